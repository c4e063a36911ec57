"""Embedders: text in, array<float> out.

The default is a hashing embedder: every word votes for a slot with a sign, both
from its MD5. It needs no model and equals what SQL makes of the same formula.
``OnnxEmbedder`` runs a model where there is one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvine.functions.arrow import bytes_of, lists, ranges

SLOTS = 64


# the functions of columns are declared as not deterministic: Spark would compute them
# once more for every filter on what they give

#: Distinct words whose votes a worker remembers.
WORDS_KEPT = 1 << 16
#: Upper case as lower case, what is in no word as a space, line feeds as they are.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c in b"_\n" else 32 for c in range(256))
_votes: dict[bytes, int] = {}


def _vote(word: bytes) -> int:
    v = _votes.get(word)
    if v is None:
        if len(_votes) >= WORDS_KEPT:
            _votes.clear()
        v = _votes[word] = int(hashlib.md5(word).hexdigest()[:4], 16)
    return v


def counted(texts: pa.Array, slots: int) -> np.ndarray:
    """A line of counts of signed slots for each text, zeros for null. Only lines that
    differ are looked at, each once."""
    closed = pc.binary_join_element_wise(texts.cast(pa.large_string()).fill_null(""), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    data, off = bytes_of(closed)
    data = data.tobytes().translate(_WORDS)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    lines = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    words = [line.split() for line in lines.dictionary.to_pylist()]
    vote = np.fromiter((_vote(w) for ws in words for w in ws), np.int64)
    slot, sign = vote % slots, np.where((vote // slots) % 2 == 0, 1.0, -1.0)
    size, line = np.fromiter(map(len, words), np.int64, len(words)), lines.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(ends, off, "right")))
    n, start = size[line], (np.cumsum(size) - size)[line]
    at = ranges(start, start + n)
    place = np.repeat(text, n) * slots + slot[at]
    return np.bincount(place, weights=sign[at], minlength=len(texts) * slots).reshape(-1, slots) + 0.0


class HashingEmbedder:
    """Words (runs of a-z, digits and underscores after ASCII lower-casing) vote by
    Arrow batches."""

    model_name = "hashing"

    def __init__(self, slots: int = SLOTS):
        self.dimension = slots

    def embed(self, text: Column) -> Column:
        """Counts of signed slots, not yet of length one; zeros for null."""
        slots = self.dimension

        @F.arrow_udf("array<double>")
        def count(rows: pa.Array) -> pa.Array:
            return lists(counted(rows, slots))

        return count.asNondeterministic()(text)

    def units(self, texts: pa.Array) -> pa.Array:
        """The same of length one (F4), null for a text without words."""
        x = counted(texts, self.dimension)
        s = (x * x).sum(axis=1)
        none = s < 1e-12
        return lists(x / np.sqrt(np.where(none, 1.0, s))[:, None], none)

    def unit(self, text: Column) -> Column:
        own = self

        @F.arrow_udf("array<double>")
        def scale(rows: pa.Array) -> pa.Array:
            return own.units(rows)

        return scale.asNondeterministic()(text)

    def embed_text(self, text: str) -> list[float]:
        """The same of one text on the driver."""
        return counted(pa.array([text]), self.dimension)[0].tolist()


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of the unmasked token states of each row."""
    m = mask[:, :, None].astype(np.float64)
    return (states * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)


class OnnxEmbedder:
    """V2: a model that pools inside; loaded once a worker."""

    def __init__(self, model: str, tokenizer: str, dimension: int = 384, max_length: int = 512):
        self.model, self.tokenizer, self.dimension, self.max_length = model, tokenizer, dimension, max_length

    def embed(self, text: Column) -> Column:
        model, path, longest = self.model, self.tokenizer, self.max_length

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import onnxruntime

            from corvine.functions.tokenizer import WordPiece

            session = onnxruntime.InferenceSession(model, providers=["CUDAExecutionProvider", "CPUExecutionProvider"])
            tokens = WordPiece.load(path)
            for texts in batches:
                ids, mask = tokens.batch([t or "" for t in texts], longest)
                out = session.run(None, {"input_ids": ids, "attention_mask": mask})[0]
                length = np.sqrt((out * out).sum(axis=1))
                yield pd.Series([None if n * n < 1e-12 else (v / n).tolist() for v, n in zip(out, length, strict=True)])

        return run(text)
