"""WordPiece: basic tokens, greedy longest pieces, ids, padding and decoding.

Words are bytes, as the vocabulary's file format has it: a piece may end inside
a character of several bytes.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PUNCTUATION = rb"[!-/:-@\[-`{-~]"
_BASIC = re.compile(_PUNCTUATION + rb"|[^\x00-\x20\x7f!-/:-@\[-`{-~]+")
_CONTROL = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]")


def basic_tokens(text: Column) -> Column:
    """F6 as an expression: A-Z lower-cased, split at white space, every ASCII
    punctuation mark by itself, control characters dropped."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    clean = F.regexp_replace(low, r"[\x00-\x08\x0e-\x1f\x7f]", "")
    return F.regexp_extract_all(clean, F.lit(r"[!-/:-@\[-`{-~]|[^\x00-\x20!-/:-@\[-`{-~]+"), F.lit(0))


class WordPiece:
    """``vocabulary``: ids by token; special tokens by role, each falling back to
    the usual angle-bracket name and then to id 0 (S14)."""

    def __init__(self, vocabulary: dict[str, int], lower: bool = True, prefix: str = "##", longest: int = 200):
        self.ids = {t.encode(): i for t, i in vocabulary.items()}
        self.tokens = {i: t for t, i in vocabulary.items()}
        self.lower, self.prefix, self.longest = lower, prefix.encode(), longest
        self.cls, self.sep, self.pad, self.unk = (next((vocabulary[n] for n in names if n in vocabulary), 0) for names in (("[CLS]", "<s>"), ("[SEP]", "</s>"), ("[PAD]", "<pad>"), ("[UNK]", "<unk>")))

    @classmethod
    def load(cls, path: str) -> WordPiece:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocabulary = dict(model["vocab"]) | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        normalizer = spec.get("normalizer") or {}
        return cls(vocabulary, normalizer.get("lowercase", True), model.get("continuing_subword_prefix", "##"), model.get("max_input_chars_per_word", 200))

    @property
    def vocab_size(self) -> int:
        return len(self.tokens)

    def words(self, text: str) -> list[bytes]:
        data = text.encode("utf-8", "replace")
        return _BASIC.findall(_CONTROL.sub(b"", data.lower() if self.lower else data))

    def pieces(self, word: bytes) -> list[int]:
        """the longest known piece from the left, again and again; a word
        that is too long or can't be covered is unknown as a whole."""
        if len(word) > self.longest:
            return [self.unk]
        out, at = [], 0
        while at < len(word):
            head = self.prefix if at else b""
            for end in range(len(word), at, -1):
                if (i := self.ids.get(head + word[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
            else:
                return [self.unk]
        return out

    def encode(self, text: str, max_length: int = 512) -> list[int]:
        """F8."""
        body = [i for w in self.words(text) for i in self.pieces(w)]
        return [self.cls, *body[: max(0, max_length - 2)], self.sep]

    def batch(self, texts: list[str], max_length: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask, padded to the longest text of the batch."""
        rows = [self.encode(t, max_length) for t in texts]
        width = max(map(len, rows), default=0)
        ids = np.full((len(rows), width), self.pad, np.int64)
        mask = np.zeros((len(rows), width), np.int64)
        for k, row in enumerate(rows):
            ids[k, : len(row)] = row
            mask[k, : len(row)] = 1
        return ids, mask

    def decode(self, ids: list[int]) -> str:
        """without sequence marks and padding; unknown stays."""
        words: list[str] = []
        mark = self.prefix.decode()
        for i in ids:
            if i in (self.cls, self.sep, self.pad) or i not in self.tokens:
                continue
            token = self.tokens[i]
            if token.startswith(mark) and words:
                words[-1] += token[len(mark) :]
            else:
                words.append(token)
        return " ".join(words)


def wordpiece_ids(text: Column, vocabulary: WordPiece, max_length: int = 512) -> Column:
    """F7, F8 over a column: array<long>, by Arrow batches."""
    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: vocabulary.encode(t or "", max_length))

    return run(text)
