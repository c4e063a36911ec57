"""Words of UTF-8 text as numpy arrays, a whole Arrow batch at a time.

A word is a run of bytes other than space and 0x09-0x0D. Words are told apart
exactly within a batch (as Arrow dictionaries) and by their 64-bit XXH3 hashes
across batches, computed once for each distinct word of a batch. Texts of any
length are read in slices that end between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_A, _B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
SLICE = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> U(30))) * _A
    x = (x ^ (x >> U(27))) * _B
    return x ^ (x >> U(31))


@cache
def tables(fold: bool) -> tuple[np.ndarray, np.ndarray]:
    sep = np.zeros(256, bool)
    sep[[0x20, *range(0x09, 0x0E)]] = True
    case = np.arange(256, dtype=np.uint8)
    if fold:
        case[65:91] += 32
    return sep, case


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offset of each text; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each text (with
    the number of all words last)."""
    inner = ~tables(False)[0][data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    before = np.concatenate(([False], inner))
    here = np.concatenate((inner, [False]))
    starts = np.flatnonzero(here & (~before | first))
    ends = np.flatnonzero(before & (~here | first))
    return starts, ends, np.searchsorted(starts, offs)


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> pa.Array:
    """The stretches (in order, apart from each other) as a binary array."""
    change = np.zeros(len(data) + 1, np.int8)
    change[starts] += 1
    change[ends] -= 1
    body = data[np.cumsum(change[:-1], dtype=np.int8).view(bool)]
    if fold:
        body = tables(True)[1][body]
    offs = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(body)])


def numbered(items: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each item's place in the array of distinct items, and that array."""
    d = items.dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary


def hashes(items: pa.Array) -> np.ndarray:
    """A 64-bit hash of each item."""
    at, distinct = numbered(items)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), U, len(distinct))[at]


def slices(data: np.ndarray, offs: np.ndarray, limit: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of a part: whole, or, if it is one text over ``limit``
    bytes, in slices that end before a separator."""
    if len(data) <= limit or len(offs) > 2:
        yield data, offs
        return
    sep, at = tables(False)[0], 0
    while at < len(data):
        end = min(len(data), at + limit)
        while end < len(data) and not sep[data[end]]:
            ahead = np.flatnonzero(sep[data[end : end + 65536]])
            end = end + int(ahead[0]) if len(ahead) else min(len(data), end + 65536)
        yield data[at:end], np.array([0, end - at])
        at = end


def hashed(data: np.ndarray, offs: np.ndarray, fold: bool = False, digests: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, with A-Z as a-z if ``fold``, and the first word of
    each text (with the number of all words last). ``digests`` gets 128 bits of
    BLAKE2b over the words of each text: equal ones mean equal words in order."""
    out, first, sums = [], None, None
    for part, own in slices(data, offs):
        starts, ends, first = bounds(part, own)
        items = spelled(part, starts, ends, fold)
        out.append(hashes(items))
        if digests is not None:
            body, sizes = memoryview(items.buffers()[2] or b""), (ends - starts).astype("<i8")
            at = np.concatenate(([0], np.cumsum(sizes)))[first].tolist()
            if sums is None:
                sums = [(blake2b(digest_size=32), blake2b(digest_size=32)) for _ in range(len(offs) - 1)]
            for k, (letters, lengths) in enumerate(sums):
                letters.update(body[at[k] : at[k + 1]])
                lengths.update(sizes[first[k] : first[k + 1]].tobytes())
    if digests is not None:
        digests += [blake2b(a.digest() + b.digest(), digest_size=16).digest() for a, b in sums or []]
    h = out[0] if len(out) == 1 else np.concatenate(out)
    return h, first if len(out) == 1 else np.array([0, len(h)])


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of every ``width`` words in a row of one text, in order;
    and the first such window of each text, with their number last."""
    count = np.maximum(np.diff(first) - width + 1, 0)
    at = np.concatenate(([0], np.cumsum(count)))
    return np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1]), at


def windows(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each of the ``window_starts``, and their second result."""
    begin, at = window_starts(first, width)
    h = np.zeros(at[-1], U)
    for k in range(width):
        h = mix(h * _B + words[begin + k])
    return h, at


def parts(offs: np.ndarray, limit: int = 1 << 20):
    """Ranges of whole texts of about ``limit`` bytes (a longer text is one)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def each_part(texts: pa.Array, limit: int = 1 << 20):
    """(first text, end, bytes, offsets) of every part of a batch."""
    data, offs = utf8(texts)
    for i, j in parts(offs, limit):
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
