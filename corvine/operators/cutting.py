"""Chunking on the bytes of an Arrow batch of files.

The lines of a batch lie in one buffer, each ended by one line feed. Lines, blocks,
pieces and groups are arrays of line numbers in it: only lines that may start a block
(by their first letters, or by what stands before their first bracket) are looked at
one at a time, so the cost of other lines is that of reading their bytes.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corvine.functions import syntax
from corvine.functions.arrow import bytes_of, ranges, strings
from corvine.functions.languages import BEFORE_BRACKET, CALLS, FIRST_LETTERS, PATTERNS

_NONBLANK = re.compile(rb"[^ \t\r\n]")
_FNV_START, _FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(2**40 + 435)
_HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint8).reshape(256, 2)

@cache
def _set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_LETTERS = "".join(map(chr, range(128)))
_WORD_SPACE = "".join(c for c in _LETTERS if c == "_" or c.isalnum() or c in " \t\r\v\f")


@cache
def _patterns(lang: str) -> list[re.Pattern]:
    return [re.compile(p.removeprefix("^").encode()) for p in PATTERNS[lang]]


@cache
def _call(lang: str) -> re.Pattern:
    return re.compile(CALLS[lang])


def _after(text: np.ndarray, at: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """The first place from each of ``at`` on whose byte is not in ``skip``."""
    at = np.array(at)
    live = np.flatnonzero(skip[text[at]])
    for _ in range(64):
        if not len(live):
            return at
        at[live] += 1
        live = live[skip[text[at[live]]]]
    other = re.compile(b"[^" + re.escape(bytes(np.flatnonzero(skip).tolist())) + b"]")
    for k in live.tolist():
        at[k] = other.search(text, at[k]).start()
    return at


def fnv1a(keys: pa.Array) -> pa.Array:
    """As ``corvine.functions.text.fnv1a``, a byte of all keys at a time."""
    data, off = bytes_of(keys)
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    at, h, longest = off[:-1][order], np.full(len(size), _FNV_START), np.sort(size)
    for j in range(int(size.max(initial=0))):
        m = len(size) - int(np.searchsorted(longest, j, "right"))
        h[:m] = (h[:m] ^ data[at[:m] + j]) * _FNV_PRIME
    out = np.empty_like(h)
    out[order] = h
    digits = _HEX[out.astype(">u8").view(np.uint8)].reshape(-1)
    return strings(digits, np.arange(len(h) + 1) * 16)


@dataclass
class Parts:
    """Consecutive parts of files, by line: the first, the one after the last, the
    symbol (an index, -1 for none), the file, and numbers within it."""

    a: np.ndarray
    z: np.ndarray
    symbol: np.ndarray
    file: np.ndarray
    number: np.ndarray
    piece: np.ndarray


class Batch:
    """Files that are not empty, and their languages."""

    def __init__(self, content: pa.Array, langs: list[str]):
        self.langs, self.content = langs, content
        text, off = bytes_of(content)
        bare = np.flatnonzero(text[off[1:] - 1] != 10)
        if len(bare):  # C1: the last line is closed as well
            text = np.insert(text, off[1:][bare], 10)
            off = off + np.concatenate([[0], np.cumsum(np.bincount(bare, minlength=len(langs)))])
        if (text == 13).any():  # C1: one carriage return before a line end goes
            gone = np.flatnonzero((text[:-1] == 13) & (text[1:] == 10))
            text, off = np.delete(text, gone), off - np.searchsorted(gone, off)
        self.text = text
        self.ends = np.flatnonzero(text == 10) + 1
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.first = np.searchsorted(self.ends, off, "right")
        self.symbols: list[str | bytes] = []

    def blank(self, lines: np.ndarray) -> np.ndarray:
        """P14, for the lines of these numbers."""
        return self.text[_after(self.text, self.starts[lines], _set(" \t\r"))] == 10

    def hashes(self) -> pa.Array:
        """SHA-256 of each file as it was, 16 digits."""
        data, off = bytes_of(self.content)
        view, off = memoryview(data), off.tolist()
        return pa.array([hashlib.sha256(view[a:b]).hexdigest()[:16] for a, b in zip(off, off[1:])], pa.string())

    def _candidates(self, lines: np.ndarray, lang: str) -> np.ndarray:
        """The lines among ``lines`` that a pattern of the language may take."""
        text, starts = self.text, self.starts[lines]
        at = starts if lang == "go" else _after(text, starts, _set(" \t"))
        some = np.flatnonzero(_set("".join(w[0] for w in FIRST_LETTERS[lang]))[text[at]])
        at, last, hit = at[some], len(text) - 1, np.zeros(len(some), bool)
        letters = [text[np.minimum(at + k, last)] for k in range(3)]
        for w in FIRST_LETTERS[lang]:
            same = letters[0] == ord(w[0])
            for k, c in enumerate(w[1:], 1):
                same &= letters[k] == ord(c)
            hit |= same
        found = np.zeros(len(lines), bool)
        found[some[hit]] = True
        if lang in BEFORE_BRACKET:
            other = np.flatnonzero(~_set(_WORD_SPACE + BEFORE_BRACKET[lang])[text])
            bracket = other[np.searchsorted(other, starts)]
            calls = np.flatnonzero(text[bracket] == 40)
            stop = np.append(np.flatnonzero(text == 59), len(text))
            found[calls[stop[np.searchsorted(stop, bracket[calls])] >= self.ends[lines[calls]] - 1]] = True
        if lang == "cpp":
            found |= np.isin(lines, self._templates())
        return lines[found]

    def _templates(self) -> np.ndarray:
        places = [m.start() for m in re.finditer(b"template", self.text)]
        return np.unique(np.searchsorted(self.ends, np.array(places, np.int64), "right"))

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        """The lines that start blocks, in order, and their symbols."""
        out, names = [], []
        langs = np.array(self.langs)
        for lang in dict.fromkeys(self.langs):
            mine = np.flatnonzero(langs == lang)
            lines = np.arange(len(self.ends)) if len(mine) == len(langs) else ranges(self.first[mine], self.first[mine + 1])
            if lang not in PATTERNS:
                blank = self.blank(lines)
                opens = np.append(True, blank[:-1])
                opens[np.searchsorted(lines, self.first[mine])] = True
                found = lines[opens & ~blank]
                out.append(found)
                names.append(np.full(len(found), -1))
                continue
            patterns, kept, text = _patterns(lang), [], self.text.tobytes()
            lines, odd = self._candidates(lines, lang), set(self._templates().tolist()) if lang == "cpp" else set()
            for k, a, z in zip(lines.tolist(), self.starts[lines].tolist(), (self.ends[lines] - 1).tolist()):
                for i, p in enumerate(patterns):
                    if i == 0 and lang in CALLS and k not in odd:
                        p = _call(lang)
                    if m := p.match(text, a, z):
                        kept.append(k)
                        self.symbols.append(m[1])
                        break
            out.append(np.array(kept, np.int64))
            names.append(np.arange(len(self.symbols) - len(kept), len(self.symbols)))
        at, symbol = np.concatenate([np.empty(0, np.int64), *out]), np.concatenate([np.empty(0, np.int64), *names])
        order = np.argsort(at, kind="stable")
        return at[order], symbol[order]

    def blocks(self) -> Parts:
        """C4: lines before the first start of a file are its block 0."""
        at, symbol = self.heads()
        top = self.first[:-1]
        headless = np.append(at, -1)[np.searchsorted(at, top)] != top
        a, symbol = np.concatenate([at, top[headless]]), np.concatenate([symbol, np.full(headless.sum(), -1)])
        order = np.argsort(a, kind="stable")
        a, symbol = a[order], symbol[order]
        file = np.searchsorted(self.first, a, "right") - 1
        number = np.arange(len(a)) - np.searchsorted(a, top)[file] + ~headless[file]
        return Parts(a, np.append(a[1:], len(self.ends)), symbol, file, number, np.zeros(len(a), np.int64))

    def found(self) -> list:
        """The definitions of each file; None where it can't be read."""
        return [syntax.definitions(t, lang) for t, lang in zip(self.content.to_pylist(), self.langs, strict=True)]

    def by_structure(self, found: list) -> Parts:
        """Innermost definitions and what lies between them, of files that
        have definitions; the number of a block is its first line."""
        rows = []
        for f, defs in enumerate(found):
            if defs:
                base = int(self.first[f])
                rows += [(base + a, base + z, name, f, a) for a, z, name in innermost(defs, int(self.first[f + 1]) - base)]
        symbol = np.full(len(rows), -1)
        for k, r in enumerate(rows):
            if r[2]:
                symbol[k] = len(self.symbols)
                self.symbols.append(r[2])
        a, z, file, number = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 3, 4))
        return Parts(a, z, symbol, file, number, np.zeros(len(a), np.int64))

    def structured(self) -> Parts:
        """The blocks of ``by_structure`` that are not blank, and for other files
        those by patterns."""
        found = self.found()
        p, q = self.by_structure(found), self.blocks()
        full = np.array([_NONBLANK.search(self.text, a, z) is not None for a, z in zip(self.starts[p.a].tolist(), self.ends[p.z - 1].tolist())], bool)
        other = np.array([not d for d in found], bool)[q.file]
        return _sorted(Parts(*(np.concatenate([x[full], y[other]]) for x, y in zip(vars(p).values(), vars(q).values(), strict=True))))

    def size(self, p: Parts) -> np.ndarray:
        return self.ends[p.z - 1] - self.starts[p.a]

    def pieces(self, p: Parts, most: int) -> Parts:
        """Oversize blocks are cut before a blank line that would pass the limit,
        and after a line that passes twice the limit; all of them in rounds, a piece
        of each a round. The symbol stays on the first piece."""
        large = self.size(p) > most
        if not large.any():
            return p
        big = np.flatnonzero(large)
        inside = ranges(p.a[big], p.z[big])
        blank = np.append(inside[self.blank(inside)], len(self.ends) + 1)
        own, a, z, piece, k = [np.flatnonzero(~large)], [p.a[~large]], [p.z[~large]], [p.piece[~large]], 0
        at = p.a[big]
        while len(big):
            base, stop = self.starts[at], p.z[big]
            late = np.searchsorted(self.ends, base + 2 * most, "right")
            early = np.maximum(np.searchsorted(self.ends, base + most, "right"), at + 1)
            early = blank[np.searchsorted(blank, early)]
            then = np.minimum(np.where(early <= late, early, late + 1), stop)
            for xs, x in ((own, big), (a, at), (z, then), (piece, np.full(len(big), k))):
                xs.append(x)
            more = then < stop
            big, at, k = big[more], then[more], k + 1
        own, piece = np.concatenate(own), np.concatenate(piece)
        return _sorted(Parts(np.concatenate(a), np.concatenate(z), np.where(piece == 0, p.symbol[own], -1), p.file[own], p.number[own], piece))

    def merged(self, p: Parts, least: int) -> tuple[Parts, np.ndarray]:
        """Tiny pieces joined to what is before them unless both are named; the
        groups, and the number of the first piece of each."""
        new = np.ones(len(p.a), bool)
        new[1:] = p.file[1:] != p.file[:-1]
        run, named = new | (self.size(p) >= least), p.symbol >= 0
        before = np.cumsum(named) - named
        before = before - before[np.maximum.accumulate(np.where(run, np.arange(len(run)), 0))]
        top = np.flatnonzero(run | (named & (before >= 1)))
        group = np.searchsorted(top, np.arange(len(p.a)), "right") - 1
        symbol, at = np.full(len(top), -1), np.flatnonzero(named)[::-1]
        symbol[group[at]] = p.symbol[at]  # the first of a group is the last to be put
        file = p.file[top]
        number = np.arange(len(top)) - np.searchsorted(file, file) + 1
        last = np.append(top[1:], len(p.a)) - 1
        return Parts(p.a[top], p.z[last], symbol, file, number, np.zeros(len(top), np.int64)), top

    def names(self, symbol: np.ndarray) -> pa.Array:
        return pa.array([*self.symbols, ""], pa.string()).take(pa.array(np.where(symbol < 0, len(self.symbols), symbol)))

    def lines_of(self, p: Parts) -> tuple[pa.Array, pa.Array]:
        """First and last lines in the file, from 1."""
        base = self.first[p.file]
        return pa.array((p.a - base + 1).astype(np.int32)), pa.array((p.z - base).astype(np.int32))

    def sizes(self, p: Parts, top: np.ndarray) -> np.ndarray:
        """Bytes of the groups that start at the pieces ``top``."""
        total = np.append(0, np.cumsum(self.size(p)))
        return total[np.append(top[1:], len(p.a))] - total[top]

    def texts(self, p: Parts, top: np.ndarray) -> pa.Array:
        """The texts of the groups that start at the pieces ``top``."""
        data = self.text
        if self.size(p).sum() < len(data):
            data = data[ranges(self.starts[p.a], self.ends[p.z - 1])]
        return strings(data, np.append(0, np.cumsum(self.sizes(p, top))))


    def full(self, texts: pa.Array) -> np.ndarray:
        """Which texts are not blank."""
        data, off = bytes_of(texts)
        data, off = data.tobytes(), off.tolist()
        return np.array([_NONBLANK.search(data, a, z) is not None for a, z in zip(off, off[1:])], bool)

    def filled(self, p: Parts, least: int) -> tuple[Parts, np.ndarray]:
        """The groups of pieces, and which of them are not blank."""
        g, top = self.merged(p, least)
        return g, self.full(self.texts(p, top))


def _sorted(p: Parts) -> Parts:
    order = np.argsort(p.a, kind="stable")
    return Parts(*(x[order] for x in vars(p).values()))


def innermost(found: list[tuple[int, int, str]], n: int) -> list[tuple[int, int, str]]:
    """C11-C13 of a file of ``n`` lines: (start, end, symbol), lines from 0, ends
    exclusive, of definitions that hold no other and unnamed blocks around them."""
    own: dict[tuple[int, int], str] = {}
    for first, last, name in found:
        own.setdefault((first - 1, last), name)
    leaf, least = [], float("inf")
    for r in sorted(own, key=lambda r: (-r[0], r[1])):
        if r[1] < least:
            leaf.append(r)
            least = r[1]
    out, at = [], 0
    for a, z in reversed(leaf):
        if at < a:
            out.append((at, a, ""))
        if max(a, at) < z:
            out.append((max(a, at), z, own[a, z]))
        at = max(at, z)
    return out + [(at, n, "")] * (at < n)


def chunks(b: Batch, p: Parts, path: pa.Array, least: int, most: int, hashed: bool = True) -> pa.RecordBatch:
    """The chunks of the blocks ``p``, blank ones dropped; without the hashes
    of files, which cost as much as the blocks, if not ``hashed``."""
    p = b.pieces(p, most)
    g, top = b.merged(p, least)
    text = b.texts(p, top)
    full = b.full(text)
    start, end = b.lines_of(g)
    own = path.take(pa.array(g.file))
    key = fnv1a(pc.binary_join_element_wise(own, start.cast(pa.string()), end.cast(pa.string()), ":"))
    file = b.hashes().take(pa.array(g.file)) if hashed else pa.nulls(len(own), pa.string())
    out = pa.RecordBatch.from_arrays([text, own, start, end, b.names(g.symbol), key, file], ["source_text", "file_path", "start_line", "end_line", "symbol_name", "chunk_id", "file_content_hash"])
    return out if full.all() else out.filter(pa.array(full))
