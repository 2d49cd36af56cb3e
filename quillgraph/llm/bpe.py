"""Byte-level BPE: exact merges in linear time by longest matches, backtracking and a pair test.

Each pretoken's bytes are read as Latin-1, so that pyahocorasick finds every vocabulary entry in them in one pass.
Encoding takes the longest entry at each place and goes back to shorter ones where the entry doesn't stand beside
the one before it in merged output. That test (of two ids alone) unwinds both ids' merges; its results are memoised.
Texts are cut at white space, where pretokens never reach over, and the parts' ids are kept in a table of bounded size
by the parts' 64-bit hashes, so that the pattern and the automaton see each part once as long as the table holds it.

Defined cases: a null text counts as empty and gives no ids; rows that repeat are encoded each for itself; other
columns are handed on where keep names them; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import bytewords as W
from quillgraph.llm.common import pieces, small_batches, thrifty, utf8

#: entries of each worker's dictionaries; slots and ids of its table of text parts
MEMORY, SLOTS, MOST = 100_000, 1 << 20, 1 << 22


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        top = max(ranks.values()) + 1
        self.size = [0] * top
        self.split: list[tuple[int, int]] = [(i, i) for i in range(top)]
        self.merged: dict[tuple[int, int], int] = {}
        self.shorter: list[int] = [-1] * top
        self.auto = ahocorasick.Automaton()
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            parts = merge(token, ranks, i)
            self.size[i] = len(token)
            if len(token) > 1:
                if len(parts) != 2:
                    continue  # no merges lead to it: only a whole pretoken can be this entry
                self.split[i] = (ranks[parts[0]], ranks[parts[1]])
                self.merged[self.split[i]] = i
            self.auto.add_word(token.decode("latin-1"), i)
        self.auto.make_automaton()
        for token, i in ranks.items():
            for n in range(len(token) - 1, 0, -1):
                j = ranks.get(token[:n])
                if j is not None and token[:n].decode("latin-1") in self.auto:
                    self.shorter[i] = j
                    break
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.forget()

    def beside(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when the bytes of both are merged."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 2 * MEMORY:
                self.pairs.clear()
            known = self.pairs[key] = self._beside(a, b)
        return known

    def _beside(self, a: int, b: int) -> bool:
        limit = 1 << 60
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, self.split[a][1]
                if a == limit:
                    limit, b = b + 1, self.split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.split[b][0]
                if b + 1 == limit:
                    limit, a = a, self.split[a][1]
                    if a == limit:
                        return True

    def piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        size, shorter, beside = self.size, self.shorter, self.beside
        longest = [-1] * (len(piece) + 1)
        for end, i in self.auto.iter(piece.decode("latin-1")):
            at = end + 1 - size[i]
            if longest[at] < 0 or size[longest[at]] < size[i]:
                longest[at] = i
        open_at = bytearray(b"\1") * (len(piece) + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while token >= 0:
            last = out[-1] if out else -1
            while True:
                end = pos + size[token]
                if open_at[end] and (last < 0 or beside(last, token)):
                    out.append(token)
                    pos, token = end, longest[end]
                    break
                token = shorter[token]
                if token < 0:
                    open_at[pos] = 0
                    out.pop()
                    pos, token = pos - size[last], last
                    break
        return tuple(out)

    def ids(self, text: str) -> list[int]:
        known, out = self.pieces, []
        for p in self.find(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p.encode())
                if len(p) < 100:
                    if len(known) > MEMORY:
                        known.clear()
                    known[p] = ids
            out.extend(ids)
        return out

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and their numbers."""
        begin, end, row, odd = chunks(raw, off)
        h = W.hash_words(raw, begin, end, False)
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        place, size = self.start[slot], self.count[slot]
        miss = np.flatnonzero(self.keys[slot] != h)
        text = raw.tobytes()
        if len(miss):
            new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[first]
            got = [self.ids(text[x:y].decode()) for x, y in zip(begin[at].tolist(), end[at].tolist())]
            n = np.array([len(x) for x in got])
            fresh = np.array([y for x in got for y in x], np.int32)
            if self.used + len(fresh) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(fresh)), np.int32)])
            self.flat[self.used : self.used + len(fresh)] = fresh
            where = self.used + np.cumsum(n) - n
            self.used += len(fresh)
            place[miss], size[miss] = where[back], n[back]
            keep = n < 64
            s = (new & np.uint64(SLOTS - 1)).astype(np.int64)[keep]
            self.keys[s], self.start[s], self.count[s] = new[keep], where[keep], n[keep]
        ends = np.cumsum(size)
        out = self.flat[np.repeat(place - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        counts = np.bincount(row, weights=size, minlength=len(off) - 1).astype(np.int64)
        if len(odd):  # texts with other white space go through the pattern as a whole
            parts = np.split(out, np.cumsum(counts)[:-1])
            for i in odd.tolist():
                parts[i] = np.array(self.ids(text[off[i] : off[i + 1]].decode()), np.int32)
                counts[i] = len(parts[i])
            out = np.concatenate(parts)
        if self.used > MOST:
            self.forget()
        return out, counts

    def forget(self) -> None:
        self.keys, self.start, self.count = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0


def chunks(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begins, ends and rows of parts that pretokens never reach over, and the rows that have to go as a whole.

    Of a run of white space before a word the pattern takes all but the last character, then that one, with the word
    if it is a space; a run that ends a text is one pretoken. That holds for ASCII white space; rows with any other
    are given apart, without parts.
    """
    starts, ends, woff = W.find_words(raw, off)
    n = np.diff(woff)
    row = np.repeat(np.arange(len(n)), n)
    before = np.empty_like(starts)
    before[1:] = ends[:-1]
    heads = woff[:-1][n > 0]
    before[heads] = off[:-1][n > 0]
    gap = starts - before
    lead = (gap > 0) & (raw[np.maximum(starts - 1, 0)] == 0x20)
    rest = np.flatnonzero(gap > 1)
    sole = np.flatnonzero((gap > 0) & ~lead)
    last = np.where(n > 0, ends[np.maximum(woff[1:] - 1, 0)] if len(ends) else 0, off[:-1])
    tail = np.flatnonzero(off[1:] > last)
    begin = np.concatenate([starts - lead, before[rest], starts[sole] - 1, last[tail]])
    end = np.concatenate([ends, starts[rest] - 1, starts[sole], off[1:][tail]])
    rows = np.concatenate([row, row[rest], row[sole], tail])
    order = np.argsort(begin, kind="stable")
    begin, end, rows = begin[order], end[order], rows[order]
    odd = np.zeros(len(n), bool)
    other = other_space(raw)
    if len(other):
        odd[np.searchsorted(off, other, side="right") - 1] = True
        keep = ~odd[rows]
        begin, end, rows = begin[keep], end[keep], rows[keep]
    return begin, end, rows, np.flatnonzero(odd)


def other_space(raw: np.ndarray) -> np.ndarray:
    """Where white space outside of ASCII (or a separator among its control characters) may stand."""
    if len(raw) < 2:
        return np.flatnonzero((raw >= 0x1C) & (raw <= 0x1F))
    a, b = raw[:-1], raw[1:]
    found = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80)) | ((a >= 0x1C) & (a <= 0x1F))
    return np.flatnonzero(np.append(found, 0x1C <= raw[-1] <= 0x1F))


def merge(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Merges of rank under below, lowest rank first, leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if ranks.get(parts[best] + parts[best + 1], 1 << 60) >= below:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(read_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, and ids array<int>. path: a file of ranks, the same for all executors."""

    names = [*(f"k{i}" for i in range(len(keep))), "ids"]

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            raw, off = utf8(batch.column(0))
            for a, b in pieces(off):
                ids, n = e.encode(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                at = np.zeros(b - a + 1, np.int64)
                np.cumsum(n, out=at[1:])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], names)

    small_batches(docs.sparkSession)
    source = docs.select(F.col(text_col), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    kinds = "".join(f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    return source.mapInArrow(run, kinds + "ids array<int>").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "ids")


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, ids, and decoded binary: the bytes that the ids stand for."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, start, size = bytes_of(path)
        for batch in batches:
            ids = batch.column(0)
            flat, off = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy().astype(np.int64)
            out = []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                out.append(b"".join(expand(table, start, size, flat[i : min(b, i + 500_000)]) for i in range(a, b, 500_000)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], ids, pa.array(out, pa.binary())], [*(f"k{i}" for i in range(len(keep))), "ids", "decoded"])

    source = encoded.select("ids", *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    kinds = "".join(f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    return source.mapInArrow(run, kinds + "ids array<int>, decoded binary").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "ids", "decoded")


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, ids array<int>, and decoded binary, in one pass of Python."""
    names = [*(f"k{i}" for i in range(len(keep))), "ids", "decoded"]

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        table, start, size = bytes_of(path)
        for batch in batches:
            raw, off = utf8(batch.column(0))
            for a, b in pieces(off):
                ids, n = e.encode(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                at = np.zeros(b - a + 1, np.int64)
                np.cumsum(n, out=at[1:])
                whole = b"".join(expand(table, start, size, ids[i : i + 500_000]) for i in range(0, len(ids), 500_000))
                length = np.concatenate([[0], np.cumsum(size[ids])])[at]
                decoded = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(length.astype(np.int32)), pa.py_buffer(whole)])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)), decoded], names)

    small_batches(docs.sparkSession)
    source = docs.select(F.col(text_col), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    kinds = "".join(f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    return source.mapInArrow(run, kinds + "ids array<int>, decoded binary").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "ids", "decoded")


def expand(table: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray) -> bytes:
    n = size[ids]
    ends = np.cumsum(n)
    return table[np.repeat(start[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


_BYTES: dict[str, tuple] = {}


def bytes_of(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if path not in _BYTES:
        ranks = read_ranks(path)
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            size[i] = len(t)
        start = np.cumsum(size) - size
        _BYTES[path] = (np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8), start, size)
    return _BYTES[path]
