"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and everything outside ASCII, A-Z lower-cased. Seeds (runs of least words) that a
text shares with a benchmark item are joined; an item whose places under seeds can't reach the threshold is dropped
(no tile lies outside of seeds). The rest is tiled: windows of a search length, hashed by running Karp-Rabin, give
maximal matches of unmarked words; the longest are marked first, never overlapping, and the search length shrinks to
least. The share of the item's words under tiles decides, in whatever order the tiles stand in the text.

The benchmark goes to the executors in blocks of at most BLOCK characters; each further block is another pass.

Defined cases: a null text or item counts as empty, and an item without words is never found; an item of fewer than
least words is found where all its words stand in a row; null ids are kept as they are; rows that repeat are judged
each; columns are handed on by clean_documents whatever their names; empty tables give no findings. Texts are taken
whole, whatever their length; a task holds the words of one text, or of about 1 MB of shorter ones, and for each text at
most as many pairs of seeds as the block of the benchmark has seeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import bytewords as W
from quillgraph.llm.common import pieces, small_batches, thrifty, utf8

BLOCK = 16_000_000
LEAST, SHARE = 4, 0.6
_BASE = np.uint64(0x9E3779B97F4A7C15)


def windows(h: np.ndarray, s: int, top: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2**64) of all windows of s words, from running sums; top: the longest text's length."""
    if len(h) < s:
        return np.zeros(0, np.uint64)
    power = np.ones(top + 1, np.uint64)
    np.cumprod(np.full(top, _BASE), out=power[1:])
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=run[1:])
    return (run[s:] - run[:-s]) * power[top - np.arange(len(h) - s + 1)]


def tiles(item: np.ndarray, text: np.ndarray, least: int = LEAST, blocked: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in text, length); blocked words of the text match nothing."""
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool) if blocked is None else ~blocked
    out: list[tuple[int, int, int]] = []
    s = max(least, 20)
    while True:
        found = maximal(item, text, free_i, free_t, s)
        longest = max((m[2] for m in found), default=0)
        if longest > 2 * s:
            s = longest
            continue
        for i, t, n in sorted(found, key=lambda m: (-m[2], m[0], m[1])):
            if free_i[i : i + n].all() and free_t[t : t + n].all():
                free_i[i : i + n] = free_t[t : t + n] = False
                out.append((i, t, n))
        again = any(free_i[i : i + n].sum() >= s for i, t, n in found)
        if again and maximal(item, text, free_i, free_t, s):
            continue
        if s == least:
            return out
        s = s // 2 if s > 2 * least else least


def maximal(item: np.ndarray, text: np.ndarray, free_i: np.ndarray, free_t: np.ndarray, s: int) -> list[tuple[int, int, int]]:
    """Matches of at least s free words that can't be made longer on either side."""
    top = max(len(item), len(text))
    wi, wt = windows(item, s, top), windows(text, s, top)
    if not len(wi) or not len(wt):
        return []
    ai = np.flatnonzero(np.convolve(free_i, np.ones(s, int), "valid") == s)
    at = np.flatnonzero(np.convolve(free_t, np.ones(s, int), "valid") == s)
    order = ai[np.argsort(wi[ai], kind="stable")]
    low, high = np.searchsorted(wi[order], wt[at]), np.searchsorted(wi[order], wt[at], side="right")
    n = high - low
    if not n.sum():
        return []
    t = np.repeat(at, n)
    i = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    true = np.ones(len(t), bool)
    for j in range(s):  # equal hashes are checked word by word
        true &= item[i + j] == text[t + j]
    i, t = i[true], t[true]
    by = np.lexsort((i, t - i))
    i, t = i[by], t[by]
    first = np.ones(len(i), bool)
    first[1:] = (t[1:] - i[1:] != t[:-1] - i[:-1]) | (i[1:] != i[:-1] + 1)
    begin = np.flatnonzero(first)
    count = np.diff(np.append(begin, len(i)))
    return [(int(a), int(b), int(c) + s - 1) for a, b, c in zip(i[begin], t[begin], count)]


class Benchmark:
    """A block of items: words, and seeds with their places."""

    def __init__(self, rows: list[tuple], least: int):
        self.ids, self.least = [r[0] for r in rows], least
        raw, off = utf8(pa.array([r[1] or "" for r in rows], pa.string()))
        s, e, self.off = W.find_words(raw, off, W.SYMBOL)
        self.words = W.hash_words(raw, s, e)
        self.size = np.diff(self.off)
        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b - least + 1) for a, b in zip(self.off[:-1], self.off[1:]) if b - a >= least)])
        seeds = seeds_of(self.words, least)[at] if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.at = seeds[order], at[order]
        self.item = np.searchsorted(self.off, self.at, side="right") - 1
        # items that are shorter than a seed, by their length: hashes of whole items, and items
        self.short = []
        for k in range(1, least):
            own = np.flatnonzero(self.size == k)
            if len(own):
                whole = np.concatenate([seeds_of(self.words[a : a + k], k) for a in self.off[own]])
                by = np.argsort(whole, kind="stable")
                self.short.append((k, whole[by], own[by]))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.seeds & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def findings(self, raw: np.ndarray, off: np.ndarray, share: float) -> list[tuple[int, int, float, int]]:
        """(row, item, coverage, tiles) of all rows and items that reach the share."""
        s, e, woff = W.find_words(raw, off, W.SYMBOL)
        h = W.hash_words(raw, s, e)
        out: list[tuple[int, int, float, int]] = []
        for k, whole, item in self.short:
            g = seeds_of(h, k)
            low, high = np.searchsorted(whole, g), np.searchsorted(whole, g, side="right")
            at = np.flatnonzero(high > low)
            row = np.searchsorted(woff, at, side="right") - 1
            fits = at + k <= woff[row + 1]
            pairs = {(int(r), int(i)) for r, p in zip(row[fits], at[fits]) for i in item[low[p] : high[p]]}
            out.extend((r, i, 1.0, 1) for r, i in sorted(pairs))
        if len(h) < self.least or not len(self.seeds):
            return out
        g = seeds_of(h, self.least)
        at = np.flatnonzero(self.bits[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
        row = np.searchsorted(woff, at, side="right") - 1
        at, row = (x[at + self.least <= woff[row + 1]] for x in (at, row))
        known = np.searchsorted(self.seeds, g[at])
        true = self.seeds[np.minimum(known, len(self.seeds) - 1)] == g[at]
        at, row, known = at[true], row[true], known[true]
        if not len(at):
            return out
        # each row's different seeds, with all places of items that have them
        by = np.lexsort((known, row))
        first = np.ones(len(by), bool)
        first[1:] = (known[by][1:] != known[by][:-1]) | (row[by][1:] != row[by][:-1])
        one = by[first]
        n = np.searchsorted(self.seeds, g[at[one]], side="right") - known[one]
        begin = 0
        while begin < len(one):  # whole rows, as many as give about a million pairs
            end = begin + max(1, int(np.searchsorted(np.cumsum(n[begin:]), 1 << 20)))
            end = int(np.searchsorted(row[one], row[one[min(end, len(one)) - 1]], side="right"))
            out.extend(self.tiled(h, at, row, g, one[begin:end], known, n[begin:end], share))
            begin = end
        return out

    def tiled(self, h: np.ndarray, at: np.ndarray, row: np.ndarray, g: np.ndarray, one: np.ndarray, known: np.ndarray, n: np.ndarray, share: float) -> list[tuple[int, int, float, int]]:
        """Findings of some rows. one: their different seeds as indices of at, each in n places of items."""
        hit = np.repeat(known[one], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair = np.repeat(row[one], n) * len(self.ids) + self.item[hit]
        by = np.lexsort((self.at[hit], pair))
        pair, at_item = pair[by], self.at[hit][by]
        # words of the item under seeds: each place adds what it doesn't share with the next one
        same = np.zeros(len(pair), bool)
        same[:-1] = pair[1:] == pair[:-1]
        step = np.full(len(pair), self.least)
        step[:-1] = np.where(same[:-1], np.minimum(self.least, at_item[1:] - at_item[:-1]), self.least)
        begin = np.flatnonzero(np.concatenate([[True], ~same[:-1]]))
        bound = np.add.reduceat(step, begin)
        out = []
        for a, c in zip(begin, bound):
            r, i = divmod(int(pair[a]), len(self.ids))
            if c < share * self.size[i]:
                continue
            low, high = np.searchsorted(row, r), np.searchsorted(row, r, side="right")
            words = self.words[self.off[i] : self.off[i + 1]]
            spots = at[low:high][np.isin(g[at[low:high]], seeds_of(words, self.least))]
            cover = np.unique((spots[:, None] + np.arange(self.least)).ravel())
            gaps = np.flatnonzero(np.diff(cover) > 1) + 1
            text = np.insert(h[cover], gaps, 0)
            blocked = np.insert(np.zeros(len(cover), bool), gaps, True)
            found = tiles(words, text, self.least, blocked)
            covered = sum(t[2] for t in found) / self.size[i]
            if covered >= share:
                out.append((r, i, float(covered), len(found)))
        return out


def seeds_of(h: np.ndarray, k: int) -> np.ndarray:
    g = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        g = W.mix((g * _BASE) ^ h[j : len(h) - k + 1 + j]) if len(g) else g
    return g


def benchmark_blocks(bench: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    rows = bench.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // BLOCK))
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        if found := [tuple(r) for r in part.collect()]:
            yield found


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = LEAST, share: float = SHARE) -> DataFrame:
    """A row per document and item that it holds: doc_id, item_id, coverage (0 to 1), n_tiles."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(text_col), F.col(id_col).alias("doc_id"))
    kinds = source.schema["doc_id"].dataType.simpleString(), bench.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, coverage double, n_tiles int"
    done = docs.sparkSession.createDataFrame([], schema)
    for rows in benchmark_blocks(bench, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        @thrifty
        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = Benchmark(sent.value, least)
            for batch in batches:
                raw, off = utf8(batch.column(0))
                for a, b in pieces(off):
                    if found := block.findings(raw[off[a] : off[b]], off[a : b + 1] - off[a], share):
                        r, i, c, n = zip(*found)
                        ids = pa.array([block.ids[x] for x in i])
                        yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array([a + x for x in r])), ids, pa.array(c), pa.array(n, pa.int32())], ["doc_id", "item_id", "coverage", "n_tiles"])

        part = source.mapInArrow(run, schema)
        done = done.unionByName(part)
    return done


def clean_documents(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = LEAST, share: float = SHARE) -> DataFrame:
    """The documents that hold no item, with their columns."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)
    kinds = ", ".join(f"`c{i}` {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    out = docs.toDF(*[f"c{i}" for i in range(len(names))])
    for rows in benchmark_blocks(bench, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        @thrifty
        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = Benchmark(sent.value, least)
            for batch in batches:
                raw, off = utf8(batch.column(at))
                keep = np.ones(batch.num_rows, bool)
                for a, b in pieces(off):
                    for r, *_ in block.findings(raw[off[a] : off[b]], off[a : b + 1] - off[a], share):
                        keep[a + r] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, kinds)
    return out.toDF(*names)
