"""Vector math on array columns, and the hashing embedder."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 256


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of an ASCII string."""
    codes = F.transform(F.filter(F.split(c, ""), lambda s: s != ""), lambda s: F.ascii(s).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))


def content_hash(c: Column) -> Column:
    return F.lower(F.conv(fnv1a(c).cast("string"), 10, 36))


def bucket_and_sign(c: Column) -> Column:
    h = fnv1a(c)
    return F.struct((h % DIM).cast("int").alias("bucket"), F.when(h >= 2147483648, 1).otherwise(-1).alias("sign"))


def doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; the shorter length counts."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    size = norm(x) * norm(y)
    return F.when(size > 0, dot(x, y) / size).otherwise(0.0)


def let(value: Column, body) -> Column:
    """body(value), with value computed once: what a lambda refers to otherwise is computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalized(a: Column) -> Column:
    scaled = lambda v: F.transform(v["a"], lambda x: F.when(v["n"] > 0, x.cast("double") / v["n"]).otherwise(x.cast("double")))
    return let(a, lambda a: let(F.struct(a.alias("a"), norm(a).alias("n")), scaled))


def prefix(a: Column, size: int) -> Column:
    """The first numbers, at unit length again."""
    return normalized(F.slice(a, 1, size))


def quantized(a: Column) -> Column:
    """struct<codes array<int>, scale double>: symmetric 8-bit codes whose dot products approach cosines by scale."""
    def coded(v: Column) -> Column:
        a, top = v["a"], v["top"]
        codes = F.transform(a, lambda x: F.when(top > 0, F.floor(x.cast("double") * 127 / top + 0.5)).otherwise(0).cast("int"))
        return F.struct(codes.alias("codes"), F.when(top > 0, top / (127 * norm(a))).otherwise(0.0).alias("scale"))

    return let(a, lambda a: let(F.struct(a.alias("a"), F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))).alias("top")), coded))


def sparse(c: Column) -> Column:
    """Token counts by hash bucket."""
    from quillgraph.functions.text import tokens

    buckets = F.transform(tokens(c), lambda t: (fnv1a(F.concat(F.lit("w:"), t)) % DIM).cast("int"))
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(buckets)), lambda b: F.struct(b, F.size(F.filter(buckets, lambda x: x == b)))))


def _fnv(s: str) -> int:
    h = 2166136261
    for ch in s:
        h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
    return h


def hash_vector(text: str | None, known: dict[str, int]) -> np.ndarray:
    """Words, their padded letter trigrams and word pairs, hashed with signs into DIM numbers of unit length."""
    v = np.zeros(DIM)
    words = re.findall("[a-z0-9]+", (text or "").lower())

    def add(feature: str, weight: float) -> None:
        h = known.get(feature)
        if h is None:
            if len(known) > 200_000:
                known.clear()
            h = known[feature] = _fnv(feature)
        v[h % DIM] += weight if h >= 1 << 31 else -weight

    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    for w, c in counts.items():
        weight = 1 + math.log(c)
        add(f"w:{w}", weight)
        padded = f"#{w}#"
        for i in range(max(1, len(padded) - 2)):
            add(f"c:{padded[i : i + 3]}", 0.5 * weight)
    for a, b in zip(words, words[1:]):
        add(f"b:{a}_{b}", 0.7)
    size = math.sqrt((v * v).sum())
    return v / size if size else v


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123)]] = True
_PRIME = np.uint32(16777619)


def _state(prefix: str) -> np.uint32:
    return np.uint32(_fnv(prefix))


def _hash_on(state: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """32-bit FNV-1a of each run of bytes, going on from a state each."""
    h = state.copy()
    at, i = np.flatnonzero(size > 0), 0
    while len(at):
        h[at] = (h[at] ^ raw[start[at] + i]) * _PRIME
        i += 1
        at = at[size[at] > i]
    return h


def _runs(length: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs in a row, each element's place in its run, and that place counted from the run's begin."""
    inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    return inner, np.repeat(begin, length) + inner


def hash_vectors(texts: list[str | None]) -> np.ndarray:
    """hash_vector of many texts at once, over the bytes of all of them."""
    n = len(texts)
    raw = np.frombuffer(("\n".join((t or "").replace("\n", " ") for t in texts) + "\n").lower().encode(), np.uint8)
    inside = np.concatenate([[False], _WORD[raw], [False]])
    start = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    size = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1 - start
    row = np.searchsorted(np.flatnonzero(raw == 10), start)
    wide = raw.astype(np.uint32)
    own = np.full(len(start), _state("w:"), np.uint32)
    own = _hash_on(own, wide, start, size)
    # words are told apart by two hashes
    other = _hash_on(np.full(len(start), np.uint32(0x9E3779B9), np.uint32), wide * np.uint32(31) + np.uint32(7), start, size)
    # each different word is looked at once, however many texts hold it
    key, place, word = np.unique(own.astype(np.uint64) << np.uint64(32) | other, return_index=True, return_inverse=True)
    pair, count = np.unique(row * len(key) + word, return_counts=True)
    text, said = pair // max(1, len(key)), pair % max(1, len(key))
    weight = 1 + np.log(np.maximum(count, 1))
    cells, parts = [text * DIM + own[place][said] % DIM], [np.where(own[place][said] >= 1 << 31, weight, -weight)]
    # letter triples of each different word, with a sign on both ends
    length, begin = size[place], start[place]
    inner, at = _runs(length, begin)
    edge = np.uint32(ord("#"))
    before = np.where(inner > 0, wide[np.maximum(at - 1, 0)], edge)
    after = np.where(inner + 1 < np.repeat(length, length), wide[np.minimum(at + 1, len(wide) - 1)], edge)
    h = np.full(len(at), _state("c:"), np.uint32)
    for x in (before, wide[at], after):
        h = (h ^ x) * _PRIME
    _, at = _runs(length[said], (np.cumsum(length) - length)[said])
    cells.append(np.repeat(text * DIM, length[said]) + (h % DIM)[at])
    parts.append(np.repeat(weight, length[said]) * np.where(h >= 1 << 31, 0.5, -0.5)[at])
    pair = np.flatnonzero(row[1:] == row[:-1])
    h = (_hash_on(np.full(len(key), _state("b:"), np.uint32), wide, begin, length) ^ np.uint32(ord("_"))) * _PRIME
    h = _hash_on(h[word[pair]], wide, start[pair + 1], size[pair + 1])
    cells.append(row[pair] * DIM + h % DIM)
    parts.append(np.where(h >= 1 << 31, 0.7, -0.7))
    v = np.bincount(np.concatenate(cells).astype(np.int64), weights=np.concatenate(parts), minlength=n * DIM).reshape(n, DIM)
    norm = np.sqrt((v * v).sum(1))
    return v / np.where(norm > 0, norm, 1)[:, None]


#: letters of texts that are embedded at once; more of them don't fit into a processor's cache
BLOCK = 1 << 18


def hash_embedding(texts, once: bool = False) -> Column:
    """The vectors of a text column, as array<float>; from Arrow to Arrow, without an object per text. With once a
    filter on them isn't pushed to where they would be computed for it, and again for the result."""

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        out, part, held = [np.zeros(0, np.float32)], [], 0
        for t in texts.to_pylist():
            part.append(t)
            held += len(t or "")
            if held > BLOCK:
                out.append(hash_vectors(part).astype(np.float32).reshape(-1))
                part, held = [], 0
        if part:
            out.append(hash_vectors(part).astype(np.float32).reshape(-1))
        off = np.arange(len(texts) + 1, dtype=np.int32) * DIM
        return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(out)))

    return (embed.asNondeterministic() if once else embed)(texts)
