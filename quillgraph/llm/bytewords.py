"""Words, shingles and sets of a whole batch of texts at once, as numpy arrays over their UTF-8 bytes.

Words are hashed to 64 bits, eight bytes at a time with multiply-xor mixing, after lower-casing A-Z. Two different
words agree with probability 2**-64. All separators are ASCII, so that bytes and code points give the same words.
"""

from __future__ import annotations

import hashlib

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: everything ASCII but digits and letters
SYMBOL = np.array([not (i >= 0x80 or chr(i).isalnum()) for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
_LONG = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= _B
    x ^= x >> np.uint64(27)
    x *= _C
    x ^= x >> np.uint64(31)
    return x


def find_words(raw: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and offsets of each row's words: row i has words woff[i] to woff[i + 1]."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~separators[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = off[:-1][off[:-1] < len(raw)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = off[1:][off[1:] > 0] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, lower-cased if fold is set."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    buf = np.zeros(len(raw) + 8, np.uint8)
    buf[: len(raw)] = LOWER[raw] if fold else raw
    lanes = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=buf, strides=(1,))
    n = ends - starts
    h = mix((lanes[starts] & _MASKS[np.minimum(n, 8)]) ^ (n.astype(np.uint64) * _A))
    at = np.flatnonzero((n > 8) & (n <= _LONG))
    k = 8
    while len(at):
        left = n[at] - k
        h[at] = mix((h[at] * _A) ^ (lanes[starts[at] + k] & _MASKS[np.minimum(left, 8)]))
        at = at[left > 8]
        k += 8
    for i in np.flatnonzero(n > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def shingles(h: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and offsets by row; a row of fewer words has one, of all its words."""
    n = np.diff(woff)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    soff = np.zeros(len(woff), np.int64)
    np.cumsum(count, out=soff[1:])
    out = np.zeros(soff[-1], np.uint64)
    if len(h) >= k:
        g = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            g = mix((g * _A) ^ h[j : len(h) - k + 1 + j])
        rows = np.flatnonzero(n >= k)
        at = np.repeat(woff[rows] - soff[rows], count[rows]) + positions(soff, rows, count)
        out[positions(soff, rows, count)] = g[at]
    for i in np.flatnonzero((n > 0) & (n < k)):
        x = np.array([n[i]], np.uint64)
        for w in h[woff[i] : woff[i + 1]]:
            x = mix((x * _C) ^ w)
        out[soff[i]] = x[0]
    return out, soff


def positions(off: np.ndarray, rows: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All positions off[r] ... off[r] + count[r] - 1 of the given rows, one after another."""
    c = count[rows]
    total = int(c.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(c)
    return np.arange(total) + np.repeat(off[rows] - (ends - c), c)


def unique_sets(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes in ascending order, and their offsets."""
    n = len(off) - 1
    outs, counts = [], []
    a = 0
    while a < n:
        b = min(n, a + 65536)
        x, o = h[off[a] : off[b]], off[a : b + 1] - off[a]
        seg = np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(o))
        key = (seg << np.uint64(48)) | (x >> np.uint64(16))
        order = np.argsort(key)
        key, y, s = key[order], x[order], seg[order]
        if len(key) > 1 and ((key[1:] == key[:-1]) & (y[1:] != y[:-1])).any():
            order = np.lexsort((x, seg))
            y, s = x[order], seg[order]
        keep = np.ones(len(y), bool)
        keep[1:] = (y[1:] != y[:-1]) | (s[1:] != s[:-1])
        outs.append(y[keep])
        counts.append(np.bincount(s[keep].astype(np.int64), minlength=b - a))
        a = b
    out = np.zeros(n + 1, np.int64)
    if counts:
        np.cumsum(np.concatenate(counts), out=out[1:])
    return (np.concatenate(outs) if outs else np.zeros(0, np.uint64)), out


def set_keys(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row's set (0 for an empty one); equal sets have equal keys."""
    n = np.diff(off)
    total = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(mix(sets), out=total[1:])
    key = mix((total[off[1:]] - total[off[:-1]]) ^ (n.astype(np.uint64) * _A))
    key[n == 0] = 0
    return key.view(np.int64)


def split_lines(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines (line feeds end them, and belong to them) and offsets of each row's lines; a row without text has none."""
    cuts = np.flatnonzero(raw == 10) + 1
    loff = np.unique(np.concatenate([cuts, off, [0]]))
    return loff, np.searchsorted(loff, off)
