"""Exact set-similarity join of token sets, whatever the sets come from.

1. A count sketch over all tokens (fixed length, summed over tasks) gives one global order: rare tokens first.
2. Each item gives its set's key and the set's prefix in that order; equal sets share a key and are one node.
3. Prefix tokens are shuffled once; runs of equal tokens give candidate pairs that pass the length filter, the
   index-prefix filter, the positional filter and, for small sets, a bound by parities of hash classes. A pair is given
   at the first token of each stretch of common tokens only (both predecessors are compared). Tokens of more than RUN
   postings, as a count sketch of all prefixes tells, are split into blocks, and their runs into pairs of blocks.
4. A run with more than DENSE pairs for each of its rows (a family of near copies) gives no pairs but its members, which
   are compared by blocks of about CELL tokens. Pairs of other runs get a label by their smallest neighbour; labels are
   packed into cells of about CELL tokens, larger ones are split into pairs of blocks. Only sets of candidates (a Bloom
   filter of bounded size) travel to cells; large sets only for pairs that pass an overlap bound from whole prefixes.
5. A pair counts in the run of its first common token in the global order, where it can't be missed, so that no pair
   counts twice. In a cell it passes the suffix filter (overlap bound from hash-range counts) and is verified once.
   What leaves is one row per node: weight and smallest position of its links, and a root for components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.bytewords import mix, positions, set_keys
from quillgraph.llm.common import in_slices, pieces, small_batches, stored, summed, thrifty, utf8
from quillgraph.llm.components import local_roots

BUCKETS, SLICES = 1 << 18, 64
#: tokens of the sets in one cell
CELL = 500_000
#: postings of a token in one block, and pairs for each row of a run beyond which the run's members are compared by blocks
RUN, DENSE = 200_000, 8
#: keys with the most items, known to all tasks where items are joined; any other one has less than one in HOT of them
HOT = 4096
#: keys that a task remembers in order to give a repeated set's prefix or tokens once
SEEN = 1_000_000
POS = 28
Extract = Callable[[np.ndarray, np.ndarray, bool], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def counts(docs: DataFrame, extract: Extract) -> np.ndarray:
    """How often the tokens of each hash bucket occur in all of docs (p1, p2, text)."""

    @thrifty
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            raw, off = utf8(batch.column(0))
            for a, b in pieces(off):
                tokens = extract(raw[off[a] : off[b]], off[a : b + 1] - off[a], False)[0]
                total += np.bincount((tokens & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        yield in_slices(total, SLICES)

    found = summed(docs.select("text").mapInArrow(count, "slice int, blob binary"), SLICES)
    return found if len(found) else np.zeros(BUCKETS, np.int64)


def fresh(keys: np.ndarray, seen: set) -> np.ndarray:
    """Which keys come for the first time in this task, as far as its bounded memory goes."""
    if len(seen) > SEEN:
        seen.clear()
    out = np.zeros(len(keys), bool)
    for i, k in enumerate(keys.tolist()):
        if k not in seen:
            seen.add(k)
            out[i] = True
    return out


def items(docs: DataFrame, extract: Extract, num: int, den: int, common: np.ndarray) -> DataFrame:
    """common: each hash bucket's rank (24 bits). (p1, p2, p3, n, k, prefix): a row per item; prefix holds the prefix tokens, rare first, where k is new to the task."""
    rank = docs.sparkSession.sparkContext.broadcast(common)

    @thrifty
    def item(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            raw, off = utf8(batch.column(2))
            p1, p2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, b in pieces(off):
                sets, so, row, no = extract(raw[off[a] : off[b]], off[a : b + 1] - off[a], True)
                n, k = np.diff(so), set_keys(sets, so)
                # a set of n tokens can be close to another one only where n / (n + 1) reaches the threshold
                take = np.flatnonzero(fresh(k, seen) & (n * den >= num * (n + 1)))
                pre = np.where(n > 0, n - -(-n * num // den) + 1, 0)
                at = positions(so[:-1], take, n)
                c = n[take]
                seg = np.repeat(np.arange(len(take)), c)
                inner = np.arange(len(at)) - np.repeat(np.cumsum(c) - c, c)
                order = ordered(seg, rank.value[(sets[at] & np.uint64(BUCKETS - 1)).astype(np.int64)], inner)
                po = np.zeros(len(n) + 1, np.int64)
                use = np.zeros(len(n), np.int64)
                use[take] = pre[take]
                np.cumsum(use, out=po[1:])
                best = order[positions(np.cumsum(c) - c, np.arange(len(take)), pre[take])] if len(take) else order
                data = sets[at][best].astype("<u8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p1[a:b][row]), pa.array(p2[a:b][row]), pa.array(no), pa.array(n), pa.array(k), pa.array(parities(sets, so)), binary(data, po)],
                    ["p1", "p2", "p3", "n", "k", "sig", "prefix"],
                )

    return docs.select("p1", "p2", "text").mapInArrow(item, "p1 long, p2 long, p3 long, n long, k long, sig long, prefix binary")


def parities(sets: np.ndarray, so: np.ndarray) -> np.ndarray:
    """Of each set, for 64 hash classes, whether an odd number of tokens is in the class. Two sets differ in at
    least as many tokens as these bits differ, which bounds their overlap from above."""
    out = np.zeros(len(so) - 1, np.uint64)
    some = np.flatnonzero(np.diff(so) > 0)
    if len(some):
        out[some] = np.bitwise_xor.reduceat(np.uint64(1) << (mix(sets) >> np.uint64(58)), so[some])
    return out.view(np.int64)


def ordered(seg: np.ndarray, rank: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """The order by segment, then rank, then position."""
    if len(seg) and (seg[-1] >= 1 << 16 or inner.max() >= 1 << 24):
        return np.lexsort((inner, rank, seg))
    return np.argsort((seg.astype(np.uint64) << np.uint64(48)) | (rank.astype(np.uint64) << np.uint64(24)) | inner.astype(np.uint64))


def binary(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """A binary array of runs of 8-byte numbers."""
    o = off * data.itemsize
    kind, width = (pa.binary(), np.int32) if o[-1] < 2**31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(o.astype(width)), pa.py_buffer(np.ascontiguousarray(data))])


def prefix_counts(found: DataFrame) -> np.ndarray:
    """How many prefix tokens each hash bucket has."""

    @thrifty
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            raw, off = utf8(batch.column(0))
            for a, b in pieces(off, 1 << 22):
                tokens = np.frombuffer(raw[off[a] : off[b]].tobytes(), "<u8")
                total += np.bincount((tokens & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        yield in_slices(total, SLICES)

    total = summed(found.where("octet_length(prefix) > 0").select("prefix").mapInArrow(count, "slice int, blob binary"), SLICES)
    return total if len(total) else np.zeros(BUCKETS, np.int64)


def postings(found: DataFrame, signed: bool) -> DataFrame:
    """(token, part, prev, k, meta) of each prefix token: prev is the one before it (0 for the first); part numbers the
    runs of a token that is split, from 1 on; meta holds n, the position, and the side (0 or 1) that a row has in a run
    of two blocks, or 2 in any other run.

    signed: each also carries its set's parities; they tell small sets apart and are of no use for large ones.
    """
    own = ["k", "n", "sig"] if signed else ["k", "n"]
    load = prefix_counts(found)
    limit = max(RUN, 8 * int(load.mean()))
    parts = found.sparkSession.sparkContext.broadcast(np.minimum(-(-load // limit), 1 << 15).astype(np.int16))

    @thrifty
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column(len(own)))
            for a, b in pieces(off, 1 << 20):
                tokens = np.frombuffer(raw[off[a] : off[b]].tobytes(), "<i8")
                c = np.diff(off[a : b + 1]) // 8
                k, n, *sig = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False)[a:b], c) for i in range(len(own)))
                pos = np.arange(len(tokens)) - np.repeat(np.cumsum(c) - c, c)
                prev = np.concatenate([[0], tokens[:-1]]) if len(tokens) else tokens
                prev = np.where(pos == 0, 0, prev)
                meta = ((n << POS) | pos) << 2 | 2
                part = np.zeros(len(tokens), np.int32)
                many = parts.value[(tokens.view(np.uint64) & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.int64)
                if (many > 1).any():  # a row of block b goes to the runs of all pairs of blocks that hold b
                    at = np.repeat(np.arange(len(tokens)), np.maximum(many, 1))
                    other = np.arange(len(at)) - np.repeat(np.cumsum(np.maximum(many, 1)) - np.maximum(many, 1), np.maximum(many, 1))
                    tokens, prev, k, meta, many = tokens[at], prev[at], k[at], meta[at], many[at]
                    sig = [x[at] for x in sig]
                    block = (mix(k.view(np.uint64)) % np.maximum(many, 1).astype(np.uint64)).astype(np.int64)
                    low, high = np.minimum(block, other), np.maximum(block, other)
                    meta = meta - 2 + np.where(low == high, 2, block == high)
                    part = np.where(many > 1, high * (high + 1) // 2 + low + 1, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tokens, part, prev, k, meta, *sig)], ["token", "part", "prev", "k", "meta", *own[2:]])

    return found.where("octet_length(prefix) > 0").select(*own, "prefix").mapInArrow(spread, "token long, part int, prev long, k long, meta long" + ", sig long" * signed)


def candidates(post: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (a, b, t, g). With g null: keys a < b share the prefix token t and pass the filters. Else: key a is in the
    dense run g of token t, on side b."""

    def pair(token, part, prev, k, meta, sig=None) -> tuple[np.ndarray, ...]:
        """Rows are sorted by run (token and part) and n; i meets i + 1, i + 2, ... as long as the run and the length filter allow."""
        side, pos, n = meta & 3, (meta >> 2) & ((1 << POS) - 1), meta >> (POS + 2)
        group = np.cumsum(np.concatenate([[True], (token[1:] != token[:-1]) | (part[1:] != part[:-1])])) - 1
        room = DENSE * np.bincount(group)
        pairs = np.zeros(len(room), np.int64)
        index = pos < n - -(-2 * num * n // (num + den)) + 1
        i, d = np.flatnonzero(index[:-1]), 1
        outs = []
        while len(i):
            i = i[i + d < len(group)]
            j = i + d
            go = (group[i] == group[j]) & (n[i] * den >= num * n[j]) & (pairs[group[i]] <= room[group[i]])
            i, j = i[go], j[go]
            need = -(-num * (n[i] + n[j]) // (num + den))
            ok = (1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1) >= need) & ((prev[i] != prev[j]) | (pos[i] == 0) | (pos[j] == 0)) & (k[i] != k[j]) & ((side[i] == 2) | (side[i] != side[j]))
            if sig is not None:
                ok &= np.bitwise_count(sig[i] ^ sig[j]) <= n[i] + n[j] - 2 * need
            outs.append((i[ok], j[ok]))
            pairs += np.bincount(group[i[ok]], minlength=len(room))
            d += 1
        dense = pairs > room
        i, j = (np.concatenate(x) for x in zip(*outs)) if outs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        sparse = ~dense[group[i]]
        i, j = i[sparse], j[sparse]
        at = np.flatnonzero(dense[group])
        a = np.concatenate([np.minimum(k[i], k[j]), k[at]])
        b = np.concatenate([np.maximum(k[i], k[j]), side[at]])
        return a, b, np.concatenate([token[i], token[at]]), np.concatenate([part[i], part[at]]), np.arange(len(a)) < len(i)

    @thrifty
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(final):
            x = tuple(np.concatenate(y) for y in zip(*held))
            same = (x[0][1:] == x[0][:-1]) & (x[1][1:] == x[1][:-1])
            keep = np.ones(len(x[0]), bool)  # equal sets from several tasks
            keep[1:] = ~same | (x[3][1:] != x[3][:-1]) | (x[4][1:] != x[4][:-1])
            x = tuple(y[keep] for y in x)
            same = (x[0][1:] == x[0][:-1]) & (x[1][1:] == x[1][:-1])
            cut = len(x[0]) if final else int(np.flatnonzero(np.concatenate([[True], ~same]))[-1])
            held[:] = [tuple(y[cut:] for y in x)]
            near = np.zeros(cut, bool)
            if cut:
                near[1:] |= same[: cut - 1]
                near[:-1] |= same[: cut - 1]
            at = np.flatnonzero(near)
            if not len(at):
                return None
            a, b, token, part, sparse = pair(*(y[at] for y in x[:5]), *(y[at].view(np.uint64) for y in x[5:]))
            run = mix(token.view(np.uint64) ^ mix(part.astype(np.uint64))).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(token), pa.array(run, mask=sparse)], ["a", "b", "t", "g"]) if len(a) else None

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)))
                if any(held[0][c][0] != held[-1][c][-1] for c in (0, 1)) and (found := done(False)) is not None:
                    yield found
        if held and len(held[0][0]) and (found := done(True)) is not None:
            yield found

    return post.repartition("token", "part").sortWithinPartitions("token", "part", "meta", "k").mapInArrow(runs, "a long, b long, t long, g long")


def unique_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.stack([a[keep], b[keep]], 1)


def bloom(keys: DataFrame, count: int) -> np.ndarray:
    """Bits of all keys (column k), at most 2**27 of them; what it lets through needlessly is dropped by a join."""
    bits = 1 << min(27, max(18, int(16 * max(count, 1)).bit_length()))

    @thrifty
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for h in spots(batch.column(0).to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(total, h >> 3, (1 << (h & 7)).astype(np.uint8))
        yield in_slices(total.view(np.int64), SLICES)

    found = summed(keys.select("k").mapInArrow(fill, "slice int, blob binary"), SLICES, "or")
    return found.view(np.uint8) if len(found) else np.zeros(bits // 8, np.uint8)


def spots(k: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(k.view(np.uint64))
    return [(h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)]


def sets_of(docs: DataFrame, extract: Extract, wanted: np.ndarray) -> DataFrame:
    """(k, tokens) of all sets that the Bloom filter lets through, once per task."""
    bits = docs.sparkSession.sparkContext.broadcast(wanted)

    @thrifty
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            raw, off = utf8(batch.column(0))
            for a, b in pieces(off):
                sets, so, _, _ = extract(raw[off[a] : off[b]], off[a : b + 1] - off[a], True)
                k, n = set_keys(sets, so), np.diff(so)
                ok = n > 0
                for h in spots(k, len(bits.value) * 8):
                    ok &= (bits.value[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1
                at = np.flatnonzero(ok)
                at = at[fresh(k[at], seen)]
                if not len(at):
                    continue
                o = np.zeros(len(at) + 1, np.int64)
                np.cumsum(n[at], out=o[1:])
                yield pa.RecordBatch.from_arrays([pa.array(k[at]), binary(sets[positions(so[:-1], at, n)], o)], ["k", "tokens"])

    return docs.select("text").mapInArrow(take, "k long, tokens binary")


def bounded(num: int, den: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of one cell: the pairs that may still reach the threshold, from both sets' whole prefixes.

    Of two sets let x be the one whose prefix ends first in the common order. A common token is in both prefixes or
    comes after x's, so the overlap is at most the prefixes' overlap plus what x has after its prefix. Of a pair that
    came from several tokens the one from the first common token stays.
    """

    def cell(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        keys, first = np.unique(sets.column("k").to_numpy(), return_index=True)
        raw, off = utf8(sets.column("tokens").combine_chunks().take(pa.array(first)))
        raw_tokens = np.frombuffer(raw.tobytes(), "<u8")
        tokens = np.unique(raw_tokens, return_inverse=True)[1]
        off = off // 8
        c = np.diff(off)
        n = sets.column("n").to_numpy()[first]
        ia, ib = (np.searchsorted(keys, pairs.column(x).to_numpy()) for x in ("a", "b"))
        by = np.argsort(ia, kind="stable")
        ia, ib, t = ia[by], ib[by], pairs.column("t").to_numpy().view(np.uint64)[by]
        both, first = overlaps(ia, ib, tokens, off, c)
        ok = (both + np.maximum(n[ia] - c[ia], n[ib] - c[ib])) * (num + den) >= num * (n[ia] + n[ib])
        ok &= raw_tokens[np.minimum(off[ib] + first, len(raw_tokens) - 1)] == t
        return pa.table({"a": keys[ia[ok]], "b": keys[ib[ok]], "t": t[ok].view(np.int64)})

    return cell


def overlaps(ia: np.ndarray, ib: np.ndarray, tokens: np.ndarray, off: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs in order of ia: how many tokens (small numbers) both have, and the place of the first of them in ib's."""
    mark = np.zeros(len(tokens) + 1, np.int32)
    cuts = np.flatnonzero(np.concatenate([[True], ia[1:] != ia[:-1]])) if len(ia) else np.zeros(0, np.int64)
    both, first = np.zeros(len(ia), np.int64), np.zeros(len(ia), np.int64)
    for s, e in zip(cuts, [*cuts[1:], len(ia)]):
        own = tokens[off[ia[s]] : off[ia[s] + 1]]
        mark[own] = 1
        for t in range(s, e, 2000):
            ys = ib[t : min(e, t + 2000)]
            size = n[ys]
            begin = np.cumsum(size) - size
            hit = mark[tokens[positions(off[:-1], ys, n)]]
            both[t : t + len(ys)] = np.add.reduceat(hit, begin)
            at = np.flatnonzero(hit)
            place = np.searchsorted(at, begin)
            first[t : t + len(ys)] = np.where(place < len(at), at[np.minimum(place, len(at) - 1)] - begin, 0) if len(at) else 0
        mark[own] = 0
    return both, first


def verified(num: int, den: int, rank) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of one cell: pairs (a, b, t) and members of dense runs (a, b, t, g, i, j, o) to a row per linked node, with sets
    (k, w, p1, p2, p3, tokens). rank: the broadcast ranks of hash buckets."""

    def cell(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        keys, at = np.unique(sets.column("k").to_numpy(), return_index=True)
        raw, off = utf8(sets.column("tokens").combine_chunks().take(pa.array(at)))
        w, p1, p2, p3 = (sets.column(c).to_numpy()[at] for c in ("w", "p1", "p2", "p3"))
        off = off // 8
        n = np.diff(off)
        node = np.repeat(np.arange(len(keys)), n)
        tokens = np.frombuffer(raw.tobytes(), "<u8")
        sig = parities(tokens, off).view(np.uint64)
        ranges = np.bincount(node * 16 + (tokens >> np.uint64(60)).astype(np.int64), minlength=16 * len(keys)).reshape(-1, 16)
        # tokens by their number in the global order
        known, number = np.unique(tokens, return_inverse=True)
        order = np.lexsort((known, rank.value[(known & np.uint64(BUCKETS - 1)).astype(np.int64)]))
        place = np.empty(len(known), np.int64)
        place[order] = np.arange(len(known))
        number = place[number]
        number = number[np.lexsort((number, node))]
        number_of = lambda t: place[np.minimum(np.searchsorted(known, t.view(np.uint64)), len(known) - 1)]
        total, best = np.zeros(len(keys), np.int64), np.full(len(keys), len(keys))
        by = np.lexsort((p3, p2, p1))
        spot = np.empty(len(keys), np.int64)  # order of positions
        spot[by] = np.arange(len(keys))
        stars: list[tuple] = []

        def link(x: np.ndarray, y: np.ndarray) -> None:
            total[:] += np.bincount(x, weights=w[y], minlength=len(keys)).astype(np.int64) + np.bincount(y, weights=w[x], minlength=len(keys)).astype(np.int64)
            np.minimum.at(best, x, spot[y])
            np.minimum.at(best, y, spot[x])
            r = local_roots(x, y, len(keys))
            to = np.flatnonzero(r != np.arange(len(keys)))
            stars.append((to, r[to]))

        g = pairs.column("g")
        sparse = pairs.filter(g.is_null())
        if sparse.num_rows:
            ia, ib = (np.searchsorted(keys, sparse.column(c).to_numpy()) for c in ("a", "b"))
            t = sparse.column("t").to_numpy()
            ok = np.zeros(len(ia), bool)
            for s in range(0, len(ia), 100_000):
                x, y = ia[s : s + 100_000], ib[s : s + 100_000]
                ok[s : s + 100_000] = np.minimum(ranges[x], ranges[y]).sum(1) * (num + den) >= num * (n[x] + n[y])
            ia, ib, t = ia[ok], ib[ok], t[ok]
            sort = np.argsort(ia, kind="stable")
            ia, ib, t = ia[sort], ib[sort], t[sort]
            both, first = overlaps(ia, ib, number, off, n)
            ok = (both * (num + den) >= num * (n[ia] + n[ib])) & (number[off[ib] + first] == number_of(t)) if len(ia) else np.zeros(0, bool)
            link(ia[ok], ib[ok])
        dense = pairs.filter(g.is_valid())
        if dense.num_rows:
            k, side, t, g, i, j, o = (dense.column(c).to_numpy() for c in ("a", "b", "t", "g", "i", "j", "o"))
            x = np.searchsorted(keys, k)
            sort = np.lexsort((x, n[x], g))
            x, side, t, g, i, j, o = (c[sort] for c in (x, side, t, g, i, j, o))
            cuts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            num_t = number_of(t)
            for s, e in zip(cuts, [*cuts[1:], len(g)]):
                for p, q in dense_links(x[s:e], side[s:e], o[s:e] if i[s] != j[s] else None, num_t[s], number, off, n, sig, num, den):
                    link(p, q)
        a, b = (np.concatenate(c) for c in zip(*stars)) if stars else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        at = np.flatnonzero(total)
        q = by[best[at]]
        return pa.table({"k": keys[at], "w": total[at], "p1": p1[q], "p2": p2[q], "p3": p3[q], "root": keys[local_roots(a, b, len(keys))[at]]})

    return cell


def dense_links(x: np.ndarray, side: np.ndarray, block: np.ndarray | None, t: int, tokens: np.ndarray, off: np.ndarray, n: np.ndarray, sig: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of a dense run's members x (in order of size) whose first common token is t.

    A member meets those after it that the length filter allows, on the other side, in the other block. First the tokens
    before t are compared, of which no two may agree; what is left is verified.
    """
    size = n[x]
    at = positions(off[:-1], x, n)
    own = tokens[at]
    begin = np.zeros(len(x) + 1, np.int64)
    np.cumsum(size, out=begin[1:])
    before = own < t
    heads = own[before]
    hoff = np.zeros(len(x) + 1, np.int64)
    np.cumsum(np.add.reduceat(before, begin[:-1], dtype=np.int64), out=hoff[1:])
    mark = np.zeros(len(tokens) + 1, np.int32)
    high = np.searchsorted(size, size * den // num, side="right")
    outs, held = [], 0
    for r in range(len(x) - 1):
        s, e = r + 1, int(high[r])
        if s >= e:
            continue
        need = -(-num * (size[r] + size[s:e]) // (num + den))
        ok = np.bitwise_count(sig[x[r]] ^ sig[x[s:e]]) <= size[r] + size[s:e] - 2 * need
        if side[r] != 2:
            ok &= side[s:e] != side[r]
        if block is not None:
            ok &= block[s:e] != block[r]
        if hoff[r] < hoff[r + 1] and hoff[s] < hoff[e]:
            mark[heads[hoff[r] : hoff[r + 1]]] = 1
            found = np.concatenate([[0], np.cumsum(mark[heads[hoff[s] : hoff[e]]])])
            mark[heads[hoff[r] : hoff[r + 1]]] = 0
            ok &= found[hoff[s + 1 : e + 1] - hoff[s]] == found[hoff[s:e] - hoff[s]]
        ys = np.flatnonzero(ok) + s
        if not len(ys):
            continue
        mine = own[begin[r] : begin[r + 1]]
        mark[mine] = 1
        if len(ys) * 4 > e - s:
            both = np.add.reduceat(mark[own[begin[s] : begin[e]]], begin[s:e] - begin[s])[ys - s]
        else:
            both = np.add.reduceat(mark[own[positions(begin[:-1], ys, size)]], np.cumsum(size[ys]) - size[ys])
        mark[mine] = 0
        ys = ys[both >= need[ys - s]]
        outs.append((np.full(len(ys), x[r]), x[ys]))
        held += len(ys)
        if held > 500_000:
            yield tuple(np.concatenate(c) for c in zip(*outs))
            outs, held = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*outs))


def dense_cells(dense: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of dense runs with their cells, as in cells()."""
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
    none = F.lit(0).cast("long")
    # runs that share members share cells, so that a set travels there once; two rounds of smallest labels
    sized = stored(dense.distinct().join(labels.select(F.col("k").alias("a"), "n"), "a"), "dense")
    runs = stored(sized.groupBy("g").agg(F.count("*").alias("rows")).withColumn("label", F.col("g")), "runs")
    for _ in range(2):
        low = with_keys(sized, runs, "rows", key="g").groupBy("a").agg(F.min("label").alias("low"))
        runs = stored(sized.join(low, "a").groupBy("g").agg(F.count("*").alias("rows"), F.min("low").alias("label")), "runs")
    placed = with_keys(sized, runs, "rows", key="g")
    family = placed.select("label", "a", "n").distinct().groupBy("label").agg(F.sum("n").alias("tokens"), F.count("*").alias("rows"))
    family = stored(family.select(F.col("label").alias("f"), F.ceil(F.col("tokens") / CELL).alias("blocks"), "tokens", F.col("rows").alias("members")), "families")
    total = family.agg(F.sum("tokens")).first()[0] or 0
    blocked = with_keys(placed.withColumnRenamed("label", "f"), family, "members", key="f").withColumn("o", block("a"))
    span = F.transform(F.sequence(none, F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("o")).alias("i"), F.greatest(x, F.col("o")).alias("j")))
    alone = F.col("blocks") == 1
    return blocked.withColumn("x", F.explode(span)).select(
        "a",
        "b",
        "t",
        "g",
        F.when(alone, F.pmod(F.xxhash64("f"), F.lit(max(1, total // CELL)))).otherwise(F.col("f")).alias("c1"),
        F.when(alone, F.lit(-2)).otherwise(F.col("x.i") * (1 << 31) + F.col("x.j")).cast("long").alias("c2"),
        "x.i",
        "x.j",
        "o",
    )


def cells(pairs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates with cells (c1, c2), blocks i and j of the cell and o of the row; the members (k, d1, d2, w, p1, p2,
    p3) that each cell needs; all nodes with candidates.

    nodes: k, n (size), w, p1, p2, p3.
    """
    sparse, dense = pairs.where("g is null"), pairs.where("g is not null")
    ends = sparse.select(F.col("a").alias("k"), F.col("b").alias("o")).unionByName(sparse.select(F.col("b").alias("k"), F.col("a").alias("o"))).unionByName(dense.select(F.col("a").alias("k"), F.lit(None).cast("long").alias("o")))
    labels = stored(ends.groupBy("k").agg(F.least(F.min("o"), F.col("k")).alias("label"), F.max(F.col("o").isNotNull()).alias("paired")).join(nodes, "k"), "labels")
    size = labels.where("paired").agg(F.sum("n").alias("tokens")).first()
    groups = labels.where("paired").groupBy("label").agg(F.sum("n").alias("tokens")).where(F.col("tokens") > CELL).select("label", F.ceil(F.col("tokens") / CELL).alias("blocks"))
    many = max(1, (size["tokens"] or 0) // CELL)
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
    none = F.lit(0).cast("long")
    one = (
        sparse.join(labels.select(F.col("k").alias("b"), "label"), "b")
        .join(groups, "label", "left")
        .select(
            "a",
            "b",
            "t",
            "g",
            F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("label"), F.lit(many))).otherwise(F.col("label")).alias("c1"),
            F.when(F.col("blocks").isNull(), F.lit(-1)).otherwise(block("a") * (1 << 31) + block("b")).cast("long").alias("c2"),
            none.alias("i"),
            none.alias("j"),
            none.alias("o"),
        )
    )
    if not dense.isEmpty():
        one = one.unionByName(dense_cells(dense, labels))
    celled = stored(one, "cells")
    ends = F.when(F.col("g").isNull(), F.array("a", "b")).otherwise(F.array("a"))
    members = celled.select(F.explode(ends).alias("k"), "c1", "c2").distinct()
    members = members.join(labels.select("k", "w", "p1", "p2", "p3"), "k")
    members = members.withColumnsRenamed({"c1": "d1", "c2": "d2"})
    return celled, members, labels


def linked(docs: DataFrame, extract: Extract, num: int, den: int, signed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of sets whose Jaccard similarity is at least num / den.

    docs has p1 long, p2 long and text, none of them null. Gives (items, nodes, links): items (p1, p2, p3, n, k),
    a row per set; nodes (k, n, w, p1, p2, p3), a row per different set with its number of items and smallest
    position; links (k, w, p1, p2, p3, root), rows of nodes with a link: w items linked through other sets, the
    smallest position among them, and an edge k-root that keeps components together.
    """
    small_batches(docs.sparkSession, 2000)
    common = np.minimum(counts(docs, extract), (1 << 24) - 1).astype(np.uint32)
    found = stored(items(docs, extract, num, den, common), "items")
    nodes = found.where("n > 0").groupBy("k").agg(F.first("n").alias("n"), F.count("*").alias("w"), F.min(F.struct("p1", "p2", "p3")).alias("p")).select("k", "n", "w", "p.*")
    pairs = stored(candidates(postings(found, signed), num, den), "pairs")
    if not signed:  # large sets: only pairs whose prefixes leave a chance make whole sets travel
        celled, members, _ = cells(pairs.where("g is null"), nodes)
        heads = found.where("octet_length(prefix) > 0").select("k", "n", F.col("prefix").alias("tokens"))
        near = celled.groupBy("c1", "c2").cogroup(members.join(heads, "k").groupBy("d1", "d2")).applyInArrow(bounded(num, den), "a long, b long, t long")
        pairs = stored(near.withColumn("g", F.lit(None).cast("long")).unionByName(pairs.where("g is not null")), "near")
    celled, members, labels = cells(pairs, nodes)
    rank = docs.sparkSession.sparkContext.broadcast(common)
    shipped = members.join(sets_of(docs, extract, bloom(labels, labels.count())), "k")
    out = celled.groupBy("c1", "c2").cogroup(shipped.groupBy("d1", "d2")).applyInArrow(verified(num, den, rank), "k long, w long, p1 long, p2 long, p3 long, root long")
    links = stored(out, "links")
    return found.drop("prefix", "sig"), nodes, links


def with_keys(rows: DataFrame, known: DataFrame, weight: str, how: str = "inner", key: str = "k") -> DataFrame:
    """rows joined with known (a stored row per key). The keys with most rows are joined by broadcast, so that no task
    gets more than a small part of all rows for one key."""
    hot = F.broadcast(known.orderBy(F.desc(weight), key).limit(HOT))
    rest = rows.join(hot.select(key), key, "left_anti").join(known, key, how)
    return rows.join(hot, key).select(*rest.columns).unionByName(rest)
