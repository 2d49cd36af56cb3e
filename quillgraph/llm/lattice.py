"""Near-duplicate embeddings by lattice hashing: random projections, decoded to points of the lattice E8.

A table projects unit vectors to blocks of eight orthonormal directions and decodes each block to its nearest E8
point; all blocks' points form the cell. A vector's home is its own cell; it also probes the cells next to it, in which
some blocks take their second-nearest point, the least far ones first. Vectors meet in a cell that is the home of at
least one of them, and there the cosine is computed in double precision. A pair is counted in one cell only, the first
of the first table in which it meets. Cells of more than BLOCK entries are compared by pairs of blocks; what leaves a
task is a row per linked vector, never a pair.

All parameters are fixed, whatever the table's size: 8 tables, 3 blocks, 4 cells each, scale 1.3. Of pairs at a cosine
of just 0.95, 0.96 are found (0.99 and more from 0.97 on); two vectors that have nothing to do with each other meet in a
table once in about a million pairs. Copies that differ are all compared with one another, as their exact numbers of
links are asked for: that work is quadratic in a group of near copies, spread over tasks by blocks.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite numbers have no links and stay alone;
vectors of different lengths have no links with each other; equal vectors are one node, counted by their number; a null
id sorts last and is null in the result; rows that repeat an id count each; other columns are ignored; an empty table
gives no rows. Vectors may be of any length; a task holds at most two blocks of them.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.bytewords import mix
from quillgraph.llm.common import stored, thrifty
from quillgraph.llm.components import components, local_roots

#: entries of a cell that are compared at once with another such block
BLOCK = 4096
#: cells up to this size are compared together, by lists of pairs of rows
SMALL = 48
#: cells beyond BLOCK that are known to all tasks: any other one has less than one in HOT of all entries
HOT = 4096
TABLES, BLOCKS, CELLS, SCALE = 8, 3, 4, 1.3


def nearest_e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the nearest and twice the second-nearest of the candidates in E8 (D8 and its shift by one half)."""

    def d8(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = np.floor(y + 0.5)
        gap = y - r
        order = np.argsort(-np.abs(gap), axis=1)
        rows = np.arange(len(y))

        def flip(z: np.ndarray, j: np.ndarray) -> np.ndarray:
            z = z.copy()
            z[rows, j] += np.where(gap[rows, j] >= 0, 1, -1)
            return z

        odd = r.sum(1) % 2 != 0
        one, two, both = flip(r, order[:, 0]), flip(r, order[:, 1]), flip(flip(r, order[:, 0]), order[:, 1])
        return np.where(odd[:, None], one, r), np.where(odd[:, None], two, both)

    found = [2 * z + s for s in (0, 1) for z in d8(x - s / 2)]
    far = np.stack([((2 * x - z) ** 2).sum(1) for z in found])
    by = np.argsort(far, axis=0, kind="stable")
    stack = np.stack(found)
    rows = np.arange(len(x))
    return stack[by[0], rows].astype(np.int64), stack[by[1], rows].astype(np.int64)


@functools.lru_cache(maxsize=16)
def directions(d: int, blocks: int, tables: int, scale: float, seed: int) -> np.ndarray:
    """(tables, d, 8 * blocks): orthonormal directions of each table, scaled to blocks of about length scale."""
    r = np.random.default_rng([seed, d])
    size = max(d, 8 * blocks)
    return np.stack([np.linalg.qr(r.standard_normal((size, 8 * blocks)))[0][:d] for _ in range(tables)]) * math.sqrt(size / 8) * scale


def signatures(v: np.ndarray, blocks: int = BLOCKS, tables: int = TABLES, cells: int = CELLS, scale: float = SCALE, seed: int = 7) -> np.ndarray:
    """Of unit vectors: cells (rows, tables, cells), the first of each table is home, the others are nearest to it."""
    n, d = v.shape
    combos = 1 << blocks
    out = np.zeros((n, tables, min(cells, combos)), np.uint64)
    for t, q in enumerate(directions(d, blocks, tables, scale, seed)):
        p = v @ q
        keys, far = [], np.zeros((n, combos))
        for b in range(blocks):
            coefficients = mix(np.arange(8, dtype=np.uint64) + np.uint64(8 * b + 1)) | np.uint64(1)
            x = p[:, 8 * b : 8 * b + 8]
            pair = nearest_e8(x)
            keys.append([(z.view(np.uint64) * coefficients).sum(1, dtype=np.uint64) for z in pair])
            gap = ((2 * x - pair[1]) ** 2).sum(1) - ((2 * x - pair[0]) ** 2).sum(1)
            far += gap[:, None] * (np.arange(combos) >> b & 1)
        every = np.zeros((n, combos), np.uint64)
        for m in range(combos):
            total = np.full(n, t + 1 + (d << 8), np.uint64)
            for b in range(blocks):
                total = mix(total ^ keys[b][m >> b & 1])
            every[:, m] = total
        order = np.argsort(far, axis=1, kind="stable")
        out[:, t] = np.take_along_axis(every, order[:, : out.shape[2]], 1)
    return out


def unit(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length, and their unit vectors in double precision."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        v = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        v = v / np.abs(v).max(axis=1)[:, None]
        yield at, v / np.sqrt((v * v).sum(1))[:, None]


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(p1 struct<none, id>, v, k): v is null where a vector can't be compared; k is its hash."""
    kind = "float" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    vector = F.transform(F.col(vector_col), lambda x: x.cast(kind))
    zero = F.lit(0.0).cast(kind)
    valid = F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))
    key = F.col(id_col).cast("long")
    rows = df.select(F.struct(key.isNull().alias("none"), F.coalesce(key, F.lit(0)).alias("id")).alias("p1"), F.when(valid, F.transform(vector, lambda x: F.when(x == 0, zero).otherwise(x))).alias("v"))
    return rows.withColumn("k", F.when(F.col("v").isNotNull(), F.xxhash64("v")))


def entries(nodes: DataFrame) -> DataFrame:
    """(bucket, k, home): the cells of all vectors (k, v)."""

    @thrifty
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                k = part.column(0).to_numpy(zero_copy_only=False)
                for at, v in unit(part.column(1)):
                    keys = signatures(v)
                    home = np.zeros(keys.shape, bool)
                    home[:, :, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(k[at], keys[0].size)), pa.array(home.reshape(-1))], ["bucket", "k", "home"])

    return nodes.select("k", "v").mapInArrow(place, "bucket long, k long, home boolean")


def cell_sizes(found: DataFrame) -> DataFrame:
    """(bucket, n) of the cells in which vectors meet."""
    return found.groupBy("bucket").agg(F.count("*").alias("n"), F.max("home").alias("home")).where("n > 1 and home").select("bucket", "n")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """A row per vector: vec_id, n_links (others with a found cosine of at least the bound), component_id, kept."""
    rows = vectors(df, id_col, vector_col)
    nodes = stored(rows.where("k is not null").groupBy("k").agg(F.count("*").alias("w"), F.min("p1").alias("p1"), F.first("v").alias("v")), "vectors")
    found = stored(entries(nodes), "entries")
    sizes = stored(cell_sizes(found).withColumn("blocks", F.ceil(F.col("n") / BLOCK)), "sizes")
    # the largest cells needn't be joined by shuffling; each other one is a small part of the entries
    hot = F.broadcast(sizes.where("blocks > 1").orderBy(F.desc("n"), "bucket").limit(HOT).select("bucket", "blocks"))
    calm = found.join(hot, "bucket", "left_anti").join(sizes.select("bucket", "blocks"), "bucket")
    member = found.join(hot, "bucket").unionByName(calm).withColumn("b", F.pmod(F.xxhash64("k"), F.col("blocks")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    none = F.lit(0).cast("long")
    pairs = F.when(F.col("blocks") == 1, F.array(F.struct(none.alias("i"), none.alias("j")))).otherwise(
        F.transform(F.sequence(none, F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("b")).alias("i"), F.greatest(o, F.col("b")).alias("j")))
    )
    large = F.col("blocks") > 1
    cell = F.when(large, F.col("bucket")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(max(1, total // BLOCK))))
    placed = member.select("bucket", "k", "home", "b", large.alias("large"), cell.alias("c"), F.explode(pairs).alias("p")).select("bucket", "k", "home", "b", "large", "c", "p.i", "p.j")
    shipped = placed.join(nodes.select("k", "w", "v"), "k")
    links = stored(shipped.groupBy("c", "large", "i", "j").applyInArrow(verified(cosine), "k long, w long, root long"), "links")
    roots = components(links.select(F.col("k").alias("u"), F.col("root").alias("v")))
    lowest = roots.join(nodes.select(F.col("k").alias("node"), "p1"), "node").groupBy("root").agg(F.min("p1").alias("component"))
    known = (
        nodes.where("w > 1").select("k", "w", "p1").join(links.groupBy("k").agg(F.sum("w").alias("far")), "k", "full").join(roots.join(lowest, "root").select(F.col("node").alias("k"), "component"), "k", "left")
        .select("k", (F.coalesce("w", F.lit(1)) - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component", "p1").alias("component"))
    )
    component = F.coalesce("component", "p1")
    shown = lambda c: F.when(~c["none"], c["id"])
    return rows.select("p1", "k").join(known, "k", "left").select(shown(F.col("p1")).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), shown(component).alias("component_id"), (F.col("p1") == component).alias("kept"))


def meeting(x: np.ndarray, y: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Of pairs of rows of keys (rows, tables, cells): the cell in which each is counted."""
    out = np.zeros(len(x), np.uint64)
    left = np.arange(len(x))
    for t in range(keys.shape[1]):
        a, b = keys[x[left], t], keys[y[left], t]
        first, second = (a[:, :1] == b).any(1), (b[:, :1] == a).any(1)
        hit = first | second
        out[left[hit]] = np.where(first, a[:, 0], b[:, 0])[hit]
        left = left[~hit]
        if not len(left):
            break
    return out


def verified(cosine: float):
    """Of a group of cells (bucket, k, home, b, w, v, i, j): a row per vector with links that are counted here."""

    def cell(rows: pa.Table) -> pa.Table:
        bucket, k, home, b, w, i, j = (rows.column(c).to_numpy() for c in ("bucket", "k", "home", "b", "w", "i", "j"))
        order = np.lexsort((k, b, bucket))
        bucket, k, home, b, w = (x[order] for x in (bucket, k, home, b, w))
        bucket = bucket.view(np.uint64)
        ids, first, node = np.unique(k, return_index=True, return_inverse=True)
        total, stars = np.zeros(len(ids), np.int64), []
        weight = w[first]
        column = rows.column("v").combine_chunks().take(pa.array(order[first]))
        v, place = {}, np.zeros(len(ids), np.int64)
        for at, x in unit(column):
            v[x.shape[1]] = x
            place[at] = np.arange(len(at))
        d = column.value_lengths().to_numpy(zero_copy_only=False)
        keys = np.zeros((len(ids), TABLES, CELLS), np.uint64)
        known = np.zeros(len(ids), bool)

        def sign(nodes: np.ndarray) -> None:
            new = np.unique(nodes)
            new = new[~known[new]]
            known[new] = True
            for size in np.unique(d[new]):
                at = new[d[new] == size]
                keys[at] = signatures(v[size][place[at]])

        def count(p: np.ndarray, q: np.ndarray) -> None:
            """Rows p and q are linked in a cell; they count if the pair belongs to this cell."""
            for a in range(0, len(p), 200_000):
                x, y, at = node[p[a : a + 200_000]], node[q[a : a + 200_000]], bucket[p[a : a + 200_000]]
                sign(np.concatenate([x, y]))
                x, y = np.minimum(x, y), np.maximum(x, y)
                own = (meeting(x, y, keys) == at) & (x != y)
                x, y = x[own], y[own]
                total[:] += np.bincount(x, weights=weight[y], minlength=len(ids)).astype(np.int64) + np.bincount(y, weights=weight[x], minlength=len(ids)).astype(np.int64)
                r = local_roots(x, y, len(ids))
                to = np.unique(np.concatenate([x, y]))
                to = to[r[to] != to]
                stars.append((to, r[to]))

        across = len(i) > 0 and i[0] != j[0]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(k) else np.zeros(0, np.int64)
        run = np.diff(np.append(cuts, len(k)))
        small = np.repeat(run <= SMALL, run) & (not across)
        # small cells, all at once: each row with the next one of its cell, the one after that, ...
        left, step = np.flatnonzero(small), 1
        while len(left):
            left = left[left + step < len(k)]
            left = left[bucket[left] == bucket[left + step]]
            p = left[home[left] | home[left + step]]
            for a in range(0, len(p), 100_000):
                x, y = p[a : a + 100_000], p[a : a + 100_000] + step
                for size in np.unique(d[node[x]]):
                    own = (d[node[x]] == size) & (d[node[y]] == size)
                    near = np.einsum("ij,ij->i", v[size][place[node[x[own]]]], v[size][place[node[y[own]]]]) >= cosine
                    count(x[own][near], y[own][near])
            step += 1
        for s, e in zip(cuts, cuts + run):
            if small[s]:
                continue
            mid = s + int(np.searchsorted(b[s:e], j[0])) if across else e
            at = np.arange(s, e)
            size = d[node[s]]
            if across:
                here, there = at[: mid - s], at[mid - s :]
                chunks = [(here[x : x + 512], there, False) for x in range(0, len(here), 512)]
            else:
                chunks = list(blocks_of(at, node, bucket[s], keys, sign))
            for p, q, same in chunks:
                own, other = v[size][place[node[p]]], v[size][place[node[q]]]
                x, y = np.nonzero((own @ other.T >= cosine) & (home[p][:, None] | home[q][None, :]))
                if same:  # q begins with p
                    x, y = x[x < y], y[x < y]
                count(p[x], q[y])
        p, q = (np.concatenate(z) for z in zip(*stars)) if stars else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        at = np.flatnonzero(total)
        return pa.table({"k": ids[at], "w": total[at], "root": ids[local_roots(p, q, len(ids))[at]]})

    return cell


def blocks_of(at: np.ndarray, node: np.ndarray, bucket: np.uint64, keys: np.ndarray, sign) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows of a large cell, and rows to compare them with, which may begin with the former. Beyond the first table, rows that share their home in the first
    one have met there already, so only rows of different homes are compared, if that saves work."""
    sign(node[at])
    if not (keys[node[at], 0] == bucket).any():
        first = keys[node[at], 0, 0]
        at = at[np.argsort(first, kind="stable")]
        first = keys[node[at], 0, 0]
        cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        if len(cuts) <= len(at) // 8:
            for s, e in zip(cuts, [*cuts[1:], len(at)]):
                for x in range(s, e, 512):
                    if e < len(at):
                        yield at[x : min(x + 512, e)], at[e:], False
            return
    for x in range(0, len(at), 512):
        yield at[x : x + 512], at[x:], True
