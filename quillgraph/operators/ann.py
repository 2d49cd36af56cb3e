"""Approximate nearest neighbours by inverted lists: vectors go to their nearest centroid, queries look into a few lists.

Centroids come from a sample of at most ``sample`` vectors, those with the smallest hashes of their keys; every vector is
put into a list, whatever the table's size. Lists of more than BLOCK vectors are searched in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.lineage import cut
from quillgraph.operators.ranking import Best, blocks
from quillgraph.operators.retrieval import top_per_query

BLOCK = 50_000


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1)
    return x / np.where(n > 0, n, 1)[:, None]


def centroids(chunks: DataFrame, count: int | None = None, sample: int = 20_000, rounds: int = 8, key: str = "point_id", vector: str = "embedding") -> np.ndarray:
    """Unit centroids of spherical k-means over a bounded sample; as many as the root of the sample's size."""
    rows = chunks.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(F.col(vector).cast("array<double>").alias("v")).collect()
    if not rows:
        return np.zeros((0, 0))
    size = max(set(map(len, (r["v"] for r in rows))), key=[len(r["v"]) for r in rows].count)
    v = unit(np.array([r["v"] for r in rows if len(r["v"]) == size]))
    k = min(len(v), count or max(1, math.isqrt(len(v))))
    c = v[:: max(1, len(v) // k)][:k].copy()
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, v)
        filled = np.bincount(own, minlength=len(c)) > 0
        c[filled] = unit(total[filled])
    return c


def lists(chunks: DataFrame, c: np.ndarray, probes: int = 1, key: str = "point_id", vector: str = "embedding") -> DataFrame:
    """(key, list, vector): each vector's nearest lists. Vectors of another length than the centroids' are in none."""
    sent = chunks.sparkSession.sparkContext.broadcast(c)
    kind = ", ".join(f"{n} {chunks.schema[n].dataType.simpleString()}" for n in (key, vector))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            fits = np.array([n == c.shape[1] for n in batch.column(1).value_lengths().to_pylist()], bool)
            part = batch.filter(pa.array(fits))
            if not part.num_rows:
                continue
            s = unit(np.nan_to_num(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(part.num_rows, -1)) @ c.T
            best = np.argsort(-s, axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(part.num_rows), best.shape[1]))
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(best.ravel().astype(np.int32))], [key, vector, "list"])

    return chunks.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(place, f"{kind}, list int")


def search(indexed: DataFrame, c: np.ndarray, queries: DataFrame, k: int, probes: int = 8, key: str = "point_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank) by cosine within the lists that each query probes. indexed: what lists() gave, stored."""
    sizes = cut(indexed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))
    rows = indexed.join(F.broadcast(sizes), "list").withColumn("b", F.pmod(F.xxhash64(key), F.col("blocks")))  # no more lists than centroids
    kind = indexed.schema[key].dataType.simpleString()
    found = None
    for block in blocks(queries.where("vector is not null"), "query_id", "vector"):
        names = [r["query_id"] for r in block]
        q = unit(np.array([r["vector"] for r in block], float))
        near = np.argsort(-(q @ c.T), axis=1, kind="stable")[:, :probes]
        asking: dict[int, list[int]] = {}
        for i, row in enumerate(near.tolist()):
            for n in row:
                asking.setdefault(n, []).append(i)
        sent = indexed.sparkSession.sparkContext.broadcast((names, q, {n: np.array(i) for n, i in asking.items()}))

        part = rows.where(F.col("list").isin(*asking)).groupBy("list", "b").applyInArrow(best_of_list(sent, k, key, vector), f"query_id string, {key} {kind}, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return indexed.sparkSession.createDataFrame([], f"query_id string, {key} {kind}, score double, rank int")
    return top_per_query(found, k, F.desc(F.round("score", 9)), F.col(key))


def best_of_list(sent, k: int, key: str, vector: str):
    """The k best of one list (or a block of it) for each query that probes it."""

    def best(cell: tuple, table: pa.Table) -> pa.Table:
        names, q, asking = sent.value
        at = asking[cell[0].as_py()]
        top = Best(k, len(at))
        t = table.combine_chunks()
        for a in range(0, t.num_rows, 4096):
            part = t.slice(a, 4096)
            v = unit(np.nan_to_num(part.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(part.num_rows, -1))
            top.add(part.column(key).combine_chunks(), v @ q[at].T)
        out = list(top.batches([names[i] for i in at], key))
        empty = pa.schema([("query_id", pa.string()), (key, t.schema.field(key).type), ("score", pa.float64())])
        return pa.Table.from_batches(out) if out else empty.empty_table()

    return best
