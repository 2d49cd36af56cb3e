"""Searches by vectors against plain computations, and in ways that don't grow with the number of pairs."""

import time

import numpy as np
from pyspark.sql import functions as F

from quillgraph.functions import vectors
from quillgraph.operators import memory, ranking, retrieval

NOW = 1_000_000_000_000


def cosine(a, b):
    n = min(len(a or []), len(b or []))
    x, y = np.array((a or [])[:n], float), np.array((b or [])[:n], float)
    size = np.linalg.norm(x) * np.linalg.norm(y)
    return float((x * y).sum() / size) if size else 0.0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_vectors(n):
    g = np.random.default_rng(3)
    v = [g.normal(size=12).tolist() for _ in range(n)]
    for i in range(0, n, 9):
        v[i] = v[i % 4]  # exact copies tie
    v[5], v[6], v[7] = None, [], v[7][:5]
    return v


def memories(spark, v):
    rows = [(i, f"m{i}", e, f"v{i % 3}", NOW - (i % 40) * 86_400_000) for i, e in enumerate(v)]
    m = spark.createDataFrame(rows, "id long, memory string, embedding array<double>, virtual_record_id string, occurred_at long")
    return m.selectExpr("*", "occurred_at as created_at", "occurred_at as updated_at", "true as is_latest", "false as is_forgotten", "cast(null as long) as forget_after", "false as is_static", "cast(null as long) as last_used_at", "0 as use_count", "1.0D as confidence")


def test_recall_equals_all_pairs(spark, monkeypatch):
    """All kinds, with copies, empty and shorter vectors, over several slices and blocks; no row per pair is made."""
    v = some_vectors(300)
    asked = [(f"q{i}", "ab"[i % 2], v[i]) for i in (0, 1, 5, 6, 7, 20, 31)]
    q = spark.createDataFrame(asked, "query_id string, user_id string, vector array<double>")
    acl = spark.createDataFrame([("a", "v0"), ("a", "v1"), ("b", "v2"), ("b", "v0")], "user_id string, virtual_record_id string")
    sees = {"a": (0, 1), "b": (2, 0)}
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 3)
    for kind in ("episodic", "procedural", "semantic"):
        got = memory.recall(memories(spark, v).withColumn("kind", F.lit(kind)), q, acl, NOW, kind)
        assert "ArrowEvalPython" not in plan(got) and "MapInArrow" in plan(got)
        want = set()
        for name, user, e in asked:
            rows = [(cosine(e, x), 0.5 ** (i % 40 / 30), i) for i, x in enumerate(v) if i % 3 in sees[user]]
            if kind != "semantic":
                rows = [r for r in rows if r[0] >= 0.15]
            order = {"episodic": lambda r: (-round(0.7 * r[0] + 0.3 * r[1], 9), r[2]), "procedural": lambda r: (-round(r[0], 9), r[2]), "semantic": lambda r: (-round(r[0], 9), -r[1], r[2])}[kind]
            want |= {(name, i, round(s, 8) + 0.0, n + 1) for n, (s, _, i) in enumerate(sorted(rows, key=order)[:8])}
        assert {(r["query_id"], r["id"], round(r["similarity"], 8) + 0.0, r["rank"]) for r in got.collect()} == want


def test_codes_cost_no_power_of_the_length(spark):
    """What a lambda referred to was computed again for each element: the cube of the vector's length."""
    g = np.random.default_rng(4)
    rows = [(i, g.normal(size=1024).tolist()) for i in range(8)]
    start = time.time()
    got = spark.createDataFrame(rows, "i int, v array<double>").select("i", vectors.quantized(vectors.prefix(F.col("v"), 1024))["codes"].alias("c")).collect()
    assert time.time() - start < 30
    for r in got:
        v = np.array(rows[r["i"]][1])
        assert r["c"] == np.floor(v / np.abs(v).max() * 127 + 0.5).astype(int).tolist()


def test_graph_leg_equals_all_pairs(spark, monkeypatch):
    """Each related record's best chunk, the first of copies; chunks and queries aren't joined to pairs."""
    v = some_vectors(400)
    chunks = spark.createDataFrame([(i, f"g{i % 6}", e) for i, e in enumerate(v)], "point_id long, virtual_record_id string, embedding array<double>").repartition(5)
    asked = {f"q{i}": v[i] for i in (1, 2, 5, 7, 9)}
    related = [(q, f"g{(i + j) % 7}") for i, q in enumerate(asked) for j in (0, 1, 3)]
    q = spark.createDataFrame(list(asked.items()), "query_id string, vector array<double>")
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 2)
    got = retrieval.graph_leg(chunks, q, spark.createDataFrame(related, "query_id string, virtual_record_id string"), 8)
    assert "Join" not in plan(got)
    want = {}
    for name, record in related:
        rows = [(-cosine(asked[name], e), i) for i, e in enumerate(v) if f"g{i % 6}" == record]
        if rows:
            want.setdefault(name, []).append(min(rows, key=lambda r: (round(r[0], 12), r[1])))
    want = {(name, i, round(-s, 8) + 0.0) for name, rows in want.items() for s, i in rows}
    assert {(r["query_id"], r["point_id"], round(r["score"], 8) + 0.0) for r in got.collect()} == want


def test_tenants_legs_equal_those_of_the_whole_table(spark, monkeypatch):
    """Each user's queries against that user's chunks only, in cells, give what a search of all chunks gives."""
    g = np.random.default_rng(6)
    words = ["red", "blue", "v1", "2", "sea", "salt", "été", "wind"]
    rows = [(f"p{i:03d}", f"v{i // 2}", (" ".join(g.choice(words, 6)) + " v1.2") if i // 2 % 5 != 4 else "gone", None if i == 3 else g.normal(size=8).tolist()) for i in range(150)]
    chunks = spark.createDataFrame(rows, "point_id string, virtual_record_id string, content string, embedding array<float>")
    acl = spark.createDataFrame([(f"u{i % 5}", f"v{i}", f"r{i}") for i in range(75)] + [("u0", "v1", "r1")], "user_id string, virtual_record_id string, record_id string")
    asks = [(f"q{i}", f"u{i % 6}", " ".join(g.choice(words, 3)) + [" v1.2", "", " gone zzz"][i % 3] if i % 6 != 4 else "red", None if i == 4 else g.normal(size=8).tolist()) for i in range(24)] + [("none", "u1", "", None), ("miss", "u7", "zzz", None)]
    queries = spark.createDataFrame(asks, "query_id string, user_id string, query string, vector array<float>")
    got = retrieval.tenant_legs(chunks, queries, 7, acl, most=4)
    want = {"vector": retrieval.knn(chunks, queries, 7, acl), "keyword": retrieval.bm25(chunks, queries, 7, acl)}
    for leg in want:
        a, b = ({(r["query_id"], r["point_id"], r["rank"], round(r["score"], 9)) for r in x.collect()} for x in (got[leg], want[leg]))
        assert a == b and a


def test_terms_are_looked_up_in_slices():
    import pyarrow as pa

    lists = [["a"] * n if n is not None else None for n in (3, 0, None, 9, 1, 4, 4, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string())), pa.array(range(8))], ["tokens", "id"])
    for part in (batch, batch.slice(2, 5), batch.slice(0, 0)):
        cuts = list(ranking.slices(part, 0, 5))
        assert pa.Table.from_batches(cuts, part.schema).to_pylist() == part.to_pylist()
        assert all(c.num_rows == 1 or sum(len(x or []) for x in c.column(0).to_pylist()) <= 5 for c in cuts)
