"""The questions of memory_recall against plain Python."""

import os

import numpy as np
import pytest

import __spark_entry__ as entry
from quillgraph.functions import vectors
from quillgraph.operators import memory
from quillgraph.plans.registry import table
from quillgraph.plans.relational_queries import ordered_facts

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


def test_memory_recall_asks_for_all(spark):
    asked = [r[0] for r in table(spark, SF, "customer").where("c_custkey % 50 = 0").select("c_custkey").collect()]
    now = 1_000_000_000_000
    m = memory.current(memory.consolidate(ordered_facts(spark, SF)), now).withColumn("strength", memory.strength(now)).withColumn("embedding", vectors.hash_embedding("memory")).collect()
    q = spark.createDataFrame([(f"q{i}", f"status of customer {i}") for i in asked], "query_id string, query string").withColumn("vector", vectors.hash_embedding("query")).collect()
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    want = set()
    for x in q:
        ranked = sorted((-round(float(unit(x["vector"]) @ unit(r["embedding"])), 9), -r["strength"], -r["updated_at"], r["id"]) for r in m)
        want |= {(x["query_id"], r[3], k) for k, r in enumerate(ranked[:8], 1)}
    got = {(r["query_id"], r["id"], r["rank"]) for r in entry.queries()["memory_recall"](spark, SF).collect()}
    assert got == want and len({x[0] for x in got}) == len(asked) > 0
