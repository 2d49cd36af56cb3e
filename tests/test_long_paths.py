"""Chains longer than any fixed number of levels."""

from quillgraph.operators import graph


def test_path_of_many_hops(spark):
    rows = [(f"v{i}", f"v{i + 1}", "next", 1.0) for i in range(35)] + [("a", "b", "next", 1.0)]
    r = spark.createDataFrame(rows, "src string, dst string, label string, weight double")
    path = [(x["step"], x["src"], x["dst"]) for x in graph.shortest_path(r, ["v0"], ["v35"]).orderBy("step").collect()]
    assert path == [(i + 1, f"v{i}", f"v{i + 1}") for i in range(35)]
