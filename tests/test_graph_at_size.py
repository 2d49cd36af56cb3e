"""Graph operators against plain computations, and in ways that don't pair what access keeps apart."""

import random

from quillgraph.operators import graph

EDGE = "src string, dst string, label string, weight double, expired_at long, provenance array<string>"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_related_records_pair_only_what_a_user_may_read(spark):
    r = random.Random(7)
    mentions = {(f"r{i}", f"e{r.randrange(30)}") for i in range(120) for _ in range(3)}
    edges = spark.createDataFrame([(a, b, "mentions", 1.0, None, [a]) for a, b in sorted(mentions)], EDGE)
    access = {(f"u{i % 3}", f"r{i}") for i in range(120)} | {("u0", "r1"), ("u2", "r0")}
    acl = spark.createDataFrame([*sorted(access), ("u0", "r0")], "user_id string, record_id string")
    asked = [(f"q{i}", f"u{i % 3}", f"r{i}") for i in range(6)]
    got = graph.related_records(edges, acl, spark.createDataFrame(asked, "query_id string, user_id string, record_id string"))
    counts = [x for x in plan(got).splitlines() if "Aggregate" in x and "AS shared" in x]
    assert counts and all("user_id" in x for x in counts)  # counted per user: access was joined before
    want = set()
    for q, u, own in asked:
        first = {e for x, e in mentions if x == own}
        n = {}
        for x, e in mentions:
            if e in first and (u, x) in access and x != own:
                n[x] = n.get(x, 0) + 1
        want |= {(q, x, c, i + 1) for i, (x, c) in enumerate(sorted(n.items(), key=lambda z: (-z[1], z[0]))[:5])}
    assert {tuple(x) for x in got.collect()} == want


def test_relations_carry_what_is_wanted_without_a_second_join_of_edges(spark):
    r = random.Random(5)
    records = [f"r{i}" for i in range(40)]
    rows = [(a, f"e{r.randrange(8)}", "mentions", 1.0, None, [a]) for a in records for _ in range(3)]
    said = {(f"e{r.randrange(8)}", f"e{r.randrange(8)}", label) for label in ("knows", "likes") for _ in range(20)}
    rows += [(*k, float(r.randrange(5)) if r.random() < 0.8 else None, 7 if r.random() < 0.2 else None, r.sample(records, r.randrange(4))) for k in sorted(said)]
    edges = spark.createDataFrame(rows, EDGE)
    ents = spark.createDataFrame([(f"e{i}", f"E{i}", None) for i in range(8)], "id string, label string, type string")
    acl = spark.createDataFrame([(f"u{r.randrange(3)}", a) for a in records for _ in range(2)], "user_id string, record_id string").distinct()
    want = graph.knowledge_graph(edges, ents, acl)[1].select("user_id", "src", "dst", "label", "weight")
    got = graph.knowledge_graph(edges, ents, acl, carry=("weight",))[1].select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count()
    assert plan(got).count("Join") < plan(want).count("Join")
    bare = graph.knowledge_graph(edges, ents, acl, carry=())[1]
    assert bare.columns == ["user_id", "dst", "src", "label"] and bare.count() == got.count()
