"""Graph algorithms, access control and edge states on small graphs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.config import Config
from quillgraph.operators import acl, facts, graph


def relations(spark, edges, user="u"):
    return spark.createDataFrame([(user, a, b, label, float(w)) for a, b, label, w in edges], "user_id string, src string, dst string, label string, weight double")


def clique(names, w=1):
    return [(a, b, "knows", w) for a, b in itertools.combinations(names, 2)]


def test_communities(spark):
    a, b = [f"acme{i}" for i in range(4)], [f"globex{i}" for i in range(4)]
    r = relations(spark, clique(a) + clique(b) + [("acme0", "globex3", "knows", 1)])
    ents = spark.createDataFrame([(x, x.upper(), "ORG") for x in a + b], "id string, label string, type string")
    got = graph.communities(r, ents, "user_id").collect()
    assert sorted(sorted(g["members"]) for g in got) == [[x.upper() for x in a], [x.upper() for x in b]]
    assert {g["hub"] for g in got} == {"ACME0", "GLOBEX3"} and all(list(g["top_relations"]) == ["knows"] for g in got)
    chain = relations(spark, [(f"n{i}", f"n{i + 1}", "next", 1) for i in range(4)])
    assert graph.propagate_labels(chain, "user_id").select("community").distinct().count() == 1


def test_walks_and_paths(spark):
    r = relations(spark, [("A", "B", "x", 1), ("A", "C", "x", 1), ("A", "D", "x", 1), ("B", "E", "x", 1), ("F", "G", "x", 1)])
    got = {x["node"]: x["score"] for x in graph.pagerank(r, ["A"]).collect()}
    assert set(got) == set("BCDE") and got["B"] > got["E"]
    names = "ABCDEFG"
    m = np.zeros((7, 7))
    for a, b in ("AB", "AC", "AD", "BE", "FG"):
        m[names.index(a), names.index(b)] = m[names.index(b), names.index(a)] = 1
    p = m / m.sum(1, keepdims=True)
    t = np.eye(7)[0]
    s = t.copy()
    for _ in range(30):
        s = 0.85 * s @ p + 0.15 * t
    assert all(abs(got[c] - s[names.index(c)]) < 1e-9 for c in "BCDE")
    path = [(x["src"], x["dst"]) for x in graph.shortest_path(r, ["C"], ["E"]).orderBy("step").collect()]
    assert path == [("C", "A"), ("A", "B"), ("B", "E")]
    assert graph.shortest_path(r, ["A"], ["G"]).count() == 0 and graph.shortest_path(r, ["A"], ["A"]).count() == 0
    star = relations(spark, [("hub", f"x{i}", "x", 1) for i in range(80)] + [("x0", "y", "x", 1), ("y", "x1", "x", 1)] + [(f"p{i}", f"r{i}", "x", 1) for i in range(100)])
    path = [x["dst"] for x in graph.shortest_path(star, ["x0"], ["x1"]).orderBy("step").collect()]
    assert path == ["y", "x1"]
    assert [x["dst"] for x in graph.shortest_path(star, ["x5"], ["hub"]).collect()] == ["hub"]
    assert graph.shortest_path(star, ["x5"], ["x6"]).count() == 0
    comp = {x["node"]: x["component"] for x in graph.components(r).collect()}
    assert comp == {**dict.fromkeys("ABCDE", "A"), "F": "F", "G": "F"}


def test_neighbours_and_degrees(spark):
    r = relations(spark, [("a", "b", "relates_to", 9), ("a", "c", "likes", 1), ("d", "a", "likes", 5)])
    ids = spark.createDataFrame([("a",)], "id string")
    assert [(x["to"], x["dir"]) for x in graph.neighbours(r, ids).orderBy("rank").collect()] == [("d", "in"), ("c", "out"), ("b", "out")]
    assert [x["to"] for x in graph.neighbours(r, ids, "relates_to").collect()] == ["b"]
    assert [(x["node"], x["degree"], x["strength"]) for x in graph.central(r, 1).collect()] == [("a", 3, 15.0)]
    ents = spark.createDataFrame([("entity:acme", "Acme"), ("entity:acme-labs", "Acme Labs"), ("entity:zed", "Zed")], "id string, label string")
    ask = spark.createDataFrame([("acme",), ("lab",), ("nobody",)], "name string")
    assert sorted((x["name"], x["id"]) for x in graph.resolve(ask, ents).collect()) == [("acme", "entity:acme"), ("lab", "entity:acme-labs")]


def access_fixture(spark):
    users = spark.createDataFrame([(u, "org") for u in ("alice", "bob", "carol", "ghost")], "user_id string, org_id string")
    p = [("alice", "users", "alice", "org", None, "admin"), ("bob", "users", "bob", "org", None, "editor"), ("carol", "users", "carol", "org", None, None), ("fin", "groups", None, None, None, None), ("org", "organizations", None, None, None, None), ("kb", "recordGroups", None, None, None, None), ("any1", "anyone", None, "org", "open", None)]
    principals = spark.createDataFrame(p, "id string, coll string, user_id string, org_id string, file_key string, role string")
    e = [("bob", "fin", "belongsTo"), ("alice", "org", "belongsTo"), ("bob", "org", "belongsTo"), ("alice", "private", "permissions"), ("fin", "ledger", "permissions"), ("bob", "kb", "permissions"), ("child", "kb", "inheritPermissions"), ("grand", "child", "inheritPermissions"), ("child", "grand", "inheritPermissions"), ("page", "kb", "belongsTo"), ("alice", "draft", "permissions")]
    edges = spark.createDataFrame(e, "src string, dst string, label string")
    r = [(x, f"v-{x}", None, "UPLOAD", "FAILED" if x == "draft" else "COMPLETED") for x in ("private", "ledger", "child", "grand", "page", "open", "draft")]
    records = spark.createDataFrame(r, "record_id string, virtual_record_id string, connector_id string, origin string, indexing_status string")
    return users, principals, edges, records


def test_access_paths(spark):
    got = {}
    for x in acl.accessible(*access_fixture(spark)).collect():
        got.setdefault(x["user_id"], set()).add(x["record_id"])
    assert got == {"alice": {"private", "open"}, "bob": {"ledger", "child", "grand", "page", "open"}, "carol": {"open"}}
    a = acl.accessible(*access_fixture(spark))
    ask = spark.createDataFrame([("bob", "v-ledger"), ("alice", "v-ledger"), ("ghost", "v-open")], "user_id string, virtual_record_id string")
    assert {(x["user_id"], x["allowed"]) for x in acl.can_access(a, ask).collect()} == {("bob", True), ("alice", False), ("ghost", False)}


def test_authorization(spark):
    _, principals, edges, _ = access_fixture(spark)
    rows = [("1", "carol", "org", "create", None, ["carol"], None), ("2", "bob", "org", "create", None, ["fin", "alice"], None), ("3", "bob", "org", "create", None, ["stranger"], None), ("4", "bob", "org", "modify", "alice", [], None), ("5", "alice", "org", "delete", "bob", [], None), ("6", "bob", "org", "create", None, [], "other"), ("7", "bob", "org", "modify", "bob", [], None)]
    asked = spark.createDataFrame(rows, "request_id string, user_id string, org_id string, action string, owner_id string, grants array<string>, share_with_org string")
    assert {x["request_id"] for x in acl.authorize(asked, principals, edges).where("allowed").collect()} == {"2", "5", "7"}


def test_secret_edges_stay_secret(spark):
    users, principals, edges, records = access_fixture(spark)
    a = acl.accessible(users, principals, edges, records)
    g = spark.createDataFrame(
        [("open", "entity:google", "mentions", 1.0, None, ["open"]), ("open", "entity:hsbc", "mentions", 1.0, None, ["open"]), ("ledger", "entity:google", "mentions", 1.0, None, ["ledger"]), ("entity:google", "entity:hsbc", "secretly_partners_with", 1.0, None, ["ledger"]), ("entity:google", "entity:hsbc", "old", 1.0, 5, ["open"]), ("entity:google", "entity:hsbc", "bare", 1.0, None, [])],
        "src string, dst string, label string, weight double, expired_at long, provenance array<string>",
    )
    ents = spark.createDataFrame([("entity:google", "Google", None), ("entity:hsbc", "HSBC", "ORG")], "id string, label string, type string")
    e, r = graph.knowledge_graph(g, ents, a)
    assert {(x["user_id"], x["label"]) for x in r.collect()} == {("bob", "secretly_partners_with")}
    assert {x["user_id"] for x in e.collect()} == {"alice", "bob", "carol"}
    diff = {(x["label"], x["only"]) for x in graph.belief_diff(r, "alice", "bob").collect()}
    assert diff == {("secretly_partners_with", "bob")} and graph.shared_beliefs(r, ["alice", "bob"]).count() == 0


def test_walk_reaches_over_hops_and_respects_access(spark):
    chain = ["zephyr", "kestrel", "neptune", "aurora", "reykjavik"]
    edges, records = [], []
    for i, (x, y) in enumerate(zip(chain, chain[1:])):
        rec = f"R{i}"
        records.append(rec)
        edges += [(rec, x, "mentions", 1.0, None, [rec]), (rec, y, "mentions", 1.0, None, [rec]), (x, y, "leads_to", 1.0, None, [rec])]
    g = spark.createDataFrame(edges, "src string, dst string, label string, weight double, expired_at long, provenance array<string>")
    both = spark.createDataFrame([(u, f"v{r}", r) for u in ("boss", "u") for r in records if u == "boss" or r != "R1"], "user_id string, virtual_record_id string, record_id string")
    seeds = spark.createDataFrame([("q1", "boss", "zephyr"), ("q2", "u", "zephyr")], "query_id string, user_id string, entity string")
    got = {}
    for x in graph.walk_records(g, both, seeds).collect():
        got.setdefault(x["query_id"], {})[x["record_id"]] = x["score"]
    assert {"R0", "R1", "R2"} <= set(got["q1"]) and got["q1"]["R0"] > got["q1"]["R2"]
    assert "R2" not in got["q2"] and "R1" not in got["q2"]
    near = graph.related_records(g, both, spark.createDataFrame([("q", "boss", "R0")], "query_id string, user_id string, record_id string"))
    assert "R1" in {x["record_id"] for x in near.collect()} and "R3" not in {x["record_id"] for x in near.collect()}
    assert graph.walk_records(g, both, seeds, Config(hub=0)).count() == 0


EVENT = "seq long, ts long, op string, src string, dst string, label string, weight double, valid_at long, confidence double, record_id string"


def state(spark, rows):
    e = spark.createDataFrame([(i, i * 10, op, s, d, la, 1.0, v, c, r) for i, (op, s, d, la, v, c, r) in enumerate(rows, 1)], EVENT)
    return {(x["src"], x["dst"], x["label"]): x for x in facts.fold_edges(e).collect()}


def test_edge_states(spark):
    a = lambda d, la="lives_in", r="r1", c=0.5, v=None: ("assert", "ann", d, la, v, c, r)
    one = state(spark, [a("sf", "likes"), a("sf", "likes", "r2", 0.9, 7), a("sf", "likes", "r1", 0.2, 3)])[("ann", "sf", "likes")]
    assert (one["weight"], one["provenance"], one["confidence"], one["valid_at"], one["expired_at"]) == (3.0, ["r1", "r2"], 0.9, 7, None)
    s = state(spark, [a("sf"), a("nyc")])
    assert s[("ann", "sf", "lives_in")]["expired_at"] == 20 and s[("ann", "nyc", "lives_in")]["expired_at"] is None
    s = state(spark, [a("sf"), a("nyc"), a("sf")])
    assert s[("ann", "sf", "lives_in")]["expired_at"] is None and s[("ann", "nyc", "lives_in")]["expired_at"] == 30
    s = state(spark, [a("x", "likes"), a("y", "likes"), ("clear", None, None, None, None, None, "r1"), a("x", "likes"), a("x", "likes", "r2")])
    assert set(s) == {("ann", "x", "likes")} and s[("ann", "x", "likes")]["weight"] == 2
    s = state(spark, [a("x", "likes"), a("y", "likes"), ("expire", "ann", "x", "likes", None, None, None), ("expire", "ann", None, "hates", None, None, None)])
    assert s[("ann", "x", "likes")]["expired_at"] == 30 and s[("ann", "y", "likes")]["expired_at"] is None


def test_merges_and_provenance(spark):
    e = spark.createDataFrame([("ibm", "chips", "makes", 1.0, 1, None, 5, ["a"], 0.5), ("intl", "chips", "makes", 2.0, 2, None, None, ["b"], 0.7), ("intl", "ibm", "same", 1.0, 1, None, None, ["c"], 0.1), ("x", "y", "met", 1.0, 1, None, None, [], None)], "src string, dst string, label string, weight double, created_at long, valid_at long, expired_at long, provenance array<string>, confidence double")
    m = spark.createDataFrame([("intl", "ibm")], "loser string, winner string")
    got = {(x["src"], x["dst"]): x for x in facts.merge_entities(e, m).collect()}
    assert set(got) == {("ibm", "chips"), ("x", "y")}
    one = got[("ibm", "chips")]
    assert (one["weight"], one["provenance"], one["expired_at"], one["confidence"]) == (3.0, ["a", "b"], None, 0.7)
    mentions = spark.createDataFrame([("r1", "x"), ("r1", "y"), ("r2", "x")], "src string, dst string")
    assert {x["src"]: x["provenance"] for x in facts.backfill_provenance(e, mentions).collect()}["x"] == ["r1"]
    nodes = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "b")], "id string, seq int, v string")
    assert {x["id"]: x["v"] for x in facts.latest_nodes(nodes).collect()} == {"a": "new", "b": "b"}
    assert pytest.approx(3.0) == facts.strip_record(e, "a").agg(F.sum("weight")).first()[0] - 1


def test_connectors_and_record_groups(spark):
    users, principals, edges, records = access_fixture(spark)
    tagged = records.withColumn("connector_id", F.when(F.col("record_id").isin("ledger", "child"), "drive").otherwise("mail"))
    got = {x["record_id"] for x in acl.accessible(users, principals, edges, tagged, apps=["drive"]).where("user_id = 'bob'").collect()}
    assert got == {"ledger", "child", "page", "open"}
    got = {x["record_id"] for x in acl.accessible(users, principals, edges, tagged, groups=["other"]).where("user_id = 'bob'").collect()}
    assert got == {"ledger", "open"}
    facets = spark.createDataFrame([("ledger", "topic", "money"), ("child", "topic", "money"), ("child", "lang", "en")], "record_id string, facet string, value string")
    assert [x["record_id"] for x in acl.filter_facets(records, facets, {"topic": ["money"], "lang": ["en", "de"]}).collect()] == ["child"]


def test_what_a_user_cannot_see_changes_nothing(spark):
    from quillgraph.operators import retrieval

    r = np.random.default_rng(3)
    rows = [(f"p{i}", f"v{i}", [float(x) for x in r.standard_normal(8)]) for i in range(40)]
    hidden = {f"v{i}" for i in range(0, 40, 3)}
    access = spark.createDataFrame([("u", v, v) for _, v, _ in rows if v not in hidden], "user_id string, virtual_record_id string, record_id string")
    ask = spark.createDataFrame([("q", "u", rows[0][2])], "query_id string, user_id string, vector array<double>")
    kind = "point_id string, virtual_record_id string, embedding array<float>"
    one = retrieval.knn(spark.createDataFrame(rows, kind), ask, 7, access).orderBy("rank").collect()
    other = [(p, v, [-x for x in e] if v in hidden else e) for p, v, e in rows]
    assert retrieval.knn(spark.createDataFrame(other, kind), ask, 7, access).orderBy("rank").collect() == one


def test_principal_components(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((60, 5)) * [5, 3, 1, 0.1, 0.1]
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, embedding array<float>")
    got = np.array([p["components"] for p in graph.pca(rows, 2).orderBy("id").collect()])
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :2]
    assert np.allclose(np.abs(got), np.abs(x @ axes), atol=1e-3)


def test_access_is_found_once_for_users_with_the_same_rights(spark):
    """A hundred members of a group are one class; a grant or an organisation of one's own makes another."""
    users = [(f"u{i:03d}", "org2" if i == 7 else "org1") for i in range(100)]
    u = spark.createDataFrame(users + [("u008", "org2"), ("stranger", "org1")], "user_id string, org_id string")
    p = [(x, "users", x, None, None) for x, _ in users] + [("g", "groups", None, None, None), ("rg", "recordGroups", None, None, None), ("any", "anyone", None, "org2", "r5")]
    p = spark.createDataFrame(p, "id string, coll string, user_id string, org_id string, file_key string")
    e = [(x, "g", "belongsTo") for x, _ in users if x != "u050"] + [("g", "rg", "permissions"), ("u009", "r6", "permissions")] + [(f"r{i}", "rg", "inheritPermissions") for i in range(4)]
    e = spark.createDataFrame(e, "src string, dst string, label string")
    r = spark.createDataFrame([(f"r{i}", f"v{i}", "c", "CONNECTOR", "COMPLETED") for i in range(8)], "record_id string, virtual_record_id string, connector_id string, origin string, indexing_status string")
    seen, members = acl.accessible_to_classes(u, p, e, r)
    assert {x["class"] for x in members.collect()} == {"u000", "u007", "u008", "u009", "u050"}
    assert seen.count() == 4 + 5 + 5 + 5
    want = {(x, i) for x, _ in users for i in range(4) if x != "u050"} | {("u007", 5), ("u008", 5), ("u009", 6)}
    assert sorted((x["user_id"], x["virtual_record_id"], x["record_id"]) for x in acl.accessible(u, p, e, r).collect()) == sorted((x, f"v{i}", f"r{i}") for x, i in want)
