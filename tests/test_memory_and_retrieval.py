"""Memories over time, retrieval, questions, metrics and the audit chain."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.config import DAY_MS, Config
from quillgraph.functions import vectors
from quillgraph.operators import audit, evaluate, kgqa, memory, resolve, retrieval

NOW = 1_700_000_000_000


def told(spark, rows):
    """rows: (subject, predicate, object[, confidence[, virtual record]])"""
    full = [(i, i * 10, s, p, o, *(rest + [1.0, "v"][len(rest) :])) for i, (s, p, o, *rest) in enumerate(rows, 1)]
    return spark.createDataFrame([(*r[:7], f"r-{r[6]}", "org") for r in full], schemas.FACTS)


def live(m):
    return sorted(x["memory"] for x in memory.current(m, NOW).collect())


def test_belief_revision(spark):
    m = memory.consolidate(told(spark, [("Ann", "works at", "Meta"), ("Ann", "works at", "Nova"), ("Ann", "works_at", "Nova"), ("Ann", "likes", "tea"), ("Ann", "likes", "jazz")]))
    assert live(m) == ["Ann likes jazz", "Ann likes tea", "Ann works at Nova"]
    assert [(x["version"], x["before"]) for x in memory.history(m).where("memory like '%works%'").orderBy("version").collect()] == [(1, None), (2, "Ann works at Meta")]
    assert {(x["kind"], x["before"], x["after"]) for x in memory.revisions(m).collect()} == {("updated", "Ann works at Meta", "Ann works at Nova")}
    weak = memory.consolidate(told(spark, [("Ann", "lives_in", "Oslo", 0.9), ("Ann", "lives_in", "Rome", 0.4), ("Ann", "lives_in", "Bonn", 0.9)]))
    assert live(weak) == ["Ann lives in Bonn"] and weak.count() == 2
    change = memory.consolidate(told(spark, [("Ann", "likes", "tea"), ("Ann", "dislikes", "tea"), ("Bob", "no longer likes", "jazz"), ("Bob", "likes", "jazz")]))
    assert live(change) == ["Ann dislikes tea", "Bob likes jazz"]
    assert {x["before"] for x in memory.revisions(change).collect()} == {"Ann likes tea", "Bob no longer likes jazz"}


def test_writers_touch_only_what_they_see(spark):
    rows = told(spark, [("Ann", "works_at", "Meta", 1.0, "private"), ("Ann", "works_at", "Nova", 1.0, "other")])
    sees = spark.createDataFrame([("r-other", "other"), ("r-private", "private")], "writer_record string, virtual_record_id string")
    assert live(memory.consolidate(rows, sees)) == ["Ann works at Meta", "Ann works at Nova"]
    sees = sees.unionByName(spark.createDataFrame([("r-other", "private")], sees.schema))
    assert live(memory.consolidate(rows, sees)) == ["Ann works at Nova"]


def test_windows_equal_fold(spark):
    rows = told(spark, [(s, "status is", o) for s, o in zip("ABABABAABB", "xyxxyyzzyx")])
    a = memory.consolidate(rows).select("subject_key", "memory", "version", "is_latest", "created_at", "updated_at")
    b = memory.consolidate_windows(rows)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_opposites(spark):
    p = spark.createDataFrame([("likes",), ("not_likes",), ("dislikes",), ("met",)], "predicate string")
    got = {}
    for x in memory.opposite_predicates(spark, p).collect():
        got.setdefault(x["predicate"], set()).add(x["opposite"])
    assert got["likes"] == {"dislikes", "not_likes", "no_longer_likes"} and got["not_likes"] == {"likes", "dislikes"} and got["met"] == {"not_met", "no_longer_met"}


def test_time(spark):
    m = memory.consolidate(told(spark, [("Ann", "lives_in", "Oslo"), ("Ann", "lives_in", "Rome")]))
    assert [x["memory"] for x in memory.as_of(m, 15).collect()] == ["Ann lives in Oslo"]
    assert memory.as_of(m, 5).count() == 0
    ep = spark.createDataFrame([("org", "v", "r", "Ann visited Bonn", "2024-01-02", ["entity:ann"]), ("org", "v", "r", "Ann visited Bonn", "2024-01-02", ["entity:ann"]), ("org", "v", "r", "", None, None)], "org_id string, virtual_record_id string, record_id string, event string, occurred_at string, actor_ids array<string>")
    e = memory.record_episodes(ep, NOW)
    assert e.count() == 1 and e.first()["subject_key"] == "episode|2024-01-02|ann-visited-bonn"
    line = memory.timeline(m.unionByName(e), "entity:ann").collect()
    assert [(x["kind"], x["superseded"]) for x in line] == [("fact", True), ("fact", False), ("episode", False)]
    pr = spark.createDataFrame([(1, "org", "v", "r", "deploying", "run tests"), (2, "org", "v", "r", "deploying", "run all tests"), (3, "org", "v", "r", None, "be kind")], "seq long, org_id string, virtual_record_id string, record_id string, trigger string, action string")
    p = memory.record_procedures(pr, NOW)
    assert live_of(p, "procedural") == ["When deploying: run all tests", "be kind"]
    prof = memory.profile(m, spark.createDataFrame([("x", 1), ("y", 11)], "to string, rank int"), "entity:ann", NOW)
    assert {(x["section"], x["text"]) for x in prof.collect()} == {("recent", "Ann lives in Rome"), ("related", "x")}
    rel = spark.createDataFrame([("a", "b", "likes", 1.0), ("a", "c", "likes", 1.0)], "src string, dst string, label string, weight double")
    ents = spark.createDataFrame([("a", "Alpha")], "id string, label string")
    got = [(x["category"], x["text"]) for x in memory.reflect(m.unionByName(e).unionByName(p), rel, ents, NOW).collect()]
    assert got == [("focus", "Alpha (2 connections)"), ("change", "Ann lives in Oslo → Ann lives in Rome"), ("preference", "be kind"), ("preference", "When deploying: run all tests"), ("recent", "Ann visited Bonn")]


def live_of(m, kind):
    return sorted(x["memory"] for x in memory.current(m, NOW, kind).collect())


def test_recall_forget_sweep(spark):
    m = memory.consolidate(told(spark, [("Ann", "likes", "tea"), ("Bob", "likes", "rock climbing"), ("Eve", "likes", "tea", 1.0, "secret")])).withColumn("embedding", vectors.hash_embedding("memory"))
    acl = spark.createDataFrame([("u", "v", "r")], "user_id string, virtual_record_id string, record_id string")
    q = spark.createDataFrame([("q", "u", "who likes tea")], "query_id string, user_id string, t string").withColumn("vector", vectors.hash_embedding("t"))
    got = [x["memory"] for x in memory.recall(m, q, acl, NOW).orderBy("rank").collect()]
    assert got == ["Ann likes tea", "Bob likes rock climbing"]
    used = memory.reinforce(m, spark.createDataFrame([("mem:1", 5), ("mem:1", 9)], "id string, ts long"))
    assert [(x["use_count"], x["last_used_at"]) for x in used.where("id = 'mem:1'").collect()] == [(2, 9)]
    done, ends = memory.forget(m, acl, "u", "TEA")
    assert [x["memory"] for x in done.where("is_forgotten").collect()] == ["Ann likes tea"]
    assert [tuple(x) for x in ends.collect()] == [("entity:ann", "likes", "entity:tea")]
    old = m.withColumn("forget_after", F.lit(NOW - 1))
    assert memory.current(old, NOW).count() == 0 and memory.sweep(old, NOW).where("is_forgotten").count() == 3
    assert [tuple(x) for x in memory.counts(m).collect()] == [("semantic", 3, 3, 0)]
    s = {h: m.limit(1).select(memory.strength(20 + 30 * DAY_MS, Config(memory_half_life_days=h)).alias("s")).first()["s"] for h in (30.0, 15.0)}
    assert math.isclose(s[30.0], 0.5, rel_tol=1e-6) and math.isclose(s[15.0], 0.25, rel_tol=1e-6)


def chunks(spark, n=300, d=32):
    r = np.random.default_rng(7)
    v = r.standard_normal((n, d)) * 0.9 ** np.arange(d)  # first numbers tell most
    rows = [(f"p{i:04d}", f"v{i}", [float(x) for x in v[i]]) for i in range(n)]
    return v, spark.createDataFrame(rows, "point_id string, virtual_record_id string, embedding array<float>")


def test_nearest(spark):
    v, c = chunks(spark)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    q = spark.createDataFrame([(f"q{i}", "u" if i else "w", [float(x) for x in v[i]]) for i in range(6)], "query_id string, user_id string, vector array<double>")
    acl = spark.createDataFrame([(who, f"v{i}", f"r{i}") for i in range(300) for who in ("u", "w") if who == "u" or i % 2], "user_id string, virtual_record_id string, record_id string")
    for access in (None, acl):
        got = {}
        for x in retrieval.knn(c, q, 5, access).orderBy("rank").collect():
            got.setdefault(x["query_id"], []).append(int(x["point_id"][1:]))
        for i in range(6):
            s = u @ u[i]
            allowed = [j for j in range(300) if access is None or i or j % 2]
            assert got[f"q{i}"] == sorted(allowed, key=lambda j: (-round(s[j], 6), j))[:5]
    exact = {(x["query_id"], x["point_id"]) for x in retrieval.knn(c, q, 5).collect()}
    near = {(x["query_id"], x["point_id"]) for x in retrieval.two_stage_knn(c, q, 5, Config(mrl_prefix=16)).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    assert 16 <= retrieval.calibrate_prefix(c) <= 32
    assert retrieval.knn(c, q.limit(0), 5).count() == 0


def test_bm25(spark):
    texts = {"a": "alpha beta beta gamma", "b": "alpha alpha delta", "c": "epsilon", "d": "", "e": "alpha beta zeta eta theta iota"}
    c = spark.createDataFrame(list(texts.items()), "point_id string, content string").withColumn("virtual_record_id", F.col("point_id"))
    q = spark.createDataFrame([("q", "u", "Beta, epsilon!"), ("none", "u", "nothing")], "query_id string, user_id string, query string")
    words = {k: t.split() for k, t in texts.items()}
    avg = sum(map(len, words.values())) / 5
    want = {}
    for k, w in words.items():
        for t in ("beta", "epsilon"):
            if t in w:
                n = sum(t in x for x in words.values())
                idf = max(1e-6, math.log((5 - n + 0.5) / (n + 0.5)))
                want[k] = want.get(k, 0) + idf * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / avg))
    got = {x["point_id"]: x["score"] for x in retrieval.bm25(c, q, 10).collect()}
    assert got == pytest.approx(want)
    acl = spark.createDataFrame([("u", "a", "r")], "user_id string, virtual_record_id string, record_id string")
    assert [x["point_id"] for x in retrieval.bm25(c, q, 10, acl).collect()] == ["a"]


def test_fusion_fading_reranking(spark):
    leg = lambda ids: spark.createDataFrame([("q", p, i) for i, p in enumerate(ids, 1)], "query_id string, point_id string, rank int")
    fused = {x["point_id"]: (x["rrf"], x["legs"]) for x in retrieval.fuse({"vector": leg("abc"), "keyword": leg("ca")}).collect()}
    assert fused["a"] == (pytest.approx(1 / 61 + 1 / 62), ["keyword", "vector"]) and fused["b"] == (pytest.approx(1 / 62), ["vector"])
    pool = spark.createDataFrame([("q", "me", "tea time", p, r, x, f"about {w} of {p}.") for p, r, x, w in (("a", "r1", 1.0, "rocks"), ("b", "r1", 0.9, "tea"), ("c", "r1", 0.8, "tea time"), ("d", "r2", 0.5, "time"), ("e", "r3", 0.1, "sand"))], "query_id string, user_id string, query string, point_id string, record_id string, rrf double, content string")
    records = spark.createDataFrame([("r1", "you", 1.0, NOW, 0), ("r2", "me", 2.0, NOW, 3), ("r3", "me", None, 0, 0)], "record_id string, owner_id string, importance double, last_accessed_at long, access_count long")
    faded = {x["point_id"]: x["rrf"] for x in retrieval.fade(pool, records, spark.createDataFrame([("r1",)], "record_id string"), NOW).collect()}
    assert faded["a"] == pytest.approx(0.5) and faded["d"] == pytest.approx(0.5 * 1.2 * 2 * (1 + 0.15 * math.log(4))) and faded["e"] == pytest.approx(0.12)
    assert [x["point_id"] for x in retrieval.diversify(pool, 8).orderBy("rank").collect()] == ["a", "b", "d"]
    again = retrieval.rerank(pool)
    assert [x["point_id"] for x in again.orderBy("place").collect()] == ["c", "b", "d", "a", "e"]
    assert [x["point_id"] for x in retrieval.rerank(pool, n=2).orderBy("place").collect()] == ["b", "a", "c", "d", "e"]
    blend = {x["point_id"]: x["rrf"] for x in retrieval.rerank(pool, blend=True).collect()}
    assert blend["a"] == pytest.approx(1 / 60 + 1 / 63) and blend["c"] == pytest.approx(1 / 62 + 1 / 60)
    more = retrieval.expansion_terms(pool.withColumn("rank", F.lit(1)), 5, 2).first()["expanded"]
    assert more.startswith("tea time ") and len(more.split()) == 4


def test_leak_guard(spark):
    hits = spark.createDataFrame([("q", "u", "v1", "p1", "text", 0.9, "forged"), ("q", "u", "v2", "p2", "text", 0.8, "r1")], "query_id string, user_id string, virtual_record_id string, point_id string, content string, score double, record_id string")
    acl = spark.createDataFrame([("u", "v1", "r1")], "user_id string, virtual_record_id string, record_id string")
    records = spark.createDataFrame([("r1", "Name", "text/plain", "UPLOAD", "org")], "record_id string, record_name string, mime_type string, origin string, org_id string")
    assert [(x["point_id"], x["record_id"]) for x in retrieval.enrich(hits, acl, records).collect()] == [("p1", "r1")]


def test_questions(spark):
    ents = spark.createDataFrame([("u", f"entity:{i}", n, "X") for i, n in (("user", "You"), ("coding", "Coding"), ("sap", "SAP"), ("google", "Google"), ("meta", "Meta"))], "user_id string, id string, label string, type string")
    rels = spark.createDataFrame([("u", "entity:user", "entity:coding", "loves"), ("u", "entity:sap", "entity:google", "partners_with"), ("u", "entity:google", "entity:meta", "limits"), ("u", "entity:sap", "entity:meta", "relates_to")], "user_id string, src string, dst string, label string")
    ask = [("q1", "What do I love?"), ("q2", "my hobbies"), ("q3", "SAP and Google"), ("q4", "compare SAP and Google"), ("q5", "which partnerships exist"), ("q6", "weather tomorrow")]
    q = kgqa.parse(spark.createDataFrame([(i, "u", t) for i, t in ask], "query_id string, user_id string, query string"))
    more = spark.createDataFrame([("b1", "u", "", "sap", "partner", "google", "binary_relation"), ("b2", "u", "", "sap", "limit", "meta", "binary_relation"), ("r1", "u", "", None, "limit", "meta", "relation_query")], "query_id string, user_id string, query string, subject string, predicate string, object string, kind string")
    got = {x["query_id"]: (x["route"], x["facts"], x["confidence"]) for x in kgqa.answer(q.unionByName(more), ents, rels).collect()}
    assert got["q1"] == ("forward", ["You love Coding"], 0.9) and got["q2"] == ("preference", ["You loves Coding"], 0.85)
    assert got["q3"] == ("entity", ["SAP partners with Google"], 0.85) and len(got["q4"][1]) == 2
    assert got["q5"] == ("predicate", ["SAP partners with Google"], 0.8) and "q6" not in got
    assert got["b1"][1:] == (["Yes."], 0.9) and got["b2"][2] == 0.5 and got["r1"] == ("reverse", ["Google limit Meta"], 0.9)
    notes = spark.createDataFrame([("q", 1, "One note."), ("q", 2, "one  NOTE"), ("q", 3, "x" * 50), ("q", 4, "y" * 50), ("q", 5, "z")], "query_id string, pos int, text string")
    assert [x["pos"] for x in kgqa.within_budget(notes, 70).collect()] == [1, 3]
    lines = kgqa.mentioning_lines(spark.createDataFrame([("u", "Google grew. Menu\n- SAP fell")], "user_id string, content string"), spark.createDataFrame([("q", "u", "SAP")], "query_id string, user_id string, term string"))
    assert [x["line"] for x in lines.collect()] == ["SAP fell"]


def test_metrics(spark):
    results = spark.createDataFrame([("a", x, i) for i, x in enumerate(["d1", "d2", "d1", "d3"], 1)] + [("b", "z", 1)], "query_id string, id string, rank int")
    gold = spark.createDataFrame([("a", "d2", 2.0), ("a", "d9", 1.0), ("b", "y", 1.0), ("c", "y", 0.0)], "query_id string, id string, grade double")
    got = {x["query_id"]: x for x in evaluate.metrics(results, gold, 3).collect()}
    assert (got["a"]["recall"], got["a"]["precision"], got["a"]["rr"]) == (0.5, pytest.approx(1 / 3), 0.5)
    assert got["a"]["ndcg"] == pytest.approx((3 / math.log2(3)) / (3 + 1 / math.log2(3)))
    assert tuple(got["b"])[1:] == (0, 0, 0, 0) and got["c"]["recall"] == 1
    card = evaluate.score_card(evaluate.metrics(results, gold, 3), spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "question_id string, category string"))
    assert {(x["category"], x["n"]) for x in card.collect()} == {("x", 1), ("y", 2), ("overall", 3)}
    g = evaluate.gold_set(spark.createDataFrame([("v", "v#0", "The quarterly revenue roadmap"), ("w", "w#0", "a b")], "virtual_record_id string, point_id string, content string"))
    assert [(x["query"], x["id"]) for x in g.collect()] == [("quarterly revenue roadmap", "v")]
    eff = evaluate.efficiency(spark.createDataFrame([("c", "q", "abcd")], "case_id string, query_id string, text string"), spark.createDataFrame([("c", "x" * 40)], "case_id string, text string"))
    assert eff.first()["reduction"] == 10


def test_fragmentation_of_entities(spark):
    forms = {"Acme": ["Acme", "Acme Inc", "Acme, Inc.", "ACME LLC"], "IBM": ["IBM", "International Business Machines"], "Energy": ["Department of Energy", "Dept. of Energy"], "Noble": ["Barnes & Noble", "Barnes and Noble"]}
    rows = [(f"e{i}{j}", f, "ORG", i * 10 + j, truth) for i, (truth, fs) in enumerate(forms.items()) for j, f in enumerate(fs)]
    s = spark.createDataFrame(rows, "id string, label string, type string, seq long, truth string")
    done = resolve.canonicalise(s)
    assert evaluate.fragmentation(done.withColumnRenamed("canonical", "node")).first()[0] == 1.0
    assert {x["canonical"] for x in done.collect()} == {"e00", "e10", "e20", "e30"}
    assert {x["label"] for x in resolve.upgrade_labels(done).collect()} >= {"International Business Machines", "Department of Energy"}
    degree = spark.createDataFrame([("e11", 5), ("e10", 1)], "node string, degree long")
    won = {x["loser"]: x["winner"] for x in resolve.dedupe(s.select("id", "label", "type"), degree).collect()}
    assert won["e10"] == "e11" and won["e01"] == "e00"
    new = spark.createDataFrame([("n1", "Acme Corp", "ORG"), ("n2", "Zebra", "ORG")], "id string, label string, type string")
    assert {x["id"]: x["canonical"] for x in resolve.best_match(new, s.select("id", "label", "type")).collect()} == {"n1": "e00"}


def test_audit_chain(spark):
    rows = audit.extend([{"ts": i, "actor": "a", "org": "o", "action": "read", "target": None, "ok": 1, "detail": ""} for i in range(5)])
    kind = "id long, ts long, actor string, org string, action string, target string, ok int, detail string, prev_hash string, hash string"
    log = spark.createDataFrame([tuple(r.values()) for r in rows], kind)
    for check in (audit.verify, audit.verify_by_neighbours):
        assert check(log).count() == 0
        changed = log.withColumn("actor", F.when(F.col("id") == 3, "b").otherwise(F.col("actor")))
        assert [x["id"] for x in check(changed).collect()] == [3]
        assert [x["id"] for x in check(log.where("id <> 2")).collect()] == [3]
    assert [x["id"] for x in audit.newest(log, 2).collect()] == [5, 4]


def test_inverted_lists_find_most_neighbours(spark, monkeypatch):
    """Recall against exact neighbours over clustered vectors, with lists split into blocks."""
    from quillgraph.operators import ann, retrieval

    monkeypatch.setattr(ann, "BLOCK", 100)
    r = np.random.default_rng(6)
    v = (r.standard_normal((30, 24)).repeat(100, 0) + 0.7 * r.standard_normal((3000, 24))).astype(np.float32)
    chunks = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5001, [1.0])], "point_id long, embedding array<float>")
    asked = spark.createDataFrame([(f"q{i}", "u", v[i].tolist()) for i in range(0, 3000, 60)], "query_id string, user_id string, vector array<float>")
    c = ann.centroids(chunks, sample=2000)
    indexed = ann.cut(ann.lists(chunks, c))
    assert indexed.count() == 3000 and 30 <= len(c) <= 60
    got = {(x["query_id"], x["point_id"]) for x in ann.search(indexed, c, asked, 8).collect()}
    want = {(x["query_id"], x["point_id"]) for x in retrieval.knn(chunks, asked, 8).collect()}
    assert len(got) == len(want) == 400 and len(got & want) >= 0.9 * len(want)
    assert ann.search(indexed, c, asked.limit(0), 8).count() == 0


def test_hybrid_search_equals_a_plain_computation(spark):
    """The flagship's search over chunks of a few documents: both legs, fusion, access and cuts in plain Python."""
    import math
    import re

    from quillgraph.functions import vectors
    from quillgraph.operators import retrieval

    r = np.random.default_rng(8)
    vocabulary = ["".join(r.choice(list("abcdefgh"), 5)) for _ in range(60)]
    texts = [" ".join(r.choice(vocabulary, r.integers(4, 14))) + "." for _ in range(120)]
    rows = [(f"r{i // 3}#{i % 3}", f"r{i // 3}", t, [float(x) for x in vectors.hash_vector(t, {})]) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "point_id string, virtual_record_id string, content string, embedding array<double>")
    may = {u: {f"r{i}" for i in range(40) if i % 3 != k} for k, u in enumerate(("a", "b"))}
    acl = spark.createDataFrame([(u, x, x) for u, xs in may.items() for x in xs], "user_id string, virtual_record_id string, record_id string")
    records = spark.createDataFrame([(f"r{i}", "a" if i % 5 == 0 else "z", 1.0, 0, 0) for i in range(40)], "record_id string, owner_id string, importance double, last_accessed_at long, access_count long")
    edges = spark.createDataFrame([("s", "d", "works_at", 5, ["r1"])], "src string, dst string, label string, expired_at long, provenance array<string>")
    asks = [(f"q{i}", "ab"[i % 2], " ".join(r.choice(vocabulary, 5))) for i in range(12)]
    queries = spark.createDataFrame([(*a, [float(x) for x in vectors.hash_vector(a[2], {})]) for a in asks], "query_id string, user_id string, query string, vector array<double>")
    found, _ = retrieval.hybrid_search(queries, chunks, records, edges, acl, 1000)
    got = {}
    for x in found.orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["point_id"], round(x["rrf"], 9)))
    words = {p: re.findall("[a-z0-9]+", t.lower()) for p, _, t, _ in rows}
    average = sum(map(len, words.values())) / len(words)
    for q, user, query in asks:
        mine = [(p, v, t, e) for p, v, t, e in rows if v in may[user]]
        vec = np.array(vectors.hash_vector(query, {}))
        dense = sorted(((-round(float(np.dot(vec, e)), 9), p) for p, _, _, e in mine))[:64]
        score = {}
        for term in re.findall("[a-z0-9]+", query):
            df = sum(term in w for w in words.values())
            idf = max(math.log((len(words) - df + 0.5) / (df + 0.5)), 1e-6)
            for p, _, _, _ in mine:
                if tf := words[p].count(term):
                    score[p] = score.get(p, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[p]) / average))
        sparse = sorted((-round(s, 9), p) for p, s in score.items())[:64]
        fused = {}
        for leg in (dense, sparse):
            for rank, (_, p) in enumerate(leg, 1):
                fused[p] = fused.get(p, 0) + 1 / (60 + rank)
        for p in fused:
            i = int(p[1:].split("#")[0])
            fused[p] *= (1.2 if user == "a" and i % 5 == 0 else 1) * (0.5 if i == 1 else 1)
        top, want, per = max(fused.values()), [], {}
        for p in sorted(fused, key=lambda p: (-round(fused[p], 12), p)):
            record = p.split("#")[0]
            if fused[p] >= 0.3 * top and per.get(record, 0) < 2 and len(want) < 8:
                per[record] = per.get(record, 0) + 1
                want.append((p, round(fused[p], 9)))
        assert got[q] == want


def test_folds_at_once_equal_folds_by_row(spark):
    """Functional facts with rising, falling and unknown certainties and others, in batches of all sizes, against a fold in plain Python."""
    r = random.Random(2)
    rows = [(f"P{r.randrange(12)}", r.choice(["lives_in", "works_at"] * 3 + ["met"]), r.choice("abc"), *r.choice([(1.0,), (1.0,), (1.0,), (0.4,)])) for _ in range(400)]
    facts = told(spark, rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        got = []
        for size in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got.append(sorted(map(str, memory.consolidate(facts).collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got[0] == got[1]
    want = {}
    for i, (s, p, o, sure) in enumerate(rows):
        chain = want.setdefault((s, p) if p != "met" else (s, p, o), [])
        if not chain or chain[-1][0] != o and sure >= chain[-1][1]:
            chain.append((o, sure))
    versions = {(f"{k[0]} {k[1].replace('_', ' ')} {o}", n + 1, n + 1 == len(c), sure) for k, c in want.items() for n, (o, sure) in enumerate(c)}
    m = memory.consolidate(facts).collect()
    assert {(x["memory"], x["version"], x["is_latest"], x["confidence"]) for x in m} == versions and len(m) == len(versions)
    own = {x["id"]: x for x in m}
    for x in m:
        assert (x["parent_id"] is None) == (x["version"] == 1) == (x["relation"] is None) and own[x["root_id"]]["version"] == 1 and own[x["root_id"]]["subject_key"] == x["subject_key"]
        assert x["parent_id"] is None or (own[x["parent_id"]]["version"], own[x["parent_id"]]["subject_key"]) == (x["version"] - 1, x["subject_key"])


def test_a_timeline_folds_its_subject_only(spark):
    facts = told(spark, [("Ann", "lives_in", "Oslo"), ("Bob", "lives_in", "Rome"), ("Ann", "lives_in", "Bonn")])
    m = memory.consolidate(facts, subject="entity:ann")
    assert {x["subject_key"] for x in m.collect()} == {"entity:ann|lives_in"}
    assert memory.timeline(m, "entity:ann").collect() == memory.timeline(memory.consolidate(facts), "entity:ann").collect()
