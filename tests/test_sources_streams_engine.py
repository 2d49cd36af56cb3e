"""Stores, files, datasets, exports, sessions and the engine from end to end."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import memory
from quillgraph.plans.engine import Engine
from quillgraph.sources import datasets, directory, export
from quillgraph.sources.store import Store, by_keys
from quillgraph.streaming import sessions

NOW = 1_700_000_000_000


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.read("entities").count() == 0
    rows = lambda *x: spark.createDataFrame(list(x), "id string, label string, type string")
    s.write("entities", rows(("a", "A", "X"), ("b", "B", "X")))
    kept = s.read("entities")
    s.upsert("entities", rows(("b", "new", "X"), ("c", "C", "X")), "id")
    assert {(x["id"], x["label"]) for x in s.read("entities").collect()} == {("a", "A"), ("b", "new"), ("c", "C")}
    assert kept.count() == 2 and s.versions("entities") == [1, 2] and s.read("entities", 1).count() == 2
    s.delete("entities", rows(("a", "", "")), "id")
    assert [tuple(x) for x in s.statistics().collect()] == [("entities", 3, 2)]
    assert by_keys(kept, rows(("a", "", ""), ("a", "", "")), "id").count() == 1


def test_directory(spark, tmp_path):
    files = {"a.md": "# Title\n\nText", "src/m.py": "import os\nclass A:\n    def f(self):\n        g()\ndef g():\n    return os\n", "node_modules/x.js": "x", ".git/y.md": "y", "yarn.lock": "z", "empty.txt": "", "big.txt": "x" * 300_000, "bin.txt": "a\0b", "pic.png": "p", "src/z.ts": "let a = 1"}
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    kept, skipped = directory.read_tree(spark, str(tmp_path))
    assert [(x["path"], x["language"]) for x in kept.orderBy("path").collect()] == [("a.md", "markdown"), ("src/m.py", "python"), ("src/z.ts", "typescript")]
    assert {x["why"]: x["n"] for x in skipped.collect()} == {"directory": 1, "other": 2, "size": 1, "binary": 1}  # Spark itself passes over hidden and empty files
    assert kept.where("path = 'a.md'").first()["text"] == files["a.md"]
    k = kept.where("language = 'python'").select(directory.python_graph("text", "path").alias("k")).first()["k"]
    assert {(r["from"], r["type"], r["to"], r["confidence"]) for r in k["relations"]} == {("file:src/m.py", "defines", "sym:src/m.py#A", 1.0), ("sym:src/m.py#A", "has_method", "sym:src/m.py#A.f", 1.0), ("file:src/m.py", "defines", "sym:src/m.py#g", 1.0), ("file:src/m.py", "imports", "module:os", 1.0), ("sym:src/m.py#A.f", "calls", "sym:src/m.py#g", 0.7)}
    assert directory.code_graph("def (", "x")[1] == []


def test_datasets(spark, tmp_path):
    talk = [{"sample_id": "s", "conversation": {"speaker_a": "Ann", "session_2": [{"speaker": "Ann", "dia_id": "D2:1", "text": "", "blip_caption": "a dog"}], "session_10": [{"speaker": "Bob", "dia_id": "D10:1", "text": "hi"}, {"text": "no id"}], "session_2_date_time": "1 May"}, "qa": [{"question": "Q?", "answer": 5, "category": 2, "evidence": ["D2:1"]}, {"question": "A?", "adversarial_answer": "no", "category": 5, "evidence": ["D2:1"]}, {"question": "N?", "category": 9}]}]
    (tmp_path / "l.json").write_text(json.dumps(talk))
    h, q = datasets.locomo(spark, str(tmp_path / "l.json"))
    assert [(x["item_id"], x["text"], x["timestamp"]) for x in h.orderBy("pos").collect()] == [("D2:1", "[shared photo: a dog]", "1 May"), ("D10:1", "hi", None)]
    assert [(x["question_id"], x["answer"], x["category"], x["evidence_ids"], x["abstain"]) for x in q.orderBy("question_id").collect()] == [("s_q0", "5", "temporal", ["D2:1"], False), ("s_q1", "no", "abstention", [], True), ("s_q2", "", "single-hop", [], False)]
    lme = [{"question_id": "x1", "question_type": "multi-session", "question": "Q", "answer": "A", "haystack_session_ids": ["s1"], "haystack_dates": ["d1"], "haystack_sessions": [[{"role": "user", "content": "a"}, {"content": "b"}], []], "answer_session_ids": ["s1"]}, {"question_id": "x2_abs", "question_type": "single-session-user", "question": "Q", "answer": "A", "haystack_sessions": [], "answer_session_ids": ["s1"]}]
    (tmp_path / "m.json").write_text(json.dumps(lme))
    h, q = datasets.longmemeval(spark, str(tmp_path / "m.json"))
    assert [(x["item_id"], x["text"], x["timestamp"]) for x in h.orderBy("pos").collect()] == [("s1", "user: a\nspeaker: b", "d1"), ("x1_session_1", "", None)]
    assert {(x["question_id"], x["category"], x["abstain"], len(x["evidence_ids"])) for x in q.collect()} == {("x1", "multi-hop", False, 1), ("x2_abs", "abstention", True, 0)}
    h, q = datasets.synthetic(spark)
    assert (h.count(), q.count()) == (8, 6)


def test_exports(spark):
    e = spark.createDataFrame([("a'b", "L\\x", "T")], "id string, label string, type string")
    r = spark.createDataFrame([("a'b", "c", "9 lives-in", 2.0, None)], "src string, dst string, label string, weight double, expired_at long")
    got = [x["statement"] for x in export.cypher(e, r).orderBy("part").collect()]
    assert got[0] == "MERGE (n:Entity {id: 'a\\'b'}) SET n.label = 'L\\\\x', n.type = 'T';" and "[r:R_9_LIVES_IN]" in got[1]
    nodes = spark.createDataFrame([("a", "users")], "id string, coll string")
    assert {x["section"] for x in export.dashboard(nodes, r).collect()} == {"collections", "labels", "relations", "degrees"}


NOTES = "session_id string, ts long, op string, content string, important boolean"


def test_session_memory(spark):
    e = spark.createDataFrame([("s", 1, "note", "The  plan", False), ("s", 2, "note", "the plan", True), ("s", 3, "note", "noise", False), ("s", 9, "reference", "THE PLAN", None), ("s", 4, "reference", "unknown", None), ("t", 1, "note", "old", True), ("s", 5, "note", " ", False)], NOTES)
    items = sessions.fold_notes(e)
    assert {(x["content"], x["repeat_count"], x["ref_count"], x["important"], x["last_seen_at"]) for x in items.where("session_id = 's'").collect()} == {("The plan", 2, 1, True, 9), ("noise", 1, 0, False, 3)}
    kept, counts = sessions.consolidate_session(items, 10, "v", 8)
    assert [(x["content"], x["subject_key"].startswith("wm|v|")) for x in kept.collect()] == [("The plan", True)]
    assert {tuple(x) for x in counts.collect()} == {("s", 1, 1)}


def test_token_bucket(spark):
    r = spark.createDataFrame([("k", t, 1.0) for t in (0, 0, 0, 1000, 1001)] + [("big", 0, 9.0)], "key string, ts long, cost double")
    got = [x["allowed"] for x in sessions.token_bucket(r, 2, 1).where("key = 'k'").orderBy("ts").collect()]
    assert sorted(got[:3]) == [False, True, True] and got[3:] == [True, False]
    assert not sessions.token_bucket(r, 2, 1).where("key = 'big'").first()["allowed"]


def drain(query, seconds=120):
    end = time.time() + seconds
    query.processAllAvailable()
    query.stop()
    assert time.time() < end


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([("s", 1000, "note", "Plan", False), ("s", 2000, "note", "plan", False), ("s", 3000, "reference", "plan", False), ("t", 1000, "note", "other", False)], NOTES).withColumn("at", F.timestamp_millis("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    later = spark.createDataFrame([("z", 10 * 86_400_000, "note", "late", False)], NOTES).withColumn("at", F.timestamp_millis("ts"))
    later.coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = sessions.stream_notes(source, "1 second", 86_400_000).writeStream.outputMode("update").format("memory").queryName("notes").option("checkpointLocation", str(tmp_path / "c")).start()
    drain(q)
    got = spark.table("notes").where("session_id = 's'").orderBy(F.desc("repeat_count"), F.desc("ref_count")).first()
    assert (got["repeat_count"], got["ref_count"], got["salient"]) == (2, 1, True)
    ev = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 2.0), (1, "2024-01-01 00:50:00", "a", 3.0), (2, "2024-01-03 00:00:00", "b", 1.0), (2, "2024-01-03 00:00:00", "b", 1.0)], "user_id int, t string, event_type string, value double").select("user_id", F.to_timestamp("t").alias("ts"), "event_type", "value")
    ev.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    w = sessions.windows(stream, "1 hour", late="1 hour").writeStream.outputMode("update").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "d")).start()
    drain(w)
    assert {(x["event_type"], x["n"], x["total"]) for x in spark.table("hours").collect()} == {("a", 2, 5.0), ("b", 2, 2.0)}
    once = sessions.first_seen(stream, ["user_id", "event_type"], "1 hour").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "e")).start()
    drain(once)
    assert spark.table("firsts").count() == 2
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    e.register([{"id": u, "coll": "users", "user_id": u, "org_id": "org", "role": "editor"} for u in ("ann", "bob")] + [{"id": "fin", "coll": "groups"}, {"id": "org", "coll": "organizations"}])
    e.link([("bob", "fin", "belongsTo")])
    docs = [
        ("r1", "Helio memo", "Mara Lind works at Helio Labs.\nHelio Labs partners with Brine Systems.", 1, "ann", [], "org"),
        ("r2", "Ledger", "Brine Systems acquired Northwind Traders. The budget was approved.", 2, "bob", ["fin"], None),
        ("r3", "Move", "Mara Lind works at Brine Systems.", 3, "ann", [], "org"),
    ]
    frame = spark.createDataFrame([(i, "org", n, t, s, o, g, w) for i, n, t, s, o, g, w in docs], "record_id string, org_id string, record_name string, text string, seq long, owner_id string, permitted_principals array<string>, share_with_org string")
    assert e.ingest(frame, NOW).count() == 0
    return e


def test_engine_answers_within_access(engine):
    e = engine
    seen = {u: {x["record_id"] for x in e.access(u, "org").collect()} for u in ("ann", "bob", "eve")}
    assert seen == {"ann": {"r1", "r3"}, "bob": {"r1", "r2", "r3"}, "eve": set()}
    rel = {u: {(x["src"], x["label"]) for x in e.scope(u, "org")[1].where("label <> 'relates_to'").collect()} for u in ("ann", "bob")}
    assert ("entity:brine-systems", "acquired") in rel["bob"] and ("entity:brine-systems", "acquired") not in rel["ann"]
    assert ("entity:mara-lind", "works_at") in rel["ann"]
    assert [x["memory"] for x in e.facts("ann", "org", NOW).where("memory like '%works at%'").collect()] == ["Mara Lind works at Brine Systems"]
    found, trace = e.search(["who acquired Northwind Traders"], "bob", "org", NOW, walk=True)
    assert found.orderBy("rank").first()["record_id"] == "r2" and {x["leg"] for x in trace.collect()} >= {"vector", "keyword"}
    found, _ = e.search(["who acquired Northwind Traders"], "ann", "org", NOW)
    assert "r2" not in {x["record_id"] for x in found.collect()}


def test_engine_graph_and_time(engine):
    e = engine
    assert "entity:helio-labs" in {x["to"] for x in e.neighbours("Brine Systems", "ann", "org").collect()}
    assert e.path("Helio Labs", "Northwind Traders", "bob", "org").count() == 2 and e.path("Helio Labs", "Northwind Traders", "ann", "org").count() == 0
    assert {x["record_id"] for x in e.impact("Brine Systems", "ann", "org").collect()} == {"r1", "r3"}
    assert e.central("bob", "org").first()["node"] == "entity:brine-systems"
    assert ("acquired", "bob") in {(x["label"], x["only"]) for x in e.differences("ann", "bob", "org").collect()}
    assert e.shared(["ann", "bob"], "org").count() >= 1
    assert "entity:northwind-traders" in {x["node"] for x in e.walk(["Helio Labs"], "bob", "org").collect()}
    line = [(x["text"], x["superseded"]) for x in e.timeline("Mara Lind", "ann", "org").collect()]
    assert ("Mara Lind works at Helio Labs", True) in line and ("Mara Lind works at Brine Systems", False) in line
    assert any("MERGE" in x["statement"] for x in e.cypher("ann", "org").collect())
    assert {x["section"] for x in e.context("Brine Systems", "bob", "org", NOW).collect()} >= {"answer", "memory", "snippet"}
    told = e.context("everything about Brine Systems", "bob", "org", NOW).where("section = 'related'").collect()
    assert any("acquired" in x["text"] for x in told)
    assert e.concepts("bob", "org").where("label = 'acquired'").count() == 1
    assert e.communities("bob", "org").count() >= 1 and e.reflect("bob", "org", NOW).count() >= 1
    assert e.doctor().first()["vector_lengths"] == 1
    assert e.statistics("bob", "org").first()["typed"] >= 3
    assert e.revisions("ann", "org").count() == 1


def test_engine_replaces_forgets_and_deletes(engine, spark):
    e = engine
    again = spark.createDataFrame([("r1", "org", "Helio memo", "Helio Labs moved to Oslo.", 9, "ann", "org")], "record_id string, org_id string, record_name string, text string, seq long, owner_id string, share_with_org string")
    e.ingest(again, NOW + 1)
    assert "partners_with" not in {x["label"] for x in e.scope("ann", "org")[1].collect()}
    assert e.store.read("chunks").where("virtual_record_id = 'r1'").count() == 1
    gone = e.forget("oslo", "ann", "org")
    assert gone.count() == 1 and e.facts("ann", "org", NOW).where("memory like '%Oslo%'").count() == 0
    refused = e.delete(["r2"], "ann", "org").first()
    assert not refused["allowed"] and refused["reason"] == "neither owner nor admin"
    assert "r2" in {x["record_id"] for x in e.access("bob", "org").collect()}
    assert e.delete(["r2"], "bob", "org").first()["allowed"]
    assert {x["record_id"] for x in e.access("bob", "org").collect()} == {"r1", "r3"}
    assert "acquired" not in {x["label"] for x in e.scope("bob", "org")[1].collect()}
    e.reindex()
    e.sleep()
    assert e.health().count() >= 5


def test_engine_writes_for_users(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    e.register([{"id": u, "coll": "users", "user_id": u, "org_id": "org", "role": r} for u, r in (("ann", "editor"), ("vic", "viewer"), ("adm", "admin"), ("zed", "editor"))] + [{"id": "org", "coll": "organizations"}])
    kind = "record_id string, org_id string, record_name string, text string, seq long, permitted_principals array<string>, share_with_org string"
    doc = lambda i, text, share="org": spark.createDataFrame([(i, "org", i, text, 1, [], share)], kind)
    assert e.find(["x"], "ann", "org", NOW)[0] == 503
    given = spark.createDataFrame([("r1", [("zeta", "Zeta Works", "ORG")], [("zeta", "mara-lind", "led_by", 0.9)])], "record_id string, entities array<struct<id:string,label:string,type:string>>, relations array<struct<from:string,to:string,type:string,confidence:double>>")
    seen = spark.createDataFrame([("r1", "Mara met the board", "2024-01-02", ["Mara Lind"]), ("r1", "Mara met the board", "2024-01-02", ["Mara Lind"])], "record_id string, event string, occurred_at string, actors array<string>")
    ways = spark.createDataFrame([("r1", "writing", "use short words")], "record_id string, trigger string, action string")
    assert e.ingest(doc("r1", "Mara Lind works at Helio Labs."), NOW, "ann", "org", given, seen, ways).count() == 0
    assert [x["record_id"] for x in e.ingest(doc("r9", "Nothing."), NOW, "vic", "org").collect()] == ["r9"]
    assert [x["record_id"] for x in e.ingest(doc("r1", "Changed."), NOW, "zed", "org").collect()] == ["r1"]
    assert e.ingest(doc("r2", "The ledger of Brine Systems.", "elsewhere"), NOW, "ann", "org").count() == 1
    assert e.store.read("chunks").where("content like '%Changed%'").count() == 0
    assert ("entity:zeta", "led_by") in {(x["src"], x["label"]) for x in e.scope("ann", "org")[1].collect()}
    kinds = {x["kind"]: x["total"] for x in memory.counts(e.memories()).collect()}
    assert kinds["episodic"] == 1 and kinds["procedural"] == 1
    assert e.recall("the board", "episodic", 5, "ann", "org", NOW).count() == 1
    assert "entity:mara-lind" in {x["id"] for x in e.scope("ann", "org")[0].collect()}
    code, hits = e.find(["Mara Lind", "Helio"], "ann", "org", NOW)
    assert code == 200 and hits.first()["record_id"] == "r1" and e.find(["Mara"], "nobody", "org", NOW)[0] == 404
    assert e.find(["Mara"], "ann", "org", NOW, must={"origin": ["CONNECTOR"]})[0] == 404
    before = {(x["src"], x["label"], x["dst"]) for x in e.edges().where("expired_at is null and label = 'works_at'").collect()}
    e.rebuild_graph(NOW + 5)
    e.rebuild_memories()
    assert {(x["src"], x["label"], x["dst"]) for x in e.edges().where("expired_at is null and label = 'works_at'").collect()} == before
    assert e.facts("ann", "org", NOW).count() >= 1
    e.sleep(NOW + 10)


def test_store_appends_without_rewriting(spark, tmp_path, monkeypatch):
    from quillgraph.sources import store

    monkeypatch.setattr(store, "PARTS", 4)
    s = store.Store(spark, str(tmp_path))
    row = lambda i: spark.createDataFrame([(f"e{i}", "x", None)], "id string, label string, type string")
    for i in range(3):
        s.append("entities", row(i))
    assert sorted(p.name for p in (tmp_path / "entities").iterdir()) == ["d=2", "d=3", "v=1"]
    assert [s.read("entities", v).count() for v in (1, 2, 3)] == [1, 2, 3]
    for i in range(3, 6):
        s.append("entities", row(i))
    assert s.read("entities").count() == 6 and sum(p.name.startswith("v=") for p in (tmp_path / "entities").iterdir()) == 2
    s.write("entities", row(9))
    assert s.read("entities").count() == 1


def test_benchmark(spark):
    from quillgraph.plans import benchmark

    h, q = datasets.synthetic(spark)
    card, scored, tokens = benchmark.run(h, q, k=3)
    got = {x["category"]: x for x in card.collect()}
    assert got["overall"]["n"] == 5 and got["overall"]["recall"] >= 0.6 and "abstention" not in got
    assert benchmark.render([x.asDict() for x in got.values()]).count("\n") == len(got) + 1
    assert tokens.count() == 2 and scored.count() == 5
    a = spark.createDataFrame([("q1", "It is Brine Systems."), ("q5", "I don't know"), ("q4", "no idea")], "question_id string, predicted string")
    right = {x["question_id"] for x in benchmark.judge(a, q).where("correct").collect()}
    assert right == {"q1", "q5"}
