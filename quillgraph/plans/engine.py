"""The engine as one object: documents in, answers out, for users who see what they may see.

Every read goes through ``access()``, so no method can leave it out. Tables live in a Store; writes make new versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.config import GENERIC, STRUCTURAL, Config
from quillgraph.functions import text as T
from quillgraph.functions import vectors
from quillgraph.operators import acl, facts, graph, ingest, kgqa, memory, resolve, retrieval
from quillgraph.operators.lineage import cut
from quillgraph.sources import directory, export
from quillgraph.sources.store import Store


class Engine:
    """embedder: a UDF from a text column to vectors, the same for chunks, memories and questions."""

    def __init__(self, spark: SparkSession, path: str, cfg: Config = Config(), embedder: Callable[..., Column] = vectors.hash_embedding):
        self.spark, self.store, self.cfg, self.embedder = spark, Store(spark, path), cfg, embedder

    # identity

    def register(self, principals: list[dict]) -> None:
        """Users, groups, organisations and teams: id, coll, and for users user_id, role, org_id."""
        names = ("id", "coll", "user_id", "email", "role", "org_id", "file_key")
        rows = [tuple(p.get(n) for n in names) for p in principals]
        self.store.upsert("principals", self.spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)), "id")

    def link(self, edges: list[tuple[str, str, str]]) -> None:
        """Structural edges (src, dst, label): memberships, grants, inheritance."""
        rows = self.spark.createDataFrame([(0, 0, "assert", s, d, la, 1.0, None, None, None) for s, d, la in edges], self._events().schema)
        self.store.append("edge_events", rows)

    def _events(self) -> DataFrame:
        return self.store.read("edge_events")

    def _structure(self) -> DataFrame:
        return self._events().where(F.col("label").isin(*(x for x in STRUCTURAL if x != "mentions"))).select("src", "dst", "label").distinct()

    # writing

    def authorized(self, requests: DataFrame) -> DataFrame:
        """requests (request_id, user_id, org_id, action, owner_id, grants, share_with_org) with allowed and reason."""
        return acl.authorize(requests, self.store.read("principals"), self._structure())

    def _may_write(self, docs: DataFrame, user_id: str, org_id: str) -> DataFrame:
        """(record_id, allowed, reason) of documents that a user wants to write; a known record keeps its owner."""
        have = set(docs.columns)
        col = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
        owners = self.store.read("records").select("record_id", F.col("owner_id").alias("known_owner"), F.lit("modify").alias("known"))
        asked = docs.select("record_id", F.coalesce(col("permitted_principals", "array<string>"), F.array().cast("array<string>")).alias("grants"), col("share_with_org", "string").alias("share_with_org")).join(owners, "record_id", "left")
        rows = asked.select(F.col("record_id").alias("request_id"), F.lit(user_id).alias("user_id"), F.lit(org_id).alias("org_id"), F.coalesce("known", F.lit("create")).alias("action"), F.when(F.col("known").isNotNull(), F.col("known_owner")).otherwise(F.lit(user_id)).alias("owner_id"), "grants", "share_with_org")
        return self.authorized(rows.dropDuplicates(["request_id"])).select(F.col("request_id").alias("record_id"), "allowed", "reason")

    def ingest(self, docs: DataFrame, now_ms: int, user_id: str | None = None, org_id: str | None = None, given: DataFrame | None = None, episodes: DataFrame | None = None, procedures: DataFrame | None = None) -> DataFrame:
        """docs: record_id, org_id, record_name, text, seq, and optionally owner, grants, sharing. A record that comes
        again replaces what it said before. Gives documents that were refused, for their size or because the user (if
        one is named) may not write them.

        given: record_id, entities, relations of graphs that come with records. episodes: record_id, event, occurred_at,
        actors (names). procedures: record_id, trigger, action.
        """
        docs = ingest.latest_documents(docs.withColumn("created_at", F.lit(now_ms)))
        barred = None
        if user_id is not None:
            may = cut(self._may_write(docs, user_id, org_id))
            barred = docs.join(may.where("not allowed"), "record_id", "left_semi")
            docs = docs.join(may.where("allowed"), "record_id", "left_semi")
        clean, refused = ingest.accepted(docs, self.cfg)
        if user_id is not None:
            clean = clean.withColumn("owner_id", F.coalesce("owner_id", F.lit(user_id)))
            refused = refused.unionByName(barred, allowMissingColumns=True)
        clean = cut(clean)
        found = ingest.extraction(clean)
        if given is not None:
            found = ingest.with_given(found, given)
        found = cut(found)
        grants, shared = ingest.grants(clean)
        self._write_graph(found, clean.select("record_id", "seq"), now_ms, grants)
        self.store.upsert("records", ingest.records(clean, found), "record_id")
        fresh = ingest.chunks(clean, self.cfg, self.embedder)
        old = self.store.read("chunks").join(clean.select("virtual_record_id"), "virtual_record_id", "left_semi")
        if old.isEmpty():
            self.store.append("chunks", fresh)
        else:
            self.store.write("chunks", self.store.read("chunks").join(clean.select("virtual_record_id"), "virtual_record_id", "left_anti").unionByName(fresh))
        if not shared.isEmpty():
            self.store.upsert("principals", shared.select("id", "coll", *[F.lit(None).cast("string").alias(n) for n in ("user_id", "email", "role")], "org_id", "file_key"), "id")
        last = self.store.read("facts").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
        self.store.append("facts", ingest.facts(found, clean).withColumn("seq", F.col("seq") + F.lit(last)).withColumn("ts", F.lit(now_ms).cast("long")))
        where = clean.select("record_id", "virtual_record_id", "org_id")
        if episodes is not None:
            self._write_episodes(episodes.join(where, "record_id"), now_ms)
        if procedures is not None:
            done = self.store.read("procedures").count()
            rows = procedures.join(where, "record_id").withColumn("n", F.row_number().over(Window.partitionBy("trigger").orderBy("record_id", "action")))
            self.store.append("procedures", rows.select((F.col("n") + F.lit(done)).cast("long").alias("seq"), F.lit(now_ms).cast("long").alias("ts"), "org_id", "virtual_record_id", "record_id", "trigger", "action"))
        return refused

    def _write_graph(self, found: DataFrame, records: DataFrame, now_ms: int, grants: DataFrame | None) -> None:
        """Entities and edge events of extracted knowledge, after whatever its records said before is cleared."""
        known = self.store.read("entities").select("id", "label", "type", F.lit(-1).cast("long").alias("seq"))
        nodes, _ = ingest.graph_events(found)
        forms = known.unionByName(nodes.select("id", "label", "type", "seq")).groupBy("id").agg(F.min_by(F.struct("label", "type"), "seq").alias("n"), F.min("seq").alias("seq")).select("id", "n.*", "seq")
        canonical = cut(resolve.canonicalise(forms.where("label is not null")).select("id", "canonical"))
        nodes, events = ingest.graph_events(found, canonical)
        clear = records.select("seq", F.lit(now_ms).cast("long").alias("ts"), F.lit("clear").alias("op"), *[F.lit(None).cast(t).alias(n) for n, t in (("src", "string"), ("dst", "string"), ("label", "string"), ("weight", "double"), ("valid_at", "long"), ("confidence", "double"))], "record_id")
        last = self._events().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
        events = clear.withColumn("seq", F.col("seq") * 2 + last).unionByName(events.withColumn("seq", F.col("seq") * 2 + last + 1).withColumn("ts", F.lit(now_ms).cast("long")))
        if grants is not None:
            events = events.unionByName(grants.select(F.lit(0).cast("long").alias("seq"), F.lit(now_ms).cast("long").alias("ts"), F.lit("assert").alias("op"), "src", "dst", "label", F.lit(1.0).alias("weight"), F.lit(None).cast("long").alias("valid_at"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("record_id")))
        self.store.append("edge_events", events)
        self.store.upsert("entities", nodes.select("id", "label", "type"), "id")

    def _write_episodes(self, episodes: DataFrame, now_ms: int) -> None:
        """Episodes that aren't there yet, and their actors as entities that the records mention."""
        rows = cut(episodes.withColumn("actor_ids", F.transform(F.coalesce("actors", F.array().cast("array<string>")), T.entity_id)))
        new = memory.record_episodes(rows.drop("actors"), now_ms)
        self.store.append("episodes", new.join(self.store.read("episodes").select("id"), "id", "left_anti").select(*new.columns))
        actors = rows.select("record_id", F.explode("actors").alias("label")).select("record_id", T.entity_id(F.col("label")).alias("id"), "label").dropDuplicates(["record_id", "id"])
        ents = actors.groupBy("id").agg(F.min("label").alias("label")).select("id", "label", F.lit("PERSON").alias("type"))
        self.store.append("entities", ents.join(self.store.read("entities").select("id"), "id", "left_anti").select("id", "label", "type"))
        last = self._events().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
        self.store.append("edge_events", actors.select(F.lit(last).cast("long").alias("seq"), F.lit(now_ms).cast("long").alias("ts"), F.lit("assert").alias("op"), F.col("record_id").alias("src"), F.col("id").alias("dst"), F.lit("mentions").alias("label"), F.lit(1.0).alias("weight"), F.lit(None).cast("long").alias("valid_at"), F.lit(None).cast("double").alias("confidence"), "record_id"))

    def rebuild_graph(self, now_ms: int) -> None:
        """Everything that records' chunks say, extracted anew."""
        place = F.substring_index("point_id", "#", -1).cast("int")
        texts = self.store.read("chunks").groupBy("virtual_record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("i"), "content"))), lambda c: c["content"]), "\n\n").alias("text"))
        docs = self.store.read("records").select("record_id", "virtual_record_id").join(texts, "virtual_record_id").select("record_id", "text", F.xxhash64("record_id").bitwiseAND(F.lit((1 << 30) - 1)).alias("seq"))
        self._write_graph(cut(ingest.extraction(docs)), docs.select("record_id", "seq"), now_ms, None)

    def rebuild_memories(self) -> None:
        """Facts of all live typed edges, instead of those on record."""
        self.store.write("facts", cut(memory.facts_from_edges(self.edges())))

    def learn(self, root: str, user_id: str, org_id: str, now_ms: int) -> DataFrame:
        """Reads a directory tree; gives counts of files by language and of skipped ones by reason."""
        files, skipped = directory.read_tree(self.spark, root)
        seq = F.xxhash64("path").bitwiseAND(F.lit((1 << 30) - 1))
        docs = files.select(F.concat(F.lit("file:"), "path").alias("record_id"), F.lit(org_id).alias("org_id"), F.col("path").alias("record_name"), "text", seq.alias("seq"), F.lit(user_id).alias("owner_id"))
        self.ingest(docs, now_ms)
        return files.groupBy(F.col("language").alias("what")).agg(F.count("*").alias("n")).unionByName(skipped.select(F.concat(F.lit("skipped: "), "why").alias("what"), "n"))

    def delete(self, record_ids: list[str], user_id: str, org_id: str) -> DataFrame:
        """Deletes the records that the user may modify, as owner or admin; gives (record_id, allowed, reason)."""
        keys = self.spark.createDataFrame([(r,) for r in record_ids], "record_id string")
        owners = self.store.read("records").join(keys, "record_id").select("record_id", "owner_id")
        asked = owners.select(F.col("record_id").alias("request_id"), F.lit(user_id).alias("user_id"), F.lit(org_id).alias("org_id"), F.lit("delete").alias("action"), "owner_id", F.array().cast("array<string>").alias("grants"), F.lit(None).cast("string").alias("share_with_org"))
        may = cut(self.authorized(asked).select(F.col("request_id").alias("record_id"), "allowed", "reason"))
        gone = may.where("allowed").select("record_id")
        last = self._events().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
        clear = gone.select(F.lit(last).cast("long").alias("seq"), F.lit(0).cast("long").alias("ts"), F.lit("clear").alias("op"), *[F.lit(None).cast(t).alias(n) for n, t in (("src", "string"), ("dst", "string"), ("label", "string"), ("weight", "double"), ("valid_at", "long"), ("confidence", "double"))], "record_id")
        vids = cut(self.store.read("records").join(gone, "record_id", "left_semi").select("virtual_record_id"))
        self.store.delete("chunks", vids, "virtual_record_id")
        self.store.delete("records", gone, "record_id")
        self.store.append("edge_events", clear)
        return may

    def forget(self, phrase: str, user_id: str, org_id: str) -> DataFrame:
        """Memories that hold the phrase and that the user sees; they are gone from recall, and their edges expire."""
        v = self._vector(phrase)
        done, expired = memory.forget(self.memories().withColumn("embedding", self.embedder("memory")), self.access(user_id, org_id), user_id, phrase, v, cfg=self.cfg)
        told = cut(done.where("is_forgotten and forget_reason = 'forgotten by user'").select("subject_key", "memory"))
        last = self._events().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
        ends = expired.select(F.lit(last).cast("long").alias("seq"), F.lit(0).cast("long").alias("ts"), F.lit("expire").alias("op"), "src", "dst", "label", *[F.lit(None).cast(t).alias(n) for n, t in (("weight", "double"), ("valid_at", "long"), ("confidence", "double"), ("record_id", "string"))])
        self.store.append("edge_events", cut(ends))
        self.store.append("forgotten", told.withColumn("reason", F.lit("forgotten by user")))
        return told

    # what a user may see

    def access(self, user_id: str, org_id: str) -> DataFrame:
        users = self.spark.createDataFrame([(user_id, org_id)], "user_id string, org_id string")
        return self.store.cached("acl", lambda: acl.accessible(users, self.store.read("principals"), self._structure(), self.store.read("records")), user_id, org_id)

    def edges(self) -> DataFrame:
        return self.store.cached("edges", lambda: facts.fold_edges(self._events().where(~F.col("op").isin("assert") | F.col("record_id").isNotNull())))

    def scope(self, user_id: str, org_id: str) -> tuple[DataFrame, DataFrame]:
        """The user's entities and live relations."""
        build = lambda: graph.knowledge_graph(self.edges(), self.store.read("entities"), self.access(user_id, org_id))
        return self.store.cached("entities", lambda: build()[0], user_id, org_id), self.store.cached("relations", lambda: build()[1], user_id, org_id)

    def memories(self) -> DataFrame:
        return self.store.cached("memories", self._memories)

    def _memories(self) -> DataFrame:
        m = memory.consolidate(self.store.read("facts"))
        told = self.store.read("procedures")
        ways = memory.record_procedures(told, told.agg(F.coalesce(F.max("ts"), F.lit(0))).first()[0])
        m = m.unionByName(self.store.read("episodes").select(*m.columns)).unionByName(ways.select(*m.columns))
        gone = self.store.read("forgotten").groupBy("subject_key", "memory").agg(F.min("reason").alias("f"))
        j = m.join(gone, ["subject_key", "memory"], "left")
        return j.withColumn("forget_reason", F.coalesce("f", "forget_reason")).withColumn("is_forgotten", F.col("is_forgotten") | F.col("f").isNotNull()).select(*m.columns)

    def _seen_memories(self, user_id: str, org_id: str) -> DataFrame:
        return self.memories().join(self.access(user_id, org_id).select("virtual_record_id"), "virtual_record_id", "left_semi")

    def _vector(self, text: str) -> list[float]:
        if self.embedder is vectors.hash_embedding:
            return [float(x) for x in vectors.hash_vector(text, {})]
        one = self.spark.createDataFrame([(text,)], "t string").select(self.embedder("t").alias("v")).first()
        return [float(x) for x in one["v"]]

    def _ids(self, names: list[str], user_id: str, org_id: str) -> list[str]:
        ents, _ = self.scope(user_id, org_id)
        asked = self.spark.createDataFrame([(n,) for n in names], "name string")
        return sorted({r["id"] for r in graph.resolve(asked, ents).collect()})

    # questions

    def search(self, queries: list[str], user_id: str, org_id: str, now_ms: int, walk: bool = False, **options) -> tuple[DataFrame, DataFrame]:
        """Results and trace of a hybrid search; options go to hybrid_search."""
        rows = [(f"q{i}", user_id, q, self._vector(q)) for i, q in enumerate(queries)]
        asked = self.spark.createDataFrame(rows, "query_id string, user_id string, query string, vector array<double>")
        access, edges = self.access(user_id, org_id), self.edges()
        chunks, records = self.store.read("chunks"), self.store.read("records")
        dense = retrieval.knn(chunks, asked, self.cfg.topk, access).join(chunks.select("point_id", "virtual_record_id"), "point_id").join(access.select("virtual_record_id", "record_id"), "virtual_record_id")
        seeds = dense.select("query_id", F.lit(user_id).alias("user_id"), "record_id").distinct()
        to_vid = access.select("record_id", "virtual_record_id")
        related = graph.related_records(edges, access, seeds, cfg=self.cfg).join(to_vid, "record_id").select("query_id", "virtual_record_id")
        walked = None
        if walk:
            ents, _ = self.scope(user_id, org_id)
            words = asked.select("query_id", "user_id", F.explode(T.query_tokens(F.col("query"))).alias("w"))
            named = words.join(ents.select("id", F.explode(T.query_tokens(F.col("label"))).alias("w")), "w").select("query_id", "user_id", F.col("id").alias("entity")).distinct()
            walked = graph.walk_records(edges, access, named, self.cfg).join(to_vid, "record_id").select("query_id", "virtual_record_id")
        return retrieval.hybrid_search(asked, chunks, records, edges, access, now_ms, self.cfg, related, walked, **options)

    def facts(self, user_id: str, org_id: str, now_ms: int, query: str | None = None) -> DataFrame:
        m = self._seen_memories(user_id, org_id)
        if query is None:
            return memory.current(m, now_ms)
        asked = self.spark.createDataFrame([("q", user_id, self._vector(query))], "query_id string, user_id string, vector array<double>")
        return memory.recall(m.withColumn("embedding", self.embedder("memory")), asked, self.access(user_id, org_id), now_ms, cfg=self.cfg)

    def recall(self, query: str, kind: str, limit: int, user_id: str, org_id: str, now_ms: int) -> DataFrame:
        """(query_id, id, memory, similarity, rank) of episodes or procedures that bear on a question."""
        asked = self.spark.createDataFrame([("q", user_id, self._vector(query))], "query_id string, user_id string, vector array<double>")
        return memory.recall(self._seen_memories(user_id, org_id).withColumn("embedding", self.embedder("memory")), asked, self.access(user_id, org_id), now_ms, kind, limit, self.cfg)

    def find(self, queries: list[str], user_id: str, org_id: str, now_ms: int, must: dict[str, list] | None = None, should: dict[str, list] | None = None, limit: int = 20) -> tuple[int, DataFrame]:
        """A status and hits (point_id, record_id, record_name, content, score), best first, of several wordings.

        must and should filter records' columns. 503: nothing is indexed; 404: nothing that the user may see (or passes
        the filters); 200: all else, also without hits.
        """
        none = self.spark.createDataFrame([], "point_id string, record_id string, record_name string, content string, score double")
        chunks = self.store.read("chunks")
        if chunks.isEmpty():
            return 503, none
        records = self.store.read("records")
        access = self.access(user_id, org_id).join(records.where(retrieval.matching(must, should)).select("record_id"), "record_id", "left_semi")
        if access.isEmpty():
            return 404, none
        rows = [(f"q{i}", i, user_id, q, self._vector(q)) for i, q in enumerate(queries)]
        asked = self.spark.createDataFrame(rows, "query_id string, query_idx int, user_id string, query string, vector array<double>")
        hits = retrieval.knn(chunks, asked, limit, access).join(asked.select("query_id", "query_idx", "user_id"), "query_id")
        best = retrieval.first_of_queries(hits, limit).join(chunks.select("point_id", "virtual_record_id", "content"), "point_id")
        return 200, retrieval.enrich(best, access, records).select("point_id", "record_id", "record_name", "content", "score").orderBy(F.desc("score"), "point_id")

    def as_of(self, t: int, user_id: str, org_id: str) -> DataFrame:
        return memory.as_of(self._seen_memories(user_id, org_id), t)

    def timeline(self, subject: str, user_id: str, org_id: str) -> DataFrame:
        return memory.timeline(self._seen_memories(user_id, org_id), T.ENTITY + graph_slug(subject))

    def profile(self, subject: str, user_id: str, org_id: str, now_ms: int) -> DataFrame:
        return memory.profile(self._seen_memories(user_id, org_id), self.neighbours(subject, user_id, org_id), T.ENTITY + graph_slug(subject), now_ms)

    def reflect(self, user_id: str, org_id: str, now_ms: int) -> DataFrame:
        ents, rels = self.scope(user_id, org_id)
        return memory.reflect(self._seen_memories(user_id, org_id), rels, ents, now_ms)

    def revisions(self, user_id: str, org_id: str) -> DataFrame:
        return memory.revisions(self._seen_memories(user_id, org_id))

    def answer(self, question: str, user_id: str, org_id: str) -> DataFrame:
        ents, rels = self.scope(user_id, org_id)
        asked = kgqa.parse(self.spark.createDataFrame([("q", user_id, question)], "query_id string, user_id string, query string"))
        return kgqa.answer(asked, ents, rels)

    def context(self, question: str, user_id: str, org_id: str, now_ms: int) -> DataFrame:
        """(section, rank, text): exact answers, current facts, how-tos, experiences, what the graph says about entities
        that the question names (where it asks for breadth or has no exact answer), and snippets marked as data."""
        exact = cut(self.answer(question, user_id, org_id).where(F.col("confidence") >= 0.7).select(F.lit("answer").alias("section"), F.posexplode("facts").alias("rank", "text")))
        part = lambda df, name: df.select(F.lit(name).alias("section"), "rank", F.col("memory").alias("text"))
        told = part(self.facts(user_id, org_id, now_ms, question), "memory")
        ways = part(self.recall(question, "procedural", 3, user_id, org_id, now_ms), "procedure")
        lived = part(self.recall(question, "episodic", 5, user_id, org_id, now_ms), "episode")
        broad = self.spark.range(1).select(T.wants_breadth(F.lit(question))).first()[0]
        out = exact.unionByName(told).unionByName(ways).unionByName(lived)
        if broad or exact.isEmpty():
            out = out.unionByName(self.related_facts(question, user_id, org_id, 20 if broad else 40).select(F.lit("related").alias("section"), "rank", "text"))
        found, _ = self.search([question], user_id, org_id, now_ms)
        shown = found.join(self.store.read("records").select("record_id", "record_name"), "record_id").select(F.lit("snippet").alias("section"), "rank", T.wrap_untrusted(F.col("passage"), F.col("record_name"), F.col("rank")).alias("text"))
        return out.unionByName(shown)

    def related_facts(self, question: str, user_id: str, org_id: str, limit: int = 40) -> DataFrame:
        """(rank, text): typed relations of the entities whose whole label a question names, heavier ones first."""
        ents, rels = self.scope(user_id, org_id)
        asked = F.concat(F.lit(" "), T.answer_form(F.lit(question)), F.lit(" "))
        named = ents.where(F.length("label") >= 3).where(F.contains(asked, F.concat(F.lit(" "), T.answer_form(F.col("label")), F.lit(" ")))).select(F.col("id").alias("node"))
        near = graph.adjacency(rels.where(F.col("label") != GENERIC)).join(named, "node", "left_semi")
        name = lambda c: ents.select(F.col("id").alias(c), F.col("label").alias(c + "_name"))
        told = near.join(name("node"), "node").join(name("to"), "to")
        words = F.replace("label", F.lit("_"), F.lit(" "))
        text = F.when(F.col("dir") == "out", F.concat_ws(" ", "node_name", words, "to_name")).otherwise(F.concat_ws(" ", "to_name", words, "node_name"))
        one = told.groupBy(text.alias("text")).agg(F.max("weight").alias("weight")).orderBy(F.desc("weight"), "text").limit(limit)
        return one.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("weight"), "text"))).select("rank", "text")  # of limit rows

    # the graph

    def neighbours(self, name: str, user_id: str, org_id: str, relation: str | None = None) -> DataFrame:
        _, rels = self.scope(user_id, org_id)
        ids = self.spark.createDataFrame([(i,) for i in self._ids([name], user_id, org_id)], "id string")
        return graph.neighbours(rels, ids, relation)

    def path(self, a: str, b: str, user_id: str, org_id: str) -> DataFrame:
        _, rels = self.scope(user_id, org_id)
        return graph.shortest_path(rels, self._ids([a], user_id, org_id), self._ids([b], user_id, org_id))

    def impact(self, name: str, user_id: str, org_id: str) -> DataFrame:
        ids = self.spark.createDataFrame([(i,) for i in self._ids([name], user_id, org_id)], "id string")
        return graph.impact(self.edges(), self.access(user_id, org_id), ids)

    def central(self, user_id: str, org_id: str, limit: int = 10) -> DataFrame:
        return graph.central(self.scope(user_id, org_id)[1], limit)

    def concepts(self, user_id: str, org_id: str, limit: int = 50) -> DataFrame:
        """(src, label, dst) by name: the heaviest typed relations that the user sees."""
        ents, rels = self.scope(user_id, org_id)
        names = ents.select("id", F.col("label").alias("name"))
        top = rels.where(F.col("label") != GENERIC).orderBy(F.desc("weight"), "src", "label", "dst").limit(limit)
        for end in ("src", "dst"):
            top = top.join(names.withColumnsRenamed({"id": end, "name": end + "_name"}), end, "left")
        return top.orderBy(F.desc("weight"), "src", "label", "dst").select(F.coalesce("src_name", "src").alias("src"), "label", F.coalesce("dst_name", "dst").alias("dst"))

    def communities(self, user_id: str, org_id: str) -> DataFrame:
        ents, rels = self.scope(user_id, org_id)
        return graph.communities(rels, ents, "user_id").orderBy(F.desc("size"), F.lower("hub"), "community")

    def walk(self, names: list[str], user_id: str, org_id: str, limit: int = 15) -> DataFrame:
        _, rels = self.scope(user_id, org_id)
        seeds = self._ids(names, user_id, org_id)
        if not seeds:
            return self.spark.createDataFrame([], "node string, score double")
        return graph.pagerank(rels, seeds, self.cfg.walk_alpha, self.cfg.walk_iterations).orderBy(F.desc("score"), "node").limit(limit)

    def differences(self, a: str, b: str, org_id: str) -> DataFrame:
        return graph.belief_diff(self._beliefs([a, b], org_id), a, b)

    def shared(self, users: list[str], org_id: str) -> DataFrame:
        return graph.shared_beliefs(self._beliefs(users, org_id), users)

    def _beliefs(self, users: list[str], org_id: str) -> DataFrame:
        out = None
        for u in users:
            r = self.scope(u, org_id)[1].select("user_id", "src", "label", "dst")
            out = r if out is None else out.unionByName(r)
        return out

    def cypher(self, user_id: str, org_id: str) -> DataFrame:
        ents, rels = self.scope(user_id, org_id)
        return export.cypher(ents, rels)

    # upkeep

    def health(self) -> DataFrame:
        return self.store.statistics()

    def doctor(self) -> DataFrame:
        """(chunks, vector_lengths): more than one length means that vectors need to be made anew."""
        return self.store.read("chunks").agg(F.count("*").alias("chunks"), F.count_distinct(F.size("embedding")).alias("vector_lengths"))

    def reindex(self) -> None:
        self.store.write("chunks", ingest.reindex(self.store.read("chunks"), vectors.DIM))

    def sleep(self, now_ms: int | None = None) -> None:
        """Upkeep between sessions: merge entities that are one, forget what is past its time to live (if told the
        time), and weigh records anew."""
        if now_ms is not None:
            before = self.memories()
            late = memory.sweep(before, now_ms).where("is_forgotten and forget_reason = 'expired'").select("subject_key", "memory")
            self.store.append("forgotten", cut(late.join(self.store.read("forgotten").select("subject_key", "memory"), ["subject_key", "memory"], "left_anti")).withColumn("reason", F.lit("expired")))
        ents = self.store.read("entities")
        typed = self.edges().where(F.col("label") != "mentions")
        merges = resolve.dedupe(ents, graph.degrees(typed))
        merges = cut(merges)
        m = merges.select("loser", "winner")
        ev = self._events()
        for end in ("src", "dst"):
            ev = ev.join(m.select(F.col("loser").alias(end), F.col("winner").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        self.store.write("edge_events", ev.select(*self._events().columns))
        self.store.delete("entities", m.select(F.col("loser").alias("id")), "id")
        self.store.write("records", memory.reweigh(self.store.read("records"), self.edges()))

    def statistics(self, user_id: str, org_id: str) -> DataFrame:
        """(entities, typed, generic) of what the user sees."""
        ents, rels = self.scope(user_id, org_id)
        links = rels.select(F.when(F.col("label") == GENERIC, "generic").otherwise("typed").alias("what"))
        every = links.unionByName(ents.select(F.lit("entities").alias("what")))
        return every.agg(*[F.count_if(F.col("what") == w).alias(w) for w in ("entities", "typed", "generic")])


def graph_slug(name: str) -> str:
    from quillgraph.functions.extraction import slug

    return slug(name)
