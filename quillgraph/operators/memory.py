"""Versioned memories: facts consolidated from assertions, episodes and procedures, and questions about them over time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quillgraph import schemas
from quillgraph.config import FUNCTIONAL, GENERIC, PERMANENT, Config
from quillgraph.functions import scores, vectors
from quillgraph.functions import text as T
from quillgraph.operators import ranking
from quillgraph.operators.facts import is_typed
from quillgraph.operators.lineage import cut

OPPOSITES = dict(x.split(":") for x in "agrees_with:disagrees_with allows:forbids approves:rejects enables:blocks includes:excludes likes:dislikes loves:hates prefers:avoids recommends:discourages supports:opposes trusts:distrusts".split())
OPPOSITES |= {v: k for k, v in OPPOSITES.items()}
DENIALS = "not_|no_longer_|never_|stopped_|does_not_|doesnt_|did_not_|didnt_|is_not_|isnt_|un"


def opposite_predicates(spark, predicates: DataFrame) -> DataFrame:
    """predicates (predicate) with those that contradict them (opposite): antonyms, and the other polarity."""
    table = F.create_map(*[F.lit(x) for kv in sorted(OPPOSITES.items()) for x in kv])
    denied = F.col("predicate").rlike(f"^({DENIALS})")
    base = F.regexp_replace("predicate", f"^({DENIALS})", "")
    both = F.when(denied, F.array(base)).otherwise(F.array(F.concat(F.lit("not_"), base), F.concat(F.lit("no_longer_"), base)))
    every = F.array_compact(F.concat(both, F.array(F.try_element_at(table, base))))
    return predicates.select("predicate", F.explode(F.array_distinct(every)).alias("opposite")).where("predicate != opposite")


def keyed_facts(facts: DataFrame) -> DataFrame:
    """facts (seq, ts, subject, predicate, object, confidence, virtual_record_id, record_id, org_id) with subject_key, text and flags."""
    p = T.predicate(F.coalesce(F.nullif("predicate", F.lit("")), F.lit(GENERIC)))
    f = facts.where("trim(subject) != '' and trim(object) != ''").withColumn("predicate", p)
    s, o = T.entity_id(F.trim("subject")), T.entity_id(F.trim("object"))
    f = f.withColumn("functional", F.col("predicate").isin(*FUNCTIONAL)).withColumn("is_static", F.col("predicate").isin(*PERMANENT))
    return f.select(
        "*",
        s.alias("subject_id"),
        o.alias("object_id"),
        F.when(F.col("functional"), F.concat_ws("|", s, "predicate")).otherwise(F.concat_ws("|", s, "predicate", o)).alias("subject_key"),
        F.concat_ws(" ", F.trim("subject"), F.replace("predicate", F.lit("_"), F.lit(" ")), F.trim("object")).alias("memory"),
    )


def consolidate(facts: DataFrame, visible: DataFrame | None = None, subject: str | None = None) -> DataFrame:
    """Memories from facts in order of seq.

    A new value of a functional subject supersedes the one before it unless it is less certain; an equal one only
    refreshes it; contradicting predicates about the same subject and object retire each other. A writer's record
    touches only what the writer sees: visible (writer_record, virtual_record_id); without it all is visible. With a
    subject (an entity id) only its facts are folded; those of others don't touch them.

    The fold is sequential per subject and object group, so groups are those keys that can touch each other: the
    subject and predicate of functional facts, the subject and object of others. Groups of functional facts whose
    certainty never falls are folded many at once, the others row by row.
    """
    f = keyed_facts(facts)
    if subject is not None:
        f = f.where(F.col("subject_id") == subject)
    group = F.when(F.col("functional"), F.col("subject_key")).otherwise(F.concat_ws("|", F.lit("pair"), "subject_id", "object_id"))
    f = f.withColumn("fold", group)
    if visible is not None:
        sees = visible.groupBy("writer_record").agg(F.collect_set("virtual_record_id").alias("sees"))
        f = f.join(sees, f["record_id"] == sees["writer_record"], "left").drop("writer_record")
    else:
        f = f.withColumn("sees", F.lit(None).cast("array<string>"))
    opposite = {p: [o for o in (OPPOSITES.get(p),) if o] for p in OPPOSITES}

    def against(p: str) -> list[str]:
        import re

        base = re.sub(f"^({DENIALS})", "", p)
        out = opposite.get(base, []) + ([base] if base != p else [f"not_{base}", f"no_longer_{base}"])
        return [x for x in out if x != p]

    def step(rows: list[dict], x: dict) -> None:
        """One assertion, upon the memories of its fold so far."""
        sees = None if x["sees"] is None else {*x["sees"], x["virtual_record_id"]}

        def current(key: str) -> dict | None:
            mine = [r for r in rows if r["subject_key"] == key and r["is_latest"] and not r["is_forgotten"] and (sees is None or r["virtual_record_id"] in sees)]
            return max(mine, key=lambda r: (r["version"], r["created_at"]), default=None)

        sure = 1.0 if pd.isna(x["confidence"]) else x["confidence"]
        if not x["functional"]:
            for p in against(x["predicate"]):
                old = current(f"{x['subject_id']}|{p}|{x['object_id']}")
                if old:
                    old |= {"is_forgotten": True, "forget_reason": f'contradicted by "{x["memory"]}"', "updated_at": x["ts"]}
        now = current(x["subject_key"])
        if now and now["memory"] == x["memory"]:
            now["updated_at"] = x["ts"]
            return
        if now and x["functional"]:
            if sure + 1e-9 < now["confidence"]:
                return
            now["is_latest"] = False
        new = now if now and x["functional"] else None
        own = f"mem:{x['seq']}"
        rows.append({
            "id": own, "org_id": x["org_id"], "virtual_record_id": x["virtual_record_id"], "subject_key": x["subject_key"], "memory": x["memory"], "is_static": x["is_static"], "is_forgotten": False,
            "forget_after": None, "forget_reason": None, "version": new["version"] + 1 if new else 1, "parent_id": new["id"] if new else None, "root_id": new["root_id"] if new else own, "is_latest": True,
            "relation": "updates" if new else None, "source_record_id": x["record_id"], "created_at": x["ts"], "updated_at": x["ts"], "use_count": 0, "last_used_at": None, "kind": "semantic", "occurred_at": None, "actor_ids": [], "confidence": sure,
        })

    schema = to_arrow_schema(_parse_datatype_string(schemas.MEMORIES))

    def out(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema)

    def at_once(t: pa.RecordBatch, start: np.ndarray) -> pa.RecordBatch:
        """Whole groups, from start on each, of functional facts whose certainty never falls: versions are runs of equal memories."""
        said = pc.dictionary_encode(t.column("memory")).indices.to_numpy()
        new = np.concatenate([[True], said[1:] != said[:-1]])
        new[start] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], t.num_rows) - 1
        heads = np.flatnonzero(np.isin(first, start))
        size = np.diff(np.append(heads, len(first)))
        version = np.arange(len(first)) - np.repeat(heads, size) + 1
        rows = t.take(pa.array(first))
        own = pc.binary_join_element_wise("mem:", rows.column("seq").cast(pa.string()), "")
        later, n = version > 1, len(first)
        ends = np.zeros(n, bool)
        ends[heads + size - 1] = True
        given = {
            "id": own, "version": pa.array(version.astype(np.int32)), "parent_id": own.take(pa.array(np.where(later, np.arange(n) - 1, 0), mask=~later)), "root_id": own.take(pa.array(np.repeat(heads, size))), "is_latest": pa.array(ends), "is_forgotten": pa.array(np.zeros(n, bool)),
            "relation": pa.array(["updates"]).take(pa.array(np.zeros(n, int), mask=~later)), "source_record_id": rows.column("record_id"), "created_at": rows.column("ts"), "updated_at": t.column("ts").take(pa.array(last)), "use_count": pa.array(np.zeros(n, int)),
            "kind": pa.array(["semantic"]).take(pa.array(np.zeros(n, int))), "actor_ids": pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.string())), "confidence": pc.fill_null(rows.column("confidence"), 1.0),
        }
        columns = [given[f.name] if f.name in given else rows.column(f.name) if f.name in t.schema.names else pa.nulls(n, f.type) for f in schema]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted. A group at a batch's edge is held as its memories so far; those inside are whole."""
        rows, key = [], None
        for t in batches:
            if not t.num_rows:
                continue
            place = pc.run_end_encode(t.column("fold")).run_ends.to_numpy()
            keys, start = t.column("fold").take(pa.array(place - 1)).to_pylist(), np.append(0, place[:-1])
            group = np.repeat(np.arange(len(place)), place - start)
            sure = pc.fill_null(t.column("confidence"), 1.0).to_numpy(zero_copy_only=False)
            falls = np.append(False, (sure[1:] < sure[:-1]) & (group[1:] == group[:-1]))
            odd = falls | np.isnan(sure) | ~t.column("functional").to_numpy(zero_copy_only=False) | t.column("sees").is_valid().to_numpy(zero_copy_only=False)
            single = np.bincount(group, weights=odd) > 0
            single[[0, -1]] = True
            if not single.all():
                inside = ~single
                yield at_once(t.filter(pa.array(inside[group])), np.append(0, np.cumsum((place - start)[inside])[:-1]))
            done = []
            for g in np.flatnonzero(single):
                if keys[g] != key:
                    done.extend(rows)
                    rows, key = [], keys[g]
                for x in t.slice(start[g], place[g] - start[g]).to_pylist():
                    step(rows, x)
            if done:
                yield out(done)
        if rows:
            yield out(rows)

    f = f.select("fold", "seq", "ts", "org_id", "virtual_record_id", "record_id", "subject_key", "subject_id", "object_id", "predicate", "memory", F.col("confidence").cast("double").alias("confidence"), "functional", "is_static", "sees")
    return f.repartition("fold").sortWithinPartitions("fold", "seq").mapInArrow(fold, schemas.MEMORIES)


def consolidate_windows(facts: DataFrame) -> DataFrame:
    """The same for facts whose confidence never falls and that contradict nothing, without Python: runs of equal
    values collapse, versions count them. (subject_key, memory, version, is_latest, created_at, updated_at)."""
    f = keyed_facts(facts).where("functional")
    w = Window.partitionBy("subject_key").orderBy("seq")
    run = f.withColumn("new", (F.coalesce(F.lag("memory").over(w), F.lit("")) != F.col("memory")).cast("int")).withColumn("version", F.sum("new").over(w))
    one = run.groupBy("subject_key", "version").agg(F.first("memory").alias("memory"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
    last = F.max("version").over(Window.partitionBy("subject_key"))
    return one.select("subject_key", "memory", F.col("version").cast("int").alias("version"), (F.col("version") == last).alias("is_latest"), "created_at", "updated_at")


def record_episodes(episodes: DataFrame, now_ms: int, ttl_ms: int | None = None) -> DataFrame:
    """Memories of episodes (org_id, virtual_record_id, record_id, event, occurred_at string, actor_ids), each event of a
    day once per virtual record."""
    at = scores.when_ms(F.col("occurred_at"), now_ms)
    rows = episodes.where("trim(event) != ''").select("org_id", "virtual_record_id", "record_id", F.trim("event").alias("memory"), at.alias("occurred_at"), F.coalesce("actor_ids", F.array().cast("array<string>")).alias("actor_ids"))
    rows = rows.withColumn("subject_key", F.concat_ws("|", F.lit("episode"), F.date_format(F.timestamp_millis("occurred_at"), "yyyy-MM-dd"), F.substring(T.slugify(F.col("memory")), 1, 48)))
    one = rows.groupBy("virtual_record_id", "subject_key").agg(F.min_by(F.struct("org_id", "record_id", "memory", "occurred_at", "actor_ids"), F.struct("occurred_at", "memory")).alias("e")).select("virtual_record_id", "subject_key", "e.*")
    return as_memories(one, "episodic", now_ms, ttl_ms)


def record_procedures(procedures: DataFrame, now_ms: int) -> DataFrame:
    """Memories of procedures (seq, org_id, virtual_record_id, record_id, trigger, action); a new action for a trigger is
    a new version."""
    t, a = F.trim(F.coalesce("trigger", F.lit(""))), F.trim("action")
    rows = procedures.where("trim(action) != ''").select("seq", "org_id", "virtual_record_id", "record_id", F.concat(F.lit("procedure|"), F.substring(T.slugify(t), 1, 64)).alias("subject_key"), F.when(t != "", F.concat(F.lit("When "), t, F.lit(": "), a)).otherwise(a).alias("memory"))
    w = Window.partitionBy("subject_key").orderBy("seq")
    runs = rows.withColumn("new", (F.coalesce(F.lag("memory").over(w), F.lit("")) != F.col("memory")).cast("int")).withColumn("version", F.sum("new").over(w))
    one = runs.groupBy("subject_key", "version").agg(F.min_by(F.struct("org_id", "virtual_record_id", "record_id", "memory"), "seq").alias("p")).select("subject_key", "version", "p.*")
    return as_memories(one, "procedural", now_ms, None)


def as_memories(rows: DataFrame, kind: str, now_ms: int, ttl_ms: int | None) -> DataFrame:
    have = set(rows.columns)
    version = F.col("version").cast("int") if "version" in have else F.lit(1)
    rows = rows.withColumn("version", version)
    last = F.max("version").over(Window.partitionBy("subject_key", *([] if kind == "procedural" else ["virtual_record_id"])))
    key = F.concat_ws("|", F.lit(kind[:4]), "virtual_record_id", "subject_key") if kind == "episodic" else F.concat_ws("|", F.lit(kind[:4]), "subject_key")
    given = {
        "id": F.concat_ws("#", key, "version"), "is_static": F.lit(False), "is_forgotten": F.lit(False), "forget_after": F.lit(now_ms + ttl_ms if ttl_ms else None), "forget_reason": F.lit(None), "parent_id": F.when(F.col("version") > 1, F.concat_ws("#", key, F.col("version") - 1)),
        "root_id": F.concat_ws("#", key, F.lit(1)), "is_latest": F.col("version") == last, "relation": F.when(F.col("version") > 1, "updates"), "source_record_id": F.col("record_id"), "created_at": F.lit(now_ms), "updated_at": F.lit(now_ms), "use_count": F.lit(0), "last_used_at": F.lit(None),
        "kind": F.lit(kind), "occurred_at": F.col("occurred_at") if "occurred_at" in have else F.lit(None), "actor_ids": F.col("actor_ids") if "actor_ids" in have else F.array(), "confidence": F.lit(1.0),
    }
    fields = [x.split() for x in schemas.MEMORIES.split(", ")]
    return rows.select(*[given.get(n, F.col(n) if n in have or n == "version" else F.lit(None)).cast(t).alias(n) for n, t in fields])


def current(memories: DataFrame, now_ms: int, kind: str | None = "semantic") -> DataFrame:
    """Latest, not forgotten, within its time to live."""
    m = memories.where("is_latest and not is_forgotten").where(F.col("forget_after").isNull() | F.col("is_static") | (F.col("forget_after") > now_ms))
    return m.where(F.col("kind") == kind) if kind else m


def sweep(memories: DataFrame, now_ms: int) -> DataFrame:
    """Memories past their time to live are forgotten, unless they are static."""
    late = ~F.col("is_static") & ~F.col("is_forgotten") & (F.col("forget_after") <= now_ms)
    late = F.coalesce(late, F.lit(False))
    return memories.withColumn("forget_reason", F.when(late, "expired").otherwise(F.col("forget_reason"))).withColumn("is_forgotten", F.col("is_forgotten") | late)


def strength(now_ms: int, cfg: Config = Config()):
    return scores.memory_strength(now_ms, F.col("last_used_at"), F.col("updated_at"), F.col("use_count"), F.col("confidence"), cfg.memory_half_life_days)


def recall(memories: DataFrame, queries: DataFrame, acl: DataFrame, now_ms: int, kind: str = "semantic", limit: int = 8, cfg: Config = Config()) -> DataFrame:
    """(query_id, id, memory, similarity, rank) of current memories that the asking user may see.

    memories carry an embedding; queries: query_id, user_id, vector. Facts go by similarity, then strength; episodes by
    similarity and recency above a floor; procedures by similarity above a floor.
    """
    m = current(memories, now_ms, kind).withColumn("strength", strength(now_ms, cfg))
    users = acl.join(queries.select("user_id").distinct(), "user_id", "left_semi").groupBy("virtual_record_id").agg(F.collect_set("user_id").alias("users"))
    m = m.join(users, "virtual_record_id").withColumn("recency", scores.episode_score(now_ms, F.lit(0.0), F.coalesce("occurred_at", "created_at"), cfg.episode_half_life_days) if kind == "episodic" else F.lit(0.0))
    if kind == "semantic":
        carry, how = (("strength", "descending"), ("updated_at", "descending"), ("memory", None)), {}
        order = [F.desc(F.round("score", 9)), F.desc("strength"), F.desc("updated_at"), F.col("id")]
    else:
        carry, how = (("recency", None), ("memory", None)), {"weight": 0.7 if kind == "episodic" else 1.0, "bonus": "recency", "floor": cfg.episode_floor}
        order = [F.desc(F.round(F.lit(how["weight"]) * F.col("score") + F.col("recency"), 9)), F.col("id")]
    source = m.select("id", F.col("embedding").cast("array<double>"), "users", *[c for c, _ in carry])
    rows = ranking.nearest(source, queries, limit, "id", True, carry, True, **how)
    if rows is None:
        return memories.sparkSession.createDataFrame([], f"query_id string, id {memories.schema['id'].dataType.simpleString()}, memory string, similarity double, rank int")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= limit).select("query_id", "id", "memory", F.col("score").alias("similarity"), "rank")


def reinforce(memories: DataFrame, uses: DataFrame) -> DataFrame:
    """Memories with their recalls (id, ts) folded in."""
    u = uses.groupBy("id").agg(F.count("*").alias("more"), F.max("ts").alias("at"))
    return memories.join(u, "id", "left").withColumn("use_count", F.col("use_count") + F.coalesce("more", F.lit(0))).withColumn("last_used_at", F.greatest("last_used_at", "at")).drop("more", "at")


def forget(memories: DataFrame, acl: DataFrame, user_id: str, phrase: str, vector: list[float] | None = None, reason: str = "forgotten by user", cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Memories in which what the user named is forgotten, and the edges (src, label, dst) that expire with it."""
    mine = acl.where(F.col("user_id") == user_id).select("virtual_record_id", F.lit(True).alias("mine")).distinct()
    m = memories.join(mine, "virtual_record_id", "left")
    hit = F.contains(F.lower("memory"), F.lit(phrase.strip().lower()))
    if vector is not None:
        hit = hit | (vectors.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector])) >= cfg.forget_floor)
    hit = F.coalesce(F.col("mine") & F.col("is_latest") & ~F.col("is_forgotten") & (F.col("kind") == "semantic") & hit, F.lit(False))
    done = m.withColumn("hit", hit)
    parts = F.split("subject_key", "\\|")
    expired = done.where("hit").select(parts[0].alias("src"), F.try_element_at(parts, F.lit(2)).alias("label"), F.try_element_at(parts, F.lit(3)).alias("dst"))
    out = done.withColumn("forget_reason", F.when(F.col("hit"), reason).otherwise(F.col("forget_reason"))).withColumn("is_forgotten", F.col("is_forgotten") | F.col("hit")).drop("hit", "mine")
    return out, expired


def as_of(memories: DataFrame, t: int) -> DataFrame:
    """Per subject the facts that were current at t; ties are all given."""
    then = memories.where((F.col("kind") == "semantic") & (F.col("created_at") <= t))
    ranked = then.withColumn("r", F.rank().over(Window.partitionBy("subject_key").orderBy(F.desc("created_at"))))
    return ranked.where("r = 1").drop("r")


def history(memories: DataFrame) -> DataFrame:
    """Versions of each chain, with the memory before and whether it still holds."""
    w = Window.partitionBy("root_id").orderBy("version")
    return memories.where("kind = 'semantic'").select("root_id", "version", "memory", F.lag("memory").over(w).alias("before"), "is_latest", "is_forgotten")


def timeline(memories: DataFrame, subject: str) -> DataFrame:
    """(at, kind, text, version, superseded) of an entity id: its facts and the episodes that it took part in."""
    facts = memories.where((F.col("kind") == "semantic") & F.startswith("subject_key", F.lit(subject + "|"))).select(F.col("created_at").alias("at"), F.lit("fact").alias("kind"), F.col("memory").alias("text"), "version", (~F.col("is_latest") | F.col("is_forgotten")).alias("superseded"))
    episodes = memories.where((F.col("kind") == "episodic") & ~F.col("is_forgotten") & F.array_contains("actor_ids", subject)).select(F.coalesce("occurred_at", "created_at").alias("at"), F.lit("episode").alias("kind"), F.col("memory").alias("text"), F.lit(1).alias("version"), F.lit(False).alias("superseded"))
    return facts.unionByName(episodes).orderBy("at", "kind", "text")


def profile(memories: DataFrame, related: DataFrame, subject: str, now_ms: int) -> DataFrame:
    """(section, rank, text): static facts, recent ones, and up to ten related names (to, rank)."""
    mine = current(memories, now_ms).where(F.startswith("subject_key", F.lit(subject + "|")))
    facts = mine.select(F.when(F.col("is_static"), "static").otherwise("recent").alias("section"), F.row_number().over(Window.partitionBy("is_static").orderBy(F.desc("updated_at"), "memory")).alias("rank"), F.col("memory").alias("text"))
    return facts.unionByName(related.where("rank <= 10").select(F.lit("related").alias("section"), "rank", F.col("to").alias("text")))


def revisions(memories: DataFrame) -> DataFrame:
    """(kind, before, after): updates of functional facts, and contradictions, matched by the reason they left."""
    memories = cut(memories.select("id", "parent_id", "memory", "is_forgotten", "forget_reason"))  # four tables are made of them
    new = memories.select(F.col("id").alias("new_id"), F.col("memory").alias("after"), "parent_id")
    updates = memories.select(F.col("id").alias("parent_id"), F.col("memory").alias("before")).join(new, "parent_id").select(F.lit("updated").alias("kind"), "before", "after")
    gone = memories.where("is_forgotten").select(F.col("memory").alias("before"), "forget_reason")
    by = memories.select(F.col("memory").alias("after"), F.concat(F.lit('contradicted by "'), "memory", F.lit('"')).alias("forget_reason")).distinct()
    return updates.unionByName(gone.join(by, "forget_reason").select(F.lit("contradicted").alias("kind"), "before", "after"))


def reflect(memories: DataFrame, relations: DataFrame, entities: DataFrame, now_ms: int, limit: int = 8) -> DataFrame:
    """(category, rank, text): what keeps coming up, what changed, preferences, and what happened last."""
    from quillgraph.operators.graph import degrees

    d = degrees(relations).where("degree >= 2").join(entities.select(F.col("id").alias("node"), F.col("label").alias("name")), "node", "left").withColumn("name", F.coalesce("name", "node"))
    w = lambda *c: F.row_number().over(Window.orderBy(*c))
    focus = d.orderBy(F.desc("degree"), "node").limit(3).select(F.lit(0).alias("s"), F.lit("focus").alias("category"), w(F.desc("degree"), "node").alias("rank"), F.concat("name", F.lit(" ("), "degree", F.lit(" connections)")).alias("text"))
    chains = memories.where("kind = 'semantic'").groupBy("root_id").agg(F.min_by("memory", "version").alias("a"), F.max_by("memory", "version").alias("b"), F.count("*").alias("n"), F.bool_or(F.col("is_latest") & ~F.col("is_forgotten")).alias("live")).where("n > 1 and live")
    change = chains.orderBy("root_id").limit(5).select(F.lit(1).alias("s"), F.lit("change").alias("category"), w("root_id").alias("rank"), F.concat_ws(" → ", "a", "b").alias("text"))
    liked = current(memories, now_ms, "procedural").orderBy(F.desc("updated_at"), "id").limit(3).select(F.lit(2).alias("s"), F.lit("preference").alias("category"), w(F.desc("updated_at"), "id").alias("rank"), F.col("memory").alias("text"))
    recent = current(memories, now_ms, "episodic").orderBy(F.desc("occurred_at"), "id").limit(3).select(F.lit(3).alias("s"), F.lit("recent").alias("category"), w(F.desc("occurred_at"), "id").alias("rank"), F.col("memory").alias("text"))
    return focus.unionByName(change).unionByName(liked).unionByName(recent).orderBy("s", "rank").limit(limit).drop("s")


def facts_from_edges(edges: DataFrame, org_id: str = "default") -> DataFrame:
    """Facts of all live typed edges, for rebuilding memories."""
    live = edges.where(is_typed(F.col("label")) & F.col("expired_at").isNull())
    name = lambda c: F.regexp_replace(c, f"^{T.ENTITY}", "")
    record = F.try_element_at("provenance", F.lit(1))
    return live.select(F.xxhash64("src", "label", "dst").alias("seq"), F.col("created_at").alias("ts"), name("src").alias("subject"), F.col("label").alias("predicate"), name("dst").alias("object"), "confidence", record.alias("virtual_record_id"), record.alias("record_id"), F.lit(org_id).alias("org_id"))


def reweigh(records: DataFrame, edges: DataFrame) -> DataFrame:
    """Records with importance raised by mentions of entities that other records mention too."""
    m = edges.where("label = 'mentions'").select(F.col("src").alias("record_id"), "dst")
    common = m.groupBy("dst").agg(F.count("*").alias("c")).where("c >= 2").select("dst")
    n = m.join(common, "dst", "left_semi").groupBy("record_id").agg(F.count("*").alias("n"))
    new = F.round(F.greatest(F.lit(0.5), F.least(F.lit(3.0), F.coalesce("importance_base", F.lit(1.0)) + F.least(F.lit(0.5), 0.05 * F.coalesce("n", F.lit(0))))), 3)
    return records.join(n, "record_id", "left").withColumn("importance", new).drop("n")


def counts(memories: DataFrame) -> DataFrame:
    return memories.groupBy("kind").agg(F.count("*").alias("total"), F.count_if(F.col("is_latest") & ~F.col("is_forgotten")).alias("current"), F.count_if("is_forgotten").alias("forgotten"))
