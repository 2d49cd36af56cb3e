"""From documents to tables: records, grants, chunks with vectors, entities, edges and facts, all in one plan each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.config import Config
from quillgraph.functions import text as T
from quillgraph.functions import vectors
from quillgraph.functions.chunking import chunk_text
from quillgraph.functions.extraction import extract_knowledge
from quillgraph.operators.facts import is_typed


def accepted(docs: DataFrame, cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Documents of an acceptable size, cleaned, and those that are too large. docs: record_id, org_id, record_name,
    text, seq, and optionally owner_id, permitted_principals, share_with_org, virtual_record_id, mime_type."""
    have = set(docs.columns)
    for name, kind in (("owner_id", "string"), ("permitted_principals", "array<string>"), ("share_with_org", "string"), ("virtual_record_id", "string"), ("mime_type", "string"), ("origin", "string"), ("connector_id", "string"), ("created_at", "long")):
        if name not in have:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    docs = docs.withColumn("virtual_record_id", F.coalesce("virtual_record_id", "record_id")).withColumn("origin", F.coalesce("origin", F.lit("UPLOAD"))).withColumn("mime_type", F.coalesce("mime_type", F.lit("text/plain")))
    ok = T.within_size(F.coalesce("text", F.lit("")), cfg.max_document_bytes)
    clean = docs.where(ok).withColumn("text", T.sanitize(F.col("text"))).withColumn("record_name", T.label(F.col("record_name")))
    return clean, docs.where(~ok)


def records(docs: DataFrame, extracted: DataFrame) -> DataFrame:
    n = extracted.select("record_id", F.size(F.filter("relations", lambda r: r["type"] != "relates_to")).alias("typed"), F.size("entities").alias("ents"))
    d = docs.join(n, "record_id", "left")
    base = T.importance(F.coalesce("typed", F.lit(0)), F.coalesce("ents", F.lit(0)), F.lit(0), F.col("text"))
    return d.select(
        "record_id", "virtual_record_id", "org_id", "record_name", "mime_type", "connector_id", F.col("connector_id").alias("connector_name"), "origin", F.lit("COMPLETED").alias("indexing_status"), "owner_id", "created_at",
        base.alias("importance"), base.alias("importance_base"), F.col("created_at").alias("last_accessed_at"), F.lit(0).cast("long").alias("access_count"),
    )


def chunks(docs: DataFrame, cfg: Config = Config(), embedder: Callable[..., Column] = vectors.hash_embedding) -> DataFrame:
    """A record's chunks replace all it had before. embedder: a UDF from a text column to vectors."""
    return pieces(docs, cfg).withColumn("embedding", embedder("content"))


def pieces(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Chunks without their vectors."""
    cut = docs.select("record_id", "virtual_record_id", "org_id", F.posexplode(chunk_text(F.col("text"), cfg.chunk_size, cfg.min_chunk, strip=True)).alias("i", "content"))
    return cut.select(F.concat_ws("#", "record_id", "i").alias("point_id"), "virtual_record_id", "org_id", "content")


def grants(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Permission edges (src, dst, label) and open shares (id, coll, org_id, file_key)."""
    who = F.array_distinct(F.array_compact(F.concat(F.coalesce("permitted_principals", F.array().cast("array<string>")), F.array("owner_id"))))
    edges = docs.select(F.explode(who).alias("src"), F.col("record_id").alias("dst"), F.lit("permissions").alias("label"))
    shared = docs.where("share_with_org is not null").select(F.concat(F.lit("anyone:"), "record_id").alias("id"), F.lit("anyone").alias("coll"), F.col("share_with_org").alias("org_id"), F.col("record_id").alias("file_key"))
    return edges, shared


def extraction(docs: DataFrame) -> DataFrame:
    return docs.select("record_id", "seq", extract_knowledge("text").alias("k")).select("record_id", "seq", "k.entities", "k.relations")


KNOWLEDGE = ("array<struct<id:string,label:string,type:string>>", "array<struct<from:string,to:string,type:string,confidence:double>>")


def with_given(extracted: DataFrame, given: DataFrame) -> DataFrame:
    """extracted, with graphs that came with records (record_id, entities, relations) before what was found in texts."""
    g = given.select("record_id", F.col("entities").cast(KNOWLEDGE[0]).alias("own_e"), F.col("relations").cast(KNOWLEDGE[1]).alias("own_r"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    j = extracted.join(g, "record_id", "left").withColumn("every", F.concat(none(F.col("own_e"), KNOWLEDGE[0]), F.col("entities").cast(KNOWLEDGE[0])))
    once = F.filter("every", lambda e, i: F.array_position(F.transform("every", lambda x: x["id"]), e["id"]) == i + 1)
    return j.select("record_id", "seq", once.alias("entities"), F.concat(none(F.col("own_r"), KNOWLEDGE[1]), F.col("relations").cast(KNOWLEDGE[1])).alias("relations"))


def graph_events(extracted: DataFrame, canonical: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities (id, label, type, seq) and edge events; canonical (id, canonical) renames entities."""
    ents = extracted.select("record_id", "seq", F.explode("entities").alias("e")).select("record_id", "seq", F.concat(F.lit(T.ENTITY), "e.id").alias("id"), "e.label", "e.type")
    rels = extracted.select("record_id", "seq", F.explode("relations").alias("r")).select("record_id", "seq", F.concat(F.lit(T.ENTITY), "r.from").alias("src"), F.concat(F.lit(T.ENTITY), "r.to").alias("dst"), F.col("r.type").alias("label"), F.col("r.confidence").alias("confidence"))
    if canonical is not None:
        c = canonical.select("id", "canonical")
        ents = ents.join(c, "id", "left").withColumn("id", F.coalesce("canonical", "id")).drop("canonical")
        for end in ("src", "dst"):
            rels = rels.join(c.withColumnsRenamed({"id": end, "canonical": "to"}), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    event = lambda df: df.select("seq", F.col("seq").alias("ts"), F.lit("assert").alias("op"), "src", "dst", "label", F.lit(1.0).alias("weight"), F.lit(None).cast("long").alias("valid_at"), "confidence", "record_id")
    mentions = ents.select("seq", "record_id", F.col("record_id").alias("src"), F.col("id").alias("dst"), F.lit("mentions").alias("label"), F.lit(None).cast("double").alias("confidence")).distinct()
    nodes = ents.groupBy("id").agg(F.min_by(F.struct("label", "type"), "seq").alias("n"), F.min("seq").alias("seq")).select("id", "n.label", "n.type", "seq")
    return nodes, event(mentions).unionByName(event(rels.where("src != dst")))


def united_entities(first: DataFrame, second: DataFrame, *order: Column) -> DataFrame:
    """Entities (record_id, id, ...) of two extractors: of equal ids the first extractor's counts, then the given order."""
    return _first_wins(first, second, ["record_id", "id"], order)


def united_relations(first: DataFrame, second: DataFrame, *order: Column) -> DataFrame:
    """Relations (record_id, src, dst, label, ...) of two extractors: whichever way round, the first extractor's counts."""
    ends = lambda df: df.withColumns({"_low": F.least("src", "dst"), "_high": F.greatest("src", "dst")})
    return _first_wins(ends(first), ends(second), ["record_id", "_low", "_high", "label"], order).drop("_low", "_high")


def _first_wins(first: DataFrame, second: DataFrame, key: list[str], order: tuple[Column, ...]) -> DataFrame:
    rest = [c for c in first.columns if c not in key]
    both = first.withColumn("_from", F.lit(0)).unionByName(second.withColumn("_from", F.lit(1)))
    return both.groupBy(*key).agg(F.min_by(F.struct(*rest) if rest else F.lit(0), F.struct("_from", *order)).alias("_x")).select(*key, *(["_x.*"] if rest else [])).select(*first.columns)


def facts(extracted: DataFrame, docs: DataFrame) -> DataFrame:
    """Typed relations as facts for the memory layer; numbers run over records in order."""
    names = extracted.select("record_id", F.map_from_entries(F.transform("entities", lambda e: F.struct(e["id"], e["label"]))).alias("names"))
    rows = extracted.select("record_id", "seq", F.posexplode("relations").alias("i", "r")).where(is_typed(F.col("r.type"))).join(names, "record_id").join(docs.select("record_id", "virtual_record_id", "org_id", "created_at"), "record_id")
    return rows.select((F.col("seq") * 10_000 + F.col("i")).alias("seq"), F.coalesce("created_at", "seq").alias("ts"), F.try_element_at("names", "r.from").alias("subject"), F.col("r.type").alias("predicate"), F.try_element_at("names", "r.to").alias("object"), F.col("r.confidence").alias("confidence"), "virtual_record_id", "record_id", "org_id")


def reindex(chunk_table: DataFrame, dim: int) -> DataFrame:
    """Chunks whose vectors have another length get new ones; the others keep theirs."""
    stale = F.coalesce(F.size("embedding") != dim, F.lit(True))
    return chunk_table.withColumn("embedding", F.when(stale, vectors.hash_embedding(F.when(stale, F.col("content")))).otherwise(F.col("embedding")))


def touch(record_table: DataFrame, accesses: DataFrame) -> DataFrame:
    """Records with an access log (record_id, ts) folded in."""
    a = accesses.groupBy("record_id").agg(F.count("*").alias("more"), F.max("ts").alias("at"))
    return record_table.join(a, "record_id", "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("more", F.lit(0))).withColumn("last_accessed_at", F.greatest("last_accessed_at", "at")).drop("more", "at")


def latest_documents(docs: DataFrame) -> DataFrame:
    """The last ingest of each record."""
    w = Window.partitionBy("record_id").orderBy(F.desc("seq"))
    return docs.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
