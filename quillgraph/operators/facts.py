"""Mutable graph state as a fold over events: asserts, supersession, expiry, and records that are replaced.

Events: seq, ts, op ('assert', 'expire', 'clear'), src, dst, label, weight, valid_at, confidence, record_id. A clear
takes back all that its record asserted before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.config import FUNCTIONAL, GENERIC, STRUCTURAL


def is_typed(label: Column) -> Column:
    return ~label.isin(*STRUCTURAL, GENERIC)


def is_live(df: DataFrame) -> DataFrame:
    return df.where("expired_at is null")


def fold_edges(events: DataFrame, functional: tuple[str, ...] = FUNCTIONAL) -> DataFrame:
    """(src, dst, label, weight, created_at, valid_at, expired_at, provenance, confidence).

    Weights add up; the first valid_at and the highest confidence stay; provenance holds the records. An edge is
    live if its last event is an assert and, for functional labels, no other value of its subject came later.
    """
    cleared = events.where("op = 'clear'").groupBy("record_id").agg(F.max("seq").alias("cleared"))
    asserts = events.where("op = 'assert'").join(cleared, "record_id", "left").where("cleared is null or seq > cleared").drop("cleared")
    key = ["src", "dst", "label"]
    state = asserts.groupBy(*key).agg(
        F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"),
        F.min("ts").alias("created_at"),
        F.min_by("valid_at", F.struct(F.col("valid_at").isNull(), "seq")).alias("valid_at"),
        F.max("confidence").alias("confidence"),
        F.array_sort(F.collect_set("record_id")).alias("provenance"),
        F.max("seq").alias("last"),
    )
    ended = events.where("op = 'expire'").groupBy("src", "label", F.col("dst")).agg(F.max(F.struct("seq", "ts")).alias("e"))
    one = state.join(ended.where("dst is not null"), key, "left").withColumnRenamed("e", "e1").join(ended.where("dst is null").drop("dst"), ["src", "label"], "left").withColumnRenamed("e", "e2")
    # the assert of another value that follows this edge's last one ends it
    w = Window.partitionBy("src", "label").orderBy("last")
    later = F.when(F.col("label").isin(*functional), F.lead(F.struct(F.col("last").alias("seq"), F.col("last_ts").alias("ts"))).over(w))
    times = asserts.groupBy(*key).agg(F.max_by("ts", "seq").alias("last_ts"))
    one = one.join(times, key).withColumn("e3", later)
    gone = F.least(*[F.when(F.col(f"{e}.seq") > F.col("last"), F.col(f"{e}.ts")) for e in ("e1", "e2", "e3")])
    return one.select(*key, "weight", "created_at", "valid_at", gone.alias("expired_at"), "provenance", "confidence")


def strip_record(edges: DataFrame, record_id: str) -> DataFrame:
    """Edges without a record's contribution: gone if nothing else asserts them, else weighted by what is left."""
    left = F.array_remove("provenance", record_id)
    touched = F.array_contains("provenance", record_id)
    new = edges.select(*[c for c in edges.columns if c not in ("weight", "provenance")], F.when(touched, F.size(left).cast("double")).otherwise(F.col("weight")).alias("weight"), left.alias("provenance"), touched.alias("touched"))
    return new.where(~F.col("touched") | (F.size("provenance") > 0)).select(*edges.columns)


def backfill_provenance(edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """Edges without provenance get the records that mention both ends. mentions: src (record), dst (entity)."""
    bare = edges.where(is_typed(F.col("label")) & (F.size("provenance") == 0)).select("src", "dst", "label")
    a = mentions.select(F.col("src").alias("record_id"), F.col("dst").alias("src"))
    b = mentions.select(F.col("src").alias("record_id"), F.col("dst"))
    found = bare.join(a, "src").join(b, ["record_id", "dst"]).groupBy("src", "dst", "label").agg(F.array_sort(F.collect_set("record_id")).alias("found"))
    return edges.join(found, ["src", "dst", "label"], "left").withColumn("provenance", F.coalesce("found", "provenance")).drop("found")


def latest_nodes(nodes: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last version of each node, aggregated before the shuffle."""
    rest = [c for c in nodes.columns if c not in (key, seq)]
    return nodes.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("n")).select(key, "n.*")


def merge_entities(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges with losers replaced by winners (loser, winner); what then coincides is one edge, live if one was."""
    lost = merges.select(F.col("loser"), F.col("winner"))
    for end in ("src", "dst"):
        m = lost.select(F.col("loser").alias(end), F.col("winner").alias("w"))
        edges = edges.join(m, end, "left").withColumn(end, F.coalesce("w", end)).drop("w")
    live = F.max(F.when(F.col("expired_at").isNull(), 1))
    return (
        edges.where("src != dst")
        .groupBy("src", "dst", "label")
        .agg(
            F.sum("weight").alias("weight"),
            F.min("created_at").alias("created_at"),
            F.min("valid_at").alias("valid_at"),
            F.when(live.isNull(), F.max("expired_at")).alias("expired_at"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("provenance")))).alias("provenance"),
            F.max("confidence").alias("confidence"),
        )
    )
