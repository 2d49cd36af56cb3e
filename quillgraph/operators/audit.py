"""A log whose entries are chained by hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "GENESIS"
FIELDS = ("ts", "actor", "org", "action", "target", "ok", "detail")


def entry_hash(previous: Column) -> Column:
    return F.sha2(F.concat_ws("\n", previous, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIELDS]), 256)


def extend(rows: Iterable[dict], last: str = GENESIS, first_id: int = 1) -> list[dict]:
    """New entries chained to the last hash. A chain is sequential, so this is the one writer's own step."""
    out = []
    for i, r in enumerate(rows, first_id):
        text = "\n".join([last, *("" if r.get(c) is None else str(r[c]) for c in FIELDS)])
        last, before = hashlib.sha256(text.encode()).hexdigest(), last
        out.append({"id": i, **{c: r.get(c) for c in FIELDS}, "prev_hash": before, "hash": last})
    return out


def verify(log: DataFrame) -> DataFrame:
    """(id, reason) of broken entries; the whole chain holds if there are none. One window over the order of ids: the
    entries before are needed only one at a time."""
    w = Window.orderBy("id")
    before = F.coalesce(F.lag("hash").over(w), F.lit(GENESIS))
    seen = log.withColumn("before", before)
    reason = F.when(F.col("prev_hash") != F.col("before"), "an entry was put in, left out or moved").when(entry_hash(F.col("before")) != F.col("hash"), "an entry was changed")
    return seen.select("id", reason.alias("reason")).where("reason is not null")


def verify_by_neighbours(log: DataFrame) -> DataFrame:
    """The same by a join on consecutive ids, without a single-task window."""
    before = log.select((F.col("id") + 1).alias("id"), F.col("hash").alias("before"))
    seen = log.join(before, "id", "left").withColumn("before", F.when(F.col("id") == 1, GENESIS).otherwise(F.col("before")))
    bad_link = ~F.coalesce(F.col("prev_hash") == F.col("before"), F.lit(False))
    reason = F.when(bad_link, "an entry was put in, left out or moved").when(entry_hash(F.col("before")) != F.col("hash"), "an entry was changed")
    return seen.select("id", reason.alias("reason")).where("reason is not null")


def redacted(action: Column, target: Column) -> Column:
    """What the log keeps of a call's target: never contents."""
    return F.when(action.isin("context_ingest", "ingest"), F.concat(F.lit("chars:"), F.length(target))).when(F.length(target) > 120, F.concat(F.substring(target, 1, 117), F.lit("..."))).otherwise(target)


def newest(log: DataFrame, n: int = 50) -> DataFrame:
    return log.orderBy(F.desc("id")).limit(n)
