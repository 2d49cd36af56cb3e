"""Session memory, rate limits and event windows: the same rules for batches and for streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillgraph.config import DAY_MS
from quillgraph.functions import text as T
from quillgraph.functions.vectors import content_hash


def note_form(c: Column) -> Column:
    return F.trim(F.regexp_replace(T.sanitize(c), r"\s+", " "))


def fold_notes(events: DataFrame) -> DataFrame:
    """Items of sessions from events (session_id, ts, op 'note' or 'reference', content, important).

    A note that a session already has counts as a repetition; importance sticks.
    """
    e = events.withColumn("content", note_form(F.col("content"))).where("content != '' and session_id is not null")
    one = e.groupBy("session_id", F.lower("content").alias("key")).agg(
        F.min_by("content", F.when(F.col("op") == "note", F.col("ts"))).alias("content"),
        F.count_if(F.col("op") == "note").cast("int").alias("repeat_count"),
        F.count_if(F.col("op") == "reference").cast("int").alias("ref_count"),
        F.bool_or((F.col("op") == "note") & F.coalesce("important", F.lit(False))).alias("important"),
        F.min(F.when(F.col("op") == "note", F.col("ts"))).alias("first_seen_at"),
        F.max("ts").alias("last_seen_at"),
    )
    return one.where("repeat_count > 0").select("session_id", F.concat_ws(":", F.lit("wm"), "session_id", F.sha2("key", 256)).alias("item_id"), "content", "repeat_count", "ref_count", "important", "first_seen_at", "last_seen_at")


def expire(items: DataFrame, now_ms: int, ttl_ms: int = DAY_MS) -> DataFrame:
    """Items touched within the time to live."""
    return items.where(F.col("last_seen_at") >= now_ms - ttl_ms)


def session_count(items: DataFrame) -> DataFrame:
    """One row: sessions (different ones with items) and items."""
    return items.agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("items"))


def is_salient() -> Column:
    return F.col("important") | (F.col("repeat_count") >= 2) | (F.col("ref_count") >= 2)


def consolidate_session(items: DataFrame, now_ms: int, virtual_record_id: str, ttl_ms: int = DAY_MS) -> tuple[DataFrame, DataFrame]:
    """Promoted items with the subject_key of their memory, and counts (session_id, promoted, dropped)."""
    live = expire(items, now_ms, ttl_ms)
    kept = live.where(is_salient()).withColumn("subject_key", F.concat_ws("|", F.lit("wm"), F.lit(virtual_record_id), content_hash(F.lower("content"))))
    return kept, live.groupBy("session_id").agg(F.count_if(is_salient()).alias("promoted"), F.count_if(~is_salient()).alias("dropped"))


STATE = "repeat_count int, ref_count int, important boolean, first_seen_at long, last_seen_at long, content string"
OUT = f"session_id string, key string, {STATE}, salient boolean, done boolean"


def stream_notes(events: DataFrame, ttl: str = "24 hours", ttl_ms: int = DAY_MS) -> DataFrame:
    """A stream of items with their counts so far; an item untouched for ttl of event time is given a last time
    (done) and dropped. events: a stream with at timestamp and the columns of fold_notes."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, text = key
        names = [c.split()[0] for c in STATE.split(", ")]
        now = dict(zip(names, state.get)) if state.exists else {"repeat_count": 0, "ref_count": 0, "important": False, "first_seen_at": None, "last_seen_at": 0, "content": None}
        if state.hasTimedOut:
            state.remove()
            done = True
        else:
            done = False
            for frame in frames:
                for r in frame.sort_values("ts").itertuples():
                    if r.op == "note":
                        now["repeat_count"] += 1
                        now["content"] = now["content"] or r.content
                        now["first_seen_at"] = now["first_seen_at"] if now["first_seen_at"] is not None else int(r.ts)
                        now["important"] = bool(now["important"] or r.important)
                    elif now["repeat_count"]:
                        now["ref_count"] += 1
                    now["last_seen_at"] = max(now["last_seen_at"], int(r.ts))
            state.update(tuple(now[n] for n in names))
            state.setTimeoutTimestamp(max(now["last_seen_at"] + ttl_ms, state.getCurrentWatermarkMs() + 1))
        if now["repeat_count"]:
            salient = now["important"] or now["repeat_count"] >= 2 or now["ref_count"] >= 2
            yield pd.DataFrame([{"session_id": session, "key": text, **now, "salient": salient, "done": done}])

    e = events.withColumn("content", F.trim(F.regexp_replace("content", r"\s+", " "))).where("content != ''").withColumn("key", F.lower("content")).withColumn("important", F.coalesce("important", F.lit(False))).withWatermark("at", ttl)
    return e.groupBy("session_id", "key").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def token_bucket(requests: DataFrame, burst: float = 30.0, per_second: float = 10.0) -> DataFrame:
    """requests (key, ts, cost) with allowed: a bucket per key, filled at a rate; sequential per key by definition."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "cost"], kind="stable")
        level, last, out = burst, None, []
        for t, c in zip(frame["ts"], frame["cost"]):
            if last is not None:
                level = min(burst, level + (t - last) / 1000 * per_second)
            last = t
            ok = level >= c
            level -= c if ok else 0
            out.append(ok)
        return frame.assign(allowed=out)[["key", "ts", "cost", "allowed"]]

    return requests.groupBy("key").applyInPandas(run, "key string, ts long, cost double, allowed boolean")


def windows(events: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums of values per event type in tumbling or sliding windows; late: how long a stream waits."""
    e = events.withWatermark("ts", late) if late else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "24 hours", late: str | None = None) -> DataFrame:
    """Sessions of users: they end when nothing happens for the gap."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """A stream without repeats of keys that come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def session_numbers(events: DataFrame, gap_ms: int) -> DataFrame:
    """Events (user_id, ts_ms) with the number of their session, by windows over each user's events."""
    w = Window.partitionBy("user_id").orderBy("ts_ms", "event_id")
    new = F.coalesce((F.col("ts_ms") - F.lag("ts_ms").over(w) > gap_ms).cast("int"), F.lit(1))
    return events.withColumn("new", new).withColumn("session", F.sum("new").over(w)).drop("new")
