"""Scores of memories, records and ranked lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.config import DAY_MS, Config


def memory_strength(now_ms: int, last_used: Column, updated: Column, uses: Column, confidence: Column, half_life_days: float = 30.0) -> Column:
    """Confidence, halved each half-life since the last use, raised with the logarithm of uses."""
    age = F.greatest(F.lit(0.0), (F.lit(now_ms) - F.coalesce(last_used, updated)) / DAY_MS)
    return F.pow(F.lit(0.5), age / half_life_days) * (1 + F.log1p(F.coalesce(uses, F.lit(0)))) * F.greatest(F.lit(0.0), F.coalesce(confidence, F.lit(1.0)))


def record_decay(now_ms: int, importance: Column, last_access: Column, accesses: Column, cfg: Config = Config()) -> Column:
    """What a record's score is multiplied by: importance, age and number of accesses."""
    age = F.greatest(F.lit(0.0), (F.lit(now_ms) - last_access) / DAY_MS)
    fade = F.exp(-age * (0.6931471805599453 / cfg.record_half_life_days))
    return F.coalesce(importance, F.lit(1.0)) * (cfg.decay_floor + (1 - cfg.decay_floor) * fade) * (1 + cfg.access_weight * F.log1p(F.coalesce(accesses, F.lit(0))))


def episode_score(now_ms: int, similarity: Column, occurred: Column, half_life_days: float = 30.0) -> Column:
    age = F.greatest(F.lit(0.0), (F.lit(now_ms) - occurred) / DAY_MS)
    return 0.7 * similarity + 0.3 * F.pow(F.lit(0.5), age / half_life_days)


def when_ms(c: Column, now_ms: int) -> Column:
    """Milliseconds from a number or a date in text, else now."""
    return F.coalesce(c.try_cast("bigint"), F.unix_millis(F.try_to_timestamp(c)), F.lit(now_ms))


def reciprocal_rank_share(rank: Column, k: int = 60) -> Column:
    """rank counts from 1."""
    return 1.0 / (k + rank)
