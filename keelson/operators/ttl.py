"""Time to live, against an explicit clock in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _now(now_ms) -> Column:
    return now_ms if isinstance(now_ms, Column) else F.lit(now_ms).cast("long")


def is_live(now_ms, ttl: str = "ttl_s", ts: str = "ts_ms") -> Column:
    return (F.col(ttl) == 0) | (F.col(ts) + F.col(ttl) * 1000 > _now(now_ms))


def is_expired(now_ms, ttl: str = "ttl_s", ts: str = "ts_ms") -> Column:
    return ~is_live(now_ms, ttl, ts)


def remaining(now_ms, ttl: str = "ttl_s", ts: str = "ts_ms") -> Column:
    """Whole seconds left, -1 without a time to live, 0 when it is over."""
    left = F.floor((F.col(ts) + F.col(ttl) * 1000 - _now(now_ms)) / 1000)
    return F.when(F.col(ttl) == 0, F.lit(-1)).otherwise(F.greatest(left, F.lit(0))).cast("long")


def live(df: DataFrame, now_ms) -> DataFrame:
    return df.where(is_live(now_ms))


def expired(df: DataFrame, now_ms) -> DataFrame:
    return df.where(is_expired(now_ms))


def purge_candidates(state: DataFrame, seen: DataFrame, now_ms) -> DataFrame:
    """Keys to delete of those seen expired earlier: their timestamp is still the one seen, and they
    are still expired, so a key rewritten meanwhile stays."""
    return expired(state, now_ms).join(seen.select("bucket_id", "key", "ts_ms"), ["bucket_id", "key", "ts_ms"], "left_semi")
