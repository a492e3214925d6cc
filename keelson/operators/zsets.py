"""Sorted-set state (bucket_id, key, member, score), one row for each member of a
set, which is named by bucket and key; order (score, member)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import matches
from .kv import literal


#: What names a set.
SET = ("bucket_id", "key")


def _order():
    return Window.partitionBy(*SET).orderBy("score", "member")


def _reversed():
    return Window.partitionBy(*SET).orderBy(F.col("score").desc(), F.col("member").desc())


def members(state: DataFrame, bucket_id: int, key) -> DataFrame:
    return state.where((F.col("bucket_id") == bucket_id) & (F.col("key") == literal(key))).select("member", "score")


def card(state: DataFrame) -> DataFrame:
    return state.groupBy(*SET).agg(F.count("*").alias("n"))


def in_score(start: float, end: float, exclude_start: bool = False, exclude_end: bool = False) -> Column:
    """Scores between the ends, which exclusion follows if they are given in falling order."""
    low, high, no_low, no_high = (start, end, exclude_start, exclude_end) if start <= end else (end, start, exclude_end, exclude_start)
    s = F.col("score")
    return (s > low if no_low else s >= low) & (s < high if no_high else s <= high)


def range_by_score(state: DataFrame, start: float, end: float, limit: int = 0, exclude_start: bool = False, exclude_end: bool = False) -> DataFrame:
    """key, member, score, pos for all keys; falling order if start > end. limit <= 0: all."""
    order = _order() if start <= end else _reversed()
    out = state.where(in_score(start, end, exclude_start, exclude_end)).withColumn("pos", F.row_number().over(order))
    return out.where(F.col("pos") <= limit) if limit > 0 else out


def count(state: DataFrame, start: float, end: float, limit: int = 0, exclude_start: bool = False, exclude_end: bool = False) -> DataFrame:
    """How many range_by_score returns: counted without ordering."""
    n = F.count("*")
    return state.where(in_score(start, end, exclude_start, exclude_end)).groupBy(*SET).agg((F.least(n, F.lit(limit)) if limit > 0 else n).cast("long").alias("n"))


def ranked(state: DataFrame) -> DataFrame:
    """rank from 1 by (score, member), and rev_rank from the other end."""
    n = F.count("*").over(Window.partitionBy(*SET))
    out = state.withColumn("rank", F.row_number().over(_order()))
    return out.withColumn("rev_rank", (n - F.col("rank") + 1).cast("int"))


def _bounds(n: Column, start: int, end: int) -> tuple[Column, Column]:
    def place(x: int) -> Column:
        return F.greatest(n + x + 1, F.lit(1)) if x < 0 else F.lit(max(x, 1))

    return place(start), place(end)


def range_by_rank(state: DataFrame, start: int, end: int) -> DataFrame:
    """key, member, score, rank, pos: ranks from 1, inclusive; negative ones count from the end, 0 is 1;
    start beyond end gives falling order (pos)."""
    if 0 < start <= end:  # a group limit below the window
        return state.withColumn("rank", F.row_number().over(_order())).where(F.col("rank") <= end).where(F.col("rank") >= start).withColumn("pos", F.col("rank") - start + 1)
    n = F.count("*").over(Window.partitionBy(*SET))
    a, b = _bounds(F.col("n"), start, end)
    out = state.withColumn("rank", F.row_number().over(_order())).withColumn("n", n)
    out = out.where(F.col("rank").between(F.least(a, b), F.greatest(a, b)))
    pos = F.when(a <= b, F.col("rank") - a + 1).otherwise(a - F.col("rank") + 1)
    # ranks over the size leave falling ranges to start at the last member
    top = F.least(a, F.col("n"))
    pos = F.when(a <= b, pos).otherwise(top - F.col("rank") + 1)
    return out.withColumn("pos", pos.cast("int")).drop("n")


def remove_range_by_rank(state: DataFrame, start: int, end: int) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(*SET))
    a, b = _bounds(F.col("n"), start, end)
    out = state.withColumn("rank", F.row_number().over(_order())).withColumn("n", n)
    return out.where(~F.col("rank").between(F.least(a, b), F.greatest(a, b))).drop("n", "rank")


def score(state: DataFrame, asked: DataFrame) -> DataFrame:
    return state.join(asked, [*SET, "member"]).select(*SET, "member", "score")


def peek_max(state: DataFrame) -> DataFrame:
    return state.groupBy(*SET).agg(F.max(F.struct("score", "member")).alias("m")).select(*SET, "m.member", "m.score")


def peek_min(state: DataFrame) -> DataFrame:
    return state.groupBy(*SET).agg(F.min(F.struct("score", "member")).alias("m")).select(*SET, "m.member", "m.score")


def pop(state: DataFrame, largest: bool = True) -> DataFrame:
    """The state after taking one end's member from each key."""
    return state.withColumn("_n", F.row_number().over(_reversed() if largest else _order())).where("_n > 1").drop("_n")


def remove(state: DataFrame, gone: DataFrame) -> DataFrame:
    return state.join(gone, [*SET, "member"], "left_anti")


def keys(state: DataFrame, pattern: str = "*") -> DataFrame:
    return state.where(matches(F.col("key").cast("string"), pattern)).select(*SET).distinct()
