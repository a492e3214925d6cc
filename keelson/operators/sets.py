"""Set state (bucket_id, key, member), distinct rows. A set is named by bucket and key; operators on two sets
take two such names, of one bucket or of two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import matches
from .kv import literal

KEYS = ["bucket_id", "key"]


def add(state: DataFrame, more: DataFrame) -> DataFrame:
    return state.unionByName(more).distinct()


def remove(state: DataFrame, gone: DataFrame) -> DataFrame:
    return state.join(gone, [*KEYS, "member"], "left_anti")


def members(state: DataFrame, bucket_id: int, key) -> DataFrame:
    return state.where(_is((bucket_id, key))).select("member")


def are_members(state: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(bucket_id, key, member) with present, for each pair asked for."""
    held = state.join(asked.distinct(), [*KEYS, "member"], "left_semi").withColumn("present", F.lit(True))
    return asked.distinct().join(held, [*KEYS, "member"], "left").select(*KEYS, "member", F.coalesce("present", F.lit(False)).alias("present"))


def all_members(state: DataFrame, asked: DataFrame) -> DataFrame:
    """For each key asked for, whether all its members are present."""
    return are_members(state, asked).groupBy(*KEYS).agg(F.bool_and("present").alias("all_present"))


def card(state: DataFrame) -> DataFrame:
    return state.groupBy(*KEYS).agg(F.count("*").alias("n"))


def keys(state: DataFrame, pattern: str = "*") -> DataFrame:
    return state.where(matches(F.col("key").cast("string"), pattern)).select(*KEYS).distinct()


def has_keys(state: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(bucket_id, key) with present: whether there is such a set."""
    held = state.join(asked, KEYS, "left_semi").select(*KEYS).distinct().withColumn("present", F.lit(True))
    return asked.distinct().join(held, KEYS, "left").select(*KEYS, F.coalesce("present", F.lit(False)).alias("present"))


def _is(name: tuple) -> Column:
    return (F.col("bucket_id") == name[0]) & (F.col("key") == literal(name[1]))


def diff(state: DataFrame, a: tuple, b: tuple) -> DataFrame:
    return members(state, *a).join(members(state, *b), "member", "left_anti")


def union(state: DataFrame, a: tuple, b: tuple) -> DataFrame:
    return state.where(_is(a) | _is(b)).select("member").distinct()


def inter(state: DataFrame, a: tuple, b: tuple) -> DataFrame:
    return members(state, *a).join(members(state, *b), "member", "left_semi")


def _as_bucket(state: DataFrame, bucket_id: int, other: int) -> DataFrame:
    """The sets of one bucket under the other's id."""
    return state.where(F.col("bucket_id") == other).withColumn("bucket_id", F.lit(bucket_id).cast("long"))


def diff_buckets(state: DataFrame, bucket_id: int, other: int) -> DataFrame:
    """Key by key for all keys of a bucket: members that the other bucket's set of the same key lacks."""
    return state.where(F.col("bucket_id") == bucket_id).join(_as_bucket(state, bucket_id, other), [*KEYS, "member"], "left_anti")


def union_buckets(state: DataFrame, bucket_id: int, other: int) -> DataFrame:
    """Key by key the members of either bucket's set, under the first bucket's id."""
    return state.where(F.col("bucket_id") == bucket_id).unionByName(_as_bucket(state, bucket_id, other)).distinct()


def move(state: DataFrame, source: tuple, target: tuple, member) -> DataFrame:
    """The state after moving a member from one set to another; unchanged if the source lacks it."""
    here = _is(source) & (F.col("member") == literal(member))
    moved = state.where(here).withColumns({"bucket_id": F.lit(target[0]).cast("long"), "key": literal(target[1]).cast(state.schema["key"].dataType)})
    return state.where(~here).unionByName(moved).distinct()


def pop(state: DataFrame) -> DataFrame:
    """The member that a pop takes from each key: the least, so that results repeat."""
    return state.groupBy(*KEYS).agg(F.min("member").alias("member"))
