"""Shared helpers: tables written to the cluster's shared folder, size-checked broadcasts, word splitting."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialize, new_path, shared_dir  # noqa: F401

#: Bytes up to which a table is broadcast; above, joins shuffle. And what a row of a few longs takes.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 64

#: Separators of words: ASCII other than digits and letters (upper case is folded before).
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def small(df: DataFrame, rows: int, size: int = 0) -> DataFrame:
    """Broadcast hint behind a check of the table's bytes: those of slim rows, and size for strings and arrays;
    beyond the bound the join shuffles."""
    return F.broadcast(df) if rows * ROW_BYTES + (size or 0) <= BROADCAST_BYTES else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(text: Column) -> Column:
    """A-Z in lower case, and no other letter changed; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)  # then lower() does the same, faster
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased; null counts as empty."""
    return F.array_remove(F.split(fold(text), NON_WORD), "")


def sliding(items: Column, k: int, make) -> Column:
    """make(item_i, ..., item_i+k-1) for each window of k; fewer items: none."""
    n = F.size(items) - F.lit(k)
    spots = F.when(n >= 0, F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: make(*[F.get(items, i + j) for j in range(k)]))


def parts_for(total_bytes: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil((total_bytes or 0) / each))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
