"""The catalog of buckets (bucket_id, ds, name, op, commit_seq); an identity is (ds, name)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.globs import matches
from ..schema import Flag


def live(catalog: DataFrame) -> DataFrame:
    """Buckets whose last operation is not a deletion."""
    last = catalog.groupBy("bucket_id").agg(F.max_by(F.struct("ds", "name", "op"), F.struct("commit_seq", "op")).alias("b"))
    return last.select("bucket_id", "b.*").where(F.col("op") != int(Flag.BUCKET_DELETE)).select("bucket_id", "ds", "name")


def exists(catalog: DataFrame, ds: int, name: str) -> DataFrame:
    return live(catalog).where((F.col("ds") == ds) & (F.col("name") == name))


def iterate(catalog: DataFrame, ds: int, pattern: str = "*") -> DataFrame:
    return live(catalog).where(F.col("ds") == ds).where(matches(F.col("name"), pattern)).orderBy("name").select("name")


def without_orphans(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows of live buckets only; the catalog is joined by id."""
    return rows.join(live(catalog).select("bucket_id"), "bucket_id", "left_semi")
