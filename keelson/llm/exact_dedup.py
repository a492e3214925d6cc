"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries of each partition's digests, merged by addition, contain every digest that
makes up more than 2/k of all rows. Their exact winners are at most k rows and are broadcast, so their copies
are settled where they are read; the other digests, none of them heavy, are shuffled.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

COUNTERS = 1024


def misra_gries(keys, k: int, held: dict | None = None) -> dict:
    """Counters of a Misra-Gries summary: each key's count, too low by len(keys)/(k+1) at most."""
    held = {} if held is None else held
    for x in keys:
        if x in held:
            held[x] += 1
        elif len(held) < k:
            held[x] = 1
        else:
            for y in [y for y, n in held.items() if n == 1]:
                del held[y]
            for y in held:
                held[y] -= 1
    return held


def _summaries(k: int):
    def of(batches):
        held: dict = {}
        for b in batches:
            # equal digests of a batch are counted first: copies are then one update each
            counted = b.column(0).value_counts()
            for x, n in zip(counted.field(0).to_pylist(), counted.field(1).to_pylist()):
                if x in held or len(held) < k:
                    held[x] = held.get(x, 0) + n
                    continue
                while n > 0 and len(held) >= k:
                    off = min(n, min(held.values()))
                    n -= off
                    held = {y: m - off for y, m in held.items() if m > off}
                if n > 0:
                    held[x] = n
        if held:
            yield pa.record_batch([pa.array([*held], pa.binary()), pa.array([*held.values()], pa.int64())], names=["digest", "n"])

    return of


def heavy_hitters(rows: DataFrame, k: int = COUNTERS) -> DataFrame:
    """At most k digests, among them all that more than 2/k of rows have."""
    found = rows.select("digest").mapInArrow(_summaries(k), "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    return found.orderBy(F.desc("n"), "digest").limit(k).where("n > 1").select("digest")


def exact_dedup(spark: SparkSession, docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs.

    Texts are equal when identical; null counts as empty. Of equal texts exactly one row stays, one
    with the largest doc_id (nulls last; among rows equal in both, any one). Other columns are
    ignored; no rows give none.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    slim = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    rank = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row")
    best = F.max(rank).alias("best"), F.count("*").alias("group_size")
    heavy = materialize(heavy_hitters(slim, counters), "heavy")  # at most `counters` rows
    winners = materialize(slim.join(F.broadcast(heavy), "digest").groupBy("digest").agg(*best), "winners")
    settled = slim.join(F.broadcast(winners), "digest")
    rest = slim.join(F.broadcast(heavy), "digest", "left_anti")
    group = Window.partitionBy("digest")
    rest = rest.select("*", F.max(rank).over(group).alias("best"), F.count("*").over(group).alias("group_size"))
    every = settled.select("doc_id", "row", "digest", "best", "group_size").union(rest.select("doc_id", "row", "digest", "best", "group_size"))
    return every.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
