"""Sharding by k-d tree partitioning: nodes split at distributed weighted medians.

A node that is to give n shards splits along its widest dimension at the point below which lie
n//2 of n parts of its bytes. Medians come from histograms of bytes that are summed, searched and
refined on the executors, within the bin the cut falls in, so no round gathers or sorts rows. The tree is a table: a row for each
open node, whose histograms take BINS rows, or fewer where many nodes are open (ALL_BINS in all, LEAST_BINS a node at least).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, small

#: Histogram bins of a node, at most and at least, and of all open nodes together.
BINS, LEAST_BINS, ALL_BINS = 512, 8, 1 << 18
#: A group of equal texts that holds a cut is kept whole if that costs less than this part of a shard's bytes.
SLACK = 0.002
_LOW = -(1 << 62)


def _slim(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    name = F.rpad(F.coalesce(F.col("lang").cast("string"), F.lit("")).cast("binary"), 4, F.unhex(F.lit("00")))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 34).alias("digest"),
        F.floor(F.log2(size) * 16).cast("long").alias("d_size"),
        F.conv(F.hex(F.substring(name, 1, 4)), 16, 10).cast("long").alias("d_lang"),  # in order of the name
        (F.length(text) * 1000 / size).cast("long").alias("d_chars"),
        F.lit(0).alias("node"),
    )


DIMENSIONS = ("d_size", "d_lang", "d_chars")


def _one_language(slim: DataFrame) -> DataFrame:
    """Equal texts get one value in each dimension: the least of their languages."""
    text = ["digest", "text_crc32", "size"]
    mixed = slim.groupBy(*text).agg(F.min("d_lang").alias("least"), F.max("d_lang").alias("most")).where("least < most").drop("most")
    mixed = materialize(mixed, "mixed-languages")
    return slim.join(small(mixed, mixed.count()), text, "left").withColumn("d_lang", F.coalesce("least", "d_lang")).select(*slim.columns)


def _cuts(rows: DataFrame, nodes: DataFrame, n: int, key: Column) -> DataFrame:
    """For each of the n nodes(node, dim, want, before, low, high) the key at which before and the running sum of
    sizes, in order of the key, reach want: node, at, before (the bytes below it), mass (those at it)."""
    open_nodes, found = nodes, None
    while n:
        bins = max(LEAST_BINS, min(BINS, ALL_BINS // n))
        inside = rows.join(small(open_nodes, n), "node").withColumn("key", key).where("key between low and high")
        bin_of = F.expr(f"(key - low) div ((high - low) div {bins} + 1)")
        binned = inside.groupBy("node", "dim", "want", "before", bin_of.alias("bin")).agg(F.sum("size").alias("mass"), F.min("key").alias("low"), F.max("key").alias("high"))
        order = Window.partitionBy("node").orderBy("bin")
        binned = binned.withColumn("upto", F.col("before") + F.sum("mass").over(order))
        # the first bin in which the sum is reached, or else the last
        pick = F.min(F.when(F.col("upto") >= F.col("want"), F.col("bin"))).over(Window.partitionBy("node"))
        binned = binned.withColumn("pick", F.coalesce(pick, F.max("bin").over(Window.partitionBy("node")))).where("bin = pick")
        step = materialize(binned.select("node", "dim", "want", (F.col("upto") - F.col("mass")).alias("before"), "low", "high", "mass"), "cuts")
        done = step.where("low = high")
        found = done if found is None else found.union(done)
        open_nodes = step.where("low < high")
        n = open_nodes.count()
    return found.select("node", "dim", "want", F.col("low").alias("at"), "before", "mass")


def assign(slim: DataFrame, n_shards: int, dimensions: tuple[str, ...] = DIMENSIONS, slack: float = SLACK) -> DataFrame:
    """slim, whose column node is 0 in all rows, with a column shard from 0 to n_shards-1 instead."""
    rows, spark = slim, slim.sparkSession
    edges = [f(d).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i, d in enumerate(dimensions)]
    root = rows.agg(*edges).first()
    # the tree's leaves so far: the first of their shards, and how many they give
    leaves = materialize(spark.range(1).select(F.lit(0).alias("node"), F.lit(0).alias("first"), F.lit(n_shards).alias("count")), "leaves")
    value = F.element_at(F.array(*dimensions), F.col("dim") + 1)
    # a dimension's value and, among equal values, a digest of the text: equal texts stay together
    key, own = F.shiftleft(value, 30) + F.col("digest"), F.coalesce("doc_id", F.lit(_LOW))
    most = n_shards
    while most > 1:
        tree = leaves.where("count > 1")
        n = tree.count()
        stats = rows.join(small(tree, n), "node").groupBy("node", "count").agg(F.sum("size").alias("bytes"), *edges)
        wide = [F.struct(((F.col(f"hi{i}") - F.col(f"lo{i}")) / max(1, (root[f"hi{i}"] or 0) - (root[f"lo{i}"] or 0))).alias("w"), F.lit(-i).alias("i")) for i in range(len(dimensions))]
        dim = -F.greatest(*wide)["i"]
        bound = lambda side: F.element_at(F.array(*[F.col(f"{side}{i}") for i in range(len(dimensions))]), F.col("dim") + 1)
        stats = stats.withColumn("dim", dim.cast("int")).withColumn("want", (F.col("bytes") * F.floor(F.col("count") / 2) / F.col("count")).cast("double"))
        stats = stats.withColumns({"low": F.shiftleft(bound("lo"), 30), "high": F.shiftleft(bound("hi"), 30) + F.lit((1 << 30) - 1)})
        stats = materialize(stats.select("node", "dim", "want", F.lit(0).cast("long").alias("before"), "low", "high", "bytes", "count"), "nodes")
        filled = stats.count()
        if not filled:
            break
        cut = _cuts(rows, stats.drop("bytes", "count"), filled, key)
        over, under = F.col("before") + F.col("mass") - F.col("want"), F.col("want") - F.col("before")
        cut = cut.join(stats.select("node", "bytes", "count"), "node").withColumn("split", F.least(over, under) > F.lit(slack) * F.col("bytes") / F.col("count"))
        # the group at the cut goes to one side as a whole, left or right, or is split by doc_id
        cut = materialize(cut.withColumn("last", F.when(over <= under, F.lit(None)).otherwise(F.lit(_LOW - 1)).cast("long")), "cut")
        halves = cut.where("split")
        n_halves = halves.count()
        if n_halves:
            same = rows.join(small(halves.select("node", "dim", F.col("at").alias("_at")), n_halves), "node").where(key == F.col("_at")).drop("dim", "_at")
            ends = same.groupBy(F.col("node").alias("_n")).agg(F.min(own).alias("low"), F.max(own).alias("high"))
            inner = halves.join(ends, F.col("node") == F.col("_n")).select("node", "dim", (F.col("want") - F.col("before")).alias("want"), F.lit(0).cast("long").alias("before"), "low", "high")
            inner = materialize(inner, "halves")
            inner = _cuts(same, inner, n_halves, own).select(F.col("node").alias("_n"), F.col("at").alias("_last"))
            cut = cut.join(small(inner, n_halves), F.col("node") == F.col("_n"), "left").withColumn("last", F.when(F.col("split"), F.col("_last")).otherwise(F.col("last")))
        sides = cut.select("node", "dim", "at", "last")
        keyed = rows.join(small(sides, filled), "node", "left")
        left = (key < F.col("at")) | ((key == F.col("at")) & (F.col("last").isNull() | (own <= F.col("last"))))
        # children of node k are 2k+1 and 2k+2; an empty node's children are never asked for
        node = F.when(F.col("dim").isNull(), F.col("node")).when(left, F.col("node") * 2 + 1).otherwise(F.col("node") * 2 + 2)
        rows = materialize(keyed.select(*[c for c in slim.columns if c != "node"], node.alias("node")), "nodes")
        half = F.floor(F.col("count") / 2).cast("int")
        sides_of = F.array(F.struct((F.col("node") * 2 + 1).alias("node"), F.col("first").alias("first"), half.alias("count")), F.struct((F.col("node") * 2 + 2).alias("node"), (F.col("first") + half).alias("first"), (F.col("count") - half).alias("count")))
        leaves = materialize(leaves.where("count = 1").union(tree.select(F.explode(sides_of).alias("x")).select("x.*")), "leaves")
        most = leaves.agg(F.max("count")).first()[0]
    return rows.join(small(leaves.select("node", F.col("first").alias("shard")), n_shards), "node").drop("node")


def slots(rows: DataFrame, pieces: int = 64) -> DataFrame:
    """rows with slot, gapless from 0 in each shard: rows are counted by slices of a hash of the row,
    numbered within a slice, and offset by the slices before it, so no task holds a whole shard."""
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(pieces)).cast("int"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("shard", "piece").count().select(F.col("shard").alias("_s"), F.col("piece").alias("_p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    base = materialize(base, "slices")
    inner = Window.partitionBy("shard", "piece").orderBy(F.col("doc_id").asc_nulls_first(), "digest", "size")
    numbered = rows.withColumn("within", F.row_number().over(inner) - 1)
    out = numbered.join(small(base, base.count()), (F.col("shard") == F.col("_s")) & (F.col("piece") == F.col("_p")))
    return out.withColumn("slot", (F.col("base") + F.col("within")).cast("long")).drop("base", "within", "piece", "_s", "_p")


def shard(spark: SparkSession, docs: DataFrame, n_shards: int | None = 8, target_bytes: int | None = None, rows_per_slice: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs; the law is bytes.

    Shards hold near-equal bytes: n_shards of them, or as many as target_bytes each need. Equal texts
    meet in a shard, whatever their language, unless a cut falls in their group and moving it would unbalance the
    shards by over SLACK, as for a group larger than a shard: that is split by doc_id. A very long text is one row. A null text has no bytes (size 1); a null doc_id comes before
    all others; repeated rows are placed each; other columns are ignored; no rows give none.
    """
    slim = materialize(_one_language(materialize(_slim(docs), "slim")), "slim")
    total, n = slim.agg(F.sum("size"), F.count("*")).first()
    if target_bytes:
        n_shards = max(1, -(-(total or 0) // target_bytes))
    placed = materialize(assign(slim, n_shards), "placed")
    pieces = max(16, -(-n // (rows_per_slice * n_shards)))
    return slots(placed, pieces).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
