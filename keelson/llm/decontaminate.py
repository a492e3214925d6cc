"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

Items are partitioned by their number of shingles, in powers of two. A class has its own sketch length:
an item of n shingles that must hold ceil(t*n) is kept by its smallest hashes (the bottom of its MinHash
order), as many as the class's sizes can miss, plus one. So a document that holds enough of an item
holds one of its sketch's hashes, however long the document is, and the search dismisses no
true match. A document searches a class only if it has as many shingles as the class's least item needs, and only
with hashes up to the largest of the class's sketches. Candidates are verified by exact shingle containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, sliding, small, words

SHINGLE = 5
THRESHOLD = 0.8


def _needed(n: Column, threshold: float) -> Column:
    return F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int")


def _runs(w: Column, lengths: list[int], make) -> Column:
    """make(words) of each run of so many words, for each length."""
    return F.concat(*[sliding(w, m, make) for m in lengths]) if lengths else F.array()


def _hash(*x) -> Column:
    return F.xxhash64(*x)


def _join(*x) -> Column:
    return F.concat_ws(" ", *x)


def item_index(items: DataFrame, threshold: float, k: int) -> tuple[DataFrame, DataFrame]:
    """(sketches, shingles) of the items: item_id, size_class, need, h; and item_id, length, shingle. An item's
    shingles are its runs of k words; of fewer words, the whole. Rows that share an item_id are pooled into one item."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(k)))
    of_length = lambda make: F.coalesce(*[F.when(F.col("length") == m, sliding(F.col("w"), m, make)) for m in range(1, k + 1)])
    shingles = w.select("item_id", "length", F.explode(of_length(_join)).alias("shingle")).distinct()
    by_hash = w.select("item_id", F.explode(of_length(_hash)).alias("h")).distinct()
    per = by_hash.groupBy("item_id").agg(F.array_sort(F.collect_set("h")).alias("hs")).withColumn("n", F.size("hs"))
    per = per.withColumn("size_class", F.floor(F.log2("n")).cast("int")).withColumn("need", _needed(F.col("n"), threshold))
    # the most shingles that a matching item of the class may miss, plus one, is the length of its sketches
    length = per.groupBy(F.col("size_class").alias("c")).agg((F.max(F.col("n") - F.col("need")) + 1).alias("kept"))
    sketches = per.join(length, F.col("size_class") == F.col("c")).select("item_id", "size_class", "need", F.explode(F.slice("hs", F.lit(1), F.col("kept"))).alias("h"))
    return materialize(sketches, "sketches"), materialize(shingles, "item-shingles")


def size_classes(sketches: DataFrame) -> list[tuple[int, int, int]]:
    """(size_class, least number of shingles needed, largest hash of a sketch): a row for each power of two."""
    rows = sketches.groupBy("size_class").agg(F.min("need").alias("need"), F.max("h").alias("bound")).collect()
    return sorted((r["size_class"], r["need"], r["bound"]) for r in rows)


def searched(hs: Column, classes: list[tuple[int, int, int]]) -> Column:
    """(size_class, h) for each hash of a document and each class that it may match in."""
    none = F.array().cast("array<struct<size_class:int,h:bigint>>")

    def of(c: int, need: int, bound: int) -> Column:
        inside = F.filter(hs, lambda h: h <= bound)
        return F.when(F.size(hs) >= need, F.transform(inside, lambda h: F.struct(F.lit(c).alias("size_class"), h.alias("h")))).otherwise(none)

    return F.concat(*[of(*x) for x in classes]) if classes else none


def _found(docs: DataFrame, items: DataFrame, threshold: float, k: int) -> DataFrame:
    """doc_id, text_hash, item_id, n_shingles, n_matched: each text of docs and each item that it holds."""
    sketches, shingles = item_index(items, threshold, k)
    n_sketch = sketches.count()
    n_shingle, n_bytes = shingles.agg(F.count("*"), F.sum(F.octet_length("shingle"))).first()
    lengths = sorted(r[0] for r in shingles.select("length").distinct().collect())  # at most k rows
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    # one select after the other, and outer: else the text would be split again for every shingle
    grams = keyed.select("doc_id", "text_hash", words(F.col("text")).alias("w"))
    grams = grams.select("doc_id", "text_hash", _runs(F.col("w"), lengths, _hash).cast("array<bigint>").alias("hs"))
    grams = grams.select("doc_id", "text_hash", F.explode_outer(searched(F.col("hs"), size_classes(sketches))).alias("s"))
    found = grams.select("doc_id", "text_hash", "s.size_class", "s.h").join(small(sketches.select("size_class", "h").distinct(), n_sketch), ["size_class", "h"], "left_semi")
    ids = materialize(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "candidates")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    texts = keyed.join(small(ids, ids.count()), same, "left_semi")
    held = texts.select("doc_id", "text_hash", words(F.col("text")).alias("w"))
    held = held.select("doc_id", "text_hash", F.explode_outer(_runs(F.col("w"), lengths, _join).cast("array<string>")).alias("shingle"))
    held = held.join(small(shingles.drop("length"), n_shingle, n_bytes), "shingle").groupBy("doc_id", "text_hash", "item_id").agg(F.count_distinct("shingle").cast("int").alias("n_matched"))
    sizes = shingles.groupBy(F.col("item_id").alias("_item")).agg(F.count("*").cast("int").alias("n_shingles"))
    out = held.join(small(sizes, n_shingle), F.col("item_id").eqNullSafe(F.col("_item")))
    return out.where(F.col("n_matched") >= _needed(F.col("n_shingles"), threshold)).drop("_item")


def containments(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """doc_id, item_id, n_shingles, n_matched, containment for each text of docs and each item of whose
    distinct shingles it holds the threshold or more.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. An item's shingles are its runs of
    k words, or all of its words if they are fewer; a text of any length holds those that stand in it in a row.
    Null and empty texts hold nothing and aren't held. Rows of docs equal in doc_id (null included) and text count once;
    different texts with one doc_id are judged each by itself. Rows of items with the same id are pooled.
    Other columns are ignored; an empty table on either side gives no rows.
    """
    found = _found(docs, items, threshold, k)
    return found.select("doc_id", "item_id", "n_shingles", "n_matched", F.round(F.col("n_matched") / F.col("n_shingles"), 6).alias("containment"))


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """The rows of docs, all columns, whose own text contains no item."""
    a, b = fresh(docs, "_id"), fresh(docs, "_hash")
    hit = materialize(_found(docs, items, threshold, k).select(F.col("doc_id").alias(a), F.col("text_hash").alias(b)).distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col(a)) & (F.xxhash64("text") == F.col(b))
    return docs.join(small(hit, hit.count()), same, "left_anti")


_SPLIT = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = f"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS x, {_SPLIT} AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), {SHINGLE}) AS m FROM (SELECT item_id, {_SPLIT} AS w FROM benchmark) WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, x, unnest(list_transform(range(1, len(w) - m + 2), lambda p: array_to_string(w[p:p+m-1], ' '))) AS s FROM d, (SELECT DISTINCT m FROM i)),
s AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - m + 2), lambda p: array_to_string(w[p:p+m-1], ' '))) AS s FROM i),
n AS (SELECT item_id, count(*)::INTEGER AS n_shingles FROM s GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*)::INTEGER AS n_matched, round(count(*) / n_shingles, 6) AS containment
FROM ds JOIN s USING (s) JOIN n USING (item_id) GROUP BY doc_id, x, item_id, n_shingles HAVING count(*) >= ceil(n_shingles * {THRESHOLD} - 1e-9)
"""
