"""A table of awkward rows, and others made of it."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"word{i % 997}" for i in range(60_000))
ROWS = [
    (5, "the quick brown fox jumps over the lazy dog and runs far away", "en", "src1", 60),
    (3, "the quick brown fox jumps over the lazy dog and runs far away", "en", "src1", 60),
    (3, "the quick brown fox jumps over the lazy dog and runs far away", "en", "src1", 60),
    (9, "", "en", "src2", 0),
    (4, None, None, None, None),
    (7, LONG, "de", "src9", len(LONG)),
    (None, "no identity here at all my friends", "fr", None, 30),
    (None, None, None, None, None),
    (8, "  \t\n ", "", "", 5),
    (1, "Üñïçødé TEXT’s ñame — 漢字 𝒳", "es", "other", 20),
    (2, "one", "en", "src3", 3),
    (6, "two words", "en", "src3", 9),
]


def edge_docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def crowded(df):
    """The same rows with columns that have the names operators might use inside."""
    from pyspark.sql import functions as F

    names = ["score", "fp", "h", "w", "key", "node", "shard", "slot", "row", "component_id", "_hit", "_gone", "_label", "_toxicity", "digest", "size", "domain", "copies", "id", "path", "a", "b", "n", "kept", "lines", "host", "text_hash", "_id", "count"]
    return df.select("*", *[F.lit("x").alias(n) for n in names])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
