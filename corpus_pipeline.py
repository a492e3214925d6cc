"""A corpus pipeline over `documents`: toxicity, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as
Parquet to the shared folder and reads it again as the next one's docs. All stages but the last
return the columns of documents, and any others that docs has.

Nulls, empty texts, repeated rows and empty tables are handled as the operators' docstrings say: a
null or empty text is scored like any other, is a near copy of other empty ones, contains no
benchmark item, has no tokens (a leaf of such texts only is left out), and takes one byte of a shard. Very long texts
pass whole through each stage. Ties: a score of exactly 0.5 is rejected; of near copies with one doc_id the text with the smallest hash
stays; rows equal in doc_id and text are kept or dropped, and taken by the mixture, together. Columns that docs has beyond those of documents
come along under their names, whatever they are called; helper columns take other names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import decontaminate, mixing, sharding, simhash, toxicity
from keelson.llm.common import fresh, materialize, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the classifier learns from all labelled rows of docs."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    name = fresh(docs, "_toxicity")
    return toxicity.score(docs, model, name=name).where(F.col(name) < 0.5).drop(name)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest doc_id."""
    return simhash.keep_one(spark, docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminate(spark, docs, read(spark, sf_dir, "benchmark"))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mixture takes them: a document of n epochs is n rows."""
    return mixing.mixed(spark, docs)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of each document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return sharding.shard(spark, docs, n_shards=8)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", one_of_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", to_weights),
    ("sharding", to_shards),
]

#: A trained classifier and a k-d tree can't be expressed in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
