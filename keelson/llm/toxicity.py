"""Toxicity: a logistic classifier with counterfactual regularisation.

A text is the set of its distinct words; a word stands for itself and its prefixes, hashed into one
space, and the logit is the sum of its words' weights. Labelled texts that mention an identity term are
also read with the term swapped for its neighbour in the same list and for a neutral noun; labelled
texts that mention none are read with a term put before their first word, and the same swaps. A
squared penalty on the change of the logit keeps the score from leaning on the group named.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .texts import CHUNK_BYTES, distinct_words, prefix_sums, slices

# Groups of interchangeable identity terms, and the neutral noun put in their place.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly"),
)
NEUTRAL = "person"

#: Lengths in bytes of the prefixes counted, and the bits of the space of features.
PREFIXES, BITS = (4, 5, 6, 7), 20
#: Bounds of the sample that is learnt from: labelled texts of each class, and those of them that are read with swaps.
PER_CLASS, SWAPPED = 2_000, 1_000


def feature_ids(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(place of a word, feature) for each feature of each word."""
    found = [(at, (h >> np.uint64(64 - BITS)).astype(np.int64)) for at, h in prefix_sums(words, PREFIXES)]
    return np.concatenate([a for a, _ in found]), np.concatenate([i for _, i in found])


def features(text: str | None) -> dict[int, int]:
    """How many of a text's distinct words have each feature."""
    ids, n = np.unique(feature_ids(distinct_words(pa.array([text or ""]))[0])[1], return_counts=True)
    return dict(zip(ids.tolist(), n.tolist()))


_TERMS = [t for g in IDENTITY_TERMS for t in g]
_NEXT = {t: g[(i + 1) % len(g)] for g in IDENTITY_TERMS for i, t in enumerate(g)}
_TERM = re.compile(r"\b(" + "|".join(sorted(_NEXT, key=lambda t: (-len(t), t))) + r")\b")


def mention(text: str | None) -> str:
    """The text in lower case; one that names no identity term gets one before its first word."""
    low = (text or "").lower()
    return low if _TERM.search(low) else f"{_TERMS[zlib.crc32(low.encode('utf-8', 'surrogatepass')) % len(_TERMS)]} {low}"


def counterfactuals(text: str | None) -> list[str]:
    """The text with each identity term swapped in its list, and with the neutral noun; [] if none is named."""
    low = (text or "").lower()
    if not _TERM.search(low):
        return []
    return [_TERM.sub(lambda m: _NEXT[m[0]], low), _TERM.sub(NEUTRAL, low)]


def changes(text: str | None) -> list[dict[int, int]]:
    """What the swaps change in the features of the text's mention, a table for each swap."""
    named, out = mention(text), []
    words = lambda t: {*distinct_words(pa.array([t]))[0].to_pylist()}
    before = words(named)
    for other in counterfactuals(named):
        after = words(other)
        ids = [feature_ids(pa.array(sorted(x), pa.large_string()))[1] for x in (after - before, before - after)]
        used, at = np.unique(np.concatenate(ids), return_inverse=True)
        n = np.bincount(at, np.repeat([1, -1], [*map(len, ids)]), len(used)).astype(int)
        out.append({i: k for i, k in zip(used.tolist(), n.tolist()) if k})
    return out


class Model:
    """A weight for each feature, and how many swapped pairs were learnt from."""

    def __init__(self, weights: np.ndarray, bias: float, pairs: int = 0):
        self.weights, self.bias, self.pairs = weights, float(bias), pairs

    def of_words(self, words: pa.Array) -> np.ndarray:
        at, ids = feature_ids(words)
        return np.bincount(at, self.weights[ids], len(words))

    def score_all(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b in slices(texts, CHUNK_BYTES):
            words, text, word = distinct_words(texts.slice(a, b - a))
            out[a:b] = np.bincount(text, self.of_words(words)[word], b - a) + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.score_all(pa.array([text or ""]))[0])


def _sparse(tables: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of tables of features."""
    row = np.repeat(np.arange(len(tables), dtype=np.int32), [len(t) for t in tables])
    col = np.fromiter((i for t in tables for i in t), np.int64, len(row))
    return row, col, np.fromiter((v for t in tables for v in t.values()), np.float64, len(row))


def train(x, label, swaps, weight=None, penalty: float = 1.0, l2: float = 1e-3, steps: int = 80, rate: float = 0.05) -> Model:
    """x, swaps: (row, column, value) arrays of the texts' features and of the changes under swaps; label and
    weight of each text. Full-batch Adam on the weighted mean cross-entropy plus penalty times the mean
    squared change of the logit. A feature is scaled by its naive Bayes log ratio, so that rare words
    that go with one class count at once."""
    label = np.asarray(label, np.float64)
    n, m = len(label), int(swaps[0].max()) + 1 if len(swaps[0]) else 0
    weight = np.ones(n) if weight is None else np.asarray(weight, np.float64)
    rate_of = (weight * label).sum() / max(weight.sum(), 1e-9) if n else 0.25
    out = np.zeros(1 << BITS)
    b = np.log((rate_of + 1e-3) / (1 - rate_of + 1e-3))
    used = np.unique(np.concatenate([x[1], swaps[1]]))
    if not n or not len(used):
        return Model(out, b)
    d, row, crow = len(used), x[0], swaps[0]
    at = np.zeros(1 << BITS, np.int32)
    at[used] = np.arange(d)
    col, ccol = at[x[1]], at[swaps[1]]
    toxic, clean = np.bincount(col, label[row], d), np.bincount(col, 1 - label[row], d)
    scale = np.abs(np.log((toxic + 0.5) / (label.sum() + 1) * ((1 - label).sum() + 1) / (clean + 0.5))) + 0.1
    value, cvalue = (a.astype(np.float32) * scale.astype(np.float32)[c] for a, c in ((x[2], col), (swaps[2], ccol)))
    del x, swaps
    v, mom, var, mb, vb = np.zeros(d), np.zeros(d), np.zeros(d), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, value * v.astype(np.float32)[col], n) + b
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * weight / weight.sum()
        grad = np.bincount(col, value * err.astype(np.float32)[row], d) + l2 * v
        if m:
            change = 2 * penalty * np.bincount(crow, cvalue * v[ccol], m) / m
            grad += np.bincount(ccol, cvalue * change[crow], d)
        gb = err.sum()
        mom, var = 0.9 * mom + 0.1 * grad, 0.999 * var + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        v -= rate * (mom / c1) / (np.sqrt(var / c2) + 1e-9)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    out[used] = scale * v
    return Model(out, b, m)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, swapped: int = SWAPPED, penalty: float = 1.0, only=None) -> Model:
    """Fit on a bounded sample: at most per_class labelled documents of each class, those with the
    smallest hash of their id, weighted so that the classes count as they do among all labels, the toxic one
    by the root of its rarity more; swapped of them are read with identity terms swapped. All
    features are kept. only: a condition on labels' doc_id that rows to learn from must meet.

    Rows with a null doc_id or label are not learnt from; a document with several labels is toxic if
    any says so. No labelled rows: a constant model.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.where(only) if only is not None else known
    known = materialize(known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("_label")), "known-labels")
    of_class = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}  # two rows
    picked = [known.where(F.col("_label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    # at most 2 * per_class rows of an id and a label
    sample = docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id").select("_label", "text", F.xxhash64("doc_id").alias("at"))
    sample = materialize(sample, "toxicity-sample").repartition(max(2, docs.sparkSession.sparkContext.defaultParallelism))
    # the hash below which about `swapped` of the sample lie
    below = min(1.0, swapped / max(1, sum(min(n, per_class) for n in of_class.values())))
    below = int(below * (1 << 64)) - (1 << 63)

    def vectors(batches):
        for b in batches:
            for y, text, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                found = [(y, features(text))] + [(-1, c) for c in (changes(text) if zlib.crc32(at.to_bytes(8, "little", signed=True)) * (1 << 32) - (1 << 63) < below else [])]
                yield pa.record_batch(
                    [pa.array([at] * len(found)), pa.array([k for k, _ in found], pa.int32()), pa.array([[*t] for _, t in found], pa.list_(pa.int32())), pa.array([[*t.values()] for _, t in found], pa.list_(pa.int32()))],
                    names=["at", "y", "ids", "n"],
                )

    found = sample.mapInArrow(vectors, "at long, y int, ids array<int>, n array<int>").toArrow().combine_chunks()
    found = found.take(np.lexsort([np.asarray(found["at"]), np.asarray(found["y"])]))  # one order, wherever rows were made
    y = np.asarray(found["y"])

    def matrix(rows: pa.Table):
        ids, n = rows["ids"].combine_chunks(), rows["n"].combine_chunks()
        count = np.diff(np.asarray(ids.offsets))
        return np.repeat(np.arange(len(count), dtype=np.int32), count), np.asarray(ids.flatten()), np.asarray(n.flatten()).astype(np.float32)

    real, swaps = found.filter(pa.array(y >= 0)), found.filter(pa.array(y < 0))
    del found
    label = y[y >= 0]
    rare = (of_class.get(0, 0) / of_class[1]) ** 0.5 if of_class.get(1) else 1.0
    here = [max(1, int((label == c).sum())) for c in (0, 1)]
    weight = np.where(label == 1, of_class.get(1, 0) / here[1] * rare, of_class.get(0, 0) / here[0])
    return train(matrix(real), label, matrix(swaps), weight, penalty)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All rows of docs with a score column from 0 to 1; null and empty texts get the model's base rate."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))  # 4 MB, whatever the data
    models: list[Model] = []

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        if not models:
            models.append(Model(*shared.value))
        return pa.array(models[0].score_all(texts))

    return docs.withColumn(name, of(F.col(text)))


def held_out(doc_id=None):
    return F.coalesce(F.crc32((doc_id if doc_id is not None else F.col("doc_id")).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Learns only from labels of rows that aren't held out. A null doc_id is not held out; empty and
    null texts are scored; repeated rows are scored each; other columns are ignored; an empty docs
    gives no rows.
    """
    model = fit(docs, labels, only=~held_out(), **parameters)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
