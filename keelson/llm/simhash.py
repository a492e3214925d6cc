"""SimHash near-duplicates by covering locality-sensitive hashing.

Each fingerprint bit gets a non-zero vector of radius+1 bits; table v keeps the bits whose vector has
an odd inner product with v. Any radius positions span a proper subspace, so some v is orthogonal to
all of them: two fingerprints within the radius agree on all bits that this table keeps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, small
from .components import components

WIDTH = 64
#: Distinct fingerprints of a bucket that one task compares with each other; larger buckets are split.
BUCKET = 256


def fingerprint(text: str | None, k: int = 3) -> int:
    """Majority of the XXH64 bits (seed 42) of all k-word shingles, repeats included; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < k:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        join, digest = b" ".join, xxhash.xxh64_intdigest
        hashes = [digest(join(x), 42) for x in zip(*(words[i:] for i in range(k)))]
    ones = np.zeros(WIDTH, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        block = np.array(hashes[at : at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for b in batches:
        fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.record_batch([b.column(0), b.column(2), pa.array(fps)], names=["doc_id", "text_hash", "fp"])


def _parity(x: int) -> int:
    return bin(x).count("1") & 1


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """One mask for each table over these bit positions: a pair within the radius agrees on one of them."""
    n = (1 << (radius + 1)) - 1
    vector = {bit: 1 + k % n for k, bit in enumerate(bits)}
    return [sum(1 << bit for bit in bits if _parity(vector[bit] & v)) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mask_tree(radius: int, levels: int) -> list[list[tuple[int, int, int]]]:
    """For each level rows of (path at the level before, path, mask). A level's masks keep all bits
    of the path before and cover the bits it left out, so sub-buckets lose no pair of their bucket."""
    n, full = (1 << (radius + 1)) - 1, (1 << WIDTH) - 1
    out, kept = [], {0: 0}
    for _ in range(levels):
        rows, grown = [], {}
        for path, mask in kept.items():
            free = [i for i in range(WIDTH) if not mask >> i & 1]
            for v, more in enumerate(covering_masks(free, radius)):
                grown[path * n + v] = mask | more
                rows.append((path, path * n + v, _signed((mask | more) & full)))
        out.append(rows)
        kept = grown
    return out


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _links_of(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a bucket's distinct fingerprints."""
    near = _popcount(fps[:, None] ^ fps[None, :]) <= radius
    left, out = np.ones(len(fps), bool), []
    for start in range(len(fps)):
        if not left[start]:
            continue
        left[start] = False
        edge = [start]
        while len(edge):
            new = near[edge].any(axis=0) & left
            left &= ~new
            edge = np.flatnonzero(new)
            out += [(start, int(k)) for k in edge]
    return out


def _bucket_links(radius: int):
    def of(batches):
        rest = None  # the last bucket of what was read: it may go on
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            path, key, fp = cols
            if not len(path):
                continue
            starts = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (key[1:] != key[:-1])])
            rest = [x[starts[-1] :] for x in cols]
            yield from link(fp[: starts[-1]], starts[:-1])
        if rest is not None and len(rest[0]) > 1:
            yield from link(rest[2], np.array([0]))

    def link(fp, starts):
        if not len(starts):
            return
        unsigned = fp.view(np.uint64)
        sizes = np.diff(np.r_[starts, len(fp)])
        two = starts[sizes == 2]
        two = two[_popcount(unsigned[two] ^ unsigned[two + 1]) <= radius]
        a, b = [fp[two]], [fp[two + 1]]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            if pairs := _links_of(unsigned[s : s + n], radius):
                x = np.array(pairs) + s
                a.append(fp[x[:, 0]])
                b.append(fp[x[:, 1]])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return of


def links(fps: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: links among distinct fingerprints (column fp) that keep every component of the
    graph of all pairs within the radius. Buckets above the bound are dealt out again by the masks of
    the next level; after three levels so few bits are free that a bucket is small by construction."""
    spark = fps.sparkSession
    tree = mask_tree(radius, 3)
    n = len(tree[0])
    rows = fps.select(F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"), F.col("fp").alias("fp")) for _, p, m in tree[0]])).alias("r")).select("r.*")
    done = []
    for level in range(3):
        if level == 2:
            done.append(rows)
            break
        over = materialize(rows.groupBy("path", "key").count().where(F.col("count") > bucket).select("path", "key"), "large-buckets")
        large = over.count()
        if not large:
            done.append(rows)
            break
        over = small(over, large)
        done.append(rows.join(over, ["path", "key"], "left_anti"))
        hot = rows.join(over, ["path", "key"], "left_semi").select("path", "fp")
        # a table of (2**(radius+1)-1)**levels rows, whatever the data
        masks = spark.createDataFrame(tree[level + 1], "at int, path int, mask long").groupBy("at").agg(F.collect_list(F.struct("path", "mask")).alias("masks"))
        hot = hot.withColumnRenamed("path", "at").join(F.broadcast(masks), "at").select("fp", F.explode("masks").alias("m"))
        rows = hot.select(F.col("m.path").alias("path"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"), "fp")
    found = None
    for k, part in enumerate(done):
        part = part.select((F.col("path") + k * n**3).alias("path"), "key", "fp")
        found = part if found is None else found.union(part)
    ordered = found.repartition("path", "key").sortWithinPartitions("path", "key", "fp")
    return ordered.mapInArrow(_bucket_links(radius), "a long, b long")


def _grouped(docs: DataFrame, radius: int) -> DataFrame:
    """doc_id, text_hash, fp, component (a fingerprint), component_id for each row of docs."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    of = materialize(slim.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long"), "fingerprints")
    classes = materialize(of.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = materialize(components(links(classes.select("fp"), radius)), "components")
    joined = classes.join(found, classes.fp == found.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    joined = materialize(joined, "joined")
    ids = materialize(joined.groupBy(F.col("component").alias("c")).agg(F.min("rep").alias("component_id")), "ids")
    named = materialize(joined.join(ids, joined.component == ids.c).select(F.col("fp").alias("f"), "component", "component_id"), "named")
    return of.join(named, of.fp == named.f).drop("f")


def near_duplicates(spark: SparkSession, docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id reachable) for each row of docs.

    Null and empty texts have fingerprint zero and are linked like any others. Repeated rows each
    appear. A null doc_id keeps its row; it names a component only if all of the component's ids are
    null, and then the component is null. Other columns are ignored; no rows give none.
    """
    return _grouped(docs, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, radius: int = 3) -> DataFrame:
    """The rows of docs, all columns, of one document of each component: that with the smallest
    doc_id (a null one only if there is no other) and, of several texts with it, the smallest hash.
    Rows that repeat both doc_id and text are one document.
    """
    rows = materialize(_grouped(docs, radius), "grouped")
    first = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    least = materialize(first.groupBy(F.col("component").alias("c")).agg(F.min("text_hash").alias("least")), "least")
    second = first.join(least, first.component == least.c).where("text_hash <> least")
    gone = rows.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_hash").union(second.select("doc_id", "text_hash"))
    a, b = fresh(docs, "_id"), fresh(docs, "_hash")
    gone = materialize(gone.distinct().toDF(a, b), "near-copies")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(a)) & (F.xxhash64("text") == F.col(b))
    return docs.join(small(gone, gone.count()), same, "left_anti")
