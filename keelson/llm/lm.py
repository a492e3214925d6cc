"""Language-model scores: stupid backoff over word n-grams, computed relationally.

Documents are read in blocks. The n-gram count tables are partitioned by hash: a block's n-grams are
exploded and counted, its rows (n-gram, count) go to the partitions of their hashes, which sum them over
the corpus and join the totals back to the same rows; a block then scores its documents.

* One order after the other: an n-gram can stand in another document only if both of its (n-1)-grams do, so
  a block sends only those n-grams of which both parts were found elsewhere. That leaves every count as it is.
* Rows travel packed: those of one block and one partition are a sorted array, not a row each.
* A block sends to at most FAN ranges of hashes. Where more partitions are needed, groups of FAN blocks are merged
  by range, and each merged table is sent on to FAN narrower ranges, and so forth: the number of rows sent is
  that of the blocks times FAN at each hop, and there is a hop for each power of FAN. Answers take the same way back.

N-grams are told apart by 64-bit hashes: of N distinct ones about N*N/2**65 pairs share a count.
"""

from __future__ import annotations

import uuid
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, small
from .files import get, put
from .texts import pieces_of, slices

ALPHA = 0.4
#: Words of the longest n-grams.
ORDER = 3
#: An unseen word counts as this many occurrences.
UNSEEN = 0.5
BLOCK_WORDS = 1_000_000
#: Ranges of hashes that one table is parted into, at most.
FAN = 256
#: Blocks or ranges of a task.
EACH = 2

MESSAGE = "g long, r long, cg long, cr long, keys binary, n binary"
ANSWER = "cg long, cr long, s long, totals binary"


def _pack(x: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.record_batch([pa.array(x, kinds[t]) for x, t in zip(zip(*rows), types)], names=names)


#: A-Z to a-z, and all ASCII white space to spaces.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256)], np.uint8)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of all texts, A-Z lower-cased, coded by a dictionary, and how many each text has."""
    flat, ends = pieces_of(texts, _FOLD)
    coded = flat.dictionary_encode()
    words = pc.ascii_rtrim(coded.dictionary, " ").cast(pa.large_binary())
    place, real = np.asarray(coded.indices), np.asarray(pc.binary_length(words)) > 0
    held = real[place]
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))
    return pa.DictionaryArray.from_arrays(pa.array(place[held], pa.int32()), words), np.bincount(text[held], minlength=len(texts))


class Block:
    """Words of a run of documents: sorted hashes of the distinct ones, and the place of each word in those."""

    def __init__(self, vocabulary: np.ndarray, words: np.ndarray, lengths: np.ndarray, doc_ids: list):
        self.vocabulary, self.words, self.lengths, self.doc_ids = vocabulary, words, lengths, doc_ids
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)

    def write(self, path: str) -> None:
        row = pa.record_batch(
            [pa.array([_pack_sorted(self.vocabulary)]), pa.array([_pack(self.words)]), pa.array([self.lengths.tolist()], pa.list_(pa.int64())), pa.array([self.doc_ids], pa.list_(pa.int64()))],
            names=["vocabulary", "words", "lengths", "doc_ids"],
        )
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(row)
        put(path, out.getvalue().to_pybytes())

    @classmethod
    def read(cls, path: str) -> Block:
        row = pa.ipc.open_stream(get(path)).read_all().to_pylist()[0]
        return cls(_unpack_sorted(row["vocabulary"]), _unpack(row["words"], np.uint32), np.array(row["lengths"], np.int64), row["doc_ids"])

    def grams(self, n: int, seen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of the distinct n-grams of which both (n-1)-grams are seen in other documents; the places of
        their last words; and which of the n-grams each of those is."""
        if n == 1:
            return self.vocabulary, np.arange(len(self.words)), self.words
        last = np.flatnonzero(self.place >= n - 1)
        last = last[(seen[last] > 0) & (seen[last - 1] > 0)]
        h = self.vocabulary[self.words]
        x = h[last - n + 1]
        with np.errstate(over="ignore"):
            for k in range(n - 2, -1, -1):
                x = x * np.uint64(0x9E3779B97F4A7C15) + h[last - k]
                x ^= x >> np.uint64(32)
                x *= np.uint64(0xD6E8FEB86659FD93)
                x ^= x >> np.uint64(32)
        keys, which = np.unique(x, return_inverse=True)
        return keys, last, which

    def elsewhere(self, grams, totals: np.ndarray) -> np.ndarray:
        """For each word how often the n-gram that it ends stands in other documents."""
        keys, last, which = grams
        # a document's own occurrences don't count for it
        _, at, own = np.unique(self.doc[last] * np.int64(len(keys) + 1) + which, return_inverse=True, return_counts=True)
        out = np.zeros(len(self.words), np.int64)
        out[last] = totals[which].astype(np.int64) - own[at]
        return out

    def scores(self, joints: list[np.ndarray], corpus_words: int) -> pa.RecordBatch:
        logs = np.log10(np.maximum(joints[0], UNSEEN) / np.maximum(corpus_words - self.lengths[self.doc], 1))
        for n, joint in enumerate(joints[1:], 2):
            last = np.flatnonzero(self.place >= n - 1)
            here, before = joint[last], joints[n - 2][last - 1]
            logs[last] = np.where(here > 0, np.log10(np.maximum(here, 1) / np.maximum(before, 1)), logs[last] + np.log10(ALPHA))
        total = np.bincount(self.doc, weights=logs, minlength=len(self.lengths))
        score = [round(t / n, 6) if n else None for t, n in zip(total.tolist(), self.lengths.tolist())]
        return pa.record_batch([pa.array(self.doc_ids, pa.int64()), pa.array(self.lengths), pa.array(score, pa.float64())], names=["doc_id", "n_words", "score"])


def _blocks(folder: str, block_words: int):
    def of(batches):
        part, made = TaskContext.get().partitionId(), 0
        ids, counts, chunks, held = [], [], [], 0

        def flush():
            flat = pa.chunked_array(chunks).unify_dictionaries().combine_chunks()
            flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
            h = np.array([xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()], dtype=np.uint64)
            index = np.asarray(flat.indices)
            used = np.zeros(len(h), bool)
            used[index] = True  # a text may be cut from a batch whose other words are of another block
            vocabulary = np.unique(h[used])
            words = np.searchsorted(vocabulary, h).astype(np.uint32)[index]
            path = f"{folder}/{part}-{made}-{uuid.uuid4().hex}.words"
            Block(vocabulary, words, np.array(counts, np.int64), ids).write(path)
            return _batch([(part, made, path, len(words))], "part int, made int, path string, n long")

        for b in batches:
            for at, to in slices(b.column(1), 6 * block_words):
                flat, n = split_words(b.column(1).slice(at, to - at))
                ids += b.column(0).slice(at, to - at).to_pylist()
                counts += n.tolist()
                chunks.append(flat)
                held += len(flat)
                if held >= block_words:
                    yield flush()
                    ids, counts, chunks, held, made = [], [], [], 0, made + 1
        if ids:
            yield flush()

    return of


def _messages(source: tuple[int, int], level: int, fan: int, keys: np.ndarray, n: np.ndarray) -> list[tuple]:
    """Rows of MESSAGE from a table of the level's ranges to the next level's: a row for each range it has keys in."""
    g, r = source
    bounds = np.array([((r * fan + j) << 64) // fan ** (level + 1) for j in range(1, fan)], dtype=np.uint64)
    cut = np.r_[0, np.searchsorted(keys, bounds), len(keys)]
    return [(g // fan, r * fan + j, g, r, _pack_sorted(keys[a:b]), _pack(n[a:b].astype(np.uint64))) for j, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]


def _rows(batches):
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def _merged(level: int, fan: int):
    """Tables of one group and range made one, and sent on to narrower ranges."""

    def of(batches):
        for node, rows in groupby(_rows(batches), lambda x: (x["g"], x["r"])):
            keys, n = zip(*((_unpack_sorted(x["keys"]), _unpack(x["n"], np.uint64)) for x in rows))
            merged, where = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(merged), np.uint64)
            np.add.at(total, where, np.concatenate(n))
            if out := _messages(node, level, fan, merged, total):
                yield _batch(out, MESSAGE)

    return of


def _totals(fan: int):
    """Where one group is left: the totals of a range's keys, for each table in the order it sent them."""

    def of(batches):
        for _, rows in groupby(_rows(batches), lambda x: (x["g"], x["r"])):
            rows = list(rows)
            keys, n = zip(*((_unpack_sorted(x.pop("keys")), _unpack(x.pop("n"), np.uint64)) for x in rows))
            merged, where = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(merged), np.uint64)
            np.add.at(total, where, np.concatenate(n))
            answers = np.split(total[where], np.cumsum([*map(len, keys)])[:-1])
            yield _batch([(x["cg"], x["cr"], x["r"] - x["cr"] * fan, _pack(t)) for x, t in zip(rows, answers)], ANSWER)

    return of


def _handed_down(fan: int):
    """The answers to a merged table, given to each of the tables that it was made of."""

    def of(batches):
        for _, rows in groupby(_rows(batches), lambda x: (x["g"], x["r"])):
            rows = list(rows)
            total = np.concatenate([_unpack(x["totals"], np.uint64) for x in rows if x["s"] >= 0])
            rows = [x for x in rows if x["s"] < 0]
            keys = [_unpack_sorted(x.pop("keys")) for x in rows]
            merged = np.unique(np.concatenate(keys))
            yield _batch([(x["cg"], x["cr"], x["r"] - x["cr"] * fan, _pack(total[np.searchsorted(merged, k)])) for x, k in zip(rows, keys)], ANSWER)

    return of


def _tasks(rows: DataFrame, n: int, number, *order: str) -> DataFrame:
    """Rows by their number from 0 to n-1, EACH numbers to a task."""
    return rows.repartitionById(max(1, -(-n // EACH)), F.floor(number / EACH).cast("int")).sortWithinPartitions(*order)


def exchange(messages: DataFrame, n_blocks: int, fan: int, hops: int) -> DataFrame:
    """The corpus totals of the keys of each message: ANSWER rows, cg the block that sent it and s its range."""

    def at_nodes(rows, level):
        ranges = fan**level
        groups = -(-n_blocks // ranges)
        return _tasks(rows, groups * ranges, F.col("g") * ranges + F.col("r"), *[c for c in ("g", "r", "s", "cg", "cr") if c in rows.columns])

    levels = [materialize(messages, "messages") if hops > 1 else messages]
    for level in range(1, hops):
        levels.append(materialize(at_nodes(levels[-1], level).mapInArrow(_merged(level, fan), MESSAGE), "messages"))
    answers = at_nodes(levels[-1], hops).mapInArrow(_totals(fan), ANSWER)
    for level in range(hops - 1, 0, -1):
        none = F.lit(None).cast("binary")
        sent = levels[level - 1].select("g", "r", "cg", "cr", F.lit(-1).cast("long").alias("s"), "keys", none.alias("totals"))
        back = answers.select(F.col("cg").alias("g"), F.col("cr").alias("r"), F.lit(0).cast("long").alias("cg"), F.lit(0).cast("long").alias("cr"), "s", none.alias("keys"), "totals")
        answers = at_nodes(sent.union(back), level).mapInArrow(_handed_down(fan), ANSWER)
    return answers


def _step(folder: str, n: int, order: int, fan: int, corpus_words: int):
    """For each block the answers of order n kept, and the n-grams of the next order sent, or the scores made. A block's counts lie in
    files that a task that runs twice writes twice alike."""
    kept = lambda block, k: f"{folder}/{block}.joint{k}"

    def of(batches):
        for number, rows in groupby(_rows(batches), lambda x: x["block"]):
            rows = list(rows)
            block = Block.read(rows[0]["path"])
            joints = [_unpack(get(kept(number, k)), np.int64) for k in range(1, n)]
            if n:
                totals = np.concatenate([np.zeros(0, np.uint64), *(_unpack(x["totals"], np.uint64) for x in rows[1:])])
                joints.append(block.elsewhere(block.grams(n, joints[-1] if joints else None), totals))
            if n == order:
                yield block.scores(joints, corpus_words)
                continue
            if n:
                put(kept(number, n), _pack(joints[-1]))
            keys, _, which = block.grams(n + 1, joints[-1] if joints else None)
            if out := _messages((number, 0), 0, fan, keys, np.bincount(which, minlength=len(keys))):
                yield _batch(out, MESSAGE)

    return of


def numbered(files: DataFrame) -> DataFrame:
    """Rows (part, made, path) with block, from 0 without gaps. Only the parts, one for each task that wrote, are
    put in one order."""
    per = files.groupBy("part").agg(F.count("*").alias("n"))
    ahead = per.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    ahead = materialize(ahead, "parts")
    return files.join(small(ahead, ahead.count()), F.col("part") == F.col("p")).select((F.col("ahead") + F.col("made")).alias("block"), "path")


def ways(n_blocks: int, most: int) -> tuple[int, int]:
    """(fan, hops): the fewest hops with at most so many ranges a table, for about as many ranges as blocks."""
    hops = 1
    while most**hops < n_blocks:
        hops += 1
    fan = 1
    while fan**hops < n_blocks:
        fan += 1
    return fan, hops


def lm_scores(spark: SparkSession, docs: DataFrame, order: int = ORDER, block_words: int = BLOCK_WORDS, most: int = FAN) -> DataFrame:
    """doc_id, n_words, score for each row of docs: the mean over a text's words of the base-10
    logarithm of their stupid-backoff score, counts taken over all documents less the text's own.

    S(w | v) = c(v w) / c(v) where the n-gram v w occurs in other documents, else 0.4 * S(w | v less
    its first word); v is the order - 1 words before w, or as many as there are, and without one S(w) =
    c(w) / N; a word that no other document has counts half an occurrence. Null and empty
    texts have no words and a null score; a very long text is a block of its own. Repeated rows are documents of
    their own; a null doc_id keeps its row; other columns are ignored; no rows give none.
    """
    folder = new_path(spark, "lm")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    files = materialize(slim.mapInArrow(_blocks(folder, block_words), "part int, made int, path string, n long"), "blocks")
    total, n_blocks = files.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    blocks = materialize(numbered(files), "numbered")
    fan, hops = ways(n_blocks, most)
    rows = blocks.select("block", F.lit(-1).cast("long").alias("s"), "path", F.lit(None).cast("binary").alias("totals"))
    for n in range(order):
        sent = _tasks(rows, n_blocks, F.col("block"), "block", "s").mapInArrow(_step(folder, n, order, fan, total), MESSAGE)
        answers = materialize(exchange(sent, n_blocks, fan, hops), "answers")
        back = answers.select(F.col("cg").alias("block"), "s", F.lit(None).cast("string").alias("path"), "totals")
        rows = blocks.select("block", F.lit(-1).cast("long").alias("s"), "path", F.lit(None).cast("binary").alias("totals")).union(back)
    return _tasks(rows, n_blocks, F.col("block"), "block", "s").mapInArrow(_step(folder, order, order, fan, total), "doc_id long, n_words long, score double")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, w FROM d WHERE len(w) > 0),
t AS (SELECT doc_id, n, w[i] AS c, CASE WHEN i > 1 THEN w[i-1] END AS b, CASE WHEN i > 2 THEN w[i-2] END AS a FROM p),
u AS (SELECT c AS w, count(*) AS k FROM t GROUP BY c), du AS (SELECT doc_id, c AS w, count(*) AS k FROM t GROUP BY ALL),
g AS (SELECT b, c, count(*) AS k FROM t WHERE b IS NOT NULL GROUP BY b, c), dg AS (SELECT doc_id, b, c, count(*) AS k FROM t WHERE b IS NOT NULL GROUP BY ALL),
h AS (SELECT a, b, c, count(*) AS k FROM t WHERE a IS NOT NULL GROUP BY a, b, c), dh AS (SELECT doc_id, a, b, c, count(*) AS k FROM t WHERE a IS NOT NULL GROUP BY ALL),
s AS (SELECT t.doc_id, t.n, t.a, t.b, u.k - du.k AS cc, ub.k - db.k AS cb, g.k - dg.k AS cbc, gab.k - dgab.k AS cab, h.k - dh.k AS cabc, (SELECT count(*) FROM t) - t.n AS rest
  FROM t JOIN u ON u.w = t.c JOIN du ON du.doc_id = t.doc_id AND du.w = t.c LEFT JOIN u ub ON ub.w = t.b LEFT JOIN du db ON db.doc_id = t.doc_id AND db.w = t.b
  LEFT JOIN g ON g.b = t.b AND g.c = t.c LEFT JOIN dg ON dg.doc_id = t.doc_id AND dg.b = t.b AND dg.c = t.c
  LEFT JOIN g gab ON gab.b = t.a AND gab.c = t.b LEFT JOIN dg dgab ON dgab.doc_id = t.doc_id AND dgab.b = t.a AND dgab.c = t.b
  LEFT JOIN h ON h.a = t.a AND h.b = t.b AND h.c = t.c LEFT JOIN dh ON dh.doc_id = t.doc_id AND dh.a = t.a AND dh.b = t.b AND dh.c = t.c),
l AS (SELECT doc_id, n, a, cab, cabc, CASE WHEN cbc > 0 THEN log10(cbc / cb) ELSE log10(greatest(cc, 0.5) / greatest(rest, 1)) + CASE WHEN b IS NULL THEN 0 ELSE log10(0.4) END END AS two FROM s),
r AS (SELECT doc_id, sum(CASE WHEN cabc > 0 THEN log10(cabc / cab) WHEN a IS NULL THEN two ELSE two + log10(0.4) END) / any_value(n) AS score FROM l GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, round(score, 6) AS score FROM d LEFT JOIN r USING (doc_id)
"""
