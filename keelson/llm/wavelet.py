"""Token ids in wavelet matrix files, one for each shard of consecutive documents.

A file holds, from the highest bit down, one bit-plane for each bit of an id: plane l has bit l of
the ids in the order that the planes above have sorted them to (zeros first, stable). With counts of
ones every RANK bits, access, rank and select take one step a plane, and so do counting an id and
finding its occurrences.

Layout, little-endian: magic "KWM2"; uint32 planes, documents; uint64 ids; uint64 zeros of each plane;
uint32 length of the compressed document table, of the rank directory, of each compressed plane; the table (zstandard; int64
doc_id, uint8 known, uint32 length, one array after the other); the directory (zstandard; for each plane, uint32 ones before each
block of RANK bits and in all); the planes (zstandard; bits packed little-endian).
"""

from __future__ import annotations

import gc
import json
import os
import struct
import uuid
import zlib
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, small
from .files import get, put
from .texts import pieces_of, slices

MAGIC = b"KWM2"
RANK = 512
END_ID = 1
#: Text bytes of a shard, which are encoded at once.
SHARD_BYTES = 8 << 20
#: Words that a worker keeps.
_WORDS = 1_000_000

# The parts of a tokenizer's file that word for word encoding relies on.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space between pieces of text; any other kind stays in a piece and is left to the library.
BLANKS = b" \t\n\r"
#: Letters whose lower case is one letter, and that are their own normal form: ASCII and Latin, without dotted I.
LETTERS = "".join(chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x180)] if c not in (0xD7, 0xF7, 0x130))
#: ASCII signs other than the apostrophe, which takes letters with it.
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and c != 39)

_blank = np.arange(256, dtype=np.uint8)
_blank[list(BLANKS)] = 32
#: Ids of words, and the tokenizers, kept between the tasks of a worker.
_seen: dict[str, bytes] = {}
_tokenizers: dict = {}


def by_words(spec: dict) -> bool:
    """Whether a tokenizer's file says that white space ends a token, that letters and signs never share one,
    and that each word ends with a token of its own kind."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    first, *rest = pre.get("pretokenizers") or [{}]
    split = first.get("pattern") == {"Regex": PATTERN} and first.get("behavior") == "Removed" and first.get("invert") is True
    rest = [(p["type"], p.get("use_regex"), p.get("add_prefix_space")) for p in rest]
    added = [t["content"] for t in spec.get("added_tokens") or []]
    return (
        spec.get("normalizer") == NORMALIZER
        and pre.get("type") == "Sequence" and split and rest == [("ByteLevel", False, False)]
        and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not model.get("unk_token")
        and not any(set(t) & set(" \t\n\r") or not t.lstrip(LETTERS).lstrip(SIGNS) for t in added)
    )


def _joined(found: list[bytes], kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs one after the other, where each starts, and how long it is."""
    n = np.fromiter(map(len, found), np.int32, len(found)) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(found), kind), np.cumsum(n, dtype=np.int32) - n, n


def _gather(ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of ids one after the other."""
    before = np.cumsum(n, dtype=np.int64) - n
    at = np.repeat((start - before).astype(np.int64), n)
    at += np.arange(len(at))
    return ids.take(at)


class Encoder:
    """Ids of whole texts, END_ID after each. Where the tokenizer's file says that no token spans white space
    or a letter and a sign, each distinct word is encoded once and looked up after; any other
    tokenizer reads the texts as they are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if path not in _tokenizers:
            _tokenizers.clear()
            _seen.clear()
            _tokenizers[path] = self._load(path)
        self.whole, self.plain, self.closes, self.kind = _tokenizers[path]
        self.planes = max(self.whole.get_vocab_size() - 1, END_ID).bit_length()

    @staticmethod
    def _load(path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        whole = Tokenizer.from_file(path)
        kind = np.uint16 if max(whole.get_vocab_size() - 1, END_ID) < 1 << 16 else np.uint32
        if not by_words(spec):
            return whole, None, None, kind
        # the same model, for lower-case Latin words that are parted by single spaces
        plain = Tokenizer.from_file(path)
        plain.normalizer = normalizers.Sequence([])
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        closes = np.zeros(whole.get_vocab_size(), bool)
        for token, i in whole.get_vocab(with_added_tokens=False).items():
            closes[i] = token.endswith("</w>")
        return whole, plain, closes, kind

    def _bytes(self, e) -> bytes:
        return np.array(e.ids, self.kind).tobytes()

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case Latin words: as text of many words, parted again where a token ends a word."""
        out, width = [], np.dtype(self.kind).itemsize
        for at in range(0, len(words), 1024):
            some = words[at : at + 1024]
            (e,) = self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(e.ids, self.kind)
            ends = ((np.flatnonzero(self.closes[ids]) + 1) * width).tolist()
            if len(ends) != len(some):
                raise ValueError("the tokenizer doesn't end each word with a token of its own")
            raw = ids.tobytes()
            out += [raw[i:j] for i, j in zip([0, *ends], ends)]
        return out

    def _ids_of(self, units: list[str], latin: np.ndarray) -> list[bytes]:
        found = [*map(_seen.get, units)]
        new = [k for k, x in enumerate(found) if x is None]
        if len(_seen) + len(new) > _WORDS:  # drop the oldest third
            for w in [*islice(_seen, len(_seen) // 3)]:
                del _seen[w]
        easy = latin[new].tolist()
        a, b = [k for k, x in zip(new, easy) if x], [k for k, x in zip(new, easy) if not x]
        words, rest = [units[k] for k in a], [units[k] for k in b]
        made = dict(zip(words, self._learn(words)))
        made.update(zip(rest, map(self._bytes, self.whole.encode_batch_fast(rest, add_special_tokens=False))))
        for k in new:
            found[k] = made[units[k]]
        if len(made) <= _WORDS // 2:  # many words of one text aren't kept
            _seen.update(made)
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, END_ID after each text, and how many each has."""
        if self.plain is None:
            found = [self._bytes(e) for e in self.whole.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            end = np.array([END_ID], self.kind).tobytes()
            ids, _, n = _joined([x + end for x in found], self.kind)
            return ids, n.astype(np.int64)
        flat, ends = pieces_of(texts, _blank)
        coded = flat.dictionary_encode()
        pieces, place = coded.dictionary, np.asarray(coded.indices)
        is_end = np.asarray(pc.binary_length(pieces)) == 0
        word = pc.ascii_rtrim(pieces, " ")
        core, sign = pc.ascii_rtrim(word, SIGNS), pc.utf8_ltrim(word, LETTERS)
        latin = pc.equal(pc.add(pc.binary_length(core), pc.binary_length(sign)), pc.binary_length(word))  # letters, then signs
        units = pc.if_else(latin, pc.utf8_lower(core), word).dictionary_encode()
        marks = pc.if_else(latin, sign, "").dictionary_encode()
        easy = np.zeros(len(units.dictionary), bool)
        easy[np.asarray(units.indices)] = np.asarray(latin)
        words, first = units.dictionary.to_pylist(), marks.dictionary.to_pylist()
        easy &= np.asarray(pc.binary_length(units.dictionary)) > 0
        ids, start, n = _joined(self._ids_of(words, easy) + self._ids_of(first, np.zeros(len(first), bool)) + [np.array([END_ID], self.kind).tobytes()], self.kind)
        # each piece is a word and its signs; the piece that ends a text is END_ID
        pair = np.stack([np.where(is_end, len(n) - 1, np.asarray(units.indices)), np.asarray(marks.indices) + len(words)], axis=1)
        own = n[pair]
        ids, n = _gather(ids, start[pair].ravel(), own.ravel()), own.sum(axis=1)
        start = np.cumsum(n) - n
        size = n[place]
        upto = np.cumsum(size, dtype=np.int64)[ends]
        return _gather(ids, start[place], size), np.diff(upto, prepend=0)


def _before_blocks(packed: np.ndarray) -> np.ndarray:
    """Ones before each block of RANK bits of a plane, and in all of it."""
    ones = np.bitwise_count(packed)
    ones = np.pad(ones, (0, -len(ones) % (RANK // 8))).reshape(-1, RANK // 8).sum(axis=1, dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(ones)]).astype("<u4")


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, planes: int = 16) -> bytes:
    """The file of a shard."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids], np.uint8)
    table = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + known.tobytes() + np.asarray(lengths, "<u4").tobytes()
    zeros, packed, ranks, row = [], [], [], ids
    for level in range(planes - 1, -1, -1):
        if level == 7:
            row = row.astype(np.uint8)  # the planes above have sorted the higher bits
        one = (row & row.dtype.type(1 << level)) != 0
        bits = np.packbits(one, bitorder="little")
        packed.append(squeeze(bits.tobytes()))
        ranks.append(_before_blocks(bits))
        down, split = np.empty_like(row), len(row) - int(np.count_nonzero(one))
        np.compress(one, row, out=down[split:])
        np.logical_not(one, out=one)
        np.compress(one, row, out=down[:split])
        zeros.append(split)
        row = down
    body = [squeeze(table), squeeze(np.concatenate(ranks).tobytes()), *packed]
    head = MAGIC + struct.pack("<IIQ", planes, len(doc_ids), len(ids)) + struct.pack(f"<{planes}Q", *zeros)
    return head + struct.pack(f"<{planes + 2}I", *map(len, body)) + b"".join(body)


class WaveletMatrix:
    """A file opened for queries."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.planes, n_docs, self.n = struct.unpack_from("<IIQ", data, 4)
        self.zeros = struct.unpack_from(f"<{self.planes}Q", data, 20)
        at = 20 + 8 * self.planes
        sizes = struct.unpack_from(f"<{self.planes + 2}I", data, at)
        at += 4 * (self.planes + 2)
        parts = []
        for size in sizes:
            parts.append(data[at : at + size])
            at += size
        loose = zstandard.ZstdDecompressor().decompress
        table, self._directory, self.packed = loose(parts[0]), parts[1], [*map(loose, parts[2:])]
        ids, known = np.frombuffer(table, "<i8", n_docs), np.frombuffer(table, np.uint8, n_docs, 8 * n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known)]
        self.lengths = np.frombuffer(table, "<u4", n_docs, 9 * n_docs).astype(np.int64)

    @cached_property
    def ranks(self) -> np.ndarray:
        """Ones before each block of RANK bits, a row for each plane; read when first asked for."""
        raw = zstandard.ZstdDecompressor().decompress(self._directory)
        return np.frombuffer(raw, "<u4").reshape(self.planes, -1)

    def _bit(self, plane: int, i: int) -> int:
        return self.packed[plane][i >> 3] >> (i & 7) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits."""
        block, p = i // RANK, self.packed[plane]
        got = int(self.ranks[plane][block])
        start, end = block * RANK // 8, i >> 3
        got += int.from_bytes(p[start:end], "little").bit_count()
        return got + ((p[end] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def access(self, i: int) -> int:
        out = 0
        for k in range(self.planes):
            one = self._bit(k, i)
            out = out << 1 | one
            ones = self._ones(k, i)
            i = self.zeros[k] + ones if one else i - ones
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(self.planes):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.planes - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of the id among positions lo to hi-1."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(plane, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def occurrence(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of the id."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for plane in range(self.planes - 1, -1, -1):
            one = token >> (self.planes - 1 - plane) & 1
            i = self._select(plane, one, i - self.zeros[plane] if one else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids in order: the planes' sorting undone from the lowest up."""
        row = np.zeros(self.n, np.uint8)
        for k in range(self.planes - 1, -1, -1):
            level = self.planes - 1 - k
            if level in (8, 16):
                row = row.astype(np.uint16 if level == 8 else np.uint32)
            one = np.unpackbits(np.frombuffer(self.packed[k], np.uint8), count=self.n, bitorder="little").view(bool)
            up = np.empty_like(row)
            up[np.flatnonzero(one)] = row[self.zeros[k] :] | row.dtype.type(1 << level)
            np.logical_not(one, out=one)
            up[np.flatnonzero(one)] = row[: self.zeros[k]]
            row = up
        return row


def write_shards(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every text, append END_ID, and write wavelet matrix files in ascending doc_id order.

    Returns the manifest (part, shard, path, n_tokens, n_docs), a table in the shared folder, whose order by
    part and shard is that of the documents. A task that runs twice writes other files; only those
    that the manifest names count.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = keyed.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches):
        gc.disable()  # millions of words, no cycles
        encode, part = Encoder(tokenizer), TaskContext.get().partitionId()
        ids, names, lengths, held, shard = [], [], [], 0, 0

        def flush():
            n = np.concatenate(lengths)
            path = f"{folder}/{part:06d}-{shard:06d}-{uuid.uuid4().hex}.kwm"
            put(path, build(np.concatenate(ids), names, n, encode.planes))
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([path]), pa.array([int(n.sum())]), pa.array([len(n)])], names=["part", "shard", "path", "n_tokens", "n_docs"])

        for b in batches:
            for at, to in slices(b.column(1), shard_bytes):
                some = b.slice(at, to - at)
                tokens, n = encode(some.column(1))
                ids.append(tokens)
                lengths.append(n)
                names += some.column(0).to_pylist()
                held += int(pc.sum(pc.binary_length(some.column(1))).as_py() or 0)
                if held >= shard_bytes:
                    yield flush()
                    ids, names, lengths, held, shard = [], [], [], 0, shard + 1
        if names:
            yield flush()
        gc.enable()

    return materialize(ordered.mapInArrow(write, "part int, shard int, path string, n_tokens long, n_docs long"), "manifest")


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with base, the ids of all files before. A part's files are numbered within it; only the
    sums of the parts, one for each task that wrote, are put in one order."""
    of_part = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = of_part.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    ahead = materialize(ahead, "parts")
    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    within = manifest.withColumn("within", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    return within.join(small(ahead, ahead.count()), F.col("part") == F.col("p")).select("path", (F.col("ahead") + F.col("within")).alias("base"))


def read_shards(manifest: DataFrame, files_a_task: int = 4) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for each document, from the files."""
    spread = placed(manifest).repartition(max(1, -(-manifest.count() // files_a_task)))

    def of(batches):
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                m = WaveletMatrix(get(path))
                ids, ends = m.decode().astype("<u4"), np.cumsum(m.lengths)
                starts = ends - m.lengths
                crcs = [zlib.crc32(ids[a:e]) for a, e in zip(starts.tolist(), ends.tolist())]
                yield pa.record_batch([pa.array(m.doc_ids, pa.int64()), pa.array(starts + base), pa.array(m.lengths), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(of, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(spark: SparkSession, docs: DataFrame, tokenizer: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the files to the shared folder and read them back: doc_id, start (ids of all documents
    before), n_tokens (with the end id), ids_crc32 for each row of docs.

    Null and empty texts have the end id only. A null doc_id comes first; rows with the same doc_id
    are ordered by text; a very long text is a shard of its own. Other columns are ignored; no rows give none.
    """
    return read_shards(write_shards(spark, docs, tokenizer, new_path(spark, "wavelet"), shard_bytes))
