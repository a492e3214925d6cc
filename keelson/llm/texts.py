"""Arrow helpers for whole texts: batches cut by bytes, and texts cut at blanks without a copy of each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at once.
CHUNK_BYTES = 4 << 20
#: ASCII letters in lower case, other ASCII as blanks, and the bytes of other characters as they are.
WORDS = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256)], np.uint8)


def slices(texts: pa.Array, most: int = CHUNK_BYTES):
    """(from, to) of runs of texts with about so many bytes, or of one text."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), dtype=np.int64)
    at = 0
    while at < len(texts):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield at, to
        at = to


def pieces_of(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All texts, their bytes mapped by the table, cut after each blank, with an empty piece after each text;
    and the places of the empty ones. The pieces share one copy of the texts. Null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    data, ends = table[raw[offsets[0] : offsets[-1]]], offsets[1:] - offsets[0]
    cut = np.zeros(len(data) + 1, bool)
    np.equal(data, 32, out=cut[1:])
    cut[ends[np.diff(offsets) > 0]] = True
    inner = np.flatnonzero(cut)
    after = np.searchsorted(inner, ends, side="right")
    edges = np.concatenate([[0], np.insert(inner, after, ends)])
    flat = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data))
    return flat, after + np.arange(len(ends))


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of all texts, and for each pair of a text and a word that it holds the number of
    the text and of the word. Words are lower-cased runs of ASCII letters and non-ASCII characters."""
    flat, ends = pieces_of(texts, WORDS)
    coded = flat.dictionary_encode()
    low = pc.utf8_lower(pc.ascii_rtrim(coded.dictionary, " ")).dictionary_encode()
    words, real = low.dictionary, np.asarray(pc.binary_length(low.dictionary)) > 0
    word = np.asarray(low.indices)[np.asarray(coded.indices)]
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))
    held, n = real[word], np.int64(max(len(words), 1))
    pairs = np.sort(text[held] * n + word[held])
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    return words, pairs // n, pairs % n


def prefix_sums(words: pa.Array, lengths: tuple[int, ...]):
    """For each length, and last for whole words: the places of the words longer than that (all but empty ones
    for whole words), and 64-bit hashes of their first so many bytes. No word is a Python object."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    start, size = offsets[:-1] - offsets[0], np.diff(offsets)
    with np.errstate(over="ignore"):
        # a sum of bytes times odd numbers that go with their place in the word, modulo 2**64
        powers = np.cumprod(np.full(int(size.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(start, size)], out=run[1:])
        for tag, n in enumerate((*lengths, None)):
            at = np.flatnonzero(size > (n or 0))
            x = run[start[at] + (size[at] if n is None else n)] - run[start[at]] + np.uint64(tag + 1) * np.uint64(0xD1B54A32D192ED03)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            yield at, x ^ (x >> np.uint64(31))
