import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from edges import LONG, crowded, edge_docs, rows
from tokenizers import Tokenizer

from keelson.llm import wavelet
from keelson.llm.common import read

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def expected(docs, tokenizer):
    out, start = [], 0
    ordered = sorted(((r["doc_id"], r["text"] or "") for r in docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    for d, t in ordered:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents(spark, tokenizer):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    want = expected(docs.collect(), tokenizer)
    for size in (20_000, 8 << 20):
        got = wavelet.token_shards(spark, docs.repartition(3), PATH, shard_bytes=size)
        assert sorted(map(tuple, got.collect())) == want


def test_words_alone_make_the_ids_of_texts(tokenizer):
    texts = ["It's O'Neil's 100,000 %%% a.b -- x0y 007", "ÀÉÎ été ǅ İstanbul ΣΑΣ straße", "é ́x a b c", "don't!!! 'S 's <|endoftext|>x", "", " ", "\n\n a\tb \r\n", "漢字かな 𝒳 🙂🙂", "..., (x) [y] {z} _u_ ~`^"]
    ids, lengths = wavelet.Encoder(PATH)(pa.array(texts))
    for t, own in zip(texts, np.split(ids, np.cumsum(lengths)[:-1])):
        assert own.tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1], t


def test_other_tokenizers_read_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    texts = ["It's O'Neil's 100,000 %%% a.b -- x0y", "two  spaces here\n\nnew", "", None, "Été ΣΑΣ 漢字 🙂"]
    ids, lengths = wavelet.Encoder(path)(pa.array(texts))
    for t, own in zip(texts, np.split(ids, np.cumsum(lengths)[:-1])):
        assert own.tolist() == [*other.encode(t or "", add_special_tokens=False).ids, 1], t
    docs = read(spark, "/root/testdata/sf0.001", "documents").limit(50)
    got = wavelet.token_shards(spark, docs, path, shard_bytes=20_000)
    assert sorted(map(tuple, got.collect())) == expected(docs.collect(), other)


def test_which_tokenizers_are_read_word_by_word():
    spec = json.loads(open(PATH, encoding="utf-8").read())
    assert wavelet.by_words(spec)
    for change in ({"normalizer": None}, {"pre_tokenizer": None}, {"added_tokens": [{"content": "ab."}]}, {"added_tokens": [{"content": "<a b>"}]}):
        assert not wavelet.by_words(spec | change), change
    assert not wavelet.by_words(json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()))


def test_ids_over_16_bits():
    ids = np.random.default_rng(1).integers(0, 1 << 20, 3000).astype(np.uint32)
    m = wavelet.WaveletMatrix(wavelet.build(ids, [7], np.array([3000]), planes=20))
    assert (m.decode() == ids).all() and m.access(1234) == ids[1234] and m.count(int(ids[5])) == (ids == ids[5]).sum()


def test_words_forgotten_are_learnt_again(monkeypatch, tokenizer):
    monkeypatch.setattr(wavelet, "_WORDS", 40)
    rng = np.random.default_rng(2)
    encode = wavelet.Encoder(PATH)
    for _ in range(6):
        texts = [" ".join(f"{'abcdefgh'[a]}x{'stuvwxyz'[b]}é," for a, b in rng.integers(0, 8, (30, 2))) for _ in range(3)]
        ids, lengths = encode(pa.array(texts))
        for t, own in zip(texts, np.split(ids, np.cumsum(lengths)[:-1])):
            assert own.tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aZéÉßſŉİıÿŸ'.,$!09 \n\t\r\x0b\x0c\x85\xa0\u0300\u0308\u030c\u0331×÷"), st.characters(codec="utf-8")), max_size=30), max_size=6))
def test_any_texts(texts):
    whole = Tokenizer.from_file(PATH) if "t" not in _kept else _kept["t"]
    _kept["t"] = whole
    ids, lengths = wavelet.Encoder(PATH)(pa.array(texts, pa.string()))
    assert len(lengths) == len(texts) and lengths.sum() == len(ids)
    for t, own in zip(texts, np.split(ids, np.cumsum(lengths)[:-1])):
        assert own.tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1], t


_kept: dict = {}


def test_queries_on_a_file():
    rng = np.random.default_rng(3)
    ids = (rng.zipf(1.3, 5000) % 49408).astype(np.uint16)
    m = wavelet.WaveletMatrix(wavelet.build(ids, [1, None], np.array([2000, 3000])))
    assert (m.decode() == ids).all() and m.doc_ids == [1, None] and m.lengths.tolist() == [2000, 3000]
    for i in (0, 1, 511, 512, 513, 4999):
        assert m.access(i) == ids[i]
    for token in (1, 2, 5, 49407, int(ids[77])):
        assert m.count(token) == (ids == token).sum()
        assert m.count(token, 100, 3100) == (ids[100:3100] == token).sum()
        for k, at in enumerate(np.flatnonzero(ids == token)[:20]):
            assert m.occurrence(token, k) == at
    with pytest.raises(IndexError):
        m.occurrence(1, 10**6)


def test_edges(spark, tokenizer):
    docs = edge_docs(spark)
    got = wavelet.token_shards(spark, docs, PATH)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == expected(docs.collect(), tokenizer)
    assert rows(wavelet.token_shards(spark, crowded(docs), PATH)) == rows(got)
    assert wavelet.token_shards(spark, docs.limit(0), PATH).count() == 0
    assert len(LONG) > 400_000
