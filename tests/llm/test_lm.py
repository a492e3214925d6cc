import math
from collections import Counter

import numpy as np
import pytest
from edges import crowded, edge_docs, rows
from oracle import assert_same, connect

from keelson.llm import lm
from keelson.llm.common import read


def test_oracle(spark):
    folder = "/root/testdata/sf0.001"
    assert_same(lm.lm_scores(spark, read(spark, folder, "documents")), connect(folder), lm.ORACLE)


def plain_order(texts, order):
    split = [(t or "").encode().lower().split() for t in texts]
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    all_of = sum(map(grams, split), Counter())
    total, out = sum(map(len, split)), []
    for w in split:
        own, logs = grams(w), []
        left = lambda g: all_of[g] - own[g]
        for i in range(len(w)):
            n, penalty = min(order, i + 1), 0
            while n > 1 and not left(tuple(w[i - n + 1 : i + 1])):
                n, penalty = n - 1, penalty + math.log10(0.4)
            g = tuple(w[i - n + 1 : i + 1])
            logs.append(penalty + math.log10(left(g) / left(g[:-1]) if n > 1 else max(left(g), 0.5) / max(total - len(w), 1)))
        out.append((len(w), round(sum(logs) / len(w), 6) if w else None))
    return out


def same(got, want):
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(g[2] == w[2] or abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want))


def expected(data, order):
    return sorted(((r["doc_id"], *s) for r, s in zip(data, plain_order([r["text"] for r in data], order))), key=repr)


@pytest.mark.parametrize("block_words, most", [(700, 256), (1_000, 5)])
def test_blocks_and_hops_do_not_change_scores(spark, block_words, most):
    docs = read(spark, "/root/testdata/sf0.001", "documents").limit(80)
    same(rows(lm.lm_scores(spark, docs.repartition(5), block_words=block_words, most=most)), expected(docs.collect(), 3))


@pytest.mark.parametrize("order", [1, 2, 4])
def test_orders(spark, order):
    docs = edge_docs(spark).union(read(spark, "/root/testdata/sf0.001", "documents").select(*edge_docs(spark).columns).limit(40))
    same(rows(lm.lm_scores(spark, docs.repartition(3), block_words=700, order=order)), expected(docs.collect(), order))


def test_edges(spark):
    docs = edge_docs(spark)
    out = rows(lm.lm_scores(spark, docs))
    same(out, expected(docs.collect(), 3))
    assert rows(lm.lm_scores(spark, crowded(docs))) == out
    assert lm.lm_scores(spark, docs.limit(0)).count() == 0


def test_ways():
    assert lm.ways(0, 256) == lm.ways(1, 256) == (1, 1) and lm.ways(135, 256) == (135, 1) and lm.ways(257, 256) == (17, 2)
    fan, hops = lm.ways(27_000_000, 256)
    assert hops == 4 and fan <= 256 and fan**hops >= 27_000_000


def test_messages_grow_with_the_blocks(spark, monkeypatch):
    """A table sends to at most fan ranges at each hop, so twice the blocks send about twice as many messages."""
    sent, whole, counted = {}, lm.materialize, []
    monkeypatch.setattr(lm, "materialize", lambda df, name: counted.append(whole(df, name)) or counted[-1])
    for n in (32, 64):
        fan, hops = 4, 3
        keys = np.sort(np.random.default_rng(n).integers(0, 1 << 63, (n, 300)).astype(np.uint64) * np.uint64(2), axis=1)
        keys[1:, :50] = keys[0, :50]
        keys = np.sort(keys, axis=1)
        made = [m for b in range(n) for m in lm._messages((b, 0), 0, fan, keys[b], np.full(300, 2))]
        counted.clear()
        answers = lm.exchange(spark.createDataFrame(made, lm.MESSAGE), n, fan, hops).collect()
        sent[n] = [x.count() for x in counted]
        assert len(sent[n]) == hops and sent[n][0] == n * fan
        everything, total = np.unique(keys, return_counts=True)
        for b in range(n):
            mine = sorted((r for r in answers if r["cg"] == b), key=lambda r: r["s"])
            got = np.concatenate([lm._unpack(r["totals"], np.uint64) for r in mine])
            assert (got == 2 * total[np.searchsorted(everything, keys[b])]).all()
    assert sum(sent[64]) <= 2 * sum(sent[32])


def test_only_ngrams_whose_parts_recur_are_sent():
    """c d e is sent, since c d and d e stand elsewhere; a b c isn't, since a b doesn't."""
    block = lm.Block(np.sort(np.array([11, 22, 33, 44, 55], np.uint64)), np.array([0, 1, 2, 3, 4], np.uint32), np.array([5]), [1])
    assert block.grams(3, np.array([1, 0, 1, 1, 1]))[1].tolist() == [3, 4]
