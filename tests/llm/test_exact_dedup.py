import hashlib
from collections import Counter, defaultdict

from edges import DOCS, crowded, edge_docs, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same, connect

from keelson.llm import exact_dedup
from keelson.llm.common import read


def test_oracle(spark):
    folder = "/root/testdata/sf0.01"
    assert_same(exact_dedup.exact_dedup(spark, read(spark, folder, "documents")), connect(folder), exact_dedup.ORACLE)


def test_hot_groups_take_the_broadcast_path(spark):
    data = [(i, "hot" if i % 3 == 0 else f"text {i % 50}", "en", "s", 1) for i in range(3000)]
    docs = spark.createDataFrame(data, DOCS)
    want = rows(exact_dedup.exact_dedup(spark, docs, counters=1024))
    assert rows(exact_dedup.exact_dedup(spark, docs, counters=2)) == want
    heavy = exact_dedup.heavy_hitters(docs.selectExpr("unhex(sha2(text, 256)) as digest"), 4).collect()
    assert hashlib.sha256(b"hot").digest() in {bytes(r[0]) for r in heavy} and len(heavy) <= 4
    assert sum(r[3] for r in want) == 51


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12)), st.integers(1, 5))
def test_misra_gries_bound(keys, k):
    held = exact_dedup.misra_gries(keys, k)
    true = Counter(keys)
    assert len(held) <= k
    assert all(n <= true[x] for x, n in held.items())
    assert all(true[x] - held.get(x, 0) <= len(keys) / (k + 1) for x in true)


def test_edges(spark):
    docs = edge_docs(spark)
    out = exact_dedup.exact_dedup(spark, docs).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    by = defaultdict(list)
    for r in out:
        by[r["text_sha256"]].append(r)
    assert len(by) == len(groups)
    for text, ids in groups.items():
        got = by[hashlib.sha256(text.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        assert sorted(r["doc_id"] or -1 for r in got) == sorted(i or -1 for i in ids)
        assert {r["keep_id"] for r in got} == {max(known) if known else None}
        assert {r["group_size"] for r in got} == {len(ids)} and sum(r["kept"] for r in got) == 1
    assert len(exact_dedup.exact_dedup(spark, crowded(docs)).collect()) == len(out)
    assert exact_dedup.exact_dedup(spark, docs.limit(0)).count() == 0
