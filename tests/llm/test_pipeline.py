"""The pipeline, each stage held against brute force on its own input."""

from collections import Counter

import corpus_pipeline as cp
import duckdb
from edges import LONG, ROWS, crowded, edge_docs
from test_decontaminate import held, shingles
from test_sharding import check
from test_simhash import plain_components, plain_fingerprint

from keelson.llm import mixing
from keelson.llm.common import materialize, read

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = read(spark, FOLDER, "documents")
    labels = {r["doc_id"]: r["toxic"] for r in read(spark, FOLDER, "labels").collect()}
    clean = materialize(cp.drop_toxic(spark, docs, FOLDER), "t")
    assert clean.columns == docs.columns
    kept = {r["doc_id"] for r in clean.collect()}
    assert sum((i not in kept) == bool(y) for i, y in labels.items()) / len(labels) > 0.95

    once = materialize(cp.one_of_near_copies(spark, clean, FOLDER), "t")
    group = plain_components({r["doc_id"]: plain_fingerprint(r["text"]) for r in clean.collect()})
    assert {r["doc_id"] for r in once.collect()} == {i for i, c in group.items() if i == c}

    apart = materialize(cp.drop_leaks(spark, once, FOLDER), "t")
    items = [shingles(r["text"]) for r in read(spark, FOLDER, "benchmark").collect()]
    free = [r["doc_id"] for r in once.collect() if not any(10 * held(r["text"], s) >= 8 * len(s) for s in items if s)]
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted(free)

    mixed = materialize(cp.to_weights(spark, apart, FOLDER), "t")
    apart.write.parquet(f"file://{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    want = Counter(dict(con.execute(f"SELECT doc_id, copies FROM ({mixing.ORACLE}) WHERE copies > 0").fetchall()))
    assert Counter(r["doc_id"] for r in mixed.collect()) == want and mixed.columns == docs.columns

    check(mixed.collect(), cp.to_shards(spark, mixed, FOLDER).collect(), 8, 80_000)


def test_run(spark):
    out = cp.run(spark, FOLDER)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "sharding"]
    assert out.count() > 0 and "shard" in out.columns


def test_edges(spark):
    for docs in (crowded(edge_docs(spark)), edge_docs(spark).limit(0)):
        columns = docs.columns
        for name, stage in cp.STAGES[:-1]:
            docs = materialize(stage(spark, docs, FOLDER), name)
            assert docs.columns == columns, name
        assert cp.to_shards(spark, docs, FOLDER).count() == docs.count()


def test_edge_rows(spark):
    docs = crowded(edge_docs(spark))
    texts = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    once, quick = texts(cp.one_of_near_copies(spark, docs, FOLDER)), ROWS[0][1]
    # of one text under two ids the smaller id stays, with its repeated row; of the texts without words the smallest id
    assert once[3, quick] == 2 and once[5, quick] == 0 and once[7, LONG] == 1
    assert [k for k in once if not (k[1] or "").strip()] == [(4, None)]
    assert texts(cp.drop_leaks(spark, docs, FOLDER)) == texts(docs)
    assert set(texts(cp.drop_toxic(spark, docs, FOLDER))) <= set(texts(docs))
    assert set(texts(cp.to_weights(spark, docs, FOLDER))) <= set(texts(docs))
