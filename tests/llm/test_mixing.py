from collections import defaultdict

from edges import crowded, edge_docs, rows
from oracle import assert_same, connect
from pyspark.sql import functions as F

from keelson.llm import mixing
from keelson.llm.common import read

FOLDER = "/root/testdata/sf0.001"


def test_oracle(spark):
    assert_same(mixing.mix(spark, read(spark, FOLDER, "documents")), connect(FOLDER), mixing.ORACLE)


def fill(budget, children):
    """children: name -> (weight, capacity). Shares by repeated rounds of water filling."""
    share, live = dict.fromkeys(children, 0.0), {c for c, (w, cap) in children.items() if cap > 0}
    left = float(budget)
    while live and left > 1e-6:
        total = sum(children[c][0] for c in live)
        full = {c for c in live if children[c][1] <= left * children[c][0] / total + 1e-9}
        if not full:
            for c in live:
                share[c] = left * children[c][0] / total
            break
        for c in full:
            share[c] = children[c][1]
            left -= children[c][1]
        live -= full
    return share


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = [("a", "x", "s1", 100), ("a", "x", "s2", 1000), ("a", "y", "s3", 10), ("b", "x", "s1", 5000), ("b", "z", "s9", 400)]
    weights = {"domain": {"a": 70, "b": 30}, "lang": {"x": 1, "y": 1, "z": 3}, "source": {"s1": 3, "s2": 1}}
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, n_tokens long")
    for total in (50, 900, 1500, 3000, 6510, 9000):
        got = {tuple(r)[:3]: r["budget"] for r in mixing.budgets(df, F.lit(total).cast("long"), weights, 1).collect()}
        w = lambda level, name: weights[level].get(name, 10)
        cap = defaultdict(int)
        for d, l, s, n in leaves:
            cap[d,] += n
            cap[d, l] += n
            cap[d, l, s] += n
        top = fill(total, {d: (w("domain", d), cap[d,]) for d in ("a", "b")})
        for d in top:
            langs = {l for x, l, _, _ in leaves if x == d}
            mid = fill(top[d], {l: (w("lang", l), cap[d, l]) for l in langs})
            for l in langs:
                low = fill(mid[l], {s: (w("source", s), cap[d, l, s]) for x, y, s, _ in leaves if (x, y) == (d, l)})
                for s, share in low.items():
                    assert abs(got[d, l, s] - share) <= 3, (total, d, l, s)
        assert sum(got.values()) <= total and sum(got.values()) >= min(total, 6510) - 10


def test_prefix_of_seeded_epochs(spark):
    docs = read(spark, FOLDER, "documents")
    out = mixing.mix(spark, docs, share=1.4, max_epochs=2)
    for leaf in out.groupBy("domain", "lang", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("taken"), F.first("budget").alias("budget"), F.max("n_tokens").alias("longest"), F.max("copies").alias("most"), F.min("copies").alias("least"), F.sum("n_tokens").alias("all")).collect():
        assert leaf["taken"] <= leaf["budget"] <= 2 * leaf["all"]
        assert leaf["taken"] + leaf["longest"] >= leaf["budget"]
        assert leaf["most"] - leaf["least"] <= 1
    assert rows(out) == rows(mixing.mix(spark, docs.repartition(7), share=1.4, max_epochs=2))


def test_slices_do_not_change_the_result(spark):
    docs = read(spark, FOLDER, "documents")
    got = []
    for slices in (2, 1024):
        slim, leaves = mixing.plan(spark, docs, mixing.default_domain(F.col("source")), mixing.WEIGHTS, 0.5, 2, 17, slices)
        got.append(rows(mixing.copies(slim, leaves, 17, slices).select("doc_id", "copies")))
    assert got[0] == got[1]


def test_edges(spark):
    docs = edge_docs(spark)
    out = rows(mixing.mix(spark, docs, share=0.9))
    assert len(out) == docs.count()
    assert rows(mixing.mix(spark, crowded(docs), share=0.9)) == out
    assert mixing.mix(spark, docs.limit(0)).count() == 0
    taken = mixing.mixed(spark, crowded(docs), share=1.0, max_epochs=2)
    assert taken.columns == crowded(docs).columns
    want = rows(mixing.mix(spark, docs, share=1.0, max_epochs=2).selectExpr("doc_id", "explode(array_repeat(1, copies))").select("doc_id"))
    assert rows(taken.select("doc_id")) == want
