import math

import numpy as np
import pyarrow as pa
from edges import crowded, edge_docs, rows
from pyspark.sql import functions as F

from keelson.llm import toxicity
from keelson.llm.common import read

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = read(spark, FOLDER, "documents"), read(spark, FOLDER, "labels")
    out = toxicity.toxicity(spark, docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    judged = out.where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    assert len(judged) > 50
    right = sum(r["toxic"] == r["predicted"] for r in judged) / len(judged)
    assert right >= 0.95
    assert out.count() == docs.count()


def test_held_out_rule(spark):
    import zlib

    ids = [0, 1, 2, 10, 44871, -3]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", toxicity.held_out()).collect()
    assert [r[1] for r in got] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]


def learn(texts, labels, swapped, penalty, **more):
    real = [toxicity.features(t) for t in texts]
    swaps = [c for t in swapped for c in toxicity.changes(t)]
    return toxicity.train(toxicity._sparse(real), labels, toxicity._sparse(swaps), penalty=penalty, **more)


def test_counterfactual_penalty_frees_neutral_mentions():
    # the group's name goes with toxic texts here, though the insult makes them so
    texts = [f"the muslim idiot number{i} spoke" for i in range(30)] + [f"the nice number{i} neighbour spoke" for i in range(30)]
    labels = [1] * 30 + [0] * 30
    neutral, other = "the muslim neighbour spoke", "the christian neighbour spoke"
    plain, fair = (learn(texts, labels, texts, p) for p in (0, 5))
    assert plain.pairs == fair.pairs == 120
    assert abs(fair.score(neutral) - fair.score(other)) < abs(plain.score(neutral) - plain.score(other))
    assert fair.score(neutral) < plain.score(neutral)
    assert fair.score("the idiot spoke") > 0.5


def test_training_equals_plain_loops():
    texts, labels = ["you idiot there", "a fine black day there", "idiot old men", "fine words", ""], [1, 0, 1, 0, 0]
    weights, penalty, l2, rate = [1.0, 2.0, 1.0, 0.5, 1.0], 3.0, 0.01, 0.05
    real, swaps = [toxicity.features(t) for t in texts], [c for t in texts for c in toxicity.changes(t)]
    used = sorted({i for t in real + swaps for i in t})
    share = lambda y, i: (sum(t.get(i, 0) > 0 for t, k in zip(real, labels) if k == y) + 0.5) / (labels.count(y) + 1)
    scale = {i: abs(math.log(share(1, i) / share(0, i))) + 0.1 for i in used}
    v, m, s = ({i: 0.0 for i in used} for _ in range(3))
    rate_of = 2 / sum(weights)
    b, mb, vb = math.log((rate_of + 1e-3) / (1 - rate_of + 1e-3)), 0.0, 0.0
    for t in range(1, 13):
        grad, gb = {i: l2 * v[i] for i in used}, 0.0
        for x, y, w in zip(real, labels, weights):
            z = b + sum(n * scale[i] * v[i] for i, n in x.items())
            err = (1 / (1 + math.exp(-z)) - y) * w / sum(weights)
            gb += err
            for i, n in x.items():
                grad[i] += n * scale[i] * err
        for x in swaps:
            change = sum(n * scale[i] * v[i] for i, n in x.items())
            for i, n in x.items():
                grad[i] += 2 * penalty * change / len(swaps) * n * scale[i]
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        for i in used:
            m[i], s[i] = 0.9 * m[i] + 0.1 * grad[i], 0.999 * s[i] + 0.001 * grad[i] ** 2
            v[i] -= rate * (m[i] / c1) / (math.sqrt(s[i] / c2) + 1e-9)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        b -= rate * (mb / c1) / (math.sqrt(vb / c2) + 1e-9)
    got = toxicity.train(toxicity._sparse(real), labels, toxicity._sparse(swaps), weights, penalty, l2, 12, rate)
    assert abs(got.bias - b) < 1e-4 and all(abs(got.weights[i] - scale[i] * v[i]) < 1e-4 for i in used)
    assert set(got.weights.nonzero()[0].tolist()) <= set(used)


def test_batches_score_as_texts_alone():
    model = learn(["you idiot there", "a fine day there"], [1, 0], [], 0)
    texts = ["You IDIOT, there", None, "", "Üñïçødé TEXT’s ñame — 漢字 𝒳 idiot", "idiot idiot idiot", "a fine fine day 99 x_y", "ÉTÉ été"]
    want = [1 / (1 + math.exp(-(model.bias + sum(n * model.weights[i] for i, n in toxicity.features(t).items())))) for t in texts]
    assert np.allclose(model.score_all(pa.array(texts)), want)
    assert toxicity.features("ÉTÉ été") == toxicity.features("été")


def test_penalty_acts_on_the_documents(spark):
    """No document of these tables names an identity term by itself, so every pair is a mention put in; the penalty makes
    the names of groups weigh the same, and no clean held-out text turns toxic through a mention."""
    docs, labels = read(spark, FOLDER, "documents"), read(spark, FOLDER, "labels")
    plain, fair = (toxicity.fit(docs, labels, only=~toxicity.held_out(), penalty=p) for p in (0.0, 1.0))
    learnt = labels.where(~toxicity.held_out()).count()
    assert fair.pairs == plain.pairs == 2 * learnt > 0  # all of so few
    terms = [t for g in toxicity.IDENTITY_TERMS for t in g]
    spread = lambda m: np.std(m.of_words(pa.array([*terms, toxicity.NEUTRAL])))
    assert spread(fair) < spread(plain)
    clean = [r["text"] for r in docs.join(labels.where("toxic = 0"), "doc_id").where(toxicity.held_out()).select("text").collect()]
    mentions = pa.array([f"{t} {x}" for t in terms for x in clean])
    wrong = [int((m.score_all(mentions) >= 0.5).sum()) for m in (plain, fair)]
    assert wrong[1] <= wrong[0] and wrong[1] <= 0.01 * len(mentions)


def test_penalty_lowers_false_positives_of_a_biased_corpus(spark):
    # a group is named in most of the toxic documents that are learnt from, and in no clean one
    docs, labels = read(spark, FOLDER, "documents"), read(spark, FOLDER, "labels")
    toxic = labels.where("toxic = 1").select(F.col("doc_id").alias("t"))
    text = F.when(F.col("t").isNotNull() & (F.xxhash64("doc_id") % 4 != 0), F.concat(F.lit("muslim "), "text")).otherwise(F.col("text"))
    biased = docs.join(toxic, F.col("doc_id") == F.col("t"), "left").withColumn("text", text).drop("t")
    plain, fair = (toxicity.fit(biased, labels, only=~toxicity.held_out(), penalty=p) for p in (0.0, 1.0))
    clean = [r["text"] for r in docs.join(labels.where("toxic = 0"), "doc_id").where(toxicity.held_out()).select("text").collect()]
    wrong = [int((m.score_all(pa.array([f"muslim {t}" for t in clean])) >= 0.5).sum()) for m in (plain, fair)]
    print("false positives of", len(clean), "neutral mentions: without the penalty", wrong[0], "with", wrong[1])
    assert wrong[0] > 0.3 * len(clean) and wrong[1] < 0.1 * len(clean)


def test_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(5, 1, 1), (5, 1, 0), (9, 1, 0), (None, 1, 1), (4, None, None), (2, 0, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(spark, docs, labels)
    assert out.count() == docs.count()
    assert out.where("score is null or score < 0 or score > 1 or predicted is null or held_out is null").count() == 0
    assert rows(toxicity.toxicity(spark, crowded(docs), labels)) == rows(out)
    assert toxicity.toxicity(spark, docs.limit(0), labels).count() == 0
    assert toxicity.toxicity(spark, docs, labels.limit(0)).agg(F.countDistinct("score")).first()[0] == 1
    clashing = crowded(labels).withColumn("text", F.lit("x"))
    assert rows(toxicity.toxicity(spark, docs, clashing)) == rows(out)
