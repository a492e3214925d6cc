import re

from edges import crowded, edge_docs, rows
from oracle import assert_same, connect

from keelson.llm import licenses
from keelson.llm.common import read


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        hits += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_of_documents(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    want = sorted((r["doc_id"], *plain(r["text"])) for r in docs.collect())
    out = licenses.license_scan(spark, docs)
    assert sorted(tuple(r) for r in out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()) == want
    assert out.where("n_base > 0 and not (score = 1.0 and labels <> '')").count() == 0
    assert out.where("score < 0 or score > 1").count() == 0 and sum(w[2] for w in want) > 0


def test_passages_with_changed_words(spark):
    mit = licenses.TEXTS[0][1]
    w = mit.split()
    changed = " ".join(w[:20] + ["inserted", "words"] + w[20:35] + w[36:])
    half = " ".join(w[: len(w) // 3])
    data = [(1, "intro " + mit.upper() + " outro"), (2, changed), (3, half), (4, "cc-by"), (5, "CC BY-NC 4.0 Licensed under CC BY-NC 4.0."), (6, "mit mit license apache mit license"), (7, "public license gnu general")]
    out = {r["doc_id"]: r for r in licenses.license_scan(spark, spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert out[1]["labels"] == "mit" and out[1]["score"] == 1.0 and out[1]["n_base"] == 0
    assert out[2]["labels"] == "mit" and 0.6 <= out[2]["score"] < 1
    assert out[3]["labels"] == "" and out[3]["score"] == 0
    assert out[4]["base_labels"] == "cc-by" and out[5]["labels"] == "cc-by,cc-by-nc"
    assert (out[6]["n_base"], out[6]["first_word"], out[6]["last_word"]) == (2, 1, 4)
    assert out[7]["n_base"] == 0


def test_spans_are_verified(spark):
    w = licenses.TEXTS[0][1].split()
    blocks = [w[i : i + 6] for i in range(0, len(w), 6)]
    backwards = " ".join(x for b in reversed(blocks) for x in b)
    spread = " ".join(" ".join(b) + " " + " ".join(f"filler{i}" for i in range(3)) for b in blocks)
    data = [(1, " ".join(w)), (2, backwards), (3, spread), (4, " ".join(w) + " and then " + " ".join(w))]
    out = {r["doc_id"]: r["labels"] for r in licenses.license_scan(spark, spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert out == {1: "mit", 2: "", 3: "", 4: "mit"}


def test_other_templates(spark):
    own = [("own", " ".join(f"term{i}" for i in range(400)))]
    docs = spark.createDataFrame([(1, own[0][1]), (2, "mit license")], "doc_id long, text string")
    out = {r["doc_id"]: (r["base_labels"], r["labels"]) for r in licenses.license_scan(spark, docs, phrases=[("term1 term2", "one")], texts=own).collect()}
    assert out == {1: ("one", "one,own"), 2: ("", "")}


def test_edges(spark):
    docs = edge_docs(spark)
    out = licenses.license_scan(spark, docs)
    assert rows(out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == sorted(((r["doc_id"], *plain(r["text"])) for r in docs.collect()), key=repr)
    assert rows(licenses.license_scan(spark, crowded(docs))) == rows(out)
    assert licenses.license_scan(spark, docs.limit(0)).count() == 0


def test_oracle(spark):
    folder = "/root/testdata/sf0.01"
    assert_same(licenses.license_scan(spark, read(spark, folder, "documents")), connect(folder), licenses.ORACLE)
