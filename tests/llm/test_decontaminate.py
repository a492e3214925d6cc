import math
import random
import re
from collections import Counter

from edges import LONG, crowded, edge_docs, rows
from oracle import assert_same, connect

from keelson.llm import decontaminate
from keelson.llm.common import read


def split(text):
    return [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if x]


def runs(w, m):
    return {" ".join(w[i : i + m]) for i in range(len(w) - m + 1)}


def shingles(text):
    """Those of an item."""
    w = split(text)
    return runs(w, min(5, len(w))) if w else set()


def held(text, s):
    """How many of an item's shingles a text holds."""
    return len(s & runs(split(text), len(next(iter(s)).split()))) if s else 0


def plain(docs, items):
    out = []
    for d, t in set(docs):
        for i, x in items:
            s = shingles(x)
            if s and held(t, s) * 10 >= len(s) * 8:
                out.append((d, i, len(s), held(t, s), round(held(t, s) / len(s), 6)))
    return sorted(out, key=repr)


def test_oracle(spark):
    folder = "/root/testdata/sf0.001"
    n = assert_same(decontaminate.containments(spark, read(spark, folder, "documents"), read(spark, folder, "benchmark")), connect(folder), decontaminate.ORACLE)
    assert n > 0


def test_edges(spark):
    docs = edge_docs(spark)
    passage = " ".join(LONG.split()[500:560])
    items = [(1, "The quick, brown FOX jumps over the lazy dog"), (2, passage), (3, passage + " and ten words more that the text lacks so far"), (4, None), (5, ""), (6, "one"), (7, "two words"), (8, passage + " " + " ".join(f"new{i}" for i in range(20)))]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert {(7, 2), (7, 3), (3, 1), (5, 1), (2, 6), (6, 7)} <= {x[:2] for x in want} and (7, 8) not in {x[:2] for x in want}
    assert rows(decontaminate.containments(spark, docs, table)) == want
    assert rows(decontaminate.containments(spark, crowded(docs), crowded(table))) == want
    assert decontaminate.containments(spark, docs.limit(0), table).count() == 0
    assert decontaminate.containments(spark, docs, table.limit(0)).count() == 0
    kept = decontaminate.decontaminate(spark, crowded(docs), table)
    assert kept.columns == crowded(docs).columns
    free = [(r["doc_id"], r["text"]) for r in docs.collect() if not any(10 * held(r["text"], shingles(x)) >= 8 * len(shingles(x)) for _, x in items if shingles(x))]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(free, key=repr) and len(free) < docs.count()


def test_texts_of_one_id_are_judged_each(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    half = passage.split()
    docs = [(None, passage), (None, "a clean text without it at all"), (1, " ".join(half[:11])), (1, " ".join(half[9:])), (2, passage), (2, passage)]
    table, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert rows(decontaminate.containments(spark, table, items)) == plain(docs, [(1, passage)]) and len(plain(docs, [(1, passage)])) == 2
    assert rows(decontaminate.decontaminate(spark, table, items)) == sorted(docs[1:4], key=repr)


def test_items_are_searched_by_size_class(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 8, 11, 16, 24, 40, 70, 120] * 3)]
    docs = []
    for d in range(150):
        parts = [text(rng.randint(0, 200))]
        for _, x in rng.sample(items, 3):
            w = x.split()
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = "changed"
            parts += [" ".join(w), text(rng.randint(0, 60))]
        docs.append((d, " ".join(parts)))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert len(want) > 300 and rows(decontaminate.containments(spark, a, b)) == want  # recall is 1
    sketches, _ = decontaminate.item_index(b, 0.8, 5)
    classes = decontaminate.size_classes(sketches)
    n = {i: len(shingles(x)) for i, x in items}
    assert [c for c, _, _ in classes] == sorted({int(math.log2(k)) for k in n.values()})
    kept = Counter(r["item_id"] for r in sketches.collect())
    for c, need, bound in classes:
        inside = [i for i, k in n.items() if int(math.log2(k)) == c]
        most = max(n[i] - math.ceil(0.8 * n[i] - 1e-9) + 1 for i in inside)
        assert all(kept[i] == min(n[i], most) for i in inside) and need == min(math.ceil(0.8 * n[i] - 1e-9) for i in inside)
    # a hash over a class's bound, and a document too small for a class, aren't searched in it
    top = classes[-1]
    probe = spark.createDataFrame([([top[2], top[2] + 1] * top[1],), ([top[2]],)], "hs array<bigint>")
    got = [{(r["size_class"], r["h"]) for r in x[0]} for x in probe.select(decontaminate.searched(probe.hs, [top])).collect()]
    assert got == [{(top[0], top[2])}, set()]
