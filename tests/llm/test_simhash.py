import random
from itertools import combinations

import pytest
import xxhash
from edges import crowded, edge_docs, rows

from keelson.llm import simhash
from keelson.llm.common import read
from keelson.llm.components import components


def plain_fingerprint(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, at = [], ""
    for c in folded + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            words += [at] if at else []
            at = ""
        else:
            at += c
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(fps: dict, radius=3):
    """id -> smallest id reachable, from all pairs."""
    up = {i: i for i in fps}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(sorted(fps), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            a, b = sorted((find(i), find(j)))
            up[b] = a
    return {i: find(i) for i in fps}


def test_every_pair_within_the_radius_shares_a_table():
    rng = random.Random(1)
    tree = simhash.mask_tree(3, 3)
    for _ in range(300):
        x, y = rng.getrandbits(64), None
        y = x
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << bit
        at = {0}
        for level in tree:  # a bucket that holds both at each level
            at = {p for before, p, m in level if before in at and (x ^ y) & (m & (1 << 64) - 1) == 0}
            assert at


def test_buckets_end_small():
    assert all(64 - (m & (1 << 64) - 1).bit_count() <= 8 for _, _, m in simhash.mask_tree(3, 3)[2])


def test_documents(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    want = plain_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(spark, docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert any(i != c for i, c in want.items())


@pytest.mark.parametrize("bucket", [1, 4, 256])
def test_crowded_buckets_lose_no_component(spark, bucket):
    rng = random.Random(bucket)
    centre = rng.getrandbits(64)
    fps = {centre} | {rng.getrandbits(64) for _ in range(30)}
    for _ in range(120):
        x = centre
        for bit in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << bit
        fps.add(x)
    want = plain_components({f: f for f in fps})
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    found = {r["node"]: r["component"] for r in components(simhash.links(df, bucket=bucket)).collect()}
    groups, expected = {}, {}
    for f in fps:
        groups.setdefault(found.get(simhash._signed(f), simhash._signed(f)), set()).add(f)
        expected.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_edges(spark):
    docs = edge_docs(spark)
    out = simhash.near_duplicates(spark, docs)
    got = rows(out)
    fps = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    assert sorted((d, f) for d, f, _ in got if d is not None) == sorted((d, f"{f:016x}") for d, f in fps if d is not None)
    assert {c for d, f, c in got if f == "0" * 16} == {4}  # null, empty and blank texts are one component
    assert {c for d, f, c in got if d in (3, 5)} == {3}
    assert {(d, c) for d, f, c in got if d is None} == {(None, None), (None, 4)}
    assert rows(simhash.near_duplicates(spark, crowded(docs))) == got
    assert simhash.near_duplicates(spark, docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert found == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}
