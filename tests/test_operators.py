"""Operators on states whose buckets share keys, and on binary keys."""

from pyspark.sql import functions as F

from keelson.functions import binary
from keelson.operators import kv, lists, sets, zsets


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_lists_of_two_buckets(spark):
    state = spark.createDataFrame([(1, "k", 1, "a"), (1, "k", 2, "b"), (2, "k", 1, "c")], "bucket_id long, key string, list_seq long, value string")
    assert rows(lists.lsize(state)) == [(1, "k", 2), (2, "k", 1)]
    assert rows(lists.lrange(state, 0, -1)) == [(1, "k", 0, "a"), (1, "k", 1, "b"), (2, "k", 0, "c")]
    assert rows(lists.peek(state)) == [(1, "k", "a", "b"), (2, "k", "c", "c")]
    more = spark.createDataFrame([(2, "k", 0, "d"), (3, "k", 0, "e")], "bucket_id long, key string, ord int, value string")
    assert rows(lists.push(state, more, right=False).where("bucket_id > 1").select("bucket_id", "list_seq", "value")) == [(2, 0, "d"), (2, 1, "c"), (3, -1, "e")]


def test_sets_of_two_buckets(spark):
    state = spark.createDataFrame([(1, "k", "a"), (1, "k", "b"), (2, "k", "b")], "bucket_id long, key string, member string")
    assert rows(sets.card(state)) == [(1, "k", 2), (2, "k", 1)]
    assert rows(sets.remove(state, state.where("bucket_id = 2"))) == [(1, "k", "a"), (1, "k", "b")]
    assert rows(sets.diff(state, (1, "k"), (2, "k"))) == [("a",)]
    assert rows(sets.move(state, (1, "k"), (2, "k"), "a")) == [(1, "k", "b"), (2, "k", "a"), (2, "k", "b")]
    assert rows(sets.move(state, (2, "k"), (1, "k"), "a")) == rows(state)


def test_sorted_sets_of_two_buckets(spark):
    state = spark.createDataFrame([(1, "k", "a", 1.0), (1, "k", "b", 2.0), (2, "k", "c", 0.5)], "bucket_id long, key string, member string, score double")
    assert rows(zsets.ranked(state).select("bucket_id", "member", "rank", "rev_rank")) == [(1, "a", 1, 2), (1, "b", 2, 1), (2, "c", 1, 1)]
    assert rows(zsets.pop(state)) == [(1, "k", "a", 1.0)]
    assert rows(zsets.peek_min(state)) == [(1, "k", "a", 1.0), (2, "k", "c", 0.5)]


def test_key_values_of_two_buckets(spark):
    state = spark.createDataFrame([(1, "a", "1", 0, 0), (1, "b", "2", 0, 0), (2, "a", "3", 0, 0)], "bucket_id long, key string, value string, ttl_s long, ts_ms long")
    assert rows(kv.get(state, 2, "a")) == [("a", "3")] and rows(kv.get(state, 2, "b")) == []
    assert rows(kv.mget(state, 1, ["b", "x", "b"])) == [(0, "b", "2"), (1, "x", None), (2, "b", "2")]
    assert rows(kv.has(state, 2, ["a", "b"])) == [("a", True), ("b", False)]
    assert rows(kv.key_bounds(state)) == [(1, "a", "b"), (2, "a", "a")]
    least, rest = kv.pop(state)
    assert rows(least.select("bucket_id", "key")) == [(1, "a"), (2, "a")] and rows(rest.select("bucket_id", "key")) == [(1, "b")]
    assert rows(kv.iterate(state, 1, "aa", reverse=True)) == [("a", "1"), ("b", "2")] and rows(kv.iterate(state, 2, "b", reverse=True)) == []


def test_expressions_match_binary_keys(spark):
    state = spark.createDataFrame([(1, bytearray(b"\xff\xe9a"), bytearray(b"v"))], "bucket_id long, key binary, value binary")
    assert kv.Scan(state).match("^\xff\xe9a$").count() == 1
    assert kv.Scan(state).prefix(b"\xff").match("^\xe9a$").count() == 1 and kv.Scan(state).match("b").count() == 0


def test_counters_of_any_length(spark):
    texts = ["9" * 45, "-" + "9" * 40, "12", "x", "", None, "9" * 38, "1" * 37]
    state = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "bucket_id long, key long, value string")
    amounts = state.select("bucket_id", "key", F.lit(1).alias("n"))
    out = {r["key"]: r["value"] for r in kv.incr_by(state, amounts).collect()}
    assert [out[i] for i in (0, 1, 2, 6, 7)] == [str(int(texts[i]) + 1) for i in (0, 1, 2, 6, 7)]
    assert {i: v for i, v in out.items() if i in (3, 4, 5)} == {3: None, 4: None} | ({5: None} if 5 in out else {})
    assert spark.range(1).select(binary.add_text(F.lit("5"), F.lit(-7))).first()[0] == "-2"
