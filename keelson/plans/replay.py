"""State from the operation log, whose order is (commit_seq, op_seq).

Key/value, set and sorted-set puts are last-writer-wins: one partial aggregation by key, no sort.
Only keys whose log has an operation that depends on earlier state (pops, removals by rank, count or
index, trims) are folded in order, in one group for each key; all others stay on the aggregate path.
"""

from __future__ import annotations

from bisect import insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ttl import is_live
from ..schema import Ds, Flag

SEQ = ("commit_seq", "op_seq")


def _order() -> Column:
    return F.struct(*SEQ)


def last_writer(log: DataFrame, by: list[str], columns: list[str], order: Column | None = None) -> DataFrame:
    """The last row of each group: max_by aggregates before the shuffle."""
    last = log.groupBy(*by).agg(F.max_by(F.struct(*columns), order if order is not None else _order()).alias("_last"))
    return last.select(*by, "_last.*")


def first_writer(log: DataFrame, by: list[str], columns: list[str], order: Column | None = None) -> DataFrame:
    first = log.groupBy(*by).agg(F.min_by(F.struct(*columns), order if order is not None else _order()).alias("_first"))
    return first.select(*by, "_first.*")


def kv(log: DataFrame, now_ms: int | None = None) -> DataFrame:
    """bucket_id, key, value, ttl_s, ts_ms of the keys set last and, with a clock, not expired."""
    ops = log.where((F.col("ds") == int(Ds.KV)) & F.col("flag").isin(int(Flag.SET), int(Flag.DELETE)))
    out = last_writer(ops, ["bucket_id", "key"], ["flag", "value", "ttl_s", "ts_ms"]).where(F.col("flag") == int(Flag.SET)).drop("flag")
    return out.where(is_live(now_ms)) if now_ms is not None else out


def sets(log: DataFrame) -> DataFrame:
    """bucket_id, key, member."""
    ops = log.where((F.col("ds") == int(Ds.SET)) & F.col("flag").isin(int(Flag.SET), int(Flag.DELETE)))
    ops = ops.withColumnRenamed("value", "member")
    return last_writer(ops, ["bucket_id", "key", "member"], ["flag"]).where(F.col("flag") == int(Flag.SET)).drop("flag")


def known_keys(log: DataFrame, ds: Ds) -> DataFrame:
    """bucket_id, key of all keys that were ever written, emptied ones too."""
    return log.where((F.col("ds") == int(ds)) & F.col("key").isNotNull()).select("bucket_id", "key").distinct()


_ZFOLD = (Flag.ZPOPMAX, Flag.ZPOPMIN, Flag.ZREMRANGEBYRANK)


def zsets(log: DataFrame) -> DataFrame:
    """bucket_id, key, member, score."""
    ops = log.where((F.col("ds") == int(Ds.ZSET)) & F.col("flag").isin(*[int(f) for f in (Flag.ZADD, Flag.ZREM, *_ZFOLD)]))
    folded_keys = ops.where(F.col("flag").isin(*map(int, _ZFOLD))).select("bucket_id", "key").distinct()
    plain = ops.join(folded_keys, ["bucket_id", "key"], "left_anti").withColumnRenamed("value", "member")
    plain = last_writer(plain, ["bucket_id", "key", "member"], ["flag", "score"]).where(F.col("flag") == int(Flag.ZADD)).drop("flag")
    rest = ops.join(folded_keys, ["bucket_id", "key"], "left_semi").select("bucket_id", "key", *SEQ, "flag", "value", "score", "arg1", "arg2")
    kind = dict(log.dtypes)["key"], dict(log.dtypes)["value"]
    folded = rest.groupBy("bucket_id", "key").applyInPandas(_fold_zset, f"bucket_id long, key {kind[0]}, member {kind[1]}, score double")
    return plain.select("bucket_id", "key", "member", "score").union(folded)


def _fold_zset(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    held: dict = {}
    for op in pdf.sort_values(list(SEQ)).itertuples():
        if op.flag == Flag.ZADD:
            held[op.value] = op.score
        elif op.flag == Flag.ZREM:
            held.pop(op.value, None)
        elif held and op.flag in (Flag.ZPOPMAX, Flag.ZPOPMIN):
            end = max if op.flag == Flag.ZPOPMAX else min
            del held[end(held, key=lambda m: (held[m], m))]
        elif op.flag == Flag.ZREMRANGEBYRANK:
            ranked = sorted(held, key=lambda m: (held[m], m))
            a, b = (max(len(ranked) + int(x) + 1, 1) if x < 0 else max(int(x), 1) for x in (op.arg1, op.arg2))
            for m in ranked[min(a, b) - 1 : max(a, b)]:
                del held[m]
    return _frame(key, pdf, member=pd.Series([*held], dtype=pdf.value.dtype), score=pd.Series([*held.values()], dtype="float64"))


def _frame(key, pdf: pd.DataFrame, **columns: pd.Series) -> pd.DataFrame:
    """Result rows of one key, typed also where there are none."""
    n = len(next(iter(columns.values())))
    return pd.DataFrame({"bucket_id": pd.Series([key[0]] * n, dtype="int64"), "key": pd.Series([key[1]] * n, dtype=pdf.key.dtype)} | columns)


_LFOLD = (Flag.LPOP, Flag.RPOP, Flag.LREM, Flag.LTRIM, Flag.LREMBYINDEX)
_PUSH = (Flag.LPUSH, Flag.RPUSH)


def _list_ops(log: DataFrame) -> DataFrame:
    return log.where((F.col("ds") == int(Ds.LIST)) & F.col("flag").isin(*[int(f) for f in (*_PUSH, *_LFOLD)]))


def _raw(log: DataFrame) -> Column:
    """Whether a row is a push that brings its place along."""
    return (F.col("arg1").isNotNull() if "arg1" in log.columns else F.lit(False)) & F.col("flag").isin(*map(int, _PUSH))


def _list_kinds(log: DataFrame) -> DataFrame:
    """bucket_id, key and whether the list had other operations than pushes, some raw pushes, raw pushes only."""
    pushes = F.col("flag").isin(*map(int, _PUSH))
    return _list_ops(log).groupBy("bucket_id", "key").agg(F.max(~pushes).alias("_folded"), F.max(_raw(log)).alias("_some"), F.min(_raw(log)).alias("_all"))


def lists(log: DataFrame, now_ms: int | None = None) -> DataFrame:
    """bucket_id, key, list_seq, value; with a clock, without the lists whose time is over.

    A push to the tail goes past the largest place so far, one to the head before the smallest, and a
    raw push brings its place along. A list that was only pushed to needs no fold: the k-th push to the tail has place k
    and the k-th to the head place 1-k; and if all its pushes are raw, the last at each place stays.
    """
    raw, ops = _raw(log), _list_ops(log)
    kinds = _list_kinds(log)
    kinds = kinds.select("bucket_id", "key", F.when(~F.col("_folded") & ~F.col("_some"), 0).when(~F.col("_folded") & F.col("_all"), 1).otherwise(2).alias("_kind"))
    ops = ops.join(kinds, ["bucket_id", "key"])
    nth = F.row_number().over(Window.partitionBy("bucket_id", "key", "flag").orderBy(*SEQ))
    place = F.when(F.col("flag") == int(Flag.RPUSH), nth).otherwise(1 - nth)
    out = ops.where("_kind = 0").select("bucket_id", "key", place.cast("long").alias("list_seq"), "value")
    if "arg1" in log.columns:
        placed = ops.where("_kind = 1").withColumn("list_seq", F.col("arg1").cast("long"))
        out = out.union(last_writer(placed, ["bucket_id", "key", "list_seq"], ["value"]))
        # pandas has no whole numbers with nulls: those are told apart by a column of their own
        value = F.coalesce("value", F.lit(0)).alias("value") if dict(log.dtypes)["value"] in ("bigint", "int") else F.col("value")
        numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("arg1", "arg2")]
        rest = ops.where("_kind = 2").select("bucket_id", "key", *SEQ, "flag", value, raw.alias("given"), *numbers, "idx")
        kind = dict(log.dtypes)["key"], dict(log.dtypes)["value"]
        out = out.union(rest.groupBy("bucket_id", "key").applyInPandas(_fold_list, f"bucket_id long, key {kind[0]}, list_seq long, value {kind[1]}"))
    if now_ms is not None:
        over = list_meta(log).where(~is_live(now_ms)).select("bucket_id", "key")
        out = out.join(over, ["bucket_id", "key"], "left_anti")
    return out


def list_meta(log: DataFrame) -> DataFrame:
    """bucket_id, key, ttl_s, ts_ms: the last time to live given to each list."""
    ops = log.where((F.col("ds") == int(Ds.LIST)) & (F.col("flag") == int(Flag.EXPIRELIST)))
    return last_writer(ops, ["bucket_id", "key"], ["ttl_s", "ts_ms"])


def fold_list(ops) -> list[tuple[int, object]]:
    """ops: (flag, value, given, arg1, arg2, idx) in order; given: a push at place arg1. The places and
    elements that are left, head first."""
    places, held, head, tail = [], {}, 0, 1  # head and tail: where the next pushes go
    for flag, value, given, arg1, arg2, idx in ops:
        n, gone = len(places), []
        if flag in _PUSH:
            left = flag == Flag.LPUSH
            at = arg1 if given else head if left else tail
            if left:
                head = min(head, at - 1)
            else:
                tail = max(tail, at + 1)
            if at not in held:
                insort(places, at)
            held[at] = value
        elif flag == Flag.LPOP:
            gone = [0] if n else []
        elif flag == Flag.RPOP:
            gone = [n - 1] if n else []
        elif flag == Flag.LREM:
            equal = [i for i, p in enumerate(places) if held[p] == value]
            gone = equal if arg1 == 0 else equal[:arg1] if arg1 > 0 else equal[arg1:]
        elif flag == Flag.LTRIM:
            a = arg1 + n if arg1 < 0 and arg2 != 0 else arg1
            b = arg2 + n if arg2 < 0 else arg2
            gone = [i for i in range(n) if not a <= i <= b]
        elif flag == Flag.LREMBYINDEX:
            gone = sorted({int(i) for i in idx if 0 <= i < n})
        for i in reversed(gone):
            del held[places.pop(i)]
    return [(p, held[p]) for p in places]


def _fold_list(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(list(SEQ))
    left = fold_list(zip(pdf.flag, pdf.value, pdf.given, pdf.arg1.tolist(), pdf.arg2.tolist(), pdf.idx))
    return _frame(key, pdf, list_seq=pd.Series([p for p, _ in left], dtype="int64"), value=pd.Series([v for _, v in left], dtype=pdf.value.dtype))


def deque_fold(ops: DataFrame, by: list[str], order: list[str], kind: Column, value: str) -> DataFrame:
    """Final elements of each deque as an array, head first, by an ordered fold inside the JVM.

    kind: 'R' push to the tail, 'L' to the head, 'l' pop of the head, 'r' of the tail; pops of an
    empty list do nothing. A step copies the elements held: for short deques.
    """
    rows = ops.select(*by, F.struct(*order, kind.alias("kind"), F.col(value).alias("value")).alias("op")).where(F.col("op.kind").isNotNull())
    history = rows.groupBy(*by).agg(F.array_sort(F.collect_list("op")).alias("ops"))
    item = f"array<{dict(ops.dtypes)[value]}>"

    def step(held, op):
        size = F.size(held)
        return (
            F.when(op["kind"] == "R", F.concat(held, F.array(op["value"])))
            .when(op["kind"] == "L", F.concat(F.array(op["value"]), held))
            .when(size == 0, held)
            .when(op["kind"] == "l", F.slice(held, F.lit(2), F.greatest(size - 1, F.lit(0))))
            .otherwise(F.slice(held, F.lit(1), F.greatest(size - 1, F.lit(0))))
        )

    return history.select(*by, F.aggregate("ops", F.array().cast(item), step).alias("elements"))


def committed(log: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows of published commits only."""
    return log.join(commits.select("commit_seq"), "commit_seq", "left_semi")


def record_counts(log: DataFrame, now_ms: int | None = None) -> DataFrame:
    """ds, n: live records of each structure."""
    parts = [(Ds.KV, kv(log, now_ms)), (Ds.SET, sets(log)), (Ds.ZSET, zsets(log)), (Ds.LIST, lists(log, now_ms))]
    out = None
    for ds, state in parts:
        n = state.agg(F.count("*").alias("n")).select(F.lit(int(ds)).alias("ds"), "n")
        out = n if out is None else out.union(n)
    return out


def as_log(log: DataFrame, commit_seq: int, now_ms: int | None = None) -> DataFrame:
    """The shortest log with the same state: what compaction writes. Emptied keys keep a row."""
    names = log.columns

    def rows(df: DataFrame, ds: Ds, flag: Flag | Column, **columns) -> DataFrame:
        flag = flag if isinstance(flag, Column) else F.lit(int(flag))
        fixed = {"commit_seq": F.lit(commit_seq).cast("long"), "ds": F.lit(int(ds)).cast("short"), "flag": flag.cast("short")}
        have = fixed | {"bucket_id": F.col("bucket_id"), "key": F.col("key")} | columns
        have.setdefault("op_seq", F.lit(0).cast("long"))
        return df.select(*[(have[c] if c in have else F.lit(None)).cast(log.schema[c].dataType).alias(c) for c in names])

    pushes = lists(log).withColumn("_n", F.row_number().over(Window.partitionBy("bucket_id", "key").orderBy("list_seq")))
    out = rows(kv(log, now_ms), Ds.KV, Flag.SET, value=F.col("value"), ttl_s=F.col("ttl_s"), ts_ms=F.col("ts_ms"))
    out = out.union(rows(sets(log), Ds.SET, Flag.SET, value=F.col("member")))
    out = out.union(rows(zsets(log), Ds.ZSET, Flag.ZADD, value=F.col("member"), score=F.col("score")))
    # lists that had raw pushes keep their places, others their order
    kept = pushes.join(_list_kinds(log).where("_some").select("bucket_id", "key"), ["bucket_id", "key"], "left_semi")
    plain = pushes.join(_list_kinds(log).where("_some").select("bucket_id", "key"), ["bucket_id", "key"], "left_anti")
    out = out.union(rows(plain, Ds.LIST, Flag.RPUSH, value=F.col("value"), op_seq=F.col("_n")))
    side = F.when(F.col("list_seq") > 0, int(Flag.RPUSH)).otherwise(int(Flag.LPUSH))
    out = out.union(rows(kept, Ds.LIST, side, value=F.col("value"), arg1=F.col("list_seq"), op_seq=F.col("_n")))
    out = out.union(rows(list_meta(log), Ds.LIST, Flag.EXPIRELIST, ttl_s=F.col("ttl_s"), ts_ms=F.col("ts_ms")))
    for ds in (Ds.SET, Ds.ZSET, Ds.LIST):
        out = out.union(rows(known_keys(log, ds), ds, Flag.KEY))
    return out
