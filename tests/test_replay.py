"""Replay against a plain model, on random operations."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from keelson.plans import replay
from keelson.schema import OPLOG, Ds, Flag

KEYS = [b"a", b"b"]
VALUES = [b"x", b"y", b"z"]
OPS = st.lists(
    st.one_of(
        st.tuples(st.just(Ds.KV), st.sampled_from([Flag.SET, Flag.DELETE]), st.sampled_from(KEYS), st.sampled_from(VALUES), st.just(0), st.just(0)),
        st.tuples(st.just(Ds.SET), st.sampled_from([Flag.SET, Flag.DELETE]), st.sampled_from(KEYS), st.sampled_from(VALUES), st.just(0), st.just(0)),
        st.tuples(st.just(Ds.LIST), st.sampled_from([Flag.LPUSH, Flag.RPUSH, Flag.LPOP, Flag.RPOP, Flag.LREM, Flag.LTRIM]), st.sampled_from(KEYS), st.sampled_from(VALUES), st.integers(-2, 3), st.integers(-2, 4)),
        st.tuples(st.just(Ds.ZSET), st.sampled_from([Flag.ZADD, Flag.ZADD, Flag.ZREM, Flag.ZPOPMAX, Flag.ZPOPMIN, Flag.ZREMRANGEBYRANK]), st.sampled_from(KEYS), st.sampled_from(VALUES), st.integers(-2, 3), st.integers(-2, 3)),
    ),
    max_size=40,
)


def test_raw_pushes_and_others(spark):
    """A push goes past the largest place, before the smallest; places survive pops and compaction."""
    ops = [(Flag.RPUSH, b"a", b"x100", 100), (Flag.RPUSH, b"a", b"after", None), (Flag.RPUSH, b"a", b"x5", 5), (Flag.LPUSH, b"a", b"first", None)]
    ops += [(Flag.RPUSH, b"b", b"later", 20), (Flag.RPUSH, b"b", b"earlier", 10), (Flag.RPUSH, b"b", b"y", None), (Flag.RPOP, b"b", None, None)]
    ops += [(Flag.RPUSH, b"c", b"old", 7), (Flag.RPUSH, b"c", b"seven", 7), (Flag.LPUSH, b"c", b"three", 3), (Flag.RPUSH, b"d", b"p", None), (Flag.LPUSH, b"d", b"q", None), (Flag.LPUSH, b"d", b"r", None)]
    rows = [(i, 0, int(Ds.LIST), 1, int(f), k, v, None, a, None, None, 0, 0) for i, (f, k, v, a) in enumerate(ops)]
    log = spark.createDataFrame(rows, OPLOG)
    want = {b"a": [b"first", b"x5", b"x100", b"after"], b"b": [b"earlier", b"later"], b"c": [b"three", b"seven"], b"d": [b"r", b"q", b"p"]}
    assert replayed(log)[2] == want
    small = replay.as_log(log, 100)
    assert replayed(small)[2] == want
    more = [(200, 0, int(Ds.LIST), 1, int(Flag.RPUSH), b"a", b"x50", None, 50, None, None, 0, 0), (201, 0, int(Ds.LIST), 1, int(Flag.LPUSH), b"b", b"head", None, None, None, None, 0, 0)]
    after = replayed(small.union(spark.createDataFrame(more, OPLOG)))[2]
    assert after[b"a"] == [b"first", b"x5", b"x50", b"x100", b"after"] and after[b"b"] == [b"head", b"earlier", b"later"]


def model(ops):
    kv, sets, lists, zsets = {}, {}, {}, {}
    for i, (ds, flag, key, value, a, b) in enumerate(ops):
        if ds == Ds.KV:
            kv[key] = value if flag == Flag.SET else None
        elif ds == Ds.SET:
            s = sets.setdefault(key, set())
            s.add(value) if flag == Flag.SET else s.discard(value)
        elif ds == Ds.LIST:
            held = lists.setdefault(key, [])
            if flag == Flag.LPUSH:
                held.insert(0, value)
            elif flag == Flag.RPUSH:
                held.append(value)
            elif flag == Flag.LPOP:
                del held[:1]
            elif flag == Flag.RPOP:
                del held[-1:]
            elif flag == Flag.LREM:
                at = [k for k, x in enumerate(held) if x == value]
                gone = at if a == 0 else at[:a] if a > 0 else at[a:]
                held[:] = [x for k, x in enumerate(held) if k not in gone]
            elif flag == Flag.LTRIM:
                lo = a + len(held) if a < 0 and b != 0 else a
                hi = b + len(held) if b < 0 else b
                held[:] = [x for k, x in enumerate(held) if lo <= k <= hi]
        else:
            z = zsets.setdefault(key, {})
            order = sorted(z, key=lambda m: (z[m], m))
            if flag == Flag.ZADD:
                z[value] = float(a)
            elif flag == Flag.ZREM:
                z.pop(value, None)
            elif order and flag == Flag.ZPOPMAX:
                del z[order[-1]]
            elif order and flag == Flag.ZPOPMIN:
                del z[order[0]]
            elif flag == Flag.ZREMRANGEBYRANK:
                lo, hi = (max(x + len(order) + 1, 1) if x < 0 else max(x, 1) for x in (a, b))
                for m in order[min(lo, hi) - 1 : max(lo, hi)]:
                    del z[m]
    return (
        {k: v for k, v in kv.items() if v is not None},
        {k: v for k, v in sets.items() if v},
        {k: v for k, v in lists.items() if v},
        {k: v for k, v in zsets.items() if v},
    )


def replayed(log):
    kv = {bytes(r["key"]): bytes(r["value"]) for r in replay.kv(log).collect()}
    sets, lists, zsets = {}, {}, {}
    for r in replay.sets(log).collect():
        sets.setdefault(bytes(r["key"]), set()).add(bytes(r["member"]))
    for r in replay.lists(log).orderBy("key", "list_seq").collect():
        lists.setdefault(bytes(r["key"]), []).append(bytes(r["value"]))
    for r in replay.zsets(log).collect():
        zsets.setdefault(bytes(r["key"]), {})[bytes(r["member"])] = r["score"]
    return kv, sets, lists, zsets


@settings(max_examples=6, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(OPS)
def test_replay_and_compaction(spark, ops):
    rows = [(i // 3, i % 3, int(ds), 1, int(flag), key, value, float(a), a, b, None, 0, 0) for i, (ds, flag, key, value, a, b) in enumerate(ops)]
    log = spark.createDataFrame(rows, OPLOG)
    want = model(ops)
    assert replayed(log) == want
    assert replayed(replay.as_log(log, 10**6)) == want
