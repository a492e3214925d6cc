"""Registered queries: each a DataFrame over the supplied tables, with the DuckDB SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import binary
from ..operators import buckets, kv, lists, sets, ttl, zsets
from ..schema import Ds, Flag
from ..sources.shared import materialize
from . import bindings as b
from . import replay

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name. Integers come out as BIGINT in both engines."""

    def add(fn):
        def run(spark, d) -> DataFrame:
            df = fn(spark, d)
            return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            ORACLE[fn.__name__] = sql
        return run

    return add


# Ordered key/value: scans


@query(f"SELECT key, value FROM {b.KV1} WHERE key = '0000000042'")
def kv_get(spark, d):
    return kv.get(b.kv_orders(spark, d), 1, "0000000042")


_ASKED = ["0000000007", "0000000003", "0000000007", "9999999999", "0000000100"]


@query("WITH r AS (SELECT unnest(range(0, 5)) AS pos, unnest(['0000000007', '0000000003', '0000000007', '9999999999', '0000000100']) AS key) " f"SELECT pos, r.key, k.value FROM r LEFT JOIN {b.KV1} k ON k.key = r.key")
def kv_mget_ordered(spark, d):
    return kv.mget(b.kv_orders(spark, d), 1, _ASKED)


@query(f"SELECT r.key, k.key IS NOT NULL AS present FROM (SELECT DISTINCT unnest(['0000000007', '0000000003', '9999999999', '0000000100']) AS key) r LEFT JOIN {b.KV1} k ON k.key = r.key")
def kv_has(spark, d):
    return kv.has(b.kv_orders(spark, d), 1, _ASKED)


@query(f"SELECT bucket_id, key, strlen(value)::BIGINT AS n FROM {b.KV}")
def kv_value_len(spark, d):
    return b.kv_orders(spark, d).select("bucket_id", "key", binary.value_len(F.col("value")).alias("n"))


@query(f"SELECT bucket_id, min(key) AS min_key, max(key) AS max_key FROM {b.KV} GROUP BY bucket_id")
def kv_min_max_key(spark, d):
    return kv.key_bounds(b.kv_orders(spark, d))


@query(f"SELECT key, value FROM {b.KV1}")
def kv_get_all(spark, d):
    return kv.get_all(b.kv_orders(spark, d), 1)


@query(f"SELECT key FROM {b.KV1}")
def kv_keys(spark, d):
    return kv.keys(b.kv_orders(spark, d), 1)


@query(f"SELECT value FROM {b.KV1}")
def kv_values(spark, d):
    return kv.values(b.kv_orders(spark, d), 1)


@query(f"SELECT key, value FROM {b.KV1} WHERE key BETWEEN '0000000100' AND '0000000900'")
def kv_range_scan(spark, d):
    return kv.range_scan(b.kv_orders(spark, d), 1, "0000000100", "0000000900")


@query(f"SELECT key FROM {b.KV1} WHERE key BETWEEN '0000000100' AND '0000000900'")
def kv_range_scan_keys(spark, d):
    return kv.Scan(b.kv_orders(spark, d)).bucket(1).from_key("0000000100").to_key("0000000900").frame("key")


@query(f"SELECT key, value FROM {b.KV1} WHERE starts_with(key, '00000001')")
def kv_prefix_scan(spark, d):
    return kv.prefix_scan(b.kv_orders(spark, d), 1, "00000001")


@query(f"SELECT key, value FROM {b.KV1} WHERE starts_with(key, '0000000') ORDER BY key LIMIT 25 OFFSET 10")
def kv_prefix_offset_limit(spark, d):
    return kv.prefix_scan(b.kv_orders(spark, d), 1, "0000000", 10, 25)


@query(f"SELECT key, value FROM {b.KV1} WHERE starts_with(key, '0000000') AND regexp_matches(substr(key, 8), '[13]5$') ORDER BY key LIMIT 40 OFFSET 2")
def kv_prefix_search_regex(spark, d):
    return kv.prefix_search(b.kv_orders(spark, d), 1, "0000000", "[13]5$", 2, 40)


@query(f"SELECT key, value FROM {b.KV1} WHERE contains(value, 'URGENT') AND key > '0000000500' ORDER BY key DESC LIMIT 30 OFFSET 5")
def kv_scan_builder(spark, d):
    return kv.Scan(b.kv_orders(spark, d)).bucket(1).where(F.col("value").contains("URGENT")).where(F.col("key") > "0000000500").descending().skip(5).take(30).frame("key", "value")


@query(f"SELECT count(*) AS n FROM {b.KV1} WHERE key >= '0000000500'")
def kv_scan_count(spark, d):
    return kv.Scan(b.kv_orders(spark, d)).bucket(1).from_key("0000000500").take(3).matching().agg(F.count("*").alias("n"))


@query(f"SELECT key, value, row_number() OVER (ORDER BY key DESC) - 1 AS pos FROM {b.KV1}")
def kv_iter_reverse(spark, d):
    return kv.iterate_numbered(b.kv_orders(spark, d), 1, reverse=True)


@query(f"SELECT key, value, row_number() OVER (ORDER BY key) - 1 AS pos FROM {b.KV1} WHERE key >= '0000000420x'")
def kv_iter_seek(spark, d):
    return kv.iterate_numbered(b.kv_orders(spark, d), 1, seek="0000000420x")


@query(f"SELECT key, value, row_number() OVER (ORDER BY key DESC) - 1 AS pos FROM {b.KV1} WHERE key <= (SELECT min(key) FROM {b.KV1} WHERE key >= '0000000420x')")
def kv_iter_seek_reverse(spark, d):
    return kv.iterate_numbered(b.kv_orders(spark, d), 1, seek="0000000420x", reverse=True)


@query(f"SELECT bucket_id, key, value FROM {b.KV} QUALIFY key = min(key) OVER (PARTITION BY bucket_id)")
def kv_pop_min(spark, d):
    return kv.pop(b.kv_orders(spark, d))[0].select("bucket_id", "key", "value")


@query(f"SELECT bucket_id, key, value FROM {b.KV} QUALIFY key < max(key) OVER (PARTITION BY bucket_id)")
def kv_pop_max(spark, d):
    """What is left after popping the largest key of each bucket."""
    return kv.pop(b.kv_orders(spark, d), largest=True)[1].select("bucket_id", "key", "value")


# Key/value: replay and value functions


def _puts(spark, d):
    """A put for each customer: its balance."""
    return b.table(spark, d, "customer").select(b.bucket("c_custkey"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))


_PUTS = "(SELECT c_custkey % 2 + 1 AS bucket_id, c_custkey AS key, c_acctbal AS value FROM customer)"


@query(f"SELECT bucket_id, key, value FROM {b.LWW}")
def kv_replay_lww(spark, d):
    return replay.kv(b.event_log(spark, d)).select("bucket_id", "key", "value")


@query(f"SELECT bucket_id, key, arg_min(value, seq) AS value FROM {b.EVENTS} WHERE event_type <> 'error' GROUP BY ALL")
def kv_put_if_not_exists(spark, d):
    log = b.event_log(spark, d).where(F.col("flag") == int(Flag.SET))
    return replay.first_writer(log, ["bucket_id", "key"], ["value"])


@query(f"SELECT s.bucket_id, s.key, coalesce(p.value, s.value) AS value FROM {b.LWW} s LEFT JOIN {_PUTS} p ON p.key = s.key AND p.bucket_id = s.bucket_id")
def kv_put_if_exists(spark, d):
    return kv.put_if_exists(replay.kv(b.event_log(spark, d)), _puts(spark, d)).select("bucket_id", "key", "value")


@query(f"SELECT s.bucket_id, s.key, s.value AS old, p.value FROM {b.LWW} s JOIN {_PUTS} p ON p.key = s.key AND p.bucket_id = s.bucket_id")
def kv_get_set_old(spark, d):
    return kv.get_set(replay.kv(b.event_log(spark, d)), _puts(spark, d))


@query(f"SELECT c_custkey % 2 + 1 AS bucket_id, c_custkey AS key, (c_nationkey + coalesce(n, 0))::BIGINT::VARCHAR AS value FROM customer LEFT JOIN (SELECT bucket_id, key, sum(CASE event_type WHEN 'purchase' THEN seq ELSE -seq END) AS n FROM {b.EVENTS} WHERE event_type IN ('purchase', 'error') GROUP BY ALL) e ON e.key = c_custkey AND e.bucket_id = c_custkey % 2 + 1")
def kv_incr_decr(spark, d):
    state = b.table(spark, d, "customer").select(b.bucket("c_custkey"), F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("string").alias("value"))
    log = b.event_log(spark, d).where(F.col("event_type").isin("purchase", "error"))
    amounts = log.select("bucket_id", "key", F.when(F.col("event_type") == "purchase", F.col("commit_seq")).otherwise(-F.col("commit_seq")).alias("n"))
    return kv.incr_by(state, amounts)


@query("SELECT o_orderkey AS key, ((o_orderkey::HUGEINT * 9223372036854775)::HUGEINT + 9223372036854775807)::VARCHAR AS value FROM orders")
def kv_incr_by_big(spark, d):
    base = (F.col("o_orderkey").cast("decimal(38,0)") * F.lit(9223372036854775)).cast("decimal(38,0)").cast("string")
    return b.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), binary.add_text(base, F.lit(9223372036854775807)).alias("value"))


@query(f"SELECT bucket_id, key, coalesce(c.value, '') || coalesce(e.tail, '') AS value FROM (SELECT c_custkey % 2 + 1 AS bucket_id, c_custkey AS key, c_mktsegment AS value FROM customer) c FULL JOIN (SELECT bucket_id, key, string_agg(event_type, '' ORDER BY seq) AS tail FROM {b.EVENTS} GROUP BY ALL) e USING (bucket_id, key)")
def kv_append(spark, d):
    state = b.table(spark, d, "customer").select(b.bucket("c_custkey"), F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    return kv.append(state, b.event_log(spark, d).select("bucket_id", "key", F.col("commit_seq").alias("ord"), F.col("event_type").alias("value")))


@query(f"SELECT bucket_id, key, CASE WHEN strlen(value) > 2 THEN substr(value, 3, 4) END AS part FROM {b.KV}")
def kv_get_range(spark, d):
    return b.kv_orders(spark, d).select("bucket_id", "key", binary.get_range(F.col("value"), 2, 5).alias("part"))


@query(f"SELECT bucket_id, key, CASE WHEN strlen(value) > 9 THEN hex(substr(value, 10, 1)) ELSE '00' END AS byte FROM {b.KV}")
def kv_get_bit(spark, d):
    return b.kv_orders(spark, d).select("bucket_id", "key", F.hex(binary.get_byte(F.col("value"), 9)).alias("byte"))


@query(f"SELECT bucket_id, key, CASE WHEN strlen(value) > 9 THEN hex(substr(value, 1, 9)) || '43' || hex(substr(value, 11)) ELSE hex(value) || repeat('00', (9 - strlen(value))::BIGINT) || '43' END AS value FROM {b.KV}")
def kv_set_bit(spark, d):
    return b.kv_orders(spark, d).select("bucket_id", "key", F.hex(binary.set_byte(F.col("value"), 9, 0x43)).alias("value"))


@query("SELECT o_orderkey % 2 + 1 AS bucket_id, o_custkey AS key, max(o_orderkey) AS value FROM orders GROUP BY ALL")
def kv_mset(spark, d):
    pairs = b.table(spark, d, "orders").select(b.bucket("o_orderkey"), F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("op_seq"), F.col("o_orderkey").alias("value"))
    return replay.last_writer(pairs, ["bucket_id", "key"], ["value"], F.col("op_seq"))


@query(f"SELECT bucket_id, key, value FROM {b.LWW} s WHERE NOT EXISTS (FROM {_PUTS} p WHERE p.key = s.key AND p.bucket_id = s.bucket_id)")
def kv_delete(spark, d):
    return kv.delete(replay.kv(b.event_log(spark, d)), _puts(spark, d)).select("bucket_id", "key", "value")


# Time to live


@query(f"SELECT bucket_id, key, value FROM {b.LWW} WHERE {b.LIVE}")
def ttl_live(spark, d):
    return replay.kv(b.event_log(spark, d), b.NOW_MS).select("bucket_id", "key", "value")


@query(f"SELECT bucket_id, key, value FROM {b.LWW} WHERE NOT {b.LIVE}")
def ttl_expired(spark, d):
    return ttl.expired(replay.kv(b.event_log(spark, d)), b.NOW_MS).select("bucket_id", "key", "value")


@query(f"SELECT bucket_id, key, CASE WHEN ttl_s = 0 THEN -1 ELSE greatest(floor((ts_ms + ttl_s * 1000 - {b.NOW_MS}) / 1000), 0) END::BIGINT AS ttl FROM {b.LWW}")
def ttl_remaining(spark, d):
    return replay.kv(b.event_log(spark, d)).select("bucket_id", "key", ttl.remaining(b.NOW_MS).alias("ttl"))


@query(f"SELECT bucket_id, key, value, CASE WHEN EXISTS (FROM {_PUTS} p WHERE p.key = s.key AND p.bucket_id = s.bucket_id) THEN 0 ELSE ttl_s END::BIGINT AS ttl_s FROM {b.LWW} s WHERE {b.LIVE}")
def ttl_persist(spark, d):
    return kv.persist(replay.kv(b.event_log(spark, d), b.NOW_MS), _puts(spark, d)).select("bucket_id", "key", "value", "ttl_s")


@query(f"SELECT bucket_id, min(key) AS min_key, max(key) AS max_key FROM {b.LWW} WHERE {b.LIVE} GROUP BY bucket_id")
def ttl_min_max_key(spark, d):
    return kv.key_bounds(replay.kv(b.event_log(spark, d), b.NOW_MS))


@query(f"SELECT bucket_id, key FROM {b.LWW} s WHERE NOT {b.LIVE} AND EXISTS (FROM {b.EVENTS} e WHERE e.key = s.key AND e.bucket_id = s.bucket_id AND e.ts_ms = s.ts_ms AND seq % 3 = 0)")
def ttl_purge_compare_and_delete(spark, d):
    """Of the keys seen expired, here at every third commit, those whose timestamp is still the one seen."""
    seen = b.event_log(spark, d).where("commit_seq % 3 = 0")
    return ttl.purge_candidates(replay.kv(b.event_log(spark, d)), seen, b.NOW_MS).select("bucket_id", "key")


# Lists


@query(f"SELECT bucket_id, key, pos, value FROM {b.LISTPOS} WHERE pos BETWEEN 2 AND 7")
def list_lrange(spark, d):
    return lists.lrange(b.list_events(spark, d), 2, 7)


@query(f"SELECT bucket_id, key, pos, value FROM {b.LISTPOS} WHERE pos BETWEEN n - 5 AND n - 2")
def list_lrange_negative(spark, d):
    return lists.lrange(b.list_events(spark, d), -5, -2)


@query(f"SELECT bucket_id, key, count(*) AS n FROM {b.LIST} GROUP BY ALL")
def list_lsize(spark, d):
    return lists.lsize(b.list_events(spark, d))


@query(f"SELECT bucket_id, key, arg_min(value, list_seq) AS head, arg_max(value, list_seq) AS tail FROM {b.LIST} GROUP BY ALL")
def list_peek_both(spark, d):
    return lists.peek(b.list_events(spark, d))


_LREM = f"SELECT bucket_id, key, value, list_seq FROM (SELECT *, sum((value = 3)::INT) OVER (PARTITION BY bucket_id, key ORDER BY list_seq {{o}} ROWS UNBOUNDED PRECEDING) AS nth FROM {b.LIST}) WHERE NOT (value = 3 AND nth <= {{n}})"


@query(_LREM.format(o="ASC", n=2))
def list_lrem_head(spark, d):
    return lists.lrem(b.list_events(spark, d), 2, F.lit(3)).select("bucket_id", "key", "value", "list_seq")


@query(_LREM.format(o="DESC", n=2))
def list_lrem_tail(spark, d):
    return lists.lrem(b.list_events(spark, d), -2, F.lit(3)).select("bucket_id", "key", "value", "list_seq")


@query(f"SELECT bucket_id, key, value, list_seq FROM {b.LIST} WHERE value <> 3")
def list_lrem_all(spark, d):
    return lists.lrem(b.list_events(spark, d), 0, F.lit(3)).select("bucket_id", "key", "value", "list_seq")


@query(f"SELECT bucket_id, key, value, list_seq FROM {b.LISTPOS} WHERE pos BETWEEN 1 AND n - 2")
def list_ltrim(spark, d):
    return lists.ltrim(b.list_events(spark, d), 1, -2).select("bucket_id", "key", "value", "list_seq")


@query(f"SELECT bucket_id, key, value, list_seq FROM {b.LISTPOS} WHERE pos NOT IN (0, 2, 5, 88)")
def list_rem_by_index(spark, d):
    return lists.rem_by_index(b.list_events(spark, d), [0, 2, 5, 88, -8]).select("bucket_id", "key", "value", "list_seq")


@query(f"SELECT DISTINCT bucket_id, key FROM {b.LIST} WHERE regexp_matches(key::VARCHAR, '^.[0-4]$')")
def list_keys_glob(spark, d):
    return lists.keys(b.list_events(spark, d), "?[0-4]")


@query(f"SELECT bucket_id, key, value, list_seq FROM {b.LIST} UNION ALL SELECT bucket_id, key, 100 + i, m + i + 1 FROM (SELECT bucket_id, key, max(list_seq) AS m, unnest([0, 1, 2]) AS i FROM {b.LIST} GROUP BY bucket_id, key)")
def list_push_right(spark, d):
    state = b.list_events(spark, d)
    return lists.push(state, _pushed(state)).select("bucket_id", "key", "value", "list_seq")


def _pushed(state):
    more = state.select("bucket_id", "key").distinct().select("bucket_id", "key", F.explode(F.array(*map(F.lit, range(3)))).alias("ord"))
    return more.withColumn("value", (F.col("ord") + 100).cast("bigint"))


@query(f"SELECT bucket_id, key, value, list_seq FROM {b.LIST} UNION ALL SELECT bucket_id, key, 100 + i, m - i - 1 FROM (SELECT bucket_id, key, min(list_seq) AS m, unnest([0, 1, 2]) AS i FROM {b.LIST} GROUP BY bucket_id, key)")
def list_push_left(spark, d):
    state = b.list_events(spark, d)
    return lists.push(state, _pushed(state), right=False).select("bucket_id", "key", "value", "list_seq")


@query("""WITH RECURSIVE o AS (SELECT event_id % 2 + 1 AS bucket_id, user_id AS key, row_number() OVER (PARTITION BY event_id % 2, user_id ORDER BY event_id) AS i, event_type AS t, event_id AS v FROM events WHERE event_type <> 'purchase'),
f AS (SELECT DISTINCT bucket_id, key, 0::BIGINT AS i, []::BIGINT[] AS l FROM o
UNION ALL SELECT f.bucket_id, f.key, o.i, CASE WHEN t = 'view' THEN list_append(l, v) WHEN t = 'click' THEN list_prepend(v, l) WHEN len(l) = 0 THEN l WHEN t = 'error' THEN l[2:] ELSE l[1:len(l) - 1] END FROM f JOIN o ON o.bucket_id = f.bucket_id AND o.key = f.key AND o.i = f.i + 1)
SELECT bucket_id, key, len(l)::BIGINT AS n, coalesce(array_to_string(l, ','), '') AS elements FROM f WHERE i = (SELECT max(i) FROM o WHERE o.key = f.key AND o.bucket_id = f.bucket_id)""")
def list_deque_fold(spark, d):
    kind = F.create_map(*[F.lit(x) for x in ("view", "R", "click", "L", "error", "l", "signup", "r")])
    events = b.table(spark, d, "events").select(b.bucket("event_id"), F.col("user_id").alias("key"), "event_id", "event_type")
    out = replay.deque_fold(events, ["bucket_id", "key"], ["event_id"], F.try_element_at(kind, F.col("event_type")), "event_id")
    return out.select("bucket_id", "key", F.size("elements").alias("n"), F.array_join(F.col("elements").cast("array<string>"), ",").alias("elements"))


@query("""WITH RECURSIVE o AS (SELECT event_id % 2 + 1 AS bucket_id, user_id AS key, row_number() OVER (PARTITION BY event_id % 2, user_id ORDER BY event_id) AS i, event_type AS t, event_id AS v FROM events WHERE event_type IN ('view', 'error')),
f AS (SELECT DISTINCT bucket_id, key, 0::BIGINT AS i, []::BIGINT[] AS l FROM o
UNION ALL SELECT f.bucket_id, f.key, o.i, CASE WHEN t = 'view' THEN list_append(l, v) ELSE l[2:] END FROM f JOIN o ON o.bucket_id = f.bucket_id AND o.key = f.key AND o.i = f.i + 1)
SELECT bucket_id, key, unnest(l) AS value FROM f WHERE i = (SELECT max(i) FROM o WHERE o.key = f.key AND o.bucket_id = f.bucket_id)""")
def list_queue_closed_form(spark, d):
    ops = b.table(spark, d, "events").where(F.col("event_type").isin("view", "error")).select(b.bucket("event_id"), F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "view").alias("push"))
    return lists.queue_survivors(ops).select("bucket_id", "key", F.col("seq").alias("value"))


@query(f"SELECT bucket_id, key, len(l)::BIGINT AS n, coalesce(array_to_string(l, ','), '') AS elements FROM {b.LISTLOG}")
def list_replay_all_operations(spark, d):
    state = replay.lists(b.list_log(spark, d))
    out = state.groupBy("bucket_id", "key").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("list_seq", "value"))).alias("l"))
    return out.select("bucket_id", "key", "n", F.array_join(F.transform("l", lambda x: x["value"].cast("string")), ",").alias("elements"))


@query(f"SELECT bucket_id, key, arg_max(ttl_s, seq) AS ttl_s, arg_max(ts_ms + ttl_s * 1000 <= {b.NOW_MS} AND ttl_s > 0, seq) AS over FROM {b.EVENTS} WHERE event_type = 'purchase' GROUP BY ALL")
def list_ttl(spark, d):
    log = b.event_log(spark, d).where("event_type = 'purchase'").withColumns({"ds": F.lit(int(Ds.LIST)), "flag": F.lit(int(Flag.EXPIRELIST))})
    return replay.list_meta(log).select("bucket_id", "key", "ttl_s", ttl.is_expired(b.NOW_MS).alias("over"))


# Sets


@query(f"SELECT bucket_id, key, member FROM {b.SET} UNION SELECT 1, 1, s_suppkey FROM supplier")
def set_add(spark, d):
    more = b.table(spark, d, "supplier").select(F.lit(1).cast("long").alias("bucket_id"), F.lit(1).cast("long").alias("key"), F.col("s_suppkey").alias("member"))
    return sets.add(b.set_lineitem(spark, d), more)


@query(f"SELECT bucket_id, key, member FROM {b.SET} EXCEPT SELECT 1, l_suppkey, l_partkey FROM lineitem WHERE l_quantity > 25")
def set_rem(spark, d):
    """The parts of large lines are removed from the sets of one bucket."""
    gone = b.table(spark, d, "lineitem").where("l_quantity > 25").select(F.lit(1).cast("long").alias("bucket_id"), F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("member"))
    return sets.remove(b.set_lineitem(spark, d), gone)


@query(f"SELECT member FROM {b.SET} WHERE bucket_id = 2 AND key = 3")
def set_members(spark, d):
    return sets.members(b.set_lineitem(spark, d), 2, 3)


_PAIRS = "SELECT (l_linenumber % 2 + 1)::BIGINT AS bucket_id, l_suppkey AS key, l_partkey AS member FROM lineitem UNION SELECT l_linenumber % 2 + 1, l_suppkey, l_partkey + {} FROM lineitem"
_IN = "s.bucket_id = a.bucket_id AND s.key = a.key AND s.member = a.member"


def _asked(spark, d, shift):
    """Each line's pair, and the same with its part key shifted."""
    lines = b.table(spark, d, "lineitem")
    return lines.select(b.bucket("l_linenumber"), F.col("l_suppkey").alias("key"), F.explode(F.array(F.col("l_partkey"), F.col("l_partkey") + shift)).alias("member"))


@query(f"SELECT a.bucket_id, a.key, a.member, s.key IS NOT NULL AS present FROM ({_PAIRS.format('1')}) a LEFT JOIN {b.SET} s ON {_IN}")
def set_is_member(spark, d):
    return sets.are_members(b.set_lineitem(spark, d), _asked(spark, d, F.lit(1)))


@query(f"SELECT a.bucket_id, a.key, bool_and(s.key IS NOT NULL) AS all_present FROM ({_PAIRS.format('l_suppkey % 2')}) a LEFT JOIN {b.SET} s ON {_IN} GROUP BY ALL")
def set_are_members(spark, d):
    """Only odd keys are asked for shifted members, so that both answers occur."""
    return sets.all_members(b.set_lineitem(spark, d), _asked(spark, d, F.col("l_suppkey") % 2))


@query(f"SELECT bucket_id, key, count(*) AS n FROM {b.SET} GROUP BY ALL")
def set_card(spark, d):
    return sets.card(b.set_lineitem(spark, d))


@query(f"SELECT i::BIGINT AS bucket_id, s_suppkey AS key, (i, s_suppkey) IN (SELECT (bucket_id, key) FROM {b.SET}) AS present FROM supplier, range(1, 4) r(i)")
def set_has_key(spark, d):
    asked = b.table(spark, d, "supplier").select(F.explode(F.array(*map(F.lit, (1, 2, 3))).cast("array<bigint>")).alias("bucket_id"), F.col("s_suppkey").alias("key"))
    return sets.has_keys(b.set_lineitem(spark, d), asked)


_ONE, _TWO = f"SELECT member FROM {b.SET} WHERE bucket_id = 1 AND key = 1", f"SELECT member FROM {b.SET} WHERE bucket_id = 1 AND key = 2"


@query(f"{_ONE} EXCEPT {_TWO}")
def set_diff(spark, d):
    return sets.diff(b.set_lineitem(spark, d), (1, 1), (1, 2))


@query(f"{_ONE} UNION {_TWO}")
def set_union(spark, d):
    return sets.union(b.set_lineitem(spark, d), (1, 1), (1, 2))


@query(f"{_ONE} INTERSECT {_TWO}")
def set_inter(spark, d):
    return sets.inter(b.set_lineitem(spark, d), (1, 1), (1, 2))


def _move(target: str) -> str:
    here = f"bucket_id = 1 AND key = 1 AND member = (SELECT min(member) FROM {b.SET} WHERE bucket_id = 1 AND key = 1)"
    return f"SELECT bucket_id, key, member FROM {b.SET} WHERE NOT ({here}) UNION SELECT {target}, member FROM {b.SET} WHERE {here}"


def _moved(spark, d, target):
    s = b.set_lineitem(spark, d)
    first = s.where("bucket_id = 1 and key = 1").agg(F.min("member")).first()[0]
    return sets.move(s, (1, 1), target, first).select("bucket_id", "key", "member")


@query(_move("1, 2"))
def set_move(spark, d):
    return _moved(spark, d, (1, 2))


@query(_move("2, 5"))
def set_two_bucket_move(spark, d):
    return _moved(spark, d, (2, 5))


@query(f"SELECT bucket_id, key, min(member) AS member FROM {b.SET} GROUP BY ALL")
def set_pop_min(spark, d):
    return sets.pop(b.set_lineitem(spark, d))


@query(f"SELECT DISTINCT bucket_id, key FROM {b.SET} WHERE regexp_matches(key::VARCHAR, '^[^1].*$')")
def set_keys_glob(spark, d):
    return sets.keys(b.set_lineitem(spark, d), "[^1]*")


@query(f"SELECT key, member FROM {b.SET} WHERE bucket_id = 1 EXCEPT SELECT key, member FROM {b.SET} WHERE bucket_id = 2")
def set_two_bucket_diff(spark, d):
    return sets.diff_buckets(b.set_lineitem(spark, d), 1, 2).select("key", "member")


@query(f"SELECT DISTINCT key, member FROM {b.SET}")
def set_two_bucket_union(spark, d):
    return sets.union_buckets(b.set_lineitem(spark, d), 1, 2).select("key", "member")


# Sorted sets


@query(f"SELECT member, score FROM {b.ZSET} WHERE bucket_id = 2 AND key = 7")
def z_members(spark, d):
    return zsets.members(b.zset_customer(spark, d), 2, 7)


@query(f"SELECT bucket_id, key, count(*) AS n FROM {b.ZSET} GROUP BY ALL")
def z_card(spark, d):
    return zsets.card(b.zset_customer(spark, d))


@query(f"SELECT bucket_id, key, least(count(*), 20) AS n FROM {b.ZSET} WHERE score BETWEEN 0 AND 5000 GROUP BY ALL")
def z_count(spark, d):
    return zsets.count(b.zset_customer(spark, d), 0, 5000, 20)


@query(f"SELECT bucket_id, key, member, score, row_number() OVER (PARTITION BY bucket_id, key ORDER BY score, member) AS pos FROM {b.ZSET} WHERE score BETWEEN 1000 AND 6000")
def z_range_score(spark, d):
    return zsets.range_by_score(b.zset_customer(spark, d), 1000, 6000).select("bucket_id", "key", "member", "score", "pos")


@query(f"SELECT * FROM (SELECT bucket_id, key, member, score, row_number() OVER (PARTITION BY bucket_id, key ORDER BY score DESC, member DESC) AS pos FROM {b.ZSET} WHERE score > 1000 AND score <= 6000) WHERE pos <= 5")
def z_range_score_reverse_exclusive_limit(spark, d):
    return zsets.range_by_score(b.zset_customer(spark, d), 6000, 1000, 5, exclude_end=True).select("bucket_id", "key", "member", "score", "pos")


@query(f"SELECT bucket_id, key, member, score, rank, rank - 2 AS pos FROM {b.ZRANK} WHERE rank BETWEEN 3 AND 6")
def z_range_rank(spark, d):
    return zsets.range_by_rank(b.zset_customer(spark, d), 3, 6).select("bucket_id", "key", "member", "score", "rank", "pos")


@query(f"SELECT bucket_id, key, member, score, rank, rank - greatest(n - 3, 1) + 1 AS pos FROM {b.ZRANK} WHERE rank BETWEEN greatest(n - 3, 1) AND n")
def z_range_rank_negative(spark, d):
    return zsets.range_by_rank(b.zset_customer(spark, d), -4, -1).select("bucket_id", "key", "member", "score", "rank", "pos")


@query(f"SELECT bucket_id, key, member, score, rank, least(8, n) - rank + 1 AS pos FROM {b.ZRANK} WHERE rank BETWEEN 4 AND 8")
def z_range_rank_reversed(spark, d):
    return zsets.range_by_rank(b.zset_customer(spark, d), 8, 4).select("bucket_id", "key", "member", "score", "rank", "pos")


@query(f"SELECT bucket_id, key, member, score FROM {b.ZRANK} WHERE NOT rank BETWEEN least(2, greatest(n - 1, 1)) AND greatest(2, n - 1)")
def z_rem_range_rank(spark, d):
    return zsets.remove_range_by_rank(b.zset_customer(spark, d), 2, -2).select("bucket_id", "key", "member", "score")


@query(f"SELECT bucket_id, key, member, rank FROM {b.ZRANK}")
def z_rank(spark, d):
    return zsets.ranked(b.zset_customer(spark, d)).select("bucket_id", "key", "member", "rank")


@query(f"SELECT bucket_id, key, member, n - rank + 1 AS rev_rank FROM {b.ZRANK}")
def z_revrank(spark, d):
    return zsets.ranked(b.zset_customer(spark, d)).select("bucket_id", "key", "member", "rev_rank")


@query(f"SELECT bucket_id, key, member, score FROM {b.ZSET}")
def z_score(spark, d):
    """The score of every customer."""
    asked = b.table(spark, d, "customer").select(b.bucket("c_custkey"), F.col("c_nationkey").cast("long").alias("key"), F.col("c_name").alias("member"))
    return zsets.score(b.zset_customer(spark, d), asked)


@query(f"SELECT bucket_id, key, member, score FROM {b.ZRANK} WHERE rank = n")
def z_peek_max(spark, d):
    return zsets.peek_max(b.zset_customer(spark, d))


@query(f"SELECT bucket_id, key, member, score FROM {b.ZRANK} WHERE rank = 1")
def z_peek_min(spark, d):
    return zsets.peek_min(b.zset_customer(spark, d))


@query(f"SELECT bucket_id, key, member, score FROM {b.ZRANK} WHERE rank < n")
def z_pop_max(spark, d):
    return zsets.pop(b.zset_customer(spark, d)).select("bucket_id", "key", "member", "score")


@query(f"SELECT bucket_id, key, member, score FROM {b.ZSETLOG}")
def z_pop_fold(spark, d):
    return replay.zsets(b.zset_log(spark, d)).select("bucket_id", "key", "member", "score")


@query(f"SELECT bucket_id, key, member, score FROM {b.ZSET} WHERE member NOT IN (SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING')")
def z_rem(spark, d):
    gone = b.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(b.bucket("c_custkey"), F.col("c_nationkey").cast("long").alias("key"), F.col("c_name").alias("member"))
    return zsets.remove(b.zset_customer(spark, d), gone).select("bucket_id", "key", "member", "score")


@query(f"SELECT DISTINCT bucket_id, key FROM {b.ZSET} WHERE regexp_matches(key::VARCHAR, '^2.*$')")
def z_keys_glob(spark, d):
    return zsets.keys(b.zset_customer(spark, d), "2*")


@query(f"SELECT bucket_id, key, member, row_number() OVER (PARTITION BY bucket_id, key ORDER BY floor(score / 1000), member) AS rank FROM {b.ZSET}")
def z_tie_order(spark, d):
    tied = b.zset_customer(spark, d).withColumn("score", F.floor(F.col("score") / 1000).cast("double"))
    return zsets.ranked(tied).select("bucket_id", "key", "member", "rank")


# Catalog and log


@query(f"SELECT n_name AS name FROM nation WHERE n_nationkey % 5 <> 0 AND n_regionkey % 4 = 1 AND regexp_matches(n_name, '^[A-Z].*[0-9]$')")
def bucket_iterate_glob(spark, d):
    return buckets.iterate(b.catalog_nation(spark, d), 1, "[A-Z]*[0-9]")


@query("SELECT c_nationkey::BIGINT AS bucket_id, count(*) AS n FROM customer WHERE c_nationkey % 5 <> 0 GROUP BY c_nationkey")
def bucket_delete_orphans(spark, d):
    rows = b.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("bucket_id"))
    return buckets.without_orphans(rows, b.catalog_nation(spark, d)).groupBy("bucket_id").agg(F.count("*").alias("n"))


_STATES = f"""SELECT 'kv' AS structure, bucket_id, key::VARCHAR AS key, value::VARCHAR AS value, NULL::DOUBLE AS place FROM {b.LWW}
UNION ALL SELECT 'set', bucket_id, key::VARCHAR, member::VARCHAR, NULL FROM {b.SETLOG} UNION ALL SELECT 'zset', bucket_id, key::VARCHAR, member, score FROM {b.ZSETLOG}
UNION ALL SELECT 'list', bucket_id, key::VARCHAR, l[i]::VARCHAR, i::DOUBLE FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM {b.LISTLOG})"""


def _states(log):
    none = F.lit(None).cast("double")
    elements = lists.positioned(replay.lists(log)).withColumn("place", (F.col("pos") + 1).cast("double"))
    parts = [("kv", replay.kv(log), "value", none), ("set", replay.sets(log), "member", none), ("zset", replay.zsets(log), "member", F.col("score")), ("list", elements, "value", F.col("place"))]
    out = None
    for name, state, value, place in parts:
        rows = state.select(F.lit(name).alias("structure"), "bucket_id", "key", F.col(value).alias("value"), place.alias("place"))
        out = rows if out is None else out.union(rows)
    return out


@query(_STATES)
def compaction_equivalence(spark, d):
    """All four structures from a compacted first half of the log and the rest of it as it is."""
    log = b.full_log(spark, d)
    half = log.agg(F.expr("percentile_approx(commit_seq, 0.5)")).first()[0]
    early, late = log.where(F.col("commit_seq") < half), log.where(F.col("commit_seq") >= half)
    compacted = materialize(replay.as_log(early, half - 1), "compacted")  # written once, as a compaction is
    return _states(compacted.unionByName(late))


@query(f"SELECT {int(Ds.KV)}::BIGINT AS ds, count(*) AS n FROM {b.LWW} WHERE {b.LIVE} UNION ALL SELECT {int(Ds.SET)}, count(*) FROM {b.SETLOG} UNION ALL SELECT {int(Ds.ZSET)}, count(*) FROM {b.ZSETLOG} UNION ALL SELECT {int(Ds.LIST)}, sum(len(l))::BIGINT FROM {b.LISTLOG}")
def record_count(spark, d):
    return replay.record_counts(b.full_log(spark, d), b.NOW_MS)


@query(f"SELECT bucket_id, key, value FROM (SELECT *, row_number() OVER (PARTITION BY bucket_id, key ORDER BY seq DESC) AS rn FROM {b.EVENTS} WHERE seq % 10 <> 3) WHERE rn = 1 AND event_type <> 'error'")
def txn_uncommitted_invisible(spark, d):
    log = b.event_log(spark, d)
    commits = log.where("commit_seq % 10 <> 3").select("commit_seq").distinct()
    return replay.kv(replay.committed(log, commits)).select("bucket_id", "key", "value")


def flagship(spark, d) -> DataFrame:
    """Replay the event log, keep live keys of a range, ten in key order."""
    state = replay.kv(b.event_log(spark, d), b.NOW_MS)
    return kv.Scan(state).bucket(1).from_key(0).to_key(10_000).take(10).frame("key", "value", "ttl_s")
