"""Collections over the supplied tables: the same definitions as DataFrames and as DuckDB SQL.

Each has two buckets that share keys, dealt by the parity of a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Ds, Flag

#: The clock of all queries: 2024-02-02 00:00 UTC, when some of the last events are over and some not.
NOW_MS = 1_706_832_000_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def bucket(column: str):
    return (F.col(column) % 2 + 1).cast("long").alias("bucket_id")


def epoch_ms(ts: str):
    """Milliseconds since 1970, rounded as DuckDB's epoch_ms does: to the nearest, halves away from zero. timestampdiff
    would move times that the session's zone skips."""
    since = f"(cast({ts} as timestamp_ntz) - timestamp_ntz'1970-01-01 00:00:00')"
    half = "interval '0.0005' second"
    return F.expr(f"({since} + if({since} < interval '0' second, -{half}, {half})) div interval '0.001' second")


# Key/value: orders


def kv_orders(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        bucket("o_orderkey"),
        F.lpad(F.expr("o_orderkey div 2").cast("string"), 10, "0").alias("key"),
        F.concat("o_orderpriority", F.lit("#"), F.col("o_custkey").cast("string")).alias("value"),
        F.lit(0).cast("long").alias("ttl_s"),
        F.lit(0).cast("long").alias("ts_ms"),
    )


KV = "(SELECT o_orderkey % 2 + 1 AS bucket_id, lpad((o_orderkey // 2)::VARCHAR, 10, '0') AS key, o_orderpriority || '#' || o_custkey::VARCHAR AS value FROM orders)"
#: One bucket of it.
KV1 = f"(SELECT key, value FROM {KV} WHERE bucket_id = 1)"

# Operation log: events


def event_log(spark, d) -> DataFrame:
    """A key/value log: an error deletes the user's key, any other event sets it to its value."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("commit_seq"),
        F.lit(0).cast("long").alias("op_seq"),
        F.lit(int(Ds.KV)).cast("short").alias("ds"),
        bucket("event_id"),
        F.when(F.col("event_type") == "error", int(Flag.DELETE)).otherwise(int(Flag.SET)).cast("short").alias("flag"),
        F.col("user_id").alias("key"),
        "value",
        ((F.col("event_id") % 5) * 86400).alias("ttl_s"),
        epoch_ms("ts").alias("ts_ms"),
        "event_type",
    )


EVENTS = "(SELECT event_id AS seq, event_id % 2 + 1 AS bucket_id, user_id AS key, value, event_type, (event_id % 5) * 86400 AS ttl_s, epoch_ms(ts) AS ts_ms FROM events)"
#: Last row of each key's log that is not a deletion.
LWW = f"(SELECT bucket_id, key, value, ttl_s, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY bucket_id, key ORDER BY seq DESC) AS rn FROM {EVENTS}) WHERE rn = 1 AND event_type <> 'error')"
LIVE = f"(ttl_s = 0 OR ts_ms + ttl_s * 1000 > {NOW_MS})"

# Lists: events


def list_events(spark, d) -> DataFrame:
    """List state: a view pushes to the tail, a click to the head, of the user's list."""
    from pyspark.sql import Window

    e = table(spark, d, "events").where(F.col("event_type").isin("view", "click"))
    nth = F.row_number().over(Window.partitionBy(F.col("event_id") % 2, "user_id", "event_type").orderBy("event_id"))
    return e.select(
        bucket("event_id"),
        F.col("user_id").alias("key"),
        F.when(F.col("event_type") == "view", nth).otherwise(-nth).cast("long").alias("list_seq"),
        (F.col("event_id") % 10).alias("value"),
    )


LIST = "(SELECT event_id % 2 + 1 AS bucket_id, user_id AS key, CASE WHEN event_type = 'view' THEN 1 ELSE -1 END * row_number() OVER (PARTITION BY event_id % 2, user_id, event_type ORDER BY event_id) AS list_seq, event_id % 10 AS value FROM events WHERE event_type IN ('view', 'click'))"
LISTPOS = f"(SELECT *, row_number() OVER (PARTITION BY bucket_id, key ORDER BY list_seq) - 1 AS pos, count(*) OVER (PARTITION BY bucket_id, key) AS n FROM {LIST})"


def list_log(spark, d) -> DataFrame:
    """A list log: view and click push, error pops the head, signup the tail; a purchase trims the
    list to its first 20 elements if its id is a multiple of 3, and else removes up to two equal elements from the tail."""
    e = table(spark, d, "events")
    t = F.col("event_type")
    trim = (t == "purchase") & (F.col("event_id") % 3 == 0)
    flag = F.when(t == "view", int(Flag.RPUSH)).when(t == "click", int(Flag.LPUSH)).when(t == "error", int(Flag.LPOP)).when(t == "signup", int(Flag.RPOP)).when(trim, int(Flag.LTRIM)).otherwise(int(Flag.LREM))
    return e.select(
        F.col("event_id").alias("commit_seq"),
        F.lit(0).cast("long").alias("op_seq"),
        F.lit(int(Ds.LIST)).cast("short").alias("ds"),
        bucket("event_id"),
        flag.cast("short").alias("flag"),
        F.col("user_id").alias("key"),
        (F.col("event_id") % 10).alias("value"),
        F.when(trim, 0).when(t == "purchase", -2).cast("long").alias("arg1"),
        F.when(trim, 19).cast("long").alias("arg2"),
        F.lit(None).cast("array<int>").alias("idx"),
        F.lit(0).cast("long").alias("ttl_s"),
        epoch_ms("ts").alias("ts_ms"),
    )


# Sets: lineitem, and the orders of customers


def set_lineitem(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(bucket("l_linenumber"), F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("member")).distinct()


SET = "(SELECT DISTINCT (l_linenumber % 2 + 1)::BIGINT AS bucket_id, l_suppkey AS key, l_partkey AS member FROM lineitem)"

# Sorted sets: customer


def zset_customer(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(bucket("c_custkey"), F.col("c_nationkey").cast("long").alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"))


ZSET = "(SELECT c_custkey % 2 + 1 AS bucket_id, c_nationkey::BIGINT AS key, c_name AS member, c_acctbal AS score FROM customer)"
ZRANK = f"(SELECT *, row_number() OVER (PARTITION BY bucket_id, key ORDER BY score, member) AS rank, count(*) OVER (PARTITION BY bucket_id, key) AS n FROM {ZSET})"


def zset_log(spark, d) -> DataFrame:
    """A sorted-set log: customers in order of their key are added, and two of every eight pop the largest."""
    c = table(spark, d, "customer")
    pop = F.col("c_custkey") % 8 < 2
    return c.select(
        F.col("c_custkey").alias("commit_seq"),
        F.lit(0).cast("long").alias("op_seq"),
        F.lit(int(Ds.ZSET)).cast("short").alias("ds"),
        bucket("c_custkey"),
        F.when(pop, int(Flag.ZPOPMAX)).otherwise(int(Flag.ZADD)).cast("short").alias("flag"),
        F.col("c_nationkey").cast("long").alias("key"),
        F.col("c_name").alias("value"),
        F.col("c_acctbal").alias("score"),
        F.lit(None).cast("long").alias("arg1"),
        F.lit(None).cast("long").alias("arg2"),
    )


# Catalog: nation


def catalog_nation(spark, d) -> DataFrame:
    """A bucket for each nation; those with a key divisible by five were deleted later."""
    n = table(spark, d, "nation")
    base = n.select(F.col("n_nationkey").cast("long").alias("bucket_id"), (F.col("n_regionkey") % 4).cast("short").alias("ds"), F.col("n_name").alias("name"))
    made = base.select("*", F.lit(int(Flag.BUCKET_CREATE)).cast("short").alias("op"), F.col("bucket_id").alias("commit_seq"))
    gone = base.where("bucket_id % 5 = 0").select("*", F.lit(int(Flag.BUCKET_DELETE)).cast("short").alias("op"), (F.col("bucket_id") + 1000).alias("commit_seq"))
    return made.union(gone)


# One log of all structures; keys and values are texts


def set_log(spark, d) -> DataFrame:
    """A set log: a line adds its part to its supplier's set, or removes it if it was returned."""
    lines = table(spark, d, "lineitem")
    return lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("commit_seq"),
        F.lit(0).cast("long").alias("op_seq"),
        F.lit(int(Ds.SET)).cast("short").alias("ds"),
        bucket("l_linenumber"),
        F.when(F.col("l_returnflag") == "R", int(Flag.DELETE)).otherwise(int(Flag.SET)).cast("short").alias("flag"),
        F.col("l_suppkey").alias("key"),
        F.col("l_partkey").alias("value"),
    )


def full_log(spark, d) -> DataFrame:
    parts = [event_log(spark, d).drop("event_type"), list_log(spark, d), set_log(spark, d), zset_log(spark, d)]
    out = None
    for part in parts:
        part = part.withColumns({"key": F.col("key").cast("string"), "value": F.col("value").cast("string")})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


SETLOG = """(SELECT bucket_id, key, member FROM (SELECT (l_linenumber % 2 + 1)::BIGINT AS bucket_id, l_suppkey AS key, l_partkey AS member, l_returnflag,
row_number() OVER (PARTITION BY l_linenumber % 2, l_suppkey, l_partkey ORDER BY l_orderkey * 10 + l_linenumber DESC) AS rn FROM lineitem) WHERE rn = 1 AND l_returnflag <> 'R')"""
#: Elements of the lists of list_log as arrays, by an ordered fold.
LISTLOG = """(WITH RECURSIVE o AS (SELECT event_id % 2 + 1 AS bucket_id, user_id AS key, row_number() OVER (PARTITION BY event_id % 2, user_id ORDER BY event_id) AS i, event_type AS t, event_id % 10 AS v, event_id % 3 = 0 AS trim FROM events),
f AS (SELECT DISTINCT bucket_id, key, 0::BIGINT AS i, []::BIGINT[] AS l FROM o
UNION ALL SELECT f.bucket_id, f.key, o.i, CASE WHEN t = 'view' THEN list_append(l, v) WHEN t = 'click' THEN list_prepend(v, l) WHEN len(l) = 0 THEN l WHEN t = 'error' THEN l[2:] WHEN t = 'signup' THEN l[1:len(l) - 1]
WHEN trim THEN l[1:20] ELSE list_filter(l, lambda x, k: x <> v OR len(list_filter(l[k + 1:], lambda y: y = v)) >= 2) END FROM f JOIN o ON o.bucket_id = f.bucket_id AND o.key = f.key AND o.i = f.i + 1)
SELECT bucket_id, key, l FROM f WHERE i = (SELECT max(i) FROM o WHERE o.key = f.key AND o.bucket_id = f.bucket_id) AND len(l) > 0)"""
#: Members of the sets of zset_log, by an ordered fold.
ZSETLOG = """(WITH RECURSIVE o AS (SELECT c_custkey % 2 + 1 AS bucket_id, c_nationkey::BIGINT AS key, row_number() OVER (PARTITION BY c_custkey % 2, c_nationkey ORDER BY c_custkey) AS i, c_custkey % 8 < 2 AS pop, {'s': c_acctbal, 'm': c_name} AS v FROM customer),
f AS (SELECT DISTINCT bucket_id, key, 0::BIGINT AS i, []::STRUCT(s DOUBLE, m VARCHAR)[] AS l FROM o
UNION ALL SELECT f.bucket_id, f.key, o.i, CASE WHEN NOT pop THEN list_append(l, v) WHEN len(l) = 0 THEN l ELSE list_sort(l)[1:len(l) - 1] END FROM f JOIN o ON o.bucket_id = f.bucket_id AND o.key = f.key AND o.i = f.i + 1),
e AS (SELECT bucket_id, key, unnest(l) AS x FROM f WHERE i = (SELECT max(i) FROM o WHERE o.key = f.key AND o.bucket_id = f.bucket_id))
SELECT bucket_id, key, x.m AS member, x.s AS score FROM e)"""
