"""Streaming queries over the supplied tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ttl
from ..plans.bindings import EVENTS, LWW, NOW_MS, bucket, catalog_nation, epoch_ms, event_log
from ..schema import Flag
from ..sources.oplog import OpLog
from ..sources.shared import new_path
from .watch import Watcher, kv_updates, newest, run_available, table_stream


def _log(spark):
    return OpLog(spark, new_path(spark, "log"))


def _followed(spark, log, ids, key, schema, row):
    """What a feed delivers of all commits, as rows: bounded by the changes of one key or bucket."""
    got = []
    watcher = Watcher(log, ids, key, got.extend, new_path(spark, "watch-checkpoint")).start(once=True)
    watcher.wait()
    return spark.createDataFrame([row(r) for r in got], schema)


def watch_feed(spark, d):
    """Changes of one key, delivered by a watcher of a log of all events in three commits."""
    log = _log(spark)
    events = event_log(spark, d)
    ops = events.select(F.col("commit_seq").alias("op_seq"), "ds", "bucket_id", "flag", *[F.col(c).cast("string").cast("binary").alias(c) for c in ("key", "value")], "ttl_s", "ts_ms")
    for part in range(3):
        log.append(ops.where(F.col("op_seq") % 3 == part))
    return _followed(spark, log, {2: "events"}, b"7", "seq long, key string, value string, flag long", lambda r: (r["op_seq"], bytes(r["key"]).decode(), bytes(r["value"]).decode(), r["flag"]))


def watch_bucket_delete(spark, d):
    """A watcher of each deleted bucket of the catalog gets one message, and ends."""
    log, catalog = _log(spark), catalog_nation(spark, d)
    for op in (Flag.BUCKET_CREATE, Flag.BUCKET_DELETE):
        log.append(catalog.where(F.col("op") == int(op)).select(F.lit(0).alias("op_seq"), "ds", "bucket_id", F.col("op").alias("flag"), F.col("name").cast("binary").alias("key")))
    # a row for each bucket that the query follows
    gone = [(r["bucket_id"], r["name"]) for r in catalog.where(F.col("op") == int(Flag.BUCKET_DELETE)).collect()]
    out = [_followed(spark, log, {i: name}, None, "bucket string, flag long", lambda r, name=name: (name, r["flag"])) for i, name in gone]
    return reduce(DataFrame.union, out)


def stream_kv_state(spark, d):
    """The last-writer-wins state kept by a streaming aggregation; the last update of a key counts."""
    log = table_stream(spark, d, "events").select(F.col("event_id").alias("commit_seq"), F.lit(0).alias("op_seq"), bucket("event_id"), F.col("user_id").alias("key"), "event_type", "value")
    out = run_available(kv_updates(log), new_path(spark, "state"), "update")
    return newest(out, ["bucket_id", "key"]).where("event_type <> 'error'").select("bucket_id", "key", "value")


def stream_ttl_live(spark, d):
    """Events of a stream that are alive at the clock."""
    e = table_stream(spark, d, "events").withColumns({"ttl_s": (F.col("event_id") % 5) * 86400, "ts_ms": epoch_ms("ts")})
    return run_available(ttl.live(e, NOW_MS).select(F.col("event_id").alias("seq"), "ttl_s"), new_path(spark, "ttl")).drop("_epoch")


QUERIES = {f.__name__: f for f in (watch_feed, watch_bucket_delete, stream_kv_state, stream_ttl_live)}
ORACLE = {
    "watch_feed": f"SELECT seq, key::VARCHAR AS key, value::VARCHAR AS value, CASE event_type WHEN 'error' THEN {int(Flag.DELETE)} ELSE {int(Flag.SET)} END::BIGINT AS flag FROM {EVENTS} WHERE key = 7 AND bucket_id = 2",
    "watch_bucket_delete": f"SELECT n_name AS bucket, {int(Flag.BUCKET_DELETE)}::BIGINT AS flag FROM nation WHERE n_nationkey % 5 = 0",
    "stream_kv_state": f"SELECT bucket_id, key, value FROM {LWW}",
    "stream_ttl_live": f"SELECT event_id AS seq, (event_id % 5) * 86400 AS ttl_s FROM events WHERE event_id % 5 = 0 OR epoch_ms(ts) + (event_id % 5) * 86400000 > {NOW_MS}",
}
