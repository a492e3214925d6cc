"""Every registered query of the engine equals its SQL on the smallest tables."""

import pytest
from oracle import assert_same, connect

from keelson.plans import bindings
from keelson.plans import queries as engine
from keelson.streaming import queries as streaming

FOLDER = "/root/testdata/sf0.001"
ALL = engine.QUERIES | streaming.QUERIES
SQL = engine.ORACLE | streaming.ORACLE


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_each_query_has_sql():
    assert set(ALL) == set(SQL)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, con, name):
    assert_same(ALL[name](spark, FOLDER), con, SQL[name])


def test_no_query_is_empty_on_both_sides(spark, con):
    for name, sql in SQL.items():
        assert con.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0] > 0, name


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    """Events within a millisecond of a whole second, of the end of their time to live, and of 1970."""
    d = tmp_path_factory.mktemp("edges")
    near = "unnest([-1500, -501, -500, -499, -1, 0, 1, 499, 500, 999, 999499, 999500, 999959])"
    ends = f"unnest([0, {bindings.NOW_MS}, {bindings.NOW_MS} + 7000])"  # of the events that live a day
    times = f"SELECT row_number() OVER () AS n, us FROM (SELECT (ends - if(ends = 0, 0, 86400000)) * 1000 + us AS us FROM (SELECT {ends} AS ends), (SELECT {near} AS us))"
    con = connect(str(d))
    con.execute(f"""COPY (SELECT n * 10 + k AS event_id, make_timestamp(us::BIGINT) AS ts, n * 10 + k AS user_id, CASE k WHEN 1 THEN 'purchase' ELSE 'view' END AS event_type,
    1.5::DOUBLE AS value FROM ({times}), (SELECT unnest([0, 1, 2, 6]) AS k)) TO '{d}/events.parquet'""")
    return str(d)


@pytest.mark.parametrize("name", ["ttl_remaining", "ttl_live", "ttl_expired", "ttl_min_max_key", "ttl_purge_compare_and_delete", "list_ttl", "stream_ttl_live"])
def test_times_are_rounded_to_milliseconds_as_in_sql(spark, edges, name):
    assert assert_same(ALL[name](spark, edges), connect(edges), SQL[name])


def test_epoch_ms_is_that_of_sql(spark, edges):
    got = bindings.table(spark, edges, "events").select("event_id", bindings.epoch_ms("ts").alias("ms"))
    assert_same(got, connect(edges), "SELECT event_id, epoch_ms(ts) AS ms FROM events")


def test_epoch_ms_in_a_zone_that_skips_an_hour(spark, tmp_path):
    con = connect(str(tmp_path))
    con.execute(f"COPY (SELECT i AS event_id, timestamp '2024-03-10 01:30:00' + to_minutes(i * 30) AS ts FROM range(5) r(i)) TO '{tmp_path}/events.parquet'")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = bindings.table(spark, str(tmp_path), "events").select("event_id", bindings.epoch_ms("ts").alias("ms"))
        assert_same(got, connect(str(tmp_path)), "SELECT event_id, epoch_ms(ts) AS ms FROM events")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("name", ["kv_iter_reverse", "kv_iter_seek", "kv_iter_seek_reverse"])
def test_iterations_are_whole(spark, name):
    rows = sorted(ALL[name](spark, FOLDER).collect(), key=lambda r: r["pos"])
    assert [r["pos"] for r in rows] == list(range(len(rows)))
    keys = [r["key"] for r in rows]
    assert keys == sorted(keys, reverse="reverse" in name)
    orders = sorted(f"{r['o_orderkey'] // 2:010d}" for r in spark.read.parquet(f"{FOLDER}/orders.parquet").collect() if r["o_orderkey"] % 2 == 0)
    start = next((k for k in orders if k >= "0000000420x"), None)
    assert len(keys) == len([k for k in orders if "seek" not in name or (start is not None and (k <= start if "reverse" in name else k >= start))])


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 10
    assert [r["key"] for r in rows] == sorted(r["key"] for r in rows)


def test_entry_without_the_corpus_folders():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
sys.modules['corpus_pipeline'] = None
sys.modules['keelson.llm'] = None
import __spark_entry__ as e
assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries())
assert len(e.queries()) > 90
"""
    subprocess.run([sys.executable, "-c", code], check=True)
