"""Structures, operation flags and table schemas."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import types as T


class Ds(IntEnum):
    """Structure of a bucket."""

    SET = 0
    ZSET = 1
    KV = 2
    LIST = 3


class Flag(IntEnum):
    """Operation of a log row."""

    DELETE = 0
    SET = 1
    LPUSH = 2
    RPUSH = 3
    LREM = 4
    LPOP = 5
    RPOP = 6
    LTRIM = 8
    ZADD = 9
    ZREM = 10
    ZREMRANGEBYRANK = 11
    ZPOPMAX = 12
    ZPOPMIN = 13
    LREMBYINDEX = 18
    EXPIRELIST = 19
    BUCKET_DELETE = 20
    #: The key exists, even if nothing is left in it.
    KEY = 21
    BUCKET_CREATE = 22


#: Order of the log: (commit_seq, op_seq).
OPLOG = T.StructType(
    [
        T.StructField("commit_seq", T.LongType()),
        T.StructField("op_seq", T.LongType()),
        T.StructField("ds", T.ShortType()),
        T.StructField("bucket_id", T.LongType()),
        T.StructField("flag", T.ShortType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("arg1", T.LongType()),
        T.StructField("arg2", T.LongType()),
        T.StructField("idx", T.ArrayType(T.IntegerType())),
        T.StructField("ttl_s", T.LongType()),
        T.StructField("ts_ms", T.LongType()),
    ]
)

BUCKETS = T.StructType(
    [
        T.StructField("bucket_id", T.LongType()),
        T.StructField("ds", T.ShortType()),
        T.StructField("name", T.StringType()),
        T.StructField("op", T.ShortType()),
        T.StructField("commit_seq", T.LongType()),
    ]
)
