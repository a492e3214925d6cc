"""Reads of the ordered key/value state (bucket_id, key, value, ttl_s, ts_ms)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import binary
from ..sources.shared import materialize
from .ttl import is_live


def successor(prefix):
    """The least key above all keys with this prefix, or None."""
    raw = prefix.encode("utf-8") if isinstance(prefix, str) else bytes(prefix)
    while raw and raw[-1] == 0xFF:
        raw = raw[:-1]
    if not raw:
        return None
    out = raw[:-1] + bytes([raw[-1] + 1])
    if not isinstance(prefix, str):
        return out
    try:
        return out.decode("utf-8")
    except UnicodeDecodeError:
        return None


def literal(key) -> Column:
    return F.lit(bytearray(key)) if isinstance(key, (bytes, bytearray)) else F.lit(key)


def _text(state: DataFrame) -> Column:
    """A key to match expressions against; bytes are read one character each."""
    return F.decode("key", "ISO-8859-1") if dict(state.dtypes)["key"] == "binary" else F.col("key")


@dataclass(frozen=True)
class Scan:
    """A scan under construction: bounds, prefix, expression, conditions, direction, offset and limit.

    Bounds and prefixes become range conditions on the key column, which reach the file scan; order
    and limit become a top-n. Nothing runs until a result is asked for.
    """

    state: DataFrame
    now_ms: int | None = None
    low: object = None
    high: object = None
    start: object = None
    pattern: str | None = None
    conditions: tuple = ()
    offset: int = 0
    limit: int | None = None
    reverse: bool = False
    expired: bool = False

    def bucket(self, bucket_id: int) -> Scan:
        return replace(self, conditions=(*self.conditions, F.col("bucket_id") == bucket_id))

    def from_key(self, key) -> Scan:
        """First key of the scan: the lower end, or the upper one of a descending scan."""
        return replace(self, low=key)

    def to_key(self, key) -> Scan:
        return replace(self, high=key)

    def prefix(self, prefix) -> Scan:
        return replace(self, start=prefix)

    def match(self, regex: str) -> Scan:
        """Unanchored, on the key without the prefix."""
        return replace(self, pattern=regex)

    def where(self, condition: Column) -> Scan:
        return replace(self, conditions=(*self.conditions, condition))

    def skip(self, n: int) -> Scan:
        return replace(self, offset=max(0, n))

    def take(self, n: int) -> Scan:
        """At most n rows; 0 or less: all."""
        return replace(self, limit=n if n > 0 else None)

    def ascending(self) -> Scan:
        return replace(self, reverse=False)

    def descending(self) -> Scan:
        return replace(self, reverse=True)

    def include_expired(self) -> Scan:
        return replace(self, expired=True)

    def matching(self) -> DataFrame:
        """All matching rows, without order, offset and limit."""
        key, df = F.col("key"), self.state
        low, high = (self.high, self.low) if self.reverse else (self.low, self.high)
        if low is not None:
            df = df.where(key >= literal(low))
        if high is not None:
            df = df.where(key <= literal(high))
        if self.start is not None:
            df = df.where(key >= literal(self.start))
            above = successor(self.start)
            df = df.where(key < literal(above)) if above is not None else df
            df = df.where(key.startswith(literal(self.start)))
        if self.pattern:
            skipped = len(self.start) if self.start is not None else 0
            df = df.where(_text(self.state).substr(F.lit(skipped + 1), F.lit(2**31 - 1)).rlike(self.pattern))
        if self.now_ms is not None and not self.expired:
            df = df.where(is_live(self.now_ms))
        for c in self.conditions:
            df = df.where(c)
        return df

    def frame(self, *columns: str) -> DataFrame:
        df = self.matching().orderBy(F.col("key").desc() if self.reverse else F.col("key"))
        df = df.offset(self.offset) if self.offset else df
        df = df.limit(self.limit) if self.limit is not None else df
        return df.select(*columns) if columns else df

    def collect(self, *columns: str) -> list:
        return self.frame(*columns).collect()

    def first(self):
        return self.frame().first()

    def count(self) -> int:
        """Matching rows, whatever the offset and limit."""
        return self.matching().count()

    def for_each(self, fn) -> None:
        """fn(row) in order until it returns False."""
        for row in self.frame().toLocalIterator():
            if fn(row) is False:
                return


def _of(state: DataFrame, bucket_id: int) -> DataFrame:
    return state.where(F.col("bucket_id") == bucket_id)


def _asked(state: DataFrame, keys: list) -> DataFrame:
    """pos, key of the keys that a call names."""
    import pyarrow as pa

    kind = pa.binary() if dict(state.dtypes)["key"] == "binary" else None
    table = pa.table({"pos": pa.array(range(len(keys)), pa.int32()), "key": pa.array([bytes(k) if kind else k for k in keys], kind)})
    return state.sparkSession.createDataFrame(table).select("pos", F.col("key").cast(state.schema["key"].dataType).alias("key"))


def get(state: DataFrame, bucket_id: int, key) -> DataFrame:
    return _of(state, bucket_id).where(F.col("key") == literal(key)).select("key", "value")


def mget(state: DataFrame, bucket_id: int, keys: list) -> DataFrame:
    """pos, key, value for each key asked for, in that order and with repeats; value is null if missing.

    keys is an argument of the call, so the request is broadcast, and only its keys are read."""
    held = _of(state, bucket_id).where(F.col("key").isin(*[literal(k) for k in {bytes(k) if isinstance(k, bytearray) else k: k for k in keys}])).select("key", "value")
    return F.broadcast(_asked(state, keys)).join(held, "key", "left").select("pos", "key", "value").orderBy("pos")


def has(state: DataFrame, bucket_id: int, keys: list) -> DataFrame:
    """key, present; reads no values."""
    wanted = _asked(state, [*dict.fromkeys(keys)]).select("key")
    held = _of(state, bucket_id).select("key").join(F.broadcast(wanted), "key", "left_semi").distinct().withColumn("present", F.lit(True))
    return F.broadcast(wanted).join(held, "key", "left").select("key", F.coalesce("present", F.lit(False)).alias("present"))


def key_bounds(state: DataFrame) -> DataFrame:
    """bucket_id, min_key, max_key of each bucket that has keys."""
    return state.groupBy("bucket_id").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def get_all(state: DataFrame, bucket_id: int) -> DataFrame:
    return _of(state, bucket_id).orderBy("key").select("key", "value")


def keys(state: DataFrame, bucket_id: int) -> DataFrame:
    return _of(state, bucket_id).orderBy("key").select("key")


def values(state: DataFrame, bucket_id: int) -> DataFrame:
    return _of(state, bucket_id).orderBy("key").select("value")


def range_scan(state: DataFrame, bucket_id: int, start, end) -> DataFrame:
    """Closed interval, key order."""
    return Scan(state).bucket(bucket_id).from_key(start).to_key(end).frame("key", "value")


def prefix_scan(state: DataFrame, bucket_id: int, prefix, offset: int = 0, limit: int = 0) -> DataFrame:
    return Scan(state).bucket(bucket_id).prefix(prefix).skip(offset).take(limit).frame("key", "value")


def prefix_search(state: DataFrame, bucket_id: int, prefix, regex: str, offset: int = 0, limit: int = 0) -> DataFrame:
    return Scan(state).bucket(bucket_id).prefix(prefix).match(regex).skip(offset).take(limit).frame("key", "value")


def iterate(state: DataFrame, bucket_id: int, seek=None, reverse: bool = False) -> DataFrame:
    """Rows of a bucket from the cursor on. A seek goes to the least key not below it, in either direction; a
    reverse iteration then walks down from there."""
    rows = _of(state, bucket_id)
    if seek is None:
        return Scan(rows, reverse=reverse).frame("key", "value")
    above = rows.where(F.col("key") >= literal(seek))
    if not reverse:
        return above.orderBy("key").select("key", "value")
    landed = above.agg(F.min("key")).first()[0]  # one key, asked for first: then the walk is a range condition
    below = rows.where(F.col("key") <= literal(landed)) if landed is not None else rows.where(F.lit(False))
    return below.orderBy(F.col("key").desc()).select("key", "value")


def iterate_numbered(state: DataFrame, bucket_id: int, seek=None, reverse: bool = False) -> DataFrame:
    """The rows of iterate with pos, their place in it from 0: counted in each sorted part, no task holds all rows."""
    rows = materialize(iterate(state, bucket_id, seek, reverse).withColumn("_id", F.monotonically_increasing_id()), "iteration")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each part
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return rows.join(F.broadcast(starts), part == F.col("_part")).select("key", "value", (F.col("_start") + place).alias("pos"))


def pop(state: DataFrame, largest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the row of each bucket with its least or largest key, the state without those)."""
    ends = state.groupBy("bucket_id").agg((F.max if largest else F.min)("key").alias("key"))
    return state.join(ends, ["bucket_id", "key"], "left_semi"), state.join(ends, ["bucket_id", "key"], "left_anti")


NAME = ["bucket_id", "key"]


def put_if_exists(state: DataFrame, puts: DataFrame) -> DataFrame:
    """The state after puts(bucket_id, key, value), one a key, of which those of missing keys do nothing."""
    new = puts.select(*NAME, F.col("value").alias("_new"), F.lit(True).alias("_put"))
    return state.join(new, NAME, "left").withColumn("value", F.when(F.col("_put"), F.col("_new")).otherwise(F.col("value"))).select(*state.columns)


def get_set(state: DataFrame, puts: DataFrame) -> DataFrame:
    """bucket_id, key, old, value for each of puts(bucket_id, key, value) whose key exists."""
    return state.select(*NAME, F.col("value").alias("old")).join(puts.select(*NAME, "value"), NAME)


def delete(state: DataFrame, gone: DataFrame) -> DataFrame:
    return state.join(gone.select(*NAME), NAME, "left_anti")


def append(state: DataFrame, more: DataFrame) -> DataFrame:
    """bucket_id, key, value after appending more(bucket_id, key, ord, value) in order of ord; a missing key begins empty."""
    tails = more.groupBy(*NAME).agg(F.expr("listagg(value, '') WITHIN GROUP (ORDER BY ord)").alias("_tail"))
    joined = state.select(*NAME, "value").join(tails, NAME, "full")
    return joined.select(*NAME, binary.append(F.col("value"), F.coalesce("_tail", F.lit(""))).alias("value"))


def incr_by(state: DataFrame, amounts: DataFrame) -> DataFrame:
    """bucket_id, key, value after adding amounts(bucket_id, key, n) to decimal texts of any length; null where a text is
    no integer. Texts of up to 37 digits are added in the JVM, only longer ones in Python."""
    total = amounts.groupBy(*NAME).agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("_n"))
    rows = state.select(*NAME, "value").join(total, NAME, "left").withColumn("_n", F.coalesce("_n", F.lit(0).cast("decimal(38,0)")))
    short = (F.length("value") <= 37) & (F.abs("_n") < F.lit("1" + "0" * 37).cast("decimal(38,0)"))
    few = rows.where(short).select(*NAME, binary.add_text(F.col("value"), F.col("_n")).alias("value"))
    return few.union(rows.where(~short).select(*NAME, binary.add_long_text(F.col("value"), F.col("_n").cast("string")).alias("value")))


def persist(state: DataFrame, keys: DataFrame) -> DataFrame:
    """The state with the time to live taken from the keys(bucket_id, key)."""
    kept = keys.select(*NAME).distinct().withColumn("_kept", F.lit(True))
    return state.join(kept, NAME, "left").withColumn("ttl_s", F.when(F.col("_kept"), F.lit(0)).otherwise(F.col("ttl_s")).cast("long")).select(*state.columns)


class Cursor:
    """A position in a state's key order, moved like an iterator.

    Rows are fetched as they are passed; seek() goes to the least key not below the one asked for,
    in either direction, and a reverse cursor walks down from there.
    """

    def __init__(self, state: DataFrame, bucket_id: int, reverse: bool = False):
        self._state, self._bucket, self._reverse = state, bucket_id, reverse
        self._rows, self._at = None, None

    def _open(self, rows) -> bool:
        self._rows = rows.toLocalIterator()
        return self.next()

    def rewind(self) -> bool:
        return self._open(iterate(self._state, self._bucket, None, self._reverse))

    def seek(self, key) -> bool:
        return self._open(iterate(self._state, self._bucket, key, self._reverse))

    def next(self) -> bool:
        if self._rows is None:
            return self.rewind()
        self._at = next(self._rows, None)
        return self._at is not None

    def valid(self) -> bool:
        return self._at is not None

    def key(self):
        return self._at["key"]

    def value(self):
        return self._at["value"]

    def item(self):
        return self._at

    def release(self) -> None:
        self._rows = self._at = None
