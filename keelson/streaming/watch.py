"""Following changes.

The feed streams the manifests of published commits, not the data folders: a commit that is half
written or never published is not seen, and each is delivered once it is whole. Delivery is
at-least-once across restarts, with Spark's checkpoint remembering what was delivered.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CallbackTimeout
from ..schema import OPLOG, Flag
from ..sources.oplog import OpLog

MANIFEST = "commit_seq long, path string, rows long, kind string"


def manifests(spark: SparkSession, root: str) -> DataFrame:
    return spark.readStream.schema(MANIFEST).json(f"{root.rstrip('/')}/_commits")


def messages(log: OpLog, batch: DataFrame) -> DataFrame:
    """Rows of the commits in a batch of manifests, in log order."""
    # bounded by the commits published since the last batch
    paths = [r["path"] for r in batch.where("kind = 'ops' and rows > 0").select("path").collect()]
    if not paths:
        return log.spark.createDataFrame([], OPLOG)
    return log.spark.read.schema(OPLOG).parquet(*[f"{log.root}/{p}" for p in paths]).orderBy("commit_seq", "op_seq")


class Watcher:
    """A running feed of one bucket's key (or of the whole bucket, without a key)."""

    def __init__(self, log: OpLog, bucket_ids: dict[int, str], key: bytes | None, callback, checkpoint: str, batch: int = 128, timeout: float | None = None):
        self._log, self._ids, self._key, self._callback, self._checkpoint, self._batch = log, bucket_ids, key, callback, checkpoint, batch
        self._query, self.deleted, self.error, self._timeout = None, threading.Event(), None, timeout
        self._ready = threading.Event()

    def _call(self, rows: list) -> None:
        """The callback, which must be done in time: else the feed ends with CallbackTimeout, and this batch comes again."""
        if self._timeout is None:
            self._callback(rows)
            return
        failed: list[BaseException] = []

        def run():
            try:
                self._callback(rows)
            except BaseException as error:
                failed.append(error)

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        thread.join(self._timeout)
        if thread.is_alive():
            failed.append(CallbackTimeout(f"{self._timeout} s"))
        if failed:
            self.error = failed[0]
            raise failed[0]

    def _deliver(self, batch: DataFrame, _epoch: int) -> None:
        self._ready.set()
        if self.deleted.is_set():
            return
        rows = messages(self._log, batch).where(F.col("bucket_id").isin([*self._ids]))
        own = F.lit(True) if self._key is None else F.col("key") == F.lit(bytearray(self._key))
        rows = rows.where((own & ~F.col("flag").isin(int(Flag.BUCKET_CREATE), int(Flag.KEY))) | (F.col("flag") == int(Flag.BUCKET_DELETE)))
        held = []
        for r in rows.toLocalIterator():
            if r["flag"] == Flag.BUCKET_DELETE:
                self._ids.pop(r["bucket_id"], None)
                if self._ids:
                    continue  # the name lives on in another structure
                held.append(r)
                self.deleted.set()
                break
            held.append(r)
            if len(held) >= self._batch:
                self._call(held)
                held = []
        if held:
            self._call(held)

    def start(self, once: bool = False) -> Watcher:
        writer = manifests(self._log.spark, self._log.root).writeStream.foreachBatch(self._deliver).option("checkpointLocation", self._checkpoint)
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="100 milliseconds")
        self._query = writer.start()
        return self

    def wait_ready(self, seconds: float | None = None) -> bool:
        """Until the feed has read the commits that were there; false when the time is over first."""
        return self._ready.wait(seconds)

    def wait(self, seconds: float | None = None) -> None:
        """Until the feed ends: stopped, failed, or the bucket deleted."""
        waited = 0.0
        while self._query.isActive and not self.deleted.is_set() and (seconds is None or waited < seconds):
            self._query.awaitTermination(0.1)
            waited += 0.1
        if self.deleted.is_set():
            self.stop()

    def stop(self) -> None:
        if self._query is not None:
            self._query.stop()


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A supplied table as a file stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def kv_updates(log: DataFrame) -> DataFrame:
    """Streaming last-writer-wins state of a log stream (commit_seq, op_seq, bucket_id, key, ...): the last row of each key so far."""
    rest = [c for c in log.columns if c not in ("bucket_id", "key")]
    last = log.groupBy("bucket_id", "key").agg(F.max_by(F.struct(*rest), F.struct("commit_seq", "op_seq")).alias("l"))
    return last.select("bucket_id", "key", "l.*")


def newest(updates: DataFrame, by: list[str]) -> DataFrame:
    """The last update of each key: of a table that a stream in update mode wrote."""
    rest = [c for c in updates.columns if c not in by]
    return updates.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("commit_seq", "op_seq")).alias("l")).select(*by, "l.*")


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process all that is there into a table in the shared folder and read it back."""
    spark, schema = stream.sparkSession, stream.schema

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/out/b={epoch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(schema.add("_epoch", T.IntegerType())).option("recursiveFileLookup", "true").parquet(f"{path}/out")
    return out
