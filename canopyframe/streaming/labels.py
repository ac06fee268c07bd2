"""Structured Streaming over the label event log.

Events later than the watermark are dropped from windows and sessions (a rule of this library: a log
that is read whole has no late rows). State is kept per chip, window or session, and the checkpoint
location must be a shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT_SCHEMA = "arrival bigint, ts timestamp, raster string, row_off int, col_off int, label string, source string, annotator string, model_prob double"
KEY = ["raster", "row_off", "col_off"]


def ingest(spark: SparkSession, folder: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of label events appended to a folder as Parquet."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def latest_state(events: DataFrame) -> DataFrame:
    """Latest event of each chip; run in update or complete mode."""
    return events.groupBy(*KEY).agg(F.max_by(F.struct("arrival", "label", "source"), "arrival").alias("v")).select(*KEY, "v.*")


class LatestLabel(StatefulProcessor):
    """Holds the newest event of a chip and passes it on when a batch brings a newer one.

    With ``keep_ms`` the chip's state goes when the watermark is so far beyond its newest event's time.
    """

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "arrival bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = pd.concat([r.nlargest(1, "arrival") for r in rows]).nlargest(1, "arrival")
        arrival = int(best["arrival"].iloc[0])
        held = self.newest.get()
        if held is None or held[0] < arrival:
            self.newest.update((arrival,))
            if self.keep_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(int(best["ms"].iloc[0]) + self.keep_ms)
            yield pd.DataFrame([[*key, arrival, best["label"].iloc[0], best["source"].iloc[0]]], columns=[*KEY, "arrival", "label", "source"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.newest.clear()
        return iter([])

    def close(self) -> None:
        pass


def keyed_latest_state(events: DataFrame, keep_ms: int | None = None, late: str = "2 hours") -> DataFrame:
    """As ``latest_state``, by state of each chip, with ``keep_ms`` for so long as the watermark has not passed it.

    A chip whose state has gone starts anew, so a sink must keep what it holds of a chip against older events
    (``bucket_sink`` with ``newest``). Run in update mode; state lies in RocksDB, whose provider is set here.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = "raster string, row_off int, col_off int, arrival bigint, label string, source string"
    rows = events.filter(F.col("arrival").isNotNull())
    if keep_ms is not None:
        rows = rows.withWatermark("ts", late)
    rows = rows.select(*KEY, "arrival", "label", "source", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy(*KEY).transformWithStateInPandas(LatestLabel(keep_ms), out, "Update", "None" if keep_ms is None else "EventTime")


def throughput(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Events per window (tumbling, or sliding) and source."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "source").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "source", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sittings of each annotator: events closer than ``gap``."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "annotator").agg(F.count("*").alias("n"))
    return g.select("annotator", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def review_sink(folder: str, low: float = 0.4, high: float = 0.6) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: appends a batch's uncertain automatic rows to a review table.

    A batch goes to a folder of its own number, so a batch that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.filter(F.col("model_prob").between(low, high) & ~F.col("source").isin("manual", "auto_reviewed"))
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, folder: str, number: int) -> dict[int, int]:
    """The batch that each bucket was last written by, as of batch ``number``; at most a row a bucket."""
    if number < 0:
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").parquet(f"{folder}/manifest/{number}").collect()}


def _paths(folder: str, versions: dict[int, int]) -> list[str]:
    return [f"{folder}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]


def bucket_sink(folder: str, keys: list[str], buckets: int = 16, newest: str | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function for update mode: a batch's rows replace those of their keys, which may be null.

    Rows lie in buckets by the hash of their keys, and a batch rewrites the buckets that it touches, under its own
    number; a manifest of each batch says which batch wrote which bucket last. So a batch that is run again
    replaces itself, and a reader sees whole batches. What neither this manifest nor the one before names is
    deleted. With ``newest``, of a key's rows the one greatest in that column stays, whichever came first.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.hash(*keys), F.lit(buckets))).persist()
        try:
            touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
            before = _versions(spark, folder, number - 1)
            old = {b: before[b] for b in touched if b in before}
            merged = rows
            if old:
                held = spark.read.schema(batch.schema).option("basePath", f"{folder}/data").parquet(*_paths(folder, old)).select(*batch.columns, F.col("bucket").cast("int").alias("bucket"))
                if newest:
                    merged = held.unionByName(rows)
                else:
                    changed = rows.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
                    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
                    merged = held.join(changed, same, "left_anti").unionByName(rows)
            if newest:
                first = Window.partitionBy("bucket", *keys).orderBy(F.desc(newest))
                merged = merged.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
            if touched:
                merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/version={number}")
            now = before | dict.fromkeys(touched, number)
            spark.createDataFrame(list(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/{number}")
        finally:
            rows.unpersist()
        fs, path = _fs(spark, folder)
        if number > 1 and fs.exists(path(f"{folder}/manifest/{number - 2}")):
            stale = {b: v for b, v in _versions(spark, folder, number - 2).items() if before.get(b) != v}
            for gone in [*_paths(folder, stale), f"{folder}/manifest/{number - 2}"]:
                fs.delete(path(gone), True)

    return write


def read_buckets(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The table that ``bucket_sink`` holds as of its last batch."""
    fs, path = _fs(spark, folder)
    made = [int(s.getPath().getName()) for s in fs.listStatus(path(f"{folder}/manifest"))] if fs.exists(path(f"{folder}/manifest")) else []
    versions = _versions(spark, folder, max(made)) if made else {}
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{folder}/data").parquet(*_paths(folder, versions)).select(*schema.names)


def drain(stream: DataFrame, folder: str, mode: str = "append", keys: list[str] | None = None, newest: str | None = None) -> DataFrame:
    """Runs a stream over what is there now and gives back the rows of its result so far.

    Append results are Parquet by the file sink; update and complete results go through foreachBatch:
    complete ones replace what was there, update ones are merged by ``keys``, which they must name.
    """
    spark = stream.sparkSession
    out = f"{folder}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", out).start()
    elif mode == "update":
        if not keys:
            raise ValueError("update mode needs the keys that rows are merged by")
        q = writer.foreachBatch(bucket_sink(out, keys, newest=newest)).start()
    else:
        q = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(out)
    return read_buckets(spark, out, stream.schema)
