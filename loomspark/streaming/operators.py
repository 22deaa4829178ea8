"""Streaming operators: stateless pipelines, de-duplication, windows, keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomspark.catalog import shared_dir


def read_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, so many new files a batch (the back-pressure)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def replay(stream: DataFrame, name: str = "stream", mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there (``availableNow``) into the shared folder, and reads it back.

    Exactly once: the sink's log and the checkpoint make a restart write nothing twice.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/loomspark/{name}-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    else:
        # every batch of a complete or update result replaces or upserts its keys by batch number
        def write(df: DataFrame, batch: int) -> None:
            df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/out/_b={batch}")

        q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    return spark.read.parquet(f"{base}/out").drop("_b")


def last_of(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Of the updates that ``replay(mode='update')`` wrote, the last row of every key."""
    rest = [c for c in updates.columns if c not in keys and c != "_batch"]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def drop_seen(stream: DataFrame, keys: list[str], time: str | None = None, late: str | None = None) -> DataFrame:
    """First rows of each key. With ``time`` and ``late`` the state is bounded: keys are forgotten after that delay."""
    if time and late:
        return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def rolling_counts(stream: DataFrame, time: str, keys: list[str], width: str = "30 seconds", slide: str = "10 seconds", late: str = "0 seconds") -> DataFrame:
    """Counts and rates over sliding windows."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return w.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def failures(stream: DataFrame, keys: list[str], url: str, time: str) -> DataFrame:
    """Failures by group: attempts, approximate distinct urls, first and last time (update mode)."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempts"), F.approx_count_distinct(url).alias("urls"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))


class _Throttle(StatefulProcessor):
    """Per key: the delay grows by half on an error, and shrinks by a tenth after a good answer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("delay", "delay double, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        delay, n = self.state.get() if self.state.exists() else (1.0, 0)
        for pdf in rows:
            for bad in pdf.sort_values("seq")["error"]:
                delay = min(60.0, delay * 1.5) if bad else max(0.1, delay * 0.9)
                n += 1
        self.state.update((float(delay), int(n)))
        yield pd.DataFrame({"key": [key[0]], "delay": [round(float(delay), 6)], "n": [int(n)]})

    def close(self) -> None:
        pass


def throttle(stream: DataFrame) -> DataFrame:
    """``(key, delay, n)`` of ``stream (key, seq, error)``: additive state per key, in update mode.

    Within a batch the rows of a key are taken by ``seq``; over batches in order of arrival.
    """
    return stream.groupBy("key").transformWithStateInPandas(_Throttle(), "key string, delay double, n bigint", "Update", "None")


def throttle_batch(rows: DataFrame) -> DataFrame:
    """The same over a whole table: per key one pass over its rows in order, in bounded memory.

    The delay is a fold, so rows are sorted within partitions and folded as they come.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, delay, n, out = None, 1.0, 0, []
        for pdf in batches:
            for k, bad in zip(pdf["key"], pdf["error"]):
                if k != key:
                    if n:
                        out.append((key, round(delay, 6), n))
                    key, delay, n = k, 1.0, 0
                delay = min(60.0, delay * 1.5) if bad else max(0.1, delay * 0.9)
                n += 1
            if out:
                yield pd.DataFrame(out, columns=["key", "delay", "n"])
                out = []
        if n:
            yield pd.DataFrame([(key, round(delay, 6), n)], columns=["key", "delay", "n"])

    return rows.filter("key is not null").repartition("key").sortWithinPartitions("key", "seq").mapInPandas(run, "key string, delay double, n bigint")


def queue_order(requests: DataFrame, limit: int | None = None) -> DataFrame:
    """Requests with their place in the queue of their crawl: higher priority first, then arrival."""
    from pyspark.sql import Window

    w = Window.partitionBy("crawl").orderBy(F.col("priority").desc(), "seq")
    out = requests.withColumn("place", F.row_number().over(w))
    return out if limit is None else out.filter(F.col("place") <= limit)


def rolling_count(events: DataFrame, by: list[str], at: str, width: int) -> DataFrame:
    """``events`` with ``n``: the events of the same group within ``width`` before each one, itself included.

    Time is cut into slots of ``width``; a slot sees its own events and those of the slot before, so
    a group's events are spread over its slots and none is in one task. Equal times count alike;
    events without a time have none.
    """
    slot = F.floor(F.col(at) / width)
    rows = events.withColumn("_own", slot).withColumn("_slot", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by, "_slot").orderBy(at).rangeBetween(-width, 0))
    return rows.withColumn("n", n).filter(F.col("_slot").eqNullSafe(F.col("_own")) & F.col(at).isNotNull()).drop("_own", "_slot")
