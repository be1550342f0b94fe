"""Structured Streaming: file feeds, windows, de-duplication and change feeds."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dml, ingest
from ..session import scratch


def files(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", time: str = "ts", keys=("event_type",)) -> DataFrame:
    """Counts and sums by time window; works on streams and on tables."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return e.groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", time: str = "ts", key: str = "user_id") -> DataFrame:
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return e.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, key: str, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Each key once, as far back as the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def slot(source: str, dest: str, table: str) -> str:
    """Name of the checkpoint of one source, destination and table."""
    return f"{table}_{hashlib.sha256(f'{source}|{dest}|{table}'.encode()).hexdigest()[:12]}"


def follow(feed: DataFrame, table: dml.Table, key: list[str], checkpoint: str, op: str = "op", lsn: str = "lsn"):
    """Add a change feed to a table, batch by batch, until it is read up. A batch costs as much as it holds: its changes are
    appended with their LSN, and `current` gives each key's latest. A repeated batch, or one that comes late, changes nothing."""

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            table.append(ingest.logged(batch, op, lsn))

    q = feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def current(table: dml.Table, key: list[str]) -> DataFrame:
    """The rows that a followed table stands for."""
    return ingest.current(table.read(), key)


def compact(table: dml.Table, key: list[str]) -> int:
    """Keep each key's latest change only; deletions stay as marks, since older changes may still come."""
    return table.commit(dml.latest(table.read(), key, ingest.LSN))


def tumbling_stream(spark: SparkSession, batches: list[list[tuple]], size: str, late: str) -> DataFrame:
    """Counts by window of (event_type, ts) rows that come as a stream, one file for each batch; events older than the watermark are left out."""
    folder, checkpoint, out = scratch(spark, "in"), scratch(spark, "ck"), scratch(spark, "out")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_type string, ts string").withColumn("value", F.lit(1.0)).coalesce(1).write.mode("append").parquet(folder)
        feed = files(spark, folder, "event_type string, ts string, value double", per_trigger=1)
        counts = windowed(feed.withColumn("ts", F.to_timestamp("ts")), size, late=late)
        counts.writeStream.foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    return dml.latest(rows, ["start", "event_type"], "batch").drop("batch")
