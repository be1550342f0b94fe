"""Shared pieces: durable intermediate tables, names that do not clash, worker memory and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/loom-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = table_path(spark, label)
    df.write.parquet(path)
    spark._jvm.java.lang.System.gc()  # Spark deletes shuffles that no plan refers to any longer when the driver collects garbage
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to workers in Arrow batches of at most so many rows from now on: a batch is held by the JVM and by the worker at once."""
    if int(spark.conf.get(BATCH)) > rows or int(spark.conf.get(BATCH)) <= 0:
        spark.conf.set(BATCH, str(rows))


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables of which all that is needed has been written elsewhere."""
    for t in tables:
        spark, path = t.sparkSession, t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._loom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, which an operator's results replace; letter case does not count."""
    taken = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in taken))


class Remembered(dict):
    """Values found when first asked for. Once half of `most` are held they become the older half, and the old one goes; keys longer than `longest` are not kept."""

    def __init__(self, find, most: int, longest: int = 200):
        super().__init__()
        self.find, self.half, self.longest, self.old = find, most // 2, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.find(key)
        if len(key) <= self.longest:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


_held: dict = {}


def held(key, make):
    """An object that a worker keeps from task to task; only the one asked for last is kept."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def fresh() -> None:
    """At the beginning of a task that keeps nothing between tasks: what others left in this worker goes."""
    if _held:
        _held.clear()
        release()


def release() -> None:
    """Give the worker's free memory back at a task's end: a worker lives on, and its peak would add to the JVM's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges(u long, v long) as (node, root), root the smallest node reachable.

    Large-star and small-star steps in turn until the edge set no longer
    changes; every step is a partial aggregate and an equi-join that AQE can
    split, and each round is a written table that takes the last one's place.
    Nodes without an edge are not listed. Self-loops and nulls are dropped.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, mark = materialise(edges, "edges"), None
    for _ in range(rounds):
        sym = both(edges)
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        last, edges = edges, materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        discard(last)
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
