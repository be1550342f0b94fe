"""Session factory and table loading."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(app: str = "sparkloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive plans and skew handling; other settings by keyword, dots as double underscores."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str, args: dict | None = None) -> DataFrame:
    """Run SQL over the tables it names, each a temporary view of its Parquet files."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            load(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text, args=args)


def scratch(spark: SparkSession, label: str = "t") -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "t") -> DataFrame:
    """df written once and read back: what follows sees the same rows in the same partitions' columns however often it is evaluated."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
