"""As-of, positional and interval joins without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def asof(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, how: str = "inner", prefix: str = "r_") -> DataFrame:
    """Each left row with the latest right row of the same keys at or before its time.

    One shuffle and one sort: both sides are laid out by key and time, and the
    last right row so far is carried on. Null times never match. Right rows
    that tie on key and time: the largest remaining values win.
    """
    ls = F.struct(*left.columns)
    rs = F.struct(*(F.col(c).alias(prefix + c) for c in right.columns))
    void = lambda s, df, p: F.lit(None).cast(df.select(s.alias("x")).schema["x"].dataType)
    keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(on)]
    a = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__s"), ls.alias("__l"), void(rs, right, prefix).alias("__r"))
    b = right.where(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__s"), void(ls, left, "").alias("__l"), rs.alias("__r"))
    w = Window.partitionBy(*(f"__k{i}" for i in range(len(on)))).orderBy(F.col("__t").asc_nulls_first(), "__s", "__r").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where("__s = 1")
    bad = F.col("__t").isNull()
    for i in range(len(on)):
        bad = bad | F.col(f"__k{i}").isNull()
    out = out.withColumn("__m", F.when(~bad, F.col("__m")))
    if how == "inner":
        out = out.where("__m IS NOT NULL")
    return out.select("__l.*", *(F.col("__m")[prefix + c].alias(prefix + c) for c in right.columns))


def positional(left: DataFrame, right: DataFrame, left_by: list[Column], right_by: list[Column], key: str = "pos") -> DataFrame:
    """Rows side by side in the given orders; the shorter side is filled with nulls. Rows that tie on the order come in any order."""
    return numbered(left, left_by, key).join(numbered(right, right_by, key), key, "full")


def numbered(df: DataFrame, by: list[Column], key: str = "pos") -> DataFrame:
    """df with each row's place in the order, from 1, without a task that holds all rows.

    Rows are dealt by range of the order, ties by a row number, and written with
    the number of their range, so that counts and places refer to the same
    ranges; a range's places follow the counts of the ranges before it.
    """
    ranged = df.withColumn("__i", F.monotonically_increasing_id())
    ranged = stored(ranged.repartitionByRange(*by, "__i").withColumn("__p", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    base = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))  # one row for each range
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*by, "__i"))
    return ranged.withColumn("__r", place).join(F.broadcast(base), "__p").withColumn(key, F.col("__b") + F.col("__r")).drop("__p", "__i", "__r", "__b")


def count_smaller(df: DataFrame, value: str, name: str = "n") -> DataFrame:
    """df with the number of rows whose value is smaller; null values get null. Places in the order take the place of comparing all pairs."""
    known = numbered(df.where(F.col(value).isNotNull()).select(value), [F.asc(value)], "__pos")
    first = known.groupBy(value).agg((F.min("__pos") - 1).alias(name))
    return df.join(first, value, "left").select(*df.columns, name)


def within(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points with every range [low, high) that holds them: both are cut into cells of `width` and joined on the cell."""
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    cut = ranges.where(F.col(low) < F.col(high)).withColumn("__c", F.explode(F.sequence(cell(low), cell(high))))
    return points.withColumn("__c", cell(point)).join(cut, "__c").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__c")
