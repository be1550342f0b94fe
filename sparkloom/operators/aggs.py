"""Aggregates that Spark lacks, as compositions of those it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def arg_min_n(df: DataFrame, keys: list[str], value: str, by: str, n: int, name: str, largest: bool = False) -> DataFrame:
    """For each key the values of the n smallest (or largest) `by`, in order, ties by value; null `by` do not count. Groups are cut to n rows before they are gathered."""
    order = [F.desc(by), F.desc(value)] if largest else [F.asc(by), F.asc(value)]
    few = df.where(F.col(by).isNotNull()).withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n)
    few = few.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__r", F.col(value).alias("v")))).alias("__a"))
    return few.select(*keys, F.transform("__a", lambda x: x["v"]).alias(name))


def list_all(value: str, *by: str) -> Column:
    """All values, nulls too, ordered by the keys and then the value."""
    return F.transform(F.sort_array(F.collect_list(F.struct(*(F.col(b).alias(f"k{i}") for i, b in enumerate(by)), F.col(value).alias("v")))), lambda x: x["v"])


def first_by(value: str, key: str) -> Column:
    return F.min_by(value, key)


def last_by(value: str, key: str) -> Column:
    return F.max_by(value, key)


def exact_sum(value: Column, scale: int = 6) -> Column:
    """A sum that does not depend on the order of rows: exact in decimals."""
    return F.sum(value.cast(f"decimal(38,{scale})"))


def buckets(value: str, low: float, high: float, n: int) -> Column:
    """Number of the equal bucket, from 1; 0 below and n + 1 above."""
    return F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(n))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """One row with a map from value to count."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n")))).alias("histogram"))


def summarize(df: DataFrame, accuracy: int = 10000) -> DataFrame:
    """One row for each column: type, min, max, distinct (approximate), mean, spread, quartiles (approximate), count and share of nulls. One pass."""
    out = []
    for c, t in df.dtypes:
        number = t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")
        x = F.col(c).cast("double") if number else F.lit(None).cast("double")
        q = F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy)
        plain = not t.startswith(("array", "map", "struct", "binary", "variant"))
        edge = lambda f, c=c, plain=plain: f(F.col(c)).cast("string") if plain else F.max(F.lit(None).cast("string"))
        out.append(F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("column_type"), edge(F.min).alias("min"), edge(F.max).alias("max"), (F.approx_count_distinct(c) if plain else F.count(c)).alias("approx_unique"), F.avg(x).alias("avg"), F.stddev(x).alias("std"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.count("*").alias("count"), (F.count_if(F.col(c).isNull()) / F.count("*") * 100).alias("null_percentage")))
    return df.agg(F.array(*out).alias("a")).select(F.inline("a"))


def enum_columns(df: DataFrame, most: int = 20, ratio: float = 0.05) -> list[str]:
    """String columns that look like an enumeration: few values, and few for the number of rows."""
    texts = [c for c, t in df.dtypes if t == "string"]
    r = df.agg(F.count("*").alias("n"), *(F.approx_count_distinct(c).alias(c) for c in texts)).first()
    return [c for c in texts if r["n"] and r[c] <= most and r[c] / r["n"] <= ratio]


def describe(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, data_type) of the tables."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(t, c, k) for t, df in tables.items() for c, k in df.dtypes], "table_name string, column_name string, data_type string")
