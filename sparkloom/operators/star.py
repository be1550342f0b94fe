"""Star modifiers, first-per-key, window filters and exact samples."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclude(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def replace(df: DataFrame, **exprs: Column) -> DataFrame:
    """Replace columns in place; the order stays."""
    unknown = exprs.keys() - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return df.select(*(exprs[c].alias(c) if c in exprs else F.col(c) for c in df.columns))


def columns(df: DataFrame, pick: str | Callable[[str], bool], apply: Callable[[Column], Column] | None = None) -> list[Column]:
    """Columns whose name matches a regular expression or a predicate, each through `apply`."""
    test = pick if callable(pick) else re.compile(pick).search
    return [(apply(F.col(c)) if apply else F.col(c)).alias(c) for c in df.columns if test(c)]


def order(*keys: Column | str, descending: bool = False) -> list[Column]:
    """Sort keys with nulls last in either direction."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return [c.desc_nulls_last() if descending else c.asc_nulls_last() for c in cols]


def qualify(df: DataFrame, window_value: Column, keep: Callable[[Column], Column]) -> DataFrame:
    """Filter on a window value without leaving it in the result."""
    return df.withColumn("__q", window_value).where(keep(F.col("__q"))).drop("__q")


def distinct_on(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    return qualify(df, F.row_number().over(Window.partitionBy(*keys).orderBy(*by)), lambda q: q == 1)


def top_n(df: DataFrame, keys: list[str], by: list[Column], n: int) -> DataFrame:
    return qualify(df, F.row_number().over(Window.partitionBy(*keys).orderBy(*by)), lambda q: q <= n)


def union_by_name(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (or all, if fewer) at random."""
    return df.orderBy(F.rand(seed)).limit(n)


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    """Columns to rows; null values are dropped."""
    return df.unpivot(ids, values, name, value).where(F.col(value).isNotNull())


def not_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """NOT IN with SQL's nulls: a null in the other column lets no row through, a null in this one only if the other is empty. An anti join and one row of counts, nothing broadcast but that row."""
    seen = other.agg(F.count("*").alias("__all"), F.count_if(F.col(other_column).isNull()).alias("__nulls"))
    left = df.join(other.select(F.col(other_column).alias("__k")), F.col(column) == F.col("__k"), "left_anti")
    return left.join(F.broadcast(seen)).where((F.col("__all") == 0) | (F.col("__nulls") == 0) & F.col(column).isNotNull()).drop("__all", "__nulls")


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    page = df if after is None else df.where(F.col(key) > F.lit(after))
    return page.orderBy(key).limit(size)


def interval(df: DataFrame, key: str, start=None, end=None) -> DataFrame:
    """Rows with start <= key < end."""
    if start is not None:
        df = df.where(F.col(key) >= F.lit(start))
    return df if end is None else df.where(F.col(key) < F.lit(end))


def page(df: DataFrame, sort: str, descending: bool = True, tie: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a listing: by a field in either direction, ties by another."""
    by = order(sort, descending=descending) + ([F.col(tie).asc()] if tie else [])
    return df.orderBy(*by).offset(offset).limit(limit)
