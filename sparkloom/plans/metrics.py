"""Ready-made metrics over orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import numbered
from ..session import stored


def daily(orders: DataFrame, day: str = "o_orderdate", amount: str = "o_totalprice", user: str = "o_custkey") -> DataFrame:
    """Orders, revenue and buyers of each day."""
    return orders.groupBy(F.to_date(day).alias("order_date")).agg(F.count("*").alias("n"), F.sum(F.col(amount).cast("decimal(18,2)")).cast("double").alias("gmv"), F.count_distinct(user).alias("dau"))


def tiled(df: DataFrame, by: list, tiles: int, name: str) -> DataFrame:
    """df with its tile, from 1, of as many as equal ones in the given order; larger tiles come first."""
    rows = stored(numbered(df, by, "__pos"), "tiles")
    n = rows.agg(F.count("*").alias("__n"))
    rows = rows.join(F.broadcast(n))  # one row
    size, extra, r = F.expr(f"__n div {tiles}"), F.expr(f"__n % {tiles}"), F.col("__pos") - 1
    big = extra * (size + 1)
    tile = F.when(r < big, F.floor(r / (size + 1))).otherwise(extra + F.floor((r - big) / F.greatest(size, F.lit(1))))
    return rows.withColumn(name, (tile + 1).cast("int")).drop("__pos", "__n")


def rfm(orders: DataFrame, user: str = "o_custkey", day: str = "o_orderdate", amount: str = "o_totalprice", tiles: int = 5) -> DataFrame:
    """Recency, frequency and money scores of each buyer, 1 to `tiles`, and a segment; ties by user. No task holds all buyers, nor all that have one value."""
    per = orders.groupBy(F.col(user).alias("user_id")).agg(F.max(day).alias("last"), F.count("*").alias("frequency"), F.sum(F.col(amount).cast("decimal(18,2)")).alias("monetary"))
    for c, name in (("last", "r_score"), ("frequency", "f_score"), ("monetary", "m_score")):
        per = tiled(per, [F.asc(c), F.asc("user_id")], tiles, name)
    return _segments(per, tiles)


def _segments(per: DataFrame, tiles: int) -> DataFrame:
    strong = lambda c: F.col(c) >= tiles - 1
    segment = F.when(strong("r_score") & strong("f_score") & strong("m_score"), "champions").when(strong("r_score") & strong("f_score"), "loyal").when(strong("r_score"), "recent").when(strong("m_score"), "big spenders").when((F.col("r_score") <= 2) & (F.col("f_score") <= 2), "lost").otherwise("regular")
    return per.select("user_id", "r_score", "f_score", "m_score", segment.alias("segment"))


def star(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> dict[str, DataFrame]:
    """A fact and its dimensions."""
    day = F.to_date("o_orderdate")
    return {
        "fact_orders": orders.select("o_orderkey", "o_custkey", day.alias("order_date"), "o_totalprice"),
        "dim_customer": customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").select("c_custkey", "c_name", "n_name", "c_mktsegment"),
        "dim_date": orders.select(day.alias("order_date")).distinct().select("order_date", F.year("order_date").alias("year"), F.month("order_date").alias("month"), F.weekofyear("order_date").alias("week"), (F.dayofweek("order_date") - 1).alias("weekday")),
    }
