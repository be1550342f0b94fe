"""Statements, plans and results: prepared queries, templates, chaining, timing, caching, errors, charts and reports."""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: SQL texts by name.
TEMPLATES = {
    "status_counts": "SELECT o_orderstatus, count(*) AS n FROM {orders} WHERE o_totalprice > :least GROUP BY o_orderstatus",
}


class Prepared:
    """A statement over frames by name, run with parameters."""

    def __init__(self, sql: str, **tables: DataFrame):
        self.sql, self.tables = sql, tables
        self.spark = next(iter(tables.values())).sparkSession

    def execute(self, args: dict) -> DataFrame:
        for n, df in self.tables.items():
            df.createOrReplaceTempView(n)
        return self.spark.sql(self.sql, args=args)

    def execute_many(self, rows: list[dict]) -> DataFrame:
        """The union of the results, as one plan."""
        out = self.execute(rows[0])
        for r in rows[1:]:
            out = out.unionByName(self.execute(r))
        return out


def template(spark: SparkSession, name: str, args: dict, **tables: DataFrame) -> DataFrame:
    return spark.sql(TEMPLATES[name], args=args, **tables)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """SET for a while, then what was set before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Relation:
    """Chained steps in SQL text."""

    def __init__(self, df: DataFrame):
        self.df = df

    def filter(self, condition: str) -> Relation:
        return Relation(self.df.where(condition))

    def project(self, columns: str) -> Relation:
        return Relation(self.df.sparkSession.sql(f"SELECT {columns} FROM {{t}}", t=self.df))

    def aggregate(self, columns: str, by: str = "") -> Relation:
        return Relation(self.df.sparkSession.sql(f"SELECT {columns} FROM {{t}}" + (f" GROUP BY {by}" if by else ""), t=self.df))

    def order(self, by: str) -> Relation:
        return Relation(self.df.sparkSession.sql(f"SELECT * FROM {{t}} ORDER BY {by}", t=self.df))

    def limit(self, n: int, offset: int = 0) -> Relation:
        return Relation(self.df.offset(offset).limit(n))

    def join(self, other: Relation, on: list[str], how: str = "inner") -> Relation:
        return Relation(self.df.join(other.df, on, how))


def register_batch(spark: SparkSession, name: str, f: Callable, returns: str) -> None:
    """A scalar function over batches of values: f takes a column of a batch and gives as many values."""
    import pandas as pd

    def batch(x):
        return pd.Series(f(x))

    batch.__annotations__ = {"x": pd.Series, "return": pd.Series}  # the kind of function is read from these
    spark.udf.register(name, F.pandas_udf(batch, returns))


def register_words(spark: SparkSession) -> None:
    """loom_words(text): a row for each word with its place, from 1."""

    @F.udtf(returnType="i int, w string")
    class Words:
        def eval(self, text: str):
            for i, w in enumerate((text or "").split(" ") if text is not None else ()):
                yield i + 1, w

    spark.udtf.register("loom_words", Words)


def geometric_mean(c: Column) -> Column:
    return F.exp(F.avg(F.ln(c)))


def explain(df: DataFrame) -> dict[str, str]:
    """The physical plan as text, and the optimised one as JSON."""
    q = df._jdf.queryExecution()
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return {"text": q.explainString(mode), "json": q.optimizedPlan().toJSON()}


def timed(spark: SparkSession, sql: str, prefix: int = 80) -> dict:
    """Rows, seconds and the text's beginning of a query that is run to its end; the rows are counted where they are."""
    began = time.perf_counter()
    n = spark.sql(sql).count()
    return {"rows": n, "seconds": time.perf_counter() - began, "sql": sql[:prefix]}


class ResultCache:
    """Rows of small results, by text and time bucket; the least recently used go first."""

    def __init__(self, spark: SparkSession, size: int = 128, seconds: float = 300, now: Callable[[], float] = time.time):
        self.spark, self.size, self.seconds, self.now = spark, size, seconds, now
        self.held: OrderedDict = OrderedDict()
        self.hits = self.misses = 0

    def rows(self, sql: str) -> list:
        key = (sql, int(self.now() // self.seconds))
        if key in self.held:
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key]
        self.misses += 1
        self.held[key] = self.spark.sql(sql).collect()
        while len(self.held) > self.size:
            self.held.popitem(last=False)
        return self.held[key]


def kind_of_error(run: Callable) -> str | None:
    """catalog, parser, binder, io, memory or runtime; None if it runs."""
    try:
        run()
    except ParseException:
        return "parser"
    except AnalysisException as e:
        code = e.getCondition() or ""
        if "PATH_NOT_FOUND" in code:
            return "io"
        return "catalog" if code.startswith(("TABLE_OR_VIEW", "SCHEMA_NOT_FOUND", "UNRESOLVED_ROUTINE")) else "binder"
    except PySparkException as e:
        text = str(e)
        return "memory" if "OutOfMemory" in text else "io" if "FileNotFound" in text else "runtime"
    except Exception as e:  # errors of the JVM that have no class of their own
        return "memory" if "OutOfMemory" in str(e) else "io" if "FileNotFound" in str(e) else "runtime"
    return None


def charts(orders: DataFrame, events: DataFrame, customer: DataFrame, part: DataFrame) -> DataFrame:
    """(chart, x, y, v): orders by day, transitions between a user's events, customers by segment, size against price."""
    row = lambda chart, x, y, v: [F.lit(chart).alias("chart"), x.alias("x"), y.alias("y"), v.cast("double").alias("v")]
    none = F.lit(None).cast("string")
    calendar = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("x")).agg(F.count("*").alias("v")).select(*row("calendar", F.col("x"), none, F.col("v")))
    step = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    flow = events.select(F.col("event_type").alias("a"), step.alias("b")).where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("v")).select(*row("flow", F.col("a"), F.col("b"), F.col("v")))
    share = customer.groupBy("c_mktsegment").agg(F.count("*").alias("v")).select(*row("share", F.col("c_mktsegment"), none, F.col("v")))
    tie = part.agg(F.round(F.corr("p_size", "p_retailprice"), 8).alias("v")).select(*row("correlation", F.lit("p_size"), F.lit("p_retailprice"), F.col("v")))
    return calendar.unionByName(flow).unionByName(share).unionByName(tie)


def report(df: DataFrame) -> dict[str, str]:
    """A small result as JSON lines, a Markdown table and aligned text."""
    names, rows = df.columns, [tuple(r) for r in df.collect()]
    lines = [" | ".join(names), " | ".join("---" for _ in names), *(" | ".join(map(str, r)) for r in rows)]
    wide = [max(len(str(x)) for x in col) for col in zip(names, *rows)]
    text = [" ".join(str(x).ljust(w) for x, w in zip(r, wide)).rstrip() for r in (names, *rows)]
    return {"json": "\n".join(json.dumps(dict(zip(names, r)), default=str) for r in rows), "markdown": "\n".join(f"| {x} |" for x in lines), "text": "\n".join(text)}
