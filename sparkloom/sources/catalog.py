"""The catalogue of data sources: a table of connections with create, list, show, search, count, update, status and delete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dml
from ..operators.joins import numbered

# The columns of the catalogue.
SCHEMA = "id bigint, source_code string, source_name string, db_type string, host string, port int, database_name string, username string, password string, charset string, environment string, status int, description string, owner string"
LISTED = ("id", "source_code", "source_name", "db_type", "host", "port", "database_name", "username", "charset", "environment", "status", "owner")
MASK = "******"


class Sources:
    """Data sources in a table; codes are unique, deletion is soft unless asked otherwise, secrets stay masked."""

    def __init__(self, table: dml.Table):
        self.table = table
        if table.version() is None:
            table.commit(table.spark.createDataFrame([], SCHEMA))

    def add(self, rows: DataFrame) -> DataFrame:
        """New sources; ids go on from the greatest. A code that exists is an error."""
        have = self.table.read()
        new = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in have.columns if c != "id"))
        if new.groupBy("source_code").count().where("count > 1").limit(1).count() or new.join(have, "source_code", "left_semi").limit(1).count():
            raise ValueError("a source code exists already")
        last = have.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
        new = numbered(new, [F.asc("source_code")], "id").join(F.broadcast(last)).withColumn("id", F.col("id") + F.col("__last"))  # one row
        new = new.withColumn("status", F.coalesce("status", F.lit(1))).withColumn("charset", F.coalesce("charset", F.lit("utf8mb4")))
        self.table.append(new.select(*have.columns))
        return self.list()

    def list(self, db_type: str | None = None, status: int | None = None, environment: str | None = None) -> DataFrame:
        """Sources in order of their id, without secrets; filters are joined by AND."""
        out = self.table.read()
        for c, v in (("db_type", db_type), ("status", status), ("environment", environment)):
            if v is not None:
                out = out.where(F.col(c) == F.lit(v))
        return out.select(*LISTED).orderBy("id")

    def show(self, code: str, reveal: bool = False) -> DataFrame:
        """One source with all its columns; its password is masked unless revealed."""
        out = self.table.read().where(F.col("source_code") == code)
        return out if reveal else out.withColumn("password", F.when(F.col("password").isNotNull(), MASK))

    def search(self, word: str) -> DataFrame:
        """Sources whose code, name, host, database or description holds the word, in any case."""
        hit = F.lit(False)
        for c in ("source_code", "source_name", "host", "database_name", "description"):
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(word.lower())), F.lit(False))
        return self.table.read().where(hit).select(*LISTED).orderBy("id")

    def count(self, by: Sequence[str] = ("db_type",)) -> DataFrame:
        return self.table.read().groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)

    def update(self, code: str, **values) -> None:
        df = self.table.read()
        unknown = values.keys() - set(df.columns) | values.keys() & {"id", "source_code"}
        if unknown:
            raise ValueError(f"cannot be changed: {sorted(unknown)}")
        sets = {c: F.lit(v).cast(df.schema[c].dataType) for c, v in values.items()}
        self.table.commit(dml.update(df, sets, F.col("source_code") == code))

    def status(self, code: str, status: int) -> None:
        self.update(code, status=status)

    def delete(self, code: str, hard: bool = False) -> None:
        """Soft: the status becomes 0. Hard: the row goes."""
        if hard:
            self.table.commit(dml.delete(self.table.read(), F.col("source_code") == code))
        else:
            self.status(code, 0)


def assets(tables: dict[str, DataFrame]) -> DataFrame:
    """An inventory: one row for each table with its columns, rows and the part of empty values. One pass over each table."""
    parts = []
    for name, df in tables.items():
        empty = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
        parts.append(df.agg(F.lit(name).alias("table_name"), F.lit(len(df.columns)).alias("columns"), F.count("*").alias("n_rows"), empty.cast("long").alias("n_empty")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
