"""Databases as folders of tables: creation, changes, copies, attachment and queries over several."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import dml


class CatalogError(ValueError):
    """A table, column or database is missing or exists already."""


class Database:
    """Tables by name in one folder. Every change is a commit of the table; several tables do not change together."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only

    # ---- names ----
    def tables(self) -> list[str]:
        fs, p = dml.Table(self.spark, self.path)._fs(self.path)
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
        return [n for n in names if self.table(n).version() is not None]

    def table(self, name: str) -> dml.Table:
        if not re.fullmatch(r"[A-Za-z_]\w*", name):
            raise CatalogError(f"not a table name: {name}")
        return dml.Table(self.spark, f"{self.path}/{name}", self.read_only)

    def read(self, name: str) -> DataFrame:
        t = self.table(name)
        if t.version() is None:
            raise CatalogError(f"no table {name}")
        return t.read()

    # ---- definition ----
    def create(self, name: str, schema: str | T.StructType, replace: bool = False, if_not_exists: bool = False) -> None:
        if self.table(name).version() is not None:
            if if_not_exists:
                return
            if not replace:
                raise CatalogError(f"table {name} exists")
        self.table(name).commit(self.spark.createDataFrame([], schema))

    def create_as(self, name: str, df: DataFrame, replace: bool = False, partition_by: Sequence[str] = ()) -> None:
        if not replace and self.table(name).version() is not None:
            raise CatalogError(f"table {name} exists")
        self.table(name).commit(df, partition_by)

    def drop(self, name: str, if_exists: bool = False) -> None:
        t = self.table(name)
        if t.version() is None:
            if if_exists:
                return
            raise CatalogError(f"no table {name}")
        if self.read_only:
            raise PermissionError("read-only database")
        fs, p = t._fs(t.path)
        fs.delete(p, True)

    def truncate(self, name: str) -> None:
        self.table(name).commit(self.read(name).limit(0))

    def alter(self, name: str, add: dict[str, str] | None = None, drop: Sequence[str] = (), rename: dict[str, str] | None = None, retype: dict[str, str] | None = None) -> None:
        """ADD, DROP, RENAME and SET TYPE in this order, as one commit."""
        df = self.read(name)
        for c, t in (add or {}).items():
            if c in df.columns:
                raise CatalogError(f"column {c} exists")
            df = df.withColumn(c, F.lit(None).cast(t))
        for c in (*drop, *(rename or {}), *(retype or {})):
            if c not in df.columns:
                raise CatalogError(f"no column {c}")
        df = df.drop(*drop).withColumnsRenamed(rename or {})
        for c, t in (retype or {}).items():
            df = df.withColumn(c, F.col(c).cast(t))
        self.table(name).commit(df)

    # ---- rows; each verb returns the rows that it touched ----
    def insert(self, name: str, rows: DataFrame, columns: Sequence[str] | None = None, by_name: bool = False, defaults: dict[str, Column] | None = None) -> DataFrame:
        """Append rows: by place, to named columns, or by name. Columns left out get their default or null."""
        schema = self.read(name).schema
        names = list(rows.columns) if by_name else list(columns or schema.names)
        unknown = set(names) - set(schema.names)
        if unknown or len(names) != len(rows.columns):
            raise CatalogError(f"columns do not fit: {sorted(unknown) or names}")
        given = rows.toDF(*names)
        value = lambda f: F.col(f.name) if f.name in names else (defaults or {}).get(f.name, F.lit(None))
        full = given.select(*(value(f).cast(f.dataType).alias(f.name) for f in schema))
        t = self.table(name)
        t.append(full)
        folder = t.manifest()["folders"][-1]
        return self.spark.read.schema(schema).parquet(f"{t.path}/{folder}")

    def delete(self, name: str, where: Column) -> DataFrame:
        before = self.table(name).version()
        self.table(name).commit(dml.delete(self.read(name), where))
        return self.table(name).read(before).where(where)

    def update(self, name: str, sets: dict[str, Column], where: Column) -> DataFrame:
        before = self.table(name).version()
        self.table(name).commit(dml.update(self.read(name), sets, where))
        return dml.update(self.table(name).read(before).where(where), sets)

    def transaction(self, name: str, steps: Sequence) -> int:
        """BEGIN ... COMMIT for one table: each step maps a frame to a frame; one commit at the end, none if a step fails."""
        df = self.read(name)
        for step in steps:
            df = step(df)
        return self.table(name).commit(df)

    # ---- whole databases ----
    def copy_to(self, other: Database, schema_only: bool = False, tables: Sequence[str] | None = None) -> dict[str, int]:
        """COPY FROM DATABASE: every table, or its schema alone; returns rows by table."""
        out = {}
        for n in tables or self.tables():
            df = self.read(n)
            other.create_as(n, df.limit(0) if schema_only else df)
            out[n] = other.read(n).count()
        return out

    def export(self, path: str) -> None:
        """EXPORT DATABASE: one folder of Parquet for each table and a list of schemas."""
        rows = []
        for n in self.tables():
            df = self.read(n)
            df.write.parquet(f"{path}/{n}.parquet")
            rows.append((n, df.schema.json()))
        self.spark.createDataFrame(rows, "name string, schema string").coalesce(1).write.json(f"{path}/schema.json")

    def load(self, path: str) -> list[str]:
        """IMPORT DATABASE."""
        names = []
        for r in self.spark.read.schema("name string, schema string").json(f"{path}/schema.json").collect():  # one row for each table
            self.create_as(r.name, self.spark.read.schema(T.StructType.fromJson(json.loads(r.schema))).parquet(f"{path}/{r.name}.parquet"))
            names.append(r.name)
        return sorted(names)


class Attached:
    """ATTACH: databases and frames under aliases, and queries over all of them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.databases, self.frames = spark, {}, {}

    def attach(self, alias: str, database: Database) -> Attached:
        if alias in self.databases:
            raise CatalogError(f"{alias} is attached")
        self.databases[alias] = database
        return self

    def register(self, name: str, df: DataFrame) -> Attached:
        self.frames[name] = df
        return self

    def detach(self, alias: str) -> None:
        if alias not in self.databases:
            raise CatalogError(f"{alias} is not attached")
        del self.databases[alias]

    def sql(self, text: str, args: dict | None = None) -> DataFrame:
        """A query whose tables are `alias.table`, or registered frames by name."""
        views = {}

        def named(m):
            if m[2] not in self.databases:
                return m[0]
            views[f"{m[2]}__{m[3]}"] = self.databases[m[2]].read(m[3])
            return f"{m[1]}{m[2]}__{m[3]}"

        text = re.sub(r"(?i)(\b(?:FROM|JOIN)\s+)(\w+)\.(\w+)", named, text)
        for n, df in (self.frames | views).items():
            df.createOrReplaceTempView(n)
        return self.spark.sql(text, args=args)

