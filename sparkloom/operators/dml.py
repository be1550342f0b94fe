"""Row-level changes as copy-on-write: each verb takes frames and returns the new table; `Table` commits it by a swap."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _same(a: DataFrame, b: DataFrame, key: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in key:
        on = on & (a[k] == b[k])
    return on


def latest(df: DataFrame, key: Sequence[str], by: str | None) -> DataFrame:
    """One row for each key: the latest by `by`, or any one."""
    if by is None:
        return df.dropDuplicates(list(key))
    order = [F.col(by).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in df.columns if c != by and not df.schema[c].dataType.typeName() in ("map", "variant"))]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def insert_ignore(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    return target.unionByName(source.dropDuplicates(list(key)).join(target.select(*key), list(key), "left_anti").select(*target.columns))


def upsert(target: DataFrame, source: DataFrame, key: Sequence[str], when: str | None = None, by: str | None = None) -> DataFrame:
    """Insert or replace by key. `when` is SQL over t (target) and s (source) that lets a replacement through."""
    s = latest(source, key, by)
    both = target.withColumn("__t", F.lit(1)).alias("t").join(s.withColumn("__s", F.lit(1)).alias("s"), [F.col(f"t.{k}") == F.col(f"s.{k}") for k in key], "full")
    take = F.col("__s").isNotNull() & (F.col("__t").isNull() | (F.expr(when) if when else F.lit(True)))
    return both.select(*(F.when(take, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns))


def update(target: DataFrame, sets: dict[str, Column], where: Column | None = None) -> DataFrame:
    cond = F.lit(True) if where is None else where
    return target.select(*(F.when(cond, sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in target.columns))


def update_from(target: DataFrame, source: DataFrame, key: Sequence[str], sets: dict[str, str]) -> DataFrame:
    """UPDATE ... FROM: sets maps a column to SQL over t and s; a key may occur once in the source."""
    source = _single(source, key)
    both = target.alias("t").join(source.withColumn("__s", F.lit(1)).alias("s"), [F.col(f"t.{k}") == F.col(f"s.{k}") for k in key], "left")
    return both.select(*(F.when(F.col("__s") == 1, F.expr(sets[c])).otherwise(F.col(f"t.{c}")).alias(c) if c in sets else F.col(f"t.{c}") for c in target.columns))


def delete(target: DataFrame, where: Column) -> DataFrame:
    return target.where(~F.coalesce(where, F.lit(False)))


def delete_using(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    return target.join(source.select(*key), list(key), "left_anti").select(*target.columns)


def _single(source: DataFrame, key: Sequence[str]) -> DataFrame:
    """The source, failing where a key occurs twice; the check is part of the plan."""
    n = F.count("*").over(Window.partitionBy(*key))
    return source.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.lit("several source rows match one key")).isNull()).otherwise(F.lit(True))).drop("__n")


def merge(target: DataFrame, source: DataFrame, key: Sequence[str], matched: Sequence[tuple[str | None, str, dict | None]] = (), unmatched: Sequence[tuple[str | None, dict | None]] = ((None, None),), missing: Sequence[tuple[str | None, str, dict | None]] = ()) -> DataFrame:
    """MERGE INTO. Clauses are tried in order, the first whose condition holds acts.

    matched: (condition over t and s, 'update' or 'delete' or 'keep', sets as SQL or None for the whole source row);
    unmatched: (condition over s, values as SQL or None for the whole row);
    missing (rows of the target without a source row): as matched, over t.
    Several source rows for one key are an error.
    """
    source = _single(source, key)
    both = target.withColumn("__t", F.lit(1)).alias("t").join(source.withColumn("__s", F.lit(1)).alias("s"), [F.col(f"t.{k}") == F.col(f"s.{k}") for k in key], "full")
    rules = [(F.col("__t").isNotNull() & F.col("__s").isNotNull(), c, a, v) for c, a, v in matched]
    rules += [(F.col("__t").isNull(), c, "insert", v) for c, v in unmatched]
    rules += [(F.col("__s").isNull(), c, a, v) for c, a, v in missing]
    at = F.lit(-1)
    for i, (side, cond, *_) in reversed(list(enumerate(rules))):
        at = F.when(side & (F.coalesce(F.expr(cond), F.lit(False)) if cond else F.lit(True)), i).otherwise(at)
    both = both.withColumn("__at", at)
    dropped = [i for i, r in enumerate(rules) if r[2] == "delete"]
    both = both.where(~F.col("__at").isin(dropped) if dropped else F.lit(True)).where("NOT (__at = -1 AND __t IS NULL)")
    out = []
    for c in target.columns:
        value = F.col(f"t.{c}")
        for i, (_, _, action, sets) in enumerate(rules):
            if action in ("update", "insert"):
                new = F.col(f"s.{c}") if sets is None else F.expr(sets[c]) if c in sets else F.lit(None) if action == "insert" else F.col(f"t.{c}")
                value = F.when(F.col("__at") == i, new).otherwise(value)
        out.append(value.cast(target.schema[c].dataType).alias(c))
    return both.select(*out)


def violations(df: DataFrame, key: Sequence[str] = (), not_null: Sequence[str] = (), check: Column | None = None, foreign: tuple[DataFrame, str, str] | None = None) -> dict[str, int]:
    """Rows that break each constraint."""
    out = {}
    if key:
        out["key"] = df.groupBy(*key).count().where("count > 1").count()
    for c in not_null:
        out[f"not_null:{c}"] = df.where(F.col(c).isNull()).count()
    if check is not None:
        out["check"] = df.where(~check).count()
    if foreign:
        parent, child_key, parent_key = foreign
        p = parent.select(F.col(parent_key).alias(child_key))
        out["foreign"] = df.where(F.col(child_key).isNotNull()).join(p, child_key, "left_anti").count()
    return out


class Conflict(RuntimeError):
    """Another writer committed first."""


class Table:
    """A Parquet table as folders that a numbered manifest lists.

    A commit writes new folders, then one manifest under a name that nobody
    reads, and renames it to the next number: readers see the manifest before
    or the one after, and a crash in between leaves the one before. A second
    writer of the same number gets a Conflict. Appending adds a folder and
    rewrites nothing.
    """

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(p))
        return sorted(int(n.removeprefix("_manifest-")) for n in names if n.startswith("_manifest-"))

    def version(self) -> int | None:
        numbers = self._numbers()
        return numbers[-1] if numbers else None

    def manifest(self, version: int | None = None) -> dict:
        """{schema, folders} of a version, the current one by default."""
        n = self.version() if version is None else version
        if n is None:
            raise FileNotFoundError(self.path)
        fs, p = self._fs(f"{self.path}/_manifest-{n:012d}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, schema, folders: list[str], after: int | None) -> int:
        n = 0 if after is None else after + 1
        fs, temporary = self._fs(f"{self.path}/_next-{uuid.uuid4().hex}")
        _, final = self._fs(f"{self.path}/_manifest-{n:012d}")
        out = fs.create(temporary, False)
        out.write(json.dumps({"schema": schema.json(), "folders": folders}).encode())
        out.close()
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise Conflict(f"{self.path}: version {n} exists")
        return n

    def _write(self, df: DataFrame, partition_by: Sequence[str]) -> str:
        if self.read_only:
            raise PermissionError("read-only table")
        name = f"v-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/{name}")
        return name

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{f}") for f in m["folders"]]
        out = parts[0] if parts else self.spark.createDataFrame([], schema)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select(*(F.col(f"`{c}`") for c in schema.names))

    def commit(self, df: DataFrame, partition_by: Sequence[str] = ()) -> int:
        """df is the table from now on; it may be made from what the table holds. Returns the version."""
        before = self.version()
        return self._publish(df.schema, [self._write(df, partition_by)], before)

    def append(self, df: DataFrame, partition_by: Sequence[str] = ()) -> int:
        before = self.version()
        if before is None:
            return self.commit(df, partition_by)
        m = self.manifest(before)
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        fitted = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))
        return self._publish(schema, [*m["folders"], self._write(fitted, partition_by)], before)

    def rollback(self, version: int) -> int:
        """An older version's content as the next version."""
        m = self.manifest(version)
        return self._publish(T.StructType.fromJson(json.loads(m["schema"])), m["folders"], self.version())

    def sweep(self) -> int:
        """Delete folders and manifests that the current version does not need; returns the number of folders."""
        fs, p = self._fs(self.path)
        keep, gone = set(self.manifest()["folders"]), 0
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name.startswith("v-") and name not in keep:
                fs.delete(s.getPath(), True)
                gone += 1
            elif name.startswith("_manifest-") and int(name.removeprefix("_manifest-")) != self.version():
                fs.delete(s.getPath(), False)
        return gone
