"""Ingestion: plans, write strategies, schema contracts, masks and change feeds."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, fields
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dml
from .star import interval

# The strategy names.
STRATEGIES = ("replace", "truncate+insert", "append", "delete+insert", "merge", "scd2", "none")
# The contract names.
CONTRACTS = ("evolve", "freeze", "discard_row", "discard_value")
FROM, TO = "_scd_valid_from", "_scd_valid_to"


@dataclass(frozen=True)
class IngestPlan:
    source_uri: str = ""
    source_table: str = ""
    dest_uri: str = ""
    dest_table: str = ""
    strategy: str | None = None
    primary_key: tuple[str, ...] = ()
    incremental_key: str | None = None
    interval_start: str | None = None
    interval_end: str | None = None
    partition_by: str | None = None
    cluster_by: tuple[str, ...] = ()
    contract: str = "evolve"
    naming: str = "direct"
    full_refresh: bool = False
    extract_parallelism: int | None = None
    page_size: int | None = None
    progress: str | None = None
    debug: bool = False
    columns: str | None = None
    exclude: tuple[str, ...] = ()
    limit: int | None = None
    mask: tuple[str, ...] = ()
    metadata: bool = True
    yes: bool = False

    @classmethod
    def from_dict(cls, raw: dict) -> "IngestPlan":
        """From JSON with snake_case or camelCase names; text lists may be comma-separated; unknown names are ignored."""
        flat = {re.sub(r"([A-Z])", r"_\1", k).lower().replace("-", "_"): v for k, v in raw.items()}
        flat["strategy"] = flat.get("strategy") or flat.get("incremental_strategy")
        flat["contract"] = flat.get("contract") or flat.get("schema_contract")
        flat["naming"] = flat.get("naming") or flat.get("schema_naming")
        if flat.get("source_query"):
            flat["source_table"] = f"query:{flat['source_query']}"
        out = {}
        for f in fields(cls):
            v = flat.get(f.name)
            if v is None:
                continue
            if f.name in ("extract_parallelism", "page_size", "limit"):
                v = int(v)
            if f.name in ("full_refresh", "debug", "metadata", "yes"):
                v = v if isinstance(v, bool) else str(v).lower() in ("1", "true", "yes", "on")
            if f.name in ("primary_key", "mask", "cluster_by", "exclude"):
                v = tuple(x.strip() for x in v.split(",")) if isinstance(v, str) else tuple(map(str, v))
            out[f.name] = v
        return cls(**out)

    def pick(self) -> str:
        """The given strategy; else append with an incremental key, else replace."""
        return self.strategy or ("append" if self.incremental_key else "replace")

    def errors(self) -> list[str]:
        out = [f"{n} is missing" for n in ("source_uri", "source_table", "dest_uri", "dest_table") if not getattr(self, n)]
        if self.strategy and self.strategy not in STRATEGIES:
            out.append(f"unknown strategy {self.strategy}")
        if self.strategy in ("merge", "scd2") and not self.primary_key:
            out.append(f"{self.strategy} needs a primary key")
        if self.pick() == "delete+insert" and not self.incremental_key:
            out.append("delete+insert needs an incremental key")
        if self.contract not in CONTRACTS:
            out.append(f"unknown contract {self.contract}")
        return out

    def command(self) -> list[str]:
        """The plan as command-line words, in a fixed order; replace is the default and left out."""
        words = ["ingest"]
        for n in ("source_uri", "source_table", "dest_uri", "dest_table"):
            words += [f"--{n.replace('_', '-')}", getattr(self, n)]
        if self.pick() != "replace":
            words += ["--incremental-strategy", self.pick()]
        if self.incremental_key:
            words += ["--incremental-key", self.incremental_key]
        for k in self.primary_key:
            words += ["--primary-key", k]
        for n in ("interval_start", "interval_end", "partition_by"):
            if getattr(self, n):
                words += [f"--{n.replace('_', '-')}", getattr(self, n)]
        for c in self.cluster_by:
            words += ["--cluster-by", c]
        if self.contract != "evolve":
            words += ["--schema-contract", self.contract]
        if self.naming != "direct":
            words += ["--schema-naming", self.naming]
        words += ["--full-refresh"] if self.full_refresh else []
        for n in ("extract_parallelism", "page_size", "progress"):
            if getattr(self, n):
                words += [f"--{n.replace('_', '-')}", str(getattr(self, n))]
        words += ["--debug"] if self.debug else []
        if self.columns:
            words += ["--columns", self.columns]
        for m in self.mask:
            words += ["--mask", m]
        return words + (["--yes"] if self.yes else [])


def from_environment(given: dict, environment: dict, prefix: str = "SPARKLOOM_") -> dict:
    """Settings of a plan: given ones first, then variables PREFIX_NAME, then the defaults."""
    names = {f.name for f in fields(IngestPlan)} | {"source_query", "incremental_strategy"}
    env = {k.removeprefix(prefix).lower(): v for k, v in environment.items() if k.startswith(prefix)}
    return {k: v for k, v in env.items() if k in names} | {k: v for k, v in given.items() if v is not None}


def apply(strategy: str, target: DataFrame | None, stage: DataFrame, key=(), incremental_key: str | None = None, start=None, end=None) -> DataFrame | None:
    """The table after one run; None where the strategy writes nothing."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "none":
        return None
    if incremental_key and (start is not None or end is not None):
        stage = interval(stage, incremental_key, start, end)
    if strategy == "scd2":
        return scd2(target, stage, list(key), incremental_key)
    if strategy == "append" and (incremental_key is None or start is None and end is None) and target is not None:
        raise ValueError("append needs an incremental key and an interval, or it loads all rows again")
    if target is None or strategy == "replace":
        return dml.latest(stage, key, incremental_key) if strategy == "merge" else stage
    if strategy == "truncate+insert":
        return stage.select(*target.columns)
    if strategy == "append":
        return target.unionByName(stage)
    if strategy == "delete+insert":
        if incremental_key is None:
            raise ValueError("delete+insert needs an incremental key")
        if start is None and end is None:
            edge = stage.agg(F.min(incremental_key).alias("a"), F.max(incremental_key).alias("b"))
            inside = target.join(F.broadcast(edge), (F.col(incremental_key) >= F.col("a")) & (F.col(incremental_key) <= F.col("b")), "left_anti")  # one row
            return inside.unionByName(stage)
        k = F.col(incremental_key)
        hit = (k >= F.lit(start) if start is not None else F.lit(True)) & (k < F.lit(end) if end is not None else F.lit(True))
        return dml.delete(target, hit).unionByName(stage)
    return dml.upsert(target, stage, key, by=incremental_key)


def scd2(target: DataFrame | None, stage: DataFrame, key: list[str], by: str) -> DataFrame:
    """Type-2 history: a changed row closes the open version at its own time and opens another; unchanged rows do nothing.

    Versions inside the batch are chained in order of `by`; running the
    same batch again changes nothing.
    """
    values = [c for c in stage.columns if c not in key and c != by]
    history = stage.select(*stage.columns, F.col(by).alias(FROM)).withColumn("__new", F.lit(1))
    closed = None
    if target is not None:
        closed = target.where(F.col(TO).isNotNull())
        history = history.unionByName(target.where(F.col(TO).isNull()).drop(TO).withColumn("__new", F.lit(0)))
    w = Window.partitionBy(*key).orderBy(FROM, "__new", *values)
    mark = F.xxhash64(*values) if values else F.lit(0).cast("long")
    history = history.withColumn("__h", mark).withColumn("__before", F.lag("__h").over(w)).where("__before IS NULL OR __before <> __h OR __new = 0")
    history = history.withColumn(TO, F.lead(FROM).over(w))
    out = history.drop("__new", "__h", "__before")
    return out if closed is None else closed.unionByName(out)


LSN, GONE = "_lsn", "_deleted"


def logged(feed: DataFrame, op: str = "op", lsn: str = "lsn") -> DataFrame:
    """A change feed as rows with their LSN and a mark on deletions."""
    return feed.select(*(c for c in feed.columns if c not in (op, lsn)), F.col(lsn).cast("long").alias(LSN), (F.col(op) == "D").alias(GONE))


def current(log: DataFrame, key: list[str]) -> DataFrame:
    """What logged changes stand for: the row of the greatest LSN of each key, unless that deletes it."""
    return dml.latest(log, key, LSN).where(~F.col(GONE)).drop(LSN, GONE)


def changes(target: DataFrame, feed: DataFrame, key: list[str], op: str = "op", lsn: str = "lsn") -> DataFrame:
    """Apply a change feed (I, U, D): the last operation of each key wins; applying a feed again changes nothing.

    A target with LSN and deletion marks (`logged`) keeps them, so that an
    older operation that comes later loses. One without is taken as older than
    all of the feed.
    """
    if LSN in target.columns:
        return dml.latest(target.unionByName(logged(feed, op, lsn)), key, LSN)
    old = target.select("*", F.lit(None).cast("long").alias(LSN), F.lit(False).alias(GONE))
    rows = feed.select(*target.columns, F.col(lsn).cast("long").alias(LSN), (F.col(op) == "D").alias(GONE))
    return current(old.unionByName(rows), key)


# ---- schema ----

WIDER = ["tinyint", "smallint", "int", "bigint", "float", "double"]


def compare(target: T.StructType, source: T.StructType) -> dict[str, list[str]]:
    """Columns added, removed, widened or incompatible in the source."""
    t, s = ({f.name: f.dataType.simpleString() for f in x} for x in (target, source))
    out = {"added": [c for c in s if c not in t], "removed": [c for c in t if c not in s], "widened": [], "incompatible": []}
    for c in s:
        if c in t and s[c] != t[c]:
            wide = s[c] in WIDER and t[c] in WIDER
            if wide and WIDER.index(s[c]) > WIDER.index(t[c]):
                out["widened"].append(c)
            elif not wide:
                out["incompatible"].append(c)
    return out


def align(target: DataFrame, source: DataFrame, contract: str) -> tuple[DataFrame, DataFrame]:
    """(target, source) with one schema under a contract.

    evolve: the source's columns and types rule, incompatible ones become
    text; freeze: any drift is an error; discard_row: rows that carry drift go;
    discard_value: values that do not fit become null, new columns go.
    """
    drift = compare(target.schema, source.schema)
    if contract == "freeze":
        if any(drift.values()):
            raise ValueError(f"schema drift: {drift}")
        return target, source
    if contract == "evolve":
        for c in drift["added"]:
            target = target.withColumn(c, F.lit(None).cast(source.schema[c].dataType))
        target = target.drop(*drift["removed"])
        for c in drift["widened"]:
            target = target.withColumn(c, F.col(c).cast(source.schema[c].dataType))
        for c in drift["incompatible"]:
            target, source = target.withColumn(c, F.col(c).cast("string")), source.withColumn(c, F.col(c).cast("string"))
        return target, source.select(*(F.col(c).cast(target.schema[c].dataType).alias(c) for c in target.columns))
    fits, cols = F.lit(True), []
    for f in target.schema:
        if f.name in drift["removed"]:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        x = F.col(f.name).try_cast(f.dataType)
        fits = fits & (F.col(f.name).isNull() | x.isNotNull())
        cols.append(x.alias(f.name))
    if contract == "discard_row":
        for c in drift["added"]:
            fits = fits & F.col(c).isNull()
        source = source.where(fits)
    return target, source.select(*cols)


@dataclass(frozen=True)
class Change:
    """One step of a schema's evolution."""

    kind: str  # add, drop, widen, text, relax
    column: str
    type: str = ""

    def sql(self, table: str) -> str:
        name = f"ALTER TABLE {table} "
        if self.kind == "add":
            return name + f"ADD COLUMN {self.column} {self.type}"
        if self.kind == "drop":
            return name + f"DROP COLUMN {self.column}"
        return name + f"ALTER COLUMN {self.column} " + ("DROP NOT NULL" if self.kind == "relax" else f"TYPE {self.type}")


def evolution(target: T.StructType, source: T.StructType) -> list[Change]:
    """What turns the target's schema into one that the source fits: no renames, no keys, nothing tightened."""
    drift = compare(target, source)
    out = [Change("add", c, source[c].dataType.simpleString()) for c in drift["added"]]
    out += [Change("drop", c) for c in drift["removed"]]
    out += [Change("widen", c, source[c].dataType.simpleString()) for c in drift["widened"]]
    out += [Change("text", c, "string") for c in drift["incompatible"]]
    return out + [Change("relax", f.name) for f in target if not f.nullable and f.name in source.names and source[f.name].nullable]


def naming(df: DataFrame, mode: str, target: Sequence[str] | None = None) -> DataFrame:
    """direct: as they are; snake_case: all; auto: the names that the target's columns have already, as they are where it has none.

    A column is the target's if both have one snake_case name. Two columns of one name are an error.
    """
    from ..functions.dialect import snake_case

    if mode not in ("direct", "snake_case", "auto"):
        raise ValueError(f"unknown naming {mode}")
    known = {snake_case(c): c for c in target or ()} | {c: c for c in target or ()} if mode == "auto" else {}
    names = [snake_case(c) if mode == "snake_case" else known.get(c, known.get(snake_case(c), c)) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("two columns get one name")
    return df.toDF(*names)


def infer(df: DataFrame) -> T.StructType:
    """Types for an all-text frame: the narrowest of bigint, double and string that all values allow; one pass."""
    tests = []
    for c in df.columns:
        v = F.col(c)
        tests += [F.count(v).alias(f"{c}__n"), F.count(v.try_cast("bigint")).alias(f"{c}__i"), F.count(v.try_cast("double")).alias(f"{c}__d"), F.count("*").alias(f"{c}__a")]
    r = df.agg(*tests).first()
    kind = lambda c: T.LongType() if r[f"{c}__n"] and r[f"{c}__i"] == r[f"{c}__n"] else T.DoubleType() if r[f"{c}__n"] and r[f"{c}__d"] == r[f"{c}__n"] else T.StringType()
    return T.StructType([T.StructField(c, kind(c), r[f"{c}__n"] < r[f"{c}__a"]) for c in df.columns])


def infer_records(rows: list[dict], sample: int = 1000) -> T.StructType:
    """Types for records without a schema, from the first `sample`: columns are joined, numbers widen, mixed kinds become text, nested values JSON text."""
    kinds: dict[str, set] = {}
    seen: dict[str, int] = {}
    rows = rows[:sample]
    for r in rows:
        for k, v in r.items():
            known = kinds.setdefault(k, set())
            if v is not None:
                seen[k] = seen.get(k, 0) + 1
                known.add("json" if isinstance(v, (dict, list)) else "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "string")
    pick = lambda k: next(iter(k)) if len(k) == 1 else "double" if k == {"bigint", "double"} else "string"
    types = {"json": T.StringType(), "boolean": T.BooleanType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}
    return T.StructType([T.StructField(k, types[pick(v)] if v else T.StringType(), seen.get(k, 0) < len(rows)) for k, v in kinds.items()])


def explicit(df: DataFrame, spec: str) -> DataFrame:
    """`name:type` or `name:type:source`, comma-separated; other columns stay."""
    for part in filter(None, (x.strip() for x in spec.split(","))):
        name, kind, *source = part.split(":")
        df = df.withColumn(name, F.col(source[0] if source else name).cast({"integer": "int", "text": "string", "json": "string"}.get(kind, kind)))
        if source and source[0] != name:
            df = df.drop(source[0])
    return df


def stamp(df: DataFrame, uri: str, table: str) -> DataFrame:
    """Load metadata columns."""
    return df.withColumns({"_loaded_at": F.current_timestamp(), "_source_uri": F.lit(uri), "_source_table": F.lit(table)})


# ---- masks ----


def mask(df: DataFrame, *specs: str) -> DataFrame:
    """`column:algorithm[:parameter]`, applied in turn: hash, partial (last N stay), both (first and last N stay), round, nullify, redact."""
    for spec in specs:
        c, algo, *rest = spec.split(":")
        x, text = F.col(c), F.col(c).cast("string")
        if algo == "hash":
            new = F.sha2(text, 256)
        elif algo == "partial":
            n = int(rest[0])
            new = F.concat(F.repeat(F.lit("*"), F.greatest(F.char_length(text) - n, F.lit(0))), F.right(text, F.lit(n)))
        elif algo == "both":
            n = int(rest[0])
            middle = F.char_length(text) - 2 * n
            new = F.when(middle > 0, F.concat(F.left(text, F.lit(n)), F.repeat(F.lit("*"), middle), F.right(text, F.lit(n)))).otherwise(text)
        elif algo == "round":
            n = float(rest[0])
            new = (F.round(x / n) * n).cast(df.schema[c].dataType)
        elif algo == "nullify":
            new = F.lit(None).cast(df.schema[c].dataType)
        elif algo == "redact":
            new = F.lit("***REDACTED***")
        else:
            raise ValueError(f"unknown mask {algo}")
        df = df.withColumn(c, new)
    return df


def reconcile(source: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows and distinct keys on both sides, and whether they agree."""
    n = lambda d, p: d.agg(F.count("*").alias(f"{p}_rows"), F.count_distinct(*key).alias(f"{p}_keys"))
    return n(source, "source").crossJoin(n(target, "target")).withColumn("equal", F.expr("source_rows = target_rows AND source_keys = target_keys"))  # one row each


def months(start: date, end: date) -> list[tuple[date, date]]:
    """Half-open monthly windows from start to end."""
    out = []
    while start < end:
        nxt = date(start.year + start.month // 12, start.month % 12 + 1, 1)
        out.append((start, min(nxt, end)))
        start = nxt
    return out


# ---- running a plan ----


def retried(run, attempts: int = 3, wait: float = 0.0):
    """run(), again after a failure, `attempts` times in all; the last failure is raised."""
    import time

    for i in range(attempts):
        try:
            return run()
        except Exception:
            if i == attempts - 1:
                raise
            time.sleep(wait * 2**i)


def extract(spark, plan: IngestPlan, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The source's rows: `query:SQL` over tables, with :interval_start and :interval_end as parameters, or a URI and its table. Only columns and rows that the plan wants are read."""
    from ..sources import uris

    if plan.source_table.startswith("query:"):
        for n, df in (tables or {}).items():
            df.createOrReplaceTempView(n)
        text = plan.source_table.removeprefix("query:")
        args = {n: getattr(plan, n) for n in ("interval_start", "interval_end") if f":{n}" in text}
        df = spark.sql(text, args=args)
    elif tables and plan.source_table in tables:
        df = tables[plan.source_table]
    else:
        options = {"table": plan.source_table, "parallelism": plan.extract_parallelism, "page_size": plan.page_size} if uris.kind(plan.source_uri.partition("://")[0]) == "jdbc" else {}
        df = uris.read(spark, plan.source_uri, **options)
    df = df.drop(*plan.exclude)
    if plan.incremental_key and not plan.source_table.startswith("query:"):
        df = interval(df, plan.incremental_key, plan.interval_start, plan.interval_end)
    return df.limit(plan.limit) if plan.limit else df


def run(spark, plan: IngestPlan, database, tables: dict[str, DataFrame] | None = None, keep_staging: bool = False) -> dict:
    """Extract, name, type, mask and stamp, hold against the contract, stage, apply the strategy, commit. Returns what was done.

    The stage is a table of its own, so that the source is read once; it goes
    after the commit unless it is to be kept. `none` resolves the plan and
    writes nothing.
    """
    why = plan.errors()
    if why:
        raise ValueError("; ".join(why))
    target_table = database.table(plan.dest_table)
    target = target_table.read() if target_table.version() is not None else None
    df = naming(extract(spark, plan, tables), plan.naming, None if target is None else target.columns)
    if plan.columns:
        df = explicit(df, plan.columns)
    df = mask(df, *plan.mask)
    if plan.metadata:
        df = stamp(df, plan.source_uri, plan.source_table)
    strategy = "replace" if plan.full_refresh else plan.pick()
    if strategy == "none":
        return {"strategy": strategy, "schema": df.schema.simpleString(), "rows": 0}
    name = staging_name(plan.dest_table, strategy)
    database.create_as(name, df)
    stage = database.read(name)
    if target is not None and strategy not in ("replace", "scd2"):
        target, stage = align(target, stage, plan.contract)
    if strategy == "append" and target is not None and target.columns == target_table.read().columns:
        target_table.append(stage)
    else:
        start, end = (None, None) if plan.source_table.startswith("query:") else (plan.interval_start, plan.interval_end)
        out = apply(strategy, target, stage, plan.primary_key, plan.incremental_key, start, end)
        out = out.sortWithinPartitions(*plan.cluster_by) if plan.cluster_by else out
        target_table.commit(out, [plan.partition_by] if plan.partition_by else ())
    rows = stage.count()
    if not keep_staging:
        database.drop(name)
    return {"strategy": strategy, "schema": df.schema.simpleString(), "rows": rows}


def staging_name(table: str, strategy: str) -> str:
    import time
    import uuid

    return f"staging__{table}__{re.sub('[^a-z0-9]', '_', strategy)}__{int(time.time())}__{uuid.uuid4().hex[:8]}"


def sweep_staging(database, hours: float = 24, now: float | None = None) -> list[str]:
    """Drop staging tables older than their time to live; returns their names."""
    import time

    now, gone = time.time() if now is None else now, []
    for n in database.tables():
        parts = n.split("__")
        if n.startswith("staging__") and now - int(parts[-2]) > hours * 3600:
            database.drop(n)
            gone.append(n)
    return gone


def run_all(spark, plans: list[IngestPlan], database, tables: dict[str, DataFrame] | None = None, parallel: int = 4) -> DataFrame:
    """Several loads at a time, each on its own: (table, state, rows, reason), one row for each plan."""
    from concurrent.futures import ThreadPoolExecutor

    def one(plan):
        try:
            return (plan.dest_table, "success", run(spark, plan, database, tables)["rows"], None)
        except Exception as e:  # a load that fails is counted, and the others go on
            return (plan.dest_table, "failed", 0, str(e).splitlines()[0][:200])

    with ThreadPoolExecutor(parallel) as pool:
        return spark.createDataFrame(list(pool.map(one, plans)), "table string, state string, rows bigint, reason string")
