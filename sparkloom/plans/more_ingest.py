"""Ingestion entries: interfaces, plans, strategies, contracts, masks, staging and streams."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import functions as F

from ..operators import dml, ingest
from ..session import load, scratch
from ..sources import copying, uris
from ..sources.databases import Database
from ..streaming import feeds
from .catalogue import frame

P = ingest.IngestPlan


def listed(rows) -> str:
    """Rows as SQL VALUES."""
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({', '.join(map(text, r))})" for r in rows) + ")"


def fixed(name: str, columns: str, made, want) -> None:
    """An entry for a function that needs no table: its results against those wanted."""
    from .catalogue import QUERIES, SQL

    names = [c.split()[0] for c in columns.split(", ")]
    QUERIES[name] = lambda s, d: s.createDataFrame(made(), columns)
    SQL[name] = f"SELECT * FROM {listed(want)} t({', '.join(names)})"


# ---- schemes ----
fixed("S27_scheme_registry", "scheme string, kind string", lambda: [(x, uris.kind(x)) for x in ("csv", "postgresql+psycopg2", "gs", "memory", "kafka", "shopify", "nothing")], [("csv", "file"), ("postgresql+psycopg2", "jdbc"), ("gs", "store"), ("memory", "registered"), ("kafka", "connector"), ("shopify", "connector"), ("nothing", "unknown")])
fixed("S28_scheme_list", "scheme string, allowed boolean", lambda: [(x, not uris.problems(f"{x}://host/x")) for x in ("trino", "athena", "hana", "dynamodb", "spanner", "motherduck", "azure", "abfss", "md", "mmap", "ftp", "foo")], [(x, True) for x in ("trino", "athena", "hana", "dynamodb", "spanner", "motherduck", "azure", "abfss", "md", "mmap")] + [("ftp", False), ("foo", False)])
fixed("S29_normalise", "scheme string, plain string", lambda: [(x, uris.normalise(x)) for x in ("postgresql", "PG", "postgresql+asyncpg", "redshift+psycopg2", "azure-sql", "gs", "ndjson", "md", "csv")], [("postgresql", "postgres"), ("PG", "postgres"), ("postgresql+asyncpg", "postgres"), ("redshift+psycopg2", "redshift"), ("azure-sql", "azuresql"), ("gs", "gcs"), ("ndjson", "jsonl"), ("md", "motherduck"), ("csv", "csv")])
fixed("S30_validate", "uri string, reason string", lambda: [(u, ", ".join(uris.problems(u)) or None) for u in ("postgres://u:p@h:5432/db", "sqlite:////tmp/x.db", "csv:///data/u.csv", "", "nothing", "foo://h/db", "csv://", "postgres://", "1bad://h", "postgres://h:99999/db")], [("postgres://u:p@h:5432/db", None), ("sqlite:////tmp/x.db", None), ("csv:///data/u.csv", None), ("", "empty"), ("nothing", "no ://"), ("foo://h/db", "unsupported scheme foo"), ("csv://", "no path"), ("postgres://", "no host"), ("1bad://h", "bad scheme"), ("postgres://h:99999/db", "bad port")])
fixed("S31_jdbc_options", "key string, value string", lambda: sorted(uris.jdbc_options("postgresql://me:pw@h:5432/db", table="t", parallelism=8, page_size=500, partition_column="id", bounds=(0, 1000)).items()), [("dbtable", "t"), ("fetchsize", "500"), ("lowerBound", "0"), ("numPartitions", "8"), ("partitionColumn", "id"), ("password", "pw"), ("upperBound", "1000"), ("url", "jdbc:postgresql://h:5432/db"), ("user", "me")])


def refused(uri):
    return "connector" if uris.kind(uri.partition("://")[0]) == "connector" and not uris.problems(uri) else "other"


fixed("S32_nosql", "scheme string, how string", lambda: [(x, refused(f"{x}://h/db")) for x in ("mongodb", "cassandra", "elasticsearch", "dynamodb", "couchbase")], [(x, "connector") for x in ("mongodb", "cassandra", "elasticsearch", "dynamodb", "couchbase")])
fixed("S36_services", "scheme string, how string", lambda: [(x, refused(f"{x}://?key=k")) for x in ("stripe", "notion", "github", "zendesk", "google_ads")], [(x, "connector") for x in ("stripe", "notion", "github", "zendesk", "google_ads")])


@frame("SELECT r_regionkey, r_name FROM region")
def S25_source_interface(s, d):
    """A reader of one's own under a scheme of its own."""

    @uris.source("loomtable")
    def read(spark, rest, **options):
        return spark.read.parquet(f"{d}/{rest}.parquet").select(*options["columns"])

    return uris.read(s, "loomtable://region", columns=["r_regionkey", "r_name"])


@frame("SELECT n_nationkey, n_name FROM nation")
def S26_destination_interface(s, d):
    kept = {}

    @uris.destination("loomkeep")
    def write(df, rest, mode="overwrite", **options):
        kept[rest] = scratch(df.sparkSession, rest)
        df.write.mode(mode).parquet(kept[rest])

    uris.write(load(s, d, "nation").select("n_nationkey", "n_name"), "loomkeep://n", mode="overwrite")
    return s.read.parquet(kept["n"])


@frame("SELECT kind, count(*) AS n FROM supplier, (VALUES ('csv'), ('jsonl'), ('orc'), ('parquet')) t(kind) GROUP BY kind")
def S33_file_sources(s, d):
    out = None
    for kind in ("csv", "parquet", "jsonl", "orc"):
        path = scratch(s, kind)
        uris.write(load(s, d, "supplier"), f"{kind}://{path}")
        n = uris.read(s, f"{kind}://{path}").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@frame("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY o_custkey")
def S37_custom_query(s, d):
    """A query as the source, with the interval as its parameters."""
    plan = P("memory://x", "query:SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= CAST(:interval_start AS TIMESTAMP_NTZ) AND o_orderdate < CAST(:interval_end AS TIMESTAMP_NTZ) GROUP BY o_custkey", "memory://y", "t", interval_start="1995-01-01", interval_end="1996-01-01", metadata=False)
    db = Database(s, scratch(s, "db"))
    ingest.run(s, plan, db, {"orders": load(s, d, "orders")})
    return db.read("t")


@frame("SELECT kind, count(*) AS n FROM region, (VALUES ('csv'), ('memory'), ('parquet')) t(kind) GROUP BY kind")
def S38_destinations(s, d):
    out = None
    for kind in ("csv", "parquet", "memory"):
        uri = f"{kind}://{'loom_region' if kind == 'memory' else scratch(s, kind)}"
        uris.write(load(s, d, "region"), uri, mode="overwrite")
        n = uris.read(s, uri).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


# ---- plans ----
URIS = {"source_uri": "sqlite:////tmp/x", "source_table": "users", "dest_uri": "duckdb:///y", "dest_table": "users"}
fixed("I01_strategy_pick", "given string, key string, picked string", lambda: [(g, k, P(strategy=g, incremental_key=k).pick()) for g, k in ((None, None), (None, "at"), ("merge", "at"), ("scd2", None))], [(None, None, "replace"), (None, "at", "append"), ("merge", "at", "merge"), ("scd2", None, "scd2")])
fixed("I02_plan_errors", "plan string, problems bigint", lambda: [("whole", len(P(**URIS).errors())), ("empty", len(P().errors())), ("merge without key", len(P(**URIS, strategy="merge").errors())), ("odd strategy", len(P(**URIS, strategy="odd").errors())), ("scd2 with key", len(P(**URIS, strategy="scd2", primary_key=("id",)).errors())), ("odd contract", len(P(**URIS, contract="odd").errors()))], [("whole", 0), ("empty", 4), ("merge without key", 1), ("odd strategy", 1), ("scd2 with key", 0), ("odd contract", 1)])
RAW = json.dumps({"sourceUri": "sqlite:////tmp/x", "sourceTable": "users", "destUri": "duckdb:///y", "dest_table": "users", "primaryKey": "id, region", "incrementalKey": "at", "incrementalStrategy": "merge", "pageSize": "500", "fullRefresh": "false", "unknown": 1})
fixed("I03_plan_from_json", "field string, value string", lambda: [(n, json.dumps(getattr(P.from_dict(json.loads(RAW)), n))) for n in ("source_uri", "dest_table", "primary_key", "strategy", "page_size", "full_refresh")], [("source_uri", '"sqlite:////tmp/x"'), ("dest_table", '"users"'), ("primary_key", '["id", "region"]'), ("strategy", '"merge"'), ("page_size", "500"), ("full_refresh", "false")])
FULL = P(**URIS, strategy="merge", primary_key=("id", "r"), incremental_key="at", interval_start="2026-01-01", interval_end="2026-02-01", partition_by="day", cluster_by=("c", "e"), contract="freeze", naming="snake_case", full_refresh=True, extract_parallelism=8, page_size=100, progress="log", debug=True, columns="id:bigint", mask=("m:hash",), yes=True)
fixed("I04_plan_command", "plan string, command string", lambda: [("full", " ".join(FULL.command())), ("replace", " ".join(P(**URIS).command()))], [("full", "ingest --source-uri sqlite:////tmp/x --source-table users --dest-uri duckdb:///y --dest-table users --incremental-strategy merge --incremental-key at --primary-key id --primary-key r --interval-start 2026-01-01 --interval-end 2026-02-01 --partition-by day --cluster-by c --cluster-by e --schema-contract freeze --schema-naming snake_case --full-refresh --extract-parallelism 8 --page-size 100 --progress log --debug --columns id:bigint --mask m:hash --yes"), ("replace", "ingest --source-uri sqlite:////tmp/x --source-table users --dest-uri duckdb:///y --dest-table users")])
fixed("I36_environment", "field string, value string", lambda: sorted((k, str(v)) for k, v in ingest.from_environment({"dest_table": "mine", "primary_key": None}, {"SPARKLOOM_DEST_TABLE": "theirs", "SPARKLOOM_PRIMARY_KEY": "id", "SPARKLOOM_ODD": "x", "HOME": "/"}).items()), [("dest_table", "mine"), ("primary_key", "id")])
fixed("I30_slices", "start string, stop string", lambda: [(str(a), str(b)) for a, b in ingest.months(datetime.date(2026, 1, 15), datetime.date(2026, 3, 2))], [("2026-01-15", "2026-02-01"), ("2026-02-01", "2026-03-01"), ("2026-03-01", "2026-03-02")])
fixed("I33_slot", "same boolean, other boolean, named boolean", lambda: [(feeds.slot("a", "b", "t") == feeds.slot("a", "b", "t"), feeds.slot("a", "b", "t") != feeds.slot("a", "c", "t"), feeds.slot("a", "b", "t").startswith("t_"))], [(True, True, True)])


# ---- strategies over whole tables ----
ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"


def base(s, d):
    return load(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


def loaded(s, d, first, *plans, **more):
    """A database after the first load and further ones; each plan has the frame it reads."""
    db = Database(s, scratch(s, "db"))
    db.create_as("t", first)
    for df, settings in plans:
        ingest.run(s, P("memory://x", "src", "memory://y", "t", metadata=False, **settings), db, {"src": df}, **more)
    return db


@frame(f"{ORDERS} WHERE o_orderstatus = 'F'")
def I05_replace(s, d):
    return loaded(s, d, base(s, d), (base(s, d).where("o_orderstatus = 'F'"), {"strategy": "replace"})).read("t")


@frame(f"{ORDERS} WHERE o_orderstatus = 'O'")
def I06_truncate_insert(s, d):
    return loaded(s, d, base(s, d), (base(s, d).where("o_orderstatus = 'O'"), {"strategy": "truncate+insert"})).read("t")


@frame(f"{ORDERS} UNION ALL {ORDERS} WHERE o_orderkey >= 100 AND o_orderkey < 900")
def I07_append(s, d):
    return loaded(s, d, base(s, d), (base(s, d), {"strategy": "append", "incremental_key": "o_orderkey", "interval_start": 100, "interval_end": 900})).read("t")


@frame("SELECT 'none' AS strategy, 'struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string>' AS schema, 0::BIGINT AS rows, false AS written")
def I11_none(s, d):
    db = Database(s, scratch(s, "db"))
    r = ingest.run(s, P("memory://x", "src", "memory://y", "t", strategy="none", metadata=False), db, {"src": base(s, d)})
    return s.createDataFrame([(r["strategy"], r["schema"], r["rows"], "t" in db.tables())], "strategy string, schema string, rows bigint, written boolean")


@frame("SELECT 1::BIGINT AS kept, 1::BIGINT AS swept, 0::BIGINT AS left_over, count(*) AS n FROM orders")
def I12_staging(s, d):
    """A kept stage, swept after its 24 hours."""
    db = loaded(s, d, base(s, d), (base(s, d), {"strategy": "replace"}), keep_staging=True)
    kept = [n for n in db.tables() if n.startswith("staging__")]
    import time

    early, swept = ingest.sweep_staging(db), ingest.sweep_staging(db, now=time.time() + 25 * 3600)
    assert not early
    return db.read("t").agg(F.lit(len(kept)).cast("long").alias("kept"), F.lit(len(swept)).cast("long").alias("swept"), F.lit(len(db.tables()) - 1).cast("long").alias("left_over"), F.count("*").alias("n"))


@frame("SELECT count(*) AS before, count(*) FILTER (o_orderstatus = 'F') AS after, true AS conflict FROM orders")
def I13_swap(s, d):
    """A reader of the version before a swap still has its rows; a second writer of one version is refused."""
    db = Database(s, scratch(s, "db"))
    db.create_as("t", base(s, d))
    t = db.table("t")
    old = t.read()
    v = t.version()
    t.commit(base(s, d).where("o_orderstatus = 'F'"))
    try:
        t._publish(old.schema, [], v)
        conflict = False
    except dml.Conflict:
        conflict = True
    return old.agg(F.count("*").alias("before")).join(F.broadcast(db.read("t").agg(F.count("*").alias("after")))).withColumn("conflict", F.lit(conflict))  # one row each


@frame(f"{ORDERS} WHERE o_orderstatus <> 'F'")
def I14_full_refresh(s, d):
    return loaded(s, d, base(s, d).withColumn("old", F.lit(1)), (base(s, d).where("o_orderstatus <> 'F'"), {"strategy": "merge", "primary_key": ("o_orderkey",), "full_refresh": True})).read("t")


def drifted(s, d):
    """Orders whose status is a number now, with a note, without the customer, and a wider key."""
    b = load(s, d, "orders")
    target = b.select(F.col("o_orderkey").cast("int"), "o_custkey", F.ascii("o_orderstatus").alias("code"))
    source = b.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "x").otherwise(F.ascii("o_orderstatus").cast("string")).alias("code"), F.when(F.col("o_totalprice") > 100000, "dear").alias("note"))
    return target, source


@frame("SELECT * FROM (VALUES ('added', 'note'), ('removed', 'o_custkey'), ('widened', 'o_orderkey'), ('incompatible', 'code')) t(kind, name)")
def I15_schema_drift(s, d):
    t, src = drifted(s, d)
    return s.createDataFrame([(k, c) for k, v in ingest.compare(t.schema, src.schema).items() for c in v], "kind string, name string")


@frame("SELECT * FROM (VALUES ('ALTER TABLE t ADD COLUMN note string'), ('ALTER TABLE t DROP COLUMN o_custkey'), ('ALTER TABLE t ALTER COLUMN o_orderkey TYPE bigint'), ('ALTER TABLE t ALTER COLUMN code TYPE string')) t(step)")
def I16_evolution(s, d):
    t, src = drifted(s, d)
    return s.createDataFrame([(c.sql("t"),) for c in ingest.evolution(t.schema, src.schema)], "step string")


@frame("SELECT 'discard_row' AS contract, count(*) FILTER (o_orderstatus <> 'P' AND NOT o_totalprice > 100000) AS n, count(*) FILTER (o_orderstatus <> 'P' AND NOT o_totalprice > 100000) AS codes, 3::BIGINT AS columns FROM orders UNION ALL SELECT 'discard_value', count(*), count(*) FILTER (o_orderstatus <> 'P'), 3 FROM orders UNION ALL SELECT 'evolve', count(*), count(*), 3 FROM orders UNION ALL SELECT 'freeze', 0, 0, 0")
def I17_contracts(s, d):
    out = s.createDataFrame([("freeze", 0, 0, 0)], "contract string, n bigint, codes bigint, columns bigint")
    for c in ("evolve", "discard_row", "discard_value"):
        _, fit = ingest.align(*drifted(s, d), c)
        out = out.unionByName(fit.agg(F.lit(c).alias("contract"), F.count("*").alias("n"), F.count("code").alias("codes"), F.lit(len(fit.columns)).cast("long").alias("columns")))
    try:
        ingest.align(*drifted(s, d), "freeze")
    except ValueError:
        return out
    raise AssertionError("a drift passed the freeze")


@frame("SELECT n_nationkey AS \"NationKey\", n_name AS nation_name, n_regionkey AS region_key FROM nation")
def I18_naming(s, d):
    """auto takes the names that the target has already."""
    odd = load(s, d, "nation").toDF("NationKey", "nationName", "region key")
    assert ingest.naming(odd, "snake_case").columns == ["nation_key", "nation_name", "region_key"]
    assert ingest.naming(odd, "direct").columns == ingest.naming(odd, "auto").columns == odd.columns
    return ingest.naming(odd, "auto", ["nation_name", "region_key", "NationKey"])


fixed("I19_infer_records", "name string, type string, nullable boolean", lambda: [(f.name, f.dataType.simpleString(), f.nullable) for f in ingest.infer_records([{"a": 1, "b": 1, "c": 1, "d": {"x": 1}}, {"a": 2, "b": 1.5, "c": "x", "e": True}])], [("a", "bigint", False), ("b", "double", False), ("c", "string", False), ("d", "string", True), ("e", "boolean", True)])


@frame("SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::INT AS customer, o_orderstatus FROM orders")
def I20_explicit_columns(s, d):
    return ingest.explicit(base(s, d), "o_orderkey:text,customer:integer:o_custkey").select("o_orderkey", "customer", "o_orderstatus")


@frame("SELECT count(*) AS n, true AS dated, 'memory://x' AS uri, 'src' AS source_table FROM orders")
def I21_metadata(s, d):
    db = Database(s, scratch(s, "db"))
    ingest.run(s, P("memory://x", "src", "memory://y", "t"), db, {"src": base(s, d)})
    return db.read("t").agg(F.count("*").alias("n"), F.bool_and(F.col("_loaded_at").isNotNull()).alias("dated"), F.max("_source_uri").alias("uri"), F.max("_source_table").alias("source_table"))


@frame("SELECT c_custkey, CASE WHEN length(c_name) > 4 THEN repeat('*', length(c_name) - 4) ELSE '' END || right(c_name, 4) AS last, CASE WHEN length(c_name) > 6 THEN left(c_name, 3) || repeat('*', length(c_name) - 6) || right(c_name, 3) ELSE c_name END AS ends FROM customer")
def I23_mask_partial(s, d):
    c = load(s, d, "customer").select("c_custkey", F.col("c_name").alias("last"), F.col("c_name").alias("ends"))
    return ingest.mask(c, "last:partial:4", "ends:both:3")


@frame("SELECT p_partkey, (round(p_retailprice / 50) * 50)::DOUBLE AS p_retailprice FROM part")
def I24_mask_round(s, d):
    return ingest.mask(load(s, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice:round:50")


@frame("SELECT c_custkey, '***REDACTED***' AS c_name, NULL::DOUBLE AS c_acctbal FROM customer")
def I25_mask_redact(s, d):
    return ingest.mask(load(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_name:redact", "c_acctbal:nullify")


@frame("SELECT c_custkey, sha256(repeat('*', length(c_name) - 2) || right(c_name, 2)) AS c_name FROM customer")
def I26_mask_specs(s, d):
    """Specs apply one after another, also to one column."""
    return ingest.mask(load(s, d, "customer").select("c_custkey", "c_name"), "c_name:partial:2", "c_name:hash")


@frame("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def I27_layout(s, d):
    """A destination partitioned by one column and sorted by another."""
    db = Database(s, scratch(s, "db"))
    ingest.run(s, P("memory://x", "src", "memory://y", "t", partition_by="o_orderstatus", cluster_by=("o_custkey",), metadata=False), db, {"src": base(s, d)})
    return db.read("t").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


fixed("I28_extract_settings", "key string, value string", lambda: [(k, v) for k, v in sorted(uris.jdbc_options("mysql://h/db", table="t", parallelism=4, page_size=10_000, partition_column="id", bounds=(1, 9)).items()) if k in ("numPartitions", "fetchsize")], [("fetchsize", "10000"), ("numPartitions", "4")])


@frame("SELECT count(*) AS n, true AS bounded FROM orders")
def I29_file_size(s, d):
    """No file of more than 1000 rows."""
    path = scratch(s, "files")
    copying.write_parquet(base(s, d), path, records_per_file=1000)
    per = s.read.parquet(path).select(F.input_file_name().alias("f")).groupBy("f").agg(F.count("*").alias("k"))
    return per.agg(F.sum("k").alias("n"), (F.max("k") <= 1000).alias("bounded"))


@frame("SELECT 'a' AS dest, 'success' AS state, count(*) AS rows FROM orders UNION ALL SELECT 'b', 'success', count(*) FROM customer UNION ALL SELECT 'c', 'failed', 0")
def I31_many_tables(s, d):
    db = Database(s, scratch(s, "db"))
    plans = [P("memory://x", "orders", "memory://y", "a"), P("memory://x", "customer", "memory://y", "b"), P("nothing://x", "missing", "memory://y", "c")]
    return ingest.run_all(s, plans, db, {"orders": load(s, d, "orders"), "customer": load(s, d, "customer")}).select(F.col("table").alias("dest"), "state", "rows")


def flaky(fails):
    calls = []

    def run():
        calls.append(1)
        if len(calls) <= fails:
            raise OSError("not yet")
        return len(calls)

    try:
        return ingest.retried(run)
    except OSError:
        return -len(calls)


fixed("I35_retry", "failures bigint, outcome bigint", lambda: [(n, flaky(n)) for n in range(5)], [(0, 1), (1, 2), (2, 3), (3, -3), (4, -3)])


@frame("SELECT * FROM (SELECT 'append' AS strategy, count(*) * 3 AS n FROM orders UNION ALL SELECT 'delete+insert', count(*) FROM orders UNION ALL SELECT 'merge', count(*) FROM orders UNION ALL SELECT 'replace', count(*) FROM orders)")
def I37_reruns(s, d):
    """Each strategy run twice over a loaded table: only append adds rows again."""
    out = None
    for name, more in (("replace", {}), ("merge", {"primary_key": ("o_orderkey",)}), ("append", {"incremental_key": "o_orderkey", "interval_start": -1, "interval_end": 1 << 60}), ("delete+insert", {"incremental_key": "o_orderkey"})):
        plan = (base(s, d), {"strategy": name} | more)
        n = loaded(s, d, base(s, d), plan, plan).read("t").agg(F.lit(name).alias("strategy"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


# ---- streams ----
@frame("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def T01_micro_batches(s, d):
    """A stream of files that is read up in bounded micro-batches."""
    path, out, ck = scratch(s, "in"), scratch(s, "out"), scratch(s, "ck")
    e = load(s, d, "events").select("event_id", "event_type")
    e.repartition(6).write.parquet(path)
    q = feeds.files(s, path, e.schema, per_trigger=2).writeStream.format("parquet").option("checkpointLocation", ck).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(e.schema).parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


fixed("T02_stream_sources", "scheme string, how string", lambda: [(x, refused(f"{x}://h/topic")) for x in ("kafka", "kinesis")], [("kafka", "connector"), ("kinesis", "connector")])


@frame("SELECT event_id, event_type FROM events")
def T03_new_files(s, d):
    """Files that come between two runs are picked up once."""
    path, out, ck = scratch(s, "in"), scratch(s, "out"), scratch(s, "ck")
    e = load(s, d, "events").select("event_id", "event_type")
    for part in (e.where("event_type = 'click'"), e.where("event_type <> 'click' OR event_type IS NULL")):
        part.write.mode("append").parquet(path)
        for _ in range(2):
            feeds.files(s, path, e.schema).writeStream.format("parquet").option("checkpointLocation", ck).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(e.schema).parquet(out)


@frame("SELECT user_id AS id, event_id AS v FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'")
def T04_resume(s, d):
    """A change feed followed in two parts, the later operations first and one part again: the LSN decides, not the order of arrival."""
    path, ck = scratch(s, "feed"), scratch(s, "ck")
    e = load(s, d, "events").select(F.when(F.col("event_type") == "error", "D").otherwise("U").alias("op"), F.col("event_id").alias("lsn"), F.col("user_id").alias("id"), F.col("event_id").alias("v"))
    table = dml.Table(s, scratch(s, "t"))
    middle = e.agg((F.max("lsn") / 2).alias("m"))
    for part in ("lsn >= m", "lsn < m", "lsn >= m"):
        e.join(F.broadcast(middle)).where(part).drop("m").write.mode("append").parquet(path)  # one row
        feeds.follow(feeds.files(s, path, e.schema), table, ["id"], ck)
    feeds.compact(table, ["id"])
    return feeds.current(table, ["id"])
