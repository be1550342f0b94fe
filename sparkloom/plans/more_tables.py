"""Sources, sinks, databases and statements, each on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dialect as X
from ..functions import relation
from ..operators import dml
from ..session import TABLES, load, scratch
from ..sources import catalog, copying, uris
from ..sources.databases import Attached, CatalogError, Database
from .catalogue import frame

ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"


def base(s, d):
    return load(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


# ---- reading ----
@frame("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def S01_csv_auto(s, d):
    path = scratch(s, "csv")
    uris.write(load(s, d, "nation"), f"csv://{path}")
    return uris.read(s, f"csv://{path}")


@frame("SELECT p_partkey, nullif(p_brand, 'Brand#11') AS p_brand, p_retailprice FROM part")
def S02_csv_options(s, d):
    path = scratch(s, "csv")
    load(s, d, "part").select("p_partkey", "p_brand", "p_retailprice").write.options(sep=";", header=True).csv(path)
    return copying.read_csv(s, path, HEADER=True, DELIM=";", NULLSTR="Brand#11", COLUMNS={"p_partkey": "bigint", "p_brand": "string", "p_retailprice": "double"})


@frame("SELECT n_nationkey, coalesce(nullif(n_name, 'FRANCE'), '') AS n_name FROM nation")
def S03_copy_options(s, d):
    """Two lines of preamble skipped, a quote of its own, a null text, and a column that may not be null."""
    path = scratch(s, "csv")
    rows = load(s, d, "nation").select(F.concat_ws("|", F.col("n_nationkey").cast("string"), F.concat(F.lit("'"), "n_name", F.lit("'"))).alias("value"), "n_nationkey")
    head = s.createDataFrame([("made by hand", -3), ("second line", -2), ("n_nationkey|n_name", -1)], "value string, n_nationkey int")
    head.unionByName(rows).orderBy("n_nationkey").coalesce(1).select("value").write.text(path)
    return copying.read_csv(s, path, SKIP=2, HEADER=True, DELIMITER="|", QUOTE="'", NULL="FRANCE", FORCE_NOT_NULL=["n_name"], COLUMNS={"n_nationkey": "int", "n_name": "string"})


@frame("SELECT event_id, user_id FROM events WHERE value > 50")
def S04_parquet_pruned(s, d):
    """Two columns and one pushed filter reach the scan."""
    return load(s, d, "events").where("value > 50").select("event_id", "user_id")


@frame("SELECT r_regionkey, r_name, 'array' AS kind FROM region UNION ALL SELECT r_regionkey, r_name, 'lines' FROM region")
def S05_json(s, d):
    out = []
    for kind in ("array", "lines"):
        path = scratch(s, "json")
        copying.write_json(load(s, d, "region"), path, array=kind == "array")
        out.append(s.read.schema("r_regionkey int, r_name string").option("multiLine", kind == "array").json(path).withColumn("kind", F.lit(kind)))
    return out[0].unionByName(out[1])


@frame("SELECT s_suppkey, s_name FROM supplier")
def S06_glob(s, d):
    path = scratch(s, "glob")
    t = load(s, d, "supplier").select("s_suppkey", "s_name")
    for i, part in enumerate((t.where("s_nationkey < 12"), t.where("s_nationkey >= 12 OR s_nationkey IS NULL"))):
        part.write.csv(f"{path}/logs-2024-{i}/part", header=True)
    return s.read.schema("s_suppkey bigint, s_name string").csv(f"{path}/logs-2024-*/part", header=True)


@frame("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def S07_partition_pruning(s, d):
    path = scratch(s, "parts")
    copying.write_parquet(load(s, d, "orders").select("o_orderkey", "o_orderstatus"), path, partition_by=["o_orderstatus"])
    return s.read.parquet(path).where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")


@frame(f"{ORDERS} UNION ALL {ORDERS}")
def S08_copy_from(s, d):
    """Bulk load of a file into a table that has rows."""
    path, db = scratch(s, "csv"), Database(s, scratch(s, "db"))
    copying.write_csv(base(s, d), path)
    db.create_as("t", base(s, d))
    db.insert("t", copying.read_csv(s, path, COLUMNS={"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double"}))
    return db.read("t")


@frame("SELECT c_custkey, c_mktsegment FROM customer")
def S09_copy_to_csv(s, d):
    path = scratch(s, "csv")
    copying.write_csv(load(s, d, "customer").select("c_custkey", "c_mktsegment"), path, DELIMITER="\t", COMPRESSION="gzip")
    return copying.read_csv(s, path, DELIMITER="\t", COLUMNS={"c_custkey": "bigint", "c_mktsegment": "string"})


@frame("SELECT 'zstd' AS codec, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem UNION ALL SELECT 'snappy', count(*), sum(l_linenumber)::BIGINT FROM lineitem")
def S10_copy_to_parquet(s, d):
    out = []
    for codec in ("zstd", "snappy"):
        path = scratch(s, "parquet")
        copying.write_parquet(load(s, d, "lineitem").select("l_orderkey", "l_linenumber"), path, codec=codec, records_per_file=100_000)
        out.append(s.read.parquet(path).agg(F.lit(codec).alias("codec"), F.count("*").alias("n"), F.sum("l_linenumber").alias("lines")))
    return out[0].unionByName(out[1])


@frame("SELECT event_id, event_type, value FROM events")
def S11_copy_to_json(s, d):
    path = scratch(s, "json")
    copying.write_json(load(s, d, "events").select("event_id", "event_type", "value"), path)
    return s.read.schema("event_id bigint, event_type string, value double").json(path)


@frame("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def S12_copy_query(s, d):
    path = scratch(s, "query")
    copying.copy_query(s, "SELECT o_orderstatus, count(*) AS n FROM {o} GROUP BY o_orderstatus", path, o=load(s, d, "orders"))
    return s.read.parquet(path)


@frame("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL")
def S13_partitioned_export(s, d):
    path = scratch(s, "parts")
    copying.write_parquet(load(s, d, "customer"), path, partition_by=["c_mktsegment", "c_nationkey"], cluster_by=["c_custkey"])
    return s.read.parquet(path).groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


def two(s, d):
    a, b = Database(s, scratch(s, "a")), Database(s, scratch(s, "b"))
    a.create_as("orders", load(s, d, "orders"))
    a.create_as("nation", load(s, d, "nation"))
    b.create_as("customer", load(s, d, "customer"))
    return a, b


@frame("SELECT 'nation' AS name, (SELECT count(*) FROM nation) AS n, 0::BIGINT AS schema_only UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), 0")
def S14_copy_database(s, d):
    a, _ = two(s, d)
    whole, bare = Database(s, scratch(s, "w")), Database(s, scratch(s, "s"))
    x, y = a.copy_to(whole), a.copy_to(bare, schema_only=True)
    return s.createDataFrame([(n, x[n], y[n]) for n in x], "name string, n bigint, schema_only bigint")


@frame("SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def S15_attach(s, d):
    a, b = two(s, d)
    return Attached(s).attach("sales", a).attach("crm", b).sql("SELECT n_name, count(*) AS n FROM sales.orders JOIN crm.customer ON o_custkey = c_custkey JOIN sales.nation ON c_nationkey = n_nationkey GROUP BY n_name")


@frame("SELECT * FROM (VALUES ('postgres', 'jdbc'), ('mysql', 'jdbc'), ('sqlite', 'jdbc'), ('s3', 'store'), ('iceberg', 'connector')) t(scheme, kind)")
def S16_remote_attach(s, d):
    """How a remote database would be reached; drivers and connectors come with the session's class path."""
    return s.createDataFrame([(k, uris.kind(k)) for k in ("postgres", "mysql", "sqlite", "s3", "iceberg")], "scheme string, kind string")


@frame("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def S17_export_import(s, d):
    a, _ = two(s, d)
    path, b = scratch(s, "export"), Database(s, scratch(s, "b"))
    a.export(path)
    assert b.load(path) == ["nation", "orders"]
    return b.read("nation")


@frame("SELECT n_name, label FROM nation JOIN (VALUES (0, 'x'), (3, 'y')) t(k, label) ON n_regionkey = k")
def S18_register_frame(s, d):
    import pandas as pd

    att = Attached(s).register("mine", s.createDataFrame(pd.DataFrame({"k": [0, 3], "label": ["x", "y"]}))).register("nation", load(s, d, "nation"))
    return att.sql("SELECT n_name, label FROM nation JOIN mine ON n_regionkey = k")


@frame("SELECT sink, count(*) AS n, sum(r_regionkey)::BIGINT AS keys FROM region, (VALUES ('all'), ('arrow'), ('column'), ('pandas')) t(sink) GROUP BY sink")
def S19_result_sinks(s, d):
    out = copying.sinks(load(s, d, "region").select("r_regionkey"))
    keys = {"all": [r[0] for r in out["all"]], "column": out["column"], "pandas": out["pandas"]["r_regionkey"].tolist(), "arrow": out["arrow"].column(0).to_pylist()}
    return s.createDataFrame([(k, len(v), sum(map(int, v))) for k, v in keys.items()], "sink string, n bigint, keys bigint")


@frame("SELECT (i // 1000)::BIGINT AS batch, count(*) AS n FROM (SELECT row_number() OVER () - 1 AS i FROM orders) GROUP BY 1")
def S20_result_batches(s, d):
    sizes = [len(b) for b in copying.batches(load(s, d, "orders").select("o_orderkey"), 1000)]
    return s.createDataFrame(list(enumerate(sizes)), "batch bigint, n bigint")


@frame("SELECT c_mktsegment, count(DISTINCT event_id) AS events FROM customer JOIN events ON user_id = c_custkey GROUP BY c_mktsegment")
def S21_federated(s, d):
    """One query over a CSV file, a Parquet file and a database."""
    path, db = scratch(s, "csv"), Database(s, scratch(s, "db"))
    copying.write_csv(load(s, d, "customer").select("c_custkey", "c_mktsegment"), path)
    db.create_as("events", load(s, d, "events"))
    att = Attached(s).attach("live", db).register("customer", copying.read_csv(s, path))
    return att.sql("SELECT c_mktsegment, count(DISTINCT event_id) AS events FROM customer JOIN live.events ON user_id = c_custkey GROUP BY c_mktsegment")


@frame("SELECT count(*) AS n, true AS refused FROM nation")
def S22_read_only(s, d):
    path = scratch(s, "db")
    Database(s, path).create_as("nation", load(s, d, "nation"))
    again = Database(s, path, read_only=True)
    try:
        again.truncate("nation")
        refused = False
    except PermissionError:
        refused = True
    return again.read("nation").agg(F.count("*").alias("n"), F.lit(refused).alias("refused"))


@frame("SELECT count(*) AS n, 1::BIGINT AS files, true AS dated FROM part")
def S34_file_metadata(s, d):
    df = copying.with_metadata(s, f"{d}/part.parquet")
    return df.agg(F.count("*").alias("n"), F.count_distinct("file_name").alias("files"), F.bool_and(F.col("file_modification_time").isNotNull() & (F.col("file_size") > 0)).alias("dated"))


@frame("SELECT 'file' AS scheme, count(*) AS n FROM region UNION ALL SELECT 'parquet', count(*) FROM region")
def S35_local_files(s, d):
    path = scratch(s, "parquet")
    uris.write(load(s, d, "region"), f"parquet://{path}")
    out = [uris.read(s, u).agg(F.lit(n).alias("scheme"), F.count("*").alias("n")) for n, u in (("file", f"parquet://{path}#parquet"), ("parquet", f"parquet://{path}"))]
    return out[0].unionByName(out[1])


@frame("SELECT 'memory' AS kind, count(*) AS n FROM supplier")
def S45_memory_table(s, d):
    """A table that is kept in executors' memory for a session."""
    t = load(s, d, "supplier").persist()
    return t.agg(F.lit("memory").alias("kind"), F.count("*").alias("n"))


@frame(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in sorted(TABLES)))
def S47_asset_inventory(s, d):
    return catalog.assets({t: load(s, d, t) for t in sorted(TABLES)}).select("table_name", "n_rows")


@frame("SELECT * FROM (VALUES ('l_returnflag'), ('l_linestatus')) t(name)")
def S48_enum_columns(s, d):
    from ..operators import aggs

    return s.createDataFrame([(c,) for c in aggs.enum_columns(load(s, d, "lineitem"))], "name string")


# ---- the catalogue of data sources ----
def sources(s, d):
    """Suppliers as data sources."""
    t = catalog.Sources(dml.Table(s, scratch(s, "sources")))
    kind = F.when(F.col("s_acctbal") > 5000, "postgres").when(F.col("s_acctbal") > 0, "mysql").otherwise("mssql")
    u = load(s, d, "supplier")
    t.add(u.select(F.col("s_name").alias("source_code"), F.concat(F.lit("Source "), "s_name").alias("source_name"), kind.alias("db_type"), F.lit("h").alias("host"), F.lit(5432).alias("port"), F.lit("pw").alias("password"), F.when(F.col("s_nationkey") < 10, "prod").otherwise("test").alias("environment")))
    return t


KIND = "SELECT s_name AS source_code, CASE WHEN s_acctbal > 5000 THEN 'postgres' WHEN s_acctbal > 0 THEN 'mysql' ELSE 'mssql' END AS db_type, CASE WHEN s_nationkey < 10 THEN 'prod' ELSE 'test' END AS environment, row_number() OVER (ORDER BY s_name) AS id FROM supplier"


@frame(f"SELECT id, source_code, db_type, 1 AS status, 'utf8mb4' AS charset FROM ({KIND})")
def S39_source_add(s, d):
    return sources(s, d).list().select("id", "source_code", "db_type", "status", "charset")


@frame(f"SELECT id, source_code FROM ({KIND}) WHERE db_type = 'mysql' AND environment = 'prod' ORDER BY id")
def S40_source_filters(s, d):
    return sources(s, d).list(db_type="mysql", status=1, environment="prod").select("id", "source_code")


@frame(f"SELECT id, source_code FROM ({KIND}) WHERE lower('Source ' || source_code) LIKE '%1%' OR lower(source_code) LIKE '%1%' ORDER BY id")
def S41_source_search(s, d):
    return sources(s, d).search("1").select("id", "source_code")


@frame(f"SELECT db_type, environment, count(*) AS n FROM ({KIND}) GROUP BY ALL ORDER BY n DESC, db_type, environment")
def S42_source_count(s, d):
    return sources(s, d).count(["db_type", "environment"])


@frame(f"SELECT CASE WHEN id = 1 THEN 0 WHEN id = 2 THEN 2 ELSE 1 END AS status, count(*) AS n FROM ({KIND}) WHERE id <> 3 GROUP BY 1")
def S43_source_delete(s, d):
    """The first is deleted softly, the second changes its status, the third goes."""
    t = sources(s, d)
    a, b, c = (r.source_code for r in t.list().limit(3).collect())
    t.delete(a)
    t.status(b, 2)
    t.delete(c, hard=True)
    return t.table.read().groupBy("status").agg(F.count("*").alias("n"))


@frame(f"SELECT source_code, '******' AS password, 'pw' AS revealed FROM ({KIND}) WHERE id = 1")
def S44_secret_mask(s, d):
    t = sources(s, d)
    code = t.list().first().source_code
    return t.show(code).select("source_code", "password").join(t.show(code, reveal=True).select("source_code", F.col("password").alias("revealed")), "source_code")


# ---- statements ----
@frame(f"{ORDERS} WHERE o_totalprice > 1000")
def X01_create(s, d):
    db = Database(s, scratch(s, "db"))
    db.create("t", "o_orderkey bigint, o_custkey bigint, o_totalprice double")
    db.create("t", "other int", if_not_exists=True)
    try:
        db.create("t", "other int")
        raise AssertionError("a second table of the name")
    except CatalogError:
        pass
    db.create("t", "o_orderkey bigint, o_custkey bigint, o_totalprice double", replace=True)
    db.insert("t", base(s, d).where("o_totalprice > 1000"))
    return db.read("t")


@frame("SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey")
def X02_create_as(s, d):
    db = Database(s, scratch(s, "db"))
    db.create_as("t", load(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top")))
    return db.read("t")


@frame("SELECT o_orderkey, o_custkey, 0.0::DOUBLE AS o_totalprice, 'new' AS state FROM orders UNION ALL SELECT 1, NULL, 2.5, 'new' UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, 'all' FROM orders")
def X03_insert(s, d):
    """To named columns with a default, as values, and a whole query by place."""
    db = Database(s, scratch(s, "db"))
    db.create("t", "o_orderkey bigint, o_custkey bigint, o_totalprice double, state string")
    b = base(s, d)
    db.insert("t", b.select("o_custkey", "o_orderkey"), columns=["o_custkey", "o_orderkey"], defaults={"o_totalprice": F.lit(0.0), "state": F.lit("new")})
    db.insert("t", s.createDataFrame([(1, 2.5)], "a bigint, b double"), columns=["o_orderkey", "o_totalprice"], defaults={"state": F.lit("new")})
    db.insert("t", b.withColumn("state", F.lit("all")))
    return db.read("t")


@frame("SELECT o_orderkey, o_custkey, NULL::DOUBLE AS o_totalprice FROM orders")
def X04_insert_by_name(s, d):
    db = Database(s, scratch(s, "db"))
    db.create("t", "o_orderkey bigint, o_custkey bigint, o_totalprice double")
    db.insert("t", base(s, d).select("o_custkey", "o_orderkey"), by_name=True)
    return db.read("t")


@frame(f"SELECT 'deleted' AS verb, * FROM ({ORDERS}) WHERE o_custkey < 50 UNION ALL SELECT 'updated', o_orderkey, o_custkey, 0.0 FROM orders WHERE o_custkey >= 50 AND o_totalprice < 2000 UNION ALL SELECT 'inserted', * FROM ({ORDERS}) WHERE o_custkey < 50")
def X07_returning(s, d):
    """What each verb returns."""
    db = Database(s, scratch(s, "db"))
    db.create_as("t", base(s, d))
    gone = db.delete("t", F.col("o_custkey") < 50).withColumn("verb", F.lit("deleted"))
    changed = db.update("t", {"o_totalprice": F.lit(0.0)}, F.col("o_totalprice") < 2000).withColumn("verb", F.lit("updated"))
    back = db.insert("t", base(s, d).where("o_custkey < 50")).withColumn("verb", F.lit("inserted"))
    return gone.unionByName(changed).unionByName(back)


@frame(f"SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice FROM ({ORDERS}) WHERE o_custkey >= 50")
def X11_transaction(s, d):
    """Two steps as one commit; a failing one leaves the table; a rollback brings an older version back, and forward again."""
    db = Database(s, scratch(s, "db"))
    db.create_as("t", base(s, d))
    try:
        db.transaction("t", [lambda t: t.where("o_custkey >= 50"), lambda t: t.select("no_such_column")])
        raise AssertionError("a failing step went through")
    except AssertionError:
        raise
    except Exception:  # the step's own error
        if db.table("t").version() != 0:
            raise
    v = db.transaction("t", [lambda t: t.where("o_custkey >= 50"), lambda t: t.withColumn("o_totalprice", F.col("o_totalprice") + 1)])
    db.table("t").rollback(0)
    db.table("t").rollback(v)
    return db.read("t")


@frame("SELECT o_custkey, round(sum(price::DECIMAL(18,2) * 2)::DOUBLE, 2) AS s FROM (SELECT o_custkey, o_totalprice AS price FROM orders) GROUP BY o_custkey")
def X13_views_macros(s, d):
    """A view over a table and a macro over its column."""
    load(s, d, "orders").select("o_custkey", F.col("o_totalprice").alias("price")).createOrReplaceTempView("loom_prices")
    s.sql("CREATE OR REPLACE TEMPORARY FUNCTION loom_twice(x DECIMAL(18,2)) RETURNS DECIMAL(20,2) RETURN x * 2")
    return s.sql("SELECT o_custkey, round(CAST(sum(loom_twice(CAST(price AS DECIMAL(18,2)))) AS DOUBLE), 2) AS s FROM loom_prices GROUP BY o_custkey")


@frame("SELECT * FROM (SELECT 'key' AS rule, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)) AS n UNION ALL SELECT 'not_null:l_shipdate', (SELECT count(*) FROM lineitem WHERE l_shipdate IS NULL) UNION ALL SELECT 'check', (SELECT count(*) FROM lineitem WHERE NOT l_quantity < 30) UNION ALL SELECT 'foreign', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')))")
def X14_constraints(s, d):
    found = dml.violations(load(s, d, "lineitem"), key=["l_orderkey"], not_null=["l_shipdate"], check=F.col("l_quantity") < 30, foreign=(load(s, d, "orders").where("o_orderstatus = 'F'"), "l_orderkey", "o_orderkey"))
    return s.createDataFrame(list(found.items()), "rule string, n bigint")


@frame("SELECT 'F' AS status, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'O', count(*) FROM orders WHERE o_orderstatus = 'O'")
def X15_prepared(s, d):
    """One statement run with several parameters, as one query over the parameter rows."""
    q = relation.Prepared("SELECT :status AS status, count(*) AS n FROM orders WHERE o_orderstatus = :status", orders=load(s, d, "orders"))
    return q.execute_many([{"status": "F"}, {"status": "O"}])


@frame("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")
def X16_template(s, d):
    return relation.template(s, "status_counts", {"least": 1000}, orders=load(s, d, "orders"))


@frame("SELECT '9' AS during, true AS restored, 2::BIGINT AS swept, count(*) AS n FROM nation")
def X18_maintenance(s, d):
    """SET and RESET of a session key, and VACUUM of a table's old versions."""
    key = "spark.sql.shuffle.partitions"
    before = s.conf.get(key)
    with relation.setting(s, key, "9"):
        during = s.conf.get(key)
    db = Database(s, scratch(s, "db"))
    for _ in range(3):
        db.create_as("t", load(s, d, "nation"), replace=True)
    swept = db.table("t").sweep()
    return db.read("t").agg(F.lit(during).alias("during"), F.lit(s.conf.get(key) == before).alias("restored"), F.lit(swept).cast("long").alias("swept"), F.count("*").alias("n"))


@frame("SELECT o_orderkey AS id, o_totalprice::DECIMAL(18,2) AS o_totalprice, NULL::VARCHAR AS note FROM orders")
def X19_alter(s, d):
    db = Database(s, scratch(s, "db"))
    db.create_as("t", base(s, d))
    db.alter("t", add={"note": "string"}, drop=["o_custkey"], rename={"o_orderkey": "id"}, retype={"o_totalprice": "decimal(18,2)"})
    db.create_as("u", base(s, d))
    db.truncate("u")
    assert db.read("u").count() == 0
    db.drop("u")
    assert db.tables() == ["t"]
    return db.read("t")


# ---- functions, plans and results ----
@frame("SELECT p_partkey, CASE WHEN p_retailprice > 1500 THEN 'high' WHEN p_retailprice > 1000 THEN 'mid' ELSE 'low' END AS band FROM part")
def Y01_scalar_udf(s, d):
    relation.register_batch(s, "loom_band", lambda p: ["high" if x > 1500 else "mid" if x > 1000 else "low" for x in p], "string")
    return load(s, d, "part").selectExpr("p_partkey", "loom_band(p_retailprice) AS band")


@frame("SELECT p_brand, round(exp(avg(ln(p_retailprice))), 6) AS g FROM part GROUP BY p_brand")
def Y02_aggregate_udf(s, d):
    """The geometric mean: an aggregate of one's own, composed of those that combine before the shuffle."""
    return load(s, d, "part").groupBy("p_brand").agg(F.round(relation.geometric_mean(F.col("p_retailprice")), 6).alias("g"))


@frame("SELECT p_partkey, i::INT AS i, w FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)")
def Y03_table_function(s, d):
    relation.register_words(s)
    load(s, d, "part").createOrReplaceTempView("loom_part")
    return s.sql("SELECT p_partkey, t.i, t.w FROM loom_part, LATERAL loom_words(p_name) t")


@frame("SELECT o_orderkey, greatest(0, least(o_totalprice, 100000)) AS c FROM orders")
def Y04_macro(s, d):
    s.sql("CREATE OR REPLACE TEMPORARY FUNCTION loom_clamp(x DOUBLE, lo DOUBLE, hi DOUBLE) RETURNS DOUBLE RETURN greatest(lo, least(x, hi))")
    return load(s, d, "orders").selectExpr("o_orderkey", "loom_clamp(o_totalprice, 0, 100000) AS c")


@frame("SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 5000 GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
def Y05_relation(s, d):
    return relation.Relation(load(s, d, "orders")).filter("o_totalprice > 5000").aggregate("o_custkey, count(*) AS n", "o_custkey").order("n DESC, o_custkey").limit(10).df


@frame("SELECT true AS scan, true AS filter, true AS pushed, true AS json")
def Y06_explain(s, d):
    """The plan as text and as JSON: the scan, the filter, and the filter's way into the scan."""
    p = relation.explain(load(s, d, "orders").where("o_orderkey > 5").select("o_orderkey"))
    return s.createDataFrame([("Scan" in p["text"], "Filter" in p["text"], "PushedFilters" in p["text"] and "GreaterThan(o_orderkey,5)" in p["text"], bool(p["json"]))], "scan boolean, filter boolean, pushed boolean, json boolean")


@frame("SELECT count(*) AS n, true AS timed, 'SELECT * FROM orders WHERE o_orde' AS sql FROM orders WHERE o_orderkey > 9")
def Y07_timed(s, d):
    load(s, d, "orders").createOrReplaceTempView("orders")
    r = relation.timed(s, "SELECT * FROM orders WHERE o_orderkey > 9", prefix=33)
    return s.createDataFrame([(r["rows"], r["seconds"] > 0, r["sql"])], "n bigint, timed boolean, sql string")


@frame("SELECT count(*) AS n, 2::BIGINT AS misses, 2::BIGINT AS hits FROM orders")
def Y08_cache(s, d):
    """Five minutes' buckets: the same question is answered from the cache until the bucket changes."""
    load(s, d, "orders").createOrReplaceTempView("orders")
    clock = [0.0]
    cache = relation.ResultCache(s, size=128, seconds=300, now=lambda: clock[0])
    sql = "SELECT count(*) AS n FROM orders"
    for t in (1, 2, 299, 301):
        clock[0] = t
        n = cache.rows(sql)[0].n
    return s.createDataFrame([(n, cache.misses, cache.hits)], "n bigint, misses bigint, hits bigint")


@frame("SELECT * FROM (VALUES ('SELEC 1', 'parser'), ('SELECT * FROM no_such_table', 'catalog'), ('SELECT no_such_column FROM orders', 'binder'), ('SELECT raise_error(''x'')', 'runtime'), ('SELECT * FROM parquet.`/no/such/file`', 'io')) t(sql, kind)")
def Y09_errors(s, d):
    load(s, d, "orders").createOrReplaceTempView("orders")
    texts = ("SELEC 1", "SELECT * FROM no_such_table", "SELECT no_such_column FROM orders", "SELECT raise_error('x')", "SELECT * FROM parquet.`/no/such/file`")
    return s.createDataFrame([(t, relation.kind_of_error(lambda t=t: s.sql(t).collect())) for t in texts], "sql string, kind string")


@frame("SELECT 'UTC' AS zone, 'true' AS adaptive, 'true' AS skew")
def Y10_session(s, d):
    from ..session import session

    made = session()
    return s.createDataFrame([tuple(made.conf.get(f"spark.sql.{k}") for k in ("session.timeZone", "adaptive.enabled", "adaptive.skewJoin.enabled"))], "zone string, adaptive string, skew string")


@frame("SELECT 'calendar' AS chart, strftime(o_orderdate, '%Y-%m-%d') AS x, NULL AS y, count(*)::DOUBLE AS v FROM orders GROUP BY ALL UNION ALL SELECT 'flow', a, b, count(*)::DOUBLE FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL GROUP BY a, b UNION ALL SELECT 'share', c_mktsegment, NULL, count(*)::DOUBLE FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'correlation', 'p_size', 'p_retailprice', round(corr(p_size, p_retailprice), 8) FROM part")
def Y11_chart_feeds(s, d):
    """What charts are drawn from: a calendar, transitions between steps, shares, a correlation."""
    return relation.charts(load(s, d, "orders"), load(s, d, "events"), load(s, d, "customer"), load(s, d, "part"))


@frame("SELECT 'json' AS kind, count(*) AS lines FROM (SELECT DISTINCT o_orderstatus FROM orders) UNION ALL SELECT 'markdown', count(*) + 2 FROM (SELECT DISTINCT o_orderstatus FROM orders) UNION ALL SELECT 'text', count(*) + 1 FROM (SELECT DISTINCT o_orderstatus FROM orders)")
def Y12_reports(s, d):
    """A small result as JSON lines, a Markdown table and plain text."""
    r = relation.report(load(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")))
    return s.createDataFrame([(k, len(v.splitlines())) for k, v in r.items()], "kind string, lines bigint")


# ---- bulk copies, names, layouts in place of indexes ----
@frame("SELECT o_orderkey, o_custkey, o_totalprice, nullif(o_orderpriority, '5-LOW') AS priority, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS status FROM orders")
def S46_bulk_copy(s, d):
    """A query's rows out and in again in character mode; nulls and empty texts stay apart."""
    path = scratch(s, "bulk")
    status = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus"))
    rows = load(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), status.alias("status"))
    copying.bulk_out(rows, path, field="|")
    return copying.bulk_in(s, path, "o_orderkey long, o_custkey long, o_totalprice double, priority string, status string", field="|")


@frame("SELECT c_custkey AS customer_key, c_mktsegment AS market_segment, c_acctbal AS acct_bal_usd FROM customer")
def F19_snake_case(s, d):
    t = load(s, d, "customer").select(F.col("c_custkey").alias("customerKey"), F.col("c_mktsegment").alias("Market Segment"), F.col("c_acctbal").alias("AcctBalUSD"))
    return t.toDF(*(X.snake_case(c) for c in t.columns))


@frame("SELECT p_partkey, '[' || replace(p_name || ']x', ']', ']]') || ']' AS name, 'N''' || replace(p_brand || '''s', '''', '''''') || '''' AS text FROM part")
def F20_quoting(s, d):
    """Names in brackets and national text literals, of values that hold the closing sign."""
    return load(s, d, "part").select("p_partkey", X.quoted_name(F.concat("p_name", F.lit("]x"))).alias("name"), X.quoted_text(F.concat("p_brand", F.lit("'s"))).alias("text"))


@frame("SELECT c_custkey, c_name, (SELECT count(*) - count(DISTINCT c_custkey) FROM customer)::BIGINT AS twice FROM customer WHERE lower(c_name) BETWEEN 'customer#000000010' AND 'customer#000000019'")
def X12_lookup(s, d):
    """In place of an index on an expression and of a unique one: rows laid out by range of the expression, so that file and row group bounds leave out what a lookup cannot need, and a check of the key."""
    path = scratch(s, "laid")
    t = load(s, d, "customer").select("c_custkey", "c_name").withColumn("low", F.lower("c_name"))
    t.repartitionByRange("low").sortWithinPartitions("low").write.parquet(path)
    laid = s.read.parquet(path)
    twice = laid.groupBy("c_custkey").agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("twice"))
    found = laid.where("low BETWEEN 'customer#000000010' AND 'customer#000000019'").select("c_custkey", "c_name")
    return found.join(F.broadcast(twice))  # one row
