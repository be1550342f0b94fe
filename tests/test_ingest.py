"""Ingestion and row changes on small golden tables."""

import datetime
import glob

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import dialect as X
from sparkloom.functions import memory, text
from sparkloom.operators import aggs, dml, ingest, joins, star
from sparkloom.plans import metrics
from sparkloom.sources import copying, databases, uris
from sparkloom.streaming import feeds


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


FARMS = [(11, "Beetroot", "row 3", "2023-04-02 06:15:00"), (12, "Leek", "row 5", "2023-04-09 18:40:00"), (13, "Quince", "wall", "2023-04-17 12:05:00")]
LATER = [(14, "Sorrel", "pot", "2023-05-06 07:30:00"), (15, "Yam", "row 9", "2023-05-21 07:30:00")]


def test_strategies(spark):
    crops = lambda r: spark.createDataFrame(r, "id int, crop string, place string, sown string")
    t = ingest.apply("replace", None, crops(FARMS))
    assert t.count() == 3
    t = ingest.apply("append", t, crops(FARMS + LATER), incremental_key="sown", start="2023-04-20", end="2023-12-31")
    assert t.count() == 5
    changed = [(11, "Chard", "row 3", "2023-06-01"), *FARMS[1:], *LATER]
    for _ in range(2):
        t = ingest.apply("merge", t, crops(changed), key=["id"], incremental_key="sown", start="2023-05-25", end="2023-12-31")
        assert t.count() == 5 and t.where("id = 11").first().crop == "Chard"
    again = ingest.apply("delete+insert", t, crops(LATER), incremental_key="sown", start="2023-05-01", end="2023-05-31")
    assert rows(again) == rows(t)
    with pytest.raises(ValueError):
        ingest.apply("append", t, crops(LATER))
    assert ingest.apply("none", t, crops(LATER)) is None
    assert rows(ingest.apply("truncate+insert", t, crops(LATER))) == sorted(LATER, key=repr)


def test_scd2(spark):
    b = lambda *r: spark.createDataFrame(r, "id int, name string, at string")
    t = ingest.apply("scd2", None, b((1, "A", "2026-01-01"), (2, "B", "2026-01-01")), key=["id"], incremental_key="at")
    second = b((1, "A2", "2026-02-01"), (2, "B", "2026-02-01"))
    for _ in range(2):
        t = ingest.apply("scd2", t, second, key=["id"], incremental_key="at")
        got = sorted((r.id, r.name, r[ingest.FROM], r[ingest.TO]) for r in t.collect())
        assert got == [(1, "A", "2026-01-01", "2026-02-01"), (1, "A2", "2026-02-01", None), (2, "B", "2026-01-01", None)]


def test_plan():
    raw = {"sourceUri": "sqlite:////tmp/x", "sourceTable": "users", "destUri": "duckdb:///y", "destTable": "users", "primaryKey": ["id"], "strategy": "merge", "incrementalKey": "updated_at"}
    snake = {"source_uri": "sqlite:////tmp/x", "source_table": "users", "dest_uri": "duckdb:///y", "dest_table": "users", "primary_key": "id", "strategy": "merge", "incremental_key": "updated_at"}
    assert ingest.IngestPlan.from_dict(raw) == ingest.IngestPlan.from_dict(snake)
    p = ingest.IngestPlan.from_dict(raw)
    assert not p.errors() and "--primary-key" in p.command()
    assert len(ingest.IngestPlan(strategy="merge").errors()) == 5
    assert ingest.IngestPlan(strategy="odd").errors()[-1] == "unknown strategy odd"
    assert ingest.IngestPlan(incremental_key="k").pick() == "append" and ingest.IngestPlan().pick() == "replace"


def test_uris(tmp_path, spark):
    for good in ("postgres://u:p@h:5432/db", "postgresql+psycopg2://h/db", "sqlite:////tmp/x.db", "csv:///data/u.csv"):
        assert not uris.problems(good)
    for bad in ("", "nothing", "foo://h/db", "csv://", "postgres://", "1bad://h", "postgres://h:99999/db"):
        assert uris.problems(bad)
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    for kind in ("csv", "parquet", "jsonl", "orc"):
        uris.write(df, f"{kind}://{tmp_path}/{kind}")
        back = uris.read(spark, f"{kind}://{tmp_path}/{kind}")
        assert rows(back.select(F.col("id").cast("int"), "name")) == rows(df)


@pytest.mark.parametrize("contract,count,names", [("evolve", 2, {"id", "qty", "note"}), ("discard_row", 0, {"id", "name", "qty"}), ("discard_value", 2, {"id", "name", "qty"})])
def test_contracts(spark, contract, count, names):
    target = spark.createDataFrame([(1, "x", 3)], "id bigint, name string, qty int")
    source = spark.createDataFrame([(2, "7", "n"), (3, "x", "m")], "id bigint, qty string, note string")
    assert ingest.compare(target.schema, source.schema) == {"added": ["note"], "removed": ["name"], "widened": [], "incompatible": ["qty"]}
    t, s = ingest.align(target, source, contract)
    assert set(t.columns) == names and t.schema.simpleString() == s.schema.simpleString() and s.count() == count
    if contract == "discard_value":
        assert {r.id: r.qty for r in s.collect()} == {2: 7, 3: None}
    with pytest.raises(ValueError):
        ingest.align(target, source, "freeze")


def test_masks(spark):
    df = spark.createDataFrame([("a@b.c", "123456789", "5551234567", 12345, "s", "t")], "e string, n string, p string, v int, r string, z string")
    r = ingest.mask(df, "e:hash", "n:partial:4", "p:both:3", "v:round:1000", "r:redact", "z:nullify").first()
    assert len(r.e) == 64 and r.n == "*****6789" and r.p == "555****567" and r.v == 12000 and r.r == "***REDACTED***" and r.z is None


def test_merge_refuses_doubles_and_tables_swap(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    s = spark.createDataFrame([(1, "x"), (1, "y")], "id int, v string")
    with pytest.raises(Exception, match="several source rows"):
        dml.merge(t, s, ["id"], matched=[(None, "update", None)]).collect()
    table = dml.Table(spark, f"file://{tmp_path}/t")
    table.commit(t)
    table.commit(dml.upsert(table.read(), s.limit(1), ["id"]))
    assert table.read().count() == 2 and table.sweep() == 1 and table.read().count() == 2
    assert rows(dml.merge(t, s.limit(0), ["id"], missing=[("t.id = 2", "delete", None)])) == [(1, "a")]
    with pytest.raises(PermissionError):
        dml.Table(spark, f"file://{tmp_path}/t", read_only=True).commit(t)


def test_change_feed_stream(spark, tmp_path):
    schema = "op string, lsn bigint, id int, name string"
    add = lambda feed: spark.createDataFrame(feed, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    table = dml.Table(spark, f"file://{tmp_path}/t")
    follow = lambda: feeds.follow(feeds.files(spark, f"{tmp_path}/feed", schema), table, ["id"], f"{tmp_path}/ck")
    add([("I", 1, 1, "a"), ("I", 2, 2, "b"), ("U", 3, 1, "a2"), ("D", 4, 2, None), ("I", 5, 3, "c")])
    for _ in range(2):
        follow()
        assert rows(feeds.current(table, ["id"])) == [(1, "a2"), (3, "c")]
    add([("U", 2, 1, "late"), ("U", 3, 2, "late"), ("U", 9, 3, "c9")])  # older ones that come later change nothing
    follow()
    assert rows(feeds.current(table, ["id"])) == [(1, "a2"), (3, "c9")]
    n = len(table.manifest()["folders"])
    assert n == 2  # a batch adds a folder and rewrites none
    feeds.compact(table, ["id"])
    add([("U", 3, 2, "late again")])
    follow()
    assert rows(feeds.current(table, ["id"])) == [(1, "a2"), (3, "c9")]


def test_commits_are_whole(spark, tmp_path):
    t = dml.Table(spark, f"file://{tmp_path}/t")
    one, two = (spark.createDataFrame([(i,)], "id int") for i in (1, 2))
    t.commit(one)
    old = t.read()
    v = t.append(two)
    assert rows(t.read()) == [(1,), (2,)] and rows(old) == [(1,)] and v == 1
    with pytest.raises(dml.Conflict):  # a writer that began before the append
        t._publish(one.schema, [], 0)
    assert rows(t.read()) == [(1,), (2,)]
    t.commit(t.read().where("id = 2"))
    t.rollback(0)
    assert rows(t.read()) == [(1,)] and rows(t.read(1)) == [(1,), (2,)]
    assert t.sweep() == 2 and rows(t.read()) == [(1,)]


def test_asof_ties_and_nulls(spark):
    t = lambda r: spark.createDataFrame(r, "k int, ts int, v string")
    left = t([(1, 5, "a"), (1, None, "b"), (None, 5, "c"), (2, 1, "d")])
    right = t([(1, 5, "x"), (1, 5, "y"), (1, None, "n"), (None, 1, "m"), (2, 2, "z")])
    assert rows(joins.asof(left, right, ["k"], "ts", "ts").select("v", "r_v")) == [("a", "y")]
    assert joins.asof(left, right, ["k"], "ts", "ts", how="left").count() == 4


def test_names_and_formats():
    assert X.snake_case("firstName") == "first_name" and X.snake_case("HTTPServer ID") == "http_server_id"
    assert X.java_format("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH" and X.quote_identifier("a]b") == "[a]]b]"
    assert ingest.months(datetime.date(2026, 1, 15), datetime.date(2026, 3, 2)) == [(datetime.date(2026, 1, 15), datetime.date(2026, 2, 1)), (datetime.date(2026, 2, 1), datetime.date(2026, 3, 1)), (datetime.date(2026, 3, 1), datetime.date(2026, 3, 2))]


def test_summary_and_inference(spark):
    df = spark.createDataFrame([("1", "1.5", "x"), ("2", "2", None), (None, "7", "x")], "a string, b string, c string")
    assert ingest.infer(df).simpleString() == "struct<a:bigint,b:double,c:string>"
    got = {r.column_name: r for r in aggs.summarize(spark.createDataFrame([(1, "u"), (3, None)], "n int, s string")).collect()}
    assert got["n"].avg == 2 and got["s"].null_percentage == 50 and got["s"]["count"] == 2


@pytest.mark.parametrize("size", ["64m", "2m", "64k"])
def test_numbering_at_size(spark, size):
    """Positions of 600,000 wide rows, most with one value of the order, against the row number."""
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    try:
        t = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").withColumn("v", F.when(F.col("l_orderkey") % 5 > 0, 7).otherwise(F.col("l_orderkey")))
        got = joins.numbered(t, [F.asc("v"), F.asc("l_orderkey"), F.asc("l_linenumber")])
        n = t.count()
        r = got.agg(F.count("*").alias("n"), F.count_distinct("pos").alias("d"), F.min("pos").alias("a"), F.max("pos").alias("z")).first()
        assert (r.n, r.d, r.a, r.z) == (n, n, 1, n)
        w = Window.orderBy("v", "l_orderkey", "l_linenumber")
        want = t.select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("w")).groupBy("l_orderkey", "l_linenumber").agg(F.min("w").alias("w"), F.max("w").alias("x"))
        off = got.join(want, ["l_orderkey", "l_linenumber"]).where("pos < w OR pos > x")
        assert off.count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)


def test_positional_join_keeps_rows(spark):
    o = spark.read.parquet("/root/testdata/sf0.1/orders.parquet").select("o_orderkey", "o_totalprice")
    got = joins.positional(o, o.select(F.col("o_orderkey").alias("k")), [F.asc("o_orderkey")], [F.asc("k")])
    r = got.agg(F.count("*").alias("n"), F.count_if(F.expr("o_orderkey <=> k")).alias("same")).first()
    assert r.n == r.same == o.count()


def test_tiles_with_one_dominant_value(spark):
    t = spark.range(50_003).select("id", F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id")).alias("v"))
    got = metrics.tiled(t, [F.asc("v"), F.asc("id")], 7, "tile")
    want = t.select("id", F.ntile(7).over(Window.orderBy("v", "id")).alias("w"))
    assert got.join(want, "id").where("tile <> w").count() == 0 and got.count() == 50_003


def test_not_in_nulls(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    for other, want in (([], [(1,), (2,), (None,)]), ([(1,)], [(2,)]), ([(1,), (None,)], [])):
        assert rows(star.not_in(a, "x", spark.createDataFrame(other, "y int"), "y")) == want


def test_databases(spark, tmp_path):
    db = databases.Database(spark, f"file://{tmp_path}/db")
    for bad in ("a.b", "", "../x"):
        with pytest.raises(databases.CatalogError):
            db.table(bad)
    with pytest.raises(databases.CatalogError):
        db.read("nothing")
    db.create("t", "id int, v string")
    with pytest.raises(databases.CatalogError):
        db.insert("t", spark.createDataFrame([(1,)], "a int"), columns=["missing"])
    assert rows(db.insert("t", spark.createDataFrame([(1,)], "a int"), columns=["id"], defaults={"v": F.lit("d")})) == [(1, "d")]
    db.drop("t")
    assert db.tables() == []


def test_ingest_run(spark, tmp_path):
    db = databases.Database(spark, f"file://{tmp_path}/db")
    crops = spark.createDataFrame(FARMS + LATER, "id int, crop string, place string, sown string")
    plan = lambda **k: ingest.IngestPlan("memory://x", "crops", "memory://y", "t", metadata=False, **k)
    ingest.run(spark, plan(mask=("place:redact",), exclude=("sown",)), db, {"crops": crops})
    assert db.read("t").columns == ["id", "crop", "place"] and {r.place for r in db.read("t").collect()} == {"***REDACTED***"}
    with pytest.raises(ValueError):
        ingest.run(spark, plan(strategy="merge"), db, {"crops": crops})
    with pytest.raises(ValueError):
        ingest.run(spark, plan(strategy="merge", primary_key=("id",), contract="freeze"), db, {"crops": crops})
    ingest.run(spark, plan(strategy="merge", primary_key=("id",)), db, {"crops": crops})
    assert "sown" in db.read("t").columns and db.read("t").count() == 5
    assert not [n for n in db.tables() if n.startswith("staging")] or len(db.tables()) == 2


def test_json_array_files_parse(spark, tmp_path):
    import json

    for n in (0, 1, 5):
        path = f"{tmp_path}/{n}"
        copying.write_json(spark.range(n).coalesce(1), path, array=True)
        whole = "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))
        assert json.loads(whole) == [{"id": i} for i in range(n)]


def test_scan_golden(spark):
    files = spark.createDataFrame([("app.js", "const h = md5(x);"), ("prompt.md", "please ignore previous instructions"), ("key.pem", "-----BEGIN RSA PRIVATE KEY-----")], "path string, text string")
    found = text.gated(text.scan(files, id_col="path"))
    got = {(r.path, r.severity) for r in found.collect()}
    assert got == {("app.js", "MAJOR"), ("prompt.md", "MAJOR"), ("key.pem", "BLOCKER")} and text.gate(found, "CRITICAL") == 2


def test_bulk_copy(spark, tmp_path):
    rows = [(1, "a", 0.5), (2, None, None), (3, "", 1e-9), (None, "x,y", 2.0)]
    df = spark.createDataFrame(rows, "id long, t string, v double")
    copying.bulk_out(df, f"{tmp_path}/a", field="|")
    got = copying.bulk_in(spark, f"{tmp_path}/a", "id long, t string, v double", field="|")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows))
    with pytest.raises(Exception, match="holds a terminator"):
        copying.bulk_out(df, f"{tmp_path}/b", field=",")
    with pytest.raises(Exception, match="number of fields"):
        copying.bulk_in(spark, f"{tmp_path}/a", "id long, t string", field="|").collect()
    copying.bulk_out(df.limit(0), f"{tmp_path}/c")
    assert copying.bulk_in(spark, f"{tmp_path}/c", "id long, t string, v double").count() == 0


def test_names_of_the_target(spark):
    df = spark.createDataFrame([(1, 2, 3)], "userId int, `First Name` int, other int")
    names = lambda *a: ingest.naming(df, *a).columns
    assert names("auto", ["user_id", "First Name"]) == ["user_id", "First Name", "other"]
    assert names("auto") == df.columns and names("snake_case", ["userId"]) == ["user_id", "first_name", "other"]
    with pytest.raises(ValueError):
        ingest.naming(spark.createDataFrame([(1, 2)], "userId int, user_id int"), "auto", ["user_id"])


@pytest.mark.parametrize("block_bytes", [None, 4096])
def test_unlike_by_row_and_without_shuffled_blocks(spark, block_bytes):
    """Against brute force, with ids that are null or repeated; whole blocks of vectors are not copied to every shard."""
    rng = np.random.default_rng(3)
    store = rng.normal(size=(300, 8))
    mine = np.concatenate([rng.normal(size=(200, 8)), store[:40] * 3 + 0.01, rng.normal(size=(1, 8)) * 1e-200, store[:1] * 1e200])
    vectors = [[float(y) for y in x] for x in mine] + [None, [], [0.0] * 8, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0]]
    data = [(None if i % 7 == 0 else i // 2, i, v) for i, v in enumerate(vectors)]
    known = [(i, i, [float(y) for y in x]) for i, x in enumerate(store)] + [(1, 0, None), (1, 0, [0.0] * 8), (1, 0, [float("nan")] * 8)]
    schema = "vec_id long, n int, embedding array<double>"
    got = memory.unlike(spark.createDataFrame(data, schema).repartition(3), spark.createDataFrame(known, schema), 0.8, **({"block_bytes": block_bytes} if block_bytes else {}))
    assert "Generate" not in got._jdf.queryExecution().toString()
    unit = lambda a: a / np.abs(a).max(1, keepdims=True) / np.linalg.norm(a / np.abs(a).max(1, keepdims=True), axis=1, keepdims=True)
    like = (unit(mine) @ unit(store).T > 0.8).any(1)
    assert 40 < like.sum() < 200
    assert sorted(r.n for r in got.collect()) == [i for i in range(len(vectors)) if i >= len(mine) or not like[i]]
