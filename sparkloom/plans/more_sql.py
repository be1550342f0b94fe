"""Further functions, types, samples, summaries and windows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dialect as X
from ..operators import aggs, star
from ..session import load, run_sql
from .catalogue import frame, pair, same

# ---- projection ----
pair("P02_prefix_alias", X.prefix_aliases("SELECT k: o_orderkey, price: o_totalprice * 2 FROM orders WHERE o_orderkey > 3"), "SELECT k: o_orderkey, price: o_totalprice * 2 FROM orders WHERE o_orderkey > 3")
same(
    P26_coercion="SELECT o_orderkey, o_orderkey + 0.5e0 AS a, o_orderkey = '7' AS b, coalesce(o_totalprice, 1) AS c, CASE WHEN o_orderkey > 5 THEN 1 ELSE 2.5e0 END AS e FROM orders",
    C02_materialized="WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT x.o_custkey, x.n, y.n AS m FROM a x JOIN a y ON x.o_custkey = y.o_custkey + 1",
)


@frame("SELECT * EXCLUDE (o_totalprice, o_orderpriority) FROM orders")
def P30_source_exclusion(s, d):
    return star.exclude(load(s, d, "orders"), "o_totalprice", "o_orderpriority")


@frame("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 77")
def P31_row_cap(s, d):
    """A cap at the source, where it is the feature; the key's order makes it the same rows each time."""
    return load(s, d, "orders").select("o_orderkey").orderBy("o_orderkey").limit(77)


@frame("SELECT true AS inside, count(*) AS n, true AS distinct_keys FROM (SELECT 1)")
def P35_sample_share(s, d):
    """Rows of a 20 % sample are rows of the table, each at most once, and about a fifth of them: within six standard deviations."""
    t = load(s, d, "orders")
    sample = t.sample(False, 0.2, seed=11).select("o_orderkey")
    both = sample.groupBy("o_orderkey").agg(F.count("*").alias("c")).join(t.select("o_orderkey"), "o_orderkey", "left_semi")
    got = both.agg(F.count("*").alias("g"), F.coalesce(F.max("c"), F.lit(1)).alias("m")).join(F.broadcast(t.agg(F.count("*").alias("n"))))  # one row each
    return got.select((F.abs(F.col("g") - F.col("n") * 0.2) <= 6 * F.sqrt(F.col("n") * 0.16) + 1).alias("inside"), F.lit(1).cast("long").alias("n"), (F.col("m") == 1).alias("distinct_keys"))


@frame("SELECT least(count(*), 100)::BIGINT AS n, least(count(*), 100)::BIGINT AS known FROM orders")
def P36_sample_rows(s, d):
    """Exactly 100 rows, all of them different rows of the table."""
    t = load(s, d, "orders")
    sample = star.sample_rows(t, 100, 7).select("o_orderkey")
    known = sample.distinct().join(t.select("o_orderkey"), "o_orderkey", "left_semi")
    return sample.agg(F.count("*").alias("n")).join(F.broadcast(known.agg(F.count("*").alias("known"))))  # one row each


# ---- joins ----
@frame("SELECT o_orderkey, p.i AS i FROM orders, (SELECT unnest(range(1, 4)) AS i) p")
def J20_cross_apply(s, d):
    """A table function applied to each row."""
    return run_sql(s, d, "SELECT o_orderkey, p.i FROM orders, LATERAL (SELECT explode(sequence(1L, 3L)) AS i) p")


@frame("SELECT n_nationkey, n_name, region_label FROM nation JOIN (VALUES (0, 'south'), (1, 'west'), (9, 'none')) r(region, region_label) ON n_regionkey = region")
def J18_registered_frame(s, d):
    """A frame made in memory joined with a table."""
    mine = s.createDataFrame([(0, "south"), (1, "west"), (9, "none")], "region int, region_label string")
    n = load(s, d, "nation")
    return n.join(mine, n.n_regionkey == mine.region).select("n_nationkey", "n_name", "region_label")


@frame("SELECT n_name, r_name, count(c_custkey) AS members FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def J21_membership(s, d):
    """Members of each group over two catalogues."""
    n, r, c = (load(s, d, t) for t in ("nation", "region", "customer"))
    j = n.join(r, n.n_regionkey == r.r_regionkey).join(c, c.c_nationkey == n.n_nationkey, "left")
    return j.groupBy("n_name", "r_name").agg(F.count("c_custkey").alias("members"))


# ---- aggregates ----
@frame("SELECT true AS parts_close, true AS mid_close FROM (SELECT 1)")
def A24_approx(s, d):
    """Approximate distinct counts within 10 % of the exact one, and the median's rank within 1 %."""
    t = load(s, d, "lineitem")
    a = t.agg(F.approx_count_distinct("l_partkey", 0.02).alias("p"), F.percentile_approx("l_extendedprice", 0.5, 10000).alias("m"))
    b = t.agg(F.count_distinct("l_partkey").alias("q"), F.count("*").alias("n"))
    below = t.join(F.broadcast(a.select("m"))).agg(F.count_if(F.col("l_extendedprice") <= F.col("m")).alias("k"))  # one row
    row = a.join(F.broadcast(b)).join(F.broadcast(below))
    return row.select((F.abs(F.col("p") - F.col("q")) <= 0.1 * F.col("q")).alias("parts_close"), (F.abs(F.col("k") - F.col("n") / 2) <= 0.01 * F.col("n") + 1).alias("mid_close"))


@frame(" UNION ALL ".join(f"SELECT '{c}' AS column_name, min({c})::VARCHAR AS min, max({c})::VARCHAR AS max, count(*) AS \"count\", round((count(*) - count({c})) * 100.0 / count(*), 4)::DOUBLE AS null_percentage, {'round(avg(' + c + '), 6)::DOUBLE' if n else 'NULL::DOUBLE'} AS avg FROM part" for c, n in (("p_partkey", 1), ("p_name", 0), ("p_brand", 0), ("p_type", 0), ("p_size", 1))))
def A25_summarize(s, d):
    out = aggs.summarize(load(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    return out.select("column_name", "min", "max", "count", F.round("null_percentage", 4).alias("null_percentage"), F.round("avg", 6).alias("avg"))


@frame("SELECT * FROM (VALUES ('nation', 'n_nationkey', 'int'), ('nation', 'n_name', 'string'), ('nation', 'n_regionkey', 'int'), ('region', 'r_regionkey', 'int'), ('region', 'r_name', 'string')) t(table_name, column_name, data_type)")
def A26_describe(s, d):
    """Columns of tables as rows."""
    return aggs.describe({t: load(s, d, t) for t in ("nation", "region")})


@frame("SELECT role AS login, count(DISTINCT conv_id) AS sessions, count(*) AS requests FROM conversations GROUP BY role ORDER BY requests DESC, login")
def A30_session_counts(s, d):
    c = load(s, d, "conversations")
    return c.groupBy(F.col("role").alias("login")).agg(F.count_distinct("conv_id").alias("sessions"), F.count("*").alias("requests")).orderBy(F.desc("requests"), "login")


@frame("SELECT source, sum(n_chars)::BIGINT AS used, (sum(n_chars) * 8 // 1024)::BIGINT AS kb FROM documents GROUP BY source ORDER BY used DESC, source LIMIT 20")
def A31_space_top(s, d):
    """The 20 largest tables by space, sources standing for tables."""
    used = load(s, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("used"))
    return used.withColumn("kb", F.expr("used * 8 div 1024")).orderBy(F.desc("used"), "source").limit(20)


# ---- order ----
same(
    L06_top_n="SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20",
    L09_catalog_order="SELECT n_nationkey, n_name FROM nation ORDER BY CASE WHEN n_nationkey <= 4 THEN 0 ELSE 1 END, n_name",
)


@frame("SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 50 OFFSET 25")
def L08_sorted_page(s, d):
    return star.page(load(s, d, "events").select("event_id", "user_id", "ts"), sort="ts", descending=True, tie="event_id", limit=50, offset=25)


# ---- text, dates, numbers ----
pair("F21_collation", "SELECT n_nationkey, n_name COLLATE UTF8_LCASE = lower(n_name) AS same, n_name COLLATE UTF8_BINARY < 'G' AS early FROM nation", "SELECT n_nationkey, lower(n_name) = lower(n_name) AS same, n_name < 'G' AS early FROM nation")
pair("F22_blobs", "SELECT n_nationkey, hex(encode(n_name, 'UTF-8') || unhex('00ff')) AS h, octet_length(encode(n_name, 'UTF-8')) AS n, lpad(bin(n_nationkey), 8, '0') AS bits, CAST(bit_count(n_nationkey) AS INT) AS ones FROM nation", "SELECT n_nationkey, hex(encode(n_name) || '\\x00\\xFF'::BLOB) AS h, octet_length(encode(n_name))::INT AS n, right(n_nationkey::BIT::VARCHAR, 8) AS bits, bit_count(n_nationkey)::INT AS ones FROM nation")
same(
    D01_now="SELECT current_date = CAST(current_timestamp AS DATE) AS a, now() >= TIMESTAMP '2024-01-01 00:00:00' AS b, now() = current_timestamp AS c",
    D14_relative="SELECT count(*) AS recent FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL '7' DAY",
    M10_session="SELECT current_user IS NOT NULL AS a, current_database() IS NOT NULL AS b, length(version()) > 0 AS c",
)
pair("D09_difference", "SELECT l_orderkey, l_linenumber, CAST(timestampdiff(SECOND, o_orderdate, l_shipdate) AS BIGINT) AS seconds, CAST(extract(DAY FROM l_shipdate - o_orderdate) AS BIGINT) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "SELECT l_orderkey, l_linenumber, epoch(l_shipdate - o_orderdate)::BIGINT AS seconds, extract(day FROM l_shipdate - o_orderdate)::BIGINT AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")


@frame("SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Shanghai' AS there, (ts AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS utc FROM events")
def D11_at_time_zone(s, d):
    return load(s, d, "events").select("event_id", X.at_zone(F.col("ts"), "UTC", "Asia/Shanghai").alias("there"), X.at_zone(F.col("ts"), "America/New_York", "UTC").alias("utc"))


@frame("SELECT event_id, (ts AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC' AS utc FROM events")
def D12_session_zone(s, d):
    """Local times read in a session zone; the session's own setting is put back."""
    return X.in_zone(load(s, d, "events").select("event_id", "ts"), "ts", "Europe/Berlin", "utc")


pair("M06_random", "SELECT count(*) AS n, bool_and(r >= 0 AND r < 1) AS inside, count(DISTINCT r) > 1 AS varied FROM (SELECT rand(7) AS r FROM orders)", "SELECT count(*) AS n, bool_and(r >= 0 AND r < 1) AS inside, count(DISTINCT r) > 1 AS varied FROM (SELECT random() AS r FROM orders)")
same(M08_uuid="SELECT count(DISTINCT u) = count(*) AS distinct_all, min(length(u)) = 36 AND max(length(u)) = 36 AS length_36, count(*) AS n FROM (SELECT CAST(uuid() AS STRING) AS u FROM orders)")


@frame("SELECT n_name, 99 + row_number() OVER (ORDER BY n_name) AS id FROM nation")
def M09_sequence(s, d):
    """CREATE SEQUENCE START 100 and nextval in name order: numbers come from counts by range, not from one task."""
    return X.nextval(load(s, d, "nation").select("n_name"), "id", start=100, by=[F.asc("n_name")])


@frame("SELECT 'UTC' AS zone, 'true' AS adaptive")
def M11_setting(s, d):
    return X.settings(s, zone="spark.sql.session.timeZone", adaptive="spark.sql.adaptive.enabled")


# ---- nested ----
@frame("SELECT o_custkey, list_transform(list_filter(list({'status': o_orderstatus, 'amount': o_totalprice::DECIMAL(18,2)} ORDER BY o_orderkey), lambda x: x.status = 'O'), lambda x: (x.amount * 0.9::DECIMAL(2,1))::DOUBLE) AS cut FROM orders GROUP BY o_custkey")
def N06_transform_filter(s, d):
    """Ten per cent off each buyer's open orders, in a list of structs."""
    o = load(s, d, "orders")
    items = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount")))), lambda x: F.struct(x.status.alias("status"), x.amount.alias("amount")))
    nested = o.groupBy("o_custkey").agg(items.alias("items"))
    return nested.select("o_custkey", F.transform(F.filter("items", lambda x: x.status == "O"), lambda x: (x.amount * F.lit("0.9").cast("decimal(2,1)")).cast("double")).alias("cut"))


pair("N09_map_entries", "SELECT n_nationkey, map_from_entries(array(named_struct('k', 'name', 'v', n_name), named_struct('k', 'upper', 'v', upper(n_name))))['upper'] AS u FROM nation", "SELECT n_nationkey, map_from_entries([('name', n_name), ('upper', upper(n_name))])['upper'] AS u FROM nation")


@frame("SELECT vec_id, len(embedding)::INT AS n, embedding[1] AS first FROM embeddings")
def N11_fixed_array(s, d):
    """ARRAY[n]: other lengths are an error."""
    e = load(s, d, "embeddings")
    n = len(e.select("embedding").first()[0])
    return e.select("vec_id", X.fixed_array(F.col("embedding"), n).alias("a")).select("vec_id", F.size("a").alias("n"), F.col("a")[0].alias("first"))


@frame("SELECT event_id, CASE WHEN value >= 50 THEN 'num' ELSE 'str' END AS tag, CASE WHEN value >= 50 THEN value END AS num, CASE WHEN value >= 50 THEN NULL ELSE event_type END AS str FROM events")
def N12_union_type(s, d):
    """A tagged union: the tag and one field for each member, of which one is set. A null value takes the text member."""
    u = X.tagged({"num": F.col("value"), "str": F.col("event_type")}, F.when(F.col("value") >= 50, "num").otherwise("str"))
    return load(s, d, "events").select("event_id", u.alias("u")).select("event_id", "u.tag", "u.num", "u.str")


@frame("SELECT event_id, props AS j, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def N15_nested_json(s, d):
    """Nested JSON stays one column; a flattener gives its fields on demand."""
    e = load(s, d, "events").select("event_id", F.col("props").alias("j"))
    return X.flatten_json(e, "j", "k bigint").select("event_id", "j", "k")


pair("N16_list_text", "SELECT o_orderkey, CAST(array(o_orderkey, o_custkey) AS STRING) AS t FROM orders", "SELECT o_orderkey, [o_orderkey, o_custkey]::VARCHAR AS t FROM orders")


@frame("SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 END AS rank FROM orders ORDER BY rank, o_orderkey")
def N17_enum(s, d):
    """A closed domain of texts that sorts by its own order; other values are an error."""
    kind = X.Enum("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    o = load(s, d, "orders").select("o_orderkey", kind.checked(F.col("o_orderpriority")).alias("o_orderpriority"))
    return o.withColumn("rank", kind.rank(F.col("o_orderpriority"))).orderBy("rank", "o_orderkey")


# ---- windows over time ----
@frame("SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR])::TIMESTAMP AS start FROM events) GROUP BY ALL")
def T05_sliding(s, d):
    """Windows of twelve hours that begin every six."""
    from ..streaming.feeds import windowed

    return windowed(load(s, d, "events"), "12 hours", "6 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@frame("SELECT 'click' AS event_type, 1::BIGINT AS n, 0::BIGINT AS hour UNION ALL SELECT 'click', 1, 3")
def T05_late(s, d):
    """A stream of three files: the third holds an event that is older than the watermark, and is left out."""
    from ..streaming.feeds import tumbling_stream

    rows = [("click", "2024-01-01 00:10:00"), ("click", "2024-01-01 03:20:00"), ("click", "2024-01-01 00:20:00")]
    return tumbling_stream(s, [[r] for r in rows], "1 hour", "30 minutes").select("event_type", "n", F.hour("start").cast("long").alias("hour"))
