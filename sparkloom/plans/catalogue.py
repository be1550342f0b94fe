"""The query catalogue: one entry for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dialect as X
from ..operators import aggs, dml, ingest, joins, star
from ..session import load, run_sql
from . import metrics

QUERIES: dict = {}
SQL: dict = {}


def same(**texts: str) -> None:
    """Texts that both engines run."""
    for name, text in texts.items():
        QUERIES[name] = lambda s, d, t=text: run_sql(s, d, t)
        SQL[name] = text


def pair(name: str, spark_sql: str, sql: str) -> None:
    QUERIES[name] = lambda s, d: run_sql(s, d, spark_sql)
    SQL[name] = sql


def frame(sql: str | None):
    """A DataFrame query and its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# ---- projection, filters ----
same(
    P01_projection="SELECT o_orderkey, o_totalprice * 2 + 1 AS r, sqrt(o_totalprice) AS root FROM orders",
    P03_distinct="SELECT DISTINCT c_mktsegment FROM customer",
    P10_no_from="SELECT 1 AS one, 'a' AS letter",
    P11_from_first="FROM nation SELECT n_nationkey, n_name WHERE n_regionkey = 1",
    P12_where="SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 100000) AND NOT o_orderpriority LIKE '5%'",
    P13_half_open="SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15'",
    P14_between="SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20",
    P15_in_list="SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    P17_like="SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%'",
    P18_ilike="SELECT p_partkey FROM part WHERE p_type ILIKE '%BRASS%' OR p_type ILIKE 'standard%'",
    P20_regexp="SELECT p_partkey FROM part WHERE regexp_like(p_name, '[aeiou]{2}')" ,
    P21_null_logic="SELECT o_orderkey, NULL = NULL AS e, nullif(o_orderstatus, 'F') IS NULL AS f FROM orders",
    P22_correlated="SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    P24_case="SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS band, coalesce(nullif(o_orderstatus, 'P'), '?') AS s FROM orders",
    P25_casts="SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS d, try_cast(o_orderpriority AS INT) AS i, o_orderkey::VARCHAR AS k FROM orders".replace("VARCHAR", "STRING"),
    P28_identifiers="SELECT O_ORDERKEY AS order_key FROM Orders WHERE O_OrderStatus = 'F'".replace("Orders", "orders"),
    S23_values="SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(id, name)",
)
SQL["P20_regexp"] = "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '[aeiou]{2}')"
SQL["P25_casts"] = SQL["P25_casts"].replace("STRING", "VARCHAR")
pair("S24_series", "SELECT explode(sequence(1, 100)) AS i", "SELECT generate_series::INT AS i FROM generate_series(1, 100)")
pair("P19_similar_to", "SELECT p_partkey FROM part WHERE p_brand RLIKE '^(?:Brand#(1|2).*)$'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#(1|2).*')")


@frame("SELECT * EXCLUDE (l_tax, l_discount) FROM lineitem")
def P05_exclude(s, d):
    return star.exclude(load(s, d, "lineitem"), "l_tax", "l_discount")


@frame("SELECT * REPLACE (upper(n_name) AS n_name) FROM nation")
def P06_replace(s, d):
    return star.replace(load(s, d, "nation"), n_name=F.upper("n_name"))


@frame("SELECT COLUMNS('.*key$') FROM lineitem")
def P07_columns_regex(s, d):
    t = load(s, d, "lineitem")
    return t.select(*star.columns(t, "key$"))


@frame("SELECT p_name, p_partkey, p_type, p_size, p_retailprice, p_brand FROM part")
def P08_columns_lambda(s, d):
    t = load(s, d, "part")
    return t.select(*star.columns(t, lambda c: c.startswith("p_")))


@frame("SELECT max(o_orderkey) AS o_orderkey, max(o_custkey) AS o_custkey, max(o_totalprice) AS o_totalprice FROM orders")
def P09_fn_columns(s, d):
    t = load(s, d, "orders")
    return t.agg(*star.columns(t, "key$|price$", F.max))


@frame("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def P04_distinct_on(s, d):
    return star.distinct_on(load(s, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@frame("SELECT o_orderkey, o_custkey FROM orders QUALIFY sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) > 500000")
def P32_qualify(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return star.qualify(load(s, d, "orders"), F.sum("o_totalprice").over(w), lambda q: q > 500000).select("o_orderkey", "o_custkey")


@frame("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def P23_keyset(s, d):
    return star.keyset_page(load(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 50)


@frame("SELECT o_orderkey FROM orders WHERE o_orderkey >= 10 AND o_orderkey < 500")
def P29_interval(s, d):
    return star.interval(load(s, d, "orders"), "o_orderkey", 10, 500).select("o_orderkey")


@frame("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def P27_parameters(s, d):
    return run_sql(s, d, "SELECT o_orderkey FROM orders WHERE o_orderstatus = :st AND o_totalprice > :lo", {"st": "F", "lo": 1000})


@frame("SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'O') AS O, sum(l_quantity) FILTER (l_linestatus = 'F') AS F FROM lineitem GROUP BY l_returnflag")
def P33_pivot(s, d):
    return load(s, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.sum("l_quantity"))


@frame("SELECT l_orderkey, l_linenumber, name, value FROM (SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem) UNPIVOT (value FOR name IN (l_tax, l_discount))")
def P34_unpivot(s, d):
    return star.unpivot(load(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"], "name", "value")


@frame("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def P16_not_in(s, d):
    return star.not_in(load(s, d, "customer"), "c_custkey", load(s, d, "orders"), "o_custkey").select("c_custkey")


# ---- joins and sets ----
same(
    J01_inner="SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    J02_left="SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
    J03_right="SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey",
    J04_full="SELECT s_suppkey, n_nationkey FROM supplier FULL JOIN nation ON s_nationkey = n_nationkey",
    J05_using="SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)",
    J06_natural="SELECT doc_id, lang, toxic FROM documents NATURAL JOIN labels",
    J07_star="SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
    J08_self="SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    J13_semi="SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)",
    J14_anti="SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    J15_cross="SELECT r_name, n_name FROM region CROSS JOIN nation",
    J17_filter_then_join="SELECT o_orderkey, l_linenumber FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') o JOIN lineitem ON l_orderkey = o_orderkey",
    J19_fan_out="SELECT n_name, count(DISTINCT c_custkey) AS buyers, count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name",
    U01_union_all="SELECT 'c' AS kind, c_custkey AS k FROM customer UNION ALL SELECT 's', s_suppkey FROM supplier",
    U02_union="SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    U04_intersect="SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    U05_except="SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    C01_cte="WITH a AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), b AS (SELECT * FROM a WHERE t > 100000) SELECT count(*) AS n FROM b",
    C03_recursive="WITH RECURSIVE t AS (SELECT 1 AS i, 0 AS depth UNION ALL SELECT i * 2, depth + 1 FROM t WHERE depth < 10) SELECT i, depth FROM t",
    C04_clause_order="SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus HAVING count(*) > 10 ORDER BY n DESC, o_orderstatus LIMIT 2",
)
pair("J10_lateral", "SELECT c_custkey, top.o_orderkey FROM customer, LATERAL (SELECT max(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey = c_custkey) AS top", "SELECT c_custkey, top.o_orderkey FROM customer, LATERAL (SELECT max(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey = c_custkey) AS top")
pair("J16_hint", "SELECT /*+ BROADCAST(nation) */ s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")


@frame("SELECT c.event_id AS event_id, e.event_id AS r_event_id FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY ALL) e ON c.user_id = e.user_id AND e.ts <= c.ts")
def J09_asof_join(s, d):
    e = load(s, d, "events")
    click, error = (e.where(F.col("event_type") == t).select("user_id", "ts", "event_id") for t in ("click", "error"))
    return joins.asof(click, error, ["user_id"], "ts", "ts").select("event_id", "r_event_id")


@frame("SELECT a.s_suppkey AS x, count(*) AS n FROM supplier a JOIN supplier b ON a.s_acctbal > b.s_acctbal GROUP BY a.s_suppkey")
def J12_theta(s, d):
    return joins.count_smaller(load(s, d, "supplier"), "s_acctbal").where("n > 0").select(F.col("s_suppkey").alias("x"), "n")


@frame("SELECT a.pos AS pos, n_name, r_name FROM (SELECT row_number() OVER (ORDER BY n_name) AS pos, n_name FROM nation) a FULL JOIN (SELECT row_number() OVER (ORDER BY r_name) AS pos, r_name FROM region) b ON a.pos = b.pos")
def J11_positional(s, d):
    return joins.positional(load(s, d, "nation").select("n_name"), load(s, d, "region").select("r_name"), [F.asc("n_name")], [F.asc("r_name")])


@frame("SELECT p_partkey, lo FROM part JOIN (SELECT p_partkey * 10.0 AS lo, p_partkey * 10.0 + 25 AS hi FROM part) r ON p_retailprice >= lo AND p_retailprice < hi")
def J12_range_join(s, d):
    p = load(s, d, "part")
    r = p.select((F.col("p_partkey") * 10.0).alias("lo"), (F.col("p_partkey") * 10.0 + 25).alias("hi"))
    return joins.within(p, r, "p_retailprice", "lo", "hi", 25.0).select("p_partkey", "lo")


@frame("SELECT n_nationkey AS k, n_name AS name, NULL AS extra FROM nation UNION ALL BY NAME SELECT r_regionkey AS k, 'x' AS extra FROM region")
def U03_by_name(s, d):
    return star.union_by_name(load(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), load(s, d, "region").select(F.col("r_regionkey").alias("k"), F.lit("x").alias("extra")))


# ---- aggregates ----
same(
    A01_counts="SELECT count(*) AS n, count(nullif(o_orderstatus, 'F')) AS c, count(DISTINCT o_custkey) AS u FROM orders",
    A02_count_if="SELECT o_orderstatus, count_if(o_totalprice > 100000) AS n FROM orders GROUP BY o_orderstatus",
    A06_min_max="SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY o_orderstatus",
    A11_bools="SELECT o_custkey, bool_and(o_totalprice > 1000) AS a, bool_or(o_orderstatus = 'F') AS b FROM orders GROUP BY o_custkey",
    A18_filter="SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS m FROM orders GROUP BY o_custkey",
    A19_distinct="SELECT count(DISTINCT p_size) AS n, sum(DISTINCT p_size)::BIGINT AS s FROM part",
    A20_empty="SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0",
    A21_having="SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    A22_group_all="SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL",
    A23_rollup="SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    A23_cube="SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    A23_sets="SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    A13_median="SELECT p_brand, median(p_retailprice) AS m FROM part GROUP BY p_brand",
    A29_group_stats="SELECT c_mktsegment, count(*) AS n, median(c_acctbal) AS med FROM customer GROUP BY c_mktsegment ORDER BY n DESC LIMIT 20",
    A07_arg="SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS lo, max_by(o_orderkey, o_totalprice * 1000000 + o_orderkey) AS hi FROM orders GROUP BY o_custkey",
)
pair("A03_sum_avg", "SELECT l_returnflag, sum(l_linenumber) AS s, round(avg(l_quantity), 6) AS a, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS p FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, sum(l_linenumber)::BIGINT AS s, round(avg(l_quantity), 6) AS a, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS p FROM lineitem GROUP BY l_returnflag")
pair("A09_string_agg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
pair("A13_quantiles", "SELECT p_brand, percentile_cont(0.25) WITHIN GROUP (ORDER BY p_retailprice) AS c, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY p_size) AS INT) AS d FROM part GROUP BY p_brand", "SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS c, quantile_disc(p_size, 0.5) AS d FROM part GROUP BY p_brand")
for name, fn in (("A14_spread", "round(var_samp(p_retailprice), 4) AS a, round(var_pop(p_retailprice), 4) AS b, round(stddev_samp(p_retailprice), 4) AS c, round(stddev_pop(p_retailprice), 4) AS d"), ("A15_corr", "round(covar_samp(p_retailprice, p_size), 4) AS a, round(corr(p_retailprice, p_size), 8) AS b")):
    same(**{name: f"SELECT p_brand, {fn} FROM part GROUP BY p_brand"})
pair("A16_mode", "SELECT min_by(p_size, struct(-n, p_size)) AS m FROM (SELECT p_size, count(*) AS n FROM part GROUP BY p_size)", "SELECT p_size AS m FROM part GROUP BY p_size ORDER BY count(*) DESC, p_size LIMIT 1")
pair("A27_daily_rollup", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1", "SELECT date_trunc('day', ts)::DATE AS day, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY 1")


@frame("SELECT l_orderkey, round(product(1 + l_discount), 8) AS p FROM lineitem GROUP BY l_orderkey")
def A04_product(s, d):
    return load(s, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.product(1 + F.col("l_discount")), 8).alias("p"))


@frame("SELECT sum(l_extendedprice::DECIMAL(38,6))::DOUBLE AS total FROM lineitem")
def A05_exact_sum(s, d):
    return load(s, d, "lineitem").agg(aggs.exact_sum(F.col("l_extendedprice")).cast("double").alias("total"))


@frame("SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice, o_orderkey)[1:3] AS cheap FROM orders GROUP BY o_custkey")
def A08_arg_min_n(s, d):
    return aggs.arg_min_n(load(s, d, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice", 3, "cheap")


@frame("SELECT o_custkey, list(nullif(o_orderstatus, 'F') ORDER BY o_orderkey) AS states FROM orders GROUP BY o_custkey")
def A10_list(s, d):
    return load(s, d, "orders").withColumn("st", F.expr("nullif(o_orderstatus, 'F')")).groupBy("o_custkey").agg(aggs.list_all("st", "o_orderkey").alias("states"))


@frame("SELECT CASE WHEN p_retailprice < 900 THEN 0 WHEN p_retailprice >= 2000 THEN 12 ELSE floor((p_retailprice - 900) / 100) + 1 END::BIGINT AS bucket, count(*) AS n FROM part GROUP BY 1")
def A12_histogram(s, d):
    return load(s, d, "part").groupBy(aggs.buckets("p_retailprice", 900, 2000, 11).alias("bucket")).agg(F.count("*").alias("n"))


@frame("SELECT c_mktsegment, first(c_custkey ORDER BY c_custkey) AS a, last(c_name ORDER BY c_custkey) AS z FROM customer GROUP BY c_mktsegment")
def A17_first_last(s, d):
    return load(s, d, "customer").groupBy("c_mktsegment").agg(aggs.first_by("c_custkey", "c_custkey").alias("a"), aggs.last_by("c_name", "c_custkey").alias("z"))


@frame("SELECT o_orderdate::DATE AS order_date, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS gmv, count(DISTINCT o_custkey) AS dau FROM orders GROUP BY 1")
def A28_daily_metrics(s, d):
    return metrics.daily(load(s, d, "orders"))


@frame("""WITH p AS (SELECT o_custkey AS user_id, max(o_orderdate) AS l, count(*) AS f, sum(o_totalprice::DECIMAL(18,2)) AS m FROM orders GROUP BY 1),
q AS (SELECT user_id, ntile(5) OVER (ORDER BY l, user_id)::INT AS r_score, ntile(5) OVER (ORDER BY f, user_id)::INT AS f_score, ntile(5) OVER (ORDER BY m, user_id)::INT AS m_score FROM p)
SELECT *, CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'champions' WHEN r_score >= 4 AND f_score >= 4 THEN 'loyal' WHEN r_score >= 4 THEN 'recent' WHEN m_score >= 4 THEN 'big spenders' WHEN r_score <= 2 AND f_score <= 2 THEN 'lost' ELSE 'regular' END AS segment FROM q""")
def W13_rfm(s, d):
    return metrics.rfm(load(s, d, "orders"))


# ---- windows ----
W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
same(
    W01_ranks=f"SELECT o_orderkey, row_number() OVER ({W}) AS a, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS b, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS c FROM orders",
    W02_shares=f"SELECT o_orderkey, percent_rank() OVER ({W}) AS a, cume_dist() OVER ({W}) AS b, ntile(3) OVER ({W}) AS c FROM orders",
    W03_lag_lead=f"SELECT o_orderkey, lag(o_orderkey, 1, -1) OVER ({W}) AS a, lead(o_orderkey, 2) OVER ({W}) AS b FROM orders",
    W04_values=f"SELECT o_orderkey, first_value(o_orderkey) OVER ({W}) AS a, last_value(o_orderkey) OVER ({W}) AS b, nth_value(o_orderkey, 2) OVER ({W}) AS c FROM orders",
    W06_moving=f"SELECT o_orderkey, round(avg(o_totalprice) OVER ({W} ROWS 2 PRECEDING), 4) AS a FROM orders",
    W07_partition="SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders",
    W08_named=f"SELECT o_orderkey, count(*) OVER w AS n, max(o_totalprice) OVER w AS m FROM orders WINDOW w AS ({W})",
    W09_frames=f"SELECT o_orderkey, count(*) OVER ({W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS a, max(o_orderkey) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM orders",
    W10_top_n=f"SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER ({W}) AS rn FROM orders) WHERE rn <= 3",
    W11_first_order=f"SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER ({W}) AS rn FROM orders) WHERE rn = 1",
)
pair("W05_running", f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER ({W}) AS DOUBLE) AS t FROM orders", f"SELECT o_orderkey, (sum(o_totalprice::DECIMAL(18,2)) OVER ({W}))::DOUBLE AS t FROM orders")
pair("W12_latest", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
pair("W14_distinct_over", "SELECT o_orderkey, CAST(size(collect_set(o_orderstatus) OVER (PARTITION BY o_custkey)) AS BIGINT) AS n FROM orders", "SELECT o_orderkey, count(DISTINCT o_orderstatus) OVER (PARTITION BY o_custkey) AS n FROM orders")

# ---- order and limit ----
same(
    L01_order="SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name",
    L02_nulls="SELECT o_orderkey, nullif(o_orderstatus, 'F') AS st FROM orders ORDER BY st ASC NULLS LAST, o_orderkey",
    L03_order_all="SELECT n_regionkey, n_name FROM nation ORDER BY ALL",
    L04_offset="SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40",
    L05_top_k="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    L07_rank_order="SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey",
)

# ---- functions ----
same(
    F01_case="SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l FROM nation",
    F04_concat="SELECT n_nationkey, n_name || '-' || nullif(n_name, n_name) AS x, n_name || '!' AS y FROM nation",
    F06_concat_ws="SELECT n_nationkey, concat_ws('/', n_name, NULL, 'z') AS x FROM nation",
    F08_replace="SELECT p_partkey, replace(p_name, 'a', 'oo') AS x FROM part",
    F10_substring="SELECT p_partkey, substring(p_name, 2, 4) AS x FROM part",
    F11_extract="SELECT p_partkey, regexp_extract(p_brand, '#([0-9])', 1) AS x FROM part",
    F15_trim="SELECT p_partkey, trim('  ' || p_name || ' ') AS a, ltrim('  x ') AS b, rtrim(' x  ') AS c FROM part",
    F16_pad="SELECT n_nationkey, lpad(n_name, 12, '*') AS a, rpad(n_name, 12, '.') AS b FROM nation",
    F17_md5="SELECT doc_id, md5(text) AS m FROM documents",
    D07_plus_interval="SELECT event_id, ts + INTERVAL 2 DAY AS a, ts - INTERVAL 3 HOUR AS b FROM events",
    D02_extract="SELECT event_id, extract(year FROM ts)::BIGINT AS y, extract(month FROM ts)::BIGINT AS m, extract(hour FROM ts)::BIGINT AS h FROM events",
    M01_round="SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, sign(c_acctbal)::INT AS s, floor(c_acctbal)::BIGINT AS f, ceil(c_acctbal)::BIGINT AS c FROM customer",
    M02_roots="SELECT p_partkey, round(sqrt(p_retailprice), 8) AS a, round(cbrt(p_retailprice), 8) AS b, round(exp(p_size / 50.0e0), 8) AS c, round(ln(p_retailprice), 8) AS d, round(log10(p_retailprice), 8) AS e, round(log2(p_retailprice), 8) AS f FROM part",
    M03_power="SELECT p_partkey, power(p_size, 2)::DOUBLE AS p FROM part",
    M04_mod="SELECT o_orderkey, o_orderkey % 7 AS a, -o_orderkey % 7 AS b FROM orders",
    M05_trig="SELECT p_partkey, round(sin(p_size), 8) AS a, round(cos(p_size), 8) AS b, round(atan2(p_size, 2), 8) AS c FROM part",
    D08_plus_days="SELECT o_orderkey, CAST(o_orderdate AS DATE) + 5 AS x FROM orders",
)
pair("F02_length", "SELECT doc_id, CAST(char_length(text) AS BIGINT) AS n, CAST(bit_length(text) AS BIGINT) AS b FROM documents", "SELECT doc_id, length(text) AS n, bit_length(text)::BIGINT AS b FROM documents")
pair("F07_search", "SELECT p_partkey, CAST(position('e' IN p_name) AS BIGINT) AS a, contains(p_name, 'an') AS b, startswith(p_name, 'b') AS c, endswith(p_name, 'e') AS d FROM part", "SELECT p_partkey, position('e' IN p_name) AS a, contains(p_name, 'an') AS b, starts_with(p_name, 'b') AS c, ends_with(p_name, 'e') AS d FROM part")
pair("F13_split", "SELECT p_partkey, split(p_name, ' ') AS a FROM part", "SELECT p_partkey, string_split(p_name, ' ') AS a FROM part")
pair("F14_split_rows", "SELECT p_partkey, explode(split(p_name, ' ')) AS w FROM part", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part")
pair("F17_sha256", "SELECT doc_id, sha2(text, 256) AS h FROM documents", "SELECT doc_id, sha256(text) AS h FROM documents")
pair("F18_codes", "SELECT n_nationkey, hex(n_name) AS h, base64(encode(n_name, 'UTF-8')) AS b, decode(unhex(hex(n_name)), 'UTF-8') AS s FROM nation", "SELECT n_nationkey, hex(n_name) AS h, to_base64(encode(n_name)) AS b, decode(unhex(hex(n_name))) AS s FROM nation")
pair("D04_trunc", "SELECT event_id, CAST(date_trunc('month', ts) AS TIMESTAMP_NTZ) AS m, CAST(date_trunc('week', ts) AS TIMESTAMP_NTZ) AS w FROM events", "SELECT event_id, date_trunc('month', ts)::TIMESTAMP AS m, date_trunc('week', ts)::TIMESTAMP AS w FROM events")
pair("M07_bits", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS b, o_orderkey ^ 5 AS c, ~o_orderkey AS d, shiftleft(o_orderkey, 2) AS e, CAST(bit_count(o_orderkey) AS INT) AS f FROM orders", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS b, xor(o_orderkey, 5) AS c, ~o_orderkey AS d, o_orderkey << 2 AS e, bit_count(o_orderkey)::INT AS f FROM orders")
pair("M12_division", "SELECT o_orderkey, o_orderkey / 4 AS a, try_divide(o_orderkey, 0) AS b FROM orders", "SELECT o_orderkey, o_orderkey / 4 AS a, o_orderkey / nullif(0, 0) AS b FROM orders")
pair("M13_pages", "SELECT o_orderkey, o_orderkey * 8 div 1024 AS mb FROM orders", "SELECT o_orderkey, o_orderkey * 8 // 1024 AS mb FROM orders")


@frame("SELECT p_partkey, p_name[2:4] AS a, p_name[:-2] AS b, p_name[-3:] AS c FROM part")
def F03_slice(s, d):
    n = F.col("p_name")
    return load(s, d, "part").select("p_partkey", X.slice_text(n, 2, 4).alias("a"), X.slice_text(n, None, -2).alias("b"), X.slice_text(n, -3, None).alias("c"))


@frame("SELECT n_nationkey, concat(n_name, NULL, '!') AS x FROM nation")
def F05_concat_skip(s, d):
    return load(s, d, "nation").select("n_nationkey", X.concat_skip(F.col("n_name"), F.lit(None).cast("string"), F.lit("!")).alias("x"))


@frame("SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '#') AS x FROM part")
def F09_replace_first(s, d):
    return load(s, d, "part").select("p_partkey", X.regexp_replace_first(F.col("p_name"), "[aeiou]", "#").alias("x"))


@frame("SELECT p_partkey, regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 1) AS a, regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 2) AS b FROM part")
def F12_extract_struct(s, d):
    return load(s, d, "part").select("p_partkey", X.extract_struct(F.col("p_brand"), "([A-Za-z]+)#([0-9]+)", ["a", "b"]).alias("m")).select("p_partkey", "m.*")


@frame("SELECT event_id, dayofweek(ts) AS d FROM events")
def D03_dow(s, d):
    return load(s, d, "events").select("event_id", X.dow(F.col("ts")).alias("d"))


@frame("SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S %j') AS a, strftime(ts, 'w%w u%u') AS b FROM events")
def D05_strftime(s, d):
    return load(s, d, "events").select("event_id", X.strftime(F.col("ts"), "%Y/%m/%d %H:%M:%S %j").alias("a"), X.strftime(F.col("ts"), "w%w u%u").alias("b"))


@frame("SELECT event_id, strptime(strftime(ts, '%d.%m.%Y'), '%d.%m.%Y')::TIMESTAMP AS a FROM events")
def D06_strptime(s, d):
    return load(s, d, "events").select("event_id", X.strptime(X.strftime(F.col("ts"), "%d.%m.%Y"), "%d.%m.%Y").cast("timestamp_ntz").alias("a"))


@frame("SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate) AS a, date_diff('month', o_orderdate, l_shipdate) AS b, date_diff('year', o_orderdate, l_shipdate) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def D10_date_diff(s, d):
    t = load(s, d, "lineitem").join(load(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    a, b = F.col("o_orderdate"), F.col("l_shipdate")
    return t.select("l_orderkey", "l_linenumber", *(X.date_diff(u, a, b).alias(n) for u, n in (("day", "a"), ("month", "b"), ("year", "c"))))


@frame("SELECT DISTINCT o_orderdate::DATE AS order_date, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, weekofyear(o_orderdate)::INT AS week, dayofweek(o_orderdate)::INT AS weekday FROM orders")
def D13_date_dimension(s, d):
    return metrics.star(load(s, d, "orders"), load(s, d, "customer"), load(s, d, "nation"))["dim_date"]


@frame("SELECT c_custkey, c_name, n_name, c_mktsegment FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def X17_dim_customer(s, d):
    return metrics.star(load(s, d, "orders"), load(s, d, "customer"), load(s, d, "nation"))["dim_customer"]


# ---- nested ----
pair("N01_lists", "SELECT vec_id, size(embedding) AS n, embedding[0] AS a, slice(embedding, 2, 3) AS b FROM embeddings", "SELECT vec_id, len(embedding)::INT AS n, embedding[1] AS a, embedding[2:4] AS b FROM embeddings")
pair("N03_transform", "SELECT o_orderkey, transform(array(o_orderkey, o_custkey), x -> x * 2) AS a FROM orders", "SELECT o_orderkey, list_transform([o_orderkey, o_custkey], lambda x: x * 2) AS a FROM orders")
pair("N04_filter", "SELECT o_orderkey, filter(array(o_orderkey, o_custkey), x -> x % 2 = 0) AS a FROM orders", "SELECT o_orderkey, list_filter([o_orderkey, o_custkey], lambda x: x % 2 = 0) AS a FROM orders")
pair("N07_struct", "SELECT s.a AS a, s.b AS b FROM (SELECT named_struct('a', n_name, 'b', n_regionkey) AS s FROM nation)", "SELECT s.a AS a, s['b'] AS b FROM (SELECT {'a': n_name, 'b': n_regionkey} AS s FROM nation)")
pair("N08_map", "SELECT n_nationkey, m['k'] AS v, map_keys(m) AS k FROM (SELECT n_nationkey, map('k', n_name) AS m FROM nation)", "SELECT n_nationkey, m['k'] AS v, map_keys(m) AS k FROM (SELECT n_nationkey, MAP {'k': n_name} AS m FROM nation)")
pair("N10_unnest", "SELECT vec_id, explode(embedding) AS x FROM embeddings", "SELECT vec_id, unnest(embedding) AS x FROM embeddings")
pair("N14_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
pair("N13_variant", "SELECT event_id, variant_get(parse_json(props), '$.k', 'bigint') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
pair("N02_list_concat", "SELECT n_nationkey, concat(array(n_name), array('x', 'y')) AS a FROM nation", "SELECT n_nationkey, list_concat([n_name], ['x', 'y']) AS a FROM nation")


@frame("SELECT o_orderkey, list_reduce([o_orderkey, o_custkey, 5], lambda x, y: x + y) AS t FROM orders")
def N05_reduce(s, d):
    return load(s, d, "orders").select("o_orderkey", X.reduce_list(F.array("o_orderkey", "o_custkey", F.lit(5).cast("long")), lambda x, y: x + y).alias("t"))


# ---- changes ----
def _targets(s, d):
    """All customers as the target; all suppliers, under the customers' names for columns, as the source: some keys meet, others do not."""
    c = load(s, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("decimal(18,2)").alias("bal"))
    u = load(s, d, "supplier").select((F.col("s_suppkey") * 2).alias("c_custkey"), F.lit("supplier").alias("c_name"), (F.col("s_acctbal").cast("decimal(18,2)") + 1).cast("decimal(18,2)").alias("bal"))
    return c, u.unionByName(u.withColumn("c_custkey", -F.col("c_custkey") - 1))


T_SQL = "WITH t AS (SELECT c_custkey, c_name, c_acctbal::DECIMAL(18,2) AS bal FROM customer), u AS (SELECT s_suppkey * 2 AS c_custkey, 'supplier' AS c_name, (s_acctbal::DECIMAL(18,2) + 1)::DECIMAL(18,2) AS bal FROM supplier), s AS (SELECT * FROM u UNION ALL SELECT -c_custkey - 1, c_name, bal FROM u) "


@frame(T_SQL + "SELECT * FROM t UNION ALL SELECT * FROM s WHERE c_custkey NOT IN (SELECT c_custkey FROM t)")
def X05_insert_ignore(s, d):
    t, src = _targets(s, d)
    return dml.insert_ignore(t, src, ["c_custkey"])


@frame(T_SQL + "SELECT * FROM t WHERE c_custkey NOT IN (SELECT c_custkey FROM s) UNION ALL SELECT * FROM s")
def X06_upsert(s, d):
    t, src = _targets(s, d)
    return dml.upsert(t, src, ["c_custkey"])


@frame(T_SQL + "SELECT t.c_custkey, t.c_name, coalesce(s.bal, t.bal) AS bal FROM t LEFT JOIN s USING (c_custkey)")
def X08_update_from(s, d):
    t, src = _targets(s, d)
    return dml.update_from(t, src, ["c_custkey"], {"bal": "s.bal"})


@frame(T_SQL + "SELECT * FROM t WHERE c_custkey NOT IN (SELECT c_custkey FROM s)")
def X09_delete_using(s, d):
    t, src = _targets(s, d)
    return dml.delete_using(t, src, ["c_custkey"])


@frame(T_SQL + "SELECT t.c_custkey, t.c_name, CASE WHEN s.c_custkey IS NULL THEN t.bal ELSE s.bal END AS bal FROM t LEFT JOIN s USING (c_custkey) WHERE NOT (s.c_custkey IS NOT NULL AND t.bal < 0) UNION ALL SELECT * FROM s WHERE bal > 100 AND c_custkey NOT IN (SELECT c_custkey FROM t)")
def X10_merge(s, d):
    t, src = _targets(s, d)
    return dml.merge(t, src, ["c_custkey"], matched=[("t.bal < 0", "delete", None), (None, "update", {"bal": "s.bal"})], unmatched=[("s.bal > 100", None)])


@frame(T_SQL + "SELECT * FROM t WHERE NOT (c_custkey >= 10 AND c_custkey < 50) UNION ALL SELECT * FROM s WHERE c_custkey >= 10 AND c_custkey < 50")
def I08_delete_insert(s, d):
    t, src = _targets(s, d)
    return ingest.apply("delete+insert", t, src, incremental_key="c_custkey", start=10, end=50)


@frame(T_SQL + "SELECT * FROM t WHERE c_custkey NOT IN (SELECT c_custkey FROM s) UNION ALL SELECT * FROM s")
def I09_merge(s, d):
    t, src = _targets(s, d)
    return ingest.apply("merge", t, src, key=["c_custkey"])


@frame("SELECT user_id, event_type, ts, ts AS _scd_valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS _scd_valid_to FROM (SELECT user_id, event_type, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS b FROM (SELECT DISTINCT user_id, event_type, ts FROM events)) WHERE b IS NULL OR b <> event_type")
def I10_scd2(s, d):
    e = load(s, d, "events").select("user_id", "event_type", "ts").distinct()
    return ingest.apply("scd2", None, e, key=["user_id"], incremental_key="ts")


@frame("SELECT c_custkey, sha256(c_name) AS c_name, CASE WHEN length(c_mktsegment) > 3 THEN repeat('*', length(c_mktsegment) - 3) ELSE '' END || right(c_mktsegment, 3) AS c_mktsegment, NULL::DOUBLE AS c_acctbal FROM customer")
def I22_mask(s, d):
    return ingest.mask(load(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), "c_name:hash", "c_mktsegment:partial:3", "c_acctbal:nullify")


@frame("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def I32_changes(s, d):
    e = load(s, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "D").otherwise("U").alias("op"))
    return ingest.changes(e.limit(0).select("user_id", "event_id"), e, ["user_id"], lsn="event_id")


@frame("SELECT 'same' AS pair, count(*) AS source_rows, count(DISTINCT o_orderkey) AS source_keys, count(*) AS target_rows, count(DISTINCT o_orderkey) AS target_keys, true AS equal FROM orders UNION ALL SELECT 'lines', (SELECT count(*) FROM orders), (SELECT count(DISTINCT o_orderkey) FROM orders), count(*), count(DISTINCT l_orderkey), false FROM lineitem")
def I34_reconcile(s, d):
    t = load(s, d, "orders")
    lines = load(s, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    pairs = [ingest.reconcile(t, x, ["o_orderkey"]).withColumn("pair", F.lit(n)) for n, x in (("same", t), ("lines", lines))]
    return pairs[0].unionByName(pairs[1])


@frame("SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, event_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g")
def T06_sessions(s, d):
    from ..streaming.feeds import sessions

    return sessions(load(s, d, "events"), "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@frame("SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def T05_tumbling(s, d):
    from ..streaming.feeds import windowed

    return windowed(load(s, d, "events"), "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


from . import records  # noqa: E402, F401, I001
from . import more_sql  # noqa: E402, F401
from . import more_tables  # noqa: E402, F401
from . import more_ingest  # noqa: E402, F401
from . import more_records  # noqa: E402, F401
