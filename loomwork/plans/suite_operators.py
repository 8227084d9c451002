"""A query for each operator of the survey: scans, sinks, expressions, joins, aggregates, windows, sets, functions."""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork import operators as ops
from loomwork import sources
from loomwork.plans.registry import frame_query, sql_query
from loomwork.scratch import shared_folder

# ---------------------------------------------------------------- scans and sinks

sql_query("scan_parquet_pushdown", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 100 AND 500 AND l_returnflag = 'A'")
sql_query("scan_values", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t (k, v)")
sql_query("scan_one_row", "SELECT 1 AS one, 'x' AS x")
sql_query("scan_empty", "SELECT l_orderkey, l_quantity FROM lineitem WHERE 1 = 0")
sql_query("generate_series_int", "SELECT value FROM generate_series(1, 20, 3) AS t", "SELECT value FROM generate_series(1, 20, 3) AS t (value)")
sql_query("generate_series_down", "SELECT value FROM generate_series(10, 1, -4) AS t", "SELECT value FROM generate_series(10, 1, -4) AS t (value)")
sql_query("view_scan", "WITH v AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F') SELECT o_custkey, count(*) AS n FROM v GROUP BY o_custkey")
sql_query("cte_reused", "WITH c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.n AS n, count(*) AS m FROM c a JOIN c b ON a.n = b.n AND a.k < b.k GROUP BY a.n")


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/loomwork-io/{uuid.uuid4().hex}"


ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


def _round_trip(kind: str, schema: str | None = None, **options):
    @frame_query(ORDERS)
    def run(spark, t):
        path = _folder(spark)
        df = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
        sources.write(df, kind, path, **options)
        own = schema or (df.schema if kind in ("csv", "json") else None)
        return sources.read(spark, kind, path, own, **({"header": "true"} if kind == "csv" else {})).select(*df.columns)

    return run


def _named(name: str, run) -> None:
    from loomwork.plans import registry

    registry.QUERIES[name], registry.SQL[name] = registry.QUERIES.pop("run"), registry.SQL.pop("run")


for kind in ("parquet", "csv", "json", "orc"):
    _named(f"sink_{kind}", _round_trip(kind))


@frame_query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def sink_partitioned(spark, t):
    path = _folder(spark)
    sources.write(t("orders"), "parquet", path, ["o_orderstatus"])
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@frame_query("SELECT r_regionkey, r_name FROM region")
def sink_single_file(spark, t):
    path = f"{_folder(spark)}/one.csv"
    sources.write(t("region"), "csv", path)
    return spark.read.csv(path, header=True, schema="r_regionkey int, r_name string")


@frame_query("SELECT r_regionkey, r_name FROM region")
def scan_tbl(spark, t):
    path = _folder(spark)
    t("region").select(F.concat_ws("|", F.col("r_regionkey").cast("string"), "r_name", F.lit("")).alias("value")).write.text(path)
    return sources.read_tbl(spark, path, "r_regionkey int, r_name string")


@frame_query("SELECT n_nationkey, n_name FROM nation")
def copy_to_and_external_table(spark, t):
    from loomwork.session import Loom

    loom, path, name = Loom(spark), _folder(spark), f"ext_{uuid.uuid4().hex[:8]}"
    t("nation").createOrReplaceTempView("nation")
    loom.sql(f"COPY (SELECT n_nationkey, n_name FROM nation) TO '{path}' STORED AS CSV OPTIONS ('format.has_header' 'true')")
    loom.sql(f"CREATE EXTERNAL TABLE {name} (n_nationkey INT NOT NULL, n_name VARCHAR) STORED AS CSV OPTIONS ('format.has_header' 'true') LOCATION '{path}'")
    return loom.table(name)


@frame_query("SELECT count(*) + 2 AS n FROM region")
def insert_into_and_ctas(spark, t):
    path, name = _folder(spark), f"ins_{uuid.uuid4().hex[:8]}"
    t("region").createOrReplaceTempView("region")
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}' AS SELECT * FROM region")
    spark.sql(f"INSERT INTO {name} VALUES (100, 'x'), (101, 'y')")
    n = spark.read.parquet(path).agg(F.count("*").alias("n"))
    spark.sql(f"DROP TABLE {name}")
    return n


@frame_query("SELECT count(*) AS n FROM orders WHERE o_custkey > 50 AND o_orderstatus = 'F'")
def prepare_and_execute(spark, t):
    from loomwork.session import Loom

    loom = Loom(spark)
    t("orders").createOrReplaceTempView("orders")
    loom.sql("PREPARE q (BIGINT, STRING) AS SELECT count(*) AS n FROM orders WHERE o_custkey > $1 AND o_orderstatus = $2")
    return loom.sql("EXECUTE q (50, 'F')")


# ---------------------------------------------------------------- expressions and predicates

sql_query("expr_arithmetic", "SELECT l_orderkey, l_linenumber, l_linenumber + 2 AS a, l_linenumber - 7 AS b, l_linenumber * 3 AS c, l_linenumber % 3 AS d, -l_linenumber AS e, (l_linenumber > 2) AND NOT (l_quantity < 10) AS f FROM lineitem")
sql_query("expr_bits", "SELECT l_orderkey, l_linenumber, l_orderkey & 12 AS a, l_orderkey | 5 AS b FROM lineitem")
sql_query("expr_concat_null", "SELECT n_nationkey, n_name || '-' || CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS s FROM nation")
sql_query("expr_distinct_from", "SELECT n_nationkey, nullif(n_regionkey, 1) IS DISTINCT FROM nullif(n_nationkey, 2) AS d, nullif(n_regionkey, 1) IS NOT DISTINCT FROM NULL AS e FROM nation")
sql_query("expr_truth", "SELECT n_nationkey, (nullif(n_regionkey, 1) > 2) IS TRUE AS t, (nullif(n_regionkey, 1) > 2) IS NOT FALSE AS f, (nullif(n_regionkey, 1) > 2) IS UNKNOWN AS u FROM nation",
          "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1) > 2, false) AS t, coalesce(nullif(n_regionkey, 1) > 2, true) AS f, (nullif(n_regionkey, 1) > 2) IS NULL AS u FROM nation")
sql_query("expr_null_tests", "SELECT count(*) AS n FROM nation WHERE nullif(n_regionkey, 1) IS NULL OR nullif(n_nationkey, 3) IS NOT NULL")
sql_query("expr_between_in", "SELECT count(*) AS n FROM part WHERE p_size BETWEEN 5 AND 20 AND p_size NOT BETWEEN 10 AND 12 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_size NOT IN (6, 7)")
sql_query("expr_like", "SELECT p_partkey, p_name LIKE '%a_e%' AS a, p_name ILIKE '%A%' AS b, p_type NOT LIKE 'PROMO%' AS c, '10%' LIKE '10!%' ESCAPE '!' AS d FROM part")
sql_query("expr_similar", "SELECT p_partkey, p_brand SIMILAR TO 'Brand#(1|2)%' AS s FROM part", "SELECT p_partkey, regexp_full_match(p_brand, 'Brand#(1|2).*') AS s FROM part")
sql_query("expr_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS a, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' END AS b FROM orders")
sql_query("expr_cast", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS a, CAST(l_linenumber AS STRING) AS b, TRY_CAST(l_returnflag AS INT) AS c, CAST(l_shipdate AS DATE) AS d FROM lineitem",
          "SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS INT) AS a, CAST(l_linenumber AS VARCHAR) AS b, TRY_CAST(l_returnflag AS INT) AS c, CAST(l_shipdate AS DATE) AS d FROM lineitem")
sql_query("expr_struct_list", "SELECT n_nationkey, named_struct('a', n_name, 'b', n_regionkey).b AS b, element_at(array(n_nationkey, 7, 9), 2) AS l, array_join(slice(array('x', 'y', n_name), 2, 2), '/') AS s FROM nation",
          "SELECT n_nationkey, n_regionkey AS b, 7 AS l, 'y/' || n_name AS s FROM nation")
sql_query("subquery_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
sql_query("subquery_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
sql_query("subquery_exists_or", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR c_acctbal > 9000")
sql_query("subquery_not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(r_regionkey, 2) FROM region)")
sql_query("subquery_not_in", "SELECT n_nationkey FROM nation WHERE nullif(n_nationkey, 9) NOT IN (SELECT r_regionkey FROM region)")
sql_query("subquery_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders p WHERE p.o_custkey = o.o_custkey)")


@frame_query("SELECT o_orderkey FROM orders WHERE nullif(o_orderkey, 8) NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def not_in_large(spark, t):
    orders = t("orders").select("o_orderkey", F.expr("nullif(o_orderkey, 8)").alias("k"))
    return ops.not_in(orders, "k", t("lineitem").where("l_quantity > 40"), "l_orderkey").select("o_orderkey")


@frame_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE CASE l_linenumber % 3 WHEN 0 THEN l_quantity > 10 WHEN 1 THEN l_quantity < 20 ELSE l_returnflag = 'R' END")
def per_partition_filter(spark, t):
    df = ops.per_partition_filter(t("lineitem"), F.col("l_linenumber") % 3, ["l_quantity > 10", "l_quantity < 20", "l_returnflag = 'R'"])
    return df.select("l_orderkey", "l_linenumber")


@frame_query("SELECT b AS bucket, count(*) AS n FROM orders, (VALUES (0), (1), (2)) AS v (b) WHERE (b = 0 AND o_custkey < 55) OR (b = 1 AND o_custkey >= 45 AND o_custkey < 105) OR (b = 2 AND o_custkey >= 95) GROUP BY b")
def range_filter(spark, t):
    return ops.range_filter(t("orders"), "o_custkey", [50, 100], 5, 5).groupBy("bucket").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- joins

PAIRS = "FROM customer {} orders ON c_custkey = o_custkey AND o_totalprice > 350000"
for kind in ("INNER", "LEFT", "RIGHT", "FULL"):
    sql_query(f"join_{kind.lower()}", f"SELECT c_custkey, o_orderkey {PAIRS.format(kind + ' JOIN')}")
sql_query("join_left_semi", f"SELECT c_custkey {PAIRS.format('LEFT SEMI JOIN')}", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 350000)")
sql_query("join_left_anti", f"SELECT c_custkey {PAIRS.format('LEFT ANTI JOIN')}", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 350000)")
sql_query("join_right_semi", "SELECT c_custkey FROM orders RIGHT SEMI JOIN customer ON c_custkey = o_custkey AND o_totalprice > 400000", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 400000)")
sql_query("join_right_anti", "SELECT c_custkey FROM orders RIGHT ANTI JOIN customer ON c_custkey = o_custkey AND o_totalprice > 350000", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 350000)")
sql_query("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey + b.n_regionkey > 5")
sql_query("join_cross", "SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region")
sql_query("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND n_nationkey < 20")
sql_query("join_null_safe", "SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a JOIN region b ON nullif(a.n_regionkey, 1) IS NOT DISTINCT FROM nullif(b.r_regionkey, 3)")
sql_query("join_using", "SELECT k, x, y FROM (SELECT o_custkey AS k, o_orderkey AS x FROM orders) JOIN (SELECT c_custkey AS k, c_nationkey AS y FROM customer) USING (k)",
          "SELECT k, x, y FROM (SELECT o_custkey AS k, o_orderkey AS x FROM orders) a JOIN (SELECT c_custkey AS k, c_nationkey AS y FROM customer) b USING (k)")
sql_query("join_natural", "SELECT k, x, y FROM (SELECT o_custkey AS k, o_orderkey AS x FROM orders) a NATURAL JOIN (SELECT c_custkey AS k, c_nationkey AS y FROM customer) b")
sql_query("join_residual", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_quantity * 10 < o_totalprice")
for how in ("hash", "merge", "broadcast"):
    hint = {"hash": "SHUFFLE_HASH", "merge": "MERGE", "broadcast": "BROADCAST"}[how]
    sql_query(f"join_strategy_{how}", f"SELECT /*+ {hint}(c) */ o_orderkey, c_nationkey FROM orders o JOIN customer c ON o_custkey = c_custkey")


@frame_query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS mark FROM customer")
def join_mark(spark, t):
    return ops.join(t("customer").select("c_custkey"), t("orders").where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left_mark")


# ---------------------------------------------------------------- aggregates

sql_query("agg_basic", "SELECT o_orderstatus, min(o_totalprice) AS a, max(o_totalprice) AS b, round(sum(o_totalprice), 2) AS c, round(avg(o_totalprice), 4) AS d, count(o_custkey) AS e, count(*) AS f FROM orders GROUP BY o_orderstatus")
sql_query("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INT) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority), ())")
sql_query("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql_query("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping_id(o_orderstatus, o_orderpriority) AS INT) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql_query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
sql_query("agg_distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql_query("agg_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS a, count(DISTINCT o_orderpriority) AS b, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS c FROM orders GROUP BY o_orderstatus")
sql_query("agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 250000) AS a, round(sum(o_totalprice) FILTER (WHERE o_custkey % 2 = 0), 2) AS b FROM orders GROUP BY o_orderstatus")
sql_query("agg_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC NULLS LAST, o_orderkey")
sql_query("agg_top_groups", "SELECT o_custkey, max(o_orderkey) AS m FROM orders GROUP BY o_custkey ORDER BY m DESC NULLS LAST LIMIT 10")
sql_query("agg_ungrouped_empty", "SELECT count(*) AS n, max(o_custkey) AS m FROM orders WHERE o_custkey < 0")
sql_query("agg_statistics", "SELECT round(var(l_quantity), 6) AS a, round(var_pop(l_quantity), 6) AS b, round(stddev(l_quantity), 6) AS c, round(stddev_pop(l_quantity), 6) AS d, round(covar(l_quantity, l_discount), 6) AS e, round(corr(l_quantity, l_extendedprice), 6) AS f, round(covar_pop(l_quantity, l_tax), 6) AS g FROM lineitem",
          "SELECT round(var_samp(l_quantity), 6) AS a, round(var_pop(l_quantity), 6) AS b, round(stddev(l_quantity), 6) AS c, round(stddev_pop(l_quantity), 6) AS d, round(covar_samp(l_quantity, l_discount), 6) AS e, round(corr(l_quantity, l_extendedprice), 6) AS f, round(covar_pop(l_quantity, l_tax), 6) AS g FROM lineitem")
sql_query("agg_percentile", "SELECT l_returnflag, round(approx_percentile_cont(l_extendedprice, 0.3), 4) AS a, round(median(l_extendedprice), 4) AS b, round(approx_percentile_cont_with_weight(l_extendedprice, l_linenumber, 0.5), 4) AS c, round(approx_percentile_cont(0.9) WITHIN GROUP (ORDER BY l_quantity), 4) AS d FROM lineitem GROUP BY l_returnflag",
          "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.3), 4) AS a, round(median(l_extendedprice), 4) AS b, (SELECT round(quantile_cont(w.l_extendedprice, 0.5), 4) FROM lineitem w, range(w.l_linenumber) WHERE w.l_returnflag = lineitem.l_returnflag) AS c, round(quantile_cont(l_quantity, 0.9), 4) AS d FROM lineitem GROUP BY l_returnflag")
sql_query("agg_approx_distinct", "SELECT o_orderstatus, approx_distinct(o_orderpriority) AS few, abs(approx_distinct(o_custkey) - count(DISTINCT o_custkey)) < 0.1 * count(DISTINCT o_custkey) AS close, count(DISTINCT o_custkey) AS exact FROM orders GROUP BY o_orderstatus",
          "SELECT o_orderstatus, count(DISTINCT o_orderpriority) AS few, true AS close, count(DISTINCT o_custkey) AS exact FROM orders GROUP BY o_orderstatus")
sql_query("agg_array", "SELECT n_regionkey, array_join(array_sort(array_agg(n_name)), ',') AS a, size(array_agg_all(nullif(n_nationkey, 3))) AS n FROM nation GROUP BY n_regionkey",
          "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS a, CAST(count(*) AS INTEGER) AS n FROM nation GROUP BY n_regionkey")
sql_query("agg_string", "SELECT n_regionkey, string_agg(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS a FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS a FROM nation GROUP BY n_regionkey")
sql_query("agg_bool_bits", "SELECT o_orderstatus, bool_and(o_custkey > 3) AS a, bool_or(o_custkey > 140) AS b, bit_and(o_orderkey) AS c, bit_or(o_orderkey) AS d, bit_xor(o_orderkey) AS e FROM orders GROUP BY o_orderstatus")
sql_query("agg_regression", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS a, round(regr_intercept(l_extendedprice, l_quantity), 2) AS b, round(regr_r2(l_extendedprice, l_quantity), 6) AS c, regr_count(l_extendedprice, l_quantity) AS d FROM lineitem",
          "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS a, round(regr_intercept(l_extendedprice, l_quantity), 2) AS b, round(regr_r2(l_extendedprice, l_quantity), 6) AS c, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS d FROM lineitem")
sql_query("agg_first_last", "SELECT o_custkey, min_by(o_orderkey, o_totalprice) AS a, max_by(o_orderkey, o_totalprice) AS b FROM orders GROUP BY o_custkey")

# ---------------------------------------------------------------- windows

W = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)"
for name, expr in {
    "rank": "CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS BIGINT)", "dense_rank": "CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS BIGINT)",
    "percent_rank": f"round(percent_rank() {W}, 8)", "cume_dist": f"round(cume_dist() {W}, 8)", "ntile": f"CAST(ntile(3) {W} AS BIGINT)", "lag": f"lag(o_orderkey, 2, -1) {W}",
    "lead": f"lead(o_orderkey) {W}", "first_value": f"first_value(o_orderkey) {W}", "last_value": "last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "nth_value": f"nth_value(o_orderkey, 2) {W}", "whole": "count(*) OVER ()", "rows_frame": "count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)",
}.items():
    sql_query(f"window_{name}", f"SELECT o_orderkey, {expr} AS w FROM orders")
sql_query("window_of_aggregate", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS total, CAST(rank() OVER (ORDER BY count(*) DESC NULLS LAST, o_orderstatus, o_orderpriority) AS BIGINT) AS r FROM orders GROUP BY o_orderstatus, o_orderpriority")
sql_query("window_qualify", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) = 1")


@frame_query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS w FROM orders")
def window_groups(spark, t):
    return ops.groups_frame(t("orders"), ["o_orderstatus"], [F.col("o_custkey")], -2, 1, lambda w: F.count("*").over(w), "w").select("o_orderkey", "w")


@frame_query("SELECT o_orderkey, (SELECT count(DISTINCT p.o_custkey) FROM orders p WHERE p.o_orderstatus = o.o_orderstatus) AS w FROM orders o")
def window_count_distinct(spark, t):
    df = ops.count_distinct_window(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderstatus"], "o_custkey", "w")
    return df.select("o_orderkey", F.when(F.col("o_orderstatus").isNull(), 0).otherwise(F.col("w")).alias("w"))  # nothing equals null


@frame_query("SELECT o_orderkey, count(*) OVER w AS n, min(o_orderkey) OVER w AS low FROM (SELECT o_orderkey, nullif(o_custkey, 7) AS k FROM orders) WINDOW w AS (ORDER BY k NULLS LAST RANGE BETWEEN 5 PRECEDING AND 3 FOLLOWING)")
def window_parallel_range(spark, t):
    df = t("orders").select("o_orderkey", F.expr("nullif(o_custkey, 7)").alias("k"))
    one = ops.parallel_range_window(df, "k", 5, 3, lambda w: F.struct(F.count("*").over(w).alias("n"), F.min("o_orderkey").over(w).alias("low")), "w", 6)
    return one.select("o_orderkey", "w.n", "w.low")


# ---------------------------------------------------------------- sort, limit, exchange

sql_query("sort_nulls", "SELECT k, x FROM (SELECT nullif(n_regionkey, 2) AS k, n_nationkey AS x FROM nation) AS t ORDER BY k ASC NULLS FIRST, x DESC NULLS LAST LIMIT 12")
sql_query("sort_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 25")
sql_query("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 37")


@frame_query("SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, true AS rising FROM orders")
def ordered_range_repartition(spark, t):
    df = ops.ordered_ranges(t("orders"), "o_totalprice", 6).withColumn("p", F.spark_partition_id())
    by = df.groupBy("p").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.count("*").alias("n"), F.sum("o_custkey").alias("s"))
    by = by.withColumn("ok", F.coalesce(F.col("lo") >= F.max("hi").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    return by.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("ok").alias("rising"))


@frame_query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, true AS apart, 5 AS parts FROM orders")
def unordered_range_repartition(spark, t):
    df = ops.unordered_ranges(t("orders"), "o_custkey", 5)
    by = df.groupBy(F.spark_partition_id().alias("p")).agg(F.min("o_custkey").alias("lo"), F.max("o_custkey").alias("hi"), F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))
    by = by.withColumn("apart", F.coalesce(F.col("lo") > F.lag("hi").over(Window.orderBy("lo")), F.lit(True)))  # a row for each partition
    return by.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("apart").alias("apart"), F.count("*").cast("int").alias("parts"))


@frame_query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def hash_repartition(spark, t):
    return ops.hash_repartition(t("orders"), 5, "o_orderstatus").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@frame_query("SELECT count(*) AS rows, min(o_custkey) AS least, max(o_custkey) AS greatest FROM orders")
def runtime_stats(spark, t):
    df, tap = ops.runtime_stats(t("orders"), "o_custkey", f"stats_{uuid.uuid4().hex[:6]}")
    df.write.format("noop").mode("overwrite").save()
    got = tap.get
    return spark.createDataFrame([(got["rows"], got["least"], got["greatest"])], "rows long, least long, greatest long")


# ---------------------------------------------------------------- sets, nesting, recursion

A, B = "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 2000"
for name, word in {"union_all": "UNION ALL", "union": "UNION", "intersect": "INTERSECT", "except": "EXCEPT", "intersect_all": "INTERSECT ALL", "except_all": "EXCEPT ALL"}.items():
    sql_query(f"set_{name}", f"{A} {word} {B}")
sql_query("unnest_list", "SELECT n_nationkey, unnest(make_array(n_nationkey, n_regionkey, 7)) AS u FROM nation", "SELECT n_nationkey, unnest([n_nationkey, n_regionkey, 7]) AS u FROM nation")
sql_query("recursive_cte", "WITH RECURSIVE t (n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 12) SELECT n, f FROM t")
sql_query("recursive_distinct", "WITH RECURSIVE t (n) AS (SELECT 0 AS n UNION SELECT (n * 3 + 1) % 17 AS n FROM t) SELECT n FROM t")
sql_query("subquery_alias_columns", "SELECT a, b FROM (SELECT n_nationkey, n_name FROM nation) AS t (a, b)")


@frame_query("SELECT n_nationkey, unnest([n_name, 'x']) AS a, unnest([n_regionkey, NULL]) AS b FROM nation")
def unnest_parallel(spark, t):
    df = t("nation").select("n_nationkey", F.array("n_name", F.lit("x")).alias("a"), F.array("n_regionkey").alias("b"))
    return ops.unnest(df, ["a", "b"])


@frame_query("SELECT n_nationkey, n_name AS p, n_regionkey AS q FROM nation")
def unnest_struct(spark, t):
    return ops.unnest(t("nation").select("n_nationkey", F.struct(F.col("n_name").alias("p"), F.col("n_regionkey").alias("q")).alias("s")), ["s"])


@frame_query("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region")
def set_interleave(spark, t):
    return ops.interleave(t("nation").select(F.col("n_nationkey").alias("k")), t("region").select("r_regionkey"))


# ---------------------------------------------------------------- functions

sql_query("fn_math", """
    SELECT p_partkey, abs(p_size - 20) AS a, round(sqrt(p_size), 8) AS b, round(power(p_size, 2), 4) AS c, round(exp(p_size / 50.0), 8) AS d, round(ln(p_size), 8) AS e, round(log10(p_size), 8) AS f,
           CAST(floor(p_retailprice) AS BIGINT) AS g, CAST(ceil(p_retailprice) AS BIGINT) AS h, CAST(sign(p_size - 20) AS DOUBLE) AS i, round(sin(p_size), 8) AS j, round(degrees(p_size), 6) AS k,
           round(cbrt(p_size), 8) AS l, round(atan2(p_size, 3), 8) AS m, round(pi(), 8) AS n, gcd(p_size, 12) AS o, lcm(p_size, 12) AS q FROM part""", """
    SELECT p_partkey, abs(p_size - 20) AS a, round(sqrt(p_size), 8) AS b, round(power(p_size, 2), 4) AS c, round(exp(p_size / 50.0), 8) AS d, round(ln(p_size), 8) AS e, round(log10(p_size), 8) AS f,
           CAST(floor(p_retailprice) AS BIGINT) AS g, CAST(ceil(p_retailprice) AS BIGINT) AS h, CAST(sign(p_size - 20) AS DOUBLE) AS i, round(sin(p_size), 8) AS j, round(degrees(p_size), 6) AS k,
           round(cbrt(p_size), 8) AS l, round(atan2(p_size, 3), 8) AS m, round(pi(), 8) AS n, CAST(gcd(p_size, 12) AS BIGINT) AS o, CAST(lcm(p_size, 12) AS BIGINT) AS q FROM part""")
sql_query("fn_string", """
    SELECT p_partkey, upper(p_name) AS a, lower(p_type) AS b, CAST(length(p_name) AS BIGINT) AS c, substr(p_name, 2, 3) AS d, replace(p_name, 'a', '#') AS e, reverse(p_brand) AS f, lpad(p_brand, 12, '*') AS g,
           rpad(p_brand, 12, '*') AS h, concat(p_name, '/', p_brand) AS i, concat_ws('-', p_name, p_brand) AS j, CAST(strpos(p_name, 'e') AS BIGINT) AS k, starts_with(p_type, 'PROMO') AS l, left(p_name, 2) AS m,
           right(p_name, 2) AS n, repeat('ab', 2) AS o, split_part(p_type, ' ', 1) AS q, translate(p_brand, '#B', '-b') AS r, trim('  x ') AS s, CAST(ascii(p_name) AS INT) AS t, chr(65) AS u, CAST(levenshtein(p_name, p_brand) AS BIGINT) AS v,
           ends_with(p_type, 'EEL') AS w, contains(p_type, 'R') AS x, CAST(bit_length(p_name) AS BIGINT) AS y, CAST(octet_length(p_name) AS BIGINT) AS z FROM part""", """
    SELECT p_partkey, upper(p_name) AS a, lower(p_type) AS b, length(p_name) AS c, substr(p_name, 2, 3) AS d, replace(p_name, 'a', '#') AS e, reverse(p_brand) AS f, lpad(p_brand, 12, '*') AS g,
           rpad(p_brand, 12, '*') AS h, concat(p_name, '/', p_brand) AS i, concat_ws('-', p_name, p_brand) AS j, strpos(p_name, 'e') AS k, starts_with(p_type, 'PROMO') AS l, left(p_name, 2) AS m,
           right(p_name, 2) AS n, repeat('ab', 2) AS o, split_part(p_type, ' ', 1) AS q, translate(p_brand, '#B', '-b') AS r, trim('  x ') AS s, CAST(ascii(p_name) AS INT) AS t, chr(65) AS u, CAST(levenshtein(p_name, p_brand) AS BIGINT) AS v,
           ends_with(p_type, 'EEL') AS w, contains(p_type, 'R') AS x, CAST(bit_length(p_name) AS BIGINT) AS y, CAST(strlen(p_name) AS BIGINT) AS z FROM part""")
sql_query("fn_regex", "SELECT p_partkey, regexp_like(p_type, '^P.*L$') AS a, regexp_replace(p_name, '[aeiou]+', '_') AS b, CAST(regexp_count(p_name, '[aeiou]') AS BIGINT) AS c FROM part",
          "SELECT p_partkey, regexp_matches(p_type, '^P.*L$') AS a, regexp_replace(p_name, '[aeiou]+', '_', 'g') AS b, CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS BIGINT) AS c FROM part")
sql_query("fn_crypto", "SELECT p_partkey, md5(p_name) AS a, sha1(p_name) AS b, sha256(p_name) AS c, to_hex(p_partkey) AS d FROM part", "SELECT p_partkey, md5(p_name) AS a, sha1(p_name) AS b, sha256(p_name) AS c, lower(to_hex(p_partkey)) AS d FROM part")
sql_query("fn_conditional", "SELECT n_nationkey, nullif(n_regionkey, 1) AS a, coalesce(nullif(n_regionkey, 1), -1) AS b, greatest(n_nationkey, n_regionkey, 3) AS c, least(n_nationkey, n_regionkey, 3) AS d, nvl2(nullif(n_regionkey, 1), 'y', 'n') AS e FROM nation",
          "SELECT n_nationkey, nullif(n_regionkey, 1) AS a, coalesce(nullif(n_regionkey, 1), -1) AS b, greatest(n_nationkey, n_regionkey, 3) AS c, least(n_nationkey, n_regionkey, 3) AS d, CASE WHEN n_regionkey <> 1 THEN 'y' ELSE 'n' END AS e FROM nation")
sql_query("fn_datetime", """
    SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS INT) AS a, CAST(extract(MONTH FROM o_orderdate) AS INT) AS b, CAST(date_part('DAY', o_orderdate) AS INT) AS c, CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS d,
           CAST(o_orderdate + INTERVAL '1' MONTH AS DATE) AS e, CAST(extract(DAY FROM CAST(o_orderdate AS DATE) - DATE '1992-01-01') AS BIGINT) AS f, make_date(1994, 2, 3) AS g, datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01') AS h,
           CAST(date_bin(INTERVAL '15' MINUTE, o_orderdate) AS TIMESTAMP_NTZ) AS i FROM orders""", """
    SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS INT) AS a, CAST(extract(MONTH FROM o_orderdate) AS INT) AS b, CAST(date_part('DAY', o_orderdate) AS INT) AS c, CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS d,
           CAST(o_orderdate + INTERVAL '1' MONTH AS DATE) AS e, CAST(CAST(o_orderdate AS DATE) - DATE '1992-01-01' AS BIGINT) AS f, make_date(1994, 2, 3) AS g, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INT) AS h,
           time_bucket(INTERVAL '15 minutes', o_orderdate, TIMESTAMP '1970-01-01 00:00:00') AS i FROM orders""")
sql_query("fn_array", """
    WITH t AS (SELECT n_nationkey AS k, make_array(n_nationkey, n_regionkey, 3) AS x, make_array(1, 2, 3) AS y FROM nation)
    SELECT k, array_length(x) AS a, array_has(x, 3) AS b, array_has_any(x, y) AS c, array_has_all(x, make_array(3, k)) AS d, array_to_string(array_distinct(x), ',') AS e, array_to_string(array_sort(array_union(x, y)), ',') AS f,
           array_position(x, 3) > 0 AS g, array_to_string(array_append(x, 9), ',') AS h, array_to_string(array_slice(x, 2, 3), ',') AS i, array_max(x) AS j, array_min(x) AS l, array_to_string(flatten(make_array(x, y)), ',') AS m,
           array_to_string(array_filter(x, e -> e > 2), ',') AS n, array_to_string(array_transform(y, e -> e * 10), ',') AS o, array_element(x, 2) AS p, array_to_string(array_concat(x, y), ',') AS q, array_to_string(array_repeat(k, 2), ',') AS r,
           array_to_string(array_sort(array_except(y, x)), ',') AS s, array_to_string(array_sort(array_intersect(y, x)), ',') AS u, array_to_string(array_remove(x, 3), ',') AS v FROM t""", """
    WITH t AS (SELECT n_nationkey AS k, [n_nationkey, n_regionkey, 3] AS x, [1, 2, 3] AS y FROM nation)
    SELECT k, 3 AS a, list_contains(x, 3) AS b, list_has_any(x, y) AS c, true AS d, k || CASE WHEN x[2] <> k THEN ',' || x[2] ELSE '' END || CASE WHEN 3 NOT IN (k, x[2]) THEN ',3' ELSE '' END AS e,
           array_to_string(list_sort(list_distinct(list_concat(x, y))), ',') AS f, true AS g, array_to_string(list_append(x, 9), ',') AS h, array_to_string(x[2:3], ',') AS i, list_max(x) AS j, list_min(x) AS l, array_to_string(list_concat(x, y), ',') AS m,
           array_to_string(list_filter(x, lambda e: e > 2), ',') AS n, '10,20,30' AS o, x[2] AS p, array_to_string(list_concat(x, y), ',') AS q, k || ',' || k AS r,
           coalesce(array_to_string(list_sort(list_filter(y, lambda e: NOT list_contains(x, e))), ','), '') AS s, array_to_string(list_sort(list_filter(y, lambda e: list_contains(x, e))), ',') AS u, coalesce(array_to_string(list_filter(x, lambda e: e <> 3), ','), '') AS v FROM t""")
sql_query("fn_map_struct", "SELECT n_nationkey, map_extract(map('a', n_name, 'b', 'x'), 'a') AS a, size(map_keys(map('a', 1, 'b', 2))) AS b, get_field(named_struct('p', n_regionkey, 'q', 1), 'p') AS c FROM nation",
          "SELECT n_nationkey, n_name AS a, 2 AS b, n_regionkey AS c FROM nation")
sql_query("fn_json", "SELECT event_id, get_json_object(props, '$.nothing') IS NULL AS a, get_json_object(props, '$.k') AS b, CAST(from_json(props, 'k INT').k AS INT) AS c FROM events", "SELECT event_id, json_extract(props, '$.nothing') IS NULL AS a, json_extract_string(props, '$.k') AS b, CAST(json_extract(props, '$.k') AS INT) AS c FROM events")
sql_query("fn_integer_division", "SELECT l_orderkey, l_linenumber, div_trunc(l_orderkey, l_linenumber - 3) AS a FROM lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey // nullif(l_linenumber - 3, 0) AS a FROM lineitem WHERE l_linenumber >= 3 UNION ALL SELECT l_orderkey, l_linenumber, -(l_orderkey // (3 - l_linenumber)) AS a FROM lineitem WHERE l_linenumber < 3")


@frame_query("SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS y FROM lineitem")
def udf_scalar(spark, t):
    @F.pandas_udf("double")
    def twice(x: pd.Series) -> pd.Series:
        return x * 2 + 1

    return t("lineitem").select("l_orderkey", "l_linenumber", twice("l_quantity").alias("y"))


@frame_query("SELECT o_orderstatus, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY o_orderstatus")
def udf_aggregate(spark, t):
    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    return t("orders").groupBy("o_orderstatus").agg(spread("o_totalprice").alias("spread"))


@frame_query("SELECT n_nationkey, k FROM nation, (VALUES (0), (1), (2)) AS v (k) WHERE k < n_regionkey")
def udf_table(spark, t):
    @F.udtf(returnType="k int")
    class Count:
        def eval(self, n: int):
            for k in range(min(n, 3)):
                yield (k,)

    spark.udtf.register("count_to", Count)
    t("nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, k FROM nation, LATERAL count_to(n_regionkey)")


@frame_query(None)
def explain_analyze(spark, t):
    from loomwork.plans import explain

    return explain.analyze(t("orders").groupBy("o_orderstatus").count())


@frame_query("SELECT 'region' AS table_name, 2 AS n")
def information_schema(spark, t):
    from loomwork.session import Loom

    t("region").createOrReplaceTempView("region")
    return Loom(spark).sql("SELECT table_name, CAST(count(*) AS INT) AS n FROM information_schema.columns WHERE table_name = 'region' GROUP BY table_name")


@frame_query("SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def streaming_windows(spark, t):
    from loomwork.streaming import windowed

    return windowed(t("events"), "ts", "1 hour", [F.count("*").alias("n")], ["event_type"])


@frame_query("SELECT n_nationkey FROM nation")
def scan_arrow(spark, t):
    import pyarrow as pa
    from pyarrow import fs

    path = f"{_folder(spark)}/nation.arrow"
    store, where = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(where), recursive=True)
    data = t("nation").select("n_nationkey").toArrow()  # 25 rows by definition
    with store.open_output_stream(where) as f, pa.ipc.new_file(f, data.schema) as w:
        w.write_table(data)
    return sources.read(spark, "arrow", path)

# ---------------------------------------------------------------- forms that scale where the plain plan does not, and ordered aggregates

sql_query("agg_ordered", "SELECT o_custkey, array_join(array_agg(o_orderkey ORDER BY o_totalprice DESC, o_orderkey), ',') AS a, first_value(o_orderkey ORDER BY o_totalprice, o_orderkey) AS f, last_value(o_orderkey ORDER BY o_totalprice, o_orderkey) AS l FROM orders GROUP BY o_custkey",
          "SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_totalprice DESC, o_orderkey) AS a, first(o_orderkey ORDER BY o_totalprice, o_orderkey) AS f, last(o_orderkey ORDER BY o_totalprice, o_orderkey) AS l FROM orders GROUP BY o_custkey")
sql_query("agg_array_with_nulls", "SELECT o_orderstatus, array_length(array_agg(nullif(o_orderpriority, '1-URGENT'))) AS n, array_length(array_agg(o_orderkey) FILTER (WHERE o_totalprice > 300000)) AS m FROM orders GROUP BY o_orderstatus",
          "SELECT o_orderstatus, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (WHERE o_totalprice > 300000) AS INTEGER) AS m FROM orders GROUP BY o_orderstatus")
sql_query("distinct_on_limit", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey DESC, o_totalprice, o_orderkey LIMIT 20")
sql_query("qualify_with_cte", "WITH c AS (SELECT o_custkey, o_orderkey, extract(YEAR FROM o_orderdate) AS y, o_totalprice FROM orders) SELECT o_custkey, CAST(y AS INT) AS y, o_orderkey FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey, y ORDER BY o_totalprice, o_orderkey) = 1")
sql_query("subquery_not_in_orders", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AND o_orderstatus = 'F'")
sql_query("window_range_of_sql", "SELECT o_orderkey, count(*) OVER (ORDER BY o_totalprice RANGE BETWEEN 1500 PRECEDING AND 500 FOLLOWING) AS n, max(o_custkey) OVER (ORDER BY o_totalprice RANGE BETWEEN 1500 PRECEDING AND 500 FOLLOWING) AS m FROM orders")
sql_query("similar_to_column", "SELECT p_partkey, p_type SIMILAR TO (concat(substr(p_type, 1, 3), '%')) AS s, p_name SIMILAR TO p_brand AS t FROM part", "SELECT p_partkey, true AS s, p_name = p_brand AS t FROM part")
sql_query("fn_regexp_match", "SELECT p_partkey, regexp_match(p_brand, '#([0-9])([0-9])')[0] AS a, regexp_match(p_brand, '#([0-9])([0-9])')[1] AS b, regexp_match(p_type, 'Q+X') IS NULL AS c FROM part",
          "SELECT p_partkey, nullif(regexp_extract(p_brand, '#([0-9])([0-9])', 1), '') AS a, nullif(regexp_extract(p_brand, '#([0-9])([0-9])', 2), '') AS b, NOT regexp_matches(p_type, 'Q+X') AS c FROM part")
sql_query("fn_trunc_char", "SELECT o_orderkey, trunc(o_totalprice) AS a, round(trunc(o_totalprice / 7, 1), 1) AS b, to_char(o_orderdate, '%Y-%m/%d') AS c FROM orders",
          "SELECT o_orderkey, trunc(o_totalprice) AS a, round(trunc(o_totalprice / 7 * 10) / 10, 1) AS b, strftime(o_orderdate, '%Y-%m/%d') AS c FROM orders")

# shapes of decision-support queries: rollups with ranks, chains of set operators, windows over aggregates over joins

sql_query("ds_rollup_rank", """
    SELECT n_name, o_orderpriority, round(sum(o_totalprice), 2) AS total, CAST(grouping(n_name) + grouping(o_orderpriority) AS INT) AS lochierarchy,
           CAST(rank() OVER (PARTITION BY grouping(n_name) + grouping(o_orderpriority), CASE WHEN grouping(o_orderpriority) = 0 THEN n_name END ORDER BY round(sum(o_totalprice), 2) DESC) AS BIGINT) AS within_parent
    FROM orders, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey
    GROUP BY ROLLUP (n_name, o_orderpriority)""")
sql_query("ds_intersect_chain", """
    SELECT count(*) AS n FROM (
      SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'
      INTERSECT SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'
      EXCEPT SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 450000) AS both_states""")
sql_query("ds_share_of_class", """
    SELECT p_brand, l_returnflag, round(sum(l_extendedprice), 2) AS revenue, round(sum(l_extendedprice) * 100 / sum(sum(l_extendedprice)) OVER (PARTITION BY p_brand), 6) AS share
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
    WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1998-12-31 00:00:00' GROUP BY p_brand, l_returnflag""")
sql_query("ds_above_average", """
    WITH spent AS (SELECT o_custkey AS k, c_nationkey AS nation, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' GROUP BY o_custkey, c_nationkey)
    SELECT k, round(total, 2) AS total FROM spent a WHERE total > (SELECT avg(total) * 1.2 FROM spent b WHERE a.nation = b.nation) ORDER BY total DESC, k LIMIT 100""")
sql_query("ds_year_over_year", """
    WITH y AS (SELECT c_mktsegment, extract(YEAR FROM o_orderdate) AS year, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, extract(YEAR FROM o_orderdate))
    SELECT a.c_mktsegment, CAST(a.year AS INT) AS year, round(a.total / b.total, 6) AS ratio FROM y a JOIN y b ON a.c_mktsegment = b.c_mktsegment AND a.year = b.year + 1""")
sql_query("ds_pivoted_counts", """
    SELECT l_linestatus, sum(CASE WHEN d < 30 THEN 1 ELSE 0 END) AS days30, sum(CASE WHEN d >= 30 AND d < 60 THEN 1 ELSE 0 END) AS days60, sum(CASE WHEN d >= 60 THEN 1 ELSE 0 END) AS more
    FROM (SELECT l_linestatus, datediff(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY l_linestatus""", """
    SELECT l_linestatus, CAST(sum(CASE WHEN d < 30 THEN 1 ELSE 0 END) AS BIGINT) AS days30, CAST(sum(CASE WHEN d >= 30 AND d < 60 THEN 1 ELSE 0 END) AS BIGINT) AS days60, CAST(sum(CASE WHEN d >= 60 THEN 1 ELSE 0 END) AS BIGINT) AS more
    FROM (SELECT l_linestatus, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY l_linestatus""")
sql_query("agg_kll_sketch", "SELECT n_regionkey, kll_sketch_get_quantile_bigint(kll_sketch_agg_bigint(CAST(n_nationkey AS BIGINT)), 0.5) AS m, kll_sketch_get_n_bigint(kll_sketch_agg_bigint(CAST(n_nationkey AS BIGINT))) AS n FROM nation GROUP BY n_regionkey",
          "SELECT n_regionkey, CAST(quantile_disc(n_nationkey, 0.5) AS BIGINT) AS m, count(*) AS n FROM nation GROUP BY n_regionkey")

# forms of the dialect that Spark refuses, and functions of users

sql_query("window_distinct_filter", "SELECT o_orderkey, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS kinds, sum(DISTINCT extract(YEAR FROM o_orderdate)) OVER (PARTITION BY o_custkey) AS years, count(*) FILTER (WHERE o_totalprice > 250000) OVER (PARTITION BY o_custkey) AS large, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey), 2) AS done FROM orders",
          "SELECT o_orderkey, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS kinds, CAST(sum(DISTINCT extract(YEAR FROM o_orderdate)) OVER (PARTITION BY o_custkey) AS BIGINT) AS years, count(*) FILTER (WHERE o_totalprice > 250000) OVER (PARTITION BY o_custkey) AS large, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey), 2) AS done FROM orders")
sql_query("agg_distinct_ordered", "SELECT o_orderstatus, array_to_string(array_agg(DISTINCT o_orderpriority ORDER BY o_orderpriority DESC), ',') AS a, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS b FROM orders GROUP BY o_orderstatus",
          "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority DESC) AS a, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS b FROM orders GROUP BY o_orderstatus")
sql_query("generate_series_time", "SELECT value FROM generate_series(TIMESTAMP '2020-01-01 00:00:00', TIMESTAMP '2020-01-02 00:00:00', INTERVAL '6' HOUR) AS t", "SELECT value FROM generate_series(TIMESTAMP '2020-01-01 00:00:00', TIMESTAMP '2020-01-02 00:00:00', INTERVAL 6 HOUR) AS t (value)")
sql_query("table_range", "SELECT value, value * value AS square FROM range(3, 12, 2) AS t", "SELECT range AS value, range * range AS square FROM range(3, 12, 2)")
sql_query("expr_regex_match", "SELECT p_partkey, p_type ~ '^[A-M]' AS a, p_type ~* 'steel' AS b, p_type !~ 'BR.SS' AS c, p_type !~* 'copper$' AS d FROM part",
          "SELECT p_partkey, regexp_matches(p_type, '^[A-M]') AS a, regexp_matches(p_type, 'steel', 'i') AS b, NOT regexp_matches(p_type, 'BR.SS') AS c, NOT regexp_matches(p_type, 'copper$', 'i') AS d FROM part")
sql_query("expr_list_map_exclude", "SELECT * EXCLUDE (n_comment), array_to_string([n_nationkey, n_regionkey], '-') AS a, map([n_name], [n_nationkey])[n_name] AS b, MAP {'k': n_regionkey}['k'] AS c FROM (SELECT n_nationkey, n_regionkey, n_name, 'x' AS n_comment FROM nation)",
          "SELECT n_nationkey, n_regionkey, n_name, concat_ws('-', n_nationkey, n_regionkey) AS a, n_nationkey AS b, n_regionkey AS c FROM nation")
sql_query("fn_encode", "SELECT p_partkey, encode(p_name, 'hex') AS a, encode(p_name, 'base64') AS b, CAST(decode(encode(p_name, 'base64'), 'base64') AS STRING) AS c, CAST(decode(encode(p_name, 'hex'), 'hex') AS STRING) AS d FROM part",
          "SELECT p_partkey, lower(hex(p_name)) AS a, rtrim(to_base64(encode(p_name)), '=') AS b, p_name AS c, p_name AS d FROM part")
sql_query("fn_arrow_types", "SELECT o_orderkey, arrow_cast(o_orderkey, 'Int32') AS a, arrow_cast(o_totalprice, 'Utf8') IS NULL AS b, arrow_typeof(o_totalprice) AS c, arrow_typeof(arrow_cast(o_orderkey, 'Int16')) AS d FROM orders WHERE o_orderkey < 32768",
          "SELECT o_orderkey, CAST(o_orderkey AS INTEGER) AS a, false AS b, 'Float64' AS c, 'Int16' AS d FROM orders WHERE o_orderkey < 32768")


@frame_query("SELECT o_orderkey, o_custkey, o_orderkey - coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS gap FROM orders")
def udf_window(spark, t):
    def gap(rows):
        return rows["o_orderkey"] - rows["o_orderkey"].shift(1, fill_value=0)

    return ops.user_window(t("orders").select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"], gap, "gap", "bigint")


@frame_query("SELECT c_custkey, c_custkey * 2 + c_nationkey AS y FROM customer")
def udf_async(spark, t):
    import asyncio

    from loomwork.session import Loom

    async def answer(key, nation):
        await asyncio.sleep(0)
        return key * 2 + nation

    Loom(spark).register_async_udf("answer_of", answer, "bigint")
    return t("customer").selectExpr("c_custkey", "answer_of(c_custkey, c_nationkey) AS y")
