"""Group-by, join and window statements of the usual benchmark, over lineitem and orders."""

from __future__ import annotations

from loomwork.plans.registry import sql_query

for k, (keys, values) in enumerate([
    ("l_returnflag", "round(sum(l_quantity), 2) AS v1"),
    ("l_returnflag, l_linestatus", "round(sum(l_quantity), 2) AS v1"),
    ("l_partkey", "round(sum(l_quantity), 2) AS v1, round(avg(l_tax), 6) AS v3"),
    ("l_linenumber", "round(avg(l_quantity), 6) AS v1, round(avg(l_discount), 6) AS v2, round(avg(l_tax), 6) AS v3"),
    ("l_suppkey", "round(sum(l_quantity), 2) AS v1, round(sum(l_discount), 2) AS v2, round(sum(l_tax), 2) AS v3"),
    ("l_linenumber, l_returnflag", "round(median(l_extendedprice), 4) AS median_v3, round(stddev(l_extendedprice), 4) AS sd_v3"),
    ("l_partkey", "max(l_quantity) - min(l_linenumber) AS range_v1_v2"),
], 1):
    sql_query(f"h2o_groupby_{k}", f"SELECT {keys}, {values} FROM lineitem GROUP BY {keys}")
sql_query("h2o_groupby_8", """
    SELECT l_suppkey, largest2 FROM (
      SELECT l_suppkey, l_extendedprice AS largest2, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC NULLS LAST) AS nth
      FROM lineitem WHERE l_extendedprice IS NOT NULL) AS s WHERE nth <= 2""")
sql_query("h2o_groupby_9", "SELECT l_returnflag, l_linenumber, round(power(corr(l_quantity, l_extendedprice), 2), 8) AS r2 FROM lineitem GROUP BY l_returnflag, l_linenumber")
sql_query("h2o_groupby_10", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS v3, count(*) AS n
    FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus""")

for k, (table, key, kind) in enumerate([("region", "n_regionkey = r_regionkey", "INNER"), ("customer", "n_nationkey = c_nationkey", "INNER"), ("customer", "n_nationkey = c_nationkey AND c_acctbal > 5000", "LEFT"), ("supplier", "n_nationkey = s_nationkey", "INNER")], 1):
    more = {"region": "r_name", "customer": "c_custkey, c_acctbal", "supplier": "s_suppkey, s_acctbal"}[table]
    sql_query(f"h2o_join_{k}", f"SELECT n_nationkey, n_name, {more} FROM nation {kind} JOIN {table} ON {key}")
sql_query("h2o_join_5", "SELECT l_orderkey, l_linenumber, o_custkey, o_totalprice, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey")

ORDER = "o_orderdate, o_orderkey"
for name, expr in {
    "basic": "round(sum(o_totalprice) OVER (), 2)",
    "sorted": f"first_value(o_custkey) OVER (ORDER BY {ORDER})",
    "row_number": f"CAST(row_number() OVER (ORDER BY {ORDER}) AS BIGINT)",
    "partition_by": "round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2)",
    "partition_by_2": "round(sum(o_totalprice) OVER (PARTITION BY o_orderstatus, o_orderpriority), 2)",
    "partition_order": f"first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY {ORDER})",
    "lag_by_frame": f"first_value(o_orderkey) OVER (ORDER BY {ORDER} ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING)",
    "lead_by_frame": f"first_value(o_orderkey) OVER (ORDER BY {ORDER} ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING)",
    "moving_average": f"round(avg(o_totalprice) OVER (ORDER BY {ORDER} ROWS BETWEEN 100 PRECEDING AND CURRENT ROW), 7)",
    "rolling_sum": f"round(sum(o_totalprice) OVER (ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2)",
    "range_between": "count(*) OVER (ORDER BY o_custkey RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)",
    "lag_in_partition": f"first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY {ORDER} ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING)",
    "moving_in_partition": f"round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY {ORDER} ROWS BETWEEN 100 PRECEDING AND CURRENT ROW), 7)",
    "rolling_in_partition": f"round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2)",
    "range_in_partition": "count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)",
}.items():
    sql_query(f"h2o_window_{name}", f"SELECT o_orderkey, o_custkey, {expr} AS w FROM orders")
for n in (100, 1000, 10000):
    sql_query(f"h2o_window_top2_{n}", f"""
        SELECT pk, largest2 FROM (
          SELECT l_orderkey % {n} AS pk, l_extendedprice AS largest2, row_number() OVER (PARTITION BY l_orderkey % {n} ORDER BY l_extendedprice DESC NULLS LAST) AS nth
          FROM lineitem WHERE l_extendedprice IS NOT NULL) AS s WHERE nth <= 2""")
