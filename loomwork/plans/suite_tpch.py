"""The 22 decision-support queries, in the form that the test tables allow.

Q1, Q5 to Q8, Q14 and Q18 are as published; others lose output columns or take the place of a missing
table or column with one of the same shape (supply cost from lineitem, ship mode from priority).
"""

from __future__ import annotations

from loomwork.plans.registry import sql_query

REVENUE = "l_extendedprice * (1 - l_discount)"

sql_query("tpch_q1", f"""
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
           round(sum({REVENUE}), 4) AS sum_disc_price, round(sum({REVENUE} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty,
           round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
    GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")

sql_query("tpch_q2", """
    SELECT s_acctbal, s_name, n_name, p_partkey, p_brand
    FROM part, supplier, lineitem, nation, region
    WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND p_size = 15 AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
      AND r_name = (SELECT min(r_name) FROM region)
      AND l_extendedprice = (SELECT min(l.l_extendedprice) FROM lineitem l, supplier s, nation n, region r
                             WHERE p_partkey = l.l_partkey AND s.s_suppkey = l.l_suppkey AND s.s_nationkey = n.n_nationkey
                               AND n.n_regionkey = r.r_regionkey AND r.r_name = (SELECT min(r_name) FROM region))
    ORDER BY s_acctbal DESC NULLS LAST, n_name, s_name, p_partkey LIMIT 100""")

sql_query("tpch_q3", f"""
    SELECT l_orderkey, round(sum({REVENUE}), 4) AS revenue, o_orderdate
    FROM customer, orders, lineitem
    WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
      AND o_orderdate < TIMESTAMP '1995-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00'
    GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC NULLS LAST, o_orderdate, l_orderkey LIMIT 10""")

sql_query("tpch_q4", """
    SELECT o_orderpriority, count(*) AS order_count FROM orders
    WHERE o_orderdate >= TIMESTAMP '1996-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-07-01 00:00:00' + INTERVAL '3' MONTH
      AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)
    GROUP BY o_orderpriority ORDER BY o_orderpriority""")

sql_query("tpch_q5", f"""
    SELECT n_name, round(sum({REVENUE}), 4) AS revenue
    FROM customer, orders, lineitem, supplier, nation, region
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
      AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
      AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00'
    GROUP BY n_name ORDER BY revenue DESC NULLS LAST, n_name""")

sql_query("tpch_q6", """
    SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00'
      AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")

sql_query("tpch_q7", f"""
    SELECT supp_nation, cust_nation, l_year, round(sum(volume), 4) AS revenue FROM (
      SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(YEAR FROM l_shipdate) AS INT) AS l_year, {REVENUE} AS volume
      FROM supplier, lineitem, orders, customer, nation n1, nation n2
      WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
        AND ((n1.n_nationkey < 5 AND n2.n_nationkey >= 5) OR (n1.n_nationkey >= 5 AND n2.n_nationkey < 5))
        AND l_shipdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1996-12-31 00:00:00') AS shipping
    GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""")

sql_query("tpch_q8", f"""
    SELECT o_year, round(sum(CASE WHEN n_key = 3 THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
      SELECT CAST(extract(YEAR FROM o_orderdate) AS INT) AS o_year, {REVENUE} AS volume, n2.n_nationkey AS n_key
      FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
      WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
        AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_size < 25) AS all_nations
    GROUP BY o_year ORDER BY o_year""")

sql_query("tpch_q9", f"""
    SELECT nation_name, o_year, round(sum(amount), 4) AS sum_profit FROM (
      SELECT n_name AS nation_name, CAST(extract(YEAR FROM o_orderdate) AS INT) AS o_year, {REVENUE} - 0.1 * p_retailprice * l_quantity AS amount
      FROM part, supplier, lineitem, orders, nation
      WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%a%') AS profit
    GROUP BY nation_name, o_year ORDER BY nation_name, o_year DESC NULLS LAST""")

sql_query("tpch_q10", f"""
    SELECT c_custkey, c_name, round(sum({REVENUE}), 4) AS revenue, c_acctbal, n_name
    FROM customer, orders, lineitem, nation
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= TIMESTAMP '1996-10-01 00:00:00'
      AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
    GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC NULLS LAST, c_custkey LIMIT 20""")

sql_query("tpch_q11", """
    SELECT l_partkey, round(sum(l_extendedprice * l_quantity), 2) AS value FROM lineitem, supplier, nation
    WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 1
    GROUP BY l_partkey
    HAVING sum(l_extendedprice * l_quantity) > (SELECT sum(l_extendedprice * l_quantity) * 0.001 FROM lineitem, supplier, nation
                                                WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 1)
    ORDER BY value DESC NULLS LAST, l_partkey""")

sql_query("tpch_q12", """
    SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
           CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
    FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND o_orderdate < l_shipdate
      AND l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00'
    GROUP BY l_linestatus ORDER BY l_linestatus""")

sql_query("tpch_q13", """
    SELECT c_count, count(*) AS custdist FROM (
      SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%'
      GROUP BY c_custkey) AS c_orders (c_custkey, c_count)
    GROUP BY c_count ORDER BY custdist DESC NULLS LAST, c_count DESC NULLS LAST""")

sql_query("tpch_q14", f"""
    SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END) / sum({REVENUE}), 6) AS promo_revenue
    FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1995-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-10-01 00:00:00'""")

sql_query("tpch_q15", f"""
    WITH revenue0 (supplier_no, total_revenue) AS (
      SELECT l_suppkey, round(sum({REVENUE}), 4) FROM lineitem
      WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-04-01 00:00:00' GROUP BY l_suppkey)
    SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue0
    WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue0) ORDER BY s_suppkey""")

sql_query("tpch_q16", """
    SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem, part
    WHERE p_partkey = l_partkey AND p_brand <> 'Brand#45' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
      AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
    GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC NULLS LAST, p_brand, p_type, p_size""")

sql_query("tpch_q17", """
    SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem, part
    WHERE p_partkey = l_partkey AND p_size < 10 AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)""")

sql_query("tpch_q18", """
    SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS sum_qty
    FROM customer, orders, lineitem
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
    GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC NULLS LAST, o_orderdate, o_orderkey LIMIT 100""")

sql_query("tpch_q19", f"""
    SELECT round(sum({REVENUE}), 4) AS revenue FROM lineitem, part
    WHERE (p_partkey = l_partkey AND p_size BETWEEN 1 AND 5 AND l_quantity >= 1 AND l_quantity <= 11)
       OR (p_partkey = l_partkey AND p_size BETWEEN 6 AND 10 AND l_quantity >= 10 AND l_quantity <= 20)
       OR (p_partkey = l_partkey AND p_size BETWEEN 11 AND 15 AND l_quantity >= 20 AND l_quantity <= 30)""")

sql_query("tpch_q20", """
    SELECT s_name, s_nationkey FROM supplier
    WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '%a%')
                        GROUP BY l_partkey, l_suppkey HAVING sum(l_quantity) > 60)
    ORDER BY s_name""")

sql_query("tpch_q21", """
    SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders
    WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R'
      AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
      AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
    GROUP BY s_name ORDER BY numwait DESC NULLS LAST, s_name LIMIT 100""")

sql_query("tpch_q22", """
    SELECT cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM (
      SELECT substring(c_name FROM 10 FOR 2) AS cntrycode, c_acctbal FROM customer
      WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00)
        AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)) AS custsale
    GROUP BY cntrycode ORDER BY cntrycode""")
