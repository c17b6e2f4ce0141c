"""Relational queries run under a role, each with the permitted query written out by hand."""

from __future__ import annotations

#: name: (role, query, permitted query).
WORKLOAD: dict[str, tuple[str, str, str]] = {
    "where": ("staff", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag <> 'R'"),
    "group_by": (
        "staff", "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, COUNT(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL",
    ),
    "aggregate": ("public", "SELECT p_brand, MIN(p_retailprice) AS lo, MAX(p_retailprice) AS hi, COUNT(p_partkey) AS n FROM part GROUP BY p_brand", "SELECT p_brand, MIN(p_retailprice) AS lo, MAX(p_retailprice) AS hi, COUNT(p_partkey) AS n FROM part WHERE p_size < 25 GROUP BY p_brand"),
    "column_drop": ("staff", "SELECT s_suppkey, s_name, s_acctbal FROM supplier", "SELECT s_suppkey, s_name FROM supplier"),
    "aggregate_shield": ("staff", "SELECT s_nationkey, ROUND(AVG(s_acctbal), 4) AS mean, COUNT(DISTINCT s_name) AS names FROM supplier GROUP BY s_nationkey", "SELECT s_nationkey, ROUND(AVG(s_acctbal), 4) AS mean, COUNT(DISTINCT s_name) AS names FROM supplier GROUP BY s_nationkey"),
    "function_no_shield": ("staff", "SELECT s_suppkey, ROUND(s_acctbal) AS rounded, CAST(s_acctbal AS INT) AS whole FROM supplier", "SELECT s_suppkey FROM supplier"),
    "table_view_deny": ("staff", "SELECT n_name, COUNT(c_custkey) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name", "SELECT n_name FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name"),
    "table_process_deny": ("public", "SELECT n_name, c_acctbal FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey", "SELECT n_name FROM nation"),
    "from_repair": ("public", "SELECT n_name, o_orderkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey", "SELECT n_name FROM nation"),
    "semi_in": (
        "analyst", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
        "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING')",
    ),
    "semi_exists": (
        "analyst", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)",
        "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0 AND c_mktsegment = 'BUILDING')",
    ),
    "anti_exists": (
        "analyst", "SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900)",
        "SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900 AND c_mktsegment = 'BUILDING')",
    ),
    "scalar_subquery": ("public", "SELECT p_partkey, p_size FROM part WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part)", "SELECT p_partkey, p_size FROM part WHERE p_size < 25 AND p_retailprice > (SELECT AVG(p_retailprice) FROM part WHERE p_size < 25)"),
    "correlated": (
        "analyst", "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer",
        "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE c_mktsegment = 'BUILDING'",
    ),
    "union": ("analyst", "SELECT c_mktsegment AS name FROM customer UNION SELECT r_name FROM region", "SELECT 'BUILDING' AS name FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT r_name FROM region"),
    "union_all": ("staff", "SELECT l_returnflag AS f FROM lineitem UNION ALL SELECT r_name FROM region", "SELECT l_returnflag AS f FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT r_name FROM region"),
    "intersect": ("analyst", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "except": ("analyst", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'BUILDING'"),
    "cte": (
        "analyst", "WITH b AS (SELECT c_custkey, c_name, c_acctbal FROM customer) SELECT c_custkey, c_name, c_acctbal FROM b WHERE c_acctbal > 0",
        "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0",
    ),
    "derived_table": (
        "analyst", "SELECT x.seg, x.n FROM (SELECT c_mktsegment AS seg, COUNT(*) AS n FROM customer GROUP BY c_mktsegment) AS x WHERE x.n > 1",
        "SELECT c_mktsegment AS seg, COUNT(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_mktsegment",
    ),
    "joined_subquery": (
        "analyst", "SELECT n_name, x.c_name, x.c_custkey FROM nation JOIN (SELECT c_custkey, c_name, c_nationkey FROM customer) AS x ON n_nationkey = x.c_nationkey",
        "SELECT n_name, c_custkey FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING'",
    ),
    "top_k": (
        "analyst", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 10",
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    ),
    "left_join": (
        "staff", "SELECT p_partkey, l_orderkey FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 49",
        "SELECT p_partkey, l_orderkey FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 49 AND l_returnflag <> 'R'",
    ),
    "right_join": (
        "staff", "SELECT p_partkey, l_orderkey FROM lineitem RIGHT JOIN part ON p_partkey = l_partkey AND l_quantity > 49",
        "SELECT p_partkey, l_orderkey FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag <> 'R') ON p_partkey = l_partkey AND l_quantity > 49",
    ),
    "full_join": (
        "analyst", "SELECT n_name, c_custkey FROM nation FULL JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9000",
        "SELECT n_name, c_custkey FROM nation FULL JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON n_nationkey = c_nationkey AND c_acctbal > 9000",
    ),
    "using": (
        "analyst", "SELECT c_nationkey, a.c_custkey, b.c_custkey AS other FROM customer a JOIN customer b USING (c_nationkey) WHERE a.c_custkey < b.c_custkey AND a.c_custkey < 60",
        "SELECT a.c_nationkey, a.c_custkey, b.c_custkey AS other FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey WHERE a.c_custkey < b.c_custkey AND a.c_custkey < 60 AND a.c_mktsegment = 'BUILDING' AND b.c_mktsegment = 'BUILDING'",
    ),
    "natural_star": (
        "public", "SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) x NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) y",
        "SELECT n_regionkey AS k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "full_using": (
        "admin", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x FULL JOIN (SELECT n_nationkey + 10 AS k, n_regionkey AS b FROM nation) y USING (k)",
        "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x FULL JOIN (SELECT n_nationkey + 10 AS k, n_regionkey AS b FROM nation) y USING (k)",
    ),
    "window_frame": (
        "analyst", "SELECT o_custkey, o_orderkey, COUNT(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'",
        "SELECT o_custkey, o_orderkey, COUNT(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'",
    ),
    "bare_column": ("admin", "SELECT r_name, COUNT(*) AS n, UPPER(r_name) AS u FROM region WHERE r_regionkey = 1", "SELECT any_value(r_name) AS r_name, COUNT(*) AS n, upper(any_value(r_name)) AS u FROM region WHERE r_regionkey = 1"),
    "bare_column_in_group": (
        "analyst", "SELECT c_nationkey, n_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey",
        "SELECT c_nationkey, any_value(n_name) AS n_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_nationkey",
    ),
    "grouping_sets": (
        "staff", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, COUNT(*) FILTER (WHERE l_quantity > 25) AS many FROM lineitem WHERE (l_tax > 0.02) IS TRUE GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())",
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, COUNT(*) FILTER (WHERE l_quantity > 25) AS many FROM lineitem WHERE l_tax > 0.02 AND l_returnflag <> 'R' GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())",
    ),
    "self_join": (
        "staff", "SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS other FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE a.l_quantity = 50",
        "SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS other FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE a.l_quantity = 50 AND a.l_returnflag <> 'R' AND b.l_returnflag <> 'R'",
    ),
    "broken_on": ("staff", "SELECT COUNT(*) AS n FROM nation JOIN customer ON n_name = c_name", "SELECT COUNT(*) AS n FROM nation CROSS JOIN customer"),
    "star": ("staff", "SELECT * FROM supplier", "SELECT s_suppkey, s_name, s_nationkey FROM supplier"),
    "star_many_tables": (
        "analyst", "SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey",
        "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, n_nationkey, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'",
    ),
    "window": (
        "staff", "SELECT l_orderkey, l_linenumber, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem",
        "SELECT l_orderkey, l_linenumber, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem WHERE l_returnflag <> 'R'",
    ),
    "having": (
        "staff", "SELECT l_suppkey, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 20",
        "SELECT l_suppkey, COUNT(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_suppkey HAVING COUNT(*) > 20",
    ),
    "case_cast": (
        "public", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size BETWEEN 10 AND 19 THEN 'middle' ELSE 'large' END AS kind, CAST(p_retailprice AS INT) % 7 AS r FROM part WHERE p_type LIKE '%BRASS%' OR p_brand IN ('Brand#11', 'Brand#12')",
        "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size BETWEEN 10 AND 19 THEN 'middle' ELSE 'large' END AS kind, CAST(trunc(p_retailprice) AS INT) % 7 AS r FROM part WHERE (p_type LIKE '%BRASS%' OR p_brand IN ('Brand#11', 'Brand#12')) AND p_size < 25",
    ),
    "distinct": ("public", "SELECT DISTINCT p_brand, p_size FROM part", "SELECT DISTINCT p_brand, p_size FROM part WHERE p_size < 25"),
    "implied_filter": ("analyst", "SELECT c_custkey FROM customer AS c WHERE c.c_mktsegment = 'BUILDING' AND c.c_acctbal IS NOT NULL", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal IS NOT NULL"),
    "pruned_condition": ("staff", "SELECT n_name FROM nation, customer WHERE n_nationkey = c_nationkey AND (c_name LIKE '%1' OR c_custkey < 50)", "SELECT n_name FROM nation, customer WHERE n_nationkey = c_nationkey AND c_custkey < 50"),
    "order_by_unscoped": ("staff", "SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5", "SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5"),
    "admin_unrestricted": ("admin", "SELECT c_name, c_acctbal FROM customer WHERE c_acctbal > 9000", "SELECT c_name, c_acctbal FROM customer WHERE c_acctbal > 9000"),
    "recursive_cte": ("admin", "WITH RECURSIVE k AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM k WHERE n < 5) SELECT n FROM k", "SELECT unnest(generate_series(1, 5))::INTEGER AS n"),
}

#: Queries that are decided, not run: id: (role, query, status, rules).
DECISIONS: dict[str, tuple[str, str, str, str]] = {
    "d01": ("analyst", "UPDATE customer SET c_acctbal = 0 WHERE c_custkey = 1", "deny", "rtm"),
    "d02": ("admin", "UPDATE customer SET c_acctbal = 0 WHERE c_custkey = 1", "allow", ""),
    "d03": ("analyst", "DELETE FROM nation WHERE n_nationkey = 1", "allow", ""),
    "d04": ("analyst", "INSERT INTO region (r_regionkey, r_name) VALUES (9, 'X')", "allow", ""),
    "d05": ("staff", "SELECT c_name FROM customer", "deny", "rcp,rcv,rtr,rtv"),
    "d06": ("public", "SELECT o_totalprice FROM orders", "deny", "rcp,rcv,rtr,rtv"),
    "d07": ("visitor", "SELECT r_name FROM region", "deny", ""),
    "d08": ("analyst", "SELECT nothing FROM customer", "deny", ""),
    "d09": ("analyst", "SELECT FROM", "deny", ""),
    "d10": ("analyst", "", "deny", ""),
    "d11": ("analyst", "SELECT COUNT(c_name) AS n FROM customer", "allow", "rrp,rrv"),
    "d12": ("staff", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)", "allow", "rtr"),
    "d13": ("public", "SELECT s_name FROM supplier", "deny", "rtr,rtv"),
    "d14": ("staff", "SELECT AVG(s_acctbal > 5) AS x FROM supplier", "deny", "rcv"),
}
