"""The catalogue of queries in the SQL dialect, one or more for each operator.

Every entry runs over whole tables.  A text that DuckDB can run as it is serves
as its own oracle; where the dialect or a type differs, DuckDB has a text of its
own.  Texts go through the dialect's rewrites and are then planned by Catalyst.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakemill.plans.rewrite import sql
from lakemill.session import TABLES, configure
from lakemill.sources.io import register_tables

FLAGSHIP = "flagship_revenue_by_nation_segment"

#: Texts that run alike here and in DuckDB.
SAME: dict[str, str] = {
    FLAGSHIP: """
        SELECT n_name, c_mktsegment, count(*) AS n_lines, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS DOUBLE) / 100 AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey
        WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1999-01-01 00:00:00'
        GROUP BY n_name, c_mktsegment""",
    # Scans, filters, expressions
    "scan_filter_project": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity > 45 AND l_discount >= 0.05",
    "index_seek": "SELECT * FROM orders WHERE o_orderkey = 1234",
    "range_scan": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 1000 AND 1999",
    "values_table": "SELECT t.a, t.b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)",
    "select_without_from": "SELECT 1 + 2 AS three, 'a' || 'b' AS ab",
    "between_in": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_type IN ('ECONOMY', 'PROMO') AND p_partkey NOT BETWEEN 100 AND 200",
    "not_in_list": "SELECT p_partkey FROM part WHERE p_type NOT IN ('ECONOMY', 'PROMO')",
    "like_prefix": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%' AND p_name NOT LIKE '%ring'",
    "like_escape": "SELECT p_partkey, p_brand FROM part WHERE p_brand || '_x' LIKE 'Brand#1_!_x' ESCAPE '!'",
    "ilike": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%WIDGET'",
    "null_safe_eq": "SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NOT DISTINCT FROM nullif('BUILDING', 'BUILDING')",
    "is_distinct": "SELECT c_custkey FROM customer WHERE nullif(c_nationkey, 3) IS DISTINCT FROM 4",
    "is_null": "SELECT count(*) AS n FROM (SELECT nullif(o_orderstatus, 'P') AS s FROM orders) t WHERE s IS NULL",
    "three_valued_logic": "SELECT o_orderkey FROM orders WHERE NOT (nullif(o_orderstatus, 'P') = 'F' AND o_totalprice > 100000)",
    "case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS status FROM orders",
    "case_searched": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' END AS band FROM orders",
    "cast_matrix": "SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS d, CAST(trunc_price AS BIGINT) AS b, CAST('42' AS BIGINT) AS n, CAST('2024-02-29' AS DATE) AS dt FROM (SELECT o_orderkey, floor(o_totalprice) AS trunc_price FROM orders) t",
    "interval_arith": "SELECT o_orderkey, o_orderdate + INTERVAL '1' MONTH AS next_month, o_orderdate - INTERVAL '10' DAY AS before FROM orders",
    "row_value_in": "SELECT c_custkey FROM customer WHERE (c_nationkey, c_mktsegment) IN (SELECT n_nationkey, 'BUILDING' FROM nation WHERE n_regionkey = 1)",
    "concat_operator": "SELECT n_nationkey, n_name || '/' || nullif(n_name, 'NATION_1') AS two FROM nation",
    # Joins
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey",
    "join_right": "SELECT n_name, c_custkey FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 9500",
    "join_full": "SELECT a.n_nationkey AS a_key, b.s_suppkey AS b_key FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT * FROM supplier WHERE s_nationkey >= 10) b ON a.n_nationkey = b.s_nationkey",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_comma": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey",
    "join_using": "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation WHERE n_nationkey < 20) x FULL JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier WHERE s_nationkey > 5 GROUP BY s_nationkey) y USING (k)",
    "join_natural": "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) x NATURAL JOIN (SELECT c_nationkey AS k, c_custkey FROM customer) y",
    "join_self": "SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_multiway": "SELECT r_name, p_type, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey GROUP BY r_name, p_type",
    "join_theta_range": "SELECT a.n_nationkey AS lo, b.n_nationkey AS hi FROM nation a JOIN nation b ON a.n_nationkey + 20 < b.n_nationkey",
    "join_lateral": "SELECT c_custkey, t.total FROM customer, LATERAL (SELECT round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey = c_custkey) AS t",
    "join_left_lateral": "SELECT n_nationkey, t.most FROM nation LEFT JOIN LATERAL (SELECT max(s_acctbal) AS most FROM supplier WHERE s_nationkey = n_nationkey) AS t ON true",
    "semi_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    "anti_not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "in_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "not_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "not_in_nulls": "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders)",
    # Subqueries and CTEs
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "correlated_scalar": "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation",
    "cte_chain": "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT * FROM a WHERE s > 1000000) SELECT o_custkey, round(s, 2) AS s FROM b",
    "cte_columns": "WITH t(k, v) AS (SELECT n_nationkey, n_name FROM nation) SELECT k, v FROM t WHERE k > 20",
    "derived_table": "SELECT t.k, t.n FROM (SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey) AS t(k, n)",
    "recursive_union_all": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 100) SELECT n FROM t",
    "recursive_tree": "WITH RECURSIVE t(k, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.depth + 1 FROM t JOIN nation n ON n.n_nationkey IN (2 * t.k + 1, 2 * t.k + 2)) SELECT k, depth FROM t",
    # Aggregates
    "group_by": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "group_by_null": "SELECT nullif(o_orderstatus, 'F') AS s, count(*) AS n FROM orders GROUP BY nullif(o_orderstatus, 'F')",
    "global_agg_empty": "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderdate) AS d FROM orders WHERE o_orderkey < 0",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "having_global": "SELECT count(*) AS n FROM orders HAVING count(*) > 100000000",
    "count_distinct": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority",
    "min_max_text": "SELECT p_brand, min(p_name) AS lo, max(p_name) AS hi FROM part GROUP BY p_brand",
    "stddev_variance": "SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sp, round(variance(l_quantity), 6) AS va, round(var_pop(l_quantity), 6) AS vp FROM lineitem GROUP BY l_returnflag",
    "stddev_single": "SELECT r_regionkey, stddev_samp(r_regionkey) AS sd, var_pop(r_regionkey) AS vp FROM region GROUP BY r_regionkey",
    "bool_and_or": "SELECT o_custkey, bool_and(o_totalprice > 50000) AS every, bool_or(o_totalprice > 400000) AS some FROM orders GROUP BY o_custkey",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "median": "SELECT p_type, median(p_size) AS m FROM part GROUP BY p_type",
    "percentile_cont": "SELECT event_type, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY value), 6) AS q, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY value DESC), 6) AS d FROM events GROUP BY event_type",
    "string_agg_ordered": "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey",
    "agg_filter": "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY o_custkey",
    # Windows
    "row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders",
    "rank_dense_rank": "SELECT p_partkey, rank() OVER (PARTITION BY p_type ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_type ORDER BY p_size) AS d FROM part",
    "percent_rank_cume_dist": "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS p, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS c FROM part",
    "ntile": "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q FROM orders",
    "lag_lead_default": "SELECT event_id, lag(value, 1, 0.0) OVER w AS before, lead(value, 2) OVER w AS behind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "first_last_nth_default_frame": "SELECT p_partkey, first_value(p_size) OVER w AS f, last_value(p_size) OVER w AS l, nth_value(p_size, 3) OVER w AS t FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)",
    "running_sum_rows": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS s FROM events",
    "rolling_avg_rows": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 4) AS a FROM events",
    "range_peers": "SELECT p_partkey, count(*) OVER (PARTITION BY p_type ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM part",
    "agg_over_partition": "SELECT c_custkey, round(avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS a, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS m FROM customer",
    # Sort, limit, sets
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset": "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 40",
    "order_nulls": "SELECT c_custkey, s FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS s FROM customer) t ORDER BY s NULLS FIRST, c_custkey LIMIT 30",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "set_nested": "(SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region) EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 10",
}

#: Texts of the dialect, and what DuckDB runs instead.
PAIRS: dict[str, tuple[str, str]] = {
    "regex_match": ("SELECT p_partkey FROM part WHERE p_name ~ '^(red|blue) .*t$'", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^(red|blue) .*t$')"),
    "regex_not_match_ci": ("SELECT p_partkey FROM part WHERE p_name !~* 'RED|ring'", "SELECT p_partkey FROM part WHERE NOT regexp_matches(p_name, 'RED|ring', 'i')"),
    "int_div_zero": (
        "SELECT p_partkey, p_size div nullif(p_partkey % 5, 0) AS q, try_divide(p_retailprice, p_partkey % 5) AS d FROM part",
        "SELECT p_partkey, p_size // nullif(p_partkey % 5, 0) AS q, p_retailprice / nullif(p_partkey % 5, 0) AS d FROM part",
    ),
    "mod_zero": ("SELECT p_partkey, try_mod(p_size, p_partkey % 3) AS m FROM part", "SELECT p_partkey, p_size % nullif(p_partkey % 3, 0) AS m FROM part"),
    "collate_nocase": ("SELECT p_partkey FROM part WHERE p_type COLLATE UTF8_LCASE = 'promo'", "SELECT p_partkey FROM part WHERE p_type COLLATE NOCASE = 'promo'"),
    "collate_rtrim": ("SELECT p_partkey FROM part WHERE (p_type || '  ') COLLATE UTF8_BINARY_RTRIM = 'PROMO'", "SELECT p_partkey FROM part WHERE rtrim(p_type || '  ') = 'PROMO'"),
    "any_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > ANY (SELECT o_totalprice * 2 FROM orders WHERE o_orderkey < 50)", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT min(o_totalprice * 2) FROM orders WHERE o_orderkey < 50)"),
    "all_subquery": ("SELECT c_custkey FROM customer WHERE c_acctbal >= ALL (SELECT s_acctbal FROM supplier)", "SELECT c_custkey FROM customer WHERE c_acctbal >= (SELECT max(s_acctbal) FROM supplier)"),
    "all_empty": ("SELECT n_nationkey FROM nation WHERE n_nationkey > ALL (SELECT s_nationkey FROM supplier WHERE s_suppkey < 0)", "SELECT n_nationkey FROM nation"),
    "sum_avg_distinct": ("SELECT p_type, sum(DISTINCT p_size) AS s, round(avg(DISTINCT p_size), 6) AS a FROM part GROUP BY p_type", "SELECT p_type, sum(DISTINCT p_size)::BIGINT AS s, round(avg(DISTINCT p_size), 6) AS a FROM part GROUP BY p_type"),
    "group_concat": ("SELECT n_regionkey, group_concat(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey"),
    "distinct_on": (
        "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
        "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    ),
    "offset_fetch": ("SELECT s_suppkey FROM supplier ORDER BY s_suppkey OFFSET 10 ROWS FETCH NEXT 5 ROWS ONLY", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 5 OFFSET 10"),
    "limit_all": ("SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT ALL", "SELECT s_suppkey FROM supplier"),
    "sql_division": (
        "SELECT p_partkey, p_size / 7 AS q, p_size / (p_partkey % 5) AS z, p_retailprice / (p_partkey % 5) AS d, 2 * p_size / 4 AS c, p_size % (p_partkey % 3) AS m FROM part",
        "SELECT p_partkey, (p_size // 7)::DOUBLE AS q, (p_size // nullif(p_partkey % 5, 0))::DOUBLE AS z, p_retailprice / nullif(p_partkey % 5, 0) AS d, (2 * p_size // 4)::DOUBLE AS c, p_size % nullif(p_partkey % 3, 0) AS m FROM part",
    ),
    "sql_functions": (
        "SELECT p_partkey, concat(p_name, nullif(p_type, 'PROMO'), '|') AS c, substr(p_name, -2, 3) AS s, greatest(p_size, nullif(p_partkey % 2, 0)) AS g, iif(p_size > 20, 'large', 'small') AS i FROM part",
        "SELECT p_partkey, concat(p_name, nullif(p_type, 'PROMO'), '|') AS c, substring(p_name, 1, 3) AS s, CASE WHEN p_partkey % 2 <> 0 THEN greatest(p_size, 1) END::BIGINT AS g, CASE WHEN p_size > 20 THEN 'large' ELSE 'small' END AS i FROM part",
    ),
    "sql_dates": (
        "SELECT o_orderkey, strftime('%d/%m/%Y %H:%M', o_orderdate) AS f, strftime('%w', o_orderdate) AS w, date_diff('day', TIMESTAMP '1998-06-15 12:00:00', o_orderdate) AS n FROM orders",
        "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y %H:%M') AS f, strftime(o_orderdate, '%w') AS w, floor((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1998-06-15 12:00:00')) / 86400000000)::BIGINT AS n FROM orders",
    ),
    "sql_total": ("SELECT o_orderstatus, total(o_custkey) AS t, total(nullif(o_custkey, o_custkey)) AS z FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, sum(o_custkey)::DOUBLE AS t, 0.0::DOUBLE AS z FROM orders GROUP BY o_orderstatus"),
    "sql_array_agg": (
        "SELECT n_regionkey, array_agg(nullif(n_nationkey, 7) ORDER BY n_nationkey DESC) AS a, array_agg(DISTINCT n_nationkey % 3) AS d FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, replace(to_json(list(nullif(n_nationkey, 7) ORDER BY n_nationkey DESC))::VARCHAR, ' ', '') AS a, replace(to_json(list(DISTINCT n_nationkey % 3 ORDER BY n_nationkey % 3))::VARCHAR, ' ', '') AS d FROM nation GROUP BY n_regionkey",
    ),
    "sql_collate": ("SELECT p_partkey FROM part WHERE p_type COLLATE NOCASE = 'promo'", "SELECT p_partkey FROM part WHERE lower(p_type) = 'promo'"),
    "sql_series": ("SELECT n_nationkey, g.x FROM nation JOIN generate_series(1, 10, 3) AS g(x) ON g.x < n_nationkey", "SELECT n_nationkey, g.x::INT AS x FROM nation JOIN generate_series(1, 10, 3) AS g(x) ON g.x < n_nationkey"),
    "sql_series_down": ("SELECT x FROM generate_series(9, 1, -4) AS g(x)", "SELECT x::INT AS x FROM generate_series(9, 1, -4) AS g(x)"),
    "sql_json_each": (
        "SELECT e.event_id, j.key, j.value, j.type FROM events e, json_each(e.props) j",
        "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value, 'integer' AS type FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
    ),
    "sql_json_functions": (
        "SELECT event_id, json_extract(props, '$.k') AS k, json_type(props, '$.k') AS t, json_valid(event_type) AS v FROM events",
        "SELECT event_id, json_extract_string(props, '$.k') AS k, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'integer' END AS t, json_valid(event_type) AS v FROM events",
    ),
    "sql_any_all_equal": (
        "SELECT c_custkey, c_nationkey <> ANY (SELECT s_nationkey FROM supplier) AS a, c_nationkey = ALL (SELECT r_regionkey FROM region WHERE r_regionkey = 3) AS b FROM customer",
        "SELECT c_custkey, c_nationkey <> (SELECT min(s_nationkey) FROM supplier) OR c_nationkey <> (SELECT max(s_nationkey) FROM supplier) AS a, c_nationkey = 3 AS b FROM customer",
    ),
    "sql_like_backslash": ("SELECT n_nationkey, ('a\\b' LIKE 'a\\b') AS m, length('a\\b') AS n FROM nation", "SELECT n_nationkey, true AS m, 3 AS n FROM nation"),
    "distinct_on_limit": (
        "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 5",
        "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey ORDER BY o_custkey DESC LIMIT 5",
    ),
    "distinct_on_nested": (
        "SELECT count(*) AS n, sum(d.o_orderkey) AS s FROM (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey) AS d WHERE d.o_custkey % 2 = 0",
        "SELECT count(*) AS n, sum(k)::BIGINT AS s FROM (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY o_custkey) WHERE o_custkey % 2 = 0",
    ),
    "fetch_without_offset": ("SELECT s_suppkey FROM supplier ORDER BY s_suppkey DESC FETCH FIRST 4 ROWS ONLY", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey DESC LIMIT 4"),
    "json_arrows": ("SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k, props -> '$.k' AS j FROM events", "SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k, CAST(props -> '$.k' AS VARCHAR) AS j FROM events"),
}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    tables = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_tables(configure(spark), sf_dir, tables or ["region"])
        return sql(spark, text)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(text) for name, text in SAME.items()} | {name: _query(text) for name, (text, _) in PAIRS.items()}


def oracle_sql() -> dict[str, str]:
    return SAME | {name: text for name, (_, text) in PAIRS.items()}
