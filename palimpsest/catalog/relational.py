"""Relational queries, as SQL that Spark plans; the oracle's SQL is given where its dialect differs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: name: SQL, or (Spark's SQL, the oracle's SQL).
QUERIES: dict[str, str | tuple[str, str]] = {
    # projections
    "proj_star": "SELECT * FROM nation",
    "proj_alias": "SELECT c_custkey AS id, c_name AS customer_name FROM customer",
    "proj_qualified": "SELECT o.o_orderkey, o.o_totalprice FROM orders AS o WHERE o.o_orderstatus = 'F'",
    "proj_qualified_star": "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "proj_arith": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, l_quantity + 1 AS more, l_quantity - 1 AS less FROM lineitem",
    "proj_div_zero": (
        "SELECT p_partkey, try_divide(p_retailprice, p_size - 10) AS ratio FROM part",
        "SELECT p_partkey, p_retailprice / nullif(p_size - 10, 0) AS ratio FROM part",
    ),
    "proj_modulo": "SELECT o_orderkey, o_orderkey % 7 AS m, CAST(-(o_orderkey % 7) AS BIGINT) AS neg FROM orders",
    "proj_case_searched": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS tier FROM customer",
    "proj_case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders",
    "proj_nested_expr": "SELECT p_partkey, CASE WHEN p_size > 25 THEN (p_size + 1) * 2 ELSE (p_size - (1 - p_size)) END AS x FROM part",
    "proj_functions": "SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS low, length(c_name) AS n, concat(c_mktsegment, '-', c_name) AS both FROM customer",
    "proj_coalesce_cast": "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'done') AS status, CAST(o_orderkey AS VARCHAR(20)) AS text_key FROM orders",
    "proj_concat_op": "SELECT n_nationkey, n_name || '/' || CAST(n_regionkey AS VARCHAR(10)) AS tag FROM nation",
    "proj_compare_values": "SELECT c_custkey, c_acctbal > 0 AS positive, c_mktsegment = 'BUILDING' AS building, NOT (c_acctbal > 0) AS negative FROM customer",
    "proj_extract": "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m FROM orders",
    "select_without_from": "SELECT 1 AS one, 1 + 1 AS two, 'x' AS s, 7 % 3 AS m, 2 > 1 AS b, NULL IS NULL AS n",
    # filters
    "filter_eq": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
    "filter_ne": "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'",
    "filter_range": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_quantity < 48 AND l_discount > 0.05",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%A%' AND p_brand LIKE 'Brand#_1%'",
    "filter_not_like": "SELECT p_partkey FROM part WHERE p_type NOT LIKE '%E%'",
    "filter_in": "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)",
    "filter_in_and": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "filter_not_in": "SELECT n_name FROM nation WHERE n_regionkey NOT IN (1, 3)",
    "filter_null": "SELECT c_custkey FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) t WHERE seg IS NULL",
    "filter_not_null": "SELECT c_custkey, seg FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) t WHERE seg IS NOT NULL AND c_custkey > 10",
    "filter_null_comparison": "SELECT c_custkey FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) t WHERE seg <> 'MACHINERY'",
    "filter_between": "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000",
    "filter_not_between": "SELECT o_orderkey FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 400000",
    "filter_or_not": "SELECT c_custkey FROM customer WHERE NOT (c_mktsegment = 'BUILDING' OR c_acctbal < 0)",
    "filter_and_or": "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_acctbal > 0) OR (c_nationkey = 5 AND c_acctbal < 0)",
    "filter_column_compare": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey",
    "filter_negative_literal": "SELECT c_custkey FROM customer WHERE c_acctbal > -500 AND c_acctbal < -10",
    "filter_pk": "SELECT * FROM customer WHERE c_custkey = 42",
    "filter_index_range": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 200",
    # subqueries
    "semi_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "anti_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
    "anti_not_in_null": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders)",
    "exists_uncorrelated": "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_name = 'ASIA')",
    "exists_corr": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    "not_exists_corr": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    "scalar_sub_select": "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c",
    "scalar_sub_where": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "scalar_sub_corr_where": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "scalar_sub_empty": "SELECT n_nationkey, (SELECT r_name FROM region WHERE r_regionkey = -1) AS none FROM nation",
    "any_rewrite": (
        "SELECT p_partkey FROM part WHERE p_retailprice < (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = 3)",
        "SELECT p_partkey FROM part WHERE p_retailprice < ANY (SELECT s_acctbal FROM supplier WHERE s_nationkey = 3)",
    ),
    "all_rewrite": (
        "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) FROM orders WHERE o_orderstatus = 'P')",
        "SELECT o_orderkey FROM orders WHERE o_totalprice > ALL (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'P')",
    ),
    "derived_table": "SELECT seg, n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) t WHERE n > 1",
    "nested_subquery": "SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50))",
    # joins
    "join_inner": "SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'",
    "join_right": "SELECT c.c_name, o.o_orderkey FROM customer c RIGHT JOIN orders o ON c.c_custkey = o.o_custkey AND c.c_acctbal > 5000",
    "join_full": "SELECT s.s_suppkey, c.c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 0) s FULL JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON s.s_suppkey = c.c_custkey",
    "join_cross": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "join_self": "SELECT a.n_name AS first_name, b.n_name AS second_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_using": "SELECT k, a.c_name, b.o_orderkey FROM (SELECT c_custkey AS k, c_name FROM customer) a JOIN (SELECT o_custkey AS k, o_orderkey FROM orders) b USING (k)",
    "join_multi": "SELECT r.r_name, n.n_name, c.c_custkey, o.o_orderkey FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'",
    "join_theta": "SELECT a.r_name AS x, b.r_name AS y FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey",
    "join_multi_key": "SELECT l.l_orderkey, l.l_linenumber, o.o_custkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey AND l.l_shipdate > o.o_orderdate WHERE l.l_quantity > 49",
    "join_null_keys": "SELECT a.c_custkey, b.s_suppkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) a LEFT JOIN (SELECT s_suppkey, nullif(s_nationkey, 3) AS k FROM supplier) b ON a.k = b.k",
    "join_anti": (
        "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'",
        "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_orderpriority = '1-URGENT')",
    ),
    "join_over_cte": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000) SELECT c.c_name, b.o_orderkey FROM big b JOIN customer c ON b.o_custkey = c.c_custkey",
    "join_agg": "SELECT n.n_name, count(*) AS n, round(sum(c.c_acctbal), 2) AS total FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    # aggregation
    "agg_global": "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders",
    "agg_empty": "SELECT count(*) AS n, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, min(o_orderstatus) AS low FROM orders WHERE o_orderkey < 0",
    "agg_count": "SELECT count(*) AS n, count(seg) AS some FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) t",
    "agg_count_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_orderstatus",
    "agg_sum_int": ("SELECT o_orderstatus, sum(o_custkey) AS s FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus"),
    "agg_avg": "SELECT l_returnflag, round(avg(l_quantity), 6) AS q FROM lineitem GROUP BY l_returnflag",
    "agg_minmax_strings": "SELECT n_regionkey, min(n_name) AS first_name, max(n_name) AS last_name FROM nation GROUP BY n_regionkey",
    "agg_expression": "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(sum(l_extendedprice) / count(*), 4) AS each_line FROM lineitem GROUP BY l_returnflag",
    "agg_case": "SELECT count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o, CASE WHEN count(*) > 10 THEN 'many' ELSE 'few' END AS size FROM orders",
    "group_multi": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "group_no_agg": "SELECT c_mktsegment, c_nationkey FROM customer GROUP BY c_mktsegment, c_nationkey",
    "group_expression": "SELECT p_size % 10 AS bucket, count(*) AS n FROM part GROUP BY p_size % 10",
    "group_null_keys": "SELECT seg, nation, count(*) AS n FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS seg, nullif(c_nationkey, 3) AS nation FROM customer) t GROUP BY seg, nation",
    "group_having": "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 5 AND avg(c_acctbal) > 4000",
    "having_alias": "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 1000000",
    "distinct_cols": "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer",
    "distinct_rows": "SELECT DISTINCT * FROM lineitem",
    "agg_filter": "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big FROM lineitem GROUP BY l_returnflag",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_stddev": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY l_returnflag",
    # order, limit
    "order_limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    "order_nulls_last": "SELECT k, seg FROM (SELECT c_custkey AS k, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) t ORDER BY seg ASC NULLS LAST, k LIMIT 50",
    "order_nulls_first": "SELECT k, seg FROM (SELECT c_custkey AS k, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) t ORDER BY seg DESC NULLS FIRST, k LIMIT 50",
    "order_unselected": "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7",
    "order_expression": "SELECT c_custkey FROM customer ORDER BY abs(c_acctbal), c_custkey LIMIT 9",
    "order_aggregate": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10",
    "offset_only": "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20",
    "topk_per_group": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 2",
    # sets
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "intersect": "SELECT c_nationkey AS a, c_custkey % 5 AS b FROM customer INTERSECT SELECT s_nationkey AS a, s_suppkey % 5 AS b FROM supplier",
    "intersect_all": "SELECT c_nationkey AS a FROM customer INTERSECT ALL SELECT s_nationkey AS a FROM supplier",
    "except": "SELECT c_nationkey AS a, c_custkey % 5 AS b FROM customer EXCEPT SELECT s_nationkey AS a, s_suppkey % 5 AS b FROM supplier",
    "except_all": "SELECT c_nationkey AS a FROM customer EXCEPT ALL SELECT s_nationkey AS a FROM supplier",
    "set_order_limit": "SELECT k FROM (SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey AS k FROM supplier) t ORDER BY k DESC LIMIT 10",
    # common table expressions
    "cte_simple": "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT * FROM t WHERE n > 12",
    "cte_chained": "WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT avg(s) AS mean FROM a) SELECT a.k FROM a CROSS JOIN b WHERE a.s > 2 * b.mean",
    "cte_recursive": ("WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 40) SELECT n, f FROM t"),
    "cte_window": "WITH t AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P') SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS r FROM t",
    # windows
    "win_row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders",
    "win_rank": "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS r, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS d FROM orders",
    "win_percent_rank": "SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice), 9) AS p, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_totalprice), 9) AS c FROM orders",
    "win_ntile": "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS q FROM orders",
    "win_lag_lead": "SELECT o_orderkey, lag(o_totalprice) OVER w AS before_, lead(o_totalprice, 2, -1.0) OVER w AS after_ FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win_first_last": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_last_default_frame": "SELECT o_orderkey, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS l FROM orders",
    "win_nth": "SELECT o_orderkey, nth_value(o_orderkey, 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third FROM orders",
    "win_running": "SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS s, avg(o_orderkey) OVER w AS a, count(*) OVER w AS n, min(o_totalprice) OVER w AS lo, max(o_totalprice) OVER w AS hi FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win_rows_frame": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s FROM orders",
    "win_range_frame": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 50 PRECEDING AND CURRENT ROW) AS n FROM orders",
    "win_whole": "SELECT c_custkey, avg(CAST(round(c_acctbal * 100) AS BIGINT)) OVER (PARTITION BY c_nationkey) AS mean_cents FROM customer",
    "win_nulls_last": "SELECT c_custkey, row_number() OVER (ORDER BY nullif(c_mktsegment, 'BUILDING') ASC NULLS LAST, c_custkey) AS rn FROM customer",
    # the rest of what the dialect has
    "join_natural": ("SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b"),
    "join_lateral": "SELECT n.n_name, t.top FROM nation n, LATERAL (SELECT max(c.c_acctbal) AS top FROM customer c WHERE c.c_nationkey = n.n_nationkey) t",
    "join_semi": ("SELECT s_suppkey FROM supplier LEFT SEMI JOIN customer ON s_nationkey = c_nationkey AND c_acctbal > 9900", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE s_nationkey = c_nationkey AND c_acctbal > 9900)"),
    "join_range": "SELECT s.s_suppkey, count(*) AS n FROM supplier s JOIN customer c ON c.c_nationkey = s.s_nationkey AND c.c_acctbal BETWEEN s.s_acctbal - 200 AND s.s_acctbal + 200 GROUP BY s.s_suppkey",
    "join_asof": (
        "SELECT o_orderkey, prev FROM (SELECT o_orderkey, is_order, max(CASE WHEN NOT is_order THEN at END) OVER (PARTITION BY k ORDER BY at, is_order ROWS UNBOUNDED PRECEDING) AS prev FROM (SELECT o_orderkey, o_custkey AS k, o_orderdate AS at, true AS is_order FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT NULL, o_custkey, o_orderdate, false FROM orders WHERE o_orderstatus = 'P') t) u WHERE is_order",
        "SELECT a.o_orderkey, b.at AS prev FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') a ASOF LEFT JOIN (SELECT DISTINCT o_custkey AS k, o_orderdate AS at FROM orders WHERE o_orderstatus = 'P') b ON a.o_custkey = b.k AND a.o_orderdate >= b.at",
    ),
    "scalar_sub_boolean": "SELECT n_name FROM nation WHERE (SELECT count(*) > 4 FROM region)",
    "agg_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "agg_percentile": ("SELECT l_returnflag, round(percentile(l_quantity, 0.9), 6) AS p FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.9), 6) AS p FROM lineitem GROUP BY l_returnflag"),
    "agg_array": ("SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_bool": "SELECT o_orderstatus, bool_or(o_totalprice > 400000) AS some, bool_and(o_totalprice > 1000) AS every_ FROM orders GROUP BY o_orderstatus",
    "distinct_on": (
        "SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, -o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey",
        "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    ),
    "with_ties": "SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part) t WHERE r <= 10",
    "set_minus": ("SELECT c_nationkey AS a FROM customer MINUS SELECT s_nationkey AS a FROM supplier WHERE s_acctbal > 8000", "SELECT c_nationkey AS a FROM customer EXCEPT SELECT s_nationkey AS a FROM supplier WHERE s_acctbal > 8000"),
    "proj_cast_coalesce": "SELECT o_orderkey, CAST(o_custkey AS VARCHAR(20)) AS t, coalesce(nullif(o_orderstatus, 'P'), 'pending') AS s, -o_custkey AS neg, NOT (o_totalprice > 1000) AS small FROM orders",
    "proj_like_value": "SELECT p_partkey, p_brand LIKE 'Brand#1%' AS first_brand FROM part",
    "proj_math": "SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS r, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(sign(c_acctbal) AS INT) AS s, round(power(c_acctbal / 1000, 2), 6) AS p FROM customer",
    "proj_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"),
    "proj_arrays": ("SELECT doc_id, size(split(text, ' ')) AS n, element_at(split(text, ' '), 1) AS first_word, array_contains(split(text, ' '), 'the') AS has_the FROM documents", "SELECT doc_id, CAST(len(string_split(text, ' ')) AS INT) AS n, string_split(text, ' ')[1] AS first_word, list_contains(string_split(text, ' '), 'the') AS has_the FROM documents"),
    "proj_dates": ("SELECT o_orderkey, date_format(date_trunc('month', o_orderdate), 'yyyy-MM-dd') AS m, datediff(DATE '1999-01-01', o_orderdate) AS days FROM orders", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, CAST(DATE '1999-01-01' - CAST(o_orderdate AS DATE) AS INT) AS days FROM orders"),
    "server_shims": ("SELECT current_database() IS NOT NULL AS db, version() IS NOT NULL AS v, current_timestamp() > TIMESTAMP '2020-01-01' AS now", "SELECT current_database() IS NOT NULL AS db, version() IS NOT NULL AS v, current_localtimestamp() > TIMESTAMP '2020-01-01' AS now"),
    # larger ones
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "top_customers": "SELECT c.c_custkey, c.c_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 4) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY c.c_custkey, c.c_name ORDER BY revenue DESC, c.c_custkey LIMIT 20",
    "region_revenue": "SELECT r.r_name, n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 4) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name",
}


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Temporary views of the tables that a statement names."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    views(spark, sf_dir, sql)
    return spark.sql(sql)
