"""Relational queries whose text Spark and DuckDB share; where the dialects differ, DuckDB's text stands second."""

from __future__ import annotations

import re

from chronoframe.session import TABLES

#: name: SQL, or (Spark's SQL, DuckDB's SQL).
SQL: dict[str, str | tuple[str, str]] = {
    "agg_pricing_summary": """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
               round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "scan_full": "SELECT * FROM nation",
    "scan_filter_project": "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.05",
    "scan_point_lookup": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7",
    "scan_prefix": "SELECT p_partkey, p_name FROM part WHERE p_type LIKE 'S%'",
    "scan_index_equality": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'",
    "scan_composite_equality": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    "scan_index_in": "SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'signup')",
    "scan_index_range": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000",
    "select_no_from": "SELECT 1 + 1 AS two, 'x' AS x",
    "subq_from": "SELECT s.k, s.n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) s WHERE s.n > 12",
    "pred_comparison": """SELECT o_orderkey, o_totalprice <> 100 AS ne, o_totalprice >= 1e5 AS ge, NOT (o_orderstatus = 'O') AS n
        FROM orders WHERE o_custkey < 40 OR (o_totalprice > 200000 AND o_orderstatus = 'P')""",
    "pred_null": "SELECT c.c_custkey, o.o_orderkey IS NULL AS none FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000 WHERE o.o_orderkey IS NULL OR c.c_acctbal IS NOT NULL AND c.c_custkey IS NULL",
    "pred_between": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02 AND 0.08",
    "pred_in": "SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (2, 7)",
    "pred_like": "SELECT p_partkey FROM part WHERE p_name LIKE '%a_e%' AND p_type NOT LIKE 'M%'",
    "pred_ilike": "SELECT p_partkey FROM part WHERE p_brand ILIKE 'brand%1%' AND p_type NOT ILIKE '%steel'",
    "case_when": """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS simple,
        CASE WHEN o_totalprice > 200000 THEN 3 WHEN o_totalprice > 100000 THEN 2 ELSE 1 END AS searched FROM orders""",
    "arithmetic": (
        "SELECT l_orderkey, l_linenumber, -l_quantity AS neg, l_quantity - 1.5 AS minus, try_divide(l_quantity, l_linenumber - 1) AS q, try_mod(l_orderkey, CAST(l_linenumber - 1 AS BIGINT)) AS m FROM lineitem",
        "SELECT l_orderkey, l_linenumber, -l_quantity AS neg, l_quantity - 1.5 AS minus, CASE WHEN l_linenumber <> 1 THEN l_quantity / (l_linenumber - 1) END AS q, CASE WHEN l_linenumber <> 1 THEN l_orderkey % (l_linenumber - 1) END AS m FROM lineitem",
    ),
    "cast_all": (
        "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18, 2)) AS d, CAST(trunc_price AS BIGINT) AS i, try_cast(o_orderpriority AS INT) AS bad, CAST(o_orderkey AS STRING) AS s FROM (SELECT *, floor(o_totalprice) AS trunc_price FROM orders)",
        "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18, 2)) AS d, CAST(floor(o_totalprice) AS BIGINT) AS i, try_cast(o_orderpriority AS INT) AS bad, CAST(o_orderkey AS VARCHAR) AS s FROM orders",
    ),
    "subq_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "subq_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "subq_exists": "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)",
    "subq_not_exists": "SELECT s_suppkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal < -900)",
    "subq_scalar": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
    "join_right": "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'",
    "join_full": "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey * 20",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_theta": "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey",
    "join_index_nested": "SELECT n_name, s_name FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey",
    "join_multiway": """SELECT c_custkey, round(sum(l_extendedprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey
        JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 GROUP BY c_custkey""",
    "join_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey"),
    "join_anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000", "SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000"),
    "join_shared_key": (
        "SELECT l.pk, l.name, r.name AS right_name FROM (SELECT c_custkey AS pk, c_name AS name FROM customer) l JOIN (SELECT s_suppkey AS pk, s_name AS name FROM supplier) r USING (pk)",
        "SELECT pk, l.name, r.name AS right_name FROM (SELECT c_custkey AS pk, c_name AS name FROM customer) l JOIN (SELECT s_suppkey AS pk, s_name AS name FROM supplier) r USING (pk)",
    ),
    "agg_count": "SELECT count(*) AS n, count(o_orderkey) AS k, count(DISTINCT o_custkey) AS d FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
    "agg_group": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_orderstatus",
    "agg_group_expr": "SELECT o_custkey % 7 AS k, o_orderstatus AS st, count(*) AS n FROM orders GROUP BY o_custkey % 7, o_orderstatus",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 100000",
    "agg_expression": "SELECT l_returnflag, round(sum(l_extendedprice) / count(*), 2) AS mean, CASE WHEN sum(l_quantity) > 1000 THEN 'big' ELSE 'small' END AS size, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY l_returnflag",
    "agg_empty": "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0",
    "agg_string": (
        "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ),
    "agg_stats": """SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 5) AS vs,
        round(var_pop(l_quantity), 5) AS vp FROM lineitem GROUP BY l_returnflag""",
    "agg_first_last": (
        "SELECT user_id, min_by(value, struct(ts, event_id)) AS first_value, max_by(value, struct(ts, event_id)) AS last_value FROM events GROUP BY user_id",
        "SELECT user_id, arg_min(value, {'t': ts, 'e': event_id}) AS first_value, arg_max(value, {'t': ts, 'e': event_id}) AS last_value FROM events GROUP BY user_id",
    ),
    "agg_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "select_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "win_row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders",
    "win_rank": "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS r, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS d FROM lineitem",
    "win_lead_lag": "SELECT event_id, lead(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, lag(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prv FROM events",
    "win_frame": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s FROM events",
    "sort_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20",
    "set_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey + 10 AS k FROM supplier",
    "set_intersect": "SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey AS k FROM supplier",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 200000",
    "cte_chain": "WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT k, s FROM a WHERE s > 500000) SELECT k, round(s, 2) AS s FROM b",
    "cte_recursive": "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
    "cte_hierarchy": (
        """WITH RECURSIVE tree(id, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL
        SELECT e.id, depth + 1 FROM tree JOIN (SELECT c_custkey AS id, CAST(floor((c_custkey - 1) / 3) AS BIGINT) AS parent FROM customer) e ON e.parent = tree.id WHERE e.id <> tree.id)
        SELECT id, depth FROM tree""",
        """WITH RECURSIVE tree(id, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL
        SELECT e.id, depth + 1 FROM tree JOIN (SELECT c_custkey AS id, CAST(floor((c_custkey - 1) / 3) AS BIGINT) AS parent FROM customer) e ON e.parent = tree.id WHERE e.id <> tree.id)
        SELECT id, depth FROM tree""",
    ),
    "fn_string": (
        """SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS lo, LENGTH(c_name) AS bytes, SUBSTR(c_name, c_custkey % 5 - 1, 4) AS sub,
           replace(c_name, '0', 'o') AS rep, CONCAT(c_name, NULL, '!') AS cat, concat_ws('-', c_mktsegment, NULL, 'x') AS ws, left(c_name, 3) AS lef, right(c_name, 2) AS rig,
           lpad(CAST(c_custkey AS STRING), 8, '*') AS lp, rpad(c_mktsegment, 4, '.') AS rp, reverse(c_name) AS rev, SPLIT_PART(c_name, '#', c_custkey % 3) AS part, repeat(c_mktsegment, 2) AS twice,
           STRPOS(c_name, '00') AS pos, INITCAP(CONCAT(' ', c_mktsegment, '  x')) AS cap, TRIM(CONCAT(' ', c_name, ' ')) AS bare FROM customer""",
        """SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS lo, strlen(c_name) AS bytes, substring(c_name, greatest(c_custkey % 5 - 1, 1), 4) AS sub,
           replace(c_name, '0', 'o') AS rep, concat(c_name, NULL, '!') AS cat, concat_ws('-', c_mktsegment, NULL, 'x') AS ws, left(c_name, 3) AS lef, right(c_name, 2) AS rig,
           lpad(CAST(c_custkey AS VARCHAR), 8, '*') AS lp, CASE WHEN length(c_mktsegment) > 4 THEN left(c_mktsegment, 4) ELSE rpad(c_mktsegment, 4, '.') END AS rp, reverse(c_name) AS rev,
           CASE WHEN c_custkey % 3 = 0 THEN '' ELSE split_part(c_name, '#', (c_custkey % 3)::INT) END AS part, repeat(c_mktsegment, 2) AS twice, instr(c_name, '00') AS pos,
           upper(left(c_mktsegment, 1)) || lower(substring(c_mktsegment, 2)) || ' X' AS cap, c_name AS bare FROM customer""",
    ),
    "fn_numeric": (
        """SELECT o_orderkey, abs(o_totalprice - 1e5) AS ab, round(o_totalprice, 1) AS ro, CAST(ceil(o_totalprice) AS DOUBLE) AS ce, CAST(floor(o_totalprice) AS DOUBLE) AS fl, power(o_custkey, 2) AS po,
           round(SQRT(o_totalprice - 100000), 9) AS sq, round(LOG(o_totalprice), 9) AS lg, round(ln(o_totalprice), 9) AS l, round(exp(o_custkey / 1000), 9) AS ex, sign(o_custkey - 50) AS sg,
           greatest(o_custkey, 100, NULL) AS gr, least(o_custkey, 100, NULL) AS le FROM orders""",
        """SELECT o_orderkey, abs(o_totalprice - 1e5) AS ab, round(o_totalprice, 1) AS ro, ceil(o_totalprice) AS ce, floor(o_totalprice) AS fl, power(o_custkey, 2) AS po,
           round(CASE WHEN o_totalprice >= 100000 THEN sqrt(o_totalprice - 100000) END, 9) AS sq, round(log10(o_totalprice), 9) AS lg, round(ln(o_totalprice), 9) AS l, round(exp(o_custkey / 1000), 9) AS ex, sign(o_custkey - 50)::DOUBLE AS sg,
           greatest(o_custkey, 100, NULL) AS gr, least(o_custkey, 100, NULL) AS le FROM orders""",
    ),
    "fn_conditional": (
        "SELECT c_custkey, coalesce(NULL, c_name) AS co, nullif(c_mktsegment, 'BUILDING') AS nu, if(c_acctbal > 0, 'in', 'out') AS iif FROM customer",
        "SELECT c_custkey, coalesce(NULL, c_name) AS co, nullif(c_mktsegment, 'BUILDING') AS nu, CASE WHEN c_acctbal > 0 THEN 'in' ELSE 'out' END AS iif FROM customer",
    ),
    "fn_datetime": (
        """SELECT o_orderkey, EPOCH(o_orderdate) AS epoch, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS d,
           EXTRACT('dow', o_orderdate) AS dow, DATE_PART('doy', o_orderdate) AS doy, EXTRACT('week', o_orderdate) AS week_simple,
           CAST(unix_timestamp(date_trunc('week', o_orderdate)) AS BIGINT) AS wk, CAST(unix_timestamp(date_trunc('month', o_orderdate)) AS BIGINT) AS mo,
           EPOCH(DATE_ADD(o_orderdate, 90)) AS plus, EPOCH(MAKE_TIMESTAMP(o_orderkey)) AS made FROM orders""",
        """SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS epoch, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS d,
           dayofweek(o_orderdate) AS dow, dayofyear(o_orderdate) AS doy, ((dayofyear(o_orderdate) - 1) // 7 + 1)::INT AS week_simple,
           epoch(date_trunc('week', o_orderdate))::BIGINT AS wk, epoch(date_trunc('month', o_orderdate))::BIGINT AS mo,
           epoch(o_orderdate)::BIGINT + 90 AS plus, epoch(to_timestamp(o_orderkey))::BIGINT AS made FROM orders""",
    ),
    "fn_json": (
        """SELECT event_id, props ->> 'k' AS k, props -> 'k' AS raw, json_array_length(CONCAT('[', props ->> 'k', ',0]')) AS n,
           props ->> 'none' AS missing, JSON_TYPE(props) AS kind, props @> '{"k": 7}' AS seven FROM events""",
        "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract(props, '$.k') AS VARCHAR) AS raw, json_array_length('[' || json_extract_string(props, '$.k') || ',0]')::INT AS n, json_extract_string(props, '$.none') AS missing, lower(json_type(props)) AS kind, json_extract_string(props, '$.k') = '7' AS seven FROM events",
    ),
    "ai_top_risk_words": (
        "SELECT word, count(*) AS n FROM (SELECT explode(split(lower(event_type), '')) AS word FROM events) WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 5",
        "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(event_type), '')) AS word FROM events) WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 5",
    ),
}


def texts(name: str) -> tuple[str, str]:
    """(Spark's SQL, DuckDB's SQL)."""
    found = SQL[name]
    return (found, found) if isinstance(found, str) else found


def tables_of(sql: str) -> list[str]:
    """The tables that a query names."""
    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
