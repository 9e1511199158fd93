"""Named queries over the Parquet tables: each with its Spark SQL text and, where it differs, the oracle's text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: name -> SQL that Spark and the oracle both run
SQL: dict[str, str] = {
    # scans and projections
    "scan_all": "SELECT * FROM region",
    "proj_cols": "SELECT c_custkey, c_name FROM customer",
    "proj_qualified": "SELECT customer.c_name, customer.c_acctbal FROM customer",
    "qual_wildcard": "SELECT n.* FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey",
    "proj_alias": "SELECT c_custkey AS id, upper(c_name) AS shouted FROM customer",
    "proj_expression": "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem",
    "proj_boolean": "SELECT c_custkey, c_acctbal < 0 AS in_debt FROM customer",
    "proj_cast": "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS DOUBLE) AS k FROM orders",
    "join_dup_names": "SELECT a.r_name AS `a.r_name`, b.r_name AS `b.r_name` FROM region a JOIN region b ON a.r_regionkey = b.r_regionkey",
    # filters
    "filter_eq": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 42",
    "filter_ne": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'",
    "filter_lt": "SELECT o_orderkey FROM orders WHERE o_totalprice < 5000",
    "filter_le": "SELECT o_orderkey FROM orders WHERE o_orderkey <= 20",
    "filter_gt": "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000",
    "filter_ge": "SELECT o_orderkey FROM orders WHERE o_totalprice >= 400000",
    "filter_and_or_not": "SELECT c_custkey FROM customer WHERE (c_acctbal > 9000 OR c_mktsegment = 'BUILDING') AND NOT c_nationkey = 3",
    "filter_bool": "SELECT c_custkey FROM (SELECT c_custkey, c_acctbal < 0 AS in_debt FROM customer) t WHERE in_debt",
    "filter_in": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity IN (1, 7)",
    "filter_not_in": "SELECT n_name FROM nation WHERE n_regionkey NOT IN (0, 2)",
    "filter_between": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12",
    "filter_not_between": "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45",
    "filter_column_to_column": "SELECT n_nationkey FROM nation WHERE n_nationkey > n_regionkey * 5",
    "filter_timestamp": "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-02-01 00:00:00'",
    "like_prefix": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 's%'",
    "like_suffix": "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%L'",
    "like_contains": "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%'",
    "like_underscore": "SELECT n_nationkey, n_name FROM nation WHERE n_name LIKE '______%'",
    "not_like": "SELECT p_partkey FROM part WHERE p_type NOT LIKE '%O%'",
    "null_is": "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL",
    "null_isnot": "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL",
    "null_3vl": "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (l.quality = 1) OR l.toxic = 1 AND d.n_chars > 100",
    "null_in": "SELECT d.doc_id, l.quality IN (0, 1) AS known FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "null_kleene": "SELECT d.doc_id, (l.quality = 1) OR TRUE AS a, (l.quality = 1) AND FALSE AS b, NOT (l.quality = 1) AS c FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    # arithmetic and functions
    "arith_add": "SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS x FROM lineitem",
    "arith_sub": "SELECT o_orderkey, o_totalprice - 1000 AS x FROM orders",
    "arith_mul": "SELECT p_partkey, p_size * 3 AS x FROM part",
    "arith_neg": "SELECT c_custkey, -c_acctbal AS x FROM customer",
    "float_div": "SELECT l_orderkey, l_extendedprice / l_quantity AS x FROM lineitem",
    "fn_lower": "SELECT n_nationkey, lower(n_name) AS x FROM nation",
    "fn_upper": "SELECT doc_id, upper(lang) AS x FROM documents",
    "fn_length": "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars FROM documents",
    "fn_coalesce": "SELECT d.doc_id, coalesce(l.quality, l.toxic, -1) AS x FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "fn_ifnull": "SELECT d.doc_id, ifnull(l.quality, 9) AS x FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "fn_abs": "SELECT c_custkey, abs(c_acctbal) AS x FROM customer",
    "fn_in_order_by": "SELECT n_name FROM nation ORDER BY length(n_name), lower(n_name)",
    "variadic_greatest_least": "SELECT l_orderkey, l_linenumber, greatest(l_quantity, l_partkey * 1.0) AS g, least(l_quantity, l_partkey * 1.0) AS s FROM lineitem",
    # joins
    "join_inner": "SELECT c.c_name, o.o_orderkey, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000",
    "join_right": "SELECT d.doc_id, l.quality FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id",
    "join_cross": "SELECT a.r_name AS a_name, b.r_name AS b_name FROM region a CROSS JOIN region b",
    "join_three_way": "SELECT r.r_name, n.n_name, c.c_name FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey",
    "join_theta": "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey < r.r_regionkey",
    "join_range": "SELECT p.p_partkey, g.lo FROM part p JOIN (SELECT r_regionkey * 10 AS lo, r_regionkey * 10 + 4 AS hi FROM region) g ON p.p_size BETWEEN g.lo AND g.hi",
    "join_null_keys": "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON nullif(n.n_regionkey, 0) = r.r_regionkey",
    "join_empty": "SELECT n.n_name, r.r_name FROM nation n LEFT JOIN (SELECT * FROM region WHERE r_regionkey > 99) r ON n.n_regionkey = r.r_regionkey",
    "join_where_on_outer": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000 WHERE o.o_totalprice > 450000",
    "join_self": "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_residual": "SELECT o.o_orderkey, l.l_linenumber, l.l_quantity FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_quantity > 40 AND o.o_totalprice < 100000",
    "join_comma": "SELECT r.r_name, n.n_name FROM region r, nation n WHERE r.r_regionkey = n.n_regionkey",
    "join_mixed_key_types": "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_custkey = n.n_nationkey",
    "join_star": "SELECT o.o_orderkey, l.l_linenumber, p.p_name, s.s_name FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey",
    # order and limit
    "sort_multi": "SELECT c_custkey FROM customer ORDER BY c_mktsegment DESC NULLS FIRST, c_acctbal ASC NULLS LAST, c_custkey",
    "sort_nulls": "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality ASC NULLS LAST, d.doc_id",
    "sort_nulls_first": "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC NULLS FIRST, d.doc_id",
    "sort_expression": "SELECT p_partkey FROM part ORDER BY p_size * -1, p_partkey",
    "sort_ordinal": "SELECT n_name, n_nationkey FROM nation ORDER BY 1 DESC",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 35",
    "offset_only": "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20",
    "offset_past_end": "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 1000",
    "limit_zero": "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 0",
    # aggregates over the whole result
    "agg_count_star": "SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem",
    "agg_count_col": "SELECT CAST(count(l.quality) AS BIGINT) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "agg_sum": "SELECT round(sum(l_quantity), 2) AS s, CAST(sum(l_linenumber) AS BIGINT) AS k FROM lineitem",
    "agg_avg": "SELECT round(avg(l_extendedprice), 4) AS a FROM lineitem",
    "agg_min": "SELECT min(l_shipdate) AS d, min(l_extendedprice) AS p FROM lineitem",
    "agg_max": "SELECT max(l_shipdate) AS d, max(l_returnflag) AS f FROM lineitem",
    "agg_filtered": "SELECT CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "agg_empty": "SELECT CAST(count(*) AS BIGINT) AS n, sum(l_quantity) AS s, avg(l_quantity) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem WHERE l_quantity < 0",
    # beyond the core: what Spark brings along
    "superset_group_by": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "superset_having": "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "superset_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "superset_count_distinct": "SELECT CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n FROM lineitem",
    "superset_rollup": "SELECT r.r_name, n.n_name, CAST(count(*) AS BIGINT) AS n FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY ROLLUP (r.r_name, n.n_name)",
    "superset_full": "SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a FULL JOIN region b ON a.n_nationkey = b.r_regionkey + 3",
    "superset_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "superset_anti": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "superset_in_subquery": "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')",
    "superset_scalar_subquery": "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)",
    "superset_union": "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey AS k FROM region",
    "superset_union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region",
    "superset_intersect": "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000 INTERSECT SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000",
    "superset_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 100000",
    "superset_window": "SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM orders",
    "superset_window_frame": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders",
    "superset_cte": "WITH big AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) SELECT c.c_name, b.top FROM customer c JOIN big b ON b.o_custkey = c.c_custkey WHERE b.top > 400000",
    "superset_case": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'fine' END AS state FROM customer",
    "superset_extract": "SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1",
    "superset_pricing": "SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name",
    "superset_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
}

#: name -> (Spark, oracle) where the dialects differ
PAIRS: dict[str, tuple[str, str]] = {
    "int_div": ("SELECT p_partkey, (p_size - 25) DIV 7 AS x FROM part", "SELECT p_partkey, (p_size - 25) // 7 AS x FROM part"),
    "int_div_zero": ("SELECT p_partkey, p_size DIV nullif(p_size - p_size, 0) AS x FROM part", "SELECT p_partkey, CAST(NULL AS BIGINT) AS x FROM part"),
    "fn_octet_length": ("SELECT doc_id, CAST(octet_length(text) AS BIGINT) AS x FROM documents", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS x FROM documents"),
    "fn_len": ("SELECT n_name, CAST(len(n_name) AS BIGINT) AS x, lcase(n_name) AS l, ucase(n_name) AS u FROM nation", "SELECT n_name, CAST(length(n_name) AS BIGINT) AS x, lower(n_name) AS l, upper(n_name) AS u FROM nation"),
    "fn_round": ("SELECT l_orderkey, l_linenumber, round(l_extendedprice * 10) / 10 AS x FROM lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * 10) / 10 AS x FROM lineitem"),
}
PAIRS["int_div"] = (PAIRS["int_div"][0].replace("(p_size - 25) DIV 7", "CAST((p_size - 25) DIV 7 AS BIGINT)"), PAIRS["int_div"][1].replace("(p_size - 25) // 7", "CAST((p_size - 25) // 7 AS BIGINT)"))


def load(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Temp views of the tables; scans stay lazy, so filters and columns reach Parquet."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        load(spark, sf_dir, used)
        return spark.sql(text)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(text) for name, text in SQL.items()} | {name: _query(a) for name, (a, _) in PAIRS.items()}


def oracles() -> dict[str, str]:
    return {name: text.replace("`", '"') for name, text in SQL.items()} | {name: b for name, (_, b) in PAIRS.items()}
