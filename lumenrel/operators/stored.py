"""Named queries that run through the engine's own tables: changes, transactions and JSON queries."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import errors
from ..engine import Engine
from ..functions.scalar import uuidv7
from . import catalogue
from .dml import Transaction


def _engine(spark: SparkSession) -> Engine:
    """A new engine in the folder that executors share, or a temporary one where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    shared = shared or f"file://{tempfile.mkdtemp(prefix='lumenrel-')}"
    return Engine(spark, os.path.join(shared.removeprefix("file://"), f"engine-{uuid.uuid4().hex}"))


def _seed(spark: SparkSession, sf_dir: str, table: str, ddl: str) -> Engine:
    engine = _engine(spark)
    engine.sql(ddl)
    with engine.transaction() as tx:
        tx.insert(table, spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    return engine


NATION = "CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT NOT NULL, n_regionkey INTEGER)"
CUSTOMER = "CREATE TABLE customer (c_custkey BIGINT PRIMARY KEY, c_name TEXT, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment TEXT)"
ORDERS = "CREATE TABLE orders (o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT REFERENCES customer(c_custkey), o_orderstatus TEXT, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority TEXT)"


def _nation(*changes: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _seed(spark, sf_dir, "nation", NATION)
        return engine.sql("; ".join([*changes, "SELECT * FROM nation"]))

    return run


def _both(spark: SparkSession, sf_dir: str) -> Engine:
    engine = _seed(spark, sf_dir, "customer", CUSTOMER)
    engine.sql(ORDERS)
    with engine.transaction() as tx:
        tx.insert("orders", spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return engine


def _find(**query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _seed(spark, sf_dir, "customer", CUSTOMER).structured_frame({"op": "findMany", "from": "customer", **query})


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _seed(spark, sf_dir, "nation", NATION)
    engine.structured({"op": "upsert", "in": "nation", "where": {"n_nationkey": 3}, "update": {"n_name": "changed"}, "create": {"n_nationkey": 3, "n_name": "x"}})
    engine.structured({"op": "upsert", "in": "nation", "where": {"n_nationkey": 99}, "update": {"n_name": "no"}, "create": {"n_nationkey": 99, "n_name": "made", "n_regionkey": 1}})
    return engine.sql("SELECT * FROM nation")


def _transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _seed(spark, sf_dir, "nation", NATION)
    with engine.transaction() as tx:
        engine.sql("DELETE FROM nation WHERE n_regionkey = 0; UPDATE nation SET n_name = 'in one' WHERE n_regionkey = 1", tx=tx)
    try:
        with engine.transaction() as tx:
            engine.sql("DELETE FROM nation", tx=tx)
            raise InterruptedError
    except InterruptedError:
        pass
    return engine.sql("SELECT * FROM nation")


def _include(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _both(spark, sf_dir)
    found = engine.structured_frame(
        {
            "op": "findMany", "from": "customer", "select": {"c_custkey": True},
            "include": {"orders": {"where": {"o_totalprice": {"gt": 300000}}, "select": {"o_orderkey": True}, "orderBy": {"o_orderkey": "asc"}, "take": 2}},
        }
    )
    return found.selectExpr("c_custkey", "array_join(transform(orders, x -> cast(x.o_orderkey as string)), ',') AS orders")


def _uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", uuidv7().alias("id"))


def _seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _both(spark, sf_dir)
    return engine.sql("CREATE INDEX by_customer ON orders (o_custkey); SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")


_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "TEXT", "timestamp_ntz": "TIMESTAMP"}


def _through_engine(text: str, *tables: str, first: str = "") -> Callable[[SparkSession, str], DataFrame]:
    """The query's text by the engine, over its own copies of whole tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _engine(spark)
        with engine.transaction() as tx:
            for t in tables:
                rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
                engine.sql(f"CREATE TABLE {t} ({', '.join(f'{c} {_TYPES[kind]}' for c, kind in rows.dtypes)})")
                tx.insert(t, rows)
        if first:
            engine.sql(first)
        return engine.sql(text)

    return run


def _outcomes(spark: SparkSession, steps: list[tuple[str, Callable[[], object]]]) -> DataFrame:
    """(step, outcome): done, or the name of the error."""
    out = []
    for name, step in steps:
        try:
            step()
            out.append((name, "done"))
        except errors.EngineError as e:
            out.append((name, type(e).__name__))
    return spark.createDataFrame(out, "step string, outcome string")


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _seed(spark, sf_dir, "nation", NATION)
    names = ["INSERT INTO nation VALUES (3, 'again', 1)", "INSERT INTO nation VALUES (200, 'a', 1), (200, 'b', 1)", "UPDATE nation SET n_nationkey = 4 WHERE n_nationkey = 5", "INSERT INTO nation VALUES (201, NULL, 1)", "INSERT INTO nation VALUES (202, 'new', NULL)", "CREATE UNIQUE INDEX one ON nation (n_regionkey)"]
    return _outcomes(spark, [(n, lambda n=n: engine.sql(n)) for n in names]).unionByName(engine.sql("SELECT n_name AS step, 'row' AS outcome FROM nation"))


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two transactions of one snapshot: other rows go together, the same row doesn't, nor does a key taken meanwhile."""
    engine = _seed(spark, sf_dir, "nation", NATION)
    a, b, c, d = (Transaction(engine.tables) for _ in range(4))
    for tx in (a, b, c, d):
        tx.manifest("nation")
    a.update("nation", {"n_name": "'a'"}, "n_nationkey = 1")
    b.update("nation", {"n_name": "'b'"}, "n_nationkey = 2")
    c.update("nation", {"n_name": "'c'"}, "n_nationkey = 1")
    d.insert("nation", spark.sql("SELECT 300, 'd', 1"))
    steps = [("a", a.commit), ("b", b.commit), ("c", c.commit), ("d", d.commit)]
    return _outcomes(spark, steps).unionByName(engine.sql("SELECT n_name AS step, 'row' AS outcome FROM nation"))


def _atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _seed(spark, sf_dir, "nation", NATION)
    engine.sql("CREATE TABLE log (id INTEGER)")

    def both(key: int) -> None:
        with engine.transaction() as tx:
            engine.sql(f"INSERT INTO log VALUES ({key}); INSERT INTO nation VALUES ({key}, 'n', 0)", tx=tx)

    out = _outcomes(spark, [("taken key", lambda: both(1)), ("free key", lambda: both(500))])
    return out.unionByName(engine.sql("SELECT cast(id AS STRING) AS step, 'log' AS outcome FROM log UNION ALL SELECT cast(count(*) AS STRING), 'nations' FROM nation"))


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _seed(spark, sf_dir, "nation", NATION + " ENGINE = memory")
    engine.sql("CREATE TABLE IF NOT EXISTS nation (x INTEGER); CREATE TABLE gone (x INTEGER UNIQUE, PRIMARY KEY (x)); CREATE TABLE kept (x INTEGER, y TEXT DEFAULT 'd')")
    names = ["CREATE TABLE kept (x INTEGER)", "DROP TABLE gone", "DROP TABLE gone", "DROP TABLE IF EXISTS gone", "CREATE INDEX i ON kept (x)", "CREATE INDEX i ON kept (x)", "DROP INDEX i ON kept", "DROP INDEX i ON kept", "ALTER TABLE nation ENGINE = disk", "ALTER TABLE nation ENGINE = tape", "CREATE TABLE bad (x MONEY)"]
    out = _outcomes(spark, [(f"{i} {n}", lambda n=n: engine.sql(n)) for i, n in enumerate(names)])
    out = out.unionByName(engine.sql("SHOW TABLES").selectExpr("table_name AS step", "'table' AS outcome"))
    indexes = [(name, "index") for name in sorted(engine.tables.manifest("nation").indexes)]
    return out.unionByName(spark.createDataFrame(indexes, "step string, outcome string")).unionByName(engine.sql("SELECT n_name AS step, 'row' AS outcome FROM nation"))


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _seed(spark, sf_dir, "nation", NATION)
    for i in range(3):
        engine.sql(f"INSERT INTO nation VALUES ({1000 + i}, 'late', 0); DELETE FROM nation WHERE n_nationkey = {i}")
    engine.compact("nation")
    engine.tables.vacuum("nation")
    return Engine(spark, str(engine.root)).sql("SELECT * FROM nation")  # opened again


def _grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _seed(spark, sf_dir, "customer", CUSTOMER)
    engine.sql("CREATE USER u PASSWORD 'p'; GRANT SELECT (c_custkey, c_name), UPDATE (c_name) ON customer TO u")
    names = ["SELECT c_custkey, c_name FROM customer", "SELECT * FROM customer", "SELECT c_custkey FROM customer WHERE c_acctbal > 0", "UPDATE customer SET c_name = 'n' WHERE c_custkey = 1", "UPDATE customer SET c_name = c_mktsegment", "DELETE FROM customer", "INSERT INTO customer (c_custkey) VALUES (-1)", "GRANT ALL ON customer TO u", "DROP TABLE customer"]
    out = _outcomes(spark, [(n, lambda n=n: engine.sql(n, user="u")) for n in names])
    return out.unionByName(engine.sql("SELECT c_name AS step, 'row' AS outcome FROM customer"))


def _single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """findUnique, create, update and delete by JSON; the table and what findUnique gave."""
    engine = _seed(spark, sf_dir, "nation", NATION)
    engine.structured({"op": "create", "into": "nation", "data": {"n_nationkey": 70, "n_name": "made"}})
    engine.structured({"op": "update", "in": "nation", "where": {"n_regionkey": {"gt": 3}}, "data": {"n_name": "it's"}})
    engine.structured({"op": "delete", "in": "nation", "where": {"n_nationkey": {"in": [1, 2]}}})
    found = engine.structured({"op": "findUnique", "from": "nation", "where": {"n_nationkey": 70}})
    return engine.sql("SELECT * FROM nation").unionByName(spark.createDataFrame([(found["n_nationkey"], "found " + found["n_name"], found["n_regionkey"])], "n_nationkey int, n_name string, n_regionkey int"))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _seed(spark, sf_dir, "nation", NATION)
    engine.execute(engine.prepare("UPDATE nation SET n_name = $1 WHERE n_regionkey = $2"), ["$2; it's", 2])
    engine.execute(engine.prepare("DELETE FROM nation WHERE n_nationkey = $1"), [0])
    engine.execute(engine.prepare("INSERT INTO nation (n_nationkey, n_name) VALUES ($1, $2)"), [90, "p"])
    return engine.execute(engine.prepare("SELECT * FROM nation WHERE n_nationkey > $1"), [3])


def _sql_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _seed(spark, sf_dir, "nation", NATION).connect()
    session.sql("BEGIN; INSERT INTO nation VALUES (400, 'kept', 1); UPDATE nation SET n_name = 'seen' WHERE n_nationkey = 400; COMMIT")
    session.sql("START TRANSACTION; DELETE FROM nation; ROLLBACK")
    return session.sql("SELECT * FROM nation")


_BY_ENGINE = {
    name: ("customer", "orders") if "orders" in catalogue.SQL[name] else ("customer",)
    for name in ("join_inner", "join_left", "join_where_on_outer", "filter_and_or_not", "filter_bool", "sort_multi", "superset_having", "superset_window", "superset_cte")
} | {"null_3vl": ("documents", "labels"), "filter_not_in": ("nation",), "join_three_way": ("region", "nation", "customer"), "join_residual": ("orders", "lineitem"), "topk": ("orders",), "limit_offset": ("orders",)}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "insert_select_back": _nation("INSERT INTO nation VALUES (100, 'new', 1), (101, 'newer', NULL)", "INSERT INTO nation (n_name, n_nationkey) VALUES ('short', 102)"),
    "insert_select": _nation("INSERT INTO nation SELECT n_nationkey + 1000, n_name, n_regionkey FROM nation WHERE n_regionkey = 2"),
    "update_where": _nation("UPDATE nation SET n_name = 'x', n_regionkey = NULL WHERE n_regionkey = 2"),
    "update_expression": _nation("UPDATE nation SET n_name = concat(n_name, '!') WHERE n_nationkey < 5"),
    "update_all": _nation("UPDATE nation SET n_regionkey = 7"),
    "delete_where": _nation("UPDATE nation SET n_regionkey = NULL WHERE n_nationkey = 4", "DELETE FROM nation WHERE n_regionkey > 1"),
    "delete_all": _nation("DELETE FROM nation"),
    "upsert": _upsert,
    "transaction_commit_rollback": _transaction,
    "index_point": _seek,
    "structured_find_many": _find(select={"c_custkey": True, "c_name": True}),
    "structured_where_ops": _find(where={"c_acctbal": {"gte": 100, "lt": 5000}, "c_mktsegment": ["BUILDING", "MACHINERY"], "c_name": {"contains": "1"}, "c_nationkey": {"ne": 3}}),
    "structured_or_not": _find(where={"OR": [{"c_custkey": 5}, {"c_acctbal": {"gt": 9900}}, {"c_name": {"endsWith": "77"}}], "NOT": {"c_nationkey": {"in": [1, 2]}}}),
    "structured_select_order_page": _find(orderBy=[{"c_acctbal": "desc"}, {"c_custkey": "asc"}], take=10, skip=5, select={"c_custkey": True, "c_acctbal": True}),
    "structured_include": _include,
    "fn_uuidv7": _uuid,
    "dialect_names": _through_engine("SELECT * FROM nation JOIN region ON nation.n_regionkey = region.r_regionkey JOIN nation b ON b.n_nationkey = region.r_regionkey", "nation", "region"),
    "dialect_int_div": _through_engine("SELECT p_partkey, (p_size - 25) / 7 AS x, p_size / (p_size - p_size) AS z, p_retailprice / 4 AS f FROM part", "part"),
    "dialect_round": _through_engine("SELECT p_partkey, ROUND(p_retailprice / 7, 2) AS x, round(1.005, 2) AS y FROM part", "part"),
    "dialect_nulls_largest": _through_engine("SELECT n_nationkey FROM nation ORDER BY n_regionkey DESC, n_nationkey OFFSET 2 ROWS FETCH FIRST 5 ROWS ONLY", "nation", first="UPDATE nation SET n_regionkey = NULL WHERE n_nationkey < 4"),
    "dialect_row_functions": _through_engine("SELECT c_custkey, max(c_custkey, c_nationkey) AS a, min(c_custkey, c_nationkey) AS b, sum(c_custkey, c_nationkey) AS s, count(c_custkey, nullif(c_nationkey, 3)) AS n FROM customer WHERE sum(c_custkey, c_nationkey) > 20", "customer"),
    "keys_unique": _keys,
    "snapshot_conflicts": _snapshots,
    "commit_atomic": _atomic,
    "definitions": _definitions,
    "compaction_reopen": _compacted,
    "grants": _grants,
    "structured_single": _single,
    "prepared_statements": _prepared,
    "sql_transactions": _sql_transactions,
    **{f"engine_{name}": _through_engine(catalogue.SQL[name], *tables) for name, tables in _BY_ENGINE.items()},
}

ORACLES: dict[str, str] = {
    "insert_select_back": "SELECT * FROM nation UNION ALL SELECT * FROM (VALUES (100, 'new', 1), (101, 'newer', NULL), (102, 'short', NULL)) t",
    "insert_select": "SELECT * FROM nation UNION ALL SELECT n_nationkey + 1000, n_name, n_regionkey FROM nation WHERE n_regionkey = 2",
    "update_where": "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'x' ELSE n_name END AS n_name, nullif(n_regionkey, 2) AS n_regionkey FROM nation",
    "update_expression": "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN n_name || '!' ELSE n_name END AS n_name, n_regionkey FROM nation",
    "update_all": "SELECT n_nationkey, n_name, CAST(7 AS INTEGER) AS n_regionkey FROM nation",
    "delete_where": "SELECT n_nationkey, n_name, CASE WHEN n_nationkey = 4 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey = 4 OR n_regionkey <= 1",
    "delete_all": "SELECT * FROM nation WHERE FALSE",
    "upsert": "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'changed' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'made', 1",
    "transaction_commit_rollback": "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'in one' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 0",
    "index_point": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7",
    "structured_find_many": "SELECT c_custkey, c_name FROM customer",
    "structured_where_ops": "SELECT * FROM customer WHERE c_acctbal >= 100 AND c_acctbal < 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name LIKE '%1%' AND c_nationkey <> 3",
    "structured_or_not": "SELECT * FROM customer WHERE (c_custkey = 5 OR c_acctbal > 9900 OR c_name LIKE '%77') AND c_nationkey NOT IN (1, 2)",
    "structured_select_order_page": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 5",
    "structured_include": """
        SELECT c_custkey, coalesce((SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FROM
            (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000 ORDER BY o_orderkey LIMIT 2) t), '') AS orders
        FROM customer""",
    "dialect_names": """
        SELECT a.n_nationkey AS "nation.n_nationkey", a.n_name AS "nation.n_name", a.n_regionkey AS "nation.n_regionkey", r.r_regionkey, r.r_name,
               b.n_nationkey AS "b.n_nationkey", b.n_name AS "b.n_name", b.n_regionkey AS "b.n_regionkey"
        FROM nation a JOIN region r ON a.n_regionkey = r.r_regionkey JOIN nation b ON b.n_nationkey = r.r_regionkey""",
    "dialect_int_div": "SELECT p_partkey, CAST((p_size - 25) // 7 AS BIGINT) AS x, CAST(NULL AS BIGINT) AS z, p_retailprice / 4 AS f FROM part",
    "dialect_round": "SELECT p_partkey, round(p_retailprice / 7 * 100) / 100 AS x, CAST(1.0 AS DOUBLE) AS y FROM part",
    "dialect_nulls_largest": "SELECT n_nationkey FROM (SELECT n_nationkey, CASE WHEN n_nationkey >= 4 THEN n_regionkey END AS r FROM nation) ORDER BY r DESC NULLS FIRST, n_nationkey LIMIT 5 OFFSET 2",
    "dialect_row_functions": "SELECT c_custkey, greatest(c_custkey, c_nationkey) AS a, least(c_custkey, c_nationkey) AS b, c_custkey + c_nationkey AS s, CAST(1 + CAST(c_nationkey <> 3 AS INTEGER) AS INTEGER) AS n FROM customer WHERE c_custkey + c_nationkey > 20",
    "keys_unique": """
        SELECT * FROM (VALUES ('INSERT INTO nation VALUES (3, ''again'', 1)', 'DuplicateKey'), ('INSERT INTO nation VALUES (200, ''a'', 1), (200, ''b'', 1)', 'DuplicateKey'),
            ('UPDATE nation SET n_nationkey = 4 WHERE n_nationkey = 5', 'DuplicateKey'), ('INSERT INTO nation VALUES (201, NULL, 1)', 'NullViolation'),
            ('INSERT INTO nation VALUES (202, ''new'', NULL)', 'done'), ('CREATE UNIQUE INDEX one ON nation (n_regionkey)', 'DuplicateKey'), ('new', 'row')) t(step, outcome)
        UNION ALL SELECT n_name, 'row' FROM nation""",
    "snapshot_conflicts": """
        SELECT * FROM (VALUES ('a', 'done'), ('b', 'done'), ('c', 'Conflict'), ('d', 'done'), ('d', 'row')) t(step, outcome)
        UNION ALL SELECT CASE n_nationkey WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE n_name END, 'row' FROM nation""",
    "commit_atomic": """
        SELECT * FROM (VALUES ('taken key', 'DuplicateKey'), ('free key', 'done'), ('500', 'log')) t(step, outcome)
        UNION ALL SELECT CAST(count(*) + 1 AS VARCHAR), 'nations' FROM nation""",
    "definitions": """
        SELECT * FROM (VALUES ('0 CREATE TABLE kept (x INTEGER)', 'TableExists'), ('1 DROP TABLE gone', 'done'), ('2 DROP TABLE gone', 'TableNotFound'), ('3 DROP TABLE IF EXISTS gone', 'done'),
            ('4 CREATE INDEX i ON kept (x)', 'done'), ('5 CREATE INDEX i ON kept (x)', 'IndexError_'), ('6 DROP INDEX i ON kept', 'done'), ('7 DROP INDEX i ON kept', 'IndexError_'),
            ('8 ALTER TABLE nation ENGINE = disk', 'done'), ('9 ALTER TABLE nation ENGINE = tape', 'Unsupported'), ('10 CREATE TABLE bad (x MONEY)', 'ParseError'),
            ('kept', 'table'), ('nation', 'table'), ('pk_nation', 'index')) t(step, outcome)
        UNION ALL SELECT n_name, 'row' FROM nation""",
    "compaction_reopen": "SELECT * FROM nation WHERE n_nationkey > 2 UNION ALL SELECT * FROM (VALUES (1000, 'late', 0), (1001, 'late', 0), (1002, 'late', 0)) t",
    "grants": """
        SELECT * FROM (VALUES ('SELECT c_custkey, c_name FROM customer', 'done'), ('SELECT * FROM customer', 'PermissionDenied'), ('SELECT c_custkey FROM customer WHERE c_acctbal > 0', 'PermissionDenied'),
            ('UPDATE customer SET c_name = ''n'' WHERE c_custkey = 1', 'done'), ('UPDATE customer SET c_name = c_mktsegment', 'PermissionDenied'), ('DELETE FROM customer', 'PermissionDenied'),
            ('INSERT INTO customer (c_custkey) VALUES (-1)', 'PermissionDenied'), ('GRANT ALL ON customer TO u', 'PermissionDenied'), ('DROP TABLE customer', 'PermissionDenied')) t(step, outcome)
        UNION ALL SELECT CASE c_custkey WHEN 1 THEN 'n' ELSE c_name END, 'row' FROM customer""",
    "structured_single": """
        SELECT n_nationkey, CASE WHEN n_regionkey > 3 THEN 'it''s' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (1, 2)
        UNION ALL SELECT * FROM (VALUES (70, 'made', NULL), (70, 'found made', NULL)) t""",
    "sql_transactions": "SELECT * FROM nation UNION ALL SELECT 400, 'seen', 1",
    "prepared_statements": "SELECT n_nationkey, CASE n_regionkey WHEN 2 THEN '$2; it''s' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey > 3 UNION ALL SELECT 90, 'p', NULL",
    **{f"engine_{name}": catalogue.SQL[name].replace("`", '"') for name in _BY_ENGINE},
}
