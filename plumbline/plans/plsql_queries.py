"""Queries of the code analytics on sources that Spark derives from the given tables; the SQL derives the expected facts from the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import extract, graph
from plumbline.sources.lines import assemble


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A procedure for each order: a call and a statement for each of its distinct line items."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    k = F.col("l_linenumber") % 5
    sql = (
        F.when(k == 0, F.concat(F.lit("  SELECT 1 INTO v FROM t_"), F.col("l_suppkey"), F.lit(" WHERE a IN (1, 2);\n")))
        .when(k == 1, F.concat(F.lit("  INSERT INTO t_"), F.col("l_suppkey"), F.lit(" (a, b) VALUES (1, 'x;''y');\n")))
        .when(k == 2, F.concat(F.lit("  UPDATE app.t_"), F.col("l_suppkey"), F.lit(" SET a = 1 WHERE b = 2; -- from t_none\n")))
        .when(k == 3, F.concat(F.lit("  DELETE FROM t_"), F.col("l_suppkey"), F.lit(" WHERE a = 1;\n")))
        .otherwise(F.concat(F.lit("  MERGE INTO t_"), F.col("l_suppkey"), F.lit(" t USING dual ON (t.a = 1) WHEN MATCHED THEN UPDATE SET b = 2;\n")))
    )
    call = F.concat(F.lit("  pkg_s"), F.col("l_suppkey"), F.lit(".load_"), F.col("l_partkey"), F.lit("(1);\n  dbms_output.put_line('x');\n"))
    item = li.select("l_orderkey", (10 + 2 * F.hash("l_linenumber", "l_partkey", "l_suppkey").cast("long")).alias("at"), F.concat(call, sql).alias("text"))
    heads = li.select("l_orderkey").distinct()
    first = heads.select("l_orderkey", F.lit(-(1 << 40)).alias("at"), F.concat(F.lit("PROCEDURE o_"), F.col("l_orderkey"), F.lit(" IS\n  v NUMBER;\nBEGIN\n")).alias("text"))
    last = heads.select("l_orderkey", F.lit(1 << 40).alias("at"), F.lit("END;\n").alias("text"))
    rows = first.unionByName(item).unionByName(last)
    return rows.select(F.lit("APP").alias("owner"), F.concat(F.lit("O_"), F.col("l_orderkey")).alias("name"), F.lit("PROCEDURE").alias("type"), F.col("at").alias("line"), "text")


def parsed_orders(spark: SparkSession, sf_dir: str, *facts: str) -> DataFrame:
    return extract.parse(assemble(order_lines(spark, sf_dir)), facts)


def parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_orders(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.call_edges(parsed_orders(spark, sf_dir, "call_edges")).select("caller_object", "callee_object", "callee_subprogram")


def table_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.table_accesses(parsed_orders(spark, sf_dir, "table_accesses")).select("object_name", "table_name", "operation")


def statement_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.substatements(parsed_orders(spark, sf_dir, "substatements")).groupBy("object_name", "statement_type").agg(F.count("*").alias("n")).where("statement_type like 'SQL%'")


def subprogram_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package body for each customer with a procedure for each of its orders."""
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").distinct()
    text = F.concat(F.lit("  PROCEDURE p_"), F.col("o_orderkey"), F.lit(" IS\n  BEGIN\n    IF a > 1 THEN b := c(1); ELSE NULL; END IF;\n  END;\n"))
    lines = o.select("o_custkey", F.col("o_orderkey").alias("at"), text.alias("text"))
    heads = o.select("o_custkey").distinct()
    lines = lines.unionByName(heads.select("o_custkey", F.lit(-1).cast("long").alias("at"), F.concat(F.lit("PACKAGE BODY c_"), F.col("o_custkey"), F.lit(" AS\n")).alias("text"))).unionByName(heads.select("o_custkey", F.lit(1 << 40).alias("at"), F.lit("END;\n").alias("text")))
    named = lines.select(F.lit("APP").alias("owner"), F.concat(F.lit("C_"), F.col("o_custkey")).alias("name"), F.lit("PACKAGE BODY").alias("type"), F.col("at").alias("line"), "text")
    found = extract.subprograms(extract.parse(assemble(named), ["subprograms"]))
    return found.select("object_name", "subprogram_name", "subprogram_type", "start_line", "end_line")


def _orders_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges order, customer, nation, region; information of all nodes but some nations; all orders as roots."""
    o, c, n, r = (_t(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region"))
    s = lambda p, x: F.concat(F.lit(p), F.col(x))
    none = F.lit(None).cast("string")
    edge = lambda df, a, b: df.select(F.lit("APP").alias("caller_schema"), a.alias("caller_object"), none.alias("caller_subprogram"), none.alias("callee_schema"), b.alias("callee_object"), none.alias("callee_subprogram"))
    edges = edge(o, s("O_", "o_orderkey"), s("C_", "o_custkey")).unionByName(edge(c, s("C_", "c_custkey"), s("N_", "c_nationkey"))).unionByName(edge(n, s("N_", "n_nationkey"), s("R_", "n_regionkey")))
    names = o.select(s("O_", "o_orderkey").alias("x")).unionByName(c.select(s("C_", "c_custkey").alias("x"))).unionByName(n.select(s("N_", "n_nationkey").alias("x"))).unionByName(r.select(s("R_", "r_regionkey").alias("x"))).distinct()
    status = F.when(F.col("x") == "N_3", "wrapped").otherwise("ok")
    info = names.where("x <> 'R_4'").select(F.lit("APP").alias("schema_name"), F.col("x").alias("object_name"), F.lit("PROCEDURE").alias("object_type"), status.alias("status"))
    roots = o.select(F.lit("APP").alias("schema_name"), s("O_", "o_orderkey").alias("object_name"), none.alias("subprogram")).distinct()
    return roots, edges, info


def explain_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependency_tree(*_orders_graph(spark, sf_dir)).select("root", "object_name", "depth", "status")


def explain_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependency_tree(*_orders_graph(spark, sf_dir), max_depth=1).select("root", "object_name", "depth", "status")


def explain_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part calls another one of its block of 13 keys; every path ends in a cycle, or where a key is missing."""
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("i")).distinct()
    s = lambda x: F.concat(F.lit("P_"), x)
    none, block = F.lit(None).cast("string"), F.expr("i div 13 * 13")
    edges = p.select(F.lit("APP").alias("caller_schema"), s(F.col("i")).alias("caller_object"), none.alias("caller_subprogram"), none.alias("callee_schema"), s(block + (F.col("i") % 13 * 7 + 3) % 13).alias("callee_object"), none.alias("callee_subprogram"))
    info = p.select(F.lit("APP").alias("schema_name"), s(F.col("i")).alias("object_name"), F.lit("PROCEDURE").alias("object_type"), F.lit("ok").alias("status"))
    roots = info.select("schema_name", "object_name", none.alias("subprogram"))
    return graph.dependency_tree(roots, edges, info).select("root", "object_name", "depth", "status")


QUERIES = {
    "parse_status": parse_status, "call_edges": call_edges, "table_access": table_access, "statement_types": statement_types, "subprograms": subprogram_table,
    "explain_tree": explain_tree, "explain_depth": explain_depth, "explain_cycle": explain_cycle,
}

_OP = "CASE l_linenumber % 5 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'INSERT' WHEN 2 THEN 'UPDATE' WHEN 3 THEN 'DELETE' ELSE 'MERGE' END"
_TREE = """
SELECT 'APP.O_' || o_orderkey || '.' AS root, 'O_' || o_orderkey AS object_name, 0 AS depth, 'ok' AS status FROM (SELECT DISTINCT o_orderkey FROM orders)
UNION ALL SELECT 'APP.O_' || o_orderkey || '.', 'C_' || o_custkey, 1, 'ok' FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders)
"""

ORACLE = {
    "parse_status": "SELECT 'ok' AS status, count(DISTINCT l_orderkey) AS n FROM lineitem",
    "call_edges": "SELECT DISTINCT 'O_' || l_orderkey AS caller_object, 'PKG_S' || l_suppkey AS callee_object, 'LOAD_' || l_partkey AS callee_subprogram FROM lineitem",
    "table_access": f"SELECT DISTINCT 'O_' || l_orderkey AS object_name, 'T_' || l_suppkey AS table_name, {_OP} AS operation FROM lineitem",
    "statement_types": f"SELECT 'O_' || l_orderkey AS object_name, 'SQL_' || {_OP} AS statement_type, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) GROUP BY 1, 2",
    "subprograms": (
        "SELECT 'C_' || o_custkey AS object_name, 'P_' || o_orderkey AS subprogram_name, 'PROCEDURE' AS subprogram_type, CAST(4 * rn - 2 AS INTEGER) AS start_line, CAST(4 * rn + 1 AS INTEGER) AS end_line "
        "FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders))"
    ),
    "explain_depth": _TREE,
    "explain_tree": _TREE
    + """
UNION ALL SELECT 'APP.O_' || o_orderkey || '.', 'N_' || c_nationkey, 2, CASE WHEN c_nationkey = 3 THEN 'wrapped' ELSE 'ok' END FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders) JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'APP.O_' || o_orderkey || '.', 'R_' || n_regionkey, 3, CASE WHEN n_regionkey = 4 THEN 'missing' ELSE 'ok' END FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey <> 3
""",
    "explain_cycle": """
WITH RECURSIVE p AS (SELECT DISTINCT CAST(p_partkey AS BIGINT) AS i FROM part), w AS (
  SELECT i AS root, i, 0 AS depth, CAST([] AS BIGINT[]) AS path, true AS there FROM p
  UNION ALL SELECT w.root, n.i, w.depth + 1, list_append(w.path, w.i), q.i IS NOT NULL FROM w, LATERAL (SELECT w.i // 13 * 13 + (w.i % 13 * 7 + 3) % 13 AS i) n LEFT JOIN p q ON q.i = n.i WHERE w.there AND NOT list_contains(w.path, w.i)
) SELECT 'APP.P_' || root || '.' AS root, 'P_' || i AS object_name, depth, CASE WHEN list_contains(path, i) THEN 'cycle' WHEN NOT there THEN 'missing' ELSE 'ok' END AS status FROM w
""",
}
