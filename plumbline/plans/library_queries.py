"""Queries that run the library's operators on objects, statements and graphs that Spark derives from the given tables; the SQL derives the expected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import chunks, extract, graph, recovery, report, store, summarize
from plumbline.sources.lines import assemble


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(name: Column, kind: str | Column = "PROCEDURE") -> list[Column]:
    return [F.lit("APP").alias("schema_name"), name.cast("string").alias("object_name"), (F.lit(kind) if isinstance(kind, str) else kind).alias("object_type")]


def _units(rows: DataFrame, name: Column, text: Column, kind: str = "PROCEDURE") -> DataFrame:
    """Parsed objects of one line each."""
    return extract.parse(assemble(rows.select(F.lit("APP").alias("owner"), name.alias("name"), F.lit(kind).alias("type"), F.lit(1).alias("line"), text.alias("text"))))


# sources and the store
def assemble_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as objects, their turns as lines."""
    lines = _t(spark, sf_dir, "conversations").select(F.lit("APP").alias("owner"), F.col("conv_id").alias("name"), F.lit("PROCEDURE").alias("type"), F.col("turn").alias("line"), "text")
    return assemble(lines).select(F.col("object_name").alias("conv_id"), "source_text")


def source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "documents").select(F.lit("APP").alias("owner"), F.col("doc_id").alias("name"), F.lit("PROCEDURE").alias("type"), F.lit(1).alias("line"), "text")
    return assemble(lines).select(F.col("object_name").alias("doc_id"), "source_hash")


def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    old = docs.where("n_chars > 500").select("doc_id", F.md5("text").alias("source_hash"))
    new = docs.select("doc_id", F.md5(F.when(F.col("n_chars") > 5000, F.upper("text")).otherwise(F.col("text"))).alias("source_hash"))
    return store.outcomes(old, new, ["doc_id"]).groupBy("outcome").agg(F.count("*").alias("n"))


def pending_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = _t(spark, sf_dir, "orders").select(*_key(F.col("o_orderkey")), F.col("o_orderstatus").alias("source_hash"), "o_orderpriority", "o_orderkey")
    parsed = objects.withColumn("source_hash", F.when(F.col("o_orderpriority") == "2-HIGH", "old").otherwise(F.col("source_hash"))).where("o_orderpriority <> '1-URGENT'")
    return store.pending(objects, parsed).select("o_orderkey")


def object_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's objects: a body, a specification or a procedure for each status of its orders; procedures are not indexed."""
    kind = F.when(F.col("o_orderstatus") == "F", "PACKAGE BODY").when(F.col("o_orderstatus") == "O", "PACKAGE").otherwise("PROCEDURE")
    objects = _t(spark, sf_dir, "orders").select(*_key(F.col("o_custkey"), kind)).distinct()
    parsed = objects.where("object_type <> 'PROCEDURE'").select("*", F.when(F.col("object_type") == "PACKAGE", "error").otherwise("ok").alias("status"), F.lit(None).cast("string").alias("error_message"))
    return store.object_info(objects, parsed).select("object_name", "object_type", "status")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    old = c.select(F.col("c_custkey").cast("long").alias("k"), F.col("c_name").alias("v"), F.md5("c_name").alias("source_hash"))
    changed = c.where("c_nationkey in (3, 4)").select(F.col("c_custkey").cast("long").alias("k"), F.when(F.col("c_nationkey") == 3, F.upper(F.concat("c_name", F.lit("x")))).otherwise(F.col("c_name")).alias("v"))
    new = changed.unionByName(s.select((-1 - F.col("s_suppkey")).cast("long").alias("k"), F.col("s_name").alias("v"))).withColumn("source_hash", F.md5("v"))
    return store.upsert(old, new, ["k"]).select("k", "v")


def replace_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as facts of their orders: those of finished orders are replaced by one fact each, if it is an expensive one."""
    o = _t(spark, sf_dir, "orders")
    old = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("fact"))
    touched = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    new = o.where("o_orderstatus = 'F' and o_totalprice > 100000").select(F.col("o_orderkey").alias("k"), F.lit(-1).cast(old.schema["fact"].dataType).alias("fact"))
    return store.replace(old, new, touched, ["k"])


def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem")
    return extract.first_of(rows, ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey")


# the parser
def builtin_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's procedure calls the standard library and one procedure of its own."""
    p = _t(spark, sf_dir, "part")
    body = F.concat(F.lit("PROCEDURE p IS\n  v NUMBER := nvl(1, round(2));\nBEGIN\n  dbms_output.put_line(to_char(v));\n  sys.audit(v);\n  SELECT count(*), stddev(a), lead(b) OVER (ORDER BY c) INTO v FROM t;\n  own_"), F.col("p_partkey"), F.lit("(greatest(1, 2));\n  raise_application_error(-20001, 'x');\nEND;\n"))
    return extract.call_edges(_units(p, F.concat(F.lit("P_"), F.col("p_partkey")), body)).select("caller_object", "callee_object", "callee_subprogram")


def call_edges_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's procedure calls one of its nation's schema by three names, and the same one by four."""
    c = _t(spark, sf_dir, "customer")
    body = F.concat(F.lit("PROCEDURE p IS\nBEGIN\n  n_"), F.col("c_nationkey"), F.lit(".pkg.load(1);\n  CALL x.n_"), F.col("c_nationkey"), F.lit(".pkg.load(2);\n  IF pkg.load(3) > 0 THEN NULL; END IF;\nEND;\n"))
    return extract.call_edges(_units(c, F.concat(F.lit("C_"), F.col("c_custkey")), body)).select("caller_object", "callee_schema", "callee_object", "callee_subprogram")


def wrapped_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as objects: finished ones are wrapped, open ones fine, others broken."""
    o = _t(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("PROCEDURE o_"), F.col("o_orderkey"), F.lit(" wrapped\na000000\nabcd\n"))).when(F.col("o_orderstatus") == "O", F.lit("PROCEDURE p IS BEGIN x := 'wrapped'; END;")).otherwise(F.lit("PROCEDURE p IS BEGIN f(1; END;"))
    parsed = _units(o, F.col("o_orderkey").cast("string"), text)
    return parsed.select("object_name", "status", F.size("call_edges").alias("edges"))


#: A procedure's statements by forms that name tables, and the tables and operations in each.
_FORMS = [
    ("INSERT ALL INTO a_# (x) VALUES (1) INTO b_# (x) VALUES (f(2)) SELECT * FROM c_#;", "A INSERT,B INSERT,C SELECT"),
    ("INSERT FIRST WHEN x > 1 THEN INTO a_# WHEN x IN (SELECT k FROM d_#) THEN INTO b_# ELSE INTO e_# SELECT x FROM c_#;", "A INSERT,B INSERT,C SELECT,D SELECT,E INSERT"),
    ("SELECT 1 INTO v FROM a_# LEFT JOIN b_# ON a_#.x = b_#.x, c_# y CROSS JOIN d_#;", "A SELECT,B SELECT,C SELECT,D SELECT"),
    ("SELECT extract(year FROM e), trim(both '0' FROM d) INTO v FROM a_#;", "A SELECT"),
    ("DELETE FROM ONLY (a_#) WHERE x = 1; SELECT 1 INTO v FROM b_# PIVOT (count(*) FOR x IN (1, 2));", "A DELETE,B SELECT"),
]


def access_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's procedure has a statement of one form, by its number; the tables bear the number too."""
    d = _t(spark, sf_dir, "documents").select("doc_id")
    text = F.lit(_FORMS[-1][0])
    for n, (form, _) in reversed(list(enumerate(_FORMS[:-1]))):
        text = F.when(F.col("doc_id") % len(_FORMS) == n, form).otherwise(text)
    body = F.concat(F.lit("PROCEDURE p IS\nBEGIN\n  "), F.replace(text, F.lit("#"), F.col("doc_id").cast("string")), F.lit("\nEND;\n"))
    found = extract.table_accesses(_units(d, F.concat(F.lit("P_"), F.col("doc_id")), body))
    return found.select("object_name", "table_name", "operation")


_TREE_TEXT = "PROCEDURE c IS\nBEGIN\n  IF a > 1 THEN\n    x := 1;\n    y := 2;\n  ELSE\n    INSERT INTO t (a) VALUES (1);\n  END IF;\nEND;\n"


def statement_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A procedure for each customer, with its statements, their parents and lines."""
    text = F.regexp_replace(F.lit(_TREE_TEXT), "INTO t", F.concat(F.lit("INTO t_"), F.col("c_custkey")))
    found = extract.substatements(_units(_t(spark, sf_dir, "customer"), F.col("c_custkey").cast("string"), text))
    return found.select("object_name", "seq", "parent_seq", "position", "statement_type", "start_line", "end_line", F.length("source_text").alias("chars"))


def merge_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A procedure for each user, with an insert for each purchase and an assignment for each other event; neighbouring assignments become one statement."""
    e = _t(spark, sf_dir, "events").withColumn("line", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    one = F.when(F.col("event_type") == "purchase", F.lit("  INSERT INTO t (a) VALUES (1);\n")).otherwise(F.lit("  x := 1;\n"))
    users = e.select("user_id").distinct()
    lines = e.select("user_id", "line", one.alias("text")).unionByName(users.select("user_id", F.lit(0).alias("line"), F.lit("PROCEDURE p IS\nBEGIN\n").alias("text"))).unionByName(users.select("user_id", F.lit((1 << 31) - 1).alias("line"), F.lit("END;\n").alias("text")))
    objects = assemble(lines.select(F.lit("APP").alias("owner"), F.col("user_id").cast("string").alias("name"), F.lit("PROCEDURE").alias("type"), "line", "text"))
    return extract.substatements(extract.parse(objects)).where("parent_seq is not null").groupBy("object_name", "statement_type").agg(F.count("*").alias("n"))


# statement trees and chunks: a conversation's turns as statements, each third one a root and the next two below it
def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.when(F.col("turn") % 3 > 0, F.col("turn") - 1).cast("int")
    kind = F.when(F.col("turn") == 3, "EXCEPTION_HANDLER").otherwise("OTHER")
    return _t(spark, sf_dir, "conversations").select(*_key(F.col("conv_id")), F.lit("").alias("subprogram"), F.col("turn").cast("int").alias("seq"), parent.alias("parent_seq"), F.col("turn").cast("int").alias("position"), kind.alias("statement_type"), F.col("text").alias("source_text"), F.sha2("text", 256).alias("source_hash"))


def subtree_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.subtree_sums(chunks.tree(_statements(spark, sf_dir))).select("object_name", "root", "length", F.size("hashes").alias("statements"))


def chunk_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk holds a conversation up to turn 2, and the handler at turn 3 begins another one."""
    return chunks.chunks(_statements(spark, sf_dir), 1 << 20).select("object_name", "chunk_index", "chunk_hash")


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunks(_statements(spark, sf_dir), 100).select("object_name", "chunk_index", F.array_min("root_seqs").alias("first_root"), F.size("root_seqs").alias("roots"), "length")


def cache_prefix_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks; those whose text's length is a multiple of three have changed since they were stored."""
    made = _t(spark, sf_dir, "conversations").select(*_key(F.col("conv_id")), F.lit("").alias("subprogram"), F.col("turn").cast("int").alias("chunk_index"), F.sha2("text", 256).alias("chunk_hash"), F.length("text").alias("size"))
    stored = made.withColumn("chunk_hash", F.when(F.col("size") % 3 == 0, "old").otherwise(F.col("chunk_hash")))
    return chunks.valid_chunks(made.drop("size"), stored.drop("size")).select("object_name", "chunk_index", "valid")


# graphs
def _diamonds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For each part a procedure that calls two others, which call one; with tables that these touch."""
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k")).distinct()
    none = F.lit(None).cast("string")
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ("TL", "TR", "LE", "RE")])).alias("e")
    e = p.select("k", pairs).select("k", "e.*")
    edges = e.select(F.lit("APP").alias("caller_schema"), F.concat("a", F.lit("_"), "k").alias("caller_object"), none.alias("caller_subprogram"), none.alias("callee_schema"), F.concat("b", F.lit("_"), "k").alias("callee_object"), none.alias("callee_subprogram"))
    info = p.select(F.lit("APP").alias("schema_name"), F.explode(F.array(*[F.concat(F.lit(f"{x}_"), "k") for x in "TLRE"])).alias("object_name"), F.lit("PROCEDURE").alias("object_type"), F.lit("ok").alias("status"))
    roots = p.select(F.lit("APP").alias("schema_name"), F.concat(F.lit("T_"), "k").alias("object_name"), none.alias("subprogram"))
    return roots, edges, info


def explain_diamond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node that two paths reach is visited on both."""
    return graph.dependency_tree(*_diamonds(spark, sf_dir)).select("root", "object_name", "depth", "status")


def diamond_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a summary visits: each node once."""
    return graph.reach(*_diamonds(spark, sf_dir)).select("root", "object_name", "depth", "status")


def tree_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots, edges, info = _diamonds(spark, sf_dir)
    accesses = info.where("object_name like 'L%'").select("schema_name", "object_name", F.lit(None).cast("string").alias("subprogram"), F.lit(None).cast("string").alias("table_schema"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("table_name"), F.lit("SELECT").alias("operation"))
    lines = graph.rendered(graph.with_accesses(graph.dependency_tree(roots, edges, info), accesses))
    return lines.select("root", F.row_number().over(W.partitionBy("root").orderBy("at")).alias("nth"), "line")


def bottom_up_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of all diamonds from the leaves up, by the offline completer, which counts the callees that a prompt lists."""
    roots, edges, info = _diamonds(spark, sf_dir)
    sources = info.select("schema_name", "object_name", "object_type", F.lit("x").alias("source_text"), F.lit("h").alias("source_hash"))
    accesses = info.limit(0).select("schema_name", "object_name", F.lit("").alias("subprogram"), F.lit("").alias("table_schema"), F.lit("").alias("table_name"), F.lit("").alias("operation"))
    return summarize.summarize(roots, edges, info, sources, accesses).select("object_name", "summary")


def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for each customer, with its orders as callees and its nation as a table."""
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("O_"), F.col("o_orderkey"), F.lit(": done")))).alias("calls"))
    c = _t(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    rows = c.select(F.lit("APP").alias("schema_name"), F.concat(F.lit("C_"), F.col("c_custkey")).alias("object_name"), F.lit("").alias("sub"), F.lit("PROCEDURE").alias("object_type"), F.concat(F.lit(" "), "c_name").alias("fragment"), F.array(F.concat(F.lit("N_"), F.col("c_nationkey"), F.lit(" (SELECT)"))).alias("tables"), F.coalesce("calls", F.array().cast("array<string>")).alias("calls"))
    return rows.select("object_name", summarize.prompt().alias("prompt"))


# look-ups, reports and recovery
def source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text by name of each customer's objects: the body's, where there is one."""
    kind = F.when(F.col("o_orderstatus") == "F", "PACKAGE BODY").when(F.col("o_orderstatus") == "O", "PACKAGE").otherwise("PROCEDURE")
    objects = _t(spark, sf_dir, "orders").groupBy(*_key(F.col("o_custkey"), kind)).agg(F.min("o_orderkey").cast("string").alias("source_text"))
    return store.source_text(objects).select("object_name", "object_type", "source_text")


def parse_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of what was parsed last, for a specification and a body of each part."""
    p = _t(spark, sf_dir, "part")
    parsed = [p.select(*_key(F.col("p_partkey"), kind), F.md5(F.concat("p_name", F.lit(kind))).alias("source_hash")) for kind in ("PACKAGE", "PACKAGE BODY")]
    return store.parse_hash(parsed[0].unionByName(parsed[1])).select("object_name", "source_hash")


def subprogram_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order's package the text of one procedure; finished orders ask for one that is not there and get all of it."""
    o = _t(spark, sf_dir, "orders")
    objects = o.select(*_key(F.col("o_orderkey"), "PACKAGE BODY"), F.concat(F.lit("all of "), "o_orderkey").alias("source_text"))
    own = o.where("o_orderstatus <> 'F'").select(*_key(F.col("o_orderkey"), "PACKAGE BODY"), F.lit("LOAD").alias("subprogram_name"), F.concat(F.lit("load of "), "o_orderkey").alias("source_text"))
    wanted = o.select(*_key(F.col("o_orderkey"), "PACKAGE BODY"), F.lit("load").alias("subprogram"))
    return recovery.subprogram_text(wanted, objects, own).select("object_name", "source_text")


def unmatched_begin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's text opens a block after its name; those of the first ten nations close it."""
    text = F.concat(F.lit("/* BEGIN */ "), "c_name", F.lit(" v := 'BEGIN';\nBEGIN -- END\n  BEGIN x; END;\n  IF a THEN b; END IF;\n"), F.when(F.col("c_nationkey") < 10, "END;").otherwise("y;"))
    return _t(spark, sf_dir, "customer").select("c_custkey", recovery.unmatched_begin(text).alias("at"))


def loose_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four statements of each order's text, with semicolons in strings and comments."""
    text = F.concat(F.lit("\n v := 'x;y'; -- c;d\n UPDATE o_"), "o_orderkey", F.lit("\n SET a = 1 /* ; */;\nwith q as (1) select 1;; Execute immediate '"), "o_orderpriority", F.lit(";'"))
    segments = _t(spark, sf_dir, "orders").select("o_orderkey", text.alias("source_text"))
    return recovery.loose_statements(segments, first_line=F.lit(10)).select("o_orderkey", "position", "statement_type", "start_line", "end_line", "source_text")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of a package for each customer, whose call and update bear its number."""
    text = F.concat(F.lit("PACKAGE BODY k IS\n  PROCEDURE p IS\n  BEGIN\n    IF v > 1 THEN\n      q_"), "c_custkey", F.lit("(1);\n    END IF;\n    UPDATE t_"), "c_custkey", F.lit(" SET a = 1;\n  END;\nEND;\n"))
    made = report.reports(_units(_t(spark, sf_dir, "customer"), F.concat(F.lit("C_"), "c_custkey"), text, "PACKAGE BODY"))
    return made.select("object_name", F.posexplode("lines").alias("n", "x")).select("object_name", (F.col("n") + 1).alias("nth"), "x.line")


def json_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's procedure as a JSON text, read back by its fields."""
    text = F.concat(F.lit("PROCEDURE p IS\nBEGIN\n  n_"), "s_nationkey", F.lit(".load(1);\nEND;\n"))
    made = report.json_records(_units(_t(spark, sf_dir, "supplier"), F.concat(F.lit("S_"), "s_suppkey"), text))
    field = lambda path: F.get_json_object("record", f"$.{path}")
    return made.select(field("object_name").alias("object_name"), field("status").alias("status"), field("call_edges[0].callee_object").alias("callee_object"), field("call_edges[0].callee_subprogram").alias("callee_subprogram"), field("substatements[1].statement_type").alias("statement_type"))


QUERIES = {
    f.__name__: f
    for f in (
        assemble_source, source_hash, change_counts, pending_parse, object_info, upsert_latest, replace_facts, first_per_key, builtin_filter, call_edges_schema, wrapped_flag, access_forms, statement_tree, merge_others,
        subtree_len, chunk_hash, chunk_pack, cache_prefix_invalid, explain_diamond, diamond_once, tree_render, bottom_up_height, prompt_build,
        source_text, parse_hash, subprogram_text, unmatched_begin, loose_statements, report_lines, json_record,
    )
}

_CREATED = "CASE WHEN upper(regexp_replace({0}, '^\\s+', '')) LIKE 'CREATE%' THEN {0} ELSE 'CREATE OR REPLACE ' || {0} END"
_NODES = "(SELECT CAST(p_partkey AS VARCHAR) AS k FROM part GROUP BY p_partkey)"

ORACLE = {
    "assemble_source": f"SELECT conv_id, {_CREATED.format('s')} AS source_text FROM (SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS s FROM conversations GROUP BY conv_id)",
    "source_hash": f"SELECT doc_id, sha256({_CREATED.format('s')}) AS source_hash FROM (SELECT doc_id, coalesce(text, '') AS s FROM documents)",
    "change_counts": (
        "WITH old AS (SELECT doc_id, md5(text) AS h FROM documents WHERE n_chars > 500), new AS (SELECT doc_id, md5(CASE WHEN n_chars > 5000 THEN upper(text) ELSE text END) AS h FROM documents) "
        "SELECT CASE WHEN old.h IS NULL THEN 'inserted' WHEN old.h = new.h THEN 'unchanged' ELSE 'updated' END AS outcome, count(*) AS n FROM new LEFT JOIN old ON new.doc_id = old.doc_id GROUP BY 1"
    ),
    "pending_parse": "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "object_info": (
        "SELECT CAST(o_custkey AS VARCHAR) AS object_name, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'PACKAGE BODY' WHEN bool_or(o_orderstatus = 'O') THEN 'PACKAGE' ELSE 'PROCEDURE' END AS object_type, "
        "CASE WHEN bool_or(o_orderstatus = 'F') THEN 'ok' WHEN bool_or(o_orderstatus = 'O') THEN 'error' ELSE 'unindexed' END AS status FROM orders GROUP BY o_custkey"
    ),
    "upsert_latest": "SELECT CAST(c_custkey AS BIGINT) AS k, CASE WHEN c_nationkey = 3 THEN upper(c_name || 'x') ELSE c_name END AS v FROM customer UNION ALL SELECT CAST(-1 - s_suppkey AS BIGINT), s_name FROM supplier",
    "replace_facts": (
        "SELECT l_orderkey AS k, l_partkey AS fact FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') "
        "UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000"
    ),
    "first_per_key": "SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) t WHERE rn = 1",
    "builtin_filter": "SELECT 'P_' || p_partkey AS caller_object, 'OWN_' || p_partkey AS callee_object, CAST(NULL AS VARCHAR) AS callee_subprogram FROM part",
    "call_edges_schema": (
        "SELECT 'C_' || c_custkey AS caller_object, 'N_' || c_nationkey AS callee_schema, 'PKG' AS callee_object, 'LOAD' AS callee_subprogram FROM customer "
        "UNION ALL SELECT 'C_' || c_custkey, NULL, 'PKG', 'LOAD' FROM customer"
    ),
    "wrapped_flag": "SELECT CAST(o_orderkey AS VARCHAR) AS object_name, CASE o_orderstatus WHEN 'F' THEN 'wrapped' WHEN 'O' THEN 'ok' ELSE 'error' END AS status, CAST(0 AS INTEGER) AS edges FROM orders",
    "access_forms": f"""
SELECT 'P_' || doc_id AS object_name, split_part(f, ' ', 1) || '_' || doc_id AS table_name, split_part(f, ' ', 2) AS operation
FROM (SELECT doc_id, unnest(string_split([{", ".join(repr(facts) for _, facts in _FORMS)}][doc_id % {len(_FORMS)} + 1], ',')) AS f FROM documents) x
""",
    "statement_tree": (
        "SELECT CAST(c_custkey AS VARCHAR) AS object_name, v.seq, v.parent_seq, v.position, v.statement_type, v.start_line, v.end_line, CAST(v.chars + CASE v.statement_type WHEN 'SQL_INSERT' THEN 1 + length(CAST(c_custkey AS VARCHAR)) ELSE 0 END AS INTEGER) AS chars FROM customer, "
        "(VALUES (0, NULL, 0, 'BEGIN_END', 2, 2, 5), (1, 0, 0, 'IF', 3, 3, 13), (2, 1, 0, 'OTHER', 4, 5, 13), (4, 1, 1, 'IF_ELSE', 6, 6, 4), (5, 4, 0, 'SQL_INSERT', 7, 7, 28)) v(seq, parent_seq, position, statement_type, start_line, end_line, chars)"
    ),
    "merge_others": (
        "SELECT CAST(user_id AS VARCHAR) AS object_name, CASE WHEN bought THEN 'SQL_INSERT' ELSE 'OTHER' END AS statement_type, count(*) AS n FROM "
        "(SELECT user_id, event_type = 'purchase' AS bought, lag(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) t WHERE bought OR before IS NULL OR before GROUP BY 1, 2"
    ),
    "subtree_len": "SELECT CAST(conv_id AS VARCHAR) AS object_name, CAST(turn - turn % 3 AS INTEGER) AS root, CAST(sum(length(text)) AS BIGINT) AS length, CAST(count(*) AS INTEGER) AS statements FROM conversations GROUP BY 1, 2",
    "chunk_hash": "SELECT CAST(conv_id AS VARCHAR) AS object_name, CAST(CASE WHEN turn < 3 THEN 0 ELSE 1 END AS INTEGER) AS chunk_index, sha256(string_agg(sha256(text), '|' ORDER BY turn)) AS chunk_hash FROM conversations GROUP BY 1, 2",
    "chunk_pack": """
WITH RECURSIVE r AS (SELECT conv_id, turn - turn % 3 AS root, sum(length(text)) AS n FROM conversations GROUP BY 1, 2), w AS (
  SELECT conv_id, root, 0 AS chunk, n FROM r WHERE root = 0
  UNION ALL SELECT r.conv_id, r.root, CASE WHEN r.root = 3 OR w.n + r.n > 400 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN r.root = 3 OR w.n + r.n > 400 THEN r.n ELSE w.n + r.n END FROM w JOIN r ON r.conv_id = w.conv_id AND r.root = w.root + 3
) SELECT CAST(conv_id AS VARCHAR) AS object_name, CAST(chunk AS INTEGER) AS chunk_index, CAST(min(root) AS INTEGER) AS first_root, CAST(count(*) AS INTEGER) AS roots, CAST(max(n) AS BIGINT) AS length FROM w GROUP BY 1, 2
""",
    "cache_prefix_invalid": "SELECT CAST(conv_id AS VARCHAR) AS object_name, CAST(turn AS INTEGER) AS chunk_index, max(CASE WHEN length(text) % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 0 AS valid FROM conversations",
    "explain_diamond": f"SELECT 'APP.T_' || k || '.' AS root, v.p || '_' || k AS object_name, v.depth, 'ok' AS status FROM {_NODES}, (VALUES ('T', 0), ('L', 1), ('R', 1), ('E', 2), ('E', 2)) v(p, depth)",
    "diamond_once": f"SELECT 'APP.T_' || k || '.' AS root, v.p || '_' || k AS object_name, v.depth, 'ok' AS status FROM {_NODES}, (VALUES ('T', 0), ('L', 1), ('R', 1), ('E', 2)) v(p, depth)",
    "bottom_up_height": f"SELECT v.p || '_' || k AS object_name, 'Object: APP.' || v.p || '_' || k || ' (PROCEDURE) calls ' || v.n AS summary FROM {_NODES}, (VALUES ('T', 2), ('L', 1), ('R', 1), ('E', 0)) v(p, n)",
    "prompt_build": (
        "SELECT 'C_' || c_custkey AS object_name, 'Object: APP.C_' || c_custkey || ' (PROCEDURE)' || chr(10) || chr(10) || 'Source code:' || chr(10) || '```plsql' || chr(10) || c_name || chr(10) || '```' || chr(10) || chr(10) "
        "|| 'Table accesses:' || chr(10) || '- N_' || c_nationkey || ' (SELECT)' || chr(10) || chr(10) || coalesce('Called objects:' || chr(10) || o.calls || chr(10) || chr(10), '') "
        "|| 'Write a short description (2-4 sentences) of what this object does.' AS prompt FROM customer LEFT JOIN (SELECT o_custkey, string_agg('- O_' || o_orderkey || ': done', chr(10) ORDER BY 'O_' || o_orderkey || ': done') AS calls FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) GROUP BY 1) o ON o_custkey = c_custkey"
    ),
    "tree_render": (
        f"SELECT 'APP.T_' || k || '.' AS root, v.nth, replace(v.line, '#', k || ' (PROCEDURE)') AS line FROM {_NODES}, (VALUES (1, 'T_#'), (2, '    ├── L_#'), (3, '    │   ├── TABLE A SELECT'), "
        "(4, '    │   ├── TABLE B SELECT'), (5, '    │   └── E_#'), (6, '    └── R_#'), (7, '        └── E_#')) v(nth, line)"
    ),
    "source_text": (
        "SELECT CAST(o_custkey AS VARCHAR) AS object_name, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'PACKAGE BODY' WHEN bool_or(o_orderstatus = 'O') THEN 'PACKAGE' ELSE 'PROCEDURE' END AS object_type, "
        "CAST(coalesce(min(o_orderkey) FILTER (o_orderstatus = 'F'), min(o_orderkey) FILTER (o_orderstatus = 'O'), min(o_orderkey)) AS VARCHAR) AS source_text FROM orders GROUP BY o_custkey"
    ),
    "parse_hash": "SELECT CAST(p_partkey AS VARCHAR) AS object_name, md5(p_name || 'PACKAGE BODY') AS source_hash FROM part",
    "subprogram_text": "SELECT CAST(o_orderkey AS VARCHAR) AS object_name, CASE o_orderstatus WHEN 'F' THEN 'all of ' ELSE 'load of ' END || o_orderkey AS source_text FROM orders",
    "unmatched_begin": "SELECT c_custkey, CAST(CASE WHEN c_nationkey >= 10 THEN length('/* BEGIN */ ') + length(c_name) + length(' v := ''BEGIN'';') + 2 END AS INTEGER) AS at FROM customer",
    "loose_statements": (
        "SELECT o_orderkey, v.position, v.statement_type, v.start_line, v.end_line, replace(replace(v.text, '#', CAST(o_orderkey AS VARCHAR)), '@', o_orderpriority) AS source_text FROM orders, "
        "(VALUES (0, 'OTHER', 11, 11, 'v := ''x;y'''), (1, 'SQL_UPDATE', 12, 13, 'UPDATE o_#' || chr(10) || ' SET a = 1'), (2, 'SQL_SELECT', 14, 14, 'with q as (1) select 1'), "
        "(3, 'SQL_EXECUTE_IMMEDIATE', 14, 14, 'Execute immediate ''@;''')) v(position, statement_type, start_line, end_line, text)"
    ),
    "report_lines": """
SELECT 'C_' || k AS object_name, v.nth, replace(replace(replace(v.line, '#', k), '<C>', rpad('Q_' || k, 32, ' ')), '<T>', rpad('T_' || k, 12, ' ')) AS line FROM (SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer), (VALUES
  (1, '=== Parse Result: APP.C_# (PACKAGE BODY) ==='), (2, 'Status: ok'),
  (3, '--- Call edges (1) ---'), (4, 'CALLER  CALLEE_SCHEMA  CALLEE_OBJECT  CALLEE_SUBPROGRAM'), (5, '------  -------------  -------------  -----------------'), (6, rpad('P', 23, ' ') || '<C>'),
  (7, '--- Table accesses (1) ---'), (8, 'SUBPROGRAM  TABLE_SCHEMA  TABLE_NAME  OPERATION'), (9, '----------  ------------  ----------  ---------'), (10, rpad('P', 26, ' ') || '<T>' || 'UPDATE   '),
  (11, '--- Subprograms (1) ---'), (12, 'NAME  TYPE       START_LINE  END_LINE'), (13, '----  ---------  ----------  --------'), (14, 'P     PROCEDURE  2           8       '),
  (15, '--- Substatements (4) ---'), (16, '  Subprogram: P'), (17, '  └── [0] BEGIN_END  L3-L3'), (18, '      ├── [1] IF  L4-L4'), (19, '      │   └── [2] OTHER  L5-L5'), (20, '      └── [3] SQL_UPDATE  L7-L7')) v(nth, line)
""",
    "json_record": "SELECT 'S_' || s_suppkey AS object_name, 'ok' AS status, 'N_' || s_nationkey AS callee_object, 'LOAD' AS callee_subprogram, 'OTHER' AS statement_type FROM supplier",
}
