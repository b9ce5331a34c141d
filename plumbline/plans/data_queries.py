"""Queries of multi-table inserts, multisets, JSON documents and samples, and of journals, walks and order statistics on documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import bags, formats
from plumbline.functions.json_table import Exists, Nested, Ordinal, Value, json_table
from plumbline.operators.densify import partitioned_outer_join
from plumbline.operators.hierarchy import connect_by, path_text, searched
from plumbline.operators.inserts import Target, insert_all
from plumbline.operators.journal import Journal
from plumbline.operators.order_stats import hypothetical_ranks, percentile_disc
from plumbline.operators.sample import sample, sample_blocks
from plumbline.operators.views import AggregateView
from plumbline.plans.change_queries import streamed
from plumbline.sources.shared import new_dir
from plumbline.streaming import ingest


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labelled(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sorted(tables.items()):
        one = df.select(F.lit(name).alias("target"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
        out = one if out is None else out.unionByName(one)
    return out


def insert_all_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document into a log, long ones and those in English also into tables of their own."""
    d = _t(spark, sf_dir, "documents")
    key, size = (F.col("doc_id"), "bigint"), (F.col("n_chars"), "int")
    branches = [(None, [Target("log", {"k": key})]), (F.col("n_chars") > 2000, [Target("long", {"k": key, "size": size})]), (F.col("lang") == "en", [Target("english", {"k": key, "source": (F.col("source"), "string")})])]
    return _labelled(insert_all(d, branches).tables)


def insert_first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents into the first table that fits: a text as a number fails to convert unless it is one; other tables check and require."""
    d = _t(spark, sf_dir, "documents")
    number = (F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("no "), F.col("doc_id"))), "int")
    some = (F.when(F.col("doc_id") % 10 > 0, F.col("source")), "string")
    key, size = (F.col("doc_id"), "bigint"), (F.col("n_chars"), "int")
    first = Target("short", {"k": key, "number": number}, ["k"])
    second = Target("foreign", {"k": key, "who": some, "size": size}, ["who"], {"small": lambda r: r["size"] < 3000})
    made = insert_all(d, [(F.col("n_chars") <= 500, [first]), (F.col("lang") != "en", [second])], [Target("rest", {"k": key})], first=True, tag="load", reject_limit=None)
    errors = made.errors.select(F.concat(F.lit("error:"), "target").alias("target"), F.concat_ws(" ", "error", "tag", F.col("given")["k"]).alias("row"))
    return _labelled(made.tables).unionByName(errors)


def multisets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of each conversation's even and odd turns as two bags, with their roles."""
    word = F.concat("role", F.lit(" "), F.substring("text", 1, 1))
    turns = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(*(F.collect_list(F.when(F.expr("turn % 4 DIV 2") == n, word)).alias(c) for n, c in enumerate("ab")))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return turns.select(
        "conv_id", text(bags.multiset_union("a", "b")).alias("union_all"), text(bags.multiset_union("a", "b", True)).alias("union_distinct"), text(bags.multiset_except("a", "b")).alias("except_all"), text(bags.multiset_except("a", "b", True)).alias("except_distinct"),
        text(bags.multiset_intersect("a", "b")).alias("intersect_all"), text(bags.multiset_intersect("a", "b", True)).alias("intersect_distinct"), bags.submultiset("a", "b").alias("sub"), bags.equal("a", "b").alias("same"), bags.is_a_set("a").alias("is_set"), bags.cardinality("a").alias("n"),
    )


def json_table_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of conversations with their turns and, beside them, the digits of their number; ordinals, and sibling rows with nulls."""
    turns = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    built = turns.select("conv_id", F.to_json(F.struct(F.struct(F.lit("ok").alias("status"), F.split(F.col("conv_id").cast("string"), "").alias("digits"), "turns").alias("talk"))).alias("doc"))
    columns = [
        Value("status", "$.status"), Exists("has_turns", "$.turns"), Value("missing", "$.nothing", "int", on_empty=-1),
        Nested("$.turns[*]", [Ordinal("line"), Value("turn", "$.turn", "bigint"), Value("text", "$.text"), Value("number", "$.role", "int", on_error=0)]), Nested("$.digits[*]", [Ordinal("digit_at"), Value("digit", "$", "int")]),
    ]
    found = json_table(built, "doc", "$.talk", columns).drop("doc")
    return found.withColumn("text", F.md5("text"))


def json_table_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_table(_t(spark, sf_dir, "events").select("event_id", "props"), "props", "$", [Value("k", "$.k", "int"), Value("whole", "$", "json"), Exists("has_x", "$.x")], outer=True).drop("props")


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(_t(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), 12.5, 42, ["conv_id", "turn"])


def sample_block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of a sample of the conversations."""
    return sample_blocks(_t(spark, sf_dir, "conversations").select("conv_id", "turn"), 30, 7, F.col("conv_id"))


_WIDE = "9G999G999G999G999G990D00"


def format_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths as amounts, and numbers as dates, by format models and back, with defaults for what is no date."""
    d = _t(spark, sf_dir, "documents")
    amount = ((F.col("n_chars") * 125 - 100_000) / 100).cast("decimal(18,2)")
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("doc_id") % 9000).cast("int"))
    odd = F.format_string("%04d-%02d-%02d", 2000 + F.col("doc_id") % 30, F.col("doc_id") % 14, F.col("doc_id") % 32)
    made = d.select("doc_id", amount.alias("amount"), day.alias("day"), odd.alias("odd"))
    # as wide as the amount's type, so that no length is `#`; text shows 13 places
    made = made.withColumn("wide", formats.to_char_number(F.col("amount"), _WIDE))
    made = made.withColumns({"text": F.lpad(F.ltrim("wide"), 13, " "), "signed": formats.to_char_number(F.col("amount"), "FM9999999999999990D0S"), "long_day": formats.to_char_date(F.col("day"), 'fmDay, DD "of" Month YYYY'), "coded": formats.to_char_date(F.col("day"), "DDD/RR Q")})
    back = formats.to_number(F.col("wide"), _WIDE).cast("decimal(18,2)")
    return made.select("doc_id", "text", "signed", "long_day", "coded", back.alias("back"), formats.to_date(F.col("odd"), "YYYY-MM-DD", "1900-01-01").alias("at"), formats.validate_conversion(F.col("odd"), "date", "YYYY-MM-DD").alias("valid"))


# the operators of change_queries and query_forms on rows of documents and conversations
def ingest_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as objects, their turns as lines that come in no order in three batches."""
    c = _t(spark, sf_dir, "conversations")
    lines = c.select(F.lit("APP").alias("owner"), F.col("conv_id").cast("string").alias("name"), F.lit("PROCEDURE").alias("type"), F.col("turn").alias("line"), "text", F.timestamp_seconds(F.col("turn") * 60 + 1_700_000_000).alias("at"))
    journal = Journal(spark, new_dir(spark, "objects"), ingest.KEY, ingest.OBJECTS)
    ingest.into(ingest.objects(streamed(lines, 3), None), journal, "lines", new_dir(spark, "checkpoint")).awaitTermination()
    return journal.read().select("object_name", "source_hash", "lines")


def _documents(spark: SparkSession, sf_dir: str) -> Journal:
    """Documents without their texts in three writes: all, some of them longer and moved to another language, and without those of one length class."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    journal = Journal(spark, new_dir(spark, "documents"), ["doc_id"], d.schema)
    journal.upsert(d)
    journal.upsert(d.where("doc_id % 4 = 1").withColumn("n_chars", F.col("n_chars") + 7).withColumn("lang", F.when(F.col("doc_id") % 8 == 1, "xx").otherwise(F.col("lang"))))
    journal.delete(d.where("n_chars % 5 = 2"))
    return journal


def view_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and source, from the changes of all three writes by two refreshes."""
    journal = _documents(spark, sf_dir)
    view = AggregateView(spark, new_dir(spark, "view"), journal.schema, ["lang", "source"], ("n_chars",), ("n_chars",), 0)
    view.refresh(journal.changes(0, 1), "documents", 1)
    view.follow(journal, "documents")
    return view.read().select("lang", "source", "n", F.col("sum_n_chars").cast("long").alias("total"), "min_n_chars", "max_n_chars")


def versions_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).versions().select("doc_id", "lang", "n_chars", "operation", "first_seq", "last_seq")


def connect_by_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, each below the one with its number without the last digit; siblings from the longest on, in the order of a depth-first search."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "n_chars", F.expr("CASE WHEN doc_id >= 10 THEN doc_id DIV 10 END").alias("above"))
    walked = connect_by(d, ["doc_id"], ["above"], F.col("above").isNull(), [F.desc("n_chars")], carry=["doc_id"])
    return searched(walked).select("doc_id", "level", F.col("root.k0").alias("root"), "is_leaf", path_text("doc_id").alias("path"), "seq")


def partitioned_outer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each language and source by length, for all lengths that there are in steps of 50; a length without any has what the length before it had."""
    d = _t(spark, sf_dir, "documents").withColumn("step", F.expr("n_chars DIV 50"))
    facts = d.groupBy("lang", "source", "step").agg(F.count("*").alias("n"), F.max("doc_id").alias("last_doc"))
    return partitioned_outer_join(facts, ["lang", "source"], "step", d.select("step").distinct(), carry=True)


def percentile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentile_disc(_t(spark, sf_dir, "documents"), ["lang", "source"], "n_chars", [0.0, 0.05, 0.5, 0.99, 1.0])


def hypothetical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each labelled document's length would stand among the English ones."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.expr("n_chars DIV 10").alias("tens"))
    probes = d.join(_t(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id").select("doc_id", F.lit("en").alias("lang"), F.col("tens").alias("own_tens"))
    found = hypothetical_ranks(d, ["lang"], "tens", probes, "own_tens")
    return found.select("doc_id", "rank", "dense_rank", F.round("percent_rank", 9).alias("percent_rank"), F.round("cume_dist", 9).alias("cume_dist"))


QUERIES = {
    f.__name__: f
    for f in (
        insert_all_routed, insert_first_errors, multisets, json_table_nested, json_table_events, sample_rows, sample_block_rows, format_models,
        ingest_conversations, view_documents, versions_documents, connect_by_documents, partitioned_outer_documents, percentile_documents, hypothetical_documents,
    )
}

_COUNTS = "SELECT conv_id, v, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM (SELECT conv_id, role || ' ' || text[1] AS v, turn % 4 // 2 AS side FROM conversations) x GROUP BY 1, 2"

_WRITES = """
WITH w1 AS (SELECT doc_id, lang, source, n_chars FROM documents),
w2 AS (SELECT doc_id, CASE WHEN doc_id % 8 = 1 THEN 'xx' ELSE lang END AS lang, source, CASE WHEN doc_id % 4 = 1 THEN n_chars + 7 ELSE n_chars END AS n_chars, n_chars AS first_chars FROM w1),
w3 AS (SELECT * FROM w2 WHERE first_chars % 5 <> 2)
"""

ORACLE = {
    "insert_all_routed": """
SELECT 'log' AS target, '{"k":' || doc_id || '}' AS row FROM documents
UNION ALL SELECT 'long', '{"k":' || doc_id || ',"size":' || n_chars || '}' FROM documents WHERE n_chars > 2000
UNION ALL SELECT 'english', '{"k":' || doc_id || ',"source":"' || source || '"}' FROM documents WHERE lang = 'en'
""",
    "insert_first_errors": """
WITH o AS (SELECT *, CASE WHEN n_chars <= 500 THEN 'short' WHEN lang <> 'en' THEN 'foreign' ELSE 'rest' END AS t FROM documents),
e AS (SELECT *, CASE WHEN t = 'short' AND doc_id % 3 <> 0 THEN 'conversion:number'
  WHEN t = 'foreign' AND doc_id % 10 = 0 THEN 'required:who' WHEN t = 'foreign' AND n_chars >= 3000 THEN 'check:small' END AS error FROM o)
SELECT t AS target, CASE t WHEN 'short' THEN '{"k":' || doc_id || ',"number":' || doc_id || '}'
  WHEN 'foreign' THEN '{"k":' || doc_id || ',"who":"' || source || '","size":' || n_chars || '}' ELSE '{"k":' || doc_id || '}' END AS row FROM e WHERE error IS NULL
UNION ALL SELECT 'error:' || t, error || ' load ' || doc_id FROM e WHERE error IS NOT NULL
""",
    "multisets": f"""
WITH c AS ({_COUNTS})
SELECT conv_id, rtrim(string_agg(repeat(v || ',', a + b), '' ORDER BY v), ',') AS union_all, string_agg(v, ',' ORDER BY v) AS union_distinct,
       rtrim(string_agg(repeat(v || ',', greatest(a - b, 0)), '' ORDER BY v), ',') AS except_all, coalesce(string_agg(v, ',' ORDER BY v) FILTER (b = 0), '') AS except_distinct,
       rtrim(string_agg(repeat(v || ',', least(a, b)), '' ORDER BY v), ',') AS intersect_all, coalesce(string_agg(v, ',' ORDER BY v) FILTER (a > 0 AND b > 0), '') AS intersect_distinct,
       bool_and(a <= b) AS sub, bool_and(a = b) AS same, bool_and(a <= 1) AS is_set, CAST(sum(a) AS INTEGER) AS n
FROM c GROUP BY conv_id
""",
    "json_table_nested": """
WITH l AS (SELECT conv_id, turn, md5(text) AS text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS INTEGER) AS line FROM conversations),
o AS (SELECT DISTINCT conv_id, 'ok' AS status, true AS has_turns, -1 AS missing, CAST(conv_id AS VARCHAR) AS digits FROM conversations)
SELECT conv_id, status, has_turns, missing, line, turn, text, 0 AS number, CAST(NULL AS INTEGER) AS digit_at, CAST(NULL AS INTEGER) AS digit FROM o JOIN l USING (conv_id)
UNION ALL
SELECT conv_id, status, has_turns, missing, NULL, NULL, NULL, NULL, CAST(n AS INTEGER), CAST(digits[n] AS INTEGER) FROM (SELECT *, unnest(generate_series(1, len(digits))) AS n FROM o) x
""",
    "json_table_events": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, replace(props, ' ', '') AS whole, false AS has_x FROM events",
    "sample_rows": "SELECT conv_id, turn, role FROM conversations WHERE CAST('0x' || substr(sha256('42:' || conv_id || chr(31) || turn), 1, 8) AS BIGINT) < CAST(0.125 * 4294967296 AS BIGINT)",
    "sample_block_rows": "SELECT conv_id, turn FROM conversations WHERE CAST('0x' || substr(sha256('7:' || conv_id), 1, 8) AS BIGINT) < CAST(floor(0.3 * 4294967296) AS BIGINT)",
    "format_models": """
WITH d AS (SELECT doc_id, n_chars * 125 - 100000 AS cents, DATE '1995-01-01' + CAST(doc_id % 9000 AS INTEGER) AS day, TRY_CAST(printf('%04d-%02d-%02d', 2000 + doc_id % 30, doc_id % 14, doc_id % 32) AS TIMESTAMP) AS odd FROM documents),
e AS (SELECT *, CAST(CASE WHEN cents < 0 THEN -1 ELSE 1 END * ((abs(cents) + 5) // 10) AS BIGINT) AS tenths FROM d)
SELECT doc_id, lpad(format('{:,.2f}', cents / 100), 13, ' ') AS text, (abs(tenths) // 10) || '.' || (abs(tenths) % 10) || CASE WHEN tenths < 0 THEN '-' ELSE '+' END AS signed,
       strftime(day, '%A, ') || day(day) || ' of ' || strftime(day, '%B %Y') AS long_day, strftime(day, '%j/%y ') || quarter(day) AS coded,
       CAST(CAST(cents AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,2)) AS back, coalesce(odd, TIMESTAMP '1900-01-01') AS at, CAST(odd IS NOT NULL AS INTEGER) AS valid FROM e
""",
    "ingest_conversations": "SELECT CAST(conv_id AS VARCHAR) AS object_name, sha256(CASE WHEN upper(ltrim(string_agg(text, '' ORDER BY turn), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) LIKE 'CREATE%' THEN '' ELSE 'CREATE OR REPLACE ' END || string_agg(text, '' ORDER BY turn)) AS source_hash, count(*) AS lines FROM conversations GROUP BY conv_id",
    "view_documents": f"{_WRITES} SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, min(n_chars) AS min_n_chars, max(n_chars) AS max_n_chars FROM w3 GROUP BY 1, 2",
    "versions_documents": f"""{_WRITES},
gone AS (SELECT doc_id FROM w2 WHERE first_chars % 5 = 2)
SELECT doc_id, lang, n_chars, 'I' AS operation, CAST(1 AS BIGINT) AS first_seq, CAST(CASE WHEN doc_id % 4 = 1 THEN 1 WHEN doc_id IN (SELECT doc_id FROM gone) THEN 2 END AS BIGINT) AS last_seq FROM w1
UNION ALL SELECT doc_id, lang, n_chars, 'U', 2, CASE WHEN doc_id IN (SELECT doc_id FROM gone) THEN 2 END FROM w2 WHERE doc_id % 4 = 1
UNION ALL SELECT doc_id, lang, n_chars, 'D', 3, 3 FROM w2 WHERE doc_id IN (SELECT doc_id FROM gone)
""",
    "connect_by_documents": """
WITH RECURSIVE c AS (SELECT doc_id, CASE WHEN doc_id >= 10 THEN doc_id // 10 END AS above, n_chars FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY above ORDER BY n_chars DESC, doc_id) AS place FROM c),
w AS (
  SELECT doc_id, 1 AS level, doc_id AS root, '/' || doc_id AS path, [place] AS ord FROM r WHERE above IS NULL
  UNION ALL
  SELECT r.doc_id, w.level + 1, w.root, w.path || '/' || r.doc_id, list_append(w.ord, r.place) FROM w JOIN r ON r.above = w.doc_id
)
SELECT doc_id, level, root, doc_id NOT IN (SELECT above FROM c WHERE above IS NOT NULL) AS is_leaf, path, row_number() OVER (ORDER BY ord) AS seq FROM w
""",
    "partitioned_outer_documents": """
WITH d AS (SELECT lang, source, n_chars // 50 AS step, doc_id FROM documents),
f AS (SELECT lang, source, step, count(*) AS n, max(doc_id) AS last_doc FROM d GROUP BY 1, 2, 3),
x AS (SELECT k.lang, k.source, s.step, f.n, f.last_doc FROM (SELECT DISTINCT lang, source FROM f) k CROSS JOIN (SELECT DISTINCT step FROM d) s LEFT JOIN f ON f.lang = k.lang AND f.source = k.source AND f.step = s.step)
SELECT lang, source, step, last_value(n IGNORE NULLS) OVER w AS n, last_value(last_doc IGNORE NULLS) OVER w AS last_doc, n IS NULL AS is_filled FROM x
WINDOW w AS (PARTITION BY lang, source ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""",
    "percentile_documents": """
WITH v AS (SELECT lang, source, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY lang, source) AS n FROM documents),
f AS (SELECT unnest([0.0, 0.05, 0.5, 0.99, 1.0]::DECIMAL(14,12)[]) AS f)
SELECT lang, source, CAST(f AS DOUBLE) AS fraction, n_chars FROM v, f WHERE r = greatest(1, ceil(f * n))
""",
    "hypothetical_documents": """
WITH d AS (SELECT doc_id, lang, n_chars // 10 AS tens FROM documents), p AS (SELECT doc_id, tens FROM d WHERE doc_id IN (SELECT doc_id FROM labels)),
e AS (SELECT tens, count(*) AS n FROM d WHERE lang = 'en' GROUP BY 1), t AS (SELECT DISTINCT tens FROM p),
r AS (SELECT t.tens, coalesce(sum(n) FILTER (e.tens < t.tens), 0) AS less, count(*) FILTER (e.tens < t.tens) AS kinds, coalesce(sum(n) FILTER (e.tens <= t.tens), 0) AS upto, sum(n) AS total FROM t, e GROUP BY 1)
SELECT doc_id, CAST(less + 1 AS BIGINT) AS rank, kinds + 1 AS dense_rank, round(less / total, 9) AS percent_rank, round((upto + 1) / (total + 1), 9) AS cume_dist FROM p JOIN r USING (tens)
""",
}
