"""Queries of journals, streams and views on the given tables; the SQL computes the same rows from the tables at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.journal import Journal
from plumbline.operators.views import AggregateView
from plumbline.sources.shared import new_dir
from plumbline.streaming import ingest


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(rows: DataFrame, batches: int) -> DataFrame:
    """Rows as a stream of some batches, dealt without order over files."""
    spark, files = rows.sparkSession, 2 * batches
    path = new_dir(spark, "stream-source")
    rows.repartition(files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as objects, their events as lines that come in no order in four batches; every tenth line comes a second time, changed and later."""
    e = _t(spark, sf_dir, "events")
    lines = e.select(F.lit("APP").alias("owner"), F.col("user_id").cast("string").alias("name"), F.lit("PROCEDURE").alias("type"), F.col("event_id").alias("line"), F.concat("event_type", F.lit(";\n")).alias("text"), F.col("ts").alias("at"))
    again = lines.where("line % 10 = 0").withColumn("text", F.upper("text")).withColumn("at", F.col("at") + F.expr("INTERVAL 1 HOUR"))
    journal = Journal(spark, new_dir(spark, "objects"), ingest.KEY, ingest.OBJECTS)
    stream = ingest.objects(streamed(lines.unionByName(again), 4), "90 days")
    ingest.into(stream, journal, "lines", new_dir(spark, "checkpoint")).awaitTermination()
    return journal.read().select("object_name", "source_hash", "lines")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type, counted as they come in four batches."""
    journal = Journal(spark, new_dir(spark, "windows"), ["window_start", "event_type"], "window_start timestamp, event_type string, n long, total decimal(38,6)")
    events = streamed(_t(spark, sf_dir, "events").select("ts", "event_type", "value"), 4)
    ingest.into(ingest.windowed(events, "ts", ["event_type"], "value", "1 day", "90 days"), journal, "windows", new_dir(spark, "checkpoint")).awaitTermination()
    return journal.read().select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.col("total").cast("decimal(18,2)").alias("total"))


def _orders(spark: SparkSession, sf_dir: str) -> Journal:
    """Orders in three writes: all of them, then a higher price for those in progress and another priority for some, then without the finished urgent ones."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    journal = Journal(spark, new_dir(spark, "orders"), ["o_orderkey"], o.schema)
    journal.upsert(o)
    price = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1000).otherwise(F.col("o_totalprice"))
    priority = F.when(F.col("o_orderkey") % 5 == 0, "9-NEW").otherwise(F.col("o_orderpriority"))
    journal.upsert(o.where("o_orderstatus <> 'O'").withColumn("o_totalprice", price).withColumn("o_orderpriority", priority))
    journal.delete(o.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'"))
    return journal


def view_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status and priority, kept by two refreshes: after the first write, and from the changes of the two others."""
    journal = _orders(spark, sf_dir)
    view = AggregateView(spark, new_dir(spark, "view"), journal.schema, ["o_orderstatus", "o_orderpriority"], ("o_totalprice",), ("o_totalprice",), 2)
    view.refresh(journal.changes(0, 1), "orders", 1)
    view.follow(journal, "orders")
    return view.read().select("o_orderstatus", "o_orderpriority", "n", F.col("sum_o_totalprice").cast("decimal(18,2)").alias("total"), "min_o_totalprice", "max_o_totalprice")


def as_of_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders after the first two writes, after a compaction of all three."""
    journal = _orders(spark, sf_dir)
    journal.compact()
    return journal.read(2).select("o_orderkey", "o_totalprice", "o_orderpriority")


def versions_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' histories, with the first and last write of each version."""
    return _orders(spark, sf_dir).versions().select("o_orderkey", "o_totalprice", "o_orderpriority", "operation", "first_seq", "last_seq")


QUERIES = {f.__name__: f for f in (stream_ingest, stream_windows, view_refresh, as_of_write, versions_between)}

_WRITES = """
WITH w1 AS (SELECT o_orderkey, o_orderstatus, o_orderpriority AS first_priority, o_totalprice, o_orderpriority FROM orders),
w2 AS (
  SELECT o_orderkey, o_orderstatus, first_priority, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1000 ELSE o_totalprice END AS o_totalprice,
         CASE WHEN o_orderstatus <> 'O' AND o_orderkey % 5 = 0 THEN '9-NEW' ELSE o_orderpriority END AS o_orderpriority FROM w1
), w3 AS (SELECT * FROM w2 WHERE NOT (o_orderstatus = 'F' AND first_priority = '1-URGENT'))
"""

ORACLE = {
    "stream_ingest": """
SELECT CAST(user_id AS VARCHAR) AS object_name,
       sha256('CREATE OR REPLACE ' || string_agg(CASE WHEN event_id % 10 = 0 THEN upper(event_type || ';' || chr(10)) ELSE event_type || ';' || chr(10) END, '' ORDER BY event_id)) AS source_hash, count(*) AS lines
FROM events GROUP BY user_id
""",
    "stream_windows": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28,6))) AS DECIMAL(18,2)) AS total FROM events GROUP BY 1, 2",
    "view_refresh": f"""{_WRITES}
SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(28,2))) AS DECIMAL(18,2)) AS total, min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice
FROM w3 GROUP BY 1, 2
""",
    "as_of_write": f"{_WRITES} SELECT o_orderkey, o_totalprice, o_orderpriority FROM w2",
    "versions_between": f"""{_WRITES},
changed AS (SELECT w2.o_orderkey FROM w1 JOIN w2 USING (o_orderkey) WHERE w1.o_totalprice <> w2.o_totalprice OR w1.o_orderpriority <> w2.o_orderpriority),
gone AS (SELECT o_orderkey FROM w2 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM w3))
SELECT o_orderkey, o_totalprice, o_orderpriority, 'I' AS operation, CAST(1 AS BIGINT) AS first_seq,
       CAST(CASE WHEN o_orderkey IN (SELECT o_orderkey FROM changed) THEN 1 WHEN o_orderkey IN (SELECT o_orderkey FROM gone) THEN 2 END AS BIGINT) AS last_seq FROM w1
UNION ALL
SELECT o_orderkey, o_totalprice, o_orderpriority, 'U', 2, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM gone) THEN 2 END FROM w2 WHERE o_orderkey IN (SELECT o_orderkey FROM changed)
UNION ALL
SELECT o_orderkey, o_totalprice, o_orderpriority, 'D', 3, 3 FROM w2 WHERE o_orderkey IN (SELECT o_orderkey FROM gone)
""",
}
