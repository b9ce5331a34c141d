"""Queries of hierarchical walks, partitioned outer joins and order statistics on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.densify import partitioned_outer_join
from plumbline.operators.hierarchy import connect_by, path_text, searched
from plumbline.operators.order_stats import hypothetical_ranks, percentile_disc


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connect_by_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, each below the one with its number without the last digit; siblings from the richest on, in the order of a depth-first search."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.expr("CASE WHEN c_custkey >= 10 THEN c_custkey DIV 10 END").alias("above"))
    walked = connect_by(c, ["c_custkey"], ["above"], F.col("above").isNull(), [F.desc("c_acctbal")], carry=["c_custkey"])
    return searched(walked).select("c_custkey", "level", F.col("root.k0").alias("root"), "is_leaf", path_text("c_custkey").alias("path"), "seq")


def connect_by_nocycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in rings of up to seven: each below the one before it, the first of a ring below its last. NOCYCLE marks the row that would close the ring."""
    p = _t(spark, sf_dir, "part").select("p_partkey", F.expr("p_partkey DIV 7").alias("ring"))
    last = p.groupBy("ring").agg(F.max("p_partkey").alias("last"))
    p = p.join(last, "ring").select("p_partkey", F.expr("CASE WHEN p_partkey % 7 = 0 THEN last ELSE p_partkey - 1 END").alias("above"))
    walked = connect_by(p, ["p_partkey"], ["above"], F.col("p_partkey") % 7 == 2, loops="nocycle")
    return walked.select("p_partkey", "level", F.col("root.k0").alias("root"), "is_leaf", "is_cycle")


def recursive_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the pair (customer, place in it), in rings of each customer's orders; the CYCLE clause marks the second visit. Ordered breadth first."""
    o = _t(spark, sf_dir, "orders")
    at = o.select("o_orderkey", "o_custkey", F.expr("row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)").alias("nth"), F.expr("count(*) OVER (PARTITION BY o_custkey)").alias("many"))
    rows = at.select("o_orderkey", "o_custkey", "nth", F.expr("CASE WHEN nth = 1 THEN many ELSE nth - 1 END").cast("int").alias("before"))
    walked = connect_by(rows, ["o_custkey", "nth"], ["o_custkey", "before"], F.col("nth") == 1, loops="mark", max_level=6)
    return searched(walked, breadth=True).select("o_orderkey", "o_custkey", "level", "is_cycle", "seq")


def partitioned_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's daily value on all days that have events at all; a day without events has the value of the user's last day before."""
    e = _t(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    daily = e.groupBy("user_id", "day").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(18,2)").alias("total"), F.count("*").alias("n"))
    days = e.groupBy("day").agg(F.max("event_id").alias("last_event"))
    return partitioned_outer_join(daily, ["user_id"], "day", days, carry=True)


def percentile_disc_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentile_disc(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.0, 0.1, 0.5, 0.95, 1.0])


def percentile_disc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the whole table, and of a value that very many rows have."""
    orders = _t(spark, sf_dir, "orders").withColumn("price", F.when(F.col("o_orderstatus") == "F", 100.0).otherwise(F.col("o_totalprice")))
    return percentile_disc(orders, [], "price", [0.25, 0.5, 0.9], descending=True)


def hypothetical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each supplier's balance would stand among the customers of its nation."""
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"), F.round("s_acctbal").alias("s_acctbal"))
    c = _t(spark, sf_dir, "customer").withColumn("c_acctbal", F.round("c_acctbal"))
    found = hypothetical_ranks(c, ["c_nationkey"], "c_acctbal", s, "s_acctbal")
    return found.select("s_suppkey", "rank", "dense_rank", F.round("percent_rank", 9).alias("percent_rank"), F.round("cume_dist", 9).alias("cume_dist"))


QUERIES = {f.__name__: f for f in (connect_by_siblings, connect_by_nocycle, recursive_cycle, partitioned_outer, percentile_disc_grouped, percentile_disc_table, hypothetical_rank)}

ORACLE = {
    "connect_by_siblings": """
WITH RECURSIVE c AS (
  SELECT c_custkey, CASE WHEN c_custkey >= 10 THEN c_custkey // 10 END AS above, c_acctbal FROM customer
), r AS (
  SELECT *, row_number() OVER (PARTITION BY above ORDER BY c_acctbal DESC, c_custkey) AS place FROM c
), w AS (
  SELECT c_custkey, 1 AS level, c_custkey AS root, '/' || c_custkey AS path, [place] AS ord FROM r WHERE above IS NULL
  UNION ALL
  SELECT r.c_custkey, w.level + 1, w.root, w.path || '/' || r.c_custkey, list_append(w.ord, r.place) FROM w JOIN r ON r.above = w.c_custkey
)
SELECT c_custkey, level, root, NOT EXISTS (SELECT 1 FROM c WHERE c.above = w.c_custkey) AS is_leaf, path, row_number() OVER (ORDER BY ord) AS seq FROM w
""",
    "connect_by_nocycle": """
WITH RECURSIVE l AS (SELECT p_partkey // 7 AS ring, max(p_partkey) AS last FROM part GROUP BY 1),
p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN last ELSE p_partkey - 1 END AS above FROM part JOIN l ON p_partkey // 7 = ring),
w AS (
  SELECT p_partkey, 1 AS level, p_partkey AS root, [p_partkey] AS path FROM p WHERE p_partkey % 7 = 2
  UNION ALL
  SELECT p.p_partkey, w.level + 1, w.root, list_append(w.path, p.p_partkey) FROM w JOIN p ON p.above = w.p_partkey WHERE NOT list_contains(w.path, p.p_partkey)
)
SELECT p_partkey, level, root, NOT EXISTS (SELECT 1 FROM p WHERE p.above = w.p_partkey AND NOT list_contains(w.path, p.p_partkey)) AS is_leaf,
       EXISTS (SELECT 1 FROM p WHERE p.above = w.p_partkey AND list_contains(w.path, p.p_partkey)) AS is_cycle FROM w
""",
    "recursive_cycle": """
WITH RECURSIVE a AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth, count(*) OVER (PARTITION BY o_custkey) AS many FROM orders),
o AS (SELECT *, CASE WHEN nth = 1 THEN many ELSE nth - 1 END AS before FROM a),
w AS (
  SELECT o_orderkey, o_custkey, nth, 1 AS level, [nth] AS path, false AS is_cycle FROM o WHERE nth = 1
  UNION ALL
  SELECT o.o_orderkey, o.o_custkey, o.nth, w.level + 1, list_append(w.path, o.nth), list_contains(w.path, o.nth)
  FROM w JOIN o ON o.o_custkey = w.o_custkey AND o.before = w.nth WHERE NOT w.is_cycle AND w.level < 6
)
SELECT o_orderkey, o_custkey, level, is_cycle, row_number() OVER (ORDER BY level, o_custkey) AS seq FROM w
""",
    "partitioned_outer": """
WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, value FROM events),
f AS (SELECT user_id, day, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total, count(*) AS n FROM e GROUP BY 1, 2),
d AS (SELECT day, max(event_id) AS last_event FROM e GROUP BY 1),
x AS (SELECT u.user_id, d.day, d.last_event, f.total, f.n FROM (SELECT DISTINCT user_id FROM f) u CROSS JOIN d LEFT JOIN f ON f.user_id = u.user_id AND f.day = d.day)
SELECT user_id, day, last_value(total IGNORE NULLS) OVER w AS total, last_value(n IGNORE NULLS) OVER w AS n, last_event, n IS NULL AS is_filled FROM x
WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""",
    "percentile_disc_grouped": """
WITH v AS (SELECT l_returnflag, l_linestatus, l_extendedprice, row_number() OVER w AS r, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice)),
f AS (SELECT unnest([0.0, 0.1, 0.5, 0.95, 1.0]::DECIMAL(14,12)[]) AS f)
SELECT l_returnflag, l_linestatus, CAST(f AS DOUBLE) AS fraction, l_extendedprice FROM v, f WHERE r = greatest(1, ceil(f * n))
""",
    "percentile_disc_table": """
WITH v AS (SELECT price, row_number() OVER (ORDER BY price DESC) AS r, count(*) OVER () AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 100.0 ELSE o_totalprice END AS price FROM orders) o),
f AS (SELECT unnest([0.25, 0.5, 0.9]::DECIMAL(14,12)[]) AS f)
SELECT CAST(f AS DOUBLE) AS fraction, price FROM v, f WHERE r = greatest(1, ceil(f * n))
""",
    "hypothetical_rank": """
WITH s AS (SELECT s_suppkey, s_nationkey, round(s_acctbal) AS b FROM supplier), c AS (SELECT c_nationkey, round(c_acctbal) AS v FROM customer)
SELECT s_suppkey, count(*) FILTER (v < b) + 1 AS rank, count(DISTINCT v) FILTER (v < b) + 1 AS dense_rank,
       CASE WHEN count(v) = 0 THEN 0.0 ELSE round(count(*) FILTER (v < b) / count(v), 9) END AS percent_rank, round((count(*) FILTER (v <= b) + 1) / (count(v) + 1), 9) AS cume_dist
FROM s LEFT JOIN c ON c_nationkey = s_nationkey GROUP BY s_suppkey
""",
}
