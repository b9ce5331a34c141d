"""An extension: Spark queries for the SQL constructs that the PL/SQL parser recognises.

The reference engine accepts these constructs without running them; here each runs on the given tables.
Where Spark and DuckDB agree on the text, one text serves as query and as check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Queries whose text both engines run.
SHARED: dict[str, str] = {
    # I.1 projections, filters
    "select_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "cte_chain": "WITH a AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey, count(*) AS n FROM a GROUP BY o_custkey) SELECT o_custkey, n FROM b WHERE n > 1",
    "filter_between_like": "SELECT p_partkey, p_type FROM part WHERE p_size BETWEEN 10 AND 20 AND p_type LIKE '%A%' AND p_brand IS NOT NULL",
    "filter_in_subquery": "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "filter_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    "filter_all_subquery": "SELECT p_partkey FROM part WHERE p_size >= (SELECT max(p_size) FROM part)",
    "case_expression": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    "decode_expression": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders",
    "derived_table": "SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE n >= 3",
    # I.2 joins
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey",
    "join_right": "SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey",
    "join_full": "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey",
    "join_using": "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)",
    "join_semi": "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)",
    "join_range": "SELECT r.r_regionkey, n.n_nationkey FROM region r JOIN nation n ON n.n_nationkey BETWEEN r.r_regionkey * 5 AND r.r_regionkey * 5 + 4",
    "join_comma": "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey",
    "join_many": "SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, n.n_name FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE n.n_regionkey = 2",
    # I.3 set operators
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "set_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "set_minus": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 8000",
    # I.4 aggregation
    "group_having": "SELECT o_custkey, count(*) AS n, CAST(sum(o_totalprice) AS DECIMAL(18,2)) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 2",
    "group_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "group_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "distinct_agg": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag",
    "stat_aggs": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS co, round(covar_pop(l_quantity, l_discount), 6) AS cv FROM lineitem GROUP BY l_returnflag",
    "regression": "SELECT l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, regr_count(l_extendedprice, l_quantity) AS n FROM lineitem GROUP BY l_linestatus",
    "percentiles": "SELECT l_returnflag, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity), 4) AS med, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_quantity), 4) AS p90 FROM lineitem GROUP BY l_returnflag",
    # I.5 windows
    "rank_family": "SELECT s_suppkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)",
    "cume_percent": "SELECT s_suppkey, round(cume_dist() OVER w, 9) AS cd, round(percent_rank() OVER w, 9) AS pr FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)",
    "lead_lag": "SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "frame_rows": "SELECT event_id, CAST(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DECIMAL(18,3)) AS s3 FROM events",
    "frame_range": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS last_day FROM events",
    "nth_value": "SELECT event_id, nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM events",
    "ratio_to_report": "SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey), 9) AS ratio FROM supplier",
    # I.6 sort and limit
    "offset_fetch": "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10",
    # I.7 mutations, as the rows that they would leave
    "update_tuple": "SELECT c.c_custkey, coalesce(t.m, c.c_acctbal) AS c_acctbal FROM customer c LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY o_custkey) t ON t.o_custkey = c.c_custkey",
    "delete_where": "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal < 0)",
    "merge_branches": (
        "SELECT coalesce(c.c_custkey, s.s_suppkey) AS k, CASE WHEN s.s_suppkey IS NULL THEN c.c_acctbal WHEN c.c_custkey IS NULL THEN s.s_acctbal ELSE s.s_acctbal + c.c_acctbal END AS bal "
        "FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey WHERE s.s_suppkey IS NULL OR c.c_custkey IS NULL OR s.s_acctbal >= 0"
    ),
    "insert_first": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'rest' END AS target FROM orders",
    # I.8 scalar functions
    "string_functions": "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, substr(c_name, 1, 4) AS s, length(c_name) AS n, replace(c_name, '0', 'o') AS r, lpad(c_mktsegment, 12, '*') AS p, concat(c_name, '-', c_mktsegment) AS c FROM customer",
    "math_functions": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_quantity) AS f, ceil(l_discount * 10) AS c, abs(l_tax - l_discount) AS a, greatest(l_tax, l_discount) AS g, least(l_tax, l_discount) AS e FROM lineitem",
    "null_functions": "SELECT d.doc_id, coalesce(l.quality, -1) AS q, nullif(l.toxic, 0) AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "date_functions": "SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m, date_trunc('month', o_orderdate) AS first FROM orders",
}

#: Spark text and DuckDB text, where they differ.
TWO: dict[str, tuple[str, str]] = {
    # Spark sends the whole list of a NOT IN to every task; a null key is in no list but the empty one
    "join_anti": (
        "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND (o_orderkey IS NOT NULL OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey IS NOT NULL))",
        "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)",
    ),
    "listagg": (
        "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ),
    "keep_first_last": (
        "SELECT o_custkey, min(struct(o_orderdate, o_totalprice)).o_totalprice AS first_price, max(struct(o_orderdate, o_totalprice)).o_totalprice AS last_price FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, min({'d': o_orderdate, 'p': o_totalprice}).p AS first_price, max({'d': o_orderdate, 'p': o_totalprice}).p AS last_price FROM orders GROUP BY o_custkey",
    ),
    "pivot_status": (
        "SELECT * FROM (SELECT o_orderpriority, o_orderstatus FROM orders) PIVOT (count(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
        "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1",
    ),
    "unpivot_flags": (
        "SELECT doc_id, kind, flag FROM labels UNPIVOT (flag FOR kind IN (quality, toxic))",
        "SELECT doc_id, 'quality' AS kind, quality AS flag FROM labels WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'toxic', toxic FROM labels WHERE toxic IS NOT NULL",
    ),
    "last_ignore_nulls": (
        "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bought FROM events",
        "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bought FROM events",
    ),
    "lateral_words": (
        "SELECT b.item_id, count(*) AS n, max(length(w.word)) AS longest FROM benchmark b, LATERAL explode(split(b.text, ' ')) AS w(word) GROUP BY b.item_id",
        "SELECT item_id, count(*) AS n, max(length(word)) AS longest FROM (SELECT item_id, unnest(string_split(text, ' ')) AS word FROM benchmark) GROUP BY item_id",
    ),
    # the tenth size alone decides, so no window takes all rows into one task
    "fetch_ties": (
        "SELECT p_partkey, p_size FROM part WHERE p_size >= (SELECT min(p_size) FROM (SELECT p_size FROM part ORDER BY p_size DESC LIMIT 10) t)",
        "SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part) t WHERE r <= 10",
    ),
    "json_field": ("SELECT event_id, length(props) AS n, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, length(props) AS n, json_extract_string(props, '$.k') AS k FROM events"),
}


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Temporary views of the tables that a text names."""
    for t in TABLES:
        if t in text:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text)
        return spark.sql(text)

    return query


def fetch_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest 5% of the order keys, rounded up: most lie below a quantile that surely is among them; only the rest, some thousandths of all, is put in order."""
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").distinct()
    many = -(-keys.count() * 5 // 100)
    error = 0.001
    sure = keys.approxQuantile("o_orderkey", [0.05 - 2 * error], error)
    if not sure:
        return keys
    below = keys.where(F.col("o_orderkey") < sure[0])
    return below.unionByName(keys.where(F.col("o_orderkey") >= sure[0]).orderBy("o_orderkey").limit(many - below.count()))


QUERIES = {k: _run(v) for k, v in SHARED.items()} | {k: _run(v[0]) for k, v in TWO.items()} | {"fetch_percent": fetch_percent}
ORACLE = SHARED | {k: v[1] for k, v in TWO.items()} | {
    "fetch_percent": "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderkey FROM orders) d) t WHERE r <= ceil(n * 5 / 100.0)"
}
