"""URL filters by a sort-merge range join of reversed-host keys with rule intervals.

A key is the host's labels in reverse, a separator, then the path. All keys that a rule's path prefix
covers under one host form one interval [prefix, prefix + 0xFF), and the intervals nest. A url asks with
one key for each suffix of its host, since a rule also fits subdomains. Interval starts, interval ends
and keys are sorted together over range partitions; the sweep keeps the running depth (+1 at a start,
-1 at an end) and, for each depth, the last rule that opened there: that is the stack, and its top at a key
is the longest rule for that host suffix. Sums and stacks at partition borders come from one small row
for each partition (and depth). Everything is a DataFrame function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import lower_ascii, stash, table

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end; without :// or url both are empty."""
    host = lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    host, path = F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))
    return host, path


def _key(host: Column, path: Column) -> Column:
    """Reversed labels, each followed by 0x01, then 0x02 and the path; as bytes. In labels those bytes stand as 0x03 and another one."""
    for byte, escaped in (("\x03", "\x03\x03"), ("\x01", "\x03\x04"), ("\x02", "\x03\x05")):
        host = F.replace(host, F.lit(byte), F.lit(escaped))
    labels = F.reverse(F.split(host, r"\."))
    return F.concat(F.array_join(labels, "\x01"), F.lit("\x01\x02"), path).cast("binary")


def apply_rules(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The longest rule that fits each distinct (host, path) of urls: host, path, rule, verdict.

    rules: host, path, verdict; of repeated rules a block wins. A rule fits its host and all subdomains if
    the path starts with its own. Longest: most characters of host and path; ties go to the smaller rule
    text. Where none fits, rule is null and verdict is default. Rules with a null host or path are left
    out. Empty urls or rules: as many rows as there are distinct pairs.
    """
    pairs = stash(urls.select("host", "path").distinct())
    rules = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict")).alias("v"))
    rules = rules.select(_key(lower_ascii(F.col("host")), F.col("path")).alias("key"), F.struct(F.concat("host", "path").alias("rule"), F.col("v.verdict").alias("verdict")).alias("rule"))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asks = pairs.where("host <> ''").select("host", "path", F.explode(suffixes).alias("suffix")).select(_key(F.col("suffix"), F.col("path")).alias("key"), F.lit(0).alias("step"), none.alias("rule"), "host", "path")
    no = [F.lit(None).cast("string").alias(c) for c in ("host", "path")]
    starts = rules.select("key", F.lit(1).alias("step"), "rule", *no)
    ends = rules.select(F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(-1).alias("step"), none.alias("rule"), *no)
    rank = F.when(F.col("step") == 1, 0).otherwise(1)  # at a key, a rule opens before the key asks
    events = asks.unionByName(starts).unionByName(ends).withColumn("o", rank).withColumn("salt", F.xxhash64("host", "path"))
    n = urls.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = stash(events.repartitionByRange(int(n), "key", "o", "salt").withColumn("part", F.spark_partition_id()))

    order = ["key", "o", "salt"]
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    sums = dealt.groupBy("part").agg(F.sum("step").alias("d")).select("part", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("base"))
    swept = dealt.join(sums, "part").withColumn("depth", F.col("base") + F.sum("step").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    # The stack: by depth, the last rule that opened there. Ends only lower the depth.
    swept = stash(swept.where("step >= 0").select("part", "key", "o", "salt", "depth", "rule", "host", "path"))
    opened = swept.where("rule is not null").groupBy("part", "depth").agg(F.max_by("rule", F.struct("key", "salt")).alias("last"))
    # carried: what was open at a depth when a partition began, for the depths that it meets
    met = swept.select("part", "depth").distinct()
    earlier = W.partitionBy("depth").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    carried = met.join(opened, ["part", "depth"], "left").select("part", "depth", F.last("last", ignorenulls=True).over(earlier).alias("carry"))
    top = F.last("rule", ignorenulls=True).over(W.partitionBy("part", "depth").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    asked = swept.withColumn("top", top).where("host is not null").join(carried, ["part", "depth"], "left")
    fits = asked.where("depth > 0").select("host", "path", F.coalesce("top", "carry").alias("r"))
    best = fits.groupBy("host", "path").agg(F.min(F.struct((-F.length("r.rule")).alias("n"), F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))).alias("best"))
    return pairs.join(best, ["host", "path"], "left").select("host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def judge_urls(df: DataFrame, rules: DataFrame, keep: list[str], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Every row's keep columns with host, path, rule and verdict; repeated rows stay. A null url has an empty host and path."""
    host, path = host_and_path(F.col(url_col))
    rows = df.select(*keep, host.alias("host"), path.alias("path"))
    judged = stash(apply_rules(rows, rules, default))
    return rows.join(judged, ["host", "path"], "left").select(*keep, "host", "path", "rule", "verdict")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, path, verdict)")
    return judge_urls(table(spark, sf_dir, "pages"), rules, ["page_id"])


OP4_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), j AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM j
"""
