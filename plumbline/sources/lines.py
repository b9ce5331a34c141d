"""Source lines and their assembly into objects."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schema of a table of source lines.
LINES = "owner string, name string, type string, line int, text string"


def settings(env: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options of from_jdbc by the variables ORACLE_USER, ORACLE_PASSWORD and ORACLE_DSN; a missing one raises KeyError."""
    env = os.environ if env is None else env
    return {"url": f"jdbc:oracle:thin:@{env['ORACLE_DSN']}", "user": env["ORACLE_USER"], "password": env["ORACLE_PASSWORD"], "driver": "oracle.jdbc.OracleDriver"}


def from_texts(spark: SparkSession, texts: Iterable[tuple[str, str, str, str | None]]) -> DataFrame:
    """Objects of a few given texts (schema, name, type, text), which are taken as they are."""
    rows = spark.createDataFrame([(s.upper(), n.upper(), t.upper(), x) for s, n, t, x in texts], "schema_name string, object_name string, object_type string, source_text string")
    return rows.withColumn("source_text", F.coalesce("source_text", F.lit(""))).withColumn("source_hash", F.sha2("source_text", 256))


def from_jdbc(spark: SparkSession, options: dict[str, str], schema: str, obj: str | None = None) -> DataFrame:
    """Lines of a schema (and object) from a database; the filters and the columns reach it."""
    lines = spark.read.format("jdbc").options(**options, dbtable="ALL_SOURCE").load()
    return only(lines.select("owner", "name", "type", "line", "text"), schema, obj)


def from_parquet(spark: SparkSession, path: str, schema: str, obj: str | None = None) -> DataFrame:
    return only(spark.read.schema(LINES).parquet(path), schema, obj)


def from_files(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    """Whole files as objects named after them."""
    name = F.upper(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1))
    return spark.read.text(path, wholetext=True).select(F.lit(schema.upper()).alias("schema_name"), name.alias("object_name"), F.lit(kind.upper()).alias("object_type"), with_create(F.col("value")).alias("source_text"))


def only(lines: DataFrame, schema: str, obj: str | None = None) -> DataFrame:
    found = lines.where(F.col("owner") == schema.upper())
    return found.where(F.col("name") == obj.upper()) if obj else found


def with_create(source: Column) -> Column:
    """A source that does not begin with CREATE gets the words in front."""
    return F.when(F.upper(F.regexp_replace(source, r"^\s+", "")).startswith("CREATE"), source).otherwise(F.concat(F.lit("CREATE OR REPLACE "), source))


def assemble(lines: DataFrame) -> DataFrame:
    """Objects of lines: schema_name, object_name, object_type, source_text, source_hash. Lines join in order, without anything between; a null line is empty."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "")
    # the hash goes first: groups are sorted by it, while names mostly begin alike
    named = lines.groupBy(F.xxhash64("owner", "name", "type").alias("_hash"), F.col("owner").alias("schema_name"), F.col("name").alias("object_name"), F.col("type").alias("object_type")).agg(whole.alias("source_text")).drop("_hash")
    return named.withColumn("source_text", with_create(F.col("source_text"))).withColumn("source_hash", F.sha2("source_text", 256))
