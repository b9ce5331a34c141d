"""Stored tables as Parquet folders: hash-checked upserts, replacement of an object's facts, incremental parsing."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.extract import KEY, call_edges, parse, subprograms, substatements, table_accesses


def outcomes(old: DataFrame, new: DataFrame, key: list[str] | None = None) -> DataFrame:
    """new with outcome: inserted, updated or unchanged, by the stored hash."""
    key = key or KEY
    stored = old.select(*key, F.col("source_hash").alias("_stored"))
    what = F.when(F.col("_stored").isNull(), "inserted").when(F.col("_stored") == F.col("source_hash"), "unchanged").otherwise("updated")
    return new.join(stored, key, "left").withColumn("outcome", what).drop("_stored")


def upsert(old: DataFrame, new: DataFrame, key: list[str] | None = None) -> DataFrame:
    """old with new's changed rows in place; unchanged rows stay as they are, with their times."""
    key = key or KEY
    changed = outcomes(old, new, key).where("outcome <> 'unchanged'").drop("outcome")
    return changed.unionByName(old.join(changed.select(*key), key, "left_anti"), allowMissingColumns=True)


def replace(old: DataFrame, new: DataFrame, touched: DataFrame, key: list[str]) -> DataFrame:
    """old without the rows of the touched keys, with new ones; an object without new rows ends up empty."""
    return old.join(touched.select(*key).distinct(), key, "left_anti").unionByName(new)


def pending(objects: DataFrame, parsed: DataFrame, force: bool = False) -> DataFrame:
    """Objects whose present source is not parsed yet; all of them when forced."""
    return objects if force else objects.join(parsed.select(*KEY, "source_hash"), [*KEY, "source_hash"], "left_anti")


def prefer_body(objects: DataFrame) -> DataFrame:
    """One row for each schema and name: a body before its specification, then by type name."""
    rank = F.struct((~F.col("object_type").endswith("BODY")).alias("o"), "object_type")
    first = objects.groupBy("schema_name", "object_name").agg(F.min(rank).alias("r")).select("schema_name", "object_name", F.col("r.object_type").alias("object_type"))
    return objects.join(first, KEY)


def object_info(objects: DataFrame, parsed: DataFrame) -> DataFrame:
    """Type and status by schema and name; unindexed where nothing is parsed."""
    joined = objects.join(parsed.select(*KEY, "status", "error_message"), KEY, "left")
    return prefer_body(joined.select(*KEY, F.coalesce("status", F.lit("unindexed")).alias("status"), "error_message"))


def source_text(objects: DataFrame) -> DataFrame:
    """The whole text by schema and name, of the body where there is one: schema_name, object_name, object_type, source_text."""
    return prefer_body(objects).select(*KEY, "source_text")


def parse_hash(parsed: DataFrame) -> DataFrame:
    """The hash of the source that was parsed last, by schema and name: what a stored summary must match."""
    return prefer_body(parsed).select(*KEY, "source_hash")


class Store:
    """Tables under one folder. A write goes to new version folders; one appended pointer file then names them all.

    So the tables of one write change together: a reader sees all of them or none, and a failed write changes nothing.
    Version folders that no pointer names any more may be deleted by a retention rule.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def current(self) -> dict[str, str]:
        """The version of each table."""
        try:
            lines = self.spark.read.text(f"{self.path}/current").select(F.split("value", " ").alias("v"))
        except AnalysisException:
            return {}
        last = lines.groupBy(F.col("v")[1].alias("name")).agg(F.max_by(F.col("v")[2], F.col("v")[0]).alias("version"))
        return {r["name"]: r["version"] for r in last.collect()}

    def read(self, name: str, like: DataFrame | None = None) -> DataFrame | None:
        """The table as it is now; without one, None or no rows of like's columns."""
        version = self.current().get(name)
        if version is None:
            return None if like is None else like.limit(0)
        return self.spark.read.parquet(f"{self.path}/{name}/{version}")

    def write(self, name: str, df: DataFrame) -> None:
        self.write_all({name: df})

    def write_all(self, tables: dict[str, DataFrame]) -> None:
        versions = {name: uuid.uuid4().hex for name in tables}
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{name}/{versions[name]}")
        now = f"{time.time_ns():020d}"
        rows = [(f"{now} {name} {version}",) for name, version in versions.items()]
        self.spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(f"{self.path}/current")

    def fetch(self, objects: DataFrame) -> DataFrame:
        """Store assembled objects; counts by outcome."""
        new = objects.withColumn("fetched_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
        old = self.read("object_source", new)
        counts = outcomes(old, new).groupBy("outcome").count().persist()
        counts.count()
        self.write("object_source", upsert(old, new))
        return counts

    def index(self, schema: str, obj: str | None = None, force: bool = False) -> DataFrame:
        """Parse what is pending and replace its facts; counts by status, unchanged included."""
        objects = self.read("object_source")
        if objects is None:
            return self.spark.createDataFrame([], "status string, count long")
        objects = objects.where(F.col("schema_name") == schema.upper())
        objects = objects.where(F.col("object_name") == obj.upper()) if obj else objects
        blank = parse(objects.limit(0))
        status = blank.select(*KEY, "source_hash", "status", "error_message", F.lit("").alias("parsed_at"))
        done = self.read("parse_result", status)
        todo = pending(objects, done, force)
        self.write("parse_output", parse(todo))
        got = self.read("parse_output")
        result = got.select(*KEY, "source_hash", "status", "error_message", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("parsed_at"))
        caller = ["caller_schema", "caller_object", "caller_type"]
        touched = got.select(*KEY, *[F.col(k).alias(c) for k, c in zip(KEY, caller, strict=True)])
        tables = {}
        for name, make, key in (("call_edge", call_edges, caller), ("table_access", table_accesses, KEY), ("subprogram", subprograms, KEY), ("substatement", substatements, KEY)):
            new = make(got)
            tables[name] = replace(self.read(name, new), new, touched, key)
        self.write_all(tables | {"parse_result": replace(done, result, got, KEY)})
        counts = [got.groupBy("status").count(), objects.join(got.select(*KEY), KEY, "left_anti").groupBy(F.lit("unchanged").alias("status")).count()]
        return reduce(DataFrame.unionByName, counts)

    def keep_summaries(self, made: DataFrame) -> None:
        """Put the summaries of objects whose hash is known in the place of earlier ones of the same node."""
        from plumbline.operators.summarize import KEY as NODE
        from plumbline.operators.summarize import to_store

        new = to_store(made)
        self.write("summary", replace(self.read("summary", new), new, new, [*NODE, "kind"]))
