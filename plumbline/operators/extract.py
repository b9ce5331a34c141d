"""Facts of source objects: one Arrow pass of the parser, then relational tables."""

from __future__ import annotations

from collections.abc import Collection, Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.plsql import parse_unit

KEY = ["schema_name", "object_name", "object_type"]
CALLER = ["caller_schema", "caller_object", "caller_type"]

PARSED = (
    "schema_name string, object_name string, object_type string, source_hash string, status string, error_message string, "
    "call_edges array<struct<caller_subprogram:string,callee_schema:string,callee_object:string,callee_subprogram:string>>, "
    "table_accesses array<struct<subprogram:string,table_schema:string,table_name:string,operation:string>>, "
    "subprograms array<struct<subprogram_name:string,subprogram_type:string,start_line:int,end_line:int,source_text:string>>, "
    "substatements array<struct<subprogram:string,seq:int,parent_seq:int,position:int,statement_type:string,start_line:int,end_line:int,source_text:string>>"
)
_ARROW = {
    "call_edges": [("caller_subprogram", pa.string()), ("callee_schema", pa.string()), ("callee_object", pa.string()), ("callee_subprogram", pa.string())],
    "table_accesses": [("subprogram", pa.string()), ("table_schema", pa.string()), ("table_name", pa.string()), ("operation", pa.string())],
    "subprograms": [("subprogram_name", pa.string()), ("subprogram_type", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("source_text", pa.string())],
    "substatements": [("subprogram", pa.string()), ("seq", pa.int32()), ("parent_seq", pa.int32()), ("position", pa.int32()), ("statement_type", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("source_text", pa.string())],
}


def _nested(lists: list[list[tuple]], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    """A list of structs for each source, of tuples in the order of fields."""
    offsets = pa.array([0, *accumulate(map(len, lists))], pa.int32())
    columns = list(zip(*chain.from_iterable(lists), strict=True)) or [()] * len(fields)
    made = [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(made, [n for n, _ in fields]))


def parse(objects: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """Nested facts of each object; objects: KEY, source_text, source_hash. A source that cannot be parsed has status error and no facts.

    only: the nested columns that are wanted; the others come back empty, so that their texts need not leave the task.
    """
    wanted = set(_ARROW) if only is None else set(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b["source_text"].to_pylist(), b["object_name"].to_pylist(), strict=True)
            found = [parse_unit(text or "", name or "", wanted) for text, name in pairs]
            nested = {k: _nested([getattr(f, k) if k in wanted else [] for f in found], fields) for k, fields in _ARROW.items()}
            status = {"status": pa.array([f.status for f in found], pa.string()), "error_message": pa.array([f.error_message for f in found], pa.string())}
            yield pa.RecordBatch.from_pydict({k: b[k] for k in (*KEY, "source_hash")} | status | nested)

    return objects.select(*KEY, "source_text", "source_hash").mapInArrow(run, PARSED)


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; rows with a null in the key are all kept, as a unique constraint would."""
    complete = F.lit(True)
    for k in key:
        complete = complete & F.col(k).isNotNull()
    # the hash goes first: rows are sorted by it, while keys mostly begin alike
    nth = F.row_number().over(W.partitionBy(F.xxhash64(*key), *key).orderBy(*order))
    return df.withColumn("_nth", nth).where(~complete | (F.col("_nth") == 1)).drop("_nth")


def call_edges(parsed: DataFrame) -> DataFrame:
    """Edges; the callee's schema is part of the key, so calls of one name in two schemas both stay."""
    return parsed.select(*[F.col(k).alias(c) for k, c in zip(KEY, CALLER, strict=True)], F.inline("call_edges")).distinct()


def table_accesses(parsed: DataFrame) -> DataFrame:
    """Accesses; the table's schema is no part of the key, and the first in source order stays."""
    rows = parsed.select(*KEY, F.posexplode("table_accesses").alias("n", "a")).select(*KEY, "n", "a.*")
    return first_of(rows, [*KEY, "subprogram", "table_name", "operation"], ["n"]).drop("n")


def subprograms(parsed: DataFrame) -> DataFrame:
    """Subprograms with a hash of their text; of overloads the first stays."""
    rows = parsed.select(*KEY, F.posexplode("subprograms").alias("n", "a")).select(*KEY, "n", "a.*")
    return first_of(rows, [*KEY, "subprogram_name"], ["n"]).drop("n").withColumn("source_hash", F.sha2("source_text", 256))


def substatements(parsed: DataFrame) -> DataFrame:
    return parsed.select(*KEY, F.inline("substatements")).withColumn("subprogram", F.coalesce("subprogram", F.lit(""))).withColumn("source_hash", F.sha2("source_text", 256))
