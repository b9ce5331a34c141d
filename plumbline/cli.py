"""Command line: fetch, parse, explain, summarize and debug over a store in a folder.

Each command starts the Spark jobs of its operators; what it prints are counts, one tree, one summary or one report.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import extract, graph, report, summarize
from plumbline.operators.store import Store, object_info
from plumbline.sources import lines


def _counts(df: DataFrame, by: str) -> dict[str, int]:
    return {r[by]: r["n"] for r in df.groupBy(by).agg(F.sum("count").alias("n")).collect()}


def fetch(spark: SparkSession, store: Store, args: argparse.Namespace) -> str:
    """Lines of a schema (and object), from a table of lines or the database, go to the store."""
    found = lines.from_parquet(spark, args.lines, args.schema, args.object) if args.lines else lines.from_jdbc(spark, lines.settings(), args.schema, args.object)
    n = _counts(store.fetch(lines.assemble(found)), "outcome")
    text = f"{sum(n.values())} objects: {n.get('inserted', 0)} inserted, {n.get('updated', 0)} updated, {n.get('unchanged', 0)} unchanged"
    return text + ("\n" + parse(spark, store, args) if args.parse else "")


def parse(spark: SparkSession, store: Store, args: argparse.Namespace) -> str:
    n = _counts(store.index(args.schema, args.object, getattr(args, "force", False)), "status")
    return f"{sum(n.values())} objects: " + ", ".join(f"{n.get(s, 0)} {s}" for s in ("ok", "error", "wrapped", "unchanged"))


def explain(spark: SparkSession, store: Store, args: argparse.Namespace) -> str:
    return "\n".join(graph.render(graph.explain(store, args.schema, args.object, args.subprogram, args.depth)))


def summary(spark: SparkSession, store: Store, args: argparse.Namespace, complete: summarize.Complete = summarize.outline) -> str:
    """The summary of one object; summaries of all that it reaches are kept and used again while their sources stay."""
    root = (args.schema.upper(), args.object.upper(), args.subprogram.upper() if args.subprogram else None)
    roots = spark.createDataFrame([root], "schema_name string, object_name string, subprogram string")
    sources, parsed = store.read("object_source"), store.read("parse_result")
    info = object_info(sources, parsed)
    edges = store.read("call_edge")
    if args.depth is not None:  # nodes below the limit are shown, and call nothing
        tops = graph.dependency_tree(roots, edges, info, args.depth).where(F.col("status") == "ok").groupBy("schema_name", "object_name", F.upper(F.coalesce("subprogram", F.lit(""))).alias("_sub")).agg(F.min("depth").alias("depth"))
        inner = tops.where(F.col("depth") < args.depth).select(F.col("schema_name").alias("caller_schema"), F.col("object_name").alias("caller_object"), "_sub")
        edges = edges.withColumn("_sub", F.upper(F.coalesce("caller_subprogram", F.lit("")))).join(inner, ["caller_schema", "caller_object", "_sub"], "left_semi").drop("_sub")
    stored = store.read("summary")
    fragments = store.read("subprogram").select("schema_name", "object_name", F.col("subprogram_name").alias("subprogram"), "source_text")
    pieces = None if args.no_substatements else summarize.chunk_texts(store.read("substatement"))
    analyses = None if stored is None else stored.where(F.col("kind") == args.kind).select(*summarize.KEY, "analyses")
    made = summarize.summarize(roots, edges, info, sources, store.read("table_access"), complete, args.kind, args.force, fragments, pieces, stored, analyses).persist()
    store.keep_summaries(made)
    mine = made.where((F.col("schema_name") == root[0]) & (F.col("object_name") == root[1]) & (F.col("sub") == (root[2] or "")))
    row = mine.orderBy((F.col("kind") == args.kind).desc()).first()
    return row["summary"] if row else f"[missing] {root[1]}"


def debug(spark: SparkSession, args: argparse.Namespace) -> str:
    """The report of one text: of a file, of the command line, or of the standard input."""
    if args.source_file:
        with open(args.source_file, encoding="utf-8") as f:
            text = f.read()
    else:
        text = args.source if args.source is not None else sys.stdin.read()
    parsed = extract.parse(lines.from_texts(spark, [(args.schema, args.object, args.object_type, text)])).persist()
    if args.output_json:
        return report.json_records(parsed).first()["record"]
    return "\n".join(r["line"] for r in report.report(parsed).orderBy("at").collect())


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline", description="Analysis of PL/SQL code.")
    p.add_argument("--store", default=os.environ.get("PLUMBLINE_STORE", "./data/store"), help="folder of the stored tables")
    sub = p.add_subparsers(dest="command", required=True)
    made = {name: sub.add_parser(name, help=text) for name, text in (("fetch", "store the sources of a schema"), ("parse", "parse what has changed"), ("explain", "print a dependency tree"), ("summarize", "summarise an object from its callees up"), ("debug", "parse one text and print what was found"))}
    for name in ("fetch", "parse", "explain", "summarize"):
        made[name].add_argument("--schema", required=True)
        made[name].add_argument("--object", required=name in ("explain", "summarize"), default=None)
    for name in ("explain", "summarize"):
        made[name].add_argument("--subprogram", default=None)
        made[name].add_argument("--depth", type=int, default=None)
    made["fetch"].add_argument("--parse", action="store_true")
    made["fetch"].add_argument("--lines", default=None, help="a Parquet table of source lines, in place of the database")
    made["parse"].add_argument("--force", action="store_true")
    made["summarize"].add_argument("--kind", choices=["brief", "detailed"], default="brief")
    made["summarize"].add_argument("--no-substatements", action="store_true")
    made["summarize"].add_argument("--force", action="store_true")
    d = made["debug"]
    d.add_argument("--schema", default="DEBUG")
    d.add_argument("--object", default="ANONYMOUS")
    d.add_argument("--type", dest="object_type", default="PACKAGE BODY")
    one = d.add_mutually_exclusive_group()
    one.add_argument("--source-file", default=None)
    one.add_argument("--source", default=None)
    d.add_argument("--json", dest="output_json", action="store_true")
    d.add_argument("--output", dest="output_file", default=None)
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, complete: summarize.Complete = summarize.outline) -> int:
    """Run one command; 1 if a file cannot be read or written or a setting is missing. complete: what answers the prompts of summarize."""
    args = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("plumbline").getOrCreate()
    store = Store(spark, args.store)
    try:
        if args.command == "summarize":
            text = summary(spark, store, args, complete)
        elif args.command == "debug":
            text = debug(spark, args)
        else:
            text = {"fetch": fetch, "parse": parse, "explain": explain}[args.command](spark, store, args)
        if getattr(args, "output_file", None):
            with open(args.output_file, "w", encoding="utf-8") as f:
                f.write(text + "\n")
        else:
            print(text)
    except OSError as e:
        print(f"Cannot read or write: {e}", file=sys.stderr)
        return 1
    except KeyError as e:
        print(f"Missing setting: {e}", file=sys.stderr)
        return 1
    return 0
