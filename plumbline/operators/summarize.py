"""Summaries of dependency trees, level by level from the leaves, with prompts as columns and a completer that the caller gives.

Nodes are visited once each, however many paths reach them. A level is one pass over the nodes whose callees are
done: a join gathers their callees' summaries, an expression builds their prompts, and only the call of the completer runs as
Python, in batches. Long subprograms go through their chunks one after the other, inside that call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import chunks as ch
from plumbline.operators import graph
from plumbline.sources.shared import drop, kept

Complete = Callable[[str, str], str]

#: Texts of the prompts; a caller may give others by the same names.
TEXTS = {
    "system": "You analyse Oracle PL/SQL code. Say briefly and exactly what the given object does.",
    "system_chunk": "You analyse Oracle PL/SQL code piece by piece. Keep track of key variables and of their state.",
    "system_detailed": "You analyse Oracle PL/SQL code. Describe the object in detail, with its control flow and business rules.",
    "object": "Object: ", "code": "Source code:", "fragment": "Present piece:", "context": "Context of the pieces before:", "tables": "Table accesses:", "calls": "Called objects:",
    "analyses": "Analysis by pieces:", "piece": "--- Piece {0} ---",
    "brief": "Write a short description (2-4 sentences) of what this object does.",
    "detailed": "Write a detailed description: parameters; the order of actions; conditions and branches; table accesses; exception handling; results.",
    "chunk": "Analyse this piece: 1. key variables; 2. what it does; 3. conditions and branches; 4. data that it touches.",
}

#: Names go first: joins sort by them, and schemas are mostly the same.
KEY = ["object_name", "schema_name", "sub"]


def outline(system: str, user: str) -> str:
    """An offline completer: the object's line, and how many callees and pieces the prompt has."""
    lines = user.split("\n")
    calls = lines[lines.index(TEXTS["calls"]) + 1 :] if TEXTS["calls"] in lines else []
    many = next((n for n, x in enumerate(calls) if not x.startswith("- ")), len(calls))
    return f"{lines[0]} calls {many}"


def reference(obj: Column, sub: Column) -> Column:
    return F.concat(obj, F.coalesce(F.concat(F.lit("."), F.nullif(sub, F.lit(""))), F.lit("")))


def _listed(head: str, items: Column) -> Column:
    """A heading with a line for each item, and an empty line; nothing without items."""
    return F.when(F.size(items) > 0, F.concat(F.lit(head + "\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n\n"))).otherwise("")


def _fenced(head: str, text: Column) -> Column:
    return F.concat(F.lit(head + "\n```plsql\n"), F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("\n```\n\n"))


def _heading(texts: dict[str, str]) -> Column:
    return F.concat(F.lit(texts["object"]), F.col("schema_name"), F.lit("."), reference(F.col("object_name"), F.col("sub")), F.lit(" ("), F.coalesce("object_type", F.lit("UNKNOWN")), F.lit(")\n\n"))


def prompt(kind: str = "brief", texts: dict[str, str] | None = None) -> Column:
    """The prompt of a node with columns schema_name, object_name, sub, object_type, fragment, tables and calls (texts `ref: summary`)."""
    t = TEXTS | (texts or {})
    return F.concat(_heading(t), _fenced(t["code"], F.coalesce("fragment", F.lit(""))), _listed(t["tables"], F.col("tables")), _listed(t["calls"], F.col("calls")), F.lit(t[kind]))


def chunk_texts(statements: DataFrame, max_chunk_tokens: int = 2000) -> DataFrame:
    """pieces of each subprogram that is long enough to be summarised by chunks: an array of (chunk_index, chunk_hash, text)."""
    placed = ch.tree(statements)
    long = placed.groupBy(*ch.SCOPE).agg(F.sum(F.length("source_text")).alias("all")).where(F.col("all") >= ch.THRESHOLD).drop("all")
    made = ch.chunks(statements.join(long, ch.SCOPE), max_chunk_tokens)
    roots = made.select(*ch.SCOPE, "chunk_index", "chunk_hash", F.posexplode("root_seqs").alias("nth", "seq"))
    shown = F.concat(F.lit("-- ["), "statement_type", F.lit("] (lines "), "start_line", F.lit("-"), "end_line", F.lit(")\n"), F.trim("source_text"))
    lines = roots.join(statements.select(*ch.SCOPE, "seq", shown.alias("text")), [*ch.SCOPE, "seq"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"])
    pieces = lines.groupBy(*ch.SCOPE, "chunk_index", "chunk_hash").agg(F.array_join(ordered, "\n\n").alias("text"))
    return pieces.groupBy(*ch.SCOPE).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_hash", "text"))).alias("pieces"))


_DONE = "schema_name string, object_name string, sub string, object_type string, kind string, source_hash string, summary string, analyses array<struct<chunk_index:int,chunk_hash:string,analysis:string>>"


def _complete(complete: Complete, kind: str, t: dict[str, str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Each row's summary: by its prompt, or by its pieces in order, each with what was said of those before it.

    A stored analysis of a piece counts while it and all before it have their hashes still.
    """
    system = t["system_detailed" if kind == "detailed" else "system"]

    def by_pieces(r) -> tuple[str, list[dict]]:  # noqa: ANN001
        known, said, valid = {x["chunk_index"]: x for x in (r.stored if r.stored is not None else [])}, [], True
        for p in r.pieces:
            old = known.get(p["chunk_index"])
            valid = valid and old is not None and old["chunk_hash"] == p["chunk_hash"]
            context = f"{t['context']}\n" + "\n\n".join(x["analysis"] for x in said) + "\n\n" if said else ""
            text = old["analysis"] if valid else complete(t["system_chunk"], f"{r.head}{context}{t['fragment']}\n```plsql\n{p['text']}\n```\n\n{r.lists}{t['chunk']}")
            said.append({"chunk_index": p["chunk_index"], "chunk_hash": p["chunk_hash"], "analysis": text})
        every = "\n".join(f"\n{t['piece'].format(n)}\n{x['analysis']}" for n, x in enumerate(said, 1))
        return complete(system, f"{r.head}{t['analyses']}\n{every}\n\n{t[kind]}"), said

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [by_pieces(r) if r.pieces is not None and len(r.pieces) else (complete(system, r.prompt), []) for r in b.itertuples(index=False)]
            out = b[[*KEY, "object_type", "kind", "source_hash"]].copy()
            out["summary"], out["analyses"] = [x for x, _ in found], [x for _, x in found]
            yield out

    return run


def summarize(
    roots: DataFrame, edges: DataFrame, info: DataFrame, sources: DataFrame, accesses: DataFrame, complete: Complete = outline, kind: str = "brief", force: bool = False,
    fragments: DataFrame | None = None, pieces: DataFrame | None = None, stored: DataFrame | None = None, analyses: DataFrame | None = None, texts: dict[str, str] | None = None,
) -> DataFrame:
    """A row for each node that the roots reach: its key, object_type, kind, source_hash, summary, analyses and status.

    sources: schema_name, object_name, object_type, source_text, source_hash; accesses: as table_accesses() gives them;
    fragments: schema_name, object_name, subprogram, source_text of single subprograms (else the whole source is shown); pieces: as
    chunk_texts() gives them; stored and analyses: earlier results by key, used while their hashes hold (force
    passes over stored summaries, never over analyses). Callees are always summarised briefly; kind is that of the roots. A node that is
    missing, wrapped, broken or not indexed, and the end of a cycle, is `[status] name` and asks nothing.
    """
    t = TEXTS | (texts or {})
    sub = lambda c: F.upper(F.coalesce(c, F.lit("")))
    reached = graph.reach(roots, edges, info).select("schema_name", "object_name", sub(F.col("subprogram")).alias("sub"), "object_type", "status", "depth")
    nodes = reached.groupBy(*KEY).agg(F.first("object_type").alias("object_type"), F.first("status").alias("status"), F.min("depth").alias("depth"))
    nodes = kept(nodes)
    calls = edges.select(F.col("caller_schema").alias("schema_name"), F.col("caller_object").alias("object_name"), sub(F.col("caller_subprogram")).alias("sub"), F.coalesce(F.nullif("callee_schema", F.lit("")), "caller_schema").alias("to_schema"), F.col("callee_object").alias("to_object"), sub(F.col("callee_subprogram")).alias("to_sub")).distinct()
    to = nodes.select(F.col("schema_name").alias("to_schema"), F.col("object_name").alias("to_object"), F.col("sub").alias("to_sub"), F.col("depth").alias("to_depth"))
    deps = kept(calls.join(nodes.where("status = 'ok'").select(*KEY, "depth"), KEY).join(to, ["to_object", "to_schema", "to_sub"]))
    touched = accesses.groupBy("schema_name", "object_name", sub(F.col("subprogram")).alias("sub")).agg(F.array_sort(F.collect_set(F.concat(F.concat_ws(".", "table_schema", "table_name"), F.lit(" ("), "operation", F.lit(")")))).alias("tables"))
    rows = nodes.where("status = 'ok'").join(sources.select("schema_name", "object_name", "object_type", "source_text", "source_hash"), ["object_name", "schema_name", "object_type"], "left").join(touched, KEY, "left")
    if fragments is not None:
        own = fragments.select("schema_name", "object_name", sub(F.col("subprogram")).alias("sub"), F.col("source_text").alias("own"))
        rows = rows.join(own, KEY, "left")
    none_list = F.lit(None).cast("array<struct<chunk_index:int,chunk_hash:string,text:string>>")
    if pieces is not None:
        rows = rows.join(pieces.withColumn("sub", sub(F.col("subprogram"))).drop("subprogram"), [*KEY, "object_type"], "left")
    no_old = F.lit(None).cast("array<struct<chunk_index:int,chunk_hash:string,analysis:string>>")
    rows = rows.join(analyses.select(*KEY, F.col("analyses").alias("stored")), KEY, "left") if analyses is not None else rows.withColumn("stored", no_old)
    shown = F.coalesce("own", "source_text") if fragments is not None else F.col("source_text")
    rows = kept(rows.withColumn("fragment", shown).withColumn("pieces", F.col("pieces") if pieces is not None else none_list).withColumn("tables", F.coalesce("tables", F.array().cast("array<string>"))))
    known = stored.select(*KEY, F.col("source_hash").alias("old_hash"), F.col("kind").alias("old_kind"), F.col("summary").alias("old")) if stored is not None and not force else None
    stub = F.concat(F.lit("["), "status", F.lit("] "), reference(F.col("object_name"), F.col("sub")))
    done = nodes.where("status <> 'ok'").select(*KEY, "object_type", F.lit("brief").alias("kind"), F.lit(None).cast("string").alias("source_hash"), stub.alias("summary"), no_old.alias("analyses"), "status")

    def made(ready: DataFrame, kind: str) -> DataFrame:
        """Summaries of ready nodes: KEY, and calls."""
        asked = rows.join(ready, KEY).withColumn("kind", F.lit(kind))
        if known is None:
            old = None
        else:
            with_old = asked.join(known, KEY, "left")
            holds = (F.col("old_hash") == F.col("source_hash")) & (F.col("old_kind") == kind)
            old = with_old.where(holds).select(*KEY, "object_type", "kind", "source_hash", F.col("old").alias("summary"), F.col("stored").alias("analyses"))
            asked = with_old.where(~F.coalesce(holds, F.lit(False)))
        cols = asked.select(*KEY, "object_type", "kind", "source_hash", "pieces", "stored", _heading(t).alias("head"), F.concat(_listed(t["tables"], F.col("tables")), _listed(t["calls"], F.col("calls"))).alias("lists"), prompt(kind, texts).alias("prompt"))
        new = cols.mapInPandas(_complete(complete, kind, t), _DONE)
        return (new if old is None else new.unionByName(old)).withColumn("status", F.lit("ok"))

    def called(over: DataFrame) -> DataFrame:
        """KEY and calls of nodes by their dependencies (KEY, to_object, to_sub, text)."""
        line = F.concat(reference(F.col("to_object"), F.col("to_sub")), F.lit(": "), "text")
        return over.groupBy(*KEY).agg(F.array_sort(F.collect_list(line)).alias("calls"))

    while True:
        left = rows.select(*KEY).join(done, KEY, "left_anti")
        if left.isEmpty():
            break
        text = done.select(F.col("schema_name").alias("to_schema"), F.col("object_name").alias("to_object"), F.col("sub").alias("to_sub"), F.col("summary").alias("text"))
        over = asked = kept(left.join(deps, KEY, "left").join(text, ["to_object", "to_schema", "to_sub"], "left"))
        is_open = F.col("to_object").isNotNull() & F.col("text").isNull()
        ready = over.groupBy(*KEY).agg(F.count_if(is_open).alias("open"), F.count_if(is_open & (F.col("to_depth") > F.col("depth"))).alias("deeper"))
        now = ready.where("open = 0").select(*KEY)
        if now.isEmpty():  # only cycles are left: what calls back to its own level or above ends there
            now = ready.where("deeper = 0").select(*KEY)
        over = over.withColumn("text", F.when(is_open, F.concat(F.lit("[cycle] "), reference(F.col("to_object"), F.col("to_sub")))).otherwise(F.col("text")))
        gathered = now.join(called(over.where("to_object is not null")), KEY, "left").withColumn("calls", F.coalesce("calls", F.array().cast("array<string>")))
        level = kept(made(gathered, "brief"))
        drop(asked)
        done = done.unionByName(level)
    if kind == "brief":
        return done
    tops = roots.select(F.upper("schema_name").alias("schema_name"), F.upper("object_name").alias("object_name"), sub(F.col("subprogram")).alias("sub")).distinct()
    text = done.select(F.col("schema_name").alias("to_schema"), F.col("object_name").alias("to_object"), F.col("sub").alias("to_sub"), F.col("summary").alias("text"))
    over = tops.join(deps, KEY).join(text, ["to_object", "to_schema", "to_sub"])
    ready = tops.join(called(over), KEY, "left").withColumn("calls", F.coalesce("calls", F.array().cast("array<string>")))
    return done.unionByName(made(ready, kind))


def to_store(summaries: DataFrame) -> DataFrame:
    """The rows that a store keeps: summaries of objects whose hash is known."""
    return summaries.where("status = 'ok' and source_hash is not null").drop("status")
