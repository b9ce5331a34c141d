"""Hierarchical queries: START WITH, CONNECT BY on any keys, NOCYCLE, ORDER SIBLINGS BY, SEARCH and CYCLE.

Rows are walked level by level: each level joins the frontier with the rows and is written to the shared folder; nothing
is cached. A visit carries the keys on its path, by which cycles are found, and the ranks of its path's rows among their
siblings. Ranks are given before the walk begins, by exact running counts, so a parent with very many children is no
single task's work. The order of a depth-first search is the order of the arrays of ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.order_stats import running
from plumbline.sources.shared import drop, kept, new_dir

#: Columns that a walk adds to the rows'.
ADDED = ["level", "root", "path", "is_leaf", "is_cycle", "sibling_order"]


class ConnectByLoop(ValueError):
    """A row is its own ancestor, and neither NOCYCLE nor a CYCLE clause was given."""


def _key(columns: Sequence[str]) -> Column:
    """The key as one value; null if a part is null."""
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return F.when(known, F.struct(*(F.col(c).alias(f"k{n}") for n, c in enumerate(columns))))


def connect_by(rows: DataFrame, key: list[str], parent: list[str], start: Column, siblings: Sequence[Column] = (), loops: str = "error", keep: Column | None = None, max_level: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Every visit of the walk: the columns of rows, level (from 1), root and path (keys as structs; of its first row, and of all down to it), is_leaf, is_cycle, sibling_order, and path_<c> for each carried column.

    key: what rows are known by; parent: the columns, in the same order, with the key of a row's parent; start: START WITH.
    A row that several paths reach is visited on each. keep: a condition on children, besides; max_level: the last level.

    loops, for a child that stands on its own path already: "error" raises ConnectByLoop; "nocycle" leaves the child out, and
    is_cycle marks the row above it; "mark", the CYCLE clause of a recursive WITH, visits it once more, with is_cycle, and goes
    no further. is_leaf: the walk went no further from this visit.

    siblings: ORDER SIBLINGS BY of the starting rows and of each parent's children, ties by key, equal keys in any order.
    sibling_order sorts visits depth first. carry: columns whose values along the path are collected, for SYS_CONNECT_BY_PATH.
    A null in a key or parent links to nothing, but a starting row may have them. No starting rows: no visits.
    """
    if loops not in ("error", "nocycle", "mark"):
        raise ValueError("loops: error, nocycle or mark")
    columns, extra = rows.columns, [f"path_{c}" for c in carry]
    if clash := {*ADDED, *extra} & set(columns):
        raise ValueError(f"columns that the walk adds: {sorted(clash)}")
    spark, dir_ = rows.sparkSession, new_dir(rows.sparkSession, "walk")
    order = [*siblings, *(F.asc(k) for k in key)]
    starting = running(rows.where(F.coalesce(start, F.lit(False))), [], order, out="_rank")
    below = rows.where(_key(parent).isNotNull() & F.coalesce(keep if keep is not None else F.lit(True), F.lit(False)))
    packed = lambda df: df.select(F.struct(*columns).alias("row"), _key(key).alias("key"), _key(parent).alias("of"), "_rank", *(F.col(c).alias(f"_{e}") for c, e in zip(carry, extra, strict=True)))
    children = kept(packed(running(below, parent, order, out="_rank")))
    visit = ["row", "level", "root", "path", "is_cycle", "sibling_order", *extra]
    level = packed(starting).select("row", F.lit(1).alias("level"), F.col("key").alias("root"), F.array("key").alias("path"), F.lit(False).alias("is_cycle"), F.array("_rank").alias("sibling_order"), *(F.array(f"_{e}").alias(e) for e in extra))
    levels, closed, n = [], [], 1
    while True:
        level.write.parquet(f"{dir_}/level-{n}")
        level = spark.read.schema(level.schema).parquet(f"{dir_}/level-{n}")
        levels.append(f"{dir_}/level-{n}")
        if level.isEmpty() or n == max_level:
            break
        above = level.where("not is_cycle").select("root", "path", "sibling_order", *extra, F.element_at("path", -1).alias("of"), "level")
        found = children.join(above, "of").select("row", (F.col("level") + 1).alias("level"), "root", F.array_append("path", F.col("key")).alias("path"), F.coalesce(F.array_contains("path", F.col("key")), F.lit(False)).alias("is_cycle"), F.array_append("sibling_order", F.col("_rank")).alias("sibling_order"), *(F.array_append(e, F.col(f"_{e}")).alias(e) for e in extra))
        if loops != "mark":
            loop = kept(found.where("is_cycle").select("sibling_order"))
            if loops == "error" and not loop.isEmpty():
                raise ConnectByLoop("CONNECT BY loop in the rows")
            closed.append(loop)
            found = found.where("not is_cycle")
        level, n = found.select(*visit), n + 1
    visits = spark.read.schema(level.schema).parquet(*levels)
    drop(children)
    up = lambda df: df.select(F.slice("sibling_order", 1, F.size("sibling_order") - 1).alias("sibling_order")).distinct()
    out = visits.join(up(visits.where("level > 1")).withColumn("_inner", F.lit(True)), "sibling_order", "left")
    if loops == "nocycle" and closed:
        ends = closed[0]
        for c in closed[1:]:
            ends = ends.unionByName(c)
        out = out.drop("is_cycle").join(up(ends).withColumn("is_cycle", F.lit(True)), "sibling_order", "left").withColumn("is_cycle", F.coalesce("is_cycle", F.lit(False)))
    return out.withColumn("is_leaf", F.col("_inner").isNull()).select("row.*", *ADDED, *extra)


def searched(visits: DataFrame, breadth: bool = False, out: str = "seq") -> DataFrame:
    """visits with out: their place (from 1) in a depth-first search, or in a breadth-first one: the SEARCH clause."""
    order = [F.asc("level"), F.asc("sibling_order")] if breadth else [F.asc("sibling_order")]
    return running(visits, [], order, out=out).withColumn(out, F.col(out) + 1)


def path_text(carried: str, separator: str = "/") -> Column:
    """SYS_CONNECT_BY_PATH of a carried column: each value with the separator before it; a null is empty."""
    return F.array_join(F.transform(f"path_{carried}", lambda x: F.concat(F.lit(separator), F.coalesce(x.cast("string"), F.lit("")))), "")
