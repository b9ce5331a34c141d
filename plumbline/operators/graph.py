"""Dependency trees over call edges: a level at a time, cycle-safe along each path, with a depth limit. Levels are written to the shared folder; nothing is cached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.store import Store
from plumbline.sources.shared import drop, kept

VISIT = "root string, schema_name string, object_name string, subprogram string, depth int, path array<string>, ord array<string>, status string, object_type string"


def _label(schema, obj, sub):  # noqa: ANN001, ANN202
    return F.concat_ws(".", schema, obj, F.coalesce(sub, F.lit("")))


def dependency_tree(roots: DataFrame, edges: DataFrame, info: DataFrame, max_depth: int | None = None) -> DataFrame:
    """A row for each visit: root, schema_name, object_name, subprogram, depth, path, ord, status, object_type.

    roots: schema_name, object_name, subprogram (may be null). A visit is a cycle if its node stands on its own
    path already, else missing if it is no object, else it has its object's status; only ok nodes above the
    depth limit are expanded. Nodes that several paths reach are visited on each. Siblings are in the order of
    ord: the callee's schema, object and subprogram.
    """
    node = _label(F.col("schema_name"), F.col("object_name"), F.col("subprogram"))
    level = roots.select(node.alias("root"), F.upper("schema_name").alias("schema_name"), F.upper("object_name").alias("object_name"), "subprogram", F.lit(0).alias("depth"), F.array().cast("array<string>").alias("path"), F.array().cast("array<string>").alias("ord"))
    calls = edges.select("caller_schema", "caller_object", "caller_subprogram", F.coalesce(F.nullif("callee_schema", F.lit("")), "caller_schema").alias("callee_schema"), "callee_object", "callee_subprogram").distinct()
    kinds = info.select("schema_name", "object_name", "object_type", F.col("status").alias("found"))
    calls, kinds = kept(calls), kept(kinds)  # read at every level
    visits: DataFrame | None = None
    depth = 0
    while True:
        status = F.when(F.array_contains("path", node), "cycle").when(F.col("found").isNull(), "missing").otherwise(F.col("found"))
        seen = level.join(kinds, ["object_name", "schema_name"], "left").withColumn("status", status).drop("found")
        seen = kept(seen)
        visits = seen if visits is None else visits.unionByName(seen)
        open_ = seen.where("status = 'ok'")
        if (max_depth is not None and depth >= max_depth) or open_.isEmpty():
            drop(calls, kinds)
            return visits
        same = (F.col("v.object_name") == F.col("e.caller_object")) & (F.col("v.schema_name") == F.col("e.caller_schema")) & F.upper("v.subprogram").eqNullSafe(F.upper("e.caller_subprogram"))
        below = _label(F.col("callee_schema"), F.col("callee_object"), F.col("callee_subprogram"))
        level = open_.alias("v").join(calls.alias("e"), same).select(
            "root", F.col("callee_schema").alias("schema_name"), F.col("callee_object").alias("object_name"), F.col("callee_subprogram").alias("subprogram"), (F.col("depth") + 1).alias("depth"),
            F.array_append("path", _label(F.col("v.schema_name"), F.col("v.object_name"), F.col("v.subprogram"))).alias("path"), F.array_append("ord", below).alias("ord"),
        )
        depth += 1


def with_accesses(visits: DataFrame, accesses: DataFrame) -> DataFrame:
    """Visits with their table accesses as sorted `TABLE operation` texts; stubs have none."""
    mine = accesses.groupBy(F.col("schema_name"), F.col("object_name"), F.upper(F.coalesce("subprogram", F.lit(""))).alias("_sub")).agg(F.array_sort(F.collect_set(F.concat_ws(" ", F.concat_ws(".", "table_schema", "table_name"), "operation"))).alias("tables"))
    joined = visits.withColumn("_sub", F.upper(F.coalesce("subprogram", F.lit("")))).join(mine, ["schema_name", "object_name", "_sub"], "left").drop("_sub")
    return joined.withColumn("tables", F.when(F.col("status") == "ok", F.coalesce("tables", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))


def reach(roots: DataFrame, edges: DataFrame, info: DataFrame) -> DataFrame:
    """Distinct nodes that a root reaches, with status and smallest depth: what a summary visits once.

    Breadth first: a node that a root has visited is not expanded again, so shared subtrees cost one visit each.
    """
    key = ["object_name", "root", "schema_name", "_sub"]  # names first: joins sort by them, and schemas are mostly the same
    sub = F.upper(F.coalesce("subprogram", F.lit("")))
    root = _label(F.col("schema_name"), F.col("object_name"), F.col("subprogram"))
    calls = kept(edges.select("caller_schema", "caller_object", F.upper(F.coalesce("caller_subprogram", F.lit(""))).alias("_sub"), F.coalesce(F.nullif("callee_schema", F.lit("")), "caller_schema").alias("to_schema"), "callee_object", "callee_subprogram").distinct())
    kinds = kept(info.select("schema_name", "object_name", "object_type", F.col("status").alias("found")))
    level = roots.select(root.alias("root"), F.upper("schema_name").alias("schema_name"), F.upper("object_name").alias("object_name"), "subprogram", sub.alias("_sub"), F.lit(0).alias("depth"))
    visited: DataFrame | None = None
    while True:
        new = level.dropDuplicates(key)
        new = new if visited is None else new.join(visited.select(*key), key, "left_anti")
        new = new.join(kinds, ["object_name", "schema_name"], "left").withColumn("status", F.coalesce("found", F.lit("missing"))).drop("found")
        new = kept(new)
        if visited is not None and new.isEmpty():
            drop(calls, kinds)
            return visited.drop("_sub")
        visited = new if visited is None else visited.unionByName(new)
        same = (F.col("v.object_name") == F.col("e.caller_object")) & (F.col("v.schema_name") == F.col("e.caller_schema")) & (F.col("v._sub") == F.col("e._sub"))
        level = new.where("status = 'ok'").alias("v").join(calls.alias("e"), same).select(
            "root", F.col("to_schema").alias("schema_name"), F.col("callee_object").alias("object_name"), F.col("callee_subprogram").alias("subprogram"),
            F.upper(F.coalesce("callee_subprogram", F.lit(""))).alias("_sub"), (F.col("depth") + 1).alias("depth"),
        )


def rendered(visits: DataFrame) -> DataFrame:
    """The trees of all roots as text: root, at, line. Ordered by root and at, the lines are what render() prints of each root.

    A line's lead follows from whether each of its ancestors is the last of its siblings, so it is a join of visits
    with the visits above them, and no tree comes together in one task. Tables stand before calls.
    """
    none = F.array().cast("array<string>")
    v = visits.withColumn("tables", F.col("tables")) if "tables" in visits.columns else visits.withColumn("tables", none)
    parent = F.slice("ord", 1, F.greatest(F.col("depth") - 1, F.lit(0)))
    label = F.concat("object_name", F.coalesce(F.concat(F.lit("."), F.nullif("subprogram", F.lit(""))), F.lit("")), F.coalesce(F.concat(F.lit(" ("), "object_type", F.lit(")")), F.lit("")), F.when(F.col("status") != "ok", F.concat(F.lit(" ["), "status", F.lit("]"))).otherwise(""))
    v = v.select("root", "depth", "ord", "tables", parent.alias("parent"), label.alias("label"))
    last = v.where("depth > 0").groupBy("root", "parent").agg(F.max("ord").alias("last"))
    ends = v.where("depth > 0").join(last, ["root", "parent"]).select("root", "ord", (F.col("ord") == F.col("last")).alias("is_last"))
    has_calls = last.select("root", F.col("parent").alias("ord"), F.lit(True).alias("calls"))
    ups = v.where("depth > 0").select("root", "ord", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("ord")), lambda n: F.slice("ord", 1, n))).alias("n", "up"))
    flags = ups.join(ends.withColumnRenamed("ord", "up"), ["root", "up"]).groupBy("root", "ord").agg(F.array_sort(F.collect_list(F.struct("n", "is_last"))).alias("flags"))
    lead = lambda flags: F.array_join(F.transform(flags, lambda f: F.when(f["is_last"], "    ").otherwise("│   ")), "")
    stick = lambda is_last: F.when(is_last, "└── ").otherwise("├── ")
    full = v.join(flags, ["root", "ord"], "left").join(has_calls, ["root", "ord"], "left")
    above = F.concat(F.lit("    "), lead(F.slice("flags", 1, F.size("flags") - 1)), stick(F.element_at("flags", -1)["is_last"]))
    lines = full.select("root", F.transform("ord", lambda x: F.concat(F.lit("1"), x)).alias("at"), F.concat(F.when(F.col("depth") > 0, above).otherwise(""), "label").alias("line"))
    below = F.concat(F.lit("    "), F.when(F.col("depth") > 0, lead(F.col("flags"))).otherwise(""))
    leaves = full.select("root", "ord", "calls", below.alias("below"), F.size("tables").alias("many"), F.posexplode("tables").alias("n", "name"))
    ends_here = (F.col("n") == F.col("many") - 1) & F.col("calls").isNull()
    leaves = leaves.select("root", F.concat(F.transform("ord", lambda x: F.concat(F.lit("1"), x)), F.array(F.concat(F.lit("0"), F.lpad(F.col("n").cast("string"), 9, "0")))).alias("at"), F.concat("below", stick(ends_here), F.lit("TABLE "), "name").alias("line"))
    return lines.unionByName(leaves)


def render(visits: DataFrame) -> list[str]:
    """One tree as text lines: tables stand before calls. The visits of one root come to the driver, which prints them."""
    rows = sorted(visits.collect(), key=lambda r: [x or "" for x in r["ord"]])
    kids: dict[tuple, list] = {}
    for r in rows:
        if r["depth"]:
            kids.setdefault(tuple(r["ord"][:-1]), []).append(r)
    out: list[str] = []

    def label(r) -> str:  # noqa: ANN001
        name = r["object_name"] + (f".{r['subprogram']}" if r["subprogram"] else "")
        return name + (f" ({r['object_type']})" if r["object_type"] else "") + (f" [{r['status']}]" if r["status"] != "ok" else "")

    def below(r, lead: str) -> None:  # noqa: ANN001
        leaves = [(f"TABLE {t}", None) for t in (r["tables"] if "tables" in r else [])]
        items = leaves + [(label(k), k) for k in kids.get(tuple(r["ord"]), [])]
        for n, (text, kid) in enumerate(items):
            last = n == len(items) - 1
            out.append(f"{lead}{'└── ' if last else '├── '}{text}")
            if kid is not None:
                below(kid, lead + ("    " if last else "│   "))

    for r in (r for r in rows if not r["depth"]):
        out.append(label(r))
        below(r, "    ")
    return out


def explain(store: Store, schema: str, obj: str, subprogram: str | None = None, max_depth: int | None = None) -> DataFrame:
    """The visits of one stored object, with accesses."""
    from plumbline.operators.store import object_info

    roots = store.spark.createDataFrame([(schema.upper(), obj.upper(), subprogram)], "schema_name string, object_name string, subprogram string")
    info = object_info(store.read("object_source"), store.read("parse_result"))
    return with_accesses(dependency_tree(roots, store.read("call_edge"), info, max_depth), store.read("table_access"))
