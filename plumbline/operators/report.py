"""Reports of parsed objects as rows of text: fact tables with fitted columns, statement trees, JSON records.

Every object's report is made in Spark, of the arrays in its row: widths are maxima of them, a tree line's lead follows from
whether each of its ancestors is the last of its siblings. Ordered by `at`, an object's lines are its report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import chunks
from plumbline.operators.extract import KEY
from plumbline.sources.shared import kept

NOTHING = "  (no data)"
#: Most statements of an object whose trees are made in its row, where each looks through the others.
FEW = 256
#: The tables of a report: title, nested column, and its columns by heading.
TABLES = (
    ("Call edges", "call_edges", {"CALLER": "caller_subprogram", "CALLEE_SCHEMA": "callee_schema", "CALLEE_OBJECT": "callee_object", "CALLEE_SUBPROGRAM": "callee_subprogram"}),
    ("Table accesses", "table_accesses", {"SUBPROGRAM": "subprogram", "TABLE_SCHEMA": "table_schema", "TABLE_NAME": "table_name", "OPERATION": "operation"}),
    ("Subprograms", "subprograms", {"NAME": "subprogram_name", "TYPE": "subprogram_type", "START_LINE": "start_line", "END_LINE": "end_line"}),
)


def _line(at: Column, line: Column) -> Column:
    return F.struct(at.cast("array<int>").alias("at"), line.alias("line"))


def fitted(rows: DataFrame, name: str, headings: dict[str, str], n: int) -> DataFrame:
    """rows with name, an array of structs, as an array of lines (at, line) of its table, which is none without structs. Columns are as wide as their widest cell or heading."""
    rows = rows.withColumn(name, F.transform(name, lambda x: F.array(*[F.coalesce(x[c].cast("string"), F.lit("")) for c in headings.values()])))
    widest = [F.greatest(F.coalesce(F.array_max(F.transform(name, lambda x: F.length(x[k]))), F.lit(0)), F.lit(len(h))) for k, h in enumerate(headings)]
    rows = rows.withColumn("_wide", F.array(*widest))
    join = lambda make: F.concat_ws("  ", *[make(k, h) for k, h in enumerate(headings)])
    padded = lambda text, k: F.rpad(text, F.col("_wide")[k], F.lit(" "))
    at = lambda i: F.array(F.lit(n), F.lit(2), i)
    top = _line(at(F.lit(-2)), join(lambda k, h: padded(F.lit(h), k)))
    rule = _line(at(F.lit(-1)), join(lambda k, _: F.repeat(F.lit("-"), F.col("_wide")[k])))
    body = F.transform(name, lambda x, i: _line(at(i), join(lambda k, _: padded(x[k], k))))
    return rows.withColumn(name, F.when(F.size(name) > 0, F.concat(F.array(top, rule), body)).otherwise(F.filter(body, lambda _: F.lit(False)))).drop("_wide")


def statement_lines(statements: DataFrame) -> DataFrame:
    """Lines `[seq] TYPE  La-Lb` of each subprogram's statement tree: chunks.SCOPE, path, line. Statements without their parent are roots."""
    scope = chunks.SCOPE
    placed = chunks.tree(statements).withColumn("_parent", F.when(F.size("path") > 1, F.element_at("path", -2)["seq"]))
    last = F.lead("seq").over(W.partitionBy(*scope, "_parent").orderBy("path")).isNull()
    placed = placed.withColumn("_last", last)
    steps = placed.select(*scope, F.col("seq").alias("_seq"), F.posexplode("path").alias("_n", "_step")).select(*scope, "_seq", "_n", F.col("_step.seq").alias("seq"))
    flags = steps.join(placed.select(*scope, "seq", "_last"), [*scope, "seq"]).groupBy(*scope, F.col("_seq").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("_n", "_last"))).alias("_flags"))
    above = F.transform(F.slice("_flags", 1, F.size("_flags") - 1), lambda f: F.when(f["_last"], "    ").otherwise("│   "))
    branch = F.when(F.col("_last"), "└── ").otherwise("├── ")
    text = F.concat(F.lit("  "), F.array_join(above, ""), branch, F.lit("["), "seq", F.lit("] "), "statement_type", F.lit("  L"), "start_line", F.lit("-L"), "end_line")
    return placed.join(flags, [*scope, "seq"]).select(*scope, F.transform("path", lambda p: F.struct(p["position"], p["seq"])).alias("path"), text.alias("line"))


def _title(subprogram: Column) -> Column:
    return F.concat(F.lit("  Subprogram: "), F.when(subprogram == "", "(package-level)").otherwise(subprogram))


def _parents(parsed: DataFrame) -> DataFrame:
    """parsed with substatements that have _up, the place (from 1) of their parent among them or 0, and plain: whether they are few, each known by its seq, and none stands before its parent."""
    keys = F.transform("substatements", lambda x: F.struct(x["subprogram"], x["seq"]))
    up = lambda x: F.when(x["parent_seq"].isNull(), 0).otherwise(F.array_position("_keys", F.struct(x["subprogram"], x["parent_seq"].alias("seq")))).cast("int")
    small = parsed.withColumn("_keys", keys).withColumn("_few", F.size("_keys") <= FEW)
    found = small.withColumn("substatements", F.when(F.col("_few"), F.transform("substatements", lambda x: x.withField("_up", up(x)))).otherwise(F.transform("substatements", lambda x: x.withField("_up", F.lit(0)))))
    late = F.exists(F.transform("substatements", lambda x, i: x["_up"] > i), lambda x: x)
    plain = F.when(F.col("_few"), ~late & (F.size(F.array_distinct("_keys")) == F.size("_keys"))).otherwise(False)
    return found.withColumn("plain", plain).drop("_keys", "_few")


def _plain_trees(parsed: DataFrame, n: int) -> DataFrame:
    """Plain objects with their substatements as the lines (at, line) of their trees: a fold, in which each statement finds its parent done."""
    all_, order = F.col("substatements"), lambda x: F.struct(x["position"], x["seq"])
    later = lambda x: F.exists(all_, lambda y: (y["subprogram"] == x["subprogram"]) & (y["_up"] == x["_up"]) & (order(y) > order(x)))
    parsed = parsed.withColumn("substatements", F.transform(all_, lambda x: x.withField("_last", ~later(x))))
    parsed = parsed.withColumn("_names", F.transform(all_, lambda x: x["subprogram"]))
    group = lambda name: F.array(F.lit(n), F.lit(2), (F.array_position("_names", name) - 1).cast("int"))

    def step(done: Column, x: Column) -> Column:
        at = F.concat(F.coalesce(F.get(done, x["_up"] - 1)["at"], group(x["subprogram"])), F.array(x["position"], x["seq"]))
        lead = F.coalesce(F.get(done, x["_up"] - 1)["lead"], F.lit("  "))
        text = F.concat(lead, F.when(x["_last"], "└── ").otherwise("├── "), F.lit("["), x["seq"], F.lit("] "), x["statement_type"], F.lit("  L"), x["start_line"], F.lit("-L"), x["end_line"])
        return F.array_append(done, F.struct(at.alias("at"), text.alias("line"), F.concat(lead, F.when(x["_last"], "    ").otherwise("│   ")).alias("lead")))

    tree = F.aggregate(all_, F.array().cast("array<struct<at:array<int>,line:string,lead:string>>"), step)
    titles = F.transform(F.array_distinct("_names"), lambda x: _line(group(x), _title(x)))
    return parsed.withColumn("substatements", F.sort_array(F.concat(titles, F.transform(tree, lambda x: _line(x["at"], x["line"]))))).drop("_names")


def _other_trees(parsed: DataFrame, n: int) -> DataFrame:
    """Objects with their substatements as the lines (at, line) of their trees, by joins: for many statements, cycles, and parents that come late."""
    statements = parsed.select(*KEY, F.posexplode("substatements").alias("_n", "_x")).select(*KEY, "_n", "_x.*")
    groups = statements.groupBy(*KEY, "subprogram").agg(F.min("_n").alias("_group"))
    titles = groups.select(*KEY, _line(F.array(F.lit(n), F.lit(2), F.col("_group")), _title(F.col("subprogram"))).alias("_line"))
    tree = statement_lines(statements.drop("_n", "_up")).join(groups, [*KEY, "subprogram"])
    place = F.concat(F.array(F.lit(n), F.lit(2), F.col("_group")), F.flatten(F.transform("path", lambda p: F.array(p["position"], p["seq"]))))
    lines = titles.unionByName(tree.select(*KEY, _line(place, F.col("line")).alias("_line")))
    trees = lines.groupBy(*KEY).agg(F.sort_array(F.collect_list("_line")).alias("substatements"))
    none = F.array().cast("array<struct<at:array<int>,line:string>>")
    return parsed.drop("substatements").join(trees, KEY, "left").withColumn("substatements", F.coalesce("substatements", none))


def reports(parsed: DataFrame) -> DataFrame:
    """Each parsed object's report: KEY, lines (at, line) in order. Subprograms' trees stand in the order of their first statement.

    Parsed objects are stored once, without their texts. The report of an object is made of its row alone, without a
    shuffle; only trees of more than FEW statements, and those not in order, are joined.
    """
    bare = [F.transform(name, lambda x: F.struct(*[x[k].alias(k) for k in headings.values()])).alias(name) for _, name, headings in TABLES]
    names = ("seq", "parent_seq", "position", "statement_type", "start_line", "end_line")
    statements = F.transform("substatements", lambda x: F.struct(F.coalesce(x["subprogram"], F.lit("")).alias("subprogram"), *[x[k].alias(k) for k in names])).alias("substatements")
    parsed = kept(_parents(parsed.select(*KEY, "status", "error_message", *bare, statements)))
    head = F.concat(F.lit("=== Parse Result: "), F.concat_ws(".", "schema_name", "object_name"), F.lit(" ("), "object_type", F.lit(") ==="))
    top = lambda x, y, line: _line(F.array(F.lit(x), F.lit(y)), line)
    parts = [F.array(top(0, 0, head), top(0, 1, F.concat(F.lit("Status: "), "status")), top(0, 2, F.concat(F.lit("Error:  "), "error_message")))]
    for n, (title, name) in enumerate([*[(t, c) for t, c, _ in TABLES], ("Substatements", "substatements")], 1):
        size = F.col(f"_size{n}")
        parts += [F.array(top(n, 0, F.concat(F.lit(f"--- {title} ("), size, F.lit(") ---"))), top(n, 1, F.when(size == 0, NOTHING))), F.col(name)]
        parsed = parsed.withColumn(f"_size{n}", F.size(name))
    for n, (_, name, headings) in enumerate(TABLES, 1):
        parsed = fitted(parsed, name, headings, n)
    n = len(TABLES) + 1
    made, others = _plain_trees(parsed.where("plain"), n), parsed.where("not plain")
    if not others.isEmpty():
        made = made.unionByName(_other_trees(others, n))
    return made.select(*KEY, F.filter(F.concat(*parts), lambda x: x["line"].isNotNull()).alias("lines"))


def report(parsed: DataFrame) -> DataFrame:
    """All lines of each parsed object's report: KEY, at, line."""
    return reports(parsed).select(*KEY, F.inline("lines"))


def json_records(parsed: DataFrame) -> DataFrame:
    """Each parsed object as a JSON text with all its keys, nulls included: KEY, record."""
    return parsed.select(*KEY, F.to_json(F.struct(*[c for c in parsed.columns if c != "source_hash"]), {"ignoreNullFields": "false"}).alias("record"))
