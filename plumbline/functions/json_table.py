"""JSON_TABLE: rows and columns of JSON documents by paths, with nested paths, ordinals and defaults, in one pass.

A document is parsed once, into a variant. The columns compile to one expression that makes the array of all rows of a
document, nested paths included, which is exploded once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP = re.compile(r"""\.(?:(?P<name>[A-Za-z_]\w*)|"(?P<quoted>[^"]*)")|\[(?P<index>\d+)\]|\[(?P<all>\*)\]""")


@dataclass
class Value:
    """A column of a path's value. type: a type, or "json" for the text of any JSON (FORMAT JSON).

    on_empty and on_error: what stands for a missing value, or one that the type can't hold: a value, None, or ERROR. A JSON null is null.
    """

    name: str
    path: str
    type: str = "string"
    on_empty: object = None
    on_error: object = None


@dataclass
class Exists:
    """Whether a path leads to anything, a JSON null included."""

    name: str
    path: str


@dataclass
class Ordinal:
    """FOR ORDINALITY: the number (from 1) of the row among its parent's."""

    name: str


@dataclass
class Nested:
    """NESTED PATH: rows below each row, which stands once with nulls if there are none. Rows of several nested paths stand one after the other, each with nulls in the others' columns."""

    path: str
    columns: Sequence[Value | Exists | Ordinal | Nested]


ERROR = object()


def steps(path: str) -> list[str | int | None]:
    """A path's steps: names, positions, and None for all elements."""
    if not path.startswith("$"):
        raise ValueError(f"a path begins with $: {path}")
    out: list[str | int | None] = []
    at = 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"cannot read the path from here: {path[at:]}")
        out.append(None if m["all"] else int(m["index"]) if m["index"] is not None else m["name"] if m["name"] is not None else m["quoted"])
        at = m.end()
    return out


def _text(found: Sequence[str | int]) -> str:
    if any(isinstance(s, str) and ("'" in s or "\\" in s) for s in found):
        raise ValueError("a name holds a quote or a backslash")
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in found)


def _one(v: Column, path: str) -> Column:
    """The variant that a path without wildcards leads to, or null."""
    found = steps(path)
    if None in found:
        raise ValueError(f"a column's path leads to one value: {path}")
    return F.try_variant_get(v, _text(found), "variant") if found else v


def _matches(v: Column, path: str) -> Column:
    """All variants that a path leads to, in order; an object where an array is asked for is its one element."""
    known = lambda found: F.filter(found, lambda x: x.isNotNull())
    out, plain = known(F.array(v)), []

    def walked(found: Column, names: list[str | int]) -> Column:
        return known(F.transform(found, lambda x: F.try_variant_get(x, _text(names), "variant"))) if names else found

    for s in steps(path):
        if s is not None:
            plain.append(s)
            continue
        out, plain = F.flatten(F.transform(walked(out, plain), lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x)))), []
    return walked(out, plain)


def _fields(columns: Sequence) -> list[tuple[str, str]]:  # noqa: ANN401
    out: list[tuple[str, str]] = []
    for c in columns:
        if isinstance(c, Nested):
            out += _fields(c.columns)
        else:
            out.append((c.name, "int" if isinstance(c, Ordinal) else "boolean" if isinstance(c, Exists) else "string" if c.type == "json" else c.type))
    return out


def _value(c: Value, v: Column) -> Column:
    kind = "string" if c.type == "json" else c.type
    found = _one(v, c.path)
    made = lambda what, default: F.raise_error(F.lit(f"JSON_TABLE column {c.name}: {what}")).cast(kind) if default is ERROR else F.lit(default).cast(kind)

    def of(x: Column) -> Column:
        value = F.to_json(x) if c.type == "json" else F.try_variant_get(x, "$", kind)
        value = value if c.type != "string" else F.coalesce(value, F.to_json(x))
        return F.when(x.isNull(), made("no value", c.on_empty)).when(F.is_variant_null(x), F.lit(None).cast(kind)).when(value.isNull(), made("the type can't hold the value", c.on_error)).otherwise(value)

    return F.element_at(F.transform(F.array(found), of), 1)


def _rows(columns: Sequence, v: Column, number: Column, fields: list[tuple[str, str]]) -> Column:  # noqa: ANN401
    """The rows (structs of all fields) that one match makes."""
    own: dict[str, Column] = {}
    for c in columns:
        if isinstance(c, Value):
            own[c.name] = _value(c, v)
        elif isinstance(c, Exists):
            own[c.name] = _one(v, c.path).isNotNull()
        elif isinstance(c, Ordinal):
            own[c.name] = number
    parts = [_made(c.columns, v, c.path, fields) for c in columns if isinstance(c, Nested)]
    mine = F.struct(*(own[n].cast(k).alias(n) for n, k in fields if n in own), F.lit(0).alias("_"))

    def joined(o: Column) -> Column:  # the row's own columns are computed once, not for each row below
        with_own = lambda r: F.struct(*((o[n] if n in own else r[n] if r is not None else F.lit(None).cast(k)).alias(n) for n, k in fields))
        if not parts:
            return F.array(with_own(None))
        below = parts[0] if len(parts) == 1 else F.concat(*parts)
        return F.element_at(F.transform(F.array(below), lambda b: F.when(F.size(b) > 0, F.transform(b, with_own)).otherwise(F.array(with_own(None)))), 1)

    return F.element_at(F.transform(F.array(mine), joined), 1)


def _made(columns: Sequence, v: Column, path: str, fields: list[tuple[str, str]]) -> Column:  # noqa: ANN401
    return F.flatten(F.transform(_matches(v, path), lambda m, i: _rows(columns, m, (i + 1).cast("int"), fields)))


def json_table(df: DataFrame, document: str, path: str, columns: Sequence[Value | Exists | Ordinal | Nested], outer: bool = False) -> DataFrame:
    """df with a row for each match of a path in its document, and the columns made of it.

    A null document, one that is no JSON, and one without matches have no rows; with outer one, with nulls. Paths: $, .name,
    ."any name", [position], [*].
    """
    fields = _fields(columns)
    names = [n for n, _ in fields]
    if len({*names, *df.columns}) < len(names) + len(df.columns):
        raise ValueError("two columns of one name")
    parsed = df.withColumn("_json", F.try_parse_json(F.col(document)))
    rows = parsed.withColumn("_rows", _made(columns, F.col("_json"), path, fields)).drop("_json")
    return rows.withColumn("_row", (F.explode_outer if outer else F.explode)("_rows")).select(*df.columns, *(F.col(f"_row.{n}").alias(n) for n in names))
