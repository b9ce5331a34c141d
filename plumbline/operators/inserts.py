"""INSERT ALL and INSERT FIRST: one scan routed to several targets and an error table, with a reject limit and RETURNING.

Each row becomes an array of what it adds to each target, which is exploded and written by target in one job without a
shuffle. What a target can't take is written beside them as an error. Counts, the reject limit and returned aggregates
are observed while the job writes, so nothing is read twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from plumbline.sources.shared import new_dir

ERRORS = "target string, error string, tag string, given map<string,string>"


@dataclass
class Target:
    """One INTO: a target's name, and for each of its columns the value and the type to convert it to.

    required: columns that must not be null; checks: conditions by name, functions of the target's row (a struct), which must not be false.
    """

    name: str
    columns: dict[str, tuple[Column, str]]
    required: Sequence[str] = ()
    checks: dict[str, Callable[[Column], Column]] = field(default_factory=dict)


@dataclass
class Inserted:
    """What an insert wrote: rows by target, errors, row counts by target, and what it returns."""

    tables: dict[str, DataFrame]
    errors: DataFrame
    counts: dict[str, int]
    rejected: int
    returned: dict[str, object]


class RejectLimit(ValueError):
    """More rows were rejected than the limit allows; errors: the rejected ones. No target has got any row."""

    def __init__(self, rejected: int, limit: int, errors: DataFrame):
        super().__init__(f"{rejected} rows were rejected, {limit} may be")
        self.errors = errors


def routed(rows: DataFrame, branches: Sequence[tuple[Column | None, Sequence[Target]]], otherwise: Sequence[Target] = (), first: bool = False, tag: str | None = None) -> DataFrame:
    """What each row adds where: _target (the INTO's number, -1 for an error), _rejected (ERRORS), and t0, t1 ..., the row for each INTO.

    A branch without a condition takes all rows; an unknown condition does not hold; otherwise: ELSE. With first only a
    row's first branch that holds counts.
    """
    holds = [F.lit(True) if when is None else F.coalesce(when, F.lit(False)) for when, _ in branches]
    goes: list[tuple[Column, Target]] = []
    none = F.lit(True)
    for (_, into), h in zip(branches, holds, strict=True):
        goes += [((h & none) if first else h, t) for t in into]
        none = none & ~h
    goes += [(none, t) for t in otherwise]
    kinds = [f"struct<{', '.join(f'`{c}`: {kind}' for c, (_, kind) in t.columns.items())}>" for _, t in goes]
    entry = "struct<_target: int, _rejected: struct<target: string, error: string, tag: string, given: map<string,string>>, " + ", ".join(f"t{n}: {k}" for n, k in enumerate(kinds)) + ">"

    def put(n: int, t: Target) -> Column:
        given = {c: v for c, (v, _) in t.columns.items()}
        taken = F.struct(*(v.try_cast(kind).alias(c) for c, (v, kind) in t.columns.items()))

        def entry_of(row: Column) -> Column:
            error = F.lit(None).cast("string")
            for name, check in reversed(list(t.checks.items())):
                error = F.when(~F.coalesce(check(row), F.lit(True)), f"check:{name}").otherwise(error)
            for c in reversed(list(t.required)):
                error = F.when(row[c].isNull(), f"required:{c}").otherwise(error)
            for c, v in reversed(list(given.items())):
                error = F.when(v.isNotNull() & row[c].isNull(), f"conversion:{c}").otherwise(error)
            bad = F.struct(F.lit(t.name).alias("target"), error.alias("error"), F.lit(tag).cast("string").alias("tag"), F.create_map(*(x for c, v in given.items() for x in (F.lit(c), v.cast("string")))).alias("given"))
            nulls = [F.lit(None).cast(k).alias(f"t{m}") for m, k in enumerate(kinds)]
            good = [row.cast(kinds[n]).alias(f"t{n}") if m == n else x for m, x in enumerate(nulls)]
            accepted = F.struct(F.lit(n).alias("_target"), F.lit(None).cast("struct<target: string, error: string, tag: string, given: map<string,string>>").alias("_rejected"), *good)
            return F.when(error.isNull(), accepted.cast(entry)).otherwise(F.struct(F.lit(-1).alias("_target"), bad.alias("_rejected"), *nulls).cast(entry))

        return F.element_at(F.transform(F.array(taken), entry_of), 1)  # the converted row is made once

    entries = F.array(*(F.when(g, put(n, t)) for n, (g, t) in enumerate(goes)))
    return rows.select(F.explode(F.filter(entries, lambda x: x.isNotNull())).alias("x")).select("x.*")


def insert_all(rows: DataFrame, branches: Sequence[tuple[Column | None, Sequence[Target]]], otherwise: Sequence[Target] = (), first: bool = False, tag: str | None = None, reject_limit: int | None = 0, returning: dict[str, tuple[str, Callable[[Column], Column]]] | None = None) -> Inserted:
    """Route rows to targets and log what they can't take.

    A value that is not null and can't be converted, a required column that is null, and a check that is false reject a
    row from that target only; the first of them, in this order, is its error. More than reject_limit rejected rows (None: no
    limit) raise RejectLimit, and no target has got any row. returning: aggregates of what was inserted, by name: the
    target, and a function from its row (a struct) to an aggregate that is to skip nulls. Targets of one name are one table.
    No rows: empty tables, aggregates of nothing.
    """
    spark, path = rows.sparkSession, new_dir(rows.sparkSession, "insert")
    targets = [t for _, into in branches for t in into] + list(otherwise)
    out = routed(rows, branches, otherwise, first, tag)
    asked = returning or {}
    values = [made(F.col(f"t{n}")).alias(f"r_{name}_{n}") for name, (where, made) in asked.items() for n, t in enumerate(targets) if t.name == where]
    seen = Observation()
    counts = [F.count_if(F.col("_target") == n - 1).alias(f"n{n}") for n in range(len(targets) + 1)]
    out.observe(seen, *counts, *values).write.partitionBy("_target").parquet(path)
    got = seen.get
    rejected = got["n0"]
    schema = out.schema
    # what was written is listed by its columns: a target without rows has no folder
    written = spark.read.schema(schema).parquet(path) if sum(got[f"n{n}"] for n in range(len(targets) + 1)) else spark.createDataFrame([], schema)
    errors = written.where("_target = -1").select("_rejected.*")
    if reject_limit is not None and rejected > reject_limit:
        raise RejectLimit(rejected, reject_limit, errors)
    tables: dict[str, DataFrame] = {}
    total: dict[str, int] = {}
    for n, t in enumerate(targets):
        df = written.where(F.col("_target") == n).select(f"t{n}.*")
        tables[t.name] = tables[t.name].unionByName(df) if t.name in tables else df
        total[t.name] = total.get(t.name, 0) + got[f"n{n + 1}"]
    returned = {name: [got[f"r_{name}_{n}"] for n, t in enumerate(targets) if t.name == where] for name, (where, _) in asked.items()}
    return Inserted(tables, errors, total, rejected, {k: v[0] if len(v) == 1 else v for k, v in returned.items()})
