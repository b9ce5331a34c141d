"""Multiset operators on arrays, by runs of sorted elements: UNION, EXCEPT, INTERSECT (ALL and DISTINCT), SUBMULTISET, SET and others.

Both arrays are sorted together once, with the side that each element is of; runs of equal elements then give how often it
stands on either side. All of it is higher-order functions: linear after the sort, in generated code, without explode.
Null elements are equal to each other. A null array makes the result null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _runs(ordered: Column) -> Column:
    """Of a sorted array that isn't empty: array of (v, n), the elements and how often they stand."""
    differs = lambda i: (i == 0) | ~F.get(ordered, i).eqNullSafe(F.get(ordered, F.greatest(i - 1, F.lit(0))))
    starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), differs)
    return _let(starts, lambda at: F.transform(at, lambda p, k: F.struct(F.get(ordered, p).alias("v"), (F.when(k + 1 < F.size(at), F.get(at, k + 1)).otherwise(F.size(ordered)) - p).alias("n"))))


def bag(a: str | Column) -> Column:
    """An array as sorted (v, n): each different element and how often it stands; nulls last."""
    c = F.col(a) if isinstance(a, str) else a
    return _let(F.array_sort(c), lambda s: F.when(F.size(s) > 0, _runs(s)).otherwise(F.when(s.isNotNull(), F.filter(_runs(s), lambda _: F.lit(False)))))


def both(a: str | Column, b: str | Column) -> Column:
    """(v, a, b) for each element that stands in either array: how often in the one and in the other."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    sided = lambda c, s: F.transform(c, lambda v: F.struct(v.isNull().alias("none"), v.alias("v"), F.lit(s).alias("side")))

    def counted(s: Column) -> Column:
        def merged(runs: Column) -> Column:
            of = lambda i: F.get(runs, i)
            alike = lambda i, j: of(i)["v"]["none"].eqNullSafe(of(j)["v"]["none"]) & of(i)["v"]["v"].eqNullSafe(of(j)["v"]["v"])
            heads = F.filter(F.sequence(F.lit(0), F.size(runs) - 1), lambda i: (i == 0) | ~alike(i, F.greatest(i - 1, F.lit(0))))

            def one(i: Column) -> Column:
                second = (i + 1 < F.size(runs)) & alike(i, F.least(i + 1, F.size(runs) - 1))
                first_side = of(i)["v"]["side"] == 0
                n = of(i)["n"]
                in_a = F.when(first_side, n).otherwise(0)
                in_b = F.when(~first_side, n).when(second, of(i + 1)["n"]).otherwise(0)
                return F.struct(of(i)["v"]["v"].alias("v"), in_a.alias("a"), in_b.alias("b"))

            return F.transform(heads, one)

        found = _let(_runs(s), merged)
        return F.when(F.size(s) > 0, found).otherwise(F.when(s.isNotNull(), F.filter(found, lambda _: F.lit(False))))

    return _let(F.array_sort(F.concat(sided(x, 0), sided(y, 1))), counted)


def _repeated(a: str | Column, b: str | Column, many: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(both(a, b), lambda e: F.array_repeat(e["v"], many(e).cast("int"))))


def multiset_union(a: str | Column, b: str | Column, distinct: bool = False) -> Column:
    return _repeated(a, b, (lambda e: F.lit(1)) if distinct else (lambda e: e["a"] + e["b"]))


def multiset_except(a: str | Column, b: str | Column, distinct: bool = False) -> Column:
    """Of a as often as b lacks it; distinct: once what b doesn't have at all."""
    return _repeated(a, b, (lambda e: (e["b"] == 0).cast("int")) if distinct else (lambda e: F.greatest(e["a"] - e["b"], F.lit(0))))


def multiset_intersect(a: str | Column, b: str | Column, distinct: bool = False) -> Column:
    return _repeated(a, b, (lambda e: F.least(e["a"], e["b"], F.lit(1))) if distinct else (lambda e: F.least(e["a"], e["b"])))


def submultiset(a: str | Column, b: str | Column) -> Column:
    """Whether b has each element of a as often at least."""
    return F.forall(both(a, b), lambda e: e["a"] <= e["b"])


def equal(a: str | Column, b: str | Column) -> Column:
    return F.forall(both(a, b), lambda e: e["a"] == e["b"])


def set_of(a: str | Column) -> Column:
    """Each different element once, sorted."""
    return F.transform(bag(a), lambda e: e["v"])


def is_a_set(a: str | Column) -> Column:
    return F.forall(bag(a), lambda e: e["n"] == 1)


def cardinality(a: str | Column) -> Column:
    """How many elements; null for a null array."""
    c = F.col(a) if isinstance(a, str) else a
    return F.when(c.isNotNull(), F.size(c))


def collected(df: DataFrame, by: list[str], value: str, out: str = "bag") -> DataFrame:
    """COLLECT as a bag: by, and sorted (v, n) of each group's values, counted before they come together. A group's different values must fit one row."""
    counted = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("_v").isNull().alias("none"), F.col("_v").alias("v"), F.col("_n").cast("int").alias("n"))))
    return counted.groupBy(*by).agg(F.transform(entries, lambda e: F.struct(e["v"].alias("v"), e["n"].alias("n"))).alias(out))
