"""Partitioned outer joins: every point of a dimension for every key that has facts, with values carried over gaps.

A key's points with facts are put in order; between two of them lies a gap of known length, which becomes its missing
points. So rows are made only for keys that there are, and a gap's values come from the point before it, without a
window over what was filled in. A key has at most as many points as the dimension.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.order_stats import running
from plumbline.sources.shared import kept


def partitioned_outer_join(facts: DataFrame, by: list[str], on: str, dimension: DataFrame, carry: bool = False, order: Sequence[Column] = ()) -> DataFrame:
    """facts PARTITION BY (by) RIGHT OUTER JOIN dimension USING (on): by, on, the other columns of facts and of dimension, is_filled.

    Each key of facts, a null one too, gets all points of the dimension: its facts there, or one row with nulls and
    is_filled. Facts at no point (a null is none) are left out, and keys with such facts only have filled rows. With carry a
    filled row has the values of the last fact before it: at the last point before with facts, the last by order, ties by the
    greatest row. on is unique in dimension: of a repeated point the greatest row counts. An empty dimension: no rows.
    """
    values, more = [c for c in facts.columns if c not in (*by, on)], [c for c in dimension.columns if c != on]
    if clash := {"is_filled"} & {*facts.columns, *more} | set(more) & set(facts.columns):
        raise ValueError(f"columns of both sides, or that this adds: {sorted(clash)}")
    points = dimension.where(F.col(on).isNotNull()).groupBy(on).agg(F.max(F.struct(*more)).alias("_more") if more else F.lit(0).alias("_more"))
    points = kept(running(points, [], [F.asc(on)], out="_at"))
    last_of_all = points.agg(F.max("_at")).first()[0]
    if last_of_all is None:
        return facts.select(*by, on, *values).withColumns({c: F.lit(None).cast(dimension.schema[c].dataType) for c in more}).withColumn("is_filled", F.lit(False)).limit(0)
    placed = facts.join(points.select(on, "_at"), on, "left")
    rank = F.struct(*(F.struct(c) for c in order), *values) if order or values else F.lit(0)
    last = F.max(F.when(F.col("_at").isNotNull(), rank))
    # a key's points with facts, and the place before the first one, from which nothing is carried
    held = placed.where("_at is not null").groupBy(*by, "_at").agg(last.alias("_last"))
    keys = facts.select(*by).distinct()
    start = keys.withColumn("_at", F.lit(-1).cast("long")).withColumn("_last", F.lit(None).cast(held.schema["_last"].dataType))
    following = F.coalesce(F.lead("_at").over(W.partitionBy(*by).orderBy("_at")), F.lit(last_of_all + 1))
    gaps = held.unionByName(start).withColumn("_next", following).where("_next > _at + 1")
    filled = gaps.withColumn("_at", F.explode(F.sequence(F.col("_at") + 1, F.col("_next") - 1)))
    value = lambda c: F.col(f"_last.{c}") if carry else F.lit(None).cast(facts.schema[c].dataType)
    filled = filled.select(*by, "_at", *(value(c).alias(c) for c in values), F.lit(True).alias("is_filled"))
    both = placed.where("_at is not null").select(*by, "_at", *values, F.lit(False).alias("is_filled")).unionByName(filled)
    return both.join(points, "_at").select(*by, on, *values, *(F.col(f"_more.{c}").alias(c) for c in more), "is_filled")
