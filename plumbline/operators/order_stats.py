"""Exact order statistics by range partitions with carried counts: running sums, percentiles, hypothetical ranks.

No group and no table comes together in one task: rows go to ranges of (group, order), each range adds up its own rows, and
the sums of earlier ranges of a group are carried on from a table of one row for each group and range. Values are counted
before they are dealt out, so a value that very many rows have is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.sources.shared import kept


def _same(a: Sequence[str], b: Sequence[str]) -> Column:
    return F.lit(True) if not a else _all([F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b, strict=True)])


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], weight: Column | None = None, out: str = "before") -> DataFrame:
    """df with out: the sum of weight (1: the count) over the rows that stand before a row in its group; without by, in the table.

    order must tell a group's rows apart, or equal rows are in any order. Null groups are a group. The rows are kept in the
    shared folder. A range is one task's work; a group has as many ranges as it needs.
    """
    weight = F.lit(1).cast("long") if weight is None else weight
    weighed = df.withColumn("_weight", weight)
    ranged = kept(weighed.repartitionByRange(*(F.asc(b) for b in by), *order).withColumn("_range", F.spark_partition_id()))
    w = W.partitionBy(*by, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy(*(F.col(b).alias(f"_by{n}") for n, b in enumerate(by)), F.col("_range").alias("_of")).agg(F.sum("_weight").alias("_sum"))
    names = [f"_by{n}" for n in range(len(by))]
    earlier = W.partitionBy(*names).orderBy("_of").rowsBetween(W.unboundedPreceding, -1)  # rows: ranges
    carried = sums.withColumn("_carried", F.sum("_sum").over(earlier)).where("_carried is not null").drop("_sum")
    own = ranged.withColumn("_own", F.sum("_weight").over(w))
    both = own.join(carried, _same(list(by), names) & (F.col("_range") == F.col("_of")), "left")
    return both.withColumn(out, F.coalesce("_own", F.lit(0)) + F.coalesce("_carried", F.lit(0))).select(*df.columns, out)


def percentile_disc(df: DataFrame, by: Sequence[str], value: str, fractions: Sequence[float], descending: bool = False) -> DataFrame:
    """For each group (by; none: the table) and fraction, the first value whose cumulative share is at least the fraction: by, fraction, value.

    Nulls do not count; a group without values has null. Fractions from 0 to 1; they are compared as decimals of 12 digits,
    so that a share of exactly a fraction counts. An empty table has no groups, but
    null for each fraction where by is empty.
    """
    if not all(0 <= f <= 1 for f in fractions):
        raise ValueError("fractions lie between 0 and 1")
    counted = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    order = [F.desc("_v") if descending else F.asc("_v")]
    placed = running(counted.where("_v is not null"), by, order, F.col("_n"), "_before")
    totals = kept(counted.groupBy(*(F.col(b).alias(f"_by{n}") for n, b in enumerate(by))).agg(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))).alias("_all")))
    totals = totals.withColumn("_f", F.explode(F.array(*(F.lit(float(f)) for f in fractions))))
    names = [f"_by{n}" for n in range(len(by))]
    # the smallest rank that has the share: a fraction of whole numbers, rounded up
    totals = totals.withColumn("_rank", F.greatest(F.lit(1).cast("decimal(38,0)"), F.ceil(F.col("_f").cast("decimal(14,12)") * F.col("_all").cast("decimal(20,0)")).cast("decimal(38,0)")))
    within = (F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_n"))
    if by:
        found = totals.join(placed.select(*by, "_v", "_n", "_before"), _same(list(by), names) & within, "left").select(*names, "_f", "_v")
    else:  # as many rows as there are fractions are told to all ranges
        hit = placed.join(F.broadcast(totals.select("_f", "_rank")), within).select("_f", "_v")
        found = totals.select("_f").join(hit, "_f", "left")
    return found.select(*(F.col(n).alias(b) for n, b in zip(names, by, strict=True)), F.col("_f").alias("fraction"), F.col("_v").alias(value))


def hypothetical_ranks(df: DataFrame, by: Sequence[str], value: str, probes: DataFrame, probe: str) -> DataFrame:
    """Where each probe would stand among its group's values, ascending, nulls last: the columns of probes, rank, dense_rank, percent_rank, cume_dist.

    probes: rows with by and a value to try (a null stands among the nulls). rank is one more than the values before it,
    dense_rank one more than the different values before it, percent_rank (rank - 1) / n, cume_dist the share of values
    up to it in the group with the probe added. A group without rows: 1, 1, 0, 1.
    """
    clash = {"rank", "dense_rank", "percent_rank", "cume_dist"} & set(probes.columns)
    if clash:
        raise ValueError(f"columns that this adds: {sorted(clash)}")
    of_values = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    asked = probes.select(*by, F.col(probe).cast(df.schema[value].dataType).alias("_v")).distinct()
    points = of_values.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_n", F.lit(0).cast("long")).withColumn("_asked", F.lit(True)))
    points = points.groupBy(*by, "_v").agg(F.sum("_n").alias("_n"), F.max("_asked").alias("_asked"))
    order = [F.asc_nulls_last("_v")]
    placed = running(points, by, order, F.col("_n"), "_before")
    placed = running(placed, by, order, (F.col("_n") > 0).cast("long"), "_different").where("_asked")
    names = [f"_by{n}" for n in range(len(by))]
    totals = of_values.groupBy(*(F.col(b).alias(n) for b, n in zip(by, names, strict=True))).agg(F.sum("_n").alias("_all"))
    ranked = placed.join(totals, _same(list(by), names), "left").drop(*names).withColumn("_all", F.coalesce("_all", F.lit(0)))
    ranks = ranked.select(
        *(F.col(b).alias(n) for b, n in zip(by, names, strict=True)), "_v", (F.col("_before") + 1).alias("rank"), (F.col("_different") + 1).alias("dense_rank"),
        F.when(F.col("_all") == 0, 0.0).otherwise(F.col("_before") / F.col("_all")).alias("percent_rank"), ((F.col("_before") + F.col("_n") + 1) / (F.col("_all") + 1)).alias("cume_dist"),
    )
    on = _all([*([_same(list(by), names)] if by else []), F.col(probe).cast(df.schema[value].dataType).eqNullSafe(F.col("_v"))])
    return probes.join(ranks, on).select(*probes.columns, "rank", "dense_rank", "percent_rank", "cume_dist")
