"""Materialised aggregates that are refreshed from a log of signed changes, without reading their base again.

Counts and sums are linear: a refresh adds what the changes sum up to, a segment whose size is that of the changes. Least
and greatest values are not: for these a view keeps how often each value stands in each group, which is linear again, and
takes the least and greatest of those that stand there at all. Reading a view adds up its segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from plumbline.operators.journal import Journal


class AggregateView:
    """For each group: n, the number of its rows, and of some columns sums, non-null counts, least and greatest values.

    Sums are decimals of 38 digits, `scale` of them after the point, so that what is added and taken away again leaves
    nothing behind. A null value counts in n only; a null group is a group. A group is there while n > 0.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, group: list[str], sums: tuple[str, ...] = (), extremes: tuple[str, ...] = (), scale: int = 6):
        self.group, self.sums, self.extremes, self.number = group, sums, extremes, f"decimal(38,{scale})"
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        keys = [schema[c] for c in group]
        totals = [StructField("n", LongType()), *(f for c in sums for f in (StructField(f"sum_{c}", spark.sql(f"SELECT CAST(NULL AS {self.number}) AS x").schema[0].dataType), StructField(f"count_{c}", LongType())))]
        self.totals = Journal(spark, f"{path}/totals", group, StructType([*keys, *totals]))
        self.values = {c: Journal(spark, f"{path}/values_{c}", [*group, c], StructType([*keys, schema[c], StructField("n", LongType())])) for c in extremes}

    def _linear(self) -> list[str]:
        return ["n", *(f"{k}_{c}" for c in self.sums for k in ("sum", "count"))]

    def refresh(self, changes: DataFrame, log: str = "log", upto: int = 0) -> None:
        """Add changes: rows with _sign (1 or -1). upto: the last write of the log that they come from; changes up to one that was added before are not added again.

        The parts of a view are written one after the other, the totals last; after a failure a refresh with the same upto adds what is missing.
        """
        sign = F.col("_sign").cast("long")
        for c, journal in self.values.items():
            counted = changes.where(F.col(c).isNotNull()).groupBy(*self.group, c).agg(F.sum(sign).alias("n")).where("n <> 0")
            journal.append(counted.withColumn("_sign", F.lit(1)), log, upto)
        sums = [x for c in self.sums for x in (F.sum(F.col(c).cast(self.number) * sign).cast(self.number).alias(f"sum_{c}"), F.sum(F.when(F.col(c).isNotNull(), sign)).alias(f"count_{c}"))]
        self.totals.append(changes.groupBy(*self.group).agg(F.sum(sign).alias("n"), *sums).withColumn("_sign", F.lit(1)), log, upto)

    def refreshed(self, log: str = "log") -> int:
        """The last write of a log that the view holds."""
        return self.totals.log().where(F.col("stream") == log).agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0]

    def follow(self, base: Journal, log: str = "log") -> None:
        """Refresh from the writes of a journal that the view doesn't hold yet."""
        last = base.last()
        done = self.refreshed(log)
        if last > done:
            self.refresh(base.changes(done, last), log, last)

    def read(self) -> DataFrame:
        """group, n, sum_ and count_ of each summed column (a sum without values is null), min_ and max_ of each extreme."""
        added = self.totals.changes().groupBy(*self.group).agg(*(F.sum(c).alias(c) for c in self._linear())).where("n > 0")
        out = added.select(*self.group, "n", *(x for c in self.sums for x in (F.when(F.col(f"count_{c}") > 0, F.col(f"sum_{c}").cast(self.number)).alias(f"sum_{c}"), F.coalesce(F.col(f"count_{c}"), F.lit(0)).alias(f"count_{c}"))))
        for c, journal in self.values.items():
            present = journal.changes().groupBy(*self.group, c).agg(F.sum("n").alias("n")).where("n > 0")
            ends = present.groupBy(*(F.col(g).alias(f"_{g}") for g in self.group)).agg(F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))
            out = out.join(ends, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in self.group], "left").drop(*(f"_{g}" for g in self.group)) if self.group else out.join(ends, how="left")
        return out

    def compact(self) -> None:
        """Add up the segments of each part into one, which takes their place."""
        for journal, linear in [(self.totals, self._linear()), *((j, ["n"]) for j in self.values.values())]:
            key = journal.key
            journal.fold(lambda rows, key=key, linear=linear: rows.groupBy(*key).agg(*(F.sum(c).alias(c) for c in linear)).where("n <> 0").withColumn("_sign", F.lit(1).cast(IntegerType())))
