"""Mixing of sources to target weights by subset-sum budget fitting.

Sources get word targets by weight. A source's target is some whole passes over it and a remaining
budget. The budget is fitted on the number of documents of each exact length: an even share of every
length first, then long documents as long as they fit, then a bounded-knapsack dynamic program that
meets what is left as closely as any choice of the rest can. Which documents of a length are taken is
decided by a seeded hash, ranked over salted groups.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import discard, stash, table

#: Weights of the sources in code point order, repeating; the most passes over a source; the seed.
WEIGHTS, MOST, SEED = (5, 2, 1), 3, 17

#: Groups in which the documents of one source and length are ranked.
SALTS = 256

#: The dynamic program's budget, in words; documents that fit are taken by length before it, down to this.
KNAPSACK = 1 << 15


def knapsack(items: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """How many of each size to take, at most as many as there are, so that the sum is the largest <= budget.

    items: (size, how many). Binary splitting turns counts into single items; a bit set holds the sums that
    the items so far can make.
    """
    split: list[tuple[int, int]] = []
    for size, many in items:
        many, step = min(many, budget // size if size else 0), 1
        while many > 0:
            split.append((size, min(step, many)))
            many, step = many - step, 2 * step
    mask, sums = (1 << budget + 1) - 1, [1]
    for size, times in split:
        sums.append((sums[-1] | sums[-1] << size * times) & mask)
    at, taken = sums[-1].bit_length() - 1, dict[int, int]()
    for (size, times), before in zip(reversed(split), reversed(sums[:-1]), strict=True):
        if not before >> at & 1:
            at -= size * times
            taken[size] = taken.get(size, 0) + times
    return taken


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each size to take so that their words come as near below budget as can be found."""
    total = sum(s * n for s, n in counts.items())
    if budget >= total:
        return dict(counts)
    taken = {s: n * budget // total for s, n in counts.items() if s}
    left = budget - sum(s * n for s, n in taken.items())
    for s in sorted(taken, reverse=True):
        if left > KNAPSACK:
            more = min(counts[s] - taken[s], (left - KNAPSACK) // s + (left >= s > (left - KNAPSACK) % s))
            more = min(more, left // s)
            taken[s] += more
            left -= more * s
    for s, n in knapsack([(s, counts[s] - n) for s, n in taken.items() if s <= min(left, KNAPSACK)], min(left, KNAPSACK)).items():
        taken[s] += n
    return taken


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target of each source; sizes: source, source_size, one row each.

    Weights go round in code point order, null last. Targets share the sum of all sizes by weight; a target
    stops at most times its source's size, and the excess is shared anew among the others. In closed form: a
    source stops when most * size / weight is below the level; sources ordered by that ratio stop in turn,
    and a running sum tells where the level settles. The table has one row for a source.
    """
    nth = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(nth - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w.cast("double")).withColumn("cap", most * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    below = W.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    rows = rows.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
    rows = rows.withColumn("rest_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(below), F.lit(0.0)))
    # those below this one in order have stopped; it stops too if its cap is under its share of the rest
    stops = F.col("ratio") <= F.col("rest") / F.col("rest_w")
    rows = rows.withColumn("stops", stops).withColumn("level", F.max(F.when(~F.col("stops"), F.col("rest") / F.col("rest_w"))).over(everything))
    return rows.select("source", "source_size", F.when(F.col("stops") | F.col("level").isNull(), F.col("cap")).otherwise(F.col("w") * F.col("level")).alias("target"))


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one source: for each size, how many documents the remaining budget takes, and the whole passes."""
    total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    passes = int(target // total) if total else 0
    counts = dict(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True))
    taken = fit(counts, int(round(target - passes * total)))
    return pdf.drop(columns="n").assign(passes=passes, extra=[taken.get(s, 0) for s in counts])


def words(text: str = "text") -> Column:
    r"""Number of [^\x20\x09-\x0D]+ in a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, seed: int = SEED, key_cols: tuple[str, ...] = ()) -> DataFrame:
    """Each document with size, source_size, target and times, how often the mix takes it (0 to 3), and its key_cols.

    docs: doc_id, text, source; other columns are not read, whatever their names. A null text has size 0; a null
    source is a source of its own. Every document is taken by whole passes alike, and once more where the seeded
    hash chooses it. Equal rows rank side by side, so any of them may be the one that is chosen, and the result is
    the same set of rows. A source without words is never chosen beyond passes (0). No rows: no result. Each
    source's words come within the knapsack's gap of its target, below it. Texts are read once and never shuffled.
    """
    cols = ["doc_id", "source", *key_cols]
    text_key = F.xxhash64("text")
    rows = docs.select(*cols, words().alias("size"), F.xxhash64(F.lit(seed), "doc_id", text_key).alias("pick"))
    rows = stash(rows.withColumn("salt", F.pmod(F.shiftright("pick", 32), F.lit(SALTS))).withColumn("none", F.col("source").isNull()).withColumn("src", F.coalesce("source", F.lit(""))))
    counts = stash(rows.groupBy("none", "src", "source", "size", "salt").count())
    hist = counts.groupBy("none", "src", "source", "size").agg(F.sum("count").alias("n"))
    sizes = hist.groupBy("none", "src", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(sizes.select("source", "source_size")).withColumn("none", F.col("source").isNull()).withColumn("src", F.coalesce("source", F.lit(""))).drop("source")
    schema = "none boolean, src string, size long, source_size long, target double, passes long, extra long"
    chosen = hist.select("none", "src", "size", "n").join(goal, ["none", "src"]).groupBy("none", "src").applyInPandas(_plan, schema)
    before = W.partitionBy("none", "src", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    quota = counts.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count", "source").join(chosen, ["none", "src", "size"])
    quota = stash(quota.withColumn("quota", F.greatest(F.col("extra") - F.col("before"), F.lit(0))).drop("before", "extra"))
    discard(counts)
    nth = F.row_number().over(W.partitionBy("none", "src", "size", "salt").orderBy("pick", "doc_id"))
    ranked = rows.withColumn("nth", nth).join(quota, ["none", "src", "size", "salt"])
    return ranked.select(*cols, "size", "source_size", "target", (F.col("passes") + (F.col("nth") <= F.col("quota")).cast("long")).alias("times"))


def mixed_rows(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; docs: doc_id, text, source and any others, whatever their names.

    Rows are known by two hashes of all their columns. Which rows are taken is decided on sizes alone; then the texts move
    once, to meet the numbers. Equal rows meet as one that stands as often as all of them are taken.
    """
    taken = [n for n in (f"_{x}" for x in range(len(docs.columns) + 4)) if n not in docs.columns][:4]
    one, two, nth, total = taken
    keyed = docs.withColumns({one: F.xxhash64(*docs.columns), two: F.hash(*docs.columns)})
    mixed = mix(keyed.select("doc_id", "text", "source", one, two), seed, (one, two)).where("times > 0")
    times = stash(mixed.groupBy(one, two).agg(F.sum("times").alias(total)))
    first = F.row_number().over(W.partitionBy(one, two).orderBy("doc_id"))
    single = keyed.withColumn(nth, first).where(F.col(nth) == 1).join(times, [one, two])
    return single.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(total).cast("int"))).alias(total)).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))

