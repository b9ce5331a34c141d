"""Hierarchical walks, partitioned outer joins and order statistics against plain Python: nulls, ties, repeated rows, empty tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators.densify import partitioned_outer_join
from plumbline.operators.hierarchy import ConnectByLoop, connect_by, path_text, searched
from plumbline.operators.order_stats import hypothetical_ranks, percentile_disc, running


def walk(rows, start, order, loops, max_level=None):
    """rows: (key, parent, value); depth first: (key, level, path, is_leaf, is_cycle)."""
    out = []

    def visit(row, path, cycle):
        at = len(out)
        out.append(None)
        kids = [] if cycle or row[0] is None else sorted((r for r in rows if r[1] == row[0]), key=order)
        loop = [k for k in kids if k[0] in path]
        if loops == "nocycle":
            kids = [k for k in kids if k not in loop]
        kids = [] if len(path) == max_level else kids
        for k in kids:
            visit(k, [*path, k[0]], k[0] in path)
        out[at] = (row[0], len(path), path, not kids, cycle if loops == "mark" else bool(loop) and loops == "nocycle" and len(path) != max_level)

    for r in sorted((r for r in rows if start(r)), key=order):
        visit(r, [r[0]], False)
    return out


@pytest.mark.parametrize(("loops", "max_level"), [("nocycle", None), ("mark", None), ("nocycle", 3), ("mark", 2)])
def test_walks(spark, loops, max_level):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, *range(12)]), rng.randrange(4)) for k in range(12)] + [(3, 5, 9), (20, 3, 0), (None, 3, 1), (21, None, 1), (22, 22, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k long, p long, v long, level_ string")
    start, order = F.col("p").isNull() | (F.col("k") == 22) | (F.col("v") == 9), lambda r: (-r[2], r[0] is not None, r[0] or 0)
    found = connect_by(df, ["k"], ["p"], start, [F.desc("v")], loops, max_level=max_level, carry=["v"])
    at = searched(found).orderBy("seq").collect()
    wanted = walk(rows, lambda r: r[1] is None or r[0] == 22 or r[2] == 9, order, loops, max_level)
    assert [(r.k, r.level, [x and x.k0 for x in r.path], r.is_leaf, r.is_cycle) for r in at] == wanted and [r.seq for r in at] == list(range(1, len(at) + 1))
    assert all(r.root == r.path[0] and len(r.path_v) == r.level for r in at)
    wide = searched(found, breadth=True).orderBy("seq").collect()
    assert [r.level for r in wide] == sorted(w[1] for w in wanted)
    assert connect_by(df.limit(0), ["k"], ["p"], start).count() == 0


def test_walks_raise_on_loops_and_take_conditions(spark):
    df = spark.createDataFrame([(1, 1, None, None), (1, 2, 1, 1), (2, 2, 1, 1), (2, 5, 2, 2), (2, 2, 2, 5)], "a long, b long, pa long, pb long")
    with pytest.raises(ConnectByLoop):
        connect_by(df, ["a", "b"], ["pa", "pb"], F.col("pa").isNull())
    found = connect_by(df, ["a", "b"], ["pa", "pb"], F.col("pa").isNull(), keep=F.col("pb") != 5, carry=["b"])
    assert sorted(found.select("a", "b", "level", path_text("b", "-").alias("p")).collect()) == [(1, 1, 1, "-1"), (1, 2, 2, "-1-2"), (2, 2, 2, "-1-2"), (2, 5, 3, "-1-2-5")]
    with pytest.raises(ValueError, match="level"):
        connect_by(df.withColumn("level", F.lit(1)), ["a"], ["pa"], F.lit(True))


@pytest.mark.parametrize("carry", [False, True])
def test_partitioned_outer_join(spark, carry):
    facts = [("a", 3, 1, "x"), ("a", 3, 2, "w"), ("a", 5, 9, None), ("a", 99, 7, "none"), (None, 1, 4, "n"), ("b", None, 1, "q"), ("b", 98, 1, "q"), ("c", 1, 1, "i"), ("c", 1, 1, "i"), ("c", 6, None, "k")]
    days = [(1, "one"), (2, "two"), (3, "three"), (5, "five"), (5, "fivf"), (6, None), (None, "null")]
    f, d = spark.createDataFrame(facts, "g string, d long, v long, s string"), spark.createDataFrame(days, "d long, name string")
    points = {1: "one", 2: "two", 3: "three", 5: "fivf", 6: None}
    wanted = []
    for g in {r[0] for r in facts}:
        last = (None, None)
        for p, name in points.items():
            here = [r for r in facts if r[0] == g and r[1] == p]
            wanted += [(g, p, r[2], r[3], name, False) for r in here] or [(g, p, *(last if carry else (None, None)), name, True)]
            if here:
                last = max(((r[3] is not None, r[3] or ""), r[2] is not None, r[2] or 0, r[2], r[3]) for r in here)[3:]
    found = partitioned_outer_join(f, ["g"], "d", d, carry, [F.col("s")])
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted))
    assert partitioned_outer_join(f.limit(0), ["g"], "d", d).count() == 0 == partitioned_outer_join(f, ["g"], "d", d.limit(0)).count()
    assert partitioned_outer_join(f, ["g"], "d", d.limit(0)).columns == found.columns


def test_running_sums_with_hot_groups_and_ties(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", None, "x"]), rng.randrange(50), n, rng.choice([0, 1, 5, -2])) for n in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        found = running(spark.createDataFrame(rows, "g string, v long, id long, w long"), ["g"], [F.desc("v"), F.asc("id")], F.col("w")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sums, wanted = {}, {}
    for g, v, n, w in sorted(rows, key=lambda r: (-r[1], r[2])):
        wanted[n] = sums.get(g, 0)
        sums[g] = wanted[n] + w
    assert {r.id: r.before for r in found} == wanted


def test_percentiles(spark):
    rng = random.Random(8)
    rows = [(g, rng.choice([None, 5.0, 5.0, 5.0, rng.randrange(100) / 4])) for g in ["a", "a", "b", None] for _ in range(rng.randrange(1, 60))] + [("empty", None), ("one", 1.5), ("ten", 0.0)] + [("ten", float(n)) for n in range(1, 10)]
    df, fractions = spark.createDataFrame(rows, "g string, v double"), [0.0, 0.1, 0.3, 0.5, 0.999, 1.0]
    for down in (False, True):
        for by in (["g"], []):
            wanted = set()
            for g in {r[0] for r in rows} if by else {()}:
                vs = sorted((r[1] for r in rows if (not by or r[0] == g) and r[1] is not None), reverse=down)
                wanted |= {((g,) if by else ()) + (f, vs[max(1, math.ceil(round(f * 1000) * len(vs) / 1000)) - 1] if vs else None) for f in fractions}
            found = percentile_disc(df, by, "v", fractions, down).collect()
            assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)
    assert percentile_disc(df.where("g = 'empty'"), [], "v", [0.5]).collect() == [(0.5, None)]
    assert percentile_disc(df.limit(0), [], "v", [0.5]).collect() == [(0.5, None)]
    assert percentile_disc(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_hypothetical_ranks(spark):
    rng = random.Random(9)
    rows = [(g, rng.choice([None, rng.randrange(8)])) for g in ["a", "b", None] for _ in range(25)]
    probes = [(n, g, p) for n, (g, p) in enumerate((g, p) for g in ["a", "b", None, "none"] for p in [None, -1, 3, 3, 100])]
    df, asked = spark.createDataFrame(rows, "g string, v long"), spark.createDataFrame(probes, "id long, g string, p int")
    key = lambda v: (v is None, v or 0)
    for by in (["g"], []):
        wanted = {}
        for n, g, p in probes:
            vs = [r[1] for r in rows if not by or r[0] == g]
            less, same = [v for v in vs if key(v) < key(p)], [v for v in vs if v == p]
            wanted[n] = (len(less) + 1, len(set(less)) + 1, round(len(less) / len(vs), 9) if vs else 0.0, round((len(less) + len(same) + 1) / (len(vs) + 1), 9))
        found = {r.id: (r["rank"], r.dense_rank, round(r.percent_rank, 9), round(r.cume_dist, 9)) for r in hypothetical_ranks(df, by, "v", asked, "p").collect()}
        assert found == wanted
