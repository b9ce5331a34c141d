"""Multi-table inserts, multisets, JSON_TABLE and samples against plain Python: nulls, errors, empty tables."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.functions import bags
from plumbline.functions.json_table import ERROR, Exists, Nested, Ordinal, Value, json_table, steps
from plumbline.operators.inserts import RejectLimit, Target, insert_all, routed
from plumbline.operators.sample import sample, sample_blocks


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ROWS = [(1, "10", 5.0), (2, "x", 1.0), (3, None, 9.0), (4, "-4", None), (None, "7", 2.0), (4, "-4", None)]
def into(name, **checks):
    return Target(name, {"k": (F.col("k"), "bigint"), "n": (F.col("t"), "int")}, ["k"], checks)


def test_insert_all_routes_in_one_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, "k long, t string, v double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    branches = [(None, [into("a", small=lambda r: r["n"] < 10)]), (F.col("v") > 1.5, [into("b"), Target("c", {"v": (F.col("v"), "int")})])]
    plan = routed(df, branches)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Exchange" not in plan
    made = insert_all(df, branches, [into("rest")], tag="t", reject_limit=4, returning={"most": ("c", lambda r: F.max(r["v"])), "sum": ("a", lambda r: F.sum(r["n"])), "none": ("rest", lambda r: F.max(r["n"]))})
    assert rows_of(made.tables["a"]) == rows_of(spark.createDataFrame([(3, None), (4, -4), (4, -4)], "k long, n int"))
    assert rows_of(made.tables["b"]) == [(1, 10), (3, None)] and rows_of(made.tables["c"]) == [(2,), (5,), (9,)] and rows_of(made.tables["rest"]) == []
    errors = {(r.target, r.error, r.tag, r.given["k"], r.given["n"]) for r in made.errors.collect()}
    assert errors == {("a", "check:small", "t", "1", "10"), ("a", "conversion:n", "t", "2", "x"), ("a", "required:k", "t", None, "7"), ("b", "required:k", "t", None, "7")} and made.rejected == 4
    assert made.counts == {"a": 3, "b": 2, "c": 3, "rest": 0} and made.returned == {"most": 9, "sum": -8, "none": None}


def test_insert_first_reject_limit_and_empty(spark):
    df = spark.createDataFrame(ROWS, "k long, t string, v double")
    made = insert_all(df, [(F.col("v") > 4, [into("a")]), (F.col("v").isNotNull(), [into("b")])], [into("a")], first=True, reject_limit=None)
    assert rows_of(made.tables["a"]) == [(1, 10), (3, None), (4, -4), (4, -4)] and made.tables["b"].count() == 0 and made.counts == {"a": 4, "b": 0} and made.rejected == 2
    with pytest.raises(RejectLimit, match="2 rows were rejected, 1 may be") as e:
        insert_all(df, [(F.col("v") > 4, [into("a")]), (F.col("v").isNotNull(), [into("b")])], [into("a")], first=True, reject_limit=1)
    assert e.value.errors.count() == 2
    none = insert_all(df.limit(0), [(None, [into("a")])], returning={"n": ("a", lambda r: F.max(r["n"]))})
    assert none.tables["a"].count() == 0 == none.errors.count() and none.counts == {"a": 0} and none.returned == {"n": None}


def test_multisets(spark):
    rng = random.Random(1)
    some = lambda: [rng.choice([None, 1.0, 2.0, float("nan"), 3.0]) for _ in range(rng.randrange(6))]
    rows = [(n, rng.choice([None, some(), some()]), some()) for n in range(150)]
    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>")
    made = {"ua": bags.multiset_union("a", "b"), "ud": bags.multiset_union("a", "b", True), "ea": bags.multiset_except("a", "b"), "ed": bags.multiset_except("a", "b", True), "ia": bags.multiset_intersect("a", "b"), "idd": bags.multiset_intersect("a", "b", True), "sub": bags.submultiset("a", "b"), "eq": bags.equal("a", "b"), "one": bags.is_a_set("a"), "bag": bags.bag("a"), "st": bags.set_of("a"), "n": bags.cardinality("a")}
    count = lambda x: Counter(map(str, x))
    for r in df.select("i", "a", "b", *(c.alias(k) for k, c in made.items())).collect():
        if r.a is None:
            assert all(r[k] is None for k in made)
            continue
        a, b = count(r.a), count(r.b)
        once = lambda keys: Counter(dict.fromkeys(keys, 1))
        assert (count(r.ua), count(r.ud), count(r.ea), count(r.ia)) == (a + b, once({*a, *b}), a - b, a & b)
        assert (count(r.ed), count(r.idd)) == (once({*a} - {*b}), once({*a} & {*b}))
        assert (r["sub"], r.eq, r.one, r.n) == (not a - b, a == b, max(a.values(), default=1) == 1, len(r.a))
        assert {str(e.v): e.n for e in r.bag} == dict(a) and count(r.st) == once(a)
    groups = [(rng.choice("xy"), rng.choice([None, 1, 2])) for _ in range(60)]
    found = {r.g: [(e.v, e.n) for e in r.bag] for r in bags.collected(spark.createDataFrame(groups, "g string, v int"), ["g"], "v").collect()}
    assert found == {g: [(v, n) for v in (1, 2, None) if (n := sum(x == (g, v) for x in groups))] for g in "xy"}


DOCS = [
    {"id": 1, "items": [{"n": "a", "q": 2, "tags": ["x", "y"]}, {"n": "b", "q": "many", "tags": []}, {"n": None, "q": 2.5}], "notes": [{"t": 7}]},
    {"id": 2, "items": {"n": "alone", "tags": "z"}},
    {"id": 3}, {"items": [1, "two", None, [3]]},
]


def test_json_table(spark):
    docs = [(n, json.dumps(d)) for n, d in enumerate(DOCS)] + [(8, "no json {"), (9, None), (10, "[1]")]
    df = spark.createDataFrame(docs, "k int, doc string")
    columns = [Value("id", "$.id", "int", on_empty=-1), Exists("has", "$.notes"), Nested("$.items[*]", [Ordinal("i"), Value("n", "$.n"), Value("q", "$.q", "int", on_error=0), Value("whole", "$", "json"), Nested("$.tags[*]", [Ordinal("j"), Value("tag", "$")])]), Nested("$.notes[*]", [Value("t", "$.t", "int")])]
    found = [tuple(r)[2:] for r in json_table(df, "doc", "$", columns).where("k < 4").orderBy("k", F.asc_nulls_last("i"), "j").select("k", "doc", "k", "id", "has", "i", "n", "q", "j", "tag", "t").collect()]
    assert found == [
        (0, 1, True, 1, "a", 2, 1, "x", None), (0, 1, True, 1, "a", 2, 2, "y", None), (0, 1, True, 2, "b", 0, None, None, None), (0, 1, True, 3, None, 2, None, None, None), (0, 1, True, None, None, None, None, None, 7),
        (1, 2, False, 1, "alone", None, 1, "z", None), (2, 3, False, None, None, None, None, None, None),
        (3, -1, False, 1, None, None, None, None, None), (3, -1, False, 2, None, None, None, None, None), (3, -1, False, 3, None, None, None, None, None), (3, -1, False, 4, None, None, None, None, None),
    ]
    assert {r.k for r in json_table(df, "doc", "$.id", [Value("v", "$")]).collect()} == {0, 1, 2}
    outer = json_table(df, "doc", "$.id", [Value("v", "$", "int")], outer=True)
    assert rows_of(outer.select("k", "v")) == sorted([(0, 1), (1, 2), (2, 3), (3, None), (8, None), (9, None), (10, None)], key=str)
    assert [r.whole for r in json_table(df, "doc", "$.items[0]", [Value("whole", "$", "json")]).where("k = 3").collect()] == ["1"]
    with pytest.raises(Exception, match="column v: no value"):
        json_table(df, "doc", "$", [Value("v", "$.nope", "int", on_empty=ERROR)]).collect()
    with pytest.raises(ValueError, match="cannot read"):
        steps("$.a..b")
    assert steps('$.a."b c"[3][*]') == ["a", "b c", 3, None] and json_table(df.limit(0), "doc", "$", columns).count() == 0


def test_samples_repeat(spark, tmp_path):
    df = spark.createDataFrame([(n, n % 50, None if n % 9 else "s") for n in range(4000)], "k long, b long, s string")
    some = lambda d, p=20.0, seed=1: {r.k for r in sample(d, p, seed, ["k", "s"]).collect()}
    assert some(df) == some(df.repartition(7)) and abs(len(some(df)) - 800) < 150 and some(df) < some(df, 40.0) and some(df) != some(df, 20.0, 2)
    assert some(df, 0) == set() and len(some(df, 100)) == 4000
    blocks = sample_blocks(df, 30, 5, F.col("b")).groupBy("b").count().collect()
    assert 5 < len(blocks) < 30 and all(r["count"] == 80 for r in blocks)
    df.repartition(10).write.parquet(str(tmp_path / "f"))
    files = spark.read.parquet(str(tmp_path / "f"))
    found = sample_blocks(files, 50, 3).select("_metadata.file_name", "k")
    assert found.count() == files.select("_metadata.file_name", "k").join(found.select("file_name").distinct(), "file_name").count() > 0
    with pytest.raises(ValueError, match="percent"):
        sample(df, 101, 1, ["k"])
