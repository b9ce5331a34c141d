"""Journals, streams into them and views that follow them, against plain recomputation."""

import random
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.operators.journal import Journal
from plumbline.operators.views import AggregateView
from plumbline.streaming import ingest

SCHEMA = "k long, g string, v double"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_reads_of_any_write_and_versions(spark, tmp_path):
    j = Journal(spark, str(tmp_path), ["k"], SCHEMA)
    make = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    assert j.read().count() == 0 and j.versions().count() == 0 and j.last() == 0
    assert j.upsert(make((1, "a", 1.0), (2, "b", None), (None, "n", 3.0)))
    assert j.upsert(make((1, "a", 1.0), (2, "b", 5.0)), "s", 7)
    time.sleep(1.1)
    at = str(spark.range(1).select(F.current_timestamp().cast("string")).first()[0])
    time.sleep(1.1)
    j.compact()
    assert j.delete(spark.createDataFrame([(1,), (None,), (99,)], "k long"))
    assert not j.upsert(make((2, "b", 77.0)), "s", 7) and not j.upsert(make((2, "b", 78.0)), "s", 3)  # batches of a stream that were added
    j.compact()
    assert j.upsert(make((1, "z", 9.0), (1, "y", 9.0)), "s", 8)  # of one key in a write the greatest
    first, second = [(1, "a", 1.0), (2, "b", None), (None, "n", 3.0)], [(1, "a", 1.0), (2, "b", 5.0), (None, "n", 3.0)]
    assert rows_of(j.read(0)) == [] and rows_of(j.read(1)) == sorted(first, key=str) and rows_of(j.read(2)) == sorted(second, key=str) == rows_of(j.as_of(at))
    assert rows_of(j.read(3)) == [(2, "b", 5.0)] and rows_of(j.read()) == [(1, "z", 9.0), (2, "b", 5.0)]
    versions = j.versions()
    found = {(r.k, r.g, r.v, r.operation, r.first_seq, r.last_seq) for r in versions.collect()}
    assert found == {(1, "a", 1.0, "I", 1, 2), (1, "a", 1.0, "D", 3, 3), (1, "z", 9.0, "I", 4, None), (2, "b", None, "I", 1, 1), (2, "b", 5.0, "U", 2, None), (None, "n", 3.0, "I", 1, 2), (None, "n", 3.0, "D", 3, 3)}
    assert all(r.first_at is not None and (r.last_at is None) == (r.last_seq is None or r.last_seq == 4) for r in versions.collect())
    assert {(r.k, r.first_seq) for r in j.versions(2, 2).collect()} == {(1, 1), (2, 2), (None, 1)}
    assert [r._sign for r in j.changes(1, 2).orderBy("_sign").collect()] == [-1, 1]


def test_a_second_writer_fails_and_a_failed_write_changes_nothing(spark, tmp_path):
    j = Journal(spark, str(tmp_path), ["k"], SCHEMA)
    j.upsert(spark.createDataFrame([(1, "a", 1.0)], SCHEMA))
    stale = Journal(spark, str(tmp_path), ["k"], SCHEMA)
    stale.last = lambda: 0
    with pytest.raises(Exception, match="exists"):
        stale.append(spark.createDataFrame([(5, "x", 1.0)], SCHEMA).withColumn("_sign", F.lit(1)))
    with pytest.raises(Exception):  # noqa: B017
        j.upsert(spark.createDataFrame([(2, "a", 1.0)], SCHEMA).withColumn("g", F.raise_error(F.lit("no"))))
    assert rows_of(j.read()) == [(1, "a", 1.0)] and j.last() == 1


@pytest.mark.parametrize("compact", [False, True])
def test_a_view_equals_recomputation(spark, tmp_path, compact):
    rng = random.Random(3)
    base = Journal(spark, f"{tmp_path}/base", ["k"], SCHEMA)
    view = AggregateView(spark, f"{tmp_path}/view", SCHEMA, ["g"], ("v",), ("v",), 2)
    table = {}
    for step in range(5):
        new = {rng.randrange(30): (rng.choice(["a", "b", None, f"s{step}"]), rng.choice([None, rng.randrange(5) / 4, 10.1])) for _ in range(12)}
        table |= new
        base.upsert(spark.createDataFrame([(k, *x) for k, x in new.items()], SCHEMA))
        gone = [k for k in table if rng.random() < 0.3]
        base.delete(spark.createDataFrame([(k,) for k in gone], "k long"))
        table = {k: x for k, x in table.items() if k not in gone}
        if step != 1:  # two writes, or four, at once
            view.follow(base)
            view.follow(base)
            view.refresh(base.changes(), "log", base.last())  # again: changes nothing
        if compact and step == 2:
            view.compact()
            view.compact()
    groups = {}
    for g, v in table.values():
        groups.setdefault(g, []).append(v)
    number = lambda v: Decimal(str(v)).quantize(Decimal("0.01"))
    wanted = {g: (len(vs), sum(map(number, x)) if (x := [v for v in vs if v is not None]) else None, len(x), min(x, default=None), max(x, default=None)) for g, vs in groups.items()}
    assert {r.g: (r.n, r.sum_v, r.count_v, r.min_v, r.max_v) for r in view.read().collect()} == wanted
    base.delete(spark.createDataFrame([(k,) for k in table], "k long"))
    view.follow(base)
    assert view.read().count() == 0


LINES = "owner string, name string, type string, line int, text string, at timestamp"


def put(spark, folder, n, rows):
    df = spark.createDataFrame([("APP", name, "PROCEDURE", line, text, at) for name, line, text, at in rows], "owner string, name string, type string, line int, text string, at string")
    df.withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(folder))
    time.sleep(0.05)


def test_late_lines_replays_and_expired_state(spark, tmp_path):
    lines, where = tmp_path / "lines", str(tmp_path / "journal")
    put(spark, lines, 0, [("A", 2, "two\n", "2024-01-01 10:00:00"), ("A", 1, "one\n", "2024-01-01 10:00:01"), ("B", 1, "b\n", "2024-01-01 10:00:00"), ("B", None, "no number", "2024-01-01 10:00:00")])
    put(spark, lines, 1, [("A", 3, "three", "2024-01-01 09:30:00"), ("A", 1, "old one\n", "2024-01-01 09:59:00"), ("B", 1, "B again\n", "2024-01-01 10:05:00")])
    put(spark, lines, 2, [("C", 1, None, "2024-01-01 20:00:00")])
    put(spark, lines, 3, [("D", 1, "create d", "2024-01-01 20:00:00")])  # the watermark of the batch before takes effect on state
    put(spark, lines, 4, [("A", 9, "too late", "2024-01-01 10:00:00")])
    j = Journal(spark, where, ingest.KEY, ingest.OBJECTS)

    def run(checkpoint):
        stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(str(lines))
        query = ingest.into(ingest.objects(stream, "1 hour"), j, "lines", str(tmp_path / checkpoint))
        query.awaitTermination(300)
        return query

    query = run("one")
    wanted = {"A": "CREATE OR REPLACE one\ntwo\nthree", "B": "CREATE OR REPLACE B again\n", "C": "CREATE OR REPLACE ", "D": "create d"}
    assert {r.object_name: r.source_text for r in j.read().collect()} == wanted
    assert sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators) == 1
    writes = j.last()
    run("two")  # the same batches under the same numbers
    assert j.last() == writes and {r.object_name: r.source_text for r in j.read().collect()} == wanted
    put(spark, lines, 5, [("C", 2, "more", "2024-01-01 20:30:00")])
    run("one")
    assert j.last() > writes and j.read().where("object_name = 'C'").first().source_text == "CREATE OR REPLACE more" and j.read(writes).where("object_name = 'C'").first().source_text == "CREATE OR REPLACE "


def test_state_kept_for_ever(spark, tmp_path):
    put(spark, tmp_path / "l", 0, [("A", 2, "two\n", "2024-01-01 10:00:00"), ("A", 1, "new\n", "2024-01-02 10:00:00"), ("B", 5, None, "2024-01-01 10:00:00")])
    put(spark, tmp_path / "l", 1, [("A", 1, "old\n", "2023-01-01 10:00:00"), ("A", 0, "zero\n", "1960-01-01 10:00:00"), ("A", 2, "two!\n", "2024-01-01 10:00:00")])
    j = Journal(spark, str(tmp_path / "j"), ingest.KEY, ingest.OBJECTS)
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "l"))
    ingest.into(ingest.objects(stream, None), j, "lines", str(tmp_path / "c")).awaitTermination(300)
    assert {(r.object_name, r.source_text, r.lines) for r in j.read().collect()} == {("A", "CREATE OR REPLACE zero\nnew\ntwo!\n", 3), ("B", "CREATE OR REPLACE ", 1)}
    assert j.last() == 2


def test_windows_change_as_events_come(spark, tmp_path):
    events = [("2024-01-01 23:00:00", "x", 1.5), ("2024-01-02 01:00:00", "x", None), ("2024-01-01 22:30:00", "x", 2.25), ("2024-01-02 01:30:00", "y", 1.0)]
    for at, g, v in events:
        spark.createDataFrame([(at, g, v)], "at string, g string, v double").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        time.sleep(0.05)
    stream = spark.readStream.schema("at timestamp, g string, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    j = Journal(spark, str(tmp_path / "j"), ["window_start", "g"], "window_start timestamp, g string, n long, total decimal(38,6)")
    ingest.into(ingest.windowed(stream, "at", ["g"], "v", "1 day", "3 hours"), j, "w", str(tmp_path / "c")).awaitTermination(300)
    assert rows_of(j.read().select(F.date_format("window_start", "dd"), "g", "n", "total")) == [("01", "x", 2, Decimal("3.750000")), ("02", "x", 1, None), ("02", "y", 1, Decimal("1.000000"))]
    assert {(r.n, r.first_seq) for r in j.versions().where("g = 'x' and day(window_start) = 1").collect()} == {(1, 1), (2, 3)}


def test_objects_share_states(spark, tmp_path):
    put(spark, tmp_path / "l", 0, [(f"N{n}", 1, "one\n", "2024-01-01 10:00:00") for n in range(1500)])
    put(spark, tmp_path / "l", 1, [(f"N{n}", 2, "two", "2024-01-01 10:00:00.000001") for n in range(0, 1500, 2)])
    j = Journal(spark, str(tmp_path / "j"), ingest.KEY, ingest.OBJECTS)
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "l"))
    query = ingest.into(ingest.objects(stream, "1 hour"), j, "lines", str(tmp_path / "c"))
    query.awaitTermination(300)
    assert 0 < query.lastProgress.stateOperators[0].numRowsTotal <= ingest.BUCKETS < 1500  # each costs milliseconds a batch
    assert {(r.object_name, r.source_text) for r in j.read().collect()} == {(f"N{n}", "CREATE OR REPLACE one\n" + ("" if n % 2 else "two")) for n in range(1500)}


def test_objects_of_one_state_expire_by_themselves(spark, tmp_path):
    put(spark, tmp_path / "l", 0, [("A", 1, "a\n", "2024-01-01 10:00:00"), (None, 1, "ä\n", "2024-01-01 12:30:00")])
    put(spark, tmp_path / "l", 1, [("C", 1, "c", "2024-01-01 13:00:00")])
    put(spark, tmp_path / "l", 2, [("C", 2, "c", "2024-01-01 13:00:00")])  # the watermark is 12:00, A's last line an hour and more behind it
    put(spark, tmp_path / "l", 3, [("A", 2, "new", "2024-01-01 13:00:00"), (None, 2, "more", "2024-01-01 12:40:00")])
    j = Journal(spark, str(tmp_path / "j"), ingest.KEY, ingest.OBJECTS)
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "l"))
    ingest.into(ingest.objects(stream, "1 hour", buckets=1), j, "lines", str(tmp_path / "c")).awaitTermination(300)
    assert {(r.object_name, r.source_text) for r in j.read().collect()} == {("A", "CREATE OR REPLACE new"), (None, "CREATE OR REPLACE ä\nmore"), ("C", "CREATE OR REPLACE cc")}
