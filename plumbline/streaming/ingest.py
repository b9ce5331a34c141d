"""Streams of source lines into a journal of objects, and windowed counts.

Lines of an object come in any order and in several batches. State keeps what has come, of many objects in one; each batch gives the objects that
it changed, assembled from all their lines so far, and foreachBatch upserts them under the batch's number, so that a
batch that is run again changes nothing. State of an object is dropped once the watermark has passed its last line by
`delay`; lines behind the watermark are late data, which Spark drops and counts in the query's progress.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators.journal import Journal
from plumbline.sources.lines import with_create

KEY = ["schema_name", "object_name", "object_type"]
#: Of a bucket's objects: keys, when each expires (ms), and its lines as a JSON list of [line, time in us, text].
_STATE = "schema_name array<string>, object_name array<string>, object_type array<string>, expires array<long>, held array<string>"
_PIECES = "schema_name string, object_name string, object_type string, body string, lines long"

#: States that objects share.
BUCKETS = 1024

#: Schema of a journal of objects.
OBJECTS = "schema_name string, object_name string, object_type string, source_text string, source_hash string, lines long"


def merged(state: dict[int, tuple[int, str]], rows: Iterable[tuple[int, int, str]]) -> dict[int, tuple[int, str]]:
    """Lines with those that came: of one number the latest, at the same time the greater text."""
    for line, at, text in rows:
        state[line] = max(state[line], (at, text)) if line in state else (at, text)
    return state


def _objects(delay_ms: int):  # noqa: ANN202
    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found = {tuple(key): (expires, held) for *key, expires, held in zip(*state.get, strict=True)} if state.exists else {}
        came: dict[tuple, list[tuple[int, int, str]]] = {}
        for b in batches:
            for *key, line, us, text in zip(*(b[c].tolist() for c in (*KEY, "line", "us")), b["text"].fillna("").tolist(), strict=True):
                came.setdefault(tuple(key), []).append((line, us, text))
        now, pieces = state.getCurrentWatermarkMs(), []
        for key, rows in came.items():
            lines = merged({n: (at, text) for n, at, text in json.loads(found[key][1])} if key in found else {}, rows)
            order = sorted(lines)
            last = max(at for at, _ in lines.values()) // 1000
            found[key] = (max(last, now) + delay_ms + 1, json.dumps([(n, *lines[n]) for n in order], ensure_ascii=False))
            pieces.append((*key, "".join(lines[n][1] for n in order), len(order)))
        left = {key: x for key, x in found.items() if x[0] >= now}  # an object to which lines came is among them
        if left:
            state.update((*map(list, zip(*left, strict=True)), *map(list, zip(*left.values(), strict=True))))
            state.setTimeoutTimestamp(min(expires for expires, _ in left.values()))
        elif state.exists:
            state.remove()
        if pieces:
            yield pd.DataFrame(pieces, columns=[f.split()[0] for f in _PIECES.split(", ")])

    return run


def _latest(found: Column) -> Column:
    """Of (line, at, text), sorted, the last of each line."""
    last = lambda all_: F.filter(all_, lambda x, n: (n + 1 == F.size(all_)) | (x["line"] != F.get(all_, n + 1)["line"]))
    return F.element_at(F.transform(F.array(found), last), 1)  # sorted once


def objects(lines: DataFrame, delay: str | None = "1 hour", delay_ms: int = 3_600_000, buckets: int = BUCKETS) -> DataFrame:
    """A stream of objects as far as their lines have come, of a stream of lines: owner, name, type, line, text, at.

    delay: how late a line may be, after which state expires too (delay_ms after an object's last line). None: state is kept
    for ever and no line is late; then the state is a built-in aggregate's, and no Python runs.
    buckets: by a hash of their keys objects share this many states, since each state of a batch costs milliseconds; a
    batch reads and writes the states of the objects that it changes, but takes apart only these objects' lines.

    A line that comes again replaces the earlier one if its time is later; a null text is empty. Rows without a line
    number or a time are left out; times up to 1970-01-01, where a watermark begins, are late. Each batch gives a row for
    each object that it changed.
    """
    rows = lines.where("line is not null and at is not null").select(F.col("owner").alias("schema_name"), F.col("name").alias("object_name"), F.col("type").alias("object_type"), F.col("line").cast("long").alias("line"), "text", F.col("at").cast("timestamp").alias("at"))
    if delay is None:
        all_ = F.array_sort(F.collect_list(F.struct("line", "at", F.coalesce("text", F.lit("")).alias("text"))))
        held = rows.groupBy(*KEY).agg(all_.alias("all")).select(*KEY, _latest(F.col("all")).alias("all"))
        return _hashed(held.select(*KEY, F.array_join(F.transform("all", lambda x: x["text"]), "").alias("body"), F.size("all").cast("long").alias("lines")))
    shared = F.pmod(F.xxhash64(*KEY), F.lit(buckets)).alias("bucket")
    grouped = rows.withWatermark("at", delay).select("*", F.unix_micros("at").alias("us"), shared).groupBy("bucket")
    pieces = grouped.applyInPandasWithState(_objects(delay_ms), _PIECES, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return _hashed(pieces)


def _hashed(pieces: DataFrame) -> DataFrame:
    whole = pieces.withColumn("source_text", with_create(F.col("body")))
    return whole.select(*KEY, "source_text", F.sha2("source_text", 256).alias("source_hash"), "lines")


def windowed(events: DataFrame, at: str, by: list[str], value: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """A stream of counts and sums (decimal) of a stream by tumbling window and columns: window_start, by, n, total. Each batch gives the windows that it changed."""
    counted = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(28,6)")).alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def into(stream: DataFrame, journal: Journal, name: str, checkpoint: str, **trigger: Any) -> StreamingQuery:  # noqa: ANN401
    """Start writing a stream of changed rows to a journal, each batch under its number; without a trigger, what is available now."""

    def write(batch: DataFrame, number: int) -> None:
        if not journal.upsert(batch, name, number):
            batch.write.format("noop").mode("overwrite").save()  # state must be brought up to the batch in any case

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).queryName(name).trigger(**(trigger or {"availableNow": True})).start()
