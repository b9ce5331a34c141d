"""A table kept as a log of signed changes: replay-safe writes, reads of any past write, row histories, changes since a write.

Each write is a segment of rows, signed -1 (an old image that leaves) or 1 (a new image), and one log file that names it.
A write costs what it changes, not what the table holds; readers take the latest image of each key. The log file appears
last and at once, so a failed write changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

_LOG = "seq long, at timestamp, kind string, segment string, stream string, batch long"


class Journal:
    """key: what rows are known by; schema: of its rows, key included. One writer at a time: a second one's write fails."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: StructType | str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = self.schema.fieldNames()

    def log(self) -> DataFrame:
        """Writes so far: seq (from 1), at, kind (delta, base or fold), segment, stream, batch."""
        fs, path = self._file("log")
        return self.spark.read.schema(_LOG).json(f"{self.path}/log") if fs.exists(path) else self.spark.createDataFrame([], _LOG)

    def _file(self, name: str) -> tuple:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(sc._jsc.hadoopConfiguration()), path

    def _entries(self) -> list:
        return sorted(self.log().collect(), key=lambda r: (r["seq"], r["kind"] == "base"))

    def last(self) -> int:
        return max((e["seq"] for e in self._entries()), default=0)

    def seq_at(self, at: object) -> int:
        """The last write at this time (a timestamp, or a text of one) or before."""
        return self.log().where((F.col("kind") == "delta") & (F.col("at") <= F.lit(at).cast("timestamp"))).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]

    def _written(self, rows: DataFrame, seq: int, kind: str, stream: str | None = None, batch: int | None = None) -> None:
        segment = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/segments/{segment}")
        entry = {"seq": seq, "at": self.spark.range(1).select(F.current_timestamp().cast("string")).first()[0], "kind": kind, "segment": segment, "stream": stream, "batch": batch}
        fs, path = self._file(f"log/{seq:020d}-{kind}.json")
        out = fs.create(path, False)  # fails where there is one
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()

    def _read(self, entries: list) -> DataFrame:
        full = StructType([*self.schema.fields, StructField("_seq", LongType()), StructField("_sign", IntegerType())])
        paths = [f"{self.path}/segments/{e['segment']}" for e in entries]
        return self.spark.read.schema(full).parquet(*paths) if paths else self.spark.createDataFrame([], full)

    def done(self, stream: str, batch: int) -> bool:
        return any(e["stream"] == stream and e["batch"] >= batch for e in self._entries() if e["stream"] is not None)

    def append(self, signed: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
        """Add changes (this table's columns and _sign); one of a stream's batch that was added before changes nothing (False).

        An update is an old and a new image, an insertion a new one, a deletion an old one. A key that leaves and comes in
        one write is there after it; of several new images of a key the greatest counts.
        """
        if stream is not None and batch is not None and self.done(stream, batch):
            return False
        seq = self.last() + 1
        rows = signed.select(*(F.col(c).cast(self.schema[c].dataType) for c in self.columns), F.lit(seq).cast("long").alias("_seq"), F.col("_sign").cast("int"))
        self._written(rows, seq, "delta", stream, batch)
        return True

    def upsert(self, new: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
        """Add the rows of new that differ from the present ones, with those as their old images. A null key is a key too."""
        if stream is not None and batch is not None and self.done(stream, batch):
            return False
        best = new.groupBy(*self.key).agg(F.max(F.struct(*self.columns)).alias("new"))
        old = self.read().select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(self.key)), F.struct(*self.columns).alias("old"))
        on = [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(self.key)]
        both = best.join(old, on, "left").where(~F.col("new").eqNullSafe(F.col("old")))
        sides = F.array(F.struct(F.lit(-1).alias("_sign"), F.col("old").alias("row")), F.struct(F.lit(1).alias("_sign"), F.col("new").alias("row")))
        signed = both.select(F.explode(sides).alias("x")).where("x.row is not null").select("x.row.*", "x._sign")
        return self.append(signed, stream, batch)

    def delete(self, keys: DataFrame) -> bool:
        """Delete the rows of these keys."""
        k = keys.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(self.key)))
        on = [F.col(c).eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate(self.key)]
        return self.append(self.read().join(k, on, "left_semi").withColumn("_sign", F.lit(-1)))

    def read(self, seq: int | None = None) -> DataFrame:
        """The rows after a write (after all: None), those of write 0 being none; a later compaction doesn't matter."""
        entries = [e for e in self._entries() if e["kind"] != "fold" and (seq is None or e["seq"] <= seq)]
        bases = [n for n, e in enumerate(entries) if e["kind"] == "base"]
        latest = self._read(entries[bases[-1] :] if bases else entries).groupBy(*self.key).agg(F.max(F.struct("_seq", "_sign", *self.columns)).alias("row"))
        return latest.where("row._sign = 1").select(*(F.col(f"row.{c}").alias(c) for c in self.columns))

    def as_of(self, at: object) -> DataFrame:
        """The rows at a time."""
        return self.read(self.seq_at(at))

    def changes(self, since: int = 0, until: int | None = None) -> DataFrame:
        """Signed rows of the writes after since, up to until: _seq, _sign and the columns. Nothing else is read."""
        last = self.last() if until is None else until
        entries = [e for e in self._entries() if e["kind"] != "base"]
        folds = [e["seq"] for e in entries if e["kind"] == "fold" and e["seq"] <= last and not since]
        return self._read([e for e in entries if since < e["seq"] <= last and (e["kind"] == "fold" and e["seq"] == folds[-1] or e["kind"] == "delta" and e["seq"] > folds[-1] if folds else e["kind"] == "delta")])

    def fold(self, add_up: Callable[[DataFrame], DataFrame]) -> None:
        """Write what add_up makes of all changes so far as one segment, which later reads of all changes begin with: for changes that only their sums matter of."""
        last = self.last()
        if last and not any(e["kind"] == "fold" and e["seq"] == last for e in self._entries()):
            self._written(add_up(self.changes()).select(*self.columns, F.lit(last).cast("long").alias("_seq"), "_sign"), last, "fold")

    def versions(self, low: int = 0, high: int | None = None) -> DataFrame:
        """Histories of rows between two writes: the columns, first_seq and last_seq, first_at and last_at, and operation (I, U or D).

        A version holds from its write up to the one before the key's next one (null: it holds still). A deletion is a row of
        the old image at its write. Versions that ended before low or began after high are left out. A key's history
        has a row for each write at most.
        """
        high = self.last() if high is None else high
        image = F.max(F.struct("_sign", *self.columns)).alias("row")
        rows = self._read([e for e in self._entries() if e["kind"] == "delta" and e["seq"] <= high]).groupBy(*self.key, "_seq").agg(image, (F.min("_sign") == -1).alias("had"))
        w = W.partitionBy(*self.key).orderBy("_seq")
        kind = F.when(F.col("row._sign") == -1, "D").when(F.col("had"), "U").otherwise("I")
        whole = rows.select(*(F.col(f"row.{c}").alias(c) for c in self.columns), F.col("_seq").alias("first_seq"), kind.alias("operation"), (F.lead("_seq").over(w) - 1).alias("next"))
        whole = whole.withColumn("last_seq", F.when(F.col("operation") == "D", F.col("first_seq")).otherwise(F.col("next"))).drop("next")
        whole = whole.where((F.col("first_seq") <= high) & (F.col("last_seq").isNull() | (F.col("last_seq") >= low)))
        times = self.log().where("kind = 'delta'").select("seq", "at")
        first = times.select(F.col("seq").alias("first_seq"), F.col("at").alias("first_at"))
        after = times.select((F.col("seq") - 1).alias("last_seq"), F.col("at").alias("last_at"))  # a version ends when the next begins
        return whole.join(first, "first_seq", "left").join(after, "last_seq", "left").select(*self.columns, "operation", "first_seq", "last_seq", "first_at", "last_at")

    def compact(self) -> None:
        """Write the present rows as one segment that later reads begin with. Older segments stay for reads of past writes."""
        entries = [e for e in self._entries() if e["kind"] != "fold"]
        if not entries or entries[-1]["kind"] == "base":
            return
        seq = entries[-1]["seq"]
        self._written(self.read().select(*self.columns, F.lit(seq).cast("long").alias("_seq"), F.lit(1).alias("_sign")), seq, "base")
