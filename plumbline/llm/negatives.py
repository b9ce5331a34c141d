"""Hard-negative mining by a secondary sort of pair scores.

Anchors are a stated set of queries, scored against all rows in blocks. A first pass finds each anchor's positives: its
best rows of the same label. A second pass keeps of each block the pairs that can be a negative of one of them: the
best few of each positive's window of scores. These pairs and the positives go to their anchor's partition, sorted by
anchor, falling score, positives before others, and id. One iterator reads them: a positive opens a window, later rows
of another label are told to all windows that they fall into, and a full window closes. Its state is a few windows;
no anchor's pairs are ever held together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import stash, table
from plumbline.llm.topk import quantised

#: Anchors and rows of a block; scores that a task holds at once.
ANCHOR_BLOCK, ROW_BLOCK, SCORES = 1024, 8192, 2_000_000

_BLOCK = "block long, ids binary, labels binary, sizes binary, flat binary"


def _block(t: pa.Table) -> pa.Table:
    """One row for a block, its rows by id."""
    t = t.take(pa.array(np.argsort(t.column("id").to_numpy(), kind="stable")))
    values = t.column("terms").combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    cells = [t.column("block")[0].as_py(), *(t.column(c).to_numpy().astype(np.int64).tobytes() for c in ("id", "label")), np.diff(values.offsets.to_numpy()).astype(np.int32).tobytes(), flat.tobytes()]
    return pa.table({c: pa.array([x]) for c, x in zip(("block", "ids", "labels", "sizes", "flat"), cells, strict=True)})


class Block:
    """Ids, labels and a matrix of weights; what a short row lacks is 0."""

    def __init__(self, ids: bytes, labels: bytes, sizes: bytes, flat: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        n = np.frombuffer(sizes, np.int32)
        self.rows = np.zeros((len(n), int(n.max(initial=0))), np.int64)
        self.rows[np.arange(self.rows.shape[1]) < n[:, None]] = np.frombuffer(flat, np.int64)


def scores(a: Block, b: Block) -> Iterator[tuple[slice, np.ndarray]]:
    """Inner products of a's rows with b's, some rows of a at a time: as doubles where no sum can exceed what they hold, else as 64-bit integers that wrap."""
    terms = min(a.rows.shape[1], b.rows.shape[1])
    x, y = a.rows[:, :terms], b.rows[:, :terms]
    largest = [max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))) for m in (x, y)]
    if largest[0] * largest[1] * terms < 1 << 53:
        x, y = x.astype(np.float64), y.astype(np.float64)
    step = max(1, SCORES // max(1, len(y)))
    for lo in range(0, len(x), step):
        yield slice(lo, lo + step), (x[lo : lo + step] @ y.T).astype(np.int64)


def best(score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the positions at, which ascend, the k of the highest scores, ties to the smaller position."""
    if len(at) > k:
        own = score[at]
        at = at[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return at[np.lexsort((at, -score[at]))][:k]


_PAIR = [("anchor", pa.int64()), ("row", pa.int64()), ("score", pa.int64()), ("id", pa.int64()), ("same", pa.bool_())]
_PAIRS = "anchor long, row long, score long, id long, same boolean"


def _search(pick: Callable[[Block, Block, int, np.ndarray, list[int]], np.ndarray], same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over a block of anchors (with the scores of their positives, if known) beside a block of rows: pairs that pick chooses for each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(batch.num_rows):
                r = {c: batch.column(c)[x].as_py() for c in batch.schema.names}
                a, b = Block(*(r[f"a_{c}"] for c in ("ids", "labels", "sizes", "flat"))), Block(*(r[c] for c in ("ids", "labels", "sizes", "flat")))
                rows, counts, known = (np.frombuffer(r[c], np.int64) for c in ("a_rows", "a_counts", "a_known"))
                ends = np.cumsum(counts)
                out: list[tuple[np.ndarray, ...]] = []
                for part, s in scores(a, b):
                    for i in range(len(s)):
                        n = part.start + i
                        at = pick(a, b, n, s[i], known[ends[n] - counts[n] : ends[n]].tolist())
                        out.append((np.full(len(at), a.ids[n]), np.full(len(at), rows[n]), s[i][at], b.ids[at], np.full(len(at), same)))
                cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, (_, k) in zip(cols, _PAIR, strict=True)], names=[c for c, _ in _PAIR])

    return run


def _positives(k: int) -> Callable[[Block, Block, int, np.ndarray, list[int]], np.ndarray]:
    def pick(a: Block, b: Block, n: int, score: np.ndarray, known: list[int]) -> np.ndarray:
        return best(score, np.flatnonzero((b.labels == a.labels[n]) & (b.ids != a.ids[n])), k)

    return pick


def _negatives(k: int, low: int, high: int, den: int) -> Callable[[Block, Block, int, np.ndarray, list[int]], np.ndarray]:
    def pick(a: Block, b: Block, n: int, score: np.ndarray, known: list[int]) -> np.ndarray:
        found: list[np.ndarray] = []
        for p in set(known):
            least, most = -(-low * p // den), high * p // den
            if least <= most:
                found.append(best(score, np.flatnonzero((score >= least) & (score <= most) & (b.labels != a.labels[n])), k))
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    return pick


_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _mined(k: int, low: int, high: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over sorted pairs: each positive's first k negatives. Carried on from batch to batch: the anchor, and its open windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, windows = None, []
        for b in batches:
            out: list[tuple] = []
            for anchor, row, score, key, same in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if of != (anchor, row):
                    of, windows = (anchor, row), []
                if same:
                    windows.append([key, score, 0])
                    continue
                for w in windows:
                    if low * w[1] <= den * score <= high * w[1]:
                        w[2] += 1
                        out.append((anchor, w[0], w[2], key, w[1], score))
                windows = [w for w in windows if w[2] < k and low * w[1] <= den * score]
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in _MINED.split(", ")])

    return run


def hard_negatives(df: DataFrame, id_col: str, label: Column, terms: Column, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, den: int = 100) -> DataFrame:
    """Each anchor's positives with their hard negatives: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A row's score is its inner product with the anchor (terms: array of long weights; a missing weight is 0; products wrap
    as 64-bit integers do). Higher scores come first, ties by the smaller id. An anchor's positives are its first
    `positives` rows of another id and the same label; a positive's negatives are its first rows of another label with
    low * positive_score <= den * score <= high * positive_score, where high is at most den. A positive without such rows
    is in no row.

    Rows with a null id, label or terms take no part. Equal rows count once. A repeated id with other terms or another
    label is a row of its own, as anchor and as candidate; its anchors' rows all bear its id. Extra columns are ignored.
    No rows: no result.
    """
    if not 0 <= low <= high <= den:
        raise ValueError("a window ends at the positive's score or below: 0 <= low <= high <= den")
    v = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), terms.alias("terms"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    v = stash(v.where("id is not null and label is not null and terms is not null").distinct())
    n, n_a = v.agg(F.count("*"), F.count_if("is_anchor")).first()
    r_blocks, a_blocks = max(1, -(-n // ROW_BLOCK)), max(1, -(-n_a // ANCHOR_BLOCK))
    row = F.xxhash64("id", "label", "terms")
    rows = stash(v.withColumn("block", F.pmod(row, F.lit(r_blocks))).select("block", "id", "label", "terms").groupBy("block").applyInArrow(_block, _BLOCK))
    anchors = v.where("is_anchor").select("id", "label", "terms", row.alias("row"))

    def beside(known: DataFrame | None, pick: Callable, same: bool) -> DataFrame:
        """The blocks of anchors, and only those, are sent to all blocks of rows."""
        a = anchors.withColumn("known", F.array().cast("array<bigint>")) if known is None else anchors.join(known, ["id", "row"])
        a = a.groupBy(F.pmod("row", F.lit(a_blocks)).alias("a")).applyInArrow(_anchor_block, ", ".join(f"a_{c} binary" for c in ("ids", "labels", "sizes", "flat", "rows", "counts", "known")))
        a = a.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(r_blocks - 1)).cast("array<bigint>")))
        return a.join(rows.hint("merge"), "block").drop("block").mapInArrow(_search(pick, same), _PAIRS)

    first = W.partitionBy("anchor", "row").orderBy(F.desc("score"), "id")
    found = stash(beside(None, _positives(positives), True).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= positives).drop("nth"))
    known = found.groupBy(F.col("anchor").alias("id"), "row").agg(F.collect_list("score").alias("known"))
    pairs = found.unionByName(beside(known, _negatives(negatives, low, high, den), False))
    ordered = pairs.repartition("anchor", "row").sortWithinPartitions("anchor", "row", F.desc("score"), F.desc("same"), "id")
    return ordered.mapInArrow(_mined(negatives, low, high, den), _MINED)


def _anchor_block(t: pa.Table) -> pa.Table:
    t = t.take(pa.array(np.argsort(t.column("id").to_numpy(), kind="stable")))
    own = _block(t.append_column("block", pa.array(np.zeros(t.num_rows, np.int64))))
    known = t.column("known").combine_chunks()
    cells = [t.column("row").to_numpy().astype(np.int64), np.diff(known.offsets.to_numpy()).astype(np.int64), known.flatten().to_numpy(zero_copy_only=False).astype(np.int64)]
    return pa.table({**{f"a_{c}": own.column(c) for c in ("ids", "labels", "sizes", "flat")}, **{f"a_{c}": pa.array([x.tobytes()]) for c, x in zip(("rows", "counts", "known"), cells, strict=True)}})


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), "vec_id", label, quantised("embedding", 256), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id OR a.label <> c.label WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), r AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5
"""
