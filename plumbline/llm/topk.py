"""Exact top-k search by term-at-a-time accumulation.

Vectors are sparse rows of weighted terms (here: their components). Candidates form blocks that hold one
posting list per term; a query adds weight times posting into a dense array of scores, one term after the
other, then takes its k best by partition selection. Each pair of a query block and a candidate block is
one row of Spark work; the blocks' winners merge by a ranking window per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import stash, table

#: Rows in a block: a query block's postings sums and a candidate block's postings stay in the CPU's caches.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192

#: A posting list that covers this share of its block is kept as a dense column.
DENSE = 0.25


def _block(t: pa.Table) -> pa.Table:
    """One row for a block: ids in ascending order, with the rows' values as a flat array."""
    order = np.argsort(t.column("id").to_numpy(), kind="stable")
    t = t.take(pa.array(order))
    values = t.column("terms").combine_chunks()
    sizes = np.diff(values.offsets.to_numpy()).astype(np.int32)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    cells = [t.column("block")[0].as_py(), t.column("id").to_numpy().astype(np.int64).tobytes(), sizes.tobytes(), flat.tobytes()]
    return pa.table({k: pa.array([x], type=y) for (k, y), x in zip(_BLOCK, cells, strict=True)})


_BLOCK = [("block", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("flat", pa.binary())]


def _rows(ids: bytes, sizes: bytes, flat: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and a matrix of term weights; what a short row lacks is 0."""
    n = np.frombuffer(sizes, np.int32)
    m = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    m[np.arange(m.shape[1]) < n[:, None]] = np.frombuffer(flat, np.int64)
    return np.frombuffer(ids, np.int64), m


def search_block(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of the block, without rows of its own id: query ids, candidate ids, scores. ids ascend."""
    terms = min(queries.shape[1], rows.shape[1])
    postings: list[tuple[np.ndarray | None, np.ndarray]] = []
    for d in range(terms):
        col = np.ascontiguousarray(rows[:, d])
        at = np.flatnonzero(col)
        postings.append((None, col) if len(at) >= DENSE * len(col) else (at, col[at]))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    scores, part = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for q, row in zip(q_ids, queries, strict=True):
        scores[:] = 0
        for d in np.flatnonzero(row[:terms]):
            at, weights = postings[d]
            if at is None:
                np.multiply(weights, row[d], out=part)
                scores += part
            else:
                scores[at] += weights * row[d]
        lo, hi = np.searchsorted(ids, q, "left"), np.searchsorted(ids, q, "right")
        want = min(len(ids), k + hi - lo)
        least = np.partition(scores, len(ids) - want)[len(ids) - want]
        at = np.flatnonzero(scores >= least)
        at = at[(at < lo) | (at >= hi)]
        at = at[np.lexsort((at, -scores[at]))][:k]  # ids ascend with positions
        out.append((np.full(len(at), q), ids[at], scores[at]))
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def exact_topk(df: DataFrame, id_col: str, terms: Column, is_query: Column, k: int = 20) -> DataFrame:
    """Each query's k best rows by inner product: query_id, rank (from 1), id_col, score.

    df: rows with a long id; terms: array of long weights by term; is_query: which rows are queries; the
    others stay candidates too. Every query meets every row but those of its own id; ties go to the smaller
    id. Rows with a null id or null terms take no part; a row shorter than another has weight 0 in what it
    lacks. A repeated id is several candidates; queries of one id and equal terms count once, and of one id
    and different terms share one ranking. Products wrap as 64-bit integers do. No rows: no result.
    """
    v = df.select(F.col(id_col).cast("long").alias("id"), terms.alias("terms"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and terms is not null")
    v = stash(v)
    n, n_q = v.agg(F.count("*"), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0))).first()
    c_blocks, q_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-n_q // QUERY_BLOCK))
    schema = "block long, ids binary, sizes binary, flat binary"

    def blocks(rows: DataFrame, many: int) -> DataFrame:
        return rows.withColumn("block", F.pmod(F.xxhash64("id", "terms"), F.lit(many))).groupBy("block").applyInArrow(_block, schema)

    cand = blocks(v.select("id", "terms"), c_blocks).select(F.col("block").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)).cast("array<bigint>")).alias("q"), "ids", "sizes", "flat")
    ask = blocks(v.where("q").select("id", "terms").distinct(), q_blocks).select(F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)).cast("array<bigint>")).alias("c"), F.col("ids").alias("q_ids"), F.col("sizes").alias("q_sizes"), F.col("flat").alias("q_flat"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in range(b.num_rows):
                r = {c: b.column(c)[x].as_py() for c in b.schema.names}
                found = search_block(*_rows(r["q_ids"], r["q_sizes"], r["q_flat"]), *_rows(r["ids"], r["sizes"], r["flat"]), k)
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int64()) for y in found], names=["query_id", "id", "score"])

    best = ask.join(cand, ["q", "c"]).select("q_ids", "q_sizes", "q_flat", "ids", "sizes", "flat").mapInArrow(search, "query_id long, id long, score long")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def quantised(vector: str, scale: int = 64) -> Column:
    """floor(scale * x) of each component as a double; null where the vector or a component is null or not finite."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.when(~bad, F.transform(x, lambda e: F.floor(e * scale).cast("long")))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return exact_topk(df, "vec_id", quantised("embedding"), F.col("vec_id") % 20 == 0, 20)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
