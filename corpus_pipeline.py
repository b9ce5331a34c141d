"""A corpus pipeline: quality classifier, near-duplicate join, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm import jaccard_join, mixing, packing, quality
from plumbline.llm.common import discard, stash, table

#: Near duplicates of the join stage: shingles of five words, similarity of 0.8 or more.
SHINGLE, NUM, DEN = 5, 80, 100


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name += "_"
    return name


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the line field predicts to be good. It learns from the labelled rows of `documents` that op6 learns from.

    A null or empty text is one empty line; rows with equal texts stay or go together, and extra columns pass through.
    """
    labels = table(spark, sf_dir, "labels").where(~quality.held_out())
    field = quality.train(table(spark, sf_dir, "documents"), labels)
    score = _free(docs, "_score")
    return quality.score(docs, field, docs.columns, score).where(F.col(score) >= 0.5).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: that with the smallest id, null ids last.

    Ids need not tell rows apart: a row is known by its id and a hash of its text, so rows of other groups stay,
    whatever their ids. Different texts of one id in a group follow by that hash, and equal rows by chance: one
    of them stays. Documents without words are groups of their own: all stay. Extra columns pass through.
    """
    doc, key, nth = (_free(docs, c) for c in ("_doc", "_key", "_nth"))
    found = jaccard_join.keyed_components(docs.select("doc_id", "text", F.xxhash64("text").alias("_key")), "_key", SHINGLE, NUM, DEN)
    firsts = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct("doc", "key")).alias("first"))
    kept = stash(firsts.select(F.col("first.doc").alias(doc), F.col("first.key").alias(key)))
    has_words = F.coalesce(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    rows = docs.where(has_words).withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(jaccard_join.NO_ID)), key: F.xxhash64("text")})
    # equal rows only: each task passes on one of them
    one = rows.withColumn(nth, F.row_number().over(W.partitionBy(doc, key).orderBy("doc_id"))).where(F.col(nth) == 1).join(kept, [doc, key], "left_semi")
    return one.select(*docs.columns).unionByName(docs.where(~has_words))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does: up to three times, or not at all. Empty texts add no words and go with their length's share."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; a null or empty text is its end id alone."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("quality classifier", classify), ("n-gram jaccard join", deduplicate), ("mixing sources to target weights", mix), ("packing", pack)]

#: The classifier, the join and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has read is deleted when its own result is written, but for the given table and the last stage's input."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
