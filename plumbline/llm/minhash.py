"""SuperMinHash near-duplicate detection: signatures, banding, verification on full sets, union-find grouping.

Each element of a set walks through a random permutation of the m slots, one slot a step, and offers step + r there,
r being uniform in [0, 1) and new in each step; a slot keeps the smallest offer. So one element's offers are
correlated, every slot gets another step of it, and the estimate of the Jaccard similarity varies less than with
independent hashes. Once all slots hold an offer of at most the steps taken, later steps can't change any of them, and
the walk stops: long texts need one or two steps. Steps are taken for all elements of many texts at once.

A band of 4 slots makes two sets of similarity s meet with probability s^4; that a pair of similarity 0.85 meets in none
of 32 bands has probability 6e-11, with these signatures less. Only sets of sizes that can link meet: the smaller one's
size says in which band of sizes. Sets that meet are compared exactly, and links are joined into components; equal sets
are one node from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import discard, stash, table
from plumbline.llm.jaccard_join import NO_ID, Threshold, _sets, connect, marks_of, node_of, shingles

#: Slots of a signature and of a band.
SLOTS, BAND = 128, 4

#: Elements whose walks a task holds at once, unless one text has more.
WALKS = 100_000

_G1, _G2, _G3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _draw(seeds: np.ndarray, step: int) -> np.ndarray:
    """64 random bits for each element and step."""
    with np.errstate(over="ignore"):
        x = seeds + np.uint64(step + 1) * _G1
        x = (x ^ (x >> np.uint64(30))) * _G2
        x = (x ^ (x >> np.uint64(27))) * _G3
        return x ^ (x >> np.uint64(31))


def signatures(sets: list[np.ndarray], m: int = SLOTS) -> np.ndarray:
    """A row of m offers for each of some sets that aren't empty: step and r as one number, step * 2^32 + r * 2^32."""
    sizes = np.array([len(s) for s in sets])
    out = np.full(len(sets) * m, np.iinfo(np.int64).max, np.int64)
    seeds, owner = (np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    perm: np.ndarray | None = None
    for step in range(m):
        bits = _draw(seeds, step)
        swap = step + ((bits >> np.uint64(32)) * np.uint64(m - step) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            slot = swap
        else:  # a step of Fisher and Yates' shuffle
            rows = np.arange(len(seeds))
            slot = perm[rows, swap].astype(np.int64)
            perm[rows, swap] = perm[:, step]
        np.minimum.at(out, owner * m + slot, (np.int64(step) << 32) + (bits & np.uint64(0xFFFFFFFF)).astype(np.int64))
        left = out.reshape(-1, m).max(axis=1) >= (step + 1) << 32
        if not left.any():
            break
        stay = left[owner]
        if perm is None:
            perm = np.tile(np.arange(m, dtype=np.uint16), (int(stay.sum()), 1))
            at = np.arange(len(perm))
            perm[at, slot[stay]] = 0
        elif not stay.all():
            perm = perm[stay]
        seeds, owner = seeds[stay], owner[stay]
    return out.reshape(-1, m)


def band_keys(signature: np.ndarray, rows: int = BAND) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signature.reshape(len(signature), -1, rows).astype(np.uint64)
    key = np.tile(np.arange(parts.shape[1], dtype=np.uint64) * _G3 + _G1, (len(parts), 1))
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = _draw(key ^ parts[:, :, k], k)
    return key.view(np.int64)


_SIGNED = "doc long, n long, node long, marks binary, keys array<long>"


def meeting_keys(sets: list[np.ndarray], threshold: Threshold, m: int, rows: int) -> list[np.ndarray]:
    """For each set, its bands' keys in each band of sizes that a linked pair with it can have; none where only equal sets link."""
    with np.errstate(over="ignore"):
        sized = [np.array([b for b, most in threshold.bands(len(s)) if most], np.uint64) * _G1 for s in sets]
        return [(k.view(np.uint64) ^ b[:, None]).view(np.int64).reshape(-1) for k, b in zip(band_keys(signatures(sets, m), rows), sized, strict=True)]


def _sign(n: int, threshold: Threshold, m: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (doc, text): each document's set size and node; of each node once in a task, or again after many others, marks and keys of bands."""

    def signed(sets: list[np.ndarray]) -> tuple[list[bytes], list[np.ndarray]]:
        return [marks_of(s, threshold) for s in sets], meeting_keys(sets, threshold, m, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            lo = 0
            docs, texts = b.column(0), b.column(1)
            while lo < b.num_rows:
                sizes: list[int] = []
                nodes: list[int | None] = []
                new: list[np.ndarray] = []
                at: list[int] = []
                elements = 0
                while lo + len(sizes) < b.num_rows and elements < WALKS:
                    s = shingles(texts[lo + len(sizes)].as_py(), n)
                    node = node_of(s) if len(s) else None
                    if node is not None and node not in seen:
                        seen.add(node)
                        at.append(len(sizes))
                        new.append(s)
                        elements += len(s)
                    sizes.append(len(s))
                    nodes.append(node)
                marks: list[bytes | None] = [None] * len(sizes)
                keys: list[np.ndarray | None] = [None] * len(sizes)
                for x, mk, k in zip(at, *signed(new), strict=True):
                    marks[x], keys[x] = mk, k
                yield pa.RecordBatch.from_arrays([docs.slice(lo, len(sizes)), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=[f.split()[0] for f in _SIGNED.split(", ")])
                lo += len(sizes)
            if len(seen) > 200_000:
                seen.clear()

    return run


def near_duplicates(docs: DataFrame, n: int = 3, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, band: int = BAND) -> DataFrame:
    """Each row's id, n_shingles, component_id (the smallest id of a document that links reach, its own included) and kept, whether it is that document.

    A-Z are lower-cased, words are runs of other than ASCII white space, and a document's set holds its distinct n-word
    shingles (fewer words: the whole sequence; none or null: the empty set, linked with nothing). Sets that share a band
    link when den * intersection >= num * union, by their full sets. Rows with equal sets are one node; rows of a
    repeated id tell their own text's component, and all rows of the smallest id are kept. A null id counts as larger
    than all others; a component of null ids alone is null, and its rows are kept. Extra columns are ignored. No rows:
    no result. Sets are compared by 64-bit hashes of shingles and known by 64 bits of a 128-bit hash.
    """
    t = Threshold(num, den)
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).alias("text"))
    made = stash(keyed.mapInArrow(_sign(n, t, slots, band), _SIGNED))
    nodes = stash(made.where("n > 0").groupBy("node").agg(F.min("doc").alias("least")))
    bands = made.where("keys is not null").select(F.explode("keys").alias("region"), "node").distinct()
    many = bands.groupBy("region").agg(F.count("*").alias("many")).where("many > 1")
    met = stash(bands.join(many, "region"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The set of each wanted node, from its smallest id; an id with several texts is told apart by its node."""
        ids = stash(wanted.join(nodes, "node"))
        some = keyed.join(ids.select(F.col("least").alias("doc")).distinct(), "doc", "left_semi")
        return some.mapInArrow(_sets(n), "node long, data binary").join(ids.select("node"), "node", "left_semi").dropDuplicates(["node"])

    roots = connect(met, made.select("node", "n", "marks"), sets_of, t)
    named = stash(roots.join(nodes, "node"))
    discard(met)
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    linked = named.select("node", "root").join(least, "root").select("node", "component")
    all_nodes = stash(nodes.join(linked, "node", "left").select("node", F.coalesce("component", "least").alias("component")))
    out = made.select("doc", "n", "node").join(all_nodes, "node", "left").withColumn("component", F.coalesce("component", "doc"))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(known("doc").alias(id_col), F.col("n").alias("n_shingles"), known("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
