"""Document fingerprints by I-Match with randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies in a band, counted over all documents.
Each of several random subsets of it gives one hash of a text: of the text's distinct terms in the subset.
Two texts are as alike as the share of subsets in which their hashes agree; a subset that neither text has a
term of does not count. Subsets are of several densities, so that short and long texts each have some that hold
a few of their terms. A term's subsets follow from a hash of the term. The densest subsets together hold every
term, so all terms of all texts are counted and looked up; lists of terms are not stored for single texts.
A range of texts is told which of its terms the lexicon leaves out: those are the fewer, and all others are in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import discard, stash, table

#: Random lexicon subsets of each density.
SUBSETS = 16

#: Densities: a subset holds one in 2^bits terms, by that many bits of a term's hash from the shift on.
DENSITIES = ((0, 4), (4, 7), (11, 10))

#: The band: a term stands in at least this many documents, and in at most this share of them.
LEAST, MOST = 2, 0.2

#: Bytes of text that a range of ids holds, about, and the most ranges that ids are dealt to (a few numbers of each are known to the driver and the plan).
RANGE, RANGES = 32 << 20, 1 << 16

#: Terms of a range that a task counts before it passes them on.
HELD = 2_000_000


def words_of(text: str) -> set[bytes]:
    return set(text.encode().lower().split())


def hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def mixed_bits(terms: np.ndarray) -> np.ndarray:
    mixed = (terms ^ (terms >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def whole_hash(terms: np.ndarray, words: set[bytes]) -> str:
    """A hash of all terms of the lexicon that a text has, whatever their order; of a text that has none, of all its terms."""
    if len(terms):
        return f"{int(mixed_bits(terms).sum()):016x}"
    return xxhash.xxh64_hexdigest(b" ".join(sorted(words)))


def subset_hashes(terms: np.ndarray) -> np.ndarray:
    """For each subset the hash of its terms among these (distinct) ones, whatever their order; 0 without any."""
    out = np.zeros((len(DENSITIES), SUBSETS), np.uint64)
    mixed = mixed_bits(terms)
    for level, (shift, bits) in enumerate(DENSITIES):
        subset = (terms >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        inside = subset < SUBSETS
        np.add.at(out[level], subset[inside].astype(np.int64), mixed[inside])
    return out.ravel()


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by as many characters from the beginning of another, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def likeness(a: tuple[str, np.ndarray], b: tuple[str, np.ndarray]) -> float:
    """0 to 1, of fingerprints (hash of all terms of the lexicon, subset hashes): 1 for equal ones; else the share of subsets with equal hashes among those that either text has terms of."""
    used = (a[1] != 0) | (b[1] != 0)
    same = a[1] == b[1]
    if a[0] == b[0] and same.all():
        return 1.0
    return float((used & same).sum() / used.sum()) if used.any() else 0.0


def printed(fingerprint: tuple[str, np.ndarray]) -> str:
    """A fingerprint as text: the hash of its terms in the lexicon, then for each subset the hash of its terms in the lexicon, or `-`."""
    return ".".join([fingerprint[0], *(f"{x:016X}" if x else "-" for x in fingerprint[1].tolist())])


#: Kinds of rows, in the order in which a range's rows come.
OUTSIDE, OWN, LENT = 0, 1, 2

_MET = "part int, term long, n long"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (part, kind, doc_id, text, terms), sorted within part: the terms that a part's fingerprints ask for, and how many of its own texts hold each.

    A part with very many terms gives some of them more than once.
    """
    held: tuple[int, int, str, set[bytes]] | None = None
    own: list[np.ndarray] = []
    more: list[np.ndarray] = []
    size = 0

    def passed(part: int) -> pa.RecordBatch:
        nonlocal size
        none = [np.zeros(0, np.uint64)]
        terms, n = np.unique(np.concatenate(own or none), return_counts=True)
        rest = np.setdiff1d(np.concatenate(more or none), terms)
        own.clear()
        more.clear()
        size = 0
        both = np.concatenate((terms, rest)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(both), part, np.int32)), pa.array(both), pa.array(np.concatenate((n, np.zeros(len(rest), np.int64))), pa.int64())], names=["part", "term", "n"])

    for b in batches:
        for part, kind, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
            if held is not None and (held[0] != part or size > HELD):
                yield passed(held[0])
            if kind == LENT and (held is None or held[0] != part or held[1] == LENT):
                held = (part, kind, "", set())
                continue
            t = text.as_py() or ""
            words = words_of(t)
            (own if kind == OWN else more).append(hashes(words))
            size += len(words)
            if held is not None and held[0] == part:
                # words that the edit cuts or joins
                more.append(hashes(words_of(edited(held[2], t)) - held[3] - words))
            held = (part, kind, t, words)
    if held is not None:
        yield passed(held[0])


_PRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (part, kind, doc_id, text, terms), sorted within part: each own row with what follows from its text and the next one's.

    A part's terms outside the lexicon come first; all others are in it. Lent rows belong to the next part (to the last part: to the first) and only end this one.
    """
    held: tuple[int, int, int | None, str, dict[bytes, int], tuple[str, np.ndarray]] | None = None
    lists: list[np.ndarray] = []
    outside, outside_of = np.zeros(0, np.uint64), None
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def fingerprint(words: set[bytes], terms: np.ndarray) -> tuple[str, np.ndarray]:
        if len(outside):
            terms = terms[outside[np.minimum(np.searchsorted(outside, terms), len(outside) - 1)] != terms]
        return whole_hash(terms, words), subset_hashes(terms)

    for b in batches:
        out: list[tuple] = []
        for part, kind, doc, text, terms in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4), strict=True):
            if part != outside_of:
                outside_of, lists, held, outside = part, [], None, np.zeros(0, np.uint64)
            if kind == OUTSIDE:
                lists.append(terms.values.to_numpy().view(np.uint64))
                continue
            if lists:
                outside, lists = np.sort(np.concatenate(lists)), []
            if kind == LENT and (held is None or held[1] == LENT):
                continue
            t = text.as_py() or ""
            words = words_of(t)
            h = hashes(words)
            own = fingerprint(words, h)
            by = dict(zip(words, h.tolist(), strict=True))
            if held is not None:
                e = edited(held[3], t)
                e_words = words_of(e)
                e_terms = np.array([held[4].get(w) or by.get(w) or xxhash.xxh64_intdigest(w) for w in e_words], np.uint64)
                changed = fingerprint(e_words, e_terms)
                out.append((held[2], len(held[3]), hashlib.sha256(e.encode()).hexdigest(), printed(held[5]), printed(changed), likeness(held[5], changed), likeness(held[5], own)))
            held = (part, kind, doc, t, by, own)
        cols = list(zip(*out, strict=True)) if out else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types, strict=True)], names=[f.split()[0] for f in _PRINTS.split(", ")])


def _numbers(found: list[int]) -> Column:
    """Numbers as one constant array."""
    return F.split(F.lit(",".join(map(str, found))), ",").cast("array<bigint>")


def _range(cuts: list[int]) -> Column:
    """0 for a null doc_id, else 1 + the number of cuts (ascending) that are <= doc_id, by binary search."""
    if not cuts:
        return F.when(F.col("doc_id").isNull(), 0).otherwise(1).cast("int")
    array, bits = _numbers(cuts), len(cuts).bit_length()
    steps = F.array(*[F.lit(1 << x) for x in range(bits - 1, -1, -1)])
    onward = lambda at, step: F.when((at + step <= len(cuts)) & (F.get(array, at + step - 1) <= F.col("doc_id")), at + step).otherwise(at)
    return F.when(F.col("doc_id").isNull(), 0).otherwise(1 + F.aggregate(steps, F.lit(0), onward)).cast("int")


def dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (part, kind, doc_id, text, h, terms) of ranges of ids, and the number of documents; next is by ascending doc_id, then a hash of the text; after the last, the first.

    Ranges of ids hold about RANGE bytes each, or 1 / RANGES of all; an id (or null) that alone fills several ranges is
    split by the hash. The first row of a range also ends the range before it: it is found from ids and hashes alone,
    and the row is lent to that range, so neighbours meet without a global sort of texts. Of each range only its size,
    its first id and hash come to the driver.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    each = max(RANGE, -(-int(size) // RANGES))
    many = max(1, min(int(n), -(-int(size) // each)))
    cuts = sorted({int(x) for x in rows.approxQuantile("doc_id", [x / many for x in range(1, many)], 0.1 / many)}) if many > 1 else []
    ranges = rows.withColumn("range", _range(cuts))
    found = ranges.groupBy("range").agg(F.sum(F.octet_length("text")).alias("size"), (F.max("doc_id") > F.min("doc_id")).alias("ids")).collect()  # a row for each range
    split = [1] * (len(cuts) + 2)
    for r in found:
        split[r["range"]] = 1 if r["ids"] else max(1, -(-r["size"] // each))
    base = np.concatenate(([0], np.cumsum(split)[:-1])).tolist()
    k = F.get(_numbers(split), F.col("range"))
    nth = F.least(k - 1, F.floor((F.col("h").cast("double") / float(1 << 64) + 0.5) * k))
    parts = ranges.withColumn("part", (F.get(_numbers(base), F.col("range")) + nth).cast("int")).drop("range")
    none = F.lit(None).cast("array<long>").alias("terms")
    own = parts.select("part", F.lit(OWN).alias("kind"), "doc_id", "text", "h", none)
    firsts = sorted((r["part"], r["first"]) for r in parts.groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("first")).collect())  # a row for each part
    if not firsts:
        return own, 0
    # the rows that begin a part, lent to the part before; those that begin the first one to the last
    ids, hs, to = ([0] * sum(split) for _ in range(3))
    for x, (part, first) in enumerate(firsts):
        ids[part], hs[part], to[part] = first["doc_id"] or 0, first["h"], firsts[x - 1][0]
    begins = F.coalesce("doc_id", F.lit(0)) == F.get(_numbers(ids), F.col("part"))
    lent = parts.where(begins & (F.col("h") == F.get(_numbers(hs), F.col("part"))))
    return own.unionByName(lent.select(F.get(_numbers(to), F.col("part")).cast("int").alias("part"), F.lit(LENT).alias("kind"), "doc_id", "text", "h", none)), int(n)


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("part")).sortWithinPartitions("part", "kind", F.col("doc_id").asc_nulls_first(), "h").drop("h")


def imatch(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, its edited text's, and how alike they and the next document's are.

    docs: doc_id, text. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. A null text is empty. Rows of one id follow by a hash of the text; null ids come first. One row
    alone is its own next. A text without terms in the lexicon has only the hash of all its terms. No rows: no
    result. Columns other than doc_id and text are not read.

    Texts move twice, in ranges of ids: for their terms, and, with the range's terms outside the lexicon, for their fingerprints.
    """
    rows, n = dealt(docs)
    if not n:
        return docs.sparkSession.createDataFrame([], _PRINTS)
    met = stash(_in_order(rows).mapInArrow(_met, _MET))
    # a term's documents are summed over the parts that hold it: one shuffle gives both the lexicon and who asks for it
    everywhere = met.withColumn("all", F.sum("n").over(W.partitionBy("term"))).where((F.col("all") < LEAST) | (F.col("all") > max(LEAST, MOST * n)))
    left_out = stash(everywhere.groupBy("part", F.pmod("term", F.lit(16)).alias("list")).agg(F.collect_set("term").alias("terms")).select("part", "terms"))
    discard(met)
    outside = left_out.select("part", F.lit(OUTSIDE).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("h"), "terms")
    return _in_order(rows.unionByName(outside)).mapInArrow(_prints, _PRINTS)


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch(table(spark, sf_dir, "documents"))
