"""Scoring of texts by a Brown class-based bigram model.

P(word | word before) = P(class | class before) * P(word | class). Classes come from exchange clustering:
the most frequent words start as classes of their own and all others in one class; then every word, those
frequent ones too, is exchanged into the class that raises the mutual information of neighbouring classes most,
given the class bigrams. Such rounds over all words at once are repeated until the mutual information rises by less
than SETTLED, at most ROUNDS times.

Words of a text are counted and looked up by blocks of documents: a block holds its texts' words as numbers into the
block's own list of distinct words. What blocks and words tell each other goes in buckets of words, a row for each block
and bucket, and is matched there by sorted arrays. The most frequent words, which stand in nearly every block, are summed
over all blocks of a task first. Every training text counts, and the tables of words grow with them; only the table of
classes is of fixed size.

An unknown word is one further type. A class gives it the share of its tokens that are words seen once, so
the probabilities of all known words and the unknown one sum to 1 after every word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import discard, remainder, stash, table

#: Number of classes: one for the end, one for unknown words, one that rare words start in, and one for each most frequent word.
CLASSES = 64
END, UNKNOWN, REST = 0, 1, 2

#: Bytes of text in a block.
BLOCK = 5 << 20

#: Rounds of exchange at most; the share by which mutual information must rise for another one.
ROUNDS, SETTLED = 4, 0.02

#: Words that a task sums over its blocks; distinct words of blocks that a bucket holds about; words whose contexts a task unfolds at once.
FREQUENT, BUCKET, UNFOLDED = 1000, 1_000_000, 20_000

#: Added to each class bigram, as a share of the class's own frequency times this many tokens.
PRIOR = 20.0

#: The end's word.
_END = xxhash.xxh64_intdigest(b"\n") - (1 << 64) if xxhash.xxh64_intdigest(b"\n") >> 63 else xxhash.xxh64_intdigest(b"\n")

_BLOCK = "block long, rows binary, held binary, sizes binary, ids binary, words binary, many long"


def _pack(t: pa.Table) -> pa.Table:
    """A block's documents as one row: positions, held-out flags, token numbers (each text ends with 0), distinct words."""
    known: dict[bytes, int] = {}
    ids: list[np.ndarray] = []
    for x in t["text"]:
        words = (x.as_py() or "").encode().lower().split()
        ids.append(np.array([known.setdefault(w, len(known) + 1) for w in words] + [0], np.int32))
    words = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64).view(np.int64)
    words = np.concatenate(([_END], words))
    doc = t["doc_id"].combine_chunks()
    null = doc.is_null().to_numpy(zero_copy_only=False)
    cells = [
        t["block"][0].as_py(), np.column_stack([doc.fill_null(0).to_numpy().astype(np.int64), null.astype(np.int64)]).tobytes(), t["held"].to_numpy().astype(np.uint8).tobytes(),
        np.array([len(x) for x in ids], np.int64).tobytes(), zstandard.compress(np.concatenate(ids).tobytes(), 1), words.astype(np.int64).tobytes(), len(words),
    ]
    names = ["block", "rows", "held", "sizes", "ids", "words", "many"]
    return pa.table({n: pa.array([c], pa.int64() if n in ("block", "many") else pa.binary()) for n, c in zip(names, cells, strict=True)})


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Held-out flags by document, sizes, token numbers, words."""
    return np.frombuffer(row["held"], np.uint8).astype(bool), np.frombuffer(row["sizes"], np.int64), np.frombuffer(zstandard.decompress(row["ids"]), np.int32), np.frombuffer(row.get("words", b""), np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for x in range(b.num_rows):
            yield {c: b.column(i)[x].as_buffer() if pa.types.is_binary(b.column(i).type) else b.column(i)[x].as_py() for i, c in enumerate(b.schema.names)}


def _bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return (((words.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places that are its own, in order."""
    order = np.argsort(bucket, kind="stable")
    at = bucket[order]
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
    for lo, hi in zip(starts, np.append(starts[1:], len(at)), strict=True):
        yield int(at[lo]), order[lo:hi]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


_DEALT = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("many", pa.binary()), ("cells", pa.binary())])
_DEALT_SQL = "bucket int, words binary, many binary, cells binary"
_CELL = np.dtype([("c", "<u1"), ("n", "<u4")])


def _counts(buckets: int):
    """For mapInArrow: training counts of each word of each block, as (words, counts) by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            held, sizes, ids, words = _open(row)
            n = np.bincount(ids[np.repeat(~held, sizes)], minlength=len(words)).astype(np.int64)
            at = np.flatnonzero(n)
            words, n = words[at], n[at]
            yield _batch([(k, words[x].tobytes(), n[x].tobytes(), None) for k, x in _runs(_bucket(words, buckets))], _DEALT)

    return run


_VOCABULARY = "bucket int, words binary, n binary, class binary"
_VOCABULARY_ARROW = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("n", pa.binary()), ("class", pa.binary())])


def _vocabulary(t: pa.Table) -> pa.Table:
    """A bucket's words, ascending, with their counts."""
    words, n = (np.concatenate([np.frombuffer(x, np.int64) for x in t[c].to_pylist()]) for c in ("words", "many"))
    distinct, row = np.unique(words, return_inverse=True)
    sums = np.zeros(len(distinct), np.int64)
    np.add.at(sums, row, n)
    return pa.Table.from_batches([_batch([(t["bucket"][0].as_py(), distinct.tobytes(), sums.tobytes(), None)], _VOCABULARY_ARROW)])


def _known(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, counts and classes of a bucket (none: empty)."""
    if not t.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    row = {c: t[c][0].as_py() for c in ("words", "n", "class")}
    return np.frombuffer(row["words"], np.int64), np.frombuffer(row["n"], np.int64), np.frombuffer(row["class"] or b"", np.uint8)


def _most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent words of each bucket, as many as are wanted of all: word, n."""
    for b in batches:
        for words, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w, k = np.frombuffer(words, np.int64), np.frombuffer(n, np.int64)
            at = np.lexsort((w, -k))[: FREQUENT + 1]
            yield pa.RecordBatch.from_arrays([pa.array(w[at]), pa.array(k[at])], names=["word", "n"])


def _initial(row: dict, words: np.ndarray, first: dict[int, int]) -> np.ndarray:
    """Classes of a block's words: those that a look-up left, or else the first ones."""
    return np.frombuffer(row["class"], np.uint8).astype(np.int64) if row.get("class") is not None else np.array([first.get(w, REST) for w in words.tolist()], np.int64)


def _contexts(first: dict[int, int], frequent: np.ndarray, buckets: int):
    """For mapInArrow: for each word of each block its neighbours' classes in training texts: words, numbers of cells, cells, by bucket.

    A cell is (code, count); code: class of the word before, or CLASSES + class of the word after. The end, whose class
    is fixed, has none. frequent: words (ascending) that are summed over a task's blocks.
    """

    def dealt(words: np.ndarray, many: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
        bucket = _bucket(words, buckets)
        of_cell = dict(_runs(np.repeat(bucket, many)))
        return _batch([(k, words[x].tobytes(), many[x].astype(np.int32).tobytes(), cells[of_cell[k]].tobytes()) for k, x in _runs(bucket)], _DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(frequent), 2 * CLASSES), np.int64)
        for row in _rows(batches):
            held, sizes, ids, words = _open(row)
            number = np.int32 if len(words) * 2 * CLASSES < 1 << 31 else np.int64
            cls = _initial(row, words, first).astype(number)
            ids = ids[np.repeat(~held, sizes)].astype(number, copy=False)
            if not len(ids):
                continue
            at = np.minimum(np.searchsorted(frequent, words), max(len(frequent) - 1, 0))
            often = np.where(frequent[at] == words, at, -1) if len(frequent) else np.full(len(words), -1)
            often[0] = -2  # the end
            of = cls[ids]  # every text ends with 0, the end, and so does what stands before the first one
            rare = []
            for word, beside in ((ids, np.concatenate((cls[:1], of[:-1]))), (ids[:-1], CLASSES + of[1:])):
                mine = often[word]
                some = mine >= 0
                sums += np.bincount(mine[some] * (2 * CLASSES) + beside[some], minlength=sums.size).reshape(sums.shape)
                some = mine == -1
                rare.append((word * (2 * CLASSES) + beside)[some])
            key, n = np.unique(np.concatenate(rare), return_counts=True)
            if not len(key):
                continue
            cells = np.empty(len(key), _CELL)
            cells["c"], cells["n"] = key % (2 * CLASSES), n
            local, many = np.unique(key // (2 * CLASSES), return_counts=True)
            yield dealt(words[local], many, cells)
        while sums.any():  # a cell's count has four bytes: what exceeds them makes more cells
            part = np.minimum(sums, (1 << 32) - 1)
            sums = sums - part
            a, b = np.nonzero(part)
            cells = np.empty(len(a), _CELL)
            cells["c"], cells["n"] = b, part[a, b]
            local, many = np.unique(a, return_counts=True)
            yield dealt(frequent[local], many, cells)

    return run


def exchange(left: np.ndarray, right: np.ndarray, pairs: np.ndarray, now: np.ndarray) -> np.ndarray:
    """The best class of each word (row): left and right hold its neighbours' classes, pairs the class bigrams.

    Moving a word's bigrams from its class to another changes the mutual information, to first order, by the sum of
    log(n(l, c) * N / (n(l) n(c))) over its neighbours; its own bigrams are left out of its present class.
    The end and the unknown word's class take no words.
    """
    total = max(pairs.sum(), 1.0)
    p = pairs + PRIOR * np.outer(pairs.sum(1) + 1, pairs.sum(0) + 1) / (total + len(pairs)) / len(pairs)
    info = np.log(p * p.sum() / np.outer(p.sum(1), p.sum(0)))
    gain = left @ info + right @ info.T
    gain[:, :REST] = -np.inf
    best = gain.argmax(1)
    keep = gain[np.arange(len(now)), now] >= gain[np.arange(len(now)), best]
    return np.where(keep, now, best)


def _assign(pairs: np.ndarray, first: dict[int, int]):
    """For cogrouped applyInArrow: a bucket's contexts and its words with their classes give the words with their next classes."""

    def run(key: tuple, dealt: pa.Table, known: pa.Table) -> pa.Table:
        words, n, cls = _known(known)
        now = cls.astype(np.int64) if len(cls) == len(words) else np.array([first.get(w, REST) for w in words.tolist()], np.int64)
        new = now.copy()
        rows: list[np.ndarray] = []
        cells: list[np.ndarray] = []
        for r in _rows(iter(dealt.to_batches())):
            rows.append(np.repeat(np.searchsorted(words, np.frombuffer(r["words"], np.int64)), np.frombuffer(r["many"], np.int32)).astype(np.int32))
            cells.append(np.frombuffer(r["cells"], _CELL))
        if rows:
            row, cell = np.concatenate(rows), np.concatenate(cells)
            order = np.argsort(row, kind="stable")
            row, cell = row[order], cell[order]
            for lo in range(0, len(words), UNFOLDED):
                a, b = np.searchsorted(row, [lo, lo + UNFOLDED])
                some = min(UNFOLDED, len(words) - lo)
                m = np.bincount((row[a:b].astype(np.int64) - lo) * (2 * CLASSES) + cell["c"][a:b], weights=cell["n"][a:b], minlength=some * 2 * CLASSES).reshape(some, -1)
                new[lo : lo + some] = exchange(m[:, :CLASSES], m[:, CLASSES:], pairs, now[lo : lo + some])
        new[words == _END] = END
        return pa.Table.from_batches([_batch([(key[0].as_py(), words.tobytes(), n.tobytes(), new.astype(np.uint8).tobytes())] if len(words) else [], _VOCABULARY_ARROW)])

    return run


def _asked(buckets: int):
    """For mapInArrow over (block, words): the words of each block by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words = np.frombuffer(row["words"], np.int64)
            rows = [(k, row["block"], words[x].tobytes()) for k, x in _runs(_bucket(words, buckets))]
            yield _batch(rows, pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.binary())]))

    return run


_FOUND = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("class", pa.binary()), ("n", pa.binary())])


def _answered(counts: bool):
    """For cogrouped applyInArrow: each block's words of a bucket get their classes, and their counts where asked for; words of no training text are unknown."""

    def run(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        words, n, cls = _known(known)
        out = []
        for r in _rows(iter(asked.to_batches())):
            w = np.frombuffer(r["words"], np.int64)
            if len(words):
                at = np.minimum(np.searchsorted(words, w), len(words) - 1)
                hit = words[at] == w
                found = np.where(hit, cls[at], UNKNOWN).astype(np.uint8), np.where(hit, n[at], 0)
            else:
                found = np.full(len(w), UNKNOWN, np.uint8), np.zeros(len(w), np.int64)
            out.append((r["block"], key[0].as_py(), found[0].tobytes(), found[1].tobytes() if counts else None))
        return pa.Table.from_batches([_batch(out, _FOUND)])

    return run


def _looked_up(blocks: DataFrame, vocabulary: DataFrame, buckets: int, counts: bool) -> DataFrame:
    """blocks with found: for each bucket the classes, and counts, of the block's words there."""
    asked = blocks.select("block", "words").mapInArrow(_asked(buckets), "bucket int, block long, words binary")
    answers = asked.groupBy("bucket").cogroup(vocabulary.groupBy("bucket")).applyInArrow(_answered(counts), "block long, bucket int, class binary, n binary")
    answers = stash(answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "class", "n")).alias("found")))
    return blocks.join(answers, "block")


def _filled(row: dict, words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes and counts of a block's words, from what its buckets have answered."""
    cls, n = np.zeros(len(words), np.uint8), np.zeros(len(words), np.int64)
    places = dict(_runs(_bucket(words, buckets)))
    for f in row["found"]:
        cls[places[f["bucket"]]] = np.frombuffer(f["class"], np.uint8)
        if f["n"] is not None:
            n[places[f["bucket"]]] = np.frombuffer(f["n"], np.int64)
    return cls, n


def _with_classes(buckets: int):
    """For mapInArrow over blocks with what was found: blocks with their words' classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = b.select([f.name for f in b.schema if f.name != "found"])
            cls = [_filled(r, np.frombuffer(r["words"], np.int64), buckets)[0].tobytes() for r in _rows(iter([b.select(["words", "found"])]))]
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cls, pa.binary())], names=[*kept.schema.names, "class"])

    return run


def information(pairs: np.ndarray) -> float:
    """Mutual information of neighbouring classes, in nats."""
    p = pairs / max(pairs.sum(), 1.0)
    a, b = np.nonzero(p)
    return float((p[a, b] * np.log(p[a, b] / (p.sum(1)[a] * p.sum(0)[b]))).sum())


def _pair_sums(batches: Iterator[pa.RecordBatch], cls_of) -> Iterator[pa.RecordBatch]:
    """Class bigrams of training texts: a, b, n; cls_of gives each row's classes by token and training flags."""
    sums = np.zeros((CLASSES, CLASSES))
    for row in _rows(batches):
        for cls, keep in cls_of(row):
            c = cls.astype(np.int64)
            before = np.concatenate(([END], c[:-1]))
            sums += np.bincount((before * CLASSES + c)[keep], minlength=CLASSES * CLASSES).reshape(CLASSES, CLASSES)
    a, b = np.nonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sums[a, b].astype(np.int64))], names=["a", "b", "n"])


def _table(df: DataFrame) -> np.ndarray:
    out = np.zeros((CLASSES, CLASSES))
    for r in df.groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # at most CLASSES squared
        out[r["a"], r["b"]] = r["n"]
    return out


def _look_up(train_tokens: int, types: int, class_n: np.ndarray, class_once: np.ndarray, buckets: int):
    """For mapInArrow: a block and what was found of its words give each document's sums and classes."""
    base = np.log10(train_tokens + types + 1)
    share = np.clip(class_once / np.maximum(class_n, 1), 1e-6, 0.5)  # what a class keeps for the unknown word
    share[END] = 0
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("emitted", pa.float64()), ("classes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            held, sizes, ids, words = _open(row)
            cls, n = _filled(row, words, buckets)
            cls = cls.astype(np.int64)
            known = n > 0
            cls[~known] = UNKNOWN
            emit = np.where(known, np.log10(np.maximum(n, 1) / np.maximum(class_n[cls], 1) * (1 - share[cls])), 0.0)
            plain = np.log10(n + 1) - base
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            tokens = cls[ids].astype(np.uint8).tobytes()
            doc = np.frombuffer(row["rows"], np.int64).reshape(-1, 2)
            sums = [np.add.reduceat(known[ids].astype(np.int64), starts), np.add.reduceat(plain[ids], starts), np.add.reduceat(emit[ids], starts)]
            texts = [tokens[s : s + k] for s, k in zip(starts.tolist(), sizes.tolist(), strict=True)]
            cols = [pa.array([None if null else d for d, null in doc.tolist()], pa.int64()), pa.array(held), pa.array(sizes), *map(pa.array, sums), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def transitions(pairs: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Log10 probabilities of a class after a class, smoothed by the classes' own frequencies; in the unknown's column, of the unknown word.

    pairs: class bigrams; share: what each class keeps of its probability for the unknown word.
    """
    freq = pairs.sum(0) + 1e-9
    freq[UNKNOWN] = 0
    freq /= freq.sum()
    rows = pairs.copy()
    rows[:, UNKNOWN] = 0
    move = (rows + PRIOR * freq) / (rows.sum(1, keepdims=True) + PRIOR)
    move[UNKNOWN] = freq  # after an unknown word: the classes' own frequencies
    log = np.log10(np.maximum(move, 1e-300))
    log[:, UNKNOWN] = np.log10(np.maximum(move @ share, 1e-12))  # the unknown word, of whichever class
    return log


def _by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens, words seen once and words of each class of each bucket."""
    for row in _rows(batches):
        n, cls = np.frombuffer(row["n"], np.int64), np.frombuffer(row["class"], np.uint8)
        found = np.unique(cls)
        cols = [found.astype(np.int32), *([int(x[cls == c].sum()) for c in found] for x in (n, (n == 1).astype(np.int64), np.ones(len(n), np.int64)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["class", "n", "once", "types"])


def _score(pairs: np.ndarray, share: np.ndarray):
    """For mapInArrow: adds the classes' transitions to what the words emit."""
    log = transitions(pairs, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column(b.schema.get_field_index("classes"))
            offsets = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
            c = np.frombuffer(blobs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.int64) if len(blobs) else np.zeros(0, np.int64)
            before = np.concatenate(([END], c[:-1]))  # a text's last class is the end, and so is what stands before a text
            s = np.add.reduceat(log[before, c], offsets[:-1] - offsets[0]) if len(blobs) else np.zeros(0)
            score = b.column(b.schema.get_field_index("emitted")).to_numpy() + s
            rest = [b.column(b.schema.get_field_index(x)) for x in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def class_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """Each row's doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity (10 to the power -score / n_tokens).

    docs: doc_id, text; held_out: the rows that the model does not learn from. A-Z are lower-cased; words are
    runs of other than ASCII white space, and a text ends with one end token, so a null or empty text is
    that token alone. Repeated rows count and are scored as often as they stand. With no training row every
    word is unknown. Words are known by 64-bit hashes. No rows: no result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    many = max(1, -(-int(size) // BLOCK))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(many)).cast("long"))
    blocks = stash(dealt.groupBy("block").applyInArrow(_pack, _BLOCK))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, int(blocks.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]) // BUCKET)
    vocabulary = stash(blocks.mapInArrow(_counts(buckets), _DEALT_SQL).groupBy("bucket").applyInArrow(_vocabulary, _VOCABULARY))
    most = vocabulary.select("words", "n").mapInArrow(_most, "word long, n long").where(F.col("word") != _END).orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    first = {_END: END} | {r["word"]: REST + 1 + x for x, r in enumerate(most[: CLASSES - REST - 1])}
    frequent = np.sort(np.array([r["word"] for r in most], np.int64))
    now, pairs, before = blocks, np.zeros((CLASSES, CLASSES)), 0.0

    def present_classes(row: dict):
        held, sizes, ids, words = _open(row)
        yield _initial(row, words, first)[ids], np.repeat(~held, sizes)

    for round_ in range(ROUNDS):
        pairs = _table(now.mapInArrow(lambda b: _pair_sums(b, present_classes), "a long, b long, n long"))
        told = information(pairs)
        if round_ > 1 and told < before * (1 + SETTLED):
            break
        before = told
        contexts = now.mapInArrow(_contexts(first, frequent, buckets), _DEALT_SQL)
        next_ = stash(contexts.groupBy("bucket").cogroup(vocabulary.groupBy("bucket")).applyInArrow(_assign(pairs, first), _VOCABULARY))
        discard(vocabulary, *([now] if now is not blocks else []))
        vocabulary = next_
        if round_ + 1 < ROUNDS:
            now = stash(_looked_up(blocks, vocabulary, buckets, False).mapInArrow(_with_classes(buckets), f"{_BLOCK}, class binary"))
    totals = vocabulary.mapInArrow(_by_class, "class int, n long, once long, types long").groupBy("class").agg(*(F.sum(c).alias(c) for c in ("n", "once", "types"))).collect()  # at most CLASSES
    class_n, class_once = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in totals:
        class_n[r["class"]], class_once[r["class"]] = r["n"], r["once"]
    train_tokens, types = (sum(r[c] for r in totals) for c in ("n", "types"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emitted double, classes binary"
    looked = stash(_looked_up(blocks, vocabulary, buckets, True).mapInArrow(_look_up(train_tokens, types, class_n, class_once, buckets), schema))

    def final_classes(row: dict):
        c = np.frombuffer(row["classes"], np.uint8)
        yield c, np.full(len(c), not row["held_out"])

    pairs = _table(looked.select("held_out", "classes").mapInArrow(lambda b: _pair_sums(b, final_classes), "a long, b long, n long"))
    share = np.clip(class_once / np.maximum(class_n, 1), 1e-6, 0.5)
    share[END] = 0
    scored = looked.mapInArrow(_score(pairs, share), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(train_tokens).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op1_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_scores(table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)
