"""Packing of documents into sequences by best-fit decreasing.

A document's token ids are cut into full windows first; what is left over is one piece shorter than a
window. Best-fit decreasing looks at a piece's length alone, so it runs on the number of pieces of each
length: at most `window` numbers, however many documents there are. A segment tree indexed by remaining
capacity finds the tightest open windows, and all pieces of one length that the same kind of window takes
are placed in one step. The plan is a list of runs (length, first rank, windows, offset); pieces find their
window by their rank among the pieces of their length, which Spark counts over salted groups.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import stash, table

WINDOW, END = 4096, 2

#: Words that a worker keeps with their ids; beyond it starts anew.
CACHE = 500_000

#: Groups in which the pieces of one length are ranked.
SALTS = 256


#: The split of the tokenizer file's pre-tokenizer, for words of ASCII and Latin-1 letters in lower case.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_PLAIN = re.compile(r"[!-~ß-öø-ÿ]+")
#: The byte-level alphabet: bytes without a visible character of their own follow from 256 on.
_HIDDEN = [x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 172 or x >= 174)]
_ALPHABET = {x: 256 + n for n, x in enumerate(_HIDDEN)}


class WordIds(dict):
    """Token ids, as bytes, of words without ASCII white space; each word is encoded once.

    The tokenizer's own split never takes white space into a token, so a text's ids are those of its words.
    Plain words are split here and only their parts go through the tokenizer's merges; all others, and those
    that could hold a special token, go through the tokenizer as they stand.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(_ALPHABET)
        ids = array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
        if len(part) <= 64:
            if len(self.parts) >= CACHE:  # a text without white space has parts, but no words that are kept
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
            self.parts.clear()
        text = word.decode()
        low = text.lower()
        if _PLAIN.fullmatch(low) and "<|" not in low:
            ids = b"".join([self.parts.get(x) or self.part(x) for x in _SPLIT.findall(low)])
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        return b"".join([self[w] for w in text.encode().split()])


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(path: str, window: int = WINDOW, end: int = END) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (doc_id, text): a row for each piece."""
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for b in batches:
            out: list[tuple[int | None, int, int, int, int]] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = words.of(text.as_py() or "") + last
                n = len(ids) // 4
                out += [(doc, at, min(window, n - at), zlib.crc32(ids[4 * at : 4 * (at + window)]), n) for at in range(0, n, window)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


class Tightest:
    """A segment tree over capacities 0..size-1: how many windows have each, and the least capacity from one on."""

    def __init__(self, size: int):
        self.n = 1 << max(1, (size - 1).bit_length())
        self.tree = [0] * (2 * self.n)

    def add(self, capacity: int, many: int) -> None:
        x = capacity + self.n
        while x:
            self.tree[x] += many
            x //= 2

    def at_least(self, capacity: int) -> int | None:
        """The smallest capacity >= the given one that some window has."""
        x = capacity + self.n
        if self.tree[x]:
            return capacity
        while x > 1:
            if x % 2 == 0 and self.tree[x + 1]:
                x += 1
                while x < self.n:
                    x = 2 * x if self.tree[2 * x] else 2 * x + 1
                return x - self.n
            x //= 2
        return None


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, windows, pieces in each, first window, offset of the first piece).

    The pieces of a run fill its windows one after the other: `pieces in each` of them side by side. This is
    what best-fit decreasing does piece by piece: the tightest window that takes a piece takes as many more
    of the same length as it can, since it stays the tightest.
    """
    open_ = Tightest(window + 1)
    groups: dict[int, list[tuple[int, int]]] = {}  # by remaining capacity: (first window, windows)
    runs: list[tuple[int, int, int, int, int, int]] = []
    made = 0

    def put(capacity: int, first: int, many: int) -> None:
        if capacity and many:
            groups.setdefault(capacity, []).append((first, many))
            open_.add(capacity, many)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = open_.at_least(length)
            if capacity is None:
                capacity, many = window, -(-left // (window // length))
                first, made = made, made + many
            else:
                first, many = groups[capacity].pop()
                open_.add(capacity, -many)
            each = capacity // length
            full = min(many, left // each)
            if full:
                runs.append((length, rank, full, each, first, window - capacity))
                put(capacity - each * length, first, full)
            rank, left = rank + full * each, left - full * each
            if full < many and left < each:
                if left:
                    runs.append((length, rank, 1, left, first + full, window - capacity))
                    put(capacity - left * length, first + full, 1)
                    put(capacity, first + full + 1, many - full - 1)
                    rank, left = rank + left, 0
                else:
                    put(capacity, first + full, many - full)
    return runs


def place(runs: list[tuple[int, int, int, int, int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: adds sequence_id and offset to rows that have length and rank."""
    r = np.array(sorted(runs), np.int64).reshape(-1, 6)
    key = r[:, 0] << 44 | r[:, 1]  # by length, then by first rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            x = r[np.searchsorted(key, length << 44 | rank, "right") - 1] if len(length) else r[:0]
            nth = rank - x[:, 1]
            rest = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(x[:, 4] + nth // x[:, 3]), pa.array(x[:, 5] + nth % x[:, 3] * length)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """A row for each piece of each document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs: doc_id and text. A null or empty text is the end id alone; texts of any length are cut into full
    windows and a rest, and no id is lost or repeated. Repeated rows are packed as often as they stand; a null
    doc_id stays null. No rows: no result. Pieces of one length rank by salt, doc_id and start, so that reruns
    agree. The plan's size depends on the window, not on the rows.
    """
    cut = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces(tokenizer, window, end), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SALTS)))
    counts = stash(cut.groupBy("length", "salt").count())
    by_length = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # at most `window` rows
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = cut.withColumn("n", F.row_number().over(within)).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("n") - 1)
    return ranked.drop("n", "base", "salt").mapInArrow(place(plan(by_length, window)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
