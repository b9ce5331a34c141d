"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is good or bad. A line's features are shares of kinds of bytes, lengths and repeats of
its own and of the lines beside it; weights on them, and on pairs of neighbouring states, give the field.
Training rows carry their document's label on each line. Forward and backward passes give each line's
marginal, and the mean of the marginals, weighted by line length, is the document's score after a logistic
calibration that is fitted on the same rows. Features, training rows and scores come from whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import remainder, table

#: Most labelled documents that the field is fitted on, the smallest by a seeded hash of the id, and the most bytes of all their texts together.
SAMPLE, BUDGET = 2000, 128 << 20

#: Steps of the fit, its step size and the weight of the squared weights of features and of pairs.
STEPS, RATE, RIDGE, PAIR_RIDGE = 150, 0.05, 1e-3, 1e-2

# Kinds of bytes: lower-case, upper-case, digit, white space, sentence marks, other ASCII, first byte of a non-ASCII character, later byte.
_KIND = np.array([3 if x in (9, 10, 11, 12, 13, 32) else 2 if 48 <= x <= 57 else 1 if 65 <= x <= 90 else 0 if 97 <= x <= 122 else 4 if x in b".,;:?!'\"()-" else 5 if x < 128 else 7 if x < 192 else 6 for x in range(256)], np.uint8)
KINDS = 8

_RANDOM = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Features of one line; then the same of the line before and the line after; then a constant.
OWN = KINDS + 9
FEATURES = 3 * OWN + 1


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x FEATURES) and byte lengths of a text's lines. A text without lines has one empty line; a line of any length is one line."""
    data = np.frombuffer(text + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    starts = np.concatenate(([0], ends[:-1]))
    size = (ends - starts).astype(np.float64)
    kind = _KIND[data]
    of = np.repeat(np.arange(len(starts)), (ends - starts))
    counts = np.bincount(of * KINDS + kind, minlength=len(starts) * KINDS).reshape(-1, KINDS).astype(np.float64)
    space = kind == 3
    begins = ~space & np.concatenate(([True], space[:-1]))
    words = np.bincount(of[begins], minlength=len(starts)).astype(np.float64)
    first_upper = np.bincount(of[begins & (kind == 1)], minlength=len(starts))
    # words by a hash of their bytes: repeats of a word right after itself, and distinct words, within a line
    at = np.flatnonzero(begins)
    stop = np.flatnonzero(~space & np.concatenate((space[1:], [True])))
    h = np.zeros(0, np.uint64)
    if len(at):
        c = np.cumsum(_RANDOM[data], dtype=np.uint64)
        p = np.cumsum(_RANDOM[data] * np.arange(1, len(data) + 1, dtype=np.uint64), dtype=np.uint64)
        c0, p0 = (np.where(at > 0, v[at - 1], np.uint64(0)) for v in (c, p))
        h = (p[stop] - p0) - (c[stop] - c0) * at.astype(np.uint64)  # each byte's value times its place in the word
        h ^= h >> np.uint64(29)
    again = np.zeros(len(starts))
    distinct = np.zeros(len(starts))
    if len(at):
        line = of[at]
        same = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        again = np.bincount(line[1:][same], minlength=len(starts))
        key = np.unique(line.astype(np.uint64) << np.uint64(40) | h & np.uint64((1 << 40) - 1))
        distinct = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=len(starts))
    # marks at the ends of words, and words that repeat anywhere in the text
    odd_end = np.bincount(of[stop[(kind[stop] == 5) | (data[stop] == 33)]], minlength=len(starts)) if len(at) else again
    seen = len(np.unique(h)) / max(1, len(h))
    w = np.maximum(words, 1)
    own = np.column_stack([counts / np.maximum(size, 1)[:, None], np.log1p(size) / 8, (size - 1 - counts[:, 3]) / w / 10, first_upper / w, again / w, distinct / w, odd_end / w, counts[:, 1] / np.maximum(1, counts[:, 0] + counts[:, 1]), np.full(len(starts), seen), words == 0])
    none = np.zeros((1, OWN))
    return np.column_stack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]), np.ones(len(starts))]), size


def marginals(good: np.ndarray, lengths: np.ndarray, pair: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probability of state 1, and the expected weight of each pair of neighbouring states.

    good: log weight of state 1 over state 0 by line; lines stand one text after the other; lengths: lines of
    each text; pair: log weights of neighbouring states; weight: of lines, for the expected pairs.

    Texts advance together, longest first, so that a step is one vector operation.
    """
    order = np.argsort(-lengths, kind="stable")
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order]
    n = lengths[order]
    emit1 = np.exp(np.clip(good, -30, 30))
    m = np.exp(pair)
    a0, a1 = np.empty(len(good)), np.empty(len(good))
    steps = [int(np.searchsorted(-n, -x, "left")) for x in range(int(n[0]) if len(n) else 0)]  # texts with more than x lines
    for x, many in enumerate(steps):
        at = first[:many] + x
        if x == 0:
            u, v = np.ones(many), emit1[at]
        else:
            p, q = a0[at - 1], a1[at - 1]
            u, v = p * m[0, 0] + q * m[1, 0], (p * m[0, 1] + q * m[1, 1]) * emit1[at]
        s = u + v
        a0[at], a1[at] = u / s, v / s
    out, pairs = np.empty(len(good)), np.zeros((2, 2))
    b0, b1 = np.ones(len(good)), np.ones(len(good))
    for x in range(len(steps) - 1, -1, -1):
        at = first[: steps[x]] + x
        if x + 1 < len(steps):
            go = first[: steps[x + 1]] + x
            e0, e1 = b0[go + 1], b1[go + 1] * emit1[go + 1]
            u, v = m[0, 0] * e0 + m[0, 1] * e1, m[1, 0] * e0 + m[1, 1] * e1
            s = u + v
            b0[go], b1[go] = u / s, v / s
            if weight is not None:
                joint = np.array([a0[go] * m[0, 0] * e0, a0[go] * m[0, 1] * e1, a1[go] * m[1, 0] * e0, a1[go] * m[1, 1] * e1])
                pairs += ((joint / joint.sum(0)) @ weight[go + 1]).reshape(2, 2)
        u, v = a0[at] * b0[at], a1[at] * b1[at]
        out[at] = v / (u + v)
    return out, pairs


def document_means(p: np.ndarray, size: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    first = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    return np.add.reduceat(p * size, first) / np.add.reduceat(size, first)


class Field:
    """Weights of a fitted field. State 1 is a good line."""

    def __init__(self, weights: np.ndarray, pair: np.ndarray, mean: np.ndarray, spread: np.ndarray, scale: tuple[float, float]):
        self.weights, self.pair, self.mean, self.spread, self.scale = weights, pair, mean, spread, scale

    def raw(self, texts: list[bytes]) -> np.ndarray:
        each = [line_features(t) for t in texts]
        lengths = np.array([len(s) for _, s in each], np.int64)
        x, size = np.concatenate([f for f, _ in each]), np.concatenate([s for _, s in each])
        return document_means(marginals(((x - self.mean) / self.spread) @ self.weights, lengths, self.pair)[0], size, lengths)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Quality of each text, 0 to 1."""
        out: list[np.ndarray] = []
        group: list[bytes] = []
        for t in [*texts, None]:
            if t is not None:
                group.append(t)
            if group and (t is None or sum(map(len, group[-1:])) > 1 << 16 or len(group) >= 256):
                m = np.clip(self.raw(group), 1e-9, 1 - 1e-9)
                out.append(1 / (1 + np.exp(-(self.scale[0] * np.log(m / (1 - m)) + self.scale[1]))))
                group = []
        return np.concatenate(out) if out else np.zeros(0)


def fit(texts: list[bytes], labels: np.ndarray) -> Field:
    """Fit by Adam on the conditional likelihood of the line labels, each document weighing the same."""
    each = [line_features(t) for t in texts]
    lengths = np.array([len(s) for _, s in each], np.int64)
    x, size = np.concatenate([f for f, _ in each]), np.concatenate([s for _, s in each])
    mean, spread = x.mean(0), x.std(0) + 1e-6
    mean[-1], spread[-1] = 0, 1
    x = (x - mean) / spread
    y = np.repeat(labels.astype(np.float64), lengths)
    weight = np.repeat(1 / lengths, lengths)
    share = np.clip(labels.mean(), 0.05, 0.95)
    weight *= np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    w, pair = np.zeros(FEATURES), np.zeros((2, 2))
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    inner = np.ones(len(y), bool)
    inner[first] = False  # lines that have one before them in their text
    same = inner.nonzero()[0]
    m1, m2, k1, k2 = np.zeros(FEATURES), np.zeros(FEATURES), np.zeros((2, 2)), np.zeros((2, 2))
    for step in range(1, STEPS + 1):
        p, e = marginals(x @ w, lengths, pair, weight)
        g = x.T @ ((p - y) * weight) / len(labels) + RIDGE * w
        o = np.array([[((1 - y[same]) * weight[same]).sum(), 0.0], [0.0, (y[same] * weight[same]).sum()]])
        gp = (e - o) / len(labels) + PAIR_RIDGE * pair
        for v, gr, a, b in ((w, g, m1, m2), (pair, gp, k1, k2)):
            a *= 0.9
            a += 0.1 * gr
            b *= 0.999
            b += 0.001 * gr * gr
            v -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    field = Field(w, pair, mean, spread, (1.0, 0.0))
    d = np.clip(document_means(marginals(x @ w, lengths, pair)[0], size, lengths), 1e-9, 1 - 1e-9)
    z, yl = np.log(d / (1 - d)), labels.astype(np.float64)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit of the labels on the documents' means
        q = 1 / (1 + np.exp(-(a * z + b)))
        r = np.maximum(q * (1 - q), 1e-9)
        h = np.array([[(r * z * z).sum() + 1, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [((yl - q) * z).sum() - (a - 1), (yl - q).sum()])
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-8:
            break
    field.scale = (max(a, 1e-3), b)
    return field


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, budget: int = BUDGET) -> Field:
    """Fit on at most `sample` labelled documents with `budget` bytes of text together. These bounds hold at every size of input.

    Documents are taken by a hash of their ids, whatever their length, as long as they fit into what is left of the budget;
    a shorter one may then follow. Only a text above the whole budget is never taken.

    docs: doc_id, text; labels: doc_id, quality (0 or 1; other values and null do not count). With no
    labelled row, or labels of one kind, the field is fitted all the same and gives that kind.
    """
    y = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    by = F.xxhash64(F.lit(29), "doc_id")
    y = y.orderBy(by, "doc_id").limit(sample)
    labelled = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")
    sizes = labelled.groupBy("doc_id").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).orderBy(by, "doc_id").collect()  # at most sample rows
    taken, left = [], budget
    for r in sizes:
        if r["size"] <= left:
            taken.append((r["doc_id"],))
            left -= r["size"]
    some = docs.sparkSession.createDataFrame(taken, "doc_id long")
    rows = labelled.join(F.broadcast(some), "doc_id", "left_semi").orderBy(by, "doc_id", "text").limit(sample).collect()  # bounded by sample and budget
    if not rows:
        return Field(np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(FEATURES), np.ones(FEATURES), (1.0, 0.0))
    return fit([(r["text"] or "").encode() for r in rows], np.array([r["quality"] for r in rows]))


def score(docs: DataFrame, field: Field, keep: list[str], name: str = "score") -> DataFrame:
    """Every row's keep columns and, under that name, its quality score, 0 to 1. A null text is empty; an empty text has one empty line. Repeated rows stay; no rows give none."""
    text = next(x for x in ("_text", "_text_", "_text__") if x not in keep)
    schema = docs.select(*keep, F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = field.scores([(x.as_py() or "").encode() for x in b.column(0)])
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found, pa.float64())], names=[*keep, name])

    return docs.select(F.col("text").alias(text), *keep).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return remainder(id_col, 3) == 1


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = train(docs, labels.where(~held_out()))
    scored = score(docs, field, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
