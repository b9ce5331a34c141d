"""N-gram Jaccard join in metric space: pivots, regions, triangle-inequality windows, recursion.

1 - J is a metric on shingle sets, and so is the size of the symmetric difference, D. Two sets of a and b
shingles are as similar as the threshold asks iff D <= (1-t)/(1+t) * (a+b).

First level. Documents cannot be the pivots here: nearly all texts share nothing, stand at distance 1 from
nearly every pivot, and a window around each border would then hold everything. The pivots are sets of
shingles instead: for each band of sizes, a hash deals all possible shingles to m sets. A pivot's distance to a
document tells the document's share of that set, and by the triangle inequality the shares of two linked
documents differ by at most D over all m sets together. With m above the largest D, some shares are the same: the
window has width 0 there. m leaves room for empty shares, which would part nothing. Documents with the same
share of the same set meet. Size bands are windows of the same kind around the empty set: a document near a
border stands in both bands.

Second level. Of those that meet, the document that meets most others is the pivot, and a pivot's Voronoi region
holds all that meet where it is the pivot; a document near several pivots stands in the regions of all of them, so
each linked pair is in one region. A document's marks are the parities of its shares of 2^k more pivot sets; the
number of parities in which two documents differ (h) is a metric, and never above D, so pairs whose h is above what
the threshold allows are no links. Documents that may link to their pivot need not be compared with each other by
marks; the others are compared with all whose distance to the pivot the triangle inequality allows. A large
region is parted again between its pivot and the document farthest from it, with windows of twice the largest D
on the border, as long as that makes regions smaller; what stays large is compared in blocks, by shells of distance.

Only documents with a partner that marks allow are compared by their whole sets: first with their pivots, then, in
regions that those links do not connect, with each other. A comparison of a block gives a spanning forest of its
links, not all pairs. Equal sets are one document from the start, so groups of copies never meet in a region.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import discard, stash, table

#: Documents of a block, that one task compares whole; of a region that is not parted again; levels of that.
BLOCK, LEAF, LEVELS = 1024, 4096, 6

#: Ratio of a size band's borders.
BAND = 1.25

#: Keys that a task gathers before it deals them out or brings them together.
HELD = 2_000_000


def shingles(text: str | None, n: int) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of a text's n-word shingles; with fewer words, of the whole sequence; without words, none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    h = np.array([known[w] for w in words], np.uint64)
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    out += np.uint64(len(words) if len(words) < n else 0)
    return np.unique(out)


class Threshold:
    """J >= num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def links(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * both >= self.num * (a + b - both)

    def may(self, h, a, b):
        """Whether sets of a and b elements can link when they differ in h at least; of numbers, arrays or columns."""
        return ((self.den + self.num) * h <= (self.den - self.num) * (a + b)) & (self.den * a >= self.num * b) & (self.den * b >= self.num * a)

    def most(self, size: int) -> int:
        """The largest symmetric difference of a set of this size and a linked one that is no smaller."""
        large = size * self.den // self.num
        return (self.den - self.num) * (size + large) // (self.den + self.num)

    def bands(self, size: int) -> list[tuple[int, int]]:
        """Bands (number, largest D) of a set of this size: the smaller set's band of any linked pair that holds it."""
        own = band(size)
        least = -(-size * self.num // self.den)  # the smallest set that can be linked to it
        return [(b, self.most(border(b + 1) - 1)) for b in range(band(least), own + 1)]


def border(b: int) -> int:
    """The smallest size of band b."""
    return int(np.ceil(BAND**b - 1e-9))


def band(size: int) -> int:
    b = int(np.log(size) / np.log(BAND))
    while border(b + 1) <= size:
        b += 1
    while border(b) > size:
        b -= 1
    return b


def region_keys(s: np.ndarray, threshold: Threshold) -> np.ndarray:
    """First-level regions of a set: a hash of band, pivot set and the document's share of it, for each pivot set."""
    out = []
    mixed = s * np.uint64(0x9FB21C651E98DF25)
    mixed ^= mixed >> np.uint64(35)
    for b, most in threshold.bands(len(s)):
        if not most:  # within this band only equal sets link
            continue
        spare = 1 + most // 10
        m = most + 1 + spare  # of m shares, at least spare + 1 are the same in both sets of a linked pair
        pivot = (mixed % np.uint64(m)).astype(np.int64)
        share = np.zeros(m, np.uint64)
        np.add.at(share, pivot, s * np.uint64(0xC2B2AE3D27D4EB4F) ^ (s >> np.uint64(29)))
        key = (share + np.uint64(b)) * np.uint64(0x9E3779B97F4A7C15) ^ (np.arange(m, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(b * 1_000_003))
        full = np.bincount(pivot, minlength=m) > 0
        if m - full.sum() <= spare:  # then one of those is not empty, and empty shares make no region
            key = key[full]
        out.append(key ^ (key >> np.uint64(30)))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh128_digest(s.tobytes())[:8], "little", signed=True)


def marks_size(size: int, threshold: Threshold) -> int:
    """Bytes of the marks of a set: 8 parities at least for each element of the largest D, so that few of D's elements meet in one."""
    bits = 256
    while bits < 8 * threshold.most(size):
        bits *= 2
    return bits // 8


def marks_of(s: np.ndarray, threshold: Threshold) -> bytes:
    """Parities of a set's shares of 2^k pivot sets."""
    bits = 8 * marks_size(len(s), threshold)
    mixed = s * np.uint64(0xA0761D6478BD642F)
    mixed ^= mixed >> np.uint64(29)
    odd = np.bincount((mixed & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def window_size(pivot: int, threshold: Threshold) -> int:
    """Bytes to which the marks of all that meet a set of this size can be folded: the smallest of them has at least t * pivot / BAND shingles."""
    return marks_size(int(pivot * threshold.num / threshold.den / BAND), threshold)


def fold(marks: np.ndarray, size: int) -> np.ndarray:
    """The marks for fewer pivot sets, in bytes; each is the union of some of the former."""
    return np.bitwise_xor.reduce(marks.reshape(-1, size), axis=0)


def differing(x: bytes, y: bytes, size: int = 0) -> int:
    size = size or min(len(x), len(y))
    return int(np.bitwise_count(fold(np.frombuffer(x, np.uint8), size) ^ fold(np.frombuffer(y, np.uint8), size)).sum())


def _blobs(values: np.ndarray, starts: np.ndarray) -> pa.BinaryArray:
    """Runs of 8-byte values as binary cells; starts: the first of each run, and the end."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * 8).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


_DEALT = "bucket int, doc long, n long, node long, marks binary, key long, keys binary, nodes binary"


def _deal(n: int, threshold: Threshold, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (doc, text, key): a row for each document, and for each bucket the keys (of shares) that fall into it, with their nodes.

    A task deals out the keys of equal sets once, or once again after many others.
    """
    names = [f.split()[0] for f in _DEALT.split(", ")]

    def passed(keys: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
        k, v = np.concatenate(keys), np.repeat(np.array(nodes, np.int64), [len(x) for x in keys])
        bucket = ((k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        at = bucket[order]
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        ends = np.append(starts, len(k))
        none = lambda kind: pa.nulls(len(starts), kind)
        return pa.RecordBatch.from_arrays([pa.array(at[starts].astype(np.int32)), *(none(pa.int64()) for _ in range(3)), none(pa.binary()), none(pa.int64()), _blobs(k[order], ends), _blobs(v[order], ends)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys: list[np.ndarray] = []
        nodes: list[int] = []
        size = row = 0
        for b in batches:
            found: list[tuple[int, int, bytes | None]] = []
            for x in b.column(1):
                s = shingles(x.as_py(), n)
                if not len(s):
                    found.append((0, 0, None))
                    continue
                node = node_of(s)
                if node in seen:
                    found.append((len(s), node, None))
                    continue
                seen.add(node)
                found.append((len(s), node, marks_of(s, threshold)))
                k = region_keys(s, threshold)
                if len(k):
                    keys.append(k)
                    nodes.append(node)
                    size += len(k)
                if size > HELD:
                    yield passed(keys, nodes)
                    keys, nodes, size = [], [], 0
            if len(seen) > 200_000:
                seen.clear()
            many = b.num_rows
            sizes, ids, marks = zip(*found, strict=True) if found else ((), (), ())
            bucket = pa.array((np.arange(row, row + many) % buckets).astype(np.int32))
            row += many
            yield pa.RecordBatch.from_arrays([bucket, b.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(marks, pa.binary()), b.column(2), pa.nulls(many, pa.binary()), pa.nulls(many, pa.binary())], names=names)
        if keys:
            yield passed(keys, nodes)

    return run


def meet(keys: np.ndarray, nodes: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys and nodes of keys that several nodes have, how many there are, and one node for each key, to go on with.

    told: entries that an earlier call returned as part of a key with several nodes; they are not returned again.
    """
    o = np.lexsort((nodes, keys))
    k, v, m = keys[o], nodes[o], told[o]
    first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (v[1:] != v[:-1]))))
    k, v, m = k[first], v[first], np.logical_or.reduceat(m, first)
    starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    many = np.diff(np.append(starts, len(k)))
    several = (many > 1) | np.logical_or.reduceat(m, starts)
    out = np.repeat(several, many) & ~m
    return k[out], v[out], np.repeat(many, many)[out], (k[starts], v[starts], several)


_MET = "region long, node long, many long, doc long, n long, marks binary, key long"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over dealt rows sorted by bucket: documents as they are, and (region, node, many) where several nodes meet.

    A bucket's keys meet in pieces of bounded size: each piece leaves one node for each key behind, so a key that very many nodes have streams through.
    """
    names = [f.split()[0] for f in _MET.split(", ")]
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    state, keys, nodes, size, of = none, [], [], 0, None

    def passed() -> pa.RecordBatch:
        nonlocal state, keys, nodes, size
        told = np.concatenate((state[2], np.zeros(size, bool)))
        k, v, many, state = meet(np.concatenate((state[0], *keys)), np.concatenate((state[1], *nodes)), told)
        keys, nodes, size = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(v), pa.array(many.astype(np.int64)), *(pa.nulls(len(k), x) for x in (pa.int64(), pa.int64(), pa.binary(), pa.int64()))], names=names)

    for b in batches:
        docs = b.filter(pa.compute.is_null(b.column(6)))
        if docs.num_rows:
            empty = pa.nulls(docs.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([empty, docs.column(3), empty, docs.column(1), docs.column(2), docs.column(4), docs.column(5)], names=names)
        for x in range(b.num_rows):
            if not b.column(6)[x].is_valid:
                continue
            bucket = b.column(0)[x].as_py()
            if bucket != of:
                if size:
                    yield passed()
                state, of = none, bucket
            keys.append(np.frombuffer(b.column(6)[x].as_buffer(), np.int64))
            nodes.append(np.frombuffer(b.column(7)[x].as_buffer(), np.int64))
            size += len(keys[-1])
            if size > 4 * HELD:
                yield passed()
    if size:
        yield passed()


def _sets(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (doc, text): node and set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py(), n) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "data"])

    return run


_NEAR = "region long, node long, n long, w long, size int, may boolean"


def _apart(threshold: Threshold) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (pivot, node, pivot_n, n, pivot_marks, marks): whether the two may link, and w, their distance by marks that are folded alike for all that meet the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            a, b = t.column(2).to_numpy(), t.column(3).to_numpy()
            size = np.array([window_size(x, threshold) for x in a.tolist()], np.int32)
            pairs = [(x.as_py(), y.as_py()) for x, y in zip(t.column(4), t.column(5), strict=True)]
            h = np.array([differing(x, y) for x, y in pairs], np.int64)
            w = np.array([differing(x, y, s) for (x, y), s in zip(pairs, size.tolist(), strict=True)], np.int64)
            cols = [t.column(0), t.column(1), t.column(3), pa.array(w), pa.array(size), pa.array(threshold.may(h, a, b), pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["region", "node", "n", "w", "size", "may"])

    return run


def _farther(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over rows whose last columns are size, marks, far_marks: these rows, with v, the distance of the marks, in place of both marks."""
    for t in batches:
        v = [differing(x.as_py(), y.as_py(), s.as_py()) for s, x, y in zip(t.column(t.num_columns - 3), t.column(t.num_columns - 2), t.column(t.num_columns - 1), strict=True)]
        yield pa.RecordBatch.from_arrays([*t.columns[:-2], pa.array(v, pa.int64())], names=[*t.schema.names[:-2], "v"])


def _linked(threshold: Threshold) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (a, b, a_set, b_set): the pairs a, b that link, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            i = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in sets], np.int64)
            a, b = (np.array([len(s[k]) for s in sets], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(threshold.links(i, a, b), pa.bool_()))

    return run


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of some sets have in common."""
    many = len(sets)
    owner = np.repeat(np.arange(many), [len(s) for s in sets])
    e = np.concatenate(sets)
    o = np.argsort(e, kind="stable")
    e, owner = e[o], owner[o]
    starts = np.flatnonzero(np.concatenate(([True], e[1:] != e[:-1])))
    held = np.diff(np.append(starts, len(e)))
    out = np.zeros((many, many), np.float32)
    for count in np.unique(held[(held > 1) & (held <= 16)]).tolist():
        rows = owner[starts[held == count][:, None] + np.arange(count)]
        for i in range(count):
            for j in range(i + 1, count):
                np.add.at(out.reshape(-1), rows[:, i] * many + rows[:, j], 1)
    out += out.T
    often = np.flatnonzero(held > 16)
    for lo in range(0, len(often), 4096):
        part = often[lo : lo + 4096]
        m = np.zeros((many, len(part)), np.float32)
        for x, (s, h) in enumerate(zip(starts[part].tolist(), held[part].tolist(), strict=True)):
            m[owner[s : s + h], x] = 1
        out += m @ m.T
    return out.astype(np.int64)


def forest(linked: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Of a matrix of links enough to connect what they connect, given nodes that are connected already (equal roots)."""
    label, out = np.unique(root, return_inverse=True)[1], []
    for i in np.flatnonzero(linked.any(axis=1)).tolist():
        for j in np.flatnonzero(linked[i]).tolist():
            if label[i] != label[j]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _to_compare(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """node, n, root of a pair of blocks (side 0 and 1; a block with itself: 2), and which two rows are to be compared."""
    side, node, n, root = (t[c].to_numpy() for c in ("side", "node", "n", "root"))
    asked = np.triu(np.ones((len(node), len(node)), bool), 1) & (root[:, None] != root[None, :]) & ((side[:, None] != side[None, :]) | (side[:, None] == 2))
    return node, n, root, asked


def _alive(threshold: Threshold) -> Callable[[pa.Table], pa.Table]:
    """For applyInArrow over a pair of blocks with marks: the nodes that may link to another one that they are compared with."""

    def run(t: pa.Table) -> pa.Table:
        node, n, _, asked = _to_compare(t)
        marks = [np.frombuffer(x, np.uint8) for x in t["data"].to_pylist()]
        size = min(map(len, marks))
        m = np.stack([fold(x, size) for x in marks])
        ones, both = np.bitwise_count(m).sum(axis=1, dtype=np.int64), np.zeros((len(n), len(n)), np.float32)
        for lo in range(0, size, 512):
            part = np.unpackbits(m[:, lo : lo + 512], axis=1).astype(np.float32)
            both += part @ part.T
        h = ones[:, None] + ones[None, :] - 2 * both.astype(np.int64)
        may = asked & threshold.may(h, n[:, None], n[None, :])
        return pa.table({"node": pa.array(node[may.any(axis=0) | may.any(axis=1)], pa.int64())})

    return run


def _links(threshold: Threshold) -> Callable[[pa.Table], pa.Table]:
    """For applyInArrow over a pair of blocks with whole sets: links that connect what its links connect."""

    def run(t: pa.Table) -> pa.Table:
        node, n, root, asked = _to_compare(t)
        both = common([np.frombuffer(x, np.uint64) for x in t["data"].to_pylist()])
        found = forest(asked & threshold.links(both, n[:, None], n[None, :]), root)
        i, j = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(node[i], pa.int64()), "b": pa.array(node[j], pa.int64())})

    return run


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable over links (a, b), for nodes that have links.

    Large-star and small-star steps until every component is a star; each step is a few joins and minimums
    over the links and is kept in the shared folder.
    """
    edges = stash(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        no_star = ends.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
        if not no_star.agg(F.count("*")).first()[0]:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        # large star: neighbours above a node go to the smallest of its neighbours and itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stash(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: a node and its neighbours below go to the smallest of them
        moved = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        before, edges = edges, stash(moved.select("u", F.col("m").alias("v")).unionByName(moved.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
        discard(before, large)


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) with the components that links (a, b) connect joined into one; nodes without links are in no row.

    Only components are joined anew: the links between them, not those within, make the graph that components() works on.
    """
    x, y = (roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
    ends = links.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    between = stash(ends.where("a <> b").distinct())
    if between.isEmpty():
        return roots
    over = stash(components(between))
    moved = roots.join(over.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stash(moved.unionByName(over.join(roots.select("node"), "node", "left_anti")))


def _most(threshold: Threshold, n: str) -> Column:
    """The largest symmetric difference of a set of n and a linked one that is no smaller."""
    return F.expr(f"(({threshold.den - threshold.num}) * ({n} + {n} * {threshold.den} div {threshold.num})) div {threshold.den + threshold.num}")


def parted(members: DataFrame, marks: DataFrame, threshold: Threshold) -> DataFrame:
    """Members (region, node, n, w, size, may, many) with large regions parted between their pivot and the node farthest from it.

    A node joins the side that it is nearer to, and the other one too if the triangle inequality lets a linked
    node be there: by 2 * the largest D that its size allows. A region whose sides hold over one and a half times
    its nodes together stays whole.
    """
    done = members.where(F.col("many") <= LEAF)
    large = members.where(F.col("many") > LEAF)
    for level in range(LEVELS):
        if large.isEmpty():
            return done
        far = large.groupBy("region").agg(F.max_by("node", F.struct("w", "node")).alias("far"))
        far = far.join(marks.select(F.col("node").alias("far"), F.col("marks").alias("far_marks")), "far").drop("far")
        cols = ["region", "node", "n", "w", "may", "many", "size"]
        asked = large.select(*cols).join(marks.select("node", "marks"), "node").join(far, "region").select(*cols, "marks", "far_marks")
        known = stash(asked.mapInArrow(_farther, "region long, node long, n long, w long, may boolean, many long, size int, v long"))
        near, over = F.col("w") <= F.col("v") + 2 * _most(threshold, "n"), F.col("v") <= F.col("w") + 2 * _most(threshold, "n")
        counts = known.groupBy("region").agg(F.count_if(near).alias("c0"), F.count_if(over).alias("c1"))
        known = known.join(stash(counts), "region").withColumn("whole", F.col("c0") + F.col("c1") > 1.5 * F.col("many"))
        side = lambda k, d, c: known.where("not whole").where(near if k == 0 else over).select(F.xxhash64("region", F.lit(level), F.lit(k)).alias("region"), "node", "n", F.col(d).alias("w"), "size", "may", F.col(c).alias("many"))  # noqa: E731, B023
        sides = stash(side(0, "w", "c0").unionByName(side(1, "v", "c1")))
        done = done.unionByName(stash(known.where("whole").select(*done.columns))).unionByName(sides.where(F.col("many") <= LEAF))
        large = sides.where(F.col("many") > LEAF)
    return done.unionByName(large)


def paired(members: DataFrame, data: DataFrame, threshold: Threshold) -> DataFrame:
    """Rows (region, x, y, side, node, n, root, data) of the pairs of blocks that are to be compared; members: region, node, n, w, root, many.

    A region that fits is one block. A larger one has shells of distance to the pivot, and each shell as many
    blocks as it needs, dealt by a hash. Shells further apart than the largest D have no links, nor do blocks of one root matter.
    """
    cols = ["region", "x", "y", "side", "node", "n", "root"]
    rows = members.where(F.col("many") <= BLOCK).select("region", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(2).alias("side"), "node", "n", "root")
    large = members.where(F.col("many") > BLOCK)
    if not large.isEmpty():
        wide = large.groupBy("region").agg(F.max("n").alias("n_max")).withColumn("most", _most(threshold, "n_max")).withColumn("width", F.greatest(F.lit(1), F.expr("most div 2"))).drop("n_max")
        shells = stash(large.join(wide, "region").withColumn("shell", F.expr("w div width")))
        parts = shells.groupBy("region", "shell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("parts"))
        dealt = stash(shells.join(parts, ["region", "shell"]).withColumn("block", F.col("shell") * (1 << 24) + F.pmod(F.xxhash64("node"), "parts")))
        blocks = stash(dealt.groupBy("region", "block", "shell", "most", "width").agg(F.min("root").alias("r0"), F.max("root").alias("r1")))
        x, y = blocks.select("region", "most", "width", *(F.col(c).alias(f"x_{c}") for c in ("block", "shell", "r0", "r1"))), blocks.select("region", *(F.col(c).alias(f"y_{c}") for c in ("block", "shell", "r0", "r1")))
        pairs = stash(x.join(y, "region").where("x_block <= y_block and (y_shell - x_shell - 1) * width <= most and not (x_r0 = x_r1 and y_r0 = y_r1 and x_r0 = y_r0)").select("region", F.col("x_block").alias("x"), F.col("y_block").alias("y")))
        sides = pairs.select("region", "x", "y", F.col("x").alias("block"), F.when(F.col("x") == F.col("y"), 2).otherwise(0).alias("side")).unionByName(pairs.where("x < y").select("region", "x", "y", F.col("y").alias("block"), F.lit(1).alias("side")))
        rows = rows.unionByName(dealt.join(sides, ["region", "block"]).select(*cols))
    return rows.join(data, "node").select(*cols, "data")


def connect(met: DataFrame, marks: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: Threshold) -> DataFrame:
    """node, root of all linked nodes. met: region, node, many; marks: node, n, marks; sets_of: node, data (the set) of the nodes that it is given.

    Pairs that other links connect already may be left out.
    """
    # where nodes meet, the pivot is the one that meets most others anywhere: the text that copies were made from
    degree = met.groupBy("node").agg(F.sum("many").alias("degree"))
    pivots = met.join(degree, "node").groupBy("region").agg(F.max(F.struct("degree", "node")).alias("top")).select("region", F.col("top.node").alias("pivot"))
    pairs = stash(met.join(pivots, "region").where("node <> pivot").select("pivot", "node").distinct())
    some = pairs.select("node").unionByName(pairs.select(F.col("pivot").alias("node"))).distinct()
    marks = stash(marks.where("marks is not null").join(some, "node", "left_semi").dropDuplicates(["node"]))
    own = marks.select(F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col("marks").alias("pivot_marks"))
    asked = pairs.join(marks, "node").join(own, "pivot").select("pivot", "node", "pivot_n", "n", "pivot_marks", "marks")
    near = stash(asked.mapInArrow(_apart(threshold), _NEAR))
    discard(pairs)
    # regions where marks leave something open: a node that may not link to the pivot, and another one within its window
    windows = near.groupBy("region").agg(F.min(F.when(~F.col("may"), F.col("w") - _most(threshold, "n"))).alias("low"), F.count("*").alias("all")).where("low is not null and all > 1").drop("all")
    within = near.join(windows, "region").where("w >= low").drop("low")
    many = within.groupBy("region").agg(F.count("*").alias("many"), F.count_if(~F.col("may")).alias("open")).where("many > 1")
    members = stash(parted(stash(within.join(many.drop("open"), "region")), marks, threshold))
    as_one = F.when(F.col("may"), F.lit(NO_ID)).otherwise(F.col("node"))  # what may link to the pivot goes on in any case
    compared = paired(members.withColumn("root", as_one), marks.select("node", F.col("marks").alias("data")), threshold)
    alive = compared.groupBy("region", "x", "y").applyInArrow(_alive(threshold), "node long")
    hoped = near.where("may")
    alive = stash(alive.unionByName(hoped.select("node")).unionByName(hoped.select(F.col("region").alias("node"))).distinct())
    discard(marks)

    sets = stash(sets_of(alive))
    a, b = (sets.select(F.col("node").alias(c), F.col("data").alias(f"{c}_set")) for c in "ab")
    found = hoped.select(F.col("region").alias("a"), F.col("node").alias("b")).join(b, "b").join(a, "a").select("a", "b", "a_set", "b_set")
    roots = stash(components(stash(found.mapInArrow(_linked(threshold), "a long, b long"))))
    left = members.join(alive, "node", "left_semi").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("many", "may", "size")
    left = stash(left)
    still = left.groupBy("region").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("many")).where("r0 < r1").select("region", "many")
    compared = paired(stash(left.join(still, "region")), sets, threshold)
    more = stash(compared.groupBy("region", "x", "y").applyInArrow(_links(threshold), "a long, b long"))
    discard(near, members, left, alive, sets)
    return joined(roots, more)


#: Stands for a null id inside; greater than any other.
NO_ID = (1 << 63) - 1


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, n_shingles and component_id: the smallest id of a document that links reach, its own included.

    docs: a long id and a text. A-Z are lower-cased, words are runs of other than ASCII white space, and a
    document's set holds its distinct n-word shingles (fewer words: the whole sequence; none or null: the
    empty set, linked with nothing). Sets link when den * intersection >= num * union. Rows with equal sets are
    one node; repeated ids with different texts are nodes of their own, and each row tells its own text's
    component. A null id counts as larger than all others; a component of null ids alone is null. No rows: no
    result. Sets are compared by 64-bit hashes of shingles and known by 64 bits of a 128-bit hash.
    """
    sets, nodes, roots = _linked_sets(docs, n, num, den, id_col, text_col)
    named = stash(roots.join(nodes, "node"))
    least = stash(named.groupBy("root").agg(F.min("least").alias("component")))
    linked = stash(named.select("node", "root").join(least, "root").select("node", "component"))
    alone = nodes.join(linked, "node", "left").select("node", F.coalesce("component", "least").alias("component"))
    out = sets.join(stash(alone), "node", "left")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.withColumn("component", F.coalesce("component", "doc")).select(known("doc").alias(id_col), F.col("n").alias("n_shingles"), known("component").alias("component_id"))


def keyed_components(docs: DataFrame, key_col: str, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As jaccard_components, of rows that ids do not tell apart: each row's doc (its id, NO_ID for null), key (a long), n_shingles and root.

    root is the same for the rows of one component only, whatever their ids, and means nothing for rows without words.
    """
    sets, _, roots = _linked_sets(docs, n, num, den, id_col, text_col, key_col)
    return sets.join(roots, "node", "left").select("doc", "key", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("root"))


def _linked_sets(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str, key_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each row's set (doc, n, node, and key where asked for), the nodes (node, least id) and the linked ones' components (node, root)."""
    t = Threshold(num, den)
    key = F.col(key_col).cast("long") if key_col else F.lit(0).cast("long")
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).alias("text"), key.alias("key"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * max(parts, docs.count() >> 14)
    dealt = keyed.mapInArrow(_deal(n, t, buckets), _DEALT).repartition("bucket").sortWithinPartitions("bucket")
    both = stash(dealt.mapInArrow(_meet, _MET))
    made, met = both.where("region is null"), both.where("region is not null").select("region", "node", "many")
    nodes = stash(made.where("n > 0").groupBy("node").agg(F.min("doc").alias("least")))
    sets = stash(made.select("doc", "n", "node", *(["key"] if key_col else [])))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The set of each wanted node, from its smallest id; an id with several texts is told apart by its node."""
        ids = stash(wanted.join(nodes, "node"))
        some = keyed.select("doc", "text").join(ids.select(F.col("least").alias("doc")).distinct(), "doc", "left_semi")
        return some.mapInArrow(_sets(n), "node long, data binary").join(ids.select("node"), "node", "left_semi").dropDuplicates(["node"])

    roots = connect(met, made.select("node", "n", "marks"), sets_of, t)
    roots = stash(roots)
    discard(both)
    return sets, nodes, roots


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
