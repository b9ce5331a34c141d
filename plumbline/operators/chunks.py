"""Statement trees: paths, subtree lengths and hashes, and greedy chunks of root statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.shared import kept

#: What a subprogram's statements are known by; characters in a token; shortest source that is chunked.
SCOPE = ["schema_name", "object_name", "object_type", "subprogram"]
CHARS, THRESHOLD = 4, 4000

def tree(statements: DataFrame) -> DataFrame:
    """Statements with root (the seq of their root), path (positions from the root) and depth.

    A statement whose parent is not there is a root, and so is the one with the smallest seq of a cycle of parents: no
    statement is lost. Each level is written to the shared folder; nothing is cached.
    """
    s = statements.withColumn("subprogram", F.coalesce("subprogram", F.lit("")))
    ids = s.select(*SCOPE, F.col("seq").alias("parent_seq"), F.lit(True).alias("_known"))
    s = kept(s.join(ids, [*SCOPE, "parent_seq"], "left"))
    step = F.struct("position", "seq")
    links = s.where("_known").select(*SCOPE, "seq", "parent_seq", "position")

    def below(level: DataFrame, links: DataFrame) -> DataFrame:
        """level and all that stands below it."""
        out = level
        while True:
            up = level.select(*SCOPE, F.col("seq").alias("parent_seq"), "root", "path")
            level = kept(links.join(up, [*SCOPE, "parent_seq"]).select(*SCOPE, "seq", "root", F.array_append("path", step).alias("path")))
            if level.isEmpty():
                return out
            out = out.unionByName(level)

    first = lambda rows: rows.select(*SCOPE, "seq", F.col("seq").alias("root"), F.array(step).alias("path"))
    placed = below(kept(first(s.where("_known is null"))), links)
    lost = kept(links.join(placed.select(*SCOPE, "seq"), [*SCOPE, "seq"], "left_anti"))
    if not lost.isEmpty():
        heads = kept(_cycle_heads(lost).join(lost, [*SCOPE, "seq"]))
        placed = placed.unionByName(below(kept(first(heads)), lost.join(heads.select(*SCOPE, "seq"), [*SCOPE, "seq"], "left_anti")))
    return s.drop("_known").join(placed, [*SCOPE, "seq"]).withColumn("depth", F.size("path") - 1)


def _cycle_heads(links: DataFrame) -> DataFrame:
    """The smallest seq of each cycle, of statements that all are on cycles or below them: SCOPE, seq.

    First each goes up by doubling steps, as many as there are statements: where they arrive are the cycles, all of them.
    Then those on cycles take the smallest seq on their way round, by doubling steps too. A few joins for any length.
    """
    key = [*SCOPE, "seq"]
    jump = links.select(*key, F.col("parent_seq").alias("to"))
    steps = 1
    many = links.groupBy(*SCOPE).count().agg(F.max("count")).first()[0]
    while steps < many:  # everything has arrived on its cycle then
        far = jump.select(*SCOPE, F.col("seq").alias("to"), F.col("to").alias("far"))
        jump = kept(jump.join(far, [*SCOPE, "to"]).select(*key, F.col("far").alias("to")))
        steps *= 2
    on = jump.select(*SCOPE, F.col("to").alias("seq")).distinct()
    ring = kept(links.join(on, key).select(*key, F.col("parent_seq").alias("to"), F.col("seq").alias("least")))
    steps = 1
    while steps < many:
        far = ring.select(*SCOPE, F.col("seq").alias("to"), F.col("to").alias("far"), F.col("least").alias("other"))
        ring = kept(ring.join(far, [*SCOPE, "to"]).select(*key, F.col("far").alias("to"), F.least("least", "other").alias("least")))
        steps *= 2
    return ring.where("seq = least").select(*key)


def subtree_sums(placed: DataFrame) -> DataFrame:
    """For each root: the length of its subtree's texts, and the hashes of it in order; placed: as tree() gives it."""
    ordered = F.array_sort(F.collect_list(F.struct("path", "source_hash")))
    roots = placed.groupBy(*SCOPE, "root").agg(F.sum(F.length("source_text")).alias("length"), F.transform(ordered, lambda x: x["source_hash"]).alias("hashes"))
    first = placed.where("depth = 0").select(*SCOPE, F.col("seq").alias("root"), "position", "statement_type")
    return roots.join(first, [*SCOPE, "root"])


def chunks(statements: DataFrame, max_chunk_tokens: int = 2000) -> DataFrame:
    """Root statements of each subprogram in chunks: chunk_index, root_seqs, chunk_hash, length.

    Roots go in order of position; a chunk takes roots while its characters stay within the budget; an exception handler
    begins a new chunk; a root is never split. The hash is that of its statements' hashes, joined by `|`.
    A subprogram's roots, not its texts, meet in one row, and a fold over their lengths says where chunks begin.
    """
    budget = max_chunk_tokens * CHARS
    one = F.struct("position", "root", (F.col("statement_type") == "EXCEPTION_HANDLER").alias("handler"), "length", "hashes")
    roots = subtree_sums(tree(statements)).groupBy(*SCOPE).agg(F.array_sort(F.collect_list(one)).alias("roots"))

    def step(s: Column, r: Column) -> Column:
        new = (s["length"] < 0) | r["handler"] | (s["length"] + r["length"] > budget)
        length = F.when(new, r["length"]).otherwise(s["length"] + r["length"])
        return F.struct(length.alias("length"), (s["chunk"] + new.cast("int")).alias("chunk"), F.array_append(s["of"], s["chunk"] + new.cast("int")).alias("of"))

    start = F.struct(F.lit(-1).cast("long").alias("length"), F.lit(-1).alias("chunk"), F.array().cast("array<int>").alias("of"))
    placed = roots.withColumn("of", F.aggregate("roots", start, step, lambda s: s["of"]))
    each = placed.select(*SCOPE, F.posexplode("roots").alias("n", "r"), "of").select(*SCOPE, "n", "r", F.get("of", F.col("n")).alias("chunk_index"))
    grouped = each.groupBy(*SCOPE, "chunk_index").agg(F.array_sort(F.collect_list(F.struct("n", "r.root", "r.hashes"))).alias("all"), F.sum("r.length").alias("length"))
    hashes = F.array_join(F.flatten(F.transform("all", lambda x: x["hashes"])), "|")
    return grouped.select(*SCOPE, "chunk_index", F.transform("all", lambda x: x["root"]).alias("root_seqs"), F.sha2(hashes, 256).alias("chunk_hash"), "length")


def valid_chunks(made: DataFrame, stored: DataFrame) -> DataFrame:
    """made with valid: whether the stored analysis of a chunk and of all before it is of the same hash."""
    from pyspark.sql import Window as W

    old = stored.select(*SCOPE, "chunk_index", F.col("chunk_hash").alias("_old"))
    miss = F.coalesce((F.col("_old") != F.col("chunk_hash")).cast("int"), F.lit(1))
    before = W.partitionBy(*SCOPE).orderBy("chunk_index").rowsBetween(W.unboundedPreceding, 0)
    return made.join(old, [*SCOPE, "chunk_index"], "left").withColumn("valid", F.max(miss).over(before) == 0).drop("_old")
