"""Recovery from sources that the parser does not take apart: an outer BEGIN, loose statements, the text of a named subprogram.

All of it is column expressions on one row a source, without a shuffle: a pattern cuts the text into pieces (comments,
strings, words and what lies between), and a fold over the pieces keeps a few numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_QUIET = r"--[^\n]*|/\*(?s:.*?)\*/|'[^']*'|'[^']*$"
_WORDS = rf"(?i){_QUIET}|END\s+(?:IF|LOOP|CASE)(?![\p{{L}}\p{{Nd}}_$#])|[\p{{L}}\p{{Nd}}_$#]+|[^\p{{L}}\p{{Nd}}_$#'/\-]+|(?s:.)"
_PARTS = rf"{_QUIET}|;|[^;'/\-]+|(?s:.)"
#: Statement types by the words that a statement begins with; others are OTHER.
TYPES = {"SELECT": "SQL_SELECT", "WITH": "SQL_SELECT", "UPDATE": "SQL_UPDATE", "INSERT": "SQL_INSERT", "DELETE": "SQL_DELETE", "MERGE": "SQL_MERGE", "EXECUTE IMMEDIATE": "SQL_EXECUTE_IMMEDIATE"}


def unmatched_begin(text: Column) -> Column:
    """Where (from 1) the outermost BEGIN stands that no END of the text closes; null if all are closed.

    Words in comments and strings do not count, nor do END IF, END LOOP and END CASE; an END without a BEGIN is passed over.
    """
    none = F.lit(None).cast("int")

    def step(s: Column, piece: Column) -> Column:
        word, depth = F.upper(piece), s["depth"]
        deeper = F.when(word == "BEGIN", depth + 1).when((word == "END") & (depth > 0), depth - 1).otherwise(depth)
        outer = F.when((word == "BEGIN") & (depth == 0), s["at"]).otherwise(s["outer"])
        return F.struct((s["at"] + F.length(piece)).alias("at"), deeper.alias("depth"), outer.alias("outer"))

    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("depth"), none.alias("outer"))
    return F.aggregate(F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0)), start, step, lambda s: F.when(s["depth"] > 0, s["outer"]))


def _spans(text: Column) -> Column:
    """First and last place of each statement's code, comments at its ends apart."""
    span = "struct<a:int,b:int>"
    none = F.lit(None).cast("int")

    def closed(s: Column) -> Column:
        return F.when(s["a"].isNull(), s["found"]).otherwise(F.array_append(s["found"], F.struct(s["a"].alias("a"), s["b"].alias("b"))))

    def step(s: Column, piece: Column) -> Column:
        end = piece == ";"
        code = ~piece.startswith("--") & ~piece.startswith("/*") & piece.rlike(r"\S")
        lead = F.length(piece) - F.length(F.regexp_replace(piece, r"^\s+", ""))
        tail = F.length(F.regexp_replace(piece, r"\s+$", ""))
        a = F.when(end, none).when(code, F.coalesce(s["a"], s["at"] + lead)).otherwise(s["a"])
        b = F.when(end, none).when(code, s["at"] + tail - 1).otherwise(s["b"])
        return F.struct((s["at"] + F.length(piece)).alias("at"), a.alias("a"), b.alias("b"), F.when(end, closed(s)).otherwise(s["found"]).alias("found"))

    start = F.struct(F.lit(1).alias("at"), none.alias("a"), none.alias("b"), F.array().cast(f"array<{span}>").alias("found"))
    return F.aggregate(F.regexp_extract_all(text, F.lit(_PARTS), F.lit(0)), start, step, closed)


def loose_statements(segments: DataFrame, text: str = "source_text", first_line: Column | None = None) -> DataFrame:
    """The statements of each segment, which end at `;` outside comments and strings: the segment's other columns, position, statement_type, start_line, end_line, source_text.

    A null or empty segment, and one of comments alone, has none. first_line: the line that the segment begins on (else 1).
    """
    others = [c for c in segments.columns if c != text]
    first = F.lit(1) if first_line is None else first_line
    rows = segments.select(*others, F.col(text).alias("_text"), first.alias("_first"), F.posexplode(_spans(F.col(text))).alias("position", "_span"))
    cut = rows.withColumn("source_text", F.substring(F.col("_text"), F.col("_span.a"), F.col("_span.b") - F.col("_span.a") + 1))
    kind = F.lit("OTHER")
    for words, name in TYPES.items():
        kind = F.when(F.upper("source_text").startswith(words), name).otherwise(kind)
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    start = F.col("_first") + breaks(F.substring(F.col("_text"), F.lit(1), F.col("_span.a") - 1))
    return cut.select(*others, "position", kind.alias("statement_type"), start.alias("start_line"), (start + breaks(F.col("source_text"))).alias("end_line"), "source_text")


def subprogram_text(wanted: DataFrame, sources: DataFrame, subprograms: DataFrame) -> DataFrame:
    """wanted (schema_name, object_name, object_type, subprogram) with source_text: the subprogram's own text, else the object's.

    sources: as assemble() gives them; subprograms: as extract.subprograms() gives them. An object without a source has null.
    """
    key = ["schema_name", "object_name", "object_type"]
    own = subprograms.select(*key, F.upper("subprogram_name").alias("_sub"), F.col("source_text").alias("_own"))
    found = wanted.withColumn("_sub", F.upper("subprogram")).join(own, [*key, "_sub"], "left").join(sources.select(*key, "source_text"), key, "left")
    return found.select(*wanted.columns, F.coalesce("_own", "source_text").alias("source_text"))
