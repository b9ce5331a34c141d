"""Summaries against a plain recursion, with a completer that records what it is asked."""

from plumbline.operators import chunks, summarize

NONE = "caller_schema string, caller_object string, caller_subprogram string, callee_schema string, callee_object string, callee_subprogram string"


def graph_of(spark, pairs, statuses):
    edges = spark.createDataFrame([("S", a, None, None, b, None) for a, b in pairs], NONE)
    info = spark.createDataFrame([("S", n, "PROCEDURE", s) for n, s in statuses.items()], "schema_name string, object_name string, object_type string, status string")
    sources = spark.createDataFrame([("S", n, "PROCEDURE", f" code of {n} ", f"hash {n}") for n in statuses], "schema_name string, object_name string, object_type string, source_text string, source_hash string")
    roots = spark.createDataFrame([("s", "A", None)], "schema_name string, object_name string, subprogram string")
    accesses = spark.createDataFrame([("S", "D", "PROCEDURE", None, "X", "T", "INSERT")], "schema_name string, object_name string, object_type string, subprogram string, table_schema string, table_name string, operation string")
    return roots, edges, info, sources, accesses


def test_each_node_once_from_the_leaves(spark):
    given = graph_of(spark, [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "E"), ("C", "W")], {"A": "ok", "B": "ok", "C": "ok", "D": "ok", "W": "wrapped"})
    found = summarize.summarize(*given, complete=lambda s, u: u.replace("\n", "|")).collect()
    by = {r.object_name: r.summary for r in found}
    assert len(found) == len(by) == 6 and by["E"] == "[missing] E" and by["W"] == "[wrapped] W"
    assert by["D"] == f"Object: S.D (PROCEDURE)||Source code:|```plsql|code of D|```||Table accesses:|- X.T (INSERT)||Called objects:|- E: [missing] E||{summarize.TEXTS['brief']}"
    assert f"- D: {by['D']}" in by["B"] and f"- D: {by['D']}" in by["C"] and "- W: [wrapped] W" in by["C"]
    assert f"- B: {by['B']}|- C: {by['C']}" in by["A"]
    stored = summarize.to_store(summarize.summarize(*given, complete=lambda s, u: "old"))
    assert stored.count() == 4
    again = {r.object_name: r.summary for r in summarize.summarize(*given, complete=lambda s, u: "new", stored=stored.where("object_name <> 'B'")).collect()}
    assert again["A"] == again["C"] == "old" and again["B"] == "new"
    forced = {r.object_name: r.summary for r in summarize.summarize(*given, complete=lambda s, u: "new", stored=stored, force=True).collect()}
    assert forced["A"] == "new"
    detailed = summarize.summarize(*given, complete=lambda s, u: s, kind="detailed").where("kind = 'detailed'").collect()
    assert [(r.object_name, r.summary) for r in detailed] == [("A", summarize.TEXTS["system_detailed"])]


def test_cycles_end(spark):
    given = graph_of(spark, [("A", "B"), ("B", "A"), ("B", "C"), ("C", "C")], {"A": "ok", "B": "ok", "C": "ok"})
    by = {r.object_name: r.summary for r in summarize.summarize(*given, complete=lambda s, u: u.replace("\n", "|")).collect()}
    assert "- C: [cycle] C" in by["C"] and "- A: [cycle] A" in by["B"] and "- B: Object" in by["A"]


def test_long_subprograms_go_by_chunks(spark):
    given = graph_of(spark, [], {"A": "ok"})
    rows = [("S", "A", "PROCEDURE", "", n, None, n, "OTHER", n, n, chr(97 + n) * 3000, f"h{n}") for n in range(3)]
    statements = spark.createDataFrame(rows, f"{', '.join(f'{c} string' for c in chunks.SCOPE)}, seq int, parent_seq int, position int, statement_type string, start_line int, end_line int, source_text string, source_hash string")
    pieces = summarize.chunk_texts(statements, 1000)
    say = lambda s, u: (f"said of {u[u.index('-- [') :][:24]!r}" + (" after " + str(u.count("said of")) if "said of" in u else "")) if summarize.TEXTS["chunk"] in u else f"all: {u.count('said of')}"
    first = summarize.summarize(*given, complete=say, pieces=pieces).where("object_name = 'A'")
    r = first.first()
    assert len(r.analyses) == 3 and r.summary.startswith("all:") and r.analyses[2].analysis.endswith("after 2")
    changed = statements.replace({"h1": "h9"}, subset=["source_hash"])
    other = summarize.summarize(*given, complete=lambda s, u: "new", pieces=summarize.chunk_texts(changed, 1000), analyses=first).where("object_name = 'A'").first()
    assert [x.analysis == "new" for x in other.analyses] == [False, True, True]
