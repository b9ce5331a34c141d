import sys

from plumbline.operators import extract, graph
from plumbline.operators.store import Store, outcomes, pending, replace, upsert
from plumbline.sources.lines import assemble


def lines(spark, rows):
    return spark.createDataFrame([("S", *r) for r in rows], "owner string, name string, type string, line int, text string")


def test_assembly(spark):
    out = assemble(lines(spark, [("A", "PROCEDURE", 2, "b\n"), ("A", "PROCEDURE", 1, "a\n"), ("B", "PROCEDURE", 1, " create x"), ("C", "PROCEDURE", 1, None)])).collect()
    assert {r.object_name: r.source_text for r in out} == {"A": "CREATE OR REPLACE a\nb\n", "B": " create x", "C": "CREATE OR REPLACE "}


def test_upsert_and_pending(spark):
    schema = "schema_name string, object_name string, object_type string, source_hash string"
    old = spark.createDataFrame([("S", "A", "T", "1"), ("S", "B", "T", "1")], schema)
    new = spark.createDataFrame([("S", "A", "T", "1"), ("S", "B", "T", "2"), ("S", "C", "T", "1")], schema)
    assert {r.object_name: r.outcome for r in outcomes(old, new).collect()} == {"A": "unchanged", "B": "updated", "C": "inserted"}
    assert sorted((r.object_name, r.source_hash) for r in upsert(old, new).collect()) == [("A", "1"), ("B", "2"), ("C", "1")]
    assert [r.object_name for r in pending(new, old).orderBy("object_name").collect()] == ["B", "C"]
    assert replace(old, new.limit(0), new, ["object_name"]).count() == 0


def test_store_end_to_end(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    src = [("A", "PROCEDURE", 1, "PROCEDURE a IS BEGIN b(1); UPDATE t SET x = 1; END;"), ("B", "PROCEDURE", 1, "PROCEDURE b IS BEGIN a(1); c(2); END;")]
    assert {r.outcome: r["count"] for r in store.fetch(assemble(lines(spark, src))).collect()} == {"inserted": 2}
    assert {r.status: r["count"] for r in store.index("s").collect()} == {"ok": 2}
    assert {r.status: r["count"] for r in store.index("s").collect()} == {"unchanged": 2}
    text = graph.render(graph.explain(store, "S", "A"))
    assert text == ["A (PROCEDURE)", "    ├── TABLE T UPDATE", "    └── B (PROCEDURE)", "        ├── A (PROCEDURE) [cycle]", "        └── C [missing]"]


def test_depth(spark):
    edges = spark.createDataFrame([("S", "A", None, None, "B", None), ("S", "B", None, "", "C", None)], "caller_schema string, caller_object string, caller_subprogram string, callee_schema string, callee_object string, callee_subprogram string")
    info = spark.createDataFrame([("S", x, "P", "ok") for x in "ABC"], "schema_name string, object_name string, object_type string, status string")
    roots = spark.createDataFrame([("S", "A", None)], "schema_name string, object_name string, subprogram string")
    for limit, n in ((0, 1), (1, 2), (None, 3)):
        assert graph.dependency_tree(roots, edges, info, limit).count() == n


def test_entry_without_the_other_package(spark, monkeypatch):
    import __spark_entry__

    monkeypatch.setitem(sys.modules, "plumbline.llm.queries", None)
    assert "explain_tree" in __spark_entry__.queries() and "op8_topk" not in __spark_entry__.queries()
    assert extract.KEY
