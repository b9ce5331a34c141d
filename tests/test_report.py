"""Reports of objects are made in their rows; trees that are large or not in order are joined."""

from plumbline.operators import extract, report


def parsed(spark):
    s = lambda sub, seq, parent, position, kind: (sub, seq, parent, position, kind, seq + 1, seq + 2, "text")
    edges, accesses = [("P", None, "Q_LONG_NAME", "R"), (None, "S", "T", None)], [("P", None, "T", "UPDATE")]
    subs = [("P", "PROCEDURE", 2, 8, "text")]
    nested = [s("P", 0, None, 0, "BEGIN_END"), s("P", 1, 0, 0, "IF"), s("P", 2, 1, 0, "OTHER"), s("P", 3, 0, 1, "LOOP"), s("P", 4, 3, 0, "IF"), s("P", 5, 4, 0, "OTHER"), s(None, 0, None, 0, "OTHER"), s("P", 6, 77, 1, "OTHER"), s(None, 1, None, 1, "SQL_UPDATE")]
    late = [s("P", 1, 2, 0, "OTHER"), s("P", 2, None, 0, "IF"), s("Q", 0, 1, 0, "IF"), s("Q", 1, 0, 0, "LOOP"), s("Q", 2, 1, 0, "OTHER")]
    rows = [
        ("APP", "NESTED", "PACKAGE BODY", "h", "ok", None, edges, accesses, subs, nested),
        ("APP", "LATE", "PACKAGE BODY", "h", "ok", None, [], [], [], late),
        ("APP", "FAILED", "PACKAGE", "h", "error", "why", [], [], [], []),
    ]
    return spark.createDataFrame(rows, extract.PARSED)


def lines(made):
    found = {}
    for r in made.orderBy("object_name", "at").collect():
        found.setdefault(r["object_name"], []).append(r["line"])
    return found


def test_trees_in_rows_and_by_joins_are_the_same(spark, monkeypatch):
    found = lines(report.report(parsed(spark)))
    assert [x["line"] for x in report.reports(parsed(spark)).where("object_name = 'NESTED'").first()["lines"]] == found["NESTED"]
    assert found["NESTED"][-11:] == [
        "  Subprogram: P", "  ├── [0] BEGIN_END  L1-L2", "  │   ├── [1] IF  L2-L3", "  │   │   └── [2] OTHER  L3-L4", "  │   └── [3] LOOP  L4-L5", "  │       └── [4] IF  L5-L6", "  │           └── [5] OTHER  L6-L7",
        "  └── [6] OTHER  L7-L8", "  Subprogram: (package-level)", "  ├── [0] OTHER  L1-L2", "  └── [1] SQL_UPDATE  L2-L3",
    ]
    assert found["NESTED"][3] == "CALLER  CALLEE_SCHEMA  CALLEE_OBJECT  CALLEE_SUBPROGRAM" and found["NESTED"][5] == "P                      Q_LONG_NAME    R                "
    assert found["LATE"][-7:] == ["  Subprogram: P", "  └── [2] IF  L3-L4", "      └── [1] OTHER  L2-L3", "  Subprogram: Q", "  └── [0] IF  L1-L2", "      └── [1] LOOP  L2-L3", "          └── [2] OTHER  L3-L4"]
    assert found["FAILED"][:5] == ["=== Parse Result: APP.FAILED (PACKAGE) ===", "Status: error", "Error:  why", "--- Call edges (0) ---", "  (no data)"]
    monkeypatch.setattr(report, "FEW", -1)
    assert lines(report.report(parsed(spark))) == found


def test_reports_of_plain_objects_need_no_shuffle(spark):
    plan = report.report(parsed(spark).where("object_name <> 'LATE'"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
