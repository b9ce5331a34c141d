import json

import pytest

from plumbline.cli import arguments, main
from plumbline.operators import recovery
from plumbline.operators.store import Store, parse_hash, source_text
from plumbline.sources.lines import LINES, from_texts, settings

PACKAGE = """PACKAGE BODY k IS
  PROCEDURE p IS
    v NUMBER;
  BEGIN
    IF v > 1 THEN
      q(1);
    END IF;
    UPDATE app.t SET a = 1;
  END;
END;
"""


def test_debug_report(spark, capsys, tmp_path):
    assert main(["debug", "--source", PACKAGE, "--object", "k"], spark) == 0
    assert capsys.readouterr().out.split("\n") == [
        "=== Parse Result: DEBUG.K (PACKAGE BODY) ===", "Status: ok",
        "--- Call edges (1) ---", "CALLER  CALLEE_SCHEMA  CALLEE_OBJECT  CALLEE_SUBPROGRAM", "------  -------------  -------------  -----------------", "P                      Q                               ",
        "--- Table accesses (1) ---", "SUBPROGRAM  TABLE_SCHEMA  TABLE_NAME  OPERATION", "----------  ------------  ----------  ---------", "P           APP           T           UPDATE   ",
        "--- Subprograms (1) ---", "NAME  TYPE       START_LINE  END_LINE", "----  ---------  ----------  --------", "P     PROCEDURE  2           9       ",
        "--- Substatements (5) ---", "  Subprogram: P", "  ├── [0] DECLARE  L3-L3", "  └── [1] BEGIN_END  L4-L4", "      ├── [2] IF  L5-L5", "      │   └── [3] OTHER  L6-L6", "      └── [4] SQL_UPDATE  L8-L8", "",
    ]
    path = tmp_path / "a.sql"
    path.write_text("BEGIN f(1; END;", encoding="utf-8")
    assert main(["debug", "--source-file", str(path), "--json", "--output", str(tmp_path / "o")], spark) == 0
    found = json.loads((tmp_path / "o").read_text(encoding="utf-8"))
    assert found["status"] == "error" and found["error_message"] and found["call_edges"] == [] and found["object_type"] == "PACKAGE BODY"
    assert main(["debug", "--source", ""], spark) == 0
    assert capsys.readouterr().out.count("(no data)") == 4


def test_failures(spark, capsys, monkeypatch):
    assert main(["debug", "--source-file", "/nonexistent/x.sql"], spark) == 1
    assert "Cannot read" in capsys.readouterr().err
    monkeypatch.delenv("ORACLE_DSN", raising=False)
    assert main(["fetch", "--schema", "s"], spark) == 1
    assert "ORACLE_DSN" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        arguments().parse_args(["debug", "--source", "x", "--source-file", "y"])
    assert settings({"ORACLE_USER": "u", "ORACLE_PASSWORD": "p", "ORACLE_DSN": "h:1/s"})["url"].endswith("@h:1/s")


def test_commands(spark, capsys, tmp_path):
    where = f"file://{tmp_path}/lines"
    rows = [("S", "A", "PROCEDURE", 1, "PROCEDURE a IS BEGIN b(1); UPDATE t SET x = 1; END;"), ("S", "B", "PROCEDURE", 1, "PROCEDURE b IS BEGIN c(2); END;"), ("T", "Z", "PROCEDURE", 1, "x")]
    spark.createDataFrame(rows, LINES).write.parquet(where)
    store = ["--store", f"file://{tmp_path}/store"]

    def run(*args):
        assert main([*store, *args], spark) == 0
        return capsys.readouterr().out.rstrip("\n")

    assert run("parse", "--schema", "s") == "0 objects: 0 ok, 0 error, 0 wrapped, 0 unchanged"
    assert run("fetch", "--schema", "s", "--lines", where, "--parse").split("\n") == ["2 objects: 2 inserted, 0 updated, 0 unchanged", "2 objects: 2 ok, 0 error, 0 wrapped, 0 unchanged"]
    assert run("parse", "--schema", "s") == "2 objects: 0 ok, 0 error, 0 wrapped, 2 unchanged"
    assert run("explain", "--schema", "s", "--object", "a").split("\n") == ["A (PROCEDURE)", "    ├── TABLE T UPDATE", "    └── B (PROCEDURE)", "        └── C [missing]"]
    assert run("explain", "--schema", "s", "--object", "a", "--depth", "0").split("\n") == ["A (PROCEDURE)", "    └── TABLE T UPDATE"]
    assert run("summarize", "--schema", "s", "--object", "a") == "Object: S.A (PROCEDURE) calls 1"
    kept = Store(spark, store[1]).read("summary")
    assert sorted((r.object_name, r.kind) for r in kept.collect()) == [("A", "brief"), ("B", "brief")]
    asked = []
    assert main([*store, "summarize", "--schema", "s", "--object", "a"], spark, lambda system, user: asked.append(user) or "anew") == 0
    assert capsys.readouterr().out.strip() == "Object: S.A (PROCEDURE) calls 1"  # stored, so nothing is asked
    assert run("summarize", "--schema", "s", "--object", "a", "--depth", "0", "--force") == "Object: S.A (PROCEDURE) calls 0"
    assert run("summarize", "--schema", "s", "--object", "nope") == "[missing] NOPE"


def test_tables_of_one_write_change_together(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    one, two = spark.range(1), spark.range(2)
    store.write_all({"a": one, "b": one})
    broken = two.selectExpr("assert_true(id > 5) IS NULL AS id")
    with pytest.raises(Exception):  # noqa: B017
        store.write_all({"a": two, "b": broken})
    assert store.read("a").count() == 1 and store.read("b").count() == 1
    store.write_all({"a": two, "b": two})
    assert store.read("a").count() == 2 and store.read("b").count() == 2 and store.read("c") is None


def test_lookups(spark):
    rows = from_texts(spark, [("s", "k", "package", "spec"), ("s", "k", "package body", "body"), ("s", "e", "procedure", None)])
    assert {r.object_name: r.source_text for r in source_text(rows).collect()} == {"K": "body", "E": ""}
    assert parse_hash(rows).count() == 2
    own = spark.createDataFrame([("S", "K", "PACKAGE BODY", "P", "p's text")], "schema_name string, object_name string, object_type string, subprogram_name string, source_text string")
    wanted = spark.createDataFrame([("S", "K", "PACKAGE BODY", x) for x in ("p", "other", None)] + [("S", "NO", "T", "p")], "schema_name string, object_name string, object_type string, subprogram string")
    assert {(r.object_name, r.subprogram): r.source_text for r in recovery.subprogram_text(wanted, rows, own).collect()} == {("K", "p"): "p's text", ("K", "other"): "body", ("K", None): "body", ("NO", "p"): None}


def begin(text):
    """The plain loop: positions of BEGINs that are still open, outside comments and strings."""
    import re

    quiet = re.sub(r"--[^\n]*|/\*.*?\*/|'[^']*'|'[^']*$", lambda m: "." * len(m.group()), text, flags=re.S)
    open_ = []
    for m in re.finditer(r"(?i)(?<![\w$#])(BEGIN|END(\s+(?:IF|LOOP|CASE))?)(?![\w$#])", quiet):
        if m.group(1).upper() == "BEGIN":
            open_.append(m.start() + 1)
        elif not m.group(2) and open_:
            open_.pop()
    return open_[0] if open_ else None


def test_unmatched_begin(spark):
    import random

    rng = random.Random(5)
    bits = ["BEGIN ", "begin\n", "END; ", "END IF; ", "end\nloop; ", "-- BEGIN\n", "/* END */ ", "'BEGIN' ", "'it''s END' ", "x_BEGIN ", "END$ ", "BEGINÄ ", "a - b / c ", "END", " "]
    texts = ["", None, "BEGIN", "END BEGIN", "'open BEGIN"] + ["".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(300)] + ["BEGIN x; END; " * 20_000 + "BEGIN"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").select("n", recovery.unmatched_begin(df_col()).alias("at"))
    got = {r.n: r["at"] for r in df.collect()}
    assert got == {n: begin(t) if t is not None else None for n, t in enumerate(texts)}


def df_col():
    from pyspark.sql import functions as F

    return F.col("t")


def test_loose_statements(spark):
    text = "\n a := 'x;y'; -- c;d\n UPDATE t\n  SET a = 1 /* ; */; ;\nwith q as (1)\n; Execute Immediate 'drop;' -- last\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "-- only\n/* ; */"), (5, "it''s")], "k int, source_text string")
    got = [tuple(r) for r in recovery.loose_statements(df).orderBy("k", "position").collect()]
    assert got == [
        (1, 0, "OTHER", 2, 2, "a := 'x;y'"), (1, 1, "SQL_UPDATE", 3, 4, "UPDATE t\n  SET a = 1"), (1, 2, "SQL_SELECT", 5, 5, "with q as (1)"),
        (1, 3, "SQL_EXECUTE_IMMEDIATE", 6, 6, "Execute Immediate 'drop;'"), (5, 0, "OTHER", 1, 1, "it''s"),
    ]
