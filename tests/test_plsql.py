import random

from plumbline.functions import plsql
from plumbline.functions.plsql import call_target, parse_unit

BODY = """PACKAGE BODY pkg AS
  PROCEDURE run_it(p NUMBER) IS
    v NUMBER := calc.start_value(1);
  BEGIN
    IF v > 1 THEN
      other.do_it(v);
    ELSIF v = 0 THEN
      NULL;
    ELSE
      a.b.c.d(v);
    END IF;
    FOR r IN (SELECT * FROM t1 x, s.t2@link y WHERE x.a = y.a) LOOP
      INSERT INTO t3 (a) SELECT a FROM t4;
    END LOOP;
    v := 1; w := 2;
    COMMIT;
  EXCEPTION
    WHEN OTHERS THEN log_it('x; y');
  END run_it;
END pkg;
"""


def test_targets():
    assert call_target(["P"]) == (None, "P", None)
    assert call_target(["A", "B"]) == (None, "A", "B")
    assert call_target(["W", "X", "Y", "Z"]) == ("X", "Y", "Z")


def test_edges_and_accesses():
    f = parse_unit(BODY, "PKG")
    assert f.status == "ok"
    assert set(f.call_edges) == {("RUN_IT", None, "CALC", "START_VALUE"), ("RUN_IT", None, "OTHER", "DO_IT"), ("RUN_IT", "B", "C", "D"), ("RUN_IT", None, "LOG_IT", None)}
    assert set(f.table_accesses) == {("RUN_IT", None, "T1", "SELECT"), ("RUN_IT", "S", "T2", "SELECT"), ("RUN_IT", None, "T3", "INSERT"), ("RUN_IT", None, "T4", "SELECT")}
    assert [(s[0], s[1], s[2], s[3]) for s in f.subprograms] == [("RUN_IT", "PROCEDURE", 2, 19)]


def test_statement_tree():
    rows = parse_unit(BODY, "PKG").substatements
    kinds = [r[4] for r in rows]
    assert kinds == ["DECLARE", "BEGIN_END", "IF", "OTHER", "IF_ELSIF", "OTHER", "IF_ELSE", "OTHER", "LOOP_FOR", "SQL_INSERT", "OTHER", "EXCEPTION_HANDLER", "OTHER"]
    merged = rows[10]
    assert merged[7] == "v := 1\nw := 2" and merged[3] == 2


def test_wrapped_and_errors():
    assert parse_unit("PACKAGE x wrapped\nabc", "X").status == "wrapped"
    bad = parse_unit("PROCEDURE p IS BEGIN f(1; END;", "P")
    assert bad.status == "error" and bad.error_message.startswith("line") and not bad.call_edges
    assert parse_unit("PROCEDURE p IS BEGIN x := 'open; END;", "P").status == "error"


def calls(body: str) -> set[str]:
    f = parse_unit(f"PROCEDURE p IS BEGIN {body} END;", "P")
    assert f.status == "ok", f.error_message
    return {".".join(x for x in e[1:] if x) for e in f.call_edges}


def tables(body: str) -> set[tuple]:
    f = parse_unit(f"PROCEDURE p IS BEGIN {body} END;", "P")
    assert f.status == "ok", f.error_message
    return {(a[2], a[3]) for a in f.table_accesses}


def test_standard_library_is_no_edge():
    assert calls("raise_application_error(-20001, 'x'); sys.do_it(1); dbms_lob.append(a, b); dbms_session.set_role('x'); to_clob(1);") == {"DBMS_LOB.APPEND"}
    assert calls("SELECT stddev(a), lead(b) OVER (ORDER BY c), percentile_cont(0.5) WITHIN GROUP (ORDER BY d), first_value(e) OVER (ORDER BY f), ntile(4) OVER (ORDER BY g), translate(h, 'a', 'b'), json_object('k' VALUE i), chr(10), xmlagg(j), greatest(1, 2) INTO v FROM t;") == set()
    assert calls("v := pkg.lead(1) + my.chr(2);") == {"PKG.LEAD", "MY.CHR"}


def test_aliases_are_no_tables():
    assert tables("SELECT 1 INTO v FROM t1, (SELECT b FROM t2) z, TABLE(f(1)) q, t3 x WHERE a IN (SELECT c FROM t4);") == {(t, "SELECT") for t in ("T1", "T2", "T3", "T4")}
    assert tables("SELECT 1 INTO v FROM (t1 a JOIN t2 b ON a.x = b.x) LEFT JOIN t3 c ON c.x = a.x;") == {(t, "SELECT") for t in ("T1", "T2", "T3")}


def test_no_source_breaks_a_job():
    deep = "PROCEDURE p IS BEGIN " + "IF a THEN " * 1500 + "NULL;" + " END IF;" * 1500 + " END;"
    assert parse_unit(deep, "P").status in ("ok", "error")
    assert parse_unit("PROCEDURE p IS BEGIN x := = 3 + ; END;", "P").status == "error"
    assert parse_unit("", "P").status in ("ok", "error")
    assert calls("SELECT a INTO v FROM t, u WHERE t.x = u.x (+); v := -f(1);") == {"F"}


def test_multi_table_inserts():
    assert tables("INSERT ALL INTO a1 (x) VALUES (1) INTO s.a2 (x) VALUES (f(2)) SELECT * FROM b;") == {("A1", "INSERT"), ("A2", "INSERT"), ("B", "SELECT")}
    body = "INSERT FIRST WHEN q(x) > 1 THEN INTO a1 INTO a2 (x, y) VALUES (x, (SELECT max(z) FROM m)) WHEN x IN (SELECT k FROM n) THEN INTO a3@far ELSE INTO a4 SELECT x FROM b, c;"
    assert tables(body) == {(f"A{n}", "INSERT") for n in range(1, 5)} | {(t, "SELECT") for t in "MNBC"}
    assert calls(body) == {"Q"} and calls("INSERT ALL INTO a1 (x) VALUES (p.f(1)) INTO a2 (SELECT g(2) FROM b);") == {"P.F", "G"}


def test_from_lists():
    assert tables("SELECT 1 INTO v FROM t1 LEFT JOIN t2 ON t1.a = t2.a AND f(t1.b, t2.b) = 1, t3 x CROSS JOIN t4, s.t5 WHERE a IN (1, b, c) GROUP BY d, e;") == {(f"T{n}", "SELECT") for n in range(1, 6)}
    assert tables("SELECT extract(year FROM d), trim(both 'x' FROM y), extract(day FROM (SELECT e FROM t2)) INTO v FROM t1;") == {("T1", "SELECT"), ("T2", "SELECT")}
    assert tables("DELETE FROM ONLY (v1) WHERE a = 1; UPDATE ONLY (s.v2) SET a = 1, b = c; SELECT 1 INTO v FROM ONLY (v3), v4;") == {("V1", "DELETE"), ("V2", "UPDATE"), ("V3", "SELECT"), ("V4", "SELECT")}
    pivot = "SELECT * INTO v FROM t1 PIVOT (count(*) FOR a IN (1, 2)) p UNPIVOT INCLUDE NULLS (x FOR y IN (b, c)), t2;"
    assert tables(pivot) == {("T1", "SELECT"), ("T2", "SELECT")} and calls(pivot) == set()
    assert tables("MERGE INTO t1 USING (SELECT a, b FROM t2) s ON (t1.a = s.a) WHEN MATCHED THEN UPDATE SET t1.b = s.b, t1.c = f(1, 2) WHEN NOT MATCHED THEN INSERT (a, b) VALUES (s.a, s.b);") == {("T1", "MERGE"), ("T2", "SELECT")}


def test_what_is_no_statement():
    for body in ("foo bar baz;", "IF THEN x; END IF;", "SELECT FROM WHERE;", "SELECT a INTO v FROM WHERE b = 1;", "123 abc;", "garbage here;", "'text';", ";", "SELECT a FROM;"):
        f = parse_unit(f"PROCEDURE p IS BEGIN {body} END;", "P")
        assert f.status == "error" and f.error_message.startswith("line 1:") and not f.call_edges, body
    assert calls("<<l>> foo; foo.bar(1); a.b.c; x.y := 1; r(1).z := 2; EXIT l WHEN f(1); RAISE e; RETURN g(1); GOTO l; PIPE ROW (h(2)); NULL; CALL k(1); SET TRANSACTION READ ONLY;") >= {"FOO", "FOO.BAR", "A.B.C", "F", "G", "H", "K"}


def test_known_shapes_change_no_facts():
    """Statements of known shapes give what the parser of whole sources gives, whatever stands in strings, comments and digits."""
    lines = [
        "pkg_{0}.load_{1}(1);", "v := 'x;''{0}';", "UPDATE app.t_{0} SET a = {1}; -- from x; it's", "IF a{0} > 1 THEN b := c{1}(2); ELSE NULL; END IF;", 'x."a;b{0}"(1);', "/* ; 'a{0} */ nvl2(a{0}, b);", "SELECT q{0} INTO v FROM t{1} a, (SELECT 1 FROM u{0});",
        "v := CAST(a{0} AS VARCHAR2({1}));", "regr_r2(a{0}); regr_r{0}(a);", "BEGIN f{0}(1); EXCEPTION WHEN OTHERS THEN g{1}; END;", "CASE a WHEN {0} THEN h{0}(1); ELSE COMMIT; END CASE;", "p{0}(1", "v := ;", "v := q'[;{0}]';", "'", "END;", "dual{0}.dual(1); DELETE FROM dual;", "a{0}.b{1}.c{0}.d(1)@x;",
    ]
    rng = random.Random(3)
    seen = set()
    for _ in range(1500):
        body = "\n  ".join(rng.choice(lines).format(rng.randrange(200), rng.randrange(3)) for _ in range(rng.randint(1, 6)))
        source = f"CREATE OR REPLACE PACKAGE BODY k{rng.randrange(99)} AS\n PROCEDURE p{rng.randrange(9)} IS v{rng.randrange(9)} NUMBER;\nBEGIN\n  {body}\nEND;\nEND;\n"
        whole = plsql.parse_whole(source, "k")
        assert parse_unit(source, "k") == whole, source
        some = parse_unit(source, "k", ["table_accesses"])
        assert (some.status, some.table_accesses) == (whole.status, whole.table_accesses)
        seen.add(whole.status)
    assert seen == {"ok", "error"}


def test_statements_of_one_shape_are_taken_into_tokens_once(monkeypatch):
    made = []
    monkeypatch.setattr(plsql, "Token", lambda *a, make=plsql.Token: made.append(a) or make(*a))
    source = "PROCEDURE p IS\nBEGIN\n" + "".join(f"  some_name_{n}.other_{n + 1}(1);\n  INSERT INTO target_{n} (a, b) VALUES (1, 2);\n" for n in range(500)) + "END;\n"
    f = parse_unit(source, "p")
    assert len(f.call_edges) == len(f.table_accesses) == 500 and len(made) < 1200  # an end each; 12,500 tokens otherwise
