"""Fact extraction from one PL/SQL unit: a tokenizer and an island parser of blocks, statements and SQL.

Known gap: it accepts more than a full grammar does. It reports unbalanced parentheses and blocks, open
strings and comments, missing statement ends, conditions and clauses, and names with something else than
parentheses, `:=` or an end after them; it skips what it does not know up to the next `;`.
"""

from __future__ import annotations

import re
import time
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

#: Seconds that one source may take.
LIMIT = 60

#: Packages and functions of the standard library; calls of which they are the object are no edges.
BUILTINS = frozenset(
    "DBMS_OUTPUT DBMS_SQL DBMS_UTILITY DBMS_METADATA DBMS_LOCK DBMS_SESSION DBMS_APPLICATION_INFO DBMS_TRANSACTION UTL_FILE UTL_HTTP UTL_SMTP UTL_RAW UTL_I18N SYS STANDARD DUAL "
    "TO_DATE TO_CHAR TO_NUMBER TO_TIMESTAMP TO_CLOB NVL NVL2 NULLIF COALESCE DECODE TRIM LTRIM RTRIM SUBSTR INSTR LENGTH UPPER LOWER REPLACE REGEXP_REPLACE REGEXP_LIKE SYSDATE SYSTIMESTAMP "
    "TRUNC ROUND FLOOR CEIL ABS MOD POWER SQRT RAISE_APPLICATION_ERROR ROWNUM ROWID".split()
)
#: Functions that the grammar knows by name; without a dot before them they are no calls.
STANDARD = frozenset(
    "SUBSTR TO_CHAR DECODE CHR NVL TRIM TO_DATE SUM COUNT ROUND AVG MIN MAX LEAST GREATEST CORR LAG_DIFF LAG_DIFF_PERCENT MEDIAN NTH_VALUE NTILE RATIO_TO_REPORT ROW_NUMBER VARIANCE "
    "REGR_SLOPE REGR_INTERCEPT REGR_COUNT REGR_R2 REGR_AVGX REGR_AVGY REGR_SXX REGR_SYY REGR_SXY STDDEV STDDEV_POP STDDEV_SAMP VAR_POP VAR_SAMP COVAR_POP COVAR_SAMP "
    "CAST XMLCAST COALESCE COLLECT CUME_DIST DENSE_RANK LISTAGG PERCENT_RANK PERCENTILE_CONT PERCENTILE_DISC RANK DECOMPOSE EXTRACT FIRST_VALUE LAST_VALUE LEAD LAG "
    "PREDICTION PREDICTION_BOUNDS PREDICTION_COST PREDICTION_DETAILS PREDICTION_PROBABILITY PREDICTION_SET TO_BINARY_DOUBLE TO_BINARY_FLOAT TO_NUMBER TO_TIMESTAMP TO_TIMESTAMP_TZ TO_DSINTERVAL TO_YMINTERVAL "
    "TRANSLATE TREAT VALIDATE_CONVERSION XMLAGG XMLCOLATTVAL XMLFOREST XMLELEMENT XMLEXISTS XMLPARSE XMLPI XMLQUERY XMLROOT XMLSERIALIZE XMLTABLE "
    "JSON_ARRAY JSON_ARRAYAGG JSON_OBJECT JSON_OBJECTAGG JSON_QUERY JSON_SERIALIZE JSON_TRANSFORM JSON_VALUE JSON_TABLE".split()
)
#: Operators that need a value after them, and what stands there when none does.
NEEDS_VALUE = frozenset([":=", "=", "<", ">", "<=", ">=", "<>", "!=", "^=", "~=", "+", "-", "||"])
NO_VALUE = frozenset([";", ",", ":=", "=", "<", ">", "<=", ">=", "<>", "!=", "^=", "~=", "*", "||"])

#: Words that an opening parenthesis may follow without a call.
KEYWORDS = frozenset(
    "AND OR NOT IN IF ELSIF WHILE WHEN THEN ELSE CASE RETURN SELECT FROM WHERE ON USING VALUES INTO SET BY HAVING UNION ALL ANY SOME EXISTS BETWEEN LIKE IS NULL AS OVER PARTITION WITHIN GROUP ORDER KEEP "
    "INTERSECT MINUS JOIN INNER LEFT RIGHT FULL OUTER CROSS NATURAL LATERAL TABLE LOOP FOR FORALL BEGIN END DECLARE EXIT CONTINUE GOTO RAISE CURSOR TYPE RECORD VARRAY OF INDEX INSERT UPDATE DELETE MERGE "
    "EXECUTE IMMEDIATE VARCHAR2 VARCHAR CHAR NCHAR NVARCHAR2 NUMBER RAW FLOAT DECIMAL NUMERIC INTEGER TIMESTAMP INTERVAL CAST EXTRACT CONNECT START PRIOR DISTINCT UNIQUE FETCH OPEN CLOSE PIPE MULTISET MEMBER "
    "DENSE_RANK RANK ROW_NUMBER FIRST LAST LISTAGG MEDIAN REVERSE WITH LIMIT BULK COLLECT RETURNING SAVE EXCEPTIONS PACKAGE PROCEDURE FUNCTION".split()
)
#: Functions with a FROM of their own in their parentheses.
FROM_INSIDE = frozenset(["EXTRACT", "TRIM", "OVERLAY", "SUBSTRING"])
#: Words that begin a statement, which more than a call may follow.
BEGINS = frozenset("EXIT CONTINUE GOTO RAISE RETURN PIPE PRAGMA SET NULL CALL FORALL LOCK ROLLBACK COMMIT SAVEPOINT TRUNCATE ALTER CREATE DROP GRANT REVOKE".split())
_TOKEN = re.compile(
    r"\s*(?:(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<badcomment>/\*)|(?P<q>[nN]?[qQ]'(?:\[.*?\]|\{.*?\}|\(.*?\)|<.*?>|(?P<d>[^\s\[{(<]).*?(?P=d))')|(?P<str>[nN]?'(?:[^']|'')*')|(?P<badstr>')"
    r"|(?P<id>\"[^\"]*\"|[^\W\d][\w$#]*)|(?P<num>\d+(?:\.(?!\.)\d*)?(?:[eE][+-]?\d+)?)|(?P<end>\Z)|(?P<op>:=|=>|\.\.|\|\||<<|>>|<=|>=|<>|!=|\^=|~=|\*\*|.))",
    re.S,
)


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    at: int
    line: int
    upper: str


@dataclass
class Facts:
    status: str = "ok"
    error_message: str | None = None
    call_edges: list[tuple] = field(default_factory=list)
    table_accesses: list[tuple] = field(default_factory=list)
    subprograms: list[tuple] = field(default_factory=list)
    substatements: list[tuple] = field(default_factory=list)


class Problem(Exception):
    pass


class Timeout(Problem):
    pass


def tokens(source: str, base: int = 0, first: int = 1) -> list[Token]:
    """Tokens of a source, or of the part of one that begins at base, in line first."""
    out, line = [], 1
    breaks = [m.start() for m in re.finditer("\n", source)] + [len(source) + 1]
    for m in _TOKEN.finditer(source):
        kind = m.lastgroup or ""
        kind = "q" if kind == "d" else kind
        if kind in ("comment", "end"):
            continue
        text, at = m.group(kind), m.start(kind)
        while breaks[line - 1] < at:
            line += 1
        if kind in ("badstr", "badcomment"):
            raise Problem(f"line {line}:{at - source.rfind(chr(10), 0, at) - 1} open {'string' if kind == 'badstr' else 'comment'}")
        out.append(Token(kind, text, at + base, line + first - 1, text.upper() if kind == "id" else text))
    return out


def check_values(t: list[Token], source: str) -> None:
    for x, y in zip(t, t[1:], strict=False):
        if x.kind == y.kind == "op" and x.text in NEEDS_VALUE and y.text in NO_VALUE:
            raise Problem(f"line {y.line}:{y.at - source.rfind(chr(10), 0, y.at) - 1} no value before {y.text}")


WRAPPED = re.compile(r"^\s*\w+(\s+\w+)*\s+wrapped\b", re.I | re.M)


def call_target(parts: list[str]) -> tuple[str | None, str, str | None]:
    """Schema, object, subprogram of a dotted name: one part is the object, two are object and subprogram, of more the last three count."""
    if len(parts) == 1:
        return None, parts[0], None
    if len(parts) == 2:
        return None, parts[0], parts[1]
    return parts[-3], parts[-2], parts[-1]


#: The lists of facts.
FACTS = ("call_edges", "table_accesses", "subprograms", "substatements")


class Parser:
    def __init__(self, source: str, name: str, wanted: Collection[str] = FACTS):
        self.source, self.name = source, name.upper()
        self.edges, self.accesses, self.records = ("call_edges" in wanted), ("table_accesses" in wanted), ("substatements" in wanted)
        self.t = self.read()
        self.x = 0
        self.scope: list[str] = []
        self.facts = Facts()
        self.seen: set[tuple] = set()
        self.seqs: dict[str, int] = {}
        self.until_time = time.monotonic() + LIMIT

    # -- reading
    def read(self) -> list[Token]:
        t = tokens(self.source)
        check_values(t, self.source)
        return t

    def more(self) -> bool:
        """Whether further tokens came; here all are there from the beginning."""
        return False

    def up(self, k: int = 0) -> str:
        return self.t[self.x + k].upper if self.x + k < len(self.t) else ""

    def fail(self, what: str) -> Problem:
        t = self.t[min(self.x, len(self.t) - 1)] if self.t else None
        return Problem(f"line {t.line}:{t.at - self.source.rfind(chr(10), 0, t.at) - 1} {what}" if t else f"line 1:0 {what}")

    def slice(self, a: int, b: int) -> str:
        """Text from token a up to and with token b - 1."""
        return self.source[self.t[a].at : self.t[b - 1].at + len(self.t[b - 1].text)]

    # -- facts
    def edge(self, parts: list[str]) -> None:
        schema, obj, sub = call_target(parts)
        row = (self.scope[-1] if self.scope else None, schema, obj, sub)
        if obj not in BUILTINS and ("e", *row) not in self.seen:
            self.seen.add(("e", *row))
            self.facts.call_edges.append(row)

    def access(self, name: str, op: str) -> None:
        name = name.upper().split("@")[0]
        schema, _, table = name.partition(".") if "." in name else ("", "", name)
        scope = self.scope[-1] if self.scope else None
        if table and table != "DUAL" and ("a", scope, table, op) not in self.seen:
            self.seen.add(("a", scope, table, op))
            self.facts.table_accesses.append((scope, schema or None, table, op))

    def statement(self, parent: int | None, position: int, kind: str, a: int, b: int, text: str | None = None) -> int:
        if time.monotonic() > self.until_time:
            raise Timeout(f"timeout after {LIMIT} s")
        sub = self.scope_name
        seq = self.seqs.get(sub, 0)
        self.seqs[sub] = seq + 1
        if not self.records and kind not in ("CASE", "CASE_WHEN", "CASE_ELSE"):  # those are looked up again
            return seq
        end = self.t[b - 1]
        self.facts.substatements.append((sub, seq, parent, position, kind, self.t[a].line, end.line + end.text.count("\n"), text if text is not None else self.slice(a, b)))
        return seq

    # -- expressions and SQL: an island scan of tokens a..b
    def scan(self, a: int, b: int, op: str | None = None, call: bool = False) -> None:
        """Calls and table names between two tokens. op: the SQL operation at the outside; call: a call statement stands here."""
        frames: list[dict] = [{"op": op, "tables": False}]
        x = a
        t = self.t
        if call:
            parts, y = self.dotted(a)
            if parts and (y >= b or t[y].text not in ("(",)):
                self.edge(parts)
        while x < b:
            u = t[x].upper
            f = frames[-1]
            if t[x].text == "(":
                inner = t[x + 1].upper if x + 1 < b else ""
                wanted = f["tables"] and f.get("want") and not (x > a and t[x - 1].upper in ("TABLE", "LATERAL"))
                f["want"] = False  # what stands in these parentheses is this place's table; a name after them is its alias
                if wanted and inner not in ("SELECT", "WITH"):  # a join in parentheses
                    frames.append({"op": f["op"], "tables": True, "want": True})
                    x += 1
                    continue
                # a subquery in a FROM list or after INTO is a statement of its own; others keep the operation outside
                frames.append({"op": "SELECT" if inner in ("SELECT", "WITH") and f["tables"] else f["op"], "tables": False, "arg": not f["tables"], "from_off": x > a and t[x - 1].upper in FROM_INSIDE})
            elif t[x].text == ")":
                if len(frames) > 1:
                    frames.pop()
                frames[-1]["alias"] = True
            elif t[x].kind == "id":
                if u in ("FROM", "JOIN") and f["op"] and not f.get("from_off"):
                    f["tables"], f["want"] = True, True
                elif u == "ONLY" and f["tables"] and f.get("want") and x + 1 < b and t[x + 1].text == "(":
                    pass  # its view stands in the parentheses
                elif u in ("PIVOT", "UNPIVOT", "NULLS") and f["tables"] and not f.get("want") and x + 1 < b and (t[x + 1].text == "(" or t[x + 1].upper in ("XML", "INCLUDE", "EXCLUDE")):
                    pass
                elif u == "USING" and f["op"] == "MERGE":
                    f["tables"], f["want"] = True, False
                elif u in ("WHERE", "SET", "GROUP", "ORDER", "CONNECT", "START", "ON", "HAVING", "UNION", "INTERSECT", "MINUS", "VALUES", "SELECT", "RETURNING", "FETCH", "MODEL", "WHEN"):
                    f["joined"] = u == "ON" and (f["tables"] or f.get("joined", False)) and f["op"] != "MERGE"  # a comma may go on with the FROM list
                    f["tables"], f["want"] = False, False
                    if u == "SELECT" and f["op"] == "INSERT":
                        f["op"] = "SELECT"
                elif f["tables"] and f.get("want") and u not in KEYWORDS:
                    parts, y = self.dotted(x)
                    if y < b and t[y].text == "@":
                        y += 2
                    if not (y < b and t[y].text == "("):
                        self.access(".".join(parts), f["op"])
                        f["want"] = False
                        x = y
                        continue
                    f["want"] = False
                elif u not in KEYWORDS and (x == a or t[x - 1].text != "."):
                    parts, y = self.dotted(x)
                    k = x
                    while y < b and t[y].text == "(" and not (y + 2 < b and t[y + 1].text == "+" and t[y + 2].text == ")"):  # (+) marks an outer join
                        if not (f["tables"] and f.get("want")) and not (len(parts) == 1 and parts[0] in STANDARD):
                            self.edge(parts)
                        close = self.closing(y, b)
                        if close + 1 < b and t[close + 1].text == "." and t[close + 2].kind == "id":
                            self.scan(y + 1, close, f["op"])
                            more, y = self.dotted(close + 2)
                            parts = parts + more
                            k = y
                        else:
                            k = y
                            break
                    else:
                        k = max(y, x + 1)
                    x = k
                    continue
            elif t[x].text == "," and (f["tables"] or f.get("joined")):
                f["tables"], f["want"], f["joined"] = True, True, False
            x += 1

    def dotted(self, x: int) -> tuple[list[str], int]:
        parts = []
        while x < len(self.t) and self.t[x].kind == "id":
            parts.append(self.t[x].upper)
            x += 1
            if x + 1 < len(self.t) and self.t[x].text == "." and self.t[x + 1].kind == "id":
                x += 1
            else:
                break
        return parts, x

    def closing(self, x: int, b: int) -> int:
        depth = 0
        for y in range(x, b):
            depth += (self.t[y].text == "(") - (self.t[y].text == ")")
            if depth == 0:
                return y
        self.x = x
        raise self.fail("missing ')'")

    def sql(self, a: int, b: int) -> None:
        """A SQL statement's table accesses and calls."""
        kind = self.t[a].upper
        kind = "SELECT" if kind == "WITH" else kind
        if kind == "SELECT":
            self.clauses(a, b)
            self.scan(a, b, "SELECT")
        elif kind in ("INSERT", "UPDATE", "DELETE", "MERGE"):
            x = a + 1
            if kind == "INSERT" and x < b and self.t[x].upper in ("ALL", "FIRST"):
                return self.insert_all(x + 1, b)
            while x < b and self.t[x].upper in ("INTO", "FROM"):
                x += 1
            only = x + 1 < b and self.t[x].upper == "ONLY" and self.t[x + 1].text == "("
            parts, y = self.dotted(x + 2 if only else x)
            if parts:
                self.access(".".join(parts), kind)
            if only:
                y = self.closing(x + 1, b) + 1
            if y < b and self.t[y].text == "@":
                y += 2
            if kind == "INSERT" and y < b and self.t[y].text == "(" and self.t[y + 1].upper not in ("SELECT", "WITH"):
                y = self.closing(y, b) + 1  # the list of columns
            self.scan(y, b, kind)
        else:
            self.scan(a, b)

    def clauses(self, a: int, b: int) -> None:
        """SELECT is followed by what is selected, FROM by what it is selected from."""
        for x in range(a, b):
            u, after = self.t[x].upper, self.t[x + 1] if x + 1 < b else None
            if self.t[x].kind == "id" and (x == a or self.t[x - 1].text != ".") and (
                (u == "SELECT" and (after is None or after.upper == "FROM")) or (u == "FROM" and (after is None or after.upper in ("WHERE", "GROUP", "ORDER", "HAVING", "CONNECT") or after.text in (")", ",")))
            ):
                self.x = min(x + 1, len(self.t) - 1)
                raise self.fail(f"nothing after {u}")

    def insert_all(self, x: int, b: int) -> None:
        """A multi-table insert: each INTO has a target; its conditions, its values and the query are scanned."""
        while x < b:
            u = self.t[x].upper
            query = self.t[x].text == "(" and x + 1 < b and self.t[x + 1].upper in ("SELECT", "WITH")
            if u in ("SELECT", "WITH") or query:
                self.scan(x, b, "SELECT")
                return
            if u == "INTO":
                parts, x = self.dotted(x + 1)
                if parts:
                    self.access(".".join(parts), "INSERT")
                if x < b and self.t[x].text == "@":
                    x += 2
                if x < b and self.t[x].text == "(" and self.t[x + 1].upper not in ("SELECT", "WITH"):
                    x = self.closing(x, b) + 1  # the list of columns
                continue
            y = x  # a condition, or values
            while y < b and self.t[y].upper not in ("INTO", "SELECT", "WITH") and (y == x or self.t[y].text != "(" or self.t[y + 1].upper not in ("SELECT", "WITH") or self.t[y - 1].upper in ("IN", "EXISTS", "ANY", "ALL", "SOME")):
                y = self.closing(y, b) + 1 if self.t[y].text == "(" else y + 1
            self.scan(x, y, "INSERT")
            x = max(y, x + 1)

    def until(self, *stops: str) -> int:
        """The index of the next stop word or `;` outside parentheses and CASE expressions."""
        depth, case, y = 0, 0, self.x
        while y < len(self.t) or self.more():
            u = self.t[y].upper
            if self.t[y].text == "(":
                depth += 1
            elif self.t[y].text == ")":
                depth -= 1
                if depth < 0:
                    self.x = y
                    raise self.fail("extraneous ')'")
            elif not depth and not case and (u in stops or self.t[y].text == ";"):
                return y
            elif u == "CASE":
                case += 1
            elif u == "END" and case:
                case -= 1
            y += 1
        self.x = len(self.t) - 1
        raise self.fail("missing ';'")

    # -- statements
    def end_of(self, *words: str) -> None:
        if self.up() != "END":
            raise self.fail("missing END")
        self.x += 1
        for w in words:
            if self.up() != w:
                raise self.fail(f"missing {w}")
            self.x += 1
        while self.up() not in (";", ""):
            self.x += 1
        if self.up() != ";":
            self.x = len(self.t) - 1
            raise self.fail("missing ';'")
        self.x += 1

    def body(self, parent: int | None, position: int, first: int | None = None) -> int:
        """BEGIN statements [EXCEPTION handlers] END; -> its sequence number."""
        if self.up() != "BEGIN":
            raise self.fail("missing BEGIN")
        seq = self.statement(parent, position, "BEGIN_END", self.x, self.x + 1)
        self.x += 1
        n = self.statements(seq, 0, ("END", "EXCEPTION"))
        if self.up() == "EXCEPTION":
            self.x += 1
            while self.up() == "WHEN":
                a = self.x
                self.x = self.until("THEN") + 1
                h = self.statement(seq, n, "EXCEPTION_HANDLER", a, self.x)
                n += 1
                self.statements(h, 0, ("WHEN", "END"))
        self.end_of()
        return seq

    def statements(self, parent: int, position: int, stops: tuple[str, ...]) -> int:
        while True:
            while self.up() == "<<":
                self.x += 3
            u = self.up()
            if not u:
                self.x = len(self.t) - 1
                raise self.fail("missing END")
            if u in stops:
                return position
            position += self.one(parent, position)

    def one(self, parent: int, position: int) -> int:
        """One statement; 0 if it leaves no record."""
        a, u = self.x, self.up()
        if u == "IF":
            self.x = self.until("THEN") + 1
            self.condition(a + 1, self.x - 1)
            self.scan(a + 1, self.x - 1)
            seq = self.statement(parent, position, "IF", a, self.x)
            n = self.statements(seq, 0, ("ELSIF", "ELSE", "END"))
            while self.up() in ("ELSIF", "ELSE"):
                b, word = self.x, self.up()
                self.x = self.until("THEN") + 1 if word == "ELSIF" else self.x + 1
                self.scan(b + 1, self.x)
                k = self.statement(seq, n, "IF_" + word, b, self.x)
                n += 1
                self.statements(k, 0, ("ELSIF", "ELSE", "END"))
            self.end_of("IF")
        elif u in ("LOOP", "FOR", "WHILE"):
            self.x = self.until("LOOP") + 1
            self.scan(a + 1, self.x - 1, "SELECT" if "SELECT" in {t.upper for t in self.t[a : self.x]} else None)
            seq = self.statement(parent, position, {"LOOP": "LOOP_BASIC", "FOR": "LOOP_FOR", "WHILE": "LOOP_WHILE"}[u], a, self.x)
            self.statements(seq, 0, ("END",))
            self.end_of("LOOP")
        elif u == "CASE":
            at = len(self.facts.substatements)
            seq = self.statement(parent, position, "CASE", a, a + 1)
            self.x += 1
            b = self.x
            self.x = self.until("WHEN")
            self.scan(b, self.x)
            n = 0
            while self.up() in ("WHEN", "ELSE"):
                b, word, mark = self.x, self.up(), len(self.facts.substatements)
                self.x = self.until("THEN") + 1 if word == "WHEN" else self.x + 1
                self.scan(b + 1, self.x)
                k = self.statement(seq, n, "CASE_" + word, b, self.x)
                n += 1
                self.statements(k, 0, ("WHEN", "ELSE", "END"))
                self.whole(mark, b)
            self.end_of("CASE")
            self.whole(at, a)
        elif u == "DECLARE":
            self.block(None)
            self.statement(parent, position, "OTHER", a, self.x)
        elif u == "BEGIN":
            self.body(parent, position)
        else:
            self.x = self.until()
            b = self.x
            self.x += 1
            if u == "FORALL":
                dml = next((y for y in range(a, b) if self.t[y].upper in ("INSERT", "UPDATE", "DELETE", "MERGE")), None)
                self.scan(a + 1, dml or b)
                if dml:
                    self.sql(dml, b)
                self.statement(parent, position, "FORALL", a, b)
            elif u in ("SELECT", "WITH", "INSERT", "UPDATE", "DELETE", "MERGE"):
                self.sql(a, b)
                self.statement(parent, position, "SQL_" + ("SELECT" if u == "WITH" else u), a, b)
            elif u == "EXECUTE":
                self.scan(a + 2, b)
                self.statement(parent, position, "SQL_EXECUTE_IMMEDIATE", a, b)
            elif u in ("OPEN", "FETCH", "CLOSE", "COMMIT", "ROLLBACK", "SAVEPOINT", "LOCK", "EXPLAIN"):
                query = next((y for y in range(a, b) if self.t[y].upper == "SELECT"), None)
                self.scan(a + 1, query or b)
                if query:
                    self.sql(query, b)
                return 0
            else:
                plain = ":=" not in {t.text for t in self.t[a:b]} and u not in KEYWORDS and u != "NULL"
                self.whole_call(a, b)
                begin = a + (u == "CALL")
                self.scan(begin, b, None, call=plain and self.t[a].kind == "id")
                self.statement(parent, position, "OTHER", a, b)
        return 1

    def whole_call(self, a: int, b: int) -> None:
        """A statement that begins with a name is a call or an assignment: after the name stand parentheses, `:=` or nothing."""
        if self.t[a].kind in ("num", "str", "q") or b == a:
            self.x = a
            raise self.fail(f"a statement can't begin with {self.t[a].text}")
        if self.t[a].kind == "id" and self.t[a].upper not in KEYWORDS and self.t[a].upper not in BEGINS:
            _, y = self.dotted(a)
            if y < b and self.t[y].kind in ("id", "num", "str", "q"):
                self.x = y
                raise self.fail(f"unexpected {self.t[y].text}")

    def condition(self, a: int, b: int) -> None:
        if a >= b:
            self.x = a
            raise self.fail("missing condition")

    def whole(self, at: int, a: int) -> None:
        """Give a recorded statement the text up to here."""
        r = list(self.facts.substatements[at])
        end = self.t[self.x - 1]
        r[6], r[7] = end.line, self.slice(a, self.x).rstrip(";") if r[4] == "CASE" else self.slice(a, self.x)
        self.facts.substatements[at] = tuple(r)

    # -- declarations and units
    def declarations(self) -> None:
        """Up to BEGIN or END: nested subprograms are taken apart, cursors and defaults scanned."""
        while self.up() not in ("BEGIN", "END", ""):
            if self.up() in ("PROCEDURE", "FUNCTION"):
                self.subprogram()
                continue
            a = self.x
            self.x = self.until()
            query = next((y for y in range(a, self.x) if self.t[y].upper in ("SELECT", "WITH")), None)
            if self.t[a].upper == "CURSOR" and query:
                self.sql(query, self.x)
            else:
                default = next((y for y in range(a, self.x) if self.t[y].text == ":=" or self.t[y].upper == "DEFAULT"), None)
                if default:
                    self.scan(default + 1, self.x)
            self.x += 1

    def block(self, parent: int | None) -> None:
        """A nested DECLARE block: its facts count, its statements stand as one."""
        kept, seqs = len(self.facts.substatements), dict(self.seqs)
        self.x += 1
        self.declarations()
        self.body(parent, 0)
        del self.facts.substatements[kept:]
        self.seqs = seqs

    @property
    def scope_name(self) -> str:
        return self.sub

    sub = ""

    def subprogram(self, standalone: bool = False) -> None:
        a, kind = self.x, self.up()
        self.x += 1
        parts, self.x = self.dotted(self.x)
        name = self.name if standalone else parts[-1]
        head = self.until("IS", "AS")
        if self.t[head].text == ";":  # a declaration only
            self.x = head + 1
            return
        self.x = head + 1
        if self.up() in ("LANGUAGE", "EXTERNAL"):
            self.x = self.until() + 1
            return
        place = len(self.facts.subprograms)
        self.facts.subprograms.append(())
        outer = self.sub
        if not standalone:
            self.scope.append(name)
        self.sub = name
        first = self.x
        self.declarations()
        position = 0
        if self.x > first and self.up() == "BEGIN":
            self.statement(None, position, "DECLARE", first, self.x)
            position += 1
        self.body(None, position)
        if not standalone:
            self.scope.pop()
        self.sub = outer
        self.facts.subprograms[place] = (name, kind, self.t[a].line, self.t[self.x - 1].line, self.slice(a, self.x))

    def unit(self) -> None:
        while self.up():
            while self.up() in ("CREATE", "OR", "REPLACE", "EDITIONABLE", "NONEDITIONABLE", "/", ";"):
                self.x += 1
            u = self.up()
            if not u:
                return
            if u in ("PROCEDURE", "FUNCTION"):
                self.subprogram(standalone=True)
            elif u in ("PACKAGE", "TYPE"):
                self.x = self.until("IS", "AS") + 1
                if self.t[self.x - 1].text == ";":
                    continue
                self.declarations()
                if self.up() == "BEGIN":
                    kept = len(self.facts.substatements)
                    self.body(None, 0)
                    del self.facts.substatements[kept:]
                elif self.up() == "END":
                    self.end_of()
                else:
                    self.x = len(self.t) - 1
                    raise self.fail("missing END")
            elif u in ("DECLARE", "BEGIN", "TRIGGER"):
                kept = len(self.facts.substatements)
                while self.up() not in ("DECLARE", "BEGIN", ""):
                    self.x += 1
                if self.up() == "DECLARE":
                    self.x += 1
                    self.declarations()
                self.body(None, 0)
                del self.facts.substatements[kept:]
            else:
                a = self.x
                self.x = self.until()
                if u in ("SELECT", "WITH", "INSERT", "UPDATE", "DELETE", "MERGE"):
                    self.sql(a, self.x)
                self.x += 1


#: Runs of digits, which tell statements of one shape apart.
_DIGITS = re.compile("[0-9]+")
#: Words of the fixed values that have digits and decide how a statement is read; private characters, which stand for digits in shapes.
_NO_SHAPE = re.compile("(?i)VARCHAR0|REGR_R0|[\\ue000-\\uf8ff\\0]")
_WORD = re.compile(r"\s*([^\W\d][\w$#]*)(?=\s)")
#: What begins no simple statement.
_NOT_SIMPLE = frozenset(["", "<<", "IF", "LOOP", "FOR", "WHILE", "CASE", "DECLARE", "BEGIN", "END", "EXCEPTION", "WHEN", "ELSIF", "ELSE"])
#: Known shapes, at most so many, of at most so many characters each; longer statements are read each time.
_SHAPES: dict[str, tuple[tuple | None, list | None] | None] = {}
SHAPES, SHAPE_CHARS = 8192, 2000
#: A source with more `;` than this in one string or comment is read by Parser.
OPEN_PIECES = 50


class Shape(Parser):
    """One statement with a private character for each run of digits: what it does is taken down, with those characters in the names."""

    def read(self) -> list[Token]:
        t = super().read()
        for x in t:
            if x.kind == "id" and "0" in x.text:
                run = iter(range(self.source.count("0", 0, x.at), len(self.source)))
                x.upper = re.sub("0", lambda _, run=run: chr(0xE000 + next(run)), x.upper)
        return t

    def edge(self, parts: list[str]) -> None:
        self.does["e"].append(call_target(parts))

    def access(self, name: str, op: str) -> None:
        name = name.split("@")[0]
        schema, _, table = name.partition(".") if "." in name else ("", "", name)
        if table and table != "DUAL":
            self.does["a"].append((schema or None, table, op))

    def statement(self, parent: int | None, position: int, kind: str, a: int, b: int, text: str | None = None) -> int:
        self.kind, self.a, self.b = kind, a, b
        return 0

    kind, a, b = "", 0, 1

    def taken(self) -> tuple | None:
        """What the statement does, None if it is no simple one: runs of digits, lines, calls, accesses, kind, its first and last line, where its text begins and how much follows it."""
        self.does: dict[str, list[tuple]] = {"e": [], "a": []}
        try:
            if self.up() in _NOT_SIMPLE:
                return None
            self.one(None, 0)
        except (Problem, IndexError):
            return None
        first, end = self.t[self.a], self.t[self.b - 1]
        tail = len(self.source) - end.at - len(end.text)
        if self.x != len(self.t) or self.source.count("0") > 6000 or "0" in self.source[: first.at] or "0" in self.source[len(self.source) - tail :]:
            return None

        def told(rows: list[tuple]) -> tuple:
            """The format of all names (split by a null), its runs of digits, and rows of places of names (-1: none)."""
            names, places = [], []
            for row in rows:
                places.append(tuple(-1 if name is None else len(names) + sum(x is not None for x in row[:n]) for n, name in enumerate(row)))
                names += [x for x in row if x is not None]
            text = "\0".join(names).replace("%", "%%")
            runs = tuple(ord(x) - 0xE000 for x in re.findall("[\ue000-\uf8ff]", text))
            return re.sub("[\ue000-\uf8ff]", "%s", text), runs, tuple(places)

        return (
            self.source.count("0"), self.source.count("\n"), told([x for x in self.does["e"] if x[1] not in BUILTINS]), told(self.does["a"]),
            self.kind, first.line - 1, end.line - 1 + end.text.count("\n"), first.at, tail,
        )


def _shape(piece: str) -> tuple[tuple | None, list | None] | None:
    """What a statement up to a `;` does, digits apart (see Shape.taken), and its tokens with the runs of digits before and in them, where digits don't matter; None if the `;` stands in a string or comment."""
    try:
        t = tokens(piece)
    except Problem:
        return None
    if not t or t[-1].text != ";" or t[-1].kind != "op" or any(x.kind == "op" and x.text == '"' for x in t):
        return None
    try:
        check_values(t, piece)
    except Problem:
        return None, None
    if _NO_SHAPE.search(piece):
        return None, None
    return Shape(piece, "").taken(), [(x.kind, x.text, x.at, x.line - 1, x.upper, piece.count("0", 0, x.at), x.text.count("0")) for x in t]


class Quick(Parser):
    """A Parser that reads a source statement by statement. Statements of a known shape, in a list of statements, are not taken
    into tokens: only what their digits make of the shape's names is worked out. It fails where Parser fails, but not with the same message.
    """

    def read(self) -> list[Token]:
        if "q'" in self.source or "Q'" in self.source:  # may hold single quotes
            raise Problem("alternative quotes")
        self.plain, self.runs = _DIGITS.sub("0", self.source), _DIGITS.findall(self.source)
        self.longer = [0, *accumulate([len(x) - 1 for x in self.runs])]
        self.at, self.run, self.line, self.ready = 0, 0, 1, None  # at: in plain
        return []

    def up(self, k: int = 0) -> str:
        while self.x + k >= len(self.t):
            if not self.more():
                return ""
        return self.t[self.x + k].upper

    def piece(self) -> tuple[str, tuple[tuple | None, list | None]]:
        """The plain source from here up to the next `;` outside strings and comments, and its shape."""
        end = self.at
        for _ in range(OPEN_PIECES):
            end = self.plain.find(";", end) + 1
            if not end:
                return self.plain[self.at :], (None, None)
            piece = self.plain[self.at : end]
            found = _SHAPES.get(piece, _SHAPES)
            if found is _SHAPES:
                found = _shape(piece)
                if len(piece) <= SHAPE_CHARS:
                    if len(_SHAPES) >= SHAPES:
                        _SHAPES.clear()
                    _SHAPES[piece] = found
            if found is not None:
                return piece, found
        raise Problem("many open pieces")

    def more(self) -> bool:
        if self.at >= len(self.plain):
            return False
        (piece, shape), self.ready = self.ready or self.piece(), None
        m = _WORD.match(piece)
        if m and m[1].upper() in ("BEGIN", "ELSE"):
            piece = m[0]
            self.t.append(Token("id", m[1], self.at + self.longer[self.run] + m.start(1), self.line + piece.count("\n"), m[1].upper()))
        elif shape[1] is not None:
            self.t += self.retold(shape[1])
        else:
            at, runs = self.at + self.longer[self.run], piece.count("0")
            found = tokens(self.source[at : self.at + len(piece) + self.longer[self.run + runs]], at, self.line)
            check_values(found, self.source)
            self.t += found
        self.at += len(piece)
        self.run += piece.count("0")
        self.line += piece.count("\n")
        return True

    def retold(self, shape: list) -> Iterator[Token]:
        """The tokens of a piece by those of its shape."""
        longer, run = self.longer, self.run
        for kind, text, at, line, upper, before, within in shape:
            begin = self.at + at + longer[run + before]
            if within:
                text = self.source[begin : self.at + at + len(text) + longer[run + before + within]]
                upper = text.upper() if kind == "id" else text
            yield Token(kind, text, begin, self.line + line, upper)

    def statements(self, parent: int, position: int, stops: tuple[str, ...]) -> int:
        while True:
            while self.x == len(self.t) and self.at < len(self.plain):
                piece, (does, _) = self.ready = self.piece()
                if does is None:
                    break
                position += self.same(piece, does, parent, position)
                self.ready = None
            while self.up() == "<<":
                self.x += 3
            u = self.up()
            if not u:
                raise self.fail("missing END")
            if u in stops:
                return position
            position += self.one(parent, position)

    def named(self, form: str, runs: tuple, rows: tuple) -> Iterator[tuple]:
        """Rows of the names of a shape."""
        at = self.run
        names: list = (form % tuple([self.runs[at + n] for n in runs])).split("\0")
        names.append(None)
        for row in rows:
            yield [names[n] for n in row]

    def same(self, piece: str, shape: tuple, parent: int, position: int) -> int:
        """What a statement of a known shape does; its `;` stands for it among the tokens."""
        runs, lines, calls, accesses, kind, first, last, begin, tail = shape
        scope = self.scope[-1] if self.scope else None
        if self.edges and calls[2]:
            for schema, obj, sub in self.named(*calls):
                row = (scope, schema, obj, sub)
                if obj not in BUILTINS and ("e", *row) not in self.seen:
                    self.seen.add(("e", *row))
                    self.facts.call_edges.append(row)
        if self.accesses and accesses[2]:
            for schema, table, op in self.named(*accesses):
                if ("a", scope, table, op) not in self.seen:
                    self.seen.add(("a", scope, table, op))
                    self.facts.table_accesses.append((scope, schema, table, op))
        end = self.at + len(piece)
        after = end + self.longer[self.run + runs]
        if kind and self.records:
            sub = self.sub
            seq = self.seqs.get(sub, 0)
            self.seqs[sub] = seq + 1
            self.facts.substatements.append((sub, seq, parent, position, kind, self.line + first, self.line + last, self.source[self.at + self.longer[self.run] + begin : after - tail]))
        self.at = end
        self.run += runs
        self.line += lines
        self.t.append(Token("op", ";", after - 1, self.line, ";"))
        self.x += 1
        return 1 if kind else 0


def merge_others(rows: list[tuple]) -> list[tuple]:
    """Runs of neighbouring OTHER siblings become one; positions are counted anew."""
    out: list[tuple] = []
    last: dict[tuple, int] = {}
    count: dict[tuple, int] = {}
    for r in rows:
        key = (r[0], r[2])
        p = last.get(key)
        if r[4] == "OTHER" and p is not None and out[p][4] == "OTHER":
            o = out[p]
            out[p] = (*o[:6], r[6], o[7] + "\n" + r[7])
            continue
        last[key] = len(out)
        out.append((*r[:3], count.get(key, 0), *r[4:]))
        count[key] = count.get(key, 0) + 1
    return out


def parse_unit(source: str, name: str, wanted: Collection[str] = FACTS) -> Facts:
    """Facts of one source: wrapped sources have none; the first error leaves the status `error` and no facts. Lists that are not wanted may stay empty."""
    if WRAPPED.search(source[:200]):
        return Facts("wrapped")
    try:
        p = Quick(source, name, wanted)
        p.unit()
        p.facts.substatements = merge_others(p.facts.substatements) if p.records else []
        return p.facts
    except Timeout as e:
        return Facts("error", str(e))
    except Exception:  # noqa: S110 - Parser says what is wrong, if anything is
        pass
    return parse_whole(source, name)


def parse_whole(source: str, name: str) -> Facts:
    """Facts of one source that is taken into tokens as a whole."""
    try:
        p = Parser(source, name)
        p.unit()
        p.facts.substatements = merge_others(p.facts.substatements)
        return p.facts
    except Problem as e:
        return Facts("error", str(e))
    except RecursionError:
        return Facts("error", "line 1:0 nested too deeply")
    except Exception as e:  # one source's failure is its status, never the job's
        return Facts("error", f"line 1:0 unexpected end ({type(e).__name__})")
