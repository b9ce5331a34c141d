"""Licence scans by template-markup matching.

A template is licence wording with markup: `<<opt>> ... <</opt>>` may be left out, `<<any N>>` stands for
up to N words of any kind, all else is mandatory and must stand word for word. Each template compiles
into an automaton over words: a state is a place in the wording, optional regions give jumps, replaceable
ones give loops with a counter. A text is accepted where a run of its words leads from a first state to the
end. Words that every match must have as a whole (the template's longest mandatory run) are looked up first
with a substring search, so the automaton runs only around them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import table

#: Phrase and label.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<opt>>the software<</opt>> to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
_AS_IS = "<<any 12>> is provided as is <<opt>>without warranty of any kind<</opt>>"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_2 = (
    f"{_BSD} <<opt>>1<</opt>> <<opt>>a<</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<opt>>2<</opt>> <<opt>>b<</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_GNU = "<<opt>>licensed<</opt>> <<opt>>licenced<</opt>> under <<opt>>the<</opt>> <<opt>>terms of the<</opt>> gnu general public license <<opt>>as published by the free software foundation<</opt>> <<opt>>either<</opt>>"
_GNU_NOTICE = "is free software you can redistribute it and or modify it under the terms of the gnu <<opt>>lesser<</opt>> <<opt>>affero<</opt>> general public license as published by the free software foundation <<opt>>either<</opt>> version <<any 1>> of the license"

#: Template and label. Wording of well-known public licences, whole ones first, then notices that name one.
TEMPLATES = [
    (f"{_MIT} and to permit persons to whom the software is furnished to do so subject to the following conditions <<any 40>> the software is provided as is without warranty of any kind express or implied", "mit-text"),
    (_MIT, "mit"),
    (f"{_BSD_2} <<any 60>> neither the name of <<any 20>> may be used to endorse or promote products derived from this software without specific prior written permission <<any 12>> this software {_AS_IS}", "bsd-3-text"),
    (f"{_BSD_2} <<any 12>> this software {_AS_IS}", "bsd-2-text"),
    (f"{_BSD} <<any 40>> redistributions in binary form must reproduce the above copyright notice", "bsd"),
    (f"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software {_AS_IS}", "isc-text"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    (
        "this software is provided as is without any express or implied warranty <<any 40>> permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely "
        "subject to the following restrictions <<any 8>> the origin of this software must not be misrepresented",
        "zlib-text",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use <<opt>>this file<</opt>> <<opt>>these files<</opt>> except in compliance with the license you may obtain a copy of the license at <<any 20>> "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "apache-2.0-text",
    ),
    ("licensed under the apache license version 2 0 <<opt>>the license<</opt>>", "apache-2.0"),
    (f"<<opt>>this program<</opt>> <<opt>>this library<</opt>> {_GNU_NOTICE} <<opt>>or at your option any later version<</opt>> <<any 30>> without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "gnu-text"),
    (_GNU_NOTICE, "gnu-notice"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unlicense-text"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("<<opt>>released<</opt>> <<opt>>licensed<</opt>> under the mit license", "mit"),
    (f"{_GNU} version 2", "gpl-2"),
    (f"{_GNU} version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("cc by <<opt>>nc<</opt>> <<opt>>sa<</opt>> 4 0", "cc-by-4.0"),
    ("cc by nc", "cc-by-nc"),
    ("cc by <<opt>>nc<</opt>> sa", "cc-by-sa"),
    ("cc by <<opt>>nc<</opt>> nd", "cc-by-nd"),
    ("creative commons attribution <<opt>>noncommercial<</opt>> <<opt>>sharealike<</opt>> <<opt>>noderivatives<</opt>> <<opt>>4 0<</opt>> <<opt>>international<</opt>> license", "cc-by"),
    ("copyright <<opt>>c<</opt>> <<any 12>> all rights reserved", "copyright"),
    ("<<opt>>subject to the terms of the<</opt>> mozilla public license <<opt>>version<</opt>> <<opt>>v<</opt>> 2 0", "mpl-2.0"),
    ("subject to the terms of the mozilla public license", "mpl"),
]

#: Bytes that part words: everything in ASCII but digits and letters; letters become lower-case.
_TABLE = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


class Template:
    """A word automaton. ops: (word,), ("opt", where to jump) or ("any", how many)."""

    def __init__(self, markup: str, label: str):
        self.label = label
        self.ops: list[tuple[str, bytes | int]] = []
        open_: list[int] = []
        for part in re.findall(r"<<[^>]*>>|[^\s<>]+", markup):
            if part == "<<opt>>":
                open_.append(len(self.ops))
                self.ops.append(("opt", -1))
            elif part == "<</opt>>":
                self.ops[open_.pop()] = ("opt", len(self.ops))
            elif part.startswith("<<any "):
                self.ops.append(("any", int(part[6:-2])))
            else:
                self.ops.append(("word", part.encode()))
        runs, depth_end = [[]], 0
        for at, (kind, x) in enumerate(self.ops):
            if kind == "opt":
                depth_end = max(depth_end, int(x))
            if kind == "word" and at >= depth_end:
                runs[-1].append(at)
            else:
                runs.append([])
        best = max(runs, key=lambda r: sum(len(self.ops[x][1]) for x in r))  # type: ignore[arg-type]
        if not best:
            raise ValueError(f"{label}: a template needs mandatory words")
        #: The longest mandatory run, as a byte string, and the most words that can stand before it.
        self.anchor = b" " + b" ".join(self.ops[x][1] for x in best) + b" "  # type: ignore[misc]
        #: How many words a match needs at least.
        self.needs, depth_end = 0, 0
        for at, (kind, x) in enumerate(self.ops):
            if kind == "opt":
                depth_end = max(depth_end, int(x))
            self.needs += kind == "word" and at >= depth_end
        self.before = sum(int(x) if kind == "any" else kind == "word" for kind, x in self.ops[: best[0]])
        self.after = sum(int(x) if kind == "any" else kind == "word" for kind, x in self.ops[best[0] :])

    def states(self, at: int, used: int) -> set[tuple[int, int]]:
        """All (place, words a replaceable region has taken) that need no further word."""
        found, todo = set(), [(at, used)]
        while todo:
            x = todo.pop()
            if x in found:
                continue
            found.add(x)
            if x[0] < len(self.ops):
                kind, y = self.ops[x[0]]
                if kind == "opt":
                    todo += [(int(y), 0), (x[0] + 1, 0)]
                elif kind == "any":
                    todo.append((x[0] + 1, 0))
        return found

    def ends(self, words: list[bytes], start: int) -> int | None:
        """Where the shortest match from start ends, or None. start is the first mandatory or optional word."""
        now, at = self.states(0, 0), start
        while True:
            if (len(self.ops), 0) in now:
                return at
            if at >= len(words) or not now:
                return None
            after: set[tuple[int, int]] = set()
            for place, used in now:
                if place < len(self.ops):
                    kind, x = self.ops[place]
                    if kind == "word" and words[at] == x:
                        after |= self.states(place + 1, 0)
                    elif kind == "any" and used < int(x):
                        after |= self.states(place, used + 1)
            now, at = after, at + 1

    def accepts(self, words: bytes) -> bool:
        """Whether the automaton accepts somewhere. words: ` a b c `. Around each anchor only as many words are looked at as a match can have."""
        at = words.find(self.anchor)
        while at >= 0:
            lo = at
            for _ in range(self.before):
                lo = max(words.rfind(b" ", 0, lo), 0)
            hi = at
            for _ in range(self.after):
                hi = words.find(b" ", hi + 1)
                if hi < 0:
                    hi = len(words)
                    break
            head, tail = words[lo:at].split(), words[at:hi].split()
            window = head + tail
            if any((self.ends(window, x) or 0) > len(head) for x in range(len(head) + 1)):
                return True
            at = words.find(self.anchor, at + 1)
        return False


def normal(text: str | None) -> bytes:
    """The text's words, lower-case, each with one space before it and one at the end."""
    w = (text or "").encode().translate(_TABLE).split()
    return b" " + b" ".join(w) + b" " if w else b" "


def scan(text: str | None, phrases: list[tuple[bytes, str]], templates: list[Template]) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = normal(text)
    n = words.count(b" ") - 1
    places, base = [], set()
    for phrase, label in phrases:
        at = words.find(phrase)
        while at >= 0:
            places.append(at)
            base.add(label)
            at = words.find(phrase, at + 1)
    first, last = (words.count(b" ", 0, f(places)) for f in (min, max)) if places else (None, None)
    own = [t for t in templates if t.accepts(words)]
    most = max([t.needs for t in own] + [p.count(b" ") - 1 for p, label in phrases if label in base], default=0)
    return n, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | {t.label for t in own})), most / (most + 2)


def licence_scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Each document's licence wording: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    docs: doc_id, text. A-Z become lower-case; words are runs of digits, a-z and non-ASCII. n_base counts the
    places of all phrases; first_word and last_word are the smallest and largest start (words from 0), else
    null. labels adds the templates' labels to the phrases'. score: m / (m + 2), m the most words
    that an accepted template or a phrase needs, so a whole licence is near 1 and none is 0. A null or empty text has no
    words; repeated rows stay; a null doc_id stays null; no rows: no result. The scan of a text takes time and memory in
    proportion to that text; columns other than doc_id and text are not read, whatever their names.
    """
    marks = [(f" {p} ".encode(), label) for p, label in phrases]
    compiled = [Template(*t) for t in templates]
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan(x.as_py(), marks, compiled) for x in b.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types[1:], strict=True))], names=[f.split()[0] for f in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


def _pattern(markup: str) -> str:
    """A template as a regular expression over ` a b c `, for checks by other engines."""
    out = re.sub(r"<<any (\d+)>>", lambda m: "(?: [^ ]+){0," + m[1] + "}", markup)
    parts = re.findall(r"\(\?: \[\^ \]\+\)\{0,\d+\}|<<opt>>|<</opt>>|[^\s<>]+", out)
    return "".join({"<<opt>>": "(?:", "<</opt>>": ")?"}.get(x, x if x.startswith("(?:") else f" {x}") for x in parts) + " "


def _sql() -> str:
    """The contract's columns in DuckDB: phrases by positions in the list of words, templates as regular expressions."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    at = lambda p: "list_filter(range(0, len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split())) + ")"
    hit = {n: f"regexp_matches(s, '{_pattern(m)}')" for n, (m, _) in enumerate(TEMPLATES)}
    phrase = [f"CASE WHEN len(p{n}) > 0 THEN ['{label}'] ELSE [] END" for n, (_, label) in enumerate(PHRASES)]
    own = [f"CASE WHEN t{n} THEN ['{label}'] ELSE [] END" for n, (_, label) in enumerate(TEMPLATES)]
    needs = [f"CASE WHEN len(p{n}) > 0 THEN {len(p.split())} ELSE 0 END" for n, (p, _) in enumerate(PHRASES)] + [f"CASE WHEN t{n} THEN {Template(*TEMPLATES[n]).needs} ELSE 0 END" for n in hit]
    every = "list_sort(" + "p0 || " + " || ".join(f"p{n}" for n in range(1, len(PHRASES))) + ")"
    return f"""
WITH a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s, {', '.join(f'{at(p)} AS p{n}' for n, (p, _) in enumerate(PHRASES))} FROM a),
c AS (SELECT *, {every} AS places, {', '.join(f'{h} AS t{n}' for n, h in hit.items())} FROM b),
d AS (SELECT *, greatest({', '.join(needs)}) AS m FROM c)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(places[1] AS BIGINT) AS first_word, CAST(places[-1] AS BIGINT) AS last_word,
  array_to_string(list_sort({' || '.join(phrase)}), ',') AS base_labels, array_to_string(list_sort(list_distinct({' || '.join(phrase + own)})), ',') AS labels, m / (m + 2.0) AS score FROM d
"""


OP7_SQL = _sql()
