"""Small fixtures against brute force; nulls, empty and repeated rows, ties, empty tables, extra columns."""

import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import class_lm, html_text, imatch, jaccard_join, licences, mixing, packing, quality, topk, url_rules
from plumbline.llm.common import remainder

TEXTS = ["a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s t", "A b c d e f g h i j k l m n o p q r s X", "", None, "one", "one", "x y " * 2000, "the quick brown fox, all rights reserved"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n, t, None if n == 3 else f"s{n % 2}", "clash") for n, t in enumerate(TEXTS)] + [(None, "null id", "s0", "clash"), (8, TEXTS[8], "s0", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_jaccard(spark, docs):
    found = jaccard_join.jaccard_components(docs, 3, 80, 100).collect()
    assert len(found) == docs.count()
    by = {r.doc_id: r.component_id for r in found}
    assert by[1] == by[2] == 0 and by[6] == 5 and by[3] == 3 and by[4] == 4 and by[None] is None
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def near_copies(seed, many, longest=120, edits=7):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 500, longest)]
    texts = []
    for k in range(many):
        w = list(base)
        for x in rng.integers(0, longest, k % edits):
            w[x] = f"z{rng.integers(0, 9999)}"
        texts.append(" ".join(w))
    return texts


def all_pairs(texts, n, num, den):
    """Each text's component by comparing all pairs of plain word tuples."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        i = len(sets[a] & sets[b])
        if i and den * i >= num * (len(sets[a]) + len(sets[b]) - i):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in range(len(texts))}


@pytest.mark.parametrize(("n", "num", "block", "leaf"), [(3, 90, 1024, 4096), (5, 80, 1024, 4096), (3, 90, 16, 32), (5, 80, 8, 24)])
def test_jaccard_matches_all_pairs(spark, monkeypatch, n, num, block, leaf):
    """Small blocks and leaves: regions are parted between far pivots, and what stays large is compared in blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "HELD", 500)
    texts = near_copies(1, 90) + near_copies(2, 60, 40, 12) + near_copies(3, 30, 8, 3) + ["", "one", "one two", "one two", "ONE two three"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, n, num, 100).collect()} == all_pairs(texts, n, num, 100)


def test_keys_meet_in_pieces_as_at_once():
    rng = np.random.default_rng(8)
    keys, nodes = rng.integers(0, 40, 600), rng.integers(0, 90, 600)
    want = {(k, v) for k, v in zip(keys.tolist(), nodes.tolist(), strict=True) if len(set(nodes[keys == k].tolist())) > 1}
    state, got = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)), set()
    for lo in range(0, 600, 70):
        k, v = np.concatenate((state[0], keys[lo : lo + 70])), np.concatenate((state[1], nodes[lo : lo + 70]))
        k, v, _, state = jaccard_join.meet(k, v, np.concatenate((state[2], np.zeros(len(k) - len(state[2]), bool))))
        got |= set(zip(k.tolist(), v.tolist(), strict=True))
    assert got == want


def test_common_and_forest():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 60, k).astype(np.uint64)) for k in rng.integers(1, 40, 50)]
    both = jaccard_join.common(sets)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i, j in itertools.combinations(range(50), 2))
    linked = np.zeros((6, 6), bool)
    linked[0, 1] = linked[1, 2] = linked[0, 2] = linked[3, 4] = linked[2, 4] = True
    assert len(jaccard_join.forest(linked, np.arange(6))) == 4 and len(jaccard_join.forest(linked, np.array([0, 0, 0, 3, 3, 5]))) == 1


def test_marks_bound_the_distance():
    rng, t = np.random.default_rng(5), jaccard_join.Threshold(80, 100)
    for size in (1, 7, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        for change in (0, 1, size // 20, size):
            b = np.unique(np.concatenate((a[change:], rng.integers(0, 1 << 62, 2 * change).astype(np.uint64))))
            if not len(b):
                continue
            x, y = jaccard_join.marks_of(a, t), jaccard_join.marks_of(b, t)
            assert jaccard_join.differing(x, y) <= len(np.setxor1d(a, b)) and (change or x == y)
            assert jaccard_join.differing(x, y, 16) <= jaccard_join.differing(x, y)
    for a in range(1, 3000, 7):  # what meets a pivot has marks that can be folded to its window's size
        bands = {b for b, _ in t.bands(a)}
        for b in range(max(1, a // 2), 2 * a, max(1, a // 50)):
            if bands & {x for x, _ in t.bands(b)}:
                assert jaccard_join.window_size(a, t) <= jaccard_join.marks_size(b, t)


def test_packing(spark, docs):
    rows = packing.pack(docs, packing.tokenizer_path()).collect()
    assert {r.doc_id for r in rows} == {*range(len(TEXTS)), None}
    for _, g in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in g:
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    assert packing.pack(docs.limit(0), packing.tokenizer_path()).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for _ in range(20):
        items = sorted(rng.integers(1, 51, 200).tolist(), reverse=True)
        bins: list[int] = []
        for s in items:
            fits = [b for b in range(len(bins)) if bins[b] >= s]
            if fits:
                bins[min(fits, key=lambda b: bins[b])] -= s
            else:
                bins.append(50 - s)
        runs = packing.plan(dict(Counter(items)), 50)
        assert sum(r[2] * r[3] for r in runs) == len(items) and 1 + max(r[4] + r[2] - 1 for r in runs) == len(bins)


def test_knapsack():
    rng = np.random.default_rng(3)
    for _ in range(30):
        items = [(int(s), int(n)) for s, n in zip(rng.choice(np.arange(1, 30), 5, False), rng.integers(1, 4, 5), strict=True)]
        budget = int(rng.integers(0, 120))
        taken = mixing.knapsack(items, budget)
        best = max(x for x in (sum(s * k for (s, _), k in zip(items, ks, strict=True)) for ks in itertools.product(*[range(n + 1) for _, n in items])) if x <= budget)
        assert sum(s * k for s, k in taken.items()) == best and all(taken.get(s, 0) <= n for s, n in items)


def test_mixing(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.times <= 3 for r in rows)
    total = sum(r["size"] for r in rows)
    assert math.isclose(sum({r.source: r.target for r in rows}.values()), total, rel_tol=1e-9)
    again = mixing.mix(docs).collect()
    assert Counter(rows) == Counter(again) and mixing.mix(docs.limit(0)).count() == 0


def test_topk(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [1.0, 2.0]), (4, None), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (6, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = topk.exact_topk(df, "vec_id", topk.quantised("embedding"), F.col("vec_id") % 20 == 0, 3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, 5 * 4096), (3, 5 * 4096), (2, 4 * 4096)]
    assert topk.exact_topk(df.limit(0), "vec_id", topk.quantised("embedding"), F.lit(True)).count() == 0


def test_url_rules(spark):
    urls = ["http://A.Net/x", "http://a.example.net/en/1", "http://example.com/de/", "https://x.org/fr/1?a", "http://net", None, "none", "http://xnet/y", "http://net/"] * 2
    df = spark.createDataFrame([(n, u, "clash") for n, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    found = {r.page_id: (r.host, r.rule, r.verdict) for r in url_rules.judge_urls(df, rules, ["page_id"]).collect()}
    want = [("a.net", "net/", "block"), ("a.example.net", "example.net/en/", "allow"), ("example.com", "example.com/de/", "block"), ("x.org", "org/fr/", "allow"), ("net", None, "allow"), ("", None, "allow"), ("", None, "allow"), ("xnet", None, "allow"), ("net", "net/", "block")]
    assert [found[n] for n in range(len(urls))] == want * 2


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><div class='ad'>buy</div><article><h1>H &amp; x</h1><p>one<b>two</b><br>three<p>four<form>f</form></article><div id='comments'>c</div><footer>f</footer>"
    df = spark.createDataFrame([(1, "http://h/1", page), (1, "http://h/1", page), (2, None, None), (3, "http://h/2", "<p>a<div>plain</div>")], "page_id long, url string, html string")
    found = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect())
    assert found == [(1, "H & x onetwo three four", 23)] * 2 + [(2, "", 0), (3, "a plain", 7)]
    same = spark.createDataFrame([(n, "http://h/", f"<div>top</div><div>own {n}</div>") for n in range(4)], "page_id long, url string, html string")
    assert sorted(r.text for r in html_text.extract(same).collect()) == [f"own {n}" for n in range(4)]


def test_licences():
    t, p = [licences.Template(*x) for x in licences.TEMPLATES], [(f" {a} ".encode(), b) for a, b in licences.PHRASES]
    assert licences.scan("x CC-BY! All rights reserved", p, t)[:6] == (6, 2, 1, 3, "cc-by,reserved", "cc-by,reserved")
    assert "mit" in licences.scan("Released under the MIT License.", p, t)[5] and licences.scan("the MIT licence", p, t)[5] == ""
    assert licences.scan(None, p, t) == (0, 0, None, None, "", "", 0.0)


def test_licence_templates_match_a_plain_search():
    """Whole templates with their optional words in and out, replaceable words up to their number and one above, and a mandatory word changed."""
    rng = np.random.default_rng(13)
    compiled = [licences.Template(*x) for x in licences.TEMPLATES]
    patterns = [re.compile(licences._pattern(m)) for m, _ in licences.TEMPLATES]
    hits = Counter()
    for markup, _ in licences.TEMPLATES:
        for trial in range(30):
            text = re.sub(r"<<opt>>(.*?)<</opt>>", lambda m: m[1] if rng.random() < 0.5 else "", markup)
            text = re.sub(r"<<any (\d+)>>", lambda m: "w " * int(rng.integers(0, int(m[1]) + (2 if trial % 3 == 0 else 1))), text)
            w = ("before it " * 3 + text + " after" * 3).split()
            if trial % 5 == 4:
                w[int(rng.integers(6, len(w) - 3))] = "other"
            words = licences.normal(" ".join(w) * (2 if trial % 7 == 6 else 1))
            got = [t.accepts(words) for t in compiled]
            assert got == [p.search(words.decode()) is not None for p in patterns]
            hits[sum(got) > 0] += 1
    assert hits[True] > 300 and hits[False] > 20
    began = time.perf_counter()
    assert not any(t.accepts(licences.normal("all rights reserved gnu general public license cc by " * 20_000)) for t in compiled if t.label not in ("copyright",))
    assert time.perf_counter() - began < 10


def test_licences_on_rows(spark):
    rows = [(1, "All rights reserved", "x"), (1, "All rights reserved", "x"), (None, None, "x"), (2, "", "x"), (3, "word " * 200_000 + "cc by", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    found = licences.licence_scan(df).collect()
    assert len(found) == 5 and Counter(r.labels for r in found) == {"reserved": 2, "": 2, "cc-by": 1} and licences.licence_scan(df.limit(0)).count() == 0
    assert {r.first_word for r in found if r.doc_id == 3} == {200_000}


def test_field_marginals_match_enumeration():
    rng = np.random.default_rng(4)
    good, pair = rng.normal(size=7), rng.normal(size=(2, 2))
    p, _ = quality.marginals(good, np.array([4, 3]), pair)
    for lo, n in ((0, 4), (4, 3)):
        w = {s: math.exp(sum(good[lo + k] * s[k] for k in range(n)) + sum(pair[s[k], s[k + 1]] for k in range(n - 1))) for s in itertools.product((0, 1), repeat=n)}
        for k in range(n):
            assert math.isclose(p[lo + k], sum(v for s, v in w.items() if s[k]) / sum(w.values()), rel_tol=1e-9)


def test_quality_held_out():
    good = [f"The words of text {k} run on, and end. So it goes on with other words." for k in range(60)]
    bad = [f"BUY!! NOW!! ${k}$$ ### ### %%% WIN!! WIN!!" for k in range(60)]
    f = quality.fit([t.encode() for t in good[:40] + bad[:40]], np.array([1] * 40 + [0] * 40))
    assert (f.scores([t.encode() for t in good[40:]]) > 0.5).all() and (f.scores([t.encode() for t in bad[40:]]) < 0.5).all()
    assert len(f.scores([b""])) == 1


def test_class_lm(spark, docs):
    found = class_lm.class_scores(docs, remainder("doc_id", 7) == 2).collect()
    assert len(found) == docs.count()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    rows = [(r.doc_id, re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().lower()) + [b"\n"]) for r in docs.collect()]
    c = Counter(w for d, t in rows if not held(d) for w in t)
    want = Counter((d, held(d), len(t), sum(w in c for w in t), round(sum(math.log10((c[w] + 1) / (sum(c.values()) + len(c) + 1)) for w in t), 6)) for d, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == want
    assert class_lm.class_scores(docs.limit(0), F.lit(False)).count() == 0


def test_imatch(spark, docs):
    rows = imatch.imatch(docs).collect()
    assert len(rows) == docs.count()
    assert rows and len({r.fingerprint for r in rows if r.doc_id in (0, 1)}) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert imatch.imatch(docs.limit(0)).count() == 0


def test_imatch_tells_edited_texts_of_all_lengths(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{x}" for x in range(6000)]
    sizes = [24] * 40 + [300] * 40 + [2500] * 40
    texts = [" ".join(rng.choice(vocabulary, s)) for s in sizes]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r for r in imatch.imatch(df).collect()}
    for size in (24, 300, 2500):
        mine = [found[n] for n, s in enumerate(sizes[:-1]) if s == size == sizes[n + 1]]
        assert sum(r.near_edited > 0 for r in mine) > 0.8 * len(mine), size
        assert sum(r.near_edited > r.near_next for r in mine) > 0.8 * len(mine), size


def test_imatch_matches_one_pass(spark, docs, monkeypatch):
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice([f"w{x}" for x in range(300)], int(s))) for s in rng.integers(0, 60, 80)]
    rows = [(None if n % 9 == 0 else n // 2, t) for n, t in enumerate(texts)] + [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(imatch, "RANGE", 2000)
    found = imatch.imatch(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    h = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = [(k, d, t) for k, d, _, t in sorted((d is not None, d or 0, h[t or ""], t or "") for d, t in rows)]
    lists = [imatch.words_of(t) for *_, t in order]
    count = Counter(w for words in lists for w in words)
    lexicon = {w for w, c in count.items() if 2 <= c <= max(2, 0.2 * len(rows))}

    def prints(words):
        out = []
        for shift, bits in ((0, 4), (4, 7), (11, 10)):
            for s in range(16):
                out.append(frozenset(w for w in words & lexicon if int(imatch.hashes([w])[0]) >> shift & (1 << bits) - 1 == s))
        return frozenset(words & lexicon) or frozenset(words), out

    def like(a, b):
        used = sum(bool(x or y) for x, y in zip(a[1], b[1], strict=True))
        return 1.0 if a == b else sum(bool(x) and x == y for x, y in zip(a[1], b[1], strict=True)) / used if used else 0.0

    want = []
    for k, (known, d, t) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        own, e, nxt = (prints(imatch.words_of(x)) for x in (t, imatch.edited(t, after), after))
        want.append((d if known else None, len(t), round(like(own, e), 9), round(like(own, nxt), 9), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()))
    assert Counter(want) == Counter((r.doc_id, r.n_chars, round(r.near_edited, 9), round(r.near_next, 9), r.edited_sha256) for r in found)
    # a word outside the lexicon makes no difference to a fingerprint
    extra = [(1000, texts[5] + " onlyhere"), (1001, texts[5])]
    both = {r.doc_id: r.fingerprint for r in imatch.imatch(spark.createDataFrame(rows + extra, "doc_id long, text string")).where("doc_id >= 1000").collect()}
    assert both[1000] == both[1001]


def test_imatch_splits_an_id_that_fills_ranges(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE", 300)
    rows = [(None if n % 3 else 7, f"text {n} " * (n % 5)) for n in range(60)] + [(7, "same")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts, _ = imatch.dealt(df)
    assert parts.where("kind = 1").groupBy("doc_id").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 2
    found = imatch.imatch(df).collect()
    h = {r.t: r.h for r in df.select(F.col("text").alias("t"), F.xxhash64("text").alias("h")).collect()}
    order = [t for *_, t in sorted((d is not None, d or 0, h[t], t) for d, t in rows)]
    want = Counter(hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][: len(t) // 2]).encode()).hexdigest() for k, t in enumerate(order))
    assert Counter(r.edited_sha256 for r in found) == want


def test_html_template_is_a_share_of_different_pages(spark):
    copy = "<html><body><div><p>The only text of a copied page.</p></div></body></html>"
    rows = [(n, f"http://a/{n}", copy) for n in range(5)]
    rows += [(10 + n, f"http://b/{n}", f"<body><div>menu of b</div><p>own words {n}</p>{'<p>quoted passage</p>' if n < 3 else ''}</body>") for n in range(40)]
    rows += [(60 + n, f"http://c/{n}", f"<html><head><title>{n}</title></head><body><div>same on all</div></body></html>") for n in range(4)]
    found = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[n] == "The only text of a copied page." for n in range(5))
    assert all(found[10 + n] == f"own words {n}" + (" quoted passage" if n < 3 else "") for n in range(40))
    assert all(found[60 + n] == "same on all" for n in range(4))


def test_html_template_inside_articles_and_class_marks(spark):
    def page(n):
        quote = "<p>A passage that a few pages quote.</p>" if n < 4 else ""
        return f"<body><article><h1>Title {n}</h1><div class='x1'><p>Written by the staff</p></div><p>Own <b>bold</b> words {n}.</p>{quote}<ul><li>yes</li><li>item {n}</li></ul></article></body>"

    wrappers = ["<div class='no-sidebar'>", "<div class='page with-header'>", "<div class='has-ads'>", "<div id='sidebar-layout'>", "<div class='wide'>"]
    rows = [(n, f"http://d/{n}", page(n)) for n in range(10)]
    rows += [(20 + n, f"http://e{n}/", f"<html class='nav'><body class='has-sidebar comments'>{w}<article class='post'><p>Kept {n}</p><div class='ad-box'>buy</div></article></div><div class='comments'><article>{'short' if n == 3 else 'a comment that is longer than the text'}</article></div></body></html>") for n, w in enumerate(wrappers)]
    rows += [(30 + n, f"http://f{n}/", f"<body class='sidebar'>{w}<p>Bare {n}</p><div class='share'>share</div></div></body>") for n, w in enumerate(wrappers)]
    found = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[n] == f"Title {n} Own bold words {n}." + (" A passage that a few pages quote." if n < 4 else "") + f" yes item {n}" for n in range(10))
    assert [found[20 + n] for n in range(5)] == [f"Kept {n}" for n in range(5)]
    assert [found[30 + n] for n in (0, 1, 2, 4)] == [f"Bare {n}" for n in (0, 1, 2, 4)] and "Bare 3" in found[33]


def test_html_is_read_in_linear_time():
    for page in ('<a ' + '"x' * 100_000, "<a '" * 50_000, '<a ">"' * 50_000, '<a "' * 50_001 + ">", "<" * 100_000, "<div>" * 20_000 + "deep", "<p>a" * 20_000):
        began = time.perf_counter()
        html_text.main_text(page, set())
        assert time.perf_counter() - began < 3, page[:20]


def test_html_attributes_and_articles():
    text = lambda page: html_text.main_text(page, set())
    assert text('<p title="a hidden gem">text</p>') == text('<p data-id="ad">text</p>') == text("<p data-class='nav menu'>text</p>") == "text"
    assert text("<p hidden>gone</p><p>text</p>") == text('<div class="ad">gone</div><p>text</p>') == "text"
    assert text('<body class="right-sidebar"><p>real text</p></body>') == "real text"
    assert text('<article class="post has-sidebar">real</article><p>other</p>') == text('<article class="sidebar">real</article><p>other</p>') == "real"
    assert text("<article><p>one</p></article><p>x</p><article><p>two</p></article><div class='comments'><article>no</article></div>") == "one two"
    assert text("<article><header><h1>Head</h1><p>by line</p></header><p>body <math><mi>x</mi></math></p><footer>f</footer></article>") == "Head body x"
    assert text("<main><article>in</article> out</main>") == "in" and text("<main>all</main><p>x</p>") == "all"
    assert text('<p>a<br/>b<img src="x>y"/>c &amp;lt; &eacute;</p>') == "a bc &lt; é"


def test_html_template_against_a_plain_count(spark):
    """Subtrees that only recurrence can tell, at several shares of a host's pages, with equal pages and clashing columns."""
    rng = np.random.default_rng(11)
    shares = {f"block {k}": k / 10 for k in range(11)}
    rows = []
    for n in range(60):
        blocks = [b for b, p in shares.items() if rng.random() < p]
        rows.append((n, f"http://{'ab'[n % 2]}.net/{n}", "<article>" + "".join(f"<div><span>{b}</span></div>" for b in blocks) + f"<p>own {n}</p></article>", "x", "y"))
    rows += [(100 + n, "http://a.net/again", rows[0][2], "x", "y") for n in range(30)]
    found = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string, template string")).collect()}
    for host in "ab":
        mine = {r[2] for r in rows if r[1].startswith(f"http://{host}.")}
        gone = {b for b in shares if sum(f"<span>{b}</span>" in h for h in mine) >= max(html_text.INSIDE_RECURS, html_text.INSIDE_SHARE * len(mine))}
        assert gone and len(gone) < 11
        for n, url, page, *_ in rows:
            if url.startswith(f"http://{host}."):
                want = [x for x in re.findall(r"block \d+|own \d+", page) if x not in gone]
                assert found[n] == " ".join(want)
    assert html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string, template string").limit(0)).count() == 0


def test_quality_on_rows(spark):
    """Held-out accuracy, lines of any length, nulls, empty and very long texts, repeated rows, clashing columns, empty tables."""
    rng = np.random.default_rng(12)
    good = lambda: "\n".join(" ".join(rng.choice(["the", "river", "runs", "under", "old", "stones", "and", "we", "walk"], 12)).capitalize() + "." for _ in range(int(rng.integers(1, 6))))
    bad = lambda: "\n".join(" ".join(rng.choice(["BUY!!", "$$$", "###", "WIN", "!!!", "www", "%%%", "CLICK"], 8)) for _ in range(int(rng.integers(1, 6))))
    rows = [(n, good() if n % 2 else bad(), n % 2) for n in range(240)]
    docs = spark.createDataFrame([(n, t, "clash") for n, t, _ in rows] + [(300, None, ""), (301, "", ""), (302, "one line " * 5000, ""), (1, rows[1][1], ""), (None, "no id", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(n, y) for n, _, y in rows] + [(300, None), (301, 7)], "doc_id long, quality int")
    field = quality.train(docs, labels.where(~quality.held_out()))
    found = quality.score(docs, field, ["doc_id", "text", "score"], "found").collect()
    assert len(found) == docs.count() and all(0 <= r.found <= 1 for r in found)
    held = [(r.found >= 0.5, r.doc_id % 2 == 1) for r in found if r.doc_id is not None and r.doc_id < 240 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 60 and sum(a == b for a, b in held) > 0.97 * len(held)
    assert len({r.found for r in found if r.doc_id == 1}) == 1 and len({r.found for r in found if r.doc_id in (300, 301)}) == 1
    assert len(quality.line_features(b"word " * 3000 + b"\nnext")[1]) == 2 and quality.score(docs.limit(0), field, ["doc_id"]).count() == 0
    assert quality.train(docs.limit(0), labels).scores([b"x"]).shape == (1,)
    # each line's features stand beside those of its neighbours
    x, size = quality.line_features(b"aa bb\nC! 7\n")
    own = quality.OWN
    assert (x[1, own : 2 * own] == x[0, :own]).all() and (x[0, 2 * own : 3 * own] == x[1, :own]).all() and size.tolist() == [6, 5, 1]


def test_exchange_takes_the_best_class():
    rng = np.random.default_rng(14)
    k = class_lm.CLASSES
    pairs = rng.integers(0, 50, (k, k)).astype(float)
    left, right, now = rng.integers(0, 4, (20, k)).astype(float), rng.integers(0, 4, (20, k)).astype(float), rng.integers(2, k, 20)
    got = class_lm.exchange(left, right, pairs, now)
    p = pairs + class_lm.PRIOR * np.outer(pairs.sum(1) + 1, pairs.sum(0) + 1) / (pairs.sum() + k) / k
    for w in range(20):
        gain = {c: sum(left[w, a] * math.log(p[a, c] * p.sum() / p[a].sum() / p[:, c].sum()) for a in range(k)) + sum(right[w, b] * math.log(p[c, b] * p.sum() / p[c].sum() / p[:, b].sum()) for b in range(k)) for c in range(class_lm.REST, k)}
        assert math.isclose(gain[int(got[w])], max(gain.values()), rel_tol=1e-9)


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(15)
    k = class_lm.CLASSES
    pairs, share = rng.integers(0, 9, (k, k)).astype(float), rng.random(k) / 2
    pairs[:, class_lm.UNKNOWN] = pairs[class_lm.UNKNOWN] = 0
    p = 10.0 ** class_lm.transitions(pairs, share)
    known = [c for c in range(k) if c != class_lm.UNKNOWN]
    for a in range(k):  # all known words of a class have 1 - share of it together
        assert math.isclose(sum(p[a, c] * (1 - share[c]) for c in known) + p[a, class_lm.UNKNOWN], 1, rel_tol=1e-6)


@pytest.mark.parametrize(("rounds", "frequent"), [(1, 1000), (2, 70), (5, 1000)])
def test_class_scores_by_one_pass(spark, monkeypatch, rounds, frequent):
    """Scores of a small corpus, over many blocks, against a model that is counted word by word."""
    monkeypatch.setattr(class_lm, "BLOCK", 4000)
    monkeypatch.setattr(class_lm, "ROUNDS", rounds)
    monkeypatch.setattr(class_lm, "FREQUENT", frequent)
    monkeypatch.setattr(class_lm, "UNFOLDED", 7)
    rng = np.random.default_rng(16)
    weights = 1 / np.arange(1, 151)
    texts = [" ".join(rng.choice([f"w{x}" for x in range(150)], int(n), p=weights / weights.sum())) for n in rng.integers(0, 40, 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in class_lm.class_scores(df, F.col("doc_id") % 5 == 2).collect()}
    code = lambda w: class_lm._END if w == "\n" else int(np.array([xxhash.xxh64_intdigest(w)], np.uint64).view(np.int64)[0])
    train = [[*t.split(), "\n"] for n, t in enumerate(texts) if n % 5 != 2]
    count = Counter(w for t in train for w in t)
    k, rest = class_lm.CLASSES, class_lm.REST
    top = sorted((w for w in count if w != "\n"), key=lambda w: (-count[w], code(w)))[: k - rest - 1]
    first = {"\n": 0} | {w: rest + 1 + n for n, w in enumerate(top)}
    line = ["\n"] + [w for t in train for w in t]
    best = {w: first.get(w, rest) for w in count}
    told = []
    for _ in range(rounds):
        pairs, left, right = np.zeros((k, k)), {w: np.zeros(k) for w in count}, {w: np.zeros(k) for w in count}
        for a, b in itertools.pairwise(line):
            pairs[best[a], best[b]] += 1
            left[b][best[a]] += 1
            right[a][best[b]] += 1
        told.append(class_lm.information(pairs))
        if len(told) > 2 and told[-1] < told[-2] * (1 + class_lm.SETTLED):
            break
        best = {w: int(class_lm.exchange(left[w][None], right[w][None], pairs, np.array([best[w]]))[0]) for w in count if w != "\n"} | {"\n": 0}
    n, once = np.zeros(k), np.zeros(k)
    for w, c in best.items():
        n[c] += count[w]
        once[c] += count[w] == 1
    share = np.clip(once / np.maximum(n, 1), 1e-6, 0.5)
    share[0] = 0
    final = np.zeros((k, k))
    for a, b in itertools.pairwise(line):
        final[best[a], best[b]] += 1
    log = class_lm.transitions(final, share)
    agree = 0
    for d, t in enumerate(texts):
        before, score = 0, 0.0
        for w in [*t.split(), "\n"]:
            c = best.get(w, class_lm.UNKNOWN)
            score += log[before, c] + (math.log10(count[w] / n[c] * (1 - share[c])) if w in count else 0)
            before = c
        agree += math.isclose(found[d].score, score, rel_tol=1e-6)
        assert math.isclose(found[d].perplexity, 10 ** (-found[d].score / found[d].n_tokens), rel_tol=1e-9)
    assert agree == len(texts)


def test_pieces_hold_the_tokenizers_ids(spark):
    """Every id of every text, in order, against the tokenizer itself, in windows of 16."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(17)
    odd = ["It's 2024: don't <|endoftext|> stop!", "Straße ÄÖÜ naïve — “quotes” \u00a0x", "日本語 テキスト 🎉🎉", "\x00\x1f tab\tnew\nline", "aaaa" * 500, "x" * 70 + " " + "y1" * 60, None, "", "   ", "ǅ İ ﬁ"]
    texts = odd + [" ".join(rng.choice(["The", "quick", "brown's", "fox,", "1999", "jumps!", "über", "C++", "(ok)"], int(n))) for n in rng.integers(0, 60, 20)]
    path = packing.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(spark.createDataFrame([(n, t, "clash") for n, t in enumerate(texts)], "doc_id long, text string, offset string"), path, 16).collect()
    by = {n: sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == n) for n in range(len(texts))}
    for n, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END]
        assert by[n] == [(at, len(ids[at : at + 16]), zlib.crc32(np.array(ids[at : at + 16], "<u4").tobytes()), len(ids)) for at in range(0, len(ids), 16)], t


def test_targets_are_those_of_sharing_again_and_again(spark):
    rng = np.random.default_rng(18)
    for _ in range(4):
        many = int(rng.integers(1, 12))
        sizes = {f"s{x:02d}" if x else None: int(v) for x, v in enumerate(rng.choice([0, 1, 10, 1000, 100_000], many))}
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
        total, target, free = sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
        while free:
            left = total - sum(target[s] for s in sizes if s not in free)
            share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            over = {s for s in free if share[s] > mixing.MOST * sizes[s]}
            target |= {s: float(mixing.MOST * sizes[s]) for s in over} if over else share
            free = free - over if over else set()
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert all(math.isclose(got[s], target[s], rel_tol=1e-9, abs_tol=1e-9) for s in sizes), (sizes, got, target)


def test_url_rules_against_a_plain_loop(spark):
    """Random nested rules and urls: the rule of most characters that fits wins, then the smaller text."""
    rng = np.random.default_rng(19)
    hosts, paths = ["net", "a.net", "b.a.net", "org", "x.org", "neta.net", "a\x01net", "x\x02.net"], ["/", "/en/", "/en/a", "/en/a/b", "/e", ""]
    pairs = sorted({(str(rng.choice(hosts[:5])), str(rng.choice(paths))) for _ in range(14)})
    rules = [(h, p, str(rng.choice(["block", "allow"]))) for h, p in pairs]
    urls = [f"http://{'w.' if rng.random() < 0.3 else ''}{rng.choice(hosts)}{rng.choice([*paths, '/en/a/b/c', '/q', '/en'])}" for _ in range(300)]
    found = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"), ["page_id"]).collect()}
    for n, u in enumerate(urls):
        host, slash, path = u[7:].partition("/")
        fits = [(-len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and (slash + path).startswith(p)]
        assert found[n] == (min(fits)[1:] if fits else (None, "allow")), (u, rules)
