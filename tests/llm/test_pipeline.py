"""The pipeline's stages on rows that ids do not tell apart, nulls, empty texts, clashing columns and empty tables."""

from collections import Counter

import corpus_pipeline
import pytest

text = lambda s: " ".join(f"{s}{x}" for x in range(60))
CLASHING = ["score", "size", "pick", "salt", "none", "src", "nth", "_doc", "_key", "_nth", "_0", "_1", "_text", "_score", "times", "bucket", "region", "node", "n"]
SF = "/root/testdata/sf0.001"


def test_one_row_of_each_group_stays(spark):
    near = lambda s: text(s) + " more"
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, near("c")), (None, text("c")), (5, text("d")), (5, text("e")), (7, near("d")), (8, text("f")), (9, near("f")), (9, text("g")), (9, text("g"))]
    rows += [(10, near("b")), (11, ""), (11, None), (None, " \n"), (None, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r.doc_id, r.text) for r in corpus_pipeline.deduplicate(spark, docs, "").collect())
    c = [k for k in found if k[0] is None and (k[1] or "").startswith("c0")]
    assert len(c) == 1 and found.pop(c[0]) == 1
    assert found == Counter([(None, text("a")), (10, near("b")), (5, text("d")), (5, text("e")), (8, text("f")), (9, text("g")), (11, ""), (11, None), (None, " \n"), (None, " \n")])
    assert corpus_pipeline.deduplicate(spark, docs.limit(0), "").count() == 0


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n if n % 5 else None, text(f"t{n}") if n % 7 else ("" if n % 2 else None), None if n == 4 else f"s{n % 3}", "en", 1) for n in range(30)] + [(3, text("t3"), "s0", "en", 1)] * 3
    rows.append((31, "word " * 30_000, "s1", None, None))
    names = ["doc_id", "text", "source", "lang", "n_chars"]
    return spark.createDataFrame([(*r, *("x" * len(CLASHING))) for r in rows], f"doc_id long, text string, source string, lang string, n_chars long, {', '.join(f'{c} string' for c in CLASHING)}").select(*names, *CLASHING)


@pytest.mark.parametrize("stage", range(3))
def test_stages_keep_columns_and_take_any_rows(spark, docs, stage):
    run = corpus_pipeline.STAGES[stage][1]
    found = run(spark, docs, SF)
    assert found.columns == docs.columns
    rows = Counter((r.doc_id, r.text, r.source) for r in found.collect())
    given = Counter((r.doc_id, r.text, r.source) for r in docs.collect())
    assert set(rows) <= set(given) and rows
    if stage == 1:  # only the repeated rows and none of the different texts go
        assert set(rows) == set(given) and all(n == 1 for r, n in rows.items() if r[1])
    if stage == 2:
        from plumbline.llm import mixing

        times = Counter()
        for r in mixing.mix(docs).join(docs.select("doc_id", "source").distinct().limit(0), ["doc_id", "source"], "left_anti").collect():
            times[(r.doc_id, r.source, r["size"])] += r.times
        assert Counter({(d, s, len((t or "").split())): sum(n for (d2, t2, s2), n in rows.items() if (d2, s2, len((t2 or "").split())) == (d, s, len((t or "").split()))) for d, t, s in rows}) == +times
    assert run(spark, docs.limit(0), SF).count() == 0


def test_packing_stage(spark, docs):
    found = corpus_pipeline.pack(spark, docs, SF).collect()
    assert sum(r.start == 0 for r in found) == docs.count() and corpus_pipeline.pack(spark, docs.limit(0), SF).count() == 0
