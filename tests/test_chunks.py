from plumbline.operators.chunks import chunks, tree, valid_chunks

SCHEMA = "schema_name string, object_name string, object_type string, subprogram string, seq int, parent_seq int, position int, statement_type string, source_text string, source_hash string"


def rows(spark, items):
    return spark.createDataFrame([("S", "O", "PACKAGE BODY", None, *x, f"h{x[0]}") for x in items], SCHEMA)


def test_tree(spark):
    df = rows(spark, [(0, None, 0, "BEGIN_END", "b"), (1, 0, 0, "IF", "i"), (2, 1, 0, "OTHER", "o"), (9, 77, 1, "OTHER", "lost")])
    assert {r.seq: (r.root, r.depth) for r in tree(df).collect()} == {0: (0, 0), 1: (0, 1), 2: (0, 2), 9: (9, 0)}


def test_cycles_of_parents_lose_nothing(spark):
    ring = [(0, None, 0, "IF", "r"), (1, 0, 0, "OTHER", "a"), (5, 6, 0, "OTHER", "b"), (6, 7, 1, "OTHER", "c"), (7, 5, 2, "OTHER", "d"), (4, 6, 3, "OTHER", "below"), (3, 4, 0, "OTHER", "deeper"), (2, 2, 9, "OTHER", "own parent")]
    found = {r.seq: (r.root, r.depth) for r in tree(rows(spark, ring)).collect()}
    assert found == {0: (0, 0), 1: (0, 1), 5: (5, 0), 7: (5, 1), 6: (5, 2), 4: (5, 3), 3: (5, 4), 2: (2, 0)}
    assert tree(rows(spark, ring).limit(0)).count() == 0 and sum(r.length for r in chunks(rows(spark, ring)).collect()) == sum(len(x[4]) for x in ring)


def test_chunks(spark):
    two = rows(spark, [(0, None, 0, "OTHER", "x" * 5000), (1, None, 1, "OTHER", "x" * 5000)])
    assert [r.root_seqs for r in chunks(two).orderBy("chunk_index").collect()] == [[0], [1]]
    handler = rows(spark, [(0, None, 0, "OTHER", "a"), (1, None, 1, "EXCEPTION_HANDLER", "b")])
    assert chunks(handler, 100_000).count() == 2
    whole = rows(spark, [(0, None, 0, "IF", "x" * 3000), (1, 0, 0, "OTHER", "x" * 3000)])
    assert [r.length for r in chunks(whole, 500).collect()] == [6000]


def test_first_miss_ends_validity(spark):
    made = rows(spark, [(n, None, n, "OTHER", "x" * 5000) for n in range(3)])
    made = chunks(made)
    stored = made.where("chunk_index <> 1")
    assert [r.valid for r in valid_chunks(made, stored).orderBy("chunk_index").collect()] == [True, False, False]
