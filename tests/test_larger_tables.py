"""Queries on what larger tables hold: other plans, wider values."""

import __spark_entry__


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_join_anti_sends_no_list_to_all_tasks(spark, tmp_path):
    table(spark, tmp_path, "orders", [(1,), (2,), (None,)], "o_orderkey long")
    table(spark, tmp_path, "lineitem", [(1,), (None,)], "l_orderkey long")
    found = __spark_entry__.queries()["join_anti"](spark, str(tmp_path))
    assert [r[0] for r in found.collect()] == [2]  # a null is not known to be missing
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = __spark_entry__.queries()["join_anti"](spark, str(tmp_path))
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_join_anti_of_nothing(spark, tmp_path):
    table(spark, tmp_path, "orders", [(1,), (None,)], "o_orderkey long")
    table(spark, tmp_path, "lineitem", [(None,)], "l_orderkey long")
    assert {r[0] for r in __spark_entry__.queries()["join_anti"](spark, str(tmp_path)).collect()} == {1, None}


def test_format_models_of_long_documents(spark, tmp_path):
    table(spark, tmp_path, "documents", [(1, 122_698), (2, 400), (3, 8_080_000)], "doc_id long, n_chars long")
    found = {r["doc_id"]: (r["text"], r["signed"], str(r["back"])) for r in __spark_entry__.queries()["format_models"](spark, str(tmp_path)).collect()}
    assert found == {1: ("   152,372.50", "152372.5+", "152372.50"), 2: ("      -500.00", "500.0-", "-500.00"), 3: ("10,099,000.00", "10099000.0+", "10099000.00")}
