import pytest
from pyspark.sql import functions as F

from plumbline.operators.reconcile import match_row_counts, reconcile


def found(check):
    return sorted(
        (f.failure_type, f.business_key, f.column_name, f.expected_value, f.actual_value)
        for f in check.failures.collect()
    )


def counts(check):
    m = check.metrics.first()
    return (m.status, m.source_row_count, m.target_row_count, m.matched_record_count,
            m.failed_record_count)


@pytest.fixture
def pair(spark):
    ddl = "ID string, AMT int, KIND string"
    src = spark.createDataFrame([("P1", 100, "Auto"), ("P2", 200, "Home"), ("P3", 300, "Life")],
                                ddl)
    tgt = spark.createDataFrame([("P1", 100, "Auto"), ("P2", 999, "Home"), ("P4", 400, "Health")],
                                ddl)
    return src, tgt


def test_every_defect_class(pair):
    check = reconcile(*pair, ["id"])
    assert found(check) == [
        ("EXTRA_IN_TARGET", "P4", "ID", "<NOT IN SOURCE>", "record present in target"),
        ("MISSING_IN_TARGET", "P3", "ID", "record present in target", "<NOT FOUND>"),
        ("VALUE_MISMATCH", "P2", "AMT", "200", "999"),
    ]
    assert counts(check) == ("FAIL", 3, 3, 1, 3)
    assert check.compared_columns == ("AMT", "KIND")


def test_swapping_sides_swaps_missing_and_extra(pair):
    src, tgt = pair
    kinds = sorted(f[0] for f in found(reconcile(tgt, src, ["ID"])))
    assert kinds == ["EXTRA_IN_TARGET", "MISSING_IN_TARGET", "VALUE_MISMATCH"]
    assert counts(reconcile(src, src, ["ID"])) == ("PASS", 3, 3, 3, 0)
    assert found(reconcile(src, src, ["ID"])) == []


def test_partitioning_does_not_change_the_result(pair):
    src, tgt = pair
    assert found(reconcile(src.repartition(3), tgt.repartition(2), ["ID"])) == found(
        reconcile(src.coalesce(1), tgt.coalesce(1), ["ID"]))


def test_composite_duplicate_and_null_keys(spark):
    ddl = "A string, B int, V int"
    src = spark.createDataFrame([("x", 1, 5), ("y", 2, 6), ("y", 2, 7), (None, 3, 1)], ddl)
    tgt = spark.createDataFrame([("x", 1, 9), ("y", 2, 6), (None, 3, 1)], ddl)
    check = reconcile(src, tgt, ["A", "B"])
    assert found(check) == [
        ("DUPLICATE_KEY", "y | 2", "A,B", "1 row", "2 rows"),
        ("VALUE_MISMATCH", "x | 1", "V", "5", "9"),
    ]
    assert counts(check) == ("FAIL", 4, 3, 2, 2)   # the repeated key's smallest row matches


def test_composite_parts_do_not_run_together(spark):
    ddl = "A string, B string"
    src = spark.createDataFrame([("x | y", "z")], ddl)
    tgt = spark.createDataFrame([("x", "y | z")], ddl)
    assert {f[0] for f in found(reconcile(src, tgt, ["A", "B"]))} == {
        "MISSING_IN_TARGET", "EXTRA_IN_TARGET"}


def test_keys_of_different_types_match_by_their_text(spark):
    src = spark.createDataFrame([("1", 1), ("1.0", 2), (" 3", 3)], "K string, V int")
    tgt = spark.createDataFrame([(1.0, 1), (3.0, 3)], "K double, V int")
    assert [(f[0], f[1]) for f in found(reconcile(src, tgt, ["K"]))] == [
        ("EXTRA_IN_TARGET", "3"), ("MISSING_IN_TARGET", " 3"), ("MISSING_IN_TARGET", "1.0")]


def test_column_choice_and_errors(pair, spark):
    src, tgt = pair
    assert counts(reconcile(src, tgt, ["ID"], ["kind"]))[4] == 2
    with pytest.raises(ValueError, match="target has no KEY"):
        reconcile(src.withColumnRenamed("ID", "KEY"), tgt, ["KEY"])
    with pytest.raises(ValueError, match="source has no NOPE, target has no NOPE"):
        reconcile(src, tgt, ["ID"], ["NOPE"])
    assert counts(reconcile(src.select("ID"), tgt.select("ID"), ["ID"])) == ("FAIL", 3, 3, 2, 2)


def test_nested_values_compare_as_json(spark):
    src = spark.createDataFrame([(1, ["a", "b"])], "K int, V array<string>")
    same = spark.createDataFrame([(1, '["a","b"]')], "K int, V string")
    assert counts(reconcile(src, same, ["K"]))[0] == "PASS"


def test_a_hot_key_is_collapsed_before_the_shuffle(spark):
    rows = spark.range(0, 30000, numPartitions=4).select(
        F.when(F.col("id") < 20000, 7).otherwise(F.col("id")).alias("K"),
        F.col("id").alias("V"))
    check = reconcile(rows, rows.filter("V != 25000"), ["K"])
    assert found(check) == [
        ("DUPLICATE_KEY", "7", "K", "1 row", "20000 rows"),
        ("DUPLICATE_KEY", "7", "K", "1 row", "20000 rows"),
        ("MISSING_IN_TARGET", "25000", "K", "record present in target", "<NOT FOUND>"),
    ]
    plan = check.frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_min" in plan


def test_all_failures_are_kept_and_the_sample_is_capped(spark):
    src = spark.range(3000).select("id", F.lit(1).alias("v"))
    check = reconcile(src, src.withColumn("v", F.lit(2)), ["id"])
    m = check.metrics.first()
    assert (m.failed_record_count, m.truncated) == (3000, True)
    assert check.failures.count() == 3000 and check.sample().count() == 1000


@pytest.mark.parametrize("a,b,tolerance,expected", [
    ([(5,)], [(5,)], 0, ("PASS", 5, 5, 5, 0)),
    ([(5,)], [(7,)], 0, ("FAIL", 5, 7, 0, 1)),
    ([(5,)], [(7,)], 2, ("PASS", 5, 7, 5, 0)),
    ([("x",)], [(1,)], 0, ("PASS", 1, 1, 1, 0)),       # not a number: one row
    ([("12",)], [(12,)], 0, ("PASS", 12, 12, 12, 0)),
    ([(5,), (6,)], [(2,)], 0, ("PASS", 2, 2, 2, 0)),   # rows are counted
    ([], [(0,)], 0, ("PASS", 0, 0, 0, 0)),
    ([(None,)], [(1,)], 0, ("PASS", 1, 1, 1, 0)),
])
def test_row_counts(spark, a, b, tolerance, expected):
    def frame(rows):
        text = any(isinstance(r[0], str) for r in rows)
        return spark.createDataFrame(rows, "n string" if text else "n int")

    check = match_row_counts(frame(a), frame(b), tolerance)
    assert counts(check) == expected
    assert check.failures.count() == expected[4]


def test_a_side_laid_out_by_key_is_not_shuffled_again(spark):
    left = spark.range(100).selectExpr("id", "id AS v").repartition(3)
    keys = spark.range(120).repartition(3).hint("merge")
    held = spark.range(1, 150).selectExpr("id", "id % 99 AS v").repartition(3).join(keys, "id", "left_semi")
    check = reconcile(left, held, ["id"], laid_out=True)
    assert counts(check) == ("FAIL", 100, 119, 98, 1 + 1 + 20)
    plan = check.frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("Union")]
