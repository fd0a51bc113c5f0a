from pyspark.sql import functions as F

from plumbline.operators.profile import candidate_keys, find_keys, profile, table_summary


def test_profile_of_every_kind(spark):
    df = spark.sql("""
        SELECT * FROM VALUES
          (1, 1.0D, 1.5D, true,  '2024-01-01', '2024-01-01 10:00', 'a', CAST(NULL AS STRING), 5BD),
          (2, 2.0D, 2.5D, false, '2024-01-02', '2024-01-02T11:00:00', 'b', NULL, 6BD),
          (3, NULL, 2.5D, NULL,  '2024-01-02', '2024-01-03 10:00:00.5', 'a', NULL, 6BD)
        AS t(k, whole, dec, flag, d, ts, txt, nothing, amt)""")
    got = {r.column_name: r for r in profile(df).collect()}
    assert {c: r.kind for c, r in got.items()} == {
        "k": "integer", "whole": "integer", "dec": "decimal", "flag": "boolean", "d": "date",
        "ts": "timestamp", "txt": "text", "nothing": "empty", "amt": "integer"}
    k, dec, txt = got["k"], got["dec"], got["txt"]
    assert (k.distinct_count, k.is_key, k.min_value, k.max_value) == (3, True, "1", "3")
    assert (dec.distinct_count, dec.is_key, dec.min_value) == (2, False, "1.5")
    assert (txt.min_value, txt.max_value, txt.example) == ("", "", "a")
    whole, nothing = got["whole"], got["nothing"]
    assert (whole.null_count, whole.null_pct, whole.distinct_count, whole.is_key) == (
        1, 33.3, 2, False)
    assert (nothing.null_pct, nothing.distinct_count, nothing.example) == (100.0, 0, "")
    assert sorted(r[0] for r in candidate_keys(profile(df)).collect()) == ["k", "ts"]
    assert find_keys(df) == ({"row_count": 3, "column_count": 9, "columns_with_nulls": 3}, ["k", "ts"])
    assert find_keys(df.limit(0)) == ({"row_count": 0, "column_count": 9, "columns_with_nulls": 0}, [])
    s = table_summary(profile(df)).first()
    assert (s.row_count, s.column_count, s.columns_with_nulls, s.candidate_keys) == (3, 9, 3, 2)


def test_empty_table_and_long_values(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert [(r.kind, r.null_pct, r.is_key) for r in profile(empty).collect()] == [
        ("empty", 0.0, False)] * 2
    long = spark.range(10).select(F.concat(F.repeat(F.lit("x"), 500),
                                           (F.col("id") % 4).cast("string")).alias("t"))
    r = profile(long).first()
    assert (r.distinct_count, len(r.example)) == (4, 60)
    assert profile(long, approximate=True).first().distinct_count == 4


def test_a_value_filling_the_column_is_pre_aggregated(spark):
    df = spark.range(0, 40000, numPartitions=4).select(F.lit(1).alias("same"), "id")
    got = {r.column_name: (r.distinct_count, r.is_key) for r in profile(df).collect()}
    assert got == {"same": (1, False), "id": (40000, True)}


def test_keys_are_exact_where_sketches_are_near(spark):
    df = spark.range(0, 20000, numPartitions=4).select(
        "id", F.when(F.col("id") == 7, 8).otherwise(F.col("id")).alias("one_repeat"), (F.col("id") % 9000).alias("half"),
        F.array("id").alias("nested"), F.when(F.col("id") != 3, F.col("id")).alias("one_null"))
    facts, keys = find_keys(df)
    assert keys == ["id", "nested"] and facts["columns_with_nulls"] == 1
