from pyspark.sql import functions as F

import plumbline.operators.screen as screen
from plumbline.operators.reconcile import reconcile
from plumbline.operators.screen import reconcile_screened


def outcome(check):
    return (tuple(check.metrics.first()),
            sorted(tuple(map(str, r)) for r in check.failures.collect()))


def wide(spark, n=2000):
    return spark.range(0, n, numPartitions=4).select(
        F.when(F.col("id") != 5, F.col("id")).alias("K"), F.lit("k").alias("K2"),
        *[(F.col("id") % (i + 3)).alias(f"N{i}") for i in range(4)],
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("t"), "id")).alias("T"),
        F.when(F.col("id") % 2 == 1, F.concat(F.lit("t"), "id")).alias("U"),
        F.array("id").alias("A"))


def faulty(df):
    k = F.col("K")
    changed = df.withColumns({
        "N1": F.when(k == 11, -1).otherwise(F.col("N1")),
        "T": F.when(k == 20, F.col("U")).otherwise(F.col("T")),
        "U": F.when(k == 20, F.col("T")).otherwise(F.col("U")),   # a NULL changes places
    }).filter(k.isNull() | (k != 13))
    again = df.filter(k == 17)
    hot = df.filter(k == 30).withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(500))))
    hot = hot.drop("_n")
    return changed.unionByName(again).unionByName(hot).unionByName(
        df.filter(k == 19).withColumn("K", F.lit(99999).cast("bigint")))


def test_same_result_as_the_full_comparison(spark):
    src = wide(spark)
    tgt = faulty(src)
    plain = outcome(reconcile(src, tgt, ["K", "K2"]))
    assert outcome(reconcile_screened(src, tgt, ["K", "K2"])) == plain
    assert plain[0][0] == "FAIL" and len(plain[1]) == 7
    assert outcome(reconcile_screened(tgt, src, ["k", "k2"], ["N1", "T"])) == outcome(
        reconcile(tgt, src, ["k", "k2"], ["N1", "T"]))


def test_without_a_broadcast_and_without_differences(spark, monkeypatch):
    src = wide(spark)
    tgt = faulty(src)
    monkeypatch.setattr(screen, "BROADCAST_BYTES", -1)
    assert outcome(reconcile_screened(src, tgt, ["K"])) == outcome(reconcile(src, tgt, ["K"]))
    same = reconcile_screened(src, src, ["K"])
    assert tuple(same.metrics.first())[:5] == ("PASS", 2000, 2000, 2000, 0)
    assert same.failures.isEmpty()
    empty = reconcile_screened(src.limit(0), src.limit(0), ["K"])
    assert tuple(empty.metrics.first())[:5] == ("PASS", 0, 0, 0, 0)


def test_tolerance_and_mixed_types_keep_their_meaning(spark):
    src = spark.range(100).select("id", (F.col("id") * 1.0).alias("v"))
    near = src.withColumn("v", F.col("v") + F.when(F.col("id") == 3, 0.005).otherwise(0.0))
    assert reconcile_screened(src, near, ["id"], tolerance=0.01).metrics.first().status == "PASS"
    assert reconcile_screened(src, near, ["id"]).metrics.first().failed_record_count == 1
    text = src.withColumn("v", F.col("v").cast("string"))
    assert reconcile_screened(src, text, ["id"]).metrics.first().status == "PASS"


def test_text_and_typed_columns_agree_by_their_digests(spark):
    src = spark.range(200).selectExpr(
        "id", "cast(id AS decimal(12,2)) AS amount", "date_add(date'2024-01-01', cast(id AS int)) AS day", "id % 2 = 0 AS flag",
        "cast(id AS float) / 8 AS ratio")
    text = src.selectExpr(
        "cast(id AS string) AS id", "if(id = 7, '7.50', cast(id AS string)) AS amount", "cast(day AS string) AS day", "flag",
        "cast(ratio AS double) AS ratio")
    seen = screen._suspects(screen.Sides.of(src, text, ["id"]))[1]
    assert (seen["agreed"], seen["single"], seen["repeated"]) == (199, 1, 0)
    assert outcome(reconcile_screened(src, text, ["id"])) == outcome(reconcile(src, text, ["id"]))


def test_kinds_that_never_match_do_not_agree(spark):
    src = spark.sql("SELECT 1 AS id, true AS a, date'2024-10-31' AS b, CAST(NULL AS boolean) AS c")
    tgt = spark.sql("SELECT 1 AS id, 'True' AS a, timestamp_ntz'2024-10-31 00:00:00' AS b, CAST(NULL AS string) AS c")
    seen = screen._suspects(screen.Sides.of(src, tgt, ["id"]))[1]
    assert seen["agreed"] == 0
    assert screen._suspects(screen.Sides.of(src, tgt, ["id"], ["c"]))[1]["agreed"] == 1


def test_only_hashing_where_no_key_repeats(spark):
    src = spark.range(1000).selectExpr("id", "concat('t', id) AS t", "id * 2 AS n")
    tgt = src.withColumn("t", F.when(F.col("id") == 3, "x").otherwise(F.col("t"))).filter("id <> 5")
    check = reconcile_screened(src, tgt, ["id"])
    for frame in (check.metrics, check.failures, screen.digests(screen.Sides.of(src, tgt, ["id"]))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and ("HashAggregate" in plan or "HashJoin" in plan)
    assert outcome(check) == outcome(reconcile(src, tgt, ["id"]))


def test_a_hot_key_is_counted_by_its_digests(spark):
    src = spark.range(3000).selectExpr("if(id % 3 = 0, NULL, id) AS id", "concat('v', id) AS v")
    tgt = src.filter("id IS NULL OR id <> 10")
    assert outcome(reconcile_screened(src, tgt, ["id"])) == outcome(reconcile(src, tgt, ["id"]))
    mostly = src.withColumn("v", F.lit("other"))
    assert outcome(reconcile_screened(src, mostly, ["id"])) == outcome(reconcile(src, mostly, ["id"]))
