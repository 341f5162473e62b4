"""Samples of history, and reasons, without the rows' way through a sort or a second look at the texts."""

from pyspark.sql import functions as F

from paralex.operators import replay, validate


def test_a_sample_is_the_start_of_the_seeded_order_and_moves_no_row(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 500 > 0, F.col("id")).alias("k"), F.lit("text").alias("x")).repartition(3)
    order = [r["k"] for r in rows.orderBy(replay.chance(7, F.col("k")), "k").collect()]
    for count in (0, 1, 6, 7, 1500, 2999, 3000):
        got = replay.sample(rows, count, 7, "k")
        assert sorted(r["k"] or -1 for r in got.collect()) == sorted(k or -1 for k in order[:count])
    assert "rangepartitioning" not in replay.sample(rows, 1500, 7, "k")._jdf.queryExecution().executedPlan().toString().lower()
    assert replay.sample(rows, 4000, 7, "k").count() == 4000


def test_new_rows_are_told_once(spark, tmp_path):
    """What a mixture returns reads the new rows from where they were written, not from the join that found them."""
    rows = spark.createDataFrame([(k, f"s{k}", f"t{k}", "d") for k in range(30)], "ord long, source string, target string, domain string")
    new = replay.new_rows(rows.where("ord % 3 = 0"), rows.where("ord % 3 <> 0")).select(rows.columns)
    out = replay.mixture(new, rows.where("ord % 3 <> 0"), "balanced", 7, "ord")[0]
    assert out.count() == 20 and "leftanti" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_own_reasons_are_found_once(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "a", "c"), (3, "", "b"), (4, "x " * 600, "y"), (5, "a", "b")], "ord long, source string, target string")
    out = validate.validate(rows, validate.Rules())
    assert {r["ord"]: ",".join(r["reasons"]) for r in out.collect()} == {1: "", 2: "source_duplicate,conflicting_translation", 3: "empty,missing_value", 4: "length,length_ratio", 5: "duplicate_pair,source_duplicate,target_duplicate"}
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
