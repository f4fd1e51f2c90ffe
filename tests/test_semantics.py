"""pandas parity of the points pinned down in SURVEY 1.1, on tiny frames."""

import math

from pyspark.sql import functions as F

from fairlane.functions import features as fx
from fairlane.operators import columns, encode, segment, windows


def test_capped_ratio_follows_pandas_clip(spark):
    df = spark.createDataFrame([(100.0, 0.0), (0.0, 0.0), (None, 5.0), (50.0, 10.0), (500.0, 10.0), (-5.0, 0.0)],
                               "a double, b double")
    got = [r[0] for r in df.select(fx.capped_ratio("a", "b", 10.0)).collect()]
    # +inf → cap, NaN / null stay missing, -inf is not clipped from above.
    assert got == [10.0, None, None, 5.0, 10.0, float("-inf")]


def test_cut_is_open_left_closed_right(spark):
    df = spark.createDataFrame([(0.0,), (50000.0,), (50000.5,), (None,), (1e9,)], "x double")
    got = [r[0] for r in df.select(fx.bin_column("x", *fx.INCOME_BRACKETS)).collect()]
    assert got == [None, "<$50K", "$50-75K", None, ">$250K"]
    low = [r[0] for r in df.select(fx.bin_column("x", *fx.INCOME_CLASSES, include_lowest=True)).collect()]
    assert low[0] == "Low"


def test_one_hot_drops_smallest_label_and_null_is_all_zero(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "k string")
    m = encode.fit_one_hot(df, ["k"])
    assert m.labels == {"k": ["a", "b", "c"]}
    rows = m.transform(df).orderBy(F.col("k").asc_nulls_first()).collect()
    assert [tuple(r) for r in rows] == [(0, 0), (0, 0), (1, 0), (0, 1)]


def test_group_by_leaves_out_null_keys_and_counts_non_null_labels(spark):
    df = spark.createDataFrame([("x", 1), ("x", None), ("x", 0), (None, 1)], "g string, target int")
    r = segment.rate_by(df, "g").collect()
    assert len(r) == 1 and r[0]["n"] == 2 and r[0]["approved"] == 1 and r[0]["rate"] == 0.5


def test_value_counts_dropna_flag(spark):
    df = spark.createDataFrame([("x",), ("x",), (None,)], "g string")
    assert segment.value_counts(df, "g").count() == 1
    keep = {r["g"]: r["count"] for r in segment.value_counts(df, "g", dropna=False).collect()}
    assert keep == {"x": 2, None: 1}


def test_fill_gaps_forward_then_backward(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, None), ("a", 4, 7.0), ("b", 1, None)],
                               "k string, o int, v double")
    got = {(r["k"], r["o"]): r["v"] for r in windows.fill_gaps(df, ["v"], "o", "k", rows_per_range=1).collect()}
    assert got == {("a", 1): 5.0, ("a", 2): 5.0, ("a", 3): 5.0, ("a", 4): 7.0, ("b", 1): None}


def test_median_is_linear_interpolation(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,)], "x double")
    m = encode.fit_median_imputer(df, ["x"])
    assert m.values["x"] == 6.0


def test_standardize_and_duplicate_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`A b` int, ` a b ` int, c int")
    out = columns.drop_duplicate_columns(columns.standardize_columns(df))
    assert out.columns == ["a_b", "c"] and out.first()["a_b"] == 1


def test_try_cast_and_finite(spark):
    df = spark.createDataFrame([("12",), ("Exempt",), ("1,200",)], "s string")
    got = [r[0] for r in columns.coerce_numeric(df, ["s"]).collect()]
    assert got == [12.0, None, None]
    got2 = [r[0] for r in columns.coerce_numeric(df, ["s"], strip_commas=True).collect()]
    assert got2 == [12.0, None, 1200.0]
    inf = spark.createDataFrame([(math.inf,), (-math.inf,), (1.5,)], "x double")
    assert [r[0] for r in inf.select(fx.finite_or_null("x")).collect()] == [None, None, 1.5]


def test_validate_records_quarantines_bad_rows(spark):
    rows = [(350000.0, 450000.0, 120000.0, 6.5, 360.0, "CA"),      # good
            (-1000.0, 450000.0, 120000.0, 6.5, 360.0, "CA"),       # amount negative
            (350000.0, 450000.0, 120000.0, 150.0, 360.0, "CA"),    # rate too high
            (350000.0, 450000.0, 120000.0, 6.5, 700.0, "CA"),      # term out of range
            (350000.0, None, 120000.0, 6.5, 360.0, "CAL")]         # missing field, bad state
    df = spark.createDataFrame(rows, "loan_amount double, property_value double, income double, "
                                     "interest_rate double, loan_term double, state_code string")
    v = [r["valid"] for r in fx.validate_records(df).collect()]
    assert v == [True, False, False, False, False]


def test_decision_wording(spark):
    df = spark.createDataFrame([(0.85,), (0.55,), (0.45,), (0.1,)], "p double")
    d = fx.decide("p")
    got = [tuple(r) for r in df.select(d["decision"], d["risk_level"], d["needs_review"]).collect()]
    assert got == [("Approved", "Low Risk", False), ("Approved", "Moderate Risk", True),
                   ("Denied", "High Risk", True), ("Denied", "High Risk", False)]


def test_template_rows_validate_and_score(spark):
    from fairlane.sources import io
    t = io.template_table(spark)
    assert t.count() == 3
    v = fx.validate_records(t.withColumn("state_code", F.lit(None).cast("string")))
    assert [r["valid"] for r in v.collect()] == [True, True, True]
    out = fx.ratio_features(t).select("loan_to_value_ratio").collect()
    assert [round(r[0], 6) for r in out] == [75.0, round(250000 / 300000 * 100, 6), 75.0]


def test_schema_diff_missing_and_extra(spark):
    from fairlane.operators import reshape
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    got = sorted(tuple(r) for r in reshape.schema_diff(spark, df, ["a", "c"]).collect())
    assert got == [("b", "extra"), ("c", "missing")]


def test_prefix_sums_by_text_and_date_with_null_groups(spark):
    from pyspark.sql import functions as F

    from fairlane.operators.prefix import ordered_prefix_sums
    rows = [(None if i % 3 == 0 else "g", f"k{i:04d}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k string, v long").withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), F.col("v").cast("int")))
    for order in ("k", "d"):
        got = {(r["g"], r["v"]): r["cum_v"] for r in ordered_prefix_sums(df, ["g"], order, ["v"], rows_per_range=40).collect()}
        want, run = {}, {}
        for g, _, v in rows:
            run[g] = run.get(g, 0) + v
            want[(g, v)] = run[g]
        assert got == want


def test_auc_of_more_rows_than_a_long_product_holds(spark):
    from pyspark.sql import functions as F

    from fairlane.operators import metrics
    big = 5_000_000_000
    counts = spark.createDataFrame([("m", 0.1, 0, big), ("m", 0.9, big, 0)], "model string, score double, pos long, neg long")
    old = metrics.score_counts
    metrics.score_counts = lambda *a: counts
    try:
        r = metrics.roc_auc(counts.select("model", "score", F.lit(1).alias("y_true"))).first()
    finally:
        metrics.score_counts = old
    assert r["auc"] == 1.0 and r["p"] == big


def test_names_that_must_not_be_model_inputs(spark):
    from fairlane.operators import columns
    names = ["income", "minority_tract_flag", "tract_minority_population_percent", "is_hispanic", "aus_result", "action_taken_name",
             "census_tract", "applicant_age", "has_coborrower", "application_type", "derived_race", "application_id", "target"]
    df = spark.createDataFrame([tuple(range(len(names)))], names)
    assert columns.select_features(df).columns == ["income", "applicant_age", "has_coborrower", "application_type"]


def test_empty_tables_and_all_null_columns(spark):
    from fairlane.operators import encode, profile, windows
    df = spark.createDataFrame([], "target int, a double")
    assert [r["null_pct"] for r in profile.null_profile(df).collect()] == [None, None]
    assert profile.completeness(df, ["a"]).first()["complete_pct"] is None
    assert profile.class_balance(df).first()["approved_pct"] is None
    zero = spark.createDataFrame([("x", 0.0)], "k string, v double")
    assert windows.share_of_total(zero, "v").first()["share"] is None
    nulls = spark.createDataFrame([(None,), (None,)], "v double")
    assert encode.fit_quantile_one_hot(nulls, "v").transform(nulls).count() == 2


def test_split_of_any_number_of_parts(spark):
    from fairlane.operators import split
    df = spark.range(40000).withColumnRenamed("id", "application_id")
    got = {r["split"]: r["share"] for r in split.split_shares(split.split(df, fractions=(0.875, 0.0625, 0.03125, 0.03125))).collect()}
    assert set(got) == {"part_1", "part_2", "part_3", "part_4"}
    assert abs(got["part_1"] - 0.875) < 0.006 and abs(got["part_4"] - 0.03125) < 0.004
