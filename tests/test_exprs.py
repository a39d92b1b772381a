"""Cell-by-cell behaviour of the cleaning and feature expressions."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from cohortkit.functions import exprs as X
from cohortkit.health_survey import AGE_CUTS, AGE_LABELS, BMI_CUTS, BMI_LABELS

NAN = float("nan")

def apply(spark, expr, values, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_nan_becomes_null(spark):
    assert apply(spark, lambda x: X.nan_to_null(x), [1.0, NAN, None]) == [1.0, None, None]


def test_null_codes(spark):
    got = apply(spark, lambda x: X.null_codes(x, (77, 99)), [7.0, 77.0, 99.0, 9.0, None])
    assert got == [7.0, None, None, 9.0, None]


def test_flat_codes_erase_valid_values(spark):
    got = apply(spark, lambda x: X.null_codes(x, (7, 9, 77, 99, 777, 999)), [6.0, 7.0, 9.0, 10.0])
    assert got == [6.0, None, None, 10.0]


def test_bmi_rescale_and_guard(spark):
    got = apply(spark, lambda x: X.rescaled(x, 10, 80, 100.0), [999.0, 1000.0, 8000.0, 8001.0, None])
    assert got == [None, 10.0, 80.0, None, None]


def test_range_guard_ends(spark):
    assert apply(spark, lambda x: X.rescaled(x, 1, 24), [0.0, 1.0, 24.0, 25.0]) == [None, 1.0, 24.0, None]
    days = apply(spark, lambda x: X.rescaled(x, 0, 30), [0.0, 7.0, 30.0, 31.0, -1.0])
    assert days == [0.0, 7.0, 30.0, None, None]


def test_none_code_reads_as_zero(spark):
    assert apply(spark, lambda x: X.rescaled(x, 0, 30, zero_codes=(88,)), [88.0, 3.0, 31.0]) == [0.0, 3.0, None]


def test_reverse_scale(spark):
    got = apply(spark, lambda x: X.reverse_scale(x, 1, 5), [1.0, 5.0, 3.0, 7.0, 0.0, None])
    assert got == [5.0, 1.0, 3.0, None, None, None]


@pytest.mark.parametrize(
    ("op", "cut", "want"),
    [
        (">=", 150, [0, 1, 1, None]),
        ("<", 150, [1, 0, 0, None]),
        (">", 150, [0, 0, 1, None]),
        ("<=", 150, [1, 1, 0, None]),
        ("==", 150, [0, 1, 0, None]),
    ],
)
def test_compare_flag(spark, op, cut, want):
    assert apply(spark, lambda x: X.compare_flag(x, op, cut), [149.0, 150.0, 151.0, None]) == want


def test_nan_passes_a_threshold_when_kept(spark):
    """NaN sorts above every number: the published rules keep it and count it as active."""
    assert apply(spark, lambda x: X.compare_flag(x, ">=", 150), [NAN]) == [1]
    assert apply(spark, lambda x: X.compare_flag(X.nan_to_null(x), ">=", 150), [NAN]) == [None]


def test_healthy_bmi_bounds(spark):
    values = [18.4, 18.5, 24.9, 24.95, 25.0, None]
    assert apply(spark, lambda x: X.between_flag(x, 18.5, 25.0), values) == [0, 1, 1, 1, 0, None]
    assert apply(spark, lambda x: X.between_flag(x, 18.5, 24.9, closed=True), values) == [0, 1, 1, 0, 0, None]


def test_recode_and_overlay(spark):
    values = [1.0, 2.0, 9.0, None]
    assert apply(spark, lambda x: X.recode(x, {1: 1, 2: 0}), values) == [1, 0, None, None]
    assert apply(spark, lambda x: X.recode(x, {1: "Male", 2: "Female"}), values) == [
        "Male", "Female", None, None,
    ]
    assert apply(spark, lambda x: X.overlay_codes(x, {9.0: 11.0}), values) == [1.0, 2.0, 11.0, None]


def test_age_bands(spark):
    values = [18.0, 29.9, 30.0, 59.0, 74.0, 75.0, 80.0, None]
    want = ["18–29", "18–29", "30–44", "45–59", "60–74", "75+", "75+", None]
    assert apply(spark, lambda x: X.band(x, AGE_CUTS, AGE_LABELS), values) == want
    assert apply(spark, lambda x: X.band(x, AGE_CUTS, AGE_LABELS, missing="75+"), [None]) == ["75+"]


def test_bmi_bands(spark):
    values = [18.49, 18.5, 24.95, 25.0, 29.99, 30.0, None]
    want = ["Underweight", "Normal", "Normal", "Overweight", "Overweight", "Obese", None]
    assert apply(spark, lambda x: X.band(x, BMI_CUTS, BMI_LABELS), values) == want


def test_bands_need_matching_labels():
    with pytest.raises(ValueError, match="one label more"):
        X.band(None, (1, 2), ("a", "b"))
    with pytest.raises(ValueError, match="ascending"):
        X.band(None, (2, 1), ("a", "b", "c"))


def test_outcome_flag(spark):
    got = apply(spark, lambda x: X.outcome_flag(x, (1, 2)), [1.0, 2.0, 3.0, 4.0, None, NAN])
    assert got == [1, 1, 0, 0, None, None]


def test_scores_count_null_as_zero(spark):
    df = spark.createDataFrame([(1, None, 0), (None, None, None)], "a int, b int, c int")
    parts = [F.col(c) for c in "abc"]
    got = df.select(X.add_up(parts), X.count_observed(parts)).collect()
    assert [tuple(r) for r in got] == [(1, 2), (0, 0)]


def test_log_positive(spark):
    got = apply(spark, lambda x: X.log_positive(x), [0.0, math.e - 1, None])
    assert got[0] == 0.0 and got[1] == pytest.approx(1.0) and got[2] is None
    assert apply(spark, lambda x: X.log_positive(x, 0.0), [None]) == [0.0]


def test_stars(spark):
    got = apply(spark, lambda x: X.stars(x), [0.0009, 0.001, 0.009, 0.01, 0.049, 0.05])
    assert got == ["***", "**", "**", "*", "*", ""]


def test_hash_share_is_stable_and_even(spark):
    df = spark.range(20_000)
    bucket = X.hash_share(F.col("id"), 1)
    one = df.select(F.sum(bucket * F.col("id"))).head()[0]
    two = df.repartition(5).select(F.sum(bucket * F.col("id"))).head()[0]
    assert one == two
    low, high, part = df.select(
        F.min(bucket), F.max(bucket), F.avg((bucket < 80).cast("int"))
    ).head()
    assert (low, high) == (0, 99)
    assert part == pytest.approx(0.8, abs=0.02)
