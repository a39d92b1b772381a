"""Rule levels, missing inputs, and the two rule sets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortkit.health_survey import COLUMNS, default_spec, published_spec
from cohortkit.operators.stages import (
    MissingColumnsError,
    adults,
    analytic,
    clean,
    derive,
    engineer,
    present,
    standardise,
)
from cohortkit.spec import Available, CleanSpec, Flag, Outcome, Score

NAN = float("nan")
RAW = ", ".join(f"`{c}` double" for c in COLUMNS) + ", survey_year int"


def raw(spark, **values):
    row = tuple(values.get(c) for c in COLUMNS) + (values.get("survey_year", 2018),)
    return spark.createDataFrame([row], RAW)


def one(spark, spec, **values):
    return analytic(raw(spark, **values), spec).head()


def test_missing_inputs_are_all_named(spark):
    df = raw(spark).drop("_BMI5", "GENHLTH")
    with pytest.raises(MissingColumnsError, match="_BMI5, GENHLTH") as e:
        clean(df, default_spec().clean)
    assert e.value.columns == ("_BMI5", "GENHLTH")


def test_skip_leaves_out_dependent_rules(spark):
    df = raw(spark).drop("_BMI5", "BPHIGH6")
    cleaned = clean(df, default_spec().clean, on_missing="skip")
    out = engineer(cleaned, default_spec().features, on_missing="skip")
    assert "bmi" not in out.columns and "flag_obese" not in out.columns
    assert "lifestyle_score" not in out.columns  # one of its parts needs bmi
    assert out.schema["flag_htn"].dataType.simpleString() == "int"
    assert out.head().flag_htn is None


def test_unknown_option(spark):
    with pytest.raises(ValueError, match="on_missing"):
        derive(spark.range(1), [], on_missing="ignore")


def test_circular_rules(spark):
    rules = [Available("a", "b"), Available("b", "a")]
    with pytest.raises(ValueError, match="depend on each other"):
        derive(spark.range(1), rules)


def test_rules_may_come_in_any_order(spark):
    df = spark.createDataFrame([(3.0,), (None,)], "x double")
    rules = [Score("s", ("big", "yes"), "seen"), Flag("big", "x", ">", 2), Outcome("yes", "x", (3,))]
    got = derive(df, rules).select("s", "seen").collect()
    assert [tuple(r) for r in got] == [(2, 2), (0, 0)]


def test_one_projection_per_level(spark):
    """The whole rule set costs four projections above the scan, not one per column."""
    spec = default_spec()
    plan = analytic(raw(spark), spec)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") <= 4


def test_standardise_types(spark):
    df = spark.createDataFrame(
        [("1.5", "x", 7, NAN, 2019), ("", "2", 3, 4.0, 2019)],
        "a string, b string, c bigint, d double, survey_year int",
    )
    out = standardise(df, CleanSpec({"c": (7,)}, ()))
    assert [f.dataType.simpleString() for f in out.schema] == [
        "double", "double", "double", "double", "int",
    ]
    assert [tuple(r) for r in out.collect()] == [
        (1.5, None, None, None, 2019),
        (None, 2.0, 3.0, 4.0, 2019),
    ]


def test_valid_seven_hours_of_sleep(spark):
    row = one(spark, default_spec(), SLEPTIM1=7.0)
    assert (row.sleep_hrs, row.flag_poor_sleep, row.flag_enough_sleep) == (7.0, 0, 1)
    assert one(spark, published_spec(), SLEPTIM1=7.0).sleep_hrs is None


@pytest.mark.parametrize("hours", [77.0, 99.0, 0.0, 25.0, None])
def test_invalid_sleep(spark, hours):
    assert one(spark, default_spec(), SLEPTIM1=hours).sleep_hrs is None


def test_outlier_minutes(spark):
    row = one(spark, default_spec(), PA1MIN_=20000.0)
    assert (row.pa_min_week, row.meets_pa_guidelines) == (None, None)
    row = one(spark, published_spec(), PA1MIN_=20000.0)
    assert (row.pa_min_week, row.meets_pa_guidelines) == (None, 1)


def test_missing_minutes(spark):
    row = one(spark, default_spec())
    assert (row.meets_pa_guidelines, row.log_pa_min) == (None, None)
    row = one(spark, published_spec())
    assert (row.meets_pa_guidelines, row.log_pa_min) == (None, 0.0)
    assert one(spark, default_spec(), PA1MIN_=NAN).meets_pa_guidelines is None
    assert one(spark, published_spec(), PA1MIN_=NAN).meets_pa_guidelines == 1


def test_missing_age(spark):
    assert one(spark, default_spec()).age_group is None
    assert one(spark, published_spec()).age_group == "75+"
    assert one(spark, published_spec(), _AGE80=NAN).age_group == "75+"


def test_bmi_just_under_25(spark):
    row = one(spark, default_spec(), _BMI5=2495.0)
    assert (row.bmi_cat, row.flag_healthy_bmi, row.lifestyle_score) == ("Normal", 1, 1)
    row = one(spark, published_spec(), _BMI5=2495.0)
    assert (row.bmi_cat, row.flag_healthy_bmi, row.lifestyle_score) == ("Normal", 0, 0)


def test_scores_report_what_was_observed(spark):
    row = one(spark, default_spec())
    assert (row.disease_burden, row.disease_burden_n) == (0, 0)
    assert (row.lifestyle_score, row.lifestyle_score_n) == (0, 0)
    row = one(spark, default_spec(), DIABETE4=2.0, CVDCRHD4=2.0, SMOKE100=2.0, SLEPTIM1=5.0)
    assert (row.disease_burden, row.disease_burden_n) == (1, 2)
    assert (row.lifestyle_score, row.lifestyle_score_n) == (1, 2)
    assert row.flag_htn_available == 0


def test_sex_and_trend(spark):
    row = one(spark, default_spec(), SEXVAR=2.0, survey_year=2021)
    assert (row.sex, row.sex_label, row.female, row.years_since_2017) == (2, "Female", 1, 4.0)
    row = one(spark, default_spec(), SEXVAR=9.0)
    assert (row.sex, row.sex_label, row.female) == (None, None, None)


def test_adults_filter(spark):
    df = spark.createDataFrame([(17.0, 1), (18.0, None), (40.0, 0), (None, 1)], "age double, y int")
    assert adults(df, "age").count() == 2
    assert adults(df, "age", outcome="y").count() == 1


def test_present(spark):
    assert present(spark.range(1).withColumn("a", F.lit(1)), ["b", "a", "id"]) == ["a", "id"]


def test_rules_run_on_a_stream(spark, tmp_path):
    """The stages are stateless expressions: a streaming table takes them unchanged."""
    raw(spark, _BMI5=3100.0).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw(spark).schema).parquet(str(tmp_path / "in"))
    out = analytic(stream, default_spec())
    assert out.isStreaming and "flag_obese" in out.columns


def test_nan_is_blank_not_an_answer(spark):
    from cohortkit.operators.missingness import availability, missing_kinds

    rows = [(2017, float("nan")), (2017, float("nan")), (2018, 3.0), (2018, float("nan"))]
    raw = spark.createDataFrame(rows, "survey_year int, x double")
    got = {r.survey_year: (r.answered, r.blank, r.status) for r in availability(raw, ["x"], {}).collect()}
    assert got == {2017: (0, 2, "not_asked"), 2018: (1, 1, "answered")}
    kinds = missing_kinds(raw, ["x"], {}).groupBy("survey_year", "x_kind").count().collect()
    assert {(r.survey_year, r.x_kind): r["count"] for r in kinds} == {
        (2017, "not_asked"): 2, (2018, "answered"): 1, (2018, "blank"): 1,
    }
