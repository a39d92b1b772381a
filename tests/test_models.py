"""Regression inference, scoring, splits and forest."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from brute import auc, newton
from catalog.survey_view import SPEC
from cohortkit.operators import evaluate as E
from cohortkit.operators import forest as R
from cohortkit.operators import inference as I

#: Questions of different years.
ROTATING = ("sleep_hrs", "flag_poor_sleep", "flag_htn")
FEATURES = ("_AGE80", "bmi", "female", "gen_health")


@pytest.fixture(scope="module")
def cases(respondents):
    return I.complete_cases(respondents, "flag_diabetes", FEATURES, "_LLCPWT").toPandas()


@pytest.fixture(scope="module")
def fit(respondents):
    return I.fit_logit(respondents, "flag_diabetes", FEATURES)


def test_fit_equals_brute_force(fit, cases):
    b, se, ll = newton(cases[list(FEATURES)].to_numpy(float), cases.flag_diabetes.to_numpy(float))
    assert fit.n == len(cases)
    assert fit.coefficients == pytest.approx(b, rel=1e-7)
    assert fit.standard_errors == pytest.approx(se, rel=1e-6)
    assert fit.log_likelihood == pytest.approx(ll, rel=1e-9)
    share = cases.flag_diabetes.mean()
    null = len(cases) * (share * math.log(share) + (1 - share) * math.log(1 - share))
    assert fit.null_log_likelihood == pytest.approx(null, rel=1e-9)
    assert fit.pseudo_r2 == pytest.approx(1 - ll / null, rel=1e-9)


def test_weighted_fit_equals_brute_force(respondents, cases):
    fit = I.fit_logit(respondents, "flag_diabetes", FEATURES, weight="_LLCPWT")
    b, se, ll = newton(
        cases[list(FEATURES)].to_numpy(float),
        cases.flag_diabetes.to_numpy(float),
        cases["_LLCPWT"].to_numpy(float),
    )
    assert fit.coefficients == pytest.approx(b, rel=1e-7)
    assert fit.standard_errors == pytest.approx(se, rel=1e-6)
    assert fit.log_likelihood == pytest.approx(ll, rel=1e-9)


def test_collapsing_equal_rows_changes_nothing(respondents):
    features = ["female", "flag_obese", "pa_any"]
    one = I.fit_logit(respondents, "flag_diabetes", features)
    two = I.fit_logit(respondents, "flag_diabetes", features, collapse=True)
    assert (one.n, one.coefficients) == (two.n, pytest.approx(two.coefficients, rel=1e-7))
    assert one.standard_errors == pytest.approx(two.standard_errors, rel=1e-6)
    assert one.log_likelihood == pytest.approx(two.log_likelihood, rel=1e-9)


def test_heavy_patterns_still_converge(spark):
    """Large cell counts push a naive start to probabilities of 0 and 1."""
    a, b, c, d = 2_340_000, 4_822_000, 368_000, 6_984_000
    table = [(1, 1, a), (0, 1, b), (1, 0, c), (0, 0, d)]
    df = spark.createDataFrame(table, "y int, x int, w bigint")
    fit = I.fit_logit(df, "y", ["x"], weight="w")
    estimates = (math.log(c / d), math.log(a * d / (b * c)))
    assert fit.coefficients == pytest.approx(estimates, rel=1e-9)
    error = math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    assert fit.standard_errors[1] == pytest.approx(error, rel=1e-7)


@pytest.mark.parametrize("collapse", [False, True])
def test_rows_of_weight_zero_take_no_part(spark, collapse):
    rows = [(1, 1, 2.0), (0, 1, 1.0), (1, 0, 1.0), (0, 0, 3.0), (1, 0, 0.0), (1, 2, 0.0)]
    df = spark.createDataFrame(rows, "y int, x int, w double")
    fit = I.fit_logit(df, "y", ["x"], weight="w", collapse=collapse)
    assert fit.coefficients == pytest.approx((math.log(1 / 3), math.log(6)), rel=1e-8)


def test_wald_table(respondents, fit):
    rows = I.wald_table(respondents, fit, {"bmi": "BMI"}).collect()
    assert [r.variable for r in rows] == ["const", *FEATURES]
    bmi = rows[2]
    assert bmi.label == "BMI"
    assert bmi.odds_ratio == pytest.approx(math.exp(bmi.coefficient))
    assert bmi.ci_lower == pytest.approx(math.exp(bmi.coefficient - 1.959963984540054 * bmi.se))
    assert bmi.ci_upper == pytest.approx(math.exp(bmi.coefficient + 1.959963984540054 * bmi.se))
    assert bmi.z == pytest.approx(bmi.coefficient / bmi.se)
    assert bmi.p_value == pytest.approx(math.erfc(abs(bmi.z) / math.sqrt(2)))
    assert (bmi.significance, bmi.direction) == ("***", "increases")
    assert bmi.odds_change_pct == pytest.approx(100 * (bmi.odds_ratio - 1))
    assert rows[0].direction is None and rows[0].odds_change_pct is None


def test_published_layout(respondents, fit):
    t = I.formatted_wald(I.wald_table(respondents, fit))
    assert t.columns == [
        "Variable", "Label", "Coefficient", "SE", "OR", "CI_lower", "CI_upper", "z", "p_value",
        "Significance",
    ]
    row = t.collect()[2]
    assert row.Coefficient == round(fit.coefficients[2], 4)


@pytest.mark.parametrize(
    ("feature", "formula", "message"),
    [
        ("copy", "bmi", "linear dependence among bmi, copy"),
        ("total", "bmi + _AGE80", "linear dependence among _AGE80, bmi, total"),
        ("same", "1.0", "constant same"),
    ],
)
def test_singular_designs_are_named(respondents, feature, formula, message):
    df = respondents.withColumn(feature, F.expr(formula))
    with pytest.raises(I.SingularDesignError, match=message):
        I.fit_logit(df, "flag_diabetes", ["_AGE80", "bmi", feature])


def test_single_constant_feature(respondents):
    df = respondents.withColumn("same", F.lit(2.0))
    with pytest.raises(I.SingularDesignError, match="constant same"):
        I.fit_logit(df, "flag_diabetes", ["same"])


def test_separated_outcome(spark):
    df = spark.createDataFrame([(int(i >= 10), float(i)) for i in range(20)], "y int, x double")
    with pytest.raises(I.SeparatedError, match="x separates"):
        I.fit_logit(df, "y", ["x"], max_iter=25)


@pytest.mark.parametrize("scale", [1.0, 1e-6, 1e6])
def test_separation_by_two_features_is_found_early(spark, scale):
    """Neither x nor z separates the outcome, their sum does; noise does not matter."""
    rng = np.random.default_rng(3)
    x, z, noise = rng.normal(size=(3, 4_000))
    rows = [(int(a + b > 0), float(a * 1e3), float(b), float(c), scale) for a, b, c in zip(x, z, noise)]
    df = spark.createDataFrame(rows, "y int, x double, z double, noise double, w double")
    with pytest.raises(I.SeparatedError, match="x, z"):
        I.fit_logit(df, "y", ["x", "z", "noise"], weight="w", max_iter=30)


def test_quasi_separation_by_a_flag(spark):
    """Nobody with the flag lacks the outcome; among the others both occur."""
    rows = [(1, 1, 0.1 * i) for i in range(30)] + [(i % 2, 0, 0.1 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "y int, flag int, x double")
    with pytest.raises(I.SeparatedError, match="flag"):
        I.fit_logit(df, "y", ["flag", "x"], max_iter=30)


def test_strong_effects_are_not_separation(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=6_000)
    y = (rng.random(6_000) < 1 / (1 + np.exp(-6 * x - 2))).astype(int)
    df = spark.createDataFrame(list(zip(y.tolist(), x.tolist())), "y int, x double")
    b, se, _ = newton(x[:, None], y.astype(float))
    fit = I.fit_logit(df, "y", ["x"])
    assert fit.coefficients == pytest.approx(b, rel=1e-7) and fit.standard_errors == pytest.approx(se, rel=1e-6)


def test_rare_outcomes_and_far_away_features(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(1e6, 1, 20_000)
    y = (rng.random(20_000) < 0.002 * np.exp(x - 1e6)).astype(int)
    df = spark.createDataFrame(list(zip(y.tolist(), x.tolist())), "y int, x double")
    b, se, ll = newton((x - 1e6)[:, None], y.astype(float))
    fit = I.fit_logit(df, "y", ["x"])
    assert fit.coefficients[1] == pytest.approx(b[1], rel=1e-6)
    assert fit.standard_errors[1] == pytest.approx(se[1], rel=1e-6)
    assert fit.log_likelihood == pytest.approx(ll, rel=1e-9)


@pytest.mark.parametrize("weight", [None, "_LLCPWT"])
def test_robust_errors_equal_brute_force(respondents, cases, weight):
    x = np.column_stack([np.ones(len(cases)), cases[list(FEATURES)].to_numpy(float)])
    y = cases.flag_diabetes.to_numpy(float)
    w = cases["_LLCPWT"].to_numpy(float) if weight else np.ones(len(cases))
    if weight is None:
        respondents = respondents.dropna(subset=["_LLCPWT"])
    b, _, _ = newton(x[:, 1:], y, w)
    p = 1 / (1 + np.exp(-x @ b))
    bread = np.linalg.inv((x * (w * p * (1 - p))[:, None]).T @ x)
    meat = (x * ((w * (y - p)) ** 2)[:, None]).T @ x
    want = np.sqrt(np.diag(bread @ meat @ bread))
    fit = I.fit_logit(respondents, "flag_diabetes", FEATURES, weight=weight, robust=True)
    assert fit.standard_errors == pytest.approx(want, rel=1e-6)
    scaled = respondents.withColumn("_LLCPWT", F.col("_LLCPWT") / 1000)
    again = I.fit_logit(scaled, "flag_diabetes", FEATURES, weight=weight, robust=True)
    assert again.standard_errors == pytest.approx(want, rel=1e-6)  # whatever the weights' scale


def test_robust_errors_of_collapsed_rows(respondents):
    features = ["female", "flag_obese"]
    one, two = (
        I.fit_logit(respondents, "flag_diabetes", features, weight="_LLCPWT", collapse=c, robust=True)
        for c in (False, True)
    )
    assert one.standard_errors == pytest.approx(two.standard_errors, rel=1e-6)


def test_a_fit_takes_one_job_a_step(spark, respondents):
    tracker, group = spark.sparkContext.statusTracker(), "count the jobs of a fit"
    spark.sparkContext.setJobGroup(group, group)
    try:
        fit = I.fit_logit(respondents, "flag_diabetes", FEATURES)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup(group)) <= 2 * (fit.iterations + 1) + 2  # a shuffle's stages are jobs


def test_one_sided_outcome(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (None, 3.0)], "y int, x double")
    with pytest.raises(ValueError, match="2 complete cases"):
        I.fit_logit(df, "y", ["x"])


def test_complete_cases_drop_nan_too(spark):
    rows = [(1, 1.0), (1, float("nan")), (0, None), (None, 1.0)]
    df = spark.createDataFrame(rows, "y int, x double")
    assert I.complete_cases(df, "y", ["x"]).count() == 1


def test_predictions_match_the_model(respondents, fit):
    scored = fit.predict(respondents).agg(
        F.avg("probability"),
        F.avg(F.when(F.col("probability").isNotNull(), F.col("flag_diabetes"))),
    )
    mean_p, share = scored.head()
    assert mean_p == pytest.approx(share, abs=0.02)
    row = fit.predict(respondents.filter("bmi IS NULL")).head()
    assert row.probability is None


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame(
        [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, None), (None, 0.3)], "y int, s double"
    )
    assert E.auc(df, "y", "s") == pytest.approx((1 + 1 + 0.5 + 1) / 4)


@pytest.mark.parametrize("distinct", [3, 5_000])
def test_auc_equals_spark_evaluator(spark, distinct):
    rng = np.random.default_rng(distinct)
    score = rng.integers(0, distinct, 5_000) / distinct
    yes = (rng.random(5_000) < score).astype(int)
    df = spark.createDataFrame([(int(y), float(s)) for y, s in zip(yes, score)], "y int, s double")
    evaluator = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="s", numBins=0)
    assert E.auc(df.repartition(13), "y", "s") == pytest.approx(evaluator.evaluate(df), rel=1e-12)


def test_auc_without_pairs(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert E.auc(df, "y", "s") is None
    assert E.auc(df.limit(0), "y", "s") is None


def test_auc_of_fit(respondents, fit):
    scored = fit.predict(respondents).select("flag_diabetes", "probability").dropna().toPandas()
    want = auc(scored.flag_diabetes, scored.probability)
    assert fit.auc(respondents) == pytest.approx(want, rel=1e-9)


# ----------------------------------------------------------------------------- forest


def test_hash_split_ignores_partitioning(respondents):
    chosen = R.in_training("resp_id", 7, 0.8)
    a = respondents.repartition(3).filter(chosen).select("resp_id")
    b = respondents.coalesce(1).filter(chosen).select("resp_id")
    assert a.exceptAll(b).isEmpty() and a.count() == b.count()
    assert a.count() / respondents.count() == pytest.approx(0.8, abs=0.05)


def test_random_split_loses_nothing(respondents):
    train, test = R.random_split(respondents.select("resp_id"), 0.8, 1)
    assert train.unionByName(test).exceptAll(respondents.select("resp_id")).isEmpty()
    assert train.count() + test.count() == respondents.count()
    assert train.count() / respondents.count() == pytest.approx(0.8, abs=0.05)


def test_standardised(respondents):
    z = R.standardised(respondents, ["bmi", "_AGE80"])
    row = z.agg(F.avg("bmi_z"), F.stddev_samp("bmi_z"), F.avg("_AGE80_z")).head()
    assert row[0] == pytest.approx(0, abs=1e-9)
    assert row[1] == pytest.approx(1)
    assert z.count() == respondents.dropna(subset=["bmi", "_AGE80"]).count()


@pytest.fixture(scope="module")
def forest(respondents):
    model = SPEC.model
    features = [c for c in model.forest_features if c not in ROTATING]
    return R.fit_forest(
        respondents, model.outcome, features, model.forest_required, model.seed, trees=10,
        depth=4, split_key="resp_id",
    )


def test_forest(respondents, forest):
    assert sum(forest.importances) == pytest.approx(1)
    assert 0.75 < forest.auc <= 1 and 0.7 < forest.accuracy <= 1
    assert forest.train_used < forest.train_n and forest.test_used < forest.test_n
    top = R.importance_table(respondents, forest, SPEC.model.labels, top=3).collect()
    assert [r.importance for r in top] == sorted(forest.importances, reverse=True)[:3]
    assert {"_AGE80", "bmi"} <= {r.variable for r in top}
    metrics = R.metrics_table(respondents, forest).head()
    assert metrics.auc == forest.auc and metrics.train_n == forest.train_n


def test_rotating_questions_leave_no_rows(respondents):
    """Sleep and blood pressure are never asked in the same year here."""
    model = SPEC.model
    with pytest.raises(ValueError, match="no training rows left"):
        R.fit_forest(
            respondents, model.outcome, model.forest_features, model.forest_required, 1, trees=2
        )


def test_imputed_forest_uses_every_row(respondents):
    model = SPEC.model
    fit = R.fit_forest(
        respondents, model.outcome, model.forest_features, model.forest_required, 1, trees=3,
        depth=3, impute="median",
    )
    required = respondents.dropna(subset=list(model.forest_required)).count()
    assert fit.train_n + fit.test_n == fit.train_used + fit.test_used == required


def test_forest_does_not_follow_the_layout(respondents):
    from catalog.survey_view import SPEC
    from cohortkit.operators.forest import fit_forest

    model = SPEC.model
    fits = [
        fit_forest(
            part, model.outcome, ["bmi", "_AGE80"], [model.outcome, "bmi", "_AGE80"], 7, trees=5, depth=3, split_key="resp_id"
        )
        for part in (respondents.repartition(3), respondents.repartition(7, "bmi"))
    ]
    assert fits[0].train_n == fits[1].train_n
    assert fits[0].importances == fits[1].importances
    assert fits[0].auc == fits[1].auc


def test_a_forest_reads_its_input_once(spark):
    """Sizes, training and test rows were each worked out from the input anew."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def touched(x):
        seen.add(1)
        return float(x % 7)

    rows = spark.range(600).select(F.col("id").alias("k"), (F.col("id") % 2).alias("y"), touched("id").alias("x"))
    fit = R.fit_forest(rows, "y", ["x"], ["y"], 7, trees=2, depth=2, split_key="k")
    assert fit.train_n + fit.test_n == 600 and seen.value == 600


def test_parts_grow_with_the_rows():
    sizes = [10**k for k in range(13)]
    parts = [R.parts_for(n) for n in sizes]
    assert parts[0] == 1 and parts == sorted(parts)
    rows = [n / p for n, p in zip(sizes, parts)]
    assert all(a < b for a, b in zip(rows, rows[1:]))
    assert R.parts_for(120_000) == 11 and 2_000 < R.parts_for(10**9) < 3_000


def test_shares_beyond_hundredths_are_refused():
    from cohortkit.operators.forest import in_training

    for share in (0.125, 0.995, 1.0):
        with pytest.raises(ValueError, match="hundredths"):
            in_training("resp_id", 1, share)


def test_no_complete_cases_names_the_empty_columns(spark):
    from cohortkit.operators.inference import fit_logit

    df = spark.createDataFrame([(1, None, 2.0), (0, None, 1.0)], "y int, x double, z double")
    with pytest.raises(ValueError, match="nothing is known of x"):
        fit_logit(df, "y", ["x", "z"])
