"""Table 1 and the missingness and distribution tables."""

from __future__ import annotations

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.operators import characteristics as C
from cohortkit.operators import distribution as D
from cohortkit.operators import missingness as M
from cohortkit.spec import Table1Row

ROWS = [
    (1, 60.0, 1, 2.0), (1, 70.0, None, 1.0), (0, 30.0, 0, 1.0), (0, None, 1, 3.0),
    (0, 50.0, 0, 1.0), (None, 90.0, 1, 2.0),
]
LINES = (Table1Row("age", "Age"), Table1Row("f", "Flag (%)", "share"), Table1Row("gone", "Gone"))


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "y int, age double, f int, w double")


def lines(table):
    return {r.variable: r for r in table.collect()}


def test_strata_and_denominators(df):
    t = lines(C.characteristics(df, "y", LINES))
    assert list(t) == ["N", "Age", "Flag (%)"]  # absent variable left out
    assert (t["N"].diabetic, t["N"].no_diabetes, t["N"].overall) == (2, 3, 6)
    assert (t["Age"].diabetic, t["Age"].no_diabetes, t["Age"].overall) == (65.0, 40.0, 60.0)
    assert (t["Flag (%)"].diabetic, t["Flag (%)"].overall) == (100.0, 60.0)
    whole = lines(C.characteristics(df, "y", LINES, denominator="stratum"))
    assert (whole["Flag (%)"].diabetic, whole["Flag (%)"].overall) == (50.0, 50.0)


def test_standard_deviations(df):
    t = lines(C.characteristics(df, "y", LINES, sd=True))["Age"]
    assert t.diabetic_sd == pytest.approx(statistics.stdev([60, 70]))
    assert t.no_diabetes_sd == pytest.approx(statistics.stdev([30, 50]))
    assert t.overall_sd == pytest.approx(statistics.stdev([60, 70, 30, 50, 90]))


def test_weighted_standard_deviations(spark):
    """About the weighted mean, far from zero, with weights of any scale; equal ones change nothing."""
    rng = np.random.default_rng(8)
    y, x, w = rng.integers(0, 2, 400), rng.normal(1e8, 1.0, 400), rng.random(400) * 50
    rows = [(int(a), float(b), float(c)) for a, b, c in zip(y, x, w)] + [(1, None, 3.0), (1, 5.0, 0.0), (None, 1e8, 2.0)]
    df = spark.createDataFrame(rows, "y int, age double, w double")
    lines_ = [C.Table1Row("age", "Age")]

    def want(part):
        v = np.array([r[1] for r in part if r[1] is not None and r[2] > 0])
        u = np.array([r[2] for r in part if r[1] is not None and r[2] > 0])
        near = v - 1e8
        return math.sqrt(np.average((near - np.average(near, weights=u)) ** 2, weights=u) * len(v) / (len(v) - 1))

    for scale in (1, 1e-6):
        scaled = df.withColumn("w", F.col("w") * scale)
        t = lines(C.characteristics(scaled, "y", lines_, weight="w", sd=True))["Age"]
        assert t.diabetic_sd == pytest.approx(want([r for r in rows if r[0] == 1]), rel=1e-6)
        assert t.no_diabetes_sd == pytest.approx(want([r for r in rows if r[0] == 0]), rel=1e-6)
        assert t.overall_sd == pytest.approx(want(rows), rel=1e-6)
    equal = df.filter("w > 0").withColumn("w", F.lit(3.0))
    a = lines(C.characteristics(equal, "y", lines_, weight="w", sd=True))["Age"]
    b = lines(C.characteristics(equal, "y", lines_, sd=True))["Age"]
    assert a.overall_sd == pytest.approx(b.overall_sd, rel=1e-7)


def test_weighted_table(df):
    t = lines(C.characteristics(df, "y", LINES, weight="w"))
    assert t["N"].overall == 6
    assert t["Age"].diabetic == pytest.approx(190 / 3)
    assert t["Flag (%)"].no_diabetes == pytest.approx(60.0)


def test_other_strata(df):
    t = lines(C.characteristics(df, "y", LINES, strata={"yes": 1}, overall="all"))
    assert t["N"].asDict() == {"position": 0, "variable": "N", "kind": "count", "yes": 2, "all": 6}


def test_bad_options(df):
    with pytest.raises(ValueError, match="denominator"):
        C.characteristics(df, "y", LINES, denominator="rows")


def test_formatting(spark, df):
    big = df.crossJoin(spark.range(500).select(F.lit(1).alias("_"))).drop("_")
    t = lines(C.formatted(C.characteristics(big, "y", LINES)))
    assert t["N"].asDict() == {
        "variable": "N", "diabetic": "1,000", "no_diabetes": "1,500", "overall": "3,000",
    }
    assert t["Age"].overall == "60.0" and t["Flag (%)"].no_diabetes == "33.3%"


def test_formatting_of_an_empty_stratum_and_sd(df):
    t = lines(C.formatted(C.characteristics(df.filter("y = 1"), "y", LINES, sd=True)))
    assert t["N"].no_diabetes == "0"
    assert t["Age"].no_diabetes == "—" and t["Flag (%)"].no_diabetes == "—"
    assert t["Age"].diabetic == "65.0 ± 7.1"


def test_published_shares_are_zero_not_null(spark):
    df = spark.createDataFrame([(1, None), (0, 1)], "y int, f int")
    rows = (Table1Row("f", "F", "share"),)
    t = lines(C.characteristics(df, "y", rows, denominator="stratum"))["F"]
    assert (t.diabetic, t.no_diabetes, t.overall) == (0.0, 100.0, 50.0)


# ------------------------------------------------------------------------ missingness

RAW = [
    (2017, 7.0, None), (2017, 1.0, None), (2018, 9.0, 77.0), (2018, None, 99.0), (2019, None, 5.0),
]
CODES = {"a": (7, 9), "b": (77, 99)}


def test_availability(spark):
    raw = spark.createDataFrame(RAW, "survey_year int, a double, b double")
    t = {
        (r.survey_year, r.variable): (r.n, r.answered, r.non_response, r.blank, r.status)
        for r in M.availability(raw, ["a", "b"], CODES).collect()
    }
    assert t[2017, "a"] == (2, 1, 1, 0, "answered")
    assert t[2017, "b"] == (2, 0, 0, 2, "not_asked")
    assert t[2018, "a"] == (2, 0, 1, 1, "no_answer")
    assert t[2018, "b"] == (2, 0, 2, 0, "no_answer")
    assert t[2019, "a"] == (1, 0, 0, 1, "not_asked")


def test_missing_kinds(spark):
    raw = spark.createDataFrame(RAW, "survey_year int, a double, b double")
    t = M.missing_kinds(raw, ["a", "b"], CODES)
    assert t.columns == ["survey_year", "a", "b", "a_kind", "b_kind"]
    got = sorted((r.survey_year, r.a_kind, r.b_kind) for r in t.collect())
    assert got == [
        (2017, "answered", "not_asked"),
        (2017, "non_response", "not_asked"),
        (2018, "blank", "non_response"),
        (2018, "non_response", "non_response"),
        (2019, "not_asked", "answered"),
    ]


def test_missing_kinds_wait_for_an_action(spark):
    """No job while the plan is built, no join and no shuffle of the rows; null and NaN groups."""
    rows = [(1, 1.0), (1, None), (None, None), (None, 5.0), (2, None), (3, float("nan"))]
    raw = spark.createDataFrame(rows, "g int, a double")
    spark.sparkContext.setJobGroup("plan only", "plan only")
    t = M.missing_kinds(raw, ["a"], {}, by="g")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan only")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r.g or 0, r.a_kind) for r in t.collect()) == [
        (0, "answered"), (0, "blank"), (1, "answered"), (1, "blank"), (2, "not_asked"), (3, "not_asked"),
    ]
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_too_many_groups_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_GROUPS", 2)
    raw = spark.createDataFrame([(i, 1.0) for i in range(3)], "g int, a double")
    with pytest.raises(Exception, match="more than 2 groups"):
        M.missing_kinds(raw, ["a"], {}, by="g").collect()


# ---------------------------------------------------------------------- distributions


def test_exact_quantiles_interpolate(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 3, 10)], "x double")
    r = D.exact_quantiles(df, {"x": (0, 10)}, (0, 0.25, 0.5, 0.9, 1)).head()
    assert r.asDict() == {
        "variable": "x", "known": 5, "p0": 1.0, "p25": 2.0, "p50": 2.0,
        "p90": pytest.approx(7.2), "p100": 10.0,
    }


@pytest.mark.parametrize("bad", [2.5, 11.0, -1.0])
def test_exact_quantiles_refuse_other_values(spark, bad):
    df = spark.createDataFrame([(1.0,), (bad,)], "x double")
    with pytest.raises(Exception, match="not a whole number in 0..10"):
        D.exact_quantiles(df, {"x": (0, 10)}, (0.5,)).collect()


def test_approximate_quantiles_are_close(spark):
    df = spark.range(100_001).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).alias("g"))
    for r in D.approximate_quantiles(df, ["x"], (0.025, 0.5), ["g"]).collect():
        assert r.p50 == pytest.approx(50_000, abs=20)
        assert r.p2_5 == pytest.approx(2_500, abs=20)


def test_merged_sketches_answer_for_coarser_groups(spark, tmp_path):
    n = 60_000
    df = spark.range(n).select(
        (F.col("id") * 7919 % n).cast("double").alias("x"), (F.col("id") % 7).alias("year"), (F.col("id") % 50).alias("state"),
        F.lit(None).cast("double").alias("none"),
    )
    fine = D.quantile_sketches(df, ["x", "none"], ["year", "state"])
    fine.write.parquet(str(tmp_path / "sketches"))
    stored = spark.read.parquet(str(tmp_path / "sketches"))
    assert stored.count() == 2 * 350
    assert stored.agg(F.max(F.length("sketch"))).head()[0] < 10_000
    for by in ([], ["year"]):
        found = D.sketched_quantiles(D.merged_sketches(stored, by), (0, 0.1, 0.5, 0.9, 1), by).collect()
        assert len(found) == 2 * (7 if by else 1)
        for r in found:
            if r.variable == "none":
                assert r.known == 0 and r.p50 is None
                continue
            assert r.known == pytest.approx(n / (7 if by else 1), abs=1)
            for p, at in ((0, r.p0), (0.1, r.p10), (0.5, r.p50), (0.9, r.p90), (1, r.p100)):
                assert abs(at / n - p) <= D.SKETCH_ERROR + 1e-3


def brute_weighted(values, weights, p):
    order = np.argsort(values, kind="stable")
    run = np.cumsum(np.array(weights)[order])
    return np.array(values)[order][np.searchsorted(run, p * run[-1] * (1 - 1e-12))]


@pytest.mark.parametrize("kind", ["many", "few", "far", "one"])
def test_weighted_quantiles_equal_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    n = 5_000
    x = {
        "many": rng.normal(size=n), "few": rng.integers(0, 5, n).astype(float),
        "far": np.exp(rng.normal(0, 40, n)) * rng.choice([-1, 1], n), "one": np.full(n, 3.5),
    }[kind]
    w = rng.integers(0, 60, n).astype(float)
    group = rng.choice([0, 0, 0, 1, 2], n)
    rows = [(None if g == 2 else int(g), float(a), float(b)) for g, a, b in zip(group, x, w)]
    df = spark.createDataFrame([*rows, (0, None, 5.0), (0, 1.0, None), (0, float("nan"), 1.0), (9, 1.0, 0.0)], "g int, x double, w double")
    probs = (0, 0.001, 0.25, 0.5, 0.75, 0.999, 1)
    got = {r.g: r for r in D.weighted_quantiles(df, ["x"], probs, "w", ["g"]).collect()}
    assert set(got) == {0, 1, None}
    for g, r in got.items():
        mine = [(a, b) for h, a, b in rows if h == g and b > 0]
        assert r.known == len(mine)
        want = [brute_weighted(*zip(*mine), p) for p in probs]
        assert [r.p0, r.p0_1, r.p25, r.p50, r.p75, r.p99_9, r.p100] == want


def test_weighted_quantiles_have_no_window_over_a_whole_group(spark):
    """Windows run over a group's ranges and over the values of single ranges; the data is
    read once, into counted values."""
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("w"))
    t = D.weighted_quantiles(df, ["x"], (0.5,), "w")
    assert t.head().p50 == 499.0
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("variable" in line for line in windows)  # all partitioned
    over_values = [line for line in windows if "value#" in line]
    assert over_values and all("which:" in line for line in over_values)
    assert D.weighted_quantiles(df.limit(0), ["x"], (0.5,), "w").count() == 0
