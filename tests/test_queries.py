"""Every registered query against its SQL."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
import catalog.queries
import check
from brute import auc, newton
from catalog.survey_view import SPEC
from cohortkit.operators import distribution as D

QUERIES = {n: q for n, q in entry.queries().items() if n in catalog.queries.QUERIES}
SQL = {n: s for n, s in entry.oracle_sql().items() if n in QUERIES}


@pytest.fixture(scope="module")
def duck(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert check.differences(got, duck.execute(SQL[name]).df()) == []
    assert len(got) > 0


# Queries without SQL, against brute force on the same rows.


@pytest.fixture(scope="module")
def rows(respondents):
    return respondents.toPandas()


@pytest.fixture(scope="module")
def brute_fit(rows):
    model = SPEC.model
    cases = rows[[model.outcome, *model.inference_features]].dropna()
    x = cases[list(model.inference_features)].to_numpy(float)
    y = cases[model.outcome].to_numpy(float)
    return x, y, newton(x, y)


def test_logit_wald(spark, sf, brute_fit):
    _, _, (b, se, _) = brute_fit
    got = QUERIES["q_logit_wald"](spark, sf).toPandas()
    assert got.Variable.tolist() == ["const", *SPEC.model.inference_features]
    assert got.Coefficient.tolist() == pytest.approx(b, abs=6e-5)
    assert got.SE.tolist() == pytest.approx(se, abs=6e-5)
    assert got.OR.tolist() == pytest.approx(np.exp(b), abs=6e-5)
    z = b / se
    assert got.z.tolist() == pytest.approx(z, abs=6e-4)
    p = [math.erfc(abs(v) / math.sqrt(2)) for v in z]
    assert got.p_value.tolist() == pytest.approx(p, abs=6e-5)


def test_logit_auc(spark, sf, brute_fit):
    x, y, (b, _, ll) = brute_fit
    row = QUERIES["q_logit_auc"](spark, sf).head()
    assert row.n == len(y)
    assert row.log_likelihood == pytest.approx(ll, rel=1e-9)
    score = pd.Series(b[0] + x @ b[1:])
    assert row.auc == pytest.approx(auc(pd.Series(y), score), rel=1e-9)


def test_quantiles_approx(respondents, rows):
    df = D.approximate_quantiles(respondents, ["bmi", "sleep_hrs", "pa_min_week"], (0.05, 0.5, 0.95), ["survey_year"])
    for r in df.collect():
        known = rows.loc[rows.survey_year == r.survey_year, r.variable].dropna().sort_values()
        assert r.known == len(known)
        for p, got in ((0.05, r.p5), (0.5, r.p50), (0.95, r.p95)):
            if len(known):
                assert got == known.iloc[math.ceil(p * len(known)) - 1]
            else:
                assert got is None


def test_random_split(spark, sf, rows):
    got = catalog.queries.split_parts(spark, sf).toPandas()
    assert sorted(got.resp_id) == sorted(rows.resp_id)
    assert (got.part == "train").mean() == pytest.approx(SPEC.model.train_share, abs=0.05)


def in_training(key):
    digest = hashlib.md5(f"{key}{SPEC.model.seed}".encode()).hexdigest()
    return int(digest[:8], 16) % 100 < 80


def test_forest_metrics(spark, sf, rows):
    row = QUERIES["q_forest_metrics"](spark, sf).head()
    known = rows.dropna(subset=list(SPEC.model.forest_required))
    train = known.resp_id.map(in_training).sum()
    assert (row.train_n, row.test_n) == (train, len(known) - train)
    assert (row.train_used, row.test_used) == (row.train_n, row.test_n)  # filled in
    assert 0.75 < row.auc <= 1 and row.accuracy > known.flag_diabetes.eq(0).mean() - 0.05


def test_forest_importance(spark, sf):
    got = QUERIES["q_forest_importance"](spark, sf).toPandas()
    assert len(got) == 10 and got.importance.is_monotonic_decreasing
    # the outcome of the test survey is a threshold on age and BMI
    assert set(got.variable[:2]) == {"_AGE80", "bmi"}


def test_queries_without_sql_are_those_above():
    assert set(QUERIES) - set(SQL) == {
        "q_logit_wald", "q_logit_auc", "q_forest_metrics", "q_forest_importance",
    }


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "survey_year" and df.count() == 7
