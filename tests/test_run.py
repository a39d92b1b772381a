"""The whole analysis on yearly files."""

from __future__ import annotations

from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

import check
from catalog.oracles import ORACLES
from catalog.queries import QUERIES, analytic, yearly_files
from catalog.survey_view import PUBLISHED, SPEC
from cohortkit.__main__ import main
from cohortkit.operators import characteristics as C
from cohortkit.operators import tabulate as P
from cohortkit.plans.run import question_availability, run


def spec_for(spec, files):
    model = replace(spec.model, impute="median", split_key="resp_id", trees=5, depth=3)
    return replace(spec.at(files + "/survey_year={year}"), model=model)


@pytest.fixture(scope="module")
def files(spark, sf):
    return yearly_files(spark, sf)


@pytest.fixture(scope="module")
def done(spark, files, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    return run(spark, spec_for(SPEC, files), out, score="probability"), out


def test_summaries_equal_those_of_the_survey_view(spark, sf, done):
    direct = analytic(spark, sf)
    for s in SPEC.report.summaries:
        want = P.summary(direct, s).toPandas().round(9)
        assert done[0].summaries[s.name].toPandas().round(9).equals(want), s.name


def test_export(spark, done):
    analysis, out = done
    back = spark.read.parquet(f"{out}/analytic")
    assert sorted(back.columns) == sorted([*SPEC.export, "probability"])
    assert back.count() == 1500
    known = back.filter("probability IS NOT NULL")
    assert known.filter("flag_diabetes IS NOT NULL").count() == analysis.logit.n
    assert known.filter(~F.col("probability").between(0, 1)).isEmpty()


def test_states_and_distributions(done):
    analysis, _ = done
    states = analysis.states.collect()
    assert [(r.end, r["rank"]) for r in states] == [
        (end, i + 1) for end in ("top", "bottom") for i in range(10)
    ]
    assert states[0].diabetes_pct >= states[9].diabetes_pct >= states[10].diabetes_pct
    sleep = analysis.distributions.filter("variable = 'sleep_hrs' AND known > 0").collect()
    assert {r.survey_year for r in sleep} == {1996, 1998, 2000}
    assert all(4 <= r.p5 <= r.p50 <= r.p95 <= 10 for r in sleep)


def test_question_availability(spark, files):
    t = question_availability(spark, spec_for(SPEC, files))
    missing = {(r.survey_year, r.variable) for r in t.filter("status = 'not_asked'").collect()}
    sleep = {(y, "SLEPTIM1") for y in (1995, 1997, 1999, 2001)}
    pressure = {(y, "BPHIGH6") for y in (1996, 1998, 2000)}
    assert missing == sleep | pressure | {(1995, "CHCKDNY2")}


def test_tables_on_disk(spark, done):
    analysis, out = done
    t1 = spark.read.option("header", True).csv(f"{out}/table1")
    assert t1.columns == ["variable", "diabetic", "no_diabetes", "overall"]
    assert t1.count() == len(SPEC.report.table1) + 1
    t2 = spark.read.option("header", True).csv(f"{out}/table2")
    assert t2.count() == len(SPEC.model.inference_features) + 1
    assert t2.head().Variable == "const"


def test_models(done):
    analysis, _ = done
    assert analysis.rows == 1500
    assert analysis.logit.pseudo_r2 > 0.2
    assert analysis.forest.auc > 0.7
    assert len(analysis.forest.importances) == len(SPEC.model.forest_features)


def test_published_rules_end_to_end(spark, sf, files, tmp_path):
    spec = spec_for(PUBLISHED, files)
    analysis = run(spark, spec, str(tmp_path))
    direct = C.characteristics(
        analytic(spark, sf), "flag_diabetes", SPEC.report.table1
    ).collect()
    published = analysis.table1.collect()
    htn = next(i for i, r in enumerate(published) if r.variable.startswith("Hypertension"))
    # over the whole stratum, years without the question dilute the share
    assert published[htn].overall < direct[htn].overall
    trend = analysis.summaries["yearly_trend"].collect()
    assert all(round(r.diabetes_pct, 1) == r.diabetes_pct for r in trend)
    assert "sex" in analysis.logit.features and "female" not in analysis.logit.features


def test_command_line(spark, files, tmp_path, capsys):
    analysis = main(
        [files + "/survey_year={year}", str(tmp_path), "--years", *map(str, range(1995, 2003)),
         "--rules", "published", "--impute", "mean"]
    )
    shown = capsys.readouterr().out
    assert "table2" in shown and "Self-rated health" in shown
    assert analysis.logit.features[-1] == "years_since_1995"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["analytic", "table1", "table2"]


def test_counts_ride_along(spark, done):
    """Rows of the stages, known features included, without a job of their own."""
    analysis, _ = done
    counts, table = analysis.counts, analysis.table
    assert counts["loaded"] == counts["analytic"] == analysis.rows == table.count()
    assert counts["outcome_known"] == table.filter("flag_diabetes IS NOT NULL").count()
    assert counts["complete_cases"] == table.dropna(subset=[SPEC.model.outcome, *SPEC.model.inference_features]).count()
    assert counts["forest_cases"] == analysis.forest.train_n + analysis.forest.test_n


def test_years_come_from_the_data(spark, tmp_path):
    """Dates before the first named year and none at all."""
    dates = ["1993-05-01", "1995-02-03", "1997-01-01", "1999-09-09", "2004-12-31", None]
    rows = [(i, i % 7, float(1000 + i), d) for i, d in enumerate(dates * 20)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, d string")
    orders = orders.withColumn("o_orderdate", F.to_date("d")).drop("d")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = QUERIES["q_union_years"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert check.differences(got, con.execute(ORACLES["q_union_years"]).df()) == []
    assert len(got) == 120 and got.survey_year.isna().sum() == 20
