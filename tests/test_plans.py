"""What the physical plans must and must not contain."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog.queries import QUERIES
from cohortkit.operators.inference import complete_cases
from cohortkit.session import SETTINGS, held, tune

@pytest.fixture
def sf():
    """Tables no other test caches, so that plans start at the files."""
    return "/root/testdata/sf0.01"


LAZY = sorted(
    name
    for name in QUERIES
    if not re.search(r"logit|fit_summary|forest|auc|roundtrip|standardise|union_years", name)
)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_python_no_cross_joins(spark, sf, name):
    plan = physical(entry.queries()[name](spark, sf))
    for unwanted in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in plan


@pytest.mark.parametrize(
    "name",
    ["q_table1", "q_table1_sd", "q_prevalence_multi", "q_yearly_trend", "q_score_share",
     "q_availability", "q_distributions", "q_overview"],
)
def test_one_scan(spark, sf, name):
    assert physical(entry.queries()[name](spark, sf)).count("FileScan") == 1


def test_rows_are_combined_before_every_shuffle(spark, sf):
    for name in ("q_yearly_trend", "q_prevalence_multi", "q_table1", "q_by_state"):
        plan = physical(entry.queries()[name](spark, sf))
        assert "partial_" in plan.split("FileScan")[0]


def test_scans_read_only_the_columns_used(spark, sf):
    plan = physical(entry.queries()["q_by_year"](spark, sf))
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz>" in plan
    plan = physical(entry.queries()["q_events_prevalence"](spark, sf))
    assert "ReadSchema: struct<event_type:string,value:double>" in plan


def test_complete_cases_skip_row_groups_without_answers(spark, tmp_path):
    """The checks reach the scan; infinite values stay."""
    rows = [(1, 2.0), (0, None), (None, 1.0), (1, float("nan")), (0, -math.inf), (1, math.inf)]
    spark.createDataFrame(rows, "y int, x double").write.parquet(str(tmp_path / "t"))
    cases = complete_cases(spark.read.parquet(str(tmp_path / "t")), "y", ["x"])
    pushed = re.search(r"PushedFilters: \[(.*?)\]", physical(cases)).group(1)
    assert "IsNotNull(y)" in pushed and "IsNotNull(x)" in pushed
    assert sorted(tuple(r) for r in cases.collect()) == [(0, -math.inf), (1, 2.0), (1, math.inf)]


def test_top_and_bottom_share_one_aggregation(spark, sf):
    df = entry.queries()["q_state_topk"](spark, sf)
    df.collect()
    plan = physical(df)
    assert "TakeOrderedAndProject" in plan
    assert "ReusedExchange" in plan


def test_households_are_combined_before_the_join(spark, sf):
    """The join sees one row per household, however many respondents it has."""
    plan = entry.queries()["q_by_state"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join LeftOuter")
    assert "Aggregate [household" in plan[join:]


def test_tune_sets_the_limits(spark):
    tune(spark)
    assert all(spark.conf.get(k) == v for k, v in SETTINGS.items())


def test_held_keeps_the_partitions_and_lets_go(spark):
    small = spark.range(100).coalesce(1)
    with held(small) as frame:
        assert frame.rdd.getNumPartitions() == 1
        assert frame.count() == 100
        assert frame.storageLevel.useDisk
    assert not small.storageLevel.useMemory
    wide = spark.range(0, 100, 1, 20).withColumn("x", F.col("id") * 2)
    with held(wide) as frame:
        assert frame.rdd.getNumPartitions() == 20
