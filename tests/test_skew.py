"""Results stay whole and right when one key holds a third of all rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
from cohortkit.operators.inference import fit_logit

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """The test tables with a third of the orders from one customer in one year."""
    root = tmp_path_factory.mktemp("skew")
    for name in ("customer", "nation"):
        spark.read.parquet(f"{SF}/{name}.parquet").coalesce(1).write.parquet(
            f"{root}/{name}.parquet"
        )
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    hot = F.col("o_orderkey") % 3 == 0
    date = F.lit("1996-06-01").cast("timestamp_ntz")
    orders.withColumns(
        {
            "o_custkey": F.when(hot, F.lit(1)).otherwise(F.col("o_custkey")).cast("bigint"),
            "o_orderdate": F.when(hot, date).otherwise(F.col("o_orderdate")),
        }
    ).repartition(6).write.parquet(f"{root}/orders.parquet")
    return str(root)


@pytest.fixture(scope="module")
def duck(skewed):
    con = check.duckdb.connect()
    for name in ("orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{skewed}/{name}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
@pytest.mark.parametrize(
    "name",
    ["q_by_state", "q_state_topk", "q_yearly_trend", "q_table1_sd", "q_distributions",
     "q_missing_kinds", "q_availability", "q_auc", "q_logit_2x2", "q_prevalence_multi"],
)
def test_hot_key(spark, skewed, duck, name, threshold):
    """With and without Spark's own broadcasts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = entry.queries()[name](spark, skewed).toPandas()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert check.differences(got, duck.execute(entry.oracle_sql()[name]).df()) == []


def test_one_pattern_for_most_rows(spark):
    """A covariate pattern with nearly all rows is one row after collapsing."""
    df = spark.range(0, 100_000, 1, 8).select(
        (F.col("id") % 100 < 1).cast("int").alias("x"),
        (F.col("id") % 7 < 3).cast("int").alias("y"),
    )
    plain = fit_logit(df, "y", ["x"])
    collapsed = fit_logit(df, "y", ["x"], collapse=True)
    assert plain.n == collapsed.n == 100_000
    assert plain.coefficients == pytest.approx(collapsed.coefficients, rel=1e-7, abs=1e-9)
