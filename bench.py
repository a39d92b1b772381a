"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores (default 8).  With
BENCH_COPIES=n the whole analysis also runs on n times the respondents: every order n times,
each time under another number, customer and price (24 copies of sf0.1 are 3.6 million).
"""

from __future__ import annotations

import json
import os
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.queries import QUERIES, yearly_spec
from cohortkit import sinks
from cohortkit.plans.run import run

HEADLINE = (
    "q_yearly_trend", "q_prevalence_overall", "q_by_age", "q_score_share",
    "q_prevalence_multi", "q_weighted_prevalence", "q_table1", "q_analytic_table",
    "q_availability", "q_missing_kinds", "q_state_topk", "q_distributions", "q_auc",
    "q_logit_2x2", "q_logit_wald", "q_forest_importance",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cohortkit-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 3)


def consume(df: DataFrame) -> None:
    """Compute every row and column without bringing rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def whole_analysis(spark: SparkSession, sf_dir: str) -> float:
    """Yearly files to tables, models and export, as one run."""
    spec = yearly_spec(spark, sf_dir)
    spec = replace(spec, model=replace(spec.model, impute="median", split_key="resp_id"))
    output = sinks.shared_folder(spark)

    def work() -> None:
        analysis = run(spark, spec, output)
        for table in analysis.summaries.values():
            table.collect()

    return timed(work)


def enlarged(spark: SparkSession, sf_dir: str, copies: int) -> str:
    """A folder with ``copies`` times the orders of ``sf_dir``."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    top = orders.agg(F.max("o_orderkey")).head()[0] + 1
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    many = orders.repartition(8).withColumn("copy", copy).withColumns(
        {
            "o_orderkey": F.col("o_orderkey") + F.col("copy") * top,
            "o_custkey": F.col("o_custkey") + 7 * F.col("copy"),
            "o_totalprice": F.col("o_totalprice") + 31 * F.col("copy"),
        }
    )
    folder = sinks.shared_folder(spark)
    sinks.write_parquet(many.drop("copy"), f"{folder}/orders.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    consume(QUERIES["q_by_year"](spark, sf_dir))  # start the JVM's compilers
    seconds = {
        name: timed(lambda: consume(QUERIES[name](spark, sf_dir))) for name in HEADLINE
    }
    seconds["whole_analysis"] = whole_analysis(spark, sf_dir)
    copies = int(os.environ.get("BENCH_COPIES", "0"))
    if copies:
        seconds[f"whole_analysis_x{copies}"] = whole_analysis(spark, enlarged(spark, sf_dir, copies))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
