"""Run the whole analysis: ``python -m cohortkit PATH OUTPUT`` (PATH holds ``{year}``)."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import SparkSession

from cohortkit.health_survey import YEARS, default_spec, published_spec
from cohortkit.operators.forest import importance_table, metrics_table
from cohortkit.operators.inference import fit_summary
from cohortkit.plans.run import Analysis, run

SHOWN_ROWS = 30


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="cohortkit", description="Health-survey analysis")
    parser.add_argument("path", help="yearly files, with {year} in the path")
    parser.add_argument("output", help="folder for the analytic table and Tables 1 and 2")
    parser.add_argument("--format", default="parquet", help="parquet, orc, csv, json or xport")
    parser.add_argument("--years", type=int, nargs="+", default=list(YEARS))
    parser.add_argument("--rules", choices=("default", "published"), default="default")
    parser.add_argument("--impute", choices=("mean", "median"), help="fill forest features")
    parser.add_argument("--score", help="name of an exported column of fitted probabilities")
    return parser.parse_args(argv)


def show(analysis: Analysis, labels: dict[str, str]) -> None:
    tables = dict(analysis.summaries)
    if analysis.states is not None:
        tables["states"] = analysis.states
    tables |= {
        "distributions": analysis.distributions,
        "table1": analysis.table1,
        "table2": analysis.table2,
        "fit": fit_summary(analysis.table, analysis.logit),
    }
    if analysis.forest is not None:
        tables["forest"] = metrics_table(analysis.table, analysis.forest)
        tables["importances"] = importance_table(analysis.table, analysis.forest, labels)
    for name, table in tables.items():
        print(name)
        table.show(SHOWN_ROWS, truncate=False)


def main(argv: Sequence[str] | None = None) -> Analysis:
    args = arguments(argv)
    make = published_spec if args.rules == "published" else default_spec
    options = {"header": "true"} if args.format == "csv" else {}
    spec = make(args.path, base_year=min(args.years)).at(
        args.path, format=args.format, years=tuple(args.years), options=options
    )
    spec = replace(spec, model=replace(spec.model, impute=args.impute))
    spark = SparkSession.builder.appName("cohortkit").getOrCreate()
    analysis = run(spark, spec, args.output, score=args.score)
    show(analysis, dict(spec.model.labels))
    return analysis


if __name__ == "__main__":
    main()
