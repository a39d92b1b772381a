"""The whole analysis: load, clean, engineer, tabulate, model, export."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cohortkit import sinks
from cohortkit.operators import characteristics as C
from cohortkit.operators import forest as R
from cohortkit.operators import inference as I
from cohortkit.operators import tabulate as P
from cohortkit.operators.distribution import approximate_quantiles
from cohortkit.operators.missingness import availability
from cohortkit.operators.stages import all_known, analytic, present
from cohortkit.session import tune
from cohortkit.sources.yearly import load_years
from cohortkit.spec import SurveySpec


log = logging.getLogger(__name__)

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


@dataclass(frozen=True)
class Analysis:
    """Results of a run; the DataFrames are computed when used."""

    table: DataFrame
    counts: dict[str, int]  # rows of each stage, taken while it was written
    summaries: dict[str, DataFrame]
    states: DataFrame | None
    distributions: DataFrame
    table1: DataFrame
    logit: I.LogitFit
    table2: DataFrame
    forest: R.ForestFit | None
    notes: tuple[str, ...] = ()

    @property
    def rows(self) -> int:
        return self.counts["analytic"]


def needed(spec: SurveySpec) -> list[str]:
    """Analytic columns that any later stage reads."""
    report, model = spec.report, spec.model
    used = [*spec.export, spec.state, spec.weight, spec.source.year_column, model.outcome]
    for s in report.summaries:
        used += [*s.by, *s.flags.values(), *s.means.values()]
    used += [row.column for row in report.table1] + [*report.distributions]
    used += [*model.inference_features, *model.forest_features, *model.forest_required]
    used += [model.split_key] if model.split_key else []
    return list(dict.fromkeys(used))


def prepare(spark: SparkSession, spec: SurveySpec) -> tuple[DataFrame, dict[str, int], list[str]]:
    """The analytic table, written once to the shared folder and read back; rows of the
    stages; and the model features that some row knows.

    Every later stage scans that table for the few columns it needs.  The yearly files
    are read once, and a lost executor costs no recomputation of them.  The counts are
    taken from the rows on their way into the table.
    """
    model = spec.model
    loaded = Observation()
    raw = load_years(tune(spark), spec.source).observe(loaded, F.count(F.lit(1)).alias("loaded"))
    df = analytic(raw, spec)
    df = df.select(present(df, needed(spec)))
    asked = list(dict.fromkeys([*model.inference_features, *model.forest_features]))

    def rows(columns: Sequence[str]) -> Column:
        return F.count(F.when(all_known(df, columns), 1))

    counts = {
        "analytic": F.count(F.lit(1)),
        "outcome_known": rows([model.outcome]),
        "complete_cases": rows([model.outcome, *model.inference_features]),
        "forest_cases": rows(model.forest_required),
        **{f"known:{c}": rows([c]) for c in asked},
    }
    path = f"{sinks.shared_folder(spark)}/analytic"
    year = spec.source.year_column
    staged, seen = sinks.stage_counted(df, path, counts, partition_by=year)
    known = [c for c in asked if seen.pop(f"known:{c}")]
    return staged, {"loaded": loaded.get["loaded"], **seen}, known


def describe(df: DataFrame, spec: SurveySpec, weight: str | None = None) -> dict[str, DataFrame]:
    """All summary tables from one scan of the analytic table."""
    report = spec.report
    cells = P.summary_cells(df, report.summaries, weight)
    cells = sinks.stage(cells, f"{sinks.shared_folder(df.sparkSession)}/cells")
    return P.summaries(cells, report.summaries, weight, report.digits)


def state_ranking(df: DataFrame, spec: SurveySpec, k: int = 10) -> DataFrame | None:
    """The ``k`` states with the highest and lowest prevalence of the first flag, named."""
    states, names = spec.report.states, spec.report.state_names
    if states is None or not present(df, states.by):
        return None
    table = P.summary(df, states, digits=spec.report.digits)
    ends = P.extremes(table, states.by[0], next(iter(states.flags)), k)
    if not names:
        return ends
    codes = df.sparkSession.createDataFrame(list(names.items()), "code int, state_name string")
    return P.with_label(ends, codes, states.by[0], "code", "state_name", "state_name")


def question_availability(spark: SparkSession, spec: SurveySpec) -> DataFrame:
    """Which questions each year asked, and how they were answered (one raw scan)."""
    raw = load_years(tune(spark), spec.source)
    asked = present(raw, list(spec.clean.codes))
    return availability(raw, asked, spec.clean.codes, spec.source.year_column)


def _asked(features: Sequence[str], known: Sequence[str]) -> tuple[list[str], list[str]]:
    """The features of which anything is known, and a note on each of the others."""
    notes = [f"{c} left out: no year asked it" for c in features if c not in known]
    return [c for c in features if c in known], notes


def run(spark: SparkSession, spec: SurveySpec, output: str, score: str | None = None) -> Analysis:
    """Run every stage and write the analytic table and Tables 1 and 2 under ``output``.

    ``score`` names an extra exported column with the fitted probability.  Features nobody
    was asked are left out of the models, and without complete rows there is no forest;
    ``notes`` says so.  What is ready is written before the next model is fitted.
    """
    model = spec.model
    df, counts, known = prepare(spark, spec)
    log.info("rows: %s", counts)
    summaries = describe(df, spec)
    table1 = C.characteristics(
        df, model.outcome, spec.report.table1, denominator=spec.report.denominator
    )
    sinks.write_table_csv(C.formatted(table1), f"{output}/table1")
    year = spec.source.year_column
    if score is None:
        sinks.write_parquet(df, f"{output}/analytic", spec.export, partition_by=year)
    asked, notes = _asked(model.inference_features, known)
    logit = I.fit_logit(df, model.outcome, asked, max_iter=model.max_iter)
    table2 = I.wald_table(df, logit, model.labels)
    sinks.write_table_csv(I.formatted_wald(table2), f"{output}/table2")
    if score is not None:
        exported, columns = logit.predict(df, into=score), [*spec.export, score]
        sinks.write_parquet(exported, f"{output}/analytic", columns, partition_by=year)
    usable, more = _asked(model.forest_features, known)
    notes += [note for note in more if note not in notes]
    forest = None
    try:
        forest = R.fit_forest(
            df,
            model.outcome,
            usable,
            [c for c in model.forest_required if c in usable or c not in model.forest_features],
            model.seed,
            model.train_share,
            model.trees,
            model.depth,
            split_key=model.split_key,
            impute=model.impute,
        )
    except R.NoRowsError as e:
        notes.append(f"no forest: {e}")
    for note in notes:
        log.warning(note)

    return Analysis(
        table=df,
        counts=counts,
        summaries=summaries,
        states=state_ranking(df, spec),
        distributions=approximate_quantiles(df, spec.report.distributions, QUANTILES, [year]),
        table1=table1,
        logit=logit,
        table2=table2,
        forest=forest,
        notes=tuple(notes),
    )
