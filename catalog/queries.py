"""One registered query per operator: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.survey_view import PUBLISHED, SPEC, survey, table, with_state
from cohortkit import sinks
from cohortkit.health_survey import ANY_PA, BMI, CKD, DIABETES, HTN, OBESITY
from cohortkit.operators import characteristics as C
from cohortkit.operators import distribution as D
from cohortkit.operators import evaluate as E
from cohortkit.operators import forest as R
from cohortkit.operators import inference as I
from cohortkit.operators import missingness as M
from cohortkit.operators import stages as G
from cohortkit.operators import tabulate as P
from cohortkit.plans import run
from cohortkit.sources.yearly import load_years
from cohortkit.spec import SurveySpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[f"q_{fn.__name__}"] = fn
    return fn


def analytic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.analytic(survey(spark, sf_dir), SPEC)


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.analytic(survey(spark, sf_dir), PUBLISHED)


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Select and rename to the lower-case names without edge underscores."""
    return df.select(*(F.col(n).alias(n.lower().strip("_")) for n in names))


# ------------------------------------------------------------------- scans and sinks


def yearly_files(spark: SparkSession, sf_dir: str, fmt: str = "parquet") -> str:
    """Write the respondents as yearly files, as they would arrive: older names up to
    1998, no kidney question in 1995, none of the columns a year lacks.  Every respondent
    is in one of them, those without a date in one of their own."""
    path = sinks.shared_folder(spark)
    raw = survey(spark, sf_dir).select("survey_year", *SPEC.source.columns)
    older = {"DIABETE4": "DIABETE3", "BPHIGH6": "BPHIGH4", "INCOME3": "INCOME2",
             "SEXVAR": "SEX1", "_RFCHOL3": "_RFCHOL2"}
    year = F.col("survey_year")
    layouts = (
        raw.filter(year == 1995).drop("CHCKDNY2").withColumnsRenamed(older),
        raw.filter((year != 1995) & (year <= 1998)).withColumnsRenamed(
            {**older, "CHCKDNY2": "CHCKDNY1"}
        ),
        raw.filter(year.isNull() | (year > 1998)),
    )
    for part in layouts:
        writer = part.write.partitionBy("survey_year").mode("append").format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(path)
    return path


def years_of(spark: SparkSession, sf_dir: str) -> tuple[int | None, ...]:
    """The years that occur, null last if it does, and one that does not."""
    found = survey(spark, sf_dir).select("survey_year").distinct().collect()
    known = sorted(r.survey_year for r in found if r.survey_year is not None)
    return (*known, max(known, default=0) + 1, *([None] if len(known) < len(found) else []))


def yearly_spec(spark: SparkSession, sf_dir: str) -> SurveySpec:
    """The survey as yearly files, with the years the data has."""
    spec = SPEC.at(yearly_files(spark, sf_dir) + "/survey_year={year}")
    return replace(spec, source=replace(spec.source, years=years_of(spark, sf_dir)))


@query
def union_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns(
        load_years(spark, yearly_spec(spark, sf_dir).source), "resp_id", "survey_year", "IYEAR", "SEXVAR", "_AGE80",
        "DIABETE4", "BPHIGH6", "CHCKDNY2", "SLEPTIM1", "_RFCHOL3", "INCOME3",
    )


@query
def scan_export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.shared_folder(spark)
    sinks.write_parquet(analytic(spark, sf_dir), path, SPEC.export, partition_by="survey_year")
    names = {"_LLCPWT": "weight", "_STATE": "state"}
    return spark.read.parquet(path).withColumnsRenamed(names)


@query
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.shared_folder(spark)
    trend = yearly_trend(spark, sf_dir)
    sinks.write_table_csv(trend, path)
    return spark.read.schema(trend.schema).option("header", True).csv(path)


def _exported(df: DataFrame, *extra: str) -> DataFrame:
    names = {"_LLCPWT": "weight", "_STATE": "state"}
    table = df.select("resp_id", *SPEC.export, *extra, "phys_hlth_days", "log_pa_min")
    return rounded(table.withColumnsRenamed(names), ["log_pa_min"])


@query
def analytic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = analytic(spark, sf_dir)
    return _exported(df, "disease_burden_n", "lifestyle_score_n", "female")


@query
def published_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exported(published(spark, sf_dir), "sex")


# -------------------------------------------------------------------------- cleaning


@query
def cast_nullify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns(
        G.standardise(survey(spark, sf_dir), SPEC.clean), "resp_id", "IYEAR", "SEXVAR",
        "SLEPTIM1", "MENTHLTH", "PHYSHLTH", "GENHLTH", "EDUCA", "INCOME3", "SMOKE100",
        "ALCDAY4", "DIABETE4", "BPHIGH6", "CVDCRHD4", "CHCKDNY2", "EXERHMM1", "PA1MIN_",
    )


@query
def nullify_flat_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns(
        G.standardise(survey(spark, sf_dir), PUBLISHED.clean), "resp_id", "SEXVAR", "SLEPTIM1",
        "MENTHLTH", "PHYSHLTH", "GENHLTH", "EDUCA", "INCOME3", "SMOKE100", "ALCDAY4",
        "DIABETE4", "EXERHMM1", "PA1MIN_",
    )


def _cleaned(*names: str) -> Query:
    def query_(spark: SparkSession, sf_dir: str) -> DataFrame:
        return columns(G.clean(survey(spark, sf_dir), SPEC.clean), "resp_id", *names)

    return query_


def _featured(*names: str) -> Query:
    def query_(spark: SparkSession, sf_dir: str) -> DataFrame:
        return columns(analytic(spark, sf_dir), "resp_id", *names)

    return query_


QUERIES["q_rescale_guard"] = _cleaned("_BMI5", "bmi")
QUERIES["q_range_guards"] = _cleaned(
    "sleep_hrs", "mental_hlth_days", "phys_hlth_days", "pa_min_week"
)
QUERIES["q_reverse_scale"] = _cleaned("gen_health")
QUERIES["q_threshold_flags"] = _featured(
    "meets_pa_guidelines", "flag_obese", "flag_poor_sleep", "flag_mental_burden"
)
QUERIES["q_recode_label"] = _cleaned("sex", "sex_label", "pa_any")
QUERIES["q_age_bands"] = _cleaned("age_group")
QUERIES["q_outcome_flags"] = _featured("flag_diabetes", "flag_htn", "flag_chd", "flag_ckd")
QUERIES["q_disease_burden"] = _featured(
    "disease_burden", "disease_burden_n", "flag_htn_available"
)
QUERIES["q_lifestyle_score"] = _featured("lifestyle_score", "lifestyle_score_n")
QUERIES["q_bmi_category"] = _featured("bmi_cat")


@query
def log_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = columns(analytic(spark, sf_dir), "resp_id", "log_pa_min", "years_since_1995")
    return rounded(df, ["log_pa_min"])


@query
def analysis_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = G.adults(analytic(spark, sf_dir), "_AGE80", 21, outcome="flag_diabetes")
    return columns(kept, "resp_id", "_AGE80", "flag_diabetes")


# -------------------------------------------------------------------- summary tables


def _summary(name: str) -> Query:
    spec = next(s for s in SPEC.report.summaries if s.name == name)

    def query_(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(P.summary(analytic(spark, sf_dir), spec), list(spec.means))

    return query_


for _spec in SPEC.report.summaries:
    QUERIES[f"q_{_spec.name}"] = _summary(_spec.name)
yearly_trend = QUERIES["q_yearly_trend"]


@query
def summaries_one_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table of a run, all merged from one scan's cells, with each of its measures,
    stacked as (summary, level, measure, value)."""
    tables = run.describe(analytic(spark, sf_dir), SPEC)
    stacked = []
    for spec in SPEC.report.summaries:
        level = F.col(spec.by[0]).cast("string") if spec.by else F.lit(None).cast("string")
        names = [c for c in tables[spec.name].columns if c not in spec.by]
        lines = F.array(
            *(F.struct(F.lit(c).alias("measure"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in names)
        )
        stacked.append(
            tables[spec.name].select(F.lit(spec.name).alias("summary"), level.alias("level"), F.inline(lines))
        )
    return reduce(DataFrame.unionByName, stacked)


@query
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the stages of a run, counted while they are written."""
    _, counts, _ = run.prepare(spark, yearly_spec(spark, sf_dir))
    return spark.createDataFrame(list(counts.items()), "stage string, n bigint")


@query
def published_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = PUBLISHED.report.summaries[0]
    return P.summary(published(spark, sf_dir), spec, digits=PUBLISHED.report.digits)


@query
def prevalence_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = (
        "meets_pa_guidelines", "flag_poor_sleep", "bmi_cat", "lifestyle_score", "sex_label",
        "age_group",
    )
    flags = {**DIABETES, **HTN, **CKD, **OBESITY, **ANY_PA}
    return rounded(P.prevalence_sets(analytic(spark, sf_dir), sets, flags, BMI), list(BMI))


@query
def published_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {**DIABETES, **HTN, **CKD, **OBESITY, **ANY_PA}
    return P.prevalence(published(spark, sf_dir), ["age_group"], flags, digits=6)


@query
def events_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_type", "value", (F.col("value") >= 100).cast("int").alias("large")
    )
    summary = P.prevalence(
        events, ["event_type"], {"large_pct": "large"}, {"mean_value": "value"}
    )
    return rounded(summary, ["mean_value"])


# --------------------------------------------------------------------------- Table 1


def _table1(
    df: DataFrame, spec=SPEC, weight: str | None = None, sd: bool = False
) -> DataFrame:
    report = spec.report
    return C.characteristics(
        df, "flag_diabetes", report.table1, denominator=report.denominator, weight=weight, sd=sd
    )


def _numbers(df: DataFrame) -> DataFrame:
    return rounded(df, [c for c in df.columns if c not in ("position", "variable", "kind")])


@query
def table1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(_table1(analytic(spark, sf_dir)))


@query
def table1_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(_table1(published(spark, sf_dir), PUBLISHED))


@query
def table1_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(_table1(analytic(spark, sf_dir), weight="_LLCPWT"))


@query
def table1_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(_table1(analytic(spark, sf_dir), sd=True))


@query
def asked_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model features of which a run finds anything known, and which of its columns files lack."""
    spec = yearly_spec(spark, sf_dir)
    model = replace(spec.model, inference_features=(*spec.model.inference_features, "ALCDAY4"))
    _, _, known = run.prepare(spark, replace(spec, model=model))
    lines = [(c, c in known) for c in dict.fromkeys([*model.inference_features, *model.forest_features])]
    return spark.createDataFrame(lines, "variable string, asked boolean")


@query
def table1_weighted_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(_table1(analytic(spark, sf_dir), weight="_LLCPWT", sd=True))


@query
def table1_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.formatted(_table1(published(spark, sf_dir), PUBLISHED))


# ------------------------------- weights, states, distributions, change, missingness


@query
def weighted_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {**DIABETES, **HTN, **OBESITY}
    weighted = P.prevalence(
        analytic(spark, sf_dir), ["survey_year"], flags, BMI, weight="_LLCPWT"
    )
    return rounded(weighted, list(BMI))


@query
def by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {**DIABETES, **OBESITY}
    # Combine per household before the join, so that no household's rows, however
    # many, travel further than the task that read them.
    per_household = P.cells(analytic(spark, sf_dir), ["household"], list(flags.values()))
    return P.rates(with_state(per_household, spark, sf_dir), ["state"], flags)


@query
def state_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = P.extremes(by_state(spark, sf_dir), "state", "diabetes_pct", 10)
    nation = table(spark, sf_dir, "nation")
    return P.with_label(ends, nation, "state", "n_nationkey", "n_name", "state_name")


@query
def state_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.state_ranking(analytic(spark, sf_dir), SPEC, 5)


@query
def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = {"sleep_hrs": (1, 24), "pa_min_week": (0, 10000)}
    probs = (0, 0.05, 0.25, 0.5, 0.75, 0.95, 1)
    found = D.exact_quantiles(analytic(spark, sf_dir), ranges, probs, ["survey_year"])
    return rounded(found, found.columns[3:])


MEASURES = ("bmi", "sleep_hrs", "pa_min_week")
PROBS = (0.05, 0.5, 0.95)


def _rank_checked(
    df: DataFrame, found: DataFrame, by: Sequence[str], probs: Sequence[float], error: float
) -> DataFrame:
    """Per group, variable and probability: known values, and whether the rank of the quantile
    ``found`` is within ``error`` of the one asked for (null without values)."""
    asked = F.array(
        *(F.struct(F.lit(p).alias("p"), F.col(D._name(p)).alias("at")) for p in probs)
    )
    asked = found.select(*(F.col(b).alias(f"group_{b}") for b in by), F.col("variable").alias("name"), "known", F.inline(asked))
    values = df.select(*by, F.inline(F.array(
        *(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in MEASURES)
    )))
    # Equal values are combined before they meet the quantiles of their group.
    counted = values.dropna(subset=["value"]).groupBy(*by, "variable", "value").agg(F.count(F.lit(1)).alias("n"))
    same = [F.col(f"group_{b}").eqNullSafe(F.col(b)) for b in by]
    met = asked.join(counted, [F.col("name") == F.col("variable"), *same], "left")
    ranks = met.groupBy(*(f"group_{b}" for b in by), "name", "known", "p", "at").agg(
        F.sum(F.when(F.col("value") < F.col("at"), F.col("n")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("value") <= F.col("at"), F.col("n")).otherwise(0)).alias("up_to"),
    )
    goal, slack = F.col("p") * F.col("known"), error * F.col("known") + 1
    within = (F.col("below") <= goal + slack) & (F.col("up_to") >= goal - slack)
    return ranks.select(
        *(F.col(f"group_{b}").alias(b) for b in by), F.col("name").alias("variable"), "known", "p",
        F.when(F.col("at").isNotNull(), within).alias("within"),
    )


@query
def quantiles_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = analytic(spark, sf_dir)
    found = D.approximate_quantiles(df, MEASURES, PROBS, ["survey_year"])
    return _rank_checked(df, found, ["survey_year"], PROBS, 1e-4)


@query
def quantiles_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by year and state, stored, then merged over the states."""
    df = analytic(spark, sf_dir)
    fine = D.quantile_sketches(df, MEASURES, ["survey_year", "_STATE"])
    stored = sinks.stage(fine, sinks.shared_folder(spark))
    found = D.sketched_quantiles(D.merged_sketches(stored, ["survey_year"]), PROBS, ["survey_year"])
    return _rank_checked(df, found, ["survey_year"], PROBS, D.SKETCH_ERROR)


@query
def quantiles_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    probs = (0, 0.05, 0.25, 0.5, 0.75, 0.95, 1)
    return D.weighted_quantiles(analytic(spark, sf_dir), MEASURES, probs, "_LLCPWT", ["survey_year"])


@query
def pp_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = P.prevalence(analytic(spark, sf_dir), ["survey_year"], {**DIABETES, **HTN})
    changed = P.change_over_time(yearly, ["diabetes_pct", "htn_pct"])
    return rounded(changed, [c for c in changed.columns if "_since_" in c])


@query
def prevalence_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_bmi = P.prevalence(analytic(spark, sf_dir), ["bmi_cat"], DIABETES)
    return P.ratio_to(by_bmi, "bmi_cat", "Normal", ["diabetes_pct"])


@query
def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = ["SLEPTIM1", "BPHIGH6", "CHCKDNY2", "DIABETE4", "GENHLTH", "PA1MIN_"]
    return M.availability(survey(spark, sf_dir), asked, SPEC.clean.codes)


@query
def missing_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = ["SLEPTIM1", "BPHIGH6", "CHCKDNY2", "PA1MIN_"]
    kinds = M.missing_kinds(survey(spark, sf_dir), asked, SPEC.clean.codes)
    return columns(kinds, "resp_id", "survey_year", *(f"{c}_kind" for c in asked))


@query
def missing_kinds_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN is no answer, in a question with other answers and in one without."""
    raw = survey(spark, sf_dir)
    nan, number = F.lit(float("nan")), F.col("resp_id")
    raw = raw.withColumns({
        "PA1MIN_": F.when(number % 59 == 0, nan).otherwise(F.col("PA1MIN_")),
        "SLEPTIM1": F.when(F.col("survey_year") % 2 == 1, nan).otherwise(F.col("SLEPTIM1")),
    })
    asked = ["SLEPTIM1", "PA1MIN_"]
    kinds = M.missing_kinds(raw, asked, SPEC.clean.codes)
    return columns(kinds, "resp_id", "PA1MIN_", *(f"{c}_kind" for c in asked))


# ---------------------------------------------------------------------------- models


def _inference_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = SPEC.model
    return I.complete_cases(analytic(spark, sf_dir), model.outcome, model.inference_features)


@query
def complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inference_cases(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("flag_diabetes").alias("yes"),
        F.sum("lifestyle_score").alias("score_sum"),
        F.round(F.sum("bmi"), 2).alias("bmi_sum"),
    )


def _fit_2x2(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, I.LogitFit]:
    df = analytic(spark, sf_dir)
    return df, I.fit_logit(df, "flag_diabetes", ["flag_obese"], collapse=True)


@query
def logit_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    wald = I.wald_table(*_fit_2x2(spark, sf_dir)).drop("label", "p_value")
    numbers = ("coefficient", "se", "odds_ratio", "ci_lower", "ci_upper", "z", "odds_change_pct")
    return rounded(wald, numbers, 4)


@query
def logit_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table 2 as published, of the fit whose closed form is known."""
    return I.formatted_wald(I.wald_table(*_fit_2x2(spark, sf_dir), labels={"flag_obese": "Obese"}))


@query
def fit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = I.fit_summary(*_fit_2x2(spark, sf_dir)).drop("iterations")
    summary = rounded(summary, ["log_likelihood", "null_log_likelihood"], 4)
    return rounded(summary, ["pseudo_r2"])


def _fit_full(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, I.LogitFit]:
    df, model = analytic(spark, sf_dir), SPEC.model
    fit = I.fit_logit(df, model.outcome, model.inference_features, max_iter=model.max_iter)
    return df, fit


@query
def logit_wald(spark: SparkSession, sf_dir: str) -> DataFrame:
    wald = I.wald_table(*_fit_full(spark, sf_dir), labels=SPEC.model.labels)
    return I.formatted_wald(wald)


@query
def logit_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, fit = _fit_full(spark, sf_dir)
    return I.fit_summary(df, fit).withColumn("auc", F.lit(fit.auc(df)))


def _estimates(df: DataFrame, outcome: str, features: Sequence[str]) -> DataFrame:
    fit = I.fit_logit(df, outcome, features)
    wald = I.wald_table(df, fit).select(
        "position", "variable", "coefficient", "se", "odds_ratio", "ci_lower", "ci_upper",
        F.round("z", 4).alias("z"), F.lit(fit.n).cast("bigint").alias("n"),
        F.round(F.lit(fit.log_likelihood), 4).alias("log_likelihood"),
    )
    return rounded(wald, ("coefficient", "se", "odds_ratio", "ci_lower", "ci_upper"))


@query
def logit_two_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _estimates(analytic(spark, sf_dir), "flag_diabetes", ["_AGE80", "bmi"])


@query
def logit_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = analytic(spark, sf_dir)
    fit = I.fit_logit(df, "flag_diabetes", ["flag_obese"], weight="_LLCPWT")
    wald = I.wald_table(df, fit).select("position", "variable", "coefficient", "se", "odds_ratio")
    return rounded(wald, ("coefficient", "se", "odds_ratio"), 4)


@query
def logit_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = analytic(spark, sf_dir)
    fit = I.fit_logit(df, "flag_diabetes", ["flag_obese"], weight="_LLCPWT", collapse=True, robust=True)
    wald = I.wald_table(df, fit).select("position", "variable", "coefficient", "se", "ci_lower", "ci_upper")
    return rounded(wald, ("coefficient", "se", "ci_lower", "ci_upper"), 5)


@query
def logit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score equations of the whole regression: at the maximum, what the fit leaves of the
    outcome adds up to nothing along every feature; so the features' totals over the rows with
    the outcome are those the fit expects."""
    df, fit = _fit_full(spark, sf_dir)
    cases = fit.predict(I.complete_cases(df, fit.outcome, fit.features))
    lines = [F.struct(F.lit(c).alias("variable"), F.sum(F.col("probability") * x).alias("expected")) for c, x in (
        (I.CONSTANT, F.lit(1.0)), *((c, F.col(c)) for c in fit.features)
    )]
    return rounded(cases.agg(F.array(*lines).alias("lines")).select(F.inline("lines")), ["expected"], 3)


@query
def logit_auc_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, fit = _fit_2x2(spark, sf_dir)
    return rounded(_value(df, "auc", fit.auc(df)), ["auc"], 8)


@query
def logit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", F.log1p("n_chars").alias("log_chars")
    )
    rated = table(spark, sf_dir, "labels").join(documents, "doc_id")
    return _estimates(rated, "quality", ["log_chars", "toxic"])


@query
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = R.in_training("resp_id", SPEC.model.seed, SPEC.model.train_share)
    return survey(spark, sf_dir).select("resp_id", chosen.alias("in_training"))


def split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resp_id and part, of Spark's own seeded split."""
    model = SPEC.model
    respondents = survey(spark, sf_dir).select("resp_id")
    train, test = R.random_split(respondents, model.train_share, model.seed)
    parts = (train.withColumn("part", F.lit("train")), test.withColumn("part", F.lit("test")))
    return reduce(DataFrame.unionByName, parts)


@query
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many rows of which parts each respondent is."""
    return split_parts(spark, sf_dir).groupBy("resp_id").agg(F.count("part").alias("rows"))


@query
def standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = ["_AGE80", "bmi", "gen_health", "mental_hlth_days"]
    frame = analytic(spark, sf_dir).select("resp_id", *features)
    z = columns(R.standardised(frame, features), "resp_id", *(f"{c}_z" for c in features))
    return rounded(z, z.columns[1:])


def _value(df: DataFrame, name: str, value: float) -> DataFrame:
    return df.sparkSession.createDataFrame([(value,)], f"{name} double")


@query
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = analytic(spark, sf_dir)
    return rounded(_value(df, "auc", E.auc(df, "flag_diabetes", "bmi")), ["auc"], 8)


@query
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = analytic(spark, sf_dir).dropna(subset=["flag_diabetes", "flag_obese"])
    right = F.round(E.accuracy("flag_diabetes", "flag_obese"), 8)
    return judged.agg(right.alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query
def forest_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, model = analytic(spark, sf_dir), SPEC.model
    fit = R.fit_forest(
        df, model.outcome, model.forest_features, model.forest_required, model.seed,
        model.train_share, model.trees, model.depth, split_key="resp_id", impute="median",
    )
    return R.importance_table(df, fit, model.labels)


STUMP = ("flag_diabetes", "female", "pa_any")


@query
def forest_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree of one split over all training rows: what it is worth follows from counts."""
    df, model = analytic(spark, sf_dir), SPEC.model
    fit = R.fit_forest(
        df, "flag_obese", STUMP, ["flag_obese", *STUMP], model.seed, model.train_share,
        trees=1, depth=1, split_key="resp_id", bootstrap=False,
    )
    return R.importance_table(df, fit).select(
        "variable", "importance", F.lit(fit.train_n).alias("n_train"), F.lit(fit.test_n).alias("n_test"),
        F.lit(fit.train_used).alias("train_used"), F.lit(fit.test_used).alias("test_used"),
        F.round(F.lit(fit.auc), 8).alias("auc"), F.round(F.lit(fit.accuracy), 8).alias("accuracy"),
    )


@query
def forest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, model = analytic(spark, sf_dir), SPEC.model
    fit = R.fit_forest(
        df, model.outcome, model.forest_features, model.forest_required, model.seed,
        model.train_share, model.trees, model.depth, split_key="resp_id", impute="median",
    )
    return R.metrics_table(df, fit)
