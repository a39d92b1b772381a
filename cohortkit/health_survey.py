"""Ready-made specs for the annual telephone health survey.

``default_spec`` makes the statistically careful choices; ``published_spec`` gives
the results of the published analysis of 2017-2024, quirks included (see README,
"Two rule sets").
"""

from __future__ import annotations

from dataclasses import replace

from cohortkit.spec import (
    Available,
    Bands,
    Between,
    CleanSpec,
    FeatureSpec,
    Flag,
    Guard,
    LogPositive,
    ModelSpec,
    Offset,
    Outcome,
    Recode,
    ReportSpec,
    Reverse,
    Rule,
    Score,
    SourceSpec,
    Summary,
    SurveySpec,
    Table1Row,
)

# Survey years, public codebook names and their renames over time.
YEARS = (2017, 2018, 2019, 2020, 2021, 2022, 2023, 2024)

COLUMNS = (
    "IYEAR", "_STATE", "SEXVAR", "_AGE80", "_IMPRACE", "EDUCA", "INCOME3",
    "_TOTINDA", "PA1MIN_", "SLEPTIM1", "MENTHLTH", "PHYSHLTH", "GENHLTH",
    "_BMI5", "_BMI5CAT", "DIABETE4", "BPHIGH6", "CVDCRHD4", "CHCKDNY2",
    "_RFCHOL3", "SMOKE100", "ALCDAY4", "EXERHMM1", "_LLCPWT",
)

ALIASES = {
    "SEXVAR": ("SEXVAR", "SEX1", "SEX", "_SEX"),
    "INCOME3": ("INCOME3", "INCOME2"),
    "BPHIGH6": ("BPHIGH6", "BPHIGH4"),
    "CHCKDNY2": ("CHCKDNY2", "CHCKDNY1"),
    "DIABETE4": ("DIABETE4", "DIABETE3"),
    "_RFCHOL3": ("_RFCHOL3", "_RFCHOL2"),
}

# Codes for "don't know" and "refused", per column as in the codebook.
MISSING_CODES = {
    "SEXVAR": (7, 9),
    "EDUCA": (9,),
    "INCOME3": (77, 99),
    "SLEPTIM1": (77, 99),
    "MENTHLTH": (77, 99),
    "PHYSHLTH": (77, 99),
    "GENHLTH": (7, 9),
    "DIABETE4": (7, 9),
    "BPHIGH6": (7, 9),
    "CVDCRHD4": (7, 9),
    "CHCKDNY2": (7, 9),
    "SMOKE100": (7, 9),
    "ALCDAY4": (777, 999),
    "EXERHMM1": (777, 999),
}

# The flat code set of the published analysis and the columns it hits.
FLAT_CODES = (7, 9, 77, 99, 777, 999)
FLAT_COLUMNS = (
    "SLEPTIM1", "MENTHLTH", "PHYSHLTH", "GENHLTH", "EDUCA", "INCOME3", "SMOKE100",
    "ALCDAY4", "DIABETE4", "BPHIGH6", "CVDCRHD4", "CHCKDNY2", "SEXVAR", "EXERHMM1",
    "PA1MIN_",
)

# Cut points and labels.
AGE_CUTS = (30, 45, 60, 75)
AGE_LABELS = ("18–29", "30–44", "45–59", "60–74", "75+")
BMI_CUTS = (18.5, 25.0, 30.0)
BMI_LABELS = ("Underweight", "Normal", "Overweight", "Obese")
ACTIVE_MINUTES = 150
ENOUGH_SLEEP = 7
MANY_BAD_DAYS = 14

# Display labels of model variables.
VARIABLE_LABELS = {
    "log_pa_min": "PA volume (log MET-min/wk)",
    "meets_pa_guidelines": "Meets CDC PA guidelines",
    "pa_any": "Any physical activity",
    "sleep_hrs": "Sleep duration (hrs/night)",
    "flag_poor_sleep": "Poor sleep (<7 hrs)",
    "lifestyle_score": "Healthy lifestyle score (0–4)",
    "bmi": "BMI (kg/m²)",
    "flag_obese": "Obesity (BMI ≥30)",
    "_AGE80": "Age (years)",
    "sex": "Female sex",
    "female": "Female sex",
    "mental_hlth_days": "Poor mental health days",
    "flag_mental_burden": "Mental health burden (≥14 days)",
    "flag_htn": "Hypertension",
    "flag_chd": "Coronary heart disease",
    "gen_health": "Self-rated health (1=Poor–5=Excellent)",
}

# Lines of the characteristics table, in display order.
TABLE1 = (
    Table1Row("_AGE80", "Age (years)"),
    Table1Row("bmi", "BMI (kg/m²)"),
    Table1Row("pa_min_week", "PA (MET-min/week)"),
    Table1Row("sleep_hrs", "Sleep duration (hrs/night)"),
    Table1Row("mental_hlth_days", "Poor mental health days/month"),
    Table1Row("gen_health", "Self-rated health (1=Poor–5=Excellent)"),
    Table1Row("sex", "Female (%)", "share", 2),
    Table1Row("pa_any", "Any physical activity (%)", "share"),
    Table1Row("meets_pa_guidelines", "Meets CDC PA guidelines (%)", "share"),
    Table1Row("flag_poor_sleep", "Poor sleep — <7 hrs (%)", "share"),
    Table1Row("flag_obese", "Obesity — BMI ≥30 (%)", "share"),
    Table1Row("flag_htn", "Hypertension (%) [odd yrs only]", "share"),
    Table1Row("flag_chd", "Coronary heart disease (%)", "share"),
    Table1Row("flag_mental_burden", "Mental health burden ≥14 days (%)", "share"),
)

DIABETES = {"diabetes_pct": "flag_diabetes"}
HTN = {"htn_pct": "flag_htn"}
CKD = {"ckd_pct": "flag_ckd"}
CHD = {"chd_pct": "flag_chd"}
OBESITY = {"obesity_pct": "flag_obese"}
MENTAL = {"mental_burden_pct": "flag_mental_burden"}
ANY_PA = {"any_pa_pct": "pa_any"}
BMI = {"mean_bmi": "bmi"}
SLEEP = {"mean_sleep_hrs": "sleep_hrs"}
AVERAGES = {
    "mean_age": "_AGE80",
    **BMI,
    **SLEEP,
    "mean_pa_min_wk": "pa_min_week",
    "mean_mental_bad_days": "mental_hlth_days",
}

# The summary tables of the analysis, all taken from one scan (see tabulate.summaries).
SUMMARIES = (
    Summary("overview", means=AVERAGES, digits={"mean_pa_min_wk": 0}),
    Summary("by_year", ("survey_year",)),
    Summary("prevalence_overall", flags={**DIABETES, **HTN, **CKD, **CHD, **OBESITY}),
    Summary(
        "yearly_trend", ("survey_year",), {**DIABETES, **HTN, **CKD, **OBESITY, **ANY_PA}, SLEEP
    ),
    Summary(
        "by_guideline",
        ("meets_pa_guidelines",),
        {**DIABETES, **HTN, **CKD, **OBESITY},
        {**BMI, **SLEEP},
    ),
    Summary("by_sleep", ("flag_poor_sleep",), {**DIABETES, **HTN, **CKD, **MENTAL}),
    Summary("by_bmi", ("bmi_cat",), {**DIABETES, **HTN, **CKD, **ANY_PA}),
    Summary("score_share", ("lifestyle_score",), {**DIABETES, **CKD}, share="share_pct"),
    Summary("by_sex", ("sex_label",), {**DIABETES, **HTN, **CKD}, BMI),
    Summary("by_age", ("age_group",), {**DIABETES, **HTN, **CKD, **OBESITY, **ANY_PA}),
)

# FIPS codes of the states and territories.
STATE_NAMES = {
    1: "Alabama", 2: "Alaska", 4: "Arizona", 5: "Arkansas", 6: "California", 8: "Colorado",
    9: "Connecticut", 10: "Delaware", 11: "District of Columbia", 12: "Florida", 13: "Georgia",
    15: "Hawaii", 16: "Idaho", 17: "Illinois", 18: "Indiana", 19: "Iowa", 20: "Kansas",
    21: "Kentucky", 22: "Louisiana", 23: "Maine", 24: "Maryland", 25: "Massachusetts",
    26: "Michigan", 27: "Minnesota", 28: "Mississippi", 29: "Missouri", 30: "Montana",
    31: "Nebraska", 32: "Nevada", 33: "New Hampshire", 34: "New Jersey", 35: "New Mexico",
    36: "New York", 37: "North Carolina", 38: "North Dakota", 39: "Ohio", 40: "Oklahoma",
    41: "Oregon", 42: "Pennsylvania", 44: "Rhode Island", 45: "South Carolina",
    46: "South Dakota", 47: "Tennessee", 48: "Texas", 49: "Utah", 50: "Vermont",
    51: "Virginia", 53: "Washington", 54: "West Virginia", 55: "Wisconsin", 56: "Wyoming",
    66: "Guam", 72: "Puerto Rico", 78: "Virgin Islands",
}

# Columns of the exported analytic table.
EXPORT = (
    "survey_year", "_STATE", "sex_label", "age_group", "bmi_cat", "bmi", "sleep_hrs",
    "pa_min_week", "meets_pa_guidelines", "mental_hlth_days", "gen_health",
    "lifestyle_score", "disease_burden", "flag_diabetes", "flag_htn", "flag_ckd",
    "flag_chd", "flag_obese", "flag_poor_sleep", "flag_mental_burden", "_LLCPWT",
)


# Fixed value: the public codebook's answer "none" to both questions on days.
NO_DAYS = (88.0,)


def _clean_rules(
    active_source: str, age_missing: str | None, no_days: tuple[float, ...] = ()
) -> tuple[Rule, ...]:
    return (
        Guard("bmi", "_BMI5", 10, 80, divisor=100.0),
        Guard("sleep_hrs", "SLEPTIM1", 1, 24),
        Reverse("gen_health", "GENHLTH", 1, 5),
        Guard("mental_hlth_days", "MENTHLTH", 0, 30, zero_codes=no_days),
        Guard("phys_hlth_days", "PHYSHLTH", 0, 30, zero_codes=no_days),
        Guard("pa_min_week", "PA1MIN_", 0, 10000),
        Flag("meets_pa_guidelines", active_source, ">=", ACTIVE_MINUTES),
        Recode("sex", "SEXVAR", {1: 1, 2: 2}),
        Recode("sex_label", "sex", {1: "Male", 2: "Female"}),
        Bands("age_group", "_AGE80", AGE_CUTS, AGE_LABELS, missing=age_missing),
        Recode("pa_any", "_TOTINDA", {1: 1, 2: 0}),
    )


def _feature_rules(
    base_year: int, healthy_bmi: Between, log_missing: float | None
) -> tuple[Rule, ...]:
    return (
        Outcome("flag_diabetes", "DIABETE4", (1, 2)),
        Outcome("flag_htn", "BPHIGH6", (1,)),
        Outcome("flag_chd", "CVDCRHD4", (1,)),
        Outcome("flag_ckd", "CHCKDNY2", (1,)),
        Flag("flag_obese", "bmi", ">=", BMI_CUTS[-1]),
        Flag("flag_poor_sleep", "sleep_hrs", "<", ENOUGH_SLEEP),
        Flag("flag_mental_burden", "mental_hlth_days", ">=", MANY_BAD_DAYS),
        Flag("flag_enough_sleep", "sleep_hrs", ">=", ENOUGH_SLEEP),
        healthy_bmi,
        Outcome("flag_never_smoker", "SMOKE100", (2,)),
        Recode("female", "sex", {1: 0, 2: 1}),
        Score(
            "disease_burden",
            ("flag_diabetes", "flag_htn", "flag_ckd", "flag_chd"),
            observed="disease_burden_n",
        ),
        Available("flag_htn_available", "flag_htn"),
        Score(
            "lifestyle_score",
            ("meets_pa_guidelines", "flag_enough_sleep", "flag_healthy_bmi", "flag_never_smoker"),
            observed="lifestyle_score_n",
        ),
        Bands("bmi_cat", "bmi", BMI_CUTS, BMI_LABELS),
        LogPositive("log_pa_min", "pa_min_week", missing=log_missing),
        Offset(f"years_since_{base_year}", "survey_year", base_year),
    )


def _model(sex: str, base_year: int) -> ModelSpec:
    years = f"years_since_{base_year}"
    # The two feature lists; the first holds only yearly questions.
    inference = (
        "log_pa_min", "meets_pa_guidelines", "pa_any", "lifestyle_score", "bmi",
        "flag_obese", "_AGE80", sex, "mental_hlth_days", "flag_mental_burden",
        "flag_chd", "gen_health", years,
    )
    forest = (
        "log_pa_min", "meets_pa_guidelines", "pa_any", "sleep_hrs", "flag_poor_sleep",
        "lifestyle_score", "bmi", "flag_obese", "_AGE80", sex, "mental_hlth_days",
        "flag_mental_burden", "flag_htn", "flag_chd", "gen_health", years,
    )
    return ModelSpec(
        outcome="flag_diabetes",
        inference_features=inference,
        forest_features=forest,
        forest_required=("flag_diabetes", "bmi", "_AGE80", sex),
        labels={**VARIABLE_LABELS, years: f"Survey year (years since {base_year})"},
    )


def default_spec(path: str = "data/{year}", base_year: int = YEARS[0]) -> SurveySpec:
    """Per-column missing codes, null kept as null, shared cut points, 0/1 sex."""
    return SurveySpec(
        source=SourceSpec(YEARS, path, COLUMNS, aliases=ALIASES),
        clean=CleanSpec(MISSING_CODES, _clean_rules("pa_min_week", None, NO_DAYS)),
        features=FeatureSpec(
            _feature_rules(
                base_year, Between("flag_healthy_bmi", "bmi", BMI_CUTS[0], BMI_CUTS[1]), None
            )
        ),
        report=ReportSpec(
            SUMMARIES,
            TABLE1,
            states=Summary("by_state", ("_STATE",), {**DIABETES, **OBESITY}),
            state_names=STATE_NAMES,
            distributions=("pa_min_week", "sleep_hrs"),
        ),
        model=_model("female", base_year),
        state="_STATE",
        weight="_LLCPWT",
        export=EXPORT,
    )


def published_spec(path: str = "data/{year}", base_year: int = YEARS[0]) -> SurveySpec:
    """The choices behind the published tables.

    One flat code set on fifteen columns, NaN left as NaN, missing age counted as
    75+, the guideline flag on unguarded minutes, healthy BMI closed at 24.9, log
    minutes 0.0 when missing, sex as 1/2, binary lines of Table 1 over the whole
    stratum, one decimal.
    """
    spec = default_spec(path, base_year)
    return replace(
        spec,
        clean=CleanSpec(
            {c: FLAT_CODES for c in FLAT_COLUMNS},
            _clean_rules("PA1MIN_", AGE_LABELS[-1]),
            nan_as_null=False,
        ),
        source=replace(spec.source, nan_as_null=False),
        features=FeatureSpec(
            _feature_rules(
                base_year, Between("flag_healthy_bmi", "bmi", 18.5, 24.9, closed=True), 0.0
            )
        ),
        report=replace(spec.report, denominator="stratum", digits=1),
        model=_model("sex", base_year),
    )
