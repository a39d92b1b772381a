"""The SQL each registered query must agree with, written for DuckDB.

Ratios are one division of whole sums where the inputs are whole numbers; results that
depend on the order of floating-point additions are rounded to six decimals on both
sides.
"""

from __future__ import annotations

from catalog.survey_view import SPEC, SURVEY_CTE
from cohortkit.health_survey import STATE_NAMES

FOREST_REQUIRED = SPEC.model.forest_required
ASKED = tuple(dict.fromkeys([*SPEC.model.inference_features, "ALCDAY4", *SPEC.model.forest_features]))

# Column -> missing codes of the careful rule set.
CODES = {
    "SEXVAR": "7, 9",
    "EDUCA": "9",
    "INCOME3": "77, 99",
    "SLEPTIM1": "77, 99",
    "MENTHLTH": "77, 99",
    "PHYSHLTH": "77, 99",
    "GENHLTH": "7, 9",
    "DIABETE4": "7, 9",
    "BPHIGH6": "7, 9",
    "CVDCRHD4": "7, 9",
    "CHCKDNY2": "7, 9",
    "SMOKE100": "7, 9",
    "ALCDAY4": "777, 999",
    "EXERHMM1": "777, 999",
}
FLAT = "7, 9, 77, 99, 777, 999"
UNCODED = ("_STATE", "_AGE80", "_IMPRACE", "_TOTINDA", "_BMI5", "_BMI5CAT", "_RFCHOL3", "_LLCPWT")


def _coded(column: str, codes: str | None) -> str:
    if codes is None:
        return column
    return f"CASE WHEN {column} IN ({codes}) THEN NULL ELSE {column} END AS {column}"


def _raw_cte(flat: bool) -> str:
    columns = [
        _coded(c, FLAT if flat else CODES.get(c)) for c in (*CODES, "PA1MIN_")
    ]
    return (
        "raw AS (SELECT resp_id, household, survey_year, TRY_CAST(IYEAR AS DOUBLE) AS IYEAR, "
        + ", ".join([*UNCODED, *columns])
        + " FROM survey)"
    )


def _cleaned_cte(published: bool) -> str:
    minutes = "PA1MIN_" if published else "pa_min_week"
    mental, physical = ("" if published else f"WHEN {c} = 88 THEN 0" for c in ("MENTHLTH", "PHYSHLTH"))
    age_else = "'75+'" if published else "CASE WHEN _AGE80 IS NULL THEN NULL ELSE '75+' END"
    return f"""
guarded AS (SELECT *,
    CASE WHEN _BMI5 / 100e0 BETWEEN 10 AND 80 THEN _BMI5 / 100e0 END AS bmi,
    CASE WHEN SLEPTIM1 BETWEEN 1 AND 24 THEN SLEPTIM1 END AS sleep_hrs,
    CASE WHEN GENHLTH BETWEEN 1 AND 5 THEN 6 - GENHLTH END AS gen_health,
    CASE {mental} WHEN MENTHLTH BETWEEN 0 AND 30 THEN MENTHLTH END AS mental_hlth_days,
    CASE {physical} WHEN PHYSHLTH BETWEEN 0 AND 30 THEN PHYSHLTH END AS phys_hlth_days,
    CASE WHEN PA1MIN_ BETWEEN 0 AND 10000 THEN PA1MIN_ END AS pa_min_week,
    CASE WHEN SEXVAR IN (1, 2) THEN CAST(SEXVAR AS INT) END AS sex,
    CASE WHEN _AGE80 < 30 THEN '18–29' WHEN _AGE80 < 45 THEN '30–44'
         WHEN _AGE80 < 60 THEN '45–59' WHEN _AGE80 < 75 THEN '60–74'
         ELSE {age_else} END AS age_group,
    CASE _TOTINDA WHEN 1 THEN 1 WHEN 2 THEN 0 END AS pa_any
  FROM raw),
cleaned AS (SELECT *,
    CASE WHEN {minutes} IS NULL THEN NULL WHEN {minutes} >= 150 THEN 1 ELSE 0 END
      AS meets_pa_guidelines,
    CASE sex WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' END AS sex_label
  FROM guarded)"""


def _analytic_cte(published: bool) -> str:
    upper = "<= 24.9" if published else "< 25"
    log_else = "0e0" if published else "CASE WHEN pa_min_week IS NULL THEN NULL ELSE 0e0 END"
    return f"""
flagged AS (SELECT *,
    CASE WHEN DIABETE4 IS NULL THEN NULL WHEN DIABETE4 IN (1, 2) THEN 1 ELSE 0 END AS flag_diabetes,
    CASE WHEN BPHIGH6 IS NULL THEN NULL WHEN BPHIGH6 = 1 THEN 1 ELSE 0 END AS flag_htn,
    CASE WHEN CVDCRHD4 IS NULL THEN NULL WHEN CVDCRHD4 = 1 THEN 1 ELSE 0 END AS flag_chd,
    CASE WHEN CHCKDNY2 IS NULL THEN NULL WHEN CHCKDNY2 = 1 THEN 1 ELSE 0 END AS flag_ckd,
    CASE WHEN bmi IS NULL THEN NULL WHEN bmi >= 30 THEN 1 ELSE 0 END AS flag_obese,
    CASE WHEN sleep_hrs IS NULL THEN NULL WHEN sleep_hrs < 7 THEN 1 ELSE 0 END AS flag_poor_sleep,
    CASE WHEN mental_hlth_days IS NULL THEN NULL WHEN mental_hlth_days >= 14 THEN 1 ELSE 0 END
      AS flag_mental_burden,
    CASE WHEN sex IS NULL THEN NULL WHEN sex = 2 THEN 1 ELSE 0 END AS female,
    CASE WHEN bmi < 18.5 THEN 'Underweight' WHEN bmi < 25 THEN 'Normal'
         WHEN bmi < 30 THEN 'Overweight' WHEN bmi IS NOT NULL THEN 'Obese' END AS bmi_cat,
    CASE WHEN pa_min_week > 0 THEN ln(1 + pa_min_week) ELSE {log_else} END AS log_pa_min,
    CAST(survey_year - 1995 AS DOUBLE) AS years_since_1995
  FROM cleaned),
analytic AS (SELECT *,
    COALESCE(flag_diabetes, 0) + COALESCE(flag_htn, 0) + COALESCE(flag_ckd, 0)
      + COALESCE(flag_chd, 0) AS disease_burden,
    (flag_diabetes IS NOT NULL)::INT + (flag_htn IS NOT NULL)::INT + (flag_ckd IS NOT NULL)::INT
      + (flag_chd IS NOT NULL)::INT AS disease_burden_n,
    CASE WHEN flag_htn IS NULL THEN 0 ELSE 1 END AS flag_htn_available,
    COALESCE(meets_pa_guidelines, 0) + (CASE WHEN sleep_hrs >= 7 THEN 1 ELSE 0 END)
      + (CASE WHEN bmi >= 18.5 AND bmi {upper} THEN 1 ELSE 0 END)
      + (CASE WHEN SMOKE100 = 2 THEN 1 ELSE 0 END) AS lifestyle_score,
    (meets_pa_guidelines IS NOT NULL)::INT + (sleep_hrs IS NOT NULL)::INT
      + (bmi IS NOT NULL)::INT + (SMOKE100 IS NOT NULL)::INT AS lifestyle_score_n
  FROM flagged)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


SURVEY = _with(SURVEY_CTE)
RAW = _with(SURVEY_CTE, _raw_cte(False))
CLEANED = _with(SURVEY_CTE, _raw_cte(False), _cleaned_cte(False))
ANALYTIC = _with(SURVEY_CTE, _raw_cte(False), _cleaned_cte(False), _analytic_cte(False))
PUB_RAW = _with(SURVEY_CTE, _raw_cte(True))
PUB = _with(SURVEY_CTE, _raw_cte(True), _cleaned_cte(True), _analytic_cte(True))


def _pct(column: str, name: str) -> str:
    return f"100e0 * sum({column}) / count({column}) AS {name}"


def _wpct(column: str, name: str) -> str:
    return (
        f"100e0 * sum(_LLCPWT * {column}) / "
        f"sum(CASE WHEN {column} IS NOT NULL THEN _LLCPWT END) AS {name}"
    )


def _mean(column: str, name: str) -> str:
    return f"round(sum({column}) / count({column}), 6) AS {name}"


DIABETES = _pct("flag_diabetes", "diabetes_pct")
HTN = _pct("flag_htn", "htn_pct")
CKD = _pct("flag_ckd", "ckd_pct")
CHD = _pct("flag_chd", "chd_pct")
OBESITY = _pct("flag_obese", "obesity_pct")
MENTAL = _pct("flag_mental_burden", "mental_burden_pct")
ANY_PA = _pct("pa_any", "any_pa_pct")


def _grouped(key: str, *measures: str, cte: str = ANALYTIC) -> str:
    return f"{cte}SELECT {key}, count(*) AS n, {', '.join(measures)} FROM analytic GROUP BY {key}"


def _pick(columns: str, cte: str, source: str) -> str:
    return f"{cte}SELECT resp_id, {columns} FROM {source}"


EXPORT = (
    "survey_year, _STATE AS state, sex_label, age_group, bmi_cat, bmi, sleep_hrs, pa_min_week, "
    "meets_pa_guidelines, mental_hlth_days, gen_health, lifestyle_score, disease_burden, "
    "flag_diabetes, flag_htn, flag_ckd, flag_chd, flag_obese, flag_poor_sleep, "
    "flag_mental_burden, _LLCPWT AS weight"
)

YEARLY = ", ".join(
    [DIABETES, HTN, CKD, OBESITY, ANY_PA, _mean("sleep_hrs", "mean_sleep_hrs")]
)


def _sets() -> str:
    keys = (
        "meets_pa_guidelines", "flag_poor_sleep", "bmi_cat", "lifestyle_score",
        "sex_label", "age_group",
    )
    return ANALYTIC + "\nUNION ALL ".join(
        f"SELECT '{k}' AS dimension, CAST({k} AS VARCHAR) AS level, count(*) AS n, "
        f"{DIABETES}, {HTN}, {CKD}, {OBESITY}, {ANY_PA}, {_mean('bmi', 'mean_bmi')} "
        f"FROM analytic GROUP BY {k}"
        for k in keys
    )


def _stacked_summaries() -> str:
    trend = (DIABETES, HTN, CKD, OBESITY, ANY_PA, _mean("sleep_hrs", "mean_sleep_hrs"))
    bmi, sleep = _mean("bmi", "mean_bmi"), _mean("sleep_hrs", "mean_sleep_hrs")
    share = "100e0 * count(*) / sum(count(*)) OVER () AS share_pct"
    averages = (
        _mean("_AGE80", "mean_age"), bmi, sleep, _mean("pa_min_week", "mean_pa_min_wk"),
        _mean("mental_hlth_days", "mean_mental_bad_days"),
    )
    tables = {
        "overview": (None, averages), "by_year": ("survey_year", ()),
        "prevalence_overall": (None, (DIABETES, HTN, CKD, CHD, OBESITY)),
        "yearly_trend": ("survey_year", trend),
        "by_guideline": ("meets_pa_guidelines", (DIABETES, HTN, CKD, OBESITY, bmi, sleep)),
        "by_sleep": ("flag_poor_sleep", (DIABETES, HTN, CKD, MENTAL)),
        "by_bmi": ("bmi_cat", (DIABETES, HTN, CKD, ANY_PA)),
        "score_share": ("lifestyle_score", (DIABETES, CKD, share)),
        "by_sex": ("sex_label", (DIABETES, HTN, CKD, bmi)),
        "by_age": ("age_group", (DIABETES, HTN, CKD, OBESITY, ANY_PA)),
    }

    def stacked(name: str, key: str | None, measures: tuple[str, ...]) -> str:
        level, group = (f"CAST({key} AS VARCHAR)", f" GROUP BY {key}") if key else ("CAST(NULL AS VARCHAR)", "")
        split = [m.rsplit(" AS ", 1) for m in ("count(*) AS n", *measures)]
        names = ", ".join(f"'{n}'" for _, n in split)
        values = ", ".join(f"round(CAST({v} AS DOUBLE), 6)" for v, _ in split)
        return (
            f"SELECT '{name}' AS summary, level, unnest([{names}]) AS measure, unnest(v) AS value "
            f"FROM (SELECT {level} AS level, [{values}] AS v FROM analytic{group})"
        )

    return ANALYTIC + "\nUNION ALL ".join(stacked(n, k, m) for n, (k, m) in tables.items())


def _table1(
    published: bool = False, weighted: bool = False, sd: bool = False
) -> str:
    means = (
        ("_AGE80", "Age (years)"),
        ("bmi", "BMI (kg/m²)"),
        ("pa_min_week", "PA (MET-min/week)"),
        ("sleep_hrs", "Sleep duration (hrs/night)"),
        ("mental_hlth_days", "Poor mental health days/month"),
        ("gen_health", "Self-rated health (1=Poor–5=Excellent)"),
    )
    shares = (
        ("sex", 2, "Female (%)"),
        ("pa_any", 1, "Any physical activity (%)"),
        ("meets_pa_guidelines", 1, "Meets CDC PA guidelines (%)"),
        ("flag_poor_sleep", 1, "Poor sleep — <7 hrs (%)"),
        ("flag_obese", 1, "Obesity — BMI ≥30 (%)"),
        ("flag_htn", 1, "Hypertension (%) [odd yrs only]"),
        ("flag_chd", 1, "Coronary heart disease (%)"),
        ("flag_mental_burden", 1, "Mental health burden ≥14 days (%)"),
    )
    strata = (
        ("diabetic", "flag_diabetes = 1"),
        ("no_diabetes", "flag_diabetes = 0"),
        ("overall", "TRUE"),
    )
    w = "_LLCPWT" if weighted else "1"

    def columns(value, spread=None):
        out = [f"{value(cond)} AS {name}" for name, cond in strata]
        if sd:
            none = "CAST(NULL AS DOUBLE)"
            out += [
                f"{spread(cond) if spread else none} AS {name}_sd" for name, cond in strata
            ]
        return ", ".join(out)

    def mean(c):
        return lambda cond: (
            f"round(sum(CASE WHEN {cond} THEN {w} * {c} END) / "
            f"sum(CASE WHEN {cond} AND {c} IS NOT NULL THEN {w} END), 6)"
        )

    def spread(c):
        if not weighted:
            return lambda cond: f"round(stddev_samp(CASE WHEN {cond} THEN {c} END), 6)"
        # Two passes: squares about the weighted mean of the stratum.
        return lambda cond: (
            f"(SELECT round(sqrt(sum({w} * ({c} - m) * ({c} - m)) / sum({w}) * count(*) / (count(*) - 1)), 6) "
            f"FROM (SELECT {w}, {c}, sum({w} * {c}) OVER () / sum({w}) OVER () AS m "
            f"FROM analytic WHERE {cond} AND {c} IS NOT NULL))"
        )

    def share(c, v):
        known = "" if published else f" AND {c} IS NOT NULL"
        return lambda cond: (
            f"round(100e0 * sum(CASE WHEN {cond} AND {c} = {v} THEN {w} ELSE 0 END) / "
            f"sum(CASE WHEN {cond}{known} THEN {w} END), 6)"
        )

    lines = [
        "SELECT 0 AS position, 'N' AS variable, 'count' AS kind, "
        + columns(lambda cond: f"CAST(count(CASE WHEN {cond} THEN 1 END) AS DOUBLE)")
        + " FROM analytic"
    ]
    position = 0
    for c, label in means:
        position += 1
        lines.append(
            f"SELECT {position}, '{label}', 'mean', {columns(mean(c), spread(c))} FROM analytic"
        )
    for c, v, label in shares:
        position += 1
        lines.append(f"SELECT {position}, '{label}', 'share', {columns(share(c, v))} FROM analytic")
    return (PUB if published else ANALYTIC) + "\nUNION ALL ".join(lines)


def _texts(stratum: str) -> str:
    """A number of Table 1 as text: 1,234 or 27.3 or 12.3% or a dash."""
    fixed = f"printf('%.1f', round(CAST({stratum} AS DECIMAL(30, 6)), 1))"
    return (
        f"COALESCE(CASE kind WHEN 'count' THEN format('{{:,}}', CAST({stratum} AS BIGINT)) "
        f"WHEN 'mean' THEN {fixed} ELSE {fixed} || '%' END, '—') AS {stratum}"
    )


def _availability() -> str:
    columns = ("SLEPTIM1", "BPHIGH6", "CHCKDNY2", "DIABETE4", "GENHLTH", "PA1MIN_")
    parts = []
    for c in columns:
        coded = f"count(CASE WHEN {c} IN ({CODES[c]}) THEN 1 END)" if c in CODES else "0"
        parts.append(
            f"SELECT survey_year, '{c}' AS variable, count(*) AS n, "
            f"count({c}) - {coded} AS answered, CAST({coded} AS BIGINT) AS non_response, "
            f"count(*) - count({c}) AS blank FROM survey GROUP BY survey_year"
        )
    return (
        SURVEY
        + "SELECT *, CASE WHEN answered + non_response = 0 THEN 'not_asked' "
        + "WHEN answered = 0 THEN 'no_answer' ELSE 'answered' END AS status FROM ("
        + "\nUNION ALL ".join(parts)
        + ")"
    )


def _missing_kinds() -> str:
    def kind(c: str) -> str:
        coded = f"WHEN {c} IN ({CODES[c]}) THEN 'non_response' " if c in CODES else ""
        return (
            f"CASE {coded}WHEN {c} IS NOT NULL THEN 'answered' "
            f"WHEN count({c}) OVER (PARTITION BY survey_year) > 0 THEN 'blank' "
            f"ELSE 'not_asked' END AS {c.lower()}_kind"
        )

    columns = ("SLEPTIM1", "BPHIGH6", "CHCKDNY2", "PA1MIN_")
    return f"{SURVEY}SELECT resp_id, survey_year, {', '.join(map(kind, columns))} FROM survey"


def _two_by_two(w: str = "1") -> str:
    """Closed form of a logistic fit on one binary predictor, from its 2x2 table."""
    return (
        ANALYTIC
        + f""", cell AS (
  SELECT CAST(sum({w} * flag_diabetes * flag_obese) AS DOUBLE) AS a,
         CAST(sum({w} * (1 - flag_diabetes) * flag_obese) AS DOUBLE) AS b,
         CAST(sum({w} * flag_diabetes * (1 - flag_obese)) AS DOUBLE) AS c,
         CAST(sum({w} * (1 - flag_diabetes) * (1 - flag_obese)) AS DOUBLE) AS d
  FROM analytic WHERE flag_diabetes IS NOT NULL AND flag_obese IS NOT NULL),
est AS (
  SELECT 0 AS position, 'const' AS variable, ln(c / d) AS coefficient,
         sqrt(1 / c + 1 / d) AS se FROM cell
  UNION ALL
  SELECT 1, 'flag_obese', ln(a * d / (b * c)), sqrt(1 / a + 1 / b + 1 / c + 1 / d) FROM cell)
"""
    )


def _logit_2x2() -> str:
    return (
        _two_by_two()
        + """
SELECT position, variable, round(coefficient, 4) AS coefficient, round(se, 4) AS se,
  round(exp(coefficient), 4) AS odds_ratio,
  round(exp(coefficient - 1.959963984540054 * se), 4) AS ci_lower,
  round(exp(coefficient + 1.959963984540054 * se), 4) AS ci_upper,
  round(coefficient / se, 4) AS z,
  CASE WHEN abs(coefficient / se) > 3.290526731491925 THEN '***'
       WHEN abs(coefficient / se) > 2.575829303548901 THEN '**'
       WHEN abs(coefficient / se) > 1.959963984540054 THEN '*' ELSE '' END AS significance,
  CASE WHEN position = 1 THEN CASE WHEN coefficient > 0 THEN 'increases' ELSE 'decreases' END END
    AS direction,
  CASE WHEN position = 1 THEN round(abs(exp(coefficient) - 1) * 100, 4) END AS odds_change_pct
FROM est"""
    )


def _logit_newton(
    with_: str, source: str, outcome: str, one: str, two: str, steps: int = 12
) -> str:
    """Newton's method on a constant and two features, one CTE per step."""
    ctes = [
        f"""data AS (SELECT CAST(y AS DOUBLE) AS y, x1, x2
  FROM (SELECT {outcome} AS y, {one} AS x1, {two} AS x2 FROM {source})
  WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL)""",
        "b0 AS (SELECT 0e0 AS c0, 0e0 AS c1, 0e0 AS c2)",
    ]
    for k in range(steps + 1):
        ctes.append(
            f"""s{k} AS (SELECT c0, c1, c2, count(*) AS n,
    sum(y - p) AS g0, sum((y - p) * x1) AS g1, sum((y - p) * x2) AS g2,
    sum(w) AS h00, sum(w * x1) AS h01, sum(w * x2) AS h02,
    sum(w * x1 * x1) AS h11, sum(w * x1 * x2) AS h12, sum(w * x2 * x2) AS h22,
    sum(y * ln(p) + (1 - y) * ln(1 - p)) AS ll
  FROM (SELECT *, p * (1 - p) AS w FROM (
    SELECT *, 1 / (1 + exp(-(c0 + c1 * x1 + c2 * x2))) AS p FROM data CROSS JOIN b{k}))
  GROUP BY c0, c1, c2),
i{k} AS (SELECT *,
    (h11 * h22 - h12 * h12) / d AS v00, (h02 * h12 - h01 * h22) / d AS v01,
    (h01 * h12 - h02 * h11) / d AS v02, (h00 * h22 - h02 * h02) / d AS v11,
    (h01 * h02 - h00 * h12) / d AS v12, (h00 * h11 - h01 * h01) / d AS v22
  FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02)
                  + h02 * (h01 * h12 - h11 * h02) AS d FROM s{k})),
b{k + 1} AS (SELECT c0 + v00 * g0 + v01 * g1 + v02 * g2 AS c0,
    c1 + v01 * g0 + v11 * g1 + v12 * g2 AS c1, c2 + v02 * g0 + v12 * g1 + v22 * g2 AS c2
  FROM i{k})"""
        )
    last = f"i{steps}"
    lines = "\nUNION ALL ".join(
        f"SELECT {i} AS position, '{name}' AS variable, round(c{i}, 6) AS coefficient, "
        f"round(sqrt(v{i}{i}), 6) AS se, round(exp(c{i}), 6) AS odds_ratio, "
        f"round(exp(c{i} - 1.959963984540054 * sqrt(v{i}{i})), 6) AS ci_lower, "
        f"round(exp(c{i} + 1.959963984540054 * sqrt(v{i}{i})), 6) AS ci_upper, "
        f"round(c{i} / sqrt(v{i}{i}), 4) AS z, n, round(ll, 4) AS log_likelihood FROM {last}"
        for i, name in enumerate(("const", one, two))
    )
    return with_ + ",\n".join(ctes) + "\n" + lines


def _fit_summary() -> str:
    return (
        ANALYTIC
        + """, cell AS (
  SELECT flag_obese AS x, CAST(sum(flag_diabetes) AS DOUBLE) AS yes,
         CAST(count(*) AS DOUBLE) AS n
  FROM analytic WHERE flag_diabetes IS NOT NULL AND flag_obese IS NOT NULL GROUP BY flag_obese),
ll AS (SELECT sum(yes * ln(yes / n) + (n - yes) * ln(1 - yes / n)) AS fitted,
              sum(yes) AS yes, sum(n) AS n FROM cell),
both_ll AS (SELECT n, fitted, yes * ln(yes / n) + (n - yes) * ln(1 - yes / n) AS base FROM ll)
SELECT CAST(n AS BIGINT) AS n, TRUE AS converged, round(fitted, 4) AS log_likelihood,
  round(base, 4) AS null_log_likelihood, round(1 - fitted / base, 6) AS pseudo_r2 FROM both_ll"""
    )


def _auc() -> str:
    return (
        ANALYTIC
        + """, scored AS (
  SELECT flag_diabetes AS y, rank() OVER (ORDER BY bmi)
         + (count(*) OVER (PARTITION BY bmi) - 1) / 2e0 AS mid_rank
  FROM analytic WHERE flag_diabetes IS NOT NULL AND bmi IS NOT NULL),
sums AS (SELECT CAST(sum(y) AS DOUBLE) AS n1, CAST(sum(1 - y) AS DOUBLE) AS n0,
                sum(CASE WHEN y = 1 THEN mid_rank END) AS r FROM scored)
SELECT round((r - n1 * (n1 + 1) / 2) / (n1 * n0), 8) AS auc FROM sums"""
    )


STANDARDISED = ("_AGE80", "bmi", "gen_health", "mental_hlth_days")


def _standardise() -> str:
    complete = " AND ".join(f"{c} IS NOT NULL" for c in STANDARDISED)
    z = ", ".join(
        f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c.lower().strip('_')}_z"
        for c in STANDARDISED
    )
    return f"{ANALYTIC}SELECT resp_id, {z} FROM analytic WHERE {complete}"


def _quantiles() -> str:
    probs = (0, 0.05, 0.25, 0.5, 0.75, 0.95, 1)
    at = ", ".join(f"round(quantile_cont({{c}}, {p}), 6) AS p{100 * p:g}" for p in probs)
    parts = [
        f"SELECT survey_year, '{c}' AS variable, count({c}) AS known, {at.format(c=c)} "
        f"FROM analytic WHERE {c} IS NOT NULL GROUP BY survey_year"
        for c in ("sleep_hrs", "pa_min_week")
    ]
    return ANALYTIC + "\nUNION ALL ".join(parts)


INFERENCE = (
    "flag_diabetes", "log_pa_min", "meets_pa_guidelines", "pa_any", "lifestyle_score", "bmi",
    "flag_obese", "_AGE80", "female", "mental_hlth_days", "flag_mental_burden", "flag_chd",
    "gen_health", "years_since_1995",
)


def _complete_cases() -> str:
    known = " AND ".join(f"{c} IS NOT NULL" for c in INFERENCE)
    return (
        f"{ANALYTIC}SELECT count(*) AS n, CAST(sum(flag_diabetes) AS BIGINT) AS yes, "
        f"CAST(sum(lifestyle_score) AS BIGINT) AS score_sum, round(sum(bmi), 2) AS bmi_sum "
        f"FROM analytic WHERE {known}"
    )


BY_STATE = (
    ANALYTIC
    + f""", by_state AS (
  SELECT c_nationkey AS state, count(*) AS n, {DIABETES}, {OBESITY}
  FROM analytic LEFT JOIN customer ON c_custkey = household GROUP BY c_nationkey)"""
)

MEASURES = ("bmi", "sleep_hrs", "pa_min_week")


def _ranks() -> str:
    """Every quantile is within the error its sketch promises; null where nothing is known."""
    parts = [
        f"SELECT survey_year, '{c}' AS variable, count({c}) AS known, p, "
        f"CASE WHEN count({c}) > 0 THEN TRUE END AS within "
        f"FROM analytic, (SELECT unnest([0.05e0, 0.5e0, 0.95e0]) AS p) GROUP BY survey_year, p"
        for c in MEASURES
    ]
    return ANALYTIC + "\nUNION ALL ".join(parts)


def _weighted_quantiles() -> str:
    probs = (0, 0.05, 0.25, 0.5, 0.75, 0.95, 1)
    at = ", ".join(f"min(CASE WHEN up_to >= {p}e0 * whole THEN x END) AS p{100 * p:g}" for p in probs)
    parts = [
        f"SELECT survey_year, '{c}' AS variable, count(*) AS known, {at} FROM (SELECT survey_year, "
        f"{c} AS x, sum(_LLCPWT) OVER (PARTITION BY survey_year ORDER BY {c}) AS up_to, "
        f"sum(_LLCPWT) OVER (PARTITION BY survey_year) AS whole FROM analytic WHERE {c} IS NOT NULL) "
        "GROUP BY survey_year"
        for c in MEASURES
    ]
    return ANALYTIC + "\nUNION ALL ".join(parts)


def _robust() -> str:
    """Sandwich errors of the weighted 2x2 fit: each group's log-odds has the variance of a
    ratio estimator, the sum of squared weighted residuals over the squared information."""
    return (
        ANALYTIC
        + """, cases AS (
  SELECT flag_obese AS x, flag_diabetes AS y, _LLCPWT AS w FROM analytic
  WHERE flag_diabetes IS NOT NULL AND flag_obese IS NOT NULL),
rates AS (SELECT x, sum(w * y) / sum(w) AS p, sum(w) AS total FROM cases GROUP BY x),
parts AS (
  SELECT x, any_value(ln(p / (1 - p))) AS odds,
    sum(w * w * (y - p) * (y - p)) / any_value(total * p * (1 - p) * total * p * (1 - p)) AS v
  FROM cases JOIN rates USING (x) GROUP BY x),
est AS (
  SELECT 0 AS position, 'const' AS variable, odds AS coefficient, sqrt(v) AS se FROM parts WHERE x = 0
  UNION ALL
  SELECT 1, 'flag_obese', max(CASE WHEN x = 1 THEN odds END) - max(CASE WHEN x = 0 THEN odds END),
    sqrt(sum(v)) FROM parts)
SELECT position, variable, round(coefficient, 5) AS coefficient, round(se, 5) AS se,
  round(exp(coefficient - 1.959963984540054 * se), 5) AS ci_lower,
  round(exp(coefficient + 1.959963984540054 * se), 5) AS ci_upper FROM est"""
    )


def _scores() -> str:
    known = " AND ".join(f"{c} IS NOT NULL" for c in INFERENCE)
    return ANALYTIC + "\nUNION ALL ".join(
        f"SELECT '{c}' AS variable, round(CAST(sum(flag_diabetes * {x}) AS DOUBLE), 3) AS expected "
        f"FROM analytic WHERE {known}"
        for c, x in (("const", "1"), *((c, c) for c in INFERENCE[1:]))
    )


def _stump() -> str:
    """The best of three splits by its Gini gain over the training rows, and how the two leaves
    rank and judge the test rows."""
    names = ("flag_diabetes", "female", "pa_any")
    each = "\n  UNION ALL ".join(
        f"SELECT '{c}' AS variable, {c} AS x, y, training FROM cases" for c in names
    )
    known = " AND ".join(f"{c} IS NOT NULL" for c in ("flag_obese", *names))
    return (
        ANALYTIC
        + f""", cases AS (
  SELECT *, flag_obese AS y, CAST('0x' || substr(md5(CAST(resp_id AS VARCHAR) || '20260301'), 1, 8)
    AS BIGINT) % 100 < 80 AS training FROM analytic WHERE {known}),
long AS ({each}),
leaves AS (
  SELECT variable, x, CAST(count(*) FILTER (training) AS DOUBLE) AS n,
    CAST(count(*) FILTER (training AND y = 1) AS DOUBLE) AS n1,
    CAST(count(*) FILTER (NOT training AND y = 1) AS DOUBLE) AS t1,
    CAST(count(*) FILTER (NOT training AND y = 0) AS DOUBLE) AS t0
  FROM long GROUP BY variable, x),
gains AS (  -- the parent's impurity is the same for all
  SELECT variable, -sum(2 * n1 * (n - n1) / n) AS gain FROM leaves GROUP BY variable),
best AS (SELECT variable FROM gains ORDER BY gain DESC LIMIT 1),
ends AS (
  SELECT *, n1 / n AS p, sum(t1) OVER () AS all1, sum(t0) OVER () AS all0
  FROM leaves JOIN best USING (variable)),
judged AS (
  SELECT sum(a.t1 * b.t0 * CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5 ELSE 0 END)
      / any_value(a.all1 * a.all0) AS auc FROM ends a, ends b),
right_ AS (
  SELECT sum(CASE WHEN p > 0.5 THEN t1 ELSE t0 END) / any_value(all1 + all0) AS accuracy FROM ends),
sizes AS (SELECT count(*) FILTER (training) AS n_train, count(*) FILTER (NOT training) AS n_test FROM cases)
SELECT g.variable, CASE WHEN g.variable = best.variable THEN 1e0 ELSE 0e0 END AS importance,
  n_train, n_test, n_train AS train_used, n_test AS test_used, round(auc, 8) AS auc,
  round(accuracy, 8) AS accuracy
FROM gains g, best, judged, right_, sizes"""
    )


def _auc_2x2() -> str:
    """Of pairs with and without the outcome: those ranked by the flag, and half of the ties."""
    return (
        ANALYTIC
        + """, cell AS (
  SELECT CAST(count(*) FILTER (y = 1 AND x = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (y = 0 AND x = 1) AS DOUBLE) AS b,
    CAST(count(*) FILTER (y = 1 AND x = 0) AS DOUBLE) AS c, CAST(count(*) FILTER (y = 0 AND x = 0) AS DOUBLE) AS d
  FROM (SELECT flag_diabetes AS y, flag_obese AS x FROM analytic))
SELECT round((CASE WHEN a * d > b * c THEN a * d ELSE b * c END + (a * b + c * d) / 2) / ((a + c) * (b + d)), 8) AS auc
FROM cell"""
    )


def _stage_counts() -> str:
    forest = " AND ".join(f"{c} IS NOT NULL" for c in FOREST_REQUIRED)
    cases = " AND ".join(f"{c} IS NOT NULL" for c in INFERENCE)
    counts = {
        "loaded": "TRUE", "analytic": "TRUE", "outcome_known": "flag_diabetes IS NOT NULL",
        "complete_cases": cases, "forest_cases": forest,
    }
    return ANALYTIC + "\nUNION ALL ".join(
        f"SELECT '{name}' AS stage, count(*) AS n FROM analytic WHERE {cond}" for name, cond in counts.items()
    )


def _state_names() -> str:
    return "names(code, state_name) AS (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in STATE_NAMES.items()) + ")"


ORACLES: dict[str, str] = {
    # scans and sinks
    "q_union_years": f"""{SURVEY}SELECT resp_id, survey_year, IYEAR AS iyear, SEXVAR AS sexvar,
        _AGE80 AS age80, DIABETE4 AS diabete4, BPHIGH6 AS bphigh6, CHCKDNY2 AS chckdny2,
        SLEPTIM1 AS sleptim1, _RFCHOL3 AS rfchol3, INCOME3 AS income3 FROM survey""",
    "q_scan_export_roundtrip": f"{ANALYTIC}SELECT {EXPORT} FROM analytic",
    "q_csv_roundtrip": f"{ANALYTIC}SELECT survey_year, count(*) AS n, {YEARLY} "
    "FROM analytic GROUP BY survey_year",
    "q_analytic_table": _pick(
        EXPORT + ", disease_burden_n, lifestyle_score_n, female, phys_hlth_days, "
        "round(log_pa_min, 6) AS log_pa_min",
        ANALYTIC,
        "analytic",
    ),
    "q_published_table": _pick(
        EXPORT + ", sex, phys_hlth_days, round(log_pa_min, 6) AS log_pa_min", PUB, "analytic"
    ),
    # cleaning
    "q_cast_nullify": _pick(
        "IYEAR AS iyear, SEXVAR AS sexvar, SLEPTIM1 AS sleptim1, MENTHLTH AS menthlth, "
        "PHYSHLTH AS physhlth, GENHLTH AS genhlth, EDUCA AS educa, INCOME3 AS income3, "
        "SMOKE100 AS smoke100, ALCDAY4 AS alcday4, DIABETE4 AS diabete4, BPHIGH6 AS bphigh6, "
        "CVDCRHD4 AS cvdcrhd4, CHCKDNY2 AS chckdny2, EXERHMM1 AS exerhmm1, PA1MIN_ AS pa1min",
        RAW,
        "raw",
    ),
    "q_nullify_flat_codes": _pick(
        "SEXVAR AS sexvar, SLEPTIM1 AS sleptim1, MENTHLTH AS menthlth, PHYSHLTH AS physhlth, "
        "GENHLTH AS genhlth, EDUCA AS educa, INCOME3 AS income3, SMOKE100 AS smoke100, "
        "ALCDAY4 AS alcday4, DIABETE4 AS diabete4, EXERHMM1 AS exerhmm1, PA1MIN_ AS pa1min",
        PUB_RAW,
        "raw",
    ),
    "q_rescale_guard": _pick("_BMI5 AS bmi5, bmi", CLEANED, "cleaned"),
    "q_range_guards": _pick(
        "sleep_hrs, mental_hlth_days, phys_hlth_days, pa_min_week", CLEANED, "cleaned"
    ),
    "q_reverse_scale": _pick("gen_health", CLEANED, "cleaned"),
    "q_threshold_flags": _pick(
        "meets_pa_guidelines, flag_obese, flag_poor_sleep, flag_mental_burden",
        ANALYTIC,
        "analytic",
    ),
    "q_recode_label": _pick("sex, sex_label, pa_any", CLEANED, "cleaned"),
    "q_age_bands": _pick("age_group", CLEANED, "cleaned"),
    "q_analysis_filter": f"{ANALYTIC}SELECT resp_id, _AGE80 AS age80, flag_diabetes FROM analytic "
    "WHERE _AGE80 >= 21 AND flag_diabetes IS NOT NULL",
    # features
    "q_outcome_flags": _pick("flag_diabetes, flag_htn, flag_chd, flag_ckd", ANALYTIC, "analytic"),
    "q_disease_burden": _pick(
        "disease_burden, disease_burden_n, flag_htn_available", ANALYTIC, "analytic"
    ),
    "q_lifestyle_score": _pick("lifestyle_score, lifestyle_score_n", ANALYTIC, "analytic"),
    "q_bmi_category": _pick("bmi_cat", ANALYTIC, "analytic"),
    "q_log_trend": _pick(
        "round(log_pa_min, 6) AS log_pa_min, years_since_1995", ANALYTIC, "analytic"
    ),
    # summary tables
    "q_overview": f"{ANALYTIC}SELECT count(*) AS n, {_mean('_AGE80', 'mean_age')}, "
    f"{_mean('bmi', 'mean_bmi')}, {_mean('sleep_hrs', 'mean_sleep_hrs')}, "
    f"{_mean('pa_min_week', 'mean_pa_min_wk')}, "
    f"{_mean('mental_hlth_days', 'mean_mental_bad_days')} FROM analytic",
    "q_by_year": f"{SURVEY}SELECT survey_year, count(*) AS n FROM survey GROUP BY survey_year",
    "q_prevalence_overall": f"{ANALYTIC}SELECT count(*) AS n, {DIABETES}, {HTN}, {CKD}, {CHD}, "
    f"{OBESITY} FROM analytic",
    "q_yearly_trend": f"{ANALYTIC}SELECT survey_year, count(*) AS n, {YEARLY} "
    "FROM analytic GROUP BY survey_year",
    "q_by_guideline": _grouped(
        "meets_pa_guidelines", DIABETES, HTN, CKD, OBESITY, _mean("bmi", "mean_bmi"),
        _mean("sleep_hrs", "mean_sleep_hrs"),
    ),
    "q_by_sleep": _grouped("flag_poor_sleep", DIABETES, HTN, CKD, MENTAL),
    "q_by_bmi": _grouped("bmi_cat", DIABETES, HTN, CKD, ANY_PA),
    "q_score_share": _grouped(
        "lifestyle_score", DIABETES, CKD, "100e0 * count(*) / sum(count(*)) OVER () AS share_pct"
    ),
    "q_by_sex": _grouped("sex_label", DIABETES, HTN, CKD, _mean("bmi", "mean_bmi")),
    "q_by_age": _grouped("age_group", DIABETES, HTN, CKD, OBESITY, ANY_PA),
    "q_summaries_one_scan": _stacked_summaries(),
    "q_prevalence_multi": _sets(),
    "q_published_overview": f"""{PUB}SELECT count(*) AS n,
        round(avg(_AGE80), 1) AS mean_age, round(avg(bmi), 1) AS mean_bmi,
        round(avg(sleep_hrs), 1) AS mean_sleep_hrs, round(avg(pa_min_week), 0) AS mean_pa_min_wk,
        round(avg(mental_hlth_days), 1) AS mean_mental_bad_days FROM analytic""",
    "q_published_by_age": _grouped(
        "age_group",
        *(
            f"round(100e0 * sum({c}) / count({c}), 6) AS {n}"
            for c, n in (
                ("flag_diabetes", "diabetes_pct"),
                ("flag_htn", "htn_pct"),
                ("flag_ckd", "ckd_pct"),
                ("flag_obese", "obesity_pct"),
                ("pa_any", "any_pa_pct"),
            )
        ),
        cte=PUB,
    ),
    "q_events_prevalence": """SELECT event_type, count(*) AS n,
        100e0 * sum(CASE WHEN value >= 100 THEN 1 ELSE 0 END) / count(*) AS large_pct,
        round(sum(value) / count(value), 6) AS mean_value FROM events GROUP BY event_type""",
    # Table 1
    "q_table1": _table1(),
    "q_table1_published": _table1(published=True),
    "q_table1_formatted": f"""SELECT variable,
        {_texts("diabetic")}, {_texts("no_diabetes")}, {_texts("overall")}
        FROM ({_table1(published=True)})""",
    "q_table1_weighted": _table1(weighted=True),
    "q_table1_sd": _table1(sd=True),
    "q_table1_weighted_sd": _table1(weighted=True, sd=True),
    # weights, states, distributions, change, ratios, missingness
    "q_weighted_prevalence": f"{ANALYTIC}SELECT survey_year, count(*) AS n, "
    f"sum(_LLCPWT) AS weighted_n, {_wpct('flag_diabetes', 'diabetes_pct')}, "
    f"{_wpct('flag_htn', 'htn_pct')}, {_wpct('flag_obese', 'obesity_pct')}, "
    "round(sum(_LLCPWT * bmi) / sum(CASE WHEN bmi IS NOT NULL THEN _LLCPWT END), 6) AS mean_bmi "
    "FROM analytic GROUP BY survey_year",
    "q_by_state": f"{BY_STATE} SELECT * FROM by_state",
    "q_state_topk": BY_STATE
    + """, ranked AS (
  SELECT *, row_number() OVER (ORDER BY diabetes_pct DESC, state) AS top_rank,
            row_number() OVER (ORDER BY diabetes_pct ASC, state) AS bottom_rank
  FROM by_state WHERE diabetes_pct IS NOT NULL),
ends AS (
  SELECT 'top' AS "end", CAST(top_rank AS INT) AS rank, state, n, diabetes_pct, obesity_pct
  FROM ranked WHERE top_rank <= 10
  UNION ALL
  SELECT 'bottom', CAST(bottom_rank AS INT), state, n, diabetes_pct, obesity_pct
  FROM ranked WHERE bottom_rank <= 10)
SELECT ends.*, n_name AS state_name FROM ends LEFT JOIN nation ON n_nationkey = state""",
    "q_state_ranking": f"""{ANALYTIC}, {_state_names()}, t AS (
  SELECT _STATE, count(*) AS n, {DIABETES}, {OBESITY} FROM analytic GROUP BY _STATE),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY diabetes_pct DESC, _STATE) AS top_rank,
            row_number() OVER (ORDER BY diabetes_pct ASC, _STATE) AS bottom_rank
  FROM t WHERE diabetes_pct IS NOT NULL)
SELECT 'top' AS "end", CAST(top_rank AS INT) AS rank, _STATE, n, diabetes_pct, obesity_pct, state_name
FROM ranked LEFT JOIN names ON code = _STATE WHERE top_rank <= 5
UNION ALL
SELECT 'bottom', CAST(bottom_rank AS INT), _STATE, n, diabetes_pct, obesity_pct, state_name
FROM ranked LEFT JOIN names ON code = _STATE WHERE bottom_rank <= 5""",
    "q_quantiles_approx": _ranks(),
    "q_quantiles_sketched": _ranks(),
    "q_quantiles_weighted": _weighted_quantiles(),
    "q_stage_counts": _stage_counts(),
    "q_asked_features": ANALYTIC + "\nUNION ALL ".join(
        f"SELECT '{c}' AS variable, count({c}) > 0 AS asked FROM analytic" for c in ASKED
    ),
    "q_logit_formatted": _two_by_two() + """
SELECT variable AS "Variable", CASE variable WHEN 'const' THEN 'const' ELSE 'Obese' END AS "Label",
  round(coefficient, 4) AS "Coefficient", round(se, 4) AS "SE", round(exp(coefficient), 4) AS "OR",
  round(exp(coefficient - 1.959963984540054 * se), 4) AS "CI_lower",
  round(exp(coefficient + 1.959963984540054 * se), 4) AS "CI_upper", round(coefficient / se, 3) AS z,
  CASE WHEN abs(coefficient / se) > 4.2 THEN 0e0 END AS p_value,  -- below half of the last digit
  CASE WHEN abs(coefficient / se) > 4.2 THEN '***' END AS "Significance"
FROM est""",
    "q_logit_robust": _robust(),
    "q_logit_scores": _scores(),
    "q_logit_auc_2x2": _auc_2x2(),
    "q_random_split": f"{SURVEY}SELECT resp_id, count(*) AS rows FROM survey GROUP BY resp_id",
    "q_forest_stump": _stump(),
    "q_missing_kinds_nan": f"""{SURVEY}SELECT resp_id, pa1min,
        CASE WHEN sleep IN (77, 99) THEN 'non_response' WHEN sleep IS NOT NULL THEN 'answered'
          WHEN count(sleep) OVER (PARTITION BY survey_year) > 0 THEN 'blank' ELSE 'not_asked' END AS sleptim1_kind,
        CASE WHEN pa1min IS NOT NULL THEN 'answered'
          WHEN count(pa1min) OVER (PARTITION BY survey_year) > 0 THEN 'blank' ELSE 'not_asked' END AS pa1min__kind
        FROM (SELECT resp_id, survey_year, CASE WHEN resp_id % 59 = 0 THEN NULL ELSE PA1MIN_ END AS pa1min,
          CASE WHEN survey_year % 2 = 1 THEN NULL ELSE SLEPTIM1 END AS sleep FROM survey)""",
    "q_distributions": _quantiles(),
    "q_pp_change": f"""{ANALYTIC}, yearly AS (
  SELECT survey_year, count(*) AS n, {DIABETES}, {HTN} FROM analytic GROUP BY survey_year)
SELECT *,
  round(diabetes_pct - first_value(diabetes_pct IGNORE NULLS) OVER w, 6)
    AS diabetes_pct_since_first,
  round(diabetes_pct - last_value(diabetes_pct IGNORE NULLS) OVER before, 6)
    AS diabetes_pct_since_last,
  round(htn_pct - first_value(htn_pct IGNORE NULLS) OVER w, 6) AS htn_pct_since_first,
  round(htn_pct - last_value(htn_pct IGNORE NULLS) OVER before, 6) AS htn_pct_since_last
FROM yearly
WINDOW w AS (ORDER BY survey_year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
  before AS (ORDER BY survey_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "q_prevalence_ratio": f"""{ANALYTIC}, t AS (
  SELECT bmi_cat, count(*) AS n, {DIABETES} FROM analytic GROUP BY bmi_cat)
SELECT *, diabetes_pct / (SELECT diabetes_pct FROM t WHERE bmi_cat = 'Normal')
  AS diabetes_pct_ratio FROM t""",
    "q_availability": _availability(),
    "q_missing_kinds": _missing_kinds(),
    # models
    "q_complete_cases": _complete_cases(),
    "q_logit_2x2": _logit_2x2(),
    "q_logit_two_features": _logit_newton(
        ANALYTIC + ", ", "analytic", "flag_diabetes", "_AGE80", "bmi"
    ),
    "q_logit_documents": _logit_newton(
        """WITH rated AS (SELECT quality, ln(1 + n_chars) AS log_chars, toxic
  FROM labels JOIN documents USING (doc_id)), """,
        "rated",
        "quality",
        "log_chars",
        "toxic",
    ),
    "q_logit_weighted": _two_by_two("_LLCPWT")
    + "SELECT position, variable, round(coefficient, 4) AS coefficient, round(se, 4) AS se, "
    "round(exp(coefficient), 4) AS odds_ratio FROM est",
    "q_fit_summary": _fit_summary(),
    "q_hash_split": SURVEY
    + """SELECT resp_id,
  CAST('0x' || substr(md5(CAST(resp_id AS VARCHAR) || '20260301'), 1, 8) AS BIGINT) % 100 < 80
    AS in_training FROM survey""",
    "q_standardise": _standardise(),
    "q_auc": _auc(),
    "q_accuracy": f"""{ANALYTIC}SELECT round(avg(CASE WHEN flag_diabetes = flag_obese THEN 1e0
        ELSE 0e0 END), 8) AS accuracy, count(*) AS n FROM analytic
        WHERE flag_diabetes IS NOT NULL AND flag_obese IS NOT NULL""",
}
