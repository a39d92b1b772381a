"""A health-survey table derived from the orders table.

One respondent per order.  The same text runs in Spark SQL and in DuckDB, in integer
arithmetic only.  It holds every kind of missing data: non-response codes, values out
of range, blanks, and questions not asked in some years (sleep in odd years, blood
pressure in even years, kidney disease in 1995).

A respondent's household is the order's customer, its home state that customer's nation.
Only queries by home state join the customers; the others read one table and never
shuffle a row.  (``_STATE`` is a bare code, as survey files carry one.)
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.health_survey import COLUMNS, default_spec, published_spec
from cohortkit.session import tune
from cohortkit.spec import SurveySpec

YEARS = tuple(range(1995, 2002))

BASE = (
    "o_orderkey AS k",
    "o_custkey AS ck",
    "CAST(year(o_orderdate) AS INT) AS yr",
    "CAST(floor(o_totalprice) AS BIGINT) AS tp",
)

RESPONDENT = {
    "resp_id": "k",
    "survey_year": "yr",
    "IYEAR": "CASE WHEN k % 101 = 0 THEN 'x' WHEN k % 103 = 0 THEN '' "
    "ELSE CAST(yr AS STRING) END",
    "_STATE": "CAST(1 + ck % 56 AS DOUBLE)",
    "SEXVAR": "CAST(CASE WHEN k % 50 = 49 THEN 9 WHEN k % 10 < 5 THEN 1 ELSE 2 END AS DOUBLE)",
    "_AGE80": "CAST(CASE WHEN k % 41 = 0 THEN NULL ELSE 18 + (ck * 13 + k) % 63 END AS DOUBLE)",
    "_IMPRACE": "CAST(1 + ck % 6 AS DOUBLE)",
    "EDUCA": "CAST(CASE WHEN k % 63 = 0 THEN 9 ELSE 1 + k % 6 END AS DOUBLE)",
    "INCOME3": "CAST(CASE WHEN k % 21 = 0 THEN 77 WHEN k % 39 = 0 THEN 99 "
    "ELSE 1 + k % 11 END AS DOUBLE)",
    "_TOTINDA": "CAST(CASE WHEN k % 67 = 0 THEN 9 WHEN tp % 4 = 0 THEN 2 ELSE 1 END AS DOUBLE)",
    "PA1MIN_": "CAST(CASE WHEN k % 23 = 0 THEN NULL WHEN k % 61 = 0 THEN 20000 "
    "ELSE (tp * 3) % 900 END AS DOUBLE)",
    "SLEPTIM1": "CAST(CASE WHEN yr % 2 = 1 THEN NULL WHEN k % 29 = 0 THEN 77 "
    "WHEN k % 31 = 0 THEN 99 ELSE 4 + k % 7 END AS DOUBLE)",
    "MENTHLTH": "CAST(CASE WHEN k % 37 = 0 THEN 77 WHEN k % 43 = 0 THEN 99 WHEN k % 19 = 0 THEN 88 "
    "ELSE (k * 11) % 31 END AS DOUBLE)",
    "PHYSHLTH": "CAST(CASE WHEN k % 33 = 0 THEN 31 WHEN k % 57 = 0 THEN 99 WHEN k % 17 = 0 THEN 88 "
    "ELSE (k * 13) % 31 END AS DOUBLE)",
    "GENHLTH": "CAST(CASE WHEN k % 47 = 0 THEN 7 WHEN k % 59 = 0 THEN 9 "
    "ELSE 1 + (k + ck) % 5 END AS DOUBLE)",
    "_BMI5": "CAST(CASE WHEN k % 53 = 0 THEN 9999 ELSE 1500 + tp % 3000 END AS DOUBLE)",
    "_BMI5CAT": "CAST(1 + tp % 4 AS DOUBLE)",
    "DIABETE4": "CAST(CASE WHEN k % 73 = 0 THEN 9 "
    "WHEN (tp % 3000) + ((ck * 13 + k) % 63) * 40 + (k * 7919) % 3000 > 5600 THEN 1 "
    "WHEN k % 97 = 0 THEN 2 WHEN k % 83 = 0 THEN 4 ELSE 3 END AS DOUBLE)",
    "BPHIGH6": "CAST(CASE WHEN yr % 2 = 0 THEN NULL WHEN k % 79 = 0 THEN 7 "
    "WHEN (k * 31 + ck) % 5 < 2 THEN 1 ELSE 2 END AS DOUBLE)",
    "CVDCRHD4": "CAST(CASE WHEN k % 89 = 0 THEN 7 WHEN (k * 101 + ck) % 17 = 0 THEN 1 "
    "ELSE 2 END AS DOUBLE)",
    "CHCKDNY2": "CAST(CASE WHEN yr = 1995 THEN NULL WHEN (k * 103 + ck) % 27 = 0 THEN 1 "
    "ELSE 2 END AS DOUBLE)",
    "_RFCHOL3": "CAST(CASE WHEN k % 5 = 0 THEN NULL ELSE 1 + k % 2 END AS DOUBLE)",
    "SMOKE100": "CAST(CASE WHEN k % 71 = 0 THEN 7 WHEN ck % 3 = 0 THEN 1 ELSE 2 END AS DOUBLE)",
    "ALCDAY4": "CAST(CASE WHEN k % 27 = 0 THEN 777 WHEN k % 51 = 0 THEN 999 "
    "ELSE 101 + k % 7 END AS DOUBLE)",
    "EXERHMM1": "CAST(CASE WHEN k % 69 = 0 THEN 777 ELSE 1 + (k * 7) % 300 END AS DOUBLE)",
    "_LLCPWT": "CAST(1 + (k * 17) % 97 AS DOUBLE)",
}

SURVEY_CTE = (
    f"b AS (SELECT {', '.join(BASE)} FROM orders),\nsurvey AS (\n  SELECT ck AS household,\n"
    + ",\n".join(f"    {text} AS {name}" for name, text in RESPONDENT.items())
    + "\n  FROM b)"
)


def _adapted(spec: SurveySpec) -> SurveySpec:
    ids = ("resp_id", "household")
    return replace(
        spec,
        source=replace(
            spec.source,
            years=(*YEARS, 2002),
            columns=("resp_id", *COLUMNS),
            types={"resp_id": "bigint", "IYEAR": "string"},
        ),
        clean=replace(spec.clean, keep_as_is=(*ids, *spec.clean.keep_as_is)),
    )


SPEC = _adapted(default_spec(base_year=YEARS[0]))
PUBLISHED = _adapted(published_spec(base_year=YEARS[0]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw respondents, codes and all."""
    base = table(tune(spark), sf_dir, "orders").selectExpr(*BASE)
    return base.selectExpr(
        "ck AS household", *(f"{text} AS {name}" for name, text in RESPONDENT.items())
    )


def with_state(households: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add ``state`` by ``household``.  No hint: Spark broadcasts the customers only
    while their measured size allows."""
    homes = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("household"), F.col("c_nationkey").alias("state")
    )
    return households.join(homes, "household", "left")
