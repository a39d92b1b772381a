"""Prevalence tables: hand-made cases and properties."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalog.survey_view import SPEC
from cohortkit.operators import tabulate as P
from cohortkit.operators.stages import MissingColumnsError

ROWS = [
    ("a", 1, 10.0, 1.0, 2017),
    ("a", 0, None, 3.0, 2017),
    ("a", None, 30.0, 2.0, 2018),
    ("b", None, 5.0, 4.0, 2018),
    (None, 1, 1.0, 1.0, 2019),
]
SCHEMA = "g string, f int, x double, w double, y int"


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def as_dict(table, *key):
    return {tuple(r[k] for k in key): r for r in table.collect()}


def test_nulls_leave_the_denominator(df):
    t = as_dict(P.prevalence(df, ["g"], {"pct": "f"}, {"mean": "x"}), "g")
    assert (t["a",].n, t["a",].pct, t["a",].mean) == (3, 50.0, 20.0)
    assert t["b",].pct is None  # nobody asked: null, not 0 %
    assert (t[None,].n, t[None,].pct) == (1, 100.0)  # a null key is its own group


def test_share_and_digits(df):
    t = as_dict(P.prevalence(df, ["g"], {"pct": "f"}, share="share", digits=1), "g")
    assert [t[k].share for k in (("a",), ("b",), (None,))] == [60.0, 20.0, 20.0]


def test_no_key(df):
    r = P.prevalence(df, flags={"pct": "f"}, means={"m": "x"}).head()
    assert r.n == 5 and r.pct == pytest.approx(200 / 3) and r.m == 11.5


def test_empty_table(spark, df):
    r = P.prevalence(df.limit(0), flags={"pct": "f"}).head()
    assert (r.n, r.pct) == (0, None)


def test_weights(df):
    t = as_dict(P.prevalence(df, ["g"], {"pct": "f"}, {"mean": "x"}, weight="w"), "g")
    assert t["a",].weighted_n == 6.0
    assert t["a",].pct == 25.0  # 1 / (1 + 3)
    assert t["a",].mean == pytest.approx((10 + 60) / 3)


def test_weights_of_one_change_nothing(df):
    ones = df.withColumn("w", F.lit(1.0))
    plain = P.prevalence(ones, ["g"], {"pct": "f"}, {"mean": "x"})
    weighted = P.prevalence(ones, ["g"], {"pct": "f"}, {"mean": "x"}, weight="w")
    assert plain.collect() == weighted.drop("weighted_n").collect()


def test_keys_may_have_any_name(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0)], "rows string, weight int")
    r = P.prevalence(df, ["rows"], {"pct": "weight"}, share="share").head()
    assert (r["rows"], r.n, r.pct, r.share) == ("a", 2, 50.0, 100.0)


def test_absent_columns_are_named(df):
    with pytest.raises(MissingColumnsError, match="nope"):
        P.prevalence(df, ["g"], {"pct": "nope"})


def test_tables_from_cells_equal_direct_tables(respondents):
    """Every summary, merged from the one-scan cells, is the table of its own scan."""
    specs = SPEC.report.summaries
    merged = P.summaries(P.summary_cells(respondents, specs), specs)
    assert list(merged) == [s.name for s in specs]
    for s in specs:
        direct = P.summary(respondents, s).toPandas()
        got = merged[s.name].toPandas()
        assert list(direct.columns) == list(got.columns), s.name
        numbers = direct.select_dtypes("number").columns
        assert got[numbers].round(9).equals(direct[numbers].round(9)), s.name


def test_weighted_cells_equal_direct_tables(respondents):
    specs = [s for s in SPEC.report.summaries if s.name in ("yearly_trend", "score_share")]
    merged = P.summaries(P.summary_cells(respondents, specs, "_LLCPWT"), specs, "_LLCPWT")
    for s in specs:
        direct = P.summary(respondents, s, "_LLCPWT").toPandas().round(9)
        assert merged[s.name].toPandas().round(9).equals(direct)


def test_group_sizes_and_shares_add_up(respondents):
    t = P.prevalence(respondents, ["bmi_cat"], share="share").toPandas()
    assert t.n.sum() == respondents.count()
    assert t.share.sum() == pytest.approx(100)


def test_sets_split_null_levels_from_other_sets(df):
    t = P.prevalence_sets(df, ["g", "y"], {"pct": "f"}).collect()
    got = {(r.dimension, r.level): r.n for r in t}
    assert got == {
        ("g", "a"): 3, ("g", "b"): 1, ("g", None): 1,
        ("y", "2017"): 2, ("y", "2018"): 2, ("y", "2019"): 1,
    }


def test_change_over_time_skips_unknown_years(spark):
    rows = [(2017, 10.0), (2018, None), (2019, 13.0), (2020, 12.0)]
    t = spark.createDataFrame(rows, "survey_year int, p double")
    got = P.change_over_time(t, ["p"]).orderBy("survey_year").collect()
    assert [r.p_since_first for r in got] == [0.0, None, 3.0, 2.0]
    assert [r.p_since_last for r in got] == [None, None, 3.0, -1.0]


def test_change_over_time_by_group(spark):
    rows = [("a", 2017, 1.0), ("a", 2018, 4.0), ("b", 2018, 9.0)]
    t = spark.createDataFrame(rows, "g string, survey_year int, p double")
    got = as_dict(P.change_over_time(t, ["p"], by=["g"]), "g", "survey_year")
    assert got["a", 2018].p_since_first == 3.0
    assert got["b", 2018].p_since_first == 0.0


def test_ratio_to_reference(spark):
    t = spark.createDataFrame([("n", 7.3), ("o", 23.5), ("u", None)], "g string, p double")
    got = as_dict(P.ratio_to(t, "g", "n", ["p"]), "g")
    assert got["o",].p_ratio == pytest.approx(23.5 / 7.3)
    assert got["n",].p_ratio == 1.0 and got["u",].p_ratio is None


def test_extremes_break_ties_by_key(spark):
    rows = [(1, 5.0), (2, 5.0), (3, 1.0), (4, None), (5, 9.0)]
    t = spark.createDataFrame(rows, "s int, p double")
    got = [(r.end, r["rank"], r.s) for r in P.extremes(t, "s", "p", 2).collect()]
    assert sorted(got) == [("bottom", 1, 3), ("bottom", 2, 1), ("top", 1, 5), ("top", 2, 1)]


def test_label_lookup_keeps_unknown_codes(spark):
    t = spark.createDataFrame([(1.0,), (9.0,), (None,)], "s double")
    codes = spark.createDataFrame([(1, "one"), (2, "two")], "k int, name string")
    got = {r.s: r.label for r in P.with_label(t, codes, "s", "k", "name", "label").collect()}
    assert got == {1.0: "one", 9.0: None, None: None}


def test_one_group_holding_most_rows(spark):
    """A third of all rows under one key: its rows are combined before the shuffle."""
    df = spark.range(0, 30_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("g"),
        (F.col("id") % 2).cast("int").alias("f"),
    )
    t = as_dict(P.prevalence(df, ["g"], {"pct": "f"}).filter("g = 0"), "g")
    assert (t[0,].n, t[0,].pct) == (10_000, 50.0)


value = st.one_of(st.none(), st.sampled_from([0, 1]))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    rows=st.lists(st.tuples(st.sampled_from("abc"), value, value), min_size=1, max_size=40),
    parts=st.integers(1, 7),
)
def test_any_order_and_partitioning_give_the_same_table(spark, rows, parts):
    df = spark.createDataFrame(rows, "g string, f int, h int")
    one = P.prevalence(df.coalesce(1), ["g"], {"f": "f", "h": "h"}).collect()
    many = P.prevalence(df.repartition(parts), ["g"], {"f": "f", "h": "h"}).collect()
    assert one == many
    for r in one:
        known = [f for g, f, _ in rows if g == r.g and f is not None]
        assert r.n == sum(g == r.g for g, _, _ in rows)
        assert r.f == (100.0 * sum(known) / len(known) if known else None)


def test_flags_and_scores_stay_in_range(respondents):
    flags = [c for c in respondents.columns if c.startswith("flag_")]
    bad = respondents.filter(
        " OR ".join(f"{c} NOT IN (0, 1)" for c in flags)
        + " OR disease_burden NOT BETWEEN 0 AND 4 OR lifestyle_score NOT BETWEEN 0 AND 4"
        + " OR disease_burden > disease_burden_n OR lifestyle_score > lifestyle_score_n"
    )
    assert bad.isEmpty()
