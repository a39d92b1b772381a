"""Yearly files: aliases, absent columns, absent years, formats, pruning."""

from __future__ import annotations

import logging
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from catalog.queries import yearly_files
from catalog.survey_view import SPEC, survey
from cohortkit import sinks
from cohortkit.sources.yearly import load_years, resolve
from cohortkit.spec import SourceSpec


def spec(path, **changes):
    values = {
        "years": (2017, 2018, 2019),
        "path": f"{path}/{{year}}",
        "columns": ("A", "B", "C", "T"),
        "aliases": {"A": ("A", "A_OLD", "A_OLDEST"), "B": ("B", "B1")},
        "types": {"T": "string"},
    }
    return SourceSpec(**{**values, **changes})


def write(spark, path, rows, schema, fmt="parquet"):
    spark.createDataFrame(rows, schema).write.format(fmt).option("header", True).save(str(path))


@pytest.fixture
def files(spark, tmp_path):
    write(spark, tmp_path / "2017", [(1.0, "5", "x", 9)], "A_OLDEST double, B1 string, T string, Z int")
    write(spark, tmp_path / "2018", [(2, 6.0, 8.0), (2, 6.0, 8.0)], "A int, B double, A_OLD double")
    return tmp_path


def test_resolve_takes_first_alias_in_schema():
    s = spec("")
    assert resolve(["A_OLD", "A_OLDEST", "X"], "A", s) == "A_OLD"
    assert resolve(["A", "A_OLD"], "A", s) == "A"
    assert resolve(["X"], "A", s) is None
    assert resolve(["C"], "C", s) == "C"


def test_union_keeps_duplicates_fills_absent_and_tags_year(spark, files, caplog):
    with caplog.at_level(logging.WARNING):
        df = load_years(spark, spec(files))
    assert "2019" in caplog.text
    assert df.columns == ["A", "B", "C", "T", "survey_year"]
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == [
        (1.0, 5.0, None, "x", 2017),
        (2.0, 6.0, None, None, 2018),
        (2.0, 6.0, None, None, 2018),
    ]


def test_no_files_at_all_is_an_error(spark, tmp_path):
    with pytest.raises(RuntimeError, match="no survey files"):
        load_years(spark, spec(tmp_path))


def test_bad_text_in_a_number_is_null(spark, tmp_path):
    write(spark, tmp_path / "2017", [("",), ("x",), ("4",)], "A string")
    df = load_years(spark, spec(tmp_path, years=(2017,)))
    assert {r.A for r in df.collect()} == {None, 4.0}


def test_recode_of_a_renamed_column(spark, files):
    df = load_years(spark, spec(files, recodes={"A_OLDEST": {1.0: 11.0}}))
    assert sorted(r.A for r in df.collect()) == [2.0, 2.0, 11.0]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_formats(spark, tmp_path, fmt):
    write(spark, tmp_path / "2017", [(1.5, "t")], "A_OLD double, T string", fmt)
    options = {"header": "true"} if fmt == "csv" else {}
    df = load_years(spark, spec(tmp_path, format=fmt, options=options, years=(2017,)))
    assert [tuple(r) for r in df.collect()] == [(1.5, None, None, "t", 2017)]


def test_only_used_columns_are_read(spark, files):
    df = load_years(spark, spec(files)).select("A")
    plan = df._jdf.queryExecution().toString()
    assert "ReadSchema: struct<A_OLDEST:double>" in plan
    assert "ReadSchema: struct<A:int>" in plan


def test_year_filter_drops_the_other_years(spark, files):
    df = load_years(spark, spec(files)).filter(F.col("survey_year") == 2018)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert df.count() == 2


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_yearly_survey_files_equal_the_survey(spark, sf, fmt):
    path = yearly_files(spark, sf, fmt)
    source = SPEC.at(
        path + "/survey_year={year}", format=fmt, options={"header": "true"}
    ).source
    got = load_years(spark, source)
    want = survey(spark, sf).select(got.columns)
    if fmt == "csv":  # CSV reads an empty text as null
        blank = F.when(F.col("IYEAR") != "", F.col("IYEAR"))
        got, want = got.withColumn("IYEAR", blank), want.withColumn("IYEAR", blank)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_export_and_stage(spark, tmp_path):
    df = spark.createDataFrame([(1, 2017, "a"), (2, 2018, "b")], "v int, y int, s string")
    sinks.write_parquet(df, str(tmp_path / "out"), ["s", "y", "absent"], partition_by="y")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.select("s", "y").collect()) == [("a", 2017), ("b", 2018)]
    assert (tmp_path / "out" / "y=2017").is_dir()
    staged = sinks.stage(df, str(tmp_path / "staged"), partition_by="y")
    assert sorted(r.v for r in staged.collect()) == [1, 2]
    assert "createDataFrame" not in staged._jdf.queryExecution().toString()


def test_small_table_is_one_csv_file(spark, tmp_path):
    df = spark.range(10).repartition(4)
    sinks.write_table_csv(df, str(tmp_path / "t"))
    assert len(list((tmp_path / "t").glob("*.csv"))) == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 10


def session(master, root):
    conf = SimpleNamespace(get=lambda key, default: root)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_shared_folder_on_a_cluster():
    assert sinks.shared_folder(session("yarn", "hdfs://x/ck/")).startswith("hdfs://x/ck/cohortkit-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sinks.shared_folder(session("yarn", None))
    assert "cohortkit-" in sinks.shared_folder(session("local[2]", None))


def test_shared_folder_follows_the_cluster_setting(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    one, two = sinks.shared_folder(spark), sinks.shared_folder(spark)
    assert one != two
    if root:
        assert one.startswith(root.rstrip("/"))
