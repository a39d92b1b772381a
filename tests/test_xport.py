"""SAS transport files, written here byte by byte."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog.survey_view import SPEC
from cohortkit.sources import xport
from cohortkit.sources.yearly import load_years
from cohortkit.spec import SourceSpec


def number(value, length=8):
    """A base-16 float; a one-letter text is that missing mark."""
    if isinstance(value, str):
        return value.encode() + bytes(length - 1)
    if value == 0:
        return bytes(length)
    fraction, power = math.frexp(abs(value))
    power16 = math.ceil(power / 4)
    bits = int(math.ldexp(fraction, power - 4 * power16 + 56))
    head = (0x80 if value < 0 else 0) | (power16 + 64)
    return bytes([head, *bits.to_bytes(7, "big")])[:length]


def write(path, variables, rows):
    """``variables``: (name, kind, length) with kind "n" or "c"."""
    def padded(raw):
        return raw + b" " * (-len(raw) % 80)

    head = b"HEADER RECORD*******%s HEADER RECORD!!!!!!!%s  "
    out = head % (b"LIBRARY", b"0" * 30) + b" " * 160
    out += head % (b"MEMBER ", b"000000000000000001600000000140")
    out += head % (b"DSCRPTR", b"0" * 30) + b" " * 160
    out += head % (b"NAMESTR", b"%010d" % len(variables) + b"0" * 20)
    names, offset = b"", 0
    for i, (name, kind, length) in enumerate(variables):
        entry = struct.pack(">hhhh", 1 if kind == "n" else 2, 0, length, i + 1)
        entry += name.encode().ljust(8) + b" " * 68 + struct.pack(">i", offset)
        names += entry.ljust(140, b"\0")
        offset += length
    out += padded(names) + head % (b"OBS    ", b"0" * 30)
    body = b""
    for row in rows:
        for (_, kind, length), value in zip(variables, row):
            body += (
                number(value, length) if kind == "n" else value.encode("latin1").ljust(length)
            )
    path.write_bytes(out + padded(body))


@pytest.mark.parametrize(
    ("raw", "value"),
    [
        ("4110000000000000", 1.0),
        ("c276a00000000000", -118.625),
        ("4264000000000000", 100.0),
        ("0000000000000000", 0.0),
        ("4019999999999999", 0.1),
        ("42640000", 100.0),
    ],
)
def test_known_numbers(raw, value):
    cells = np.frombuffer(bytes.fromhex(raw), dtype=np.uint8)[None, :]
    values, missing = xport.decode_numbers(cells)
    assert values[0] == pytest.approx(value, rel=1e-15) and not missing[0]


@pytest.mark.parametrize("mark", [".", "_", "A", "Z"])
def test_missing_marks(mark):
    cells = np.frombuffer(number(mark), dtype=np.uint8)[None, :]
    assert xport.decode_numbers(cells)[1][0]


VARIABLES = [("_STATE", "n", 8), ("NAME", "c", 6), ("AGE", "n", 4), ("Z", "n", 8)]


def read(spark, path, **options):
    spark.dataSource.register(xport.XportSource)
    return spark.read.format("xport").options(**options).load(str(path))


def test_round_trip_in_many_splits(spark, tmp_path):
    rows = [(float(i), f"né{i}", i % 80 + 0.5, "." if i % 7 == 0 else -i / 3) for i in range(1, 1001)]
    write(tmp_path / "t.xpt", VARIABLES, rows)
    df = read(spark, tmp_path / "t.xpt", split_bytes="2600")
    assert df.rdd.getNumPartitions() == 10
    got = sorted(tuple(r) for r in df.collect())
    want = [(a, b, c, None if d == "." else d) for a, b, c, d in rows]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == [None if w[3] is None else pytest.approx(w[3]) for w in want]


@pytest.mark.parametrize("n", range(0, 12))
def test_filling_is_not_read_as_rows(spark, tmp_path, n):
    write(tmp_path / "t.xpt", [("A", "n", 8)], [(1.0,)] * n)
    assert xport.read_layout(str(tmp_path / "t.xpt")).rows == n


def test_no_rows(spark, tmp_path):
    write(tmp_path / "t.xpt", VARIABLES, [])
    assert read(spark, tmp_path / "t.xpt").count() == 0


def test_only_wanted_columns(spark, tmp_path):
    write(tmp_path / "t.xpt", VARIABLES, [(1.0, "a", 2.0, 3.0)])
    df = read(spark, tmp_path / "t.xpt", columns="AGE,_STATE,OTHER")
    assert df.columns == ["_STATE", "AGE"]
    assert tuple(df.head()) == (1.0, 2.0)


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "t.xpt").write_bytes(b"hello" * 100)
    with pytest.raises(ValueError, match="not a SAS transport file"):
        xport.read_layout(str(tmp_path / "t.xpt"))


def test_yearly_transport_files(spark, tmp_path):
    write(tmp_path / "LLCP2017.XPT", [("SEX", "n", 8), ("_AGE80", "n", 8), ("X", "c", 3)],
          [(1.0, 40.0, "q"), (2.0, ".", "")])
    write(tmp_path / "LLCP2018.XPT", [("SEXVAR", "n", 3), ("_AGE80", "n", 8)], [(9.0, 20.0)])
    source = SourceSpec(
        (2017, 2018, 2019), f"{tmp_path}/LLCP{{year}}.XPT", ("SEXVAR", "_AGE80", "DIABETE4"),
        format="xport", aliases=SPEC.source.aliases,
    )
    df = load_years(spark, source)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == [(1.0, 40.0, None, 2017), (2.0, None, None, 2017), (9.0, 20.0, None, 2018)]
    one = df.filter(F.col("survey_year") == 2018)
    assert one._jdf.queryExecution().executedPlan().toString().count("BatchScan") == 1


def test_no_transport_files(spark, tmp_path):
    source = SourceSpec((2017,), f"{tmp_path}/{{year}}.xpt", ("A",), format="xport")
    with pytest.raises(RuntimeError, match="no survey files"):
        load_years(spark, source)


def test_store_names_of_spark_paths(monkeypatch):
    """Paths as Spark writes them reach pyarrow's stores."""
    asked = []
    monkeypatch.setattr(xport, "FileSystem", type("Stores", (), {"from_uri": staticmethod(lambda u: asked.append(u) or (None, ""))}))
    for path in ("s3a://survey/2017.xpt", "s3://survey/2017.xpt", "hdfs://host/x", "file:///x", "gs://b/x"):
        xport._filesystem(path)
    assert asked == ["s3://survey/2017.xpt", "s3://survey/2017.xpt", "hdfs://host/x", "file:///x", "gs://b/x"]
