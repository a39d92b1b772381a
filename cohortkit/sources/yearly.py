"""Yearly files to one canonical table, resolved at plan time, read on executors."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.functions import exprs as X
from cohortkit.sources import xport
from cohortkit.spec import SourceSpec

log = logging.getLogger(__name__)


def resolve(raw_columns: Sequence[str], canonical: str, spec: SourceSpec) -> str | None:
    """The raw name to use for ``canonical``: first alias the schema has."""
    have = set(raw_columns)
    return next((a for a in spec.aliases.get(canonical, (canonical,)) if a in have), None)


def _canonical_column(raw: DataFrame, canonical: str, spec: SourceSpec) -> Column:
    wanted = spec.types.get(canonical, "double")
    actual = resolve(raw.columns, canonical, spec)
    if actual is None:
        return F.lit(None).cast(wanted).alias(canonical)
    c = F.col(actual).try_cast(wanted)
    if spec.nan_as_null and wanted in ("double", "float"):
        c = X.nan_to_null(c)
    if actual in spec.recodes:
        c = X.overlay_codes(c, spec.recodes[actual])
    return c.alias(canonical)


def to_canonical(raw: DataFrame, year: int | None, spec: SourceSpec) -> DataFrame:
    """Project one year's raw table to the canonical columns plus the year tag.

    The projection sits right on the scan, so only the columns used are read.
    """
    columns = [_canonical_column(raw, c, spec) for c in spec.columns]
    return raw.select(*columns, F.lit(year).cast("int").alias(spec.year_column))


def _read(spark: SparkSession, path: str, spec: SourceSpec) -> DataFrame | None:
    reader = spark.read.format(spec.format).options(**spec.options)
    if spec.schema is not None:
        reader = reader.schema(spec.schema)
    if spec.format == xport.XportSource.name():
        if not xport.exists(path):
            return None
        spark.dataSource.register(xport.XportSource)
        names = [a for c in spec.columns for a in spec.aliases.get(c, (c,))]
        return reader.option("columns", ",".join(names)).load(path)
    try:
        return reader.load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_year(spark: SparkSession, year: int | None, spec: SourceSpec) -> DataFrame | None:
    """One year's canonical table, or None (with a warning) when its files are absent.

    The year None stands for respondents without one; their folder has the name that Spark
    writes for a null.
    """
    path = spec.path.format(year="__HIVE_DEFAULT_PARTITION__" if year is None else year)
    raw = _read(spark, path, spec)
    if raw is None:
        log.warning("no files for %s, skipped: %s", year, path)
        return None
    return to_canonical(raw, year, spec)


def load_years(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """All configured years as one table, duplicates kept.

    The year is a literal in each branch, so a filter on it drops whole years
    before anything is read.
    """
    tables = [t for t in (read_year(spark, y, spec) for y in spec.years) if t is not None]
    if not tables:
        raise RuntimeError(f"no survey files found under {spec.path!r}")
    return reduce(DataFrame.unionByName, tables)
