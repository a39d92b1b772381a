"""Where results go: Parquet datasets, small CSV tables, staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from cohortkit.operators.stages import present


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the cluster's ``spark.checkpoint.dir``.

    A session on one machine may go without the setting and gets a temporary folder; on
    a cluster its absence is an error, for executors share no such folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="cohortkit-")
    return f"{root.rstrip('/')}/cohortkit-{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage with a table that outlives any executor; later scans read only
    the columns they need.
    """
    write_parquet(df, path, partition_by=partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_counted(
    df: DataFrame, path: str, counts: Mapping[str, Column], partition_by: str | None = None
) -> tuple[DataFrame, dict[str, int]]:
    """``stage``, and the aggregates ``counts`` of the rows written, taken as they pass by:
    no job and no scan of their own."""
    seen = Observation()
    watched = df.observe(seen, *(c.alias(name) for name, c in counts.items()))
    staged = stage(watched, path, partition_by=partition_by)
    return staged, {name: seen.get[name] for name in counts}


def write_parquet(
    df: DataFrame,
    path: str,
    columns: Sequence[str] | None = None,
    partition_by: str | None = None,
) -> None:
    """Overwrite ``path`` with (those present of) ``columns``.

    No shuffle before a partitioned write: each input file belongs to one year, so a
    task already writes one directory.
    """
    if columns is not None:
        df = df.select(present(df, columns))
    writer = df.write.mode("overwrite")
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def write_table_csv(table: DataFrame, path: str) -> None:
    """One CSV file with a header, for result tables of a few dozen rows."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
