"""Session settings the library relies on for speed; results never depend on them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

# A rule set fuses into one generated method.  Past 8,000 bytes of bytecode the JVM
# does not compile a method but interprets it, ten times slower; with this limit Spark
# splits such a stage into small compiled projections instead.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Rows go to Python ten thousand at a time, whatever their texts hold, and a task has such a
# batch on either side; long texts fill memory outside the heap, which the JVM then keeps.
TEXTS = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m"}


def tune(spark: SparkSession, settings: dict[str, str] = SETTINGS) -> SparkSession:
    """Set those of ``settings`` that the caller has left unset."""
    for key, value in settings.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` cached for the passes of an iterative fit, spilling to disk.

    The rows stay in the partitions they are in, so what is fitted does not follow the
    machine.  A block lost with its executor is recomputed from the scan.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()
