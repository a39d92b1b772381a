"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension becomes a number (a string by its first seven bytes, which keeps its order),
is quantised at its own approximate quantiles, and the cells are put in the order in which a
Hilbert curve visits them.  Rows sorted by curve index are cut into runs of equal counts, so
a shard covers a compact box and its minima and maxima prune in all dimensions at once.

A null counts as the least value of its dimension.  Ties on the curve go by document number,
then by hash, then by place in the input, so every row has one place; repeated rows are rows.
An empty table has no shards.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.llm.common import staged, tasks

#: Levels of each dimension are 2 ** BITS.
BITS = 5


def hilbert_index(levels: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points (rows) with one level per dimension.

    Skilling's transform: undo the excess work of each bit plane, Gray encode, interleave.
    """
    x = [levels[:, k].astype(np.int64) for k in range(levels.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | (((x[i] ^ t) >> b) & 1)
    return index


def _number(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    if kind == "string":
        padded = F.rpad(F.substring(F.hex(F.col(name).cast("binary")), 1, 14), 14, "0")
        return F.conv(padded, 16, 10).cast("double")
    return F.col(name).cast("double")


def hilbert_runs(
    docs: DataFrame, dimensions: Sequence[str], n_shards: int, carry: dict[str, Column],
    order: str = "doc_id", bits: int = BITS,
) -> DataFrame:
    """``carry`` columns of every row with ``curve``, ``shard`` and ``slot``.

    Shards are consecutive runs of the curve whose row counts differ by one at most; slots
    count from 0 within a shard.
    """
    numbers = [f"__d{k}" for k in range(len(dimensions))]
    points = docs.select(
        F.col(order).cast("long").alias("__order"), *(e.alias(n) for n, e in carry.items()),
        *(_number(docs, d).alias(n) for d, n in zip(dimensions, numbers, strict=True)),
    )
    points = staged(points.withColumn("__place", F.monotonically_increasing_id()))
    levels = 1 << bits
    steps = F.array(*(F.lit(k / levels) for k in range(1, levels)))
    cuts = points.agg(
        *(F.percentile_approx(F.when(~F.isnan(n), F.col(n)), steps).alias(n) for n in numbers)
    ).first()  # 2 ** bits numbers per dimension
    bounds = [np.array(cuts[n] or [], float) for n in numbers]

    @F.pandas_udf("long")
    def curve(*columns: pd.Series) -> pd.Series:
        at = [np.searchsorted(b, c.fillna(-np.inf), "right") for b, c in zip(bounds, columns, strict=True)]
        return pd.Series(hilbert_index(np.stack(at, 1), bits))

    ties = ["curve", "__order", F.xxhash64(*carry), "__place"]
    sorted_ = (
        points.select("__order", "__place", *carry, curve(*numbers).alias("curve"))
        .repartitionByRange(tasks(docs), *ties)
        .sortWithinPartitions(*ties)
        .withColumn("__id", F.monotonically_increasing_id())
    )
    run = staged(sorted_.drop("__order", "__place"))
    # monotonically_increasing_id: the partition above 33 bits with the place in it.
    run = run.withColumns(
        {"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND((1 << 33) - 1)}
    )
    counts = run.groupBy("__part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        "__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"),
        F.sum("n").over(Window.partitionBy()).alias("__total"),
    )
    rank = F.col("__before") + F.col("__at")
    whole = F.expr(f"(__rank * {n_shards}) div __total")
    first = F.expr(f"(shard * __total + {n_shards - 1}) div {n_shards}")
    return (
        run.join(F.broadcast(before), "__part")  # one row for each partition
        .withColumn("__rank", rank)
        .withColumn("shard", whole.cast("int"))
        .withColumn("slot", (F.col("__rank") - first).cast("long"))
        .select(*carry, "curve", "shard", "slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in curve order, for readers that prune files."""
    ordered = sharded.repartitionByRange(tasks(sharded), "shard", "slot")
    ordered.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
