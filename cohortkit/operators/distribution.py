"""Quantiles of survey measures: approximate in one pass, stored as mergeable sketches, exact
over counted values, and weighted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit import sinks
from cohortkit.operators.stages import require

#: Size of a stored quantile sketch; ranks are then within about 0.0133 of those asked for.
SKETCH = 200
SKETCH_ERROR = 0.0165
#: Ranges of values that weighted quantiles are looked for in, a power of two, and tasks over
#: which the values of one group are spread to be placed in them.
RANGES, SPREAD = 256, 64


def _name(p: float) -> str:
    return f"p{100 * p:g}".replace(".", "_")


def approximate_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """Quantiles of any numeric column, within ``1/accuracy`` of the asked rank.

    A mergeable sketch of bounded size per group, one pass over the data.
    """
    require(df, [*by, *columns])
    parts = []
    for c in columns:
        sketch = F.percentile_approx(F.col(c).cast("double"), list(probs), accuracy)
        parts += [F.count(c).alias(f"known:{c}"), sketch.alias(f"at:{c}")]
    wide = df.groupBy(*by).agg(*parts)
    lines = F.array(*(_line(c, F.col(f"`known:{c}`"), F.col(f"`at:{c}`")) for c in columns))
    return _spread(wide.select(*by, F.inline(lines)), by, probs)


def exact_quantiles(
    df: DataFrame,
    ranges: Mapping[str, tuple[int, int]],
    probs: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact interpolated quantiles of whole-number measures with a known range.

    ``ranges`` maps each column to its ``(lo, hi)``; a value that is not a whole
    number in that range is an error.  Values are counted first, so what reaches one
    group's final step is at most ``hi - lo + 1`` counted values however many rows
    there are.  For other columns use ``approximate_quantiles``.
    """
    require(df, [*by, *ranges])
    lines = F.array(
        *(
            F.struct(F.lit(c).alias("variable"), _checked(c, lo, hi).alias("value"))
            for c, (lo, hi) in ranges.items()
        )
    )
    counted = (
        df.select(*by, F.inline(lines))
        .filter(F.col("value").isNotNull())
        .groupBy(*by, "variable", "value")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    found = counted.groupBy(*by, "variable").agg(
        F.sum("times").alias("known"),
        F.percentile("value", list(probs), F.col("times")).alias("at"),
    )
    return _spread(found, by, probs)


def quantile_sketches(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), size: int = SKETCH
) -> DataFrame:
    """One row per group and variable: ``known`` values and a ``sketch`` of their ranks.

    The sketches (KLL, bounded by ``size`` whatever the data) can be stored and merged over
    any of the groups later by ``merged_sketches``, without a look at the data.
    """
    require(df, [*by, *columns])
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        parts += [
            F.count(c).alias(f"known:{c}"),
            F.kll_sketch_agg_double(x, F.lit(size)).alias(f"at:{c}"),
        ]
    wide = df.groupBy(*by).agg(*parts)
    lines = F.array(*(_line(c, F.col(f"`known:{c}`"), F.col(f"`at:{c}`")) for c in columns))
    return wide.select(*by, F.inline(lines)).withColumnRenamed("at", "sketch")


def merged_sketches(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of coarser groups ``by`` from those of finer ones."""
    require(table, [*by, "variable", "known", "sketch"])
    # A group without values has an empty sketch, which adds nothing.
    return table.groupBy(*by, "variable").agg(
        F.sum("known").alias("known"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def sketched_quantiles(
    table: DataFrame, probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Quantiles of each sketch, null for groups without values; ranks within SKETCH_ERROR
    of those asked for, with 99 % probability, at the default size."""
    asked = F.array(*(F.lit(float(p)) for p in probs))
    # An empty sketch has no quantiles to ask for.
    found = table.withColumn(
        "at", F.when(F.col("known") > 0, F.kll_sketch_get_quantile_double("sketch", asked))
    )
    return _spread(found, by, probs)


def weighted_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    weight: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact weighted quantiles: the least value up to which at least ``p`` of a group's
    weight lies.

    Rows are combined per value first.  The values of a group are placed in RANGES ranges of
    about equally many values, by edges from a sketch; running weights over the ranges tell
    which one holds each quantile, and running weights over the values are taken in those
    ranges only.  So no window passes over a group, only over its ranges and over
    the few ranges picked, in parallel.  Rows of no or no positive weight take no part;
    ``known`` counts rows.  The combined values and the edges are kept in the shared
    folder, for they are read twice.
    """
    require(df, [*by, *columns, weight])
    keys, w = [*by, "variable"], F.col(weight).cast("double")
    lines = F.array(
        *(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns)
    )
    counted = (
        df.filter(w > 0)
        .select(*by, w.alias("weight:"), F.inline(lines))
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy(*keys, "value")
        .agg(F.sum("weight:").alias("weight:"), F.count(F.lit(1)).alias("rows:"))
    )
    folder = sinks.shared_folder(df.sparkSession)
    counted = sinks.stage(counted, f"{folder}/values")
    steps = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
    groups = counted.groupBy(*keys).agg(
        F.sum("weight:").alias("whole:"),
        F.sum("rows:").alias("known"),
        F.kll_sketch_get_quantile_double(
            F.kll_sketch_agg_double("value", F.lit(4 * RANGES)), steps
        ).alias("edges:"),
    )
    groups = sinks.stage(groups, f"{folder}/groups")  # a sketch's edges are not the same twice
    dealt = F.pmod(F.xxhash64("value"), F.lit(SPREAD)).cast("int")
    salted = groups.withColumn("salt:", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    placed = _joined(counted.withColumn("salt:", dealt), salted, [*keys, "salt:"])
    placed = placed.select(*keys, "value", "weight:", "whole:", "known", _place("edges:", "value").alias("range:"))

    along = Window.partitionBy(*keys).orderBy("range:")
    ranges = placed.groupBy(*keys, "range:", "whole:", "known").agg(F.sum("weight:").alias("weight:"))
    ranges = ranges.withColumn("end:", F.sum("weight:").over(along))
    before = F.col("end:") - F.col("weight:")
    asked = ranges.select(
        *keys, "range:", "whole:", "known", before.alias("before:"), "end:",
        F.posexplode(F.array(*(F.lit(float(p)) for p in probs))).alias("which:", "p:"),
    )
    # The first range that reaches the weight asked for; a share of 0 asks for the first value.
    reached = F.col("end:") >= _goal()
    asked = asked.filter(reached).withColumn(
        "turn:", F.row_number().over(Window.partitionBy(*keys, "which:").orderBy("range:"))
    ).filter("`turn:` = 1").drop("turn:", "end:")
    inside = _joined(placed.drop("whole:", "known"), asked, [*keys, "range:"])
    run = F.sum("weight:").over(Window.partitionBy(*keys, "which:").orderBy("value"))
    found = inside.withColumn("run:", F.col("before:") + run).filter(F.col("run:") >= _goal())
    at = found.groupBy(*keys, "known").agg(
        *(F.min(F.when(F.col("which:") == i, F.col("value"))).alias(f"at:{i}") for i in range(len(probs)))
    )
    return at.select(*keys, "known", *(F.col(f"`at:{i}`").alias(_name(p)) for i, p in enumerate(probs)))


def _goal() -> Column:
    """The weight that a quantile has to reach; sums of weights may differ in the last digits."""
    return F.col("p:") * F.col("whole:") * (1 - 1e-12)


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys``, of which nulls are equal."""
    renamed = right.withColumnsRenamed({k: f"right {k}" for k in keys})
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`right {k}`")) for k in keys]
    return left.join(renamed, same).drop(*(f"right {k}" for k in keys))


def _place(edges: str, value: str) -> Column:
    """How many of the sorted ``edges`` lie below ``value``, by halving."""
    halves = [RANGES >> i for i in range(1, RANGES.bit_length())]
    steps = F.array(*(F.lit(h) for h in halves))
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.element_at(F.col(edges), at + step) < F.col(value), at + step).otherwise(at),
    )


def _checked(column: str, lo: int, hi: int) -> Column:
    c = F.col(column).cast("double")
    fits = c.between(lo, hi) & (c == F.floor(c))
    message = F.lit(f"{column} is not a whole number in {lo}..{hi}")
    return F.when(c.isNull() | fits, c).otherwise(F.raise_error(message).cast("double"))


def _line(column: str, known: Column, at: Column) -> Column:
    return F.struct(F.lit(column).alias("variable"), known.alias("known"), at.alias("at"))


def _spread(lines: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    at = [F.get("at", F.lit(i)).alias(_name(p)) for i, p in enumerate(probs)]
    return lines.select(*by, "variable", "known", *at)
