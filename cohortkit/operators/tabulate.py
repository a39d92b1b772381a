"""Prevalence tables.

All tables come from the same additive parts (row count, and per column its sum and
number of known values), so any coarser table can be merged from a finer one.  Only
those parts are shuffled, already combined on the map side; a group holding a third of
all rows therefore costs the reducer no more than any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.functions import exprs as X
from cohortkit.operators.stages import require
from cohortkit.spec import Summary


def _sum(column: str) -> str:
    return f"sum:{column}"


def _known(column: str) -> str:
    return f"known:{column}"


ROWS, WEIGHT = "rows:", "weight:"

# Decimals for all measures, or per output name; without an entry a value is not rounded.
Digits = int | Mapping[str, int] | None


def _rounded(c: Column, name: str, digits: Digits) -> Column:
    places = digits.get(name) if isinstance(digits, Mapping) else digits
    return c if places is None else F.round(c, places)


def _parts(columns: Sequence[str], weight: str | None) -> list[Column]:
    parts = [F.count(F.lit(1)).alias(ROWS)]
    if weight is None:
        for c in columns:
            parts += [F.sum(c).alias(_sum(c)), F.count(c).alias(_known(c))]
    else:
        w = F.col(weight)
        parts.append(F.sum(w).alias(WEIGHT))
        for c in columns:
            parts += [
                F.sum(w * F.col(c)).alias(_sum(c)),
                F.sum(F.when(F.col(c).isNotNull(), w)).alias(_known(c)),
            ]
    return parts


def _merged(columns: Sequence[str], weight: str | None) -> list[Column]:
    names = [ROWS] + ([WEIGHT] if weight is not None else [])
    names += [n for c in columns for n in (_sum(c), _known(c))]
    return [F.sum(F.col(f"`{n}`")).alias(n) for n in names]


def _measured(flags: Mapping[str, str], means: Mapping[str, str]) -> list[str]:
    return list(dict.fromkeys([*flags.values(), *means.values()]))


def _finish(
    flags: Mapping[str, str], means: Mapping[str, str], weight: str | None, digits: Digits
) -> list[Column]:
    out = [F.col(ROWS).alias("n")]
    if weight is not None:
        out.append(F.col(WEIGHT).alias("weighted_n"))
    for name, c in flags.items():
        ratio = X.per_cent(F.col(f"`{_sum(c)}`"), F.col(f"`{_known(c)}`"))
        out.append(_rounded(ratio, name, digits).alias(name))
    for name, c in means.items():
        ratio = F.try_divide(F.col(f"`{_sum(c)}`"), F.col(f"`{_known(c)}`"))
        out.append(_rounded(ratio, name, digits).alias(name))
    return out


def cells(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], weight: str | None = None
) -> DataFrame:
    """The finest table: additive parts per combination of ``by``.

    At most as many rows as there are combinations of group labels, whatever the size
    of ``df``.  Keep it (``persist`` or a staged table) and take every coarser table
    from it with ``rates``.
    """
    require(df, [*by, *columns, *([weight] if weight else [])])
    return df.groupBy(*by).agg(*_parts(columns, weight))


def rates(
    table: DataFrame,
    by: Sequence[str] = (),
    flags: Mapping[str, str] | None = None,
    means: Mapping[str, str] | None = None,
    weight: str | None = None,
    share: str | None = None,
    digits: Digits = None,
) -> DataFrame:
    """Merge ``cells`` up to ``by`` and turn the parts into per cents and means."""
    flags, means = flags or {}, means or {}
    merged = table.groupBy(*by).agg(*_merged(_measured(flags, means), weight))
    return _ordered(merged, by, flags, means, weight, share, digits)


def prevalence(
    df: DataFrame,
    by: Sequence[str] = (),
    flags: Mapping[str, str] | None = None,
    means: Mapping[str, str] | None = None,
    weight: str | None = None,
    share: str | None = None,
    digits: Digits = None,
) -> DataFrame:
    """Per group of ``by``: row count, per cent of each 0/1 flag, mean of each number.

    ``flags`` and ``means`` map output names to columns.  Nulls leave the
    denominator; a column with no known value in a group (a question not asked that
    year) gives null, never 0 %.  A null key is a group of its own.  ``share`` names
    an extra column holding the group's per cent of all rows.  With ``weight`` the
    estimates are weighted and ``weighted_n`` is added.
    """
    flags, means = flags or {}, means or {}
    table = cells(df, by, _measured(flags, means), weight)
    return _ordered(table, by, flags, means, weight, share, digits)


def _ordered(
    table: DataFrame,
    by: Sequence[str],
    flags: Mapping[str, str],
    means: Mapping[str, str],
    weight: str | None,
    share: str | None,
    digits: Digits,
) -> DataFrame:
    columns = [F.col(b) for b in by] + _finish(flags, means, weight, digits)
    if share is not None:
        size = ROWS if weight is None else WEIGHT
        # The window runs over the finished groups, not over rows of data.
        total = F.sum(F.col(size)).over(Window.partitionBy(F.lit(1)))
        part = X.per_cent(F.col(size), total)
        columns.append(_rounded(part, share, digits).alias(share))
    out = table.select(*columns)
    return out.orderBy(*by) if by else out


def summary(
    df: DataFrame, spec: Summary, weight: str | None = None, digits: int | None = None
) -> DataFrame:
    """The table ``spec`` describes, straight from the data."""
    rounding = spec.rounding(digits)
    return prevalence(df, spec.by, spec.flags, spec.means, weight, spec.share, rounding)


def summary_cells(
    df: DataFrame, specs: Sequence[Summary], weight: str | None = None
) -> DataFrame:
    """The cells all of ``specs`` can be read from: one scan for all tables."""
    keys = list(dict.fromkeys(k for s in specs for k in s.by))
    columns = list(dict.fromkeys(c for s in specs for c in _measured(s.flags, s.means)))
    return cells(df, keys, columns, weight)


def summaries(
    table: DataFrame,
    specs: Sequence[Summary],
    weight: str | None = None,
    digits: int | None = None,
) -> dict[str, DataFrame]:
    """Every table of ``specs``, by name, from their ``summary_cells``."""
    return {
        s.name: rates(table, s.by, s.flags, s.means, weight, s.share, s.rounding(digits))
        for s in specs
    }


def prevalence_sets(
    df: DataFrame,
    sets: Sequence[str],
    flags: Mapping[str, str] | None = None,
    means: Mapping[str, str] | None = None,
    weight: str | None = None,
    digits: Digits = None,
) -> DataFrame:
    """One table per key in ``sets``, stacked as (dimension, level), in one scan.

    The rows of ``df`` are first combined over all keys together; the grouping sets
    then expand those few cells instead of every row.
    """
    flags, means = flags or {}, means or {}
    measured = _measured(flags, means)
    fine = cells(df, sets, measured, weight)
    dimension = F.coalesce(*(F.when(F.grouping(k) == 0, F.lit(k)) for k in sets))
    level = F.coalesce(*(F.when(F.grouping(k) == 0, F.col(k).cast("string")) for k in sets))
    table = fine.groupingSets([[k] for k in sets], *sets).agg(
        dimension.alias("dimension"), level.alias("level"), *_merged(measured, weight)
    )
    return table.select("dimension", "level", *_finish(flags, means, weight, digits))


def change_over_time(
    table: DataFrame,
    columns: Sequence[str],
    time: str = "survey_year",
    by: Sequence[str] = (),
) -> DataFrame:
    """Add each column's change from its first known year and from the last known year
    before (``*_since_first``, ``*_since_last``).  Years without a value are skipped.

    ``table`` is a summary: one row per year and group.
    """
    per_group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    ordered = per_group.orderBy(time)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    every = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    extra = {}
    for c in columns:
        first = F.first(F.col(c), ignorenulls=True).over(every)
        last = F.last(F.col(c), ignorenulls=True).over(before)
        extra[f"{c}_since_first"] = F.col(c) - first
        extra[f"{c}_since_last"] = F.col(c) - last
    return table.withColumns(extra)


def ratio_to(
    table: DataFrame, key: str, reference: object, columns: Sequence[str], suffix: str = "_ratio"
) -> DataFrame:
    """Divide each column of a summary table by its value in the ``reference`` group."""
    group = table.filter(F.col(key) == F.lit(reference))
    return table.withColumns(
        {f"{c}{suffix}": F.try_divide(F.col(c), group.agg(F.max(c)).scalar()) for c in columns}
    )


def extremes(table: DataFrame, key: str, value: str, k: int = 10) -> DataFrame:
    """The ``k`` highest and ``k`` lowest groups by ``value`` (ties broken by ``key``).

    Two top-k sorts that keep ``k`` rows per task; ranks are given to those rows only.
    """
    known = table.filter(F.col(value).isNotNull())
    ends = []
    for end, order in (
        ("top", [F.col(value).desc(), F.col(key).asc()]),
        ("bottom", [F.col(value).asc(), F.col(key).asc()]),
    ):
        best = known.orderBy(*order).limit(k)
        rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
        ends.append(best.select(F.lit(end).alias("end"), rank.alias("rank"), "*"))
    return ends[0].unionByName(ends[1])


def with_label(
    table: DataFrame, codes: DataFrame, key: str, code: str, label: str, name: str
) -> DataFrame:
    """Attach ``label`` from a code table; a key without a code keeps a null label.

    Apply it to the finished groups.  The join strategy is Spark's, from the measured
    size of the code table.
    """
    labels = codes.select(F.col(code).cast("double").alias("code:"), F.col(label).alias(name))
    joined = table.join(labels, F.col(key).cast("double") == F.col("`code:`"), "left")
    return joined.drop("code:")
