"""Table 1: characteristics per stratum, from one aggregation over the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.functions import exprs as X
from cohortkit.operators.stages import present
from cohortkit.spec import Table1Row

DASH = "—"


def characteristics(
    df: DataFrame,
    outcome: str,
    rows: Sequence[Table1Row],
    strata: Mapping[str, int] | None = None,
    overall: str = "overall",
    denominator: str = "observed",
    weight: str | None = None,
    sd: bool = False,
) -> DataFrame:
    """One line per variable, one numeric column per stratum and for all rows.

    ``overall`` includes rows whose outcome is null.  A ``share`` line divides by the
    rows where the variable is known (``denominator="observed"``) or by the whole
    stratum (``"stratum"``).  Variables ``df`` lacks are left out.  ``sd`` adds the
    sample standard deviation of ``mean`` lines as ``<stratum>_sd``; with ``weight`` it is the
    root of the weighted mean square distance from the weighted mean times n / (n - 1), of the
    n rows with a weight above 0, which for equal weights is the same.

    The data is aggregated once by outcome; everything after works on those few rows.
    Weighted squares are taken about the weighted means, which one aggregation more finds first,
    so that they lose no digits.
    """
    if denominator not in ("observed", "stratum"):
        raise ValueError("denominator is 'observed' or 'stratum'")
    strata = {"diabetic": 1, "no_diabetes": 0} if strata is None else strata
    rows = [r for r in rows if present(df, [r.column])]

    per_outcome = _per_outcome(df, outcome, rows, weight, sd)
    lines = per_outcome.select(F.col(outcome).alias("outcome"), F.inline(_lines(rows, sd)))
    if sd:
        lines = _with_total_spread(lines)
    everyone = F.lit(True)
    groups = {name: F.col("outcome") == value for name, value in strata.items()}
    groups[overall] = everyone
    sums = [
        F.sum(F.when(member, F.col(part))).alias(f"{name}:{part}")
        for name, member in groups.items()
        for part in ("n", "known", "size", "total", *(["cases"] if sd else []))
    ]
    if sd:
        # Within one outcome value the spread is about its own mean, overall about the
        # common one.
        sums += [
            F.sum(F.when(member, F.col("spread_all" if name == overall else "spread"))).alias(
                f"{name}:spread"
            )
            for name, member in groups.items()
        ]
    table = lines.groupBy("position", "variable", "kind").agg(*sums)
    values: list[Column] = []
    for name in groups:
        values.append(_value(name, denominator).alias(name))
    if sd:
        values += [_sd(name).alias(f"{name}_sd") for name in groups]
    return table.select("position", "variable", "kind", *values).orderBy("position")


def _per_outcome(
    df: DataFrame, outcome: str, rows: Sequence[Table1Row], weight: str | None, sd: bool
) -> DataFrame:
    w = F.lit(1) if weight is None else F.col(weight)
    parts = [F.count(F.lit(1)).alias("n"), F.sum(w).alias("size")]
    numbers = {i: F.col(r.column) for i, r in enumerate(rows) if sd and r.kind == "mean"}
    if weight is not None and numbers:
        means = F.struct(*(
            F.try_divide(F.sum(w * x), F.sum(F.when(x.isNotNull(), w))).alias(f"near_{i}") for i, x in numbers.items()
        ))
        df = df.withColumn("near:", df.agg(means).scalar())
    for i, row in enumerate(rows):
        x = F.col(row.column)
        amount = x if row.kind == "mean" else (x == F.lit(row.value)).cast("int")
        parts += [
            F.sum(F.when(x.isNotNull(), w)).alias(f"known_{i}"),
            F.sum(amount if weight is None else w * amount).alias(f"total_{i}"),
        ]
        if i in numbers and weight is None:
            spread = F.coalesce(F.var_samp(x), F.lit(0.0)) * (F.count(x) - 1)
            parts += [F.count(x).alias(f"cases_{i}"), spread.alias(f"spread_{i}")]
        elif i in numbers:
            far = x - F.col(f"near:.near_{i}")
            moved, known = F.sum(w * far), F.sum(F.when(x.isNotNull(), w))
            spread = F.greatest(F.sum(w * far * far) - F.try_divide(moved * moved, known), F.lit(0.0))
            parts += [F.count(F.when(w > 0, x)).alias(f"cases_{i}"), spread.alias(f"spread_{i}")]
    return df.groupBy(outcome).agg(*parts)


def _lines(rows: Sequence[Table1Row], sd: bool) -> Column:
    def line(
        position: int, label: str, kind: str, known: Column, total: Column, *more: Column
    ) -> Column:
        fields = [
            F.lit(position).alias("position"),
            F.lit(label).alias("variable"),
            F.lit(kind).alias("kind"),
            F.col("n").cast("double").alias("n"),
            F.col("size").cast("double").alias("size"),
            known.cast("double").alias("known"),
            total.cast("double").alias("total"),
        ]
        if sd:
            cases, spread = more or (F.lit(None), F.lit(None))
            fields += [cases.cast("double").alias("cases"), spread.cast("double").alias("spread")]
        return F.struct(*fields)

    lines = [line(0, "N", "count", F.col("n"), F.col("n"))]
    for i, row in enumerate(rows):
        more = (F.col(f"cases_{i}"), F.col(f"spread_{i}")) if sd and row.kind == "mean" else ()
        lines.append(
            line(i + 1, row.label, row.kind, F.col(f"known_{i}"), F.col(f"total_{i}"), *more)
        )
    return F.array(*lines)


def _with_total_spread(lines: DataFrame) -> DataFrame:
    """Squared deviations about the mean over all outcomes, from those about the line's own."""
    line = Window.partitionBy("position")
    mean = F.try_divide(F.col("total"), F.col("known"))
    common = F.try_divide(F.sum("total").over(line), F.sum("known").over(line))
    inside = F.coalesce(F.col("spread"), F.lit(0.0))
    return lines.withColumns({"spread": inside, "gap": mean - common}).withColumn(
        "spread_all", F.col("spread") + F.col("known") * F.col("gap") * F.col("gap")
    )


def _value(name: str, denominator: str) -> Column:
    n, known, size, total = (
        F.col(f"`{name}:{part}`") for part in ("n", "known", "size", "total")
    )
    whole = known if denominator == "observed" else size
    return (
        F.when(F.col("kind") == "count", F.coalesce(n, F.lit(0.0)))
        .when(F.col("kind") == "mean", F.try_divide(total, known))
        # no yes-answer at all in the stratum is 0 %, no rows at all is null
        .otherwise(X.per_cent(F.coalesce(total, F.lit(0.0)), whole))
    )


def _sd(name: str) -> Column:
    known, cases, spread = (F.col(f"`{name}:{part}`") for part in ("known", "cases", "spread"))
    variance = F.try_divide(spread, known) * cases / (cases - 1)
    return F.when((F.col("kind") == "mean") & (cases > 1), F.sqrt(variance))


def formatted(table: DataFrame, digits: int = 1) -> DataFrame:
    """Text version: ``1,234``, ``27.3`` or ``27.3 ± 5.1``, ``12.3%``, and a dash for null."""
    values = [c for c in table.columns if c not in ("position", "variable", "kind")]
    strata = [c for c in values if not c.endswith("_sd")]
    kind = F.col("kind")
    fixed = f"decimal(38,{digits})"
    texts = []
    for c in strata:
        mean = F.round(c, digits).cast(fixed).cast("string")
        if f"{c}_sd" in values:
            spread = F.round(f"{c}_sd", digits).cast(fixed).cast("string")
            mean = F.concat(mean, F.coalesce(F.concat(F.lit(" ± "), spread), F.lit("")))
        share = F.concat(F.bround(c, digits).cast(fixed).cast("string"), F.lit("%"))
        text = (
            F.when(kind == "count", F.format_number(F.col(c), 0))
            .when(kind == "mean", mean)
            .otherwise(share)
        )
        texts.append(F.coalesce(text, F.lit(DASH)).alias(c))
    return table.select("position", "variable", *texts).orderBy("position").drop("position")
