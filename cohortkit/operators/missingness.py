"""Questions not asked, told apart from questions not answered."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.functions import exprs as X
from cohortkit.operators.stages import require


#: Groups whose questions fit into one value.
MOST_GROUPS = 10_000


def _is_code(column: str, codes: Mapping[str, Sequence[float]]) -> Column:
    listed = codes.get(column)
    return F.col(column).isin(*listed) if listed else F.col(column).isNotNull() & F.lit(False)


def _nan_blank(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``raw`` with NaN in ``columns`` read as blank: nobody answers "not a number"."""
    kinds = dict(raw.dtypes)
    return raw.withColumns(
        {c: X.nan_to_null(F.col(c)) for c in columns if kinds[c] in ("double", "float")}
    )


def availability(
    raw: DataFrame,
    columns: Sequence[str],
    codes: Mapping[str, Sequence[float]],
    by: str = "survey_year",
) -> DataFrame:
    """Per (``by``, variable): rows, answers, non-response codes, blanks, and a status.

    ``raw`` still holds the codes.  The status is ``not_asked`` when nobody gave an
    answer or a code, ``no_answer`` when there are codes only, else ``answered``.
    One pass over the data.
    """
    require(raw, [by, *columns])
    raw = _nan_blank(raw, columns)
    parts = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        parts += [
            F.count(c).alias(f"given_{i}"),
            F.count(F.when(_is_code(c, codes), 1)).alias(f"coded_{i}"),
        ]
    per_group = raw.groupBy(by).agg(*parts)
    lines = F.array(
        *(
            F.struct(
                F.lit(c).alias("variable"),
                F.col("n").alias("n"),
                (F.col(f"given_{i}") - F.col(f"coded_{i}")).alias("answered"),
                F.col(f"coded_{i}").alias("non_response"),
                (F.col("n") - F.col(f"given_{i}")).alias("blank"),
            )
            for i, c in enumerate(columns)
        )
    )
    status = (
        F.when(F.col("answered") + F.col("non_response") == 0, "not_asked")
        .when(F.col("answered") == 0, "no_answer")
        .otherwise("answered")
    )
    return per_group.select(by, F.inline(lines)).withColumn("status", status)


def missing_kinds(
    raw: DataFrame,
    columns: Sequence[str],
    codes: Mapping[str, Sequence[float]],
    by: str = "survey_year",
) -> DataFrame:
    """Add ``<column>_kind`` per row: ``answered``, ``non_response``, ``blank`` or
    ``not_asked`` (nobody in that row's ``by`` group was asked).  NaN is blank, in the
    columns as well.

    What was asked is one value for all groups, a map from group to flags, which the rows
    look their group up in: a scalar subquery, so the data neither moves nor waits for a job
    when the plan is built.  It is for groups like survey years; over MOST_GROUPS of them are
    an error.
    """
    require(raw, [by, *columns])
    raw = _nan_blank(raw, columns)
    asked = raw.groupBy(F.col(by).alias("group")).agg(
        F.array(*((F.count(c) > 0) for c in columns)).alias("asked")
    )
    # A map has no null key, so groups are keyed by arrays of one.
    entries = F.collect_list(F.struct(F.array("group").alias("group"), "asked"))
    checked = F.when(
        F.count(F.lit(1)) > MOST_GROUPS, F.raise_error(F.lit(f"more than {MOST_GROUPS} groups of {by}"))
    ).otherwise(F.map_from_entries(entries))
    mine = F.element_at(asked.agg(checked).scalar(), F.array(F.col(by)))
    kinds = {
        f"{c}_kind": F.when(_is_code(c, codes), "non_response")
        .when(F.col(c).isNotNull(), "answered")
        .when(F.col("asked:")[i], "blank")
        .otherwise("not_asked")
        for i, c in enumerate(columns)
    }
    return raw.withColumn("asked:", mine).withColumns(kinds).drop("asked:")
