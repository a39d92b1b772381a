"""Cleaning and feature stages: rules become one projection per dependency level."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterable, Sequence
from functools import reduce, singledispatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit import spec as S
from cohortkit.functions import exprs as X

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class MissingColumnsError(ValueError):
    """Raised at plan time, naming every input column a stage lacks."""

    def __init__(self, columns: Iterable[str]):
        self.columns = tuple(dict.fromkeys(columns))
        super().__init__(f"missing input columns: {', '.join(self.columns)}")


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of ``columns`` that ``df`` has, in the given order."""
    have = set(df.columns)
    return [c for c in columns if c in have]


def require(df: DataFrame, columns: Sequence[str]) -> None:
    have = set(df.columns)
    absent = [c for c in columns if c not in have]
    if absent:
        raise MissingColumnsError(absent)


def all_known(df: DataFrame, columns: Sequence[str]) -> Column:
    """True where none of ``columns`` is null or NaN, else false or null.

    One plain condition per column, which reaches the file scan: row groups of years that
    never asked a question are not read.  NaN is ordered above infinity, so a comparison
    with it settles both kinds of missing number.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    checks = [
        F.col(c) <= math.inf
        if isinstance(types[c], (T.DoubleType, T.FloatType))
        else F.col(c).isNotNull()
        for c in columns
    ]
    return reduce(operator.and_, checks, F.lit(True))


@singledispatch
def express(rule: S.Rule) -> Column:
    raise TypeError(f"not a rule: {rule!r}")


@express.register
def _(rule: S.Guard) -> Column:
    return X.rescaled(F.col(rule.source), rule.lo, rule.hi, rule.divisor, rule.zero_codes)


@express.register
def _(rule: S.Reverse) -> Column:
    return X.reverse_scale(F.col(rule.source), rule.lo, rule.hi)


@express.register
def _(rule: S.Flag) -> Column:
    return X.compare_flag(F.col(rule.source), rule.op, rule.cut)


@express.register
def _(rule: S.Between) -> Column:
    return X.between_flag(F.col(rule.source), rule.lo, rule.hi, rule.closed)


@express.register
def _(rule: S.Recode) -> Column:
    return X.recode(F.col(rule.source), rule.mapping)


@express.register
def _(rule: S.Bands) -> Column:
    return X.band(F.col(rule.source), rule.cuts, rule.labels, rule.missing)


@express.register
def _(rule: S.Outcome) -> Column:
    return X.outcome_flag(F.col(rule.source), rule.yes)


@express.register
def _(rule: S.Score) -> Column:
    return X.add_up([F.col(p) for p in rule.parts])


@express.register
def _(rule: S.Available) -> Column:
    return X.available(F.col(rule.source))


@express.register
def _(rule: S.LogPositive) -> Column:
    return X.log_positive(F.col(rule.source), rule.missing)


@express.register
def _(rule: S.Offset) -> Column:
    return X.offset(F.col(rule.source), rule.base)


def inputs(rule: S.Rule) -> tuple[str, ...]:
    return rule.parts if isinstance(rule, S.Score) else (rule.source,)


def _columns_of(rule: S.Rule) -> dict[str, Column]:
    columns = {rule.name: express(rule)}
    if isinstance(rule, S.Score) and rule.observed:
        columns[rule.observed] = X.count_observed([F.col(p) for p in rule.parts])
    return columns


def derive(df: DataFrame, rules: Sequence[S.Rule], on_missing: str = "error") -> DataFrame:
    """Add the columns of ``rules``, one ``withColumns`` per dependency level.

    ``on_missing="error"`` names every absent input; ``"skip"`` leaves out the rules
    that need one (and, in turn, the rules that need those).  An ``Outcome`` whose
    source is absent is a null int column either way.
    """
    if on_missing not in ("error", "skip"):
        raise ValueError("on_missing is 'error' or 'skip'")
    have = set(df.columns)
    made = {rule.name for rule in rules}
    lacking = [
        c
        for rule in rules
        if not isinstance(rule, S.Outcome)
        for c in inputs(rule)
        if c not in have and c not in made
    ]
    if lacking and on_missing == "error":
        raise MissingColumnsError(lacking)

    waiting = list(rules)
    while waiting:
        level: dict[str, Column] = {}
        later: list[S.Rule] = []
        for rule in waiting:
            pending = {r.name for r in waiting if r is not rule}
            if any(c in pending for c in inputs(rule)):
                later.append(rule)
            elif all(c in have for c in inputs(rule)):
                level.update(_columns_of(rule))
            elif isinstance(rule, S.Outcome):
                level[rule.name] = F.lit(None).cast("int")
        if len(later) == len(waiting):
            raise ValueError(f"rules depend on each other: {[r.name for r in later]}")
        if level:
            df = df.withColumns(level)
            have.update(level)
        waiting = later
    return df


def _as_number(field: T.StructField, nan_as_null: bool) -> Column:
    c = F.col(field.name)
    if isinstance(field.dataType, T.IntegerType):
        return c
    if not isinstance(field.dataType, T.DoubleType):
        c = c.try_cast("double") if isinstance(field.dataType, T.StringType) else c.cast("double")
        if isinstance(field.dataType, INTEGRAL):
            return c
    return X.nan_to_null(c) if nan_as_null else c


def standardise(df: DataFrame, clean: S.CleanSpec) -> DataFrame:
    """Numbers as numbers, NaN and non-response codes as null: one projection."""
    columns = []
    for field in df.schema.fields:
        if field.name in clean.keep_as_is:
            columns.append(F.col(field.name))
            continue
        c = _as_number(field, clean.nan_as_null)
        codes = clean.codes.get(field.name)
        columns.append((X.null_codes(c, codes) if codes else c).alias(field.name))
    return df.select(columns)


def clean(df: DataFrame, spec: S.CleanSpec, on_missing: str = "error") -> DataFrame:
    return derive(standardise(df, spec), spec.rules, on_missing)


def engineer(df: DataFrame, spec: S.FeatureSpec, on_missing: str = "error") -> DataFrame:
    return derive(df, spec.rules, on_missing)


def analytic(df: DataFrame, spec: S.SurveySpec, on_missing: str = "error") -> DataFrame:
    """Raw canonical table to analytic table."""
    return engineer(clean(df, spec.clean, on_missing), spec.features, on_missing)


def adults(
    df: DataFrame, age: str, minimum: float = 18, outcome: str | None = None
) -> DataFrame:
    """Rows of known adult age; with ``outcome``, only those where it is known."""
    kept = df.filter(F.col(age) >= minimum)
    return kept if outcome is None else kept.dropna(subset=[outcome])
