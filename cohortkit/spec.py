"""Declarative specs: plain frozen dataclasses, no Spark objects inside.

A spec says which columns a survey has, which codes mean "no answer", and which
derived columns follow from which inputs.  ``cohortkit.operators.stages`` turns the
rules into Catalyst expressions; nothing in this module touches a session.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

# --------------------------------------------------------------------------- rules


@dataclass(frozen=True)
class Guard:
    """Keep ``source / divisor`` when it lies in ``[lo, hi]``, else null.

    ``zero_codes`` are raw codes that mean "none" and are read as 0.
    """

    name: str
    source: str
    lo: float
    hi: float
    divisor: float = 1.0
    zero_codes: tuple[float, ...] = ()


@dataclass(frozen=True)
class Reverse:
    """Flip an ordinal scale ``lo..hi``; anything off the scale is null."""

    name: str
    source: str
    lo: float
    hi: float


@dataclass(frozen=True)
class Flag:
    """0/1 flag ``source <op> cut``; null stays null."""

    name: str
    source: str
    op: str
    cut: float


@dataclass(frozen=True)
class Between:
    """0/1 flag for ``lo <= source < hi`` (``closed=True``: ``<= hi``); null stays null."""

    name: str
    source: str
    lo: float
    hi: float
    closed: bool = False


@dataclass(frozen=True)
class Recode:
    """Map listed codes to new values; every other code is null."""

    name: str
    source: str
    mapping: Mapping[Any, Any]


@dataclass(frozen=True)
class Bands:
    """Label half-open bands split at ``cuts``; the last label is open-ended.

    ``missing`` is the label of a null value (null when not given).
    """

    name: str
    source: str
    cuts: tuple[float, ...]
    labels: tuple[str, ...]
    missing: str | None = None


@dataclass(frozen=True)
class Outcome:
    """1 for a yes-code, 0 for any other answer, null for no answer.

    The one rule whose source may be absent: the flag is then a null int column.
    """

    name: str
    source: str
    yes: tuple[float, ...]


@dataclass(frozen=True)
class Score:
    """Sum of 0/1 columns with null counted as 0.

    ``observed`` names a companion column holding how many parts were not null.
    """

    name: str
    parts: tuple[str, ...]
    observed: str | None = None


@dataclass(frozen=True)
class Available:
    """1 when ``source`` is not null, else 0."""

    name: str
    source: str


@dataclass(frozen=True)
class LogPositive:
    """``log1p`` of a positive value, 0.0 for zero or less, ``missing`` for null."""

    name: str
    source: str
    missing: float | None = None


@dataclass(frozen=True)
class Offset:
    """``source - base`` as a double."""

    name: str
    source: str
    base: float


Rule = (
    Guard
    | Reverse
    | Flag
    | Between
    | Recode
    | Bands
    | Outcome
    | Score
    | Available
    | LogPositive
    | Offset
)


# --------------------------------------------------------------------------- specs


@dataclass(frozen=True)
class SourceSpec:
    """Where the yearly files are and what their columns are called.

    ``options`` go to the reader.  ``schema`` (a DDL string) names the raw columns of CSV
    or JSON files, so that neither a header nor a sample decides what is read; columns a
    file lacks are null.  ``path`` contains ``{year}``.  ``aliases`` lists, per canonical column, the raw
    names in priority order.  ``recodes`` maps a *raw* name to a code map applied
    when that alias is the one found (codes not listed pass through).  ``types`` gives
    the Spark type of canonical columns that are not doubles.  NaN is read as null
    unless ``nan_as_null`` is off.
    """

    years: tuple[int, ...]
    path: str
    columns: tuple[str, ...]
    format: str = "parquet"
    options: Mapping[str, str] = field(default_factory=dict)
    aliases: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    recodes: Mapping[str, Mapping[float, float]] = field(default_factory=dict)
    types: Mapping[str, str] = field(default_factory=dict)
    year_column: str = "survey_year"
    schema: str | None = None
    nan_as_null: bool = True


@dataclass(frozen=True)
class CleanSpec:
    """Cast, null the missing codes, then apply the cleaning rules."""

    codes: Mapping[str, tuple[float, ...]]
    rules: tuple[Rule, ...]
    keep_as_is: tuple[str, ...] = ("survey_year", "state_name")
    nan_as_null: bool = True


@dataclass(frozen=True)
class FeatureSpec:
    rules: tuple[Rule, ...]


@dataclass(frozen=True)
class Table1Row:
    """One line of the characteristics table.

    ``kind`` is ``mean`` (of a number) or ``share`` (per cent equal to ``value``).
    """

    column: str
    label: str
    kind: str = "mean"
    value: float = 1


@dataclass(frozen=True)
class Summary:
    """One summary table: per cents of 0/1 ``flags`` and ``means`` per group of ``by``.

    ``flags`` and ``means`` map output names to columns; ``share`` names a column for
    the group's per cent of all rows.  Where a report rounds, ``digits`` holds the
    decimals of outputs that differ from the report's.
    """

    name: str
    by: tuple[str, ...] = ()
    flags: Mapping[str, str] = field(default_factory=dict)
    means: Mapping[str, str] = field(default_factory=dict)
    share: str | None = None
    digits: Mapping[str, int] = field(default_factory=dict)

    def rounding(self, digits: int | None) -> dict[str, int]:
        """Decimals per output column when the report uses ``digits`` (none: no rounding)."""
        if digits is None:
            return {}
        names = [*self.flags, *self.means, *([self.share] if self.share else [])]
        return {name: self.digits.get(name, digits) for name in names}


@dataclass(frozen=True)
class ReportSpec:
    summaries: tuple[Summary, ...]
    table1: tuple[Table1Row, ...]
    states: Summary | None = None  # ranked by its first flag
    state_names: Mapping[int, str] = field(default_factory=dict)
    distributions: tuple[str, ...] = ()
    denominator: str = "observed"  # or "stratum"
    digits: int | None = None


@dataclass(frozen=True)
class ModelSpec:
    outcome: str
    inference_features: tuple[str, ...]
    forest_features: tuple[str, ...]
    forest_required: tuple[str, ...]
    labels: Mapping[str, str]
    seed: int = 20260301
    train_share: float = 0.80
    max_iter: int = 200
    trees: int = 50
    depth: int = 6
    impute: str | None = None  # None drops rows with a missing forest feature
    split_key: str | None = None  # None splits with Spark's seeded randomSplit


@dataclass(frozen=True)
class SurveySpec:
    source: SourceSpec
    clean: CleanSpec
    features: FeatureSpec
    report: ReportSpec
    model: ModelSpec
    state: str
    weight: str
    export: tuple[str, ...]

    def at(self, path: str, **source_changes: Any) -> SurveySpec:
        """The same spec reading its yearly files from ``path``."""
        return replace(self, source=replace(self.source, path=path, **source_changes))
