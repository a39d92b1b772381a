"""Logistic regression with Wald inference, fitted on executors.

One pass measures the cases (numbers, ranges, how far the outcomes overlap).  Each Newton step
is one more pass that adds up a p-by-p matrix (p features); only that matrix and the p
coefficients reach the driver.  Features are centred and scaled by their ranges on the way,
so that units do not matter; the first step, at the null model, doubles as the check of the
design, for there the matrix is that of the correlations.  Robust errors take one pass more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import erfc, log, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.functions import exprs as X
from cohortkit.operators.evaluate import auc
from cohortkit.operators.stages import all_known, require
from cohortkit.session import held

CONSTANT = "const"
ROWS, SIZE, RATE = "rows:", "size:", "rate:"
# Squared sizes of the rows with and without the outcome.
YES2, NO2 = "yes squared:", "no squared:"


class SingularDesignError(ValueError):
    """The design matrix does not determine the coefficients."""


class NotConvergedError(RuntimeError):
    """The likelihood has no finite maximum, or the iteration limit is too low."""


class SeparatedError(NotConvergedError):
    """Features separate the outcomes, so the likelihood has no finite maximum."""


def complete_cases(
    df: DataFrame, outcome: str, features: Sequence[str], weight: str | None = None
) -> DataFrame:
    """Outcome, features (and weight) of the rows where none is null or NaN."""
    columns = [outcome, *features, *([weight] if weight else [])]
    require(df, columns)
    return df.select(*columns).filter(all_known(df, columns))


@dataclass(frozen=True)
class LogitFit:
    outcome: str
    features: tuple[str, ...]
    n: int
    iterations: int
    coefficients: tuple[float, ...]  # constant first
    standard_errors: tuple[float, ...]
    p_values: tuple[float, ...]
    log_likelihood: float
    null_log_likelihood: float

    @property
    def pseudo_r2(self) -> float:
        """McFadden: one minus the ratio of log-likelihoods."""
        return 1 - self.log_likelihood / self.null_log_likelihood

    def log_odds(self) -> Column:
        terms = [F.lit(b) * F.col(c) for b, c in zip(self.coefficients[1:], self.features)]
        return sum(terms, F.lit(self.coefficients[0]))

    def predict(self, df: DataFrame, into: str = "probability") -> DataFrame:
        """``df`` with the fitted probability; null where a feature is missing."""
        require(df, self.features)
        return df.withColumn(into, 1 / (1 + F.exp(-self.log_odds())))

    def auc(self, df: DataFrame) -> float:
        """Exact area under the ROC curve over the complete cases of ``df``."""
        return auc(self.predict(df), self.outcome, "probability")


def fit_logit(
    df: DataFrame,
    outcome: str,
    features: Sequence[str],
    weight: str | None = None,
    max_iter: int = 200,
    tol: float = 1e-18,
    collapse: bool = False,
    robust: bool = False,
) -> LogitFit:
    """Maximum-likelihood logistic regression with a constant and no penalty.

    Newton's method; it ends when a step promises the log-likelihood less than ``tol``
    (of cases with a mean weight of 1).
    ``collapse=True`` first combines rows with equal features into one row holding
    their share of yes-answers and their number: the same estimates from one row per
    covariate pattern.  Use it when the features take few values.

    With ``weight`` the point estimates are the weighted ones.  Standard errors are those of
    the model, which for weighted fits treat weights as frequencies; with ``robust`` they come
    from the sandwich of the inverse information around the sum of squared scores, which holds
    for weights of any scale.  Rows of weight 0 take no part.
    """
    features = tuple(features)
    cases = complete_cases(df, outcome, features, weight)
    size = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    yes = F.col(outcome).cast("double")
    squares = {YES2: size * size * yes, NO2: size * size * (1 - yes)} if robust else {}
    numbers = [F.col(c).cast("double").alias(c) for c in features]
    if collapse:
        cases = cases.groupBy(*features).agg(
            F.count(F.lit(1)).cast("double").alias(ROWS),
            F.sum(size).alias(SIZE),
            F.try_divide(F.sum(size * yes), F.sum(size)).alias(RATE),
            *(F.sum(c).alias(name) for name, c in squares.items()),
        ).select(*numbers, ROWS, SIZE, RATE, *squares)
    else:
        cases = cases.select(
            *numbers, F.lit(1.0).alias(ROWS), size.alias(SIZE), yes.alias(RATE),
            *(c.alias(name) for name, c in squares.items()),
        )
    # Every step reads the cases again.
    with held(cases.filter(F.col(SIZE) > 0)) as cases:
        known = _measure(cases, len(features))
        if not known.n:
            raise ValueError(_no_cases(df, outcome, features))
        if not 0 < known.yes < known.total:
            raise ValueError(f"{known.n} complete cases; {outcome} must take the values 0 and 1")
        known.check(features)
        theta, information, likelihood, steps = _newton(cases, known, features, max_iter, tol)
        inverse = np.linalg.inv(information)
        if robust:
            inverse = inverse @ _squared_scores(cases, known, theta) @ inverse
    coefficients, errors = known.unscaled(theta, inverse)
    share = known.yes / known.total
    return LogitFit(
        outcome=outcome,
        features=features,
        n=known.n,
        iterations=steps,
        coefficients=coefficients,
        standard_errors=errors,
        p_values=tuple(erfc(abs(b / se) / sqrt(2)) for b, se in zip(coefficients, errors)),
        log_likelihood=likelihood,
        null_log_likelihood=known.total * (share * log(share) + (1 - share) * log(1 - share)),
    )


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _summed(cases: DataFrame, work: Work, sums: int, bounds: int = 0) -> tuple[np.ndarray, ...]:
    """What ``work`` yields for each task as one array, in one job: the sums of its first
    ``sums`` numbers, the least of the next ``bounds``, the greatest of the last ``bounds``."""
    parts = cases.mapInArrow(work, "numbers array<double>")
    places = parts.select(F.posexplode("numbers").alias("at", "x")).groupBy("at")
    rows = places.agg(F.sum("x"), F.min("x"), F.max("x")).collect()  # a row for each number
    out = np.full((3, sums + 2 * bounds), np.nan)
    for at, *three in rows:
        out[:, at] = three
    return out[0, :sums], out[1, sums : sums + bounds], out[2, sums + bounds :]


@dataclass(frozen=True)
class _Measured:
    """Numbers of cases, and each feature's centre and ranges: overall, and by outcome."""

    n: int
    total: float
    yes: float
    centre: np.ndarray
    least: np.ndarray  # row 0 of those without the outcome, row 1 of those with it
    most: np.ndarray

    @property
    def extent(self) -> np.ndarray:
        return self.most.max(0) - self.least.min(0)

    def check(self, features: Sequence[str]) -> None:
        constant = [c for c, width in zip(features, self.extent) if width == 0]
        if constant:
            raise SingularDesignError(f"singular design: constant {', '.join(constant)}")
        apart = (self.most[0] <= self.least[1]) | (self.most[1] <= self.least[0])
        if apart.any():
            raise SeparatedError(f"{', '.join(c for c, a in zip(features, apart) if a)} separates the outcomes")

    def unscaled(self, theta: np.ndarray, covariance: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
        """Coefficients and standard errors in the units of the features, constant first."""
        back = np.diag(np.append(1.0, 1 / self.extent))
        back[0, 1:] = -self.centre / self.extent
        return (
            tuple(map(float, back @ theta)),
            tuple(map(float, np.sqrt(np.diag(back @ covariance @ back.T)))),
        )


def _measure(cases: DataFrame, p: int) -> _Measured:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 + p)
        least, most = np.full((2, p), np.inf), np.full((2, p), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([np.asarray(c) for c in batch.columns[:p]], 1)
            rows, size, rate = (np.asarray(c) for c in batch.columns[p : p + 3])
            total += [rows.sum(), size.sum(), size @ rate, *(size @ x)]
            for side, has in enumerate((rate < 1, rate > 0)):
                if has.any():
                    least[side] = np.minimum(least[side], x[has].min(0))
                    most[side] = np.maximum(most[side], x[has].max(0))
        flat = np.concatenate([total, least.ravel(), most.ravel()]).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64()))], names=["numbers"])

    total, least, most = _summed(cases, work, 3 + p, 2 * p)
    if not total[0] > 0:
        return _Measured(0, 0.0, 0.0, np.zeros(p), np.zeros((2, p)), np.zeros((2, p)))
    return _Measured(int(total[0]), float(total[1]), float(total[2]), total[3:] / total[1], least.reshape(2, p), most.reshape(2, p))


def _outer_sums(cases: DataFrame, known: _Measured, theta: np.ndarray, kind: str) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, score, and the matrix of ``kind`` (information or squares) at ``theta``."""
    p, centre, extent = len(known.centre), known.centre, known.extent
    squares = kind == "squares"
    upper = np.triu_indices(p + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likelihood, score, matrix = 0.0, np.zeros(p + 1), np.zeros((p + 1, p + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.ones((batch.num_rows, p + 1))
            for j, c in enumerate(batch.columns[:p]):
                z[:, j + 1] = (np.asarray(c) - centre[j]) / extent[j]
            size, rate = (np.asarray(c) for c in batch.columns[p + 1 : p + 3])
            odds = z @ theta
            chance = 1 / (1 + np.exp(-odds))
            likelihood += size @ (rate * odds - np.logaddexp(0, odds))
            score += (size * (rate - chance)) @ z
            if squares:
                yes, no = (np.asarray(c) for c in batch.columns[p + 3 : p + 5])
                times = yes * (1 - chance) ** 2 + no * chance**2
            else:
                times = size * chance * (1 - chance)
            matrix += (z * times[:, None]).T @ z
        flat = [float(likelihood), *score.tolist(), *matrix[upper].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64()))], names=["numbers"])

    total = _summed(cases, work, 1 + (p + 1) + len(upper[0]))[0]
    matrix = np.zeros((p + 1, p + 1))
    matrix[upper] = matrix.T[upper] = total[p + 2 :]
    return float(total[0]), total[1 : p + 2], matrix


def _squared_scores(cases: DataFrame, known: _Measured, theta: np.ndarray) -> np.ndarray:
    return _outer_sums(cases, known, theta, "squares")[2]


def check_design(information: np.ndarray, features: Sequence[str], tolerance: float = 1e-9) -> None:
    """Raise, naming columns, when features are linearly dependent.

    ``information`` is that of the null model, whose part without the constant is
    proportional to the features' covariances.
    """
    inner = information[1:, 1:] - np.outer(information[1:, 0], information[0, 1:]) / information[0, 0]
    spread = np.sqrt(np.diag(inner))
    if (spread == 0).any():
        raise SingularDesignError(f"singular design: constant {', '.join(f for f, s in zip(features, spread) if s == 0)}")
    values, vectors = np.linalg.eigh(inner / np.outer(spread, spread))
    if len(features) > 1 and values[0] < tolerance:
        involved = [f for f, v in zip(features, vectors[:, 0]) if abs(v) > 1e-4]
        raise SingularDesignError(f"singular design: linear dependence among {', '.join(involved)}")


def _newton(
    cases: DataFrame, known: _Measured, features: Sequence[str], max_iter: int, tol: float
) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Coefficients of the scaled features, information, log-likelihood, steps taken.

    Where the outcomes are separated, each step moves the odds at the ends of some feature's
    range by about one although next to nothing is left to gain.
    """
    theta = np.zeros(len(features) + 1)
    theta[0] = log(known.yes / (known.total - known.yes))
    likelihood, score, information = _outer_sums(cases, known, theta, "information")
    check_design(information, features)
    for steps in range(1, max_iter + 1):
        try:
            step = np.linalg.solve(information, score)
        except np.linalg.LinAlgError as e:
            raise SeparatedError("the information is singular: features separate the outcomes") from e
        gain = float(step @ score) / 2
        promised = gain * known.n / known.total  # whatever the scale of the weights
        moving = [f for f, s in zip(features, step[1:]) if abs(s) > 0.25]
        if promised < 1e-3 and any(abs(step[1:]) > 0.5):
            raise SeparatedError(f"{', '.join(moving)} separates the outcomes, in part or with others")
        theta = theta + step
        if promised < tol:
            return theta, information, likelihood + gain, steps
        before = likelihood
        likelihood, score, information = _outer_sums(cases, known, theta, "information")
        while likelihood < before - 1e-9 * abs(before):  # too far: halve the step
            step = step / 2
            theta = theta - step
            likelihood, score, information = _outer_sums(cases, known, theta, "information")
    raise NotConvergedError(f"no convergence in {max_iter} iterations")


def _no_cases(df: DataFrame, outcome: str, features: Sequence[str]) -> str:
    columns = [outcome, *features]
    known = df.agg(*(F.count(F.when(all_known(df, [c]), 1)) for c in columns)).head()
    empty = [c for c, n in zip(columns, known) if not n]
    reason = f"; nothing is known of {', '.join(empty)}" if empty else ""
    return f"0 complete cases of {', '.join(columns)}{reason}"


def wald_table(
    df: DataFrame,
    fit: LogitFit,
    labels: Mapping[str, str] | None = None,
    confidence: float = 0.95,
) -> DataFrame:
    """Table 2: one line per coefficient, constant first, full precision.

    ``df`` only lends its session.  ``direction`` and ``odds_change_pct`` read the
    odds ratio as a change in odds per unit; both are null for the constant.
    """
    labels = labels or {}
    lines = [
        (i, name, labels.get(name, name), b, se, p)
        for i, (name, b, se, p) in enumerate(
            zip((CONSTANT, *fit.features), fit.coefficients, fit.standard_errors, fit.p_values)
        )
    ]
    schema = (
        "position int, variable string, label string, coefficient double, se double, p_value double"
    )
    reach = NormalDist().inv_cdf(0.5 + confidence / 2) * F.col("se")
    b = F.col("coefficient")
    is_feature = F.col("position") > 0
    return (
        df.sparkSession.createDataFrame(lines, schema)
        .select(
            "position",
            "variable",
            "label",
            "coefficient",
            "se",
            F.exp(b).alias("odds_ratio"),
            F.exp(b - reach).alias("ci_lower"),
            F.exp(b + reach).alias("ci_upper"),
            (b / F.col("se")).alias("z"),
            "p_value",
            X.stars(F.col("p_value")).alias("significance"),
            F.when(is_feature & (b > 0), "increases")
            .when(is_feature, "decreases")
            .alias("direction"),
            F.when(is_feature, F.abs(F.exp(b) - 1) * 100).alias("odds_change_pct"),
        )
        .orderBy("position")
    )


def formatted_wald(table: DataFrame) -> DataFrame:
    """Published layout: four decimals (three for z), p-values rounded last."""
    four = {c: F.round(c, 4) for c in ("coefficient", "se", "odds_ratio", "ci_lower", "ci_upper")}
    rounded = table.withColumns({**four, "z": F.round("z", 3), "p_value": F.round("p_value", 4)})
    return rounded.orderBy("position").select(
        F.col("variable").alias("Variable"),
        F.col("label").alias("Label"),
        F.col("coefficient").alias("Coefficient"),
        F.col("se").alias("SE"),
        F.col("odds_ratio").alias("OR"),
        F.col("ci_lower").alias("CI_lower"),
        F.col("ci_upper").alias("CI_upper"),
        "z",
        "p_value",
        F.col("significance").alias("Significance"),
    )


def fit_summary(df: DataFrame, fit: LogitFit) -> DataFrame:
    """One line: n, convergence, log-likelihood, null log-likelihood, pseudo-R²."""
    line = (
        fit.n,
        True,
        fit.iterations,
        fit.log_likelihood,
        fit.null_log_likelihood,
        fit.pseudo_r2,
    )
    return df.sparkSession.createDataFrame(
        [line],
        "n bigint, converged boolean, iterations int, log_likelihood double, "
        "null_log_likelihood double, pseudo_r2 double",
    )
