"""Random forest as a non-parametric check on the regression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.functions import exprs as X
from cohortkit.operators.evaluate import accuracy, auc
from cohortkit.operators.stages import all_known, require
from cohortkit.session import held

RAW, SCALED = "unscaled", "scaled"


def parts_for(rows: int) -> int:
    """Partitions for the training rows: with more rows both their number and their size grow
    (11 for 120,000, some 2,500 for a billion)."""
    return max(1, round(rows**0.6 / 100))


def model_frame(
    df: DataFrame,
    outcome: str,
    features: Sequence[str],
    required: Sequence[str],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Outcome and features of the rows whose ``required`` columns are all known."""
    columns = list(dict.fromkeys([*keep, outcome, *features]))
    require(df, [*columns, *required])
    return df.select(columns).filter(all_known(df, required))


def in_training(key: str, seed: int, share: float) -> Column:
    """Row-wise split by a hash of its key, the same for any partitioning.

    ``share`` is a whole number of hundredths.
    """
    hundredths = round(100 * share)
    if abs(100 * share - hundredths) > 1e-6 or not 0 < hundredths < 100:
        raise ValueError(f"share must be a whole number of hundredths in 0.01..0.99, not {share}")
    return X.hash_share(F.col(key), seed) < F.lit(hundredths)


def random_split(df: DataFrame, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Spark's own seeded split; it depends on the row layout as well as the seed."""
    train, test = df.randomSplit([share, 1 - share], seed=seed)
    return train, test


def vector_stages(
    features: Sequence[str], impute: str | None = None, standardise: bool = True
) -> list:
    """Assemble (dropping rows with a missing feature unless imputed) and standardise."""
    names, stages = list(features), []
    if impute is not None:
        filled = [f"{c}:filled" for c in names]
        stages.append(Imputer(strategy=impute, inputCols=names, outputCols=filled))
        names = filled
    out = RAW if standardise else SCALED
    stages.append(VectorAssembler(inputCols=names, outputCol=out, handleInvalid="skip"))
    if standardise:
        stages.append(
            StandardScaler(inputCol=RAW, outputCol=SCALED, withMean=True, withStd=True)
        )
    return stages


def standardised(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with every feature as (x - mean) / sd; rows missing a feature are dropped."""
    scaled = Pipeline(stages=vector_stages(features)).fit(df).transform(df)
    values = vector_to_array(SCALED)
    return scaled.withColumns(
        {f"{c}_z": values[i] for i, c in enumerate(features)}
    ).drop(RAW, SCALED)


class NoRowsError(ValueError):
    """No row knows all that training or scoring needs."""


@dataclass(frozen=True)
class ForestFit:
    model: PipelineModel
    features: tuple[str, ...]
    train_n: int
    test_n: int
    train_used: int
    test_used: int
    auc: float
    accuracy: float
    importances: tuple[float, ...]


def fit_forest(
    df: DataFrame,
    outcome: str,
    features: Sequence[str],
    required: Sequence[str],
    seed: int,
    share: float = 0.8,
    trees: int = 50,
    depth: int = 6,
    split_key: str | None = None,
    impute: str | None = None,
    standardise: bool = True,
    bootstrap: bool = True,
) -> ForestFit:
    """Train on ``share`` of the rows, score on the rest.

    With ``split_key`` the split is a hash of that column, otherwise ``randomSplit``.
    Rows with a missing feature are dropped unless ``impute`` ("mean" or "median") is
    given; ``train_used`` and ``test_used`` count the rows that took part.  The split is
    made on the rows as they come; the trees then draw their samples from rows dealt by
    content to as many partitions as their number asks for (``parts_for``), so neither cores
    nor files change a forest.
    """
    keep = [split_key] if split_key else []
    frame = model_frame(df, outcome, features, required, keep)
    numbers = {c: F.col(c).cast("double") for c in dict.fromkeys([outcome, *features])}
    frame = frame.withColumns(numbers)
    # The rows come from the input once; what follows reads the held ones.
    with held(frame) as frame:
        if split_key:
            chosen = in_training(split_key, seed, share)
            train, test = frame.filter(chosen), frame.filter(~chosen)
        else:
            train, test = random_split(frame, share, seed)
        sizes = _sizes(train, test, features, impute)
        for name, (_, used) in zip(("training", "test"), sizes):
            if not used:
                raise NoRowsError(f"no {name} rows left: every row misses one of {list(features)}")
        with held(_dealt(train, parts_for(sizes[0][0]))) as train, held(test) as test:
            forest = RandomForestClassifier(
                featuresCol=SCALED, labelCol=outcome, numTrees=trees, maxDepth=depth, seed=seed,
                bootstrap=bootstrap,
            )
            stages = [*vector_stages(features, impute, standardise), forest]
            # A copy leaves the training summary behind, which holds the session: that cannot go to
            # executors once the session has observed a count.
            model = Pipeline(stages=stages).fit(train).copy()
            scored = model.transform(test).select(
                outcome, "prediction", vector_to_array("probability")[1].alias("score")
            )
            with held(scored) as scored:
                area = auc(scored, outcome, "score")
                right = scored.agg(accuracy(outcome, "prediction")).head()[0]
    return ForestFit(
        model=model,
        features=tuple(features),
        train_n=sizes[0][0],
        test_n=sizes[1][0],
        train_used=sizes[0][1],
        test_used=sizes[1][1],
        auc=area,
        accuracy=right,
        importances=tuple(float(v) for v in model.stages[-1].featureImportances.toArray()),
    )


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    """The rows in ``parts`` partitions and an order that follow from their content alone."""
    columns = [F.col(c) for c in df.columns]
    return df.repartition(parts, F.xxhash64(*columns)).sortWithinPartitions(*columns)


def _sizes(
    train: DataFrame, test: DataFrame, features: Sequence[str], impute: str | None
) -> list[tuple[int, int]]:
    """Rows and rows that can take part, of both parts, in one pass."""
    complete = all_known(train, features if impute is None else [])
    both = train.withColumn("part:", F.lit(0)).union(test.withColumn("part:", F.lit(1)))
    rows = both.groupBy("part:").agg(F.count(F.lit(1)), F.count(F.when(complete, 1))).collect()
    found = {part: (n, used) for part, n, used in rows}
    return [found.get(part, (0, 0)) for part in (0, 1)]


def importance_table(
    df: DataFrame, fit: ForestFit, labels: Mapping[str, str] | None = None, top: int = 10
) -> DataFrame:
    """The ``top`` features by importance; ``df`` only lends its session."""
    labels = labels or {}
    lines = [(f, labels.get(f, f), v) for f, v in zip(fit.features, fit.importances)]
    table = df.sparkSession.createDataFrame(
        lines, "variable string, label string, importance double"
    )
    return table.orderBy(F.desc("importance"), "variable").limit(top)


def metrics_table(df: DataFrame, fit: ForestFit) -> DataFrame:
    line = (fit.train_n, fit.test_n, fit.train_used, fit.test_used, fit.auc, fit.accuracy)
    return df.sparkSession.createDataFrame(
        [line],
        "train_n bigint, test_n bigint, train_used bigint, test_used bigint, "
        "auc double, accuracy double",
    )
