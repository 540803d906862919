"""Regression from features to settle time: fit, score, compare, diagnose."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType
from pyspark.storagelevel import StorageLevel

from settlespark.functions.stats import importance_stats
from settlespark.operators.joins import smallest
from settlespark.operators.project import drop_unlabelled, feature_columns, front_columns
from settlespark.plans.skew import freeze, number_rows

LABEL, PRED = "wait_time_ms", "pred_wait_time_ms"
VECTOR = "_features"
FILLED = "_filled_"


def default_candidates(seed: int = 0) -> dict[str, Estimator]:
    """Regressors to try, cheapest first."""
    return {
        "linear": LinearRegression(regParam=0.0),
        "tree": DecisionTreeRegressor(maxDepth=8, seed=seed),
        "forest": RandomForestRegressor(numTrees=40, maxDepth=8, seed=seed),
        "boosted": GBTRegressor(maxIter=20, maxDepth=4, stepSize=0.1, seed=seed),
    }


@dataclass
class Trained:
    """The best model with the scores of all candidates on held-out waves."""

    model: PipelineModel
    features: list[str]
    label: str
    id: str
    best: str
    scores: list[tuple[str, float, float, float]] = field(default_factory=list)
    held_out: bool = True
    skipped: list[str] = field(default_factory=list)


def _pipeline(features: Sequence[str], label: str, estimator: Estimator) -> Pipeline:
    filled = [FILLED + c for c in features]
    estimator = estimator.copy()
    estimator.setFeaturesCol(VECTOR).setLabelCol(label).setPredictionCol(PRED)
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol=VECTOR),
        estimator,
    ])


def _numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def held_out(holdout: float = 0.2, seed: int = 0, id: str = "wave_id") -> Column:
    """Whether a wave is held out of training; depends on its id and the seed only."""
    return F.pmod(F.xxhash64(id, F.lit(seed)), F.lit(10_000)) < int(round(holdout * 10_000))


def split_waves(
    df: DataFrame, holdout: float = 0.2, seed: int = 0, id: str = "wave_id",
    held: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows; ``held`` replaces the rule of :func:`held_out`."""
    held = held_out(holdout, seed, id) if held is None else held
    return df.filter(~held), df.filter(held)


def train_regressor(
    df: DataFrame,
    label: str = LABEL,
    candidates: dict[str, Estimator] | None = None,
    time_limit: float | None = 60.0,
    features: Sequence[str] | None = None,
    id: str = "wave_id",
    holdout: float = 0.2,
    seed: int = 0,
    held: Column | None = None,
) -> Trained:
    """Fit candidates in order until ``time_limit`` seconds are used; keep the best.

    Candidates are compared by the mean absolute error on held-out waves, not
    on the rows they were fitted to; ``holdout=0`` asks for a comparison on the
    training rows, and ``held_out`` of the result tells which it was.  Without
    ``features``, all numeric and boolean columns are taken and others left out.  The
    first candidate is always fitted, those left when the time is used are listed as
    ``skipped``; ``time_limit=None`` fits all.
    """
    features = list(features or numeric_features(df, label, id))
    candidates = candidates or default_candidates(seed)
    table = _numeric(drop_unlabelled(df, label), [*features, label])
    table = table.select(id, label, *features).persist(StorageLevel.MEMORY_AND_DISK)
    apart = holdout > 0 or held is not None
    training, validation = split_waves(table, holdout, seed, id, held) if apart else (table, table)
    models: dict[str, PipelineModel] = {}
    scores, skipped = [], []
    started = time.monotonic()
    try:
        if validation.isEmpty():
            raise ValueError("no labelled wave is held out; give more waves, or holdout=0")
        for name, estimator in candidates.items():
            if models and time_limit is not None and time.monotonic() - started > time_limit:
                skipped.append(name)
                continue
            begin = time.monotonic()
            models[name] = _pipeline(features, label, estimator).fit(training)
            fitted = time.monotonic()
            error = F.avg(F.abs(F.col(PRED) - F.col(label)))
            mae = models[name].transform(validation).agg(error).first()[0]
            scores.append((name, -mae, time.monotonic() - fitted, fitted - begin))
    finally:
        table.unpersist()
    scores.sort(key=lambda s: -s[1])
    best = scores[0][0]
    return Trained(models[best], features, label, id, best, scores, apart, skipped)


def leaderboard(spark: SparkSession, trained: Trained, top: int | None = None) -> DataFrame:
    """One row per candidate, best first; ``score_val`` is the negative error.

    ``held_out`` says whether it was measured on waves kept out of training.
    Candidates that the time limit left out follow without a score.
    """
    rows = [(*s, trained.held_out) for s in trained.scores]
    rows += [(name, None, None, None, trained.held_out) for name in trained.skipped]
    columns = "model string, score_val double, pred_time_val double, fit_time double, held_out boolean"
    return spark.createDataFrame(rows[:top], columns)


def out_of_fold(
    df: DataFrame,
    candidates: dict[str, Estimator],
    fold: Column,
    folds: int,
    features: Sequence[str] | None = None,
    label: str = LABEL,
    id: str = "wave_id",
) -> DataFrame:
    """Per labelled wave its id, label and one prediction of each candidate.

    ``fold`` gives a wave a number below ``folds``; its predictions come from models
    fitted to the waves of the other folds.  A fold whose number is not below ``folds``
    or is null fails the job, as no model would predict it.
    """
    features = list(features or numeric_features(df, label, id))
    table = _numeric(drop_unlabelled(df, label), [*features, label])
    number = F.when((fold >= 0) & (fold < folds), fold).otherwise(
        F.raise_error(F.lit("a wave is in none of the folds")))
    table = freeze(table.select(id, label, *features, number.cast("int").alias("_fold")))
    parts = []
    for part in range(folds):
        inside, rest = table.filter(F.col("_fold") == part), table.filter(F.col("_fold") != part)
        for name, estimator in candidates.items():
            fitted = _pipeline(features, label, estimator).fit(rest)
            inside = fitted.transform(inside).drop(VECTOR, *[FILLED + c for c in features])
            inside = inside.withColumnRenamed(PRED, name)
        parts.append(inside.select(id, label, *candidates))
    return reduce(DataFrame.unionByName, parts)


def select_ensemble(
    predictions: DataFrame, candidates: Sequence[str], rounds: int = 20, label: str = LABEL
) -> DataFrame:
    """Weights of candidates whose weighted mean predicts the label well.

    Greedy selection with replacement: each round adds the candidate that brings the
    mean absolute error of the mean of all chosen ones lowest, the first named among
    equals; all choices of a round are tried in one pass.  One row per candidate:
    ``model``, ``weight`` (its share of the rounds), ``mae`` and ``ensemble_mae``.
    """
    names, spark = list(candidates), predictions.sparkSession
    held = freeze(predictions.select(label, *names))

    def errors(options: list[list[int]]) -> list[float]:
        means = [
            sum((F.col(c) * F.lit(float(n)) for c, n in zip(names, option)), F.lit(0.0)) / F.lit(float(sum(option)))
            for option in options]
        return list(held.agg(*[F.avg(F.abs(m - F.col(label))).alias(f"e{i}") for i, m in enumerate(means)]).first())

    chosen = [0] * len(names)
    alone, best = None, None
    for _ in range(rounds):
        options = [[n + (i == j) for j, n in enumerate(chosen)] for i in range(len(names))]
        tried = errors(options)
        if None in tried:
            raise ValueError("an ensemble needs labelled rows")
        alone, best = alone or tried, min(tried)
        chosen = options[tried.index(best)]
    rows = [(name, n / rounds, mae, best) for name, n, mae in zip(names, chosen, alone)]
    return spark.createDataFrame(rows, "model string, weight double, mae double, ensemble_mae double")


def score(
    df: DataFrame, model: PipelineModel, features: Sequence[str], id: str = "wave_id"
) -> DataFrame:
    """Add ``pred_wait_time_ms``; id and prediction come first, other columns stay."""
    scored = model.transform(_numeric(df, features))
    helper = [c for c in scored.columns if c.startswith(FILLED)]
    scored = scored.drop(VECTOR, *helper)
    return front_columns(scored, id, PRED)


def model_features(model: PipelineModel) -> list[str]:
    """The feature columns a fitted model reads."""
    return model.stages[0].getInputCols()


def short_predictions(scored: DataFrame, id: str = "wave_id") -> DataFrame:
    """Id and prediction only."""
    return scored.select(id, PRED)


def residuals(scored: DataFrame, label: str = LABEL, pred: str = PRED) -> DataFrame:
    """Add the signed and the absolute error of each prediction."""
    error = F.col(pred) - F.col(label)
    return scored.withColumns({"error_ms": error, "abs_error_ms": F.abs(error)})


def metrics(scored: DataFrame, label: str = LABEL, pred: str = PRED) -> DataFrame:
    """MAE, RMSE, largest error, bias and R² of the labelled rows."""
    table = drop_unlabelled(scored, label)
    error = F.col(pred) - F.col(label)
    return table.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.max(F.abs(error)).alias("max_error"),
        F.avg(error).alias("bias"),
        (1 - F.avg(error * error) / F.nullif(F.var_pop(label), F.lit(0.0))).alias("r2"),
    )


def worst_predictions(
    scored: DataFrame, k: int = 10, id: str = "wave_id", label: str = LABEL
) -> DataFrame:
    """The ``k`` waves with the largest absolute error; ties go to the smaller id."""
    table = residuals(scored, label)
    top = smallest(table, [F.desc("abs_error_ms"), F.col(id)], k)
    return top.select(id, label, PRED, "error_ms")


def diagnosis_report(scored: DataFrame, label: str = LABEL, id: str = "wave_id") -> DataFrame:
    """Features, label, prediction and both errors of each wave."""
    rest = [c for c in scored.columns if c not in (id, label, PRED)]
    table = residuals(drop_unlabelled(scored, label), label)
    return table.select(id, label, *rest, PRED, "error_ms", "abs_error_ms")


def train_with_predictions(
    scored: DataFrame, label: str = LABEL, id: str = "wave_id"
) -> DataFrame:
    """The diagnosis report without the absolute error."""
    return diagnosis_report(scored, label, id).drop("abs_error_ms")


def numeric_features(df: DataFrame, label: str = LABEL, id: str = "wave_id") -> list[str]:
    """The columns a model can use as they are: numeric and boolean ones."""
    usable = {f.name for f in df.schema.fields if isinstance(f.dataType, (NumericType, BooleanType))}
    return [c for c in feature_columns(df, label, id=id) if c in usable]


def fit_linear(
    df: DataFrame, features: Sequence[str], y: str = LABEL, id: str = "wave_id"
) -> PipelineModel:
    """Least squares of some features."""
    table = _numeric(drop_unlabelled(df, y), [*features, y]).select(id, *features, y)
    return _pipeline(features, y, LinearRegression(solver="normal", regParam=0.0)).fit(table)


def fit_line(
    df: DataFrame, x: str, y: str = LABEL, id: str = "wave_id"
) -> tuple[PipelineModel, DataFrame]:
    """Least squares of one feature: the model, and its slope and intercept as a row."""
    model = fit_linear(df, [x], y, id)
    line = model.stages[-1]
    row = [(float(line.coefficients[0]), float(line.intercept))]
    return model, df.sparkSession.createDataFrame(row, "slope double, intercept double")


def permutation_importance(
    df: DataFrame,
    model: PipelineModel,
    features: Sequence[str],
    label: str = LABEL,
    repeats: int = 5,
    seed: int = 0,
    id: str = "wave_id",
    key: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Per feature the mean rise of the absolute error when its values are shuffled.

    Each repeat has a random order of its own, of hashes of id, seed and repeat; the row
    at a place in the order of ids gets the values of the row at that place in the random
    order.  All repeats are sorted and joined at once.  ``key`` replaces the hash; it is
    given the number of the repeat.
    """
    features = list(features)
    error = F.abs(F.col(PRED) - F.col(label))
    table = score(_numeric(drop_unlabelled(df, label), [label]), model, features, id)
    table = freeze(number_rows(table.select(id, label, *features, error.alias("_base")), [id], "_row"))
    rows = table.count()
    rounds = table.withColumn("_repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = F.xxhash64(id, F.lit(seed), "_repeat") if key is None else key(F.col("_repeat"))
    # the repeats follow one another, so a place in this order is repeat * rows + place
    donors = number_rows(
        rounds.select("_repeat", order.alias("_key"), id, *[F.col(c).alias(f"_other_{c}") for c in features]),
        ["_repeat", "_key", id], "_place")
    places = rounds.withColumn("_place", F.col("_repeat") * F.lit(rows) + F.col("_row"))
    joined = places.join(donors.drop("_repeat", "_key", id), "_place")
    variants = [
        F.struct(
            F.lit(c).alias("feature"),
            *[F.col(f"_other_{o}" if o == c else o).alias(o) for o in features],
        )
        for c in features
    ]
    shuffled = joined.select("_repeat", label, "_base", F.inline(F.array(*variants)))
    rises = model.transform(shuffled).groupBy("feature", "_repeat").agg(
        F.avg(error - F.col("_base")).alias("_rise")
    )
    summary = rises.groupBy("feature").agg(
        F.avg("_rise").alias("importance"), F.stddev_samp("_rise").alias("stddev")
    )
    return importance_stats(summary, repeats)


def top_importances(importance: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` most important features."""
    return importance.orderBy(F.desc("importance"), "feature").limit(k)
