"""The whole course from raw waves to reviewed predictions, file to file.

Each step reads tables, runs operators and writes tables; the steps can also be
called without files by composing the operators directly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlespark.functions.features import CURRENT
from settlespark.operators import model as mo
from settlespark.operators import review as rv
from settlespark.operators.features import grouped_features
from settlespark.operators.reshape import (
    append_features, non_series_columns, to_long, wide_plus_features,
)
from settlespark.operators.settle import Rule, labels
from settlespark.plans.skew import scratch
from settlespark.signals import Signals
from settlespark.sources import io


def _scratch(sig: Signals):
    """Intermediate tables of a step go when it has written its result."""
    sig.hot_ids  # belongs to the caller's table and is found before
    return scratch(sig.df.sparkSession)


def training_features(
    sig: Signals, out: str, features: str | Sequence[str] = CURRENT, rule: Rule = Rule(),
    format: str = "parquet",
) -> None:
    """Write the feature table with labels."""
    with _scratch(sig):
        io.write_table(grouped_features(sig, features, label=rule), out, format)


def label_table(
    sig: Signals, out: str, rule: Rule = Rule(), format: str = "parquet",
) -> None:
    """Write the label file: wave id and wait time."""
    with _scratch(sig):
        io.write_table(labels(sig, rule), out, format)


def classic_features_of_wide(
    wide: DataFrame, id: str = "wave_id", features: str | Sequence[str] = "classic",
) -> DataFrame:
    """The columns of a wide table that are no samples, with features of its samples.

    Missing samples are left out, so positions close up.
    """
    long = to_long(wide, id).withColumn("time_ms", F.col("sample").cast("double"))
    table = grouped_features(Signals(long, id=id), features)
    return append_features(non_series_columns(wide), table, id)


def scoring_table(
    sig: Signals, out: str, samples: Sequence[int] | None = None,
    features: str | Sequence[str] = CURRENT, format: str = "parquet",
) -> None:
    """Write the wide scoring table with meta columns and features."""
    with _scratch(sig):
        io.write_table(wide_plus_features(sig, samples, features), out, format)


def train(
    table: DataFrame, out: str, label: str = mo.LABEL, id: str = "wave_id",
    time_limit: float = 120.0, run_id: str | None = None, holdout: float = 0.2,
) -> tuple[str, mo.Trained]:
    """Fit a model and write it with its diagnosis; returns the run id and the model.

    Written per run below ``out``: ``model``, ``leaderboard``, ``diagnosis`` and
    ``train_with_predictions`` of all labelled rows, ``metrics`` and ``importance`` of
    the held-out waves.  ``held_out`` in the diagnosis tells the waves kept out of
    training from the others, whose errors are in-sample.
    """
    run_id = run_id or io.new_run_id()
    spark = table.sparkSession
    trained = mo.train_regressor(table, label, id=id, time_limit=time_limit, holdout=holdout)
    io.save_model(trained.model, f"{out}/model/{run_id}")
    scored = mo.score(table.select(id, label, *trained.features), trained.model, trained.features, id)
    held = mo.split_waves(scored, holdout, id=id)[1] if trained.held_out else scored
    apart = mo.held_out(holdout, id=id) if trained.held_out else F.lit(False)
    with scratch(spark):
        importance = mo.permutation_importance(
            held.drop(mo.PRED), trained.model, trained.features, label, id=id
        )
        for name, df in (
            ("leaderboard", mo.leaderboard(spark, trained)),
            ("diagnosis", mo.diagnosis_report(scored, label, id).withColumn("held_out", apart)),
            ("train_with_predictions", mo.train_with_predictions(scored, label, id)),
            ("metrics", mo.metrics(held, label)),
            ("importance", importance),
        ):
            io.write_run(df, f"{out}/{name}", run_id)
    return run_id, trained


def predict(
    spark: SparkSession, model_path: str, table: DataFrame, out: str, id: str = "wave_id",
    format: str = "parquet",
) -> None:
    """Score a feature table with a saved model and write the predictions."""
    model = io.load_model(model_path)
    io.write_table(mo.score(table, model, mo.model_features(model), id), out, format)


def review(
    sig: Signals, result: DataFrame, mode: str, order: str, out: str,
    per_page: int = rv.PER_PAGE,
) -> None:
    """Write the review table, the points to draw and the list of their files.

    The files of the points follow one another in drawing order, and the list, written
    last, names the pages each of them holds (:func:`read_page`).
    """
    with _scratch(sig):
        io.write_table(rv.review_table(sig, result, mode, order, per_page), f"{out}/{mode}")
        points = f"{out}/{mode}_points"
        io.write_table(rv.overlay(sig, result, mode, order, per_page), points)
        written = io.read_signals(sig.df.sparkSession, points)
        io.write_table(rv.page_files(written, sig.id, sig.time).coalesce(1), f"{out}/{mode}_pages")


def read_page(spark: SparkSession, out: str, mode: str, page: int) -> DataFrame:
    """The points of one page of a written review; only the files that hold it are opened."""
    points = f"{out}/{mode}_points"
    files = [r.file for r in io.read_signals(spark, f"{out}/{mode}_pages").filter(
        (F.col("first.page") <= page) & (F.col("last.page") >= page)).select("file").collect()]
    if not files:
        return io.read_signals(spark, points).filter(F.lit(False))
    return spark.read.parquet(*[f"{points}/{f}" for f in files]).filter(F.col("page") == page)
