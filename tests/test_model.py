"""Training, scoring, importance and its statistics."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import LinearRegression

from settlespark.functions.stats import importance_stats, t_cdf, t_quantile
from settlespark.operators import model as mo
from settlespark.sources import io


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 400
    a, b = rng.normal(0, 1, n), rng.normal(0, 1, n)
    return spark.createDataFrame(pd.DataFrame({
        "wave_id": np.arange(n), "wait_time_ms": 3 * a - b + 5 + rng.normal(0, 0.01, n),
        "a": a, "b": b, "flat": 1.0, "temp_C": 20.0,
    }))


@pytest.fixture(scope="module")
def trained(table):
    candidates = {"linear": LinearRegression(regParam=0.0), **{
        k: v for k, v in mo.default_candidates().items() if k == "tree"}}
    return mo.train_regressor(table, candidates=candidates)


def test_training_keeps_id_and_meta_out(trained):
    assert trained.features == ["a", "b", "flat"]
    assert trained.best == "linear" and trained.scores[0][1] > -0.02


def test_leaderboard(spark, trained):
    rows = mo.leaderboard(spark, trained).collect()
    assert [r["model"] for r in rows] == ["linear", "tree"]
    assert rows[0]["score_val"] > rows[1]["score_val"]


def test_ensemble_of_predictions_for_unseen_waves(spark, table):
    from pyspark.sql import functions as F
    candidates = {name: LinearRegression(regParam=p, solver="normal") for name, p in (
        ("linear", 0.0), ("shrunk", 3.0), ("flat", 1e12))}
    oof = mo.out_of_fold(table, candidates, F.col("wave_id") % 4, 4, ["a"])
    got = oof.toPandas().sort_values("wave_id")
    data = table.toPandas().sort_values("wave_id")
    assert got["wave_id"].tolist() == data["wave_id"].tolist()
    for part in range(4):
        rest, inside = data[data.wave_id % 4 != part], data[data.wave_id % 4 == part]
        slope, intercept = np.polyfit(rest["a"], rest["wait_time_ms"], 1)
        mine = got[got.wave_id % 4 == part]
        assert np.allclose(mine["linear"], slope * inside["a"] + intercept)
        assert np.allclose(mine["flat"], rest["wait_time_ms"].mean())
    names, counts, rounds = list(candidates), np.zeros(3), 8
    for _ in range(rounds):
        tries = [np.abs(got[names].to_numpy() @ (counts + e) / (counts.sum() + 1) - got["wait_time_ms"]).mean()
                 for e in np.eye(3)]
        counts += np.eye(3)[int(np.argmin(tries))]
    rows = mo.select_ensemble(oof, names, rounds).collect()
    assert [r.weight for r in rows] == (counts / rounds).tolist()
    assert abs(rows[0].ensemble_mae - min(tries)) < 1e-9
    with pytest.raises(ValueError, match="labelled"):
        mo.select_ensemble(oof.limit(0), names)
    with pytest.raises(Exception, match="none of the folds"):
        mo.out_of_fold(table, candidates, F.col("wave_id") % 5, 4, ["a"])


def test_time_limit_stops_after_the_first_candidate(table):
    trained = mo.train_regressor(table, time_limit=0)
    assert [s[0] for s in trained.scores] == ["linear"]
    assert trained.skipped == ["tree", "forest", "boosted"]
    board = mo.leaderboard(table.sparkSession, trained).collect()
    assert [r["score_val"] is None for r in board] == [False, True, True, True]


def test_training_needs_held_out_waves(table):
    few = table.limit(1)
    line = {"linear": LinearRegression()}
    with pytest.raises(ValueError, match="held out"):
        mo.train_regressor(few, candidates=line, holdout=1e-9)
    assert not mo.train_regressor(table, candidates=line, holdout=0).held_out


def test_text_columns_are_no_features(table):
    from pyspark.sql import functions as F
    mixed = table.withColumns({"kind": F.lit("x"), "ok": F.lit(True), "n": F.lit(1)})
    trained = mo.train_regressor(mixed, candidates={"linear": LinearRegression(regParam=0.1)})
    assert trained.features == ["a", "b", "flat", "ok", "n"]


def test_score_fills_missing_features(spark, table, trained):
    rows = spark.createDataFrame(
        [(1, None, 0.0, 1.0, "m")], "wave_id long, a double, b double, flat double, note string")
    got = mo.score(rows, trained.model, trained.features)
    assert got.columns == ["wave_id", "pred_wait_time_ms", "a", "b", "flat", "note"]
    assert abs(got.first()["pred_wait_time_ms"] - 5) < 0.6


def test_saved_model_scores_the_same(table, trained, tmp_path):
    path = str(tmp_path / "model")
    io.save_model(trained.model, path)
    def scores(m):
        return mo.score(table, m, trained.features).orderBy("wave_id").toPandas()
    assert scores(trained.model).equals(scores(io.load_model(path)))


def test_split_by_id(table):
    train, held = mo.split_waves(table, 0.25, seed=3)
    assert train.count() + held.count() == 400 and 60 < held.count() < 140
    assert train.join(held, "wave_id").count() == 0


def test_metrics_and_reports(spark):
    rows = [(1, 1.0, 1.5), (2, 2.0, 1.0), (3, 3.0, 3.0), (4, None, 9.0)]
    scored = spark.createDataFrame(rows, "wave_id long, wait_time_ms double, pred_wait_time_ms double")
    m = mo.metrics(scored).first()
    assert m["n"] == 3 and math.isclose(m["mae"], 0.5) and math.isclose(m["bias"], -0.5 / 3)
    assert math.isclose(m["r2"], 1 - 1.25 / 2)
    worst = mo.worst_predictions(scored.filter("wave_id < 4"), k=2).collect()
    assert [r["wave_id"] for r in worst] == [2, 1]
    assert mo.diagnosis_report(scored).count() == 3
    assert "abs_error_ms" not in mo.train_with_predictions(scored).columns


def test_importance(table, trained):
    rows = mo.permutation_importance(table, trained.model, trained.features)
    got = {r["feature"]: r for r in rows.collect()}
    assert got["a"]["importance"] > got["b"]["importance"] > 0.5
    assert got["flat"]["importance"] == 0.0 and got["flat"]["p_value"] == 0.5
    assert got["flat"]["p99_high"] == got["flat"]["p99_low"] == 0.0
    assert got["a"]["p_value"] < 1e-4
    top = mo.top_importances(rows, 2).collect()
    assert [r["feature"] for r in top] == ["a", "b"]


def test_repeats_are_different_permutations(spark):
    """With the row's own place as only feature, a prediction tells where it came from."""
    n = 2000
    df = spark.range(n).selectExpr("id AS wave_id", "0.0D AS wait_time_ms", "CAST(id AS DOUBLE) AS a")
    model = mo.fit_linear(df.withColumn("wait_time_ms", df.a), ["a"])
    seen = []
    for repeats in (2, 3):
        rises = mo.permutation_importance(df, model, ["a"], repeats=repeats).first()
        # the values are only moved, so their sum stays
        assert abs(rises["importance"]) < 1e-6
    for seed in (0, 1):
        target = df.withColumn("wait_time_ms", df.a)
        rises = mo.permutation_importance(target, model, ["a"], repeats=5, seed=seed).first()
        # the mean distance of two random places is a third of their number
        assert abs(rises["importance"] / n - 1 / 3) < 0.02 and 0 < rises["stddev"] < 0.02 * n
        seen.append(rises["importance"])
    assert seen[0] != seen[1]


def test_importance_plan_does_not_grow_with_the_repeats(table, trained):
    plans = [
        mo.permutation_importance(table, trained.model, trained.features, repeats=k)
        ._jdf.queryExecution().executedPlan().toString() for k in (2, 5)]
    counts = [p.count("Exchange") for p in plans]
    assert counts[0] == counts[1] < 10


# Quantiles of Student's t distribution.
@pytest.mark.parametrize("df, p, t", [
    (1, 0.975, 12.706204736), (2, 0.975, 4.302652730), (3, 0.975, 3.182446305),
    (4, 0.995, 4.604094871), (5, 0.995, 4.032142984), (9, 0.995, 3.249835542),
    (10, 0.99, 2.763769458),
])
def test_t_distribution(spark, df, p, t):
    assert math.isclose(t_quantile(p, df), t, rel_tol=1e-8)
    from pyspark.sql import functions as F
    got = spark.range(1).select(t_cdf(F.lit(t), df), t_cdf(F.lit(-t), df)).first()
    assert math.isclose(got[0], p, rel_tol=1e-8) and math.isclose(got[1], 1 - p, rel_tol=1e-6)


def test_importance_stats_without_spread(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (-1.0, 0.0), (1.0, 0.5)],
                               "importance double, stddev double")
    got = importance_stats(df, 5).toPandas()
    assert list(got["p_value"][:3]) == [0.5, 0.0, 1.0] and got["p_value"][3] < 0.01
    with pytest.raises(ValueError):
        importance_stats(df, 1)
