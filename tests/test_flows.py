"""From raw waves to reviewed predictions through files."""

import numpy as np
import pytest

from settlespark import Rule, Signals
from settlespark.plans import flows
from settlespark.sources import io
from tests import waves as w


def settling(count, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(300)
    return {
        k: 3 + rng.uniform(0.5, 2) * np.exp(-t / rng.uniform(10, 40)) * np.cos(t / 4)
        + rng.normal(0, 0.001, len(t)) for k in range(count)
    }


def test_the_whole_course(spark, tmp_path):
    out = str(tmp_path)
    raw = spark.createDataFrame(w.frame(settling(120, 1)))
    flows.training_features(Signals(raw), f"{out}/features")
    features = io.read_signals(spark, f"{out}/features")
    assert features.count() == 120 and features.columns[:2] == ["wave_id", "wait_time_ms"]

    run, trained = flows.train(features, out, time_limit=10.0, run_id="20250101_000000")
    diagnosis = io.read_run(spark, f"{out}/diagnosis", run)
    assert diagnosis.count() == 120 and "abs_error_ms" in diagnosis.columns
    assert io.read_run(spark, f"{out}/importance", run).count() == len(trained.features) == 8
    spread = np.std([w.hold_index(x) * 0.01 for x in settling(120, 1).values()])
    assert io.read_run(spark, f"{out}/metrics", run).first()["mae"] < spread

    fresh = spark.createDataFrame(w.frame(settling(30, 2))).withColumnRenamed("time_ms", "time")
    sig = Signals(fresh, time="time")
    flows.scoring_table(sig, f"{out}/scoring", samples=range(300))
    scoring = io.read_signals(spark, f"{out}/scoring")
    flows.predict(spark, f"{out}/model/{run}", scoring, f"{out}/predictions.csv", format="csv")
    pred = io.read_signals(spark, f"{out}/predictions.csv", infer=True)
    assert pred.columns[:2] == ["wave_id", "pred_wait_time_ms"] and pred.count() == 30
    assert len([c for c in pred.columns if c.startswith("i_")]) == 300

    result = pred.select("wave_id", "pred_wait_time_ms").selectExpr("*", "0 AS run")
    flows.review(sig, result, "check_pred", "run", f"{out}/review")
    assert io.read_signals(spark, f"{out}/review/check_pred").count() == 30
    assert set(diagnosis.columns) >= {"held_out"} and 0 < diagnosis.filter("held_out").count() < 60

    flows.label_table(Signals(raw), f"{out}/labels.csv", format="csv")
    labels = io.read_signals(spark, f"{out}/labels.csv", infer=True)
    assert labels.columns == ["wave_id", "wait_time_ms"] and labels.count() == 120
    classic = flows.classic_features_of_wide(scoring.select("wave_id", *[c for c in scoring.columns if c.startswith("i_")]))
    assert classic.count() == 30 and "settle_idx" in classic.columns and "i_0" not in classic.columns

    points = io.read_signals(spark, f"{out}/review/check_pred_points")
    assert points.count() == 9000 and points.filter("page = 1").count() == 3000


def test_bucketed_table_needs_no_exchange(spark, tmp_path):
    raw = spark.createDataFrame(w.frame(settling(10, 1)))
    io.write_bucketed(raw, "bucketed_waves", str(tmp_path / "t"), buckets=4)
    sig = Signals(spark.table("bucketed_waves"))
    from settlespark.operators.features import grouped_features
    df = grouped_features(sig, label=Rule())
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 10


def test_checkpoint_folder_comes_from_the_session(spark):
    from settlespark.plans.skew import checkpoint_dir
    assert spark.conf.get("spark.checkpoint.dir") in checkpoint_dir(spark)



def test_bad_arguments(spark):
    raw = spark.createDataFrame(w.frame({1: np.ones(20)}))
    with pytest.raises(ValueError):
        Signals(raw, missing="drop")
