"""Settle rules and features against direct numpy statements."""

import numpy as np
import pytest

from settlespark import Rule, Signals
from settlespark.operators.features import grouped_features
from settlespark.operators.settle import labels, settle
from tests import waves as w

PLANS = {"windows": 10_000, "ranges": 20}


def by_wave(df):
    return {r["wave_id"]: r for r in df.collect()}


@pytest.fixture(scope="module", params=list(PLANS))
def hot_rows(request):
    return PLANS[request.param]


@pytest.mark.parametrize("rule, brute", [
    (Rule(), w.hold_index),
    (Rule(hold=10, tol=0.05), lambda x: w.hold_index(x, 10, 0.05)),
    (Rule("exit"), w.exit_index),
    (Rule("exit", tol=0.02), lambda x: w.exit_index(x, 2.0)),
    (Rule("exit", never_out="last"), lambda x: w.exit_index(x, reset=len(x) - 1)),
    (Rule("suffix"), w.suffix_index),
])
@pytest.mark.parametrize("gaps", [False, True])
def test_settle_index(spark, hot_rows, rule, brute, gaps):
    waves = w.random_waves(gaps=gaps)
    sig = Signals(spark.createDataFrame(w.frame(waves)), hot_rows=hot_rows)
    got = by_wave(settle(sig, rule))
    assert got.keys() == waves.keys()
    wrong = {k: (got[k]["settle_idx"], brute(x)) for k, x in waves.items()
             if got[k]["settle_idx"] != brute(x)}
    assert not wrong
    assert all(np.isclose(got[k]["wait_time_ms"], got[k]["settle_idx"] * 0.01) for k in waves)


def check_features(got, waves, brute, shortest):
    for k, x in waves.items():
        if len(x) < shortest:
            assert all(got[k][f] is None for f in brute(np.ones(20)))
            continue
        for name, value in brute(x).items():
            assert np.isclose(got[k][name], value, rtol=1e-9, atol=1e-9, equal_nan=True), (k, name)


@pytest.mark.parametrize("gaps", [False, True])
def test_current_features(spark, hot_rows, gaps):
    waves = w.random_waves(gaps=gaps)
    sig = Signals(spark.createDataFrame(w.frame(waves)), hot_rows=hot_rows)
    check_features(by_wave(grouped_features(sig)), waves, w.current_features, 10)


def test_current_features_skip_missing(spark, hot_rows):
    waves = w.random_waves(gaps=True)
    sig = Signals(spark.createDataFrame(w.frame(waves)), hot_rows=hot_rows, missing="skip")
    clean = {k: x[~np.isnan(x)] for k, x in waves.items()}
    clean = {k: x for k, x in clean.items() if len(x)}
    check_features(by_wave(grouped_features(sig)), clean, w.current_features, 10)


@pytest.mark.parametrize("gaps", [False, True])
def test_classic_features(spark, hot_rows, gaps):
    waves = {k: x for k, x in w.random_waves(gaps=gaps).items() if len(x) >= 5}
    sig = Signals(spark.createDataFrame(w.frame(waves)), hot_rows=hot_rows)
    check_features(by_wave(grouped_features(sig, "classic")), waves, w.classic_features, 5)


def test_label_beside_classic_features(spark):
    waves = {k: x for k, x in w.random_waves().items() if len(x) >= 5}
    sig = Signals(spark.createDataFrame(w.frame(waves)))
    got = by_wave(grouped_features(sig, "classic", label=Rule()))
    for k, x in waves.items():
        assert got[k]["settle_idx"] == w.suffix_index(x)
        assert np.isclose(got[k]["wait_time_ms"], w.hold_index(x) * 0.01)


def test_label_kept_for_short_waves(spark):
    sig = Signals(spark.createDataFrame(w.frame({1: np.arange(6.0), 2: np.ones(80)})))
    got = by_wave(grouped_features(sig, label=Rule()))
    assert got[1]["x_end"] is None and np.isclose(got[1]["wait_time_ms"], 0.05)
    assert got[2]["x_end"] == 1.0 and got[2]["wait_time_ms"] == 0.0


def test_classic_features_refuse_short_waves(spark):
    sig = Signals(spark.createDataFrame(w.frame({1: np.arange(4.0), 2: np.ones(80)})))
    with pytest.raises(Exception, match="shorter than the 5 samples"):
        grouped_features(sig, "classic").collect()


N, M = 200, 50


def _one_out(at):
    x = np.ones(N)
    x[at] = 2.0
    return x


@pytest.mark.parametrize("x, hold, exit_, suffix", [
    (np.full(N, 3.0), 0, 0, 0),
    (np.full(30, 3.0), 29, 0, 0),
    (_one_out(0), 50, 1, 1),
    (_one_out(N - 50), N - 1, N - 49, N - 49),
    (_one_out(N - 51), N - 1, N - 50, N - 50),
    (-_one_out(10), 60, 11, 11),
])
def test_edges(spark, x, hold, exit_, suffix):
    sig = Signals(spark.createDataFrame(w.frame({1: x})))
    got = [settle(sig, Rule(r)).first()["settle_idx"] for r in ("hold", "exit", "suffix")]
    assert got == [hold, exit_, suffix]


def test_last_sample_out(spark):
    sig = Signals(spark.createDataFrame(w.frame({1: _one_out(N - 1)})))
    assert settle(sig).first()["settle_idx"] == N - 1


def test_zero_target_needs_a_floor(spark):
    x = np.zeros(N)
    x[20] = 1e-6
    sig = Signals(spark.createDataFrame(w.frame({1: x})))
    assert settle(sig).first()["settle_idx"] == 70
    assert settle(sig, Rule(abs_tol=1e-3)).first()["settle_idx"] == 0


def test_missing_samples_in_the_tail(spark):
    x = _one_out(10)
    x[-3] = w.NAN
    df = spark.createDataFrame(w.frame({1: x}))
    assert settle(Signals(df)).first()["settle_idx"] == 0
    assert settle(Signals(df, missing="skip")).first()["settle_idx"] == 60


def test_null_ids_and_null_values(spark):
    rows = [(None, 0, 0.0, 1.0)] + [(1, i, i * 0.01, None if i == 5 else 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "wave_id long, sample long, time_ms double, value double")
    got = grouped_features(Signals(df), ["mean_all"], label=Rule()).collect()
    assert [r["wave_id"] for r in got] == [1] and np.isnan(got[0]["mean_all"])
    assert grouped_features(Signals(df, missing="skip"), ["mean_all"]).first()["mean_all"] == 1.0


def test_anchor(spark):
    sig = Signals(spark.createDataFrame(w.frame({1: _one_out(10)})))
    assert settle(sig, Rule(anchor="exit")).first()["settle_idx"] == 11


def test_unknown_options_are_refused(spark):
    with pytest.raises(ValueError):
        Rule("median")
    sig = Signals(spark.createDataFrame(w.frame({1: np.ones(20)})))
    with pytest.raises(ValueError, match="unknown feature"):
        grouped_features(sig, ["nothing"])
    with pytest.raises(ValueError, match="not found"):
        Signals(sig.df, value="force")


def test_methods(spark):
    sig = Signals(spark.createDataFrame(w.frame({1: _one_out(10)})), hot_rows=None)
    assert sig.settle("exit").first()["settle_idx"] == 11
    assert np.isclose(sig.labels(anchor="exit").first()["wait_time_ms"], 0.11)
    assert sig.features(["x_end"]).first()["x_end"] == 1.0
    assert len(sig.wide(range(N)).columns) == N + 1
    assert len(sig.array().first()["values"]) == N


@pytest.mark.parametrize("parts", [1, 7])
def test_row_order_does_not_matter(spark, hot_rows, parts):
    waves = w.random_waves(30)
    table = w.frame(waves).sample(frac=1.0, random_state=3)
    base = labels(Signals(spark.createDataFrame(w.frame(waves)))).toPandas()
    df = spark.createDataFrame(table).repartition(parts)
    got = labels(Signals(df, hot_rows=hot_rows)).toPandas()
    key = ["wave_id"]
    assert got.sort_values(key).reset_index(drop=True).equals(
        base.sort_values(key).reset_index(drop=True))


@pytest.mark.parametrize("rule", ["exit", "suffix"])
def test_index_on_the_band_does_not_depend_on_the_plan(spark, rule):
    """Samples lie exactly on the band, where the last bit of a mean decides."""
    rng = np.random.default_rng(3)
    waves = {}
    for k in range(8):
        x = np.round(5 + rng.normal(0, 0.001, 4000), 12)
        target = x[-400:].mean() if rule == "exit" else x[-10:].mean()
        band = 0.01 * target if rule == "exit" else max(3 * x[-10:].std(), 1e-12)
        x[:1400] = np.where(np.arange(1400) % 2 == 0, target + band, target - band)
        waves[k] = x
    df = spark.createDataFrame(w.frame(waves))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    try:
        for hot_rows, parts in ((None, 4), (None, 7), (1000, 4), (300, 5)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = settle(Signals(df.repartition(parts), hot_rows=hot_rows), Rule(rule)).orderBy("wave_id")
            seen.add(tuple((r["settle_idx"], r["target"], r["tolerance"]) for r in got.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1
