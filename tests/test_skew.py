"""Exact results for waves that are cut into ranges, and the shape of the plans."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from settlespark import Rule, Signals
from settlespark.operators import sequence as seq
from settlespark.operators.features import apply_per_wave, fold_per_wave, fold_ranges, grouped_features
from settlespark.operators.joins import lookup_result
from settlespark.operators.review import id_rank, post_settle_stats
from settlespark.operators.settle import settle
from settlespark.plans.skew import _FROZEN, exact_median, number_rows
from tests import waves as w


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 2, 999, 1000, 5001])
@pytest.mark.parametrize("kind", ["spread", "ties", "outlier"])
def test_exact_median(spark, n, kind):
    rng = np.random.default_rng(n)
    x = rng.normal(0, 1, n)
    if kind == "ties":
        x = np.round(x)
    if kind == "outlier":
        x[0] = 1e300
    df = spark.createDataFrame(pd.DataFrame({"id": 1, "x": x})).repartition(4)
    got = exact_median(df, "id", "x", "m", groups=1, accuracy=100).first()["m"]
    assert got == np.median(x)


def test_exact_median_narrows_its_bracket(spark):
    """Several rounds, ranks at the ends of a bracket, NaN, infinities and two values."""
    rng = np.random.default_rng(1)
    two = (np.arange(4001) % 2).astype(float)
    tail = np.exp(rng.normal(0, 1, 6000) * 30)
    waves = {
        0: rng.normal(0, 1, 9000), 1: two, 2: np.r_[np.zeros(2000), np.ones(2000)], 3: tail,
        4: np.r_[rng.normal(0, 1, 1000), np.full(2000, np.nan)], 5: np.r_[np.full(3000, -np.inf), np.full(10, np.inf)],
        6: np.array([4.0]), 7: np.full(5000, 2.5)}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"id": k, "x": x}) for k, x in waves.items()])).repartition(4)
    got = {r["id"]: r["m"] for r in exact_median(df, "id", "x", "m", groups=8, accuracy=100, held=20).collect()}
    for k, x in waves.items():
        x = np.sort(x)
        want = (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2
        assert got[k] == want or (np.isnan(got[k]) and np.isnan(want)), k


def test_exact_median_ranks_no_wave_in_one_task(spark):
    df = spark.range(1000).select(F.lit(1).alias("id"), F.col("id").cast("double").alias("x"))
    assert "Window" not in plan(exact_median(df, "id", "x", "m", groups=1))


def test_number_rows_is_a_global_rank(spark):
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_007).alias("k"))
    got = number_rows(df, ["k"], "rank").toPandas().sort_values("k")
    assert list(got["rank"]) == list(range(10_000))


def test_one_wave_holds_most_rows(spark):
    rng = np.random.default_rng(5)
    t = np.arange(60_000)
    big = 5 + np.exp(-t / 9000) * np.sin(t / 50) + rng.normal(0, 0.01, len(t))
    waves = {0: big, **{k: x for k, x in w.random_waves(20).items() if k}}
    df = spark.createDataFrame(w.frame(waves))
    sig = Signals(df, hot_rows=1000)
    assert sig.hot_count == 1
    got = {r["wave_id"]: r for r in grouped_features(sig, label=Rule()).collect()}
    for k, x in waves.items():
        assert np.isclose(got[k]["wait_time_ms"], w.hold_index(x) * 0.01)
        if len(x) >= 10:
            for name, value in w.current_features(x).items():
                assert np.isclose(got[k][name], value, rtol=1e-9), name


@pytest.mark.parametrize("hot_rows", [10_000, 20])
def test_sequence_operators(spark, hot_rows):
    waves = w.random_waves(30, gaps=True)
    sig = Signals(spark.createDataFrame(w.frame(waves)), hot_rows=hot_rows)
    pos = seq.with_position(sig).toPandas()
    assert (pos["pos"] == pos["sample"]).all()
    assert all(pos[pos.wave_id == k]["n"].iloc[0] == len(x) for k, x in waves.items())
    dx = seq.with_diff(sig).toPandas().sort_values(["wave_id", "sample"])
    held = seq.hold_ok(sig, F.lit(1.0), F.lit(0.3), 12).toPandas().sort_values("sample")
    stay = seq.stays_within(sig, F.lit(1.0), F.lit(0.3)).toPandas().sort_values("sample")
    tail = seq.tail(sig, frac=0.1).toPandas()
    for k, x in waves.items():
        np.testing.assert_array_equal(dx[dx.wave_id == k]["dx"].to_numpy()[1:], np.diff(x))
        out = np.abs(x - 1.0) > 0.3
        want = [None if i > len(x) - 12 else not out[i:i + 12].any() for i in range(len(x))]
        assert [None if v is None else bool(v) for v in held[held.wave_id == k]["hold_ok"]] == want
        inside = np.abs(x - 1.0) <= 0.3
        want = [bool(inside[i:].all()) for i in range(len(x))]
        assert list(stay[stay.wave_id == k]["stays_within"]) == want
        assert len(tail[tail.wave_id == k]) == len(w.tail_of(x))


def test_hold_ok_looks_across_blocks(spark):
    x = np.zeros(500)
    x[430] = 1.0
    sig = Signals(spark.createDataFrame(w.frame({1: x})), hot_rows=10)
    part = sig.positioned()[1]
    got = seq._next_out(part, F.when(F.col("value") > 0.5, F.col("_pos")), block=100)
    rows = got.select("sample", "_next").toPandas().sort_values("sample")
    assert (rows["_next"][:431] == 430).all() and rows["_next"][431:].isna().all()


@pytest.mark.parametrize("hot_rows", [10_000, 20])
def test_results_reach_every_sample(spark, hot_rows):
    waves = w.random_waves(30)
    sig = Signals(spark.createDataFrame(w.frame(waves)), hot_rows=hot_rows)
    rows = [(k, r, float(k + r)) for k in range(0, 30, 2) for r in (0, 1)]
    result = spark.createDataFrame(rows, "wave_id long, run int, wait_time_ms double")
    got = lookup_result(sig, result, "wait_time_ms", "run").toPandas()
    assert len(got) == sum(map(len, waves.values()))
    for k, table in got.groupby("wave_id"):
        want = k + 1.0 if k % 2 == 0 else None
        assert table["wait_time_ms"].isna().all() if want is None else (
            table["wait_time_ms"] == want).all()
    lines = spark.createDataFrame([(k, 0.2) for k in range(0, 30, 2)], "wave_id long, t double")
    stats = {r["wave_id"]: r for r in post_settle_stats(sig, lines, "t").collect()}
    assert stats.keys() == waves.keys()
    for k, x in waves.items():
        after = x[np.arange(len(x)) * 0.01 >= 0.2]
        if k % 2 or not len(after):
            assert stats[k]["delta"] is None
        else:
            assert stats[k]["delta"] == after.max() - after.min()


def test_user_function_refuses_hot_waves(spark):
    sig = Signals(spark.createDataFrame(w.frame({1: np.ones(50)})), hot_rows=10)
    with pytest.raises(ValueError, match="hot_rows"):
        apply_per_wave(sig, lambda p: p, "wave_id long")


def test_fold_sees_every_sample_in_order(spark):
    waves = w.random_waves(12)
    waves[3] = np.arange(25_000.0)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 700)
    try:
        got = fold_per_wave(
            Signals(spark.createDataFrame(w.frame(waves)).repartition(6), hot_rows=50), list,
            lambda seen, block: seen + [list(block["sample"])],
            lambda wave, seen: {"wave_id": wave, "n": sum(map(len, seen)), "blocks": len(seen),
                                "sorted": sum(seen, []) == list(range(sum(map(len, seen))))},
            "wave_id long, n long, blocks long, sorted boolean").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r["wave_id"]: r["n"] for r in got} == {k: len(x) for k, x in waves.items()}
    assert all(r["sorted"] for r in got) and max(r["blocks"] for r in got) >= 35


def test_fold_of_a_large_wave_uses_many_tasks(spark):
    """Partial states of ranges, merged in order, equal the serial fold."""
    waves = w.random_waves(12)
    waves[3] = np.arange(25_000.0)
    sig = Signals(spark.createDataFrame(w.frame(waves)).repartition(6), hot_rows=50)

    def step(seen, block):
        return {"samples": seen["samples"] + list(block["sample"]), "ranges": seen["ranges"]}

    def merge(a, b):
        return {"samples": a["samples"] + b["samples"], "ranges": a["ranges"] + b["ranges"]}

    def finish(wave, seen):
        return {"wave_id": wave, "n": len(seen["samples"]), "ranges": seen["ranges"],
                "sorted": seen["samples"] == list(range(len(seen["samples"])))}

    got = fold_ranges(
        sig, lambda: {"samples": [], "ranges": 1}, step, merge, finish,
        "wave_id long, n long, ranges long, sorted boolean", rows_per_range=1000, merge_width=3).collect()
    assert {r["wave_id"]: r["n"] for r in got} == {k: len(x) for k, x in waves.items()}
    assert all(r["sorted"] for r in got)
    assert {r["wave_id"]: r["ranges"] for r in got}[3] >= 20


def test_small_ranges_need_no_task_each(spark):
    """Ranges of 100 samples are folded one by one, but all in the tasks of the session."""
    waves = w.random_waves(12)
    waves[3] = np.arange(60_000.0)
    sig = Signals(spark.createDataFrame(w.frame(waves)).repartition(6))

    def step(seen, block):
        return seen[:-1] + [seen[-1] + list(block["sample"])]

    def merge(a, b):
        return a + b

    def finish(wave, seen):
        joined = sum(seen, [])
        return {"wave_id": wave, "n": len(joined), "ranges": len(seen), "most": max(map(len, seen)),
                "sorted": joined == list(range(len(joined)))}

    before = len(_FROZEN)
    got = fold_ranges(
        sig, lambda: [[]], step, merge, finish,
        "wave_id long, n long, ranges long, most long, sorted boolean", rows_per_range=100, merge_width=2).collect()
    assert {r["wave_id"]: r["n"] for r in got} == {k: len(x) for k, x in waves.items()}
    assert all(r["sorted"] and r["most"] <= 100 for r in got)
    assert {r["wave_id"]: r["ranges"] for r in got}[3] >= 600
    files = spark.read.parquet(_FROZEN[before]).inputFiles()
    assert 1 < len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_features_and_label_need_one_exchange(spark, small):
    df = spark.read.parquet(f"{small}/lineitem.parquet").select(
        F.col("l_suppkey").alias("wave_id"), F.col("l_orderkey").alias("sample"),
        F.col("l_tax").alias("time_ms"), F.col("l_extendedprice").alias("value"),
        F.col("l_quantity").alias("quantity"),
    )
    text = plan(grouped_features(Signals(df), label=Rule()))
    assert text.count("Exchange") == 1 and text.count("Sort [") == 1
    assert "Python" not in text and "Pandas" not in text
    assert "l_quantity" not in text  # columns no role uses are not read
    both = plan(grouped_features(Signals(df), "classic", label=Rule(), meta=["quantity"]))
    assert both.count("Exchange") == 1


def test_features_without_position_are_not_sorted(spark):
    waves = w.random_waves(30)
    sig = Signals(spark.createDataFrame(w.frame(waves)), hot_rows=20)
    df = grouped_features(sig, ["x0", "x_end", "mean_all", "std_all"], min_length=1)
    text = plan(df)
    assert "Window" not in text and "Join" not in text and "Sort" not in text
    assert text.count("Exchange") == 1 and "partial_" in text
    for r in df.collect():
        x = waves[r["wave_id"]]
        assert np.allclose([r["x0"], r["x_end"], r["mean_all"], r["std_all"]],
                           [x[0], x[-1], x.mean(), x.std()])


def test_pushed_filter(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet").select(
        F.col("vec_id").alias("wave_id"), F.col("label").alias("sample"),
        F.col("label").alias("time_ms"), F.col("label").alias("value"))
    text = plan(seq.wave_slice(Signals(df), 7))
    assert "EqualTo(vec_id,7)" in text


def test_hot_plan_has_no_window_over_a_wave(spark):
    sig = Signals(spark.createDataFrame(w.frame({1: np.arange(100.0), 2: np.ones(30)})), hot_rows=50)
    hot = sig.positioned()[1]
    text = plan(hot.attach(m=F.max("value")).df)
    assert "Window" not in text and "BroadcastHashJoin" in text


def test_rank_has_no_single_partition_sort_of_ids(spark):
    got = id_rank(spark.range(1000).withColumnRenamed("id", "wave_id")).toPandas()
    assert (got["rank"] == got["wave_id"]).all()


def test_settle_of_equal_times(spark):
    table = w.frame({1: np.r_[np.full(20, 9.0), np.ones(80)]})
    table["time_ms"] = np.floor(table["time_ms"] * 10)
    assert settle(Signals(spark.createDataFrame(table))).first()["settle_idx"] == 69
