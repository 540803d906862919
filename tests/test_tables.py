"""Reshaping, roles, files and defects."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from settlespark import Signals
from settlespark.operators import joins, perturb, project, reshape, review
from settlespark.operators.features import grouped_features, signal_quality
from settlespark.sources import io
from tests import waves as w


@pytest.fixture(scope="module")
def sig(spark):
    return Signals(spark.createDataFrame(w.frame(w.random_waves(20))))


def ordered(df, *keys):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


def test_wide_and_back(spark, sig):
    wide = reshape.to_wide(sig)
    assert reshape.series_columns(wide) == [f"i_{k}" for k in range(200)]
    long = ordered(reshape.to_long(wide), "wave_id", "sample")
    want = ordered(sig.df.drop("time_ms"), "wave_id", "sample")
    assert (long.to_numpy() == want.to_numpy()).all()


def test_array_and_back(spark, sig):
    arrays = reshape.to_array(sig, chunk=64)
    assert arrays.agg(F.max(F.size("values"))).first()[0] == 64
    long = arrays.select("wave_id", "part", F.posexplode("values").alias("at", "value"))
    long = long.select("wave_id", (F.col("part") * 64 + F.col("at")).alias("sample"), "value")
    got, want = ordered(long, "wave_id", "sample"), ordered(sig.df, "wave_id", "sample")
    assert (got["value"] == want["value"]).all() and (got["sample"] == want["sample"]).all()


def test_duplicates_fail_the_pivot(spark):
    rows = [(1, 0, 0.0, 1.0), (1, 0, 0.0, 2.0), (2, 0, 0.0, 3.0)]
    sig = Signals(spark.createDataFrame(rows, "wave_id long, sample int, time_ms double, value double"))
    with pytest.raises(Exception, match="duplicate sample 0 of wave 1"):
        reshape.to_wide(sig).collect()
    wide = {r["wave_id"]: r["i_0"] for r in reshape.to_wide(sig, on_duplicate="max").collect()}
    assert wide == {1: 2.0, 2: 3.0}
    assert reshape.duplicate_samples(sig).collect()[0].asDict() == {"wave_id": 1, "sample": 0, "n": 2}
    assert signal_quality(sig).orderBy("wave_id").first()["n_duplicate"] == 1


def test_samples_without_a_column_are_not_lost(spark):
    waves = {1: np.arange(5.0), 2: np.arange(3.0)}
    sig = Signals(spark.createDataFrame(w.frame(waves)))
    with pytest.raises(Exception, match="sample [34] of wave 1 has no column"):
        reshape.to_wide(sig, range(3)).collect()
    assert reshape.to_long(reshape.to_wide(sig)).count() == 8
    chosen = reshape.to_wide(sig, [0, 4], select=True)
    assert chosen.columns == ["wave_id", "i_0", "i_4"]
    assert sorted(map(tuple, chosen.collect())) == [(1, 0.0, 4.0), (2, 0.0, None)]


@pytest.fixture
def few_pivots(spark):
    before = spark.conf.get("spark.sql.pivotMaxValues")
    spark.conf.set("spark.sql.pivotMaxValues", "10")
    yield
    spark.conf.set("spark.sql.pivotMaxValues", before)


def test_wide_beyond_the_pivot_equals_the_pivot(spark, few_pivots):
    rng = np.random.default_rng(4)
    rows = [(wave, int(k), float(k), [None, float("nan"), 0.5 * int(k)][int(rng.integers(3))])
            for wave in (1, 2, None, 3) for k in rng.choice(3000, 40, replace=False)]
    sig = Signals(spark.createDataFrame(rows, "wave_id long, sample int, time_ms double, value double"))
    samples = sorted({r[1] for r in rows if r[0] is not None})
    for missing, on_duplicate in [("propagate", "error"), ("skip", "max")]:
        own = sig.replace(sig.df, missing=missing)
        got = reshape.to_wide(own, on_duplicate=on_duplicate)
        spark.conf.set("spark.sql.pivotMaxValues", "10000")
        want = reshape.to_wide(own, on_duplicate=on_duplicate)
        chosen = reshape.to_wide(own, samples[::2], select=True)
        spark.conf.set("spark.sql.pivotMaxValues", "10")
        assert got.columns == want.columns and got.schema == want.schema
        pd.testing.assert_frame_equal(ordered(got, "wave_id"), ordered(want, "wave_id"))
        few = reshape.to_wide(own, samples[::2], select=True)
        pd.testing.assert_frame_equal(ordered(few, "wave_id"), ordered(chosen, "wave_id"))
    with pytest.raises(Exception, match="has no column"):
        reshape.to_wide(sig, samples[1:]).collect()
    twice = sig.replace(sig.df.union(sig.df.filter("wave_id = 2").limit(1)))
    with pytest.raises(Exception, match="duplicate sample"):
        reshape.to_wide(twice).collect()
    with pytest.raises(ValueError, match="negative"):
        reshape.to_wide(sig, range(-1, 20))


def test_wave_of_twenty_thousand_samples_is_wide(spark):
    rows = spark.range(2).select(F.col("id").alias("wave_id"), F.explode(F.sequence(F.lit(0), F.lit(19_999))).alias("sample"))
    sig = Signals(rows.filter("wave_id = 0 or sample % 7 = 0").withColumn("value", F.col("sample") * 0.5))
    wide = reshape.to_wide(sig)
    assert wide.columns == ["wave_id", *[f"i_{k}" for k in range(20_000)]]
    got = {r[0]: list(r[1:]) for r in wide.collect()}
    assert got[0] == [k * 0.5 for k in range(20_000)]
    assert got[1] == [None if k % 7 else k * 0.5 for k in range(20_000)]


def test_dense_arrays(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 2, 3.0), (1, 9, 9.0), (2, 3, 4.0), (2, 3, 5.0)],
                               "wave_id long, sample long, value double")
    sig = Signals(df)
    got = {(r[0], r[1]): r[2] for r in reshape.to_dense(sig, 4, "max").collect()}
    assert got == {(1, 0): [1.0, None, 3.0, None], (1, 2): [None, 9.0, None, None], (2, 0): [None, None, None, 5.0]}
    with pytest.raises(Exception, match="duplicate sample in segment 0 of wave 2"):
        reshape.to_dense(sig, 4).collect()
    with pytest.raises(Exception, match="has no place"):
        reshape.to_dense(sig.replace(df.withColumn("sample", -F.col("sample"))), 4, "max").collect()
    assert reshape.to_dense(sig.replace(df.limit(0)), 4).collect() == []


def test_columns_that_only_look_like_samples(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "wave_id long, i_0 double, i_total double, i_10 double")
    assert reshape.series_columns(df) == ["i_0", "i_10"]
    assert reshape.non_series_columns(df).columns == ["wave_id", "i_total"]


def test_features_ignore_filled_samples(spark):
    waves = {1: np.full(40, 2.0), 2: np.full(60, 2.0)}
    sig = Signals(spark.createDataFrame(w.frame(waves)))
    wide = reshape.wide_plus_features(sig, range(60)).orderBy("wave_id").collect()
    assert wide[0]["i_59"] == 0.0 and wide[0]["std_all"] == 0.0


def test_long_needs_series_columns(spark):
    with pytest.raises(ValueError, match="i_<number>"):
        reshape.to_long(spark.range(3))


def test_roles(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "ID long, ms double, Volt double")
    assert project.normalize_roles(df).columns == ["wave_id", "time", "value"]
    with pytest.raises(KeyError, match="value"):
        project.normalize_roles(df.drop("Volt"))
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "wave_id long, time_ms double, current double, value double")
    assert project.normalize_roles(df, "preferred").first().asDict() == {
        "wave_id": 1, "time": 2.0, "current": 3.0, "value": 4.0}


def test_roles_lose_no_column(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0, 6.0)], "wave_id long, time_ms double, current double, value double")
    assert project.normalize_roles(df).first().asDict() == {
        "wave_id": 1, "time": 2.0, "value": 5.0, "value_other": 6.0}


def test_passed_through_values_stay_as_they_came(spark):
    rows = [(1, 0, 0.0, 5), (1, 1, 0.1, None), (None, 0, 0.0, 7), (2, 0, 0.0, None)]
    sig = Signals(spark.createDataFrame(rows, "wave_id long, sample int, time_ms double, value int"))
    result = spark.createDataFrame([(1, 0, 0.0)], "wave_id long, run int, wait_time_ms double")
    from settlespark.operators import sequence
    zero = F.lit(0.0)
    for df in (sequence.with_position(sig), sequence.with_diff(sig), sequence.tail(sig, 5),
               sequence.hold_ok(sig, zero, zero, 1), sequence.stays_within(sig, zero, zero),
               joins.lookup_result(sig, result, "wait_time_ms", "run"), sequence.sort_samples(sig)):
        got = sorted(((r.wave_id, r.sample, r["value"]) for r in df.collect()))
        assert got == [(1, 0, 5), (1, 1, None), (2, 0, None)]
        assert df.schema["value"].dataType.simpleString() == "int"
    noisy = {(r.wave_id, r.sample): r["value"] for r in perturb.add_noise(sig, 1.0, 1).collect()}
    assert noisy[1, 1] is None and noisy[1, 0] is not None and len(noisy) == 3
    ids = sig.df.select("wave_id").filter("wave_id = 1")
    kept = perturb.truncate_waves(sig, ids, F.lit(1.0)).collect()
    assert sorted(((r.wave_id, r.sample, r["value"] is None) for r in kept)) == [(1, 0, False), (1, 1, True), (2, 0, True)]


@pytest.mark.parametrize("hot_rows", [1000, 1])
def test_duplicate_order_fails_positions(spark, hot_rows):
    rows = [(1, 0, 0.0, 1.0), (1, 1, 0.1, 2.0), (1, 1, 0.1, 3.0)]
    sig = Signals(spark.createDataFrame(rows, "wave_id long, sample int, time_ms double, value double"), hot_rows=hot_rows)
    from settlespark.operators import sequence
    with pytest.raises(Exception, match="two samples of wave 1 share sample"):
        sequence.with_position(sig).collect()


def test_order_of_sorted_results(spark):
    rng = np.random.default_rng(2)
    sig = Signals(spark.createDataFrame(w.frame(w.random_waves(50))).repartition(5))
    from settlespark.operators import sequence
    rows = [(r.wave_id, r.time_ms, r.sample) for r in sequence.sort_samples(sig).collect()]
    assert rows == sorted(rows) and len(rows) == sig.df.count()
    ids = [r.wave_id for r in joins.distinct_ids(sig.df).collect()]
    assert ids == sorted(set(ids))
    result = spark.createDataFrame(
        [(k, 0, float(rng.random())) for k in range(50)], "wave_id long, run int, wait_time_ms double")
    drawn = review.overlay(sig, result, "check_train", "run", per_page=7)
    rows = [(r.page, r.wave_id, r.time_ms, r.sample) for r in drawn.collect()]
    assert rows == sorted(rows) and len(rows) == sig.df.count()


def test_label_and_meta_columns(spark):
    rows = [(1, 1.0, 5.0), (2, float("nan"), 5.0), (3, None, 5.0)]
    df = spark.createDataFrame(rows, "wave_id long, wait_time_ms double, temp_C double")
    assert [r["wave_id"] for r in project.drop_unlabelled(df).collect()] == [1]
    assert project.drop_meta(df).columns == ["wait_time_ms"]
    assert project.drop_meta(df, keep=["wave_id"]).columns == ["wave_id", "wait_time_ms"]


def test_csv(spark, sig, tmp_path):
    rows = sig.df.withColumns({
        "value": F.when(F.col("sample") != 3, F.col("value")),
        "sd": F.lit(0.1), "low_limit": F.lit(0.0), "high_limit": F.lit(1.0),
    })
    path = str(tmp_path / "raw.csv")
    io.write_table(rows, path, format="csv")
    got = ordered(io.read_signals(spark, path), "wave_id", "sample")
    want = ordered(rows, "wave_id", "sample")
    assert got["value"].equals(want["value"])
    assert io.read_signals(spark, path, infer=True).schema["value"].dataType.simpleString() == "double"
    with pytest.raises(Exception):
        io.read_signals(spark, path, io.SCORING_SCHEMA).collect()
    scoring = rows.withColumnRenamed("time_ms", "time").drop("sd")
    io.write_table(scoring, f"{path}.scoring.csv", format="csv")
    assert io.read_signals(spark, f"{path}.scoring.csv").columns == io.SCORING_SCHEMA.fieldNames()
    io.write_table(scoring.drop("time"), f"{path}.other.csv", format="csv")
    with pytest.raises(ValueError, match="schema"):
        io.read_signals(spark, f"{path}.other.csv")


def test_runs_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "runs")
    io.write_run(spark.range(3), path, "20250101_000000")
    io.write_run(spark.range(5), path, "20250102_000000")
    io.write_run(spark.range(4), path, "20250102_000000")
    assert io.read_run(spark, path, "20250101_000000").count() == 3
    assert io.read_run(spark, path, "20250102_000000").count() == 4
    assert len(io.new_run_id()) == 15


def test_a_run_without_its_marker_stays_unseen(spark, tmp_path, monkeypatch):
    path, run = str(tmp_path / "runs"), "20250101_000000"
    assert io.list_runs(spark, path).collect() == []
    with pytest.raises(FileNotFoundError):
        io.read_run(spark, path, run)
    io.write_run(spark.range(3), path, run)

    def killed(*_):
        raise KeyboardInterrupt
    with monkeypatch.context() as patch:
        patch.setattr(io, "_put", killed)
        with pytest.raises(KeyboardInterrupt):
            io.write_run(spark.range(7), path, run)
        with pytest.raises(KeyboardInterrupt):
            io.write_run(spark.range(7), path, "20250102_000000")
    assert io.read_run(spark, path, run).count() == 3
    assert [(r.run_id, r.rows) for r in io.list_runs(spark, path).collect()] == [(run, 3)]
    with pytest.raises(FileNotFoundError):
        io.read_run(spark, path, "20250102_000000")


def test_a_run_with_other_files_is_refused(spark, tmp_path):
    path, run = str(tmp_path / "runs"), "20250101_000000"
    table = spark.createDataFrame([(1, "a", None), (2, None, 0.5)], "k int, s string, x double")
    io.write_run(table.withColumn("run_id", F.lit("old")), path, run, format="csv")
    back = io.read_run(spark, path, run)
    assert back.columns == ["k", "s", "x", "run_id"] and back.schema["k"].dataType.simpleString() == "int"
    assert sorted(map(tuple, back.collect())) == [(1, "a", None, run), (2, None, 0.5, run)]
    with pytest.raises(ValueError, match="csv"):
        io.read_run(spark, path, run, format="parquet")
    lost = next((tmp_path / "runs" / f"run_id={run}").glob("*/part-*"))
    lost.unlink()
    with pytest.raises(ValueError, match="files"):
        io.read_run(spark, path, run)
    for bad in ("", "../x", "_/a", "a b"):
        with pytest.raises(ValueError, match="run id"):
            io.write_run(table, path, bad)


def test_a_large_cut_is_no_single_task(spark, monkeypatch):
    df = spark.range(2000).select((F.col("id") * 7 % 500).alias("wave_id"))
    for limit in (0, 1, 7, 499, 500, 10_000_000):
        monkeypatch.setattr(joins, "ONE_TASK_ROWS", 100_000)
        few = sorted(r.wave_id for r in joins.first_ids(df, limit).collect())
        monkeypatch.setattr(joins, "ONE_TASK_ROWS", -1)
        assert sorted(r.wave_id for r in joins.first_ids(df, limit).collect()) == few == list(range(min(limit, 500)))
    key = F.xxhash64("wave_id")
    cut = {r.wave_id for r in perturb.sample_ids(df, 20, 1, key=key).collect()}
    monkeypatch.setattr(joins, "ONE_TASK_ROWS", 100_000)
    assert cut == {r.wave_id for r in perturb.sample_ids(df, 20, 1, key=key).collect()}
    pairs = joins.pair_by_rank(df, df.filter("wave_id % 2 = 1"), 10_000_000)
    assert sorted(map(tuple, pairs.collect())) == [(k, k, 2 * k + 1) for k in range(250)]
    for big in (joins.first_ids(df, 10_000_000), pairs, perturb.sample_ids(df, 10_000_000, 1)):
        plan = big._jdf.queryExecution().executedPlan().toString()
        windows = [x for x in plan.splitlines() if "Window " in x]
        assert "TakeOrderedAndProject" not in plan
        # the only window adds up one row per range
        assert windows and all("_rows" in x and "row_number" not in x for x in windows)


def test_a_page_opens_only_its_files(spark, tmp_path):
    from settlespark.plans import flows
    waves = spark.createDataFrame(w.frame({k: np.arange(50.0) for k in range(60)}))
    result = spark.createDataFrame([(k, 0, 0.1) for k in range(60)], "wave_id long, run int, wait_time_ms double")
    out = str(tmp_path / "review with space")
    # a table this small would become one file
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        flows.review(Signals(waves), result, "check_train", "run", out, per_page=3)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    pages = io.read_signals(spark, f"{out}/check_train_pages").collect()
    assert len(pages) > 1 and sum(p.n_points for p in pages) == 3000
    for page in (0, 7, 19):
        points = flows.read_page(spark, out, "check_train", page)
        assert {r.wave_id for r in points.collect()} == set(range(3 * page, 3 * page + 3))
        assert points.count() == 150 and len(points.inputFiles()) <= 2 < len(pages)
    assert flows.read_page(spark, out, "check_train", 20).collect() == []


def test_truncation_and_oscillation_touch_chosen_waves_only(spark):
    waves = {k: np.ones(100) for k in range(10)}
    df = spark.createDataFrame(w.frame(waves)).withColumns(
        {"low_limit": F.lit(0.0), "high_limit": F.lit(2.0)})
    sig = Signals(df)
    first, second = perturb.disjoint_groups(df, 3, seed=1)
    a = {r[0] for r in first.collect()}
    b = {r[0] for r in second.collect()}
    assert len(a) == len(b) == 3 and not a & b
    cut = perturb.truncate_waves(sig, first).groupBy("wave_id").count().collect()
    assert all((50 <= n < 90) if k in a else n == 100 for k, n in cut)
    shaken = perturb.inject_late_oscillation(sig, second).toPandas()
    moved = shaken[shaken["value"] != 1.0]
    assert set(moved["wave_id"]) == b and moved["sample"].min() >= 60
    assert (moved["value"] - 1.0).abs().max() <= 1.8


def test_noise_depends_on_keys_only(spark):
    df = spark.createDataFrame(w.frame({k: np.zeros(2000) for k in range(10)}))
    a = ordered(perturb.add_noise(Signals(df), 0.5, 3), "wave_id", "sample")
    b = ordered(perturb.add_noise(Signals(df.repartition(7)), 0.5, 3), "wave_id", "sample")
    assert a.equals(b)
    assert abs(a["value"].mean()) < 0.02 and abs(a["value"].std() - 0.5) < 0.02
    c = ordered(perturb.add_noise(Signals(df), 0.5, 4), "wave_id", "sample")
    assert abs(np.corrcoef(a["value"], c["value"])[0, 1]) < 0.05


def test_pairs_and_pages(spark):
    a = spark.range(5, 50).withColumnRenamed("id", "wave_id")
    b = spark.range(100, 130).withColumnRenamed("id", "wave_id")
    pairs = joins.pair_by_rank(a, b, 100).orderBy("rank").collect()
    assert len(pairs) == 30 and pairs[29].asDict() == {"rank": 29, "id_a": 34, "id_b": 129}
    pages = review.paginate(a, 20).orderBy("wave_id").toPandas()
    assert list(pages["page"]) == [0] * 20 + [1] * 20 + [2] * 5
    assert review.page_count(a, 20).first()["n_pages"] == 3


def test_review_texts_and_modes(spark):
    sig = Signals(spark.createDataFrame(w.frame({1: np.arange(20.0), 2: np.ones(5)})))
    result = spark.createDataFrame(
        [(1, 0, 0.05), (1, 1, 0.1)], "wave_id long, run int, wait_time_ms double")
    rows = review.review_table(sig, result, "check_train", "run").orderBy("wave_id").collect()
    assert rows[0]["title"] == "ID:1 | Δ:9.000" and rows[0]["line_text"] == "0.10ms"
    assert rows[1]["title"] is None and rows[1]["line_text"] is None
    with pytest.raises(ValueError, match="mode"):
        review.review_table(sig, result, "check", "run")


def test_actual_lines_fall_back_as_a_whole(spark):
    sig = Signals(spark.createDataFrame(w.frame({1: np.ones(20), 2: np.ones(20)})))
    schema = "wave_id long, run int, wait_time_ms double, pred_wait_time_ms double"
    pred = spark.createDataFrame([(1, 0, 0.1, 0.2), (2, 0, 0.1, 0.2)], schema)
    actual = spark.createDataFrame([(1, 0, 0.3)], "wave_id long, run int, wait_time_ms double")
    def lines(**k):
        rows = review.actual_and_predicted(sig, pred, "run", **k).orderBy("wave_id").collect()
        return [r["wait_time_ms"] for r in rows]
    assert lines(actual=actual) == [0.3, None]
    assert lines(actual=actual.limit(0)) == [0.1, 0.1]
    assert lines() == [0.1, 0.1]


def test_first_non_null_meta(spark):
    df = spark.createDataFrame(pd.DataFrame({
        "wave_id": [1] * 4, "sample": [3, 2, 1, 0], "time_ms": [0.0] * 4, "value": [1.0] * 4,
        "flag": ["d", "c", "b", None], "level": [21.0, 20.0, float("nan"), float("nan")],
    }))
    got = grouped_features(Signals(df), ["x0"], meta=["flag", "level"], min_length=1).first()
    assert got["flag"] == "b" and got["level"] == 20.0
