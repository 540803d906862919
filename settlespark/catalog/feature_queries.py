"""Grouped features, sequence columns and quality figures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from settlespark.catalog import sql
from settlespark.catalog.registry import query, rounded
from settlespark.functions.features import CLASSIC, CURRENT, LIMITS
from settlespark.functions.scalar import clamp_index, ratio_eps, tail_length
from settlespark.operators import features as fe
from settlespark.operators import sequence as seq
from settlespark.operators.settle import Rule
from settlespark.signals import Signals
from settlespark.sources import tables as t

HOT = 600  # at small scale: treat waves above this length as too large for a task


def _table(names, source, guard=0):
    columns = sql.features(names, guard=guard)
    return f"WITH {source} SELECT wave_id, {columns} FROM p GROUP BY wave_id"


@query("e0_grouped_features", _table(CURRENT, sql.D1P, guard=10))
def _(spark, sf):
    return rounded(fe.grouped_features(Signals(t.embeddings(spark, sf))))


@query("e0_grouped_features_settling", _table(CURRENT, sql.D2P, guard=10))
def _(spark, sf):
    return rounded(fe.grouped_features(t.price_signals(spark, sf)))


@query("e0_grouped_features_ragged", _table(CURRENT, sql.D3P, guard=10))
def _(spark, sf):
    return rounded(fe.grouped_features(t.event_signals(spark, sf)))


@query("e0_grouped_features_hot_waves", _table(CURRENT, sql.D2P, guard=10))
def _(spark, sf):
    return rounded(fe.grouped_features(t.price_signals(spark, sf, hot_rows=HOT)))


@query("e0_features_and_label", f"""
WITH {sql.D2P}, {sql.settle()},
f AS (SELECT wave_id, {sql.features(CURRENT)} FROM p GROUP BY wave_id)
SELECT f.*, {sql.r('wait_time_ms', 'wait_time_ms')} FROM f JOIN s USING (wave_id)""")
def _(spark, sf):
    return rounded(fe.grouped_features(t.price_signals(spark, sf), label=Rule()))


@query("e0_short_waves_have_null_features", _table(CURRENT, sql.D3P, guard=66))
def _(spark, sf):
    return rounded(fe.grouped_features(t.event_signals(spark, sf), min_length=66))


def _single(name: str, key: str) -> None:
    @query(f"{key}_{name}", _table((name,), sql.D2P))
    def _(spark, sf):
        return rounded(fe.grouped_features(t.price_signals(spark, sf), [name]))


for _key, _name in (
    ("e1", "x_end"), ("e2", "std_all"), ("e3", "std_tail_50"), ("e4", "max_dev_tail_50"),
    ("e5", "std_tail_150"), ("e6", "settling_trend"), ("e7", "ringing_energy"),
    ("e8", "max_slope"), ("e9", "stability_ratio"),
    ("f1", "x0"), ("f2", "mean_all"), ("f3", "mean_last"), ("f4", "std_last"),
    ("f5", "peak_rel"), ("f6", "trough_rel"), ("f7", "min_slope"), ("f8", "band_3std_last"),
    ("x2", "ringing_sq"), ("x7", "peak_rel_end"), ("x8", "range_tail_50"),
):
    _single(_name, _key)


@query("e10_trend_flag", f"""
WITH {sql.D2P}
SELECT wave_id, {sql.FEATURES['settling_trend']} > CAST('1.2' AS DOUBLE) AS trend_flag
FROM p GROUP BY wave_id""")
def _(spark, sf):
    return fe.grouped_features(t.price_signals(spark, sf), ["trend_flag"])


@query("e11_first_non_null", f"""
WITH {sql.D2P}, m AS (
  SELECT wave_id, pos, quantity, CASE WHEN flag <> 'N' THEN flag END AS flag FROM p)
SELECT wave_id, {sql.r('min_by(quantity, pos)', 'quantity')},
       min_by(flag, pos) FILTER (flag IS NOT NULL) AS flag
FROM m GROUP BY wave_id""")
def _(spark, sf):
    rows = t.prices(spark, sf).withColumn("flag", F.when(F.col("flag") != "N", F.col("flag")))
    sig = Signals(rows, order=t.PRICE_ORDER)
    return rounded(fe.meta_table(sig, ["quantity", "flag"]))


@query("e11_first_present_skips_nan", f"""
WITH {sql.D2P} SELECT wave_id, {sql.r("min_by(quantity, pos) FILTER (flag <> 'N')", 'quantity')}
FROM p GROUP BY wave_id""")
def _(spark, sf):
    quantity = F.when(F.col("flag") == "N", F.lit(float("nan"))).otherwise(F.col("quantity").cast("double"))
    sig = Signals(t.prices(spark, sf).withColumn("quantity", quantity), order=t.PRICE_ORDER)
    return rounded(fe.meta_table(sig, ["quantity"]))


@query("e12_count_waves", f"""
WITH {sql.PRICES} SELECT count(DISTINCT wave_id) AS n_waves, count(*) AS n_rows FROM d2""")
def _(spark, sf):
    return fe.count_waves(t.price_signals(spark, sf))


_SUFFIX = sql.settle("suffix")


@query("f0_length_guard", f"""
WITH {sql.D3P}, {_SUFFIX}, f AS (
  SELECT wave_id, max(n) AS n, {sql.features(tuple(c for c in CLASSIC if c != 'settle_idx'), guard=60)}
  FROM p GROUP BY wave_id)
SELECT f.* EXCLUDE (n), CASE WHEN f.n >= 60 THEN CAST(settle_idx AS BIGINT) ELSE -1 END AS settle_idx
FROM f JOIN s USING (wave_id)""")
def _(spark, sf):
    sig = t.event_signals(spark, sf)
    df = fe.grouped_features(sig, "classic", min_length=60, on_short="null")
    return rounded(df.withColumn("settle_idx", F.coalesce("settle_idx", F.lit(-1))))


@query("f9_settle_idx", f"""
WITH {sql.D1P}, {_SUFFIX} SELECT wave_id, CAST(settle_idx AS BIGINT) AS settle_idx FROM s""")
def _(spark, sf):
    return rounded(fe.grouped_features(Signals(t.embeddings(spark, sf)), ["settle_idx"]))


def _classic(source: str) -> str:
    shaped = tuple(c for c in CLASSIC if c != "settle_idx")
    return f"""
WITH {source}, {_SUFFIX}, f AS (
  SELECT wave_id, {sql.features(shaped)} FROM p GROUP BY wave_id)
SELECT f.*, CAST(settle_idx AS BIGINT) AS settle_idx FROM f JOIN s USING (wave_id)"""


@query("f10_classic_features", _classic(sql.D1P))
def _(spark, sf):
    return rounded(fe.grouped_features(Signals(t.embeddings(spark, sf)), "classic"))


@query("f10_classic_features_settling", _classic(sql.D2P))
def _(spark, sf):
    return rounded(fe.grouped_features(t.price_signals(spark, sf), "classic"))


@query("f10_classic_features_and_hold_label", f"""
WITH {sql.D2P}, {_SUFFIX}, {sql.settle(name='h')}, f AS (
  SELECT wave_id, {sql.features(tuple(c for c in CLASSIC if c != 'settle_idx'))}
  FROM p GROUP BY wave_id)
SELECT f.*, CAST(s.settle_idx AS BIGINT) AS settle_idx,
       {sql.r('h.wait_time_ms', 'wait_time_ms')}
FROM f JOIN s USING (wave_id) JOIN h USING (wave_id)""")
def _(spark, sf):
    return rounded(fe.grouped_features(t.price_signals(spark, sf), "classic", label=Rule()))


@query("x3_limit_features", _table(("limit_low", "limit_high", "std_all"), sql.D2P))
def _(spark, sf):
    sig = t.price_signals(spark, sf)
    return rounded(fe.grouped_features(sig, ["limit_low", "limit_high", "std_all"]))


@query("x3_limit_feature_set", f"""
WITH {sql.D3P}, {sql.settle('exit', never='n - 1')}, f AS (
  SELECT wave_id, {sql.features(LIMITS)} FROM p GROUP BY wave_id)
SELECT f.*, {sql.r('wait_time_ms', 'wait_time_ms')} FROM f JOIN s USING (wave_id)""")
def _(spark, sf):
    rule = Rule("exit", min_tail=1, never_out="last")
    return rounded(fe.grouped_features(t.event_signals(spark, sf), "limits", label=rule))


@query("s6_signal_quality", """
SELECT user_id AS wave_id, count(*) AS n, count(*) FILTER (value < 10) AS n_missing,
       count(*) - count(DISTINCT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)))
         AS n_duplicate,
       count(*) FILTER (value >= 10) < 60 AS too_short
FROM events GROUP BY user_id""")
def _(spark, sf):
    rows = t.table(spark, sf, "events").select(
        F.col("user_id").alias("wave_id"),
        F.datediff("ts", F.lit("2024-01-01")).alias("sample"),
        F.when(F.col("value") >= 10, F.col("value"))
        .otherwise(F.when(F.col("event_id") % 2 == 0, F.lit(float("nan")))).alias("value"),
    )
    return fe.signal_quality(Signals(rows), min_len=60)


@query("u1_apply_per_wave", f"""
WITH {sql.D2P} SELECT wave_id, {sql.features(('x_end', 'std_all', 'ringing_energy'))}
FROM p GROUP BY wave_id""")
def _(spark, sf):
    def shape(wave: pd.DataFrame) -> pd.DataFrame:
        x = wave["value"].to_numpy()
        return pd.DataFrame({
            "wave_id": [wave["wave_id"].iloc[0]], "x_end": [x[-1]], "std_all": [x.std()],
            "ringing_energy": [np.abs(np.diff(x)[3:]).sum()],
        })
    schema = "wave_id long, x_end double, std_all double, ringing_energy double"
    return rounded(fe.apply_per_wave(t.price_signals(spark, sf), shape, schema))


@query("u1_fold_per_wave", f"""
WITH {sql.D2P}
SELECT wave_id, max(n) AS n, {sql.r('sum(abs(dx))', 'path')} FROM p GROUP BY wave_id""")
def _(spark, sf):
    def step(state, block):
        count, last, path = state
        x = block["value"].to_numpy()
        joined = x if last is None else np.r_[last, x]
        return count + len(x), x[-1], path + np.abs(np.diff(joined)).sum()

    def finish(wave, state):
        return {"wave_id": wave, "n": state[0], "path": state[2]}

    sig = t.price_signals(spark, sf, hot_rows=100)
    return rounded(fe.fold_per_wave(
        sig, lambda: (0, None, 0.0), step, finish, "wave_id long, n long, path double"))


@query("u1_fold_ranges", f"""
WITH {sql.D2P}
SELECT wave_id, max(n) AS n, {sql.r('sum(abs(dx))', 'path')} FROM p GROUP BY wave_id""")
def _(spark, sf):
    def step(state, block):
        count, first, last, path = state
        x = block["value"].to_numpy()
        joined = x if last is None else np.r_[last, x]
        return count + len(x), x[0] if first is None else first, x[-1], path + np.abs(np.diff(joined)).sum()

    def merge(a, b):
        return a[0] + b[0], a[1], b[2], a[3] + abs(b[1] - a[2]) + b[3]

    def finish(wave, state):
        return {"wave_id": wave, "n": state[0], "path": state[3]}

    return rounded(fe.fold_ranges(
        t.price_signals(spark, sf), lambda: (0, None, None, 0.0), step, merge, finish,
        "wave_id long, n long, path double", rows_per_range=1000))


@query("h1_with_position", f"""
WITH {sql.D2P} SELECT wave_id, order_key, line_no, part_key, pos, n FROM p""")
def _(spark, sf):
    df = seq.with_position(t.price_signals(spark, sf))
    return rounded(df.select("wave_id", "order_key", "line_no", "part_key", "pos", "n"))


@query("h1_with_position_keeps_null", f"""
WITH {sql.D2P}
SELECT wave_id, order_key, line_no, part_key, pos,
       {sql.r("CASE WHEN flag <> 'N' THEN value END", 'value')} FROM p""")
def _(spark, sf):
    rows = t.prices(spark, sf).withColumn("value", F.when(F.col("flag") != "N", F.col("value")))
    df = seq.with_position(Signals(rows, order=t.PRICE_ORDER))
    return rounded(df.select("wave_id", "order_key", "line_no", "part_key", "pos", "value"))


@query("h1_with_position_hot_waves", f"""
WITH {sql.D2P} SELECT wave_id, order_key, line_no, part_key, pos, n FROM p""")
def _(spark, sf):
    df = seq.with_position(t.price_signals(spark, sf, hot_rows=HOT))
    return rounded(df.select("wave_id", "order_key", "line_no", "part_key", "pos", "n"))


@query("h2_with_diff", f"""
WITH {sql.D3P} SELECT wave_id, event_id, {sql.r('dx', 'dx')} FROM p""")
def _(spark, sf):
    return rounded(seq.with_diff(t.event_signals(spark, sf)).select("wave_id", "event_id", "dx"))


@query("h3_tail_k", f"""
WITH {sql.D3P} SELECT wave_id, event_id, {sql.r('value', 'value')} FROM p WHERE pos >= n - 50""")
def _(spark, sf):
    return rounded(seq.tail(t.event_signals(spark, sf), k=50).select("wave_id", "event_id", "value"))


@query("h3_tail_frac", f"""
WITH {sql.D2P} SELECT wave_id, order_key, line_no, part_key, {sql.r('value', 'value')}
FROM p WHERE pos >= n - {sql.TAIL}""")
def _(spark, sf):
    df = seq.tail(t.price_signals(spark, sf))
    return rounded(df.select("wave_id", "order_key", "line_no", "part_key", "value"))


_BAND = "abs(value - CAST(100 AS DOUBLE)) > CAST(1 AS DOUBLE)"


def _hold_ok(source: str) -> str:
    return f"""
WITH {source}, o AS (
  SELECT *, max(CASE WHEN {_BAND} THEN 1 ELSE 0 END) OVER (
    PARTITION BY wave_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS hit FROM p)
SELECT wave_id, event_id,
       CASE WHEN pos > n - 10 THEN 'short' WHEN hit = 0 THEN 'true' ELSE 'false' END AS hold_ok
FROM o"""


def _held(df):
    text = F.coalesce(F.col("hold_ok").cast("string"), F.lit("short"))
    return df.select("wave_id", "event_id", text.alias("hold_ok"))


@query("h4_hold_ok", _hold_ok(sql.D3P))
def _(spark, sf):
    df = seq.hold_ok(t.event_signals(spark, sf), F.lit(100.0), F.lit(1.0), 10)
    return _held(df)


@query("h4_hold_ok_hot_waves", _hold_ok(sql.D3P))
def _(spark, sf):
    df = seq.hold_ok(t.event_signals(spark, sf, hot_rows=65), F.lit(100.0), F.lit(1.0), 10)
    return _held(df)


@query("h5_stays_within", f"""
WITH {sql.D3P}
SELECT wave_id, event_id, max(abs(value - CAST(100 AS DOUBLE))) OVER (
  PARTITION BY wave_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= CAST(1 AS DOUBLE) AS stays_within
FROM p""")
def _(spark, sf):
    df = seq.stays_within(t.event_signals(spark, sf), F.lit(100.0), F.lit(1.0))
    return df.select("wave_id", "event_id", "stays_within")


@query("h6_last_excursion", f"""
WITH {sql.D3P}
SELECT wave_id, coalesce(max(CASE WHEN {_BAND} THEN pos END), -1) AS last_excursion
FROM p GROUP BY wave_id""")
def _(spark, sf):
    df = seq.last_excursion(t.event_signals(spark, sf), F.lit(100.0), F.lit(1.0))
    return df.withColumn("last_excursion", F.coalesce("last_excursion", F.lit(-1)))


@query("l1_sort_samples", f"""
WITH {sql.EVENTS} SELECT wave_id, time_ms, event_id FROM d3""")
def _(spark, sf):
    return seq.sort_samples(t.event_signals(spark, sf)).select("wave_id", "time_ms", "event_id")


@query("p7_wave_slice", f"""
WITH {sql.EVENTS} SELECT event_id, time_ms, {sql.r('value', 'value')} FROM d3 WHERE wave_id = 7""")
def _(spark, sf):
    return rounded(seq.wave_slice(t.event_signals(spark, sf), 7).select("event_id", "time_ms", "value"))


@query("p10_ratio_eps", f"""
WITH {sql.D3P}
SELECT wave_id, event_id, {sql.r("value / (abs(dx) + CAST('1e-9' AS DOUBLE)) / 1000000", 'ratio')}
FROM p""")
def _(spark, sf):
    df = seq.with_diff(t.event_signals(spark, sf))
    ratio = ratio_eps(F.col("value"), F.abs("dx")) / 1_000_000
    return rounded(df.select("wave_id", "event_id", ratio.alias("ratio")))


@query("p11_tail_length", """
SELECT o_custkey AS wave_id, count(*) AS n,
       CASE WHEN count(*) // 10 = 0 THEN count(*) ELSE count(*) // 10 END AS tail,
       CAST(floor(count(*) * CAST('0.6' AS DOUBLE)) AS BIGINT) AS late
FROM orders GROUP BY o_custkey""")
def _(spark, sf):
    rows = t.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("wave_id"))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    late = F.floor(F.col("n") * F.lit(0.6)).cast("long")
    return n.select("wave_id", "n", tail_length(F.col("n")).alias("tail"), late.alias("late"))


@query("p13_clamp_index", f"""
WITH {sql.D3P} SELECT wave_id, event_id, least(pos + 50, n - 1) AS idx FROM p""")
def _(spark, sf):
    df = seq.with_position(t.event_signals(spark, sf))
    return df.select("wave_id", "event_id", clamp_index(F.col("pos") + 50, F.col("n")).alias("idx"))
