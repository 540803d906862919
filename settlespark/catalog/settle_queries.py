"""Settle rules, targets and label tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from settlespark.catalog import sql
from settlespark.catalog.registry import query, rounded
from settlespark.operators import settle as st
from settlespark.operators.settle import Rule
from settlespark.signals import Signals
from settlespark.sources import tables as t

HOT = 600


def _full(source: str, rule: str) -> str:
    return f"""
WITH {source}, {rule}
SELECT wave_id, n, {sql.r('target', 'target')}, {sql.r('tol', 'tolerance')}, coalesce(j, -1) AS last_out,
       CAST(settle_idx AS BIGINT) AS settle_idx, {sql.r('wait_time_ms', 'wait_time_ms')}
FROM s"""


@query("g1_target_median", f"""
WITH {sql.D2P}
SELECT wave_id, {sql.r(f'median(value) FILTER (pos >= n - {sql.TAIL})', 'target')}
FROM p GROUP BY wave_id""")
def _(spark, sf):
    return rounded(st.targets(t.price_signals(spark, sf)).select("wave_id", "target"))


@query("g1_target_median_hot_waves", f"""
WITH {sql.D2P}
SELECT wave_id, {sql.r(f'median(value) FILTER (pos >= n - {sql.TAIL})', 'target')}
FROM p GROUP BY wave_id""")
def _(spark, sf):
    sig = t.price_signals(spark, sf, hot_rows=HOT)
    return rounded(st.targets(sig).select("wave_id", "target"))


@query("g2_tolerance", f"""
WITH {sql.D3P}, {sql.settle()} SELECT wave_id, {sql.r('tol', 'tolerance')} FROM s_t""")
def _(spark, sf):
    return rounded(st.targets(t.event_signals(spark, sf)).select("wave_id", "tolerance"))


def _rule(name, rule, sql_rule, source=sql.D2P, signals=t.price_signals, **options):
    @query(name, _full(source, sql_rule))
    def _(spark, sf):
        df = st.settle(signals(spark, sf, **options), rule)
        return rounded(df.withColumn("last_out", F.coalesce("last_out", F.lit(-1))))


def _waves(spark, sf, **options):
    return Signals(t.embeddings(spark, sf), **options)


_rule("g3_hold_rule", Rule(), sql.settle())
_rule("g3_hold_rule_hot_waves", Rule(), sql.settle(), hot_rows=HOT)
_rule("g3_hold_rule_skip_missing", Rule(), sql.settle(), missing="skip")
_rule("g3_hold_rule_exit_anchor", Rule(anchor="exit"), sql.settle(anchor="exit"))
_rule("g3_hold_rule_floor", Rule(abs_tol=0.75), sql.settle(abs_tol="0.75"))
_rule("g3_hold_rule_ragged", Rule(hold=10), sql.settle(hold=10), sql.D3P, t.event_signals)
_rule(
    "g3_hold_rule_short_waves", Rule(hold=65), sql.settle(hold=65), sql.D3P, t.event_signals
)
_rule(
    "g3_hold_rule_wide_band", Rule(tol=5.0, hold=10), sql.settle(tol="5", hold=10), sql.D1P, _waves
)
_rule("g5_exit_rule", Rule("exit"), sql.settle("exit"))
_rule("g5_exit_rule_hot_waves", Rule("exit"), sql.settle("exit"), hot_rows=HOT)
_rule("g5_exit_rule_threshold", Rule("exit", tol=0.02), sql.settle("exit", "0.02"))
_rule("g6_suffix_rule", Rule("suffix"), sql.settle("suffix"), sql.D1P, _waves)
_rule("g6_suffix_rule_settling", Rule("suffix"), sql.settle("suffix"))
_rule("g6_suffix_rule_hot_waves", Rule("suffix"), sql.settle("suffix"), hot_rows=HOT)
_rule(
    "x1_exit_rule_never_out", Rule("exit", tol=5.0, min_tail=1, never_out="last"),
    sql.settle("exit", "5", never="n - 1"), sql.D3P, t.event_signals,
)


@query("g4_wait_time", f"""
WITH {sql.D3P}, {sql.settle(hold=10)}
SELECT wave_id, {sql.r('wait_time_ms', 'wait_time_ms')} FROM s""")
def _(spark, sf):
    return rounded(st.labels(t.event_signals(spark, sf), Rule(hold=10)))


@query("g7_label_table", f"""
WITH {sql.D2P}, {sql.settle('exit')}
SELECT wave_id, {sql.r('wait_time_ms', 'wait_time_ms')} FROM s""")
def _(spark, sf):
    return rounded(st.labels(t.price_signals(spark, sf), Rule("exit")))
