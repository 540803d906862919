"""Result joins and review tables of the price waves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlespark.catalog import sql
from settlespark.catalog.registry import query, rounded
from settlespark.operators import joins as jo
from settlespark.operators import review as rv
from settlespark.operators.features import grouped_features
from settlespark.operators.model import fit_line, score
from settlespark.operators.settle import Rule, labels
from settlespark.plans import flows
from settlespark.plans.skew import checkpoint_dir, freeze
from settlespark.sources import tables as t

HOT = 600
PAIRS = 40


LATE, EARLY = 1500.0, 870.0


def results(spark, sf):
    """The waves and their results."""
    sig = t.price_signals(spark, sf)
    return sig, _results(sig)


def _results(sig):
    """Two runs of results per wave: hold rule with predictions, then early exit-rule ones.

    Waves that settle late have no result in the first run.
    """
    table = freeze(grouped_features(sig, ["std_all"], label=Rule()).filter(F.col("wait_time_ms") < LATE))
    model, _ = fit_line(table, "std_all")
    columns = ["wave_id", "run", "wait_time_ms", "pred_wait_time_ms"]
    first = score(table, model, ["std_all"]).withColumn("run", F.lit(0)).select(*columns)
    early = labels(sig, Rule("exit", tol=0.02)).filter(F.col("wait_time_ms") < EARLY)
    second = early.withColumns({"run": F.lit(1), "pred_wait_time_ms": F.col("wait_time_ms") + 0.5})
    return first.unionByName(second.select(*columns))


RESULTS = f"""{sql.D2P}, {sql.settle()}, {sql.settle('exit', '0.02', name='e')},
shape AS (SELECT wave_id, stddev_pop(value) AS std_all FROM p GROUP BY wave_id),
fitted AS (SELECT wave_id, wait_time_ms, std_all FROM s JOIN shape USING (wave_id)
           WHERE wait_time_ms < {LATE:.0f}),
line AS (SELECT regr_slope(wait_time_ms, std_all) AS a, regr_intercept(wait_time_ms, std_all) AS b
         FROM fitted),
res AS (
  SELECT wave_id, 0 AS run, wait_time_ms, a * std_all + b AS pred_wait_time_ms FROM fitted, line
  UNION ALL
  SELECT wave_id, 1, wait_time_ms, wait_time_ms + CAST('0.5' AS DOUBLE) FROM e
  WHERE wait_time_ms < {EARLY:.0f}),
last AS (SELECT wave_id, max_by(wait_time_ms, run) AS wait_time_ms,
                max_by(pred_wait_time_ms, run) AS pred_wait_time_ms
         FROM res GROUP BY wave_id),
ranks AS (SELECT wave_id, row_number() OVER (ORDER BY wave_id) - 1 AS rank
          FROM (SELECT DISTINCT wave_id FROM p))"""

_KEY = ["wave_id", "order_key", "line_no", "part_key"]


@query("j3_lookup_result", f"""
WITH {RESULTS}
SELECT wave_id, order_key, line_no, part_key, {sql.r('wait_time_ms', 'wait_time_ms', 4)}
FROM p LEFT JOIN last USING (wave_id)""")
def _(spark, sf):
    sig, result = results(spark, sf)
    df = jo.lookup_result(sig, result, "wait_time_ms", "run")
    return rounded(df.select(*_KEY, "wait_time_ms"), 4)


_AFTER = f"""
WITH {RESULTS}
SELECT wave_id, order_key, line_no, part_key, {sql.r('time_ms', 'time_ms', 4)}
FROM p JOIN last USING (wave_id) WHERE time_ms >= """


@query("j4_after_settle", _AFTER + "pred_wait_time_ms")
def _(spark, sf):
    sig, result = results(spark, sf)
    df = jo.after_settle(sig, result, "pred_wait_time_ms", "run")
    return rounded(df.select(*_KEY, "time_ms"), 4)


@query("j4_after_settle_hot_waves", _AFTER + "pred_wait_time_ms")
def _(spark, sf):
    sig, result = results(spark, sf)
    sig = sig.replace(sig.df, hot_rows=HOT)
    df = jo.after_settle(sig, result, "pred_wait_time_ms", "run")
    return rounded(df.select(*_KEY, "time_ms"), 4)


@query("p8_after_time", _AFTER + "wait_time_ms")
def _(spark, sf):
    sig, result = results(spark, sf)
    df = jo.after_settle(sig, result, "wait_time_ms", "run")
    return rounded(df.select(*_KEY, "time_ms"), 4)


_PAIRED = f"""
a AS (SELECT wave_id AS id_a, row_number() OVER (ORDER BY wave_id) - 1 AS rank
      FROM (SELECT DISTINCT l_suppkey AS wave_id FROM lineitem)),
b AS (SELECT wave_id AS id_b, row_number() OVER (ORDER BY wave_id) - 1 AS rank
      FROM (SELECT DISTINCT user_id AS wave_id FROM events)),
pairs AS (SELECT rank, id_a, id_b FROM a JOIN b USING (rank) WHERE rank < {PAIRS})"""


@query("j5_pair_by_rank", f"WITH {_PAIRED} SELECT * FROM pairs")
def _(spark, sf):
    return jo.pair_by_rank(t.prices(spark, sf), t.events(spark, sf), PAIRS)


@query("h7_id_rank", f"WITH {RESULTS} SELECT wave_id, rank FROM ranks")
def _(spark, sf):
    return rv.id_rank(t.prices(spark, sf))


@query("h8_paginate", f"WITH {RESULTS} SELECT wave_id, rank, rank // 20 AS page FROM ranks")
def _(spark, sf):
    return rv.paginate(t.prices(spark, sf))


@query("h8_page_count", """
SELECT count(DISTINCT user_id) AS n_ids, (count(DISTINCT user_id) + 19) // 20 AS n_pages
FROM events""")
def _(spark, sf):
    return rv.page_count(t.events(spark, sf))


def _stats(line: str) -> str:
    return f"""
stats AS (
  SELECT p.wave_id, any_value(last.{line}) AS line_ms,
         max(value) FILTER (time_ms >= last.{line}) AS y_max,
         min(value) FILTER (time_ms >= last.{line}) AS y_min
  FROM p LEFT JOIN last ON last.wave_id = p.wave_id GROUP BY p.wave_id)"""


_SPREAD = f"""{sql.r('y_max', 'y_max')}, {sql.r('y_min', 'y_min')},
       {sql.r('y_max - y_min', 'delta')}"""


def _v1(line):
    return f"""
WITH {RESULTS}, {_stats(line)}
SELECT wave_id, {sql.r('line_ms', line)}, {_SPREAD} FROM stats"""


@query("v1_post_settle_stats", _v1("wait_time_ms"))
def _(spark, sf):
    return _spread(*results(spark, sf))


def _spread(sig, result):
    lines = jo.lookup_table(result, "wait_time_ms", "run")
    return rounded(rv.post_settle_stats(sig, lines, "wait_time_ms"))


@query("v1_post_settle_stats_hot_waves", _v1("wait_time_ms"))
def _(spark, sf):
    sig, result = results(spark, sf)
    lines = jo.lookup_table(result, "wait_time_ms", "run")
    return rounded(rv.post_settle_stats(sig.replace(sig.df, hot_rows=HOT), lines, "wait_time_ms"))


def _review(line: str) -> str:
    return f"""
WITH {RESULTS}, {_stats(line)}
SELECT wave_id, rank, rank // 20 AS page, {sql.r('line_ms', 'line_ms')}, {_SPREAD},
       CASE WHEN y_max IS NOT NULL
            THEN 'ID:' || wave_id || ' | Δ:' || printf('%.3f', y_max - y_min) END AS title,
       CASE WHEN line_ms IS NOT NULL THEN printf('%.2f', line_ms) || 'ms' END AS line_text
FROM stats JOIN ranks USING (wave_id)"""


@query("v2_review_check_train", _review("wait_time_ms"))
def _(spark, sf):
    sig, result = results(spark, sf)
    return rounded(rv.review_table(sig, result, "check_train", "run"))


@query("v2_review_check_pred", _review("pred_wait_time_ms"))
def _(spark, sf):
    sig, result = results(spark, sf)
    return rounded(rv.review_table(sig, result, "check_pred", "run"))


@query("v3_compare_pairs", f"""
WITH {sql.PRICES}, {sql.EVENTS}, {_PAIRED}, both_sides AS (
  SELECT rank, 'TRAIN' AS source, wave_id, time_ms, value FROM d2 JOIN pairs ON wave_id = id_a
  UNION ALL
  SELECT rank, 'TEST', wave_id, time_ms, value FROM d3 JOIN pairs ON wave_id = id_b)
SELECT rank // 20 AS page, rank AS pair, source, wave_id, source || ' ID: ' || wave_id AS title,
       {sql.r('time_ms', 'time')}, {sql.r('value', 'value')}
FROM both_sides""")
def _(spark, sf):
    df = rv.compare_pairs(t.price_signals(spark, sf), t.event_signals(spark, sf), PAIRS)
    return rounded(df)


@query("v4_overlay", f"""
WITH {RESULTS}
SELECT rank // 20 AS page, wave_id, order_key, line_no, part_key, {sql.r('time_ms', 'time_ms')},
       {sql.r('value', 'value')}, {sql.r('pred_wait_time_ms', 'line_ms')}
FROM p JOIN ranks USING (wave_id) LEFT JOIN last USING (wave_id)""")
def _(spark, sf):
    return _overlay(*results(spark, sf))


def _overlay(sig, result):
    return rounded(rv.overlay(sig, result, "check_pred", "run").drop("price"))


@query("v4_open_page", f"""
WITH {RESULTS}
SELECT rank // 20 AS page, wave_id, order_key, line_no, part_key, {sql.r('time_ms', 'time_ms')},
       {sql.r('value', 'value')}, {sql.r('pred_wait_time_ms', 'line_ms')}
FROM p JOIN ranks USING (wave_id) LEFT JOIN last USING (wave_id) WHERE rank // 20 = 0""")
def _(spark, sf):
    """The first page of a written review of all waves, by the list of its files."""
    sig, result = results(spark, sf)
    out = f"{checkpoint_dir(spark)}/review-{uuid.uuid4().hex}"
    flows.review(sig, result, "check_pred", "run", out)
    return rounded(flows.read_page(spark, out, "check_pred", 0).drop("price"))


def prepare(spark, sf):
    """The input of :data:`ON_PREPARED`: the waves, and their results as a written table."""
    sig, result = results(spark, sf)
    return sig, freeze(result)


#: What two of the queries do from their results on, for timing it alone.
ON_PREPARED = {"v1_post_settle_stats": _spread, "v4_overlay": _overlay}


@query("x6_actual_and_predicted", f"""
WITH {RESULTS}, {_stats('pred_wait_time_ms')}
SELECT wave_id, {sql.r('line_ms', 'pred_wait_time_ms')}, {_SPREAD},
       {sql.r('e.wait_time_ms', 'wait_time_ms')}
FROM stats LEFT JOIN e USING (wave_id)""")
def _(spark, sf):
    sig, result = results(spark, sf)
    actual = labels(sig, Rule("exit", tol=0.02)).withColumn("run", F.lit(0))
    return rounded(rv.actual_and_predicted(sig, result, "run", actual))


@query("x6_actual_from_predictions", f"""
WITH {RESULTS}, {_stats('pred_wait_time_ms')}
SELECT wave_id, {sql.r('line_ms', 'pred_wait_time_ms')}, {_SPREAD},
       {sql.r('last.wait_time_ms', 'wait_time_ms')}
FROM stats LEFT JOIN last USING (wave_id)""")
def _(spark, sf):
    sig, result = results(spark, sf)
    return rounded(rv.actual_and_predicted(sig, result, "run"))
