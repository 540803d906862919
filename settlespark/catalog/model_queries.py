"""Training, scoring and diagnosis of settle-time models."""

from __future__ import annotations

import uuid

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from settlespark.catalog import sql
from settlespark.catalog.registry import query, rounded
from settlespark.functions.stats import importance_stats
from settlespark.operators import model as mo
from settlespark.operators.features import grouped_features
from settlespark.operators.settle import Rule
from settlespark.plans.skew import checkpoint_dir
from settlespark.sources import io
from settlespark.sources import tables as t


def _line_scores(spark, sf):
    table = t.supplier_line(spark, sf)
    model, _ = mo.fit_line(table, "x")
    return mo.score(table, model, ["x"])


_SCORED = f"""{sql.SUPPLIER_LINE},
line AS (SELECT regr_slope(wait_time_ms, x) AS a, regr_intercept(wait_time_ms, x) AS b FROM d7),
scored AS (SELECT wave_id, wait_time_ms, x, a * x + b AS pred_wait_time_ms FROM d7, line),
errors AS (SELECT *, pred_wait_time_ms - wait_time_ms AS error_ms,
                  abs(pred_wait_time_ms - wait_time_ms) AS abs_error_ms FROM scored)"""

_ALL = f"""wave_id, {sql.r('wait_time_ms', 'wait_time_ms')}, {sql.r('x', 'x')},
  {sql.r('pred_wait_time_ms', 'pred_wait_time_ms')}"""


def _training(spark, sf):
    return grouped_features(t.price_signals(spark, sf), label=Rule())


# Waves held out by arithmetic, so that SQL can name them.
HELD = "wave_id % 5 = 0"
_FITTED = f"""{sql.SUPPLIER_LINE},
fit AS (SELECT regr_slope(wait_time_ms, x) AS a, regr_intercept(wait_time_ms, x) AS b,
               avg(wait_time_ms) AS m FROM d7 WHERE NOT {HELD})"""


def _trained(table, **options):
    """Least squares, and least squares shrunk to the mean, compared on held-out waves."""
    candidates = {
        "flat": LinearRegression(regParam=1e12, solver="normal"),
        "linear": LinearRegression(regParam=0.0, solver="normal"),
    }
    return mo.train_regressor(
        table, candidates=candidates, time_limit=None, held=F.expr(HELD), **options)


@query("m1_train_regressor", f"""
WITH {_FITTED},
errors AS (SELECT avg(abs(a * x + b - wait_time_ms)) AS linear, avg(abs(m - wait_time_ms)) AS flat
           FROM d7, fit WHERE {HELD})
SELECT wave_id, {sql.r('wait_time_ms', 'wait_time_ms')}, {sql.r('x', 'x')},
       {sql.r('CASE WHEN linear <= flat THEN a * x + b ELSE m END', 'pred_wait_time_ms')}
FROM d7, fit, errors""")
def _(spark, sf):
    table = t.supplier_line(spark, sf)
    trained = _trained(table)
    return rounded(mo.score(table, trained.model, trained.features))


@query("m1_train_on_mixed_columns", f"""
WITH {_FITTED}
SELECT wave_id, {sql.r('wait_time_ms', 'wait_time_ms')}, s_name, {sql.r('x', 'x')},
       {sql.r('a * x + b', 'pred_wait_time_ms')}
FROM fit, d7 JOIN supplier ON s_suppkey = wave_id""")
def _(spark, sf):
    """A text column is no feature, and stays in the scored table."""
    names = t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("wave_id"), "s_name")
    table = t.supplier_line(spark, sf).join(names, "wave_id")
    trained = mo.train_regressor(
        table, candidates={"linear": LinearRegression(solver="normal")}, held=F.expr(HELD))
    return rounded(mo.score(table, trained.model, trained.features))


@query("m1_train_tree_models")
def _(spark, sf):
    table = _training(spark, sf)
    trained = mo.train_regressor(table, time_limit=None)
    return rounded(mo.score(table, trained.model, trained.features))


@query("m1b_fit_line", f"""
WITH {_SCORED} SELECT {sql.r('a', 'slope')}, {sql.r('b', 'intercept')} FROM line""")
def _(spark, sf):
    return rounded(mo.fit_line(t.supplier_line(spark, sf), "x")[1])


@query("m2_score", f"WITH {_SCORED} SELECT {_ALL} FROM scored")
def _(spark, sf):
    return rounded(_line_scores(spark, sf))


@query("m2_short_predictions", f"""
WITH {_SCORED} SELECT wave_id, {sql.r('pred_wait_time_ms', 'pred_wait_time_ms')} FROM scored""")
def _(spark, sf):
    return rounded(mo.short_predictions(_line_scores(spark, sf)))


_SCORES = f"""{_FITTED},
board AS (
  SELECT 'linear' AS model, -avg(abs(a * x + b - wait_time_ms)) AS score_val FROM d7, fit WHERE {HELD}
  UNION ALL SELECT 'flat', -avg(abs(m - wait_time_ms)) FROM d7, fit WHERE {HELD})"""


@query("m3_leaderboard", f"""
WITH {_SCORES} SELECT model, {sql.r('score_val', 'score_val')}, TRUE AS held_out FROM board""")
def _(spark, sf):
    board = mo.leaderboard(spark, _trained(t.supplier_line(spark, sf)))
    return rounded(board.drop("pred_time_val", "fit_time"))


FOLDS, ROUNDS = 3, 10


@query("m3_ensemble", f"""
WITH RECURSIVE {sql.SUPPLIER_LINE},
fits AS (SELECT f.fold, regr_slope(wait_time_ms, x) AS a, regr_intercept(wait_time_ms, x) AS b,
                avg(wait_time_ms) AS m
         FROM (SELECT DISTINCT wave_id % {FOLDS} AS fold FROM d7) f JOIN d7 ON wave_id % {FOLDS} <> fold
         GROUP BY f.fold),
oof AS (SELECT wait_time_ms AS y, a * x + b AS linear, m AS flat
        FROM d7 JOIN fits ON wave_id % {FOLDS} = fold),
grid AS (SELECT i, j, avg(abs((i * linear + j * flat) / (i + j) - y)) AS mae
         FROM oof, range(0, {ROUNDS + 1}) i(i), range(0, {ROUNDS + 1}) j(j)
         WHERE i + j BETWEEN 1 AND {ROUNDS} GROUP BY i, j),
steps AS (
  SELECT 0 AS n, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j
  UNION ALL
  SELECT n + 1, CASE WHEN l.mae <= f.mae THEN l.i ELSE f.i END, CASE WHEN l.mae <= f.mae THEN l.j ELSE f.j END
  FROM steps JOIN grid l ON l.i = steps.i + 1 AND l.j = steps.j
             JOIN grid f ON f.i = steps.i AND f.j = steps.j + 1
  WHERE n < {ROUNDS}),
done AS (SELECT steps.i, steps.j, mae FROM steps JOIN grid USING (i, j) WHERE n = {ROUNDS})
SELECT 'linear' AS model, {sql.r(f'i / CAST({ROUNDS} AS DOUBLE)', 'weight')}, {sql.r('alone', 'mae')},
       {sql.r('done.mae', 'ensemble_mae')}
FROM done, (SELECT avg(abs(linear - y)) AS alone FROM oof)
UNION ALL
SELECT 'flat', {sql.r(f'j / CAST({ROUNDS} AS DOUBLE)', 'weight')}, {sql.r('alone', 'mae')},
       {sql.r('done.mae', 'ensemble_mae')}
FROM done, (SELECT avg(abs(flat - y)) AS alone FROM oof)""")
def _(spark, sf):
    """Greedy weights of two candidates from predictions for waves they were not fitted to."""
    candidates = {
        "linear": LinearRegression(regParam=0.0, solver="normal"),
        "flat": LinearRegression(regParam=1e12, solver="normal"),
    }
    table = t.supplier_line(spark, sf)
    predictions = mo.out_of_fold(table, candidates, F.col("wave_id") % FOLDS, FOLDS)
    return rounded(mo.select_ensemble(predictions, list(candidates), ROUNDS))


REPEATS = 5
_P_VALUE = """0.5 - CAST('0.375' AS DOUBLE) * (t / sqrt(1 + t * t / 4))
              * (1 - t * t / (12 * (1 + t * t / 4)))"""


def _importance_stats(source: str) -> str:
    """Mean, spread, one-sided p-value and 99 % interval of five repeats per feature."""
    return f"""
tested AS (SELECT *, importance / (stddev / sqrt(CAST(5 AS DOUBLE))) AS t,
                  CAST('4.604094871415897' AS DOUBLE) * stddev / sqrt(CAST(5 AS DOUBLE)) AS half
           FROM {source}),
imp AS (
  SELECT feature, {sql.r('importance', 'importance')}, {sql.r('stddev', 'stddev')},
         {sql.r(_P_VALUE, 'p_value')}, CAST(5 AS BIGINT) AS n,
         {sql.r('importance + half', 'p99_high')}, {sql.r('importance - half', 'p99_low')}
  FROM tested)"""


def _plane(spark, sf):
    """Regression table with two features: mean quantity and mean discount."""
    more = t.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("wave_id")).agg(
        (F.avg("l_discount") * 100).alias("z"))
    return t.supplier_line(spark, sf).join(more, "wave_id")


# Least squares with two features by the normal equations, and a random order of the
# waves per repeat.
_SHUFFLED = f"""{sql.SUPPLIER_LINE},
plane AS (SELECT d7.*, z FROM d7 JOIN (SELECT l_suppkey AS wave_id, avg(l_discount) * 100 AS z
                                       FROM lineitem GROUP BY 1) USING (wave_id)),
sums AS (SELECT covar_pop(x, wait_time_ms) AS xy, covar_pop(z, wait_time_ms) AS zy, covar_pop(x, z) AS xz,
                var_pop(x) AS xx, var_pop(z) AS zz, avg(x) AS mx, avg(z) AS mz, avg(wait_time_ms) AS my
         FROM plane),
model AS (SELECT (xy * zz - zy * xz) / (xx * zz - xz * xz) AS a,
                 (zy * xx - xy * xz) / (xx * zz - xz * xz) AS c, mx, mz, my FROM sums),
base AS (SELECT wave_id, x, z, wait_time_ms,
                abs(my + a * (x - mx) + c * (z - mz) - wait_time_ms) AS e,
                row_number() OVER (ORDER BY wave_id) AS place FROM plane, model),
donor AS (SELECT k, x, z, row_number() OVER (
            PARTITION BY k ORDER BY md5(wave_id::VARCHAR || ':' || k::VARCHAR), wave_id) AS place
          FROM plane, range({REPEATS}) AS ks(k)),
rises AS (
  SELECT f.feature, k, avg(abs(my + a * (CASE WHEN feature = 'x' THEN d.x ELSE b.x END - mx)
           + c * (CASE WHEN feature = 'z' THEN d.z ELSE b.z END - mz) - wait_time_ms) - e) AS rise
  FROM base b JOIN donor d USING (place), model, (VALUES ('x'), ('z')) AS f(feature)
  GROUP BY f.feature, k),
summary AS (SELECT feature, avg(rise) AS importance, stddev_samp(rise) AS stddev
            FROM rises GROUP BY feature),
{_importance_stats('summary')}"""


@query("m4_permutation_importance", f"WITH {_SHUFFLED} SELECT * FROM imp")
def _(spark, sf):
    table = _plane(spark, sf)
    model = mo.fit_linear(table, ["x", "z"])

    def key(repeat):
        return F.md5(F.concat_ws(":", F.col("wave_id").cast("string"), repeat.cast("string")))
    return rounded(mo.permutation_importance(table, model, ["x", "z"], repeats=REPEATS, key=key))


@query("m4_feature_importance")
def _(spark, sf):
    table = _training(spark, sf)
    tree = {"tree": mo.default_candidates()["tree"]}
    trained = mo.train_regressor(table, candidates=tree)
    return rounded(mo.permutation_importance(table, trained.model, trained.features))


def _importances(spark, sf):
    """A table of means and spreads: the discounts of each supplier around 5 %."""
    away = F.col("l_discount") - F.lit(0.05)
    table = t.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("feature")).agg(
        F.avg(away).alias("importance"),
        (F.stddev_samp(away) / F.lit(20.0)).alias("stddev"),
    )
    return importance_stats(table, 5)


_IMPORTANCES = f"""
away AS (SELECT l_suppkey AS feature, l_discount - CAST('0.05' AS DOUBLE) AS d FROM lineitem),
base AS (SELECT feature, avg(d) AS importance, stddev_samp(d) / CAST(20 AS DOUBLE) AS stddev
         FROM away GROUP BY feature),
{_importance_stats('base')}"""


@query("m4b_importance_stats", f"WITH {_IMPORTANCES} SELECT * FROM imp")
def _(spark, sf):
    return rounded(_importances(spark, sf))


@query("l3_top_importances", f"""
WITH {_IMPORTANCES} SELECT * FROM imp
WHERE feature IN (SELECT feature FROM base ORDER BY importance DESC, feature LIMIT 15)""")
def _(spark, sf):
    return rounded(mo.top_importances(_importances(spark, sf)))


@query("l3_top_models", f"""
WITH {_SCORES} SELECT model, {sql.r('score_val', 'score_val')}, TRUE AS held_out FROM board
ORDER BY board.score_val DESC LIMIT 1""")
def _(spark, sf):
    board = mo.leaderboard(spark, _trained(t.supplier_line(spark, sf)), top=1)
    return rounded(board.drop("pred_time_val", "fit_time"))


@query("p9_residual_columns", f"""
WITH {_SCORED} SELECT {_ALL}, {sql.r('error_ms', 'error_ms')},
  {sql.r('abs_error_ms', 'abs_error_ms')} FROM errors""")
def _(spark, sf):
    return rounded(mo.residuals(_line_scores(spark, sf)))


@query("m5_residuals_of_features", f"""
WITH {sql.D2P}, {sql.settle()},
shape AS (SELECT wave_id, stddev_pop(value) AS std_all FROM p GROUP BY wave_id),
table_ AS (SELECT wave_id, wait_time_ms, std_all FROM s JOIN shape USING (wave_id)),
line AS (SELECT regr_slope(wait_time_ms, std_all) AS a, regr_intercept(wait_time_ms, std_all) AS b
         FROM table_)
SELECT wave_id, {sql.r('wait_time_ms', 'wait_time_ms', 4)}, {sql.r('std_all', 'std_all', 4)},
       {sql.r('a * std_all + b', 'pred_wait_time_ms', 4)},
       {sql.r('a * std_all + b - wait_time_ms', 'error_ms', 4)},
       {sql.r('abs(a * std_all + b - wait_time_ms)', 'abs_error_ms', 4)}
FROM table_, line""")
def _(spark, sf):
    table = grouped_features(t.price_signals(spark, sf), ["std_all"], label=Rule())
    model, _ = mo.fit_line(table, "std_all")
    return rounded(mo.residuals(mo.score(table, model, ["std_all"])), 4)


@query("m6_metrics", f"""
WITH {_SCORED}
SELECT count(*) AS n, {sql.r('avg(abs_error_ms)', 'mae')},
       {sql.r('sqrt(avg(error_ms * error_ms))', 'rmse')},
       {sql.r('max(abs_error_ms)', 'max_error')}, {sql.r('avg(error_ms)', 'bias')},
       {sql.r('1 - avg(error_ms * error_ms) / var_pop(wait_time_ms)', 'r2')}
FROM errors""")
def _(spark, sf):
    return rounded(mo.metrics(_line_scores(spark, sf)))


@query("m7_worst_predictions", f"""
WITH {_SCORED}
SELECT wave_id, {sql.r('wait_time_ms', 'wait_time_ms')},
       {sql.r('pred_wait_time_ms', 'pred_wait_time_ms')}, {sql.r('error_ms', 'error_ms')}
FROM (SELECT * FROM errors ORDER BY abs_error_ms DESC, wave_id LIMIT 10)""")
def _(spark, sf):
    return rounded(mo.worst_predictions(_line_scores(spark, sf)))


@query("l2_top_k_worst", f"""
WITH {_SCORED} SELECT wave_id FROM (SELECT * FROM errors ORDER BY abs_error_ms DESC, wave_id LIMIT 5)""")
def _(spark, sf):
    return mo.worst_predictions(_line_scores(spark, sf), k=5).select("wave_id")


@query("m8_diagnosis_report", f"""
WITH {_SCORED} SELECT {_ALL}, {sql.r('error_ms', 'error_ms')},
  {sql.r('abs_error_ms', 'abs_error_ms')} FROM errors""")
def _(spark, sf):
    return rounded(mo.diagnosis_report(_line_scores(spark, sf)))


@query("m8_train_with_predictions", f"""
WITH {_SCORED} SELECT {_ALL}, {sql.r('error_ms', 'error_ms')} FROM errors""")
def _(spark, sf):
    return rounded(mo.train_with_predictions(_line_scores(spark, sf)))


@query("s9_save_load_model", f"WITH {_SCORED} SELECT {_ALL} FROM scored")
def _(spark, sf):
    table = t.supplier_line(spark, sf)
    model, _ = mo.fit_line(table, "x")
    path = f"{checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    io.save_model(model, path)
    return rounded(mo.score(table, io.load_model(path), ["x"]))
