"""Building blocks of the comparison SQL."""

from __future__ import annotations

PRICE_ORDER = "time_ms, order_key, line_no, part_key, price"
EVENT_ORDER = "time_ms, event_id"

EMBEDDINGS = """
d1 AS (
  SELECT wave_id, sample, CAST(sample AS DOUBLE) * CAST('0.01' AS DOUBLE) AS time_ms,
         CAST(x AS DOUBLE) AS value, label
  FROM (SELECT vec_id AS wave_id, label, unnest(embedding) AS x,
               CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS sample
        FROM embeddings))"""

PRICES = """
d2 AS (
  SELECT wave_id, time_ms, order_key, line_no, part_key, price,
         CAST(50 AS DOUBLE) + swing * (share * share) AS value, quantity, flag
  FROM (SELECT l_suppkey AS wave_id, l_orderkey AS order_key, l_linenumber AS line_no,
               l_partkey AS part_key, l_extendedprice AS price, l_quantity AS quantity,
               l_returnflag AS flag, time_ms,
               (CASE WHEN l_linenumber % 2 = 0 THEN CAST(1 AS DOUBLE)
                     ELSE CAST(-1 AS DOUBLE) END)
                 * (l_extendedprice / CAST(1000 AS DOUBLE)) AS swing,
               CAST('100.3' AS DOUBLE) / (CAST('100.3' AS DOUBLE) + time_ms) AS share
        FROM (SELECT *, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))
                             AS DOUBLE) AS time_ms FROM lineitem)))"""

EVENTS = """
d3 AS (
  SELECT wave_id, time_ms, event_id,
         CAST(100 AS DOUBLE) + (amount - CAST(50 AS DOUBLE)) * (share * share) AS value,
         kind, amount
  FROM (SELECT *, CAST(86400000 AS DOUBLE) / (CAST(86400000 AS DOUBLE) + time_ms) AS share
        FROM (SELECT user_id AS wave_id, event_id, event_type AS kind, value AS amount,
                     (epoch_us(ts) - 1704067200000000) / CAST(1000 AS DOUBLE) AS time_ms
              FROM events)))"""

SUPPLIER_LINE = """
d7 AS (
  SELECT l_suppkey AS wave_id, avg(l_extendedprice) / CAST(1000 AS DOUBLE) AS wait_time_ms,
         avg(l_quantity) AS x
  FROM lineitem GROUP BY l_suppkey)"""


def r(expression: str, name: str, digits: int = 6) -> str:
    """A rounded column without negative zero."""
    return f"round({expression}, {digits}) + CAST(0 AS DOUBLE) AS {name}"


def positions(source: str, order: str, name: str = "p") -> str:
    return f"""
{name} AS (
  SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY wave_id) AS n,
         value - lag(value) OVER w AS dx
  FROM {source} WINDOW w AS (PARTITION BY wave_id ORDER BY {order}))"""


D1P = f"{EMBEDDINGS}, {positions('d1', 'sample')}"
D2P = f"{PRICES}, {positions('d2', PRICE_ORDER)}"
D3P = f"{EVENTS}, {positions('d3', EVENT_ORDER)}"

TAIL = "(CASE WHEN n // 10 = 0 THEN n ELSE n // 10 END)"


def settle(
    rule: str = "hold", tol: str = "0.01", hold: int = 50, anchor: str = "hold",
    abs_tol: str | None = None, never: str = "0", source: str = "p", name: str = "s",
) -> str:
    """CTE ``name``: one row per wave with j, settle_idx and wait_time_ms."""
    tol = f"CAST('{tol}' AS DOUBLE)"
    if rule == "suffix":
        target = "avg(value) FILTER (pos >= n - 10)"
        band = (
            "greatest(stddev_pop(value) FILTER (pos >= n - 10) * CAST(3 AS DOUBLE),"
            " CAST('1e-12' AS DOUBLE))"
        )
        out = "NOT (abs(value - target) <= tol)"
    else:
        how = "median" if rule == "hold" else "avg"
        target = f"{how}(value) FILTER (pos >= n - {TAIL})"
        band = f"abs(({target}) * {tol})"
        if abs_tol:
            band = f"greatest({band}, CAST('{abs_tol}' AS DOUBLE))"
        out = (
            "abs(value - target) > tol" if rule == "hold"
            else "(value < target - tol OR value > target + tol)"
        )
    if rule == "hold":
        step = hold if anchor == "hold" else 1
        index = f"""CASE WHEN n < {hold} THEN n - 1 WHEN j IS NULL THEN {never}
                         WHEN j >= n - {hold} THEN n - 1 ELSE least(j + {step}, n - 1) END"""
    else:
        index = f"CASE WHEN j IS NULL THEN {never} ELSE least(j + 1, n - 1) END"
    return f"""
{name}_t AS (
  SELECT wave_id, {target} AS target, {band} AS tol FROM {source} GROUP BY wave_id),
{name}_j AS (
  SELECT wave_id, max(n) AS n, any_value(target) AS target, any_value(tol) AS tol,
         max(CASE WHEN {out} THEN pos END) AS j
  FROM {source} JOIN {name}_t USING (wave_id) GROUP BY wave_id),
{name}_i AS (SELECT *, {index} AS settle_idx FROM {name}_j),
{name} AS (
  SELECT i.*, q.time_ms AS wait_time_ms
  FROM {name}_i i JOIN {source} q ON q.wave_id = i.wave_id AND q.pos = i.settle_idx)"""


_LAST10, _LAST50, _LAST150 = (f"FILTER (pos >= n - {k})" for k in (10, 50, 150))
_TENTH = "FILTER (pos >= n - greatest(n // 10, 1))"
_EPS = "CAST('1e-9' AS DOUBLE)"

# Aggregates over the samples of a wave.
FEATURES = {
    "x0": "min_by(value, pos)",
    "x_end": "max_by(value, pos)",
    "mean_all": "avg(value)",
    "std_all": "stddev_pop(value)",
    "std_tail_50": f"stddev_pop(value) {_LAST50}",
    "std_tail_150": f"stddev_pop(value) {_LAST150}",
    "max_dev_tail_50": (
        f"greatest(max(value) {_LAST50} - max_by(value, pos),"
        f" max_by(value, pos) - min(value) {_LAST50})"
    ),
    "range_tail_50": f"max(value) {_LAST50} - min(value) {_LAST50}",
    "settling_trend": f"(stddev_pop(value) {_LAST150}) / (stddev_pop(value) {_LAST50} + {_EPS})",
    "ringing_energy": "coalesce(sum(abs(dx)) FILTER (pos > 3), CAST(0 AS DOUBLE))",
    "ringing_sq": f"(var_pop(value) {_TENTH}) * (count(*) {_TENTH})",
    "max_slope": "max(dx)",
    "min_slope": "min(dx)",
    "stability_ratio": f"(stddev_pop(value) {_LAST50}) / (stddev_pop(value) + {_EPS})",
    "mean_last": f"avg(value) {_LAST10}",
    "std_last": f"stddev_pop(value) {_LAST10}",
    "peak_rel": f"max(value) - avg(value) {_LAST10}",
    "trough_rel": f"(avg(value) {_LAST10}) - min(value)",
    "band_3std_last": (
        f"greatest((stddev_pop(value) {_LAST10}) * CAST(3 AS DOUBLE), CAST('1e-12' AS DOUBLE))"
    ),
    "peak_rel_end": "max(value) - max_by(value, pos)",
    "mean_tenth": f"avg(value) {_TENTH}",
    "std_tenth": f"stddev_pop(value) {_TENTH}",
    "peak_rel_tenth": f"max(value) - avg(value) {_TENTH}",
    "trough_rel_tenth": f"(avg(value) {_TENTH}) - min(value)",
    "band_3std_tenth": f"(stddev_pop(value) {_TENTH}) * CAST(3 AS DOUBLE)",
    "limit_low": f"(avg(value) {_TENTH}) - abs((avg(value) {_TENTH}) * CAST('0.01' AS DOUBLE))",
    "limit_high": f"(avg(value) {_TENTH}) + abs((avg(value) {_TENTH}) * CAST('0.01' AS DOUBLE))",
}


def features(names: tuple[str, ...], digits: int = 6, guard: int = 0) -> str:
    """Rounded feature columns, null for waves shorter than ``guard``."""
    def column(name: str) -> str:
        expression = FEATURES[name]
        if guard:
            expression = f"CASE WHEN max(n) >= {guard} THEN {expression} END"
        return r(expression, name, digits)
    return ", ".join(column(n) for n in names)
