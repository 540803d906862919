"""Shape features of a wave as aggregate columns.

``BASE`` features are aggregates over the samples of a wave; ``DERIVED`` ones
are expressions over other features of the same row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from settlespark.functions.scalar import ratio_eps, tail_length
from settlespark.plans.skew import DX, N, POS

NAN = float("nan")
SKIPPED_DIFFS = 3  # differences left out at the start of ringing_energy


def _last(v: Column, k: int) -> Column:
    return F.when(F.col(POS) >= F.col(N) - k, v)


def _tenth(v: Column) -> Column:
    return F.when(F.col(POS) >= F.col(N) - tail_length(F.col(N), min_tail=1), v)


def _min(v: Column) -> Column:
    # min() ranks NaN last; pass it on as max() does
    return F.when(F.max(F.isnan(v)), F.lit(NAN)).otherwise(F.min(v))


def _max_dev(v: Column, at: Column) -> Column:
    # max |v - x_end| is reached at the largest or the smallest value
    end, tail = F.max_by(v, at), _last(v, 50)
    return F.greatest(F.max(tail) - end, end - _min(tail))


def _ringing(v: Column, at: Column) -> Column:
    moved = F.when(F.col(POS) > SKIPPED_DIFFS, F.abs(F.col(DX)))
    return F.coalesce(F.sum(moved), F.lit(0.0))


def _sum_squares(v: Column) -> Column:
    return F.var_pop(v) * F.count(v)


def _steps(reduce: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    # a wave of one sample has no difference; the tables carry 0 for it
    return lambda v, at: F.coalesce(reduce(F.col(DX)), F.lit(0.0))


# Aggregates of the value and a column that orders the samples.  Those named in
# UNPLACED need no position, so they are computed without sorting the samples.
BASE: dict[str, Callable[[Column, Column], Column]] = {
    "x0": lambda v, at: F.min_by(v, at),
    "x_end": lambda v, at: F.max_by(v, at),
    "mean_all": lambda v, at: F.avg(v),
    "std_all": lambda v, at: F.stddev_pop(v),
    "peak": lambda v, at: F.max(v),
    "trough": lambda v, at: _min(v),
    "std_tail_50": lambda v, at: F.stddev_pop(_last(v, 50)),
    "std_tail_150": lambda v, at: F.stddev_pop(_last(v, 150)),
    "max_dev_tail_50": _max_dev,
    "range_tail_50": lambda v, at: F.max(_last(v, 50)) - _min(_last(v, 50)),
    "ringing_energy": _ringing,
    "ringing_sq": lambda v, at: _sum_squares(_tenth(v)),
    "max_slope": _steps(F.max),
    "min_slope": _steps(_min),
    "mean_last": lambda v, at: F.avg(_last(v, 10)),
    "std_last": lambda v, at: F.stddev_pop(_last(v, 10)),
    "mean_tenth": lambda v, at: F.avg(_tenth(v)),
    "std_tenth": lambda v, at: F.stddev_pop(_tenth(v)),
}
UNPLACED = {"x0", "x_end", "mean_all", "std_all", "peak", "trough"}

DERIVED: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "settling_trend": (("std_tail_150", "std_tail_50"), ratio_eps),
    "stability_ratio": (("std_tail_50", "std_all"), ratio_eps),
    "trend_flag": (("settling_trend",), lambda trend: trend > F.lit(1.2)),
    "peak_rel": (("peak", "mean_last"), lambda peak, mean: peak - mean),
    "trough_rel": (("mean_last", "trough"), lambda mean, trough: mean - trough),
    "band_3std_last": (("std_last",), lambda std: F.greatest(std * 3.0, F.lit(1e-12))),
    "peak_rel_end": (("peak", "x_end"), lambda peak, end: peak - end),
    "peak_rel_tenth": (("peak", "mean_tenth"), lambda peak, mean: peak - mean),
    "trough_rel_tenth": (("mean_tenth", "trough"), lambda mean, trough: mean - trough),
    "band_3std_tenth": (("std_tenth",), lambda std: std * 3.0),
    "limit_low": (("mean_tenth",), lambda mean: mean - F.abs(mean * 0.01)),
    "limit_high": (("mean_tenth",), lambda mean: mean + F.abs(mean * 0.01)),
}

CURRENT = (
    "x_end", "std_all", "std_tail_50", "max_dev_tail_50",
    "settling_trend", "ringing_energy", "max_slope", "stability_ratio",
)
CLASSIC = (
    "x0", "x_end", "mean_all", "std_all", "mean_last", "std_last", "peak_rel", "trough_rel",
    "max_slope", "min_slope", "ringing_energy", "settle_idx", "band_3std_last",
)
LIMITS = (
    "limit_low", "limit_high", "x0", "x_end", "mean_all", "std_all", "mean_tenth", "std_tenth",
    "peak_rel_tenth", "trough_rel_tenth", "max_slope", "min_slope", "ringing_sq",
    "band_3std_tenth",
)
SETS = {"current": CURRENT, "classic": CLASSIC, "limits": LIMITS}


def resolve(names: list[str]) -> tuple[list[str], list[str]]:
    """The base and the derived features that ``names`` need, in build order."""
    base: list[str] = []
    derived: list[str] = []

    def need(name: str) -> None:
        if name in BASE:
            target = base
        elif name in DERIVED:
            for other in DERIVED[name][0]:
                need(other)
            target = derived
        else:
            raise ValueError(f"unknown feature {name!r}; known: {sorted([*BASE, *DERIVED])}")
        if name not in target:
            target.append(name)

    for name in names:
        need(name)
    return base, derived
