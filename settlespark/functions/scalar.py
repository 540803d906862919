"""Column helpers shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def ratio_eps(a: Column, b: Column) -> Column:
    """``a / (b + 1e-9)``: a ratio that stays finite for a zero denominator."""
    return a / (b + F.lit(EPS))


def tail_length(n: Column, frac: float = 0.1, min_tail: int = 0) -> Column:
    """Samples in the last ``frac`` of a wave; a length of 0 means the whole wave."""
    if frac == 0.1:
        k = F.floor(n / F.lit(10)).cast("long")
    else:
        k = F.floor(n * F.lit(float(frac))).cast("long")
    if min_tail:
        k = F.greatest(k, F.lit(min_tail).cast("long"))
    return F.when(k == 0, n).otherwise(k)


def clamp_index(idx: Column, n: Column) -> Column:
    """``min(idx, n - 1)``."""
    return F.least(idx, n - 1)


def is_missing(x: Column) -> Column:
    """Whether a floating-point value is null or NaN."""
    return x.isNull() | F.isnan(x)


def grid_scale(top: Column) -> Column:
    """The power of two that takes numbers up to ``top`` to integers below 2^53."""
    # log2 may be off by one at a power of two, which the spare bit allows for
    exponent = F.greatest(F.floor(F.log2(F.when(top > 0, top).otherwise(F.lit(1.0)))), F.lit(-960))
    return F.pow(F.lit(2.0), F.lit(51) - exponent)


def on_grid(x: Column, top: Column) -> Column:
    """``x`` as an integer of the grid of ``top``; null unless all are finite numbers.

    Sums of such integers are exact and do not depend on their order.
    """
    finite = ~F.isnan(top) & (top < F.lit(float("inf")))
    return F.when(finite, F.rint(x * grid_scale(top))).cast("decimal(16,0)")


def uniform(seed: int, *keys: str | Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Uniform numbers in ``[low, high)`` that depend only on the keys and the seed."""
    unit = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return F.lit(low) + unit * F.lit(high - low)


def box_muller(a: Column, b: Column) -> Column:
    """Standard normal numbers from two independent uniforms in [0, 1)."""
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - a)) * F.cos(F.lit(2 * math.pi) * b)


def gaussian(seed: int, *keys: str | Column) -> Column:
    """Standard normal numbers that depend only on the keys and the seed."""
    return box_muller(uniform(2 * seed, *keys), uniform(2 * seed + 1, *keys))
