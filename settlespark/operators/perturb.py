"""Controlled defects added to an existing waveform table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlespark.functions.scalar import gaussian, is_missing, uniform
from settlespark.operators.joins import disjoint_ids, smallest
from settlespark.plans.skew import N, POS, Part
from settlespark.signals import OWN, Signals


def sample_ids(
    df: DataFrame, k: int, seed: int, id: str = "wave_id", key: Column | None = None
) -> DataFrame:
    """``k`` distinct ids without replacement, in the order of a keyed hash.

    ``key`` replaces the hash; ties are broken by the id.
    """
    key = F.xxhash64(id, F.lit(seed)) if key is None else key
    return smallest(df.select(id).distinct(), [key, F.col(id)], k)


def disjoint_groups(
    df: DataFrame, k: int, seed: int, id: str = "wave_id", key: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Two samples of ``k`` ids that share none."""
    first = sample_ids(df, k, seed, id, key)
    rest = disjoint_ids(df, first, id)
    return first, sample_ids(rest, k, seed + 1, id, key)


def _on_chosen(sig: Signals, ids: DataFrame, change) -> DataFrame:
    """Apply ``change`` to the samples of chosen waves; the others are not shuffled."""
    columns = sig.df.columns
    own = sig.replace(sig.df.withColumn(OWN, F.col(sig.value)))
    chosen = own.replace(own.samples.join(ids.select(sig.id), sig.id, "left_semi"))
    others = own.samples.join(ids.select(sig.id), sig.id, "left_anti")
    changed = chosen.per_part(change, *columns, OWN)
    # a null value stays null, whatever is added to it
    value = F.when(F.col(OWN).isNotNull(), F.col(sig.value)).alias(sig.value)
    return sig.with_own(others).select(*columns).unionByName(
        changed.select(*[value if c == sig.value else c for c in columns]))


def inject_late_oscillation(
    sig: Signals,
    ids: DataFrame,
    amplitude: Column | None = None,
    frequency: Column | None = None,
    start: float = 0.6,
    seed: int = 0,
) -> DataFrame:
    """Add a sine from ``start`` of the wave on to the chosen waves.

    Amplitude and frequency (Hz, time in ms) default to keyed uniforms: 0.4 to
    0.9 of ``high_limit - low_limit`` and 30 to 100 Hz.
    """
    if amplitude is None:
        share = uniform(2 * seed, sig.id, low=0.4, high=0.9)
        amplitude = (F.col("high_limit") - F.col("low_limit")) * share
    if frequency is None:
        frequency = uniform(2 * seed + 1, sig.id, low=30.0, high=100.0)
    seconds = F.col(sig.time) / F.lit(1000.0)
    wave = amplitude * F.sin(F.lit(2 * math.pi) * frequency * seconds)

    def shake(p: Part) -> DataFrame:
        late = F.col(POS) >= F.floor(F.col(N) * F.lit(start))
        return p.df.withColumn(sig.value, F.when(late, p.value + wave).otherwise(p.value))
    return _on_chosen(sig, ids, shake)


def truncate_waves(
    sig: Signals, ids: DataFrame, keep: Column | None = None, seed: int = 0
) -> DataFrame:
    """Keep the first part of the chosen waves, a keyed 50 to 90 % by default."""
    keep = uniform(seed, sig.id, low=0.5, high=0.9) if keep is None else keep
    return _on_chosen(
        sig, ids, lambda p: p.where(F.col(POS) < F.floor(F.col(N) * keep)).df
    )


def add_noise(
    sig: Signals, sd: float | Column, seed: int, normal: Column | None = None
) -> DataFrame:
    """Add Gaussian noise that depends on wave, sample and seed only; null stays null.

    ``normal`` replaces the keyed standard normal numbers.
    """
    sd = sd if isinstance(sd, Column) else F.lit(float(sd))
    noise = sd * (gaussian(seed, sig.id, *sig.order) if normal is None else normal)
    rows = sig.df.filter(F.col(sig.id).isNotNull())
    if sig.missing == "skip":
        rows = rows.filter(~is_missing(F.col(sig.value).cast("double")))
    return rows.withColumn(sig.value, F.col(sig.value).cast("double") + noise)


def limit_band(df: DataFrame, center: str, band: str | Column) -> DataFrame:
    """Add ``low_limit`` and ``high_limit`` at half a band from the centre."""
    half = (F.col(band) if isinstance(band, str) else band) / 2.0
    return df.withColumns({
        "low_limit": F.col(center) - half, "high_limit": F.col(center) + half,
    })
