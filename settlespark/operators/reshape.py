"""Long, wide and array forms of a waveform table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlespark.functions.features import CURRENT
from settlespark.operators.features import grouped_features, meta_table
from settlespark.signals import Signals

SERIES = "i_"
TIME_NAMES = ("time", "time_ms")
CHUNK = 65_536
SEGMENT = 1024


_NUMBERED = re.compile(re.escape(SERIES) + r"(-?\d+)")


def series_columns(df: DataFrame) -> list[str]:
    """The ``i_<k>`` columns in numeric order; names like ``i_total`` are no samples."""
    found = {c: int(m[1]) for c in df.columns if (m := _NUMBERED.fullmatch(c))}
    return sorted(found, key=found.get)


def non_series_columns(df: DataFrame) -> DataFrame:
    """The table without its ``i_<k>`` columns."""
    return df.drop(*series_columns(df))


def meta_columns(
    sig: Signals, label: str = "wait_time_ms", exclude: Sequence[str] = TIME_NAMES
) -> list[str]:
    """Columns with a value per wave: all but id, order, value, label and time."""
    taken = {sig.id, *sig.order, sig.value, label, *exclude}
    return [c for c in sig.df.columns if c not in taken]


def _sample(sig: Signals) -> str:
    if len(sig.order) != 1:
        raise ValueError("reshaping needs one sample column; add one with with_position")
    return sig.order[0]


def duplicate_samples(sig: Signals) -> DataFrame:
    """(wave, sample) pairs that occur more than once, with their number."""
    counts = sig.samples.groupBy(sig.id, *sig.order).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > 1)


def to_wide(
    sig: Signals, samples: Sequence[int] | None = None, on_duplicate: str = "error",
    select: bool = False,
) -> DataFrame:
    """One row per wave with a column ``i_<sample>`` per sample, missing ones null.

    Naming the ``samples`` saves a job; without them the distinct ones are
    looked up, as they name the columns.  More than ``spark.sql.pivotMaxValues`` are
    not pivoted: their values are scattered into the arrays of ``to_dense`` first
    (samples must not be negative then).  A sample that is not named fails the job, so
    that none is lost unnoticed; ``select=True`` leaves such samples out.  A duplicate
    (wave, sample) fails the job, or gives the largest value with ``on_duplicate="max"``.
    """
    _check_duplicates(on_duplicate)
    sample = _sample(sig)
    if samples is None:
        samples = [r[0] for r in sig.samples.select(sample).distinct().collect()]
    samples = sorted(int(s) for s in samples)
    value: Column = F.max(sig.value)
    if on_duplicate == "error":
        message = F.format_string("duplicate sample %s of wave %s", F.first(sample), F.first(sig.id))
        value = F.when(F.count(F.lit(1)) > 1, F.raise_error(message)).otherwise(value)
    named = F.expr(f"`{sample}` IN ({', '.join(map(str, samples))})") if samples else F.lit(False)
    rows = sig.samples
    if select:
        # waves without a named sample keep their row
        rows = rows.withColumn(sample, F.when(named, F.col(sample)))
        value = F.when(F.first(sample).isNotNull(), value)
    else:
        lost = F.raise_error(F.format_string("sample %s of wave %s has no column", sample, sig.id))
        rows = rows.withColumn(sample, F.when(named, F.col(sample)).otherwise(lost.cast(rows.schema[sample].dataType)))
    if len(samples) > int(sig.df.sparkSession.conf.get("spark.sql.pivotMaxValues")):
        return _project_segments(sig.replace(rows), samples, on_duplicate)
    wide = rows.groupBy(sig.id).pivot(sample, samples).agg(value)
    return wide.withColumnsRenamed({str(s): f"{SERIES}{s}" for s in samples})


def _check_duplicates(on_duplicate: str) -> None:
    if on_duplicate not in ("error", "max"):
        raise ValueError(f"on_duplicate must be 'error' or 'max', not {on_duplicate!r}")


def to_dense(sig: Signals, width: int = SEGMENT, on_duplicate: str = "error") -> DataFrame:
    """Arrays with a place for every sample number: one row per wave and ``segment`` of
    ``width`` numbers, whose ``values`` hold sample ``segment * width + k`` at place
    ``k``, null where the wave has none.

    A segment without a sample has no row.  A wave of any length is spread over its
    segments, so no row or task holds it whole.  Sample numbers must not be negative
    or null.  Duplicates are treated as in ``to_wide``.
    """
    _check_duplicates(on_duplicate)
    sample = _sample(sig)
    rows = sig.samples
    if on_duplicate == "max":
        rows = rows.groupBy(sig.id, sample).agg(F.max(sig.value).alias(sig.value))
    number = F.col(sample).cast("long")
    refused = F.raise_error(F.format_string("sample %s of wave %s has no place", sample, sig.id)).cast("long")
    number = F.when(number >= 0, number).otherwise(refused)
    slots = rows.select(sig.id, number.alias("_n"), F.col(sig.value).alias("_v")).select(
        sig.id, F.expr(f"_n div {width}").alias("segment"), (F.col("_n") % width).cast("int").alias("slot"), "_v")
    pairs = slots.groupBy(sig.id, "segment").agg(F.array_sort(F.collect_list(F.struct("slot", "_v"))).alias("pairs"))
    twice = F.raise_error(F.format_string(
        "duplicate sample in segment %s of wave %s", F.col("segment"), F.col(sig.id))).cast("int")

    def run(pair: Column, at: Column) -> Column:
        """The value after as many nulls as numbers are missing before it."""
        last = F.coalesce(F.get("pairs", at - 1)["slot"], F.lit(-1))
        gap = F.when(pair["slot"] > last, pair["slot"] - last - 1).otherwise(twice)
        return F.concat(_nulls(gap), F.array(pair["_v"]))

    rest = _nulls(F.lit(width - 1) - F.element_at("pairs", -1)["slot"])
    return pairs.select(sig.id, "segment", F.concat(F.flatten(F.transform("pairs", run)), rest).alias("values"))


def _nulls(n: Column) -> Column:
    return F.array_repeat(F.lit(None).cast("double"), n)


def _project_segments(sig: Signals, samples: Sequence[int], on_duplicate: str) -> DataFrame:
    """The wide table from the arrays of ``to_dense``; a null sample only keeps its wave."""
    if samples[0] < 0:
        raise ValueError("more samples than Spark pivots must not be negative")
    named = sig.replace(sig.df.filter(F.col(_sample(sig)).isNotNull()))
    kept = sig.samples.filter(F.col(_sample(sig)).isNull()).select(
        sig.id, F.lit(None).cast("long").alias("segment"), F.lit(None).cast("array<double>").alias("values"))
    arrays = to_dense(named, SEGMENT, on_duplicate).unionByName(kept)
    used = sorted({s // SEGMENT for s in samples})
    wide = arrays.groupBy(sig.id).agg(*[
        F.max(F.when(F.col("segment") == k, F.col("values"))).alias(f"_segment_{k}") for k in used])
    # as text, since thousands of column objects take the driver minutes
    return wide.selectExpr(f"`{sig.id}`", *[
        f"get(_segment_{s // SEGMENT}, {s % SEGMENT}) AS `{SERIES}{s}`" for s in samples])


def to_array(sig: Signals, chunk: int = CHUNK) -> DataFrame:
    """Ordered value arrays: one row per wave and block of ``chunk`` sample numbers.

    Waves up to ``chunk`` samples give one row with ``part`` 0; longer ones give
    several, so that no row has to hold an unbounded wave.
    """
    sample = _sample(sig)
    pairs = F.array_sort(F.collect_list(F.struct(sample, sig.value)))
    return (
        sig.samples.groupBy(sig.id, F.expr(f"`{sample}` div {chunk}").cast("long").alias("part"))
        .agg(F.transform(pairs, lambda p: p[sig.value]).alias("values"))
    )


def to_long(
    wide: DataFrame, id: str = "wave_id", sample: str = "sample", value: str = "value",
    drop_missing: bool = True,
) -> DataFrame:
    """One row per wave and sample from the ``i_<k>`` columns of a wide table."""
    columns = series_columns(wide)
    if not columns:
        raise ValueError(f"a wide table needs columns named {SERIES}<number>; it has {wide.columns}")
    long = wide.unpivot([id], columns, "_series", value).select(
        id, F.substring("_series", len(SERIES) + 1, 10).cast("int").alias(sample), value
    )
    return drop_missing_samples(long, value) if drop_missing else long


def drop_missing_samples(df: DataFrame, value: str = "value") -> DataFrame:
    """Remove null and NaN samples; positions computed later close up."""
    return df.filter(F.col(value).isNotNull() & ~F.isnan(value))


def fill_series(wide: DataFrame, fill: float = 0.0) -> DataFrame:
    """Replace missing ``i_<k>`` values, for models that take no missing ones."""
    return wide.fillna(fill, subset=series_columns(wide))


def attach_meta(wide: DataFrame, meta: DataFrame, id: str = "wave_id") -> DataFrame:
    """Left join of a table with one row per wave."""
    return wide.join(meta, id, "left")


def append_features(df: DataFrame, features: DataFrame, id: str = "wave_id") -> DataFrame:
    """Put feature columns beside a table by wave id (never by row position)."""
    return df.join(features, id, "left")


def wide_with_meta(
    sig: Signals, samples: Sequence[int] | None = None, label: str = "wait_time_ms",
    exclude: Sequence[str] = TIME_NAMES,
) -> DataFrame:
    """Wide table with the first meta values and, if the table has it, the label."""
    meta = meta_columns(sig, label, exclude) + ([label] if label in sig.df.columns else [])
    wide = to_wide(sig, samples)
    return attach_meta(wide, meta_table(sig, meta), sig.id) if meta else wide


def wide_plus_features(
    sig: Signals,
    samples: Sequence[int] | None = None,
    features: str | Sequence[str] = CURRENT,
    label: str = "wait_time_ms",
    exclude: Sequence[str] = TIME_NAMES,
    fill: float = 0.0,
) -> DataFrame:
    """Scoring table: raw samples, first meta values and features of each wave.

    Features come from the existing samples only; missing raw samples are
    filled afterwards.
    """
    present = sig.replace(sig.df, missing="skip")
    table = grouped_features(present, features, meta=meta_columns(sig, label, exclude))
    return fill_series(append_features(to_wide(sig, samples), table, sig.id), fill)
