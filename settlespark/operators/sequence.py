"""Positions, differences, tails and forward conditions along a wave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from settlespark.functions.scalar import tail_length
from settlespark.plans.skew import DX, N, POS, Part
from settlespark.signals import Signals


def with_position(sig: Signals, pos: str = "pos", n: str = "n") -> DataFrame:
    """Add the 0-based position of each sample in its wave and the wave length."""
    return sig.per_row(lambda p: p.df.withColumnsRenamed({POS: pos, N: n}).drop(DX))


def with_diff(sig: Signals, name: str = "dx") -> DataFrame:
    """Add the difference to the previous sample (null on the first)."""
    return sig.per_row(lambda p: p.df.withColumnsRenamed({DX: name}).drop(POS, N))


def tail(sig: Signals, k: int | None = None, frac: float = 0.1) -> DataFrame:
    """The last ``k`` samples of each wave, or the last ``frac`` of them."""
    def cut(p: Part) -> DataFrame:
        length = F.least(F.lit(k), F.col(N)) if k is not None else tail_length(F.col(N), frac)
        return p.where(F.col(POS) >= F.col(N) - length).df.drop(POS, N, DX)
    return sig.per_row(cut)


def _out(sig: Signals, center: Column, band: Column) -> Column:
    value = F.col(sig.value)
    return ~F.isnan(value) & ~F.isnan(center) & (F.abs(value - center) > band)


def hold_ok(
    sig: Signals, center: Column, band: Column, m: int, name: str = "hold_ok"
) -> DataFrame:
    """Whether a sample starts ``m`` consecutive samples inside ``center ± band``.

    Null where fewer than ``m`` samples are left.  ``center`` and ``band`` may
    use the columns of the table.
    """
    def mark(p: Part) -> DataFrame:
        df = _next_out(p, F.when(_out(sig, center, band), F.col(POS)))
        clear = F.col("_next").isNull() | (F.col("_next") >= F.col(POS) + m)
        whole = F.col(POS) <= F.col(N) - m
        return df.withColumn(name, F.when(whole, clear)).drop(POS, N, DX, "_next")
    return sig.per_row(mark)


def _next_out(p: Part, at: Column, block: int = 65_536) -> DataFrame:
    """Add ``_next``, the first non-null ``at`` at or after each sample.

    Looking ahead is a running minimum in descending order, linear in the
    samples.  Hot waves look ahead inside a block and, when that finds nothing,
    take the first one of the following blocks (one row per block and wave).
    """
    id = p.sig.id
    if not p.hot:
        backwards = Window.partitionBy(id).orderBy(F.desc(POS))
        return p.df.withColumn(
            "_next", F.min(at).over(backwards.rowsBetween(Window.unboundedPreceding, 0))
        )
    df = p.df.withColumns({"_at": at, "_block": F.expr(f"{POS} div {block}")})
    ahead = Window.partitionBy(id, "_block").orderBy(F.desc(POS))
    later = Window.partitionBy(id).orderBy(F.desc("_block"))
    blocks = (
        df.groupBy(id, "_block").agg(F.min("_at").alias("_first"))
        .select(
            id, "_block",
            F.min("_first").over(later.rowsBetween(Window.unboundedPreceding, -1)).alias("_later"),
        )
    )
    return (
        df.withColumn("_here", F.min("_at").over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
        .join(blocks, [id, "_block"])
        .withColumn("_next", F.coalesce("_here", "_later"))
        .drop("_at", "_block", "_here", "_later")
    )


def stays_within(
    sig: Signals, center: Column, band: Column, name: str = "stays_within"
) -> DataFrame:
    """Whether a sample and all later ones of its wave lie inside ``center ± band``.

    True exactly after the last excursion, so one per-wave maximum decides it.
    A missing sample counts as outside.
    """
    def mark(p: Part) -> DataFrame:
        value = F.col(sig.value)
        out = F.isnan(value) | ~(F.abs(value - center) <= band)
        p = p.attach(_last=F.max(F.when(out, F.col(POS))))
        inside = F.col("_last").isNull() | (F.col(POS) > F.col("_last"))
        return p.df.withColumn(name, inside).drop(POS, N, DX, "_last")
    return sig.per_row(mark)


def last_excursion(
    sig: Signals, center: Column, band: Column, name: str = "last_excursion"
) -> DataFrame:
    """Per wave the last position outside ``center ± band``, null if there is none."""
    out = _out(sig, center, band)
    return sig.per_part(
        lambda p: p.collapse(**{name: F.max(F.when(out, F.col(POS)))}), *sig.df.columns
    )


def wave_slice(sig: Signals, id: object) -> DataFrame:
    """The samples of one wave sorted by time."""
    return sig.df.filter(F.col(sig.id) == F.lit(id)).orderBy(sig.time, *sig.order)


def sort_samples(sig: Signals) -> DataFrame:
    """All samples with an id sorted by wave and time; a range sort, so one wave may
    span tasks."""
    return sig.df.filter(F.col(sig.id).isNotNull()).orderBy(sig.id, sig.time, *sig.order)


