"""Splitting waves too large for one task from the rest, and the exact
distributed forms of the per-wave window work for them.

A window over ``partitionBy(wave)`` gives each wave to one task, which is the
right plan (one exchange, one sort) as long as a wave fits a task.  A wave that
holds a large share of the table does not, so such *hot* waves are cut into
ranges of their own order, numbered per range, and stitched with one small row
per (wave, range).
"""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from settlespark.signals import Signals

POS, N, DX = "_pos", "_n", "_dx"
SEG = "_seg"

# A hot id costs 8 bytes of a broadcast; there are at most rows / hot_rows.
MAX_BROADCAST_IDS = 1_000_000
ROWS_PER_RANGE = 1_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        # one JVM does all the work, and the folder goes with it
        path = tempfile.mkdtemp(prefix="settlespark-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


_FROZEN: list[str] = []


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there.

    Partition numbers in it survive lost executors, and later passes read only
    the columns they use.  The table stays until :func:`scratch` ends or the folder
    is cleared.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _FROZEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of frozen tables, which nothing may read any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


@contextmanager
def kept_paths() -> Iterator[list[str]]:
    """A list that holds, when the block ends, the folders frozen inside it."""
    start, paths = len(_FROZEN), []
    try:
        yield paths
    finally:
        paths += _FROZEN[start:]
        del _FROZEN[start:]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables frozen inside this block when it ends.

    What the block returns must not read them any more: write results inside it.
    """
    with kept_paths() as paths:
        yield
    delete(spark, paths)


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint when the known row bound is small, plain join otherwise."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_IDS else df


def order_key(order: list[str]) -> Column:
    """One column that orders the samples; a plain one keeps aggregation hash-based."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_count(df: DataFrame, rows: int, rows_per_range: int = ROWS_PER_RANGE) -> int:
    return max(shuffle_partitions(df), math.ceil(rows / rows_per_range))


def number_rows(df: DataFrame, keys: list[str | Column], name: str) -> DataFrame:
    """Add the 0-based rank of each row in the order of ``keys`` over the whole table.

    Rows are numbered inside the range partitions of a distributed sort and
    shifted by the sizes of the partitions before (one row per partition), so
    no task sees the whole table.  The numbers are frozen before they are used
    twice.
    """
    ranged = freeze(df.orderBy(*keys).withColumn("_mono", F.monotonically_increasing_id()))
    # one row per partition of that sort
    parts = shuffle_partitions(df)
    # monotonically_increasing_id: partition in the upper 31 bits, row in the lower 33.
    ranged = ranged.withColumns({
        SEG: F.shiftright("_mono", 33), name: F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)),
    }).drop("_mono")
    before = Window.orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(SEG).agg(F.count(F.lit(1)).alias("_rows")).select(
        SEG, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    return (
        ranged.join(bounded_broadcast(starts, parts), SEG)
        .withColumn(name, F.col("_start") + F.col(name))
        .drop(SEG, "_start")
    )


@dataclass(frozen=True)
class Part:
    """Samples of a set of waves with their position, wave length and difference."""

    df: DataFrame
    sig: Signals
    hot: bool

    @property
    def value(self) -> Column:
        return F.col(self.sig.value)

    def where(self, condition: Column) -> Part:
        return replace(self, df=self.df.filter(condition))

    def with_columns(self, **columns: Column) -> Part:
        return replace(self, df=self.df.withColumns(columns))

    def attach(self, medians: dict[str, Column] | None = None, **aggregates: Column) -> Part:
        """Put per-wave aggregates, and exact ``medians`` of non-null values, on the samples."""
        medians = medians or {}
        if not self.hot:
            wave = Window.partitionBy(self.sig.id)
            aggregates |= {name: F.median(x) for name, x in medians.items()}
            return self.with_columns(**{k: c.over(wave) for k, c in aggregates.items()})
        # per-wave figures are frozen, as every later pass joins them again
        df = self.df
        if aggregates:
            df = df.join(self._small(freeze(self.collapse(**aggregates))), self.sig.id)
        for name, x in medians.items():
            rows = self.df.select(self.sig.id, x.alias("_v")).filter(F.col("_v").isNotNull())
            median = freeze(exact_median(rows, self.sig.id, "_v", name, self.sig.hot_count))
            df = df.join(self._small(median), self.sig.id, "left")
        return replace(self, df=df)

    def collapse(self, **aggregates: Column) -> DataFrame:
        """One row per wave; partial aggregation runs before any exchange."""
        return self.df.groupBy(self.sig.id).agg(*[c.alias(k) for k, c in aggregates.items()])

    def _small(self, per_wave: DataFrame) -> DataFrame:
        return bounded_broadcast(per_wave, self.sig.hot_count)


def exact_median(
    df: DataFrame, id: str, x: str, name: str, groups: int, accuracy: int = 20_000, held: int = 10_000
) -> DataFrame:
    """Exact median of ``x`` for each of at most ``groups`` ids, without gathering a group.

    Selection by narrowing brackets: a quantile sketch of known rank error brackets the
    two middle ranks, one pass counts the rows below, at the ends of and inside the
    bracket, and the next sketch looks inside only.  Every pass is an aggregation with one
    row per id and leaves a share of about ``16 / accuracy`` of the rows inside, so two or
    three suffice for any wave.  When at most ``held`` rows are left inside, they are
    sorted as one bounded array.
    """
    def fine(margin: float) -> Column:
        return F.percentile_approx(x, [0.5 - margin, 0.5 + margin], accuracy)

    margin, none = 4.0 / accuracy, F.lit(None).cast("double")
    # ranks _k and _l count from the rows at _low, of which there are _at_low
    state = freeze(df.groupBy(id).agg(F.count(F.lit(1)).alias("_m"), fine(margin).alias("_f")).select(
        id, F.expr("(_m - 1) div 2").alias("_k"), F.expr("_m div 2").alias("_l"), F.col("_m").alias("_in"),
        F.lit(0).cast("long").alias("_at_low"), none.alias("_low"), none.alias("_high"),
        F.col("_f")[0].alias("_a"), F.col("_f")[1].alias("_b")))
    above = F.col("_low").isNull() | (F.col(x) > F.col("_low"))
    inside = above & (F.col("_high").isNull() | (F.col(x) < F.col("_high")))
    while True:
        # what lies below, at the ends of and inside the new bracket
        a, b, v = F.col("_a"), F.col("_b"), F.col(x)
        counted = df.join(bounded_broadcast(state.filter("_a is not null"), groups), id).filter(inside).groupBy(id).agg(
            F.count_if(v < a).alias("_below"), F.count_if(v == a).alias("_ends"),
            F.count_if((v > a) & (v < b)).alias("_left"))
        shift, new = F.col("_at_low") + F.col("_below"), F.col("_below").isNotNull()
        state = freeze(state.join(counted, id, "left").select(id, *[
            F.when(new, value).otherwise(F.col(old)).alias(old) for old, value in (
                ("_k", F.col("_k") - shift), ("_l", F.col("_l") - shift), ("_in", F.col("_left")),
                ("_at_low", F.col("_ends")), ("_low", a), ("_high", b))]))
        known = bounded_broadcast(state, groups)
        open_ = (F.col("_in") > held) & (F.col("_l") >= F.col("_at_low")) & (F.col("_k") < F.col("_at_low") + F.col("_in"))
        if state.filter(open_).isEmpty():
            break
        # where the ranks lie among the rows inside, and quantiles around them
        rows = F.greatest("_in", F.lit(1))
        first = F.greatest(F.col("_k") - F.col("_at_low"), F.lit(0)) / rows
        last = F.least(F.col("_l") - F.col("_at_low"), F.col("_in") - 1) / rows
        grid = F.percentile_approx(x, [i / 64 for i in range(65)], accuracy)
        sketch = df.join(bounded_broadcast(state.filter(open_), groups), id).filter(inside).groupBy(id).agg(
            grid.alias("_q"), fine(margin).alias("_f"))
        middle = (first > 0.5 - margin / 2) & (last < 0.5 + margin / 2)
        low = F.get("_q", F.greatest(F.floor(first * 64).cast("int") - 1, F.lit(0)))
        high = F.get("_q", F.least(F.ceil(last * 64).cast("int") + 1, F.lit(64)))
        state = freeze(state.join(sketch, id, "left").select(
            *state.columns, F.when(middle, F.col("_f")[0]).otherwise(low).alias("_a"),
            F.when(middle, F.col("_f")[1]).otherwise(high).alias("_b")))
    few = df.join(known, id).filter(inside & (F.col("_in") <= held)).groupBy(id).agg(
        F.sort_array(F.collect_list(x)).alias("_values"))

    def at(rank: str) -> Column:
        place = (F.col(rank) - F.col("_at_low")).cast("int")
        return F.when(F.col(rank) < F.col("_at_low"), F.col("_low")).when(
            place < F.col("_in"), F.get("_values", place)).otherwise(F.col("_high"))

    return state.join(few, id, "left").select(id, ((at("_k") + at("_l")) / 2).alias(name))


def find_hot(df: DataFrame, id: str, hot_rows: int) -> tuple[DataFrame | None, int]:
    """Ids with more than ``hot_rows`` samples, and their number."""
    counts = df.groupBy(id).agg(F.count(F.lit(1)).alias(N))
    hot = freeze(counts.filter(F.col(N) > hot_rows).select(id))
    found = hot.count()
    return (hot if found else None), found


def _numbered(sig: Signals, ordered: WindowSpec) -> Column:
    """0-based row number; samples that share id and order fail the job, as their
    order would be arbitrary."""
    number = F.row_number().over(ordered)
    same = F.lag(F.struct(*sig.order)).over(ordered).eqNullSafe(F.struct(*sig.order))
    message = F.format_string("two samples of wave %s share %s", sig.id, F.lit(", ".join(sig.order)))
    return F.when((number > 1) & same, F.raise_error(message).cast("int")).otherwise(number - 1)


def cold_positions(sig: Signals, df: DataFrame) -> Part:
    """Positions by windows: one exchange and one sort serve all of them."""
    ordered = Window.partitionBy(sig.id).orderBy(*sig.order)
    df = df.withColumns({
        POS: _numbered(sig, ordered).cast("long"),
        DX: F.col(sig.value) - F.lag(sig.value).over(ordered),
        N: F.count(F.lit(1)).over(Window.partitionBy(sig.id)),
    })
    return Part(df, sig, hot=False)


def hot_positions(sig: Signals, df: DataFrame, total: int) -> Part:
    """Positions of hot waves: local numbers per order range plus range offsets.

    The samples are sorted into ranges, numbered there and written once; range numbers
    are read from the written table only, so nothing depends on cutting the same ranges
    again.
    """
    ranges = range_count(df, total)
    ranged = df.repartitionByRange(ranges, sig.id, *sig.order).withColumn(SEG, F.spark_partition_id())
    local = Window.partitionBy(sig.id, SEG).orderBy(*sig.order)
    # each range number is a partition of its own, as even as the ranges
    numbered = freeze(ranged.repartitionById(ranges, SEG).withColumns({
        "_local": _numbered(sig, local),
        "_prev": F.lag(sig.value).over(local),
    }))
    in_wave = Window.partitionBy(sig.id).orderBy(SEG)
    # One row per (wave, range): at most ranges + number of hot waves.
    offsets = freeze(
        numbered.groupBy(sig.id, SEG)
        .agg(F.count(F.lit(1)).alias("_rows"), F.max_by(sig.value, "_local").alias("_last"))
        .select(
            sig.id, SEG,
            F.coalesce(
                F.sum("_rows").over(in_wave.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_start"),
            F.sum("_rows").over(Window.partitionBy(sig.id)).alias(N),
            F.lag("_last").over(in_wave).alias("_before"),
        )
    )
    placed = (
        numbered.join(bounded_broadcast(offsets, ranges + sig.hot_count), [sig.id, SEG])
        .withColumns({
            POS: F.col("_start") + F.col("_local"),
            DX: F.col(sig.value) - F.coalesce("_prev", "_before"),
        })
        .drop("_local", "_prev", "_start", "_before", SEG)
    )
    return Part(placed, sig, hot=True)
