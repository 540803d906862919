"""Feature tables: one row per wave."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, FloatType, LongType, StructField, StructType

from settlespark.functions.features import BASE, DERIVED, SETS, UNPLACED, resolve
from settlespark.functions.scalar import is_missing
from settlespark.operators.settle import Names, Rule, wait_time, with_settle
from settlespark.plans.skew import N, POS, ROWS_PER_RANGE, Part, freeze, order_key, range_count
from settlespark.signals import Signals

MIN_CURRENT = 10  # shorter waves have no current features
MIN_CLASSIC = 5   # shorter waves are an error for the classic features


def first_present(df: DataFrame, column: str, at: Column) -> Column:
    """Aggregate: the value of a wave that comes first in the order of ``at``, of those
    that are neither null nor NaN."""
    kind = df.schema[column].dataType
    x = F.col(column)
    absent = is_missing(x) if isinstance(kind, (DoubleType, FloatType)) else x.isNull()
    return F.min_by(column, F.when(~absent, at))


def grouped_features(
    sig: Signals,
    features: str | Sequence[str] = "current",
    label: Rule | None = None,
    meta: Sequence[str] = (),
    min_length: int | None = None,
    on_short: str | None = None,
) -> DataFrame:
    """Features of each wave, with its wait time by ``label`` and its ``meta`` columns.

    Everything is computed from one exchange on the wave id.  Features that need
    no position, and no label, are aggregated before it instead of sorted after
    it.  Waves shorter than ``min_length`` get null features, or fail the job
    with ``on_short="error"``;
    their label is kept.
    """
    names = list(SETS[features]) if isinstance(features, str) else list(features)
    classic = features == "classic"
    min_length = min_length if min_length is not None else (MIN_CLASSIC if classic else MIN_CURRENT)
    on_short = on_short or ("error" if classic else "null")
    if on_short not in ("null", "error"):
        raise ValueError(f"on_short must be 'null' or 'error', not {on_short!r}")
    base, derived = resolve([f for f in names if f != "settle_idx"])
    suffix = "settle_idx" in names

    def aggregates(at: Column) -> dict[str, Column]:
        value = F.col(sig.value)
        return {name: BASE[name](value, at) for name in base} | {
            name: first_present(sig.df, name, at) for name in meta
        }

    def row(p: Part) -> DataFrame:
        rules = ({"": label} if label else {}) | ({"_suffix": Rule("suffix")} if suffix else {})
        if rules:
            p = with_settle(p, rules)
        own = {N: F.first(N)}
        if label:
            own["wait_time_ms"] = wait_time(p)
        if suffix:
            own["settle_idx"] = F.first(Names("_suffix").index).cast("int")
        return p.collapse(**own, **aggregates(F.col(POS)))

    if label or suffix or not UNPLACED.issuperset(base):
        table = sig.per_part(row, *meta)
    else:
        figures = {N: F.count(F.lit(1))} | aggregates(order_key(sig.order))
        table = sig.samples.groupBy(sig.id).agg(*[c.alias(k) for k, c in figures.items()])
    for name in derived:
        needs, expression = DERIVED[name]
        table = table.withColumn(name, expression(*[F.col(c) for c in needs]))
    short = F.col(N) < min_length
    if on_short == "error":
        problem = F.raise_error(F.lit(f"a wave is shorter than the {min_length} samples that its features need"))
        guard = {c: F.when(short, problem).otherwise(F.col(c)) for c in names}
    else:
        guard = {c: F.when(~short, F.col(c)) for c in names}
    table = table.withColumns(guard)
    return table.select(sig.id, *(["wait_time_ms"] if label else []), *names, *meta)


def meta_table(sig: Signals, meta: Sequence[str]) -> DataFrame:
    """Per wave the first non-missing value of each meta column."""
    at = order_key(sig.order)
    return sig.samples.groupBy(sig.id).agg(*[first_present(sig.df, c, at).alias(c) for c in meta])


def apply_per_wave(sig: Signals, fn, schema: str | StructType) -> DataFrame:
    """Run a user function from one wave (pandas) to rows of features.

    The function sees whole waves, so hot waves are refused rather than held by one
    Python worker; :func:`fold_per_wave` takes waves of any size.
    """
    if sig.hot_ids is not None:
        raise ValueError(
            f"{sig.hot_count} waves exceed hot_rows={sig.hot_rows}; use fold_per_wave"
        )
    order = sig.order

    def ordered(wave: pd.DataFrame) -> pd.DataFrame:
        return fn(wave.sort_values(order, kind="stable"))

    return sig.samples.groupBy(sig.id).applyInPandas(ordered, schema)


def fold_per_wave(
    sig: Signals, start: Callable[[], Any], step: Callable[[Any, pd.DataFrame], Any],
    finish: Callable[[Any, Any], dict], schema: str | StructType,
) -> DataFrame:
    """Run user functions along each wave, block by block in the order of its samples.

    ``start()`` gives a state, ``step(state, block)`` the next one for a pandas block of
    samples, ``finish(id, state)`` the row of the wave.  Only a block and the state are
    held, so a wave may have any size.
    """
    id = sig.id

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wave, state, rows = None, None, []
        for block in blocks:
            for key, part in block.groupby(id, sort=False):
                if key != wave:
                    if wave is not None:
                        rows.append(finish(wave, state))
                    wave, state = key, start()
                state = step(state, part)
            if rows:
                yield pd.DataFrame(rows)
                rows = []
        if wave is not None:
            yield pd.DataFrame([finish(wave, state)])

    ordered = sig.samples.repartition(id).sortWithinPartitions(id, *sig.order)
    return ordered.mapInPandas(run, schema)


MERGE_WIDTH = 16


def fold_ranges(
    sig: Signals, start: Callable[[], Any], step: Callable[[Any, pd.DataFrame], Any],
    merge: Callable[[Any, Any], Any], finish: Callable[[Any, Any], dict], schema: str | StructType,
    rows_per_range: int = ROWS_PER_RANGE, merge_width: int = MERGE_WIDTH,
) -> DataFrame:
    """Like :func:`fold_per_wave`, but a wave of any size is folded by many tasks.

    The samples are range-partitioned by (wave, order), at least ``ROWS_PER_RANGE`` a task
    once they fill all tasks.  In a task, each ``rows_per_range`` samples of a wave are
    folded on their own from ``start()`` to a partial state, and ``merge(earlier, later)``
    joins the states of neighbouring ranges: in the task until it has one a wave, then
    those of ``merge_width`` tasks at a time until each wave has one.  ``merge`` must
    give the state that folding the later range after the earlier one gives; states are
    pickled.
    """
    id, order = sig.id, sig.order
    # a range needs no task of its own, so tasks and exchanged blocks stay few
    tasks = range_count(sig.df, sig.samples.count(), max(rows_per_range, ROWS_PER_RANGE))
    partial = StructType([
        StructField("wave", sig.samples.schema[id].dataType), StructField("part", LongType()),
        StructField("state", BinaryType())])

    def fold(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        wave, merged, state, room, states = None, None, None, 0, []
        for block in blocks:
            for key, rows in block.groupby(id, sort=False):
                if merged is None or key != wave:
                    if merged is not None:
                        merged.add(state)
                        states.append((wave, part, pickle.dumps(merged.all())))
                    wave, merged, state, room = key, _Merged(merge), start(), rows_per_range
                at = 0
                while at < len(rows):
                    if not room:
                        merged.add(state)
                        state, room = start(), rows_per_range
                    taken = rows if at == 0 and len(rows) <= room else rows.iloc[at:at + room]
                    state = step(state, taken)
                    at, room = at + len(taken), room - len(taken)
            if states:
                yield pd.DataFrame(states, columns=partial.names)
                states = []
        if merged is not None:
            merged.add(state)
            yield pd.DataFrame([(wave, part, pickle.dumps(merged.all()))], columns=partial.names)

    def ordered(states: DataFrame, width: int | None) -> DataFrame:
        """The states to be merged one after another, in one task."""
        if width:
            states = states.withColumn("_to", F.expr(f"part div {width}"))
        keys = ["wave", "_to"] if width else ["wave"]
        return states.repartition(*keys).sortWithinPartitions(*keys, "part")

    def merged_parts(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in _runs(blocks, ["wave", "_to"], merge):
            yield pd.DataFrame([(wave, to, state) for (wave, to), state in found], columns=partial.names)

    def finished(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in _runs(blocks, ["wave"], merge):
            yield pd.DataFrame([finish(wave, pickle.loads(state)) for (wave,), state in found])

    samples = sig.samples.repartitionByRange(tasks, id, *order).sortWithinPartitions(id, *order)
    # the ranges must not be cut anew when a task is repeated
    states = freeze(samples.mapInPandas(fold, partial))
    while tasks > merge_width:
        states = ordered(states, merge_width).mapInPandas(merged_parts, partial)
        tasks = -(-tasks // merge_width)
    return ordered(states, None).mapInPandas(finished, schema)


class _Merged:
    """States that come in order, merged in pairs of about equal extent, so that few are
    held and none is copied once for every later one."""

    def __init__(self, merge: Callable[[Any, Any], Any]):
        self.merge, self.held = merge, []

    def add(self, state: Any) -> None:
        level = 0
        while self.held and self.held[-1][0] == level:
            state, level = self.merge(self.held.pop()[1], state), level + 1
        self.held.append((level, state))

    def all(self) -> Any:
        _, state = self.held.pop()
        while self.held:
            state = self.merge(self.held.pop()[1], state)
        return state


def _runs(
    blocks: Iterator[pd.DataFrame], keys: list[str], merge: Callable[[Any, Any], Any]
) -> Iterator[list[tuple[tuple, bytes]]]:
    """The merged state of each run of rows with equal ``keys``; a state alone in its run
    stays as it is pickled."""
    key, one, merged, found = None, None, None, []

    def ended() -> tuple[tuple, bytes]:
        return key, one if merged is None else pickle.dumps(merged.all())

    for block in blocks:
        for *at, state in zip(*[block[k] for k in keys], block["state"]):
            at = tuple(at)
            if at == key:
                if merged is None:
                    merged = _Merged(merge)
                    merged.add(pickle.loads(one))
                merged.add(pickle.loads(state))
                continue
            if key is not None:
                found.append(ended())
            key, one, merged = at, state, None
        if found:
            yield found
            found = []
    if key is not None:
        yield [ended()]


def count_waves(sig: Signals) -> DataFrame:
    """Number of waves and of samples."""
    return sig.samples.agg(
        F.count_distinct(sig.id).alias("n_waves"), F.count(F.lit(1)).alias("n_rows")
    )


def signal_quality(sig: Signals, min_len: int = 10) -> DataFrame:
    """Per wave: samples, missing and duplicate samples, and whether it is too short."""
    value = F.col(sig.value).cast("double")
    df = sig.df.filter(F.col(sig.id).isNotNull())
    return df.groupBy(sig.id).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(value.isNull() | F.isnan(value)).alias("n_missing"),
        (F.count(F.lit(1)) - F.count_distinct(*sig.order)).alias("n_duplicate"),
    ).withColumn("too_short", F.col("n") - F.col("n_missing") < min_len)
