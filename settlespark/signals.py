"""The long table of sampled waves and its column roles."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlespark.plans.skew import (
    Part, bounded_broadcast, cold_positions, find_hot, hot_positions,
)

HOT_ROWS = 4_000_000
OWN = "_own_value"


class Signals:
    """A long waveform table: one row per (wave, sample).

    ``order`` names the column or columns giving the sample order of a wave;
    together with the id they must be unique.  ``missing`` is ``"propagate"``
    (a missing value makes the figures it touches NaN) or ``"skip"`` (missing
    samples are removed and positions close up).  Waves with more than
    ``hot_rows`` samples are handled range by range, see ``plans.skew``;
    ``None`` states that every wave fits a task and saves the check.
    """

    def __init__(
        self,
        df: DataFrame,
        id: str = "wave_id",
        order: str | Sequence[str] = "sample",
        time: str = "time_ms",
        value: str = "value",
        missing: str = "propagate",
        hot_rows: int | None = HOT_ROWS,
    ):
        if missing not in ("propagate", "skip"):
            raise ValueError(f"missing must be 'propagate' or 'skip', not {missing!r}")
        self.id, self.time, self.value = id, time, value
        self.order = [order] if isinstance(order, str) else list(order)
        self.missing, self.hot_rows = missing, hot_rows
        absent = [c for c in (id, value, *self.order) if c not in df.columns]
        if absent:
            raise ValueError(f"columns {absent} not found; columns are {df.columns}")
        self.df = df

    def replace(self, df: DataFrame, **changes) -> Signals:
        """The same roles over another table."""
        roles = {k: getattr(self, k) for k in ("id", "order", "time", "value", "missing", "hot_rows")}
        other = Signals(df, **{**roles, **changes})
        if df is self.df and not {"id", "hot_rows"} & changes.keys() and "_hot" in self.__dict__:
            other.__dict__["_hot"] = self._hot  # the same waves need not be counted again
        return other

    @property
    def roles(self) -> list[str]:
        names = [self.id, *self.order, self.time, self.value]
        return [c for c in dict.fromkeys(names) if c in self.df.columns]

    @cached_property
    def samples(self) -> DataFrame:
        """Rows with an id, value as DOUBLE, missing samples NaN or removed."""
        value = F.col(self.value).cast("double")
        df = self.df.filter(F.col(self.id).isNotNull())
        if self.missing == "skip":
            return df.filter(value.isNotNull() & ~F.isnan(value)).withColumn(self.value, value)
        return df.withColumn(self.value, F.coalesce(value, F.lit(float("nan"))))

    @cached_property
    def _hot(self) -> tuple[DataFrame | None, int, int]:
        if self.hot_rows is None:
            return None, 0, 0
        # counting the unfiltered table lets a file source answer from its footers
        total = self.df.count()
        if total <= self.hot_rows:
            return None, 0, total
        return *find_hot(self.samples.select(self.id), self.id, self.hot_rows), total

    @property
    def hot_ids(self) -> DataFrame | None:
        return self._hot[0]

    @property
    def hot_count(self) -> int:
        return self._hot[1]

    def _split(self, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Rows of ordinary and of hot waves."""
        if self.hot_ids is None:
            return df, None
        ids = bounded_broadcast(self.hot_ids, self.hot_count)
        return df.join(ids, self.id, "left_anti"), df.join(ids, self.id, "left_semi")

    def positioned(self, *columns: str) -> list[Part]:
        """Samples with positions, in one part or in an ordinary and a hot one.

        Only the role columns and ``columns`` are carried through the exchange.
        """
        keep = list(dict.fromkeys([*self.roles, *columns]))
        ordinary, hot = self._split(self.samples.select(*keep))
        parts = [cold_positions(self, ordinary)]
        if hot is not None:
            parts.append(hot_positions(self, hot, self._hot[2]))
        return parts

    def per_part(self, fn: Callable[[Part], DataFrame], *columns: str) -> DataFrame:
        """Union of ``fn`` over the parts; waves never span two parts."""
        first, *rest = [fn(p) for p in self.positioned(*columns)]
        for other in rest:
            first = first.unionByName(other)
        return first

    def per_row(self, fn: Callable[[Part], DataFrame]) -> DataFrame:
        """``per_part`` for operators that return the samples: all columns, values as they came."""
        return self.with_own(self.keeping_own().per_part(fn, *self.df.columns, OWN))

    def keeping_own(self) -> Signals:
        """The same samples with their values once more, as they came."""
        same = self.replace(self.df.withColumn(OWN, F.col(self.value)))
        # the same waves, so they are not counted again
        same.__dict__["_hot"] = self._hot
        return same

    def with_own(self, df: DataFrame) -> DataFrame:
        """The values as they came, null included, instead of those computed with."""
        return df.withColumn(self.value, F.col(OWN)).drop(OWN)

    def join_waves(
        self, per_wave: DataFrame, how: str = "left", condition: Column | None = None
    ) -> DataFrame:
        """Join a table with one row per wave to the samples.

        Ordinary waves meet in a join on the id whose strategy is left to the
        optimizer; the rows of hot waves are few and go to their samples.
        """
        ordinary, hot = self._split(self.samples)
        joined = ordinary.join(per_wave, self.id, how)
        if hot is not None:
            ids = bounded_broadcast(self.hot_ids, self.hot_count)
            few = per_wave.join(ids, self.id, "left_semi")
            joined = joined.unionByName(hot.join(bounded_broadcast(few, self.hot_count), self.id, how))
        return joined if condition is None else joined.filter(condition)

    # The operators most used, as methods; all of them are functions of a Signals.

    def features(self, features: str | Sequence[str] = "current", **options) -> DataFrame:
        from settlespark.operators.features import grouped_features
        return grouped_features(self, features, **options)

    def settle(self, rule: str = "hold", **options) -> DataFrame:
        from settlespark.operators.settle import Rule, settle
        return settle(self, Rule(rule, **options))

    def labels(self, rule: str = "hold", **options) -> DataFrame:
        from settlespark.operators.settle import Rule, labels
        return labels(self, Rule(rule, **options))

    def wide(self, samples: Sequence[int] | None = None, **options) -> DataFrame:
        from settlespark.operators.reshape import to_wide
        return to_wide(self, samples, **options)

    def array(self, **options) -> DataFrame:
        from settlespark.operators.reshape import to_array
        return to_array(self, **options)

    def review(self, result: DataFrame, mode: str, order: str, **options) -> DataFrame:
        from settlespark.operators.review import review_table
        return review_table(self, result, mode, order, **options)
