"""Joins of samples with per-wave results, and of two sets of waves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlespark.plans.skew import number_rows
from settlespark.signals import Signals

# Rows that one task may put in order.
ONE_TASK_ROWS = 100_000


def lookup_table(result: DataFrame, value: str, order: str, id: str = "wave_id") -> DataFrame:
    """One value per wave from a result table: the last row of a wave wins."""
    return result.groupBy(id).agg(F.max_by(value, order).alias(value))


def lookup_result(sig: Signals, result: DataFrame, value: str, order: str) -> DataFrame:
    """Samples with the result of their wave; waves without one keep a null."""
    table = lookup_table(result, value, order, sig.id)
    return sig.with_own(sig.keeping_own().join_waves(table))


def after_settle(sig: Signals, result: DataFrame, value: str, order: str) -> DataFrame:
    """Samples at or after the result time of their wave."""
    table = lookup_table(result, value, order, sig.id)
    late = F.col(sig.time) >= F.col(value)
    return sig.with_own(sig.keeping_own().join_waves(table, "inner", late))


def distinct_ids(df: DataFrame, id: str = "wave_id") -> DataFrame:
    """The distinct wave ids in order."""
    return df.select(id).distinct().orderBy(id)


def smallest(df: DataFrame, keys: list[str | Column], k: int) -> DataFrame:
    """The ``k`` smallest rows in the order of ``keys``.

    Up to ``ONE_TASK_ROWS`` rows the best of each partition meet in one task; beyond, rows
    are numbered by a distributed sort and cut at the number.  Keys must tell all rows
    apart for the same rows in every run.
    """
    if k <= ONE_TASK_ROWS:
        return df.orderBy(*keys).limit(k)
    return number_rows(df, keys, "_rank").filter(F.col("_rank") < k).drop("_rank")


def first_ids(df: DataFrame, limit: int, id: str = "wave_id") -> DataFrame:
    """The ``limit`` smallest wave ids."""
    return smallest(df.select(id).distinct(), [id], limit)


def pair_by_rank(
    a: DataFrame, b: DataFrame, limit: int = 100, id_a: str = "wave_id", id_b: str = "wave_id"
) -> DataFrame:
    """The k-th smallest id of ``a`` beside the k-th smallest of ``b``, k < limit."""
    def ranked(df: DataFrame, id: str, name: str) -> DataFrame:
        numbered = number_rows(df.select(id).distinct(), [id], "rank").filter(F.col("rank") < limit)
        return numbered.select("rank", F.col(id).alias(name))
    return ranked(a, id_a, "id_a").join(ranked(b, id_b, "id_b"), "rank")


def disjoint_ids(ids: DataFrame, chosen: DataFrame, id: str = "wave_id") -> DataFrame:
    """Distinct ids that are not among the chosen ones."""
    return ids.select(id).distinct().join(chosen.select(id), id, "left_anti")
