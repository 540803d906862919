"""Tables for reviewing waves with their settle lines, page by page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlespark.operators.joins import lookup_table, pair_by_rank
from settlespark.plans.skew import bounded_broadcast, number_rows
from settlespark.signals import Signals

MODES = {"check_train": "wait_time_ms", "check_pred": "pred_wait_time_ms"}
PER_PAGE = 20


def id_rank(df: DataFrame, id: str = "wave_id") -> DataFrame:
    """The 0-based rank of each distinct wave id."""
    return number_rows(df.select(id).distinct(), [id], "rank")


def paginate(df: DataFrame, per_page: int = PER_PAGE, id: str = "wave_id") -> DataFrame:
    """The 0-based page of each distinct wave id, ``per_page`` ids in id order."""
    return id_rank(df, id).withColumn("page", F.expr(f"rank div {per_page}"))


def page_count(df: DataFrame, per_page: int = PER_PAGE, id: str = "wave_id") -> DataFrame:
    """Number of distinct ids and of pages they fill."""
    return df.agg(F.count_distinct(id).alias("n_ids")).withColumn(
        "n_pages", F.expr(f"(n_ids + {per_page - 1}) div {per_page}")
    )


def post_settle_stats(sig: Signals, lines: DataFrame, line: str) -> DataFrame:
    """Per wave the extremes and their difference at or after its line.

    ``lines`` has one row per wave; waves without a line, or without samples
    after it, have nulls.
    """
    value = F.col(sig.value)
    after = F.when((F.col(sig.time) >= F.col(line)) & ~F.isnan(value), value)
    return (
        sig.join_waves(lines.select(sig.id, line))
        .groupBy(sig.id)
        .agg(F.max(line).alias(line), F.max(after).alias("y_max"), F.min(after).alias("y_min"))
        .withColumn("delta", F.col("y_max") - F.col("y_min"))
    )


def _line(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {sorted(MODES)}, not {mode!r}")
    return MODES[mode]


def review_table(
    sig: Signals, result: DataFrame, mode: str, order: str, per_page: int = PER_PAGE
) -> DataFrame:
    """Per wave: page, line position, spread after the line and their texts."""
    line = _line(mode)
    stats = post_settle_stats(sig, lookup_table(result, line, order, sig.id), line)
    # The texts as they are drawn.
    title = F.format_string("ID:%s | Δ:%.3f", F.col(sig.id).cast("string"), "delta")
    text = F.format_string("%.2fms", line)
    return number_rows(stats, [sig.id], "rank").select(
        sig.id, "rank", F.expr(f"rank div {per_page}").alias("page"),
        F.col(line).alias("line_ms"), "y_max", "y_min", "delta",
        F.when(F.col("delta").isNotNull(), title).alias("title"),
        F.when(F.col(line).isNotNull(), text).alias("line_text"),
    )


def overlay(
    sig: Signals, result: DataFrame, mode: str, order: str, per_page: int = PER_PAGE
) -> DataFrame:
    """Samples with the page and the line of their wave, in drawing order by ranges.

    Ranges of (page, wave, time) go to one task each and are sorted there; partition
    after partition gives the whole order, which is all a page needs; a wave of any size is spread by time.
    """
    lines = lookup_table(result, _line(mode), order, sig.id)
    pages = paginate(sig.samples, per_page, sig.id).join(lines, sig.id, "left")
    drawn = ["page", sig.id, sig.time, *sig.order]
    points = sig.with_own(sig.keeping_own().join_waves(pages, "inner"))
    return (
        points.withColumn("line_ms", F.col(_line(mode))).select("page", "line_ms", *sig.roles)
        .repartitionByRange(*drawn).sortWithinPartitions(*drawn)
    )


def page_files(points: DataFrame, id: str = "wave_id", time: str = "time_ms") -> DataFrame:
    """Per written file of an overlay its first and last (page, wave, time) and its points.

    ``points`` must be read from files.  One row per file, partially aggregated where
    the file is read.
    """
    at = F.struct(F.col("page"), F.col(id).alias("wave"), F.col(time).alias("time"))
    return points.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n_points"))


def compare_pairs(
    train: Signals, test: Signals, limit: int = 100, per_page: int = PER_PAGE
) -> DataFrame:
    """Samples of the first ``limit`` waves of two tables, paired by rank of their ids."""
    pairs = pair_by_rank(train.samples, test.samples, limit, train.id, test.id)

    def side(sig: Signals, column: str, source: str) -> DataFrame:
        chosen = pairs.select(F.col(column).alias(sig.id), "rank")
        return sig.samples.join(bounded_broadcast(chosen, limit), sig.id).select(
            F.expr(f"rank div {per_page}").alias("page"), F.col("rank").alias("pair"),
            F.lit(source).alias("source"), F.col(sig.id).alias("wave_id"),
            # Fixed value: the text as it is drawn.
            F.concat(F.lit(f"{source} ID: "), F.col(sig.id).cast("string")).alias("title"),
            F.col(sig.time).alias("time"), F.col(sig.value).alias("value"),
        )
    return side(train, "id_a", "TRAIN").unionByName(side(test, "id_b", "TEST"))


def actual_and_predicted(
    sig: Signals, pred: DataFrame, order: str, actual: DataFrame | None = None
) -> DataFrame:
    """Per wave the actual and the predicted line and the spread after the prediction.

    Actual times come from ``actual``; only if that has none at all they come
    from the prediction table, when it carries them.
    """
    label, guess = MODES["check_train"], MODES["check_pred"]
    has_actual = actual is not None and label in actual.columns and not actual.isEmpty()
    source = actual if has_actual else (pred if label in pred.columns else None)
    stats = post_settle_stats(sig, lookup_table(pred, guess, order, sig.id), guess)
    if source is None:
        return stats.withColumn(label, F.lit(None).cast("double"))
    return stats.join(lookup_table(source, label, order, sig.id), sig.id, "left")
