"""The driver tables read as waveform tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from settlespark.signals import Signals
from settlespark.sources.io import read_signals

PRICE_ORDER = ["time_ms", "order_key", "line_no", "part_key", "price"]
EVENT_ORDER = ["time_ms", "event_id"]
LEVEL_PRICE, LEVEL_EVENT = 50.0, 100.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_signals(spark, f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-length waves: one per vector, a sample per dimension."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.col("vec_id").alias("wave_id"), "label", F.posexplode("embedding").alias("sample", "value")
    ).select(
        "wave_id", F.col("sample").cast("long").alias("sample"),
        (F.col("sample") * F.lit(0.01)).alias("time_ms"),
        F.col("value").cast("double").alias("value"), "label",
    )


def _decay(time: Column, scale: float) -> Column:
    share = F.lit(scale) / (F.lit(scale) + time)
    return share * share


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settling waves: the prices of a supplier swing around a level and fade with time."""
    day = F.datediff("l_shipdate", F.lit("1995-01-01")).cast("double")
    side = F.when(F.col("l_linenumber") % 2 == 0, 1.0).otherwise(-1.0)
    swing = side * (F.col("l_extendedprice") / F.lit(1000.0))
    rows = table(spark, sf_dir, "lineitem").withColumn("time_ms", day)
    return rows.select(
        F.col("l_suppkey").alias("wave_id"), "time_ms",
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_key"), F.col("l_extendedprice").alias("price"),
        (F.lit(LEVEL_PRICE) + swing * _decay(F.col("time_ms"), 100.3)).alias("value"),
        F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"),
    )


def price_signals(spark: SparkSession, sf_dir: str, **options) -> Signals:
    return Signals(prices(spark, sf_dir), order=PRICE_ORDER, **options)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged waves with irregular times: the events of a user, fading to a level."""
    rows = table(spark, sf_dir, "events")
    time = F.expr("timestampdiff(MICROSECOND, TIMESTAMP '2024-01-01 00:00:00', ts) / 1000D")
    rows = rows.withColumn("time_ms", time)
    swing = (F.col("value") - F.lit(50.0)) * _decay(F.col("time_ms"), 86_400_000.0)
    return rows.select(
        F.col("user_id").alias("wave_id"), "time_ms", "event_id",
        (F.lit(LEVEL_EVENT) + swing).alias("value"), F.col("event_type").alias("kind"),
        F.col("value").alias("amount"),
    )


def event_signals(spark: SparkSession, sf_dir: str, **options) -> Signals:
    return Signals(events(spark, sf_dir), order=EVENT_ORDER, **options)


def supplier_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression table: mean price and mean quantity per supplier."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("wave_id")).agg(
        (F.avg("l_extendedprice") / F.lit(1000.0)).alias("wait_time_ms"),
        F.avg("l_quantity").alias("x"),
    )
