"""Named queries over the driver tables and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, ShortType

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL for the same result if there is one."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (without negative zero) and integers widened, for comparison."""
    def plain(field) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DoubleType):
            return (F.round(column, digits) + F.lit(0.0)).alias(field.name)
        if isinstance(field.dataType, (IntegerType, ShortType)):
            return column.cast("long").alias(field.name)
        return column
    return df.select(*[plain(f) for f in df.schema.fields])
