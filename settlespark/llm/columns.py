"""Column helpers of the operators that use DataFrame functions only."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of a broadcast table; each takes some tens of bytes.
MAX_BROADCAST_ROWS = 200_000


def row_key(id: Column, text: Column) -> Column:
    """16 bytes for a row's id and text; rows that share both share the key."""
    known = F.concat(F.lit("="), id.cast("string"), F.lit("\n"))
    return F.unhex(F.md5(F.concat(F.coalesce(known, F.lit("-\n")), text)))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, ascii_uppercase, ascii_lowercase))


def words(text: Column, gap: str) -> Column:
    """The parts between the matches of ``gap``, without empty ones."""
    return F.array_remove(F.split(text, gap), "")


def small(df: DataFrame, rows: int, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast a table of ``rows`` rows if they are few, else leave the join to Spark."""
    return F.broadcast(df) if rows <= limit else df
