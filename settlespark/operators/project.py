"""Roles, column selection and row filters of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names a column role may have.
ALIASES = {
    "wave_id": ("wave_id", "id", "wave"),
    "time": ("time_ms", "time", "t", "ms", "timestamp"),
    "value": ("value", "current", "v", "signal", "volt", "amp"),
}
# Measurement settings and keys that are never features.
META = ("force_mA", "range_V", "temp_C", "wave_id")


def normalize_roles(df: DataFrame, mode: str = "alias") -> DataFrame:
    """Rename the id, time and value columns to ``wave_id``, ``time`` and ``value``.

    ``alias`` takes for each role the first column whose lowercase name is a
    known alias; ``preferred`` takes ``value`` before ``current`` and
    ``time_ms`` before ``time``, by exact name.  A column that has the name of a
    role but was not chosen for it is kept as ``<name>_other``.
    """
    if mode == "alias":
        role_of = {name: role for role, names in ALIASES.items() for name in names}
        found: dict[str, str | None] = dict.fromkeys(ALIASES)
        # from the last column to the first, so that the first one stays
        found |= {role_of[c.lower()]: c for c in reversed(df.columns) if c.lower() in role_of}
    elif mode == "preferred":
        found = {
            "wave_id": "wave_id",
            "time": "time_ms" if "time_ms" in df.columns else "time",
            "value": "value" if "value" in df.columns else "current",
        }
    else:
        raise ValueError(f"mode must be 'alias' or 'preferred', not {mode!r}")
    absent = [role for role, column in found.items() if column not in df.columns]
    if absent:
        raise KeyError(f"no column for {absent}; columns are {df.columns}")
    names = {column: role for role, column in found.items()}
    for role, column in found.items():
        if role != column and role in df.columns and role not in names:
            other = f"{role}_other"
            while other in df.columns:
                other += "_"
            names[role] = other
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def drop_meta(df: DataFrame, meta: Sequence[str] = META, keep: Sequence[str] = ()) -> DataFrame:
    """Drop meta columns where present, except those to ``keep``."""
    return df.drop(*[c for c in meta if c not in keep])


def drop_unlabelled(df: DataFrame, label: str = "wait_time_ms") -> DataFrame:
    """Remove rows whose label is null or NaN."""
    return df.filter(F.col(label).isNotNull() & ~F.isnan(label))


def front_columns(df: DataFrame, *first: str) -> DataFrame:
    """Move columns to the front, the rest in order."""
    return df.select(*first, *[c for c in df.columns if c not in first])


def feature_columns(
    df: DataFrame, label: str = "wait_time_ms", meta: Sequence[str] = META,
    id: str = "wave_id",
) -> list[str]:
    """Columns a model may use: all but the label, the id and meta columns."""
    return [c for c in df.columns if c not in {label, id, *meta}]
