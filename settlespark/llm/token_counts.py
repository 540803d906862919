"""Token counts of fields and sections, from one encoding of the whole document.

The fields of a row are joined to one document, which is encoded once with
character offsets.  Sections are sorted intervals that cover the document; the
token spans meet them by binary search.  A token that crosses a border is
allocated by an explicit rule.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from settlespark.llm.batches import map_batches, text_or_empty
from settlespark.llm.encoding import encoder

RULES = ("start", "end", "most")


def section_starts(fields: list[str], separator: str, border: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined document, the start of each section, and the field of each section.

    A separator belongs to the field before it, a ``border`` string to the section
    before it; every field has at least one section.
    """
    starts, owner, at = [], [], 0
    for number, text in enumerate(fields):
        starts.append(at)
        owner.append(number)
        found = text.find(border) if border else -1
        while found >= 0 and found + len(border) < len(text):
            starts.append(at + found + len(border))
            owner.append(number)
            found = text.find(border, found + len(border))
        at += len(text) + len(separator)
    return separator.join(fields), np.array(starts, np.int64), np.array(owner, np.int64)


def allocate(offsets: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether the token crosses a border.

    ``start``: the section that holds the first character; ``end``: the last one;
    ``most``: the section with most of its characters, the earlier one of equals.
    """
    first = np.searchsorted(starts, offsets[:, 0], side="right") - 1
    last = np.searchsorted(starts, np.maximum(offsets[:, 1] - 1, offsets[:, 0]), side="right") - 1
    crossing = first != last
    if rule == "start" or not crossing.any():
        return first, crossing
    if rule == "end":
        return last, crossing
    section = first.copy()
    for token in np.flatnonzero(crossing):
        edges = np.concatenate(([offsets[token, 0]], starts[first[token] + 1:last[token] + 1], [offsets[token, 1]]))
        section[token] = first[token] + int(np.argmax(np.diff(edges)))
    return section, crossing


def _count(batches, schema: pa.Schema, fields: int, tokenizer: str, separator: str, border: str, rule: str):
    encode = encoder(tokenizer, spaced=True).encode_offsets
    for batch in batches:
        texts = [batch[f"f{i}"] for i in range(fields)]
        rows = []
        for row in range(batch.num_rows):
            text, starts, owner = section_starts([t[row].as_py() for t in texts], separator, border)
            ids, offsets = encode(text)
            section, crossing = allocate(offsets, starts, rule)
            per_section = np.bincount(section, minlength=len(starts))
            per_field = np.bincount(owner, weights=per_section, minlength=fields).astype(np.int64)
            rows.append((len(ids), int(crossing.sum()), per_field, per_section))
        yield pa.RecordBatch.from_arrays(
            [batch["id"], *[pa.array([r[i] for r in rows], schema.field(i + 1).type) for i in range(4)]],
            schema=schema)


def token_counts(
    df: DataFrame, tokenizer: str, fields: Sequence[str], id: str = "doc_id", separator: str = "\n",
    border: str = "\n", rule: str = "start",
) -> DataFrame:
    """One row per row of ``df``: id, ``n_tokens``, ``n_crossing``, ``field_tokens`` (in
    the order of ``fields``) and ``section_tokens``.

    The tokenizer is byte-level, so every character belongs to a token; both
    lists sum to ``n_tokens``.  Sections are the parts of a field after each
    ``border``.  A null field counts as empty and keeps its (empty) section; other
    columns are ignored; an empty table gives no row.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule!r}")
    held = df.select(
        F.col(f"`{id}`").alias("id"), *[text_or_empty(c).alias(f"f{i}") for i, c in enumerate(fields)])
    return map_batches(held, _count, T.StructType([
        T.StructField(id, df.schema[id].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_crossing", T.LongType()),
        T.StructField("field_tokens", T.ArrayType(T.LongType())),
        T.StructField("section_tokens", T.ArrayType(T.LongType())),
    ]), len(fields), tokenizer, separator, border, rule)
