"""Exact deduplication by Grace hashing.

Records are partitioned by their digest until each bucket fits an open-addressing
table that compares complete contents.  Copies inside one batch are folded before
the first exchange, so a text that makes up a third of the table reaches its
bucket once per batch.  A bucket whose table is full passes the records of
unknown content on; they are written as the spill of that level and partitioned
again by another hash, until nothing is passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import count

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from settlespark.llm.batches import (
    int_bounded, map_batches, others, partition_id, restore, shuffles, slices, text_or_empty,
)
from settlespark.plans.skew import freeze

TABLE_BYTES = 32 << 20
BATCH_BYTES = 8 << 20


class ContentTable:
    """Open addressing with linear probing.

    The digest chooses the slot; contents of equal length and digest are then
    compared in full, so two contents share an entry only if they are the same.
    """

    def __init__(self):
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.contents)

    def find(self, hash_: int, content: bytes) -> tuple[int, int]:
        """The entry of the content, or -1, and the slot where the search ended."""
        mask = len(self.slots) - 1
        slot = hash_ & mask
        while (entry := self.slots[slot]) >= 0:
            if self.hashes[entry] == hash_ and self.contents[entry] == content:
                return entry, slot
            slot = (slot + 1) & mask
        return -1, slot

    def add(self, hash_: int, content: bytes, slot: int) -> int:
        entry = len(self.contents)
        self.slots[slot] = entry
        self.hashes.append(hash_)
        self.contents.append(content)
        self.bytes += len(content) + 64
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, hash_ in enumerate(self.hashes):
            slot = hash_ & mask
            while self.slots[slot] >= 0:
                slot = (slot + 1) & mask
            self.slots[slot] = entry


def _larger(a, b) -> bool:
    """Whether id ``a`` comes after ``b``; a null id before all others."""
    return a is not None and (b is None or a > b)


def _fold(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Mark one head (the largest id) per distinct content of each slice, and give
    the rows of one content the same key."""
    following = partition_id() << 40
    for batch in batches:
        lengths = pc.binary_length(batch["content"]).to_pylist()
        for part in slices(batch, lengths, BATCH_BYTES):
            table, entries, heads, sizes, digests = ContentTable(), [], [], [], []
            ids = part["id"].to_pylist()
            contents = part["content"].to_pylist()
            for row, content in enumerate(contents):
                digest = sha256(content)
                hash_ = int.from_bytes(digest.digest()[:8], "little")
                entry, slot = table.find(hash_, content)
                if entry < 0:
                    entry = table.add(hash_, content, slot)
                    heads.append(row)
                    sizes.append(0)
                    digests.append(digest.hexdigest())
                elif _larger(ids[row], ids[heads[entry]]):
                    heads[entry] = row
                sizes[entry] += 1
                entries.append(entry)
            head = [heads[e] == row for row, e in enumerate(entries)]
            columns = {
                "key": [following + e for e in entries], "head": head,
                "n": [sizes[e] if h else None for e, h in zip(entries, head)],
                "digest": [digests[e] for e in entries],
                "content": [c if h else None for c, h in zip(contents, head)],
                "bytes": [len(c) if h else None for c, h in zip(contents, head)],
            }
            following += len(table)
            yield pa.RecordBatch.from_arrays([
                part[f.name] if f.name in ("id", "rest", "absent") else pa.array(columns[f.name], f.type)
                for f in schema
            ], schema=schema)


def _settle(
    batches: Iterator[pa.RecordBatch], schema: pa.Schema, table_bytes: int, keep_rows: bool
) -> Iterator[pa.RecordBatch]:
    """Classes of one bucket; records beyond the table's bytes leave as they came.

    Returns a row per record with its class, or with ``keep_rows`` one whole row per
    class: the record that stays.
    """
    table = ContentTable()
    best, sizes, keys, entries = [], [], [], []
    carried = [f.name for f in schema if f.name in ("absent", "rest")]
    for batch in batches:
        passed = []
        columns = [batch[c].to_pylist() for c in ("key", "id", "n", "digest", "content")]
        for row, (key, id_, n, digest, content) in enumerate(zip(*columns)):
            hash_ = int(digest[:16], 16)
            entry, slot = table.find(hash_, content)
            new = entry < 0
            if new:
                if len(table) and table.bytes + len(content) > table_bytes:
                    passed.append(row)
                    continue
                entry = table.add(hash_, content, slot)
                best.append(None)
                sizes.append(0)
            if new or _larger(id_, best[entry]["keep_id"]):
                best[entry] = {"keep_key": key, "keep_id": id_, "key": key, "id": id_, "digest": digest}
                if keep_rows:
                    best[entry] |= {c: batch[c][row].as_py() for c in carried}
            sizes[entry] += n
            if not keep_rows:
                keys.append(key)
                entries.append(entry)
        if passed:
            kept = batch.take(pa.array(passed))
            yield pa.RecordBatch.from_arrays([
                kept[f.name] if f.name in kept.schema.names else pa.nulls(len(passed), f.type) for f in schema
            ], schema=schema)
    if keep_rows:
        start, held = 0, 0
        for entry in range(len(table) + 1):
            if entry == len(table) or held > BATCH_BYTES:
                yield _filled(schema, entry - start, best[start:entry], content=table.contents[start:entry])
                start, held = entry, 0
            held += len(table.contents[entry]) if entry < len(table) else 0
        return
    for start in range(0, len(keys), 10_000):
        found = entries[start:start + 10_000]
        classes = [{"keep_key": best[e]["keep_key"], "keep_id": best[e]["keep_id"], "group_size": sizes[e]}
                   for e in found]
        yield _filled(schema, len(found), classes, key=keys[start:start + 10_000])


def _filled(schema: pa.Schema, rows: int, values: list[dict], **columns: list) -> pa.RecordBatch:
    """A batch from some columns and row values, null where there is neither."""
    known = values[0].keys() if values else ()
    return pa.RecordBatch.from_arrays([
        pa.array(columns[f.name], f.type) if f.name in columns
        else pa.array([v[f.name] for v in values], f.type) if f.name in known
        else pa.nulls(rows, f.type) for f in schema
    ], schema=schema)


def _held(df: DataFrame, id: str, text: str, carry: bool) -> DataFrame:
    return df.select(
        F.col(f"`{id}`").alias("id"), text_or_empty(text).cast("binary").alias("content"),
        F.col(f"`{text}`").isNull().alias("absent"),
        *([others(df, id, text).alias("rest")] if carry else []),
    )


def _folded(held: DataFrame) -> DataFrame:
    return map_batches(held, _fold, T.StructType([
        *[f for f in held.schema.fields if f.name != "content"],
        T.StructField("key", T.LongType()), T.StructField("head", T.BooleanType()),
        T.StructField("n", T.LongType()), T.StructField("digest", T.StringType()),
        T.StructField("bytes", T.LongType()), T.StructField("content", T.BinaryType()),
    ]))


def _levels(records: DataFrame, left: int | None, table_bytes: int, keep_rows: bool) -> DataFrame:
    """Partition, settle, and partition again what was passed on, until nothing is left."""
    out = T.StructType([
        *records.schema.fields, T.StructField("keep_key", T.LongType()),
        T.StructField("keep_id", records.schema["id"].dataType), T.StructField("group_size", T.LongType()),
    ])
    columns, found = records.columns, None
    for level in count():
        # half a table on average, so that few buckets pass records on
        buckets = int_bounded(left or 0, table_bytes // 2, shuffles(records) if level == 0 else 1)
        dealt = records.repartition(buckets, F.xxhash64(F.lit(level), "digest"))
        spilled = freeze(map_batches(dealt, _settle, out, table_bytes, keep_rows))
        settled = spilled.filter("keep_key is not null")
        found = settled if found is None else found.unionByName(settled)
        records = spilled.filter("keep_key is null").select(*columns)
        left = records.agg(F.sum("bytes")).first()[0]
        if left is None:
            return found


def exact_groups(
    df: DataFrame, id: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES
) -> DataFrame:
    """One row per row of ``df``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when their bytes are; a null text counts as empty.  Of equal
    texts the row with the largest id stays, a null id counting as the smallest;
    of several rows with that id exactly one stays.  Other columns are ignored.
    An empty table gives an empty result.  ``table_bytes`` bounds the contents
    that a task holds (a single longer content is held alone).
    """
    folded = freeze(_folded(_held(df, id, text, carry=False)))
    records = folded.filter("head").select("key", "id", "n", "digest", "bytes", "content")
    left = records.agg(F.sum("bytes")).first()[0]
    found = _levels(records, left, table_bytes, keep_rows=False)
    return folded.select("key", "id", "head", "digest").join(
        found.select("key", "keep_key", "keep_id", "group_size"), "key"
    ).select(
        F.col("id").alias(id), F.col("keep_id"), F.col("group_size"),
        (F.col("head") & (F.col("key") == F.col("keep_key"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(
    df: DataFrame, id: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES
) -> DataFrame:
    """The rows of ``df`` that :func:`exact_groups` keeps, with all their columns."""
    held = _held(df, id, text, carry=True)
    left = held.agg(F.sum(F.octet_length("content"))).first()[0]
    kept = _levels(_folded(held).filter("head").drop("head"), left, table_bytes, keep_rows=True)
    content = F.when(~F.col("absent"), F.col("content").cast("string"))
    return restore(kept, df.columns, **{
        id: F.col("id"), text: content.cast(df.schema[text].dataType)})
