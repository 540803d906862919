"""Removal of repeated passages by merged Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes that covers it starts somewhere else too.
Strings are brought together without sorting the corpus:

1. Every window of ``LENGTH`` bytes is dealt to one anchor, the gram of ``GRAM`` bytes in
   it with the smallest hash.  Equal windows have equal anchors in the same place, so
   windows need to be compared only where their anchors agree.  Neighbouring windows of
   one anchor form a context, the bytes that they cover.
2. Equal contexts are folded into one with its number.  A context whose gram occurs
   nowhere else is settled, and so is one that occurs twice as a whole.
3. The others are dealt to tasks by their gram.  A task cuts them into shards, transforms
   each, and merges the transforms by refining their interleave (``bwt``); the intervals
   of suffixes with a common prefix of ``LENGTH`` bytes are the repeated windows.
4. A gram with too many contexts for a task is split by the place of the anchor in the
   window: half of the windows share more bytes before, half more bytes after the gram,
   and those bytes are the new gram.  With one place left the gram is the whole window.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from settlespark.llm.batches import map_batches, partition_id, slices, text_or_empty
from settlespark.llm.bwt import Strings, gram_hashes, merged_order
from settlespark.llm.columns import MAX_BROADCAST_ROWS, small
from settlespark.plans.skew import freeze

# The length of the contract.
LENGTH = 200
GRAM = 64
# Symbols of a window in the transforms, which is also the number of refinements.
SYMBOLS = 4
SEGMENT = 1 << 20
# Contexts of a gram, from which it is split, and occurrences, from which it is hot.
CROWDED = 2_000
HOT = 20_000
# Rows with one text, from which they are not dealt by their content.
COPIES = 1_000
BUCKET_BYTES = 1 << 20
SHARD_BYTES = 60_000


def _windowed(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, end: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, windows, place, hash) of the contexts in concatenated texts.

    ``end`` is where the text of each byte ends.  ``windows`` windows from byte ``start``
    on share the anchor ``place`` bytes after ``start``, whose gram has the hash.
    """
    for at in range(0, max(len(data) - length + 1, 0), SEGMENT):
        part = data[at:at + SEGMENT + length - 1]
        hashes = gram_hashes(part, gram)
        # the smallest hash, of equal ones the first
        bits = np.uint64(len(hashes).bit_length())
        place = np.arange(len(hashes), dtype=np.uint64)
        least = _windowed(hashes >> bits << bits | place, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))
        least = least.astype(np.int64)
        start = np.arange(len(least))
        inside = start + at + length <= end[at:at + len(least)]
        new = inside.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new)
        if not len(first):
            continue
        # windows of an anchor follow one another
        run = np.cumsum(new)[inside] - 1
        yield first + at, np.bincount(run, minlength=len(first)), least[first] - first, hashes[least[first]]


CONTEXTS = T.StructType([
    T.StructField("digest", T.BinaryType()), T.StructField("doc", T.LongType()), T.StructField("gram", T.LongType()),
    T.StructField("context", T.BinaryType()), T.StructField("start", T.LongType()),
    T.StructField("windows", T.IntegerType()), T.StructField("place", T.IntegerType())])


def _contexts(batches, schema: pa.Schema, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """One row per context; the first of a text also has the digest of the text."""
    number = partition_id() << 33
    for batch in batches:
        for part in slices(batch, pc.binary_length(batch["text"]).to_pylist(), SEGMENT):
            texts = part["text"].to_pylist()
            whole = b"".join(texts)
            sizes = np.array([len(t) for t in texts], np.int64)
            ends = np.cumsum(sizes)
            data = np.frombuffer(whole, np.uint8)
            view, last = memoryview(whole), -1
            for start, windows, place, hashes in anchors(data, np.repeat(ends, sizes), length, gram):
                text = np.searchsorted(ends, start, side="right")
                new = np.concatenate(([text[0] != last], text[1:] != text[:-1]))
                last = text[-1]
                context = [
                    xxhash.xxh3_128_digest(view[a:a + n + length - 1], seed=p)
                    for a, n, p in zip(start.tolist(), windows.tolist(), place.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pc.if_else(pa.array(new), part["digest"].take(pa.array(text)), None), pa.array(text + number), pa.array(hashes.view(np.int64)),
                    pa.array(context, pa.binary()), pa.array(start - (ends - sizes)[text]),
                    pa.array(windows, pa.int32()), pa.array(place, pa.int32())], schema=schema)
            number += len(texts)


BODIES = T.StructType([
    T.StructField("gram", T.LongType()), T.StructField("context", T.BinaryType()), T.StructField("times", T.LongType()),
    T.StructField("place", T.IntegerType()), T.StructField("windows", T.IntegerType()),
    T.StructField("body", T.BinaryType())])


def _bodies(batches, schema: pa.Schema, length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts wanted from each text."""
    for batch in batches:
        for text, wanted in zip(batch["text"], batch["wanted"]):
            text = memoryview(text.as_buffer())
            for at in range(0, len(wanted), 4096):
                rows = wanted.as_py()[at:at + 4096] if len(wanted) > 4096 else wanted.as_py()
                body = [bytes(text[w["start"]:w["start"] + w["windows"] + length - 1]) for w in rows]
                yield pa.RecordBatch.from_arrays([
                    pa.array(body, f.type) if f.name == "body" else pa.array([w[f.name] for w in rows], f.type)
                    for f in schema], schema=schema)


def repeated_windows(
    body: list[bytes], place: np.ndarray, times: np.ndarray, length: int, symbols: int,
    shard_bytes: int = SHARD_BYTES,
) -> list[np.ndarray]:
    """For each context the numbers of the windows that occur again.

    ``place`` is where the anchor of each begins, ``times`` how often it occurs.  Two
    windows count as one occurrence only if they lie in one context, so windows are
    compared at the same distance from their anchors.
    """
    sizes = np.array([len(b) for b in body])
    strings = Strings(np.frombuffer(b"".join(body), np.uint8), sizes, length // symbols)
    merged = merged_order(strings, symbols, shard_bytes)
    whole = strings.left[merged.slots] >= length
    alone = np.ones(len(whole), bool)
    alone[1:] = merged.common[1:] < symbols
    alone[:-1] &= alone[1:]
    kept = np.flatnonzero(whole & ~alone)
    slots, interval = merged.slots[kept], merged.interval[kept].astype(np.int64)
    string, offset = strings.string[slots], strings.offset[slots]
    # places before the anchor; every window of a context holds it
    key = interval * length + (place[string] - offset)
    order = np.argsort(key, kind="stable")
    key, string, offset = key[order], string[order], offset[order]
    group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))) if len(key) else key
    again = np.bincount(group, weights=times[string])[group] >= 2 if len(key) else key.astype(bool)
    # whole contexts that occur again need no partner
    found: list[list[int]] = [[] for _ in body]
    for s, o in zip(string[again].tolist(), offset[again].tolist()):
        found[s].append(o)
    return [
        np.arange(n - length + 1) if t > 1 else np.array(sorted(f), np.int64)
        for f, n, t in zip(found, sizes.tolist(), times.tolist())]


def _runs(numbers: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of neighbouring numbers."""
    if not len(numbers):
        return []
    cut = np.flatnonzero(np.diff(numbers) > 1)
    return list(zip(numbers[np.concatenate(([0], cut + 1))].tolist(), (numbers[np.concatenate((cut, [-1]))] + 1).tolist()))


RUNS = T.StructType([
    T.StructField("context", T.BinaryType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])


def _merge_tasks(batches, schema: pa.Schema, length: int, symbols: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of rows sorted by key; all rows of a key are merged together."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None

    def done() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        shift, context = table["shift"].to_pylist(), table["context"].to_pylist()
        windows = repeated_windows(
            table["body"].to_pylist(), table["place"].to_numpy(), table["times"].to_numpy(), length, symbols)
        rows = [(c, a + s, b + s) for c, s, w in zip(context, shift, windows) for a, b in _runs(w)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    for batch in batches:
        keys = batch["key"].to_pylist()
        sizes = pc.binary_length(batch["body"]).to_pylist()
        start = 0
        for row, key in enumerate(keys):
            if size >= BUCKET_BYTES and key != last:
                if row > start:
                    held.append(batch.slice(start, row - start))
                yield done()
                held, size, start = [], 0, row
            size, last = size + sizes[row], key
        if len(keys) > start:
            held.append(batch.slice(start))
    if held:
        yield done()


def _halves(rows: DataFrame, length: int) -> DataFrame:
    """Rows by the two halves of the places that an anchor may have in a window.

    ``low`` to ``high`` are the places; windows with the anchor at ``high`` or less and
    ``low`` or more share the bytes from ``low`` before it to ``length - high`` after its
    begin, which are the new key.
    """
    middle = F.expr("(low + high) div 2").cast("int")
    ranges = F.explode(F.array(
        F.struct(F.col("low").alias("low"), middle.alias("high")),
        F.struct((middle + 1).alias("low"), F.col("high").alias("high"))))
    part = rows.withColumn("half", ranges).withColumns({"low": F.col("half.low"), "high": F.col("half.high")})
    most, least = F.least("place", "high"), F.greatest(F.col("place") - F.col("windows") + 1, F.col("low"))
    cut = F.col("place") - most
    part = part.filter(most >= least).select(
        "context", "times", "low", "high", (F.col("shift") + cut).alias("shift"), most.alias("place"),
        (most - least + 1).alias("windows"), F.substring("body", cut + 1, most - least + length).alias("body"))
    core = F.substring("body", F.col("place") - F.col("low") + 1, length - F.col("high") + F.col("low"))
    # the key names the range: windows of two ranges are never compared
    return part.withColumn("key", F.unhex(F.md5(F.concat(F.hex(core), F.lit(":"), F.col("low").cast("string")))))


def window_runs(
    rows: DataFrame, grams: DataFrame, length: int = LENGTH, gram: int = GRAM, symbols: int = SYMBOLS,
    crowded: int = CROWDED,
) -> DataFrame:
    """Runs of repeated windows in contexts (``BODIES``): ``context``, ``first``, ``last``.

    ``grams`` has the number of contexts, ``c``, of each ``gram``.
    """
    key = F.unhex(F.lpad(F.hex("gram"), 16, "0")).alias("key")
    part = rows.select(
        "context", "times", F.lit(0).alias("low"), F.lit(length - gram).alias("high"), F.lit(0).alias("shift"),
        "place", "windows", "body", key)
    sizes, found = grams.select(key, F.col("c").alias("m")), None
    while True:
        busy = freeze(sizes.filter(F.col("m") > crowded).select("key"))
        m = busy.count()
        many = None
        if m:
            busy = small(busy, m)
            many, part = part.join(busy, "key", "left_semi"), part.join(busy, "key", "left_anti")
        dealt = part.select("key", "context", "times", "shift", "place", "body").repartition("key")
        runs = map_batches(dealt.sortWithinPartitions("key"), _merge_tasks, RUNS, length, symbols)
        found = runs if found is None else found.unionByName(runs)
        if many is None:
            return found
        # with one place left, rows that share a key are the same window, more than once
        found = found.unionByName(many.filter("low = high").select(
            "context", F.col("shift").alias("first"), (F.col("shift") + 1).alias("last")))
        part = freeze(_halves(many.filter("low < high"), length))
        sizes = part.groupBy("key").agg(F.count(F.lit(1)).alias("m"))


def hot_rows(rows: int, most: int = HOT) -> int:
    """Rows from which a key is hot: ``most``, or a thousandth of a smaller table.

    There are never more hot keys than a broadcast may hold.
    """
    return max(min(most, rows // 1000), rows // MAX_BROADCAST_ROWS, 1)


def _joined(rows: DataFrame, table: DataFrame, key: str, busy: DataFrame) -> DataFrame:
    """Join with a table that has each key once; ``busy`` keys, which have very many rows,
    are met by broadcast."""
    busy = freeze(busy)
    keys = small(busy, busy.count())
    few = freeze(table.join(keys, key, "left_semi"))
    return rows.join(keys, key, "left_anti").join(table, key).unionByName(
        rows.join(small(few, few.count()), key))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
MERGED = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("spans", SPANS)])


def _merge_spans(batches, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted spans that neither overlap nor touch."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            merged = []
            for spans in part["spans"].to_pylist():
                bounds = np.array([(s["start"], s["end"]) for s in spans], np.int64)
                bounds = bounds[np.argsort(bounds[:, 0], kind="stable")]
                reach = np.maximum.accumulate(bounds[:, 1])
                cut = np.flatnonzero(bounds[1:, 0] > reach[:-1])
                merged.append([{"start": a, "end": b} for a, b in zip(
                    bounds[np.concatenate(([0], cut + 1)), 0].tolist(), reach[np.concatenate((cut, [-1]))].tolist())])
            yield pa.RecordBatch.from_arrays(
                [part["digest"], pa.array(merged, schema.field("spans").type)], schema=schema)


def repeated_spans(
    texts: DataFrame, length: int = LENGTH, gram: int = GRAM, symbols: int = SYMBOLS, crowded: int = CROWDED,
    most: int = HOT,
) -> tuple[DataFrame, DataFrame]:
    """``digest`` and ``spans`` (start, end; sorted, apart) of each text that has repeated
    passages, and the ``digest`` of each text that occurs more than ``COPIES`` times.

    ``texts`` has ``text`` (binary) and ``digest``, which identifies its content.
    """
    found = freeze(map_batches(texts, _contexts, CONTEXTS, length, gram))
    docs = freeze(found.filter("digest is not null").groupBy("digest").agg(
        F.min("doc").alias("doc"), F.count_distinct("doc").alias("copies")))
    found = found.drop("digest")
    hot = hot_rows(found.count(), most)
    grams = freeze(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    # rows are folded before they are shuffled, those of ordinary grams after the join
    contexts = freeze(_joined(found, grams.select("gram"), "gram", grams.filter(F.col("n") > hot).select("gram"))
                      .groupBy("gram", "context").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("doc", "start", "windows", "place")).alias("one")))
    mixed = freeze(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    contended = _joined(contexts, mixed.select("gram"), "gram", mixed.filter(F.col("c") > hot).select("gram"))
    # the first document with a context is the first with its text
    wanted = contended.select(F.col("one.doc").alias("doc"), F.struct(
        "gram", "context", "times", "one.place", "one.windows", "one.start").alias("w")
    ).groupBy("doc").agg(F.collect_list("w").alias("wanted")).join(docs.select("doc", "digest"), "doc")
    sources = texts.dropDuplicates(["digest"]).join(wanted.select("digest", "wanted"), "digest").select("text", "wanted")
    # written once, as crowded grams and the others read it apart
    bodies = freeze(map_batches(sources, _bodies, BODIES, length))
    runs = window_runs(bodies, mixed, length, gram, symbols, crowded)
    # a gram in one context only, which occurs more than once: all its windows do
    settled = contexts.filter("times > 1").join(mixed.select("gram"), "gram", "left_anti").select(
        "context", F.lit(0).alias("first"), F.col("one.windows").alias("last"))
    runs = freeze(runs.unionByName(settled).groupBy("context").agg(
        F.collect_list(F.struct("first", "last")).alias("runs")))
    placed = _joined(
        found.select("doc", "context", "start"), runs, "context",
        contexts.filter(F.col("times") > hot).select("context"))
    spans = placed.select("doc", F.explode(F.transform("runs", lambda r: F.struct(
        (F.col("start") + r["first"]).alias("start"), (F.col("start") + r["last"] + length - 1).alias("end")
    ))).alias("span")).groupBy("doc").agg(F.collect_list("span").alias("spans"))
    merged = freeze(map_batches(
        spans.join(docs.select("doc", "digest"), "doc").select("digest", "spans"), _merge_spans, MERGED))
    return merged, docs.filter(F.col("copies") > COPIES).select("digest")


def _cut(batches, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, pc.binary_length(batch["text"]).to_pylist()):
            kept = []
            for text, spans in zip(part["text"].to_pylist(), part["removed"].to_pylist()):
                ends = [0] + [s["end"] for s in spans]
                starts = [s["start"] for s in spans] + [len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(ends, starts)))
            yield pa.RecordBatch.from_arrays([
                pa.array(kept, f.type) if f.name == "kept" else part[f.name] for f in schema], schema=schema)


def cut_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """One row per row of ``df``: id, ``n_bytes``, ``removed`` (spans of bytes, sorted and
    apart) and ``kept`` (the other bytes).

    A byte is removed if ``length`` bytes that cover it start somewhere else too, in the
    same text or another, in UTF-8 and across no end of a text; overlaps count.  A null
    text counts as empty; texts shorter than ``length`` stay whole; rows may repeat and
    are then repeated text; other columns are ignored; an empty table gives no row.
    """
    body = text_or_empty(text)
    rows = df.select(
        F.col(f"`{id}`").alias("id"), body.cast("binary").alias("text"),
        F.unhex(F.substring(F.sha2(body, 256), 1, 32)).alias("digest"))
    spans, copied = repeated_spans(rows.select("digest", "text"), length, **options)
    held = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    if held <= MAX_BROADCAST_ROWS:
        joined = rows.join(small(spans, held), "digest", "left")
    else:
        # copies of one text would meet in one task
        copied = freeze(copied)
        keys = small(copied, copied.count())
        few = freeze(spans.join(keys, "digest", "left_semi"))
        joined = rows.join(keys, "digest", "left_anti").join(spans, "digest", "left").unionByName(
            rows.join(keys, "digest", "left_semi").join(
                small(few, few.agg(F.sum(F.size("spans"))).first()[0] or 0), "digest", "left"))
    joined = joined.select(
        "id", "text", F.octet_length("text").cast("long").alias("n_bytes"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("removed"))
    return map_batches(joined, _cut, T.StructType([
        joined.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("removed", SPANS),
        T.StructField("kept", T.BinaryType())])).withColumnRenamed("id", id)
