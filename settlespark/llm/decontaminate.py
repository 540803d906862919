"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item gives windows of consecutive words, each window a set of
shingles.  Full containment needs every shingle of a window, so a prefix of one,
its rarest, is enough to join on.  One pass counts the shingles of the benchmark in each
document; only documents that hold a prefix are searched for its places.  The place of such a shingle
fixes where a window would begin, whatever number of windows and items share it; starts
that do not fit the document are dropped, the words at the others are compared in full
with the windows, and the items that own a window are joined last.  Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlespark.llm.batches import text_or_empty
from settlespark.llm.columns import MAX_BROADCAST_ROWS, ascii_lower, row_key, small, words
from settlespark.plans.skew import freeze

# The words and the window of the contract.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 5
# A broadcast of hashes alone may have so many times the rows of another.
HASHES = 10
MAX_BROADCAST_BYTES = 32 << 20


def item_words(text: Column) -> Column:
    return words(ascii_lower(text), GAP)


def _shingle(of: Column, at: Column, k: int) -> Column:
    """Hash of ``k`` words from position ``at``; null where fewer are left."""
    taken = [F.get(of, at + i) for i in range(k)]
    return F.when(at + k <= F.size(of), F.xxhash64(F.lit(k), *taken))


def _windows(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """Distinct windows of each item: ``item`` and ``body``, the words of the window."""
    items = benchmark.select(
        F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"),
        item_words(text_or_empty(text)).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - WINDOW, F.lit(0)))
    return items.select("item", "all", F.explode(starts).alias("start")).select(
        "item", _body(F.slice("all", F.col("start") + 1, WINDOW)).alias("body")).distinct()


def _body(window: Column) -> Column:
    """The words of a window as one string; no word holds a blank."""
    return F.array_join(window, " ")


def _covered(places: Column) -> Column:
    """Number of positions in the union of sorted (start, end) spans."""
    first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    return F.aggregate(places, first, lambda done, p: F.struct(
        (done["n"] + F.greatest(F.lit(0), p["end"] - F.greatest(done["to"], p["start"]))).alias("n"),
        F.greatest(done["to"], p["end"]).alias("to")))["n"]


def contamination(
    df: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """One row per row of ``df``: id, ``n_words``, ``n_hit``, ``n_items``,
    ``items_sha256`` and ``contaminated``.

    A word is hit if it lies in any occurrence of a window: ``WINDOW`` consecutive
    words of an item, or all words of an item that has fewer.  ``contaminated``: at
    least one word in twenty is hit.  A null text has no words, a null item id
    counts as the empty string, items that share an id count once.  Rows may repeat;
    other columns are ignored; an empty table gives no row, an empty benchmark no hit.
    """
    held = df.select(
        F.col(f"`{id}`").alias("id"), row_key(F.col(f"`{id}`"), text_or_empty(text)).alias("key"),
        item_words(text_or_empty(text)).alias("words"))
    owners = freeze(_windows(benchmark, item, item_text))
    # what many items share is one window
    windows = freeze(owners.select("body").distinct().withColumn("window", F.split("body", " ")).withColumn(
        "size", F.size("window")))
    shingles = sorted({min(r.size, SHINGLE) for r in windows.select("size").distinct().collect()})
    k = F.least("size", F.lit(SHINGLE))
    grams = freeze(windows.select("body", "window", "size", F.posexplode("window").alias("at", "word")).select(
        "body", "size", "at", F.coalesce(*[
            F.when(k == n, _shingle(F.col("window"), F.col("at"), n)) for n in shingles or [1]
        ]).alias("h")).filter("h is not null"))
    sought = freeze(grams.select("h").distinct())

    # how often each document holds them; hashes alone are small enough for larger broadcasts
    def places(rows: DataFrame) -> DataFrame:
        spots = rows.select("key", "words", F.posexplode("words").alias("pos", "word"))
        hashes = [_shingle(F.col("words"), F.col("pos"), n) for n in shingles or [1]]
        return (
            spots.select("key", "pos", hashes[0].alias("h")) if len(hashes) == 1
            else spots.select("key", "pos", F.explode(F.array(*hashes)).alias("h")))

    counted = freeze(places(held).select("key", "h").join(
        small(sought, sought.count(), HASHES * max_broadcast_rows), "h"
    ).groupBy("key", "h").agg(F.count(F.lit(1)).alias("n")))
    rarity = counted.groupBy("h").agg(F.sum("n").alias("n"))

    # the rarest shingle of each window; a window with a shingle found nowhere occurs nowhere.
    # Where a window may begin follows from the shingle, its place and the size alone.
    prefix = freeze(grams.join(rarity, "h", "left").groupBy("body", "size").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "at")).alias("rarest")
    ).filter("rarest.n > 0").select("rarest.h", "rarest.at", "size").distinct())
    prefix_rows = prefix.count()
    keys = freeze(counted.join(
        small(prefix.select("h").distinct(), prefix_rows, max_broadcast_rows), "h", "left_semi"
    ).select("key").distinct())
    # only these documents are cut into words again
    near = df.select(row_key(F.col(f"`{id}`"), text_or_empty(text)).alias("key"), text_or_empty(text).alias("text")).join(
        small(keys, keys.count(), max_broadcast_rows), "key", "left_semi").select("key", item_words(F.col("text")).alias("words"))
    starts = places(near).join(small(prefix, prefix_rows, max_broadcast_rows), "h").withColumn(
        "start", F.col("pos") - F.col("at")).filter("start >= 0")
    per_row = freeze(starts.groupBy("key").agg(F.collect_set(F.struct("start", "size")).alias("starts")))

    # the words there, compared in full with the windows
    there = near.dropDuplicates(["key"]).join(per_row, "key").select("key", "words", F.explode("starts").alias("s")).select(
        "key", "s.start", "s.size", _body(F.slice(F.col("words"), F.col("s.start") + 1, F.col("s.size"))).alias("body"))
    known = windows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("body")).alias("bytes")).first()
    few = known.n <= max_broadcast_rows and (known.bytes or 0) <= MAX_BROADCAST_BYTES
    bodies = windows.select("body", "size")
    real = freeze(there.join(F.broadcast(bodies) if few else bodies, ["body", "size"]))

    # items last, each once per window of a document
    found = real.select("key", "body").distinct().join(owners, "body").groupBy("key").agg(
        F.array_sort(F.collect_set("item")).alias("items"))
    hits = real.groupBy("key").agg(F.array_sort(F.collect_set(F.struct(
        F.col("start"), (F.col("start") + F.col("size")).alias("end")))).alias("places")
    ).select("key", _covered(F.col("places")).alias("n_hit")).join(found, "key")

    n_words, n_hit = F.col("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return held.select("id", "key", F.size("words").cast("long").alias("n_words")).join(
        hits, "key", "left"
    ).select(
        F.col("id").alias(id), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"))


def drop_contaminated(
    df: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """The rows of ``df`` that :func:`contamination` does not flag, with all columns."""
    number = "_row_key"
    while number in df.columns:
        number = f"_{number}"
    key = row_key(F.col(f"`{id}`"), text_or_empty(text))
    flagged = freeze(contamination(
        df.select(key.alias(number), F.col(f"`{text}`").alias("text")), benchmark, number, "text", **options
    ).filter("contaminated").select(number).distinct())
    return df.withColumn(number, key).join(
        small(flagged, flagged.count()), number, "left_anti").drop(number)
