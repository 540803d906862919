"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

Documents with the same words in the same order are folded into one node first, so
copies are never compared.  Nodes meet in the buckets of signature bands:

1. in every bucket each node is paired with the smallest one, the pairs are verified
   on the full shingle sets, and the links give first components;
2. buckets that still hold several components are completed block by block: nodes
   outside the largest component are compared with all nodes of other components on
   their signatures, and those that may reach the threshold meet again with their full
   sets, likeliest pairs first, until a link joins their components or all have failed.

Pairs within one component need no comparison, so a group of thousands of copies
costs a star and not all its pairs, and no link between components is lost that
shares a band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from settlespark.llm.batches import map_batches, slices, text_or_empty
from settlespark.llm.columns import MAX_BROADCAST_ROWS, row_key, small
from settlespark.llm.components import EDGES as LINKS
from settlespark.llm.components import UnionFind, components
from settlespark.llm.superminhash import SLOTS, band_keys, mix, signatures
from settlespark.plans.skew import freeze

SHINGLE = 5
# Links: 100 * intersection >= percent * union.
PERCENT = 85
# A pair at the threshold shares no band with less than this probability.
UNMET = 1e-6
# Below so many equal slots a pair is not verified; a pair at the threshold has fewer with
# less than this probability, taking slots as independent.
UNLIKELY = 2e-7
BLOCK = 500
SLICE_BYTES = 4 << 20
CACHED_WORDS = 150_000


@dataclass(frozen=True)
class Threshold:
    """Links from ``percent`` on, and how pairs are sought for them."""

    percent: int

    @cached_property
    def band_rows(self) -> int:
        """Slots a band, as many as ``UNMET`` allows: 5 at 85 percent, 4 at 80."""
        p = self.percent / 100
        rows = [r for r in range(1, SLOTS + 1) if (1 - p ** r) ** (SLOTS // r) < UNMET]
        if not rows or p > 1:
            raise ValueError(f"pairs are not found reliably at {self.percent} percent")
        return max(rows)

    @cached_property
    def plausible(self) -> int:
        """Equal slots from which a pair is verified."""
        p, below = self.percent / 100, 0.0
        for slots in range(SLOTS):
            below += comb(SLOTS, slots) * p ** slots * (1 - p) ** (SLOTS - slots)
            if below >= UNLIKELY:
                return slots
        return SLOTS

    def same_size(self, a: Column, b: Column) -> Column:
        """A bound on the sizes that every link keeps."""
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def shingle_sets(texts: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
    """Sorted distinct shingle hashes of each text, and a digest of its words.

    Words are what white space of ASCII separates, with A-Z in lower case.  A text
    with fewer words than a shingle has one shingle, a text without words none.
    """
    if len(_WORDS) > CACHED_WORDS:
        _WORDS.clear()
    sets, digests = [], []
    for text in texts:
        words = text.lower().split()
        digests.append(blake2b(b" ".join(words), digest_size=16).digest())
        if not words:
            sets.append(np.zeros(0, np.uint64))
            continue
        hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
        width = min(SHINGLE, len(words))
        count = len(words) - width + 1
        joined = np.full(count, width, np.uint64)
        for at in range(width):
            joined = mix(joined * np.uint64(0x9E3779B97F4A7C15) + hashes[at:at + count])
        sets.append(np.unique(joined))
    return sets, digests


def _sketch(batches, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, pc.binary_length(batch["text"]).to_pylist(), SLICE_BYTES):
            sets, digests = shingle_sets(part["text"].to_pylist())
            # the signature of a digest leaves the slice once
            first: dict[bytes, int] = {}
            fresh = [first.setdefault(d, row) == row and len(sets[row]) > 0 for row, d in enumerate(digests)]
            rows = [row for row, f in enumerate(fresh) if f]
            chosen = [sets[row] for row in rows]
            owner = np.repeat(np.arange(len(chosen)), [len(s) for s in chosen])
            table = signatures(np.concatenate(chosen) if chosen else np.zeros(0, np.uint64), owner, len(chosen))
            at = {row: k for k, row in enumerate(rows)}
            columns = {
                "digest": digests, "n": [len(s) for s in sets],
                "sig": [table[at[r]].tobytes() if f else None for r, f in enumerate(fresh)],
            }
            yield pa.RecordBatch.from_arrays([
                part[f.name] if f.name in ("id", "key") else pa.array(columns[f.name], f.type) for f in schema
            ], schema=schema)


def _full_sets(batches, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, pc.binary_length(batch["text"]).to_pylist(), SLICE_BYTES):
            sets, _ = shingle_sets(part["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([
                part["node"], pa.array([s.view(np.int64) for s in sets], schema.field(1).type)], schema=schema)


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SLOTS)


def _places(batches, schema: pa.Schema, band_rows: int) -> Iterator[pa.RecordBatch]:
    """One row per node and band."""
    for batch in batches:
        keys = band_keys(_signatures(batch["sig"]), band_rows)
        yield pa.RecordBatch.from_arrays([
            *[pa.array(np.repeat(batch[c].to_numpy(), keys.shape[1])) for c in ("node", "n")],
            pa.array(keys.reshape(-1))], schema=schema)


class _Groups:
    """The tables of one run; every one that is read twice is written first."""

    def __init__(self, df: DataFrame, id: str, text: str, threshold: Threshold):
        self.threshold = threshold
        body = text_or_empty(text)
        self.texts = df.select(
            F.col(f"`{id}`").alias("id"), row_key(F.col(f"`{id}`"), body).alias("key"),
            body.cast("binary").alias("text"))
        self.documents = freeze(map_batches(self.texts, _sketch, T.StructType([
            *self.texts.schema.fields[:2], T.StructField("digest", T.BinaryType()),
            T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType()),
        ])))
        self.nodes = freeze(
            self.documents.filter("n > 0").groupBy("digest").agg(
                # a null id comes last
                F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "key")).alias("head"),
                F.first("n").alias("n"),
                F.first("sig", ignorenulls=True).alias("sig"),
            ).withColumn("node", F.monotonically_increasing_id()))
        places = map_batches(self.nodes.select("node", "n", "sig"), _places, T.StructType([
            T.StructField(c, T.LongType()) for c in ("node", "n", "band")]), threshold.band_rows)
        buckets = places.groupBy("band").agg(
            F.count(F.lit(1)).alias("m"), F.min(F.struct("node", "n")).alias("least")).filter("m > 1").drop("m")
        # nodes in buckets with others
        self.met = freeze(places.join(buckets, "band"))
        self.sets: DataFrame | None = None

    def _fetch_sets(self, nodes: DataFrame) -> None:
        """Full sets of the nodes that have none yet, from the texts."""
        wanted = nodes.distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("node"), "node", "left_anti")
        wanted = freeze(self.nodes.join(wanted, "node", "left_semi").select("node", "head.key"))
        texts = self.texts.select("key", "text").join(small(wanted, wanted.count(), MAX_BROADCAST_ROWS), "key")
        # rows that share a key are the same text
        sets = freeze(map_batches(texts.dropDuplicates(["node"]), _full_sets, T.StructType([
            T.StructField("node", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])))
        self.sets = sets if self.sets is None else self.sets.unionByName(sets)

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b), by the sizes of full sets and their intersection."""
        self._fetch_sets(pairs.select(F.col("a").alias("node")).unionByName(
            pairs.select(F.col("b").alias("node"))))
        sets = self.sets
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").join(
            sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
        shared = F.size(F.array_intersect("of_a", "of_b"))
        return freeze(both.select(
            F.col("a").alias("u"), F.col("b").alias("v"), shared.alias("shared"),
            (F.size("of_a") + F.size("of_b")).alias("sizes"),
        ).filter(100 * F.col("shared") >= self.threshold.percent * (F.col("sizes") - F.col("shared"))).select("u", "v"))

    def stars(self) -> DataFrame:
        """Pairs of each node with the smallest of its bucket, if the sizes allow a link."""
        others = self.met.filter("node <> least.node")
        return freeze(others.filter(self.threshold.same_size(F.col("n"), F.col("least.n"))).select(
            F.col("least.node").alias("a"), F.col("node").alias("b")).distinct())

    def completing(self, roots: DataFrame) -> DataFrame:
        """Links between different components that meet in a bucket."""
        met = self.met.drop("least").join(
            roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        per_root = met.groupBy("band", "root").agg(F.count(F.lit(1)).alias("m"))
        open_ = freeze(per_root.groupBy("band").agg(
            F.sum("m").alias("rows"), F.max(F.struct("m", "root")).alias("main"),
        ).filter(F.col("rows") > F.col("main.m")))
        held = freeze(met.join(open_, "band").select(
            "band", "node", "root", "n", (F.col("root") != F.col("main.root")).alias("odd")))
        marks = self.nodes.select("node", "sig")
        plausible = freeze(map_batches(
            _cells(held, marks), _compare, T.StructType([T.StructField("band", T.LongType()),
                                                         T.StructField("node", T.LongType())]),
            self.threshold).distinct())
        if plausible.isEmpty():
            return plausible.select(F.col("band").alias("u"), F.col("node").alias("v"))
        self._fetch_sets(plausible.select("node"))
        full = marks.join(self.sets, "node")
        return freeze(map_batches(
            _cells(held.join(plausible, ["band", "node"], "left_semi"), full), _link, LINKS,
            self.threshold).distinct())


def _cells(held: DataFrame, carried: DataFrame) -> DataFrame:
    """Rows of buckets dealt to cells of a left and a right block, one cell after another.

    Left are the nodes outside the largest component of a bucket, right are all nodes;
    each left block meets each right block once, so a bucket of any size is spread.
    """
    sizes = held.groupBy("band").agg(
        F.ceil(F.count_if("odd") / BLOCK).cast("int").alias("left_blocks"),
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("right_blocks")).filter("left_blocks > 0")
    rows = held.join(sizes, "band").join(carried, "node")

    def block(count: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    columns = ["band", "node", "root", "n", "odd", *[c for c in carried.columns if c != "node"]]
    left = rows.filter("odd").select(
        *columns, block("left_blocks").alias("i"), every("right_blocks").alias("j"), F.lit(True).alias("left"))
    right = rows.select(
        *columns, every("left_blocks").alias("i"), block("right_blocks").alias("j"), F.lit(False).alias("left"))
    return left.unionByName(right).repartition("band", "i", "j").sortWithinPartitions(
        "band", "i", "j", "left", "node")


class _Cell:
    """The rows of one cell; the right ones come first."""

    def __init__(self, rows: list[pa.RecordBatch], threshold: Threshold):
        self.threshold = threshold
        table = pa.Table.from_batches(rows)
        left = table["left"].to_numpy()
        self.band = table["band"][0].as_py()
        self.right = len(left) - int(np.count_nonzero(left))
        self.node, self.root, self.n = (table[c].to_numpy() for c in ("node", "root", "n"))
        self.odd = table["odd"].to_numpy()
        self.sig = _signatures(table["sig"])
        self.bands = band_keys(self.sig, threshold.band_rows)
        self.sets = table["shingles"] if "shingles" in table.column_names else None

    def plausible(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each left row the right rows that it may be linked with, and equal slots.

        A pair belongs to the first band that it shares, and to the smaller node if both
        are outside the largest component.
        """
        root, odd, n = self.root[:self.right], self.odd[:self.right], self.n[:self.right]
        for x in range(self.right, len(self.node)):
            fits = (root != self.root[x]) & (~odd | (self.node[:self.right] > self.node[x]))
            fits &= 100 * np.minimum(n, self.n[x]) >= self.threshold.percent * np.maximum(n, self.n[x])
            at = np.flatnonzero(fits)
            if not len(at):
                continue
            same = self.bands[at] == self.bands[x]
            at = at[self.bands[x][np.argmax(same, axis=1)] == self.band]
            equal = np.count_nonzero(self.sig[at] == self.sig[x], axis=1)
            kept = equal >= self.threshold.plausible
            if kept.any():
                yield x, at[kept], equal[kept]

    def shingles(self, row: int) -> np.ndarray:
        # sorted as unsigned numbers
        return self.sets[row].values.to_numpy(zero_copy_only=False).view(np.uint64)


def _by_cell(batches, threshold: Threshold) -> Iterator[_Cell]:
    """Cells in a stream of rows in which those of a cell follow one another."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        ids = list(zip(*[batch[c].to_pylist() for c in ("band", "i", "j")]))
        start = 0
        for row, cell in enumerate(ids):
            if cell != last:
                if row > start:
                    held.append(batch.slice(start, row - start))
                if held:
                    yield _Cell(held, threshold)
                held, start, last = [], row, cell
        if len(ids) > start:
            held.append(batch.slice(start))
    if held:
        yield _Cell(held, threshold)


def _compare(batches, schema: pa.Schema, threshold: Threshold) -> Iterator[pa.RecordBatch]:
    """The rows of each cell that have a plausible partner."""
    for cell in _by_cell(batches, threshold):
        rows: set[int] = set()
        for x, partners, _ in cell.plausible():
            rows.add(x)
            rows.update(partners.tolist())
        if rows:
            nodes = np.unique(cell.node[list(rows)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(nodes), cell.band)), pa.array(nodes)], schema=schema)


def _link(batches, schema: pa.Schema, threshold: Threshold) -> Iterator[pa.RecordBatch]:
    """Links between components in each cell; joined components are compared no more."""
    for cell in _by_cell(batches, threshold):
        joined, found = UnionFind(), []
        for x, partners, equal in cell.plausible():
            own = cell.shingles(x)
            for y in partners[np.argsort(-equal, kind="stable")].tolist():
                a, b = int(cell.root[x]), int(cell.root[y])
                if joined.find(a) == joined.find(b):
                    continue
                other = cell.shingles(y)
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                shared = int(np.count_nonzero(own[at] == other))
                if 100 * shared >= threshold.percent * (len(own) + len(other) - shared):
                    joined.join(a, b)
                    found.append((int(cell.node[x]), int(cell.node[y])))
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], schema=schema)


def _grouped(df: DataFrame, id: str, text: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """All documents, and per node its component's smallest id and the head that stays."""
    run = _Groups(df, id, text, Threshold(percent))
    links = run.verify(run.stars())
    roots = freeze(components(links))
    more = run.completing(roots)
    if not more.isEmpty():
        roots = freeze(components(links.unionByName(more)))
    heads = run.nodes.select("digest", "head", "node").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    stays = heads.groupBy("root").agg(F.min("head").alias("stays")).withColumn("component_id", F.col("stays.id"))
    return run.documents, heads.join(stays, "root").select("digest", "component_id", F.col("stays.key").alias("stays"))


def near_groups(df: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``df``: id, ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked when their sets of ``SHINGLE``-word shingles have a Jaccard
    similarity of at least ``percent`` / 100; ``component_id`` is the smallest id
    reachable over links (a null id counts only if there is no other), ``kept`` says
    whether it is the row's own.  A text without words (or null) is linked with
    nothing.  Rows may repeat; other columns are ignored; an empty table gives no row.
    """
    documents, heads = _grouped(df, id, text, percent)
    joined = documents.select("id", "digest", "n").join(heads, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_copies(
    df: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """One row of each group of near copies (the one with the smallest id), with all
    columns; texts without words stay.  Rows equal in id and text count as one row
    and stay or go together."""
    documents, heads = _grouped(df, id, text, percent)
    gone = freeze(documents.filter("n > 0").select("key", "digest").join(heads, "digest")
                  .filter("key <> stays").select("key").distinct())
    number = "_row_key"
    while number in df.columns:
        number = f"_{number}"
    return df.withColumn(number, row_key(F.col(f"`{id}`"), text_or_empty(text))).join(
        small(gone.select(F.col("key").alias(number)), gone.count(), MAX_BROADCAST_ROWS), number, "left_anti"
    ).drop(number)
