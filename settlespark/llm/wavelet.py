"""Token ids of documents as wavelet matrix files.

A shard holds the ids of a run of documents in id order.  Its distinct ids get
dense codes by falling frequency; plane by plane the codes are split by one bit,
zeros first, both halves in order.  The planes with rank directories answer access,
rank (occurrences before a position), select (position of the k-th occurrence)
and counting in as many steps as there are planes.  High planes are almost empty
and compress well.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from settlespark.llm.batches import (
    SLICE_BYTES, map_batches, partition_id, shuffles, slices, text_or_empty,
)
from settlespark.llm.encoding import encoder
from settlespark.plans.skew import checkpoint_dir, freeze

MAGIC = b"WVM1"
SHARD_TOKENS = 4_000_000


@dataclass
class _Plane:
    words: np.ndarray
    zeros: int

    def __post_init__(self):
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(counts)))

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, inside = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[np.minimum(word, len(self.words) - 1)] & ((np.uint64(1) << inside) - np.uint64(1))
        return self.before[word] + np.where(inside > 0, np.bitwise_count(low), 0)


class WaveletMatrix:
    """Succinct sequence of ids; positions and ids may be arrays."""

    def __init__(self, length: int, alphabet: np.ndarray, planes: list[bytes]):
        self.length, self.alphabet, self.packed = length, alphabet, planes
        self._planes: list[_Plane] | None = None

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        present = np.flatnonzero(counts)
        alphabet = present[np.argsort(-counts[present], kind="stable")].astype(np.uint32)
        code_of = np.zeros(len(counts), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        code_of[alphabet] = np.arange(len(alphabet))
        codes, planes = code_of[ids], []
        for shift in reversed(range(cls.depth(len(alphabet)))):
            ones = (codes >> shift) & 1 == 1
            planes.append(np.packbits(ones, bitorder="little").tobytes())
            codes = np.concatenate((codes.compress(~ones), codes.compress(ones)))
        return cls(len(ids), alphabet, planes)

    @staticmethod
    def depth(symbols: int) -> int:
        return max(0, symbols - 1).bit_length()

    @property
    def planes(self) -> list[_Plane]:
        if self._planes is None:
            self._planes = []
            for packed in self.packed:
                words = np.frombuffer(packed + bytes(-len(packed) % 8), "<u8")
                self._planes.append(_Plane(words, self.length - int(np.bitwise_count(words).sum())))
        return self._planes

    def decode(self) -> np.ndarray:
        """All ids in order, undoing the splits from the last plane to the first."""
        codes = np.zeros(self.length, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for shift, packed in enumerate(reversed(self.packed)):
            ones = np.unpackbits(
                np.frombuffer(packed, np.uint8), bitorder="little", count=self.length).view(bool)
            zeros = self.length - int(np.count_nonzero(ones))
            above = np.empty_like(codes)
            # by positions: a mask costs a wrong guess at every other bit
            above[np.flatnonzero(~ones)] = codes[:zeros]
            above[np.flatnonzero(ones)] = codes[zeros:] | codes.dtype.type(1 << shift)
            codes = above
        return self.alphabet[codes] if len(self.alphabet) else np.zeros(0, np.uint32)

    def access(self, at) -> np.ndarray:
        """Ids at the given positions."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        if len(at) and (at.min() < 0 or at.max() >= self.length):
            raise IndexError("position outside the sequence")
        code = np.zeros(len(at), np.int64)
        for plane in self.planes:
            bit = plane.bit(at).astype(bool)
            ones = plane.rank1(at)
            at = np.where(bit, plane.zeros + ones, at - ones)
            code = 2 * code + bit
        return self.alphabet[code] if self.length else np.zeros(0, np.uint32)

    def _code(self, id_: int) -> int | None:
        found = np.flatnonzero(self.alphabet == id_)
        return int(found[0]) if len(found) else None

    def rank(self, id_: int, at) -> np.ndarray:
        """Occurrences of the id before each position."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        low, high, _ = self._range(id_, np.zeros_like(at), at)
        return high - low

    def count(self, id_: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of the id in positions ``low`` to ``high`` (exclusive)."""
        high = self.length if high is None else high
        a, b = self.rank(id_, [low, high])
        return int(b - a)

    def _range(self, id_: int, low: np.ndarray, high: np.ndarray):
        code = self._code(id_)
        path = []
        if code is None:
            return high, high, path
        for level, plane in enumerate(self.planes):
            ones_low, ones_high = plane.rank1(low), plane.rank1(high)
            bit = code >> (len(self.packed) - 1 - level) & 1
            path.append(bit)
            low, high = (
                (plane.zeros + ones_low, plane.zeros + ones_high) if bit
                else (low - ones_low, high - ones_high))
        return low, high, path

    def select(self, id_: int, k) -> np.ndarray:
        """Position of the k-th occurrence (from 0) of the id, -1 where there is none."""
        k = np.atleast_1d(np.asarray(k, np.int64))
        low, high, path = self._range(id_, np.zeros(1, np.int64), np.array([self.length]))
        found = (k >= 0) & (k < high[0] - low[0])
        at = low[0] + np.where(found, k, 0)
        for plane, bit in zip(reversed(self.planes), reversed(path)):
            at = _select(plane, at - plane.zeros if bit else at, bit, self.length)
        return np.where(found, at, -1)

    def occurrences(self, id_: int) -> np.ndarray:
        """Positions of all occurrences of the id."""
        return self.select(id_, np.arange(self.count(id_)))


def _select(plane: _Plane, k: np.ndarray, bit: int, length: int) -> np.ndarray:
    """Position of the k-th one (or zero): the word by binary search, then the bit."""
    before = plane.before if bit else 64 * np.arange(len(plane.before)) - plane.before
    word = np.searchsorted(before, k, side="right") - 1
    rest = k - before[word]
    bits = plane.words[np.minimum(word, len(plane.words) - 1)]
    bits = bits if bit else ~bits
    table = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    inside = np.argmax(np.cumsum(table, axis=1) > rest[:, None], axis=1)
    return word * 64 + inside


@dataclass
class Shard:
    """The ids of a run of documents; ``ids`` are document ids, ``sizes`` their tokens."""

    matrix: WaveletMatrix
    doc_ids: list
    sizes: np.ndarray

    def to_bytes(self) -> bytes:
        """Header, then the compressed parts: document ids, sizes, alphabet, planes."""
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [
            json.dumps(self.doc_ids, default=str).encode(), self.sizes.astype("<i8").tobytes(),
            self.matrix.alphabet.astype("<u4").tobytes(), *self.matrix.packed,
        ]
        packed = [pack(p) for p in parts]
        header = json.dumps({"tokens": self.matrix.length, "parts": [len(p) for p in packed]}).encode()
        return b"".join([MAGIC, struct.pack("<I", len(header)), header, *packed])

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (size,) = struct.unpack("<I", data[4:8])
        header, at, parts = json.loads(data[8:8 + size]), 8 + size, []
        for length in header["parts"]:
            parts.append(zstandard.ZstdDecompressor().decompress(data[at:at + length]))
            at += length
        matrix = WaveletMatrix(header["tokens"], np.frombuffer(parts[2], "<u4"), parts[3:])
        return cls(matrix, json.loads(parts[0]), np.frombuffer(parts[1], "<i8"))


MANIFEST = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()),
    T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
])


def _write(batches, schema: pa.Schema, folder: str, tokenizer: str, end_id: int, shard_tokens: int):
    """Encode the sorted documents of a task and close a shard file at ``shard_tokens``."""
    encode = encoder(tokenizer).encode
    store, base = fs.FileSystem.from_uri(folder)
    docs, sizes, ids, held, seq, files = [], [], [], 0, 0, []

    def close():
        nonlocal docs, sizes, ids, held, seq
        if not docs:
            return
        data = Shard(WaveletMatrix.build(np.concatenate(ids)), docs, np.concatenate(sizes)).to_bytes()
        # a name of its own per attempt: only files in the manifest count
        name = f"{partition_id():06d}-{seq:06d}-{uuid.uuid4().hex}.wvm"
        with store.open_output_stream(f"{base}/{name}") as out:
            out.write(data)
        files.append((partition_id(), seq, f"{folder}/{name}", len(docs), held))
        docs, sizes, ids, held, seq = [], [], [], 0, seq + 1

    for batch in batches:
        lengths = pc.binary_length(batch["text"]).to_pylist()
        for part in slices(batch, lengths, min(SLICE_BYTES, shard_tokens)):
            found, count = encode(part["text"].to_pylist())
            ends = np.cumsum(count)
            docs += part["id"].to_pylist()
            sizes.append(count + 1)
            ids.append(np.insert(found, ends, end_id))
            held += len(found) + len(count)
            if held >= shard_tokens:
                close()
    close()
    yield pa.RecordBatch.from_arrays(
        [pa.array([f[i] for f in files], t.type) for i, t in enumerate(schema)], schema=schema)


def write_shards(
    df: DataFrame, folder: str, tokenizer: str, end_id: int, id: str = "doc_id",
    text: str = "text", shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Write the ids of all texts below ``folder`` and return the manifest of its files.

    Documents are in ascending order of id over the files (null first, ties by
    text), each followed by ``end_id``; a null text counts as empty.  A file is
    closed once it holds ``shard_tokens`` tokens and never divides a document.
    The folder must be one that all executors share.
    """
    fs_, base = fs.FileSystem.from_uri(folder)
    fs_.create_dir(base, recursive=True)
    ranged = (
        df.select(F.col(f"`{id}`").alias("id"), text_or_empty(text).cast("binary").alias("text"))
        .repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    )
    return freeze(map_batches(ranged, _write, MANIFEST, folder, tokenizer, end_id, shard_tokens))


def open_shard(path: str) -> Shard:
    store, base = fs.FileSystem.from_uri(path)
    with store.open_input_stream(base) as source:
        return Shard.from_bytes(source.read())


def _read(batches, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch["path"].to_pylist(), batch["first"].to_pylist()):
            shard = open_shard(path)
            ids = shard.matrix.decode().astype("<u4")
            ends = np.cumsum(shard.sizes)
            view = memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), shard.sizes.tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array(shard.doc_ids, schema.field(0).type),
                pa.array(start + ends - shard.sizes, pa.int64()), pa.array(shard.sizes, pa.int64()),
                pa.array(crc, pa.int64()),
            ], schema=schema)


def read_documents(manifest: DataFrame, id: str, id_type: T.DataType) -> DataFrame:
    """Per document, from the files: id, ``start``, ``n_tokens``, ``ids_crc32``.

    Ids of documents must be integers or strings (they are kept as JSON).
    """
    # one row per file
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))
    tasks = max(shuffles(manifest), manifest.count() // 4)
    return map_batches(placed.repartition(tasks), _read, T.StructType([
        T.StructField(id, id_type), T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ]))


def token_files(
    df: DataFrame, tokenizer: str, end_id: int, id: str = "doc_id", text: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Write ``df`` as shards in the shared folder and read every document back.

    An empty table writes no file and gives an empty result; rows that repeat an
    id stay separate documents; other columns are ignored.
    """
    folder = f"{checkpoint_dir(df.sparkSession)}/tokens-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else folder.replace("file:", "file://", 1)
    manifest = write_shards(df, folder, tokenizer, end_id, id, text, shard_tokens)
    return read_documents(manifest, id, df.schema[id].dataType)
