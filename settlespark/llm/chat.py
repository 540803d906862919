"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered as a whole and encoded once with character offsets.
The spans of the assistant texts are then intersected with the token spans by
binary search.  Every border of a span is a control token, so no token crosses it.

Turns are sorted over the whole table and cut into blocks of at most ``TURNS`` rows and
``BLOCK_CHARS`` characters (or one longer turn) as they stream by; as each turn begins and ends with control tokens, the blocks of a
conversation put together are the encoding of the whole.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from settlespark.llm.batches import map_batches, partition_id
from settlespark.plans.skew import freeze

START, BODY, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TURNS = 256
BLOCK_CHARS = 1 << 20
PREFIX = 128
TARGET = "assistant"


def escape(text: str) -> str:
    """Break control strings by a backslash; a broken one gets one more."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted text and the sorted (start, end) spans of the assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{BODY}", escape(text)
        if role == TARGET and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for piece in formatted.split(END)[:-1]:
        role, text = piece.removeprefix(START).split(BODY)
        turns.append((unescape(role), unescape(text)))
    return turns


@lru_cache(maxsize=2)
def chat_tokenizer(path: str):
    """A byte-level tokenizer that knows the control tokens and keeps full offsets."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    if not isinstance(tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel):
        raise ValueError("chat formatting needs a byte-level tokenizer, which loses nothing")
    tokenizer.no_truncation()
    tokenizer.pre_tokenizer.trim_offsets = False
    tokenizer.post_processor = None
    tokenizer.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (START, BODY, END)])
    return tokenizer


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Whether each token lies in a span: by binary search for its start."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    at = np.searchsorted(spans[:, 0], offsets[:, 0], side="right") - 1
    return (at >= 0) & (offsets[:, 0] < spans[np.maximum(at, 0), 1])


FORMATTED = [
    T.StructField("ids", T.BinaryType()), T.StructField("mask", T.BinaryType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("formatted_chars", T.LongType()),
]


def _format(batches, schema: pa.Schema, tokenizer: str, turns_per_block: int, chars_per_block: int):
    """Blocks of sorted turns; those of earlier partitions have lower numbers."""
    chat, number = chat_tokenizer(tokenizer), partition_id() << 33

    def formatted(id_, turns) -> pa.RecordBatch:
        text, spans = render(turns)
        encoding = chat.encode(text, add_special_tokens=False)
        offsets = np.array(encoding.offsets, np.int64).reshape(-1, 2)
        mask = loss_mask(offsets, spans)
        values = (
            id_, number, np.array(encoding.ids, "<u4").tobytes(),
            np.packbits(mask, bitorder="little").tobytes(), len(mask), len(text))
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    last, turns, held = None, [], 0
    for batch in batches:
        for cells in zip(*[batch[c] for c in ("id", "role", "text")]):
            id_, role, text = (c.as_py() for c in cells)
            size = len(role) + len(text)
            if turns and (id_ != last or len(turns) == turns_per_block or held + size > chars_per_block):
                yield formatted(last, turns)
                turns, held, number = [], 0, number + 1
            last, held = id_, held + size
            turns.append((role, text))
    if turns:
        yield formatted(last, turns)


def _sorted_turns(rows: DataFrame) -> DataFrame:
    """Range partitions in the order of id, turn, role and text, sorted inside.

    Only the first ``PREFIX`` characters of roles and texts are range keys, as a sample
    of the keys is held by the driver.  Rows equal in all of them are told apart by a
    random number if nothing was cut off, so that any number of them is spread; others
    stay in one partition, which is sorted and streamed, not held.
    """
    cut_role, cut_text = (F.length(c) > PREFIX for c in ("role", "text"))
    keys = {
        "_role": F.substring("role", 1, PREFIX), "_cut_role": cut_role,
        "_text": F.when(cut_role, "").otherwise(F.substring("text", 1, PREFIX)),
        "_cut_text": cut_role | cut_text, "_spread": F.when(~(cut_role | cut_text), F.rand(0)),
    }
    return rows.withColumns(keys).repartitionByRange("id", "turn", *keys).sortWithinPartitions(
        "id", "turn", "role", "text").select("id", "role", "text")


def format_conversations(
    df: DataFrame, tokenizer: str, id: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", turns_per_block: int = TURNS, chars_per_block: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per block of a conversation, at most ``turns_per_block`` rows and
    ``chars_per_block`` characters of roles and texts (a longer turn is a block of its
    own): id, ``block`` (ascending in the conversation, with gaps), token ``ids`` (little-endian unsigned 32-bit),
    ``mask`` (one bit per token, lowest first), ``n_tokens``, ``formatted_chars``.

    Turns are in ascending order of ``turn`` (null first, ties by role and text);
    null roles and texts count as empty; rows with a null id form one
    conversation.  Other columns are ignored; an empty table gives no row.
    """
    def column(name: str):
        return F.col(f"`{name}`")

    rows = df.select(
        column(id).alias("id"), column(turn).alias("turn"),
        F.coalesce(column(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(column(text).cast("string"), F.lit("")).alias("text"))
    return map_batches(_sorted_turns(rows), _format, T.StructType([
        T.StructField("id", df.schema[id].dataType), T.StructField("block", T.LongType()), *FORMATTED,
    ]), tokenizer, turns_per_block, chars_per_block)


def _digest(batches, schema: pa.Schema, tokenizer: str):
    """Read formatted rows back, block after block of each conversation."""
    chat = chat_tokenizer(tokenizer)
    state, rows = None, []

    def ended():
        return [state["id"], state["n"], state["turns"].hexdigest(), state["chars"],
                state["loss"].hexdigest(), state["formatted"], state["tokens"]]

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("id", "ids", "mask", "n_tokens", "formatted_chars")]
        for id_, ids, mask, n, chars in zip(*columns):
            if state is None or state["id"] != id_:
                if state is not None:
                    rows.append(ended())
                state = {"id": id_, "n": 0, "turns": sha256(), "loss": sha256(), "chars": 0,
                         "formatted": 0, "tokens": 0}
            ids = np.frombuffer(ids, "<u4")
            turns = parse(chat.decode(ids.tolist(), skip_special_tokens=False))
            for role, text in turns:
                state["turns"].update(f"{role}\n{text}\n".encode())
            kept = np.unpackbits(np.frombuffer(mask, np.uint8), bitorder="little", count=n).view(bool)
            edges = np.flatnonzero(np.diff(np.concatenate(([0], kept.view(np.int8), [0]))))
            for a, b in edges.reshape(-1, 2).tolist():
                text = unescape(chat.decode(ids[a:b].tolist(), skip_special_tokens=False))
                state["loss"].update(text.encode())
                state["chars"] += len(text)
            state["n"] += len(turns)
            state["formatted"] += chars
            state["tokens"] += n
        if len(rows) >= 1000:
            yield _rows(rows, schema)
            rows = []
    if state is not None:
        rows.append(ended())
    yield _rows(rows, schema)


def _rows(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def read_back(formatted: DataFrame, tokenizer: str, id: str = "conv_id") -> DataFrame:
    """Digests of each conversation, from the formatted rows alone."""
    ordered = formatted.repartition("id").sortWithinPartitions("id", "block")
    return map_batches(ordered, _digest, T.StructType([
        T.StructField(id, formatted.schema["id"].dataType), T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ]), tokenizer)


def chat_digests(df: DataFrame, tokenizer: str, **columns) -> DataFrame:
    """Format all conversations, write them, and read their digests back."""
    formatted = freeze(format_conversations(df, tokenizer, **columns))
    return read_back(formatted, tokenizer, columns.get("id", "conv_id"))
