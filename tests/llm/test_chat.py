import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest

from settlespark.llm.chat import (
    BODY, END, START, chat_digests, chat_tokenizer, escape, format_conversations, loss_mask, parse,
    read_back, render, unescape,
)
from settlespark.plans.skew import freeze

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [START, END, BODY, "<|", "<\\|", "<\\\\|", "\\", "|", "<", "<|endoftext|>", " ", "\n", "ok", "é", "😀", "", "user\n"]


def made(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_escape_is_reversible_and_leaves_no_control_string():
    for text in made(3000):
        assert unescape(escape(text)) == text
        assert "<|" not in escape(text)


def test_mask_covers_exactly_the_assistant_texts():
    chat = chat_tokenizer(PATH)
    texts = made(600, 6)
    for k in range(0, 600, 6):
        turns = list(zip(["system", "user", "assistant", "user\n", "assistant", START], texts[k:k + 6]))
        formatted, spans = render(turns)
        assert parse(formatted) == turns
        e = chat.encode(formatted, add_special_tokens=False)
        assert chat.decode(e.ids, skip_special_tokens=False) == formatted
        mask = loss_mask(np.array(e.offsets).reshape(-1, 2), spans)
        loss = chat.decode([i for i, m in zip(e.ids, mask) if m], skip_special_tokens=False)
        assert loss == "".join(escape(t) for r, t in turns if r == "assistant")


def expected(rows):
    out = []
    for id_ in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == id_), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        turns = [(r or "", t or "") for _, r, t in turns]
        said = "".join(t for r, t in turns if r == "assistant")
        out.append((id_, len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                    len(said), sha256(said.encode()).hexdigest(), len(render(turns)[0])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [256, 2])
def test_digests(spark, block):
    texts = made(60, 7)
    rows = [(i % 7, i // 7, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)]
    rows += [(None, 1, "user", "x"), (None, None, None, None), (50, 0, "assistant", None), (51, 3, "assistant", "y"),
             (51, 3, "assistant", "y"), (51, 3, "assistant", "a"), (52, 0, "assistant", "long " * 30_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, id int, block int")
    got = chat_digests(df, PATH, turns_per_block=block) if block == 256 else None
    if got is None:
        got = read_back(format_conversations(df, PATH, turns_per_block=block), PATH)
    assert sorted([tuple(r)[:6] for r in got.collect()], key=repr) == expected(rows)


def test_no_block_exceeds_its_rows_when_turns_repeat(spark):
    rows = [(9, None, "user", f"m{i}") for i in range(700)] + [(None, i % 8, "assistant", "same") for i in range(700)]
    rows += [(8, 1, "user", "long " * 50 + f"{i}") for i in range(300)] + [(8, 1, "u" * 200 + f"{i}", "x") for i in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    blocks = format_conversations(df.repartition(3), PATH)
    one = len(chat_tokenizer(PATH).encode(render([("assistant", "same")])[0], add_special_tokens=False).ids)
    assert max(r.n_tokens for r in blocks.filter("id IS NULL").collect()) <= 256 * one
    assert sorted([tuple(r)[:6] for r in chat_digests(df, PATH).collect()], key=repr) == expected(rows)


def test_no_block_exceeds_its_characters(spark):
    rows = [(9, i, ("user", "assistant")[i % 2], f"{i} " * 400) for i in range(60)]
    rows += [(8, i, "assistant", "x" * size) for i, size in enumerate((10, 30_000, 10, 0, 4_990))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    blocks = freeze(format_conversations(df, PATH, chars_per_block=5_000))
    marks = len(START + BODY + END)
    sizes = [(r.id, r.formatted_chars) for r in blocks.collect()]
    assert len([s for i, s in sizes if i == 9]) > 10
    assert [s for i, s in sizes if s > 5_000 + 256 * marks] == [30_000 + len("assistant") + marks]
    assert sorted([tuple(r)[:6] for r in read_back(blocks, PATH).collect()], key=repr) == expected(rows)


def test_repeated_rows_are_spread(spark):
    df = spark.createDataFrame([(9, 1, "user", "same")] * 4000, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = format_conversations(df, PATH).selectExpr("shiftright(block, 33) AS part").distinct()
        assert blocks.count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_digests(df, PATH).collect() == []
