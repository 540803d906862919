import random

import public_tokenizers
import pytest

from settlespark.llm.encoding import PLAIN, PartEncoder, _tokenizer

PIECES = ["the", "Hello", "it's", "'ll", "naïve", "é", "́", "É", "ß", "Σ", "ς", "12", "1", "!!", "$$$", "<|endoftext|>",
          "<|startoftext|>", "漢字", "😀", "👩‍👩‍👧", "\x1c", "\x00", "​", " ", "\xa0", "\x85", "　", " ", "\t", "\n",
          "\n\n", "l'été", "DON'T", "Ça", "ÿŸ", "x²", "½", "ǅ", "ª", "×", "ŉ", "ẞ", "'S", "a_b", "0x1F", "ɏ", "Ⱥ", " ", "  ", "\r\n", "\x0b", "İ", "ﬁ", "</w>", "don't", " ", "_", "﻿", "ٱ", "़"]


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice(PIECES) + rng.choice(["", "", " "]) for _ in range(rng.randrange(40)))
            for _ in range(1500)]
    plain = [p for p in PIECES if PLAIN.fullmatch(p) and "<|" not in p]
    made += ["".join(rng.choice(plain) + rng.choice(["", "", " "]) for _ in range(rng.randrange(40)))
             for _ in range(1500)]
    letters = "".join(chr(c) for c in range(0x250) if PLAIN.fullmatch(chr(c)))
    return ["", " ", "\n", "a", " a ", "x" * 5000, letters, " ".join(letters), *letters] + made


@pytest.mark.parametrize("as_bytes", [False, True])
def test_ids_equal_those_of_whole_texts(as_bytes):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = [e.ids for e in _tokenizer(path).encode_batch(texts(), add_special_tokens=False)]
    small = PartEncoder(path, limit=50)
    for start in range(0, len(whole), 100):
        part = texts()[start:start + 100]
        ids, sizes = small.encode([t.encode() for t in part] if as_bytes else part)
        at = 0
        for k, size in enumerate(sizes):
            assert ids[at:at + size].tolist() == whole[start + k], part[k]
            at += size


def test_offsets_equal_those_of_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, small = _tokenizer(path), PartEncoder(path, spaced=True, limit=50)
    for text in texts():
        e = tokenizer.encode(text, add_special_tokens=False)
        ids, offsets = small.encode_offsets(text)
        assert ids.tolist() == e.ids, text
        assert [tuple(o) for o in offsets.tolist()] == e.offsets, text


def test_pieces_are_not_normalised_and_split_again():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = [t for t in texts() if PLAIN.fullmatch(t) and "<|" not in t]
    whole = [e.ids for e in _tokenizer(path).encode_batch(plain, add_special_tokens=False)]
    small = PartEncoder(path)
    # the tokenizer that does so is for all other texts
    small.tokenizer = None
    ids, sizes = small.encode(plain)
    assert sizes.tolist() == list(map(len, whole))
    assert ids.tolist() == [i for found in whole for i in found]
