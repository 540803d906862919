"""Token ids of whole texts, given by the tokenizers library once per distinct part.

Both tokenizers in use split a text at white space before they merge, and no
merge, normalisation or split pattern looks across such a border.  The ids of a
text are therefore those of its parts put together, and a part met before need not
be encoded again.  Where white space is dropped, texts of common characters are cut
on into the pieces that the tokenizer merges within, so that "word", "Word," and
"word." share one.  ``tests/llm/test_encoding.py`` compares the result with that of
the library on whole texts.
"""

from __future__ import annotations

import codecs
import os
import re
from functools import lru_cache

import numpy as np

# The characters that both tokenizers treat as white space (Unicode White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Chunks of a tokenizer that drops white space, and of one whose tokens may begin with it.
BARE, SPACED = f"[^{SPACE}]+", f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
CACHED_PARTS = 400_000

# Texts of these characters and without a control string are cut into pieces here; all
# others into chunks.  The letters are those of Latin-1 and Latin Extended-A that keep
# within this set in lower case; normalisation leaves them as they are.
LETTERS = "a-zA-ZÀ-ÖØ-öø-įı-ſ"
PLAIN = re.compile(f"[ -~\t-\r{LETTERS}]*")
# Fixed value: the split pattern of the tokenizer, for such characters in lower case.
PIECE = re.compile(f"[{LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^{LETTERS}0-9 \t-\r]+")
JOINED = 200


class _Numbers(dict):
    """Number of each key seen; new ones are queued."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key):
        self.new.append(key)
        self[key] = number = len(self)
        return number


class _Store:
    """Token ids of numbered strings, put together on demand."""

    def __init__(self, offsets: bool = False):
        self.numbers, self.used = _Numbers(), 0
        self.begin = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)
        self.offsets = np.zeros((4096, 2), np.int32) if offsets else None

    def queued(self) -> tuple[int, list]:
        """The first number and the strings that have no ids yet."""
        new, self.numbers.new = self.numbers.new, []
        return len(self.numbers) - len(new), new

    def put(self, where: np.ndarray, count: np.ndarray, ids: np.ndarray, offsets=None) -> None:
        size, total = len(self.numbers), self.used + len(ids)
        self.begin, self.count = _room(self.begin, size), _room(self.count, size)
        self.ids = _room(self.ids, total)
        self.begin[where] = self.used + np.cumsum(count) - count
        self.count[where] = count
        self.ids[self.used:total] = ids
        if offsets is not None:
            self.offsets = _room(self.offsets, total)
            self.offsets[self.used:total] = offsets
        self.used = total

    def places(self, where: np.ndarray) -> np.ndarray:
        """Positions in the store of all tokens of the numbered strings."""
        count = self.count[where]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        return np.arange(total) + np.repeat(self.begin[where] - (ends - count), count)


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    if isinstance(tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel):
        # offsets that include the leading space
        tokenizer.pre_tokenizer.trim_offsets = False
        tokenizer.post_processor = None
    return tokenizer


def _byte_alphabet() -> str:
    """The character that stands for each byte in a byte-level model; a space stays one."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    alphabet = [chr(b if b in shown else next(hidden)) for b in range(256)]
    return "".join(alphabet[:32] + [" "] + alphabet[33:])


BYTES = _byte_alphabet()


def _piece_tokenizer(tokenizer):
    """The same model for normalised pieces in ``BYTES``, joined by spaces."""
    from tokenizers import Tokenizer, pre_tokenizers

    pieces = Tokenizer(tokenizer.model)
    pieces.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
    return pieces


class PartEncoder:
    """Encodes texts with a memory of at most ``limit`` parts (and those of one call).

    ``spaced``: tokens may begin with white space, and offsets are kept.
    """

    def __init__(self, path: str, spaced: bool = False, limit: int = CACHED_PARTS):
        self.tokenizer, self.spaced, self.limit = _tokenizer(path), spaced, limit
        self.pieces = None if spaced else _piece_tokenizer(self.tokenizer)
        self.pattern = re.compile(SPACED if spaced else BARE)
        self.store = _Store(spaced)
        vocabulary = {} if spaced else self.tokenizer.get_vocab()
        # whether a token ends a piece
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _learn_chunks(self) -> None:
        first, new = self.store.queued()
        if new:
            found = self.tokenizer.encode_batch(new, add_special_tokens=False)
            count = np.fromiter((len(e.ids) for e in found), np.int64, len(new))
            ids = np.fromiter((i for e in found for i in e.ids), np.uint32, int(count.sum()))
            self.store.put(
                np.arange(first, first + len(new)), count, ids,
                np.array([o for e in found for o in e.offsets], np.int32).reshape(-1, 2) if self.spaced else None)

    def _learn_pieces(self) -> None:
        """Many pieces in one call: each ends with the token that closes a word."""
        first, new = self.store.queued()
        for start in range(0, len(new), JOINED):
            joined = new[start:start + JOINED]
            shown, _ = codecs.charmap_decode(" ".join(joined).encode(), "strict", BYTES)
            ids = np.array(self.pieces.encode_batch_fast(
                [shown], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(joined):
                raise ValueError("the tokenizer splits a piece")
            self.store.put(
                np.arange(first + start, first + start + len(joined)), np.diff(ends, prepend=0), ids)

    def _look_up(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.store.numbers.__getitem__, parts), np.int64, len(parts))

    def _forget(self) -> None:
        if len(self.store.numbers) > self.limit:
            self.store = _Store(self.spaced)

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (str or UTF-8 bytes) in a row, and the number of ids of each."""
        self._forget()
        texts = [t.decode() if isinstance(t, bytes) else t for t in texts]
        plain = [not self.spaced and PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        where: list = [None] * len(texts)
        for number, text in enumerate(texts):
            if plain[number]:
                where[number] = self._look_up(PIECE.findall(text.lower()))
        self._learn_pieces()
        for number, text in enumerate(texts):
            if not plain[number]:
                where[number] = self._look_up(self.pattern.findall(text))
        self._learn_chunks()
        sizes = np.fromiter(map(len, where), np.int64, len(where))
        parts = np.concatenate(where) if where else np.zeros(0, np.int64)
        tokens = np.concatenate(([0], np.cumsum(self.store.count[parts])))
        ends = np.cumsum(sizes)
        return self.store.ids[self.store.places(parts)], tokens[ends] - tokens[ends - sizes]

    def encode_offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one text and the (start, end) code points of each."""
        self._forget()
        chunks = self.pattern.findall(text)
        where = self._look_up(chunks)
        self._learn_chunks()
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        places = self.store.places(where)
        shift = np.repeat(np.cumsum(lengths) - lengths, self.store.count[where])
        return self.store.ids[places], self.store.offsets[places] + shift[:, None]


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if len(array) >= size:
        return array
    grown = np.zeros((max(size, 2 * len(array)), *array.shape[1:]), array.dtype)
    grown[:len(array)] = array
    return grown


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool = False) -> PartEncoder:
    """One encoder per Python worker and tokenizer, kept from task to task."""
    return PartEncoder(path, spaced)
