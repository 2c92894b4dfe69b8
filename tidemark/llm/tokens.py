"""Byte-level BPE over a published vocabulary file, for use inside tasks."""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import tiktoken

#: The pre-tokenising pattern that goes with this vocabulary family.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Words in each generation of a worker's word table. Results don't depend on it.
MEMORY = 1 << 19

_ODD_SPACE = re.compile(r" (?:\s|\Z)")
_WORD_START = re.compile(r" (?=\S)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read_vocabulary(path: str | None = None) -> str:
    """The vocabulary file as text: read once by the driver, its size is that of the file."""
    with open(path or default_vocabulary(), encoding="utf-8") as file:
        return file.read()


def _byte_of() -> dict[str, int]:
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Words(dict):
    """Distinct-word table: a word's ids (little-endian unsigned 32-bit) on first use, then by look-up.

    Two generations bound its size: when the young one is full it becomes the old one, from which
    words still in use come back.
    """

    def __init__(self, encode, prefix: str):
        super().__init__()
        self.encode, self.prefix, self.old = encode, prefix, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = array("I", self.encode(self.prefix + word)).tobytes()
        self[word] = ids
        return ids

    def age(self) -> None:
        if len(self) > MEMORY:
            self.old = dict(self)
            self.clear()


class Bpe:
    """Encoder and decoder; equal to the tokenizers library on the same file.

    A text is cut before each space that a non-space follows: there the pattern always starts a
    new token, so the parts ("words") encode independently of their surroundings.
    """

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        table = _byte_of()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {}
        self.pieces = [b""] * (1 + max([*spec["model"]["vocab"].values(), *special.values()]))
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                ranks[bytes(table[c] for c in token)] = i
        for piece, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.pieces[i] = piece
        self.tokenizer = tiktoken.Encoding(
            "vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
        self.special = tuple(special)
        self.inner = _Words(self.tokenizer.encode_ordinary, " ")
        self.first = _Words(self.tokenizer.encode_ordinary, "")

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; null counts as empty."""
        if not text:
            return b""
        if any(x in text for x in self.special):
            return array("I", self.tokenizer.encode(text, allowed_special="all")).tobytes()
        parts = _WORD_START.split(text) if _ODD_SPACE.search(text) else text.split(" ")
        ids = self.first[parts[0]] + b"".join(map(self.inner.__getitem__, parts[1:]))
        self.inner.age()
        self.first.age()
        return ids

    def decode(self, ids: list[int]) -> str:
        """Joins each id to its piece; special tokens are kept."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def load(vocabulary: str) -> Bpe:
    """One encoder for each worker and vocabulary."""
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(vocabulary)
    return _LOADED[key]
