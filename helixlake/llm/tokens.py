"""Token ids of whole texts, encoded piece by piece with a cache of pieces.

The tokenizers in use never join characters across a space or line feed: their normalizers and pre-tokenizers cut
there.  So a text's ids are those of its pieces between blanks, one after the other, and a piece that was seen before
needs no encoding.  Pieces of Latin letters, digits and ASCII signs are cut into words here and given to the tokenizer's
model; all others, and those that may hold a special token, go through the whole tokenizer.  `pieces_are_safe` checks a
tokenizer file for what this relies on; texts of other tokenizers are encoded whole.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

TOKENIZER = "word_bpe_49k.json"
#: Pieces kept by each Python worker, and where other work needs its memory; beyond, the cache starts anew.
CACHE, SMALL_CACHE = 500_000, 150_000
#: Longer pieces (in bytes) are not kept.
LONG_PIECE = 64
#: The pre-tokenizer's pattern that is known here: a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = "À-ÖØ-öø-įı-ž"
PLAIN_PIECE = re.compile(f"[!-~{_LATIN}]+")
PLAIN_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+")


def pieces_are_safe(path: str) -> bool:
    """Whether the tokenizer's normalizer and pre-tokenizer are those that cutting at blanks is right for."""
    with open(path) as file:
        config = json.load(file)
    normal = (config.get("normalizer") or {}).get("normalizers", [])
    steps = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [n["type"] for n in normal] != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in steps] != ["Split", "ByteLevel"]:
        return False
    split, byte = steps
    return (
        (normal[1]["pattern"], normal[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and (split["pattern"], split["behavior"], split["invert"]) == ({"Regex": SPLIT}, "Removed", True)
        and not byte["add_prefix_space"]
        and not byte["use_regex"]
        and config.get("post_processor") is None
        and all("<|" in t["content"] and not t["lstrip"] and not t["rstrip"] for t in config["added_tokens"])
    )


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Words(dict):
    """The ids of words that pieces of plain letters are made of."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, byte_letters()

    def __missing__(self, word: str) -> bytes:
        own = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = np.array([t.id for t in self.model.tokenize(own)], dtype="<u4").tobytes()
        if len(self) >= SMALL_CACHE:
            self.clear()
        if len(word) <= LONG_PIECE:
            self[word] = ids
        return ids


class Encoder(dict):
    """Encodes UTF-8 texts to little-endian unsigned 32-bit ids; the dictionary holds the ids of pieces."""

    def __init__(self, name: str, cache: int = CACHE):
        super().__init__()
        self.most = cache
        path = name if os.path.sep in name else public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.words = Words(self.tokenizer.model)
        self.safe = pieces_are_safe(path)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, piece: bytes) -> bytes:
        text = piece.decode()
        if not PLAIN_PIECE.fullmatch(text) or "<|" in text:
            ids = self.whole(text)
        else:
            ids = b"".join(map(self.words.__getitem__, PLAIN_SPLIT.findall(text.lower())))
        if len(piece) <= LONG_PIECE:
            self[piece] = ids
        return ids

    def pieces(self, data: bytes) -> list[bytes]:
        """The ids of each piece between spaces and line feeds, in order."""
        if len(self) > self.most:
            self.clear()
        return list(map(self.__getitem__, data.replace(b"\n", b" ").split(b" ")))

    def ids(self, data: bytes) -> bytes:
        return b"".join(self.pieces(data)) if self.safe else self.whole(data.decode())


@functools.cache
def encoder(name: str = TOKENIZER, cache: int = CACHE) -> Encoder:
    """One encoder for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(name, cache)
