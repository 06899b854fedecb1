"""Token ids of texts by a public tokenizer file, with each piece of text encoded once per worker."""

from __future__ import annotations

import functools
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
END_ID = 1
CACHE_PIECES = 400_000  # of at most LONG_PIECE characters: some 70 MB a worker
LONG_PIECE = 64
LATIN = 0x100  # code points below are Latin-1: there lower case and normal form go letter by letter
SLICE_CHARS = 1 << 20
#: White space as the tokenizers library's patterns know it (fixed values).
SPACE = r"\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def text_slices(column: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a column in order, about a million characters (one text at least) at a time."""
    part: list[str | None] = []
    size = 0
    for i in range(len(column)):
        part.append(column[i].as_py())
        size += len(part[-1] or "")
        if size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _class(pattern: str) -> str:
    """The characters below LATIN that match ``pattern``, as ranges of a character class."""
    codes = [c for c in range(LATIN) if regex.match(pattern, chr(c))]
    ranges = [[codes[0], codes[0]]]
    for c in codes[1:]:
        if c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where it is
    printable Latin-1, else the next unused code point from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Pieces(dict):
    """Ids of single pieces by the library's merges alone, kept once asked for: a piece needs no more cutting."""

    def __init__(self, model):
        super().__init__()
        self.model = model
        self.letters = dict(enumerate(byte_letters()))

    def __missing__(self, piece: str) -> bytes:
        text = piece
        if not (piece.isascii() and piece.isprintable()):  # bytes as the letters that stand for them
            text = piece.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [token.id for token in self.model.tokenize(text)]).tobytes()
        if len(piece) <= LONG_PIECE:
            self[piece] = ids
        return ids


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers.

    Where a tokenizer cuts lower-cased text by the pattern ``PIECES`` into byte-level pieces and drops white
    space, texts in Latin-1 are cut likewise, and the library merges each different piece once.  Texts with
    other characters or special strings, and other tokenizers, get the library's call on whole texts.
    """

    #: Fixed value: the pattern by which the public word vocabulary cuts texts.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        cuts = [p["pattern"].get("Regex") for p in (config["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        lower = "Lowercase" in [n["type"] for n in (config["normalizer"] or {}).get("normalizers", [])]
        kinds = [p["type"] for p in (config["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_piece = (
            sys.byteorder == "little" and cuts == [self.PIECES] and kinds == ["Split", "ByteLevel"] and lower
            and not any(self._ids([" ", "\n", " \n "])))
        if self.by_piece:
            letters, digits = _class(r"\p{L}"), _class(r"\p{N}")
            self.cut = re.compile(f"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{digits}]|[^{SPACE}{letters}{digits}]+").findall
            self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
            self.pieces = Pieces(self.tokenizer.model)

    def _ids(self, texts: Sequence[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def odd(self, text: str) -> bool:
        """Whether a text has characters outside Latin-1 or special strings."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return True
        return any(s in text for s in self.special)

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        whole = [t or "" for t in texts]
        if not self.by_piece:
            return self._ids(whole)
        odd = [i for i, t in enumerate(whole) if self.odd(t)]
        skip = set(odd)
        cut = [[] if i in skip else self.cut(t.lower()) for i, t in enumerate(whole)]
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        out = [b"".join(map(self.pieces.__getitem__, parts)) for parts in cut]
        for i, ids in zip(odd, self._ids([whole[i] for i in odd]), strict=True):
            out[i] = ids
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder and its cache for each worker process."""
    return Encoder(path)


def public_file(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
