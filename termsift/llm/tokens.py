"""Token ids of whole texts with a public tokenizer file, at a known memory bound.

A tokenizer first cuts a text into pieces, letters apart from punctuation, and then encodes each
piece by itself. Texts are cut here by the same rule, a piece goes to the tokenizer's model as it
is, and the ids of pieces are kept while they are in use. All of this only saves time: whatever is
not certain to be cut right (rare white space, letters beyond Latin-1) goes through the whole
tokenizer.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable

from tokenizers import Tokenizer

from termsift.llm.common import worker_tool

#: Pieces whose ids a Python worker keeps, some 60 MB. Half of them are the latest; when these are
#: full, they become the older half, and what was not used since then is forgotten.
CACHED_PIECES = 300_000

#: Longer ones are encoded each time.
_CACHED_LENGTH = 40

_LOWER = "a-zªµºß-öø-ÿ"
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_DIGITS = "0-9²³¹¼½¾"
_ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
_PLAIN = re.compile(r"[ \n!-~¡-ÿ]*")
_SPACED = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
_RARE_SPACE = re.compile(
    r"[\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿]"
)


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level models have for the UTF-8 bytes of each Latin-1 character."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [byte for byte in range(256) if byte not in plain]
    letters = {byte: chr(byte) for byte in plain} | {byte: chr(256 + k) for k, byte in enumerate(rest)}
    return {code: "".join(letters[byte] for byte in chr(code).encode()) for code in range(256)}


_BYTE_LETTERS = _byte_letters()


class _Bare:
    """For tokenizers that drop white space and case."""

    pieces = re.compile(rf"{_ENDINGS}|[{_LOWER}]+|[{_DIGITS}]|[^ \n{_LOWER}{_DIGITS}]+")

    def cut(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return self.pieces.findall(text.lower())
        words = [word.decode() for word in text.encode().split()]
        return [p for w in words for p in (self.cut(w) if _PLAIN.fullmatch(w) else [w])]


class _Spaced:
    """For byte-level tokenizers that keep a blank as a part of the word that follows."""

    pieces = re.compile(
        rf"{_ENDINGS}| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^ \n{_LETTERS}{_DIGITS}]+|[ \n]+(?![^ \n])|[ \n]+"
    )

    def cut(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return self.pieces.findall(text)
        if _RARE_SPACE.search(text):
            return [text]
        words = _SPACED.findall(text)
        return [p for w in words for p in (self.cut(w) if _PLAIN.fullmatch(w) else [w])]


_CUTS = {"bare": _Bare, "spaced": _Spaced}


class _Known(dict):
    """Ids by piece. Any piece can be asked for: one that is not there is encoded then."""

    def __init__(self, encoded: Callable[[str], bytes]):
        super().__init__()
        self.encoded = encoded
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encoded(piece)
        if len(piece) <= _CACHED_LENGTH:
            if 2 * len(self) >= CACHED_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encodes texts as little-endian unsigned 16-bit ids (every id must be below 65,536).

    ``cut`` is ``bare`` for tokenizers that drop white space, ``spaced`` for those that keep it. One
    that is not byte-level is found by trying every character, and then cuts each piece itself. The
    strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, cut: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("token ids do not fit into 16 bits")
        self.cut = _CUTS[cut]()
        self.known = _Known(lambda piece: self._ids([piece])[0])
        self.model = self.tokenizer.model
        trial = "\n".join(f"{c} {c}{c} a{c}" for c in map(chr, range(256)) if _PLAIN.fullmatch(c))
        trial = sorted(set(self.cut.cut(trial)))
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.by_model = all(token.special for token in added) and all(
            self._by_model(piece) == self._whole(piece) for piece in trial
        )

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes; a null text has none."""
        ids = self.known.__getitem__
        return [b"".join(map(ids, self.cut.cut(text))) if text else b"" for text in texts]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        out = []
        for piece in pieces:
            # a plain piece was cut by the tokenizer's own rule and has no further cut in it
            plain = self.by_model and _PLAIN.fullmatch(piece)
            ids = self._by_model(piece) if plain else self._whole(piece)
            out.append(struct.pack(f"<{len(ids)}H", *ids))
        return out

    def _by_model(self, piece: str) -> list[int]:
        return [token.id for token in self.model.tokenize(piece.translate(_BYTE_LETTERS))]

    def _whole(self, piece: str) -> list[int]:
        (found,) = self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)
        return found.ids


def encoder(path: str, cut: str) -> Encoder:
    """The encoder of a Python worker, loaded once."""
    return worker_tool((Encoder, path, cut), lambda: Encoder(path, cut))
