"""Token ids by the tokenizers library, fast enough for whole corpora.

Both vocabularies cut a text into pieces and encode each piece by itself. A piece is encoded
once by the library and remembered, so that a corpus costs its distinct pieces. Only texts of
plain Latin characters take this way, for which the cut is written out below; every other text, and
any that holds an added token, goes to the library as a whole. The ids are the same either way.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np

#: Characters whose class is the same for every library: white space, ASCII and Latin up to U+024F
#: (without U+0130, whose lower case has two characters).
PLAIN = re.compile("[\t\n\r -~¡-¬®-įı-ɏ]*")
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
#: The pieces of the two published vocabularies, over those characters.
SPACED = rf" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"
UNSPACED = rf"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+"
#: Pieces and characters remembered at most; then the memory starts anew.
REMEMBERED, REMEMBERED_CHARACTERS = 1 << 19, 1 << 22

#: Byte-level vocabularies write each byte as a visible character: itself, or the next one from U+0100 on.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTER_OF = {b: 0x100 + n for n, b in enumerate(b for b in range(256) if b not in _VISIBLE)}

_encoders: dict[str, "Encoder"] = {}


class _Memo(dict):
    """Piece to its number; new pieces are noted."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.fresh.append(piece)
        n = self[piece] = len(self)
        return n


def byte_letters(piece: str) -> str:
    """A piece in the characters that byte-level vocabularies are written in."""
    return piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(_LETTER_OF)


class Encoder:
    """Encodes batches of texts with one vocabulary file, as the library does without adding special tokens; those written in a text get their ids."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark keeps the cores busy
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.whole = Tokenizer.from_file(path)
        cut = json.dumps(spec["pre_tokenizer"])
        self.lower = "Lowercase" in json.dumps(spec["normalizer"])
        self.cut: Callable[[str], list[str]] | None = None
        if '"ByteLevel"' in cut and '"use_regex": true' in cut and spec["normalizer"] is None:
            self.cut = re.compile(SPACED).findall
        elif r"[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in cut and '"Removed"' in cut and self.lower:
            self.cut = re.compile(UNSPACED).findall
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.model = self.whole.model
        self._forget()

    def _forget(self) -> None:
        self.memo, self.ids, self.characters = _Memo(), np.empty(0, np.uint32), 0
        self.starts = self.lens = np.empty(0, np.int64)

    def _learn(self) -> None:
        fresh, self.memo.fresh = self.memo.fresh, []
        if fresh:
            self.characters += sum(map(len, fresh))
            tokenize = self.model.tokenize
            found = [[x.id for x in tokenize(byte_letters(p))] for p in fresh]
            lens = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.uint32, int(lens.sum()))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lens) - lens])
            self.lens, self.ids = np.concatenate([self.lens, lens]), np.concatenate([self.ids, ids])

    def _holds_added(self, text: str) -> bool:
        lower = text.lower() if self.lower else text
        return any(x in text or x in lower for x in self.added)

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        if len(self.memo) > REMEMBERED or self.characters > REMEMBERED_CHARACTERS:
            self._forget()
        cut, memo, look = self.cut, self.memo, []
        odd: dict[int, str] = {}
        for i, t in enumerate(texts):
            t = t or ""
            if cut is None or PLAIN.fullmatch(t) is None or self._holds_added(t):
                odd[i], t = t, ""
            pieces = cut(t.lower() if self.lower else t) if t else ()
            look.append(np.fromiter(map(memo.__getitem__, pieces), np.int64, len(pieces)))
        self._learn()
        out = []
        for at in look:
            lens = self.lens[at]
            ends = np.cumsum(lens)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.ids[np.repeat(self.starts[at] - ends + lens, lens) + np.arange(total)])
        for i, x in zip(odd, self.whole.encode_batch(list(odd.values()), add_special_tokens=False), strict=True):
            out[i] = np.asarray(x.ids, np.uint32)
        return out


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
