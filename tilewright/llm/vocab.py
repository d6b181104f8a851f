"""Vocabulary files of the ``tokenizers`` library and the cache that encoding runs through."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path

import numpy as np

from . import common

#: Entries of one generation of a cache (there are two), and the longest string that is cached.
CACHE_ENTRIES, CACHE_CHARS = 500_000, 48


def path(name_or_path: str) -> str:
    """The place of a vocabulary file: a path, or the name of one of the public tokenizers."""
    if Path(name_or_path).exists():
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def read(name_or_path: str) -> str:
    """The file's text; the driver reads it and ships it to the executors."""
    return Path(path(name_or_path)).read_text(encoding="utf-8")


def tokenizer(text: str):
    """The library's tokenizer for a vocabulary file's text, without truncation and padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(text)
    t.no_truncation()
    t.no_padding()
    return t


#: The one way of splitting for which a text in Latin-1 is cut into pieces here.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: The same over lower-case Latin-1.
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
#: Control characters, on whose being white space the two patterns may differ.
_CONTROLS = bytes(c for c in (*range(32), *range(127, 161)) if c not in b"\t\n\r")


def splits_plainly(text: str) -> bool:
    """Whether a vocabulary file normalises and splits in the way that ``_PIECE`` knows."""
    whole = json.loads(text)
    steps = lambda part, key: (whole.get(part) or {}).get(key) or [whole.get(part) or {}]
    normal = [s.get("type") for s in steps("normalizer", "normalizers")]
    split = steps("pre_tokenizer", "pretokenizers")
    return normal == ["NFC", "Replace", "Lowercase"] and [s.get("type") for s in split] == ["Split", "ByteLevel"] and split[0].get("pattern") == {"Regex": _SPLIT} and split[0].get("invert") is True and not split[1].get("use_regex") and not split[1].get("add_prefix_space")


class Chunks(dict):
    """Ids, as bytes, of each piece of text.

    White space never lies inside a token of such a vocabulary, so a text's ids are those of its chunks
    between blanks in turn, and, where ``plain`` holds, those of the pieces it is split into anyway. A miss is
    computed by ``__missing__``, so that ``map(chunks.__getitem__, ...)`` runs without Python code for hits.
    A full cache becomes the old generation, from which what is used again is taken over.
    """

    def __init__(self, encode: Callable[[str], list[int]], dtype: str, plain: bool, added: tuple[str, ...]):
        super().__init__()
        self.encode, self.dtype, self.plain, self.added, self.old = encode, np.dtype(dtype), plain, added, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = np.array(self.encode(piece), dtype=self.dtype).tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got

    def pieces(self, text: str) -> list[str]:
        if self.plain:
            try:
                raw = text.encode("latin-1")
            except UnicodeEncodeError:
                raw = None
            if raw is not None and len(raw.translate(None, _CONTROLS)) == len(raw) and not any(a in text for a in self.added):
                return _PIECE.findall(text.lower())
        return text.replace("\n", " ").split(" ")

    def text(self, text: str | None) -> bytes:
        """Ids of a whole text; null counts as empty."""
        return b"".join(map(self.__getitem__, self.pieces(text))) if text else b""


class Counts(Chunks):
    """The number of ids of each piece of text, where ids themselves aren't needed: small numbers instead of bytes."""

    def __missing__(self, piece: str) -> int:
        got = self.old.get(piece)
        if got is None:
            got = len(self.encode(piece))
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES // 2:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got

    def count(self, text: str | None) -> int:
        """The number of ids of a whole text; null counts as empty."""
        return sum(map(self.__getitem__, self.pieces(text))) if text else 0


_made: dict[tuple, Chunks] = {}
common.cached(__name__, _made.clear)


def chunks(text: str, encode: Callable[[str], list[int]], dtype: str) -> Chunks:
    return Chunks(encode, dtype, splits_plainly(text), tuple(a["content"] for a in json.loads(text).get("added_tokens") or []))


def library_counts(text: str) -> Counts:
    """Ids of pieces counted by the library; one cache for each vocabulary in a Python worker."""
    common.begin(__name__)
    key = ("counts", text)
    if key not in _made:
        encode = tokenizer(text).encode
        _made[key] = Counts(lambda s: encode(s, add_special_tokens=False).ids, "<u4", splits_plainly(text), tuple(a["content"] for a in json.loads(text).get("added_tokens") or []))
    return _made[key]


def library_chunks(text: str, dtype: str = "<u2") -> Chunks:
    """Pieces encoded by the library; one cache for each vocabulary in a Python worker."""
    common.begin(__name__)
    key = ("library", text, dtype)
    if key not in _made:
        encode = tokenizer(text).encode
        _made[key] = chunks(text, lambda s: encode(s, add_special_tokens=False).ids, dtype)
    return _made[key]
