"""Encoding with a tokenizer whose pre-tokens never cross white space, each different part once.

``word_bpe_49k.json`` replaces white space by one space, splits at a pattern that never matches white space, and neither its
normal form nor its lower case looks across it. So ids of a text are the ids of its words (bytes between ASCII white space, which
is part of the pattern's white space) one after the other, and a word can be encoded alone and remembered. Its added tokens hold
no white space either. ``assert_independent`` checks this on the tokenizer's file.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np

from .common import RangeHash

WORD_BPE = "word_bpe_49k.json"
#: Parts that a worker remembers before it forgets those not used of late. Only speed depends on it.
REMEMBERED = 400_000


def assert_independent(path: str) -> None:
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    steps = [x["type"] for x in d["normalizer"]["normalizers"]]
    split = d["pre_tokenizer"]["pretokenizers"][0]
    if steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or split["behavior"] != "Removed" or not split["invert"]:
        raise ValueError("words cannot be encoded one by one with this tokenizer")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or len(t["content"].split()) != 1 for t in d["added_tokens"]):
        raise ValueError("an added token reaches beyond a word")


class _Memo(dict):
    """Key to a number, and per number its ids in one flat array. ``old`` is the memo before: what is still used moves over, what is not
    used again is forgotten with it, so frequent keys stay however many rare ones pass."""

    def __init__(self, encode, old: "_Memo | None" = None):
        super().__init__()
        self.encode, self.old = encode, old
        self.ids, self.starts = array("I"), array("q", [0])
        if old is not None:
            old.old = None

    def __missing__(self, key: bytes | str) -> int:
        old = self.old
        if old is not None and (k := old.get(key)) is not None:
            self.ids.extend(old.ids[old.starts[k] : old.starts[k + 1]])
        else:
            self.ids.extend(self.encode(key))
        self.starts.append(len(self.ids))
        self[key] = n = len(self)
        return n

    def renewed(self) -> "_Memo":
        return _Memo(self.encode, self) if len(self) > REMEMBERED else self


def _by_class(name: str) -> bytes:
    """Latin-1 characters of a general category, escaped for a character class."""
    return b"".join(b"\\x%02x" % c for c in range(256) if unicodedata.category(chr(c))[0] == name)


#: The tokenizer's split pattern on lower-cased Latin-1 text, and that lower case: both keep to one byte a character.
_SPACE = rb"\x09-\x0d\x20\x85\xa0"
_PARTS = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[%(L)s]+|[%(N)s]|[^%(S)s%(L)s%(N)s]+" % {b"L": _by_class("L"), b"N": _by_class("N"), b"S": _SPACE})
_LOWER = bytes(ord(chr(c).lower()) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 256 else c for c in range(256))

#: Space, letter, number, other.
_CLASS = np.array([0 if re.match(b"[" + _SPACE + b"]", bytes([c])) else {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3) for c in range(256)], np.uint8)
#: Longest text that is cut together with others.
_TOGETHER = 4 << 20
_part_hash = RangeHash(41)


def _byte_letters() -> dict[int, int]:
    """The rule of byte-level vocabularies: printable bytes stand for themselves, the others for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of texts by parts. A Latin-1 text without the beginning of an added token is its own normal form but for the lower case,
    so its parts are the matches of the split pattern, merged by the library's model; a part is merged once and remembered.
    The words of any other text are encoded by the library as they are, and remembered too."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        assert_independent(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.memo = _Memo(self._encode)

    def _encode(self, key: bytes | str) -> list[int]:
        if isinstance(key, str):
            return self.tokenizer.encode(key, add_special_tokens=False).ids
        return [t.id for t in self.model.tokenize(key.decode("latin-1").encode().decode("latin-1").translate(self.letters))]

    @staticmethod
    def keys(raw: bytes) -> list[bytes] | list[str]:
        """The parts of a text (bytes), or its words (str) where parts cannot be told."""
        try:
            if b"<|" not in raw:
                return _PARTS.findall(raw.decode().encode("latin-1").translate(_LOWER))
        except UnicodeError:
            pass
        return [w.decode("utf-8", "replace") for w in raw.split()]

    def numbered_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the parts of all texts, one text after the other, for ``lengths`` and ``flat`` until the next call; and the number
        of parts of each text.

        Most texts (Latin-1, no apostrophe, which the pattern treats apart) are cut at changes of the character class, all at once;
        each different part of them is looked up once.
        """
        self.memo = self.memo.renewed()
        plain, at, found = [], [], [None] * len(texts)
        for i, raw in enumerate(texts):
            try:
                if len(raw) > _TOGETHER or b"<|" in raw or b"'" in raw:
                    raise UnicodeError
                plain.append(raw.decode().encode("latin-1"))
                at.append(i)
            except UnicodeError:
                keys = self.keys(raw)
                found[i] = np.fromiter(map(self.memo.__getitem__, keys), np.int64, len(keys))
        if plain:
            text = b" ".join(plain).translate(_LOWER)
            data = np.frombuffer(text, np.uint8)
            kind = _CLASS[data]
            edge = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | (kind[1:] == 2), [True]))) if len(data) else np.zeros(1, np.int64)
            start, end = edge[:-1], edge[1:]
            part = kind[start] != 0
            start, end = start[part], end[part]
            _, first, inverse = np.unique(_part_hash.load(data).ranges(start, end), return_index=True, return_inverse=True)
            keys = [text[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            number = np.fromiter(map(self.memo.__getitem__, keys), np.int64, len(keys))[inverse]
            begin = np.cumsum([0, *(len(p) + 1 for p in plain)])
            for i, x in zip(at, np.split(number, np.searchsorted(start, begin[1:-1])), strict=True):
                found[i] = x
        return (np.concatenate(found) if found else np.zeros(0, np.int64)), np.array([len(x) for x in found], np.int64)

    def numbered(self, keys: list) -> np.ndarray:
        """Number of each key, for ``lengths`` and ``flat``, until the next call."""
        self.memo = self.memo.renewed()
        return np.fromiter(map(self.memo.__getitem__, keys), np.int64, len(keys))

    def lengths(self, numbers: np.ndarray) -> np.ndarray:
        starts = np.frombuffer(self.memo.starts, np.int64)
        return starts[numbers + 1] - starts[numbers]

    def flat(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of the keys, one after the other."""
        n = self.lengths(numbers)
        if not n.sum():
            return np.zeros(0, np.uint32)
        end = np.cumsum(n)
        at = np.repeat(np.frombuffer(self.memo.starts, np.int64)[numbers] - end + n, n) + np.arange(end[-1])
        return np.frombuffer(self.memo.ids, np.uint32)[at]


_encoders: dict[str, WordEncoder] = {}


def encoder(name: str = WORD_BPE) -> WordEncoder:
    """The worker's encoder; ``name`` is a file of public_tokenizers or a path."""
    if name not in _encoders:
        import public_tokenizers

        _encoders[name] = WordEncoder(name if os.path.sep in name else public_tokenizers.path(name))
    return _encoders[name]
