"""Terms of texts: maximal runs of bytes of a class, with only A-Z lower-cased. A byte of 128 or more belongs to every class, so a term is
a run of code points, whole ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import PIECE

_code = np.arange(256)
_LETTERS = ((_code | 32) >= 97) & ((_code | 32) <= 122) | (_code >= 128)
#: Bytes of `[^\x00-\x40\x5B-\x60\x7B-\x7F]`, and those with digits, `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]`.
LETTERS, ALNUM = _LETTERS, _LETTERS | (_code >= 48) & (_code <= 57)
#: A-Z to a-z, all else unchanged.
LOWER = np.where((_code >= 65) & (_code <= 90), _code + 32, _code).astype(np.uint8)


def spans(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each term begins and ends; no term crosses the beginning of a text, which ``at`` names. Works on windows, so memory
    beyond the result is bounded."""
    starts, ends, n = [], [], len(data)
    first = at[(at > 0) & (at < n)]
    for lo in range(0, n, PIECE):
        hi = min(n, lo + PIECE)
        wide = np.zeros(hi - lo + 2, bool)  # one byte more on both sides
        a, b = max(lo - 1, 0), min(hi + 1, n)
        wide[a - lo + 1 : b - lo + 1] = inside[data[a:b]]
        here = wide[1:-1]
        fresh = np.zeros(hi - lo + 1, bool)  # a text begins here
        fresh[first[np.searchsorted(first, lo) : np.searchsorted(first, hi, "right")] - lo] = True
        starts.append(np.flatnonzero(here & (~wide[:-2] | fresh[:-1])) + lo)
        ends.append(np.flatnonzero(here & (~wide[2:] | fresh[1:])) + lo + 1)
    none = np.zeros(0, np.int64)
    return np.concatenate(starts or [none]), np.concatenate(ends or [none])


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The lower-cased terms of ascending spans that do not overlap."""
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_utf8(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(LOWER[data[at]])])


def coded(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different terms, the number among them of each term in the texts, and the number of its text."""
    start, end = spans(data, at, inside)
    if not len(start):
        return pa.array([], pa.large_utf8()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = strings(data, start, end).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(at, start, "right") - 1
