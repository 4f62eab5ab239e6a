"""What the corpus operators share: reading documents, Arrow columns as arrays, hashes of byte ranges, stored tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import scratch_dir, stored  # noqa: F401

U = np.uint64
#: Bytes of text that a worker turns into arrays at a time. Only memory depends on it, never a result.
PIECE = 1 << 20
#: The ASCII white space of the contracts, \x20 and \x09 to \x0D.
SPACES = b" \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Whole documents table; only the named columns are read."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, one text after the other, and where each begins (one entry more than rows). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``limit`` bytes of text each, or one row."""
    at = utf8(batch.column(column))[1]
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed << 20)) * U(0x9E3779B97F4A7C15))


class RangeHash:
    """Hashes of any byte ranges of one array in constant time each: prefix sums of a polynomial modulo 2**64 over random
    byte values, finalised by ``mix``. Equal ranges have equal hashes wherever they stand."""

    def __init__(self, seed: int = 1, lower: bool = False):
        table = constants(seed, 256)
        if lower:
            table[65:91] = table[97:123]
        self.table, self.base = table, int(constants(seed + 1000, 1)[0]) & ~7 | 5
        self.up = self.down = np.ones(1, U)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n, PIECE + 2048)
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                x = np.full(n + 1, base, U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def load(self, data: np.ndarray) -> "RangeHash":
        n = len(data)
        self._powers(n)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(self.table[data] * self.up[:n], out=self.sums[1:])
        return self

    def runs(self, width: int) -> np.ndarray:
        """Hash of the ``width`` bytes from each position that has so many."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


_is_space = np.zeros(256, bool)
_is_space[list(SPACES)] = True
_word_hash = RangeHash(7, lower=True)


def words(data: np.ndarray, at: np.ndarray, between: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (bytes between ASCII white space, A-Z lower-cased), and the number of words of each text.
    ``between``: another table of the bytes that separate words."""
    apart = _is_space if between is None else between
    n, hashes, starts = len(data), [], []
    lo = 0
    while lo < n:
        hi = min(n, lo + PIECE)
        while hi < n:  # cut at a white space or a new text
            blank = np.flatnonzero(apart[data[lo:hi]])
            cut = max(lo + int(blank[-1]) + 1 if len(blank) else 0, int(at[np.searchsorted(at, hi, "right") - 1]))
            if cut > lo:
                hi = cut
                break
            hi = min(n, hi + PIECE)
        part = data[lo:hi]
        inside = ~apart[part]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        first = at[np.searchsorted(at, lo) : np.searchsorted(at, hi)] - lo
        begin[first] = inside[first]
        s = np.flatnonzero(begin)
        stop = ~inside
        stop = np.append(stop, True)
        stop[first] = True
        e = np.flatnonzero(stop)
        e = e[np.searchsorted(e, s, "right")] if len(s) else s
        hashes.append(_word_hash.load(part).ranges(s, e))
        starts.append(s + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, U), np.zeros(len(at) - 1, np.int64)
    where = np.concatenate(starts)
    return np.concatenate(hashes), np.diff(np.searchsorted(where, at))


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list column out of concatenated values and the number of them in each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values))


def sums_per(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each run values[at[i]:at[i + 1]]."""
    c = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return c[at[1:]] - c[at[:-1]]


def grouped(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """All pieces of all batches."""
    for batch in batches:
        if batch.num_rows:
            yield from pieces(batch, column, limit)
