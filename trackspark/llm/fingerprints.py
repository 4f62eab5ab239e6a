"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes ends a chunk where its lowest bits are zero: k zero bits at block size 2^k, so the boundaries of
a block size are some of those of half that size. A text's block size is the least, from 4 on, with fewer than 64 boundaries, counted and
not guessed from the length, so periodic texts have short signatures, too. A chunk is two characters of its hash (12 bits), and a fingerprint
is "block size:signature:signature at twice the block size". Since boundaries depend on seven bytes only, an edit changes the chunks it
touches and no others.

Likeness of two fingerprints, 0 to 1: their signatures are compared at a block size that both have (the same, or one twice the other)
by edit distance with insertions and deletions, over the sum of their lengths; the better of two where the block sizes are equal. Without
a common block size it is 0. Equal texts have equal fingerprints and a likeness of 1, also empty ones.

``with_next`` deals texts out in ranges of their order by keys alone: ids and hashes are sorted first, the first key of each range goes to
the driver (one for each shard), and each range also receives the first text of the next one. So texts are shuffled once and no window
runs over all of them. Equal (doc_id, text) rows may be dealt over several ranges; they are interchangeable.

Null text counts as empty. Rows are ordered by doc_id, null last, those that share one by a hash of their text; each row has its own
result. The last row is followed by the first; a single row follows itself. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import discard
from .common import PIECE, U, constants, documents, grouped, stored, utf8

WINDOW, LEAST, CHUNKS = 7, 2, 64
#: Text bytes that a range of ``with_next`` holds on average, where there are more than the session's shuffle partitions can take.
SHARD = 256 << 20
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_VALUE = np.zeros(256, np.uint16)
_VALUE[_LETTERS] = np.arange(64)
_byte = (constants(81, 256) >> U(32)).astype(np.uint32)
_turn = (constants(82, WINDOW) >> U(32)).astype(np.uint32) | np.uint32(1)


class Prints(NamedTuple):
    """Fingerprints in columns: log2 of the block size, and both signatures as matrices of chunk codes with their lengths."""

    level: np.ndarray
    first: np.ndarray
    n_first: np.ndarray
    second: np.ndarray
    n_second: np.ndarray

    def take(self, rows: np.ndarray) -> "Prints":
        return Prints(*(x[rows] for x in self))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _rolling(part: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW bytes that end at each byte from the seventh on."""
    values, n = _byte[part], len(part) - WINDOW + 1
    h = np.zeros(n, np.uint32)
    for j in range(WINDOW):
        h += values[j : j + n] * _turn[j]
    return _mixed(h)


def prints(data: np.ndarray, at: np.ndarray) -> Prints:
    """Fingerprints of concatenated texts. Zero bytes stand before each text, so its first bytes have windows, too."""
    m, size = len(at) - 1, np.diff(at)
    pad = WINDOW - 1
    padded = np.zeros(len(data) + pad * m, np.uint8)
    begin = at[:-1] + pad * np.arange(1, m + 1)
    for a, b, o in zip(at[:-1].tolist(), at[1:].tolist(), begin.tolist(), strict=True):
        padded[o : o + b - a] = data[a:b]
    where, level, sums, total = [], [], [], U(0)
    edge = np.concatenate((begin, begin + size))  # the running sum is also needed where texts begin and end
    edge_sum, order = np.zeros(2 * m, U), np.argsort(edge, kind="stable")
    edge, done = edge[order], 0
    for lo in range(pad, len(padded), PIECE):
        hi = min(len(padded), lo + PIECE)
        h = _rolling(padded[lo - pad : hi])
        run = np.cumsum(_mixed(h + np.uint32(0x9E3779B9)).astype(U)) + total  # sum up to and including each byte
        upto = int(np.searchsorted(edge, hi, "right"))
        here = edge[done:upto]
        edge_sum[order[done:upto]] = np.where(here > lo, run[np.maximum(here - lo - 1, 0)], total)
        done, total = upto, run[-1]
        cut = np.flatnonzero(h & np.uint32((1 << LEAST) - 1) == 0)
        low = h[cut] & (~h[cut] + np.uint32(1))
        where.append(cut + lo + 1)  # a chunk ends before this
        level.append(np.bitwise_count(low - np.uint32(1)))  # 32 where the hash is zero
        sums.append(run[cut])
    none = np.zeros(0, np.int64)
    where, level, sums = np.concatenate(where or [none]), np.concatenate(level or [none]).astype(np.int64), np.concatenate(sums or [none.astype(U)])
    text = np.searchsorted(begin, where, "left") - 1
    end = begin + size
    inside = (text >= 0) & (where <= end[np.maximum(text, 0)]) if m else np.zeros(0, bool)
    where, level, sums, text = (x[inside] for x in (where, level, sums, text))
    counts = np.bincount(text * 34 + level, minlength=34 * m).reshape(m, 34)[:, ::-1].cumsum(axis=1)[:, ::-1]
    few = counts < CHUNKS  # at level 33 there is no boundary
    few[:, :LEAST] = False
    chosen = few.argmax(axis=1)
    signatures = []
    for more in (0, 1):
        keep = level >= chosen[text] + more
        t = np.concatenate((text[keep], np.arange(m)))
        stop = np.concatenate((where[keep], end))
        value = np.concatenate((sums[keep], edge_sum[m:]))
        by = np.lexsort((stop, t))
        t, stop, value = t[by], stop[by], value[by]
        fresh = np.ones(len(t), bool)
        fresh[1:] = t[1:] != t[:-1]
        before = np.where(fresh, begin[t], np.append(0, stop)[:-1])
        code = value - np.where(fresh, edge_sum[:m][t], np.append(U(0), value)[:-1])
        real = stop > before
        t, code = t[real], code[real]
        number = np.arange(len(t)) - np.searchsorted(t, t)
        codes = np.zeros((m, CHUNKS), np.uint16)
        codes[t, number] = (_mixed((code ^ (code >> U(32))).astype(np.uint32)) >> np.uint32(20)).astype(np.uint16)
        signatures += [codes, np.bincount(t, minlength=m)]
    return Prints(chosen, *signatures)


def spelled(p: Prints) -> list[str]:
    """Fingerprints as strings."""
    letters = [np.stack([_LETTERS[codes >> 6], _LETTERS[codes & 63]], axis=2).reshape(len(codes), -1) for codes in (p.first, p.second)]
    return [f"{1 << k}:{a[: 2 * x].tobytes().decode()}:{b[: 2 * y].tobytes().decode()}"
            for k, a, x, b, y in zip(p.level.tolist(), letters[0], p.n_first.tolist(), letters[1], p.n_second.tolist(), strict=True)]


def parsed(texts: list[str]) -> Prints:
    """The inverse of ``spelled``."""
    m = len(texts)
    out = Prints(np.zeros(m, np.int64), *(x for _ in range(2) for x in (np.zeros((m, CHUNKS), np.uint16), np.zeros(m, np.int64))))
    for i, text in enumerate(texts):
        block, *parts = text.split(":")
        out.level[i] = int(block).bit_length() - 1
        for part, codes, n in zip(parts, (out.first, out.second), (out.n_first, out.n_second), strict=True):
            value = _VALUE[np.frombuffer(part.encode(), np.uint8)]
            n[i] = len(value) // 2
            codes[i, : n[i]] = value[::2] << 6 | value[1::2]
    return out


def _same(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """1 - (insertions and deletions) / (sum of lengths) for each pair of signatures: a longest common subsequence by bit vectors, all pairs at once."""
    column = np.arange(CHUNKS)
    a = np.where(column < n_a[:, None], a, 0xFFFF)
    b = np.where(column < n_b[:, None], b, 0xFFFE)
    open_ = np.full(len(a), ~U(0))
    for j in range(int(n_b.max(initial=0))):
        match = np.packbits(a == b[:, j : j + 1], axis=1, bitorder="little").view(U).ravel()
        open_ = (open_ + (open_ & match)) | (open_ & ~match)
    total = n_a + n_b
    return np.where(total == 0, 1.0, 2.0 * np.bitwise_count(~open_) / np.maximum(total, 1))


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """Likeness of each pair of fingerprints."""
    step = b.level - a.level
    low, high = (step == 1)[:, None], (step == -1)[:, None]
    one = _same(np.where(low, a.second, a.first), np.where(low[:, 0], a.n_second, a.n_first), np.where(high, b.second, b.first), np.where(high[:, 0], b.n_second, b.n_first))
    out = np.where(np.abs(step) <= 1, one, 0.0)
    even = np.flatnonzero(step == 0)
    out[even] = np.maximum(out[even], _same(a.second[even], a.n_second[even], b.second[even], b.n_second[even]))
    return out


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every text; no shuffle."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in grouped(batches):
            yield pa.record_batch([piece.column("doc_id"), pa.array(spelled(prints(*utf8(piece.column("text")))), pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(rows, docs.select("doc_id", F.lit("").alias("fingerprint")).schema)


def compared(pairs: DataFrame, a: str = "fingerprint", b: str = "other") -> DataFrame:
    """``pairs`` with a column ``near``, the likeness of two columns of fingerprints; null where one is null."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [batch.column(c).to_pylist() for c in (a, b)]
            known = [i for i, (x, y) in enumerate(zip(*both, strict=True)) if x is not None and y is not None]
            near = np.full(batch.num_rows, np.nan)
            near[known] = likeness(*(parsed([c[i] for i in known]) for c in both))
            yield batch.append_column("near", pa.array(near, mask=np.isnan(near)))

    return pairs.mapInArrow(rows, T.StructType([*pairs.schema.fields, T.StructField("near", T.DoubleType())]))


class Follower(NamedTuple):
    """Rows of a range with their followers: ids, texts (one more than ids, the last being the follower of the last row)."""

    ids: pa.Array
    texts: pa.Array


def with_next(docs: DataFrame, work: Callable[[Iterator[Follower]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``work`` on the documents in their order, in runs that overlap by the following text."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
                        F.xxhash64(text).alias("code"), F.rand(17).alias("salt"))
    order = ("none", "id", "code", "salt")
    keys = stored(keyed.select(*order, F.octet_length("text").alias("size")))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(keys.agg(F.sum("size")).first()[0] or 0) // SHARD))
    firsts = keys.repartitionByRange(ranges, *order).groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct(*order)).alias("first")).select("first.*").collect()
    bounds = sorted(tuple(r) for r in firsts)
    discard(keys)
    shared = spark.sparkContext.broadcast(bounds)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        begins: dict[tuple, list[int]] = {}
        for i, bound in enumerate(known):
            begins.setdefault(bound[:3], []).append((i - 1) % len(known))
        for batch in batches:
            key = list(zip(*(batch.column(c).to_pylist() for c in order), strict=True))
            to = [max(0, bisect_right(known, k) - 1) for k in key]
            first = {k[:3]: i for i, k in enumerate(key) if k[:3] in begins}
            again = [(i, b) for k, i in first.items() for b in begins[k]]
            rows = pa.array([*range(batch.num_rows), *(i for i, _ in again)], pa.int64())
            out = [batch.column(c).take(rows) for c in ("doc_id", "text", "none", "id", "code")]
            yield pa.record_batch([pa.array([*to, *(b for _, b in again)], pa.int32()), pa.array([False] * len(to) + [True] * len(again)), *out], ["range", "border", "doc_id", "text", "none", "id", "code"])

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[Follower]:
        last = None  # the row whose follower is still to come
        for piece in grouped(batches):
            border = piece.column("border").to_pylist()
            n = border.index(True) + 1 if True in border else len(border)  # copies of the border's text may follow
            rows = pa.table([piece.column("doc_id")[:n], piece.column("text")[:n]], ["doc_id", "text"])
            if last is not None:
                rows = pa.concat_tables([last, rows])
            if rows.num_rows > 1:
                yield Follower(rows.column("doc_id").combine_chunks()[:-1], rows.column("text"))
            if n < len(border) or border[n - 1]:
                return
            last = rows[-1:]

    dealt = keyed.mapInArrow(deal, T.StructType([T.StructField("range", T.IntegerType()), T.StructField("border", T.BooleanType()), *keyed.drop("salt").schema.fields]))
    dealt = dealt.repartitionById(max(1, len(bounds)), "range").sortWithinPartitions("border", "none", "id", "code").select("doc_id", "text", "border")
    return dealt.mapInArrow(lambda batches: work(runs(batches)), schema)


def _edited(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts but the last: code points, and the edited texts (last quarter replaced by the beginning of the next text) with
    where they begin."""
    point = np.flatnonzero((data & 0xC0) != 0x80)
    begin = np.searchsorted(point, at)
    n = np.diff(begin)
    where = np.append(point, len(data))
    quarter = n[:-1] // 4
    stop = np.where(quarter > 0, where[begin[1:-1] - quarter], at[1:-1])
    more = where[np.minimum(begin[1:-1] + quarter, begin[2:])]
    parts = [x for a, s, b, e in zip(at[:-2].tolist(), stop.tolist(), at[1:-1].tolist(), more.tolist(), strict=True) for x in (data[a:s], data[b:e])]
    size = stop - at[:-2] + more - at[1:-1]
    return n[:-1], np.concatenate(parts), np.concatenate(([0], np.cumsum(size)))


def _digests(runs: Iterator[Follower]) -> Iterator[pa.RecordBatch]:
    for run in runs:
        data, at = utf8(run.texts)
        own = prints(data, at)
        n_chars, text, begin = _edited(data, at)
        edited = prints(text, begin)
        here, after = np.arange(len(run.ids)), np.arange(1, len(run.ids) + 1)
        mine = own.take(here)
        raw = memoryview(text)
        yield pa.record_batch([
            run.ids, pa.array(n_chars, pa.int64()), pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], pa.string()),
            pa.array(spelled(mine), pa.string()), pa.array(spelled(edited), pa.string()), pa.array(likeness(mine, edited)), pa.array(likeness(mine, own.take(after))),
        ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_next(docs, _digests, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
