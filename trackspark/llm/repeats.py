"""Removal of long repeated byte strings with a logarithmic index family.

Every byte covered by a string of ``LENGTH`` (200) bytes that also starts anywhere else, in the same or another text, is removed;
strings are judged on the input. Texts are UTF-8, null counts as empty, and no string crosses a text. Each input row is a text of
its own, so two whole copies of 200 bytes or more empty each other.

Indexing every suffix would cost many times the input. A text is indexed at anchors instead, in three probes of growing prefix
length k. The k-byte prefix whose hash is least among those starting in a 200-byte string is its anchor, and equal strings have
the same anchor wherever they stand. An index entry is a suffix at an anchor: the hash of its first k bytes (its sort key) and the
hash of all bytes that strings through this anchor can reach.

* no other suffix has this prefix: no string through the anchor repeats;
* another suffix also agrees on the whole reach: every string through it repeats;
* another suffix has this prefix with another reach: the strings through both go to the next probe, which looks at longer
  prefixes. The last probe has k = 200 and decides all.

Texts are dealt into blocks of a few megabytes. A block offers each entry once, so an entry that a third of all texts hold reaches
its index shard once per block. A shard takes the entries in batches: every batch is sorted (its suffix array), merge-scanned
against each level of the shard for long matches, and kept as a new level; equal-sized levels merge, so an entry is merged a
logarithmic number of times. Large levels lie in files of the task. Blocks get back only their decided or undecided entries.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, RangeHash, documents, mix, scratch_dir, stored, utf8

LENGTH = 200
PROBES = (100, 180, 200)
#: Bytes of text in a block; blocks of a bucket file; bytes looked at together; entries of a batch; entries of a level in memory.
BLOCK, PER_BUCKET, SEGMENT, BATCH, IN_MEMORY = 4 << 20, 16, 1 << 19, 1 << 16, 1 << 22
#: State of an entry, as bits: its prefix occurs with another reach; its reach repeats.
SOME, ALL = np.int8(1), np.int8(2)
_first, _second = RangeHash(21), RangeHash(22)


class LogIndex:
    """Levels of entries sorted by prefix; sizes fall geometrically. Arrays of a level: prefix, reach, block, many, state."""

    def __init__(self, folder: str):
        self.folder, self.levels = folder, []

    def add(self, prefix, reach, block, many) -> None:
        order = np.lexsort((reach, prefix))
        new = [prefix[order], reach[order], block[order], many[order], np.zeros(len(order), np.int8)]
        self._match(new)
        for level in self.levels:
            self._scan(new, level)
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= len(self.levels[-1][0]):
            b, a = self.levels.pop(), self.levels.pop()
            both = [np.concatenate(x) for x in zip(a, b, strict=True)]
            order = np.argsort(both[0], kind="stable")
            self.levels.append(self._settle([x[order] for x in both]))

    def _settle(self, level: list) -> list:
        """Large levels as mapped files."""
        if len(level[0]) < IN_MEMORY:
            return level
        out = []
        for x in level:
            path = os.path.join(self.folder, uuid.uuid4().hex)
            np.save(path, x)
            out.append(np.load(path + ".npy", mmap_mode="r+"))
            os.unlink(path + ".npy")  # the mapping holds it
        return out

    @staticmethod
    def _match(new: list) -> None:
        """Matches within one batch."""
        prefix, reach, _, many, state = new
        if not len(prefix):
            return
        edge = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
        size = np.diff(np.append(edge, len(prefix)))
        state |= np.repeat(reach[edge] != reach[edge + size - 1], size) * SOME
        same = (prefix[1:] == prefix[:-1]) & (reach[1:] == reach[:-1])
        state[1:] |= same * ALL
        state[:-1] |= same * ALL
        state |= many * ALL

    @staticmethod
    def _scan(new: list, level: list) -> None:
        """Long matches between a batch and a level, marked on both sides."""
        lo, hi = np.searchsorted(level[0], new[0], "left"), np.searchsorted(level[0], new[0], "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return
        edge = np.zeros(len(level[0]) + 1, np.int64)
        np.add.at(edge, lo[hit], 1)
        np.add.at(edge, hi[hit], -1)
        back = np.flatnonzero(np.cumsum(edge[:-1]))
        sides = []
        for x, at in ((new, hit), (level, back)):  # both have the same prefixes
            prefix, reach = x[0][at], x[1][at]
            first = np.concatenate(([True], prefix[1:] != prefix[:-1]))
            sides.append((reach, np.cumsum(first) - 1, np.minimum.reduceat(reach, np.flatnonzero(first)), np.maximum.reduceat(reach, np.flatnonzero(first))))
        (ra, ga, la, ha), (rb, gb, lb, hb) = sides
        other = (np.minimum(la, lb) != np.maximum(ha, hb)) * SOME
        new[4][hit] |= (other[ga] | np.isin(ra, rb) * ALL).astype(np.int8)
        level[4][back] |= (other[gb] | np.isin(rb, ra) * ALL).astype(np.int8)

    def matches(self) -> Iterator[tuple]:
        for prefix, reach, block, _, state in self.levels:
            for lo in range(0, len(prefix), BATCH):
                at = lo + np.flatnonzero(state[lo : lo + BATCH])
                yield block[at], reach[at], state[at]


def _index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with tempfile.TemporaryDirectory(dir=os.environ.get("TMPDIR")) as folder:
        index, held, n = LogIndex(folder), [], 0

        def add():
            both = pa.Table.from_batches(held)
            index.add(*(both.column(c).to_numpy() for c in ("prefix", "reach", "block", "many")))

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BATCH:
                add()
                held, n = [], 0
        if n:
            add()
        for block, reach, state in index.matches():
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(reach), pa.array(state)], names=["block", "reach", "state"])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[size:], x[:-size])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _runs(flag: np.ndarray) -> np.ndarray:
    """Start and end of each run of true values, one row per run."""
    return np.flatnonzero(np.diff(np.concatenate(([0], flag.view(np.int8), [0])))).reshape(-1, 2)


def _spread(flag: np.ndarray, width: int) -> np.ndarray:
    """Positions reached by a true value within the ``width`` positions up to them."""
    c = np.cumsum(flag, dtype=np.int32)
    c[width:] -= c[:-width].copy()
    return c > 0


class Text:
    """The texts of a block, one after the other."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at

    def windows(self, states: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple]:
        """For each segment: its first position, the starts known to repeat, and (with fewer states than probes) the entries
        of the next probe. ``states`` has the sorted entries and their state for each probe done."""
        n = len(self.data)
        for lo in range(0, n, SEGMENT):
            hi = min(n, lo + SEGMENT)
            left, right = max(0, lo - LENGTH), min(n, hi + 2 * LENGTH)
            part = self.data[left:right]
            inside = np.zeros(right - left + 1, np.int32)
            i, j = np.searchsorted(self.at, left, "right") - 1, np.searchsorted(self.at, right)
            begin = np.maximum(self.at[i:j], left) - left
            end = np.minimum(self.at[i + 1 : j + 1], right) - left - LENGTH + 1
            ok = end > begin
            np.add.at(inside, begin[ok], 1)
            np.add.at(inside, end[ok], -1)
            open_ = np.cumsum(inside[:-1]) > 0
            open_[: lo - left] = open_[hi - left :] = False
            repeats = np.zeros(right - left, bool)
            if not open_.any():
                continue
            _first.load(part), _second.load(part)
            entries = None
            for probe, k in enumerate(PROBES):
                starts, owner, anchor, prefix, reach = self._anchors(part, left, open_, k)
                if probe == len(states):
                    entries = anchor + left, prefix, reach
                    break
                keys, state = states[probe]
                found = np.minimum(np.searchsorted(keys, reach), max(0, len(keys) - 1))
                got = np.where(keys[found] == reach, state[found], np.int8(0))[owner] if len(keys) else np.zeros(len(starts), np.int8)
                repeats[starts[(got & ALL) > 0]] = True
                open_[:] = False
                open_[starts[(got & SOME) > 0]] = True
                if not open_.any():
                    break
            yield lo, repeats[lo - left : hi - left], entries

    def _anchors(self, part, left, open_, k) -> tuple:
        """Open starts, the number of each one's anchor, and the anchors' position, prefix and reach."""
        width = LENGTH - k + 1
        need = np.zeros(len(part), bool)
        reached = _spread(open_, width) if width > 1 else open_
        need[: len(reached)] = reached
        p = np.flatnonzero(need)
        h = mix((_first.sums[p + k] - _first.sums[p]) * _first.down[p])
        low = U((1 << 21) - 1)
        least = _least((h & ~low) | p.astype(U), width)
        starts = np.flatnonzero(open_)
        where = (np.cumsum(need, dtype=np.int32) - 1)[starts]
        a = (least[where] & low).astype(np.int64)
        new = np.concatenate(([True], a[1:] != a[:-1]))
        a, owner = a[new], np.cumsum(new) - 1
        doc = np.searchsorted(self.at, a + left, "right") - 1
        b = np.maximum(self.at[doc] - left, a - (LENGTH - k))
        e = np.minimum(self.at[doc + 1] - left, a + LENGTH)
        prefix = mix((_first.sums[a + k] - _first.sums[a]) * _first.down[a])
        reach = mix(_second.ranges(b, e) ^ mix(prefix + (a - b).astype(U)))
        return starts, owner, a, prefix, reach


def _states(table: pa.Table | None, probes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for probe in range(probes):
        part = table.filter(pa.compute.equal(table.column("probe"), probe))
        keys, state = part.column("reach").to_numpy().view(U), part.column("state").to_numpy()
        order = np.argsort(keys)
        out.append((keys[order], state[order]))
    return out


ENTRIES = "block long, prefix long, reach long, many boolean"


def _entries(docs: pa.Table, known: pa.Table | None, probes: int) -> pa.Table:
    """Index entries of a block for the next probe, each once."""
    found = [e for _, _, e in Text(*utf8(docs.column("text"))).windows(_states(known, probes)) if e is not None]
    place, prefix, reach = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, U) for i in range(3))
    once = np.concatenate(([True], place[1:] != place[:-1]))[: len(place)]  # segments may meet in one anchor
    prefix, reach = prefix[once], reach[once]
    order = np.argsort(reach, kind="stable")
    prefix, reach = prefix[order], reach[order]
    new = np.concatenate(([True], reach[1:] != reach[:-1])) if len(reach) else np.zeros(0, bool)
    edge = np.flatnonzero(new)
    many = np.diff(np.append(edge, len(reach))) > 1
    block = docs.column("block")[0].as_py() if docs.num_rows else 0
    return pa.table({"block": np.full(len(edge), block, np.int64), "prefix": prefix[edge].view(np.int64), "reach": reach[edge].view(np.int64), "many": many})


def _next(probes: int):
    """The function of two tables that Spark asks for."""
    return lambda docs, known: _entries(docs, known, probes)


CLEANED = "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>"


def _cleaned(docs: pa.Table, known: pa.Table) -> pa.Table:
    data, at = utf8(docs.column("text"))
    start = np.zeros(len(data), bool)
    for lo, repeats, _ in Text(data, at).windows(_states(known, len(PROBES))):
        start[lo : lo + len(repeats)] = repeats
    gone = _spread(start, LENGTH) if len(data) else start
    kept, spans = [], []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        cut = gone[lo:hi]
        kept.append(data[lo:hi][~cut].tobytes())
        spans.append([{"start": a, "end": b} for a, b in _runs(cut).tolist()] if cut.any() else [])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": np.diff(at), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, kind)})


def _blocked(docs: DataFrame) -> DataFrame:
    """Documents dealt into blocks, in a table bucketed by block: later passes read it without a shuffle."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    buckets = min(blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks // PER_BUCKET))
    name = f"blocks_{uuid.uuid4().hex}"
    (docs.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))).repartition(buckets, "block")
     .write.bucketBy(buckets, "block").option("path", scratch_dir(spark)).saveAsTable(name))
    return spark.table(name)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_bytes, kept (the remaining bytes) and spans (removed runs, byte offsets). Other columns
    of ``docs`` are not read. Empty input gives no rows."""
    spark = docs.sparkSession
    table = _blocked(docs.select("doc_id", "text"))
    known = None
    for probe in range(len(PROBES)):
        if known is None:
            entries = table.groupBy("block").applyInArrow(lambda t: _entries(t, None, 0), ENTRIES)
        else:
            entries = table.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_next(probe), ENTRIES)
        states = stored(entries.repartition("prefix").mapInArrow(_index, "block long, reach long, state byte").withColumn("probe", F.lit(probe)))
        known = states if known is None else known.unionByName(states)
    return table.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_cleaned, CLEANED)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
