"""Near duplicates by fast similarity sketching, banding and exact verification.

A document's set holds the hashes of its 5-word shingles (words: bytes between ASCII white space, A-Z lower-cased; fewer than
five words make one shingle, no word none). Two documents are linked when intersection is at least 0.75 of union.

Sketch: in round i < T every shingle is thrown into bin h_i(x) of T bins with the value (i, u_i(x)); in round T + j all go to
bin j. The least value of a bin is its coordinate, so a document stops at the first round after which every bin is full, and
2T rounds always fill all. Long documents end after one or two rounds, short ones still get every coordinate, and the share of
equal coordinates concentrates around the similarity as with T independent permutations.

Bands: 40 bands of 5 coordinates miss a pair at 0.75 with a chance of 2e-5.

Links, without rows for all pairs of a group: documents of equal sets are linked to the smallest id. Every other document is
verified against the centre (smallest id of a bucket) it shares most bands with, and components are formed. What remains are pairs
of one bucket in different components. Buckets of the same documents are looked at once; of a bucket's largest component only
the other rows' partners matter. A bucket is cut into cells of a bounded number of shingles, rows against columns, and a cell counts
the common shingles of all its pairs exactly and gives one link for each row and other component. No link between different
components is lost that way, and links within a component change nothing.

Repeated rows: links are between doc_ids; each row with an id is compared with its own set, and the id is linked when one of its
rows is. Rows without doc_id are returned as unlinked and kept, since nothing could name them. Null and empty texts are unlinked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, constants, documents, grouped, lists, mix, stored, sums_per, utf8, words
from .graph import components

WIDTH = 5
NUM, DEN = 75, 100
BANDS, BAND_ROWS = 40, 5
BINS = BANDS * BAND_ROWS
#: Shingles of the rows, and of the columns, that one task compares at a time.
CELL = 300_000
_EMPTY = ~U(0)
_place = constants(11, 16)
_round = constants(12, 2 * BINS)
_set = constants(13, 2)
_band = constants(14, BANDS * BAND_ROWS)


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after the other; and their numbers."""
    w, count = words(data, at)
    first = np.concatenate(([0], np.cumsum(count)))
    whole = np.zeros(0, U)
    if len(w) >= WIDTH:
        whole = reduce(np.add, (w[j : len(w) - WIDTH + 1 + j] * _place[j] for j in range(WIDTH)))
        whole = mix(whole)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= WIDTH:
            x = np.sort(whole[lo : hi - WIDTH + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif hi > lo:
            out.append(mix((w[lo:hi] * _place[: hi - lo]).sum(keepdims=True) + U(hi - lo)))
        else:
            out.append(w[:0])
    return (np.concatenate(out) if out else w[:0]), np.array([len(x) for x in out], np.int64)


def sketches(x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Matrix of one row of BINS coordinates per set; rows of empty sets hold no value."""
    n = len(count)
    bins = np.full(n * BINS, _EMPTY, U)
    owner = np.repeat(np.arange(n), count)
    open_ = count > 0
    for i in range(2 * BINS):
        if not len(x):
            break
        h = mix(x ^ _round[i])
        if i < BINS:
            at = owner * BINS + ((h >> U(32)) * U(BINS) >> U(32)).astype(np.int64)
        else:
            at = owner * BINS + (i - BINS)
        np.minimum.at(bins, at, (U(i) << U(32)) | (h & U(0xFFFFFFFF)))
        still = open_ & (bins.reshape(n, BINS) == _EMPTY).any(axis=1)
        if not still.all() or i == 0:
            keep = still[owner]
            if not keep.all():
                x, owner = x[keep], owner[keep]
            open_ = still
    return bins.reshape(n, BINS)


SKETCHED = "doc_id long, n long, set1 long, set2 long, bands array<long>"


def _sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in grouped(batches):
        x, count = shingles(*utf8(part.column("text")))
        s = sketches(x, count)
        edge = np.concatenate(([0], np.cumsum(count)))
        full = count > 0
        band = (s[full] * _band).reshape(-1, BANDS, BAND_ROWS).sum(axis=2)
        band = mix(band + np.arange(BANDS, dtype=U) * U(0x9E3779B97F4A7C15))
        yield pa.RecordBatch.from_arrays([
            part.column("doc_id"), pa.array(count), *(pa.array(sums_per(mix(x ^ k), edge).view(np.int64)) for k in _set),
            lists(band.ravel().view(np.int64), np.where(full, BANDS, 0)),
        ], names=["doc_id", "n", "set1", "set2", "bands"])


def _confirmed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach the similarity."""
    for batch in batches:
        for part in grouped([batch], "ta"):
            left, nl = shingles(*utf8(part.column("ta")))
            right, nr = shingles(*utf8(part.column("tb")))
            el, er = np.cumsum(nl), np.cumsum(nr)
            keep = []
            for i in range(part.num_rows):
                a, b = left[el[i] - nl[i] : el[i]], right[er[i] - nr[i] : er[i]]
                if len(a) > len(b):
                    a, b = b, a
                if not len(a) or DEN * len(a) < NUM * len(b):
                    continue
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                if DEN * both >= NUM * (len(a) + len(b) - both):
                    keep.append(i)
            yield part.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Linked pairs among ``pairs`` (a, b)."""
    full = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb"))
    return full.mapInArrow(_confirmed, "a long, b long")


def _across(cell: pa.Table) -> pa.Table:
    """Links of the rows (left) of a cell to its columns (right) in other components, one for each component."""
    x, count = shingles(*utf8(cell.column("text")))
    cell, count = cell.filter(pa.array(count > 0)), count[count > 0]
    d, part, left, right = (cell.column(c).to_numpy() for c in ("d", "p", "left", "right"))
    known, number = np.unique(x, return_inverse=True)
    edge = np.concatenate(([0], np.cumsum(count)))
    mark, a, b = np.zeros(len(known), np.int32), [], []
    for i in np.flatnonzero(left).tolist():
        mine = number[edge[i] : edge[i + 1]]
        mark[mine] = 1
        both = np.add.reduceat(mark[number], edge[:-1])
        mark[mine] = 0
        ok = np.flatnonzero(right & (part != part[i]) & (DEN * both >= NUM * (count + count[i] - both)))
        if len(ok):
            other = ok[np.unique(part[ok], return_index=True)[1]]
            a += [d[i]] * len(other)
            b += d[other].tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _between(shared: DataFrame, part: DataFrame, texts: DataFrame) -> DataFrame:
    """All links between documents of one bucket in different components."""
    placed = shared.join(part.select(F.col("a").alias("d"), F.col("b").alias("p")), "d", "left").withColumn("p", F.coalesce("p", "d"))
    code = F.xxhash64("d")
    parts = placed.groupBy("band", "p").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"), F.bit_xor(code).alias("x"), F.sum(F.shiftright(F.xxhash64(code), 20)).alias("y"))
    order = F.struct("m", -F.col("p"))
    buckets = (parts.groupBy("band").agg(F.max_by("p", order).alias("main"), F.max_by("size", order).alias("most"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts"),
                                         F.sum("m").alias("m"), F.bit_xor("x").alias("x"), F.sum("y").alias("y")).where("parts > 1"))
    # the same documents in several bands are one bucket
    buckets = (buckets.groupBy("m", "x", "y").agg(F.min_by(F.struct("band", "main", "size", "most"), "band").alias("u"))
               .select("u.band", "u.main", (F.floor((F.col("u.size") - F.col("u.most")) / CELL) + 1).cast("int").alias("rows"), (F.floor(F.col("u.size") / CELL) + 1).cast("int").alias("columns")))
    of = placed.join(buckets, "band").withColumns({"i": F.pmod(code, "rows").cast("int"), "j": F.pmod(F.shiftright(code, 32), "columns").cast("int")})
    column = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda k: F.struct(k.alias("r"), F.col("j").alias("c")))
    row = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda k: F.struct(F.col("i").alias("r"), k.alias("c")))
    cells = F.when(F.col("p") == F.col("main"), column).otherwise(F.array_union(column, row))
    spread = (of.select("band", "d", "p", "i", "j", "main", F.inline(cells))
              .select("band", "r", "c", "d", "p", ((F.col("p") != F.col("main")) & (F.col("i") == F.col("r"))).alias("left"), (F.col("j") == F.col("c")).alias("right")))
    full = spread.join(texts.select(F.col("doc_id").alias("d"), "text"), "d")
    return full.groupBy("band", "r", "c").applyInArrow(_across, "a long, b long")


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept. Other columns of ``docs`` are not read."""
    docs = docs.select("doc_id", "text")
    rows = stored(docs.mapInArrow(_sketched, SKETCHED))
    named = rows.where("doc_id is not null and n > 0")
    equal = named.groupBy("n", "set1", "set2").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    same = (named.select("doc_id", "n", "set1", "set2").join(equal.where("copies > 1").select("n", "set1", "set2", F.col("doc_id").alias("b")), ["n", "set1", "set2"])
            .where("doc_id != b").select(F.col("doc_id").alias("a"), "b"))
    # one row per set and band; buckets of one set are dropped
    banded = equal.select(F.col("doc_id").alias("d"), "n", F.explode("bands").alias("band"))
    centre = banded.groupBy("band").agg(F.min("d").alias("centre"), F.max("d").alias("last")).where("centre != last").drop("last")
    shared = stored(banded.join(centre, "band"))

    star = shared.where("d != centre").groupBy(F.col("d").alias("a"), F.col("centre").alias("b")).agg(F.count(F.lit(1)).alias("bands"))
    best = star.groupBy("a").agg(F.max_by("b", F.struct("bands", -F.col("b"))).alias("b"))
    texts = stored(docs.join(shared.select(F.col("d").alias("doc_id")).distinct(), "doc_id"))
    links = stored(same.unionByName(_verified(best, texts)))
    part = components(links)
    more = stored(_between(shared.select("d", "n", "band"), part, texts))
    part = components(part.unionByName(more))
    return (rows.select("doc_id", F.col("n").alias("n_shingles")).join(part.select(F.col("a").alias("doc_id"), "b"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("b", "doc_id").alias("component_id"), F.col("b").isNull().alias("kept")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir, "doc_id", "text"))
