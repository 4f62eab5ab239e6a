"""Silhouettes on the plain distance: sums of distances from every row to every cluster, without pairs of rows.

Equal rows of a cluster are one point with a weight. Space is cut into boxes at medians of a bounded sample (at most ``BOXES``); a box
cuts its points into a tree of cells at medians. The points of a cell stand, for rows that are at least as far away as the cell is wide, for
weights on a grid of Chebyshev nodes (``ORDER`` per axis), which take the place of the points in the sum; a cell with no more points than
nodes stands for itself. On the side of the rows the largest cell that is as far away as it is wide reads the sum at its own nodes and hands
it down to its halves; leaves interpolate. What is nearer is summed point by point.

Along an axis the distance is analytic up to an imaginary offset of one cell width, so interpolating it errs by at most about
``8 w (2 + 5 ** 0.5) ** (1 - ORDER)`` for a cell of width w, which is no more than the distance itself: below 2e-5 of it with the orders
used. Errors of many cells have no common sign; tests hold the sums to 1e-7 of all pairs and the mean silhouette to 1e-8.

A box sends to each other box the coarsest cells that are far enough from it, and points of the leaves at its border only, so what is sent
grows with the number of boxes and with borders. No row is compared with all others, and no task holds more than a box and what it needs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, stored
from .graph import boxed, distinct_points

BOX_POINTS, BOXES, LEAF, STRIP = 4096, 512, 256, 8192
#: Distances held at a time, few enough for a core's cache.
PAIRS = 65536
#: Nodes per axis by the number of columns; in one dimension distances between separate cells are linear, so two are exact.
ORDER = {1: 2, 2: 10, 3: 9}


def _basis(x: np.ndarray, low: np.ndarray, high: np.ndarray, order: int) -> np.ndarray:
    """points x order^d: how much each node of the cell counts at each point."""
    at = np.cos((2 * np.arange(order) + 1) * np.pi / (2 * order))
    turns = np.cos(np.arange(order)[:, None] * np.arccos(at))
    turns[1:] *= 2
    out = np.ones((len(x), 1))
    for j in range(x.shape[1]):
        half = (high[j] - low[j]) / 2
        u = np.clip((x[:, j] - (low[j] + high[j]) / 2) / (half or 1.0), -1.0, 1.0)
        line = np.cos(np.arccos(u)[:, None] * np.arange(order)) @ turns / order
        out = (out[:, :, None] * line[:, None, :]).reshape(len(x), -1)
    return out


def _nodes(low: np.ndarray, high: np.ndarray, order: int) -> np.ndarray:
    at = np.cos((2 * np.arange(order) + 1) * np.pi / (2 * order))
    axes = [(a + b) / 2 + (b - a) / 2 * at for a, b in zip(low, high)]
    return np.stack([g.ravel() for g in np.meshgrid(*axes, indexing="ij")], axis=1)


def _sums(x: np.ndarray, sources: list[tuple[np.ndarray, np.ndarray]], clusters: int) -> np.ndarray:
    """points x clusters: weighted distances from each point to the sources."""
    out = np.zeros((len(x), clusters))
    if sources:
        y, w = (np.concatenate(p) for p in zip(*sources))
        x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
        strip = max(1, PAIRS // max(1, x.shape[1]))
        for lo in range(0, y.shape[1], strip):
            part, d2 = y[:, lo : lo + strip], None
            for j in range(len(x)):
                step = np.subtract.outer(x[j], part[j])
                step *= step
                d2 = step if j == 0 else np.add(d2, step, out=d2)
            out += np.sqrt(d2, out=d2) @ w[lo : lo + strip]
    return out


def _gap(low: np.ndarray, high: np.ndarray, to_low: np.ndarray, to_high: np.ndarray) -> np.ndarray:
    """Distance between cells; either side may be many."""
    apart = np.maximum(np.maximum(low - to_high, to_low - high), 0.0)
    return np.sqrt((apart * apart).sum(axis=-1))


class _Cell:
    """Points of a box between tight bounds, what stands for them, and the two halves; a leaf has none."""

    def __init__(self, x: np.ndarray, w: np.ndarray, rows: np.ndarray, order: int):
        self.rows, self.low, self.high = rows, x[rows].min(axis=0), x[rows].max(axis=0)
        self.width = float((self.high - self.low).max())
        self.halves: list[_Cell] = []
        nodes = order ** x.shape[1]
        if len(rows) > max(LEAF, nodes) and self.width > 0:
            axis = int((self.high - self.low).argmax())
            by = rows[np.argsort(x[rows, axis], kind="stable")]
            self.halves = [_Cell(x, w, part, order) for part in (by[: len(by) // 2], by[len(by) // 2 :])]
        if len(rows) <= nodes:
            self.stand = (x[rows], w[rows])
        else:
            parts = [h.stand for h in self.halves] or [(x[rows], w[rows])]
            self.stand = (_nodes(self.low, self.high, order), sum(_basis(y, self.low, self.high, order).T @ v for y, v in parts))

    def seen_from(self, low: np.ndarray, high: np.ndarray) -> list["_Cell"]:
        """The coarsest cells as far from the bounds as they are wide; else leaves, whose points are needed."""
        if not self.halves or _gap(self.low, self.high, low, high) >= self.width:
            return [self]
        return [c for h in self.halves for c in h.seen_from(low, high)]


def _box_sums(x: np.ndarray, w: np.ndarray, root: _Cell, sources: list[tuple[np.ndarray, np.ndarray]], lows: np.ndarray, highs: np.ndarray, order: int) -> np.ndarray:
    """points x clusters: distances from each point of a box to the points of the box and to the sources, which lie between lows and highs.

    A source is summed at the nodes of the largest cell that it is far enough from. Cells hand the sums at their nodes to their halves, so a
    leaf reads all of them at its own nodes and goes through those sources only that are far from it but not from the cells around it.
    """
    k, nodes = w.shape[1], order ** x.shape[1]
    out = np.zeros((len(x), k))
    work: list[tuple[_Cell, np.ndarray, _Cell | None, np.ndarray | None]] = [(root, np.arange(len(sources)), None, None)]
    while work:
        cell, rest, around, above = work.pop()
        distant = _gap(lows[rest], highs[rest], cell.low, cell.high) >= cell.width
        far, near, rest = [sources[g] for g in rest[distant]], [], rest[~distant]
        if not cell.halves:
            near = [sources[g] for g in rest]
            for c in root.seen_from(cell.low, cell.high):
                gap = _gap(c.low, c.high, cell.low, cell.high)
                stand = c.stand if gap >= c.width and c is not cell else (x[c.rows], w[c.rows])
                (far if gap >= cell.width and c is not cell else near).append(stand)
        if len(cell.rows) > nodes:
            at = _nodes(cell.low, cell.high, order)
            there = _sums(at, far, k)
            if above is not None:  # polynomials of the same order: nothing is lost
                there += _basis(at, around.low, around.high, order) @ above
            if cell.halves:
                work += [(h, rest, cell, there) for h in cell.halves]
                continue
            for lo in range(0, len(cell.rows), STRIP):
                rows = cell.rows[lo : lo + STRIP]
                out[rows] += _basis(x[rows], cell.low, cell.high, order) @ there
        else:
            out[cell.rows] += _sums(x[cell.rows], far, k)
            if above is not None:
                out[cell.rows] += _basis(x[cell.rows], around.low, around.high, order) @ above
        out[cell.rows] += _sums(x[cell.rows], near, k)
    return out


def _read(t: pa.Table, cols: list[str], clusters: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([t.column(c).to_numpy().astype(float) for c in cols], axis=1) if t.num_rows else np.zeros((0, len(cols)))
    w = np.zeros((len(x), clusters))
    w[np.arange(len(x)), t.column("_c").to_numpy()] = t.column("n").to_numpy()
    return x, w


def distance_sums(df: DataFrame, cols: list[str], cluster: str = "cluster", size: int | None = None) -> tuple[DataFrame, list, list[int]]:
    """(points, labels, sizes): for every different complete row its columns, cluster, ``n`` (how often it occurs) and ``sums``, the
    sum of distances to the rows of each label. One to three columns. Rows with a null column or cluster are left out."""
    if len(cols) not in ORDER:
        raise ValueError(f"one to {max(ORDER)} columns")
    order, dims = ORDER[len(cols)], len(cols)
    points = distinct_points(df, [cluster, *cols])
    found = sorted((r[0], int(r[1])) for r in points.groupBy(cluster).agg(F.sum("n")).collect())  # one row per cluster
    labels, sizes = [f[0] for f in found], [f[1] for f in found]
    if not labels:
        return points.withColumn("sums", F.array().cast("array<double>")).drop("id"), [], []
    k = len(labels)
    size = size or max(BOX_POINTS, -(-points.count() // BOXES))
    code = F.coalesce(*[F.when(F.col(cluster) == F.lit(v), F.lit(i)) for i, v in enumerate(labels)]).alias("_c")
    placed, _ = boxed(points.select("id", cluster, code, *[F.col(c).cast("double").alias(c) for c in cols], "n"), cols, size)
    # one row per box, and there are at most BOXES
    edges = placed.groupBy("box").agg(F.array(*[F.min(c) for c in cols]), F.array(*[F.max(c) for c in cols])).collect()
    bounds = {r[0]: (np.array(r[1]), np.array(r[2])) for r in edges}

    def send(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        x, w = _read(t, cols, k)
        root, out = _Cell(x, w, np.arange(len(x)), order), []
        for box, (low, high) in bounds.items():
            if box == key[0].as_py():
                continue
            for c in root.seen_from(low, high):
                far = _gap(c.low, c.high, low, high) >= c.width
                y, v = c.stand if far else (x[c.rows], w[c.rows])
                at = np.nonzero(v)
                out.append((box, c.low.tolist(), c.high.tolist(), y.ravel(), at[0].astype(np.int32), at[1].astype(np.int32), v[at]))
        return pa.table({n: pa.array([o[i] for o in out], kind) for i, (n, kind) in enumerate((
            ("box", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("y", pa.list_(pa.float64())),
            ("i", pa.list_(pa.int32())), ("c", pa.list_(pa.int32())), ("v", pa.list_(pa.float64()))))})

    def receive(key: tuple[pa.Scalar, ...], t: pa.Table, guests: pa.Table) -> pa.Table:
        x, w = _read(t, cols, k)
        root = _Cell(x, w, np.arange(len(x)), order)
        sources, lows, highs = [], np.zeros((guests.num_rows, dims)), np.zeros((guests.num_rows, dims))
        for g in range(guests.num_rows):
            low, high, y, i, c, v = (guests.column(n)[g].values.to_numpy(zero_copy_only=False) for n in ("low", "high", "y", "i", "c", "v"))
            lows[g], highs[g] = low, high
            full = np.zeros((len(y) // dims, k))
            full[i, c] = v
            sources.append((y.reshape(-1, dims), full))
        out = _box_sums(x, w, root, sources, lows, highs, order)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(out.ravel()))
        return pa.table({"id": t.column("id"), "sums": lists})

    sent = stored(placed.groupBy("box").applyInArrow(send, "box int, low array<double>, high array<double>, y array<double>, i array<int>, c array<int>, v array<double>"))
    sums = placed.groupBy("box").cogroup(sent.groupBy("box")).applyInArrow(receive, "id long, sums array<double>")
    out = stored(points.join(sums, "id").drop("id"))
    discard(sent, placed, points)
    return out, labels, sizes


def plain_silhouette(df: DataFrame, cols: list[str], cluster: str = "cluster", size: int | None = None) -> DataFrame:
    """Columns, cluster, ``n`` and ``silhouette`` of every different row: (b - a) / max(a, b) with a the mean distance to the other rows of
    its cluster and b the least mean distance to those of another one. A row alone in its cluster has 0, and so has one with a = b = 0;
    with fewer than two clusters it is null."""
    out, labels, sizes = distance_sums(df, cols, cluster, size)
    if len(labels) < 2:
        return out.withColumn("silhouette", F.lit(None).cast("double")).drop("sums")
    own = F.coalesce(*[F.when(F.col(cluster) == F.lit(v), F.struct(F.col("sums")[i].alias("s"), F.lit(n).alias("n"))) for i, (v, n) in enumerate(zip(labels, sizes))])
    other = F.array_min(F.array(*[F.when(F.col(cluster) != F.lit(v), F.col("sums")[i] / n) for i, (v, n) in enumerate(zip(labels, sizes))]))
    a, b = F.try_divide(F.col("_own.s"), F.col("_own.n") - 1), F.col("_b")
    value = F.when(F.col("_own.n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    return out.withColumns({"_own": own, "_b": other}).withColumn("silhouette", value).drop("_own", "_b", "sums")


def mean_silhouette(rows: DataFrame, keys=()) -> DataFrame:
    """The mean over all rows, or by key, of the result of ``plain_silhouette``."""
    return rows.groupBy(*keys).agg((F.sum(F.col("n") * F.col("silhouette")) / F.sum("n")).alias("silhouette"), F.sum("n").alias("rows"))
