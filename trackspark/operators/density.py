"""Histograms and kernel densities.

Densities are fast Gauss transforms. Values are summed up in cells narrower than the bandwidth, as moments of their distance to the cell's
centre; a cell acts on what is near it by a Hermite series of these moments. Rows are aggregated once, in one pass, and neither multiplied by
grid points nor paired with each other; an outlier is one more cell. Left out are kernels beyond ``REACH`` bandwidths (2e-16 of
the kernel's peak) and terms beyond the series' order (below 1e-11 of it).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunk import computed

REACH = 8.5
#: Cells per bandwidth and order of the series, for a grid and at points.
GRID_CELLS, GRID_ORDER = 4, 12
POINT_CELLS, POINT_ORDER = 2, 12
#: Cells that a task holds before it hands on its sums, and pairs of a cell and a grid point that it works on at a time.
HELD, PAIRS = 8192, 1 << 15


def hermite(x: np.ndarray, order: int) -> np.ndarray:
    """He_n(x) exp(-x^2 / 2) for n up to ``order``, first axis n."""
    out = np.empty((order + 1, *x.shape))
    out[0] = np.exp(-0.5 * x * x)
    if order:
        out[1] = x * out[0]
    for n in range(1, order):
        out[n + 1] = x * out[n] - n * out[n - 1]
    return out


_FACTORIAL = np.array([math.factorial(n) for n in range(40)], float)


def joint_histogram(df: DataFrame, x: str, y: str, width: float, keys=()) -> DataFrame:
    """Counts per (bx, by) square of side ``width``."""
    return df.groupBy(*keys, F.floor(F.col(x) / width).alias("bx"), F.floor(F.col(y) / width).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def smooth_histogram(hist: DataFrame, sigma: float = 2.0, reach: int = 8, keys=()) -> DataFrame:
    """Gaussian-smoothed counts: every bin is spread over the bins within ``reach`` with normalised weights."""
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    total = sum(weights)
    taps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w / total).alias("w")) for k, w in zip(range(-reach, reach + 1), weights)])
    out = hist.withColumn("v", F.col("n").cast("double"))
    for axis, other in (("bx", "by"), ("by", "bx")):
        spread = out.select(*keys, F.col(axis), F.col(other), "v", F.explode(taps).alias("t"))
        spread = spread.select(*keys, (F.col(axis) + F.col("t.k")).alias(axis), other, (F.col("v") * F.col("t.w")).alias("v"))
        out = spread.groupBy(*keys, axis, other).agg(F.sum("v").alias("v"))
    return out.withColumnRenamed("v", "smooth")


def quantile_histogram(df: DataFrame, value: str, bins: int = 40, low: float = 0.05, high: float = 0.95, keys=()) -> DataFrame:
    """Counts in ``bins`` equal bins between two quantiles; values outside are left out."""
    from .quantile import exact_quantiles

    q = exact_quantiles(df, list(keys), value, {"lo": low, "hi": high})
    j = df.join(q, list(keys)) if keys else df.crossJoin(F.broadcast(q))  # one row of bounds
    v = F.col(value)
    j = j.where((v >= F.col("lo")) & (v <= F.col("hi")) & (F.col("hi") > F.col("lo")))
    b = F.least(F.lit(bins - 1), F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("long")
    return j.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def scott_bandwidth(n: Column, std: Column, dims: int = 1) -> Column:
    return F.pow(n.cast("double"), -1.0 / (dims + 4)) * std


def kde_grid(df: DataFrame, value: str, step: float, keys=(), bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density of each group at multiples of ``step``: keys, g (counted from the bin of the least value of all), x, density.

    A grid point has a row where it lies within ``REACH`` bandwidths, and two steps, of the bin of one of the group's values. Without
    ``bandwidth`` it is Scott's rule per group; groups without spread have no rows.
    """
    from ..sources.tables import stored
    from .sweeps import _groups

    keys = list(keys)
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    stats = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_v").alias("_s"), F.floor(F.min("_v") / step).alias("_low"))
    stats = stats.select(*keys, "_n", "_low", (F.lit(float(bandwidth)) if bandwidth else scott_bandwidth(F.col("_n"), F.col("_s"))).alias("_h"))
    stats = stored(stats)
    low = stats.agg(F.min("_low").alias("_first"))  # one row
    stats = stats.drop("_low").where(F.col("_h") > 0)
    v = v.join(stats, keys) if keys else v.crossJoin(F.broadcast(stats))  # one row
    cell = F.floor(F.col("_v") * GRID_CELLS / F.col("_h"))
    v = computed(v, {"_c": cell}).withColumn("_d", F.col("_v") / F.col("_h") - (F.col("_c") + 0.5) / GRID_CELLS)
    power, sums = F.lit(1.0), []
    for n in range(GRID_ORDER + 1):
        sums.append((F.sum(power) / math.factorial(n)).alias(f"_m{n}"))
        power = power * F.col("_d")
    bin_ = F.floor(F.col("_v") / step)
    cells = v.groupBy(*keys, "_c").agg(F.max("_n").alias("_n"), F.max("_h").alias("_h"), F.min(bin_).alias("_b0"), F.max(bin_).alias("_b1"), *sums)
    if not keys:
        cells = cells.withColumn("_all", F.lit(0))
    names = keys or ["_all"]
    kept = [cells.schema[k] for k in names]

    def grid(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in _groups(batches, names):
            c, h, n, b0, b1 = (t.column(x).to_numpy().astype(float) for x in ("_c", "_h", "_n", "_b0", "_b1"))
            moments = np.stack([t.column(f"_m{i}").to_numpy() for i in range(GRID_ORDER + 1)])
            # points that have a row: all within reach of a cell's bins
            reach = np.ceil(REACH * h / step) + 2
            size = (b1 - b0 + 2 * reach + 1).astype(np.int64)
            at = np.repeat((b0 - reach).astype(np.int64), size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            wanted = np.unique(np.stack([np.repeat(group, size), at]), axis=1)
            # what a cell adds to the points near it, also to those beyond its own reach; some cells at a time
            base, span = wanted[1].min(initial=0), wanted[1].max(initial=0) - wanted[1].min(initial=0) + 1
            code, total = wanted[0] * span + (wanted[1] - base), np.zeros(wanted.shape[1])
            centre = (c + 0.5) / GRID_CELLS * h
            far = np.ceil((REACH + 4) * h / step)
            first = np.maximum(np.floor(centre / step) - far, base).astype(np.int64)
            size = np.maximum(np.minimum(np.floor(centre / step) + far + 1, base + span - 1).astype(np.int64) - first + 1, 0)
            ends = np.cumsum(size)
            lo = 0
            while lo < len(c):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + PAIRS, "right")))
                row = np.repeat(np.arange(lo, hi), size[lo:hi])
                at = first[row] + np.arange(len(row)) - (ends - size)[row] + (ends - size)[lo]
                mine = group[row] * span + (at - base)
                place = np.minimum(np.searchsorted(code, mine), len(code) - 1)
                hit = code[place] == mine
                row, at, place = row[hit], at[hit], place[hit]
                series = np.einsum("np,np->p", hermite((at * step - centre[row]) / h[row], GRID_ORDER), moments[:, row])
                total += np.bincount(place, series, minlength=len(code))
                lo = hi
            one = np.searchsorted(group, wanted[0])
            yield pa.RecordBatch.from_arrays([*[pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x for x in (t.column(k).take(pa.array(one)).combine_chunks() for k in names)],
                                              pa.array(wanted[1]), pa.array(wanted[1] * float(step)), pa.array(total / (n[one] * h[one] * math.sqrt(2 * math.pi)))], [*names, "g", "x", "density"])

    dealt = cells.repartition(*names).sortWithinPartitions(*names)
    out = dealt.mapInArrow(grid, T.StructType([*kept, T.StructField("g", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("density", T.DoubleType())]))
    return out.crossJoin(F.broadcast(low)).select(*keys, (F.col("g") - F.col("_first")).alias("g"), "x", "density")  # one row


def _cell_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moments per cell of points (k, cx, cy, dx, dy), or sums of moments (k, cx, cy, m); handed on whenever many cells are held."""
    held: dict[tuple, np.ndarray] = {}
    order = np.arange(POINT_ORDER + 1)

    def out() -> pa.RecordBatch:
        cells = np.array(list(held), np.int64).reshape(-1, 3)
        flat = np.concatenate(list(held.values())) if held else np.zeros(0)
        m = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * (POINT_ORDER + 1) ** 2), pa.array(flat))
        held.clear()
        return pa.RecordBatch.from_arrays([*[pa.array(cells[:, i]) for i in range(3)], m], ["_k", "_cx", "_cy", "_m"])

    for b in batches:
        for lo in range(0, b.num_rows, HELD):
            part = b.slice(lo, HELD)
            cell = np.stack([part.column(c).to_numpy() for c in ("_k", "_cx", "_cy")], axis=1)
            if "_m" in part.schema.names:
                m = part.column("_m").flatten().to_numpy().reshape(len(cell), -1)
            else:
                px, py = (part.column(c).to_numpy()[:, None] ** order / _FACTORIAL[order] for c in ("_dx", "_dy"))
                m = (px[:, :, None] * py[:, None, :]).reshape(len(cell), -1)
            by = np.lexsort(cell.T[::-1])
            cell, m = cell[by], m[by]
            first = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]).any(axis=1)))
            for c, total in zip(map(tuple, cell[first].tolist()), np.add.reduceat(m, first, axis=0), strict=True):
                held[c] = held[c] + total if c in held else total
            if len(held) > HELD:
                yield out()
    if held:
        yield out()


def _line_pass(axis: str, other: str, last: bool):
    """Sums of one line of cells carried over to the cells near them on the line, as series about those cells' centres."""
    n = POINT_ORDER + 1
    sign = (-1.0) ** np.arange(n)
    reach = math.ceil(REACH * POINT_CELLS) + 1
    steps = np.arange(-reach, reach + 1)
    h = hermite(steps / POINT_CELLS, 2 * POINT_ORDER)
    move = np.stack([[[sign[i] * h[i + a, s] for a in range(n)] for i in range(n)] for s in range(len(steps))])

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        at, m = t.column(axis).to_numpy(), t.column("_m").combine_chunks()
        m = (pa.concat_arrays(m.chunks) if isinstance(m, pa.ChunkedArray) else m).flatten().to_numpy().reshape(-1, n, n)
        have = t.column("_have").to_numpy()
        targets = np.unique(at[have]) if last else np.unique(at[:, None] + steps[None])
        out = np.zeros((len(targets), n, n))
        for s, step in enumerate(steps) if len(targets) else ():
            place = np.searchsorted(targets, at + step)
            hit = (place < len(targets)) & (targets[np.minimum(place, len(targets) - 1)] == at + step)
            # moments run over (axis x, axis y); the line's own axis is carried over
            part = np.einsum("ia,rab->rib", move[s], m[hit]) if axis == "_cx" else np.einsum("jb,rab->raj", move[s], m[hit])
            np.add.at(out, place[hit], part)
        k, line = (x.as_py() for x in key)
        cells = {axis: pa.array(targets.astype(np.int64)), other: pa.array(np.full(len(targets), line, np.int64))}
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(targets) + 1, dtype=np.int32) * n * n), pa.array(out.ravel()))
        return pa.table({"_k": pa.array(np.full(len(targets), k, np.int64)), "_cx": cells["_cx"], "_cy": cells["_cy"], "_m": lists, "_have": pa.array(np.isin(targets, at))})

    return run


def point_density(df: DataFrame, x: str, y: str, keys=(), out: str = "density") -> DataFrame:
    """``df`` with the Gaussian kernel density of its group's points at each of them: bandwidth by Scott's rule times the covariance, every point
    counted. Null where a coordinate is, and in groups whose covariance is singular.

    In coordinates in which the kernel is round, cells hold moments in both directions; they are carried over along the lines of cells, first
    in one direction, then in the other, and points take the series of their own cell. A line has as many cells as the group is wide in
    half bandwidths, which grows with the sixth root of its rows.
    """
    from ..sources.tables import stored

    keys = list(keys)
    there = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    stats = df.where(there).groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg(a).alias("_mx"), F.avg(b).alias("_my"),
                                              F.var_samp(a).alias("_vx"), F.var_samp(b).alias("_vy"), F.covar_samp(a, b).alias("_vxy"))
    wide = F.pow("_n", F.lit(-1.0 / 6))
    stats = stats.where("_vx > 0").select(*keys, "_n", "_mx", "_my", (F.sqrt("_vx") * wide).alias("_sx"), (F.col("_vxy") / F.col("_vx")).alias("_tilt"),
                                         (F.sqrt(F.col("_vy") - F.col("_vxy") * F.col("_vxy") / F.col("_vx")) * wide).alias("_sy"))
    stats = stored(stats.where("_sy > 1e-9 * _sx * abs(_tilt)").where("_sy > 0").withColumn("_k", F.monotonically_increasing_id()))
    placed = df.where(there).join(stats, keys) if keys else df.where(there).crossJoin(F.broadcast(stats))  # one row
    u, v = (a - F.col("_mx")) / F.col("_sx"), (b - F.col("_my") - F.col("_tilt") * (a - F.col("_mx"))) / F.col("_sy")
    placed = computed(placed, {"_u": u, "_v": v})
    placed = placed.withColumns({"_cx": F.floor(F.col("_u") * POINT_CELLS), "_cy": F.floor(F.col("_v") * POINT_CELLS)})
    placed = placed.withColumns({"_dx": F.col("_u") - (F.col("_cx") + 0.5) / POINT_CELLS, "_dy": F.col("_v") - (F.col("_cy") + 0.5) / POINT_CELLS})
    schema = "_k long, _cx long, _cy long, _m array<double>"
    cells = placed.select("_k", "_cx", "_cy", "_dx", "_dy").mapInArrow(_cell_sums, schema).repartition("_k", "_cx", "_cy").sortWithinPartitions("_k", "_cx", "_cy")
    # sums of one cell stand together now, so they are handed on whole unless more cells are held than fit
    cells = cells.mapInArrow(_cell_sums, schema).withColumn("_have", F.lit(True))
    across = cells.groupBy("_k", "_cy").applyInArrow(_line_pass("_cx", "_cy", False), f"{schema}, _have boolean")
    local = stored(across.groupBy("_k", "_cx").applyInArrow(_line_pass("_cy", "_cx", True), f"{schema}, _have boolean").drop("_have"))
    powers = np.arange(POINT_ORDER + 1)
    fields = df.schema.fields

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, HELD):
                part = whole.slice(lo, HELD)
                px, py = (part.column(c).to_numpy()[:, None] ** powers / _FACTORIAL[powers] for c in ("_dx", "_dy"))
                m = part.column("_m").flatten().to_numpy().reshape(part.num_rows, len(powers), -1)
                d = np.einsum("nij,ni,nj->n", m, px, py, optimize=True) * part.column("_w").to_numpy()
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in fields], pa.array(d)], [*[f.name for f in fields], out])

    weight = 1 / (F.col("_n") * 2 * math.pi * F.col("_sx") * F.col("_sy"))
    own = placed.select(*df.columns, "_k", "_cx", "_cy", "_dx", "_dy", weight.alias("_w")).join(local, ["_k", "_cx", "_cy"]).drop("_k", "_cx", "_cy")
    dense = own.mapInArrow(read, T.StructType([*fields, T.StructField(out, T.DoubleType())]))
    without = df.where(~there) if not keys else df.where(~there).unionByName(df.where(there).join(stats.select(*keys), keys, "left_anti"))
    if not keys:
        without = without.unionByName(df.where(there & F.lit(stats.isEmpty())))
    return dense.unionByName(without.withColumn(out, F.lit(None).cast("double")))


def density_at_points(df: DataFrame, x: str, y: str, width: float, sigma: float = 2.0, keys=()) -> DataFrame:
    """Position density at every row, read from smoothed bins of side ``width``."""
    h = joint_histogram(df, x, y, width, keys)
    s = smooth_histogram(h, sigma, keys=keys)
    b = df.withColumns({"bx": F.floor(F.col(x) / width), "by": F.floor(F.col(y) / width)})
    return b.join(s, [*keys, "bx", "by"]).drop("bx", "by").withColumnRenamed("smooth", "density")


def density_valleys(grid: DataFrame, keys=("loop_id",)) -> DataFrame:
    """Per group with exactly two peaks: the minima between the higher peak and the last one (keys, x)."""
    w = Window.partitionBy(*keys).orderBy("g")
    up, down = F.lag("density").over(w), F.lead("density").over(w)
    e = grid.withColumns({"_peak": (F.col("density") > up) & (F.col("density") > down), "_pit": (F.col("density") < up) & (F.col("density") < down)})
    x = F.col("x")
    found = e.where("_peak or _pit").groupBy(*keys).agg(
        F.count(F.when(F.col("_peak"), 1)).alias("_n"), F.max(F.when(F.col("_peak"), x)).alias("_last"),
        F.max_by(x, F.when(F.col("_peak"), F.struct(F.col("density"), -x))).alias("_top"), F.collect_list(F.when(F.col("_pit"), x)).alias("_pits"))
    return found.where("_n = 2").select(*keys, F.explode(F.filter("_pits", lambda p: (p < F.col("_last")) & (p > F.col("_top")))).alias("x"))


def valley_threshold(valleys: DataFrame) -> DataFrame:
    """Mean and exact median of the valley positions."""
    from ..sources.tables import stored
    from .quantile import exact_quantiles

    valleys = stored(valleys)
    mean = valleys.agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("valleys"))
    return mean.crossJoin(exact_quantiles(valleys, [], "x", {"median": 0.5}))  # two one-row tables
