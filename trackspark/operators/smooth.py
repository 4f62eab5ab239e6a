"""Smoothing splines of whole tracks: the curve of least squared second derivative within a given sum of squared residuals.

The curve through the points (t, y) of a track that minimises ``sum (y - g)^2 + penalty * integral g''^2`` is a natural cubic spline. Its second
derivatives solve a banded system, two neighbours to each side. Points are numbered per track and dealt by chunks of that number. A chunk
solves its own part by block cyclic reduction, for its right side and for the two unknowns of either neighbour chunk it touches; the few
numbers at its borders make one small block system per track, whose solution goes back to the chunks. The residual grows with the penalty,
so the penalty of a wanted residual is found between two powers of ten by rounds of ``GRID`` penalties at once. Tracks of a single chunk
do all rounds in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, stored
from .chunk import chunk_size, scan, with_halo

#: Powers of ten between which a penalty is looked for. Beyond the upper one double precision no longer carries the system.
LEAST, MOST = -6.0, 10.0
GRID, ROUNDS = 16, 5


def block_solve(low: np.ndarray, mid: np.ndarray, up: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve low[i] x[i-1] + mid[i] x[i] + up[i] x[i+1] = right[i] (... x n x b x b, right ... x n x b x m) by cyclic reduction."""
    n = mid.shape[-3]
    if n == 1:
        return np.linalg.solve(mid, right)
    odd, even = np.s_[..., 1::2, :, :], np.s_[..., 0::2, :, :]
    width = mid.shape[-1]
    done = np.linalg.solve(mid[odd], np.concatenate([low[odd], up[odd], right[odd]], axis=-1))
    l1, u1, f1 = done[..., :width], done[..., width : 2 * width], done[..., 2 * width :]
    evens = (n + 1) // 2

    def beside(a, before):
        """The odd row before (or after) each even one; zero where there is none."""
        out = np.zeros((*a.shape[:-3], evens, *a.shape[-2:]))
        if before:
            out[..., 1:, :, :] = a[..., : evens - 1, :, :]
        else:
            out[..., : a.shape[-3], :, :] = a
        return out

    lo, hi = low[even], up[even]
    x_even = block_solve(-lo @ beside(l1, True), mid[even] - lo @ beside(u1, True) - hi @ beside(l1, False), -hi @ beside(u1, False),
                         right[even] - lo @ beside(f1, True) - hi @ beside(f1, False))
    x = np.empty(right.shape)
    x[even] = x_even
    odds = n // 2
    after = np.zeros((*x_even.shape[:-3], odds, *x_even.shape[-2:]))
    after[..., : evens - 1, :, :] = x_even[..., 1:, :, :]
    x[odd] = f1 - l1 @ x_even[..., :odds, :, :] - u1 @ after
    return x


class _Chunk:
    """Own points ``a`` to ``b`` of the points t, y, which reach up to two further to each side; ``first``, ``last``: a track ends there."""

    def __init__(self, t: np.ndarray, y: np.ndarray, a: int, b: int, first: bool, last: bool):
        m = len(t)
        h = np.diff(t)
        self.y, self.a, self.b = y, a, b
        self.q = np.zeros((3, m))  # second differences: before, at, after
        self.q[0, 1:], self.q[2, :-1] = 1 / h, 1 / h
        self.q[1, 1:-1] = -1 / h[:-1] - 1 / h[1:]
        self.r = np.zeros((2, m))
        self.r[0, 1:-1], self.r[1, :-1] = (h[:-1] + h[1:]) / 3, h / 6
        self.fixed = np.zeros(m, bool)  # no second derivative at the ends of a track
        self.fixed[[i for i, end in ((0, first), (m - 1, last)) if end]] = True
        self.q[:, self.fixed] = 0
        self.r[:, self.fixed] = 0
        self.r[1, :-1][self.fixed[1:]] = 0
        self.right = np.zeros(m)
        self.right[1:-1] = self.q[0, 1:-1] * y[:-2] + self.q[1, 1:-1] * y[1:-1] + self.q[2, 1:-1] * y[2:]

    def bands(self, penalty: np.ndarray) -> list[np.ndarray]:
        """Diagonal and the two bands beside it, penalties x points; band d at i couples i and i + d."""
        q, r, p = self.q, self.r, penalty[:, None]
        out = [r[0] + p * (q * q).sum(axis=0), np.zeros((len(penalty), q.shape[1])), np.zeros((len(penalty), q.shape[1]))]
        out[0][:, self.fixed] = 1
        out[1][:, :-1] = r[1, :-1] + p * (q[1, :-1] * q[0, 1:] + q[2, :-1] * q[1, 1:])
        out[2][:, :-2] = p * q[2, :-2] * q[0, 2:]
        return out

    def solve(self, penalty: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
        """penalties x own points x 5: the solution with no neighbour chunks, and how much each of the two unknowns of the chunk before
        and after take away from it; with their values given (penalties x 2 each), penalties x own points."""
        a, b, g = self.a, self.b, len(penalty)
        bands, n = self.bands(penalty), b - a
        size = n + n % 2
        diagonals = [np.zeros((g, size)) for _ in range(3)]
        for d in range(3):
            diagonals[d][:, : max(0, n - d)] = bands[d][:, a : b - d] if n > d else 0
        diagonals[0][:, n:] = 1
        blocks = (g, size // 2)
        mid, low, up = np.zeros((*blocks, 2, 2)), np.zeros((*blocks, 2, 2)), np.zeros((*blocks, 2, 2))
        mid[..., 0, 0], mid[..., 1, 1] = diagonals[0][:, 0::2], diagonals[0][:, 1::2]
        mid[..., 0, 1] = mid[..., 1, 0] = diagonals[1][:, 0::2]
        up[..., 0, 0], up[..., 1, 1], up[..., 1, 0] = diagonals[2][:, 0::2], diagonals[2][:, 1::2], diagonals[1][:, 1::2]
        low[:, 1:] = np.swapaxes(up[:, :-1], -1, -2)
        right = np.zeros((g, size, 5))
        right[:, :n, 0] = self.right[a:b]
        if a >= 2:
            right[:, 0, 1], right[:, 0, 2] = bands[2][:, a - 2], bands[1][:, a - 1]
            if n > 1:
                right[:, 1, 2] = bands[2][:, a - 1]
        if len(self.y) > b:
            right[:, n - 1, 3] = bands[1][:, b - 1]
            if n > 1:
                right[:, n - 2, 3] = bands[2][:, b - 2]
            if len(self.y) > b + 1:
                right[:, n - 1, 4] = bands[2][:, b - 1]
        if before is not None:
            right = (right[..., 0] - np.einsum("gnk,gk->gn", right[..., 1:3], before) - np.einsum("gnk,gk->gn", right[..., 3:], after))[..., None]
        x = block_solve(low, mid, up, right.reshape(*blocks, 2, -1)).reshape(g, size, -1)[:, :n]
        return x if before is None else x[..., 0]

    def bent(self, second: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """penalties x own points: what a unit of penalty takes from y, by the second derivatives."""
        full = np.concatenate([before[:, 1:], second, after[:, :1]], axis=1)
        q = np.zeros((3, self.b - self.a + 2))
        lo, hi = max(0, self.a - 1), min(len(self.y), self.b + 1)
        q[:, lo - self.a + 1 : hi - self.a + 1] = self.q[:, lo:hi]
        return q[2, :-2] * full[:, :-2] + q[1, 1:-1] * full[:, 1:-1] + q[0, 2:] * full[:, 2:]


def _grid(low: float, high: float) -> np.ndarray:
    return np.linspace(low, high, GRID)


def _narrowed(low: float, high: float, residuals: np.ndarray, target: float, last: bool) -> tuple[float, float]:
    """The cell of the grid in which the residual passes the target; in the last round the place in it, by logarithms."""
    at = _grid(low, high)
    if residuals[0] >= target:
        return at[0], at[0]
    if residuals[-1] <= target:
        return at[-1], at[-1]
    i = int(np.flatnonzero(residuals >= target)[0])
    if last:
        part = np.log(target / max(residuals[i - 1], 1e-300)) / np.log(residuals[i] / max(residuals[i - 1], 1e-300))
        return (at[i - 1] + part * (at[i] - at[i - 1]),) * 2
    return at[i - 1], at[i]


def _whole(t: np.ndarray, y: np.ndarray, target: float, penalty: float | None) -> tuple[np.ndarray, np.ndarray, float]:
    """Values, second derivatives and penalty of a track in one piece."""
    if len(t) < 3:
        return y, np.zeros(len(t)), penalty or 0.0
    c, none = _Chunk(t, y, 0, len(t), True, True), np.zeros((GRID, 2))

    def solved(p):
        second = c.solve(p)[..., 0]
        return second, p[:, None] * c.bent(second, none[: len(p)], none[: len(p)])

    if penalty is None:
        low, high = LEAST, MOST
        for turn in range(ROUNDS):
            if low < high:
                low, high = _narrowed(low, high, (solved(10 ** _grid(low, high))[1] ** 2).sum(axis=1), target, turn + 1 == ROUNDS)
        penalty = 10**low
    second, off = solved(np.array([penalty]))
    return y - off[0], second[0], penalty


def smoothing_spline(df: DataFrame, col: str, residual: float | None = None, penalty: float | None = None, out: str = "smooth",
                     keys=("track_id",), frame: str = "frame", size: int | None = None) -> DataFrame:
    """Add the smoothing spline of ``col``: either with the squared residuals of a track adding up to ``residual`` times its points
    (None: once, which is the usual choice for values of unit noise), or with a fixed ``penalty``.

    Null rows have no weight; they get the curve's value where they lie between points and stay null before a track's first and after
    its last point. A track of fewer than three points gets its values. Where the target lies outside what penalties of 1e-6 to 1e10 give, the
    nearest of these is used: at 1e-6 the curve follows the points, at 1e10 it bends over some 300 frames. One row per frame.
    """
    n = chunk_size(size)
    goal = float("nan") if penalty is not None else 1.0 if residual is None else float(residual)
    names, fixed = list(keys), penalty
    kinds = [df.schema[k] for k in names]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    points = df.where(F.col(col).isNotNull()).select(*names, F.col(frame).cast("long").alias("_t"), F.col(col).cast("double").alias("_y"))
    points = scan(points, {"_i": ("sum", F.lit(1))}, keys=names, frame="_t", size=size).drop("_chunk").withColumn("_i", F.col("_i") - 1)
    counts = points.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    points = stored(points.join(counts, names))

    def arrays(t: pa.Table, *more: str) -> list[np.ndarray]:
        t = t.sort_by("_t")
        return [t.column(c).to_numpy() for c in ("_t", "_y", *more)]

    def keyed(key, **values) -> pa.Table:
        rows = len(next(iter(values.values())))
        return pa.table({**{k: pa.array([v.as_py()] * rows) for k, v in zip(names, key)}, **values})

    def short(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        at, y = arrays(t)
        g, second, _ = _whole(at.astype(float), y, goal * len(y), fixed)
        return keyed(key, _t=at, _g=g, _s=second)

    result = f"{types}, _t long, _g double, _s double"
    curve = points.where(F.col("_n") <= n).groupBy(*names).applyInArrow(short, result)
    long = points.where(F.col("_n") > n)
    if not long.isEmpty():
        # the last rows of a track whose points fill its chunks have no chunk to be copied to
        pieces = stored(with_halo(long, 2, 2, "_i", n).where(F.expr(f"_chunk <= (_n - 1) div {n}")))
        curve = curve.unionByName(_long_curve(pieces, counts.where(F.col("_n") > n), names, types, arrays, keyed, goal, fixed))
    fitted = df.withColumn("_t", F.col(frame).cast("long")).join(curve, [*names, "_t"], "left").drop("_t", "_chunk")
    here = F.when(F.col("_g").isNotNull(), F.struct(F.col(frame).alias("t"), F.col("_g").alias("g"), F.col("_s").alias("s")))
    near = scan(fitted, {"_a": ("last", here), "_b": ("next", here)}, keys=names, frame=frame, size=size)
    h, u, v = F.col("_b.t") - F.col("_a.t"), F.col(frame) - F.col("_a.t"), F.col("_b.t") - F.col(frame)
    between = (v * F.col("_a.g") + u * F.col("_b.g")) / h - u * v / 6 * ((1 + u / h) * F.col("_b.s") + (1 + v / h) * F.col("_a.s"))
    return near.withColumn(out, F.when(F.col("_g").isNotNull(), F.col("_g")).when(h > 0, between)).drop("_a", "_b", "_g", "_s")


def _long_curve(pieces: DataFrame, counts: DataFrame, names: list[str], types: str, arrays, keyed, goal: float, fixed: float | None) -> DataFrame:
    """Curves of tracks of several chunks; ``pieces`` are their points by chunk, with two more from each side."""

    def part(t: pa.Table) -> tuple[np.ndarray, _Chunk, np.ndarray]:
        at, y, i, own, n = arrays(t, "_i", "_own", "_n")
        a = int(np.argmax(own))
        b = a + int(own.sum())
        return at[a:b], _Chunk(at.astype(float), y, a, b, i[0] == 0, i[-1] == n[0] - 1), y[a:b]

    def penalties(state: pa.Table) -> np.ndarray:
        low, high = state.column("_low")[0].as_py(), state.column("_high")[0].as_py()
        return 10 ** (_grid(low, high) if low < high else np.array([low]))

    def edge(key: tuple[pa.Scalar, ...], t: pa.Table, state: pa.Table) -> pa.Table:
        """What the rest of the track needs of a chunk: rows of its first two and last two unknowns."""
        _, c, _ = part(t)
        x = c.solve(penalties(state))
        rows = np.zeros((len(x), 4, 5))
        some = min(2, x.shape[1])
        rows[:, :some], rows[:, 4 - some :] = x[:, :some], x[:, -some:]
        return keyed(key[:-1], _chunk=[key[-1].as_py()], _x=pa.array([rows.ravel()], pa.list_(pa.float64())))

    def join_up(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        """Border unknowns of all chunks of a track; one row of numbers per chunk comes in."""
        t = t.sort_by("_chunk")
        x = np.stack([v.values.to_numpy() for v in t.column("_x")]).reshape(t.num_rows, -1, 4, 5).swapaxes(0, 1)
        low, up = np.zeros((*x.shape[:2], 4, 4)), np.zeros((*x.shape[:2], 4, 4))
        low[..., 2:], up[..., :2] = x[..., 1:3], x[..., 3:]
        low[:, 0], up[:, -1] = 0, 0
        z = block_solve(low, np.broadcast_to(np.eye(4), low.shape).copy(), up, x[..., :1].copy())[..., 0]
        around = np.zeros((*x.shape[:2], 4))  # of the chunk before: its last two; of the one after: its first two
        around[:, 1:, :2], around[:, :-1, 2:] = z[:, :-1, 2:], z[:, 1:, :2]
        return keyed(key, _chunk=t.column("_chunk"), _z=pa.array([a.ravel() for a in around.swapaxes(0, 1)], pa.list_(pa.float64())))

    def inner(t: pa.Table, state: pa.Table):
        at, c, y = part(t)
        p = penalties(state)
        around = state.column("_z")[0].values.to_numpy().reshape(len(p), 4)
        second = c.solve(p, around[:, :2], around[:, 2:])
        return at, y, second, p[:, None] * c.bent(second, around[:, :2], around[:, 2:])

    def off(key: tuple[pa.Scalar, ...], t: pa.Table, state: pa.Table) -> pa.Table:
        return keyed(key[:-1], _off=pa.array([(inner(t, state)[3] ** 2).sum(axis=1)], pa.list_(pa.float64())))

    def values(key: tuple[pa.Scalar, ...], t: pa.Table, state: pa.Table) -> pa.Table:
        at, y, second, taken = inner(t, state)
        return keyed(key[:-1], _t=at, _g=y - taken[0], _s=second[0])

    def narrow(last: bool):
        def fn(batches):
            for b in batches:
                t = pa.Table.from_batches([b])
                rows = zip(*(t.column(c).to_pylist() for c in ("_low", "_high", "_off", "_n")))
                cells = [_narrowed(lo, hi, np.array(r), goal * n, last) if lo < hi else (lo, hi) for lo, hi, r, n in rows]
                yield pa.record_batch({**{k: b.column(k) for k in names}, "_n": b.column("_n"), "_low": pa.array([c[0] for c in cells], pa.float64()), "_high": pa.array([c[1] for c in cells], pa.float64())})
        return fn

    by = [*names, "_chunk"]
    chunks = stored(pieces.select(*by).distinct())  # one row per chunk
    start = (np.log10(fixed),) * 2 if fixed is not None else (LEAST, MOST)
    state = counts.withColumns({"_low": F.lit(float(start[0])), "_high": F.lit(float(start[1]))})

    def around(state: DataFrame) -> DataFrame:
        per_chunk = chunks.join(state, names)
        edges = pieces.groupBy(*by).cogroup(per_chunk.groupBy(*by)).applyInArrow(edge, f"{types}, _chunk long, _x array<double>")
        border = edges.groupBy(*names).applyInArrow(join_up, f"{types}, _chunk long, _z array<double>")
        return per_chunk.join(border, by)

    if fixed is None:
        for turn in range(ROUNDS):
            offs = pieces.groupBy(*by).cogroup(around(state).groupBy(*by)).applyInArrow(off, f"{types}, _off array<double>")
            # a track whose target is out of reach has one penalty left from the first round on
            each = offs.select(*names, F.posexplode("_off")).groupBy(*names, "pos").agg(F.sum("col").alias("o"))
            total = each.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "o"))), lambda e: e["o"]).alias("_off"))
            before, state = state, stored(state.join(total, names).mapInArrow(narrow(turn + 1 == ROUNDS), f"{types}, _n long, _low double, _high double"))
            discard(before)
    return pieces.groupBy(*by).cogroup(around(state).groupBy(*by)).applyInArrow(values, f"{types}, _t long, _g double, _s double")
