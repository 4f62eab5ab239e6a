"""Slope profiles of a tail on an open or closed curve, at its parts and where it crosses given positions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spine import spline_nodes

HALVINGS = 60


def closed_nodes(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``spline_nodes`` for closed curves through p (m, k, 2), k >= 4; also the points. The last point of each gives way to its first.

    Second derivatives solve one cyclic tridiagonal system per curve: open elimination of the system less its corners, for
    the right sides and for the corner vector, then the correction of rank one.
    """
    p = np.concatenate([p[:, :-1], p[:, :1]], axis=1)
    step = np.hypot(*np.moveaxis(np.diff(p, axis=1), 2, 0))
    good = (step > 0).all(axis=1)  # repeated points have no curve
    step = np.where(good[:, None], step, 1.0)
    u = np.concatenate([np.zeros((len(p), 1)), np.cumsum(step, axis=1)], axis=1)
    u = u / u[:, -1:]
    h = np.diff(u, axis=1)
    slope = np.diff(p, axis=1) / h[:, :, None]
    n = h.shape[1]
    before = np.roll(h, 1, axis=1)
    corner = before[:, 0]
    main = 2 * (h + before)
    # corners beta in the first row and last column, and the other way round: the system is open + v w'
    gamma = -main[:, 0]
    open_main = main.copy()
    open_main[:, 0] -= gamma
    open_main[:, -1] -= corner * corner / gamma
    right = np.concatenate([6 * (slope - np.roll(slope, 1, axis=1)), np.zeros((len(p), n, 1))], axis=2)
    right[:, 0, 2], right[:, -1, 2] = gamma, corner
    for i in range(1, n):
        f = h[:, i - 1] / open_main[:, i - 1]
        open_main[:, i] -= f * h[:, i - 1]
        right[:, i] -= f[:, None] * right[:, i - 1]
    right[:, -1] /= open_main[:, -1, None]
    for i in range(n - 2, -1, -1):
        right[:, i] = (right[:, i] - h[:, i, None] * right[:, i + 1]) / open_main[:, i, None]
    ratio = (corner / gamma)[:, None]
    z = right[:, :, 2]
    share = (right[:, 0, :2] + ratio * right[:, -1, :2]) / (1 + z[:, 0] + ratio[:, 0] * z[:, -1])[:, None]
    second = right[:, :, :2] - share[:, None, :] * z[:, :, None]
    second = np.concatenate([second, second[:, :1]], axis=1)
    first = slope - h[:, :, None] * (2 * second[:, :-1] + second[:, 1:]) / 6
    return u, np.concatenate([first, first[:, :1]], axis=1), second, good, p


def _pieces(u: np.ndarray, p: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """Coefficients (m, k - 1, 2) of each piece over its own 0..1, from the constant up."""
    h = np.diff(u, axis=1)[:, :, None]
    return p[:, :-1], h * first[:, :-1], h ** 2 * second[:, :-1] / 2, h ** 2 * np.diff(second, axis=1) / 6


def _derivative_at(u: np.ndarray, first: np.ndarray, second: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First derivatives (m, j, 2) at parameters ``at`` (m, j); outside 0..1 the first and the last piece go on."""
    piece = np.clip((u[:, None, :] <= at[:, :, None]).sum(axis=2) - 1, 0, u.shape[1] - 2)
    row = np.arange(len(u))[:, None]
    h, t = (u[row, piece + 1] - u[row, piece])[:, :, None], (at - u[row, piece])[:, :, None]
    return first[row, piece] + second[row, piece] * t + (second[row, piece + 1] - second[row, piece]) * t ** 2 / (2 * h)


def crossings(u: np.ndarray, p: np.ndarray, first: np.ndarray, second: np.ndarray, levels: Sequence[float]) -> np.ndarray:
    """Parameter, y, dx and dy (m, levels, 4) where each curve first reaches x = level; nan where it never does.

    Each piece is cut where its x turns, so that x is monotone in between; the first part whose ends embrace the level is halved.
    """
    a, b, c, d = _pieces(u, p, first, second)
    m, k = a.shape[:2]
    with np.errstate(invalid="ignore", divide="ignore"):
        q = -(c[..., 0] + np.where(c[..., 0] < 0, -1.0, 1.0) * np.sqrt(c[..., 0] ** 2 - 3 * b[..., 0] * d[..., 0]))
        turns = np.stack([q / (3 * d[..., 0]), b[..., 0] / q], axis=2)
    turns = np.sort(np.where((turns > 0) & (turns < 1), turns, 0.0), axis=2)
    cuts = np.concatenate([np.zeros((m, k, 1)), turns, np.ones((m, k, 1))], axis=2)

    def value(j: int, row, piece, t):
        return a[row, piece, j] + t * (b[row, piece, j] + t * (c[row, piece, j] + t * d[row, piece, j]))

    rows, each = np.arange(m)[:, None], np.arange(k)[None, :]
    x = np.stack([value(0, rows, each, cuts[:, :, j]) for j in range(4)], axis=2)
    out = np.full((m, len(levels), 4), np.nan)
    for j, level in enumerate(levels):
        side = x - level
        found = (side[:, :, :-1] * side[:, :, 1:] <= 0).reshape(m, -1)
        r = np.flatnonzero(found.any(axis=1))
        piece, part = np.divmod(found[r].argmax(axis=1), 3)
        lo, hi = cuts[r, piece, part], cuts[r, piece, part + 1]
        rising = side[r, piece, part] < side[r, piece, part + 1]
        for _ in range(HALVINGS):
            mid = (lo + hi) / 2
            short = (value(0, r, piece, mid) < level) == rising
            lo, hi = np.where(short, mid, lo), np.where(short, hi, mid)
        t, h = (lo + hi) / 2, u[r, piece + 1] - u[r, piece]
        slopes = [(b[r, piece, i] + t * (2 * c[r, piece, i] + 3 * t * d[r, piece, i])) / h for i in (0, 1)]
        out[r, j] = np.stack([u[r, piece] + t * h, value(1, r, piece, t), *slopes], axis=1)
    return out


def tail_profile(df: DataFrame, parts: list[str], keys=("track_id", "frame"), closed: bool = False, levels: Sequence[float] = ()) -> DataFrame:
    """Tangents of the curve through the present parts of every frame (at least 4).

    Arrays per part, null at missing ones: ``dx`` and ``dy`` by the curve's parameter, ``slope`` (dy/dx), ``inverse`` (dx/dy), and
    ``dx_by_x``, ``dy_by_x``, the derivatives at a parameter equal to the part's x. A closed curve returns to its first part instead
    of reaching its last one, which gets the first one's tangent. Per level: ``at`` (parameter), ``y``, ``slope_at`` and ``inverse_at``
    where the curve first has x = level, null if it never has. Frames without a curve have nulls only.
    """
    n, names = len(parts), ("dx", "dy", "dx_by_x", "dy_by_x")
    cols = [f"{p}_{a}" for p in parts for a in "xy"]
    level_names = ("at", "y", "dx_at", "dy_at")
    types = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + [f"{c} array<double>" for c in (*names, *level_names)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pts = b[cols].to_numpy(dtype=float, na_value=np.nan).reshape(len(b), n, 2)
            there = ~np.isnan(pts).any(axis=2)
            out = np.full((4, len(b), n), np.nan)
            crossed = np.full((len(b), len(levels), 4), np.nan)
            codes = there @ (1 << np.arange(n))
            for code in np.unique(codes):
                rows = np.flatnonzero(codes == code)
                idx = np.flatnonzero(there[rows[0]])
                if len(idx) < 4:
                    continue
                p = pts[rows][:, idx]
                x = p[..., 0]
                u, first, second, good, p = closed_nodes(p) if closed else (*spline_nodes(p), p)
                rows = rows[good]
                u, first, second, p, x = (v[good] for v in (u, first, second, p, x))
                for j, v in enumerate(np.moveaxis(np.concatenate([first, _derivative_at(u, first, second, x)], axis=2), 2, 0)):
                    out[j][np.ix_(rows, idx)] = v
                crossed[rows] = crossings(u, p, first, second, levels)
            yield pd.DataFrame({k: b[k].to_numpy() for k in keys} | {c: list(v) for c, v in zip(names, out)}
                               | {c: list(crossed[:, :, j]) for j, c in enumerate(level_names)})

    def present(c: str) -> Column:
        return F.transform(c, lambda v: F.when(~F.isnan(v), v))

    def ratio(above: str, below: str) -> Column:
        return F.zip_with(above, below, lambda y, x: F.try_divide(y, x))

    r = df.select(*keys, *cols).mapInPandas(run, types).withColumns({c: present(c) for c in (*names, *level_names)})
    return r.select(*keys, *names, ratio("dy", "dx").alias("slope"), ratio("dx", "dy").alias("inverse"), "at", "y",
                    ratio("dy_at", "dx_at").alias("slope_at"), ratio("dx_at", "dy_at").alias("inverse_at"))
