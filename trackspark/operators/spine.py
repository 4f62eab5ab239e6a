"""Curves through the spine points of a frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geom import vector_angle, xy


def _moments(u: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Second derivatives at the nodes of the not-a-knot cubic through p (m, k, 2) at u (m, k)."""
    m, k = u.shape
    h = np.diff(u, axis=1)
    a = np.zeros((m, k, k))
    r = np.zeros((m, k, 2))
    slope = np.diff(p, axis=1) / h[:, :, None]
    for i in range(1, k - 1):
        a[:, i, i - 1], a[:, i, i], a[:, i, i + 1] = h[:, i - 1], 2 * (h[:, i - 1] + h[:, i]), h[:, i]
        r[:, i] = 6 * (slope[:, i] - slope[:, i - 1])
    a[:, 0, 0], a[:, 0, 1], a[:, 0, 2] = h[:, 1], -(h[:, 0] + h[:, 1]), h[:, 0]
    a[:, -1, -3], a[:, -1, -2], a[:, -1, -1] = h[:, -1], -(h[:, -2] + h[:, -1]), h[:, -2]
    return np.linalg.solve(a, r)


def spline_nodes(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chord-length parameter, first and second derivatives and validity for p (m, k, 2), k >= 4."""
    step = np.hypot(*np.moveaxis(np.diff(p, axis=1), 2, 0))
    good = (step > 0).all(axis=1)  # repeated points have no curve
    step = np.where(good[:, None], step, 1.0)
    u = np.concatenate([np.zeros((len(p), 1)), np.cumsum(step, axis=1)], axis=1)
    u = u / u[:, -1:]
    second = _moments(u, p)
    h = np.diff(u, axis=1)[:, :, None]
    slope = np.diff(p, axis=1) / h
    first = np.empty_like(p)
    first[:, :-1] = slope - h * (2 * second[:, :-1] + second[:, 1:]) / 6
    first[:, -1] = slope[:, -1] + h[:, -1] * (2 * second[:, -1] + second[:, -2]) / 6
    return u, first, second, good


def spline_path(p: np.ndarray, u: np.ndarray, second: np.ndarray, samples: int) -> np.ndarray:
    """Points of the curve at ``samples`` equal parameter steps (m, samples, 2)."""
    grid = np.linspace(0, 1, samples)
    seg = np.clip((u[:, None, :] <= grid[None, :, None]).sum(axis=2) - 1, 0, u.shape[1] - 2)
    row = np.arange(len(p))[:, None]
    lo, hi = u[row, seg], u[row, seg + 1]
    h = (hi - lo)[:, :, None]
    a, b = (hi - grid)[:, :, None] / h, (grid - lo)[:, :, None] / h
    return (a * p[row, seg] + b * p[row, seg + 1]
            + ((a ** 3 - a) * second[row, seg] + (b ** 3 - b) * second[row, seg + 1]) * h ** 2 / 6)


def spine_curves(df: DataFrame, parts: list[str], keys=("track_id", "frame"), samples: int = 0, inverse: bool = False) -> DataFrame:
    """Interpolating parametric cubic through the present points of every frame (at least 4).

    Adds arrays per part: ``curvature`` (signed), ``tangent`` (cosine to the line from the second to the third part) and
    ``slope`` (dy/dx, or dx/dy) and ``heading`` (degrees of the tangent); null at missing parts. ``samples`` > 0 adds ``path``. Frames are solved in batches that
    share the same present parts.
    """
    n = len(parts)
    cols = [f"{p}_{a}" for p in parts for a in "xy"]
    key_types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [f"{v}{i}" for v in "ctsh" for i in range(n)]
    schema = f"{key_types}, " + ", ".join(f"{c} double" for c in names) + (", px array<double>, py array<double>" if samples else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pts = b[cols].to_numpy(dtype=float, na_value=np.nan).reshape(len(b), n, 2)
            there = ~np.isnan(pts).any(axis=2)
            out = np.full((4, len(b), n), np.nan)
            path = np.full((len(b), samples, 2), np.nan)
            line = pts[:, 2] - pts[:, 1]
            codes = there @ (1 << np.arange(n))
            for code in np.unique(codes):
                rows = np.flatnonzero(codes == code)
                idx = np.flatnonzero(there[rows[0]])
                if len(idx) < 4:
                    continue
                p = pts[rows][:, idx]
                u, d1, d2, good = spline_nodes(p)
                with np.errstate(invalid="ignore", divide="ignore"):
                    speed = np.hypot(d1[..., 0], d1[..., 1])
                    k = (d1[..., 0] * d2[..., 1] - d1[..., 1] * d2[..., 0]) / speed ** 3
                    ref = line[rows][:, None, :]
                    cos = (d1 * ref).sum(axis=2) / np.hypot(ref[..., 0], ref[..., 1]) / speed
                    slope = d1[..., 0] / d1[..., 1] if inverse else d1[..., 1] / d1[..., 0]
                heading = np.degrees(np.arctan2(d1[..., 1], d1[..., 0]))
                for j, v in enumerate((k, cos, slope, heading)):
                    v[~good] = np.nan
                    out[j][np.ix_(rows, idx)] = v
                if samples:
                    path[rows[good]] = spline_path(p, u, d2, samples)[good]
            res = {k: b[k].to_numpy() for k in keys} | {c: out[j, :, i] for j, v in enumerate("ctsh") for i in range(n) for c in [f"{v}{i}"]}
            if samples:
                res |= {"px": list(path[..., 0]), "py": list(path[..., 1])}
            yield pd.DataFrame(res)

    r = df.select(*keys, *cols).mapInPandas(run, schema)
    null = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))
    out = [F.array(*[null(f"{v}{i}") for i in range(n)]).alias(name) for v, name in (("c", "curvature"), ("t", "tangent"), ("s", "slope"), ("h", "heading"))]
    if samples:
        out.append(F.expr("CASE WHEN px[0] IS NOT NULL AND NOT isnan(px[0]) THEN transform(px, (x, i) -> named_struct('x', x, 'y', py[i])) END").alias("path"))
    return r.select(*keys, *out)


def max_curvature(curvature: str = "curvature") -> Column:
    """Largest absolute curvature; null without a curve."""
    return F.array_max(F.transform(curvature, lambda k: F.abs(k)))


def pack(values: str) -> Column:
    """Present values first, then nulls, same length."""
    return F.expr(f"concat(filter({values}, v -> v IS NOT NULL), filter({values}, v -> v IS NULL))")


def tail_slopes(curves: DataFrame, pts: str = "pts", slope: str = "slope") -> Column:
    """Slope profile where parts the gate left out take y/x of the last kept point."""
    last = f"{pts}[array_max(filter(sequence(0, size({pts}) - 1), k -> {pts}[k] IS NOT NULL))]"
    return F.expr(f"transform({slope}, (s, i) -> CASE WHEN {pts}[i] IS NULL THEN try_divide({last}.y, {last}.x) ELSE s END)")


def native_curvature(parts: list[str]) -> Column:
    """Absolute curvature of the inner points from central differences, null at both ends."""
    out = [F.lit(None).cast("double")]
    for a, p, b in zip(parts, parts[1:], parts[2:]):
        (ax, ay), (px, py), (bx, by) = xy(a), xy(p), xy(b)
        dx, dy, ddx, ddy = (bx - ax) / 2, (by - ay) / 2, bx + ax - 2 * px, by + ay - 2 * py
        out.append(F.try_divide(F.abs(dx * ddy - dy * ddx), F.pow(dx * dx + dy * dy, 1.5)))
    return F.array(*out, F.lit(None).cast("double"))


def native_bend(parts: list[str]) -> Column:
    """Angle between the first and the last segment of the spine."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = (xy(p) for p in (parts[0], parts[1], parts[-2], parts[-1]))
    return vector_angle(bx - ax, by - ay, dx - cx, dy - cy)


def spline_bend(heading: str = "heading") -> Column:
    """Angle between the first and the last tangent of the curve, 0..180."""
    return F.expr(f"""transform(array(filter({heading}, t -> t IS NOT NULL)), v -> CASE WHEN size(v) > 1 THEN
        abs(180 - pmod(element_at(v, -1) - element_at(v, 1) + 180, 360)) END)[0]""")
