"""Closed and inverse tail profiles and the head check against plain versions."""

import numpy as np
import pytest
from conftest import column

from trackspark.operators import position, tail

RNG = np.random.default_rng(11)
PARTS = list("abcdefgh")


def frames(spark, pts):
    rows = [(1, i, *[None if np.isnan(v) else float(v) for v in p.ravel()]) for i, p in enumerate(pts)]
    return spark.createDataFrame(rows, "track_id long, frame long, " + ", ".join(f"{c}_{a} double" for c in PARTS for a in "xy"))


def plain_curve(p, closed):
    """Parameters and coefficients (pieces, 4, 2) by one dense system in the coefficients of all pieces."""
    if closed:
        p = np.vstack([p[:-1], p[:1]])
    u = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
    u /= u[-1]
    k = len(p) - 1
    a, r = [], []

    def row(i, values):
        out = np.zeros(4 * k)
        out[4 * i : 4 * i + 4] = values
        return out

    for i in range(k):
        h = u[i + 1] - u[i]
        a += [row(i, [1, 0, 0, 0]), row(i, [1, h, h * h, h ** 3])]
        r += [p[i], p[i + 1]]
        if closed or i < k - 1:
            j = (i + 1) % k
            a += [row(i, [0, 1, 2 * h, 3 * h * h]) - row(j, [0, 1, 0, 0]), row(i, [0, 0, 2, 6 * h]) - row(j, [0, 0, 2, 0])]
            r += [np.zeros(2)] * 2
    if not closed:
        for i in (0, k - 2):
            a.append(row(i, [0, 0, 0, 6]) - row(i + 1, [0, 0, 0, 6]))
            r.append(np.zeros(2))
    return u, np.linalg.lstsq(np.array(a), np.array(r), rcond=None)[0].reshape(k, 4, 2)


def plain_at(u, c, t, order=0):
    i = min(max(int((u <= t).sum()) - 1, 0), len(c) - 1)
    s = t - u[i]
    powers = [1, s, s * s, s ** 3] if order == 0 else [0, 1, 2 * s, 3 * s * s]
    return np.array(powers) @ c[i]


@pytest.mark.parametrize("closed", [False, True])
def test_tail_profile(spark, closed):
    pts = np.cumsum(RNG.normal(2, 3, (40, 8, 2)), axis=1)
    pts[3, 4] = np.nan
    pts[4, 2:6] = np.nan
    pts[5, 1:6] = np.nan  # three parts are no curve
    pts[6, 3] = pts[6, 2]  # nor are repeated ones
    pts[7] = np.nan
    levels = [0.0, 3.0, 10.0, 1e6]
    out = tail.tail_profile(frames(spark, pts), PARTS, closed=closed, levels=levels).orderBy("frame").collect()
    assert len(out) == 40
    for r, p in zip(out, pts, strict=True):
        there = ~np.isnan(p).any(axis=1)
        if r.frame in (5, 6, 7):
            assert all(v is None for name in ("dx", "dy", "slope", "inverse", "dx_by_x", "at", "slope_at") for v in r[name])
            continue
        u, c = plain_curve(p[there], closed)
        tangent = np.array([plain_at(u, c, t, 1) for t in u])
        if closed:
            tangent[-1] = tangent[0]
        assert [v is not None for v in r.slope] == there.tolist()
        for got, want in ((r.dx, tangent[:, 0]), (r.dy, tangent[:, 1]), (r.slope, tangent[:, 1] / tangent[:, 0]), (r.inverse, tangent[:, 0] / tangent[:, 1])):
            assert np.allclose([v for v in got if v is not None], want, rtol=1e-6, atol=1e-6)
        by_x = np.array([plain_at(u, c, x, 1) for x in p[there][:, 0]])
        assert np.allclose([v for v in r.dx_by_x if v is not None], by_x[:, 0], rtol=1e-5, atol=1e-4)
        assert np.allclose([v for v in r.dy_by_x if v is not None], by_x[:, 1], rtol=1e-5, atol=1e-4)
        grid = np.linspace(0, 1, 4001)
        path = np.array([plain_at(u, c, t) for t in grid])
        for j, level in enumerate(levels):
            side = path[:, 0] - level
            passes = np.flatnonzero(side[:-1] * side[1:] <= 0)
            if r["at"][j] is None:
                assert not len(passes)
                continue
            # the curve has the level there, and no sampled passage lies before
            assert abs(plain_at(u, c, r["at"][j])[0] - level) < 1e-6
            assert not len(passes) or r["at"][j] <= grid[passes[0] + 1] + 1e-9
            d = plain_at(u, c, r["at"][j], 1)
            assert np.allclose((plain_at(u, c, r["at"][j])[1], r.slope_at[j] * d[0], r.inverse_at[j] * d[1]), (r.y[j], d[1], d[0]), rtol=1e-5, atol=1e-5)
        assert r["at"][3] is None


def test_crossings_meet_both_turns_of_a_piece():
    """Where x turns twice within a piece, the first of three passages is found."""
    u = np.array([[0.0, 1.0]])
    # x(t) = 12 t^3 - 18 t^2 + 7 t is 0.5 three times between 0 and 1
    p = np.array([[[0.0, 0.0], [1.0, 1.0]]])
    second = np.array([[[-36.0, 0.0], [36.0, 0.0]]])
    first = np.array([[[7.0, 1.0], [7.0, 1.0]]])
    at, y, dx, dy = tail.crossings(u, p, first, second, [0.5])[0, 0]
    roots = np.sort(np.roots([12, -18, 7, -0.5]).real)
    assert len(roots) == 3 and at == pytest.approx(roots[0]) and y == pytest.approx(roots[0]) and dy == pytest.approx(1)
    assert dx == pytest.approx(36 * at * at - 36 * at + 7)


def plain_head(x, y, fits, dist, limit):
    lx = ly = None
    rejects, ok = 0, []
    for a, b, f in zip(x, y, fits, strict=True):
        if lx is None and not np.isnan(a):
            lx, ly = a, b
        good = not np.isnan(a) and f and (rejects > limit or np.hypot(a - lx, b - ly) <= dist)
        if good:
            lx, ly = a, b
        rejects = 0 if good else rejects + 1
        ok.append(good)
    return ok


@pytest.mark.parametrize("warm", [0, 8, 256])
def test_head_check(spark, small_chunks, monkeypatch, warm):
    """Square outlines; tracks that begin outside, begin missing, or have no outline in places, over many chunks."""
    monkeypatch.setattr(position, "WARM_FRAMES", warm)
    rows, want = [], []
    for t in range(4):
        x, y = RNG.normal(0, 8, 300).cumsum(), RNG.normal(0, 8, 300).cumsum()
        x[RNG.random(300) < 0.1] += 150
        x[RNG.random(300) < 0.05] = np.nan
        if t == 1:
            x[:40] = np.nan
        if t == 2:
            x[:] = np.nan
        centre = np.nan_to_num(x) + np.where(RNG.random(300) < 0.25, 90.0, 0.0)
        if t == 0:
            centre[:30] += 400  # the first points lie outside
        none = RNG.random(300) < 0.03
        fits = (np.abs(x - centre) <= 45) & ~none
        want += plain_head(x, y, fits, 20, 7)
        for i in range(300):
            square = None if none[i] else [{"x": float(centre[i] + a), "y": float(y[i] + b)} for a, b in ((-40, -40), (40, -40), (40, 40), (-40, 40))]
            rows.append((t, i, None if np.isnan(x[i]) else float(x[i]), float(y[i]), square))
    df = spark.createDataFrame(rows, "track_id long, frame long, k_x double, k_y double, pts array<struct<x: double, y: double>>")
    got = position.head_check(df, "k", margin=5)
    assert [v is not None for v in column(got, "k_x")] == want
    assert 20 < sum(want) < len(want) and got.columns == ["track_id", "frame", "k_x", "k_y"]
