"""Smoothing splines against dense versions."""

import numpy as np
import pytest

from trackspark.operators import smooth


def dense(t, y, penalty):
    """Values, second derivatives by one dense solve."""
    n, h = len(t), np.diff(t)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(1, n - 1):
        q[j - 1 : j + 2, j - 1] = 1 / h[j - 1], -1 / h[j - 1] - 1 / h[j], 1 / h[j]
        r[j - 1, j - 1] = (h[j - 1] + h[j]) / 3
        if j < n - 2:
            r[j - 1, j] = r[j, j - 1] = h[j] / 6
    second = np.linalg.solve(r + penalty * q.T @ q, q.T @ y)
    return y - penalty * q @ second, np.concatenate([[0], second, [0]])


def wave(n, seed, gaps):
    r = np.random.default_rng(seed)
    y = 10 * np.sin(np.arange(n) / 17) + r.normal(0, 1, n)
    for lo, hi in gaps:
        y[lo:hi] = np.nan
    return [None if np.isnan(v) else float(v) for v in y]


def tracks(spark, **values):
    rows = [(int(k[1:]), i, v) for k, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "track_id long, frame long, signal double")


TRACKS = {"t1": wave(400, 1, [(0, 3), (60, 110), (395, 400)]), "t2": wave(35, 2, [(4, 5)]), "t3": wave(97, 3, []), "t4": [1.0, None, 3.0], "t5": [None, 2.0], "t6": [None] * 5, "t7": wave(48, 7, []), "t8": wave(33, 8, [])}


def lines(df):
    p = df.toPandas().sort_values(["track_id", "frame"])
    return {k: g["smooth"].to_numpy(float) for k, g in p.groupby("track_id")}


@pytest.mark.parametrize("size", [None, 16])
def test_fixed_penalty(spark, size):
    got = lines(smooth.smoothing_spline(tracks(spark, **TRACKS), "signal", penalty=500.0, size=size))
    for k in (1, 2, 3, 7, 8):  # 7 fills its chunks, 8 leaves one point for its last
        v = np.array([np.nan if x is None else x for x in TRACKS[f"t{k}"]])
        at = np.flatnonzero(~np.isnan(v))
        g, _ = dense(at.astype(float), v[at], 500.0)
        assert np.allclose(got[k][at], g, atol=1e-7)
        assert np.isnan(got[k][: at[0]]).all() and np.isnan(got[k][at[-1] + 1 :]).all()
        assert not np.isnan(got[k][at[0] : at[-1] + 1]).any()
    # a gap is bridged by one cubic: its fourth differences vanish
    assert np.abs(np.diff(got[1][59:111], 4)).max() < 1e-8
    assert np.allclose(got[4], [1, 2, 3]) and np.allclose(got[5], [np.nan, 2], equal_nan=True) and np.isnan(got[6]).all()


@pytest.mark.parametrize("size", [None, 64])
@pytest.mark.parametrize("residual", [0.5, 1.0])
def test_target(spark, size, residual):
    got = lines(smooth.smoothing_spline(tracks(spark, t1=TRACKS["t1"], t3=TRACKS["t3"]), "signal", residual=residual, size=size))
    for k in (1, 3):
        v = np.array([np.nan if x is None else x for x in TRACKS[f"t{k}"]])
        at = np.flatnonzero(~np.isnan(v))
        assert abs(((v[at] - got[k][at]) ** 2).sum() / len(at) - residual) < 1e-6
        # of the family of curves: the one of the penalty with this residual
        low, high = -6.0, 10.0
        for _ in range(60):
            mid = (low + high) / 2
            off = ((v[at] - dense(at.astype(float), v[at], 10**mid)[0]) ** 2).mean()
            low, high = (mid, high) if off < residual else (low, mid)
        assert np.allclose(got[k][at], dense(at.astype(float), v[at], 10**low)[0], atol=1e-5)


def test_targets_out_of_reach(spark):
    v = np.array(TRACKS["t3"])
    for size in (None, 16):
        follow = lines(smooth.smoothing_spline(tracks(spark, t3=TRACKS["t3"]), "signal", residual=0.0, size=size))[3]
        assert np.allclose(follow, v, atol=1e-4)
        flat = lines(smooth.smoothing_spline(tracks(spark, t3=TRACKS["t3"]), "signal", residual=1e9, size=size))[3]
        x = np.arange(len(v))
        assert np.allclose(flat, np.polyval(np.polyfit(x, v, 1), x), atol=1e-2)


def test_block_solve():
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 7, 8, 33):
        low, up, right = r.normal(size=(2, n, 3, 3)), r.normal(size=(2, n, 3, 3)), r.normal(size=(2, n, 3, 2))
        mid = r.normal(size=(2, n, 3, 3)) + 12 * np.eye(3)
        x = smooth.block_solve(low, mid, up, right)
        back = mid @ x
        back[:, 1:] += low[:, 1:] @ x[:, :-1]
        back[:, :-1] += up[:, :-1] @ x[:, 1:]
        assert np.allclose(back, right)
