"""Kernel densities against plain sums over all values."""

import math

import numpy as np
import pytest

from trackspark.operators import density


def plain_grid(values, step):
    v = np.array(values)
    h = len(v) ** -0.2 * v.std(ddof=1) if len(v) > 1 else 0.0
    if not h > 0:
        return {}
    r = math.ceil(8.5 * h / step) + 2
    at = sorted({int(b) + k for b in np.floor(v / step) for k in range(-r, r + 1)})
    return {i: float(np.exp(-0.5 * ((i * step - v) / h) ** 2).sum() / (len(v) * h * math.sqrt(2 * math.pi))) for i in at}


@pytest.mark.parametrize("step", [0.5, 7.0])
def test_grid(spark, step):
    r = np.random.default_rng(1)
    groups = {"a": r.normal(0, 3, 400), "b": np.concatenate([r.normal(-5, 1, 50), r.normal(30, 2, 80)]), "c": [4.0, 4.0], "d": [1.0], "e": r.exponential(20, 60), None: [0.0, 10.0, 10.0]}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("a", None)], "k string, v double")
    got = density.kde_grid(df, "v", step, ("k",)).collect()
    low = math.floor(min(min(x) for x in groups.values()) / step)
    for k, x in groups.items():
        if k is None:
            continue  # keys are joined, so rows without a key have no density
        mine = {r.g + low: (r.x, r.density) for r in got if r.k == k}
        want = plain_grid(x, step)
        assert mine.keys() == want.keys()
        for i, d in want.items():
            assert mine[i][0] == pytest.approx(i * step)
            assert mine[i][1] == pytest.approx(d, rel=1e-6, abs=1e-25)


def test_one_outlier_changes_nothing_near(spark):
    """A value of 1e9 adds its own few grid points; with a fixed bandwidth all others keep their density."""
    r = np.random.default_rng(2)
    x = r.normal(50, 9, 300)
    one = lambda v: {q.x: q.density * len(v) for q in density.kde_grid(spark.createDataFrame([(float(a),) for a in v], "v double"), "v", 5.0, bandwidth=4.0).collect()}
    without, with_ = one(x), one([*x, 1e9])
    assert len(with_) - len(without) < 30
    assert all(with_[k] == pytest.approx(d, abs=1e-12) for k, d in without.items())


@pytest.mark.parametrize("held", [16, 8192])
def test_at_points(spark, held, monkeypatch):
    monkeypatch.setattr(density, "HELD", held)
    r = np.random.default_rng(4)
    a = r.normal(0, 1, (700, 2)) @ np.array([[3.0, 1.0], [0.0, 0.4]]) + [100, -20]
    b = np.concatenate([r.normal(0, 1, (90, 2)), r.normal(8, 0.2, (60, 2)), np.repeat([[3.0, 3.0]], 50, axis=0)])
    rows = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(a)] + [("b", i, float(x), float(y)) for i, (x, y) in enumerate(b)]
    rows += [("a", 900, None, 1.0), ("c", 0, 1.0, 1.0), ("c", 1, 2.0, 2.0), ("c", 2, 3.0, 3.0), ("d", 0, 5.0, 5.0)]
    got = density.point_density(spark.createDataFrame(rows, "k string, i int, x double, y double"), "x", "y", ("k",)).collect()
    assert len(got) == len(rows)
    have = {(r.k, r.i): r.density for r in got}
    for k, p in (("a", a), ("b", b)):
        cov = np.cov(p.T) * len(p) ** (-1 / 3)
        d = p[:, None] - p[None]
        want = np.exp(-0.5 * np.einsum("ija,ab,ijb->ij", d, np.linalg.inv(cov), d)).sum(axis=1) / (len(p) * 2 * math.pi * math.sqrt(np.linalg.det(cov)))
        assert [have[k, i] for i in range(len(p))] == pytest.approx(list(want), rel=1e-9)
    assert all(have[x] is None for x in (("a", 900), ("c", 0), ("d", 0)))


def test_at_points_without_keys(spark):
    r = np.random.default_rng(5)
    p = r.normal(0, 1, (200, 2))
    df = spark.createDataFrame([(float(x), float(y)) for x, y in np.vstack([p, [[1e6, -1e6]]])], "x double, y double")
    got = {(r.x, r.y): r.density for r in density.point_density(df, "x", "y").collect()}
    q = np.vstack([p, [[1e6, -1e6]]])
    cov = np.cov(q.T) * len(q) ** (-1 / 3)
    d = q[:, None] - q[None]
    want = np.exp(-0.5 * np.einsum("ija,ab,ijb->ij", d, np.linalg.inv(cov), d)).sum(axis=1) / (len(q) * 2 * math.pi * math.sqrt(np.linalg.det(cov)))
    assert [got[float(x), float(y)] for x, y in q] == pytest.approx(list(want), rel=1e-6)
