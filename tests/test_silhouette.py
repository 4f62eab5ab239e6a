"""Plain-distance silhouettes against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.operators import silhouette


def all_pairs(x, c):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    labels = sorted(set(c))
    sums = np.stack([d[:, c == v].sum(axis=1) for v in labels], axis=1)
    size = np.array([(c == v).sum() for v in labels])
    own = np.searchsorted(labels, c)
    a = sums[np.arange(len(x)), own] / np.maximum(size[own] - 1, 1)
    means = sums / size
    means[np.arange(len(x)), own] = np.inf
    b = means.min(axis=1)
    top = np.maximum(a, b)
    return sums, np.where((size[own] == 1) | (top == 0), 0.0, (b - a) / np.where(top > 0, top, 1))


def table(spark, x, c):
    cols = [f"c{j}" for j in range(x.shape[1])]
    df = spark.createDataFrame([(int(v), *map(float, p)) for v, p in zip(c, x)], "cluster int, " + ", ".join(f"{n} double" for n in cols))
    return df, cols


@pytest.mark.parametrize("dims, n, size, leaf", [(1, 2000, 300, 32), (2, 2000, None, 32), (2, 3000, 400, 100), (3, 3000, 1500, 256)])
def test_sums_and_mean(spark, monkeypatch, dims, n, size, leaf):
    monkeypatch.setattr(silhouette, "LEAF", leaf)
    r = np.random.default_rng(dims + n)
    spread = r.choice([0.01, 1.0, 6.0], n)[:, None]
    x = r.normal(size=(n, dims)) * spread + r.integers(0, 3, (n, 1)) * 4.0
    x[:40] = x[0]  # one place, several clusters
    x[-1] = 1e6  # an outlier
    c = r.integers(0, 4, n) + (x[:, 0] > 3)
    c[5] = 99  # alone
    df, cols = table(spark, x, c)
    sums, labels, sizes = silhouette.distance_sums(df, cols, size=size)
    want_sums, want = all_pairs(x, c)
    assert labels == sorted(set(c)) and sizes == [int((c == v).sum()) for v in labels]
    at = {(int(v), *p): i for i, (v, p) in enumerate(zip(c, x.tolist()))}
    for row in sums.collect():
        assert np.allclose(row["sums"], want_sums[at[(row["cluster"], *(row[k] for k in cols))]], rtol=1e-7, atol=1e-9)
    rows = silhouette.plain_silhouette(df, cols, size=size)
    got = silhouette.mean_silhouette(rows).first()
    assert got["rows"] == n and abs(got["silhouette"] - want.mean()) < 1e-8


def test_awkward_tables(spark):
    x = np.array([[1.0, 1.0]] * 6)
    df, cols = table(spark, x, np.array([0, 0, 0, 1, 1, 1]))
    assert silhouette.mean_silhouette(silhouette.plain_silhouette(df, cols)).first()["silhouette"] == 0.0
    with_null = df.unionByName(df.limit(1).withColumn("c0", F.lit(None).cast("double"))).unionByName(df.limit(1).withColumn("cluster", F.lit(None).cast("int")))
    assert silhouette.mean_silhouette(silhouette.plain_silhouette(with_null, cols)).first()["rows"] == 6
    assert silhouette.plain_silhouette(df.where("cluster = 0"), cols).first()["silhouette"] is None
    assert silhouette.plain_silhouette(df.where("cluster > 9"), cols).count() == 0
    with pytest.raises(ValueError):
        silhouette.distance_sums(df.withColumns({"a": F.lit(1), "b": F.lit(2)}), ["c0", "c1", "a", "b"])


def box_and_neighbours(n):
    """A box of n points and what its eight neighbours of as many points send to it."""
    r = np.random.default_rng(n)
    x, w = r.random((n, 2)), np.ones((n, 1))
    low, high = x.min(axis=0), x.max(axis=0)
    sources, lows, highs, every = [], [], [], [x]
    for shift in [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]:
        y = r.random((n, 2)) + shift
        every.append(y)
        for c in silhouette._Cell(y, w, np.arange(n), 10).seen_from(low, high):
            sources.append(c.stand if silhouette._gap(c.low, c.high, low, high) >= c.width else (y[c.rows], w[c.rows]))
            lows.append(c.low)
            highs.append(c.high)
    return x, w, sources, np.array(lows), np.array(highs), np.concatenate(every)


def test_work_of_a_box_grows_with_its_points(monkeypatch):
    """Sources near a box's border are not summed again by each of its leaves."""
    pairs, plain, per_point = [], silhouette._sums, []
    monkeypatch.setattr(silhouette, "_sums", lambda a, s, k: pairs.append(len(a) * sum(len(p[0]) for p in s)) or plain(a, s, k))
    for n in (2048, 16384):
        x, w, sources, lows, highs, every = box_and_neighbours(n)
        pairs.clear()
        got = silhouette._box_sums(x, w, silhouette._Cell(x, w, np.arange(n), 10), sources, lows, highs, 10)
        per_point.append(sum(pairs) / n)
        some = slice(0, n, n // 50)
        want = np.sqrt(((x[some, None] - every[None]) ** 2).sum(axis=2)).sum(axis=1)
        assert np.allclose(got[some, 0], want, rtol=1e-7)
    assert per_point[1] < 2 * per_point[0]
