"""Steps whose time or memory once grew with all rows: what they hand on stays small, results stay those of the plain computation."""

import re

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trackspark.operators import chunk, models, quantile
from trackspark.plans import spectra

RNG = np.random.default_rng(5)


def stump_rows(spark, a, b, y):
    return spark.createDataFrame([(float(p), float(q), int(v)) for p, q, v in zip(a, b, y)], "a double, b double, y int")


def plain_scores(df, rounds, bins=256):
    t = models.vectors(df.withColumns({"label": F.col("y").cast("double"), "weight": F.when(F.col("y") == 1, 9.0).otherwise(1.0)}), ["a", "b"])
    model = GBTClassifier(maxDepth=1, maxIter=rounds, maxBins=bins, weightCol="weight", seed=1).fit(t)
    return model.transform(t).select("a", "b", vector_to_array("probability")[1].alias("score")).distinct().collect()


def test_stumps_read_rows_alike_once(spark, monkeypatch):
    a, b = RNG.integers(0, 9, 3000), RNG.integers(0, 5, 3000)
    df = stump_rows(spark, a, b, (a + b + RNG.normal(0, 2, 3000)) > 7)
    read, fit = [], GBTClassifier.fit
    monkeypatch.setattr(models.GBTClassifier, "fit", lambda self, t: read.append(t.count()) or fit(self, t))
    score = models.boosted_stumps(df, ["a", "b"], "y", rounds=8)
    assert read[0] <= 9 * 5 * 2
    monkeypatch.undo()
    got = {(r.a, r.b): r.score for r in score(df).collect()}
    for r in plain_scores(df, 8):
        assert np.isclose(got[r.a, r.b], r.score)


def test_stumps_in_bins(spark, monkeypatch):
    """More different rows than the limit: a column of many values is binned, one of few is not."""
    monkeypatch.setattr(models, "STUMP_ROWS", 100)
    a, b = RNG.normal(size=2000), RNG.integers(0, 3, 2000)
    df = stump_rows(spark, a, b, a + b > 1.2)
    read, fit = [], GBTClassifier.fit
    monkeypatch.setattr(models.GBTClassifier, "fit", lambda self, t: read.append(t.count()) or fit(self, t))
    score = models.boosted_stumps(df.unionByName(df.limit(1).withColumn("a", F.lit(None).cast("double"))), ["a", "b"], "y", rounds=8, bins=32)
    assert read[0] <= 32 * 3 * 2
    out = score(df)
    assert out.columns == ["a", "b", "y", "score"] and out.count() == 2000
    got = {(r.a, r.b): r.score for r in out.collect()}
    assert np.mean([abs(got[r.a, r.b] - r.score) for r in plain_scores(df, 8, 32)]) < 0.05


def test_weighted_cuts(spark):
    """Bins of about equal weight; a heavy value stands alone; a value on a cut is not on its right."""
    values = [(float(i), 1.0) for i in range(100)] + [(200.0, 900.0)]
    cuts = models._weighted_cuts(spark.createDataFrame(values, "v double, w double"), "v", "w", 10)
    assert cuts == [float(np.nextafter(149.5, np.inf))]
    even = models._weighted_cuts(spark.createDataFrame([(float(i), 2.0) for i in range(100)], "v double, w double"), "v", "w", 4)
    assert even == pytest.approx([24.5, 49.5, 74.5])


def test_sine_sums_leave_one_row_per_group_and_rate(spark, monkeypatch):
    """Rows are not copied per rate; sums of a track of several chunks are put together."""
    monkeypatch.setattr(chunk, "CHUNK_FRAMES", 64)
    monkeypatch.setattr(models, "_sine_steps", lambda rows, value, fit, *a: fit)
    v = {1: 30 * np.sin(0.05 * np.arange(300) + 1) + 70, 2: 30 * np.sin(0.125 * np.arange(100) - 2) + 3}
    df = spark.createDataFrame([(k, i, float(x)) for k in v for i, x in enumerate(v[k])] + [(3, 0, None)], "track_id long, frame long, signal double")
    fit = models.sine_fit(df, "signal")
    assert "Generate" not in fit._jdf.queryExecution().optimizedPlan().toString()
    got = {r.track_id: r for r in fit.collect()}
    assert sorted(got) == [1, 2]
    for k, b, c, d in ((1, 0.05, 1, 70), (2, 0.125, -2, 3)):
        assert np.isclose(got[k].b, b) and abs(got[k].c - c) < 1e-4 and abs(got[k].d - d) < 0.01 and got[k].error < 1e-3


def test_least_on_grid(spark):
    """The grid of the query ``sine_fit`` against single sines, on rows in no order, with a gap and a null."""
    v = RNG.normal(25, 10, 900)
    rows = [(7, i, None if i == 450 else float(x)) for i, x in enumerate(v) if i != 401]
    df = spark.createDataFrame([rows[i] for i in RNG.permutation(len(rows))], "track_id long, frame long, signal double").withColumn("period", F.expr("frame div 400"))
    got = {r.period: r.least for r in spectra._least_on_grid(df).collect()}
    for p in (0, 1, 2):
        t = np.array([i for _, i, x in rows if i // 400 == p and x is not None])
        want = min(np.var(v[t] - 30 * np.sin(b / 200 * t + np.pi * c / 12)) for b in range(1, 41, 2) for c in range(-11, 13))
        assert np.isclose(got[p], want)


def test_quantiles_of_small_groups_count_no_bins(spark, monkeypatch):
    """Small groups are ordered as they are, in as many tasks as there are rows for; large and even groups go other ways to the same result."""
    groups = {"small": RNG.normal(size=40), "tail": np.append(RNG.normal(size=400), 1e9), "even": np.full(500, 2.5),
              "two": np.repeat([1.0, 4.0], [150, 90]), "one": np.array([3.0]), "ties": RNG.integers(0, 5, 300).astype(float)}
    df = spark.createDataFrame([(k, float(x)) for k, xs in groups.items() for x in xs] + [("small", None), (None, 1.0)], "k string, v double")
    qs = {"a": 0.1, "b": 0.5, "c": 0.975}
    for ordered in (None, 50):
        got = {r.k: r for r in quantile.exact_quantiles(df, ["k"], "v", qs, bins=8, ordered=ordered).collect()}
        assert sorted(got) == sorted(groups)
        for k, xs in groups.items():
            assert np.allclose([got[k].a, got[k].b, got[k].c], np.quantile(xs, list(qs.values())))
        alone = quantile.exact_quantiles(df, [], "v", qs, bins=8, ordered=ordered).first()
        assert np.allclose(list(alone), np.quantile(np.append(np.concatenate(list(groups.values())), 1.0), list(qs.values())))
    monkeypatch.setattr(quantile, "TASK_ROWS", 100)
    plan = quantile.exact_quantiles(df, ["k"], "v", qs)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[[^\]]*_v#", plan) and re.search(r"RepartitionByExpression \[k#\d+\], 15", plan)
