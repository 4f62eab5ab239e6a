"""Whole-bout spectra against numpy, in one block and in steps over many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.operators import spectral


def bouts(spark, lengths, seed=1):
    r = np.random.default_rng(seed)
    x = {(t, 10 * t): np.cumsum(r.normal(size=n)) for t, n in enumerate(lengths)}
    rows = [(t, s, n_, i, float(v)) for (t, s), v in x.items() for n_ in [len(v)] for i, v in enumerate(v)]
    return x, spark.createDataFrame(rows, "track_id long, start long, n int, pos int, signal double").repartition(5)


@pytest.mark.parametrize("block", [16, 64, 1 << 18])
def test_magnitudes_of_any_length(spark, block):
    x, df = bouts(spark, [1, 2, 3, 17, 64, 97, 101, 128, 500, 1009])
    got = {}
    for r in spectral.bout_magnitudes(df, "signal", block=block).collect():
        got.setdefault((r.track_id, r.start), {})[r.k] = (r.mag, r.n)
    for key, v in x.items():
        want = np.abs(np.fft.fft(v))[1 : (len(v) - 1) // 2 + 1]
        have = got.get(key, {})
        assert sorted(have) == list(range(1, len(want) + 1)) and all(n == len(v) for _, n in have.values())
        assert np.allclose([have[k][0] for k in sorted(have)], want, rtol=1e-9, atol=1e-9 * max(1, np.abs(v).sum()))


def test_a_bout_of_a_million_frames(spark):
    """Of prime length, in blocks of 2^16 values."""
    n = 1_000_003
    df = spark.range(n).select(F.lit(1).cast("long").alias("track_id"), F.lit(0).cast("long").alias("start"), F.lit(n).alias("n"), F.col("id").alias("pos"),
                               (F.sin(F.col("id") * 0.31) * 5 + F.sin(F.col("id") * F.col("id") * 1e-7) + F.col("id") % 7).alias("signal"))
    i = np.arange(n)
    v = np.sin(i * 0.31) * 5 + np.sin(i.astype(float) * i * 1e-7) + i % 7
    mag = np.abs(np.fft.rfft(v))[1 : (n - 1) // 2 + 1]
    f = np.arange(1, len(mag) + 1) * 40.0 / n
    want = (mag * np.where((f > 1.5) & (f < 5), f * f, 0)).sum() / mag.sum()
    got = spectral.bout_dft_scores(df, "signal", block=1 << 16).collect()
    assert len(got) == 1 and got[0].score == pytest.approx(want, rel=1e-9)


def test_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0, 4, i, None if i == 2 else float(i)) for i in range(4)], "track_id long, start long, n int, pos int, signal double")
    assert [round(r.mag, 9) for r in spectral.bout_magnitudes(df, "signal").collect()] == [round(float(np.abs(np.fft.fft([0, 1, 0, 3]))[1]), 9)]
    assert spectral.bout_magnitudes(df.limit(0), "signal").collect() == []
