"""Intervals to labels without a row per covered frame."""

import pytest
from pyspark.sql import functions as F

from trackspark.operators import intervals

FRAMES = {1: range(0, 60), 2: [3, 4, 9, 10, 40], 3: range(5), 4: []}
BOUTS = [(1, -5, 3), (1, 10, 20), (1, 15, 30), (1, 30, 31), (1, 58, 900), (1, 40, 40), (1, 44, 41), (2, 0, 5), (2, 6, 8), (2, 9, 10), (2, 30, 45), (9, 0, 5), (4, 0, 9)]


@pytest.fixture()
def tables(spark):
    frames = spark.createDataFrame([(t, f, f * 2.0) for t, fs in FRAMES.items() for f in fs], "track_id long, frame long, signal double")
    return frames, spark.createDataFrame(BOUTS, "track_id long, start long, stop long")


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("size", [None, 7])
def test_cover_and_labels(tables, closed, size):
    frames, bouts = tables
    stop = 1 if closed else 0
    want = {(t, f): sum(a <= f < z + stop for b, a, z in BOUTS if b == t and z + stop > a) for t, fs in FRAMES.items() for f in fs}
    got = intervals.cover(frames, bouts, closed=closed, size=size)
    assert {(r.track_id, r.frame): r.covering for r in got.collect()} == want
    labels = intervals.label_frames(frames, bouts, closed=closed, size=size)
    assert labels.columns == ["track_id", "frame", "signal", "manual"]
    assert {(r.track_id, r.frame): r.manual for r in labels.collect()} == {k: int(v > 0) for k, v in want.items()}


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("n", [1, 8, 1000])
def test_bout_rows(tables, closed, n):
    frames, bouts = tables
    last = 0 if closed else 1
    want = sorted((t, f, f * 2.0, a) for t, fs in FRAMES.items() for f in fs for b, a, z in BOUTS if b == t and a <= f <= z - last)
    got = intervals.bout_rows(frames, bouts, closed, bin_frames=n)
    assert sorted(map(tuple, got.select("track_id", "frame", "signal", "start").collect())) == want


def test_hour_long_bouts(spark):
    """Bouts of hours at 10,000 frames a second cost two rows each."""
    hours = 3600 * 10_000
    frames = spark.range(1000).select(F.lit(1).cast("long").alias("track_id"), F.expr(f"id * {hours // 100}").alias("frame"))
    bouts = spark.createDataFrame([(1, h * hours, h * hours + 2 * hours) for h in range(0, 10, 3)], "track_id long, start long, stop long")
    assert intervals.bounds(bouts).count() == 8
    got = intervals.label_frames(frames, bouts)
    assert got.agg(F.sum("manual")).first()[0] == sum(any(h * hours <= f < (h + 2) * hours for h in range(0, 10, 3)) for f in range(0, 1000 * hours // 100, hours // 100))
