"""The online position check: order, gaps, repeats, bounded state, restart."""

import datetime

import numpy as np
import pytest

from trackspark.operators.position import walk
from trackspark.streaming import live

SCHEMA = "track_id long, frame long, ts timestamp, x double, y double"
START = datetime.datetime(2024, 1, 1)


def deliver(spark, path, rows, mode="append"):
    data = [(t, f, START + datetime.timedelta(seconds=s), x, y) for t, f, s, x, y in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode(mode).parquet(path)


def plain(points, dist=20, limit=7):
    """Accepted frames of a complete list of (frame, x, y); frames between them are missing."""
    last = max(f for f, _, _ in points)
    x = np.full(last + 1, np.nan)
    y = x.copy()
    for f, a, b in points:
        x[f], y[f] = np.nan if a is None else a, np.nan if b is None else b
    ok = walk(x, y, (float("nan"), float("nan"), 0), dist, limit)[0]
    return {f for f, _, _ in points if ok[f]}


def track(seed, n=120):
    r = np.random.default_rng(seed)
    x = r.normal(0, 5, n).cumsum()
    x[r.random(n) < 0.1] += 300
    return [(f, float(x[f]), 0.0) for f in range(n)]


def result(df, t):
    rows = [r for r in df.collect() if r.track_id == t]
    assert len({r.frame for r in rows}) == len(rows)
    return {r.frame for r in rows if r.x is not None}, {r.frame for r in rows}


@pytest.fixture()
def path(tmp_path):
    return str(tmp_path / "points")


def run(spark, path, base=None, wait="10 seconds", idle=3600.0, files=1):
    return live.run_available(live.position_check(live.read_stream(spark, path, SCHEMA, files), wait=wait, idle=idle), base=base)


def test_gaps_repeats_and_restart(spark, path, tmp_path):
    base = str(tmp_path / "run")
    a, b = track(1), track(2)
    gone = {7, 8, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50}
    first = [(1, f, f, x, y) for f, x, y in a[:60] if f not in gone] + [(2, f, f, x, y) for f, x, y in b[:60]]
    first += [(1, 20, 21, 999.0, 0.0)]  # a repeated frame: the first row counts
    deliver(spark, path, first)
    out = run(spark, path, base)
    ok, seen = result(out, 2)
    assert seen == set(range(60))
    # nothing after the first gap yet, its wait is not over
    assert max(result(out, 1)[1]) < 60
    # a restart from the checkpoint goes on with the same state; the rows come shuffled, one frame is given up
    later = [(t, f, f, x, y) for t, p in ((1, a), (2, b)) for f, x, y in p[60:] if (t, f) != (2, 90)]
    np.random.default_rng(3).shuffle(later)
    deliver(spark, path, [(int(t), int(f), int(s), float(x), float(y)) for t, f, s, x, y in later])
    deliver(spark, path, [(9, 0, 1000, 0.0, 0.0)])  # moves the watermark past all of it
    deliver(spark, path, [(9, 1, 2000, 0.0, 0.0)])
    run(spark, path, base)
    out = spark.read.schema("track_id long, frame long, x double, y double").parquet(f"{base}/out")
    keep_a, keep_b = [p for p in a if p[0] not in gone], [p for p in b if p[0] != 90]
    assert result(out, 1) == (plain(keep_a), {f for f, _, _ in keep_a})
    assert result(out, 2) == (plain(keep_b), {f for f, _, _ in keep_b})


def test_late_rows_and_idle_tracks(spark, path, tmp_path):
    base = str(tmp_path / "run")
    deliver(spark, path, [(1, f, f, 0.0, 0.0) for f in range(5)] + [(1, 7, 7, 0.0, 0.0)])
    deliver(spark, path, [(3, 0, 500, 0.0, 0.0)])
    deliver(spark, path, [(3, 1, 501, 0.0, 0.0)])  # frames 5 and 6 of track 1 are given up, the track is forgotten
    deliver(spark, path, [(1, 6, 6, 0.0, 0.0), (3, 2, 502, 0.0, 0.0)])  # too late
    deliver(spark, path, [(1, 0, 600, 500.0, 0.0), (1, 1, 601, 500.0, 0.0)])  # begins anew
    deliver(spark, path, [(3, 3, 2000, 0.0, 0.0)])
    run(spark, path, base, idle=60.0)
    rows = spark.read.schema("track_id long, frame long, x double, y double").parquet(f"{base}/out").collect()
    assert sorted((r.frame, r.x) for r in rows if r.track_id == 1) == [(0, 0.0), (0, 500.0), (1, 0.0), (1, 500.0), (2, 0.0), (3, 0.0), (4, 0.0), (7, 0.0)]
