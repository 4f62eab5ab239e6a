"""Sweeps over runs against the rule applied once per combination."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from trackspark.functions import geom as G
from trackspark.operators import clean, evaluate, sweeps
from trackspark.operators.chunk import windowed
from trackspark.sources import bind


def noted(df):
    return windowed(df, lambda w: {"last": F.lead(F.lit(1)).over(w).isNull()}, after=1).drop("_chunk")


def table(df):
    return {r.param_id: (r.p0, r.p1, r.p2, r.tp, r.fp, r.tn, r.fn) for r in df.collect()}


@pytest.mark.parametrize("rows", [64, 1 << 16])
def test_width_sweep(spark, small_chunks, rows, monkeypatch):
    """Runs that end in a chunk, cross one border or several, or fill a track; null scores; scores equal to thresholds."""
    monkeypatch.setattr(sweeps, "ROWS", rows)
    r = np.random.default_rng(3)
    tracks = [np.round(r.normal(0, 3, n).cumsum()) for n in (1, 7, 16, 17, 150, 400)] + [np.zeros(90)]
    data = [(t, i, None if r.random() < 0.01 and len(x) > 20 else float(v), int(r.random() < 0.4)) for t, x in enumerate(tracks) for i, v in enumerate(x)]
    df = noted(spark.createDataFrame(data, "track_id long, frame long, signal double, manual int"))
    lists = {"p0": [5.0, -40.0, -5.0, 0.0], "p1": [4.0, 60.0, 12.0], "p2": [20.0, 3.0, 12.0]}
    want = evaluate.sweep(df, lists, evaluate.width_scorer("signal"), "manual", "last")
    got = sweeps.width_sweep(df, lists, "signal", "manual", "last")
    assert table(got) == table(want) and len(table(got)) == 36
    assert sum(x[3] for x in table(got).values()) > 100


@pytest.mark.parametrize("width", [False, True])
def test_trace_sweep(spark, small_chunks, width):
    p = bind.pose(spark, SF, clean.CORE_PARTS).where("track_id % 3 = 0").withColumn("manual", F.when(F.col("frame") % 7 < 3, 1).otherwise(0))
    p = noted(p)
    first = 3 if width else 2
    rules = ([300.0, 200.0], [300.0, 250.0], [40.0], [250.0, 150.0], [300.0])
    lists = {"p0": [20.0, 45.0], "p1": [90.0, 150.0], **({"p2": [1.0, 15.0]} if width else {}), **{f"p{first + i}": v for i, v in enumerate(rules)}}
    want = evaluate.sweep(p, lists, evaluate.skeleton_scorer(G.operculum_angle(), width), "manual", "last")
    got = sweeps.trace_sweep(p, lists, G.operculum_angle(), "manual", "last", width)
    cols = ["param_id", *lists, "tp", "fp", "tn", "fn"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_empty_table(spark):
    df = spark.createDataFrame([], "track_id long, frame long, signal double, manual int, last boolean")
    got = sweeps.width_sweep(df, {"p0": [1.0], "p1": [2.0], "p2": [3.0]}, "signal", "manual", "last").collect()
    assert [(r.tp, r.fp) for r in got] == [(0, 0)]
