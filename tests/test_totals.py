"""Running totals over all data, blocks of chunks, bridges, splits and codes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.operators import fill, select
from trackspark.operators.chunk import running_total, scan


def tracks(spark, **values):
    rows = [(int(k[1:]), i, v) for k, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "track_id long, frame long, signal double")


def test_running_total_and_blocks(spark):
    r = np.random.default_rng(9)
    v = r.integers(0, 9, 500).tolist()
    df = spark.createDataFrame([(f"k{i:04}", x) for i, x in enumerate(v)], "k string, v long").repartition(7)
    got = [x["s"] for x in running_total(df, ["k"], F.col("v"), "s").orderBy("k").collect()]
    assert got == [0, *np.cumsum(v)[:-1].tolist()]
    s = spark.createDataFrame([(1, i, None if i % 7 < 3 or 100 < i < 220 else float(x)) for i, x in enumerate(v)], "track_id int, frame long, v double")
    cols = {"a": ("sum", F.col("v")), "b": ("max", F.col("v")), "c": ("last", F.col("v")), "d": ("next", F.col("v"))}
    one, two = (sorted(map(tuple, scan(s, cols, size=8, **kw).drop("_chunk").collect())) for kw in ({}, {"block": 4}))
    assert one == two


def test_bridges_and_splits(spark):
    df = tracks(spark, t1=[1.0, None], t2=[None, 5.0], t7=[None])
    b = fill.interpolate_bridged(fill.bridge_tracks(df, 2), "signal", block=2, size=2)
    assert [r["signal"] for r in b.orderBy("axis").collect()] == pytest.approx([1 + 4 * i / 5 for i in range(6)] + [5.0] * 5)
    parts = {r["track_id"]: r["part"] for r in select.split_tracks(df, 0.67).collect()}
    assert parts == {1: "train", 2: "train", 7: "test"}
    codes = {r["track_id"]: r["code"] for r in select.encode_labels(df, "track_id").collect()}
    assert codes == {1: 0, 2: 1, 7: 2}
    rare = select.collapse_rare(df.withColumn("track_id", F.col("track_id").cast("string")), "track_id", F.lit(True), least=1)
    assert sorted(r["track_id"] for r in rare.collect()) == ["1", "1", "2", "2", "OTHER"]
