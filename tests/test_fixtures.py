"""Hand-computed cases for the quirks of each rule."""

from conftest import column, series
from pyspark.sql import functions as F

from trackspark.operators import clean, evaluate, fill, intervals
from trackspark.operators import series as s


def test_dilation_of_even_size_is_off_centre(spark, small_chunks):
    d = s.dilate(series(spark, [1 if i == 20 else 0 for i in range(41)]), "signal", 10)
    assert [i for i, v in enumerate(column(d, "dilated")) if v == 1] == list(range(15, 25))


def test_fills(spark, small_chunks):
    gaps = [None, None, 2, None, None, 8, None] + [None] * 20 + [1, None]
    t = series(spark, gaps)
    assert column(fill.fill_forward(t, ["signal"]), "signal") == [None, None, 2, 2, 2, 8] + [8] * 21 + [1, 1]
    assert column(fill.fill_backward(t, ["signal"]), "signal") == [2, 2, 2, 8, 8, 8] + [1] * 22 + [None]
    assert column(fill.interpolate_linear(t, "signal"), "signal")[:6] == [None, None, 2, 4, 6, 8]
    assert column(fill.interpolate_linear(t, "signal"), "signal")[-1] == 1
    near = column(fill.interpolate_nearest(t, "signal"), "signal")
    assert near[:6] == [None, None, 2, 2, 8, 8] and near[-1] is None
    assert near[16] == 8 and near[17] == 1


def test_empty_track_stays_empty(spark):
    t = series(spark, [None] * 5)
    for f in (fill.interpolate_linear, fill.interpolate_nearest):
        assert column(f(t, "signal"), "signal") == [None] * 5


def test_local_max_never_sees_the_last_row(spark, small_chunks):
    m = s.local_max(series(spark, [0, 1, 2, 9]), "signal", 2)
    assert column(m, "local_max") == [1, 2, 2, 2]


def test_bout_edges(spark, small_chunks):
    t = series(spark, [0] * 30)
    b = spark.createDataFrame([(1, 0, 2), (1, 2, 4), (1, 3, 6), (1, 9, 9), (1, 27, 99)], "track_id long, start long, stop long")
    got = column(intervals.label_frames(t, b), "manual")
    assert [i for i, v in enumerate(got) if v] == [0, 1, 2, 3, 4, 5, 27, 28, 29]
    assert len(column(intervals.label_frames(t, b, drop_last=1), "manual")) == 29


def test_runs_rebuild_the_series(spark, small_chunks):
    values = [1] * 3 + [0] * 50 + [1] * 1 + [0] * 2 + [1] * 40
    r = intervals.runs(series(spark, values), "signal").orderBy("start").collect()
    assert [(x.signal, x.start, x.stop, x.length) for x in r] == [(1, 0, 2, 3), (0, 3, 52, 50), (1, 53, 53, 1), (0, 54, 55, 2), (1, 56, 95, 40)]


def test_width_filter_drops_the_last_frame(spark, small_chunks):
    k = column(intervals.width_filter(series(spark, [0] + [1] * 20 + [0] + [1] * 13 + [0]), "signal", width=15), "kept")
    assert [i for i, v in enumerate(k) if v] == list(range(1, 20))
    assert sum(column(intervals.width_filter(series(spark, [0] * 5), "signal"), "kept")) == 0


def test_steady_start_counts_from_one(spark, small_chunks):
    valid = [1] * 4 + [0] + [1] * 60
    t = series(spark, valid)
    got = intervals.first_steady_frame(t, F.col("signal") == 1, 50).collect()
    assert [(r.track_id, r.start_frame) for r in got] == [(1, 54)]
    early = intervals.first_steady_frame(series(spark, [1] * 60), F.col("signal") == 1, 50).collect()
    assert early[0].start_frame == 48  # 49 valid frames suffice from the start


def test_last_frame_counts_as_a_miss(spark):
    rows = spark.createDataFrame([(1, 1, False), (1, 0, False), (0, 0, False), (1, 0, True), (0, 0, True)], "auto int, manual int, last boolean")
    c = rows.agg(*evaluate.counts(F.col("auto"), F.col("manual"), F.col("last"))).first()
    assert (c.tp, c.fp, c.tn, c.fn) == (1, 2, 1, 1)


def test_jump_chain_sees_earlier_nulls(spark, small_chunks):
    cols = ", ".join(f"{p}_{a} double" for p in clean.CORE_PARTS for a in "xy")
    base = [100.0] * 10
    base[3] = 25.0
    rows = []
    for i in range(20):
        v = list(base)
        if i == 5:
            v[0] = 200.0  # head x jumps away and back
        if i == 8:
            v[3] = 10.0  # no jump, but below the origin: the row goes
            v[5] = 300.0  # never seen by the later jump rule
        rows.append((1, i, *v))
    t = spark.createDataFrame(rows, f"track_id long, frame long, {cols}")
    out = clean.jump_origin_filter(t, 20, 15).orderBy("frame").collect()
    assert [r.frame for r in out if r.A_head_x is None] == [5, 6, 8]
    assert out[5].A_head_y == 100.0
    # the row is gone before the tail base is looked at, so frame 9 has nothing to jump from
    assert [r.frame for r in out if r.C_tailbase_y is None] == [8]


def test_permutation_is_deterministic_and_complete(spark, small_chunks):
    t = series(spark, list(range(100)))
    a, b = (column(evaluate.shuffled(t, "signal"), "control") for _ in range(2))
    assert a == b and sorted(a) == [float(i) for i in range(100)] and a != sorted(a)


def test_hot_track_matches_whole_window(spark, small_chunks):
    """One track with most rows: chunked numbering and carries equal one window over the track."""
    from pyspark.sql import Window

    from trackspark.operators.chunk import number_frames, scan

    rows = spark.range(3000).select((F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7)).alias("track_id"), (F.col("id") * 7919 % 3000).alias("at"))
    got = number_frames(rows, "track_id", ["at"], {"b": F.expr("at div 100")})
    want = rows.withColumn("want", F.row_number().over(Window.partitionBy("track_id").orderBy("at")) - 1)
    assert got.join(want, ["track_id", "at"]).where("frame <> want").count() == 0
    total = scan(got, {"total": ("sum", F.col("at"))})
    check = total.withColumn("want", F.sum("at").over(Window.partitionBy("track_id").orderBy("frame")))
    assert check.where("total <> want").count() == 0


def test_quantiles_with_one_value_dominating(spark):
    from trackspark.operators.quantile import exact_quantiles

    rows = spark.range(1001).select(F.lit(1).alias("k"), F.when(F.col("id") < 700, 5.0).otherwise(F.col("id") * 1.0).alias("v"))
    r = exact_quantiles(rows, ["k"], "v", {"a": 0.5, "b": 0.7, "c": 0.9995}).first()
    assert (r.a, r.b) == (5.0, 700.0) and abs(r.c - 999.5) < 1e-9


def test_scratch_is_the_shared_folder(spark):
    from trackspark.sources.tables import scratch_dir, stored

    assert scratch_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert stored(spark.range(5)).count() == 5


def test_quantiles_of_a_heavy_tail(spark):
    """One huge value over continuous ones: bins are counted again until a task orders few rows, and the result is exact."""
    import numpy as np
    from trackspark.operators import quantile

    x = np.concatenate([np.random.default_rng(3).random(5000), [1e12, -1e9], np.full(3000, 0.25)])
    df = spark.createDataFrame([(1, float(v)) for v in x], "k long, v double")
    qs = {"a": 0.01, "b": 0.37, "c": 0.5, "d": 0.999}
    for keys in (["k"], []):
        r = quantile.exact_quantiles(df, keys, "v", qs, bins=16, ordered=50).first()
        assert all(abs(r[n] - np.quantile(x, q)) < 1e-12 for n, q in qs.items())


def test_roc_of_a_heavy_tail(spark):
    rows = [(float(i) if i else 1e12, i % 3 == 0) for i in range(2000)]
    df = spark.createDataFrame([(s, int(y)) for s, y in rows], "score double, y int")
    got = evaluate.roc_points(df, "score", "y").orderBy("score").collect()
    assert all((r.tp, r.fp) == (sum(y for s, y in rows if s >= r.score), sum(not y for s, y in rows if s >= r.score)) for r in got[::97])


def test_chunks_of_another_size_are_made_anew(spark):
    from trackspark.operators.chunk import with_chunk

    a = with_chunk(series(spark, range(100)), size=10)
    assert with_chunk(a, size=10) is a
    assert [r[0] for r in with_chunk(a, size=50).groupBy("_chunk").count().orderBy("_chunk").collect()] == [0, 1]
    back = fill.fill_forward(with_chunk(series(spark, [1, None, None, 4, None]), size=2), ["signal"], size=4)
    assert column(back, "signal") == [1, 1, 1, 4, 4]


def test_flat_peaks_count():
    import numpy as np
    from trackspark.operators.spectral import _local_peaks

    m = np.array([[0, 1, 1, 0, 2, 2, 2, 1, 3, 3], [0, 0, 1, 0, 0, 1, 2, 2, 3, 0]], float)
    assert [np.flatnonzero(r).tolist() for r in _local_peaks(m)] == [[1, 5], [2, 8]]


def test_executors_get_the_package(tmp_path):
    """From another folder, without the repository on the workers' path."""
    import os
    import subprocess
    import sys
    import textwrap

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = textwrap.dedent(f"""
        import sys, tempfile
        sys.path.insert(0, {root!r})
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
                 .config("spark.checkpoint.dir", tempfile.mkdtemp()).getOrCreate())
        from __spark_entry__ import queries
        for name in ("freq_score", "hmm_path"):
            print("ROWS", queries()[name](spark, "/root/testdata/sf0.001").count())
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.count("ROWS 6000") == 2, out.stderr[-2000:]


def test_stored_tables_can_be_discarded(spark):
    import os
    from trackspark.sources.tables import discard, stored

    t = stored(spark.range(5))
    assert t.count() == 5 and os.path.isdir(t._scratch)
    discard(t)
    assert not os.path.exists(t._scratch)
