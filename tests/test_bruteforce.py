"""Operators without SQL against plain loops."""

import itertools

import numpy as np
import pytest
from conftest import column
from pyspark.sql import functions as F

from trackspark.operators import graph, hmm, models, position, ring, spectral, spine

RNG = np.random.default_rng(5)


def plain_check(x, y, dist, limit):
    lx = ly = None
    rejects, ok = 0, []
    for a, b in zip(x, y):
        if np.isnan(a):
            ok.append(False)
            rejects += 1
        elif lx is None or not (np.hypot(a - lx, b - ly) > dist and rejects <= limit):
            lx, ly, rejects = a, b, 0
            ok.append(True)
        else:
            ok.append(False)
            rejects += 1
    return ok


@pytest.fixture(scope="module")
def walkers():
    out = []
    for t in range(3):
        x, y = RNG.normal(0, 6, 400).cumsum(), RNG.normal(0, 6, 400).cumsum()
        far = RNG.random(400) < 0.15
        x[far] += 200
        x[100:125] += 500
        x[RNG.random(400) < 0.05] = np.nan
        x[0] = 0
        out.append((t, x, y))
    return out


def table(spark, walkers):
    return spark.createDataFrame([(t, i, None if np.isnan(a) else float(a), float(b)) for t, x, y in walkers for i, (a, b) in enumerate(zip(x, y))],
                                 "track_id long, frame long, x double, y double")


@pytest.mark.parametrize("warm", [0, 8, 256])
def test_position_check(spark, small_chunks, monkeypatch, walkers, warm):
    monkeypatch.setattr(position, "WARM_FRAMES", warm)  # without a warm-up many chunks start from a wrong state
    got = position.position_check(table(spark, walkers), "x", "y", 20, 7)
    want = [ok for _, x, y in walkers for ok in plain_check(x, y, 20, 7)]
    assert [v is not None for v in column(got, "x")] == want


def test_stream_position_check(spark, tmp_path, walkers):
    from trackspark.streaming import live

    for step in range(4):
        part = table(spark, walkers).where(F.expr(f"frame div 100 = {step}"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.read_stream(spark, str(tmp_path / "in"), table(spark, walkers).schema, files_per_batch=1)
    got = live.run_available(live.position_check(stream, max_dist=20))
    want = [ok for _, x, y in walkers for ok in plain_check(x, y, 20, 7)]
    assert [v is not None for v in column(got, "x")] == want


def test_stream_position_check_in_any_order(spark, tmp_path, walkers):
    """Files that bring later frames first change nothing."""
    from trackspark.streaming import live

    for step in (2, 0, 3, 1):
        table(spark, walkers).where(F.expr(f"frame div 100 = {step}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.read_stream(spark, str(tmp_path / "in"), table(spark, walkers).schema, files_per_batch=1)
    want = [ok for _, x, y in walkers for ok in plain_check(x, y, 20, 7)]
    assert [v is not None for v in column(live.run_available(live.position_check(stream, max_dist=20)), "x")] == want


def plain_spline(p):
    """Not-a-knot cubic by one dense system in monomial coefficients per segment."""
    u = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
    u /= u[-1]
    k = len(u)
    a, r = [], []

    def row(seg, powers):
        v = np.zeros(4 * (k - 1))
        v[4 * seg:4 * seg + 4] = powers
        return v
    for i in range(k - 1):
        h = u[i + 1] - u[i]
        a += [row(i, [1, 0, 0, 0]), row(i, [1, h, h ** 2, h ** 3])]
        r += [p[i], p[i + 1]]
        if i < k - 2:
            a += [row(i, [0, 1, 2 * h, 3 * h * h]) - row(i + 1, [0, 1, 0, 0]), row(i, [0, 0, 2, 6 * h]) - row(i + 1, [0, 0, 2, 0])]
            r += [np.zeros(2)] * 2
    for i in (0, k - 3):
        a.append(row(i, [0, 0, 0, 6]) - row(i + 1, [0, 0, 0, 6]))
        r.append(np.zeros(2))
    c = np.linalg.lstsq(np.array(a), np.array(r), rcond=None)[0].reshape(k - 1, 4, 2)
    h = u[-1] - u[-2]
    d1 = np.vstack([c[:, 1], c[-1, 1] + 2 * c[-1, 2] * h + 3 * c[-1, 3] * h * h])
    d2 = np.vstack([2 * c[:, 2], 2 * c[-1, 2] + 6 * c[-1, 3] * h])
    return (d1[:, 0] * d2[:, 1] - d1[:, 1] * d2[:, 0]) / np.hypot(*d1.T) ** 3, d1


def test_spline_curvature(spark):
    parts = list("abcdefgh")
    pts = np.cumsum(RNG.uniform(1, 5, (12, 8, 2)), axis=1)
    pts[3, 4] = np.nan
    pts[4, 2:5] = np.nan
    pts[5, 1:6] = np.nan
    rows = [(1, i, *[None if np.isnan(v) else float(v) for v in p.ravel()]) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "track_id long, frame long, " + ", ".join(f"{c}_{a} double" for c in parts for a in "xy"))
    out = spine.spine_curves(df, parts, samples=50).orderBy("frame").collect()
    for r, p in zip(out, pts):
        there = ~np.isnan(p).any(axis=1)
        if there.sum() < 4:
            assert all(v is None for v in r.curvature) and r.path is None
            continue
        k, d1 = plain_spline(p[there])
        assert np.allclose([v for v in r.curvature if v is not None], k, rtol=1e-6, atol=1e-9)
        assert np.allclose([v for v in r.slope if v is not None], d1[:, 1] / d1[:, 0])
        assert [v is not None for v in r.curvature] == list(there)
        assert np.allclose(r.path[0], p[there][0]) and np.allclose(r.path[-1], p[there][-1])


def plain_peak(mag, f):
    low = mag[2:] / mag[2:].max()
    peaks = [i for i in range(1, len(low) - 1) if low[i] > low[i - 1] and low[i] > low[i + 1] and low[i] >= 0.2]
    kept = []
    for i in sorted(peaks, key=lambda i: -low[i]):
        if all(abs(i - j) >= 3 for j in kept):
            kept.append(i)
    w = lambda v: 0 if v > 10 or v <= 2 else min(v, 5)
    amp = min(1, mag[(f > 2) & (f < 10)].max() / 3) ** 2
    return max((w(f[i + 2]) * low[i] for i in kept), default=0) * amp


def test_peak_scores():
    f = np.fft.rfftfreq(70, 1 / 40)
    mags = RNG.random((300, 36)) * 4
    assert np.allclose(spectral.peak_scores(mags, f), [plain_peak(m, f) for m in mags])


def test_sine_is_found(spark, small_chunks):
    wave = [40 * np.sin(2 * np.pi * 2.5 * i / 40) if i < 200 else 0.0 for i in range(300)]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(wave)], "track_id long, frame long, signal double")
    got = column(spectral.frequency_scores(df, "signal"), "peak_score")
    assert got[:35] == [None] * 35 and got[-34:] == [None] * 34 and got[34 + 1] is not None
    assert 2.2 < got[100] < 3.2 and got[255] == 0


def plain_segments(flags, shortest):
    n, runs = len(flags), [[flags[0], 0]]
    for v in flags:
        if v != runs[-1][0]:
            runs.append([v, 0])
        runs[-1][1] += 1
    cut = 0
    if len(runs) > 1 and runs[0][0] == runs[-1][0]:
        cut = runs.pop()[1]
        runs[0][1] += cut
    ring_pos, label, waiting = [], None, 0
    for v, length in runs:
        if length >= shortest and v != label:
            ring_pos.append([v, length + (waiting if label is None else 0)])
            label = v
        elif label is None:
            waiting += length
        else:
            ring_pos[-1][1] += length
    if not ring_pos:
        return None
    ring_pos[0][1] -= cut
    if cut and ring_pos[-1][0] != ring_pos[0][0]:
        ring_pos.append([ring_pos[0][0], cut])
    elif cut:
        ring_pos[-1][1] += cut
    assert sum(length for _, length in ring_pos) == n
    return [(bool(v), length) for v, length in ring_pos]


def test_ring_segments(spark):
    rings = []
    for _ in range(200):
        flags = []
        while len(flags) < 40:
            flags += [bool(RNG.integers(2))] * int(RNG.integers(1, 12))
        rings.append(flags[:40])
    rings = [r for r in rings if len(set(r)) > 1]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], "frame long, flags array<boolean>").withColumn("runs", ring.ring_runs("flags"))
    out = ring.merge_short_runs(df, "runs", "segs", "size(flags)", 5).orderBy("frame").collect()
    for row, r in zip(out, rings):
        want = plain_segments(r, 5)
        assert (None if row.segs is None else [(s.v, s.len) for s in row.segs]) == want


def plain_cooldown(flags, wait):
    ins, outs, flag, since = [], [], flags[0], wait + 1
    for i, v in enumerate(flags):
        if v != flag and (since > wait or (flags[0] and flag)):
            (ins if v else outs).append(i)
            flag, since = v, 0
        else:
            since += 1
    a, b = (outs[0] if outs else -1), (outs[-1] if len(outs) > 1 else -1)
    out1, out2 = (b, a) if flags[0] else (a, b)
    return ins[0] if ins else -1, out1, ins[1] if len(ins) > 1 else -1, out2


def test_ring_cooldown(spark):
    rings = [[bool(v) for v in RNG.random(40) < 0.5] for _ in range(100)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], "frame long, flags array<boolean>")
    out = ring.anchors_by_cooldown(df, "flags", 4).orderBy("frame").collect()
    assert [(r.in1, r.out1, r.in2, r.out2) for r in out] == [plain_cooldown(r, 4) for r in rings]


def test_ring_anchors(spark):
    flags = [True] * 12 + [False] * 8 + [True] * 3 + [False] * 2 + [True] * 9 + [False] * 10 + [True] * 2
    df = spark.createDataFrame([(0, flags), (1, [True] * 20 + [False] * 26)], "frame long, flags array<boolean>").withColumn("runs", ring.ring_runs("flags"))
    a, b = ring.anchors_by_runs(df, "runs", "size(flags)", 5).orderBy("frame").collect()
    # segments 12 valid, 8 not, 14 valid (short runs are valid), 10 not, 2 closing the seam
    assert (a.out2, a.in1, a.out1, a.in2) == (12, 20, 34, 44)
    assert b.in1 is None


def test_ring_ends(spark):
    n = 120
    t = 2 * np.pi * np.arange(n) / n
    x, y = 100 * np.cos(t), 20 * np.sin(t)  # tips at 0 and 60
    pts = [(float(a), float(b)) for a, b in zip(np.roll(x, 10), np.roll(y, 10))]
    df = spark.createDataFrame([(1, pts, 72)], "frame long, pts array<struct<x:double,y:double>>, head_idx int")
    r = ring.locate_ends(df, shortest=10, tail_step=12, head_step=18, blur=6).first()
    assert abs(r.head_at - 70) <= 1 and abs(r.tail_at - 10) <= 1


def test_hmm_against_enumeration():
    m = hmm.gaussian_start(np.array([[0.0, 0], [2, 1], [-1, 2]]), np.stack([np.eye(2)] * 3), sticky=0.5)
    for trial in range(5):
        x = RNG.normal(size=(7, 2)) * 2
        lb = m.emission.log_prob(x)
        paths = list(itertools.product(range(3), repeat=7))
        score = np.array([np.log(m.start[p[0]]) + lb[0, p[0]] + sum(np.log(m.trans[p[i - 1], p[i]]) + lb[i, p[i]] for i in range(1, 7)) for p in paths])
        total = np.logaddexp.reduce(score)
        prod = hmm.chunk_product(m, x, True, False)
        assert np.isclose(np.logaddexp.reduce((np.log(m.start)[:, None] + prod).ravel()), total)
        weight = np.exp(score - total)
        gamma, xi = hmm.chunk_posterior(m, x, True, m.start, np.ones(3))
        want = np.array([[sum(w for w, p in zip(weight, paths) if p[i] == k) for k in range(3)] for i in range(7)])
        assert np.allclose(gamma, want)
        assert np.allclose(xi, [[sum(w * sum(p[i] == a and p[i + 1] == b for i in range(6)) for w, p in zip(weight, paths)) for b in range(3)] for a in range(3)])
        assert tuple(hmm.chunk_best(m, x, True, np.log(m.start), None)) == paths[score.argmax()]
        assert np.isclose(hmm.track_posterior(m, x)[2], total)


@pytest.mark.parametrize("emission", ["full", "mixture", "codes"])
def test_tracks_side_by_side_are_tracks_alone(emission):
    """Tracks of many lengths in one batch give the sums, likelihoods and paths of one track after the other, a track of one frame too."""
    lengths = np.array([1, 40, 7, 40, 23, 2, 1, 31, 40, 12, 9, 38, 5, 17, 40, 3, 28, 33, 1])
    starts = np.cumsum(lengths) - lengths
    x = RNG.normal(size=(2, lengths.sum())) * 2 if emission != "codes" else RNG.integers(0, 4, (1, lengths.sum())).astype(float)
    means, covs = np.array([[0.0, 0], [2, 1], [-1, 2]]), np.stack([np.eye(2)] * 3)
    m = hmm.gaussian_start(means, covs, sticky=0.5) if emission == "full" else hmm.mixture_start(means, covs) if emission == "mixture" else hmm.categorical_start(3, 4)
    groups = list(hmm._grouped(starts, lengths))
    assert sorted(i for part, _ in groups for i in part) == list(range(len(lengths)))
    got = sum(hmm._track_sums(m, own.T, lanes) for own, lanes in hmm._cut(x, starts, lengths))
    want = sum(hmm._track_sums(m, x[:, a : a + n].T, None) for a, n in zip(starts, lengths))
    assert np.allclose(got, want)
    for part, lanes in groups:
        own = x[:, lanes.rows].T
        gamma, _, ll = hmm._lane_posterior(m, own, lanes)
        path = hmm._lane_best(m, own, lanes)
        for b, i in enumerate(part):
            alone = x[:, starts[i] : starts[i] + lengths[i]].T
            on = np.flatnonzero(lanes.track == b)
            assert np.allclose(gamma[:, on].T, hmm.track_posterior(m, alone)[0]) and np.isclose(ll[b], hmm.track_posterior(m, alone)[2])
            assert path[on].tolist() == hmm.chunk_best(m, alone, True, np.log(m.start), None).tolist()


@pytest.mark.parametrize("emission", ["full", "diagonal", "mixture", "codes"])
def test_blocks_give_the_sums_of_tracks(emission):
    """Sums of a fit from blocks of tracks, whose squares and products are shared, equal those of one track after the other: models on all columns and on
    some of them in another order, far from the origin, with states so narrow or so far off that digits would be lost, with a state that cannot be reached."""
    lengths = np.array([40, 40, 40, 38, 33, 31, 28, 23, 17, 12, 9, 7, 5, 3, 2, 1, 1, 1])
    lanes, n, compared = hmm._Lanes(np.cumsum(lengths) - lengths, lengths), lengths.sum(), 0
    for offset, width in ((0.0, 1.0), (1e3, 1.0), (0.0, 1e-6), (40.0, 1.0)):
        x = RNG.normal(size=(3, n)) * 2 + (0 if offset == 40 else offset) if emission != "codes" else RNG.integers(0, 4, (3, n)).astype(float)
        models = []
        for at in ([0, 1, 2], [2, 0], [1]):
            means, covs = np.arange(9.0).reshape(3, 3)[:, at] % 4 - 1 + offset, np.stack([np.eye(len(at)) * width * (1 + s) for s in range(3)])
            gauss = hmm.gaussian_start(means, covs, sticky=0.5, diagonal=emission == "diagonal")
            models.append(gauss if emission in ("full", "diagonal") else hmm.mixture_start(means, covs) if emission == "mixture" else hmm.categorical_start(3, 4))
            if emission == "codes":
                break
            shut = hmm.HMM(np.array([0.0, 0.5, 0.5]), np.array([[1.0, 0, 0], [0, 0.5, 0.5], [0, 1e-9, 1 - 1e-9]]), models[-1].emission)
            models.append(shut)
        used = [[0]] if emission == "codes" else [at for at in ([0, 1, 2], [2, 0], [1]) for _ in range(2)]
        got = hmm._block_sums(models, used, x, lanes)
        for model, at, sums in zip(models, used, got):
            want = sum(hmm._track_sums(model, x[at][:, np.flatnonzero(lanes.track == t)].T, None) for t in range(len(lengths)))
            if np.isfinite(want).all():  # a state that cannot be reached may be the only one that fits
                assert np.allclose(sums, want, rtol=1e-7, atol=1e-7)
                compared += 1
    assert compared >= (4 if emission == "codes" else 20)
    alone = hmm._block_sums(models[:1], used[:1], x[:, : lengths[0]], None)[0]
    assert np.allclose(alone, hmm._track_sums(models[0], x[used[0]][:, : lengths[0]].T, None))


def test_lone_and_lane_tracks_decode_alike(spark, monkeypatch):
    """Long tracks run alone, short ones side by side, tracks without a key are left out; results do not depend on it."""
    rows = [(t, i, float(v)) for t, n in ((1, 300), (2, 290), (3, 5), (4, 1), (None, 9)) for i, v in enumerate(RNG.normal(size=n) * 3)]
    df = spark.createDataFrame(rows, "track_id long, frame long, a double")
    m = hmm.gaussian_start(np.array([[-2.0], [2.0]]), np.ones((2, 1, 1)))
    read = lambda: [sorted(map(str, hmm.decode(df, ["a"], m, how).collect())) for how in ("best", "posterior")]
    alone = read()
    both = hmm.decode(df, ["a"], m, ("smooth", "posterior"))
    assert both.columns == ["track_id", "frame", "smooth", "state"] and both.count() == 596
    monkeypatch.setattr(hmm, "LANES", 1)
    assert read() == alone and len(alone[0]) == 596


@pytest.mark.parametrize("size", [3, 100])
def test_hmm_path_does_not_splice_ties(spark, size):
    """Two equal emissions and a forced alternation: both best paths are possible, a mixture of them is not."""
    m = hmm.HMM(np.array([0.5, 0.5]), np.array([[0.0, 1.0], [1.0, 0.0]]), hmm.CategoricalEmission(np.array([[1.0], [1.0]])))
    df = spark.createDataFrame([(1, i, 0.0) for i in range(20)], "track_id long, frame long, code double")
    got = column(hmm.decode(df, ["code"], m, size=size), "state")
    assert got in ([0, 1] * 10, [1, 0] * 10)


def test_fits_together_are_fits_alone(spark):
    x = np.where(np.repeat([0, 1, 0], 70)[:, None] == 0, [0.0, 0.0], [4.0, 3.0]) + RNG.normal(size=(210, 2))
    df = spark.createDataFrame([(t, i, float(a), float(b)) for t in range(3) for i, (a, b) in enumerate(x[t * 30:])], "track_id long, frame long, a double, b double")
    jobs = [(["a", "b"], hmm.gaussian_start(np.array([[1.0, 1.0], [3.0, 2.0]]), np.stack([np.eye(2)] * 2))), (["b"], hmm.gaussian_start(np.array([[0.0], [2.0]]), np.ones((2, 1, 1))))]
    both = hmm.fit_many(df, ["a", "b"], jobs, rounds=60)
    for (cols, start), got in zip(jobs, both):
        alone = hmm.fit(df, cols, start, rounds=60)
        assert np.allclose(alone.trace, got.trace) and np.allclose(alone.trans, got.trans)
        # the last value of the trace belongs to the parameters returned
        assert np.isclose(hmm.log_likelihood(df, cols, got).agg(F.sum("ll")).first()[0], got.trace[-1])
        counted = {(r.state): r.size for r in hmm.state_counts(df.withColumn("y", F.lit(1)), ["a", "b"], [(cols, got)], "y").collect()}
        decoded = column(hmm.decode(df, cols, got), "state")
        assert counted == {k: decoded.count(k) for k in range(2) if k in counted or decoded.count(k)} | {k: 0 for k in counted if not decoded.count(k)}


def test_mixture_likelihood_rises(spark):
    x = np.concatenate([RNG.normal(-4, 1, 80), RNG.normal(0, 1, 80), RNG.normal(6, 1, 80)])
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "track_id long, frame long, a double")
    m = hmm.fit(df, ["a"], hmm.mixture_start(np.array([[-1.0], [5.0]]), np.full((2, 1, 1), 4.0)), rounds=40)
    assert all(b >= a - 1e-6 for a, b in zip(m.trace, m.trace[1:])) and len(m.trace) > 3
    assert sorted(np.round(m.emission.means.ravel()))[0] == -4


def test_spectral_clusters_are_k(spark):
    """An outlier does not squeeze the others; k clusters come out for every k and separate blobs are found."""
    pts = [(0, i, float(a), float(b)) for i, (a, b) in enumerate(np.concatenate([RNG.normal(c, 0.15, (60, 2)) for c in ((0, 0), (3, 0), (0, 3))]))] + [(1, 0, 50.0, 50.0)]
    df = spark.createDataFrame(pts, "track_id long, frame long, a double, b double")
    out = graph.spectral_clusters(df, ["a", "b"], [2, 3, 4, 5]).toPandas()
    assert [out[f"cluster_{k}"].nunique() for k in (2, 3, 4, 5)] == [2, 3, 4, 5]
    blobs = out[out.track_id == 0].sort_values("frame").cluster_4.to_numpy().reshape(3, 60)
    assert all(len(set(b)) == 1 for b in blobs) and len({b[0] for b in blobs}) == 3


def test_hmm_over_chunks(spark, monkeypatch):
    """Chunked fits equal unchunked ones, the likelihood never falls and known states are found."""
    monkeypatch.setattr(hmm, "GROUP", 3)
    state = np.repeat([0, 1, 0, 1, 0], 60)
    x = np.where(state[:, None] == 0, [0.0, 0.0], [4.0, 3.0]) + RNG.normal(size=(300, 2))
    df = spark.createDataFrame([(t, i, float(a), float(b)) for t in range(2) for i, (a, b) in enumerate(x[t * 50:])], "track_id long, frame long, a double, b double")
    start = hmm.gaussian_start(np.array([[1.0, 1.0], [3.0, 2.0]]), np.stack([np.eye(2)] * 2))
    whole = hmm.fit(df, ["a", "b"], start, rounds=4, tol=-1)
    chunked = hmm.fit(df, ["a", "b"], start, rounds=4, tol=-1, size=16)
    assert len(whole.trace) == 5
    assert np.allclose(whole.trace, chunked.trace) and np.allclose(whole.trans, chunked.trans)
    assert all(b >= a - 1e-6 for a, b in zip(whole.trace, whole.trace[1:]))
    best = hmm.decode(df.where("track_id = 0"), ["a", "b"], chunked, size=16)
    assert np.mean(np.array(column(best, "state")) == state) > 0.97
    assert column(best, "state") == column(hmm.decode(df.where("track_id = 0"), ["a", "b"], chunked), "state")
    smooth = column(hmm.decode(df.where("track_id = 0"), ["a", "b"], chunked, "smooth", size=16), "smooth")
    assert np.allclose(np.array(smooth)[70], chunked.emission.means[1], atol=0.2)


def test_common_kmeans_rounds_are_spark_fits(spark):
    """Restarts in common passes end at the centres and costs of Spark's own fits from the same seeds, with weights too."""
    from pyspark.ml.clustering import KMeans

    x = np.concatenate([RNG.normal(c, 0.6, (80, 2)) for c in ((0, 0), (3, 0), (0, 3), (4, 4))])
    df = spark.createDataFrame([(float(a), float(b), float(1 + i % 3)) for i, (a, b) in enumerate(x)] + [(None, 1.0, 1.0)], "a double, b double, w double").persist()
    v = models.vectors(df, ["a", "b"]).persist()
    for k, weight in ((2, None), (3, None), (4, "w")):
        more = {"weightCol": weight} if weight else {}
        fits = [KMeans(k=k, seed=1 + i, featuresCol="features", maxIter=100, **more).fit(v) for i in range(3)]
        want = min(fits, key=lambda m: m.summary.trainingCost)
        got = models.fit_kmeans_many(df, ["a", "b"], [k], restarts=3, weight=weight)[0]
        assert np.allclose(sorted(map(tuple, got)), sorted(map(tuple, want.clusterCenters())), atol=1e-6)
        order = sorted(range(k), key=lambda i: tuple(want.clusterCenters()[i]))
        labels = {(r.a, r.b): order.index(r.prediction) for r in want.transform(v).collect()}
        assert {(r.a, r.b): r.cluster for r in models.label_clusters(df, ["a", "b"], got).collect()} == labels


def test_first_centres_are_those_of_spark(spark):
    """Common passes choose what Spark ML chooses from the same partitions, for several k and seeds, also with fewer different rows than centres."""
    from pyspark.ml.clustering import KMeans

    x = np.concatenate([RNG.normal(c, 0.8, (500, 3)) for c in ((0, 0, 1), (3, 0, 2), (0, 3, 0))])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, 1.0, 2.0), (float("nan"), 1.0, 1.0)], "a double, b double, c double").repartition(5).persist()
    few = spark.createDataFrame([(float(i % 2), 0.0, 1.0) for i in range(40)], "a double, b double, c double").persist()
    jobs = [(2, 1), (3, 2), (5, 3), (5, -7)]
    for data in (df, few):
        v = models.vectors(data, ["a", "b", "c"]).persist()
        got = models._first_centres(models._weighted(data, ["a", "b", "c"]).persist(), jobs)
        for (k, seed), c in zip(jobs, got):
            want = np.array(KMeans(k=k, seed=seed, featuresCol="features", maxIter=0).fit(v).clusterCenters())
            assert c.shape == want.shape and np.allclose(c, want, atol=1e-9)
    starts = models.gaussian_starts(df, [(["a", "b", "c"], 3), (["b"], 2), (["a", "b", "c"], 4)], seed=5)
    for i, (cols, k) in enumerate([(["a", "b", "c"], 3), (["b"], 2), (["a", "b", "c"], 4)]):
        want = KMeans(k=k, seed=5 + i, featuresCol="features").fit(models.vectors(df.select(*cols), cols)).clusterCenters()
        assert np.allclose(starts[i].emission.means, want, atol=1e-6)


@pytest.mark.parametrize("dims", [1, 3, 5])
def test_cells_give_the_sums_of_rows(spark, monkeypatch, dims):
    """Rounds that take cells as a whole equal rounds row by row: equal rows, rows as near to two centres, centres without rows, weights."""
    monkeypatch.setattr(models, "CELL_BLOCK", 1000)
    x = np.concatenate([RNG.normal(0, 1, (2500, dims)), np.round(RNG.normal(0, 2, (300, dims))), np.zeros((90, dims))])
    w = RNG.integers(0, 4, len(x)).astype(float)
    centres = [np.concatenate([RNG.normal(0, 1, (k, dims)), np.full((1, dims), 1.0), np.full((1, dims), -1.0), np.full((1, dims), 90.0)]) for k in (1, 4)]
    for c in centres:
        assert np.array_equal(np.sort(models._cells(x)), np.arange(len(x)))
        d2 = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        near = d2.argmin(axis=1)
        want = np.array([np.append(w[near == i].sum(), (x[near == i] * w[near == i, None]).sum(axis=0)) for i in range(len(c))])
        df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, w)], ", ".join(f"c{i} double" for i in range(dims)) + ", w double").repartition(2)
        cost, total = 0.0, 0.0
        for r in models._celled(df).collect():
            data, cells = np.frombuffer(r.x).reshape(dims + 1, -1, models.CELL_ROWS), np.frombuffer(r.cells).reshape(3 * dims + 2, -1)
            part = models._block_round(c, data, cells)
            cost, total = cost + part[0], total + part[1]
        # ties may fall either way by rounding, which moves rows between centres and leaves the cost
        assert np.isclose(cost, d2.min(axis=1) @ w)
        assert np.isclose(total[:, 0].sum(), w.sum()) and np.allclose(total[:, 1:].sum(axis=0), x.T @ w)
        if len(c) == 7:
            plain = (np.sort(d2, axis=1)[:, 1] - d2.min(axis=1) > 1e-9).all()
            assert not plain or np.allclose(total, want)
        moved, costs = models._lloyd(df, [c], rounds=1)
        assert np.isclose(costs[0], cost) and np.allclose(moved[0][-1], 90.0)


def test_components_match_numpy(spark):
    x = RNG.normal(size=(200, 3)) @ np.array([[3, 1, 0], [0, 1, 0.5], [0, 0, 0.3]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    comp = models.fit_components(df, ["a", "b", "c"])
    w, v = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(comp.ratios, (w / w.sum())[::-1])
    assert np.allclose(np.abs(comp.loadings), np.abs(v[:, ::-1]))
    s = comp.transform(df).toPandas()
    assert np.allclose([s.pc0.mean(), s.pc0.var()], [0, w[-1]])


def test_sine_fit(spark):
    rows = [(1, i, float(30 * np.sin(0.05 * i + 1) + 70)) for i in range(500)]
    df = spark.createDataFrame(rows, "track_id long, frame long, signal double")
    f = models.sine_fit(df, "signal").first()
    assert abs(f.b - 0.05) < 1e-6 and abs(f.d - 70) < 1e-3 and f.error < 1e-5
    e = models.sine_error(df, "signal", models.sine_fit(df, "signal")).agg(F.max("sine_error")).first()[0]
    assert e < 1e-2


def test_sine_fit_is_the_least_error(spark):
    """Noise and an amplitude of 12 under the fixed 30: no worse than a dense search, and b lies between the candidates."""
    i = np.arange(400)
    v = 12 * np.sin(0.0123 * i + 0.7) + 5 + RNG.normal(0, 4, 400)
    df = spark.createDataFrame([(1, int(k), float(x)) for k, x in zip(i, v)], "track_id long, frame long, signal double")
    f = models.sine_fit(df, "signal").first()
    best = np.inf
    for b in np.arange(0.001, 0.2, 0.0005):
        for c in np.arange(-np.pi, np.pi, 0.05):
            r = v - 30 * np.sin(b * i + c)
            best = min(best, ((r - r.mean()) ** 2).mean())
    assert f.error <= best + 1e-6
    assert np.isclose(f.error, ((v - 30 * np.sin(f.b * i + f.c) - f.d) ** 2).mean())
