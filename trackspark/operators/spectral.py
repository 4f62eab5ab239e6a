"""Sliding and block spectra along a track."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.schema import FPS
from .chunk import chunk_size, scan, with_halo

# rows per numpy batch: bounds the window matrix of one chunk
BATCH = 4096


def _hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def _segments(values: np.ndarray, first: int, centers: np.ndarray, n: int) -> np.ndarray:
    """Rows [c - n/2, c + n/2) of a series that starts at frame ``first``; zero outside it."""
    pad = np.zeros(n)
    v = np.concatenate([pad, values, pad])
    at = centers - n // 2 - first + n
    return v[at[:, None] + np.arange(n)[None, :]]


def _local_peaks(m: np.ndarray) -> np.ndarray:
    """Inner points above both sides; the middle of a flat top counts, its earlier one when even."""
    out = np.zeros(m.shape, dtype=bool)
    start, rising = np.zeros(len(m), dtype=int), np.zeros(len(m), dtype=bool)
    for j in range(1, m.shape[1]):
        up, down = m[:, j] > m[:, j - 1], m[:, j] < m[:, j - 1]
        top = np.flatnonzero(down & rising)
        out[top, (start[top] + j - 1) // 2] = True
        start[up] = j
        rising = up | (rising & ~down)
    return out


def peak_scores(mags: np.ndarray, freqs: np.ndarray, full: float = 3.0, height: float = 0.2, distance: int = 3) -> np.ndarray:
    """Per row: the highest weighted local peak of the bins from the third on, times the amplitude scale; 0 without a peak."""
    low = mags[:, 2:]
    top = low.max(axis=1, keepdims=True)
    scaled = np.divide(low, top, out=np.zeros_like(low), where=top > 0)
    weight = np.where(freqs > 10, 0.0, np.where(freqs > 5, 5.0, np.where(freqs <= 2, 0.0, freqs)))[2:]
    open_ = _local_peaks(scaled) & (scaled >= height)
    kept = np.zeros_like(open_)
    # the highest open peak wins and closes its neighbours, until none is open
    while open_.any():
        rows = np.flatnonzero(open_.any(axis=1))
        best = np.where(open_[rows], scaled[rows], -1.0).argmax(axis=1)
        kept[rows, best] = True
        for off in range(1 - distance, distance):
            j = best + off
            ok = (j >= 0) & (j < open_.shape[1])
            open_[rows[ok], j[ok]] = False
    band = mags[:, (freqs > 2) & (freqs < 10)].max(axis=1)
    score = np.where(kept, weight * scaled, 0.0).max(axis=1)
    return score * np.minimum(1.0, band / full) ** 2


def mean_scores(mags: np.ndarray, freqs: np.ndarray, full: float = 4.0) -> np.ndarray:
    """Per row: magnitude-weighted mean of the frequencies in (2, 10), times the amplitude scale; nan for a silent row."""
    total = mags[:, 2:].sum(axis=1)
    band = (freqs > 2) & (freqs < 10)
    with np.errstate(invalid="ignore", divide="ignore"):
        score = (mags[:, band] * freqs[band]).sum(axis=1) / total
    return score * np.minimum(1.0, mags[:, band].max(axis=1) / full) ** 2


def _dense(frames: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values placed by frame from the first to the last; a missing frame repeats the one before it."""
    at = frames - frames[0]
    last = np.zeros(at[-1] + 1, dtype=int)
    last[at] = np.arange(len(at))
    return values[np.maximum.accumulate(last)]


def _spectrum(df: DataFrame, value: str, nperseg: int, hop: int, padded: bool, outputs: dict, schema: str, fps: float,
              keys: tuple, detrend: bool, size: int | None, every: bool = False) -> DataFrame:
    """Rows per segment; with ``every`` (hop 1) one row per own frame, null where no whole segment fits.

    A null repeats the value before it, as does a missing frame; before a track's first value there is silence (0).
    """
    half, chunk = nperseg // 2, chunk_size(size)
    window, freqs = _hann(nperseg), np.fft.rfftfreq(nperseg, 1 / fps)
    key_list = list(keys)

    def per_chunk(key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        frames = rows["frame"].to_numpy()
        values = _dense(frames, rows[value].to_numpy(dtype=float, na_value=0.0))
        lo, hi = int(key[-1]) * chunk, (int(key[-1]) + 1) * chunk
        first, last = int(frames[0]), int(frames[-1])
        if padded:
            # centres on multiples of the hop, up to the first one at or past the end
            centers = np.arange(-(-lo // hop) * hop, min(hi, last + 1 + hop), hop)
        else:
            # whole segments only; the first starts at frame 0
            a = -(-(max(lo, first + half) - half) // hop) * hop + half
            centers = np.arange(a, min(hi, last + 1 - (nperseg - half) + 1), hop)
        for i in range(0, len(centers), BATCH):
            c = centers[i:i + BATCH]
            seg = _segments(values, first, c, nperseg)
            if detrend:
                seg = seg - seg.mean(axis=1, keepdims=True)
            mags = np.abs(np.fft.rfft(seg * window, axis=1))
            yield pd.DataFrame({"frame": c} | {name: list(fn(mags)) if name == "mags" else fn(mags) for name, fn in outputs.items()})

    filled = scan(df.select(*keys, "frame", value), {value: ("last", F.col(value))}, keys=keys, size=size)
    h = with_halo(filled.select(*keys, "frame", value), nperseg, nperseg + hop, size=size)
    parts = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    # the batches of one bounded chunk
    def run(key, rows):
        rows = rows.sort_values("frame")
        got = list(per_chunk(key, rows))
        out = pd.concat(got) if got else pd.DataFrame({"frame": [], **{n: [] for n in outputs}}, dtype=object)
        if every:
            out = rows.loc[rows["_own"], ["frame"]].merge(out, on="frame", how="left")
        return out.assign(**dict(zip(key_list, key)))[[*key_list, "frame", *outputs]]
    return h.groupBy(*keys, "_chunk").applyInPandas(run, f"{parts}, frame long, {schema}")


def stft(df: DataFrame, value: str, nperseg: int = 70, hop: int = 1, padded: bool = False, fps: float = FPS, keys=("track_id",),
         size: int | None = None) -> DataFrame:
    """Windowed magnitudes ``mags array<double>`` per segment centre ``frame`` (bin i is i * fps / nperseg Hz).

    ``padded`` lets segments hang over both ends on zeros; otherwise only whole segments are kept. The work unit is a
    frame chunk with its halo, transformed by numpy.
    """
    w = _hann(nperseg).sum()
    return _spectrum(df, value, nperseg, hop, padded, {"mags": lambda m: m / w}, "mags array<double>", fps, tuple(keys), False, size)


def frequency_scores(df: DataFrame, value: str, nperseg: int = 70, fps: float = FPS, keys=("track_id",), size: int | None = None) -> DataFrame:
    """Per frame ``peak_score`` and ``mean_score`` of the hop-1 spectrum; frames without a whole window are null."""
    w, freqs = _hann(nperseg).sum(), np.fft.rfftfreq(nperseg, 1 / fps)
    scored = _spectrum(df, value, nperseg, 1, False, {
        "peak_score": lambda m: peak_scores(m / w, freqs), "mean_score": lambda m: mean_scores(m / w, freqs)},
        "peak_score double, mean_score double", fps, tuple(keys), False, size, every=True)
    null = F.lit(None).cast("double")
    return scored.withColumns({c: F.nanvl(c, null) for c in ("peak_score", "mean_score")})


def block_scores(df: DataFrame, value: str, nperseg: int = 100, hop: int = 50, fps: float = FPS, keys=("track_id",), size: int | None = None) -> DataFrame:
    """Per block ``col``: magnitude-weighted mean of f^2 in (1.5, 5) over the padded block spectrum."""
    from ..functions.label import frequency_weight

    s = stft(df, value, nperseg, hop, True, fps, keys, size)
    weighted = F.expr("aggregate(mags, 0D, (a, m) -> a + m)")
    f = F.transform("mags", lambda m, i: frequency_weight(i * F.lit(fps / nperseg), "square") * m)
    s = s.withColumn("_w", f)
    return s.select(*keys, F.expr(f"frame div {hop}").alias("col"), F.try_divide(F.expr("aggregate(_w, 0D, (a, m) -> a + m)"), weighted).alias("score"))


def welch(df: DataFrame, value: str, nperseg: int = 64, fps: float = FPS, keys=("track_id",), size: int | None = None) -> DataFrame:
    """One-sided power density per bin: mean over half-overlapping segments with their mean removed."""
    scale = 1.0 / (fps * (_hann(nperseg) ** 2).sum())
    s = _spectrum(df, value, nperseg, nperseg // 2, False, {"mags": lambda m: m}, "mags array<double>", fps, tuple(keys), True, size)
    nyquist = nperseg // 2 if nperseg % 2 == 0 else -1
    p = s.select(*keys, F.posexplode("mags").alias("bin", "mag"))
    twice = F.when((F.col("bin") == 0) | (F.col("bin") == nyquist), 1.0).otherwise(2.0)
    return p.groupBy(*keys, "bin").agg((F.avg(F.col("mag") * F.col("mag")) * F.lit(scale) * F.max(twice)).alias("power"))


#: Values that a task transforms at a time. Longer bouts are transformed by several.
BLOCK = 1 << 18


def _plan(n: int, block: int) -> tuple[int, int, int, int]:
    """Length of a transform that holds a chirp convolution of n values as rows x columns, and columns and rows of a block."""
    bits = (2 * n - 2).bit_length()
    rows, columns = 1 << bits // 2, 1 << bits - bits // 2
    return rows, columns, min(columns, max(1, block // rows)), min(rows, max(1, block // columns))


def _turns(k: np.ndarray, n: int) -> np.ndarray:
    """exp(2 pi i k / n) for whole k, reduced exactly."""
    return np.exp(2j * np.pi / n * (k % n))


def _complex(column: pa.ChunkedArray, i: int) -> np.ndarray:
    return np.ascontiguousarray(column[i].values.to_numpy(zero_copy_only=False)).view(np.complex128)


def bout_magnitudes(rows: DataFrame, value: str, keys=("track_id", "start"), block: int | None = None) -> DataFrame:
    """keys, n, k, mag: magnitudes of the discrete Fourier transform of whole bouts at k = 1 .. (n - 1) // 2, for any length. Rows carry ``pos`` and
    ``n`` (position in and length of the bout); a null value counts as 0.

    A bout of up to ``BLOCK`` values is transformed by one task. A longer one is a convolution with a chirp (Bluestein), so that any length,
    also a prime one, becomes transforms of a power of two; these go in steps over a matrix: columns, twiddle factors, rows,
    product with the chirp's transform, rows back, twiddle factors, columns back. Tasks hold blocks of columns or rows, and blocks cross over in
    two exchanges, so the work is n log n and no task holds a bout.
    """
    from .sweeps import _groups

    keys, block = list(keys), block or BLOCK
    slim = rows.select(*keys, F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    kept = [slim.schema[k] for k in keys]
    out = T.StructType([*kept, *[T.StructField(c, t) for c, t in (("n", T.LongType()), ("k", T.LongType()), ("mag", T.DoubleType()))]])

    def spread(t: pa.Table, count: int) -> dict[str, pa.Array]:
        """The key columns of the table's first row, ``count`` times."""
        return {k: t.column(k).take(pa.array(np.zeros(count, np.int64))).combine_chunks() for k in (*keys, "n")}

    def whole(batches):
        for t, group in _groups(batches, keys):
            v, n = t.column("v").to_numpy(), t.column("n").to_numpy()
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            mags = [np.abs(np.fft.rfft(x))[1 : (len(x) - 1) // 2 + 1] for x in np.split(v, first[1:])]
            size = np.array([len(m) for m in mags])
            at = np.repeat(first, size)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + 1
            named = [t.column(c).take(pa.array(at)).combine_chunks() for c in keys]
            yield pa.RecordBatch.from_arrays([*[pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in named], pa.array(n[at]), pa.array(k), pa.array(np.concatenate(mags))], [f.name for f in out])

    short = slim.where(F.col("n") <= block).repartition(*keys).sortWithinPartitions(*keys, "pos").mapInArrow(whole, out)

    def lists(parts: list[np.ndarray]) -> pa.Array:
        flat = [np.ascontiguousarray(p).ravel().view(np.float64) for p in parts]
        return pa.LargeListArray.from_arrays(pa.array(np.cumsum([0, *(len(f) for f in flat)])), pa.array(np.concatenate(flat))).cast(pa.list_(pa.float64()))

    def columns_first(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        n, here = key[-2].as_py(), key[-1].as_py()
        r, c, w, k = _plan(n, block)
        pos = t.column("pos").to_numpy()
        x = np.zeros((r, w), np.complex128)
        x[pos // c, pos % c - here * w] = t.column("v").to_numpy() * _turns(-pos * pos, 2 * n)
        at = np.arange(r)[:, None] * c + here * w + np.arange(w)
        back = np.minimum(at, r * c - at)
        chirp = np.where(back < n, _turns(back * back, 2 * n), 0)
        turn = _turns(-(np.arange(r)[:, None] * (here * w + np.arange(w))), r * c)
        x, chirp = np.fft.fft(x, axis=0) * turn, np.fft.fft(chirp, axis=0) * turn
        to = np.arange(r // k)
        return pa.table({**spread(t, len(to)), "_to": pa.array(to.astype(np.int64)), "_from": pa.array(np.full(len(to), here, np.int64)),
                         "x": lists([x[i * k : (i + 1) * k] for i in to]), "h": lists([chirp[i * k : (i + 1) * k] for i in to])})

    def rows_there_and_back(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        n, here = key[-2].as_py(), key[-1].as_py()
        r, c, w, k = _plan(n, block)
        x, h = (np.empty((k, c), np.complex128) for _ in range(2))
        for i, j in enumerate(t.column("_from").to_pylist()):
            x[:, j * w : (j + 1) * w], h[:, j * w : (j + 1) * w] = (_complex(t.column(name), i).reshape(k, w) for name in ("x", "h"))
        y = np.fft.ifft(np.fft.fft(x, axis=1) * np.fft.fft(h, axis=1), axis=1)
        y *= _turns((here * k + np.arange(k))[:, None] * np.arange(c), r * c)
        to = np.arange(c // w)
        return pa.table({**spread(t, len(to)), "_to": pa.array(to.astype(np.int64)), "_from": pa.array(np.full(len(to), here, np.int64)), "x": lists([y[:, i * w : (i + 1) * w] for i in to])})

    def columns_last(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        n, here = key[-2].as_py(), key[-1].as_py()
        r, c, w, k = _plan(n, block)
        y = np.empty((r, w), np.complex128)
        for i, j in enumerate(t.column("_from").to_pylist()):
            y[j * k : (j + 1) * k] = _complex(t.column("x"), i).reshape(k, w)
        # the last chirp turns values only, magnitudes stay
        mag = np.abs(np.fft.ifft(y, axis=0)).ravel()
        at = (np.arange(r)[:, None] * c + here * w + np.arange(w)).ravel()
        own = (at >= 1) & (at <= (n - 1) // 2)
        return pa.table({**spread(t, int(own.sum())), "k": pa.array(at[own]), "mag": pa.array(mag[own])})

    bits = F.length(F.bin(2 * F.col("n") - 2))
    c = F.expr("shiftleft(1L, cast(_bits - _bits div 2 as int))")
    r = F.expr("shiftleft(1L, cast(_bits div 2 as int))")
    long = slim.where(F.col("n") > block).withColumn("_bits", bits).withColumns({"_c": c, "_r": r})
    long = long.withColumn("_to", F.expr(f"(pos % _c) div least(_c, greatest(1L, {block}L div _r))")).select(*keys, "n", "_to", "pos", "v")
    cross = T.StructType([*kept, T.StructField("n", T.LongType()), T.StructField("_to", T.LongType()), T.StructField("_from", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    both = T.StructType([*cross.fields, T.StructField("h", T.ArrayType(T.DoubleType()))])
    for step, schema in ((columns_first, both), (rows_there_and_back, cross), (columns_last, out)):
        long = long.groupBy(*keys, "n", "_to").applyInArrow(step, schema)
    return short.unionByName(long)


def bout_dft_scores(rows: DataFrame, value: str, keys=("track_id", "start"), fps: float = FPS, block: int | None = None) -> DataFrame:
    """One DFT per bout: sum over bins 1..(n-1)/2 of mag / sum(mag) * f^2 in (1.5, 5). Rows carry ``pos`` and ``n``, see ``bout_magnitudes``."""
    from ..functions.label import frequency_weight

    g = bout_magnitudes(rows, value, keys, block).withColumn("f", F.col("k") * F.lit(float(fps)) / F.col("n"))
    return g.groupBy(*keys, "n").agg(F.try_divide(F.sum(F.col("mag") * frequency_weight("f", "square")), F.sum("mag")).alias("score"))
