"""Scaling, components, clusters, classifiers."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, Bucketizer, OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import discard, stored
from .chunk import running_total, with_chunk


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with the mean and population deviation of every column."""
    return df.agg(*[a for c in cols for a in (F.avg(c).alias(f"_a_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])


def scale(df: DataFrame, scaler: DataFrame, cols: list[str]) -> DataFrame:
    out = df.crossJoin(F.broadcast(scaler))  # one row
    return out.withColumns({c: F.try_divide(F.col(c) - F.col(f"_a_{c}"), F.col(f"_s_{c}")) for c in cols}).drop(*scaler.columns)


def unscale(df: DataFrame, scaler: DataFrame, cols: list[str]) -> DataFrame:
    out = df.crossJoin(F.broadcast(scaler))  # one row
    return out.withColumns({c: F.col(c) * F.col(f"_s_{c}") + F.col(f"_a_{c}") for c in cols}).drop(*scaler.columns)


def sine_fit(df: DataFrame, value: str, keys=("track_id",), rates: list[float] | None = None, amplitude: float = 30.0, rounds: int = 6) -> DataFrame:
    """Best b, c, d of amplitude * sin(b * frame + c) + d per group, with its mean squared error.

    For every candidate b the sums of sine, cosine and value give the error as a function of c alone, since the best d follows;
    its least value over c is found on a grid and refined. The best b then starts ``rounds`` damped Gauss-Newton steps in b, c
    and d together, each one aggregate of the rows; a step that does not lower the error is halved.
    """
    rates = rates or [i / 200 for i in range(1, 41)]
    # a row without a key, frame or value belongs to no fit
    rows = df.select(*keys, "frame", F.col(value).cast("double").alias(value))
    for c in (*keys, "frame", value):
        rows = rows.where(F.col(c).isNotNull())
    m = _sine_phases(_sine_sums(rows, value, list(keys), rates), list(keys), amplitude)
    best = m.groupBy(*keys).agg(F.min_by(F.struct("b", "c", "d", "error"), F.struct("error", "b")).alias("f")).select(*keys, "f.*")
    return _sine_steps(rows, value, best, keys, amplitude, rounds)


#: Sums per group and rate: rows, sine, cosine, their squares and product, value, value by sine, value by cosine, squared value.
SINE_SUMS = [f"_q{i}" for i in range(10)]


def _sine_sums(rows: DataFrame, value: str, keys: list[str], rates: list[float]) -> DataFrame:
    """keys, b and ``SINE_SUMS``: rows of a group come side by side, so an Arrow batch leaves one row per group it meets and rate."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField(n, T.DoubleType()) for n in ("b", *SINE_SUMS)])

    def sums(batches):
        b = np.array(rates, float)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.ones(batch.num_rows, bool)
            new[1:] = False
            for k in keys:
                c = batch.column(k)
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(new)
            t, v = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("frame", value))
            s, c = np.sin(b[:, None] * t), np.cos(b[:, None] * t)
            by_rate = {i: np.add.reduceat(x, at, axis=1) for i, x in ((1, s), (2, c), (3, s * s), (4, c * c), (5, s * c), (7, v * s), (8, v * c))}
            alone = {i: np.tile(np.add.reduceat(x, at), (len(b), 1)) for i, x in ((0, np.ones(len(v))), (6, v), (9, v * v))}
            found = by_rate | alone
            first = pa.array(np.tile(at, len(b)))
            yield pa.record_batch([*[batch.column(k).take(first) for k in keys], pa.array(np.repeat(b, len(at))), *[pa.array(found[i].ravel()) for i in range(10)]],
                                  names=[*keys, "b", *SINE_SUMS])

    # a group may be a whole track: its chunks are summed apart
    dealt = with_chunk(rows).repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk").select(*rows.columns)
    return dealt.mapInArrow(sums, schema).groupBy(*keys, "b").agg(*[F.sum(n).alias(n) for n in SINE_SUMS])


def _sine_phases(sums: DataFrame, keys: list[str], amplitude: float) -> DataFrame:
    """keys, b and its best c, d with their error."""
    import numpy as np
    import pyarrow as pa

    schema = T.StructType([sums.schema[k] for k in keys] + [T.StructField(n, T.DoubleType()) for n in ("b", "c", "d", "error")])

    def least(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                n, S, C, SS, CC, SC, V, VS, VC, VV = (batch.column(q).to_numpy(zero_copy_only=False) for q in SINE_SUMS)
                ss, cc, sc, vs, vc, vv = (x[:, None] for x in (SS - S * S / n, CC - C * C / n, SC - S * C / n, VS - V * S / n, VC - V * C / n, VV - V * V / n))
                phase = np.zeros(len(n))
                for step, steps in ((math.pi / 90, 90), (math.pi / 900, 10), (math.pi / 9000, 10), (math.pi / 90000, 10)):
                    tried = phase[:, None] + np.arange(-steps, steps + 1) * step
                    p, q = amplitude * np.cos(tried), amplitude * np.sin(tried)  # amplitude * sin(bt + c) = p sin(bt) + q cos(bt)
                    error = (vv + p * p * ss + q * q * cc + 2 * p * q * sc - 2 * p * vs - 2 * q * vc) / n[:, None]
                    best = np.arange(len(n)), np.where(np.isnan(error), np.inf, error).argmin(axis=1)
                    phase = tried[best]
                d = (V - amplitude * np.cos(phase) * S - amplitude * np.sin(phase) * C) / n
                yield pa.record_batch([*[batch.column(k) for k in keys], batch.column("b"), *[pa.array(x) for x in (phase, d, error[best])]], names=[*keys, "b", "c", "d", "error"])

    return sums.mapInArrow(least, schema)


def _sine_steps(rows: DataFrame, value: str, fit: DataFrame, keys, amplitude: float, rounds: int) -> DataFrame:
    """Damped Gauss-Newton on b, c, d: the error of the step tried and the sums for the next one come from the same pass."""
    state = fit.select(*keys, "b", "c", "d", "error", *[F.col(k).alias(f"n{k}") for k in "bcd"])
    for r in range(rounds + 1):
        j = rows.join(state, list(keys))
        at = F.col("nb") * F.col("frame") + F.col("nc")
        rest = F.col(value) - amplitude * F.sin(at) - F.col("nd")
        gc = amplitude * F.cos(at)
        gb = gc * F.col("frame")
        held = [F.max(k).alias(k) for k in ("b", "c", "d", "error", "nb", "nc", "nd")]
        sums = j.groupBy(*keys).agg(*held, F.count(F.lit(1)).alias("n"), F.avg(rest * rest).alias("tried"),
                                    F.sum(gb * gb).alias("bb"), F.sum(gc * gc).alias("cc"), F.sum(gb * gc).alias("bc"), F.sum(gb).alias("sb"), F.sum(gc).alias("sc"),
                                    F.sum(gb * rest).alias("rb"), F.sum(gc * rest).alias("rc"), F.sum(rest).alias("rd"))
        better = F.col("tried") < F.col("error")
        kept = {k: F.when(better, F.col(f"n{k}")).otherwise(F.col(k)) for k in "bcd"}
        n = F.col("n")
        # normal equations with d eliminated
        bb, cc, bc = F.col("bb") - F.col("sb") ** 2 / n, F.col("cc") - F.col("sc") ** 2 / n, F.col("bc") - F.col("sb") * F.col("sc") / n
        rb, rc = F.col("rb") - F.col("sb") * F.col("rd") / n, F.col("rc") - F.col("sc") * F.col("rd") / n
        det = bb * cc - bc * bc
        db, dc = F.try_divide(rb * cc - rc * bc, det), F.try_divide(rc * bb - rb * bc, det)
        dd = (F.col("rd") - F.col("sb") * db - F.col("sc") * dc) / n
        half = {k: (F.col(k) + F.col(f"n{k}")) / 2 for k in "bcd"}
        first = F.lit(r == 0) | better
        step = {"b": db, "c": dc, "d": dd}
        nxt = [F.coalesce(F.when(first, F.col(f"n{k}") + step[k]).otherwise(half[k]), F.col(k)).alias(f"n{k}") for k in "bcd"]
        before, state = state, stored(sums.select(*keys, *[e.alias(k) for k, e in kept.items()], F.least("tried", "error").alias("error"), *nxt))
        discard(before)
    return state.select(*keys, "b", "c", "d", "error")


def sine_error(df: DataFrame, value: str, fit: DataFrame, keys=("track_id",), amplitude: float = 30.0) -> DataFrame:
    """Absolute difference of every row to its group's fitted sine."""
    model = amplitude * F.sin(F.col("b") * F.col("frame") + F.col("c")) + F.col("d")
    return df.join(fit, list(keys)).withColumn("sine_error", F.abs(F.col(value) - model))


def vectors(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="skip").transform(df)


class Components:
    """Principal components of centred columns, signs fixed by the largest loading."""

    def __init__(self, cols: list[str], means: list[float], loadings, ratios):
        self.cols, self.means, self.loadings, self.ratios = cols, means, loadings, ratios

    def transform(self, df: DataFrame, k: int | None = None, prefix: str = "pc") -> DataFrame:
        """Scores of any table with the same columns, also of another subject."""
        k = k or self.loadings.shape[1]
        return df.withColumns({
            f"{prefix}{j}": reduce(lambda a, b: a + b, [(F.col(c) - m) * float(self.loadings[i, j]) for i, (c, m) in enumerate(zip(self.cols, self.means))])
            for j in range(k)})

    def table(self, spark) -> DataFrame:
        """component, ratio, cumulative, feature, loading, magnitude."""
        rows, total = [], 0.0
        for j in range(self.loadings.shape[1]):
            total += float(self.ratios[j])
            rows += [(j, float(self.ratios[j]), total, c, float(self.loadings[i, j]), abs(float(self.loadings[i, j]))) for i, c in enumerate(self.cols)]
        return spark.createDataFrame(rows, "component int, ratio double, cumulative double, feature string, loading double, magnitude double")


def fit_components(df: DataFrame, cols: list[str], k: int | None = None) -> Components:
    import numpy as np

    clean = df.na.drop("any", subset=cols)
    means = list(clean.agg(*[F.avg(c).alias(c) for c in cols]).first())
    centred = clean.select(*[(F.col(c) - m).alias(c) for c, m in zip(cols, means)])
    model = PCA(k=k or len(cols), inputCol="features", outputCol="pcs").fit(vectors(centred, cols))
    load = model.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(axis=0), np.arange(load.shape[1])])
    return Components(cols, means, load * sign, model.explainedVariance.toArray())


#: Rows whose distances to all centres are held at a time.
KMEANS_STRIP = 8192
#: Rounds in which k-means|| draws candidates, as in Spark ML.
INIT_STEPS = 2
#: Rows whose cells are laid out together, and rows of a cell.
CELL_BLOCK, CELL_ROWS = 262_144, 64


class _Draws:
    """Numbers in 0..1 of the generators that Spark ML gives a partition (xorshift, two draws a number), one for each seed and many at a time: a generator is
    linear, so its states after 2^j draws are table look-ups of the states before."""

    tables: list = []

    def __init__(self, seeds: list[int]):
        import numpy as np

        low = [_murmur(s, 0x3C074A61) for s in seeds]
        self.state = np.array([_murmur(s, h) << 32 | h for s, h in zip(seeds, low)], np.uint64)

    @staticmethod
    def _jump(table, x):
        import numpy as np

        out = np.zeros_like(x)
        for byte in range(8):
            out ^= table[byte][(x >> np.uint64(8 * byte)) & np.uint64(255)]
        return out

    @classmethod
    def _table(cls, j: int):
        import numpy as np

        while len(cls.tables) <= j:
            basis = np.uint64(1) << np.arange(64, dtype=np.uint64)
            if cls.tables:
                image = cls._jump(cls.tables[-1], cls._jump(cls.tables[-1], basis))
            else:
                image = cls._step(basis)
            bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
            cls.tables.append([np.bitwise_xor.reduce(np.where(bits > 0, image[8 * b : 8 * b + 8], np.uint64(0)), axis=1) for b in range(8)])
        return cls.tables[j]

    @staticmethod
    def _step(x):
        import numpy as np

        x = x ^ (x << np.uint64(21))
        x ^= x >> np.uint64(35)
        x ^= x << np.uint64(4)
        return x

    def below(self, limit):
        """Which of the next numbers of each generator are below their limit (seeds, numbers): runs of eight numbers begin at states looked up and go on side
        by side."""
        import numpy as np

        n, have = limit.shape[1], 1
        runs = np.empty((-(-n // 8), len(limit)), np.uint64)
        runs[0] = self.state
        while have < len(runs):
            more = min(have, len(runs) - have)
            runs[have : have + more] = self._jump(self._table(3 + have.bit_length()), runs[:more])
            have += more
        first, second = np.empty((2, len(runs), 8, len(limit)), np.uint64)
        for i in range(8):
            first[:, i] = runs = self._step(runs)
            second[:, i] = runs = self._step(runs)
        first, second = (x.reshape(-1, len(limit))[:n] for x in (first, second))
        self.state = second[-1].copy()
        high, low = first & np.uint64((1 << 26) - 1), second & np.uint64((1 << 27) - 1)
        return ((high << np.uint64(27) | low) * 2.0**-53).T < limit


def _murmur(value: int, h: int) -> int:
    """MurmurHash3 of the eight bytes of a long."""
    data = (value & (1 << 64) - 1).to_bytes(8, "big")
    for i in (0, 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        h ^= (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def _nearest_of(every, first, batch):
    """For strips of a batch (coordinates and a last column): the strip's rows, and for each of several sets of centres the squared distances to all of them
    less the row's own square, the least of these, and the squared distance to the nearest."""
    import numpy as np

    size = (every * every).sum(axis=1)
    data = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
    for lo in range(0, len(data), KMEANS_STRIP):
        x = data[lo : lo + KMEANS_STRIP, :-1]
        own, found = (x * x).sum(axis=1), []
        for a, b in zip(first[:-1], first[1:]):
            far = size[a:b, None] - 2 * (every[a:b] @ x.T)
            least = far.min(axis=0)
            found.append((far, least, np.maximum(least + own, 0.0)))
        yield x, found


def _of_first(far, least):
    """1 for the nearest centre of each row (column), 0 for the others; the first where several are as near."""
    import numpy as np

    on = (far == least).astype(float)
    if on.sum() != far.shape[1]:
        on[:] = 0.0
        on[far.argmin(axis=0), np.arange(far.shape[1])] = 1.0
    return on


def _first_centres(rows: DataFrame, jobs: list[tuple[int, int]]) -> list:
    """What Spark ML's k-means|| chooses from the same partitions for each (k, seed), drawn and counted for all jobs in common passes; ``rows`` has
    the coordinates and, last, a weight, which the choice does not use."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    context, dims = rows.sparkSession.sparkContext, len(rows.columns) - 1
    jvm, gateway = context._jvm, context._gateway
    seeds = [jvm.org.apache.spark.util.random.XORShiftRandom(s).nextInt() for _, s in jobs]
    # the place of a row stands for it while Spark draws, then all rows drawn are fetched at once
    place = F.monotonically_increasing_id().alias("_place")
    drawn = rows.select(place)._jdf.rdd()
    with ThreadPoolExecutor(4) as pool:
        samples = list(pool.map(lambda s: drawn.takeSample(False, 1, s), seeds))
    if not len(samples[0]):
        raise ValueError("no complete rows to choose centres from")
    places = [s[0].getLong(0) for s in samples]
    named = rows.select(place, *rows.columns[:-1]).where(F.col("_place").isin(sorted(set(places)))).collect()
    at = {r[0]: [float(v) for v in r[1:]] for r in named}
    centres = [np.array([at[p]]) for p in places]
    bounds = lambda c: (np.concatenate(c), np.cumsum([0] + [len(x) for x in c]))

    def totals(work, width) -> np.ndarray:
        found = rows.mapInArrow(work, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(width)
        for r in found:
            out[r["i"]] = r["v"]
        return out

    for step in range(INIT_STEPS):
        every, first = bounds(centres)

        def costs(batches, every=every, first=first):
            total = np.zeros(len(first) - 1)
            for batch in batches:
                for _, found in _nearest_of(every, first, batch):
                    total += [d2.sum() for _, _, d2 in found]
            yield pa.record_batch({"i": pa.array(np.arange(len(total), dtype=np.int32)), "v": pa.array(total)})

        cost = totals(costs, len(jobs))

        def choose(batches, every=every, first=first, cost=cost, step=step):
            part = TaskContext.get().partitionId()
            # the seed is an int there
            draws, scale = _Draws([seed ^ step << 16 ^ part for seed in seeds]), np.array([k for k, _ in jobs])[:, None]
            at = 0
            for batch in batches:
                for x, found in _nearest_of(every, first, batch):
                    d2 = np.stack([d2 for _, _, d2 in found])
                    limit = np.divide(2.0 * d2 * scale, cost[:, None], out=np.zeros_like(d2), where=cost[:, None] > 0)
                    j, hit = np.nonzero(draws.below(limit))
                    if len(hit):
                        yield pa.record_batch({"j": pa.array(j.astype(np.int32)), "part": pa.array(np.full(len(hit), part, np.int32)), "at": pa.array(at + hit.astype(np.int64)),
                                               "x": pa.array(x[hit].tolist(), pa.list_(pa.float64()))})
                    at += len(x)

        # about 2k rows a job
        chosen = sorted((r["j"], r["part"], r["at"], r["x"]) for r in rows.mapInArrow(choose, "j int, part int, at long, x array<double>").collect())
        centres = [np.concatenate([c, *[[x] for i, _, _, x in chosen if i == j]]) for j, c in enumerate(centres)]
    centres = [np.array(list(dict.fromkeys(map(tuple, c)))) for c in centres]
    every, first = bounds(centres)

    def counts(batches):
        total = np.zeros(len(every))
        for batch in batches:
            for _, found in _nearest_of(every, first, batch):
                for a, (far, least, _) in zip(first, found):
                    total[a : a + len(far)] += _of_first(far, least).sum(axis=1)
        yield pa.record_batch({"i": pa.array(np.arange(len(total), dtype=np.int32)), "v": pa.array(total)})

    weight = totals(counts, len(every))
    out = []
    for (k, _), c, a in zip(jobs, centres, first):
        if len(c) > k:
            points = gateway.new_array(jvm.org.apache.spark.mllib.clustering.VectorWithNorm, len(c))
            weights = gateway.new_array(jvm.double, len(c))
            for i, p in enumerate(c):
                values = gateway.new_array(jvm.double, dims)
                for d, v in enumerate(p):
                    values[d] = float(v)
                points[i] = jvm.org.apache.spark.mllib.clustering.VectorWithNorm(values)
                weights[i] = float(weight[a + i])
            best = jvm.org.apache.spark.mllib.clustering.LocalKMeans.kMeansPlusPlus(0, points, weights, k, 30)
            c = np.array([list(b.vector().toArray()) for b in best])
        out.append(c)
    return out


def _cells(x):
    """Order of the rows of x (rows, d) by cells of ``CELL_ROWS`` near rows: slabs of equal count along the widest columns, one in another."""
    import numpy as np

    n, axes = len(x), np.argsort(-np.ptp(x, axis=0), kind="stable")[:3]
    parts = -(-n // CELL_ROWS)
    each, order, slab = max(1, round(parts ** (1 / len(axes)))), np.arange(n), np.zeros(n, np.int64)
    for i, axis in enumerate(axes):
        order = order[np.lexsort((x[order, axis], slab))]
        slab = np.arange(n) // CELL_ROWS * min(each ** (i + 1), parts) // parts
    return order


def _celled(rows: DataFrame) -> DataFrame:
    """Rows (coordinates and, last, a weight) as blocks: the values, column after column, cell by cell (the last filled up by rows of no weight), and of each
    cell its least and greatest coordinates, weight, weighted sums and sum of squares."""
    import numpy as np
    import pyarrow as pa

    def block(data):
        order = _cells(data[:, :-1])
        rest = -len(data) % CELL_ROWS
        data = np.ascontiguousarray(data[np.append(order, np.repeat(order[-1:], rest))].T)
        data[-1, data.shape[1] - rest :] = 0.0
        c = data.reshape(len(data), -1, CELL_ROWS)
        x, w = c[:-1], c[-1]
        cells = np.vstack([x.min(axis=2), x.max(axis=2), w.sum(axis=1)[None], (x * w).sum(axis=2), ((x * x).sum(axis=0) * w).sum(axis=1)[None]])
        return pa.record_batch({"x": pa.array([data.tobytes()], pa.binary()), "cells": pa.array([cells.tobytes()], pa.binary())})

    def lay(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
                n += batch.num_rows
            if n >= CELL_BLOCK:
                yield block(np.concatenate(held))
                held, n = [], 0
        if n:
            yield block(np.concatenate(held))

    return rows.mapInArrow(lay, "x binary, cells binary")


def _block_round(centres, data, cells):
    """Cost and weights with weighted sums (k, 1 + d) of the rows of a block by nearest centre. A cell whose box lies wholly nearer to one centre than to any
    other counts as a whole; the rows of the others are compared one by one. ``data`` is (1 + d, cells, rows)."""
    import numpy as np

    k, d = centres.shape
    low, high, square = cells[:d], cells[d : 2 * d], cells[-1]
    size, mid, half = (centres * centres).sum(axis=1), (low + high) / 2, (high - low) / 2
    far = size[:, None] - 2 * (centres @ mid)  # squared distance of the middle, less its own square
    near, total, cost = far.argmin(axis=0), np.zeros((k, 1 + d)), 0.0
    whole = np.zeros(len(square), bool)
    for c in range(k):
        at = np.flatnonzero(near == c)
        if not len(at):
            continue
        others = np.arange(k) != c
        # the difference of two squared distances is linear in the point
        reach = 2 * (np.abs(centres[others] - centres[c]) @ half[:, at])
        ahead = far[others][:, at] - far[c, at]
        at = at[(ahead > reach + 1e-9 * (reach + np.abs(far[c, at]) + size[c])).all(axis=0)]
        whole[at] = True
        sums = cells[2 * d : 3 * d + 1, at].sum(axis=1)
        total[c] += sums
        cost += max(0.0, float(square[at].sum() - 2 * (centres[c] @ sums[1:]) + size[c] * sums[0]))
    left = np.flatnonzero(~whole)
    for lo in range(0, len(left), KMEANS_STRIP // CELL_ROWS):
        part = data[:, left[lo : lo + KMEANS_STRIP // CELL_ROWS]].reshape(d + 1, -1)
        x, weight = part[:-1], part[-1]
        far = size[:, None] - 2 * (centres @ x)
        least = far.min(axis=0)
        on = _of_first(far, least) * weight
        total[:, 0] += on.sum(axis=1)
        total[:, 1:] += on @ x.T
        cost += float(np.maximum(least + (x * x).sum(axis=0), 0.0) @ weight)
    return cost, total


def _lloyd(rows: DataFrame, starts: list, rounds: int = 100, tol: float = 1e-4) -> tuple[list, list[float]]:
    """Lloyd rounds of several fits in common passes; ``rows`` has the coordinates and, last, a weight. A fit ends when none of its centres moves
    by more than ``tol``, or after ``rounds``; its cost belongs to the centres before the last move, as in Spark ML."""
    import numpy as np
    import pyarrow as pa

    centres, costs = [np.asarray(c, float) for c in starts], [0.0] * len(starts)
    live = [i for i, c in enumerate(centres) if len(c)]
    dims, laid = len(rows.columns) - 1, _celled(rows).persist()
    for _ in range(rounds):
        if not live:
            break
        now = [centres[i] for i in live]
        first = np.cumsum([0] + [len(c) for c in now])

        def sums(batches, now=now, first=first):
            far, total = np.zeros(len(now)), np.zeros((first[-1], dims + 1))
            for batch in batches:
                given = dict(zip(batch.schema.names, batch.columns))
                for i in range(batch.num_rows):
                    data, cells = (np.frombuffer(given[c][i].as_buffer(), np.float64) for c in ("x", "cells"))
                    data, cells = data.reshape(dims + 1, -1, CELL_ROWS), cells.reshape(3 * dims + 2, -1)
                    for f, c in enumerate(now):
                        cost, own = _block_round(c, data, cells)
                        far[f] += cost
                        total[first[f] : first[f + 1]] += own
            flat = np.concatenate([far, total.ravel()])
            yield pa.record_batch({"i": pa.array(np.arange(len(flat), dtype=np.int32)), "v": pa.array(flat)})

        # a fixed number of sums per fit, whatever the data
        found = laid.mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.array([r["v"] for r in sorted(found, key=lambda r: r["i"])])
        if not len(flat):
            break
        total = flat[len(live):].reshape(-1, dims + 1)
        still = []
        for f, i in enumerate(live):
            part = total[first[f] : first[f + 1]]
            # a centre without rows stays
            moved = np.where(part[:, :1] > 0, part[:, 1:] / np.where(part[:, :1] > 0, part[:, :1], 1.0), now[f])
            costs[i] = float(flat[f])
            if (((moved - now[f]) ** 2).sum(axis=1) > tol * tol).any():
                still.append(i)
            centres[i] = moved
        live = still
    laid.unpersist()
    return centres, costs


def _weighted(df: DataFrame, cols: list[str], weight: str | None = None) -> DataFrame:
    """Complete rows: the columns, and a weight last."""
    rows = df.na.drop("any", subset=list(cols))
    return rows.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(weight).cast("double").alias("_w") if weight else F.lit(1.0).alias("_w"))


def fit_kmeans_many(df: DataFrame, cols: list[str], ks: list[int], restarts: int = 10, seed: int = 1, weight: str | None = None) -> list:
    """For each of ``ks`` the centres of the cheapest of ``restarts`` fits. All fits choose their first centres (Spark ML's k-means||) and run their
    rounds in common passes over the rows."""
    jobs = [(k, seed + i) for k in ks for i in range(restarts)]
    rows = _weighted(df, cols, weight).persist()
    centres, costs = _lloyd(rows, _first_centres(rows, jobs))
    rows.unpersist()
    return [centres[min((i for i, j in enumerate(jobs) if j[0] == k), key=lambda i: costs[i])] for k in ks]


def fit_kmeans(df: DataFrame, cols: list[str], k: int, restarts: int = 10, seed: int = 1, weight: str | None = None):
    """``fit_kmeans_many`` of one k; centres are sorted by their first coordinate when labelling."""
    return fit_kmeans_many(df, cols, [k], restarts, seed, weight)[0]


def label_clusters(df: DataFrame, cols: list[str], centres, out: str = "cluster") -> DataFrame:
    """The number of the nearest centre, counted by first coordinate; rows with a missing value are left out."""
    at = sorted(tuple(map(float, c)) for c in centres)
    far = [reduce(lambda a, b: a + b, [(F.col(c) - v) * (F.col(c) - v) for c, v in zip(cols, p)]) for p in at]
    near = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).cast("long").alias("i")) for i, d in enumerate(far)]))["i"]
    return df.na.drop("any", subset=cols).withColumn(out, near)


def silhouette(df: DataFrame, cols: list[str], cluster: str = "cluster") -> float:
    """Mean silhouette on squared distances, which needs one pass; the plain distance would need every pair of rows."""
    e = ClusteringEvaluator(featuresCol="features", predictionCol="_p")
    return e.evaluate(vectors(df.withColumn("_p", F.col(cluster).cast("int")), cols))


def curvedness(rings: DataFrame, scores: str, k: int, spark=None) -> tuple[DataFrame, object]:
    """First component of the top-k scores of every outline and two clusters on it; ``outlier`` marks scores above 1."""
    cols = [f"s{i}" for i in range(k)]
    wide = rings.select(*[c for c in rings.columns if c != scores], *[F.col(scores)[i].alias(c) for i, c in enumerate(cols)])
    comp = fit_components(wide, cols, 1)
    scored = comp.transform(wide, 1).drop(*cols)
    km = fit_kmeans(scored, ["pc0"], 2)
    return label_clusters(scored, ["pc0"], km).withColumn("outlier", F.col("pc0") > 1), comp


def balanced(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Class weights rows / (classes * class size)."""
    from pyspark.sql import Window

    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy(F.lit(0))  # one row per class
    w = c.select(label, (F.sum("_n").over(every) / (F.count(F.lit(1)).over(every) * F.col("_n"))).alias(out))
    return df.join(F.broadcast(w), label)  # one row per class


def logistic(df: DataFrame, cols: list[str], label: str, states: str | None = None, strength: float = 1e-3):
    """L1 multinomial regression with balanced classes, optionally with one-hot states; returns (model, transform)."""
    def prepare(t: DataFrame) -> DataFrame:
        names = list(cols)
        if states:
            t = encoder.transform(t.withColumn("_state", F.col(states).cast("int")))
            names.append("_onehot")
        return vectors(t, names)
    encoder = OneHotEncoder(inputCol="_state", outputCol="_onehot", dropLast=False).fit(df.withColumn("_state", F.col(states).cast("int"))) if states else None
    train = balanced(prepare(df).withColumn("label", F.col(label).cast("double")), "label")
    model = LogisticRegression(elasticNetParam=1.0, regParam=strength, weightCol="weight", family="multinomial", maxIter=50).fit(train)
    return model, lambda t: model.transform(prepare(t)).withColumn("pred", F.col("prediction").cast("long")).drop("features", "rawPrediction", "prediction")


#: Different rows up to which boosted stumps choose their cuts from the values themselves, as Spark ML does.
STUMP_ROWS = 65536


def _weighted_cuts(df: DataFrame, col: str, weight: str, bins: int) -> list[float]:
    """At most ``bins`` - 1 cuts between the different values of a column, with about equal weight between them; all rows count."""
    import numpy as np

    values = df.groupBy(col).agg(F.sum(weight).alias("_w"))
    total = df.agg(F.sum(weight)).first()[0]
    ahead = running_total(values, [col], F.col("_w"), "_before")
    # by the middle of a value's weight, so that a heavy value does not take the lighter ones before it into its bin
    part = F.least(F.lit(bins - 1), F.floor((F.col("_before") + F.col("_w") / 2) * bins / total))
    ends = ahead.groupBy(part.alias("_part")).agg(F.min(col).alias("lo"), F.max(col).alias("hi")).orderBy("_part").collect()  # at most ``bins`` rows
    # a value on the cut itself goes left, as in a tree; Bucketizer would put it right
    cuts = [float(np.nextafter((a["hi"] + b["lo"]) / 2, np.inf)) for a, b in zip(ends, ends[1:])]
    return sorted({c for c in cuts if math.isfinite(c)})


def boosted_stumps(df: DataFrame, cols: list[str], label: str, positive_weight: float = 9.0, rounds: int = 100, bins: int = 256, seed: int = 1):
    """Boosted depth-1 trees with heavier positives and ``bins`` candidate cuts per column; returns a function that adds ``score``.

    A stump only asks in which bin a value lies, so rows alike in all bins and the label go through the rounds as one row with their weight.
    Where there are more than ``STUMP_ROWS`` different rows, columns of more than ``bins`` different values are cut into bins of about equal
    weight first. The rounds then read at most as many rows as there are combinations of bins, however many rows fit the model.
    """
    weight = F.when(F.col(label) == 1, positive_weight).otherwise(1.0)
    rows = df.na.drop("any", subset=cols).select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(label).cast("double").alias("label"), weight.alias("weight"))
    alike = lambda t, names: t.groupBy(*names, "label").agg(F.sum("weight").alias("weight"))
    cells, names, bucket = stored(alike(rows, cols)), list(cols), lambda t: t
    if cells.count() > STUMP_ROWS:
        size = cells.agg(*[F.count_distinct(c).alias(c) for c in cols]).first()
        cuts = {c: _weighted_cuts(cells, c, "weight", bins) for c in cols if size[c] > bins}
        many = [c for c in cuts if cuts[c]]
        if many:
            splits = [[-math.inf, *cuts[c], math.inf] for c in many]
            bucket = Bucketizer(splitsArray=splits, inputCols=many, outputCols=[f"_{c}_bin" for c in many]).transform
            names = [f"_{c}_bin" if c in many else c for c in cols]
            before, cells = cells, stored(alike(bucket(cells), names))
            discard(before)
    model = GBTClassifier(maxDepth=1, maxIter=rounds, maxBins=bins, weightCol="weight", seed=seed).fit(vectors(cells, names))
    discard(cells)
    spare = ["features", "rawPrediction", "probability", "prediction", *[n for n in names if n not in cols]]
    return lambda d: model.transform(vectors(bucket(d.na.drop("any", subset=cols)), names)).withColumn("score", vector_to_array("probability")[1]).drop(*spare)


def cut_points(df: DataFrame, col: str, label: str, least: int = 2000, bins: int = 4096, seed: int = 1) -> list[float]:
    """Thresholds of a tree with at most three leaves of at least ``least`` rows on one feature; cuts are tried at ``bins`` quantiles."""
    t = vectors(df.withColumn("label", F.col(label).cast("double")), [col])
    tree = DecisionTreeClassifier(maxDepth=2, maxBins=bins, minInstancesPerNode=least, seed=seed).fit(t)
    found = []

    def visit(node, depth):
        if node.numDescendants() == 0:
            return
        found.append((depth, -node.gain(), node.split().threshold()))
        visit(node.leftChild(), depth + 1)
        visit(node.rightChild(), depth + 1)
    visit(tree._call_java("rootNode"), 0)
    # three leaves: the root split and the better of the splits below it
    return sorted(t for _, _, t in sorted(found)[:2])


def gaussian_starts(df: DataFrame, jobs: list[tuple[list[str], int]], seed: int = 1, diagonal: bool = False) -> list:
    """Start of a Gaussian model for each (columns, states): KMeans centres, unit covariances. Fits run side by side."""
    import numpy as np

    from . import hmm

    def start(job):
        i, (cols, k) = job
        m = KMeans(k=k, seed=seed + i, featuresCol="features").fit(vectors(df.select(*cols), cols))
        centres = np.array(m.clusterCenters())
        while len(centres) < k:  # fewer different rows than states
            centres = np.vstack([centres, centres[-1] + 0.1])
        return hmm.gaussian_start(centres, np.stack([np.eye(len(cols))] * k), diagonal=diagonal)
    with ThreadPoolExecutor(4) as pool:
        return list(pool.map(start, enumerate(jobs)))


def subset_search(df: DataFrame, must: list[str], optional: list[str], manual: str, ks=None, repeats: int = 2, rounds: int = 100) -> DataFrame:
    """Mean best one-vs-rest F1 of the states of Gaussian sequence models against the manual label, for every feature subset, at its
    best number of states, best subset first.

    Every subset of ``optional`` is a bit mask; for its l features, states run over ``ks`` or 3 + l // 2 .. 5 + l, each fitted ``repeats`` times
    from another start. All models are fitted in common passes (``hmm.fit_many``), and their states are counted in one pass.
    """
    from . import hmm

    every = must + optional
    plan = []
    for mask in range(1 << len(optional)):
        cols = must + [c for i, c in enumerate(optional) if mask >> i & 1]
        plan += [(mask, cols, k, r) for k in (ks or range(3 + len(cols) // 2, 6 + len(cols))) for r in range(repeats)]
    starts = gaussian_starts(df, [(cols, k) for _, cols, k, _ in plan])
    fitted = hmm.fit_many(df, every, [(cols, m) for (_, cols, _, _), m in zip(plan, starts)], rounds)
    counts = hmm.state_counts(df, every, [(cols, m) for (_, cols, _, _), m in zip(plan, fitted)], manual)
    # F1 of a state: 2 tp / (rows of the state + positives)
    totals = counts.groupBy("m").agg(F.sum("tp").alias("positives"))
    f1 = counts.join(totals, "m").groupBy("m").agg(F.max(F.try_divide(2 * F.col("tp"), F.col("size") + F.col("positives"))).alias("f1"))
    named = df.sparkSession.createDataFrame([(i, mask, ",".join(cols), k) for i, (mask, cols, k, _) in enumerate(plan)], "m int, mask int, features string, k int")
    mean = named.join(f1, "m").groupBy("mask", "features", "k").agg(F.avg(F.coalesce("f1", F.lit(0.0))).alias("f1"))
    return mean.groupBy("mask", "features").agg(F.max_by(F.struct("k", "f1"), F.struct("f1", -F.col("k"))).alias("b")).select("mask", "features", "b.k", "b.f1").orderBy(F.desc("f1"), "mask")
