"""Sweeps whose rule looks at runs of frames: bands low < score < high, then a least width of runs, over a whole parameter grid.

Rows are never copied per combination. A frame is in the band of low p and high q when p is below its rank among the lows and q is not below
its rank among the highs. For each low the frames are taken in the order of their rank among the highs: with each further high
new frames join, and runs that they touch merge, so every band's runs come from those of the band before. Work for a band is in
proportion to its runs and new frames.

Rows are dealt by (track, chunk). A run that goes on over a border (both neighbouring frames are in the band) is put together from one
row per chunk and band that it crosses; all others are summed where they are. A task sums over all its chunks before it emits a row, so
grids of many combinations and many short tracks do not multiply either.

The skeleton rule makes one score per setting of its own thresholds inside the task, from frames it sees anyway.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geom import distance, xy
from .chunk import with_halo
from .clean import CORE_PARTS
from .evaluate import rates_from_counts

#: Rows that a task works on at a time, at least one chunk.
ROWS = 1 << 16
_OUT = "variant int, low int, high int, width int, track string, chunk long, left boolean, right boolean, first long, n long, m1 long, m0 long, end1 long, end0 long"


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of sorted rows, many at a time, and the number of each row's group."""
    held: list[pa.RecordBatch] = []

    def numbered(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            code = t.column(k).dictionary_encode().unify_dictionaries().combine_chunks().indices.fill_null(-1).to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return np.cumsum(new)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            t = pa.Table.from_batches(held).combine_chunks()
            group = numbered(t)
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield t[:cut], group[:cut]
                held = t[cut:].to_batches()
    if held and sum(b.num_rows for b in held):
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, numbered(t)


def _merge(s, e, more):
    """Runs (s, e) with the ascending positions ``more`` added."""
    step = np.flatnonzero(np.diff(more) != 1)
    s, e = np.concatenate((s, more[np.append(0, step + 1)])), np.concatenate((e, more[np.append(step, len(more) - 1)]))
    by = np.argsort(s, kind="stable")
    s, e = s[by], e[by]
    apart = s[1:] != e[:-1] + 1
    return s[np.append(True, apart)], e[np.append(apart, True)]


class _Sums:
    """Sums of kept frames per (variant, low, high, width), and the pieces of runs that cross chunks."""

    def __init__(self, variants: int, lows, highs, widths, least: int):
        self.lows, self.highs, self.widths, self.least = np.array(lows), np.array(highs), widths, least
        self.sums = np.zeros((variants, len(lows), len(highs), len(widths or [None]), 3), np.int64)

    def add(self, variant: int, score, group, own, m1, m0) -> Iterator[tuple]:
        """Adds one table; yields low, high, and arrays (start, end, left, right) of runs that go on beyond their chunk."""
        low, high = np.searchsorted(self.lows, score), np.searchsorted(self.highs, score, "right")
        low[np.isnan(score)] = 0
        at = np.flatnonzero(own)
        # what stands just outside the chunk, if the track goes on there
        beside = []
        for shift in (-1, 1):
            near = np.clip(at + shift, 0, len(own) - 1)
            there = (near != at) & (group[near] == group[at]) & ~own[near]
            beside.append((np.where(there, low[near], 0), high[near]))
        low, high, m1, m0, group = low[at], high[at], m1[at], m0[at], group[at]
        # positions of different groups never touch
        place = np.arange(len(at)) + group
        back = np.full(int(place[-1]) + 1 if len(place) else 0, -1)
        back[place] = np.arange(len(at))
        c1, c0 = (np.concatenate(([0], np.cumsum(m))) for m in (m1, m0))
        sums = self.sums[variant]
        if self.widths is None:
            cells = np.zeros((3, len(self.lows) + 1, len(self.highs) + 1))
            for k, w in enumerate((np.ones(len(at)), m1, m0)):
                np.add.at(cells[k], (low, high), w)
            # in the band: rank above p among the lows, at most q among the highs
            inside = cells[:, ::-1].cumsum(axis=1)[:, ::-1].cumsum(axis=2)
            sums[..., 0, :] += np.moveaxis(inside[:, 1:, :-1], 0, 2).astype(np.int64)
            return
        for p in range(len(self.lows)):
            on = np.flatnonzero(low > p)
            on = on[np.argsort(high[on], kind="stable")]
            edge = np.searchsorted(high[on], np.arange(len(self.highs) + 1))
            s = e = np.zeros(0, np.int64)
            for q in range(len(self.highs)):
                if edge[q + 1] > edge[q]:
                    s, e = _merge(s, e, place[on[edge[q] : edge[q + 1]]])
                if not len(s):
                    continue
                a, b = back[s], back[e]
                left, right = (beside[0][0][a] > p) & (beside[0][1][a] <= q), (beside[1][0][b] > p) & (beside[1][1][b] <= q)
                open_ = left | right
                if open_.any():
                    yield p, q, at[a[open_]], at[b[open_]], left[open_], right[open_], np.stack([c1[b + 1] - c1[a], c0[b + 1] - c0[a], m1[b], m0[b]])[:, open_]
                a, b = a[~open_], b[~open_]
                for w, width in enumerate(self.widths):
                    wide = b - a > max(self.least, width)
                    x, y = a[wide], b[wide]
                    sums[p, q, w] += ((y - x).sum(), (c1[y] - c1[x]).sum(), (c0[y] - c0[x]).sum())


def run_counts(df: DataFrame, lows, highs, widths, manual: str, last: str, scores: Callable[[dict, np.ndarray], list[np.ndarray]], columns: list[str], variants: int = 1,
               least: int = 10, reach: int = 0, key: str = "track_id", size: int | None = None) -> DataFrame:
    """variant, low, high, width (positions in ascending lists), tp, fp, tn, fn. ``scores`` turns the named columns of some groups, and the group of
    each row, into one array per variant; it looks back ``reach`` frames. ``widths`` None: runs of any width are kept whole."""
    lows, highs = sorted(map(float, lows)), sorted(map(float, highs))
    rows = with_halo(df.select(key, "frame", manual, last, *columns), before=reach + 1, after=1, size=size)
    name = [c for c in rows.columns if c not in (key, manual, last)]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, names = _Sums(variants, lows, highs, widths, least), [f.split()[0] for f in _OUT.split(", ")]
        for t, group in _groups(batches, [key, "_chunk"]):
            values = {c: t.column(c).to_numpy().astype(float) for c in columns}
            own = t.column("_own").to_numpy().astype(bool)
            late = t.column(last).to_numpy().astype(bool)
            mark = t.column(manual).to_numpy()
            track, chunk = t.column(key).cast(pa.string()), t.column("_chunk").to_numpy()
            for v, score in enumerate(scores(values, group)):
                for p, q, a, b, left, right, (s1, s0, e1, e0) in total.add(v, score, group, own, ((mark == 1) & ~late).astype(np.int64), ((mark == 0) & ~late).astype(np.int64)):
                    same = [pa.array(np.full(len(a), x, np.int32)) for x in (v, p, q, -1)]
                    yield pa.RecordBatch.from_arrays([*same, track.take(pa.array(a)).combine_chunks(), pa.array(chunk[a]), pa.array(left), pa.array(right), pa.array(a), pa.array(b - a + 1), pa.array(s1), pa.array(s0), pa.array(e1), pa.array(e0)], names)
        at = np.argwhere(total.sums[..., 0] > 0)
        if len(at):
            found = total.sums[tuple(at.T)]
            none = [pa.nulls(len(at), k) for k in (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*[pa.array(at[:, j].astype(np.int32)) for j in range(4)], *none, *[pa.array(found[:, j]) for j in range(3)], *[pa.nulls(len(at), pa.int64())] * 2], names)

    counted = rows.repartition(key, "_chunk").sortWithinPartitions(key, "_chunk", "frame").select(key, manual, last, *name).mapInArrow(count, _OUT)
    from ..sources.tables import stored

    counted = stored(counted)
    band = ["variant", "low", "high"]
    # a piece that is not open to the left begins a run; of two pieces of a chunk the one that ends a run comes first
    order = Window.partitionBy(*band, "track").orderBy("chunk", "first").rowsBetween(Window.unboundedPreceding, 0)
    pieces = counted.where("width < 0").withColumn("run", F.sum(F.when(F.col("left"), 0).otherwise(1)).over(order))
    whole = pieces.groupBy(*band, "track", "run").agg(F.sum("n").alias("n"), *[(F.sum(m) - F.max_by(e, F.struct("chunk", "first"))).alias(m) for m, e in (("m1", "end1"), ("m0", "end0"))])
    wide = F.filter(F.array(*[F.struct(F.lit(i).alias("width"), F.lit(float(w)).alias("least")) for i, w in enumerate(widths or [0.0])]), lambda x: F.col("n") - 1 > F.greatest(x["least"], F.lit(float(least))))
    whole = whole.withColumn("w", F.explode(wide)).select(*band, "w.width", (F.col("n") - 1).alias("n"), "m1", "m0")
    kept = counted.where("width >= 0").select(*band, "width", "n", "m1", "m0").unionByName(whole).groupBy(*band, "width").agg(*[F.sum(c).alias(c) for c in ("n", "m1", "m0")])
    grid = df.sparkSession.range(variants * len(lows) * len(highs) * len(widths or [0])).select(*[
        F.expr(f"cast(id div {step} % {n} as int)").alias(c) for c, n, step in (("variant", variants, 1), ("low", len(lows), variants), ("high", len(highs), variants * len(lows)), ("width", len(widths or [0]), variants * len(lows) * len(highs)))])
    every = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when((F.col(manual) == 0) & ~F.col(last), 1).otherwise(0)).alias("off"))
    out = grid.join(kept, [*band, "width"], "left").na.fill(0, ["n", "m1", "m0"]).crossJoin(F.broadcast(every))  # one row
    tn = F.col("off") - F.col("m0")
    return out.select(*band, "width", F.col("m1").alias("tp"), (F.col("n") - F.col("m1")).alias("fp"), tn.alias("tn"), (F.col("rows") - F.col("n") - tn).alias("fn"))


def _named(table: DataFrame, lists: dict[str, list[float]], ranks: dict[str, tuple[str, list[float]]], others: list[str]) -> DataFrame:
    """Parameters and param_id (first list fastest) instead of positions. ``ranks``: parameter to its column and ascending values; ``others``: the
    parameters that number the variants, first fastest."""
    stride, out, at = 1, table, {}
    step = 1
    for name in others:
        at[name] = F.expr(f"cast(variant div {step} % {len(lists[name])} as int)")
        step *= len(lists[name])
    for name, (column, values) in ranks.items():
        at[name] = F.element_at(F.array(*[F.lit([float(x) for x in lists[name]].index(v)) for v in values]), F.col(column) + 1)
    number = F.lit(0)
    for name, values in lists.items():
        number = number + at[name] * stride
        stride *= len(values)
    values = {name: F.element_at(F.array(*[F.lit(float(x)) for x in v]), at[name] + 1) for name, v in lists.items()}
    return rates_from_counts(out.select(number.cast("int").alias("param_id"), *[c.alias(n) for n, c in values.items()], "tp", "fp", "tn", "fn"))


def width_sweep(df: DataFrame, lists: dict[str, list[float]], score: str, manual: str, last: str, **kw) -> DataFrame:
    """Counts and rates for the band p0..p1 and runs wider than p2, for all combinations of different values."""
    p0, p1, p2 = (sorted(set(map(float, lists[p]))) for p in ("p0", "p1", "p2"))
    table = run_counts(df, p0, p1, p2, manual, last, lambda c, _: [c[score]], [score], **kw)
    return _named(table, lists, {"p0": ("low", p0), "p1": ("high", p1), "p2": ("width", p2)}, [])


def trace_sweep(df: DataFrame, lists: dict[str, list[float]], angle: Column, manual: str, last: str, width: bool = False, **kw) -> DataFrame:
    """Skeleton rules with p2..p6 (p3..p7 with a width p2), then the band p0..p1 on the angle."""
    others = [f"p{i}" for i in range(3 if width else 2, 8 if width else 7)]
    settings = [[float(lists[p][i // int(np.prod([len(lists[x]) for x in others[:j]])) % len(lists[p])]) for j, p in enumerate(others)] for i in range(int(np.prod([len(lists[p]) for p in others])))]
    h, r, l, t = xy("A_head"), xy("B_rightoperculum"), xy("E_leftoperculum"), xy("D_tailtip")
    spans = [distance(a, b).alias(f"_d{i}") for i, (a, b) in enumerate(((h, t), (l, r), (h, r), (h, l), (t, l), (t, r)))]
    coordinates = [f"{p}_{a}" for p in CORE_PARTS for a in "xy"]

    def scores(c: dict, group: np.ndarray) -> Iterator[np.ndarray]:
        follows = np.append(False, group[1:] == group[:-1])
        for jump, body, origin, head, tail in settings:
            big = c["_d0"] > body
            for i, limit in ((1, head), (2, head), (3, head), (4, tail), (5, tail)):
                big = big | (c[f"_d{i}"] > limit)
            dead = np.zeros(len(group), bool)
            for i, name in enumerate(coordinates):
                alive = np.where(dead, np.nan, c[name])
                before = np.where(follows, np.append(np.nan, alive[:-1]), np.nan)
                dead = dead | (np.abs(alive - before) > jump) | (alive < origin)
                dead = dead | big if i == 0 else dead
            yield np.where(dead, np.nan, c["_angle"])

    p0, p1 = (sorted(set(map(float, lists[p]))) for p in ("p0", "p1"))
    p2 = sorted(set(map(float, lists["p2"]))) if width else None
    rows = df.select("track_id", "frame", manual, last, *coordinates, *spans, angle.alias("_angle"))
    table = run_counts(rows, p0, p1, p2, manual, last, scores, [*coordinates, *[f"_d{i}" for i in range(6)], "_angle"], len(settings), reach=len(coordinates), **kw)
    return _named(table, lists, {"p0": ("low", p0), "p1": ("high", p1), **({"p2": ("width", p2)} if width else {})}, others)
