"""Sequential position check, run over frame chunks.

A point is rejected when it is farther than ``max_dist`` from the last accepted one while at most ``max_counter`` points
in a row were rejected, or when it is missing. The state (last accepted point, rejects in a row) flows from frame to frame,
so a chunk needs the state its predecessor ends with. Every chunk is first run from a warm-up stretch; chunks whose assumed
entry state differs from their predecessor's exit state are run again from that exit state until all agree. States are kept
in a table of one row per chunk.

``head_check`` adds a test against the body's outline: a point outside is rejected and counted, too, but its track's first present
point is what the next ones are measured from even if it lies outside itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import discard, stored
from .chunk import computed, with_chunk, with_halo
from .ring import edge_distance, inside

WARM_FRAMES = 256


def walk(x: np.ndarray, y: np.ndarray, state: tuple[float, float, int], max_dist: float, max_counter: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, tuple[float, float, int]]:
    """Accepted flags of a stretch and the state after it; a nan state position accepts the first present point. With ``allowed``, other
    points are rejected, and a nan state position becomes the first present point, allowed or not."""
    lx, ly, counter = state
    n = len(x)
    if allowed is not None:
        begin = np.flatnonzero(~(np.isnan(x) | np.isnan(y)))[:1]
        if np.isnan(lx) and len(begin):
            lx, ly = x[begin[0]], y[begin[0]]
        x, y = np.where(allowed, x, np.nan), np.where(allowed, y, np.nan)
    ok = np.zeros(n, dtype=bool)
    there = ~(np.isnan(x) | np.isnan(y))
    step = np.full(n, np.nan)
    step[1:] = np.hypot(x[1:] - x[:-1], y[1:] - y[:-1])
    stops = np.flatnonzero(~(step <= max_dist))
    i = 0
    while i < n:
        if there[i]:
            near = np.isnan(lx) or np.hypot(x[i] - lx, y[i] - ly) <= max_dist
            if near or counter > max_counter:
                # everything up to the next large step follows
                j = np.searchsorted(stops, i + 1)
                end = stops[j] if j < len(stops) else n
                ok[i:end] = True
                lx, ly, counter = x[end - 1], y[end - 1], 0
                i = end
                continue
        counter += 1
        i += 1
    return ok, (float(lx), float(ly), int(counter))


_STATE = "in_x double, in_y double, in_c long, out_x double, out_y double, out_c long"


def position_check(df: DataFrame, x: str, y: str, max_dist: float = 20, max_counter: int = 7, keys=("track_id",), size: int | None = None, allowed: str | None = None) -> DataFrame:
    """Null the points the check rejects. ``allowed`` names a boolean column; points where it is not true are rejected (see ``walk``)."""
    keys = list(keys)
    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    base = with_chunk(df, size=size)
    points = base.select(*keys, "_chunk", "frame", F.col(x).alias("x"), F.col(y).alias("y"), *([F.coalesce(allowed, F.lit(False)).alias("_allowed")] if allowed else []))

    def arrays(rows):
        rows = rows.sort_values("frame")
        flags = rows["_allowed"].to_numpy(bool) if allowed else None
        return rows, rows["x"].to_numpy(float, na_value=np.nan), rows["y"].to_numpy(float, na_value=np.nan), flags

    def state_row(key, entry, leave):
        return pd.DataFrame([[*key, *entry, *leave]], columns=[*keys, "_chunk", "in_x", "in_y", "in_c", "out_x", "out_y", "out_c"])

    fresh = (float("nan"), float("nan"), 0)

    def guess(key, rows):
        rows, px, py, flags = arrays(rows)
        own = rows["_own"].to_numpy()
        if not own.any():
            return pd.DataFrame(columns=[*keys, "_chunk", "in_x", "in_y", "in_c", "out_x", "out_y", "out_c"])
        mine, warm_up = (flags[own], flags[~own]) if allowed else (None, None)
        entry = walk(px[~own], py[~own], fresh, max_dist, max_counter, warm_up)[1]
        return state_row(key, entry, walk(px[own], py[own], entry, max_dist, max_counter, mine)[1])

    def rerun(key, rows):
        rows, px, py, flags = arrays(rows)
        entry = (float(rows["want_x"].iloc[0]), float(rows["want_y"].iloc[0]), int(rows["want_c"].iloc[0]))
        return state_row(key, entry, walk(px, py, entry, max_dist, max_counter, flags)[1])

    warm = with_halo(points, WARM_FRAMES, 0, size=size)
    states = stored(warm.groupBy(*keys, "_chunk").applyInPandas(guess, f"{types}, _chunk long, {_STATE}"))
    order = Window.partitionBy(*keys).orderBy("_chunk")
    while True:
        wanted = states.withColumns({f"want_{c}": F.lag(f"out_{c}").over(order) for c in "xyc"})
        differs = F.lit(False)
        for c in "xyc":
            differs = differs | ~F.col(f"want_{c}").eqNullSafe(F.col(f"in_{c}"))
        wrong = wanted.where(F.col("want_c").isNotNull() & differs).select(*keys, "_chunk", "want_x", "want_y", "want_c")
        if wrong.isEmpty():
            break
        again = points.join(wrong, [*keys, "_chunk"]).groupBy(*keys, "_chunk").applyInPandas(rerun, f"{types}, _chunk long, {_STATE}")
        before, states = states, stored(states.join(wrong.select(*keys, "_chunk"), [*keys, "_chunk"], "left_anti").unionByName(again))
        discard(before)

    def mark(key, rows):
        rows, px, py, flags = arrays(rows)
        entry = (float(rows["in_x"].iloc[0]), float(rows["in_y"].iloc[0]), int(rows["in_c"].iloc[0]))
        ok = walk(px, py, entry, max_dist, max_counter, flags)[0]
        return pd.DataFrame({**{k: v for k, v in zip([*keys, "_chunk"], key)}, "frame": rows["frame"].to_numpy(), "_ok": ok})

    marks = points.join(states.select(*keys, "_chunk", "in_x", "in_y", "in_c"), [*keys, "_chunk"]).groupBy(*keys, "_chunk").applyInPandas(
        mark, f"{types}, _chunk long, frame long, _ok boolean")
    out = base.join(marks.drop("_chunk"), [*keys, "frame"])
    return out.withColumns({c: F.when(F.col("_ok"), F.col(c)) for c in (x, y)}).drop("_ok")


def head_check(df: DataFrame, head: str, pts: str = "pts", margin: float = 5.0, max_dist: float = 20, max_counter: int = 7, keys=("track_id",), size: int | None = None) -> DataFrame:
    """Null the heads that lie outside the outline by more than ``margin`` or that the position check rejects; a frame without outline
    has no head. The outlines are dropped: they are tested once, before any shuffle."""
    x, y = f"{head}_x", f"{head}_y"
    tested = computed(df, {"_inside": inside(pts, x, y) | (edge_distance(pts, x, y) <= margin)}).drop(pts)
    return position_check(stored(tested), x, y, max_dist, max_counter, keys, size, "_inside").drop("_inside", "_chunk")
