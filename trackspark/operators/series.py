"""Ordered functions over one track; every window reaches a fixed number of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schema import FPS
from .chunk import windowed


def forward_diff(df: DataFrame, col: str, out: str = "diff", **kw) -> DataFrame:
    return windowed(df, lambda w: {out: F.lead(col).over(w) - F.col(col)}, after=1, **kw)


def point_speed(df: DataFrame, x: str, y: str, frames: int = 1, fps: int = FPS, out: str = "speed", **kw) -> DataFrame:
    """Distance to the position ``frames`` earlier, per second."""
    def stage(w):
        dx, dy = F.lag(x, frames).over(w) - F.col(x), F.lag(y, frames).over(w) - F.col(y)
        return {out: F.sqrt(dx * dx + dy * dy) / F.lit(frames / fps)}
    return windowed(df, stage, before=frames, **kw)


def opening_speed(df: DataFrame, col: str, fps: int = FPS, out: str = "speed", **kw) -> DataFrame:
    """Absolute change to the next frame per second; null on the last frame."""
    return windowed(df, lambda w: {out: F.abs(F.lead(col).over(w) - F.col(col)) / F.lit(1 / fps)}, after=1, **kw)


def local_max(df: DataFrame, col: str, width: int = 20, out: str = "local_max", skip_nulls: bool = True, **kw) -> DataFrame:
    """Max of rows i-width .. i+width-1; the last row of a track never counts."""
    def visible(w):
        last = F.lead(F.lit(1)).over(w).isNull()
        return {"_x": F.when(~last, F.col(col)), "_hole": F.when(~last & F.col(col).isNull(), 1)}

    def peak(w):
        near = w.rowsBetween(-width, width - 1)
        top = F.max("_x").over(near)
        return {out: top if skip_nulls else F.when(F.max("_hole").over(near).isNull(), top)}
    return windowed(df, visible, peak, before=width, after=width, **kw).drop("_x", "_hole")


def rolling_mean(df: DataFrame, col: str, width: int = 3, out: str = "mean", **kw) -> DataFrame:
    def stage(w):
        near = w.rowsBetween(1 - width, 0)
        return {out: F.when(F.count(col).over(near) == width, F.avg(col).over(near))}
    return windowed(df, stage, before=width - 1, **kw)


def shifted(df: DataFrame, col: str, frames: int, out: str, **kw) -> DataFrame:
    """Value ``frames`` earlier (later when negative)."""
    return windowed(df, lambda w: {out: F.lag(col, frames).over(w)}, before=max(frames, 0), after=max(-frames, 0), **kw)


def turning_angle(df: DataFrame, vx, vy, frames: int = 40, out: str = "turning", **kw) -> DataFrame:
    """Angle of a direction vector to itself ``frames`` earlier (later when negative), in degrees."""
    from ..functions.geom import vector_angle

    base = df.withColumns({"_vx": vx, "_vy": vy})
    return windowed(
        base,
        lambda w: {"_px": F.lag("_vx", frames).over(w), "_py": F.lag("_vy", frames).over(w)},
        lambda w: {out: vector_angle(F.col("_vx"), F.col("_vy"), F.col("_px"), F.col("_py"))},
        before=max(frames, 0), after=max(-frames, 0), **kw).drop("_vx", "_vy", "_px", "_py")


def crossings(df: DataFrame, col: str, threshold: float, side: str = "down", reach: int = 7, **kw) -> DataFrame:
    """Frames where the ``reach`` values before are all on one side and this one and ``reach`` after on the other."""
    def stage(w):
        past, ahead = w.rowsBetween(-reach, -1), w.rowsBetween(0, reach)
        full = (F.count(col).over(past) == reach) & (F.count(col).over(ahead) == reach + 1)
        if side == "down":
            turn = (F.min(col).over(past) > threshold) & (F.max(col).over(ahead) < threshold)
        else:
            turn = (F.max(col).over(past) < threshold) & (F.min(col).over(ahead) > threshold)
        return {"_cross": full & turn}
    return windowed(df, stage, before=reach, after=reach, **kw).where("_cross").drop("_cross")


def dilate(df: DataFrame, col: str, size: int = 10, out: str = "dilated", **kw) -> DataFrame:
    """1 where any of rows i-(size/2-1) .. i+size/2 is 1 (an even structure is off centre)."""
    half = size // 2
    return windowed(df, lambda w: {out: F.max(col).over(w.rowsBetween(1 - half, half))}, before=half - 1, after=half, **kw)


def smooth_quadratic(df: DataFrame, col: str, half: int = 10, out: str = "smooth", **kw) -> DataFrame:
    """Local least-squares parabola through the non-null rows within ``half`` frames, read at the row itself."""
    def collect(w):
        point = F.when(F.col(col).isNotNull(), F.struct(F.col("frame").alias("t"), F.col(col).alias("v")))
        return {"_near": F.collect_list(point).over(w.rowsBetween(-half, half))}  # at most 2 * half + 1 points

    def moments(_w):
        power = lambda p: f"pow(cast(q.t - frame as double), {p})"
        s = {f"_s{p}": F.expr(f"aggregate(_near, 0D, (a, q) -> a + {power(p)})") for p in range(5)}
        return s | {f"_m{p}": F.expr(f"aggregate(_near, 0D, (a, q) -> a + q.v * {power(p)})") for p in range(3)}

    def solve(_w):
        s0, s1, s2, s3, s4 = (F.col(f"_s{p}") for p in range(5))
        m0, m1, m2 = (F.col(f"_m{p}") for p in range(3))
        # constant term of the normal equations by Cramer's rule
        det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
        top = m0 * (s2 * s4 - s3 * s3) - s1 * (m1 * s4 - m2 * s3) + s2 * (m1 * s3 - m2 * s2)
        return {out: F.when(F.size("_near") >= 3, F.try_divide(top, det))}
    drop = ["_near", *[f"_s{p}" for p in range(5)], *[f"_m{p}" for p in range(3)]]
    return windowed(df, collect, moments, solve, before=half, after=half, **kw).drop(*drop)


def peri_event(df: DataFrame, events: DataFrame, reach: int = 200, margin: int = 1, keys=("track_id",)) -> DataFrame:
    """Rows within ``reach`` frames of each event later than ``reach + margin``, with their offset."""
    slots = events.where(F.col("event") > reach + margin).select(
        *keys, "event", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("offset"))
    slots = slots.withColumn("frame", F.col("event") + F.col("offset"))
    return slots.join(df, [*keys, "frame"], "left")


def repeat_columns(cols: DataFrame, hop: int = 50, keys=("track_id",), idx: str = "col", value: str = "score") -> DataFrame:
    """Spread block values back to frames: ``hop`` frames each, half of that for the first and the last block."""
    last = cols.groupBy(*keys).agg(F.max(idx).alias("_last"))
    c = cols.join(last, list(keys))
    start = F.when(F.col(idx) == 0, 0).otherwise(F.col(idx) * hop - hop // 2)
    length = F.when((F.col(idx) == 0) | (F.col(idx) == F.col("_last")), hop // 2).otherwise(hop)
    return c.select(*keys, F.explode(F.sequence(start, start + length - 1)).alias("frame"), value).withColumn("frame", F.col("frame").cast("long"))
