"""Bouts: intervals to frames and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunk import scan, windowed


def bout_frames(bouts: DataFrame, closed: bool = False, extra=(), keys=("track_id",)) -> DataFrame:
    """One row per frame of every half-open bout (closed: the stop frame too)."""
    last = F.col("stop") if closed else F.col("stop") - 1
    return bouts.where(last >= F.col("start")).select(
        *keys, *extra, F.explode(F.sequence(F.col("start"), last)).alias("frame"))


def bounds(bouts: DataFrame, closed: bool = False, keys=("track_id",), out: str = "_delta") -> DataFrame:
    """keys, frame and how many more bouts cover this frame than the one before; two rows a bout, whatever its length."""
    stop = F.col("stop") + 1 if closed else F.col("stop")
    ends = F.array(F.struct(F.col("start").cast("long").alias("frame"), F.lit(1).cast("long").alias("_d")), F.struct(stop.cast("long").alias("frame"), F.lit(-1).cast("long").alias("_d")))
    return bouts.where(stop > F.col("start")).select(*keys, F.inline(ends)).groupBy(*keys, "frame").agg(F.sum("_d").alias(out)).where(F.col(out) != 0)


def cover(frames: DataFrame, bouts: DataFrame, out: str = "covering", closed: bool = False, keys=("track_id",), size: int | None = None) -> DataFrame:
    """``frames`` with the number of bouts that cover each: a running sum of the bouts' bounds, also of those between or beyond the frames."""
    have = frames.drop("_chunk").withColumn("_have", F.lit(True))
    both = have.join(bounds(bouts, closed, keys), [*keys, "frame"], "full")
    return scan(both, {out: ("sum", F.coalesce("_delta", F.lit(0)))}, keys=keys, size=size).where("_have").drop("_have", "_delta")


def label_frames(frames: DataFrame, bouts: DataFrame, out: str = "manual", crop0: int = 0, drop_last: int = 0, keys=("track_id",), closed: bool = False, size: int | None = None) -> DataFrame:
    """Dense 0/1 per frame: inside any bout. Frames before ``crop0`` and the last ``drop_last`` are removed."""
    out_df = cover(frames, bouts, "_n", closed, keys, size)
    out_df = out_df.withColumn(out, F.when(F.col("_n") > 0, 1).otherwise(0).cast("long")).drop("_n")
    if "_chunk" not in frames.columns:
        out_df = out_df.drop("_chunk")
    if drop_last:
        out_df = windowed(out_df, lambda w: {"_keep": F.lead(F.lit(1), drop_last).over(w).isNotNull()}, after=drop_last, keys=keys)
        out_df = out_df.where("_keep").drop("_keep")
    return out_df.where(F.col("frame") >= crop0) if crop0 else out_df


#: Frames of a bin in which bouts and frames are compared.
BIN = 256


def bout_rows(frames: DataFrame, bouts: DataFrame, closed: bool = True, extra=("start",), bin_frames: int | None = None) -> DataFrame:
    """Rows of each bout, keeping the bout's columns: a join by bins of frames, so a bout makes a row per bin and not per frame."""
    n = bin_frames or BIN
    last = F.col("stop") if closed else F.col("stop") - 1
    binned = bouts.where(last >= F.col("start")).select(
        F.col("track_id").alias("_t"), *[F.col(c).alias(f"_e_{c}") for c in extra], F.col("start").alias("_a"), last.alias("_z"),
        F.explode(F.sequence(F.floor(F.col("start") / n), F.floor(last / n))).alias("_b"))
    rows = frames.withColumn("_bin", F.floor(F.col("frame") / n))
    on = (F.col("track_id") == F.col("_t")) & (F.col("_bin") == F.col("_b")) & F.col("frame").between(F.col("_a"), F.col("_z"))
    return rows.join(binned, on).select(*frames.columns, *[F.col(f"_e_{c}").alias(c) for c in extra])


def run_ends(df: DataFrame, value: str, keys=("track_id",), size: int | None = None) -> DataFrame:
    """Every row with ``start`` and ``stop`` (inclusive) of its run of equal values.

    A row that differs from the one before starts a run; the latest start and the next end are running values, so one exchange by
    chunk serves all of it.
    """
    def edges(w):
        prev, after = F.lag(value).over(w), F.lead(value).over(w)
        first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
        return {"_starts": first | ~prev.eqNullSafe(F.col(value)), "_ends": last | ~after.eqNullSafe(F.col(value))}
    marks = windowed(df, edges, before=1, after=1, keys=keys, size=size)
    at = F.col("frame")
    return scan(marks, {"start": ("last", F.when(F.col("_starts"), at)), "stop": ("next", F.when(F.col("_ends"), at))}, keys=keys, size=size)


def runs(df: DataFrame, value: str, keys=("track_id",), size: int | None = None) -> DataFrame:
    """Maximal runs of equal values: keys, value, start, stop (inclusive), length."""
    r = run_ends(df.select(*keys, "frame", value), value, keys, size).where("_starts")
    return r.select(*keys, value, "start", "stop", (F.col("stop") - F.col("start") + 1).alias("length"))


def _wide(width, least: int) -> Column:
    return (F.col("stop") > F.col("start") + least) & (F.col("stop") - F.col("start") > width)


def wide_bouts(df: DataFrame, binary: str, width=30, least: int = 10, keys=("track_id",), carry=(), **kw) -> DataFrame:
    """Runs of 1 that span more than ``width`` and ``least`` frames, as [start, last index).

    ``width`` may be a column; columns named in ``carry`` are constant per key and kept for it.
    """
    r = runs(df, binary, keys=(*keys, *carry), **kw).where(F.col(binary) == 1)
    return r.where(_wide(width, least)).select(*keys, "start", "stop")


def width_filter(df: DataFrame, binary: str, width=30, least: int = 10, out: str = "kept", keys=("track_id",), carry=(), **kw) -> DataFrame:
    """Keep only wide runs of 1; the last frame of a kept run becomes 0. Rows are neither expanded nor joined."""
    r = run_ends(df, binary, keys, **kw)
    kept = (F.col(binary) == 1) & _wide(width, least) & (F.col("frame") < F.col("stop"))
    return r.withColumn(out, F.when(kept, 1).otherwise(0).cast("long")).drop("_starts", "_ends", "start", "stop")


def run_positions(df: DataFrame, valid: Column, start_at: int = 1, keys=("track_id",), **kw) -> DataFrame:
    """Counter of valid rows since the last invalid one; it starts at ``start_at`` on the first row of a track."""
    ok = F.when(valid, 1).otherwise(0)
    s = scan(df, {"_cum": ("sum", ok)}, keys=keys, **kw)
    s = scan(s, {"_base": ("max", F.when(~F.coalesce(valid, F.lit(False)), F.col("_cum")))}, keys=keys, **kw)
    return s.withColumn("position", F.col("_cum") - F.coalesce("_base", F.lit(-start_at))).drop("_cum", "_base")


def first_steady_frame(candidates: DataFrame, valid: Column, need: int = 50, keys=("track_id",), **kw) -> DataFrame:
    """First frame at which the counter of valid candidate rows reaches ``need``."""
    p = run_positions(candidates, valid, keys=keys, **kw).where(valid & (F.col("position") >= need))
    return p.groupBy(*keys).agg(F.min("frame").alias("start_frame"))


def repeat_codes(codes: DataFrame, idx: str = "idx", code: str = "code", duration: str = "duration", keys=("track_id",)) -> DataFrame:
    """Each code repeated for its own number of frames, in idx order."""
    c = scan(codes, {"_end": ("sum", F.col(duration))}, keys=keys, frame=idx)
    return c.where(F.col(duration) > 0).select(
        *keys, idx, code, F.explode(F.expr(f"sequence(_end - {duration}, _end - 1)")).alias("frame"))
