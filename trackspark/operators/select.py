"""Slices, samples, splits and label vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schema import FPS
from .chunk import running_total


def frame_range(df: DataFrame, start: int, stop: int | None = None) -> DataFrame:
    out = df.where(F.col("frame") >= start)
    return out if stop is None else out.where(F.col("frame") < stop)


def duration_window(df: DataFrame, start: int, seconds: float, stop: int | None = None, fps: int = FPS) -> DataFrame:
    return frame_range(df, start, stop if stop is not None else start + int(fps * seconds))


def renumber(df: DataFrame, start: int, out: str = "new_frame") -> DataFrame:
    return df.withColumn(out, F.col("frame") - start)


def every(df: DataFrame, k: int, start: int = 0) -> DataFrame:
    """Every k-th frame counted from ``start``."""
    return df.where((F.col("frame") - start) % k == 0)


def clock(df: DataFrame, fps: int = FPS) -> DataFrame:
    minutes = F.col("frame") / F.lit(float(fps)) / F.lit(60)
    return df.withColumn("minute", F.floor(minutes)).withColumn(
        "second", F.col("frame") / F.lit(float(fps)) - F.lit(60) * F.col("minute"))


def split_tracks(df: DataFrame, share: float = 0.75, out: str = "part") -> DataFrame:
    """First ``share`` of the tracks by id are 'train', the rest 'test'."""
    tracks = df.select("track_id").distinct()
    total = tracks.agg(F.count(F.lit(1)).alias("_n"))
    pos = running_total(tracks, ["track_id"], F.lit(1), "_i").crossJoin(F.broadcast(total))  # one row
    part = pos.select("track_id", F.when(F.col("_i") + 1 <= share * F.col("_n"), "train").otherwise("test").alias(out))
    return df.join(part, "track_id")


def collapse_rare(df: DataFrame, label: str, fit_on: Column, least: float | None = None, other: str = "OTHER") -> DataFrame:
    """Labels seen at most ``least`` times in the fitting rows become ``other`` (default: the mean count)."""
    counts = df.where(fit_on).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    cut = counts.agg((F.lit(least) if least is not None else F.avg("_n")).alias("_cut"))
    popular = counts.crossJoin(F.broadcast(cut)).where(F.col("_n") > F.col("_cut"))  # one row
    vocab = popular.select(label, F.lit(True).alias("_popular"))
    return df.join(vocab, label, "left").withColumn(label, F.when(F.col("_popular"), F.col(label)).otherwise(other)).drop("_popular")


def encode_labels(df: DataFrame, label: str, out: str = "code") -> DataFrame:
    """Alphabetical integer codes of the distinct labels."""
    codes = running_total(df.select(label).distinct(), [label], F.lit(1), out).withColumn(out, F.col(out).cast("long"))
    return df.join(codes, label)


def top_k(df: DataFrame, keys: tuple, value: str, tie: str, k: int) -> DataFrame:
    """The k rows with the largest value per key (smallest ``tie`` first), with their rank.

    Rows are thinned to k per key and slice of the tie column before the final ranking, so a hot key is ranked by many tasks.
    """
    part = F.pmod(F.hash(tie), F.lit(64))
    order = [F.col(value).desc(), F.col(tie)]
    thin = df.withColumn("_s", part).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(*order))).where(F.col("_r") <= k)
    return thin.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k).drop("_s", "_r")
