"""Per-frame feature table from a raw pose table, in one chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geom as G
from ..sources.schema import FPS, SPINE8, SPINE10
from ..sources.tables import stored
from . import clean, fill, series, spine
from .chunk import computed, windowed
from .select import frame_range

OTHER = ["operculum", "orientation", "movement_speed", "turning_angle"]


def part_names(parts: list[str]) -> list[str]:
    return ["head", "spine1", "spine1.5", "spine2", "spine2.5", "spine3", "spine4", "spine5", "spine6", "spine7"] if len(parts) == 10 else [
        "head", *[f"spine{i}" for i in range(1, 8)]]


def group_columns(parts: list[str] = SPINE10) -> dict[str, list[str]]:
    """The four column groups of the table: other, curvature, diff_curvature, tangent."""
    names = [n.replace(".", "_") for n in part_names(parts)]
    return {"other": OTHER, **{g: [f"{g}_{n}" for n in names] for g in ("curvature", "diff_curvature", "tangent")}}


def other_features(pose: DataFrame, parts: list[str] = SPINE10) -> DataFrame:
    """Operculum angle, orientation, speed and turning angle per frame."""
    second = "mid_spine1_spine2" if len(parts) == 10 else "G_spine2"
    s1, s2 = G.xy("F_spine1"), G.xy(second)
    p = pose.withColumns({"operculum": G.operculum_angle(), "orientation": G.orientation_degrees(*G.head_vector())})
    p = series.point_speed(p, "A_head_x", "A_head_y", 10, FPS, "movement_speed")
    return series.turning_angle(p, s1[0] - s2[0], s1[1] - s2[1], 40, "turning_angle")


def feature_table(pose: DataFrame, kind: str = "full", start: int = 0, stop: int | None = None, add_midpoint: bool = True, estimate_missing: bool = True,
                  drop_outliers: bool = True, fill_missing: bool = True, **rules) -> DataFrame:
    """Clean, slice, derive, null outliers beyond three deviations and fill: one row per frame with all four groups.

    The cleaned and the derived table are written to the scratch folder, since several steps read each of them.
    """
    parts = SPINE10 if add_midpoint else SPINE8
    cleaned = clean.choose_filter(pose, kind, add_midpoint, **rules)
    rows = stored(frame_range(cleaned, start, stop).drop("_chunk"))
    other = other_features(rows, parts).select("track_id", "frame", *OTHER)
    pts = computed(rows.select("track_id", "frame", *[f"{p}_{a}" for p in parts for a in "xy"]), {"pts": clean.points(parts)})
    if estimate_missing:
        pts = computed(pts, {"filled": clean.fill_between_points("pts", 4)}).drop("pts").withColumnRenamed("filled", "pts")
    wide = pts.select("track_id", "frame", *[F.col("pts")[i][a].alias(f"{p}_{a}") for i, p in enumerate(parts) for a in "xy"])
    curves = spine.spine_curves(wide, parts)
    groups = group_columns(parts)
    curves = curves.select("track_id", "frame", *[F.col("curvature")[i].alias(c) for i, c in enumerate(groups["curvature"])],
                           *[F.col("tangent")[i].alias(c) for i, c in enumerate(groups["tangent"])])
    curves = windowed(curves, lambda w: {
        d: F.when(F.lag(F.lit(1)).over(w).isNull(), F.col(c) - F.col(c)).otherwise(F.col(c) - F.lag(c).over(w))
        for c, d in zip(groups["curvature"], groups["diff_curvature"])}, before=1).drop("_chunk")
    table = stored(other.join(curves, ["track_id", "frame"]))
    every = [c for g in groups.values() for c in g]
    if drop_outliers:
        table = clean.sigma_filter(table, every)
    if fill_missing:
        # curvature groups take the mean of the forward-filled series, the others the mean of the present values
        late = [c for g in ("curvature", "diff_curvature", "tangent") for c in groups[g]]
        table = fill.fill_mean(table, every, late)
    return table.select("track_id", "frame", *every)
