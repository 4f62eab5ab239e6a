"""Two subjects in one trial."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geom import vector_angle
from ..sources.schema import FPS
from .chunk import windowed

ARENA_WIDTH = 500  # fixed value: offset of the right subject's x


def offset_side(df: DataFrame, cols: list[str], right, width: float = ARENA_WIDTH) -> DataFrame:
    """Shift the right subject's x columns into the common frame."""
    return df.withColumns({c: F.when(right, F.col(c) + width).otherwise(F.col(c)) for c in cols})


def mirror_side(df: DataFrame, x: str, orientation: str, flipped, width: float = ARENA_WIDTH) -> DataFrame:
    """x -> width - x and orientation -> 180 - orientation on the flipped side."""
    return df.withColumns({x: F.when(flipped, width - F.col(x)).otherwise(F.col(x)),
                           orientation: F.when(flipped, 180 - F.col(orientation)).otherwise(F.col(orientation))})


def pair_frames(df: DataFrame, cols: list[str], keys=("frame",)) -> DataFrame:
    """Left (even track) and right (odd track) subject side by side: trial, frame, L_*, R_*."""
    trial = F.expr("track_id div 2").alias("trial")

    def side(odd, prefix):
        return df.where(F.expr(f"track_id % 2 = {odd}")).select(trial, *keys, *[F.col(c).alias(f"{prefix}_{c}") for c in cols])
    return side(0, "L").join(side(1, "R"), ["trial", *keys])


def swap_labels(df: DataFrame, label: str, out: str = "opponent") -> DataFrame:
    """Each track with the label of the other track of its trial."""
    other = df.select(F.expr("track_id + 1 - 2 * (track_id % 2)").alias("track_id"), "frame", F.col(label).alias(out))
    return df.join(other, ["track_id", "frame"])


def projected_speed(df: DataFrame, x: str, y: str, bx: str, by: str, along: str, across: str, frames: int = 10, keys=("trial",), fps: int = FPS) -> DataFrame:
    """Displacement over ``frames`` split along and across a base vector, per second."""
    def move(w):
        return {"_dx": F.lag(x, frames).over(w) - F.col(x), "_dy": F.lag(y, frames).over(w) - F.col(y)}

    def split(_w):
        total = F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")
        part = F.try_divide(F.abs(F.col("_dx") * F.col(bx) + F.col("_dy") * F.col(by)),
                            F.sqrt(F.col(bx) * F.col(bx) + F.col(by) * F.col(by)))
        rest = total - part * part
        # rounding can leave a tiny negative rest for motion along the base
        return {along: part / F.lit(frames / fps), across: F.sqrt(F.greatest(rest, F.lit(0.0))) / F.lit(frames / fps)}
    return windowed(df, move, split, before=frames, keys=keys).drop("_dx", "_dy")


def pair_features(heads: DataFrame) -> DataFrame:
    """Distances, angles and projected speeds of two subjects from hx, hy (head) and cx, cy (centre) per track and frame.

    ``*_lateral_speed`` holds the component along the other subject's heading, ``*_forward_speed`` the one across it.
    """
    p = pair_frames(heads, ["hx", "hy", "cx", "cy"])
    c = F.col
    p = p.withColumns({f"{s}_vx": c(f"{s}_hx") - c(f"{s}_cx") for s in "LR"} | {f"{s}_vy": c(f"{s}_hy") - c(f"{s}_cy") for s in "LR"})
    dcx, dcy, dhx, dhy = (c(f"L_{k}") - c(f"R_{k}") for k in ("cx", "cy", "hx", "hy"))
    p = p.withColumns({
        "center_distance": F.sqrt(dcx * dcx + dcy * dcy), "head_distance": F.sqrt(dhx * dhx + dhy * dhy),
        "LR_Angle": vector_angle(c("L_vx"), c("L_vy"), dcx, dcy), "RL_Angle": vector_angle(c("R_vx"), c("R_vy"), dcx, dcy),
        "head_dir_angle": vector_angle(c("L_vx"), c("L_vy"), c("R_vx"), c("R_vy")),
    })
    p = projected_speed(p, "L_hx", "L_hy", "R_vx", "R_vy", "L_lateral_speed", "L_forward_speed")
    p = projected_speed(p, "R_hx", "R_hy", "L_vx", "L_vy", "R_lateral_speed", "R_forward_speed")
    return p.select("trial", "frame", "center_distance", "head_distance", "LR_Angle", "RL_Angle", "head_dir_angle",
                    "L_lateral_speed", "L_forward_speed", "R_lateral_speed", "R_forward_speed")


def part_distances(df: DataFrame, parts: list[str], keys=("track_id", "frame")) -> DataFrame:
    """part_a, part_b, distance for every ordered pair of the listed parts of a frame."""
    from ..functions.geom import distance, xy

    rows = F.array(*[F.struct(F.lit(a).alias("part_a"), F.lit(b).alias("part_b"), distance(xy(a), xy(b)).alias("distance"))
                     for a in parts for b in parts if a != b])
    return df.select(*keys, F.inline(rows))
