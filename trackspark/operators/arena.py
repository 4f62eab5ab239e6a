"""Arena boxes, zones and track quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rates import any_of


def zones(x: int, y: int, box: int, arm: int) -> list[tuple[str, int, int, int, int]]:
    """Named zones of a plus-shaped arena as (zone, x0, y0, x1, y1); earlier zones win shared borders."""
    # Zone names and their order.
    return [
        ("Center", x, y, x + box, y + box),
        ("Closed_left", x - arm, y, x, y + box),
        ("Closed_right", x + box, y, x + box + arm, y + box),
        ("Open_up_near", x, y - box, x + box, y),
        ("Open_up_far", x, y - arm, x + box, y - box),
        ("Open_down_near", x, y + box, x + box, y + 2 * box),
        ("Open_down_far", x, y + 2 * box, x + box, y + box + arm),
    ]


def bounds(x: int, y: int, box: int, arm: int) -> list[tuple[int, int, int, int]]:
    """The vertical and the horizontal bar of the arena."""
    return [(x, y - arm, x + box, y + box + arm), (x - arm, y, x + box + arm, y + box)]


def within(cx, cy, rect) -> Column:
    x0, y0, x1, y1 = rect
    return F.col(cx).between(x0, x1) & F.col(cy).between(y0, y1)


def in_arena(cx: str, cy: str, arena: tuple[int, int, int, int]) -> Column:
    return any_of([within(cx, cy, b) for b in bounds(*arena)])


def zone_of(cx: str, cy: str, arena: tuple[int, int, int, int]) -> Column:
    """First zone holding the point; null outside all of them."""
    out = None
    for name, *rect in zones(*arena):
        hit = within(cx, cy, rect)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def not_in_corner(cx: str, cy: str, x: float = 360, y: float = 48, right: bool = True) -> Column:
    """False for points in the top corner (time stamp right, marker left)."""
    side = F.col(cx) > x if right else F.col(cx) < x
    return ~(side & (F.col(cy) < y))


def track_blobs(frames: DataFrame, blobs: DataFrame, arena, min_area: float, keys=("track_id",)) -> DataFrame:
    """One row per frame: number of blobs, chosen blob and fault flags.

    Of several blobs the biggest one inside the arena and large enough is taken, of one blob that one.
    """
    b = blobs.withColumn("_in", in_arena("cx", "cy", arena))
    fit = F.col("_in") & (F.col("area") > min_area)
    pick = F.max_by(F.struct("blob", "area", "cx", "cy"), F.struct(F.when(fit, 1).otherwise(0), F.when(fit, F.col("area")), -F.col("blob")))
    per = b.groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("n_blobs"), pick.alias("_b"))
    j = frames.select(*keys, "frame").join(per, [*keys, "frame"], "left")
    j = j.select(*keys, "frame", F.coalesce("n_blobs", F.lit(0)).cast("long").alias("n_blobs"), "_b.*")
    one = lambda c: F.when(c, 1).otherwise(0)
    return j.withColumns({
        "no_contour": one(F.col("n_blobs") == 0), "multiple": one(F.col("n_blobs") > 1),
        "too_small": one(F.col("area") < min_area), "not_in_box": one(~F.coalesce(in_arena("cx", "cy", arena), F.lit(False))),
        "zone": zone_of("cx", "cy", arena),
    })
