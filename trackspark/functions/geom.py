"""Plane geometry as column expressions. Angles are degrees; undefined results are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xy(part: str) -> tuple[Column, Column]:
    return F.col(f"{part}_x"), F.col(f"{part}_y")


def distance(a, b) -> Column:
    dx, dy = a[0] - b[0], a[1] - b[1]
    return F.sqrt(dx * dx + dy * dy)


def acos_degrees(c: Column) -> Column:
    return F.when(F.abs(c) <= 1, F.degrees(F.acos(c)))


def side_angle(a: Column, b: Column, opposite: Column) -> Column:
    """Angle between sides a and b of a triangle."""
    return acos_degrees(F.try_divide(a * a + b * b - opposite * opposite, a * b * 2))


def midpoint(a, b) -> tuple[Column, Column]:
    return (a[0] + b[0]) / 2, (a[1] + b[1]) / 2


def vector_cosine(ax, ay, bx, by) -> Column:
    return F.try_divide(ax * bx + ay * by, F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by)))


def vector_angle(ax, ay, bx, by) -> Column:
    return acos_degrees(vector_cosine(ax, ay, bx, by))


def gill_midpoint() -> tuple[Column, Column]:
    return midpoint(xy("B_rightoperculum"), xy("E_leftoperculum"))


def head_vector() -> tuple[Column, Column]:
    """Head relative to the midpoint of the opercula."""
    mx, my = gill_midpoint()
    hx, hy = xy("A_head")
    return hx - mx, hy - my


def operculum_angle() -> Column:
    h, r, l = xy("A_head"), xy("B_rightoperculum"), xy("E_leftoperculum")
    return side_angle(distance(h, r), distance(h, l), distance(r, l))


def triangle_ratio() -> Column:
    """Head angle / left angle / right angle of the head-operculum triangle."""
    h, r, l = xy("A_head"), xy("B_rightoperculum"), xy("E_leftoperculum")
    hr, hl, rl = distance(h, r), distance(h, l), distance(r, l)
    return F.try_divide(F.try_divide(side_angle(hr, hl, rl), side_angle(hr, rl, hl)), side_angle(hl, rl, hr))


def orientation_east(vx: Column, vy: Column) -> Column:
    """0..180 against +x, by the triangle (vector, unit x)."""
    length = F.sqrt(vx * vx + vy * vy)
    chord = F.sqrt((vx - 1) * (vx - 1) + vy * vy)
    return side_angle(length, F.lit(1.0), chord)


def orientation_cosine(vx: Column, vy: Column, hx: Column) -> Column:
    """dx / length, undefined where the head's x is 0."""
    return F.try_divide(vx * hx, F.sqrt(vx * vx + vy * vy) * hx)


def orientation_degrees(vx: Column, vy: Column) -> Column:
    return acos_degrees(F.try_divide(vx, F.sqrt(vx * vx + vy * vy)))


def orientation_folded(vx: Column, vy: Column) -> Column:
    """As orientation_degrees, but vectors not pointing up get 180 added and folded back."""
    a = orientation_degrees(vx, vy)
    b = F.when(vy > 0, a).otherwise(a + 180)
    return F.least(b, 360 - b)


def gaze_angle(head, gill_mid, other_head) -> Column:
    """Angle at the head between own gill midpoint and the other head; 180 looks straight at it."""
    return side_angle(distance(gill_mid, head), distance(head, other_head), distance(other_head, gill_mid))


def wag_cosine() -> Column:
    """Cosine at the gill midpoint between head and tail base."""
    mx, my = gill_midpoint()
    hx, hy = head_vector()
    tx, ty = xy("C_tailbase")
    return vector_cosine(hx, hy, tx - mx, ty - my)


def body_frame(px: Column, py: Column, head, origin) -> tuple[Column, Column]:
    """Point in the frame with its origin at spine1 and +x towards the head."""
    ux, uy = head[0] - origin[0], head[1] - origin[1]
    n = F.sqrt(ux * ux + uy * uy)
    dx, dy = px - origin[0], py - origin[1]
    return F.try_divide(ux * dx + uy * dy, n), F.try_divide(ux * dy - uy * dx, n)


def line_distance(h1, h2, p) -> Column:
    """Distance of p to the line through h1 and h2."""
    k = F.try_divide(h1[1] - h2[1], h1[0] - h2[0])
    b = h2[1] - k * h2[0]
    return (F.when(h1[0] == h2[0], F.abs(p[0] - h1[0])).when(h1[1] == h2[1], F.abs(p[1] - h1[1]))
            .otherwise(F.abs(k * p[0] - p[1] + b) / F.sqrt(k * k + 1)))


STEEP = 10000.0  # fixed value: slope that stands for a vertical line


def line_foot(h1, h2, p) -> tuple[Column, Column]:
    """Foot of the perpendicular from p on the line through h1 and h2."""
    k1 = F.when(h1[0] == h2[0], F.lit(STEEP)).when(h1[1] == h2[1], F.lit(0.0)).otherwise(
        F.try_divide(h1[1] - h2[1], h1[0] - h2[0]))
    b1 = F.when(h1[0] == h2[0], -STEEP * h1[0]).when(h1[1] == h2[1], h1[1]).otherwise(h2[1] - k1 * h2[0])
    flat = k1 == 0
    k2 = F.when(flat, F.lit(STEEP)).otherwise(F.try_divide(F.lit(-1.0), k1))
    b2 = F.when(flat, -STEEP * p[0]).otherwise(p[1] - p[0] * k2)
    x = F.try_divide(b2 - b1, k1 - k2)
    return x, k1 * x + b1
