"""Small builders for the check SQL."""

from __future__ import annotations


def over(rows: str = "", by: str = "track_id") -> str:
    return f"OVER (PARTITION BY {by} ORDER BY frame{' ROWS BETWEEN ' + rows if rows else ''})"


def div(a, b):
    return f"(({a}) / NULLIF({b}, 0))"


def dist(a, b):
    return f"SQRT(({a}_x-{b}_x)*({a}_x-{b}_x)+({a}_y-{b}_y)*({a}_y-{b}_y))"


def acosd(c):
    return f"(CASE WHEN ABS({c}) <= 1 THEN DEGREES(ACOS(LEAST(1, GREATEST(-1, {c})))) END)"


def side(a, b, c):
    return acosd(div(f"{a}*{a}+{b}*{b}-{c}*{c}", f"{a}*{b}*2"))


def cosv(ax, ay, bx, by):
    return div(f"({ax})*({bx})+({ay})*({by})", f"SQRT((({ax})*({ax})+({ay})*({ay}))*(({bx})*({bx})+({by})*({by})))")


def angle(ax, ay, bx, by):
    return acosd(cosv(ax, ay, bx, by))


H, R, L = "A_head", "B_rightoperculum", "E_leftoperculum"
MX, MY = f"(({R}_x+{L}_x)/2)", f"(({R}_y+{L}_y)/2)"
VX, VY = f"({H}_x-{MX})", f"({H}_y-{MY})"
