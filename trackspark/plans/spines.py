"""Queries over spine curves and the position check."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geom as G
from ..operators import clean, position, spine, tail
from ..operators.chunk import computed
from ..sources import bind
from ..sources.bind import SQL_POSE
from ..sources.schema import SPINE8
from .registry import query
from .sqltext import angle


@query("native_curvature", "V5", f"WITH {SQL_POSE} SELECT track_id, frame, " + ", ".join(
    f"ABS(({b}_x-{a}_x)/2*({b}_y+{a}_y-2*{p}_y) - ({b}_y-{a}_y)/2*({b}_x+{a}_x-2*{p}_x)) / NULLIF(POWER(({b}_x-{a}_x)/2*(({b}_x-{a}_x)/2) + ({b}_y-{a}_y)/2*(({b}_y-{a}_y)/2), 1.5), 0) AS k{i}"
    for i, (a, p, b) in enumerate(zip(SPINE8, SPINE8[1:], SPINE8[2:]), 1)) + " FROM pose", " ".join(f"k{i}" for i in range(1, 7)))
def _(spark, sf):
    p = bind.pose(spark, sf, SPINE8).withColumn("k", spine.native_curvature(SPINE8))
    return p.select("track_id", "frame", *[F.col("k")[i].alias(f"k{i}") for i in range(1, 7)])


@query("native_bend", "V6 F16", f"WITH {SQL_POSE} SELECT track_id, frame, {angle('F_spine1_x-A_head_x', 'F_spine1_y-A_head_y', 'L_spine7_x-K_spine6_x', 'L_spine7_y-K_spine6_y')} AS bend FROM pose", "bend")
def _(spark, sf):
    return bind.pose(spark, sf, ["A_head", "F_spine1", "K_spine6", "L_spine7"]).select("track_id", "frame", spine.native_bend(SPINE8).alias("bend"))


def _holed(spark, sf):
    p = bind.pose(spark, sf, SPINE8)
    return p.withColumns({f"{q}_{a}": clean.null_if(F.col(f"{q}_l") < 0.6, f"{q}_{a}") for q in SPINE8 for a in "xy"})


@query("spine_curvature", "V1 V2 V6 X3")
def _(spark, sf):
    c = spine.spine_curves(_holed(spark, sf), SPINE8)
    return c.select("track_id", "frame", "curvature", "tangent", "slope", spine.max_curvature().alias("max_curvature"), spine.spline_bend().alias("bend"))


@query("tail_slopes", "V3 F18 C16")
def _(spark, sf):
    p = bind.pose(spark, sf, SPINE8)
    rotated = [F.struct(*[c.alias(a) for c, a in zip(G.body_frame(*G.xy(q), G.xy("A_head"), G.xy("F_spine1")), "xy")]) for q in SPINE8]
    d = computed(p, {"rotated": F.array(*rotated)}).select("track_id", "frame", "rotated")
    d = computed(d, {"pts": clean.radius_gate("rotated", 100.0, 60.0, 50.0)}).where("pts is not null").drop("rotated")
    wide = d.select("track_id", "frame", "pts", *[F.col("pts")[i][a].alias(f"{q}_{a}") for i, q in enumerate(SPINE8) for a in "xy"])
    c = spine.spine_curves(wide, SPINE8).join(wide.select("track_id", "frame", "pts"), ["track_id", "frame"])
    return c.select("track_id", "frame", spine.tail_slopes(c).alias("slope"), spine.pack("slope").alias("packed"))


# The closed curve's second derivatives m by 60 Jacobi steps; the system is dominated by its diagonal, a step halves the error.
_RING = range(7)
_D = {f"{a}{i}": f"({a}{(i + 1) % 7}-{a}{i})/h{i}" for a in "xy" for i in _RING}
SQL_CLOSED = f"""WITH RECURSIVE {SQL_POSE}, rot AS (SELECT track_id, frame, {", ".join(
    f"((A_head_x-F_spine1_x)*({p}_x-F_spine1_x)+(A_head_y-F_spine1_y)*({p}_y-F_spine1_y))/n AS x{i}, ((A_head_x-F_spine1_x)*({p}_y-F_spine1_y)-(A_head_y-F_spine1_y)*({p}_x-F_spine1_x))/n AS y{i}"
    for i, p in enumerate(SPINE8[:-1]))} FROM (SELECT *, SQRT((A_head_x-F_spine1_x)*(A_head_x-F_spine1_x)+(A_head_y-F_spine1_y)*(A_head_y-F_spine1_y)) AS n FROM pose) q),
    st AS (SELECT *, {", ".join(f"SQRT((x{(i + 1) % 7}-x{i})*(x{(i + 1) % 7}-x{i})+(y{(i + 1) % 7}-y{i})*(y{(i + 1) % 7}-y{i})) AS l{i}" for i in _RING)} FROM rot),
    hs AS (SELECT * EXCLUDE ({", ".join(f"l{i}" for i in _RING)}), {", ".join(f"l{i}/({'+'.join(f'l{j}' for j in _RING)}) AS h{i}" for i in _RING)} FROM st),
    jac AS (SELECT 0 AS step, *, {", ".join(f"CAST(0 AS DOUBLE) AS m{a}{i}" for a in "xy" for i in _RING)} FROM hs
      UNION ALL SELECT step + 1, track_id, frame, {", ".join(f"x{i}, y{i}" for i in _RING)}, {", ".join(f"h{i}" for i in _RING)},
        {", ".join(f"(6*({_D[f'{a}{i}']}-{_D[f'{a}{(i - 1) % 7}']})-h{(i - 1) % 7}*m{a}{(i - 1) % 7}-h{i}*m{a}{(i + 1) % 7})/(2*(h{(i - 1) % 7}+h{i}))" for a in "xy" for i in _RING)} FROM jac WHERE step < 60),
    tan AS (SELECT track_id, frame, {", ".join(f"{_D[f'{a}{i}']}-h{i}*(2*m{a}{i}+m{a}{(i + 1) % 7})/6 AS d{a}{i}" for a in "xy" for i in _RING)} FROM jac WHERE step = 60)
    SELECT track_id, frame, {", ".join(f"dx{i % 7}/SQRT(dx{i % 7}*dx{i % 7}+dy{i % 7}*dy{i % 7}) AS c{i}, dx{i % 7}/dy{i % 7} AS s{i}" for i in range(8))} FROM tan"""


def _rotated(spark, sf):
    p = bind.pose(spark, sf, SPINE8)
    return p.select("track_id", "frame", *[c.alias(f"{q}_{a}") for q in SPINE8 for c, a in zip(G.body_frame(*G.xy(q), G.xy("A_head"), G.xy("F_spine1")), "xy")])


@query("tail_slopes_closed", "V3", SQL_CLOSED, " ".join(f"c{i} s{i}:4" for i in range(8)))
def _(spark, sf):
    d = tail.tail_profile(_rotated(spark, sf), SPINE8, closed=True)
    cos = [F.col("dx")[i] / F.sqrt(F.col("dx")[i] * F.col("dx")[i] + F.col("dy")[i] * F.col("dy")[i]) for i in range(8)]
    return d.select("track_id", "frame", *[cos[i].alias(f"c{i}") for i in range(8)], *[F.col("inverse")[i].alias(f"s{i}") for i in range(8)])


@query("tail_crossings", "V3")
def _(spark, sf):
    d = tail.tail_profile(_rotated(spark, sf), SPINE8, levels=(-200.0, -100.0, -50.0, 0.0, 50.0, 100.0))
    return d.select("track_id", "frame", "at", "y", "slope_at", "inverse_at", "inverse")


@query("spine_path", "V4")
def _(spark, sf):
    return spine.spine_curves(_holed(spark, sf), SPINE8, samples=100).where("path is not null").select("track_id", "frame", "path")


SQL_CHECKED = f"""WITH RECURSIVE {SQL_POSE}, p AS MATERIALIZED (SELECT track_id, frame, A_head_x AS x, A_head_y AS y FROM pose),
    w AS ( SELECT track_id, frame, x, y, x IS NOT NULL AND y IS NOT NULL AS ok, x AS lx, y AS ly, CASE WHEN x IS NULL OR y IS NULL THEN 1 ELSE 0 END AS rejects FROM p WHERE frame = 0
      UNION ALL SELECT n.track_id, n.frame, n.x, n.y, n.ok, CASE WHEN n.ok THEN n.x ELSE n.lx END, CASE WHEN n.ok THEN n.y ELSE n.ly END, CASE WHEN n.ok THEN 0 ELSE n.rejects + 1 END
        FROM (SELECT p.track_id, p.frame, p.x, p.y, w.lx, w.ly, w.rejects, p.x IS NOT NULL AND p.y IS NOT NULL
            AND (w.lx IS NULL OR w.rejects > 7 OR SQRT((p.x-w.lx)*(p.x-w.lx) + (p.y-w.ly)*(p.y-w.ly)) <= 150) AS ok FROM w JOIN p ON p.track_id = w.track_id AND p.frame = w.frame + 1) n)
    SELECT track_id, frame, CASE WHEN ok THEN x END AS x, CASE WHEN ok THEN y END AS y FROM w"""


@query("position_check", "C12", SQL_CHECKED)
def _(spark, sf):
    p = bind.pose(spark, sf, ["A_head"]).select("track_id", "frame", F.col("A_head_x").alias("x"), F.col("A_head_y").alias("y"))
    return position.position_check(p, "x", "y", 150, 7).select("track_id", "frame", "x", "y")
