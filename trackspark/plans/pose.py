"""Queries over wide pose tables: geometry, cleaning rules, pairs of subjects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geom as G
from ..operators import clean, sweeps, pairs, rates, series
from ..operators.chunk import computed, windowed
from ..sources import bind
from ..sources.bind import SQL_POSE, SQL_RINGS
from ..sources.schema import PARTS, SPINE8, SPINE10
from .registry import query
from .sqltext import H, L, MX, MY, R, VX, VY, acosd, angle, cosv, dist, div, over, side

HEAD = ["A_head", "B_rightoperculum", "E_leftoperculum"]
SQL_OPER = f"SELECT track_id, frame, {dist(H, R)} AS hr, {dist(H, L)} AS hl, {dist(R, L)} AS rl FROM pose"


# --- geometry -------------------------------------------------------------------------------------------------------
@query("operculum_angle", "F1 F2 F3 F7 X2", f"WITH {SQL_POSE}, d AS ({SQL_OPER}) SELECT track_id, frame, {side('hr', 'hl', 'rl')} AS angle FROM d", "angle")
def _(spark, sf):
    return bind.pose(spark, sf, HEAD).select("track_id", "frame", G.operculum_angle().alias("angle"))


@query("triangle_ratio", "F8", f"""WITH {SQL_POSE}, d AS ({SQL_OPER}), a AS (SELECT track_id, frame, {side('hr', 'hl', 'rl')} AS h, {side('hr', 'rl', 'hl')} AS l, {side('hl', 'rl', 'hr')} AS r FROM d)
    SELECT track_id, frame, {div(div('h', 'l'), 'r')} AS ratio FROM a""", "ratio")
def _(spark, sf):
    return bind.pose(spark, sf, HEAD).select("track_id", "frame", G.triangle_ratio().alias("ratio"))


SQL_HEADV = f"{SQL_POSE}, hv AS (SELECT track_id, frame, A_head_x AS hx, {VX} AS vx, {VY} AS vy FROM pose)"
SQL_ORI = acosd(div("vx", "SQRT(vx*vx+vy*vy)"))


@query("orientation_variants", "F9 F10 F11 F13 D3", f"""WITH {SQL_HEADV} SELECT track_id, frame, vx, vy,
    {side('SQRT(vx*vx+vy*vy)', 'CAST(1 AS DOUBLE)', 'SQRT((vx-1)*(vx-1)+vy*vy)')} AS east, {div('vx*hx', 'SQRT(vx*vx+vy*vy)*hx')} AS cosine, {SQL_ORI} AS degrees
    FROM hv""", "vx vy east:5 cosine degrees")
def _(spark, sf):
    vx, vy = G.head_vector()
    p = bind.pose(spark, sf, HEAD).withColumns({"vx": vx, "vy": vy})
    vx, vy = F.col("vx"), F.col("vy")
    return p.select("track_id", "frame", "vx", "vy", G.orientation_east(vx, vy).alias("east"),
                    G.orientation_cosine(vx, vy, F.col("A_head_x")).alias("cosine"), G.orientation_degrees(vx, vy).alias("degrees"))


@query("orientation_fold", "F12", f"""WITH {SQL_HEADV}, a AS (SELECT track_id, frame, CASE WHEN vy > 0 THEN {SQL_ORI} ELSE {SQL_ORI} + 180 END AS a FROM hv)
    SELECT track_id, frame, LEAST(a, 360 - a) AS folded FROM a""", "folded")
def _(spark, sf):
    return bind.pose(spark, sf, HEAD).select("track_id", "frame", G.orientation_folded(*G.head_vector()).alias("folded"))


@query("tail_wag", "F15 F16 F17 W7", f"""WITH {SQL_POSE}, c AS (SELECT track_id, frame, {cosv(VX, VY, f'C_tailbase_x-{MX}', f'C_tailbase_y-{MY}')} AS wag,
    {angle(VX, VY, 'C_tailbase_x-D_tailtip_x', 'C_tailbase_y-D_tailtip_y')} AS tail_angle FROM pose)
    SELECT track_id, frame, wag, tail_angle, ABS(LEAD(wag) {over()} - wag) / 0.025 AS wag_speed FROM c""", "wag tail_angle wag_speed")
def _(spark, sf):
    t = G.xy("C_tailbase"), G.xy("D_tailtip")
    p = bind.pose(spark, sf, [*HEAD, "C_tailbase", "D_tailtip"]).select(
        "track_id", "frame", G.wag_cosine().alias("wag"),
        G.vector_angle(*G.head_vector(), t[0][0] - t[1][0], t[0][1] - t[1][1]).alias("tail_angle"))
    return series.opening_speed(p, "wag", out="wag_speed").select("track_id", "frame", "wag", "tail_angle", "wag_speed")


@query("mid_spine", "F4 F5 F6 D3", f"""WITH {SQL_POSE} SELECT track_id, frame, (F_spine1_x+G_spine2_x)/2 AS m12x, (F_spine1_y+G_spine2_y)/2 AS m12y,
    LEAST(F_spine1_l, G_spine2_l) AS m12l, (G_spine2_x+H_spine3_x)/2 AS m23x, (G_spine2_y+H_spine3_y)/2 AS m23y, LEAST(G_spine2_l, H_spine3_l) AS m23l FROM pose""",
       "m12x m12y m12l m23x m23y m23l")
def _(spark, sf):
    p = clean.add_mid_spine(bind.pose(spark, sf, ["F_spine1", "G_spine2", "H_spine3"]))
    return p.select("track_id", "frame", *[F.col(f"mid_spine{a}_spine{b}_{c}").alias(f"m{a}{b}{c}") for a, b in ((1, 2), (2, 3)) for c in "xyl"])


_UX, _UY = "(A_head_x-F_spine1_x)", "(A_head_y-F_spine1_y)"
_UN = f"SQRT({_UX}*{_UX}+{_UY}*{_UY})"


@query("rotate_pose", "F18 D4", f"""WITH {SQL_POSE} SELECT track_id, frame, {', '.join(
    f"{div(f'{_UX}*({p}_x-F_spine1_x)+{_UY}*({p}_y-F_spine1_y)', _UN)} AS x{i}, {div(f'{_UX}*({p}_y-F_spine1_y)-{_UY}*({p}_x-F_spine1_x)', _UN)} AS y{i}" for i, p in enumerate(SPINE8))}
    FROM pose""", " ".join(f"x{i} y{i}" for i in range(8)))
def _(spark, sf):
    cols = []
    for i, p in enumerate(SPINE8):
        x, y = G.body_frame(*G.xy(p), G.xy("A_head"), G.xy("F_spine1"))
        cols += [x.alias(f"x{i}"), y.alias(f"y{i}")]
    return bind.pose(spark, sf, SPINE8).select("track_id", "frame", *cols)


@query("turning_angles", "W17 W18", f"""WITH {SQL_POSE}, v AS (SELECT track_id, frame, {VX} AS hx, {VY} AS hy, F_spine1_x-G_spine2_x AS sx, F_spine1_y-G_spine2_y AS sy FROM pose),
    l AS (SELECT *, LAG(sx, 40) {over()} AS px, LAG(sy, 40) {over()} AS py, LEAD(hx, 40) {over()} AS qx, LEAD(hy, 40) {over()} AS qy FROM v)
    SELECT track_id, frame, {angle('sx', 'sy', 'px', 'py')} AS lookback, {angle('hx', 'hy', 'qx', 'qy')} AS lookahead FROM l""", "lookback lookahead")
def _(spark, sf):
    p = bind.pose(spark, sf, [*HEAD, "F_spine1", "G_spine2"])
    s1, s2 = G.xy("F_spine1"), G.xy("G_spine2")
    p = p.select("track_id", "frame", (s1[0] - s2[0]).alias("sx"), (s1[1] - s2[1]).alias("sy"), *[c.alias(n) for c, n in zip(G.head_vector(), ("hx", "hy"))])
    back = series.turning_angle(p, F.col("sx"), F.col("sy"), 40, "lookback")
    return series.turning_angle(back, F.col("hx"), F.col("hy"), -40, "lookahead").select("track_id", "frame", "lookback", "lookahead")


def _speed_sql(k):
    dx, dy = (f"(LAG(A_head_{c}, {k}) {over()} - A_head_{c})" for c in "xy")
    return f"WITH {SQL_POSE}, s AS (SELECT track_id, frame, SQRT({dx}*{dx}+{dy}*{dy}) / ({k} / 40.0) AS speed FROM pose)"


@query("speed_lag1", "W4", _speed_sql(1) + " SELECT * FROM s", "speed")
def _(spark, sf):
    return series.point_speed(bind.pose(spark, sf, ["A_head"]), "A_head_x", "A_head_y", 1).select("track_id", "frame", "speed")


@query("speed_lag10", "W5", _speed_sql(10) + " SELECT * FROM s", "speed")
def _(spark, sf):
    return series.point_speed(bind.pose(spark, sf, ["A_head"]), "A_head_x", "A_head_y", 10).select("track_id", "frame", "speed")


@query("mean_speed", "A2", _speed_sql(1) + " SELECT track_id, AVG(speed) AS speed FROM s GROUP BY 1", "speed")
def _(spark, sf):
    return series.point_speed(bind.pose(spark, sf, ["A_head"]), "A_head_x", "A_head_y", 1).groupBy("track_id").agg(F.avg("speed").alias("speed"))


@query("r_squared", "F19", f"WITH {SQL_POSE} SELECT track_id, POWER(CORR(A_head_x, F_spine1_x), 2) AS r2 FROM pose GROUP BY 1", "r2")
def _(spark, sf):
    return bind.pose(spark, sf, ["A_head", "F_spine1"]).groupBy("track_id").agg(F.pow(F.corr("A_head_x", "F_spine1_x"), 2).alias("r2"))


@query("midline_foot", "F23 F24", f"""WITH {SQL_POSE}, k AS (SELECT *, (A_head_y-F_spine1_y) / NULLIF(A_head_x-F_spine1_x, 0) AS k1 FROM pose),
    b AS (SELECT *, F_spine1_y - k1*F_spine1_x AS b1, -1/NULLIF(k1, 0) AS k2 FROM k), x AS (SELECT *, ((D_tailtip_y - D_tailtip_x*k2) - b1) / (k1-k2) AS fx FROM b)
    SELECT track_id, frame, ABS(k1*D_tailtip_x - D_tailtip_y + b1) / SQRT(k1*k1+1) AS dev, fx, k1*fx+b1 AS fy FROM x""", "dev:5 fx:5 fy:5")
def _(spark, sf):
    h1, h2, t = G.xy("A_head"), G.xy("F_spine1"), G.xy("D_tailtip")
    fx, fy = G.line_foot(h1, h2, t)
    return bind.pose(spark, sf, ["A_head", "F_spine1", "D_tailtip"]).select(
        "track_id", "frame", G.line_distance(h1, h2, t).alias("dev"), fx.alias("fx"), fy.alias("fy"))


# --- shapes of the table ----------------------------------------------------------------------------------------------
@query("pose_long", "S3 D1 D2", f"WITH {SQL_POSE} " + " UNION ALL ".join(
    f"SELECT track_id, frame, '{p}' AS part, {p}_x AS x, {p}_y AS y, {p}_l AS likelihood FROM pose" for p in PARTS), "x y likelihood")
def _(spark, sf):
    from ..sources.tables import to_long

    return to_long(bind.pose(spark, sf), PARTS)


@query("pose_wide", "S3", f"WITH {SQL_POSE} SELECT track_id, frame, A_head_x, A_head_y, L_spine7_x, L_spine7_y, right_eye_l FROM pose", "A_head_x A_head_y L_spine7_x L_spine7_y right_eye_l")
def _(spark, sf):
    from ..sources.tables import to_long, to_wide

    return to_wide(to_long(bind.pose(spark, sf), PARTS), PARTS).select("track_id", "frame", "A_head_x", "A_head_y", "L_spine7_x", "L_spine7_y", "right_eye_l")


# --- cleaning rules ----------------------------------------------------------------------------------------------------
def _clean_cols(parts):
    return [f"{p}_{c}" for p in parts for c in "xy"]


def _whole_row(cols, cond):
    return ", ".join(f"CASE WHEN {cond} THEN NULL ELSE {c} END AS {c}" for c in cols)


def _replace(cols: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in cols.items())


def _c1_sql(jump, origin):
    cols = _clean_cols(clean.CORE_PARTS)
    ctes, prev = [SQL_POSE], "pose"
    for i, c in enumerate(cols):
        ctes.append(f"j{i} AS (SELECT * REPLACE (CASE WHEN ABS({c} - LAG({c}) {over()}) > {jump} THEN NULL ELSE {c} END AS {c}) FROM {prev})")
        ctes.append(f"o{i} AS (SELECT track_id, frame, {_whole_row(cols, f'{c} < {origin}')} FROM j{i})")
        prev = f"o{i}"
    return f"WITH {', '.join(ctes)} SELECT track_id, frame, {', '.join(cols)} FROM {prev}"


@query("jump_origin_filter", "C1", _c1_sql(200, 60), " ".join(_clean_cols(clean.CORE_PARTS)))
def _(spark, sf):
    return clean.jump_origin_filter(bind.pose(spark, sf, clean.CORE_PARTS), 200, 60).select("track_id", "frame", *_clean_cols(clean.CORE_PARTS))


def _c2_sql(jump, body, origin, head, tail):
    cols = _clean_cols(clean.CORE_PARTS)
    h, r, le, t = "A_head", "B_rightoperculum", "E_leftoperculum", "D_tailtip"
    big = f"{dist(h, t)} > {body} OR {dist(le, r)} > {head} OR {dist(h, r)} > {head} OR {dist(h, le)} > {head} OR {dist(t, le)} > {tail} OR {dist(t, r)} > {tail}"
    ctes, prev = [SQL_POSE], "pose"
    for i, c in enumerate(cols):
        ctes.append(f"j{i} AS (SELECT track_id, frame, {', '.join(cols)}, ABS({c} - LAG({c}) {over()}) > {jump} AS jumped FROM {prev})")
        ctes.append(f"o{i} AS (SELECT track_id, frame, {_whole_row(cols, f'jumped OR {c} < {origin} OR {big}')} FROM j{i})")
        prev = f"o{i}"
    return f"WITH {', '.join(ctes)} SELECT track_id, frame, {', '.join(cols)} FROM {prev}"


@query("skeleton_filter", "C2", _c2_sql(300, 300, 40, 250, 300), " ".join(_clean_cols(clean.CORE_PARTS)))
def _(spark, sf):
    return clean.skeleton_filter(bind.pose(spark, sf, clean.CORE_PARTS), 300, 300, 40, 250, 300).select("track_id", "frame", *_clean_cols(clean.CORE_PARTS))


_RULES = (300.0, 300.0, 40.0, 250.0, 300.0)
_SWEEP = {"p0": [20.0, 45.0], "p1": [90.0, 150.0]}


def _trace_sql(width: bool) -> str:
    """The cleaned head angle scored by every band, with a width rule on top or without."""
    grid = "g0 AS (SELECT UNNEST([20.0::DOUBLE, 45.0]) AS p0), g1 AS (SELECT UNNEST([90.0::DOUBLE, 150.0]) AS p1)"
    hr, hl, rl = dist(H, R), dist(H, L), dist(R, L)
    ang = f"an AS (SELECT track_id, frame, {side('hr', 'hl', 'rl')} AS angle, CASE WHEN frame % 7 < 3 THEN 1 ELSE 0 END AS manual, LEAD(1) {over()} IS NULL AS last FROM (SELECT track_id, frame, {hr} AS hr, {hl} AS hl, {rl} AS rl FROM cleaned) d)"
    band = "bn AS (SELECT p0, p1, track_id, frame, manual, last, CASE WHEN angle > p0 AND angle < p1 THEN 1 ELSE 0 END AS b FROM an, g0, g1)"
    rule = """n AS (SELECT *, CASE WHEN b = LAG(b) OVER (PARTITION BY p0, p1, track_id ORDER BY frame) THEN 0 ELSE 1 END AS new FROM bn),
    g AS (SELECT *, SUM(new) OVER (PARTITION BY p0, p1, track_id ORDER BY frame) AS g FROM n),
    e AS (SELECT *, MIN(frame) OVER (PARTITION BY p0, p1, track_id, g) AS start, MAX(frame) OVER (PARTITION BY p0, p1, track_id, g) AS stop FROM g),
    sc AS (SELECT p0, p1, manual, last, CASE WHEN b = 1 AND stop > start + 10 AND stop - start > 1 AND frame < stop THEN 1 ELSE 0 END AS auto FROM e)""" if width else "sc AS (SELECT p0, p1, manual, last, b AS auto FROM bn)"
    base = _c2_sql(*_RULES)
    at = base.rindex(" SELECT track_id, frame,")
    return f"""{base[:at]}, cleaned AS ({base[at + 1:]}), {ang}, {grid}, {band}, {rule}
    SELECT p0, p1, CAST(SUM(CASE WHEN NOT last THEN auto*manual ELSE 0 END) AS BIGINT) AS tp, CAST(SUM(auto) - SUM(CASE WHEN NOT last THEN auto*manual ELSE 0 END) AS BIGINT) AS fp, COUNT(*) AS rows FROM sc GROUP BY 1, 2"""


def _trace_sweep(spark, sf, width):
    p = bind.pose(spark, sf, clean.CORE_PARTS).withColumn("manual", F.when(F.col("frame") % 7 < 3, 1).otherwise(0))
    p = windowed(p, lambda w: {"last": F.lead(F.lit(1)).over(w).isNull()}, after=1).drop("_chunk")
    first = 3 if width else 2
    lists = {**_SWEEP, **({"p2": [1.0]} if width else {}), **{f"p{first + i}": [v] for i, v in enumerate(_RULES)}}
    out = sweeps.trace_sweep(p, lists, G.operculum_angle(), "manual", "last", width)
    return out.select("p0", "p1", "tp", "fp", (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("rows"))


@query("trace_sweep", "E2 C2", _trace_sql(False))
def _(spark, sf):
    return _trace_sweep(spark, sf, False)


@query("trace_width_sweep", "E2 C2 W23", _trace_sql(True))
def _(spark, sf):
    return _trace_sweep(spark, sf, True)


@query("drop_then_fill", "P11 W8", f"""WITH {SQL_POSE}, k AS (SELECT track_id, frame, CASE WHEN F_spine1_x > 180 THEN F_spine1_x END AS s, CASE WHEN A_head_x > 230 THEN A_head_x END AS h FROM pose)
    SELECT track_id, frame, s, LAST_VALUE(h IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame) AS h FROM k WHERE s IS NOT NULL""", "s h")
def _(spark, sf):
    from ..operators import fill

    p = bind.pose(spark, sf, ["A_head", "F_spine1"])
    k = p.select("track_id", "frame", F.when(F.col("F_spine1_x") > 180, F.col("F_spine1_x")).alias("s"), F.when(F.col("A_head_x") > 230, F.col("A_head_x")).alias("h"))
    return fill.fill_forward(k.where("s is not null"), ["h"]).select("track_id", "frame", "s", "h")


SQL_MID = f"""{SQL_POSE}, mids AS (SELECT *, (F_spine1_x+G_spine2_x)/2 AS mid_spine1_spine2_x, (F_spine1_y+G_spine2_y)/2 AS mid_spine1_spine2_y,
    LEAST(F_spine1_l, G_spine2_l) AS mid_spine1_spine2_l, (G_spine2_x+H_spine3_x)/2 AS mid_spine2_spine3_x, (G_spine2_y+H_spine3_y)/2 AS mid_spine2_spine3_y,
    LEAST(G_spine2_l, H_spine3_l) AS mid_spine2_spine3_l FROM pose)"""


def _spine_sql(lik, jh, jt, hd, gd, ang, drops_head, per_coord, null_without):
    parts = SPINE10 + ([R, L] if gd is not None else [])
    ctes = [SQL_MID, "raw AS (SELECT *, F_spine1_x AS rx, F_spine1_y AS ry FROM mids)"]
    ctes.append("lik AS (SELECT * REPLACE (" + _replace({f"{p}_{c}": f"CASE WHEN {p}_l < {lik} THEN NULL ELSE {p}_{c} END" for p in parts for c in "xy"}) + ") FROM raw)")
    prev = "lik"
    if jh is not None:
        lim = {p: jh if i <= 3 else jt for i, p in enumerate(parts)}
        ctes.append("jmp AS (SELECT * REPLACE (" + _replace({f"{p}_{c}": f"CASE WHEN ABS({p}_{c} - LAG({p}_{c}) {over()}) > {lim[p]} THEN NULL ELSE {p}_{c} END" for p in parts for c in "xy"}) + ") FROM lik)")
        prev = "jmp"
    ctes.append(f"""hd AS (SELECT *, A_head_x-rx AS hsx, A_head_y-ry AS hsy, mid_spine1_spine2_x-F_spine1_x AS bx, mid_spine1_spine2_y-F_spine1_y AS by_ FROM {prev})""")
    ctes.append("g0 AS (SELECT * REPLACE (" + _replace({f"A_head_{c}": f"CASE WHEN SQRT(hsx*hsx+hsy*hsy) > {hd} THEN NULL ELSE A_head_{c} END" for c in "xy"}) + ") FROM hd)")
    prev = "g0"
    for i in range(3, len(SPINE10)):
        p, ps = SPINE10[i], [SPINE10[i - 1], SPINE10[i - 2], SPINE10[i - 3]]
        d = {c: [f"({p}_{c}-{q}_{c})" for q in ps] for c in "xy"}
        if per_coord:
            ox, oy = (f"COALESCE({', '.join(d[c])})" for c in "xy")
        else:
            ox, oy = ("CASE " + " ".join(f"WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {v}" for a, b, v in zip(d["x"], d["y"], d[c])) + " END" for c in "xy")
        ctes.append(f"v{i} AS (SELECT *, {ox} AS ox, {oy} AS oy FROM {prev})")
        bad = f"COALESCE({angle('bx', 'by_', 'ox', 'oy')} > {ang}, FALSE)" + (" OR ox IS NULL OR oy IS NULL" if null_without else "")
        ctes.append(f"a{i} AS (SELECT * EXCLUDE (ox, oy) REPLACE (" + _replace({f"{p}_{c}": f"CASE WHEN {bad} THEN NULL ELSE {p}_{c} END" for c in "xy"}) + f") FROM v{i})")
        prev = f"a{i}"
    if gd is not None:
        for g in (R, L):
            bad = f"{dist(g, H)} > {gd}"
            drop = [g, H] if drops_head else [g]
            ctes.append(f"g{g[0]} AS (SELECT * REPLACE (" + _replace({f"{p}_{c}": f"CASE WHEN {bad} THEN NULL ELSE {p}_{c} END" for p in drop for c in "xy"}) + f") FROM {prev})")
            prev = f"g{g[0]}"
    ctes.append("fin AS (SELECT * REPLACE (" + _replace({f"A_head_{c}": f"CASE WHEN {angle('bx', 'by_', '-hsx', '-hsy')} > {ang} THEN NULL ELSE A_head_{c} END" for c in "xy"}) + f") FROM {prev})")
    return f"WITH {', '.join(ctes)} SELECT track_id, frame, {', '.join(_clean_cols(parts))} FROM fin"


_GILLS = [R, L]
for _name, _ids, _kw, _sqlargs, _parts in (
    ("spine_filter_full", "C3 C11", dict(kind="full", likelihood=0.6, jump_head=180, jump_tail=220, head_dist=220, gill_dist=250), (0.6, 180, 220, 220, 250, 75, False, False, True), SPINE10 + _GILLS),
    ("spine_filter_late", "C4 C11", dict(kind="late", likelihood=0.6, head_dist=220, gill_dist=250), (0.6, None, None, 220, 250, 75, True, False, True), SPINE10 + _GILLS),
    ("spine_filter_early", "C5 C11", dict(kind="early", likelihood=0.6, jump=200, head_dist=220), (0.6, 200, 200, 220, None, 75, False, True, False), SPINE10),
):
    @query(_name, _ids, _spine_sql(*_sqlargs), " ".join(_clean_cols(_parts)))
    def _(spark, sf, kw=_kw, parts=_parts):
        return clean.choose_filter(bind.pose(spark, sf), **kw).select("track_id", "frame", *_clean_cols(parts))


def _c6_sql(head, near, inner, slack):
    d = lambda i, j: dist(SPINE8[i], SPINE8[j])
    bad = {0: f"{d(0, 1)} > {head}"}
    for i in range(2, 7):
        bad[i] = f"COALESCE({d(i - 1, i)} > {near}, FALSE) OR COALESCE({d(i, i + 1)} > {near}, FALSE)"
        if i > 2:
            bad[i] += f" OR COALESCE(d{i} > {(i - 1) * near + slack} OR d{i} < {(i - 3) * inner}, FALSE)"
    bad[7] = f"COALESCE({d(6, 7)} > {near}, FALSE) OR COALESCE({d(5, 7)} > {near}, FALSE) OR COALESCE(d7 > {6 * near} OR d7 < {3 * inner}, FALSE)"
    first = ", ".join(f"{d(1, i)} AS d{i}" for i in range(3, 8))
    return (f"WITH {SQL_POSE}, f AS (SELECT track_id, {first} FROM pose WHERE frame = 0) SELECT track_id, frame, "
            + ", ".join((f"CASE WHEN {bad[i]} THEN NULL ELSE {p}_{c} END" if i in bad else f"{p}_{c}") + f" AS {p}_{c}" for i, p in enumerate(SPINE8) for c in "xy")
            + " FROM pose JOIN f USING (track_id)")


@query("part_distance_filter", "C6 C11", _c6_sql(200, 230, 10, 20), " ".join(_clean_cols(SPINE8)))
def _(spark, sf):
    return clean.choose_filter(bind.pose(spark, sf, SPINE8), "neighbour", head=200, near=230, inner=10, slack=20).select("track_id", "frame", *_clean_cols(SPINE8))


def _jump_cte(parts, jump):
    return "jp AS (SELECT * REPLACE (" + _replace({f"{p}_{c}": f"CASE WHEN ABS({p}_{c} - LAG({p}_{c}) {over()}) > {jump} THEN NULL ELSE {p}_{c} END" for p in parts for c in "xy"}) + ") FROM pose)"


S10B = [*SPINE8, "D_tailtip", "C_tailbase"]


def _c7_sql(jump, near):
    ctes, prev = [SQL_POSE, _jump_cte(clean.JUMP_PARTS, jump)], "jp"
    for i in range(2, 10):
        p, a, b = S10B[i], S10B[i - 1], S10B[i + 1] if i < 9 else S10B[i - 2]
        op = ">" if i < 9 else "<"
        bad = f"{dist(a, p)} {op} {near} AND {dist(b, p)} {op} {near}"
        ctes.append(f"n{i} AS (SELECT * REPLACE (" + _replace({f"{p}_{c}": f"CASE WHEN {bad} THEN NULL ELSE {p}_{c} END" for c in "xy"}) + f") FROM {prev})")
        prev = f"n{i}"
    return f"WITH {', '.join(ctes)} SELECT track_id, frame, {', '.join(_clean_cols(S10B))} FROM {prev}"


@query("jump_neighbour_filter", "C7", _c7_sql(250, 170), " ".join(_clean_cols(S10B)))
def _(spark, sf):
    return clean.jump_neighbour_filter(bind.pose(spark, sf), 250, 170).select("track_id", "frame", *_clean_cols(S10B))


def _c8_sql(jump, near):
    sp = S10B[1:]
    hits = {i: f"{dist(sp[i - 1], sp[i])} > {near} AND {dist(sp[i + 1] if i < 8 else sp[i - 2], sp[i])} > {near}" for i in range(2, 9)}
    raw = ", ".join(f"COALESCE({h}, FALSE) AS h{i}" for i, h in hits.items())
    jumps = _replace({f"{p}_{c}": f"CASE WHEN ABS({p}_{c} - LAG({p}_{c}) {over()}) > {jump} THEN NULL ELSE {p}_{c} END" for p in [*clean.JUMP_PARTS, "C_tailbase"] for c in "xy"})
    return (f"WITH {SQL_POSE}, r AS (SELECT *, {raw} FROM pose), j AS (SELECT * REPLACE ({jumps}) FROM r) SELECT track_id, frame, "
            + ", ".join((f"CASE WHEN h{i} THEN NULL ELSE {p}_{c} END" if i in hits else f"{p}_{c}") + f" AS {p}_{c}" for i, p in enumerate(sp) for c in "xy") + " FROM j")


@query("jump_neighbour_filter_raw", "C8", _c8_sql(250, 170), " ".join(_clean_cols(S10B[1:])))
def _(spark, sf):
    return clean.jump_neighbour_filter_raw(bind.pose(spark, sf), 250, 170).select("track_id", "frame", *_clean_cols(S10B[1:]))


C9_PARTS = [*clean.JUMP_PARTS, "D_tailtip", "C_tailbase"]
C9_COLS = [f"{p}_{c}" for p in C9_PARTS for c in "xyl"]


def _c9_sql(jump, close):
    q = ", ".join(f"QUANTILE_CONT({p}_l, 0.5) AS q_{p}" for p in C9_PARTS)
    lik = _replace({f"{p}_l": f"CASE WHEN {p}_l > q_{p} THEN NULL ELSE {p}_l END" for p in C9_PARTS})
    dead = " OR ".join(f"COALESCE({dist(a, b)} < {close}, FALSE)" for i, a in enumerate(S10B) for b in S10B[i + 1:])
    return (f"WITH {SQL_POSE}, {_jump_cte(C9_PARTS, jump)}, q AS (SELECT track_id, {q} FROM pose GROUP BY 1), "
            f"k AS (SELECT * REPLACE ({lik}) FROM jp JOIN q USING (track_id)) SELECT track_id, frame, {_whole_row(C9_COLS, dead)} FROM k")


@query("median_likelihood_filter", "C9 A27", _c9_sql(300, 20), " ".join(C9_COLS))
def _(spark, sf):
    return clean.median_likelihood_filter(bind.pose(spark, sf, C9_PARTS), 300, 20).select("track_id", "frame", *C9_COLS)


C10_COLS = [f"{p}_{c}" for p in clean.LOOSE_PARTS for c in "xyl"]


def _c10_sql(jump, q):
    ctes, prev = [SQL_POSE], "pose"
    for a in "xy":
        ctes.append(f"f{a} AS (SELECT *, " + ", ".join(f"COALESCE(ABS({p}_{a} - LAG({p}_{a}) {over()}) > {jump}, FALSE) AS j_{p}" for p in clean.LOOSE_PARTS) + f" FROM {prev})")
        ctes.append(f"n{a} AS (SELECT * EXCLUDE ({', '.join('j_' + p for p in clean.LOOSE_PARTS)}) REPLACE (" + _replace({f"{p}_{c}": f"CASE WHEN j_{p} THEN NULL ELSE {p}_{c} END" for p in clean.LOOSE_PARTS for c in "xy"}) + f") FROM f{a})")
        prev = f"n{a}"
    qs = ", ".join(f"QUANTILE_CONT({p}_l, {q}) AS q_{p}" for p in clean.LOOSE_PARTS)
    ctes.append(f"q AS (SELECT track_id, {qs} FROM pose GROUP BY 1)")
    cols = ", ".join(f"CASE WHEN {p}_l < q_{p} THEN NULL ELSE {p}_{c} END AS {p}_{c}" for p in clean.LOOSE_PARTS for c in "xyl")
    return f"WITH {', '.join(ctes)} SELECT track_id, frame, {cols} FROM {prev} JOIN q USING (track_id)"


@query("low_likelihood_filter", "C10 A27", _c10_sql(250, 0.1), " ".join(C10_COLS))
def _(spark, sf):
    return clean.low_likelihood_filter(bind.pose(spark, sf, clean.LOOSE_PARTS), 250).select("track_id", "frame", *C10_COLS)


# points whose likelihood is low are taken as missing, which makes the gaps of the next three queries
def _holes(spark, sf, cut=0.62):
    p = bind.pose(spark, sf, SPINE8)
    p = p.withColumns({f"{q}_{a}": clean.null_if(F.col(f"{q}_l") < cut, f"{q}_{a}") for q in SPINE8[2:] for a in "xy"})
    return computed(p, {"pts": clean.points(SPINE8)})


def _flat(df, n=8):
    return df.select("track_id", "frame", *[F.col("pts")[i][a].alias(f"{a}{i}") for i in range(n) for a in "xy"])


def _gap_sql(least, only):
    long = " UNION ALL ".join(f"SELECT track_id, frame, {i} AS k, " + ", ".join(f"CASE WHEN {i} >= 2 AND {p}_l < 0.62 THEN NULL ELSE {p}_{c} END AS {c}" for c in "xy") + " FROM pose" for i, p in enumerate(SPINE8))
    win = "OVER (PARTITION BY track_id, frame ORDER BY k ROWS BETWEEN"
    nb = ", ".join(f"LAST_VALUE({e} IGNORE NULLS) {win} UNBOUNDED PRECEDING AND 1 PRECEDING) AS p{n}, FIRST_VALUE({e} IGNORE NULLS) {win} 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n{n}"
                   for n, e in (("x", "x"), ("y", "y"), ("k", "CASE WHEN x IS NOT NULL THEN k END")))
    fill = ", ".join(f"CASE WHEN {c} IS NOT NULL OR present < {least} OR pk IS NULL OR nk IS NULL THEN {c} ELSE p{c} + (k-pk)*(n{c}-p{c})/(nk-pk) END AS {c}" for c in "xy")
    return (f"WITH {SQL_POSE}, long AS ({long}), nb AS (SELECT *, COUNT(x) OVER (PARTITION BY track_id, frame) AS present, {nb} FROM long), "
            f"f AS (SELECT track_id, frame, k, present, {fill} FROM nb) SELECT track_id, frame, "
            + ", ".join(f"MAX(CASE WHEN k = {i} THEN {c} END) AS {c}{i}" for i in range(8) for c in "xy") + f" FROM f {f'WHERE present >= {least}' if only else ''} GROUP BY 1, 2")


_XY8 = " ".join(f"x{i} y{i}" for i in range(8))


@query("spine_gap_fill", "C15", _gap_sql(4, False), _XY8)
def _(spark, sf):
    return _flat(computed(_holes(spark, sf), {"filled": clean.fill_between_points("pts", 4)}).withColumn("pts", F.col("filled")))


@query("spine_gap_fill_full_frames", "C15 P19", _gap_sql(5, True), _XY8)
def _(spark, sf):
    return _flat(clean.full_tail_frames(_holes(spark, sf), "pts", 5))


def _gate_sql(r, t1, t2):
    rot = ", ".join(f"{div(f'{_UX}*({p}_x-F_spine1_x)+{_UY}*({p}_y-F_spine1_y)', _UN)} AS x{i}, {div(f'{_UX}*({p}_y-F_spine1_y)-{_UY}*({p}_x-F_spine1_x)', _UN)} AS y{i}" for i, p in enumerate(SPINE8))
    rad = lambda i: f"SQRT(x{i}*x{i}+y{i}*y{i})"
    keep = ["TRUE"] + [f"({rad(i)} <= {r * (i - 1) + t1} AND {rad(i)} > {r * (i - 2) - t2})" for i in range(1, 8)]
    n = " + ".join(f"CASE WHEN {k} THEN 1 ELSE 0 END" for k in keep)
    return (f"WITH {SQL_POSE}, rot AS (SELECT track_id, frame, {rot} FROM pose), c AS (SELECT *, {n} AS n FROM rot) SELECT track_id, frame, "
            + ", ".join(f"CASE WHEN n >= 4 AND {keep[i]} THEN {c}{i} END AS {c}{i}" for i in range(8) for c in "xy") + " FROM c")


@query("radius_gate", "C16 F18", _gate_sql(100.0, 60.0, 50.0), _XY8)
def _(spark, sf):
    pts = []
    for p in SPINE8:
        x, y = G.body_frame(*G.xy(p), G.xy("A_head"), G.xy("F_spine1"))
        pts.append(F.struct(x.alias("x"), y.alias("y")))
    d = computed(bind.pose(spark, sf, SPINE8), {"pts": F.array(*pts)})
    return _flat(computed(d, {"kept": clean.radius_gate("pts", 100.0, 60.0, 50.0)}).withColumn("pts", F.col("kept")))


# --- pairs ---------------------------------------------------------------------------------------------------------------
SQL_PAIR = SQL_POSE + f""", side AS (SELECT track_id // 2 AS trial, track_id % 2 AS s, frame, {', '.join(
    f"{p}_x + CASE WHEN track_id % 2 = 1 THEN 500 ELSE 0 END AS {p}_x, {p}_y" for p in HEAD)} FROM pose),
    g AS (SELECT trial, s, frame, {H}_x AS hx, {H}_y AS hy, {MX} AS mx, {MY} AS my, {dist(H, R)} AS hr, {dist(H, L)} AS hl, {dist(R, L)} AS rl FROM side),
    d AS (SELECT a.trial, a.frame, a.s, SQRT((a.mx-a.hx)*(a.mx-a.hx)+(a.my-a.hy)*(a.my-a.hy)) AS l1,
        SQRT((a.hx-b.hx)*(a.hx-b.hx)+(a.hy-b.hy)*(a.hy-b.hy)) AS l2, SQRT((b.hx-a.mx)*(b.hx-a.mx)+(b.hy-a.my)*(b.hy-a.my)) AS l3, a.hr, a.hl, a.rl
        FROM g a JOIN g b ON a.trial = b.trial AND a.frame = b.frame AND a.s <> b.s),
    gz AS (SELECT trial, frame, s, {side('l1', 'l2', 'l3')} AS gaze, {side('hr', 'hl', 'rl')} AS oper FROM d),
    pr AS (SELECT a.trial, a.frame, a.gaze AS l_gaze, b.gaze AS r_gaze, a.oper AS l_oper, b.oper AS r_oper
        FROM gz a JOIN gz b ON a.trial = b.trial AND a.frame = b.frame AND a.s = 0 AND b.s = 1)"""


def gaze_pairs(spark, sf):
    """trial, frame, gaze and operculum angle of both subjects."""
    p = bind.pose(spark, sf, HEAD)
    p = pairs.offset_side(p, [f"{q}_x" for q in HEAD], F.expr("track_id % 2 = 1"))
    mx, my = G.gill_midpoint()
    p = p.select("track_id", "frame", F.col("A_head_x").alias("hx"), F.col("A_head_y").alias("hy"), mx.alias("mx"), my.alias("my"), G.operculum_angle().alias("oper"))
    j = pairs.pair_frames(p, ["hx", "hy", "mx", "my", "oper"])
    pt = lambda s, k: (F.col(f"{s}_{k}x"), F.col(f"{s}_{k}y"))
    return j.select("trial", "frame", G.gaze_angle(pt("L", "h"), pt("L", "m"), pt("R", "h")).alias("l_gaze"),
                    G.gaze_angle(pt("R", "h"), pt("R", "m"), pt("L", "h")).alias("r_gaze"),
                    F.col("L_oper").alias("l_oper"), F.col("R_oper").alias("r_oper"))


@query("gaze_pair", "F14 J1 P13", f"WITH {SQL_PAIR} SELECT trial, frame, l_gaze, r_gaze, l_oper, r_oper FROM pr", "l_gaze r_gaze l_oper r_oper")
def _(spark, sf):
    return gaze_pairs(spark, sf)


_D40 = over("19 PRECEDING AND 20 FOLLOWING", "trial")


@query("mutual_gaze", "A26 W20", f"""WITH {SQL_PAIR}, m AS (SELECT trial, frame, MAX(CASE WHEN l_gaze > 175 THEN 1 ELSE 0 END) {_D40} AS l,
    MAX(CASE WHEN r_gaze > 175 THEN 1 ELSE 0 END) {_D40} AS r FROM pr) SELECT trial, frame FROM m WHERE l * r = 1""")
def _(spark, sf):
    from ..functions.label import above

    g = gaze_pairs(spark, sf).select("trial", "frame", above("l_gaze", 175).alias("l"), above("r_gaze", 175).alias("r"))
    m = windowed(g, lambda w: {c: F.max(c).over(w.rowsBetween(-19, 20)) for c in "lr"}, before=19, after=20, keys=("trial",))
    return m.where("l = 1 AND r = 1").select("trial", "frame")


@query("prob_cond_face", "A3 P9 J6", f"WITH {SQL_PAIR} SELECT trial, SUM(CASE WHEN l_gaze > 90 THEN 1 ELSE 0 END) / CAST(COUNT(*) AS DOUBLE) AS prob FROM pr WHERE r_gaze BETWEEN 60 AND 150 GROUP BY 1", "prob")
def _(spark, sf):
    return rates.conditional_probability(gaze_pairs(spark, sf), "l_gaze", 90, "r_gaze", 60, 150, ("trial",))


@query("prob_cond_att", "A4", f"WITH {SQL_PAIR} SELECT trial, SUM(CASE WHEN l_oper > 60 THEN 1 ELSE 0 END) / CAST(COUNT(*) AS DOUBLE) AS prob FROM pr WHERE l_gaze BETWEEN 60 AND 150 GROUP BY 1", "prob")
def _(spark, sf):
    return rates.conditional_probability(gaze_pairs(spark, sf), "l_oper", 60, "l_gaze", 60, 150, ("trial",))


@query("condition_filter", "P8 P9 J6", f"WITH {SQL_PAIR} SELECT trial, frame, l_oper, r_oper FROM pr WHERE l_gaze > 120 AND r_gaze BETWEEN 30 AND 150", "l_oper r_oper")
def _(spark, sf):
    return gaze_pairs(spark, sf).where((F.col("l_gaze") > 120) & F.col("r_gaze").between(30, 150)).select("trial", "frame", "l_oper", "r_oper")


@query("joint_gaze_hist", "A10 A11", f"""WITH {SQL_PAIR} SELECT CAST(FLOOR(l_gaze / 20) AS BIGINT) AS bin_l, CAST(FLOOR(r_gaze / 20) AS BIGINT) AS bin_r, l_oper > 65 AS open, COUNT(*) AS frames
    FROM pr WHERE l_gaze IS NOT NULL AND r_gaze IS NOT NULL AND l_oper IS NOT NULL GROUP BY 1, 2, 3""")
def _(spark, sf):
    from ..operators.density import joint_histogram

    g = gaze_pairs(spark, sf).na.drop("any", subset=["l_gaze", "r_gaze", "l_oper"]).withColumn("open", F.col("l_oper") > 65)
    return joint_histogram(g, "l_gaze", "r_gaze", 20, keys=("open",)).select(F.col("bx").alias("bin_l"), F.col("by").alias("bin_r"), "open", F.col("n").alias("frames"))


@query("mirror_side", "P14", f"""WITH {SQL_HEADV} SELECT track_id, frame, CASE WHEN track_id % 2 = 1 THEN 500 - hx ELSE hx END AS x,
    CASE WHEN track_id % 2 = 1 THEN 180 - {SQL_ORI} ELSE {SQL_ORI} END AS orientation FROM hv""", "x orientation")
def _(spark, sf):
    p = bind.pose(spark, sf, HEAD).select("track_id", "frame", F.col("A_head_x").alias("x"), G.orientation_degrees(*G.head_vector()).alias("orientation"))
    return pairs.mirror_side(p, "x", "orientation", F.expr("track_id % 2 = 1"))


@query("opponent_labels", "J13", f"""WITH {SQL_PAIR}, s AS (SELECT trial, frame, s, CASE WHEN gaze > 90 THEN 1 ELSE 0 END AS label FROM gz)
    SELECT a.trial * 2 + a.s AS track_id, a.frame, CAST(a.label AS BIGINT) AS label, CAST(b.label AS BIGINT) AS opponent FROM s a JOIN s b ON a.trial = b.trial AND a.frame = b.frame AND a.s <> b.s""")
def _(spark, sf):
    from ..functions.label import above

    g = gaze_pairs(spark, sf)
    both = g.select(F.inline(F.array(*[F.struct((F.col("trial") * 2 + i).alias("track_id"), F.col("frame"), above(f"{s}_gaze", 90).alias("label")) for i, s in enumerate("lr")])))
    return pairs.swap_labels(both, "label")


@query("part_pairs", "J14", f"WITH {SQL_POSE} SELECT part_a, part_b, COUNT(*) AS frames FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS part_a, '{b}' AS part_b, {dist(a, b)} AS d FROM pose" for a in S10B for b in S10B if a != b) + ") q WHERE d < 100 GROUP BY 1, 2")
def _(spark, sf):
    d = pairs.part_distances(bind.pose(spark, sf, S10B), S10B).where("distance < 100")
    return d.groupBy("part_a", "part_b").agg(F.count(F.lit(1)).alias("frames"))


_PF = "center_distance head_distance LR_Angle RL_Angle head_dir_angle L_lateral_speed L_forward_speed R_lateral_speed R_forward_speed"


def _moves(s, o):
    dx, dy = f"(LAG({s}.hx, 10) OVER w - {s}.hx)", f"(LAG({s}.hy, 10) OVER w - {s}.hy)"
    along = f"(ABS({dx}*({o}.hx-{o}.cx)+{dy}*({o}.hy-{o}.cy)) / NULLIF(SQRT(({o}.hx-{o}.cx)*({o}.hx-{o}.cx)+({o}.hy-{o}.cy)*({o}.hy-{o}.cy)), 0))"
    return f"{along} / 0.25", f"SQRT(GREATEST({dx}*{dx}+{dy}*{dy} - {along}*{along}, 0)) / 0.25"


@query("pair_features", "J11 J12 R2 R18 J1", f"""WITH {SQL_RINGS}, num AS (SELECT vec_id, CAST(label AS BIGINT) AS track_id, ROW_NUMBER() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS f FROM embeddings),
    sh AS (SELECT n.track_id, n.f AS frame, r.pt, r.x + CASE WHEN n.track_id % 2 = 1 THEN 500 ELSE 0 END AS x, r.y FROM ring r JOIN num n ON r.frame = n.vec_id),
    nx AS (SELECT a.track_id, a.frame, a.x, a.y, b.x AS u, b.y AS v FROM sh a JOIN sh b ON a.track_id = b.track_id AND a.frame = b.frame AND b.pt = (a.pt + 1) % 32),
    ce AS (SELECT track_id, frame, SUM((x+u)*(x*v-u*y)) / (3*SUM(x*v-u*y)) AS cx, SUM((y+v)*(x*v-u*y)) / (3*SUM(x*v-u*y)) AS cy FROM nx GROUP BY 1, 2),
    he AS (SELECT ce.*, sh.x AS hx, sh.y AS hy FROM ce JOIN sh ON ce.track_id = sh.track_id AND ce.frame = sh.frame AND sh.pt = (ce.frame * 7) % 32)
    SELECT l.track_id // 2 AS trial, l.frame, SQRT((l.cx-r.cx)*(l.cx-r.cx)+(l.cy-r.cy)*(l.cy-r.cy)) AS center_distance, SQRT((l.hx-r.hx)*(l.hx-r.hx)+(l.hy-r.hy)*(l.hy-r.hy)) AS head_distance,
    {angle('l.hx-l.cx', 'l.hy-l.cy', 'l.cx-r.cx', 'l.cy-r.cy')} AS LR_Angle, {angle('r.hx-r.cx', 'r.hy-r.cy', 'l.cx-r.cx', 'l.cy-r.cy')} AS RL_Angle,
    {angle('l.hx-l.cx', 'l.hy-l.cy', 'r.hx-r.cx', 'r.hy-r.cy')} AS head_dir_angle, {_moves('l', 'r')[0]} AS L_lateral_speed, {_moves('l', 'r')[1]} AS L_forward_speed,
    {_moves('r', 'l')[0]} AS R_lateral_speed, {_moves('r', 'l')[1]} AS R_forward_speed
    FROM he l JOIN he r ON l.track_id % 2 = 0 AND r.track_id = l.track_id + 1 AND l.frame = r.frame WINDOW w AS (PARTITION BY l.track_id ORDER BY l.frame)""",
       " ".join(f"{c}:4" for c in _PF.split()))
def _(spark, sf):
    from ..operators import ring

    n = bind.numbered_vectors(spark, sf).select("track_id", "frame", F.col("vec_id"))
    r = bind.rings(spark, sf).select(F.col("frame").alias("vec_id"), "pts")
    t = n.join(r, "vec_id").withColumn("pts", F.expr("transform(pts, p -> named_struct('x', p.x + CASE WHEN track_id % 2 = 1 THEN 500 ELSE 0 END, 'y', p.y))"))
    t = t.withColumn("c", ring.centroid("pts")).withColumn("h", ring.point_at("pts", "frame * 7"))
    return pairs.pair_features(t.select("track_id", "frame", "h.x", "h.y", "c").select(
        "track_id", "frame", F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("c.x").alias("cx"), F.col("c.y").alias("cy")))
