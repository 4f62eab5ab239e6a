"""Null-out rules for tracked points (wide pose tables).

Rules run in a fixed order and later rules see the nulls of earlier ones. Jump rules look one frame back, so a chain of
n of them needs n halo frames; everything else is per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geom import acos_degrees, distance, midpoint, vector_cosine, xy
from ..sources.schema import SPINE8, SPINE10
from .chunk import computed, windowed
from .quantile import exact_quantiles
from .rates import any_of

# Parts checked by the frame-jump rules.
CORE_PARTS = ["A_head", "B_rightoperculum", "C_tailbase", "D_tailtip", "E_leftoperculum"]
JUMP_PARTS = ["A_head", "B_rightoperculum", "E_leftoperculum", "F_spine1", "G_spine2", "H_spine3", "I_spine4",
              "J_spine5", "K_spine6", "L_spine7"]
LOOSE_PARTS = ["B_rightoperculum", "E_leftoperculum", "I_spine4", "J_spine5", "K_spine6", "L_spine7", "D_tailtip", "C_tailbase"]


def no(cond: Column) -> Column:
    """A comparison that nulls make false."""
    return F.coalesce(cond, F.lit(False))


def null_if(cond: Column, value) -> Column:
    return F.when(no(cond), None).otherwise(F.col(value) if isinstance(value, str) else value)


def sigma_filter(df: DataFrame, cols: list[str], k: float = 3.0, keys=("track_id",)) -> DataFrame:
    """Null values more than ``k`` population standard deviations from the track mean."""
    stats = df.groupBy(*keys).agg(*[a for c in cols for a in (F.avg(c).alias(f"_a_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    out = df.join(stats, list(keys))
    return out.withColumns({
        c: null_if(F.abs(F.col(c) - F.col(f"_a_{c}")) > k * F.col(f"_s_{c}"), c) for c in cols
    }).drop(*[f"_{p}_{c}" for p in "as" for c in cols])


def _pose_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c[-2:] in ("_x", "_y", "_l")]


def _kill_rows(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.col("_dead"), F.col(c)) for c in _pose_columns(df)}).drop("_dead")


def jump_origin_filter(df: DataFrame, jump: float = 20, origin: float = 15, parts=CORE_PARTS, **kw) -> DataFrame:
    """Per coordinate in order: null it where it jumps, then null the whole row where it lies below ``origin``."""
    stages = []
    for c in [f"{p}_{a}" for p in parts for a in "xy"]:
        def step(w, c=c):
            alive = F.when(~F.col("_dead"), F.col(c))
            return {c: null_if(F.abs(alive - F.lag(alive).over(w)) > jump, alive)}
        stages += [step, lambda w, c=c: {"_dead": F.col("_dead") | no(F.col(c) < origin)}]
    out = windowed(df.withColumn("_dead", F.lit(False)), *stages, before=2 * len(parts), **kw)
    return _kill_rows(out)


def skeleton_filter(df: DataFrame, jump: float = 20, body: float = 250, origin: float = 15, head: float = 70, tail: float = 200, **kw) -> DataFrame:
    """Null the whole row on a jump, a body longer than ``body``, a coordinate below ``origin`` or a skeleton too wide."""
    h, r, l, t = xy("A_head"), xy("B_rightoperculum"), xy("E_leftoperculum"), xy("D_tailtip")
    too_big = any_of([no(distance(h, t) > body), no(distance(l, r) > head), no(distance(h, r) > head), no(distance(h, l) > head),
                      no(distance(t, l) > tail), no(distance(t, r) > tail)])
    cols = [f"{p}_{a}" for p in CORE_PARTS for a in "xy"]
    stages = []
    for i, c in enumerate(cols):
        def step(w, c=c, i=i):
            alive = F.when(~F.col("_dead"), F.col(c))
            bad = no(F.abs(alive - F.lag(alive).over(w)) > jump) | no(alive < origin)
            return {"_dead": F.col("_dead") | bad | F.col("_big")} if i == 0 else {"_dead": F.col("_dead") | bad}
        stages.append(step)
    out = windowed(df.withColumn("_dead", F.lit(False)).withColumn("_big", too_big), *stages, before=len(cols), **kw)
    return _kill_rows(out.drop("_big"))


def add_mid_spine(df: DataFrame) -> DataFrame:
    """Midpoints of spine 1-2 and 2-3; likelihood is the smaller of the two."""
    out = df
    for name, a, b in (("mid_spine1_spine2", "F_spine1", "G_spine2"), ("mid_spine2_spine3", "G_spine2", "H_spine3")):
        mx, my = midpoint(xy(a), xy(b))
        out = out.withColumns({f"{name}_x": mx, f"{name}_y": my,
                               f"{name}_l": F.when(F.col(f"{a}_l").isNotNull() & F.col(f"{b}_l").isNotNull(), F.least(f"{a}_l", f"{b}_l"))})
    return out


def _drop_point(df: DataFrame, part: str, cond: Column) -> DataFrame:
    return df.withColumn("_hit", no(cond)).withColumns(
        {f"{part}_{a}": F.when(~F.col("_hit"), F.col(f"{part}_{a}")) for a in "xy"}).drop("_hit")


def _spine_angle(df: DataFrame, part: str, previous: list[str], per_coordinate: bool, angle: float, null_without: bool) -> DataFrame:
    """Angle of the segment from the nearest present previous part to the baseline."""
    vx, vy = [], []
    for p in previous:
        dx, dy = F.col(f"{part}_x") - F.col(f"{p}_x"), F.col(f"{part}_y") - F.col(f"{p}_y")
        both = dx.isNotNull() & dy.isNotNull()
        vx.append(dx if per_coordinate else F.when(both, dx))
        vy.append(dy if per_coordinate else F.when(both, dy))
    out = df.withColumns({"_ox": F.coalesce(*vx), "_oy": F.coalesce(*vy)})
    a = acos_degrees(vector_cosine(F.col("_bx"), F.col("_by"), F.col("_ox"), F.col("_oy")))
    missing = F.col("_ox").isNull() | F.col("_oy").isNull() if null_without else F.lit(False)
    return _drop_point(out, part, no(a > angle) | missing).drop("_ox", "_oy")


def spine_filter(df: DataFrame, likelihood: float = 0.5, jump_tail: float | None = 15, jump_head: float | None = 5, head_dist: float = 25,
                 gill_dist: float | None = 75, angle: float = 75, gill_drops_head: bool = False, per_coordinate: bool = False,
                 null_without: bool = True, **kw) -> DataFrame:
    """Likelihood, jump, head and gill distance and segment angle rules along the spine (needs ``add_mid_spine``).

    ``jump_*`` None leaves the jump rule out; ``gill_dist`` None leaves the opercula alone.
    """
    parts = SPINE10 + (["B_rightoperculum", "E_leftoperculum"] if gill_dist is not None else [])
    start = df.withColumns({f"_raw_{a}": F.col(f"F_spine1_{a}") for a in "xy"})

    def likely(_w):
        return {f"{p}_{a}": null_if(F.col(f"{p}_l") < likelihood, f"{p}_{a}") for p in parts for a in "xy"}

    def jumps(w):
        limit = {p: jump_head if i <= 3 else jump_tail for i, p in enumerate(parts)}
        return {f"{p}_{a}": null_if(F.abs(F.col(f"{p}_{a}") - F.lag(f"{p}_{a}").over(w)) > limit[p], f"{p}_{a}") for p in parts for a in "xy"}

    if jump_head is None:
        out = start.withColumns(likely(None))
    else:
        out = windowed(start, likely, jumps, before=1, **kw)
    # the head rule runs before spine1 is filtered
    out = out.withColumns({"_hx": F.col("A_head_x") - F.col("_raw_x"), "_hy": F.col("A_head_y") - F.col("_raw_y"),
                           "_bx": F.col("mid_spine1_spine2_x") - F.col("F_spine1_x"), "_by": F.col("mid_spine1_spine2_y") - F.col("F_spine1_y")})
    out = _drop_point(out, "A_head", F.sqrt(F.col("_hx") * F.col("_hx") + F.col("_hy") * F.col("_hy")) > head_dist)
    for i in range(3, len(SPINE10)):
        out = _spine_angle(out, SPINE10[i], [SPINE10[i - 1], SPINE10[i - 2], SPINE10[i - 3]], per_coordinate, angle, null_without)
    if gill_dist is not None:
        for g in ("B_rightoperculum", "E_leftoperculum"):
            out = out.withColumn("_far", no(distance(xy(g), xy("A_head")) > gill_dist))
            out = _drop_point(out, g, F.col("_far"))
            if gill_drops_head:
                out = _drop_point(out, "A_head", F.col("_far"))
            out = out.drop("_far")
    back = acos_degrees(vector_cosine(F.col("_bx"), F.col("_by"), -F.col("_hx"), -F.col("_hy")))
    return _drop_point(out, "A_head", back > angle).drop("_hx", "_hy", "_bx", "_by", "_raw_x", "_raw_y")


def spine_filter_late(df: DataFrame, likelihood: float = 0.5, angle: float = 75, **kw) -> DataFrame:
    """No jump rule; a misplaced operculum also drops the head."""
    return spine_filter(df, likelihood, None, None, angle=angle, gill_drops_head=True, **kw)


def spine_filter_early(df: DataFrame, likelihood: float = 0.5, jump: float = 20, **kw) -> DataFrame:
    """No gill rule, one jump limit, vectors filled per coordinate, points without a vector kept."""
    return spine_filter(df, likelihood, jump, jump, gill_dist=None, per_coordinate=True, null_without=False, **kw)


def neighbour_filter(df: DataFrame, head: float = 30, near: float = 25, inner: float = 10, slack: float = 20, keys=("track_id",)) -> DataFrame:
    """Null spine points too far from either neighbour; the distance to spine1 in the track's first frame decides for
    the whole track. All distances come from the unfiltered points."""
    p = SPINE8
    d = {(i, j): distance(xy(p[i]), xy(p[j])) for i in range(8) for j in range(8)}
    first = df.groupBy(*keys).agg(*[F.min_by(d[(1, i)], "frame").alias(f"_d{i}") for i in range(3, 8)])
    out = df.join(first, list(keys))
    hits = {0: d[(0, 1)] > head}
    for i in range(2, 7):
        bad = no(d[(i - 1, i)] > near) | no(d[(i, i + 1)] > near)
        if i > 2:
            bad = bad | no((F.col(f"_d{i}") > (i - 1) * near + slack) | (F.col(f"_d{i}") < (i - 3) * inner))
        hits[i] = bad
    hits[7] = no(d[(6, 7)] > near) | no(d[(5, 7)] > near) | no((F.col("_d7") > 6 * near) | (F.col("_d7") < 3 * inner))
    # all hits read unfiltered points, so they are fixed before any point is dropped
    out = out.withColumns({f"_hit{i}": no(h) for i, h in hits.items()})
    out = out.withColumns({f"{p[i]}_{a}": F.when(~F.col(f"_hit{i}"), F.col(f"{p[i]}_{a}")) for i in hits for a in "xy"})
    return out.drop(*[f"_hit{i}" for i in hits], *[f"_d{i}" for i in range(3, 8)])


def _jump_each(df: DataFrame, parts: list[str], jump: float, **kw) -> DataFrame:
    """Null every coordinate that jumps, each on its own."""
    return windowed(df, lambda w: {
        f"{p}_{a}": null_if(F.abs(F.col(f"{p}_{a}") - F.lag(f"{p}_{a}").over(w)) > jump, f"{p}_{a}") for p in parts for a in "xy"
    }, before=1, **kw)


def jump_neighbour_filter(df: DataFrame, jump: float = 20, near: float = 20, **kw) -> DataFrame:
    """Jump rule, then null a spine point when both neighbours are farther than ``near``, each step on the result of
    the one before; the last part is dropped when both are nearer."""
    spine = [*SPINE8, "D_tailtip", "C_tailbase"]
    out = _jump_each(df, JUMP_PARTS, jump, **kw)
    for i in range(2, len(spine) - 1):
        here = xy(spine[i])
        out = _drop_point(out, spine[i], no(distance(xy(spine[i - 1]), here) > near) & no(distance(xy(spine[i + 1]), here) > near))
    here = xy(spine[-1])
    return _drop_point(out, spine[-1], no(distance(xy(spine[-2]), here) < near) & no(distance(xy(spine[-3]), here) < near))


def jump_neighbour_filter_raw(df: DataFrame, jump: float = 20, near: float = 50, **kw) -> DataFrame:
    """As ``jump_neighbour_filter`` from spine1 on, with distances of the unfiltered points and one sign throughout."""
    spine = [*SPINE8[1:], "D_tailtip", "C_tailbase"]
    raw = {p: xy(p) for p in spine}
    last = len(spine) - 1
    hits = {i: no(distance(raw[spine[i - 1]], raw[spine[i]]) > near)
            & no(distance(raw[spine[i + 1] if i < last else spine[i - 2]], raw[spine[i]]) > near) for i in range(2, last + 1)}
    out = df.withColumns({f"_hit{i}": h for i, h in hits.items()})
    out = _jump_each(out, [*JUMP_PARTS, "C_tailbase"], jump, **kw)
    return out.withColumns({f"{spine[i]}_{a}": F.when(~F.col(f"_hit{i}"), F.col(f"{spine[i]}_{a}")) for i in hits for a in "xy"}).drop(
        *[f"_hit{i}" for i in hits])


def _likelihood_cut(df: DataFrame, parts: list[str], q: float, keys) -> DataFrame:
    long = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"{p}_l").alias("l")) for p in parts])))
    cut = exact_quantiles(long, [*keys, "part"], "l", {"cut": q})
    return cut.groupBy(*keys).agg(*[F.max(F.when(F.col("part") == p, F.col("cut"))).alias(f"_q_{p}") for p in parts])


def median_likelihood_filter(df: DataFrame, jump: float = 20, close: float | None = 5, keys=("track_id",), **kw) -> DataFrame:
    """Jump rule; null likelihoods above the part's median; null the row when any two spine parts are closer than ``close``
    (None leaves that rule out)."""
    parts = [*JUMP_PARTS, "D_tailtip", "C_tailbase"]
    out = _jump_each(df, parts, jump, **kw).join(_likelihood_cut(df, parts, 0.5, keys), list(keys))
    out = out.withColumns({f"{p}_l": null_if(F.col(f"{p}_l") > F.col(f"_q_{p}"), f"{p}_l") for p in parts}).drop(*[f"_q_{p}" for p in parts])
    if close is None:
        return out
    spine = [*SPINE8, "D_tailtip", "C_tailbase"]
    pairs = [no(distance(xy(a), xy(b)) < close) for i, a in enumerate(spine) for b in spine[i + 1:]]
    return _kill_rows(out.withColumn("_dead", any_of(pairs)))


def low_likelihood_filter(df: DataFrame, jump: float = 20, q: float = 0.1, keys=("track_id",), **kw) -> DataFrame:
    """A jump in x, then in y, nulls both; a likelihood below the part's ``q`` quantile nulls x, y and likelihood."""
    cut = _likelihood_cut(df, LOOSE_PARTS, q, keys)

    def axis(a):
        def find(w):
            return {f"_j_{p}": no(F.abs(F.col(f"{p}_{a}") - F.lag(f"{p}_{a}").over(w)) > jump) for p in LOOSE_PARTS}

        def apply(_w):
            return {f"{p}_{b}": F.when(~F.col(f"_j_{p}"), F.col(f"{p}_{b}")) for p in LOOSE_PARTS for b in "xy"}
        return find, apply
    out = windowed(df, *axis("x"), *axis("y"), before=2, **kw).join(cut, list(keys))
    out = out.withColumns({f"_j_{p}": no(F.col(f"{p}_l") < F.col(f"_q_{p}")) for p in LOOSE_PARTS})
    out = out.withColumns({f"{p}_{b}": F.when(~F.col(f"_j_{p}"), F.col(f"{p}_{b}")) for p in LOOSE_PARTS for b in "xyl"})
    return out.drop(*[f"_j_{p}" for p in LOOSE_PARTS], *[f"_q_{p}" for p in LOOSE_PARTS])


def choose_filter(df: DataFrame, kind: str = "full", add_midpoint: bool = True, **kw) -> DataFrame:
    """'full' | 'late' | 'early' spine rules (with midpoints) or 'neighbour' distances."""
    if kind == "neighbour":
        return neighbour_filter(df, **kw)
    rule = {"full": spine_filter, "late": spine_filter_late, "early": spine_filter_early}[kind]
    return rule(add_mid_spine(df) if add_midpoint else df, **kw)


def points(parts: list[str]) -> Column:
    """array<struct<x,y>> of the named parts; a point missing a coordinate is null."""
    return F.array(*[F.when(F.col(f"{p}_x").isNotNull() & F.col(f"{p}_y").isNotNull(),
                            F.struct(F.col(f"{p}_x").alias("x"), F.col(f"{p}_y").alias("y"))) for p in parts])


def fill_between_points(pts: str = "pts", least: int = 4) -> Column:
    """Points missing between present ones lie on the line between them, if the first two and ``least`` are present."""
    return F.expr(f"""
        CASE WHEN {pts}[0] IS NOT NULL AND {pts}[1] IS NOT NULL AND size(filter({pts}, p -> p IS NOT NULL)) >= {least} THEN
            transform({pts}, (p, i) -> CASE WHEN p IS NOT NULL THEN p ELSE
                transform(array(named_struct(
                        'a', array_max(filter(sequence(0, size({pts}) - 1), k -> k < i AND {pts}[k] IS NOT NULL)),
                        'b', array_min(filter(sequence(0, size({pts}) - 1), k -> k > i AND {pts}[k] IS NOT NULL)))),
                    n -> CASE WHEN n.a IS NOT NULL AND n.b IS NOT NULL THEN named_struct(
                        'x', {pts}[n.a].x + (i - n.a) * ({pts}[n.b].x - {pts}[n.a].x) / (n.b - n.a),
                        'y', {pts}[n.a].y + (i - n.a) * ({pts}[n.b].y - {pts}[n.a].y) / (n.b - n.a)) END)[0] END)
        ELSE {pts} END""")


def full_tail_frames(df: DataFrame, pts: str = "pts", least: int = 4) -> DataFrame:
    """Only frames whose first two points and ``least`` in all are present, gaps filled."""
    ok = F.expr(f"{pts}[0] IS NOT NULL AND {pts}[1] IS NOT NULL AND size(filter({pts}, p -> p IS NOT NULL)) >= {least}")
    return computed(computed(df.where(ok), {"_filled": fill_between_points(pts, least)}), {pts: F.col("_filled")}).drop("_filled")


def radius_gate(pts: str = "pts", r: float = 15, t1: float = 10, t2: float = 5, least: int = 4) -> Column:
    """Keep point 0 and every point k with r(k-2)-t2 < |p| <= r(k-1)+t1; null when fewer than ``least`` remain."""
    kept = f"""transform({pts}, (p, k) -> CASE WHEN k = 0 OR (sqrt(p.x * p.x + p.y * p.y) <= {r}D * (k - 1) + {t1}D
        AND sqrt(p.x * p.x + p.y * p.y) > {r}D * (k - 2) - {t2}D) THEN p END)"""
    return F.expr(f"CASE WHEN size(filter({kept}, p -> p IS NOT NULL)) >= {least} THEN {kept} END")
