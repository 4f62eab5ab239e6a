"""Closed outlines: one row per frame with ``pts array<struct<x,y>>``.

An outline is small (tens to some thousand points), so every operator is a per-row array expression and nothing is
shuffled. Functions take column names or SQL snippets and return columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunk import computed


def _at(pts: str, i: str) -> str:
    return f"{pts}[cast(pmod({i}, size({pts})) as int)]"


def _index(pts: str) -> str:
    return f"sequence(0, size({pts}) - 1)"


def area(pts: str = "pts") -> Column:
    p, q = f"{pts}[i]", _at(pts, "i + 1")
    return F.expr(f"aggregate({_index(pts)}, 0D, (s, i) -> s + ({p}.x * {q}.y - {q}.x * {p}.y)) / 2")


def centroid(pts: str = "pts") -> Column:
    """Centre of the enclosed polygon as struct<x,y>; null for a degenerate outline."""
    p, q = f"{pts}[i]", _at(pts, "i + 1")
    cross = f"({p}.x * {q}.y - {q}.x * {p}.y)"
    s = (f"aggregate({_index(pts)}, named_struct('a', 0D, 'x', 0D, 'y', 0D), (s, i) -> named_struct("
         f"'a', s.a + {cross}, 'x', s.x + ({p}.x + {q}.x) * {cross}, 'y', s.y + ({p}.y + {q}.y) * {cross}), "
         f"s -> CASE WHEN s.a <> 0 THEN named_struct('x', s.x / (3 * s.a), 'y', s.y / (3 * s.a)) END)")
    return F.expr(s)


def distances(pts: str = "pts", x: str = "center.x", y: str = "center.y") -> Column:
    return F.expr(f"transform({pts}, p -> sqrt((p.x - {x}) * (p.x - {x}) + (p.y - {y}) * (p.y - {y})))")


def array_quantile(values: str, q: float) -> Column:
    """Linear-interpolated quantile of a non-empty array."""
    return F.expr(f"""transform(array(array_sort({values})), v ->
        v[cast(floor({q}D * (size(v) - 1)) as int)] + (v[cast(ceil({q}D * (size(v) - 1)) as int)] - v[cast(floor({q}D * (size(v) - 1)) as int)])
        * ({q}D * (size(v) - 1) - floor({q}D * (size(v) - 1))))[0]""")


def nearest_point(pts: str, x: str, y: str) -> Column:
    """Index of the point nearest to (x, y), the first on ties."""
    return F.expr(f"""array_min(transform({pts}, (p, i) -> named_struct(
        'd', (p.x - {x}) * (p.x - {x}) + (p.y - {y}) * (p.y - {y}), 'i', i))).i""")


def point_at(pts: str, idx: str) -> Column:
    return F.expr(_at(pts, idx))


def _cosine(p: str, a: str, b: str) -> str:
    """Cosine at p between a and b, plus 1."""
    ax, ay, bx, by = f"({a}.x - {p}.x)", f"({a}.y - {p}.y)", f"({b}.x - {p}.x)", f"({b}.y - {p}.y)"
    return f"try_divide({ax} * {bx} + {ay} * {by}, sqrt(({ax} * {ax} + {ay} * {ay}) * ({bx} * {bx} + {by} * {by}))) + 1"


def cosine_scores(pts: str = "pts", step: int | str = 30) -> Column:
    """1 + cosine between the points ``step`` ahead and ``step`` behind, per point."""
    return F.expr(f"transform({pts}, (p, i) -> {_cosine('p', _at(pts, f'i + ({step})'), _at(pts, f'i - ({step})'))})")


def cosine_scores_backoff(pts: str, valid: str, step: int = 3, min_step: int = 2) -> Column:
    """As ``cosine_scores``, each side shortening its step until it meets a valid point or ``min_step``; invalid points are -1."""
    def reach(sign):
        ok = _at(valid, f"i {sign} s")
        return f"array_max(filter(sequence({min_step}, {step}), s -> s = {min_step} OR {ok}))"
    a, b = _at(pts, f"i + {reach('+')}"), _at(pts, f"i - {reach('-')}")
    return F.expr(f"transform({pts}, (p, i) -> CASE WHEN NOT {valid}[i] THEN -1D ELSE {_cosine('p', a, b)} END)")


def side_scores(scores: str, valid: str, in1: str, out1: str) -> tuple[Column, Column]:
    """Scores of valid points strictly between the first pair of anchors, and of the other valid points."""
    left = F.expr(f"filter({scores}, (c, i) -> {valid}[i] AND i > {in1} AND i < {out1})")
    right = F.expr(f"filter({scores}, (c, i) -> {valid}[i] AND NOT (i > {in1} AND i < {out1}))")
    return left, right


def curvature(pts: str = "pts", n: int = 3) -> Column:
    """Absolute discrete curvature from central differences ``n`` points wide."""
    p, a, b = "p", _at(pts, f"i + {n}"), _at(pts, f"i - {n}")
    h = f"({n}D / size({pts}))"
    d1 = lambda c: f"(({a}.{c} - {b}.{c}) / (2 * {h}))"
    d2 = lambda c: f"(({a}.{c} + {b}.{c} - 2 * {p}.{c}) / ({h} * {h}))"
    return F.expr(f"""transform({pts}, (p, i) -> try_divide(abs({d1('x')} * {d2('y')} - {d1('y')} * {d2('x')}),
        pow({d1('x')} * {d1('x')} + {d1('y')} * {d1('y')}, 1.5D)))""")


def suppress_far(scores: str, dists: str, threshold: str, value: float = 0.1) -> Column:
    return F.expr(f"transform({scores}, (s, i) -> CASE WHEN {dists}[i] > {threshold} THEN {value}D ELSE s END)")


def circular_mean(values: str, width: int | str) -> Column:
    """Mean of the 2*width+1 values around each position, over the seam."""
    return F.expr(f"""transform({values}, (val_, pos_) -> aggregate(sequence(-({width}), {width}), 0D,
        (acc_, off_) -> acc_ + {_at(values, 'pos_ + off_')}) / (2 * ({width}) + 1))""")


def top_scores(scores: str, k: int) -> Column:
    return F.expr(f"slice(reverse(array_sort({scores})), 1, {k})")


def midline(pts: str, idx: str, step: int) -> Column:
    """Middle of the two points ``step`` away from ``idx`` on either side."""
    a, b = _at(pts, f"{idx} + {step}"), _at(pts, f"{idx} - {step}")
    return F.expr(f"named_struct('x', ({a}.x + {b}.x) / 2, 'y', ({a}.y + {b}.y) / 2)")


def midline_path(pts: str, idx: str, length: str | None = None) -> Column:
    """Middles of idx+j and idx-j for j = 0, 1, .. (half the outline by default)."""
    n = length or f"cast(floor(size({pts}) / 2) as int)"
    a, b = _at(pts, f"{idx} + j"), _at(pts, f"{idx} - j")
    return F.expr(f"transform(sequence(0, {n} - 1), j -> named_struct('x', ({a}.x + {b}.x) / 2, 'y', ({a}.y + {b}.y) / 2))")


def side_midline(pts: str, in1: str, out1: str, in2: str, out2: str) -> Column:
    """Middles of in1+j and out2-j along the shorter of the two sides."""
    n = f"least(pmod({out1} - {in1}, size({pts})), pmod({out2} - {in2}, size({pts})))"
    a, b = _at(pts, f"{in1} + j"), _at(pts, f"{out2} - j")
    body = f"transform(sequence(0, cast({n} as int) - 1), j -> named_struct('x', ({a}.x + {b}.x) / 2, 'y', ({a}.y + {b}.y) / 2))"
    return F.expr(f"CASE WHEN {n} > 0 THEN {body} END")


def tail_shape(df: DataFrame, pts: str = "pts", head: str = "head_idx", tail: str = "tail_idx", step: int = 50) -> DataFrame:
    """tail_angle between the head and tail midlines and tail_dev, the tail's distance to the head midline."""
    from ..functions.geom import line_distance, vector_angle

    d = computed(df, {"_h1": point_at(pts, head), "_h2": midline(pts, head, step), "_t1": point_at(pts, tail), "_t2": midline(pts, tail, step)})
    c = lambda n: (F.col(f"{n}.x"), F.col(f"{n}.y"))
    (hx, hy), (mx, my), (tx, ty), (ux, uy) = c("_h1"), c("_h2"), c("_t1"), c("_t2")
    return d.withColumns({
        "tail_angle": vector_angle(hx - mx, hy - my, tx - ux, ty - uy),
        "tail_dev": line_distance((hx, hy), (mx, my), (tx, ty)),
    }).drop("_h1", "_h2", "_t1", "_t2")


# --- runs on the outline -----------------------------------------------------------------------------------------------
def ring_runs(flags: str) -> Column:
    """array<struct<v, at, len>> of the runs of equal flags, from position 0 on."""
    starts = f"filter({_index(flags)}, i -> i = 0 OR {flags}[i] <> {flags}[greatest(i - 1, 0)])"
    return F.expr(f"""transform(array({starts}), s -> transform(s, (b, k) -> named_struct('v', {flags}[b], 'at', b,
        'len', CASE WHEN k + 1 < size(s) THEN s[least(k + 1, size(s) - 1)] ELSE size({flags}) END - b)))[0]""")


def merge_short_runs(df: DataFrame, runs: str, out: str, n_pts: str, shortest: int) -> DataFrame:
    """Runs shorter than ``shortest`` join the segment before them (leading ones the first segment).

    The run over the seam counts as one run. A segment therefore begins where a long run differs from the long run
    before it. The result is array<struct<v, len>> from position 0; null when no run is long.
    """
    seam = f"(size({runs}) > 1 AND {runs}[0].v = {runs}[size({runs}) - 1].v)"
    d = computed(df, {"_cut": F.expr(f"CASE WHEN {seam} THEN {runs}[size({runs}) - 1].len ELSE 0 END")})
    # positions are counted from the start of the seam run
    d = computed(d, {"_turned": F.expr(f"""transform(slice({runs}, 1, size({runs}) - CASE WHEN {seam} THEN 1 ELSE 0 END),
        (r, k) -> named_struct('v', r.v, 'at', CASE WHEN k = 0 THEN 0 ELSE r.at + _cut END, 'len', r.len + CASE WHEN k = 0 THEN _cut ELSE 0 END))""")})
    d = computed(d, {"_long": F.expr(f"filter(_turned, r -> r.len >= {shortest})")})
    d = computed(d, {"_heads": F.expr("filter(_long, (r, k) -> k = 0 OR r.v <> _long[greatest(k - 1, 0)].v)")})
    d = computed(d, {"_segs": F.expr(f"""transform(_heads, (h, k) -> named_struct('v', h.v, 'len',
        CASE WHEN k + 1 < size(_heads) THEN _heads[least(k + 1, size(_heads) - 1)].at ELSE {n_pts} END - CASE WHEN k = 0 THEN 0 ELSE h.at END))""")})
    last = "size(_segs) - 1"
    d = computed(d, {"_segs": F.expr(f"""CASE WHEN size(_segs) = 0 THEN NULL WHEN _cut = 0 THEN _segs
        WHEN _segs[{last}].v <> _segs[0].v THEN concat(
            transform(_segs, (s, k) -> named_struct('v', s.v, 'len', s.len - CASE WHEN k = 0 THEN _cut ELSE 0 END)),
            array(named_struct('v', _segs[0].v, 'len', _cut)))
        ELSE transform(_segs, (s, k) -> named_struct('v', s.v, 'len',
            s.len - CASE WHEN k = 0 THEN _cut ELSE 0 END + CASE WHEN k = {last} THEN _cut ELSE 0 END)) END""")})
    # a single long run is not a segmentation
    return computed(d, {out: F.expr(f"CASE WHEN size({runs}) > 1 THEN _segs END")}).drop("_cut", "_turned", "_long", "_heads", "_segs")


def anchors_by_runs(df: DataFrame, runs: str, n_pts: str, shortest: int = 100) -> DataFrame:
    """in1, out1, in2, out2 from four segments of valid / invalid points.

    Short runs count as valid. The first and the last run are judged by their joint length; the last one closes the ring
    as its own segment when long and joins the segment before it otherwise. Fewer than four segments give nulls.
    """
    last = f"size({runs}) - 1"
    ends = f"({runs}[0].len + {runs}[{last}].len > {shortest})"
    d = computed(df, {"_eff": F.expr(f"""transform({runs}, (r, k) -> named_struct('at', r.at, 'v',
        CASE WHEN k = 0 THEN r.v OR NOT {ends} WHEN r.len < {shortest} THEN true ELSE r.v END))""")})
    inner = f"slice(_eff, 1, {last})"
    starts = f"""concat(filter({inner}, (r, k) -> k = 0 OR r.v <> _eff[greatest(k - 1, 0)].v),
        CASE WHEN {ends} THEN array(_eff[{last}]) ELSE slice(_eff, 1, 0) END)"""
    d = computed(d, {"_s": F.expr(f"CASE WHEN size({runs}) > 1 THEN {starts} END")})
    ok = "size(_s) >= 4"
    end4 = f"least({n_pts} - 1, CASE WHEN size(_s) > 4 THEN _s[4].at ELSE {n_pts} END)"
    first = "_s[0].v"
    names = {"in1": f"CASE WHEN {first} THEN _s[2].at ELSE _s[1].at END", "out1": f"CASE WHEN {first} THEN _s[3].at ELSE _s[2].at END",
             "in2": f"CASE WHEN {first} THEN {end4} ELSE _s[3].at END", "out2": f"CASE WHEN {first} THEN _s[1].at ELSE {end4} END"}
    return computed(d, {n: F.expr(f"CASE WHEN {ok} THEN {e} END") for n, e in names.items()}).drop("_eff", "_s")


def anchors_by_cooldown(df: DataFrame, flags: str, cooldown: int = 30) -> DataFrame:
    """in1, out1, in2, out2 where a flip of the flag counts only more than ``cooldown`` points after the last one.

    A ring that starts valid takes every flip to invalid at once. Missing anchors are -1.
    """
    free = f"(s.since > {cooldown} OR (s.flag AND {flags}[0]))"
    flip = f"({flags}[i] <> s.flag AND {free})"
    state = f"""aggregate({_index(flags)},
        named_struct('flag', {flags}[0], 'since', {cooldown + 1}, 'flips', cast(array() as array<struct<i:int,v:boolean>>)),
        (s, i) -> named_struct('flag', CASE WHEN {flip} THEN {flags}[i] ELSE s.flag END,
            'since', CASE WHEN {flip} THEN 0 ELSE s.since + 1 END,
            'flips', CASE WHEN {flip} THEN concat(s.flips, array(named_struct('i', i, 'v', {flags}[i]))) ELSE s.flips END),
        s -> s.flips)"""
    d = computed(df, {"_flips": F.expr(state)})
    d = computed(d, {"_in": F.expr("filter(_flips, f -> f.v)"), "_out": F.expr("filter(_flips, f -> NOT f.v)")})
    first_out = "CASE WHEN size(_out) > 0 THEN _out[0].i ELSE -1 END"
    later_out = "CASE WHEN size(_out) > 1 THEN _out[size(_out) - 1].i ELSE -1 END"
    return computed(d, {
        "in1": F.expr("CASE WHEN size(_in) > 0 THEN _in[0].i ELSE -1 END"),
        "in2": F.expr("CASE WHEN size(_in) > 1 THEN _in[1].i ELSE -1 END"),
        "out1": F.expr(f"CASE WHEN {flags}[0] THEN {later_out} ELSE {first_out} END"),
        "out2": F.expr(f"CASE WHEN {flags}[0] THEN {first_out} ELSE {later_out} END"),
    }).drop("_flips", "_in", "_out")


def locate_ends(df: DataFrame, pts: str = "pts", head: str = "head_idx", q: float = 0.4, shortest: int = 23, tail_step: int | str | None = None,
                head_step: int | str | None = None, blur: int | str | None = None) -> DataFrame:
    """Refined head_idx (``head_at``) and ``tail_at``: the two longest far segments of the outline, the one at the head
    index being the head; in each the point with the highest blurred cosine score."""
    n = f"size({pts})"
    tail_step = tail_step or f"cast({n} / 10 as int)"
    head_step = head_step or f"cast(cast({n} / 10 as int) * 1.5 as int)"
    blur = blur or f"cast({n} / 20 as int)"
    d = computed(computed(df, {"_center": centroid(pts)}), {"_d": distances(pts, "_center.x", "_center.y")})
    d = computed(computed(d, {"_thr": array_quantile("_d", q)}), {"_far": F.expr("transform(_d, dist_ -> dist_ > _thr)")})
    d = merge_short_runs(computed(d, {"_runs": ring_runs("_far")}), "_runs", "_seg", n, shortest)
    ring = "(size(_seg) > 1 AND _seg[0].v = _seg[size(_seg) - 1].v)"
    d = computed(d, {"_joined": F.expr(f"""transform(slice(_seg, 1, size(_seg) - CASE WHEN _seg[0].v = _seg[size(_seg) - 1].v THEN 1 ELSE 0 END), (s, k) ->
        named_struct('v', s.v, 'k', k, 'len', s.len + CASE WHEN k = 0 AND {ring} THEN _seg[size(_seg) - 1].len ELSE 0 END))""")})
    d = computed(d, {"_pick": F.expr("""slice(array_sort(transform(filter(_joined, s -> s.v),
        s -> named_struct('rank', -s.len, 'k', s.k))), 1, 2)""")})
    upto = "aggregate(slice(_seg, 1, p.k), 0, (a, s) -> a + s.len)"
    head_of_last = f"pmod(aggregate(slice(_seg, 1, size(_seg) - 1), 0, (a, s) -> a + s.len), {n})"
    # segment 0 is taken to run over the seam
    d = computed(d, {"_iv": F.expr(f"""transform(_pick, p -> named_struct(
        's', CASE WHEN p.k = 0 THEN {head_of_last} ELSE {upto} END,
        'e', CASE WHEN p.k = 0 THEN _seg[0].len ELSE {upto} + _seg[p.k].len END - 1))""")})
    holds = lambda i: f"({head} <= _iv[{i}].e AND {head} >= _iv[{i}].s) OR ({head} >= _iv[{i}].s AND _iv[{i}].s > _iv[{i}].e)"
    gap = lambda i: "least(" + ", ".join(f"pmod({a} - {b}, {n})" for a, b in (
        (head, f"_iv[{i}].s"), (head, f"_iv[{i}].e"), (f"_iv[{i}].s", head), (f"_iv[{i}].e", head))) + ")"
    d = computed(d, {"_first": F.expr(f"""CASE WHEN size(_iv) < 2 THEN NULL WHEN {holds(0)} THEN true WHEN {holds(1)} THEN false
        ELSE {gap(1)} >= {gap(0)} END""")})
    d = computed(d, {"_head": F.expr("CASE WHEN _first THEN _iv[0] WHEN NOT _first THEN _iv[1] END"),
                       "_tail": F.expr("CASE WHEN _first THEN _iv[1] WHEN NOT _first THEN _iv[0] END")})
    for name, step in (("tail", tail_step), ("head", head_step)):
        d = computed(computed(d, {"_score": cosine_scores(pts, step)}), {"_score": circular_mean("_score", blur)})
        length = f"CASE WHEN _{name}.s <= _{name}.e THEN _{name}.e - _{name}.s + 1 ELSE {n} - _{name}.s + _{name}.e + 1 END"
        d = computed(d, {f"{name}_at": F.expr(f"""CASE WHEN _{name} IS NOT NULL THEN cast(pmod(_{name}.s - array_max(transform(
            sequence(0, cast({length} as int) - 1), j -> named_struct('v', {_at('_score', f'_{name}.s + j')}, 'j', -j))).j, {n}) as int) END""")})
    return d.drop("_center", "_d", "_thr", "_far", "_runs", "_seg", "_joined", "_pick", "_iv", "_first", "_head", "_tail", "_score")


# --- points against outlines ---------------------------------------------------------------------------------------------
def inside(pts: str, x: str, y: str) -> Column:
    """Even-odd test of (x, y) against the outline."""
    p, q = f"{pts}[i]", _at(pts, "i + 1")
    hit = (f"(({p}.y > {y}) <> ({q}.y > {y}) AND {x} < ({q}.x - {p}.x) * ({y} - {p}.y) / CASE WHEN {q}.y = {p}.y THEN 1D ELSE {q}.y - {p}.y END + {p}.x)")
    return F.expr(f"aggregate({_index(pts)}, 0, (s, i) -> s + CASE WHEN {hit} THEN 1 ELSE 0 END) % 2 = 1")


def edge_distance(pts: str, x: str, y: str) -> Column:
    """Distance of (x, y) to the nearest edge of the outline."""
    p, q = f"{pts}[i]", _at(pts, "i + 1")
    t = (f"greatest(0D, least(1D, coalesce(try_divide(({x} - {p}.x) * ({q}.x - {p}.x) + ({y} - {p}.y) * ({q}.y - {p}.y), "
         f"({q}.x - {p}.x) * ({q}.x - {p}.x) + ({q}.y - {p}.y) * ({q}.y - {p}.y)), 0D)))")
    dx, dy = f"({p}.x + {t} * ({q}.x - {p}.x) - {x})", f"({p}.y + {t} * ({q}.y - {p}.y) - {y})"
    return F.expr(f"array_min(transform({_index(pts)}, i -> sqrt({dx} * {dx} + {dy} * {dy})))")


def keep_inside(df: DataFrame, parts: list[str], pts: str = "pts", margin: float = 5.0) -> DataFrame:
    """Null the parts lying outside the outline by more than ``margin``."""
    out = df
    for p in parts:
        ok = inside(pts, f"{p}_x", f"{p}_y") | (edge_distance(pts, f"{p}_x", f"{p}_y") <= margin)
        out = out.withColumn("_ok", ok).withColumns({f"{p}_{a}": F.when(F.col("_ok"), F.col(f"{p}_{a}")) for a in "xy"}).drop("_ok")
    return out


def largest_blob(blobs: DataFrame, keys=("track_id", "frame"), limit: float = 10000, zoom: int = 0) -> DataFrame:
    """Per frame the biggest blob under the size limit, the first on ties."""
    ok = blobs.where((F.col("area") > 0) & (F.col("area") < limit * (zoom * 8 + 1)))
    best = F.max_by(F.struct("blob", "area", "cx", "cy"), F.struct("area", -F.col("blob")))
    return ok.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")
