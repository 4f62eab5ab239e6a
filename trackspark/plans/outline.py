"""Queries over closed outlines, candidate blobs and arenas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geom as G
from ..functions import label as L
from ..operators import arena, intervals, position, ring
from ..operators.chunk import computed
from ..sources import bind
from ..sources.bind import SQL_POSE, SQL_RINGS
from ..sources.schema import PARTS, SPINE8
from .registry import query
from .sqltext import angle, cosv, div

N = 32
SQL_NEXT = SQL_RINGS + f", nx AS (SELECT a.track_id, a.frame, a.pt, a.x, a.y, b.x AS u, b.y AS v FROM ring a JOIN ring b ON a.frame = b.frame AND b.pt = (a.pt + 1) % {N})"
SQL_CENTER = SQL_NEXT + """, ce AS (SELECT track_id, frame, SUM(x*v-u*y)/2 AS area, SUM((x+u)*(x*v-u*y)) / (3*SUM(x*v-u*y)) AS cx, SUM((y+v)*(x*v-u*y)) / (3*SUM(x*v-u*y)) AS cy FROM nx GROUP BY 1, 2),
    di AS (SELECT r.track_id, r.frame, r.pt, r.x, r.y, SQRT((r.x-cx)*(r.x-cx)+(r.y-cy)*(r.y-cy)) AS d FROM ring r JOIN ce USING (track_id, frame))"""


def _neighbours(step: int, src: str = "ring") -> str:
    return f"""SELECT p.track_id, p.frame, p.pt, p.x, p.y, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM {src} p
        JOIN {src} a ON a.frame = p.frame AND a.pt = (p.pt + {step}) % {N} JOIN {src} b ON b.frame = p.frame AND b.pt = (p.pt - {step} + {N}) % {N}"""


COS1 = f"{cosv('ax-x', 'ay-y', 'bx-x', 'by_-y')} + 1"


def centered(spark, sf):
    r = computed(bind.rings(spark, sf), {"center": ring.centroid("pts")})
    return computed(r, {"d": ring.distances("pts")})


def points_of(df, values: str, name: str, keys=("track_id", "frame")):
    return df.select(*keys, F.posexplode(values).alias("pt", name)).withColumn("pt", F.col("pt").cast("long"))


@query("ring_centroid", "R2 D5", f"WITH {SQL_CENTER} SELECT track_id, frame, area, cx, cy FROM ce", "area:4 cx cy")
def _(spark, sf):
    r = bind.rings(spark, sf)
    return r.select("track_id", "frame", ring.area().alias("area"), ring.centroid().alias("c")).select("track_id", "frame", "area", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))


@query("ring_distance", "R3", f"WITH {SQL_CENTER} SELECT track_id, frame, pt, d FROM di", "d")
def _(spark, sf):
    return points_of(centered(spark, sf), "d", "d")


@query("ring_head_point", "R4 R18 T2", f"""WITH {SQL_RINGS}, h AS (SELECT vec_id AS frame, 250 + 1000 * CAST(embedding[40] AS DOUBLE) AS hx, 250 + 1000 * CAST(embedding[41] AS DOUBLE) AS hy FROM embeddings),
    d AS (SELECT r.*, (x-hx)*(x-hx)+(y-hy)*(y-hy) AS d FROM ring r JOIN h USING (frame)), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY frame ORDER BY d, pt) AS rn FROM d)
    SELECT track_id, frame, pt AS head_idx, x, y FROM k WHERE rn = 1""", "x y")
def _(spark, sf):
    e = bind.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), *[(250 + 1000 * F.element_at("embedding", i).cast("double")).alias(n) for i, n in ((40, "hx"), (41, "hy"))])
    r = bind.rings(spark, sf).join(e, "frame").withColumn("head_idx", ring.nearest_point("pts", "hx", "hy"))
    return r.withColumn("p", ring.point_at("pts", "head_idx")).select("track_id", "frame", F.col("head_idx").cast("long"), "p.x", "p.y")


@query("ring_cosine", "R5", f"WITH {SQL_RINGS}, n AS ({_neighbours(5)}) SELECT track_id, frame, pt, {COS1} AS score FROM n", "score")
def _(spark, sf):
    return points_of(computed(bind.rings(spark, sf), {"s": ring.cosine_scores("pts", 5)}), "s", "score")


SQL_VALID = SQL_CENTER + ", th AS (SELECT frame, QUANTILE_CONT(d, 0.5) AS thr FROM di GROUP BY 1), va AS (SELECT di.*, d < thr AS ok FROM di JOIN th USING (frame))"


@query("ring_cosine_backoff", "R6 A27", f"""WITH {SQL_VALID}, st AS (SELECT p.frame, p.pt,
    MAX(CASE WHEN s = 2 OR a.ok THEN s END) AS fs, MAX(CASE WHEN s = 2 OR b.ok THEN s END) AS bs FROM va p, (SELECT UNNEST([2, 3, 4, 5]) AS s) q
    JOIN va a ON a.frame = p.frame AND a.pt = (p.pt + s) % {N} JOIN va b ON b.frame = p.frame AND b.pt = (p.pt - s + {N}) % {N} GROUP BY 1, 2),
    n AS (SELECT p.track_id, p.frame, p.pt, p.ok, p.x, p.y, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM va p JOIN st ON st.frame = p.frame AND st.pt = p.pt
        JOIN va a ON a.frame = p.frame AND a.pt = (p.pt + fs) % {N} JOIN va b ON b.frame = p.frame AND b.pt = (p.pt - bs + {N}) % {N})
    SELECT track_id, frame, pt, CASE WHEN NOT ok THEN -1.0 ELSE {COS1} END AS score FROM n""", "score")
def _(spark, sf):
    c = _flags(spark, sf, 0.5)
    return points_of(computed(c, {"score": ring.cosine_scores_backoff("pts", "near", 5, 2)}), "score", "score")


@query("ring_curvature", "R7", f"""WITH {SQL_RINGS}, n AS ({_neighbours(3)}), d AS (SELECT *, (ax-bx)/(2*3.0/{N}) AS dx, (ay-by_)/(2*3.0/{N}) AS dy, (ax+bx-2*x)/((3.0/{N})*(3.0/{N})) AS ddx, (ay+by_-2*y)/((3.0/{N})*(3.0/{N})) AS ddy FROM n)
    SELECT track_id, frame, pt, ABS(dx*ddy-dy*ddx) / NULLIF(POWER(dx*dx+dy*dy, 1.5), 0) AS k FROM d""", "k")
def _(spark, sf):
    return points_of(computed(bind.rings(spark, sf), {"k": ring.curvature("pts", 3)}), "k", "k")


@query("ring_suppress_far", "R8 A27", f"""WITH {SQL_CENTER}, th AS (SELECT frame, QUANTILE_CONT(d, 0.6) AS thr FROM di GROUP BY 1), n AS ({_neighbours(5)}), s AS (SELECT frame, pt, {COS1} AS score FROM n)
    SELECT di.track_id, di.frame, di.pt, CASE WHEN d > thr THEN 0.1 ELSE score END AS score FROM di JOIN th USING (frame) JOIN s USING (frame, pt)""", "score")
def _(spark, sf):
    c = computed(centered(spark, sf), {"thr": ring.array_quantile("d", 0.6), "cosines": ring.cosine_scores("pts", 5)})
    return points_of(computed(c, {"kept": ring.suppress_far("cosines", "d", "thr")}), "kept", "score")


SQL_SCORE = SQL_RINGS + f", n AS ({_neighbours(5)}), sc AS (SELECT track_id, frame, pt, {COS1} AS score FROM n)"


@query("ring_smooth", "R9", f"WITH {SQL_SCORE} SELECT p.track_id, p.frame, p.pt, AVG(q.score) AS smooth FROM sc p JOIN sc q ON p.frame = q.frame AND ((q.pt - p.pt + {N}) % {N} <= 3 OR (p.pt - q.pt + {N}) % {N} <= 3) GROUP BY 1, 2, 3", "smooth")
def _(spark, sf):
    c = computed(bind.rings(spark, sf), {"cosines": ring.cosine_scores("pts", 5)})
    return points_of(computed(c, {"blurred": ring.circular_mean("cosines", 3)}), "blurred", "smooth")


@query("ring_topk", "R10 T3", f"WITH {SQL_SCORE}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY frame ORDER BY score DESC) AS rank FROM sc) SELECT track_id, frame, rank, score FROM r WHERE rank <= 10", "score")
def _(spark, sf):
    c = computed(computed(bind.rings(spark, sf), {"cosines": ring.cosine_scores("pts", 5)}), {"top": ring.top_scores("cosines", 10)})
    return c.select("track_id", "frame", F.posexplode("top").alias("i", "score")).select("track_id", "frame", (F.col("i") + 1).cast("long").alias("rank"), "score")


# head and tail positions for the next queries: fixed offsets that differ per frame
SQL_IDX = SQL_RINGS + f", ix AS (SELECT frame, track_id, (frame * 7) % {N} AS hi, (frame * 5 + 16) % {N} AS ti FROM (SELECT DISTINCT frame, track_id FROM ring) q)"


def indexed(spark, sf):
    return bind.rings(spark, sf).withColumns({"head_idx": F.expr(f"frame * 7 % {N}"), "tail_idx": F.expr(f"(frame * 5 + 16) % {N}")})


@query("ring_midline", "R15", f"""WITH {SQL_IDX} SELECT ix.track_id, ix.frame, j.j, (a.x+b.x)/2 AS x, (a.y+b.y)/2 AS y FROM ix, (SELECT CAST(UNNEST(generate_series(0, 15)) AS BIGINT) AS j) j
    JOIN ring a ON a.frame = ix.frame AND a.pt = (hi + j.j) % {N} JOIN ring b ON b.frame = ix.frame AND b.pt = (hi - j.j + {N}) % {N}""", "x y")
def _(spark, sf):
    m = indexed(spark, sf).withColumn("m", ring.midline_path("pts", "head_idx"))
    return m.select("track_id", "frame", F.posexplode("m").alias("j", "p")).select("track_id", "frame", F.col("j").cast("long").alias("j"), "p.x", "p.y")


@query("tail_shape", "R16 R15 F23 F16", f"""WITH {SQL_IDX}, m AS (SELECT ix.track_id, ix.frame, h.x AS hx, h.y AS hy, (h1.x+h2.x)/2 AS mx, (h1.y+h2.y)/2 AS my, t.x AS tx, t.y AS ty, (t1.x+t2.x)/2 AS ux, (t1.y+t2.y)/2 AS uy FROM ix
    JOIN ring h ON h.frame = ix.frame AND h.pt = hi JOIN ring h1 ON h1.frame = ix.frame AND h1.pt = (hi+5)%{N} JOIN ring h2 ON h2.frame = ix.frame AND h2.pt = (hi-5+{N})%{N}
    JOIN ring t ON t.frame = ix.frame AND t.pt = ti JOIN ring t1 ON t1.frame = ix.frame AND t1.pt = (ti+5)%{N} JOIN ring t2 ON t2.frame = ix.frame AND t2.pt = (ti-5+{N})%{N}),
    k AS (SELECT *, (hy-my)/NULLIF(hx-mx, 0) AS k FROM m)
    SELECT track_id, frame, {angle('hx-mx', 'hy-my', 'tx-ux', 'ty-uy')} AS tail_angle, CASE WHEN hx = mx THEN ABS(tx-hx) WHEN hy = my THEN ABS(ty-hy) ELSE ABS(k*tx-ty+(my-k*mx))/SQRT(k*k+1) END AS tail_dev FROM k""", "tail_angle:5 tail_dev:5")
def _(spark, sf):
    return ring.tail_shape(indexed(spark, sf), step=5).select("track_id", "frame", "tail_angle", "tail_dev")


@query("side_midline", "R17", f"""WITH {SQL_IDX}, an AS (SELECT *, hi AS in1, (hi+8)%{N} AS out1, (hi+15)%{N} AS in2, (hi+26)%{N} AS out2 FROM ix)
    SELECT an.track_id, an.frame, j.j, (a.x+b.x)/2 AS x, (a.y+b.y)/2 AS y FROM an, (SELECT CAST(UNNEST(generate_series(0, 7)) AS BIGINT) AS j) j
    JOIN ring a ON a.frame = an.frame AND a.pt = (in1 + j.j) % {N} JOIN ring b ON b.frame = an.frame AND b.pt = (out2 - j.j + {N}) % {N}""", "x y")
def _(spark, sf):
    r = indexed(spark, sf).withColumns({n: F.expr(f"(head_idx + {o}) % {N}") for n, o in (("in1", 0), ("out1", 8), ("in2", 15), ("out2", 26))})
    m = r.withColumn("m", ring.side_midline("pts", "in1", "out1", "in2", "out2"))
    return m.select("track_id", "frame", F.posexplode("m").alias("j", "p")).select("track_id", "frame", F.col("j").cast("long").alias("j"), "p.x", "p.y")


SQL_FLAG = SQL_CENTER + f", th AS (SELECT frame, QUANTILE_CONT(d, 0.4) AS thr FROM di GROUP BY 1), fl AS (SELECT di.track_id, di.frame, di.pt, d > thr AS far FROM di JOIN th USING (frame))"


@query("ring_runs", "R11 W21", f"""WITH {SQL_FLAG}, c AS (SELECT *, CASE WHEN far = LAG(far) OVER (PARTITION BY frame ORDER BY pt) THEN 0 ELSE 1 END AS new FROM fl), g AS (SELECT *, SUM(new) OVER (PARTITION BY frame ORDER BY pt) AS g FROM c)
    SELECT track_id, frame, far, MIN(pt) AS at, COUNT(*) AS len FROM g GROUP BY track_id, frame, g, far""")
def _(spark, sf):
    r = computed(_flags(spark, sf, 0.4), {"runs": ring.ring_runs("far")}).select("track_id", "frame", F.explode("runs").alias("r"))
    return r.select("track_id", "frame", F.col("r.v").alias("far"), F.col("r.at").cast("long").alias("at"), F.col("r.len").cast("long").alias("len"))


def _flags(spark, sf, q):
    c = computed(centered(spark, sf), {"thr": ring.array_quantile("d", q)})
    return computed(c, {"far": F.expr("transform(d, dist_ -> dist_ > thr)"), "near": F.expr("transform(d, dist_ -> dist_ < thr)")})


@query("ring_segments", "R11")
def _(spark, sf):
    c = computed(_flags(spark, sf, 0.4), {"runs": ring.ring_runs("far")})
    m = ring.merge_short_runs(c, "runs", "segs", "size(pts)", 3)
    return m.select("track_id", "frame", F.posexplode("segs").alias("seg", "s")).select("track_id", "frame", "seg", F.col("s.v").alias("far"), F.col("s.len").alias("len"))


@query("ring_anchors_runs", "R12")
def _(spark, sf):
    c = computed(_flags(spark, sf, 0.5), {"runs": ring.ring_runs("near")})
    return ring.anchors_by_runs(c, "runs", "size(pts)", 3).select("track_id", "frame", "in1", "out1", "in2", "out2")


_FLIP = "v <> flag AND (since > 3 OR (f0 AND flag))"


@query("ring_anchors_cooldown", "R13", f"""WITH RECURSIVE {SQL_FLAG.replace("QUANTILE_CONT(d, 0.4)", "QUANTILE_CONT(d, 0.5)").replace("d > thr AS far", "d < thr AS v")}, p AS MATERIALIZED (SELECT track_id, frame, pt, v FROM fl),
    w AS ( SELECT track_id, frame, CAST(-1 AS BIGINT) AS pt, v AS f0, v AS flag, 4 AS since, CAST(-1 AS BIGINT) AS in1, CAST(-1 AS BIGINT) AS in2, CAST(-1 AS BIGINT) AS o1, CAST(-1 AS BIGINT) AS ol, 0 AS n FROM p WHERE pt = 0
      UNION ALL SELECT track_id, frame, pos, f0, CASE WHEN {_FLIP} THEN v ELSE flag END, CASE WHEN {_FLIP} THEN 0 ELSE since + 1 END,
        CASE WHEN {_FLIP} AND v AND in1 < 0 THEN pos ELSE in1 END, CASE WHEN {_FLIP} AND v AND in1 >= 0 AND in2 < 0 THEN pos ELSE in2 END,
        CASE WHEN {_FLIP} AND NOT v AND n = 0 THEN pos ELSE o1 END, CASE WHEN {_FLIP} AND NOT v AND n > 0 THEN pos ELSE ol END, CASE WHEN {_FLIP} AND NOT v THEN n + 1 ELSE n END
        FROM (SELECT w.*, p.pt AS pos, p.v FROM w JOIN p ON p.frame = w.frame AND p.track_id = w.track_id AND p.pt = w.pt + 1) j)
    SELECT track_id, frame, in1, CASE WHEN f0 THEN ol ELSE o1 END AS out1, in2, CASE WHEN f0 THEN o1 ELSE ol END AS out2 FROM w WHERE pt = {N} - 1""")
def _(spark, sf):
    a = ring.anchors_by_cooldown(_flags(spark, sf, 0.5), "near", 3)
    return a.select("track_id", "frame", *[F.col(c).cast("long").alias(c) for c in ("in1", "out1", "in2", "out2")])


@query("ring_ends", "R14")
def _(spark, sf):
    return ring.locate_ends(indexed(spark, sf), shortest=3, tail_step=5, head_step=4, blur=1).select("track_id", "frame", "head_at", "tail_at")


@query("ring_side_scores", "R6 R12")
def _(spark, sf):
    c = computed(_flags(spark, sf, 0.5), {"runs": ring.ring_runs("near")})
    c = computed(ring.anchors_by_runs(c, "runs", "size(pts)", 3), {"cosines": ring.cosine_scores_backoff("pts", "near", 5, 2)})
    left, right = ring.side_scores("cosines", "near", "in1", "out1")
    c = computed(c, {"left_scores": left, "right_scores": right})
    return c.select("track_id", "frame", F.size("left_scores").alias("left_points"), F.size("right_scores").alias("right_points"),
                    F.array_max("left_scores").alias("left_top"), F.array_max("right_scores").alias("right_top"))


# --- points and outlines ---------------------------------------------------------------------------------------------
SQL_PTS = f"""{SQL_NEXT}, pt0 AS (SELECT vec_id AS frame, p.p, 250 + 1000 * CAST(embedding[CAST(2*p.p+1 AS INT)] AS DOUBLE) AS px, 250 + 1000 * CAST(embedding[CAST(2*p.p+2 AS INT)] AS DOUBLE) AS py FROM embeddings, (SELECT UNNEST([16, 17, 18, 19]) AS p) p),
    ed AS (SELECT pt0.frame, p, px, py, x, y, u, v, LEAST(1, GREATEST(0, COALESCE(((px-x)*(u-x)+(py-y)*(v-y)) / NULLIF((u-x)*(u-x)+(v-y)*(v-y), 0), 0))) AS t FROM pt0 JOIN nx USING (frame)),
    io AS (SELECT frame, p, px, py, SUM(CASE WHEN (y > py) <> (v > py) AND px < (u-x)*(py-y)/(CASE WHEN v = y THEN 1 ELSE v-y END)+x THEN 1 ELSE 0 END) % 2 = 1 AS inside, MIN(SQRT((x+t*(u-x)-px)*(x+t*(u-x)-px)+(y+t*(v-y)-py)*(y+t*(v-y)-py))) AS edge FROM ed GROUP BY 1, 2, 3, 4)"""


@query("keypoint_inside", "C13", f"WITH {SQL_PTS} SELECT frame, " + ", ".join(
    f"MAX(CASE WHEN p = {16 + i} AND (inside OR edge <= 5) THEN p{c} END) AS k{i}_{c}" for i in range(4) for c in "xy") + " FROM io GROUP BY 1", " ".join(f"k{i}_{c}" for i in range(4) for c in "xy"))
def _(spark, sf):
    e = bind.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), *[
        (F.lit(250.0) + F.lit(1000.0) * F.element_at("embedding", 2 * (16 + i) + 1 + j).cast("double")).alias(f"k{i}_{c}") for i in range(4) for j, c in enumerate("xy")])
    d = bind.rings(spark, sf).select("frame", "pts").join(e, "frame")
    return ring.keep_inside(d, [f"k{i}" for i in range(4)]).drop("pts")


SQL_HEAD = f"""WITH RECURSIVE {SQL_PTS}, hd AS (SELECT CAST(e.label AS BIGINT) AS track_id, ROW_NUMBER() OVER (PARTITION BY e.label ORDER BY e.vec_id) - 1 AS frame,
      CASE WHEN e.vec_id % 11 <> 0 THEN px END AS x, CASE WHEN e.vec_id % 11 <> 0 THEN py END AS y, e.vec_id % 11 <> 0 AND (inside OR edge <= 5) AS fits FROM io JOIN embeddings e ON e.vec_id = io.frame WHERE p = 16),
    w AS (SELECT track_id, frame, x, y, fits AS ok, x AS lx, y AS ly, CASE WHEN fits THEN 0 ELSE 1 END AS rejects FROM hd WHERE frame = 0
      UNION ALL SELECT n.track_id, n.frame, n.x, n.y, n.ok, CASE WHEN n.ok THEN n.x ELSE n.lx END, CASE WHEN n.ok THEN n.y ELSE n.ly END, CASE WHEN n.ok THEN 0 ELSE n.rejects + 1 END
        FROM (SELECT hd.track_id, hd.frame, hd.x, hd.y, COALESCE(w.lx, hd.x) AS lx, COALESCE(w.ly, hd.y) AS ly, w.rejects, hd.fits AND (w.rejects > 7
            OR SQRT((hd.x-COALESCE(w.lx, hd.x))*(hd.x-COALESCE(w.lx, hd.x)) + (hd.y-COALESCE(w.ly, hd.y))*(hd.y-COALESCE(w.ly, hd.y))) <= 60) AS ok FROM w JOIN hd ON hd.track_id = w.track_id AND hd.frame = w.frame + 1) n)
    SELECT track_id, frame, CASE WHEN ok THEN x END AS k_x, CASE WHEN ok THEN y END AS k_y FROM w"""


@query("head_inside", "C13 C12", SQL_HEAD, "k_x k_y")
def _(spark, sf):
    e = bind.numbered_vectors(spark, sf).select("track_id", "frame", "vec_id", *[
        F.when(F.col("vec_id") % 11 != 0, F.lit(250.0) + F.lit(1000.0) * F.element_at("embedding", 33 + j).cast("double")).alias(f"k_{c}") for j, c in enumerate("xy")])
    d = e.join(bind.rings(spark, sf).select(F.col("frame").alias("vec_id"), "pts"), "vec_id")
    return position.head_check(d, "k", max_dist=60).select("track_id", "frame", "k_x", "k_y")


# --- blobs and arenas -------------------------------------------------------------------------------------------------
BLOB_PARTS = PARTS[:7]
SQL_BLOBS = SQL_POSE + ", blobs AS (" + " UNION ALL ".join(
    f"SELECT track_id, frame, {i} AS blob, ({p}_l - 0.5) * 20000 AS area, CAST(FLOOR({p}_x) AS BIGINT) AS cx, CAST(FLOOR({p}_y) AS BIGINT) AS cy FROM pose WHERE {p}_l > 0.8" for i, p in enumerate(BLOB_PARTS)) + ")"
ARENA = (200, 200, 100, 180)


def blobs(spark, sf):
    """track_id, frame, blob, area, cx, cy: the clear parts of a pose as candidate blobs."""
    p = bind.pose(spark, sf, BLOB_PARTS)
    rows = F.array(*[F.struct(F.lit(i).alias("blob"), ((F.col(f"{q}_l") - 0.5) * 20000).alias("area"), F.floor(f"{q}_x").alias("cx"), F.floor(f"{q}_y").alias("cy"),
                              (F.col(f"{q}_l") > 0.8).alias("clear")) for i, q in enumerate(BLOB_PARTS)])
    return p.select("track_id", "frame", F.inline(rows)).where("clear").drop("clear")


@query("largest_blob", "R1 D11 T2", f"WITH {SQL_BLOBS}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY track_id, frame ORDER BY area DESC, blob) AS rn FROM blobs WHERE area > 0 AND area < 9500) SELECT track_id, frame, blob, area, cx, cy FROM r WHERE rn = 1", "area")
def _(spark, sf):
    return ring.largest_blob(blobs(spark, sf), limit=9500)


_X, _Y, _B, _A = ARENA
_IN = f"((cx BETWEEN {_X} AND {_X + _B} AND cy BETWEEN {_Y - _A} AND {_Y + _B + _A}) OR (cx BETWEEN {_X - _A} AND {_X + _B + _A} AND cy BETWEEN {_Y} AND {_Y + _B}))"
_ZONE = "CASE " + " ".join(f"WHEN cx BETWEEN {x0} AND {x1} AND cy BETWEEN {y0} AND {y1} THEN '{z}'" for z, x0, y0, x1, y1 in (
    ("Center", 200, 200, 300, 300), ("Closed_left", 20, 200, 200, 300), ("Closed_right", 300, 200, 480, 300), ("Open_up_near", 200, 100, 300, 200),
    ("Open_up_far", 200, 20, 300, 100), ("Open_down_near", 200, 300, 300, 400), ("Open_down_far", 200, 400, 300, 480))) + " END"


@query("zone_assign", "J8 P22 D10", f"WITH {SQL_BLOBS} SELECT track_id, frame, blob, {_ZONE} AS zone, {_IN} AS in_box FROM blobs")
def _(spark, sf):
    return blobs(spark, sf).select("track_id", "frame", "blob", arena.zone_of("cx", "cy", ARENA).alias("zone"), arena.in_arena("cx", "cy", ARENA).alias("in_box"))


@query("corner_exclusion", "P21", f"WITH {SQL_BLOBS} SELECT track_id, COUNT(CASE WHEN NOT (cx > 360 AND cy < 148) THEN 1 END) AS kept_right, COUNT(CASE WHEN NOT (cx < 110 AND cy < 154) THEN 1 END) AS kept_left FROM blobs GROUP BY 1")
def _(spark, sf):
    b = blobs(spark, sf)
    return b.groupBy("track_id").agg(F.count(F.when(arena.not_in_corner("cx", "cy", 360, 148), 1)).alias("kept_right"),
                                     F.count(F.when(arena.not_in_corner("cx", "cy", 110, 154, right=False), 1)).alias("kept_left"))


@query("crop_window", "P23", f"""WITH {SQL_BLOBS} SELECT track_id, frame, blob, CASE WHEN cx + 100 >= 500 THEN 300 WHEN cx - 100 < 0 THEN 0 ELSE cx - 100 END AS x0, CASE WHEN cx + 100 >= 500 THEN 500 WHEN cx - 100 < 0 THEN 200 ELSE cx + 100 END AS x1,
    CASE WHEN cy + 100 >= 500 THEN 300 WHEN cy - 100 < 0 THEN 0 ELSE cy - 100 END AS y0, CASE WHEN cy + 100 >= 500 THEN 500 WHEN cy - 100 < 0 THEN 200 ELSE cy + 100 END AS y1 FROM blobs""")
def _(spark, sf):
    (x0, x1), (y0, y1) = L.crop_bounds("cx", 500), L.crop_bounds("cy", 500)
    return blobs(spark, sf).select("track_id", "frame", "blob", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))


SQL_TRACKED = SQL_BLOBS + f""", pk AS (SELECT *, CASE WHEN {_IN} AND area > 7000 THEN 1 ELSE 0 END AS fit FROM blobs), rk AS (SELECT *, COUNT(*) OVER (PARTITION BY track_id, frame) AS n_blobs,
    ROW_NUMBER() OVER (PARTITION BY track_id, frame ORDER BY fit DESC, CASE WHEN fit = 1 THEN area END DESC NULLS LAST, blob) AS rn FROM pk),
    tr AS (SELECT p.track_id, p.frame, COALESCE(n_blobs, 0) AS n_blobs, blob, area, cx, cy, CASE WHEN blob IS NULL THEN FALSE ELSE {_IN} END AS in_box, {_ZONE} AS zone FROM (SELECT track_id, frame FROM pose) p LEFT JOIN (SELECT * FROM rk WHERE rn = 1) r USING (track_id, frame))"""


def tracked(spark, sf):
    f = bind.pose(spark, sf, ["A_head"]).select("track_id", "frame")
    return arena.track_blobs(f, blobs(spark, sf), ARENA, 7000)


@query("qc_counters", "A17 R1", f"""WITH {SQL_TRACKED} SELECT track_id, COUNT(*) AS frames, COUNT(CASE WHEN n_blobs = 0 THEN 1 END) AS no_contour, COUNT(CASE WHEN NOT in_box THEN 1 END) AS not_in_box, COUNT(CASE WHEN area < 7000 THEN 1 END) AS too_small,
    COUNT(CASE WHEN n_blobs > 1 THEN 1 END) AS multiple, 100.0 * COUNT(CASE WHEN n_blobs = 0 THEN 1 END) / COUNT(*) AS no_contour_pct FROM tr GROUP BY 1""", "no_contour_pct")
def _(spark, sf):
    from ..operators.rates import qc_counts

    q = qc_counts(tracked(spark, sf))
    return q.select("track_id", "frames", *[F.col(c).cast("long") for c in ("no_contour", "not_in_box", "too_small", "multiple")], "no_contour_pct")


@query("track_log_zones", "S8 J8", f"WITH {SQL_TRACKED} SELECT zone, COUNT(*) AS frames FROM tr WHERE in_box GROUP BY 1")
def _(spark, sf):
    return tracked(spark, sf).where("not_in_box = 0").groupBy("zone").agg(F.count(F.lit(1)).alias("frames"))


@query("steady_start", "W25", f"""WITH {SQL_TRACKED}, ca AS (SELECT *, in_box AND area > 7000 AND n_blobs < 7 AS ok FROM tr WHERE n_blobs > 0), cu AS (SELECT *, SUM(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame) AS c FROM ca),
    ba AS (SELECT *, MAX(CASE WHEN NOT ok THEN c END) OVER (PARTITION BY track_id ORDER BY frame) AS b FROM cu), po AS (SELECT *, c - COALESCE(b, -1) AS pos FROM ba)
    SELECT track_id, MIN(frame) AS start_frame FROM po WHERE ok AND pos >= 5 GROUP BY 1""")
def _(spark, sf):
    c = tracked(spark, sf).where("n_blobs > 0")
    ok = (F.col("not_in_box") == 0) & (F.col("area") > 7000) & (F.col("n_blobs") < 7)
    return intervals.first_steady_frame(c, ok, need=5)
