"""Queries over sources, sinks, unions and whole pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geom as G
from ..operators import features, fill
from ..sources import bind, tables
from ..sources.bind import SQL_BOUTS, SQL_EVENTS, SQL_GAPS, SQL_POSE, SQL_RINGS
from ..sources.schema import BOUTS, SIGNAL
from . import outline
from .pose import HEAD
from .registry import query
from .sqltext import H, L, MX, MY, R, VX, VY, acosd, angle, dist, div, over, side


@query("scan_file_identity", "S2 S10", "SELECT 'labels' AS fish, COUNT(*) AS rows, MAX(doc_id) AS last FROM labels UNION ALL SELECT 'documents', COUNT(*), MAX(doc_id) FROM documents")
def _(spark, sf):
    schema = T.StructType([T.StructField("doc_id", T.LongType())])
    d = tables.scan_named_files(spark, [f"{sf}/labels.parquet", f"{sf}/documents.parquet"], schema, r"^(\w+)\.parquet$", ["fish"])
    return d.groupBy("fish").agg(F.count(F.lit(1)).alias("rows"), F.max("doc_id").alias("last"))


@query("csv_roundtrip", "S4", f"WITH {SQL_EVENTS} SELECT track_id, frame, signal FROM tracks")
def _(spark, sf):
    path = tables.scratch_dir(spark)
    tables.write_csv(bind.event_tracks(spark, sf), path)
    return tables.read_csv(spark, path, SIGNAL)


@query("bout_sheets", "S5 D7", f"WITH {SQL_BOUTS} SELECT track_id, behaviour, start, stop FROM bouts")
def _(spark, sf):
    path = tables.scratch_dir(spark)
    tables.write_results(bind.bouts(spark, sf), path, by=("behaviour",))
    return tables.scan_tracks(spark, path, BOUTS)


@query("result_export", "S6 S10", f"WITH {SQL_POSE} SELECT track_id, COUNT(*) AS frames, AVG({H}_x) AS x FROM pose GROUP BY 1", "x")
def _(spark, sf):
    path = tables.scratch_dir(spark)
    tables.write_results(bind.pose(spark, sf, ["A_head"]).withColumn("fish", F.col("track_id")), path, by=("fish",))
    return spark.read.parquet(path).groupBy("track_id").agg(F.count(F.lit(1)).alias("frames"), F.avg("A_head_x").alias("x"))


@query("artefact_store", "S7 D5", f"WITH {SQL_RINGS} SELECT track_id, frame, COUNT(*) AS points, SUM(x) AS sx, SUM(y) AS sy FROM ring GROUP BY 1, 2", "sx:5 sy:5")
def _(spark, sf):
    path = tables.scratch_dir(spark)
    tables.write_results(bind.rings(spark, sf).withColumn("fish", F.col("track_id")), path, by=("fish",))
    total = lambda c: F.expr(f"aggregate(pts, 0D, (a, p) -> a + p.{c})")
    return spark.read.parquet(path).select("track_id", "frame", F.size("pts").cast("long").alias("points"), total("x").alias("sx"), total("y").alias("sy"))


@query("track_log", "S8", f"WITH {outline.SQL_TRACKED} SELECT frame, cx, cy, zone FROM tr WHERE in_box")
def _(spark, sf):
    path = tables.scratch_dir(spark)
    tables.write_track_log(outline.tracked(spark, sf).where("not_in_box = 0").select("frame", "cx", "cy", "zone"), path)
    return spark.read.csv(path, sep="\t", schema="frame long, cx long, cy long, zone string")


@query("feature_concat", "S9 J2", f"""WITH {SQL_POSE}, o AS (SELECT track_id, frame, {dist(H, R)} AS hr, {dist(H, L)} AS hl, {dist(R, L)} AS rl FROM pose), v AS (SELECT track_id, frame, {VX} AS vx, {VY} AS vy, {H}_x AS x FROM pose)
    SELECT o.track_id, o.frame, {side('hr', 'hl', 'rl')} AS operculum, {acosd(div('vx', 'SQRT(vx*vx+vy*vy)'))} AS orientation, x AS x_position, SQRT(vx*vx+vy*vy) AS head_length FROM o JOIN v USING (track_id, frame)""",
       "operculum orientation x_position head_length")
def _(spark, sf):
    p = bind.pose(spark, sf, HEAD)
    vx, vy = G.head_vector()
    return tables.concat_features(
        p.select("track_id", "frame", G.operculum_angle().alias("operculum")), p.select("track_id", "frame", G.orientation_degrees(vx, vy).alias("orientation")),
        p.select("track_id", "frame", F.col("A_head_x").alias("x_position")), p.select("track_id", "frame", F.sqrt(vx * vx + vy * vy).alias("head_length")))


_AX = "OVER (ORDER BY axis ROWS BETWEEN"


@query("feature_concat_outer", "J2", f"""WITH {SQL_EVENTS}, a AS (SELECT track_id, frame, signal AS a FROM tracks WHERE frame % 3 <> 0), b AS (SELECT track_id, frame, signal * 2 AS b FROM tracks WHERE frame % 2 = 0)
    SELECT COALESCE(a.track_id, b.track_id) AS track_id, COALESCE(a.frame, b.frame) AS frame, a.a, b.b FROM a FULL JOIN b ON a.track_id = b.track_id AND a.frame = b.frame""")
def _(spark, sf):
    t = bind.event_tracks(spark, sf)
    a = t.where("frame % 3 <> 0").select("track_id", "frame", F.col("signal").alias("a"))
    b = t.where("frame % 2 = 0").select("track_id", "frame", (F.col("signal") * 2).alias("b"))
    return tables.concat_features(a, b, how="outer").select("track_id", "frame", "a", "b")


@query("interp_bridged", "W12 U1", f"""WITH {SQL_GAPS}, n AS (SELECT track_id, MAX(frame) + 1 AS n FROM gaps GROUP BY 1), s AS (SELECT track_id, n, CAST(COALESCE(SUM(n + 100) OVER (ORDER BY track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s0 FROM n),
    a AS (SELECT g.track_id, g.frame, s0 + g.frame AS axis, g.signal FROM gaps g JOIN s USING (track_id) UNION ALL SELECT NULL, NULL, s0 + n + k, NULL FROM s, (SELECT UNNEST(generate_series(0, 99)) AS k) k),
    b AS (SELECT *, LAST_VALUE(signal IGNORE NULLS) {_AX} UNBOUNDED PRECEDING AND CURRENT ROW) AS pv, FIRST_VALUE(signal IGNORE NULLS) {_AX} CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
        LAST_VALUE(CASE WHEN signal IS NOT NULL THEN axis END IGNORE NULLS) {_AX} UNBOUNDED PRECEDING AND CURRENT ROW) AS pf, FIRST_VALUE(CASE WHEN signal IS NOT NULL THEN axis END IGNORE NULLS) {_AX} CURRENT ROW AND UNBOUNDED FOLLOWING) AS nf FROM a)
    SELECT axis, track_id, frame, CASE WHEN signal IS NOT NULL THEN signal WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) / (nf - pf) * (axis - pf) END AS signal FROM b""", "signal")
def _(spark, sf):
    b = fill.bridge_tracks(bind.gap_tracks(spark, sf))
    return fill.interpolate_bridged(b, "signal").select("axis", "track_id", "frame", "signal")


@query("label_union", "U2 U4", "SELECT quality AS label, COUNT(*) AS rows FROM labels GROUP BY 1 UNION ALL SELECT 10 + toxic, COUNT(*) FROM labels GROUP BY 1")
def _(spark, sf):
    lb = bind.table(spark, sf, "labels")
    u = lb.select(F.col("quality").alias("label")).union(lb.select((F.col("toxic") + 10).alias("label")))
    return u.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


@query("unused_labels", "U3", "SELECT DISTINCT user_id AS track_id FROM events EXCEPT SELECT user_id FROM events WHERE value > 200")
def _(spark, sf):
    e = bind.table(spark, sf, "events").select(F.col("user_id").alias("track_id"), "value")
    return e.select("track_id").distinct().exceptAll(e.where("value > 200").select("track_id").distinct())


@query("popular_labels", "J5", "SELECT event_id, event_type FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 HAVING COUNT(*) > (SELECT COUNT(*) / 5.0 FROM events))")
def _(spark, sf):
    e = bind.table(spark, sf, "events").select("event_id", "event_type")
    counts = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    popular = counts.join(F.broadcast(total), F.col("n") > F.col("total") / 5)  # one row
    return e.join(popular, "event_type", "left_semi").select("event_id", "event_type")


@query("top_bouts", "T3 T1", f"WITH {SQL_BOUTS}, r AS (SELECT track_id, start, stop - start AS length, ROW_NUMBER() OVER (PARTITION BY track_id ORDER BY stop - start DESC, start) AS rank FROM bouts) SELECT track_id, start, length, rank FROM r WHERE rank <= 2")
def _(spark, sf):
    from ..operators.select import top_k

    b = bind.bouts(spark, sf).select("track_id", "start", (F.col("stop") - F.col("start")).alias("length"))
    return top_k(b, ("track_id",), "length", "start", 2).select("track_id", "start", "length", "rank")


_M12X, _M12Y = "(F_spine1_x-mx2)", "(F_spine1_y-my2)"
_DX, _DY = (f"(LAG(A_head_{c}, 10) {over()} - A_head_{c})" for c in "xy")
_FF = over("UNBOUNDED PRECEDING AND CURRENT ROW")


@query("feature_other_group", "X5 D6 C14 W11 S10", f"""WITH {SQL_POSE}, b AS (SELECT *, (F_spine1_x+G_spine2_x)/2 AS mx2, (F_spine1_y+G_spine2_y)/2 AS my2, {dist(H, R)} AS hr, {dist(H, L)} AS hl, {dist(R, L)} AS rl, {VX} AS vx, {VY} AS vy FROM pose),
    t AS (SELECT *, {_M12X} AS sx, {_M12Y} AS sy, LAG({_M12X}, 40) {over()} AS px, LAG({_M12Y}, 40) {over()} AS py FROM b),
    f AS (SELECT track_id, frame, {side('hr', 'hl', 'rl')} AS operculum, {acosd(div('vx', 'SQRT(vx*vx+vy*vy)'))} AS orientation, SQRT({_DX}*{_DX}+{_DY}*{_DY}) / 0.25 AS movement_speed, {angle('sx', 'sy', 'px', 'py')} AS turning_angle FROM t),
    st AS (SELECT track_id, {', '.join(f'AVG({c}) AS a_{c}, STDDEV_POP({c}) AS s_{c}' for c in features.OTHER)} FROM f GROUP BY 1),
    k AS (SELECT f.track_id, frame, {', '.join(f'CASE WHEN ABS({c} - a_{c}) > 3 * s_{c} THEN NULL ELSE {c} END AS {c}' for c in features.OTHER)} FROM f JOIN st ON f.track_id = st.track_id),
    m AS (SELECT track_id, {', '.join(f'AVG({c}) AS m_{c}' for c in features.OTHER)} FROM k GROUP BY 1)
    SELECT k.track_id, frame, {', '.join(f"COALESCE(LAST_VALUE({c} IGNORE NULLS) {_FF.replace('track_id', 'k.track_id')}, m_{c}) AS {c}" for c in features.OTHER)} FROM k JOIN m ON k.track_id = m.track_id""", " ".join(features.OTHER))
def _(spark, sf):
    from ..operators.clean import add_mid_spine, sigma_filter

    p = add_mid_spine(bind.pose(spark, sf, [*HEAD, "F_spine1", "G_spine2", "H_spine3"]))
    f = features.other_features(p).select("track_id", "frame", "_chunk", *features.OTHER)
    return fill.fill_mean(sigma_filter(f, features.OTHER), features.OTHER).select("track_id", "frame", *features.OTHER)


@query("feature_export", "X5 X4 C11 C15 V1 W2 S9")
def _(spark, sf):
    return features.feature_table(bind.pose(spark, sf), "full", likelihood=0.6, jump_head=400, jump_tail=400, head_dist=300, gill_dist=300, angle=170)
