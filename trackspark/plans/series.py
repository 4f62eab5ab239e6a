"""Queries over single signals: differences, fills, windows, crossings, rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import label as L
from ..operators import fill, rates, series, smooth
from ..operators.chunk import scan, windowed
from ..sources import bind
from ..sources.bind import SQL_EVENTS, SQL_GAPS, SQL_LINES
from .registry import query

W = "OVER (PARTITION BY track_id ORDER BY frame)"


def over(rows: str) -> str:
    return f"OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN {rows})"


# --- flagship: jump null, forward fill, band, rate per loop -------------------------------------------------------
LOOP = 20
SQL_FILLED = SQL_GAPS + f", filled AS (SELECT track_id, frame, LAST_VALUE(signal IGNORE NULLS) {over('UNBOUNDED PRECEDING AND CURRENT ROW')} AS signal FROM gaps)"


@query("band_rate_per_loop", "S1 C1 W8 P6 A1 A5", f"""WITH {SQL_FILLED}
    SELECT track_id, CAST(frame // {LOOP} AS BIGINT) AS loop_id,
           AVG(CASE WHEN signal > 20 AND signal < 80 THEN 1 ELSE 0 END) AS rate
    FROM filled GROUP BY 1, 2 HAVING COUNT(*) = {LOOP}""", "rate")
def _(spark, sf):
    filled = fill.fill_forward(bind.gap_tracks(spark, sf), ["signal"])
    return rates.loop_rates(filled, L.in_band("signal", 20, 80), LOOP)


@query("band_rate_per_track", "P6 A1", f"""WITH {SQL_EVENTS} SELECT track_id,
    AVG(CASE WHEN signal > 20 AND signal < 80 THEN 1 ELSE 0 END) AS fraction, COUNT(*) AS frames FROM tracks GROUP BY 1""", "fraction")
def _(spark, sf):
    # needs no frame order, so no numbering
    e = bind.table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("track_id")).agg(
        F.avg(L.in_band("value", 20, 80)).alias("fraction"), F.count(F.lit(1)).alias("frames"))


@query("track_scan", "S1 D1", f"WITH {SQL_EVENTS} SELECT track_id, frame, signal FROM tracks")
def _(spark, sf):
    from ..sources.schema import SIGNAL, check_schema

    return check_schema(bind.event_tracks(spark, sf), SIGNAL)


@query("jump_null_ffill", "C1 W1 W8", f"WITH {SQL_FILLED} SELECT * FROM filled")
def _(spark, sf):
    return fill.fill_forward(bind.gap_tracks(spark, sf), ["signal"]).select("track_id", "frame", "signal")


# --- fills --------------------------------------------------------------------------------------------------------
FWD, BWD = over("UNBOUNDED PRECEDING AND CURRENT ROW"), over("CURRENT ROW AND UNBOUNDED FOLLOWING")


@query("fill_backward", "W9", f"WITH {SQL_GAPS} SELECT track_id, frame, FIRST_VALUE(signal IGNORE NULLS) {BWD} AS signal FROM gaps")
def _(spark, sf):
    return fill.fill_backward(bind.gap_tracks(spark, sf), ["signal"]).select("track_id", "frame", "signal")


@query("fill_both", "W10", f"""WITH {SQL_GAPS}, holes AS (SELECT track_id, frame, CASE WHEN frame < 3 OR frame % 7 = 3 THEN NULL ELSE signal END AS signal FROM gaps),
    n AS (SELECT track_id, frame, LAST_VALUE(signal IGNORE NULLS) {FWD} AS f, FIRST_VALUE(signal IGNORE NULLS) {BWD} AS b FROM holes)
    SELECT track_id, frame, COALESCE(f, b) AS forward_first, COALESCE(b, f) AS backward_first FROM n""")
def _(spark, sf):
    # leading and inner gaps, which the jump rule alone does not make
    g = bind.gap_tracks(spark, sf)
    g = g.withColumn("signal", F.when((F.col("frame") < 3) | (F.col("frame") % 7 == 3), None).otherwise(F.col("signal")))
    s = scan(g, {"f": ("last", F.col("signal")), "b": ("next", F.col("signal"))})
    return s.select("track_id", "frame", F.coalesce("f", "b").alias("forward_first"), F.coalesce("b", "f").alias("backward_first"))


@query("fill_mean", "W11", f"""WITH {SQL_GAPS}, holes AS (SELECT track_id, frame, CASE WHEN frame < 3 THEN NULL ELSE signal END AS signal FROM gaps),
    n AS (SELECT track_id, frame, signal, LAST_VALUE(signal IGNORE NULLS) {FWD} AS f FROM holes),
    m AS (SELECT track_id, AVG(signal) AS before_mean, AVG(f) AS after_mean FROM n GROUP BY 1)
    SELECT track_id, frame, COALESCE(f, before_mean) AS mean_before, COALESCE(f, after_mean) AS mean_after FROM n JOIN m USING (track_id)""",
       "mean_before mean_after")
def _(spark, sf):
    g = bind.gap_tracks(spark, sf)
    g = g.withColumn("mean_before", F.when(F.col("frame") >= 3, F.col("signal"))).withColumn("mean_after", F.col("mean_before"))
    return fill.fill_mean(g, ["mean_before", "mean_after"], late=["mean_after"]).select("track_id", "frame", "mean_before", "mean_after")


NEIGHBOURS = f"""nb AS (SELECT track_id, frame, signal,
    LAST_VALUE(signal IGNORE NULLS) {FWD} AS pv, FIRST_VALUE(signal IGNORE NULLS) {BWD} AS nv,
    LAST_VALUE(CASE WHEN signal IS NOT NULL THEN frame END IGNORE NULLS) {FWD} AS pf,
    FIRST_VALUE(CASE WHEN signal IS NOT NULL THEN frame END IGNORE NULLS) {BWD} AS nf FROM gaps)"""


@query("interp_linear", "W12", f"""WITH {SQL_GAPS}, {NEIGHBOURS} SELECT track_id, frame,
    CASE WHEN signal IS NOT NULL THEN signal WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) / (nf - pf) * (frame - pf) END AS signal FROM nb""", "signal")
def _(spark, sf):
    return fill.interpolate_linear(bind.gap_tracks(spark, sf), "signal").select("track_id", "frame", "signal")


@query("interp_nearest", "W13", f"""WITH {SQL_GAPS}, {NEIGHBOURS} SELECT track_id, frame,
    CASE WHEN signal IS NOT NULL THEN signal WHEN nv IS NULL OR pv IS NULL THEN NULL WHEN frame - pf <= nf - frame THEN pv ELSE nv END AS signal FROM nb""")
def _(spark, sf):
    return fill.interpolate_nearest(bind.gap_tracks(spark, sf), "signal").select("track_id", "frame", "signal")


# --- differences and speeds -----------------------------------------------------------------------------------------
@query("diff_prepend", "W1 W2", f"""WITH {SQL_EVENTS} SELECT track_id, frame, signal - LAG(signal) {W} AS diff,
    COALESCE(signal - LAG(signal) {W}, 0.0) AS diff0 FROM tracks""", "diff diff0")
def _(spark, sf):
    return windowed(bind.event_tracks(spark, sf), lambda w: {
        "diff": F.col("signal") - F.lag("signal").over(w),
        "diff0": F.coalesce(F.col("signal") - F.lag("signal").over(w), F.lit(0.0)),
    }, before=1).select("track_id", "frame", "diff", "diff0")


@query("diff_forward", "W3", f"WITH {SQL_EVENTS} SELECT track_id, frame, LEAD(signal) {W} - signal AS diff FROM tracks", "diff")
def _(spark, sf):
    return series.forward_diff(bind.event_tracks(spark, sf), "signal").select("track_id", "frame", "diff")


@query("opening_speed", "W6 W7", f"""WITH {SQL_GAPS}, b AS (SELECT track_id, frame, signal, FIRST_VALUE(signal IGNORE NULLS) {BWD} AS filled FROM gaps)
    SELECT track_id, frame, ABS(filled - LAG(filled) {W}) / 0.025 AS backward, ABS(LEAD(signal) {W} - signal) / 0.025 AS forward FROM b""",
       "backward forward")
def _(spark, sf):
    g = scan(bind.gap_tracks(spark, sf), {"filled": ("next", F.col("signal"))})
    return windowed(g, lambda w: {
        "backward": F.abs(F.col("filled") - F.lag("filled").over(w)) / F.lit(1 / 40),
        "forward": F.abs(F.lead("signal").over(w) - F.col("signal")) / F.lit(1 / 40),
    }, before=1, after=1).select("track_id", "frame", "backward", "forward")


# --- bounded windows ------------------------------------------------------------------------------------------------
@query("local_max_pm20", "W14", f"""WITH {SQL_GAPS}, m AS (SELECT track_id, frame, LEAD(1) {W} IS NULL AS is_last, signal FROM gaps)
    SELECT track_id, frame, MAX(CASE WHEN NOT is_last THEN signal END) {over('20 PRECEDING AND 19 FOLLOWING')} AS local_max,
    CASE WHEN COUNT(CASE WHEN NOT is_last AND signal IS NULL THEN 1 END) {over('20 PRECEDING AND 19 FOLLOWING')} = 0
    THEN MAX(CASE WHEN NOT is_last THEN signal END) {over('20 PRECEDING AND 19 FOLLOWING')} END AS strict_max FROM m""")
def _(spark, sf):
    g = series.local_max(bind.gap_tracks(spark, sf), "signal", 20)
    return series.local_max(g, "signal", 20, out="strict_max", skip_nulls=False).select("track_id", "frame", "local_max", "strict_max")


@query("rolling_mean3", "W15", f"""WITH {SQL_GAPS} SELECT track_id, frame,
    CASE WHEN COUNT(signal) {over('2 PRECEDING AND CURRENT ROW')} = 3 THEN AVG(signal) {over('2 PRECEDING AND CURRENT ROW')} END AS mean FROM gaps""", "mean")
def _(spark, sf):
    return series.rolling_mean(bind.gap_tracks(spark, sf), "signal").select("track_id", "frame", "mean")


@query("shift40", "W16", f"WITH {SQL_LINES} SELECT track_id, frame, LAG(signal, 40) {W} AS earlier, LEAD(signal, 40) {W} AS later FROM lines")
def _(spark, sf):
    return windowed(bind.line_tracks(spark, sf), lambda w: {"earlier": F.lag("signal", 40).over(w), "later": F.lead("signal", 40).over(w)},
                    before=40, after=40).select("track_id", "frame", "earlier", "later")


SQL_SMOOTH = SQL_LINES + f", smooth AS (SELECT track_id, frame, ROUND(AVG(signal) {over('11 PRECEDING AND CURRENT ROW')}, 6) AS signal FROM lines)"

for _side in ("down", "up"):
    _past, _ahead = over("7 PRECEDING AND 1 PRECEDING"), over("CURRENT ROW AND 7 FOLLOWING")
    _test = f"MIN(signal) {_past} > 25 AND MAX(signal) {_ahead} < 25" if _side == "down" else f"MAX(signal) {_past} < 25 AND MIN(signal) {_ahead} > 25"

    @query(f"crossing_{_side}", "W19", f"""WITH {SQL_SMOOTH}, c AS (SELECT track_id, frame, signal,
        COUNT(signal) {_past} = 7 AND COUNT(signal) {_ahead} = 8 AND {_test} AS hit FROM smooth) SELECT track_id, frame, signal FROM c WHERE hit""", "signal")
    def _(spark, sf, side=_side):
        smooth = windowed(bind.line_tracks(spark, sf), lambda w: {"signal": F.round(F.avg("signal").over(w.rowsBetween(-11, 0)), 6)}, before=11)
        return series.crossings(smooth, "signal", 25, side).select("track_id", "frame", "signal")


@query("dilate10", "W20", f"""WITH {SQL_EVENTS}, b AS (SELECT track_id, frame, CASE WHEN signal > 150 THEN 1 ELSE 0 END AS hit FROM tracks)
    SELECT track_id, frame, MAX(hit) {over('4 PRECEDING AND 5 FOLLOWING')} AS d10, MAX(hit) {over('19 PRECEDING AND 20 FOLLOWING')} AS d40 FROM b""")
def _(spark, sf):
    b = bind.event_tracks(spark, sf).withColumn("hit", L.above("signal", 150))
    return windowed(b, lambda w: {"d10": F.max("hit").over(w.rowsBetween(-4, 5)).cast("int"),
                                  "d40": F.max("hit").over(w.rowsBetween(-19, 20)).cast("int")},
                    before=19, after=20).select("track_id", "frame", "d10", "d40")


@query("threshold_frames", "P7", f"WITH {SQL_EVENTS} SELECT track_id, frame FROM tracks WHERE signal > 140")
def _(spark, sf):
    return bind.event_tracks(spark, sf).where("signal > 140").select("track_id", "frame")


@query("smooth_signal", "W27", f"""WITH {SQL_GAPS}, p AS (
    SELECT a.track_id, a.frame, CAST(b.frame - a.frame AS DOUBLE) AS t, b.signal AS v
    FROM gaps a JOIN gaps b ON a.track_id = b.track_id AND b.frame BETWEEN a.frame - 10 AND a.frame + 10 WHERE b.signal IS NOT NULL),
    s AS (SELECT track_id, frame, COUNT(*) AS s0, SUM(t) AS s1, SUM(t*t) AS s2, SUM(t*t*t) AS s3, SUM(t*t*t*t) AS s4,
                 SUM(v) AS m0, SUM(v*t) AS m1, SUM(v*t*t) AS m2 FROM p GROUP BY 1, 2)
    SELECT gaps.track_id, gaps.frame, CASE WHEN s0 >= 3 THEN (m0*(s2*s4-s3*s3) - s1*(m1*s4-m2*s3) + s2*(m1*s3-m2*s2))
        / NULLIF(s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2), 0) END AS smooth FROM gaps LEFT JOIN s USING (track_id, frame)""", "smooth:5")
def _(spark, sf):
    return series.smooth_quadratic(bind.gap_tracks(spark, sf), "signal").select("track_id", "frame", "smooth")


#: Smoothing by a band factorisation that walks from point to point, instead of the library's cyclic reduction.
SQL_SPLINE = f"""WITH RECURSIVE {SQL_GAPS}, pts AS (SELECT track_id, frame, CAST(signal AS DOUBLE) AS y, ROW_NUMBER() OVER (PARTITION BY track_id ORDER BY frame) AS i FROM gaps WHERE signal IS NOT NULL),
    dd AS (SELECT *, 1.0 / (frame - LAG(frame) OVER w) AS q0, 1.0 / (LEAD(frame) OVER w - frame) AS q2, LAG(y) OVER w AS y0, LEAD(y) OVER w AS y2 FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY i)),
    qq AS (SELECT track_id, i, q0, -q0 - q2 AS q1, q2, q0*y0 - (q0 + q2)*y + q2*y2 AS f FROM dd WHERE q0 IS NOT NULL AND q2 IS NOT NULL),
    ee AS (SELECT track_id, i, f, (1/q0 + 1/q2) / 3 + 100 * (q0*q0 + q1*q1 + q2*q2) AS a, COALESCE(1/q2 / 6 + 100 * (q1 * LEAD(q0) OVER w + q2 * LEAD(q1) OVER w), 0) AS b, COALESCE(100 * q2 * LEAD(q0, 2) OVER w, 0) AS c
        FROM qq WINDOW w AS (PARTITION BY track_id ORDER BY i)),
    down(track_id, i, d, l, m, z, dp, lp, mp, zp) AS (SELECT track_id, i, a, b / a, c / a, f, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM ee WHERE i = 2
        UNION ALL SELECT ee.track_id, ee.i, ee.a - d*l*l - dp*mp*mp AS nd, (ee.b - d*l*m) / nd, ee.c / nd, ee.f - l*z - mp*zp, d, l, m, z FROM down JOIN ee ON ee.track_id = down.track_id AND ee.i = down.i + 1),
    solved AS (SELECT track_id, i, z / d AS v, l, m, MAX(i) OVER (PARTITION BY track_id) AS n FROM down),
    up(track_id, i, x, xn) AS (SELECT track_id, i, v, CAST(0 AS DOUBLE) FROM solved WHERE i = n
        UNION ALL SELECT s.track_id, s.i, s.v - s.l * x - s.m * xn, x FROM up JOIN solved s ON s.track_id = up.track_id AND s.i = up.i - 1),
    bent AS (SELECT track_id, i + k - 1 AS i, SUM(x * CASE k WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END) AS off FROM up JOIN qq USING (track_id, i), (SELECT UNNEST([0, 1, 2]) AS k) GROUP BY 1, 2),
    curve AS (SELECT pts.track_id, pts.frame, y - 100 * COALESCE(off, 0) AS g, COALESCE(x, 0) AS s FROM pts LEFT JOIN bent USING (track_id, i) LEFT JOIN up USING (track_id, i)),
    near AS (SELECT gaps.track_id, gaps.frame, g, LAST_VALUE(CASE WHEN g IS NOT NULL THEN gaps.frame END IGNORE NULLS) OVER p AS ta, LAST_VALUE(g IGNORE NULLS) OVER p AS ga, LAST_VALUE(s IGNORE NULLS) OVER p AS sa,
        FIRST_VALUE(CASE WHEN g IS NOT NULL THEN gaps.frame END IGNORE NULLS) OVER n AS tb, FIRST_VALUE(g IGNORE NULLS) OVER n AS gb, FIRST_VALUE(s IGNORE NULLS) OVER n AS sb FROM gaps LEFT JOIN curve USING (track_id, frame)
        WINDOW p AS (PARTITION BY gaps.track_id ORDER BY gaps.frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY gaps.track_id ORDER BY gaps.frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT track_id, frame, CASE WHEN g IS NOT NULL THEN g WHEN tb > ta THEN ((tb-frame)*ga + (frame-ta)*gb) / (tb-ta)
        - (frame-ta)*(tb-frame) / 6.0 * ((1 + (frame-ta) / CAST(tb-ta AS DOUBLE)) * sb + (1 + (tb-frame) / CAST(tb-ta AS DOUBLE)) * sa) END AS smooth FROM near"""


@query("smoothing_spline", "W27", SQL_SPLINE, "smooth")
def _(spark, sf):
    return smooth.smoothing_spline(bind.gap_tracks(spark, sf), "signal", penalty=100.0).select("track_id", "frame", "smooth")


@query("smoothing_spline_target", "W27")
def _(spark, sf):
    return smooth.smoothing_spline(bind.gap_tracks(spark, sf), "signal", residual=400.0).select("track_id", "frame", "smooth")


# --- projections, filters --------------------------------------------------------------------------------------------
@query("frame_slice", "P1 P2 P3", f"""WITH {SQL_LINES} SELECT track_id, frame, frame - 40 AS new_frame,
    CAST(frame / 40.0 AS DOUBLE) AS second, signal FROM lines WHERE frame >= 40 AND frame < 40 + 40 * 5""", "second")
def _(spark, sf):
    from ..operators.select import duration_window, renumber

    s = duration_window(bind.line_tracks(spark, sf), start=40, seconds=5)
    return renumber(s, 40).select("track_id", "frame", "new_frame", (F.col("frame") / F.lit(40.0)).alias("second"), "signal")


@query("downsample20", "P4", f"WITH {SQL_LINES} SELECT track_id, frame, signal FROM lines WHERE frame >= 100 AND (frame - 100) % 20 = 0")
def _(spark, sf):
    from ..operators.select import every

    return every(bind.line_tracks(spark, sf).where("frame >= 100"), 20, start=100).select("track_id", "frame", "signal")


@query("threshold_two_sided", "P5 P6 X1", f"""WITH {SQL_GAPS} SELECT track_id, frame,
    CASE WHEN signal > 65 AND signal < 135.56 THEN 1 ELSE 0 END AS ts1, CASE WHEN signal > 0 AND signal < 100 THEN 1 ELSE 0 END AS band FROM gaps""")
def _(spark, sf):
    return bind.gap_tracks(spark, sf).select("track_id", "frame", L.in_band("signal", 65, 135.56).cast("int").alias("ts1"),
                                             L.in_band("signal", 0, 100).cast("int").alias("band"))


@query("drop_null_rows", "P10 P11", f"""WITH {SQL_GAPS}, kept AS (SELECT * FROM gaps WHERE signal IS NOT NULL) SELECT track_id, COUNT(*) AS frames, SUM(signal) AS total FROM kept GROUP BY 1""", "total")
def _(spark, sf):
    g = bind.gap_tracks(spark, sf).na.drop("any", subset=["signal"])
    return g.groupBy("track_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("signal").alias("total"))


@query("clip_signal", "P12", f"""WITH {SQL_EVENTS}, m AS (SELECT track_id, AVG(signal) AS a, STDDEV_POP(signal) AS s FROM tracks GROUP BY 1)
    SELECT track_id, frame, LEAST(GREATEST((signal - a) / NULLIF(s, 0), -2), 2) AS z FROM tracks JOIN m USING (track_id)""", "z")
def _(spark, sf):
    t = bind.event_tracks(spark, sf)
    m = bind.table(spark, sf, "events").groupBy(F.col("user_id").alias("track_id")).agg(F.avg("value").alias("a"), F.stddev_pop("value").alias("s"))
    return t.join(m, "track_id").select("track_id", "frame", L.clip(F.try_divide(F.col("signal") - F.col("a"), F.col("s")), -2.0, 2.0).alias("z"))


@query("three_sigma", "C14", f"""WITH {SQL_EVENTS}, m AS (SELECT track_id, AVG(signal) AS a, STDDEV_POP(signal) AS s FROM tracks GROUP BY 1)
    SELECT track_id, frame, CASE WHEN ABS(signal - a) > 3 * s THEN NULL ELSE signal END AS signal FROM tracks JOIN m USING (track_id)""")
def _(spark, sf):
    from ..operators.clean import sigma_filter

    return sigma_filter(bind.event_tracks(spark, sf), ["signal"]).select("track_id", "frame", "signal")


@query("frame_clock", "P24", f"""WITH {SQL_LINES} SELECT track_id, frame, CAST(FLOOR(frame / 40.0 / 60) AS BIGINT) AS minute,
    frame / 40.0 - 60 * FLOOR(frame / 40.0 / 60) AS second FROM lines""", "second")
def _(spark, sf):
    from ..operators.select import clock

    return clock(bind.line_tracks(spark, sf)).select("track_id", "frame", "minute", "second")


@query("column_subset", "P15", f"WITH {SQL_LINES} SELECT track_id, frame, signal AS quantity, l_tax AS tax FROM lines")
def _(spark, sf):
    t = bind.line_tracks(spark, sf, "l_discount", "l_tax").drop("l_discount")
    return t.withColumnRenamed("signal", "quantity").withColumnRenamed("l_tax", "tax").select("track_id", "frame", "quantity", "tax")


@query("positional_split", "P20", f"""WITH {SQL_LINES}, r AS (SELECT *, DENSE_RANK() OVER (ORDER BY track_id) AS pos FROM lines), n AS (SELECT COUNT(DISTINCT track_id) AS k FROM lines)
    SELECT CASE WHEN pos <= 0.75 * k THEN 'train' ELSE 'test' END AS part, CASE WHEN frame < 400 THEN 'early' ELSE 'late' END AS half,
    COUNT(*) AS frames, AVG(signal) AS mean FROM r, n GROUP BY 1, 2""", "mean")
def _(spark, sf):
    from ..operators.select import split_tracks

    s = split_tracks(bind.line_tracks(spark, sf), 0.75)
    return s.withColumn("half", F.when(F.col("frame") < 400, "early").otherwise("late")).groupBy("part", "half").agg(
        F.count(F.lit(1)).alias("frames"), F.avg("signal").alias("mean"))


# --- rates -----------------------------------------------------------------------------------------------------------
SQL_RATES = SQL_EVENTS + f""", rates AS (SELECT track_id, CAST(frame // {LOOP} AS BIGINT) AS loop_id,
    AVG(CASE WHEN signal > 20 AND signal < 80 THEN 1 ELSE 0 END) AS rate FROM tracks GROUP BY 1, 2 HAVING COUNT(*) = {LOOP})"""


@query("loop_rates", "A5", f"WITH {SQL_RATES} SELECT * FROM rates", "rate")
def _(spark, sf):
    return rates.loop_rates(bind.event_tracks(spark, sf), L.in_band("signal", 20, 80), LOOP)


def _coded_rates(spark, sf):
    r = rates.loop_rates(bind.event_tracks(spark, sf), L.in_band("signal", 20, 80), LOOP)
    codes = r.select("loop_id").distinct().withColumn("code", F.expr("2 + loop_id % 3"))
    return r.join(codes, "loop_id")


@query("stimulus_means", "J9 A6 D9", f"""WITH {SQL_RATES}, codes AS (SELECT DISTINCT loop_id, 2 + loop_id % 3 AS code FROM rates)
    SELECT track_id, code, AVG(rate) AS rate FROM rates JOIN codes USING (loop_id) GROUP BY 1, 2""", "rate")
def _(spark, sf):
    return _coded_rates(spark, sf).groupBy("track_id", "code").agg(F.avg("rate").alias("rate"))


@query("preference_index", "A6", f"""WITH {SQL_RATES}, m AS (SELECT track_id, AVG(CASE WHEN loop_id % 3 = 0 THEN rate END) AS rate_2,
    AVG(CASE WHEN loop_id % 3 = 1 THEN rate END) AS rate_3, AVG(CASE WHEN loop_id % 3 = 2 THEN rate END) AS rate_4 FROM rates GROUP BY 1)
    SELECT *, (rate_2 - rate_3) / NULLIF(rate_2 + rate_3, 0) AS preference FROM m""", "rate_2 rate_3 rate_4 preference")
def _(spark, sf):
    return rates.stimulus_index(_coded_rates(spark, sf))


@query("period_change", "A7", f"""WITH {SQL_EVENTS} SELECT track_id, {', '.join(
    f"AVG(CASE WHEN frame >= 30 THEN CASE WHEN {c} THEN 1 ELSE 0 END END) - AVG(CASE WHEN frame < 30 THEN CASE WHEN {c} THEN 1 ELSE 0 END END) AS {n}"
    for n, c in [('open', 'signal > 65 AND signal < 135'), ('near', 'signal > 0 AND signal < 100'), ('turned', 'signal > 90 AND signal < 180'),
                 ('fast', 'signal > 150'), ('clicks', "event_type = 'click'")])} FROM tracks GROUP BY 1""", "open near turned fast clicks")
def _(spark, sf):
    t = bind.event_tracks(spark, sf, "event_type")
    return rates.period_change(t, {
        "open": L.in_band("signal", 65, 135), "near": L.in_band("signal", 0, 100), "turned": L.in_band("signal", 90, 180),
        "fast": L.above("signal", 150), "clicks": (F.col("event_type") == "click").cast("int"),
    }, F.col("frame") >= 30)


@query("bin_means10", "A8", f"WITH {SQL_LINES} SELECT track_id, CAST(frame // 10 AS BIGINT) AS bin, AVG(signal) AS mean FROM lines GROUP BY 1, 2", "mean")
def _(spark, sf):
    return rates.bin_means(bind.line_tracks(spark, sf), "signal")


@query("second_matrix", "A9", f"""WITH {SQL_LINES}, s AS (SELECT track_id, CAST(frame // 40 AS BIGINT) AS second, {', '.join(f'MAX(CASE WHEN frame % 40 = {i} THEN signal END) AS c{i}' for i in range(40))}
    FROM lines GROUP BY 1, 2) SELECT track_id, second, {', '.join(f'c{i}' for i in range(40))} FROM s""")
def _(spark, sf):
    m = rates.second_matrix(bind.line_tracks(spark, sf), "signal")
    return m.select("track_id", "second", *[F.col("cells")[i].alias(f"c{i}") for i in range(40)])


@query("loop_raster", "A24", f"WITH {SQL_EVENTS} SELECT frame % {LOOP} AS position, COUNT(*) AS hits FROM tracks WHERE signal > 40 GROUP BY 1")
def _(spark, sf):
    b = bind.event_tracks(spark, sf).withColumn("hit", L.above("signal", 40))
    return rates.loop_raster(b, "hit", LOOP)


@query("null_report", "P19", f"""WITH {SQL_GAPS}, w AS (SELECT track_id, frame, signal, LAG(signal) {W} AS previous, LEAD(signal) {W} AS following FROM gaps)
    SELECT 'signal' AS column_name, COUNT(*) - COUNT(signal) AS nulls FROM w UNION ALL SELECT 'previous', COUNT(*) - COUNT(previous) FROM w
    UNION ALL SELECT 'following', COUNT(*) - COUNT(following) FROM w""")
def _(spark, sf):
    w = windowed(bind.gap_tracks(spark, sf), lambda w: {"previous": F.lag("signal").over(w), "following": F.lead("signal").over(w)}, before=1, after=1)
    return rates.null_report(w, ["signal", "previous", "following"])


@query("discretise_labels", "P16 P17", f"""WITH {SQL_LINES}, d AS (SELECT track_id, frame,
    CASE WHEN signal > 25 THEN 'open' ELSE 'closed' END || ',' || CASE WHEN l_tax * 1000 < 30 THEN 'ori:0' WHEN l_tax * 1000 < 70 THEN 'ori:1' ELSE 'ori:2' END
      || ',' || CASE WHEN l_discount * 50 <= 2 THEN 'low' WHEN l_discount * 50 <= 2.5 THEN 'mid' ELSE 'high' END AS label,
    CASE WHEN track_id % 4 < 3 THEN 'train' ELSE 'test' END AS part FROM lines),
    v AS (SELECT label, COUNT(*) AS n FROM d WHERE part = 'train' GROUP BY 1), t AS (SELECT AVG(n) AS cut FROM v),
    k AS (SELECT d.part, CASE WHEN v.n > t.cut THEN d.label ELSE 'OTHER' END AS label FROM d LEFT JOIN v USING (label), t)
    SELECT part, label, COUNT(*) AS rows FROM k GROUP BY 1, 2""")
def _(spark, sf):
    from ..operators.select import collapse_rare

    t = bind.line_tracks(spark, sf, "l_tax", "l_discount")
    d = t.select("track_id", "frame", F.concat_ws(
        ",", L.cut_above("signal", [25], ["closed", "open"]), L.cut(F.col("l_tax") * 1000, [30, 70], ["ori:0", "ori:1", "ori:2"]),
        L.cut_above(F.col("l_discount") * 50, [2, 2.5], ["low", "mid", "high"])).alias("label"),
        F.when(F.col("track_id") % 4 < 3, "train").otherwise("test").alias("part"))
    return collapse_rare(d, "label", F.col("part") == "train").groupBy("part", "label").agg(F.count(F.lit(1)).alias("rows"))


@query("label_encode", "P18 U4 A16", """WITH t AS (SELECT event_type AS label, COUNT(*) AS rows FROM events GROUP BY 1)
    SELECT label, DENSE_RANK() OVER (ORDER BY label) - 1 AS code, rows FROM t""")
def _(spark, sf):
    from ..operators.select import encode_labels

    e = bind.table(spark, sf, "events").select(F.col("event_type").alias("label"))
    return encode_labels(e, "label").groupBy("label", "code").agg(F.count(F.lit(1)).alias("rows"))
