"""Queries over bouts, labels and densities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import label as L
from ..operators import density, evaluate, intervals, quantile, rates, series, sweeps
from ..operators.chunk import windowed
from ..sources import bind
from ..sources.bind import SQL_BOUTS, SQL_EVENTS, SQL_LINES, SQL_SCORES
from .registry import query
from .sqltext import over

SQL_DENSE = SQL_BOUTS + """, dense AS (SELECT t.track_id, t.frame, t.signal, MAX(CASE WHEN b.start IS NULL THEN 0 ELSE 1 END) AS manual
    FROM tracks t LEFT JOIN bouts b ON t.track_id = b.track_id AND t.frame >= b.start AND t.frame < b.stop GROUP BY 1, 2, 3)"""


# --- intervals -------------------------------------------------------------------------------------------------------
@query("manual_dense", "J3 D7 D8", f"""WITH {SQL_DENSE}, m AS (SELECT *, MAX(frame) OVER (PARTITION BY track_id) AS last FROM dense)
    SELECT track_id, frame, CAST(manual AS BIGINT) AS manual FROM m WHERE frame < last AND frame >= 5""")
def _(spark, sf):
    t = bind.event_tracks(spark, sf).select("track_id", "frame")
    return intervals.label_frames(t, bind.bouts(spark, sf), crop0=5, drop_last=1).select("track_id", "frame", "manual")


@query("bout_segments", "J4", f"""WITH {SQL_BOUTS} SELECT b.track_id, b.start, COUNT(*) AS frames, SUM(t.signal) AS total
    FROM bouts b JOIN tracks t ON t.track_id = b.track_id AND t.frame BETWEEN b.start AND b.stop GROUP BY 1, 2""", "total")
def _(spark, sf):
    r = intervals.bout_rows(bind.event_tracks(spark, sf), bind.bouts(spark, sf), closed=True)
    return r.groupBy("track_id", "start").agg(F.count(F.lit(1)).alias("frames"), F.sum("signal").alias("total"))


SQL_STATE = SQL_LINES + f", st AS (SELECT track_id, frame, CASE WHEN AVG(signal) {over('5 PRECEDING AND CURRENT ROW')} > 26 THEN 1 ELSE 0 END AS state FROM lines)"
SQL_RUNS = SQL_STATE + """, ch AS (SELECT *, CASE WHEN state = LAG(state) OVER (PARTITION BY track_id ORDER BY frame) THEN 0 ELSE 1 END AS new FROM st),
    gr AS (SELECT *, SUM(new) OVER (PARTITION BY track_id ORDER BY frame) AS g FROM ch),
    runs AS (SELECT track_id, CAST(state AS BIGINT) AS state, MIN(frame) AS start, MAX(frame) AS stop, COUNT(*) AS length FROM gr GROUP BY track_id, g, state)"""


def states(spark, sf):
    return windowed(bind.line_tracks(spark, sf), lambda w: {"state": L.above(F.avg("signal").over(w.rowsBetween(-5, 0)), 26)}, before=5).select(
        "track_id", "frame", "_chunk", "state")


@query("run_length", "W21", f"WITH {SQL_RUNS} SELECT * FROM runs")
def _(spark, sf):
    return intervals.runs(states(spark, sf), "state")


@query("state_durations", "A23", f"WITH {SQL_RUNS} SELECT state, AVG(length) AS mean_length, COUNT(*) AS runs, MAX(length) AS longest FROM runs GROUP BY 1", "mean_length")
def _(spark, sf):
    return intervals.runs(states(spark, sf), "state").groupBy("state").agg(
        F.avg("length").alias("mean_length"), F.count(F.lit(1)).alias("runs"), F.max("length").alias("longest"))


@query("state_run_shares", "A23", f"""WITH {SQL_RUNS}, b AS (SELECT state, CAST(FLOOR(length / 5) AS BIGINT) AS bin, COUNT(*) AS n FROM runs GROUP BY 1, 2)
    SELECT state, bin, n / CAST(SUM(n) OVER (PARTITION BY state) AS DOUBLE) AS share FROM b""", "share")
def _(spark, sf):
    return rates.run_shares(intervals.runs(states(spark, sf), "state"), "state", 5)


_KEPT = """, wide AS (SELECT track_id, start, stop FROM runs WHERE state = 1 AND stop > start + 10 AND stop - start > 12)
    SELECT s.track_id, s.frame, CAST(MAX(CASE WHEN w.start IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS kept
    FROM st s LEFT JOIN wide w ON s.track_id = w.track_id AND s.frame >= w.start AND s.frame < w.stop GROUP BY 1, 2"""


@query("width_filter", "W22 W23", f"WITH {SQL_RUNS}{_KEPT}")
def _(spark, sf):
    return intervals.width_filter(states(spark, sf), "state", width=12).select("track_id", "frame", "kept")


@query("peri_event", "W24", f"""WITH {SQL_EVENTS}, e AS (SELECT track_id, frame AS event FROM tracks WHERE signal > 150 AND frame > 11),
    o AS (SELECT *, UNNEST(generate_series(-10, 10)) AS k FROM e)
    SELECT k AS offset_frames, COUNT(*) AS slots, COUNT(t.signal) AS present, AVG(t.signal) AS mean FROM o LEFT JOIN tracks t ON t.track_id = o.track_id AND t.frame = o.event + o.k GROUP BY 1""", "mean")
def _(spark, sf):
    t = bind.event_tracks(spark, sf)
    e = t.where("signal > 150").select("track_id", F.col("frame").alias("event"))
    p = series.peri_event(t.select("track_id", "frame", "signal"), e, reach=10)
    return p.groupBy(F.col("offset").cast("long").alias("offset_frames")).agg(
        F.count(F.lit(1)).alias("slots"), F.count("signal").alias("present"), F.avg("signal").alias("mean"))


@query("repeat_codes", "J10 D9", f"""WITH {SQL_EVENTS}, c AS (SELECT track_id, frame AS idx, CAST(FLOOR(signal / 100) AS BIGINT) AS code, 1 + CAST(FLOOR(signal) AS BIGINT) % 5 AS duration FROM tracks),
    s AS (SELECT *, SUM(duration) OVER (PARTITION BY track_id ORDER BY idx) - duration AS s0 FROM c), x AS (SELECT *, UNNEST(generate_series(0, duration - 1)) AS k FROM s)
    SELECT track_id, code, COUNT(*) AS frames, CAST(SUM(s0 + k) AS BIGINT) AS frame_sum FROM x GROUP BY 1, 2""")
def _(spark, sf):
    c = bind.event_tracks(spark, sf).select("track_id", F.col("frame").alias("idx"), F.floor(F.col("signal") / 100).alias("code"), (1 + F.floor("signal") % 5).alias("duration"))
    r = intervals.repeat_codes(c, keys=("track_id",))
    return r.groupBy("track_id", "code").agg(F.count(F.lit(1)).alias("frames"), F.sum("frame").alias("frame_sum"))


@query("manual_vs_auto", "A25 J3 P5", f"""WITH {SQL_DENSE} SELECT track_id, frame, CAST(manual AS BIGINT) AS manual, CAST(CASE WHEN signal > 65.5 THEN 1 ELSE 0 END AS BIGINT) AS auto,
    CAST(manual + CASE WHEN signal > 65.5 THEN 1 ELSE 0 END AS BIGINT) AS both FROM dense""")
def _(spark, sf):
    t = intervals.label_frames(bind.event_tracks(spark, sf), bind.bouts(spark, sf)).withColumn("auto", L.above("signal", 65.5))
    return t.select("track_id", "frame", "manual", "auto", (F.col("manual") + F.col("auto")).alias("both"))


@query("confusion_counts", "A22 E1", f"""WITH {SQL_DENSE}, m AS (SELECT *, CASE WHEN signal > 30 AND signal < 90 THEN 1 ELSE 0 END AS auto, LEAD(1) {over()} IS NULL AS last FROM dense)
    SELECT CAST(SUM(CASE WHEN NOT last THEN auto * manual END) AS BIGINT) AS tp, CAST(SUM(auto) - SUM(CASE WHEN NOT last THEN auto * manual END) AS BIGINT) AS fp,
    CAST(SUM(CASE WHEN NOT last THEN (1-auto) * (1-manual) END) AS BIGINT) AS tn, CAST(COUNT(*) - SUM(auto) - SUM(CASE WHEN NOT last THEN (1-auto) * (1-manual) END) AS BIGINT) AS fn FROM m""")
def _(spark, sf):
    d = intervals.label_frames(bind.event_tracks(spark, sf), bind.bouts(spark, sf))
    d = windowed(d.withColumn("auto", L.in_band("signal", 30, 90)), lambda w: {"last": F.lead(F.lit(1)).over(w).isNull()}, after=1)
    return d.agg(*evaluate.counts(F.col("auto"), F.col("manual"), F.col("last")))


# --- sweeps ------------------------------------------------------------------------------------------------------------
LOWS, HIGHS = [float(v) for v in range(200, 5200, 250)], [float(v) for v in range(3000, 30000, 3000)]
SQL_SWEEP = SQL_SCORES + f""", m AS (SELECT *, frame = MAX(frame) OVER () AS last FROM scores),
    grid AS (SELECT lo, hi, CAST(i + {len(LOWS)} * j AS BIGINT) AS param_id FROM (SELECT UNNEST({LOWS}) AS lo, UNNEST(generate_series(0, {len(LOWS) - 1})) AS i) a, (SELECT UNNEST({HIGHS}) AS hi, UNNEST(generate_series(0, {len(HIGHS) - 1})) AS j) b),
    c AS (SELECT param_id, CAST(lo AS DOUBLE) AS low, CAST(hi AS DOUBLE) AS high, CASE WHEN score > lo AND score < hi THEN 1 ELSE 0 END AS auto, manual, last FROM grid, m),
    k AS (SELECT param_id, low, high, CAST(SUM(CASE WHEN NOT last THEN auto*manual ELSE 0 END) AS BIGINT) AS tp, CAST(SUM(auto) AS BIGINT) AS pos,
        CAST(SUM(CASE WHEN NOT last THEN (1-auto)*(1-manual) ELSE 0 END) AS BIGINT) AS tn, COUNT(*) AS n FROM c GROUP BY 1, 2, 3),
    f AS (SELECT param_id, low, high, tp, pos - tp AS fp, tn, n - pos - tn AS fn FROM k),
    r AS (SELECT *, tp / NULLIF(CAST(tp + fn AS DOUBLE), 0) AS tpr, fp / NULLIF(CAST(fp + tn AS DOUBLE), 0) AS fpr, tp / NULLIF(CAST(tp + fp AS DOUBLE), 0) AS prec, fp / NULLIF(CAST(tp + fp AS DOUBLE), 0) AS fdr FROM f),
    sweep AS (SELECT *, tpr + tn / NULLIF(CAST(tn + fp AS DOUBLE), 0) - 1 AS youden FROM r)"""


def _sweep(spark, sf):
    s = bind.scores(spark, sf).select("frame", "manual", "score")
    last = s.agg(F.max("frame").alias("_last"))
    s = s.join(F.broadcast(last), s.frame == last["_last"], "left").withColumn("last", F.col("_last").isNotNull())
    return evaluate.sweep_band(s, "score", "manual", "last", LOWS, HIGHS)


@query("roc_sweep", "E1 E2 J7 D12 P6", f"WITH {SQL_SWEEP} SELECT * FROM sweep", "tpr fpr prec fdr youden")
def _(spark, sf):
    return _sweep(spark, sf).withColumn("param_id", F.col("param_id").cast("long"))


@query("roc_best", "E3 T2", f"WITH {SQL_SWEEP} SELECT low, high, tpr, fpr, youden FROM sweep ORDER BY ROUND(youden, 9) DESC, param_id LIMIT 1", "tpr fpr youden")
def _(spark, sf):
    t = _sweep(spark, sf).withColumn("youden", F.round("youden", 9))
    return evaluate.best_parameters(t, ["low", "high"])


_WG = {"p0": [10.0, 20.0, 30.0], "p1": [90.0, 200.0], "p2": [4.0, 11.0]}


@query("width_sweep", "E2 W23", f"""WITH {SQL_DENSE}, m AS (SELECT *, LEAD(1) {over()} IS NULL AS last FROM dense),
    grid AS (SELECT i + 3*j + 6*l AS param_id, p0, p1, p2 FROM (SELECT UNNEST([10.0::DOUBLE, 20.0, 30.0]) AS p0, UNNEST([0, 1, 2]) AS i) a, (SELECT UNNEST([90.0::DOUBLE, 200.0]) AS p1, UNNEST([0, 1]) AS j) b, (SELECT UNNEST([4.0::DOUBLE, 11.0]) AS p2, UNNEST([0, 1]) AS l) c),
    s AS (SELECT param_id, p0, p1, p2, track_id, frame, manual, last, CASE WHEN signal > p0 AND signal < p1 THEN 1 ELSE 0 END AS b FROM grid, m),
    n AS (SELECT *, CASE WHEN b = LAG(b) OVER (PARTITION BY param_id, track_id ORDER BY frame) THEN 0 ELSE 1 END AS new FROM s),
    g AS (SELECT *, SUM(new) OVER (PARTITION BY param_id, track_id ORDER BY frame) AS g FROM n),
    e AS (SELECT *, MIN(frame) OVER (PARTITION BY param_id, track_id, g) AS start, MAX(frame) OVER (PARTITION BY param_id, track_id, g) AS stop FROM g),
    a AS (SELECT *, CASE WHEN b = 1 AND stop > start + 10 AND stop - start > p2 AND frame < stop THEN 1 ELSE 0 END AS auto FROM e)
    SELECT param_id, p0, p1, p2, CAST(SUM(CASE WHEN NOT last THEN auto*manual ELSE 0 END) AS BIGINT) AS tp,
    CAST(SUM(auto) AS BIGINT) - CAST(SUM(CASE WHEN NOT last THEN auto*manual ELSE 0 END) AS BIGINT) AS fp FROM a GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    d = intervals.label_frames(bind.event_tracks(spark, sf), bind.bouts(spark, sf))
    d = windowed(d, lambda w: {"last": F.lead(F.lit(1)).over(w).isNull()}, after=1).drop("_chunk")
    return sweeps.width_sweep(d, _WG, "signal", "manual", "last").select("param_id", "p0", "p1", "p2", "tp", "fp")


# the grid of 100 lower by 10 upper thresholds that sweeps of one angle use
_GRID = {"p0": [0.5 * v for v in range(100)], "p1": [40.0 + 25 * v for v in range(10)], "p2": [11.0]}


@query("width_sweep_grid", "E2 W23 D12", f"""WITH {SQL_DENSE}, m AS (SELECT *, LEAD(1) {over()} IS NULL AS last FROM dense),
    grid AS (SELECT i + 100 * j AS param_id, i * CAST(0.5 AS DOUBLE) AS p0, CAST(40 + 25 * j AS DOUBLE) AS p1 FROM (SELECT UNNEST(generate_series(0, 99)) AS i) a, (SELECT UNNEST(generate_series(0, 9)) AS j) b),
    s AS (SELECT param_id, p0, p1, track_id, frame, manual, last, CASE WHEN signal > p0 AND signal < p1 THEN 1 ELSE 0 END AS b FROM grid, m),
    i AS (SELECT *, frame - ROW_NUMBER() OVER (PARTITION BY param_id, track_id ORDER BY frame) AS g FROM s WHERE b = 1),
    e AS (SELECT *, MAX(frame) OVER (PARTITION BY param_id, track_id, g) AS stop, MIN(frame) OVER (PARTITION BY param_id, track_id, g) AS start FROM i),
    k AS (SELECT param_id, COUNT(*) AS pos, CAST(SUM(CASE WHEN last THEN 0 ELSE manual END) AS BIGINT) AS tp, CAST(SUM(CASE WHEN last THEN 0 ELSE 1 - manual END) AS BIGINT) AS no FROM e WHERE stop > start + 10 AND stop - start > 11 AND frame < stop GROUP BY 1),
    t AS (SELECT COUNT(*) AS n, CAST(SUM(CASE WHEN last THEN 0 ELSE 1 - manual END) AS BIGINT) AS off FROM m),
    c AS (SELECT grid.param_id, p0, p1, COALESCE(tp, 0) AS tp, COALESCE(pos - tp, 0) AS fp, off - COALESCE(no, 0) AS tn, n, COALESCE(pos, 0) AS pos FROM grid LEFT JOIN k ON k.param_id = grid.param_id, t),
    f AS (SELECT param_id, p0, p1, tp, fp, tn, n - pos - tn AS fn FROM c)
    SELECT CAST(param_id AS BIGINT) AS param_id, p0, p1, tp, fp, tn, fn, tp / NULLIF(CAST(tp + fn AS DOUBLE), 0) + tn / NULLIF(CAST(tn + fp AS DOUBLE), 0) - 1 AS youden FROM f""", "youden")
def _(spark, sf):
    d = intervals.label_frames(bind.event_tracks(spark, sf), bind.bouts(spark, sf))
    d = windowed(d, lambda w: {"last": F.lead(F.lit(1)).over(w).isNull()}, after=1).drop("_chunk")
    out = sweeps.width_sweep(d, _GRID, "signal", "manual", "last")
    return out.select(F.col("param_id").cast("long").alias("param_id"), "p0", "p1", "tp", "fp", "tn", "fn", "youden")


# --- scores of labelings ----------------------------------------------------------------------------------------------
SQL_CLASS = SQL_SCORES + """, c AS (SELECT *, CASE WHEN score < 1000 THEN 0 WHEN score < 4000 THEN 1 ELSE 2 END AS pred FROM scores)"""


def _classes(spark, sf):
    return bind.scores(spark, sf).withColumn("pred", F.when(F.col("score") < 1000, 0).when(F.col("score") < 4000, 1).otherwise(2))


@query("f1_per_state", "E5 P25", f"""WITH {SQL_CLASS}, s AS (SELECT pred AS state, CAST(SUM(manual) AS BIGINT) AS tp, COUNT(*) AS size FROM c GROUP BY 1), p AS (SELECT SUM(manual) AS pos FROM c)
    SELECT state, tp, 2.0 * tp / NULLIF(size + pos, 0) AS f1 FROM s, p""", "f1")
def _(spark, sf):
    return evaluate.f1_per_state(_classes(spark, sf).withColumnRenamed("pred", "state"), "state", "manual")


@query("best_state_transfer", "E5 T2 P20", f"""WITH {SQL_CLASS}, z AS (SELECT *, frame % 4 < 3 AS tr FROM c), s AS (SELECT tr, pred AS state, SUM(manual) AS tp, COUNT(*) AS size FROM z GROUP BY 1, 2), p AS (SELECT tr, SUM(manual) AS pos FROM z GROUP BY 1),
    f AS (SELECT tr, state, 2.0 * tp / NULLIF(size + pos, 0) AS f1 FROM s JOIN p USING (tr)), b AS (SELECT state, f1 AS train_f1 FROM f WHERE tr ORDER BY f1 DESC, state LIMIT 1)
    SELECT b.state, train_f1, f.f1 AS test_f1 FROM b LEFT JOIN f ON f.state = b.state AND NOT f.tr""", "train_f1 test_f1")
def _(spark, sf):
    c = _classes(spark, sf).withColumnRenamed("pred", "state")
    return evaluate.best_state(c.where("frame % 4 < 3"), c.where("frame % 4 = 3"), "state", "manual")


@query("confusion_prf", "E6 P26", f"""WITH {SQL_CLASS}, k AS (SELECT UNNEST([0, 1, 2]) AS class), n AS (SELECT k.class, SUM(CASE WHEN pred = class AND class3 = class THEN 1 ELSE 0 END) AS hit,
    SUM(CASE WHEN pred = class THEN 1 ELSE 0 END) AS p, SUM(CASE WHEN class3 = class THEN 1 ELSE 0 END) AS a FROM k, c GROUP BY 1)
    SELECT class, hit / NULLIF(CAST(p AS DOUBLE), 0) AS precision, hit / NULLIF(CAST(a AS DOUBLE), 0) AS recall, 2.0 * hit / NULLIF(p + a, 0) AS f1 FROM n""", "precision recall f1")
def _(spark, sf):
    return evaluate.class_scores(_classes(spark, sf), "class3", "pred")


@query("confusion_matrix", "E6", f"WITH {SQL_CLASS}, n AS (SELECT class3 AS label, pred, COUNT(*) AS n FROM c GROUP BY 1, 2) SELECT label, pred, n, CAST(SUM(n) OVER (PARTITION BY label) AS BIGINT) AS label_total, CAST(SUM(n) OVER (PARTITION BY pred) AS BIGINT) AS pred_total FROM n")
def _(spark, sf):
    return evaluate.confusion(_classes(spark, sf).withColumnRenamed("class3", "label"), "label", "pred")


@query("class_merge", "P26", f"""WITH {SQL_DENSE} SELECT CAST(CASE WHEN signal > 100 THEN 2 WHEN manual = 1 THEN 1 ELSE 0 END AS BIGINT) AS class, COUNT(*) AS frames FROM dense GROUP BY 1""")
def _(spark, sf):
    d = intervals.label_frames(bind.event_tracks(spark, sf), bind.bouts(spark, sf))
    return d.select(L.merge_classes("manual", L.above("signal", 100)).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("frames"))


SQL_ROC = SQL_SCORES + """, d AS (SELECT score, SUM(manual) AS pos, SUM(1 - manual) AS neg FROM scores GROUP BY 1),
    cu AS (SELECT score, pos, neg, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER () AS p, SUM(neg) OVER () AS q FROM d WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("roc_curve", "E7", f"WITH {SQL_ROC} SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, tp / CAST(p AS DOUBLE) AS tpr, fp / CAST(q AS DOUBLE) AS fpr FROM cu", "tpr fpr")
def _(spark, sf):
    return evaluate.roc_points(bind.scores(spark, sf), "score", "manual").select("score", "tp", "fp", "tpr", "fpr")


@query("auc", "E7", f"WITH {SQL_ROC} SELECT SUM(neg * (tp - pos / 2.0)) / (CAST(MAX(p) AS DOUBLE) * MAX(q)) AS auc FROM cu", "auc")
def _(spark, sf):
    return evaluate.auc(evaluate.roc_points(bind.scores(spark, sf), "score", "manual"))


@query("operating_point", "E7", f"WITH {SQL_ROC} SELECT score, tp / CAST(p AS DOUBLE) AS tpr, fp / CAST(q AS DOUBLE) AS fpr FROM cu WHERE fp / CAST(q AS DOUBLE) < 0.2 ORDER BY score LIMIT 1", "tpr fpr")
def _(spark, sf):
    return evaluate.operating_point(evaluate.roc_points(bind.scores(spark, sf), "score", "manual"))


@query("ari", "E8", f"""WITH {SQL_CLASS}, k AS (SELECT UNNEST([0, 1, 2]) AS cluster), l AS (SELECT cluster, manual, CASE WHEN pred = cluster THEN 1 ELSE 0 END AS z FROM k, c),
    n AS (SELECT cluster, manual, z, CAST(COUNT(*) AS DOUBLE) AS n FROM l GROUP BY 1, 2, 3), ab AS (SELECT cluster, SUM(n*(n-1)/2) AS ab, SUM(n) AS t FROM n GROUP BY 1),
    a AS (SELECT cluster, SUM(s*(s-1)/2) AS a FROM (SELECT cluster, manual, SUM(n) AS s FROM n GROUP BY 1, 2) q GROUP BY 1),
    b AS (SELECT cluster, SUM(s*(s-1)/2) AS b FROM (SELECT cluster, z, SUM(n) AS s FROM n GROUP BY 1, 2) q GROUP BY 1)
    SELECT cluster, (ab - a*b/(t*(t-1)/2)) / NULLIF((a+b)/2 - a*b/(t*(t-1)/2), 0) AS ari FROM ab JOIN a USING (cluster) JOIN b USING (cluster)""", "ari")
def _(spark, sf):
    c = _classes(spark, sf).withColumn("cluster", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    return evaluate.rand_index(c.withColumn("z", F.when(F.col("pred") == F.col("cluster"), 1).otherwise(0)), "manual", "z", ("cluster",))


@query("overlap", "M15 U3", f"WITH {SQL_CLASS} SELECT class3, pred, COUNT(*) AS n FROM c GROUP BY 1, 2")
def _(spark, sf):
    return evaluate.state_overlap(_classes(spark, sf), "class3", "pred")


_PERMS = [(a, b, c) for a in range(3) for b in range(3) for c in range(3) if len({a, b, c}) == 3]


@query("relabelled", "M15", f"""WITH {SQL_CLASS}, p AS (SELECT * FROM (VALUES {', '.join(str(q) for q in _PERMS)}) v(a, b, d)),
    t AS (SELECT a, b, d, COUNT(CASE WHEN (pred = 0 AND class3 = a) OR (pred = 1 AND class3 = b) OR (pred = 2 AND class3 = d) THEN 1 END) AS hit FROM p, c GROUP BY 1, 2, 3),
    best AS (SELECT * FROM t ORDER BY hit DESC, a, b, d LIMIT 1)
    SELECT CAST(CASE pred WHEN 0 THEN a WHEN 1 THEN b ELSE d END AS BIGINT) AS pred, COUNT(*) AS frames, COUNT(CASE WHEN class3 = CASE pred WHEN 0 THEN a WHEN 1 THEN b ELSE d END THEN 1 END) AS agree FROM c, best GROUP BY 1""")
def _(spark, sf):
    c = _classes(spark, sf)
    perm = evaluate.best_permutation(evaluate.state_overlap(c, "pred", "class3"), "pred", "class3", 3, 3)
    return evaluate.relabel(c, "pred", perm).groupBy("pred").agg(
        F.count(F.lit(1)).alias("frames"), F.count(F.when(F.col("class3") == F.col("pred"), 1)).alias("agree"))


SQL_EST = SQL_EVENTS + ", es AS (SELECT track_id, frame, signal, CAST(CASE WHEN signal < 20 THEN 0 WHEN signal < 60 THEN 1 ELSE 2 END AS BIGINT) AS state FROM tracks)"


def _event_states(spark, sf, *extra):
    return bind.event_tracks(spark, sf, *extra).withColumn("state", F.when(F.col("signal") < 20, 0).when(F.col("signal") < 60, 1).otherwise(2).cast("long"))


@query("transitions", "E11", f"""WITH {SQL_EST}, n AS (SELECT state, LEAD(state) {over()} AS next_state FROM es), c AS (SELECT state, next_state, COUNT(*) AS n FROM n WHERE next_state <> state GROUP BY 1, 2)
    SELECT state, next_state, n, n / SUM(n) OVER (PARTITION BY state) AS prob FROM c""", "prob")
def _(spark, sf):
    return evaluate.transitions(_event_states(spark, sf), "state")


@query("state_occupancy", "E11 A16", f"WITH {SQL_EST} SELECT state, COUNT(*) AS frames, AVG(signal) AS mean, STDDEV_POP(signal) AS sd FROM es GROUP BY 1", "mean sd")
def _(spark, sf):
    return _event_states(spark, sf).groupBy("state").agg(F.count(F.lit(1)).alias("frames"), F.avg("signal").alias("mean"), F.stddev_pop("signal").alias("sd"))


@query("negative_control", "E4", f"WITH {SQL_EVENTS} SELECT track_id, COUNT(*) AS frames, SUM(signal) AS total, MIN(signal) AS low, MAX(signal) AS high FROM tracks GROUP BY 1", "total")
def _(spark, sf):
    # a permutation keeps each track's values; its rates are covered by the tests
    c = evaluate.shuffled(bind.event_tracks(spark, sf).select("track_id", "frame", "signal"), "signal")
    return c.groupBy("track_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("control").alias("total"), F.min("control").alias("low"), F.max("control").alias("high"))


@query("negative_control_scored", "E4 E1", f"""WITH {SQL_EVENTS}, g AS (SELECT UNNEST([10.0::DOUBLE, 30.0, 60.0]) AS low), h AS (SELECT UNNEST([90.0::DOUBLE, 200.0]) AS high)
    SELECT low, high, COUNT(CASE WHEN signal > low AND signal < high THEN 1 END) AS positives, COUNT(*) AS rows FROM tracks, g, h GROUP BY 1, 2""")
def _(spark, sf):
    """The sweep on shuffled values: what it calls positive is as much as on the true ones, only elsewhere."""
    d = evaluate.shuffled(intervals.label_frames(bind.event_tracks(spark, sf), bind.bouts(spark, sf)).select("track_id", "frame", "signal", "manual"), "signal")
    d = windowed(d, lambda w: {"last": F.lead(F.lit(1)).over(w).isNull()}, after=1)
    s = evaluate.sweep_band(d, "control", "manual", "last", [10.0, 30.0, 60.0], [90.0, 200.0])
    return s.select("low", "high", (F.col("tp") + F.col("fp")).alias("positives"), (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("rows"))


@query("manual_per_state", "A18", f"""WITH {SQL_DENSE} SELECT CASE WHEN signal < 20 THEN 0 WHEN signal < 60 THEN 1 ELSE 2 END AS state, CASE WHEN frame < 40 THEN 'train' ELSE 'test' END AS part,
    CAST(SUM(manual) AS BIGINT) AS bouts, CAST(SUM(CASE WHEN signal > 100 THEN 1 ELSE 0 END) AS BIGINT) AS flares FROM dense GROUP BY 1, 2""")
def _(spark, sf):
    d = intervals.label_frames(bind.event_tracks(spark, sf), bind.bouts(spark, sf))
    return d.groupBy(F.when(F.col("signal") < 20, 0).when(F.col("signal") < 60, 1).otherwise(2).alias("state"),
                     F.when(F.col("frame") < 40, "train").otherwise("test").alias("part")).agg(
        F.sum("manual").alias("bouts"), F.sum(L.above("signal", 100)).alias("flares"))


# --- tables ------------------------------------------------------------------------------------------------------------
FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _line_rows(spark, sf, *cols):
    return bind.table(spark, sf, "lineitem").select(*cols)


@query("state_means", "A15 D13", " UNION ALL ".join(f"SELECT l_returnflag AS state, '{f}' AS feature, AVG({f}) AS mean, VAR_SAMP({f}) AS variance FROM lineitem GROUP BY 1" for f in FEATS), "mean:4 variance:2")
def _(spark, sf):
    return rates.state_table(_line_rows(spark, sf, F.col("l_returnflag").alias("state"), *FEATS), FEATS)


@query("state_means_wide", "A15", " UNION ALL ".join(f"SELECT '{f}' AS feature, " + ", ".join(f"AVG(CASE WHEN l_linenumber = {s} THEN {f} END) AS state{s}" for s in range(1, 8)) + " FROM lineitem" for f in FEATS),
       " ".join(f"state{s}:4" for s in range(1, 8)))
def _(spark, sf):
    return rates.state_means_wide(_line_rows(spark, sf, F.col("l_linenumber").alias("state"), *FEATS), FEATS, list(range(1, 8)))


@query("crosstab", "A19", "SELECT l_returnflag, CAST(SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS l_linestatus_F, CAST(SUM(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS l_linestatus_O FROM lineitem GROUP BY 1")
def _(spark, sf):
    return rates.crosstab(_line_rows(spark, sf, "l_returnflag", "l_linestatus"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("corr_matrix", "A20", " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, CORR({a}, {b}) AS corr FROM lineitem" for i, a in enumerate(FEATS) for b in FEATS[i + 1:]), "corr")
def _(spark, sf):
    return rates.correlations(_line_rows(spark, sf, *FEATS), FEATS)


@query("anova", "A21", """WITH g AS (SELECT l_linenumber, COUNT(*) AS n, AVG(l_quantity) AS m, VAR_POP(l_quantity) AS v FROM lineitem GROUP BY 1), t AS (SELECT SUM(n) AS n, COUNT(*) AS k, SUM(n*v) AS w FROM g), a AS (SELECT AVG(l_quantity) AS grand FROM lineitem)
    SELECT ((SELECT SUM(n*(m-grand)*(m-grand)) FROM g, a) / (k-1)) / (w / (n-k)) AS f_ratio, k AS groups, CAST(n AS BIGINT) AS rows FROM t""", "f_ratio:5")
def _(spark, sf):
    return rates.anova_f(_line_rows(spark, sf, "l_linenumber", "l_quantity"), "l_linenumber", "l_quantity")


@query("zscore", "M1", """WITH s AS (SELECT AVG(l_extendedprice) AS a, STDDEV_POP(l_extendedprice) AS s FROM lineitem WHERE l_linenumber <= 4)
    SELECT l_linenumber, COUNT(*) AS rows, AVG((l_extendedprice-a)/s) AS mean, STDDEV_POP((l_extendedprice-a)/s) AS sd, MAX((l_extendedprice-a)/s) AS top FROM lineitem, s GROUP BY 1""", "mean sd top")
def _(spark, sf):
    from ..operators.models import fit_scaler, scale

    li = _line_rows(spark, sf, "l_linenumber", "l_extendedprice")
    z = scale(li, fit_scaler(li.where("l_linenumber <= 4"), ["l_extendedprice"]), ["l_extendedprice"])
    return z.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("rows"), F.avg("l_extendedprice").alias("mean"), F.stddev_pop("l_extendedprice").alias("sd"), F.max("l_extendedprice").alias("top"))


@query("zscore_inverse", "M1", "SELECT l_linenumber, COUNT(*) AS rows, SUM(l_extendedprice) AS total, MAX(l_extendedprice) AS top FROM lineitem GROUP BY 1", "total:2 top:5")
def _(spark, sf):
    from ..operators.models import fit_scaler, scale, unscale

    li = _line_rows(spark, sf, "l_linenumber", "l_extendedprice")
    fit = fit_scaler(li.where("l_linenumber <= 4"), ["l_extendedprice"])
    back = unscale(scale(li, fit, ["l_extendedprice"]), fit, ["l_extendedprice"])
    return back.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_extendedprice").alias("total"), F.max("l_extendedprice").alias("top"))


# --- densities ---------------------------------------------------------------------------------------------------------
@query("joint_hist", "A10", f"WITH {SQL_EVENTS}, p AS (SELECT signal, LAG(signal) {over()} AS prev FROM tracks) SELECT CAST(FLOOR(signal / 20) AS BIGINT) AS bx, CAST(FLOOR(prev / 20) AS BIGINT) AS by, COUNT(*) AS n FROM p WHERE prev IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    t = windowed(bind.event_tracks(spark, sf), lambda w: {"prev": F.lag("signal").over(w)}, before=1).where("prev is not null")
    return density.joint_histogram(t, "signal", "prev", 20)


_TAPS = ", ".join(f"({k}, EXP(-{k * k}/8.0))" for k in range(-8, 9))


@query("smooth_hist", "A10", f"""WITH h AS (SELECT CAST(FLOOR(l_quantity / 2) AS BIGINT) AS bx, CAST(FLOOR(l_tax * 100) AS BIGINT) AS by, COUNT(*) AS n FROM (SELECT l_quantity, ROUND(l_tax, 2) + 0.001 AS l_tax FROM lineitem) q GROUP BY 1, 2),
    t AS (SELECT * FROM (VALUES {_TAPS}) v(k, w)), s AS (SELECT SUM(w) AS s FROM t),
    g AS (SELECT h.bx + a.k AS bx, h.by + b.k AS by, SUM(h.n * a.w * b.w) / MAX(s.s * s.s) AS smooth FROM h, t a, t b, s GROUP BY 1, 2) SELECT * FROM g""", "smooth")
def _(spark, sf):
    li = _line_rows(spark, sf, "l_quantity", (F.round(F.col("l_tax"), 2) * 100 + F.lit(0.1)).alias("tax"))
    h = density.joint_histogram(li.withColumn("q", F.col("l_quantity") / 2), "q", "tax", 1)
    return density.smooth_histogram(h, 2.0, 8)


@query("quantile_hist", "A14 A27", """WITH q AS (SELECT event_type, QUANTILE_CONT(value, 0.05) AS lo, QUANTILE_CONT(value, 0.95) AS hi FROM events GROUP BY 1)
    SELECT event_type, CAST(LEAST(39, FLOOR((value - lo) / (hi - lo) * 40)) AS BIGINT) AS bin, COUNT(*) AS n FROM events JOIN q USING (event_type) WHERE value >= lo AND value <= hi GROUP BY 1, 2""")
def _(spark, sf):
    return density.quantile_histogram(bind.table(spark, sf, "events").select("event_type", "value"), "value", keys=("event_type",))


@query("quantile_thresholds", "A27", "SELECT l_suppkey, QUANTILE_CONT(l_extendedprice, 0.1) AS q10, QUANTILE_CONT(l_extendedprice, 0.5) AS q50, QUANTILE_CONT(l_extendedprice, 0.975) AS q975 FROM lineitem GROUP BY 1", "q10 q50 q975")
def _(spark, sf):
    return quantile.exact_quantiles(bind.table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice"), ["l_suppkey"], "l_extendedprice", {"q10": 0.1, "q50": 0.5, "q975": 0.975})


def _kde_sql(src, key):
    """Densities at the multiples of 5 within 8.5 bandwidths (and two steps) of the bin of a value of the group."""
    return f"""st AS (SELECT {key}, POWER(COUNT(*), -0.2) * STDDEV_SAMP(value) AS h, COUNT(*) AS n FROM {src} GROUP BY {key}),
    ends AS (SELECT CAST(FLOOR(MIN(value) / 5) AS BIGINT) AS lo FROM {src}),
    bins AS (SELECT DISTINCT {key}, CAST(FLOOR(value / 5) AS BIGINT) AS b, CAST(CEIL(8.5 * h / 5) AS BIGINT) + 2 AS r FROM {src} JOIN st USING ({key}) WHERE h > 0),
    gr AS (SELECT DISTINCT {key}, UNNEST(generate_series(b - r, b + r)) AS i FROM bins),
    kde AS (SELECT {key}, i - MAX(lo) AS g, CAST(i * 5 AS DOUBLE) AS x, SUM(EXP(-0.5 * POWER((i * 5 - value) / h, 2))) / (MAX(n) * MAX(h) * SQRT(2 * PI())) AS density
      FROM {src} s JOIN st USING ({key}) JOIN gr USING ({key}), ends GROUP BY {key}, i)"""


@query("kde_grid", "A13", f"WITH e AS (SELECT event_type, value FROM events), {_kde_sql('e', 'event_type')} SELECT * FROM kde", "density:9")
def _(spark, sf):
    e = bind.table(spark, sf, "events").select("event_type", "value")
    return density.kde_grid(e, "value", 5.0, ("event_type",))


@query("kde_conditional", "A12 P9", f"WITH {SQL_EVENTS}, p AS (SELECT track_id % 5 AS fish, signal AS value, LAG(signal) {over()} AS prev FROM tracks), e AS (SELECT fish, value FROM p WHERE prev BETWEEN 20 AND 90), {_kde_sql('e', 'fish')} SELECT * FROM kde", "density:9")
def _(spark, sf):
    t = windowed(bind.event_tracks(spark, sf), lambda w: {"prev": F.lag("signal").over(w)}, before=1).where(F.col("prev").between(20, 90))
    t = t.select(F.expr("track_id % 5").alias("fish"), "signal")
    return density.kde_grid(t, "signal", 5.0, ("fish",))


_VALLEY = """, ex AS (SELECT *, LAG(density) OVER w AS a, LEAD(density) OVER w AS b FROM kde WINDOW w AS (PARTITION BY track_id, loop ORDER BY g)),
    pk AS (SELECT track_id, loop, COUNT(*) AS n, MAX(x) AS last, ARG_MAX(x, density) AS top FROM ex WHERE density > a AND density > b GROUP BY 1, 2),
    va AS (SELECT e.track_id, e.loop, e.x FROM ex e JOIN pk p ON e.track_id = p.track_id AND e.loop = p.loop WHERE n = 2 AND density < a AND density < b AND e.x < last AND e.x > top)"""


@query("kde_valley", "E10", f"WITH {SQL_EVENTS}, e AS (SELECT track_id, frame // 20 AS loop, signal AS value FROM tracks), {_kde_sql('e', 'track_id, loop')}{_VALLEY} SELECT AVG(x) AS mean, COUNT(*) AS valleys, MEDIAN(x) AS median FROM va", "mean median")
def _(spark, sf):
    t = bind.event_tracks(spark, sf).select("track_id", F.expr("frame div 20").alias("loop"), "signal")
    keys = ("track_id", "loop")
    return density.valley_threshold(density.density_valleys(density.kde_grid(t, "signal", 5.0, keys), keys))


@query("density_sorted", "A13 T4 T1", f"""WITH h AS (SELECT CAST(FLOOR(l_quantity / 5) AS BIGINT) AS bx, CAST(FLOOR(l_extendedprice / 10000) AS BIGINT) AS by, COUNT(*) AS n FROM lineitem GROUP BY 1, 2),
    t AS (SELECT * FROM (VALUES {_TAPS}) v(k, w)), s AS (SELECT SUM(w) AS s FROM t), g AS (SELECT h.bx + a.k AS bx, h.by + b.k AS by, SUM(h.n * a.w * b.w) / MAX(s.s * s.s) AS density FROM h, t a, t b, s GROUP BY 1, 2)
    SELECT l_returnflag, COUNT(*) AS rows, AVG(density) AS mean, MAX(density) AS top FROM lineitem JOIN g ON g.bx = FLOOR(l_quantity / 5) AND g."by" = FLOOR(l_extendedprice / 10000) GROUP BY 1 ORDER BY mean DESC""", "mean top")
def _(spark, sf):
    li = _line_rows(spark, sf, "l_returnflag", "l_quantity", (F.col("l_extendedprice") / 2000).alias("price"))
    d = density.density_at_points(li, "l_quantity", "price", 5.0)
    return d.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.avg("density").alias("mean"), F.max("density").alias("top")).orderBy(F.desc("mean"))


@query("density_points", "A13 T4", """WITH p AS (SELECT event_type, value AS x, value * 0.3 + EXTRACT(minute FROM ts) + EXTRACT(second FROM ts) / 60.0 AS y FROM events WHERE user_id % 5 = 0),
    m AS (SELECT event_type, COUNT(*) AS n, AVG(x) AS mx, AVG(y) AS my, VAR_SAMP(x) AS vx, VAR_SAMP(y) AS vy, COVAR_SAMP(x, y) AS c FROM p GROUP BY 1),
    s AS (SELECT event_type, n, vx * POWER(n, -1.0/3) AS a, vy * POWER(n, -1.0/3) AS b, c * POWER(n, -1.0/3) AS c FROM m),
    d AS (SELECT p.event_type, p.x, p.y, SUM(EXP(-0.5 * (b * POWER(p.x - q.x, 2) - 2 * c * (p.x - q.x) * (p.y - q.y) + a * POWER(p.y - q.y, 2)) / (a * b - c * c))) / (MAX(n) * 2 * PI() * SQRT(MAX(a * b - c * c))) AS density
      FROM p JOIN p q ON p.event_type = q.event_type JOIN s ON s.event_type = p.event_type GROUP BY p.event_type, p.x, p.y)
    SELECT event_type, COUNT(*) AS points, AVG(density) * 1e6 AS mean, MIN(density) * 1e6 AS least, MAX(density) * 1e6 AS most, ARG_MAX(x, density) AS top FROM d GROUP BY 1""", "mean:5 least:5 most:5 top")
def _(spark, sf):
    e = bind.table(spark, sf, "events").where("user_id % 5 = 0")
    p = e.select("event_type", F.col("value").alias("x"), (F.col("value") * 0.3 + F.minute("ts") + F.second("ts") / 60).alias("y"))
    d = density.point_density(p, "x", "y", ("event_type",)).dropDuplicates(["event_type", "x", "y"])
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("points"), (F.avg("density") * 1e6).alias("mean"), (F.min("density") * 1e6).alias("least"), (F.max("density") * 1e6).alias("most"), F.max_by("x", "density").alias("top"))


@query("background_model", "A28 S7", """WITH p AS (SELECT label, CAST(UNNEST(generate_series(0, 63)) AS BIGINT) AS px, embedding FROM embeddings), v AS (SELECT label, px, CAST(embedding[CAST(px + 1 AS INT)] AS DOUBLE) AS v FROM p)
    SELECT label, px, AVG(v) AS mean, MEDIAN(v) AS median FROM v GROUP BY 1, 2""", "mean median")
def _(spark, sf):
    px = bind.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("px", "v")).select("label", F.col("px").cast("long").alias("px"), F.col("v").cast("double").alias("v"))
    mean = px.groupBy("label", "px").agg(F.avg("v").alias("mean"))
    return mean.join(quantile.exact_quantiles(px, ["label", "px"], "v", {"median": 0.5}), ["label", "px"])
