"""Queries over scaled features, components, clusters and sequence models."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import evaluate, graph, hmm, models, ring, silhouette
from ..operators.chunk import computed, windowed
from ..sources import bind
from ..sources.bind import SQL_LINES
from ..sources.tables import stored
from .registry import query

COLS = ["signal", "l_discount", "l_tax"]


def features(spark, sf):
    """track_id, frame and three smoothed, scaled line features."""
    t = bind.line_tracks(spark, sf, "l_discount", "l_tax")
    t = windowed(t, lambda w: {c: F.avg(c).over(w.rowsBetween(-9, 0)) for c in COLS}, before=9)
    t = stored(t.select("track_id", "frame", *COLS))  # read by several fits
    return models.scale(t, models.fit_scaler(t, COLS), COLS)


def _manual(df):
    return df.withColumn("manual", F.when(F.col("signal") > 0.8, 1).otherwise(0))


def _sql_components(where: str = "TRUE") -> str:
    """Eigenvalues l1 >= l2 >= l3 and unit eigenvectors of the covariance of the three features, in closed form."""
    means = ", ".join(f"AVG({c}) OVER w AS {c}" for c in COLS)
    z = ", ".join(f"({c} - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER () AS {x}" for c, x in zip(COLS, "xyz"))
    cov = ", ".join(f"COVAR_POP({a}, {b}) AS {n}" for n, a, b in (("a", "x", "x"), ("b", "y", "y"), ("c", "z", "z"), ("d", "x", "y"), ("e", "x", "z"), ("f", "y", "z")))
    vectors = " UNION ALL ".join(f"""SELECT {i} AS component, l{i + 1} / (l1+l2+l3) AS ratio, {' + '.join(f'l{j + 1}' for j in range(i + 1))} AS upto, l1+l2+l3 AS total,
        d*f - e*(b-l{i + 1}) AS v0, e*d - (a-l{i + 1})*f AS v1, (a-l{i + 1})*(b-l{i + 1}) - d*d AS v2 FROM ev""" for i in range(3))
    return f"""{SQL_LINES}, sm AS (SELECT track_id, frame, {means} FROM lines WINDOW w AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
    sc AS (SELECT track_id, frame, {z} FROM sm), mu AS (SELECT AVG(x) AS mx, AVG(y) AS my, AVG(z) AS mz FROM sc WHERE {where}), cv AS (SELECT {cov} FROM sc WHERE {where}),
    q0 AS (SELECT *, (a+b+c)/3 AS q FROM cv), q1 AS (SELECT *, SQRT(((a-q)*(a-q) + (b-q)*(b-q) + (c-q)*(c-q) + 2*(d*d+e*e+f*f)) / 6) AS p FROM q0),
    q2 AS (SELECT *, ACOS(LEAST(1, GREATEST(-1, ((a-q)*((b-q)*(c-q)-f*f) - d*(d*(c-q)-f*e) + e*(d*f-(b-q)*e)) / (2*p*p*p)))) / 3 AS g FROM q1),
    ev AS (SELECT *, q + 2*p*COS(g) AS l1, q + 2*p*COS(g + 2*PI()/3) AS l3, 3*q - (q + 2*p*COS(g)) - (q + 2*p*COS(g + 2*PI()/3)) AS l2 FROM q2),
    vs AS ({vectors}), nv AS (SELECT component, ratio, upto / total AS cumulative, SQRT(v0*v0+v1*v1+v2*v2) * SIGN(CASE WHEN ABS(v0) >= ABS(v1) AND ABS(v0) >= ABS(v2) THEN v0 WHEN ABS(v1) >= ABS(v2) THEN v1 ELSE v2 END) AS n, v0, v1, v2 FROM vs)"""


@query("pca_loadings", "M2", f"WITH {_sql_components()} " + " UNION ALL ".join(
    f"SELECT component, ratio, cumulative, '{c}' AS feature, v{i}/n AS loading, ABS(v{i}/n) AS magnitude FROM nv" for i, c in enumerate(COLS)), "ratio cumulative loading:4 magnitude:4")
def _(spark, sf):
    return models.fit_components(features(spark, sf), COLS).table(spark)


@query("pca_transfer", "M3 M2 P12", f"""WITH {_sql_components('track_id % 2 = 0')} SELECT track_id, frame, {', '.join(
    f"((x-mx)*(SELECT v0/n FROM nv WHERE component = {k}) + (y-my)*(SELECT v1/n FROM nv WHERE component = {k}) + (z-mz)*(SELECT v2/n FROM nv WHERE component = {k})) AS pc{k}" for k in (0, 1))}
    FROM sc, mu WHERE track_id % 2 = 1""", "pc0:4 pc1:4")
def _(spark, sf):
    f = features(spark, sf)
    comp = models.fit_components(f.where("track_id % 2 = 0"), COLS)
    return comp.transform(f.where("track_id % 2 = 1"), 2).select("track_id", "frame", "pc0", "pc1")


@query("kmeans_clusters", "M4 A19")
def _(spark, sf):
    f = features(spark, sf)
    km = models.fit_kmeans(f, COLS, 3)
    return models.label_clusters(f, COLS, km).groupBy("cluster").agg(F.count(F.lit(1)).alias("frames"), *[F.avg(c).alias(c) for c in COLS])


@query("silhouette", "M5 M4")
def _(spark, sf):
    f = features(spark, sf)
    ks = [2, 3, 4]
    rows = [(k, models.silhouette(models.label_clusters(f, COLS, km), COLS)) for k, km in zip(ks, models.fit_kmeans_many(f, COLS, ks))]
    return spark.createDataFrame(rows, "k int, silhouette double")


@query("silhouette_fixed", "M5", f"""WITH {SQL_LINES}, c AS (SELECT CASE WHEN signal < 20 THEN 0 ELSE 1 END AS z, signal AS a, l_tax * 100 AS b FROM lines),
    s AS (SELECT z, CAST(COUNT(*) AS DOUBLE) AS n, SUM(a) AS sa, SUM(b) AS sb, SUM(a*a + b*b) AS q FROM c GROUP BY 1),
    d AS (SELECT (i.n*(c.a*c.a + c.b*c.b) - 2*(c.a*i.sa + c.b*i.sb) + i.q) / (i.n - 1) AS own, (o.n*(c.a*c.a + c.b*c.b) - 2*(c.a*o.sa + c.b*o.sb) + o.q) / o.n AS other
      FROM c JOIN s i ON i.z = c.z JOIN s o ON o.z <> c.z)
    SELECT AVG((other - own) / GREATEST(other, own)) AS silhouette FROM d""", "silhouette")
def _(spark, sf):
    t = bind.line_tracks(spark, sf, "l_tax").select(F.when(F.col("signal") < 20, 0).otherwise(1).alias("cluster"), "signal", (F.col("l_tax") * 100).alias("tax"))
    return spark.createDataFrame([(models.silhouette(t, ["signal", "tax"]),)], "silhouette double")


@query("silhouette_plain", "M5", """WITH o AS (SELECT CASE WHEN o_totalprice < 90000 THEN 0 WHEN date_diff('day', DATE '1998-04-15', CAST(o_orderdate AS DATE)) < 0 THEN 1 ELSE 2 END AS cluster,
        CAST(o_totalprice AS DOUBLE) / 1000 AS a, CAST(date_diff('day', DATE '1998-04-15', CAST(o_orderdate AS DATE)) AS DOUBLE) / 10 AS b FROM orders),
    p AS (SELECT cluster, a, b, CAST(COUNT(*) AS DOUBLE) AS n FROM o GROUP BY 1, 2, 3), size AS (SELECT cluster, SUM(n) AS size FROM p GROUP BY 1),
    d AS (SELECT p.cluster, p.a, p.b, p.n, q.cluster AS to_cluster, SUM(q.n * SQRT((p.a-q.a)*(p.a-q.a) + (p.b-q.b)*(p.b-q.b))) AS s FROM p, p q GROUP BY 1, 2, 3, 4, 5),
    m AS (SELECT d.cluster, a, b, n, MAX(CASE WHEN d.cluster = to_cluster THEN s / (size - 1) END) AS own, MIN(CASE WHEN d.cluster <> to_cluster THEN s / size END) AS other
        FROM d JOIN size ON to_cluster = size.cluster GROUP BY 1, 2, 3, 4)
    SELECT cluster, CAST(SUM(n) AS BIGINT) AS rows, SUM(n * (other - own) / GREATEST(other, own)) / SUM(n) AS silhouette FROM m GROUP BY 1""", "silhouette")
def _(spark, sf):
    day = F.datediff("o_orderdate", F.lit("1998-04-15").cast("date"))
    o = bind.table(spark, sf, "orders").select((F.col("o_totalprice").cast("double") / 1000).alias("price"), (day.cast("double") / 10).alias("day"))
    o = o.withColumn("cluster", F.when(F.col("price") < 90, 0).when(F.col("day") < 0, 1).otherwise(2))
    return silhouette.mean_silhouette(silhouette.plain_silhouette(o, ["price", "day"]), ["cluster"])


@query("spectral_clusters", "M6 E8 P4")
def _(spark, sf):
    """Every 20th frame; best one-vs-rest Rand index against the manual label for each k."""
    f = stored(_manual(features(spark, sf)).where("frame % 20 = 0"))
    ks = list(range(2, 9))
    c = stored(graph.spectral_clusters(f, COLS, ks).join(f.select("track_id", "frame", "manual"), ["track_id", "frame"]))
    long = c.select("manual", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"cluster_{k}").alias("cluster")) for k in ks])))
    named = long.select("k", "cluster").distinct().withColumnRenamed("cluster", "z")
    each = long.join(named, "k").select("k", "z", "manual", F.when(F.col("cluster") == F.col("z"), 1).otherwise(0).alias("on"))
    ari = evaluate.rand_index(each, "manual", "on", ("k", "z"))
    return ari.groupBy("k").agg(F.count(F.lit(1)).alias("clusters"), F.max("ari").alias("best"))


def _gaussian(f, k, diagonal=False):
    return models.gaussian_starts(f, [(COLS, k)], diagonal=diagonal)[0]


@query("hmm_fit", "M7 M8 D13")
def _(spark, sf):
    f = features(spark, sf)
    m = hmm.fit(f, COLS, _gaussian(f, 3), rounds=50)
    return hmm.parameter_table(spark, m.ordered())


@query("hmm_states", "M12 M7 A15")
def _(spark, sf):
    f = features(spark, sf)
    m = hmm.fit(f, COLS, _gaussian(f, 3), rounds=50).ordered()
    return hmm.decode(f, COLS, m)


@query("hmm_diagonal", "M9 M13")
def _(spark, sf):
    f = features(spark, sf)
    m = hmm.fit(f, COLS, _gaussian(f, 3, diagonal=True), rounds=50, fix_start=True).ordered()
    return hmm.decode(f, COLS, m, "smooth").select("track_id", "frame", *[F.col("smooth")[i].alias(c) for i, c in enumerate(COLS)])


@query("hmm_mixture", "M10")
def _(spark, sf):
    f = features(spark, sf)
    g = _gaussian(f, 3)
    m = hmm.fit(f, COLS, hmm.mixture_start(g.emission.means, g.emission.covs, 2), rounds=50)
    return hmm.parameter_table(spark, m.ordered())


def _codes(spark, sf):
    codes = bind.line_tracks(spark, sf, "l_returnflag", "l_linestatus")
    return stored(codes.select("track_id", "frame", F.expr("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END * 2 + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END").alias("code")))


@query("hmm_categorical", "M11 P18")
def _(spark, sf):
    return hmm.parameter_table(spark, hmm.fit(_codes(spark, sf), ["code"], hmm.categorical_start(4, 6), rounds=50).ordered())


@query("information_criteria", "M14")
def _(spark, sf):
    f = features(spark, sf)
    ks = list(range(2, 9))
    fitted = hmm.fit_many(f, COLS, [(COLS, m) for m in models.gaussian_starts(f, [(COLS, k) for k in ks])], rounds=100)
    n = f.count()
    return evaluate.information_criteria(spark.createDataFrame([(k, len(COLS), m.trace[-1], n) for k, m in zip(ks, fitted)], "k int, d int, ll double, n long"))


# --- two given states, against recursions in SQL ------------------------------------------------------------------------
START, TRANS = [0.6, 0.4], [[0.9, 0.1], [0.2, 0.8]]
_A = {(i, j): math.log(TRANS[i][j]) for i in (0, 1) for j in (0, 1)}


def _normal(x: str, mean: float, var: float) -> str:
    return f"(-0.5*POWER({x}-{mean!r}, 2)/{var!r} - 0.5*LN({2 * math.pi * var!r}))"


def _plus(a: str, b: str) -> str:
    return f"(GREATEST({a}, {b}) + LN(1 + EXP(-ABS(({a}) - ({b})))))"


def _sql_passes(lb0: str, lb1: str) -> str:
    """Per frame: log forward (a0, a1) and backward (b0, b1) values, their log-emissions (e0, e1) and the track's likelihood ll."""
    f0, f1 = _plus(f"a0 + {_A[0, 0]!r}", f"a1 + {_A[1, 0]!r}"), _plus(f"a0 + {_A[0, 1]!r}", f"a1 + {_A[1, 1]!r}")
    g0, g1 = (_plus(f"x.e0 + r.b0 + {_A[i, 0]!r}", f"x.e1 + r.b1 + {_A[i, 1]!r}") for i in (0, 1))
    return f"""{SQL_LINES}, obs AS MATERIALIZED (SELECT track_id, frame, signal, l_tax, l_returnflag, l_linestatus, {lb0} AS e0, {lb1} AS e1 FROM lines),
    fw AS ( SELECT track_id, frame, {math.log(START[0])!r} + e0 AS a0, {math.log(START[1])!r} + e1 AS a1 FROM obs WHERE frame = 0
      UNION ALL SELECT o.track_id, o.frame, {f0} + o.e0, {f1} + o.e1 FROM fw JOIN obs o ON o.track_id = fw.track_id AND o.frame = fw.frame + 1),
    ends AS MATERIALIZED (SELECT track_id, MAX(frame) AS frame FROM obs GROUP BY 1),
    bw AS ( SELECT track_id, frame, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1 FROM ends
      UNION ALL SELECT x.track_id, x.frame - 1, {g0}, {g1} FROM bw r JOIN obs x ON x.track_id = r.track_id AND x.frame = r.frame WHERE x.frame > 0),
    lls AS MATERIALIZED (SELECT f.track_id, {_plus('f.a0', 'f.a1')} AS ll FROM fw f JOIN ends e ON e.track_id = f.track_id AND e.frame = f.frame),
    post AS MATERIALIZED (SELECT o.track_id, o.frame, o.signal, o.l_tax, o.l_returnflag, o.l_linestatus, e0, e1, a0, a1, b0, b1, ll, EXP(a0 + b0 - ll) AS g0, EXP(a1 + b1 - ll) AS g1
      FROM obs o JOIN fw f ON f.track_id = o.track_id AND f.frame = o.frame JOIN bw b ON b.track_id = o.track_id AND b.frame = o.frame JOIN lls l ON l.track_id = o.track_id)"""


def _sql_update(extra: str) -> str:
    """Start, transitions and ``extra`` after one update, and the likelihood before it."""
    pair = {(i, j): f"EXP(p.a{i} + {_A[i, j]!r} + q.e{j} + q.b{j} - q.ll)" for i, j in _A}
    return f"""xs AS (SELECT {', '.join(f"SUM({e}) AS x{i}{j}" for (i, j), e in pair.items())} FROM post p JOIN post q ON q.track_id = p.track_id AND q.frame = p.frame + 1),
    st AS (SELECT SUM(g0) AS s0, SUM(g1) AS s1 FROM post WHERE frame = 0), lt AS (SELECT SUM(ll) AS ll FROM lls),
    u AS (SELECT 'trace' AS kind, 0 AS i, 0 AS j, ll AS value FROM lt UNION ALL SELECT 'start', 0, 0, s0/(s0+s1) FROM st UNION ALL SELECT 'start', 1, 0, s1/(s0+s1) FROM st
    UNION ALL SELECT 'trans', 0, 0, x00/(x00+x01) FROM xs UNION ALL SELECT 'trans', 0, 1, x01/(x00+x01) FROM xs
    UNION ALL SELECT 'trans', 1, 0, x10/(x10+x11) FROM xs UNION ALL SELECT 'trans', 1, 1, x11/(x10+x11) FROM xs {extra})"""


def _given(emission) -> hmm.HMM:
    return hmm.HMM(np.array(START), np.array(TRANS), emission)


def _updated(spark, model, extra):
    """One update of the given model as rows, with the likelihood before it."""
    t = hmm.parameter_table(spark, model).where("kind in ('start', 'trans') or (kind = 'trace' and i = 0)")
    return t.unionByName(spark.createDataFrame([(k, i, j, float(v)) for k, i, j, v in extra], "kind string, i int, j int, value double"))


TAX = "(l_tax * 100)"
_ONE = _sql_passes(_normal("signal", 15.0, 90.0), _normal("signal", 35.0, 90.0))
_TWO = _sql_passes(f"{_normal('signal', 15.0, 90.0)} + {_normal(TAX, 2.0, 6.0)}", f"{_normal('signal', 35.0, 90.0)} + {_normal(TAX, 5.0, 6.0)}")


def _one(spark, sf):
    return stored(bind.line_tracks(spark, sf)), _given(hmm.GaussianEmission(np.array([[15.0], [35.0]]), np.full((2, 1, 1), 90.0)))


def _two(spark, sf, diagonal):
    t = bind.line_tracks(spark, sf, "l_tax").withColumn("tax", F.col("l_tax") * 100)
    return stored(t), _given(hmm.GaussianEmission(np.array([[15.0, 2.0], [35.0, 5.0]]), np.stack([np.diag([90.0, 6.0])] * 2), diagonal))


_MOMENTS = " ".join(f"""UNION ALL SELECT 'mean', {k}, 0, SUM(g{k}*signal)/SUM(g{k}) FROM post UNION ALL SELECT 'mean', {k}, 1, SUM(g{k}*{TAX})/SUM(g{k}) FROM post
    UNION ALL SELECT 'var', {k}, 0, SUM(g{k}*signal*signal)/SUM(g{k}) - POWER(SUM(g{k}*signal)/SUM(g{k}), 2) + 0.001 FROM post
    UNION ALL SELECT 'cov', {k}, 0, SUM(g{k}*signal*{TAX})/SUM(g{k}) - SUM(g{k}*signal)/SUM(g{k})*SUM(g{k}*{TAX})/SUM(g{k}) FROM post""" for k in (0, 1))


def _moments(m):
    e = m.emission
    return [x for k in (0, 1) for x in (("mean", k, 0, e.means[k, 0]), ("mean", k, 1, e.means[k, 1]), ("var", k, 0, e.covs[k, 0, 0]), ("cov", k, 0, e.covs[k, 0, 1]))]


@query("hmm_update", "M7 M8", f"WITH RECURSIVE {_TWO}, {_sql_update(_MOMENTS)} SELECT * FROM u", "value:5")
def _(spark, sf):
    t, m = _two(spark, sf, False)
    m = hmm.fit(t, ["signal", "tax"], m, rounds=1, tol=-1e9)
    return _updated(spark, m, _moments(m))


@query("hmm_update_diagonal", "M9", f"""WITH RECURSIVE {_TWO}, {_sql_update(_MOMENTS)} SELECT kind, i, j,
    CASE WHEN kind = 'cov' THEN 0 WHEN kind = 'start' THEN CASE WHEN i = 0 THEN {START[0]} ELSE {START[1]} END ELSE value END AS value FROM u""", "value:5")
def _(spark, sf):
    t, m = _two(spark, sf, True)
    m = hmm.fit(t, ["signal", "tax"], m, rounds=1, tol=-1e9, fix_start=True)
    return _updated(spark, m, _moments(m))


_EMIT = {(k, c): round((1 + 0.5 * math.cos(k + c)) / sum(1 + 0.5 * math.cos(k + d) for d in range(6)), 6) for k in (0, 1) for c in range(6)}
_CODE = "(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END * 2 + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END)"
_CASE = [f"LN(CASE {_CODE} " + " ".join(f"WHEN {c} THEN {_EMIT[k, c]!r}" for c in range(6)) + " END)" for k in (0, 1)]
_TABLE = " ".join(f"UNION ALL SELECT 'emission', {k}, {c}, SUM(CASE WHEN {_CODE} = {c} THEN g{k} ELSE 0 END)/SUM(g{k}) FROM post" for k in (0, 1) for c in range(6))


@query("hmm_update_categorical", "M11 P18", f"WITH RECURSIVE {_sql_passes(*_CASE)}, {_sql_update(_TABLE)} SELECT * FROM u", "value")
def _(spark, sf):
    m = hmm.fit(_codes(spark, sf), ["code"], _given(hmm.CategoricalEmission(np.array([[_EMIT[k, c] for c in range(6)] for k in (0, 1)]))), rounds=1, tol=-1e9)
    return _updated(spark, m, [("emission", k, c, m.emission.table[k, c]) for k in (0, 1) for c in range(6)])


_MIX = [f"LN(0.3*EXP({_normal('signal', a, 40.0)}) + 0.7*EXP({_normal('signal', b, 60.0)}))" for a, b in ((8.0, 20.0), (30.0, 42.0))]
_COMPONENTS = " ".join(f"""UNION ALL SELECT 'weight', {k}, {c}, SUM(g{k}*{w}*EXP({_normal('signal', m, v)} - e{k}))/SUM(g{k}) FROM post
    UNION ALL SELECT 'mean', {k}, {c}, SUM(g{k}*EXP({_normal('signal', m, v)} - e{k})*signal)/SUM(g{k}*EXP({_normal('signal', m, v)} - e{k})) FROM post"""
                       for k, pair in enumerate(((8.0, 20.0), (30.0, 42.0))) for c, (w, m, v) in enumerate(((0.3, pair[0], 40.0), (0.7, pair[1], 60.0))))


@query("hmm_update_mixture", "M10", f"WITH RECURSIVE {_sql_passes(*_MIX)}, {_sql_update(_COMPONENTS)} SELECT * FROM u", "value")
def _(spark, sf):
    e = hmm.MixtureEmission([[0.3, 0.7]] * 2, [[[8.0], [20.0]], [[30.0], [42.0]]], [[[[40.0]], [[60.0]]]] * 2)
    m = hmm.fit(bind.line_tracks(spark, sf), ["signal"], _given(e), rounds=1, tol=-1e9)
    return _updated(spark, m, [x for k in (0, 1) for c in (0, 1) for x in (("weight", k, c, m.emission.weights[k, c]), ("mean", k, c, m.emission.means[k, c, 0]))])


@query("hmm_likelihood", "M8 M14", f"""WITH RECURSIVE {_ONE} SELECT track_id, ll, 2 * 5 - 2 * ll AS aic FROM lls""", "ll aic")
def _(spark, sf):
    t, m = _one(spark, sf)
    ll = hmm.log_likelihood(t, ["signal"], m).select("track_id", "ll", F.lit(2).alias("k"), F.lit(1).alias("d"), F.lit(1).alias("n"))
    # 1 start, 2 transitions, 2 means, 2 variances
    return evaluate.information_criteria(ll).select("track_id", "ll", (F.col("aic") - 2 * F.col("params") + 10).alias("aic"))


def _sql_criteria(passes: str, params: int) -> str:
    return (f"WITH RECURSIVE {passes}, c AS (SELECT track_id, COUNT(*) AS n FROM obs GROUP BY 1) "
            f"SELECT track_id, n, {params} AS params, ll, 2 * {params} - 2 * ll AS aic, {params} * LN(n) - 2 * ll AS bic FROM lls JOIN c USING (track_id)")


def _criteria(tracks, model, features):
    """Per track: frames, free parameters, log-likelihood and criteria of a two-state model with full covariances."""
    n = tracks.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    ll = hmm.log_likelihood(tracks, features, model).select("track_id", "ll", F.lit(2).alias("k"), F.lit(len(features)).alias("d")).join(n, "track_id")
    return evaluate.information_criteria(ll).select("track_id", "n", F.col("params").cast("int").alias("params"), "ll", "aic", "bic")


# 1 start, 2 transitions, 2 means, 2 variances
@query("model_criteria", "M14 M8", _sql_criteria(_ONE, 7), "ll aic bic")
def _(spark, sf):
    return _criteria(*_one(spark, sf), ["signal"])


# 1 start, 2 transitions, 4 means, 3 entries of each of 2 covariances
@query("model_criteria_two_features", "M14 M7", _sql_criteria(_TWO, 13), "ll aic bic")
def _(spark, sf):
    return _criteria(*_two(spark, sf, False), ["signal", "tax"])


@query("hmm_smooth", "M13", f"WITH RECURSIVE {_ONE} SELECT track_id, frame, g0 * 15 + g1 * 35 AS smooth, CASE WHEN g1 > g0 THEN 1 ELSE 0 END AS state FROM post", "smooth")
def _(spark, sf):
    t, m = _one(spark, sf)
    return hmm.decode(t, ["signal"], m, ("smooth", "posterior")).select("track_id", "frame", F.col("smooth")[0].alias("smooth"), "state")


_STEP = {j: (f"d0 + {_A[0, j]!r}", f"d1 + {_A[1, j]!r}") for j in (0, 1)}


@query("hmm_path", "M12", f"""WITH RECURSIVE {_ONE[:_ONE.index('fw AS')].rstrip(' ,' + chr(10))}, ends AS MATERIALIZED (SELECT track_id, MAX(frame) AS frame FROM obs GROUP BY 1),
    v AS ( SELECT track_id, frame, {math.log(START[0])!r} + e0 AS d0, {math.log(START[1])!r} + e1 AS d1, 0 AS p0, 0 AS p1 FROM obs WHERE frame = 0
      UNION ALL SELECT o.track_id, o.frame, GREATEST({_STEP[0][0]}, {_STEP[0][1]}) + o.e0, GREATEST({_STEP[1][0]}, {_STEP[1][1]}) + o.e1,
        CASE WHEN {_STEP[0][1]} > {_STEP[0][0]} THEN 1 ELSE 0 END, CASE WHEN {_STEP[1][1]} > {_STEP[1][0]} THEN 1 ELSE 0 END FROM v JOIN obs o ON o.track_id = v.track_id AND o.frame = v.frame + 1),
    vt AS MATERIALIZED (SELECT * FROM v),
    w AS ( SELECT t.track_id, t.frame, CASE WHEN d1 > d0 THEN 1 ELSE 0 END AS state FROM vt t JOIN ends e ON e.track_id = t.track_id AND e.frame = t.frame
      UNION ALL SELECT t.track_id, t.frame - 1, CASE WHEN w.state = 1 THEN t.p1 ELSE t.p0 END FROM w JOIN vt t ON t.track_id = w.track_id AND t.frame = w.frame WHERE t.frame > 0)
    SELECT track_id, frame, state FROM w""")
def _(spark, sf):
    t, m = _one(spark, sf)
    return hmm.decode(t, ["signal"], m)


# --- classifiers ----------------------------------------------------------------------------------------------------------
#: Rows that fit a classifier: tracks whose number leaves 0 to 5 by 8, so three quarters of any table train.
TRAIN = "track_id % 8 < 6"


def _classed(spark, sf):
    f = features(spark, sf)
    return f.withColumns({"class3": F.expr("CASE WHEN signal > 0.8 THEN 2 WHEN l_tax > 0.8 THEN 1 ELSE 0 END"), "state": F.expr("CASE WHEN l_discount > 0 THEN 1 ELSE 0 END")})


@query("logistic_states", "M16 E6")
def _(spark, sf):
    c = stored(_classed(spark, sf))
    out = None
    for states in ("state", None):
        _, predict = models.logistic(c.where(TRAIN), ["l_discount", "l_tax"], "class3", states)
        part = evaluate.confusion(predict(c.where(f"NOT {TRAIN}")), "class3", "pred").withColumn("with_states", F.lit(states is not None))
        out = part if out is None else out.unionByName(part)
    return out


@query("boosted_stumps", "M17 E7")
def _(spark, sf):
    c = stored(_manual(_classed(spark, sf)))
    score = models.boosted_stumps(c.where(TRAIN), ["signal", "l_tax"], "manual")
    return evaluate.operating_point(evaluate.roc_points(score(c.where(f"NOT {TRAIN}")), "score", "manual"), 0.2)


@query("tree_cuts", "M18")
def _(spark, sf):
    """The class is a noisy step function of the price with three levels; two cuts are found."""
    t = bind.line_tracks(spark, sf, "l_extendedprice", "l_partkey").select((F.col("l_extendedprice") / 1000).alias("price"), (F.col("l_partkey") % 10).alias("noise"))
    t = t.withColumn("class3", F.when(F.col("noise") == 0, 0).when(F.col("price") < 20, 0).when(F.col("price") < 45, 1).otherwise(2))
    cuts = models.cut_points(stored(t), "price", "class3", least=100)  # a tree reads its rows several times
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(cuts)], "i int, threshold double")


@query("curvedness", "R19 R10 M2 M4")
def _(spark, sf):
    r = computed(bind.rings(spark, sf), {"cosines": ring.cosine_scores("pts", 5)})
    r = computed(r, {"top": ring.top_scores("cosines", 10)}).select("track_id", "frame", "top")
    return models.curvedness(r, "top", 10)[0]


@query("subset_search", "E9 T1")
def _(spark, sf):
    """All subsets of the optional features, ten updates a model and two repeats."""
    f = stored(_manual(features(spark, sf)))
    return models.subset_search(f, ["signal"], ["l_discount", "l_tax"], "manual", rounds=10)
