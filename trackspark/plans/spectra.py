"""Queries over spectra."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import intervals, series, spectral
from ..operators.chunk import windowed
from ..sources import bind
from ..sources.bind import SQL_BOUTS, SQL_LINES
from ..sources.tables import stored
from .registry import query


def _coef(n: int, bins: int, scale: str) -> str:
    h = f"(0.5 - 0.5*COS(2*PI()*o/{n}))"
    return (f"co AS (SELECT o, k, {h}*COS(2*PI()*((o*k)%{n})/{n}) / {scale} AS c, {h}*SIN(2*PI()*((o*k)%{n})/{n}) / {scale} AS s "
            f"FROM (SELECT UNNEST(generate_series(0, {n - 1})) AS o) a, (SELECT UNNEST(generate_series(0, {bins - 1})) AS k) b)")


# hop-1 spectrum of 70 rows: centre frame t+35, 36 bins
SQL_STFT = f"""{SQL_LINES}, {_coef(70, 36, '35.0')}, n AS (SELECT track_id, COUNT(*) AS n FROM lines GROUP BY 1),
    pr AS (SELECT l.track_id, l.frame - o.o + 35 AS frame, o.o AS o, l.signal FROM lines l, (SELECT UNNEST(generate_series(0, 69)) AS o) o),
    ok AS (SELECT pr.* FROM pr JOIN n USING (track_id) WHERE frame >= 35 AND frame <= n.n - 35),
    sp AS (SELECT track_id, frame, k, SQRT(SUM(signal*c)*SUM(signal*c) + SUM(signal*s)*SUM(signal*s)) AS mag FROM ok JOIN co USING (o) GROUP BY 1, 2, 3)"""


@query("stft_bins", "Q1", f"WITH {SQL_STFT} SELECT track_id, k AS bin, COUNT(*) AS frames, AVG(mag) AS mean, MAX(mag) AS top FROM sp GROUP BY 1, 2", "mean top")
def _(spark, sf):
    s = spectral.stft(bind.line_tracks(spark, sf), "signal")
    b = s.select("track_id", F.posexplode("mags").alias("bin", "mag"))
    return b.groupBy("track_id", F.col("bin").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("frames"), F.avg("mag").alias("mean"), F.max("mag").alias("top"))


@query("freq_score", "Q4 Q1 F21 F22", f"""WITH {SQL_STFT}, sc AS (SELECT track_id, frame, SUM(CASE WHEN k > 3.5 AND k < 17.5 THEN k*40.0/70*mag ELSE 0 END) / NULLIF(SUM(CASE WHEN k >= 2 THEN mag ELSE 0 END), 0)
    * POWER(LEAST(1.0, MAX(CASE WHEN k > 3.5 AND k < 17.5 THEN mag END) / 4), 2) AS mean_score FROM sp GROUP BY 1, 2)
    SELECT l.track_id, l.frame, mean_score FROM lines l LEFT JOIN sc USING (track_id, frame)""", "mean_score")
def _(spark, sf):
    return spectral.frequency_scores(bind.line_tracks(spark, sf), "signal").select("track_id", "frame", "mean_score")


def _sql_peaks(rounds: int = 12) -> str:
    """Peaks in the order of their height; each closes the peaks less than three bins away."""
    steps = []
    for i in range(rounds):
        steps.append(f"k{i} AS (SELECT track_id, frame, ARG_MAX(k, v) AS k, MAX(v) AS v FROM o{i} GROUP BY 1, 2)")
        steps.append(f"o{i + 1} AS (SELECT o.track_id, o.frame, o.k, o.v FROM o{i} o JOIN k{i} b ON b.track_id = o.track_id AND b.frame = o.frame WHERE ABS(o.k - b.k) >= 3)")
    return ", ".join(steps) + ", kept AS (" + " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(rounds)) + ")"


@query("freq_score_peak", "Q3 F21 F22", f"""WITH {SQL_STFT}, lo AS (SELECT track_id, frame, k, mag / NULLIF(MAX(mag) OVER (PARTITION BY track_id, frame), 0) AS v FROM sp WHERE k >= 2),
    nb AS (SELECT *, LAG(v) OVER (PARTITION BY track_id, frame ORDER BY k) AS a, LEAD(v) OVER (PARTITION BY track_id, frame ORDER BY k) AS b FROM lo),
    o0 AS (SELECT track_id, frame, k, v FROM nb WHERE v > a AND v > b AND v >= 0.2), {_sql_peaks()},
    am AS (SELECT track_id, frame, POWER(LEAST(1.0, MAX(CASE WHEN k > 3.5 AND k < 17.5 THEN mag END) / 3), 2) AS amp FROM sp GROUP BY 1, 2),
    ps AS (SELECT track_id, frame, MAX(CASE WHEN k*40.0/70 > 10 OR k*40.0/70 <= 2 THEN 0 WHEN k*40.0/70 > 5 THEN 5 ELSE k*40.0/70 END * v) AS best FROM kept GROUP BY 1, 2)
    SELECT l.track_id, l.frame, CASE WHEN am.amp IS NOT NULL THEN COALESCE(best, 0) * amp END AS peak_score FROM lines l LEFT JOIN am USING (track_id, frame) LEFT JOIN ps USING (track_id, frame)""", "peak_score")
def _(spark, sf):
    return spectral.frequency_scores(bind.line_tracks(spark, sf), "signal").select("track_id", "frame", "peak_score")


# a signal with nulls and missing frames: every null or missing frame repeats the value before it
SQL_HOLES = SQL_STFT.replace("pr AS (SELECT l.track_id, l.frame - o.o + 35 AS frame, o.o AS o, l.signal FROM lines l", """seen AS (SELECT track_id, frame, CASE WHEN l_extendedprice % 7 >= 1 THEN signal END AS signal FROM lines WHERE frame = 0 OR frame % 11 <> 5),
    held AS (SELECT l.track_id, l.frame, COALESCE(LAST_VALUE(s.signal IGNORE NULLS) OVER (PARTITION BY l.track_id ORDER BY l.frame), 0) AS signal FROM lines l LEFT JOIN seen s ON s.track_id = l.track_id AND s.frame = l.frame),
    n2 AS (SELECT track_id, MAX(frame) + 1 AS n FROM seen GROUP BY 1), pr AS (SELECT l.track_id, l.frame - o.o + 35 AS frame, o.o AS o, l.signal FROM held l""").replace("ok AS (SELECT pr.* FROM pr JOIN n USING (track_id) WHERE frame >= 35 AND frame <= n.n - 35)", "ok AS (SELECT pr.* FROM pr JOIN n2 USING (track_id) WHERE frame >= 35 AND frame <= n2.n - 35)")


@query("freq_score_gaps", "Q4 Q1 W8", f"""WITH {SQL_HOLES}, sc AS (SELECT track_id, frame, SUM(CASE WHEN k > 3.5 AND k < 17.5 THEN k*40.0/70*mag ELSE 0 END) / NULLIF(SUM(CASE WHEN k >= 2 THEN mag ELSE 0 END), 0)
    * POWER(LEAST(1.0, MAX(CASE WHEN k > 3.5 AND k < 17.5 THEN mag END) / 4), 2) AS mean_score FROM sp GROUP BY 1, 2)
    SELECT l.track_id, l.frame, mean_score FROM seen l LEFT JOIN sc USING (track_id, frame)""", "mean_score")
def _(spark, sf):
    t = bind.line_tracks(spark, sf, "l_extendedprice").where("frame = 0 OR frame % 11 <> 5")
    t = t.select("track_id", "frame", F.when(F.col("l_extendedprice") % 7 >= 1, F.col("signal")).alias("signal"))
    return spectral.frequency_scores(t, "signal").select("track_id", "frame", "mean_score")


# padded blocks of 100 rows every 50
SQL_BLOCK = f"""{SQL_LINES}, {_coef(100, 51, '50.0')}, n AS (SELECT track_id, COUNT(*) AS n FROM lines GROUP BY 1),
    pr AS (SELECT l.track_id, x.c AS col, l.frame - x.c * 50 + 50 AS o, l.signal FROM lines l, LATERAL (SELECT UNNEST([l.frame // 50, l.frame // 50 + 1]) AS c) x),
    ok AS (SELECT pr.* FROM pr JOIN n USING (track_id) WHERE o >= 0 AND o < 100 AND (col - 1) * 50 < n.n),
    sp AS (SELECT track_id, col, k, SQRT(SUM(signal*c)*SUM(signal*c) + SUM(signal*s)*SUM(signal*s)) AS mag FROM ok JOIN co USING (o) GROUP BY 1, 2, 3),
    sc AS (SELECT track_id, col, SUM(CASE WHEN k*0.4 > 1.5 AND k*0.4 < 5 THEN k*0.4*k*0.4*mag ELSE 0 END) / NULLIF(SUM(mag), 0) AS score FROM sp GROUP BY 1, 2)"""


@query("block_score", "Q2 F21", f"WITH {SQL_BLOCK} SELECT * FROM sc", "score")
def _(spark, sf):
    return spectral.block_scores(bind.line_tracks(spark, sf), "signal")


@query("block_score_frames", "W26 Q2", f"""WITH {SQL_BLOCK}, la AS (SELECT track_id, MAX(col) AS last FROM sc GROUP BY 1), st AS (SELECT sc.*, CASE WHEN col = 0 THEN 0 ELSE col * 50 - 25 END AS s0, CASE WHEN col = 0 OR col = last THEN 25 ELSE 50 END AS len FROM sc JOIN la USING (track_id))
    SELECT track_id, s0 + j AS frame, score FROM (SELECT *, UNNEST(generate_series(0, len - 1)) AS j FROM st) q""", "score")
def _(spark, sf):
    return series.repeat_columns(spectral.block_scores(bind.line_tracks(spark, sf), "signal"))


@query("welch_power", "Q6", f"""WITH {SQL_LINES}, {_coef(64, 33, '1.0')}, n AS (SELECT track_id, COUNT(*) AS n FROM lines GROUP BY 1),
    pr AS (SELECT l.track_id, x.c AS seg, l.frame - x.c * 32 AS o, l.signal FROM lines l, LATERAL (SELECT UNNEST([l.frame // 32 - 1, l.frame // 32]) AS c) x),
    ok AS (SELECT pr.* FROM pr JOIN n USING (track_id) WHERE seg >= 0 AND seg * 32 + 64 <= n.n), mu AS (SELECT track_id, seg, AVG(signal) AS m FROM ok GROUP BY 1, 2),
    sp AS (SELECT track_id, seg, k, SUM((signal-m)*c) AS re, SUM((signal-m)*s) AS im FROM ok JOIN mu USING (track_id, seg) JOIN co USING (o) GROUP BY 1, 2, 3)
    SELECT track_id, k AS bin, AVG(re*re+im*im) / (40 * 24.0) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS power FROM sp GROUP BY 1, 2""", "power")
def _(spark, sf):
    return spectral.welch(bind.line_tracks(spark, sf), "signal").withColumn("bin", F.col("bin").cast("long"))


@query("bout_dft_score", "Q5 J4 F21", f"""WITH {SQL_BOUTS}, r AS (SELECT b.track_id, b.start, t.frame - b.start AS pos, t.signal, COUNT(*) OVER (PARTITION BY b.track_id, b.start) AS n FROM bouts b JOIN tracks t ON t.track_id = b.track_id AND t.frame BETWEEN b.start AND b.stop),
    k AS (SELECT *, UNNEST(generate_series(1, (n-1)//2)) AS k FROM r), s AS (SELECT track_id, start, n, k, SUM(signal*COS(2*PI()*((k*pos)%n)/n)) AS re, SUM(signal*SIN(2*PI()*((k*pos)%n)/n)) AS im FROM k GROUP BY 1, 2, 3, 4),
    m AS (SELECT *, SQRT(re*re+im*im) AS mag, k*40.0/n AS f FROM s) SELECT track_id, start, n, SUM(CASE WHEN f > 1.5 AND f < 5 THEN mag*f*f ELSE 0 END) / NULLIF(SUM(mag), 0) AS score FROM m GROUP BY 1, 2, 3""", "score")
def _(spark, sf):
    rows = intervals.bout_rows(bind.event_tracks(spark, sf), bind.bouts(spark, sf), closed=True).drop("_chunk")
    size = rows.groupBy("track_id", "start").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(size, ["track_id", "start"]).withColumn("pos", F.col("frame") - F.col("start"))
    return spectral.bout_dft_scores(rows, "signal")


SQL_SINE = f"{SQL_LINES}, le AS (SELECT DISTINCT track_id, frame // 400 AS period FROM lines)"


def _sine(spark, sf):
    t = windowed(bind.line_tracks(spark, sf), lambda w: {"signal": F.avg("signal").over(w.rowsBetween(-3, 0))}, before=3)
    return t.withColumn("period", F.expr("frame div 400")).select("track_id", "period", "frame", "signal")


@query("sine_value", "F20", f"""WITH {SQL_LINES}, sm AS (SELECT track_id, frame // 400 AS period, frame, AVG(signal) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS signal FROM lines)
    SELECT track_id, period, frame, ABS(signal - (30 * SIN((1 + track_id % 5) / 20.0::DOUBLE * frame + (period + 1) / 2.0::DOUBLE) + 25)) AS sine_error FROM sm""", "sine_error")
def _(spark, sf):
    """Distance to the sine of given parameters, which differ by track and period."""
    from ..operators.models import sine_error

    t = _sine(spark, sf)
    given = t.select("track_id", "period").distinct().withColumns({"b": (F.col("track_id") % 5 + 1) / 20, "c": (F.col("period") + 1) / 2, "d": F.lit(25.0)})
    return sine_error(t, "signal", given, keys=("track_id", "period")).select("track_id", "period", "frame", "sine_error")


#: Periods whose rows, 400 frames each, are searched at a time.
PERIODS = 40


def _least_on_grid(t):
    """track_id, period, least: the least variance of what is left of the values beside 20 x 24 given sines, each taken away in full."""

    def search(key, rows):
        period, frame, v = (rows.column(c).to_numpy() for c in ("period", "frame", "signal"))
        by = np.argsort(period, kind="stable")
        frame, v = frame[by].astype(float), v[by]
        first = np.concatenate([[0], np.flatnonzero(np.diff(period[by])) + 1])
        n, phases = np.diff(np.append(first, len(v))), np.pi * np.arange(-11, 13)[:, None] / 12
        least = np.full(len(first), np.inf)
        for b in range(1, 41, 2):
            # sin(bt + c) by the sine and cosine of bt
            rest = v - 30 * (np.sin(b / 200 * frame) * np.cos(phases) + np.cos(b / 200 * frame) * np.sin(phases))
            rest -= np.repeat(np.add.reduceat(rest, first, axis=1) / n, n, axis=1)
            rest *= rest
            least = np.minimum(least, (np.add.reduceat(rest, first, axis=1) / n).min(axis=0))
        track = rows.column("track_id").take(pa.array(by[first]))
        return pa.table({"track_id": track, "period": pa.array(period[by][first]), "least": pa.array(least)})

    whole = t.where("track_id IS NOT NULL AND signal IS NOT NULL").withColumn("_part", F.expr(f"period div {PERIODS}"))
    return whole.groupBy("track_id", "_part").applyInArrow(search, T.StructType([t.schema["track_id"], t.schema["period"], T.StructField("least", T.DoubleType())]))


@query("sine_fit", "M19 F20", f"WITH {SQL_SINE} SELECT track_id, period, TRUE AS no_worse, TRUE AS own_error, TRUE AS far_from_mean FROM le")
def _(spark, sf):
    """Whether the fit is no worse than the best of a grid (searched by other means here), its error that of its values, its
    differences centred."""
    from ..operators.models import sine_error, sine_fit

    t = stored(_sine(spark, sf))
    fit = stored(sine_fit(t, "signal", keys=("track_id", "period")))
    value = sine_error(t, "signal", fit, keys=("track_id", "period"))
    own = value.groupBy("track_id", "period").agg(F.avg(F.col("sine_error") ** 2).alias("own"), F.max("error").alias("error"))
    least = _least_on_grid(t)
    return own.join(least, ["track_id", "period"]).select("track_id", "period", (F.col("error") <= F.col("least") + 1e-6).alias("no_worse"),
                                                          (F.abs(F.col("own") - F.col("error")) < 1e-6).alias("own_error"), (F.col("error") >= 0).alias("far_from_mean"))
