"""Queries that drain a stream over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import label as L
from ..sources import bind
from ..streaming import live
from .registry import query
from .spines import SQL_CHECKED


def events(spark, sf):
    """The event table as a stream that can be closed, and its columns as a track."""
    feed = live.Feed(spark, f"{sf}/events.parquet*", bind.table(spark, sf, "events").schema)
    return feed, feed.rows.select(F.col("user_id").alias("track_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("signal"))


@query("stream_loop_rates", "Z1 A5", f"""WITH w AS (SELECT user_id AS track_id, TIME_BUCKET(INTERVAL 6 HOURS, ts) AS s, value FROM events)
    SELECT track_id, CAST(EPOCH(s) AS BIGINT) AS loop_start, AVG(CASE WHEN value > 20 AND value < 80 THEN 1 ELSE 0 END) AS rate, COUNT(*) AS frames FROM w GROUP BY 1, 2""", "rate")
def _(spark, sf):
    feed, rows = events(spark, sf)
    r = live.run_available(live.loop_rates(rows, L.in_band("signal", 20, 80), "6 hours", "10 minutes"), feed)
    return r.select("track_id", F.unix_timestamp("loop_start").alias("loop_start"), "rate", "frames")


@query("stream_sessions", "Z3 W21", f"""WITH g AS (SELECT user_id AS track_id, ts, CASE WHEN ts >= LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOURS OR LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
    s AS (SELECT *, SUM(new) OVER (PARTITION BY track_id ORDER BY ts) AS k FROM g), b AS (SELECT track_id, MIN(ts) AS start, MAX(ts) + INTERVAL 2 HOURS AS stop, COUNT(*) AS events FROM s GROUP BY track_id, k)
    SELECT track_id, CAST(EPOCH_US(start) AS BIGINT) AS start, CAST(EPOCH_US(stop) AS BIGINT) AS stop, events FROM b""")
def _(spark, sf):
    feed, rows = events(spark, sf)
    r = live.run_available(live.bout_sessions(rows, "2 hours", "10 minutes"), feed)
    return r.select("track_id", F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "events")


@query("stream_pairs", "Z4 J1", """SELECT l.user_id // 2 AS trial, COUNT(*) AS pairs, SUM(l.value - r.value) AS diff FROM events l JOIN events r
    ON l.user_id % 2 = 0 AND r.user_id = l.user_id + 1 AND r.ts BETWEEN l.ts - INTERVAL 30 MINUTES AND l.ts + INTERVAL 30 MINUTES GROUP BY 1""", "diff")
def _(spark, sf):
    side = lambda odd: events(spark, sf)[1].where(f"track_id % 2 = {odd}").select(F.expr("track_id div 2").alias("trial"), "ts", "signal")
    r = live.run_available(live.joined_pairs(side(0), side(1), ["trial"], "30 minutes", "10 minutes"))
    return r.groupBy("trial").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("l_signal") - F.col("r_signal")).alias("diff"))


@query("stream_position_check", "Z2 C12", SQL_CHECKED)
def _(spark, sf):
    path = live.scratch_dir(spark)
    p = bind.pose(spark, sf, ["A_head"]).select("track_id", "frame", F.timestamp_seconds(F.col("frame") + 1_000_000_000).alias("ts"), F.col("A_head_x").alias("x"), F.col("A_head_y").alias("y"))
    p.write.parquet(path)
    # the files are not in the order of time: nothing of the stored table may count as late
    check = live.position_check(live.read_stream(spark, path, p.schema), max_dist=150, wait="100000 hours")
    return live.run_available(check)
