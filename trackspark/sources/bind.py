"""The given tables read as tracks, poses, outlines, bouts and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunk import computed, number_frames, windowed
from .schema import PARTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_tracks(spark, sf_dir, *extra: str) -> DataFrame:
    """track_id, frame, signal (+ event columns): one track per user, frames in time order."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"), F.col("value").alias("signal"), "ts", "event_id", *extra)
    hours = {"day": F.to_date("ts"), "hour": F.hour("ts")}
    return number_frames(e, "track_id", ["ts", "event_id"], hours).select("track_id", "frame", "signal", *extra)


def gap_tracks(spark, sf_dir) -> DataFrame:
    """Event tracks whose signal is null wherever it jumps by more than 60."""
    return windowed(
        event_tracks(spark, sf_dir),
        lambda w: {"signal": F.when(F.abs(F.col("signal") - F.lag("signal").over(w)) > 60, None).otherwise(F.col("signal"))},
        before=1)


def line_tracks(spark, sf_dir, *extra: str) -> DataFrame:
    """track_id, frame, signal: one longer track per supplier."""
    cols = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("track_id"), *{*cols, *extra})
    buckets = {"day": F.col("l_shipdate"), "orders": F.expr("l_orderkey div 1000000")}
    return number_frames(li, "track_id", cols, buckets).select(
        "track_id", "frame", F.col("l_quantity").alias("signal"), *extra)


def numbered_vectors(spark, sf_dir) -> DataFrame:
    """track_id (label), frame, vec_id, embedding."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("track_id"), "vec_id", "embedding")
    return number_frames(e, "track_id", ["vec_id"], {"ids": F.expr("vec_id div 65536")})


def _emb(i: int):
    return F.element_at("embedding", i).cast("double")


def pose(spark, sf_dir, parts=PARTS) -> DataFrame:
    """Wide pose table: track_id, frame and <part>_x, <part>_y, <part>_l per part."""
    cols = []
    for part in parts:
        p = PARTS.index(part)
        cols += [
            (F.lit(250.0) + F.lit(1000.0) * _emb(2 * p + 1)).alias(f"{part}_x"),
            (F.lit(250.0) + F.lit(1000.0) * _emb(2 * p + 2)).alias(f"{part}_y"),
            F.least(F.lit(1.0), F.lit(0.5) + F.lit(4.0) * F.abs(_emb(33 + p))).alias(f"{part}_l"),
        ]
    return numbered_vectors(spark, sf_dir).select("track_id", "frame", *cols)


def rings(spark, sf_dir) -> DataFrame:
    """One closed 32-point outline per vector: track_id, frame, pts array<struct<x,y>>."""
    point = """transform(sequence(0, 31), k -> named_struct(
        'x', 250D + (100D + 200D * cast(element_at(embedding, k + 1) as double)) * cos(2 * pi() * k / 32),
        'y', 250D + (100D + 200D * cast(element_at(embedding, k + 1) as double)) * sin(2 * pi() * k / 32)))"""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("track_id"), F.col("vec_id").alias("frame"), "embedding")
    return computed(e, {"pts": F.expr(point)}).drop("embedding")


def bouts(spark, sf_dir) -> DataFrame:
    """Half-open [start, stop) intervals over the event tracks, one per purchase."""
    t = event_tracks(spark, sf_dir, "event_type", "props").where("event_type = 'purchase'")
    k = F.get_json_object("props", "$.k").cast("long")
    return t.select("track_id", F.lit("purchase").alias("behaviour"), F.col("frame").alias("start"),
                    (F.col("frame") + 1 + k % 10).alias("stop"))


def scores(spark, sf_dir) -> DataFrame:
    """frame, manual (0/1), class3 (0..2), score from the labelled documents."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id").select(
        F.col("doc_id").alias("frame"), F.col("quality").alias("manual"),
        F.expr("CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END").alias("class3"),
        F.col("n_chars").cast("double").alias("score"), "lang", "source")


# The same bindings as SQL for the checks.
SQL_EVENTS = """tracks AS (SELECT user_id AS track_id,
    ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS signal, event_type, props FROM events)"""
SQL_GAPS = SQL_EVENTS + """, gaps AS (SELECT track_id, frame,
    CASE WHEN ABS(signal - LAG(signal) OVER (PARTITION BY track_id ORDER BY frame)) > 60 THEN NULL ELSE signal END AS signal FROM tracks)"""
SQL_LINES = """lines AS (SELECT l_suppkey AS track_id, ROW_NUMBER() OVER (PARTITION BY l_suppkey
    ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS frame,
    l_quantity AS signal, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem)"""


def _sql_pose() -> str:
    cols = []
    for p, part in enumerate(PARTS):
        cols += [f"250 + 1000 * CAST(embedding[{2 * p + 1}] AS DOUBLE) AS {part}_x",
                 f"250 + 1000 * CAST(embedding[{2 * p + 2}] AS DOUBLE) AS {part}_y",
                 f"LEAST(CAST(1 AS DOUBLE), CAST(0.5 AS DOUBLE) + 4 * ABS(CAST(embedding[{33 + p}] AS DOUBLE))) AS {part}_l"]
    return ("pose AS (SELECT CAST(label AS BIGINT) AS track_id, ROW_NUMBER() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, "
            + ", ".join(cols) + " FROM embeddings)")


SQL_POSE = _sql_pose()
SQL_RINGS = """ring AS (SELECT CAST(label AS BIGINT) AS track_id, vec_id AS frame, CAST(k AS BIGINT) AS pt, 32 AS n_pts,
    250 + (100 + 200 * CAST(embedding[CAST(k+1 AS INT)] AS DOUBLE)) * COS(2*PI()*k/32) AS x,
    250 + (100 + 200 * CAST(embedding[CAST(k+1 AS INT)] AS DOUBLE)) * SIN(2*PI()*k/32) AS y
    FROM (SELECT label, vec_id, embedding, UNNEST(generate_series(0, 31)) AS k FROM embeddings) q)"""
SQL_BOUTS = SQL_EVENTS + """, bouts AS (SELECT track_id, 'purchase' AS behaviour, frame AS start,
    frame + 1 + CAST(json_extract_string(props, '$.k') AS INT) % 10 AS stop FROM tracks WHERE event_type = 'purchase')"""
SQL_SCORES = """scores AS (SELECT l.doc_id AS frame, l.quality AS manual,
    CASE WHEN l.toxic = 1 THEN 2 WHEN l.quality = 1 THEN 1 ELSE 0 END AS class3,
    CAST(d.n_chars AS DOUBLE) AS score, d.lang, d.source FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
