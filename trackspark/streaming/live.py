"""Stream forms: loop rates, position check, bout sessions, joined pairs. Inputs carry an event time ``ts``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.position import walk
from ..sources.tables import scratch_dir


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class Feed:
    """A folder as a stream that can be closed: ``close`` delivers one last row whose event time lies ahead of all others, which
    moves the watermark past every open window. The row itself stays in its own, never finished window."""

    def __init__(self, spark: SparkSession, path: str, schema, files_per_batch: int = 100):
        self.spark, self.schema, self.end = spark, schema, scratch_dir(spark)
        spark.createDataFrame([], schema).write.parquet(self.end)
        self.rows = read_stream(spark, path, schema, files_per_batch).unionByName(read_stream(spark, self.end, schema))

    def close(self, time: str = "ts") -> None:
        last = self.spark.range(1).select(*[
            (F.lit("9000-01-01").cast("timestamp") if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema])
        last.write.mode("append").parquet(self.end)


def loop_rates(stream: DataFrame, binary: Column, length: str = "27 seconds", late: str = "10 seconds", keys=("track_id",)) -> DataFrame:
    """Mean of ``binary`` per track and tumbling loop, emitted once the watermark has passed the loop."""
    w = stream.withWatermark("ts", late).groupBy(*keys, F.window("ts", length))
    return w.agg(F.avg(binary).alias("rate"), F.count(F.lit(1)).alias("frames")).select(
        *keys, F.col("window.start").alias("loop_start"), F.col("window.end").alias("loop_end"), "rate", "frames")


def bout_sessions(stream: DataFrame, gap: str = "1 seconds", late: str = "10 seconds", keys=("track_id",)) -> DataFrame:
    """Events of a track less than ``gap`` apart form one bout."""
    s = stream.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap))
    return s.agg(F.count(F.lit(1)).alias("events")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "events")


def joined_pairs(left: DataFrame, right: DataFrame, on: list[str], apart: str = "1 seconds", late: str = "10 seconds") -> DataFrame:
    """Rows of two subjects with equal keys and times at most ``apart``; the bound lets old rows leave the state."""
    a = left.withWatermark("ts", late).select(*on, F.col("ts").alias("l_ts"), *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in (*on, "ts")])
    b = right.withWatermark("ts", late).select(*[F.col(c).alias(f"_{c}") for c in on], F.col("ts").alias("r_ts"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in (*on, "ts")])
    same = [F.col(c) == F.col(f"_{c}") for c in on]
    near = F.col("r_ts").between(F.col("l_ts") - F.expr(f"INTERVAL {apart}"), F.col("l_ts") + F.expr(f"INTERVAL {apart}"))
    cond = near
    for s in same:
        cond = cond & s
    return a.join(b, cond).drop(*[f"_{c}" for c in on])


_WALK = "lx double, ly double, rejects long, due long, latest long"
_HELD = "frame long, at long, x double, y double"


class _Check(StatefulProcessor):
    """State of a track: the last accepted point, rejects in a row, the next frame, the latest event time; and a list of the points that came early."""

    def __init__(self, x: str, y: str, max_dist: float, max_counter: int, idle: int, timed: bool):
        self.x, self.y, self.max_dist, self.max_counter, self.idle, self.timed = x, y, max_dist, max_counter, idle, timed

    def init(self, handle) -> None:
        self.handle = handle
        self.walk, self.held = handle.getValueState("walk", _WALK), handle.getListState("held", _HELD)

    def _settle(self, key, points: np.ndarray, state: tuple, until: int) -> pd.DataFrame:
        """Runs the check over the points that are due, and all up to the frame ``until``; keeps the others; sets the timers."""
        lx, ly, rejects, due, latest = state
        points = points[np.argsort(points[:, 0], kind="stable")]
        points = points[points[:, 0] >= due]
        points = points[np.append(True, points[1:, 0] != points[:-1, 0])[: len(points)]]  # of a repeated frame the first to come
        frames = points[:, 0].astype(np.int64)
        late = max(int(np.searchsorted(frames, until, "right")), 0)
        run = frames[late:] == (frames[late - 1] + 1 if late else due) + np.arange(len(frames) - late)
        ready = late + (len(run) if run.all() else int(run.argmin()))
        go, ok = points[:ready], np.zeros(ready, bool)
        cuts = [0, *(np.flatnonzero(np.diff(frames[:ready]) != 1) + 1).tolist(), ready] if ready else []
        for a, b in zip(cuts, cuts[1:]):
            rejects += int(frames[a]) - due  # frames given up count as missing
            ok[a:b], (lx, ly, rejects) = walk(go[a:b, 2].copy(), go[a:b, 3].copy(), (lx, ly, rejects), self.max_dist, self.max_counter)
            due = int(frames[b - 1]) + 1
        self.walk.update((lx, ly, rejects, due, latest))
        wait = points[ready:]
        if len(wait):
            self.held.put([(int(f), int(t), float(a), float(b)) for f, t, a, b in wait])
        else:
            self.held.clear()
        if self.timed:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            # the earliest point that waits, or the end of an idle track
            self.handle.registerTimer(int(wait[:, 1].min()) + 1 if len(wait) else latest + self.idle)
        return pd.DataFrame({"track_id": np.full(ready, key[0], np.int64), "frame": frames[:ready], "x": np.where(ok, go[:, 2], np.nan), "y": np.where(ok, go[:, 3], np.nan)})

    def _points(self) -> np.ndarray:
        return np.array([tuple(p) for p in self.held.get()] if self.held.exists() else [], float).reshape(-1, 4)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.walk.get()) if self.walk.exists() else (float("nan"), float("nan"), 0, 0, 0)
        new = pd.concat(list(rows))
        at = new["ts"].to_numpy("datetime64[ms]").astype(np.int64) if self.timed else np.zeros(len(new), np.int64)
        new = np.stack([new["frame"].to_numpy(float), at.astype(float), new[self.x].to_numpy(float, na_value=np.nan), new[self.y].to_numpy(float, na_value=np.nan)], axis=1)
        yield self._settle(key, np.concatenate([self._points(), new]), (*state[:4], max(int(state[4]), int(at.max()))), -1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.walk.exists():
            return
        state, points, now = tuple(self.walk.get()), self._points(), timerValues.getCurrentWatermarkInMs()
        over = points[points[:, 1] <= now]
        if len(over):
            yield self._settle(key, points, state, int(over[:, 0].max()))
        elif now >= state[4] + self.idle:
            self.walk.clear()
            self.held.clear()

    def close(self) -> None:
        pass


def position_check(stream: DataFrame, x: str = "x", y: str = "y", max_dist: float = 20, max_counter: int = 7, wait: str = "10 seconds", idle: float = 3600.0) -> DataFrame:
    """Online position check of (track_id, frame, ts, x, y).

    Frames of a track are numbered from 0 and may arrive in any order: a point waits in the state until all frames before it are there.
    A frame that has not come when the watermark, ``wait`` behind the latest event time, passes a point after it is given up: it counts
    as missing, and the points that waited for it are settled. Of a repeated frame the first row counts; further ones, and rows of frames
    that were settled or given up, are left out. So a track holds the points of one ``wait`` at most, and a track without a row for ``idle``
    seconds of event time is forgotten; it may begin anew. Without a column ts there is no such time, and points wait until the missing ones
    are there. State is kept by RocksDB (see ``run_available``).
    """
    timed = "ts" in stream.columns
    kept = stream.withWatermark("ts", wait).select("track_id", "frame", "ts", x, y) if timed else stream.select("track_id", "frame", x, y)
    out = kept.groupBy("track_id").transformWithStateInPandas(
        _Check(x, y, max_dist, max_counter, int(idle * 1000), timed), "track_id long, frame long, x double, y double", "append", "eventTime" if timed else "none")
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("x", "y")})


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, feed: Feed | None = None, base: str | None = None, store: str = ROCKS) -> DataFrame:
    """Drain what the source holds into a Parquet table of the scratch folder and read that table. With a ``feed`` the source is then
    closed and drained again from the same progress, so windows that were still open come out too. ``base`` of an earlier call goes on
    from its progress. ``store``: class of the state store; ``position_check`` needs RocksDB."""
    spark = stream.sparkSession
    base = base or scratch_dir(spark)
    name = "spark.sql.streaming.stateStore.providerClass"

    def drain() -> None:
        before = spark.conf.get(name, None)
        spark.conf.set(name, store)
        try:
            q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
        finally:
            spark.conf.unset(name) if before is None else spark.conf.set(name, before)
        q.awaitTermination()
    drain()
    if feed is not None:
        feed.close()
        drain()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
