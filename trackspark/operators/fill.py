"""Gap filling along a track."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk import running_total, scan


def fill_forward(df: DataFrame, cols: list[str], **kw) -> DataFrame:
    return scan(df, {c: ("last", F.col(c)) for c in cols}, **kw)


def fill_backward(df: DataFrame, cols: list[str], **kw) -> DataFrame:
    return scan(df, {c: ("next", F.col(c)) for c in cols}, **kw)


def fill_both(df: DataFrame, cols: list[str], forward_first: bool = True, **kw) -> DataFrame:
    """Forward then backward, or backward then forward."""
    both = {f"_f_{c}": ("last", F.col(c)) for c in cols} | {f"_b_{c}": ("next", F.col(c)) for c in cols}
    out = scan(df, both, **kw)
    order = ("_f_", "_b_") if forward_first else ("_b_", "_f_")
    return out.withColumns({c: F.coalesce(*[F.col(p + c) for p in order]) for c in cols}).drop(*both)


def fill_mean(df: DataFrame, cols: list[str], late: list[str] = (), keys=("track_id",), **kw) -> DataFrame:
    """Forward, then the track's mean: of the present values, for columns in ``late`` of the forward-filled ones."""
    filled = scan(df, {f"_f_{c}": ("last", F.col(c)) for c in cols}, keys=keys, **kw)
    means = filled.groupBy(*keys).agg(*[F.avg(f"_f_{c}" if c in late else c).alias(f"_m_{c}") for c in cols])
    out = filled.join(means, list(keys))
    return out.withColumns({c: F.coalesce(F.col(f"_f_{c}"), F.col(f"_m_{c}")) for c in cols}).drop(
        *[f"_f_{c}" for c in cols], *[f"_m_{c}" for c in cols])


def _neighbours(df: DataFrame, col: str, **kw) -> DataFrame:
    at = F.when(F.col(col).isNotNull(), F.col(kw.get("frame", "frame")))
    return scan(df, {"_pv": ("last", F.col(col)), "_pf": ("last", at), "_nv": ("next", F.col(col)), "_nf": ("next", at)}, **kw)


def interpolate_linear(df: DataFrame, col: str, **kw) -> DataFrame:
    """Linear between neighbours; leading nulls stay, trailing nulls take the last value."""
    n = _neighbours(df, col, **kw)
    at = F.col(kw.get("frame", "frame"))
    step = F.try_divide(F.col("_nv") - F.col("_pv"), F.col("_nf") - F.col("_pf"))
    value = F.when(F.col("_nv").isNull(), F.col("_pv")).otherwise(F.col("_pv") + step * (at - F.col("_pf")))
    return n.withColumn(col, F.when(F.col(col).isNotNull(), F.col(col)).otherwise(value)).drop("_pv", "_pf", "_nv", "_nf")


def interpolate_nearest(df: DataFrame, col: str, **kw) -> DataFrame:
    """Inner gaps take the value of the nearest present frame, the earlier one on ties."""
    n = _neighbours(df, col, **kw)
    inner = F.col("_pv").isNotNull() & F.col("_nv").isNotNull()
    at = F.col(kw.get("frame", "frame"))
    near = F.when(at - F.col("_pf") <= F.col("_nf") - at, F.col("_pv")).otherwise(F.col("_nv"))
    return n.withColumn(col, F.when(F.col(col).isNotNull(), F.col(col)).when(inner, near)).drop("_pv", "_pf", "_nv", "_nf")


def bridge_tracks(df: DataFrame, buffer: int = 100) -> DataFrame:
    """All tracks one after another by id on a common frame ``axis``, ``buffer`` empty rows after each.

    ``interpolate_bridged`` fills the gaps of the result over the buffers.
    """
    lengths = df.groupBy("track_id").agg((F.max("frame") + 1).alias("_n"))
    starts = running_total(lengths, ["track_id"], F.col("_n") + buffer, "_start")
    rows = df.drop("_chunk").join(starts.select("track_id", "_start"), "track_id").withColumn("axis", F.col("_start") + F.col("frame")).drop("_start")
    pads = starts.select(F.explode(F.expr(f"sequence(_start + _n, _start + _n + {buffer} - 1)")).alias("axis"))
    return rows.unionByName(pads, allowMissingColumns=True).withColumn("series", F.lit(0).cast("long"))


def interpolate_bridged(bridged: DataFrame, col: str, block: int = 4096, **kw) -> DataFrame:
    """``interpolate_linear`` along the axis of ``bridge_tracks``: one series over all tracks, scanned by rows, chunks and blocks of chunks."""
    return interpolate_linear(bridged, col, keys=("series",), frame="axis", block=block, **kw)
