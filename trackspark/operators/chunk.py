"""Frame chunks: the unit of parallelism inside one track.

A track can hold a large share of all rows, so nothing here windows over a whole track. Rows are grouped by
``(track, _chunk)`` with ``_chunk = frame div CHUNK_FRAMES``:

* ``with_halo`` copies the edge rows a bounded window needs into the neighbouring chunk;
* ``scan`` runs unbounded windows as chunk totals, a short window over those totals, and a window inside the chunk;
* ``number_frames`` numbers rows the same way, over coarse buckets of the order key.

``_chunk`` stays on the result so that the next operator of a chain reuses the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_FRAMES = 16384


def computed(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated once per row.

    A plain projection may be merged into the expressions that use it, which repeats array work inside their loops.
    """
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def chunk_size(size: int | None = None) -> int:
    return size or CHUNK_FRAMES


def _marked(chunk: Column, frame: str, size: int | None) -> Column:
    """The column, noting in its metadata what it was made from."""
    return chunk.alias("_chunk", metadata={"frame": frame, "size": chunk_size(size)})


def with_chunk(df: DataFrame, frame: str = "frame", size: int | None = None) -> DataFrame:
    """Add ``_chunk``; one that was made from the same frame column and size is kept."""
    if "_chunk" in df.columns and df.schema["_chunk"].metadata == {"frame": frame, "size": chunk_size(size)}:
        return df
    return df.drop("_chunk").select("*", _marked(F.expr(f"`{frame}` div {chunk_size(size)}"), frame, size))


def with_halo(df: DataFrame, before: int = 0, after: int = 0, frame: str = "frame", size: int | None = None) -> DataFrame:
    """Add ``_chunk`` and ``_own``; a row is repeated in every chunk that sees it within ``before`` / ``after`` frames."""
    n = chunk_size(size)
    lo = F.expr(f"greatest((`{frame}` - {after}) div {n}, 0L)")
    hi = F.expr(f"(`{frame}` + {before}) div {n}")
    spread = df.drop("_chunk").withColumn("_chunk", F.explode(F.sequence(lo, hi)))
    return spread.select(*[c for c in spread.columns if c != "_chunk"], _marked(F.col("_chunk"), frame, size), F.expr(f"`{frame}` div {n} = _chunk").alias("_own"))


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own")


def chunk_window(keys=("track_id",), frame: str = "frame"):
    return Window.partitionBy(*keys, "_chunk").orderBy(frame)


def windowed(df: DataFrame, *stages, before: int = 0, after: int = 0, keys=("track_id",), frame: str = "frame",
             size: int | None = None) -> DataFrame:
    """Apply bounded-window stages in order; each stage maps the window spec to ``{column: expression}``.

    ``before`` / ``after`` must cover the reach of all stages together. Frames are dense per track.
    """
    out = with_halo(df, before, after, frame, size)
    w = chunk_window(keys, frame)
    for stage in stages:
        out = out.withColumns(stage(w))
    return own_rows(out)


def _earlier(totals: DataFrame, kinds: list[str], keys, at: str, block: int | None = None) -> DataFrame:
    """keys, ``at`` and, as ``_c0`` .., the totals ``_t0`` .. of all rows before (kind next: after) each value of ``at``.

    With ``block``, rows are taken together by ``block`` values of ``at`` first, so that one task sees the blocks and not all rows.
    """
    if block:
        totals = totals.withColumn("_block", F.expr(f"`{at}` div {block}"))
        whole = totals.groupBy(*keys, "_block").agg(*[_TOTAL[k](f"_t{i}", at).alias(f"_t{i}") for i, k in enumerate(kinds)])
        outer = _earlier(whole, kinds, keys, "_block").withColumnsRenamed({f"_c{i}": f"_b{i}" for i in range(len(kinds))})
        both = _earlier(totals, kinds, [*keys, "_block"], at).join(outer, [*keys, "_block"])
        merge = {"sum": lambda c, b: F.coalesce(c + b, c, b), "max": F.greatest, "last": F.coalesce, "next": F.coalesce}
        return both.select(*keys, at, *[merge[k](F.col(f"_c{i}"), F.col(f"_b{i}")).alias(f"_c{i}") for i, k in enumerate(kinds)])
    past = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    # looking ahead is looking back in descending order: a frame that starts at the row and runs to the end is
    # summed anew for every row
    future = Window.partitionBy(*keys).orderBy(F.col(at).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = {
        "sum": lambda t: F.sum(t).over(past),
        "max": lambda t: F.max(t).over(past),
        "last": lambda t: F.last(t, True).over(past),
        "next": lambda t: F.last(t, True).over(future),
    }
    return totals.select(*keys, at, *[carried[k](f"_t{i}").alias(f"_c{i}") for i, k in enumerate(kinds)])


#: Total of a group of rows by kind of running value.
_TOTAL = {
    "sum": lambda v, at: F.sum(v),
    "max": lambda v, at: F.max(v),
    "last": lambda v, at: F.max_by(v, F.when(F.col(v).isNotNull(), F.col(at))),
    "next": lambda v, at: F.min_by(v, F.when(F.col(v).isNotNull(), F.col(at))),
}


def scan(df: DataFrame, cols: dict[str, tuple[str, Column]], keys=("track_id",), frame: str = "frame",
         size: int | None = None, block: int | None = None) -> DataFrame:
    """Running values over whole tracks: ``{out: (kind, expr)}`` with kind sum | max | last | next.

    sum, max and last (latest non-null) look back and include the row; next is the first non-null at or after it. ``block`` is for a
    single series over all data: its chunk totals are combined by blocks of so many chunks before the blocks are.
    """
    c = with_chunk(df, frame, size)
    names = list(cols)
    c = c.withColumns({f"_v{i}": cols[n][1] for i, n in enumerate(names)})
    kinds = [cols[n][0] for n in names]
    totals = c.groupBy(*keys, "_chunk").agg(*[_TOTAL[k](f"_v{i}", frame).alias(f"_t{i}") for i, k in enumerate(kinds)])
    carry = _earlier(totals, kinds, keys, "_chunk", block)
    seen = chunk_window(keys, frame).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys, "_chunk").orderBy(F.col(frame).desc()).rowsBetween(Window.unboundedPreceding, 0)
    merged = {
        "sum": lambda v, p: F.coalesce(F.sum(v).over(seen), F.lit(0)) + F.coalesce(F.col(p), F.lit(0)),
        "max": lambda v, p: F.greatest(F.max(v).over(seen), F.col(p)),
        "last": lambda v, p: F.coalesce(F.last(v, True).over(seen), F.col(p)),
        "next": lambda v, p: F.coalesce(F.last(v, True).over(ahead), F.col(p)),
    }
    j = c.join(carry, [*keys, "_chunk"])
    j = j.withColumns({f"_o{i}": merged[cols[n][0]](f"_v{i}", f"_c{i}") for i, n in enumerate(names)})
    j = j.withColumns({n: F.col(f"_o{i}") for i, n in enumerate(names)})
    return j.drop(*[f"_{p}{i}" for p in "vco" for i in range(len(names))])


def running_total(df: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before each row in ``order`` (no two rows alike in it), without one task over all rows.

    Rows are dealt by ranges of the order and stored, since a second deal might cut elsewhere; only one total per range is ordered at once.
    """
    from ..sources.tables import stored

    dealt = stored(df.withColumn("_v", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(F.sum("_v").alias("_t0"))  # as many rows as shuffle partitions
    before = _earlier(ranges.withColumn("_all", F.lit(0)), ["sum"], ["_all"], "_range").drop("_all")
    summed = dealt.withColumn("_s", F.sum("_v").over(inside)).join(before, "_range")
    return summed.withColumn(out, F.coalesce("_s", F.lit(0)) + F.coalesce("_c0", F.lit(0))).drop("_v", "_s", "_c0", "_range")


def number_frames(df: DataFrame, key: str, order_by: list[str], buckets: dict[str, Column]) -> DataFrame:
    """Dense 0-based ``frame`` per key in ``order_by`` order.

    ``buckets`` are coarse leading parts of the order key (a day, an hour, a range of ids), so one key is numbered by
    many tasks: rows are counted per bucket, the counts summed up, and rows numbered inside the bucket.
    """
    b = df.withColumns({f"_b{i}": c for i, c in enumerate(buckets.values())})
    bs = [f"_b{i}" for i in range(len(buckets))]
    before = Window.partitionBy(key).orderBy(*bs).rowsBetween(Window.unboundedPreceding, -1)
    offsets = b.groupBy(key, *bs).agg(F.count(F.lit(1)).alias("_n")).select(
        key, *bs, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(key, *bs).orderBy(*order_by)
    return (b.join(offsets, [key, *bs])
            .withColumn("frame", F.col("_off") + F.row_number().over(inside) - F.lit(1))
            .drop("_off", *bs))
