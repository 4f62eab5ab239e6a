"""Exact quantiles of groups of any size, without gathering a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group or bin that one task may order.
ORDERED = 200_000
#: Rows that a task orders in all, about.
TASK_ROWS = 1_000_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], bins: int = 1024, ordered: int | None = None) -> DataFrame:
    """keys + one column per quantile (linear interpolation between order statistics).

    Groups of at most ``ordered`` rows are ordered as they are. Values of larger ones are counted in ``bins`` equal bins between the least and
    greatest of the group; only bins that hold a wanted rank matter. Where one of these holds more than ``ordered`` rows of different
    values (an outlier or a heavy tail squeezes the others), it is counted again in bins between its own least and greatest value, and so
    on. The bins left are ordered; one of equal values needs no rows. So bins are counted for few groups, and the tasks that order rows grow
    in number with the rows. Rows with a null key are left out.
    """
    from ..sources.tables import discard, stored

    limit = ordered or ORDERED
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    for k in keys:
        v = v.where(F.col(k).isNotNull())
    span = stored(v.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_c")))
    large = F.col("_c") > limit  # few groups: no more than one in ``limit`` rows
    wanted = span.where(large).select(*keys, "_lo", "_hi", "_c", F.col("_c").alias("_n"), F.lit(0).cast("long").alias("_below"))
    apart = F.col("_lo") < F.col("_hi")
    ranks = [f(F.lit(q) * (F.col("_n") - 1)) for q in qs.values() for f in (F.floor, F.ceil)]

    def inside(bounds: DataFrame) -> DataFrame:
        j = v.join(bounds, keys) if keys else v.crossJoin(F.broadcast(bounds))  # without keys at most two rows per quantile
        return j.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))

    def dealt(rows: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
        """Rows in as many tasks as their number asks for, where Spark's own number of shuffle partitions is less."""
        tasks = -(-(counts.agg(F.sum("_c")).first()[0] or 0) // TASK_ROWS)
        return rows.repartition(tasks, *by) if by and tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows

    some_large = not wanted.isEmpty()
    for _ in range(64):
        if wanted.where(large & apart).isEmpty():
            break
        width = F.col("_hi") - F.col("_lo")
        bin_no = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_lo")) / width * bins))).otherwise(0).cast("int")
        counts = inside(wanted).groupBy(*keys, "_below", F.col("_c").alias("_all"), bin_no.alias("_bin")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.max("_n").alias("_n"))
        ahead = Window.partitionBy(*keys, "_below", "_all").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("_from", F.col("_below") + F.coalesce(F.sum("_c").over(ahead), F.lit(0)))
        needed = F.lit(False)
        for r in ranks:
            needed = needed | ((r >= F.col("_from")) & (r < F.col("_from") + F.col("_c")))
        before, wanted = wanted, stored(placed.where(needed).select(*keys, "_lo", "_hi", "_c", "_n", F.col("_from").alias("_below")))
        discard(before)

    # rows with the rank they have in their group
    parts, columns = [], [*keys, "_v", "_n", "_from", "_upto"]
    if keys or not some_large:
        small = v.join(span.where(large).select(*keys), keys, "left_anti") if some_large else v
        group = Window.partitionBy(*keys)
        small = dealt(small, span.where(~large), keys).withColumns({"_n": F.count(F.lit(1)).over(group), "_upto": F.row_number().over(group.orderBy("_v")).cast("long")})
        parts.append(small.withColumn("_from", F.col("_upto") - 1).select(columns))
    if some_large:
        bounds = wanted.where(apart)
        rank = F.row_number().over(Window.partitionBy(*keys, "_below").orderBy("_v"))
        binned = dealt(inside(bounds), bounds, [*keys, "_below"]).withColumn("_upto", F.col("_below") + rank)
        parts.append(binned.withColumn("_from", F.col("_upto") - 1).select(columns))
        equal = wanted.where(~apart).withColumns({"_v": F.col("_lo"), "_from": F.col("_below"), "_upto": F.col("_below") + F.col("_c")})
        parts.append(equal.select(columns))
    placed = reduce(DataFrame.unionByName, parts)

    def at(rank):
        return F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_upto")), F.col("_v")))

    out = []
    for name, q in qs.items():
        pos = F.lit(q) * (F.col("_n") - 1)
        out += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}"), F.max(pos - F.floor(pos)).alias(f"_f_{name}")]
    got = placed.groupBy(*keys).agg(*out)
    return got.select(*keys, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in qs])
