"""Rates, counts and summary tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fraction(df: DataFrame, binary, keys=("track_id",), out: str = "fraction") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(binary).alias(out))


def loop_rates(df: DataFrame, binary, length: int = 1080, keys=("track_id",), out: str = "rate") -> DataFrame:
    """Mean of ``binary`` per full loop of ``length`` frames; a short last loop is dropped."""
    loops = df.withColumn("loop_id", F.expr(f"frame div {length}")).groupBy(*keys, "loop_id").agg(
        F.avg(binary).alias(out), F.count(F.lit(1)).alias("_n"))
    return loops.where(F.col("_n") == length).drop("_n")


def stimulus_index(rates: DataFrame, keys=("track_id",), rate: str = "rate", plus: int = 2, minus: int = 3) -> DataFrame:
    """Mean rate per stimulus code and (plus - minus) / (plus + minus)."""
    m = rates.groupBy(*keys).agg(*[F.avg(F.when(F.col("code") == c, F.col(rate))).alias(f"rate_{c}") for c in (2, 3, 4)])
    p, q = F.col(f"rate_{plus}"), F.col(f"rate_{minus}")
    return m.withColumn("preference", F.try_divide(p - q, p + q))


def period_change(df: DataFrame, measures: dict[str, Column], is_test: Column, keys=("track_id",)) -> DataFrame:
    """Rate in the test period minus rate in the habituation period, per measure."""
    return df.groupBy(*keys).agg(*[
        (F.avg(F.when(is_test, m)) - F.avg(F.when(~is_test, m))).alias(n) for n, m in measures.items()])


def conditional_probability(df: DataFrame, target, cutoff: float, given, low: float, high: float, keys=("track_id",),
                            out: str = "prob") -> DataFrame:
    """Share of rows with target > cutoff among rows with given in [low, high]; null targets count in the denominator."""
    return df.where(F.col(given).between(low, high)).groupBy(*keys).agg(
        F.try_divide(F.sum(F.when(F.col(target) > cutoff, 1).otherwise(0)), F.count(F.lit(1))).alias(out))


def bin_means(df: DataFrame, col: str, width: int = 10, keys=("track_id",)) -> DataFrame:
    return df.groupBy(*keys, F.expr(f"frame div {width}").alias("bin")).agg(F.avg(col).alias("mean"))


def second_matrix(df: DataFrame, col: str, fps: int = 40, keys=("track_id",)) -> DataFrame:
    """One row per second with an array of its ``fps`` values (null where missing)."""
    slots = [F.max(F.when(F.expr(f"frame % {fps}") == i, F.col(col))) for i in range(fps)]
    return df.groupBy(*keys, F.expr(f"frame div {fps}").alias("second")).agg(F.array(*slots).alias("cells"))


def state_table(df: DataFrame, features: list[str], state: str = "state") -> DataFrame:
    """feature, state, mean, variance (sample)."""
    aggs = [a for f in features for a in (F.avg(f).alias(f"m_{f}"), F.var_samp(f).alias(f"v_{f}"))]
    wide = df.groupBy(state).agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"), F.col(f"v_{f}").alias("variance")) for f in features])
    return wide.select(state, F.inline(pairs))


def state_means_wide(df: DataFrame, features: list[str], states: list[int], state: str = "state") -> DataFrame:
    """Features as rows, one mean column per state."""
    t = state_table(df, features, state)
    return t.groupBy("feature").agg(*[F.max(F.when(F.col(state) == s, F.col("mean"))).alias(f"state{s}") for s in states])


def crosstab(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    return df.groupBy(row).agg(*[F.sum(F.when(F.col(col) == v, 1).otherwise(0)).alias(f"{col}_{v}") for v in values])


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """feature_a, feature_b, corr for every unordered pair, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)])))


def anova_f(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way analysis of variance: F, groups, rows, from per-group sums."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
              F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("mm"))
    between = F.col("mm") - F.col("n") * F.col("grand") * F.col("grand")
    f = F.try_divide(between / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
    return t.select(f.alias("f_ratio"), F.col("k").alias("groups"), F.col("n").alias("rows"))


def qc_counts(frames: DataFrame, keys=("track_id",)) -> DataFrame:
    """Share and number of frames per fault flag (0/1 columns no_contour, not_in_box, too_small, multiple)."""
    flags = ["no_contour", "not_in_box", "too_small", "multiple"]
    return frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        *[F.sum(f).alias(f) for f in flags], *[(F.avg(f) * 100).alias(f"{f}_pct") for f in flags])


def loop_raster(df: DataFrame, binary: str, length: int) -> DataFrame:
    """How often each position inside the loop is 1, pooled over full loops."""
    return df.where(F.col(binary) == 1).groupBy(F.expr(f"frame % {length}").alias("position")).agg(F.count(F.lit(1)).alias("hits"))


def null_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, nulls in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in cols])))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def run_shares(runs: DataFrame, state: str, width: int) -> DataFrame:
    """Share of each state's runs by length class of ``width`` frames (state, bin, share)."""
    n = runs.groupBy(state, F.floor(F.col("length") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(state).agg(F.sum("n").alias("total"))
    return n.join(total, state).select(state, "bin", (F.col("n") / F.col("total")).alias("share"))
