"""Scoring against manual labels: sweeps, F1, confusion, ROC, Rand index, transitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunk import number_frames, windowed
from .intervals import width_filter
from .clean import skeleton_filter
from ..functions.label import in_band


def parameter_grid(df: DataFrame, lists: dict[str, list[float]]) -> DataFrame:
    """Every row with every combination of the listed values: param_id and one column per parameter.

    The first list varies fastest in param_id.
    """
    total = 1
    for v in lists.values():
        total *= len(v)
    out = df.withColumn("param_id", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    stride = 1
    cols = {}
    for name, v in lists.items():
        cols[name] = F.element_at(F.array(*[F.lit(float(x)) for x in v]), F.expr(f"cast(param_id div {stride} % {len(v)} as int) + 1"))
        stride *= len(v)
    return out.withColumns(cols)


def rates_from_counts(df: DataFrame) -> DataFrame:
    """tp, fp, tn, fn to TPR, FPR, precision, FDR and Youden's index."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    d = df.withColumns({"tpr": F.try_divide(tp, tp + fn), "fpr": F.try_divide(fp, fp + tn), "prec": F.try_divide(tp, tp + fp), "fdr": F.try_divide(fp, fp + tp)})
    return d.withColumn("youden", F.col("tpr") + F.try_divide(tn, tn + fp) - 1)


def counts(auto: Column, manual: Column, last: Column, weight: Column | None = None) -> list[Column]:
    """Confusion sums; the manual series ends one row early, so a last row counts as a miss of its own kind."""
    weight = F.lit(1) if weight is None else weight
    hit = lambda c: F.sum(F.when(c, weight).otherwise(F.lit(0))).cast("long")
    return [hit((auto == 1) & (manual == 1) & ~last).alias("tp"), hit((auto == 1) & ((manual != 1) | last)).alias("fp"),
            hit((auto == 0) & (manual == 0) & ~last).alias("tn"), hit((auto == 0) & ((manual != 0) | last)).alias("fn")]


def sweep_band(df: DataFrame, score: str, manual: str, last: str, lows: list[float], highs: list[float]) -> DataFrame:
    """Confusion counts and rates for every low < score < high.

    Rows are first counted per cell between the sorted thresholds (at most 2 x 2 x twice their number), so the number of
    combinations never multiplies the data.
    """
    cuts = sorted({*map(float, lows), *map(float, highs)})
    lit = F.array(*[F.lit(c) for c in cuts])
    below = F.size(F.filter(lit, lambda t: t < F.col(score)))
    on = F.array_contains(lit, F.col(score))
    cells = df.groupBy(below.alias("k"), F.coalesce(on, F.lit(False)).cast("int").alias("eq"), F.col(manual).alias("_m"), F.col(last).alias("_last")).agg(F.count(F.lit(1)).alias("_n"))
    g = parameter_grid(cells, {"low": lows, "high": highs})
    place = F.map_from_arrays(lit, F.array(*[F.lit(i) for i in range(len(cuts))]))
    auto = F.when((place[F.col("low")] < F.col("k")) & (place[F.col("high")] >= F.col("k") + F.col("eq")), 1).otherwise(0)
    return rates_from_counts(g.groupBy("param_id", "low", "high").agg(*counts(auto, F.col("_m"), F.col("_last"), F.col("_n"))))


def sweep(df: DataFrame, lists: dict[str, list[float]], scorer: Callable[[DataFrame], DataFrame], manual: str, last: str) -> DataFrame:
    """As ``sweep_band`` for any scorer that adds ``auto`` to (param_id, track_id, frame, ..) rows."""
    g = scorer(parameter_grid(df, lists))
    return rates_from_counts(g.groupBy("param_id", *lists).agg(*counts(F.col("auto"), F.col(manual), F.col(last))))


def band_scorer(score: str) -> Callable[[DataFrame], DataFrame]:
    return lambda g: g.withColumn("auto", in_band(score, F.col("p0"), F.col("p1")))


def width_scorer(score: str, **kw) -> Callable[[DataFrame], DataFrame]:
    """Band p0..p1, then runs wider than p2."""
    def run(g):
        b = g.withColumn("_bin", in_band(score, F.col("p0"), F.col("p1")))
        return width_filter(b, "_bin", width=F.col("p2"), out="auto", keys=("param_id", "track_id"), carry=("p2",), **kw)
    return run


def skeleton_scorer(angle: Column, width: bool = False, **kw) -> Callable[[DataFrame], DataFrame]:
    """Skeleton rules with p2..p6 (p3..p7 with a width p2), then the band p0..p1 on the angle."""
    def run(g):
        first = 3 if width else 2
        p = [F.col(f"p{i}") for i in range(first, first + 5)]
        c = skeleton_filter(g, *p, keys=("param_id", "track_id"), **kw).withColumn("_angle", angle)
        if width:
            return width_scorer("_angle")(c)
        return band_scorer("_angle")(c)
    return run


def best_parameters(table: DataFrame, names: list[str], score: str = "youden") -> DataFrame:
    """The row with the highest score, the first parameter combination on ties."""
    return table.agg(F.max_by(F.struct(*names, "tpr", "fpr", score), F.struct(F.col(score), -F.col("param_id"))).alias("b")).select("b.*")


def shuffled(df: DataFrame, value: str, out: str = "control", seed: int = 7, keys: str = "track_id") -> DataFrame:
    """Values of a track dealt to its frames in hash order: a fixed random permutation for negative controls."""
    h = df.select(keys, F.col(value).alias(out), F.xxhash64(F.lit(seed), F.col(keys), F.col("frame")).alias("_h"), F.col("frame").alias("_f"))
    dealt = number_frames(h, keys, ["_h", "_f"], {"range": F.shiftright("_h", 50)}).select(keys, "frame", out)
    return df.join(dealt, [keys, "frame"])


def f1_per_state(df: DataFrame, state: str, manual: str) -> DataFrame:
    """One-vs-rest F1 of every state against the 0/1 manual label."""
    s = df.groupBy(state).agg(F.sum(manual).alias("tp"), F.count(F.lit(1)).alias("size"))
    total = Window.partitionBy(F.lit(0))  # a handful of states
    s = s.withColumn("positives", F.sum("tp").over(total))
    return s.select(state, "tp", F.try_divide(2 * F.col("tp"), F.col("size") + F.col("positives")).alias("f1"))


def best_state(train: DataFrame, test: DataFrame, state: str, manual: str) -> DataFrame:
    """State with the best F1 on the training rows and its F1 on both parts."""
    a = f1_per_state(train, state, manual).agg(F.max_by(F.struct(state, F.col("f1").alias("train_f1")), F.struct(F.col("f1"), -F.col(state))).alias("b")).select("b.*")
    return a.join(f1_per_state(test, state, manual).select(state, F.col("f1").alias("test_f1")), state, "left")


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Counts per (label, pred) with precision and recall of that cell's class."""
    c = df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumns({"label_total": F.sum("n").over(Window.partitionBy(label)), "pred_total": F.sum("n").over(Window.partitionBy(pred))})


def class_scores(df: DataFrame, label: str, pred: str) -> DataFrame:
    """class, precision, recall, f1."""
    c = df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))
    side = F.array(F.struct(F.col(label).alias("class"), F.col("n").alias("actual"), F.lit(0).alias("predicted")),
                   F.struct(F.col(pred).alias("class"), F.lit(0).cast("long").alias("actual"), F.lit(1).alias("predicted")))
    t = c.withColumn("_hit", F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0)).select("n", "_hit", F.inline(side))
    g = t.groupBy("class").agg(F.sum("actual").alias("actual"), F.sum(F.col("n") * F.col("predicted")).alias("predicted"),
                               F.sum(F.col("_hit") * F.col("predicted")).alias("hit"))
    return g.select("class", F.try_divide("hit", "predicted").alias("precision"), F.try_divide("hit", "actual").alias("recall"),
                    F.try_divide(2 * F.col("hit"), F.col("predicted") + F.col("actual")).alias("f1"))


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """score, pos, neg, tp, fp, tpr, fpr for the rule "at least this score", one row per distinct score.

    Spark deals the distinct scores into ranges of about equal numbers; running sums are taken inside a range and carried from
    range to range, so no task sees all scores, however they are distributed.
    """
    from ..sources.tables import stored

    d = df.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    d = stored(d.repartitionByRange("score").withColumn("_bin", F.spark_partition_id()))
    above = Window.orderBy(F.col("_bin").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    bins = d.groupBy("_bin").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
    carry = bins.select("_bin", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p"), F.coalesce(F.sum("_q").over(above), F.lit(0)).alias("_q"))
    inside = Window.partitionBy("_bin").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(carry, "_bin").withColumns({"tp": F.col("_p") + F.sum("pos").over(inside), "fp": F.col("_q") + F.sum("neg").over(inside)})
    d = d.crossJoin(F.broadcast(bins.agg(F.sum("_p").alias("_all_pos"), F.sum("_q").alias("_all_neg"))))  # one row of totals
    return d.withColumns({"tpr": F.try_divide("tp", "_all_pos"), "fpr": F.try_divide("fp", "_all_neg")}).drop("_bin", "_p", "_q")


def auc(points: DataFrame) -> DataFrame:
    """Area under the ROC curve by trapezoids between distinct scores."""
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    return points.agg(F.try_divide(F.sum(area), F.max("_all_pos").cast("double") * F.max("_all_neg")).alias("auc"))


def operating_point(points: DataFrame, max_fpr: float = 0.2) -> DataFrame:
    """Lowest score whose false-positive rate stays below the limit."""
    return points.where(F.col("fpr") < max_fpr).agg(F.min_by(F.struct("score", "tpr", "fpr"), "score").alias("b")).select("b.*")


def rand_index(df: DataFrame, a: str, b: str, keys=()) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency counts."""
    pairs = lambda n: n * (n - 1) / 2
    c = df.groupBy(*keys, a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    both = c.groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("_ab"), F.sum("n").alias("_t")) if keys else c.agg(F.sum(pairs(F.col("n"))).alias("_ab"), F.sum("n").alias("_t"))

    def margin(col, out):
        m = c.groupBy(*keys, col).agg(F.sum("n").alias("n"))
        return (m.groupBy(*keys) if keys else m).agg(F.sum(pairs(F.col("n"))).alias(out))
    ma, mb = margin(a, "_a"), margin(b, "_b")
    j = both.join(ma, list(keys)).join(mb, list(keys)) if keys else both.crossJoin(ma).crossJoin(mb)  # one row each
    expected = F.try_divide(F.col("_a") * F.col("_b"), pairs(F.col("_t")))
    return j.select(*keys, F.try_divide(F.col("_ab") - expected, (F.col("_a") + F.col("_b")) / 2 - expected).alias("ari"))


def transitions(df: DataFrame, state: str, keep_self: bool = False, keys=("track_id",), **kw) -> DataFrame:
    """state, next_state, n and the share of the state's transitions."""
    t = windowed(df, lambda w: {"next_state": F.lead(state).over(w)}, after=1, keys=keys, **kw).where(F.col("next_state").isNotNull())
    if not keep_self:
        t = t.where(F.col("next_state") != F.col(state))
    n = t.groupBy(state, "next_state").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy(state)))


def state_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def best_permutation(overlap: DataFrame, a: str, b: str, k1: int, k2: int) -> list[int]:
    """Partner of each state 0..k1-1 that maximises the total overlap; unused partners are appended.

    The overlap table has at most k1 x k2 rows. Solved by subsets of partners.
    """
    m = [[0] * k2 for _ in range(k1)]
    for r in overlap.collect():
        m[r[a]][r[b]] = r["n"]
    best = {0: (0, ())}
    for row in m:
        step = {}
        for used, (total, picks) in best.items():
            for j in range(k2):
                if not used & 1 << j:
                    cand = (total + row[j], (*picks, j))
                    key = used | 1 << j
                    if key not in step or cand[0] > step[key][0]:
                        step[key] = cand
        best = step
    picks = max(best.values(), key=lambda t: t[0])[1]
    return [*picks, *[j for j in range(k2) if j not in picks]]


def relabel(df: DataFrame, state: str, perm: list[int], out: str | None = None) -> DataFrame:
    lit = F.array(*[F.lit(p) for p in perm])
    return df.withColumn(out or state, F.element_at(lit, F.col(state).cast("int") + 1).cast("long"))


def information_criteria(fits: DataFrame, states: str = "k", dims: str = "d", ll: str = "ll", rows: str = "n") -> DataFrame:
    """Free parameters, AIC and BIC of full-covariance Gaussian HMM fits."""
    k, d = F.col(states), F.col(dims)
    p = k - 1 + k * (k - 1) + k * d + k * (d * d + d) / 2
    return fits.withColumn("params", p).withColumns({"aic": -2 * F.col(ll) + 2 * F.col("params"), "bic": -2 * F.col(ll) + F.col("params") * F.log(F.col(rows))})
