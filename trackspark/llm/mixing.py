"""Mixing of sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents are counted in cells (source, lang, topic) with their tokens (words between ASCII white space). The weights of the cells start
as their tokens and are raked: in turn for source, language and topic, the weights of each value are scaled to the value's target, and
no weight may pass the cell's tokens / ``RATE``. Targets are the token shares to the power ``TEMPER``, so rare values gain. Then a
document is sampled with the probability RATE x weight / tokens of its cell, by a hash of its id: the sample has RATE of all tokens
in the target mix, as far as the bound allows.

Raking converges (``rake_fully``): a value whose target is beyond all its tokens / RATE gets these, the values below their bound share what
it leaves in proportion to their targets, and rounds go on until none of the last ones changed a probability by ``TOLERANCE``. The SQL of
op9_mixing takes ``SQL_ROUNDS`` rounds, several times what the given tables need. ``rake`` is the plain form of a fixed number of rounds.

``labels`` gives the topic: toxic, high or low quality, or none. The tables that are raked have one row per cell; documents are only
counted (partially before the shuffle) and joined with their cell, by broadcast if Spark finds the cells small, else by a join whose
hot cells Spark splits. Null sources, languages and topics are values of their own. A cell without tokens keeps its documents with
probability RATE. Rows of one id share their fate; rows without id are drawn as one. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

SIDES = ("source", "lang", "topic")
ROUNDS, TEMPER, RATE = 10, 0.6, 0.6
SQL_ROUNDS = 1500
#: Up to FEW cells are raked as arrays of one row, MANY rounds a query; more are dealt out, ROUNDS rounds a query.
TOLERANCE, FEW, MANY = 1e-11, 10_000, 200
_WORDS = r"[^\\x20\\x09-\\x0D]+"


def with_topic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``_topic``; of several labels of an id the greatest count."""
    named = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_quality"), F.max("toxic").alias("_toxic"))
    topic = F.when(F.col("_toxic") == 1, "toxic").when(F.col("_quality") == 1, "high").when(F.col("_quality") == 0, "low").otherwise("none")
    # labels grow with the documents, so they are never broadcast
    return docs.join(named.hint("merge"), F.col("doc_id") == F.col("_id"), "left").withColumn("_topic", topic).drop("_id", "_quality", "_toxic")


def _start(cells: DataFrame, temper: float, rate: float, reachable: bool) -> DataFrame:
    """Cells with their targets and first weights."""
    out = cells.select(*SIDES, "tokens", F.col("tokens").cast("double").alias("weight"))
    total = cells.agg(F.sum("tokens").alias("total"))  # one row
    for s in SIDES:
        power = cells.groupBy(F.col(s).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("power"), (F.sum("tokens") / F.lit(rate)).alias("most"))
        if reachable:
            target = power.select("value", F.least("most", F.col("power") * F.lit(_scale(power, rate))).alias(f"target_{s}"))
        else:
            target = power.crossJoin(power.agg(F.sum("power").alias("powers"))).crossJoin(total)
            target = target.select("value", (F.col("total") * F.col("power") / F.col("powers")).alias(f"target_{s}"))
        out = out.join(target, F.col(s).eqNullSafe(F.col("value"))).drop("value")
    return stored(out)


def _scale(power: DataFrame, rate: float) -> float:
    """The factor by which powers, each up to its value's ``most``, sum to all tokens."""
    scale = 0.0
    while True:
        full = F.col("power") * F.lit(scale) >= F.col("most")
        r = power.agg((F.sum("most") * rate).alias("total"), F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("power"))).alias("free")).first()
        new = (r["total"] - r["full"]) / r["free"] if r["free"] else 0.0
        if new <= scale * (1 + 1e-12):
            return scale
        scale = new


def _round(cells: DataFrame, rate: float) -> DataFrame:
    for s in SIDES:
        held = F.sum("weight").over(Window.partitionBy(s))
        scaled = F.least(F.col("weight") * F.col(f"target_{s}") / held, F.col("tokens") / F.lit(rate))
        cells = cells.withColumn("weight", F.when(held > 0, scaled).otherwise(F.col("weight")))
    return cells


def rake(cells: DataFrame, rounds: int = ROUNDS, temper: float = TEMPER, rate: float = RATE) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight``, after so many rounds."""
    cells = _start(cells, temper, rate, False)
    for r in range(rounds):
        cells = _round(cells, rate)
        if r % 2:
            cells = stored(cells)
    return cells


def rake_fully(cells: DataFrame, temper: float = TEMPER, rate: float = RATE) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with converged ``weight``, to targets within reach."""
    cells = _start(cells, temper, rate, True)
    if cells.count() <= FEW:
        return _raked_as_arrays(cells, rate)
    while True:
        for _ in range(ROUNDS):
            cells = _round(cells.withColumn("before", F.col("weight")), rate)
        cells = stored(cells)
        change = cells.where("tokens > 0").agg(F.max(F.abs(F.col("weight") - F.col("before")) / F.col("tokens") * rate)).first()[0]
        if not change or change < TOLERANCE:
            return cells.drop("before")


def _raked_as_arrays(cells: DataFrame, rate: float) -> DataFrame:
    """The same rounds on one row of arrays, one entry a cell; ``code`` numbers the values of a side, ``members`` has the cells of each."""
    one = cells.agg(F.array_sort(F.collect_list(F.struct(*cells.columns))).alias("cells")).where(F.size("cells") > 0)

    def value(s: str) -> Column:
        return F.transform("cells", lambda c: F.struct(c[s].alias("value")))

    def code(s: str) -> Column:
        return F.transform(f"of_{s}", lambda v: (F.array_position(f"values_{s}", v) - 1).cast("int"))

    def members(s: str) -> Column:
        return F.transform(f"values_{s}", lambda _, v: F.filter("at", lambda i: F.get(F.col(f"code_{s}"), i) == v))

    one = one.select("cells", F.col("cells.weight").alias("weight"), F.sequence(F.lit(0), F.size("cells") - 1).alias("at"), *[value(s).alias(f"of_{s}") for s in SIDES])
    one = one.select("*", *[F.array_distinct(f"of_{s}").alias(f"values_{s}") for s in SIDES])
    one = one.select("cells", "weight", "at", *[F.col(f"values_{s}") for s in SIDES], *[code(s).alias(f"code_{s}") for s in SIDES])
    one = one.select("cells", "weight", "at", *[f"code_{s}" for s in SIDES], *[members(s).alias(f"members_{s}") for s in SIDES])
    one = stored(one)

    def turn(weight: Column, s: str) -> Column:
        held = F.transform(f"members_{s}", lambda m: F.aggregate(m, F.lit(0.0), lambda a, i: a + F.get(weight, i)))

        def scaled(h: Column, i: Column) -> Column:
            cell, mine, total = F.get(F.col("cells"), i), F.get(weight, i), F.get(h, F.get(F.col(f"code_{s}"), i))
            return F.when(total > 0, F.least(mine * cell[f"target_{s}"] / total, cell["tokens"] / F.lit(rate))).otherwise(mine)

        # the outer transform holds the sums, so that they are taken once
        return F.get(F.transform(F.array(held), lambda h: F.transform("at", lambda i: scaled(h, i))), F.lit(0))

    def held_once(weight: Column, s: str) -> Column:
        return F.get(F.transform(F.array(weight), lambda w: turn(w, s)), F.lit(0))

    def step(weight: Column, _: Column) -> Column:
        for s in SIDES:
            weight = held_once(weight, s)
        return weight

    def rounds(n: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.col("weight"), step)

    while True:
        before = stored(one.withColumn("weight", rounds(MANY)))
        one = stored(before.withColumn("before", F.col("weight")).withColumn("weight", rounds(1)))
        moved = F.transform("at", lambda i: F.when(F.get("cells", i)["tokens"] > 0, F.abs(F.get("weight", i) - F.get("before", i)) / F.get("cells", i)["tokens"] * rate))
        change = one.agg(F.max(F.array_max(moved))).first()[0]
        if not change or change < TOLERANCE:
            break
        one = one.drop("before")
    each = one.select(F.explode(F.arrays_zip("cells", "weight")).alias("x"))
    return each.select(*[F.col(f"x.cells.{c}").alias(c) for c in cells.columns if c != "weight"], F.col("x.weight").alias("weight"))


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mixed(docs: DataFrame, labels: DataFrame, raked: Callable[[DataFrame], DataFrame] = rake_fully, texts: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, source, lang) with _topic, _tokens, _weight (raked tokens of the document), _probability and _kept. Without ``texts``
    the counts are stored instead of being taken once for the cells and once for the documents."""
    # tokens are counted before the join, so that texts are shuffled only where the caller asks for them
    rows = with_topic(docs.withColumn("_tokens", F.expr(f"cast(regexp_count(coalesce(text, ''), '{_WORDS}') as long)")), labels)
    if not texts:
        rows = stored(rows.drop("text"))
    sums = rows.groupBy("source", "lang", F.col("_topic").alias("topic")).agg(F.sum("_tokens").alias("tokens"))
    cells = raked(stored(sums)).select(*[F.col(s).alias(f"_cell_{s}") for s in SIDES], F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0).alias("_factor"))
    same = rows.source.eqNullSafe(F.col("_cell_source")) & rows.lang.eqNullSafe(F.col("_cell_lang")) & (F.col("_topic") == F.col("_cell_topic"))
    out = rows.join(cells, same)
    chance = F.col("_factor") * RATE
    return out.withColumns({"_weight": F.col("_tokens") * F.col("_factor"), "_probability": chance, "_kept": draw(F.col("doc_id")) < chance})


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The sampled documents, all their columns as they were. Other columns than doc_id, text, source and lang may have any name."""
    inner = {c: c if c in ("doc_id", "text", "source", "lang") else f"column{i}" for i, c in enumerate(docs.columns)}
    work = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in inner.items()])
    return mixed(work, labels).where("_kept").select(*[F.col(x).alias(c) for c, x in inner.items()])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"), texts=False)
    return out.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_weight", 2).alias("weight"),
                      F.round("_probability", 4).alias("probability"), F.col("_kept").alias("kept"))


def _sql() -> str:
    # the scale of a side's targets: values in the order of the scale that fills them, the first one that its own scale does not fill
    targets = ",\n".join(f"""c_{s} AS (SELECT {s}, power(sum(tokens), {TEMPER}) AS p, sum(tokens) / {RATE} AS most FROM cells GROUP BY {s}),
o_{s} AS (SELECT *, most / p AS r, sum(most) OVER w - most AS filled, sum(p) OVER () - sum(p) OVER w + p AS free FROM c_{s} WHERE p > 0 WINDOW w AS (ORDER BY most / p, {s} ROWS UNBOUNDED PRECEDING)),
f_{s} AS (SELECT (total - filled) / free AS scale FROM o_{s}, whole WHERE (total - filled) / free <= r ORDER BY r, {s} LIMIT 1),
t_{s} AS (SELECT {s}, least(most, p * scale) AS target_{s} FROM c_{s}, f_{s})""" for s in SIDES)
    joins = " ".join(f"JOIN t_{s} ON cells.{s} IS NOT DISTINCT FROM t_{s}.{s}" for s in SIDES)
    now = f"(SELECT * FROM raked WHERE round < {SQL_ROUNDS})"
    for s in SIDES:
        now = f"(SELECT * REPLACE (least(weight * target_{s} / sum(weight) OVER (PARTITION BY {s}), tokens / {RATE}) AS weight) FROM {now})"
    return f"""
WITH RECURSIVE named AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
docs AS MATERIALIZED (SELECT d.doc_id, d.source, d.lang, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'high' WHEN quality = 0 THEN 'low' ELSE 'none' END AS topic,
  len(regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents d LEFT JOIN named ON d.doc_id = named.doc_id),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY source, lang, topic),
whole AS (SELECT sum(tokens) AS total FROM cells),
{targets},
start AS MATERIALIZED (SELECT 0 AS round, cells.source, cells.lang, cells.topic, tokens, {", ".join(f"target_{s}" for s in SIDES)}, tokens::DOUBLE AS weight FROM cells {joins}),
raked AS (SELECT * FROM start UNION ALL SELECT * REPLACE (round + 1 AS round) FROM {now}),
p AS (SELECT docs.*, CASE WHEN tokens > 0 THEN weight / tokens ELSE 1.0 END AS factor FROM docs JOIN raked c ON c.round = {SQL_ROUNDS} AND docs.source IS NOT DISTINCT FROM c.source AND docs.lang IS NOT DISTINCT FROM c.lang AND docs.topic = c.topic)
SELECT doc_id, source, lang, topic, n_tokens, round(n_tokens * factor, 2) AS weight, round(factor * {RATE}, 4) AS probability,
  ('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < factor * {RATE} AS kept FROM p
"""


SQL = _sql()
