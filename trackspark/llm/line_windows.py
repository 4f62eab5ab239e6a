"""Line deduplication by overlapping windows of three lines, with DataFrame functions only.

A text is split at line feeds; null counts as empty. Each run of three lines is a window, known by 96 bits of hashes of its lines.
Where a window occurs more than once anywhere, all occurrences but the first in the order (doc_id, hash of the text, position; null
ids last) are removed: the lines they cover are merged and dropped. A text of fewer than three lines keeps all.

Rows equal in doc_id and text are one document: their windows are the same occurrences, and all of them get the same result.
Only hashes are shuffled to find repeats; counting is partial before the shuffle, so a window of a third of all texts is no burden,
and the join that marks later occurrences can be split where one window is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunk import computed
from .common import documents

SIZE = 3


def _order(*more):
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "code", *more)


def drop_repeated_windows(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, text (the kept lines). Other columns of ``docs`` are not read."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("code", F.xxhash64("text"))
    lines = F.split("text", "\n", -1)
    hashed = computed(rows.select("doc_id", "code", lines.alias("lines")).where(F.size("lines") >= SIZE),
                      {"a": F.transform("lines", lambda x: F.xxhash64(x)), "b": F.transform("lines", lambda x: F.hash(x))}).drop("lines")
    window = F.transform(F.sequence(F.lit(0), F.size("a") - SIZE), lambda i: F.struct(
        i.alias("at"), F.xxhash64(*[F.col("a")[i + k] for k in range(SIZE)]).alias("w1"), F.hash(*[F.col("b")[i + k] for k in range(SIZE)]).alias("w2")))
    windows = hashed.select("doc_id", "code", F.inline(window))
    firsts = windows.groupBy("w1", "w2").agg(F.min(_order("at")).alias("first"), F.max(_order("at")).alias("last")).where("first != last").drop("last")
    later = windows.join(firsts, ["w1", "w2"]).where(_order("at") != F.col("first"))
    covered = later.groupBy("doc_id", "code").agg(F.collect_set("at").alias("at")).select(
        F.col("doc_id").alias("d"), F.col("code").alias("c"), F.array_distinct(F.flatten(F.transform("at", lambda p: F.array(*[p + k for k in range(SIZE)])))).alias("gone"))
    out = rows.join(covered, rows.doc_id.eqNullSafe(F.col("d")) & (rows.code == F.col("c")), "left")
    out = computed(out.select("doc_id", "text", "gone"), {"lines": lines})
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.col("lines")[i])
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
                      F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))


def op6_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_windows(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
w AS (SELECT doc_id, pos, line, lead(line, 1) OVER (PARTITION BY doc_id ORDER BY pos) AS l1, lead(line, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS l2 FROM l),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, l1, l2 ORDER BY doc_id, pos) AS place FROM w WHERE l2 IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, (SELECT unnest([0, 1, 2]) AS k) AS steps WHERE place > 1),
m AS (SELECT l.doc_id, l.pos, l.line, gone.pos IS NOT NULL AS out FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE out) AS n_removed, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT out), '')) AS kept_md5
FROM m GROUP BY doc_id
"""
