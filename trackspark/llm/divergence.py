"""Source divergence audit by token-start pointer sort.

A shard is the texts that a task holds at a time. Pointers to the beginnings of its words are built over the Arrow text buffer and sorted by
multikey quicksort, a character being eight bytes: pointers whose words agree so far are sorted by the next eight bytes, all such runs
in one pass, until every run of equal pointers is one word. Documents lie in the buffer by (language, source), so within a run
pointers to one document, and to one group, stand together; their numbers give document frequency and source counts. Spark adds up
the counts of all shards.

Divergence: in a language the terms in at least ``LEAST`` of its documents are kept (V of them). A group, and the language as a whole, gives a
kept term p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N its occurrences of kept terms; two distributions differ by the sum of
floor((p - q)^2 / (p + q)). All numbers are exact: decimals where a product could leave 64 bits, integers elsewhere.

Sums for pairs of sources do not make rows of pairs of terms' sources. Where neither source has a term, the summand is the same for all
such terms, so V times that summand is corrected for the terms that one of them has. Corrections are added in tiles: a slice of a
language's terms, a block of its sources against another, as matrices of bounded size (``SLICE``, ``SIDE``); tiles give one row for each
pair of sources. The sum is the same both ways, so a pair of blocks is computed once.

Null text, lang and source count as ''. Terms are runs of letters and bytes from 128 on with A-Z lower-cased. Each row is a document,
repeated rows and null ids included; doc_id and other columns are not read. A group without terms, and a language without kept terms,
still have their ``pair`` rows. A language of one source has no pairs. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stored, utf8
from .terms import LETTERS, LOWER, spans

LEAST, TOP = 10, 10
#: Text bytes of a shard, terms of a slice and sources of a block. They bound memory, results do not depend on them.
SHARD, SLICE, SIDE = 8 << 20, 2048, 64
_U8 = np.dtype(">u8")
_MASK = np.array([0xFFFFFFFFFFFFFFFF ^ ((1 << (8 * (8 - k))) - 1) for k in range(9)], np.uint64)


def pointer_sort(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pointers ``start`` by the words they begin (up to ``end``), equal words by position, and the first of each run of equal
    words in that order. ``data`` goes on for eight bytes after the last word."""
    n = len(start)
    order = np.arange(n)
    run = np.zeros(n, np.int64)  # run of each place of the order: the first place of words equal so far
    open_, depth = order.copy(), 0  # places whose run may fall apart
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    while len(open_):
        pointer = order[open_]
        left = np.clip(end[pointer] - start[pointer] - depth, 0, 8)
        char = eight[np.minimum(start[pointer] + depth, len(eight) - 1)].copy().view(_U8).ravel().astype(np.uint64) & _MASK[left]
        by = np.lexsort((char, run[open_])) if depth else np.argsort(char)
        order[open_] = pointer[by]
        char, left, old = char[by], left[by], run[open_]
        new = np.ones(len(open_), bool)
        new[1:] = (char[1:] != char[:-1]) | (old[1:] != old[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(open_)))
        run[open_] = np.repeat(open_[first], size)
        # a run of one is done, and so is one whose words have ended: its last character has a zero byte
        open_ = open_[np.repeat(size > 1, size) & (left == 8)]
        depth += 8
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if n else run
    place = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    order = np.sort(place * max(1, n) + order) % max(1, n)  # equal words by position
    return order, first


def shard_counts(rows: pa.Table) -> pa.RecordBatch:
    """lang, source, term, docs, count of one shard."""
    pair = [pc.fill_null(rows.column(c).cast(pa.string()), "").combine_chunks().dictionary_encode() for c in ("lang", "source")]
    pair = [pa.concat_arrays(p.chunks) if isinstance(p, pa.ChunkedArray) else p for p in pair]
    code = pair[0].indices.to_numpy().astype(np.int64) * max(1, len(pair[1].dictionary)) + pair[1].indices.to_numpy()
    rows, by = rows.column("text").take(pa.array(np.argsort(code, kind="stable"))), np.sort(code)
    data, at = utf8(rows)
    data = np.concatenate((LOWER[data], np.zeros(8, np.uint8)))
    start, end = spans(data[:-8], at, LETTERS)
    order, first = pointer_sort(data, start, end)
    doc = np.searchsorted(at, start[order], "right") - 1
    new_run = np.zeros(len(order), bool)
    new_run[first] = True
    new_doc, new_group = new_run.copy(), new_run
    new_doc[1:] |= doc[1:] != doc[:-1]
    new_group[1:] |= by[doc[1:]] != by[doc[:-1]]
    out = np.flatnonzero(new_group)
    pointer, which = order[out], by[doc[out]]
    width = max(1, len(pair[1].dictionary))
    size = end[pointer] - start[pointer]
    offsets = np.concatenate(([0], np.cumsum(size)))
    body = data[np.repeat(start[pointer] - offsets[:-1], size) + np.arange(offsets[-1])]
    term = pa.Array.from_buffers(pa.large_utf8(), len(out), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)]).cast(pa.string())
    docs = np.add.reduceat(new_doc.astype(np.int64), out) if len(out) else out
    return pa.record_batch([pair[0].dictionary.take(pa.array(which // width)), pair[1].dictionary.take(pa.array(which % width)), term,
                            pa.array(docs), pa.array(np.diff(np.append(out, len(order))))], ["lang", "source", "term", "docs", "count"])


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        lo, at = 0, utf8(batch.column("text"))[1]
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SHARD - size, "right")) - 1)
            held.append(batch.slice(lo, hi - lo))
            size += int(at[hi] - at[lo])
            lo = hi
            if size >= SHARD or hi < batch.num_rows:
                yield shard_counts(pa.Table.from_batches(held))
                held, size = [], 0
    if held:
        yield shard_counts(pa.Table.from_batches(held))


def source_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, docs (that hold it), count (occurrences)."""
    shards = docs.select("text", "lang", "source").mapInArrow(_shards, "lang string, source string, term string, docs long, count long")
    return shards.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("count"))


def _share(count: str, n: str) -> F.Column:
    """p of ``count`` occurrences of ``n``. A decimal, since 10^9 times a count of a large corpus leaves 64 bits."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * cast({count} + 2 as decimal(20,0))) div cast({n} + 2 * v as decimal(20,0))").cast("long")


def _differ(p: str, q: str) -> F.Column:
    # shares are below 2^30.1, so the square fits
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _tile(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Corrections of one tile: for each pair of its sources the sum over its terms of f(p, q) less f of both without the term."""
    lang, low, high = key[0].as_py(), key[2].as_py(), key[3].as_py()
    name, term = (pa.chunked_array(rows.column(c).chunks, pa.string()).combine_chunks().dictionary_encode() for c in ("source", "term"))
    name, term = (pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x for x in (name, term))
    source, real = name.indices.to_numpy(), term.is_valid().to_numpy(zero_copy_only=False)
    base, of = np.zeros(len(name.dictionary), np.int64), np.zeros(len(name.dictionary), np.int64)
    base[source], of[source] = rows.column("p0").to_numpy(), rows.column("block").to_numpy()
    share = np.repeat(base[:, None], len(term.dictionary), axis=1)
    share[source[real], term.indices.drop_null().to_numpy()] = rows.column("p").to_numpy()[real]
    a, b = np.flatnonzero(of == low), np.flatnonzero(of == high)
    out = [np.zeros(0, np.int64)]
    for s in a:
        f = (share[s] - share[b]) ** 2 // (share[s] + share[b])
        out.append(f.sum(axis=1) - (base[s] - base[b]) ** 2 // (base[s] + base[b]) * share.shape[1])
    value, x, y = np.concatenate(out), np.repeat(a, len(b)), np.tile(b, len(a))
    if low != high:
        value, x, y = np.tile(value, 2), np.concatenate((x, y)), np.concatenate((y, x))
    return pa.table({"lang": pa.array([lang] * len(value), pa.string()), "source": name.dictionary.take(pa.array(x)), "item": name.dictionary.take(pa.array(y)), "extra": value})


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of a language's sources, and each group's ``top`` terms above the language."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    counts = stored(source_counts(docs))
    words = stored(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("all")).where(F.col("docs") >= least).drop("docs"))
    kept = counts.join(words, ["lang", "term"]).select("lang", "source", "term", "count", "all")
    whole = words.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("total"))
    totals = stored(groups.join(kept.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left")
                    .join(whole, "lang", "left").na.fill(0, ["n", "v", "total"]))
    # blocks of sources and slices of terms are by hash; a language with few has one
    size = totals.groupBy("lang").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("blocks"), F.ceil(F.max("v") / SLICE).cast("int").alias("slices"))
    shares = totals.where("v > 0").join(size, "lang").withColumns({"block": F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"), "p0": _share("0", "n")})
    shares = stored(shares)
    terms = kept.join(shares, ["lang", "source"]).withColumn("p", _share("count", "n"))
    rows = terms.select("lang", "source", "block", "blocks", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"), "term", "p", "p0")
    # every tile knows its sources, also those without any of its terms
    rest = shares.select("lang", "source", "block", "blocks", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), "p0")
    tiles = rows.unionByName(rest).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("lang", "slice", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "source", "block", "term", "p", "p0")
    extra = tiles.groupBy("lang", "slice", "low", "high").applyInArrow(_tile, "lang string, source string, item string, extra long")
    extra = extra.groupBy("lang", "source", "item").agg(F.sum("extra").alias("extra"))
    mine = totals.select("lang", "source", "v").join(shares.select("lang", "source", "p0"), ["lang", "source"], "left")
    both = mine.join(mine.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")), "lang").where("source != item")
    value = F.coalesce(F.col("v") * _differ("p0", "q0"), F.lit(0)) + F.coalesce("extra", F.lit(0))
    pairs = both.join(extra, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    above = terms.withColumn("q", _share("all", "total")).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _differ("p", "q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    return pairs.withColumn("rank", rank).unionByName(above.withColumn("rank", rank).where(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir, "text", "lang", "source"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT r, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*) AS v, sum(c)::BIGINT AS n FROM k GROUP BY lang),
c AS (SELECT o.lang, o.source, o.term, count(*) AS c FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY o.lang, o.source, o.term),
n AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0)::BIGINT AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
s AS MATERIALIZED (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, (1 + (1000000000 * (coalesce(c.c, 0) + 2)) // (n.n + 2 * l.v))::BIGINT AS p,
  (1 + (1000000000 * (k.c + 2)) // (l.n + 2 * l.v))::BIGINT AS q
  FROM n JOIN l ON l.lang = n.lang JOIN k ON k.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM s WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r
QUALIFY part = 'pair' OR rank <= 10
"""
