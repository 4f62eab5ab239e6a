"""Ranked lexical search by pipelined term partitioning.

The index is dealt by term: an owner holds all postings of its terms. Items travel in bundles from owner to owner; a bundle carries
the documents that may still be among an item's best, with the sum of their contributions so far, and each owner adds its integer
contributions. After the last owner the best are selected.

Owners are ordered by term weight (``OWNERS``), rare terms first, so accumulators stay sparse without losing a result: after each stage
the tenth best sum of an item, over all documents, bounds its final tenth best from below, and the largest contributions of the
terms to come (from the index) bound what a document can still gain. A document that cannot reach the tenth best, ties included, is
let go, and documents not met before are only taken in while they could reach it. A document let go may be met again by a later owner;
its sum is then too small, but its true one is below the tenth best as well, so it is never among the results.

Blocks: an index block is a run of documents of bounded size, in one row per term with the positions, counts and lengths of the documents
that hold it, and one row without term that lists the documents. A stage is a cogroup of bundles and postings by (block, bundle), so
a term or an item that most documents match is work for all tasks, and a group is bounded by the block and ``BUNDLE``. The index holds
only terms that pass a Bloom filter of the items' terms, of a fixed size; the join with the items' terms is exact.

Terms are runs of letters, digits and bytes from 128 on, with only A-Z lower-cased. Null and empty texts have none and count for
nothing. Each row is a document of its own, also where doc_id is repeated or null; ties are in the order of doc_id, null last. Rows of
items that share an item_id (or have none) are one item with the terms of all. Items without known terms have no rows. Other columns
are not read. Tables without rows or terms give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import discard
from .common import U, RangeHash, documents, grouped, lists, mix, stored, utf8
from .terms import ALNUM, coded

TOP = 10
#: Least weight of the terms of each owner; the last one has the rest. A thousand times the natural logarithm of 1 / share.
OWNERS = (6000, 4000, 2000, 0)
#: Text bytes and documents of an index block, and items of a bundle on average. They bound a group, results do not depend on them.
BLOCK_BYTES, BLOCK_DOCS, BUNDLE = 4 << 20, 4096, 128
#: Bits of the filter of item terms (1 MB).
FILTER_BITS = 1 << 23
_hash = RangeHash(61)


def _places(terms: pa.Array) -> np.ndarray:
    """Three bit positions per term."""
    data, at = utf8(terms)
    h = _hash.load(data).ranges(at[:-1], at[1:])
    return np.stack([h, mix(h), mix(h + U(1))]) % U(FILTER_BITS)


def _item_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in grouped(batches):
        terms, code, row = coded(*utf8(piece.column("text")), ALNUM)
        key = np.unique(row * max(1, len(terms)) + code)
        yield pa.record_batch([piece.column("item_id").take(pa.array(key // max(1, len(terms)))), terms.take(pa.array(key % max(1, len(terms)))).cast(pa.string())], ["item_id", "term"])


def _filter_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        if batch.num_rows:
            bits[_places(batch.column("term")).ravel()] = True
    packed = np.packbits(bits).view(np.int64)
    at = np.flatnonzero(packed)
    yield pa.record_batch([pa.array(at), pa.array(packed[at])], ["at", "word"])


def term_filter(terms: DataFrame) -> np.ndarray:
    """Bits of all terms as bytes; what reaches the driver is bounded by FILTER_BITS."""
    rows = terms.select("term").mapInArrow(_filter_words, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    packed = np.zeros(FILTER_BITS // 64, np.int64)
    packed[rows.column("at").to_numpy()] = rows.column("word").to_numpy()
    return packed.view(np.uint8)


INDEX = "block long, term string, at array<int>, tf array<int>, n array<long>, ids array<long>"


def build_index(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Postings of the terms that pass the filter, by block (see above); stored."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def block_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        seen = shared.value
        for piece in grouped(batches, limit=BLOCK_BYTES):
            for lo in range(0, piece.num_rows, BLOCK_DOCS):
                rows = piece.slice(lo, BLOCK_DOCS)
                terms, code, doc = coded(*utf8(rows.column("text")), ALNUM)
                n = np.bincount(doc, minlength=rows.num_rows).astype(np.int64)
                have = np.flatnonzero(n)
                if not len(have):
                    continue
                place = _places(terms)
                wanted = (seen[place >> U(3)] >> (U(7) - (place & U(7))).astype(np.uint8) & 1).all(axis=0)
                keep = wanted[code]
                key, tf = np.unique(code[keep] * rows.num_rows + doc[keep], return_counts=True)
                code, doc = key // rows.num_rows, key % rows.num_rows
                local = np.cumsum(n > 0) - 1  # position among the documents with terms
                present, count = np.unique(code, return_counts=True)
                ends = np.concatenate((count, [len(have)]))
                ids = rows.column("doc_id").take(pa.array(have)).cast(pa.int64())
                yield pa.record_batch([
                    pa.array(np.full(len(ends), number)), pa.concat_arrays([terms.take(pa.array(present)).cast(pa.string()), pa.nulls(1, pa.string())]),
                    lists(np.concatenate((local[doc], np.arange(len(have)))).astype(np.int32), ends),
                    lists(np.concatenate((tf, np.zeros(len(have), np.int64))).astype(np.int32), ends), lists(np.concatenate((n[doc], n[have])), ends),
                    pa.ListArray.from_arrays(pa.array(np.concatenate((np.zeros(len(present) + 1, np.int32), [len(have)])).astype(np.int32)), ids),
                ], ["block", "term", "at", "tf", "n", "ids"])
                number += 1

    return stored(docs.select("doc_id", "text").mapInArrow(block_rows, INDEX))


def _arrays(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and where each row's begin."""
    whole = column.combine_chunks()
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], column.type)
    return whole.flatten().to_numpy(zero_copy_only=False), whole.offsets.to_numpy() - (whole.offsets[0].as_py() if len(whole) else 0)


ACC = "block long, bundle int, item long, at array<int>, score array<long>, best array<long>"


def _stage(n_docs: int, n_terms: int, top: int):
    """One owner's turn with a bundle in a block. ``floor`` is the item's tenth best so far, ``rest`` what later owners can add, ``more`` what
    this and later owners can add."""

    def turn(key, left: pa.Table, right: pa.Table) -> pa.Table:
        block, bundle = (k.as_py() for k in key)
        at, at_row = _arrays(right.column("at"))
        tf, n = (_arrays(right.column(c))[0].astype(np.int64) for c in ("tf", "n"))
        m = 10 + 90 * n * n_docs // n_terms
        gain = 1_000_000_000 * tf // (1000 * tf + 8 * m)
        weight = right.column("w").to_numpy()
        to = right.column("items").combine_chunks()
        to = pa.concat_arrays(to.chunks) if isinstance(to, pa.ChunkedArray) else to
        to_row = to.offsets.to_numpy() - (to.offsets[0].as_py() if len(to) else 0)
        fields = {f: to.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("item", "floor", "more", "rest")}
        old, old_row = _arrays(left.column("at"))
        old_score = _arrays(left.column("score"))[0]
        known = {f: np.concatenate((left.column(f).to_numpy(), fields[f])) for f in ("item", "floor", "more", "rest")}
        items, first, number = np.unique(known["item"], return_index=True, return_inverse=True)
        floor, more, rest = (known[f][first] for f in ("floor", "more", "rest"))
        own, number = number[: left.num_rows], number[left.num_rows :]
        width = int(max(old.max(initial=-1), at.max(initial=-1))) + 1
        sums = np.zeros((len(items), width), np.int64)
        met = np.repeat(more >= floor, width).reshape(sums.shape)
        for i, row in enumerate(own):
            part = old[old_row[i] : old_row[i + 1]]
            sums[row, part] = old_score[old_row[i] : old_row[i + 1]]
            met[row, part] = True
        for i in range(right.num_rows):
            lo, hi = at_row[i], at_row[i + 1]
            sums[np.ix_(number[to_row[i] : to_row[i + 1]], at[lo:hi])] += weight[i] * gain[lo:hi]
        sums[~met] = 0
        if width > top:  # the tenth best of this block alone is a bound, too
            floor = np.maximum(floor, np.partition(sums, width - top, axis=1)[:, width - top])
        keep = (sums > 0) & (sums + rest[:, None] >= floor[:, None])
        count = keep.sum(axis=1)
        out = np.flatnonzero(count)
        best = [np.sort(s[k])[::-1][:top] for s, k in zip(sums[out], keep[out], strict=True)]
        none = np.zeros(0, np.int64)
        return pa.table({
            "block": pa.array(np.full(len(out), block, np.int64)), "bundle": pa.array(np.full(len(out), bundle, np.int32)), "item": pa.array(items[out].astype(np.int64)),
            "at": lists(np.nonzero(keep[out])[1].astype(np.int32), count[out]), "score": lists(sums[out][keep[out]], count[out]),
            "best": lists(np.concatenate([none, *best]), np.array([len(b) for b in best], np.int64)),
        })

    return turn


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents (doc_id, text) of each item (item_id, text) by score, of those above 0."""
    spark = docs.sparkSession
    terms = items.select("item_id", "text").mapInArrow(_item_terms, items.select("item_id", F.lit("").alias("term")).schema)
    named = stored(terms.groupBy("item_id").agg(F.collect_set("term").alias("terms")).withColumn("item", F.monotonically_increasing_id()))
    bundles = max(1, -(-named.count() // BUNDLE))
    pairs = named.select("item", F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int").alias("bundle"), F.explode("terms").alias("term"))
    index = build_index(docs, term_filter(pairs.select("term").distinct()))
    n_docs, n_terms = index.where("term IS NULL").agg(F.coalesce(F.sum(F.size("at")), F.lit(0)), F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    result = [f.dataType.simpleString() for f in (items.schema["item_id"], docs.schema["doc_id"])]
    if not n_docs:
        return spark.createDataFrame([], f"item_id {result[0]}, rank int, doc_id {result[1]}, score long")
    # weight of each term, its owner, and the largest contribution that any document gets from it
    gain = F.expr(f"array_max(zip_with(tf, n, (t, k) -> (1000000000L * t) div (1000L * t + 8L * (10L + (90L * k * {n_docs}L) div {n_terms}L))))")
    stats = index.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("at")).alias("df"), F.max(gain).alias("most"))
    stats = stats.withColumn("w", F.floor(1000 * F.log((2 * F.lit(float(n_docs)) + 2) / (2 * F.col("df") + 1))).cast("long")).where("w > 0")
    owner = F.lit(len(OWNERS) - 1)
    for k in reversed(range(len(OWNERS) - 1)):
        owner = F.when(F.col("w") >= OWNERS[k], k).otherwise(owner)
    owned = stored(pairs.join(stats, "term").select("item", "bundle", "term", "w", owner.alias("owner"), (F.col("w") * F.col("most")).alias("bound")))
    state = owned.groupBy("item").agg(*[F.sum(F.when(F.col("owner") >= k, F.col("bound")).otherwise(0)).alias(f"more{k}") for k in range(len(OWNERS))])
    state = state.withColumn(f"more{len(OWNERS)}", F.lit(0).cast("long"))
    carried = spark.createDataFrame([], ACC)
    for k in range(len(OWNERS)):
        floors = carried.select("item", F.explode("best").alias("s")).withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("s"))))
        floors = floors.where(F.col("r") <= top).groupBy("item").agg(F.count("*").alias("have"), F.min("s").alias("s"))
        now = state.join(floors, "item", "left").select("item", F.when(F.col("have") == top, F.col("s")).otherwise(0).alias("floor"), F.col(f"more{k}").alias("more"), F.col(f"more{k + 1}").alias("rest"))
        sent = owned.where(F.col("owner") == k).join(now, "item").groupBy("term", "bundle", "w").agg(F.collect_list(F.struct("item", "floor", "more", "rest")).alias("items"))
        postings = index.where("term IS NOT NULL").join(sent, "term").select("block", "bundle", "at", "tf", "n", "w", "items")
        came = carried.drop("best").join(now, "item")
        after = stored(came.groupBy("block", "bundle").cogroup(postings.groupBy("block", "bundle")).applyInArrow(_stage(n_docs, n_terms, top), ACC))
        discard(carried)
        carried = after
    found = carried.select("block", "item", F.explode(F.arrays_zip("at", "score")).alias("x")).select("block", "item", F.col("x.at").alias("at"), F.col("x.score").alias("score"))
    named_docs = index.where("term IS NULL").select("block", "ids")
    found = found.join(named_docs, "block").select("item", F.element_at("ids", F.col("at") + 1).cast(result[1]).alias("doc_id"), "score")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(named.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) AS docs, sum(len(words))::BIGINT AS total FROM d WHERE len(words) > 0),
p AS (SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM d),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, docs),
c AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total)))) AS part FROM t JOIN w USING (term), s),
f AS (SELECT item_id, r, doc_id, sum(part)::BIGINT AS score FROM q JOIN c USING (term) GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM f WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
