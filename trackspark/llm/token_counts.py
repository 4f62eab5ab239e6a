"""Token counts with overlap resynchronisation.

Texts of up to ``CHUNK`` bytes are encoded whole. Longer ones are cut into chunks that overlap, dealt out over all tasks and
encoded with the offset of every word. Neighbouring chunks are spliced at the first boundary in their overlap that is stable:
both encodings start a word there, preceded by white space in both, and give this word and the next the same ids, none of the words
touching a cut. What follows such a boundary does not depend on what stands before it (see ``tokens``), so the spliced ids are
those of the whole text. Texts with a seam without stable boundary (a long run without white space) are cut again with chunks
and overlaps four times as wide, until one chunk holds the text.

Null counts as an empty text. Each input row gives one row, whatever its doc_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, documents, grouped, stored, sums_per, utf8
from .tokens import WORD_BPE, encoder

CHUNK, OVERLAP = 16_384, 512
#: Tokens of a text beyond which ``over_limit`` holds.
CONTEXT = 2048
_space = np.zeros(256, bool)
_space[list(SPACES)] = True


def _whole(name: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(name)
        for part in grouped(batches):
            data, at = utf8(part.column("text"))
            raw = data.tobytes()
            number, parts = tok.numbered_texts([raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
            n = sums_per(tok.lengths(number), np.concatenate(([0], np.cumsum(parts))))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


CHUNKS = "row long, no long, start long, last boolean, chunk binary"


def _cut(size: int, overlap: int):
    """Chunks of ``size`` bytes, each beginning ``overlap`` bytes before the end of the one before, at whole characters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, limit=1):
            raw, row = utf8(part.column("text"))[0], part.column("row")[0].as_py()
            no, lo = 0, 0
            while True:
                hi = min(len(raw), lo + size)
                while hi < len(raw) and raw[hi] & 0xC0 == 0x80:
                    hi -= 1
                yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([no]), pa.array([lo]), pa.array([hi == len(raw)]), pa.array([raw[lo:hi].tobytes()], pa.binary())], names=["row", "no", "start", "last", "chunk"])
                if hi == len(raw):
                    break
                lo = hi - overlap
                while raw[lo] & 0xC0 == 0x80:
                    lo -= 1
                no += 1

    return run


ZONE = pa.list_(pa.struct([("at", pa.int64()), ("ids", pa.int64())]))
ENCODED = ("row long, no long, last boolean, total long, head array<struct<at:long,ids:long>>, head_before array<long>, "
           "tail array<struct<at:long,ids:long>>, tail_before array<long>")


def _encode(name: str, overlap: int):
    """Token count of a chunk and, for the words that begin in either overlap, offset, hash of the ids of the word and the next,
    and tokens before it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(name)
        for part in grouped(batches, "chunk"):
            out = []
            for row, no, start, last, raw in zip(*(part.column(c).to_pylist() for c in ("row", "no", "start", "last", "chunk")), strict=True):
                words = raw.split()
                number = tok.numbered([w.decode("utf-8", "replace") for w in words])
                length = tok.lengths(number)
                before = np.concatenate(([0], np.cumsum(length)))
                blank = _space[np.frombuffer(raw, np.uint8)]
                at = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
                cut_left = len(words) and at[0] == 0 and no > 0
                cut_right = len(words) and not blank[-1] and not last
                usable = range(1 if cut_left else 0, len(words) - 1 - (1 if cut_right else 0))

                def zone(of):
                    return [{"at": int(at[i]) + start, "ids": zlib.crc32(tok.flat(number[i : i + 2]).tobytes()) << 16 | int(length[i] & 0xFFFF)} for i in of], [int(before[i]) for i in of]

                head = [i for i in usable if at[i] < overlap] if no else []
                tail = [] if last else [i for i in usable if at[i] >= len(raw) - overlap - 4]
                out.append((row, no, last, int(before[-1]), *zone(head), *zone(tail)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), ZONE, pa.list_(pa.int64()), ZONE, pa.list_(pa.int64())), strict=True)],
                                             names=["row", "no", "last", "total", "head", "head_before", "tail", "tail_before"])

    return run


def _long_counts(rows: DataFrame, name: str, size: int, overlap: int) -> DataFrame:
    """(row, n_tokens) of long texts."""
    chunks = rows.select("row", "text").mapInArrow(_cut(size, overlap), CHUNKS).repartition("row", "no")
    coded = chunks.mapInArrow(_encode(name, overlap), ENCODED)
    after = Window.partitionBy("row").orderBy("no")
    seam = F.get(F.array_intersect("tail", F.col("next.head")), F.lit(0))
    ends = (coded.withColumn("next", F.lead(F.struct("head", "head_before")).over(after)).withColumn("seam", seam)
            .select("row", "last", F.when(F.col("last"), F.col("total")).otherwise(F.get("tail_before", F.array_position("tail", F.col("seam")).cast("int") - 1)).alias("upto"),
                    F.when(F.col("last"), F.lit(0)).otherwise(F.get(F.col("next.head_before"), F.array_position("next.head", F.col("seam")).cast("int") - 1)).alias("skipped")))
    # a seam adds the tokens before it in the left chunk and takes away those before it in the right one
    sums = stored(ends.groupBy("row").agg(F.sum("upto").alias("plus"), F.sum("skipped").alias("minus"), F.bool_or(F.col("upto").isNull()).alias("failed"))
                  .select("row", (F.col("plus") - F.col("minus")).alias("n_tokens"), "failed"))
    done = sums.where("not failed").select("row", "n_tokens")
    if sums.where("failed").isEmpty():
        return done
    again = rows.join(sums.where("failed").select("row"), "row", "left_semi")
    return done.unionByName(_long_counts(again, name, 4 * size, 4 * overlap))


def token_counts(docs: DataFrame, tokenizer: str = WORD_BPE, limit: int = CONTEXT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit. Other columns of ``docs`` are not read."""
    docs = docs.select("doc_id", "text")
    long = F.octet_length(F.coalesce("text", F.lit(""))) > CHUNK
    short = docs.where(~long).mapInArrow(_whole(tokenizer), "doc_id long, n_bytes long, n_tokens long")
    rows = stored(docs.where(long).withColumn("row", F.monotonically_increasing_id()))
    counted = (rows.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
               .join(_long_counts(rows, tokenizer, CHUNK, OVERLAP), "row").drop("row"))
    return short.unionByName(counted).withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir, "doc_id", "text"))
