"""Token ids as compressed files, in ascending doc_id order.

Documents are range-partitioned by doc_id and sorted (null ids first, equal ids by a hash of the text). Each partition becomes a
sequence of blocks of whole documents with about ``BLOCK_IDS`` ids; a longer document is a block alone. The frequencies of all ids
of the whole table are counted and scaled to one shared table, and each block is encoded independently with it (``rans``).

Files: a folder with ``tables`` (id, frequency) and ``blocks`` (part, no, n_ids, doc_ids, lengths, data), in the session's shared
folder or where the caller says, written by Spark's own writers: any store works, and a lost executor costs its tasks only.
Blocks in the order (part, no) hold the ids in ascending doc_id order. Null texts count as empty; each text ends with ``end``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, grouped, lists, scratch_dir, stored, sums_per, utf8
from .rans import Table, decode, encode
from .tokens import WORD_BPE, encoder

END = 2
BLOCK_IDS = 1 << 19
RAW = "part int, no int, n_ids long, doc_ids array<long>, lengths array<long>, ids binary"


def _block(part: int, no: int, docs: list, lengths: list, ids: list) -> pa.RecordBatch:
    flat = np.concatenate(ids)
    # two bytes are enough for ids of most vocabularies
    raw = flat.astype("<u2") if len(flat) == 0 or flat.max() < 1 << 16 else flat.astype("<u4")
    return pa.RecordBatch.from_arrays([
        pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([len(flat)]), pa.array([docs], pa.list_(pa.int64())),
        lists(np.array(lengths, np.int64), np.array([len(lengths)])), pa.array([raw.tobytes()], pa.binary())], names=["part", "no", "n_ids", "doc_ids", "lengths", "ids"])


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def _tokenised(name: str, end: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, no = encoder(name), TaskContext.get().partitionId(), 0
        docs, lengths, ids, held, last = [], [], [], 0, np.array([end], np.uint32)
        for b in grouped(batches):
            data, at = utf8(b.column("text"))
            raw = data.tobytes()
            number, parts = tok.numbered_texts([raw[lo:hi] for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
            count = sums_per(tok.lengths(number), np.concatenate(([0], np.cumsum(parts))))
            each = np.split(tok.flat(number), np.cumsum(count)[:-1])
            for doc_id, flat in zip(b.column("doc_id").to_pylist(), each, strict=True):
                docs.append(doc_id)
                lengths.append(len(flat) + 1)
                ids += [flat, last]
                held += lengths[-1]
                if held >= BLOCK_IDS:
                    yield _block(part, no, docs, lengths, ids)
                    docs, lengths, ids, held, no = [], [], [], 0, no + 1
        if docs:
            yield _block(part, no, docs, lengths, ids)

    return run


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for b in batches:
        for raw, n in zip(b.column("ids").to_pylist(), b.column("n_ids").to_pylist(), strict=True):
            c = np.bincount(_ids(raw, n))
            if len(c) > len(total):
                total = np.concatenate((total, np.zeros(len(c) - len(total), np.int64)))
            total[: len(c)] += c
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])


FILE = "part int, no int, n_ids long, doc_ids array<long>, lengths array<long>, data binary"


def _encoded(frequency: bytes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(np.frombuffer(frequency, np.int64))
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                data = encode(_ids(row.column("ids")[0].as_py(), row.column("n_ids")[0].as_py()), table)
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("part", "no", "n_ids", "doc_ids", "lengths")), pa.array([data], pa.binary())],
                                                 names=["part", "no", "n_ids", "doc_ids", "lengths", "data"])

    return run


def _decoded(frequency: bytes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(np.frombuffer(frequency, np.int64))
        for b in batches:
            for i in range(b.num_rows):
                ids = decode(b.column("data")[i].as_py(), table).astype("<u4")
                n = np.array(b.column("lengths")[i].as_py(), np.int64)
                end = np.cumsum(n)
                if end[-1] != len(ids):
                    raise ValueError("lengths and ids differ")
                crc = [zlib.crc32(ids[x - y : x].tobytes()) for x, y in zip(end.tolist(), n.tolist(), strict=True)]
                same = np.ones(len(n), np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(same * b.column("part")[i].as_py()), pa.array(same * b.column("no")[i].as_py()), pa.array(b.column("doc_ids")[i].as_py(), pa.int64()),
                    pa.array(end - n), pa.array(n), pa.array(crc, pa.int64())], names=["part", "no", "doc_id", "ahead", "n_tokens", "ids_crc32"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str = WORD_BPE, end: int = END) -> None:
    """Write the files of ``docs`` (doc_id, text) to the folder ``path``. No rows give an empty table of blocks."""
    spark = docs.sparkSession
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    raw = stored(ordered.mapInArrow(_tokenised(tokenizer, end), RAW))
    counts = raw.select("ids", "n_ids").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counts.collect()  # one row per id of the vocabulary at most
    total = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        total[r.id] = r.n
    frequency = Table.of_counts(total).frequency.astype(np.int64)
    spark.createDataFrame(pa.table({"id": np.arange(len(frequency)), "frequency": frequency})).coalesce(1).write.parquet(f"{path}/tables")
    raw.mapInArrow(_encoded(frequency.tobytes()), FILE).write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32."""
    rows = spark.read.parquet(f"{path}/tables").orderBy("id").collect()  # bounded by the vocabulary
    frequency = np.array([r.frequency for r in rows], np.int64)
    blocks = spark.read.schema(FILE).parquet(f"{path}/blocks")
    order, all_before = Window.partitionBy("part").orderBy("no"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    head = blocks.select("part", "no", "n_ids")
    parts = head.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(all_before), F.lit(0)).alias("first"))
    starts = (head.withColumn("inside", F.sum("n_ids").over(order) - F.col("n_ids")).join(parts, "part")
              .select("part", "no", (F.col("first") + F.col("inside")).alias("begin")))
    docs = blocks.select("part", "no", "lengths", "doc_ids", "data").mapInArrow(_decoded(frequency.tobytes()), "part int, no int, doc_id long, ahead long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "no"]).select("doc_id", (F.col("begin") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")


def tokens_by_files(docs: DataFrame) -> DataFrame:
    path = scratch_dir(docs.sparkSession)
    write_tokens(docs, path)
    return read_tokens(docs.sparkSession, path)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_by_files(documents(spark, sf_dir, "doc_id", "text"))
