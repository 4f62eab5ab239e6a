"""Exact duplicates by Grace hashing.

Texts are equal when they are the same after every ASCII white-space character is deleted; null counts as empty. Of equal
texts the row with the most code points stays, then the smallest doc_id (null last), then the first in reading order.

1. Each task groups the copies it reads itself, so a text that a third of all rows repeat leaves a task once.
2. The groups of all tasks are partitioned by a hash of the content. A task that gets more than ``limit`` bytes partitions
   them again to spill files by the next bits of the hash, recursively, until a bucket fits an open-addressing table. The
   table compares complete content, so equal hashes of different texts stay apart.
3. The result goes back to the members of each local group, whose size is bounded by what one task reads.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, documents, grouped, stored

#: Bytes of different contents held in a table at a time.
LIMIT = 32 << 20
FAN_BITS = 4
NO_ID = (1 << 63) - 1


class ContentTable:
    """Open addressing with linear probing; a slot matches when hash and complete content are equal."""

    def __init__(self, slots: int = 1 << 10):
        self.slots = np.full(slots, -1, np.int64)
        self.codes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def find(self, code: int, content: bytes) -> int:
        """Number of the content; new contents get the next number."""
        last = len(self.slots) - 1
        at = (code * 0x9E3779B97F4A7C15 >> 20) & last
        while (k := int(self.slots[at])) >= 0:
            if self.codes[k] == code and self.contents[k] == content:
                return k
            at = at + 1 & last
        self.slots[at] = k = len(self.codes)
        self.codes.append(code)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.codes) > len(self.slots):
            self._grow()
        return k

    def _grow(self) -> None:
        last = 2 * len(self.slots) - 1
        self.slots = np.full(last + 1, -1, np.int64)
        for k, code in enumerate(self.codes):
            at = (code * 0x9E3779B97F4A7C15 >> 20) & last
            while self.slots[at] >= 0:
                at = at + 1 & last
            self.slots[at] = k


MEMBERS = pa.schema([
    ("row", pa.int64()), ("local", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.string()),
    ("code", pa.int64()), ("content", pa.binary()), ("n", pa.int64()), ("chars", pa.int64()), ("best_id", pa.int64()), ("best_row", pa.int64()),
])
MEMBERS_DDL = "row long, local long, doc_id long, sha string, code long, content binary, n long, chars long, best_id long, best_row long"


def local_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their group among what this task reads; the first row of a group carries its content."""
    base = TaskContext.get().partitionId() << 40
    rows = 0

    def flush(table: ContentTable, best: list, counts: list, ids: list, shas: list, member: list, firsts: list, start: int):
        head = {f: k for k, f in enumerate(firsts)}
        pick = [head.get(i) for i in range(len(ids))]

        def of(values):
            return [None if k is None else values[k] for k in pick]

        yield pa.RecordBatch.from_arrays([
            pa.array([base + start + i for i in range(len(ids))], pa.int64()), pa.array([base + start + firsts[k] for k in member], pa.int64()),
            pa.array(ids, pa.int64()), pa.array(shas, pa.string()), pa.array(of(table.codes), pa.int64()), pa.array(of(table.contents), pa.binary()),
            pa.array(of(counts), pa.int64()), pa.array(of([-b[0] for b in best]), pa.int64()), pa.array(of([b[1] for b in best]), pa.int64()),
            pa.array(of([b[2] for b in best]), pa.int64())], schema=MEMBERS)

    table, state = ContentTable(), ([], [], [], [], [], [])
    start = 0
    for batch in grouped(batches):
        best, counts, ids, shas, member, firsts = state
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            text = text or ""
            content = text.encode().translate(None, SPACES)
            digest = hashlib.sha256(content)
            code = int.from_bytes(digest.digest()[:8], "big", signed=True)
            k = table.find(code, content)
            mine = (-len(text), NO_ID if doc_id is None else doc_id, base + rows)
            if k == len(counts):
                counts.append(0)
                best.append(mine)
                firsts.append(len(ids))
            counts[k] += 1
            best[k] = min(best[k], mine)
            ids.append(doc_id)
            shas.append(digest.hexdigest())
            member.append(k)
            rows += 1
        if table.bytes > LIMIT or len(ids) > 100_000:
            yield from flush(table, *state, start)
            table, state, start = ContentTable(), ([], [], [], [], [], []), rows
    if state[2]:
        yield from flush(table, *state, start)


CLASSES = pa.schema([("local", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])


def _classes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, best, size, local, member = ContentTable(), [], [], [], []
    for b in batches:
        for code, content, n, chars, best_id, best_row, loc in zip(*(b.column(c).to_pylist() for c in ("code", "content", "n", "chars", "best_id", "best_row", "local")), strict=True):
            k = table.find(code, content)
            if k == len(best):
                best.append((-chars, best_id, best_row))
                size.append(0)
            best[k] = min(best[k], (-chars, best_id, best_row))
            size[k] += n
            local.append(loc)
            member.append(k)
    at = np.array(member, np.int64)
    for lo in range(0, len(local), 50_000):
        k = at[lo : lo + 50_000]
        keep = [None if best[i][1] == NO_ID else best[i][1] for i in k]
        yield pa.RecordBatch.from_arrays([pa.array(local[lo : lo + 50_000], pa.int64()), pa.array(keep, pa.int64()),
                                          pa.array([best[i][2] for i in k], pa.int64()), pa.array([size[i] for i in k], pa.int64())], schema=CLASSES)


def grace(batches: Iterable[pa.RecordBatch], limit: int = LIMIT, depth: int = 0) -> Iterator[pa.RecordBatch]:
    """Classes of equal content. Input beyond ``limit`` bytes goes to 2**FAN_BITS spill files by the next bits of ``code``;
    a file whose rows share one code cannot be split and is streamed through a table, which holds each content once."""
    held, size, source = [], 0, iter(batches)
    for b in source:
        held.append(b)
        size += b.nbytes
        if size > limit:
            break
    else:
        yield from _classes(held)
        return
    with tempfile.TemporaryDirectory(dir=os.environ.get("TMPDIR")) as folder:
        sinks, seen = {}, {}
        for b in (x for part in (held, source) for x in part):
            codes = b.column("code").to_numpy(zero_copy_only=False).view(np.uint64)
            bucket = (codes >> np.uint64(64 - FAN_BITS * (depth + 1))) & np.uint64((1 << FAN_BITS) - 1)
            for k in np.unique(bucket).tolist():
                rows = np.flatnonzero(bucket == k)
                if k not in sinks:
                    sinks[k] = pa.ipc.new_stream(os.path.join(folder, f"{k}.spill"), b.schema)
                    seen[k] = codes[rows[0]], True
                seen[k] = seen[k][0], seen[k][1] and bool((codes[rows] == seen[k][0]).all())
                sinks[k].write_batch(b.take(pa.array(rows)))
        held.clear()
        for s in sinks.values():
            s.close()
        for k in sorted(sinks):
            path = os.path.join(folder, f"{k}.spill")
            with pa.ipc.open_stream(path) as spill:
                yield from _classes(spill) if seen[k][1] else grace(spill, limit, depth + 1)
            os.remove(path)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. Other columns of ``docs`` are not read."""
    members = stored(docs.select("doc_id", "text").mapInArrow(local_groups, MEMBERS_DDL))
    groups = members.where("content is not null").select("local", "code", "content", "n", "chars", "best_id", "best_row")
    classes = groups.repartition("code").mapInArrow(grace, "local long, keep_id long, keep_row long, group_size long")
    return (members.select("row", "local", "doc_id", "sha").join(classes, "local")
            .select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir, "doc_id", "text"))


SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
best AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS place, count(*) OVER (PARTITION BY body) AS group_size,
  first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM best
"""
