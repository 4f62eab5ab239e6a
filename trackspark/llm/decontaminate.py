"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased and split into tokens: runs of letters, marks and digits, so layout, punctuation, symbols and case do not hide a
passage. Each code point of a script that is written without spaces (``ALONE``) is a token of its own. A document and a benchmark item that share a seed (``LEAST`` tokens in a row) are compared: the longest common
run of unmarked tokens is searched by running Karp-Rabin hashes, marked in both, and so on until none of ``LEAST`` tokens is left.
The tiles do not overlap and may stand in any order, so a reordered passage is covered as well as a plain one. A document is
contaminated when tiles cover at least ``SHARE`` of an item's tokens. An item of fewer than ``LEAST`` tokens is found where all of them stand
in a row, so its one tile covers it wholly.

The benchmark is a query set: it is read in blocks of at most ``BLOCK`` bytes, each block goes to all workers and meets all documents
within one scan, without a shuffle or join. Null, empty and token-free texts
are clean. Each input row is judged by its own text, so repeated rows get equal results.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, constants, documents, grouped, mix, utf8, words

LEAST, SHARE = 5, 0.5
BLOCK = 4 << 20
#: Tai scripts, Tibetan, Myanmar, Khmer, Balinese, Javanese, kana, bopomofo, Chinese characters, Yi.
ALONE = [(0xE00, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035), (0x3038, 0x303C),
         (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF),
         (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF)]
_place = constants(31, LEAST)
_kinds = None
_apart = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])


def _spaced(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with blanks for what separates tokens beyond ASCII, and a blank on either side of what stands alone."""
    global _kinds
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if len(lead) == len(data):  # only ASCII
        return data, at
    if _kinds is None:
        _kinds = np.zeros(0x110000, np.uint8)
        for lo, hi in ALONE:
            _kinds[lo : hi + 1] = 2
        _kinds[[c for c in range(0x80, 0x110000) if unicodedata.category(chr(c))[0] in "PSZ"]] = 1
        _kinds[0x80:0xA0] = _kinds[[0x200B, 0x2060, 0xFEFF]] = 1
    kinds = _kinds[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    if not kinds.any():
        return data, at
    data = np.where(np.repeat(kinds == 1, np.diff(np.append(lead, len(data)))), np.uint8(32), data)
    alone = kinds == 2
    alone[1:] |= alone[:-1].copy()
    before = lead[alone]
    return np.insert(data, before, np.uint8(32)), at + np.searchsorted(before, at)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens and where each text's begin."""
    w, count = words(*_spaced(*utf8(pc.utf8_lower(pc.fill_null(column, "")))), between=_apart)
    return w, np.concatenate(([0], np.cumsum(count)))


def _seeds(w: np.ndarray, at: np.ndarray, size: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` tokens from each position, and whether they lie in one text."""
    n = len(w) - size + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, bool)
    h = _place[0] * w[:n]
    for j in range(1, size):
        h = h + _place[j] * w[j : n + j]
    ok = np.ones(n, bool)
    for edge in at[1:-1] if size > 1 else ():
        ok[max(0, edge - size + 1) : edge] = False
    return mix(h), ok


class _Running:
    """Karp-Rabin hashes of all runs of one token array."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, w: np.ndarray):
        self.power = np.full(len(w) + 1, self.BASE, U)
        self.power[0] = 1
        self.power = np.multiply.accumulate(self.power)
        # highest power first, so the hash of a run is s[i + n] - s[i] * BASE ** n
        self.sums = np.zeros(len(w) + 1, U)
        s = 0
        for i, x in enumerate(w.tolist()):
            s = (s * self.BASE + x) & 0xFFFFFFFFFFFFFFFF
            self.sums[i + 1] = s

    def runs(self, n: int) -> np.ndarray:
        return self.sums[n:] - self.sums[: len(self.sums) - n] * self.power[n]


def _free(marked: np.ndarray, n: int) -> np.ndarray:
    """Starts of runs of n unmarked tokens."""
    c = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(c[n:] == c[:-n]) if len(marked) >= n else np.zeros(0, np.int64)


def tile(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item position, text position, length) of each tile, longest first, then by item and text position."""
    mi, mt = np.zeros(len(item), bool), np.zeros(len(text), bool)
    hi, ht = _Running(item), _Running(text)
    tiles = []

    def common(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = _free(mi, n), _free(mt, n)
        if not len(a) or not len(b):
            return a[:0], b, a[:0]
        x, y = hi.runs(n)[a], ht.runs(n)[b]
        order = np.argsort(y, kind="stable")
        at = np.searchsorted(y[order], x)
        found = np.flatnonzero((at < len(y)) & (y[order][np.minimum(at, len(y) - 1)] == x))
        return a[found], b[order], at[found]

    size = min(len(item), len(text))
    while size >= least:
        # longest common length by bisection: a common run of n tokens has one of n - 1
        lo, top = least - 1, size
        while lo < top:
            mid = (lo + top + 1) // 2
            if len(common(mid)[0]):
                lo = mid
            else:
                top = mid - 1
        size = lo
        if size < least:
            break
        marked = False
        starts, places, at = common(size)
        for a, k in zip(starts.tolist(), at.tolist(), strict=True):
            if mi[a : a + size].any():
                continue
            while k < len(places):
                b = int(places[k])
                if not (item[a : a + size] == text[b : b + size]).all():
                    break
                if not mt[b : b + size].any():
                    mi[a : a + size] = mt[b : b + size] = marked = True
                    tiles.append((a, b, size))
                    break
                k += 1
        if not marked:
            size -= 1
    return tiles


class Benchmark:
    """A block of items: their tokens, and the seeds in hash order."""

    def __init__(self, ids: list, column: pa.Array):
        w, at = tokens(column)
        seed, ok = _seeds(w, at)
        place = np.flatnonzero(ok)
        order = np.argsort(seed[place], kind="stable")
        self.seed, self.place = seed[place][order], place[order]
        self.item = np.searchsorted(at, self.place, "right") - 1
        self.ids, self.w, self.at = ids, w, at
        # items below LEAST tokens by their number: hashes of the whole items in order, and the items
        self.short = {}
        for n in range(1, LEAST):
            items = np.flatnonzero(np.diff(at) == n)
            if len(items):
                whole = _seeds(w, at, n)[0][at[items]]
                order = np.argsort(whole, kind="stable")
                self.short[n] = whole[order], items[order]

    def short_matches(self, w: np.ndarray, at: np.ndarray) -> dict[int, list[dict]]:
        """Short items that stand in texts as they are: by text, in the order of items, each at its first place."""
        found: dict[tuple[int, int], int] = {}
        for n, (whole, items) in self.short.items():
            seed, ok = _seeds(w, at, n)
            first, last = np.searchsorted(whole, seed, "left"), np.searchsorted(whole, seed, "right")
            for p in np.flatnonzero(ok & (last > first)).tolist():
                text = int(np.searchsorted(at, p, "right")) - 1
                for item in items[first[p] : last[p]].tolist():
                    if (text, item) not in found and (w[p : p + n] == self.w[self.at[item] : self.at[item] + n]).all():
                        found[text, item] = p - int(at[text])
        out: dict[int, list[dict]] = {}
        for (text, item), p in sorted(found.items()):
            n = int(self.at[item + 1] - self.at[item])
            out.setdefault(text, []).append({"item": self.ids[item], "coverage": 1.0, "tiles": [{"item_at": 0, "text_at": p, "length": n}]})
        return out


MATCH = pa.list_(pa.struct([("item", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([("item_at", pa.int32()), ("text_at", pa.int32()), ("length", pa.int32())])))]))
MATCH_DDL = "array<struct<item:long,coverage:double,tiles:array<struct<item_at:int,text_at:int,length:int>>>>"


def _matches(w: np.ndarray, lo: int, bench: Benchmark, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[dict]:
    """Items that share seeds with one document; ``place``: seed positions found, ``first`` and ``last``: their range of seeds."""
    found: dict[int, tuple[set, list]] = {}
    for p, a, b in zip(place.tolist(), first.tolist(), last.tolist(), strict=True):
        for k in range(a, b):
            item = int(bench.item[k])
            at, where = found.setdefault(item, (set(), []))
            at.add(int(bench.place[k]))
            where.append(p)
    out = []
    for item, (at, where) in sorted(found.items()):
        a, b = bench.at[item], bench.at[item + 1]
        reach = np.zeros(b - a + LEAST, bool)
        for p in at:
            reach[p - a : p - a + LEAST] = True
        if reach.sum() < SHARE * (b - a):  # not even all seeds together cover enough
            continue
        # only the parts of the document around seeds can hold tiles; a gap becomes one token that equals no other
        spots = np.unique((np.unique(where)[:, None] + np.arange(LEAST)).ravel())
        gap = np.flatnonzero(np.diff(spots) > 1) + 1
        text = np.insert(w[spots], gap, U(0))
        back = np.insert(spots, gap, -1)
        tiles = tile(bench.w[a:b], text)
        coverage = sum(t[2] for t in tiles) / int(b - a)
        if coverage >= SHARE:
            out.append({"item": bench.ids[item], "coverage": coverage, "tiles": [{"item_at": x, "text_at": int(back[y]) - lo, "length": n} for x, y, n in tiles]})
    return out


def _compare(block, name: str, fresh: bool):
    """Adds the matches of one block of the benchmark to the column ``name``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(*block.value)
        for part in grouped(batches):
            w, at = tokens(part.column("text"))
            seed, ok = _seeds(w, at)
            first = np.searchsorted(bench.seed, seed, "left")
            hit = np.flatnonzero(ok & (bench.seed[np.minimum(first, len(bench.seed) - 1)] == seed)) if len(bench.seed) else np.zeros(0, np.int64)
            out = [[]] * part.num_rows if fresh else part.column(name).to_pylist()
            if len(hit):
                first, last = first[hit], np.searchsorted(bench.seed, seed[hit], "right")
                doc = np.searchsorted(at, hit, "right") - 1
                edge = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]))
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    d = int(doc[a])
                    out[d] = out[d] + _matches(w, int(at[d]), bench, hit[a:b], first[a:b], last[a:b])
            for d, more in bench.short_matches(w, at).items() if bench.short else ():
                out[d] = out[d] + more
            columns = {c: part.column(c) for c in part.schema.names if c != name}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(out, MATCH)], names=[*columns, name])

    return run


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, pa.Array]]:
    """Items in blocks of bounded size, streamed through the driver one block at a time."""
    ids, texts, held = [], [], 0
    for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if texts and held + len(r.text) > BLOCK // 4:
            yield ids, pa.array(texts, pa.string())
            ids, texts, held = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        held += len(r.text)
    yield ids, pa.array(texts, pa.string())


def with_matches(docs: DataFrame, benchmark: DataFrame, name: str = "matches") -> DataFrame:
    """``docs`` with a column of the items found: id, coverage and tiles (token positions). A column of that name is replaced."""
    docs, context = docs.drop(name), docs.sparkSession.sparkContext
    ddl = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{name}` {MATCH_DDL}"])
    for i, block in enumerate(_blocks(benchmark)):
        docs = docs.mapInArrow(_compare(context.broadcast(block), name, i == 0), ddl)
    return docs


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any item, all their columns as they were."""
    name = "matches"
    while name in docs.columns:
        name += "_"
    return with_matches(docs, benchmark, name).where(F.size(name) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, contaminated, n_items, items (ids, ascending), coverage (the greatest, 0 where none)."""
    found = with_matches(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.size("matches").cast("long").alias("n_items"),
                        F.array_sort(F.transform("matches", lambda m: m["item"])).alias("items"),
                        F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("coverage"))
