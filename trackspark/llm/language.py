"""Language identification by interpolated Kneser-Ney character models.

A text is lower-cased; letters stay, each run of other characters becomes one blank, and a blank is put at either end. Each language
has a model of order 4 over these symbols, estimated by interpolated Kneser-Ney: counts of the highest order, numbers of different
left neighbours below, one discount per order from its counts of one and two. The language of the lowest cross-entropy per symbol
wins (ties: the first in the alphabet).

Counting: tasks count packed 4-grams, Spark sums them per language; every fitting text counts and every gram stays, however many there
are. Up to ``GRAMS`` rows of language and 4-gram, the model is computed on the driver: sorted arrays of 64-bit hashes (a bijection of
the packed symbols, so no two grams collide), one per order, each with a matrix of log-probabilities for all languages. A gram that no
language has falls back by its context's weight. Beyond, Spark computes the same tables, and they are broadcast in blocks of sorted
keys: a worker holds some texts and looks their grams up in one block after the other, so memory is bounded by the block.

Calibration: one in five of the fitting texts is not counted. On these the sharpness of the score (softmax of the cross-entropies,
times the sharpness) minimises the log-loss, and mean and deviation of the winning cross-entropy are taken per language and doubling
of length. A text is rejected when it has no letter, or its cross-entropy is above that mean by more deviations than all but a share
``FALSE_REJECTS`` of the calibrating texts are. A quantile that far out takes 1 / ``FALSE_REJECTS`` such texts; from fewer the limit is
``DEVIATIONS`` deviations and ``SLACK`` above the mean.

Which texts may be learned from, and which of them calibrate, follows from crc32 of the id; an id never reaches a prediction.
Null texts and texts without letters get ``und`` and score 0. Without any labelled text all are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import discard
from .common import PIECE, U, documents, grouped, lists, mix, stored, utf8

ORDER, GRAMS = 4, 1_000_000
#: Log-probabilities of a block of a large model, and how many of all blocks a worker keeps loaded.
VALUES, KEPT = 1 << 23, 1 << 24
#: Share of the calibrating texts that may be rejected, and the wide limit while too few of them are there to tell.
FALSE_REJECTS = 0.001
DEVIATIONS, SLACK = 8.0, 1.0
#: Deviations are counted in steps of STEP up to FARTHEST; a deviation is at least LEAST_DEVIATION nats.
STEP, FARTHEST, LEAST_DEVIATION = 0.05, 200.0, 0.01
UNKNOWN = "und"
SHARPNESS = [0.5, 1.0, 2.0, 4.0, 8.0, 12.0, 16.0, 24.0, 32.0, 48.0]
BLANK = 32
_letters = None


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """16-bit symbols of all texts, blanks at both ends of each; and where each begins. A text without letters is one blank."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0xD800)] + [False] * 0x800 + [chr(c).isalpha() for c in range(0xE000, 0x10000)])
    data, at = utf8(pc.utf8_lower(pc.fill_null(column, "")))
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    at = lead[at]
    beyond = np.flatnonzero(codes > 0xFFFF)
    different, which = np.unique(codes[beyond], return_inverse=True)
    codes = np.minimum(codes, 0xFFFF).astype(np.uint16)  # letters beyond the basic plane share one symbol
    letter = _letters[codes]
    letter[beyond] = np.array([chr(c).isalpha() for c in different.tolist()], bool)[which]
    codes = np.where(letter, codes, np.uint16(BLANK))
    # a blank at each text's end, then only the first of each run of blanks, then one at each start
    ends = at[1:]
    codes = np.insert(codes, ends, np.uint16(BLANK))
    at = at + np.arange(len(at))
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != BLANK) | (codes[:-1] != BLANK)
    begins = at[:-1]
    first[begins] = codes[begins] != BLANK
    first[(at[1:] - 1)[np.diff(at) == 1]] = False
    place = np.concatenate(([0], np.cumsum(first)))[at]
    out = np.insert(codes[first], place[:-1], np.uint16(BLANK))
    return out, place + np.arange(len(place))


def grams(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams of all texts and where each text's begin. A text of n symbols has n - 1: those at its start are padded."""
    n = np.diff(at)
    pad = np.insert(s, np.repeat(at[:-1], ORDER - 2), np.uint16(BLANK)).astype(U)
    edge = at + (ORDER - 2) * np.arange(len(at))
    g = pad[: max(0, len(pad) - ORDER + 1)].copy()
    for j in range(1, ORDER):
        g = (g << U(16)) | pad[j : len(g) + j]
    keep = np.zeros(len(pad) + 1, np.int32)
    np.add.at(keep, edge[:-1], 1)
    np.add.at(keep, edge[1:] - ORDER + 1, -1)
    inside = np.cumsum(keep[:-1])[: len(g)] > 0
    return g[inside], np.concatenate(([0], np.cumsum(n - 1)))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out():
        for lang, (g, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    for part in grouped(batches):
        langs = np.array(part.column("lang").to_pylist(), object)
        g, at = grams(*symbols(part.column("text")))
        owner = np.repeat(langs, np.diff(at))
        for lang in sorted(set(langs.tolist())):
            new, n = np.unique(g[owner == lang], return_counts=True)
            if lang in held:
                both, where = np.unique(np.concatenate((held[lang][0], new)), return_inverse=True)
                n = np.bincount(where, np.concatenate((held[lang][1], n)), len(both)).astype(np.int64)
                new = both
            held[lang] = new, n
        if sum(len(g) for g, _ in held.values()) > GRAMS:
            yield from out()
            held = {}
    yield from out()


def _discount(one: int, two: int) -> float:
    return min(one / (one + 2 * two) if one else 0.5, 0.9)


class Model:
    """Log-probabilities of all languages. ``orders[k]`` has, for grams of k + 1 symbols, the sorted hashes and their matrix;
    ``weights[k]`` the sorted hashes of contexts of k symbols and the log-weight of the order below."""

    piece = PIECE

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        n_langs = len(self.langs)
        # counts of each order: highest from the text, below the number of different left neighbours
        own: list[list] = [[] for _ in range(ORDER)]
        for lang in self.langs:
            g, n = counts[lang]
            order = np.argsort(g)
            g, n = g[order], n[order].astype(float)
            for k in range(ORDER - 1, -1, -1):
                own[k].append((g, n))
                g, c = np.unique(g & U((1 << 16 * k) - 1), return_counts=True) if k else (g, n)
                n = c.astype(float)
        self.orders, self.weights, below_keys, below = [], [], None, None
        for k in range(ORDER):
            keys = np.unique(np.concatenate([g for g, _ in own[k]])) if n_langs else np.zeros(0, U)
            contexts = np.unique(keys >> U(16)) if k else np.zeros(1, U)
            prob, weight = np.empty((len(keys), n_langs)), np.zeros((len(contexts), n_langs))
            if below is None:
                low = np.full((len(keys), n_langs), 1.0 / (len(keys) + 1))
            else:
                low = below[np.searchsorted(below_keys, keys & U((1 << 16 * k) - 1))]
            of_key = np.searchsorted(contexts, keys >> U(16)) if k else np.zeros(len(keys), np.int64)
            for j, (g, n) in enumerate(own[k]):
                discount = _discount((n == 1).sum(), (n == 2).sum())
                at = np.searchsorted(contexts, g >> U(16)) if k else np.zeros(len(g), np.int64)
                total = np.bincount(at, n, len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1e-300), 1.0)
                mine = np.zeros(len(keys))
                mine[np.searchsorted(keys, g)] = np.maximum(n - discount, 0)
                prob[:, j] = np.where(total[of_key] > 0, mine / np.maximum(total[of_key], 1e-300), 0) + gamma[of_key] * low[:, j]
                weight[:, j] = gamma
            below_keys, below = keys, prob
            for store, x, y in ((self.orders, keys, prob), (self.weights, contexts, weight)):
                h = mix(x + U(k))
                order = np.argsort(h)
                store.append((h[order], np.log(np.maximum(y, 1e-300))[order].astype(np.float32)))
        self.rare = float(-np.log(len(self.orders[0][0]) + 1.0)) if n_langs else 0.0

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return at, table[0][at] == keys

    def logs(self, g: np.ndarray, k: int = ORDER - 1) -> np.ndarray:
        """Log-probability of the last symbol of each gram of k + 1 symbols, one column per language."""
        at, hit = self._look(self.orders[k], mix(g + U(k)))
        out = self.orders[k][1][at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            if k == 0:
                at, seen = self._look(self.weights[0], mix(np.zeros(1, U)))
                out[miss] = self.weights[0][1][at] + self.rare
            else:
                rest = self.logs(g[miss] & U((1 << 16 * k) - 1), k - 1)
                at, seen = self._look(self.weights[k], mix((g[miss] >> U(16)) + U(k)))
                out[miss] = rest + np.where(seen[:, None], self.weights[k][1][at], 0)
        return out

    def cross_entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol of each text in each language, and the number of symbols; texts without letters have none."""
        s, at = symbols(column)
        g, edge = grams(s, at)
        n = np.diff(edge)
        sums = np.zeros((len(n), len(self.langs)))
        step = max(1, (1 << 22) // max(1, len(self.langs)))
        owner = np.repeat(np.arange(len(n)), n)
        for lo in range(0, len(g), step):
            logs, who = self.logs(g[lo : lo + step]), owner[lo : lo + step]
            for j in range(len(self.langs)):
                sums[:, j] -= np.bincount(who, logs[:, j], len(n))
        return sums / np.maximum(n, 1)[:, None], n


def _packed(size: int):
    """Sorted rows (key, value) as blocks of at most ``size`` rows: bytes of all keys and of all values."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out():
            keys = np.concatenate([b.column("key").to_numpy() for b in held])
            values = np.concatenate([b.column("value").flatten().to_numpy() for b in held])
            return pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["keys", "values"])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - sum(b.num_rows for b in held))
                held.append(part)
                batch = batch.slice(part.num_rows)
                if sum(b.num_rows for b in held) == size:
                    yield out()
                    held = []
        if held:
            yield out()

    return run


class WideModel:
    """The tables of ``Model`` computed by Spark and broadcast in blocks of sorted signed keys, the packed symbols themselves.
    ``orders[k]`` and ``weights[k]`` list their blocks: first and last key, and the broadcast keys and log-probabilities."""

    piece = 4 * PIECE

    def __init__(self, counts: DataFrame):
        self.langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
        each = range(len(self.langs))
        n, low, total = F.col("n"), F.col("low"), F.col("total")
        suffix = [None, *(F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1)) for k in range(1, ORDER))]
        context = F.shiftrightunsigned("gram", 16)
        own = [counts.groupBy("gram").agg(F.array(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).cast("double") for x in self.langs]).alias("n"))]
        own[0] = stored(own[0])
        for k in range(ORDER - 1, 0, -1):
            own.insert(0, stored(own[0].groupBy(suffix[k].alias("gram")).agg(F.array(*[F.sum(F.when(n[j] > 0, 1.0).otherwise(0.0)) for j in each]).alias("n"))))
        n_symbols = own[0].count()
        self.rare = float(-np.log(n_symbols + 1.0))
        self.orders, self.weights, self.n_values, scratch = [], [], 0, [*own]
        for k, table in enumerate(own):
            found = table.agg(*[F.sum((n[j] == c).cast("long")).alias(f"{c}_{j}") for j in each for c in (1, 2)]).first()
            discount = [_discount(found[f"1_{j}"], found[f"2_{j}"]) for j in each]
            sums = table.groupBy(context.alias("context")).agg(F.array(*[F.sum(n[j]) for j in each]).alias("total"), F.array(*[F.sum((n[j] > 0).cast("double")) for j in each]).alias("kinds"))
            gamma = F.array(*[F.when(total[j] > 0, discount[j] * F.col("kinds")[j] / total[j]).otherwise(1.0) for j in each])
            contexts = stored(sums.select("context", "total", gamma.alias("gamma")))
            rows = table.join(contexts, context == F.col("context"))
            rows = rows.join(prob.select(F.col("gram").alias("below"), F.col("p").alias("low")), suffix[k] == F.col("below")) if k else rows.withColumn("low", F.array(*[F.lit(1.0 / (n_symbols + 1)) for _ in each]))
            p = F.array(*[F.when(total[j] > 0, F.greatest(n[j] - discount[j], F.lit(0.0)) / total[j]).otherwise(0.0) + F.col("gamma")[j] * low[j] for j in each])
            prob = stored(rows.select("gram", p.alias("p")))
            scratch += [contexts, prob]
            self.orders.append(self._blocks(prob, "gram", "p"))
            self.weights.append(self._blocks(contexts, "context", "gamma"))
        discard(*scratch)

    def _blocks(self, table: DataFrame, key: str, value: str) -> list:
        rows, size = table.count(), max(1, min(GRAMS, VALUES // len(self.langs)))
        self.n_values += rows * len(self.langs)
        logs = F.transform(value, lambda x: F.log(F.greatest(x, F.lit(1e-300))).cast("float"))
        dealt = table.select(F.col(key).alias("key"), logs.alias("value")).repartitionByRange(-(-rows // size), "key").sortWithinPartitions("key")
        out, held, context = [], [], table.sparkSession.sparkContext

        def put():
            keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
            out.append((keys[0], keys[-1], context.broadcast((keys, values))))

        for r in dealt.mapInArrow(_packed(size), "keys binary, values binary").toLocalIterator():
            new = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["values"], np.float32).reshape(-1, len(self.langs))
            if held and sum(len(x) for x, _ in held) + len(new[0]) > size:
                put()
                held = []
            held.append(new)
        put()
        return out

    @property
    def value(self) -> "WideModel":
        return self

    def _add(self, out: np.ndarray, rows: np.ndarray, keys: np.ndarray, blocks: list) -> np.ndarray:
        """Adds to ``rows`` of ``out`` what the blocks have for their keys; and which of them they have."""
        keys, found = keys.view(np.int64), np.zeros(len(keys), bool)
        order = np.argsort(keys)
        ordered = keys[order]
        for first, last, block in blocks:
            lo, hi = np.searchsorted(ordered, first, "left"), np.searchsorted(ordered, last, "right")
            if lo == hi:
                continue
            table, values = block.value
            if self.n_values > KEPT:
                block.__dict__.pop("_value", None)  # it is loaded again from the worker's disk
            at = np.searchsorted(table, ordered[lo:hi])
            hit = table[at] == ordered[lo:hi]
            mine = order[lo:hi][hit]
            found[mine] = True
            out[rows[mine]] += values[at[hit]]
        return found

    def logs(self, g: np.ndarray) -> np.ndarray:
        """Log-probability of the last symbol of each different gram of four symbols, one column per language."""
        out, left = np.zeros((len(g), len(self.langs)), np.float32), np.arange(len(g))
        for k in range(ORDER - 1, -1, -1):
            keys = g[left] & U((1 << 16 * (k + 1)) - 1)
            found = self._add(out, left, keys, self.orders[k])
            left, keys = left[~found], keys[~found]
            self._add(out, left, keys >> U(16), self.weights[k])
        out[left] += self.rare
        return out

    def cross_entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As of ``Model``; each different gram is looked up once."""
        s, at = symbols(column)
        g, edge = grams(s, at)
        n = np.diff(edge)
        keys, where = np.unique(g, return_inverse=True)
        owner = np.repeat(np.arange(len(n)), n)
        sums, step = np.zeros((len(n), len(self.langs))), max(1, (1 << 22) // max(1, len(self.langs)))
        for lo in range(0, len(keys), step):
            logs = self.logs(keys[lo : lo + step])
            mine = np.flatnonzero((where >= lo) & (where < lo + step))
            for j in range(len(self.langs)):
                sums[:, j] -= np.bincount(owner[mine], logs[where[mine] - lo, j], len(n))
        return sums / np.maximum(n, 1)[:, None], n


def _scored(model, without: str | None = "text"):
    """Adds to each row, less the column ``without``: the cross-entropies of all languages and the number of symbols."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for part in grouped(batches, limit=m.piece):
            h, n = m.cross_entropies(part.column("text"))
            keep = [c for c in part.schema.names if c != without]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists(h.ravel(), np.full(len(n), h.shape[1])), pa.array(n)], names=[*keep, "_entropies", "_symbols"])

    return run


def third(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def fit(docs: DataFrame) -> Model | WideModel:
    """Model of the rows whose lang is not null (columns text and lang). No text and no gram is left out."""
    rows = docs.where("lang is not null and text is not null").select("text", "lang")
    counts = rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stored(counts)
    if counts.count() > GRAMS:
        return WideModel(counts)
    table = counts.toArrow()
    langs = table.column("lang").to_numpy(zero_copy_only=False)
    g, n = table.column("gram").to_numpy().view(U), table.column("n").to_numpy()
    return Model({lang: (g[langs == lang], n[langs == lang]) for lang in sorted(set(langs.tolist()))})


def identify(docs: DataFrame, without: str | None = "text") -> DataFrame:
    """All columns but ``without``, and lang_pred, score, cross_entropy, rejected; the model is fitted to ``docs`` itself: on rows with a
    language whose crc32 of doc_id leaves a remainder other than 1 by 3."""
    spark = docs.sparkSession
    names = docs.columns
    code = third(F.col("doc_id"))
    fitting = docs.where((code % 3 != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    calibrating = F.floor(code / 3) % 5 == 0
    # one text in five calibrates a model of the others; the texts are then judged by a model of all of them
    model = fit(fitting.where(~calibrating))
    if not model.langs:
        model = fit(fitting)
    plain = [f"`{c}`" for c in names if c != without]
    if not model.langs:
        return docs.select(*plain, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    best = F.array_min("_entropies")
    size = F.floor(F.log2(F.greatest("_symbols", F.lit(1)).cast("double"))).cast("int")

    def sent(m: Model | WideModel):
        return m if isinstance(m, WideModel) else spark.sparkContext.broadcast(m)

    def named(m: Model | WideModel) -> tuple[Column, Column]:
        """The languages of a model, and the best one."""
        langs = F.array(*[F.lit(x) for x in m.langs])
        return langs, langs[F.array_position("_entropies", best).cast("int") - 1]

    def share(sharp) -> Column:
        """Softmax of the best language."""
        return F.lit(1.0) / F.aggregate("_entropies", F.lit(0.0), lambda a, x: a + F.exp(-(x - best) * sharp))

    # calibration: a few sums per language and length
    langs, pred = named(model)
    tried = (fitting.where(calibrating).select("text", "lang").mapInArrow(_scored(sent(model)), "lang string, _entropies array<double>, _symbols long")
             .where("_symbols > 1").withColumns({"pred": pred, "size": size, "best": best}))
    tried = stored(tried)
    right = F.coalesce(F.get(F.col("_entropies"), F.array_position(langs, F.col("lang")).cast("int") - 1), best + 10)
    losses = [F.sum((right - best) * s - F.log(share(F.lit(s)))).alias(f"loss{i}") for i, s in enumerate(SHARPNESS)]
    rows = tried.groupBy("pred", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("best").alias("s"), F.sum(F.col("best") ** 2).alias("q"), *losses).collect()
    loss = [sum(r[f"loss{i}"] or 0 for r in rows) for i in range(len(SHARPNESS))]
    sharp = SHARPNESS[int(np.argmin(loss))] if rows else 8.0
    usual = _usual(rows)
    away = _by_length(F.col("pred"), F.col("size"), {k: (F.col("best") - mean) / deviation for k, (mean, deviation) in usual.items()})
    steps = tried.groupBy(F.ceil(F.least(away, F.lit(FARTHEST)) / STEP).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect() if rows else []
    deviations, slack = _width({r["step"]: r["n"] for r in steps})
    where = _by_length(F.col("lang_pred"), F.col("_size"), {k: F.lit(mean + deviations * deviation + slack) for k, (mean, deviation) in usual.items()})
    discard(tried)
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != without] + ["_entropies array<double>", "_symbols long"])
    known = F.col("_symbols") > 1
    model = fit(fitting)
    pred = named(model)[1]
    out = docs.mapInArrow(_scored(sent(model), without), ddl)
    return out.withColumns({"lang_pred": F.when(known, pred).otherwise(UNKNOWN), "score": F.when(known, share(F.lit(sharp))).otherwise(0.0),
                            "cross_entropy": F.when(known, best), "_size": size}).withColumn(
        "rejected", ~known | F.coalesce(F.col("cross_entropy") > where, F.lit(False))).select(*plain, "lang_pred", "score", "cross_entropy", "rejected")


def _by_length(lang: Column, size: Column, values: dict) -> Column:
    """The value of a language and doubling of length, or else of the language."""
    out = F.lit(None).cast("double")
    for (name, bits), value in values.items():
        out = F.when((lang == name) & (size == bits) if bits is not None else lang == name, value).otherwise(out)
    return out


def _usual(rows) -> dict:
    """Mean and deviation of the cross-entropy by language and doubling of length; lengths seen too rarely take the language's."""
    def at(n: int, s: float, q: float) -> tuple[float, float]:
        mean = s / n
        return mean, max(LEAST_DEVIATION, float(np.sqrt(max(0.0, q / n - mean * mean))))

    out: dict = {}
    for lang in sorted({r["pred"] for r in rows}):
        mine = [r for r in rows if r["pred"] == lang]
        out[lang, None] = at(sum(r["n"] for r in mine), sum(r["s"] for r in mine), sum(r["q"] for r in mine))
        for r in mine:
            if r["n"] >= 30:
                out[lang, r["size"]] = at(r["n"], r["s"], r["q"])
    return out


def _width(steps: dict[int, int]) -> tuple[float, float]:
    """Deviations and slack of the limit, from the number of calibrating texts per step of deviations (upper ends). With the texts in
    ascending order it is the place ceil((n + 1) * (1 - FALSE_REJECTS)), if there is one: a new text of the same kind
    lies beyond it with at most that probability."""
    n = sum(steps.values())
    place = int(np.ceil((n + 1) * (1 - FALSE_REJECTS)))
    if place > n:
        return DEVIATIONS, SLACK
    order = sorted(steps)
    return order[int(np.searchsorted(np.cumsum([steps[k] for k in order]), place))] * STEP, 0.0


def accepted(docs: DataFrame) -> DataFrame:
    """The rows that are not rejected, all their columns as they were. Other columns than doc_id, text and lang may have any name."""
    inner = {c: c if c in ("doc_id", "text", "lang") else f"column{i}" for i, c in enumerate(docs.columns)}
    work = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in inner.items()])
    return identify(work, None).where("not rejected").select(*[F.col(x).alias(c) for c, x in inner.items()])


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    out = identify(docs.withColumn("held_out", third(F.col("doc_id")) % 3 == 1))
    return out.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
