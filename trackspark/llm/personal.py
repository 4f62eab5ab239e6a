"""Personal data: patterns, and a semi-Markov conditional random field that adds what they miss.

Patterns find emails, IPv4 addresses, card numbers (14 to 19 digits, Luhn) and phone numbers (+, 10 to 15 digits); matches are
leftmost and non-overlapping per kind, and a match that fails its check is dropped without a retry.

The field looks at regions: stretches of tokens (runs of letters, runs of digits, other characters) around digits, @ and bracketed
signs such as (at). A labelling of a region is a sequence of segments: single tokens outside, and entities of up to ``LONGEST`` tokens of one kind.
Every candidate segment is scored as a whole (digit counts, groups, separators, check digits, signs, what stands next to it), kinds
that follow one another by a transition weight. Dynamic programming over (token, kind) chooses boundaries and kinds together; the
forward-backward sums give each entity's probability. An entity is added when it is on the best labelling with at least
``CERTAIN`` and overlaps no pattern match. Work is linear in the tokens of a region, as entities are bounded.

Fitting: regions of at most ``FIT_DOCS`` documents, chosen by a hash of the id, at most ``FIT_REGIONS`` of them, labelled by the
patterns; and variants of these (sign dropped, bracketed signs), so spellings beyond the patterns are learned.
Maximum likelihood with a quadratic penalty. These bounds are the only sample; all documents are searched whole.

Null counts as empty. Each input row gives one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, grouped, utf8

KINDS = ("email", "ip", "card", "phone")
LONGEST, CERTAIN = 18, 0.9
FIT_DOCS, FIT_REGIONS, ROUNDS, PENALTY = 3000, 250, 30, 0.05
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = re.compile(r"[A-Za-z0-9._%+-]*\Z")
# no match begins inside a run of digits, as one from its first digit would be further left; so long runs are read once
_ip = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digits = re.compile(r"[^0-9]")
_in_local = np.zeros(128, bool)
_in_local[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"]] = True
_trigger = np.zeros(256, bool)
_trigger[[*b"0123456789@(["]] = True


def luhn(digits: str) -> bool:
    """Whether the doubled-every-second digit sum ends in 0."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # a match holds one @ after its longest local part, so only the surroundings of each @ are read
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and ord(text[start - 1]) < 128 and _in_local[ord(text[start - 1])]:
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start, then kind; code points, end exclusive."""
    out = [(a, b, 0) for a, b in _emails(text)]
    out += [(*m.span(), 1) for m in _ip.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _card.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((*m.span(), 2))
    out += [(*m.span(), 3) for m in _phone.finditer(text) if 10 <= len(_digits.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


# -- regions, segments and their features

_token = re.compile(r"[^\W\d_]+|[0-9]+|\s|.", re.S)
_seed = re.compile(r"[0-9@]|\s?[(\[]\s?(?:at|dot)\s?[)\]]\s?", re.I)
_written = re.compile(r"\s?[(\[]\s?at\s?[)\]]\s?", re.I)
_dotted = re.compile(r"\s?[(\[]\s?dot\s?[)\]]\s?", re.I)
_GAP = 12
N_FEATURES = 26


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits and signs that stand at most _GAP characters apart on a line."""
    lo = hi = -1
    for m in _seed.finditer(text):
        a, b = m.span()
        if lo >= 0 and (a - hi > _GAP or "\n" in text[hi:a]):
            yield lo, hi
            lo = -1
        if lo < 0:
            lo = a
        hi = b
    if lo >= 0:
        yield lo, hi


def _cut_left(c: str) -> bool:
    return c.isalnum() or c in "._%+-("


def widened(text: str, found: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The regions with the words they cut; those that share a word become one, so every character is in one region at most."""
    low = high = -1
    for lo, hi in found:
        while lo > max(high, 0) and _cut_left(text[lo - 1]):
            lo -= 1
        if high >= 0 and (lo < high or (lo == high and _cut_left(text[lo - 1]))):
            lo = low
        elif high >= 0:
            yield low, high
        low, high = lo, max(hi, high)
        while high < len(text) and (text[high].isalnum() or text[high] in "-_" or (text[high] == "." and text[high + 1 : high + 2].isalnum())):
            high += 1
    if high >= 0:
        yield low, high


def features(span: str, left: str, right: str) -> list[int]:
    """Numbers of the features that hold for a whole span between two characters."""
    digits = _digits.sub("", span)
    n, groups = len(digits), re.findall(r"[0-9]+", span)
    letters = any(c.isalpha() for c in span)
    at, low = span.count("@"), span.lower()
    head, _, tail = span.partition("@")
    f = [0]
    add = f.append
    if at == 1 and head and tail and _domain.fullmatch(tail) and all(ord(c) < 128 and _in_local[ord(c)] for c in head):
        add(1)
    if at > 1 or (at and " " in span):
        add(2)
    if not at and (m := _written.search(low)) and m.start() and re.fullmatch(r"[a-z0-9._%+-]+", low[: m.start()]):
        add(3)
        if _dotted.search(low, m.end()) or re.fullmatch(r"[a-z0-9-]+(\.[a-z0-9-]+)+", low[m.end() :]):
            add(4)
    if len(groups) == 4 and not letters and re.fullmatch(r"[0-9]+(\.[0-9]+){3}", span):
        add(6 if all(map(_small, groups)) else 5)
    add(7 if n < 7 else 8 if n < 10 else 9 if n < 14 else 10 if n < 16 else 11 if n < 20 else 12)
    if not letters and not at:
        add(13)
        if 14 <= n <= 19 and luhn(digits):
            add(14)
        if re.fullmatch(r"[0-9]+([ -][0-9]+)*", span):
            add(15)
            if len({len(g) for g in groups[:-1]}) <= 1:
                add(16)
        if re.fullmatch(r"\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?([ .-]?[0-9]{2,5}){1,5}", span):
            add(17)
    if span[0] == "+":
        add(18)
    if "(" in span and span.count("(") == span.count(")"):
        add(19)
    elif "(" in span or ")" in span:
        add(20)
    if left.isalnum() or left in "+@_":
        add(21)
    if right.isalnum() or right in "@_":
        add(22)
    if letters and not at and 3 not in f:
        add(23)
    if not (span[0].isalnum() or span[0] in "+(") or not span[-1].isalnum():
        add(24)
    if left in ".-":
        add(25)
    return f


class Region:
    """Tokens of a region and its candidate segments: first token, token after the last, features."""

    def __init__(self, text: str, lo: int, hi: int):
        self.edges = [lo + m.start() for m in _token.finditer(text[lo:hi])] + [hi]
        e, n = self.edges, len(self.edges) - 1
        self.n, self.segments = n, []
        for i in range(n):
            if not (text[e[i]].isalnum() or text[e[i]] in "+("):
                continue
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                if text[e[j] - 1] == "\n":
                    break
                if not text[e[j] - 1].isalnum():
                    continue
                span = text[e[i] : e[j]]
                if "@" not in span and sum(c.isdigit() for c in span) < 4 and not _written.search(span):
                    continue
                self.segments.append((i, j, features(span, text[e[i] - 1] if e[i] else " ", text[e[j]] if e[j] < len(text) else " ")))


class Field:
    """Weights: ``span`` (kind x feature), ``step`` (kind x kind, the last kind is outside)."""

    def __init__(self, span: np.ndarray, step: np.ndarray):
        self.span, self.step = span, step

    def _sums(self, r: Region, most: bool = False):
        """Forward scores by (token, kind), and for each position the segments that end there with their scores."""
        K = len(KINDS)
        ends: list[list] = [[] for _ in range(r.n + 1)]
        for k, (i, j, f) in enumerate(r.segments):
            ends[j].append((i, k, self.span[:, f].sum(axis=1)))
        join = (lambda x: x.max(axis=0)) if most else _log_sum
        alpha = np.full((r.n + 1, K + 1), -np.inf)
        enter = np.full((r.n + 1, K + 1), -np.inf)
        enter[0] = 0.0
        for j in range(1, r.n + 1):
            alpha[j, K] = enter[j - 1, K]
            if ends[j]:
                alpha[j, :K] = join(np.array([enter[i, :K] + s for i, _, s in ends[j]]))
            if j < r.n:
                enter[j] = join(alpha[j][:, None] + self.step)
        return alpha, enter, ends

    def best(self, r: Region) -> list[tuple[int, int, int, int]]:
        """Segments of the best labelling: first token, token after the last, kind, number of the segment."""
        K = len(KINDS)
        alpha, enter, ends = self._sums(r, True)
        out, j, y = [], r.n, int(np.argmax(alpha[r.n]))
        while j > 0:
            i = j - 1
            if y < K:
                i, k = next((i, k) for i, k, s in ends[j] if enter[i, y] + s[y] == alpha[j, y])
                out.append((i, j, y, k))
            if i:
                y = int(np.argmax(alpha[i] + self.step[:, y]))
            j = i
        return out[::-1]

    def marginals(self, r: Region) -> tuple[np.ndarray, np.ndarray, float]:
        """Probability of each segment and kind, expected transitions, log of the sum of all labellings."""
        K = len(KINDS)
        alpha, enter, ends = self._sums(r)
        beta = np.full((r.n + 1, K + 1), -np.inf)
        beta[r.n] = 0.0
        begin = np.full((r.n + 1, K + 1), -np.inf)  # by kind of the segment that begins here
        starts: list[list] = [[] for _ in range(r.n + 1)]
        for j in range(r.n + 1):
            for i, k, s in ends[j]:
                starts[i].append((j, k, s))
        total = float(_log_sum(alpha[r.n]))
        p, steps = np.zeros((len(r.segments), K)), np.zeros((K + 1, K + 1))
        for i in range(r.n - 1, -1, -1):
            begin[i, K] = beta[i + 1, K]
            if starts[i]:
                begin[i, :K] = _log_sum(np.array([beta[j, :K] + s for j, _, s in starts[i]]))
                for j, k, s in starts[i]:
                    p[k] = np.exp(enter[i, :K] + s + beta[j, :K] - total)
            if i:
                joint = alpha[i][:, None] + self.step + begin[i][None, :]
                beta[i] = _log_sum((self.step + begin[i][None, :]).T)
                steps += np.exp(joint - total)
        return p, steps, total

    def entities(self, text: str) -> Iterator[tuple[int, int, int]]:
        for lo, hi in widened(text, regions(text)):
            if hi - lo < 7:
                continue
            r = Region(text, lo, hi)
            if not r.segments:
                continue
            found = self.best(r)
            if found:
                p = self.marginals(r)[0]
                yield from ((r.edges[i], r.edges[j], y) for i, j, y, k in found if p[k, y] >= CERTAIN)


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - safe).sum(axis=0)) + safe


def variants(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """The text with its spans, and once more with every span in a spelling that the patterns miss."""
    yield text, spans
    for way in range(2):
        out, moved, at, changed = [], [], 0, False
        for a, b, y in spans:
            if a < at:
                continue
            out.append(text[at:a])
            s = text[a:b]
            if KINDS[y] == "phone":
                s = s[1:] if way == 0 else re.sub(r"^\+[0-9]{1,3}[ .-]", "", s)
            elif KINDS[y] == "email":
                s = s.replace("@", " (at) " if way == 0 else "[at]")
            start = sum(map(len, out))
            out.append(s)
            moved.append((start, start + len(s), y))
            changed |= s != text[a:b]
            at = b
        if changed:
            yield "".join(out) + text[at:], moved


def train(samples: list[str]) -> Field:
    """Weights of the greatest penalised likelihood on labelled regions and their variants, by RProp steps on all of them."""
    K = len(KINDS)
    cases = []
    for sample in samples:
        for text, spans in variants(sample, base_spans(sample)):
            r = Region(text, 0, len(text))
            place = {e: i for i, e in enumerate(r.edges)}
            number = {(i, j): k for k, (i, j, _) in enumerate(r.segments)}
            gold, free = [], 0
            for a, b, y in sorted(spans, key=lambda s: (s[0], s[0] - s[1])):
                key = place.get(a), place.get(b)
                if a >= free and key in number:
                    gold.append((*key, y, number[key]))
                    free = b
            if r.segments:
                cases.append((r, gold))
    field = Field(np.zeros((K, N_FEATURES)), np.zeros((K + 1, K + 1)))
    rate, before = [np.full(w.shape, 0.2) for w in (field.span, field.step)], [0.0, 0.0]
    for _ in range(ROUNDS if cases else 0):
        slope = [-PENALTY * field.span, -PENALTY * field.step]
        for r, gold in cases:
            p, steps, _ = field.marginals(r)
            for k, (_, _, f) in enumerate(r.segments):
                slope[0][:, f] -= p[k][:, None]
            slope[1] -= steps
            at, last = 0, None
            for i, j, y, k in [*gold, (r.n, r.n, None, None)]:
                for _ in range(at, i):
                    if last is not None:
                        slope[1][last, K] += 1
                    last = K
                if y is not None:
                    if last is not None:
                        slope[1][last, y] += 1
                    slope[0][y, r.segments[k][2]] += 1
                    at, last = j, y
        for w, g, step, i in ((field.span, slope[0], rate[0], 0), (field.step, slope[1], rate[1], 1)):
            turn = np.sign(g) * np.sign(before[i])
            step *= np.where(turn > 0, 1.2, np.where(turn < 0, 0.5, 1.0))
            np.clip(step, 1e-4, 1.0, out=step)
            w += np.sign(g) * step
            before[i] = g
    return field


# -- on tables

def _samples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text in b.column("text").to_pylist():
            for lo, hi in widened(text or "", regions(text or "")):
                if 7 <= hi - lo <= 200:
                    out.append(text[max(0, lo - 1) : hi + 1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["sample"])


def fit(docs: DataFrame) -> Field:
    """The field, fitted to a bounded sample of ``docs``."""
    rows = docs.count()
    share = min(1.0, FIT_DOCS / max(1, rows))
    chosen = docs.select("doc_id", "text").where((F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(1_000_003)) < F.lit(max(1, int(share * 1_000_003)))) & F.col("text").isNotNull())
    found = chosen.select("text").mapInArrow(_samples, "sample string").distinct().orderBy(F.xxhash64("sample"), "sample").limit(FIT_REGIONS).collect()
    return train([r.sample for r in found])


SPANS = "doc_id long, base array<struct<start:int,end:int,kind:int>>, added array<struct<start:int,end:int,kind:int>>"
_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))


def _searched(field):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field.value
        for part in grouped(batches):
            data, at = utf8(part.column("text"))
            hits = np.concatenate(([0], np.cumsum(_trigger[data], dtype=np.int64)))
            with_any = hits[at[1:]] > hits[at[:-1]]
            base, added = [[] for _ in with_any], [[] for _ in with_any]
            for i in np.flatnonzero(with_any).tolist():
                text = part.column("text")[i].as_py()
                base[i] = base_spans(text)
                taken = sorted((a, b) for a, b, _ in base[i])
                starts, far = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken]) if taken else []
                for a, b, y in model.entities(text):
                    k = int(np.searchsorted(starts, b))  # spans that begin before this one ends
                    if not k or far[k - 1] <= a:
                        added[i].append((a, b, y))
            columns = [pa.array([[{"start": a, "end": b, "kind": y} for a, b, y in x] for x in side], _kind) for side in (base, added)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "base", "added"])

    return run


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per input row: doc_id, base and added spans (start, end, number of the kind). Other columns are not read."""
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(field or fit(docs))
    return docs.mapInArrow(_searched(shared), SPANS)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir, "doc_id", "text"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def by_start(spans):
        return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))

    counts = [F.size(F.filter("base", lambda s, k=k: s["kind"] == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(by_start(F.col("base"))), 256).alias("base_sha256"),
                        joined(by_start(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
