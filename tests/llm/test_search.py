"""Ranked search, fingerprints and source divergence against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm.conftest import frame, rows

from trackspark.llm import divergence, fingerprints, search, terms

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM, LETTERS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def found(pattern, text):
    return re.findall(pattern, (text or "").translate(LOW))


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


@pytest.mark.parametrize("pattern, inside", [(ALNUM, terms.ALNUM), (LETTERS, terms.LETTERS)])
@pytest.mark.parametrize("window", [1, 3, 1 << 20])
def test_terms(pattern, inside, window, monkeypatch):
    monkeypatch.setattr(terms, "PIECE", window)
    r = random.Random(5)
    texts = ["".join(r.choices("aB9 _é\x7f{ÉÄ漢-\U0001f600", k=r.randrange(12))) for _ in range(60)] + ["", "abc", "def", "", "1", ""]
    words, code, doc = terms.coded(*packed(texts), inside)
    got = [(d, words[c].as_py()) for c, d in zip(code.tolist(), doc.tolist(), strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in found(pattern, t)]


# -- search

def search_brute(docs, items, top=10):
    docs = [(d, found(ALNUM, t)) for d, t in docs]
    docs = [(d, len(w), Counter(w)) for d, w in docs if w]
    n_all, total = len(docs), sum(n for _, n, _ in docs)
    df = Counter(t for _, _, c in docs for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(found(ALNUM, t))
    out = []
    for i, q in wanted.items():
        scored = []
        for d, n, c in docs:
            m = 100 - 90 + 90 * n * n_all // total
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in q if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, bundle", [(4096, 128), (7, 2)])
def test_search(spark, awkward, block, bundle, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_DOCS", block)
    monkeypatch.setattr(search, "BUNDLE", bundle)
    r = random.Random(9)
    vocabulary = [f"t{i}" for i in range(300)]
    spread = [1 / (i + 1) for i in range(300)]
    more = [(100 + i, " ".join(r.choices(vocabulary, spread, k=r.randrange(1, 60))), "en", "a") for i in range(400)]
    more += [(600 + i, "t1 T2 t3 common", "en", "a") for i in range(150)]  # ties beyond the ranks
    docs = awkward.unionByName(frame(spark, more))
    items = [(1, "t1 t2 t250 w17"), (2, None), (3, ""), (4, "nowhere at all"), (5, " ".join(r.choices(vocabulary, k=60))), (None, "t5 é"), (7, "t9 t9 t9"), (7, "COMMON w1"), (8, "x")]
    items += [(20 + i, " ".join(r.choices(vocabulary, spread, k=12))) for i in range(20)]
    given = spark.createDataFrame([(i, t, "q", 1) for i, t in items], "item_id long, text string, term string, block int")
    got = rows(search.search(docs, given))
    assert got == search_brute([(d.doc_id, d.text) for d in docs.select("doc_id", "text").collect()], items)


def test_search_empty(spark, nothing, awkward):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert search.search(nothing, items).collect() == []
    assert search.search(awkward, items.limit(0)).collect() == []
    assert search.search(frame(spark, [(1, "...", "en", "a"), (2, None, "en", "a")]), items).collect() == []


# -- fingerprints

def plain_print(text):
    """The definition, byte by byte."""
    data, mask = text.encode(), 0xFFFFFFFF
    byte, turn = fingerprints._byte.tolist(), fingerprints._turn.tolist()

    def mixed(x):
        x = (x ^ x >> 16) * 0x85EBCA6B & mask
        x = (x ^ x >> 13) * 0xC2B2AE35 & mask
        return x ^ x >> 16

    wide = bytes(6) + data
    h = [mixed(sum(byte[wide[i + j]] * turn[j] for j in range(7)) & mask) for i in range(len(data))]
    zeros = [(x & -x).bit_length() - 1 if x else 32 for x in h]
    k = 2
    while sum(z >= k for z in zeros) >= 64:
        k += 1
    out = []
    for level in (k, k + 1):
        codes, total, any_ = [], 0, False
        for x, z in zip(h, zeros, strict=True):
            total, any_ = total + mixed(x + 0x9E3779B9 & mask), True
            if z >= level:
                codes.append(total)
                total, any_ = 0, False
        if any_:
            codes.append(total)
        codes = [mixed((c ^ c >> 32) & mask) >> 20 for c in codes]
        out.append(codes)
    alphabet = fingerprints._LETTERS.tobytes().decode()
    return k, out[0], out[1], f"{1 << k}:" + ":".join("".join(alphabet[c >> 6] + alphabet[c & 63] for c in s) for s in out)


def plain_same(a, b):
    if not a and not b:
        return 1.0
    best = [0] * (len(b) + 1)
    for x in a:
        best = [0] + [0] * len(b) if not best else best
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(best[j + 1], row[j]))
        best = row
    return 2 * best[-1] / (len(a) + len(b))


def plain_likeness(a, b):
    if a[0] == b[0]:
        return max(plain_same(a[1], b[1]), plain_same(a[2], b[2]))
    return plain_same(a[1], b[2]) if a[0] == b[0] + 1 else plain_same(a[2], b[1]) if b[0] == a[0] + 1 else 0.0


def sample_texts():
    r = random.Random(4)
    texts = ["", "a", "abcdef", "abcdefg", "é" * 40, "ab" * 3000, "\x00" * 500, "x" * 9000, "漢字" * 100 + "z"]
    return texts + ["".join(r.choices("abcdefgh é", k=r.randrange(1, 4000))) for _ in range(40)]


@pytest.mark.parametrize("window", [64, 1 << 20])
def test_prints(window, monkeypatch):
    monkeypatch.setattr(fingerprints, "PIECE", window)
    texts = sample_texts()
    p = fingerprints.prints(*packed(texts))
    spelled = fingerprints.spelled(p)
    plain = [plain_print(t) for t in texts]
    assert spelled == [x[3] for x in plain]
    again = fingerprints.parsed(spelled)
    assert all((x == y).all() for x, y in zip(p, again, strict=True))
    r = np.random.default_rng(1)
    i, j = r.integers(0, len(texts), 300), r.integers(0, len(texts), 300)
    near = fingerprints.likeness(p.take(i), p.take(j))
    assert near == pytest.approx([plain_likeness(plain[a], plain[b]) for a, b in zip(i, j, strict=True)])
    assert (fingerprints.likeness(p, p) == 1).all()


def test_likeness_follows_edits():
    r = random.Random(8)
    base = ["".join(r.choices("abcdefghijklmnop ", k=6000)) for _ in range(30)]
    moved = [t[:2000] + "inserted words" + t[2000:] for t in base]
    a, b = fingerprints.prints(*packed(base)), fingerprints.prints(*packed(moved))
    assert fingerprints.likeness(a, b).min() > 0.9
    assert fingerprints.likeness(a, b.take(np.roll(np.arange(30), 1))).max() < 0.1


def digests_brute(data):
    data = [(d, t or "") for d, t in data]
    out = []
    for i, (d, t) in enumerate(data):
        after = data[(i + 1) % len(data)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        p, e, n = (plain_print(x) for x in (t, edited, after))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), p[3], e[3], round(plain_likeness(p, e), 9), round(plain_likeness(p, n), 9)))
    return sorted(out, key=repr)


def digests(docs, spark):
    got = fingerprints.with_next(docs, fingerprints._digests, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return sorted([(*r[:5], round(r[5], 9), round(r[6], 9)) for r in got.collect()], key=repr)


@pytest.mark.parametrize("n", [1, 2, 49])
@pytest.mark.parametrize("shard", [500, 1 << 28])
def test_followers(spark, n, shard, monkeypatch):
    monkeypatch.setattr(fingerprints, "SHARD", shard)
    texts = sample_texts()[::-1][:n]
    data = [(3 * i - 20, None if i % 11 == 5 else t) for i, t in enumerate(texts)]
    mixed = random.Random(1).sample(data, len(data))
    got = digests(frame(spark, [(d, t, "en", "a") for d, t in mixed]).repartition(3), spark)
    assert got == digests_brute(data)


def test_followers_of_repeated_and_missing_ids(spark, awkward, nothing, monkeypatch):
    monkeypatch.setattr(fingerprints, "SHARD", 2000)
    code = {r.text: r.code for r in awkward.selectExpr("text", "xxhash64(coalesce(text, '')) code").collect()}
    data = sorted(((r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect() if len(r.text or "") < 20000), key=lambda x: (x[0] is None, x[0] or 0, code[x[1]]))
    data += [(40, "same")] * 30
    data.sort(key=lambda x: (x[0] is None, x[0] or 0, code.get(x[1], 0)))
    got = digests(frame(spark, [(d, t, "en", "a") for d, t in data]).repartition(4), spark)
    assert got == digests_brute(data)
    assert digests(nothing, spark) == []


def test_fingerprints_compared(spark, awkward):
    printed = fingerprints.fingerprinted(awkward)
    got = {r.doc_id: r.fingerprint for r in printed.collect() if r.doc_id not in (None, 6)}
    texts = {r.doc_id: r.text for r in awkward.collect()}
    assert all(f == plain_print(texts[d] or "")[3] for d, f in got.items() if len(texts[d] or "") < 10_000)
    pairs = spark.createDataFrame([(1, got[5], got[17]), (2, got[2], got[2]), (3, None, got[5])], "k long, fingerprint string, other string")
    near = {r.k: r.near for r in fingerprints.compared(pairs).collect()}
    assert near[1] > 0.9 and near[2] == 1.0 and near[3] is None


# -- divergence

@pytest.mark.parametrize("words", [["b", "a", "abcdefgh", "abcdefghi", "abcdefgh", "a" * 30, "a" * 31, "a" * 30, "é" * 9, "é" * 9, "abcdefghabcdefgh", "abcdefghabcdefgh"], [], ["x"]])
def test_pointer_sort(words):
    data, at = packed([w + " " for w in words])
    order, first = divergence.pointer_sort(np.concatenate((data, np.zeros(8, np.uint8))), at[:-1], at[1:] - 1)
    want = sorted(range(len(words)), key=lambda i: (words[i].encode(), i))
    assert order.tolist() == want
    assert first.tolist() == [k for k in range(len(words)) if not k or words[want[k]] != words[want[k - 1]]]


def divergence_brute(data, least=10, top=10):
    data = [(found(LETTERS, t), lang or "", src or "") for t, lang, src in data]
    df, count, groups = Counter(), Counter(), defaultdict(set)
    for w, lang, src in data:
        groups[lang].add(src)
        for t in w:
            count[lang, src, t] += 1
        for t in set(w):
            df[lang, t] += 1
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), n in df.items() if x == lang and n >= least]
        v = len(kept)

        def share(c, n, v=v):
            return 1 + 1000000000 * (c + 2) // (n + 2 * v)

        def f(p, q):
            return (p - q) * (p - q) // (p + q)

        n = {s: sum(count[lang, s, t] for t in kept) for s in sources}
        whole = sum(n.values())
        all_ = {t: sum(count[lang, s, t] for s in sources) for t in kept}
        for s in sources:
            pairs = [(-sum(f(share(count[lang, s, t], n[s]), share(count[lang, o, t], n[o])) for t in kept), o.encode(), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -x, r) for r, (x, _, o) in enumerate(sorted(pairs), 1)]
            own = [(-f(share(count[lang, s, t], n[s]), share(all_[t], whole)), t.encode(), t) for t in kept if count[lang, s, t] and share(count[lang, s, t], n[s]) > share(all_[t], whole)]
            out += [(lang, s, "term", t, -x, r) for r, (x, _, t) in enumerate(sorted(own)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard, slice_, side", [(8 << 20, 2048, 64), (300, 5, 2)])
def test_divergence(spark, awkward, shard, slice_, side, monkeypatch):
    for name, value in (("SHARD", shard), ("SLICE", slice_), ("SIDE", side)):
        monkeypatch.setattr(divergence, name, value)
    r = random.Random(2)
    vocabulary = [f"{a}{b}x" for a in "abcdeé" for b in "ABcd"]
    more = [(100 + i, " ".join(r.choices(vocabulary, k=r.randrange(0, 25))), r.choice(["en", "fr", None, ""]), r.choice(["a", "b", "c", None, "", "zz"])) for i in range(300)]
    more += [(500, "only here", "xx", "one"), (501, None, "xx", "two"), (502, "...", "yy", "one"), (503, "a b", "zz", None)]
    docs = awkward.unionByName(frame(spark, more)).repartition(3)
    got = rows(divergence.divergence(docs).select("lang", "source", "part", "item", "value", "rank"))
    assert got == divergence_brute([(d.text, d.lang, d.source) for d in docs.select("text", "lang", "source").collect()])


def test_divergence_empty(nothing):
    assert divergence.divergence(nothing).collect() == []


def test_shares_beyond_64_bits(spark):
    """Counts of a very large corpus: 10^9 times a count does not fit a long."""
    df = spark.createDataFrame([(10**12, 3 * 10**12, 10**6)], "c long, n long, v long")
    assert df.select(divergence._share("c", "n").alias("p")).first().p == 1 + 10**9 * (10**12 + 2) // (3 * 10**12 + 2 * 10**6)


def test_arrow_lists_of_slices():
    column = pa.chunked_array([pa.array([[9], [1, 2], [3]])[1:], pa.array([[4, 5]])])
    values, at = search._arrays(column)
    assert values.tolist() == [1, 2, 3, 4, 5] and at.tolist() == [0, 2, 3, 5]
