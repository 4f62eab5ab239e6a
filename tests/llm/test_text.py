"""Language, tokens, personal data, decontamination, mixture and the pipeline against plain versions."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from llm.conftest import frame, words
from pyspark.sql import functions as F

from trackspark.llm import decontaminate, language, mixing, personal, rans, token_counts, token_files, tokens


def docs_of(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


# -- language

def test_symbols_and_grams():
    s, at = language.symbols(pa.array(["Hé, llo!", "", None, "..1", "a", "  a\t b "], pa.string()))
    assert ["".join(map(chr, s[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)] == [" hé llo ", " ", " ", " ", " a ", " a b "]
    g, edge = language.grams(s, at)
    assert np.diff(edge).tolist() == [7, 0, 0, 0, 2, 4]
    assert ["".join(chr(int(x) >> 16 * k & 0xFFFF) for k in (3, 2, 1, 0)) for x in g[:3]] == ["   h", "  hé", " hé "]


def test_emoji_are_no_letters(spark):
    s, at = language.symbols(pa.array(["\U0001f600\U0001f680", "a\U0001f600b", "\U00010330\U00020000 \uffff"], pa.string()))
    assert ["".join(map(chr, s[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)] == [" ", " a b ", " \uffff\uffff "]
    docs = docs_of(spark).select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(10**9, "\U0001f600\U0001f680 \U0001f600", "en")], "doc_id long, text string, lang string"))
    got = language.identify(docs).where("doc_id = 1000000000").first()
    assert (got.lang_pred, got.score, got.rejected) == ("und", 0.0, True)


def kneser_ney(text_grams, gram, order=4):
    """Interpolated Kneser-Ney by its definition, for one language."""
    counts = {}
    for g in text_grams:
        counts[g] = counts.get(g, 0) + 1
    levels = [counts]
    for _ in range(order - 1):
        below = {}
        for g in levels[0]:
            below[g[1:]] = below.get(g[1:], 0) + 1
        levels.insert(0, below)

    def p(g):
        if not g:
            return 1 / (len(levels[0]) + 1)
        c = levels[len(g) - 1]
        one, two = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        d = min(one / (one + 2 * two) if one else 0.5, 0.9)
        mine = {x: n for x, n in c.items() if x[:-1] == g[:-1]}
        if not mine:
            return p(g[1:])
        total = sum(mine.values())
        return max(mine.get(g, 0) - d, 0) / total + d * len(mine) / total * p(g[1:])

    return p(gram)


def test_model_is_kneser_ney():
    g, _ = language.grams(*language.symbols(pa.array(["the cat sat on the mat", "a hat that the rat had"])))
    packed, n = np.unique(g, return_counts=True)
    model = language.Model({"xx": (packed, n)})
    text = [tuple(int(x) >> 16 * k & 0xFFFF for k in (3, 2, 1, 0)) for x in g]
    for probe in [text[0], text[5], (32, 116, 104, 97), (120, 121, 122, 97), (116, 104, 101, 120), (97, 116, 32, 122)]:
        key = np.array([sum(c << 16 * (3 - i) for i, c in enumerate(probe))], np.uint64)
        assert np.exp(model.logs(key)[0, 0]) == pytest.approx(kneser_ney(text, probe), rel=1e-5)


def test_language_accuracy_and_ids(spark):
    """Held-out accuracy; predictions do not depend on lang, source or ids of held-out rows."""
    docs = docs_of(spark, "/root/testdata/sf0.01").select("doc_id", "text", "lang")
    held = language.third(F.col("doc_id")) % 3 == 1
    got = language.identify(docs.withColumn("held", held), None).where("held")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.97
    blind = docs.withColumn("lang", F.when(~held, F.col("lang")))
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in language.identify(blind).where(held).collect()) == sorted((r.doc_id, r.lang_pred, r.score) for r in got.collect())
    assert got.where("rejected").count() == 0


def test_language_of_the_calibration_part_is_learned(spark):
    """All labels of one language lie in the texts that calibrate: it is still learned, and found in the others."""
    code = language.third(F.col("doc_id"))
    learnable, held = code % 3 != 1, F.floor(code / 3) % 5 == 0
    docs = docs_of(spark, "/root/testdata/sf0.01").select("doc_id", "text", "lang")
    less = docs.withColumn("lang", F.when((F.col("lang") == "fr") & learnable & ~held, None).otherwise(F.col("lang")))
    assert less.where(learnable & (F.col("lang") == "fr") & held).count() > 5
    got = language.identify(less).select("doc_id", "lang_pred").join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").where("truth = 'fr'")
    assert got.where("lang_pred = 'fr'").count() > 0.9 * got.count()


def test_language_awkward(awkward, nothing, spark):
    got = [(r.doc_id, r.lang_pred, r.score, r.rejected) for r in language.identify(awkward).collect()]
    assert len(got) == awkward.count()
    assert all(r[1:] == ("und", 0.0, True) for r in got if r[0] in (1, 2, 3, 4))
    assert all(r[1] in ("en", "fr", "de") and 0 <= r[2] <= 1 for r in got if r[0] not in (1, 2, 3, 4, None))
    assert language.accepted(awkward).columns == awkward.columns
    assert language.identify(nothing).collect() == []
    unknown = frame(spark, [(1, "hello", None, None)])
    assert [(r.lang_pred, r.score) for r in language.identify(unknown).collect()] == [("und", 0.0)]


def test_gibberish_is_rejected(spark):
    docs = docs_of(spark).select("doc_id", "text", "lang")
    r = random.Random(1)
    odd = spark.createDataFrame([(10**9 + i, "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(300)), None) for i in range(5)], "doc_id long, text string, lang string")
    got = language.identify(docs.unionByName(odd))
    assert got.where("doc_id >= 1000000000 and rejected").count() == 5


def test_width_is_the_quantile():
    """The limit leaves the stated share of the calibrating texts beyond it, and is wide where they are too few."""
    for n in (998, 999, 1500, 20_000):
        z = np.random.default_rng(n).standard_t(4, n)
        steps, counts = np.unique(np.ceil(np.minimum(z, language.FARTHEST) / language.STEP).astype(int), return_counts=True)
        limit, slack = language._width(dict(zip(steps.tolist(), counts.tolist(), strict=True)))
        if n < 999:
            assert (limit, slack) == (language.DEVIATIONS, language.SLACK)
        else:
            assert slack == 0 and (z > limit).mean() <= language.FALSE_REJECTS
            exact = np.sort(z)[int(np.ceil((n + 1) * (1 - language.FALSE_REJECTS))) - 1]
            assert exact <= limit < exact + language.STEP + 1e-9
    assert language._width({}) == (language.DEVIATIONS, language.SLACK)


def test_rejection_rate(spark):
    """Held-out texts are rejected about as seldom as stated; texts of shuffled letters, of a language unknown to the model
    and of mixed signs are rejected."""
    docs = docs_of(spark, "/root/testdata/sf0.1").select("doc_id", "text", "lang")
    r = random.Random(3)
    some = [x.text for x in docs.where("lang = 'en' and length(text) > 400").orderBy("doc_id").limit(40).collect()]
    shuffled = ["".join(r.sample(t[:400], 400)).replace(" ", "") for t in some]
    vowels = [" ".join("".join(r.choice(s) for s in ("ptkshmnl", "aiu", "q", "aāī", "xzwj")) for _ in range(60)) for _ in range(40)]
    odd = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(shuffled + vowels)], "doc_id long, text string, lang string")
    got = language.identify(docs.unionByName(odd)).withColumn("held", language.third(F.col("doc_id")) % 3 == 1).collect()
    held = [x for x in got if x.held and x.doc_id < 10**9]
    assert len(held) > 3000 and sum(x.rejected for x in held) <= 5 * language.FALSE_REJECTS * len(held)
    strange = [x for x in got if x.doc_id >= 10**9]
    assert len(strange) == 80 and all(x.rejected for x in strange)


def test_every_gram_counts(spark, monkeypatch):
    """A model beyond the bound of one table scores as that table does, and still has a language whose grams are all rare."""
    r = random.Random(5)
    rare = [" ".join("".join(r.choice("αβγδεζηθικλμνξοπρστυφχψω") for _ in range(5)) for _ in range(12)) for _ in range(60)]
    docs = docs_of(spark).select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(10**9 + i, t, "rare") for i, t in enumerate(rare)], "doc_id long, text string, lang string"))
    known = {x.doc_id: x for x in language.identify(docs).collect()}
    monkeypatch.setattr(language, "GRAMS", 2000)
    got = language.identify(docs).collect()
    assert len(got) == len(known) and all(x.lang_pred == "rare" and not x.rejected for x in got if x.doc_id >= 10**9)
    for x in got:
        y = known[x.doc_id]
        assert (x.lang_pred, x.rejected) == (y.lang_pred, y.rejected)
        assert (x.score, x.cross_entropy) == pytest.approx((y.score, y.cross_entropy), rel=1e-4)


# -- tokens

@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(tokens.WORD_BPE))


ODD = ["a<|endoftext|>b <|startoftext|>", "x\x1cy\x85z　w", "é e ́", "don't I'LL 123 Ⅷ", "ΣΣ Σ", "a\x00b", "  ", "\U0001f600" * 300, "n" * 3000 + " m", "-'s'- ''re", "﻿a", " q"]


def test_word_by_word_is_the_library(library):
    r = random.Random(7)
    parts = list("aé'1 \t\n\x0b\x1c\x85　́<|>sSt.") + ["<|endoftext|>", "'re", "'LL", "Σ"]
    samples = ODD + [x for c in range(0x250) for x in (chr(c), f"a{chr(c)}B", f"{chr(c)}'s")] + ["".join(r.choices(parts, k=r.randrange(30))) for _ in range(3000)]
    enc = tokens.WordEncoder(__import__("public_tokenizers").path(tokens.WORD_BPE))
    for s in samples:
        assert enc.flat(enc.numbered(enc.keys(s.encode()))).tolist() == library.encode(s, add_special_tokens=False).ids, s


@pytest.mark.parametrize(("chunk", "overlap"), [(16_384, 512), (300, 40)])
def test_token_counts(spark, awkward, library, chunk, overlap, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    monkeypatch.setattr(token_counts, "OVERLAP", overlap)
    df = awkward.unionByName(frame(spark, [(100 + i, s, None, None) for i, s in enumerate(ODD)]))
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect()), key=repr)
    got = token_counts.token_counts(df).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_token_counts_empty(nothing):
    assert token_counts.token_counts(nothing).collect() == []


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 5000, 600_000])
def test_range_coding_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.geometric(0.01, n), 40_000).astype(np.uint32)
    ids[: n // 3] = 7  # a symbol of a third of all
    table = rans.Table.of_counts(np.bincount(ids))
    assert int(table.frequency.sum()) == 1 << rans.M
    block = rans.encode(ids, table)
    assert (rans.decode(block, table) == ids).all()
    points = rans.HEAD.unpack_from(block)[5]
    assert (np.concatenate([rans.decode(block, table, i) for i in range(points)]) == ids).all()
    if n > 10_000:
        share = np.bincount(ids)[np.bincount(ids) > 0] / n
        assert len(block) * 8 < 1.1 * n * -(share * np.log2(share)).sum() + 64 * rans.LANES * (points + 1)
    for at in {5, len(block) // 2, len(block) - 1}:
        with pytest.raises(ValueError):
            rans.decode(block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :], table)


def test_frequencies_stay_positive():
    counts = np.ones(60_000, np.int64)
    counts[3] = 10**12
    f = rans.Table.of_counts(counts).frequency
    assert f.min() >= 1 and int(f.sum()) == 1 << rans.M


def files_brute(data, library):
    out, at = [], 0
    for d, t in data:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("block", [1 << 19, 50])
def test_token_files(spark, library, block, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", block)
    df = frame(spark, [(i * 37 % 101, s, None, None) for i, s in enumerate([*ODD, None, "", words(5000, 3)])]).repartition(3)
    data = sorted((r.doc_id, r.text) for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
    assert sorted(tuple(r) for r in token_files.tokens_by_files(df).collect()) == files_brute(data, library)


def test_token_files_awkward(spark, awkward, nothing):
    got = token_files.tokens_by_files(awkward).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0)) and len(ids) == awkward.count()
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    assert token_files.tokens_by_files(nothing).collect() == []


# -- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def base_brute(t):
    out = [(*m.span(), 0) for m in EMAIL.finditer(t)]
    out += [(*m.span(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((*m.span(), 2))
    out += [(*m.span(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def test_base_patterns(spark):
    r = random.Random(1)
    for _ in range(20_000):
        t = "".join(r.choice("a0b1.@@-+ ()92é5") for _ in range(r.randint(0, 40)))
        assert personal.base_spans(t) == base_brute(t), t
    for row in docs_of(spark).select("text").collect():
        assert personal.base_spans(row.text) == base_brute(row.text)


@pytest.fixture(scope="module")
def field():
    return personal.train([" und.34@mail7.example.com ", " +1 (017) 555-7713 ", " 97.51.17.173 word ", " card 4111 1111 1111 1111.", " under 4.0. ", " 5927243074273351 ", " version 3.1 ", ' "04dbebab91ab85687d33eeaaf9ac699e1188f962"', " in 1999 and 2001 ", " +49 (030) 555-1234 "] * 4)


def test_field_sums_over_all_labellings(field):
    """Forward-backward and best labelling against listing every labelling of a short region."""
    text = "+1 (017) 555-7713"
    region = personal.Region(text, 0, len(text))
    K = len(personal.KINDS)
    by_start = {}
    for k, (i, j, f) in enumerate(region.segments):
        by_start.setdefault(i, []).append((j, k, field.span[:, f].sum(axis=1)))

    def all_of(i, last):
        if i == region.n:
            yield 0.0, []
            return
        for score, rest in all_of(i + 1, K):
            yield score + (0 if last is None else field.step[last, K]), rest
        for j, k, s in by_start.get(i, []):
            for y in range(K):
                for score, rest in all_of(j, y):
                    yield score + s[y] + (0 if last is None else field.step[last, y]), [(k, y), *rest]

    listed = list(all_of(0, None))
    scores = np.array([s for s, _ in listed])
    total = np.log(np.exp(scores - scores.max()).sum()) + scores.max()
    p, _, got = field.marginals(region)
    assert got == pytest.approx(total)
    want = np.zeros_like(p)
    for s, path in listed:
        for k, y in path:
            want[k, y] += np.exp(s - total)
    assert np.allclose(p, want)
    assert [(k, y) for _, _, y, k in field.best(region)] == max(listed, key=lambda x: x[0])[1]


def test_field_adds_other_spellings(field):
    found = lambda s: [(s[a:b], personal.KINDS[y]) for a, b, y in field.entities(s)]
    assert ("(017) 555-7713", "phone") in found("call (017) 555-7713 now")
    assert ("joe(at)mail.example.com", "email") in found("write joe(at)mail.example.com")
    for clean in ("version 4.0.", "in 1999 and 2001", 'token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"', "", "no digits"):
        assert found(clean) == []


def test_regions_share_no_character(field):
    """Digits far apart in one long word make one region, and long runs of digits are read once."""
    word = ("a" * 13 + "1") * 300
    assert list(personal.widened(word, personal.regions(word))) == [(0, len(word))]
    text = f"call (017) 555-7713 {word[:140]}.{word[:140]} (017) 555-7714 or 1.2.3.4-{word[:28]}"
    cut = list(personal.widened(text, personal.regions(text)))
    assert all(b <= c for (_, b), (c, _) in zip(cut, cut[1:]))
    found = list(field.entities(text))
    assert len(found) == len(set(found)) and ("(017) 555-7713", 3) in [(text[a:b], y) for a, b, y in found]
    digits = "1" * 200_000
    assert personal.base_spans(f"{digits} 1.2.3.4 {digits}.1") == [(200_001, 200_008, 1)]


def test_personal_data(spark, awkward, nothing, field):
    df = awkward.unionByName(frame(spark, [(50, "a@b.cd +1 (017) 555-7713 1.2.3.4 4111 1111 1111 1111 é", None, None)]))
    got = personal.personal_data(df, field).collect()
    assert len(got) == df.count()
    for r in got:
        text = next(x.text or "" for x in df.collect() if x.doc_id == r.doc_id and (r.doc_id is not None or x.text))
        assert r.doc_id is None or [tuple(s) for s in r.base] == base_brute(text)
        assert not any(s.start < b.end and b.start < s.end for s in r.added for b in r.base)
    assert personal.personal_data(nothing, field).collect() == []
    assert personal.personal_data(nothing).collect() == []


# -- decontamination

def naive_tiles(a, b, least):
    """Greedy string tiling by comparing every pair of positions."""
    ma, mb, tiles = [False] * len(a), [False] * len(b), []
    while True:
        top, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > top:
                    top, found = n, [(i, j)]
                elif n == top and n >= least:
                    found.append((i, j))
        if not found:
            return tiles
        for i, j in found:
            if not any(ma[i : i + top]) and not any(mb[j : j + top]):
                ma[i : i + top] = mb[j : j + top] = [True] * top
                tiles.append((i, j, top))


def test_tiling_is_greedy():
    r = random.Random(2)
    for _ in range(150):
        a, b = (np.array([r.randrange(4) + 1 for _ in range(r.randrange(3, 30))], np.uint64) for _ in range(2))
        assert decontaminate.tile(a, b, 3) == naive_tiles(a.tolist(), b.tolist(), 3)


def bench_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


@pytest.mark.parametrize("block", [4 << 20, 400])
def test_decontamination(spark, awkward, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    items = [words(30, 100 + i, 3000) for i in range(12)] + ["only four words here", None, ""]
    w = [i.split() for i in items[:12]]
    cases = {  # id: (text, items found)
        200: (words(50, 1) + " " + items[0] + " " + words(50, 2), [0]),
        201: (" ".join(w[1][20:] + ["x"] + w[1][10:20] + ["y", "z"] + w[1][:10]), [1]),  # reordered
        202: (items[2].upper().replace(" ", ",\n") + "!", [2]),
        203: (" ".join(w[3][:14]), []),  # 14 of 30
        204: (" ".join(w[3][:15]), [3]),
        205: (" ".join(w[4] + w[5]), [4, 5]),
        206: (" ".join(x for i in range(0, 30, 4) for x in [*w[6][i : i + 4], "gap"]), []),  # runs too short
        207: (" ".join([items[7]] * 50), [7]),
        208: ("Only four, words HERE", [12]),
        209: ("only four other words here", []),
        210: ("before only four words here and after only four words here", [12]),
    }
    df = awkward.unionByName(frame(spark, [(d, t, None, None) for d, (t, _) in cases.items()]))
    bench = bench_of(spark, items)
    got = {r.doc_id: sorted(m["item"] for m in r.found) for r in decontaminate.with_matches(df, bench, "found").collect()}
    assert {d: got[d] for d in cases} == {d: f for d, (_, f) in cases.items()}
    assert all(not f for d, f in got.items() if d not in cases)
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns and left.count() == df.count() - sum(bool(f) for _, f in cases.values())
    assert decontaminate.clean(df, bench_of(spark, [])).count() == df.count()


def test_decontamination_is_brute_force(spark):
    """Every document against every item, without seeds: tiles of all tokens, whole items below the shortest tile."""
    docs = docs_of(spark).where("doc_id % 2 = 0")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    some = re.findall(r"\w+", items[3])
    items += [" ".join(some[:n]) for n in (1, 2, 3, 4, 5, 6)] + ["zzz none of this", "the", items[0]]
    got = {r.doc_id: {m["item"]: m["coverage"] for m in r.found} for r in decontaminate.with_matches(docs, bench_of(spark, items), "found").collect()}

    def split(t):
        return decontaminate.tokens(pa.array([t], pa.string()))[0]

    bench = [split(t) for t in items]
    for d, text in texts.items():
        w, want = split(text), {}
        for i, b in enumerate(bench):
            if len(b) < decontaminate.LEAST:
                cover = float(any((w[p : p + len(b)] == b).all() for p in range(len(w) - len(b) + 1)))
            else:
                common = np.isin(b, w).sum() >= decontaminate.SHARE * len(b)  # no tile without common tokens
                cover = sum(t[2] for t in decontaminate.tile(b, w)) / len(b) if common else 0.0
            if cover >= decontaminate.SHARE:
                want[i] = cover
        assert got[d] == pytest.approx(want), d
    assert sum(map(bool, got.values())) > 3


def test_decontamination_of_scripts_without_spaces(spark):
    items = ["我们今天下午去公园散步，然后回家吃饭。", "วันนี้อากาศดีมากเราไปเดินเล่นกัน", "Il a dit : « bonjour à tous les amis » — puis rien"]
    texts = ["前面还有别的话。" + items[0].replace("，", "、\u3000") + "后面也有很多别的话", "ก่อนหน้า" + items[1] + "abc", "x " + items[2].replace("—", "…").replace("«", "“").replace(" »", "”"), "我们昨天下午在公园散了步", "abc " + items[0][:12]]
    got = decontaminate.with_matches(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]), bench_of(spark, items), "found")
    assert [[m["item"] for m in r.found] for r in got.orderBy("doc_id").collect()] == [[0], [1], [2], [], [0]]
    w, at = decontaminate.tokens(pa.array(["a日本b、c", "日", "", "é日", "été’s \U00020000x"], pa.string()))
    assert np.diff(at).tolist() == [5, 1, 0, 2, 4] and w[1] == w[5] == w[7]


# -- mixture

def test_raking_meets_targets(spark):
    r = random.Random(3)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", r.randrange(500, 2000)) for i in range(6) for j in range(3) for k in range(2)], "source string, lang string, topic string, tokens long")
    out = mixing.rake(cells).toPandas()
    for s in mixing.SIDES:
        share = out.groupby(s).tokens.sum() ** mixing.TEMPER
        want = out.tokens.sum() * share / share.sum()
        assert np.allclose(out.groupby(s).weight.sum(), want, rtol=1e-3)
    assert (out.weight <= out.tokens / mixing.RATE + 1e-6).all()


def test_raking_goes_on_until_it_converges(spark, monkeypatch):
    """One source holds a third of the tokens of every other; some values cannot reach their target."""
    r = random.Random(4)
    made = [(f"s{i}", f"l{j}", f"t{k}", int(r.uniform(1, 3) * (30, 300, 3000)[k] * 2 ** (i / 2))) for i in range(8) for j in range(4) for k in range(3)]
    made = [(s, x, t, n - n // 3) for s, x, t, n in made] + [("hot", f"l{j}", f"t{k}", sum(n // 3 for _, x, t, n in made if (x, t) == (f"l{j}", f"t{k}"))) for j in range(4) for k in range(3)]
    cells = spark.createDataFrame(made, "source string, lang string, topic string, tokens long")
    total, missed, wanted = sum(n for *_, n in made), {}, {}
    for s in mixing.SIDES:
        held = cells.groupBy(s).agg(F.sum("tokens").alias("n")).toPandas().set_index(s).n.astype(float)
        power, most, low, top = held**mixing.TEMPER, held / mixing.RATE, 0.0, 1e9
        for _ in range(200):  # by bisection
            mid = (low + top) / 2
            low, top = (mid, top) if np.minimum(most, power * mid).sum() < total else (low, mid)
        wanted[s] = np.minimum(most, power * low)
    for name, raked in (("rounds", mixing.rake), ("fully", mixing.rake_fully), ("dealt", mixing.rake_fully)):
        if name == "dealt":
            monkeypatch.setattr(mixing, "FEW", 0)
            monkeypatch.setattr(mixing, "TOLERANCE", 1e-3)
        out = raked(cells).toPandas()
        assert (out.weight <= out.tokens / mixing.RATE * (1 + 1e-9)).all()
        missed[name] = max((out.groupby(s).weight.sum() / wanted[s] - 1).abs().max() for s in mixing.SIDES)
    assert missed["rounds"] > 0.01 and missed["fully"] < 1e-3 and missed["dealt"] < 1e-2


def test_mixing_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(6, 1, 0), (6, 0, 1), (None, 1, 1), (7, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = mixing.mixed(awkward.select("doc_id", "text", "source", "lang"), labels).collect()
    assert len(got) == awkward.count()
    assert {r.doc_id: r._topic for r in got if r.doc_id in (5, 6, 7)} == {5: "none", 6: "toxic", 7: "low"}
    assert all(0 <= r._probability <= 1 + 1e-9 for r in got)
    assert all(r._tokens == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in got)
    assert mixing.sample(awkward, labels).columns == awkward.columns
    assert mixing.sample(nothing, labels).collect() == [] and mixing.sample(awkward, labels.limit(0)).count() > 0


def test_sample_share(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = mixing.mixed(docs.select("doc_id", "text", "source", "lang"), labels)
    kept, meant = out.agg(F.sum(F.when(F.col("_kept"), F.col("_tokens")).otherwise(0)), F.sum(F.col("_probability") * F.col("_tokens"))).first()
    assert kept == pytest.approx(meant, rel=0.12)


# -- pipeline

def test_pipeline_is_its_stages(spark, library):
    import corpus_pipeline as p

    docs = docs_of(spark)
    kept, bench = docs, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in p.STAGES[:4]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        before, after = {r.doc_id: r.text for r in kept.collect()}, {r.doc_id: r.text for r in out.collect()}
        assert set(after.items()) <= set(before.items())
        if name == "language_id":
            assert len(after) == len(before)
        if name == "near_dedup":
            from llm.test_dedup import near_brute

            assert set(after) == {d for d, _, c in near_brute(list(before.items())) if c == d}
        if name == "decontaminate":
            gone = set(before) - set(after)
            squeeze = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
            assert gone >= {d for d, t in before.items() if any(squeeze(b) in squeeze(t) for b in bench)}
        kept = spark.createDataFrame(out.collect(), docs.schema)
    want = files_brute(sorted(after.items()), library)
    assert sorted(tuple(r) for r in p.as_token_files(spark, kept, SF).collect()) == want
    assert sorted(tuple(r) for r in p.run(spark, SF).collect()) == want


def test_pipeline_awkward(spark, awkward, nothing, tmp_path):
    import corpus_pipeline as p

    bench_of(spark, [words(20, 1)]).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (awkward, nothing):
        for _, stage in p.STAGES[:4]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
            stage(spark, docs, str(tmp_path)).collect()
