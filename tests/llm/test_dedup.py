"""Exact, near, line and byte-string deduplication against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from llm.conftest import frame, rows, words

from trackspark.llm import exact_dedup, graph, line_windows, near_dedup, repeats

SPACE = r"[\x20\x09-\x0D]"


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# -- exact

def exact_brute(data):
    groups = defaultdict(list)
    for d, t in data:
        groups[re.sub(SPACE, "", t or "")].append((-len(t or ""), d is None, d or 0))
    return groups


@pytest.mark.parametrize("limit", [1 << 25, 200])
def test_exact_groups(awkward, limit, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LIMIT", limit)
    data, got = texts(awkward), exact_dedup.exact_groups(awkward).collect()
    groups = exact_brute(data)
    assert len(got) == len(data)
    for (d, t), n in Counter(data).items():
        body = re.sub(SPACE, "", t or "")
        best = min(groups[body])
        mine = [r for r in got if r.doc_id == d and r.text_sha256 == hashlib.sha256(body.encode()).hexdigest()]
        assert {r.group_size for r in mine} == {len(groups[body])}
        assert {r.keep_id for r in mine} == {None if best[1] else best[2]}
    assert sum(r.kept for r in got) == len(groups)


def test_exact_empty(nothing):
    assert exact_dedup.exact_groups(nothing).collect() == []


def test_grace_spills_and_compares_content():
    """Equal codes of different contents stay apart, also where they cannot be split; every level of files is used."""
    r = random.Random(3)
    data = [(r.choice([5, 5 << 40, -7, r.randrange(-1 << 63, 1 << 63)]), bytes(r.choices(b"ab", k=r.randrange(1, 4)))) for _ in range(3000)]
    batch = pa.table({"local": range(3000), "code": pa.array([c for c, _ in data], pa.int64()), "content": pa.array([b for _, b in data], pa.binary()),
                      "n": [1] * 3000, "chars": [1] * 3000, "best_id": range(3000), "best_row": range(3000)}).to_batches(100)
    got = {x["local"]: x for b in exact_dedup.grace(batch, limit=4000) for x in b.to_pylist()}
    want = Counter(data)
    assert len(got) == 3000 and all(got[i]["group_size"] == want[data[i]] for i in range(3000))


# -- near

def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_brute(data):
    sets = [(d, shingle_set(t)) for d, t in data]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if d is not None and e is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(d), find(e)))
                parent[y] = x
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=repr)


def check_near(df):
    got = near_dedup.near_groups(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == near_brute(texts(df))
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_near_awkward(awkward):
    check_near(awkward)


def test_near_chains_and_groups(spark):
    """A chain of edits links ends that are far apart; a group of copies with own edits; ties at the threshold."""
    chain, data = words(120, 5, 5000).split(), []
    for i in range(25):
        data.append((100 + i, " ".join(chain), "en", "a"))
        chain[(i * 7) % 120] = f"edit{i}"
    base = words(150, 6, 5000).split()
    for i in range(60):
        own = list(base)
        for k in random.Random(i).sample(range(150), 3):
            own[k] = f"own{i}"
        data.append((1000 - i, " ".join(own), "en", "a"))
    a = [f"t{i}" for i in range(11)]  # 7 shingles; with 9 of 12 shared below
    data += [(2000, " ".join(a), "en", "a"), (2001, " ".join(a[:10]), "en", "a"), (2002, " ".join(a[:9]), "en", "a"), (2003, " ".join(a[:8]), "en", "a")]
    check_near(frame(spark, data))


def test_near_across_cells(spark, monkeypatch):
    """A bucket of many components is cut into cells."""
    monkeypatch.setattr(near_dedup, "CELL", 700)
    base, data = words(90, 8, 5000).split(), []
    for i in range(70):
        own, r = list(base), random.Random(i)
        for k in r.sample(range(90), r.choice([1, 2, 4, 6, 9])):
            own[k] = f"own{i}"
        data.append((i * 31 % 997, " ".join(own), "en", "a"))
    check_near(frame(spark, data))


def test_near_on_table(spark):
    check_near(spark.read.parquet(f"{SF}/documents.parquet"))


def test_near_empty(nothing):
    assert near_dedup.near_groups(nothing).collect() == []


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(1)
    x = np.unique(r.integers(0, 1 << 63, 4000).astype(np.uint64))
    sets = [x[:1], x[:3000], x[600:3600], x[:0]]
    s = near_dedup.sketches(np.concatenate(sets), np.array([len(v) for v in sets]))
    full = ~np.uint64(0)
    assert (s[:3] != full).all() and (s[3] == full).all()
    similarity = len(np.intersect1d(sets[1], sets[2])) / len(np.union1d(sets[1], sets[2]))
    assert abs((s[1] == s[2]).mean() - similarity) < 0.13


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {x.a: x.b for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


# -- lines

def lines_brute(data):
    data = sorted(set(data), key=lambda x: (x[0] is None, x[0] or 0))
    seen, out = set(), {}
    for d, t in data:
        lines = (t or "").split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out[d, t] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_lines(awkward, spark):
    more = frame(spark, [(20 + i, "\n".join(random.Random(i).choices("pqrs", k=9)), "en", "a") for i in range(40)])
    df = awkward.unionByName(more)
    data, want = texts(df), lines_brute(texts(df))
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in line_windows.drop_repeated_windows(df).collect()), key=repr)
    # rows without id whose texts differ come in the order of a hash; none of these repeats another
    assert got == sorted(((d, *want[d, t]) for d, t in data), key=repr)


def test_lines_empty(nothing):
    assert line_windows.drop_repeated_windows(nothing).collect() == []


# -- byte strings

def repeats_brute(data):
    bodies = [(t or "").encode() for _, t in data]
    seen = Counter(b[i : i + 200] for b in bodies for i in range(len(b) - 199))
    out = []
    for (d, _), b in zip(data, bodies, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0])))).reshape(-1, 2)
        out.append((d, len(b), [tuple(x) for x in runs.tolist()], bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "segment"), [(1 << 22, 1 << 19), (3000, 700)])
def test_repeats(spark, awkward, block, segment, monkeypatch):
    for name, value in (("BLOCK", block), ("SEGMENT", segment), ("BATCH", 64), ("IN_MEMORY", 256)):
        monkeypatch.setattr(repeats, name, value)
    passage, r = words(70, 9), random.Random(4)
    data = [(30 + i, words(60, 50 + i) + " " + passage[r.randrange(60) : 300 + r.randrange(60)] + words(40, 90 + i), "en", "a") for i in range(30)]
    data += [(70, "ab" * 400, "en", "a"), (71, "z" * 199, "en", "a"), (72, "z" * 199, "en", "a"), (73, "é" * 100, "en", "a"), (74, "é" * 101, "en", "a")]
    df = frame(spark, data).unionByName(awkward.where("doc_id != 5 or doc_id is null"))
    got = sorted(((x.doc_id, x.n_bytes, [(s.start, s.end) for s in x.spans], bytes(x.kept)) for x in repeats.remove_repeats(df).collect()), key=repr)
    assert got == repeats_brute(texts(df))


def test_repeats_empty(nothing):
    assert rows(repeats.remove_repeats(nothing)) == []


def test_log_index_levels(tmp_path):
    """Batches of any sizes give what one sort of all entries gives; level sizes fall."""
    r = np.random.default_rng(5)
    index, all_ = repeats.LogIndex(str(tmp_path)), []
    for n in (1, 5, 40, 3, 3, 100, 7, 64, 64):
        e = [r.integers(0, 90, n).astype(np.int64), r.integers(0, 3, n).astype(np.int64), np.arange(n) + 1000 * len(all_), r.random(n) < 0.02]
        e[1] += 10 * e[0]
        index.add(*e)
        all_.append(e)
    sizes = [len(x[0]) for x in index.levels]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)
    p, q, b, many = (np.concatenate(x) for x in zip(*all_, strict=True))
    reach, prefix = Counter(q.tolist()), defaultdict(set)
    for x, y in zip(p.tolist(), q.tolist(), strict=True):
        prefix[x].add(y)
    want = {k: (len(prefix[x]) > 1) * 1 + (reach[y] > 1 or m) * 2 for k, x, y, m in zip(b.tolist(), p.tolist(), q.tolist(), many.tolist(), strict=True)}
    got = {k: s for block, _, state in index.matches() for k, s in zip(block.tolist(), state.tolist(), strict=True)}
    assert got == {k: s for k, s in want.items() if s}
