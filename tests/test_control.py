"""The negative control replayed in plain Python: the same hash order, the same confusion counts."""

import struct

import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F

from trackspark.operators import evaluate, intervals
from trackspark.sources import bind

LOWS, HIGHS = [10.0, 30.0, 60.0], [90.0, 200.0]


def signed_hash(seed, track, frame):
    """xxHash64 of an int and two longs in turn, each seeded by the hash before, the first by 42."""
    h = 42
    for form, v in (("<i", seed), ("<q", track), ("<q", frame)):
        h = xxhash.xxh64_intdigest(struct.pack(form, v), seed=h)
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("seed", [7, 8])
def test_control_is_the_replayed_permutation(spark, seed):
    d = intervals.label_frames(bind.event_tracks(spark, SF), bind.bouts(spark, SF)).select("track_id", "frame", "signal", "manual").withColumn("last", F.lit(False))
    rows = [tuple(r) for r in d.select("track_id", "frame", "signal", "manual").collect()]
    tracks = {}
    for t, f, s, m in rows:
        tracks.setdefault(t, []).append((f, s, m))
    want, labels = {}, {}
    for t, own in tracks.items():
        frames = sorted(f for f, _, _ in own)
        assert frames == list(range(len(own)))
        dealt = [s for _, f, s in sorted((signed_hash(seed, t, f), f, s) for f, s, _ in own)]
        want |= {(t, f): v for f, v in zip(frames, dealt, strict=True)}
        labels |= {(t, f): m for f, _, m in own}
    control = evaluate.shuffled(d, "signal", seed=seed)
    assert {(r.track_id, r.frame): r.control for r in control.collect()} == want
    true = {(t, f): s for t, f, s, _ in rows}
    assert sum(want[k] != true[k] for k in want) > 0.9 * len(want)
    moved = []
    for r in evaluate.sweep_band(control, "control", "manual", "last", LOWS, HIGHS).collect():
        on = {k for k, v in want.items() if r.low < v < r.high}
        tp = sum(labels[k] == 1 for k in on)
        fn = sum(m == 1 for m in labels.values()) - tp
        assert (r.tp, r.fp, r.fn, r.tn) == (tp, len(on) - tp, fn, len(labels) - len(on) - fn)
        moved.append(tp != sum(labels[k] == 1 for k, v in true.items() if r.low < v < r.high))
    assert len(moved) == len(LOWS) * len(HIGHS) and any(moved)
