"""Static range asymmetric numeral system for token ids, in interleaved lanes.

A block of ids is dealt to K lanes, id i to lane i mod K. All lanes share one stream of 32-bit words and one static table of
frequencies that sum to 2**M; a lane's state stays in [2**31, 2**63). One step codes one id of every lane with array operations.
The encoder goes from the last step to the first, so the stream read forwards decodes forwards.

Block layout, little-endian: magic, version, M, K, number of ids, number of checkpoints, number of words (header ``HEAD``); for each
checkpoint: step, position in the words, crc32 of the ids up to the next checkpoint, then K states; the words; crc32 of all before.
A checkpoint holds all that decoding needs, so the segments between checkpoints can be decoded independently of each other.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U = np.uint64
HEAD = struct.Struct("<4sHHIQII")
POINT = struct.Struct("<QQI")
MAGIC, VERSION = b"TRNS", 1
M, LANES, EVERY = 20, 2048, 128
LOW = 1 << 31


class Table:
    """Frequencies summing to 2**M, at least 1 for every symbol that occurs."""

    def __init__(self, frequency: np.ndarray):
        self.frequency = frequency.astype(U)
        self.before = np.concatenate(([0], np.cumsum(self.frequency)[:-1])).astype(U)
        self._symbols = None

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> "Table":
        """Shares rounded down, at least 1; what is missing or too much is settled on the most frequent symbols in turn."""
        total, size = int(counts.sum()), 1 << M
        if (counts > 0).sum() > size:
            raise ValueError("more symbols than slots")
        f = np.where(counts > 0, np.maximum(1, (counts.astype(object) * size // max(1, total)).astype(np.int64)), 0)
        order = np.argsort(-f, kind="stable")
        rest = size - int(f.sum()) if total else 0
        if rest > 0:
            f[order[0]] += rest
        for k in order:
            if rest >= 0:
                break
            take = min(int(f[k]) - 1, -rest)
            f[k] -= take
            rest += take
        return cls(f)

    @property
    def symbols(self) -> np.ndarray:
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.frequency), dtype=np.uint32), self.frequency.astype(np.int64))
        return self._symbols


def encode(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = int(min(LANES, max(1, n // 64)))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, U)
    f, c = table.frequency[ids], table.before[ids]
    if n and not f.all():
        raise ValueError("an id without frequency")
    shift, mask = U(63 - M), U(0xFFFFFFFF)
    words, points, written = [], [], 0
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        y, fs = x[: b - a], f[a:b]
        full = y >= fs << shift
        if full.any():
            words.append((y[full] & mask).astype(np.uint32))
            written += len(words[-1])
            y[full] >>= U(32)
        q = y // fs
        x[: b - a] = (q << U(M)) + (y - q * fs) + c[a:b]
        if t % EVERY == 0:
            points.append((t, written, x.copy()))
    points.reverse()
    out = [HEAD.pack(MAGIC, VERSION, M, lanes, n, len(points), written)]
    for i, (t, after, states) in enumerate(points):
        end = points[i + 1][0] * lanes if i + 1 < len(points) else n
        out += [POINT.pack(t, written - after, zlib.crc32(ids[t * lanes : end].astype("<u4").tobytes())), states.astype("<u8").tobytes()]
    out += [w.astype("<u4").tobytes() for w in reversed(words)]
    body = b"".join(out)
    return body + struct.pack("<I", zlib.crc32(body))


def decode(block: bytes, table: Table, segment: int | None = None) -> np.ndarray:
    """All ids, or those from one checkpoint to the next. Raises when a checksum differs."""
    magic, version, m, lanes, n, count, size = HEAD.unpack_from(block)
    if magic != MAGIC or version != VERSION or m != M or zlib.crc32(memoryview(block)[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("damaged block")
    at, points = HEAD.size, []
    for _ in range(count):
        points.append((*POINT.unpack_from(block, at), np.frombuffer(block, "<u8", lanes, at + POINT.size)))
        at += POINT.size + 8 * lanes
    words = np.frombuffer(block, "<u4", size, at).astype(U)
    out = np.empty(n, np.uint32)
    first, last = (0, count) if segment is None else (segment, segment + 1)
    mask, shift, low, up = U((1 << M) - 1), U(M), U(LOW), U(32)
    for i in range(first, last):
        t, pos, crc, states = points[i]
        x = states.astype(U)
        end = points[i + 1][0] if i + 1 < count else -(-n // lanes)
        for step in range(t, end):
            a, b = step * lanes, min(n, (step + 1) * lanes)
            y = x[: b - a]
            slot = y & mask
            s = table.symbols[slot]
            out[a:b] = s
            y = table.frequency[s] * (y >> shift) + slot - table.before[s]
            need = y < low
            k = int(need.sum())
            if k:
                y[need] = (y[need] << up) | words[pos : pos + k]
                pos += k
            x[: b - a] = y
        if zlib.crc32(out[t * lanes : min(n, end * lanes)].astype("<u4").tobytes()) != crc:
            raise ValueError("damaged segment")
    return out if segment is None else out[points[first][0] * lanes : (points[last][0] * lanes if last < count else n)]
