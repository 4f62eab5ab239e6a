"""Hidden Markov models over long tracks.

A track is cut into frame chunks. Per chunk the product of the K x K transition-times-emission matrices is formed; the
products of a track, one small matrix per chunk, are combined into the vectors entering and leaving every chunk; with
these the chunk runs its own forward-backward (or max-plus) recursion. No task sees more than a chunk, and only sums of fixed
size (K states, d features) reach the driver between rounds. Tracks that fit one chunk need no combining: each round is one pass over
them, and the tracks of a batch advance side by side, one frame at a time. Several models are fitted in the same passes. The rounds of a
fit read blocks of tracks that were laid side by side once; log-densities and sums of Gaussian states are products with the squares and
products of a block's columns, which all models share.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .chunk import chunk_size, with_chunk

GROUP = 1024  # chunk matrices combined per task and level
#: Rows of the tracks that advance side by side, the fewest tracks for which that pays, the longest for which it always does, and rows per task.
LANE_ROWS, LANES, SHORT, TASK_ROWS = 524_288, 16, 256, 500_000
#: Frames from one scaling of forward vectors to the next, rows of which log-densities are computed at a time, most columns whose products are shared.
SCALE_EVERY, STRIP, SHARED_COLUMNS = 4, 16384, 6
#: Sums of forward vectors below this have lost digits. Squared distances in deviations above the other lose them where squares are multiplied out.
LEAST_SUM, MOST_SQUARE = 1e-200, 1e7


class GaussianEmission:
    """Gaussian per state, full or diagonal covariance."""

    def __init__(self, means: np.ndarray, covs: np.ndarray, diagonal: bool = False, ridge: float = 1e-3):
        self.means, self.covs, self.diagonal, self.ridge = np.asarray(means, float), np.asarray(covs, float), diagonal, ridge

    @property
    def states(self) -> int:
        return len(self.means)

    @property
    def parts(self) -> int:
        return len(self.means)

    def log_prob(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((self.states, len(x))).T
        for k in range(self.states):
            low = np.linalg.cholesky(self.covs[k])
            z = np.linalg.inv(low) @ (x - self.means[k]).T
            out[:, k] = -0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
        return out

    def sums(self, x: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        # centred on the current means, so the second moments keep their digits
        parts = [gamma.sum(axis=0)]
        c = [x - m for m in self.means]
        parts += [gamma[:, k] @ c[k] for k in range(self.states)]
        parts += [((gamma[:, k, None] * c[k]).T @ c[k]).ravel() for k in range(self.states)]
        return np.concatenate(parts)

    def updated(self, s: np.ndarray) -> GaussianEmission:
        k, d = self.means.shape
        w, first, second = s[:k], s[k:k + k * d].reshape(k, d), s[k + k * d:].reshape(k, d, d)
        w = np.maximum(w, 1e-12)
        shift = first / w[:, None]
        covs = second / w[:, None, None] - shift[:, :, None] * shift[:, None, :]
        if self.diagonal:
            covs = covs * np.eye(d)
        return GaussianEmission(self.means + shift, covs + self.ridge * np.eye(d), self.diagonal, self.ridge)

    def quadratic(self, shift: np.ndarray, reach: np.ndarray) -> np.ndarray | None:
        """Coefficients (K, 1 + d + d(d+1)/2) of the log-densities in ``_products_of`` x - shift; None where digits would be lost for x within
        ``reach`` of the shift."""
        k, d = self.means.shape
        i, j = np.triu_indices(d)
        out = np.empty((k, 1 + d + len(i)))
        for s in range(k):
            low = np.linalg.cholesky(self.covs[s])
            inv = np.linalg.inv(low)
            a, m = inv.T @ inv, self.means[s] - shift
            if not d * ((reach + np.abs(m)) ** 2) @ np.diag(a) < MOST_SQUARE:
                return None
            out[s, 0] = -0.5 * m @ a @ m - np.log(np.diag(low)).sum() - 0.5 * d * np.log(2 * np.pi)
            out[s, 1 : 1 + d] = a @ m
            out[s, 1 + d :] = np.where(i == j, -0.5, -1.0) * a[i, j]
        return out

    def from_products(self, s: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """``sums`` from the weighted sums (K, 1 + d + d(d+1)/2) of ``_products_of`` x - shift."""
        k, d = self.means.shape
        i, j = np.triu_indices(d)
        w, first, m = s[:, 0], s[:, 1 : 1 + d], self.means - shift
        second = np.empty((k, d, d))
        second[:, i, j] = second[:, j, i] = s[:, 1 + d :]
        cross = first[:, :, None] * m[:, None, :]
        second += w[:, None, None] * m[:, :, None] * m[:, None, :] - cross - cross.transpose(0, 2, 1)
        return np.concatenate([w, (first - w[:, None] * m).ravel(), second.ravel()])

    def centers(self) -> np.ndarray:
        return self.means

    def reordered(self, order) -> GaussianEmission:
        return GaussianEmission(self.means[order], self.covs[order], self.diagonal, self.ridge)


class CategoricalEmission:
    """Probability of every code per state."""

    def __init__(self, table: np.ndarray):
        self.table = np.asarray(table, float)

    @property
    def states(self) -> int:
        return len(self.table)

    @property
    def parts(self) -> int:
        return len(self.table)

    def log_prob(self, x: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(self.table[:, x[:, 0].astype(int)].T, 1e-300))

    def sums(self, x: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        codes = x[:, 0].astype(int)
        return np.concatenate([np.bincount(codes, gamma[:, k], self.table.shape[1]) for k in range(self.states)])

    def updated(self, s: np.ndarray) -> CategoricalEmission:
        t = s.reshape(self.table.shape)
        return CategoricalEmission(t / np.maximum(t.sum(axis=1, keepdims=True), 1e-12))

    def centers(self) -> np.ndarray:
        return self.table @ np.arange(self.table.shape[1])[:, None]

    def reordered(self, order) -> CategoricalEmission:
        return CategoricalEmission(self.table[order])


class MixtureEmission:
    """A mixture of full-covariance Gaussians per state: weights (K, G), means (K, G, d), covs (K, G, d, d)."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, covs: np.ndarray, ridge: float = 1e-3):
        self.weights, self.means, self.covs, self.ridge = np.asarray(weights, float), np.asarray(means, float), np.asarray(covs, float), ridge

    @property
    def states(self) -> int:
        return len(self.means)

    @property
    def parts(self) -> int:
        return self.weights.size

    def _parts(self) -> GaussianEmission:
        d = self.means.shape[-1]
        return GaussianEmission(self.means.reshape(-1, d), self.covs.reshape(-1, d, d), ridge=self.ridge)

    def _logs(self, x: np.ndarray) -> np.ndarray:
        k, g = self.weights.shape
        return self._parts().log_prob(x).reshape(len(x), k, g) + np.log(np.maximum(self.weights, 1e-300))

    def log_prob(self, x: np.ndarray) -> np.ndarray:
        logs = self._logs(x)
        top = logs.max(axis=2)
        return top + np.log(np.exp(logs - top[:, :, None]).sum(axis=2))

    def sums(self, x: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        logs = self._logs(x)
        share = np.exp(logs - logs.max(axis=2, keepdims=True))
        share *= (gamma / share.sum(axis=2))[:, :, None]
        return self._parts().sums(x, share.reshape(len(x), -1))

    def updated(self, s: np.ndarray) -> MixtureEmission:
        k, g, d = self.means.shape
        w = np.maximum(s[: k * g].reshape(k, g), 1e-12)
        parts = self._parts().updated(s)
        return MixtureEmission(w / w.sum(axis=1, keepdims=True), parts.means.reshape(k, g, d), parts.covs.reshape(k, g, d, d), self.ridge)

    def quadratic(self, shift: np.ndarray, reach: np.ndarray) -> np.ndarray | None:
        """As for Gaussians, a row for each part of each state."""
        out = self._parts().quadratic(shift, reach)
        if out is not None:
            out[:, 0] += np.log(np.maximum(self.weights, 1e-300)).ravel()
        return out

    def from_products(self, s: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return self._parts().from_products(s, shift)

    def centers(self) -> np.ndarray:
        return (self.weights[:, :, None] * self.means).sum(axis=1)

    def reordered(self, order) -> MixtureEmission:
        return MixtureEmission(self.weights[order], self.means[order], self.covs[order], self.ridge)


@dataclass
class HMM:
    start: np.ndarray
    trans: np.ndarray
    emission: GaussianEmission | CategoricalEmission | MixtureEmission
    trace: list[float] = field(default_factory=list)

    @property
    def states(self) -> int:
        return len(self.start)

    def ordered(self) -> HMM:
        """States sorted by their first feature, since their order is arbitrary."""
        o = np.argsort(self.emission.centers()[:, 0])
        return HMM(self.start[o], self.trans[np.ix_(o, o)], self.emission.reordered(o), self.trace)


def gaussian_start(means, covs, sticky: float = 0.9, diagonal: bool = False, ridge: float = 1e-3) -> HMM:
    k = len(means)
    trans = np.full((k, k), (1 - sticky) / max(k - 1, 1)) + np.eye(k) * (sticky - (1 - sticky) / max(k - 1, 1))
    return HMM(np.full(k, 1 / k), trans / trans.sum(axis=1, keepdims=True), GaussianEmission(means, covs, diagonal, ridge))


def mixture_start(means, covs, parts: int = 2, spread: float = 0.5, sticky: float = 0.9) -> HMM:
    """Components side by side around each state's mean, ``spread`` deviations apart."""
    base = gaussian_start(means, covs, sticky)
    k, d = np.shape(means)
    shift = (np.arange(parts) - (parts - 1) / 2) * spread
    deviation = np.sqrt(np.array([np.diag(c) for c in covs]))
    m = np.asarray(means, float)[:, None, :] + shift[None, :, None] * deviation[:, None, :]
    return HMM(base.start, base.trans, MixtureEmission(np.full((k, parts), 1 / parts), m, np.repeat(np.asarray(covs, float)[:, None], parts, axis=1)))


def categorical_start(states: int, codes: int, sticky: float = 0.9) -> HMM:
    """Deterministic, slightly uneven emission tables."""
    t = 1 + 0.5 * np.cos(np.arange(states)[:, None] * (np.arange(codes)[None, :] + 1))
    base = gaussian_start(np.zeros((states, 1)), np.ones((states, 1, 1)), sticky)
    return HMM(base.start, base.trans, CategoricalEmission(t / t.sum(axis=1, keepdims=True)))


# --- recursions inside one chunk (numpy) -------------------------------------------------------------------------------
# The rows of a chunk form about sqrt(n) blocks that advance together: the block products give the vectors at the block
# borders, from which all blocks run their recursion side by side.
def _steps(model: HMM, x: np.ndarray, first: bool, best: bool) -> tuple[np.ndarray, float]:
    """(blocks, rows, K, K) step matrices, padded with neutral steps, and the log scale taken out of them.

    The first row of a track has no transition into it.
    """
    k, n = model.states, len(x)
    lb = model.emission.log_prob(x)
    with np.errstate(divide="ignore"):
        if best:
            step = np.log(model.trans)[None] + lb[:, None, :]
            neutral, log = np.where(np.eye(k) > 0, 0.0, -np.inf), 0.0
            opening = neutral + lb[0][None, :]
        else:
            top = lb.max(axis=1)
            b = np.exp(lb - top[:, None])
            step, neutral, log = model.trans[None] * b[:, None, :], np.eye(k), top.sum()
            opening = np.diag(b[0])
    if first:
        step[0] = opening
    rows = int(np.ceil(np.sqrt(n)))
    blocks = -(-n // rows)
    pad = np.broadcast_to(neutral, (blocks * rows - n, k, k))
    return np.concatenate([step, pad]).reshape(blocks, rows, k, k), log


def _times(a: np.ndarray, b: np.ndarray, best: bool) -> np.ndarray:
    return (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2) if best else a @ b


def _left(v: np.ndarray, m: np.ndarray, best: bool) -> np.ndarray:
    return (v[..., :, None] + m).max(axis=-2) if best else (v[..., None, :] @ m)[..., 0, :]


def _right(m: np.ndarray, v: np.ndarray, best: bool) -> np.ndarray:
    return (m + v[..., None, :]).max(axis=-1) if best else (m @ v[..., :, None])[..., 0]


def _even(v: np.ndarray, best: bool, axes) -> tuple[np.ndarray, np.ndarray]:
    """Take the largest entry out; returns the rest and its log."""
    top = v.max(axis=axes, keepdims=True)
    if best:
        return v - top, np.squeeze(top, axes)
    return v / top, np.log(np.squeeze(top, axes))


def _block_products(steps: np.ndarray, best: bool) -> tuple[np.ndarray, np.ndarray]:
    m, log = _even(steps[:, 0], best, (1, 2))
    for t in range(1, steps.shape[1]):
        m, more = _even(_times(m, steps[:, t], best), best, (1, 2))
        log = log + more
    return m, log


def chunk_product(model: HMM, x: np.ndarray, first: bool, best: bool) -> np.ndarray:
    """Log of the K x K product over the rows of a chunk; ``best`` uses (max, +) instead of (+, x)."""
    steps, scale = _steps(model, x, first, best)
    blocks, logs = _block_products(steps, best)
    m, log = blocks[0], logs.sum() + scale
    for nxt in blocks[1:]:
        m, more = _even(_times(m, nxt, best), best, (0, 1))
        log = log + more
    with np.errstate(divide="ignore"):
        return (m if best else np.log(m)) + log


def _runs(steps: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward vector after and backward vector after every row, each up to a factor (rows, K); log of the chunk's total."""
    blocks, logs = _block_products(steps, False)
    nb, rows, k, _ = steps.shape
    ins, outs = np.empty((nb, k)), np.empty((nb, k))
    v, total = _even(enter, False, 0)
    total = total + logs.sum()
    for i in range(nb):
        ins[i] = v
        v, more = _even(_left(v, blocks[i], False), False, 0)
        total = total + more
    total = total + np.log(v.sum())
    v = _even(leave, False, 0)[0]
    for i in range(nb - 1, -1, -1):
        outs[i] = v
        v = _even(_right(blocks[i], v, False), False, 0)[0]
    ahead, behind = np.empty((nb, rows, k)), np.empty((nb, rows, k))
    v = ins
    for t in range(rows):
        v = _even(_left(v, steps[:, t], False), False, (1,))[0]
        ahead[:, t] = v
    v = outs
    for t in range(rows - 1, -1, -1):
        behind[:, t] = v
        v = _even(_right(steps[:, t], v, False), False, (1,))[0]
    return ahead.reshape(-1, k), behind.reshape(-1, k), float(total)


def _posterior(model: HMM, x: np.ndarray, first: bool, enter: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    n = len(x)
    steps, scale = _steps(model, x, first, False)
    alpha, beta, total = _runs(steps, enter, leave)
    alpha, beta = alpha[:n], beta[:n]
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    lo = 1 if first else 0
    before = np.vstack([enter[None], alpha[:-1]])[lo:]
    pair = before[:, :, None] * steps.reshape(-1, *model.trans.shape)[lo:n] * beta[lo:, None, :]
    xi = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0) if len(pair) else np.zeros_like(model.trans)
    return gamma, xi, total + float(scale)


def chunk_posterior(model: HMM, x: np.ndarray, first: bool, enter: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """gamma (n, K) and summed xi (K, K) of a chunk from the vectors entering it and following it."""
    return _posterior(model, x, first, enter, leave)[:2]


def track_posterior(model: HMM, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """gamma, summed xi and log-likelihood of a whole track."""
    return _posterior(model, x, True, model.start, np.ones(model.states))


def chunk_best(model: HMM, x: np.ndarray, first: bool, enter: np.ndarray, end: int | None) -> np.ndarray:
    """States of one best path through a chunk that ends in state ``end`` (None: the best one).

    Every step back follows the pointer of the state chosen after it, so ties never splice two paths.
    """
    n = len(x)
    steps, _ = _steps(model, x, first, True)
    blocks, _ = _block_products(steps, True)
    nb, rows, k, _ = steps.shape
    ins, v = [], enter
    for b in range(nb):
        ins.append(v)
        v = _left(v, blocks[b], True)
    begins, ends = np.empty(nb, int), np.empty(nb, int)
    state = int(v.argmax()) if end is None else end
    for b in range(nb - 1, -1, -1):
        ends[b] = state
        begins[b] = state = int((ins[b] + blocks[b][:, state]).argmax())
    v = np.full((nb, k), -np.inf)
    v[np.arange(nb), begins] = 0.0
    back = np.empty((nb, rows, k), int)
    for t in range(rows):
        through = v[:, :, None] + steps[:, t]
        back[:, t], v = through.argmax(axis=1), through.max(axis=1)
    out, state = np.empty((nb, rows), np.int64), ends
    for t in range(rows - 1, -1, -1):
        out[:, t] = state
        state = back[np.arange(nb), t, state]
    return out.reshape(-1)[:n]


# --- whole tracks side by side (numpy) -----------------------------------------------------------------------------------
# Rows of several tracks stand by frame, within a frame by track, the longest track first: the tracks that still run at a frame
# are the first ``counts[t]`` of those at the frame before. Arrays are (K, rows), so a step works on whole rows of them.
class _Lanes:
    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts, self.lengths = starts, lengths
        self.counts = np.bincount(lengths - 1)[::-1].cumsum()[::-1]
        self.off = np.concatenate([[0], self.counts.cumsum()])

    @cached_property
    def _at(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @cached_property
    def track(self) -> np.ndarray:
        return np.arange(len(self._at)) - self.off[self._at]

    @property
    def rows(self) -> np.ndarray:
        return self.starts[self.track] + self._at

    @property
    def last(self) -> np.ndarray:
        """The row of each track's last frame."""
        return self.off[self.lengths - 1] + np.arange(len(self.lengths))

    def steps(self):
        """Per frame: begin and end of its rows, begin of the rows of the frame before."""
        off = self.off.tolist()
        return zip(off[:-1], off[1:], [0, *off[:-2]])


def _grouped(starts: np.ndarray, lengths: np.ndarray, limit: int | None = None):
    """(numbers of tracks, lanes or None): groups of tracks of similar length; None for tracks that are better run alone."""
    by, lo = np.argsort(-lengths, kind="stable"), 0
    rows = np.concatenate([[0], lengths[by].cumsum()])
    while lo < len(by):
        most = int(np.searchsorted(rows, rows[lo] + (limit or LANE_ROWS), "right")) - 1
        similar = int(np.searchsorted(-lengths[by], -(lengths[by[lo]] // 2), "right"))
        hi = max(lo + 1, min(most, similar))
        part = by[lo:hi]
        yield part, (_Lanes(starts[part], lengths[part]) if hi - lo >= LANES or lengths[part[0]] <= SHORT else None)
        lo = hi


def _ahead(model: HMM, x: np.ndarray, lanes: _Lanes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emissions up to a factor per row, forward vectors that sum to one, and the log of what was taken out of each row."""
    lb = model.emission.log_prob(x).T
    top = lb.max(axis=0)
    b, into = np.exp(lb - top), np.ascontiguousarray(model.trans.T)
    alpha, total = np.empty_like(b), np.empty(len(x))
    for lo, hi, before in lanes.steps():
        v = (into @ alpha[:, before : before + hi - lo] if lo else model.start[:, None]) * b[:, lo:hi]
        total[lo:hi] = sums = v.sum(axis=0)
        np.divide(v, sums, out=alpha[:, lo:hi])
    return b, alpha, np.log(total) + top


def _lane_posterior(model: HMM, x: np.ndarray, lanes: _Lanes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gamma (K, rows), summed xi and the log-likelihood of every track."""
    b, alpha, logs = _ahead(model, x, lanes)
    pair = np.zeros_like(model.trans, dtype=float)
    v = None
    for lo, hi, before in reversed(list(lanes.steps())):
        n = hi - lo
        beta = np.ones((model.states, n))
        if v is not None:
            beta[:, : v.shape[1]] = v
        if lo:
            u = b[:, lo:hi] * beta
            v = model.trans @ u
            past = alpha[:, before : before + n]
            pair += past @ (u / (past * v).sum(axis=0)).T
            v /= v.max(axis=0)
        beta *= alpha[:, lo:hi]
        np.divide(beta, beta.sum(axis=0), out=alpha[:, lo:hi])
    return alpha, model.trans * pair, np.bincount(lanes.track, logs)


def _scratch(name: str, *shape: int, kept={}) -> np.ndarray:  # noqa: B006
    """An array of any content that the worker keeps from one block to the next: fresh ones of this size cost as much as the sums."""
    n = math.prod(shape)
    if len(kept.get(name, ())) < n:
        kept[name] = np.empty(n)
    return kept[name][:n].reshape(shape)


def _products_of(x: np.ndarray) -> np.ndarray:
    """1, the columns (d, rows), and their products by pairs, row after row of the upper triangle."""
    d, n = x.shape
    out, at = _scratch("products", 1 + d + d * (d + 1) // 2, n), 1 + d
    out[0], out[1:at] = 1.0, x
    for i in range(d):
        np.multiply(out[1 + i], out[1 + i : 1 + d], out=out[at : at + d - i])
        at += d - i
    return out


def _pair_columns(at: list[int], d: int) -> np.ndarray:
    """Where ``_products_of`` columns ``at`` stand in those of all d columns."""
    i, j = np.triu_indices(d)
    found = {(a, b): 1 + d + n for n, (a, b) in enumerate(zip(i.tolist(), j.tolist()))}
    return np.array([0, *[1 + a for a in at], *[found[min(at[a], at[b]), max(at[a], at[b])] for a, b in zip(*np.triu_indices(len(at)))]])


def _swept(model: HMM, b: np.ndarray, lanes: _Lanes) -> tuple[np.ndarray, np.ndarray, float] | None:
    """gamma (K, rows), summed xi and log-likelihood from emissions ``b`` up to a factor per row, which it overwrites; None where numbers
    got too small. Forward vectors are scaled every ``SCALE_EVERY`` frames, and backward ones by the same sums, so that their product is gamma."""
    k, n = b.shape
    off, into, trans = lanes.off.tolist(), np.ascontiguousarray(model.trans.T), np.ascontiguousarray(model.trans)
    frames, alpha, beta, sums = len(off) - 1, _scratch("alpha", k, n), _scratch("beta", k, n), []
    for t in range(frames):
        lo, hi = off[t], off[t + 1]
        now, own = alpha[:, lo:hi], b[:, lo:hi]
        if t:
            before = off[t - 1]
            np.matmul(into, alpha[:, before : before + hi - lo], out=now)
            now *= own
        else:
            np.multiply(model.start[:, None], own, out=now)
        if not t % SCALE_EVERY:
            total = np.add.reduce(now, axis=0)
            now /= total
            own /= total
            sums.append(total)
    sums.append(alpha[:, lanes.last].sum(axis=0))
    end, sums = 1.0 / sums[-1], np.concatenate(sums)
    if not sums.min() >= LEAST_SUM:
        return None
    done = 0
    for t in range(frames - 1, -1, -1):
        lo, hi = off[t], off[t + 1]
        if hi - lo > done:
            beta[:, lo + done : hi] = end[done : hi - lo]
        if t:
            own, before = b[:, lo:hi], off[t - 1]
            own *= beta[:, lo:hi]
            np.matmul(trans, own, out=beta[:, before : before + hi - lo])
        done = hi - lo
    # frames that as many tracks reach as the frame before stand as far apart as their predecessors
    pair, since, counts = np.zeros((k, k)), 1, lanes.counts
    for t in [*(np.flatnonzero(counts[1:] != counts[:-1]) + 1).tolist(), frames]:
        if t > since:
            pair += alpha[:, off[since - 1] : off[t - 1]] @ b[:, off[since] : off[t]].T
        if t < frames:
            pair += alpha[:, off[t - 1] : off[t - 1] + int(counts[t])] @ b[:, off[t] : off[t + 1]].T
        since = t + 1
    return np.multiply(alpha, beta, out=alpha), trans * pair, float(np.log(sums).sum())


def _lane_sums(model: HMM, x: np.ndarray, lanes: _Lanes, shared=None) -> np.ndarray:
    """``_track_sums`` of tracks side by side in x (columns, rows). ``shared`` has what ``_shared`` gives."""
    n, k, e = x.shape[1], model.states, model.emission
    coefficients = shared and e.quadratic(shared[0], shared[1]) if hasattr(e, "quadratic") else None
    parts = k if coefficients is None else len(coefficients)
    if coefficients is not None:
        products, columns = shared[2:]
        every = np.zeros((parts, len(products)))
        every[:, columns] = coefficients
    else:
        logs = e.log_prob(x.T).T
    b, ll = _scratch("b", k, n), 0.0
    each = _scratch("each", parts, n) if parts > k else b
    for lo in range(0, n, STRIP):
        strip = slice(lo, lo + STRIP)
        lb = logs[:, strip] if coefficients is None else every @ products[:, strip]
        top = lb.max(axis=0)
        ll += float(top.sum())
        np.exp(lb - top, out=each[:, strip])
        if parts > k:
            each[:, strip].reshape(k, parts // k, -1).sum(axis=1, out=b[:, strip])
    found = _swept(model, b, lanes)
    if found is None:
        return _track_sums(model, x.T, lanes)
    gamma, xi, more = found
    first = gamma[:, : lanes.counts[0]].sum(axis=1)
    if coefficients is None:
        sums = e.sums(x.T, gamma.T)
    else:
        if parts > k:
            for lo in range(0, n, STRIP):
                strip = slice(lo, lo + STRIP)
                own = each[:, strip].reshape(k, parts // k, -1)
                total = own.sum(axis=1)
                own *= np.divide(gamma[:, strip], total, out=np.zeros_like(total), where=total > 0)[:, None]
                each[:, strip] = own.reshape(parts, -1)
            gamma = each
        sums = e.from_products((gamma @ products.T)[:, columns], shared[0])
    out = np.concatenate([[ll + more], first, xi.ravel(), sums])
    return out if np.isfinite(out).all() else _track_sums(model, x.T, lanes)


def _block_sums(models, used, x: np.ndarray, lanes: _Lanes | None) -> list[np.ndarray]:
    """``_track_sums`` for each model of a block of tracks; the products of its columns are computed once."""
    d, shared = len(x), None
    if lanes is not None and d <= SHARED_COLUMNS and any(hasattr(m.emission, "quadratic") for m in models):
        shift = x.mean(axis=1)
        products = _products_of(x - shift[:, None])
        reach = np.maximum(products[1 : 1 + d].max(axis=1), -products[1 : 1 + d].min(axis=1))
        shared = {tuple(at): (shift[at], reach[at], products, _pair_columns(at, d)) for at in used}
    out = []
    for model, at in zip(models, used):
        own = x if at == list(range(d)) else x[at]
        out.append(_track_sums(model, own.T, None) if lanes is None else _lane_sums(model, own, lanes, shared and shared[tuple(at)]))
    return out


def _lane_best(model: HMM, x: np.ndarray, lanes: _Lanes) -> np.ndarray:
    """States of one best path through every track; each step back follows the pointer of the state chosen after it."""
    lb = model.emission.log_prob(x).T
    with np.errstate(divide="ignore"):
        start, trans = np.log(model.start)[:, None], np.log(model.trans)[:, :, None]
    back, ends, v = np.empty(lb.shape, np.int16), np.empty(lanes.counts[0], int), None
    for lo, hi, _ in lanes.steps():
        n = hi - lo
        if v is None:
            v = start + lb[:, lo:hi]
            continue
        ends[n : v.shape[1]] = v[:, n:].argmax(axis=0)
        through = v[:, None, :n] + trans
        back[:, lo:hi] = through.argmax(axis=0)
        v = through.max(axis=0) + lb[:, lo:hi]
    ends[: v.shape[1]] = v.argmax(axis=0)
    out = np.empty(len(x), np.int64)
    for lo, hi, _ in reversed(list(lanes.steps())):
        n = hi - lo
        out[lo:hi] = ends[:n]
        if lo:
            ends[:n] = back[ends[:n], np.arange(lo, hi)]
    return out


def _tracks(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, rows) values of a list column of tracks, first row and rows of each track."""
    flat = values.flatten().to_numpy(zero_copy_only=False)
    lengths = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) // width
    return np.ascontiguousarray(flat.reshape(-1, width).T), np.cumsum(lengths) - lengths, lengths


def _columns(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    return dict(zip(batch.schema.names, batch.columns))


# --- Spark passes --------------------------------------------------------------------------------------------------------
def _key_types(df: DataFrame, keys) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def _values(rows: pd.DataFrame, cols) -> np.ndarray:
    return rows[list(cols)].to_numpy(float)


def chunk_rows(df: DataFrame, cols: list[str], keys=("track_id",), size: int | None = None) -> tuple[DataFrame, bool]:
    """Observations by chunk, rows with a missing feature left out, and whether any track has several chunks: _opens marks the first
    chunk of a track, _whole its only one. Tasks hold about TASK_ROWS rows, whatever the number of rows."""
    c = with_chunk(df, size=size).na.drop("any", subset=[*cols, *keys])
    span = stored(c.groupBy(*keys).agg(F.min("_chunk").alias("_first"), F.max("_chunk").alias("_last"), F.count(F.lit(1)).alias("_n")))  # one row per track
    rows = span.agg(F.sum("_n")).first()[0] or 0
    several = span.where("_first < _last").drop("_n")
    chunked = not several.isEmpty()
    opens = whole = F.lit(True)
    if chunked:
        c = c.join(stored(several), list(keys), "left")
        opens, whole = F.col("_first").isNull() | (F.col("_chunk") == F.col("_first")), F.col("_first").isNull()
    parts = max(-(-rows // TASK_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // 20_000)), 1)
    c = c.select(*keys, "frame", "_chunk", opens.alias("_opens"), whole.alias("_whole"), *cols)
    return c.repartition(parts, *keys, "_chunk"), chunked


def packed(obs: DataFrame, cols: list[str], keys) -> DataFrame:
    """One row per track that fits one chunk: frames and values (row after row) in frame order."""
    rows = F.array_sort(F.collect_list(F.struct("frame", *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])))
    p = obs.where("_whole").groupBy(*keys, "_chunk").agg(rows.alias("_rows")).drop("_chunk")
    values = F.flatten(F.transform("_rows", lambda r: F.array(*[r[f"_x{i}"] for i in range(len(cols))])))
    return p.select(*keys, F.transform("_rows", lambda r: r["frame"]).alias("frames"), values.alias("x"))


def blocks(whole: DataFrame, width: int, limit: int | None = None) -> DataFrame:
    """Tracks of ``packed`` as blocks for ``_block_sums``: values (columns, rows) of tracks side by side, the longest first, and the tracks' lengths;
    or of one track that runs alone."""
    def lay(batches):
        for batch in batches:
            x, starts, lengths = _tracks(batch.column(0), width)
            for part, lanes in _grouped(starts, lengths, limit):
                for own, some in [(x[:, lanes.rows], lengths[part])] if lanes is not None else [(x[:, starts[i] : starts[i] + lengths[i]], lengths[[i]]) for i in part]:
                    yield pa.record_batch({"x": pa.array([np.ascontiguousarray(own).tobytes()], pa.binary()), "lengths": pa.array([some.astype(np.int64).tobytes()], pa.binary()), "alone": pa.array([lanes is None])})

    return whole.select("x").mapInArrow(lay, "x binary, lengths binary, alone boolean")


def _products(obs: DataFrame, cols, model: HMM, keys, best: bool) -> DataFrame:
    def run(key, rows):
        rows = rows.sort_values("frame")
        m = chunk_product(model, _values(rows, cols), bool(rows["_opens"].iloc[0]), best)
        return pd.DataFrame({**dict(zip([*keys, "_chunk"], [[v] for v in key])), "m": [m.ravel()]})
    return obs.groupBy(*keys, "_chunk").applyInPandas(run, f"{_key_types(obs, keys)}, _chunk long, m array<double>")


def _multiply(a: np.ndarray, b: np.ndarray, best: bool) -> np.ndarray:
    s = a[..., :, :, None] + b[..., None, :, :]
    if best:
        return s.max(axis=-2)
    top = s.max(axis=-2, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(s - top).sum(axis=-2)) + top.squeeze(-2)


def _apply(v: np.ndarray, m: np.ndarray, best: bool, left: bool) -> np.ndarray:
    return (_multiply(v[None, :], m, best)[0] if left else _multiply(m, v[:, None], best)[:, 0])


def _mark(state: int, k: int) -> np.ndarray:
    return np.where(np.arange(k) == state, 1.0, 0.0)


def _borders(products: DataFrame, model: HMM, keys, best: bool) -> DataFrame:
    """keys, _chunk, enter, leave (log vectors) and ll, the total of the track.

    Products are first multiplied in groups of GROUP chunks, the group products are walked per track, and each group is
    walked again from its own border vectors, so a task holds GROUP matrices or one matrix per group.
    """
    k, types = model.states, _key_types(products, keys)
    with np.errstate(divide="ignore"):
        start = np.log(model.start)
    keys = list(keys)
    grouped = products.withColumn("_group", F.expr(f"_chunk div {GROUP}"))

    def fold(key, rows):
        total = None
        for m in rows.sort_values("_chunk")["m"]:
            m = np.asarray(m).reshape(k, k)
            total = m if total is None else _multiply(total, m, best)
        return pd.DataFrame({**dict(zip([*keys, "_group"], [[v] for v in key])), "m": [total.ravel()]})

    def walked(ms, enter, leave):
        """Vectors entering and leaving each matrix; for best paths what leaves marks the one state of the path."""
        ins, outs = [enter], [leave]
        for m in ms[:-1]:
            ins.append(_apply(ins[-1], m, best, True))
        for i in range(len(ms) - 1, 0, -1):
            if best:
                outs.append(_mark(int((ins[i] + ms[i][:, int(outs[-1].argmax())]).argmax()), k))
            else:
                outs.append(_apply(outs[-1], ms[i], best, False))
        return ins, outs[::-1]

    def over_groups(key, rows):
        rows = rows.sort_values("_group")
        ms = [np.asarray(m).reshape(k, k) for m in rows["m"]]
        ins, outs = walked(ms, start, np.zeros(k))
        end = _apply(ins[-1], ms[-1], best, True)
        if best:
            outs = walked(ms, start, _mark(int(end.argmax()), k))[1]
        ll = end.max() + (0.0 if best else np.log(np.exp(end - end.max()).sum()))
        return pd.DataFrame({**{c: [v] * len(rows) for c, v in zip(keys, key)}, "_group": rows["_group"].to_numpy(), "g_in": ins, "g_out": outs, "ll": ll})

    def inside(key, rows):
        rows = rows.sort_values("_chunk")
        ms = [np.asarray(m).reshape(k, k) for m in rows["m"]]
        ins, outs = walked(ms, np.asarray(rows["g_in"].iloc[0]), np.asarray(rows["g_out"].iloc[0]))
        # only the proportions matter inside a chunk
        ins, outs = [v - v.max() for v in ins], outs if best else [v - v.max() for v in outs]
        return pd.DataFrame({**{c: [v] * len(rows) for c, v in zip(keys, key)}, "_chunk": rows["_chunk"].to_numpy(), "enter": ins, "leave": outs, "ll": rows["ll"].to_numpy()})

    folded = grouped.groupBy(*keys, "_group").applyInPandas(fold, f"{types}, _group long, m array<double>")
    groups = folded.groupBy(*keys).applyInPandas(over_groups, f"{types}, _group long, g_in array<double>, g_out array<double>, ll double")
    return grouped.join(groups, [*keys, "_group"]).groupBy(*keys, "_group").applyInPandas(
        inside, f"{types}, _chunk long, enter array<double>, leave array<double>, ll double")


def _with_borders(obs, products, model, keys, best):
    return obs.join(_borders(products, model, keys, best), [*keys, "_chunk"])


def _head(model: HMM, first: bool, ll: float, gamma: np.ndarray, xi: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.concatenate([[ll], gamma[0] if first else np.zeros(model.states), xi.ravel(), model.emission.sums(x, gamma)])


def _track_sums(model: HMM, x: np.ndarray, lanes: _Lanes | None) -> np.ndarray:
    if lanes is None:
        gamma, xi, ll = track_posterior(model, x)
        return _head(model, True, ll, gamma, xi, x)
    gamma, xi, ll = _lane_posterior(model, x, lanes)
    return np.concatenate([[ll.sum()], gamma[:, : lanes.counts[0]].sum(axis=1), xi.ravel(), model.emission.sums(x, gamma.T)])


def _expected(obs, laid, chunked: bool, cols, models, used, keys) -> list[np.ndarray]:
    """Sums of one expectation pass for each model; ``used`` has the numbers of its columns."""
    def over_blocks(batches):
        totals = [0.0] * len(models)
        for batch in batches:
            given = _columns(batch)
            for i in range(batch.num_rows):
                x = np.frombuffer(given["x"][i].as_buffer(), np.float64).reshape(len(cols), -1)
                lengths = np.frombuffer(given["lengths"][i].as_buffer(), np.int64)
                lanes = None if given["alone"][i].as_py() else _Lanes(np.cumsum(lengths) - lengths, lengths)
                for m, s in enumerate(_block_sums(models, used, x, lanes)):
                    totals[m] = totals[m] + s
        found = [m for m, t in enumerate(totals) if not np.isscalar(t)]
        yield pa.record_batch({"m": pa.array(found, pa.int32()), "s": pa.array([totals[m] for m in found], pa.list_(pa.float64()))})

    parts = laid.mapInArrow(over_blocks, "m int, s array<double>")
    if chunked:
        many = obs.where("not _whole")
        for m, (model, at) in enumerate(zip(models, used)):
            own = [cols[i] for i in at]

            def run(key, rows, m=m, model=model, own=own):
                return _chunk_sums(rows, m, model, own)
            sums = _with_borders(many, _products(many, own, model, keys, False), model, keys, False)
            parts = parts.unionByName(sums.groupBy(*keys, "_chunk").applyInPandas(_two(run), "m int, s array<double>"))
    # a fixed number of positions per model, whatever the data
    total = parts.select("m", F.posexplode("s").alias("i", "v")).groupBy("m", "i").agg(F.sum("v").alias("v")).collect()
    out = []
    for m in range(len(models)):
        out.append(np.array([v for _, v in sorted((r["i"], r["v"]) for r in total if r["m"] == m)]))
    return out


def _two(run):
    return lambda key, rows: run(key, rows)


def _chunk_sums(rows: pd.DataFrame, m: int, model: HMM, cols) -> pd.DataFrame:
    rows = rows.sort_values("frame")
    x, first = _values(rows, cols), bool(rows["_opens"].iloc[0])
    gamma, xi = chunk_posterior(model, x, first, np.exp(rows["enter"].iloc[0]), np.exp(rows["leave"].iloc[0]))
    return pd.DataFrame({"m": pd.Series([m], dtype="int32"), "s": [_head(model, first, rows["ll"].iloc[0] if first else 0.0, gamma, xi, x)]})


def fit_many(df: DataFrame, cols: list[str], jobs: list[tuple[list[str], HMM]], rounds: int = 100, tol: float = 1e-2, keys=("track_id",),
             fix_start: bool = False, size: int | None = None) -> list[HMM]:
    """Expectation maximisation of several models, each on its own columns, in common passes over the rows.

    A model stops when its log-likelihood gains less than ``tol`` or after ``rounds`` updates. The last value of its trace belongs to the
    parameters returned. Rows with a null in any of ``cols`` are left out for all.
    """
    obs, chunked = chunk_rows(df, cols, keys, size)
    if chunked:
        obs = obs.persist()
    # as many numbers in a block for many states as for eight
    limit = LANE_ROWS * 8 // max(8, *[m.emission.parts for _, m in jobs])
    laid = blocks(packed(obs, cols, keys), len(cols), limit).persist()
    models, used = [m for _, m in jobs], [[cols.index(c) for c in own] for own, _ in jobs]
    traces: list[list[float]] = [[] for _ in jobs]
    live = list(range(len(jobs)))
    for r in range(rounds + 1):
        sums = _expected(obs, laid, chunked, cols, [models[m] for m in live], [used[m] for m in live], keys)
        still = []
        for m, s in zip(live, sums):
            if not len(s):
                continue  # no rows at all
            traces[m].append(float(s[0]))
            if r == rounds or (len(traces[m]) > 1 and traces[m][-1] - traces[m][-2] < tol):
                continue
            k = models[m].states
            xi = np.maximum(s[1 + k:1 + k + k * k].reshape(k, k), 1e-12)
            start = models[m].start if fix_start else s[1:1 + k] / s[1:1 + k].sum()
            models[m] = HMM(start, xi / xi.sum(axis=1, keepdims=True), models[m].emission.updated(s[1 + k + k * k:]))
            still.append(m)
        live = still
        if not live:
            break
    laid.unpersist()
    obs.unpersist()
    for m, t in zip(models, traces):
        m.trace = t
    return models


def fit(df: DataFrame, cols: list[str], model: HMM, rounds: int = 100, tol: float = 1e-2, keys=("track_id",), fix_start: bool = False,
        size: int | None = None) -> HMM:
    """``fit_many`` of one model."""
    return fit_many(df, cols, [(cols, model)], rounds, tol, keys, fix_start, size)[0]


def log_likelihood(df: DataFrame, cols: list[str], model: HMM, keys=("track_id",), size: int | None = None) -> DataFrame:
    """keys, ll: log-likelihood of every track."""
    obs, chunked = chunk_rows(df, cols, keys, size)

    def run(batches):
        for batch in batches:
            x, starts, lengths = _tracks(batch.column(len(keys)), len(cols))
            ll = np.empty(len(starts))
            for part, lanes in _grouped(starts, lengths):
                if lanes is not None:
                    ll[part] = np.bincount(lanes.track, _ahead(model, x[:, lanes.rows].T, lanes)[2])
                    continue
                for i in part:
                    ll[i] = track_posterior(model, x[:, starts[i] : starts[i] + lengths[i]].T)[2]
            yield pa.record_batch({**dict(zip(keys, batch.columns)), "ll": pa.array(ll)})

    out = packed(obs, cols, keys).select(*keys, "x").mapInArrow(run, f"{_key_types(obs, keys)}, ll double")
    if chunked:
        many = obs.where("not _whole")
        b = _borders(_products(many, cols, model, keys, False), model, keys, False)
        out = out.unionByName(b.select(*keys, "ll").distinct())
    return out


def state_counts(df: DataFrame, cols: list[str], jobs: list[tuple[list[str], HMM]], label: str, keys=("track_id",), size: int | None = None) -> DataFrame:
    """m (number of the model), state, size (frames on the best path) and tp (of them with label 1) for several models."""
    obs, chunked = chunk_rows(df, [*cols, label], keys, size)
    whole, used = packed(obs, [*cols, label], keys), [[cols.index(c) for c in own] for own, _ in jobs]

    def run(batches):
        totals = {}
        for batch in batches:
            x, starts, lengths = _tracks(batch.column(0), len(cols) + 1)
            for own, lanes in _cut(x, starts, lengths):
                for m, ((_, model), at) in enumerate(zip(jobs, used)):
                    path = _best(model, own[at].T, lanes)
                    n, tp = totals.get(m, (0, 0.0))
                    totals[m] = n + np.bincount(path, minlength=model.states), tp + np.bincount(path, own[-1], model.states)
        rows = [(m, s, int(n[s]), float(tp[s])) for m, (n, tp) in totals.items() for s in range(len(n))]
        kinds = (("m", pa.int32()), ("state", pa.int64()), ("size", pa.int64()), ("tp", pa.float64()))
        yield pa.record_batch({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds)})

    parts = whole.select("x").mapInArrow(run, "m int, state long, size long, tp double")
    if chunked:
        many = df.join(obs.where("not _whole").select(*keys).distinct(), list(keys), "left_semi")
        for m, (own, model) in enumerate(jobs):
            states = decode(many, own, model, keys=keys, size=size).join(many.select(*keys, "frame", label), [*keys, "frame"])
            parts = parts.unionByName(states.groupBy(F.lit(m).alias("m"), "state").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col(label).cast("double")).alias("tp")))
    return parts.groupBy("m", "state").agg(F.sum("size").alias("size"), F.sum("tp").alias("tp"))


def _cut(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """(values, lanes) of groups of tracks and, with None, of the tracks that run alone."""
    for part, lanes in _grouped(starts, lengths):
        if lanes is not None:
            yield x[:, lanes.rows], lanes
        else:
            yield from ((x[:, starts[i] : starts[i] + lengths[i]], None) for i in part)


def _best(model: HMM, x: np.ndarray, lanes: _Lanes | None) -> np.ndarray:
    if lanes is not None:
        return _lane_best(model, x, lanes)
    with np.errstate(divide="ignore"):
        return chunk_best(model, x, True, np.log(model.start), None)


_OUT = {"best": "state long", "posterior": "state long", "smooth": "smooth array<double>"}


def _read_off(model: HMM, how, gamma: np.ndarray) -> dict[str, np.ndarray]:
    found = {"posterior": lambda: gamma.argmax(axis=1).astype(np.int64), "smooth": lambda: gamma @ model.emission.centers()}
    return {_OUT[h].split()[0]: found[h]() for h in how}


def decode(df: DataFrame, cols: list[str], model: HMM, how: str | tuple[str, ...] = "best", keys=("track_id",), size: int | None = None) -> DataFrame:
    """``state`` per frame: the most likely path ('best') or the most likely state ('posterior'); 'smooth' gives the
    posterior mean of every feature as ``smooth`` instead; ('smooth', 'posterior') gives both from one pass."""
    how = (how,) if isinstance(how, str) else tuple(how)
    obs, chunked = chunk_rows(df, cols, keys, size)
    best = how == ("best",)
    schema = f"{_key_types(obs, keys)}, frame long, {', '.join(_OUT[h] for h in how)}"

    def over_tracks(batches):
        for batch in batches:
            given = _columns(batch)
            x, starts, lengths = _tracks(given["x"], len(cols))
            frames = given["frames"].flatten().to_numpy(zero_copy_only=False)
            for part, lanes in _grouped(starts, lengths):
                for rows, who, run in [(lanes.rows, part[lanes.track], lanes)] if lanes is not None else [(np.arange(starts[i], starts[i] + lengths[i]), np.full(lengths[i], i), None) for i in part]:
                    own = x[:, rows].T
                    if best:
                        got = {"state": _best(model, own, run)}
                    else:
                        got = _read_off(model, how, _lane_posterior(model, own, run)[0].T if run is not None else track_posterior(model, own)[0])
                    who = pa.array(who)
                    out = {**{k: given[k].take(who) for k in keys}, "frame": pa.array(frames[rows])}
                    for name, v in got.items():
                        out[name] = pa.array(v) if v.ndim == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
                    yield pa.record_batch(out)

    out = packed(obs, cols, keys).mapInArrow(over_tracks, schema)
    if not chunked:
        return out
    many = obs.where("not _whole")
    j = _with_borders(many, _products(many, cols, model, keys, best), model, keys, best)

    def run(key, rows):
        rows = rows.sort_values("frame")
        x, first = _values(rows, cols), bool(rows["_opens"].iloc[0])
        enter, leave = np.asarray(rows["enter"].iloc[0]), np.asarray(rows["leave"].iloc[0])
        head = {**{c: [v] * len(rows) for c, v in zip(keys, key)}, "frame": rows["frame"].to_numpy()}
        if best:
            return pd.DataFrame({**head, "state": chunk_best(model, x, first, enter, int(leave.argmax()))})
        gamma, _ = chunk_posterior(model, x, first, np.exp(enter), np.exp(leave))
        return pd.DataFrame({**head, **{name: list(v) if v.ndim > 1 else v for name, v in _read_off(model, how, gamma).items()}})
    return out.unionByName(j.groupBy(*keys, "_chunk").applyInPandas(run, schema))


def parameter_table(spark, model: HMM) -> DataFrame:
    """Model parameters as rows: kind, i, j, value."""
    rows = [("start", i, 0, float(v)) for i, v in enumerate(model.start)]
    rows += [("trans", i, j, float(model.trans[i, j])) for i in range(model.states) for j in range(model.states)]
    c = model.emission.centers()
    rows += [("mean", i, j, float(c[i, j])) for i in range(len(c)) for j in range(c.shape[1])]
    rows += [("trace", i, 0, float(v)) for i, v in enumerate(model.trace)]
    return spark.createDataFrame(rows, "kind string, i int, j int, value double")
