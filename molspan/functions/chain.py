"""Two-state hidden Markov model: decoding, posteriors, likelihoods and one step of training."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from molspan.session import map_batches

TINY = 1e-30
#: Symbols that are decoded side by side, and symbols whose posteriors are.
CELLS, POSTERIOR_CELLS = 4 << 20, 1 << 20


@dataclass(frozen=True)
class Model:
    """State 0 is protected, 1 accessible. emission[s][code] is the chance of a symbol."""

    start: tuple[float, float]
    stay: tuple[float, float]
    emission: tuple[tuple[float, ...], tuple[float, ...]]

    def logs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.array([[self.stay[0], 1 - self.stay[0]], [1 - self.stay[1], self.stay[1]]])
        return np.log(np.maximum(self.start, TINY)), np.log(np.maximum(a, TINY)), np.log(np.maximum(np.array(self.emission), TINY))

    def ordered(self) -> Model:
        """The same model with the state of the lower mean chance of a hit (first half of the symbols) as 0."""
        half = len(self.emission[0]) // 2
        if np.mean(self.emission[0][:half]) <= np.mean(self.emission[1][:half]):
            return self
        return Model(self.start[::-1], self.stay[::-1], self.emission[::-1])


class Steps:
    """Sequences of one flat array walked side by side, the longest first, so those at an end drop out of the tail."""

    def __init__(self, length: np.ndarray) -> None:
        self.length = np.asarray(length, np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.order = np.argsort(-self.length, kind="stable")
        self.longest = int(self.length.max(initial=0))
        self.begin = self.first[self.order]
        #: how many sequences have a symbol at step t
        self.active = np.searchsorted(-self.length[self.order], -np.arange(self.longest), "left")


def parts(length: np.ndarray, cells: int) -> Iterator[tuple[int, int]]:
    """Ranges of sequences of about ``cells`` symbols in all; a longer one by itself."""
    if len(length):
        group = (np.cumsum(length) - 1).clip(0) // cells
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(length)]
        yield from zip(edges[:-1], edges[1:])


def clamped(steps: np.ndarray, walk: Steps, first: float, lo: float, hi: float) -> np.ndarray:
    """x[t] = clip(x[t-1], lo, hi) + steps[t] of each sequence, where x[0] = first + steps[0]."""
    out = np.empty_like(steps)
    at = walk.begin.copy()
    x = np.full(len(at), first)
    for t in range(walk.longest):
        m = walk.active[t]
        here, now = at[:m], x[:m]
        if t:
            if lo > -np.inf:
                np.maximum(now, lo, out=now)
            if hi < np.inf:
                np.minimum(now, hi, out=now)
        now += steps[here]
        out[here] = now
        here += 1
    return out


def decode(codes: np.ndarray, length: np.ndarray, model: Model) -> np.ndarray:
    """Most likely states of sequences laid end to end; ties go to state 0.

    The difference d of the two scores is all that a step needs: it is held between
    p = a01 - a11 and q = a00 - a10 and moved by the symbol. Going back, d above q forces 1,
    d up to p forces 0, and between them the state is that of the next symbol. This holds
    for sticky chains (p <= q); others go through decode_any().
    """
    pi, a, e = model.logs()
    p, q = a[0, 1] - a[1, 1], a[0, 0] - a[1, 0]
    if p > q:
        return decode_any(codes, length, model)
    walk = Steps(length)
    moved = (e[1] - e[0])[codes]
    shift = a[1, 1] - a[0, 0]
    if shift:
        moved += shift
    d = clamped(moved, walk, pi[1] - pi[0] - shift, p, q)
    last = (walk.first + walk.length - 1)[walk.length > 0]
    one, forced = d > q, d <= p
    one[last] = d[last] > 0
    forced |= one
    forced[last] = True
    at = np.flatnonzero(forced)
    return np.repeat(one[at].view(np.int8), np.diff(at, prepend=-1))


def decode_any(codes: np.ndarray, length: np.ndarray, model: Model) -> np.ndarray:
    """decode() for any chain, with back-pointers."""
    pi, a, e = model.logs()
    walk = Steps(length)
    came = np.zeros((2, len(codes)), np.int8)
    best = np.zeros((2, len(walk.begin)))
    out = np.zeros(len(codes), np.int8)
    for t in range(walk.longest):
        m = walk.active[t]
        at = walk.begin[:m] + t
        if t:
            # of two equal ways the one from state 0
            from_one = [best[1, :m] + a[1, s] > best[0, :m] + a[0, s] for s in (0, 1)]
            score = [np.where(f, best[1, :m] + a[1, s], best[0, :m] + a[0, s]) for s, f in enumerate(from_one)]
            came[0, at], came[1, at] = from_one
            best[:, :m] = score
        else:
            best[:, :m] = pi[:, None]
        best[:, :m] += e[:, codes[at]]
    state = (best[1] > best[0]).astype(np.int8)
    for t in range(walk.longest - 1, -1, -1):
        m = walk.active[t]
        at = walk.begin[:m] + t
        out[at] = state[:m]
        state[:m] = came[state[:m], at]
    return out


def log_odds(codes: np.ndarray, length: np.ndarray, model: Model) -> np.ndarray:
    """Log odds of state 1 at each symbol, given the whole sequence (forward and backward as two scalars a step)."""
    pi, a, e = model.logs()
    walk = Steps(length)
    moved = (e[1] - e[0])[codes]
    out = np.empty(len(codes))
    x = np.full(len(walk.begin), pi[1] - pi[0])
    for t in range(walk.longest):
        m = walk.active[t]
        at = walk.begin[:m] + t
        if t:
            x[:m] = np.logaddexp(a[0, 1], a[1, 1] + x[:m]) - np.logaddexp(a[0, 0], a[1, 0] + x[:m])
        x[:m] += moved[at]
        out[at] = x[:m]
    x = np.zeros(len(walk.begin))
    for t in range(walk.longest - 2, -1, -1):
        m = walk.active[t + 1]
        at = walk.begin[:m] + t
        ahead = x[:m] + moved[at + 1]
        x[:m] = np.logaddexp(a[1, 0], a[1, 1] + ahead) - np.logaddexp(a[0, 0], a[0, 1] + ahead)
        out[at] += x[:m]
    return out


def accessible_chance(codes: np.ndarray, length: np.ndarray, model: Model) -> np.ndarray:
    """Posterior of state 1 at each symbol, some sequences at a time."""
    out, ends = np.empty(len(codes)), np.concatenate(([0], np.cumsum(length)))
    for i, j in parts(length, POSTERIOR_CELLS):
        a, b = ends[i], ends[j]
        out[a:b] = 1 / (1 + np.exp(np.clip(-log_odds(codes[a:b], length[i:j], model), -700, 700)))
    return out


def forward_backward(codes: np.ndarray, length: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(alpha, beta, log-likelihood, emission logs by step) of a (steps, sequences) array, all in logs, shape (steps, 2, sequences)."""
    pi, a, e = model.logs()
    steps, n = codes.shape
    emit = e[:, codes].transpose(1, 0, 2)
    alpha, beta = np.zeros((steps, 2, n)), np.zeros((steps, 2, n))
    total = np.zeros(n)
    for t in range(steps):
        if t == 0:
            alpha[t] = pi[:, None] + emit[t]
        else:
            alpha[t] = np.logaddexp(alpha[t - 1][0] + a[0][:, None], alpha[t - 1][1] + a[1][:, None]) + emit[t]
        end = t == length - 1
        total[end] = np.logaddexp(alpha[t][0], alpha[t][1])[end]
    for t in range(steps - 2, -1, -1):
        ahead = beta[t + 1] + emit[t + 1]
        value = np.logaddexp(a[:, 0][:, None] + ahead[0], a[:, 1][:, None] + ahead[1])
        beta[t] = np.where(t >= length - 1, 0.0, value)
    return alpha, beta, total, emit


def padded(codes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sequences laid end to end as columns side by side."""
    out = np.zeros((int(length.max(initial=0)), len(length)), np.int64)
    out[np.arange(len(codes)) - np.repeat(np.cumsum(length) - length, length), np.repeat(np.arange(len(length)), length)] = codes
    return out


def score_and_sums(codes: np.ndarray, length: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood of each sequence, sums over all: g0, g1, x00, x01, x10, x11)."""
    _, a, _ = model.logs()
    total, sums = np.zeros(len(length)), np.zeros(6)
    order = np.argsort(length, kind="stable")  # those of like length together, so little is padded
    first = np.cumsum(length) - length
    for i, j in parts(length[order], POSTERIOR_CELLS):
        some = order[i:j]
        some = some[length[some] > 0]
        if not len(some):
            continue
        n = length[some]
        flat = codes[np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        alpha, beta, score, emit = forward_backward(padded(flat, n), n, model)
        total[some] = score
        inside = np.arange(1, len(alpha))[:, None] < n
        sums[:2] += np.exp(alpha[0] + beta[0] - score).sum(1)
        if len(alpha) > 1:
            sums[2:] += [float((np.exp(alpha[:-1, s] + a[s, r] + emit[1:, r] + beta[1:, r] - score) * inside).sum()) for s in (0, 1) for r in (0, 1)]
    return total, sums


def flat_lists(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of lists laid end to end, and the lists' lengths; null counts as empty."""
    return np.asarray(lists.flatten()), np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)


def to_lists(values: np.ndarray, length: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.array(values, kind))


def run_chain(reads: DataFrame, model: Model, *, want: str, id_col: str = "read_id", codes_col: str = "codes") -> DataFrame:
    """Applies the model to rows (id, codes array<int>), a batch of sequences at a time.

    want: "states" (array<tinyint>), "posterior" (array<double>, of state 1), "confidence"
    (states, and the posterior of each: array<double>), "score" (double), or "statistics":
    (g0, g1, x00, x01, x10, x11, score) summed over a batch. What is held at once is bounded
    by CELLS and POSTERIOR_CELLS symbols, and by the longest sequence.
    """
    kind = dict(reads.dtypes)[id_col]
    made = {"states": f"`{id_col}` {kind}, states array<tinyint>", "posterior": f"`{id_col}` {kind}, posterior array<double>", "confidence": f"`{id_col}` {kind}, states array<tinyint>, confidence array<double>", "score": f"`{id_col}` {kind}, score double", "statistics": "g0 double, g1 double, x00 double, x01 double, x10 double, x11 double, score double"}[want]
    names = [x.strip().split()[0].strip("`") for x in made.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            every = np.asarray(pc.fill_null(pc.list_value_length(whole.column(1)), 0), np.int64)
            for i, j in parts(every, CELLS):
                batch = whole.slice(i, j - i)
                codes, length = flat_lists(batch.column(1))
                out = [batch.column(0)]
                if want in ("states", "confidence"):
                    states = decode(codes, length, model)
                    out.append(to_lists(states, length, pa.int8()))
                if want in ("posterior", "confidence"):
                    p = accessible_chance(codes, length, model)
                    out.append(to_lists(p if want == "posterior" else np.where(states == 1, p, 1 - p), length, pa.float64()))
                if want in ("score", "statistics"):
                    total, sums = score_and_sums(codes, length, model)
                    out = [*out, pa.array(total)] if want == "score" else [pa.array([float(x)]) for x in (*sums, total.sum())]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return map_batches(reads.select(id_col, codes_col), run, made)


def train_step(reads: DataFrame, model: Model, **columns: str) -> tuple[Model, float]:
    """Start and transition chances after one step of expectation and maximisation; emissions stay."""
    from pyspark.sql import functions as F

    found = run_chain(reads, model, want="statistics", **columns)
    r = found.agg(*[F.sum(c).alias(c) for c in found.columns]).first()
    if r["score"] is None:
        return model, 0.0
    floor = 1e-10
    g0, g1 = max(r["g0"], floor), max(r["g1"], floor)
    x = {k: max(r[k], floor) for k in ("x00", "x01", "x10", "x11")}
    return Model((g0 / (g0 + g1), g1 / (g0 + g1)), (x["x00"] / (x["x00"] + x["x01"]), x["x11"] / (x["x10"] + x["x11"])), model.emission), r["score"]


def fitted(reads: DataFrame, model: Model, *, rounds: int = 1000, least: float = 1e-4, **columns: str) -> tuple[Model, float]:
    """Steps until the likelihood rises by less than ``least``: the model, and the likelihood of the last one looked at."""
    before = None
    for _ in range(rounds):
        new, score = train_step(reads, model, **columns)
        if before is not None and score - before < least:
            return model.ordered(), score
        model, before = new, score
    return model.ordered(), before or 0.0


def train(reads: DataFrame, model: Model, **options) -> Model:
    """The model of ``fitted``."""
    return fitted(reads, model, **options)[0]


def train_best(reads: DataFrame, model: Model, *, restarts: int = 10, **options) -> tuple[Model, float]:
    """The likeliest of ``restarts`` trainings from random start and transition chances; attempt i is seeded by i.

    Every step reads ``reads`` anew, so write it to a table first. Emissions stay as in ``model``.
    """
    best = None
    for i in range(restarts):
        rng = np.random.default_rng(i)
        start, *rows = (rng.dirichlet((1.0, 1.0)) for _ in range(3))
        found = fitted(reads, Model((float(start[0]), float(start[1])), (float(rows[0][0]), float(rows[1][1])), model.emission), **options)
        if best is None or found[1] > best[1]:
            best = found
    if best is None:
        raise ValueError("at least one attempt is needed")
    return best
