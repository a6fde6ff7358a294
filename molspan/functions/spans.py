"""Half-open intervals as arrays on one line, on which all molecules of a batch lie end to end."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .chain import Steps, clamped

NONE = np.zeros(0, np.int64)


class Spans(NamedTuple):
    start: np.ndarray
    stop: np.ndarray

    def size(self) -> np.ndarray:
        return self.stop - self.start

    def where(self, mask: np.ndarray) -> Spans:
        return Spans(self.start[mask], self.stop[mask])


def merged(spans: Spans, owner: np.ndarray) -> Spans:
    """Unions of touching or overlapping intervals of the same owner (a number that grows along the line)."""
    if not len(spans.start):
        return Spans(NONE, NONE)
    order = np.lexsort((spans.stop, spans.start))
    # owners are told apart by one base of nothing between each two
    a, b = spans.start[order] + owner[order], spans.stop[order] + owner[order]
    far = np.maximum.accumulate(b)
    new = np.concatenate(([True], a[1:] > far[:-1]))
    first = np.flatnonzero(new)
    who = owner[order][first]
    return Spans(a[first] - who, np.maximum.reduceat(b, first) - who)


def gaps(within: Spans, spans: Spans) -> Spans:
    """What sorted intervals without overlaps, each inside one of ``within`` (sorted, without overlaps), leave of them."""
    starts = np.sort(np.concatenate((within.start, spans.stop)), kind="stable")
    stops = np.sort(np.concatenate((spans.start, within.stop)), kind="stable")
    return Spans(starts, stops).where(stops > starts)


def overlaps(spans: Spans, others: Spans) -> np.ndarray:
    """Whether each interval overlaps any of the others."""
    if not len(others.start):
        return np.zeros(len(spans.start), bool)
    order = np.argsort(others.start, kind="stable")
    far = np.maximum.accumulate(others.stop[order])
    n = np.searchsorted(others.start[order], spans.stop, "left")
    return (n > 0) & (far[np.maximum(n - 1, 0)] > spans.start) & (spans.stop > spans.start)


def clipped(spans: Spans, least: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which stay, their starts, whether these moved) of a tiling without overlaps.

    Intervals are taken by start, of equal starts the longest first; each begins where the
    last one that stayed ended (or at its ``floor``), and goes if less than ``least`` is left.
    """
    order = np.lexsort((-spans.stop, spans.start))
    start, stop = spans.start[order], spans.stop[order]
    if floor is not None:
        start = np.maximum(start, floor[order])
    ahead = np.concatenate((start[:1], np.maximum.accumulate(stop)[:-1])) if len(start) else start
    if (start < ahead).any():
        last, begin, fits = -1, start.tolist(), []
        for k, (a, b) in enumerate(zip(begin.copy(), stop.tolist())):
            a = begin[k] = max(a, last)
            fits.append(b - a >= least)
            if fits[-1]:
                last = b
        start, stays = np.array(begin, np.int64), np.array(fits, bool)
    else:
        stays = stop - start >= least
    kept = order[stays]
    return kept, start[stays], start[stays] > spans.start[kept]


class Calls(NamedTuple):
    """Maximal-scoring segments: the space each lies in, and what it is."""

    space: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    llr: np.ndarray
    opps: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def spans(self) -> Spans:
        return Spans(self.start, self.stop)

    def where(self, mask: np.ndarray) -> Calls:
        return Calls(*[x[mask] for x in self])


class Evidence:
    """Steps, hits and opportunities on a line; only the opportunities' steps are held."""

    def __init__(self, step: np.ndarray, hit: np.ndarray, opp: np.ndarray) -> None:
        self.at = np.flatnonzero(opp)
        self.step = step[self.at]
        self.hits = np.flatnonzero(hit)

    def scan(self, spaces: Spans, *, turned: bool = False, min_llr: float, min_opps: int) -> Calls:
        """Calls inside each space. turned: evidence for accessible stretches.

        A running score starts at a step above 0, and is given up where it falls to 0. A call
        goes from where it started to its first highest place, if that has min_llr, and
        min_opps opportunities up to there. left and right: bases to the nearest hit
        outside, within the space.
        """
        begin, end = np.searchsorted(self.at, spaces.start), np.searchsorted(self.at, spaces.stop)
        n = np.maximum(end - begin, 0)
        first = np.cumsum(n) - n
        index = np.repeat(begin - first, n) + np.arange(int(n.sum()))
        step = -self.step[index] if turned else self.step[index]
        score = clamped(step, Steps(n), 0.0, 0.0, np.inf)
        high = score > 0
        edge = np.zeros(len(high), bool)
        edge[first[n > 0]] = True
        begins = high & (edge | ~np.concatenate(([False], high[:-1])))
        start = np.flatnonzero(begins)
        if not len(start):
            return Calls(NONE, NONE, NONE, np.zeros(0), NONE, NONE, NONE)
        inside = np.flatnonzero(high)
        run = np.cumsum(begins)[inside] - 1
        best = np.maximum.reduceat(score[inside], np.searchsorted(inside, start))
        top = np.flatnonzero(score[inside] == best[run])
        peak = inside[top[np.concatenate(([True], run[top][1:] != run[top][:-1]))]]
        opps = peak - start + 1
        kept = (best >= min_llr) & (opps >= min_opps)
        start, peak, best, opps = start[kept], peak[kept], best[kept], opps[kept]
        space = np.repeat(np.arange(len(n)), n)[start]
        a, b = self.at[index[start]], self.at[index[peak]] + 1
        padded = np.concatenate(([-1], self.hits, [np.iinfo(np.int64).max]))
        before = np.maximum(padded[np.searchsorted(self.hits, a)], spaces.start[space] - 1)
        after = np.minimum(padded[np.searchsorted(self.hits, b) + 1], spaces.stop[space])
        return Calls(space, a, b, best, opps, a - before - 1, after - b)


def llr_bytes(llr: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(llr * 10), 0, 255).astype(np.int64)


def edge_bytes(bases: np.ndarray) -> np.ndarray:
    """255 for a sharp edge, 0 from 30 bases on."""
    return np.where(bases <= 0, 255, np.where(bases >= 30, 0, np.rint(255 * (1 - bases / 30)))).astype(np.int64)


class Nucs(NamedTuple):
    start: np.ndarray
    stop: np.ndarray
    nq: np.ndarray
    el: np.ndarray
    er: np.ndarray

    def spans(self) -> Spans:
        return Spans(self.start, self.stop)

    def where(self, mask: np.ndarray) -> Nucs:
        return Nucs(*[x[mask] for x in self])

    def plus(self, other: Nucs) -> Nucs:
        return Nucs(*[np.concatenate(x) for x in zip(self, other)])


def refined(pieces: Spans, evidence: Evidence, least: int, min_llr: float = 2.0, min_opps: int = 2) -> tuple[np.ndarray, Nucs]:
    """(which pieces have one, their protected cores). A piece without evidence is its own core, with bytes 0."""
    large = pieces.size() >= least
    calls = evidence.scan(pieces, min_llr=min_llr, min_opps=min_opps)
    found = np.zeros(len(large), bool)
    start, stop, llr = pieces.start.copy(), pieces.stop.copy(), np.zeros(len(large))
    el, er = np.zeros(len(large), np.int64), np.zeros(len(large), np.int64)
    if len(calls.space):
        # calls are sorted by space and start
        head = np.flatnonzero(np.concatenate(([True], calls.space[1:] != calls.space[:-1])))
        tail = np.concatenate((head[1:], [len(calls.space)])) - 1
        own = calls.space[head]
        found[own] = True
        start[own], stop[own] = calls.start[head], calls.stop[tail]
        llr[own] = np.add.reduceat(calls.llr, head)
        el[own], er[own] = edge_bytes(calls.left[head]), edge_bytes(calls.right[tail])
    kept = large & (stop - start >= least)
    return kept, Nucs(start, stop, np.where(found, llr_bytes(llr), 0), el, er).where(kept)


def recalled(footprints: Spans, evidence: Evidence, *, least: int, repeat: int = 0, min_llr: float = 4.0, min_opps: int = 3) -> tuple[Nucs, Spans]:
    """(nucleosomes, what became accessible) of footprints: cut at accessible runs, then about where linkers are due, then refined."""
    footprints = footprints.where(footprints.stop > footprints.start)
    cuts = evidence.scan(footprints, turned=True, min_llr=min_llr, min_opps=min_opps).spans()
    freed = [cuts]
    pieces = gaps(footprints, cuts)
    if repeat > 0:
        size = pieces.size()
        n = np.rint(size / repeat).astype(np.int64)
        several = np.flatnonzero((size >= int(1.5 * repeat)) & (n >= 2))
        own = np.repeat(several, n[several] - 1)
        i = np.arange(len(own)) - np.repeat(np.cumsum(n[several] - 1) - (n[several] - 1), n[several] - 1) + 1
        centre = pieces.start[own] + np.rint(i * size[own] / n[own]).astype(np.int64)
        windows = Spans(np.maximum(pieces.start[own], centre - 35), np.minimum(pieces.stop[own], centre + 35))
        windows = windows.where(windows.size() >= 2)
        calls = evidence.scan(windows, turned=True, min_llr=1.0, min_opps=1)
        order = np.lexsort((calls.start, -calls.llr, calls.space))
        best = order[np.concatenate(([True], calls.space[order][1:] != calls.space[order][:-1]))] if len(order) else order
        cuts = merged(Spans(calls.start[best], calls.stop[best]), np.zeros(len(best), np.int64))
        freed.append(cuts)
        pieces = gaps(pieces, cuts)
    kept, nucs = refined(pieces, evidence, least)
    freed.append(pieces.where(~kept))
    whole = pieces.where(kept)
    freed += [Spans(whole.start, nucs.start), Spans(nucs.stop, whole.stop)]
    access = Spans(*[np.concatenate(x) for x in zip(*freed)])
    return nucs, access.where(access.stop > access.start)
