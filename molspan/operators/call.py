"""The fused plan: symbols, chain, nucleosomes, accessible patches, binding calls and tags, a batch of molecules at a time.

Nothing is shuffled: each Arrow batch is worked on as one line of bases, with numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molspan.functions.chain import Model, accessible_chance, decode, flat_lists
from molspan.functions.encoding import NUMBER, ambiguous, mark_mask, n_symbols, observe, resolved
from molspan.functions.marks import bytes_of, conversion, is_chimera, kept_places, numbers, read_changes, schema_fields, upper
from molspan.functions.spans import NONE, Calls, Evidence, Nucs, Spans, clipped, edge_bytes, gaps, llr_bytes, merged, overlaps, recalled, refined
from molspan.session import map_batches

from .recall import Profile, placed_nucs

#: Bases that are worked on at once (a longer molecule by itself).
BASES = 4 << 20
# Binding calls' least score by enzyme.
MIN_LLR = {"hia5": 5.0, "dddb": 4.0, "ddda": 5.0}
#: Where marks of deaminase data are taken from; the first that a read has decides.
SOURCES = ("ambiguity", "md", "mm")

CALL = "array<struct<start:int,n:int,llr:double,opps:int,q:int,el:int,er:int>>"
OUTPUT = f"ns array<int>, nl array<int>, nq array<int>, `as` array<int>, al array<int>, aq array<int>, ma string, ma_aq array<int>, an string, tf {CALL}, skip_reason string, error string"


@dataclass(frozen=True)
class Options:
    """How molecules are called. repeat: the nucleosome repeat length that long fragments are cut by, 0 for not at all."""

    mode: str = "pacbio-fiber"
    k: int = 3
    trim: int = 10
    threshold: int = 128
    nuc_min: int = 85
    msp_min: int = 0
    recall: bool = True
    bind: bool = True
    min_llr: float = 5.0
    min_opps: int = 3
    unify: int = 90
    split_llr: float = 4.0
    split_opps: int = 3
    repeat: int = 0
    profile: Profile | None = None
    scores: bool = False
    circular: bool = False
    compat: bool = False
    min_mapq: int = 0
    min_length: int = 1000
    primary_only: bool = False
    unmapped: bool = True
    drop_chimeras: bool = True
    sources: tuple[str, ...] = SOURCES
    codes: str | None = None
    #: take footprints and patches from the tags ns, nl, as and al instead of the chain
    tagged: bool = False
    #: whether those tags are in the direction the molecule was read, or as the sequence is stored
    molecular: bool = True


# Kernels on a line


def observed_reads(columns: dict[str, list], options: Options) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[str], list[bool]]:
    """(upper-case bytes end to end, lengths, mark positions, strands, whether a chimera) of a batch's reads."""
    raw, length = bytes_of(pa.array(columns["seq"], pa.string()))
    data = upper(raw)
    ends = np.cumsum(length)
    found, strands, chimeras = [], [], []
    for i, (a, b) in enumerate(zip((ends - length).tolist(), ends.tolist())):
        seq, at, strand, mixed = data[a:b], NONE, ".", False
        reverse = bool(columns["is_reverse"][i])
        ml = columns["ml"][i]
        if options.mode != "daf":
            at = kept_places(columns["mm"][i], ml, seq, reverse, options.threshold, options.mode, options.codes)
        else:
            for source in options.sources:
                if source == "ambiguity" and ((seq == 82) | (seq == 89)).any():
                    at, strand = ambiguous(seq, columns["st"][i])
                    break
                ops = columns["cigar"][i]
                if source == "md" and ops is not None and (columns["md"][i] is not None or columns["ref_seq"][i] is not None):
                    changes = read_changes(seq, [(x["op"], x["n"]) for x in ops], columns["md"][i], columns["ref_seq"][i])
                    way = None if changes is None else conversion(len(changes[0]), len(changes[1]))
                    if way:
                        mixed = is_chimera(*changes)
                        at, strand = (changes[0], "+") if way == "CT" else (changes[1], "-")
                        break
                if source == "mm" and columns["mm"][i] and ml is not None:
                    at = kept_places(columns["mm"][i], ml, seq, reverse, options.threshold, "daf", options.codes)
                    t, a_ = int((seq[at] == 84).sum()), int((seq[at] == 65).sum())
                    strand = "+" if t > a_ else "-" if a_ > t else "."
                    break
        found.append(at)
        strands.append(strand)
        chimeras.append(mixed)
    return resolved(data), length, found, strands, chimeras


@dataclass
class Structure:
    """Footprints and accessible patches of a line's molecules, and the evidence they come from."""

    first: np.ndarray
    length: np.ndarray
    evidence: Evidence
    footprints: Spans
    msps: Spans
    footprint_score: np.ndarray | None = None
    msp_score: np.ndarray | None = None
    footprint_q: np.ndarray | None = None

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first + self.length, at, "right")

    def molecules(self) -> Spans:
        return Spans(self.first, self.first + self.length).where(self.length > 0)


def state_runs(states: np.ndarray, length: np.ndarray) -> Spans:
    """Runs of state 0; none goes from one molecule into the next."""
    edge = np.zeros(len(states) + 1, bool)
    edge[np.cumsum(length)] = True
    edge[0] = True
    zero = states == 0
    before = np.concatenate(([False], zero[:-1]))
    start = np.flatnonzero(zero & (~before | edge[:-1]))
    after = np.concatenate((zero[1:], [False]))
    return Spans(start, np.flatnonzero(zero & (~after | edge[1:])) + 1)


def structure(codes: np.ndarray, length: np.ndarray, model: Model, ratios: tuple[np.ndarray, np.ndarray, np.ndarray], options: Options) -> Structure:
    """The apply stage: chain, footprints (every run of state 0), patches between those of nucleosome size.

    ratios: for each symbol its step, whether it is a hit, and whether it is a target. The
    score of a footprint is the mean posterior of its state, that of a patch the mean of one
    minus that of the predicted state.
    """
    states = decode(codes, length, model)
    footprints = state_runs(states, length)
    first = np.cumsum(length) - length
    step, hit, opp = ratios
    asked = codes if options.recall or options.bind else codes[:0]
    found = Structure(first, length, Evidence(step[asked], hit[asked], opp[asked]), footprints, Spans(NONE, NONE))
    found.msps = gaps(found.molecules(), footprints.where(footprints.size() >= options.nuc_min))
    found.msps = found.msps.where(found.msps.size() >= options.msp_min)
    if options.scores:
        p = accessible_chance(codes, length, model)
        sums = np.concatenate(([0.0], np.cumsum(np.where(states == 1, p, 1 - p))))
        mean = lambda s: (sums[s.stop] - sums[s.start]) / np.maximum(s.size(), 1)
        found.footprint_score, found.msp_score = mean(footprints), 1 - mean(found.msps)
    return found


def tagged_structure(columns: dict[str, list], length: np.ndarray, codes: np.ndarray, ratios: tuple[np.ndarray, np.ndarray, np.ndarray], options: Options) -> Structure:
    """structure() of what the reads' tags say; intervals that leave the read are cut to it, empty ones go."""
    step, hit, opp = ratios
    first = np.cumsum(length) - length
    found: dict[str, list[tuple[int, int, int]]] = {"ns": [], "as": []}
    quality = []
    for i, (a, n) in enumerate(zip(first.tolist(), length.tolist())):
        turn = options.molecular and bool(columns["is_reverse"][i])
        for start, size, q in (("ns", "nl", "nq"), ("as", "al", "aq")):
            values = columns[q][i] or []
            rows = []
            for j, (s, m) in enumerate(zip(columns[start][i] or [], columns[size][i] or [])):
                s = n - s - m if turn else s
                lo, hi = max(s, 0), min(s + m, n)
                if hi > lo:
                    rows.append((a + lo, a + hi, values[j] if j < len(values) else 0))
            found[start] += sorted(rows)
        quality.append(columns["nq"][i] is not None)
    nucs, msps = (np.array(found[k], np.int64).reshape(-1, 3) for k in ("ns", "as"))
    out = Structure(first, length, Evidence(step[codes], hit[codes], opp[codes]), Spans(nucs[:, 0], nucs[:, 1]), Spans(msps[:, 0], msps[:, 1]))
    out.footprint_q = nucs[:, 2] if any(quality) else None
    return out


@dataclass
class Called:
    """Nucleosomes, patches and binding calls on a line; nq of the nucleosomes is None where nothing scored them."""

    nucs: Nucs
    scored: bool
    edged: bool
    msps: Spans
    msp_q: np.ndarray | None
    bound: Calls


def unit_bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(x * 255, 0, 255).astype(np.int64)


def fuse(s: Structure, options: Options) -> Called:
    """Binding calls and, with ``recall``, nucleosomes with refined edges, tiled without overlaps."""
    none = Calls(NONE, NONE, NONE, np.zeros(0), NONE, NONE, NONE)
    plain = s.footprints
    q = s.footprint_q if s.footprint_q is not None else unit_bytes(s.footprint_score) if s.footprint_score is not None else np.zeros(len(plain.start), np.int64)
    zero = np.zeros(len(plain.start), np.int64)
    nucs, msps = Nucs(plain.start, plain.stop, q, zero, zero), s.msps
    if options.recall:
        if options.profile is not None:
            nucs, access = radial(s, options)
        else:
            nucs, access = recalled(plain, s.evidence, least=options.nuc_min, repeat=options.repeat, min_llr=options.split_llr, min_opps=options.split_opps)
        both = Spans(np.concatenate((msps.start, access.start)), np.concatenate((msps.stop, access.stop)))
        msps = merged(both, s.owner(both.start))
        msps = msps.where(msps.size() >= max(1, options.msp_min))
    bound = none
    if options.bind:
        few = nucs.spans().where(nucs.spans().size() < options.unify)
        spaces = Spans(np.concatenate((msps.start, few.start)), np.concatenate((msps.stop, few.stop)))
        spaces = spaces.where(spaces.size() > 0)
        bound = s.evidence.scan(merged(spaces, s.owner(spaces.start)), min_llr=options.min_llr, min_opps=options.min_opps)
    if options.recall:
        large = np.flatnonzero(bound.stop - bound.start >= options.unify)
        kept, promoted = refined(Spans(bound.start[large], bound.stop[large]), s.evidence, options.nuc_min)
        stay = np.ones(len(bound.start), bool)
        stay[large[kept]] = False
        bound = bound.where(stay)
        short = nucs.spans().size() < options.unify
        nucs = nucs.where(~(short & overlaps(nucs.spans(), promoted.spans()))).plus(promoted)
    short = nucs.spans().size() < options.unify
    nucs = nucs.where(~(short & overlaps(nucs.spans(), bound.spans())))
    if not options.recall:
        return Called(nucs, options.scores or s.footprint_q is not None, False, msps, None if s.msp_score is None else unit_bytes(s.msp_score), bound)
    if options.circular:  # tiled on the circle, once projected
        return Called(nucs, True, True, msps, None, bound)
    return Called(*tiled(s, nucs, options), None, bound)


def tiled(s: Structure, nucs: Nucs, options: Options) -> tuple[Nucs, bool, bool, Spans]:
    """Nucleosomes without overlaps, and the patches that they leave of what was analysed of each molecule."""
    lo, hi = s.first.copy(), s.first + s.length
    every = [s.footprints, s.msps, nucs.spans()]
    start, stop = np.concatenate([x.start for x in every]), np.concatenate([x.stop for x in every])
    own = s.owner(start)
    some = np.unique(own)
    lo[some] = np.iinfo(np.int64).max
    hi[some] = 0
    np.minimum.at(lo, own, start)
    np.maximum.at(hi, own, stop)
    kept, begin, moved = clipped(nucs.spans(), max(1, options.nuc_min), lo[s.owner(nucs.start)])
    nucs = nucs.where(kept)._replace(start=begin)
    nucs = nucs._replace(el=np.where(moved, 0, nucs.el))
    left = gaps(Spans(lo, hi).where(hi > lo), nucs.spans())
    return nucs, True, True, left.where(left.size() >= max(1, options.msp_min))


def radial(s: Structure, options: Options) -> tuple[Nucs, Spans]:
    """recalled() by the radial template, a molecule at a time."""
    rows, kept, access = [], [], []
    hit, opp = np.zeros(int(s.length.sum())), np.zeros(int(s.length.sum()))
    hit[s.evidence.hits] = 1
    opp[s.evidence.at] = 1
    own = s.owner(s.footprints.start)
    for i in np.unique(own).tolist():
        a, b = int(s.first[i]), int(s.first[i] + s.length[i])
        spans = [(int(x) - a, int(y) - a) for x, y in zip(s.footprints.start[own == i], s.footprints.stop[own == i])]
        rows += [(x + a, y + a, *rest) for x, y, *rest in placed_nucs(hit[a:b], opp[a:b], spans, options.profile, options.nuc_min)]
    start, stop, llr, left, right = (np.array(x) for x in zip(*rows)) if rows else (NONE,) * 5
    nucs = Nucs(start.astype(np.int64), stop.astype(np.int64), llr_bytes(np.asarray(llr, float)), edge_bytes(left), edge_bytes(right))
    kept, begin, _ = clipped(nucs.spans(), 1)
    held = Spans(np.maximum(begin, 0), nucs.stop[kept])
    # a core may reach beyond its footprint; only what is inside takes from it
    k = np.searchsorted(s.footprints.start, held.start, "right") - 1
    inside = Spans(held.start, np.minimum(held.stop, s.footprints.stop[np.maximum(k, 0)])) if len(held.start) else held
    inside = inside.where((k >= 0) & (inside.stop > inside.start)) if len(held.start) else inside
    return nucs, gaps(s.footprints, inside)


# Tags


def pieces(start: int, n: int, length: int) -> list[tuple[int, int]]:
    """Linear pieces of an interval on a circle: the one at the circle's start first."""
    if n <= 0 or length <= 0:
        return []
    if n >= length:
        return [(0, length)]
    start %= length
    return [(start, n)] if start + n <= length else [(0, start + n - length), (start, length - start)]


def molecular(rows: list[tuple], length: int, reverse: bool) -> list[tuple]:
    """(start, n, bytes) rows in the direction the molecule was read, by start; of three bytes the last two change places."""
    if reverse:
        rows = [(length - s - n, n, (q[0], q[2], q[1]) if len(q) == 3 else q) for s, n, q in rows]
    return sorted(rows)


def tags(length: int, reverse: bool, nucs: list[tuple], msps: list[tuple], bound: list[tuple], *, scored: bool, edged: bool, compat: bool = False) -> dict[str, object]:
    """The annotation tags of one molecule: ns, nl, nq, as, al, ma, ma_aq and an.

    nucs, bound: (start, n, (q, el, er)), msps: (start, n, ()), as the sequence is stored; an
    interval may go over the end of a circle. ma names nucleosomes with one byte of quality,
    or three if their edges were refined (edged), patches with none and binding calls with
    three; an names annotations if any of them is in two pieces. compat: no ma, and binding
    calls stand among ns and nl. nq only if nucleosomes were scored.
    """
    nucs = nucs if edged else [(s, n, q[:1]) for s, n, q in nucs]
    kinds = {k: molecular(rows, length, reverse) for k, rows in (("nuc", nucs), ("msp", msps), ("tf", bound))}
    parts, names, quality, split = {}, [], [], False
    for kind, rows in kinds.items():
        parts[kind] = []
        for i, (s, n, q) in enumerate(rows):
            some = pieces(s, n, length)
            split |= len(some) > 1
            for piece in some:
                parts[kind].append((*piece, q))
                names.append(f"fh{'w' if len(some) > 1 else ''}_{kind}_{i}")
                quality += q
    out: dict[str, object] = {"ma": None, "ma_aq": None, "an": None}
    if not compat and names:
        heads = {"nuc": "nuc.QQQ" if edged else "nuc.Q", "msp": "msp.", "tf": "tf.QQQ"}
        out["ma"] = ";".join([str(length)] + [f"{heads[k]}:" + ",".join(f"{s + 1}-{n}" for s, n, _ in rows) for k, rows in parts.items() if rows])
        out["an"] = ",".join(names) if split else None
        out["ma_aq"] = quality if parts["nuc"] or parts["tf"] else None
    legacy = sorted([(s, n, q[0]) for s, n, q in parts["nuc"]] + ([(s, n, 0) for s, n, _ in parts["tf"]] if compat else []))
    lone = sorted((s, n) for s, n, _ in parts["msp"])
    out |= {"ns": [s for s, _, _ in legacy], "nl": [n for _, n, _ in legacy], "as": [s for s, _ in lone], "al": [n for _, n in lone]}
    out["nq"] = [q for _, _, q in legacy] if scored and legacy and not compat else None
    return out


# Circles


def projected(start: int, stop: int, length: int) -> tuple[int, int] | None:
    """(start, n) on the circle of an interval on three copies of it; None if it isn't the middle copy's."""
    if stop > start and length <= start < 2 * length:
        return start - length, min(stop - start, length)
    return (0, length) if start < length and stop > 2 * length else None


def on_circle(rows: list[tuple], length: int) -> list[tuple]:
    """Rows (start, stop, …) on three copies, as (start, n, …) on the circle, each interval once."""
    out: dict[tuple, tuple] = {}
    for start, stop, *rest in rows:
        if at := projected(start, stop, length):
            out.setdefault(at, (*at, *rest))
    return list(out.values())


def circles_overlap(a: tuple, b: tuple, length: int) -> bool:
    return any(x < y + m and y < x + n for x, n in pieces(a[0], a[1], length) for y, m in pieces(b[0], b[1], length))


def tiled_circle(nucs: list[tuple], length: int, options: Options) -> tuple[list[tuple], list[tuple]]:
    """(nucleosomes without overlaps, patches between them) on a circle, opened at its first uncovered base."""
    least, floor = max(1, options.nuc_min), max(1, options.msp_min)
    whole = [(0, length, ())] if length >= floor else []
    if not nucs:
        return [], whole
    around = next((x for x in nucs if x[1] >= length), None)
    if around is not None:
        return ([(0, length, around[2])], []) if length >= least else ([], whole)
    covered = np.zeros(length, bool)
    for s, n, _ in nucs:
        covered[np.arange(s, s + n) % length] = True
    cut = 0 if covered.all() else int((~covered).argmax())
    line = []
    for s, n, (q, el, er) in nucs:
        at = (s - cut) % length
        line += [(at, at + n, (q, el, er))] if at + n <= length else [(at, length, (q, el, 0)), (0, at + n - length, (q, 0, er))]
    kept, begin, moved = clipped(Spans(np.array([x[0] for x in line]), np.array([x[1] for x in line])), least)
    out = [(int(a), line[k][1], (line[k][2][0], 0 if m else line[k][2][1], line[k][2][2])) for k, a, m in zip(kept.tolist(), begin.tolist(), moved.tolist())]
    left = gaps(Spans(np.array([0]), np.array([length])), Spans(np.array([a for a, _, _ in out], np.int64), np.array([b for _, b, _ in out], np.int64)))
    return sorted(((a + cut) % length, b - a, q) for a, b, q in out), sorted(((int(a) + cut) % length, int(b - a), ()) for a, b in zip(*left) if b - a >= floor)


# The operator


def symbol_ratios(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol: log odds of protected against accessible (0 for no target), whether it is a hit, and a target."""
    e = np.log(np.maximum(np.array(model.emission), 1e-30))
    top = e.shape[1] // 2 - 1
    code = np.arange(e.shape[1])
    hit, opp = code < top, (code < top) | (code > top) & (code < 2 * top + 1)
    return np.where(opp, e[0] - e[1], 0.0), hit, opp


def check_symbols(model: Model, k: int) -> None:
    if len(model.emission[0]) != n_symbols(k):
        raise ValueError(f"the model has {len(model.emission[0])} symbols; contexts of {k} bases on both sides need {n_symbols(k)}")


def call_batch(columns: dict[str, list], reasons: list[str | None], model: Model, second: Model, options: Options) -> list[dict[str, object]] | dict[str, pa.Array]:
    """OUTPUT of each read, as columns or as one dictionary a read; those with a reason have nothing else."""
    out: list[dict[str, object]] = [{"skip_reason": r} for r in reasons]
    some = [i for i, r in enumerate(reasons) if r is None]
    chosen = {name: [values[i] for i in some] for name, values in columns.items()}
    data, length, marks, strands, chimeras = observed_reads(chosen, options)
    if options.drop_chimeras and any(chimeras):
        for i, mixed in zip(some, chimeras):
            if mixed:
                out[i]["skip_reason"] = reasons[i] = "chimera"
        return call_batch(columns, reasons, model, second, options)
    if options.circular:
        ends = np.cumsum(length)
        data = np.concatenate([np.tile(data[a:b], 3) for a, b in zip(ends - length, ends)]) if len(length) else data
        marks = [np.concatenate((m, m + n, m + 2 * n)) for m, n in zip(marks, length.tolist())]
        length = 3 * length
    reverse = np.array([bool(x) for x in chosen["is_reverse"]], bool)
    codes = observe(NUMBER[data], length, mark_mask(length, marks), mode=options.mode, k=options.k, trim=options.trim, reverse=reverse, strand=strands)
    if options.tagged:
        s = tagged_structure(chosen, length, codes, symbol_ratios(second), options)
    else:
        s = structure(codes, length, model, symbol_ratios(second), options)
    found = fuse(s, options)
    if not options.circular and not options.tagged:
        where = pa.array([None if r is not None else k for r, k in zip(reasons, np.cumsum([r is None for r in reasons]).tolist())], pa.int64())
        at = pc.subtract(where, 1)
        return {name: values.take(at) for name, values in line_columns(s, found, reverse, options).items()} | {"skip_reason": pa.array(reasons, pa.string())}
    rows = by_molecule(s, found)
    if options.tagged:  # a read without marks stays as it is
        some = [i if len(m) else -1 for i, m in zip(some, marks)]
    for i, n, r, (nucs, msps, bound) in zip(some, length.tolist(), reverse.tolist(), rows):
        if i < 0:
            continue
        if options.circular:
            n //= 3
            nucs, msps, bound = (on_circle(x, n) for x in (nucs, msps, bound))
            if options.recall:
                nucs = [x for x in nucs if x[1] >= options.unify or not any(circles_overlap(x, y, n) for y in bound)]
                nucs, msps = tiled_circle([x[:3] for x in nucs], n, options)
        else:
            nucs, msps, bound = ([(a, b - a, *rest) for a, b, *rest in x] for x in (nucs, msps, bound))
        calls = [{"start": a, "n": m, "llr": llr, "opps": opps, "q": q[0], "el": q[1], "er": q[2]} for a, m, q, llr, opps in bound]
        made = tags(n, r, [x[:3] for x in nucs], [(a, m, ()) for a, m, *_ in msps], [x[:3] for x in bound], scored=found.scored, edged=found.edged, compat=options.compat)
        made["aq"] = None
        if found.msp_q is not None and not options.compat:
            legacy = sorted((*p, x[2][0]) for x in molecular([(a, m, q) for a, m, q in msps], n, r) for p in pieces(x[0], x[1], n))
            made["aq"] = [q for _, _, q in legacy]
        out[i] |= made | {"tf": calls, "skip_reason": None}
    if options.tagged:
        for i, r in enumerate(out):
            if "tf" not in r:
                r |= {t: columns[t][i] for t in GIVEN} | {"skip_reason": r["skip_reason"] or "no_marks"}
    return out


def line_columns(s: Structure, found: Called, reverse: np.ndarray, options: Options) -> dict[str, pa.Array]:
    """The tags and calls of every molecule of a line as columns: tags() for all at once, where no interval goes over an end."""
    n_mol = len(s.length)

    def placed(spans: Spans, *quality: np.ndarray) -> tuple[np.ndarray, ...]:
        """(molecule, start, n, *quality) in the direction the molecules were read, by start."""
        own = s.owner(spans.start)
        n = spans.size()
        at = spans.start - s.first[own]
        at = np.where(reverse[own], s.length[own] - at - n, at)
        order = np.lexsort((n, at, own))
        return tuple(x[order] for x in (own, at, n, *quality))

    def lists(own: np.ndarray, values: pa.Array, null: np.ndarray | None = None) -> pa.ListArray:
        ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(own, minlength=n_mol)))).astype(np.int32))
        return pa.ListArray.from_arrays(ends, values, mask=None if null is None else pa.array(null))

    nucs, bound = found.nucs, found.bound
    turned = reverse[s.owner(nucs.start)]
    el, er = np.where(turned, nucs.er, nucs.el), np.where(turned, nucs.el, nucs.er)
    nuc = placed(nucs.spans(), nucs.nq, el, er)
    msp = placed(found.msps, *([] if found.msp_q is None else [found.msp_q]))
    q, left, right = llr_bytes(bound.llr), edge_bytes(bound.left), edge_bytes(bound.right)
    turned = reverse[s.owner(bound.start)]
    tf = placed(bound.spans(), q, np.where(turned, right, left), np.where(turned, left, right))
    int32 = lambda x: pa.array(x, pa.int32())
    legacy = nuc[:3]
    if options.compat:
        both = [np.concatenate(x) for x in zip(nuc[:3], tf[:3])]
        order = np.lexsort((both[2], both[1], both[0]))
        legacy = tuple(x[order] for x in both)
    out: dict[str, pa.Array] = {"ns": lists(legacy[0], int32(legacy[1])), "nl": lists(legacy[0], int32(legacy[2])), "as": lists(msp[0], int32(msp[1])), "al": lists(msp[0], int32(msp[2]))}
    per = {k: np.bincount(x[0], minlength=n_mol) for k, x in (("nuc", nuc), ("msp", msp), ("tf", tf))}
    if found.scored and not options.compat:
        out["nq"] = lists(nuc[0], int32(nuc[3]), per["nuc"] == 0)
    if found.msp_q is not None and not options.compat:
        out["aq"] = lists(msp[0], int32(msp[3]))
    if not options.compat:
        heads = {"nuc": ";nuc.QQQ:" if found.edged else ";nuc.Q:", "msp": ";msp.:", "tf": ";tf.QQQ:"}
        texts = {k: ([f"{a}-{b}" for a, b in zip((x[1] + 1).tolist(), x[2].tolist())], np.concatenate(([0], np.cumsum(per[k]))).tolist()) for k, x in (("nuc", nuc), ("msp", msp), ("tf", tf))}
        ma = []
        for i, n in enumerate(s.length.tolist()):
            text = "".join(heads[k] + ",".join(tokens[ends[i] : ends[i + 1]]) for k, (tokens, ends) in texts.items() if ends[i + 1] > ends[i])
            ma.append(f"{n}{text}" if text else None)
        out["ma"] = pa.array(ma, pa.string())
        wide = 3 if found.edged else 1
        own = np.concatenate((np.repeat(nuc[0], wide), np.repeat(tf[0], 3)))
        values = np.concatenate((np.stack(nuc[3 : 3 + wide], 1).ravel(), np.stack(tf[3:], 1).ravel()))
        order = np.argsort(own, kind="stable")
        out["ma_aq"] = lists(own[order], int32(values[order]), (per["nuc"] + per["tf"]) == 0)
    own = s.owner(bound.start)
    struct = pa.StructArray.from_arrays([int32(bound.start - s.first[own]), int32(bound.stop - bound.start), pa.array(bound.llr), int32(bound.opps), int32(q), int32(left), int32(right)], names=["start", "n", "llr", "opps", "q", "el", "er"])
    return out | {"tf": lists(own, struct)}


def by_molecule(s: Structure, found: Called) -> list[tuple[list, list, list]]:
    """(nucleosomes, patches, binding calls) of each molecule as rows (start, stop, bytes, …), by start."""
    out: list[tuple[list, list, list]] = [([], [], []) for _ in range(len(s.length))]
    first = s.first.tolist()
    order = np.argsort(found.nucs.start, kind="stable")
    nucs = found.nucs.where(order)
    for i, a, b, q, el, er in zip(s.owner(nucs.start).tolist(), *[x.tolist() for x in nucs]):
        out[i][0].append((a - first[i], b - first[i], (q, el, er)))
    if found.msp_q is None:
        for i, a, b in zip(s.owner(found.msps.start).tolist(), found.msps.start.tolist(), found.msps.stop.tolist()):
            out[i][1].append((a - first[i], b - first[i], ()))
    else:
        for i, a, b, q in zip(s.owner(found.msps.start).tolist(), found.msps.start.tolist(), found.msps.stop.tolist(), found.msp_q.tolist()):
            out[i][1].append((a - first[i], b - first[i], (q,)))
    c = found.bound
    for i, a, b, llr, opps, q, el, er in zip(s.owner(c.start).tolist(), c.start.tolist(), c.stop.tolist(), c.llr.tolist(), c.opps.tolist(), llr_bytes(c.llr).tolist(), edge_bytes(c.left).tolist(), edge_bytes(c.right).tolist()):
        out[i][2].append((a - first[i], b - first[i], (q, el, er), llr, opps))
    return out


GIVEN = ("ns", "nl", "nq", "as", "al", "aq", "ma", "ma_aq", "an")
READ = {"seq": "string", "mm": "string", "ml": "array<int>", "is_reverse": "boolean", "st": "string", "md": "string", "cigar": "array<struct<op:int,n:int>>", "ref_seq": "string"} | {t: "string" if t in ("ma", "an") else "array<int>" for t in GIVEN}


def safe_worker(model: Model, second: Model, options: Options) -> Callable[[dict[str, list], list[str | None]], list[dict[str, object]] | dict[str, pa.Array]]:
    """call_batch() that, where it fails, goes through the batch a read at a time, so that only the bad ones have an error."""

    def safely(columns: dict[str, list], reasons: list[str | None]) -> list[dict[str, object]] | dict[str, pa.Array]:
        try:
            return call_batch(columns, list(reasons), model, second, options)
        except Exception as error:
            if len(reasons) == 1:
                return [{"skip_reason": None, "error": f"{type(error).__name__}: {error}"}]
            out = []
            for i, reason in enumerate(reasons):
                one = safely({n: [v[i]] for n, v in columns.items()}, [reason])
                out += one if isinstance(one, list) else [{n: v[0].as_py() for n, v in one.items()}]
            return out

    return safely


def reason_column(reads: DataFrame, options: Options) -> F.Column:
    """Why a row is passed by, null if it isn't; of columns that are there."""
    has, reason = set(reads.columns), F.lit(None).cast("string")
    flag = F.coalesce(F.col("flag"), F.lit(0)) if "flag" in has else F.lit(0)
    unmapped = flag.bitwiseAND(4) != 0
    tests = [(F.col("seq").isNull() | (F.col("seq") == ""), "no_sequence")]
    tests.append((F.length("seq") < options.min_length, "too_short"))
    if "mapq" in has:
        tests.append((~unmapped & (F.col("mapq") < options.min_mapq), "low_mapq"))
    if options.primary_only:
        tests.append((flag.bitwiseAND(0x900) != 0, "secondary_supplementary"))
    if not options.unmapped:
        tests.append((unmapped, "unmapped"))
    if "trained" in has:
        tests.insert(0, (F.col("trained"), "training_excluded"))
    for test, name in tests:  # the last that is asked comes first
        reason = F.when(test, name).otherwise(reason)
    return reason


def call(reads: DataFrame, model: Model, options: Options = Options(), *, second: Model | None = None) -> DataFrame:
    """All rows and columns of reads, with the calls of each molecule (the columns of OUTPUT, which are replaced).

    reads: seq, and of mm, ml, is_reverse (or flag), st, md, cigar, ref_seq, mapq and trained
    what is there. second: the model whose emissions score binding and edges, by default
    the same. ns … an are tags in the direction the molecule was read; tf are the binding
    calls as seq is stored.

    A row that is passed by has a skip_reason and null calls. One whose data can't be worked
    on has error, and null calls, and holds up no other: its batch is done again a row at a
    time. Nothing is shuffled and no row is lost; what is held at once is bounded by BASES
    bases, or by one molecule.
    """
    names = [x.strip().split(" ")[0].strip("`") for x in OUTPUT.replace(CALL, "x").split(", ")]
    kept = [c for c in reads.columns if c not in names]
    flags = F.coalesce(F.col("flag"), F.lit(0)).bitwiseAND(16) != 0 if "flag" in reads.columns and "is_reverse" not in reads.columns else None
    there = {c for c in reads.columns if c not in GIVEN or options.tagged}
    asked = [(flags if c == "is_reverse" and flags is not None else F.col(c) if c in there else F.lit(None)).cast(t).alias(f"__{c}") for c, t in READ.items()]
    rows = reads.select(*kept, *asked, reason_column(reads, options).alias("__reason"))
    schema = ", ".join(f"`{n}` {t}" for n, t in reads.select(*kept).dtypes) + ", " + OUTPUT
    second = model if second is None else second
    for m in (model, second):  # one that doesn't fit is told at once
        check_symbols(m, options.k)

    safely = safe_worker(model, second, options)
    fields = schema_fields(OUTPUT)
    return map_batches(rows, lambda batches: in_parts(batches, len(kept), safely, fields), schema)


def in_parts(batches: Iterator[pa.RecordBatch], n_kept: int, work: Callable[[dict[str, list], list[str | None]], list[dict[str, object]] | dict[str, pa.Array]], fields: list[pa.Field]) -> Iterator[pa.RecordBatch]:
    """Runs work() on some rows at a time, by bases; the first n_kept columns go along."""
    for whole in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(whole.column(n_kept)), 0), np.int64)
        group = (np.cumsum(size) - 1).clip(0) // BASES if len(size) else size
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)] if len(size) else [0, 0]
        for a, b in zip(edges[:-1], edges[1:]):
            batch = whole.slice(a, b - a)
            columns = {c: numbers(batch.column(n_kept + i)) if c == "ml" else batch.column(n_kept + i).to_pylist() for i, c in enumerate(READ)}
            made = work(columns, batch.column(n_kept + len(READ)).to_pylist())
            if isinstance(made, dict):
                out = [made[f.name].cast(f.type) if f.name in made else pa.nulls(batch.num_rows, f.type) for f in fields]
            else:
                out = [pa.array([r.get(f.name) for r in made], f.type) for f in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], *out], names=[*batch.schema.names[:n_kept], *[f.name for f in fields]])


def apply(reads: DataFrame, model: Model, options: Options = Options(), **more: Model) -> DataFrame:
    """call() with the chain alone: footprints and patches, no second pass."""
    return call(reads, model, replace(options, recall=False, bind=False), **more)


def recall_tagged(reads: DataFrame, model: Model, options: Options = Options()) -> DataFrame:
    """call() as a second pass over reads whose tags ns, nl, as and al (nq) say where footprints and patches are.

    A read without marks, or that is passed by, keeps its tags, and has a reason. With
    ``recall`` off nucleosomes stay as they are, with their qualities, but for short ones that
    a binding call overlaps.
    """
    if options.circular:
        raise ValueError("a second pass is over reads as lines")
    return call(reads, model, replace(options, tagged=True))


def estimate_repeat(reads: DataFrame, model: Model, options: Options = Options(), *, n: int = 3000, second: Model | None = None) -> int:
    """The nucleosome repeat length of the first n reads that are called; 185 if they show fewer than 300 neighbours."""
    from .intervals import repeat_length, spacing

    some = call(reads.limit(n), model, replace(options, recall=True, bind=False, repeat=0), second=second).where("size(ns) > 1")
    rows = some.withColumn("__id", F.monotonically_increasing_id()).select(F.col("__id").alias("read_id"), F.inline(F.arrays_zip("ns", "nl")))
    gaps = spacing(rows.select("read_id", F.col("ns").cast("long").alias("start"), (F.col("ns") + F.col("nl")).cast("long").alias("stop")), ["read_id"])
    return int(repeat_length(gaps).first()["nrl"])


def call_codes(rows: DataFrame, model: Model, options: Options = Options(), *, second: Model | None = None, id_col: str = "read_id", codes_col: str = "codes") -> DataFrame:
    """(id, kind, start, stop, llr, opps, q, el, er) of rows (id, codes array<int>): the plan from symbols on, not on circles.

    kind: nuc, msp or tf; llr and opps of binding calls only. A null or empty list has no rows.
    """
    kind = dict(rows.dtypes)[id_col]
    ratios = symbol_ratios(model if second is None else second)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, length = flat_lists(batch.column(1))
            s = structure(np.asarray(codes, np.int64), length, model, ratios, options)
            found = fuse(s, options)
            who = np.concatenate([s.owner(x.start) for x in (found.nucs, found.msps, found.bound)])
            n, m, b = len(found.nucs.start), len(found.msps.start), found.bound
            start, stop = (np.concatenate((getattr(found.nucs, f), getattr(found.msps, f), getattr(b, f))) - s.first[who] for f in ("start", "stop"))
            less = lambda values, kind: pa.concat_arrays([pa.nulls(n + m, kind), pa.array(values, kind)])  # noqa: E731, B023
            quality = [pa.array(np.concatenate((x, np.zeros(m, np.int64), y)), pa.int32()) for x, y in zip(found.nucs[2:], (llr_bytes(b.llr), edge_bytes(b.left), edge_bytes(b.right)))]
            kinds = pa.array(["nuc"] * n + ["msp"] * m + ["tf"] * len(b.start), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), kinds, pa.array(start, pa.int64()), pa.array(stop, pa.int64()), less(b.llr, pa.float64()), less(b.opps, pa.int64()), *quality], names=[id_col, "kind", "start", "stop", "llr", "opps", "q", "el", "er"])

    return map_batches(rows.select(id_col, F.col(codes_col).cast("array<int>")), run, f"`{id_col}` {kind}, kind string, start long, stop long, llr double, opps long, q int, el int, er int")
