"""Second pass over protected stretches: splits, phase, refined edges, promotion and the radial template."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molspan.functions.sequences import edge_byte, llr_byte
from molspan.session import cut

from .intervals import complement, merge, without_overlap
from .segments import segment_scan

#: Bases that a task of scan_within() has on average, where the number of tasks goes by rows.
PART_ROWS = 500_000


def scan_within(obs: DataFrame, spaces: DataFrame, by: list[str], *, turned: bool = False, parts: int | None = None, **limits) -> DataFrame:
    """segment_scan inside each of spaces (*by, a, b), which may overlap; calls carry a and b.

    Spaces are laid out by base, so the join is by equal positions and its rows are the
    bases looked at. turned: evidence for accessible stretches. parts: numbers of tasks that
    the rows are dealt to, by parts_for(); without it the session's settings decide, and
    they may put any number of rows, which are short when shuffled, in one task.
    """
    bases = spaces.where("b > a").select(*by, "a", "b", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("pos"))
    seen = obs.select(*by, "pos", "step", "hit", "opp")
    if parts is not None:
        seen, bases = (x.repartition(parts, *by, "pos") for x in (seen, bases))
    rows = seen.join(bases, [*by, "pos"])
    if parts is not None:
        rows = rows.repartition(parts, *by, "a", "b")
    return segment_scan(rows.withColumn("step", -F.col("step")) if turned else rows, [*by, "a", "b"], **limits)


def parts_for(obs: DataFrame, rows: int = PART_ROWS) -> int:
    """Tasks for scan_within() over obs, whose rows are counted: so many that a task has ``rows`` of them."""
    return max(1, -(-obs.count() // rows))


def split(spaces: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
    """(*by, a, b): what the cuts (*by, a, b, start, stop) leave of spaces (*by, a, b)."""
    keys = [*by, "a", "b"]
    span = spaces.select(*keys, F.col("a").alias("lo"), F.col("b").alias("hi"))
    left = complement(merge(cuts.select(*keys, "start", "stop"), keys), keys, span)
    return left.select(*by, F.col("start").alias("a"), F.col("stop").alias("b"))


def phase_windows(spaces: DataFrame, by: list[str], repeat: float, reach: int = 35) -> DataFrame:
    """(*by, a, b, lo, hi): where linkers are looked for in stretches that hold several repeats."""
    size = F.col("b") - F.col("a")
    n = F.bround(size / F.lit(float(repeat)), 0).cast("int")
    several = spaces.withColumn("__n", n).where((size >= int(1.5 * repeat)) & (F.col("__n") >= 2))
    each = several.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n") - 1)))
    centre = F.col("a") + F.bround(F.col("__i") * size / F.col("__n"), 0).cast("long")
    return each.select(*by, "a", "b", F.greatest(F.col("a"), centre - reach).alias("lo"), F.least(F.col("b"), centre + reach).alias("hi")).where("hi - lo >= 2")


def phase_cuts(spaces: DataFrame, obs: DataFrame, by: list[str], repeat: float, *, min_llr: float = 1.0, min_opps: int = 1) -> DataFrame:
    """(*by, a, b, start, stop): the best accessible run of each window; ties go to the first."""
    windows = phase_windows(spaces, by, repeat)
    found = scan_within(obs, windows.select(*by, F.col("lo").alias("a"), F.col("hi").alias("b")).distinct(), by, turned=True, min_llr=min_llr, min_opps=min_opps)
    best = found.groupBy(*by, F.col("a").alias("lo"), F.col("b").alias("hi")).agg(F.max_by(F.struct("start", "stop"), F.struct("llr", -F.col("start"))).alias("c"))
    return windows.join(best, [*by, "lo", "hi"]).select(*by, "a", "b", "c.start", "c.stop")


def refine(spaces: DataFrame, obs: DataFrame, by: list[str], *, least: int = 85, min_llr: float = 2.0, min_opps: int = 2, parts: int | None = None) -> DataFrame:
    """(*by, a, b, start, stop, nq, el, er) of stretches (*by, a, b): their protected core.

    A stretch without evidence is its own core with bytes 0. start and stop are null where
    the stretch or its core is under ``least``: all of it is accessible then.
    """
    keys = [*by, "a", "b"]
    calls = scan_within(obs, spaces, by, parts=parts, min_llr=min_llr, min_opps=min_opps)
    core = calls.groupBy(*keys).agg(F.min("start").alias("s"), F.max("stop").alias("e"), F.sum("llr").alias("llr"), F.min_by("left_amb", "start").alias("l"), F.max_by("right_amb", "start").alias("r"))
    rows = spaces.select(*keys).join(core, keys, "left")
    start, stop = F.coalesce("s", "a"), F.coalesce("e", "b")
    fits = (F.col("b") - F.col("a") >= least) & (stop - start >= least)
    byte = lambda c, name: F.when(F.col("s").isNull(), 0).otherwise(c).alias(name)
    return rows.select(*keys, F.when(fits, start).alias("start"), F.when(fits, stop).alias("stop"), byte(llr_byte(F.col("llr")), "nq"), byte(edge_byte(F.col("l")), "el"), byte(edge_byte(F.col("r")), "er"))


def recall(footprints: DataFrame, obs: DataFrame, by: list[str], *, repeat: float | None = None, least: int = 85, min_llr: float = 4.0, min_opps: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nucleosomes (*by, start, stop, nq, el, er) and accessible rest (*by, start, stop) of footprints.

    Footprints are cut at accessible runs, then, with a repeat length, at the best run
    about each place where a linker is due; what is left is refined.
    """
    spaces = footprints.where("stop > start").select(*by, F.col("start").alias("a"), F.col("stop").alias("b"))
    cuts = cut(scan_within(obs, spaces, by, turned=True, min_llr=min_llr, min_opps=min_opps).select(*by, "a", "b", "start", "stop"))
    pieces, freed = split(spaces, cuts, by), cuts.select(*by, "start", "stop")
    if repeat is not None:
        pieces = cut(pieces)
        cuts = cut(phase_cuts(pieces, obs, by, repeat))
        pieces, freed = split(pieces, cuts, by), freed.unionByName(cuts.select(*by, "start", "stop"))
    found = cut(refine(cut(pieces), obs, by, least=least))
    nucs = found.where(F.col("start").isNotNull()).select(*by, "start", "stop", "nq", "el", "er")
    ends = F.when(F.col("start").isNull(), F.array(F.struct(F.col("a").alias("start"), F.col("b").alias("stop")))).otherwise(F.array(F.struct(F.col("a").alias("start"), F.col("start").alias("stop")), F.struct(F.col("stop").alias("start"), F.col("b").alias("stop"))))
    rest = found.select(*by, F.explode(ends).alias("x")).select(*by, "x.start", "x.stop").where("stop > start")
    return nucs, freed.unionByName(rest)


def rederive(accessible: DataFrame, freed: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """Accessible stretches with what was freed, merged: (*by, start, stop)."""
    return merge(accessible.select(*by, "start", "stop").unionByName(freed.select(*by, "start", "stop")), by).where(F.col("stop") - F.col("start") >= max(1, least)).drop("n")


def promote(bound: DataFrame, obs: DataFrame, by: list[str], *, size: int = 90, least: int = 85) -> tuple[DataFrame, DataFrame]:
    """Binding calls (*by, start, stop) that stay, and those of ``size`` and more as nucleosomes with refined edges."""
    large = bound.where(F.col("stop") - F.col("start") >= size).select(*by, F.col("start").alias("a"), F.col("stop").alias("b"))
    found = cut(refine(large.distinct(), obs, by, least=least).where(F.col("start").isNotNull()))
    stay = bound.join(found.select(*by, F.col("a").alias("start"), F.col("b").alias("stop")), [*by, "start", "stop"], "left_anti")
    return stay, found.select(*by, "start", "stop", "nq", "el", "er")


def drop_under(nucs: DataFrame, promoted: DataFrame, by: list[str], size: int = 90) -> DataFrame:
    """Nucleosomes without those under ``size`` that a promoted one overlaps."""
    short = F.col("stop") - F.col("start") < size
    return nucs.where(~short).unionByName(without_overlap(nucs.where(short), promoted, by))


@dataclass(frozen=True)
class Profile:
    """Mark rates by distance from the centre of a nucleosome, and in linkers."""

    radial: tuple[float, ...]
    linker: float
    half: int = 73
    apart: int = 150
    edge: float = 0.82
    band: tuple[float, float] = field(default=(0.30, 0.60))

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Log weights of a mark and of an unmarked base at distances -half .. half."""
        away = np.minimum(np.abs(np.arange(-self.half, self.half + 1)), len(self.radial) - 1)
        rate = np.clip(np.nan_to_num(np.asarray(self.radial, float)[away], nan=0.05), 0.01, 0.6)
        return np.log(rate / self.linker), np.log((1 - rate) / (1 - self.linker))


def matched_filter(hit: np.ndarray, opp: np.ndarray, profile: Profile) -> np.ndarray:
    """Log odds of a nucleosome centred at each base; bases beyond the ends count for nothing."""
    marked, bare = profile.weights()
    half, n = profile.half, len(hit)
    full = np.correlate(opp * hit, marked, "full") + np.correlate(opp * (1 - hit), bare, "full")
    return full[half : half + n]


def local_rate(hit: np.ndarray, opp: np.ndarray, half: int = 10) -> np.ndarray:
    """Marks per opportunity in a centred frame, NaN without any."""
    at = np.arange(len(hit))
    lo, hi = np.maximum(at - half, 0), np.minimum(at + half + 1, len(hit))
    sums = [np.concatenate(([0], np.cumsum(x))) for x in (hit, opp)]
    marks, chances = (s[hi] - s[lo] for s in sums)
    return np.divide(marks, chances, out=np.full(len(hit), np.nan), where=chances > 0)


def spaced_peaks(odds: np.ndarray, apart: int) -> list[int]:
    """Places of positive peaks, highest first, at least ``apart`` from each other; ties go to the later one."""
    order = np.lexsort((np.arange(len(odds)), odds))[::-1]
    free, out = odds > 0, []
    for k in order:
        if free[k]:
            out.append(int(k))
            free[max(0, k - apart + 1) : k + apart] = False
    return sorted(out)


def density_edge(rate: np.ndarray, centre: int, bound: int, way: int, profile: Profile) -> tuple[int, int]:
    """(edge, width of the change) from a centre to bound (way: 1 or -1): where the rate comes near that of linkers."""
    path = np.arange(centre, bound + way, way)
    path = path[(path >= 0) & (path < len(rate))]
    low, high = (x * profile.linker for x in profile.band)
    reached = np.flatnonzero(rate[path[1:]] >= profile.edge * profile.linker)
    k = int(reached[0]) + 1 if len(reached) else len(path) - 1
    still = np.flatnonzero(~(rate[path[: k + 1]] > low))  # the last one at or under the low mark
    inner = int(path[still[-1]]) if len(still) else centre
    beyond = rate[path[k] :] if way > 0 else rate[path[k] :: -1]
    over = np.flatnonzero(~(beyond < high))
    outer = int(path[k]) + way * (int(over[0]) if len(over) else len(beyond) - 1)
    return int(path[k]), abs(outer - inner)


def placed_nucs(hit: np.ndarray, opp: np.ndarray, footprints: list[tuple[int, int]], profile: Profile, least: int = 85) -> Iterator[tuple[int, int, float, int, int]]:
    """(start, stop, llr, left, right) of the nucleosomes that the template places in footprints (start, stop) of one molecule."""
    odds, rate = matched_filter(hit, opp, profile), local_rate(hit * opp, opp)
    for a, b in footprints:
        b = min(b, len(hit))
        first = max(a + 20, 0)
        if b - a < least or b - 20 <= first:
            continue
        centres = [first + k for k in spaced_peaks(odds[first : b - 20], profile.apart)]
        reach = profile.half + 37
        fences = [c - reach for c in centres[:1]] + [(x + y) // 2 for x, y in zip(centres, centres[1:])] + [c + reach for c in centres[-1:]]
        for left, c, right in zip(fences, centres, fences[1:]):
            (start, la), (stop, ra) = density_edge(rate, c, max(0, left), -1, profile), density_edge(rate, c, min(len(rate) - 1, right), 1, profile)
            if stop - start >= least:
                yield start, stop, float(odds[c]), la, ra


def radial_recall(reads: DataFrame, profile: Profile, *, id_col: str = "read_id", least: int = 85) -> DataFrame:
    """Nucleosomes (id, start, stop, llr, left_amb, right_amb) placed in footprints by the radial template.

    reads: (id, hit array<int>, opp array<int>, footprints array<struct<start, stop>>), one row
    a molecule; molecules are worked on one by one in Arrow batches.
    """
    kind = dict(reads.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, out = [], []
            for i in range(batch.num_rows):
                if not all(batch.column(k)[i].is_valid for k in (1, 2, 3)) or not len(batch.column(1)[i]):
                    continue
                spans = [(f["start"], f["stop"]) for f in batch.column(3)[i].as_py()]
                for x in placed_nucs(np.asarray(batch.column(1)[i].values, float), np.asarray(batch.column(2)[i].values, float), spans, profile, least):
                    who.append(i)
                    out.append(x)
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=[id_col, "start", "stop", "llr", "left_amb", "right_amb"])

    return reads.select(id_col, "hit", "opp", "footprints").mapInArrow(run, f"`{id_col}` {kind}, start bigint, stop bigint, llr double, left_amb bigint, right_amb bigint")
