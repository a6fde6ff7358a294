"""Sets of half-open intervals (start, stop) of each molecule."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molspan.functions.alignment import nullable_lists


def merge(rows: DataFrame, by: list[str]) -> DataFrame:
    """Unions of touching or overlapping intervals: (*by, start, stop, n)."""
    w = Window.partitionBy(*by).orderBy("start", "stop")
    far = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(far.isNull() | (F.col("start") > far), 1).otherwise(0)
    rows = rows.withColumn("__new", new).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "__island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("n")).drop("__island")


def complement(rows: DataFrame, by: list[str], span: DataFrame, least: int = 1) -> DataFrame:
    """What merged intervals leave of (*by, lo, hi), in pieces of ``least`` at least."""
    w = Window.partitionBy(*by).orderBy("start")
    held = span.join(rows.select(*by, "start", "stop"), by, "left")
    lo, hi = F.col("lo"), F.col("hi")
    gaps = held.select(*by, F.greatest(F.coalesce(F.lag("stop").over(w), lo), lo).alias("start"), F.least(F.coalesce("start", "hi"), hi).alias("stop"))
    tail = held.groupBy(*by).agg(F.greatest(F.coalesce(F.max("stop"), F.min("lo")), F.min("lo")).alias("start"), F.max("hi").alias("stop"), F.count("stop").alias("n")).where("n > 0").drop("n")
    return gaps.unionByName(tail).where(F.col("stop") - F.col("start") >= max(1, least))


def holding(points: DataFrame, spaces: DataFrame, by: list[str]) -> DataFrame:
    """points (*by, pos, …) that one of ``spaces`` (*by, start, stop) without overlaps holds, with its start and stop.

    Both are swept together by position, so nothing is laid out by base.
    """
    named = F.struct("start", "stop")
    kinds = [(c, t) for c, t in points.dtypes if c not in (*by, "pos")]
    ends = spaces.where("stop > start").select(*by, F.col("start").alias("pos"), *[F.lit(None).cast(t).alias(c) for c, t in kinds], named.alias("__space"), F.lit(0).alias("__point"))
    dots = points.select(*by, "pos", *[c for c, _ in kinds], F.lit(None).cast(ends.schema["__space"].dataType).alias("__space"), F.lit(1).alias("__point"))
    w = Window.partitionBy(*by).orderBy("pos", "__point").rowsBetween(Window.unboundedPreceding, 0)
    met = dots.unionByName(ends).withColumn("__space", F.last("__space", ignorenulls=True).over(w)).where((F.col("__point") == 1) & (F.col("pos") < F.col("__space.stop")))
    return met.select(*points.columns, "__space.start", "__space.stop")


def clamp(rows: DataFrame, lo: Column, hi: Column) -> DataFrame:
    out = rows.withColumns({"start": F.greatest("start", lo), "stop": F.least("stop", hi)})
    return out.where("stop > start")


def scan_space(accessible: DataFrame, protected: DataFrame, by: list[str], *, short: int = 90, length: Column) -> DataFrame:
    """Where binding is looked for: accessible stretches and protected ones under ``short``, clamped and merged."""
    few = protected.where(F.col("stop") - F.col("start") < short)
    return merge(clamp(accessible.unionByName(few), F.lit(0), length), by)


def without_overlap(rows: DataFrame, others: DataFrame, by: list[str]) -> DataFrame:
    """Rows that no interval of ``others`` with the same key overlaps (a range anti join)."""
    o = others.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("start").alias("__start"), F.col("stop").alias("__stop"))
    same = [F.col(c) == F.col(f"__{c}") for c in by]
    cond = (F.col("__start") < F.col("stop")) & (F.col("__stop") > F.col("start"))
    for c in same:
        cond = c & cond
    return rows.join(o, cond, "left_anti")


def overlap(rows: DataFrame, regions: DataFrame, *, key: str, width: int, margin: int = 0) -> DataFrame:
    """Pairs of rows and regions (key, r_start, r_stop, ...) that overlap by more than ``margin``.

    Both sides are dealt to bins of ``width``, so the join is by equal bins; a pair is
    given in the first bin that both reach.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor((b - 1) / width)))
    left = rows.withColumn("__bin", bins(F.col("start"), F.col("stop")))
    right = regions.withColumn("__bin", bins(F.col("r_start"), F.col("r_stop")))
    met = left.join(right, [key, "__bin"]).where((F.col("stop") > F.col("r_start") + margin) & (F.col("start") < F.col("r_stop") - margin))
    return met.where(F.col("__bin") == F.greatest(F.floor(F.col("start") / width), F.floor(F.col("r_start") / width))).drop("__bin")


def split_circular(rows: DataFrame, length: Column) -> DataFrame:
    """Pieces of circular intervals (start, length n) on a circle: (…, piece, start, n); n is capped at the circle."""
    n = F.least(F.col("n"), length)
    at = F.pmod(F.col("start"), length)
    first = F.struct(at.alias("start"), F.least(n, length - at).alias("n"))
    rest = F.struct(F.lit(0).cast("long").alias("start"), (n - F.least(n, length - at)).alias("n"))
    pieces = F.filter(F.array(first, rest), lambda p: p["n"] > 0)
    out = rows.where(F.col("n") > 0).withColumn("__pieces", pieces)
    return out.select(*[c for c in rows.columns if c not in ("start", "n")], F.posexplode("__pieces").alias("piece", "__p")).withColumns({"start": F.col("__p.start"), "n": F.col("__p.n")}).drop("__p")


def tiled(items: Column, least: int) -> Column:
    """array<struct<start, stop, clipped>>: a sorted array of (start, minus: the negative stop) without overlaps.

    Each is clipped to where the last one ended; what is then under ``least`` goes.
    """

    @F.arrow_udf("array<struct<start:bigint,stop:bigint,clipped:boolean>>")
    def walk(items: pa.Array) -> pa.Array:
        flat = items.flatten()
        rows = zip(flat.field(0).to_pylist(), flat.field(1).to_pylist())
        starts, stops, moved, counts = [], [], [], []
        for n in pc.fill_null(pc.list_value_length(items), 0).to_pylist():
            last, kept = None, 0
            for _ in range(n):
                start, minus = next(rows)
                begin = start if last is None or last < start else last
                if -minus - begin >= least:
                    starts.append(begin)
                    stops.append(-minus)
                    moved.append(begin > start)
                    last, kept = -minus, kept + 1
            counts.append(kept)
        values = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(moved, pa.bool_())], names=["start", "stop", "clipped"])
        return nullable_lists(items, values, np.array(counts, np.int64))

    return walk(items.cast("array<struct<start:bigint,minus:bigint>>"))


def tile(rows: DataFrame, by: list[str], *, least: int = 85) -> DataFrame:
    """A tiling without overlaps: by (start, longest first), each clipped to where the last ended.

    Returns (*by, start, stop, clipped); what is then under ``least`` goes. Lists are walked
    in Arrow batches, in time that grows with them.
    """
    item = F.struct("start", (-F.col("stop")).alias("minus"))
    lists = rows.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("items"))
    folded = lists.select(*by, F.explode(tiled(F.col("items"), least)).alias("t"))
    return folded.select(*by, "t.start", "t.stop", "t.clipped")


def unify(protected: DataFrame, bound: DataFrame, by: list[str], *, short: int = 90) -> DataFrame:
    """Protected intervals, without short ones that a binding call overlaps."""
    long = protected.where(F.col("stop") - F.col("start") >= short)
    return long.unionByName(without_overlap(protected.where(F.col("stop") - F.col("start") < short), bound, by))


def spacing(rows: DataFrame, by: list[str], lo: int = 120, hi: int = 260) -> DataFrame:
    """Distances between the centres of neighbours, within [lo, hi]."""
    centre = (F.col("start") + F.col("stop")) / 2
    w = Window.partitionBy(*by).orderBy("start", "stop")
    out = rows.withColumn("centre", centre).withColumn("gap", F.lead("centre").over(w) - F.col("centre"))
    return out.where(F.col("gap").between(lo, hi)).select(*by, "gap")


def repeat_length(gaps: DataFrame, *, anchor: float = 185.0, least: int = 300, lo: int = 120, clip: tuple[float, float] = (150.0, 215.0)) -> DataFrame:
    """(n, mode_bin, median_gap, nrl): half the sum of the commonest 10-wide bin's centre and the median."""
    binned = gaps.groupBy(F.floor((F.col("gap") - lo) / 10).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    mode = binned.agg(F.max_by("bin", F.struct("c", -F.col("bin"))).alias("mode_bin"))
    mid = gaps.agg(F.count(F.lit(1)).alias("n"), F.median("gap").alias("median_gap"))
    raw = 0.5 * (F.lit(lo) + F.col("mode_bin") * 10 + 5 + F.col("median_gap"))
    nrl = F.when(F.col("n") < least, F.lit(anchor)).otherwise(F.bround(F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), raw)), 0))
    return mid.crossJoin(F.broadcast(mode)).withColumn("nrl", nrl)  # one row each


def analysed_span(length: Column, *lists: tuple[Column, Column]) -> Column:
    """struct<lo, hi>: from the first start to the last stop of lists of (starts, sizes); 0 to length if all are empty."""
    starts, stops = None, None
    for start, size in lists:
        a = F.coalesce(start.cast("array<bigint>"), F.array().cast("array<bigint>"))
        b = F.zip_with(a, F.coalesce(size.cast("array<bigint>"), F.array().cast("array<bigint>")), lambda x, n: x + n)
        starts, stops = (a, b) if starts is None else (F.concat(starts, a), F.concat(stops, b))
    return F.struct(F.coalesce(F.array_min(starts), F.lit(0).cast("bigint")).alias("lo"), F.coalesce(F.array_max(stops), length.cast("bigint")).alias("hi"))


def quality_of(rows: DataFrame, old: DataFrame, by: list[str], quality: str = "nq") -> DataFrame:
    """rows (*by, start, stop, …) plus the quality that old (*by, start, stop, quality) has for the same interval, 0 without."""
    known = old.groupBy(*by, "start", "stop").agg(F.max(quality).alias(quality))
    return rows.drop(quality).join(known, [*by, "start", "stop"], "left").withColumn(quality, F.coalesce(quality, F.lit(0)))


def gaps_to_next(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows plus ``gap``: bases to the next interval's start; null for the last."""
    return rows.withColumn("gap", F.lead("start").over(Window.partitionBy(*by).orderBy("start")) - F.col("stop"))


def depth(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(*by, pos, depth, top, mean) of each base that intervals cover."""
    laid = rows.where("stop > start").select(*(by or []), F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("pos"), value)
    return laid.groupBy(*(by or []), "pos").agg(F.count(F.lit(1)).alias("depth"), F.max(value).alias("top"), F.avg(value).alias("mean"))


def circular_pieces(rows: DataFrame, length: Column, by: list[str]) -> DataFrame:
    """(*by, start, n, part, parts, whole) of circular intervals (*by, start, n): linear pieces, numbered by start, and what they are together."""
    split = split_circular(rows, length)
    w, ordered = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("start", F.desc("piece"), "n")
    return split.select(*by, "start", "n", F.row_number().over(ordered).alias("part"), F.count(F.lit(1)).over(w).cast("int").alias("parts"), F.sum("n").over(w).alias("whole"))
