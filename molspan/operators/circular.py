"""Intervals on circular molecules: projection of tiled ones, the cut, and tilings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import tiled


def project_centre(rows: DataFrame, by: list[str], length: str = "length") -> DataFrame:
    """Intervals found on three copies in a row, as (*by, start, n) on the circle, each once.

    Kept are those that begin in the middle copy, and as the whole circle those that begin
    before it and end beyond it.
    """
    size = F.col(length)
    middle = (F.col("start") >= size) & (F.col("start") < 2 * size)
    around = (F.col("start") < size) & (F.col("stop") > 2 * size)
    kept = rows.where((F.col("stop") > F.col("start")) & (size > 0) & (middle | around))
    n = F.when(around, size).otherwise(F.least(F.col("stop") - F.col("start"), size))
    return kept.select(*by, F.when(around, F.lit(0)).otherwise(F.col("start") - size).cast("long").alias("start"), n.cast("long").alias("n")).distinct()


def on_circle(items: Column, length: Column, shift: Column) -> Column:
    """Sorted linear pieces (start, minus: the negative stop) of (start, n) items, seen from ``shift`` on."""

    def pieces(x: Column) -> Column:
        at, n = F.pmod(x["start"] - shift, length), F.least(x["n"], length)
        first = F.struct(at.cast("bigint").alias("start"), (-F.least(at + n, length)).cast("bigint").alias("minus"))
        rest = F.struct(F.lit(0).cast("bigint").alias("start"), (length - at - n).cast("bigint").alias("minus"))
        return F.when(at + n > length, F.array(first, rest)).otherwise(F.array(first))

    return F.sort_array(F.flatten(F.transform(items, pieces)))


def uncovered(pieces: Column, length: Column) -> Column:
    """First base that none of the sorted linear pieces covers; null if there is none."""
    end = F.aggregate(pieces, F.lit(0).cast("bigint"), lambda c, x: F.when(x["start"] <= c, F.greatest(c, -x["minus"])).otherwise(c))
    return F.when(end < length, end)


def lists_of(rows: DataFrame, molecules: DataFrame, by: list[str]) -> DataFrame:
    """(*by, length, items): the intervals of each molecule, of which there may be none."""
    items = rows.where("n > 0").groupBy(*by).agg(F.collect_list(F.struct(F.col("start").cast("bigint").alias("start"), F.col("n").cast("bigint").alias("n"))).alias("items"))
    empty = F.array().cast("array<struct<start:bigint,n:bigint>>")
    return molecules.where("length > 0").select(*by, F.col("length").cast("bigint").alias("length")).join(items, by, "left").withColumn("items", F.coalesce("items", empty))


def first_uncovered(rows: DataFrame, molecules: DataFrame, by: list[str]) -> DataFrame:
    """(*by, cut): first base of each molecule (*by, length) that no (start, n) covers; null if all are covered."""
    held = lists_of(rows, molecules, by)
    return held.select(*by, uncovered(on_circle(F.col("items"), F.col("length"), F.lit(0)), F.col("length")).alias("cut"))


def tile_circle(rows: DataFrame, molecules: DataFrame, by: list[str], *, least: int = 85, gap: int = 1) -> DataFrame:
    """A tiling of circles: (*by, kind, start, n), kind ``nuc`` or ``msp``.

    rows: (*by, start, n); molecules: (*by, length). The circle is opened at its first
    uncovered base (0 if there is none), what still goes over the opening is split, then
    it is tiled as a line. A molecule with an interval of its whole length is that interval
    (or accessible, if under ``least``); one without intervals is accessible. Accessible
    stretches under ``gap`` go.
    """
    least, gap, size = max(1, least), max(1, gap), F.col("length")
    held = lists_of(rows, molecules, by)
    whole = F.exists("items", lambda x: x["n"] >= size)
    one = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), (-size).alias("minus")))
    held = held.withColumn("cut", F.when(whole, 0).otherwise(F.coalesce(uncovered(on_circle(F.col("items"), size, F.lit(0)), size), F.lit(0))).cast("bigint"))
    held = held.withColumn("nucs", tiled(F.when(whole, one).otherwise(on_circle(F.col("items"), size, F.col("cut"))), least))
    kind = "array<bigint>"
    starts = F.concat(F.transform("nucs", lambda x: x["start"]).cast(kind), F.array(size))
    stops = F.concat(F.array(F.lit(0)).cast(kind), F.transform("nucs", lambda x: x["stop"]).cast(kind))
    gaps = F.filter(F.zip_with(stops, starts, lambda a, b: F.struct(F.lit("msp").alias("kind"), a.alias("start"), b.alias("stop"))), lambda x: x["stop"] - x["start"] >= gap)
    both = F.concat(F.transform("nucs", lambda x: F.struct(F.lit("nuc").alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))), gaps)
    out = held.select(*by, "length", "cut", F.explode(both).alias("x"))
    return out.select(*by, "x.kind", F.pmod(F.col("x.start") + F.col("cut"), size).alias("start"), (F.col("x.stop") - F.col("x.start")).alias("n"))
