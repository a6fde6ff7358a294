"""Filters, samples and regions of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def skip_reason(*, unmapped: Column, secondary: Column, mapq: Column, length: Column, trained: Column, min_mapq: int = 20, min_length: int = 1000) -> Column:
    """Why a read is passed by; the first reason that holds, null if none does."""
    return (
        F.when(unmapped, "unmapped").when(secondary, "secondary_supplementary").when(mapq < min_mapq, "low_mapq")
        .when(length.isNull() | (length < min_length), "too_short").when(trained, "training_excluded")
    )


def regions(contigs: DataFrame, size: int) -> DataFrame:
    """(chrom, region, r_start, r_stop): contigs (chrom, length) in bins of ``size``."""
    at = F.posexplode(F.when(F.col("length") > 0, F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))))
    return contigs.select("chrom", "length", at.alias("region", "r_start")).select("chrom", "region", "r_start", F.least(F.col("r_start") + size, F.col("length")).alias("r_stop"))


def region_of(start: Column, size: int) -> Column:
    """The one region that owns a read: that of its first base."""
    return F.floor(start / size).cast("int")


def hash_order(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")).cast("binary"))


def sample(rows: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash; the same ones on every run."""
    return rows.orderBy(hash_order(F.col(id_col), seed), id_col).limit(n)


def quota(rows: DataFrame, by: str, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows of each group in the order of a seeded hash; limited in the map tasks first."""
    w = Window.partitionBy(by).orderBy("__h", id_col)
    ranked = rows.withColumn("__h", hash_order(F.col(id_col), seed)).withColumn("__rank", F.row_number().over(w))
    return ranked.where(F.col("__rank") <= n).drop("__h", "__rank")


def summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, population deviation, least, greatest and exact quartiles of a column."""
    v = F.col(value)
    return rows.groupBy(*(by or [])).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.percentile(v, F.lit(0.25)).alias("q25"), F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.75)).alias("q75"), F.max(v).alias("greatest"))


def bed12(rows: DataFrame, by: list[str]) -> DataFrame:
    """Blocks (*by, chrom, strand, start, stop, score) of each molecule as one text line of twelve fields.

    Contig and strand are the molecule's. The score is the mean, cut to a whole number; blocks
    are sorted by start.
    """
    item = F.struct("start", "stop")
    g = rows.groupBy(*by, "chrom", "strand").agg(F.sort_array(F.collect_list(item)).alias("b"), F.avg("score").cast("int").alias("score"))
    lo, hi = F.col("b")[0]["start"], F.element_at("b", -1)["stop"]
    text = lambda f: F.array_join(F.transform("b", lambda x: f(x).cast("string")), ",")
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in by])
    fields = [F.col("chrom"), lo, hi, name, F.col("score"), F.col("strand"), lo, hi, F.lit("0"), F.size("b"), text(lambda x: x["stop"] - x["start"]), text(lambda x: x["start"] - lo)]
    return g.select(*by, F.array_join(F.array(*[f.cast("string") for f in fields]), "\t").alias("line"))


def footprint_report(reads: DataFrame) -> DataFrame:
    """One row of what footprints and patches of molecules look like: (measure, value), by measure.

    reads: (read_length, ns, nl, as, al[, nq, aq]), one row a molecule; medians and quartiles
    are exact. Gaps are between neighbouring footprints by start, where they don't touch.
    """
    n = F.size("ns")
    by_start = F.array_sort(F.arrays_zip("ns", "nl"))
    gaps = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(by_start, i)["ns"] - F.get(by_start, i - 1)["ns"] - F.get(by_start, i - 1)["nl"]), lambda g: g > 0)
    covered = F.aggregate("nl", F.lit(0).cast("long"), lambda a, x: a + x) / F.nullif(F.col("read_length"), F.lit(0))
    lone = lambda c: F.array(c.cast("double"))
    lists = {"read_length": lone(F.col("read_length")), "footprint_size": F.col("nl").cast("array<double>"), "gap_size": gaps.cast("array<double>"), "msp_size": F.col("al").cast("array<double>"), "footprints_per_read": F.when(n > 0, lone(n)).otherwise(F.array().cast("array<double>")), "msps_per_read": lone(F.size("al")), "footprint_coverage": F.when(n > 0, lone(covered)).otherwise(F.array().cast("array<double>"))}
    for tag, name in (("nq", "footprint_score"), ("aq", "msp_score")):
        if tag in reads.columns:
            lists[name] = F.coalesce(F.col(tag).cast("array<double>"), F.array().cast("array<double>"))
    rows = reads.withColumns({c: F.coalesce(c, F.array().cast("array<int>")) for c in ("ns", "nl", "as", "al")})
    values = rows.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, lists)), F.array(*lists.values()))).alias("measure", "v")).select("measure", F.explode("v").alias("v"))
    return summary(values, "v", ["measure"]).orderBy("measure")


def histogram(rows: DataFrame, value: str, width: float, by: list[str] | None = None) -> DataFrame:
    """(*by, bin_start, n): counts of a column in bins of a width."""
    at = (F.floor(F.col(value) / width) * width).alias("bin_start")
    return rows.where(F.col(value).isNotNull()).groupBy(*(by or []), at).agg(F.count(F.lit(1)).alias("n"))


def report_text(report: DataFrame) -> str:
    """footprint_report() as text: one block a measure."""
    out = []
    for r in report.collect():  # a dozen rows
        out.append(f"{r['measure']}: n {r['n']}")
        out += [f"  {c}: {r[c]:.4f}" for c in ("mean", "std", "least", "q25", "median", "q75", "greatest") if r[c] is not None]
    return "\n".join(out) + "\n"


def quick_summary(rows: DataFrame, value: str, by: list[str] | None = None, accuracy: int = 10_000) -> DataFrame:
    """summary() with quartiles that are near (a rank is off by rows / accuracy at most), for columns of very many values."""
    v = F.col(value)
    q = F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy)
    found = rows.groupBy(*(by or [])).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), q.alias("q"), F.max(v).alias("greatest"))
    return found.select(*(by or []), "n", "mean", "std", "least", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "greatest")
