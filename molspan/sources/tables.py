"""Text and Parquet forms of calls: annotation tags, posterior lines and the score store."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molspan.functions.sequences import annotation_text, bytes_text, unit_byte

HEADER = "read_id chrom start stop strand posteriors fp_starts fp_sizes".split()


def tags(nucs: DataFrame, msps: DataFrame, bound: DataFrame, molecules: DataFrame, by: list[str]) -> DataFrame:
    """Annotation tags of each molecule (*by, length): (*by, ns, nl, as, al, ma, aq).

    nucs: (*by, start, stop, nq); msps: (*by, start, stop); bound: (*by, start, stop, tq, el, er).
    ns, nl and as, al are starts and lengths; ma is the text of all three kinds with starts from
    1, aq its bytes in the same order: one a nucleosome, none an accessible stretch, three a
    binding call. ma is null if there is nothing to say, aq without nucleosomes and calls.
    Rows are sorted by start and length. The three kinds are stacked, so there is one shuffle.
    """
    n = (F.col("stop") - F.col("start")).alias("n")
    none = F.array().cast("array<int>")
    stacked = [(nucs, "nuc", F.array(F.col("nq").cast("int"))), (msps, "msp", none), (bound, "tf", F.array(*[F.col(c).cast("int") for c in ("tq", "el", "er")]))]
    rows = None
    for df, kind, values in stacked:
        part = df.select(*by, F.lit(kind).alias("kind"), F.struct("start", n, values.alias("bytes")).alias("x"))
        rows = part if rows is None else rows.unionByName(part)
    lists = rows.groupBy(*by).agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("x")))).alias(k) for k in ("nuc", "msp", "tf")])
    held = molecules.select(*by, "length").join(lists, by, "left")
    of = lambda name: F.coalesce(F.col(name), F.array().cast("array<struct<start:bigint,n:bigint,bytes:array<int>>>"))
    part = lambda name, f: F.transform(of(name), lambda x: x[f].cast("bigint"))
    ma = annotation_text(F.col("length"), [("nuc.Q", of("nuc")), ("msp.", of("msp")), ("tf.QQQ", of("tf"))])
    aq = F.flatten(F.transform(F.concat(of("nuc"), of("tf")), lambda x: x["bytes"]))
    return held.select(*by, part("nuc", "start").alias("ns"), part("nuc", "n").alias("nl"), part("msp", "start").alias("as"), part("msp", "n").alias("al"), ma.alias("ma"), F.when(F.size(aq) > 0, aq).alias("aq"))


def posterior_line(*, posterior: Column, footprints: Column, fields: list[Column]) -> Column:
    """One tab-separated line: fields, posteriors (cut to bytes, base 64), starts and sizes of footprints."""
    text = lambda f: F.array_join(F.transform(footprints, lambda x: f(x).cast("string")), ",")
    values = [*[f.cast("string") for f in fields], bytes_text(F.transform(posterior, unit_byte)), text(lambda x: x["start"]), text(lambda x: x["stop"] - x["start"])]
    return F.array_join(F.array(*[F.coalesce(v, F.lit("")) for v in values]), "\t")


def write_posteriors(rows: DataFrame, path: str, **about: object) -> None:
    """Writes rows (read_id, chrom, start, stop, strand, posterior, footprints) as gzipped lines under path.

    What is said about the run goes to ``path/about``, so each task writes its own file of ``path/lines``.
    """
    line = posterior_line(posterior=F.col("posterior"), footprints=F.col("footprints"), fields=[F.col(c) for c in HEADER[:5]])
    rows.select(line.alias("value")).write.option("compression", "gzip").text(f"{path}/lines")
    said = json.dumps({**about, "columns": HEADER, "format_version": 1}, sort_keys=True)
    rows.sparkSession.range(1).select(F.lit(said).alias("value")).coalesce(1).write.text(f"{path}/about")


def read_posteriors(spark: SparkSession, path: str) -> DataFrame:
    """What write_posteriors wrote; posteriors are steps of 1/255."""
    f = F.split("value", "\t", -1)
    digits = F.hex(F.unbase64(f[5]))
    at = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).otherwise(F.array().cast("array<int>"))
    posterior = F.transform(at, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("double") / 255)
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))
    prints = F.zip_with(numbers(f[6]), numbers(f[7]), lambda s, n: F.struct(s.alias("start"), (s + n).alias("stop")))
    return spark.read.text(f"{path}/lines").select(f[0].alias("read_id"), f[1].alias("chrom"), f[2].cast("long").alias("start"), f[3].cast("long").alias("stop"), f[4].alias("strand"), posterior.alias("posterior"), prints.alias("footprints"))


def footprint_rows(reads: DataFrame, by: list[str]) -> DataFrame:
    """(*by, footprint, …): each entry of the array ``footprints`` with its place from 0."""
    return reads.select(*by, F.posexplode("footprints").alias("footprint", "x")).select(*by, "footprint", "x.*")


def write_scores(reads: DataFrame, path: str, *, append: bool = False) -> None:
    """The score store: ``path/reads`` and ``path/footprints`` (one row each, with its place), in folders by chrom.

    reads: (read_id, chrom, start, stop, strand, footprints array<struct<start, stop, score>>).
    """
    mode = "append" if append else "errorifexists"
    reads.drop("footprints").write.mode(mode).partitionBy("chrom").parquet(f"{path}/reads")
    footprint_rows(reads, ["read_id", "chrom"]).write.mode(mode).partitionBy("chrom").parquet(f"{path}/footprints")


def sorted_bed(lines: DataFrame) -> DataFrame:
    """BED lines by contig (as bytes) and start (as number), dealt by range over the tasks."""
    f = F.split("line", "\t", 3)
    return lines.orderBy(f[0], f[1].cast("long"), "line")
