"""Posteriors by base: export, projection onto the reference, coverage and regions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molspan.functions.chain import Model, accessible_chance, decode
from molspan.functions.encoding import NUMBER, mark_mask, observe, resolved
from molspan.functions.marks import aligned, bytes_of, numbers, parse, schema_fields, upper
from molspan.session import map_batches

from .call import state_runs

ROW = "read_id string, chrom string, start long, stop long, strand string, posterior array<float>, ref_positions array<int>, fp_starts array<int>, fp_sizes array<int>"
READ = {"read_id": "string", "chrom": "string", "ref_start": "int", "ref_end": "int", "is_reverse": "boolean", "cigar": "array<struct<op:int,n:int>>", "seq": "string", "mm": "string", "ml": "array<int>"}


def export(reads: DataFrame, model: Model, *, mode: str, k: int = 3, trim: int = 100, threshold: int = 128, least_length: int = 100, least_marks: int = 10) -> DataFrame:
    """ROW of each primary mapped read of ``least_length`` bases with ``least_marks`` marks of the quality ``threshold``.

    posterior: the chance of state 0 at each base as stored, single precision; ref_positions:
    where each base lies, -1 off the reference; fp_starts and fp_sizes: footprints whose
    first and last base lie on the reference. Every mark counts, whatever its base and
    letter. A read's row is given once, whatever regions it reaches into.
    """
    flag = F.coalesce(F.col("flag"), F.lit(0)) if "flag" in reads.columns else F.lit(0)
    turned = F.col("is_reverse") if "is_reverse" in reads.columns else flag.bitwiseAND(16) != 0
    rows = reads.where((flag.bitwiseAND(0x904) == 0) & F.col("chrom").isNotNull() & (F.length("seq") >= least_length))
    rows = rows.select(*[(turned if c == "is_reverse" else F.col(c)).cast(t).alias(c) for c, t in READ.items()])
    fields = schema_fields(ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, length = bytes_of(batch.column(6))
            data = upper(raw)
            ends, lists = np.cumsum(length), numbers(batch.column(8))
            kept, found, strands = [], [], []
            for i, (mm, ml, r) in enumerate(zip(batch.column(7).to_pylist(), lists, batch.column(4).to_pylist())):
                seq = data[ends[i] - length[i] : ends[i]]
                at = [p[q >= threshold] for _, _, p, q in parse(mm, ml, seq, bool(r))]
                at = np.unique(np.concatenate(at)) if at else np.zeros(0, np.int64)
                if len(at) < least_marks:
                    continue
                t, a = int((seq[at] == 84).sum()), int((seq[at] == 65).sum())
                kept.append(i)
                found.append(at)
                strands.append(("+" if t > a else "-" if a > t else ".") if mode == "daf" else "-" if r else "+")
            if not kept:
                continue
            some = batch.take(pa.array(kept))
            flat = np.concatenate([data[ends[i] - length[i] : ends[i]] for i in kept])
            n = length[kept]
            codes = observe(NUMBER[resolved(flat)], n, mark_mask(n, found), mode=mode, k=k, trim=trim, reverse=np.array([bool(x) for x in some.column(4).to_pylist()]), strand=strands)
            chance, states = 1 - accessible_chance(codes, n, model), decode(codes, n, model)
            runs, first, out = state_runs(states, n), np.cumsum(n) - n, []
            owner = np.searchsorted(first + n, runs.start, "right")
            for i, row in enumerate(some.select(["read_id", "chrom", "ref_start", "ref_end", "cigar"]).to_pylist()):
                on = np.full(int(n[i]), -1, np.int64)
                at, offset = aligned([(x["op"], x["n"]) for x in row["cigar"] or []])
                inside = at < n[i]
                on[at[inside]] = offset[inside] + row["ref_start"]
                a, b = (x[owner == i] - first[i] for x in runs)
                ra, rb = on[a], on[b - 1]
                there = (ra >= 0) & (rb >= 0)
                out.append({"read_id": row["read_id"], "chrom": row["chrom"], "start": row["ref_start"], "stop": row["ref_end"], "strand": strands[i], "posterior": chance[first[i] : first[i] + n[i]].astype(np.float32), "ref_positions": on, "fp_starts": ra[there], "fp_sizes": np.maximum(1, rb - ra)[there]})
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in fields], names=[f.name for f in fields])

    return map_batches(rows, run, ROW)


def save(rows: DataFrame, path: str, *, append: bool = False, **about: object) -> None:
    """ROW as Parquet in folders by chrom, ``path``/rows, and what is said about the run in ``path``/about."""
    import json

    mode = "append" if append else "overwrite"
    rows.repartition("chrom", F.pmod(F.xxhash64("read_id"), F.lit(64))).write.mode(mode).partitionBy("chrom").parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(json.dumps({"format_version": 1, **about}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(spark: SparkSession, path: str) -> DataFrame:
    """What save() wrote; conditions on chrom name the folders that are read."""
    return spark.read.parquet(f"{path}/rows")


def sink(path: str) -> str:
    """The form that a path asks for: tsv (.tsv, .tsv.gz, .txt) or parquet."""
    return "tsv" if path.lower().endswith((".tsv", ".tsv.gz", ".txt", ".txt.gz")) else "parquet"


def write(rows: DataFrame, path: str, **about: object) -> None:
    """ROW in the form that the path asks for: posterior lines, or tables by chrom."""
    if sink(path) == "parquet":
        save(rows, path, **about)
        return
    from molspan.sources.tables import write_posteriors

    prints = F.transform(F.arrays_zip("fp_starts", "fp_sizes"), lambda x: F.struct(x["fp_starts"].alias("start"), (x["fp_starts"] + x["fp_sizes"]).alias("stop")))
    write_posteriors(rows.withColumn("footprints", prints), path, **about)


def overlapping(rows: DataFrame, chrom: str, start: int, stop: int, margin: int = 1) -> DataFrame:
    """Molecules that reach over a region by more than ``margin``."""
    return rows.where((F.col("chrom") == chrom) & (F.col("stop") > start + margin) & (F.col("start") < stop - margin))


def spanning(rows: DataFrame, chrom: str, start: int, stop: int) -> DataFrame:
    """Molecules that hold a whole region."""
    return rows.where((F.col("chrom") == chrom) & (F.col("start") <= start) & (F.col("stop") >= stop))


def projection(rows: DataFrame, start: int, stop: int, how: str = "max") -> DataFrame:
    """(read_id, values array<float>): each molecule's posteriors on the reference bases of a region; 0 where it has none.

    how: of several bases on one place the "max", the "mean" or the "first". The array of a
    molecule is folded inside the JVM, so its length is the region's.
    """
    if how not in ("max", "mean", "first"):
        raise ValueError(f"{how!r} is neither max, mean nor first")
    pairs = F.arrays_zip("ref_positions", "posterior")
    inside = rows.select("read_id", F.posexplode(F.filter(pairs, lambda x: (x["ref_positions"] >= start) & (x["ref_positions"] < stop))).alias("i", "x"))
    value = F.col("x.posterior")
    best = {"max": F.greatest(F.lit(0.0).cast("float"), F.max(value)), "mean": F.avg(value).cast("float"), "first": F.min_by(value, "i")}[how]
    per = inside.groupBy("read_id", (F.col("x.ref_positions") - start).alias("p")).agg(best.alias("v"))
    held = per.groupBy("read_id").agg(F.map_from_entries(F.collect_list(F.struct("p", "v"))).alias("m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(stop - start - 1)), lambda p: F.coalesce(F.col("m")[p], F.lit(0.0).cast("float")))
    none = F.array_repeat(F.lit(0.0).cast("float"), stop - start)
    return rows.select("read_id").join(held, "read_id", "left").select("read_id", F.when(F.col("m").isNull(), none).otherwise(values).alias("values"))


def coverage(start: int, stop: int) -> Column:
    """array<float>: 1 for each base of a region that a footprint of the row (fp_starts, fp_sizes) holds, else 0."""
    zipped = F.arrays_zip("fp_starts", "fp_sizes")
    return F.transform(F.sequence(F.lit(start), F.lit(stop - 1)), lambda p: F.exists(zipped, lambda x: (x["fp_starts"] <= p) & (p < x["fp_starts"] + x["fp_sizes"])).cast("float"))


def lines_to_tables(spark: SparkSession, paths: list[str], out: str, **about: object) -> None:
    """Several folders of posterior lines as one of tables by contig; of molecules that are in more than one, one row."""
    from molspan.sources.tables import read_posteriors

    rows = None
    for path in paths:
        part = read_posteriors(spark, path)
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("nothing to read")
    one = rows.dropDuplicates(["read_id", "chrom", "start"])
    starts, sizes = F.transform("footprints", lambda x: x["start"].cast("int")), F.transform("footprints", lambda x: (x["stop"] - x["start"]).cast("int"))
    save(one.select("read_id", "chrom", "start", "stop", "strand", F.col("posterior").cast("array<float>").alias("posterior"), starts.alias("fp_starts"), sizes.alias("fp_sizes")), out, **about)
