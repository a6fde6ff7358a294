"""Counts of sequence contexts, and emission models made from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molspan.functions.encoding import NUMBER, ORDER, contexts_at, iter_contexts
from molspan.functions.marks import bytes_of
from molspan.session import map_batches

#: Flanks up to which the counts of all contexts fit an array in each task (4 ** 2k of them).
DENSE_K = 6


def coded_centres(seq: pa.Array, k: int, centre: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, code) of every ``centre`` base (upper case) with k known bases on both sides."""
    data, length = bytes_of(seq)
    base = np.where((data >= 97) & (data <= 122), 4, NUMBER[data]).astype(np.uint8)
    first = np.cumsum(length) - length
    at = np.flatnonzero(data == ord(centre))
    row = np.searchsorted(first + length, at, "right")
    near = (at - first[row] >= k) & (first[row] + length[row] - at > k)
    at, row = at[near], row[near]
    code, known = contexts_at(base, at, k, False)
    return row[known], (at - first[row])[known], code[known]


def centres(seqs: DataFrame, *, k: int, centre: str = "A", keep: list[str] | None = None) -> DataFrame:
    """(*keep, pos, context) for every ``centre`` base of seq with k known bases on both sides; keep: all columns but seq."""
    keep = [c for c in seqs.columns if c != "seq"] if keep is None else keep
    rows = seqs.select(*keep, "seq")
    text = [c for _, c in iter_contexts(k, centre)] if k <= DENSE_K else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None if text is None else pa.array(text)
        for batch in batches:
            row, at, code = coded_centres(batch.column(len(keep)), k, centre)
            who = pa.array(row)
            if names is None:
                context = pa.array([spelled(c, k, centre) for c in code.tolist()], pa.string())
            else:
                context = names.take(pa.array(code))
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(who) for i in range(len(keep))], pa.array(at, pa.int32()), context], names=[*keep, "pos", "context"])

    return map_batches(rows, run, ", ".join(f"`{n}` {t}" for n, t in rows.drop("seq").dtypes) + (", " if keep else "") + "pos int, context string")


def spelled(code: int, k: int, centre: str) -> str:
    """The context of one code."""
    letters = "".join(chr(ORDER[(code >> (2 * j)) & 3]) for j in range(2 * k - 1, -1, -1))
    return letters[:k] + centre + letters[k:]


def context_counts(seqs: DataFrame, *, k: int, centre: str = "A", marked: Column, weight: Column | None = None) -> DataFrame:
    """(context, hit, nohit) over rows (…, seq): every ``centre`` base with k bases on both sides.

    marked: a boolean Column of ``pos`` (0-based) and the columns of seqs. weight: what a base
    counts for (1). Counting starts in the map tasks, so only one row a context and task is moved.
    """
    one = F.lit(1) if weight is None else weight
    none = one * 0
    rows = centres(seqs, k=k, centre=centre).select("context", F.when(marked, one).otherwise(none).alias("hit"), F.when(marked, none).otherwise(one).alias("nohit"))
    return rows.groupBy("context").agg(F.sum("hit").alias("hit"), F.sum("nohit").alias("nohit"))


def mark_counts(reads: DataFrame, *, k: int, centre: str = "A", seq_col: str = "seq", marks_col: str = "marks") -> DataFrame:
    """context_counts() of rows (seq, marks array<int>), counted in each batch before any row leaves Python."""
    if k > DENSE_K:
        raise ValueError(f"k is {k}; at most {DENSE_K}, as a task counts all 4 ** 2k contexts in an array")
    size = 4 ** (2 * k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            row, at, code = coded_centres(batch.column(0), k, centre)
            lists = batch.column(1)
            flat, n = np.asarray(lists.flatten(), np.int64), np.asarray(lists.value_lengths().fill_null(0), np.int64)
            marked = np.isin(row << 40 | at, np.repeat(np.arange(len(n)), n) << 40 | flat)
            total += np.bincount(code, minlength=size)
            hit += np.bincount(code[marked], minlength=size)
        some = np.flatnonzero(total)
        text = [spelled(c, k, centre) for c in some.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(hit[some]), pa.array((total - hit)[some])], names=["context", "hit", "nohit"])

    found = map_batches(reads.select(seq_col, F.col(marks_col).cast("array<int>")), run, "context string, hit long, nohit long")
    return found.groupBy("context").agg(F.sum("hit").alias("hit"), F.sum("nohit").alias("nohit"))


def accessibility(counts: DataFrame) -> DataFrame:
    """(context, accessible_bp, total_bp, p_accessible) of counts by context, hit: protected; 0.5 without any."""
    total = F.col("hit") + F.col("nohit")
    return counts.select("context", F.col("nohit").alias("accessible_bp"), total.alias("total_bp"), F.when(total > 0, F.col("nohit") / total).otherwise(0.5).alias("p_accessible"))


def supported_rates(target: DataFrame, priors: DataFrame, least: int = 100) -> DataFrame:
    """(context, rate, p_accessible, n) where both tables have ``least`` observations of a context."""
    total = F.col("hit") + F.col("nohit")
    rates = target.where(total >= least).select("context", (F.col("hit") / total).alias("rate"), total.alias("n"))
    return rates.join(priors.where(F.col("total_bp") >= least), "context").select("context", "rate", "p_accessible", "n")


def filled(coded: DataFrame, code: str, n: int) -> DataFrame:
    """(code, hit, nohit) with every code from 0 to n - 1; those the table lacks count 0."""
    every = coded.sparkSession.range(n).select(F.col("id").alias(code))
    return every.join(coded.select(code, "hit", "nohit"), code, "left").fillna(0, ["hit", "nohit"])


def trim_contexts(counts: DataFrame, k: int, to: list[int]) -> DataFrame:
    """Counts at shorter flanks, all at once: (k, context, hit, nohit, ratio)."""
    levels = F.explode(F.array(*[F.lit(x) for x in to]))
    rows = counts.withColumn("k", levels)
    rows = rows.withColumn("context", F.substring(F.col("context"), F.lit(k) - F.col("k") + 1, 2 * F.col("k") + 1))
    out = rows.groupBy("k", "context").agg(F.sum("hit").alias("hit"), F.sum("nohit").alias("nohit"))
    return out.withColumn("ratio", F.col("hit") / (F.col("hit") + F.col("nohit")))


def dense_codes(counts: DataFrame) -> DataFrame:
    """Adds ``encode``: the alphabetical rank from 0. The table has at most 4 ** 2k contexts."""
    return counts.withColumn("encode", (F.dense_rank().over(Window.orderBy("context")) - 1).cast("long"))


def positional_code(context: Column, k: int) -> Column:
    """The code of a context: flanks read in base four with A 0, C 1, T 2, G 3."""
    flanks = F.translate(F.concat(F.substring(context, 1, k), F.substring(context, k + 2, k)), "ACTG", "0123")
    return F.conv(flanks, 4, 10).cast("long")


def joined_tables(accessible: DataFrame, protected: DataFrame, adjust: float = 1.0) -> DataFrame:
    """(context, p_acc, p_prot) of two tables of counts; what one lacks is 0."""
    rate = F.col("hit") / (F.col("hit") + F.col("nohit"))
    a = accessible.select("context", rate.alias("p_acc"))
    b = protected.select("context", rate.alias("p_prot"))
    both = a.join(b, "context", "full").fillna(0.0)
    return both.select("context", *[F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) * adjust)).alias(c) for c in ("p_acc", "p_prot")])


def joined_codes(accessible: DataFrame, protected: DataFrame, adjust: float = 1.0) -> DataFrame:
    """joined_tables() of two tables (encode, ratio) that number contexts alike: (encode, p_acc, p_prot)."""
    both = accessible.select("encode", F.col("ratio").alias("p_acc")).join(protected.select("encode", F.col("ratio").alias("p_prot")), "encode", "full").fillna(0.0)
    return both.select("encode", *[F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) * adjust)).alias(c) for c in ("p_acc", "p_prot")])


def save_counts(counts: DataFrame, path: str, *, k: int, centre: str) -> None:
    """Counts by context, with k and centre beside them, in a Parquet folder."""
    counts.withColumns({"k": F.lit(k), "centre": F.lit(centre)}).write.mode("overwrite").parquet(path)


def load_counts(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, int, str]:
    """(sums of the counts of several folders, k, centre); ValueError unless they agree in k and centre."""
    rows = spark.read.parquet(*paths)
    kinds = rows.select("k", "centre").distinct().limit(2).collect()
    if len(kinds) != 1:
        raise ValueError(f"counts of several kinds can't be merged: {kinds}")
    return rows.groupBy("context").agg(F.sum("hit").alias("hit"), F.sum("nohit").alias("nohit")), kinds[0]["k"], kinds[0]["centre"]


def log_ratios(table: DataFrame, floor: float = 1e-30) -> DataFrame:
    """Adds llr_hit and llr_miss: protected against accessible, in natural logs."""
    ln = lambda x: F.log(F.greatest(x, F.lit(floor)))
    return table.withColumns({"llr_hit": ln(F.col("p_prot")) - ln(F.col("p_acc")), "llr_miss": ln(1 - F.col("p_prot")) - ln(1 - F.col("p_acc"))})


def uplift(table: DataFrame, power: float) -> DataFrame:
    """Chances of a hit as if marking had gone on ``power`` times as long."""
    return table.withColumns({"p_acc": 1 - F.pow(1 - F.col("p_acc"), F.lit(power)), "p_prot": F.pow(F.col("p_prot"), F.lit(power))})


def weighted_line(rows: DataFrame, x: str, y: str, weight: str) -> DataFrame:
    """(intercept, slope, r2, n) of the weighted least squares line, from sums only."""
    w, a, b = F.col(weight), F.col(x), F.col(y)
    s = rows.agg(F.sum(w).alias("w"), F.sum(w * a).alias("wx"), F.sum(w * b).alias("wy"), F.sum(w * a * a).alias("wxx"), F.sum(w * a * b).alias("wxy"), F.sum(w * b * b).alias("wyy"), F.count(F.lit(1)).alias("n"))
    det = F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx")
    s = s.withColumn("slope", (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / F.nullif(det, F.lit(0.0)))
    s = s.withColumn("intercept", (F.col("wy") - F.col("slope") * F.col("wx")) / F.col("w"))
    left = F.col("wyy") - F.col("intercept") * F.col("wy") - F.col("slope") * F.col("wxy")
    return s.select("intercept", "slope", (1 - left / F.nullif(F.col("wyy") - F.col("wy") * F.col("wy") / F.col("w"), F.lit(0.0))).alias("r2"), "n")


def rate_summary(table: DataFrame) -> DataFrame:
    """(state, n, least, greatest, mean, std) of p_prot (state 0) and p_acc (1)."""
    rates = F.array(F.struct(F.lit(0).alias("state"), F.col("p_prot").alias("p")), F.struct(F.lit(1).alias("state"), F.col("p_acc").alias("p")))
    return table.select(F.inline(rates)).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("least"), F.max("p").alias("greatest"), F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"))
