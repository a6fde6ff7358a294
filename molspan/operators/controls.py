"""Controls and training: counts of contexts in files of known state, emissions, transfer, and the arrays that a chain is trained on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molspan.functions.chain import Model, fitted
from molspan.functions.encoding import symbols
from molspan.functions.marks import marks
from molspan.session import cut

from .contexts import accessibility, mark_counts, supported_rates, trim_contexts, weighted_line
from .reads import hash_order


def funnel(reads: DataFrame, *, min_mapq: int = 20, min_length: int = 1000) -> DataFrame:
    """reads plus ``reason``: why a control's read isn't counted, ``processed`` if it is; the first that holds.

    Rows without seq have read_length; of mm and ml only counts whether they are null.
    """
    flag = F.coalesce(F.col("flag"), F.lit(0))
    reason = F.when(flag.bitwiseAND(4) != 0, "unmapped").when(flag.bitwiseAND(0x100) != 0, "secondary").when(flag.bitwiseAND(0x800) != 0, "supplementary").when(F.col("mapq") < min_mapq, "low_mapq")
    length = F.coalesce(F.length("seq") if "seq" in reads.columns else F.col("read_length"), F.lit(0))
    reason = reason.when(length == 0, "no_sequence").when(length < min_length, "short")
    return reads.withColumn("reason", reason.when(F.col("mm").isNull(), "no_mm").when(F.col("ml").isNull(), "no_ml").otherwise("processed"))


def with_marks(reads: DataFrame, *, mode: str, threshold: int = 125) -> DataFrame:
    """reads plus ``marks`` array<int>, of mm, ml, seq and is_reverse (or flag)."""
    reverse = F.col("is_reverse") if "is_reverse" in reads.columns else F.coalesce(F.col("flag"), F.lit(0)).bitwiseAND(16) != 0
    return reads.withColumn("marks", marks(F.col("mm"), F.col("ml"), F.col("seq"), reverse, mode=mode, threshold=threshold))


def strand_of_marks(reads: DataFrame, mode: str) -> DataFrame:
    """reads (…, seq, marks) plus ``strand`` and ``centre``: for deaminases by the bases that are marked (T: +, C; A: -, G), else ., A."""
    if mode != "daf":
        return reads.withColumns({"strand": F.lit("."), "centre": F.lit("A")})
    letters = F.split(F.upper("seq"), "")
    count = lambda c: F.size(F.filter("marks", lambda p: F.get(letters, p) == c))
    strand = F.when(count("T") > count("A"), "+").when(count("A") > count("T"), "-").otherwise(".")
    return reads.withColumn("strand", strand).withColumn("centre", F.when(F.col("strand") == "+", "C").when(F.col("strand") == "-", "G"))


def before_change(reads: DataFrame) -> DataFrame:
    """Deaminase reads as C-centred sequences before the change: marked T as C; those of the other strand turned round."""
    at = lambda: F.arrays_zip(F.split(F.upper("seq"), "").alias("c"), F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0))).alias("i"))
    marked = lambda x: F.array_contains("marks", x["i"])
    plus, minus = F.col("strand") == "+", F.col("strand") == "-"
    old = F.array_join(F.transform(F.filter(at(), lambda x: x["c"] != ""), lambda x: F.when(plus & (x["c"] == "T") & marked(x), "C").when(minus & (x["c"] == "A") & marked(x), "G").otherwise(x["c"])), "")
    rows = reads.where("strand <> '.'").withColumn("__old", old)
    n = F.length("seq")
    turned = F.when(minus, F.reverse(F.translate("__old", "ACGT", "TGCA"))).otherwise(F.col("__old"))
    places = F.when(minus, F.transform("marks", lambda p: (n - 1 - p).cast("int"))).otherwise(F.col("marks"))
    return rows.select(turned.alias("seq"), places.alias("marks"))


def control_counts(reads: DataFrame, *, mode: str, k: int = 6, threshold: int = 128, **limits: int) -> DataFrame:
    """(context, hit, nohit) of a control's reads at k flanking bases: A, or for deaminases C before the change."""
    kept = funnel(reads, **limits).where("reason = 'processed'")
    rows = with_marks(kept, mode=mode, threshold=threshold)
    if mode == "daf":
        return mark_counts(before_change(strand_of_marks(rows, mode)), k=k, centre="C")
    return mark_counts(rows.select(F.upper("seq").alias("seq"), "marks"), k=k, centre="A")


def tables_by_k(counts: DataFrame, top: int, ks: list[int]) -> DataFrame:
    """(k, context, hit, nohit, ratio) at each number of flanking bases, from the counts at the most."""
    return trim_contexts(counts, top, ks)


def footprint_contexts(reads: DataFrame, *, k: int = 3, centre: str = "A") -> DataFrame:
    """accessibility() of rows (seq, ns, nl): every ``centre`` base, by whether a footprint holds it."""
    inside = F.flatten(F.transform(F.arrays_zip("ns", "nl"), lambda x: F.when(x["nl"] > 0, F.sequence(x["ns"], x["ns"] + x["nl"] - 1)).otherwise(F.array().cast("array<int>"))))
    return accessibility(mark_counts(reads.select("seq", inside.alias("marks")), k=k, centre=centre))


@dataclass(frozen=True)
class Transfer:
    """Chances of a mark on protected and accessible bases, from a line through rates by context."""

    p_prot: float
    p_acc: float
    slope: float
    intercept: float
    r2: float
    n: int


def transfer(target: DataFrame, priors: DataFrame, *, least: int = 100, contexts: int = 10) -> Transfer:
    """Emissions for data without controls: the rate of marks by context against how accessible the context is elsewhere.

    Of the weighted line (weights: roots of the counts) the intercept is the rate on
    protected bases, its value at 1 that on accessible ones; both are kept within
    0.001 and 0.99, and change places if they are the wrong way round. Contexts need
    ``least`` observations in both tables, and there must be ``contexts`` of them.
    """
    rows = supported_rates(target, priors, least).withColumn("w", F.sqrt("n"))
    line = weighted_line(rows, "p_accessible", "rate", "w").first()
    if line["n"] < contexts or line["slope"] is None:
        raise ValueError(f"{line['n']} contexts have {least} observations in both tables; {contexts} are needed")
    low, high = sorted(min(max(x, 0.001), 0.99) for x in (line["intercept"], line["intercept"] + line["slope"]))
    return Transfer(low, high, line["slope"], line["intercept"], line["r2"] if line["r2"] is not None else float("nan"), line["n"])


# Samples and training


def sample_reads(reads: DataFrame, n: int, seed: int, *, by: str | None = None, files: int | None = None) -> DataFrame:
    """n distinct molecules in the order of a seeded hash. by: as many of each file (n / files, rounded up), then the rest of n from what is left.

    A molecule's row is the first by its position. Only n rows of each file are ranked, as
    each task keeps no more than that.
    """
    one = reads.dropDuplicates(["read_id"])
    keyed = one.withColumn("__h", hash_order(F.col("read_id"), seed))
    if by is None:
        return keyed.orderBy("__h", "read_id").limit(n).drop("__h")
    files = files or keyed.select(by).distinct().count()
    w = Window.partitionBy(by).orderBy("__h", "read_id")
    ranked = keyed.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n)
    share = -(-n // max(files, 1))
    return ranked.orderBy((F.col("__rank") > share).cast("int"), "__h", "read_id").limit(n).drop("__h", "__rank")


def by_position(reads: DataFrame, n: int, seed: int, genome: int) -> DataFrame:
    """n distinct molecules, each with a chance in proportion to the bases it covers, as random positions would hit them.

    The k-th smallest of hash ** (bases / genome) style keys: -ln(u) / bases, u a seeded hash.
    """
    u = (F.shiftrightunsigned(F.xxhash64("read_id", F.lit(seed)), 11) + F.lit(1)).cast("double") / float(1 << 53)
    bases = F.greatest(F.coalesce(F.length("seq"), F.lit(0)), F.lit(1)).cast("double") / float(max(genome, 1))
    return reads.dropDuplicates(["read_id"]).withColumn("__key", -F.log(u) / bases).orderBy("__key", "read_id").limit(n).drop("__key")


def top_up(sample: DataFrame, n: int, seed: int) -> DataFrame:
    """A sample with rows repeated, in a seeded order, until there are n; unchanged if there are as many or none."""
    have = sample.count()
    if not have or have >= n:
        return sample
    times, rest = n // have, n % have
    order = Window.orderBy(hash_order(F.col("read_id"), seed), "read_id")
    ranked = sample.withColumn("__r", F.row_number().over(order))
    copies = F.explode(F.sequence(F.lit(1), F.lit(times) + (F.col("__r") <= rest).cast("int")))
    return ranked.withColumn("__copy", copies).drop("__r", "__copy")


def training_rows(reads: DataFrame, *, mode: str, k: int = 3, trim: int = 10, threshold: int = 125) -> DataFrame:
    """(read_id, codes) of sampled reads: the sequences of symbols that the chain is trained on."""
    rows = with_marks(reads, mode=mode, threshold=threshold)
    reverse = F.col("is_reverse") if "is_reverse" in rows.columns else F.coalesce(F.col("flag"), F.lit(0)).bitwiseAND(16) != 0
    rows = strand_of_marks(rows, mode)
    return rows.select("read_id", symbols(F.col("seq"), F.col("marks"), mode=mode, k=k, trim=trim, reverse=reverse, strand=F.col("strand")).alias("codes"))


def train_all(rows: DataFrame, model: Model, *, restarts: int = 10, **options) -> list[tuple[Model, float]]:
    """Every restart's model and likelihood, the best first; attempt i starts from chances seeded by i.

    Sums over sequences don't hang on their order, so restarts differ by their start alone.
    """
    rows, found = cut(rows), []
    for i in range(restarts):
        rng = np.random.default_rng(i)
        start, *ways = (rng.dirichlet((1.0, 1.0)) for _ in range(3))
        found.append(fitted(rows, Model((float(start[0]), float(start[1])), (float(ways[0][0]), float(ways[1][1])), model.emission), **options))
    return sorted(found, key=lambda x: -x[1])
