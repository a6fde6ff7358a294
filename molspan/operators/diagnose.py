"""What reads carry: modes, tags, strands and changes, from a few rows or from all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS = ("mm", "ml", "ns", "nl", "as", "al", "ma", "st", "md", "hp", "ps")


def column(df: DataFrame, name: str, kind: str) -> F.Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def signs(reads: DataFrame) -> dict[str, F.Column]:
    """Conditions on a row: what kind of data it looks like."""
    mm, seq = column(reads, "mm", "string"), column(reads, "seq", "string")
    return {
        "ambiguity": F.upper(seq).rlike("[RY]"), "st": column(reads, "st", "string").isin("CT", "GA"), "a_a": mm.rlike("(?i)(^|;)A[+-]a"), "t_a": mm.rlike("(?i)(^|;)T[+-]a"),
        "c_m": mm.rlike("(?i)(^|;)C[+-]m"), "u": mm.rlike("(?i)(^|;)[CG][+-]u"), "mm": mm.isNotNull() & (mm != ""), "md": column(reads, "md", "string").isNotNull(),
    }


def sniff_mode(reads: DataFrame, n: int = 100) -> str | None:
    """The mode that the first n rows with a sequence look like; None if they show nothing.

    Ambiguity signs, strand tags or marked U: daf. Marks on A and on T: pacbio-fiber; on A
    alone: nanopore-fiber.
    """
    rows = reads.where(F.col("seq").isNotNull()).limit(n)
    s = signs(rows)
    got = rows.agg(*[F.count_if(c).alias(k) for k, c in s.items()]).first()
    if got["ambiguity"] or got["st"] or got["u"]:
        return "daf"
    if got["t_a"]:
        return "pacbio-fiber"
    return "nanopore-fiber" if got["a_a"] else None


def tag_report(reads: DataFrame, n: int | None = 20) -> DataFrame:
    """One row: how many of the first n mapped rows (None: of all) have each tag, and the kinds of marks that there are."""
    mapped = reads.where(column(reads, "flag", "int").isNull() | (column(reads, "flag", "int").bitwiseAND(4) == 0))
    rows = mapped if n is None else mapped.limit(n)
    there = [F.count_if(F.col(t).isNotNull()).alias(f"has_{t}") for t in TAGS if t in rows.columns]
    heads = F.regexp_extract_all(column(rows, "mm", "string"), F.lit(r"([A-Za-z][+-][A-Za-z0-9]+)"))
    return rows.agg(F.count(F.lit(1)).alias("n"), *there, F.array_sort(F.array_distinct(F.flatten(F.collect_set(heads)))).alias("kinds"))


def looks_like_marks_of_adenine(reads: DataFrame, n: int = 20) -> bool:
    """Whether the first rows have marks on A (or T) and nothing that tells of a deaminase."""
    return sniff_mode(reads, n) in ("pacbio-fiber", "nanopore-fiber")


def outputs_to_write(asked: list[str], reads: DataFrame, *, explicit: bool = False, n: int = 20) -> list[str]:
    """The features to extract: deaminations go, unless asked for by name, from data that have none."""
    return [x for x in asked if x != "deam" or explicit or not looks_like_marks_of_adenine(reads, n)]


def check_deaminase_input(reads: DataFrame, *, has_reference: bool = False, n: int = 10) -> None:
    """ValueError unless the first rows have ambiguity signs, MD texts or marks, or there is a reference."""
    if has_reference:
        return
    rows = reads.limit(n)
    s = signs(rows)
    got = rows.agg(F.coalesce(F.bool_or(s["ambiguity"] | s["md"] | s["u"]), F.lit(False)).alias("some")).first()
    if not got["some"]:
        raise ValueError("deaminase data need Y and R in the sequences, MD texts, or a reference")


def mark_kinds(reads: DataFrame) -> DataFrame:
    """(kind, n): how many molecules have each kind of mark, such as A+a, of all rows."""
    heads = F.array_distinct(F.regexp_extract_all(F.col("mm"), F.lit(r"(?:^|;)([A-Za-z][+-][A-Za-z0-9]+)"), F.lit(1)))
    return reads.select(F.explode(heads).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def strand_counts(stamped: DataFrame) -> DataFrame:
    """(st, n) of stamped rows; null: the strand couldn't be told."""
    return stamped.groupBy("st").agg(F.count(F.lit(1)).alias("n"))


def change_summary(stamped: DataFrame) -> DataFrame:
    """One row of stamped(): total, encoded, ct, ga, skipped, chimeras, and the mean rate of changes of encoded molecules."""
    st = F.col("st")
    changes = F.when(st == "CT", F.col("n_ct")).when(st == "GA", F.col("n_ga"))
    rate = changes / F.nullif(F.length("seq"), F.lit(0))
    return stamped.agg(F.count(F.lit(1)).alias("total"), F.count(st).alias("encoded"), F.count_if(st == "CT").alias("ct"), F.count_if(st == "GA").alias("ga"), F.count_if(st.isNull()).alias("skipped"), F.count_if(F.col("chimera")).alias("chimeras"), F.avg(rate).alias("mean_rate"))
