"""Exact dedup by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, cut, lookup, pick, spread

SALTS = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def combine(rows: DataFrame, key: list[str], content: str, salts: int = SALTS) -> DataFrame:
    """Groups rows (*key, content, id) that are equal in key and in full content.

    Returns (*key, content, keep_id, group_size). Rows are first combined inside each map
    task (the partial aggregation compares key and content), then by key and a salt of the
    id, then the salts' winners by key. So a group of any size reaches the last stage as
    at most ``salts`` rows from each of the second stage's tasks. Grouping on ``content``
    compares it byte by byte at each of these stages.
    """
    salted = rows.withColumn("salt", spread(F.col("id"), salts))
    winners = salted.groupBy(*key, content, "salt").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return winners.groupBy(*key, content).agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: (id_col, keep_id, group_size, kept, text_sha256).

    Texts are equal if they are identical after each run of U+0020 or U+0009 to U+000D
    became one space; null counts as empty. Of equal texts the row with the smallest id
    stays. text_sha256 is the lowercase hex digest of the normalised text in UTF-8.

    Null ids: never the smallest unless the whole group has none; then keep_id is null
    and all of its rows stay. Repeated ids: rows with the kept id all stay, being that
    document. Empty input: no rows. Other columns are not read.

    Scale: digests are counted first, on narrow rows, with map-side sums. Only texts
    whose digest occurs again are moved, through combine(), to be compared in full. A
    digest with one content (all, short of a collision of SHA-256) gives its keep_id by
    the digest alone, in a lookup() that sends no hot digest to one task; one with several
    is joined by its content.
    """
    text = normalised(F.col(text_col))
    full = docs.select(F.col(id_col).alias("id"), text.alias("content")).withColumn("digest", F.unhex(F.sha2(F.col("content").cast("binary"), 256)))
    narrow = cut(full.select("id", "digest"))
    repeated = narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    repeated = cut(repeated.where("n > 1").select("digest"))
    groups = combine(pick(full, repeated, ["digest"]), ["digest"], "content", salts)
    groups = groups.select("digest", "content", "keep_id", "group_size", F.xxhash64("content").alias("content_hash"))
    # the contents of one digest, of which there is one
    slim = cut(groups.select("digest", "content_hash", "keep_id", "group_size"))
    several = cut(slim.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("digest"))
    if several.isEmpty():
        out = lookup(narrow, slim.select("digest", "keep_id", "group_size"), ["digest"], "group_size", "left")
    else:
        alone = cut(slim.join(several, "digest", "left_anti").select("digest", "keep_id", "group_size"))
        out = lookup(narrow.join(several, "digest", "left_anti"), alone, ["digest"], "group_size", "left")
        rows = full.join(several, "digest", "left_semi")
        clash = cut(combine(rows, ["digest"], "content", salts))
        out = out.unionByName(lookup(rows, clash, ["digest", "content"], "group_size", "left").select("digest", "id", "keep_id", "group_size"))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    out = out.withColumn("keep_id", keep)
    kept = F.col("keep_id").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))
    return out.select(F.col("id").alias(id_col), "keep_id", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""


def op3(spark, sf_dir: str) -> DataFrame:
    """Registered query: all of ``documents``."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
