"""Mixing sources to target weights by capped water-filling, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, small

#: Rows of one source in a bucket of its seeded order, at most about.
BUCKET_ROWS = 1_000
#: Hexadecimal digits of a bucket's name that one window runs over (4096 buckets).
DIGITS = 3


def source_key(source: Column) -> Column:
    """A string that also tells null from every source; null comes last in code point order."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def cycle_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``weight``: the cycle's numbers in turn, by the order of ``skey``."""
    place = F.row_number().over(Window.orderBy("skey")) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in cycle]), (place % len(cycle) + 1).cast("int")))


def water_fill(sources: DataFrame, budget: int, max_epochs: int = 3) -> DataFrame:
    """Adds ``target`` (double) to (skey, source_size, weight).

    Sources are filled in the order of source_size / weight. One whose share of what is
    left passes max_epochs * source_size is clamped there, and the rest goes on to the
    others by weight. In that order the clamped sources are a prefix, so running sums
    find the feasible level that redistributing again and again ends at. A budget that
    no source can take any more leaves all of them clamped. Sums are exact integers;
    only the last division rounds.
    """
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "skey")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    cap = F.lit(int(max_epochs)).cast("long") * F.col("source_size")
    left = F.lit(int(budget)).cast("decimal(38,0)") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights = F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    out = sources.withColumns({"cap": cap, "all_weight": F.sum("weight").over(every)})
    out = out.withColumns({"full": F.col("weight") * left >= F.col("cap") * weights})
    out = out.withColumns({"full_cap": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0)), "full_weight": F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(every), F.lit(0))})
    share = (F.col("weight") * (F.lit(int(budget)).cast("long") - F.col("full_cap"))).cast("double") / (F.col("all_weight") - F.col("full_weight")).cast("double")
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share)
    return out.withColumn("target", target).select("skey", "source_size", "weight", "target")


def seeded_order(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{int(seed)}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def bucket_starts(sums: DataFrame, digits: int) -> DataFrame:
    """(skey, bucket, bucket_start): what the source's buckets before it sum to.

    Running sums within DIGITS digits, plus those of the longer runs that the leading
    digits name; so no window has more than 16 ** DIGITS rows, however hot a source is.
    """
    lead = F.substring("bucket", 1, max(0, digits - DIGITS))
    here = sums.withColumn("lead", lead)
    earlier = Window.partitionBy("skey", "lead").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    here = here.withColumn("start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    if digits <= DIGITS:
        return here.select("skey", "bucket", F.col("start").alias("bucket_start"))
    upper = here.groupBy("skey", F.col("lead").alias("bucket")).agg(F.sum("bucket_size").alias("bucket_size"))
    upper = bucket_starts(upper, digits - DIGITS).select("skey", F.col("bucket").alias("lead"), F.col("bucket_start").alias("before"))
    return here.join(upper, ["skey", "lead"]).select("skey", "bucket", (F.col("before") + F.col("start")).alias("bucket_start"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, text_col: str = "text", weights: DataFrame | None = None, cycle: tuple[int, ...] = (1, 2, 3), budget: int | None = None, max_epochs: int = 3, seed: int = 8) -> DataFrame:
    """How often each row is taken so that each source's size comes near its target.

    docs: rows with an id, a source and a text (or ``size``, a Column). weights: (source,
    weight long) or None for ``cycle`` over the sources in code point order, null last; a
    source without a weight gets none. budget: words to take in all, by default as many
    as there are.

    Returns (id_col, size, source_size, target, taken, repeats, skey), one row per row of
    docs. A source's target is target / source_size repetitions of each row: the whole
    part for every row, the rest by taking rows in a seeded order (md5 of seed and id)
    while they fit, and then the one left row whose size comes nearest to what is missing,
    if that is nearer than none. So a row is taken at most max_epochs times, and the same
    rows are taken on every run.

    Null text: size 0. Null source: a source of its own, last. Null id: ordered by the
    word "null". Rows of size 0 add nothing and are repeated 0 times. Rows alike in id,
    source and size are taken alike. The target of a source whose size is 0 is 0. Empty
    input: no rows. Other columns are not read, whatever their names.

    Scale: one scan of the texts; then narrow rows only. Sums by source and bucket of the
    seeded order (about BUCKET_ROWS rows each, so a hot source is many buckets) say which
    rows fit. One task handles the table of sources, one row each.
    """
    measure = n_words(F.col(text_col)) if size is None else size
    rows = cut(docs.select(F.col(id_col).alias("__id"), source_key(F.col(source_col)).alias("skey"), F.coalesce(measure, F.lit(0)).cast("long").alias("size"), seeded_order(F.col(id_col), seed).alias("order")))
    sources = cut(rows.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    n_rows, n_sources, total = sources.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    sources = sources.drop("n")
    if weights is None:
        weighed = cycle_weights(sources, cycle)
    else:
        weighed = sources.join(weights.select(source_key(F.col("source")).alias("skey"), F.col("weight").cast("long")), "skey", "left").fillna({"weight": 0})
    targets = water_fill(weighed, int(total if budget is None else budget), max_epochs)
    ratio = F.col("target") / F.col("source_size")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(ratio), F.lit(int(max_epochs)))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    targets = cut(targets.select("skey", "source_size", "target", "whole", "need"))

    digits = max(1, math.ceil(math.log(max(1, n_rows / BUCKET_ROWS), 16)))
    rows = rows.withColumn("bucket", F.substring("order", 1, digits))
    sums = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"))
    starts = bucket_starts(sums, digits)
    inside = Window.partitionBy("skey", "bucket").orderBy("order", "__id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("run", F.sum("size").over(inside)).join(starts, ["skey", "bucket"])
    placed = placed.join(small(targets, n_sources), "skey").withColumn("end", F.col("bucket_start") + F.col("run"))
    placed = cut(placed.withColumn("fits", F.col("end") <= F.col("need")).drop("bucket", "run", "bucket_start"))

    missing = placed.groupBy("skey").agg((F.max("need") - F.coalesce(F.max(F.when(F.col("fits"), F.col("end"))), F.lit(0))).alias("missing"))
    off = F.abs(F.col("missing") - F.col("size"))
    nearest = placed.where(~F.col("fits") & (F.col("size") > 0)).join(small(missing, n_sources), "skey").where(off < F.col("missing"))
    nearest = nearest.groupBy("skey").agg(F.min(F.struct(off.alias("off"), F.col("order"), F.col("__id"), F.col("size"))).alias("last"))
    nearest = nearest.select("skey", F.col("last.order").alias("last_order"), F.col("last.size").alias("last_size"), F.col("last.__id").alias("last_id"))
    one = F.col("fits") | (F.col("last_order").isNotNull() & (F.col("order") == F.col("last_order")) & F.col("__id").eqNullSafe(F.col("last_id")) & (F.col("size") == F.col("last_size")))
    repeats = F.when(F.col("size") > 0, F.col("whole") + F.when(one, 1).otherwise(0)).otherwise(F.lit(0)).cast("long")
    out = placed.join(small(nearest, n_sources), "skey", "left").withColumn("repeats", repeats)
    return out.select(F.col("__id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats", "skey")


def repeat_rows(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: the rows of docs with all their columns, each as often as mix() says."""
    plan = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options)
    plan = plan.groupBy(F.col(id_col).alias("__id"), F.col("skey").alias("__skey"), F.col("size").alias("__size")).agg(F.max("repeats").alias("__repeats")).where("__repeats > 0")
    here = docs.withColumns({"__row_skey": source_key(F.col(source_col)), "__row_size": F.coalesce(n_words(F.col(text_col)), F.lit(0))})
    both = here.join(plan, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__row_skey") == F.col("__skey")) & (F.col("__row_size") == F.col("__size")))
    copies = both.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__repeats"))))
    return copies.select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('8:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS ord
  FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
w AS (SELECT *, (row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS weight FROM s),
t AS (SELECT *, 3 * source_size AS cap, sum(weight) OVER () AS aw, sum(source_size) OVER () AS budget,
    coalesce(sum(3 * source_size) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS w_before
  FROM w WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, weight * (budget - cap_before) >= cap * (aw - w_before) AS isfull FROM t),
g AS (SELECT *, coalesce(sum(CASE WHEN isfull THEN cap END) OVER (), 0) AS fc, coalesce(sum(CASE WHEN isfull THEN weight END) OVER (), 0) AS fw FROM f),
h AS (SELECT skey, source_size, CASE WHEN isfull THEN CAST(cap AS DOUBLE)
    ELSE CAST(weight * (budget - fc) AS DOUBLE) / CAST(aw - fw AS DOUBLE) END AS target FROM g),
n AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS BIGINT) ELSE 0 END AS whole FROM h),
m AS (SELECT *, greatest(0.0, target - whole * source_size) AS need FROM n),
p AS (SELECT d.*, source_size, target, whole, need,
    sum(size) OVER (PARTITION BY d.skey ORDER BY ord, doc_id NULLS FIRST, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM d JOIN m ON d.skey = m.skey),
q AS (SELECT *, run <= need AS fits, need - coalesce(max(CASE WHEN run <= need THEN run END) OVER (PARTITION BY skey), 0) AS missing FROM p),
r AS (SELECT *, CASE WHEN fits THEN 0 ELSE rank() OVER (PARTITION BY skey ORDER BY
    fits OR size = 0 OR abs(missing - size) >= missing, abs(missing - size), ord, doc_id NULLS FIRST, size) END AS rk FROM q)
SELECT doc_id, size, source_size, target,
  CASE WHEN size > 0 THEN size * (whole + CASE WHEN fits OR (rk = 1 AND abs(missing - size) < missing) THEN 1 ELSE 0 END) ELSE 0 END AS taken
FROM r
"""


def op8(spark, sf_dir: str) -> DataFrame:
    """Registered query: mixes all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
