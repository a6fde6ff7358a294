"""Clusters of molecules whose sets of marks are nearly the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molspan.session import cut

from .graph import components
from .similarity import bucket_links, rows_of_band, set_keys
from .skew import lookup


def clusters(sets: DataFrame, *, group: str, threshold: float = 0.8, bands: int = 24, least: int = 10) -> DataFrame:
    """(id, cluster, size) of rows (id, group, items array<long>) with at least ``least`` items.

    Rows with the same set are one row to the comparison. Sets of a group that share one of
    ``bands`` buckets are compared exactly (bucket_links()): no link between rows that share a
    bucket is lost, whatever the bucket's size, and two sets just at the threshold share
    none with a chance below 1e-6. Links are closed transitively. cluster is the smallest id,
    size the number of rows in it. Null ids and null sets have no row.
    """
    percent = round(100 * threshold, 6)
    kept = sets.where("id IS NOT NULL").select("id", F.xxhash64(group).alias("scope"), F.sort_array(F.array_distinct("items")).alias("items")).where(F.size("items") >= least)
    rows_in = cut(kept.withColumn("same", F.xxhash64("scope", "items")))
    # one row for each distinct set: hashes tell which rows may have a twin, the sets themselves which do
    maybe = cut(rows_in.groupBy("same").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    held = lookup(rows_in, maybe, ["same"], "n").drop("n")
    kinds = held.groupBy("same", "scope", "items").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    kinds = cut(kinds.select("same", "first", "n"))
    clash = cut(kinds.groupBy("same").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("same"))
    alike = kinds.where("n > 1")
    if not clash.isEmpty():  # sets of one hash that differ are told apart by themselves
        alike = alike.join(clash, "same", "left_anti")
    twins = lookup(held.select("id", "same"), cut(alike), ["same"], "n").select("id", "first")
    if not clash.isEmpty():
        some = held.join(clash, "same", "left_semi")
        firsts = some.groupBy("same", "scope", "items").agg(F.min("id").alias("first"))
        twins = twins.unionByName(some.join(firsts, ["same", "scope", "items"]).select("id", "first"))
    twins = cut(twins.where("id <> first"))
    alone = rows_in.join(twins.select("id"), "id", "left_anti")
    rows = rows_of_band(threshold, bands)
    keys = cut(set_keys(alone, bands, rows, scope="scope"))
    sets_of = lambda wanted: rows_in.join(wanted, "id", "left_semi").select("id", "items")
    found = components(cut(bucket_links(keys, sets_of, percent, rows)))
    owners = rows_in.select("id").join(twins, "id", "left").withColumn("first", F.coalesce("first", "id"))
    out = owners.join(found.withColumnRenamed("node", "first"), "first", "left").select("id", F.coalesce("component", "first").alias("cluster"))
    out = cut(out)
    sizes = cut(out.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")))
    return lookup(out, sizes, ["cluster"], "size").select("id", "cluster", "size")


def representatives(rows: DataFrame, by: str, best: list[Column], id_col: str) -> DataFrame:
    """The best row of each group; ties go to the smallest id."""
    return rows.groupBy(by).agg(F.max_by(id_col, F.struct(*[b.alias(f"b{k}") for k, b in enumerate(best)], (-F.col(id_col)).alias("tie"))).alias("representative"), F.count(F.lit(1)).alias("n"))


def chimeras(events: DataFrame, by: list[str], *, forward: str = "forward", least: int = 5, purity: float = 0.8) -> DataFrame:
    """(*by, n, chimera): whether marks of two strands change over at some point.

    events: (*by, pos, forward 0 or 1). A point counts if both its sides have ``least`` marks,
    of which different strands hold at least ``least`` and the share ``purity``.
    """
    w = Window.partitionBy(*by).orderBy("pos", forward)
    upto, every = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    r = events.withColumns({"__lf": F.sum(forward).over(upto), "__ln": F.count(F.lit(1)).over(upto), "__tf": F.sum(forward).over(every), "__tn": F.count(F.lit(1)).over(every)})
    lf, ln = F.col("__lf"), F.col("__ln")
    rf, rn = F.col("__tf") - lf, F.col("__tn") - ln
    strong = lambda f, n: (f >= least) & (f >= purity * n)
    turn = (ln >= least) & (rn >= least) & ((strong(lf, ln) & strong(rn - rf, rn)) | (strong(ln - lf, ln) & strong(rf, rn)))
    enough = (F.least(F.col("__tf"), F.col("__tn") - F.col("__tf")) >= least) & (F.col("__tn") >= 2 * least)
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(turn & enough), F.lit(False)).alias("chimera"))
