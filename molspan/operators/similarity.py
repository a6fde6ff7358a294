"""Links between sets by exact Jaccard similarity, among those that share a bucket."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molspan.session import cut, map_batches

from .skew import HOT_ROWS, lookup

#: Chance that two sets just at the threshold meet in no bucket, at most.
MISS = 1e-6
#: Members in one block of an exact comparison.
BLOCK = 512
#: Columns of an incidence matrix that are multiplied at once.
COLUMNS = 4096
#: A pivot with more unlinked members than this has them dealt to finer buckets first.
DEAL_AGAIN = 8 * BLOCK
#: Times that this is done; what is large even then is compared in blocks.
LEVELS = 2
#: Items whose seeded minima are worked out at once.
CHUNK = 1 << 18


def rows_of_band(threshold: float, bands: int, miss: float = MISS) -> int:
    """The longest band with which sets at the threshold are missed by a chance of at most ``miss``."""
    rows = 1
    while (1 - threshold ** (rows + 1)) ** bands <= miss:
        rows += 1
    return rows


def bands_for(threshold: float, rows: int, miss: float = MISS) -> int:
    """The fewest bands of ``rows`` with which sets at the threshold are missed by a chance of at most ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_minima(values: np.ndarray, counts: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """(sets, bands) keys, each of ``rows`` seeded minima; every set must have an item."""
    out = np.empty((len(counts), bands), np.uint64)
    first = np.cumsum(counts) - counts
    mixed = mix64(values.astype(np.uint64))
    for b in range(bands):
        key = np.full(len(counts), b + 1, np.uint64)
        for r in range(rows):
            salt = mix64(np.array([seed * 1_000_003 + b * rows + r + 1], np.uint64))[0]
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(mix64(mixed ^ salt), first))
        out[:, b] = key
    return out


def set_keys(sets: DataFrame, bands: int, rows: int, *, scope: str | None = None, seed: int = 0) -> DataFrame:
    """(id, key): the buckets of rows (id, items array<long>[, scope long]); equal scopes only share a bucket."""
    kind = dict(sets.dtypes)["id"]
    given = sets.select("id", "items", F.lit(0).cast("long").alias("scope") if scope is None else F.col(scope).cast("long").alias("scope"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.asarray(whole.column(1).value_lengths().fill_null(0), np.int64)
            part = (np.cumsum(sizes) - 1).clip(0) // CHUNK
            edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(sizes)])) if len(sizes) else np.zeros(1, np.int64)
            for a, b in zip(edges[:-1], edges[1:]):
                some = np.flatnonzero(sizes[a:b] > 0)
                if not len(some):
                    continue
                batch = whole.slice(a, b - a).take(pa.array(some))
                keys = band_minima(np.asarray(batch.column(1).flatten(), np.int64), sizes[a:b][some], bands, rows, seed)
                scopes = np.asarray(batch.column(2), np.int64).astype(np.uint64)
                keys = mix64(keys + mix64(scopes + np.uint64(1))[:, None]).view(np.int64)
                who = pa.array(np.repeat(np.arange(len(some)), bands))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(who), pa.array(keys.reshape(-1))], names=["id", "key"])

    return map_batches(given, run, f"id {kind}, key long")


def similar(sets: list[np.ndarray], left: np.ndarray, percent: float) -> list[tuple[int, int]]:
    """Pairs of sets, not both in ``left``, of at least ``percent`` similarity; of each group, a tree.

    The sizes of all intersections are a product of the incidence matrix with itself.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    often = np.bincount(column) > 1
    renamed = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], renamed[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((n, n), np.float32 if size.max() < 1 << 24 else np.float64)  # whole numbers are exact in them
    for a in range(0, int(often.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        part = np.zeros((n, COLUMNS), shared.dtype)
        part[row[lo:hi], column[lo:hi] - a] = 1
        shared += part @ part.T
    shared = shared.astype(np.int64)
    close = (100 * shared >= percent * (size[:, None] + size[None, :] - shared)) & ~(left[:, None] & left[None, :])
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree = []
    for x, y in np.argwhere(np.triu(close, 1)).tolist():
        p, q = top(x), top(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            tree.append((x, y))
    return tree


def cross_links(pairs: DataFrame, sets: DataFrame, percent: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) among sets that share a pivot, where not both are linked with it.

    pairs: (pivot, id, distance): exact Jaccard distances. Distances obey the triangle
    inequality, so two sets whose distances to the pivot differ by more than the limit
    can't be linked: only equal and neighbouring bins of the distance meet. A bin of many
    members is dealt to blocks, and each pair of blocks is compared in full, by itself.
    """
    limit, kind = 1 - percent / 100, dict(sets.dtypes)["id"]
    bins = pairs.withColumn("bin", F.greatest(F.lit(0), F.ceil(F.col("distance") / limit - 1e-9) - 1).cast("int"))
    counted = bins.groupBy("pivot", "bin").agg(F.count(F.lit(1)).alias("n"))
    told = counted.groupBy("pivot").agg(F.sum("n").alias("members"), F.max("bin").alias("last"), F.map_from_entries(F.collect_list(F.struct("bin", F.ceil(F.col("n") / block).cast("int")))).alias("blocks"))
    told = cut(told.where("members > 1 AND last > 0"))
    placed = lookup(bins, told, ["pivot"], "members").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("blocks")[F.col("bin")]).cast("int"))
    # the blocks that this one meets: in its own bin, the one before and the one after
    meets = F.flatten(F.transform(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1), lambda b: F.when(F.coalesce(F.col("blocks")[b], F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), F.col("blocks")[b] - 1), lambda s: F.struct(b.alias("bin"), s.alias("salt")))).otherwise(F.array().cast("array<struct<bin:int,salt:int>>"))))
    meets = F.filter(meets, lambda m: (F.col("bin") > 0) | (m["bin"] > 0))
    own = F.struct("bin", "salt")
    rows = placed.withColumn("other", F.explode(meets)).select("pivot", "id", (F.col("bin") == 0).alias("near"), F.least(own, F.col("other")).alias("lo"), F.greatest(own, F.col("other")).alias("hi"))
    rows = rows.join(sets, "id")
    keyed = rows.withColumn("task", F.xxhash64("pivot", "lo", "hi"))
    # small tasks share a slot; on average a slot has one block's rows
    total = placed.count()
    keyed = keyed.withColumn("slot", F.when(F.least("lo.salt", "hi.salt") + F.greatest("lo.salt", "hi.salt") > 0, F.col("task")).otherwise(F.pmod("task", F.lit(max(1, total * 3 // block)))))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, part in frame.groupby(["pivot", "task"], sort=False):
            if len(part) > 1:
                ids = part["id"].to_numpy()
                tree = similar([np.asarray(x, np.int64) for x in part["items"]], part["near"].to_numpy(), percent)
                found += [(ids[x], ids[y]) for x, y in tree]
        return pd.DataFrame(found, columns=["a", "b"])

    return keyed.select("slot", "pivot", "task", "id", "near", "items").groupBy("slot").applyInPandas(compare, f"a {kind}, b {kind}")


def with_pivots(keys: DataFrame) -> DataFrame:
    """(id, pivot): each member of a bucket beside the member that meets the most others; buckets of one go."""
    several = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = cut(lookup(keys, several, ["key"], "n"))
    degree = members.groupBy("id").agg(F.sum(F.col("n") - 1).alias("degree"))
    best = members.join(degree, "id").groupBy("key", "n").agg(F.max(F.struct("degree", "id"))["id"].alias("pivot"))
    return lookup(members.select("id", "key"), cut(best), ["key"], "n").where("id <> pivot").select("id", "pivot").distinct()


def bucket_links(keys: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: float, rows: int, level: int = 0) -> DataFrame:
    """Links (a, b) that connect all sets of ``percent`` similarity that share a bucket.

    keys: (id, key), the buckets, made of bands of ``rows`` minima; sets_of: from rows (id) to
    (id, items array<long>, distinct).

    Every member of a bucket is compared with the bucket's pivot. All pairs of which not both
    are linked with it are compared in cross_links(). If a pivot has more than DEAL_AGAIN
    members that aren't linked with it, these, and those that are, are dealt to finer
    buckets first (bands twice as long, and as many as MISS asks for), so the work does not
    grow with the square of a group of texts that are alike but not alike enough. A pivot's
    set is copied for each HOT_ROWS of its members, so that no task has all of them.
    """
    pairs = cut(with_pivots(keys))
    crowd = cut(pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")))
    wanted = cut(pairs.select("id").unionByName(crowd.select(F.col("pivot").alias("id"))).distinct())
    sets = cut(sets_of(wanted))
    copies = F.ceil(F.col("n") / HOT_ROWS).cast("int")
    parts = crowd.withColumn("part", F.explode(F.sequence(F.lit(0), copies - 1))).drop("n")
    pivots = parts.join(sets.select(F.col("id").alias("pivot"), F.col("items").alias("others")), "pivot")
    dealt = lookup(pairs, crowd, ["pivot"], "n").withColumn("part", F.pmod(F.xxhash64("id"), copies).cast("int"))
    both = dealt.join(sets, "id").join(pivots, ["pivot", "part"])
    shared = F.size(F.array_intersect("items", "others"))
    measured = both.select("id", "pivot", shared.cast("long").alias("shared"), (F.size("items") + F.size("others")).cast("long").alias("sizes"))
    measured = measured.withColumn("either", F.col("sizes") - F.col("shared")).withColumn("linked", 100 * F.col("shared") >= percent * F.col("either"))
    measured = cut(measured.select("id", "pivot", "linked", F.when(F.col("linked"), 0.0).otherwise(F.greatest(1 - F.col("shared") / F.col("either"), F.lit(1.00001 - percent / 100))).alias("distance")))
    links = measured.where("linked").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    large = None
    if level < LEVELS:
        large = cut(measured.groupBy("pivot").agg(F.count_if(~F.col("linked")).alias("apart"), F.count(F.lit(1)).alias("n")).where(F.col("apart") > DEAL_AGAIN).select("pivot", "n"))
        if large.isEmpty():
            large = None
    near = measured.select("pivot", "id", "distance")
    if large is not None:
        crowded = lookup(near, large, ["pivot"], "n").select("id", F.xxhash64("pivot").alias("scope"))
        near = near.join(F.broadcast(large.select("pivot")) if large.count() <= HOT_ROWS else large.select("pivot"), "pivot", "left_anti")
        finer = set_keys(crowded.join(sets, "id"), bands_for(percent / 100, 2 * rows), 2 * rows, scope="scope", seed=level + 1)
        links = links.unionByName(bucket_links(cut(finer), lambda some: sets.join(some, "id", "left_semi"), percent, 2 * rows, level + 1))
    return links.unionByName(cross_links(near, sets, percent))
