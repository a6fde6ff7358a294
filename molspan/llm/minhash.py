"""Near-dedup: circulant MinHash, banding, and exact Jaccard similarity of full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molspan.operators.graph import components
from molspan.operators.similarity import bucket_links, mix64, rows_of_band

from .common import Batch, cut, lookup, map_batches, pick, ranges, slices

#: Bands of a signature.
BANDS = 32


def shuffle32(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as 64-bit numbers in order, and their count by text.

    Words are told apart after A-Z became lower case; a text of fewer words than ``width``
    is one shingle.
    """
    batch = Batch(texts, lower=True)
    counts = np.diff(batch.first)
    if not len(batch.start):
        return np.zeros(0, np.uint64), counts
    codes, words = batch.codes()
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()], np.uint64)[codes]
    doc = np.repeat(np.arange(batch.n), counts)
    factor = mix64(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    number = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.repeat(batch.first[:-1], number) + ranges(number)
    size = np.repeat(np.minimum(counts, width), number)
    value = size.astype(np.uint64)
    for k in range(width):
        there = np.flatnonzero(size > k)
        value[there] += hashed[at[there] + k] * factor[k]
    value = mix64(value)
    doc = np.repeat(np.arange(batch.n), number)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.bincount(doc[new], minlength=batch.n)


def signature(values: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """One row of ``length`` minima for each text that has shingles.

    The first permutation deals the shingles onto a circle of 2**32 places, the second
    orders the places; coordinate k is the minimum under the second shifted by k places.
    """
    place = shuffle32(((values >> np.uint64(32)).astype(np.uint32)) ^ np.uint32(0x2545F491))
    shift = np.arange(length, dtype=np.uint32) * np.uint32(1)
    full = counts[counts > 0]
    out = np.full((len(full), length), 0xFFFFFFFF, np.uint32)
    owner = np.repeat(np.arange(len(full)), full)
    for a in range(0, len(place), 512):
        block = shuffle32(place[a : a + 512, None] - shift[None, :])
        own = owner[a : a + 512]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        who = own[first]
        out[who] = np.minimum(out[who], np.minimum.reduceat(block, first, axis=0))
    return out


def band_keys(minima: np.ndarray, bands: int) -> np.ndarray:
    rows = minima.shape[1] // bands
    parts = minima.reshape(len(minima), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(minima), bands)).copy()
    for r in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def signatures(docs: DataFrame, *, id_col: str, text_col: str, width: int, threshold: float, bands: int = BANDS) -> DataFrame:
    """(id, n_shingles, digest of the set, keys of its bands); null digest and keys for an empty set."""
    length = bands * rows_of_band(threshold, bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                values, counts = shingles(batch.column(1)[a:b], width)
                ends = np.cumsum(counts)
                digests = [xxhash.xxh3_128_digest(values[e - c : e].tobytes()) if c else None for e, c in zip(ends, counts)]
                keys = band_keys(signature(values, counts, length), bands)
                bounds = np.concatenate(([0], np.cumsum((counts > 0) * bands))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists], names=["id", "n_shingles", "digest", "bands"])

    rows = docs.select(F.col(id_col).alias("id"), text_col)
    return map_batches(rows, run, f"id {dict(rows.dtypes)['id']}, n_shingles long, digest binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, *, id_col: str, text_col: str, width: int, once: bool = False) -> DataFrame:
    """(id, items) of the documents in wanted (id). once: rows alike in id and text give one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                values, counts = shingles(batch.column(1)[a:b], width)
                bounds = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], lists], names=["id", "items"])

    rows = pick(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), wanted, ["id"])
    if once:
        rows = rows.dropDuplicates(["id", "text"])
    return map_batches(rows, run, f"id {dict(rows.dtypes)['id']}, items array<long>")


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS) -> DataFrame:
    """One row per row of docs: (id_col, n_shingles, component_id, kept).

    A text's set holds its distinct shingles of ``width`` words (A-Z lower-cased); a
    shorter text is one shingle, one without a word has none and is linked with nothing.
    Texts are linked if 100 * intersection >= percent * union, counted on their full sets
    (shingles as 64-bit hashes). component_id: the smallest id that can be reached.

    Texts with equal sets are one class, and its smallest id stands for it. Signatures of
    classes are banded; bucket_links() compares what shares a bucket on full sets, so no
    link between texts that share a bucket is lost, whatever the bucket's size, and no
    bucket's pairs are written out. Two texts at the threshold share no bucket with a
    chance below 1e-6 (again at each of the two finer levels to which crowds are dealt).

    Null ids: no component of their own: they take that of an equal text, else null, and
    stay in that case. Rows with one id and several texts are one node. Empty input: no
    rows. Other columns are not read.
    """
    rows = cut(signatures(docs, id_col=id_col, text_col=text_col, width=width, threshold=percent / 100, bands=bands))
    classes = cut(rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    joined = lookup(rows, classes, ["digest"], "n", "left")
    alone = joined.where("id IS NOT NULL AND digest IS NOT NULL AND (first IS NULL OR id = first)")
    keys = cut(alone.select("id", F.explode("bands").alias("key")))
    twice = not rows.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND id IS NOT NULL").isEmpty()

    def sets_of(wanted: DataFrame) -> DataFrame:
        return full_sets(docs, wanted, id_col=id_col, text_col=text_col, width=width, once=twice)

    links = cut(bucket_links(keys, sets_of, percent, rows_of_band(percent / 100, bands)))
    found = components(links)
    narrow = joined.select("id", "n_shingles", "first")
    out = narrow.withColumn("first", F.coalesce("first", "id")).join(found.withColumnRenamed("node", "first"), "first", "left")
    out = out.withColumn("component_id", F.coalesce("component", "first"))
    kept = F.col("component_id").isNull() | F.col("id").eqNullSafe(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))


def op10(spark, sf_dir: str) -> DataFrame:
    """Registered query: ``documents``, shingles of three words, links from 85 per cent."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_dedup(docs, width=3, percent=85)
