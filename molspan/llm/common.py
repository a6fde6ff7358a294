"""What the operators of this subpackage share: words of a batch of texts, and joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molspan.operators.skew import lookup  # noqa: F401
from molspan.session import cut, give_back, map_batches, new_folder  # noqa: F401

#: White space between words: U+0020 and U+0009 to U+000D.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Rows of a table that may be broadcast, at most; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of text that a Python function works on at once (a longer text by itself).
CHUNK_BYTES = 1 << 20


def small(df: DataFrame, n_rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are few enough."""
    return F.broadcast(df) if n_rows <= limit else df


def n_words(text: Column) -> Column:
    """Number of words, null for null, in JVM expressions."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def spread(key: Column, buckets: int, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(buckets)).cast("int")


def slices(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    if not len(sizes):
        return
    part = (np.cumsum(sizes) - 1).clip(0) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    bounds = [0, *cuts.tolist(), len(sizes)]
    yield from zip(bounds[:-1], bounds[1:])


#: Bits of a key filter for each key, and at most in all; it is kept in blocks of so many.
KEY_BITS, FILTER_BITS, FILTER_BLOCK = 16, 1 << 27, 1 << 17


def key_filter(keys: DataFrame, bits: int | None = None) -> np.ndarray:
    """A bitmap with the bit pmod(key, bits) set for each of keys (key long, evenly spread; written first).

    bits: a power of two, by default that from KEY_BITS for each key on, FILTER_BITS at most. Only
    blocks of bits reach the driver, FILTER_BITS / 8 bytes in all, however many keys there
    are. A key that is there is always found. Another is taken for one that is there with
    a chance that grows once the number of keys goes beyond that bound, so the bitmap only
    spares later stages some rows: they must be right with all of them.
    """
    if bits is None:
        bits = min(FILTER_BITS, max(FILTER_BLOCK, 1 << (KEY_BITS * keys.count()).bit_length()))
    block = min(FILTER_BLOCK, bits)
    place = F.pmod(F.col("key"), F.lit(bits))
    dealt = keys.select(F.floor(place / block).cast("int").alias("block"), F.pmod(place, F.lit(block)).cast("int").alias("bit")).distinct()

    def pack(group: tuple, frame: pa.Table) -> pa.Table:
        flags = np.zeros(block, np.uint8)
        flags[np.asarray(frame.column("bit"))] = 1
        return pa.table({"block": pa.array([group[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for row in dealt.groupBy("block").applyInArrow(pack, "block int, bits binary").collect():
        out[row["block"] * block // 8 : (row["block"] + 1) * block // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def may_hold(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bits of keys are set."""
    place = keys & (8 * len(bitmap) - 1)
    return (bitmap[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


def sieve(rows: DataFrame, key: Column, bitmap: np.ndarray, held: bool = True) -> DataFrame:
    """rows whose key's bit is set (held), or isn't."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = may_hold(shared.value, np.asarray(batch.column(batch.num_columns - 1), np.int64))
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(there == held))

    return map_batches(rows.withColumn("__key", key), run, schema)


def pick(rows: DataFrame, keys: DataFrame, on: list[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows whose columns ``on`` (never null in keys) occur in keys, which is written and has no repeated row.

    Few keys are broadcast. With more, a key filter lets most other rows go before what is
    left is joined by a shuffle.
    """
    if keys.count() <= limit:
        return rows.join(F.broadcast(keys), on, "left_semi")
    return sieve(rows, F.xxhash64(*on), key_filter(keys.select(F.xxhash64(*on).alias("key")))).join(keys, on, "left_semi")


def drop(rows: DataFrame, keys: DataFrame, on: list[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows whose columns ``on`` do not occur in keys: the rest of what pick() gives."""
    if keys.count() <= limit:
        return rows.join(F.broadcast(keys), on, "left_anti").select(*rows.columns)
    bitmap = key_filter(keys.select(F.xxhash64(*on).alias("key")))
    left = sieve(rows, F.xxhash64(*on), bitmap).join(keys, on, "left_anti").select(*rows.columns)
    return sieve(rows, F.xxhash64(*on), bitmap, held=False).unionByName(left)


class Batch:
    """The UTF-8 bytes of some texts (null: empty) and the words in them.

    ``data``: the bytes of all texts. ``ends``: where each text ends. ``start``, ``stop``:
    of each word. ``first``: number of words before each text, and of all at the end.
    """

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        joined = pc.fill_null(texts, "").cast(pa.large_binary())
        if isinstance(joined, pa.ChunkedArray):
            joined = joined.combine_chunks()
        offsets = np.frombuffer(joined.buffers()[1], dtype=np.int64)[joined.offset : joined.offset + len(joined) + 1]
        raw = joined.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(joined) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0] if len(joined) else np.zeros(1, np.int64)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.data, self.offsets, self.n = data, offsets, len(joined)
        self.solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(len(data), bool)  # a text begins here
        begins = offsets[:-1]
        edge[begins[begins < len(data)]] = True
        before = np.concatenate(([False], self.solid[:-1]))[: len(data)]
        after = np.concatenate((self.solid[1:], [False]))[: len(data)]
        last = np.concatenate((edge[1:], [True]))[: len(data)]
        self.start = np.flatnonzero(self.solid & (~before | edge))
        self.stop = np.flatnonzero(self.solid & (~after | last)) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.length = self.stop - self.start

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """An exact code for each word, and the distinct words by code."""
        ends = np.zeros(len(self.length) + 1, np.int64)
        np.cumsum(self.length, out=ends[1:])
        words = pa.Array.from_buffers(pa.large_binary(), len(self.length), [None, pa.py_buffer(ends), pa.py_buffer(self.data[self.solid])])
        coded = words.dictionary_encode()
        return np.asarray(coded.indices, dtype=np.int64), coded.dictionary

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sums of per-byte values for each text."""
        sums = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. c-1 for each c of counts, one after another."""
    if not len(counts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) - np.repeat(ends - counts, counts)
