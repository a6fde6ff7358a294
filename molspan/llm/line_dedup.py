"""Line dedup by content-defined chunks of lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, key_filter, lookup, map_batches, may_hold, sieve, slices

#: Lines that the rolling hash spans.
WINDOW = 2
#: A boundary follows one line in so many.
MEAN_LINES = 4
MASK = (1 << 64) - 1


def chunk_bounds(lines: list[bytes], window: int = WINDOW, mean: int = MEAN_LINES) -> list[int]:
    """Where chunks of lines begin, and the end.

    A polynomial over the hashes of the last ``window`` lines is rolled along; a boundary
    follows a line where the mixed value is 0 modulo ``mean``. So a boundary hangs on
    ``window`` lines only, and lines put in or left out elsewhere don't shift it.
    """
    factor = 0x9E3779B97F4A7C15
    leaving = pow(factor, window, 1 << 64)
    hashes = [xxhash.xxh3_64_intdigest(x) for x in lines]
    out, rolled = [0], 0
    for i, h in enumerate(hashes):
        rolled = (rolled * factor + h) & MASK
        if i >= window:
            rolled = (rolled - hashes[i - window] * leaving) & MASK
        mixed = ((rolled ^ (rolled >> 29)) * 0xBF58476D1CE4E5B9 & MASK) >> 32
        if mixed % mean == 0:
            out.append(i + 1)
    if out[-1] != len(lines):
        out.append(len(lines))
    return out


def chunks(text: str | None, least: int = 2, pairs: bool = False, **shape: int) -> Iterator[tuple[int, int, bytes]]:
    """(first line, lines, bytes) of each chunk of at least ``least`` lines that has a word.

    pairs: then also of each two lines with a word that follow each other, with the blank
    lines between them.
    """
    if not text:
        return
    lines = text.encode("utf-8").split(b"\n")
    bounds = chunk_bounds(lines, **shape)
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= least and (content := b"\n".join(lines[a:b])).strip(b" \t\n\x0b\x0c\r"):
            yield a, b - a, content
    if pairs:
        solid = [k for k, x in enumerate(lines) if x.strip(b" \t\n\x0b\x0c\r")]
        for a, b in zip(solid, solid[1:]):
            yield a, b + 1 - a, b"\n".join(lines[a : b + 1])


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 2, window: int = WINDOW, mean: int = MEAN_LINES, counts: bool = False, pairs: bool = False, digest_bits: int = 64) -> DataFrame:
    """docs with repeated chunks of lines taken out of text_col (counts: plus n_lines, n_removed_lines).

    Lines are what \\n splits. A chunk of at least ``least`` lines that has a word and whose
    bytes occur in several places stays where it comes first (smallest id, then line); its
    other places are taken out. All rows and columns stay; a text may become empty. A
    shorter chunk never goes, so a single repeated line stays.

    pairs: pairs of lines (see chunks()) are treated like chunks. So of any passage of two
    or more lines with a word that has an earlier place, all lines go from its first such
    line to its last, whatever the boundaries. A place that overlaps the first one, as in
    a run of equal lines, stays.

    Null text: null, 0 lines. An empty text has one (empty) line. Null ids come after all
    others. Rows alike in id and text are one document and are treated alike; rows with
    one id and several texts are documents of their own. Columns n_lines and
    n_removed_lines of docs are replaced if counts is set; those whose names begin with
    two underscores may not be there. Empty input: no rows.

    Scale: places are narrow rows; digests are counted with map-side sums, and hot ones are
    looked up without a task of their own. Bytes leave the scan only for digests that occur
    again, or that a bitmap of fixed size takes for such; they are grouped by digest and
    content once, combined in the map tasks first, so a digest of several contents (which
    is then told apart by its content) is seen. Only texts that lose something, or that
    another bitmap takes for such, are moved to their lists of places. digest_bits: bits of a
    digest, fewer only to test such digests.
    """
    shape = {"least": least, "window": window, "mean": mean, "pairs": pairs}
    kind, context = dict(docs.dtypes)[id_col], docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    short = (1 << digest_bits) - 1

    def scan(bitmap=None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in slices(batch.column(2)):
                    found = [(i, *c) for i, t in enumerate(batch.column(2)[a:b].to_pylist()) for c in chunks(t, **shape)]
                    digest = np.array([xxhash.xxh3_64_intdigest(x[3]) & short for x in found], np.uint64).view(np.int64)
                    if bitmap is not None:
                        some = np.flatnonzero(may_hold(bitmap.value, digest))
                        found, digest = [found[k] for k in some.tolist()], digest[some]
                    at = pa.array([x[0] for x in found], pa.int64())
                    made = [batch.column(0)[a:b].take(at), batch.column(1)[a:b].take(at), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int32()), pa.array(digest)]
                    names = ["id", "mark", "line", "lines", "digest"]
                    if bitmap is not None:
                        made.append(pa.array([x[3] for x in found], pa.binary()))
                        names.append("content")
                    yield pa.RecordBatch.from_arrays(made, names=names)

        return run

    schema = f"id {kind}, mark long, line int, lines int, digest long"
    found = cut(map_batches(rows, scan(), schema))
    again = cut(found.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    places = cut(lookup(found, again, ["digest"], "n"))
    again_bits = context.broadcast(key_filter(again.select(F.col("digest").alias("key"))))
    contents = map_batches(rows, scan(again_bits), schema + ", content binary")
    kinds = contents.groupBy("digest", "content").agg(F.count(F.lit(1)).alias("n"))
    clash = cut(kinds.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.sum("n").alias("n")).where("contents > 1").join(again.select("digest"), "digest", "left_semi"))

    place = F.struct(F.col("id").isNull().alias("late"), "id", "mark", "line")
    one = places if clash.isEmpty() else lookup(places, clash.select("digest", F.col("n").alias("__n"), F.lit(True).alias("__clash")), ["digest"], "__n", "left").where("__clash IS NULL").drop("__n", "__clash")
    first = cut(one.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    gone = lookup(one.select("digest", "id", "mark", "line", "lines"), first, ["digest"], "size").drop("size", "digest")
    if not clash.isEmpty():
        several = cut(lookup(contents, clash.select("digest", "n"), ["digest"], "n").drop("n"))
        first = cut(several.groupBy("digest", "content").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1"))
        gone = gone.unionByName(lookup(several, first, ["digest", "content"], "size").drop("size", "digest", "content"))
    here = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark"))
    gone = gone.where((place != F.col("first")) & ~(here & (F.col("line") < F.col("first.line") + F.col("lines"))))
    gone = cut(gone.groupBy("id", "mark").agg(F.collect_set(F.struct("line", "lines")).alias("__gone")).select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), "__gone"))

    columns = [c for c in docs.columns if not counts or c not in ("n_lines", "n_removed_lines")]
    here = docs.select(*columns, F.xxhash64(text_col).alias("__own"))
    lossy = key_filter(gone.select(F.xxhash64("__id", "__mark").alias("key")))
    key = F.xxhash64(id_col, "__own")
    joined = sieve(here, key, lossy).join(gone.hint("merge"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__mark")), "left").select(*columns, "__gone")
    out_schema = ", ".join(f"`{n}` {t}" for n, t in joined.drop("__gone").dtypes) + ", n_lines int, n_removed_lines int" * counts

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.get_field_index(text_col)
            texts = batch.column(where).to_pylist()
            lists = batch.column(len(columns)).to_pylist() if batch.num_columns > len(columns) else [None] * batch.num_rows
            new, total, lost = [], [], []
            for text, taken in zip(texts, lists):
                out = {k for x in taken or () for k in range(x["line"], x["line"] + x["lines"])}
                new.append(text if not out else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in out))
                total.append(0 if text is None else text.count("\n") + 1)
                lost.append(len(out))
            made = [batch.column(k) if k != where else pa.array(new, pa.string()) for k in range(len(columns))]
            more = [pa.array(total, pa.int32()), pa.array(lost, pa.int32())] if counts else []
            yield pa.RecordBatch.from_arrays([*made, *more], names=[*columns, *(["n_lines", "n_removed_lines"] if counts else [])])

    rest = sieve(here, key, lossy, held=False).select(*columns)
    return map_batches(joined, rewrite, out_schema).unionByName(map_batches(rest, rewrite, out_schema) if counts else rest)


def op7(spark, sf_dir: str) -> DataFrame:
    """Registered query: all ``documents``; doc_id, the text that is left, and counts of lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs, counts=True, pairs=True)
