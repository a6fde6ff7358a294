"""Column functions on how a read lies on its reference: operations, substitutions, coordinates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .marks import IN_READ, IN_REFERENCE, MD_PART, bytes_of, read_changes, to_lists


def aligned_blocks(ops: Column) -> Column:
    """array<struct<q, r, n>> of an array<struct<op, n>>: read and reference starts of what lies base on base. Null for null."""

    @F.arrow_udf("array<struct<q:bigint,r:bigint,n:bigint>>")
    def walk(ops: pa.Array) -> pa.Array:
        flat, count = ops.flatten(), np.asarray(pc.fill_null(pc.list_value_length(ops), 0), np.int64)
        op, n = np.asarray(flat.field(0), np.int64), np.asarray(flat.field(1), np.int64)
        read, reference = np.isin(op, IN_READ), np.isin(op, IN_REFERENCE)
        ends = np.concatenate(([0], np.cumsum(count)))
        row = np.repeat(np.arange(len(count)), count)
        out = []
        for step in (np.where(read, n, 0), np.where(reference, n, 0)):
            sums = np.concatenate(([0], np.cumsum(step)))
            out.append(sums[:-1] - sums[ends[row]])
        kept = read & reference & (n > 0)
        found = np.bincount(row[kept], minlength=len(count))
        values = pa.StructArray.from_arrays([pa.array(x[kept]) for x in (*out, n)], names=["q", "r", "n"])
        return nullable_lists(ops, values, found)

    return walk(ops.cast("array<struct<op:int,n:bigint>>"))


def nullable_lists(like: pa.Array, values: pa.Array, count: np.ndarray) -> pa.ListArray:
    """Lists of so many of the values each; null where ``like`` is."""
    ends = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32))
    return pa.ListArray.from_arrays(ends, values, mask=pc.is_null(like)) if like.null_count else pa.ListArray.from_arrays(ends, values)


def reference_of(blocks: Column, position: Column) -> Column:
    """Where a base of the read lies, from the reference start on; null outside of all blocks."""
    holding = F.filter(blocks, lambda b: (b["q"] <= position) & (position < b["q"] + b["n"]))
    return F.when(F.size(holding) > 0, F.get(holding, F.lit(0))["r"] + position - F.get(holding, F.lit(0))["q"])


def read_of(blocks: Column, offset: Column) -> Column:
    """The base of the read that lies at a reference offset; null if none does."""
    holding = F.filter(blocks, lambda b: (b["r"] <= offset) & (offset < b["r"] + b["n"]))
    return F.when(F.size(holding) > 0, F.get(holding, F.lit(0))["q"] + offset - F.get(holding, F.lit(0))["r"])


def reference_block(blocks: Column, start: Column, n: Column) -> Column:
    """struct<start, stop> of an interval on the read; null unless both its end bases lie on the reference."""
    a, b = reference_of(blocks, start), reference_of(blocks, start + n - 1)
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.least(a, b).alias("start"), (F.greatest(a, b) + 1).alias("stop")))


def substitutions(md: Column) -> Column:
    """array<struct<r, base>> of an MD text: reference offset and reference base of each substitution. Null for null."""

    @F.arrow_udf("array<struct<r:bigint,base:string>>")
    def walk(md: pa.Array) -> pa.Array:
        at, base, count = [], [], []
        for text in md.to_pylist():
            here = found = 0
            for number, gap, letter in MD_PART.findall((text or "").upper()):
                if letter:
                    at.append(here)
                    base.append(letter)
                    found += 1
                here += int(number) if number else len(gap) if gap else 1
            count.append(found)
        values = pa.StructArray.from_arrays([pa.array(at, pa.int64()), pa.array(base, pa.string())], names=["r", "base"])
        return nullable_lists(md, values, np.array(count, np.int64))

    return walk(md)


def deaminations(md: Column, ops: Column, seq: Column) -> Column:
    """struct<ct, ga>: read positions where C became T, and G became A, by the MD text; empty where it can't tell."""

    @F.arrow_udf("struct<ct:array<bigint>,ga:array<bigint>>")
    def walk(md: pa.Array, ops: pa.Array, seq: pa.Array) -> pa.Array:
        found: tuple[list, list] = [], []
        for text, steps, letters in zip(md.to_pylist(), ops.to_pylist(), seq.to_pylist()):
            changes = None if text is None or steps is None or letters is None else read_changes(np.frombuffer(letters.upper().encode(), np.uint8), [(x["op"], x["n"]) for x in steps], text)
            for out, at in zip(found, changes or ((), ())):
                out.append(np.asarray(at, np.int64))
        return pa.StructArray.from_arrays([to_lists(x, pa.int64()) for x in found], names=["ct", "ga"])

    return walk(md, ops.cast("array<struct<op:int,n:bigint>>"), seq)


def stamp(seq: Column, positions: Column, sign: str) -> Column:
    """The sequence with ``sign`` (Y or R) written at 0-based positions; those outside are passed by."""

    @F.arrow_udf("string")
    def write(seq: pa.Array, positions: pa.Array) -> pa.Array:
        data, length = bytes_of(seq)
        at = positions.flatten()
        if not at.null_count and (data < 128).all():  # all at once
            edge, row = np.concatenate(([0], np.cumsum(length))), np.repeat(np.arange(len(seq)), np.asarray(pc.fill_null(pc.list_value_length(positions), 0), np.int64))
            at, data = np.asarray(at, np.int64), data.copy()
            inside = (at >= 0) & (at < length[row])
            data[edge[row[inside]] + at[inside]] = ord(sign)
            made = pa.StringArray.from_buffers(len(seq), pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(data))
            return pc.if_else(pc.is_valid(seq), made, pa.scalar(None, pa.string()))
        out = []
        for text, at in zip(seq.to_pylist(), positions):
            if text is None or not at.is_valid:
                out.append(text)
                continue
            letters, where = np.frombuffer(text.encode("utf-32-le"), np.uint32).copy(), np.asarray(at.values, np.int64)
            letters[where[(where >= 0) & (where < len(letters))]] = ord(sign)
            out.append(letters.tobytes().decode("utf-32-le"))
        return pa.array(out, pa.string())

    return write(seq, positions)
