"""Functions of this library for SQL: ``register(spark, model)``, then ``SELECT mark_positions(mm, ml, seq, is_reverse) ...``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from molspan.functions.chain import Model, accessible_chance, decode, flat_lists, to_lists
from molspan.functions.encoding import NUMBER, mark_mask, observe, resolved
from molspan.functions.marks import bytes_of, each_read, kept_marks, upper
from molspan.functions.marks import to_lists as position_lists


def register(spark: SparkSession, model: Model | None = None, *, mode: str = "pacbio-fiber", k: int = 3, trim: int = 10, threshold: int = 125) -> list[str]:
    """Registers the functions and returns their names.

    mark_positions(mm, ml, seq, is_reverse): array<int>. symbols(seq, positions, is_reverse):
    array<int>. reverse_complement(seq). With a model: decode(codes): array<int> of states,
    protected(codes): array<double>. Table functions: state_runs(states): (state, start, stop),
    and annotations(ma): (kind, start, n).
    """

    @F.arrow_udf("array<int>")
    def mark_positions(mm: pa.Array, ml: pa.Array, seq: pa.Array, reverse: pa.Array) -> pa.Array:
        return position_lists([kept_marks(*r, threshold, mode) for r in each_read(mm, ml, seq, reverse)], pa.int32())

    @F.arrow_udf("array<int>")
    def symbols(seq: pa.Array, positions: pa.Array, reverse: pa.Array) -> pa.Array:
        data, length = bytes_of(seq)
        at = [np.array(x or [], np.int64) for x in positions.to_pylist()]
        codes = observe(NUMBER[resolved(upper(data))], length, mark_mask(length, at), mode=mode, k=k, trim=trim, reverse=np.array([bool(x) for x in reverse.to_pylist()], bool))
        return to_lists(codes, length, pa.int32())

    @F.arrow_udf("string")
    def reverse_complement(seq: pa.Array) -> pa.Array:
        turn = str.maketrans("ACGTacgtNn", "TGCAtgcaNn")
        return pa.array([None if x is None else x.translate(turn)[::-1] for x in seq.to_pylist()], pa.string())

    found = {"mark_positions": mark_positions, "symbols": symbols, "reverse_complement": reverse_complement}
    if model is not None:

        @F.arrow_udf("array<int>")
        def decoded(codes: pa.Array) -> pa.Array:
            flat, length = flat_lists(codes)
            return to_lists(decode(np.asarray(flat, np.int64), length, model), length, pa.int32())

        @F.arrow_udf("array<double>")
        def protected(codes: pa.Array) -> pa.Array:
            flat, length = flat_lists(codes)
            return to_lists(1 - accessible_chance(np.asarray(flat, np.int64), length, model), length, pa.float64())

        found |= {"decode": decoded, "protected": protected}
    for name, f in found.items():
        spark.udf.register(name, f)
    for name, f in (("state_runs", StateRuns), ("annotations", Annotations)):
        spark.udtf.register(name, f)
    return [*found, "state_runs", "annotations"]


@F.udtf(returnType="state int, start int, stop int")
class StateRuns:
    def eval(self, states: list[int]) -> Iterator[tuple[int, int, int]]:
        start = 0
        for i in range(1, len(states or []) + 1):
            if i == len(states) or states[i] != states[start]:
                yield states[start], start, i
                start = i


@F.udtf(returnType="kind string, start int, n int")
class Annotations:
    def eval(self, ma: str) -> Iterator[tuple[str, int, int]]:
        from molspan.operators.extract import annotations

        for r in annotations(ma)[1] if ma else []:
            yield r["kind"], r["start"], r["n"]
