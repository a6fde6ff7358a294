"""Bases and marks of molecules as symbols of the chain: one symbol for each context, marked or bare."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .marks import ALIASES, bytes_of, upper

# The order of bases in a code, so that the complement is an exclusive or with 2.
ORDER = b"ACTG"
NUMBER = np.full(256, 4, np.uint8)
for _k, _b in enumerate(ORDER):
    NUMBER[[_b, _b + 32]] = _k
MODES = ("pacbio-fiber", "nanopore-fiber", "daf")


def alphabet(k: int) -> int:
    """Contexts of k bases on both sides; also the symbol of a marked base that is no target."""
    return 4 ** (2 * k)


def n_symbols(k: int) -> int:
    return 2 * (alphabet(k) + 1)


def is_hit(codes: np.ndarray, k: int) -> np.ndarray:
    return codes < alphabet(k)


def is_miss(codes: np.ndarray, k: int) -> np.ndarray:
    return (codes > alphabet(k)) & (codes < n_symbols(k) - 1)


def windows(base: np.ndarray, k: int, turned: bool) -> np.ndarray:
    """Number of the k bases from each place on, read in base four (turned: of their complement, read backwards)."""
    out = np.zeros(max(0, len(base) - k + 1), np.uint16 if k <= 8 else np.int64)
    for j in range(k):
        part = base[j : len(base) - k + 1 + j]
        out += (part ^ 2).astype(out.dtype) << (2 * j) if turned else part.astype(out.dtype) << (2 * (k - 1 - j))
    return out


def contexts_at(base: np.ndarray, at: np.ndarray, k: int, turned: bool) -> tuple[np.ndarray, np.ndarray]:
    """(codes, known) of the contexts about places ``at`` of bases as numbers; every place has k bases on both sides."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    safe = np.where(base > 3, 0, base) if (unknown := base > 3).any() else base
    value = windows(safe, k, turned).astype(np.int64)
    left, right = (value[at + 1], value[at - k]) if turned else (value[at - k], value[at + 1])
    known = np.ones(len(at), bool)
    if unknown.any():
        before = np.concatenate(([0], np.cumsum(unknown)))
        known = (before[at] == before[at - k]) & (before[at + k + 1] == before[at + 1])
    return (left << (2 * k)) | right, known


def observe(base: np.ndarray, length: np.ndarray, marked: np.ndarray, *, mode: str, k: int = 3, trim: int = 10, reverse: np.ndarray | None = None, strand: list[str | None] | None = None) -> np.ndarray:
    """The symbol of each base of reads laid end to end.

    base: numbers in ORDER, 4 for any other; marked: whether a base has a mark. Symbols of
    marked targets are their contexts' codes, those of bare ones lie alphabet(k) + 1 above;
    any other base is the last symbol. Targets are at least max(k, trim) bases from the ends
    and have known bases about them. pacbio-fiber: A, and T read backwards. nanopore-fiber:
    A, in reverse reads T alone. daf: on the strand + a C, deaminated ones being marked
    Ts; on - (or unknown) a G, deaminated ones being marked As, read backwards; contexts
    are those before the change. reverse and strand are by read.
    """
    mode = ALIASES.get(mode, mode)
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode!r}; one of {', '.join(MODES)}")
    top, margin = alphabet(k), max(k, trim)
    out = np.full(len(base), 2 * top + 1, np.int32)
    inside = np.zeros(len(base), bool)
    ends = np.cumsum(length)
    for a, b in zip((ends - length + margin).tolist(), (ends - margin).tolist()):
        if b > a:
            inside[a:b] = True

    def by_read(flags: np.ndarray) -> np.ndarray:
        return np.repeat(flags, length)

    def put(at: np.ndarray, hit: np.ndarray, bases: np.ndarray, turned: bool) -> None:
        code, known = contexts_at(bases, at, k, turned)
        at, code, hit = at[known], code[known], hit[known]
        out[at] = np.where(hit, code, code + top + 1)

    if mode != "daf":
        backwards = np.zeros(len(length), bool) if reverse is None else np.asarray(reverse, bool)
        one_way = mode == "nanopore-fiber" and backwards.any()
        for number, turned in ((0, False), (2, True)):
            here = inside & (base == number)
            if mode == "nanopore-fiber":
                if turned and not one_way:
                    continue
                if one_way:
                    here &= by_read(backwards == turned)
            at = np.flatnonzero(here)
            put(at, marked[at], base, turned)
        return out
    plus = np.array([s == "+" for s in strand] if strand is not None else np.zeros(len(length), bool), bool)
    forward = by_read(plus)
    for flags, before, after, turned in ((forward, 1, 2, False), (~forward, 3, 0, True)):
        changed = flags & marked & (base == after)
        bases = np.where(changed, before, base).astype(np.uint8)
        at = np.flatnonzero(inside & flags & (changed | (base == before) & ~marked))
        put(at, changed[at], bases, turned)
    return out


def mark_mask(length: np.ndarray, positions: list[np.ndarray]) -> np.ndarray:
    """One flag a base of reads laid end to end; positions outside a read are passed by."""
    out = np.zeros(int(length.sum()), bool)
    first = np.cumsum(length) - length
    for a, n, at in zip(first.tolist(), length.tolist(), positions):
        if len(at):
            out[a + at[(at >= 0) & (at < n)]] = True
    return out


def ambiguous(data: np.ndarray, tag: str | None) -> tuple[np.ndarray, str]:
    """(positions, strand) of Y or R in upper-case bytes: the kind that st (CT, GA) names, else the commoner one; a tie is '.'."""
    y, r = np.flatnonzero(data == 89), np.flatnonzero(data == 82)
    way = {"CT": "+", "GA": "-"}.get((tag or "").upper()) or ("+" if len(y) > len(r) else "-" if len(r) > len(y) else ".")
    return (y if way == "+" else r if way == "-" else np.union1d(y, r)), way


def resolved(data: np.ndarray) -> np.ndarray:
    """Upper-case bytes with Y as T and R as A."""
    return np.where(data == 89, 84, np.where(data == 82, 65, data)).astype(np.uint8)


def symbols(seq: Column, positions: Column, *, mode: str, k: int = 3, trim: int = 10, reverse: Column | None = None, strand: Column | None = None) -> Column:
    """array<int>: observe() of each row; positions array<int> are the marks. Y and R in seq are read as T and A."""

    @F.arrow_udf("array<int>")
    def encode(seq: pa.Array, positions: pa.Array, reverse: pa.Array, strand: pa.Array) -> pa.Array:
        data, length = bytes_of(seq)
        at, row = np.asarray(positions.flatten(), np.int64), np.repeat(np.arange(len(length)), np.asarray(pc.fill_null(pc.list_value_length(positions), 0), np.int64))
        inside = (at >= 0) & (at < length[row])
        marked = np.zeros(int(length.sum()), bool)
        marked[(np.cumsum(length) - length)[row[inside]] + at[inside]] = True
        codes = observe(NUMBER[resolved(upper(data))], length, marked, mode=mode, k=k, trim=trim, reverse=np.asarray(pc.fill_null(reverse, False), bool), strand=strand.to_pylist())
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.array(codes, pa.int32()))

    return encode(seq, positions.cast("array<int>"), F.lit(False) if reverse is None else reverse, F.lit(None).cast("string") if strand is None else strand)


def context_names(k: int) -> list[str]:
    """The 2k flanking bases of each code, as text."""
    letters = ORDER.decode()
    out = [""]
    for _ in range(2 * k):
        out = [x + c for x in out for c in letters]
    return out


def iter_contexts(k: int, centre: str) -> Iterator[tuple[int, str]]:
    """(code, context of 2k + 1 bases) of every code."""
    for code, flanks in enumerate(context_names(k)):
        yield code, flanks[:k] + centre + flanks[k:]
