"""Marks of molecules, from tags of modified bases, ambiguity signs and alignments. Kernels on Arrow arrays, and columns made of them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molspan.session import map_batches

# Fixed values of the formats: complements, bases that each mode takes marks on, how far operations go.
COMPLEMENT = bytes.maketrans(b"ACGTUN", b"TGCAAN")
ADMITTED = {"pacbio-fiber": "AT", "nanopore-fiber": "A", "daf": "ACGT"}
ALIASES = {"nanopore": "nanopore-fiber", "stranded": "nanopore-fiber", "pacbio": "pacbio-fiber", "m6a": "pacbio-fiber"}
IN_READ, IN_REFERENCE, IN_MD = (0, 1, 4, 7, 8), (0, 2, 3, 7, 8), (0, 2, 7, 8)
MD_PART = re.compile(r"(\d+)|\^([A-Za-z]+)|([A-Za-z])")

Marks = tuple[str, str, np.ndarray, np.ndarray]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts (null: empty) end to end, and their lengths."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    joined = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
    raw = joined.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(joined) else np.zeros(0, np.uint8)
    return data, np.diff(offsets)


def upper(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 97) & (data <= 122), data - 32, data).astype(np.uint8)


def parse(mm: str | None, ml: np.ndarray | None, seq: np.ndarray, reverse: bool) -> Iterator[Marks]:
    """(base, code, positions, qualities) of each specification of an MM text, positions as seq is stored.

    A specification is ``base strand code skips``; skips count bases of that kind in the
    direction the molecule was read, so from the end of seq if ``reverse``. One without
    skips is passed by. Qualities are taken from ml in the text's order, whatever becomes
    of the marks; marks beyond the last base or the last quality go. seq: upper-case bytes.
    """
    if not mm or ml is None:
        return
    taken = 0
    for spec in mm.split(";"):
        head, _, rest = spec.partition(",")
        if not rest or not head:
            continue
        try:
            skips = np.array(rest.split(","), np.int64) if len(rest) < 64 else np.fromstring(rest, np.int64, sep=",")
        except ValueError:
            continue
        base = head[0].upper()
        wanted = base.encode().translate(COMPLEMENT) if reverse else base.encode()
        places = np.flatnonzero(seq == wanted[0])
        if reverse:
            places = places[::-1]
        ordinal = np.cumsum(skips) + np.arange(len(skips))
        quality = np.asarray(ml[taken : taken + len(skips)], np.int64)
        taken += len(skips)
        there = ordinal[: len(quality)] < len(places)
        yield base, head[2:3], places[ordinal[: len(quality)][there]], quality[there]


def kept_places(mm: str | None, ml: np.ndarray | None, seq: np.ndarray, reverse: bool, threshold: int, mode: str, codes: str | None = None) -> np.ndarray:
    """Positions of marks of a mode with at least the quality ``threshold``, in the text's order. codes: only these letters."""
    bases = ADMITTED[ALIASES.get(mode, mode)]
    found = [at[q >= threshold] for base, code, at, q in parse(mm, ml, seq, reverse) if base in bases and (codes is None or code in codes)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def kept_marks(*read: object, **choice: object) -> np.ndarray:
    """kept_places() in order, each once."""
    return np.unique(kept_places(*read, **choice))


#: MM texts that parse_batch() reads all at once; others are read one by one.
PLAIN = r"^(?:(?:[A-Za-z][+-][A-Za-z0-9?.]*(?:,[0-9]{1,9})*)?;)*(?:[A-Za-z][+-][A-Za-z0-9?.]*(?:,[0-9]{1,9})*)?$"


class Found(NamedTuple):
    """Marks of a batch, by row and then in the text's order; base and code are ASCII numbers (code 0: none)."""

    row: np.ndarray
    base: np.ndarray
    code: np.ndarray
    at: np.ndarray
    quality: np.ndarray


def parse_batch(mm: pa.Array, ml: pa.Array, seq: pa.Array, reverse: pa.Array) -> Found:
    """parse() of all rows of a batch at once."""
    data, length = bytes_of(seq)
    data, edge = upper(data), np.concatenate(([0], np.cumsum(length)))
    turned = np.asarray(pc.fill_null(reverse, False), bool)
    flat, sizes, there = ml.flatten(), np.asarray(pc.fill_null(pc.list_value_length(ml), 0), np.int64), np.asarray(pc.is_valid(ml))
    named = there & np.asarray(pc.fill_null(pc.not_equal(mm, ""), False))
    plain = named & np.asarray(pc.fill_null(pc.match_substring_regex(mm, PLAIN), False)) if not flat.null_count else np.zeros(len(mm), bool)
    parts = [plain_marks(np.flatnonzero(plain), mm, np.asarray(flat), np.cumsum(sizes) - sizes, sizes, data, edge, turned)]
    odd = np.flatnonzero(named & ~plain)
    if len(odd):
        pick = pa.array(odd)
        for r, read in zip(odd.tolist(), each_read(mm.take(pick), ml.take(pick), seq.take(pick), reverse.take(pick))):
            for base, code, at, quality in parse(*read):
                parts.append(Found(*[np.full(len(at), x, np.int64) for x in (r, ord(base[0]), ord(code or "\0"))], at, quality))
        joined = [np.concatenate(x) for x in zip(*parts)]
        order = np.argsort(joined[0], kind="stable")
        return Found(*[x[order] for x in joined])
    return parts[0]


def plain_marks(rows: np.ndarray, mm: pa.Array, ml: np.ndarray, ml_first: np.ndarray, ml_size: np.ndarray, data: np.ndarray, edge: np.ndarray, turned: np.ndarray) -> Found:
    """parse_batch() of rows whose texts are PLAIN."""
    specs = pc.split_pattern(mm.take(pa.array(rows, pa.int64())), ";")
    tokens = pc.split_pattern(specs.flatten(), ",")
    owner = np.repeat(rows, np.asarray(pc.list_value_length(specs), np.int64))
    count = np.asarray(pc.list_value_length(tokens), np.int64) - 1
    first = np.cumsum(count + 1) - count - 1
    words = tokens.flatten()
    some = count > 0
    first, count, owner = first[some], count[some], owner[some]
    heads = words.take(pa.array(first)).cast(pa.binary())
    head = np.frombuffer(b"".join(h[:3].ljust(3, b"\0") for h in heads.to_pylist()), np.uint8).reshape(-1, 3)
    base, code = upper(head[:, 0]).astype(np.int64), head[:, 2].astype(np.int64)
    spec = np.repeat(np.arange(len(count)), count)
    starts = np.cumsum(count) - count
    k = np.arange(len(spec)) - starts[spec]
    skips = np.asarray(words.take(pa.array(first[spec] + 1 + k)).cast(pa.int64()), np.int64)
    sums = np.concatenate(([0], np.cumsum(skips)))
    ordinal = sums[1:] - sums[starts[spec]] + k
    row = owner[spec]
    # qualities are taken in the text's order over all specifications of a row
    leads = np.searchsorted(row, row, "left")
    nth = np.arange(len(row)) - leads
    told = nth < ml_size[row]
    spec, row, ordinal, nth = spec[told], row[told], ordinal[told], nth[told]
    quality = np.asarray(ml[ml_first[row] + nth], np.int64)
    complement = np.frombuffer(bytes(range(256)).translate(COMPLEMENT), np.uint8)
    back = turned[row]
    wanted = np.where(back, complement[base[spec]], base[spec])
    at = np.full(len(row), -1, np.int64)
    for letter in np.unique(wanted).tolist():
        these = np.flatnonzero(wanted == letter)
        places = np.flatnonzero(data == letter)
        before = np.concatenate(([0], np.cumsum(data == letter)))
        r = row[these]
        low, high = before[edge[r]], before[edge[r + 1]]
        index = np.where(back[these], high - 1 - ordinal[these], low + ordinal[these])
        good = ordinal[these] < high - low
        at[these[good]] = places[index[good]] - edge[r[good]]
    on = at >= 0
    return Found(row[on], base[spec[on]], code[spec[on]], at[on], quality[on])


def kept_lists(found: Found, rows: int, length: int, threshold: int, mode: str, codes: str | None = None) -> pa.ListArray:
    """array<int> of kept_marks() for each row of a batch; length: of the longest read at least."""
    good = (found.quality >= threshold) & np.isin(found.base, list(ADMITTED[ALIASES.get(mode, mode)].encode()))
    if codes is not None:
        good &= np.isin(found.code, [ord(c) for c in codes]) | (found.code == 0)
    line = np.unique(found.row[good] * max(length, 1) + found.at[good])
    ends = np.concatenate(([0], np.cumsum(np.bincount(line // max(length, 1), minlength=rows))))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(line % max(length, 1), pa.int32()))


def mm_text(seq: np.ndarray, reverse: bool, base: str, code: str, positions: np.ndarray) -> str:
    """The specification that marks positions of one kind of base; positions of other bases are left out."""
    wanted = base.encode().translate(COMPLEMENT) if reverse else base.encode()
    places = np.flatnonzero(seq == wanted[0])
    ordinal = np.flatnonzero(np.isin(places[::-1] if reverse else places, positions))
    skips = np.diff(ordinal, prepend=-1) - 1
    return f"{base}+{code}" + "".join(f",{x}" for x in skips.tolist()) + ";"


def each_read(mm: pa.Array, ml: pa.Array, seq: pa.Array, reverse: pa.Array) -> Iterator[tuple[str | None, np.ndarray | None, np.ndarray, bool]]:
    """The four of each row, seq as upper-case bytes."""
    data, length = bytes_of(seq)
    data, at = upper(data), 0
    values, sizes, filled = np.asarray(ml.flatten()), np.asarray(pc.fill_null(pc.list_value_length(ml), 0), np.int64), np.asarray(pc.is_valid(ml))
    m = 0
    for text, n, k, there, r in zip(mm.to_pylist(), length.tolist(), sizes.tolist(), filled.tolist(), pc.fill_null(reverse, False).to_pylist()):
        yield text, values[m : m + k] if there else None, data[at : at + n], r
        at, m = at + n, m + k


def to_lists(found: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), kind))


def numbers(lists: pa.ListArray) -> list[np.ndarray | None]:
    """Lists of numbers as arrays."""
    n, flat = pc.list_value_length(lists).to_pylist(), np.asarray(lists.flatten(), np.int64)
    out, at = [], 0
    for k in n:
        out.append(None if k is None else flat[at : at + k])
        at += k or 0
    return out


def schema_fields(ddl: str) -> list[pa.Field]:
    """Arrow fields of a schema, worked out on the driver."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return [pa.field(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(ddl).fields]


def marks(mm: Column, ml: Column, seq: Column, reverse: Column, *, mode: str, threshold: int = 125, codes: str | None = None) -> Column:
    """array<int>: kept_marks() of each row; empty without tags."""

    @F.arrow_udf("array<int>")
    def find(mm: pa.Array, ml: pa.Array, seq: pa.Array, reverse: pa.Array) -> pa.Array:
        longest = pc.max(pc.binary_length(seq)).as_py() or 0
        return kept_lists(parse_batch(mm, ml, seq, reverse), len(seq), longest, threshold, mode, codes)

    return find(mm, ml.cast("array<int>"), seq, reverse)


def marks_by_kind(reads: DataFrame, *, id_col: str = "read_id") -> DataFrame:
    """(id, base, code, pos, quality): every mark of rows (id, mm, ml, seq, is_reverse), whatever its quality."""
    kind = dict(reads.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = parse_batch(*batch.columns[1:])
            text = lambda x: pa.array([*map(chr, (u := np.unique(x, return_inverse=True))[0].tolist())], pa.string()).take(pa.array(u[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found.row)), text(found.base), pc.replace_substring(text(found.code), "\0", ""), pa.array(found.at, pa.int32()), pa.array(found.quality, pa.int32())], names=[id_col, "base", "code", "pos", "quality"])

    return map_batches(reads.select(id_col, "mm", F.col("ml").cast("array<int>").alias("ml"), "seq", "is_reverse"), run, f"`{id_col}` {kind}, base string, code string, pos int, quality int")


def tagged(seq: Column, reverse: Column, positions: Column, *, base: str, code: str) -> Column:
    """string: the MM text that marks positions array<int> of one kind of base."""

    @F.arrow_udf("string")
    def write(seq: pa.Array, reverse: pa.Array, positions: pa.Array) -> pa.Array:
        none = pa.nulls(len(seq), pa.string())
        rows = each_read(none, positions, seq, reverse)
        return pa.array([mm_text(s, r, base, code, np.zeros(0, np.int64) if at is None else at) for _, at, s, r in rows], pa.string())

    return write(seq, reverse, positions.cast("array<int>"))


# Deaminations


def aligned(ops: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(read positions, reference offsets) of the bases that lie on each other."""
    q = r = 0
    at, on = [], []
    for op, n in ops:
        if op in IN_READ and op in IN_REFERENCE:
            at.append(np.arange(q, q + n))
            on.append(np.arange(r, r + n))
        q += n * (op in IN_READ)
        r += n * (op in IN_REFERENCE)
    none = np.zeros(0, np.int64)
    return (np.concatenate(at), np.concatenate(on)) if at else (none, none)


def md_span(md: str) -> int:
    """Reference bases that an MD text tells of."""
    return sum(int(a) if a else len(b) if b else 1 for a, b, c in MD_PART.findall(md))


def md_fits(md: str | None, ops: list[tuple[int, int]] | None) -> bool:
    """Whether an MD text and operations tell of as many reference bases; true if either is missing."""
    return md is None or ops is None or md_span(md) == sum(n for op, n in ops if op in IN_MD)


def md_reference(md: str, ops: list[tuple[int, int]], seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(read positions, reference bases as bytes) where the MD text tells of a substitution."""
    # MD passes by skipped reference and inserts, so offsets count aligned and deleted bases only
    off, q, m = 0, [], []
    where, told = 0, []
    for op, n in ops:
        if op in IN_READ and op in IN_MD:
            q.append(np.arange(where, where + n))
            m.append(np.arange(off, off + n))
        where += n * (op in IN_READ)
        off += n * (op in IN_MD)
    at = 0
    for number, gap, base in MD_PART.findall(md):
        if base:
            told.append((at, ord(base.upper())))
        at += int(number) if number else len(gap) if gap else 1
    if not told or not q:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    q, m = np.concatenate(q), np.concatenate(m)
    offsets = np.array([x for x, _ in told])
    k = np.searchsorted(m, offsets)
    there = (k < len(m)) & (m[np.minimum(k, len(m) - 1)] == offsets)
    return q[k[there]], np.array([b for _, b in told], np.uint8)[there]


def deaminated(positions: np.ndarray, reference: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(C now T, G now A) of read positions whose reference bases are known. seq: upper-case bytes."""
    inside = positions < len(seq)
    positions, reference = positions[inside], reference[inside]
    now = seq[positions]
    return positions[(reference == ord("C")) & (now == ord("T"))], positions[(reference == ord("G")) & (now == ord("A"))]


def conversion(n_ct: int, n_ga: int, forced: str | None = None) -> str | None:
    """CT or GA, as most of the changes say; None for a tie."""
    if forced:
        return forced.upper()
    return "CT" if n_ct > n_ga else "GA" if n_ga > n_ct else None


def is_chimera(ct: np.ndarray, ga: np.ndarray, least: int = 5, purity: float = 0.8) -> bool:
    """Whether changes of the two kinds change over at some point of the read; at one place GA comes before CT."""
    if min(len(ct), len(ga)) < least or len(ct) + len(ga) < 2 * least:
        return False
    order = np.lexsort((np.concatenate((np.ones(len(ct)), np.zeros(len(ga)))), np.concatenate((ct, ga))))
    is_ct = order < len(ct)
    left_ct, n = np.cumsum(is_ct)[:-1], np.arange(1, len(is_ct))
    left_ga, right_ct = n - left_ct, len(ct) - left_ct
    right_ga = len(is_ct) - n - right_ct
    strong = lambda x, m: (x >= least) & (x >= purity * m)
    far = len(is_ct) - n
    return bool(((strong(left_ct, n) & strong(right_ga, far)) | (strong(left_ga, n) & strong(right_ct, far))).any())


def read_changes(seq: np.ndarray, ops: list[tuple[int, int]] | None, md: str | None, reference: str | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """(C now T, G now A) of a read by its MD text, else by the reference it lies on; None if neither can tell."""
    if ops is None:
        return None
    if md is not None and md_fits(md, ops):
        return deaminated(*md_reference(md, ops, seq), seq)
    if reference is None:
        return None
    at, on = aligned(ops)
    ref = np.frombuffer(reference.upper().encode(), np.uint8)
    inside = on < len(ref)
    return deaminated(at[inside], ref[on[inside]], seq)


def stamped(reads: DataFrame, *, forced: str | None = None) -> DataFrame:
    """reads (…, seq[, cigar, md, ref_seq]) with C>T written as Y or G>A as R, plus st (CT, GA), n_ct, n_ga and chimera.

    The strand is that of the more changes, or ``forced``. Where it can't be told, from a tie
    or from missing alignments, seq stays and st is null. ref_seq, the reference bases that
    the read spans, stands in for a missing or unfitting MD text. seq may be null.
    """
    columns = [c for c in reads.columns if c not in ("st", "n_ct", "n_ga", "chimera")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(columns.index(name)).to_pylist() if name in columns else [None] * batch.num_rows  # noqa: E731, B023
            new, strand, counts, mixed = [], [], [], []
            for seq, ops, md, ref in zip(get("seq"), get("cigar"), get("md"), get("ref_seq")):
                pairs = None if ops is None else [(x["op"], x["n"]) for x in ops]
                changes = None if seq is None else read_changes(np.frombuffer(seq.upper().encode(), np.uint8), pairs, md, ref)
                ct, ga = changes if changes is not None else (np.zeros(0, np.int64),) * 2
                way = conversion(len(ct), len(ga), forced) if changes is not None and (forced or len(ct) + len(ga)) else None
                if way:
                    letters = bytearray(seq, "ascii")
                    for k in ct if way == "CT" else ga:
                        letters[k] = 89 if way == "CT" else 82
                    seq = letters.decode()
                new.append(seq)
                strand.append(way)
                counts.append((len(ct), len(ga)))
                mixed.append(is_chimera(ct, ga))
            kept = [batch.column(k) if c != "seq" else pa.array(new, pa.string()) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(strand, pa.string()), pa.array([a for a, _ in counts], pa.int32()), pa.array([b for _, b in counts], pa.int32()), pa.array(mixed, pa.bool_())], names=[*columns, "st", "n_ct", "n_ga", "chimera"])

    rows = reads.select(*columns)
    return map_batches(rows, run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", st string, n_ct int, n_ga int, chimera boolean")
