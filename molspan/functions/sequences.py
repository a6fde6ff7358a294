"""Column functions on sequences, marks, tags and intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgtNn", "TGCAtgcaNn"))


def has_ambiguity(seq: Column) -> Column:
    return F.upper(seq).rlike("[RY]")


def resolve_ambiguity(seq: Column) -> Column:
    """The sequence with Y as T and R as A."""
    return F.translate(F.upper(seq), "YR", "TA")


def sign_positions(seq: Column, sign: str) -> Column:
    """0-based positions of a one-letter sign; empty for null."""
    letters = F.split(F.coalesce(seq, F.lit("")), "")
    return F.transform(F.filter(F.transform(letters, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: x["c"] == sign), lambda x: x["i"])


def count_sign(seq: Column, sign: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, sign, ""))


def strand_of(forward: Column, reverse: Column) -> Column:
    """Of two counts: + for more forward ones, - for more reverse ones, else a full stop."""
    return F.when(forward > reverse, "+").when(reverse > forward, "-").otherwise(".")


def md_length(md: Column) -> Column:
    """Reference bases that an MD text spans: its numbers, substitutions and deletions."""
    numbers = F.aggregate(F.transform(F.regexp_extract_all(md, F.lit(r"(\d+)")), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return numbers + F.length(F.regexp_replace(md, r"[^A-Za-z]", ""))


def llr_byte(llr: Column) -> Column:
    """Ten times the ratio, half to even, within a byte."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.bround(llr * 10, 0))).cast("int")


def byte_llr(byte: Column) -> Column:
    return byte / F.lit(10.0)


def edge_byte(bases: Column) -> Column:
    """255 for a sharp edge, 0 from 30 bases on."""
    return F.when(bases <= 0, 255).when(bases >= 30, 0).otherwise(F.bround(255 * (1 - bases / F.lit(30.0)), 0)).cast("int")


def unit_byte(x: Column) -> Column:
    """A probability as a byte, cut off."""
    return F.least(F.greatest(x * 255, F.lit(0.0)), F.lit(255.0)).cast("int")


def bytes_text(values: Column) -> Column:
    """An array of numbers 0 to 255 as bytes in base 64, on one line."""
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x), 2, "0")), ""))), "\r\n", "")


def flip(start: Column, n: Column, length: Column) -> Column:
    """Start of an interval seen from the other strand; its own inverse."""
    return length - (start + n)


def haplotype(value: Column) -> Column:
    """A tag as a 32-bit number, -1 where it is none."""
    return F.coalesce(value.try_cast("int"), F.lit(-1))


def sample_token(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[\s.]+", "_"), r"^_+|_+$", "")


def main_chromosome(name: Column) -> Column:
    """Whether a contig is a numbered, sex or mitochondrial chromosome rather than a scaffold."""
    bare = F.regexp_replace(F.upper(name), "^CHR", "")
    return bare.rlike(r"^([0-9]{1,2}[LR]?|[XYZWM]|MT|[IVX]{1,5})$") & ~F.upper(name).rlike("RANDOM|UN_|ALT|HAP|FIX|SCAFFOLD|CONTIG|DECOY")


def annotation_text(length: Column, parts: list[tuple[str, Column]]) -> Column:
    """``L;name:start-length,…;…`` with starts from 1; empty kinds left out; null if none is left.

    parts: header of a kind, and its array of (start, n) structs.
    """
    each = [F.when(F.size(a) > 0, F.concat(F.lit(f"{name}:"), F.array_join(F.transform(a, lambda x: F.concat((x["start"] + 1).cast("string"), F.lit("-"), x["n"].cast("string"))), ","))) for name, a in parts]
    body = F.concat_ws(";", *each)
    return F.when(body != "", F.concat(length.cast("string"), F.lit(";"), body))


def parse_annotations(text: Column) -> Column:
    """array of (kind, quals, start, n), in the text's order; quals is what follows the strand sign."""
    kinds = F.filter(F.slice(F.split(text, ";"), F.lit(2), F.greatest(F.size(F.split(text, ";")) - 1, F.lit(0))), lambda k: k != "")

    def of(kind: Column) -> Column:
        head, body = F.split_part(kind, F.lit(":"), F.lit(1)), F.split_part(kind, F.lit(":"), F.lit(2))
        name, quals = F.regexp_extract(head, r"^([^.+-]+)", 1), F.regexp_extract(head, r"[.+-](.*)$", 1)
        return F.transform(F.split(body, ","), lambda t: F.struct(name.alias("kind"), quals.alias("quals"), (F.split_part(t, F.lit("-"), F.lit(1)).cast("long") - 1).alias("start"), F.split_part(t, F.lit("-"), F.lit(2)).cast("long").alias("n")))

    return F.flatten(F.transform(kinds, of))


def parse_skips(mm: Column) -> Column:
    """Skip counts of a text ``base+code,skip,skip,...;`` of one kind of mark, all of them."""
    parts = F.split(F.regexp_replace(mm, ";", ""), ",")
    return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda x: x.cast("long"))


def mark_ordinals(skips: Column) -> Column:
    """Ordinals of marked bases from skip counts: running sum of skip + 1, less 1."""

    @F.arrow_udf("array<bigint>")
    def walk(skips: pa.Array) -> pa.Array:
        flat, n = np.asarray(skips.flatten(), np.int64) + 1, np.asarray(pc.fill_null(pc.list_value_length(skips), 0), np.int64)
        sums = np.concatenate(([0], np.cumsum(flat)))
        ends = np.concatenate(([0], np.cumsum(n)))
        values = pa.array(sums[1:] - np.repeat(sums[ends[:-1]], n) - 1)
        offsets = pa.array(ends.astype(np.int32))
        return pa.ListArray.from_arrays(offsets, values, mask=pc.is_null(skips)) if skips.null_count else pa.ListArray.from_arrays(offsets, values)

    return walk(skips.cast("array<bigint>"))
