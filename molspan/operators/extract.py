"""Features of tagged molecules as BED12 rows: nucleosomes, patches, binding calls, marks and deaminations, all in one pass."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molspan.functions.marks import IN_READ, IN_REFERENCE, Found, bytes_of, md_fits, md_reference, parse_batch, schema_fields, upper
from molspan.functions.sequences import sample_token
from molspan.session import map_batches

FEATURES = ("nucleosome", "msp", "tf", "m6a", "m5c", "deam")
ALIASES = {"footprint": "nucleosome"}
# Fixed values of the formats: names of annotation kinds, letters of marks, and the columns that a feature adds.
KIND = {"nucleosome": "nuc", "msp": "msp", "tf": "tf"}
LETTER = {"m6a": "a", "m5c": "m"}
SCORES = {"nucleosome": ("blockNq", "blockEl", "blockEr"), "msp": ("blockAq",), "tf": ("blockTq", "blockEl", "blockEr"), "m6a": ("blockMl",), "m5c": ("blockMl",), "deam": ("blockMod",)}
BED = [("string", "chrom", "Contig"), ("uint", "chromStart", "First base, from 0"), ("uint", "chromEnd", "Base after the last"), ("string", "name", "Molecule"), ("uint", "score", "Mean quality of the blocks, 0 to 255"), ("char[1]", "strand", "Strand of the alignment"), ("uint", "thickStart", "As chromStart"), ("uint", "thickEnd", "As chromEnd"), ("uint", "reserved", "0"), ("int", "blockCount", "Number of blocks"), ("int[blockCount]", "blockSizes", "Bases of each block"), ("int[blockCount]", "chromStarts", "Each block's start from chromStart on")]
CIRCLE = [("string", "circId", "Name that the pieces of a feature over the circle's end share, or ."), ("uint", "circPart", "Number of the piece, from 1"), ("uint", "circParts", "Number of pieces"), ("uint", "molStart", "Start of the whole feature on the molecule"), ("uint", "molLength", "Bases of the whole feature")]
HAPLOTYPE = [("int", "hp", "Haplotype of the molecule, -1 for none"), ("int", "ps", "Phase set of the molecule, -1 for none")]

ROW = (
    "feature string, chrom string, chromStart int, chromEnd int, name string, score int, strand string, thickStart int, thickEnd int, reserved int, blockCount int, blockSizes array<int>, chromStarts array<int>, "
    "s1 array<int>, s2 array<int>, s3 array<int>, circId string, circPart int, circParts int, molStart int, molLength int, hp int, ps int"
)
READ = {"read_id": "string", "chrom": "string", "ref_start": "int", "is_reverse": "boolean", "cigar": "array<struct<op:int,n:int>>", "seq": "string", "mm": "string", "ml": "array<int>", "md": "string", "ns": "array<int>", "nl": "array<int>", "nq": "array<int>", "as": "array<int>", "al": "array<int>", "aq": "array<int>", "ma": "string", "ma_aq": "array<int>", "an": "string", "hp": "bigint", "ps": "bigint"}


# Annotation text


def annotations(ma: str, quality: list[int] | None = None, names: str | None = None) -> tuple[int, list[dict[str, object]]]:
    """(length, annotations with kind, start, n, quals and name, in the text's order); ValueError if the text is malformed.

    Each kind has a strand sign (+, - or .) and then a letter for each byte of quality. Bytes
    and names that are missing at the end are left out.
    """
    head, *chunks = ma.split(";")
    if not re.fullmatch(r"\d+", head):
        raise ValueError(f"annotations begin with the length; got {head!r}")
    called = [] if not names else ["" if x == "." else x for x in names.split(",")]
    out, at = [], 0
    for chunk in chunks:
        if not chunk:
            continue
        m = re.fullmatch(r"([^+.\-:]*)[+.\-]([^:]*):(.*)", chunk)
        if m is None:
            raise ValueError(f"not an annotation: {chunk!r}")
        for token in m[3].split(","):
            if not token:
                continue
            t = re.fullmatch(r"(\d+)-(\d+)", token)
            if t is None:
                raise ValueError(f"not an interval: {token!r}")
            n = len(m[2])
            out.append({"kind": m[1], "start": int(t[1]) - 1, "n": int(t[2]), "quals": list((quality or [])[at : at + n]), "name": called[len(out)] if len(out) < len(called) else ""})
            at += n
    return int(head), out


def circular_parts(rows: list[dict[str, object]], length: int) -> list[dict[str, object]]:
    """Adds circ_id, part, parts, whole_start and whole_n: pieces of one name are one feature if just one begins and just one ends the molecule."""
    by: dict[str, list[dict[str, object]]] = {}
    for r in rows:
        if r["name"]:
            by.setdefault(r["name"], []).append(r)
    for r in rows:
        group = sorted(by.get(r["name"], [r]) if r["name"] else [r], key=lambda x: (x["start"] != 0, x["start"]))
        wrapped = len(group) > 1 and sum(x["start"] == 0 for x in group) == 1 and sum(x["start"] + x["n"] == length for x in group) == 1
        last = max(group, key=lambda x: x["start"])
        r |= {"circ_id": r["name"] if wrapped else ".", "part": next(i for i, x in enumerate(group, 1) if x is r) if wrapped else 1, "parts": len(group) if wrapped else 1}
        r |= {"whole_start": last["start"] if wrapped else r["start"], "whole_n": min(length, sum(x["n"] for x in group)) if wrapped else r["n"]}
    return rows


# One molecule


class Molecule:
    """A read's columns, and where its bases lie on the reference (on: a place a base, -1 for those off it)."""

    def __init__(self, row: dict[str, object], seq: np.ndarray, on: np.ndarray) -> None:
        self.row, self.seq, self.on = row, seq, on
        self.reverse = bool(row["is_reverse"])

    def block(self, start: int, n: int) -> tuple[int, int] | None:
        """Reference block of an interval as stored; None unless both its end bases lie on the reference."""
        if start < 0 or n <= 0 or start + n > len(self.on):
            return None
        a, b = int(self.on[start]), int(self.on[start + n - 1])
        return None if a < 0 or b < 0 else (min(a, b), max(a, b) + 1)

    def turned(self, start: int, n: int, length: int) -> int:
        return length - start - n if self.reverse else start


Row = dict[str, object]


def line(m: Molecule, feature: str, blocks: list[tuple], score: int, n_scores: int, **more: object) -> Row:
    """A row of blocks (start, stop, bytes), by start."""
    blocks.sort(key=lambda b: b[0])
    a, b = blocks[0][0], blocks[-1][1]
    scores = {f"s{i + 1}": [x[2][i] if i < len(x[2]) else 0 for x in blocks] for i in range(n_scores)}
    return {"feature": feature, "chrom": m.row["chrom"], "chromStart": a, "chromEnd": b, "name": m.row["read_id"], "score": score, "strand": "-" if m.reverse else "+", "thickStart": a, "thickEnd": b, "reserved": 0, "blockCount": len(blocks), "blockSizes": [y - x for x, y, _ in blocks], "chromStarts": [x - a for x, _, _ in blocks]} | scores | {"circId": ".", "circPart": 1, "circParts": 1, "molStart": 0, "molLength": 0} | more


def intervals_of(m: Molecule, feature: str, *, scored: bool, min_tq: int, circles: bool) -> Iterator[Row]:
    """Nucleosomes, patches or binding calls: by the annotation text if there is one that can be read, else by the older tags."""
    kind, n_scores = KIND[feature], len(SCORES[feature])
    parsed = None
    if m.row["ma"]:
        try:
            parsed = annotations(m.row["ma"], m.row["ma_aq"], m.row["an"])
        except ValueError:
            parsed = None
    if parsed is not None:
        length, rows = parsed
        blocks = []
        rows = [{**r, "start": m.turned(r["start"], r["n"], length)} for r in rows if r["kind"] == kind]
        for r in circular_parts(rows, length):
            q = [*r["quals"], 0, 0, 0][:n_scores] if kind != "msp" else [0]
            if m.reverse and len(r["quals"]) >= 3 and n_scores == 3:
                q[1], q[2] = q[2], q[1]
            place = m.block(r["start"], r["n"])
            if place is not None and not (kind == "tf" and q[0] < min_tq):
                blocks.append((*place, q, r))
        if circles:
            for a, b, q, r in sorted(blocks, key=lambda x: x[0]):
                name = m.row["read_id"] if r["circ_id"] == "." else f"{m.row['read_id']}|{kind}|{r['circ_id']}|{r['part']}/{r['parts']}"
                yield line(m, feature, [(a, b, q)], q[0] if scored else 0, n_scores, name=name, circId=r["circ_id"], circPart=r["part"], circParts=r["parts"], molStart=r["whole_start"], molLength=r["whole_n"])
        elif blocks:
            yield line(m, feature, [x[:3] for x in blocks], int(sum(x[2][0] for x in blocks) / len(blocks)) if scored else 0, n_scores)
        return
    if kind == "tf":
        return
    starts, sizes, quality = (m.row[c] or [] for c in (("ns", "nl", "nq") if kind == "nuc" else ("as", "al", "aq")))
    blocks = []
    for i, (s, n) in enumerate(zip(starts, sizes)):
        place = m.block(m.turned(s, n, len(m.seq)), n)
        if place is not None:
            blocks.append((*place, [quality[i] if i < len(quality) else 0]))
    if blocks:
        yield line(m, feature, blocks, int(sum(b[2][0] for b in blocks) / len(blocks)) if scored else 0, n_scores)


def laid(cigar: pa.Array, ref_start: pa.Array, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places on the reference, edges) of the bases of all reads of a batch end to end; -1 off the reference."""
    ops, count = cigar.flatten(), np.asarray(pc.fill_null(pc.list_value_length(cigar), 0), np.int64)
    op, n = np.asarray(ops.field(0), np.int64), np.maximum(np.asarray(ops.field(1), np.int64), 0)
    row, ends = np.repeat(np.arange(len(count)), count), np.concatenate(([0], np.cumsum(count)))
    read, reference = np.isin(op, IN_READ), np.isin(op, IN_REFERENCE)
    sums = [np.concatenate(([0], np.cumsum(np.where(x, n, 0)))) for x in (read, reference)]
    edge = np.concatenate(([0], np.cumsum(np.maximum(length, sums[0][ends[1:]] - sums[0][ends[:-1]]))))
    q, r = (x[:-1] - x[ends[row]] for x in sums)
    first = np.asarray(pc.fill_null(ref_start, -1), np.int64)
    both = np.flatnonzero(read & reference)
    i = np.arange(n[both].sum()) - np.repeat(np.cumsum(n[both]) - n[both], n[both])
    on = np.full(edge[-1], -1, np.int64)
    on[np.repeat(edge[row[both]] + q[both], n[both]) + i] = np.repeat(first[row[both]] + r[both], n[both]) + i
    return on, edge


class Spots(NamedTuple):
    """Marks on the reference: number of the read, place, and a value each."""

    row: np.ndarray
    place: np.ndarray
    value: np.ndarray


def placed(row: np.ndarray, at: np.ndarray, value: np.ndarray, on: np.ndarray, edge: np.ndarray) -> Spots:
    inside = (at >= 0) & (at < edge[row + 1] - edge[row])
    place = np.where(inside, on[np.where(inside, edge[row] + at, 0)] if len(on) else -1, -1)
    return Spots(row[place >= 0], place[place >= 0], value[place >= 0])


def deaminations(found: Found, data: np.ndarray, length: np.ndarray, md: list[str | None], cigar: pa.Array, on: np.ndarray, edge: np.ndarray, threshold: int) -> Spots:
    """Values 1 for C>T and 0 for G>A, of marked U, else of Y and R, else of the MD text; for each read the first that has any."""
    u = (found.code == 117) & np.isin(found.base, (67, 71)) & (found.quality >= threshold)
    parts = [placed(found.row[u], found.at[u], (found.base[u] == 67).astype(np.int64), on, edge)]
    first = np.cumsum(length) - length
    without = np.bincount(parts[0].row, minlength=len(length)) == 0
    for letter, kind in ((89, 1), (82, 0)):
        at = np.flatnonzero(data == letter)
        row = np.searchsorted(first + length, at, "right")
        at, row = at[without[row]], row[without[row]]
        parts.append(placed(row, at - first[row], np.full(len(at), kind, np.int64), on, edge))
    for i in np.flatnonzero(sum(np.bincount(x.row, minlength=len(length)) for x in parts) == 0).tolist():
        ops = [(x["op"], x["n"]) for x in cigar[i].as_py() or []] if md[i] else []
        if ops and md_fits(md[i], ops):
            at, ref = md_reference(md[i], ops, seq := data[first[i] : first[i] + length[i]])
            at, ref = at[at < len(seq)], ref[at < len(seq)]
            for old, now, kind in ((67, 84, 1), (71, 65, 0)):
                here = at[(ref == old) & (seq[at] == now)]
                parts.append(placed(np.full(len(here), i), here, np.full(len(here), kind, np.int64), on, edge))
    return Spots(*[np.concatenate(x) for x in zip(*parts)])


def spot_rows(spots: Spots, feature: str, batch: pa.RecordBatch, tails: dict[str, pa.Array], fields: list[pa.Field], score: int | None = None) -> pa.RecordBatch:
    """Rows of ROW with a block of one base for each spot; score: the mean value if None."""
    order = np.lexsort((spots.place, spots.row))
    row, place, value = (x[order] for x in spots)
    who, first, count = np.unique(row, return_index=True, return_counts=True)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(x, pa.int32()))
    a, b = place[first], place[first + count - 1] + 1
    mean = np.add.reduceat(value, first) // count if len(who) else count
    same = lambda x: pa.array([x] * len(who), pa.string() if isinstance(x, str) else pa.int32())
    read = lambda name: batch.column(list(READ).index(name)).take(pa.array(who, pa.int64()))
    kept = {
        "feature": same(feature), "chrom": read("chrom"), "chromStart": a, "chromEnd": b, "name": read("read_id"), "score": mean if score is None else same(score), "strand": pc.if_else(pc.fill_null(read("is_reverse"), False), "-", "+"), "thickStart": a, "thickEnd": b, "reserved": same(0),
        "blockCount": count, "blockSizes": lists(np.ones(len(place))), "chromStarts": lists(place - np.repeat(a, count)), "s1": lists(value), "s2": None, "s3": None, "circId": same("."), "circPart": same(1), "circParts": same(1), "molStart": same(0), "molLength": same(0),
    } | {t: x.take(pa.array(who, pa.int64())) for t, x in tails.items()}
    return pa.RecordBatch.from_arrays([pa.nulls(len(who), f.type) if (x := kept[f.name]) is None else pa.array(x, f.type) if isinstance(x, np.ndarray) else x for f in fields], names=[f.name for f in fields])


# The operator


def features(reads: DataFrame, kinds: tuple[str, ...] = FEATURES, *, scored: bool = True, min_tq: int = 50, threshold: int = 125, circles: bool = False) -> DataFrame:
    """Rows of ROW: a BED12 row for each feature of each molecule that has any (circles: one for each piece of an annotation).

    reads: of READ's columns what is there; tags are in the direction the molecule was read,
    rows are on the reference. A block is kept if both its end bases lie on the
    reference. Unmapped, secondary and supplementary rows (by flag) and rows without
    sequence have none. s1 to s3 are the columns of SCORES. Nothing is shuffled; a
    molecule's alignment is worked out once for all features.
    """
    kinds = tuple(ALIASES.get(k, k) for k in kinds)
    if set(kinds) - set(FEATURES):
        raise ValueError(f"no such feature: {sorted(set(kinds) - set(FEATURES))}")
    rows = reads.where(F.coalesce(F.col("flag"), F.lit(0)).bitwiseAND(0x904) == 0) if "flag" in reads.columns else reads
    flags = F.coalesce(F.col("flag"), F.lit(0)).bitwiseAND(16) != 0 if "flag" in reads.columns and "is_reverse" not in reads.columns else None
    rows = rows.where("chrom IS NOT NULL AND seq IS NOT NULL").select(*[(flags if c == "is_reverse" and flags is not None else F.col(c) if c in reads.columns else F.lit(None)).cast(t).alias(c) for c, t in READ.items()])
    fields = schema_fields(ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = dict(zip(READ, batch.columns))
            data, length = bytes_of(get["seq"])
            data = upper(data)
            on, edge = laid(get["cigar"], get["ref_start"], length)
            tails = {t: pc.if_else(pc.fill_null(pc.and_(pc.greater_equal(get[t], -(2**31)), pc.less(get[t], 2**31)), False), get[t], pa.scalar(-1, pa.int64())).cast(pa.int32()) for t in ("hp", "ps")}
            if set(kinds) - set(KIND):
                found = parse_batch(get["mm"], get["ml"], get["seq"], get["is_reverse"])
            for kind in kinds:
                if kind in LETTER:
                    good = (found.code == ord(LETTER[kind])) & (found.quality >= threshold)
                    yield spot_rows(placed(found.row[good], found.at[good], found.quality[good], on, edge), kind, batch, tails, fields)
                elif kind == "deam":
                    yield spot_rows(deaminations(found, data, length, get["md"].to_pylist(), get["cigar"], on, edge, threshold), kind, batch, tails, fields, 255)
            if not set(kinds) & set(KIND):
                continue
            needed = ("read_id", "chrom", "is_reverse", "ns", "nl", "nq", "as", "al", "aq", "ma", "ma_aq", "an")
            columns = {c: [None] * batch.num_rows if get[c].null_count == batch.num_rows else get[c].to_pylist() for c in needed}
            first, out, more = (np.cumsum(length) - length).tolist(), [], [tails[t].to_pylist() for t in ("hp", "ps")]
            for i, n in enumerate(length.tolist()):
                m = Molecule({c: v[i] for c, v in columns.items()}, data[first[i] : first[i] + n], on[edge[i] : edge[i + 1]])
                tail = {"hp": more[0][i], "ps": more[1][i]}
                for kind in kinds:
                    if kind in KIND:
                        out += [r | tail for r in intervals_of(m, kind, scored=scored, min_tq=min_tq, circles=circles)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in out], f.type) for f in fields], names=[f.name for f in fields])

    return map_batches(rows, run, ROW)


ANNOTATION = "k int, kind string, start int, n int, quals array<int>, name string"


def annotation_rows(reads: DataFrame, *, id_col: str = "read_id") -> DataFrame:
    """(id, k, kind, start, n, quals, name): the annotations of rows (id, ma, ma_aq, an, is_reverse) with their bytes and names, as the sequence is stored.

    k is the place in the text; of three bytes the last two change places on reverse reads.
    A null or malformed text has no rows.
    """
    kind = dict(reads.dtypes)[id_col]
    fields = schema_fields(ANNOTATION)
    column = lambda n, t: (F.col(n) if n in reads.columns else F.lit(None)).cast(t).alias(n)
    rows = reads.select(id_col, column("ma", "string"), column("ma_aq", "array<int>"), column("an", "string"), column("is_reverse", "boolean"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, out = [], []
            for i, (ma, quality, names, reverse) in enumerate(zip(*[c.to_pylist() for c in batch.columns[1:]])):
                try:
                    length, found = annotations(ma or "", quality, names)
                except ValueError:
                    continue
                for k, r in enumerate(found):
                    q = r["quals"]
                    if reverse:
                        q = [q[0], q[2], q[1], *q[3:]] if len(q) >= 3 else q
                        r["start"] = length - r["start"] - r["n"]
                    who.append(i)
                    out.append(r | {"k": k, "quals": q})
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), *[pa.array([r[f.name] for r in out], f.type) for f in fields]], names=[id_col, *[f.name for f in fields]])

    return map_batches(rows, run, f"`{id_col}` {kind}, {ANNOTATION}")


def columns_of(feature: str, *, block_scores: bool = False, circles: bool = False, haplotypes: bool = False) -> list[tuple[str, str, str]]:
    """(type, name, remark) of a feature's columns: BED12, then scores by block, pieces of circles, haplotypes."""
    feature = ALIASES.get(feature, feature)
    scores = [("int[blockCount]", n, "Quality of each block" if n[-2:] not in ("El", "Er") else "Sharpness of each block's edge, 0 to 255") for n in SCORES[feature]] if block_scores else []
    return [*BED, *scores, *(CIRCLE if circles and feature in KIND else []), *(HAPLOTYPE if haplotypes else [])]


def bed_line(feature: str, *, block_scores: bool = False, circles: bool = False, haplotypes: bool = False) -> Column:
    """The text of a row of features()."""
    feature = ALIASES.get(feature, feature)
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    where = {n: F.col(n).cast("string") for _, n, _ in [*BED, *CIRCLE, *HAPLOTYPE]} | {"blockSizes": listed("blockSizes"), "chromStarts": listed("chromStarts")} | {n: listed(f"s{i + 1}") for i, n in enumerate(SCORES[feature])}
    return F.concat_ws("\t", *[F.coalesce(where[n], F.lit("")) for _, n, _ in columns_of(feature, block_scores=block_scores, circles=circles, haplotypes=haplotypes)])


def autosql(feature: str, *, sample: str | None = None, about: str = "", **columns: bool) -> str:
    """The table definition of a feature's BED rows; the sample's name goes before the description."""
    feature = ALIASES.get(feature, feature)
    if feature not in SCORES:
        raise ValueError(f"no such feature: {feature}")
    about = about or f"{feature} blocks of single molecules, one row a molecule"
    if sample:
        about = f"Sample: {token(sample)}. {about}"
    body = "".join(f'    {kind} {name}; "{remark}"\n' for kind, name, remark in columns_of(feature, **columns))
    return f'table molspan_{feature}\n"{about}"\n(\n{body})\n'


def token(sample: str) -> str:
    """A sample's name without dots and white space."""
    return re.sub(r"[\s.]+", "_", sample.strip()).strip("_") or sample


def with_sample(definition: str, sample: str) -> str:
    """A table definition with another sample, or one for the first time."""
    m = re.search(r'^"(?:Sample: [^.]*\. )?(.*)"$', definition, re.M)
    if m is None:
        raise ValueError("no description in the definition")
    return definition[: m.start()] + f'"Sample: {token(sample)}. {m[1]}"' + definition[m.end() :]


def sample_of_file(path: str) -> str:
    """A sample's name from a file's: without folder, endings, and the feature at its end."""
    name = re.sub(r"(\.(bb|bigbed|bed|bam|gz|sorted|tsv))+$", "", path.replace("\\", "/").rpartition("/")[2], flags=re.I)
    return re.sub(rf"[._-]({'|'.join((*FEATURES, *ALIASES))})s?$", "", name) or name


def write_bed(reads: DataFrame, path: str, kinds: tuple[str, ...] = FEATURES, *, sample: str | None = None, block_scores: bool = False, circles: bool = False, haplotypes: bool = False, contigs: DataFrame | None = None, **options) -> None:
    """``path``/feature.bed (text lines by contig and start, dealt by range), feature.as, and contigs (chrom, length) as chrom.sizes.

    The features are worked out once and written to the shared folder; a bigBed file can be
    made of the three by the usual program.
    """
    from molspan.session import cut
    from molspan.sources.tables import sorted_bed

    found = cut(features(reads, kinds, circles=circles, **options))
    spark, shape = reads.sparkSession, {"block_scores": block_scores, "circles": circles, "haplotypes": haplotypes}
    for kind in (ALIASES.get(k, k) for k in kinds):
        rows = found.where(F.col("feature") == kind).select(bed_line(kind, **shape).alias("line"))
        sorted_bed(rows).write.mode("overwrite").text(f"{path}/{kind}.bed")
        spark.createDataFrame([(autosql(kind, sample=sample, **shape),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{kind}.as")
    if contigs is not None:
        contigs.select(F.concat_ws("\t", "chrom", F.col("length").cast("string")).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/chrom.sizes")


def with_haplotypes(rows: DataFrame, reads: DataFrame) -> DataFrame:
    """BED rows (name, …) with hp and ps of the reads of that name, -1 for none; ValueError if a name has several values.

    reads: (read_id, hp, ps); of secondary and supplementary rows (by flag) nothing is taken.
    """
    from molspan.session import cut

    primary = reads.where(F.coalesce(F.col("flag"), F.lit(0)).bitwiseAND(0x900) == 0) if "flag" in reads.columns else reads
    told = primary.where("hp IS NOT NULL OR ps IS NOT NULL").groupBy(F.col("read_id").alias("__name")).agg(F.max("hp").alias("hp"), F.max("ps").alias("ps"), F.count_distinct(F.struct(F.coalesce("hp", F.lit(-1)), F.coalesce("ps", F.lit(-1)))).alias("__n"))
    told = cut(told)
    several = [r["__name"] for r in told.where("__n > 1").limit(5).collect()]
    if several:
        raise ValueError(f"several haplotypes for {several}")
    columns = [c for c in rows.columns if c not in ("hp", "ps")]
    bare = F.substring_index("name", "|", 1)  # pieces of circular features have more in their names
    met = rows.select(*columns).join(told, bare == F.col("__name"), "left")
    return met.select(*columns, F.coalesce("hp", F.lit(-1)).cast("int").alias("hp"), F.coalesce("ps", F.lit(-1)).cast("int").alias("ps"))


def on_contigs(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """BED rows plus tid, the number of their contig in contigs (tid, chrom, length); rows beyond a contig's end or off all contigs raise when they are met."""
    met = rows.join(F.broadcast(contigs.select("chrom", "tid", F.col("length").alias("__length"))), "chrom", "left")  # one row a contig
    bad = F.col("tid").isNull() | (F.col("chromEnd") > F.col("__length"))
    return met.withColumn("tid", F.when(bad, F.raise_error(F.concat(F.lit("not on a contig: "), F.col("name"))).cast("int")).otherwise(F.col("tid"))).drop("__length")


def joined_blocks(rows: DataFrame) -> DataFrame:
    """features() rows with touching or overlapping blocks as one, and one-base blocks at chromStart and chromEnd if none begins or ends there.

    rows: plus read_start and read_end, what the row shall span; this is the older form of footprints on the whole read.
    """
    block = lambda x, i: F.struct((F.col("chromStart") + x).alias("a"), (F.col("chromStart") + x + F.get("blockSizes", i)).alias("b"))
    blocks = F.array_sort(F.transform("chromStarts", block))
    start = F.array().cast("array<struct<a:int,b:int>>")
    fold = F.aggregate(blocks, start, lambda acc, x: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["b"] >= x["a"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.get(acc, F.size(acc) - 1)["a"].alias("a"), F.greatest(F.get(acc, F.size(acc) - 1)["b"], x["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(x))))
    one = rows.withColumn("__b", fold)
    head = F.when(F.get("__b", F.lit(0))["a"] > F.col("read_start"), F.array(F.struct(F.col("read_start").cast("int").alias("a"), (F.col("read_start") + 1).cast("int").alias("b")))).otherwise(start)
    tail = F.when(F.element_at("__b", -1)["b"] < F.col("read_end"), F.array(F.struct((F.col("read_end") - 1).cast("int").alias("a"), F.col("read_end").cast("int").alias("b")))).otherwise(start)
    one = one.withColumn("__b", F.concat(head, F.col("__b"), tail))
    lo, hi = F.get("__b", F.lit(0))["a"], F.element_at("__b", -1)["b"]
    made = {"chromStart": lo, "chromEnd": hi, "thickStart": lo, "thickEnd": hi, "blockCount": F.size("__b"), "blockSizes": F.transform("__b", lambda x: x["b"] - x["a"]), "chromStarts": F.transform("__b", lambda x: x["a"] - F.get("__b", F.lit(0))["a"])}
    return one.withColumns(made).drop("__b", "read_start", "read_end")


__all__ = ["FEATURES", "annotation_rows", "annotations", "autosql", "bed_line", "circular_parts", "features", "joined_blocks", "sample_of_file", "sample_token", "with_sample", "write_bed"]
