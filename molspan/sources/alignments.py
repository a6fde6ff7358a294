"""A data source for binary alignment files: ``spark.read.format("alignments").load(path)``, and a writer of them.

Files are opened with pyarrow's file systems, so a path may name any store that these reach.
A file is read in splits of its blocks; a split finds its first record by itself.
"""

from __future__ import annotations

import bisect
import fnmatch
import json
import re
import struct
import uuid
import zlib
from collections import deque
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SCHEMA = (
    "read_id string, flag int, chrom string, ref_start int, ref_end int, mapq int, cigar array<struct<op:int,n:int>>, seq string, read_length int, qual string, is_reverse boolean, "
    "mm string, ml array<int>, md string, st string, nm int, hp int, ps int, ns array<int>, nl array<int>, nq array<int>, `as` array<int>, al array<int>, aq array<int>, ma string, ma_aq array<int>, an string, "
    "next_chrom string, next_start int, template_length int, tags binary, voffset long"
)
NAMES = [x.strip().split(" ")[0].strip("`") for x in re.sub(r"<[^ ]*>", "", SCHEMA).split(", ")]
# Fixed values of the format: letters of 4-bit bases, bytes of each kind of tag value, operations on the reference.
BASES = "=ACMGRSVTWYHKDBN"
WIDTH = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
FORMAT = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
ON_REFERENCE = (0, 2, 3, 7, 8)
END_OF_FILE = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Tags that are columns: name in the file, column, and how it is written.
TAGS = [("MM", "mm", "Z"), ("ML", "ml", "C"), ("MD", "md", "Z"), ("st", "st", "Z"), ("NM", "nm", "i"), ("HP", "hp", "i"), ("PS", "ps", "i"), ("ns", "ns", "I"), ("nl", "nl", "I"), ("nq", "nq", "C"), ("as", "as", "I"), ("al", "al", "I"), ("aq", "aq", "C"), ("MA", "ma", "Z"), ("AQ", "ma_aq", "C"), ("AN", "an", "Z")]
OLD = {"Mm": "MM", "Ml": "ML"}
PAIRS = np.array([ord(BASES[b >> 4]) | ord(BASES[b & 15]) << 8 for b in range(256)], "<u2")
#: Compressed bytes of a split; records of an Arrow batch; bytes looked through for a first record.
SPLIT, BATCH, LOOK = 64 << 20, 500, 16 << 20
MOLECULAR = "molspan:coord=molecular"  # readers look for coord=molecular, whoever wrote it


# Files


def open_store(path: str) -> tuple[pa.fs.FileSystem, str]:
    import pyarrow.fs as fs

    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the file, the .bam files of the folder, or what a pattern names; sorted."""
    import pyarrow.fs as fs

    store, where = open_store(path)
    head = path[: len(path) - len(where)] if path.endswith(where) else ""
    if any(c in where for c in "*?["):
        base = where[: re.search(r"[*?\[]", where).start()].rpartition("/")[0] or "."
        found = [i for i in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if fnmatch.fnmatch(i.path, where)]
    else:
        info = store.get_file_info(where)
        found = [info] if info.type == fs.FileType.File else [i for i in store.get_file_info(fs.FileSelector(where, allow_not_found=True)) if i.path.endswith(".bam")]
    out = sorted((head + i.path, i.size) for i in found if i.type == fs.FileType.File)
    if not out:
        raise FileNotFoundError(path)
    return out


class Blocks:
    """Reads a stream of gzip blocks as one, from the block at ``offset`` of the file on."""

    def __init__(self, raw: BinaryIO, offset: int = 0) -> None:
        self.raw, self.held, self.at, self.offset = raw, bytearray(), 0, offset
        self.begun = 0  # uncompressed bytes before self.held
        self.starts: deque[tuple[int, int]] = deque()  # (uncompressed, compressed) place of each block

    def more(self) -> bool:
        head = self.raw.read(18)
        if len(head) < 18:
            return False
        extra = struct.unpack("<H", head[10:12])[0]
        head += self.raw.read(max(0, 12 + extra - 18))
        size, at = None, 12
        while at + 4 <= 12 + extra:
            tag, n_bytes = head[at : at + 2], struct.unpack("<H", head[at + 2 : at + 4])[0]
            if tag == b"BC":
                size = struct.unpack("<H", head[at + 4 : at + 6])[0] + 1
            at += 4 + n_bytes
        if head[:2] != b"\x1f\x8b" or size is None:
            raise ValueError("not a blocked gzip file")
        body = self.raw.read(size - 12 - extra)
        if len(body) < size - 12 - extra:
            raise ValueError("the file is cut short")
        data = zlib.decompress(body[:-8], -15)
        self.starts.append((self.begun + len(self.held), self.offset))
        self.offset += size
        self.held += data
        return True

    def peek(self, n: int) -> bytes:
        """The next n bytes, fewer at the end."""
        while len(self.held) - self.at < n and self.more():
            pass
        return bytes(self.held[self.at : self.at + n])

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.at += len(out)
        if self.at > 1 << 22:
            del self.held[: self.at]
            self.begun, self.at = self.begun + self.at, 0
        return out

    def voffset(self) -> int:
        """Where the next byte is: its block's place in the file, and its own in the block."""
        here = self.begun + self.at
        if self.at >= len(self.held) and not self.more():
            return self.offset << 16
        while len(self.starts) > 1 and self.starts[1][0] <= here:
            self.starts.popleft()
        place, block = self.starts[0]
        return block << 16 | here - place


def read_header(blocks: Blocks) -> tuple[str, list[tuple[str, int]]]:
    """(text, contigs with lengths) of the file; raises ValueError if it is cut short or of another kind."""
    start = blocks.take(8)
    if len(start) < 8 or start[:4] != b"BAM\1":
        raise ValueError("empty, cut short, or not a binary alignment file")
    text = blocks.take(struct.unpack("<i", start[4:])[0]).rstrip(b"\0").decode()
    names = []
    for _ in range(struct.unpack("<i", blocks.take(4))[0]):
        n = struct.unpack("<i", blocks.take(4))[0]
        name = blocks.take(n)[:-1].decode()
        names.append((name, struct.unpack("<i", blocks.take(4))[0]))
    return text, names


def header(blocks: Blocks) -> list[tuple[str, int]]:
    return read_header(blocks)[1]


def file_header(path: str) -> tuple[str, list[tuple[str, int]]]:
    store, where = open_store(path)
    with store.open_input_stream(where, compression=None) as raw:
        return read_header(Blocks(raw))


def contigs(spark: SparkSession, path: str) -> DataFrame:
    """(tid, chrom, length) of the first file of a path, from its header alone."""
    _, names = file_header(list_files(path)[0][0])
    return spark.createDataFrame([(i, n, size) for i, (n, size) in enumerate(names)], "tid int, chrom string, length long")


# Records


def each_tag(data: bytes) -> Iterator[tuple[str, object, bytes]]:
    """(name, value, bytes) of each tag."""
    at = 0
    while at + 3 <= len(data):
        begin, name, kind = at, data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "B":
            inner, n = chr(data[at]), struct.unpack("<i", data[at + 1 : at + 5])[0]
            at += 5
            value = np.frombuffer(data, f"<{FORMAT[inner]}", n, at).tolist()
            at += n * WIDTH[inner]
        else:
            value = chr(data[at]) if kind == "A" else struct.unpack("<" + FORMAT[kind], data[at : at + WIDTH[kind]])[0]
            at += WIDTH[kind]
        yield name, value, data[begin:at]


def decoded(data: bytes, names: list[tuple[str, int]], voffset: int) -> dict[str, object]:
    ref, start, l_name, mapq, _, n_cigar, flag, l_seq, next_ref, next_start, template = struct.unpack("<iiBBHHHiiii", data[:32])
    at = 32 + l_name
    ops = np.frombuffer(data, "<u4", n_cigar, at)
    at += 4 * n_cigar
    packed = np.frombuffer(data, np.uint8, (l_seq + 1) // 2, at)
    at += len(packed)
    qual = np.frombuffer(data, np.uint8, l_seq, at)
    op, n = ops & 15, ops >> 4
    found, rest = {}, []
    known = {t for t, _, _ in TAGS}
    for name, value, raw in each_tag(data[at + l_seq :]):
        name = OLD.get(name, name)
        if name in known:
            found[name] = value
        else:
            rest.append(raw)
    out: dict[str, object] = {
        "read_id": data[32 : 32 + l_name - 1].decode(), "flag": flag, "chrom": names[ref][0] if ref >= 0 else None, "ref_start": start, "ref_end": start + int(n[np.isin(op, ON_REFERENCE)].sum()) if ref >= 0 and n_cigar else None,
        "mapq": mapq, "cigar": [{"op": a, "n": b} for a, b in zip(op.tolist(), n.tolist())], "seq": PAIRS[packed].tobytes()[:l_seq].decode() or None, "read_length": l_seq,
        "qual": None if not l_seq or qual[0] == 255 else (qual + 33).tobytes().decode("latin-1"), "is_reverse": bool(flag & 16),
        "next_chrom": names[next_ref][0] if next_ref >= 0 else None, "next_start": next_start, "template_length": template, "tags": b"".join(rest), "voffset": voffset,
    }
    for tag, column, kind in TAGS:
        value = found.get(tag)
        if value is not None and (kind == "Z") != isinstance(value, str):
            value = str(value) if kind == "Z" else None
        if kind == "i" and not (isinstance(value, int) and -(2**31) <= value < 2**31):
            value = None
        if kind in "IC" and not isinstance(value, list):
            value = None
        out[column] = value
    return out


def plausible(data: bytes, at: int, names: list[tuple[str, int]]) -> int:
    """Bytes of the record that may begin here; 0 if none can, -1 if there is too little data to tell."""
    if at + 36 > len(data):
        return -1
    size, ref, start, l_name, _, _, n_cigar, flag, l_seq, next_ref, next_start = struct.unpack("<iiiBBHHHiii", data[at : at + 32])
    least = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    if not (32 < size < 1 << 29 and -1 <= ref < len(names) and -1 <= next_ref < len(names) and l_name > 0 and l_seq >= 0 and flag < 1 << 12 and least <= size):
        return 0
    if start < -1 or next_start < -1 or ref >= 0 and start > names[ref][1] or next_ref >= 0 and next_start > names[next_ref][1]:
        return 0
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] != 0 or any(not 33 <= c <= 126 for c in name[:-1])):
        return 0
    return size + 4


def first_record(blocks: Blocks, names: list[tuple[str, int]], chain: int = 5) -> bool:
    """Moves to the first place from which ``chain`` records, or all up to the end, can follow each other."""
    size = 1 << 17
    while True:
        data = blocks.peek(size)
        ended = len(data) < size
        for at in range(len(data)):
            here, n = at, 0
            while n < chain and here < len(data):
                step = plausible(data, here, names)
                if step <= 0:
                    n = -1 if step == 0 or ended else n
                    break
                here, n = here + step, n + 1
            if n < 0 or here > len(data) and ended:
                continue
            if n >= chain or here == len(data) and ended or n >= 1 and (here >= len(data) or step == -1) and size >= LOOK:
                blocks.take(at)
                return True
            if not ended and (here >= len(data) or n < chain):
                break  # more data will tell
        if ended:
            return False
        size *= 4


def find_block(raw: BinaryIO, start: int, size: int) -> int | None:
    """Where the first block at or after ``start`` begins."""
    raw.seek(start)
    data = raw.read(min(size - start, 1 << 18))
    at = 0
    while (at := data.find(b"\x1f\x8b\x08\x04", at)) >= 0:
        if at + 18 <= len(data) and data[at + 12 : at + 16] == b"BC\x02\x00":
            follow = at + struct.unpack("<H", data[at + 16 : at + 18])[0] + 1
            if start + follow == size or data[follow : follow + 4] == b"\x1f\x8b\x08\x04":
                return start + at
        at += 1
    return None


# Index


def bin_of(start: int, stop: int) -> int:
    stop -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == stop >> shift:
            return first + (start >> shift)
    return 0


def bins_over(start: int, stop: int) -> set[int]:
    stop -= 1
    return {0} | {k for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)) for k in range(first + (start >> shift), first + (stop >> shift) + 1)}


def read_index(path: str) -> list[tuple[dict[int, list[tuple[int, int]]], list[int]]] | None:
    """(chunks by bin, linear index) of each contig from the file's index; None if there is none."""
    import pyarrow.fs as fs

    store, where = open_store(path)
    for name in (where + ".bai", where[:-4] + ".bai"):
        if store.get_file_info(name).type != fs.FileType.File:
            continue
        with store.open_input_stream(name) as raw:
            data = raw.read()
        if data[:4] != b"BAI\1":
            raise ValueError(f"{name} is no index")
        out, at = [], 8
        for _ in range(struct.unpack("<i", data[4:8])[0]):
            chunks: dict[int, list[tuple[int, int]]] = {}
            n, at = struct.unpack("<i", data[at : at + 4])[0], at + 4
            for _ in range(n):
                number, m = struct.unpack("<Ii", data[at : at + 8])
                at += 8
                chunks[number] = [struct.unpack("<QQ", data[at + 16 * i : at + 16 * i + 16]) for i in range(m)]
                at += 16 * m
            n, at = struct.unpack("<i", data[at : at + 4])[0], at + 4
            out.append((chunks, list(struct.unpack(f"<{n}Q", data[at : at + 8 * n]))))
            at += 8 * n
        return out
    return None


def chunks_of(index: list, tid: int, start: int, stop: int) -> list[tuple[int, int]]:
    """Merged ranges of virtual offsets that can hold records over an interval."""
    bins, linear = index[tid]
    least = linear[min(start >> 14, len(linear) - 1)] if linear else 0
    out: list[tuple[int, int]] = []
    for a, b in sorted(c for k in bins_over(start, stop) if k in bins for c in bins[k]):
        if b <= least:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def write_index(path: str) -> str:
    """Writes the index of a file sorted by position beside it; ValueError if the file isn't sorted."""
    store, where = open_store(path)
    with store.open_input_stream(where, compression=None) as raw:
        blocks = Blocks(raw)
        names = header(blocks)
        bins: list[dict[int, list[list[int]]]] = [{} for _ in names]
        linear: list[dict[int, int]] = [{} for _ in names]
        last, unplaced = (-1, -1), 0
        while True:
            begin = blocks.voffset()
            size = blocks.take(4)
            if len(size) < 4:
                break
            data = blocks.take(struct.unpack("<i", size)[0])
            end = blocks.voffset()
            ref, start, l_name = struct.unpack("<iiB", data[:9])
            if ref < 0:
                unplaced += 1
                last = (1 << 31, 0)
                continue
            if (ref, start) < last:
                raise ValueError(f"{path} isn't sorted by position")
            last = (ref, start)
            ops = np.frombuffer(data, "<u4", struct.unpack("<H", data[12:14])[0], 32 + l_name)
            stop = start + max(1, int((ops >> 4)[np.isin(ops & 15, ON_REFERENCE)].sum()))
            held = bins[ref].setdefault(bin_of(start, stop), [])
            if held and held[-1][1] >> 16 == begin >> 16:
                held[-1][1] = end
            else:
                held.append([begin, end])
            for k in range(start >> 14, (stop - 1 >> 14) + 1):
                linear[ref].setdefault(k, begin)
    out = [b"BAI\1", struct.pack("<i", len(names))]
    for held, places in zip(bins, linear):
        out.append(struct.pack("<i", len(held)))
        for number, parts in sorted(held.items()):
            out.append(struct.pack("<Ii", number, len(parts)) + b"".join(struct.pack("<QQ", *p) for p in parts))
        n, before = max(places, default=-1) + 1, 0
        out.append(struct.pack("<i", n))
        for k in range(n):
            before = places.get(k, before)
            out.append(struct.pack("<Q", before))
    out.append(struct.pack("<Q", unplaced))
    with store.open_output_stream(where + ".bai") as file:
        file.write(b"".join(out))
    return path + ".bai"


# Reading


class Split(InputPartition):
    """Records of a file that begin in blocks from start to stop, or between virtual offsets."""

    def __init__(self, path: str, size: int, start: int, stop: int, virtual: bool = False) -> None:
        self.path, self.size, self.start, self.stop, self.virtual = path, size, start, stop, virtual


def parse_region(text: str) -> tuple[str, int, int]:
    """(contig, start, stop) of contig[:from-to], from 1 on and with both ends."""
    m = re.fullmatch(r"(.+?)(?::([\d,]+)-([\d,]+))?", text)
    number = lambda x: int(x.replace(",", ""))
    return (m[1], number(m[2]) - 1, number(m[3])) if m[2] else (m[1], 0, 1 << 29)


class Reader(DataSourceReader):
    """Options: path; region (contig or contig:from-to; with an index only its chunks are read), owned (true: records that
    begin in the region, so regions don't share any), min_mapq, min_length, mapped (true), primary (true), split_bytes, rows."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.options, self.shape = dict(options), to_arrow_schema(schema)

    def flag(self, name: str) -> bool:
        return str(self.options.get(name, "false")).lower() == "true"

    def partitions(self) -> list[Split]:
        step, region = int(self.options.get("split_bytes", SPLIT)), self.options.get("region")
        out: list[Split] = []
        for path, size in list_files(self.options["path"]):
            index = read_index(path) if region else None
            if index is not None:
                names = [n for n, _ in file_header(path)[1]]
                chrom, start, stop = parse_region(region)
                if chrom in names:
                    out += [Split(path, size, a, b, True) for a, b in chunks_of(index, names.index(chrom), start, stop)]
            else:
                out += [Split(path, size, a, min(a + step, size)) for a in range(0, max(size, 1), step)]
        return out or [Split("", 0, 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        shape, rows = self.shape, []
        for row in self.records(partition):
            rows.append(row)
            if len(rows) >= BATCH:
                yield pa.RecordBatch.from_pylist(rows, shape)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, shape)

    def records(self, part: Split) -> Iterator[dict[str, object]]:
        store, where = open_store(part.path)
        text, names = file_header(part.path)
        region = parse_region(self.options["region"]) if self.options.get("region") else None
        tid = next((i for i, (n, _) in enumerate(names) if region and n == region[0]), None)
        mapq, length = int(self.options.get("min_mapq", 0)), int(self.options.get("min_length", 0))
        mapped, primary, owned = self.flag("mapped"), self.flag("primary"), self.flag("owned")
        with store.open_input_file(where) as raw:
            if part.virtual:
                raw.seek(part.start >> 16)
                blocks = Blocks(raw, part.start >> 16)
                blocks.take(part.start & 0xFFFF)
            elif part.start == 0:
                blocks = Blocks(raw)
                header(blocks)
            else:
                at = find_block(raw, part.start, part.size)
                if at is None or at >= part.stop:
                    return
                raw.seek(at)
                blocks = Blocks(raw, at)
                if not first_record(blocks, names):
                    return
            while True:
                here = blocks.voffset()
                if here >= part.stop if part.virtual else here >> 16 >= part.stop:
                    return
                size = blocks.take(4)
                if len(size) < 4:
                    return
                data = blocks.take(struct.unpack("<i", size)[0])
                if len(data) < struct.unpack("<i", size)[0]:
                    raise ValueError(f"{part.path} is cut short")
                ref, start, _, quality, _, _, flag, l_seq = struct.unpack("<iiBBHHHi", data[:20])
                if mapped and flag & 4 or primary and flag & 0x900 or quality < mapq and not flag & 4 or l_seq < length:
                    continue
                if region:
                    if ref != tid or start >= region[2] or owned and start < region[1]:
                        continue
                    row = decoded(data, names, here)
                    if (row["ref_end"] or start + 1) <= region[1]:
                        continue
                    yield row
                else:
                    yield decoded(data, names, here)


class Arrivals(DataSourceStreamReader):
    """A stream of the files of a folder, in the order of their names; rows of a batch in the files' order."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.reader = Reader(options, schema)

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        try:
            return {"files": len(list_files(self.reader.options["path"]))}
        except FileNotFoundError:
            return {"files": 0}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return [Split(p, size, 0, size) for p, size in list_files(self.reader.options["path"])[start["files"] : end["files"]]] if end["files"] > start["files"] else []

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        yield from self.reader.read(partition)


# Writing


def block(data: bytes) -> bytes:
    packed = zlib.compressobj(5, zlib.DEFLATED, -15)
    body = packed.compress(data) + packed.flush()
    return struct.pack("<4BIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def header_bytes(text: str, names: list[tuple[str, int]]) -> bytes:
    raw = text.encode()
    out = [b"BAM\1", struct.pack("<i", len(raw)), raw, struct.pack("<i", len(names))]
    for name, size in names:
        out.append(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size))
    return b"".join(out)


def tag_bytes(name: str, kind: str, value: object) -> bytes:
    head = name.encode()
    if kind == "Z":
        return head + b"Z" + str(value).encode() + b"\0"
    if kind == "i":
        return head + b"i" + struct.pack("<i", int(value))
    values = np.asarray(value, "<u4" if kind == "I" else np.uint8)
    return head + b"B" + kind.encode() + struct.pack("<i", len(values)) + values.tobytes()


def encoded(row: dict[str, object], number: dict[str, int]) -> bytes:
    """A record of a row; columns that are null or missing have no tag."""
    get = row.get
    seq, name = get("seq") or "", str(get("read_id") or "*").encode() + b"\0"
    ops = [(x["op"], x["n"]) for x in get("cigar") or []]
    letters = np.frombuffer(seq.upper().encode(), np.uint8)
    codes = LETTERS[letters]
    packed = (np.append(codes, 0)[: (len(codes) + 1) // 2 * 2].reshape(-1, 2) * (16, 1)).sum(1).astype(np.uint8) if len(codes) else codes
    qual = get("qual")
    quality = b"\xff" * len(seq) if qual is None or len(qual) != len(seq) else (np.frombuffer(qual.encode("latin-1"), np.uint8) - 33).tobytes()
    start = -1 if get("ref_start") is None else int(get("ref_start"))
    span = sum(n for op, n in ops if op in ON_REFERENCE)
    flag = int(get("flag") or 0)
    body = [struct.pack("<iiBBHHHiiii", number.get(get("chrom"), -1), start, len(name), int(get("mapq") or 0), bin_of(max(start, 0), max(start, 0) + max(span, 1)) if start >= 0 else 4680, len(ops), flag, len(seq), number.get(get("next_chrom"), -1), -1 if get("next_start") is None else int(get("next_start")), int(get("template_length") or 0))]
    body += [name, b"".join(struct.pack("<I", n << 4 | op) for op, n in ops), packed.tobytes(), quality, bytes(get("tags") or b"")]
    body += [tag_bytes(tag, kind, get(column)) for tag, column, kind in TAGS if get(column) is not None and (kind not in "IC" or len(get(column)))]
    data = b"".join(body)
    return struct.pack("<i", len(data)) + data


LETTERS = np.full(256, 15, np.uint8)
for _k, _b in enumerate(BASES):
    LETTERS[ord(_b)] = _k


class Part(WriterCommitMessage):
    def __init__(self, path: str) -> None:
        self.path = path


class Writer(DataSourceArrowWriter):
    """One file a task, named by its partition, so that names sort as the rows do. Options: path, header (text), contigs (JSON pairs)."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.text, self.overwrite, self.run = options["path"].rstrip("/"), options.get("header", ""), overwrite, uuid.uuid4().hex[:8]
        self.names = [(n, int(size)) for n, size in json.loads(options.get("contigs", "[]"))]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, where = open_store(f"{self.path}/.part-{context.partitionId():06d}-{self.run}-{context.taskAttemptId()}.bam")
        store.create_dir(where.rpartition("/")[0], recursive=True)
        number = {n: i for i, (n, _) in enumerate(self.names)}
        with store.open_output_stream(where, compression=None) as out:
            self.flush(out, header_bytes(self.text, self.names), 0)  # blocks of its own, so that files can be joined
            held = b""
            for batch in iterator:
                for row in batch.to_pylist():
                    held += encoded(row, number)
                    if len(held) > 1 << 20:
                        held = self.flush(out, held, 0xFF00)
            self.flush(out, held, 0)
            out.write(END_OF_FILE)
        return Part(where)

    @staticmethod
    def flush(out, data: bytes, least: int) -> bytes:
        """Writes blocks while more than ``least`` bytes are left."""
        at = 0
        while len(data) - at > least:
            out.write(block(data[at : at + 0xFF00]))
            at += 0xFF00
        return data[at:]

    def commit(self, messages: list[Part | None]) -> None:
        store, where = open_store(self.path)
        if self.overwrite:
            for path, _ in list_old(self.path):
                store.delete_file(path)
        for m in messages:
            if m is not None:
                folder, _, name = m.path.rpartition("/")
                store.move(m.path, f"{folder}/{'-'.join(name[1:].split('-')[:3])}.bam")

    def abort(self, messages: list[Part | None]) -> None:
        store, _ = open_store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.path)


def list_old(path: str) -> list[tuple[str, int]]:
    try:
        store, _ = open_store(path)
        return [(open_store(p)[1], n) for p, n in list_files(path) if not p.rpartition("/")[2].startswith(".")]
    except FileNotFoundError:
        return []


class Alignments(DataSource):
    """Binary alignment files, read and written; see Reader and Writer for the options."""

    @classmethod
    def name(cls) -> str:
        return "alignments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options, schema)

    def streamReader(self, schema) -> Arrivals:
        return Arrivals(self.options, schema)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Alignments)


def in_order(reads: DataFrame, names: list[tuple[str, int]]) -> DataFrame:
    """reads by contig, position and name, dealt by range; without a contig last."""
    tid = F.create_map(*[x for i, (n, _) in enumerate(names) for x in (F.lit(n), F.lit(i))])[F.col("chrom")] if names else F.lit(None).cast("int")
    keys = [F.coalesce(tid, F.lit(1 << 30)), F.col("ref_start"), F.col("read_id")]
    return reads.repartitionByRange(*keys).sortWithinPartitions(*keys)


def write(reads: DataFrame, path: str, names: list[tuple[str, int]], text: str = "", *, ordered: bool = True, mode: str = "overwrite") -> None:
    """Writes reads as a folder of alignment files that follow each other in order; columns that SCHEMA lacks are left out."""
    register(reads.sparkSession)
    rows = in_order(reads, names) if ordered else reads
    known = [c for c in rows.columns if c in NAMES and c != "voffset"]
    rows.select(*known).write.format("alignments").mode(mode).option("header", text).option("contigs", json.dumps(names)).save(path)


def join_files(path: str, out: str, names: list[tuple[str, int]] | None = None, text: str = "") -> str:
    """One file of a folder's files, in the order of their names, without unpacking records; with none, a header alone."""
    parts = list_old(path)
    store, target = open_store(out)
    with store.open_output_stream(target, compression=None) as to:
        if not parts:
            to.write(block(header_bytes(text, names or [])))
        for i, (part, size) in enumerate(parts):
            with store.open_input_file(part) as raw:
                blocks = Blocks(raw)
                header(blocks)
                begin = blocks.voffset()
                if begin & 0xFFFF:
                    raise ValueError(f"{part}: records don't begin with a block")
                raw.seek(0 if i == 0 else begin >> 16)
                left = size - raw.tell() - len(END_OF_FILE)
                while left > 0:
                    data = raw.read(min(left, 1 << 22))
                    to.write(data)
                    left -= len(data)
        to.write(END_OF_FILE)
    return out


def sort_and_index(spark: SparkSession, path: str) -> str:
    """Writes the index of a file; one that isn't sorted is sorted and written anew first."""
    try:
        return write_index(path)
    except ValueError:
        register(spark)
        text, names = file_header(path)
        folder = f"{path}.sorting"
        write(spark.read.format("alignments").load(path), folder, names, text)
        join_files(folder, f"{path}.sorted", names, text)
        store, where = open_store(path)
        store.delete_dir(open_store(folder)[1])
        store.move(f"{where}.sorted", where)
        return write_index(path)


# Header lines


def with_program(text: str, name: str, *, version: str | None = None, command: str | None = None, about: str | None = None) -> str:
    """The header with a line of the program: an id of its own, and after the last one there."""
    lines = [x for x in text.split("\n") if x]
    field = lambda line, tag: next((f[3:] for f in line.split("\t")[1:] if f.startswith(f"{tag}:")), None)
    known = [field(x, "ID") for x in lines if x.startswith("@PG")]
    own, i = name, 1
    while own in known:
        i += 1
        own = f"{name}.{i}"
    fields = [f"ID:{own}", f"PN:{name}", *(f"{t}:{v}" for t, v in (("VN", version), ("CL", command), ("DS", about)) if v), *([f"PP:{known[-1]}"] if known and known[-1] else [])]
    at = max((i for i, x in enumerate(lines) if x.startswith("@PG")), default=len(lines) - 1) + 1
    return "\n".join([*lines[:at], "\t".join(["@PG", *fields]), *lines[at:]]) + "\n"


def with_marker(text: str) -> str:
    """The header with the remark that tags are in the direction the molecule was read, once."""
    return text if has_marker(text) else "\n".join([*[x for x in text.split("\n") if x], f"@CO\t{MOLECULAR}"]) + "\n"


def has_marker(text: str) -> bool:
    """Without it, tags are as the sequence is stored."""
    return any(re.fullmatch(r"@CO\t(\S*:)?coord=molecular", line) for line in text.split("\n"))


def contig_filter(reads: DataFrame, *, chroms: list[str] | None = None, main: bool = False) -> DataFrame:
    from molspan.functions.sequences import main_chromosome

    rows = reads.where(F.col("chrom").isin(chroms)) if chroms else reads
    return rows.where(main_chromosome(F.col("chrom"))) if main else rows


# References


def reference(spark: SparkSession, path: str, width: int = 1 << 16) -> DataFrame:
    """(chrom, bin, piece): sequences of a text file of ``>name`` records, in pieces of ``width`` bases."""
    from molspan.session import map_batches

    whole = spark.read.text(path, lineSep=">").where("value <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                head, _, rest = text.partition("\n")
                seq = re.sub(r"\s+", "", rest)
                n = -(-len(seq) // width)
                yield pa.RecordBatch.from_arrays([pa.array([head.split()[0] if head.split() else ""] * n), pa.array(range(n), pa.int32()), pa.array([seq[k * width : (k + 1) * width] for k in range(n)])], names=["chrom", "bin", "piece"])

    return map_batches(whole, run, "chrom string, bin int, piece string")


def with_reference(reads: DataFrame, pieces: DataFrame, width: int = 1 << 16) -> DataFrame:
    """reads plus ref_seq: the reference bases from ref_start to ref_end; null off the reference.

    Reads meet pieces by equal bins, so no contig is gathered in one task.
    """
    key = [c for c in ("read_id", "chrom", "ref_start", "ref_end", "flag") if c in reads.columns]
    spans = reads.where("chrom IS NOT NULL AND ref_end > ref_start").select(*key).distinct()
    bins = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("ref_start") / width).cast("int"), F.floor((F.col("ref_end") - 1) / width).cast("int"))))
    met = bins.join(pieces, ["chrom", "bin"]).groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bin", "piece"))), lambda x: x["piece"]), "").alias("__text"))
    text: Column = F.substring(F.col("__text"), F.pmod(F.col("ref_start"), F.lit(width)).cast("int") + 1, F.col("ref_end") - F.col("ref_start"))
    met = met.withColumn("ref_seq", text).select(*[F.col(c).alias(f"__{c}") for c in key], "ref_seq")
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    columns = [c for c in reads.columns if c != "ref_seq"]
    return reads.select(*columns).join(met, same, "left").select(*columns, "ref_seq")


def block_offsets(path: str) -> list[int]:
    """Where the blocks of a file begin."""
    store, where = open_store(path)
    out, size = [], store.get_file_info(where).size
    with store.open_input_file(where) as raw:
        at = 0
        while at < size:
            raw.seek(at)
            head = raw.read(18)
            if len(head) < 18:
                break
            out.append(at)
            at += struct.unpack("<H", head[16:18])[0] + 1
    return out


def owner_split(offsets: list[int], voffset: int) -> int:
    """Number of the block that a virtual offset is in."""
    return bisect.bisect_right(offsets, voffset >> 16) - 1
