import struct
import zlib

import pytest
from pyspark.sql import functions as F

from molspan.sources import alignments


def block(data):
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packed.compress(data) + packed.flush()
    return struct.pack("<4BIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(name, ref, start, seq, extra=b""):
    codes = [alignments.BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    body = struct.pack("<iiBBHHHiiii", ref, start, len(name) + 1, 60, 0, 1, 0, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", len(seq) << 4) + packed + b"\xff" * len(seq) + extra
    return struct.pack("<i", len(body)) + body


def test_reads(spark, tmp_path):
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    marks = b"MMZA+a,0;\0" + b"MLBC" + struct.pack("<i", 1) + bytes([200])
    data = head + record("r1", 0, 7, "ACGTA", marks) + record("r2", -1, -1, "AC")
    (tmp_path / "x.bam").write_bytes(block(data[:40]) + block(data[40:]) + block(b""))
    alignments.register(spark)
    got = {r.read_id: r for r in spark.read.format("alignments").load(f"{tmp_path}/*.bam").collect()}
    assert (got["r1"].chrom, got["r1"].ref_start, got["r1"].seq, got["r1"].mm, got["r1"].ml) == ("chr1", 7, "ACGTA", "A+a,0;", [200])
    assert got["r2"].chrom is None and got["r2"].seq == "AC" and [(c.op, c.n) for c in got["r1"].cigar] == [(0, 5)]


def test_broken_file(tmp_path):
    path = tmp_path / "y.bam"
    path.write_bytes(b"")
    with open(path, "rb") as raw, pytest.raises(ValueError):
        alignments.header(alignments.Blocks(raw))


def test_posteriors_and_scores_come_back(spark, tmp_path):
    from molspan.sources import tables

    shape = "read_id string, chrom string, start long, stop long, strand string, posterior array<double>, footprints array<struct<start:bigint,stop:bigint>>"
    many = [k / 255 for k in range(256)]
    rows = [("a", "chr1", 5, 8, "+", many, [(0, 2), (4, 9)]), ("b", "chr2", 0, 0, ".", [], [])]
    tables.write_posteriors(spark.createDataFrame(rows, shape), f"{tmp_path}/p", mode="x")
    back = {r.read_id: r for r in tables.read_posteriors(spark, f"{tmp_path}/p").collect()}
    assert [tuple(x) for x in back["a"].footprints] == [(0, 2), (4, 9)] and back["b"].posterior == [] and back["b"].footprints == []
    assert max(abs(x - y) for x, y in zip(back["a"].posterior, many)) <= 1 / 255 and len(back["a"].posterior) == 256
    assert '"mode": "x"' in spark.read.text(f"{tmp_path}/p/about").first()[0]

    scored = spark.createDataFrame([("a", "chr1", 5, 8, "+", [(0, 2, 0.5), (4, 9, 0.25)])], "read_id string, chrom string, start long, stop long, strand string, footprints array<struct<start:bigint,stop:bigint,score:double>>")
    tables.write_scores(scored, f"{tmp_path}/s")
    tables.write_scores(scored.withColumn("chrom", F.lit("chr2")), f"{tmp_path}/s", append=True)
    assert spark.read.parquet(f"{tmp_path}/s/reads").count() == 2
    found = spark.read.parquet(f"{tmp_path}/s/footprints").where("chrom = 'chr1'").orderBy("footprint")
    assert [(r.footprint, r.start, r.stop, r.score) for r in found.collect()] == [(0, 0, 2, 0.5), (1, 4, 9, 0.25)]


def test_bed_lines_are_sorted(spark):
    from molspan.sources import tables

    lines = spark.createDataFrame([("chr2\t5\t6",), ("chr10\t9\t10",), ("chr10\t10\t11",), ("chr2\t40\t41",)], "line string")
    assert [r.line.split("\t")[:2] for r in tables.sorted_bed(lines).collect()] == [["chr10", "9"], ["chr10", "10"], ["chr2", "5"], ["chr2", "40"]]
