"""Alignment files, model files, tables and references."""

import json
import os
import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from molspan.functions import encoding
from molspan.functions.chain import Model
from molspan.sources import alignments, models

SHAPE = "read_id string, flag int, chrom string, ref_start int, mapq int, cigar array<struct<op:int,n:int>>, seq string, qual string, mm string, ml array<int>, ns array<int>, nl array<int>, hp int, tags binary"
CONTIGS = [("chr1", 300_000), ("chr2", 300_000), ("chr3", 300_000)]


def random_rows(n, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        size, mapped = rng.randrange(1, 1500), rng.random() < 0.95
        qual = None if i % 3 else "".join(chr(33 + rng.randrange(60)) for _ in range(size))
        rows.append((f"r{i:05d}", 0 if mapped else 4, f"chr{rng.randrange(1, 4)}" if mapped else None, rng.randrange(200_000) if mapped else -1, rng.randrange(60), [{"op": 0, "n": size}] if mapped else [], "".join(rng.choices("ACGTN", k=size)), qual, "A+a,0;" if i % 2 else None, [i % 256] if i % 2 else None, [3, 7], [1, 2], i % 5 if i % 4 else None, b"XYZhello\0XBBS\x02\0\0\0\x01\0\x02\0" if i % 3 == 0 else b""))
    return rows


def plain(r):
    return (r.read_id, r.flag, r.chrom, r.ref_start, r.mapq, [(c.op, c.n) for c in r.cigar], r.seq, r.qual, r.mm, r.ml, r.ns, r.nl, r.hp, bytes(r.tags))


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bam"))
    rows = random_rows(700)
    alignments.register(spark)
    text = alignments.with_marker(alignments.with_program("@HD\tVN:1.6\n", "molspan", version="1"))
    alignments.write(spark.createDataFrame(rows, SHAPE).repartition(3), f"{folder}/parts", CONTIGS, text)
    one = alignments.join_files(f"{folder}/parts", f"{folder}/all.bam")
    return folder, one, rows


@pytest.mark.parametrize("split", [1 << 30, 100_000, 30_000, 7_000])
def test_rows_come_back_whatever_the_splits(spark, files, split):
    _, one, rows = files
    found = spark.read.format("alignments").option("split_bytes", split).load(one)
    want = sorted((*r[:5], [(c["op"], c["n"]) for c in r[5]], *r[6:]) for r in rows)
    got = sorted(map(plain, found.collect()), key=lambda r: r[0])
    assert got == want and (split > 100_000 or found.rdd.getNumPartitions() > 3)
    places = [(r.voffset, r.chrom or "~", r.ref_start) for r in found.select("voffset", "chrom", "ref_start").collect()]
    assert sorted(places) == sorted(places, key=lambda p: (p[1], p[2], p[0])) and len({p[0] for p in places}) == len(rows)


def test_regions_and_filters(spark, files):
    folder, one, rows = files
    alignments.write_index(one)
    assert alignments.read_index(one) is not None
    for path in (one, f"{folder}/parts"):  # with and without an index
        read = lambda **o: sorted(r.read_id for r in spark.read.format("alignments").options(**o).load(path).select("read_id").collect())  # noqa: E731, B023
        inside = [r for r in rows if r[2] == "chr2" and r[3] < 90_000 and r[3] + len(r[6]) > 1000]
        assert read(region="chr2:1,001-90,000") == sorted(r[0] for r in inside)
        assert read(region="chr2:1001-90000", owned="true", min_mapq="30") == sorted(r[0] for r in inside if r[3] >= 1000 and r[4] >= 30)
        assert read(region="chr2") == sorted(r[0] for r in rows if r[2] == "chr2") and read(region="chrX") == []
        bins = [read(region=f"chr1:{a + 1}-{a + 50_000}", owned="true") for a in range(0, 300_000, 50_000)]
        assert sorted(sum(bins, [])) == sorted(r[0] for r in rows if r[2] == "chr1")
    assert read(mapped="true", min_length="700") == sorted(r[0] for r in rows if r[1] == 0 and len(r[6]) >= 700)


def test_headers(spark, files):
    _, one, _ = files
    text, names = alignments.file_header(one)
    assert names == CONTIGS and alignments.has_marker(text) and not alignments.has_marker("@HD\tVN:1.6\n") and alignments.has_marker("@CO\tother:coord=molecular\n")
    assert [tuple(r) for r in alignments.contigs(spark, one).orderBy("tid").collect()] == [(i, *c) for i, c in enumerate(CONTIGS)]
    again = alignments.with_program(alignments.with_program(text, "molspan", command="x"), "other")
    lines = [x for x in again.split("\n") if x.startswith("@PG")]
    assert [x.split("\t")[1] for x in lines] == ["ID:molspan", "ID:molspan.2", "ID:other"] and lines[1].endswith("PP:molspan") and lines[2].endswith("PP:molspan.2")
    assert alignments.with_marker(text) == text


def test_sorting_only_where_it_is_needed(spark, tmp_path):
    rows = random_rows(60, 5)
    path = f"{tmp_path}/x.bam"
    alignments.write(spark.createDataFrame(rows, SHAPE), f"{tmp_path}/p", CONTIGS, ordered=False)
    alignments.join_files(f"{tmp_path}/p", path, CONTIGS)
    with pytest.raises(ValueError):
        alignments.write_index(path)
    alignments.sort_and_index(spark, path)
    found = spark.read.format("alignments").load(path).collect()
    assert sorted(r.read_id for r in found) == sorted(r[0] for r in rows) and os.path.exists(path + ".bai")
    placed = [(r.chrom, r.ref_start) for r in found if r.chrom]
    assert placed == sorted(placed)
    alignments.register(spark)
    empty = spark.createDataFrame([], SHAPE)
    alignments.write(empty, f"{tmp_path}/none", CONTIGS)
    assert alignments.file_header(alignments.join_files(f"{tmp_path}/none", f"{tmp_path}/none.bam", CONTIGS))[1] == CONTIGS
    assert spark.read.format("alignments").load(f"{tmp_path}/none.bam").count() == 0
    with pytest.raises(FileNotFoundError):
        alignments.list_files(f"{tmp_path}/nowhere")
    with open(path, "rb") as file:
        data = file.read()
    (tmp_path / "cut.bam").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="cut short|not a blocked"):
        spark.read.format("alignments").load(f"{tmp_path}/cut.bam").count()


def test_a_stream_of_files(spark, files, tmp_path):
    folder, _, rows = files
    query = spark.readStream.format("alignments").load(f"{folder}/parts").select("read_id").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.read_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(r[0] for r in rows)


def test_reference_bases(spark, tmp_path):
    rng = random.Random(3)
    genome = {c: "".join(rng.choices("ACGT", k=n)) for c, n in (("chr1", 1000), ("chr2", 70))}
    (tmp_path / "x.fa").write_text("".join(f">{c} about\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for c, s in genome.items()))
    pieces = alignments.reference(spark, f"{tmp_path}/x.fa", width=64)
    rows = [(f"r{i}", c, a, min(a + n, len(genome[c])), 0) for i, (c, a, n) in enumerate([("chr1", 0, 64), ("chr1", 63, 3), ("chr1", 100, 700), ("chr2", 5, 200), ("chr1", 990, 10)])] + [("u", None, -1, None, 4), ("x", "chr9", 3, 9, 0)]
    got = {r.read_id: r.ref_seq for r in alignments.with_reference(spark.createDataFrame(rows, "read_id string, chrom string, ref_start int, ref_end int, flag int"), pieces, width=64).collect()}
    assert got == {r: genome[c][a:b] if c in genome else None for r, c, a, b, _ in rows}


# Models


def small(k=1):
    top = encoding.alphabet(k)
    rng = np.random.default_rng(1)
    rows = [np.concatenate((p, [1e-30], 1 - p, [1.0])) for p in (rng.uniform(0.1, 0.2, top), rng.uniform(0.6, 0.8, top))]
    return models.Saved(Model((0.3, 0.7), (0.9, 0.8), tuple(tuple(map(float, r)) for r in rows)), k, "daf")


def near(a, b):
    return a.k == b.k and a.mode == b.mode and np.allclose(a.model.start, b.model.start) and np.allclose(a.model.stay, b.model.stay) and np.allclose(a.model.emission, b.model.emission)


def test_models_come_back(spark, tmp_path):
    m = small()
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        path = models.save(m, f"{tmp_path}/m.npz")
    assert path.endswith("m.json") and said and near(models.load(path), m) and near(models.load(path, spark=spark), m)
    np.savez(f"{tmp_path}/a.npz", n_states=2, startprob=m.model.start, transmat=[[0.9, 0.1], [0.2, 0.8]], emissionprob=m.model.emission, context_size=1, mode="daf")
    assert near(models.load(f"{tmp_path}/a.npz"), m)
    turned = {"startprob_": [0.7, 0.3], "transmat_": [[0.8, 0.2], [0.1, 0.9]], "emissionprob_": [list(m.model.emission[1]), list(m.model.emission[0])], "context_size": 1, "mode": "daf"}
    assert near(models.from_dict(turned), m) and near(models.from_dict({"model": turned, "context_size": 1, "mode": "daf"}), m)
    assert not near(models.from_dict(turned, ordered=False), m)
    assert models.from_dict({**turned, "mode": "stranded"}).mode == "nanopore-fiber"
    by_symbol = json.loads(open(models.save(m, f"{tmp_path}/s.json", by_symbol=True)).read())
    assert len(by_symbol["emissionprob"]) == 34 and near(models.Saved(models.from_parts(by_symbol["startprob"], by_symbol["transmat"], by_symbol["emissionprob"]), 1, "daf"), m)
    for bad in ("x.pickle", "x.pkl"):
        with pytest.raises(ValueError):
            models.load(f"{tmp_path}/{bad}")
    with pytest.raises(ValueError):
        models.from_dict({"startprob": [1, 0]})

    class Foreign:
        startprob_, transmat_, emissionprob = m.model.start, [[0.9, 0.1], [0.2, 0.8]], m.model.emission

    assert np.allclose(models.foreign(Foreign()).emission, m.model.emission)
    with pytest.raises(ValueError):
        models.foreign(object())
    rows = models.emission_rows(spark, m).collect()
    assert len(rows) == 34 and rows[0].p0 == m.model.emission[0][0]


def test_registry(tmp_path):
    (tmp_path / "hia5_pacbio.json").write_text("{}")
    (tmp_path / "ddda_apply.json").write_text("{}")
    with pytest.warns(UserWarning):
        assert models.registered(str(tmp_path), "Hia5").endswith("hia5_pacbio.json")
    assert models.registered(str(tmp_path), "ddda", "apply", "pacbio").endswith("ddda_apply.json")
    with pytest.raises(FileNotFoundError):
        models.registered(str(tmp_path), "ddda", "recall")
    for bad in (("nope", "apply", None), ("hia5", "apply", "other"), ("hia5", "sing", "pacbio")):
        with pytest.raises(KeyError):
            models.registered(str(tmp_path), *bad)
    assert models.mode_of("dddb") == "daf" and models.mode_of("hia5", "nanopore") == "nanopore-fiber"
    assert models.resolve_mode("m6a", "daf", None) == "pacbio-fiber" and models.resolve_mode(None, "daf", "pacbio-fiber") == "daf"
    with pytest.raises(ValueError):
        models.resolve_mode(None, None, "unknown")


def test_looking_and_adjusting():
    m = small()
    seen = models.inspect(m)
    assert seen["symbols"] == 34 and seen["states"][0]["duration"] == pytest.approx(10) and seen["states"][1]["mean"] > 0.5
    twice = models.adjusted(m, 0, 9.0).model.emission[0]
    assert max(twice[:16]) == 1.0 and all(a + b == pytest.approx(1) for a, b in zip(twice[:16], twice[17:33])) and models.adjusted(m, 0, 9.0).model.emission[1] == m.model.emission[1]


def test_tables(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("encode\tContext\tHit\tnohit\n0\taca\t3\t1\n1\tcac\t0\t0\n")
    (tmp_path / "b.tsv").write_text("kmer\tprobability\nACA\t0.25\n")
    (tmp_path / "p.tsv").write_text("context\taccessible_bp\ttotal_bp\tp_accessible\nACA\t5\t10\t0.5\nACC\t0\t0\t\n")
    (tmp_path / "r.tsv").write_text("rid\nx\nx\ny\n")
    assert [tuple(r) for r in models.probabilities(spark, f"{tmp_path}/a.tsv").collect()] == [("ACA", 3.0, 1.0, 0.75), ("CAC", 0.0, 0.0, 0.0)]
    assert [tuple(r) for r in models.probabilities(spark, f"{tmp_path}/b.tsv").collect()] == [("ACA", None, None, 0.25)]
    with pytest.raises(ValueError):
        models.probabilities(spark, f"{tmp_path}/r.tsv")
    assert [r.p_accessible for r in models.priors(spark, f"{tmp_path}/p.tsv").collect()] == [0.5, 0.5]
    reads = spark.createDataFrame([("x",), ("z",), ("x",)], "read_id string")
    assert sorted((r.read_id, r.trained) for r in models.flag_trained(reads, models.training_ids(spark, f"{tmp_path}/r.tsv")).collect()) == [("x", True), ("x", True), ("z", False)]
    counts = spark.createDataFrame([("CAC", 1, 3), ("ACA", 2, 2)], "context string, hit long, nohit long")
    models.write_probabilities(counts, f"{tmp_path}/out.tsv")
    assert [tuple(r) for r in models.tsv(spark, f"{tmp_path}/out.tsv").collect()] == [("0", "ACA", "2", "2", "0.5"), ("1", "CAC", "1", "3", "0.25")]
    e = models.emissions({"CAC": (0.5, 0.1)}, 1, "A", adjust=2.0)
    assert e[1][5] == 1.0 and e[0][5] == 0.2 and e[0][5 + 17] == pytest.approx(0.8) and e[1][0] == 0.0 and e[1][17] == 1.0 and e[0][-1] == 1.0


def test_profiles_and_training_files(tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"radial": [0.1, None, 0.3], "linker": 0.5, "min_sep": 120}))
    p = models.profile(f"{tmp_path}/p.json")
    assert p.apart == 120 and p.half == 73 and p.linker == 0.5 and np.isnan(p.radial[1]) and len(p.weights()[0]) == 147
    m = small()
    models.write_training(f"{tmp_path}/run", m, [(m.model, -5.0), (m.model, -6.0)], {"seed": 1})
    assert near(models.load(f"{tmp_path}/run/best-model.json"), m)
    assert [x["score"] for x in json.loads((tmp_path / "run/all_models.json").read_text())] == [-5.0, -6.0]
    assert json.loads((tmp_path / "run/model_config.json").read_text()) == {"seed": 1, "context_size": 1, "mode": "daf"}


def test_contig_filters(spark):
    reads = spark.createDataFrame([("chr1",), ("chrUn_x",), ("chr2",)], "chrom string")
    assert [r.chrom for r in alignments.contig_filter(reads, main=True).collect()] == ["chr1", "chr2"]
    assert alignments.contig_filter(reads, chroms=["chr2", "chr9"]).count() == 1 and alignments.contig_filter(reads).where(F.col("chrom") == "chr1").count() == 1
