"""Features, posteriors, controls, diagnostics, commands, SQL functions and streams."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from molspan import cli, sql
from molspan.functions import encoding, marks
from molspan.operators import call, contexts, controls, diagnose, extract, posteriors, reads, skew
from molspan.sources import alignments, models
from molspan.streaming import flow

from test_call import reads_of, slow_marks, toy_model

READS = "read_id string, flag int, chrom string, ref_start int, ref_end int, mapq int, cigar array<struct<op:int,n:int>>, seq string, mm string, ml array<int>"


def aligned_rows(seed, n=30, longest=900):
    rng, rows = random.Random(seed), []
    for i, (seq, reverse, mm, ml) in enumerate(reads_of(seed, n, longest)):
        ops, left, on = [], len(seq), 0
        while left:
            op, size = rng.choice([0, 0, 0, 7, 1, 2, 4]), rng.randrange(1, 80)
            size = min(size, left) if op != 2 else size
            ops.append({"op": op, "n": size})
            left -= size if op != 2 else 0
            on += size if op in (0, 2, 7) else 0
        start = rng.randrange(5000)
        rows.append((f"m{i}", 16 if reverse else 0, f"chr{i % 3}", start, start + on, 60, ops, seq, mm, ml))
    return rows


def places(row):
    """Reference place of each base; None off the reference."""
    out, at = [], row[3]
    for x in row[6]:
        if x["op"] in (0, 7):
            out += range(at, at + x["n"])
        elif x["op"] in (1, 4):
            out += [None] * x["n"]
        at += x["n"] if x["op"] in (0, 2, 7) else 0
    return out


def test_annotation_text():
    n, rows = extract.annotations("500;nuc.QQQ:1-10,21-5;msp.:11-10;tf+QQQ:30-4;;", [1, 2, 3, 4, 5, 6, 7, 8], "a,b,.,d")
    assert n == 500 and [(r["kind"], r["start"], r["n"], r["quals"], r["name"]) for r in rows] == [("nuc", 0, 10, [1, 2, 3], "a"), ("nuc", 20, 5, [4, 5, 6], "b"), ("msp", 10, 10, [], ""), ("tf", 29, 4, [7, 8], "d")]
    for bad in ("", "x;nuc.:1-2", "5;nuc:1-2", "5;nuc.", "5;nuc.Q:12", "5;nuc.Q:a-b"):
        with pytest.raises(ValueError):
            extract.annotations(bad)
    two = extract.circular_parts([{"start": 0, "n": 5, "name": "w"}, {"start": 90, "n": 10, "name": "w"}, {"start": 30, "n": 4, "name": "x"}, {"start": 50, "n": 4, "name": ""}], 100)
    assert [(r["circ_id"], r["part"], r["parts"], r["whole_start"], r["whole_n"]) for r in two] == [("w", 1, 2, 90, 15), ("w", 2, 2, 90, 15), (".", 1, 1, 30, 4), (".", 1, 1, 50, 4)]


def test_marks_as_blocks(spark):
    rows = aligned_rows(3)
    rows.append(("none", 4, None, -1, None, 0, [], "ACGT", "A+a,0;", [200]))
    rows.append(("second", 256, "chr1", 5, 9, 0, [{"op": 0, "n": 4}], "AAAA", "A+a,0;", [200]))
    got = {r.name: r for r in extract.features(spark.createDataFrame(rows, READS), ("m6a",)).collect()}
    want = {}
    for r in rows[:30]:
        on = places(r)
        found = sorted((on[p], q) for _, c, p, q in slow_marks(r[8], r[9], r[7], r[1] == 16) if c == "a" and q >= 125 and on[p] is not None)
        if found:
            want[r[0]] = ([a - found[0][0] for a, _ in found], [q for _, q in found], int(sum(q for _, q in found) / len(found)), found[0][0], found[-1][0] + 1, "-" if r[1] else "+")
    assert {n: (x.chromStarts, x.s1, x.score, x.chromStart, x.chromEnd, x.strand) for n, x in got.items()} == want and len(want) > 20


def test_calls_come_back_as_features(spark):
    """What call() writes in the molecule's direction, features() puts on the reference as the calls are stored."""
    rows, o = aligned_rows(5), call.Options(min_length=50, nuc_min=30, unify=45)
    made = call.call(spark.createDataFrame(rows, READS).withColumn("is_reverse", F.col("flag") == 16), toy_model(3), o).cache()
    kept = {r.read_id: r for r in made.collect()}
    got = {(r.feature, r.name): r for r in extract.features(made, ("nucleosome", "msp", "tf"), min_tq=0).collect()}
    n_tf = 0
    for r in rows:
        on, c = places(r), kept[r[0]]
        if c.skip_reason:
            assert not any(k[1] == r[0] for k in got)
            continue
        block = lambda a, n: (min(on[a], on[a + n - 1]), max(on[a], on[a + n - 1]) + 1) if on[a] is not None and on[a + n - 1] is not None else None  # noqa: E731, B023
        tf = sorted((*block(x.start, x.n), x.q, x.el, x.er) for x in c.tf if block(x.start, x.n))
        found = got.get(("tf", r[0]))
        assert (tf == []) == (found is None)
        if found:
            n_tf += 1
            assert [(found.chromStart + s, found.chromStart + s + z, a, b, d) for s, z, a, b, d in zip(found.chromStarts, found.blockSizes, found.s1, found.s2, found.s3)] == tf
        turn = lambda s, n: len(r[7]) - s - n if r[1] else s  # noqa: E731, B023
        nucs = sorted(filter(None, (block(turn(s, n), n) for s, n in zip(c.ns, c.nl))))
        found = got.get(("nucleosome", r[0]))
        assert (nucs == []) == (found is None) and (not found or [(found.chromStart + s, found.chromStart + s + z) for s, z in zip(found.chromStarts, found.blockSizes)] == nucs)
        if found:  # the older tags give the same blocks, without edges
            older = extract.features(made.where(F.col("read_id") == r[0]).drop("ma"), ("nucleosome",)).first()
            assert older.chromStarts == found.chromStarts and older.s1 == found.s1 and older.score == found.score
    assert n_tf > 3


def test_circular_rows_and_files(spark, tmp_path):
    base = [("c", 0, "chr1", 100, 200, 60, [{"op": 0, "n": 100}], "A" * 100, None, None, "100;nuc.Q:1-20,91-10,41-30;msp.:21-20", [9, 9, 80], "fhw_nuc_0,fhw_nuc_0,fh_nuc_1,fh_msp_0", 2**40, 5)]
    df = spark.createDataFrame(base, READS + ", ma string, ma_aq array<int>, an string, hp long, ps int")
    got = sorted((r.name, r.chromStart, r.chromEnd, r.circPart, r.circParts, r.molStart, r.molLength, r.hp, r.ps) for r in extract.features(df, ("footprint",), circles=True).collect())
    assert got == [("c", 140, 170, 1, 1, 40, 30, -1, 5), ("c|nuc|fhw_nuc_0|1/2", 100, 120, 1, 2, 90, 30, -1, 5), ("c|nuc|fhw_nuc_0|2/2", 190, 200, 2, 2, 90, 30, -1, 5)]
    extract.write_bed(df, f"{tmp_path}/out", ("nucleosome", "tf"), sample="a b.c", block_scores=True, haplotypes=True, contigs=spark.createDataFrame([("chr1", 500)], "chrom string, length long"))
    line = spark.read.text(f"{tmp_path}/out/nucleosome.bed").first()[0]
    assert line == "chr1\t100\t200\tc\t32\t+\t100\t200\t0\t3\t20,30,10\t0,40,90\t9,80,9\t0,0,0\t0,0,0\t-1\t5"
    definition = "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/out/nucleosome.as").collect())
    assert 'Sample: a_b_c. ' in definition and definition.count(";") == 17 and spark.read.text(f"{tmp_path}/out/tf.bed").count() == 0
    assert spark.read.text(f"{tmp_path}/out/chrom.sizes").first()[0] == "chr1\t500"
    assert "Sample: new. " in extract.with_sample(definition, "new") and "a_b_c" not in extract.with_sample(definition, "new")
    assert extract.sample_of_file("/x/pool.1_tf.bb") == "pool.1" and extract.sample_of_file("s.sorted.bam") == "s"
    with pytest.raises(ValueError):
        extract.features(df, ("other",))


def test_joined_blocks(spark):
    shape = "chromStart int, chromEnd int, thickStart int, thickEnd int, blockCount int, blockSizes array<int>, chromStarts array<int>, read_start int, read_end int"
    row = extract.joined_blocks(spark.createDataFrame([(10, 60, 10, 60, 4, [10, 5, 9, 10], [0, 10, 12, 40], 5, 60)], shape)).first()
    assert (row.chromStart, row.chromEnd, row.blockCount, row.blockSizes, row.chromStarts) == (5, 60, 3, [1, 21, 10], [0, 5, 45])


def test_deamination_sources(spark):
    ops = [{"op": 0, "n": 8}]
    rows = [("u", 0, "c", 10, 18, 60, ops, "ACGTACGT", "C+u,0;G+u,1;", [200, 100]), ("y", 0, "c", 10, 18, 60, ops, "AYGTARGT", None, None), ("md", 0, "c", 10, 18, 60, ops, "ATGTAAGT", None, None), ("no", 0, "c", 10, 18, 60, ops, "ACGTACGT", None, None)]
    df = spark.createDataFrame(rows, READS).withColumn("md", F.when(F.col("read_id") == "md", "1C3G2").otherwise(F.lit(None)))
    got = {r.name: ([r.chromStart + s for s in r.chromStarts], r.s1, r.score) for r in extract.features(df, ("deam",), threshold=0).collect()}
    assert got == {"u": ([11, 16], [1, 0], 255), "y": ([11, 15], [1, 0], 255), "md": ([11, 15], [1, 0], 255)}
    assert diagnose.sniff_mode(df) == "daf" and diagnose.sniff_mode(df.where("read_id = 'no'")) is None
    with pytest.raises(ValueError):
        diagnose.check_deaminase_input(df.where("read_id = 'no'"))
    diagnose.check_deaminase_input(df.where("read_id = 'no'"), has_reference=True)
    diagnose.check_deaminase_input(df)


def test_diagnostics(spark):
    rows = [(1, "ACGT", "A+a,0;T+a,0;", None), (2, "ACGT", "A+a;C+m,0;", None), (3, "ACGT", None, None)]
    df = spark.createDataFrame(rows, "read_id int, seq string, mm string, ns array<int>")
    assert diagnose.sniff_mode(df) == "pacbio-fiber" and diagnose.sniff_mode(df.where("read_id = 2")) == "nanopore-fiber"
    report = diagnose.tag_report(df).first()
    assert (report.n, report.has_mm, report.has_ns, report.kinds) == (3, 2, 0, ["A+a", "C+m", "T+a"])
    assert diagnose.outputs_to_write(["m6a", "deam"], df) == ["m6a"] and diagnose.outputs_to_write(["deam"], df, explicit=True) == ["deam"]
    assert {r.kind: r.n for r in diagnose.mark_kinds(df).collect()} == {"A+a": 2, "T+a": 1, "C+m": 1}
    shape = "seq string, cigar array<struct<op:int,n:int>>, md string"
    made = marks.stamped(spark.createDataFrame([("ATAT", [{"op": 0, "n": 4}], "1C1C"), ("AA", [{"op": 0, "n": 2}], "G1"), ("AA", None, None)], shape))
    got = diagnose.change_summary(made).first()
    assert (got.total, got.encoded, got.ct, got.ga, got.skipped, got.mean_rate) == (3, 2, 1, 1, 1, 0.5)
    assert {r.st: r.n for r in diagnose.strand_counts(made).collect()} == {"CT": 1, "GA": 1, None: 1}


def test_posteriors(spark, tmp_path):
    rows, model = aligned_rows(8), toy_model(3)
    df = spark.createDataFrame(rows, READS)
    found = posteriors.export(df, model, mode="pacbio-fiber", trim=5)
    got = {r.read_id: r for r in found.collect()}
    kept = [r for r in rows if len(r[7]) >= 100 and len({p for *_, p, q in slow_marks(r[8], r[9], r[7], r[1] == 16) if q >= 128}) >= 10]
    assert set(got) == {r[0] for r in kept} and len(kept) > 10
    for r in kept:
        on = [-1 if p is None else p for p in places(r)]
        assert got[r[0]].ref_positions == on and len(got[r[0]].posterior) == len(on) and got[r[0]].strand == ("-" if r[1] else "+")
    posteriors.write(found, f"{tmp_path}/p", mode="x")
    back = posteriors.load(spark, f"{tmp_path}/p").cache()
    assert back.count() == len(kept) and posteriors.sink("a.tsv.gz") == "tsv" and posteriors.sink("a.h5") == "parquet"
    posteriors.write(found, f"{tmp_path}/lines.tsv", mode="x")
    assert spark.read.text(f"{tmp_path}/lines.tsv/lines").count() == len(kept)
    a, b = 1000, 3000
    over = {r.read_id for r in posteriors.overlapping(back, "chr1", a, b).collect()}
    assert over == {r[0] for r in kept if r[2] == "chr1" and r[4] > a + 1 and r[3] < b - 1}
    one = kept[0]
    assert {r.read_id for r in posteriors.spanning(back, one[2], one[3] + 1, one[4] - 1).collect()} >= {one[0]}
    lo, hi = one[3], one[4]
    for how in ("max", "mean", "first"):
        want = np.zeros(hi - lo)
        for p, v in zip(got[one[0]].ref_positions, got[one[0]].posterior):
            if lo <= p < hi:
                want[p - lo] = v
        values = posteriors.projection(back.where(F.col("read_id") == one[0]), lo, hi, how).first().values
        assert np.allclose(values, want)
    cover = back.where(F.col("read_id") == one[0]).select(posteriors.coverage(lo, hi).alias("c")).first().c
    want = np.zeros(hi - lo)
    for s, n in zip(got[one[0]].fp_starts, got[one[0]].fp_sizes):
        want[max(0, s - lo) : s + n - lo] = 1
    assert cover == want.tolist()


def test_controls(spark):
    rows = spark.createDataFrame([(*r, bool(r[1])) for r in aligned_rows(2)], READS + ", is_reverse boolean")
    got = {r.context: (r.hit, r.nohit) for r in controls.control_counts(rows, mode="pacbio-fiber", k=1, min_length=10).collect()}
    want = {}
    for r in aligned_rows(2):
        if len(r[7]) < 10:
            continue
        at = {p for b, _, p, q in slow_marks(r[8], r[9], r[7], r[1] == 16) if b in "AT" and q >= 128}
        for i in range(1, len(r[7]) - 1):
            c = r[7][i - 1 : i + 2]
            if c[1] == "A" and "N" not in c:
                h, n = want.get(c, (0, 0))
                want[c] = (h + (i in at), n + (i not in at))
    assert got == want
    assert {r.reason for r in controls.funnel(rows.withColumn("mm", F.lit(None).cast("string")), min_length=1).collect()} <= {"no_mm", "no_sequence"}
    # deaminases: marked T on one strand, marked A on the other, before the change and turned round
    daf = spark.createDataFrame([("ACTCATTA", [2, 5]), ("TGAGTACA", [2, 5]), ("ACGT", [0, 3])], "seq string, marks array<int>")
    got = controls.before_change(controls.strand_of_marks(daf, "daf"))
    assert sorted((r.seq, sorted(r.marks)) for r in got.collect()) == [("ACCCATTA".replace("ATTA", "ACTA"), [2, 5]), ("TGCACCCA".replace("TGCACCCA", "TGCACCCA"), [2, 5])]
    counts = contexts.mark_counts(daf, k=1)
    assert {r.context: (r.hit, r.nohit) for r in counts.collect()} == {"CAT": (0, 1), "GAG": (1, 0), "TAC": (1, 0)}
    inside = controls.footprint_contexts(spark.createDataFrame([("CACACAC", [1], [3])], "seq string, ns array<int>, nl array<int>"), k=1)
    assert [(r.context, r.accessible_bp, r.total_bp) for r in inside.collect()] == [("CAC", 1, 3)]


def test_transfer(spark):
    rows = [(f"c{i}", 0.1 + 0.05 * i, 10_000) for i in range(15)]
    target = spark.createDataFrame([(c, int(n * (0.02 + 0.6 * p)), n - int(n * (0.02 + 0.6 * p))) for c, p, n in rows], "context string, hit long, nohit long")
    priors = spark.createDataFrame([(c, int(n * p), n, p) for c, p, n in rows], "context string, accessible_bp long, total_bp long, p_accessible double")
    found = controls.transfer(target, priors)
    assert found.p_prot == pytest.approx(0.02, abs=1e-3) and found.p_acc == pytest.approx(0.62, abs=1e-3) and found.n == 15 and found.r2 > 0.99
    with pytest.raises(ValueError):
        controls.transfer(target.limit(4), priors)


def test_samples_and_training(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("read_id"), (F.col("id") % 3).alias("file"), F.repeat(F.lit("A"), (F.col("id") + 1).cast("int")).alias("seq"))
    one = [r.read_id for r in controls.sample_reads(df.unionByName(df), 50, 1).collect()]
    assert len(set(one)) == 50 and one == [r.read_id for r in controls.sample_reads(df, 50, 1).collect()] != [r.read_id for r in controls.sample_reads(df, 50, 2).collect()]
    few = df.where("file > 0 OR id < 6")
    per = controls.sample_reads(few, 30, 1, by="file").groupBy("file").count().collect()
    assert {r.file: r["count"] for r in per}[0] == 2 and sum(r["count"] for r in per) == 30
    long = np.mean([int(r.read_id) for r in controls.by_position(df, 60, 3, 1000).collect()])
    assert long > 170 and controls.by_position(df, 60, 3, 1000).count() == 60
    assert controls.top_up(df.limit(7), 20, 1).count() == 20 and controls.top_up(df.limit(0), 20, 1).count() == 0 and controls.top_up(df, 20, 1).count() == 300
    rows = spark.createDataFrame([(*r, bool(r[1])) for r in aligned_rows(6, 12, 200)], READS + ", is_reverse boolean")
    model = toy_model(2)
    trained = controls.train_all(controls.training_rows(rows, mode="pacbio-fiber", k=2), model, restarts=2, rounds=3)
    assert len(trained) == 2 and trained[0][1] >= trained[1][1] and {m.emission for m, _ in trained} == {model.ordered().emission}


def test_second_pass_over_tagged_reads(spark):
    rows, model = aligned_rows(9), toy_model(3)
    o = call.Options(min_length=50, nuc_min=30, unify=45)
    df = spark.createDataFrame(rows, READS).withColumn("is_reverse", F.col("flag") == 16)
    first = call.apply(df, model, o)
    again = {r.read_id: r for r in call.recall_tagged(first, model, o).collect()}
    fused = {r.read_id: r for r in call.call(df, model, o).collect()}
    same = 0
    for i, r in fused.items():
        if r.skip_reason is None and again[i].skip_reason is None:
            assert (again[i].ns, again[i].nl, again[i].ma, again[i].tf) == (r.ns, r.nl, r.ma, r.tf)
            same += 1
    assert same > 15
    bare = first.where("skip_reason IS NULL").withColumns({"mm": F.lit(None).cast("string"), "nq": F.transform("ns", lambda x: F.lit(7))})
    kept = {r.read_id: r for r in call.recall_tagged(bare, model, o).collect()}
    before = {r.read_id: r for r in bare.collect()}
    assert all(kept[i].skip_reason == "no_marks" and (kept[i].ns, kept[i].nq, kept[i].ma) == (r.ns, r.nq, r.ma) for i, r in before.items())
    scored = first.withColumn("nq", F.transform("ns", lambda x, i: (i % 200).cast("int")))
    quality = {r.read_id: dict(zip(zip(r.ns, r.nl), r.nq)) for r in scored.where("skip_reason IS NULL").collect()}
    for r in call.recall_tagged(scored, model, call.replace(o, recall=False)).where("skip_reason IS NULL").collect():
        assert all(quality[r.read_id][a, b] == q for a, b, q in zip(r.ns, r.nl, r.nq or []))
    assert call.estimate_repeat(df, model, o) == 185


def test_sql_functions(spark):
    model = toy_model(1)
    names = sql.register(spark, model, k=1, trim=1)
    assert {"mark_positions", "decode", "state_runs"} <= set(names)
    seq, reverse, mm, ml = reads_of(3, 1)[0]
    spark.createDataFrame([(1, seq, reverse, mm, ml, "9;nuc.Q:2-3,7-1")], "read_id int, seq string, is_reverse boolean, mm string, ml array<int>, ma string").createOrReplaceTempView("sql_reads")
    row = spark.sql("SELECT *, decode(codes) AS states, protected(codes) AS p FROM (SELECT *, symbols(seq, m, is_reverse) AS codes FROM (SELECT *, mark_positions(mm, ml, seq, is_reverse) AS m, reverse_complement(seq) AS rc FROM sql_reads))").first()
    assert row.m == sorted({p for b, _, p, q in slow_marks(mm, ml, seq, reverse) if q >= 125}) and len(row.states) == len(seq) == len(row.p)
    runs = spark.sql("SELECT r.* FROM (SELECT array(0, 0, 1, 0) AS s), LATERAL state_runs(s) r").collect()
    assert [tuple(r) for r in runs] == [(0, 0, 2), (1, 2, 3), (0, 3, 4)]
    assert [tuple(r) for r in spark.sql("SELECT a.* FROM sql_reads, LATERAL annotations(ma) a").collect()] == [("nuc", 1, 3), ("nuc", 6, 1)]
    assert encoding.n_symbols(1) == len(model.emission[0])


def test_streamed_calls(spark, tmp_path):
    rows, model, o = aligned_rows(4), toy_model(3), call.Options(min_length=50)
    df = spark.createDataFrame([(*r, i, bool(r[1])) for i, r in enumerate(rows)], READS + ", voffset long, is_reverse boolean")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    got = flow.call_stream(spark, f"{tmp_path}/in", ", ".join(f"{n} {t}" for n, t in df.dtypes), model, o, files_per_trigger=1, ordered_by="voffset")
    plain = lambda d: sorted((r.read_id, r.ma, r.skip_reason) for r in d.collect())
    assert plain(got) == plain(call.call(df, model, o)) and got.select("batch").distinct().count() >= 3


def test_lookup_of_hot_keys(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 700, 7).otherwise(F.col("id") % 90 + 100).alias("k"), "id")
    table = rows.groupBy("k").count().where("k <> 150").withColumnRenamed("count", "n")
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(table, "k", how).select("k", "id", "n").collect()))
        got = skew.lookup(rows, table, ["k"], "n", how, hot=10, limit=20)
        assert sorted(map(str, got.select("k", "id", "n").collect())) == want


def test_reports(spark):
    df = spark.createDataFrame([(100, [0, 20], [10, 30], [10], [10]), (50, None, None, None, None)], "read_length int, ns array<int>, nl array<int>, `as` array<int>, al array<int>")
    got = {r.measure: r for r in reads.footprint_report(df).collect()}
    assert got["footprint_size"].mean == 20 and got["gap_size"].n == 1 and got["msps_per_read"].n == 2 and got["footprints_per_read"].n == 1
    assert "footprint_size: n 2" in reads.report_text(reads.footprint_report(df))
    sizes = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert {r.bin_start: r.n for r in reads.histogram(sizes, "v", 50).collect()} == {0: 50, 50: 50, 100: 1}
    assert tuple(reads.quick_summary(sizes, "v").first())[5] == 50.0


# Commands


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("cli"))
    rows = aligned_rows(12, 25, 1200)
    df = spark.createDataFrame(rows, READS)
    alignments.write(df, f"{folder}/in", [(f"chr{i}", 100_000) for i in range(3)], "@HD\tVN:1.6\n")
    models.save(models.Saved(toy_model(3), 3, "pacbio-fiber"), f"{folder}/hia5_pacbio.json")
    return folder, rows


def test_call_and_extract_commands(spark, inputs, tmp_path, capsys):
    folder, rows = inputs
    run = lambda *a: cli.main([str(x) for x in a], spark)
    assert run("call", "-i", f"{folder}/in", "-o", f"{tmp_path}/bam", "--format", "bam", "--join", f"{tmp_path}/all.bam", "--models", folder, "--enzyme", "hia5", "--platform", "pacbio", "--min-length", 50) == 0
    text, _ = alignments.file_header(f"{tmp_path}/all.bam")
    assert alignments.has_marker(text) and "PN:molspan" in text
    made = spark.read.format("alignments").load(f"{tmp_path}/all.bam")
    assert made.count() == len(rows) and made.where("ma IS NOT NULL").count() > 10
    assert run("recall-nucs", "-i", f"{tmp_path}/all.bam", "-o", f"{tmp_path}/again", "-m", f"{folder}/hia5_pacbio.json", "--min-length", 50, "--phase", "off") == 0
    assert run("apply", "-i", f"{folder}/in", "-o", f"{tmp_path}/applied", "-m", f"{folder}/hia5_pacbio.json", "--min-length", 50, "--scores", "--no-msps") == 0
    assert spark.read.parquet(f"{tmp_path}/applied").where("`as` IS NOT NULL").count() == 0
    assert run("extract", "-i", f"{tmp_path}/all.bam", "-o", f"{tmp_path}/bed", "--block-scores") == 0
    assert spark.read.text(f"{tmp_path}/bed/nucleosome.bed").count() > 10 and spark.read.text(f"{tmp_path}/bed/chrom.sizes").count() == 3
    assert run("posteriors", "-i", f"{folder}/in", "-o", f"{tmp_path}/post", "-m", f"{folder}/hia5_pacbio.json", "--trim", 10) == 0
    assert run("report", "-i", f"{tmp_path}/again", "-o", f"{tmp_path}/report") == 0 and "footprint_size" in "".join(r[0] for r in spark.read.text(f"{tmp_path}/report/summary.txt").collect())
    assert run("run") == 2 and run("call", "-i", f"{folder}/in", "-o", f"{tmp_path}/x", "-m", f"{folder}/nowhere.json") == 2
    capsys.readouterr()
    assert run("utils", "inspect", f"{folder}/hia5_pacbio.json") == 0 and json.loads(capsys.readouterr().out)["k"] == 3
    assert run("utils", "adjust", f"{folder}/hia5_pacbio.json", f"{tmp_path}/a.json", "--state", 0, "--factor", 2) == 0 and run("utils", "convert", f"{tmp_path}/a.json", f"{tmp_path}/b.json", "--by-symbol") == 0
    with pytest.raises(SystemExit):
        run("nothing")


def test_probs_train_and_transfer_commands(spark, inputs, tmp_path):
    folder, _ = inputs
    run = lambda *a: cli.main([str(x) for x in a], spark)
    assert run("probs", "-a", f"{folder}/in", "-u", f"{folder}/in", "-o", f"{tmp_path}/p", "-k", 2, 3, "--min-length", 50, "--min-mapq", 0) == 0
    assert models.probabilities(spark, f"{tmp_path}/p/accessible_k2.tsv").count() > 100
    assert run("train", "-i", f"{folder}/in", "-o", f"{tmp_path}/t", "-a", f"{tmp_path}/p/accessible_k2.tsv", "-u", f"{tmp_path}/p/inaccessible_k2.tsv", "-k", 2, "-n", 5, "--restarts", 1, "--min-length", 50) == 0
    assert models.load(f"{tmp_path}/t/best-model.json").k == 2


def test_deaminase_commands(spark, tmp_path, capsys):
    rng, rows = random.Random(1), []
    genome = "".join(rng.choices("ACGT", k=3000))
    for i in range(12):
        a = rng.randrange(0, 1500)
        ref = genome[a : a + 1200]
        seq = "".join("T" if c == "C" and (k * (7 if i < 9 else i)) % 5 == 0 else c for k, c in enumerate(ref)) if i % 4 else rows[0][7] if i else "".join("T" if c == "C" and k % 5 == 0 else c for k, c in enumerate(ref))
        a = rows[0][3] if i and i % 4 == 0 else a
        rows.append((f"d{i}", 0, "chr1", a, a + 1200, 60 - i, [{"op": 0, "n": 1200}], seq, None, None))
    spark.createDataFrame(rows, READS).write.parquet(f"{tmp_path}/in")
    (tmp_path / "g.fa").write_text(f">chr1\n{genome}\n")
    run = lambda *a: cli.main([str(x) for x in a], spark)
    assert run("daf-encode", "-i", f"{tmp_path}/in", "-o", f"{tmp_path}/enc", "--reference", f"{tmp_path}/g.fa") == 0
    told = json.loads(capsys.readouterr().out)
    assert told["encoded"] == told["ct"] == 12
    assert run("dedup", "-i", f"{tmp_path}/enc", "-o", f"{tmp_path}/one", "--clusters", f"{tmp_path}/c.tsv") == 0
    kept = {r.read_id for r in spark.read.parquet(f"{tmp_path}/one").collect()}
    assert "d0" in kept and not kept & {"d4", "d8"} and len(kept) == 10
    assert [r.n_reads for r in models.tsv(spark, f"{tmp_path}/c.tsv").collect()] == ["3"]
    assert run("dedup", "-i", f"{tmp_path}/enc", "-o", f"{tmp_path}/flagged", "--flag") == 0
    assert {r.read_id for r in spark.read.parquet(f"{tmp_path}/flagged").where("flag & 1024 <> 0").collect()} == {"d4", "d8"}
