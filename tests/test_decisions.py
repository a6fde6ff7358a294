"""What was decided where the published tools are of two minds, one test for each decision."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from molspan.cli import version_key
from molspan.functions import encoding, marks, spans
from molspan.functions import sequences as S
from molspan.operators import call, contexts, extract, posteriors
from molspan.sources import models

from test_call import toy_model


def bytes_(text):
    return np.frombuffer(text.encode(), np.uint8)


def called(rows, o, shape="read_id int, seq string, mm string, ml array<int>, is_reverse boolean", model=None):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    return {r.read_id: r for r in call.call(spark.createDataFrame(rows, shape), model or toy_model(o.k), o).collect()}


def test_q01_score_of_a_patch_is_one_minus_the_predicted_state():
    o, m = call.Options(recall=False, bind=False, scores=True, k=1), toy_model(1)
    codes = np.array([3] * 40 + [20] * 40)  # hits, then misses
    s = call.structure(codes, np.array([80]), m, call.symbol_ratios(m), call.replace(o, nuc_min=10))
    assert s.msp_score[0] < 0.1 and s.footprint_score[0] > 0.9  # low where the chain is certain


def test_q02_query_offsets_are_mapped_before_the_start_is_taken_off(spark):
    shape = "read_id string, flag int, chrom string, ref_start int, cigar array<struct<op:int,n:int>>, seq string, ns array<int>, nl array<int>"
    row = extract.features(spark.createDataFrame([("r", 0, "c", 100, [(4, 10), (0, 20)], "A" * 30, [12], [5])], shape), ("nucleosome",)).first()
    assert (row.chromStart, row.chromEnd) == (102, 107)


def test_q03_tables_meet_by_context_not_by_number(spark):
    a = spark.createDataFrame([("AAC", 1, 1), ("CAC", 3, 1)], "context string, hit long, nohit long")
    b = spark.createDataFrame([("CAC", 1, 3)], "context string, hit long, nohit long")
    assert {r.context: (r.p_acc, r.p_prot) for r in contexts.joined_tables(a, b).collect()} == {"AAC": (0.5, 0.0), "CAC": (0.75, 0.25)}
    numbered = lambda *rows: spark.createDataFrame(rows, "encode int, ratio double")
    assert {r.encode: (r.p_acc, r.p_prot) for r in contexts.joined_codes(numbered((0, 0.5), (1, 0.9)), numbered((1, 0.25)), 2.0).collect()} == {0: (1.0, 0.0), 1: (1.0, 0.5)}
    code = dict((c, k) for k, c in encoding.iter_contexts(1, "A"))
    assert code["CAC"] == 5 and models.emissions({"CAC": (0.75, 0.25)}, 1, "A")[1][5] == 0.75


def test_q04_any_number_of_flanking_bases():
    assert [encoding.alphabet(k) for k in (1, 2, 3)] == [16, 256, 4096]
    step, hit, opp = call.symbol_ratios(toy_model(2))
    assert len(step) == 514 and hit.sum() == 256 and opp.sum() == 512 and step[256] == step[513] == 0.0


def test_q05_one_set_of_options_serves_both_passes(spark):
    assert call.Options().threshold == 128 and call.Options().trim == 10 and call.replace(call.Options(), tagged=True).threshold == 128


def test_q06_the_order_of_sources_is_an_option(spark):
    seq = "AYGT" * 10
    rows = [(1, seq, "C+u,0,0;", [200, 200], False)]
    one = call.observed_reads({c: [None] for c in call.READ} | {"seq": [seq], "mm": ["A+a,0;"], "ml": [np.array([200])], "is_reverse": [False]}, call.Options(mode="daf"))
    two = call.observed_reads({c: [None] for c in call.READ} | {"seq": [seq], "mm": ["A+a,0;"], "ml": [np.array([200])], "is_reverse": [False]}, call.Options(mode="daf", sources=("mm", "ambiguity")))
    assert len(one[2][0]) == 10 and one[3] == ["+"] and two[2][0].tolist() == [0] and two[3] == ["-"] and rows


def test_q07_a_chimera_is_a_reason(spark):
    seq = "T" * 70 + "A" * 50
    shape = "read_id int, seq string, cigar array<struct<op:int,n:int>>, md string"
    md = "0" + "C0" * 70 + "G0" * 50
    o = call.Options(mode="daf", min_length=10, k=1)
    assert called([(1, seq, [(0, 120)], md)], o, shape)[1].skip_reason == "chimera"
    assert called([(1, seq, [(0, 120)], md)], call.replace(o, drop_chimeras=False), shape)[1].skip_reason is None


def test_q08_each_row_once_whatever_its_kind(spark):
    rows = [(1, "ACGT" * 30, None, None, False), (2, None, None, None, False), (3, "AC", None, None, False)]
    got = called(rows, call.Options(min_length=50))
    assert {k: r.skip_reason for k, r in got.items()} == {1: None, 2: "no_sequence", 3: "too_short"}


def test_q09_posteriors_are_in_the_stored_frame_and_given_once(spark):
    seq = "T" * 5 + "ACGTACGTAC" * 12
    data = bytes_(seq)
    at = np.flatnonzero(data == ord("T"))  # As of the molecule, which was read backwards
    row = ("r", "c", 5, 5 + len(seq), 16, [(0, len(seq))], seq, marks.mm_text(data, True, "A", "a", at), [200] * len(at))
    df = spark.createDataFrame([row], "read_id string, chrom string, ref_start int, ref_end int, flag int, cigar array<struct<op:int,n:int>>, seq string, mm string, ml array<int>")
    m = toy_model(1)
    got = posteriors.export(df, m, mode="pacbio-fiber", k=1, trim=1).collect()
    codes = encoding.observe(encoding.NUMBER[data], np.array([len(seq)]), encoding.mark_mask(np.array([len(seq)]), [at]), mode="pacbio-fiber", k=1, trim=1)
    from molspan.functions.chain import accessible_chance

    assert len(got) == 1 and np.allclose(got[0].posterior, 1 - accessible_chance(codes, np.array([len(seq)]), m), atol=1e-6)


def test_q10_letters_of_marks_are_not_asked_unless_wanted():
    seq, ml = bytes_("AAAA"), np.array([200, 200])
    assert marks.kept_marks("A+a,0;A+x,1;", ml, seq, False, 125, "pacbio-fiber").tolist() == [0, 1]
    assert marks.kept_marks("A+a,0;A+x,1;", ml, seq, False, 125, "pacbio-fiber", "a").tolist() == [0]


def test_q11_qualities_go_with_their_nucleosomes():
    made = call.tags(100, False, [(50, 10, (5, 1, 2)), (10, 20, (9, 3, 4))], [], [], scored=True, edged=True)
    assert made["ns"] == [10, 50] and made["nq"] == [9, 5] and made["ma_aq"] == [9, 3, 4, 5, 1, 2]
    turned = call.tags(100, True, [(50, 10, (5, 1, 2)), (10, 20, (9, 3, 4))], [], [], scored=True, edged=True)
    assert turned["ns"] == [40, 70] and turned["nq"] == [5, 9] and turned["ma_aq"] == [5, 2, 1, 9, 4, 3]


def test_q12_call_bytes_round_half_to_even_and_scores_are_cut(spark):
    assert spans.llr_bytes(np.array([0.25, 0.35, 99.0, -1.0])).tolist() == [2, 4, 255, 0] and call.unit_bytes(np.array([0.999, 1.5, -1])).tolist() == [254, 255, 0]
    r = spark.createDataFrame([(0.25, 0.999)], "a double, b double").select(S.llr_byte(F.col("a")).alias("a"), S.unit_byte(F.col("b")).alias("b")).first()
    assert (r.a, r.b) == (2, 254)


def test_q13_signs_after_the_letter_mean_nothing():
    seq, ml = bytes_("AAAA"), np.array([200])
    for sign in ("", ".", "?"):
        assert [at.tolist() for _, _, at, _ in marks.parse(f"A+a{sign},2;", ml, seq, False)] == [[2]]


def test_q14_and_q16_no_feature_no_row_and_no_falling_back(spark):
    shape = "read_id string, chrom string, ref_start int, cigar array<struct<op:int,n:int>>, seq string, ns array<int>, nl array<int>, ma string"
    df = spark.createDataFrame([("r", "c", 0, [(0, 40)], "A" * 40, [1], [5], "40;msp.:1-9")], shape)
    assert [r.feature for r in extract.features(df, ("nucleosome", "msp", "tf")).collect()] == ["msp"]
    assert [r.feature for r in extract.features(df.withColumn("ma", F.lit("what")), ("nucleosome", "tf")).collect()] == ["nucleosome"]


def test_q15_one_row_a_piece_only_where_circles_are_asked_for(spark):
    shape = "read_id string, chrom string, ref_start int, cigar array<struct<op:int,n:int>>, seq string, ma string, mm string, ml array<int>"
    df = spark.createDataFrame([("r", "c", 0, [(0, 40)], "A" * 40, "40;nuc.:1-5,20-6", "A+a,0;", [255])], shape)
    assert extract.features(df, ("nucleosome",)).count() == 1 and extract.features(df, ("nucleosome",), circles=True).count() == 2
    assert [n for _, n, _ in extract.columns_of("m6a", circles=True)][-1] == "chromStarts"


def test_q17_hashes_don_t_decide_links(spark):
    from molspan.operators import duplicates

    sets = [(i, "x", list(range(i // 2 * 1000, i // 2 * 1000 + 30))) for i in range(20)]
    for bands in (24, 40):
        assert {(r.id, r.cluster) for r in duplicates.clusters(spark.createDataFrame(sets, "id long, g string, items array<long>"), group="g", bands=bands).collect()} == {(i, i // 2 * 2) for i in range(20)}


def test_counts_and_names(spark, tmp_path):
    a = spark.createDataFrame([("AAA", 1, 2)], "context string, hit long, nohit long")
    contexts.save_counts(a, f"{tmp_path}/a", k=1, centre="A")
    contexts.save_counts(a, f"{tmp_path}/b", k=1, centre="A")
    contexts.save_counts(a, f"{tmp_path}/c", k=1, centre="C")
    found, k, centre = contexts.load_counts(spark, [f"{tmp_path}/a", f"{tmp_path}/b"])
    assert [tuple(r) for r in found.collect()] == [("AAA", 2, 4)] and (k, centre) == (1, "A")
    with pytest.raises(ValueError):
        contexts.load_counts(spark, [f"{tmp_path}/a", f"{tmp_path}/c"])
    assert version_key("2.10.1rc") > version_key("v2.9") and version_key("x") == ()
    bed = spark.createDataFrame([("m|nuc|w|1/2", "c", 5), ("n", "c", 9)], "name string, chrom string, chromEnd int")
    reads = spark.createDataFrame([("m", 1, 7, 0), ("m", 2, 7, 256), ("n", None, None, 0)], "read_id string, hp int, ps int, flag int")
    assert sorted((r.name, r.hp, r.ps) for r in extract.with_haplotypes(bed, reads).collect()) == [("m|nuc|w|1/2", 1, 7), ("n", -1, -1)]
    with pytest.raises(ValueError):
        extract.with_haplotypes(bed, reads.withColumn("flag", F.lit(0)))
    contigs = spark.createDataFrame([(3, "c", 8)], "tid int, chrom string, length long")
    assert extract.on_contigs(bed.limit(1), contigs).first().tid == 3
    with pytest.raises(Exception, match="not on a contig"):
        extract.on_contigs(bed, contigs).collect()


def test_posterior_lines_become_tables(spark, tmp_path):
    shape = "read_id string, chrom string, start long, stop long, strand string, posterior array<float>, ref_positions array<int>, fp_starts array<int>, fp_sizes array<int>"
    row = ("r", "c", 3, 6, "+", [0.0, 1.0, 0.5], [3, 4, 5], [3], [2])
    posteriors.write(spark.createDataFrame([row], shape), f"{tmp_path}/a.tsv")
    posteriors.lines_to_tables(spark, [f"{tmp_path}/a.tsv", f"{tmp_path}/a.tsv"], f"{tmp_path}/t")
    got = posteriors.load(spark, f"{tmp_path}/t").collect()
    assert [(r.read_id, r.fp_starts, r.fp_sizes) for r in got] == [("r", [3], [2])]
