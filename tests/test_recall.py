"""The second pass, circles and alignments against plain loops."""

import numpy as np
from pyspark.sql import functions as F

from molspan.functions import alignment
from molspan.operators import circular, recall


def best_runs(steps, opps, lo, hi, min_llr, min_opps):
    """(start, stop, sum) of maximal runs in [lo, hi), by a loop."""
    out, total, begin, n, peak = [], 0.0, None, 0, None
    for p in [*range(lo, hi), None]:
        if p is not None and begin is None and steps[p] > 0:
            begin, total, n, peak = p, 0.0, 0, (0.0, p, 0)
        if p is not None and begin is not None:
            total, n = total + steps[p], n + opps[p]
            if total > peak[0]:
                peak = (total, p + 1, n)
        if begin is not None and (p is None or total <= 0):
            if peak[0] >= min_llr and peak[2] >= min_opps:
                out.append((begin, peak[1], peak[0]))
            begin = None
    return out


def molecule(seed, n=400):
    rng = np.random.default_rng(seed)
    open_ = (np.arange(n) // 60) % 3 == 2
    hit = (rng.random(n) < np.where(open_, 0.8, 0.05)).astype(int)
    opp = (rng.random(n) < 0.7).astype(int)
    hit = hit * opp
    return hit, opp, np.where(hit == 1, -2.0, np.where(opp == 1, 0.5, 0.0))


def expected(steps, opps, a, b, least):
    """Nucleosomes and accessible rest of one footprint, without phase."""
    cuts = best_runs(-steps, opps, a, b, 4.0, 3)
    edges = [a, *[x for c in cuts for x in c[:2]], b]
    nucs, free = [], [c[:2] for c in cuts]
    for s, e in zip(edges[::2], edges[1::2]):
        if e <= s:
            continue
        calls = best_runs(steps, opps, s, e, 2.0, 2) if e - s >= least else []
        core = (calls[0][0], calls[-1][1]) if calls else (s, e)
        if core[1] - core[0] < least:
            free.append((s, e))
            continue
        nucs.append((*core, int(np.clip(np.round(10 * sum(c[2] for c in calls)), 0, 255))))
        free += [x for x in ((s, core[0]), (core[1], e)) if x[1] > x[0]]
    return sorted(nucs), sorted(free)


def test_recall_splits_and_refines(spark):
    rows, prints, nucs, free = [], [], [], []
    for m in range(4):
        hit, opp, step = molecule(m)
        rows += [(m, p, float(step[p]), int(hit[p]), int(opp[p])) for p in range(len(hit))]
        for a, b in ((0, 180), (200, 400), (185, 190)):
            prints.append((m, a, b))
            n, f = expected(step, opp, a, b, 30)
            nucs += [(m, *x) for x in n]
            free += [(m, *x) for x in f]
    obs = spark.createDataFrame(rows, "read_id long, pos long, step double, hit int, opp int")
    got, rest = recall.recall(spark.createDataFrame(prints, "read_id long, start long, stop long"), obs, ["read_id"], least=30)
    assert sorted((r.read_id, r.start, r.stop, r.nq) for r in got.collect()) == sorted(nucs)
    assert sorted(map(tuple, rest.collect())) == sorted(free)
    phased, more = recall.recall(spark.createDataFrame(prints, "read_id long, start long, stop long"), obs, ["read_id"], least=30, repeat=60.0)
    assert phased.count() >= 1 and more.count() >= len(free) - len(nucs)  # a phase cut only ever adds


def test_recall_of_nothing(spark):
    obs = spark.createDataFrame([], "read_id long, pos long, step double, hit int, opp int")
    none = spark.createDataFrame([], "read_id long, start long, stop long")
    nucs, free = recall.recall(none, obs, ["read_id"], repeat=185.0)
    assert nucs.count() == 0 and free.count() == 0


def test_promotion(spark):
    hit, opp, step = molecule(1)
    obs = spark.createDataFrame([(1, p, float(step[p]), int(hit[p]), int(opp[p])) for p in range(len(hit))], "read_id long, pos long, step double, hit int, opp int")
    bound = spark.createDataFrame([(1, 0, 110), (1, 130, 150)], "read_id long, start long, stop long")
    stay, nucs = recall.promote(bound, obs, ["read_id"], size=90, least=60)
    calls = best_runs(step, opp, 0, 110, 2.0, 2)
    assert [tuple(r) for r in stay.collect()] == [(1, 130, 150)]
    assert [(r.start, r.stop) for r in nucs.collect()] == [(calls[0][0], calls[-1][1])]


PROFILE = recall.Profile(tuple(0.02 + 0.4 * (d / 90) ** 2 for d in range(90)), 0.5)


def test_matched_filter_is_the_sum_over_the_window():
    hit, opp, _ = molecule(5, 300)
    marked, bare = PROFILE.weights()
    plain = [sum((marked if hit[c + d] else bare)[d + 73] for d in range(-73, 74) if 0 <= c + d < 300 and opp[c + d]) for c in range(300)]
    assert np.allclose(recall.matched_filter(hit.astype(float), opp.astype(float), PROFILE), plain)


def test_peaks_and_edges():
    odds = np.array([1.0, 3.0, 2.0, -1.0, 3.0, 0.0, 2.5])
    assert recall.spaced_peaks(odds, 2) == [1, 4, 6]
    assert recall.spaced_peaks(odds, 4) == [0, 4]
    rate = np.array([0.5, 0.5, 0.2, 0.0, 0.0, 0.0, 0.2, 0.5, 0.5])
    assert recall.density_edge(rate, 4, 0, -1, PROFILE) == (1, 2)
    assert recall.density_edge(rate, 4, 8, 1, PROFILE) == (7, 2)


def test_radial_recall_finds_the_planted_centre(spark):
    rng = np.random.default_rng(2)
    away = np.abs(np.arange(600) - 300)
    hit = (rng.random(600) < np.where(away < 73, 0.02, 0.55)).astype(int)
    rows = [(1, hit.tolist(), [1] * 600, [(200, 400)]), (2, [], [], []), (3, None, None, None)]
    reads = spark.createDataFrame(rows, "read_id long, hit array<int>, opp array<int>, footprints array<struct<start:bigint,stop:bigint>>")
    got = recall.radial_recall(reads, PROFILE).collect()
    assert [r.read_id for r in got] == [1]
    assert abs((got[0].start + got[0].stop) / 2 - 300) < 15 and 120 < got[0].stop - got[0].start < 190


def test_circular_tiling_covers_each_base_once(spark):
    rng = np.random.default_rng(3)
    rows = [(m, int(rng.integers(0, 400)), int(rng.integers(1, 120))) for m in range(6) for _ in range(m)] + [(7, 5, 400), (8, 0, 250), (8, 200, 250)]
    molecules = spark.createDataFrame([(m, 300) for m in range(9)], "read_id long, length long")
    got = circular.tile_circle(spark.createDataFrame(rows, "read_id long, start long, n long"), molecules, ["read_id"], least=20).collect()
    for m in range(9):
        seen = np.zeros(300, int)
        for r in got:
            if r.read_id == m:
                seen[(r.start + np.arange(r.n)) % 300] += 1
        assert (seen == 1).all(), m
    assert [(r.kind, r.start, r.n) for r in got if r.read_id == 7] == [("nuc", 0, 300)]
    assert [(r.kind, r.start, r.n) for r in got if r.read_id == 0] == [("msp", 0, 300)]


def test_deaminations_and_stamps(spark):
    #  read: 2 inserted, 4 matched, 2 deleted, 4 matched; reference ACGT CC CGTA
    row = [("2A1T^CC0C3", [(1, 2), (0, 4), (2, 2), (0, 4)], "GGACTTTGTA")]
    df = spark.createDataFrame(row, "md string, ops array<struct<op:int,n:int>>, seq string")
    subs = df.select(F.inline(alignment.substitutions(F.col("md")))).collect()
    assert [tuple(r) for r in subs] == [(2, "A"), (4, "T"), (7, "C")]
    one = df.select(alignment.deaminations(F.lit("2G1^CC0C3"), F.col("ops"), F.lit("GGACATTGTA")).alias("d"), alignment.stamp(F.lit("ACGT"), F.array(F.lit(1).cast("bigint")), "Y").alias("s")).first()
    assert one.d.ct == [6] and one.d.ga == [4] and one.s == "AYGT"


def test_training_from_several_starts(spark):
    from molspan.functions import chain

    rng = np.random.default_rng(4)
    emission = ((0.05, 1e-30, 0.95), (0.9, 1e-30, 0.1))
    rows = []
    for m in range(20):
        state, codes = m % 2, []
        for _ in range(60):
            state = state if rng.random() < 0.9 else 1 - state
            codes.append(0 if rng.random() < emission[state][0] else 2)
        rows.append((m, codes))
    reads = spark.createDataFrame(rows, "read_id long, codes array<int>").coalesce(1)
    first = chain.Model((0.5, 0.5), (0.5, 0.5), emission)
    model, score = chain.train_best(reads, first, restarts=2, rounds=12)
    scores = [chain.fitted(reads, chain.Model((0.5, 0.5), (s, s), emission), rounds=12)[1] for s in (0.6, 0.8)]
    assert abs(model.stay[0] - 0.9) < 0.08 and abs(model.stay[1] - 0.9) < 0.08
    assert score >= max(scores) - 1.0
