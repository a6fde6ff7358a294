import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from molspan.functions import chain
from molspan.functions import sequences as S
from molspan.operators import duplicates, intervals, segments
from molspan.operators.graph import components


def observed(spark, text):
    step = {"h": -2.0, "m": 0.5, ".": 0.0}
    return spark.createDataFrame([(1, i, step[c], int(c == "h"), int(c != ".")) for i, c in enumerate(text)], "read_id int, pos long, step double, hit int, opp int")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("hh" + "m" * 10 + "hh", [(2, 12, 5.0, 10, 0, 0)]),
        ("h" * 5 + "m" * 10 + "h" + "m" * 10 + "h" * 5, [(5, 26, 8.0, 21, 0, 0)]),
        ("hhmmmmhh", []),
        ("h" + "." * 5 + "m" * 10 + "." * 5 + "h", [(6, 16, 5.0, 10, 5, 5)]),
    ],
)
def test_segment_scan(spark, text, expected):
    found = segments.segment_scan(observed(spark, text), ["read_id"]).drop("read_id").collect()
    assert sorted(map(tuple, found)) == expected


def test_segment_scan_against_loop(spark):
    rng = random.Random(4)
    rows, expected = [], set()
    for read in range(60):
        text = rng.choices("hm.", [1, 5, 1], k=rng.randint(1, 80))
        run, start, best, end, opps, at = 0.0, None, 0.0, 0, 0, 0
        for i, c in enumerate([*text, None]):
            s = {"h": -2.0, "m": 0.5, ".": 0.0}.get(c, -1e9)
            if c is not None:
                rows.append((read, i, s, int(c == "h"), int(c != ".")))
            if start is None and s > 0:
                start, run, best, opps = i, 0.0, 0.0, 0
            if start is not None:
                run += s
                opps += c != "."
                if run > best + 1e-9:
                    best, end, at = run, i + 1, opps
                if run <= 1e-12:
                    if best >= 3 and at >= 3:
                        expected.add((read, start, end, best, at))
                    start = None
    obs = spark.createDataFrame(rows, "read_id int, pos long, step double, hit int, opp int")
    found = segments.segment_scan(obs, ["read_id"]).select("read_id", "start", "stop", "llr", "opps").collect()
    assert set(map(tuple, found)) == expected


def test_merge_and_complement(spark):
    rows = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (2, 0, 10), (2, 20, 30)], "read_id int, start long, stop long")
    merged = intervals.merge(rows, ["read_id"])
    assert {tuple(r)[:3] for r in merged.collect()} == {(1, 0, 20), (2, 0, 10), (2, 20, 30)}
    span = spark.createDataFrame([(1, 0, 25), (2, 0, 30), (3, 5, 9)], "read_id int, lo long, hi long")
    gaps = intervals.complement(merged.drop("n"), ["read_id"], span)
    assert {tuple(r) for r in gaps.collect()} == {(1, 20, 25), (2, 10, 20), (3, 5, 9)}


def test_tile(spark):
    rows = spark.createDataFrame([(1, 0, 30), (1, 0, 100), (2, 0, 200), (2, 150, 350)], "read_id int, start long, stop long")
    found = {tuple(r) for r in intervals.tile(rows, ["read_id"]).collect()}
    assert found == {(1, 0, 100, False), (2, 0, 200, False), (2, 200, 350, True)}


def test_circular(spark):
    rows = spark.createDataFrame([(1, 20, 10), (2, 90, 20), (3, 90, 100), (4, 0, 0)], "k int, start long, n long")
    found = {tuple(r) for r in intervals.split_circular(rows, F.lit(100).cast("long")).select("k", "start", "n").collect()}
    assert found == {(1, 20, 10), (2, 90, 10), (2, 0, 10), (3, 90, 10), (3, 0, 90)}


def test_decode_against_brute_force():
    model = chain.Model((0.4, 0.6), (0.9, 0.8), ((0.1, 0.2, 0.7), (0.6, 0.3, 0.1)))
    rng = np.random.default_rng(1)
    for _ in range(20):
        codes = rng.integers(0, 3, 7)
        best, total, one = (-math.inf, None), 0.0, np.zeros(7)
        for path in range(1 << 7):
            s = [path >> k & 1 for k in range(7)]
            p = model.start[s[0]] * model.emission[s[0]][codes[0]]
            for t in range(1, 7):
                p *= (model.stay[s[t]] if s[t] == s[t - 1] else 1 - model.stay[s[t - 1]]) * model.emission[s[t]][codes[t]]
            total += p
            one += p * np.array(s)
            if p > best[0] * (1 + 1e-12):
                best = (p, s)
        grid, length = codes[:, None], np.array([7])
        assert chain.decode(grid[:, 0], length, model).tolist() == best[1]
        alpha, beta, score, _ = chain.forward_backward(grid, length, model)
        assert score[0] == pytest.approx(math.log(total))
        gamma = np.exp(alpha[:, 1, 0] + beta[:, 1, 0] - score[0])
        assert gamma == pytest.approx(one / total)


def test_bytes_and_tags(spark):
    row = spark.range(1).select(S.llr_byte(F.lit(5.0)), S.llr_byte(F.lit(100.0)), S.edge_byte(F.lit(0)), S.edge_byte(F.lit(35)), S.reverse_complement(F.lit("ACGTN")), S.md_length(F.lit("10A5^AC6")), S.flip(F.lit(100), F.lit(50), F.lit(1000))).first()
    assert tuple(row) == (50, 255, 255, 0, "NACGT", 24, 850)


def test_chimeras(spark):
    rows = [(1, p, 1) for p in range(10, 51, 10)] + [(1, p, 0) for p in range(200, 241, 10)] + [(2, p, p % 2) for p in range(20)] + [(3, p, int(p < 3)) for p in range(6)]
    found = duplicates.chimeras(spark.createDataFrame(rows, "r int, pos int, forward int"), ["r"])
    assert {(r.r, r.chimera) for r in found.collect()} == {(1, True), (2, False), (3, False)}


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (4, 4), (None, 5)] + [(k, k + 1) for k in range(20, 60)], "a long, b long")
    found = dict(map(tuple, components(links).collect()))
    assert found == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {k: 20 for k in range(20, 61)}
