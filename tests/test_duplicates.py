import itertools
import random

import pytest

from molspan.operators import duplicates


def stars(groups, n, size=198, changed=18):
    """Rows (id, lang, items): of each group a base with a middle id, and n variants near the base but not near each other."""
    rng, rows = random.Random(1), []
    for g in range(groups):
        base = [g * 10**9 + k for k in range(size)]
        rows.append((g * 10**6 + n // 2, "x", base))
        for v in range(n):
            out = set(rng.sample(range(size), changed))
            rows.append((g * 10**6 + v + (v >= n // 2), "x", [x for k, x in enumerate(base) if k not in out] + [g * 10**9 + 10**6 + v * 100 + k for k in range(changed)]))
    return rows


@pytest.mark.parametrize("n", [30, 1000])
def test_every_variant_of_a_star_is_in_its_cluster(spark, n):
    found = duplicates.clusters(spark.createDataFrame(stars(1, n), "id long, lang string, items array<long>"), group="lang").collect()
    assert {(r.cluster, r.size) for r in found} == {(0, n + 1)} and len(found) == n + 1


def test_clusters_of_chains_against_all_pairs(spark):
    rng, rows = random.Random(2), stars(3, 20)
    for c in range(6):  # each link of a chain is near the one before, ends of it aren't
        now = [10**12 + c * 10**9 + k for k in range(120)]
        for k in range(15):
            rows.append((10**9 + c * 1000 + rng.randrange(10) + 10 * k, "y", list(now)))
            for m in rng.sample(range(120), 11):
                now[m] = 10**13 + c * 10**9 + k * 1000 + m
    sets = {i: (g, set(x)) for i, g, x in rows}
    label = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a][0] == sets[b][0] and 5 * len(sets[a][1] & sets[b][1]) >= 4 * len(sets[a][1] | sets[b][1])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    found = duplicates.clusters(spark.createDataFrame(rows, "id long, lang string, items array<long>"), group="lang")
    assert {r.id: r.cluster for r in found.collect()} == label


def test_sets_of_one_hash_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(3)) if c == ("scope", "items") else real(*c))
    rows = [(i, "x", list(range(i // 3 * 100, i // 3 * 100 + 20))) for i in range(30)] + [(99, "x", list(range(5000, 5020)))]
    found = duplicates.clusters(spark.createDataFrame(rows, "id long, lang string, items array<long>"), group="lang")
    assert {r.id: (r.cluster, r.size) for r in found.collect()} == {i: (i // 3 * 3, 3) for i in range(30)} | {99: (99, 1)}
