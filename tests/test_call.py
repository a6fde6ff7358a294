"""The fused plan against slow twins, and its parts against the window forms."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from molspan.functions import encoding, marks, spans
from molspan.functions.chain import Model
from molspan.operators import call, circular, intervals, recall, segments

COMP = {"A": "T", "C": "G", "G": "C", "T": "A"}


def reads_of(seed, n=40, longest=900):
    """Random reads with marks: (seq, reverse, mm, ml)."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        length = int(rng.integers(0, longest))
        seq = "".join(rng.choice(list("ACGTN"), length, p=[0.3, 0.2, 0.2, 0.29, 0.01]))
        reverse = bool(rng.integers(2))
        data = np.frombuffer(seq.encode(), np.uint8)
        mm, ml = "", []
        for base in "AT":
            wanted = ord(COMP[base]) if reverse else ord(base)
            at = np.flatnonzero(data == wanted)
            dense = np.repeat(rng.random(length // 60 + 1) < 0.5, 60)[:length]
            at = at[rng.random(len(at)) < np.where(dense[at], 0.6, 0.05)]
            mm += marks.mm_text(data, reverse, base, "a", at)
            ml += rng.integers(60, 256, len(at)).tolist()
        out.append((seq, reverse, mm, ml))
    return out


# Marks


def slow_marks(mm, ml, seq, reverse):
    read = "".join(COMP.get(c, "N") for c in reversed(seq)) if reverse else seq
    out, taken = [], 0
    for spec in mm.split(";"):
        head, *skips = spec.split(",")
        if not skips:
            continue
        places = [i for i, c in enumerate(read) if c == head[0].upper()]
        at = -1
        for s in skips:
            at += int(s) + 1
            q = ml[taken] if taken < len(ml) else None
            taken += 1
            if q is not None and at < len(places):
                out.append((head[0].upper(), head[2], len(seq) - 1 - places[at] if reverse else places[at], q))
    return out


def test_marks_against_a_walk(spark):
    reads = reads_of(1) + [("ACGTA", False, "A+a,0,5;C+m.,0;", [200, 3]), ("ACGTA", True, "T+a?,1;N+x;;C+m,0", [9, 250, 7]), ("", False, "A+a,0;", [1]), ("AAA", False, "A+a", [1]), ("AAA", False, "A+a,0,0,0;", [130])]
    want = [sorted(slow_marks(mm, ml, s, r)) for s, r, mm, ml in reads]
    for (s, r, mm, ml), w in zip(reads, want):
        got = [(b, c, p, q) for b, c, at, qs in marks.parse(mm, np.array(ml, np.int64), np.frombuffer(s.encode(), np.uint8), r) for p, q in zip(at.tolist(), qs.tolist())]
        assert sorted(got) == w
    rows = [(i, s, r, mm, ml) for i, (s, r, mm, ml) in enumerate(reads)] + [(99, "ACA", False, None, None), (98, None, None, "A+a,0;", [1])]
    df = spark.createDataFrame(rows, "read_id int, seq string, is_reverse boolean, mm string, ml array<int>")
    found = df.select("read_id", marks.marks(F.col("mm"), F.col("ml"), F.col("seq"), F.col("is_reverse"), mode="nanopore", threshold=125).alias("m")).collect()
    assert {r.read_id: r.m for r in found} == {i: sorted({p for b, _, p, q in w if b == "A" and q >= 125}) for i, w in enumerate(want)} | {98: [], 99: []}
    flat = sorted((r.read_id, r.base, r.code, r.pos, r.quality) for r in marks.marks_by_kind(df).collect())
    assert flat == sorted((i, *x) for i, w in enumerate(want) for x in w)
    back = df.where("read_id < 40").select("mm", "seq", "is_reverse", marks.marks(F.col("mm"), F.col("ml"), F.col("seq"), F.col("is_reverse"), mode="daf", threshold=0).alias("m"))
    back = back.select(F.concat(*[marks.tagged(F.col("seq"), F.col("is_reverse"), F.col("m"), base=b, code="a") for b in "AT"]).alias("again"), "mm")
    assert all(r.again == r.mm for r in back.collect())


# Symbols


def slow_symbols(seq, at, mode, k, trim, reverse, strand):
    number, n = {"A": 0, "C": 1, "T": 2, "G": 3}, len(seq)
    top, m, out = 4 ** (2 * k), max(k, trim), []
    bases = list(seq)
    if mode == "daf":
        for i in at:
            if 0 <= i < n and bases[i] == ("T" if strand == "+" else "A"):
                bases[i] = "C" if strand == "+" else "G"
    for i, c in enumerate(seq):
        turned, hit, target = False, i in at, False
        if mode == "pacbio-fiber":
            target, turned = c in "AT", c == "T"
        elif mode == "nanopore-fiber":
            target, turned = c == ("T" if reverse else "A"), reverse
        else:
            before, after = ("C", "T") if strand == "+" else ("G", "A")
            target, turned = (c == after and hit) or (c == before and not hit), strand != "+"
        near = bases[i - k : i] + bases[i + 1 : i + k + 1]
        if not target or not m <= i < n - m or any(x not in number for x in near):
            out.append(2 * top + 1)
            continue
        left, right = bases[i - k : i], bases[i + 1 : i + k + 1]
        if turned:
            left, right = [COMP[x] for x in reversed(right)], [COMP[x] for x in reversed(left)]
        code = 0
        for x in left + right:
            code = 4 * code + number[x]
        out.append(code if hit else code + top + 1)
    return out


@pytest.mark.parametrize("mode", encoding.MODES)
@pytest.mark.parametrize("k, trim", [(1, 0), (3, 10), (4, 2)])
def test_symbols_against_a_loop(spark, mode, k, trim):
    rng = random.Random(k)
    rows = []
    for i in range(40):
        seq = "".join(rng.choices("ACGTN", [6, 5, 5, 6, 1], k=rng.randrange(60)))
        rows.append((i, seq, sorted(rng.sample(range(70), 25)), bool(rng.randrange(2)), rng.choice(["+", "-", ".", None])))
    df = spark.createDataFrame(rows, "read_id int, seq string, at array<int>, r boolean, s string")
    got = df.select("read_id", encoding.symbols(F.col("seq"), F.col("at"), mode=mode, k=k, trim=trim, reverse=F.col("r"), strand=F.col("s")).alias("c"))
    want = {i: slow_symbols(seq, set(at), mode, k, trim, r, s) for i, seq, at, r, s in rows}
    assert {x.read_id: x.c for x in got.collect()} == want


def test_ambiguity_signs():
    data = lambda t: np.frombuffer(t.encode(), np.uint8)
    assert encoding.ambiguous(data("AYYR"), None)[1] == "+" and encoding.ambiguous(data("AYYR"), "GA")[0].tolist() == [3]
    assert encoding.ambiguous(data("AYR"), "")[1] == "." and bytes(encoding.resolved(data("AYR"))) == b"ATA"


# Deaminations


def slow_md(md, ops, seq):
    import re

    ref = []  # reference bases of aligned and deleted positions
    for number, gap, base in re.findall(r"(\d+)|\^([A-Z]+)|([A-Z])", md):
        ref += ["="] * int(number) if number else list(gap) if gap else [base]
    q = r = 0
    ct, ga = [], []
    for op, n in ops:
        for _ in range(n):
            if op in (0, 7, 8) and ref[r] != "=":
                ct += [q] * (ref[r] == "C" and seq[q] == "T")
                ga += [q] * (ref[r] == "G" and seq[q] == "A")
            q += op in (0, 1, 4, 7, 8)
            r += op in (0, 2, 7, 8)
    return ct, ga


def test_changes_by_md_and_by_reference(spark):
    rng, rows, want = random.Random(2), [], []
    for i in range(60):
        ref = "".join(rng.choices("ACGT", k=80))
        ops, seq, md, run, at = [], "", "", 0, 0
        if rng.random() < 0.5:
            ops.append((4, 3))
            seq += "ACG"
        while at < 70:
            op, n = rng.choice([0, 0, 1, 2, 3, 7]), rng.randrange(1, 8)
            ops.append((op, n))
            if op in (0, 7):
                for c in ref[at : at + n]:
                    now = "T" if c == "C" and rng.random() < 0.5 else "A" if c == "G" and rng.random() < 0.3 else c
                    seq += now
                    md, run = (md, run + 1) if now == c else (f"{md}{run}{c}", 0)
                at += n
            elif op == 1:
                seq += "A" * n
            elif op == 2:
                md, run, at = f"{md}{run}^{ref[at : at + n]}", 0, at + n
            else:
                at += n
        md += str(run)
        data = np.frombuffer(seq.encode(), np.uint8)
        ct, ga = slow_md(md, ops, seq)
        for got in (marks.read_changes(data, ops, md), marks.read_changes(data, ops, None, ref)):
            assert (got[0].tolist(), got[1].tolist()) == (ct, ga)
        assert marks.md_fits(md, ops) and not marks.md_fits(md + "9", ops) and marks.read_changes(data, ops, md + "9") is None
        rows.append((i, seq, [{"op": a, "n": b} for a, b in ops], md))
        want.append((ct, ga))
    rows += [(60, None, None, None), (61, "ACGT", [{"op": 0, "n": 4}], None)]
    df = spark.createDataFrame(rows, "read_id int, seq string, cigar array<struct<op:int,n:int>>, md string")
    got = {r.read_id: r for r in marks.stamped(df).collect()}
    assert got[60].seq is None and got[61].st is None and got[61].seq == "ACGT"
    for i, (ct, ga) in enumerate(want):
        way = "CT" if len(ct) > len(ga) else "GA" if len(ga) > len(ct) else None
        new = list(rows[i][1])
        for k in ct if way == "CT" else ga if way else []:
            new[k] = "Y" if way == "CT" else "R"
        assert (got[i].st, got[i].seq, got[i].n_ct, got[i].n_ga) == (way, "".join(new), len(ct), len(ga))
    forced = {r.read_id: r.st for r in marks.stamped(df, forced="ga").collect()}
    assert forced[0] == "GA" and forced[60] is None


def test_chimera_points():
    at = np.arange
    assert marks.is_chimera(at(10), at(20, 30)) and marks.is_chimera(at(20, 30), at(10)) and not marks.is_chimera(at(0, 20, 2), at(1, 21, 2))
    assert not marks.is_chimera(at(4), at(20, 30)) and marks.is_chimera(at(5), at(5, 10))


# Lines of intervals


def test_line_algebra_against_sets():
    rng = random.Random(5)
    for _ in range(300):
        some = [(a, a + rng.randrange(0, 9)) for a in (rng.randrange(40) for _ in range(rng.randrange(6)))]
        arrays = spans.Spans(*(np.array(x, np.int64) for x in zip(*some))) if some else spans.Spans(spans.NONE, spans.NONE)
        union = {k for a, b in some for k in range(a, b)}
        whole = spans.merged(arrays.where(arrays.size() > 0), np.zeros((arrays.size() > 0).sum(), np.int64))
        assert {k for a, b in zip(*whole) for k in range(a, b)} == union and all(b < a for b, a in zip(whole.stop[:-1], whole.start[1:]))
        left = spans.gaps(spans.Spans(np.array([0]), np.array([60])), whole)
        assert {k for a, b in zip(*left) for k in range(a, b)} == set(range(60)) - union
        others = [(a, a + rng.randrange(1, 9)) for a in (rng.randrange(40) for _ in range(4))]
        hit = spans.overlaps(arrays, spans.Spans(*(np.array(x, np.int64) for x in zip(*others))))
        assert hit.tolist() == [any(a < d and c < b and b > a for c, d in others) for a, b in some]
        kept, begin, moved = spans.clipped(arrays, 3)
        last, want = -1, []
        for k in sorted(range(len(some)), key=lambda k: (some[k][0], -some[k][1])):
            a = max(some[k][0], last)
            if some[k][1] - a >= 3:
                want.append((k, a, a > some[k][0]))
                last = some[k][1]
        # of equal intervals either may stay
        assert [(some[k], int(a), bool(m)) for k, a, m in zip(kept, begin, moved)] == [(some[k], a, m) for k, a, m in want]


def observations(seed, n):
    """(rows for the window forms, evidence and bounds for the line) of random molecules; steps are exact in binary."""
    rng = random.Random(seed)
    text = ["".join(rng.choices("hm.", [1, 6, 2], k=rng.randrange(1, 400))) for _ in range(n)]
    for i in range(0, n, 2):  # stretches of hits
        text[i] = "".join(c if (k // 40) % 2 else rng.choice("hhm") for k, c in enumerate(text[i]))
    step = {"h": -2.0, "m": 0.5, ".": 0.0}
    rows = [(i, k, step[c], int(c == "h"), int(c != ".")) for i, t in enumerate(text) for k, c in enumerate(t)]
    flat = "".join(text)
    evidence = spans.Evidence(np.array([step[c] for c in flat]), np.array([c == "h" for c in flat]), np.array([c != "." for c in flat]))
    length = np.array([len(t) for t in text])
    return rows, evidence, length


OBS = "read_id int, pos long, step double, hit int, opp int"


def test_scan_and_recall_are_the_window_forms(spark):
    rows, evidence, length = observations(7, 30)
    first = np.cumsum(length) - length
    whole = spans.Spans(first, first + length)
    obs = spark.createDataFrame(rows, OBS).cache()
    calls = evidence.scan(whole, min_llr=3.0, min_opps=3)
    got = sorted(zip(calls.space.tolist(), (calls.start - first[calls.space]).tolist(), (calls.stop - first[calls.space]).tolist(), calls.llr.tolist(), calls.opps.tolist(), calls.left.tolist(), calls.right.tolist()))
    assert got == sorted(tuple(r) for r in segments.segment_scan(obs, ["read_id"]).collect()) and len(got) > 30
    prints = [(i, a, min(a + 150, n)) for i, n in enumerate(length.tolist()) for a in range(0, n, 170)]
    df = spark.createDataFrame(prints, "read_id int, start long, stop long")
    flat = spans.Spans(np.array([first[i] + a for i, a, _ in prints]), np.array([first[i] + b for i, _, b in prints]))
    for repeat in (None, 60):
        nucs, freed = recall.recall(df, obs, ["read_id"], repeat=repeat, least=20)
        mine, access = spans.recalled(flat, evidence, least=20, repeat=repeat or 0)
        own = np.searchsorted(first + length, mine.start, "right")
        assert sorted(zip(own.tolist(), (mine.start - first[own]).tolist(), (mine.stop - first[own]).tolist(), mine.nq.tolist(), mine.el.tolist(), mine.er.tolist())) == sorted(tuple(r) for r in nucs.collect())
        own = np.searchsorted(first + length, access.start, "right")
        there = sorted(zip(own.tolist(), (access.start - first[own]).tolist(), (access.stop - first[own]).tolist()))
        assert there == sorted((r.read_id, r.start, r.stop) for r in freed.collect())


# The fused plan


def toy_model(k, seed=0):
    rng = np.random.default_rng(seed)
    top = encoding.alphabet(k)
    acc, prot = rng.uniform(0.5, 0.8, top), rng.uniform(0.01, 0.06, top)
    return Model((0.5, 0.5), (0.98, 0.97), tuple(tuple(float(x) for x in np.concatenate((p, [1e-30], 1 - p, [1.0]))) for p in (prot, acc)))


def slow_call(seq, codes, model, o):
    """nucs, patches and binding calls of one read by the plan's steps, on lists."""
    _, _, e = model.logs()
    top = encoding.alphabet(o.k)
    step = [e[0, c] - e[1, c] if c < 2 * top + 1 and c != top else 0.0 for c in codes]
    hit, opp = [c < top for c in codes], [c < 2 * top + 1 and c != top for c in codes]

    def scan(lo, hi, sign, least, n_least):
        out, run, start, best = [], 0.0, None, None
        for i in range(lo, hi + 1):
            s = sign * step[i] if i < hi else None
            if start is None:
                if s is None or s <= 0:
                    continue
                start, run, best, opps = i, 0.0, (0.0, 0, 0), 0
            if s is not None:
                run += s
                opps += opp[i]
                if run > best[0]:
                    best = (run, i + 1, opps)
            if s is None or run <= 0:
                if best[0] >= least and best[2] >= n_least:
                    left = next((d for d in range(start - lo) if hit[start - 1 - d]), start - lo)
                    right = next((d for d in range(hi - best[1]) if hit[best[1] + d]), hi - best[1])
                    out.append((start, best[1], best[0], best[2], left, right))
                start = None
        return out

    from molspan.functions.chain import decode

    byte, edge = lambda x: int(np.clip(round(x * 10), 0, 255)), lambda d: 255 if d <= 0 else 0 if d >= 30 else round(255 * (1 - d / 30))
    states, n = decode(np.array(codes), np.array([len(codes)]), model).tolist() if codes else [], len(seq)
    prints, a = [], None
    for i, s in enumerate([*states, 1]):
        if s == 0 and a is None:
            a = i
        if s == 1 and a is not None:
            prints.append((a, i))
            a = None

    def rest(lo, hi, some):
        at, out = lo, []
        for x, y in sorted(some):
            out += [(at, x)] * (x > at)
            at = max(at, y)
        return out + [(at, hi)] * (hi > at)

    def union(some):
        out = []
        for x, y in sorted(some):
            if out and x <= out[-1][1]:
                out[-1] = (out[-1][0], max(y, out[-1][1]))
            else:
                out.append((x, y))
        return out

    def core(x, y):
        if y - x < o.nuc_min:
            return None
        c = scan(x, y, 1, 2.0, 2)
        if not c:
            return (x, y, (0, 0, 0))
        return (c[0][0], c[-1][1], (byte(sum(t[2] for t in c)), edge(c[0][4]), edge(c[-1][5]))) if c[-1][1] - c[0][0] >= o.nuc_min else None

    msps = [p for p in rest(0, n, [p for p in prints if p[1] - p[0] >= o.nuc_min]) if p[1] - p[0] >= o.msp_min]
    nucs, free = [(x, y, (0, 0, 0)) for x, y in prints], []
    if o.recall:
        nucs = []
        for x, y in prints:
            cuts = [c[:2] for c in scan(x, y, -1, o.split_llr, o.split_opps)]
            parts = rest(x, y, cuts)
            free += cuts
            if o.repeat:
                done = []
                for p, q in parts:
                    m, more = round((q - p) / o.repeat), []
                    if q - p >= int(1.5 * o.repeat) and m >= 2:
                        for i in range(1, m):
                            c = p + round(i * (q - p) / m)
                            found = scan(max(p, c - 35), min(q, c + 35), -1, 1.0, 1)
                            if found:
                                more.append(max(found, key=lambda t: (t[2], -t[0]))[:2])
                    free += more
                    done += rest(p, q, more)
                parts = done
            for p, q in parts:
                c = core(p, q)
                nucs += [c] if c else []
                free += rest(p, q, [c[:2]] if c else [])
        msps = [p for p in union(msps + free) if p[1] - p[0] >= max(1, o.msp_min)]
    bound = [c for x, y in union(msps + [t[:2] for t in nucs if t[1] - t[0] < o.unify]) for c in scan(x, y, 1, o.min_llr, o.min_opps)] if o.bind else []
    meets = lambda t, some: any(t[0] < u[1] and u[0] < t[1] for u in some)
    if o.recall:
        up = [(c, core(c[0], c[1])) for c in bound if c[1] - c[0] >= o.unify]
        up = [(c, k) for c, k in up if k]
        bound = [c for c in bound if c not in [x for x, _ in up]]
        nucs = [t for t in nucs if t[1] - t[0] >= o.unify or not meets(t, [k for _, k in up])] + [k for _, k in up]
    nucs = [t for t in nucs if t[1] - t[0] >= o.unify or not meets(t, bound)]
    if o.recall and n:
        every = prints + msps + [t[:2] for t in nucs]
        lo, hi = (min(t[0] for t in every), max(t[1] for t in every)) if every else (0, n)
        kept, last = [], lo
        for x, y, (q, el, er) in sorted(nucs, key=lambda t: (t[0], -t[1])):
            el = el if x >= last else 0
            x = max(x, last)
            if y - x >= max(1, o.nuc_min):
                kept.append((x, y, (q, el, er)))
                last = y
        nucs, msps = kept, [p for p in rest(lo, hi, [t[:2] for t in kept]) if p[1] - p[0] >= max(1, o.msp_min)]
    return nucs, msps, bound


@pytest.mark.parametrize("o", [call.Options(), call.Options(repeat=60, nuc_min=40, unify=50), call.Options(recall=False, unify=60, nuc_min=30), call.Options(recall=False, bind=False), call.Options(msp_min=20, nuc_min=30, unify=45, split_llr=2.0), call.Options(compat=True), call.Options(mode="nanopore-fiber", k=2, trim=4)], ids=str)
def test_fused_plan_against_lists(spark, o):
    o = call.replace(o, min_length=10)
    model, reads = toy_model(o.k), reads_of(11, 30)
    rows = [(i, s, m, q, r, 0 if i % 7 else 4, "kept", 5) for i, (s, r, m, q) in enumerate(reads)]
    df = spark.createDataFrame(rows, "read_id int, seq string, mm string, ml array<int>, is_reverse boolean, flag int, extra string, ns int")
    got = {r.read_id: r for r in call.call(df, model, o).collect()}
    assert len(got) == len(rows) and all(r.extra == "kept" for r in got.values())
    n_nucs = n_bound = 0
    for i, (seq, reverse, mm, ml) in enumerate(reads):
        r, n = got[i], len(seq)
        assert r.error is None
        if n < 10:
            assert r.skip_reason == ("too_short" if n else "no_sequence") and r.ns is None
            continue
        bases = marks.ADMITTED[o.mode]
        at = {p for b, _, p, q in slow_marks(mm, ml, seq, reverse) if b in bases and q >= 128}
        nucs, msps, bound = slow_call(seq, slow_symbols(seq, at, o.mode, o.k, o.trim, reverse, None), model, o)
        n_nucs, n_bound = n_nucs + len(nucs), n_bound + len(bound)
        turn = lambda a, b: (n - b, b - a) if reverse else (a, b - a)
        assert [(c.start, c.n, round(c.llr, 9), c.opps) for c in r.tf] == [(a, b - a, round(x, 9), k) for a, b, x, k, _, _ in bound]
        want = sorted([turn(a, b) for a, b, _ in nucs] + ([turn(a, b) for a, b, *_ in bound] if o.compat else []))
        assert list(zip(r.ns, r.nl)) == want and list(zip(r["as"], r.al)) == sorted(turn(a, b) for a, b in msps)
        assert (r.ma is None) == (o.compat or not (nucs or msps or bound))
        if r.ma and o.recall:
            from molspan.functions import sequences

            byte = lambda q: (q[0], q[2], q[1]) if reverse else q
            quality = [x for _, q in sorted((turn(a, b), byte(q)) for a, b, q in nucs) for x in q]
            assert (r.ma_aq or [])[: len(quality)] == quality and len(r.ma_aq or []) == len(quality) + 3 * len(bound) and r.an is None
            parsed = spark.createDataFrame([(r.ma,)], "ma string").select(F.explode(sequences.parse_annotations(F.col("ma"))).alias("a")).select("a.*").collect()
            assert [(p.start, p.n) for p in parsed if p.kind == "nuc"] == want
    assert n_nucs > 20 and (n_bound > 5 or not o.bind)


def test_scores_and_failures(spark):
    o = call.Options(recall=False, scores=True, min_length=1)
    model, reads = toy_model(3), reads_of(4, 6)
    rows = [(i, s, m, q, r) for i, (s, r, m, q) in enumerate(reads)] + [(50, "ACGT" * 30, "A+a,x;", [1], False), (51, "é" * 40, "A+a,0;", [200], False)]
    got = {r.read_id: r for r in call.call(spark.createDataFrame(rows, "read_id int, seq string, mm string, ml array<int>, is_reverse boolean"), model, o).collect()}
    assert all(r.error is None and len(r.nq or []) == len(r.ns) and len(r.aq) == len(r["as"]) for i, r in got.items() if i != 51 and r.skip_reason is None)
    calls = call.call(spark.createDataFrame([(1, "ACGT" * 40, None), (2, "ACGT" * 40, "CT")], "read_id int, seq string, st string"), model, call.replace(o, mode="daf"))
    assert {r.read_id: r.error for r in calls.collect()} == {1: None, 2: None}
    with pytest.raises(ValueError):
        call.call(spark.createDataFrame([], "seq string"), model, call.Options(k=2))
    assert call.call(spark.createDataFrame([], "seq string"), model, o).count() == 0


def test_one_bad_read_holds_up_no_other(spark, monkeypatch):
    real = call.kept_places

    def sometimes(mm, *rest):
        if mm == "bad":
            raise ValueError("no such mark")
        return real(mm, *rest)

    monkeypatch.setattr(call, "kept_places", sometimes)
    columns = {c: [None] * 3 for c in call.READ} | {"seq": ["ACGT" * 40] * 3, "mm": [None, "bad", None], "is_reverse": [False] * 3}
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), *[pa.array(columns[c], f.type) for c, f in zip(call.READ, call.schema_fields(", ".join(f"{c} {t}" for c, t in call.READ.items())))], pa.nulls(3, pa.string())], names=["id", *call.READ, "why"])
    o, model = call.Options(min_length=1), toy_model(3)

    work = call.safe_worker(model, model, o)
    out = pa.Table.from_batches(list(call.in_parts(iter([batch]), 1, work, call.schema_fields(call.OUTPUT)))).to_pylist()
    assert [r["error"] for r in out] == [None, "ValueError: no such mark", None] and out[0]["ns"] is not None and out[1]["ns"] is None


def test_circles(spark):
    o = call.Options(circular=True, min_length=100, nuc_min=30, unify=45)
    model, reads = toy_model(3), [r for r in reads_of(21, 25, 1500) if len(r[0]) >= 100]
    rows = [(i, s, m, q, r) for i, (s, r, m, q) in enumerate(reads)]
    got = {r.read_id: r for r in call.call(spark.createDataFrame(rows, "read_id int, seq string, mm string, ml array<int>, is_reverse boolean"), model, o).collect()}
    wrapped = 0
    for i, (seq, reverse, mm, ml) in enumerate(reads):
        r, n = got[i], len(seq)
        covered = np.zeros(n, int)
        for a, m in [*zip(r.ns, r.nl), *zip(r["as"], r.al)]:
            assert 0 <= a and a + m <= n
            covered[a : a + m] += 1
        assert (covered == 1).all(), "nucleosomes and patches tile the circle"
        wrapped += r.an is not None
        if r.an:
            assert len(r.an.split(",")) == sum(len(p.split(",")) for p in r.ma.split(";")[1:]) and "fhw_" in r.an
        # a circle opened elsewhere gives the same calls, turned
        shift = n // 3
        data = np.frombuffer(seq.encode(), np.uint8)
        at = marks.kept_marks(mm, np.array(ml), data, reverse, 128, "pacbio-fiber")
        codes = lambda s, p: encoding.observe(encoding.NUMBER[np.tile(s, 3)], np.array([3 * n]), encoding.mark_mask(np.array([3 * n]), [np.concatenate((p, p + n, p + 2 * n))]), mode="pacbio-fiber")  # noqa: E731, B023
        assert (np.roll(codes(data, at)[n : 2 * n], -shift) == codes(np.roll(data, -shift), (at - shift) % n)[n : 2 * n]).all()
    assert wrapped > 3


def test_circle_tiling_is_the_column_form(spark):
    rng = random.Random(9)
    o = call.Options(nuc_min=10, msp_min=5)
    rows, want = [], []
    for i in range(40):
        some = [(rng.randrange(200), rng.randrange(1, 90), (i, 7, 9)) for _ in range(rng.randrange(5))]
        rows += [(i, s, n) for s, n, _ in some]
        nucs, msps = call.tiled_circle(some, 200, o)
        want += [(i, "nuc", s, n) for s, n, _ in nucs] + [(i, "msp", s, n) for s, n, _ in msps]
    df = spark.createDataFrame(rows, "read_id int, start long, n long")
    found = circular.tile_circle(df, spark.range(40).select(F.col("id").cast("int").alias("read_id"), F.lit(200).cast("long").alias("length")), ["read_id"], least=10, gap=5)
    assert sorted(tuple(r) for r in found.select("read_id", "kind", "start", "n").collect()) == sorted(want)
    assert intervals is not None
