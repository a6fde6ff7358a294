import random

import numpy as np
import pyarrow as pa

from molspan.functions import marks as M
from molspan.plans import molecules


def one_by_one(*columns):
    out = []
    for r, read in enumerate(M.each_read(*columns)):
        for base, code, at, quality in M.parse(*read):
            out += [(r, ord(base), ord(code or "\0"), p, q) for p, q in zip(at.tolist(), quality.tolist())]
    return out


def test_batches_give_what_reads_give_one_by_one():
    rng = random.Random(5)
    texts = ["", None, "A+a;", "A+a,0;T+a;", ";C+m,1,2", "A+a,2,x;T+a,0", "a-a?,0,0;A+,1", "A", "A+a,,1;C+m,0;", "N+b.,0;A+17596,0,0", ",1;A+a,0", "A+a, 1,0;", "A+é,0;T+a,1", "A+a,99"]
    rows = []
    for k in range(600):
        n = rng.randrange(0, 40)
        seq = rng.choice([None, "", "".join(rng.choice("ACGTacgtNY") for _ in range(n))])
        made = "".join(f"{rng.choice('ATCGN')}+{rng.choice(['a', 'm', ''])}" + "".join(f",{rng.randrange(0, 3)}" for _ in range(rng.randrange(0, 5))) + ";" for _ in range(rng.randrange(0, 4)))
        ml = rng.choice([None, [rng.randrange(256) for _ in range(rng.randrange(0, 16))]])
        rows.append((rng.choice([made, made, made, rng.choice(texts)]), ml, seq, rng.choice([True, False, None])))
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.list_(pa.int32()), pa.string(), pa.bool_()))]
    for cut in (columns, [c.slice(7, 300) for c in columns], [c.slice(0, 0) for c in columns]):
        assert list(zip(*[x.tolist() for x in M.parse_batch(*cut)])) == one_by_one(*cut)
    longest = max(len(r[2] or "") for r in rows)
    for mode, codes in (("pacbio-fiber", None), ("daf", "m"), ("nanopore", "a")):
        lists = M.kept_lists(M.parse_batch(*columns), len(rows), longest, 100, mode, codes)
        assert lists.to_pylist() == [M.kept_marks(*r, 100, mode, codes).tolist() for r in M.each_read(*columns)]


def test_marks_are_read_by_batch(monkeypatch):
    ops = pa.array([[{"op": 0, "n": 30}, {"op": 2, "n": 9}, {"op": 1, "n": 8}], [{"op": 4, "n": 50}], [{"op": 2, "n": 3}]], pa.list_(pa.struct([("op", pa.int32()), ("n", pa.int32())])))
    reverse = pa.array([False, True, None])
    seq, mm, ml = molecules.written(pa.array([3, 104, 7]), reverse, ops)
    assert [len(s) for s in seq.to_pylist()] == [38, 50, 0] and mm[2].as_py() == "A+a;T+a;C+m;"
    slow = one_by_one(mm, ml, seq, reverse)
    monkeypatch.setattr(M, "parse", None)  # plain texts are not read one by one
    assert list(zip(*[x.tolist() for x in M.parse_batch(mm, ml, seq, reverse)])) == slow and len(slow) == len(ml.flatten())
    base = [chr(c) for s in seq.to_pylist() for c in s.encode()]
    assert base == ["ACGTGCATTA"[(i * 7 + r + i // 9) % 10] for r, n in ((3, 38), (104, 50)) for i in range(n)]
    assert np.asarray(ml.flatten()).max() < 256
