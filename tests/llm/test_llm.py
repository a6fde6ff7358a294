import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from molspan.llm import exact_dedup, html_text, language, line_dedup, minhash, mixing, packing, repetition, resharding, token_counts

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, copies, near copies, repeated rows, columns with clashing names."""
    base = [f"w{k * 7919 % 1000}" for k in range(200)]
    near = base[:]
    near[100] = "changed"
    long = " ".join(f"x{k}" for k in range(30000))
    lines = "\n".join(f"line number {k} of the passage that repeats" for k in range(30))
    texts = [None, "", " \n ", "one", " ".join(base), " ".join(near), " ".join(base), "\t".join(base), long, lines, "first line\n" + lines + "\nlast line", "a b\na b\n# $ ok", "é ü 漢字 😀"]
    rows = [(k, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", 0, "x", "y") for k, t in enumerate(texts)]
    rows += [rows[4], (None, "one", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n#é", max_size=80)), min_size=1, max_size=5))
def test_repetition_brute_force(texts):
    made = np.stack([np.asarray(x).astype(np.int64) for x in repetition.measure(pa.array(texts, pa.string()))])
    for i, t in enumerate(texts):
        w = words(t)
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = [False] * len(w)
        for k in range(len(w) - 4):
            if seen[tuple(w[k : k + 5])] > 1:
                cover[k : k + 5] = [True] * 5
        longest = 0
        for a in range(len(w)):
            for b in range(a + 1, len(w)):
                n = 0
                while b + n < len(w) and w[a + n] == w[b + n]:
                    n += 1
                longest = max(longest, n)
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        expected = [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), sum(cover)]
        assert made[:5, i].tolist() == expected
        assert made[5, i] == (len(w) < 10 or 100 * sum(cover) > 20 * len(w))
        assert made[8, i] == (longest if longest >= 5 else 0)


def test_repetition_rows(docs, nothing):
    with pytest.raises(ValueError):
        repetition.repetition(docs)
    assert repetition.repetition(docs, prefix="q_").count() == docs.count()
    kept = repetition.repetition(docs, filtered=True)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {4, 5, 8}
    assert repetition.repetition(nothing, prefix="q_").count() == 0


def test_exact_dedup(docs, nothing):
    found = [r for r in exact_dedup.exact_dedup(docs).collect()]
    by = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in found if r.doc_id is not None}
    assert len(found) == docs.count()
    assert by[4] == (4, 4, True) and by[6] == (4, 4, False) and by[7] == (4, 4, False) and by[5] == (5, 1, True)
    assert by[0] == (0, 3, True) and by[1] == (0, 3, False) and by[2] == (2, 1, True) and by[3] == (3, 2, True)
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_packing(docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = packing.tokenize_and_pack(docs.select("doc_id", "text"), limit=512).collect()
    by, bins = defaultdict(list), defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for r in docs.where("doc_id is not null and doc_id <> 4").collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        parts = sorted(by[r.doc_id], key=lambda x: x.piece)
        assert [(p.start, p.length) for p in parts] == [(a, min(512, len(ids) - a)) for a in range(0, len(ids), 512)]
        assert [p.ids_crc32 for p in parts] == [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in parts]
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 512
    rooms = []  # first fit, longest first
    for n in sorted((r.length for r in found), reverse=True):
        k = next((k for k, room in enumerate(rooms) if room >= n), None)
        if k is None:
            rooms.append(512 - n)
        else:
            rooms[k] -= n
    assert len(bins) <= len(rooms)
    assert packing.tokenize_and_pack(nothing.select("doc_id", "text")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=6), st.integers(1, 60))
def test_fullest_is_fullest(counts, room):
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * c for s in sums for c in range(n + 1)}
    chosen = packing.fullest(sorted(counts), counts, room)
    assert all(n <= counts[k] for k, n in chosen.items())
    assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)


def test_resharding(docs, nothing):
    placed = resharding.reshard(resharding.sizes(docs, F.col("doc_id") % 3), shards=4).collect()
    assert len(placed) == docs.count()
    slots = defaultdict(list)
    for r in placed:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert resharding.reshard(resharding.sizes(nothing, F.lit(0)), shards=4).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=5), st.integers(1, 5))
def test_fewest_bytes_move(sizes, shards):
    old = dict(enumerate(sizes))
    capacity = resharding.even_capacity(sum(sizes), shards)
    plan = resharding.transfers(old, capacity)
    assert sum(n for a, b, n in plan if a != b) == sum(sizes) - sum(min(old.get(j, 0), c) for j, c in enumerate(capacity))
    for a in old:
        assert sum(n for x, _, n in plan if x == a) == old[a]


def test_line_dedup(docs, nothing):
    found = {r.doc_id: r for r in line_dedup.line_dedup(docs.select("doc_id", "text", "source"), counts=True).collect()}
    assert found[9].n_removed_lines == 0
    assert found[10].n_removed_lines >= 20 and found[10].text.startswith("first line") and found[10].text.endswith("last line")
    assert found[0].text is None and found[1].text == "" and found[11].text == "a b\na b\n# $ ok"
    # against a count of all chunks
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    seen, lost = set(), Counter()
    for k, t in sorted(rows):
        for _, n, content in line_dedup.chunks(t):
            if content in seen:
                lost[k] += n
            seen.add(content)
    assert {k: found[k].n_removed_lines for k, _ in rows} == {k: lost[k] for k, _ in rows}
    assert line_dedup.line_dedup(nothing, counts=True).count() == 0


def test_mixing(spark, docs, nothing):
    found = mixing.mix(docs)
    assert found.count() == docs.count()
    assert all(r.taken <= 3 * r.size for r in found.collect())
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs).collect()}
    assert again == {(r.doc_id, r.taken) for r in found.collect()}
    repeated = mixing.repeat_rows(docs)
    assert repeated.columns == docs.columns and repeated.count() == found.agg(F.sum("repeats")).first()[0]
    assert mixing.mix(nothing).count() == 0
    # water-filling by redistributing again and again
    table = spark.createDataFrame([("a", 1, 100), ("b", 2, 10), ("c", 3, 5), ("d", 1, 0)], "skey string, weight long, source_size long")
    got = {r.skey: r.target for r in mixing.water_fill(table, 115).collect()}
    assert got == pytest.approx({"a": 70.0, "b": 30.0, "c": 15.0, "d": 0.0})


def test_ppm_and_language(spark, docs, nothing):
    en = ["the cat sat on the mat with that other hat and then it went away"] * 3
    de = ["der hund und die katze sind nicht immer gute freunde gewesen"] * 3
    rows = [(k, t, lang) for k, (t, lang) in enumerate([(t, "en") for t in en] + [(t, "de") for t in de])]
    models = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in language.predict(docs.select("doc_id", "text"), models).collect()}
    assert got[0].lang_pred == got[1].lang_pred == "und" and got[0].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    test = spark.createDataFrame([(1, "that cat went on then"), (2, "nicht die katze und der hund")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.predict(test, models).collect()} == {1: "en", 2: "de"}
    assert language.fit(nothing) == {} and language.predict(nothing.select("text"), {}).count() == 0


def test_near_dedup(spark, docs, nothing):
    got = {r.doc_id: r for r in minhash.near_dedup(docs, width=3, percent=85).collect() if r.doc_id is not None}
    assert got[0].n_shingles == got[1].n_shingles == 0 and got[0].component_id == 0 and got[1].component_id == 1
    assert got[4].component_id == got[5].component_id == got[6].component_id == got[7].component_id == 4
    assert minhash.near_dedup(nothing).count() == 0


def test_near_dedup_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(60)]
        for _ in range(rng.integers(1, 15)):
            w = base[:]
            for at in rng.integers(0, 60, rng.integers(0, 5)):
                w[at] = f"n{rng.integers(1 << 30)}"
            rows.append((len(rows), " ".join(w)))
    sets = {k: {tuple(words(t)[i : i + 3]) for i in range(58)} for k, t in rows}
    top = {k: k for k in sets}
    changed = True
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            low = min(top[a], top[b])
            changed |= top[a] != low or top[b] != low
            top[a] = top[b] = low
    found = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85)
    assert {r.doc_id: r.component_id for r in found.collect()} == top


def test_token_counts():
    from tokenizers import Tokenizer, models

    vocabulary = token_counts.Vocabulary([("<unk>", -1e9), ("▁", -3.0), ("▁ab", -4.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("bc", -3.5), ("c", -2.5)], 0, False, True)
    counter = token_counts.Counter(vocabulary)
    counter.unknown_score = -1e9 - 10
    exact = Tokenizer(models.Unigram(vocabulary.pieces, 0, False))
    rng = np.random.default_rng(2)
    for _ in range(300):
        text = " ".join("".join(rng.choice(list("abcxé"), rng.integers(1, 9))) for _ in range(rng.integers(1, 4)))
        assert counter.texts(pa.array([text]))[0] == len(exact.encode("▁" + text.replace(" ", "▁")).ids)
    assert counter.texts(pa.array([None, "", "  "], pa.string())).tolist() == [0, 0, 0]


def test_html(spark):
    page = '<html><head><title>t</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy now</div><article><h1>Title</h1><p><b>One  &amp;\n two<br><p>short</p><aside>see also</aside><p>Three</p><script>var a="</p>";</script></article><div id="comments"><p>Nice!</p></div><footer>&copy; x</footer></body></html>'
    assert html_text.main_text(page) == "Title\nOne & two\nshort\nThree"
    assert html_text.main_text(None) == html_text.main_text("") == ""
    assert html_text.main_text("a < b and <p>c") == "a < b and\nc"
    rows = spark.createDataFrame([(1, None, page, "old"), (2, "u", None, None)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(rows).collect()}
    assert got[2] == ("", 0) and got[1][1] == len(got[1][0])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    base = [" ".join(f"d{d}w{k}" for k in range(120)) for d in range(30)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(base)] + [(100, base[3] + " more", "en", "s0", 1), (101, "tiny", "en", "s1", 4), (102, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in found}
    assert ids and not ids & {100, 101, 102}
