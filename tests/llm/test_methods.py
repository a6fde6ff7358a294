"""Each method against a slow twin, and the cases that its operator's docstring states."""

import math
import os
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from molspan.llm import common, exact_dedup, html_text, language, line_dedup, minhash, repetition, resharding, token_counts
from molspan.operators import similarity

SF = "/root/testdata/sf0.001"


# Exact dedup and mixing: the driver's SQL, on the smallest tables


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["op3_exact_dedup", "op8_mixing"])
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    theirs = con.execute(entry.oracle_sql()[name]).df()
    mine = entry.queries()[name](spark, SF).toPandas()[list(theirs.columns)]
    plain = lambda df: sorted(repr(tuple(round(float(x), 6) if isinstance(x, float) else str(x) for x in r)) for r in df.itertuples(index=False))
    assert plain(mine) == plain(theirs)


def test_filters_keep_what_is_there(spark):
    keys = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("key"))
    bitmap = common.key_filter(keys, bits=1 << 12)
    rows = spark.range(2000)
    held = {r.id for r in common.sieve(rows, F.xxhash64("id"), bitmap).collect()}
    assert held >= set(range(0, 2000, 3)) and held | {r.id for r in common.sieve(rows, F.xxhash64("id"), bitmap, held=False).collect()} == set(range(2000))
    wanted = spark.range(0, 3000, 3)
    assert {r.id for r in common.pick(rows, wanted, ["id"], limit=5).collect()} == set(range(0, 2000, 3))
    assert {r.id for r in common.drop(rows, wanted, ["id"], limit=5).collect()} == set(range(2000)) - set(range(0, 2000, 3))


# Quality rules


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=26), min_size=1, max_size=4))
def test_maximal_repeats(texts):
    made = repetition.measure(pa.array([" ".join(t) for t in texts]), least=2)
    for i, w in enumerate(texts):
        places = defaultdict(list)
        for a in range(len(w)):
            for n in range(2, len(w) - a + 1):
                places[tuple(w[a : a + n])].append(a)
        maximal = [
            (s, at) for s, at in places.items() if len(at) > 1
            and len({w[a - 1] if a else -a - 1 for a in at} | {None if not a else "" for a in at if not a}) > 1
            and len({w[a + len(s)] if a + len(s) < len(w) else None for a in at}) > 1
        ]
        cover = {k for s, at in maximal for a in at for k in range(a, a + len(s))}
        assert int(made[9][i]) == len(maximal) and int(made[8][i]) == max((len(s) for s, _ in maximal), default=0)
        assert int(made[4][i]) == len(cover)


# Token counts


def unigram(rng, byte_fallback):
    from tokenizers import Tokenizer, models

    pieces = [("<unk>", -20.0), ("▁", -3.0), ("▁ab", -4.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("bc", -3.5), ("c", -2.5), ("▁a", -5.0), ("a▁b", -3.0)]
    if byte_fallback:
        pieces += [(f"<0x{k:02X}>", -19.0) for k in range(256)]
    pieces = [(p, s - float(rng.integers(0, 3))) for p, s in pieces]
    return token_counts.Counter(token_counts.Vocabulary(pieces, 0, byte_fallback, True)), Tokenizer(models.Unigram(pieces, 0, byte_fallback))


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_counts_are_the_tokenizers(byte_fallback):
    rng = np.random.default_rng(3)
    for _ in range(30):
        counter, exact = unigram(rng, byte_fallback)
        for _ in range(20):
            text = " ".join("".join(rng.choice(list("abcxé漢"), rng.integers(1, 9))) for _ in range(rng.integers(1, 4)))
            assert counter.texts(pa.array([text]))[0] == len(exact.encode("▁" + text.replace(" ", "▁")).ids), text


def test_only_six_characters_part_words(spark):
    pieces = [("<unk>", -9.0), ("▁", -1.0), ("a", -2.0), ("b", -2.0), (" ", -2.0), ("b▁a", -9.0)]
    vocabulary = token_counts.Vocabulary(pieces, 0, False, True)
    assert not token_counts.Counter(vocabulary).by_word
    rows = [(1, "a b", "old"), (1, "a b", "old"), (2, None, None), (3, " \t\n", ""), (4, "a \x0b b", "x")]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), vocabulary)
    assert got.columns == ["doc_id", "text", "n_tokens"]
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == [(1, 4), (1, 4), (2, 0), (3, 0), (4, 4)]
    assert token_counts.token_counts(spark.createDataFrame([], "text string"), vocabulary).count() == 0


# Main text


def slow_main_text(page, window, surge):
    """main_text() with every window summed anew."""
    lines = html_text.page_lines(page)
    marked = any(x.in_main for x in lines)
    weight = []
    for x in lines:
        w = x.weight
        if marked and not x.in_main:
            w *= html_text.OUTSIDE_WEIGHT
        if not marked and len(x.text) < 200 and html_text.RIGHTS.match(x.text):
            w *= html_text.NAMED_WEIGHT
        weight.append(w if x.text else 0.0)
    size = [(max(x.plain, 1) if x.in_main and x.text else x.plain) * w for x, w in zip(lines, weight)]
    value = [sum(size[i : i + window]) for i in range(len(size))]
    best = max(value, default=0)
    if not best:
        return ""
    high, run = [], []
    for i, v in enumerate([*value, 0]):
        if v > 0:
            run.append(i)
        elif run:
            if max(value[k] for k in run) >= max(min(surge, best), html_text.OF_BEST * best) - 1e-9:
                high.append(run)
            run = []
    keep, least = set(), {}
    for run in high:
        solid = [k for k in run if size[k] > 0]
        run = range(solid[0], solid[-1] + 1)
        top = max(weight[k] for k in run)
        for k in run:
            if lines[k].text and weight[k] >= top:
                keep.add(k)
                least[lines[k].element] = min(top, least.get(lines[k].element, top))
    full = max(least.values())
    keep |= {k for k, x in enumerate(lines) if x.text and (size[k] > 0 and weight[k] >= least.get(x.element, 9) or min(keep) < k < max(keep) and weight[k] >= full)}
    return "\n".join(lines[k].text for k in sorted(keep))


def random_page(rng):
    word = lambda n: " ".join(rng.choice(["aa", "bbb", "cccc", "Copyright", "&amp;"]) for _ in range(n))
    out = []

    def block(depth):
        kind = rng.randrange(9)
        if kind < 3 or depth > 3:
            out.append(f"<p>{word(rng.randrange(1, 60))}</p>")
        elif kind == 3:
            out.append("<ul>" + "".join(f'<li><a href="x">{word(1)}</a>' for _ in range(rng.randrange(1, 5))) + "</ul>")
        else:
            tag = rng.choice(["div", "div", "section", "article", "main", "nav", "footer", "aside", "form", "header"])
            name = rng.choice(["", "", ' class="ad"', ' class="content"', ' id="comments"', ' class="post no-comments"'])
            out.append(f"<{tag}{name}>")
            for _ in range(rng.randrange(1, 4)):
                block(depth + 1)
            out.append(f"</{tag}>" if rng.random() < 0.9 else "")

    for _ in range(rng.randrange(1, 6)):
        block(0)
    return "".join(out)


def test_main_text_against_a_slow_twin():
    rng = random.Random(6)
    for _ in range(600):
        page, window, surge = random_page(rng), rng.choice([1, 2, 3, 5]), rng.choice([1, 80, 400])
        assert html_text.main_text(page, window, surge) == slow_main_text(page, window, surge), page


SHORT, LONG = "A short teaser of some thirty letters.", "A sentence of an article that goes on and on. " * 8


def test_the_distribution_decides_on_pages_with_articles():
    page = f"<article><p>{LONG}<p>{LONG}</article><article><p>{SHORT * 4}</article>"
    assert html_text.main_text(page) == "\n".join([LONG.strip()] * 2 + [SHORT * 4])
    assert html_text.main_text(page, surge=10_000) == "\n".join([LONG.strip()] * 2)
    assert html_text.main_text(f"<article><p>{LONG}<p>{LONG}<p>{LONG}</article><article><p>{SHORT}</article>") == "\n".join([LONG.strip()] * 3)
    # a window wider than the gap between two articles makes one stretch of them
    assert html_text.main_text(page, window=9, surge=10_000) == html_text.main_text(page)
    # outside of articles text counts for little, not for nothing
    assert html_text.main_text(f"<div><p>{LONG * 9}</div><article>{SHORT}</article>").startswith(LONG.strip())


@pytest.mark.parametrize("name", ["content has-sidebar", "post no-comments", "with-ads", "entry comments-open"])
def test_names_of_wrappers_take_nothing(name):
    assert html_text.main_text(f'<div class="{name}"><h1>Title</h1><p>{LONG}</div>') == f"Title\n{LONG.strip()}"


def test_menus_without_names_go():
    menu = "".join(f'<div><a href="/{k}">Menu {k}</a></div>' for k in range(5))
    assert html_text.main_text(f"<body>{menu}<div>{LONG}</div><div>Short end.</div>{menu}</body>") == f"{LONG.strip()}\nShort end."


def test_pages_are_read_in_time_that_grows_with_them():
    took = {}
    for n in (16_000, 32_000):
        for page in ("<select>" + "<option>x" * n, "<div><p>x" * n, "<b><p>" * n + "</i>" * n, "</div>" * n + "<table>" * n):
            began = time.process_time()
            html_text.main_text(page)
            took[n] = took.get(n, 0) + time.process_time() - began
    assert took[32_000] < 5 and took[32_000] < 4 * took[16_000] + 0.2


def test_pages_as_rows(spark):
    shape = "page_id long, url string, html string, n_chars string"
    rows = [(1, "u", f"<article>{LONG}", "x"), (1, "u", f"<article>{LONG}", "x"), (2, None, None, None), (3, "v", "<p>" + "word " * 400_000, "")]
    got = sorted((r.page_id, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, shape)).collect())
    assert got == [(1, len(LONG) - 1), (1, len(LONG) - 1), (2, 0), (3, 1_999_999)]
    assert html_text.extract(spark.createDataFrame([], shape)).count() == 0


# Resharding


def test_no_row_is_lost(spark):
    rows = spark.createDataFrame([(k if k % 3 else None, 0 if k % 2 else 10 * k, k % 7 - 1, "x") for k in range(90)], "doc_id long, size long, old_shard int, slot string")
    got = resharding.reshard(rows.unionByName(rows), shards=4, block_rows=5).collect()
    assert len(got) == 180 and sum(r.size for r in got) == 2 * sum(10 * k for k in range(0, 90, 2))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(4))
    with pytest.raises(ValueError):
        resharding.reshard(rows, shards=2, capacity=[10, 10])
    with pytest.raises(ValueError):
        resharding.reshard(rows, shards=2, capacity=[10**6])
    with pytest.raises(ValueError):
        resharding.transfers({k: 1 for k in range(resharding.SHARDS + 1)}, [10**6])
    nothing = resharding.reshard(rows.withColumn("size", F.lit(0)), shards=3).collect()
    assert len(nothing) == 90 and all(r.shard == (r.old_shard if 0 <= r.old_shard < 3 else 0) for r in nothing)


def test_what_moves_is_what_the_flow_says(spark):
    sizes = {0: 4000, 1: 100, 2: 900, 5: 50}
    rows = spark.createDataFrame([(s * 10**6 + k, 1, s) for s, n in sizes.items() for k in range(n)], "doc_id long, size long, old_shard int")
    capacity = [1500, 1500, 1300, 750]
    got = resharding.reshard(rows, shards=4, capacity=capacity, block_rows=100).collect()
    want = sum(n for a, b, n in resharding.transfers(sizes, capacity) if a != b)
    assert want == 5050 - (1500 + 100 + 900)
    assert sum(r.old_shard != r.shard for r in got) == want and Counter(r.shard for r in got) == dict(enumerate(capacity))


def test_rewriting_touches_changed_shards_only(spark, tmp_path):
    path = f"{tmp_path}/layout"
    rows = [(None if k % 5 == 0 else k % 11, f"text {k}", k % 4) for k in range(80)] + [(3, "same", 2)] * 3
    spark.createDataFrame(rows, "doc_id long, text string, shard int").write.partitionBy("shard").parquet(path)
    before = {f: os.stat(f).st_mtime_ns for s in range(4) for f in [os.path.join(path, f"shard={s}", x) for x in os.listdir(f"{path}/shard={s}")]}
    time.sleep(0.02)
    plan = resharding.stored(spark, path)
    # shard 0 is drained into 1 and 4; 2 and 3 stay
    plan = plan.withColumn("shard", F.when(F.col("old_shard") == 0, F.when(F.col("place.row") % 2 == 0, 1).otherwise(4)).otherwise(F.col("old_shard")))
    assert resharding.rewrite(spark, path, plan) == [0, 1, 4]
    got = spark.read.parquet(path)
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted((str(a), b) for a, b, _ in rows)
    assert {r.shard for r in got.collect()} == {1, 2, 3, 4} and not os.path.exists(f"{path}/shard=0") and not os.path.exists(f"{path}/_old")
    for f, then in before.items():
        if "shard=2" in f or "shard=3" in f:
            assert os.stat(f).st_mtime_ns == then
    assert resharding.rewrite(spark, path, resharding.stored(spark, path).withColumn("shard", F.col("old_shard"))) == []
    with pytest.raises(ValueError):
        resharding.rewrite(spark, path, resharding.stored(spark, path).where("old_shard <> 2 OR place.row > 0").withColumn("shard", F.lit(7)))


def test_a_plan_comes_back_from_the_files(spark, tmp_path):
    path = f"{tmp_path}/layout"
    spark.range(500).select("id", F.col("id").cast("string").alias("text"), F.when(F.col("id") < 400, 0).otherwise(1).alias("shard")).write.partitionBy("shard").parquet(path)
    rows = resharding.stored(spark, path).select(F.col("id").alias("doc_id"), F.lit(10).cast("long").alias("size"), "old_shard", "place")
    placed = resharding.reshard(rows, shards=3, block_rows=40)
    want = {r.doc_id: r.shard for r in placed.collect()}
    assert resharding.rewrite(spark, path, placed) == [0, 1, 2]
    assert {r.id: r.shard for r in spark.read.parquet(path).collect()} == want and sorted(Counter(want.values()).values()) == [166, 167, 167]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_resharding_query(spark):
    import zlib

    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entry.queries()["op6_resharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all((r.size, r.text_crc32, r.law) == (len(docs[r.doc_id]) + 16, zlib.crc32(docs[r.doc_id]), "bytes") for r in got)
    held = Counter()
    for r in got:
        held[r.shard] += r.size
    most = max(r.size for r in got)
    assert max(held.values()) - min(held.get(s, 0) for s in range(40)) <= 2 * most


# Line dedup


def test_digests_of_several_contents_are_told_apart(spark):
    rng = random.Random(8)
    passages = ["\n".join(f"p{p} line {k}" for k in range(2)) for p in range(12)]
    rows, seen, want = [], set(), {}
    for k in range(60):
        own, p = [f"own {k} {rng.random()}" for _ in range(2)], passages[rng.randrange(12)]
        rows.append((k, f"{own[0]}\n{p}\n{own[1]}"))
        want[k] = f"{own[0]}\n{own[1]}" if p in seen else rows[-1][1]
        seen.add(p)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (64, 5):  # with five bits, digests have many contents
        assert {r.doc_id: r.text for r in line_dedup.line_dedup(docs, pairs=True, digest_bits=bits).collect()} == want


def test_line_dedup_cases(spark):
    rows = [(None, "a b\nc d\ne"), (1, "a b\nc d\ne"), (1, "a b\nc d\nf"), (2, None), (3, ""), (2, None), (1, "a b\nc d\ne")]
    docs = spark.createDataFrame([(*r, "k", "n") for r in rows], "doc_id long, text string, n_lines string, digest string")
    got = line_dedup.line_dedup(docs, pairs=True, counts=True)
    assert got.columns == ["doc_id", "text", "digest", "n_lines", "n_removed_lines"]
    by = Counter((r.doc_id, r.text, r.n_lines, r.n_removed_lines) for r in got.collect())
    assert by[(None, "", 3, 3)] == 1 and by[(2, None, 0, 0)] == 2 and by[(3, "", 1, 0)] == 1
    assert sum(n for (i, *_), n in by.items() if i == 1) == 3
    assert line_dedup.line_dedup(docs.limit(0), pairs=True, counts=True).count() == 0


# Language


def slow_bits(train, text, order):
    """Code length of a text by PPM with exclusion, one byte at a time."""
    plain = lambda t: " ".join(re.findall("[^\x20\x09-\x0d]+", t)).lower().encode()
    line = lambda t: b"\0" * (order - 1) + b" " + plain(t) + b" " if plain(t) else b""
    tables = [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        x = line(t)
        for i in range(order, len(x)):
            for k in range(order + 1):
                tables[k][x[i - k : i]][x[i]] += 1
    total, x = 0.0, line(text)
    for i in range(order, len(x)):
        excluded: set = set()
        for k in range(order, -1, -1):
            seen = {b: n for b, n in tables[k].get(x[i - k : i], {}).items() if b not in excluded}
            if not tables[k].get(x[i - k : i]):
                continue
            n, kinds = sum(seen.values()), len(seen)
            if x[i] in seen:
                total -= math.log2(seen[x[i]] / (n + kinds))
                break
            if kinds:
                total -= math.log2(kinds / (n + kinds))
            excluded |= set(tables[k][x[i - k : i]])
        else:
            total += math.log2(max(256 - len(tables[0].get(b"", ())), 1))
    return total


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab c", max_size=30), min_size=1, max_size=4), st.text("abd c\n", max_size=25), st.integers(1, 5))
def test_code_lengths(train, text, order):
    model = language.train(train, order)
    key, size = language.events(common.Batch(pa.array([text, None, "b"]), lower=True), order)
    if any(t.strip() for t in train):
        bits = model.bits(key)
        assert bits[: size[0]].sum() == pytest.approx(slow_bits(train, text, order)) and size[1] == 0
        assert bits[size[0] :].sum() == pytest.approx(slow_bits(train, "b", order))


def test_language_cases(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("x", None)] * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language.fit(docs, sample_bytes=10)  # cut to the bound
    assert sorted(models) == ["de", "en"] and len(models["en"].levels[-1]["pair"]) <= 11
    with pytest.raises(ValueError):
        language.predict(docs.withColumn("score", F.lit(1)), models)
    got = language.predict(docs.select("doc_id", "text", F.lit(1).alias("score")), language.fit(docs), prefix="my_").collect()
    assert {r.doc_id: r.my_lang_pred for r in got} == {0: "en", 1: "de", 2: "und", 3: got[3].my_lang_pred, 4: "en", 5: "de", 6: "und", 7: got[7].my_lang_pred}
    assert got[0].my_score == got[4].my_score
    with pytest.raises(ValueError):
        language.fit(spark.range(1001).select(F.lit("x").alias("text"), F.col("id").cast("string").alias("lang")))
    long = language.predict(spark.createDataFrame([("the cat " * 200_000,), ("... 123",)], "text string"), language.fit(docs)).collect()
    assert [r.lang_pred for r in long] == ["en", "und"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_languages(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [r for r in entry.queries()["op9_language"](spark, SF).collect() if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert len(got) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.95 * len(got)


# Near-dedup


def chained_pairs(pairs, size=120, apart=11, near=9):
    """Pairs of texts at about 0.83 to each other, at about 0.7 to all other pairs."""
    rng, base, rows = random.Random(4), [f"w{k}" for k in range(size)], []
    for g in range(pairs):
        first = list(base)
        for k in rng.sample(range(0, size, 3), apart // 2):
            first[k] = f"g{g}k{k}"
        second = list(first)
        second[size - 1 - rng.randrange(3)] = f"s{g}"
        second[rng.randrange(3)] = f"t{g}"
        rows += [(2 * g, " ".join(first)), (2 * g + 1, " ".join(second))]
    return rows


@pytest.mark.parametrize("deal_again", [similarity.DEAL_AGAIN, 100])
def test_crowds_of_alike_texts_lose_no_link(spark, monkeypatch, deal_again):
    monkeypatch.setattr(similarity, "DEAL_AGAIN", deal_again)
    rows = chained_pairs(350)
    sets = {k: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for k, t in rows}
    parent = {k: k for k in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                links += 1
                p, q = top(a), top(b)
                parent[max(p, q)] = min(p, q)
    assert len({top(k) for k in sets}) > 100 and links >= 350
    found = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85)
    assert {r.doc_id: r.component_id for r in found.collect()} == {k: top(k) for k in sets}


def test_an_id_with_several_texts_is_one_node(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    near_b = b.replace("b59", "zz")
    rows = [(1, a), (2, a), (2, b), (3, near_b), (4, c), (4, c), (None, c), (None, near_b + " x")]
    got = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id} == {(1, 1), (2, 1), (2, 2), (3, 2), (4, 4)} or {(r.doc_id, r.component_id) for r in got if r.doc_id} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert {(r.component_id, r.kept) for r in got if r.doc_id is None} >= {(4, False)}
    assert exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).count() == 8
