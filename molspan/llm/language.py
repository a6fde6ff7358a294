"""Language ID by prediction by partial matching, with exact code lengths."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Batch, map_batches, ranges, slices

#: Bytes of context, at most.
ORDER = 4
#: Bounds of the training sample: documents and code points of each language, and languages.
SAMPLE_DOCS = 128
SAMPLE_BYTES = 1 << 20
LANGUAGES = 1000
#: Bytes of text scored at once.
CHUNK = 4 << 20


def events(texts: Batch, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """A key for each byte of the texts' words and of one space after each word, and how many each text has.

    The key is the byte below its context: the ``order`` bytes before it in the text, where
    each run of white space is one space; one stands before the first word, and 0 beyond.
    """
    counts = np.diff(texts.first)
    doc = np.repeat(np.arange(texts.n), counts)
    begin = np.cumsum(texts.length + 1) - texts.length - 1 + order * (doc + 1)
    line = np.zeros(int(texts.length.sum()) + len(doc) + order * texts.n, np.uint64)
    inside = np.repeat(begin, texts.length) + ranges(texts.length)
    line[inside] = texts.data[texts.solid]
    line[begin + texts.length] = 32
    size = np.bincount(doc, texts.length + 1, texts.n).astype(np.int64)
    start = np.cumsum(size) - size + order * np.arange(1, texts.n + 1)
    line[(start - 1)[size > 0]] = 32
    at = np.repeat(start, size) + ranges(size)
    key = np.zeros(len(at), np.uint64)
    for back in range(order, -1, -1):
        key = (key << np.uint64(8)) | line[at - back]
    return key, size


class Model:
    """A context tree of one language, with the counts of its sample frozen.

    A byte seen in the longest known context costs -log2(n / (total + kinds)). Otherwise
    the escape costs -log2(kinds / (total + kinds)), and the next shorter context is asked,
    without the bytes that the longer one has. Below the empty context all bytes not seen
    there are alike.
    """

    def __init__(self, key: np.ndarray, order: int = ORDER) -> None:
        self.order, self.levels = order, []
        longer = None
        for k in range(order, -1, -1):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            pair, n = np.unique(key & mask, return_counts=True)
            context, where = np.unique(pair >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(where, n, len(context)), np.bincount(where, minlength=len(context))
            level = {"pair": pair, "n": n, "context": context, "total": total, "kinds": kinds}
            if longer is not None:  # what of this context's counts the longer contexts' bytes hold
                held = n[np.searchsorted(pair, longer["pair"] & mask)]
                own = np.searchsorted(longer["context"], longer["pair"] >> np.uint64(8))
                level["held"] = np.bincount(own, held, len(longer["context"]))
                level["held_kinds"] = longer["kinds"]
            self.levels.append(level)
            longer = level

    def bits(self, key: np.ndarray) -> np.ndarray:
        """Code length of each event."""
        cost, open_, above = np.zeros(len(key)), np.arange(len(key)), np.full(len(key), -1)
        for k, level in zip(range(self.order, -1, -1), self.levels):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            pair = key[open_] & mask
            context = pair >> np.uint64(8)
            at = np.searchsorted(level["context"], context).clip(0, max(len(level["context"]) - 1, 0))
            known = level["context"][at] == context
            pair, at, who = pair[known], at[known], open_[known]
            total, kinds = level["total"][at].astype(float), level["kinds"][at].astype(float)
            before = above[who]
            if k < self.order:
                had = before >= 0
                total[had] -= level["held"][before[had]]
                kinds[had] -= level["held_kinds"][before[had]]
            place = np.searchsorted(level["pair"], pair).clip(0, len(level["pair"]) - 1)
            hit = level["pair"][place] == pair
            cost[who[hit]] -= np.log2(level["n"][place[hit]] / (total[hit] + kinds[hit]))
            miss = ~hit & (kinds > 0)  # with no other byte left there is nothing to escape from
            cost[who[miss]] -= np.log2(kinds[miss] / (total[miss] + kinds[miss]))
            above[:] = -1
            above[who] = at
            open_ = np.concatenate((open_[~known], who[~hit]))
        last = self.levels[-1]
        seen = int(last["kinds"][0]) if len(last["kinds"]) else 0
        cost[open_] += np.log2(max(256 - seen, 1))
        return cost


def train(texts: list[str], order: int = ORDER) -> Model:
    return Model(events(Batch(pa.array(texts, pa.string()), lower=True), order)[0], order)


def fit(rows: DataFrame, *, text_col: str = "text", lang_col: str = "lang", order_by: Column | None = None, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, order: int = ORDER) -> dict[str, Model]:
    """A model for each label of the rows (null labels and texts: not used).

    Of each language the sample_docs rows with the smallest hash are taken, and of those
    the first sample_bytes code points of text in all. A threshold on the hash, from counts by
    label, leaves about that many rows before they are ranked, so a hot language isn't
    gathered; texts are cut to the bound before they reach the driver. order: 1 to 7 bytes.
    More than LANGUAGES labels: ValueError.
    """
    if not 1 <= order <= 7:
        raise ValueError("a key holds a byte and 1 to 7 before it")
    place = F.xxhash64(order_by if order_by is not None else F.col(text_col), F.lit(9))
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).agg(F.count(F.lit(1))).orderBy(lang_col).limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels")
    if not counts:
        return {}
    # a share of the rows: 40 more than wanted, and half again
    share = {k: min(1.0, (1.5 * sample_docs + 40) / n) for k, n in counts.items()}
    table = F.from_json(F.lit(json.dumps(share)), "map<string,double>")
    unit = F.shiftrightunsigned(place, 33).cast("double") / float(1 << 31)
    few = rows.where(unit < table[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), place.alias("place"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    few = few.withColumn("rank", rank).where(F.col("rank") <= sample_docs).withColumn("room", F.lit(sample_bytes) - before).where("room > 0")
    sample = few.select("lang", "rank", F.substring(F.col("text"), F.lit(1), F.col("room").cast("int")).alias("text")).collect()
    by: dict[str, list] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["rank"])):
        by.setdefault(r["lang"], []).append(r["text"])
    return {lang: train(texts, order) for lang, texts in sorted(by.items())}


def predict(docs: DataFrame, models: dict[str, Model], *, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds lang_pred and score to the columns of docs.

    The label with the shortest code for the whole text (ties: the first in code point
    order); score is its share if each label weighs 2 to the minus code length. Every byte
    of the text is coded after the bytes before it, A-Z as lower case and each run of white
    space as one space; equal bytes after equal contexts of a chunk are worked out once.
    Text without a letter, or null, and any text if there is no model: "und", score 0.
    Repeated rows are scored alike. New columns get ``prefix``; one that docs has already
    raises ValueError. Empty input: no rows.
    """
    clash = {f"{prefix}lang_pred", f"{prefix}score"} & set(docs.columns)
    if clash:
        raise ValueError(f"docs has columns named {sorted(clash)}; pass a prefix")
    names, order = sorted(models), next((m.order for m in models.values()), ORDER)
    shared = docs.sparkSession.sparkContext.broadcast([models[n] for n in names])  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for a, b in slices(texts, CHUNK):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *score(texts[a:b])], names=[*part.schema.names, f"{prefix}lang_pred", f"{prefix}score"])

    def score(texts: pa.Array) -> list[pa.Array]:
        letters = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False), bool)
        best, share = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        words = Batch(texts, lower=True)
        if names and len(words.start):
            key, size = events(words, order)
            coded = pa.array(key).dictionary_encode()
            each, back = np.asarray(coded.dictionary), np.asarray(coded.indices)
            some = np.flatnonzero(size)
            bits = np.zeros((len(names), words.n))
            for k, m in enumerate(shared.value):
                bits[k, some] = np.add.reduceat(m.bits(each)[back], (np.cumsum(size) - size)[some])
            best = bits.argmin(0)
            share = 1 / np.exp2(np.maximum(bits.min(0) - bits, -1000)).sum(0)
        lang = np.array([*names, "und"], object)[np.where(letters & bool(names), best, len(names))]
        return [pa.array(lang, pa.string()), pa.array(np.where(letters & bool(names), share, 0.0))]

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", `{prefix}lang_pred` string, `{prefix}score` double"
    return map_batches(docs, run, schema)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def op9(spark, sf_dir: str) -> DataFrame:
    """Registered query: every whole text of ``documents``; held out: crc32(doc_id as text) mod 4 = 2.

    Null doc_id: as the empty string, so not held out.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = fit(docs.where(fold(F.col("doc_id")) != 2).select("doc_id", "text", "lang"), order_by=F.col("doc_id"))
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "text")
    return predict(rows, models).drop("text")
