"""Quality rules on repetition, from a suffix array of each text's words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACES, Batch, map_batches, slices

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("repeat_chars", pa.int64()), ("longest_repeat", pa.int64()), ("n_repeats", pa.int64())]


def suffix_array(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of all texts in order, each ending with its text, and ranks by level.

    ranks[k][i] is equal for two suffixes if both go on for 2**k words in their text and
    those are the same words of the same text. Prefix doubling: a round sorts only the
    suffixes that are still tied.
    """
    n = len(codes)
    key = doc * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = heads
    ranks = [rank.astype(np.int32 if n < 2**31 else np.int64)]
    step = 1
    while True:
        tied = ~new | ~np.concatenate((new[1:], [True]))
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order, ranks
        at = order[slots]
        ahead = at + step
        inside = ahead < n
        inside[inside] = doc[ahead[inside]] == doc[at[inside]]
        second = np.zeros(len(at), np.int64)
        second[inside] = rank[ahead[inside]] + 1
        both = rank[at] * (n + 1) + second
        by = np.argsort(both, kind="stable")
        at, both = at[by], both[by]
        order[slots] = at
        new[slots] = np.concatenate(([True], both[1:] != both[:-1]))
        heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = rank.copy()
        rank[at] = heads[slots]
        ranks.append(rank.astype(ranks[0].dtype))
        step *= 2


def common_prefixes(codes: np.ndarray, doc: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, words that each shares with the one before it).

    stop: where the text of each word ends. Each common prefix is found by descending
    through the ranks; suffixes of different texts share nothing.
    """
    n = len(codes)
    order, ranks = suffix_array(codes, doc)
    lcp = np.zeros(n, np.int64)
    pair = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    a, b = order[pair - 1], order[pair]
    same = np.zeros(len(pair), np.int64)
    while ranks:
        level, x, y = ranks.pop(), a + same, b + same
        fits = np.flatnonzero((x < stop[a]) & (y < stop[b]))
        equal = fits[level[x[fits]] == level[y[fits]]]
        same[equal] += 1 << len(ranks)
    lcp[pair] = same
    return order, lcp


def maximal_repeats(order: np.ndarray, lcp: np.ndarray, codes: np.ndarray, doc: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(number of words, first suffix in order, number of suffixes) of each maximal repeat of at least ``least`` words.

    These are the longest-common-prefix intervals (all suffixes that share so many words and
    no more) whose suffixes aren't all preceded by one word, so that they can't be made
    longer to the left either. Intervals are closed bottom up, with a stack.
    """
    many = -1  # several words go before

    def before(i: int) -> int:
        p = int(order[i])
        return int(codes[p - 1]) if p and doc[p - 1] == doc[p] else -2 - p

    stack: list[list[int]] = []  # words, first suffix, what goes before
    high = np.flatnonzero(lcp >= least)
    for k, i in enumerate(high.tolist()):
        if k == 0 or high[k - 1] != i - 1:  # the first of a run
            leaf = before(i - 1)
        words, first, last = int(lcp[i]), i - 1, leaf
        while stack and stack[-1][0] > words:
            size, first, word = stack.pop()
            last = word if word == last else many
            if last == many:
                yield size, first, i - first
        if stack and stack[-1][0] == words:
            stack[-1][2] = last if stack[-1][2] == last else many
        else:
            stack.append([words, first, last])
        leaf = before(i)
        if k + 1 == len(high) or high[k + 1] != i + 1:  # the last of a run
            last = leaf
            while stack:
                size, first, word = stack.pop()
                last = word if word == last else many
                if last == many:
                    yield size, first, i + 1 - first


def measure(texts: pa.Array, *, least: int = 5, min_words: int = 10, base_percent: int = 20, max_percent: int = 20, max_longest: int = 100) -> list[np.ndarray]:
    """The columns of FIELDS for each text."""
    batch = Batch(texts)
    data, n_docs = batch.data, batch.n
    char = (data & 0xC0) != 0x80
    counts = np.diff(batch.first)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    lines = np.array([0 if t is None else doubled_lines(t) for t in texts.to_pylist()], np.int64)
    sums = np.concatenate(([0], np.cumsum(char & batch.solid)))
    word_chars, n_symbols = batch.total(char & batch.solid), batch.total(symbol[data])
    repeat_words, repeat_chars, longest, occurrences = (np.zeros(n_docs, np.int64) for _ in range(4))
    if len(batch.start):
        codes, _ = batch.codes()
        doc = np.repeat(np.arange(n_docs), counts)
        order, lcp = common_prefixes(codes, doc, np.repeat(batch.first[1:], counts))
        # the spans of all intervals: at each place the longest of those that have it
        reach = np.zeros(len(codes), np.int64)
        for size, first, n in maximal_repeats(order, lcp, codes, doc, least):
            at = order[first : first + n]
            reach[at] = np.maximum(reach[at], size)
            occurrences[doc[at[0]]] += 1
            longest[doc[at[0]]] = max(longest[doc[at[0]]], size)
        at = np.flatnonzero(reach)
        depth = np.bincount(at, minlength=len(codes) + 1) - np.bincount(at + reach[at], minlength=len(codes) + 1)
        covered = np.cumsum(depth)[:-1] > 0
        chars = sums[batch.stop] - sums[batch.start]
        repeat_words = np.bincount(doc, covered, n_docs).astype(np.int64)
        repeat_chars = np.bincount(doc, covered * chars, n_docs).astype(np.int64)
    failed = (counts < min_words) | (100 * repeat_words > base_percent * counts)
    kept = ~failed & (100 * repeat_chars <= max_percent * word_chars) & (longest <= max_longest)
    return [counts, word_chars, n_symbols, lines, repeat_words, failed, kept, repeat_chars, longest, occurrences]


def doubled_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def repetition(docs: DataFrame, *, text_col: str = "text", prefix: str = "", filtered: bool = False, **limits: int) -> DataFrame:
    """Adds the repetition measures of each text to all columns of docs (or drops what fails).

    A word is a run of anything but U+0020 and U+0009 to U+000D. Base: word_chars (code
    points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier
    line), n_repeat_words (words in 5-word windows found twice or more), base_failed. The
    suffix array of the text's words and its longest-common-prefix intervals give the
    maximal repeats of at least ``least`` words; the union of their occurrences covers
    repeat_chars characters (and, at 5 words, n_repeat_words words), longest_repeat is the
    longest in words, n_repeats the number of different maximal repeats. kept: not
    base_failed, at most max_percent of the characters in words covered, no repeat over
    max_longest words.

    Null and empty texts have no word, so they fail on min_words. Texts may be of any
    length; memory is about 300 bytes a word of the longest one (225 to 307 measured). Repeated rows are measured
    alike. New columns get ``prefix``; one that docs has already raises ValueError, as
    would be lost. Empty input: no rows.

    filtered: returns the rows that are kept, with the columns of docs only.
    """
    names = [prefix + n for n, _ in FIELDS]
    clash = set(names) & set(docs.columns)
    if clash and not filtered:
        raise ValueError(f"docs has columns named {sorted(clash)}; pass a prefix")
    verdict = [n for n, _ in FIELDS].index("kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for a, b in slices(texts):
                made = measure(texts[a:b], **limits)
                part = batch.slice(a, b - a)
                if filtered:
                    yield part.filter(pa.array(made[verdict]))
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x, t) for x, (_, t) in zip(made, FIELDS)]], names=[*part.schema.names, *names])

    kinds = {pa.int64(): "long", pa.bool_(): "boolean"}
    schema = ", ".join([f"`{n}` {t}" for n, t in docs.dtypes] + ([] if filtered else [f"`{n}` {kinds[t]}" for n, (_, t) in zip(names, FIELDS)]))
    return map_batches(docs, run, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    """Registered query: every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repetition(docs).drop("text")
