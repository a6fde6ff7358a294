"""Best-fit packing by minimum bin slack over the lengths of tokenized pieces."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Batch, cut, give_back, map_batches, ranges, slices

#: Distinct words whose ids a Python worker keeps; further ones are encoded for each chunk anew.
CACHED_WORDS = 250_000
#: Bytes of text tokenized at once, and words encoded at once.
CHUNK, WORDS = 2 << 20, 20_000


def byte_signs() -> dict[int, int]:
    """The signs that byte-level tokenizers write for bytes: visible Latin-1 ones as they are, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 0x100 + k for k, b in enumerate(rest)}


SIGNS = byte_signs()


class Tokens:
    """Token ids of texts by word: no token of this kind of tokenizer spans white space.

    The words of a chunk are told apart exactly and each is encoded once. Where no special
    token can occur, A-Z is lower-cased first, as the tokenizer does, and a full stop or
    comma after an ASCII letter or digit at a word's end is a word by itself, as the
    tokenizer splits it off. A word of Latin letters only goes to the tokenizer's model
    directly: it is one piece to the splitter, and normal form C already.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        give_back()
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.first = np.zeros(CACHED_WORDS, np.int64)
        self.count = np.zeros(CACHED_WORDS, np.int64)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = []
        others, model = [], self.tokenizer.model
        for k, word in enumerate(words):
            text = word.decode("utf-8", "replace")
            if text.isalpha() and max(text) < "\u0250" and "\u0130" not in text:
                signs = text.lower()
                if not signs.isascii():
                    signs = signs.encode().decode("latin-1").translate(SIGNS)
                out.append([t.id for t in model.tokenize(signs)])
            else:
                others.append((k, text))
                out.append(None)
        made = self.tokenizer.encode_batch_fast([t for _, t in others], add_special_tokens=False)
        for (k, _), x in zip(others, made):
            out[k] = x.ids
        return out

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and first place and count for each word."""
        place = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        lost = np.flatnonzero(place < 0)
        size, parts = np.zeros(len(lost), np.int64), [np.zeros(0, np.uint32)]
        for a in range(0, len(lost), WORDS):
            new = self.encode([words[i] for i in lost[a : a + WORDS]])
            size[a : a + WORDS] = [len(x) for x in new]
            parts.append(np.fromiter(chain.from_iterable(new), np.uint32))
        ids = np.concatenate(parts)
        starts = np.cumsum(size) - size
        room = min(CACHED_WORDS - len(self.known), len(lost))
        if room:
            take = int(size[:room].sum())
            while self.used + take > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + take] = ids[:take]
            at = len(self.known)
            self.first[at : at + room] = self.used + starts[:room]
            self.count[at : at + room] = size[:room]
            self.known.update((words[i], at + k) for k, i in enumerate(lost[:room]))
            self.used += take
        first, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        old = place >= 0
        first[old], count[old] = self.first[place[old]], self.count[place[old]]
        first[lost], count[lost] = self.used + starts, size
        return np.concatenate([self.flat[: self.used], ids]), first, count

    def texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end_id after each, and where each text begins (and the last ends)."""
        safe = not pc.any(pc.match_substring(texts, "<|")).as_py()
        batch = Batch(texts, lower=safe)
        length, words_of = batch.length, np.diff(batch.first)
        if safe and len(length):
            last, before = batch.data[batch.stop - 1], batch.data[np.maximum(batch.stop - 2, 0)]
            alnum = ((before >= 97) & (before <= 122)) | ((before >= 48) & (before <= 57))
            apart = ((last == 46) | (last == 44)) & (length > 1) & alnum
            units = np.repeat(length, 1 + apart)
            tail = np.cumsum(1 + apart)[apart] - 1
            units[tail], units[tail - 1] = 1, length[apart] - 1
            doc = np.repeat(np.arange(batch.n), words_of)
            words_of = np.bincount(doc, 1 + apart, batch.n).astype(np.int64)
            batch.length = units
        codes, words = batch.codes()
        flat, first, count = self.look_up(words.to_pylist())
        sizes = count[codes] if len(codes) else np.zeros(0, np.int64)
        begin = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(words_of)))]
        ids = flat[np.repeat(first[codes], sizes) + ranges(sizes)] if len(codes) else np.zeros(0, np.uint32)
        out = np.insert(ids, begin[1:], np.uint32(end_id))
        return out, begin + np.arange(batch.n + 1)


@cache
def tokens_of(path: str) -> Tokens:
    """One for each worker process, so the words of one task serve the next."""
    return Tokens(path)


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Token pieces of every text: (id_col, piece, start, length, ids_crc32, part, rank[, ids]).

    Null texts count as empty: one piece of end_id alone. Only a document of more than
    ``limit`` ids is cut, every ``limit`` ids. part and rank: the task, and how many
    pieces of the same length came before in it. They hold only once the result is
    written; pack() does that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = tokens_of(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(limit + 1, np.int64)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts, CHUNK):
                ids, begin = tokens.texts(texts[a:b], end_id)
                total = np.diff(begin)
                number = -(-total // limit)
                row = np.repeat(np.arange(b - a), number)
                piece = ranges(number)
                start = piece * limit
                length = np.minimum(limit, total[row] - start)
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                at = (begin[row] + start) * 4
                crc = np.fromiter((zlib.crc32(raw[x : x + 4 * n]) for x, n in zip(at.tolist(), length.tolist())), np.int64, len(row))
                order = np.argsort(length, kind="stable")
                values, runs = np.unique(length, return_counts=True)
                rank = np.empty(len(length), np.int64)
                rank[order] = ranges(runs) + np.repeat(seen[values], runs)
                seen[values] += runs
                columns = [keys[a:b].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(row), part), pa.int32()), pa.array(rank)]
                names = [id_col, "piece", "start", "length", "ids_crc32", "part", "rank"]
                if with_ids:
                    bounds = np.concatenate((at // 4, begin[-1:])).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * with_ids
    return map_batches(docs.select(id_col, text_col), run, schema)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """A combination of available lengths (ascending) of the largest sum up to ``room``.

    Bit s of ``reach`` says whether some combination of the lengths so far sums to s. Longer
    lengths are offered first, several copies as 1, 2, 4, ... together.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for k in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[k]
        left, copies = min(counts[length], room // length), 1
        while left:
            copies = min(copies, left)
            new = (reach | reach << length * copies) & full
            if new != reach:
                steps.append((length, copies, reach))
                reach = new
            left -= copies
            copies *= 2
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> total & 1:
            total -= length * copies
            chosen[length] = chosen.get(length, 0) + copies
    return chosen


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, {length: pieces in each}) for all pieces.

    Each step gives the longest piece left a bin, and finds the fullest feasible
    combination for the rest of it. The same combination is then used as often as there
    are pieces for it; this uses up a length, so the number of steps hangs on the number
    of different lengths, not of pieces.
    """
    counts = {int(k): int(v) for k, v in histogram.items() if v > 0}
    lengths, out = sorted(counts), []
    while lengths:
        longest = lengths[-1]
        counts[longest] -= 1
        chosen = fullest(lengths, counts, capacity - longest)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in chosen.items())
        out.append((times, chosen))
        for k, n in chosen.items():
            counts[k] -= times * n
        if any(not counts[k] for k in chosen):
            lengths = [k for k in lengths if counts[k]]
    return out


def pack(cut_pieces: DataFrame, *, limit: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to written pieces; drops part and rank.

    The driver sees one count for each length, ``limit`` at most, and solves the bins as
    combinations of lengths. Pieces of one length are alike to it, so the k-th piece of a
    length takes the k-th place for it: ranks within tasks, plus the counts of the tasks
    before, number the pieces without a shuffle of a whole length to one task. Sequences
    have no gaps, offsets start at 0. Empty input: no rows. Extra columns are carried.
    """
    histogram = cut_pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = cut(histogram)
    counts = {r[0]: r[1] for r in histogram.groupBy("length").agg(F.sum("n")).collect()}
    keys, base, copies, offsets, first = [], [], [], [], 0
    taken: dict[int, int] = {}
    for times, chosen in minimum_bin_slack(counts, limit):
        at = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            keys.append((length << 48) | taken.get(length, 0))
            base.append(first)
            copies.append(n)
            offsets.append(at)
            taken[length] = taken.get(length, 0) + times * n
            at += n * length
        first += times
    order = np.argsort(np.array(keys, np.int64)) if keys else np.zeros(0, np.int64)
    key, base, copies, offsets = (np.array(x, np.int64)[order] for x in (keys, base, copies, offsets))

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = histogram.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = cut_pieces.join(starts, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")
    schema = ", ".join(f"`{n}` {t}" for n, t in numbered.drop("rank").dtypes) + ", sequence_id long, offset long"
    names = numbered.drop("rank").columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch.column(batch.schema.get_field_index("length")), np.int64)
            rank = np.asarray(batch.column(batch.schema.get_field_index("rank")), np.int64)
            k = np.searchsorted(key, (length << 48) | rank, "right") - 1
            nth = rank - (key[k] & ((1 << 48) - 1))
            made = [pa.array(base[k] + nth // copies[k]), pa.array(offsets[k] + nth % copies[k] * length)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], *made], names=[*names, "sequence_id", "offset"])

    return map_batches(numbered, place, schema)


def tokenize_and_pack(docs: DataFrame, tokenizer: str | None = None, *, limit: int = 4096, **options) -> DataFrame:
    """Token pieces of all docs in sequences of at most ``limit`` ids.

    Null, empty or blank texts are one piece of the end id; repeated rows and ids are
    pieces of their own; null ids are carried. Other columns are not read.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(cut(pieces(docs, tokenizer, limit=limit, **options)), limit=limit)


def op4(spark, sf_dir: str) -> DataFrame:
    """Registered query: all ``documents``."""
    return tokenize_and_pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
