"""Token counts of a unigram tokenizer by count-only Viterbi."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACE_RUN, Batch, map_batches, slices

#: The mark that unigram vocabularies put before a word.
META = "▁"
#: What an unknown character costs more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Distinct words whose counts a Python worker keeps.
CACHED_WORDS = 250_000
CHUNK = 8 << 20
SPLIT = re.compile(SPACE_RUN)


@dataclass
class Vocabulary:
    """Pieces and scores of a unigram tokenizer; ids are places in the list.

    byte_fallback: an unknown character is as many tokens as it has UTF-8 bytes; otherwise
    neighbouring unknown characters are one token (fuse_unknown) or one each.
    """

    pieces: list[tuple[str, float]]
    unknown: int = 0
    byte_fallback: bool = True
    fuse_unknown: bool = True
    #: what an unknown character scores; None: UNKNOWN_PENALTY less than the worst of all pieces
    unknown_score: float | None = None

    @staticmethod
    def from_piece_model(path: str) -> Vocabulary:
        """The normal pieces and scores of a sentencepiece file, used as a unigram vocabulary."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = lambda i: not (model.is_control(i) or model.is_unused(i) or model.is_byte(i) or model.is_unknown(i))
        pieces = [(model.id_to_piece(i), float(model.get_score(i)) if normal(i) else -1e9) for i in range(model.vocab_size())]
        # such a model takes the worst of its normal pieces
        return Vocabulary(pieces, model.unk_id(), unknown_score=min((s for _, s in pieces if s > -1e9), default=0.0) - UNKNOWN_PENALTY)


class Counter:
    """Piece counts of the best segmentation, without the segmentation.

    An Aho-Corasick automaton gives every piece that ends at a character, longest first.
    The state at each character is the best score and its number of pieces; a match
    replaces it only if its score is strictly higher, so of equal scores the longest last
    piece wins, which is the earliest start in the tokenizer's own order. A character that
    is no piece by itself may also be unknown; that is asked last.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        import ahocorasick

        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        usable = [(p, s) for i, (p, s) in enumerate(vocabulary.pieces) if i != vocabulary.unknown and s > -1e9 and p]
        for piece, score in usable:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in usable if len(p) == 1}
        worst = min((s for _, s in vocabulary.pieces), default=0.0)
        self.unknown_score = worst - UNKNOWN_PENALTY if vocabulary.unknown_score is None else vocabulary.unknown_score
        # a word can be counted by itself if no piece goes on from a word into the next mark
        self.by_word = not any(META in p.lstrip(META) for p, _ in usable)
        self.known: dict[bytes, int] = {}

    def count(self, text: str) -> int:
        """Pieces of a text that has its marks already."""
        n = len(text)
        score, number, fused = [0.0] + [float("-inf")] * n, [0] * (n + 1), [False] * (n + 1)
        at = 0
        matches = self.automaton.iter(text) if len(self.automaton) else iter(())
        item = next(matches, None)
        for end in range(1, n + 1):
            best, pieces, unknown = float("-inf"), 0, False
            while item is not None and item[0] == end - 1:
                size, value = item[1]
                new = score[end - size] + value
                if new > best:
                    best, pieces, unknown = new, number[end - size] + 1, False
                item = next(matches, None)
            sign = text[at]
            if sign not in self.single and score[at] + self.unknown_score > best:
                best, unknown = score[at] + self.unknown_score, True
                if self.v.byte_fallback:
                    pieces = number[at] + len(sign.encode("utf-8", "surrogatepass"))
                else:
                    pieces = number[at] + (0 if fused[at] and self.v.fuse_unknown else 1)
            score[end], number[end], fused[end] = best, pieces, unknown
            at = end
        return number[n]

    def words(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            n = self.known.get(w)
            if n is None:
                n = self.count(META + w.decode("utf-8", "replace"))
                if len(self.known) < CACHED_WORDS:
                    self.known[w] = n
            out[i] = n
        return out

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Counts of whole texts: each run of white space is one mark, none at the ends but one before the text."""
        batch = Batch(texts)
        if not self.by_word:
            split = [[w for w in SPLIT.split(t or "") if w] for t in texts.to_pylist()]
            return np.array([self.count(META + META.join(words)) if words else 0 for words in split], np.int64)
        if not len(batch.start):
            return np.zeros(batch.n, np.int64)
        codes, words = batch.codes()
        doc = np.repeat(np.arange(batch.n), np.diff(batch.first))
        return np.bincount(doc, self.words(words.to_pylist())[codes], batch.n).astype(np.int64)


def token_counts(docs: DataFrame, vocabulary: Vocabulary, *, text_col: str = "text", into: str = "n_tokens") -> DataFrame:
    """All columns of docs, then the number of unigram tokens of text_col.

    A run of U+0020 and U+0009 to U+000D is one word mark; one stands before the first
    word. Texts without a word, empty or null: 0. ``into`` replaces a column of that name.
    Repeated rows are counted alike; texts of any length are counted whole. Empty input:
    no rows. Unknown characters follow ``vocabulary``.
    """
    kept = [c for c in docs.columns if c != into]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the vocabulary's size, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            texts = batch.column(kept.index(text_col))
            for a, b in slices(texts, CHUNK):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counter.texts(texts[a:b]))], names=[*kept, into])

    rows = docs.select(*kept)
    return map_batches(rows, run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", `{into}` long")


def op2(spark, sf_dir: str) -> DataFrame:
    """Registered query: every whole text of ``documents``, under the pieces of piece_bpe_32k.model as a unigram vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, Vocabulary.from_piece_model(public_tokenizers.path("piece_bpe_32k.model"))).drop("text")
