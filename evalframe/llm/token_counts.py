"""Operator 10: token counts by a count-only Viterbi over a unigram vocabulary.

Words (``[^\\x20\\x09-\\x0D]+``, led by U+2581 unless they start with one) are segmented into the pieces
with the greatest sum of scores.  An Aho-Corasick automaton lists all vocabulary matches
of a word, end by end and longest first; dynamic programming keeps the best score and the
number of pieces at each place and nothing else.  The tie rules are those of the unigram
model of the ``tokenizers`` library: a later start must score strictly more; a character
without a piece of its own costs the lowest score minus 10; such characters become their
UTF-8 bytes (``byte_fallback``) or, if not, one unknown piece for each run.

The vocabulary comes from a sentencepiece file (a parameter; nothing is trained); its
scores are used as they stand.  No piece holds U+2581 after another character, so words
are independent, and a worker remembers the counts of the words it has met (at most
``limit`` at a time).

Defined results: null and empty texts have no words, no tokens and score 0; every row
returns a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.shared import text_chunks

LIMIT = 1 << 20
MARK = "▁"
UNKNOWN_PENALTY = 10.0


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file, without unknown and control pieces and
    without runs of the mark, which no word holds."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())
            if not (m.is_unknown(i) or m.is_control(i) or MARK in m.id_to_piece(i)[1:])]


class PieceCounts(dict):
    """UTF-8 word -> (pieces, score of the best segmentation)."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, limit: int = LIMIT) -> None:
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.byte_fallback, self.limit = byte_fallback, limit

    def viterbi(self, word: str) -> tuple[int, float]:
        best, count, loose = [0.0], [0], [False]  # for each settled place of the word
        single = True  # the last place was reached by a piece of one character

        def unknown(end: int) -> None:
            """A character without a piece of its own may end here."""
            s = best[end - 1] + self.unknown
            if end == len(best) or s > best[end]:
                more = len(word[end - 1].encode("utf-8", "replace")) if self.byte_fallback else int(not loose[end - 1])
                best[end:], count[end:], loose[end:] = [s], [count[end - 1] + more], [True]

        for last, (length, score) in self.automaton.iter(word):
            end = last + 1
            if end == len(best) and single:
                best.append(best[end - length] + score)
                count.append(count[end - length] + 1)
                loose.append(False)
                single = length == 1
                continue
            if end >= len(best):
                if not single:
                    unknown(len(best) - 1)
                while len(best) < end:
                    unknown(len(best))
                best.append(best[end - length] + score)
                count.append(count[end - length] + 1)
                loose.append(False)
                single = False
            else:
                s = best[end - length] + score
                if s > best[end]:
                    best[end], count[end], loose[end] = s, count[end - length] + 1, False
            single = single or length == 1
        if not single:
            unknown(len(best) - 1)
        while len(best) <= len(word):
            unknown(len(best))
        return count[-1], best[-1]

    def __missing__(self, word: bytes) -> tuple[int, float]:
        if len(self) > self.limit:
            self.clear()
        text = word.decode("utf-8", "replace")
        self[word] = got = self.viterbi(text if text.startswith(MARK) else MARK + text)
        return got

    def count(self, text: bytes) -> tuple[int, int, float]:
        """(words, pieces, score) of a text."""
        words = text.split()
        if not words:
            return 0, 0, 0.0
        pieces, scores = zip(*map(self.__getitem__, words))
        return len(words), sum(pieces), float(sum(scores))


_open: dict[tuple, PieceCounts] = {}


def token_counts(docs: DataFrame, vocabulary: str | None = None, byte_fallback: bool = True) -> DataFrame:
    """(doc_id, n_words, n_tokens, score) of each row."""
    path = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, byte_fallback) not in _open:
            _open[path, byte_fallback] = PieceCounts(read_vocabulary(path), byte_fallback)
        model = _open[path, byte_fallback]
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for first, texts in text_chunks(batch):
                words, pieces, scores = zip(*map(model.count, texts))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(texts)), pa.array(words, pa.int64()), pa.array(pieces, pa.int64()),
                     pa.array(scores, pa.float64())], ["doc_id", "n_words", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        count, "doc_id long, n_words long, n_tokens long, score double")
