"""Token counts of a unigram tokenizer, without its tokens.

An Aho-Corasick automaton lists all vocabulary pieces that end at each character of a word; dynamic programming keeps, for each
place, the best score and the number of pieces on the path that has it. Ties go as in the tokenizers library's Unigram model:
candidates for a place come by rising start and only a greater score replaces, so the longest last piece wins. Where no piece of
one character starts, that character is unknown with the least score less 10; unknown characters in a row are one token.

The text is cut as by that library's Metaspace pre-tokenizer: blanks become U+2581, one is put first if missing, and each starts
a word. Word results are kept, up to KEPT of them in a worker, so each distinct word is settled about once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
UNKNOWN_PENALTY = 10.0
KEPT = 400_000


def read_pieces(path: str = PIECES) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model, without its control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.IsControl, model.IsUnknown, model.IsByte, model.IsUnused)
    return [(model.IdToPiece(i), model.GetScore(i)) for i in range(model.GetPieceSize()) if not any(f(i) for f in special)]


class Counting:
    """Counts for one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.kept: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """(number of tokens, best score) of one word."""
        n = len(word)
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)
        lost = [False] * (n + 1)
        known = [False] * (n + 1)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, (length, score) in self.automaton.iter(word) if len(self.automaton) else ():
            ending[end + 1].append((end + 1 - length, score))
            if length == 1:
                known[end] = True
        for end in range(1, n + 1):
            top, start, is_lost = None, end - 1, True
            for begin, score in ending[end]:
                total = best[begin] + score
                if top is None or total > top:
                    top, start, is_lost = total, begin, False
            if not known[end - 1]:
                total = best[end - 1] + self.unknown
                if top is None or total > top:
                    top, start, is_lost = total, end - 1, True
            best[end], lost[end] = top, is_lost
            count[end] = count[start] + (not (is_lost and lost[start]))
        return count[n], best[n]

    def text(self, text: str | None) -> tuple[int, float]:
        """(number of tokens, best score) of a text; (0, 0.0) for an empty or null one."""
        if not text:
            return 0, 0.0
        text = text.replace(" ", BLANK)
        if text[0] != BLANK:
            text = BLANK + text
        tokens, total, kept = 0, 0.0, self.kept
        for word, times in Counter(text.split(BLANK)[1:]).items():
            found = kept.get(word)
            if found is None:
                if len(kept) >= KEPT:
                    kept.clear()
                found = self.word(BLANK + word)
                if len(word) < 64:
                    kept[word] = found
            tokens += times * found[0]
            total += times * found[1]
        return tokens, total


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]] | None = None, path: str = PIECES) -> DataFrame:
    """(doc_id, n_tokens, score) of every row of docs(doc_id, text): tokens of the best segmentation and its score.

    The vocabulary is read on the driver (a tokenizer's size) and sent along. Null and empty texts have no tokens and score 0;
    repeated rows and null ids are each counted; an empty table gives an empty table; other columns are ignored.
    """
    vocabulary = read_pieces(path) if pieces is None else pieces

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(vocabulary)
        for batch in batches:
            found = [counting.text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "n_tokens", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(rows, "doc_id long, n_tokens long, score double")
