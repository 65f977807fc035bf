"""Token counts without token lists: Viterbi over the matches of an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from larkspur.llm.common import Memo, pieces_of, slices, sums

SCHEMA = "doc_id long, n_tokens long, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])
#: Fixed values of the unigram tokenizer: the mark for a blank, and what an unknown character costs below the lowest score.
BLANK, UNKNOWN_PENALTY = "▁", 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def word_counter(pieces: list[tuple[str, float]]) -> Callable[[str], tuple[int, float]]:
    """The number of pieces and the score of the best segmentation of one word.

    Tie rule of the tokenizer: of segmentations with equal scores up to a place, the one whose
    last piece begins first (is longest) stays; an unknown character is tried after them, only
    where no one-character piece fits, and counts as its bytes if the vocabulary has all byte
    pieces, else once for a run of them.
    """
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for piece, score in pieces:
        automaton.add_word(piece, (len(piece), score))
    automaton.make_automaton()
    names = {p for p, _ in pieces}
    by_byte = all(f"<0x{b:02X}>" in names for b in range(256))
    unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY

    matches = automaton.iter

    def count(word: str) -> tuple[int, float]:
        n = len(word)
        best, number, was_unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        top, pieces, single, at = None, 0, False, 1

        def settle(end: int, top: float | None, pieces: int, single: bool) -> None:
            """The unknown character competes last, where no one-character piece ends."""
            if not single and (top is None or unknown + best[end - 1] > top):
                top = unknown + best[end - 1]
                pieces = number[end - 1] + (len(word[end - 1].encode()) if by_byte else 1 - was_unknown[end - 1])
                was_unknown[end] = True
            best[end], number[end] = top, pieces

        for end, (length, score) in matches(word):  # by end, and longest first
            while at <= end:
                settle(at, top, pieces, single)
                top, single, at = None, False, at + 1
            begin = end + 1 - length
            score += best[begin]
            if top is None or score > top:
                top, pieces = score, number[begin] + 1
            if length == 1:
                single = True
        while at <= n:
            settle(at, top, pieces, single)
            top, single, at = None, False, at + 1
        return number[n], best[n]

    return count


@lru_cache(maxsize=2)
def remembered_words(model: str) -> Memo:
    """Count and score by word, kept for all tasks of a worker."""
    count = word_counter(vocabulary(model))
    return Memo(lambda word: count(BLANK + word), 500_000)


def token_counts(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text under a unigram tokenizer with the pieces and scores of ``model``.

    Blanks become the mark, the text gets one in front, and words begin at marks (no piece
    crosses into the next word), so the count of a text is the sum over its words and each
    distinct word is segmented once per worker. No shuffle. Returns doc_id, n_tokens and the
    total score. Null or empty text: 0 tokens, score 0. Null and repeated ids stay row by row;
    other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = remembered_words(model)
        for batch in slices(batches):
            texts = pc.replace_substring(pc.fill_null(batch.column("text"), ""), BLANK, " ")
            number, bounds, words = pieces_of(pc.split_pattern(texts, " "))
            found = np.array([seen[w] for w in words.to_pylist()], dtype=np.float64).reshape(-1, 2)[number]
            # What stands before a leading blank is no word, nor is an empty text.
            found[bounds[:-1][np.asarray(pc.or_(pc.starts_with(texts, " "), pc.equal(texts, "")))]] = 0.0
            tokens, scores = sums(found, bounds).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens.astype(np.int64)), pa.array(scores)], schema=_ARROW)

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, SCHEMA)
