"""Token counts without tokens: a Viterbi pass over a unigram vocabulary that keeps scores and counts only.

An Aho-Corasick automaton lists every vocabulary piece in a text; dynamic programming over end positions carries the best
score and the pieces used. Tie rules are the unigram tokenizer's: starts in ascending order, a later one replaces an earlier
one only if its score is strictly higher; a character that is no piece costs 10 more than the worst piece and counts its
UTF-8 bytes (byte fallback).

No piece holds a space mark after another character, so no piece crosses the border between a word and a following space
mark: the best path of a text is the best paths of its words, and each distinct word is worked out once.
"""

from __future__ import annotations

import functools
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct words a worker remembers.
MEMORY = 400_000


class Counter:
    """Counts for one vocabulary of (piece, score)."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.pieces = dict(reversed(pieces))  # the first of equal pieces counts
        self.unknown = min(self.pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.pieces), default=1)
        self.splits = all(MARK not in p.lstrip(MARK) for p in self.pieces)
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        if self.pieces:
            self.automaton.make_automaton()
        self.known: OrderedDict[str, int] = OrderedDict()

    def path(self, text: str) -> int:
        """Pieces on the best path over the whole of ``text``."""
        size, total = self.longest + 1, len(text)
        # scores and counts of the last ends, as far back as a piece reaches
        best, used = [0.0] * size, [0] * size
        matches = self.automaton.iter(text) if self.pieces else iter(())
        end, match = next(matches, (total, None))
        for here in range(1, total + 1):
            top, count, single = None, 0, False
            while end == here - 1 and match:  # the longest piece first, so starts come in ascending order
                length, score = match
                single |= length == 1
                start = (here - length) % size
                if top is None or best[start] + score > top:
                    top, count = best[start] + score, used[start] + 1
                end, match = next(matches, (total, None))
            if not single:
                start = (here - 1) % size
                if top is None or best[start] + self.unknown > top:
                    top, count = best[start] + self.unknown, used[start] + len(text[here - 1].encode())
            best[here % size], used[here % size] = top, count
        return used[total % size]

    def word(self, text: str) -> int:
        count = self.known.get(text)
        if count is None:
            count = self.path(text)
            if len(text) <= 64:
                if len(self.known) >= MEMORY:
                    for _ in range(MEMORY // 4):
                        self.known.popitem(last=False)
                self.known[text] = count
        return count

    def text(self, text: str | None) -> int:
        """Tokens of a text: a space mark before it and for each space; nothing for an empty text."""
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if not self.splits:
            return self.path(marked)
        return sum(self.word(w) for w in words_of(text))


def words_of(text: str) -> list[str]:
    """The marked text cut before each mark that follows another character."""
    out, pending = [], MARK
    for part in text.replace(MARK, " ").split(" "):
        if part:
            out.append(pending + part)
            pending = MARK
        else:
            pending += MARK
    # the last part has no space after it
    if pending != MARK:
        out.append(pending[:-1])
    return out


def unigram_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, without its unknown, control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda i: model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size()) if not skip(i)]


@functools.lru_cache(2)
def _counter(path: str) -> Counter:
    return Counter(unigram_pieces(path))


def count_batch(counter: Counter, column: pa.Array) -> np.ndarray:
    """Counts of many texts; each distinct word of the batch is looked up once."""
    column = pc.fill_null(column, "")
    if not counter.splits:
        return np.array([counter.text(t) for t in column.to_pylist()], np.int64)
    plain = pc.invert(pc.match_substring_regex(column, "  |^ | $|" + MARK)).to_numpy(zero_copy_only=False)
    total = np.zeros(len(column), np.int64)
    for i in np.flatnonzero(~plain):
        total[i] = counter.text(column[int(i)].as_py())
    rows = np.flatnonzero(plain & (pc.binary_length(column).to_numpy(zero_copy_only=False) > 0))
    for at in range(0, len(rows), 512):
        part = rows[at : at + 512]
        lists = pc.split_pattern(column.take(pa.array(part)), " ")
        coded = pc.dictionary_encode(lists.flatten())
        counts = np.array([counter.word(MARK + w) for w in coded.dictionary.to_pylist()], np.int64)
        starts = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))[:-1]
        total[part] = np.add.reduceat(counts[coded.indices.to_numpy()], starts)
    return total


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count_batch(counter, batch.column(1)))], ["doc_id", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and n_tokens (long) of each row of ``docs``, over its whole text.

    A null or empty text has 0 tokens. Rows that repeat each return a row; only doc_id and text are read; nothing is shuffled.
    """
    return docs.select("doc_id", "text").mapInArrow(_count(model_path), "doc_id long, n_tokens long")
