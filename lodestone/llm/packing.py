"""Packing examples into training sequences as vector bins.

A piece is a run of one document's ids and has a size in three dimensions: tokens, one segment, and loss-bearing tokens. The
open sequence takes, again and again, the waiting piece that fits and whose size has the largest dot product with the room
left, each dimension counted as a share of its limit. What fits nowhere is cut to the room left, so that no padding remains
but at the very end, where the last ids go to sequences of a power of two.

A task reads its rows once, in a stream, with a bounded number of waiting pieces. Nothing is shuffled, so a lost executor
repeats its own tasks only, and a sequence's id is the task's number and the sequence's number within it. Rows that must not
share a sequence are sorted apart within their task, and the packer finishes before it goes on to the next kind.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 128
    loss: int = 1024
    #: Pieces that wait at once; they bound a task's memory.
    waiting: int = 4096

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss, self.waiting) < 1:
            raise ValueError("tokens, segments, loss and waiting are at least 1")


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    loss: np.ndarray
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.loss[:n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[n:], self.loss[n:], self.doc_tokens)


    def joined(self, rest: Piece) -> Piece:
        """This piece and the one that was cut off behind it."""
        return Piece(self.doc_id, self.start, np.concatenate([self.ids, rest.ids]), np.concatenate([self.loss, rest.loss]), self.doc_tokens)


def _fitting(piece: Piece, tokens: int, loss: int) -> int:
    """How many of its first ids fit the room."""
    n = min(tokens, len(piece.ids))
    if int(piece.loss[:n].sum()) <= loss:
        return n
    return int(np.searchsorted(np.cumsum(piece.loss[:n]), loss, side="right"))


def _whole(tokens: int, most: int) -> int:
    """The largest length up to ``tokens`` that takes no padding: ``most`` itself, or a power of two."""
    return tokens if tokens == most else 1 << (tokens.bit_length() - 1)


class Packer:
    """Feeds on documents; gives finished sequences, each a list of pieces.

    Where segments or loss run out before the tokens do, a sequence is closed at the largest power of two that it holds, and what
    lies beyond goes back to the waiting pieces.
    """

    def __init__(self, limits: Limits):
        self.limits = limits
        self.pieces: list[Piece] = []

    def add(self, doc_id: int | None, ids: np.ndarray, loss: np.ndarray) -> Iterator[list[Piece]]:
        piece = Piece(doc_id, 0, ids, loss, len(ids))
        while len(piece.ids) >= self.limits.tokens:
            n = _fitting(piece, self.limits.tokens, self.limits.loss)
            if n < self.limits.tokens:
                break
            whole, piece = piece.cut(n)
            yield [whole]
        while int(piece.loss.sum()) > self.limits.loss or len(piece.ids) > self.limits.tokens:
            part, piece = piece.cut(_fitting(piece, self.limits.tokens, self.limits.loss))
            self.pieces.append(part)
        if len(piece.ids):
            self.pieces.append(piece)
        if len(self.pieces) >= self.limits.waiting:
            yield from self._fill(self.limits.waiting // 8)

    def _fill(self, leave: int) -> Iterator[list[Piece]]:
        """Sequences that the heuristic fills, until few pieces or fewer tokens than one sequence wait."""
        lim = self.limits
        whole = np.array([lim.tokens, lim.segments, lim.loss], float)
        waiting = self.pieces
        sizes = np.array([(len(p.ids), 1, int(p.loss.sum())) for p in waiting], float).reshape(-1, 3)
        free = np.ones(len(waiting), bool)
        while free.sum() > leave and sizes[free, 0].sum() >= lim.tokens:
            room, chosen, places = whole.copy(), [], []
            while room[0] > 0 and room[1] >= 1:
                fits = free & (sizes <= room).all(axis=1)
                if fits.any():
                    worth = (sizes / whole) @ (room / whole)
                    at = int(np.where(fits, worth, -1).argmax())
                    chosen.append(waiting[at])
                    places.append(at)
                    free[at] = False
                    room -= sizes[at]
                    continue
                open_ = np.flatnonzero(free)
                if not len(open_):
                    break
                at = int(open_[sizes[open_, 0].argmax()])
                n = _fitting(waiting[at], int(room[0]), int(room[2]))
                if n == 0:
                    break
                part, waiting[at] = waiting[at].cut(n)
                chosen.append(part)
                places.append(at)
                room -= (n, 1, int(part.loss.sum()))
                sizes[at] = (len(waiting[at].ids), 1, int(waiting[at].loss.sum()))
            over = lim.tokens - int(room[0]) - _whole(lim.tokens - int(room[0]), lim.tokens)
            while over:
                part, at = chosen.pop(), places.pop()
                if len(part.ids) > over:
                    kept, part = part.cut(len(part.ids) - over)
                    chosen.append(kept)
                over -= len(part.ids)
                waiting[at] = part.joined(waiting[at]) if free[at] else part
                free[at] = True
                sizes[at] = (len(waiting[at].ids), 1, int(waiting[at].loss.sum()))
            yield chosen
        self.pieces = [p for p, f in zip(waiting, free, strict=True) if f]

    def finish(self) -> Iterator[list[Piece]]:
        yield from self._fill(0)
        queue, self.pieces = self.pieces[::-1], []
        while queue:
            left = sum(len(p.ids) for p in queue)
            goal = 1 << (min(left, self.limits.tokens).bit_length() - 1)
            chosen, tokens, loss = [], 0, 0
            while queue and tokens < goal and len(chosen) < self.limits.segments:
                piece = queue.pop()
                n = _fitting(piece, goal - tokens, self.limits.loss - loss)
                if n == 0:
                    queue.append(piece)
                    break
                part, rest = piece.cut(n)
                chosen.append(part)
                tokens, loss = tokens + n, loss + int(part.loss.sum())
                if len(rest.ids):
                    queue.append(rest)
            over = tokens - _whole(tokens, self.limits.tokens)
            while over:
                part = chosen.pop()
                if len(part.ids) > over:
                    kept, part = part.cut(len(part.ids) - over)
                    chosen.append(kept)
                over -= len(part.ids)
                queue.append(part)
            yield chosen


def _bytes_of_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable bytes themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: A run of so much white space is encoded apart, as the pattern backtracks in it.
LONG_SPACE = 10_000
#: What ``\s`` stands for in the tokenizer's pattern (fixed values).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _around_spaces(text: str, run: re.Pattern, added: tuple[str, ...]) -> Iterator[tuple[str, bool]]:
    """Parts of a text that are tokenized each for itself as they are together, and whether a part is one long run of white space.

    The tokenizer's pattern takes a run of white space as one, but for its last character where more text follows, which begins
    what comes next. Where an added token follows, the text before it ends.
    """
    at = 0
    for found in run.finditer(text):
        start, end = found.span()
        end -= end < len(text) and not text.startswith(added, end)
        if start > at:
            yield text[at:start], False
        yield text[start:end], True
        at = end
    if at < len(text):
        yield text[at:], False


def byte_bpe(path: str) -> Callable[[str], np.ndarray]:
    """Ids by the byte-level tokenizer in ``path`` (its JSON file), each text closed by id 0.

    The ids are those of the tokenizers library with that file and without special tokens added; strings of the file's added
    tokens that stand in a text are one id each there, and here. The tests hold one library against the other. A file whose
    merges do not make ids in ascending order is refused, as ids stand for the order of merging here.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    added = {t["content"]: t["id"] for t in told["added_tokens"]}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in told["added_tokens"]) or told["normalizer"]:
        raise ValueError("added tokens with options, or a normalizer, are not supported")
    byte = _bytes_of_symbols()
    ranks = {bytes(byte[c] for c in token): number for token, number in told["model"]["vocab"].items() if token not in added}
    made = [told["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in told["model"]["merges"]]
    if any(a >= b for a, b in pairwise(made)):
        raise ValueError("merges that do not make ids in ascending order are not supported")
    if any(re.search(f"[{_SPACE}]", token) for token in added):
        raise ValueError("added tokens with white space are not supported")
    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    of_one = tiktoken.Encoding("one", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
    long_run = re.compile(f"[{_SPACE}]{{{LONG_SPACE},}}")

    def encode(text: str) -> np.ndarray:
        if not text:
            return np.zeros(1, np.uint32)
        parts = [of_one.encode_to_numpy(part) if space else coder.encode_to_numpy(part, allowed_special="all") for part, space in _around_spaces(text, long_run, tuple(added))]
        return np.concatenate([*parts, np.zeros(1, np.uint32)]).astype(np.uint32)

    return encode


_coders: dict[str, Callable[[str], np.ndarray]] = {}


def _rows(sequences: Iterator[list[Piece]], first: int) -> Iterator[tuple]:
    for number, pieces in enumerate(sequences, first):
        offset = 0
        for p in pieces:
            yield p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.doc_tokens, number, offset, int(p.loss.sum())
            offset += len(p.ids)


def _pack(path: str, limits: Limits, loss_after: bool, apart: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _coders:
            _coders[path] = byte_bpe(path)
        encode, packer = _coders[path], Packer(limits)
        number = TaskContext.get().partitionId() << 32

        def sequences() -> Iterator[list[Piece]]:
            kind = None
            for batch in batches:
                prompts = batch.column(2) if loss_after else None
                kinds = batch.column(batch.num_columns - 1).to_pylist() if apart else [None] * len(batch)
                for i in range(len(batch)):
                    if kinds[i] != kind:
                        yield from packer.finish()
                        kind = kinds[i]
                    ids = encode(batch.column(1)[i].as_py() or "")
                    loss = np.ones(len(ids), np.uint8)
                    if prompts is not None:
                        loss[: min(len(ids), max(0, prompts[i].as_py() or 0))] = 0
                    yield from packer.add(batch.column(0)[i].as_py(), ids, loss)
            yield from packer.finish()

        rows: list[tuple] = []
        for row in _rows(sequences(), number):
            rows.append(row)
            if len(rows) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], _NAMES)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], _NAMES)

    return run


def pack(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), prompt_tokens: str | None = None, apart: str | None = None) -> DataFrame:
    """Pieces of all ``docs`` placed in sequences within ``limits``; every id lies in one piece.

    ``docs`` has doc_id and text; with ``prompt_tokens`` that column tells how many of a text's first ids bear no loss (null:
    none). With ``apart`` no sequence holds rows that differ in that column (null is a value of its own), and each value ends in
    sequences of a power of two of its own in every task. A null or empty text is the closing id 0 alone. Rows that repeat are packed each for itself; an empty table gives
    no rows. Texts longer than a sequence are cut. Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    loss_tokens.
    """
    columns = ["doc_id", "text"] + ([F.col(prompt_tokens).cast("long")] if prompt_tokens else [])
    rows = docs.select(*columns)
    if apart:
        rows = docs.select(*columns, F.col(apart).cast("string").alias("apart")).sortWithinPartitions("apart", "doc_id")
    return rows.mapInArrow(_pack(tokenizer_path, limits, prompt_tokens is not None, apart is not None), SCHEMA)
