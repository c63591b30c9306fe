"""Spelling variants: words one edit apart, found by Aho-Corasick over the halves of words.

Every word is cut into two segments. An edit touches one of them, so of two words one edit apart, the longer one (of equally
long ones, the later) holds a whole segment of the other: its first at the start, or its second at the end. Words are dealt by
length and hash to shards, and a shard's automaton holds both segments of all its words. All words are scanned in blocks by the
shards of their own length and the length below; a match counts if its place and the two lengths agree, and then the distance is
verified. A segment that many words of a shard share leads to their other halves by what remains when one code point is
struck out, so that a scan never walks a long list. A pair meets in one shard and one block, and a task sends for each word
how many near words it found and the best of them, never the pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import Scratch, texts_of

#: Words of a shard, and words scanned at once; both bound a task's memory.
SHARD, BLOCK = 100_000, 200_000
#: Lengths from here on share their shards, so that the number of kinds of shards is bounded.
LONGEST_BAND = 64
#: Of a longer segment the automaton holds so many code points; the distance is verified on whole words.
SEGMENT = 64
#: A longer list of words that share a segment is searched by their other halves.
SHORT_LIST = 16
#: Words up to this length are in that index, as an index of a word takes the square of its length.
INDEXED = 256
#: Different words that a task counts before it sends their counts on.
COUNTED = 300_000
_PIECE = 1 << 20

LETTERS = "A-Za-zÀ-ÿ"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _pieces(text: str) -> Iterator[str]:
    """A text in parts of about a million code points that cut no run of letters."""
    other, at = re.compile(f"[^{LETTERS}]"), 0
    while at < len(text):
        found = other.search(text, at + _PIECE)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def _counts(least: int, misspell: int):
    run_of_letters = re.compile(f"[{LETTERS}]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            kept = {w: n for w, n in total.items() if n and len(w) >= least}
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(kept.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                if not raw:
                    continue
                words: Counter[str] = Counter()
                for piece in _pieces(raw.translate(_LOWER).decode()):
                    words.update(run_of_letters.findall(piece))
                total.update(words)
                if misspell:
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in words.items():
                        h = zlib.crc32(word.encode(), start)
                        if h % misspell == 0:
                            at = h % len(word)
                            total[word] -= n
                            total[word[:at] + word[at + 1 :]] += n
                if len(total) >= COUNTED:
                    yield flush()
        yield flush()

    return run


def word_counts(docs: DataFrame, least: int = 7, misspell: int = 0) -> DataFrame:
    """word and n: how often each word of ``least`` code points or more occurs in all texts.

    A word is a maximal run of ASCII letters and U+00C0 to U+00FF; only A-Z is lower-cased. With ``misspell`` some runs lose a code
    point, the same ones each time: h being the crc32 of "doc_id:run", the one at h mod its length, where ``misspell`` divides h
    (a null doc_id is empty there). A null text has no words; repeated rows count each for itself.
    """
    parts = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(_counts(least, misspell), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)  # a[:low] is the longest common start
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


class Halves:
    """An automaton over the two segments of every word of a shard."""

    def __init__(self, words: list[str]):
        import ahocorasick

        self.words = words
        # (segment, which half, length of the word) to the words that have it
        self.owners: dict[tuple[str, int, int], list[int]] = defaultdict(list)
        self.indexes: dict[tuple[str, int, int], dict[str, list[int]]] = {}
        self.automaton = ahocorasick.Automaton()
        for i, word in enumerate(words):
            half = len(word) // 2
            for side, segment in enumerate((word[:half][:SEGMENT], word[half:][:SEGMENT])):
                self.owners[segment, side, len(word)].append(i)
                self.automaton.add_word(segment, segment)
        self.automaton.make_automaton()

    def near(self, word: str) -> set[int]:
        """Words of the shard one edit from ``word`` that are shorter, or as long and smaller."""
        out: set[int] = set()
        size, owners = len(word), self.owners
        for end, segment in self.automaton.iter(word):
            start = end + 1 - len(segment)
            for length in (size - 1, size):
                if start == 0 and (key := (segment, 0, length)) in owners:
                    out.update(self._verified(key, word, word[length // 2 :]))
                if start == size - (length - length // 2) and (key := (segment, 1, length)) in owners:
                    out.update(self._verified(key, word, word[:start]))
        return out

    def _verified(self, key: tuple[str, int, int], word: str, other: str) -> Iterator[int]:
        for i in self._candidates(key, len(word), other):
            mine = self.words[i]
            if (len(mine) < len(word) or mine < word) and one_edit(mine, word):
                yield i

    def _candidates(self, key: tuple[str, int, int], size: int, other: str) -> list[int]:
        """Words that share the segment ``key``; of many, those whose other half may be one edit from ``other``."""
        shared, (_, side, length) = self.owners[key], key
        if len(shared) <= SHORT_LIST or length > INDEXED:
            return shared
        if key not in self.indexes:
            index: dict[str, list[int]] = defaultdict(list)
            for i in shared:
                mine = self.words[i][: length // 2] if side else self.words[i][length // 2 :]
                index[mine].append(i)
                for at in range(len(mine)):
                    index[f"{mine[:at]}\0{mine[at + 1 :]}"].append(i)
            self.indexes[key] = dict(index)
        index, blank = self.indexes[key], "\0" if length == size else ""
        return [i for at in range(len(other)) for i in index.get(f"{other[:at]}{blank}{other[at + 1 :]}", ())]


def _meet(shard: pa.Table, block: pa.Table) -> pa.Table:
    """For each word of both sides that has near words across them: how many, and the best."""
    found: dict[str, list] = {}

    def note(word: str, other: str, n: int) -> None:
        held = found.setdefault(word, [0, 0, ""])
        held[0] += 1
        if n > held[1] or n == held[1] and other < held[2]:
            held[1:] = n, other

    if len(shard) and len(block):
        words, counts = shard["word"].to_pylist(), shard["n"].to_pylist()
        halves = Halves(words)
        for scanned in block.to_batches(8192):
            for word, n in zip(scanned["word"].to_pylist(), scanned["n"].to_pylist(), strict=True):
                for i in halves.near(word):
                    note(word, words[i], counts[i])
                    note(words[i], word, n)
    return pa.table([pa.array(found, pa.string()), *(pa.array([v[i] for v in found.values()], _NEAR.field(i + 1).type) for i in range(3))], schema=_NEAR)


def near_words(words: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``words`` has different words of two code points or more and their n; it is read three times, so a written table is best.

    Returns for every word that has near words (one edit apart) n_near, how many, and best and best_n, the one of largest n, ties
    by code points.
    """
    band = F.least(F.length("word"), F.lit(LONGEST_BAND))
    sizes = {r["band"]: r["n"] for r in words.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return words.select("word", F.col("n").alias("n_near"), F.col("n").alias("best_n"), F.col("word").alias("best")).where(F.lit(False))

    def parts(most: int, of: Column) -> Column:
        each = F.create_map(*(F.lit(x) for b, n in sizes.items() for x in (b, -(-n // most))))
        return F.coalesce(F.element_at(each, of), F.lit(0))

    def dealt(most: int, seed: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "word"), parts(most, band)).cast("int")

    def each(bands: Column, most: int, one: str, two: str) -> Column:
        """A row for every part of each of the bands."""
        some = F.filter(bands, lambda b: parts(most, b) > 0)
        return F.explode(F.flatten(F.transform(some, lambda b: F.transform(F.sequence(F.lit(0), parts(most, b) - 1), lambda i: F.struct(b.alias(one), i.alias(two))))))

    # a band's shards meet the words of that band and of the next
    keys = ["held", "shard", "scanned", "block"]
    above = F.array_distinct(F.array(band, F.least(band + 1, F.lit(LONGEST_BAND))))
    below = F.array(band, band - 1)
    left = words.select(band.alias("held"), dealt(shard, "shard").alias("shard"), each(above, block, "scanned", "block").alias("to"), "word", "n").select("held", "shard", "to.*", "word", "n")
    right = words.select(band.alias("scanned"), dealt(block, "block").alias("block"), each(below, shard, "held", "shard").alias("to"), "word", "n").select("to.*", "scanned", "block", "word", "n")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meet, "word string, n_near long, best_n long, best string")
    best = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first"))
    return best.select("word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``forms`` has word and form without cycles; word and root, the last of the forms that follow from it. Each round doubles the way."""
    now = scratch.table(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.where("moved").isEmpty():
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = scratch.table(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return now.drop("moved")


def variants(docs: DataFrame, least: int = 7, min_count: int = 2, ratio: int = 10, misspell: int = 0) -> DataFrame:
    """Words of ``least`` code points or more that occur ``min_count`` times or more, grouped as spellings of one another.

    A word's form is its near word (one code point inserted, deleted or replaced) of largest n, ties by code points, if that n is
    at least ``ratio`` (2 or more) times its own; its root follows forms to the last. Words, null texts and ``misspell`` are as in
    ``word_counts``; no words, no rows. Returns word, form, root, n, n_near, form_n.
    """
    if ratio < 2 or least < 2:
        raise ValueError("ratio and least are at least 2")
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.table(word_counts(docs, least, misspell).where(F.col("n") >= min_count), "words")
    near = scratch.table(near_words(words), "near")
    takes = F.col("best_n") >= ratio * F.col("n")
    told = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n"))
    root = roots(told.where("form IS NOT NULL"), scratch)
    return told.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
