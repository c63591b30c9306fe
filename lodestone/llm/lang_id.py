"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier per bit, over hashed byte n-grams of the lower-cased text, predicts that
bit; decoding takes the codeword with the least weighted loss, and a runner-up that is nearly as close flags ambiguity.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import LOWER, at_most, below_fraction, held_out, texts_of

UNDETERMINED = "und"
#: Bound on the training rows, over all languages. What the driver gets of each is one vector of BUCKETS half floats.
TRAIN_ROWS = 2400
BUCKETS = 1 << 12
ORDERS = (2, 3)
#: How sharply a codeword's loss lowers its share of confidence. It changes no prediction; at 6 the mean score of held-out
#: documents is about the share of them that are right.
SHARPNESS = 6.0
#: The runner-up's share of the best one's confidence from which on a prediction is told as ambiguous.
AMBIGUOUS = 0.7
#: The score from which on a text's language overrules the lang it bears. Below, as of texts in two languages by halves, lang stays.
CORRECTED = 0.9
_PIECE = 1 << 18


@dataclass(frozen=True)
class Coder:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit; sums to 1


def codewords(n: int) -> np.ndarray:
    """Every split of n languages in two for n <= 5; else random words, of many drawn those whose nearest pair is farthest apart."""
    if n < 2:
        return np.ones((n, 1), np.float32)
    if n <= 5:
        splits = [(1, *rest) for rest in itertools.product((-1, 1), repeat=n - 1) if -1 in rest]
        return np.array(splits, np.float32).T
    rng, bits = np.random.default_rng(5), int(np.ceil(10 * np.log2(n)))
    drawn = (rng.choice(np.array([-1, 1], np.float32), (n, bits)) for _ in range(200))
    return max(drawn, key=lambda c: (bits - (c @ c.T - 2 * bits * np.eye(n, dtype=np.float32))).min() / 2)


def _grams(raw: np.ndarray, order: int) -> np.ndarray:
    value = np.full(len(raw) - order + 1, order, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(order):
            value = (value ^ raw[i : len(raw) - order + 1 + i]) * np.uint32(0x9E3779B1)
            value ^= value >> np.uint32(15)
    return value % np.uint32(BUCKETS)


def counts_of(text: bytes) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole text."""
    raw = LOWER[np.frombuffer(text, np.uint8)]
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(raw), _PIECE):
        for order in ORDERS:
            piece = raw[at : at + _PIECE + order - 1]
            if len(piece) >= order:
                total += np.bincount(_grams(piece, order), minlength=BUCKETS)
    return total


def _scaled(counts: np.ndarray) -> np.ndarray:
    root = np.sqrt(counts.astype(np.float32))
    return root / np.maximum(np.sqrt((root * root).sum(axis=-1, keepdims=True)), 1e-6)


def fit(x: np.ndarray, langs: list[str], steps: int = 200) -> Coder:
    """Learns from scaled counts and their languages: logistic classifiers, balanced by language, by accelerated gradient descent."""
    languages = tuple(sorted(set(langs)))
    code = codewords(len(languages))
    if len(languages) < 2:
        return Coder(languages, code, np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32))
    which = np.array([languages.index(lang) for lang in langs])
    y = code[which]
    share = (1 / np.bincount(which, minlength=len(languages)))[which].astype(np.float32)[:, None] / len(languages)
    w, bias = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    ahead_w, ahead_b = w.copy(), bias.copy()
    for step in range(steps):
        pull = -y / (1 + np.exp(np.clip(y * (x @ ahead_w + ahead_b), -30, 30))) * share
        new_w, new_b = ahead_w - 8 * (x.T @ pull + 1e-5 * ahead_w), ahead_b - 8 * pull.sum(axis=0)
        pace = step / (step + 3)
        ahead_w, ahead_b, w, bias = new_w + pace * (new_w - w), new_b + pace * (new_b - bias), new_w, new_b
    right = ((np.sign(x @ w + bias) == y) * share).sum(axis=0)
    trust = np.maximum(right - 0.5, 0.01)
    return Coder(languages, code, w, bias, (trust / trust.sum()).astype(np.float32))


def decode(coder: Coder, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of counts the index of the nearest codeword, its share of confidence, and whether the runner-up is close."""
    margin = _scaled(counts) @ coder.weights + coder.bias
    loss = (np.logaddexp(0, -margin[:, None, :] * coder.code[None]) * coder.trust).sum(axis=2)
    near = np.exp(-SHARPNESS * (loss - loss.min(axis=1, keepdims=True)))
    near /= near.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    score = near[np.arange(len(best)), best]
    second = np.sort(near, axis=1)[:, -2] if near.shape[1] > 1 else np.zeros(len(best))
    return best, score, second > AMBIGUOUS * score


def _predict(coder: Coder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_pylist()
            lang, score, unsure = [UNDETERMINED] * len(column), np.zeros(len(column)), np.zeros(len(column), bool)
            raw = texts_of(column)
            todo = [i for i, ok in enumerate(lettered) if ok and coder.languages]
            for at in range(0, len(todo), 256):
                part = todo[at : at + 256]
                best, sure, close = decode(coder, np.stack([counts_of(raw[i]) for i in part]))
                score[part], unsure[part] = sure, close
                for i, b in zip(part, best, strict=True):
                    lang[i] = coder.languages[b]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang), pa.array(score), pa.array(unsure)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return run


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lettered = pc.match_substring_regex(batch.column(0), r"\p{L}")
        batch = batch.filter(lettered)
        vectors = [_scaled(counts_of(text)).astype(np.float16).tobytes() for text in texts_of(batch.column(0))]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(vectors, pa.binary())], ["lang", "drawn", "vector"])


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Coder:
    """Learns from at most ``rows`` documents (one of each lang at least) with a lang and letters, none of them held out.

    Each lang has an even share of ``rows``; of its documents some are taken by hashes of doc_id and text, the same ones each
    time, and of equal hashes those whose vectors sort first. Whole texts are counted, on the executors.
    """
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit(np.zeros((0, BUCKETS), np.float32), [])
    each = max(1, rows // len(sizes))
    # somewhat more than the share is read, as the hash does not fall evenly and texts without letters go
    chosen = functools.reduce(operator.or_, ((F.col("lang") == lang) & below_fraction(["doc_id", "text"], 100 + 2 * each, n, "lang") for lang, n in sorted(sizes.items())))
    drawn = usable.where(chosen).select("text", "lang", F.xxhash64(F.lit("lang"), "doc_id", "text").alias("drawn"))
    vectors = drawn.mapInArrow(_vectors, "lang string, drawn long, vector binary")
    found = at_most(vectors, "lang", dict.fromkeys(sizes, each), ["drawn", "vector"]).collect()
    found = sorted(found, key=lambda r: (r["lang"], r["drawn"], bytes(r["vector"])))
    x = np.array([np.frombuffer(r["vector"], np.float16) for r in found], np.float32).reshape(-1, BUCKETS)
    return fit(x, [r["lang"] for r in found])


def identify(docs: DataFrame, coder: Coder) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1), ambiguous for each row of ``docs``, from its whole text alone.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing was learned. Ties between
    codewords go to the language that sorts first. Rows that repeat each return a row; only doc_id and text are read.
    """
    schema = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(_predict(coder), schema)


def keep_identified(docs: DataFrame, coder: Coder) -> DataFrame:
    """``docs`` without rows whose text is null or has no letter, and with ``lang`` as identified.

    A null ``lang`` is filled with the predicted one; one that was learned is corrected where the text says another with a
    score of ``CORRECTED`` or more. A lang that was not learned stays, as no text can be predicted to be in it; so does every
    lang, nulls too, if nothing was learned.
    """
    schema = docs.schema
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, text = names.index("lang"), names.index("text")
        blank = np.zeros(1, bool)
        for batch in batches:
            inner = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), batch.column(text), pa.array(np.repeat(blank, len(batch)))], ["doc_id", "text", "held_out"])
            lettered = pc.fill_null(pc.match_substring_regex(batch.column(text), r"\p{L}"), False)
            for said in _predict(coder)([inner]):
                lang = batch.column(at)
                if coder.languages:
                    wrong = pc.and_(pc.is_in(lang, pa.array(coder.languages, lang.type)), pc.greater_equal(said.column("score"), CORRECTED))
                    lang = pc.if_else(wrong, said.column("lang_pred"), pc.coalesce(lang, said.column("lang_pred")))
                columns = [lang if i == at else batch.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(lettered)

    return docs.mapInArrow(run, schema)
