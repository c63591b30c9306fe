"""Text quality by a generalised additive model with pairwise interactions.

A text is described by counts-and-shares features, read from its bytes. Boosting visits the features in turn, round after
round: each visit fits one shallow tree (up to four leaves over the feature's bins) to the residuals and adds it, shrunk, to
that feature's lookup table. Then the pairs of features that lower the loss most get tables of their own in the same way.
A score is the sum of the bins that a text falls in.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import SPACES, at_most, below_fraction, held_out, shingle_set, texts_of, word_hashes

#: Bound on the labelled rows that training reads; the driver gets their features, not their texts.
TRAIN_ROWS = 20_000
BINS, COARSE, PAIRS = 48, 8, 10
THRESHOLD = 0.3
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper_share", "digit_share", "symbol_share", "pipe_share", "stop_share", "comma_share", "shout_share",
    "other_share", "distinct_words", "same_as_before", "distinct_triples", "line_words", "distinct_lines", "short_words", "long_words", "tail_share", "repeat_top",
)

_CLASS = np.zeros(256, np.int64)
_CLASS[65:91], _CLASS[48:58], _CLASS[97:123], _CLASS[list(b" \t\n\r\x0b\x0c")] = 1, 2, 3, 4
_CLASS[list(b"#$%&*+/<=>@\\^_`{}~[]()")], _CLASS[ord("|")], _CLASS[list(b".;:?")], _CLASS[ord(",")], _CLASS[ord("!")] = 5, 6, 7, 8, 9
_CLASS[128:] = 10
_NEWLINES = np.zeros(256, bool)
_NEWLINES[10] = True


def features_of(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    n = max(len(raw), 1)
    share = np.bincount(_CLASS[raw], minlength=11) / n
    words = word_hashes(text)
    m = max(len(words), 1)
    lines = word_hashes(text, _NEWLINES)
    spaced = SPACES[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], spaced, [True]]).astype(np.int8)))
    sizes = edges[1::2] - edges[::2]
    _, often = np.unique(words, return_counts=True) if len(words) else (words, np.zeros(1, int))
    triples = shingle_set(words, 3)
    ends = raw[edges[1::2] - 1] if len(edges) else raw[:0]
    return np.array([
        np.log1p(len(raw)), np.log1p(len(words)), sizes.mean() if len(sizes) else 0, share[1], share[2], share[5], share[6], share[7], share[8], share[9],
        share[0], len(often) / m, (words[1:] == words[:-1]).mean() if len(words) > 1 else 0, len(triples) / max(len(words) - 2, 1), m / max(len(lines), 1),
        len(np.unique(lines)) / max(len(lines), 1), (sizes <= 3).mean() if len(sizes) else 0, (sizes >= 12).mean() if len(sizes) else 0,
        np.isin(_CLASS[ends], (5, 6, 9)).mean() if len(ends) else 0, often.max() / m,
    ], np.float32)


@dataclass(frozen=True)
class Model:
    edges: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int], ...]
    coarse: tuple[np.ndarray, ...]
    grids: tuple[np.ndarray, ...]
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for i, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, i], "right")]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            z += grid[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Upper borders between bins of about equally many values; a border value belongs to the bin above."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="higher")) if len(values) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4, ridge: float = 1.0) -> np.ndarray:
    """Steps for each bin: the bins are split where the gain is largest until there are enough leaves."""
    total_g, total_h = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))

    def worth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (total_g[b] - total_g[a]) ** 2 / (total_h[b] - total_h[a] + ridge)

    borders = [0, len(g)]
    while len(borders) <= leaves:
        gains = []
        for a, b in itertools.pairwise(borders):
            at = np.arange(a + 1, b)
            if len(at):
                gain = worth(np.full(len(at), a), at) + worth(at, np.full(len(at), b)) - worth(np.array([a]), np.array([b]))
                gains.append((gain.max(), int(at[gain.argmax()])))
        if not gains or max(gains)[0] <= 1e-9:
            break
        borders = sorted([*borders, max(gains)[1]])
    step = np.zeros(len(g))
    for a, b in itertools.pairwise(borders):
        step[a:b] = (total_g[b] - total_g[a]) / (total_h[b] - total_h[a] + ridge)
    return step


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2) -> Model:
    """Learns P(y = 1). Without rows of both labels it is the share of label 1 (half if there are no rows)."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    edges = [_cuts(x[:, i], BINS) for i in range(len(FEATURES))]
    tables = [np.zeros(len(e) + 1) for e in edges]
    coarse = tuple(_cuts(x[:, i], COARSE) for i in range(len(FEATURES)))
    if len(np.unique(y)) < 2:
        return Model(tuple(edges), tuple(tables), (), coarse, (), base)
    bins = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(edges)]
    z = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i, table in enumerate(tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(bins[i], g, len(table)), np.bincount(bins[i], h, len(table)))
            table += step
            z += step[bins[i]]
    cells = [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(coarse)]
    widths = [len(c) + 1 for c in coarse]
    g, h = slopes()

    def gain(pair: tuple[int, int]) -> float:
        i, j = pair
        cell = cells[i] * widths[j] + cells[j]
        return float((np.bincount(cell, g, widths[i] * widths[j]) ** 2 / (np.bincount(cell, h, widths[i] * widths[j]) + 1)).sum())

    pairs = tuple(sorted(itertools.combinations(range(len(FEATURES)), 2), key=gain, reverse=True)[:PAIRS])
    grids = [np.zeros((widths[i], widths[j])) for i, j in pairs]
    for _ in range(rounds // 2):
        for (i, j), grid in zip(pairs, grids, strict=True):
            g, h = slopes()
            cell = cells[i] * widths[j] + cells[j]
            gg, hh = (np.bincount(cell, v, grid.size).reshape(grid.shape) for v in (g, h))
            # a tree of two levels: split the first feature, then the second within each part
            step = np.zeros_like(grid)
            first = _tree(gg.sum(axis=1), hh.sum(axis=1), leaves=2)
            for part in np.unique(first):
                rows = first == part
                step[rows] = _tree(gg[rows].sum(axis=0), hh[rows].sum(axis=0), leaves=2)
            grid += rate * step
            z += rate * step.ravel()[cell]
    return Model(tuple(edges), tuple(tables), pairs, coarse, tuple(grids), base)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features_of(t or b"").tobytes() for t in texts_of(batch.column(0))]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(rows, pa.binary())], ["quality", "drawn", "features"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns from about ``rows`` labelled documents at most, none held out, each label in proportion to its rows.

    Of a label some are taken by hashes of their doc_id, the same ones each time, and of equal hashes those whose features sort first.
    Only their ids are broadcast, after they were counted, and only their features reach the driver.
    """
    usable = labels.where(~held_out() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"), F.xxhash64(F.lit("quality"), "doc_id").alias("drawn"))
    sizes = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    bounds = {label: min(n, max(1, -(-rows * n // total))) for label, n in sizes.items()}
    drawn = usable.where(below_fraction(["doc_id"], 100 + 2 * rows, total, "quality"))
    drawn = F.broadcast(at_most(drawn, "quality", bounds, ["drawn", "doc_id"]))  # no more rows than the bounds' sum
    features = docs.select("doc_id", "text").join(drawn, "doc_id").select("text", "quality", "drawn").mapInArrow(_features, "quality int, drawn long, features binary")
    found = at_most(features, "quality", bounds, ["drawn", "features"]).collect()
    found = sorted(found, key=lambda r: (r["quality"], r["drawn"], bytes(r["features"])))
    x = np.array([np.frombuffer(r["features"], np.float32) for r in found], np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["quality"] for r in found], np.float64))


def _score(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features_of(t or b"") for t in texts_of(batch.column(1))], np.float64).reshape(-1, len(FEATURES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold) for each row of ``docs``, from its whole text.

    A null text counts as empty, and empty texts are scored too. Rows that repeat each return a row; only doc_id and text are read.
    """
    schema = "doc_id long, held_out boolean, score double, predicted int"
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(_score(model, threshold), schema)
