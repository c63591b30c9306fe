"""The license join unfiltered, and the two models' decisions, against plain Python."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import lang_id, license_scan, quality
from lodestone.llm.shared import texts_of

# ---------------------------------------------------------------- 8 the join


def blocks_of(text, short):
    cut = [*text.split("\n"), *re.split(license_scan.BLANK, text)]
    return {x for b in cut for x in (re.split(license_scan.SENTENCE, b) if short else [b])}


@pytest.mark.parametrize("share", [0.5, 0.8, 1.0])
def test_the_join_finds_every_block_that_contains_a_template(spark, sf, share):
    rng = random.Random(7)
    notices = [t.text for t in license_scan.TEMPLATES]
    texts = [None, "", *notices]
    for notice in notices:
        words = notice.split()
        for _ in range(3):
            kept = [w for w in words if rng.random() < 0.9] + rng.choices(["foo", "gnu", "the", "nc"], k=2)
            rng.shuffle(kept)
            texts.append("Some prose. " + " ".join(kept) + rng.choice([".", "\n\nmore prose", "\nand a line"]))
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("label", F.lit("x"))
    got = {(r["doc_id"], r["block"], r["template"]): (r["label"], round(r["share"], 9), r["told"]) for r in license_scan.contained(docs, share=share).collect()}
    want = {}
    for i, text in enumerate(texts):
        low = (text or "").lower()
        for nr, t in enumerate(license_scan.TEMPLATES):
            for block in blocks_of(low, len(t.words) < license_scan.ONE_SENTENCE):
                held = {w for w in re.split(license_scan.GAP + "+", block) if w}
                part = len(held & set(t.words)) / len(t.words)
                if part >= share - 1e-9:
                    want[i, block, nr] = (t.label, round(part, 9), set(t.telling) <= held and not set(t.never) & held)
    assert got == want and len(want) > 20
    scanned = {r["doc_id"]: r["contained"] for r in license_scan.scan(docs, share=share).collect()}
    assert scanned == {i: ",".join(sorted({v[0] for k, v in want.items() if k[0] == i})) for i in range(len(texts))}


# ---------------------------------------------------------------- 2 decoding


def decoded(coder, counts):
    """The nearest codeword by explicit loops over languages and bits."""
    root = [math.sqrt(c) for c in counts]
    norm = max(math.sqrt(sum(r * r for r in root)), 1e-6)
    at = [i for i, r in enumerate(root) if r]
    margins = [sum(root[i] / norm * float(coder.weights[i, b]) for i in at) + float(coder.bias[b]) for b in range(coder.code.shape[1])]
    losses = [sum(math.log1p(math.exp(-m * float(c))) * float(t) for m, c, t in zip(margins, word, coder.trust, strict=True)) for word in coder.code]
    near = [math.exp(-lang_id.SHARPNESS * (x - min(losses))) for x in losses]
    score = 1 / sum(near)
    second = sorted(near)[-2] / sum(near) if len(near) > 1 else 0.0
    return coder.languages[losses.index(min(losses))], score, second > lang_id.AMBIGUOUS * score


def test_predictions_are_those_of_loops_over_codewords(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    coder = lang_id.train(docs, rows=60)
    rows = {r["doc_id"]: r for r in lang_id.identify(docs, coder).collect()}
    some = docs.orderBy("doc_id").limit(60).toArrow()
    for i, raw in zip(some["doc_id"].to_pylist(), texts_of(some["text"].combine_chunks()), strict=True):
        lang, score, unsure = decoded(coder, lang_id.counts_of(raw).tolist())
        assert rows[i]["lang_pred"] == lang and rows[i]["score"] == pytest.approx(score, abs=1e-4)
        assert rows[i]["ambiguous"] == unsure or abs(score - 0.5) < 1e-3


@pytest.mark.parametrize("n", [2, 3, 5, 8, 20])
def test_codewords_tell_languages_apart(n):
    code = lang_id.codewords(n)
    assert set(np.unique(code)) <= {-1.0, 1.0} and len({tuple(r) for r in code}) == n
    least = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
    assert least >= code.shape[1] / 3


# ---------------------------------------------------------------- 7 the additive model


def test_scores_are_sums_of_table_entries(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    below = lambda edges, v: sum(v >= e for e in edges)  # noqa: E731  (how many borders a value has reached)
    some = docs.toArrow()
    assert model.pairs and any(t.any() for t in model.tables)
    for i, raw in zip(some["doc_id"].to_pylist(), texts_of(some["text"].combine_chunks()), strict=True):
        x = [float(v) for v in quality.features_of(raw or b"")]
        z = model.base + sum(table[below(edges, v)] for edges, table, v in zip(model.edges, model.tables, x, strict=True))
        z += sum(grid[below(model.coarse[a], x[a]), below(model.coarse[b], x[b])] for (a, b), grid in zip(model.pairs, model.grids, strict=True))
        assert rows[i]["score"] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), rel=1e-9)
        assert rows[i]["predicted"] == (rows[i]["score"] >= 0.3)


def test_a_tree_splits_where_the_gain_is_largest():
    rng = np.random.default_rng(3)
    for _ in range(50):
        g, h = rng.normal(size=9), rng.uniform(0.1, 2, 9)
        step = quality._tree(g, h, leaves=2)
        worth = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
        gains = [worth(0, k) + worth(k, 9) - worth(0, 9) for k in range(1, 9)]
        k = int(np.argmax(gains)) + 1 if max(gains) > 1e-9 else 9
        want = np.concatenate([np.full(k, g[:k].sum() / (h[:k].sum() + 1)), np.full(9 - k, g[k:].sum() / (h[k:].sum() + 1))])
        assert np.allclose(step, want)
