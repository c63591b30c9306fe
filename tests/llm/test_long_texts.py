"""Texts that are long in one way or another: spaces, short rows, words without end, thousands of finds."""

import random
import re
import resource
import time

import numpy as np
import pytest

from lodestone.llm import packing, queries, secret_scan, token_counts


# ---------------------------------------------------------------- 5 packing


@pytest.fixture(scope="module")
def coders():
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    return packing.byte_bpe(path), lambda text: model.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "\t " * 500_000 + "z", "a" * 1_000_000, "漢" * 300_000, "!" * 300_000, ("x" + " " * 400_000) * 2 + "y", "　" * 300_000 + "漢"])
def test_ids_of_runs_without_end(coders, text):
    encode, want = coders
    assert encode(text)[:-1].tolist() == want(text)


def test_ids_of_long_spaces_among_other_things(coders):
    encode, want = coders
    rng = random.Random(3)
    parts = ["word", "'s", "漢字", "12", "!?", "<|endoftext|>", "\t \n" * 5000, "\x1c" * 10_050, *(" " * n for n in (1, 2, 9_999, 10_000, 10_001, 30_000)), "\n", "\n" * 12_000]
    for _ in range(60):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        assert encode(text)[:-1].tolist() == want(text)


def packed(sizes, limits, loss=lambda n: np.ones(n, np.uint8)):
    packer, out = packing.Packer(limits), []
    for i, n in enumerate(sizes):
        out += packer.add(i, np.arange(n, dtype=np.uint32), loss(n))
    return out + list(packer.finish())


def padding(sequences, sizes, limits):
    """Of the ids, the share that padding adds; every id lies in one piece, and every limit holds."""
    held = {i: [] for i in range(len(sizes))}
    added = 0
    for s in sequences:
        n = sum(len(p.ids) for p in s)
        assert 0 < n <= limits.tokens and len(s) <= limits.segments and sum(int(p.loss.sum()) for p in s) <= limits.loss
        added += 0 if n & (n - 1) == 0 else limits.tokens - n
        for p in s:
            assert p.ids.tolist() == list(range(p.start, p.start + len(p.ids)))
            held[p.doc_id].append((p.start, len(p.ids)))
    for i, size in enumerate(sizes):
        at = 0
        for start, n in sorted(held[i]):
            assert start == at
            at += n
        assert at == size
    return added / max(1, sum(sizes))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 11, 20])
def test_short_rows_take_no_padding(n):
    sizes, limits = [n] * 6000, packing.Limits()
    assert padding(packed(sizes, limits), sizes, limits) < 0.01


def test_every_limit_holds_without_padding():
    rng = random.Random(1)
    for _ in range(12):
        limits = packing.Limits(tokens=rng.choice([64, 128, 1024]), segments=rng.choice([1, 3, 16]), loss=rng.choice([5, 40, 2000]), waiting=rng.choice([8, 64, 500]))
        sizes = [rng.choice([1, 2, 3, 50, rng.randint(1, 3000)]) for _ in range(200)]
        assert padding(packed(sizes, limits, lambda n: (np.arange(n) >= n // 2).astype(np.uint8)), sizes, limits) == 0


@pytest.mark.parametrize("name", ["tokens", "segments", "loss", "waiting"])
def test_limits_are_at_least_one(name):
    with pytest.raises(ValueError, match="at least 1"):
        packing.Limits(**{name: 0})


# ---------------------------------------------------------------- 1 token counts


def test_a_word_without_end_takes_no_memory():
    counter = token_counts.Counter(token_counts.unigram_pieces(queries.tokenizer_file("piece_bpe_32k.model")))
    text = "漢字仮名交" * 400_000
    assert counter.text(text[:5000]) > 0
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    counter.text(text)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100 * 1024


def test_counts_are_those_of_all_paths():
    rng = random.Random(2)
    for _ in range(3000):
        pieces = [("".join(rng.choice("ab") for _ in range(rng.randint(1, 4))), -rng.choice([0.5, 1.0, 1.5, 2.0])) for _ in range(rng.randint(0, 6))]
        counter, text = token_counts.Counter(pieces), "".join(rng.choice("abc漢") for _ in range(rng.randint(0, 9)))
        best = [(0.0, 0)] + [None] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(end):
                part = text[start:end]
                if part in counter.pieces:
                    new = (best[start][0] + counter.pieces[part], best[start][1] + 1)
                elif end - start == 1:
                    new = (best[start][0] + counter.unknown, best[start][1] + len(part.encode()))
                else:
                    continue
                if best[end] is None or new[0] > best[end][0]:
                    best[end] = new
        assert counter.path(text) == best[-1][1]


# ---------------------------------------------------------------- 6 secret scans


def many_finds(n, seed=4):
    rng = random.Random(seed)
    pick = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    kinds = (lambda: "word", lambda: "漢字é", lambda: f"password=hunter{rng.randint(100, 99999)}", lambda: "AKIA" + pick("ABCDEFGH0123", 18), lambda: pick("0123456789abcdef", 30), lambda: "secret: AKIA" + pick("ABCDEFGH0123", 18))
    return " ".join(rng.choice(kinds)() for _ in range(n))


def base_spans(text):
    out = []
    for number, (kind, pattern, group, least) in enumerate(secret_scan.BASE):
        out += [(m.start(), number, m.end(), kind) for m in re.finditer(pattern.replace("((?i:", "((?i:"), text) if len(m[group]) >= least]
    return sorted(out)


def test_spans_and_marks_of_many_finds(spark):
    texts = [(i, many_finds(n, i)) for i, n in enumerate((0, 1, 7, 400, 3000))] + [(90, "漢" * 9000 + " password=abcdefgh"), (91, "password=abcdefgh" + " x" * 2048), (92, None), (93, "x" * 4096), (94, "token=abcdef" * 2000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, n_chars long")
    spans = {r["doc_id"]: [s.split(":") for s in r["spans"].split(",") if s] for r in secret_scan.scan(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs).collect()}
    for i, text in texts:
        base = base_spans(text or "")
        got = [(int(a), secret_scan.KINDS.index(k), int(b), k) for k, a, b in spans[i]]
        assert [s for s in got if s[3] != "random"] == base and got == sorted(got)
        assert all(not any(b[0] <= s[0] and s[2] <= b[2] for b in base) for s in got if s[3] == "random")
        if text is None:
            assert clean[i] is None
            continue
        want, at = "", 0
        for start, _, end, _ in got:
            if start >= at:
                want += text[at:start] + "[SECRET]"
            at = max(at, end)
        assert clean[i] == want + text[at:]


def test_time_follows_the_number_of_finds(spark):
    def seconds(n):
        docs = spark.createDataFrame([(1, many_finds(n))], "doc_id long, text string").cache()
        docs.count()
        began = time.time()
        secret_scan.redact(docs).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(500)
    few, many = seconds(3000), seconds(30_000)
    assert many < 10 * few + 10
