"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F


from lodestone.llm import components, embed_dedup, lang_id, license_scan, minhash, mixing, packing, quality, queries, secret_scan, token_counts, topk
from lodestone.llm.shared import Scratch, is_held_out, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, signature string, rank string, rate string, component string"
LONG = "word " * 30_000 + "end"
ODD = [
    (0, None, None, None, None), (1, "", "en", "a", 0), (2, "  \n ", "en", "a", 4), (3, "...!!! 123", None, "b", 10), (4, LONG, "en", "b", 5), (5, LONG, "de", None, 5),
    (6, "one two three four five six seven", "en", "b", 1), (7, "one two three four five six seven", "en", "b", 1), (7, "one two three four five six seven", "en", "b", 1),
    (8, "ÄÖÜ ß 漢字 İſK", "de", "c", 1), (None, "no id here", "fr", "c", 1), (9, "x", "es", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "s", "r", "q", "c") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def union_find(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


# ---------------------------------------------------------------- shared


def test_word_hashes_tell_words_apart():
    rng = random.Random(1)
    words = ["".join(rng.choice("abABé") for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    text = "".join(w + rng.choice([" ", "\n", "\t  "]) for w in words)
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    got = word_hashes(text.encode())
    assert len(got) == len(words)
    assert len(set(zip(lower, got, strict=True))) == len(set(lower)) == len(set(got.tolist()))


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    from lodestone.llm import shared

    text = ("alpha beta " * 50 + "x" * 300 + "  tail").encode()
    whole = word_hashes(text)
    monkeypatch.setattr(shared, "_CHUNK", 17)
    assert (word_hashes(text) == whole).all()


def test_components_are_those_of_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = components.connected_components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "test")).collect()
    ids = {x for a, b in links for x in (a, b) if a != b}
    want = union_find(ids, [x for x in links if x[0] != x[1]])
    assert {r["id"]: r["component"] for r in got} == want and len(got) == len(want)


# ---------------------------------------------------------------- 1 token counts


def unigram(pieces):
    from tokenizers import Tokenizer, models

    vocab = [("<unk>", 0.0), *((f"<0x{i:02X}>", -1e9) for i in range(256)), *pieces]
    return Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))


def test_counts_are_those_of_the_unigram_tokenizer(spark, sf):
    pieces = token_counts.unigram_pieces(queries.tokenizer_file("piece_bpe_32k.model"))
    counter = token_counts.Counter(pieces)
    assert counter.splits
    # the byte pieces' scores set the tokenizer's cost of an unknown character, which is 10 below the worst piece
    model, counter.unknown = unigram(pieces), -1e9 - token_counts.UNKNOWN_PENALTY
    texts = [r["text"] for r in docs_of(spark, sf).orderBy("doc_id").limit(60).collect()] + [" lead", "trail ", "a  b", "▁x▁", "漢字 \U0001f600é\n\tz", "<0x41>"]
    for text in texts:
        want = model.encode("▁" + text.replace(" ", "▁")).ids
        assert counter.text(text) == len(want), text[:40]


def test_ties_go_to_the_earlier_start():
    counter = token_counts.Counter([("a", -1.0), ("aa", -2.0), ("▁", -1.0)])
    model = unigram([("a", -1.0), ("aa", -2.0), ("▁", -1.0)])
    for text in ("a", "aa", "aaa", "aaaa aaaaa"):
        assert counter.text(text) == len(model.encode("▁" + text.replace(" ", "▁")).ids)


def test_batches_count_as_single_texts(odd, empty):
    path = queries.tokenizer_file("piece_bpe_32k.model")
    counter = token_counts.Counter(token_counts.unigram_pieces(path))
    got = Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(odd, path).collect())
    assert got == Counter((r[0], counter.text(r[1])) for r in ODD)
    assert token_counts.count_tokens(empty, path).count() == 0


# ---------------------------------------------------------------- 2 language


def test_languages_of_held_out_documents(spark):
    docs = docs_of(spark, "/root/testdata/sf0.01")
    rows = lang_id.identify(docs, lang_id.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(r["held_out"] == is_held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(odd, empty):
    rows = lang_id.identify(odd, lang_id.train(odd)).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (0, 1, 2, 3))
    assert lang_id.identify(odd, lang_id.train(empty)).where("lang_pred <> 'und'").count() == 0
    assert lang_id.identify(empty, lang_id.train(empty)).count() == 0
    kept = lang_id.keep_identified(odd, lang_id.train(odd))
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["4", "5", "6", "7", "7", "8", "9", "None"])


def test_letters_alone_decide_what_is_kept(spark, odd, empty):
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    for docs in (unlabelled, odd):
        kept = lang_id.keep_identified(docs, lang_id.train(unlabelled))
        want = [r for r in docs.collect() if r["text"] and re.search(r"[^\W\d_]", r["text"])]
        assert kept.columns == docs.columns and len(want) == 8
        assert sorted(kept.collect(), key=str) == sorted(want, key=str)
    assert lang_id.keep_identified(empty, lang_id.train(empty)).count() == 0


def test_a_lang_that_the_text_contradicts_is_corrected(spark, sf, monkeypatch):
    docs = docs_of(spark, sf)
    coder = lang_id.train(docs)
    other = F.when(F.col("lang") == "en", "de").otherwise("en")
    given = docs.withColumn("lang", F.when(F.col("doc_id") % 4 == 0, other).when(F.col("doc_id") % 4 == 1, None).when(F.col("doc_id") % 4 == 2, "xx").otherwise(F.col("lang")))
    right, said = ({r["doc_id"]: r["lang"] for r in d.collect()} for d in (docs, lang_id.keep_identified(given, coder)))
    assert said == {i: "xx" if i % 4 == 2 else lang for i, lang in right.items()}
    monkeypatch.setattr(lang_id, "CORRECTED", 1.1)
    unsure = {r["doc_id"]: r["lang"] for r in lang_id.keep_identified(given, coder).collect()}
    assert unsure == {r["doc_id"]: r["lang"] or right[r["doc_id"]] for r in given.collect()}


def test_training_rows_are_bounded_for_each_label(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(lang_id, "fit", lambda x, langs: seen.update(lang=Counter(langs), x=x))
    rows = [(1, f"wort {i}", "de") for i in range(900)] + [(1, f"word {i}", "en") for i in range(500)] + [(1, "mot", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")  # one id that training may see, repeated
    assert not is_held_out(1)
    lang_id.train(docs.repartition(7), rows=90)
    first = seen["x"]
    assert seen["lang"] == {"de": 30, "en": 30, "fr": 1}
    lang_id.train(docs.repartition(3), rows=90)
    assert (seen["x"] == first).all()
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.update(y=Counter(y.tolist())))
    labels = spark.createDataFrame([(1, 1)] * 40 + [(3, 0)] * 60 + [(4, 0)] * 20, "doc_id long, quality int")
    docs = spark.createDataFrame([(1, f"a {i}") for i in range(50)] + [(3, f"b {i}") for i in range(50)], "doc_id long, text string")
    quality.train(docs, labels, rows=50)
    assert set(seen["y"]) <= {0.0, 1.0} and seen["y"][1.0] <= 17 and seen["y"][0.0] <= 34 and min(seen["y"].values()) > 0


def test_codewords_lie_apart():
    for n in (2, 3, 4, 5, 7, 12):
        code = lang_id.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n == 2 else 2)


# ---------------------------------------------------------------- 3 embeddings


def test_links_of_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + rng.choice([0, 0.05, 0.2, 0.35]) * rng.standard_normal(16)).astype(np.float32).tolist(), i % 2) for i in range(400)]
    rows += [(400 + i, rows[3][1], rows[3][2]) for i in range(20)] + [(500, [0.0] * 16, 1), (501, None, 1), (502, [float("nan")] * 16, 1), (503, [None, *[1.0] * 15], 0), (504, rows[0][1], None), (505, [], 0), (506, [2 * x for x in rows[0][1]], 0), (507, [1.0], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = {r["vec_id"]: r for r in embed_dedup.linked_vectors(df).collect()}
    ok = [r for r in rows if r[1] and len(r[1]) == 16 and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    x = np.array([r[1] for r in ok], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & np.equal.outer([r[2] for r in ok], [r[2] for r in ok])
    np.fill_diagonal(near, False)
    ids = [r[0] for r in ok]
    want = union_find([r[0] for r in rows], [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near), strict=True)])
    degree = dict(zip(ids, near.sum(axis=1), strict=True))
    assert len(got) == len(rows)
    for i, r in got.items():
        assert (r["n_links"], r["component_id"], r["kept"]) == (degree.get(i, 0), want[i], want[i] == i)
    assert embed_dedup.linked_vectors(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 4 minhash


def brute_groups(rows, k, percent):
    sets = {}
    for i, text in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        width = min(k, len(words))
        sets[i] = {tuple(words[j : j + width]) for j in range(len(words) - width + 1)} if words else set()
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, union_find(ids, links)


@pytest.mark.parametrize("k,threshold", [(3, 0.85), (5, 0.8)])
def test_groups_of_near_copies(spark, sf, k, threshold):
    rng = random.Random(3)
    rows = [(r["doc_id"], r["text"]) for r in docs_of(spark, sf).select("doc_id", "text").collect()]
    seed = rows[5][1].split()[:220]
    for i in range(120):  # near copies of one text, some near to each other only by way of others
        words = list(seed)
        for _ in range(rng.randrange(14)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(1000)}"
        rows.append((100_000 + i, " ".join(words)))
    rows += [(200_000 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 5)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes, groups = brute_groups(rows, k, round(threshold * 100))
    got = minhash.near_duplicates(df, k, threshold).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (sizes[i], groups[i], groups[i] == i) for i in sizes}


def test_near_copies_of_odd_rows(odd, empty):
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd).collect())
    want = [("0", 0, 0, True), ("1", 0, 1, True), ("2", 0, 2, True), ("3", 1, 3, True), ("4", 2, 4, True), ("5", 2, 4, False), ("6", 3, 6, True), ("7", 3, 6, False), ("7", 3, 6, False), ("8", 1, 8, True), ("9", 1, 9, True), ("None", 1, None, False)]
    assert got == want
    assert minhash.near_duplicates(empty).count() == 0
    assert sorted(str(r["doc_id"]) for r in minhash.deduplicate(odd).collect()) == ["0", "1", "2", "3", "4", "6", "8", "9", "None"]


def test_each_row_is_deduplicated_by_its_own_text(spark):
    one, near = "a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s u"
    clean, other = "quite another text that stands for itself", "yet one more that nobody copied so far"
    rows = [(1, one), (2, near), (2, clean), (3, other), (3, other), (None, one), (None, "nowhere else is this found at all"), (None, "nowhere else is this found at all"), (4, None), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.deduplicate(df)
    want = [(1, one), (2, clean), (3, other), (None, rows[6][1]), (4, None), (4, None)]
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


# ---------------------------------------------------------------- 5 packing


def check_pieces(rows, limits, tokens_of):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, ids in tokens_of.items():
        at = 0
        for r in sorted(by_doc.pop(doc), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limits.tokens and len(pieces) <= limits.segments and sum(r["loss_tokens"] for r in pieces) <= limits.loss
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padding / max(1, sum(r["length"] for r in rows))


def test_pieces_make_the_documents_again(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = docs_of(spark, "/root/testdata/sf0.01")
    want = {r["doc_id"]: [*model.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert check_pieces(rows, packing.Limits(), want) < 0.001


def test_ids_are_the_tokenizers_where_texts_hold_added_tokens():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model, encode, rng = Tokenizer.from_file(path), packing.byte_bpe(path), random.Random(12)
    parts = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n\n", "hello", " world", "1234", "漢字", "\U0001f600", "'s", "\t", "\u00a0", "é"]
    texts = ["hello <|endoftext|> world", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(500))]
    for text in texts:
        assert encode(text).tolist() == [*model.encode(text, add_special_tokens=False).ids, 0], text
    assert len(encode(texts[0])) == 5


def test_conversations_fill_all_three_limits(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, limits = packing.byte_bpe(path), packing.Limits(tokens=1024, segments=6, loss=400, waiting=200)
    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    talks = defaultdict(list)
    for r in sorted(turns, key=lambda r: (r["conv_id"], r["turn"])):
        talks[r["conv_id"]].append((r["role"], r["text"] or ""))
    rows, want = [], {}
    for talk, said in talks.items():  # what comes before the last answer bears no loss
        prompt = "\n".join(t for _, t in said[:-1]) + "\n"
        rows.append((talk, prompt + said[-1][1], len(encode(prompt)) - 1))
        want[talk] = encode(prompt + said[-1][1]).tolist()
    df = spark.createDataFrame(rows, "doc_id long, text string, asked long")
    pieces = packing.pack(df.repartition(2), path, limits, "asked").collect()
    check_pieces(pieces, limits, want)
    prompts = {r[0]: r[2] for r in rows}
    assert sum(p["loss_tokens"] for p in pieces) == sum(max(0, len(ids) - prompts[i]) for i, ids in want.items())
    assert sum(p["loss_tokens"] for p in pieces) < sum(p["length"] for p in pieces)


def test_all_three_limits_hold():
    rng = np.random.default_rng(0)
    limits = packing.Limits(tokens=128, segments=4, loss=70, waiting=50)
    packer, rows, want = packing.Packer(limits), [], {}

    def told(sequences):
        rows.extend(dict(zip(packing._NAMES, r, strict=True)) for r in packing._rows(sequences, len(rows) + 1))

    for doc in range(300):
        n = int(rng.integers(1, 300))
        ids = rng.integers(0, 50_000, n).astype(np.uint32)
        loss = (np.arange(n) >= rng.integers(0, n + 1)).astype(np.uint8)
        want[doc] = ids.tolist()
        told(list(packer.add(doc, ids, loss)))
    told(list(packer.finish()))
    check_pieces(rows, limits, want)


def test_rows_kept_apart_share_no_sequence(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode = packing.byte_bpe(path)
    docs = docs_of(spark, "/root/testdata/sf0.01").withColumn("lang", F.when(F.col("lang") != "es", F.col("lang"))).repartition(3).cache()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    want = {r["doc_id"]: encode(r["text"] or "").tolist() for r in docs.collect()}
    for limits in (packing.Limits(), packing.Limits(waiting=50)):
        rows = packing.pack(docs, path, limits, apart="lang").collect()
        assert check_pieces(rows, limits, want) < 0.001
        held = defaultdict(set)
        for r in rows:
            held[r["sequence_id"]].add(lang[r["doc_id"]])
        assert {tuple(x) for x in held.values()} == {(None,), ("de",), ("en",), ("fr",)}
    assert sum(r["length"] for r in packing.pack(odd, path, apart="lang").collect()) == sum(len(encode(r[1] or "")) for r in ODD)
    assert packing.pack(empty, path, apart="lang").count() == 0


def test_packing_of_odd_rows(odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode = packing.byte_bpe(path)
    rows = packing.pack(odd, path).collect()
    total = sum(r["length"] for r in rows)
    assert total == sum(len(encode(r[1] or "")) for r in ODD)
    assert [r["length"] for r in rows if r["doc_id"] == 0] == [1]
    assert packing.pack(empty, path).count() == 0


# ---------------------------------------------------------------- 6 secrets

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def secret_texts():
    rng = random.Random(9)
    parts = ["password", "PassWd", "secret=token", "api_key", "apikey", "TOKEN", ":", "=", " ", '"', "'", "abc", "abcdef12", "AKIA" + "X" * 16, "AKIA7", "0123456789abcdef" * 2, "漢", "\U0001f600", "ſecret", "\n", "f" * 23, "f" * 24]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)] + [None, "", "password=hunter22"]


def test_base_spans(spark, sf):
    texts = secret_texts() + [r["text"] for r in docs_of(spark, sf).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secret_scan.scan(df).collect()}
    for i, text in enumerate(texts):
        spans = brute_spans(text or "")
        told = [f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans]
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest(), text
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _ in spans) for n in range(3)]
        assert set(told) <= set(r["spans"].split(",")) or not told


def test_random_runs_are_found_and_words_are_not(spark, sf):
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    prose = [r["text"] for r in docs_of(spark, sf).collect()]
    keys = ["".join(rng.choice(alphabet) for _ in range(48)) for _ in range(40)]
    words = ["internationalizationconfiguration", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "path/to/the/nested/folder/of/files", "0101010101010101010101010101", "some_long_identifier_in_a_program"]
    texts = [f"{prose[i]} {k} rest" for i, k in enumerate(keys)] + [f"before {w} after" for w in words] + prose[40:]
    rows = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    by = {r["doc_id"]: r["n_random"] for r in rows}
    assert sum(by[i] > 0 for i in range(40)) >= 30
    assert sum(by[i] > 0 for i in range(40, 45)) == 0
    assert sum(by[i] > 0 for i in range(45, len(texts))) <= 2


def test_keys_of_ordinary_lengths_are_found_in_every_encoding(spark, sf):
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = {"hex": digits + "ABCDEF", "alpha": upper.lower(), "base32": upper + "234567", "base36": upper.lower() + digits, "base64": upper + upper.lower() + digits + "+/", "base64url": upper + upper.lower() + digits + "-_"}
    rng, texts, kinds = random.Random(6), [], []
    for name, alphabet in alphabets.items():
        for size in (20, 24, 32, 40, 64):
            for _ in range(50):
                texts.append(f"see {''.join(rng.choice(alphabet) for _ in range(size))} there")
                kinds.append((name, size))
    prose = [w for r in docs_of(spark, sf).collect() for w in re.findall("[A-Za-z]{3,}", r["text"] or "")]
    joins = (lambda ws: "_".join(ws).upper(), lambda ws: "_".join(ws).lower(), lambda ws: "".join(w.capitalize() for w in ws), lambda ws: "/".join(ws).lower(), lambda ws: "-".join(ws), lambda ws: "".join(ws).lower(), lambda ws: str(rng.randrange(10**24, 10**25)))
    for i in range(1400):  # ordinary runs share every class of lengths
        texts.append(f"see {joins[i % len(joins)](rng.sample(prose, rng.randint(4, 6)))} there")
    n = len(texts)
    texts += [r["text"] for r in docs_of(spark, sf).collect()]
    rows = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    by = {r["doc_id"]: r["n_random"] for r in rows}
    found = Counter(kind for i, kind in enumerate(kinds) if by[i] > 0)
    assert {kind: found[kind] for kind in set(kinds) if found[kind] < (45 if kind[1] >= 32 else 40)} == {}
    assert sum(by[i] > 0 for i in range(len(kinds), n)) <= 0.02 * sum(found.values())


def test_redaction(spark, odd, empty):
    text = "x 漢 password=hunter22 and AKIA" + "Q" * 16 + " end " + "0af" * 10
    df = spark.createDataFrame([(1, text, 7), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secret_scan.redact(df).collect()}
    want = "x 漢 [SECRET] and [SECRET] end [SECRET]"
    assert got == {1: (want, len(want)), 2: ("clean", 5), 3: (None, None)}
    clashing = df.withColumns({c: F.lit("kept") for c in ("row", "base", "all", "extra", "found", "clean", "spans", "__secret_all")})
    for r in secret_scan.redact(clashing).collect():
        assert (r["text"], r["n_chars"]) == got[r["doc_id"]] and set(r[3:]) == {"kept"}
    assert secret_scan.redact(odd).columns == odd.columns and secret_scan.scan(odd).count() == len(ODD)
    assert secret_scan.scan(empty).count() == 0


def test_redaction_of_whole_documents(spark):
    docs = docs_of(spark, "/root/testdata/sf0.01")
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs).collect()}
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs).collect()}
    changed = 0
    for r in docs.collect():
        want, text = "", r["text"] or ""
        covered, at = [], 0
        for s, e in sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in spans[r["doc_id"]].split(",") if x)):
            if covered and s < covered[-1][1]:
                covered[-1][1] = max(covered[-1][1], e)
            else:
                covered.append([s, e])
        for s, e in covered:
            want, at = want + text[at:s] + "[SECRET]", e
        assert (got[r["doc_id"]] or "") == want + text[at:]
        changed += bool(covered)
    assert changed > 3


# ---------------------------------------------------------------- 7 quality


def test_quality_of_held_out_documents(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = docs_of(spark, path), spark.read.parquet(f"{path}/labels.parquet")
    rows = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    y, p = np.array([r["quality"] for r in rows]), np.array([r["predicted"] for r in rows])
    assert min((p[y == 1] == 1).mean(), (p[y == 0] == 0).mean()) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (6, 0), (9, None), (None, 1)], "doc_id long, quality int")
    assert quality.score(odd, quality.train(odd, labels)).count() == len(ODD)
    none = quality.train(empty, labels.limit(0))
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5}
    assert quality.score(empty, none).count() == 0


# ---------------------------------------------------------------- 8 licenses


def license_texts():
    rng = random.Random(8)
    parts = ["under", "the", "MIT", "License", "Apache license,", "version", "2", "2.0", "CC BY-NC", "cc by nc", "by", "nc", "Under THE mit\nlicense", "é", "xunder", "licenses", "\n\n", ".", "漢", "K"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)]


def test_license_phrases_and_templates(spark, sf):
    texts = [*license_texts(), None, "", *(t.text for t in license_scan.TEMPLATES), *NOT_THAT_LICENSE, *(r["text"] for r in docs_of(spark, sf).collect())]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            at = [j for j in range(len(words)) if words[j : j + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        own, best = set(labels), 1.0 if places else 0.0
        blocks = [("long", b) for b in [*text.split("\n"), *re.split(license_scan.BLANK, text)]]
        blocks += [("short", x) for _, b in blocks for x in re.split(license_scan.SENTENCE, b)]
        for kind, block in blocks:
            held = {w for w in re.split(license_scan.GAP + "+", block.lower()) if w}
            for t in license_scan.TEMPLATES:
                if (len(t.words) < license_scan.ONE_SENTENCE) != (kind == "short"):
                    continue
                share = len(held & set(t.words)) / len(t.words)
                if share >= license_scan.SHARE and set(t.telling) <= held and not set(t.never) & held:
                    own.add(t.label)
                    best = max(best, share)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None)), text
        assert (r["base_labels"], r["labels"]) == (",".join(sorted(labels)), ",".join(sorted(own))), text
        assert r["score"] == pytest.approx(best)


#: Notices that hold most words of a template and yet tell another license, or none.
NOT_THAT_LICENSE = {
    "This model is released under the GPL license.": "",
    "Released under the license of the author": "",
    "This work is licensed under the GNU Lesser General Public License, version 3": "",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": "cc-by-nc-sa",
    "Licensed under CC BY-NC-SA 4.0": "cc-by-nc",
    "All rights to the seats are reserved by others, all of them": "all-rights-reserved",
    "Licensed under the Apache License, Version 1.1": "",
    "Released under the MIT License.": "mit",
    "Er kam mit dem Zug. The train under the bridge was released. No license is needed here.": "",
    "Der Wagen mit dem\nLicensed under the Apache License, Version 2.0.": "apache-2",
    "This work is licensed under the GNU General Public License, version 2.": "gpl-2",
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
}


def test_one_license_is_not_taken_for_another(spark, sf):
    texts = list(NOT_THAT_LICENSE)
    prose = [r["text"] for r in docs_of(spark, sf).collect()]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate([*texts, *prose])), "doc_id long, text string")).collect()
    got = {texts[r["doc_id"]]: r["labels"] for r in rows if r["doc_id"] < len(texts)}
    assert got == NOT_THAT_LICENSE


def test_a_notice_is_found_in_wrapped_lines_and_with_words_changed(spark):
    rng = random.Random(4)
    for t in license_scan.TEMPLATES:
        words = t.text.split()
        fixed = {w for w in words if set(re.findall("[a-z0-9]+", w.lower())) & set(t.telling)}
        some = [w for w in words if w in fixed or rng.random() > 0.08]
        wrapped = "\n".join(" ".join(some[i : i + 7]) for i in range(0, len(some), 7))
        text = f"First part of another kind.\n\n{wrapped}\n\nwhat follows"
        row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        share = len(set(re.findall("[a-z0-9]+", " ".join(some).lower())) & set(t.words)) / len(t.words)
        assert (t.label in row["labels"].split(",")) == (share >= license_scan.SHARE), (t.label, share)


def test_licenses_of_odd_rows(odd, empty):
    assert license_scan.scan(odd).count() == len(ODD) and license_scan.scan(empty).count() == 0


# ---------------------------------------------------------------- 9 top k


def test_best_inner_products(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 8) / 256 * (rng.random(8) < 0.6)], "x") for i in range(700)]
    rows += [(700, None, "x"), (701, [None, *[1.0] * 7], "x"), (702, [float("inf")] * 8, "x"), (750, rows[50][1], "x"), (50, rows[50][1], "x"), (None, [0.0] * 8, "x"), (800, [1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = [tuple(r) for r in topk.top_k(topk.quantised(df), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for q, v in sorted({(i, tuple(v)) for i, v in ok if i % 50 == 0}):
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert got == want
    assert topk.top_k(topk.quantised(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


# ---------------------------------------------------------------- 10 mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    budget, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.remove(s)
    return target


def test_mixture_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 100)
    docs = docs_of(spark, "/root/testdata/sf0.01")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 97 == 0, None).otherwise(F.col("source")))
    rows, again = mixing.taken(docs).collect(), mixing.taken(docs.repartition(5)).collect()
    assert sorted(rows) == sorted(again) and len(rows) == docs.count()
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    want = brute_targets(sizes)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in sizes)


def test_mixture_is_that_of_the_sql_with_many_buckets(spark, sf, monkeypatch):
    whole = docs_of(spark, sf)
    texts = F.when(F.col("doc_id") % 2 == 0, "same size here").when(F.col("doc_id") % 3 == 0, "two words").otherwise(F.col("text"))
    ids = F.when(F.col("doc_id") != 7, F.col("doc_id") * F.when(F.col("doc_id") % 5 == 0, -1).otherwise(1_000_003))
    docs = whole.withColumn("text", texts).withColumn("doc_id", ids)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = sorted(con.execute(queries.OP10).fetchall(), key=str)
    for rows in (7, 50, 50_000):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", rows)
        assert sorted((tuple(r) for r in mixing.taken(docs).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str) == want


def test_the_mix_holds_each_row_as_often_as_it_is_taken(spark, sf):
    docs = docs_of(spark, sf).withColumns({c: F.lit("kept") for c in ("row", "size", "key", "bucket", "copies", "rate", "mix_size", "mix_key")})
    want = Counter()
    for r in mixing.taken(docs).where("size > 0").collect():
        want[r["doc_id"]] += r["taken"] // r["size"]
    rows = mixing.mix(docs).where("text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").collect()
    assert rows[0].__fields__ == docs.columns and {r["mix_size"] for r in rows} == {r["key"] for r in rows} == {"kept"}
    assert Counter(r["doc_id"] for r in rows) == +want
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(texts[r["doc_id"]] == r["text"] for r in rows)


def test_mixture_of_odd_rows(spark, odd, empty):
    rows = mixing.taken(odd).collect()
    assert len(rows) == len(ODD) and {r["doc_id"]: r["size"] for r in rows}[0] == 0
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.taken(empty).count() == 0 and mixing.mix(empty).count() == 0


# ---------------------------------------------------------------- queries and the pipeline


def test_every_query_runs_on_whole_tables(spark, sf):
    n = docs_of(spark, sf).count()
    for name in ("op2_language_id", "op6_secret_scan", "op7_quality", "op8_license_scan", "op10_mixing"):
        assert queries.queries()[name](spark, sf).count() == n


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = docs_of(spark, sf)
    at, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf)
        seen.append((name, out.count()))
        if name != "packing":
            assert out.schema.names == docs.schema.names
        at = out
    assert [n for n, _ in seen] == ["language_id", "near_dedup", "secrets", "mixture", "packing"]
    assert seen[0][1] == docs.where("text rlike '\\\\p{L}'").count()
    assert seen[1][1] < seen[0][1] and seen[2][1] == seen[1][1]
    assert corpus_pipeline.run(spark, sf).agg(F.sum("length")).first()[0] == at.agg(F.sum("length")).first()[0]




def test_language_id_decides_what_shares_a_sequence(spark, sf):
    import corpus_pipeline

    docs = docs_of(spark, sf)
    right = {r["doc_id"]: r["lang"] for r in docs.collect()}
    other = F.when(F.col("doc_id") % 2 == 0, F.when(F.col("lang") == "en", "de").otherwise("en"))
    given = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, other).otherwise(F.col("lang")))

    def mixed(rows):
        held = defaultdict(set)
        for r in rows.collect():
            held[r["sequence_id"]].add(right[r["doc_id"]])
        return sum(len(x) > 1 for x in held.values())

    assert mixed(corpus_pipeline.sequences(spark, given, sf)) > 0
    assert mixed(corpus_pipeline.sequences(spark, corpus_pipeline.language_id(spark, given, sf), sf)) == 0


def test_pipeline_stages_keep_columns_whatever_their_names(spark, sf, odd):
    import corpus_pipeline

    names = ("row", "key", "base", "all", "size", "bucket", "copies", "place", "component_id", "signature2", "__row", "drawn", "held_out")
    clashing = odd.withColumns({c: F.lit("kept") for c in names})
    at = clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf)
        assert at.columns == clashing.columns, name
        assert {r[c] for r in at.collect() for c in names} == {"kept"}, name
    assert corpus_pipeline.STAGES[-1][1](spark, at, sf).count() > 0
    empty = clashing.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0, name


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same_rows(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(found.fetchall())
