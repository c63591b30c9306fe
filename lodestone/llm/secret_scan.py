"""Secret scanning with Column functions only: three fixed patterns, and runs of characters that a randomness battery passes.

A run of 20 or more token characters has an inferred encoding (decimal, hexadecimal, letters, base 32, base 36, base 64) and
takes three tests: chi-squared uniformity over the encoding's alphabet, runs above and below the middle of the alphabet, and
serial correlation at lag one. The three are combined: their squared deviations add up to one statistic, which a random key
exceeds once in 1,000; a run that does has p-value 1. What stands against it is ordinary text, whose characters come
as often as in all documents. The run's likelihood ratio L, uniform characters against ordinary ones, has the mean 1 in
ordinary text, so ordinary text has a ratio of L or more with a chance of 1 / L at most, at any length: that is the p-value.
Base 64 tells upper from lower case; there ordinary text may also be in swapped case (names of constants), and the larger of
the two p-values counts. The other encodings have one case each, and there letters of both cases are counted together. Within
each class of lengths Benjamini and Hochberg's rule over all runs of all documents sets the largest p-value that counts as a
find.

The corpus is read three times: for character counts, for p-values by class, and for the spans. What is shuffled are counts
of distinct words and of classes; every row's spans are worked out within the row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group whose length counts, least length. Fixed values of the contract.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
RANDOM = "random"
KINDS = (*(b[0] for b in BASE), RANDOM)
RUN = r"[A-Za-z0-9+/_=-]{20,}"
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyz"
BASE64 = SYMBOLS + "ABCDEFGHIJKLMNOPQRSTUVWXYZ+/"
#: Encoding, pattern, its alphabet (of base 64 as it is, of the others in lower case); the first that matches is inferred.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", "0123456789"),
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("alpha", r"^(?:[a-z]+|[A-Z]+|[A-Z][a-z]+)$", "abcdefghijklmnopqrstuvwxyz"),
    ("base32", r"^[A-Z2-7]+=*$", "234567abcdefghijklmnopqrstuvwxyz"),
    ("base36", r"^(?:[a-z0-9]+|[A-Z0-9]+)$", SYMBOLS),
    ("base64", r"^.*$", BASE64),
)
LENGTH_CLASSES = (20, 28, 40, 64)
FALSE_SHARE = 0.01
#: The three tests' squared deviations add up to a chi-squared variable of three degrees of freedom if a run is random, which
#: leaves this value once in 1,000 (fixed value of the law). From there on a run is not random.
BATTERY = 16.27
_STEPS, _DEEPEST = 20, 400  # bins of the negative decimal logarithm of p


@dataclass(frozen=True)
class Null:
    """What stands against an encoding: for each symbol the logarithm of uniform by ordinary frequency, as it is and in swapped case."""

    plain: tuple[float, ...]
    swapped: tuple[float, ...]


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(text: Column, pattern: str, group: int) -> Column:
    """An array of (start, end, match, size): code points of every match, its text, and the length of the given group.

    A text is read once for its matches, and a second time, for what lies between them, only if there are any.
    """
    none = F.expr("cast(array() as array<struct<start:int,end:int,match:string,size:int>>)")
    size = lambda match: F.length(match if group == 0 else F.regexp_extract(match, pattern, group))

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = _scanned(F.zip_with(gaps, found, lambda gap, match: F.length(gap) + F.length(match)), lambda a, b: a + b, 0)
        told = lambda end, match: F.struct((end - F.length(match)).alias("start"), end.alias("end"), match.alias("match"), size(match).alias("size"))
        return F.when(F.size(found) > 0, F.zip_with(ends, found, told)).otherwise(none)

    return _bind(F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.expr("cast(array() as array<string>)")), placed)


def _scanned(values: Column, join: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each place of an array of integers all values up to there, joined (running sums, running maxima).

    Every step joins the array with itself moved by 1, 2, 4, ... places, so n values take n log n of work.
    """
    zero_ = F.lit(zero)
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")), lambda i: F.pow(F.lit(2), i).cast("int"))
    steps = F.filter(steps, lambda k: k < F.size(values))
    moved = lambda now, k: F.concat(F.array_repeat(zero_, k), F.slice(now, F.lit(1), F.size(now) - k))
    return F.aggregate(steps, values, lambda now, k: F.zip_with(now, moved(now, k), join))


def character_counts(docs: DataFrame) -> dict[str, int]:
    """How often each symbol of base 64 occurs in all texts, - and _ counted as + and /: one aggregate row.

    Texts are cut at spaces and equal words counted first, so that a symbol is looked for once in each distinct word.
    """
    words = docs.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("times"))
    often = lambda c: F.col("times") * (F.octet_length("word") - F.octet_length(F.replace("word", F.lit(c), F.lit(""))))
    row = words.agg(*(F.sum(often(c)).alias(f"n_{i}") for i, c in enumerate(BASE64 + "-_"))).first()
    counts = {c: row[i] or 0 for i, c in enumerate(BASE64 + "-_")}
    counts["+"] += counts.pop("-")
    counts["/"] += counts.pop("_")
    return counts


def null_of(counts: dict[str, int]) -> dict[str, Null]:
    out = {}
    for name, _, alphabet in ENCODINGS:
        own = {c: 1 + counts[c] + (counts[c.upper()] if name != "base64" and c.isalpha() else 0) for c in alphabet}
        plain = {c: math.log(sum(own.values()) / len(alphabet) / n) for c, n in own.items()}
        out[name] = Null(tuple(plain.values()), tuple(plain.get(c.swapcase(), plain[c]) for c in alphabet))
    return out


def _pick(values: list, number: Column) -> Column:
    """The value of the encoding with that number."""
    return F.get(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), number)


def _disorder(r: Column, a: Column, n: Column) -> Column:
    """What runs about the middle of an alphabet of ``a`` symbols and serial correlation add to the battery's statistic.

    Each is a squared deviation in units of its own spread under randomness. Null where a test cannot be made.
    """
    zero = F.struct(*(F.lit(0.0).alias(x) for x in ("before", "above", "runs", "s", "s2", "lag", "first")))

    def step(t: Column, x: Column) -> Column:
        high, was = x > a / 2, t["before"] > a / 2
        fresh = t["before"] == 0
        return F.struct(
            x.alias("before"),
            (t["above"] + high.cast("double")).alias("above"),
            (t["runs"] + (fresh | (high != was)).cast("double")).alias("runs"),
            (t["s"] + x).alias("s"),
            (t["s2"] + x * x).alias("s2"),
            (t["lag"] + t["before"] * x).alias("lag"),
            F.when(fresh, x).otherwise(t["first"]).alias("first"),
        )

    def deviations(t: Column) -> Column:
        pairs = 2 * t["above"] * (n - t["above"])
        runs = F.try_divide(t["runs"] - 1 - pairs / n, F.sqrt(F.try_divide(pairs * (pairs - n), n * n * (n - 1))))
        mean = t["s"] / n
        spread = t["s2"] - n * mean * mean
        serial = (F.try_divide(t["lag"] - mean * (2 * t["s"] - t["first"] - t["before"]) + (n - 1) * mean * mean, spread) + 1 / n) * F.sqrt(n)
        return F.when((pairs > n) & (spread > 0), runs * runs + serial * serial)

    return F.aggregate(r["places"], zero, step, deviations)


def _candidates(text: Column, nulls: dict[str, Null]) -> Column:
    """An array of (start, end, class, bin) of the runs of a text.

    bin is 20 times the negative decimal logarithm of the p-value against ordinary text, -1 for a run that is not random.
    Each step below binds what the next one uses, so that nothing is worked out twice.
    """
    alphabets = [a for _, _, a in ENCODINGS]
    law = [nulls[name] for name, _, _ in ENCODINGS]
    symbols = [F.array(*(F.struct(F.lit(c).alias("c"), F.lit(l).alias("l"), F.lit(m).alias("m")) for c, l, m in zip(a, x.plain, x.swapped, strict=True))) for a, x in zip(alphabets, law, strict=True)]
    base64 = len(ENCODINGS) - 1

    def read(r: Column) -> Column:
        number = F.lit(base64)
        for i, (_, pattern, _) in reversed(list(enumerate(ENCODINGS))):
            number = F.when(r["match"].rlike(pattern), i).otherwise(number)
        length = r["end"] - r["start"]
        group = sum(((length >= x).cast("int") for x in LENGTH_CLASSES), F.lit(0))
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), group.alias("class"), number.alias("code"), r["match"].alias("match"))

    def folded(r: Column) -> Column:
        kept = F.when(r["code"] == base64, F.translate(r["match"], "-_=", "+/")).otherwise(F.translate(F.lower(r["match"]), "=", ""))
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), r["class"].alias("class"), r["code"].alias("code"), kept.alias("kept"))

    def counted(r: Column) -> Column:
        times = lambda c: (F.length(r["kept"]) - F.length(F.replace(r["kept"], c, F.lit("")))).cast("double")
        counts = F.transform(_pick(symbols, r["code"]), lambda x: F.struct(times(x["c"]).alias("k"), x["l"].alias("l"), x["m"].alias("m")))
        places = F.transform(F.filter(F.split(r["kept"], ""), lambda c: c != ""), lambda c: F.position(c, _pick(alphabets, r["code"])).cast("double"))
        n = F.length(r["kept"]).cast("double")
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), r["class"].alias("class"), r["code"].alias("code"), n.alias("n"), counts.alias("counts"), places.alias("places"))

    def tested(r: Column) -> Column:
        n, zero = r["n"], F.struct(*(F.lit(0.0).alias(x) for x in ("squares", "plain", "swapped")))

        def seen(t: Column, x: Column) -> Column:
            return F.struct((t["squares"] + x["k"] * x["k"]).alias("squares"), (t["plain"] + x["k"] * x["l"]).alias("plain"), (t["swapped"] + x["k"] * x["m"]).alias("swapped"))

        return F.struct(r["start"].alias("start"), r["end"].alias("end"), r["class"].alias("class"), r["code"].alias("code"), n.alias("n"), r["places"].alias("places"), F.aggregate(r["counts"], zero, seen).alias("sums"))

    def placed(r: Column) -> Column:
        n, a = r["n"], _pick([float(len(x)) for x in alphabets], r["code"])
        k = a - 1
        chi = r["sums"]["squares"] * a / n - n
        uneven = (F.pow(F.greatest(chi, F.lit(0.0)) / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
        battery = F.greatest(uneven, F.lit(0.0)) * F.greatest(uneven, F.lit(0.0)) + _disorder(r, a, n)
        random = F.coalesce((n > 0) & (battery < BATTERY), F.lit(False))
        depth = F.floor(F.least(r["sums"]["plain"], r["sums"]["swapped"]) * (_STEPS / math.log(10))).cast("int")
        depth = F.greatest(F.least(depth, F.lit(_DEEPEST)), F.lit(0))
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), r["class"].alias("class"), F.when(random, depth).otherwise(-1).alias("bin"))

    rows = _spans(text, RUN, 0)
    for step in (read, folded, counted, tested, placed):
        rows = F.transform(rows, step)
    return rows


def thresholds(docs: DataFrame, nulls: dict[str, Null], false_share: float = FALSE_SHARE) -> dict[int, int]:
    """For each class of lengths the least bin that counts as a find. Runs that fail a test of randomness count with p = 1."""
    runs = docs.select(F.explode(_candidates(F.col("text"), nulls)).alias("r")).groupBy(F.col("r.class").alias("class"), F.col("r.bin").alias("bin")).agg(F.count("*").alias("n"))
    by_class: dict[int, dict[int, int]] = {}
    for row in runs.collect():  # at most len(LENGTH_CLASSES) x (_DEEPEST + 2) rows
        by_class.setdefault(row["class"], {})[row["bin"]] = row["n"]
    out = {}
    for group, bins in by_class.items():
        total, found, least = sum(bins.values()), 0, _DEEPEST + 1
        for depth in sorted((b for b in bins if b >= 0), reverse=True):
            found += bins[depth]
            if 10 ** (-depth / _STEPS) * total <= false_share * found:
                least = depth
        out[group] = least
    return out


def with_spans(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``), ``base`` and ``all``: sorted arrays of (start, kind number, end).

    As the columns of ``docs`` travel in the struct, their names clash with nothing.
    """
    nulls = null_of(character_counts(docs))
    least = thresholds(docs, nulls, false_share)
    text = F.coalesce("text", F.lit(""))

    def of_kind(number: int, size: int):
        return lambda s: s["size"] >= size, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"))

    arrays = []
    for number, (_, pattern, group, size) in enumerate(BASE):
        long_enough, told = of_kind(number, size)
        arrays.append(F.transform(F.filter(_spans(text, pattern, group), long_enough), told))
    more = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    if least:

        def found(r: Column) -> Column:
            limit = F.lit(_DEEPEST + 1)
            for group, depth in least.items():
                limit = F.when(r["class"] == group, F.lit(depth)).otherwise(limit)
            return r["bin"] >= limit

        more = F.transform(F.filter(_candidates(text, nulls), found), lambda r: F.struct(r["start"].alias("start"), F.lit(len(BASE)).alias("kind"), r["end"].alias("end")))
    out = docs.select(F.struct("*").alias("row"), F.sort_array(F.concat(*arrays)).alias("base"), more.alias("extra"))
    # a run is within a base span if, of the base spans that start no later, the furthest end is not before its own
    order = lambda spans, extra: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(extra).alias("extra"), s["kind"].alias("kind"), s["end"].alias("end")))
    both = F.sort_array(F.concat(order(F.col("base"), False), order(F.col("extra"), True)))
    reach = lambda spans: _scanned(F.transform(spans, lambda s: F.when(s["extra"], 0).otherwise(s["end"])), lambda a, b: F.greatest(a, b), 0)
    kept = lambda spans: F.filter(F.zip_with(spans, reach(spans), lambda s, far: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), (s["extra"] & (s["end"] <= far)).alias("told"))), lambda s: ~s["told"])
    plain = lambda spans: F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return out.select("row", "base", F.when(F.size("extra") > 0, _bind(both, lambda spans: plain(kept(spans)))).otherwise(F.col("base")).alias("all"))


def _told(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    Spans are kind:start:end of whole matches in code points, end exclusive, by start and then kind. A null text counts as
    empty: no spans, the hash of the empty string. Rows that repeat each return a row; columns besides doc_id and text are
    not read. A run that lies within a base span is not told again.
    """
    spans = with_spans(docs.select("doc_id", "text"), false_share)
    count = lambda of, number: F.size(F.filter(of, lambda s: s["kind"] == number)).cast("long")
    counts = [count("base", i).alias(f"n_{b[0]}") for i, b in enumerate(BASE)]
    return spans.select("row.doc_id", *counts, count("all", len(BASE)).alias("n_random"), F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.col("all")).alias("spans"))


#: Code points of the parts that a text is cut into before pieces are taken out of it.
_PART = 4096


def _parts(text: Column) -> Column:
    """The text in parts of ``_PART`` code points, the last ones shorter or empty: by halves, so that no part is sought from the start."""
    halvings = F.greatest(F.ceil(F.log2(F.greatest(F.length(text), F.lit(1)) / _PART)), F.lit(0)).cast("int")
    sizes = F.filter(F.transform(F.sequence(halvings, F.lit(0), F.lit(-1)), lambda i: (F.pow(F.lit(2), i) * (_PART / 2)).cast("int")), lambda half: half >= _PART)
    return F.aggregate(sizes, F.array(text), lambda parts, half: F.flatten(F.transform(parts, lambda p: F.array(F.substring(p, F.lit(1), half), F.substring(p, half + 1, half)))))


def _marked(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with ``mark`` for each run of spans that overlap; ``spans`` is sorted by start and not empty."""
    reach = _scanned(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), 0)

    def kept(ends: Column, parts: Column) -> Column:
        # what lies between the furthest end so far and the next start, for every span that starts at or after that end
        before = F.concat(F.array(F.lit(0)), ends)
        starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
        between = F.zip_with(before, starts, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        between = F.filter(between, lambda x: (x["b"] >= x["a"]))
        return F.array_join(F.transform(between, lambda x: taken(parts, x["a"], x["b"])), mark)

    def taken(parts: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / _PART).cast("int")
        held = F.slice(parts, first + 1, F.floor(b / _PART).cast("int") - first + 1)
        cut = lambda p, i: F.substring(p, F.when(i == 0, a - first * _PART + 1).otherwise(1), F.when(i == 0, b - a).otherwise(b - (first + i) * _PART))
        return F.array_join(F.transform(held, cut), "")

    return _bind(_parts(text), lambda parts: _bind(reach, lambda ends: kept(ends, parts)))


def redact(docs: DataFrame, mark: str = "[SECRET]", false_share: float = FALSE_SHARE) -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``; ``n_chars``, if there is one, follows the new text.

    Rows without a secret stay as they are, a null text too; rows that repeat are each redacted. All columns are kept, and
    none of their names is reserved. Overlapping spans become one mark.
    """
    rows = with_spans(docs, false_share)
    found = F.size("all") > 0
    rows = rows.select("row", found.alias("found"), F.when(found, _marked(F.col("row.text"), F.col("all"), mark)).otherwise(F.col("row.text")).alias("clean"))
    changed = {"text": F.col("clean"), "n_chars": F.when(F.col("found"), F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))}
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns))
