"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that count as CJK for the token estimate (fixed values).
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]"


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def runs(text: Column) -> Column:
    """Runs of ASCII letters and digits as they stand. Cut at what lies between, which costs less than finding each of them."""
    return F.array_remove(F.split(text, "[^A-Za-z0-9]+"), "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.transform(runs(text), F.lower)


def segment(text: Column) -> Column:
    """The ASCII path of segmentation: words, and any other visible character by itself, joined by single spaces."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]+|\S"), F.lit(0)), " ")


def estimate_tokens(text: Column) -> Column:
    """ceil(CJK / 1.5 + others / 4), at least 1; 0 for an empty or null text."""
    cjk = F.regexp_count(text, F.lit(CJK))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(cjk / 1.5 + (F.length(text) - cjk) / 4))).cast("long")


def numbered_lines(text: Column, first: Column) -> Column:
    """Each line with its number in front."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line, i: F.concat((i + first).cast("string"), F.lit(" | "), line)), "\n")


def name_tail(name: Column) -> Column:
    """What follows the last dot or double colon."""
    return F.element_at(F.split(F.replace(name, F.lit("::"), F.lit(".")), r"\."), -1)


#: The words of a name, the words of a query, and those that tell nothing.
NAME_WORD = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
QUERY_WORD = r"(?<![A-Za-z0-9_])[A-Za-z]{4,}(?![A-Za-z0-9_])"
STOP_WORDS = (
    "what", "when", "where", "which", "does", "into", "from", "with", "that", "this", "have", "will", "should", "would", "could", "there", "their", "about",
    "after", "before", "code", "file", "function", "method", "class", "implement", "implemented", "implementation", "work", "works", "used", "using", "call",
    "called", "value",
)


def name_words(name: Column) -> Column:
    """Lower-case words of a symbol's full name, each once: acronyms, capitalised and small words, and numbers."""
    return F.array_distinct(F.transform(F.regexp_extract_all(name, F.lit(NAME_WORD), F.lit(0)), F.lower))


def query_words(query: Column) -> Column:
    """Lower-case words of four letters or more that stand by themselves in a query, each once, without stop words."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(query, F.lit(QUERY_WORD), F.lit(0)), F.lower))
    return F.array_except(found, F.array(*(F.lit(w) for w in STOP_WORDS)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def l2_normalize(v: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x / norm))


def format_bytes(n: Column) -> Column:
    """Bytes with a binary unit and one decimal."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", n / float(1024**power)), F.lit(f" {unit}"))).otherwise(out)
    return out


def relative_age(seconds: Column) -> Column:
    """just now / n minutes / hours / days ago."""
    told = lambda unit, size: F.concat((F.floor(seconds / size)).cast("string"), F.lit(f" {unit} ago"))
    return F.when(seconds < 60, F.lit("just now")).when(seconds < 3600, told("minutes", 60)).when(seconds < 86400, told("hours", 3600)).otherwise(told("days", 86400))
