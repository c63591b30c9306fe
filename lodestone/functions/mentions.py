"""What a query or a text names outright: symbols, paths, identifiers and literal phrases.

Each function reads one string; ``named`` and ``phrases`` apply them to a table of queries in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions that make a word with a dot a path.
PATH_EXTENSIONS = (
    "bash", "c", "cc", "cfg", "cmake", "cpp", "cs", "cxx", "go", "gradle", "h", "hh", "hpp", "hxx", "ini", "ipp", "java", "js", "json", "jsx", "kt",
    "kts", "lua", "m", "md", "mm", "php", "pl", "ps1", "py", "pyi", "r", "rb", "rs", "scala", "sh", "sql", "swift", "toml", "tpp", "ts", "tsx",
    "txt", "yaml", "yml",
)
#: Forms of names.
BACKTICK = re.compile(r"`([^`]+)`")
PATH = re.compile(r"(?<![\w./\-])([\w.\-/]+\.[A-Za-z][A-Za-z0-9]{0,9})(?![\w/\-])")
CHAIN = re.compile(r"(?<![\w.:])([A-Za-z_]\w*(?:(?:::|\.)[A-Za-z_]\w*)+)(?![\w.])")
NAME = re.compile(r"[A-Za-z_]\w*(?:(?:::|\.)[A-Za-z_]\w*)*")
CAMEL = re.compile(r"\b[a-z][a-z0-9]*(?:[A-Z][a-z0-9]*)+\b")
PASCAL = re.compile(r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b")
SNAKE = re.compile(r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b")
SCREAMING = re.compile(r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b")
QUOTED = re.compile(r'"([^"]+)"|“([^”]+)”|‘([^’]+)’')
BARE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._:/=\-]{5,}")
INLINE_CODE = re.compile(r"`+([^`\n]+?)`+")
#: Least length of a literal and of a root, most phrases, and bounds of a whole sentence.
LITERAL_LEAST, ROOT_LEAST, PHRASES_MOST, SENTENCE, SENTENCE_WORDS, SENTENCE_ASCII = 6, 8, 6, (12, 200), 4, 0.9


class Phrase(NamedTuple):
    text: str
    strong: bool


def is_path(word: str) -> bool:
    stem, dot, ending = word.rpartition(".")
    return bool(stem and dot) and ending.lower() in PATH_EXTENSIONS


def _cut(pattern: re.Pattern, text: str, wanted: Callable[[str], bool] = lambda _: True) -> tuple[list[str], str]:
    """What ``pattern`` finds and is wanted, and the text with blanks in its place."""
    found: list[str] = []

    def blank(m: re.Match) -> str:
        if not wanted(m[1]):
            return m[0]
        found.append(m[1].strip())
        return " " * len(m[0])

    return found, pattern.sub(blank, text)


def explicit(query: str | None) -> list[tuple[str, str]]:
    """(symbol or path, text) that a query names: in backticks, as a path with a known extension, or as a chain of names."""
    ticked, rest = _cut(BACKTICK, query or "")
    paths, rest = _cut(PATH, rest, is_path)
    chains, _ = _cut(CHAIN, rest)
    rows = [("path" if is_path(t) else "symbol", t) for t in ticked if is_path(t) or NAME.fullmatch(t)]
    return list(dict.fromkeys(rows + [("path", t) for t in paths] + [("symbol", t) for t in chains]))


def inferred(query: str | None) -> list[str]:
    """Camel, Pascal, snake and upper snake words outside of what is named outright, in the order of the text."""
    rest = query or ""
    for pattern, wanted in ((BACKTICK, lambda _: True), (PATH, is_path), (CHAIN, lambda _: True)):
        rest = _cut(pattern, rest, wanted)[1]
    hits = sorted((m.start(), m[0]) for p in (CAMEL, SNAKE, SCREAMING, PASCAL) for m in p.finditer(rest))
    return list(dict.fromkeys(word for _, word in hits))


def _strong_word(word: str) -> bool:
    return any(c in word for c in "-=/:.") or word.isupper() or word.isdigit()


def literal_phrases(query: str | None, covered: tuple[str, ...] = ()) -> list[Phrase]:
    """At most six phrases worth a literal search, strong ones first.

    Strong: in backticks or quotes; the whole query where nothing is quoted and it reads as a sentence; words with structure, in
    upper case or of digits. Weak: other long words that the symbol channels do not cover.
    """
    query = query or ""
    strong = dict.fromkeys(t for m in BACKTICK.finditer(query) if len(t := m[1].strip()) >= LITERAL_LEAST)
    strong |= dict.fromkeys(t for m in QUOTED.finditer(query) if len(t := next(filter(None, m.groups())).strip()) >= LITERAL_LEAST)
    whole = query.strip().strip("`\"'“”‘’").strip()
    ascii_share = sum(c.isascii() for c in whole) / max(len(whole), 1)
    if not strong and SENTENCE[0] <= len(whole) <= SENTENCE[1] and len(re.findall(r"[A-Za-z0-9_]+", whole)) >= SENTENCE_WORDS and ascii_share >= SENTENCE_ASCII:
        strong[whole] = None
    known, weak = {c.lower() for c in covered}, {}
    for word in BARE.findall(query):
        if _strong_word(word):
            strong.setdefault(word)
        elif len(word) >= ROOT_LEAST and word.lower() not in known and word not in strong:
            weak[word] = None
    return ([Phrase(t, True) for t in strong] + [Phrase(t, False) for t in weak])[:PHRASES_MOST]


#: Forms of names in prose.
PROSE_EXTENSIONS = "py|pyi|c|h|cc|cpp|cxx|hpp|hh|hxx|js|jsx|mjs|cjs|ts|tsx|mts|cts|kt|kts|rs|md|markdown|json|toml|yaml|yml"
PROSE = (
    re.compile(r"\b(?:[a-z][a-z0-9]*[A-Z][A-Za-z0-9]*|[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*)\b"),
    re.compile(r"\b(?:[a-z][a-z0-9]*)(?:_[a-z0-9]+)+\b|\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b"),
    re.compile(r"\b[A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*)+\b"),
    re.compile(rf"(?:[A-Za-z0-9_.@~-]+/)+[A-Za-z0-9_.@~-]+\.(?:{PROSE_EXTENSIONS})\b|[A-Za-z0-9_-]+\.(?:{PROSE_EXTENSIONS})\b"),
)


def mentioned(text: str | None) -> list[str]:
    """Inline code and words in the form of names, each once, by first place."""
    hits = [(m.start(1), 0, m[1].strip()) for m in INLINE_CODE.finditer(text or "")]
    hits += [(m.start(), n, m[0]) for n, p in enumerate(PROSE, 1) for m in p.finditer(text or "")]
    return list(dict.fromkeys(word for _, _, word in sorted(hits) if word))


def _exploded(rows: DataFrame, key: str, text: str, of: Callable[[str], list[tuple]], names: list[str], types: str) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, n, *row) for k, t in zip(pdf[key], pdf[text], strict=True) for n, row in enumerate(of(t))], columns=[key, "position", *names])

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, position int, {types}")


def named(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, kind, token): explicit symbols and paths, then inferred identifiers, each numbered from 0 over both."""
    return _exploded(queries, key, text, lambda t: [*explicit(t), *(("inferred", w) for w in inferred(t))], ["kind", "token"], "kind string, token string")


def phrases(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, phrase, strong); what the symbol channels cover is no weak phrase."""
    covered = lambda t: (*(w for _, w in explicit(t)), *inferred(t))
    return _exploded(queries, key, text, lambda t: [tuple(p) for p in literal_phrases(t, covered(t))], ["phrase", "strong"], "phrase string, strong boolean")


def mentions(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, mention) of prose."""
    return _exploded(texts, key, text, lambda t: [(w,) for w in mentioned(t)], ["mention"], "mention string")


def lexical_query(query: Column) -> Column:
    """A query for the lexical index: backticks and double colons are blanks."""
    return F.regexp_replace(query, "`|::", " ")


def lexical_tokens(tokens: Column) -> Column:
    """Without tokens that hold no letter and no digit."""
    return F.filter(tokens, lambda t: t.rlike(r"[\p{L}\p{N}]"))
