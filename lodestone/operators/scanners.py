"""Definitions, imports and calls of C, C++, JavaScript, TypeScript, Kotlin and Rust files, by lines and braces.

Comments and string bodies are blanked first, with all line breaks kept. Then each line is read in the scope that the open
braces around it form. No scope is resolved: a call's target is the name as written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

NAME = r"[A-Za-z_$][\w$]*"


@dataclass(frozen=True)
class Rules:
    """Patterns with groups ``name`` (and ``base``) for each kind, patterns of imports, the separator of names, and words that are no calls."""

    kinds: tuple[tuple[str, str], ...]
    imports: tuple[str, ...]
    separator: str
    public: str
    private: str = r"(?!)"
    calls: str = rf"(?P<name>{NAME}(?:(?:\.|::|->){NAME})*)\s*!?\("


_C = Rules(
    (
        ("macro", rf"^\s*#\s*define\s+(?P<name>{NAME})"),
        ("namespace", rf"^\s*(?:inline\s+)?namespace\s+(?P<name>{NAME})\s*{{"),
        ("class", rf"^\s*(?:template\s*<.*>\s*)?class\s+(?P<name>{NAME})[^;(]*{{"),
        ("struct", rf"^\s*(?:typedef\s+)?(?:struct|union)\s+(?P<name>{NAME})[^;(]*{{"),
        ("enum", rf"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?(?P<name>{NAME})[^;(]*{{"),
        ("typedef", rf"^\s*(?:typedef\b.*?\b(?P<name>{NAME})\s*;|using\s+(?P<other>{NAME})\s*=)"),
        ("function", rf"^(?!\s*(?:return|else|if|for|while|switch|do)\b)[\w:<>,*&~\s]*?\b(?P<name>~?{NAME}(?:::~?{NAME})*)\s*\([^;{{}}]*\)[\w\s:,()]*{{"),
    ),
    (r'^\s*#\s*include\s*(?P<name>"[^"]*"|<[^>]*>)',),
    "::",
    r"^(?!\s*static\b)",
)
_JS = Rules(
    (
        ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>{NAME})(?:[^{{]*?\bextends\s+(?P<base>[\w$.]+))?"),
        ("interface", rf"^\s*(?:export\s+)?interface\s+(?P<name>{NAME})"),
        ("enum", rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+(?P<name>{NAME})"),
        ("typedef", rf"^\s*(?:export\s+)?type\s+(?P<name>{NAME})[^=]*="),
        ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{NAME})|^\s*(?:export\s+)?(?:const|let|var)\s+(?P<other>{NAME})\s*=\s*(?:async\s*)?(?:\([^)]*\)|{NAME})\s*=>"),
        ("variable", rf"^(?:export\s+)?(?:const|let|var)\s+(?P<name>{NAME})"),
        ("method", rf"^\s+(?:static\s+|async\s+|get\s+|set\s+|public\s+|private\s+|protected\s+)*(?!(?:if|for|while|switch|catch|return|function)\b)(?P<name>{NAME})\s*\([^)]*\)[^;{{]*{{"),
    ),
    (r"""^\s*(?:import|export)\b.*?\bfrom\s*(?P<name>"[^"]*"|'[^']*')""", r"""^\s*import\s*(?P<name>"[^"]*"|'[^']*')""", r"""\brequire\((?P<name>"[^"]*"|'[^']*')\)"""),
    ".",
    r"^\s*export\b",
)
_KOTLIN = Rules(
    (
        ("interface", rf"^[\w\s]*?\binterface\s+(?P<name>{NAME})"),
        ("enum", rf"^[\w\s]*?\benum\s+class\s+(?P<name>{NAME})"),
        ("class", rf"^[\w\s]*?\b(?:class|object)\s+(?P<name>{NAME})(?:<[^>]*>)?(?:\s*\([^)]*\))?(?:\s*:\s*(?P<base>[\w.]+))?"),
        ("function", rf"^[\w\s]*?\bfun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?(?P<name>{NAME})\s*\("),
        ("typedef", rf"^[\w\s]*?\btypealias\s+(?P<name>{NAME})"),
        ("variable", rf"^(?:[\w]+\s+)*?(?:val|var)\s+(?P<name>{NAME})"),
    ),
    (r"^\s*import\s+(?P<name>[\w.*]+)",),
    ".",
    r"",
    r"\b(?:private|internal|protected)\b",
)
_RUST = Rules(
    (
        ("namespace", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>{NAME})\s*{{"),
        ("impl", rf"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:(?P<base>[\w:]+)(?:<[^{{]*?>)?\s+for\s+)?(?P<name>{NAME})"),
        ("struct", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|union)\s+(?P<name>{NAME})"),
        ("enum", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>{NAME})"),
        ("trait", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>{NAME})(?:\s*:\s*(?P<base>[\w:]+))?"),
        ("typedef", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<name>{NAME})"),
        ("macro", rf"^\s*macro_rules!\s*(?P<name>{NAME})"),
        ("variable", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>{NAME})\s*:"),
        ("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*(?:extern\s+\"[^\"]*\"\s+)?fn\s+(?P<name>{NAME})"),
    ),
    (r"^\s*(?:pub\s+)?use\s+(?P<name>[^;]+);",),
    "::",
    r"^\s*pub\b",
)
RULES = {"c": _C, "cpp": _C, "javascript": _JS, "typescript": _JS, "tsx": _JS, "kotlin": _KOTLIN, "rust": _RUST}
CONTAINERS = ("namespace", "class", "struct", "enum", "interface", "trait", "impl")
#: Words before a parenthesis that are no calls (fixed values).
NO_CALLS = (
    "if", "for", "while", "switch", "catch", "return", "sizeof", "function", "fn", "fun", "def", "match", "when", "elif",
    "else", "do", "throw", "new", "await", "typeof", "defined", "constructor",
)
_TOKENS = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])'|'(?:\\.|[^'\\\n])*'(?=\s*[;,)\]}:])""", re.S)


def blanked(text: str) -> str:
    """Comments and string bodies as spaces; quotes and line breaks stay."""

    def blank(m: re.Match) -> str:
        part = m[0]
        body = re.sub(r"[^\n]", " ", part)
        return body if part[0] == "/" else part[0] + body[1:-1] + part[-1]

    return _TOKENS.sub(blank, text)


def _statement(lines: list[str], n: int, most: int = 12) -> str:
    """The ``n``-th line and those after it up to the first brace or semicolon: heads of definitions may take several lines."""
    head = lines[n]
    if not head.strip() or re.search("[{};#]", head) or head.rstrip().endswith(":"):
        return head
    for line in lines[n + 1 : n + most]:
        mark = re.search("[{};]", line)
        head = f"{head} {line[: mark.end()] if mark else line}"
        if mark:
            return head if mark[0] == "{" else lines[n]
    return lines[n]


def scan(language: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """(name, fqn, kind, first line, last line, exported) of definitions and (source, target, kind, line) of edges. Never raises."""
    rules = RULES.get(language)
    if rules is None:
        return [], []
    plain, raw = blanked(text).split("\n"), text.split("\n")
    symbols: list[list] = []
    edges: list[tuple] = []
    scope: list[tuple[str, str, int, int | None]] = []  # name, kind, depth, its symbol
    depth = 0
    pending = None  # a definition whose brace is still to come
    for n, (line, original) in enumerate(zip(plain, raw, strict=True), 1):
        named = [x[0] for x in scope]
        found, pending = pending, None
        statement = _statement(plain, n - 1) if rules is _C and found is None else line
        if not line.lstrip().startswith("//"):
            for pattern in rules.imports:
                if line.strip() and (m := re.search(pattern, original)):
                    edges.append((rules.separator.join(named), m["name"].strip("\"'<>").strip(), "imports", n))
        in_body = any(k in ("function", "method") for _, k, _, _ in scope)
        for kind, pattern in rules.kinds if found is None else ():
            m = re.match(pattern, statement)
            if not m or (kind in ("variable", "method") and in_body):
                continue
            name = m["name"] or m.groupdict().get("other")
            if kind == "method" and not (scope and scope[-1][1] == "class"):
                continue
            if kind == "function" and scope and scope[-1][1] in ("class", "struct", "interface", "trait", "impl"):
                kind = "method"
            fqn = rules.separator.join([*named, name])
            at = None
            if kind != "impl":
                exported = not any(k not in ("namespace",) for _, k, _, _ in scope) and bool(re.search(rules.public, statement)) and not re.search(rules.private, statement)
                at = len(symbols)
                symbols.append([name.rpartition("::")[2] or name, fqn, kind, n, n, exported])
            if base := m.groupdict().get("base"):
                edges.append((fqn, base, "implements" if kind == "impl" else "extends", n))
            found = (name, kind, depth, at, m.end())
            break
        source = rules.separator.join(named)
        for m in re.finditer(rules.calls, line):
            head = re.split(r"\.|::|->", m["name"])[0]
            if head not in NO_CALLS and not (found and m.start("name") < found[4]) and not line.lstrip().startswith("#"):
                edges.append((rules.separator.join([source, found[0]]).strip(rules.separator) if found else source, m["name"], "calls", n))
        opened = False
        for c in line:
            if c == "{":
                if found and not opened:
                    statement = line
                    scope.append((found[0], found[1], depth, found[3]))
                    opened = True
                depth += 1
            elif c == "}":
                depth = max(0, depth - 1)
                if scope and scope[-1][2] == depth:
                    if (at := scope.pop()[3]) is not None:
                        symbols[at][4] = n
        if found and not opened and statement is not line:
            pending = (*found[:4], 0)
        elif found and not opened and found[4] == 0:
            pending = found
    return [tuple(s) for s in symbols], list(dict.fromkeys(edges))


def _rows(which: int, names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(path, *row) for path, language, text in zip(pdf["path"], pdf["language"], pdf["text"], strict=True) if isinstance(text, str) for row in scan(language, text)[which]]
            yield pd.DataFrame(out, columns=["path", *names])

    return run


def symbols(files: DataFrame) -> DataFrame:
    """Definitions in ``files`` (path, language, text); other languages and null texts give no rows."""
    names = ["name", "fqn", "kind", "start_line", "end_line", "is_exported"]
    return files.select("path", "language", "text").mapInPandas(_rows(0, names), "path string, name string, fqn string, kind string, start_line int, end_line int, is_exported boolean")


def edges(files: DataFrame) -> DataFrame:
    """Imports, calls and base types in ``files`` (path, language, text)."""
    return files.select("path", "language", "text").mapInPandas(_rows(1, ["source", "target", "kind", "line"]), "path string, source string, target string, kind string, line int")
