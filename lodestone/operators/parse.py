"""Row generators: files to sections, chunks, symbols and edges. Each is a pure function of (path, text) that never raises."""

from __future__ import annotations

import ast
import bisect
import itertools
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

HEADING = re.compile(r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
FENCE = re.compile(r"^ {0,3}(```+|~~~+)(.*)$")


def markdown_sections(text: str) -> list[tuple[str, str, int, int, int]]:
    """(heading, heading path, level, first line, last line). What comes before the first heading has level 0; fences hide headings."""
    lines = text.split("\n")
    heads: list[tuple[int, int, str]] = []
    fence = ""
    for n, line in enumerate(lines, 1):
        mark = FENCE.match(line)
        if mark and (not fence or (mark[1].startswith(fence) and not mark[2].strip())):
            fence = "" if fence else mark[1]
        elif not fence and (head := HEADING.match(line)):
            heads.append((n, len(head[1]), head[2]))
    out, trail = [], []
    first = heads[0][0] if heads else len(lines) + 1
    if any(x.strip() for x in lines[: first - 1]):
        out.append(("", "", 0, 1, first - 1))
    for i, (n, level, name) in enumerate(heads):
        trail = [t for t in trail if t[0] < level] + [(level, name)]
        end = next((m - 1 for m, other, _ in heads[i + 1 :] if other <= level), len(lines))
        out.append((name, " > ".join(t[1] for t in trail), level, n, end))
    return out


#: Where a text is cut, best places first.
CUTS = ("\n\n", "\n", " ")


def split_text(text: str, max_lines: int = 800, max_chars: int = 40_000) -> list[tuple[int, int, str]]:
    """(first line, last line, piece): lossless pieces within both limits, cut after blank lines, else lines, spaces, or anywhere.

    The parts of one kind of cut are joined again as far as they fit; one that is too large by itself ends what is being
    joined and is cut at the next kind of place. All work is on offsets, so nothing is copied before the end.
    """
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    before = lambda at: bisect.bisect_left(breaks, at)  # noqa: E731  (line ends before an offset)

    def fits(a: int, b: int) -> bool:
        return b - a <= max_chars and before(b) - before(a) + (text[b - 1] != "\n") <= max_lines

    def parts(a: int, b: int, cut: str) -> list[tuple[int, int]]:
        ends = [m.end() for m in re.compile(re.escape(cut)).finditer(text, a, b)]
        return list(itertools.pairwise([a, *(e for e in ends if e < b), b]))

    def pieces(a: int, b: int, kind: int) -> Iterator[tuple[int, int]]:
        if fits(a, b):
            yield a, b
            return
        while kind < len(CUTS) and len(parts(a, b, CUTS[kind])) < 2:
            kind += 1
        if kind == len(CUTS):
            yield from ((at, min(at + max_chars, b)) for at in range(a, b, max_chars))
            return
        held = None
        for start, end in parts(a, b, CUTS[kind]):
            small = fits(start, end)
            if held and small and fits(held[0], end):
                held = held[0], end
                continue
            if held:
                yield held
            held = (start, end) if small else None
            if not small:
                yield from pieces(start, end, kind + 1)
        if held:
            yield held

    return [(1 + before(a), 1 + before(b - 1), text[a:b]) for a, b in pieces(0, len(text), 0)] if text else []


class _Python(ast.NodeVisitor):
    def __init__(self, exported: set[str] | None):
        self.exported, self.scope, self.kinds = exported, [], []
        self.symbols: list[tuple] = []
        self.edges: list[tuple] = []
        self.unresolved: list[tuple] = []

    def _public(self, name: str) -> bool:
        return not self.scope and (name in self.exported if self.exported is not None else not name.startswith("_"))

    def _define(self, node: ast.AST, kind: str) -> None:
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        self.symbols.append((node.name, ".".join([*self.scope, node.name]), kind, first, node.end_lineno, self._public(node.name)))
        for part in node.decorator_list:
            self.visit(part)
        self.scope.append(node.name)
        self.kinds.append(kind)
        for part in node.body:
            self.visit(part)
        self.scope.pop()
        self.kinds.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self._define(node, "method" if self.kinds and self.kinds[-1] == "class" else "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        for base in node.bases:
            if name := dotted(base):
                self.edges.append((".".join([*self.scope, node.name]), name, "extends", node.lineno))
        self._define(node, "class")

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if not self.scope and isinstance(node.target, ast.Name):
            self.symbols.append((node.target.id, node.target.id, "variable", node.lineno, node.end_lineno, self._public(node.target.id)))
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        self.edges += [(".".join(self.scope), a.name, "imports", node.lineno) for a in node.names]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        self.edges += [(".".join(self.scope), f"{module}.{a.name}" if node.module else f"{module}{a.name}", "imports", node.lineno) for a in node.names]

    def visit_Call(self, node: ast.Call) -> None:
        name, source = dotted(node.func), ".".join(self.scope)
        if name in ("getattr", "setattr", "hasattr", "__import__", "importlib.import_module") or name is None:
            self.unresolved.append((source, name or ast.unparse(node.func)[:120], "calls", node.lineno))
        else:
            self.edges.append((source, name, "calls", node.lineno))
        self.generic_visit(node)


def dotted(node: ast.AST) -> str | None:
    """a.b.c of a chain of names, or nothing."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


_DEFINES = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([A-Za-z_]\w*)")


def _statements(text: str) -> Iterator[tuple[int, str]]:
    """(lines before it, text) of each statement of the module, as far as its indentation tells: for files that do not parse."""
    lines = text.split("\n")
    starts = [n for n, line in enumerate(lines) if line[:1].strip() and line[0] not in "#)]}@"]
    for n, at in enumerate(starts):  # decorators belong to what follows
        while at and lines[at - 1].startswith("@"):
            at -= 1
        starts[n] = at
    for a, b in itertools.pairwise([*starts, len(lines)]):
        yield a, "\n".join(lines[a:b])


def _scanned(text: str, first: int, exported: set[str] | None) -> list[tuple]:
    """Symbols of a statement that does not parse: lines that define something, nested by indentation, up to the next such line."""
    lines, trail, out = text.split("\n"), [], []
    for n, line in enumerate(lines):
        if found := _DEFINES.match(line):
            depth, word, name = len(found[1].expandtabs()), found[2], found[3]
            trail = [t for t in trail if t[0] < depth]
            kind = "class" if word == "class" else "method" if trail and trail[-1][1] == "class" else "function"
            end = next((m for m in range(n + 1, len(lines)) if lines[m].strip() and len(lines[m]) - len(lines[m].lstrip()) <= depth), len(lines))
            while end > n + 1 and not lines[end - 1].strip():
                end -= 1
            public = not trail and (name in exported if exported is not None else not name.startswith("_"))
            out.append((name, ".".join([*(t[2] for t in trail), name]), kind, first + n + 1, first + end, public))
            trail.append((depth, kind, name))
    return out


def _exported(body: list[ast.stmt]) -> set[str] | None:
    said = None
    for node in body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets):
            try:
                said = {str(x) for x in ast.literal_eval(node.value)}
            except (ValueError, TypeError):
                said = None
    return said


_UNPARSED = (SyntaxError, ValueError, RecursionError, MemoryError)


def python_rows(text: str) -> tuple[list[tuple], list[tuple], list[tuple], str | None]:
    """Symbols, edges, unresolved references, and the error if the file does not parse as a whole.

    In that case each statement of the module is parsed by itself, and of those that do not parse either the lines that define
    something are read.
    """
    try:
        tree = ast.parse(text)
    except _UNPARSED as e:
        error = f"{type(e).__name__}: {e}"[:200]
    else:
        walk = _Python(_exported(tree.body))
        walk.visit(tree)
        return walk.symbols, walk.edges, walk.unresolved, None
    good, bad = [], []
    for before, part in _statements(text):
        try:
            good.append(ast.increment_lineno(ast.parse(part), before))
        except _UNPARSED:
            bad.append((before, part))
    walk = _Python(_exported([node for tree in good for node in tree.body]))
    for tree in good:
        walk.visit(tree)
    symbols = walk.symbols + [row for before, part in bad for row in _scanned(part, before, walk.exported)]
    return sorted(symbols, key=lambda r: r[3]), walk.edges, walk.unresolved, error


#: Makers of route tables, and methods that register a route.
FACTORIES = ("FastAPI", "APIRouter")
ROUTES = ("get", "post", "put", "delete", "patch", "head", "options", "websocket", "route", "api_route")


def route_rows(text: str) -> list[tuple[str, str, str, int]]:
    """(router, function, path, line) of functions of the module that a decorator registers with a router made in it.

    Only what is plain counts: the maker is imported by name or through its module, the router is bound once, and to a call of it.
    """
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    bound: dict[str, int] = {}
    for node in ast.walk(tree):
        names = [node.id] if isinstance(node, ast.Name) and not isinstance(node.ctx, ast.Load) else [node.name] if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) else []
        names += [(a.asname or a.name).split(".")[0] for a in node.names] if isinstance(node, ast.Import | ast.ImportFrom) else []
        for name in names:
            bound[name] = bound.get(name, 0) + 1
    makers = {a.asname or a.name for n in tree.body if isinstance(n, ast.ImportFrom) and n.module == "fastapi" and not n.level for a in n.names if a.name in FACTORIES}
    makers |= {f"{a.asname or a.name}.{f}" for n in tree.body if isinstance(n, ast.Import) for a in n.names if a.name == "fastapi" for f in FACTORIES}
    once = lambda name: bound.get(name.split(".")[0]) == 1
    made = {t.id: n.lineno for n in tree.body if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and dotted(n.value.func) in makers and once(dotted(n.value.func)) for t in n.targets if isinstance(t, ast.Name) and once(t.id)}
    rows = []
    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            for mark in node.decorator_list:
                router, _, method = (dotted(mark.func) or "").rpartition(".") if isinstance(mark, ast.Call) else ("", "", "")
                if method in ROUTES and made.get(router, node.lineno) < node.lineno:
                    where = mark.args[0].value if mark.args and isinstance(mark.args[0], ast.Constant) else ""
                    rows.append((router, node.name, str(where), mark.lineno))
    return rows


def _per_file(rows: Callable[[str], list[tuple]], names: list[str]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(path, *row) for path, text in zip(pdf["path"], pdf["text"], strict=True) for row in rows(text if isinstance(text, str) else "")]
            yield pd.DataFrame(out, columns=["path", *names])

    return run


def sections(files: DataFrame) -> DataFrame:
    """(path, heading, heading_path, level, start_line, end_line) of Markdown files (path, text)."""
    names = ["heading", "heading_path", "level", "start_line", "end_line"]
    return files.select("path", "text").mapInPandas(_per_file(markdown_sections, names), "path string, heading string, heading_path string, level int, start_line int, end_line int")


def fallback_chunks(files: DataFrame, max_lines: int = 800, max_chars: int = 40_000) -> DataFrame:
    """(path, piece, start_line, end_line, content): numbered pieces of any text; joined in order they are the text again."""
    names = ["piece", "start_line", "end_line", "content"]
    cut = lambda t: [(n, *row) for n, row in enumerate(split_text(t, max_lines, max_chars))]
    return files.select("path", "text").mapInPandas(_per_file(cut, names), "path string, piece int, start_line int, end_line int, content string")


def python_symbols(files: DataFrame) -> DataFrame:
    names = ["name", "fqn", "kind", "start_line", "end_line", "is_exported"]
    return files.select("path", "text").mapInPandas(_per_file(lambda t: python_rows(t)[0], names), "path string, name string, fqn string, kind string, start_line int, end_line int, is_exported boolean")


def python_edges(files: DataFrame, placed: bool = False) -> DataFrame:
    """(path, source, target, kind, line), and if ``placed`` each edge's place in its file: several may stand in one line."""
    names, schema = ["source", "target", "kind", "line"], "path string, source string, target string, kind string, line int"
    if placed:
        numbered = lambda t: [(*row, n) for n, row in enumerate(python_rows(t)[1])]
        return files.select("path", "text").mapInPandas(_per_file(numbered, [*names, "place"]), schema + ", place int")
    return files.select("path", "text").mapInPandas(_per_file(lambda t: python_rows(t)[1], names), schema)


def python_unresolved(files: DataFrame) -> DataFrame:
    names = ["source", "reference", "kind", "line"]
    return files.select("path", "text").mapInPandas(_per_file(lambda t: python_rows(t)[2], names), "path string, source string, reference string, kind string, line int")


def python_routes(files: DataFrame) -> DataFrame:
    """Edges (path, source, target, kind, route, line) of registered routes; always ``registers``, and synthesized."""
    names = ["source", "target", "route", "line"]
    rows = files.select("path", "text").mapInPandas(_per_file(route_rows, names), "path string, source string, target string, route string, line int")
    return rows.selectExpr("path", "source", "target", "'registers' AS kind", "route", "line", "'synthesized' AS provenance")
