"""Selecting evidence under a token budget."""

from __future__ import annotations

import math
from collections import namedtuple
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import estimate_tokens
from lodestone.operators.rendering import focused


@dataclass(frozen=True)
class Budget:
    """Limits of a pack (fixed values), all in tokens but for shares and counts.

    ``floor``: least share of the best code score; ``relaxed``: lower floors, tried while less than ``under_filled`` is used.
    ``core``: share of the best code score from which on the limit of a file does not hold. ``graph_share``: what chunks found
    by the graph may take of what is used. ``near``: lines between two ranges that still make one.
    """

    tokens: int = 14_000
    overhead: int = 500
    floor: float = 0.4
    relaxed: tuple[float, ...] = (0.2, 0.1, 0.04)
    under_filled: float = 0.35
    per_file: int = 2_500
    core: float = 0.7
    graph_share: float = 0.3
    docs: int = 950
    code_least: int = 2
    near: int = 10


def prefix(rows: DataFrame, group: str, order: list, tokens: str, budget: int) -> DataFrame:
    """Items in order while their running total stays within the budget."""
    own = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(tokens).over(own)).where(F.col("running") <= budget)


@dataclass
class _Item:
    """What one place of a pack shows: a chunk, or several whose lines lie near each other."""

    path: str
    spec: bool
    lines: set[int]
    chunks: list[tuple]  # (chunk, form, tokens)


class _Pack:
    """The state of a pack while candidates are offered to it."""

    def __init__(self, budget: Budget):
        self.budget, self.used, self.graph, self.docs = budget, budget.overhead, 0, 0
        self.files: dict[str, int] = {}
        self.items: list[_Item] = []
        self.held: set = set()
        self.symbols: set[tuple] = set()

    def _near(self, c) -> _Item | None:
        if not c.lines:
            return None
        first, last = min(c.lines), max(c.lines)
        for item in self.items:
            if item.path == c.path and item.spec == (c.kind == "spec") and any(first - self.budget.near - 1 <= n <= last + self.budget.near + 1 for n in item.lines):
                return item
        return None

    def offer(self, c, limit: int, per_file: float, free_doc: bool = False) -> str:
        """taken, skipped (it breaks a limit of its own) or full (the pack's limit is reached)."""
        b, spec = self.budget, c.kind == "spec"
        if c.chunk_id in self.held or (c.symbol and (c.path, c.symbol) in self.symbols):
            return "skipped"
        in_file = self.files.get(c.path, 0)
        form, tokens = "whole", c.tokens
        fits = lambda n: in_file + n <= per_file and self.used + n <= limit
        smaller = [f for f in c.forms if f[1] < tokens]
        if smaller and not fits(tokens):
            form, tokens = next((f for f in smaller if fits(f[1])), smaller[-1])
        if in_file + tokens > per_file or (c.tier == 3 and self.graph + tokens > b.graph_share * self.used) or (spec and not free_doc and self.docs + tokens > b.docs):
            return "skipped"
        if self.used + tokens > limit:
            return "full"
        item = self._near(c)
        if item is None:
            item = _Item(c.path, spec, set(), [])
            self.items.append(item)
        elif form == "whole":  # only lines that are not shown yet cost
            tokens = -(-tokens * len(c.lines - item.lines) // len(c.lines))
            form = "merged"
        item.lines |= c.lines
        item.chunks.append((c.chunk_id, form, tokens))
        self.used += tokens
        self.files[c.path] = in_file + tokens
        self.graph += tokens if c.tier == 3 else 0
        self.docs += tokens if spec else 0
        self.held.add(c.chunk_id)
        if c.symbol:
            self.symbols.add((c.path, c.symbol))
        return "taken"


def _packed(candidates: list, budget: Budget, floor: float) -> tuple[_Pack, bool]:
    """The pack of one query's candidates in their order, and whether anything was left out."""
    code = [c for c in candidates if c.kind != "spec"]
    top = max((c.score for c in code), default=0.0)
    docs = budget.docs if code else budget.tokens
    pack = _Pack(replace(budget, docs=docs))
    reserved = next((c for c in candidates if c.kind == "spec"), None)
    for c in candidates:
        if c.tier > 0 and top > 0 and c.score < floor * top:
            continue
        kept_free = reserved.tokens if reserved is not None and reserved.chunk_id not in pack.held and c is not reserved else 0
        core = c.kind != "spec" and c.score >= budget.core * top
        if pack.offer(c, max(budget.tokens - kept_free, budget.overhead), math.inf if core else budget.per_file, c is reserved) == "full":
            break
    if reserved is not None:
        pack.offer(reserved, budget.tokens, math.inf, True)
    for c in code:
        if sum(len(i.chunks) for i in pack.items if not i.spec) >= budget.code_least:
            break
        pack.offer(c, budget.tokens, budget.per_file)
    return pack, len(pack.held) < len(candidates)


FORMS = "array<struct<form:string,tokens:long>>"


def with_forms(candidates: DataFrame, content: str, heads: tuple[int, ...] = (40, 15, 5), focus: tuple[int, ...] = (), query: str | None = None, calls: str | None = None) -> DataFrame:
    """``candidates`` with ``forms``: what a chunk costs in smaller forms, the largest first, as rendered and estimated.

    "head n" shows the first n lines; "focus n" the n lines that matter most to the column ``query`` (``rendering.focused``, with
    path, start_line and the lines in ``calls``). A form that costs as much as another is listed after it in the order given; a null
    content has forms of no cost.
    """
    lines = F.split(F.col(content), "\n")
    told = [(f"head {n}", F.array_join(F.slice(lines, 1, n), "\n")) for n in heads]
    if focus:
        near = F.col(calls) if calls else F.array().cast("array<int>")
        told += [(f"focus {n}", F.array_join(F.transform(focused(F.col(content), F.col("start_line"), F.col(query), F.col("path"), near, n), lambda s: s["text"]), "\n")) for n in focus]
    costs = F.array(*(F.struct((-estimate_tokens(shown)).alias("less"), F.lit(i).alias("nr"), F.lit(form).alias("form")) for i, (form, shown) in enumerate(told)))
    return candidates.withColumn("forms", F.transform(F.array_sort(costs), lambda f: F.struct(f["form"].alias("form"), (-f["less"]).cast("long").alias("tokens"))))


def assemble(candidates: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Greedy packing of each query's candidates (a pool of bounded size): explicit ones first, then by score.

    ``candidates``: query_id, chunk_id, path, kind, tier, score, tokens; and, where they are known, symbol_fqn, start_line,
    end_line, and forms (see ``with_forms``: what a chunk costs when less of it is shown) or head_tokens, the cost of one form named
    head. Below a share of the
    best code score only explicit ones count. A file, documents and chunks of the graph have limits of their own; the best
    document is kept room for, and two chunks of code are taken if there are any. Of a symbol one chunk is taken; ranges of a
    file that lie near each other become one item, which pays for its lines once; what does not fit whole takes the largest form that
    fits.
    Where little of the budget is used though something was left out, lower floors are tried and the fullest pack is kept.

    Returns query_id, chunk_id, position (of the item), form (whole, merged, or the name of one), tokens, used (by the pack, overhead included).
    """
    there = set(candidates.columns)
    optional = {"symbol_fqn": "string", "start_line": "int", "end_line": "int", "head_tokens": "long", "forms": FORMS}
    rows = candidates.select("query_id", "chunk_id", "path", "kind", "tier", "score", "tokens", *((F.col(c) if c in there else F.lit(None)).cast(kind).alias(c) for c, kind in optional.items()))
    said = namedtuple("Said", "chunk_id path kind tier score tokens symbol lines forms")

    def read(r) -> tuple:
        ranged = r.start_line == r.start_line and r.start_line is not None and r.end_line == r.end_line and r.end_line is not None
        forms = [(f["form"], int(f["tokens"])) for f in r.forms] if r.forms is not None else []
        if r.head_tokens == r.head_tokens and r.head_tokens is not None:
            forms.append(("head", int(r.head_tokens)))
        return said(r.chunk_id, r.path or "", r.kind, int(r.tier), float(r.score), int(r.tokens), r.symbol_fqn or "", set(range(int(r.start_line), int(r.end_line) + 1)) if ranged else set(), forms)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pool = sorted(map(read, pdf.itertuples(index=False)), key=lambda c: (c.tier > 0, -c.score, c.chunk_id))
        best, left_out = _packed(pool, budget, budget.floor)
        for floor in budget.relaxed:
            if best.used >= budget.under_filled * budget.tokens or not left_out:
                break
            again, missing = _packed(pool, budget, floor)
            if again.used > best.used:
                best, left_out = again, missing
        out = [(pdf["query_id"].iloc[0], chunk, n, form, tokens, best.used) for n, item in enumerate(best.items, 1) for chunk, form, tokens in item.chunks]
        return pd.DataFrame(out, columns=["query_id", "chunk_id", "position", "form", "tokens", "used"])

    types = {c: candidates.schema[c].dataType.simpleString() for c in ("query_id", "chunk_id")}
    return rows.groupBy("query_id").applyInPandas(pack, f"query_id {types['query_id']}, chunk_id {types['chunk_id']}, position int, form string, tokens long, used long")


def render_groups(packed: DataFrame, related_tokens: int = 3000) -> DataFrame:
    """core, related, tests or docs for each packed item, and whether a related item's body still fits."""
    top = F.max(F.when(F.col("kind") != "spec", F.col("score"))).over(Window.partitionBy("query_id"))
    group = F.when(F.col("kind") == "spec", "docs").when(F.col("kind") == "test", "tests").when(F.col("score") >= 0.7 * top, "core").otherwise("related")
    rows = packed.withColumn("section", group)
    running = F.sum("tokens").over(Window.partitionBy("query_id", "section").orderBy(F.desc("score"), "chunk_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("with_body", (F.col("section") != "related") | (running <= related_tokens))


#: Files that must agree, how far the best agreeing score must lie above the median, candidates that make sure.
FILES_LEAST, PEAK_RATIO, AGREEING_LEAST = 2, 2.15, 3


def answerability(candidates: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """(query_id, files, answerable, confidence): whether a pool of candidates supports an answer, and how well.

    ``candidates``: query_id, chunk_id, path, kind, score, channels (how many found it), and of explicit, inferred and literal
    (whether a name, a guessed name or a quoted text hit) those that there are. ``context``: query_id, structural (the graph
    gave the answer), boundary (the graph ends outside), has_code (the index has code), spec_only (only documents were packed);
    what is absent or null is false, but has_code is true.

    A name, a guessed name, a quoted text in code or a structural answer is enough. Else two files must agree, and either the
    best candidate is found by two channels, or an agreeing one reaches 2.15 times the median. In an index with code, such
    agreement must include code.
    """
    there = lambda c, columns, other: F.coalesce(F.col(c), F.lit(other)) if c in columns else F.lit(other)
    hit = lambda c: there(c, candidates.columns, False)
    agree, code = F.col("channels") >= 2, F.col("kind").isin("code", "test")
    rows = candidates.groupBy("query_id").agg(
        F.count_if(hit("explicit")).alias("explicit"),
        F.count_if(hit("inferred")).alias("inferred"),
        F.count_if(hit("literal") & code).alias("literal"),
        F.count_if(agree).alias("agreeing"),
        F.count_distinct(F.when(agree, F.coalesce("path", F.col("chunk_id").cast("string")))).alias("files"),
        F.coalesce(F.bool_or(agree & code), F.lit(False)).alias("agreeing_code"),
        F.max(F.when(agree, F.col("score"))).alias("peak"),
        F.median("score").alias("middle"),
        F.min_by("channels", F.struct(-F.col("score"), "chunk_id")).alias("top_channels"),
    )
    known = context.columns if context is not None else []
    rows = rows.join(context, "query_id", "left") if context is not None else rows
    said = {c: there(c, known, c == "has_code") for c in ("structural", "boundary", "has_code", "spec_only")}
    hard = (F.col("explicit") + F.col("inferred") + F.col("literal") > 0) | said["structural"]
    strong = (F.col("middle") > 0) & (F.col("peak") >= PEAK_RATIO * F.col("middle"))
    backed = (F.col("files") >= FILES_LEAST) & ((F.col("top_channels") >= 2) | F.coalesce(strong, F.lit(False))) & (F.col("agreeing_code") | ~said["has_code"])
    level = F.when((F.col("explicit") > 0) & (F.col("agreeing") >= AGREEING_LEAST) & ~said["boundary"], "high")
    level = level.when(((F.col("agreeing") > 0) & (F.col("explicit") == 0)) | said["spec_only"] | (F.col("literal") > 0), "medium").otherwise("low")
    return rows.select("query_id", "files", (hard | backed).alias("answerable"), F.when(hard | backed, level).otherwise("low").alias("confidence"))
