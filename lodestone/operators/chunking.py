"""From files, symbols and sections to chunks, their headers, the texts to embed, and batches of those."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.functions.hashing import chunk_content_hash, file_content_hash
from lodestone.functions.text import normalize_newlines, segment
from lodestone.operators import intervals
from lodestone.operators.parse import split_text

#: Kinds that become a skeleton, kinds that become no chunk, names of made kinds, and limits.
SKELETONS, CONTAINERS = ("class", "struct"), ("namespace",)
SKELETON, SECTION, FALLBACK, MODULE = "class_skeleton", "spec_block", "fallback_block", "(module)"
HEADER_LINES, BODY_CHARS, NAME_CHARS, ERRORS_MOST = 40, 8_000, 120, 20


def prepare(files: DataFrame) -> DataFrame:
    """``files`` (path, content) as text with language, hash, segmented text and whether it is generated.

    A file that is too large or binary keeps its row, with ``skip_reason`` and no text. Bytes that are not UTF-8 become U+FFFD.
    """
    binary = F.when(paths.is_binary(F.col("content")), "binary")
    rows = paths.with_languages(files.withColumn("skip_reason", F.coalesce(paths.size_reason(F.col("path"), F.length("content")), binary)))
    text = F.when(F.col("skip_reason").isNull(), normalize_newlines(F.make_valid_utf8(F.col("content").cast("string"))))
    rows = rows.withColumn("text", text).withColumn("content_hash", F.when(F.col("skip_reason").isNull(), file_content_hash(F.col("content"))))
    return rows.withColumn("segmented", segment(F.col("text"))).withColumn("generated", F.coalesce(paths.is_generated(F.col("path"), F.col("text")), F.lit(False))).drop("content")


def finalize(symbols: DataFrame) -> DataFrame:
    """One row for each (path, fqn, kind, lines), long names cut."""
    cut = F.substring(F.trim(F.regexp_replace("fqn", r"\s+", " ")), 1, NAME_CHARS)
    own = Window.partitionBy("path", "fqn", "kind", "start_line", "end_line").orderBy("name")
    return symbols.withColumn("fqn", cut).withColumn("n", F.row_number().over(own)).where("n = 1").drop("n")


def first_errors(errors: DataFrame) -> DataFrame:
    """Of each path the first errors (path, line, message) by line."""
    own = Window.partitionBy("path").orderBy("line", "message")
    return errors.withColumn("n", F.row_number().over(own)).where(F.col("n") <= ERRORS_MOST).drop("n")


def first_members(symbols: DataFrame) -> DataFrame:
    """(path, fqn, member_line): of each class or struct the first line of a symbol that its name and its lines hold.

    Prefixes of names, each ending before a dot or colon, meet the holders of that name: in the order of lines, backwards, the
    last member seen is the first from a holder's start on. Work grows with the rows, not with pairs of holders and members.
    """
    none = F.lit(None).cast("int")
    holders = symbols.where(F.col("kind").isin(*SKELETONS)).select("path", "fqn", F.col("start_line").alias("at"), F.col("end_line").alias("to_line"), none.alias("line")).where("at IS NOT NULL").distinct()
    ends = F.filter(F.sequence(F.lit(1), F.length("fqn") - 1), lambda i: F.col("fqn").substr(i + 1, F.lit(1)).isin(".", ":"))
    inner = symbols.where(F.length("fqn") > 1).select("path", F.col("start_line").alias("at"), F.explode(F.transform(ends, lambda i: F.col("fqn").substr(F.lit(1), i))).alias("fqn")).distinct()
    both = holders.unionByName(inner.select("path", "fqn", "at", none.alias("to_line"), F.col("at").alias("line")))
    own = Window.partitionBy("path", "fqn").orderBy(F.desc("at"), F.col("line").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("line", F.min("line").over(own)).where("line <= to_line").groupBy("path", "fqn").agg(F.min("line").alias("member_line"))


def _fallbacks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, first, text in pdf[["path", "start_line", "content"]].itertuples(index=False):
            rows += [(path, first + a - 1, first + b - 1, n, piece) for n, (a, b, piece) in enumerate(split_text(text)) if piece.strip()]
        yield pd.DataFrame(rows, columns=["path", "start_line", "end_line", "piece", "content"])


def structural(files: DataFrame, symbols: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks (id, file_path, symbol_fqn, symbol_kind, start_line, end_line, content, content_hash) of files (path, text).

    One chunk for each symbol (path, fqn, kind, start_line, end_line) but namespaces; a class, or a struct with members, ends
    before its first member. One for each section (path, heading_path, start_line, end_line). Lines that none of them covers
    become fallback chunks, blank ones none. Line ranges are clamped to the file; ranges beyond it are skipped. Further
    fallback chunks of one id get ``#2``, ``#3``...; any other repeated id raises an error. Texts are joined once, to the
    list of their ranges, not to each of them.
    """
    lined = files.where("text IS NOT NULL").select("path", F.split(F.regexp_replace(normalize_newlines(F.col("text")), "\n$", ""), "\n").alias("lines"))
    lined = lined.where("array_join(lines, '') != '' OR size(lines) > 1").withColumn("total", F.size("lines"))
    totals = lined.select("path", "total")
    named = symbols.select("path", "fqn", "kind", "start_line", "end_line").where(~F.col("kind").isin(*CONTAINERS))
    spans = named.unionByName(sections.select("path", F.col("heading_path").alias("fqn"), F.lit(SECTION).alias("kind"), "start_line", "end_line"))
    spans = spans.join(totals, "path").where("start_line >= 1 AND end_line >= start_line AND start_line <= total")
    spans = spans.withColumn("end_line", F.least("end_line", "total"))
    free = intervals.gaps(spans.select("path", "start_line", "end_line"), totals)
    skeleton = (F.col("kind") == "class") | ((F.col("kind") == "struct") & F.col("member_line").isNotNull())
    shown = spans.join(first_members(symbols), ["path", "fqn"], "left").withColumn("skeleton", skeleton)
    shown = shown.withColumn("last", F.when(F.col("skeleton") & (F.col("member_line") > F.col("start_line")), F.col("member_line") - 1).otherwise(F.col("end_line")))
    shown = shown.select("path", "fqn", F.when(F.col("skeleton"), SKELETON).otherwise(F.col("kind")).alias("kind"), "start_line", F.col("last").cast("int").alias("end_line"))
    both = shown.unionByName(free.select("path", F.lit(MODULE).alias("fqn"), F.lit(FALLBACK).alias("kind"), "start_line", F.col("end_line").cast("int").alias("end_line")))
    lists = both.groupBy("path").agg(F.collect_list(F.struct("fqn", "kind", "start_line", "end_line")).alias("ranges"))
    cut = lined.join(lists, "path").select("path", "lines", F.explode("ranges").alias("r")).select("path", "r.*", F.array_join(F.slice("lines", F.col("r.start_line"), F.col("r.end_line") - F.col("r.start_line") + 1), "\n").alias("content"))
    loose = cut.where(F.col("kind") == FALLBACK).select("path", "start_line", "content").mapInPandas(_fallbacks, "path string, start_line int, end_line int, piece int, content string")
    loose = loose.select("path", F.lit(MODULE).alias("fqn"), F.lit(FALLBACK).alias("kind"), "start_line", "end_line", "piece", "content")
    rows = cut.where(F.col("kind") != FALLBACK).withColumn("piece", F.lit(0)).unionByName(loose)
    rows = rows.withColumn("id", F.concat_ws(":", "path", "fqn", F.col("start_line").cast("string")))
    same = Window.partitionBy("id").orderBy((F.col("kind") == FALLBACK), "end_line", "piece")
    rows = rows.withColumn("n", F.row_number().over(same))
    made = F.when(F.col("n") == 1, F.col("id")).when(F.col("kind") == FALLBACK, F.concat_ws("#", "id", F.col("n").cast("string"))).otherwise(F.raise_error(F.concat(F.lit("repeated chunk id: "), "id")))
    return rows.select(made.alias("id"), F.col("path").alias("file_path"), F.col("fqn").alias("symbol_fqn"), F.col("kind").alias("symbol_kind"), "start_line", "end_line", "content", chunk_content_hash(F.col("content")).alias("content_hash"))


_QUIET = re.compile(r"""("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|#.*""")
_OPENS = re.compile(r"""[rRuUbBfF]{0,3}(\"\"\"|'''|"|')""")


def python_header(content: str) -> tuple[str, str]:
    """(signature, docstring): decorators and head up to the line that closes all brackets and ends in a colon; then a literal."""
    lines, depth, size = content.split("\n"), 0, 0
    for line in lines[:HEADER_LINES]:
        size += 1
        code = _QUIET.sub(lambda m: "''" if m[1] else "", line).rstrip()
        depth += sum(map(code.count, "([{")) - sum(map(code.count, ")]}"))
        if depth <= 0 and code.endswith(":"):
            break
    body = "\n".join(lines[size:])
    opened = _OPENS.match(lines[size].strip()) if size < len(lines) else None
    doc = ""
    if opened:
        start = body.index(opened[0]) + len(opened[0])
        stop = body.find(opened[1], start)
        doc = body[start : stop if stop >= 0 else len(body)].strip()
    return "\n".join(lines[:size]).rstrip(), doc


def braced_header(content: str) -> str:
    """What stands before the first brace or semicolon of the first lines."""
    head = "\n".join(content.split("\n")[:HEADER_LINES])
    mark = re.search("[{;]", head)
    return (head[: mark.start()] if mark else head).rstrip() or content.split("\n")[0].strip()


def with_headers(chunks: DataFrame, language: str) -> DataFrame:
    """``chunks`` with signature and docstring. Sections have their heading path as signature, fallback chunks none."""

    @F.pandas_udf("signature string, docstring string")
    def header(content: pd.Series, kind: pd.Series, fqn: pd.Series, lang: pd.Series) -> pd.DataFrame:
        rows = []
        for text, k, name, tongue in zip(content, kind, fqn, lang, strict=True):
            rows.append((name, "") if k == SECTION else ("", "") if k == FALLBACK or not text else python_header(text) if tongue == "python" else (braced_header(text), ""))
        return pd.DataFrame(rows, columns=["signature", "docstring"])

    return chunks.withColumn("h", header("content", "symbol_kind", "symbol_fqn", language)).select("*", "h.signature", "h.docstring").drop("h")


def embedding_text(path: Column, fqn: Column, signature: Column, docstring: Column, content: Column, most: int = BODY_CHARS) -> Column:
    """path :: fqn, signature, docstring and at most so many characters of the body without the signature, with blank lines between."""
    filled = lambda c: F.when(F.length(F.trim(F.regexp_replace(c, r"\s+", " "))) > 0, c)
    head = F.regexp_replace(signature, r"^\s+|\s+$", "")
    leads = (F.length(head) > 0) & F.startswith(F.regexp_replace(content, r"^\s+", ""), head)
    rest = F.regexp_replace(content.substr(F.position(head, content) + F.length(head), F.length(content)), "^\n+", "")
    body = F.when(leads, rest).otherwise(content)
    where = F.when(F.length(fqn) > 0, F.concat(path, F.lit(" :: "), fqn)).otherwise(path)
    return F.concat_ws("\n\n", where, filled(signature), filled(docstring), F.substring(filled(body), 1, most))


def cut_bytes(text: Column, most: int) -> Column:
    """The longest prefix of at most so many UTF-8 bytes that cuts no character."""

    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else t.encode()[:most].decode(errors="ignore"))

    return F.when(F.octet_length(text) <= most, text).otherwise(cut(text))


def cut_tokens(text: Column, most: int, tokenizer_path: str) -> Column:
    """A prefix of at most so many tokens of the tokenizer; shortened until the text, tokenized again, fits."""

    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer_path)

        def fit(t: str | None) -> str | None:
            ids = [] if t is None else model.encode(t, add_special_tokens=False).ids
            for n in range(most, 0, -1):
                if len(ids) <= most:
                    return t
                short = model.decode(ids[:n], skip_special_tokens=False)
                if len(model.encode(short, add_special_tokens=False).ids) <= most:
                    return short
            return t if len(ids) <= most else ""

        return s.map(fit)

    return cut(text)


def batches(rows: DataFrame, tokens: str, count: int, budget: int) -> DataFrame:
    """``rows`` with a batch number: within each task, in its order, at most so many rows and tokens; a row above the budget stands alone."""
    if count < 1 or budget < 1:
        raise ValueError("count and budget must be positive")
    task = F.spark_partition_id().cast("long")

    def number(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = held = used = 0
        for pdf in parts:
            out = []
            for cost in pdf[tokens]:
                if held and (held >= count or used + cost > budget):
                    batch, held, used = batch + 1, 0, 0
                held, used = held + 1, used + cost
                out.append(batch)
            yield pdf.assign(batch=(pdf["_task"].astype("int64") * 2**32 + pd.Series(out, index=pdf.index, dtype="int64"))).drop(columns="_task")

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.withColumn("_task", task).mapInPandas(number, f"{types}, batch long")
