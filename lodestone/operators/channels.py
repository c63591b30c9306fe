"""Recall channels for batches of queries, their union, and the merged pool of candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import chunk_kind, path_matches
from lodestone.operators import recall
from lodestone.operators.fusion import POOL, reciprocal_rank_fusion
from lodestone.operators.phrases import Positions, phrase_top_k

#: Needles that one automaton holds; more of them are joined by grams of so many characters.
BLOCK, GRAM = 20_000, 4
#: Fixed order of the channels, in which reasons are merged.
CHANNELS = ("exact", "inferred", "bm25", "vector", "literal")


def first_seen(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of rows that agree in ``keys`` the first in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def _limited(hits: DataFrame, query: str, order: list, k: int) -> DataFrame:
    """(query, chunk_id, rank, detail): each chunk at its first place, the first k."""
    return recall.ranked(first_seen(hits, [query, "chunk_id"], order), query, [*order, "chunk_id"], k).select(query, "chunk_id", "rank", "detail")


def symbol_recall(symbols: DataFrame, tokens: DataFrame, query: str, spellings: bool, k: int = 20) -> DataFrame:
    """(query, chunk_id, rank, detail) of symbols whose name or fqn is a token (query, position, token), in the order of tokens.

    With ``spellings`` a token is tried as it stands, then with dots for double colons, then the reverse.
    """
    forms = F.array_distinct(F.array("token", F.replace("token", F.lit("::"), F.lit(".")), F.replace("token", F.lit("."), F.lit("::")))) if spellings else F.array("token")
    wanted = tokens.select(query, "position", F.posexplode(forms).alias("form", "wanted"))
    held = symbols.where("chunk_id IS NOT NULL")
    hits = held.join(wanted, F.col("name") == F.col("wanted")).unionByName(held.join(wanted, F.col("fqn") == F.col("wanted"))).withColumn("detail", F.col("wanted"))
    order = ["position", "form", F.desc("is_exported"), F.desc(F.col("fqn") == F.col("wanted")), "file_path", F.col("start_line").asc_nulls_last(), "id"]
    return _limited(hits, query, order, k)


def _found(needles: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for n, needle in enumerate(needles):
            machine.add_word(needle, n)
        if needles:
            machine.make_automaton()
        for batch in batches:
            rows, which, times = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for n in sorted({n for _, n in machine.iter(text)}) if text and needles else ():
                    rows.append(i)
                    which.append(needles[n])
                    times.append(text.count(needles[n]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(which, pa.string()), pa.array(times, pa.int64())], ["chunk_id", "low", "times"])

    return run


def occurrences(rows: DataFrame, text: str, needles: DataFrame) -> DataFrame:
    """(chunk_id, low, times): which of the needles (low) a text holds, and how often without overlap.

    Up to ``BLOCK`` different needles, which is counted first, go to the tasks as one Aho-Corasick automaton, and each text is read
    once. More of them stay a table and meet the texts by joins (``_by_grams``).
    """
    asked = needles.select("low").where("low <> ''").distinct()
    known = [r["low"] for r in asked.limit(BLOCK + 1).collect()]
    if len(known) > BLOCK:
        return _by_grams(rows, text, asked)
    kind = rows.schema["chunk_id"].dataType.simpleString()
    return rows.select("chunk_id", text).mapInArrow(_found(sorted(known)), f"chunk_id {kind}, low string, times long")


def _by_grams(rows: DataFrame, text: str, asked: DataFrame) -> DataFrame:
    """The same for any number of needles: a needle meets the texts that hold the rarest of its grams, and is looked for in these.

    A gram is four characters in a row, or a shorter needle itself. Texts' grams are met by an equi join with those of the needles.
    """
    of = lambda column, n: F.regexp_extract_all(column, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    sizes = sorted(r["n"] for r in asked.select(F.least(F.length("low"), F.lit(GRAM)).alias("n")).distinct().collect())  # four numbers at most
    own = F.coalesce(*(F.when(F.least(F.length("low"), F.lit(GRAM)) == n, of("low", n)) for n in sizes))
    wanted = asked.select("low", F.explode(F.array_distinct(own)).alias("gram"))
    held = rows.select("chunk_id", F.explode(F.array_distinct(F.concat(*(of(F.col(text), n) for n in sizes)))).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi")
    often = held.groupBy("gram").agg(F.count("*").alias("df"))
    # a needle with a gram that no text holds stands nowhere
    rarest = wanted.join(often, "gram", "left").groupBy("low").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("first")).where("first.df > 0")
    pairs = held.join(rarest.select("low", F.col("first.gram").alias("gram")), "gram").select("chunk_id", "low")
    plain = rows.select("chunk_id", F.col(text).alias("plain")).join(pairs, "chunk_id").where(F.contains("plain", F.col("low")))
    times = (F.length("plain") - F.length(F.replace("plain", F.col("low"), F.lit("")))) / F.length("low")
    return plain.select("chunk_id", "low", times.cast("long").alias("times"))


def literal_many(chunks: DataFrame, needles: DataFrame, k: int = 30) -> DataFrame:
    """(needle, chunk_id, in_name, times, rank) for each distinct needle (needle) over chunks (chunk_id, symbol_fqn, content)."""
    low = needles.select("needle", F.lower("needle").alias("low")).distinct().where(F.length("needle") >= 4)
    rows = chunks.select("chunk_id", F.lower("symbol_fqn").alias("name"), F.lower(F.concat_ws("\n", "symbol_fqn", "content")).alias("blob"))
    about = rows.select("chunk_id", "name", F.length("blob").alias("span"))
    hit = occurrences(rows, "blob", low).join(about, "chunk_id").join(low, "low")
    hit = hit.select("needle", "chunk_id", F.coalesce(F.contains("name", F.col("low")), F.lit(False)).alias("in_name"), "times", "span")
    return recall.ranked(hit, "needle", [F.desc("in_name"), F.desc("times"), "span", "chunk_id"], k).drop("span")


def names_many(symbols: DataFrame, needles: DataFrame, k: int = 20) -> DataFrame:
    """(needle, chunk_id, rank): symbols whose name holds the needle, shorter names first."""
    low = needles.select("needle", F.lower("needle").alias("low")).distinct()
    names = symbols.where("chunk_id IS NOT NULL").select("chunk_id", "name", F.lower("name").alias("lower_name"))
    each = names.select(F.col("lower_name").alias("chunk_id"), F.col("lower_name").alias("text")).distinct()
    hit = occurrences(each, "text", low).select(F.col("chunk_id").alias("lower_name"), "low").join(names, "lower_name").join(low, "low").select("needle", "chunk_id", "name")
    return recall.ranked(hit, "needle", [F.length("name"), "name", "chunk_id"], k).drop("name")


def literal_recall(chunks: DataFrame, symbols: DataFrame, phrases: DataFrame, query: str, k: int = 30, positions: Positions | None = None) -> DataFrame:
    """(query, chunk_id, rank, detail, tier) of phrases (query, position, phrase, strong).

    Strong phrases of several words are sought as adjacent words, other strong ones as substrings, weak ones in names of symbols.
    With a stored positional index of the chunks (its key chunk_id) adjacent words are found there, best by BM25 first; without one
    in the texts, most frequent first.
    """
    spaced = F.contains("phrase", F.lit(" "))
    parts = [phrases.where(c) for c in (F.col("strong") & spaced, F.col("strong") & ~spaced, ~F.col("strong"))]
    asked = parts[0].select(F.col("phrase").alias("needle"), F.col("phrase").alias("words")).distinct()
    found = [
        (recall.scanned_phrase(chunks, "chunk_id", "content", asked, "needle", "words", k) if positions is None else phrase_top_k(positions, "chunk_id", asked, "needle", "words", k)).select("needle", "chunk_id", F.col("rank").alias("place")),
        literal_many(chunks, parts[1].select(F.col("phrase").alias("needle")), k).select("needle", "chunk_id", F.col("rank").alias("place")),
        names_many(symbols, parts[2].select(F.col("phrase").alias("needle"))).select("needle", "chunk_id", F.col("rank").alias("place")),
    ]
    hits = None
    for part, rows in zip(parts, found, strict=True):
        one = part.join(rows, F.col("phrase") == F.col("needle")).select(query, "position", "place", "chunk_id", F.col("phrase").alias("detail"), "strong")
        hits = one if hits is None else hits.unionByName(one)
    order = ["position", "place"]
    once = first_seen(hits, [query, "chunk_id"], order)
    return recall.ranked(once, query, [*order, "chunk_id"], k).select(query, "chunk_id", "rank", "detail", F.when(F.col("strong"), 0).otherwise(1).alias("tier"))


def gather(channels: dict[str, Callable[[], DataFrame]], query: str, optional: tuple[str, ...] = ("vector",)) -> tuple[DataFrame, list[str]]:
    """All channels' rows as (query, channel, chunk_id, rank, tier, detail), and the optional channels that failed when planned.

    Channels build their plans here; an optional one that cannot (its table is missing, its model unreachable) is left out by name.
    """
    rows, failed = None, []
    for name, build in channels.items():
        try:
            part = build()
        except (PySparkException, OSError, TimeoutError) as e:
            if name not in optional:
                raise
            failed.append(f"{name}: {type(e).__name__}")
            continue
        tier = F.col("tier") if "tier" in part.columns else F.lit({"exact": 0, "vector": 2}.get(name, 1))
        detail = F.col("detail") if "detail" in part.columns else F.lit(name)
        part = part.select(query, F.lit(name).alias("channel"), "chunk_id", "rank", tier.cast("int").alias("tier"), detail.alias("detail"))
        rows = part if rows is None else rows.unionByName(part)
    return rows, failed


def merge(rows: DataFrame, chunks: DataFrame, query: str, named_paths: DataFrame | None = None, pool: int = POOL) -> DataFrame:
    """The pool of candidates: fused ranks, the least tier, distinct reasons in the order of channels, and the chunk's place.

    The pool is cut before chunks are joined; chunks that are gone drop out. A candidate in a path that its query names
    (``named_paths``: query, path) is of tier 0.
    """
    place = F.coalesce(F.array_position(F.array(*(F.lit(c) for c in CHANNELS)), F.col("channel")), F.lit(0))
    reasons = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("at"), "rank", "detail"))), lambda r: r["detail"]))
    about = rows.groupBy(query, "chunk_id").agg(F.min("tier").alias("tier"), reasons.alias("reasons"))
    fused = reciprocal_rank_fusion(rows.select(query, "channel", "chunk_id", "rank"), query, "chunk_id", pool).join(about, [query, "chunk_id"])
    meta = chunks.select("chunk_id", F.col("file_path").alias("path"), "symbol_fqn", chunk_kind(F.col("symbol_kind"), F.col("file_path")).alias("kind"), "start_line", "end_line")
    out = fused.join(meta, "chunk_id")
    if named_paths is None:
        return out
    asked = named_paths.groupBy(query).agg(F.collect_set("path").alias("asked"))
    hit = F.coalesce(F.exists("asked", lambda p: path_matches(F.col("path"), p)), F.lit(False))
    out = out.join(asked, query, "left").withColumn("hit", hit)
    return out.withColumn("tier", F.when(F.col("hit"), 0).otherwise(F.col("tier"))).withColumn("reasons", F.when(F.col("hit"), F.array_append("reasons", F.lit("explicit path"))).otherwise(F.col("reasons"))).drop("hit", "asked")


def signals(pool: DataFrame, chunks: DataFrame, symbols: DataFrame, stale: DataFrame, files: DataFrame) -> DataFrame:
    """``pool`` with exported, stale, generated, deprecated and near_top, one equi join for each source.

    Deprecation is that of any chunk of the same symbol in the same path; near_top holds in the file of the query's first candidate.
    """
    exported = symbols.where("is_exported AND chunk_id IS NOT NULL").select("chunk_id", F.lit(True).alias("exported")).distinct()
    outdated = stale.select("chunk_id", F.lit(True).alias("stale")).distinct()
    made = files.where("generated").select("path", F.lit(True).alias("generated")).distinct()
    marked = chunks.where(F.contains(F.lower("content"), F.lit("deprecated"))).select(F.col("file_path").alias("path"), "symbol_fqn", F.lit(True).alias("deprecated")).distinct()
    top = pool.where("position = 1").select("query_id", F.col("path").alias("top_path"))
    out = pool.join(exported, "chunk_id", "left").join(outdated, "chunk_id", "left").join(made, "path", "left").join(marked, ["path", "symbol_fqn"], "left").join(top, "query_id", "left")
    out = out.withColumn("near_top", F.coalesce((F.col("path") == F.col("top_path")) & (F.col("position") > 1), F.lit(False))).drop("top_path")
    return out.fillna(False, ["exported", "stale", "generated", "deprecated"])
