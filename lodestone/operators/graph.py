"""Operators on the reference graph: resolution, expansion, walks and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import name_tail
from lodestone.operators.intervals import stabbing_join


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, kind, line), a null line being a value of its own."""
    order = Window.partitionBy("source", "target", "kind", F.coalesce("line", F.lit(-1))).orderBy("provenance")
    return edges.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def unresolved_edges(edges: DataFrame, symbols: DataFrame, prefix: str | None = None) -> DataFrame:
    rows = edges if prefix is None else edges.where(F.startswith("target", F.lit(prefix)))
    return rows.join(symbols.select(F.col("fqn").alias("target")), "target", "left_anti")


def resolve_references(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Pending references to edges in two phases: by full name, else by last part of the name; then narrowed.

    ``refs``: id, from_symbol, reference_name, reference_kind, line, file_path, hint_path. Candidates are narrowed to those in
    the hinted file, else in the same file, else exported, as far as that leaves any. One candidate makes a parsed edge, several
    make synthesized edges to all, none leaves the reference failed (its target is null).
    """
    target = symbols.select(F.col("fqn").alias("target"), name_tail(F.col("fqn")).alias("tail"), F.col("file_path").alias("target_path"), F.coalesce("is_exported", F.lit(False)).alias("is_exported"))
    named = refs.select("id", "reference_name", "file_path", "hint_path").withColumn("tail", name_tail(F.col("reference_name")))
    near = F.when(F.col("target_path") == F.col("hint_path"), 0).when(F.col("target_path") == F.col("file_path"), 1).when(F.col("is_exported"), 2).otherwise(3)
    exact = named.join(target.drop("tail"), F.col("reference_name") == F.col("target")).select("id", "target", "target_path", near.alias("near"))
    # by the last part of the name: a part that very many symbols share meets references first in their hinted and own files, and
    # then only those of its symbols that can win there: the exported ones if there are any
    open_ = named.join(exact.select("id"), "id", "left_anti")
    files = F.array(F.struct(F.col("hint_path").alias("target_path"), F.lit(0).alias("near")), F.struct(F.col("file_path").alias("target_path"), F.lit(1).alias("near")))
    in_files = open_.select("id", "tail", F.explode(files).alias("f")).select("id", "tail", "f.target_path", "f.near").join(target, ["tail", "target_path"]).select("id", "target", "target_path", "near")
    shared = target.groupBy("tail").agg(F.bool_or("is_exported").alias("any_exported"))
    winners = target.join(shared, "tail").where("is_exported or not any_exported")
    elsewhere = open_.join(in_files.select("id"), "id", "left_anti").join(winners, "tail").select("id", "target", "target_path", F.when(F.col("is_exported"), 2).otherwise(3).alias("near"))
    own = Window.partitionBy("id")
    both = exact.unionByName(in_files).unionByName(elsewhere)
    both = both.withColumn("nearest", F.min("near").over(own)).where("near = nearest").withColumn("n", F.count("*").over(own))
    found = both.select("id", "target", F.when(F.col("n") == 1, "parsed").otherwise("synthesized").alias("provenance")).distinct()
    return refs.select("id", F.col("from_symbol").alias("source"), F.col("reference_kind").alias("kind"), "line").join(found, "id", "left").withColumn("status", F.when(F.col("target").isNull(), "failed").otherwise("resolved"))


def retarget_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges to a bare name go to the only symbol with that last part of the name; ambiguous and unknown names stay."""
    tails = symbols.select(name_tail(F.col("fqn")).alias("bare"), "fqn").distinct().groupBy("bare").agg(F.count("*").alias("n"), F.min("fqn").alias("only")).where("n = 1")
    known = symbols.select(F.col("fqn").alias("target"), F.lit(True).alias("known")).distinct()
    rows = edges.join(known, "target", "left").join(tails, F.col("target") == F.col("bare"), "left")
    moved = rows.withColumn("target", F.when(F.col("known").isNull(), F.coalesce("only", "target")).otherwise(F.col("target")))
    return distinct_edges(moved.select(*edges.columns))


def neighbours(edges: DataFrame, seeds: DataFrame, caller_limit: int = 200, callers_kept: int = 20, query_key: str | None = None) -> DataFrame:
    """(seed, seed_rank, node, direction, place): callees by line and name, then callers by name, capped where there are very many.

    With a ``query_key`` in ``seeds`` each query has its own seeds, and rows tell theirs.
    """
    by = [query_key] if query_key else []
    out = edges.join(seeds, F.col("source") == F.col("seed")).select(*by, "seed", "seed_rank", F.col("target").alias("node"), "line", F.lit(0).alias("direction"))
    into = edges.join(seeds, F.col("target") == F.col("seed")).select(*by, "seed", "seed_rank", F.col("source").alias("node"), F.lit(None).cast("int").alias("line"), F.lit(1).alias("direction"))
    both = out.unionByName(into)
    order = Window.partitionBy(*by, "seed", "direction").orderBy(F.col("line").asc_nulls_last(), "node")
    both = both.withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(*by, "seed", "direction")))
    return both.where((F.col("direction") == 0) | (F.col("n") <= caller_limit) | (F.col("place") <= callers_kept)).drop("n", "line")


def _first_of_each(rows: DataFrame, query_key: str, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each query, with their position."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(query_key).orderBy(*order))).where(F.col("position") <= limit)


def expand(edges: DataFrame, seeds: DataFrame, limit: int = 30, query_key: str | None = None) -> DataFrame:
    """The first ``limit`` nodes next to the seeds that are no seeds, in the order of seed, direction and place; of each query if keyed."""
    by = [query_key] if query_key else []
    near = neighbours(edges, seeds, query_key=query_key).join(seeds.select(*by, F.col("seed").alias("node")), [*by, "node"], "left_anti")
    first = near.withColumn("n", F.row_number().over(Window.partitionBy(*by, "node").orderBy("seed_rank", "direction", "place"))).where("n = 1")
    if query_key:
        return _first_of_each(first, query_key, ["seed_rank", "direction", "place", "node"], limit).select(query_key, "node", "seed", "direction", "position")
    top = first.orderBy("seed_rank", "direction", "place", "node").limit(limit)
    return top.select("node", "seed", "direction", F.row_number().over(Window.orderBy("seed_rank", "direction", "place", "node")).alias("position"))


def expand_twice(edges: DataFrame, seeds: DataFrame, limit: int = 12, query_key: str | None = None) -> DataFrame:
    """Callees of callees of the seeds, without seeds and their callees; of each query if keyed."""
    by = [query_key] if query_key else []
    calls = edges.select("source", "target").distinct()
    one = calls.join(seeds, F.col("source") == F.col("seed")).select(*by, "seed", "seed_rank", F.col("target").alias("middle"))
    two = one.join(calls, F.col("source") == F.col("middle")).select(*by, "seed_rank", "middle", F.col("target").alias("node"))
    two = two.join(one.select(*by, F.col("middle").alias("node")), [*by, "node"], "left_anti").join(seeds.select(*by, F.col("seed").alias("node")), [*by, "node"], "left_anti")
    first = two.withColumn("n", F.row_number().over(Window.partitionBy(*by, "node").orderBy("seed_rank", "middle"))).where("n = 1")
    if query_key:
        return _first_of_each(first, query_key, ["seed_rank", "middle", "node"], limit).select(query_key, "node", "middle", "position")
    top = first.orderBy("seed_rank", "middle", "node").limit(limit)
    return top.select("node", "middle", F.row_number().over(Window.orderBy("seed_rank", "middle", "node")).alias("position"))


def _ranked_calls(edges: DataFrame, symbols: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls by caller and by callee, each with its place, of ``wanted`` (fqn) alone; others are not ranked.

    Callees: private functions of the project, then its others, then what lies outside; then by line and name. Callers: symbols
    that nothing calls and that are exported, then other exported ones, then by name.
    """
    calls = edges.where("kind = 'calls'").select("source", "target", "line", "provenance")
    known = symbols.groupBy("fqn").agg(F.bool_or(F.col("chunk_id").isNotNull()).alias("local"), F.bool_or("is_exported").alias("exported"))
    name = name_tail(F.col("target"))
    private = F.startswith(name, F.lit("_")) & ~(F.startswith(name, F.lit("__")) & F.endswith(name, F.lit("__")))
    local = F.coalesce("local", F.lit(False))
    level = F.when(~local, 2).when(private, 0).otherwise(1)
    of = lambda side: calls.join(wanted.select(F.col("fqn").alias(side)), side, "left_semi")
    out = of("source").join(known.withColumnRenamed("fqn", "target"), "target", "left").withColumn("level", level)
    out = out.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("level", F.coalesce("line", F.lit(0)), "target", "provenance")))
    called = calls.select(F.col("target").alias("source"), F.lit(True).alias("called")).distinct()
    into = of("target").join(known.withColumnRenamed("fqn", "source"), "source", "left").join(called, "source", "left")
    exported = F.coalesce("exported", F.lit(False))
    order = [F.desc(exported & F.col("called").isNull()), F.desc(exported), "source", F.coalesce("line", F.lit(0)), "provenance"]
    into = into.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy(*order))).withColumn("n", F.count("*").over(Window.partitionBy("target")))
    return out.select("source", "target", "provenance", "place"), into.select("source", "target", "provenance", "place", "n")


def expand_pool(pool: DataFrame, symbols: DataFrame, chunks: DataFrame, edges: DataFrame, references: DataFrame, seeds: int = 20, limit: int = 30, caller_limit: int = 200, callers_kept: int = 20) -> DataFrame:
    """Chunks that the graph adds to the pools of many queries, ``limit`` for each: (query_id, chunk_id, parent, provenance, position).

    ``pool``: query_id, chunk_id, path, kind, symbol_fqn, score; ``symbols``: fqn, file_path, start_line, chunk_id, is_exported;
    ``chunks``: chunk_id, file_path, start_line, end_line; ``edges``: source, target, kind, line, provenance; ``references``:
    spec and symbol (ids of chunks), provenance, stale.

    The best ``seeds`` of a pool come in order, and of a seed: where its file registers it as a route, package files that import
    its name, callees, callers (of too many only some), sections that refer to it; of a section the code it refers to. Stale
    references do not count. A symbol without a chunk stands for the smallest chunk that covers its line. What is in the pool
    already is not added, and a chunk counts where it comes first.
    """
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    top = pool.withColumn("seed_rank", F.row_number().over(place)).where(F.col("seed_rank") <= seeds).select("query_id", "seed_rank", F.col("chunk_id").alias("parent"), "path", "kind", F.col("symbol_fqn").alias("fqn"))
    code = top.where("kind <> 'spec' and fqn is not null and fqn <> ''")
    keys = ["query_id", "seed_rank", "parent"]
    covered = lambda points: stabbing_join(chunks.select(F.col("chunk_id").alias("id"), F.col("file_path").alias("path"), "start_line", "end_line"), points)

    # a chunk for every symbol: its own, else the smallest that covers its first line
    own = symbols.where("chunk_id is not null").groupBy("fqn").agg(F.min("chunk_id").alias("chunk_id"))
    bare = symbols.join(own, "fqn", "left_anti").where("start_line is not null").groupBy("fqn").agg(F.min(F.struct(F.col("file_path").alias("path"), F.col("start_line").alias("line"))).alias("at")).select("fqn", "at.path", "at.line")
    around = covered(bare.select("path", "line").distinct()).select("path", "line", F.col("id").alias("chunk_id"))
    at = own.unionByName(bare.join(around, ["path", "line"]).select("fqn", "chunk_id"))

    out, into = _ranked_calls(edges, symbols, code.select("fqn").distinct())
    into = into.where((F.col("n") <= caller_limit) | (F.col("place") <= callers_kept))
    callees = code.join(out.withColumnRenamed("source", "fqn"), "fqn").select(*keys, F.col("target").alias("fqn"), "provenance", "place", F.lit(2).alias("channel"))
    callers = code.join(into.withColumnRenamed("target", "fqn"), "fqn").select(*keys, F.col("source").alias("fqn"), "provenance", "place", F.lit(3).alias("channel"))
    found = callees.unionByName(callers).join(at, "fqn").drop("fqn")

    made = edges.where("kind = 'registers' and line is not null").select(F.col("target").alias("fqn"), F.col("source").alias("path"), "line", "provenance")
    routes = code.join(made, ["fqn", "path"]).select(*keys, "path", "line", "provenance", F.col("line").alias("place"), F.lit(0).alias("channel"))
    exports = edges.where("kind = 'imports'").where(F.endswith("source", F.lit("__init__.py"))).select(name_tail(F.col("target")).alias("tail"), F.col("source").alias("path")).distinct()
    exports = exports.join(code.select(name_tail(F.col("fqn")).alias("tail")), "tail", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("tail").orderBy("path")))
    sites = code.select(*keys, name_tail(F.col("fqn")).alias("tail")).join(exports, "tail").select(*keys, "path", F.lit(1).alias("line"), F.lit("re-export").alias("provenance"), "place", F.lit(1).alias("channel"))
    spots = routes.unionByName(sites)
    found = found.unionByName(spots.join(covered(spots.select("path", "line").distinct()), ["path", "line"]).select(*keys, "provenance", "place", "channel", F.col("id").alias("chunk_id")))

    links = references.where("not stale").select("spec", "symbol", "provenance")
    order = lambda key, other: F.row_number().over(Window.partitionBy(key).orderBy(other, "provenance"))
    links_of = lambda side, seeds: links.join(seeds.select(F.col("parent").alias(side)), side, "left_semi")
    to_specs = links_of("symbol", code).withColumn("place", order("symbol", "spec")).select(F.col("symbol").alias("parent"), F.col("spec").alias("chunk_id"), "provenance", "place")
    to_code = links_of("spec", top.where("kind = 'spec'")).withColumn("place", order("spec", "symbol")).select(F.col("spec").alias("parent"), F.col("symbol").alias("chunk_id"), "provenance", "place")
    told = code.join(to_specs, "parent").unionByName(top.where("kind = 'spec'").join(to_code, "parent"))
    told = told.join(chunks.select("chunk_id"), "chunk_id", "left_semi").select(*keys, "provenance", "place", F.lit(4).alias("channel"), "chunk_id")

    new = found.unionByName(told).join(pool.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    sequence = ["seed_rank", "channel", "place", "chunk_id"]
    first = new.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(*sequence))).where("n = 1")
    return _first_of_each(first, "query_id", sequence, limit).select("query_id", "chunk_id", "parent", "provenance", "position")


def entry_points(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Exported symbols that nothing calls."""
    return symbols.where("is_exported").join(edges.where("kind = 'calls'").select(F.col("target").alias("fqn")), "fqn", "left_anti")


def walk(edges: DataFrame, starts: DataFrame, steps: int = 2) -> DataFrame:
    """(start, path, truncated): at each node on to the first callee by line and name; never back to a node that was seen.

    truncated: a node of the chain had several callees, the next one was seen already, or the chain could go on.
    """
    own = Window.partitionBy("source")
    firsts = edges.select("source", "target", "line").distinct()
    firsts = firsts.withColumn("n", F.row_number().over(own.orderBy(F.col("line").asc_nulls_last(), "target"))).withColumn("branches", F.count("*").over(own)).where("n = 1").select(F.col("source").alias("at"), F.col("target").alias("next"), "branches")
    rows = starts.select("start", F.array("start").alias("path"), F.lit(False).alias("truncated"), F.lit(True).alias("going"))
    for step in range(steps + 1):
        rows = rows.withColumn("at", F.element_at("path", -1)).join(firsts, "at", "left")
        seen = F.array_contains("path", F.col("next"))
        on = F.col("going") & F.col("next").isNotNull()
        cut = on & (seen | (F.col("branches") > 1) | F.lit(step == steps))
        go = on & ~seen & F.lit(step < steps)
        rows = rows.select("start", F.when(go, F.array_append("path", F.col("next"))).otherwise(F.col("path")).alias("path"), (F.col("truncated") | F.coalesce(cut, F.lit(False))).alias("truncated"), F.coalesce(go, F.lit(False)).alias("going"))
    return rows.drop("going")


def round_robin(rows: DataFrame, group: str, order: list, limit: int) -> DataFrame:
    """The first of each group, then the second of each, and so on up to the limit."""
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    top = placed.orderBy("place", group).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy("place", group)))
