"""The second round of a search: what the first pack lacks, merging packs, and trimming a union of packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lacking(pool: DataFrame, packed: DataFrame) -> DataFrame:
    """Pool rows (query_id, path, start_line, end_line, ...) whose lines overlap nothing packed in the same path."""
    lines = packed.select("query_id", "path", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    hit = (pool["query_id"] == lines["query_id"]) & (pool["path"] == lines["path"]) & ~((pool["end_line"] < lines["s"]) | (pool["start_line"] > lines["e"]))
    return pool.join(lines, hit, "left_anti")


#: Anchors of a kind, and what each may bring; what a plan holds in all.
ANCHORS, MEMBERS_MOST, TARGETS_MOST, CALLEES_MOST, GAPS_MOST = 2, 24, 6, 6, 24


def _prefixes(name: Column) -> Column:
    """A full name and all its containers, double colons as dots."""
    parts = F.split(F.replace(name, F.lit("::"), F.lit(".")), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def closures(named: DataFrame, packed: DataFrame, pool: DataFrame, symbols: DataFrame, edges: DataFrame, references: DataFrame) -> DataFrame:
    """(query_id, group_no, chunk_id, order_key): chunks of the pool that a first pack lacks, in four kinds of groups, for ``plan``.

    ``named``: query_id, position, token (names that a query tells); ``packed``: query_id, position, chunk_id, symbol_fqn (null
    for a section); ``pool``: query_id, position, chunk_id, export_of (the symbol that a chunk of the pool re-exports, else
    null); ``symbols``: fqn, chunk_id; ``edges``: source, target, kind, line; ``references``: spec, symbol.

    Groups, in this order: sites that re-export a symbol; members of the first two named containers of which something is
    packed; what the packed parts of these containers call; what the first two packed sections that have anything refer to.
    All joins are equi joins: a name is listed under each of its containers.
    """
    wanted = pool.join(packed.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    first = lambda rows, by, order, k: rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("n") <= k)
    dotted = lambda c: F.replace(F.col(c), F.lit("::"), F.lit("."))

    exports = wanted.where("export_of is not null")
    order = Window.partitionBy("query_id").orderBy("first", "export_of")
    sites = exports.groupBy("query_id", "export_of").agg(F.min("position").alias("first")).withColumn("group_no", F.row_number().over(order) - 1)
    found = exports.join(sites, ["query_id", "export_of"]).select("query_id", "group_no", "chunk_id", F.col("position").alias("order_key"))

    parts = packed.where("symbol_fqn is not null").select("query_id", F.col("symbol_fqn").alias("part"), F.explode(_prefixes(F.col("symbol_fqn"))).alias("name"))
    anchors = named.select("query_id", "position", dotted("token").alias("name")).groupBy("query_id", "name").agg(F.min("position").alias("position"))
    anchors = first(anchors.join(parts.select("query_id", "name").distinct(), ["query_id", "name"], "left_semi"), ["query_id"], ["position", "name"], ANCHORS).select("query_id", "name", F.col("n").alias("anchor"))

    held = symbols.where("chunk_id is not null").select("chunk_id", dotted("fqn").alias("full"), F.explode(_prefixes(F.col("fqn"))).alias("name")).where("name <> full")
    whole = packed.where("symbol_fqn is not null").select("query_id", dotted("symbol_fqn").alias("full"))
    # a query's own chunks meet its anchors: a container's members times the queries that name it would be a product
    members = wanted.select("query_id", "chunk_id", "position").join(anchors.select("query_id").distinct(), "query_id", "left_semi").join(held, "chunk_id").join(anchors, ["query_id", "name"])
    members = members.join(whole, ["query_id", "full"], "left_anti").select("query_id", "anchor", "chunk_id", "position").distinct()
    members = first(members, ["query_id", "anchor"], ["position", "chunk_id"], MEMBERS_MOST)
    found = found.unionByName(members.select("query_id", (1000 + F.col("anchor")).alias("group_no"), "chunk_id", F.col("position").alias("order_key")))

    calls = edges.where("kind = 'calls'").select(F.col("source").alias("part"), "target", F.coalesce("line", F.lit(0)).alias("line"))
    at = symbols.where("chunk_id is not null").groupBy(F.col("fqn").alias("target")).agg(F.min("chunk_id").alias("chunk_id"))
    called = anchors.join(parts, ["query_id", "name"]).join(calls, "part").join(at, "target").join(wanted.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    called = called.groupBy("query_id", "anchor", "chunk_id").agg(F.min(F.struct("part", "line", "target")).alias("order"))
    called = first(called, ["query_id", "anchor"], ["order", "chunk_id"], CALLEES_MOST)
    found = found.unionByName(called.select("query_id", (2000 + F.col("anchor")).alias("group_no"), "chunk_id", F.col("n").alias("order_key")))

    specs = packed.where("symbol_fqn is null").select("query_id", F.col("position").alias("place"), F.col("chunk_id").alias("spec"))
    told = specs.join(references.select("spec", F.col("symbol").alias("chunk_id")).distinct(), "spec").join(wanted.select("query_id", "chunk_id", "position"), ["query_id", "chunk_id"])
    usable = first(told.select("query_id", "place", "spec").distinct(), ["query_id"], ["place", "spec"], ANCHORS).select("query_id", "spec", F.col("n").alias("anchor"))
    told = first(told.join(usable, ["query_id", "spec"]), ["query_id", "anchor"], ["position", "chunk_id"], TARGETS_MOST)
    return found.unionByName(told.select("query_id", (3000 + F.col("anchor")).alias("group_no"), "chunk_id", F.col("position").alias("order_key")))


def plan(groups: DataFrame, per_group: int, limit: int) -> DataFrame:
    """(query_id, group_no, place, chunk_id): at most so many of each group, then group by group in turn up to the limit.

    A chunk that several groups name counts for the first of them.
    """
    once = groups.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("group_no", "order_key"))).where("n = 1").drop("n")
    own = Window.partitionBy("query_id", "group_no").orderBy("order_key", "chunk_id")
    capped = once.withColumn("place", F.row_number().over(own)).where(F.col("place") <= per_group)
    turn = Window.partitionBy("query_id").orderBy("place", "group_no", "chunk_id")
    return capped.withColumn("position", F.row_number().over(turn)).where(F.col("position") <= limit).select("query_id", "group_no", "place", "chunk_id", "position")


def backfill_order(rows: DataFrame) -> DataFrame:
    """Position by source class, chain closure, shared words, score, length of the span and id."""
    keys = ["source_class", F.desc("in_chain"), F.desc("overlap"), F.desc("score"), F.col("end_line") - F.col("start_line"), "chunk_id"]
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*keys)))


def merge_packs(base: DataFrame, extra: DataFrame, per_pack: int = 6) -> DataFrame:
    """``base`` and the first items of each extra pack; where lines of a path overlap, the extra one replaces a more elided, shorter one, else it goes.

    Both: query_id, pack, position, path, start_line, end_line, elided.
    """
    few = extra.where(F.col("position") <= per_pack)
    a = base.alias("a")
    b = few.alias("b")
    same = (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.path") == F.col("b.path")) & ~((F.col("a.end_line") < F.col("b.start_line")) | (F.col("a.start_line") > F.col("b.end_line")))
    better = (F.col("b.elided") < F.col("a.elided")) & (F.col("b.end_line") - F.col("b.start_line") > F.col("a.end_line") - F.col("a.start_line"))
    kept = a.join(b, same & better, "left_anti")
    added = few.alias("b").join(base.alias("a"), same & ~better, "left_anti")
    return kept.unionByName(added.select(*base.columns))


def union_projects(packs: DataFrame, budget: int) -> DataFrame:
    """Items of several projects' packs as one, renumbered; from the end those go that exceed the token budget.

    ``packs``: query_id, project, position, path, tokens. Paths get the project's label in front.
    """
    order = Window.partitionBy("query_id").orderBy("position", "project")
    rows = packs.withColumn("number", F.row_number().over(order)).withColumn("running", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("running") <= budget).select("query_id", "project", F.concat_ws(":", "project", "path").alias("path"), F.concat(F.lit("E"), F.col("number").cast("string")).alias("label"), "number", "tokens")


def missing_evidence(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, code): what may make an answer incomplete.

    ``queries``: query_id, unresolved, stale_docs, omitted, items; ``index`` has one row: stale, pending.
    """
    rows = queries.crossJoin(F.broadcast(index.limit(1)))
    codes = F.array(
        F.when(F.col("stale"), "index_stale"),
        F.when(F.col("pending") > 0, "indexing_pending"),
        F.when(F.col("unresolved") > 0, "unresolved_reference"),
        F.when(F.col("stale_docs") > 0, "stale_doc_reference"),
        F.when(F.col("omitted") > 0, "retrieval_truncated"),
        F.when(F.col("items") == 0, "no_context_match"),
    )
    return rows.select("query_id", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))


def benchmark_scores(expected: DataFrame, results: DataFrame) -> DataFrame:
    """By question: hit in the first 5 and 10, share of expectations within 10, and whether at least two thirds are met.

    ``expected``: question, path, symbol (null: any); ``results``: question, path, symbol, rank.
    """
    match = (expected["question"] == results["question"]) & (expected["path"] == results["path"]) & (expected["symbol"].isNull() | (expected["symbol"] == results["symbol"]))
    met = expected.join(results, match, "left").groupBy(expected["question"], expected["path"], expected["symbol"]).agg(F.min("rank").alias("first"))
    rows = met.groupBy("question").agg(F.min("first").alias("best"), F.round(F.avg(F.when(F.col("first") <= 10, 1.0).otherwise(0.0)), 6).alias("recall_10"))
    within = lambda k: F.coalesce(F.col("best") <= k, F.lit(False))
    return rows.select("question", within(5).alias("hit_5"), within(10).alias("hit_10"), "recall_10", (F.col("recall_10") >= 2 / 3).alias("passed"))
