"""Fusing ranked lists, scoring by features, and demoting translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.functions.text import name_tail, name_words, query_words

#: The rank constant, the pool, and the weights of the features.
RANK_CONSTANT, POOL = 60, 120
WEIGHTS = {
    "explicit": 2.0, "literal": 1.0, "literal_root": 0.4, "symbol_equal": 1.0, "consensus": 0.5, "flow_chain": 0.6, "near_top": 0.5, "high_value_doc": 0.8, "exported": 0.2,
    "generated": -1.0, "deprecated": -0.35, "test": -1.5, "stale": -0.8, "fallback": -0.5, "far": -0.3, "synthesized": -0.2, "translation": -2.0, "changelog": -1.2, "example": -0.6,
}
FUSION_SCALE, VECTOR_WEIGHT, VECTOR_DECAY, VECTOR_LEAST, WORD_WEIGHT, WORDS_MOST = 25.0, 1.5, 20.0, 0.05, 0.15, 3


def reciprocal_rank_fusion(lists: DataFrame, query: str, key: str, pool: int = POOL) -> DataFrame:
    """Fuses (query, channel, key, rank): the sum of 1 / (60 + first rank in each channel), then channels, best rank, key."""
    first = lists.groupBy(query, key, "channel").agg(F.min("rank").alias("rank"))
    fused = first.groupBy(query, key).agg(
        F.sum(1.0 / (RANK_CONSTANT + F.col("rank"))).alias("rrf_score"),
        F.count("*").cast("int").alias("channels"),
        F.min("rank").alias("best_rank"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "rank")))).alias("channel_ranks"),
    )
    order = Window.partitionBy(query).orderBy(F.desc(F.round("rrf_score", 12)), F.desc("channels"), "best_rank", key)
    return fused.withColumn("position", F.row_number().over(order)).where(F.col("position") <= pool)


def vector_feature(rank: Column) -> Column:
    """Decays with the rank in the vector list; nothing below the least value or without a rank."""
    value = F.round(VECTOR_WEIGHT * F.exp(-(rank - 1) / VECTOR_DECAY), 3)
    return F.when(rank.isNull() | (value < VECTOR_LEAST), 0.0).otherwise(value)


def rerank(candidates: DataFrame, query: str, key: str) -> DataFrame:
    """score = 25 rrf + weights of the features that hold (boolean columns named as in WEIGHTS; absent ones count as false)."""
    score = FUSION_SCALE * F.col("rrf_score")
    for name, weight in WEIGHTS.items():
        if name in candidates.columns:
            score = score + F.when(F.col(name), weight).otherwise(0.0)
    if "vector_rank" in candidates.columns:
        score = score + vector_feature(F.col("vector_rank"))
    if "name_overlap" in candidates.columns:
        score = score + WORD_WEIGHT * F.least(F.col("name_overlap"), F.lit(WORDS_MOST))
    rows = candidates.withColumn("score", score)
    order = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), F.desc(F.round("rrf_score", 12)), key)
    return rows.withColumn("position", F.row_number().over(order))


def demoted_variants(files: DataFrame, group: str, variant: str, preferred: str, score: str) -> DataFrame:
    """Of files that differ in language only, all but one: the preferred language stays, else the best score, else the first name."""
    own = Window.partitionBy(group)
    place = F.row_number().over(own.orderBy(F.desc(F.col(variant) == preferred), F.desc(score), variant))
    return files.withColumn("place", place).withColumn("variants", F.count("*").over(own)).where("place > 1 and variants >= 2").drop("place", "variants")


def translation_variants(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, path) of the translations to demote: of the documents of a query that differ in language only, all but one.

    ``candidates``: query_id, path, score; ``queries``: query_id, query. The best-scored path in the query's language stays
    (Chinese if the query has Chinese characters, else English or unmarked), else the best-scored of all; ties go to the first path.
    """
    found = candidates.where("path is not null and path <> ''").groupBy("query_id", "path").agg(F.max("score").alias("best")).withColumn("said", paths.translation(F.col("path")))
    chinese = queries.select("query_id", F.col("query").rlike("[\u3400-\u9fff]").alias("chinese"))
    rows = found.join(chinese, "query_id", "left").select("query_id", "path", "best", F.col("said.key").alias("key"), F.col("said.locale").alias("locale"), F.coalesce("chinese", F.lit(False)).alias("chinese"))
    liked = F.when(F.col("chinese"), F.coalesce(F.startswith("locale", F.lit("zh")), F.lit(False))).otherwise(F.coalesce(F.col("locale") == "en", F.lit(True)))
    place = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc(liked), F.desc("best"), "path"))
    return rows.withColumn("place", place).where("place > 1").select("query_id", "path")


def _spellings(symbol: Column) -> Column:
    dotted = F.replace(symbol, F.lit("::"), F.lit("."))
    return F.array(symbol, dotted, name_tail(symbol), F.replace(symbol, F.lit("."), F.lit("::")))


def with_features(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """``candidates`` with the features that paths, names and the query's words tell, named as in WEIGHTS.

    ``candidates``: query_id, chunk_id, path, kind, symbol_fqn, channels, score; ``queries``: query_id, query, symbols (names
    that the query tells). What the query asks for outright is not demoted.
    """
    asked = queries.select(
        "query_id",
        F.coalesce("symbols", F.array().cast("array<string>")).alias("asked_symbols"),
        query_words(F.col("query")).alias("asked_words"),
        *(paths.has_intent(F.col("query"), words).alias(f"asks_{name}") for name, words in (("test", paths.TEST_WORDS), ("changelog", paths.CHANGELOG_WORDS), ("example", paths.EXAMPLE_WORDS))),
    )
    variants = translation_variants(candidates, queries).withColumn("translation", F.lit(True))
    rows = candidates.join(asked, "query_id", "left").join(variants, ["query_id", "path"], "left")
    sure = lambda c: F.coalesce(c, F.lit(False))
    overlap = F.size(F.array_intersect(name_words(F.col("symbol_fqn")), F.col("asked_words")))
    return rows.withColumns({
        "consensus": sure(F.col("channels") >= 3),
        "symbol_equal": sure(F.arrays_overlap(_spellings(F.col("symbol_fqn")), F.col("asked_symbols"))),
        "high_value_doc": sure((F.col("kind") == "spec") & paths.doctype(F.col("path")).isin(*paths.HIGH_VALUE)),
        "test": sure((F.col("kind") == "test") & ~F.col("asks_test")),
        "fallback": sure(F.col("kind") == "fallback"),
        "generated": sure(paths.is_generated(F.col("path"), F.lit(""))),
        "changelog": sure(paths.is_changelog(F.col("path")) & ~F.col("asks_changelog")),
        "example": sure(paths.is_example(F.col("path")) & ~F.col("asks_example")),
        "translation": sure(F.col("translation")),
        "name_overlap": F.when(F.col("symbol_fqn").isNotNull(), F.greatest(overlap, F.lit(0))).otherwise(0),
    }).drop("asked_symbols", "asked_words", "asks_test", "asks_changelog", "asks_example")


def with_graph(pool: DataFrame, expanded: DataFrame, chained: DataFrame) -> DataFrame:
    """The pool of each query together with what the graph adds, and the features that tell where a candidate came from.

    ``pool``: query_id, chunk_id, rrf_score, position; ``expanded``: what lies next to the seeds (query_id, chunk_id, parent,
    provenance; ``graph.expand_pool``); ``chained``: callees of callees of the first seeds (query_id, chunk_id, provenance). A chunk counts
    once for a query, in that order. near_top: its parent is the query's first candidate; flow_chain: it came by the second hop of
    the calls; synthesized: by an edge that is not certain. What the graph adds has no fused score.
    """
    keys = ["query_id", "chunk_id"]
    none, flag = F.lit(False), lambda c: F.coalesce(c, F.lit(False))
    top = pool.where("position = 1").select("query_id", F.col("chunk_id").alias("top"))
    seeds = pool.select(*keys, "rrf_score", F.lit(0).alias("hop"), none.alias("near_top"), none.alias("flow_chain"), none.alias("synthesized"))
    weak = flag(F.col("provenance") == "synthesized")
    near = expanded.join(top, "query_id", "left").select(*keys, F.lit(0.0).alias("rrf_score"), F.lit(1).alias("hop"), flag(F.col("parent") == F.col("top")).alias("near_top"), none.alias("flow_chain"), weak.alias("synthesized"))
    far = chained.select(*keys, F.lit(0.0).alias("rrf_score"), F.lit(2).alias("hop"), none.alias("near_top"), F.lit(True).alias("flow_chain"), weak.alias("synthesized"))
    rows = seeds.unionByName(near).unionByName(far)
    order = Window.partitionBy(*keys).orderBy("hop", F.desc("near_top"), "synthesized")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def virtual_ranks(real: DataFrame, added: DataFrame, query: str, key: str) -> DataFrame:
    """For rows added by the graph: 1 + real vector hits of the query with a higher score, if no more than there are.

    Ranks come from one window over both lists, so no list is held against another row by row.
    """
    both = real.select(query, key, "score", F.lit(1).alias("is_real")).unionByName(added.select(query, key, "score", F.lit(0).alias("is_real")))
    above = Window.partitionBy(query).orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    level = Window.partitionBy(query, "score")
    rows = both.withColumn("rank", (F.sum("is_real").over(above) - F.sum("is_real").over(level) + 1).cast("long")).withColumn("total", F.sum("is_real").over(Window.partitionBy(query)))
    return rows.where("is_real = 0 and rank <= total").select(query, key, "rank")
