"""Queries by name over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import hashing, paths, text
from lodestone.operators import fusion, gap, graph, incremental, intervals, packing, parse, phrases, recall, usage, vector_search
from lodestone.plans import cases, columns, graphs, index, maintenance, operations  # noqa: F401  (they register their queries)
from lodestone.plans.registry import QUERIES, SQL, Query, query, table, work_dir
from lodestone.streaming import stateful

TOKENS = "regexp_extract_all({c}, '[A-Za-z0-9]+')"


# ------------------------------------------------------------------ identities and scalar functions


@query("SELECT doc_id, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS content_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.chunk_content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, sha256(CAST(doc_id AS VARCHAR) || chr(0) || text) AS blob_hash FROM documents")
def blob_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.blob_hash(F.col("doc_id").cast("string"), F.encode("text", "UTF-8")).alias("blob_hash"))


@query("SELECT source, 'cp_' || left(sha256(string_agg(h, chr(10) ORDER BY h)), 16) AS checkpoint FROM (SELECT DISTINCT source, sha256(text) AS h FROM documents) GROUP BY source")
def checkpoint_ids(spark, d):
    h = table(spark, d, "documents").select("source", F.sha2("text", 256).alias("h")).distinct()
    return h.groupBy("source").agg(F.collect_list("h").alias("hs")).select("source", hashing.checkpoint_id(F.col("hs")).alias("checkpoint"))


CJK_SQL = "len(regexp_extract_all(text, '[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}]'))"


@query(f"SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(ceil({CJK_SQL} / 1.5 + (length(text) - {CJK_SQL}) / 4.0) AS BIGINT)) END AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CAST(i AS VARCHAR) || ' | ' || x), chr(10))) AS numbered FROM documents")
def line_numbering(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.numbered_lines(F.col("text"), F.lit(1)), 256).alias("numbered"))


@query("SELECT p_partkey, regexp_extract(p_name, '[^ ]+$') AS tail, sha256(array_to_string(regexp_extract_all(p_name, '[A-Za-z0-9]+|[^ \\t\\n\\r\\f\\v]'), ' ')) AS segmented FROM part")
def name_segments(spark, d):
    return table(spark, d, "part").select("p_partkey", text.name_tail(F.replace("p_name", F.lit(" "), F.lit("."))).alias("tail"), F.sha2(text.segment(F.col("p_name")), 256).alias("segmented"))


@query("""
SELECT page_id, NOT (len(list_intersect(parts, ['test', 'tests', 'testdata', 'fixtures'])) > 0 OR regexp_matches(parts[-1], '^(test_.*|.*_test)\\.[A-Za-z0-9]+$')) AS is_code,
       len(list_intersect(list_transform(parts[:-2], lambda p: lower(p)), ['example', 'examples', 'sample', 'samples', 'demo', 'demos', 'docs_src', 'tutorial', 'tutorials', 'cookbook', 'snippets'])) > 0 AS is_example
FROM (SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/') AS parts FROM pages)
""")
def path_classes(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    return rows.select("page_id", (~paths.is_test(F.col("path"))).alias("is_code"), paths.is_example(F.col("path")).alias("is_example"))


# ------------------------------------------------------------------ postings and recall


@query("SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS term FROM documents) GROUP BY term")
def postings(spark, d):
    p = recall.postings(table(spark, d, "documents"), "doc_id", {"text": 1.0})
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("weighted").cast("long").alias("tf"))


@query("SELECT count(*) AS docs, sum(n) AS tokens, round(avg(n), 6) AS mean FROM (SELECT len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS n FROM documents)")
def corpus_stats(spark, d):
    return recall.lengths(table(spark, d, "documents"), "doc_id", {"text": 1.0}).agg(F.count("*").alias("docs"), F.sum("length").alias("tokens"), F.round(F.avg("length"), 6).alias("mean"))


BM25_SQL = """
WITH t AS (
  SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS term, 1.0::DOUBLE AS w FROM documents
  UNION ALL SELECT doc_id, lower(unnest(regexp_extract_all(source, '[A-Za-z0-9]+'))), 5.0::DOUBLE FROM documents
  UNION ALL SELECT doc_id, lower(unnest(regexp_extract_all(lang, '[A-Za-z0-9]+'))), 1.0::DOUBLE FROM documents
), f AS (SELECT doc_id, term, sum(w) AS f FROM t GROUP BY ALL), l AS (SELECT doc_id, count(*) AS len FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS n, (SELECT count(*) FROM t) * 1.0 / count(*) AS mean FROM documents),
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS term FROM benchmark) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
i AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf, mean FROM df, s),
b AS (SELECT query_id, doc_id, sum(times * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM q JOIN i USING (term) JOIN f USING (term) JOIN l USING (doc_id) GROUP BY ALL)
"""


#: Columns of the index and their weights.
INDEXED = {"text": 1.0, "source": 5.0, "lang": 1.0}
_INDEXES: dict[tuple[str, str], recall.Index] = {}


def _stored(spark, d, kind: str, source: str = "documents") -> str:
    """A folder of this application for what is derived from a table as it is now: its files, sizes and times name it."""
    where = F.col("_metadata")
    files = table(spark, d, source).select(where["file_path"].alias("path"), where["file_size"].alias("size"), where["file_modification_time"].alias("time")).distinct()
    now = files.agg(F.sum(F.xxhash64("path", "size", "time").cast("decimal(38,0)")).alias("mark")).first()["mark"]
    return work_dir(spark, f"{kind}-{spark.sparkContext.applicationId}-{hashlib.sha256(f'{d} {now}'.encode()).hexdigest()[:16]}")


def search_index(spark, d) -> recall.Index:
    """The stored index of the documents, which queries read; the first query of an application over a folder writes it, and so does
    the first one after the folder's files changed."""
    folder = _stored(spark, d, "index")
    own = spark.sparkContext.applicationId, folder
    if own not in _INDEXES:
        recall.write_index(recall.index_of(table(spark, d, "documents"), "doc_id", INDEXED), folder)
        _INDEXES[own] = recall.read_index(spark, folder)
    return _INDEXES[own]


_POSITIONS: set[tuple[str, str]] = set()


def positional_index(spark, d) -> phrases.Positions:
    """The stored positional index, kept as ``search_index`` keeps its own."""
    folder = _stored(spark, d, "positions")
    own = spark.sparkContext.applicationId, folder
    if own not in _POSITIONS:
        phrases.write_positions(phrases.positions_of(table(spark, d, "documents"), "doc_id", list(INDEXED)), folder)
        _POSITIONS.add(own)
    return phrases.read_positions(spark, folder)


def _scores(spark, d):
    return recall.bm25_scores(search_index(spark, d), "doc_id", table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id"), "query_id", "text")


@query(f"{BM25_SQL} SELECT (SELECT n FROM s) AS documents, (SELECT count(*) FROM f) AS postings, (SELECT count(*) FROM df) AS terms")
def index_build(spark, d):
    _INDEXES.pop((spark.sparkContext.applicationId, _stored(spark, d, "index")), None)
    index = search_index(spark, d)
    count = lambda rows, name: rows.agg(F.count("*").alias(name))
    return index.stats.select(F.col("n").alias("documents")).crossJoin(count(index.postings, "postings")).crossJoin(count(index.terms, "terms"))


@query(f"{BM25_SQL} SELECT query_id, doc_id, round(score, 5) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank FROM b) WHERE rank <= 10")
def bm25_topk(spark, d):
    return recall.bm25_best(_scores(spark, d), "doc_id", "query_id", 10).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


#: What stands for a text's words, each between spaces of its own.
SPACED = "' ' || array_to_string(list_transform(regexp_extract_all({c}, '[A-Za-z0-9]+'), lambda x: lower(x)), '  ') || ' '"


@query(f"""
WITH q AS (SELECT item_id AS query_id, {SPACED.format(c='text')} AS p FROM benchmark),
d AS (SELECT doc_id, {SPACED.format(c='text')} AS s FROM documents)
SELECT query_id, doc_id, times, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY times DESC, doc_id) AS INT) AS rank
FROM (SELECT query_id, doc_id, CAST((length(s) - length(replace(s, p, ''))) / length(p) AS BIGINT) AS times FROM q JOIN d ON contains(s, p) WHERE len(string_split(trim(p), '  ')) >= 2)) WHERE rank <= 50
""")
def phrase_topk(spark, d):
    return recall.phrase(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id").withColumnRenamed("text", "asked"), "query_id", "asked")


def _quotes(spark, d):
    """Every four words in a row of every benchmark text, and every whole text, as phrases of their own."""
    words = text.tokens(F.col("text"))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 3, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 4), " "))
    return table(spark, d, "benchmark").select("item_id", F.posexplode(F.array_append(each, F.array_join(words, " "))).alias("nr", "asked")).select((F.col("item_id") * 100_000 + F.col("nr")).alias("query_id"), "asked")


@query(f"""
WITH c AS (
  SELECT doc_id, 0 AS field, list_transform({TOKENS.format(c='text')}, lambda x: lower(x)) AS w FROM documents UNION ALL
  SELECT doc_id, 1, list_transform({TOKENS.format(c='source')}, lambda x: lower(x)) FROM documents UNION ALL SELECT doc_id, 2, list_transform({TOKENS.format(c='lang')}, lambda x: lower(x)) FROM documents
), l AS (SELECT doc_id, sum(coalesce(len(w), 0)) AS length FROM c GROUP BY doc_id), s AS (SELECT count(*) AS n, avg(length) AS mean FROM l),
b AS (SELECT item_id, list_transform({TOKENS.format(c='text')}, lambda x: lower(x)) AS w FROM benchmark),
q AS (
  SELECT item_id * 100000 + unnest(range(greatest(len(w) - 3, 1) + 1)) AS query_id, unnest(list_append(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: w[i:i + 3]), w)) AS p FROM b
), t AS (SELECT doc_id, field, w, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS place FROM c),
h AS (SELECT query_id, doc_id, count(*) AS times FROM q JOIN t ON t.term = p[1] AND len(p) >= 2 AND t.w[place:place + len(p) - 1] = p GROUP BY ALL),
f AS (SELECT query_id, count(*) AS df FROM h GROUP BY query_id),
r AS (
  SELECT query_id, doc_id, times, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * length / mean)) AS score
  FROM h JOIN f USING (query_id) JOIN l USING (doc_id), s)
SELECT query_id, doc_id, times, round(score, 5) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank FROM r) WHERE rank <= 30
""")
def phrase_positions(spark, d):
    found = phrases.phrase_top_k(positional_index(spark, d), "doc_id", _quotes(spark, d), "query_id", "asked")
    return found.select("query_id", "doc_id", "times", F.round("score", 5).alias("score"), "rank")


@query("""
SELECT doc_id, in_name, times, CAST(row_number() OVER (ORDER BY in_name DESC, times DESC, span, doc_id) AS INT) AS rank FROM (
  SELECT doc_id, contains(lower(source), 'src1') AS in_name, CAST((length(b) - length(replace(b, 'src1', ''))) / 4 AS BIGINT) AS times, length(b) AS span
  FROM (SELECT doc_id, source, lower(concat_ws(chr(10), source, text)) AS b FROM documents) WHERE contains(b, 'src1')) QUALIFY rank <= 30
""")
def literal_topk(spark, d):
    return recall.literal(table(spark, d, "documents"), "doc_id", "source", "text", "src1")


@query("SELECT p_partkey, p_name AS name, CAST(row_number() OVER (ORDER BY length(p_name), p_name, p_partkey) AS INT) AS rank FROM part WHERE contains(lower(p_name), 'a') QUALIFY rank <= 30")
def symbol_name_topk(spark, d):
    return recall.symbol_names(table(spark, d, "part"), "p_partkey", "p_name", "A")


@query("""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS INT) AS rank FROM s) WHERE rank <= 10
""")
def cosine_topk(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    return recall.vector_top_k(v, "vec_id", "embedding", asked, "query_id", "asked", 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


_CELLS: set[tuple[str, str]] = set()


def vector_cells(spark, d) -> vector_search.Cells:
    """The stored inverted file of the embeddings, kept as ``search_index`` keeps its own."""
    folder = _stored(spark, d, "cells", "embeddings")
    own = spark.sparkContext.applicationId, folder
    if own not in _CELLS:
        vector_search.write_cells(table(spark, d, "embeddings"), "vec_id", "embedding", folder, cells=64)
        _CELLS.add(own)
    return vector_search.read_cells(spark, folder)


def _asked_vectors(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))


@query()
def indexed_topk(spark, d):
    """As many of 64 cells probed as hold 0.95 of the nearest rows of a sample; tests hold the result against ``cosine_topk``."""
    cells = vector_cells(spark, d)
    probes = vector_search.calibrated_probes(cells, table(spark, d, "embeddings"), "vec_id", "embedding")
    return vector_search.search_cells(cells, _asked_vectors(spark, d), "query_id", "asked", "vec_id", 10, probes)


@query(SQL["cosine_topk"])
def indexed_topk_exact(spark, d):
    """All cells probed."""
    found = vector_search.search_cells(vector_cells(spark, d), _asked_vectors(spark, d), "query_id", "asked", "vec_id", 10, probes=64)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


SYMBOLS = """sym AS (SELECT 'p' || p_partkey AS id, p_name AS name, p_brand || '.' || p_type || '.' || p_name AS fqn, p_brand AS file_path, p_size AS start_line, p_size % 2 = 0 AS is_exported FROM part)"""


def symbols(spark, d):
    p = table(spark, d, "part")
    return p.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_type", "p_name").alias("fqn"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("start_line"), (F.col("p_size") % 2 == 0).alias("is_exported"))


@query(f"""
WITH {SYMBOLS}, w AS (SELECT DISTINCT p_name AS wanted FROM part), h AS (SELECT DISTINCT s.*, wanted FROM sym s JOIN w ON s.name = wanted OR s.fqn = wanted)
SELECT wanted, id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY wanted ORDER BY is_exported DESC, fqn = wanted DESC, file_path, start_line, id) AS INT) AS rank FROM h) WHERE rank <= 20
""")
def exact_lookup(spark, d):
    wanted = table(spark, d, "part").select(F.col("p_name").alias("wanted")).distinct()
    return recall.exact_symbols(symbols(spark, d), wanted).select("wanted", "id", "rank")


@query(f"""
WITH {SYMBOLS} SELECT c AS container, id, rank FROM (SELECT c, id, CAST(row_number() OVER (PARTITION BY c ORDER BY file_path, start_line, id) AS INT) AS rank
FROM sym JOIN (SELECT DISTINCT p_brand AS c FROM part) ON starts_with(fqn, c || '.')) WHERE rank <= 200
""")
def container_members(spark, d):
    brands = table(spark, d, "part").select(F.col("p_brand").alias("container")).distinct()
    return recall.container_members(symbols(spark, d), brands).select("container", "id", "rank")


# ------------------------------------------------------------------ fusion


LISTS = f"""{BM25_SQL.strip()}, lex AS (SELECT query_id, doc_id, rank, 'bm25' AS channel FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b) WHERE rank <= 50),
byl AS (SELECT query_id, doc_id, rank, 'length' AS channel FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY len DESC, doc_id) AS rank FROM b JOIN l USING (doc_id)) WHERE rank <= 50),
fused AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS rrf, CAST(count(*) AS INT) AS channels, CAST(min(rank) AS INT) AS best_rank FROM (SELECT * FROM lex UNION ALL SELECT * FROM byl) GROUP BY ALL)"""


def _lists(spark, d):
    """Two ranked lists of 50 for each query, both from the same scores."""
    scores = _scores(spark, d)
    lexical = recall.bm25_best(scores, "doc_id", "query_id", 50)
    by_length = recall.ranked(scores.select("query_id", "doc_id", "length"), "query_id", [F.desc("length"), "doc_id"], 50)
    told = lambda rows, channel: rows.select("query_id", "doc_id", "rank", F.lit(channel).alias("channel"))
    return told(lexical, "bm25").unionByName(told(by_length, "length"))


@query(f"{LISTS} SELECT query_id, doc_id, round(rrf, 9) AS rrf_score, channels, best_rank, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, channels DESC, best_rank, doc_id) AS INT) AS position FROM fused) WHERE position <= 120")
def rrf_fusion(spark, d):
    fused = fusion.reciprocal_rank_fusion(_lists(spark, d), "query_id", "doc_id")
    return fused.select("query_id", "doc_id", F.round("rrf_score", 9).alias("rrf_score"), "channels", "best_rank", "position")


@query(f"""{LISTS}, r AS (SELECT query_id, doc_id, 25 * rrf + CASE WHEN channels >= 3 THEN 0.5 ELSE 0 END + CASE WHEN lang = 'en' THEN 0.2 ELSE 0 END + CASE WHEN source = 'src0' THEN -1.5 ELSE 0 END
  + CASE WHEN best_rank IS NULL OR round(1.5 * exp(-(best_rank - 1) / 20.0), 3) < 0.05 THEN 0 ELSE round(1.5 * exp(-(best_rank - 1) / 20.0), 3) END + 0.15 * least(doc_id % 5, 3) AS score, rrf FROM fused JOIN documents USING (doc_id))
SELECT query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, round(rrf, 12) DESC, doc_id) AS INT) AS position FROM r
""")
def rerank_score(spark, d):
    fused = fusion.reciprocal_rank_fusion(_lists(spark, d), "query_id", "doc_id", 10**6)
    docs = table(spark, d, "documents").select("doc_id", (F.col("lang") == "en").alias("exported"), (F.col("source") == "src0").alias("test"), (F.col("doc_id") % 5).alias("name_overlap"))
    rows = fused.join(docs, "doc_id").withColumn("consensus", F.col("channels") >= 3).withColumn("vector_rank", F.col("best_rank"))
    return fusion.rerank(rows, "query_id", "doc_id").select("query_id", "doc_id", F.round("score", 6).alias("score"), "position")


@query("SELECT source, lang, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lang = 'de' DESC, n DESC, lang) AS place, count(*) OVER (PARTITION BY source) AS variants FROM (SELECT source, lang, max(n_chars) AS n FROM documents GROUP BY ALL)) WHERE place > 1 AND variants >= 2")
def variant_demotion(spark, d):
    files = table(spark, d, "documents").groupBy("source", "lang").agg(F.max("n_chars").alias("n"))
    return fusion.demoted_variants(files, "source", "lang", "de", "n")


@query("""
WITH v AS (SELECT label AS query_id, vec_id, round(CAST(embedding[1] AS DOUBLE), 9) AS score, vec_id % 3 = 0 AS is_real FROM embeddings), c AS (SELECT query_id, count(*) AS total FROM v WHERE is_real GROUP BY ALL)
SELECT a.query_id, a.vec_id, 1 + count(r.vec_id) AS rank FROM v a JOIN c ON c.query_id = a.query_id LEFT JOIN v r ON r.query_id = a.query_id AND r.is_real AND r.score > a.score
WHERE NOT a.is_real GROUP BY a.query_id, a.vec_id, total HAVING 1 + count(r.vec_id) <= total
""")
def virtual_rank(spark, d):
    v = table(spark, d, "embeddings").select(F.col("label").alias("query_id"), "vec_id", F.round(F.col("embedding")[0].cast("double"), 9).alias("score"))
    return fusion.virtual_ranks(v.where("vec_id % 3 = 0"), v.where("vec_id % 3 <> 0"), "query_id", "vec_id")


# ------------------------------------------------------------------ graph


EDGES = """e AS (
  SELECT DISTINCT 'o' || l_orderkey AS source, 'p' || l_partkey AS target, 'calls' AS kind, l_linenumber AS line, 'parsed' AS provenance FROM lineitem
  UNION SELECT 'c' || o_custkey, 'o' || o_orderkey, 'calls', NULL, 'parsed' FROM orders
  UNION SELECT 'p' || p_partkey, p_brand, 'extends', NULL, 'parsed' FROM part)"""


def edges(spark, d):
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    none = F.lit(None).cast("int")
    a = table(spark, d, "lineitem").select(name("o", "l_orderkey").alias("source"), name("p", "l_partkey").alias("target"), F.lit("calls").alias("kind"), F.col("l_linenumber").cast("int").alias("line"))
    b = table(spark, d, "orders").select(name("c", "o_custkey").alias("source"), name("o", "o_orderkey").alias("target"), F.lit("calls").alias("kind"), none.alias("line"))
    c = table(spark, d, "part").select(name("p", "p_partkey").alias("source"), F.col("p_brand").alias("target"), F.lit("extends").alias("kind"), none.alias("line"))
    return graph.distinct_edges(a.unionByName(b).unionByName(c).withColumn("provenance", F.lit("parsed")))


@query(f"WITH {EDGES} SELECT kind, count(*) AS n, count(DISTINCT source) AS sources FROM e GROUP BY kind")
def graph_edges(spark, d):
    return edges(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


SEEDS = "seeds AS (SELECT (c_custkey - 1) // {n} AS query_id, 'c' || c_custkey AS seed, CAST(c_custkey AS INT) AS seed_rank FROM customer)"


def seeds(spark, d, n):
    """Every customer is a seed; n with neighbouring keys make a query."""
    return table(spark, d, "customer").select(F.expr(f"(c_custkey - 1) div {n}").alias("query_id"), F.concat(F.lit("c"), "c_custkey").alias("seed"), F.col("c_custkey").cast("int").alias("seed_rank"))


@query(f"""
WITH {EDGES}, {SEEDS.format(n=20)}, nb AS (
  SELECT query_id, seed, seed_rank, target AS node, 0 AS direction, row_number() OVER (PARTITION BY query_id, seed ORDER BY line NULLS LAST, target) AS place, 0 AS n FROM e JOIN seeds ON source = seed
  UNION ALL SELECT query_id, seed, seed_rank, source, 1, row_number() OVER (PARTITION BY query_id, seed ORDER BY source), count(*) OVER (PARTITION BY query_id, seed) FROM e JOIN seeds ON target = seed),
f AS (SELECT * FROM nb WHERE (direction = 0 OR n <= 200 OR place <= 20) AND (query_id, node) NOT IN (SELECT query_id, seed FROM seeds) QUALIFY row_number() OVER (PARTITION BY query_id, node ORDER BY seed_rank, direction, place) = 1)
SELECT query_id, node, seed, direction, CAST(row_number() OVER (PARTITION BY query_id ORDER BY seed_rank, direction, place, node) AS INT) AS position FROM f QUALIFY position <= 30
""")
def expand_1hop(spark, d):
    return graph.expand(edges(spark, d), seeds(spark, d, 20), query_key="query_id")


@query(f"""
WITH {EDGES}, {SEEDS.format(n=3)}, c AS (SELECT DISTINCT source, target FROM e), one AS (SELECT query_id, seed_rank, target AS middle FROM c JOIN seeds ON source = seed),
two AS (SELECT query_id, seed_rank, middle, target AS node FROM one JOIN c ON source = middle WHERE (query_id, target) NOT IN (SELECT query_id, middle FROM one) AND (query_id, target) NOT IN (SELECT query_id, seed FROM seeds)),
f AS (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY query_id, node ORDER BY seed_rank, middle) = 1)
SELECT query_id, node, middle, CAST(row_number() OVER (PARTITION BY query_id ORDER BY seed_rank, middle, node) AS INT) AS position FROM f QUALIFY position <= 12
""")
def expand_2hop(spark, d):
    return graph.expand_twice(edges(spark, d), seeds(spark, d, 3), query_key="query_id")


#: Customers are the pools' chunks; what the graph adds to them is expanded and chained, then all is scored by features.
@query(f"""
WITH near AS ({SQL["expand_1hop"]}), far AS ({SQL["expand_2hop"]}), {SEEDS.format(n=20)}, pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seed_rank) AS place FROM seeds),
rows AS (
  SELECT query_id, seed AS chunk_id, 1.0 / (60 + place) AS rrf, 0 AS hop, false AS near_top, false AS flow_chain FROM pool UNION ALL
  SELECT n.query_id, node, 0, 1, coalesce(n.seed = s.seed, false), false FROM near n LEFT JOIN pool s ON s.query_id = n.query_id AND s.place = 1 UNION ALL SELECT query_id, node, 0, 2, false, true FROM far
), once AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY hop, near_top DESC) = 1),
scored AS (SELECT *, 25.0 * rrf + CASE WHEN flow_chain THEN 0.6 ELSE 0 END + CASE WHEN near_top THEN 0.5 ELSE 0 END AS score FROM once)
SELECT query_id, chunk_id, near_top, flow_chain, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, round(rrf, 12) DESC, chunk_id) AS INT) AS position FROM scored
""")
def chain_scores(spark, d):
    known = edges(spark, d)
    placed = seeds(spark, d, 20).withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("seed_rank")))
    pool = placed.select("query_id", F.col("seed").alias("chunk_id"), (1.0 / (60 + F.col("position"))).alias("rrf_score"), "position")
    near = graph.expand(known, seeds(spark, d, 20), query_key="query_id").select("query_id", F.col("node").alias("chunk_id"), F.col("seed").alias("parent"), F.lit("parsed").alias("provenance"))
    far = graph.expand_twice(known, seeds(spark, d, 3), query_key="query_id").select("query_id", F.col("node").alias("chunk_id"), F.lit("parsed").alias("provenance"))
    rows = fusion.rerank(fusion.with_graph(pool, near, far), "query_id", "chunk_id")
    return rows.select("query_id", "chunk_id", "near_top", "flow_chain", F.round("score", 6).alias("score"), "position")


#: The walk of every customer as plain joins; the longest chains are cut where they could go on.
@query("""
WITH e AS (SELECT DISTINCT 'o' || l_orderkey AS source, 'p' || l_partkey AS target, l_linenumber AS line FROM lineitem UNION SELECT 'c' || o_custkey, 'o' || o_orderkey, NULL FROM orders UNION SELECT 'p' || p_partkey, p_brand, NULL FROM part),
n AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY line NULLS LAST, target) AS nr, count(*) OVER (PARTITION BY source) AS branches FROM e), f AS (SELECT source, target, branches FROM n WHERE nr = 1),
s AS (SELECT 'c' || c_custkey AS start FROM customer),
one AS (SELECT s.start, f.target AS a, coalesce(f.branches, 0) > 1 AS cut FROM s LEFT JOIN f ON f.source = s.start),
two AS (SELECT one.start, a, f.target AS b, cut OR coalesce(f.branches, 0) > 1 AS cut FROM one LEFT JOIN f ON f.source = one.a)
SELECT two.start, concat_ws('>', two.start, a, b) AS path, cut OR f.target IS NOT NULL AS truncated FROM two LEFT JOIN f ON f.source = two.b
""")
def walked_chains(spark, d):
    starts = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("start"))
    return graph.walk(edges(spark, d), starts).select("start", F.array_join("path", ">").alias("path"), "truncated")


@query(f"""
WITH {EDGES}, f AS MATERIALIZED (SELECT source, target AS next, count(*) OVER (PARTITION BY source) AS branches FROM (SELECT DISTINCT source, target, line FROM e) QUALIFY row_number() OVER (PARTITION BY source ORDER BY line NULLS LAST, target) = 1)
SELECT 'c' || c_custkey AS start, array_to_string(list_filter(['c' || c_custkey, a.next, b.next], lambda x: x IS NOT NULL), '>') AS path,
       coalesce(a.branches > 1, false) OR coalesce(b.branches > 1, false) OR z.next IS NOT NULL AS truncated
FROM customer LEFT JOIN f a ON a.source = 'c' || c_custkey LEFT JOIN f b ON b.source = a.next LEFT JOIN f z ON z.source = b.next
""")
def path_walk(spark, d):
    starts = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("start"))
    return graph.walk(edges(spark, d), starts).select("start", F.array_join("path", ">").alias("path"), "truncated")


@query(f"WITH {EDGES}, s AS (SELECT 'o' || o_orderkey AS fqn, o_orderkey AS k FROM orders UNION ALL SELECT 'c' || c_custkey, c_custkey FROM customer) SELECT fqn FROM s WHERE k % 2 = 0 AND fqn NOT IN (SELECT target FROM e WHERE kind = 'calls')")
def entry_points(spark, d):
    named = lambda t, prefix, c: table(spark, d, t).select(F.concat(F.lit(prefix), F.col(c).cast("string")).alias("fqn"), (F.col(c) % 2 == 0).alias("is_exported"))
    return graph.entry_points(named("orders", "o", "o_orderkey").unionByName(named("customer", "c", "c_custkey")), edges(spark, d)).select("fqn")


@query(f"WITH {EDGES} SELECT source, target FROM e WHERE kind = 'calls' AND starts_with(target, 'p') AND target NOT IN (SELECT 'p' || p_partkey FROM part WHERE p_partkey % 10 <> 0)")
def unresolved_anti(spark, d):
    known = table(spark, d, "part").where("p_partkey % 10 <> 0").select(F.concat(F.lit("p"), "p_partkey").alias("fqn"))
    return graph.unresolved_edges(edges(spark, d).where("kind = 'calls'"), known, "p").select("source", "target")


NATIONS = """s AS (SELECT r_name || '.' || n_name AS target, n_name AS tail, 'f' || n_regionkey AS path, n_nationkey % 2 = 0 AS exported FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'OTHER.' || n_name, n_name, 'f9', n_nationkey % 3 = 0 FROM nation WHERE n_nationkey % 4 = 0)"""


def nation_symbols(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    a = n.select(F.concat_ws(".", "r_name", "n_name").alias("fqn"), F.concat(F.lit("f"), "n_regionkey").alias("file_path"), (F.col("n_nationkey") % 2 == 0).alias("is_exported"))
    b = table(spark, d, "nation").where("n_nationkey % 4 = 0").select(F.concat(F.lit("OTHER."), "n_name").alias("fqn"), F.lit("f9").alias("file_path"), (F.col("n_nationkey") % 3 == 0).alias("is_exported"))
    return a.unionByName(b)


REFS = """r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'nowhere' ELSE n_name END AS name, 'f' || (c_custkey % 5) AS path, CASE WHEN c_custkey % 7 = 0 THEN 'f9' END AS hint FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"""
WITH {NATIONS}, {REFS}, m AS (SELECT id, target, CASE WHEN s.path = hint THEN 0 WHEN s.path = r.path THEN 1 WHEN exported THEN 2 ELSE 3 END AS near FROM r JOIN s ON r.name = s.tail),
k AS (SELECT * FROM m QUALIFY near = min(near) OVER (PARTITION BY id)), n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM k)
SELECT r.id, target, CASE WHEN n = 1 THEN 'parsed' WHEN n > 1 THEN 'synthesized' END AS provenance, CASE WHEN target IS NULL THEN 'failed' ELSE 'resolved' END AS status FROM r LEFT JOIN n ON r.id = n.id
""")
def ref_resolution(spark, d):
    refs = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    refs = refs.select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("c"), "c_custkey").alias("from_symbol"), F.when(F.col("c_custkey") % 10 == 0, "nowhere").otherwise(F.col("n_name")).alias("reference_name"),
        F.lit("calls").alias("reference_kind"), F.lit(1).alias("line"), F.concat(F.lit("f"), F.col("c_custkey") % 5).alias("file_path"), F.when(F.col("c_custkey") % 7 == 0, "f9").alias("hint_path"),
    )
    return graph.resolve_references(refs, nation_symbols(spark, d)).select("id", "target", "provenance", "status")


@query(f"""
WITH {NATIONS}, t AS (SELECT tail, min(target) AS sole FROM s GROUP BY tail HAVING count(DISTINCT target) = 1)
SELECT DISTINCT 'c' || c_custkey AS source, coalesce(sole, n_name) AS target FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN t ON tail = n_name
""")
def edge_retarget(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    e = c.select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.col("n_name").alias("target"), F.lit("calls").alias("kind"), F.lit(None).cast("int").alias("line"), F.lit("parsed").alias("provenance"))
    return graph.retarget_edges(e, nation_symbols(spark, d)).select("source", "target")


@query("SELECT p_brand, p_partkey, CAST(row_number() OVER (ORDER BY place, p_brand) AS INT) AS position FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS place FROM part) QUALIFY position <= 24")
def gap_round_robin(spark, d):
    return graph.round_robin(table(spark, d, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", [F.desc("p_size"), "p_partkey"], 24).select("p_brand", "p_partkey", "position")


# ------------------------------------------------------------------ ranges


RANGES = "r AS (SELECT 'o' || l_orderkey AS path, l_linenumber AS id, l_linenumber * 7 AS start_line, l_linenumber * 7 + CAST(l_quantity AS INT) AS end_line FROM lineitem)"


def ranges(spark, d):
    line = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("path"), line.alias("id"), (line * 7).alias("start_line"), (line * 7 + F.col("l_quantity").cast("int")).alias("end_line"))


@query(f"WITH {RANGES}, p AS (SELECT 'o' || o_orderkey AS path, CAST(o_orderkey % 60 AS INT) AS line FROM orders) SELECT path, line, id, start_line, end_line FROM p JOIN r USING (path) WHERE line BETWEEN start_line AND end_line QUALIFY row_number() OVER (PARTITION BY path, line ORDER BY end_line - start_line, start_line, id) = 1")
def stabbing_join(spark, d):
    points = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("path"), (F.col("o_orderkey") % 60).cast("int").alias("line"))
    return intervals.stabbing_join(ranges(spark, d), points)


@query(f"WITH {RANGES} SELECT a.path, a.id AS left_id, b.id AS right_id FROM r a JOIN r b ON a.path = b.path AND a.id % 2 = 0 AND b.id % 2 = 1 AND a.start_line <= b.end_line AND b.start_line <= a.end_line")
def interval_overlap(spark, d):
    r = ranges(spark, d)
    return intervals.overlap_join(r.where("id % 2 = 0"), r.where("id % 2 = 1"))


@query(f"""
WITH {RANGES}, f AS (SELECT *, CASE WHEN start_line > max(end_line) OVER w + 1 OR max(end_line) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM r WINDOW w AS (PARTITION BY path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT path, min(start_line) AS s, max(end_line) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS i FROM f) GROUP BY path, i UNION ALL SELECT DISTINCT path, 101, 101 FROM r)
SELECT path, first AS start_line, s - 1 AS end_line FROM (SELECT path, s, coalesce(lag(e) OVER (PARTITION BY path ORDER BY s), 0) + 1 AS first FROM m) WHERE first <= s - 1
""")
def interval_gaps(spark, d):
    r = ranges(spark, d)
    return intervals.gaps(r, r.select("path", F.lit(100).alias("total")).distinct())


# ------------------------------------------------------------------ changes


def snapshots(spark, d):
    h = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    return h.where("path % 7 <> 0"), h.where("path % 5 <> 0").withColumn("hash", F.when(F.col("path") % 3 == 0, F.sha2(F.concat("hash", F.lit("x")), 256)).otherwise(F.col("hash")))


SNAPSHOTS = "b AS (SELECT doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 7 <> 0), a AS (SELECT doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN sha256(sha256(text) || 'x') ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 5 <> 0)"


@query(f"WITH {SNAPSHOTS} SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM b FULL JOIN a ON b.path = a.path WHERE b.hash IS DISTINCT FROM a.hash")
def snapshot_diff(spark, d):
    return incremental.snapshot_diff(*snapshots(spark, d))


@query(f"""WITH {SNAPSHOTS}, o AS (SELECT path % 50 AS path, path AS id, hash FROM b), n AS (SELECT path % 50 AS path, path AS id, hash FROM a)
SELECT n.path, id, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.path = n.path AND o.hash = n.hash) THEN 'reused' ELSE 'new' END AS state FROM n
UNION ALL SELECT path, id, 'removed' FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.path = o.path AND n.id = o.id)""")
def file_delta(spark, d):
    old, new = (s.select((F.col("path") % 50).alias("path"), F.col("path").alias("id"), "hash") for s in snapshots(spark, d))
    return incremental.file_delta(old, new)


@query(f"""WITH {SNAPSHOTS} SELECT path, hash FROM b WHERE path NOT IN (SELECT path FROM a WHERE path % 3 = 0) UNION ALL SELECT path, hash FROM a WHERE path % 3 = 0""")
def replace_by_path(spark, d):
    old, new = snapshots(spark, d)
    changed = new.where("path % 3 = 0")
    return incremental.replace_by_path(old, changed, changed)


@query(f"""WITH {SNAPSHOTS}, w AS (SELECT path AS id, hash FROM a), c AS (SELECT DISTINCT hash FROM a WHERE path % 11 = 0),
x AS (SELECT w.id, w.hash, EXISTS (SELECT 1 FROM b WHERE b.path = w.id AND b.hash = w.hash) AS same, w.hash IN (SELECT hash FROM b) AS stored, w.hash IN (SELECT hash FROM c) AS cached, row_number() OVER (PARTITION BY w.hash ORDER BY w.id) AS n FROM w)
SELECT action, count(*) AS n FROM (SELECT CASE WHEN same THEN 'skipped' WHEN stored THEN 'reused' WHEN cached THEN 'cached' WHEN n = 1 THEN 'embedded' ELSE 'shared' END AS action FROM x) GROUP BY action""")
def vector_reuse(spark, d):
    old, new = snapshots(spark, d)
    wanted = new.withColumnRenamed("path", "id")
    return incremental.vector_reuse(wanted, old.withColumnRenamed("path", "id"), new.where("path % 11 = 0")).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT min(doc_id) AS keeper, count(*) AS copies FROM documents GROUP BY sha256(text)")
def exact_duplicates(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("keeper"), F.count("*").alias("copies")).select("keeper", "copies")


# ------------------------------------------------------------------ usage


def seconds():
    return F.unix_seconds(F.col("ts").cast("timestamp"))


@query("""SELECT user_id, count(*) AS total, count(*) FILTER (state = 'done') AS succeeded, count(*) FILTER (state = 'failed') AS failed, CAST(floor(avg(value) FILTER (state = 'done')) AS BIGINT) AS avg_value,
min(value) FILTER (state = 'done') AS min_value, max(value) FILTER (state = 'done') AS max_value, max_by(state, event_id) AS last_state
FROM (SELECT *, CASE event_type WHEN 'click' THEN 'done' WHEN 'view' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS state FROM events) GROUP BY user_id""")
def index_run_stats(spark, d):
    state = F.when(F.col("event_type").isin("click", "view"), "done").when(F.col("event_type") == "error", "failed").otherwise("running")
    return usage.run_stats(table(spark, d, "events").withColumn("state", state), "user_id", "state", "value", "event_id")


@query("""SELECT event_type, count(*) AS total, count(*) FILTER (answerable) AS succeeded, count(*) FILTER (NOT answerable) AS insufficient, count(*) FILTER (degraded AND answerable IS NULL) AS failed,
CAST(floor(avg(latency)) AS BIGINT) AS avg_latency, round(avg(coverage), 4) AS avg_coverage
FROM (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 = 1 END AS answerable, event_id % 2 = 0 AS degraded, user_id AS latency, CASE WHEN event_id % 4 = 0 THEN user_id % 8 / 8.0 END AS coverage FROM events) GROUP BY event_type""")
def usage_summary(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id")
    audit = e.select("event_type", F.when(i % 3 != 0, i % 3 == 1).alias("answerable"), (i % 2 == 0).alias("degraded"), F.col("user_id").alias("latency"), F.when(i % 4 == 0, F.col("user_id") % 8 / 8.0).alias("coverage"))
    return usage.usage_summary(audit, "event_type")


@query("""SELECT user_id, value AS percentile FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
WHERE i = least(greatest(round_even(0.95 * n, 0) - 1, 0), n - 1)""")
def percentile_nearest_rank(spark, d):
    return usage.nearest_rank(table(spark, d, "events"), "user_id", "value", 0.95)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10")
def top_queries(spark, d):
    return usage.top_values(table(spark, d, "events"), "event_type")


@query("SELECT confidence, count(*) AS n FROM (SELECT CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE event_type END AS confidence FROM events) GROUP BY confidence")
def confidence_distribution(spark, d):
    return usage.distribution(table(spark, d, "events").select(F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("confidence")), "confidence")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def retention_keep_n(spark, d):
    return usage.keep_newest(table(spark, d, "events"), "user_id", "ts", "event_id", 5).select("user_id", "event_id")


@query("SELECT caller, max(seen) AS latest FROM (SELECT user_id AS caller, event_id AS seen FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_id FROM events WHERE event_type = 'purchase') GROUP BY caller ORDER BY latest DESC, caller LIMIT 50")
def call_union_max(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("caller"), F.col("event_id").alias("at"), "event_type")
    return usage.latest_activity([e.where("event_type = 'click'"), e.where("event_type = 'purchase'")], "caller", "at", 50)


@query("SELECT user_id, coalesce(sum(CASE WHEN epoch(ts) >= epoch(TIMESTAMP '2024-01-20') THEN event_id END), 0)::BIGINT AS used FROM events GROUP BY user_id")
def token_sum(spark, d):
    since = F.unix_seconds(F.lit("2024-01-20").cast("timestamp"))
    return usage.token_sum(table(spark, d, "events"), "user_id", seconds(), since, "event_id")


@query("SELECT o_custkey, n, CASE WHEN n >= 20 THEN 'exceeded' WHEN n >= 16 THEN 'warning' ELSE 'ok' END AS state FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL)")
def quota_state(spark, d):
    used = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return used.withColumn("state", usage.quota_state(F.col("n"), F.lit(20)))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def sliding_window_count(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", seconds().alias("s"))
    return usage.sliding_counts(e, "user_id", "s", 3600).select("event_id", "in_window")


@query("SELECT event_id, coalesce(s - lag(s) OVER (PARTITION BY user_id, event_type ORDER BY s, event_id) <= 6000, false) AS is_stub FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)")
def recent_stub(spark, d):
    e = table(spark, d, "events").withColumn("s", seconds())
    return usage.recent_stubs(e, ["user_id", "event_type"], "s", 6000).select("event_id", "is_stub")


@query("""
WITH RECURSIVE t AS MATERIALIZED (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS DOUBLE) AS s, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
w AS (
  SELECT event_id, user_id, n, true AS allowed, [s] AS kept FROM t WHERE n = 1
  UNION ALL
  SELECT event_id, user_id, n, len(live) < 3, CASE WHEN len(live) < 3 THEN list_append(live, s) ELSE live END
  FROM (SELECT t.event_id, t.user_id, t.n, t.s, list_filter(w.kept, lambda x: x > t.s - 36000) AS live FROM w JOIN t ON t.user_id = w.user_id AND t.n = w.n + 1)
)
SELECT user_id, event_id, allowed FROM w
""")
def limiter(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", seconds().cast("double").alias("s"))
    return stateful.limiter(e, "user_id", "s", "event_id", 3, 36_000.0)


@query("""WITH r AS (SELECT source AS query_id, doc_id AS doc, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), x AS (SELECT d.source AS query_id, d.doc_id AS doc, d.lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1),
h AS (SELECT x.query_id, lang, min(rank) AS first FROM x JOIN r ON x.query_id = r.query_id AND x.doc = r.doc GROUP BY ALL)
SELECT lang, count(*) AS queries, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(1.0 / first), 6) AS mrr FROM h GROUP BY lang""")
def recall_mrr(spark, d):
    docs = table(spark, d, "documents")
    results = recall.ranked(docs.select(F.col("source").alias("query_id"), F.col("doc_id").alias("doc"), "n_chars"), "query_id", [F.desc("n_chars"), "doc"], 10**9).select("query_id", "doc", "rank")
    expected = docs.join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").alias("doc"), "lang")
    return usage.retrieval_metrics(results, expected, ["lang"])


@query("""SELECT conv_id, turn, CAST(turn % 3 + 1 AS INT) - CASE WHEN turn % 3 = 2 THEN 1 ELSE 0 END AS valid, CASE WHEN turn % 3 = 2 THEN 1 ELSE 0 END AS invalid FROM conversations""")
def citation_verify(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("x "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("turn") % 3), lambda i: F.concat(F.lit("[E"), i.cast("string"), F.lit("]"))), " ")).alias("answer"), F.array(F.lit("E0"), F.lit("E1")).alias("known"))
    return usage.verified_citations(c, "answer", "known").select("conv_id", "turn", "valid", "invalid")


# ------------------------------------------------------------------ packing and row generators


@query("SELECT source, doc_id, CAST(running AS BIGINT) AS running FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running <= 50000")
def packing_prefix(spark, d):
    return packing.prefix(table(spark, d, "documents"), "source", ["n_chars", "doc_id"], "n_chars", 50_000).select("source", "doc_id", "running")


ESTIMATE = "CASE WHEN length({t}) = 0 THEN 0 ELSE greatest(1, CAST(ceil({c} / 1.5 + (length({t}) - {c}) / 4.0) AS BIGINT)) END"


def _estimate(t: str) -> str:
    return ESTIMATE.format(t=t, c=CJK_SQL.replace("(text,", f"({t},"))


#: One step offers one candidate to the pack of a query under one floor: all in order, then all again while less than two are held.
PACKED_SQL = f"""
{LISTS.replace("WITH t AS", "WITH RECURSIVE t AS", 1)},
pool AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, channels DESC, best_rank, doc_id) <= 120),
c AS MATERIALIZED (
  SELECT query_id, doc_id, source AS path, 25 * rrf AS score, {_estimate("text")} AS tokens, {_estimate("top_lines")} AS head_tokens, row_number() OVER (PARTITION BY query_id ORDER BY 25 * rrf DESC, doc_id) AS n, count(*) OVER (PARTITION BY query_id) AS total, max(25 * rrf) OVER (PARTITION BY query_id) AS top
  FROM pool JOIN (SELECT *, array_to_string(list_slice(string_split(text, chr(10)), 1, 15), chr(10)) AS top_lines FROM documents) USING (doc_id)
), k AS (
  SELECT DISTINCT query_id, round AS round, floor, 0 AS step, CAST(500 AS BIGINT) AS used, MAP([]::VARCHAR[], []::BIGINT[]) AS files, []::STRUCT(chunk BIGINT, form VARCHAR, tokens BIGINT)[] AS items, false AS stopped FROM c, (VALUES (1, 0.4), (2, 0.2), (3, 0.1), (4, 0.04)) r(round, floor)
  UNION ALL
  SELECT query_id, round, floor, step + 1, CASE WHEN take THEN used + cost ELSE used END, CASE WHEN take THEN map_concat(files, MAP([path], [in_file + cost])) ELSE files END,
    CASE WHEN take THEN list_append(items, {{'chunk': doc_id, 'form': form, 'tokens': cost}}) ELSE items END, stopped OR (step < total AND fits AND NOT take)
  FROM (SELECT *, fits AND used + cost <= 14000 AS take FROM (SELECT *, NOT held AND in_file + cost <= per_file AND CASE WHEN step < total THEN NOT stopped AND score >= floor * top ELSE len(items) < 2 END AS fits
    FROM (SELECT *, CASE WHEN short THEN head_tokens ELSE tokens END AS cost, CASE WHEN short THEN 'head' ELSE 'whole' END AS form FROM (SELECT *, head_tokens < tokens AND (in_file + tokens > per_file OR used + tokens > 14000) AS short
    FROM (SELECT k.*, c.* EXCLUDE (query_id), coalesce(map_extract(files, path)[1], 0) AS in_file, CASE WHEN step < total AND score >= 0.7 * top THEN 1000000000 ELSE 2500 END AS per_file, list_contains(list_transform(items, lambda x: x.chunk), doc_id) AS held
      FROM k JOIN c ON c.query_id = k.query_id AND c.n = step % total + 1 AND step < 2 * total)))))
), ended AS (SELECT k.query_id, list(used ORDER BY round) AS u, list(len(items) < total ORDER BY round) AS o, list(items ORDER BY round) AS i FROM k JOIN (SELECT DISTINCT query_id, total FROM c) USING (query_id) WHERE step = 2 * total GROUP BY k.query_id),
chosen AS (SELECT *, CASE WHEN u[a2] < 4900 AND o[a2] AND u[4] > u[a2] THEN 4 ELSE a2 END AS best FROM (SELECT *, CASE WHEN u[a1] < 4900 AND o[a1] AND u[3] > u[a1] THEN 3 ELSE a1 END AS a2 FROM (SELECT *, CASE WHEN u[1] < 4900 AND o[1] AND u[2] > u[1] THEN 2 ELSE 1 END AS a1 FROM ended)))
SELECT query_id, item.chunk AS chunk_id, CAST(position AS INT) AS position, item.form AS form, item.tokens AS tokens, used FROM (SELECT query_id, u[best] AS used, unnest(i[best]) AS item, unnest(range(1, len(i[best]) + 1)) AS position FROM chosen)
"""


def _fused(spark, d):
    """The fused lists, kept as a table, and the documents in them, so that no text is cut or counted that no list holds."""
    folder = f"{work_dir(spark)}/fused"
    fusion.reciprocal_rank_fusion(_lists(spark, d), "query_id", "doc_id").select("query_id", "doc_id", "rrf_score").write.parquet(folder)
    fused = spark.read.parquet(folder)
    return fused, table(spark, d, "documents").join(fused.select("doc_id"), "doc_id", "left_semi")


@query(PACKED_SQL)
def packing_assemble(spark, d):
    fused, found = _fused(spark, d)
    head = F.array_join(F.slice(F.split("text", "\n"), 1, 15), "\n")
    docs = found.select("doc_id", F.col("source").alias("path"), F.lit("code").alias("kind"), text.estimate_tokens(F.col("text")).alias("tokens"), text.estimate_tokens(head).alias("head_tokens"))
    rows = fused.join(docs, "doc_id").select("query_id", F.col("doc_id").alias("chunk_id"), "path", "kind", F.lit(2).alias("tier"), (25 * F.col("rrf_score")).alias("score"), "tokens", "head_tokens")
    return packing.assemble(rows)


#: As above, with three heads to choose from.
FORMS_SQL = PACKED_SQL
for _old, _new in (
    (f'{_estimate("top_lines")} AS head_tokens', "[" + ", ".join(f"{{'form': 'head {n}', 'tokens': {_estimate(f'top_{n}')}}}" for n in (40, 15, 5)) + "] AS forms"),
    ("array_to_string(list_slice(string_split(text, chr(10)), 1, 15), chr(10)) AS top_lines", ", ".join(f"array_to_string(list_slice(string_split(text, chr(10)), 1, {n}), chr(10)) AS top_{n}" for n in (40, 15, 5))),
    ("CASE WHEN short THEN head_tokens ELSE tokens END AS cost, CASE WHEN short THEN 'head' ELSE 'whole' END AS form", "CASE WHEN short THEN pick.tokens ELSE tokens END AS cost, CASE WHEN short THEN pick.form ELSE 'whole' END AS form"),
    (
        "SELECT *, head_tokens < tokens AND (in_file + tokens > per_file OR used + tokens > 14000) AS short",
        "SELECT *, len(smaller) > 0 AND (in_file + tokens > per_file OR used + tokens > 14000) AS short, coalesce(list_filter(smaller, lambda x: in_file + x.tokens <= per_file AND used + x.tokens <= 14000)[1], smaller[-1]) AS pick\n    FROM (SELECT *, list_filter(forms, lambda x: x.tokens < tokens) AS smaller",
    ),
    ("AND step < 2 * total)))))", "AND step < 2 * total))))))"),
):
    assert _old in FORMS_SQL, _old
    FORMS_SQL = FORMS_SQL.replace(_old, _new)


@query(FORMS_SQL)
def packing_forms(spark, d):
    fused, found = _fused(spark, d)
    docs = found.select("doc_id", F.col("source").alias("path"), F.lit("code").alias("kind"), "text", text.estimate_tokens(F.col("text")).alias("tokens"))
    rows = fused.join(packing.with_forms(docs, "text", heads=(40, 15, 5)).drop("text"), "doc_id").select("query_id", F.col("doc_id").alias("chunk_id"), "path", "kind", F.lit(2).alias("tier"), (25 * F.col("rrf_score")).alias("score"), "tokens", "forms")
    return packing.assemble(rows)


@query("""
WITH d AS (SELECT concat_ws('/', source, CAST(doc_id AS VARCHAR)) AS path, source, lang, CAST(4 + length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS total FROM documents)
SELECT path, source AS heading, source AS heading_path, 1 AS level, 1 AS start_line, total AS end_line FROM d
UNION ALL SELECT path, lang, source || ' > ' || lang, 2, 3, total FROM d
""")
def markdown_sections(spark, d):
    files = table(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.concat(F.lit("# "), "source", F.lit("\n\n## "), "lang", F.lit("\n"), "text").alias("text"))
    return parse.sections(files)


@query("SELECT CAST(doc_id AS VARCHAR) AS path, text AS joined FROM documents")
def fallback_split(spark, d):
    chunks = parse.fallback_chunks(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"), 40, 2000)
    parts = chunks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("piece", "content"))).alias("parts"))
    return parts.select("path", F.array_join(F.transform("parts", lambda p: p["content"]), "").alias("joined"))


# ------------------------------------------------------------------ second round and evaluation


PACKS = """pool AS (SELECT l_orderkey % 40 AS query_id, 'p' || l_partkey % 9 AS path, l_orderkey * 10 + l_linenumber AS chunk_id, l_linenumber * 5 AS start_line, l_linenumber * 5 + CAST(l_quantity AS INT) % 7 AS end_line FROM lineitem),
packed AS (SELECT * FROM pool WHERE chunk_id % 17 = 0)"""


def packs(spark, d):
    line = F.col("l_linenumber")
    pool = table(spark, d, "lineitem").select((F.col("l_orderkey") % 40).alias("query_id"), F.concat(F.lit("p"), F.col("l_partkey") % 9).alias("path"), (F.col("l_orderkey") * 10 + line).alias("chunk_id"), (line * 5).alias("start_line"), (line * 5 + F.col("l_quantity").cast("int") % 7).alias("end_line"))
    return pool, pool.where("chunk_id % 17 = 0")


@query(f"WITH {PACKS} SELECT query_id, chunk_id FROM pool a WHERE NOT EXISTS (SELECT 1 FROM packed b WHERE a.query_id = b.query_id AND a.path = b.path AND a.start_line <= b.end_line AND b.start_line <= a.end_line)")
def gap_lacking(spark, d):
    return gap.lacking(*packs(spark, d)).select("query_id", "chunk_id")


@query("""
WITH g AS (SELECT l_orderkey % 40 AS query_id, l_suppkey % 3 AS group_no, l_partkey AS chunk_id, min(l_linenumber) AS order_key FROM lineitem GROUP BY ALL),
o AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY group_no, order_key) = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, group_no ORDER BY order_key, chunk_id) AS place FROM o QUALIFY place <= 6)
SELECT query_id, group_no, place, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY place, group_no, chunk_id) AS position FROM c QUALIFY position <= 10
""")
def gap_plan(spark, d):
    g = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 40).alias("query_id"), (F.col("l_suppkey") % 3).alias("group_no"), F.col("l_partkey").alias("chunk_id")).agg(F.min("l_linenumber").alias("order_key"))
    return gap.plan(g, 6, 10)


@query("""
WITH p AS (SELECT o_custkey % 50 AS query_id, o_orderpriority AS project, row_number() OVER (PARTITION BY o_custkey % 50, o_orderpriority ORDER BY o_orderkey) AS position, 'f' || o_orderkey AS path, o_orderkey % 90 AS tokens FROM orders),
r AS (SELECT *, row_number() OVER w AS number, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS running FROM p WINDOW w AS (PARTITION BY query_id ORDER BY position, project))
SELECT query_id, project || ':' || path AS path, 'E' || number AS label FROM r WHERE running <= 1000
""")
def project_union(spark, d):
    own = usage.Window.partitionBy("query_id", "project").orderBy("o_orderkey")
    p = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("query_id"), F.col("o_orderpriority").alias("project"), "o_orderkey").withColumn("position", F.row_number().over(own))
    p = p.select("query_id", "project", "position", F.concat(F.lit("f"), "o_orderkey").alias("path"), (F.col("o_orderkey") % 90).alias("tokens"))
    return gap.union_projects(p, 1000).select("query_id", "path", "label")


@query("""
WITH e AS (SELECT o_custkey % 100 AS question, 'p' || o_orderkey % 12 AS path FROM orders GROUP BY ALL), r AS (SELECT o_custkey % 100 AS question, 'p' || o_orderkey % 15 AS path, min(o_orderkey % 25 + 1) AS rank FROM orders GROUP BY ALL),
m AS (SELECT e.question, e.path, min(rank) AS first FROM e LEFT JOIN r ON e.question = r.question AND e.path = r.path GROUP BY ALL),
s AS (SELECT question, min(first) AS best, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10 FROM m GROUP BY question)
SELECT question, coalesce(best <= 5, false) AS hit_5, coalesce(best <= 10, false) AS hit_10, recall_10, recall_10 >= 2.0 / 3 AS passed FROM s
""")
def benchmark_scores(spark, d):
    o = table(spark, d, "orders").withColumn("question", F.col("o_custkey") % 100)
    expected = o.select("question", F.concat(F.lit("p"), F.col("o_orderkey") % 12).alias("path"), F.lit(None).cast("string").alias("symbol")).distinct()
    results = o.groupBy("question", F.concat(F.lit("p"), F.col("o_orderkey") % 15).alias("path")).agg(F.min(F.col("o_orderkey") % 25 + 1).alias("rank")).withColumn("symbol", F.lit("s"))
    return gap.benchmark_scores(expected, results)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over texts fused with a second ranked list, for all benchmark texts at once."""
    return rrf_fusion(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
