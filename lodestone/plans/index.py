"""Queries of the index operators: channels, lookups, links, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import mentions
from lodestone.operators import channels, tables
from lodestone.plans.registry import query, table

# ------------------------------------------------------------------ what queries name, and the channels


@query("SELECT p_partkey, trim(regexp_replace(p_name || '`::' || p_type, '`|::', ' ', 'g')) AS cleaned, len(list_filter(string_split(p_name || ' — : ' || p_type, ' '), lambda t: regexp_matches(t, '[A-Za-z0-9]'))) AS words FROM part")
def query_cleaning(spark, d):
    kept = mentions.lexical_tokens(F.split(F.concat_ws(" — : ", "p_name", "p_type"), " "))
    return table(spark, d, "part").select("p_partkey", F.trim(mentions.lexical_query(F.concat_ws("`::", "p_name", "p_type"))).alias("cleaned"), F.size(kept).cast("long").alias("words"))


@query("""
SELECT p_partkey, unnest([{'position': 0, 'kind': 'symbol', 'token': 'part_' || p_partkey}, {'position': 1, 'kind': 'path', 'token': 'src/m' || p_size || '.py'}, {'position': 2, 'kind': 'symbol', 'token': 'Shop::sell' || p_size},
{'position': 3, 'kind': 'inferred', 'token': 'readSize' || p_size}], recursive := true) FROM part
""")
def named_tokens(spark, d):
    text = F.format_string("readSize%d of `part_%d` in src/m%d.py as Shop::sell%d", "p_size", "p_partkey", "p_size", "p_size")
    return mentions.named(table(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")


#: The whole query counts as a phrase: five words, twelve characters or more, and nothing in quotes.
@query("""
SELECT p_partkey, unnest([{'position': 0, 'phrase': 'set brand=' || p_size || '-x capability', 'strong': true}, {'position': 1, 'phrase': 'brand=' || p_size || '-x', 'strong': true},
{'position': 2, 'phrase': 'capability', 'strong': false}], recursive := true) FROM part
""")
def literal_phrases(spark, d):
    text = F.format_string("set brand=%d-x capability", "p_size")
    return mentions.phrases(table(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")


def _parts(spark, d):
    part = table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    symbols = part.select(F.concat(F.lit("s"), key).alias("id"), "p_name", F.concat_ws(".", F.lit("shop"), "p_name").alias("fqn"), F.when(F.col("p_partkey") % 7 > 0, F.concat(F.lit("c"), key)).alias("chunk_id"), "p_brand", F.col("p_size").alias("start_line"), (F.col("p_size") % 2 == 0).alias("is_exported"))
    return symbols.withColumnsRenamed({"p_name": "name", "p_brand": "file_path"})


PARTS = "s AS (SELECT 's' || p_partkey AS id, p_name AS name, 'shop.' || p_name AS fqn, CASE WHEN p_partkey % 7 > 0 THEN 'c' || p_partkey END AS chunk_id, p_brand AS file_path, p_size AS start_line, p_size % 2 = 0 AS is_exported FROM part)"


@query(f"""
WITH {PARTS}, t AS (SELECT n_nationkey AS q, CAST(p AS INT) AS position, CASE p WHEN 0 THEN name ELSE 'shop::' || name END AS token FROM nation, range(2) r(p), s WHERE id = 's' || (n_nationkey * 5 + p + 1)),
w AS (SELECT DISTINCT q, position, token, unnest([0, 1, 2]) AS form, unnest([token, replace(token, '::', '.'), replace(token, '.', '::')]) AS wanted FROM t),
f AS (SELECT q, position, wanted, min(form) AS form FROM w GROUP BY ALL),
h AS (SELECT f.*, s.*, row_number() OVER (PARTITION BY q, chunk_id ORDER BY position, form, is_exported DESC, fqn = wanted DESC, file_path, start_line, id) AS n FROM f JOIN s ON name = wanted OR fqn = wanted WHERE chunk_id IS NOT NULL)
SELECT q, chunk_id, CAST(row_number() OVER (PARTITION BY q ORDER BY position, form, is_exported DESC, fqn = wanted DESC, file_path, start_line, id) AS INT) AS rank, wanted AS detail FROM h WHERE n = 1 QUALIFY rank <= 20
""")
def symbol_channel(spark, d):
    symbols = _parts(spark, d)
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("q"), F.explode(F.array(F.lit(0), F.lit(1))).alias("position"))
    names = symbols.select(F.col("id").alias("at"), "name")
    tokens_ = asked.withColumn("at", F.concat(F.lit("s"), (F.col("q") * 5 + F.col("position") + 1).cast("string"))).join(names, "at")
    tokens_ = tokens_.select("q", "position", F.when(F.col("position") == 0, F.col("name")).otherwise(F.concat(F.lit("shop::"), "name")).alias("token"))
    return channels.symbol_recall(symbols, tokens_, "q", True)


NEEDLES = "n AS (SELECT DISTINCT upper(unnest(regexp_extract_all(text, '[A-Za-z]{6,}'))) AS needle FROM benchmark)"


@query(f"""
WITH {NEEDLES}, d AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, lower(source) AS name, lower(source || chr(10) || text) AS blob FROM documents),
h AS (SELECT needle, chunk_id, contains(name, lower(needle)) AS in_name, CAST((length(blob) - length(replace(blob, lower(needle), ''))) / length(needle) AS BIGINT) AS times, length(blob) AS span FROM n JOIN d ON contains(blob, lower(needle)))
SELECT needle, chunk_id, in_name, times, CAST(row_number() OVER (PARTITION BY needle ORDER BY in_name DESC, times DESC, span, chunk_id) AS INT) AS rank FROM h QUALIFY rank <= 30
""")
def literal_many(spark, d):
    chunks = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("symbol_fqn"), F.col("text").alias("content"))
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0)))
    needles = table(spark, d, "benchmark").select(words.alias("word")).select(F.upper("word").alias("needle")).distinct()
    return channels.literal_many(chunks, needles)


@query("""
WITH n AS (SELECT DISTINCT upper(left(p_name, 4)) AS needle FROM part), h AS (SELECT needle, p_partkey AS chunk_id, p_name FROM n JOIN part ON contains(lower(p_name), lower(needle)))
SELECT needle, chunk_id, CAST(row_number() OVER (PARTITION BY needle ORDER BY length(p_name), p_name, chunk_id) AS INT) AS rank FROM h QUALIFY rank <= 20
""")
def name_channel(spark, d):
    part = table(spark, d, "part")
    needles = part.select(F.upper(F.substring("p_name", 1, 4)).alias("needle")).distinct()
    return channels.names_many(part.select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("name")), needles)


MERGED = """
r AS (SELECT o_custkey % 30 AS q, CASE o_orderkey % 3 WHEN 0 THEN 'bm25' WHEN 1 THEN 'vector' ELSE 'exact' END AS channel, o_orderkey % 250 AS chunk_id, CAST(min(o_orderkey % 40 + 1) AS INT) AS rank FROM orders GROUP BY ALL),
f AS (SELECT q, chunk_id, sum(1.0 / (60 + rank)) AS score, count(*) AS channels, min(rank) AS best_rank, min(CASE channel WHEN 'exact' THEN 0 WHEN 'vector' THEN 2 ELSE 1 END) AS tier FROM r GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, channels DESC, best_rank, chunk_id) AS position FROM f QUALIFY position <= 120)
"""


@query(f"""
WITH {MERGED} SELECT q, chunk_id, CAST(position AS INT) AS position, CAST(CASE WHEN p_brand = 'Brand#' || q THEN 0 ELSE tier END AS INT) AS tier, p_brand AS path, round(score, 9) AS rrf FROM t JOIN part ON p_partkey = chunk_id
""")
def merged_pool(spark, d):
    o = table(spark, d, "orders")
    channel = F.when(F.col("o_orderkey") % 3 == 0, "bm25").when(F.col("o_orderkey") % 3 == 1, "vector").otherwise("exact")
    r = o.groupBy((F.col("o_custkey") % 30).alias("q"), channel.alias("channel"), (F.col("o_orderkey") % 250).alias("chunk_id")).agg(F.min(F.col("o_orderkey") % 40 + 1).cast("int").alias("rank"))
    r = r.withColumn("tier", F.when(F.col("channel") == "exact", 0).when(F.col("channel") == "vector", 2).otherwise(1)).withColumn("detail", F.col("channel"))
    chunks = table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("file_path"), F.col("p_name").alias("symbol_fqn"), F.lit("function").alias("symbol_kind"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    asked = r.select("q").distinct().select("q", F.concat(F.lit("Brand#"), "q").alias("path"))
    return channels.merge(r, chunks, "q", asked).select("q", "chunk_id", "position", "tier", "path", F.round("rrf_score", 9).alias("rrf"))


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1")
def first_seen(spark, d):
    return channels.first_seen(table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), ["l_partkey"], ["l_orderkey", "l_linenumber"])


# ------------------------------------------------------------------ lookups, links and counts


@query("SELECT o_orderkey AS id, c_name, CAST(o_orderkey % 9 AS INT) AS position FROM orders JOIN customer ON c_custkey = o_orderkey WHERE o_orderkey % 3 = 0")
def fetch_by_id(spark, d):
    ids = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 9).cast("int").alias("position"))
    return tables.fetch(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name"), ids)


@query("SELECT DISTINCT 'n' || l_partkey % 40 AS name, 'm' || l_suppkey % 5 || CASE WHEN l_suppkey % 2 = 0 THEN '/__init__.py' ELSE '/a.py' END AS source FROM lineitem WHERE l_linenumber = 1 AND l_suppkey % 2 = 0 AND l_partkey % 40 < 10")
def reexports(spark, d):
    source = F.concat(F.lit("m"), F.col("l_suppkey") % 5, F.when(F.col("l_suppkey") % 2 == 0, "/__init__.py").otherwise("/a.py"))
    edges = table(spark, d, "lineitem").select(source.alias("source"), F.concat(F.lit("pkg.mod.n"), F.col("l_partkey") % 40).alias("target"), F.when(F.col("l_linenumber") == 1, "imports").otherwise("calls").alias("kind"))
    return tables.reexports(edges, spark.range(10).select(F.concat(F.lit("n"), "id").alias("name")))


@query("SELECT DISTINCT o_custkey AS spec FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 4 = 0")
def stale_specs(spark, d):
    refs = table(spark, d, "orders").select(F.col("o_custkey").alias("spec"), (F.col("o_orderstatus") == "F").alias("stale"))
    return tables.stale_specs(refs, table(spark, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("spec")))


@query("SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'license')")
def marker_chunks(spark, d):
    docs = table(spark, d, "documents")
    return tables.with_marker(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), docs.select(F.col("doc_id").alias("id")), "License").select("id")


@query("""
WITH s AS (SELECT p_partkey AS symbol, p_brand || '.' || p_size AS fqn, CAST(p_size AS VARCHAR) AS tail FROM part),
m AS (SELECT DISTINCT o_custkey AS spec, CASE WHEN o_orderkey % 2 = 0 THEN 'Brand#' || o_orderkey % 5 * 11 || '.' || o_orderkey % 50 ELSE 'q::' || o_orderkey % 60 END AS mention FROM orders),
e AS (SELECT spec, mention, symbol FROM m JOIN s ON mention = fqn),
t AS (SELECT spec, mention, symbol FROM m JOIN s ON tail = regexp_extract(replace(mention, '::', '.'), '[^.]*$') WHERE (spec, mention) NOT IN (SELECT spec, mention FROM e))
SELECT DISTINCT spec, symbol FROM (SELECT * FROM e UNION ALL SELECT * FROM t) WHERE spec <> symbol
""")
def section_links(spark, d):
    part, key = table(spark, d, "part"), F.col("o_orderkey")
    symbols = part.select(F.col("p_partkey").alias("id"), F.concat_ws(".", "p_brand", F.col("p_size").cast("string")).alias("fqn"))
    mention = F.when(key % 2 == 0, F.concat(F.lit("Brand#"), key % 5 * 11, F.lit("."), key % 50)).otherwise(F.concat(F.lit("q::"), key % 60))
    asked = table(spark, d, "orders").select(F.col("o_custkey").alias("spec"), mention.alias("mention")).distinct()
    known = asked.select("spec", F.col("spec").alias("symbol")).distinct()
    return tables.link_sections(asked, symbols, known)


@query("""
WITH n AS (SELECT DISTINCT unnest([p_name, regexp_extract(p_name, '[^ .]+$')]) AS key FROM part WHERE p_partkey % 10 = 0)
SELECT DISTINCT p_partkey AS id, p_name AS reference_name FROM part WHERE p_partkey % 3 = 0 AND (p_name IN (SELECT key FROM n) OR regexp_extract(p_name, '[^ .]+$') IN (SELECT key FROM n))
""")
def failed_retry(spark, d):
    part = table(spark, d, "part")
    tail = F.regexp_extract("p_name", "[^ .]+$", 0)
    refs = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("reference_name"), tail.alias("name_tail"), F.when(F.col("p_partkey") % 3 == 0, "failed").otherwise("pending").alias("status"))
    new = part.where("p_partkey % 10 = 0").select(F.col("p_name").alias("name"), F.concat(F.lit("x."), tail).alias("fqn"))
    return tables.retry_failed(refs, new).select("id", "reference_name")


@query("SELECT (SELECT count(*) FROM customer) AS files, (SELECT max(c_custkey) FROM customer) AS freshness, (SELECT count(*) FROM orders) AS chunks, (SELECT bool_or(o_orderpriority <> '1-URGENT') FROM orders) AS has_code, (SELECT count(*) FILTER (l_linenumber = 1) FROM lineitem) AS pending, (SELECT count(*) FILTER (l_linenumber = 2) FROM lineitem) AS failed")
def index_counts(spark, d):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "spec_block").otherwise("function")
    status = F.when(F.col("l_linenumber") == 1, "pending").when(F.col("l_linenumber") == 2, "failed").otherwise("done")
    return tables.counts(table(spark, d, "customer").select(F.col("c_custkey").alias("indexed_at")), table(spark, d, "orders").select(kind.alias("symbol_kind")), table(spark, d, "lineitem").select(status.alias("status")))


@query("SELECT o_custkey % 20 AS query_id, count(*) FILTER (c >= 2) AS agreeing, count(DISTINCT CASE WHEN c >= 2 THEN p END) AS files, max(CASE WHEN c >= 2 THEN o_totalprice END) AS peak, median(o_totalprice) AS median FROM (SELECT *, o_orderkey % 4 AS c, o_orderpriority AS p FROM orders) GROUP BY 1")
def consensus_counts(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("query_id"), (F.col("o_orderkey") % 4).alias("channels"), F.col("o_orderpriority").alias("path"), F.col("o_totalprice").alias("score"))
    return tables.consensus(rows)


@query("SELECT event_type AS name, round(sum(value), 6) AS wall, round(sum(value / 2), 6) AS cpu, count(*) AS times FROM events GROUP BY event_type")
def stage_seconds(spark, d):
    return tables.stage_times(table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("value").alias("wall"), (F.col("value") / 2).alias("cpu")))


@query("SELECT count(*) AS files, count(DISTINCT text) AS blobs, sum(n_chars) AS bytes FROM documents")
def ledger_counts(spark, d):
    return tables.ledger_counts(table(spark, d, "documents").select(F.sha2("text", 256).alias("hash"), F.col("n_chars").alias("size")))


@query("SELECT CASE WHEN event_type = 'click' THEN 'index' ELSE 'query' END AS kind, event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS \"at\" FROM events WHERE user_id = 3")
def call_timeline(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.unix_timestamp("ts").alias("at"), F.col("user_id").alias("call_id"), "event_type")
    return tables.call_timeline(rows.where("event_type = 'click'"), rows.where("event_type != 'click'"), F.lit(3))


@query("""
WITH c AS (SELECT o_custkey % 20 AS query_id, o_orderkey AS chunk_id, CASE o_orderkey % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'cpp' ELSE 'python' END AS language, 'A::f' || o_orderkey % 9 AS fqn, 'p' || o_orderkey % 4 AS path, CASE WHEN o_orderkey % 5 = 0 THEN 'f() {' ELSE 'f();' END AS content, o_totalprice AS score FROM orders),
k AS (SELECT *, CASE WHEN language IN ('c', 'cpp') THEN fqn ELSE path || '|' || fqn END AS key FROM c)
SELECT query_id, chunk_id FROM k QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY (language IN ('c', 'cpp') AND contains(content, '{')) DESC, score DESC, chunk_id) = 1
""")
def same_symbol(spark, d):
    k = F.col("o_orderkey")
    language = F.when(k % 3 == 0, "c").when(k % 3 == 1, "cpp").otherwise("python")
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("query_id"), k.alias("chunk_id"), language.alias("language"), F.concat(F.lit("A::f"), k % 9).alias("fqn"), F.concat(F.lit("p"), k % 4).alias("path"), F.when(k % 5 == 0, "f() {").otherwise("f();").alias("content"), F.col("o_totalprice").alias("score"))
    return tables.same_symbol(rows).select("query_id", "chunk_id")
