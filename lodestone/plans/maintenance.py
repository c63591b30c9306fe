"""Queries of chunking, linking, rendering and service operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import normalize_newlines
from lodestone.operators import chunking, linking, rendering, service
from lodestone.plans.registry import query, table

# ------------------------------------------------------------------ chunking


def _texts(spark, d):
    return table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), "text", "doc_id")


#: Of each document with three lines or more, lines 2 and 3 are a function; the rest becomes fallback chunks.
@query("""
WITH d AS (SELECT doc_id, string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)) AS lines FROM (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents))
SELECT 'd' || doc_id || ':f:2' AS id, CAST(2 AS INT) AS start_line, CAST(3 AS INT) AS end_line, sha256(lines[2] || chr(10) || lines[3]) AS content_hash FROM d WHERE len(lines) >= 3
""")
def symbol_chunks(spark, d):
    files = _texts(spark, d)
    symbols = files.select("path", F.lit("f").alias("fqn"), F.lit("function").alias("kind"), F.lit(2).alias("start_line"), F.lit(3).alias("end_line"), F.size(F.split(F.regexp_replace(normalize_newlines(F.col("text")), "\n$", ""), "\n")).alias("n"))
    none = spark.createDataFrame([], "path string, heading_path string, start_line int, end_line int")
    return chunking.structural(files, symbols.where("n >= 3"), none).where("symbol_kind = 'function'").select("id", "start_line", "end_line", "content_hash")


@query("""
WITH s AS (SELECT 'p' || l_suppkey % 10 AS path, CASE WHEN l_linenumber = 1 THEN 'C' || l_orderkey % 50 ELSE 'C' || l_orderkey % 50 || '.m' || l_linenumber END AS fqn, CASE WHEN l_linenumber = 1 THEN 'class' ELSE 'method' END AS kind, CAST(l_partkey % 100 + 1 AS INT) AS a, CAST(l_partkey % 100 + 40 AS INT) AS b FROM lineitem)
SELECT c.path, c.fqn, min(m.a) AS member_line FROM s c JOIN s m ON c.path = m.path AND starts_with(m.fqn, c.fqn || '.') AND m.a BETWEEN c.a AND c.b WHERE c.kind = 'class' GROUP BY ALL
""")
def first_member_lines(spark, d):
    owner = F.concat(F.lit("C"), F.col("l_orderkey") % 50)
    first = F.col("l_linenumber") == 1
    rows = table(spark, d, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_suppkey") % 10).alias("path"),
        F.when(first, owner).otherwise(F.concat(owner, F.lit(".m"), "l_linenumber")).alias("fqn"),
        F.when(first, "class").otherwise("method").alias("kind"),
        (F.col("l_partkey") % 100 + 1).cast("int").alias("start_line"),
        (F.col("l_partkey") % 100 + 40).cast("int").alias("end_line"),
    )
    return chunking.first_members(rows)


@query("SELECT p_partkey, p_brand || ' :: ' || p_name || chr(10) || chr(10) || p_type || chr(10) || chr(10) || 'body of ' || p_size AS embed FROM part")
def embedding_texts(spark, d):
    content = F.concat("p_type", F.lit("\n"), F.lit("body of "), "p_size")
    return table(spark, d, "part").select("p_partkey", chunking.embedding_text(F.col("p_brand"), F.col("p_name"), F.col("p_type"), F.lit(" "), content).alias("embed"))


@query("SELECT doc_id, sha256(CASE WHEN strlen(text) <= 200 THEN text ELSE list_aggregate(list_filter(list_transform(range(1, 201), lambda n: left(text, n)), lambda t: strlen(t) <= 200), 'last') END) AS cut FROM documents")
def byte_cuts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(chunking.cut_bytes(F.col("text"), 200), 256).alias("cut"))


@query("SELECT count(*) AS docs, sum(n_chars) AS tokens, true AS fits FROM documents")
def token_batches(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("tokens"))
    made = chunking.batches(rows, "tokens", 64, 50_000).groupBy("batch").agg(F.count("*").alias("n"), F.sum("tokens").alias("used"))
    fits = F.bool_and((F.col("n") == 1) | ((F.col("n") <= 64) & (F.col("used") <= 50_000)))
    return made.agg(F.sum("n").alias("docs"), F.sum("used").alias("tokens"), fits.alias("fits"))


# ------------------------------------------------------------------ linking


@query("SELECT o_orderkey AS id, 'lib/m' || o_custkey % 30 || '/n.py' AS path FROM orders WHERE o_custkey % 30 < 20")
def import_hint_files(spark, d):
    refs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("app/x.py").alias("file_path"), F.concat(F.lit("m"), F.col("o_custkey") % 30, F.lit(".n.f"), "o_orderkey").alias("reference_name"))
    files = spark.range(20).select(F.concat(F.lit("lib/m"), "id", F.lit("/n.py")).alias("path")).unionByName(spark.range(20).select(F.concat(F.lit("lib/xm"), "id", F.lit("/n.py")).alias("path")))
    return linking.hinted_files(refs, files)


#: Module k exports what module k // 2 exports, down to 0, where it is defined; eight symbols are as far as a chain is followed.
@query("WITH RECURSIVE c AS (SELECT p_partkey AS ref, p_partkey % 600 AS k, 1 AS n FROM part UNION ALL SELECT ref, k // 2, n + 1 FROM c WHERE k > 0) SELECT ref, 'm0.ts::x' AS fqn FROM c WHERE k = 0 AND n <= 8")
def module_resolution(spark, d):
    module = spark.range(600)
    symbols = module.select(F.concat(F.lit("m"), "id", F.lit(".ts::x")).alias("fqn"), F.lit("x").alias("name"), F.concat(F.lit("m"), "id", F.lit(".ts")).alias("file_path"), F.lit("function").alias("kind"), F.lit(True).alias("is_exported"))
    edges = module.where("id > 0").select(F.concat(F.lit("m"), "id", F.lit(".ts::x")).alias("source"), F.concat(F.lit("js:./m"), F.floor(F.col("id") / 2), F.lit("#x")).alias("target"), F.lit("exports").alias("kind"), F.lit("parsed").alias("provenance"))
    refs = table(spark, d, "part").select(F.col("p_partkey").alias("ref"), F.concat(F.lit("js:./m"), F.col("p_partkey") % 600, F.lit("#x")).alias("target"), F.lit("main.ts").alias("source_file"), F.lit("calls").alias("kind"))
    return linking.resolve_modules(refs, symbols, symbols.select(F.col("file_path").alias("path")), edges)


@query("""
WITH s AS (SELECT DISTINCT 'm' || p_size AS method, 'C' || p_partkey % 3 || '.m' || p_size AS fqn FROM part WHERE p_size > 3 OR p_partkey % 3 = 0), u AS (SELECT method, min(fqn) AS fqn FROM s GROUP BY method HAVING count(*) = 1)
SELECT DISTINCT 'obj->m' || o_custkey % 60 AS target, fqn FROM orders JOIN u ON method = 'm' || o_custkey % 60
""")
def member_call_targets(spark, d):
    part = table(spark, d, "part").where("p_size > 3 OR p_partkey % 3 = 0")
    method = F.concat(F.lit("m"), "p_size")
    symbols = part.select(F.concat(F.lit("C"), F.col("p_partkey") % 3, F.lit("."), method).alias("fqn"), method.alias("name"), F.col("p_partkey").alias("chunk_id"), F.lit("method").alias("kind"), F.lit("a.cc").alias("file_path"))
    targets = table(spark, d, "orders").select(F.concat(F.lit("obj->m"), F.col("o_custkey") % 60).alias("target")).distinct()
    return linking.member_calls(targets, symbols).select("target", "fqn")


def _resolved(spark, d):
    """Edges and references after a third of the orders' references is resolved, a third has failed and a third waits."""
    key = F.col("o_orderkey")
    refs = table(spark, d, "orders").select(key.alias("id"), F.lit("a.py").alias("file_path"), F.concat(F.lit("m.f"), "o_custkey").alias("reference_name"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("name_tail"))
    resolved = table(spark, d, "orders").where(key % 3 < 2).select(key.alias("id"), F.lit("s").alias("source"), F.when(key % 3 == 0, F.concat(F.lit("f"), "o_custkey")).alias("target"), F.lit("calls").alias("kind"), F.lit(1).alias("line"), F.lit("parsed").alias("provenance"))
    customers = table(spark, d, "customer").where("c_custkey % 4 = 0")
    edges = customers.select(F.lit("a.py").alias("file_path"), F.lit("s").alias("source"), F.concat(F.lit("f"), "c_custkey").alias("target"), F.lit("calls").alias("kind"), F.lit(1).alias("line"), F.lit("synthesized").alias("provenance"))
    return linking.write_resolved(edges, refs, resolved)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 1 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 3 = 1 THEN 'f' || o_custkey END AS name_tail FROM orders WHERE o_orderkey % 3 > 0")
def resolution_writes(spark, d):
    return _resolved(spark, d)[1].select("id", "status", "name_tail")


@query("""
SELECT 'f' || c_custkey AS target, 'synthesized' AS provenance FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT DISTINCT 'f' || o_custkey, 'parsed' FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)
""")
def resolution_edges(spark, d):
    return _resolved(spark, d)[0].select("target", "provenance")


@query("SELECT doc_id, CAST(1 AS INT) AS first, CAST(least(10, len(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)))) AS INT) AS last FROM documents")
def focused_heads(spark, d):
    cut = table(spark, d, "documents").select("doc_id", rendering.focused(F.col("text"), F.lit(1), F.lit(""), F.lit("p"), F.array().cast("array<int>"), 10).alias("s"))
    return cut.select("doc_id", F.col("s")[0]["start"].alias("first"), F.element_at("s", -1)["end"].alias("last"))


@query(f"""
WITH g AS (SELECT o_custkey AS q, min(o_orderkey) AS position, replace('{rendering.ASK["graph_boundary"]}', '{{}}', o_orderpriority) AS ask FROM orders WHERE o_custkey % 2 = 0 GROUP BY q, ask)
SELECT q AS query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY position, ask) AS INT) AS place, ask FROM g QUALIFY place <= 3
""")
def next_query_templates(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("symbol"), F.lit("graph_boundary").alias("code"))
    queries = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), (F.col("c_custkey") % 2 == 1).alias("answerable"))
    return rendering.next_queries(queries, o, spark.createDataFrame([], "query_id long, position int, path string, heading_path string"))


# ------------------------------------------------------------------ service


@query("SELECT o_orderkey AS session, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 5 > 0")
def session_users(spark, d):
    users = table(spark, d, "customer").where("c_custkey % 5 > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return service.owned_by(table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("session")), users).select("session", "name")


@query("SELECT o_orderkey AS used, c_name AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 > 0) ON c_custkey = o_custkey")
def invite_users(spark, d):
    users = table(spark, d, "customer").where("c_custkey % 5 > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return service.invite_uses(table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("used")), users).select("used", "name")


@query("SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'deleted' WHEN doc_id % 5 > 0 AND doc_id % 3 > 0 AND doc_id % 4 > 0 THEN 'unchanged' ELSE 'changed' END AS state FROM documents")
def client_scan(spark, d):
    docs, key = table(spark, d, "documents"), F.col("doc_id")
    now = docs.where("doc_id % 7 > 0").select(key.alias("path"), F.md5("text").alias("hash"))
    cached = docs.where("doc_id % 5 > 0 OR doc_id % 7 = 0").select(key.alias("path"), F.when(key % 3 > 0, F.md5("text")).otherwise("old").alias("hash"), F.when(key % 4 > 0, "k").otherwise("other").alias("config"))
    return service.client_scan(now, cached, "k")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 > 0 AND doc_id % 5 > 0")
def accepted_uploads(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("path"))
    return service.uploaded(docs, docs.where("doc_id % 3 > 0"), docs.where("doc_id % 5 = 0")).select("doc_id")


@query("SELECT d.doc_id AS path, length(s.text) AS size FROM documents d LEFT JOIN (SELECT any_value(text) AS text, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0 GROUP BY sha256(text)) s ON h = sha256(d.text)")
def blob_source(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("blob_hash"), "text")
    stored = docs.where("doc_id % 2 = 0").groupBy("blob_hash").agg(F.first("text").alias("content"))
    return service.blobs(docs.select(F.col("doc_id").alias("path"), "blob_hash"), stored).select("path", F.length("content").cast("long").alias("size"))


@query("SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_linenumber = 6) = 0")
def written_batches(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.when(F.col("l_linenumber") == 6, "bad").alias("error"))
    return service.split_errors(rows, "error", "k")[0].groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id FROM events WHERE epoch(TIMESTAMP '2024-01-20') - floor(epoch(ts)) < 86400")
def live_entries(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("at"))
    return service.live(rows, "at", 86_400, 1_705_708_800).select("user_id", "event_id")


@query("SELECT user_id AS query, event_type AS model, max_by(event_id, floor(epoch(ts)) * 1e7 + event_id) AS event_id FROM events GROUP BY ALL ORDER BY max(floor(epoch(ts))) DESC, model, query LIMIT 20")
def cache_fifo(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("query"), F.col("event_id"), F.unix_timestamp("ts").alias("s"))
    own = rows.groupBy("model", "query").agg(F.max_by("event_id", F.struct("s", "event_id")).alias("event_id"), F.max("s").alias("at"))
    return service.cache_after(own.limit(0), own, 20).select("model", "query", "event_id")


@query("SELECT c_custkey AS project, CASE WHEN c_custkey % 4 = 0 OR 100 - c_custkey % 90 >= 60 THEN 'due' WHEN c_custkey % 3 = 0 THEN 'pending' ELSE 'recent' END AS state FROM customer")
def rescan_states(spark, d):
    key = F.col("c_custkey")
    return service.rescans(table(spark, d, "customer").select(key.alias("project"), F.when(key % 4 > 0, key % 90).alias("last"), F.lit(60).alias("interval"), (key % 3 == 0).alias("pending")), 100)


@query("SELECT count(*) FILTER (k IN (0, 1, 2, 3)) AS upserted, count(*) FILTER (k = 0) AS embedded, count(*) FILTER (k IN (1, 2, 3)) AS deduped, count(*) FILTER (k = 4) AS skipped FROM (SELECT o_orderkey % 5 AS k FROM orders)")
def embedding_counts(spark, d):
    kinds = F.array(*(F.lit(x) for x in ("embedded", "shared", "reused", "cached", "skipped")))
    return service.embedding_stats(table(spark, d, "orders").select(F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("action")))


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS added, count(*) FILTER (o_orderstatus = 'O') AS modified, count(*) FILTER (o_orderstatus = 'P') AS deleted, (SELECT count(*) FROM lineitem) AS chunks, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS skipped FROM orders")
def ingest_counts(spark, d):
    change = F.when(F.col("o_orderstatus") == "F", "added").when(F.col("o_orderstatus") == "O", "modified").otherwise("deleted")
    lines = table(spark, d, "lineitem")
    return service.ingest_counters(table(spark, d, "orders").select(change.alias("change")), lines, lines.select(F.col("l_orderkey").alias("path")))


@query("SELECT (SELECT max(c_custkey) FROM customer) AS latest, (SELECT count(*) FROM customer) AS files, (SELECT max(o_orderkey) FROM orders) AS edges, (SELECT max(p_partkey) FROM part) AS symbols")
def content_signature(spark, d):
    return service.content_signature(table(spark, d, "customer").select(F.col("c_custkey").alias("indexed_at")), table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), table(spark, d, "part").select(F.col("p_partkey").alias("id")))
