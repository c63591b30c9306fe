"""Queries of files and sinks, changes and the ledger, chunks, evidence and features, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import channels, chunking, fusion, gap, graph, incremental, ingest, linking, packing, rendering, service, snapshots, tables
from lodestone.plans.cases import NAMES, PATHS
from lodestone.plans.registry import query, table, work_dir
from lodestone.sources import files, sinks
from lodestone.streaming import stateful


# ------------------------------------------------------------------ files and sinks


NATION_FILES = "f AS (SELECT 'r' || n_regionkey || '/n' || n_nationkey || '.json' AS path, '{\"name\": \"' || n_name || '\", \"region\": ' || n_regionkey || '}' AS text FROM nation)"


def _nation_files(spark: SparkSession, d: str) -> str:
    """A folder with a small file for each nation (a table of fixed size), one of them in a folder that is never read."""
    root = work_dir(spark)
    for r in table(spark, d, "nation").collect():
        sinks.write_side_file(spark, f"{root}/r{r['n_regionkey']}/n{r['n_nationkey']}.json", {"name": r["n_name"], "region": r["n_regionkey"]})
    sinks.write_text(spark, f"{root}/node_modules/x.js", "never read")
    return root


@query(f"WITH {NATION_FILES} SELECT path, length(text) AS length, text, CAST(NULL AS VARCHAR) AS skip_reason FROM f")
def scanned_files(spark, d):
    return files.directory(spark, _nation_files(spark, d)).select("path", "length", "text", "skip_reason")


@query(f"WITH {NATION_FILES} SELECT count(*) + 1 AS files, CAST(sum(length(text)) + 10 AS BIGINT) AS bytes FROM f")
def directory_totals(spark, d):
    return files.directory_size(spark, _nation_files(spark, d))


@query("SELECT n_nationkey, n_name AS name, n_regionkey AS region FROM nation")
def side_file_values(spark, d):
    root = _nation_files(spark, d)
    keys = table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()
    rows = [(k["n_nationkey"], sinks.read_side_file(spark, f"{root}/r{k['n_regionkey']}/n{k['n_nationkey']}.json")) for k in keys]
    return spark.createDataFrame([(n, v["name"], v["region"]) for n, v in rows], "n_nationkey int, name string, region int")


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation")
def golden_lines(spark, d):
    root = work_dir(spark)
    rows = table(spark, d, "nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("j")).collect()
    sinks.write_text(spark, f"{root}/golden.jsonl", "# questions\n\n" + "\n  # more\n".join(r["j"] for r in rows) + "\n")
    sinks.write_text(spark, f"{root}/other.txt", "not read")
    return files.json_lines(spark, root, "id int, name string, region int", "id")


@query("SELECT event_id, event_type FROM events")
def log_entries(spark, d):
    root = work_dir(spark)
    whole = table(spark, d, "events").select(F.when(F.col("event_id") % 7 == 0, F.concat_ws("\n", F.lit("not json"), F.to_json(F.struct("event_id", "event_type")))).otherwise(F.to_json(F.struct("event_id", "event_type"))).alias("value"))
    whole.write.text(root)
    return files.request_log(spark, root, "event_id long, event_type string")


@query("""
SELECT '| ' || r_regionkey || ' | ' || r_name || '\\|x |' AS line FROM region
UNION ALL SELECT unnest(['# Regions', '', '| r_regionkey | told |', '|---|---|'])
""")
def report_lines(spark, d):
    root = work_dir(spark)
    sinks.write_report(table(spark, d, "region").select("r_regionkey", F.concat("r_name", F.lit("|x")).alias("told")), root, "Regions", ["r_regionkey"])
    return spark.read.text(root).select(F.col("value").alias("line"))


@query("SELECT source || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.txt' END AS path, n_chars AS length FROM documents WHERE doc_id % 3 = 0")
def unversioned_files(spark, d):
    path = F.concat_ws("", "source", F.lit("/"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".md").otherwise(".txt"))
    rows = table(spark, d, "documents").select(path.alias("path"), F.col("n_chars").alias("length"))
    return service.check_limits(rows, 10**9, 10**9, 1 << 40)


PREPARED = "['x.py', 'x.h', 'x.md', 'x.json', 'x.cc'][1 + doc_id % 5]"


@query(f"""
WITH f AS (SELECT doc_id, {PREPARED} AS name, text, octet_length(encode(text)) AS bytes, doc_id % 11 = 0 AS zero FROM documents)
SELECT doc_id, CASE WHEN name IN ('x.h', 'x.cc') THEN 'cpp' WHEN name = 'x.py' THEN 'python' WHEN name = 'x.md' THEN 'markdown' END AS language,
  CASE WHEN bytes + zero::INT > CASE WHEN name = 'x.json' THEN 131072 ELSE 1048576 END THEN 'oversize:' || (bytes + zero::INT) WHEN zero THEN 'binary' END AS skip_reason,
  CASE WHEN NOT zero AND bytes <= CASE WHEN name = 'x.json' THEN 131072 ELSE 1048576 END THEN sha256(text) END AS content_hash, false AS generated
FROM f
""")
def prepared_files(spark, d):
    names = F.array(*(F.lit(f"x.{e}") for e in ("py", "h", "md", "json", "cc")))
    raw = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % 11 == 0, F.concat(F.unhex(F.lit("00")), raw)).otherwise(raw)
    rows = table(spark, d, "documents").select("doc_id", F.get(names, (F.col("doc_id") % 5).cast("int")).alias("path"), content.alias("content"))
    return chunking.prepare(rows).select("doc_id", "language", "skip_reason", "content_hash", "generated")


# ------------------------------------------------------------------ changes, the cascade and the ledger


CHANGES = """ch AS (SELECT 'p' || l_partkey AS path, l_orderkey * 10 + l_linenumber AS seq, CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'N' THEN 'modified' ELSE 'deleted' END AS op, 'h' || l_suppkey AS hash FROM lineitem)"""


def changes(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "A", "added").when(F.col("l_returnflag") == "N", "modified").otherwise("deleted")
    return table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), flag.alias("op"), F.concat(F.lit("h"), "l_suppkey").alias("hash"))


@query(f"WITH {CHANGES} SELECT path, max(seq) AS seq, max_by(op, seq) AS op FROM ch GROUP BY path")
def last_changes(spark, d):
    return incremental.effective_changes(changes(spark, d)).select("path", "seq", "op")


@query(f"WITH {CHANGES} SELECT path, max_by(hash, seq) AS hash FROM ch GROUP BY path HAVING max_by(op, seq) <> 'deleted'")
def streamed_changes(spark, d):
    root = work_dir(spark)
    rows = changes(spark, d)
    bounds = [r[0] for r in rows.select(F.percentile_approx("seq", F.array(F.lit(0.33), F.lit(0.66)))).collect()][0]
    for part in (F.col("seq") <= bounds[0], (F.col("seq") > bounds[0]) & (F.col("seq") <= bounds[1]), F.col("seq") > bounds[1]):
        rows.where(part).write.mode("append").parquet(f"{root}/in")
    each = -(-len(spark.read.parquet(f"{root}/in").inputFiles()) // 3)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(f"{root}/in")
    log = stateful.ChangeLog(spark, f"{root}/table", compact_every=2)
    log.apply(stream, f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return log.current()


#: Of all documents a first commit takes all lines; a second one changes, removes and adds some files in both tables at once.
@query("""
WITH d AS (SELECT 'd' || doc_id AS path, doc_id, text FROM documents),
after AS (SELECT path, CASE WHEN doc_id % 10 = 0 THEN text || chr(10) || 'more' ELSE text END AS text FROM d WHERE doc_id % 10 <> 1 UNION ALL SELECT 'n' || doc_id, text FROM d WHERE doc_id % 10 = 2)
SELECT path, md5(text) AS hash, len(string_split(text, chr(10))) AS chunks, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: md5(x)), '')) AS content,
  (SELECT count(*) FROM d WHERE doc_id % 10 = 2) AS added, (SELECT count(*) FROM d WHERE doc_id % 10 = 0) AS modified, (SELECT count(*) FROM d WHERE doc_id % 10 = 1) AS deleted,
  (SELECT sum(len(string_split(text, chr(10)))) FROM after WHERE starts_with(path, 'n') OR path IN (SELECT path FROM d WHERE doc_id % 10 = 0))::BIGINT AS chunks_written FROM after
""")
def committed_tables(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), "doc_id", "text")
    schemas = {"files": spark.createDataFrame([], "path string, hash string").schema, "chunks": spark.createDataFrame([], "path string, nr int, hash string").schema}
    store = snapshots.Snapshots(spark, work_dir(spark), schemas, buckets=16)

    def rows(of: DataFrame) -> dict[str, DataFrame]:
        return {"files": of.select("path", F.md5("text").alias("hash")), "chunks": of.select("path", F.posexplode(F.split("text", "\n")).alias("nr", "line")).select("path", "nr", F.md5("line").alias("hash"))}

    store.commit(docs.select("path", F.lit("added").alias("change")), rows(docs))
    last = F.col("doc_id") % 10
    changed = docs.where(last == 0).select("path", F.concat("text", F.lit("\nmore")).alias("text"), F.lit("modified").alias("change"))
    added = docs.where(last == 2).select(F.concat(F.lit("n"), "doc_id").alias("path"), "text", F.lit("added").alias("change"))
    gone = docs.where(last == 1).select("path", F.lit(None).cast("string").alias("text"), F.lit("deleted").alias("change"))
    new = changed.unionByName(added)
    store.commit(new.unionByName(gone).select("path", "change"), rows(new))
    held = store.read("chunks").groupBy("path").agg(F.count("*").alias("chunks"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nr", "hash"))), lambda x: x["hash"]), "")).alias("content"))
    counted = store.counters()
    return store.read("files").join(held, "path").select("path", "hash", "chunks", "content", *(F.lit(counted[k]).cast("long").alias(k) for k in ("added", "modified", "deleted", "chunks_written")))


@query("""
WITH v AS (SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS seq, l_suppkey AS value FROM lineitem), o AS (SELECT p_partkey AS id, CAST(0 AS BIGINT) AS seq, CAST(-1 AS BIGINT) AS value FROM part)
SELECT id, max(seq) AS seq, max_by(value, seq) AS value FROM (SELECT * FROM o UNION ALL SELECT * FROM v WHERE id % 3 = 0) GROUP BY id
""")
def vector_upserts(spark, d):
    new = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_suppkey").alias("value")).where("id % 3 = 0")
    old = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(0).cast("long").alias("seq"), F.lit(-1).cast("long").alias("value"))
    return incremental.upsert_last(old, new, "id", "seq")


@query("""
WITH gone AS (SELECT DISTINCT p_brand AS path FROM part WHERE p_brand LIKE '%1'), c AS (SELECT p_partkey AS chunk_id, p_brand AS path FROM part), v AS (SELECT p_partkey AS chunk_id FROM part WHERE p_partkey % 2 = 0),
s AS (SELECT s_suppkey AS section_id, 'Brand#' || (11 + s_suppkey % 5) AS path FROM supplier), l AS (SELECT DISTINCT l_suppkey AS section_id, l_partkey AS symbol_id FROM lineitem)
SELECT 'chunks' AS name, count(*) AS n FROM c WHERE path NOT IN (SELECT path FROM gone)
UNION ALL SELECT 'vectors', count(*) FROM v JOIN c USING (chunk_id) WHERE path NOT IN (SELECT path FROM gone)
UNION ALL SELECT 'sections', count(*) FROM s WHERE path NOT IN (SELECT path FROM gone)
UNION ALL SELECT 'section_links', count(*) FROM l WHERE section_id NOT IN (SELECT section_id FROM s WHERE path IN (SELECT path FROM gone))
""")
def cascaded_deletes(spark, d):
    p = table(spark, d, "part")
    index = {
        "chunks": p.select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("path")),
        "vectors": p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("chunk_id")),
        "sections": table(spark, d, "supplier").select(F.col("s_suppkey").alias("section_id"), F.concat(F.lit("Brand#"), 11 + F.col("s_suppkey") % 5).alias("path")),
        "section_links": table(spark, d, "lineitem").select(F.col("l_suppkey").alias("section_id"), F.col("l_partkey").alias("symbol_id")).distinct(),
    }
    left = incremental.cascade_delete(index, p.where("p_brand LIKE '%1'").select(F.col("p_brand").alias("path")))
    out = None
    for name, rows in left.items():
        one = rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""
WITH o AS (SELECT p_partkey AS id, 'n' || p_partkey % 900 AS fqn FROM part), w AS (SELECT p_partkey + CASE WHEN p_partkey % 4 = 0 THEN 100000 ELSE 0 END AS id, 'n' || p_partkey % 900 AS fqn FROM part WHERE p_partkey % 900 % 7 <> 0),
r AS (SELECT DISTINCT l_orderkey AS spec, l_partkey AS symbol FROM lineitem), k AS (SELECT fqn, count(*) AS n, min(id) AS id FROM o GROUP BY fqn), m AS (SELECT fqn, count(*) AS n, min(id) AS id FROM w GROUP BY fqn)
SELECT spec, CASE WHEN k.n = 1 AND m.n = 1 THEN m.id ELSE symbol END AS symbol, m.fqn IS NULL AS stale FROM r JOIN o ON o.id = symbol JOIN k USING (fqn) LEFT JOIN m USING (fqn)
""")
def stale_cascade(spark, d):
    old = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("n"), F.col("p_partkey") % 900).alias("fqn"))
    new = old.where("id % 900 % 7 <> 0").withColumn("id", F.when(F.col("id") % 4 == 0, F.col("id") + 100000).otherwise(F.col("id")))
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("spec"), F.col("l_partkey").alias("symbol")).distinct()
    return incremental.stale_references(refs, old, new)


@query("SELECT * FROM (VALUES (0, 'none'), (1, 'full_reparse'), (2, 'reembed'), (3, 'reembed'), (4, 'none')) AS t(n, action)")
def invalidations(spark, d):
    keys = table(spark, d, "region").select(F.col("r_regionkey").alias("n"))
    stored = {1: {"parser_config_hash": "old", "embedding_model": "m", "embedding_dim": "8"}, 2: {"parser_config_hash": "p", "embedding_model": "other", "embedding_dim": "8"}, 3: {"parser_config_hash": "p", "embedding_model": "m"}, 4: {"parser_config_hash": "p", "embedding_model": "m", "embedding_dim": "8"}}
    out = None
    for n in range(5):
        config = spark.createDataFrame(list(stored.get(n, {}).items()), "key string, value string")
        one = keys.where(F.col("n") == n).crossJoin(incremental.invalidation(config, "p", "m", 8))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT DISTINCT p_brand AS hash FROM part WHERE p_brand NOT IN (SELECT 'Brand#' || (11 + s_suppkey % 20) FROM supplier)")
def orphaned_blobs(spark, d):
    blobs = table(spark, d, "part").select(F.col("p_brand").alias("hash")).distinct()
    return incremental.orphans(blobs, table(spark, d, "supplier").select(F.concat(F.lit("Brand#"), 11 + F.col("s_suppkey") % 20).alias("hash")))


@query("""SELECT r_regionkey AS n, CASE r_regionkey WHEN 0 THEN 'files' WHEN 1 THEN 'chunks' WHEN 2 THEN 'vectors' END AS reason FROM region""")
def index_gaps(spark, d):
    counted = table(spark, d, "documents").agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("files"))
    total = counted.select(F.col("chunks").alias("c"), F.col("files").alias("f"))
    n = F.col("r_regionkey")
    stored = table(spark, d, "region").crossJoin(F.broadcast(total)).select(
        n.alias("n"), F.when(n == 3, "building").otherwise("ready").alias("state"), (F.col("f") + F.when(n.isin(0, 3), 1).otherwise(0)).alias("files"), (F.col("c") + F.when(n == 1, 1).otherwise(0)).alias("chunks"), F.when(n == 2, 0).otherwise(1).alias("vectors")
    )
    out = None
    for i in range(5):
        one = stored.where(n == i)
        part = one.select("n").crossJoin(tables.index_gap(counted, one.drop("n")))
        out = part if out is None else out.unionByName(part)
    return out


def _sources(spark: SparkSession, d: str, called: str) -> DataFrame:
    """A Python file for each document: a function that calls that of another one, and one that nothing defines."""
    i = F.col("doc_id")
    body = F.concat(F.lit("def f"), i, F.lit("():\n    "), F.lit(called), i % 50, F.lit("()\n    missing()\n"))
    return table(spark, d, "documents").select(i, F.concat(F.lit("d"), i % 10, F.lit("/m"), i, F.lit(".py")).alias("path"), F.encode(body, "UTF-8").alias("content"))


@query("""
WITH d AS (SELECT doc_id AS i, doc_id % 7 = 0 AS gone, doc_id % 7 <> 0 AND doc_id % 5 = 0 AS changed FROM documents), k AS (SELECT * FROM d WHERE NOT gone), n AS (SELECT count(*) AS n FROM k), t AS (SELECT i, i % 50 AS called FROM k),
names AS (SELECT i FROM d), r AS (SELECT t.i, changed, EXISTS (SELECT 1 FROM names WHERE names.i = called) AS known FROM t JOIN d ON d.i = t.i)
SELECT 'files' AS name, n AS n FROM n UNION ALL SELECT 'symbols', n FROM n UNION ALL SELECT 'chunks', n FROM n UNION ALL SELECT 'edges', 2 * n FROM n
UNION ALL SELECT 'failed', count(*) + count(*) FILTER (changed AND NOT EXISTS (SELECT 1 FROM k WHERE k.i = called)) + count(*) FILTER (NOT changed AND NOT EXISTS (SELECT 1 FROM d WHERE d.i = called)) FROM (SELECT t.*, changed FROM t JOIN d ON d.i = t.i)
UNION ALL SELECT 'embedded', count(*) FROM k WHERE changed UNION ALL SELECT 'skipped', count(*) FROM k WHERE NOT changed UNION ALL SELECT 'modified', count(*) FROM k WHERE changed UNION ALL SELECT 'deleted', count(*) FROM d WHERE gone
""")
def ingested_index(spark, d):
    """Two ingests: all files, then a batch that modifies some and deletes others."""
    first, second = _sources(spark, d, "f"), _sources(spark, d, "pass; f")
    none = spark.createDataFrame([], "hash string")
    i = F.col("doc_id")
    added = first.select("path", i.alias("seq"), F.lit("added").alias("op"))
    root = work_dir(spark)
    stored = ingest.ingest(ingest.empty(spark), first.select("path", "content"), added, none, f"{root}/first")
    changed = second.where("doc_id % 7 = 0 OR doc_id % 5 = 0").select("path", i.alias("seq"), F.when(i % 7 == 0, "deleted").otherwise("modified").alias("op"))
    after = ingest.ingest(stored, second.where("doc_id % 5 = 0").select("path", "content"), changed, none, f"{root}/second")
    count = lambda name, rows: rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    parts = [count(name, after[name]) for name in ("files", "symbols", "chunks", "edges")]
    parts.append(count("failed", after["edges"].where("provenance = 'failed'")))
    parts += [count(a, after["actions"].where(F.col("action") == a)) for a in ("embedded", "skipped")]
    parts += [after["counters"].select(F.lit(name).alias("name"), F.col(name).alias("n")) for name in ("modified", "deleted")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ------------------------------------------------------------------ chunks


@query("""
SELECT 'p' || l_partkey AS path, l_orderkey AS line, 'm' || l_linenumber AS message FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, 'm' || l_linenumber) <= 20
""")
def parse_errors(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("path"), F.col("l_orderkey").alias("line"), F.concat(F.lit("m"), "l_linenumber").alias("message"))
    return chunking.first_errors(rows)


@query("""
SELECT p_brand AS path, left(trim(regexp_replace(repeat(p_name || '   ', 1 + p_size % 9), '\\s+', ' ', 'g')), 120) AS fqn, 'function' AS kind, p_size AS start_line, p_size AS end_line, min(p_type) AS name
FROM part GROUP BY ALL
""")
def finished_symbols(spark, d):
    fqn = F.expr("repeat(p_name || '   ', 1 + p_size % 9)")
    p = table(spark, d, "part").select(F.col("p_brand").alias("path"), fqn.alias("fqn"), F.lit("function").alias("kind"), F.col("p_size").alias("start_line"), F.col("p_size").alias("end_line"), F.col("p_type").alias("name"))
    return chunking.finalize(p)


# ------------------------------------------------------------------ references and recall


@query("SELECT DISTINCT l_orderkey AS spec, l_partkey AS symbol FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size % 5 = 0)")
def section_references(spark, d):
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("spec"), F.col("l_partkey").alias("symbol")).distinct()
    return linking.references_of(refs, table(spark, d, "part").where("p_size % 5 = 0").select(F.col("p_partkey").alias("symbol")), "symbol")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def membership_rows(spark, d):
    ids = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return linking.members_of(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ids, "o_custkey")


@query("""
WITH a AS (SELECT p_size AS query_id, 'exact' AS channel, p_partkey AS chunk_id, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS INT) AS rank, 0 AS tier, p_name AS detail FROM part),
b AS (SELECT p_size, 'bm25', p_partkey, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS INT), 1, 'bm25' FROM part)
SELECT * FROM a UNION ALL SELECT * FROM b
""")
def gathered_channels(spark, d):
    p = table(spark, d, "part")

    def ranked(order: list) -> DataFrame:
        return p.select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("chunk_id"), F.row_number().over(channels.Window.partitionBy("p_size").orderBy(*order)).alias("rank"), F.col("p_name").alias("detail"))

    def unreachable() -> DataFrame:
        raise TimeoutError("no model")

    rows, _ = channels.gather({"exact": lambda: ranked(["p_partkey"]), "bm25": lambda: ranked([F.desc("p_retailprice"), "p_partkey"]).drop("detail"), "vector": unreachable}, "query_id")
    return rows


@query("""
WITH d AS (SELECT doc_id, lower(source) AS name, lower(source || chr(10) || text) AS blob, ' ' || array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)), '  ') || ' ' AS plain FROM documents),
q AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM benchmark),
p AS (SELECT item_id, 0 AS position, w[1] || ' ' || w[2] AS phrase, true AS strong FROM q UNION ALL SELECT item_id, 1, list_filter(w, lambda x: length(x) >= 6)[1], true FROM q WHERE len(list_filter(w, lambda x: length(x) >= 6)) > 0 UNION ALL SELECT item_id, 2, 'src' || item_id % 4, false FROM q),
h AS (
  SELECT item_id, position, phrase, strong, doc_id, row_number() OVER (PARTITION BY item_id, position ORDER BY (length(plain) - length(replace(plain, s, ''))) / length(s) DESC, doc_id) AS place FROM (SELECT *, ' ' || replace(lower(phrase), ' ', '  ') || ' ' AS s FROM p WHERE position = 0) JOIN d ON contains(plain, s) QUALIFY place <= 30
  UNION ALL SELECT item_id, position, phrase, strong, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY contains(name, lower(phrase)) DESC, (length(blob) - length(replace(blob, lower(phrase), ''))) / length(phrase) DESC, length(blob), doc_id) AS place FROM p JOIN d ON position = 1 AND contains(blob, lower(phrase)) QUALIFY place <= 30
  UNION ALL SELECT item_id, position, phrase, strong, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY length(name), name, doc_id) AS place FROM p JOIN d ON position = 2 AND contains(name, lower(phrase)) QUALIFY place <= 20
), o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY position, place) = 1)
SELECT item_id, doc_id AS chunk_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY position, place, doc_id) AS INT) AS rank, phrase AS detail, CASE WHEN strong THEN 0 ELSE 1 END AS tier FROM o QUALIFY rank <= 30
""")
def literal_channel(spark, d):
    docs = table(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("symbol_fqn"), F.col("text").alias("content"))
    names = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("name"))
    w = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))
    long = F.get(F.filter(w, lambda x: F.length(x) >= 6), F.lit(0))
    told = F.array(F.concat_ws(" ", F.get(w, F.lit(0)), F.get(w, F.lit(1))), long, F.concat(F.lit("src"), F.col("item_id") % 4))
    phrases = table(spark, d, "benchmark").select("item_id", F.posexplode(told).alias("position", "phrase")).where("phrase IS NOT NULL").withColumn("strong", F.col("position") < 2)
    return channels.literal_recall(chunks, names, phrases, "item_id")


# ------------------------------------------------------------------ features, evidence, rendering


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Parts as candidates of ten queries, with the listed paths and names."""
    key = F.col("p_partkey")
    path, name = F.array(*(F.lit(p[0]) for p in PATHS)), F.array(*(F.lit(n[0]) for n in NAMES))
    kind = F.array(*map(F.lit, ("code", "test", "spec", "fallback")))
    return table(spark, d, "part").select(
        (F.col("p_size") % 10).alias("query_id"), key.alias("chunk_id"), F.get(path, (key % len(PATHS)).cast("int")).alias("path"), F.get(kind, (key % 4).cast("int")).alias("kind"), F.get(name, (key % len(NAMES)).cast("int")).alias("symbol_fqn"),
        (F.col("p_size") % 4 + 1).alias("channels"), (1 / (60 + F.col("p_size"))).alias("rrf_score"), F.col("p_retailprice").alias("score"),
    )


def _asked(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    text = F.when(n == 0, "where does the http server parse a request").when(n == 1, "which test covers the http cache").when(n == 2, "changelog of the server").when(n == 3, "show an example").otherwise("get")
    return table(spark, d, "nation").where("n_nationkey < 10").select(n.alias("query_id"), text.alias("query"), F.when(n == 4, F.array(F.lit("DBImpl.Get"), F.lit("Get"))).alias("symbols"))


@query(f"""
WITH p(i, test, changelog, example, doctype, generated, path) AS (VALUES {", ".join(f"({i}, {c[1]}, {c[2]}, {c[3]}, '{c[5]}', false, '{c[0]}')" for i, c in enumerate(PATHS))}),
n(i, words) AS (VALUES {", ".join(f"({i}, string_split('{c[1]}', ' '))" for i, c in enumerate(NAMES))}),
c AS (SELECT p_size % 10 AS query_id, p_partkey AS chunk_id, 1 / (60.0 + p_size) AS rrf, p_size % 4 + 1 AS channels, p_partkey % 4 AS kind, p.*, words, n.i AS name FROM part JOIN p ON p.i = p_partkey % {len(PATHS)} JOIN n ON n.i = p_partkey % {len(NAMES)}),
f AS (SELECT *, CASE query_id WHEN 0 THEN ['http', 'server', 'parse', 'request'] WHEN 1 THEN ['test', 'covers', 'http', 'cache'] WHEN 2 THEN ['changelog', 'server'] WHEN 3 THEN ['show', 'example'] ELSE [] END AS asked FROM c),
s AS (SELECT query_id, chunk_id, rrf, 25 * rrf + CASE WHEN channels >= 3 THEN 0.5 ELSE 0 END + CASE WHEN query_id = 4 AND name = 2 THEN 1.0 ELSE 0 END
  + CASE WHEN kind = 2 AND doctype IN ('agent-instructions', 'design', 'adr', 'readme', 'api') THEN 0.8 ELSE 0 END + CASE WHEN kind = 1 AND query_id <> 1 THEN -1.5 ELSE 0 END + CASE WHEN kind = 3 THEN -0.5 ELSE 0 END
  + CASE WHEN changelog AND query_id <> 2 THEN -1.2 ELSE 0 END + CASE WHEN example AND query_id <> 3 THEN -0.6 ELSE 0 END + 0.15 * least(len(list_intersect(words, asked)), 3) AS score FROM f)
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, round(rrf, 12) DESC, chunk_id) AS INT) AS position FROM s
""")
def feature_scores(spark, d):
    rows = fusion.with_features(_candidates(spark, d), _asked(spark, d))
    return fusion.rerank(rows, "query_id", "chunk_id").select("query_id", "chunk_id", F.round("score", 6).alias("score"), "position")


@query("""
WITH c AS (SELECT p_size % 20 AS query_id, ['docs/a.md', 'docs/zh/a.md', 'docs/ja/a.md', 'README.zh-CN.md', 'README.md', 'x.de.md', 'x.fr.md', 'src/en/a.py'][1 + p_partkey % 8] AS path, p_retailprice AS score FROM part),
k(path, variant_key, locale) AS (VALUES ('docs/a.md', 'docs/a.md', NULL), ('docs/zh/a.md', 'docs/a.md', 'zh'), ('docs/ja/a.md', 'docs/a.md', 'ja'), ('README.zh-CN.md', 'README.md', 'zh'), ('README.md', 'README.md', NULL), ('x.de.md', 'x.md', 'de'), ('x.fr.md', 'x.md', 'fr'), ('src/en/a.py', 'src/en/a.py', NULL)),
b AS (SELECT query_id, path, max(score) AS best FROM c GROUP BY ALL), r AS (SELECT *, CASE WHEN query_id % 2 = 0 THEN coalesce(locale = 'zh', false) ELSE locale IS NULL END AS liked FROM b JOIN k USING (path))
SELECT query_id, path FROM r QUALIFY row_number() OVER (PARTITION BY query_id, variant_key ORDER BY liked DESC, best DESC, path) > 1
""")
def demoted_translations(spark, d):
    some = F.array(*map(F.lit, ("docs/a.md", "docs/zh/a.md", "docs/ja/a.md", "README.zh-CN.md", "README.md", "x.de.md", "x.fr.md", "src/en/a.py")))
    rows = table(spark, d, "part").select((F.col("p_size") % 20).alias("query_id"), F.get(some, (F.col("p_partkey") % 8).cast("int")).alias("path"), F.col("p_retailprice").alias("score"))
    asked = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("query_id"), F.when(F.col("n_nationkey") % 2 == 0, "怎么安装").otherwise("how to install").alias("query"))
    return fusion.translation_variants(rows, asked)


@query("""
WITH c AS (SELECT l_orderkey AS query_id, l_linenumber * 1000000 + l_partkey AS chunk_id, 'f' || l_suppkey % 3 AS path, CASE l_partkey % 4 WHEN 0 THEN 'code' WHEN 1 THEN 'test' WHEN 2 THEN 'spec' ELSE 'fallback' END AS kind, l_quantity AS score, 1 + l_partkey % 3 AS channels,
  l_partkey % 23 = 0 AS explicit, l_partkey % 29 = 0 AS inferred, l_partkey % 19 = 0 AS literal FROM lineitem),
x AS (SELECT o_orderkey AS query_id, o_orderkey % 31 = 0 AS structural, o_orderkey % 5 = 0 AS boundary, o_orderkey % 7 <> 0 AS has_code, o_orderkey % 11 = 0 AS spec_only FROM orders),
g AS (SELECT query_id, count(*) FILTER (explicit) AS named, count(*) FILTER (inferred) AS guessed, count(*) FILTER (literal AND kind IN ('code', 'test')) AS quoted, count(*) FILTER (channels >= 2) AS agreeing, count(DISTINCT path) FILTER (channels >= 2) AS files,
  count(*) FILTER (channels >= 2 AND kind IN ('code', 'test')) AS coded, max(score) FILTER (channels >= 2) AS peak, median(score) AS middle, arg_max(channels, (score, -chunk_id)) AS top FROM c GROUP BY query_id),
h AS (SELECT g.*, boundary, spec_only, named + guessed + quoted > 0 OR structural AS hard, files >= 2 AND (top >= 2 OR (middle > 0 AND peak >= 2.15 * middle)) AND (coded > 0 OR NOT has_code) AS backed FROM g JOIN x USING (query_id))
SELECT query_id, files, hard OR backed AS answerable, CASE WHEN NOT (hard OR backed) THEN 'low' WHEN named > 0 AND agreeing >= 3 AND NOT boundary THEN 'high' WHEN (agreeing > 0 AND named = 0) OR spec_only OR quoted > 0 THEN 'medium' ELSE 'low' END AS confidence FROM h
""")
def answer_levels(spark, d):
    k = F.col("l_partkey")
    kind = F.when(k % 4 == 0, "code").when(k % 4 == 1, "test").when(k % 4 == 2, "spec").otherwise("fallback")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") * 1000000 + k).alias("chunk_id"), F.concat(F.lit("f"), F.col("l_suppkey") % 3).alias("path"), kind.alias("kind"), F.col("l_quantity").alias("score"), (1 + k % 3).alias("channels"), (k % 23 == 0).alias("explicit"), (k % 29 == 0).alias("inferred"), (k % 19 == 0).alias("literal"))
    o = F.col("o_orderkey")
    context = table(spark, d, "orders").select(o.alias("query_id"), (o % 31 == 0).alias("structural"), (o % 5 == 0).alias("boundary"), (o % 7 != 0).alias("has_code"), (o % 11 == 0).alias("spec_only"))
    return packing.answerability(rows, context)


@query("""
SELECT l_orderkey AS query_id, l_linenumber * 1000000 + l_partkey AS chunk_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 3, (l_partkey % 2 = 0) DESC, l_partkey % 5 DESC, l_quantity DESC, l_suppkey % 10, l_linenumber * 1000000 + l_partkey) AS INT) AS position FROM lineitem
""")
def backfill_places(spark, d):
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") * 1000000 + k).alias("chunk_id"), (s % 3).alias("source_class"), (k % 2 == 0).alias("in_chain"), (k % 5).alias("overlap"), F.col("l_quantity").alias("score"), F.lit(0).alias("start_line"), (s % 10).alias("end_line"))
    return gap.backfill_order(rows).select("query_id", "chunk_id", "position")


@query("""
WITH r AS (SELECT l_orderkey % 500 AS query_id, l_orderkey * 10 + l_linenumber AS id, 'f' || l_suppkey % 4 AS path, l_partkey % 90 AS s, l_partkey % 90 + l_suppkey % 12 AS e, l_partkey % 3 AS elided, l_orderkey % 2 AS extra FROM lineitem),
b AS (SELECT * FROM r WHERE extra = 0), x AS (SELECT * FROM r WHERE extra = 1 AND id % 10 <= 6)
SELECT query_id, id FROM b WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.query_id = b.query_id AND x.path = b.path AND x.s <= b.e AND x.e >= b.s AND x.elided < b.elided AND x.e - x.s > b.e - b.s)
UNION ALL SELECT query_id, id FROM x WHERE NOT EXISTS (SELECT 1 FROM b WHERE x.query_id = b.query_id AND x.path = b.path AND x.s <= b.e AND x.e >= b.s AND NOT (x.elided < b.elided AND x.e - x.s > b.e - b.s))
""")
def merged_packs(spark, d):
    k, s, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("query_id"), F.col("l_orderkey").alias("pack"), line.alias("position"), F.concat(F.lit("f"), s % 4).alias("path"), (k % 90).alias("start_line"), (k % 90 + s % 12).alias("end_line"), (k % 3).alias("elided"), (F.col("l_orderkey") * 10 + line).alias("id"))
    return gap.merge_packs(rows.where("pack % 2 = 0"), rows.where("pack % 2 = 1"), 6).select("query_id", "id")


@query("""
SELECT o_orderkey AS query_id, unnest(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'unresolved_reference' END, CASE WHEN o_orderkey % 5 = 0 THEN 'stale_doc_reference' END, CASE WHEN o_orderkey % 7 > 3 THEN 'retrieval_truncated' END,
  CASE WHEN o_orderkey % 13 = 0 THEN 'no_context_match' END, 'indexing_pending'], lambda x: x IS NOT NULL)) AS code FROM orders
""")
def missing_codes(spark, d):
    o = F.col("o_orderkey")
    asked = table(spark, d, "orders").select(o.alias("query_id"), (o % 3 == 0).cast("int").alias("unresolved"), (o % 5 == 0).cast("int").alias("stale_docs"), (o % 7 > 3).cast("int").alias("omitted"), (o % 13).alias("items"))
    state = table(spark, d, "region").agg(F.lit(False).alias("stale"), F.count("*").alias("pending"))
    return gap.missing_evidence(asked, state)


@query("""
WITH r AS (SELECT l_orderkey AS query_id, l_linenumber * 1000000 + l_partkey AS chunk_id, l_quantity AS score, l_suppkey % 4 AS k, 300 + l_partkey % 900 AS tokens, max(CASE WHEN l_suppkey % 4 <> 0 THEN l_quantity END) OVER (PARTITION BY l_orderkey) AS top FROM lineitem),
s AS (SELECT *, CASE WHEN k = 0 THEN 'docs' WHEN k = 1 THEN 'tests' WHEN score >= 0.7 * top THEN 'core' ELSE 'related' END AS section FROM r)
SELECT query_id, chunk_id, section, section <> 'related' OR sum(tokens) OVER (PARTITION BY query_id, section ORDER BY score DESC, chunk_id ROWS UNBOUNDED PRECEDING) <= 1000 AS with_body FROM s
""")
def rendered_groups(spark, d):
    s = F.col("l_suppkey")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("chunk_id"), F.col("l_quantity").alias("score"), F.when(s % 4 == 0, "spec").when(s % 4 == 1, "test").otherwise("code").alias("kind"), (300 + F.col("l_partkey") % 900).alias("tokens"))
    return packing.render_groups(rows, 1000).select("query_id", "chunk_id", "section", "with_body")


# ------------------------------------------------------------------ the graph of a project made of parts, for batches of queries


PROJECT = """p AS MATERIALIZED (SELECT p_partkey AS k, 'm' || p_partkey % 30 || '.C' || p_partkey % 3 || '.' || CASE WHEN p_partkey % 3 = 0 THEN '_f' ELSE 'f' END || p_partkey AS fqn, 'd/' || p_partkey % 50 || '.py' AS path, CAST(p_partkey % 40 * 5 + 1 AS INT) AS s,
    CASE WHEN p_partkey % 11 <> 0 THEN 'k' || p_partkey END AS chunk_id, p_partkey % 4 = 0 AS exported FROM part),
c AS MATERIALIZED (SELECT chunk_id, path, s, s + 9 AS e FROM p WHERE chunk_id IS NOT NULL UNION ALL SELECT DISTINCT 'w' || path, path, 1, 400 FROM p UNION ALL SELECT 'i' || i, 'd/' || i || '/__init__.py', 1, 3 FROM range(10) t(i)),
e AS MATERIALIZED (SELECT DISTINCT a.fqn AS source, b.fqn AS target, 'calls' AS kind, CAST(l_linenumber AS INT) AS line, CASE WHEN l_suppkey % 2 = 0 THEN 'parsed' ELSE 'synthesized' END AS provenance FROM lineitem JOIN p a ON a.k = l_partkey JOIN p b ON b.k = l_suppkey
  UNION ALL SELECT path, fqn, 'registers', 5, 'synthesized' FROM p WHERE k % 5 = 0 UNION ALL SELECT 'd/' || k % 10 || '/__init__.py', 'x.' || split_part(fqn, '.', 3), 'imports', NULL, 'parsed' FROM p WHERE k % 6 = 0),
r AS MATERIALIZED (SELECT DISTINCT 'k' || l_suppkey * 7 AS spec, 'k' || l_partkey AS symbol, 'parsed' AS provenance, l_orderkey % 9 = 0 AS stale FROM lineitem WHERE l_linenumber = 1),
pool AS MATERIALIZED (SELECT l_orderkey % 200 AS query_id, 'k' || k AS chunk_id, path, CASE WHEN k % 7 = 0 THEN 'spec' ELSE 'code' END AS kind, fqn, max(l_extendedprice) AS score FROM lineitem JOIN p ON k = l_partkey WHERE chunk_id IS NOT NULL AND l_linenumber <= 2 GROUP BY ALL),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM pool)"""


def project(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Tables of an index: symbols, chunks, edges, references and the pools of two hundred queries."""
    key = F.col("p_partkey")
    name = F.concat(F.lit("m"), key % 30, F.lit(".C"), key % 3, F.lit("."), F.when(key % 3 == 0, "_f").otherwise("f"), key)
    symbols = table(spark, d, "part").select(key.alias("k"), name.alias("fqn"), F.concat(F.lit("d/"), key % 50, F.lit(".py")).alias("file_path"), (key % 40 * 5 + 1).cast("int").alias("start_line"), F.when(key % 11 != 0, F.concat(F.lit("k"), key)).alias("chunk_id"), (key % 4 == 0).alias("is_exported"))
    lines = lambda a, b: (F.lit(a).alias("start_line"), F.lit(b).alias("end_line"))
    chunks = symbols.where("chunk_id is not null").select("chunk_id", "file_path", "start_line", (F.col("start_line") + 9).alias("end_line"))
    chunks = chunks.unionByName(symbols.select(F.concat(F.lit("w"), "file_path").alias("chunk_id"), "file_path", *lines(1, 400)).distinct())
    chunks = chunks.unionByName(spark.range(10).select(F.concat(F.lit("i"), "id").alias("chunk_id"), F.concat(F.lit("d/"), "id", F.lit("/__init__.py")).alias("file_path"), *lines(1, 3)))
    line = table(spark, d, "lineitem")
    named = lambda c: symbols.select(F.col("k").alias(c), F.col("fqn").alias(f"{c}_fqn"))
    calls = line.join(named("l_partkey"), "l_partkey").join(named("l_suppkey"), "l_suppkey").select(F.col("l_partkey_fqn").alias("source"), F.col("l_suppkey_fqn").alias("target"), F.lit("calls").alias("kind"), F.col("l_linenumber").alias("line"), F.when(F.col("l_suppkey") % 2 == 0, "parsed").otherwise("synthesized").alias("provenance"))
    made = symbols.where("k % 5 = 0").select(F.col("file_path").alias("source"), F.col("fqn").alias("target"), F.lit("registers").alias("kind"), F.lit(5).alias("line"), F.lit("synthesized").alias("provenance"))
    imports = symbols.where("k % 6 = 0").select(F.concat(F.lit("d/"), F.col("k") % 10, F.lit("/__init__.py")).alias("source"), F.concat(F.lit("x."), F.split("fqn", r"\.")[2]).alias("target"), F.lit("imports").alias("kind"), F.lit(None).cast("int").alias("line"), F.lit("parsed").alias("provenance"))
    references = line.where("l_linenumber = 1").select(F.concat(F.lit("k"), F.col("l_suppkey") * 7).alias("spec"), F.concat(F.lit("k"), "l_partkey").alias("symbol"), F.lit("parsed").alias("provenance"), (F.col("l_orderkey") % 9 == 0).alias("stale")).distinct()
    pool = line.where("l_linenumber <= 2").join(symbols.where("chunk_id is not null"), F.col("l_partkey") == F.col("k")).groupBy((F.col("l_orderkey") % 200).alias("query_id"), "chunk_id", F.col("file_path").alias("path"), F.when(F.col("k") % 7 == 0, "spec").otherwise("code").alias("kind"), F.col("fqn").alias("symbol_fqn")).agg(F.max("l_extendedprice").alias("score"))
    return {"symbols": symbols, "chunks": chunks, "edges": calls.distinct().unionByName(made).unionByName(imports), "references": references, "pool": pool}


@query(f"""
WITH {PROJECT}, top AS (SELECT query_id, place AS seed, chunk_id AS parent, path, kind, fqn FROM ranked WHERE place <= 20), code AS (SELECT * FROM top WHERE kind <> 'spec'),
spot AS (SELECT DISTINCT path, line FROM (SELECT path, s AS line FROM p WHERE chunk_id IS NULL UNION ALL SELECT source, line FROM e WHERE kind = 'registers' UNION ALL SELECT source, 1 FROM e WHERE kind = 'imports')),
cover AS MATERIALIZED (SELECT spot.path, line, chunk_id FROM spot JOIN c ON c.path = spot.path AND line BETWEEN s AND c.e QUALIFY row_number() OVER (PARTITION BY spot.path, line ORDER BY c.e - s, s, chunk_id) = 1),
home AS MATERIALIZED (SELECT fqn, chunk_id FROM p WHERE chunk_id IS NOT NULL UNION ALL SELECT fqn, cover.chunk_id FROM p JOIN cover ON cover.path = p.path AND line = s WHERE p.chunk_id IS NULL),
k AS (SELECT *, CASE WHEN p.chunk_id IS NULL THEN 2 WHEN starts_with(split_part(target, '.', 3), '_') THEN 0 ELSE 1 END AS level, q.exported AS source_exported FROM e JOIN p ON p.fqn = target JOIN p q ON q.fqn = source WHERE kind = 'calls'),
outs AS MATERIALIZED (SELECT source, target, provenance, row_number() OVER (PARTITION BY source ORDER BY level, line, target, provenance) AS place FROM k),
ins AS MATERIALIZED (SELECT source, target, provenance, row_number() OVER (PARTITION BY target ORDER BY source_exported AND source NOT IN (SELECT target FROM e WHERE kind = 'calls') DESC, source_exported DESC, source, line, provenance) AS place, count(*) OVER (PARTITION BY target) AS n FROM k),
f AS (
  SELECT query_id, seed, parent, 2 AS channel, outs.place, provenance, home.chunk_id FROM code JOIN outs ON source = fqn JOIN home ON home.fqn = target
  UNION ALL SELECT query_id, seed, parent, 3, ins.place, provenance, home.chunk_id FROM code JOIN ins ON target = code.fqn JOIN home ON home.fqn = source WHERE n <= 200 OR ins.place <= 20
  UNION ALL SELECT query_id, seed, parent, 0, e.line, provenance, cover.chunk_id FROM code JOIN e ON kind_of(e.kind) AND target = fqn AND source = code.path JOIN cover ON cover.path = source AND cover.line = e.line
  UNION ALL SELECT query_id, seed, parent, 1, x.place, 're-export', cover.chunk_id FROM code JOIN (SELECT tail, source, row_number() OVER (PARTITION BY tail ORDER BY source) AS place FROM (SELECT DISTINCT split_part(target, '.', 2) AS tail, source FROM e WHERE kind = 'imports')) x ON tail = split_part(fqn, '.', 3) JOIN cover ON cover.path = source AND cover.line = 1
  UNION ALL SELECT query_id, seed, parent, 4, l.place, provenance, spec FROM code JOIN (SELECT spec, symbol, provenance, row_number() OVER (PARTITION BY symbol ORDER BY spec) AS place FROM r WHERE NOT stale) l ON symbol = parent WHERE spec IN (SELECT chunk_id FROM c)
  UNION ALL SELECT query_id, seed, parent, 4, l.place, provenance, symbol FROM top JOIN (SELECT spec, symbol, provenance, row_number() OVER (PARTITION BY spec ORDER BY symbol) AS place FROM r WHERE NOT stale) l ON spec = parent WHERE kind = 'spec' AND symbol IN (SELECT chunk_id FROM c)
), g AS (SELECT * FROM f WHERE (query_id, chunk_id) NOT IN (SELECT query_id, chunk_id FROM pool) QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY seed, channel, place) = 1)
SELECT query_id, chunk_id, parent, provenance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY seed, channel, place, chunk_id) AS INT) AS position FROM g QUALIFY position <= 30
""".replace("kind_of(e.kind)", "e.kind = 'registers'"))
def expanded_pools(spark, d):
    p = project(spark, d)
    return graph.expand_pool(p["pool"], p["symbols"], p["chunks"], p["edges"], p["references"])


@query(f"""
WITH {PROJECT}, packed AS MATERIALIZED (SELECT query_id, place, chunk_id, CASE WHEN kind = 'code' THEN fqn END AS fqn FROM ranked WHERE place <= 8), rest AS MATERIALIZED (SELECT *, CASE WHEN place % 9 = 0 THEN 'x' || place % 2 END AS export_of FROM ranked WHERE place > 8),
named AS (SELECT query_id, i AS position, 'm' || (query_id * 7 + i * 11) % 30 || CASE WHEN i % 2 = 0 THEN '' ELSE '.C' || query_id % 3 END AS name FROM (SELECT DISTINCT query_id FROM pool), range(30) t(i)),
held AS (SELECT DISTINCT query_id, name FROM named JOIN packed USING (query_id) WHERE fqn = name OR starts_with(fqn, name || '.')),
anchors AS MATERIALIZED (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY min(position), name) AS anchor FROM named SEMI JOIN held USING (query_id, name) GROUP BY query_id, name QUALIFY anchor <= 2),
g AS (
  SELECT query_id, dense_rank() OVER (PARTITION BY query_id ORDER BY first, export_of) - 1 AS group_no, chunk_id, place AS order_key FROM (SELECT *, min(place) OVER (PARTITION BY query_id, export_of) AS first FROM rest WHERE export_of IS NOT NULL)
  UNION ALL SELECT * FROM (SELECT a.query_id, 1000 + anchor, rest.chunk_id, rest.place FROM anchors a JOIN p ON starts_with(fqn, name || '.') JOIN rest ON rest.query_id = a.query_id AND rest.chunk_id = p.chunk_id WHERE (a.query_id, p.fqn) NOT IN (SELECT query_id, fqn FROM packed WHERE fqn IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY a.query_id, anchor ORDER BY rest.place) <= 24)
  UNION ALL SELECT query_id, 2000 + anchor, chunk_id, n FROM (SELECT query_id, anchor, chunk_id, row_number() OVER (PARTITION BY query_id, anchor ORDER BY lead, chunk_id) AS n FROM (
    SELECT a.query_id, anchor, h.chunk_id, min((b.fqn, line, target)) AS lead FROM anchors a JOIN packed b ON b.query_id = a.query_id AND starts_with(b.fqn, name || '.') JOIN e ON source = b.fqn AND kind = 'calls' JOIN p h ON h.fqn = target AND h.chunk_id IS NOT NULL SEMI JOIN rest ON rest.query_id = a.query_id AND rest.chunk_id = h.chunk_id GROUP BY ALL)) WHERE n <= 6
  UNION ALL SELECT query_id, 3000 + anchor, chunk_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, anchor ORDER BY place) AS n FROM (
    SELECT b.query_id, b.place AS at_place, rest.chunk_id, rest.place, dense_rank() OVER (PARTITION BY b.query_id ORDER BY b.place) AS anchor FROM packed b JOIN (SELECT DISTINCT spec, symbol FROM r) ON spec = b.chunk_id JOIN rest ON rest.query_id = b.query_id AND rest.chunk_id = symbol WHERE b.fqn IS NULL) WHERE anchor <= 2) WHERE n <= 6
), o AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY group_no, order_key) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, group_no ORDER BY order_key, chunk_id) AS place FROM o)
SELECT query_id, group_no, place, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY place, group_no, chunk_id) AS position FROM n QUALIFY position <= 24
""")
def gap_closures(spark, d):
    p = project(spark, d)
    place = F.row_number().over(gap.Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    ranked = p["pool"].withColumn("position", place)
    packed = ranked.where("position <= 8").select("query_id", "position", "chunk_id", F.when(F.col("kind") == "code", F.col("symbol_fqn")).alias("symbol_fqn"))
    pool = ranked.select("query_id", "position", "chunk_id", F.when((F.col("position") % 9 == 0) & (F.col("position") > 8), F.concat(F.lit("x"), F.col("position") % 2)).alias("export_of"))
    i = F.col("position")
    token = F.concat(F.lit("m"), (F.col("query_id") * 7 + i * 11) % 30, F.when(i % 2 == 0, "").otherwise(F.concat(F.lit(".C"), F.col("query_id") % 3)))
    named = p["pool"].select("query_id").distinct().crossJoin(spark.range(30).select(F.col("id").alias("position"))).select("query_id", "position", token.alias("token"))
    groups = gap.closures(named, packed, pool, p["symbols"], p["edges"], p["references"])
    return gap.plan(groups, 24, gap.GAPS_MOST)


@query(f"""
WITH {PROJECT}, m AS (SELECT *, k % 13 = 0 AS marked, k % 17 = 0 AS old, k % 50 % 9 = 0 AS made FROM p WHERE chunk_id IS NOT NULL)
SELECT query_id, ranked.chunk_id, exported, old AS stale, made AS generated, marked AS deprecated, place > 1 AND ranked.path = first(ranked.path) OVER (PARTITION BY query_id ORDER BY place) AS near_top FROM ranked JOIN m ON m.chunk_id = ranked.chunk_id
""")
def pool_signals(spark, d):
    p = project(spark, d)
    place = F.row_number().over(gap.Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    k, own = F.col("k"), p["symbols"].where("chunk_id IS NOT NULL")
    chunks = own.select("chunk_id", "file_path", F.col("fqn").alias("symbol_fqn"), F.when(k % 13 == 0, "it is DEPRECATED").otherwise("it is not").alias("content"))
    files = own.select(F.col("file_path").alias("path"), (k % 50 % 9 == 0).alias("generated")).distinct()
    rows = channels.signals(p["pool"].withColumn("position", place), chunks, p["symbols"], own.where(k % 17 == 0).select("chunk_id"), files)
    return rows.select("query_id", "chunk_id", "exported", "stale", "generated", "deprecated", "near_top")


#: Text, and the lines that are shown of it when long comments are folded.
FOLDED = [
    ("x\n" + "# c\n" * 12 + "y", "1-3 13-14"),
    ('"""a\n' + "b\n" * 9 + '"""\nz', "1-2 11-12"),
    ("/* a\n" + "b\n" * 3 + "*/\nz", "1-6"),
    ("one\ntwo", "1-2"),
]


@query("SELECT p_partkey, shown FROM part JOIN (VALUES " + ", ".join(f"({n}, '{c[1]}')" for n, c in enumerate(FOLDED)) + f") AS c(n, shown) ON p_partkey % {len(FOLDED)} = n")
def folded_comments(spark, d):
    cases = F.array(*(F.lit(c[0]) for c in FOLDED))
    rows = table(spark, d, "part").select("p_partkey", F.get(cases, (F.col("p_partkey") % len(FOLDED)).cast("int")).alias("v"))
    parts = F.transform(rendering.folded(F.col("v"), F.lit(1)), lambda s: F.concat_ws("-", s["start"], s["end"]))
    return rows.select("p_partkey", F.array_join(parts, " ").alias("shown"))


#: Length of a chunk, query, lines of calls, and the ranges shown of twelve lines at most.
FOCUSED = [
    (10, "anything", (), "1-10"),
    (60, "nothing named", (), "1-12"),
    (60, "see p.py:30", (), "1-4 27-33"),
    (60, "word40 and p.py:30", (), "1-4 27-33 40-40"),
    (60, "", (20, 50), "1-4 17-23 50-50"),
    (60, "word2 only", (), "1-4 17-24"),
]


@query("SELECT p_partkey, shown FROM part JOIN (VALUES " + ", ".join(f"({n}, '{c[3]}')" for n, c in enumerate(FOCUSED)) + f") AS c(n, shown) ON p_partkey % {len(FOCUSED)} = n")
def focused_lines(spark, d):
    case = F.get(F.array(*(F.struct(F.lit(a).alias("n"), F.lit(q).alias("q"), F.array(*map(F.lit, c)).cast("array<int>").alias("calls")) for a, q, c, _ in FOCUSED)), (F.col("p_partkey") % len(FOCUSED)).cast("int"))
    # a row takes long and the table is small: keys are dealt to all tasks, however few row groups its file has
    part = table(spark, d, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    rows = part.select("p_partkey", case.alias("c")).select("p_partkey", "c.*")
    content = F.array_join(F.transform(F.sequence(F.lit(1), "n"), lambda n: F.concat(F.lit("line word"), F.when(n.isin(20, 26, 29, 35), "2").otherwise(n.cast("string")), F.lit("."))), "\n")
    rows = rows.withColumn("content", content)
    shown = rendering.focused(F.col("content"), F.lit(1), F.col("q"), F.lit("p.py"), F.col("calls"), 12)
    return rows.select("p_partkey", F.array_join(F.transform(shown, lambda s: F.concat_ws("-", s["start"], s["end"])), " ").alias("shown"))


ANSWERS = [
    ('{"claims":[{"text":"Set here [E1].","references":["E1"]}]}', "E1", 0, 1.0, None),
    ('```json\n{"claims":[{"text":"Guess","references":["E9"]}]}\n```', "", 1, 0.0, None),
    ("Plain prose [E1]", "", 0, 0.0, None),
    ("{broken", "", 0, 0.0, "a structured answer without readable claims"),
    ('{"claims":[{"text":"Cut. [E1","F1"],"kind":"fact"}]}', "E1 F1", 0, 1.0, None),
]


@query("SELECT CAST(o_orderkey AS BIGINT) AS query_id, cited, invalid, coverage, error FROM orders JOIN (VALUES " + ", ".join(f"({n}, '{c[1]}', {c[2]}, CAST({c[3]} AS DOUBLE), {'NULL' if c[4] is None else repr(c[4])})" for n, c in enumerate(ANSWERS)) + f") AS c(n, cited, invalid, coverage, error) ON o_orderkey % {len(ANSWERS)} = n")
def grounded_answers(spark, d):
    raw = F.get(F.array(*(F.lit(c[0]) for c in ANSWERS)), (F.col("o_orderkey") % len(ANSWERS)).cast("int"))
    items = F.create_map(F.lit("E1"), F.struct(F.lit("a.py:1-1").alias("place"), F.lit("code").alias("type"), F.lit("1 | x").alias("content")))
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), raw.alias("raw"), items.alias("items"), F.create_map(F.lit("F1"), F.lit("f -> g")).alias("flows"))
    return rendering.grounded(asked).select("query_id", F.array_join("cited", " ").alias("cited"), "invalid", "coverage", "error")
