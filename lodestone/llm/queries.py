"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import centroids, embed_dedup, exact_dedup, lang_id, license_scan, minhash, mixing, packing, quality, secret_scan, spelling, token_counts, topk


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lang_id.identify(docs, lang_id.train(docs))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.linked_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, threshold=0.85)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantised(_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, k=5)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(_table(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet").withColumnRenamed("digest", "text_sha256").drop("keep_path", "keep_row")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"), misspell=31)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (op1_token_counts, op2_language_id, op3_embedding_near_dedup, op4_minhash_near_dedup, op5_packing, op6_secret_scan, op7_quality, op8_license_scan, op9_exact_topk, op10_mixing, op11_centroid_clustering, op12_exact_dedup, op13_spelling_variants, pipeline)
    return {f.__name__: f for f in each}


OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.w) = len(c.w)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

#: The links are few pairs of equal labels here; SQL compares every pair of a label, and follows links by recursion.
OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), u AS (
  SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, min(r.b) AS component_id, v.vec_id = min(r.b) AS kept
FROM v JOIN reach r ON r.a = v.vec_id GROUP BY v.vec_id
"""

#: Equal sets are one row first; then sets that share a shingle and fit in length are held against each other in full.
OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), n AS (
  SELECT doc_id, len(s) AS n FROM s
), c AS (
  SELECT min(doc_id) AS head, list(doc_id) AS members, s FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s
), t AS (
  SELECT head, len(s) AS n, unnest(s) AS shingle FROM c
), p AS (
  SELECT a.head AS a, b.head AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM t a JOIN t b ON a.shingle = b.shingle AND a.head < b.head AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.head, b.head
), l AS (
  SELECT a, b FROM p WHERE 100 * shared >= 85 * (na + nb - shared) UNION ALL SELECT b, a FROM p WHERE 100 * shared >= 85 * (na + nb - shared)
), reach(a, b) AS (
  SELECT head, head FROM c UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
), m AS (
  SELECT unnest(members) AS doc_id, least FROM c JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) ON a = head
)
SELECT n.doc_id, n.n AS n_shingles, coalesce(least, n.doc_id) AS component_id, coalesce(least, n.doc_id) = n.doc_id AS kept FROM n LEFT JOIN m ON m.doc_id = n.doc_id
"""

#: At every size: rows of a source are ordered by size and doc_id, however many buckets the query deals them to.
OP10 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS most FROM s
), b AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(sum(most) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, level > most / weight AS capped, max(CASE WHEN level > most / weight THEN NULL ELSE level END) OVER () AS final FROM b
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN most ELSE least(final * weight, most) END AS target, CAST('0x' || substr(md5('mix' || coalesce(source, '')), 1, 7) AS BIGINT) / CAST(268435456 AS DOUBLE) AS first FROM f
), r AS (
  SELECT doc_id, size, source_size, target, first, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(n * rate + first) - floor((n - 1) * rate + first)) AS BIGINT) AS taken FROM r
"""


def _rounds(n: int) -> str:
    """Assigning and averaging, n times, as SQL: a0 assigns to the starts c0, c1 are the means of a0, and so on."""
    out = []
    for i in range(n):
        out.append(f"""
), a{i} AS (
  SELECT rid, arg_min(number, (distance, number)) AS number FROM (
    SELECT v.rid, c.number, list_sum(list_transform(list_zip(v.w, c.w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM v, c{i} c) GROUP BY rid
), m{i} AS (
  SELECT number, place, sum(x) AS s, count(*) AS n FROM (SELECT a.number, unnest(v.w) AS x, unnest(range(1, 65)) AS place FROM v JOIN a{i} a USING (rid)) GROUP BY number, place
), c{i + 1} AS (
  SELECT c.number, coalesce(m.w, c.w) AS w FROM c{i} c
  LEFT JOIN (SELECT number, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS w FROM m{i} GROUP BY number) m ON m.number = c.number""")
    return "".join(out)


OP11 = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY name, w) - 1 AS number, w FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS name, w FROM v) ORDER BY name, w LIMIT 16{_rounds(3)}
), d AS (
  SELECT rid, vec_id, unnest(nearest) FROM (
    SELECT v.rid, any_value(v.vec_id) AS vec_id, arg_min({{'cluster': c.number, 'distance': list_sum(list_transform(list_zip(v.w, c.w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))}},
      (list_sum(list_transform(list_zip(v.w, c.w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.number)) AS nearest FROM v, c3 c GROUP BY v.rid)
)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.w, ',')) AS centroid_sha256
FROM d JOIN c3 ON c3.number = d.cluster
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)
"""

#: The crc32 is worked out by its table, byte by byte. Near words meet where one code point is struck out of one or of both.
OP13 = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents
  ) WHERE length(run) >= 7 GROUP BY doc_id, run
), bytes AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] END)) AS b FROM runs
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM bytes, crc
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), struck AS (
  SELECT word, n, place, left(word, place - 1) || substr(word, place + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM words)
), links AS (
  SELECT a.word AS a, b.word AS b FROM struck a JOIN struck b ON a.less = b.less AND a.place = b.place AND a.word <> b.word
  UNION SELECT s.word, w.word FROM struck s JOIN words w ON w.word = s.less
  UNION SELECT w.word, s.word FROM struck s JOIN words w ON w.word = s.less
), best AS (
  SELECT l.a AS word, count(*) AS n_near, arg_min({'form': w.word, 'n': w.n}, (-w.n, w.word)) AS best FROM links l JOIN words w ON w.word = l.b GROUP BY l.a
), told AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * n THEN best.form END AS form, CASE WHEN best.n >= 10 * n THEN best.n END AS form_n FROM words LEFT JOIN best USING (word)
), chain(word, root, step) AS (
  SELECT word, word, 0 FROM told UNION ALL SELECT c.word, t.form, c.step + 1 FROM chain c JOIN told t ON t.word = c.root AND t.form IS NOT NULL
)
SELECT t.word, t.form, r.root, t.n, t.n_near, t.form_n FROM told t JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) r ON r.word = t.word
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_near_dedup": OP3, "op4_minhash_near_dedup": OP4, "op9_exact_topk": OP9, "op10_mixing": OP10, "op11_centroid_clustering": OP11, "op12_exact_dedup": OP12, "op13_spelling_variants": OP13}
