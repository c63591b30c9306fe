"""Near-duplicate documents by MinHash: universal hash minima, banding, signature and set verification, components.

Documents with the same set of shingles form a class, and only one of a class goes on. Each band of minima puts classes into
buckets; a bucket is not expanded into pairs. First every bucket's best connected class is its centre and is held against the
others (one row per bucket and class); pairs whose signatures agree enough are confirmed. Components of what that confirms settle most buckets. What can still be missing are
links between classes that share a bucket and lie in different components. Those classes go through an exact prefix join of
their own, as a group of copies that differ too much from each other would else be held against itself pair by pair; pairs
that it leaves and whose signatures agree enough are tested. Every link is confirmed on full sets of shingles.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.llm.shared import Scratch, shingle_set, texts_of, word_hashes

ROWS = 5
#: The share of pairs at the threshold itself that banding may miss; above the threshold it is less.
MISS = 1e-5
#: Members that are held against one centre in one task, and classes with one shingle that meet the others in one task.
SALT, HEAVY = 100, 1000


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def agreement_for(threshold: float, n: int) -> int:
    """Equal minima of n that a pair at the threshold falls short of once in 100,000 times."""
    return max(1, math.floor(n * threshold - 4.3 * math.sqrt(n * threshold * (1 - threshold))))


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_101)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def minima(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each function x -> (a x + b mod 2^64) / 2^32 the least value over the items."""
    least = np.full(len(a), 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(items), 2048):
            least = np.minimum(least, (a[:, None] * items[at : at + 2048] + b[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def _sketch(k: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _family(n)
        for batch in batches:
            counts, high, low, signatures = [], [], [], []
            for text in texts_of(batch.column(1)):
                items = shingle_set(word_hashes(text or b""), k)
                counts.append(len(items))
                digest = hashlib.blake2b(items.tobytes(), digest_size=16).digest()
                high.append(int.from_bytes(digest[:8], "little", signed=True))
                low.append(int.from_bytes(digest[8:], "little", signed=True))
                signatures.append(minima(items, a, b).view(np.int32))
            flat = np.concatenate(signatures) if signatures else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * n), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), lists], ["doc_id", "n_shingles", "high", "low", "signature"])

    return run


def sketches(docs: DataFrame, k: int, n: int) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_sketch(k, n), "doc_id long, n_shingles long, high long, low long, signature array<int>")


def _confirm(k: int, threshold: float):
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, items = None, None
        for batch in batches:
            centres, members, flags = (batch.column(i).to_pylist() for i in (0, 2, 3))
            found = []
            for c, m, is_member, text in zip(centres, members, flags, texts_of(batch.column(4)), strict=True):
                own = shingle_set(word_hashes(text or b""), k)
                if not is_member:
                    centre, items = c, own
                    continue
                if c != centre:
                    raise RuntimeError("a member came before its centre")
                shared = len(np.intersect1d(items, own, assume_unique=True))
                if 100 * shared >= percent * (len(items) + len(own) - shared):
                    found.append((c, m))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    return run


def _items(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                items = shingle_set(word_hashes(text or b""), k).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(items), rep)), pa.array(items)], ["rep", "item"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Of ``pairs`` (centre, member) those whose full sets reach the threshold. A centre with many members is dealt to many tasks."""
    sizes = pairs.groupBy("centre").agg(F.ceil(F.count("*") / SALT).cast("int").alias("parts"))
    members = pairs.join(sizes, "centre").select("centre", F.pmod(F.xxhash64("member"), "parts").cast("int").alias("part"), F.col("member").alias("doc_id"), F.lit(1).alias("is_member"))
    centres = sizes.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("centre").alias("doc_id"), F.lit(0).alias("is_member"))
    rows = members.unionByName(centres).join(texts, "doc_id").select("centre", "part", "doc_id", "is_member", "text")
    return rows.repartition("centre", "part").sortWithinPartitions("centre", "part", "is_member").mapInArrow(_confirm(k, threshold), "u long, v long")


def agreeing(pairs: DataFrame, classes: DataFrame, threshold: float, n: int) -> DataFrame:
    """Signature verification: of ``pairs`` (centre, member) those of whose n minima as many agree as a pair at the threshold needs.

    Only the last byte of each minimum is compared, a quarter of the shuffle: equal minima have equal bytes, so no more pairs are
    missed, and of unequal ones one in 256 passes for equal.
    """
    said = classes.select("rep", F.transform("signature", lambda x: (x.bitwiseAND(255) - 128).cast("byte")).alias("signature"))
    one, other = (said.select(F.col("rep").alias(c), F.col("signature").alias(f"{c}_minima")) for c in ("centre", "member"))
    equal = F.aggregate(F.zip_with("centre_minima", "member_minima", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    return pairs.join(one, "centre").join(other, "member").where(equal >= agreement_for(threshold, n)).select("centre", "member")


def _undecided(texts: DataFrame, rest: DataFrame, k: int, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs (centre, member) of ``rest`` (rep, component) in different components that may reach the threshold.

    A set-similarity join of the undecided classes alone: shingles in ascending order of how many of these classes have them,
    each class indexed by those it must share one of, and pairs kept whose overlap can still be large enough from the places
    of the shingle they share. The classes of a shingle that many have are dealt to parts, and each part meets all of them.
    Returns the pairs and the table of items they are read from.
    """
    percent = round(100 * threshold)
    chosen = texts.join(rest.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    items = scratch.table(chosen.mapInArrow(_items(k), "rep long, item long"), "items")
    own = Window.partitionBy("rep")
    often = items.groupBy("item").agg(F.count("*").alias("often"))
    placed = items.join(often, "item").withColumn("place", F.row_number().over(own.orderBy("often", "item")) - 1).withColumn("size", F.count("*").over(own))
    index = placed.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * percent / 100)).where("often > 1").join(rest, "rep").select("item", "rep", "component", "place", "size", F.ceil(F.col("often") / HEAVY).cast("int").alias("parts"))
    dealt = index.withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int")), index.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a, b = (side.select("item", "part", *(F.col(c).alias(f"{c}_{x}") for c in ("rep", "component", "place", "size"))) for x, side in zip("ab", dealt, strict=True))
    most = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    reach = (100 + percent) * most >= percent * (F.col("size_a") + F.col("size_b"))
    pairs = a.join(b, (a.item == b.item) & (a.part == b.part) & (F.col("rep_a") < F.col("rep_b")) & (F.col("component_a") != F.col("component_b")) & reach)
    return pairs.select(F.col("rep_a").alias("centre"), F.col("rep_b").alias("member")).distinct(), items


def near_duplicates(docs: DataFrame, shingle_words: int = 5, threshold: float = 0.8) -> DataFrame:
    """Groups of documents whose sets of shingles have a Jaccard similarity of at least ``threshold`` (to the hundredth).

    ``docs`` has doc_id (long) and text; other columns are not read. Words are runs of anything but space and x09-x0D, A-Z
    lower-cased. Fewer words than a shingle has make one shingle; a null text, or one without words, has an empty set and
    links with nothing. Rows that repeat a doc_id each return a row (if their texts differ, near copies are confirmed on the
    smallest text); a null doc_id returns its own row with a null component.

    Returns doc_id, n_shingles, component_id (smallest doc_id that links reach), kept (doc_id = component_id).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    n = ROWS * bands_for(threshold)
    sketch = scratch.table(sketches(docs, shingle_words, n), "sketch")

    classes = sketch.where("n_shingles > 0 and doc_id is not null").groupBy("high", "low").agg(F.min("doc_id").alias("rep"), F.min_by("signature", "doc_id").alias("signature"))
    classes = scratch.table(classes, "classes")
    keys = F.transform(F.sequence(F.lit(0), F.lit(n // ROWS - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * ROWS + 1, ROWS)))
    banded = classes.select("rep", F.explode(keys).alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = scratch.table(banded.join(shared, "key").select("key", "rep", "size"), "buckets")

    degree = buckets.groupBy("rep").agg(F.sum(F.col("size") - 1).alias("degree"))
    texts = docs.select("doc_id", "text").join(degree.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    texts = scratch.table(texts.groupBy("doc_id").agg(F.min("text").alias("text")), "texts")

    ranked = buckets.join(degree, "rep")
    centre = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("minus"))).alias("best")).select("key", (-F.col("best.minus")).alias("centre"))
    tested = buckets.join(centre, "key").where("rep <> centre").select("centre", F.col("rep").alias("member")).distinct()
    tested = scratch.table(tested, "tested")
    links = scratch.table(confirm(agreeing(tested, classes, threshold, n), texts, shingle_words, threshold), "links")
    first = scratch.table(connected_components(links, scratch), "first")

    placed = buckets.join(first.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    rest = placed.join(open_keys, "key", "left_semi").select("rep", "component").distinct()
    rest = scratch.table(rest, "rest")
    more, items = _undecided(texts, rest, shingle_words, threshold, scratch)
    done = tested.unionByName(tested.select(F.col("member").alias("centre"), F.col("centre").alias("member")))
    more = scratch.table(agreeing(more.join(done, ["centre", "member"], "left_anti"), classes, threshold, n), "more")
    late = scratch.table(confirm(more, texts, shingle_words, threshold), "late")
    for table in (texts, buckets, tested, rest, items, more):
        scratch.drop(table)

    stars = first.where("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v"))
    whole = connected_components(stars.unionByName(late), scratch)
    scratch.drop(links)
    scratch.drop(late)
    reps = classes.select("high", "low", "rep").join(whole.withColumnRenamed("id", "rep"), "rep", "left").select("high", "low", F.coalesce("component", "rep").alias("component"))
    out = sketch.select("doc_id", "n_shingles", "high", "low").join(reps, ["high", "low"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, shingle_words: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without near copies: of each group one row stays, that with the smallest doc_id (null last), all columns kept.

    Where ids repeat or are null, rows get keys of their own, so that each is judged by its own text; the rows are written to
    the shared folder first so that the keys last. Of rows of one group and id the one whose text has the smallest hash stays.
    """
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty() and docs.where("doc_id is null").isEmpty():
        gone = near_duplicates(docs, shingle_words, threshold).where("not kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti")
    keyed = Scratch(docs.sparkSession, "minhash").table(docs.select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("row")), "keyed")
    groups = near_duplicates(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), shingle_words, threshold).select(F.col("doc_id").alias("key"), "component_id")
    place = F.struct(F.col("row.doc_id").isNull().alias("absent"), F.col("row.doc_id").alias("doc_id"), F.sha2("row.text", 256).alias("hash"), "key")
    stay = keyed.select("key", place.alias("place")).join(groups, "key").groupBy("component_id").agg(F.min("place")["key"].alias("key"))
    return keyed.join(stay, "key", "left_semi").select("row.*")
