"""Fixpoints over edges: class hierarchies with their overrides, and what function pointers may point to.

Iteration is semi-naive: a round joins only the facts that the round before found, and each round's new facts are a table in the
caller's folder, which cuts lineage. A fact is never found twice, so cycles end by themselves.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A node with more edges than this is a hub; its edges are dealt to parts, each of which meets the node's facts for itself.
HUB = 10_000


def _dealt(edges: DataFrame, hub: int) -> DataFrame:
    """``edges`` (node, next) with the part that each lies in and how many parts its node has."""
    size = edges.groupBy("node").agg(F.ceil(F.count("*") / hub).cast("int").alias("parts"))
    return edges.join(size, "node").select("node", "next", "parts", F.pmod(F.xxhash64("next"), F.col("parts")).cast("int").alias("part"))


def reach(seed: DataFrame, edges: DataFrame, folder: str, hub: int = HUB, rounds: int = 1000) -> DataFrame:
    """(node, item, distance): every item that ``seed`` (node, item) puts on a node, carried along ``edges`` (node, next).

    distance is 1 on a seed's own node and one more for each edge of the shortest way. Nulls take no part, rows that repeat count
    once, cycles are allowed. The tables of the rounds stay in ``folder``, as the result reads them.
    """
    spark, top = seed.sparkSession, f"{folder}/reach-{uuid.uuid4().hex}"
    out = _dealt(edges.select("node", "next").where("node IS NOT NULL AND next IS NOT NULL AND node <> next").distinct(), hub)
    out.write.parquet(f"{top}/edges")
    out = spark.read.parquet(f"{top}/edges")
    parts = out.where("parts > 1").select("node", "parts").distinct()
    new = seed.select("node", "item").where("node IS NOT NULL AND item IS NOT NULL").distinct().withColumn("distance", F.lit(1))
    tables: list[str] = []
    schema = new.schema
    for number in range(1, rounds + 1):
        path = f"{top}/round-{number:04d}"
        new.write.parquet(path)
        now = spark.read.schema(schema).parquet(path)
        if now.isEmpty():
            break
        tables.append(path)
        each = now.join(parts, "node", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        step = each.join(out.select("node", "next", "part"), ["node", "part"]).select(F.col("next").alias("node"), "item").distinct()
        known = spark.read.schema(schema).parquet(*tables)
        new = step.join(known.select("node", "item"), ["node", "item"], "left_anti").withColumn("distance", F.lit(number + 1))
    else:
        raise RuntimeError(f"facts were still found after {rounds} rounds")
    return spark.read.schema(schema).parquet(*tables) if tables else seed.select("node", "item").limit(0).withColumn("distance", F.lit(1))


def ancestors(extends: DataFrame, folder: str) -> DataFrame:
    """(class, ancestor, distance) over ``extends`` (class, base). A class in a cycle may be its own ancestor."""
    up = extends.select(F.col("class").cast("string").alias("class"), F.col("base").cast("string").alias("base"))
    # a base passes what it extends on to the classes that extend it
    found = reach(up.select(F.col("class").alias("node"), F.col("base").alias("item")), up.select(F.col("base").alias("node"), F.col("class").alias("next")), folder)
    return found.select(F.col("node").alias("class"), F.col("item").alias("ancestor"), "distance")


def overrides(methods: DataFrame, extends: DataFrame, folder: str, rounds: int = 1000) -> DataFrame:
    """(method, overridden, distance, provenance): methods against those of the same name and arity in the classes above.

    ``methods`` has method, class, name, arity; of several ways up the shortest counts. Only the nearest classes that have such a
    method are told: what lies above them is theirs to override. A method never overrides itself or one of its own class.

    A class climbs a level a round. After levels 1, 2, 4, 8 and so on the methods that are still open meet the methods of the levels
    since then; a method that was met is done, and a class climbs on only while it has open ones. So a method joins the classes up to
    about twice the distance of the nearest, not all above it.
    """
    spark, top = methods.sparkSession, f"{folder}/overrides-{uuid.uuid4().hex}"

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{top}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{top}/{name}")

    up = kept(extends.select(F.col("class").cast("string").alias("class"), F.col("base").cast("string").alias("base")).where("class IS NOT NULL AND base IS NOT NULL AND class <> base").distinct(), "extends")
    own = kept(methods.select("method", F.col("class").cast("string").alias("class"), "name", "arity").distinct(), "methods")
    above = own.select(F.col("method").alias("overridden"), F.col("class").alias("ancestor"), "name", "arity")
    step = up.select(F.col("class").alias("ancestor"), F.col("base").alias("next"))
    open_, found, levels, since = own, [], [], []
    level = up.select("class", F.col("base").alias("ancestor")).join(own.select("class"), "class", "left_semi").withColumn("distance", F.lit(1))
    for number in range(1, rounds + 1):
        level = kept(level, f"level-{number:04d}")
        last = level.isEmpty()
        if not last:
            levels.append(level)
            since.append(level)
        if since and (last or number & (number - 1) == 0):
            met = open_.join(functools.reduce(DataFrame.unionByName, since), "class").join(above, ["ancestor", "name", "arity"]).select("method", "overridden", "distance")
            met = kept(met.withColumn("least", F.min("distance").over(Window.partitionBy("method"))).where("distance = least").drop("least").distinct(), f"met-{number:04d}")
            found.append(met)
            since = []
            if not last:
                open_ = kept(open_.join(met.select("method"), "method", "left_anti"), f"open-{number:04d}")
                level = level.join(open_.select("class"), "class", "left_semi")
        if last:
            break
        # a level's classes climb on to what they have not reached yet, and not back to themselves
        level = level.join(step, "ancestor").select("class", F.col("next").alias("ancestor")).where("class <> ancestor").distinct()
        known = functools.reduce(DataFrame.unionByName, levels).select("class", "ancestor")
        level = level.join(known, ["class", "ancestor"], "left_anti").withColumn("distance", F.lit(number + 1))
    else:
        raise RuntimeError(f"classes still climb after {rounds} rounds")
    none = own.select("method", F.col("method").alias("overridden"), F.lit(1).alias("distance")).limit(0)
    every = functools.reduce(DataFrame.unionByName, found) if found else none
    return every.select("method", "overridden", "distance", F.lit("synthesized").alias("provenance"))


def pointer_targets(assignments: DataFrame, functions: DataFrame, folder: str, hub: int = HUB, wanted: DataFrame | None = None) -> DataFrame:
    """(path, variable, function): what each variable of a file may point to, or, with ``wanted`` (path, name), each of these.

    ``assignments`` (path, variable, value) assigns a function or another variable; ``functions`` (path, name) are the functions
    that a file can see. A value that is both names the function. Aliases are followed to the end, in any order of statements.
    Facts are found for the variables alone that a wanted one may get them from, which a walk against the aliases tells first.
    """
    key = lambda name: F.concat_ws("\0", "path", name)
    rows = assignments.select("path", "variable", "value")
    if wanted is not None:
        rows = rows.join(wanted.select("path").distinct(), "path", "left_semi")
    rows = rows.distinct()
    known = functions.select("path", F.col("name").alias("value")).distinct()
    direct = rows.join(known, ["path", "value"], "left_semi").select(key("variable").alias("node"), F.col("value").alias("item"))
    alias = rows.join(known, ["path", "value"], "left_anti").select(key("value").alias("node"), key("variable").alias("next"))
    if wanted is not None:
        back = alias.select(F.col("next").alias("node"), F.col("node").alias("next"))
        needed = reach(wanted.select(key("name").alias("node"), F.lit(1).alias("item")), back, folder, hub).select("node")
        direct, alias = direct.join(needed, "node", "left_semi"), alias.join(needed.select(F.col("node").alias("next")), "next", "left_semi")
    found = reach(direct, alias, folder, hub)
    if wanted is not None:
        found = found.join(wanted.select(key("name").alias("node")).distinct(), "node", "left_semi")
    cut = F.split("node", "\0")
    return found.select(F.element_at(cut, 1).alias("path"), F.element_at(cut, 2).alias("variable"), F.col("item").alias("function"))


def pointer_calls(calls: DataFrame, assignments: DataFrame, functions: DataFrame, folder: str, hub: int = HUB) -> DataFrame:
    """(path, owner, line, target, provenance) of ``calls`` (path, owner, line, name).

    A call of a variable goes to every function that it may point to, as synthesized edges; one of a variable that points to
    nothing known is unresolved, with its name as target; any other call is parsed as it stands.
    """
    wanted = calls.select("path", "name").distinct()
    targets = pointer_targets(assignments, functions, folder, hub, wanted).withColumnRenamed("variable", "name")
    pointers = assignments.select("path", F.col("variable").alias("name")).join(wanted, ["path", "name"], "left_semi").distinct().withColumn("pointer", F.lit(True))
    seen = calls.select("path", "owner", "line", "name").join(pointers, ["path", "name"], "left").join(targets, ["path", "name"], "left")
    kind = F.when(F.col("function").isNotNull(), "synthesized").when(F.col("pointer"), "unresolved").otherwise("parsed")
    return seen.select("path", "owner", "line", F.coalesce("function", "name").alias("target"), kind.alias("provenance"))
