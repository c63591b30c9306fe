"""Queries of scopes, class hierarchies and function pointers, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import fixpoint, scopes
from lodestone.plans.registry import query, table, work_dir

# ------------------------------------------------------------------ scopes

#: A customer is a file, its orders are scopes in it, their lines scopes in these; names are declared, assigned anew and imported by keys.
SCOPES = """
o AS (SELECT 'f' || o_custkey AS path, o_orderkey AS k, 10000 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS s FROM orders),
l AS (SELECT DISTINCT path, k, l_linenumber AS n, s + 1000 * l_linenumber AS s, first_value(l_partkey) OVER w AS p, first_value(l_suppkey) OVER w AS q, first_value(l_quantity) OVER w AS quantity
      FROM lineitem JOIN o ON k = l_orderkey WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity)),
scope AS (SELECT DISTINCT path, 'r' AS scope, 0 AS a, 10000000 AS b FROM o UNION ALL SELECT path, 'o' || k, s, s + 9999 FROM o UNION ALL SELECT path, 'l' || k || '.' || n, s, s + 999 FROM l),
declared AS (SELECT path, 'r' AS scope, 'n' || k % 9 AS name, path || '::n' || k % 9 AS symbol, 'function' AS kind FROM o WHERE k % 4 = 0
  UNION ALL SELECT DISTINCT path, 'r', 'C', path || '::C.' || m, 'method' FROM o, (SELECT unnest(['m0', 'm1', 'm2']) AS m)
  UNION ALL SELECT path, 'o' || k, 'n' || k % 11, CASE WHEN k % 3 > 0 THEN path || '::o' || k END, CASE WHEN k % 5 = 0 THEN 'variable' ELSE 'function' END FROM o
  UNION ALL SELECT path, 'l' || k || '.' || n, 'n' || p % 11, path || '::l' || k || '.' || n, 'class' FROM l WHERE p % 2 = 0),
mutated AS (SELECT path, 'l' || k || '.' || n AS scope, 'n' || q % 11 AS name FROM l WHERE quantity < 10),
imported AS (SELECT 'f' || c_custkey AS path, 'n9' AS name, 'm' || c_nationkey AS module, 'x' || c_custkey % 3 AS what, c_custkey % 2 = 0 AS only_type FROM customer UNION ALL SELECT 'f' || c_custkey, 'n10', 'm' || c_nationkey, '*', false FROM customer),
loose AS (SELECT 'f' || c_custkey AS path, 'f' || c_custkey || '::C.m1' AS symbol FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'f' || c_custkey, 'f' || c_custkey || '::C.*' FROM customer WHERE c_custkey % 7 = 0),
asked AS (SELECT path, k * 10 + n AS ref, s + 500 AS "at", CASE WHEN n = 7 THEN 'this.m' || q % 4 WHEN n % 3 = 0 THEN 'n' || q % 11 || '.m' ELSE 'n' || q % 11 END AS target,
  CASE WHEN n % 2 = 0 THEN 'calls' ELSE 'reads' END AS kind, CASE WHEN n = 7 THEN path || '::C' END AS owner FROM l)"""


@query(f"""
WITH {SCOPES},
said AS (SELECT path, scope, name, true AS mutated, NULL AS symbol, NULL AS kind FROM mutated UNION ALL SELECT path, scope, name, false, symbol, kind FROM declared),
names AS (SELECT path, scope, name, bool_or(mutated) AS mutated, arg_min({{'symbol': symbol, 'kind': kind}}, (symbol IS NULL, symbol, kind)) AS first FROM said GROUP BY ALL),
found AS (SELECT r.path, ref, names.mutated, names.first.symbol AS symbol, names.first.kind AS said_kind FROM (SELECT *, string_split(target, '.')[1] AS root FROM asked) r JOIN names ON names.path = r.path AND name = root
  JOIN scope s ON s.path = r.path AND s.scope = names.scope AND r."at" BETWEEN a AND b QUALIFY row_number() OVER (PARTITION BY r.path, ref ORDER BY a DESC, b) = 1),
told AS (
  SELECT r.path, r.ref, r.target, r.kind, r.owner, f.mutated, f.symbol, f.said_kind, i.module, i.what, i.only_type, CASE WHEN contains(r.target, '.') THEN substr(r.target, instr(r.target, '.') + 1) END AS member
  FROM asked r LEFT JOIN found f ON f.path = r.path AND f.ref = r.ref LEFT JOIN imported i ON i.path = r.path AND i.name = string_split(r.target, '.')[1]),
resolved AS (SELECT path, ref, target, mutated, CASE
  WHEN owner IS NOT NULL THEN CASE WHEN (path, owner || '.' || member) IN (SELECT path, symbol FROM declared WHERE symbol IS NOT NULL) AND (path, owner || '.' || member) NOT IN (SELECT path, symbol FROM loose) AND (path, owner || '.*') NOT IN (SELECT path, symbol FROM loose) THEN owner || '.' || member END
  WHEN mutated THEN NULL
  WHEN mutated = false THEN CASE WHEN member IS NULL AND (kind <> 'calls' OR said_kind IN ('function', 'method', 'class')) THEN symbol END
  WHEN module IS NULL OR only_type AND kind = 'calls' THEN NULL
  WHEN what = '*' THEN CASE WHEN NOT contains(member, '.') THEN 'js:' || module || '#' || member END
  WHEN member IS NULL THEN 'js:' || module || '#' || what END AS to_, owner FROM told)
SELECT path, ref, CASE WHEN to_ IS NOT NULL THEN 'resolved' WHEN owner IS NULL AND mutated THEN 'binding_boundary' ELSE 'unresolved' END AS outcome, coalesce(to_, target) AS target FROM resolved
""")
def scope_resolution(spark, d):
    from pyspark.sql import Window

    orders = table(spark, d, "orders").select(F.concat(F.lit("f"), "o_custkey").alias("path"), F.col("o_orderkey").alias("k"))
    o = orders.withColumn("s", 10_000 * F.row_number().over(Window.partitionBy("path").orderBy("k")))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.struct(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("q"), F.col("l_quantity").alias("quantity")).alias("first"))
    lines = lines.repartition("k").groupBy("k", "n").agg(F.min("first").alias("first"))
    # read for scopes, declarations, mutations and references, so the join is done once
    folder = f"{work_dir(spark)}/lines"
    lines.join(o, "k").select("path", "k", "n", (F.col("s") + 1000 * F.col("n")).alias("s"), "first.*").write.parquet(folder)
    line = spark.read.parquet(folder)
    name = lambda c, m=11: F.concat(F.lit("n"), F.col(c) % m)
    in_order, in_line = F.concat(F.lit("o"), "k"), F.concat(F.lit("l"), "k", F.lit("."), "n")
    of_file = lambda c: F.concat("path", F.lit("::"), c)
    scope = (
        o.select("path", F.lit("r").alias("scope"), F.lit(0).alias("start"), F.lit(10_000_000).alias("end")).distinct()
        .unionByName(o.select("path", in_order.alias("scope"), F.col("s").alias("start"), (F.col("s") + 9999).alias("end")))
        .unionByName(line.select("path", in_line.alias("scope"), F.col("s").alias("start"), (F.col("s") + 999).alias("end")))
    )
    declared = (
        o.where("k % 4 = 0").select("path", F.lit("r").alias("scope"), name("k", 9).alias("name"), of_file(name("k", 9)).alias("symbol"), F.lit("function").alias("kind"))
        .unionByName(o.select("path", F.lit("r").alias("scope"), F.lit("C").alias("name"), F.explode(F.array(*(of_file(F.lit(f"C.m{i}")) for i in range(3)))).alias("symbol"), F.lit("method").alias("kind")).distinct())
        .unionByName(o.select("path", in_order.alias("scope"), name("k").alias("name"), F.when(F.col("k") % 3 > 0, of_file(in_order)).alias("symbol"), F.when(F.col("k") % 5 == 0, "variable").otherwise("function").alias("kind")))
        .unionByName(line.where("p % 2 = 0").select("path", in_line.alias("scope"), name("p").alias("name"), of_file(in_line).alias("symbol"), F.lit("class").alias("kind")))
    )
    mutated = line.where("quantity < 10").select("path", in_line.alias("scope"), name("q").alias("name"))
    files = table(spark, d, "customer").select(F.concat(F.lit("f"), "c_custkey").alias("path"), "c_custkey", F.concat(F.lit("m"), "c_nationkey").alias("module"))
    imported = files.select("path", F.lit("n9").alias("name"), "module", F.concat(F.lit("x"), F.col("c_custkey") % 3).alias("imported"), (F.col("c_custkey") % 2 == 0).alias("only_type"))
    imported = imported.unionByName(files.select("path", F.lit("n10").alias("name"), "module", F.lit("*").alias("imported"), F.lit(False).alias("only_type")))
    loose = files.where("c_custkey % 2 = 0").select("path", of_file(F.lit("C.m1")).alias("symbol")).unionByName(files.where("c_custkey % 7 = 0").select("path", of_file(F.lit("C.*")).alias("symbol")))
    own = F.col("n") == 7
    target = F.when(own, F.concat(F.lit("this.m"), F.col("q") % 4)).when(F.col("n") % 3 == 0, F.concat(name("q"), F.lit(".m"))).otherwise(name("q"))
    asked = line.select("path", (F.col("k") * 10 + F.col("n")).alias("ref"), (F.col("s") + 500).alias("at"), target.alias("target"), F.when(F.col("n") % 2 == 0, "calls").otherwise("reads").alias("kind"), F.when(own, of_file(F.lit("C"))).alias("class_owner"))
    return scopes.resolve(asked, scope, declared, mutated, imported, loose)


# ------------------------------------------------------------------ hierarchies and pointers


@query("""
WITH RECURSIVE e AS (SELECT 'c' || p_partkey AS class, 'c' || p_partkey // 2 AS base FROM part WHERE p_partkey > 1 UNION SELECT 'c' || p_partkey, 'c' || (p_partkey * 7 % 1000 + 1) FROM part WHERE p_size = 1),
up(class, ancestor, distance) AS (SELECT class, base, 1 FROM e WHERE class <> base UNION SELECT u.class, e.base, distance + 1 FROM up u JOIN e ON e.class = u.ancestor AND e.class <> e.base WHERE distance < 30),
near AS (SELECT class, ancestor, min(distance) AS distance FROM up WHERE class <> ancestor GROUP BY ALL),
m AS (SELECT DISTINCT 'c' || l_partkey AS class, 'm' || l_suppkey % 10 AS name, l_linenumber % 3 AS arity, 'c' || l_partkey || '.m' || l_suppkey % 10 || '/' || l_linenumber % 3 AS method FROM lineitem)
SELECT DISTINCT a.method, b.method AS overridden, CAST(distance AS INTEGER) AS distance, 'synthesized' AS provenance FROM m a JOIN near USING (class) JOIN m b ON b.class = ancestor AND a.name = b.name AND a.arity = b.arity
QUALIFY distance = min(distance) OVER (PARTITION BY a.method)
""")
def override_edges(spark, d):
    c = lambda e: F.concat(F.lit("c"), e)
    part = table(spark, d, "part")
    key = F.col("p_partkey")
    extends = part.where("p_partkey > 1").select(c(key).alias("class"), c(F.floor(key / 2)).alias("base"))
    extends = extends.unionByName(part.where("p_size = 1").select(c(key).alias("class"), c(key * 7 % 1000 + 1).alias("base")))
    line = table(spark, d, "lineitem").select(c("l_partkey").alias("class"), F.concat(F.lit("m"), F.col("l_suppkey") % 10).alias("name"), (F.col("l_linenumber") % 3).alias("arity")).distinct()
    methods = line.withColumn("method", F.concat("class", F.lit("."), "name", F.lit("/"), "arity"))
    return fixpoint.overrides(methods, extends, work_dir(spark))


@query("""
WITH RECURSIVE a AS (
  SELECT DISTINCT 'f' || l_suppkey AS path, 'v' || l_partkey % 100 AS variable, CASE WHEN l_linenumber = 3 THEN 'g' || l_orderkey % 30 ELSE 'v' || l_orderkey % 100 END AS value FROM lineitem
  UNION SELECT 'f' || l_suppkey, 'w' || l_partkey, 'v0' FROM lineitem WHERE l_returnflag = 'R'
), f AS (SELECT 'f' || s_suppkey AS path, 'g' || i AS name FROM supplier, range(20) r(i)),
points(path, variable, target) AS (
  SELECT path, variable, value FROM a WHERE (path, value) IN (SELECT path, name FROM f)
  UNION SELECT a.path, a.variable, p.target FROM points p JOIN a ON a.path = p.path AND a.value = p.variable AND (a.path, a.value) NOT IN (SELECT path, name FROM f)
), c AS (SELECT 'f' || o_custkey % 100 + 1 AS path, 'w' || o_orderkey AS owner, o_orderkey % 1000 AS line, CASE WHEN o_orderkey % 4 = 0 THEN 'g' || o_orderkey % 30 ELSE 'v' || o_orderkey % 120 END AS name FROM orders)
SELECT c.path, owner, line, coalesce(target, c.name) AS target, CASE WHEN target IS NOT NULL THEN 'synthesized' WHEN (c.path, c.name) IN (SELECT path, variable FROM a) THEN 'unresolved' ELSE 'parsed' END AS provenance
FROM c LEFT JOIN points p ON p.path = c.path AND p.variable = c.name
""".replace("'f' || o_custkey % 100 + 1", "'f' || (o_custkey % 100 + 1)"))
def pointer_calls(spark, d):
    mod = lambda p, c, m: F.concat(F.lit(p), F.col(c) % m)
    line = table(spark, d, "lineitem").withColumn("path", F.concat(F.lit("f"), "l_suppkey"))
    value = F.when(F.col("l_linenumber") == 3, mod("g", "l_orderkey", 30)).otherwise(mod("v", "l_orderkey", 100))
    assigned = line.select("path", mod("v", "l_partkey", 100).alias("variable"), value.alias("value"))
    assigned = assigned.unionByName(line.where("l_returnflag = 'R'").select("path", F.concat(F.lit("w"), "l_partkey").alias("variable"), F.lit("v0").alias("value")))
    functions = table(spark, d, "supplier").select(F.concat(F.lit("f"), "s_suppkey").alias("path"), F.explode(F.array(*(F.lit(f"g{i}") for i in range(20)))).alias("name"))
    name = F.when(F.col("o_orderkey") % 4 == 0, mod("g", "o_orderkey", 30)).otherwise(mod("v", "o_orderkey", 120))
    calls = table(spark, d, "orders").select(F.concat(F.lit("f"), F.col("o_custkey") % 100 + 1).alias("path"), F.concat(F.lit("w"), "o_orderkey").alias("owner"), (F.col("o_orderkey") % 1000).alias("line"), name.alias("name"))
    return fixpoint.pointer_calls(calls, assigned, functions, work_dir(spark), hub=200)
