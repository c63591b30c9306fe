"""Links between modules and symbols: import hints, ES modules, member calls, section references, and the writes they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import extension
from lodestone.functions.text import name_tail

#: Suffixes that a module without one may have, what a compiled suffix stands for, kinds that can be called, steps.
SUFFIXES = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".mts", ".cjs", ".cts")
COMPILED = {".js": ".ts", ".jsx": ".tsx", ".mjs": ".mts", ".cjs": ".cts"}
CALLABLE, STEPS = ("function", "method", "class"), 8
SCRIPTS = ("js", "jsx", "mjs", "cjs", "ts", "mts", "cts", "tsx")


def path_suffixes(path: Column) -> Column:
    """The path and every tail of it that starts after a slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


def import_hints(source_file: Column, name: Column) -> Column:
    """Files that may define an imported name: the module's file or package, leading dots climbing from the importing file."""
    dots = F.length(name) - F.length(F.ltrim(name, F.lit(".")))
    parts = F.filter(F.split(F.replace(F.ltrim(name, F.lit(".")), F.lit("::"), F.lit(".")), r"\."), lambda p: p != "")
    folders = F.split(source_file, "/")
    kept = F.greatest(F.size(folders) - 1 - F.greatest(dots - 1, F.lit(0)), F.lit(0))
    package = F.when(dots > 0, F.slice(folders, F.lit(1), kept)).otherwise(F.array().cast("array<string>"))
    at = lambda *tail: F.array_join(F.concat(package, *tail), "/")
    module = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    init = F.array(F.lit("__init__.py"))
    alone = F.array(at(init), F.concat(at(parts), F.lit(".py")), at(parts, init))
    inside = F.array(F.concat(at(module), F.lit(".py")), at(module, init))
    none = F.array().cast("array<string>")
    return F.when(source_file.isNull() | (source_file == "") | (F.size(parts) == 0), none).when(F.size(parts) > 1, F.array_distinct(inside)).when(dots > 0, F.array_distinct(alone)).otherwise(none)


def hinted_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path): files that equal a hint of a reference (id, file_path, reference_name) or end with a slash and it."""
    asked = refs.select("id", F.explode(import_hints(F.col("file_path"), F.col("reference_name"))).alias("hint")).distinct()
    return asked.join(files.select("path", F.explode(path_suffixes(F.col("path"))).alias("hint")), "hint").select("id", "path").distinct()


def module_paths(source_file: Column, module: Column) -> Column:
    """Paths that a relative ES module may name; none if it is not relative, holds odd characters or leaves the root."""
    steps = F.concat(F.slice(F.split(source_file, "/"), F.lit(1), F.size(F.split(source_file, "/")) - 1), F.split(module, "/"))
    #: Going up from the root leaves a marker that no later step removes.
    walked = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda have, step: F.when(step.isin("", "."), have)
        .when((step == "..") & ((F.size(have) == 0) | (F.try_element_at(have, F.lit(1)) == "..")), F.concat(F.array(F.lit("..")), have))
        .when(step == "..", F.slice(have, F.lit(1), F.size(have) - 1))
        .otherwise(F.array_append(have, step)),
    )
    none = F.array().cast("array<string>")

    def tried(at: Column) -> Column:
        base, suffix = at["base"], at["suffix"]
        stem = base.substr(F.lit(1), F.length(base) - F.length(suffix))
        out = F.when(suffix == "", F.array(base, *(F.concat(base, F.lit(s)) for s in SUFFIXES), *(F.concat(base, F.lit("/index" + s)) for s in SUFFIXES)))
        for ending, original in COMPILED.items():
            out = out.when(suffix == ending, F.array(base, F.concat(stem, F.lit(original))))
        return F.when(at["first"] != "..", out.otherwise(F.array(base))).otherwise(none)

    # each step is bound to a variable, so that a path is walked once however often it is used
    bound = F.transform(F.array(walked), lambda w: F.struct(F.array_join(w, "/").alias("base"), F.coalesce(F.try_element_at(w, F.lit(1)), F.lit("..")).alias("first")))
    bound = F.transform(bound, lambda w: F.struct(w["base"].alias("base"), w["first"].alias("first"), F.regexp_extract(w["base"], r"(?<=[^/.])(\.[^./]*)$", 1).alias("suffix")))
    fits = module.rlike(r"^\.\.?/") & ~module.rlike(r"[\\?#%\x00]")
    return F.when(fits, F.get(F.transform(bound, tried), F.lit(0))).otherwise(none)


def _module_symbols(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(ref, fqn) of references (ref, target, source_file) such as ``js:./m#name``: the one exported symbol of the one file that fits."""
    target = F.regexp_extract("target", "^js:(.*)#([^#]*)$", 1), F.regexp_extract("target", "^js:(.*)#([^#]*)$", 2)
    asked = refs.where(extension(F.col("source_file")).isin(*SCRIPTS)).select("ref", "source_file", target[0].alias("module"), target[1].alias("imported")).where("imported NOT IN ('', '*')")
    tried = asked.select("ref", "imported", F.explode(F.array_distinct(module_paths(F.col("source_file"), F.col("module")))).alias("path"))
    there = tried.join(files.select("path").distinct(), "path").groupBy("ref", "imported").agg(F.count("*").alias("n"), F.min("path").alias("file_path")).where("n = 1")
    own = symbols.where("is_exported").select("fqn", "name", "file_path")
    hit = there.join(own, (there["file_path"] == own["file_path"]) & (F.col("name") == F.col("imported")) & (F.col("fqn") == F.concat(own["file_path"], F.lit("::"), F.col("imported"))))
    return hit.groupBy("ref").agg(F.count("*").alias("n"), F.min("fqn").alias("fqn")).where("n = 1").drop("n")


def resolve_modules(refs: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(ref, fqn) of references (ref, target, source_file, kind) to ES modules, re-exports followed for at most eight symbols.

    Where each exported name leads is worked out once, and so is each different target of a file and kind; these step along that table
    together, and the references take what their target led to.
    Nothing is resolved where a file, a symbol or a re-export is not the only one, where names go in a circle, at a boundary
    (calls only), or where a call ends at something that cannot be called.
    """
    exports = edges.where("kind = 'exports' AND provenance = 'parsed'").groupBy("source").agg(F.count("*").alias("n"), F.min("target").alias("target"))
    holder = symbols.select(F.col("fqn").alias("source"), "file_path").distinct()
    through = _module_symbols(exports.where("n = 1").join(holder, "source").select(F.col("source").alias("ref"), "target", F.col("file_path").alias("source_file")), symbols, files)
    unique = symbols.groupBy(F.col("fqn").alias("target")).agg(F.count("*").alias("same")).where("same = 1")
    direct = exports.where("n = 1 AND NOT startswith(target, 'js:')").join(unique, "target").select("source", F.col("target").alias("next"))
    onward = through.select(F.col("ref").alias("source"), F.col("fqn").alias("next")).unionByName(direct)
    links = exports.select("source").join(onward, "source", "left").select(F.col("source").alias("fqn"), "next", F.lit(True).alias("moves"))
    fences = edges.where("kind = 'binding_boundary'").select(F.col("source").alias("fqn"), F.lit(True).alias("fenced")).distinct()
    kinds = symbols.groupBy("fqn").agg(F.min("kind").alias("symbol_kind"))
    about = kinds.join(links, "fqn", "left").join(fences, "fqn", "left")
    # one row for each different target, file and kind
    asked = refs.select("target", "source_file", "kind").where("target IS NOT NULL AND source_file IS NOT NULL").distinct()
    asked = asked.withColumn("ref", F.struct("target", "source_file", "kind"))
    rows = _module_symbols(asked, symbols, files).select("ref", F.col("ref.kind").alias("kind"), "fqn", F.lit(False).alias("done"))
    for _ in range(STEPS):
        at = rows.join(about, "fqn", "left")
        stopped = F.coalesce(F.col("fenced"), F.lit(False)) & (F.col("kind") == "calls")
        ends = ~F.coalesce(F.col("moves"), F.lit(False))
        right = (F.col("kind") != "calls") | F.col("symbol_kind").isin(*CALLABLE)
        fqn = F.when(F.col("done"), F.col("fqn")).when(stopped, None).when(ends & right, F.col("fqn")).when(ends, None).otherwise(F.col("next"))
        rows = at.select("ref", "kind", fqn.alias("fqn"), (F.col("done") | (~stopped & ends & right)).alias("done")).where("fqn IS NOT NULL")
    led = rows.where("done").select("ref.*", "fqn").withColumnRenamed("kind", "of_kind")
    return refs.join(led, ["target", "source_file"]).where(F.col("kind").eqNullSafe(F.col("of_kind"))).select("ref", "fqn")


def member_calls(targets: DataFrame, symbols: DataFrame) -> DataFrame:
    """(target, fqn, chunk_id) of calls on a receiver whose method is that of one class only; sources go before headers.

    Spellings that agree in class and method are one entity. A method of several classes resolves to nothing.
    """
    cut = F.when(F.contains("target", F.lit("->")), F.element_at(F.split("target", "->"), -1)).otherwise(name_tail(F.col("target")))
    asked = targets.select("target", cut.alias("method")).where(r"target RLIKE '->|[.]|::'").where("method RLIKE '^[A-Za-z_][A-Za-z0-9_]*$'").distinct()
    words = F.split(F.replace("fqn", F.lit("::"), F.lit(".")), r"\.")
    held = symbols.where("chunk_id IS NOT NULL AND kind IN ('function', 'method')").select(F.col("name").alias("method"), "fqn", "chunk_id", F.array_join(F.slice(words, -F.least(F.size(words), F.lit(2)), 2), ".").alias("entity"), extension(F.col("file_path")).isin("h", "hh", "hpp", "hxx").alias("header"), "file_path")
    one = held.groupBy("method").agg(F.min("entity").alias("low"), F.max("entity").alias("high"), F.min_by(F.struct("fqn", "chunk_id"), F.struct("header", "file_path", "fqn", "chunk_id")).alias("best")).where("low = high")
    return asked.join(one, "method").select("target", "best.fqn", "best.chunk_id")


def references_of(refs: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """Rows of ``refs`` (spec, symbol, ...) for wanted symbols or specs (one column named ``by``), in a total order."""
    return refs.join(wanted.select(by).distinct(), by, "left_semi").orderBy(by, "spec", "symbol")


def members_of(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key is among ``ids``, whatever their number."""
    return rows.join(ids.select(key), key, "left_semi")


def write_resolved(edges: DataFrame, refs: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables after resolution: ``edges`` with those of resolved references, and the references that stay.

    ``resolved``: id, source, target (null: failed), kind, line, provenance. A reference with any target goes; one without
    stays as failed, with the last part of its name. An edge that is there already is not written again.
    """
    new = resolved.where("target IS NOT NULL")
    made = new.join(refs.select("id", "file_path"), "id").select("file_path", "source", "target", "kind", "line", "provenance")
    every = edges.select("file_path", "source", "target", "kind", "line", "provenance", F.lit(0).alias("late")).unionByName(made.withColumn("late", F.lit(1)))
    own = Window.partitionBy("file_path", "source", "target", "kind", "line").orderBy("late", "provenance")
    after = every.withColumn("n", F.row_number().over(own)).where("n = 1").drop("n", "late")
    failed = resolved.where("target IS NULL").select("id", F.lit(True).alias("missed")).distinct()
    rest = refs.join(new.select("id"), "id", "left_anti").join(failed, "id", "left")
    rest = rest.withColumn("name_tail", F.when(F.col("missed"), name_tail(F.col("reference_name"))).otherwise(F.col("name_tail")))
    return after, rest.withColumn("status", F.when(F.col("missed"), "failed").otherwise(F.col("status"))).drop("missed")
