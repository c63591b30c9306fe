"""Predicates and classes of file paths and file contents."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File extension to language.
LANGUAGES = {
    "py": "python", "pyi": "python",
    "c": "c", "h": "c",
    "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "c++": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "h++": "cpp", "ipp": "cpp", "tpp": "cpp",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx",
    "rs": "rust", "kt": "kotlin", "kts": "kotlin",
    "md": "markdown", "markdown": "markdown", "mdx": "markdown",
}
#: Bytes that a file may have, for sources and for all others.
SOURCE_LIMIT, OTHER_LIMIT = 1 << 20, 128 << 10
#: Directories that are never read, by name (the last one is the engine's own) and by pattern.
PRUNED = (
    ".git", ".hg", ".svn", ".venv", "venv", "env", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".eggs",
    "dist", "build", "target", ".idea", ".vscode", ".lodestone",
)
PRUNED_PATTERNS = ("cmake-build-*", "build-*", "out", "htmlcov", ".cache", ".gradle", ".next", ".nuxt", ".turbo", ".parcel-cache", "__pypackages__")
#: Parts and ends of the names of generated files, and what their first lines say.
GENERATED_PARTS, GENERATED_ENDS = ("_generated.", "autogen"), (".pb.cc", ".pb.h", ".pb.cpp", ".pb2.py", ".designer.cs", ".g.cs")
GENERATED_BANNERS = (
    "do not edit", "don't edit", "@generated", "auto-generated", "autogenerated by", "this file was generated", "machine generated", "code generated by",
    "automatically generated",
)
BANNER_LINES = 10
#: Extensions of documents, folders and names of changelogs, folders of examples.
DOCUMENTS = (".md", ".mdx", ".rst", ".txt", ".adoc")
CHANGELOG_DIRS = ("release-notes", "release_notes", "releasenotes", "releases", "changelog", "changelogs")
CHANGELOG_NAME = r"^(changelog|changes|history|news|release[-_ ]?notes?)"
EXAMPLE_DIRS = ("example", "examples", "sample", "samples", "demo", "demos", "docs_src", "tutorial", "tutorials", "cookbook", "snippets")
#: Words by which a query asks for such files.
CHANGELOG_WORDS = ("changelog", "change log", "release note", "what's new", "whats new", "更新日志", "变更日志", "发布说明", "更新记录", "版本记录", "更新说明")
EXAMPLE_WORDS = ("example", "sample", "demo", "tutorial", "cookbook", "snippet", "示例", "样例", "例子", "教程", "演示")
TEST_WORDS = ("test", "tests", "pytest", "unittest", "fixture", "测试", "单测", "用例")
#: Marks of languages in the paths of documents.
LOCALES = (
    "en", "zh", "zh-cn", "zh-tw", "zh-hans", "zh-hant", "zh_cn", "zh_tw", "ja", "ko", "de", "fr", "es", "pt", "pt-br", "pt_br", "ru", "tr", "hi", "it",
    "vi", "id", "pl", "uk", "ar", "nl", "sv", "th", "he", "fa", "ro", "cs", "el", "hu", "bg", "da", "fi", "no", "sk",
)
#: Names of instructions for agents, and the document types that raise a score.
AGENT_NAMES = ("agents.md", "claude.md", ".cursorrules", ".agent.md", "handoff.md", "skill.md")
HIGH_VALUE = ("agent-instructions", "design", "adr", "readme", "api")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(table, extension(path))


def with_languages(files: DataFrame) -> DataFrame:
    """``files`` with a language; C headers are C++ where the project has any C++ file."""
    named = files.withColumn("language", language(F.col("path")))
    cpp = named.where("language = 'cpp'").select(F.lit(True).alias("has_cpp")).limit(1)
    joined = named.join(cpp, F.lit(True), "left")
    return joined.withColumn("language", F.when((extension(F.col("path")) == "h") & F.col("has_cpp"), "cpp").otherwise(F.col("language"))).drop("has_cpp")


def size_reason(path: Column, length: Column) -> Column:
    limit = F.when(language(path).isNotNull(), SOURCE_LIMIT).otherwise(OTHER_LIMIT)
    return F.when(length > limit, F.concat(F.lit("oversize:"), length.cast("string")))


def is_binary(content: Column) -> Column:
    """Within the first 8 KiB: a NUL, or more than a tenth of control bytes other than tab, line feed and carriage return."""
    head = F.decode(F.substring(content, 1, 8192), "ISO-8859-1")  # a character for each byte
    control = F.length(head) - F.length(F.regexp_replace(head, r"[\x00-\x08\x0B\x0C\x0E-\x1F]+", ""))
    return F.contains(head, F.lit("\0")) | (control > 0.1 * F.length(head))


def _is_one_of(name: Column, names: tuple[str, ...]) -> Column:
    return name.isin(*names)


def _any(tests: list[Column]) -> Column:
    return functools.reduce(operator.or_, tests)


def _folders(path: Column) -> Column:
    """The names of the folders on the way to a file."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def is_pruned(path: Column) -> Column:
    """Whether a folder on the way has one of the pruned names or patterns."""
    pattern = "^(" + "|".join(re.escape(p).replace(r"\*", ".*") for p in PRUNED_PATTERNS) + ")$"
    return F.exists(_folders(path), lambda d: _is_one_of(d, PRUNED) | d.rlike(pattern))


def is_generated(path: Column, text: Column) -> Column:
    """By the file's name, or by a banner in the first ten lines."""
    name = F.lower(basename(F.replace(path, F.lit("\\"), F.lit("/"))))
    by_name = _any([*(F.contains(name, F.lit(x)) for x in GENERATED_PARTS), *(F.endswith(name, F.lit(x)) for x in GENERATED_ENDS)])
    head = F.lower(F.array_join(F.slice(F.split(text, "\n", BANNER_LINES + 1), 1, BANNER_LINES), "\n"))
    return by_name | F.coalesce(_any([F.contains(head, F.lit(x)) for x in GENERATED_BANNERS]), F.lit(False))


def is_test(path: Column) -> Column:
    """In a folder (or at a path) of tests, or a file named test_x.y or x_test.y."""
    return path.rlike(r"(^|/)(tests?|testdata|fixtures)(/|$)") | path.rlike(r"(^|/)(test_[^/]*|[^/]*_test)\.[A-Za-z0-9]+$")


def is_document(path: Column) -> Column:
    return _any([F.endswith(F.lower(path), F.lit(x)) for x in DOCUMENTS])


def is_changelog(path: Column) -> Column:
    """A document in a folder of release notes, or named as one."""
    low = F.lower(path)
    return is_document(path) & (F.exists(_folders(low), lambda d: _is_one_of(d, CHANGELOG_DIRS)) | basename(F.replace(low, F.lit("\\"), F.lit("/"))).rlike(CHANGELOG_NAME))


def is_example(path: Column) -> Column:
    return F.exists(_folders(F.lower(path)), lambda d: _is_one_of(d, EXAMPLE_DIRS))


def has_intent(query: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words occurs in the lower-cased query."""
    return _any([F.contains(F.lower(query), F.lit(w)) for w in words])


def translation(path: Column) -> Column:
    """(key, locale) of a document: its path without the first mark of a language, and that mark; a null locale without one.

    A mark is a folder, or the end of the file's name before its extension. Other files are keys of their own.
    """
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    n = F.size(parts)
    low = F.slice(F.transform(parts, F.lower), F.lit(1), F.greatest(n - 1, F.lit(0)))
    place = F.coalesce(F.array_min(F.filter(F.transform(low, lambda d, i: F.when(_is_one_of(d, LOCALES), i)), lambda i: i.isNotNull())), F.lit(-1))
    mark = "(?i)[-_.](" + "|".join(sorted(LOCALES, key=len, reverse=True)) + r")(?=\.[A-Za-z0-9]+$)"
    name = F.element_at(parts, -1)
    in_name = F.lower(F.regexp_extract(name, mark, 1))
    without_folder = F.array_join(F.filter(parts, lambda _, i: i != place), "/")
    without_mark = F.array_join(F.concat(F.slice(parts, F.lit(1), n - 1), F.array(F.regexp_replace(name, mark, ""))), "/")
    whole = F.struct(path.alias("key"), F.lit(None).cast("string").alias("locale"))
    by_folder = F.struct(without_folder.alias("key"), F.get(low, place).alias("locale"))
    by_name = F.struct(without_mark.alias("key"), in_name.alias("locale"))
    return F.when(~is_document(path), whole).when(place >= 0, by_folder).when(in_name != "", by_name).otherwise(whole)


def doctype(path: Column) -> Column:
    """The type of a document, by the first rule that holds."""
    slashed = F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/")))
    name = F.lower(basename(slashed))
    begins = lambda *starts: _any([F.startswith(name, F.lit(x)) for x in starts])
    return (
        F.when(_is_one_of(name, AGENT_NAMES), "agent-instructions")
        .when(begins("readme"), "readme")
        .when(begins("architecture") | F.contains(slashed, F.lit("/docs/design/")), "design")
        .when(F.contains(slashed, F.lit("/docs/adr/")), "adr")
        .when(begins("api", "protocol", "openapi"), "api")
        .when(begins("changelog"), "changelog")
        .otherwise("guide")
    )


def chunk_kind(symbol_kind: Column, path: Column) -> Column:
    return F.when(symbol_kind == "spec_block", "spec").when(symbol_kind == "fallback_block", "fallback").when(is_test(path), "test").otherwise("code")


def path_matches(path: Column, wanted: Column) -> Column:
    """Equal, or ends with a slash and the wanted path."""
    return (path == wanted) | F.endswith(path, F.concat(F.lit("/"), wanted))
