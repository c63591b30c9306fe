"""What the operators of this subpackage share: staged tables, Arrow helpers, hashed words."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; only a plain local master may fall back to a temporary one."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        return f"file://{tempfile.gettempdir()}/lodestone-shared"
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


class Scratch:
    """Tables written to the shared folder. They cut lineage, and a lost executor costs no recomputation of what they hold."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.top = spark, f"{shared_dir(spark)}/lodestone/{label}-{uuid.uuid4().hex}"
        self.made = 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.top}/{name}-{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that nothing will read any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id="doc_id"):
    """True for the fifth of the ids that training never sees; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def texts_of(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, not decoded."""
    return column.cast(pa.binary()).to_pylist()


# --------------------------------------------------------------------------- hashed words

SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(0x10DE)
_BYTE_KEYS = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15  # odd, and 5 mod 8: its powers keep all 64 bits apart
_powers = np.ones(1, np.uint64)
_CHUNK = 1 << 20


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 256)
        with np.errstate(over="ignore"):
            step = np.full(size, _BASE, np.uint64)
            step[0] = 1
            _powers = np.multiply.accumulate(step)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(raw: np.ndarray, breaks: np.ndarray):
    """Slices of about a megabyte that cut no word."""
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + _CHUNK)
        while end < n and not breaks[raw[end]]:
            ahead = np.flatnonzero(breaks[raw[end : end + _CHUNK]])
            end = end + int(ahead[0]) if len(ahead) else min(n, end + _CHUNK)
        yield raw[at:end]
        at = end


def word_hashes(text: bytes, breaks: np.ndarray = SPACES) -> np.ndarray:
    """A 64-bit hash of each word of a text, A-Z lower-cased, in order: a polynomial over its bytes with random byte keys."""
    out = []
    for raw in _chunks(LOWER[np.frombuffer(text, np.uint8)], breaks):
        inside = ~breaks[raw]
        if not inside.any():
            continue
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        starts = np.flatnonzero(edge == 1)
        raw, inside, starts = raw[starts[0] :], inside[starts[0] :], starts - starts[0]
        place = np.arange(len(raw)) - np.repeat(starts, np.diff(starts, append=len(raw)))
        place[~inside] = 0
        with np.errstate(over="ignore"):
            terms = _BYTE_KEYS[raw] * _powers_to(int(place.max()) + 1)[place]
            terms[~inside] = 0
            lengths = np.add.reduceat(inside.astype(np.uint64), starts)
            out.append(mix(np.add.reduceat(terms, starts) + lengths))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of k consecutive words; of the whole sequence if there are fewer; nothing without words."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    with np.errstate(over="ignore"):
        total = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            total = mix(total * np.uint64(_BASE) + words[i : n - width + 1 + i])
    return np.unique(total)


def below_fraction(keys: list[str], size: int, total: int, seed: str):
    """True for about ``size`` of ``total`` rows, the same ones each time: those whose hashed keys fall below the fraction."""
    if total <= size:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) < math.ceil((1 << 30) * size / total)


def at_most(rows: DataFrame, label: str, bounds: dict, order: list[str]) -> DataFrame:
    """Of each value of ``label`` in ``bounds`` that many rows at most, the first in ``order``; each task sorts out its own first."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    most = F.create_map(*(F.lit(x) for pair in bounds.items() for x in pair)) if bounds else None
    ranked = rows.withColumn("__place", place).where(F.col("__place") <= max(bounds.values(), default=0))
    return (ranked.where(F.col("__place") <= F.element_at(most, F.col(label))) if bounds else ranked).drop("__place")
