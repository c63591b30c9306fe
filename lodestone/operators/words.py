"""Words of texts that have no spaces: paths of highest probability through a lattice of dictionary words.

The dictionary is a table of (word, n), counted from a corpus, and stays one: the different substrings of blocks of runs are
joined with it, so that its size does not matter. A run's words are the path of least cost, the cost of a word being the rounded
thousandfold of ln(total / n); of paths of equal cost the one with the longer last word counts, and so on backwards.
"""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs of characters that are written without spaces (fixed values), and the longest word in them.
CJK_RUN, LONGEST = "[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]+", 4
#: A longer run is cut after so many characters.
RUN_MOST = 4096
#: Characters of runs in a block, about, and bits of the map of the dictionary's words (2 MB).
BLOCK_CHARS, BITS = 1 << 19, 1 << 24


def counted_dictionary(texts: DataFrame, text: str, run: str = CJK_RUN, longest: int = LONGEST, least: int = 2) -> DataFrame:
    """(word, n): all substrings of ``longest`` characters or fewer of the runs in a corpus that occur ``least`` times or more."""
    size = F.length("run")
    runs = texts.select(F.explode(F.regexp_extract_all(text, F.lit(f"({run})"), F.lit(1))).alias("run")).groupBy("run").agg(F.count("*").alias("times"))
    starts = runs.select("run", "times", F.explode(F.sequence(F.lit(1), size)).alias("start"))
    grams = starts.select("times", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), size - F.col("start") + 1)), lambda n: F.substring("run", F.col("start"), n))).alias("word"))
    return grams.groupBy("word").agg(F.sum("times").alias("n")).where(F.col("n") >= least)


def _may_hold(grams: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``grams`` (block, word) without those that a bitmap of ``BITS`` bits, whatever the dictionary's size, tells to be no words of it."""
    bit = F.xxhash64("word").bitwiseAND(F.lit(BITS - 1))
    bitmap = dictionary.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    # the bytes of a bucket are told once, so that looking one up makes no string
    told = F.transform(F.sequence(F.lit(1), F.length("bits")), lambda i: F.conv(F.hex(F.substring("bits", i, F.lit(1))), 16, 10).cast("int"))
    rows = grams.withColumn("bucket", F.bitmap_bucket_number(bit)).withColumn("bit", F.bitmap_bit_position(bit).cast("int"))
    byte = F.get("told", F.shiftright("bit", 3))
    return rows.join(F.broadcast(bitmap.select("bucket", told.alias("told"))), "bucket").where(F.getbit(byte, F.col("bit") % 8) == 1).select("block", "word")


def _best_words(run: str, machine: ahocorasick.Automaton | None, unknown: int) -> list[str]:
    """The words of the least path; ``machine`` finds (length, cost) of the words that end at a place, longer ones first."""
    best, back, last = [0], [0], -1
    for at, (size, cost) in machine.iter(run) if machine else ():
        if at == last:
            total = best[last + 1 - size] + cost
            if total < best[-1] or (total == best[-1] and back[-1] == last):
                best[-1], back[-1] = total, last + 1 - size
            continue
        for place in range(last + 1, at):
            best.append(best[place] + unknown)
            back.append(place)
        total, alone = best[at + 1 - size] + cost, best[at] + unknown
        best.append(min(total, alone))
        back.append(at + 1 - size if total <= alone else at)
        last = at
    back += range(last + 1, len(run))
    out, pos = [], len(run)
    while pos:
        out.append(run[back[pos] : pos])
        pos = back[pos]
    return out[::-1]


def segmented_runs(runs: DataFrame, dictionary: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(run, words) for different ``runs`` (run) of at most ``RUN_MOST`` characters. A character that is no word counts as a word seen once.

    Runs are dealt to blocks of bounded size. Each different substring of a block that may be a word meets the dictionary once,
    and a block gets back the words found in it: no substring carries its run.
    """
    total = dictionary.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("total"))
    priced = dictionary.crossJoin(F.broadcast(total)).select("word", F.round(1000 * F.log(F.col("total") / F.col("n"))).cast("long").alias("cost"))
    chars = runs.agg(F.sum(F.length("run"))).first()[0] or 0
    dealt = runs.select(F.pmod(F.xxhash64("run"), F.lit(chars // BLOCK_CHARS + 1)).alias("block"), "run")
    starts = dealt.select("block", "run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("start"))
    ahead = starts.select("block", F.substring("run", F.col("start"), F.lit(longest)).alias("ahead"))
    grams = ahead.select("block", F.explode(F.array(*(F.substring("ahead", 1, n) for n in range(1, longest + 1)))).alias("word"))
    known = _may_hold(grams, dictionary).distinct().join(priced, "word").select(F.col("block").alias("at"), "word", "cost")
    unknown = F.round(1000 * F.log("total")).cast("long").alias("unknown")

    def lattice(runs_: pd.DataFrame, known_: pd.DataFrame) -> pd.DataFrame:
        machine = ahocorasick.Automaton()
        for word, cost in zip(known_["word"], known_["cost"].tolist(), strict=True):
            machine.add_word(word, (len(word), cost))
        machine.make_automaton()
        told = [(run, _best_words(run, machine if len(machine) else None, one)) for run, one in zip(runs_["run"], runs_["unknown"].tolist(), strict=True)]
        return pd.DataFrame(told, columns=["run", "words"])

    priced_runs = dealt.crossJoin(F.broadcast(total)).select("block", "run", unknown)
    return priced_runs.groupBy("block").cogroup(known.groupBy("at")).applyInPandas(lattice, "run string, words array<string>")


def segmented(rows: DataFrame, key: list[str], text: str, dictionary: DataFrame, run: str = CJK_RUN, longest: int = LONGEST) -> DataFrame:
    """``key`` and segmented: runs as words of the dictionary, other words and visible characters by themselves, joined by single spaces.

    Rows are told apart by ``key``. A null text gives null, one without a visible character an empty text.
    """
    whole = F.regexp_extract_all(text, F.lit(f"({run}|[A-Za-z0-9]+|\\S)"), F.lit(1))
    is_run = F.col("piece").rlike(f"^{run}$")
    pieces = rows.select(*key, F.posexplode(whole).alias("place", "piece"))
    cut = F.when(is_run, F.transform(F.sequence(F.lit(0), F.floor((F.length("piece") - 1) / RUN_MOST)), lambda i: F.substring("piece", (i * RUN_MOST + 1).cast("int"), F.lit(RUN_MOST)))).otherwise(F.array("piece"))
    parts = pieces.select(*key, "place", is_run.alias("is_run"), F.posexplode(cut).alias("part", "run"))
    known = segmented_runs(parts.where("is_run").select("run").distinct(), dictionary, longest)
    told = parts.join(known, "run", "left").withColumn("words", F.coalesce("words", F.array("run")))
    joined = told.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "part", "words"))).alias("p"))
    out = joined.select(*key, F.array_join(F.flatten(F.transform("p", lambda x: x["words"])), " ").alias("segmented"))
    left = rows.select(*key, F.when(F.col(text).isNotNull(), "").alias("none"))
    return left.join(out, key, "left").select(*key, F.coalesce("segmented", "none").alias("segmented"))
