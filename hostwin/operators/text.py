"""Word sequences and successor lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostwin.session import pin

# The characters that separate words (Unicode white space and the four
# information separators).
SPACES = (r"[\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
          r"\x{202f}\x{205f}\x{3000}]+")

# The same characters by themselves.
SEPARATORS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def words(text: Column, lower: bool = False) -> Column:
    """Words of a text in order; case is kept unless ``lower``."""
    text = F.lower(text) if lower else text
    # One separator for all: splitting at a plain character is faster than at a class of characters.
    return F.filter(F.split(F.translate(text, SEPARATORS, " " * len(SEPARATORS)), " "), lambda w: w != "")


def tokens(df: DataFrame, key: str = "doc_id", text: str = "text",
           lower: bool = False) -> DataFrame:
    """(key, pos, word) for every word of every text."""
    return df.select(key, F.posexplode(words(F.col(text), lower)).alias("pos", "word"))


def word_pairs(df: DataFrame, key: str = "doc_id", text: str = "text",
               lower: bool = False) -> DataFrame:
    """(key, pos, word, next): neighbouring words, also across line breaks. No shuffle."""
    listed = df.select(key, words(F.col(text), lower).alias("w"))
    # The inner pairs come from the array of the same row, so no window is needed.
    pairs = F.posexplode(F.arrays_zip(
        F.col("w").alias("word"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1)))
        .alias("next")))
    return listed.select(key, pairs.alias("pos", "p")).select(
        key, "pos", "p.word", "p.next").filter(F.col("next").isNotNull())


def successors(df: DataFrame, key: str = "doc_id", text: str = "text",
               lower: bool = False) -> DataFrame:
    """(key, word, nexts): the words that follow each word of a text, in order, with repeats.

    A text whose key no other row has is listed in its own row, so its words are not shuffled. Only rows that
    share a key meet by (key, word).
    """
    repeated = pin(df.groupBy(F.col(key).alias("_key")).count().filter("count > 1").select("_key"))
    if repeated.isEmpty():
        return _listed_in_rows(df, key, text, lower)
    # The stored keys have a known size, so the planner broadcasts them only while they are few.
    same = F.col(key).eqNullSafe(F.col("_key"))
    pairs = word_pairs(df.join(repeated, same, "left_semi"), key, text, lower)
    listed = F.array_sort(F.collect_list(F.struct("pos", "next")))["next"]
    return _listed_in_rows(df.join(repeated, same, "left_anti"), key, text, lower).unionByName(
        pairs.groupBy(key, "word").agg(listed.alias("nexts")))


def _listed_in_rows(df: DataFrame, key: str, text: str, lower: bool) -> DataFrame:
    """(key, word, nexts) of each row by itself: its pairs sorted by word, cut where the word changes."""
    inner = F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0)))
    pairs = F.array_sort(F.transform(inner, lambda w, i: F.struct(
        w.alias("word"), i.alias("pos"), F.get("w", i + 1).alias("next"))))
    rows = df.select(key, words(F.col(text), lower).alias("w")).select(key, pairs.alias("s"))
    begins = F.filter(F.transform("s", lambda p, i: i), lambda i: (i == 0) | (
        F.get("s", i)["word"] != F.get("s", i - 1)["word"]))
    end = lambda j: F.coalesce(F.get("at", j + 1), F.size("s"))
    runs = F.transform("at", lambda i, j: F.struct(
        F.get("s", i)["word"].alias("word"), F.slice("s", i + 1, end(j) - i)["next"].alias("nexts")))
    return rows.select(key, "s", begins.alias("at")).select(key, F.explode(runs).alias("r")).select(key, "r.*")


def successor_counts(df: DataFrame, text: str = "text", lower: bool = False) -> DataFrame:
    """(word, next, n) over all texts: the form to use when texts are many.

    A pair is counted as one string, as no word holds a space: most pairs are rare, so what is hashed and
    shuffled is the keys.
    """
    pairs = word_pairs(df.select(F.lit(0).alias("k"), text), "k", text, lower)
    counts = pairs.select(F.concat_ws(" ", "word", "next").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.substring_index("pair", " ", 1).alias("word"),
                         F.substring_index("pair", " ", -1).alias("next"), "n")
