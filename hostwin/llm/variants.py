"""Spelling variants: words one edit apart, found by probing Bloom filters with generated edits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostwin.llm.common import Batches
from hostwin.session import pin

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The symbols that a run can hold after lower-casing.
SYMBOLS = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], dtype=np.uint64)
#: Words from this length on share a filter class.
LONGEST = 64
#: A block of a filter: lanes of 64 bits, one bit in each per word.
LANES = 8
WORDS_A_SHARD, WORDS_A_TASK = 1 << 17, 1 << 14
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def counted_words(docs: DataFrame, id_col: str, text: str, shortest: int, least: int, loses: int) -> DataFrame:
    """(word, n) of the words with at least ``shortest`` code points and ``least`` occurrences, stored.

    A run whose crc32 of ``<id>:<run>`` is a multiple of ``loses`` loses the code point at the
    remainder of that number by its length.
    """
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("mark"),
                       F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.encode(F.concat("mark", "run"), "UTF-8"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % loses == 0, cut).otherwise(F.col("run")).alias("word"))
    return pin(words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
               .filter(F.col("n") >= least))


def length_class(word: str | Column) -> Column:
    """The filter class of a word."""
    return F.least(F.length(word), F.lit(LONGEST)).cast("int")


def places(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms c * base**i of the sum that is a word's hash, and the powers themselves."""
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, len(points) - 1), _BASE)]), dtype=np.uint64)
    return points * powers, powers


def mixed(sums: np.ndarray) -> np.ndarray:
    """Hashes whose bits depend on all bits of the sums."""
    h = sums ^ (sums >> np.uint64(33))
    h *= _MIX[0]
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    return h ^ (h >> np.uint64(32))


def _code_points(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)


def word_hash(word: str) -> int:
    """The hash of a word: the mixed sum of its code points times powers of a base."""
    return int(mixed(places(_code_points(word))[0].sum(dtype=np.uint64, keepdims=True))[0])


class Filter:
    """A blocked Bloom filter: a word sets one bit in each lane of one block."""

    def __init__(self, lanes: np.ndarray):
        self.lanes = lanes.reshape(-1, LANES)

    @classmethod
    def of(cls, hashes: np.ndarray, bits_a_word: int) -> Filter:
        """The filter of some hashes."""
        blocks = max(1, math.ceil(len(hashes) * bits_a_word / (64 * LANES)))
        made = cls(np.zeros(blocks * LANES, dtype=np.uint64))
        block, bits = made.block(hashes), made.bits(hashes)
        for lane in range(LANES):
            np.bitwise_or.at(made.lanes[:, lane], block, made.bit(bits, lane))
        return made

    def block(self, hashes: np.ndarray) -> np.ndarray:
        """The block of each hash, by its upper half."""
        return ((hashes >> np.uint64(32)) * np.uint64(len(self.lanes)) >> np.uint64(32)).astype(np.int64)

    @staticmethod
    def bits(hashes: np.ndarray) -> np.ndarray:
        """The numbers that choose a bit in each lane, independent of the block."""
        return mixed(hashes * _BASE)

    @staticmethod
    def bit(bits: np.ndarray, lane: int) -> np.ndarray:
        """The bit of each in a lane, by its own six bits."""
        return np.uint64(1) << ((bits >> np.uint64(6 * lane)) & np.uint64(63))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the hashes that may be in the filter: all that are, and few others."""
        at = np.arange(len(hashes))
        block, bits = self.block(hashes), self.bits(hashes)
        for lane in range(LANES):
            at = at[(self.lanes[block[at], lane] & self.bit(bits[at], lane)) != 0]
        return at


def sharded(words: DataFrame) -> tuple[DataFrame, int]:
    """((word, n, class, shard), words): a length class has as many shards as bound their size."""
    # One row per class of lengths, of which there are at most LONGEST.
    sizes = {r["class"]: r["count"] for r in words.groupBy(length_class("word").alias("class")).count().collect()}
    number = F.lit(1)
    for kind, n in sizes.items():
        number = F.when(length_class("word") == kind, -(-n // WORDS_A_SHARD)).otherwise(number)
    shard = F.pmod(F.xxhash64("word"), number.cast("bigint")).cast("int")
    dealt = words.select("word", "n", length_class("word").alias("class"), shard.alias("shard"))
    return dealt, sum(sizes.values())


def build_filters(words: DataFrame, bits_a_word: int) -> DataFrame:
    """(class, shard, size, bits): one blocked Bloom filter per shard of :func:`sharded` words, stored.

    Shards hold about ``WORDS_A_SHARD`` words, so that neither a task nor a filter grows with the
    vocabulary; only the number of shards does.
    """
    def build(pdf):
        hashes = np.array([word_hash(w) for w in pdf["word"]], dtype=np.uint64)
        made = Filter.of(hashes, bits_a_word)
        return pdf.iloc[:1][["class", "shard"]].assign(size=made.lanes.nbytes, bits=[made.lanes.tobytes()])

    return pin(words.groupBy("class", "shard").applyInPandas(
        build, "class int, shard int, size bigint, bits binary"))


def edit_sums(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Sums of the edits of a word: (places left out, their sums, replacements in parts).

    Leaving out one of several equal neighbours gives the same word, so only the first of them is
    left out. A place is replaced only by higher symbols, as the lower word of a pair proposes the
    higher one. Replacements come as (places, symbols, sums), a bounded number at a time.
    """
    terms, powers = places(points)
    total = terms.sum(dtype=np.uint64)
    first = np.concatenate([[True], points[1:] != points[:-1]]) if len(points) else np.empty(0, bool)
    out = np.flatnonzero(first)
    after = total - np.cumsum(terms, dtype=np.uint64)
    left = (np.cumsum(terms, dtype=np.uint64) - terms + after * _UNDO)[out]

    def replaced():
        step = 1 << 12
        for a in range(0, len(points), step):
            own = points[a:a + step]
            at, symbol = np.nonzero(SYMBOLS[None, :] > own[:, None])
            yield a + at, SYMBOLS[symbol], total + (SYMBOLS[symbol] - own[at]) * powers[a + at]

    return out, left, replaced()


def proposals(words: DataFrame, filters: dict[int, list[tuple[int, bytes]]]) -> DataFrame:
    """(word, n, other): edits of each word that pass a filter of their length class.

    ``filters`` has the shards sent in this round. Every edit probes all of them in its class.
    """
    sent = words.sparkSession.sparkContext.broadcast(filters)

    def probe(batches: Batches):
        own = {kind: [Filter(np.frombuffer(raw, np.uint64)) for raw in shards] for kind, shards in sent.value.items()}

        def passing(kind: int, sums: np.ndarray) -> np.ndarray:
            hashes = mixed(sums)
            found = [f.holds(hashes) for f in own.get(kind, ())]
            return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            at, others = [], []
            for row, word in enumerate(column["word"].to_pylist()):
                points = _code_points(word)
                kind, below = min(len(points), LONGEST), min(len(points) - 1, LONGEST)
                out, sums, replaced = edit_sums(points)
                if below in own:
                    for i in out[passing(below, sums)].tolist():
                        at.append(row)
                        others.append(word[:i] + word[i + 1:])
                if kind not in own:
                    continue
                for where, symbols, sums in replaced:
                    for j in passing(kind, sums).tolist():
                        i = int(where[j])
                        at.append(row)
                        others.append(word[:i] + chr(int(symbols[j])) + word[i + 1:])
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([column["word"].take(rows), column["n"].take(rows),
                                              pa.array(others, pa.string())], ["word", "n", "other"])

    return words.select("word", "n").mapInArrow(probe, "word string, n bigint, other string")


def near_pairs(words: DataFrame, bits_a_word: int = 16, round_bytes: int = 32 << 20) -> DataFrame:
    """(word, near, near_n) of all words (word, n) that differ by exactly one edit, in both directions, stored.

    An edit inserts, deletes or replaces one code point. Each word probes its deletions and its
    replacements by higher symbols; insertions are the deletions of the other word. The filters
    are broadcast, at most ``round_bytes`` (or one shard) in a round, so the number of rounds
    grows with the vocabulary and not what is sent. What passes is joined with the words
    themselves, which removes what passed by chance.
    """
    spark = words.sparkSession
    dealt, total = sharded(words)
    dealt = pin(dealt)
    made = build_filters(dealt, bits_a_word)
    sizes = sorted((r["class"], r.shard, r.size) for r in made.select("class", "shard", "size").collect())
    rounds: list[list[tuple[int, int]]] = [[]]
    held = 0
    for kind, shard, size in sizes:
        if rounds[-1] and held + size > round_bytes:
            rounds.append([])
            held = 0
        rounds[-1].append((kind, shard))
        held += size
    # Words are small but each makes hundreds of edits, so a task has few of them.
    spread = dealt.repartition(1 + total // WORDS_A_TASK, "word")
    found = None
    for part in rounds:
        if not part:
            continue
        wanted = spark.createDataFrame(part, "class int, shard int")
        filters: dict[int, list[bytes]] = {}
        for r in made.join(F.broadcast(wanted), ["class", "shard"]).collect():
            filters.setdefault(r["class"], []).append(bytes(r.bits))
        passed = pin(proposals(spread, filters))
        found = passed if found is None else found.unionAll(passed)
    if found is None:
        return spark.createDataFrame([], "word string, near string, near_n bigint")
    # An edit can pass in several rounds, in all but one by chance.
    true = pin(found.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").distinct())
    return true.select("word", F.col("other").alias("near"), F.col("other_n").alias("near_n")).unionAll(
        true.select(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms of forms, to the last.

    Steps double, so a chain of length c takes log2(c) rounds; a form is at least ``times`` as
    frequent as its word, so chains have under 64 links.
    """
    ahead = pin(forms.select("word", F.col("form").alias("root")))
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = pin(ahead.join(further, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        ahead = moved.select("word", "root")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shortest: int = 6,
                   least: int = 5, times: int = 5, loses: int = 199) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the frequent words of all texts.

    Two words are near if one inserted, deleted or replaced code point turns one into the other.
    The form of a word is its most frequent near word (ties: the smallest in code-point order), if
    that occurs ``times`` as often or more, else NULL; ``root`` follows forms to the last.

    NULL and empty texts have no words; a NULL id counts as empty text before the colon. Repeated
    rows count each time. Words of any length are compared; an empty table gives no rows.
    """
    words = counted_words(docs, id_col, text, shortest, least, loses)
    pairs = near_pairs(words)
    # Words and their near words meet in one shuffle; of the latter only the best is kept on the way.
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near")))
    told = words.select("word", "n", F.lit(None).cast("string").alias("near"),
                        F.lit(None).cast("bigint").alias("near_n"))
    facts = told.unionByName(pairs.withColumn("n", F.lit(None).cast("bigint"))).groupBy("word").agg(
        F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    formed = -F.col("best.less") >= F.col("n") * times
    known = pin(facts.select("word", "n", "n_near", F.when(formed, F.col("best.near")).alias("form"),
                             F.when(formed, -F.col("best.less")).alias("form_n")))
    roots = followed(known.filter("form is not null").select("word", "form"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
