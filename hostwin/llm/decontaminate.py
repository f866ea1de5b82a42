"""Benchmark decontamination: FM-indexes over shards of the training texts, searched for test phrases."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostwin.llm.common import Batches, attach, slices
from hostwin.session import pin

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Symbols of a shard's text beside its words, which follow.
END, BREAK, FIRST = 0, 1, 2
SAMPLED = 16
INDEX = ("numbers array<bigint>, ids array<{id}>, n_words array<bigint>, owners array<bigint>, froms array<bigint>, "
         "starts array<int>, words array<binary>, counts array<int>, planes array<binary>, marks binary, "
         "samples array<int>")


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and all beyond ASCII in a UTF-8 text, with A-Z in lower case."""
    return _WORD.findall((text or b"").lower())


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a text of small integers whose last symbol is smaller than all others.

    Suffixes are ranked by a few symbols at first; each round then looks two known lengths further, and
    only at suffixes that still share their rank.
    """
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    reach = max(1, min(3, 63 // bits))
    padded = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(reach):
        key = (key << bits) | padded[k:k + n]
    order = np.argsort(key)
    key = key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    shared = np.flatnonzero(~(first & np.concatenate([first[1:], [True]])))
    wide = (n + 1).bit_length()
    while len(shared):
        own = order[shared]
        near, far = (np.where(own + k < n, rank[np.minimum(own + k, n - 1)] + 1, 0) for k in (reach, 2 * reach))
        # Three ranks make one key while they fit.
        again = (np.argsort((rank[own] << 2 * wide) | (near << wide) | far) if 3 * wide <= 63
                 else np.lexsort((far, near, rank[own])))
        own, near, far = own[again], near[again], far[again]
        was = rank[own]
        order[shared] = own
        new = np.concatenate([[True], (was[1:] != was[:-1]) | (near[1:] != near[:-1]) | (far[1:] != far[:-1])])
        rank[own] = np.maximum.accumulate(np.where(new, shared, 0))
        shared = shared[~(new & np.concatenate([new[1:], [True]]))]
        reach *= 3
    return order


class Bits:
    """A bit vector with ranks: the number of ones before a position."""

    def __init__(self, raw: bytes):
        self.lanes = np.frombuffer(raw, "<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.lanes), dtype=np.int64)])

    @staticmethod
    def packed(bits: np.ndarray) -> bytes:
        """Bits in whole lanes of 64, with one lane to spare."""
        lanes = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        lanes[:len(raw)] = raw
        return lanes.tobytes()

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        lane = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[lane] + np.bitwise_count(self.lanes[lane] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The bits at some positions."""
        return ((self.lanes[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """A wavelet tree by levels: the bits of each symbol from the highest, zeros before ones on the next level."""

    def __init__(self, planes: list[bytes], n: int):
        self.planes = [Bits(p) for p in planes]
        self.n = n
        self.zeros = [n - int(p.rank(np.array([n]))[0]) for p in self.planes]

    @staticmethod
    def planes_of(symbols: np.ndarray) -> list[bytes]:
        """The bit planes of a sequence of symbols."""
        planes = []
        for level in range(max(1, int(symbols.max()).bit_length()) - 1, -1, -1):
            ones = (symbols >> level & 1).astype(bool)
            planes.append(Bits.packed(ones))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        return planes

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position, and the start of the symbol's leaf."""
        start, end = np.zeros_like(at), at.copy()
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            one = (symbol >> (len(self.planes) - 1 - level) & 1).astype(bool)
            both = plane.rank(np.concatenate([start, end]))
            s1, e1 = both[:len(at)], both[len(at):]
            start, end = np.where(one, zeros + s1, start - s1), np.where(one, zeros + e1, end - e1)
        return end - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, its occurrences before) of each position."""
        symbol, start, end = np.zeros_like(at), np.zeros_like(at), at.copy()
        for plane, zeros in zip(self.planes, self.zeros):
            one = plane.get(end)
            both = plane.rank(np.concatenate([start, end]))
            s1, e1 = both[:len(at)], both[len(at):]
            symbol = symbol << 1 | one
            start, end = np.where(one, zeros + s1, start - s1), np.where(one, zeros + e1, end - e1)
        return symbol, end - start


@dataclass
class Fm:
    """An FM-index: the wavelet tree of the symbols before the sorted suffixes, counts, sampled places."""

    tree: Wavelet
    before: np.ndarray
    marks: Bits
    samples: np.ndarray

    @classmethod
    def read(cls, counts: np.ndarray, planes: list[bytes], marks: bytes, samples: np.ndarray) -> Fm:
        """From its stored parts."""
        before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        return cls(Wavelet(planes, int(before[-1])), before, Bits(marks), samples)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each phrase (rows of symbols, of equal length), from its last word on."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.tree.n, np.int64)
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            ranks = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low[alive], high[alive]]))
            low[alive] = self.before[symbol] + ranks[:len(alive)]
            high[alive] = self.before[symbol] + ranks[len(alive):]
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of some suffixes, walking back to a sampled one."""
        at, steps, place = rows.copy(), np.zeros_like(rows), np.empty_like(rows)
        todo = np.arange(len(rows))
        while len(todo):
            here = at[todo]
            known = self.marks.get(here)
            done = todo[known]
            place[done] = self.samples[self.marks.rank(here[known])] + steps[done]
            todo = todo[~known]
            symbol, rank = self.tree.access(here[~known])
            at[todo] = self.before[symbol] + rank
            steps[todo] += 1
        return place


def index_parts(text: np.ndarray) -> tuple[np.ndarray, list[bytes], bytes, np.ndarray]:
    """(counts, planes, marks, samples) of a text that ends with its smallest symbol."""
    order = suffix_array(text)
    marked = order % SAMPLED == 0
    return (np.bincount(text), Wavelet.planes_of(text[order - 1]), Bits.packed(marked), order[marked])


class _Shard:
    """Texts that are indexed together."""

    def __init__(self) -> None:
        self.numbers: list[int] = []
        self.ids: list = []
        self.n_words: list[int | None] = []
        self.symbol: dict[bytes, int] = defaultdict(lambda: len(self.symbol) + FIRST)
        self.pieces: list[tuple[int, int, np.ndarray]] = []
        self.size = 0

    def add(self, number: int, key, n_words: int | None, words: list[bytes], start: int) -> None:
        """A text, or the part of it from word ``start`` on."""
        self.numbers.append(number)
        self.ids.append(key)
        self.n_words.append(n_words)
        if words:
            symbols = np.fromiter(map(self.symbol.__getitem__, words), np.int32, len(words))
            self.pieces.append((number, start, symbols))
        self.size += len(words) + 1

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        """The index as one row."""
        gap = np.array([BREAK], np.int32)
        text = np.concatenate([x for *_, s in self.pieces for x in (s, gap)] + [np.array([END], np.int32)])
        lengths = np.array([0, *[len(s) + 1 for *_, s in self.pieces]], np.int64)
        counts, planes, marks, samples = index_parts(text)
        numbers, long, short, raw = (pa.list_(t) for t in (kind, pa.int64(), pa.int32(), pa.binary()))
        return pa.RecordBatch.from_arrays([
            pa.array([self.numbers], long), pa.array([self.ids], numbers), pa.array([self.n_words], long),
            pa.array([[n for n, *_ in self.pieces]], long), pa.array([[f for _, f, _ in self.pieces]], long),
            pa.array([np.cumsum(lengths)[:-1]], short), pa.array([list(self.symbol)], raw),
            pa.array([counts], short), pa.array([planes], raw), pa.array([marks], pa.binary()),
            pa.array([samples], short)], [c.split()[0] for c in INDEX.split(", ")])


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shard_words: int = 1 << 20,
                overlap: int = 9) -> DataFrame:
    """One row per shard of about ``shard_words`` words, stored: an FM-index of its texts.

    ``numbers``, ``ids`` and ``n_words`` list the documents; ``starts`` are the places in the shard's
    text where a document begins, ``owners`` the numbers of these documents and ``froms`` the words of
    them that lie before. A document of more words than fit continues in further shards under
    the same number, each part with the last ``overlap`` words before it, so that no phrase of up to
    overlap + 1 words is cut; its ``n_words`` stands in the last one. Numbers are unique within ``origin``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Batches):
        shard, number, kind = _Shard(), 0, None
        for batch in slices(batches):
            kind = batch.column(0).type
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(raw)
                if shard.ids and shard.size + len(words) > shard_words:
                    yield shard.batch(kind)
                    shard = _Shard()
                start = 0
                while len(words) - start > shard_words:
                    shard.add(number, key, None, words[start:start + shard_words], start)
                    yield shard.batch(kind)
                    shard = _Shard()
                    start += shard_words - overlap
                shard.add(number, key, len(words), words[start:], start)
                number += 1
        if shard.ids:
            yield shard.batch(kind)

    made = rows.mapInArrow(run, INDEX.format(id=dict(rows.dtypes)["id"]))
    # The upper bits of the row number are the task's, whose documents are numbered from 0.
    return pin(made.withColumn("origin", F.shiftright(F.monotonically_increasing_id(), 33)))


def phrases_of(items: DataFrame, id_col: str, text: str, window: int, block: int) -> tuple[DataFrame, DataFrame, int]:
    """((number, phrase, block), (item, number), blocks): the distinct windows of all items, stored.

    A phrase is its words joined by blanks. An item of fewer words than ``window``, but not none, is one
    phrase. Blocks hold about ``block`` phrases.
    """
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                        F.col(text).cast("binary").alias("text"))

    def cut(batches: Batches):
        for batch in slices(batches):
            at, found = [], []
            for row, raw in enumerate(batch.column(1).to_pylist()):
                words = words_of(raw)
                own = {b" ".join(words[i:i + window]) for i in range(max(1, len(words) - window + 1))} if words else ()
                at += [row] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.binary())], ["item", "phrase"])

    windows = pin(rows.mapInArrow(cut, "item string, phrase binary").distinct())
    n = windows.select("phrase").distinct().count()
    blocks = max(1, -(-n // block))
    phrases = pin(windows.select("phrase").distinct().select(
        F.monotonically_increasing_id().alias("number"), "phrase",
        F.pmod(F.xxhash64("phrase"), F.lit(blocks)).cast("int").alias("block")))
    return phrases, pin(windows.join(phrases, "phrase").select("item", "number")), blocks


@dataclass
class Phrases:
    """A block of phrases: their distinct words, and by length the words of each as positions among these."""

    words: pa.Array
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, numbers: list[int], phrases: list[bytes]) -> Phrases:
        """From phrases and their numbers."""
        place: dict[bytes, int] = defaultdict(lambda: len(place))
        by_length: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        for number, phrase in zip(numbers, phrases):
            words = [place[w] for w in phrase.split(b" ")]
            own = by_length[len(words)]
            own[0].append(words)
            own[1].append(number)
        return cls(pa.array(list(place), pa.binary()), {
            n: (np.array(w, np.int64), np.array(x, np.int64)) for n, (w, x) in by_length.items()})


def occurrences(shard: dict, phrases: Phrases) -> tuple[np.ndarray, ...]:
    """(owner, from, to, phrase) of every occurrence of the phrases in a shard, in words of the owner."""
    nothing = np.empty(0, np.int64)
    if not len(shard["starts"]):
        return (nothing,) * 4
    symbol = pc.index_in(phrases.words, value_set=shard["words"]).fill_null(-FIRST).to_numpy(
        zero_copy_only=False).astype(np.int64) + FIRST
    index = None
    found = []
    for length, (words, numbers) in phrases.by_length.items():
        known = symbol[words]
        able = np.flatnonzero((known >= FIRST).all(axis=1))
        if not len(able):
            continue
        if index is None:
            index = Fm.read(shard["counts"], shard["planes"], shard["marks"], shard["samples"])
        low, high = index.search(known[able])
        hit = np.flatnonzero(low < high)
        sizes = (high - low)[hit]
        rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes)
        places = index.locate(rows + np.arange(len(rows)))
        piece = np.searchsorted(shard["starts"], places, side="right") - 1
        start = places - shard["starts"][piece] + shard["froms"][piece]
        found.append((shard["owners"][piece], start, start + length, np.repeat(numbers[able[hit]], sizes)))
    return tuple(map(np.concatenate, zip(*found))) if found else (nothing,) * 4


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that touch or overlap as one, in order."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]


HITS = "number bigint, froms array<bigint>, tos array<bigint>, phrases array<bigint>"


def search_index(index: DataFrame, phrases: DataFrame, blocks: int) -> DataFrame:
    """(origin, number, froms, tos, phrases) of the documents of ``index`` that hold some phrase, stored.

    A block of phrases at a time goes to all shards; a document found in several shards or
    blocks has a row for each. Spans of a row are merged, and phrases distinct.
    """
    spark, found = index.sparkSession, None
    columns = ["origin", "owners", "froms", "starts", "words", "counts", "planes", "marks", "samples"]
    for block in range(blocks):
        rows = phrases.filter(F.col("block") == block).select("number", "phrase").collect()
        sent = spark.sparkContext.broadcast(Phrases.of([r.number for r in rows], [bytes(r.phrase) for r in rows]))

        def run(batches: Batches, sent=sent):
            for batch in slices(batches, 1):
                shard = {c: batch.column(i)[0] for i, c in enumerate(columns)}
                for c in ("owners", "froms", "starts", "counts", "samples"):
                    shard[c] = shard[c].values.to_numpy(zero_copy_only=False)
                shard |= {"words": shard["words"].values, "planes": shard["planes"].values.to_pylist(),
                          "marks": shard["marks"].as_py()}
                owner, start, end, number = occurrences(shard, sent.value)
                if not len(owner):
                    continue
                order = np.argsort(owner, kind="stable")
                cuts = np.flatnonzero(np.diff(owner[order])) + 1
                groups = np.split(order, cuts)
                spans = [merged(start[g], end[g]) for g in groups]
                long = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard["origin"].as_py()] * len(groups), pa.int64()),
                     pa.array([owner[g[0]] for g in groups], pa.int64()),
                     pa.array([a for a, _ in spans], long), pa.array([b for _, b in spans], long),
                     pa.array([np.unique(number[g]) for g in groups], long)],
                    ["origin", "number", "froms", "tos", "phrases"])

        hits = pin(index.select(*columns).mapInArrow(run, "origin bigint, " + HITS))
        found = hits if found is None else found.unionAll(hits)
    return found


def whole_spans(hits: DataFrame) -> DataFrame:
    """(origin, number, spans) with the spans of all rows of a document merged."""
    lists = hits.groupBy("origin", "number").agg(F.flatten(F.collect_list("froms")).alias("froms"),
                                                 F.flatten(F.collect_list("tos")).alias("tos"))

    def run(batches: Batches):
        for batch in slices(batches, 4096):
            spans = []
            for row in range(batch.num_rows):
                a, b = merged(*(batch.column(c)[row].values.to_numpy() for c in (2, 3)))
                spans.append([{"from": x, "to": y} for x, y in zip(a.tolist(), b.tolist())])
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind)],
                                             ["origin", "number", "spans"])

    return lists.mapInArrow(run, "origin bigint, number bigint, spans array<struct<from:bigint,to:bigint>>")


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
               item_col: str = "item_id", item_text: str = "text", window: int = 10,
               shard_words: int = 1 << 20, block: int = 1 << 16) -> DataFrame:
    """(id, n_words, spans, items) of every document: merged spans of its words that repeat test items.

    A window is ``window`` consecutive words of an item, or the whole item if it has fewer, but not none. Spans cover
    every occurrence of any window, as word positions from 0, ends exclusive. ``items`` are the ids
    (as strings, sorted) of the items with a window that occurs.

    Words are runs of digits, letters and characters beyond ASCII; case of A-Z does not matter. NULL and
    empty texts have no words. Rows with a repeated document id stay separate rows; items with the same
    id are one item, and a NULL item id is the empty string. Empty tables on either side find nothing.
    """
    index = build_index(docs, id_col, text, shard_words, window - 1)
    phrases, owners, blocks = phrases_of(items, item_col, item_text, window, block)
    hits = search_index(index, phrases, blocks)
    # Few rows per document; a phrase in a third of all documents is dealt over salts.
    pairs = pin(hits.select("origin", "number", F.explode("phrases").alias("phrase")))
    named = owners.groupBy(F.col("number").alias("phrase")).agg(F.collect_list("item").alias("owners"))
    found = attach(pairs, named, "phrase").select("origin", "number", F.explode("owners").alias("item")).distinct()
    items_of = found.groupBy("origin", "number").agg(F.array_sort(F.collect_list("item")).alias("items"))
    facts = whole_spans(hits).join(items_of, ["origin", "number"])
    listed = index.select("origin", F.explode(F.arrays_zip("numbers", "ids", "n_words")).alias("d")).filter(
        "d.n_words is not null").select("origin", F.col("d.numbers").alias("number"), F.col("d.ids").alias("id"),
                                        F.col("d.n_words").alias("n_words"))
    return listed.join(facts, ["origin", "number"], "left").select(
        "id", "n_words", F.coalesce("spans", F.expr("array()").cast(dict(facts.dtypes)["spans"])).alias("spans"),
        F.coalesce("items", F.expr("array()").cast("array<string>")).alias("items"))
