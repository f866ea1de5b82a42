"""Packing documents into sequences along a Hilbert curve over projected document vectors."""

from __future__ import annotations

import os
import string
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostwin.llm.common import Batches, slices, sole
from hostwin.session import pin, scratch_path

PIECES = ("id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, `offset` bigint, hilbert bigint")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a file; one thread, as Spark runs a task per core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


_MARKS = string.punctuation.encode()


class Remembered:
    """A dictionary of about ``most`` to twice ``most`` entries; what was not used lately goes."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def age(self) -> None:
        """Begin anew if there are too many entries; those in use are taken over when wanted."""
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new

    def lacking(self, keys: set) -> list:
        """Bring ``keys`` into ``new`` as far as they are known; returns the others."""
        unknown = []
        for key in keys.difference(self.new):
            value = self.old.get(key)
            if value is None:
                unknown.append(key)
            else:
                self.new[key] = value
        return unknown


class WordEncoder:
    """Ids of texts by a vocabulary whose pre-tokenizer drops white space.

    There the ids of a text are those of its words one after the other, so each distinct word is
    encoded once and remembered while it stays in use. A word of letters and trailing marks is
    put together from these two parts, which such a pre-tokenizer separates as well. Where the
    vocabulary marks the end of a word, plain words are encoded many at a time. The vocabulary
    must be one of lower-case words.
    """

    def __init__(self, path: str, most: int = 300_000):
        self.tokenizer = tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2") if len(vocabulary) <= 1 << 16 else np.dtype("<u4")
        self.words = Remembered(most)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """For each text its ids and ``end``, as little-endian bytes of ``kind``."""
        split = [_lowered(t or "").split() for t in texts]
        self.words.age()
        self._learn(self.words.lacking(set().union(*split)))
        ids = self.words.new.__getitem__
        last = np.array([end], self.kind).tobytes()
        return [b"".join(map(ids, words)) + last for words in split]

    def _learn(self, missing: list[bytes]) -> None:
        plain, whole, marked = [], [], []
        for word in missing:
            core = word.rstrip(_MARKS)
            if not (core.isalpha() or _letters(core)):
                whole.append(word)
            elif core is word:
                plain.append(word)
            else:
                marked.append((word, core, word[len(core):]))
        plain += self.words.lacking({core for _, core, _ in marked}.difference(plain))
        whole += self.words.lacking({tail for _, _, tail in marked}.difference(whole))
        known = self.words.new
        if self.ends.any():
            known.update(self._together(plain))
        rest = [w for w in (*plain, *whole) if w not in known]
        ids = self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
        known.update(zip(rest, (np.array(i.ids, self.kind).tobytes() for i in ids)))
        for word, core, tail in marked:
            known[word] = known[core] + known[tail]

    def _together(self, words: list[bytes], many: int = 256) -> dict[bytes, bytes]:
        """The ids of words, from texts of ``many`` of them; without those that do not come apart.

        Each word ends at least once, so as many ends as words mean one end for each.
        """
        found: dict[bytes, bytes] = {}
        groups = [words[a:a + many] for a in range(0, len(words), many)]
        texts = [b" ".join(group).decode() for group in groups]
        for group, text in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(text.ids, self.kind)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist()
            raw = ids.tobytes()
            if len(cuts) == len(group) and cuts[-1] == len(raw):
                found.update(zip(group, [raw[a:b] for a, b in zip([0, *cuts], cuts)]))
        return found


@sole
def word_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process, which goes on with what it has learned."""
    return WordEncoder(path)


def _lowered(text: str) -> bytes:
    """A text in UTF-8, with A-Z in lower case as in the vocabulary; marks of special tokens stay."""
    data = text.encode()
    return data if b"<|" in data else data.lower()


def _letters(word: bytes) -> bool:
    """Whether a word is letters alone, each of which stays one letter in lower case."""
    text = word.decode()
    return text.isalpha() and len(text.lower()) == len(text)


class Projector:
    """Hilbert keys of documents: hashed token counts, projected to a few dimensions."""

    def __init__(self, vocabulary: int, buckets: int = 256, dims: int = 3, bits: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bucket = rng.integers(0, buckets, vocabulary)
        self.sign = rng.choice([-1.0, 1.0], vocabulary)
        self.lines = rng.standard_normal((buckets, dims))
        self.buckets, self.dims, self.bits = buckets, dims, bits

    def keys(self, documents: list[np.ndarray]) -> np.ndarray:
        """The place of each document (token ids) on the curve."""
        vectors = np.zeros((len(documents), self.buckets))
        for row, ids in zip(vectors, documents):
            row += np.bincount(self.bucket[ids], self.sign[ids], self.buckets)
        vectors = np.sign(vectors) * np.sqrt(np.abs(vectors))
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        # Projections are close to normal, so this spreads them evenly over the cells.
        spread = 1 / (1 + np.exp(-1.702 * (vectors @ self.lines)))
        return hilbert_keys((spread * ((1 << self.bits) - 1)).astype(np.uint64), self.bits)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions of grid points (rows of ``bits``-bit coordinates) on the Hilbert curve.

    From the highest bit down, each coordinate reflects or swaps the lower bits of the first one;
    the Gray code of the transposed bits is then undone.
    """
    x = points.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    for bit in range(bits - 1, 0, -1):
        high, low = one << np.uint64(bit), (one << np.uint64(bit)) - one
        for i in range(n):
            turned = (x[i] & high) != 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] & (one << np.uint64(bit)), (one << np.uint64(bit)) - one, np.uint64(0))
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(bit)) & one)
    return key.astype(np.int64)


def tokenized(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text",
              end: int = 2) -> DataFrame:
    """(id, hilbert, n, ids) of every document, stored with a row number ``uid``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(batches: Batches):
        encoder = word_encoder(vocabulary)
        projector = Projector(encoder.tokenizer.get_vocab_size())
        for batch in slices(batches):
            ids = encoder.encode(batch.column(1).to_pylist(), end)
            arrays = [np.frombuffer(b, encoder.kind) for b in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(projector.keys([a[:-1] for a in arrays])),
                 pa.array([len(a) for a in arrays], pa.int64()), pa.array(ids, pa.binary())],
                ["id", "hilbert", "n", "ids"])

    held = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, hilbert bigint, n bigint, ids binary")
    held = held.withColumn("uid", F.monotonically_increasing_id())
    path = scratch_path(docs.sparkSession, "tokens")
    held.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(held.schema).parquet(path)


def along_curve(tokens: DataFrame, rows_per_part: int = 100_000) -> tuple[DataFrame, int]:
    """(uid, position) of every document in one stream along the curve, and its length.

    The keys alone are range-sorted; ties are broken by row number, so a group of equal documents
    is split over parts like any other. Parts are summed side by side, and only their totals
    (one row per part) are added up in order.
    """
    spark = tokens.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens.count() // rows_per_part + 1)
    dealt = pin(tokens.select("hilbert", "uid", "n").repartitionByRange(parts, "hilbert", "uid")
                .withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(F.sum("n").alias("total"))
    starts = totals.withColumn("begin", F.expr("sum(total) over (order by part) - total"))
    length = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    inside = F.expr("sum(n) over (partition by part order by hilbert, uid "
                    "rows between unbounded preceding and current row) - n")
    placed = dealt.withColumn("inside", inside).join(F.broadcast(starts), "part")
    return placed.select("uid", (F.col("begin") + F.col("inside")).alias("position")), int(length)


class Sequences:
    """The sequences of a stream: full ones, then a tail of powers of two, so nothing is padded."""

    def __init__(self, length: int, size: int):
        self.size, self.full = size, length // size * size
        self.begins, at = [], self.full
        for bit in range(size.bit_length() - 1, -1, -1):
            if (length - self.full) >> bit & 1:
                self.begins.append((at, 1 << bit))
                at += 1 << bit

    def at(self, position: int) -> tuple[int, int, int]:
        """(sequence, offset in it, tokens left in it) of a position."""
        if position < self.full:
            return position // self.size, position % self.size, self.size - position % self.size
        k = max(i for i, (begin, _) in enumerate(self.begins) if begin <= position)
        begin, width = self.begins[k]
        return self.full // self.size + k, position - begin, begin + width - position


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text",
         size: int = 4096, end: int = 2, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` tokens (``size`` a power of two).

    Documents lie in one stream in the order of their Hilbert keys, so neighbours on the curve
    share sequences; the stream is cut at every ``size`` tokens and its tail into powers of two.
    One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, hilbert,
    and ``ids`` unless left out. A document is its ids and ``end``; NULL and empty texts are
    ``end`` alone. Rows with equal or NULL ids stay documents of their own.
    """
    tokens = tokenized(docs, vocabulary, id_col, text, end)
    placed, length = along_curve(tokens)
    rows = tokens.join(placed, "uid").select("id", "hilbert", "ids", "position", "n")
    schema = PIECES.format(kind=dict(rows.dtypes)["id"]) + (", ids array<int>" if with_ids else "")

    def cut(batches: Batches):
        sequences = Sequences(length, size)
        for batch in slices(batches, 1024):
            names = batch.schema.names
            source, rows, ids = [], [], []
            blobs = batch.column(names.index("ids")).to_pylist()
            positions = batch.column(names.index("position")).to_pylist()
            counts = batch.column(names.index("n")).to_pylist()
            for k, (blob, position, n) in enumerate(zip(blobs, positions, counts)):
                whole = np.frombuffer(blob, f"<u{len(blob) // n}").astype("<u4")
                start = 0
                while start < len(whole):
                    sequence, offset, room = sequences.at(position + start)
                    part = whole[start:start + room]
                    source.append(k)
                    rows.append((start, len(part), zlib.crc32(part.tobytes()), len(whole), sequence, offset))
                    if with_ids:
                        ids.append(part.astype(np.int32))
                    start += len(part)
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 6
            take = pa.array(source, pa.int64())
            out = [batch.column(names.index("id")).take(take), *columns,
                   batch.column(names.index("hilbert")).take(take)]
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, ["id", "start", "length", "ids_crc32", "doc_tokens",
                                                   "sequence_id", "offset", "hilbert", "ids"][:len(out)])

    return rows.mapInArrow(cut, schema)
