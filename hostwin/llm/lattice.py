"""Language-model scores: all segmentations of a text into the pieces of a given vocabulary."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostwin.llm.common import Batches, slices
from hostwin.session import pin

START = "▁"


def split_words(text: str | None) -> list[bytes]:
    """Words between blanks, tabs and line ends, with A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


@lru_cache(maxsize=2)
def processor(path: str):
    """The tokenizer of a vocabulary file."""
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def parts(path: str) -> dict[str, int]:
    """Numbers of a vocabulary's pieces, and -1 for beginnings of pieces, where a search goes on."""
    model = processor(path)
    known: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        known[piece] = i
        for n in range(1, len(piece)):
            known.setdefault(piece[:n], -1)
    return known


@dataclass
class Pieces:
    """Natural-log probabilities of a vocabulary's pieces and of the end of a text.

    ``path`` names the vocabulary and ``weights`` are the log probabilities by number of piece.
    """

    path: str
    weights: np.ndarray
    byte_costs: list[float]
    end: float

    @cached_property
    def costs(self) -> dict[str, float | None]:
        """Log probabilities by piece; the beginnings of pieces have None."""
        return {part: None if i < 0 else float(self.weights[i]) for part, i in parts(self.path).items()}


def prior(path: str) -> np.ndarray:
    """Probabilities of the pieces by the vocabulary's own scores.

    A score that is not positive and falls by 1 per place is a rank and weighs as 1 / (rank + 10);
    other scores are log probabilities already.
    """
    model = processor(path)
    scores = np.array([model.get_score(i) for i in range(model.get_piece_size())])
    ranked = scores.min() < -1000
    weight = 1 / (10 - scores) if ranked else np.exp(scores)
    return weight / weight.sum()


def weigh_pieces(path: str, counts: np.ndarray, ends: int, strength: float = 1000.0) -> Pieces:
    """Piece probabilities from the vocabulary's scores and the counts of the training words.

    The scores count as ``strength`` pieces; without training words they stand alone. A word ends
    where the next piece begins one, so ``ends`` (the words counted) is the weight of the end of
    a text, and counts once more than it was seen.
    """
    model = processor(path)
    mass = counts + strength * prior(path)
    total = mass.sum() + ends + 1
    weights = np.full(len(mass), -math.inf)
    byte_costs = [math.log(1e-9)] * 256
    for i, weight in enumerate(mass.tolist()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        weights[i] = math.log(weight / total)
        if model.is_byte(i):
            byte_costs[int(model.id_to_piece(i)[3:5], 16)] = float(weights[i])
    return Pieces(path, weights, byte_costs, math.log((ends + 1) / total))


def edges_of(word: str, known: dict[str, int]) -> np.ndarray:
    """The edges of a word's lattice: every piece at every place of the word with its start mark.

    One number per edge: its length in the low 8 bits, then a bit for a character that has no piece
    and is spelt in bytes, then the piece or the character. Edges are in order of their beginnings;
    each place begins with the one edge of length 1.
    """
    text = START + word
    n = len(text)
    out = []
    for i in range(n):
        for j in range(i + 1, n + 1):
            number = known.get(text[i:j])
            if number is not None and number >= 0:
                out.append(number << 9 | j - i)
            elif j == i + 1:
                out.append(ord(text[i]) << 9 | 1 << 8 | 1)
            if number is None:
                break
    return np.array(out, dtype="<u4")


class Lattices:
    """The lattices of many words; a step of a recursion is taken for all of them at once."""

    def __init__(self, edges: list[np.ndarray]) -> None:
        flat = np.concatenate([*edges, np.empty(0, "<u4")]).astype(np.int64)
        length = flat & 255
        self.spelt, self.number = (flat >> 8 & 1).astype(bool), flat >> 9
        self.word = np.repeat(np.arange(len(edges)), [len(e) for e in edges])
        first = length == 1
        sizes = np.bincount(self.word[first], minlength=len(edges))
        # Node of each word's first place; a word of n places has n + 1 nodes.
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1].astype(np.int64)
        self.ends = self.starts + sizes
        place = np.cumsum(first) - 1 - (self.starts - np.arange(len(edges)))[self.word]
        self.source = self.starts[self.word] + place
        self.target = self.source + length
        self.depth, self.height = place + length, sizes[self.word] - place

    def costs(self, pieces: Pieces) -> np.ndarray:
        """The log probability of every edge."""
        out = pieces.weights[np.where(self.spelt, 0, self.number)]
        if self.spelt.any():
            characters, at = np.unique(self.number[self.spelt], return_inverse=True)
            out[self.spelt] = np.array([sum(pieces.byte_costs[b] for b in chr(c).encode("utf-8", "surrogatepass"))
                                        for c in characters.tolist()])[at]
        return out

    def _sweep(self, costs: np.ndarray, begin: np.ndarray, source: np.ndarray, target: np.ndarray,
               step: np.ndarray) -> np.ndarray:
        """Log sums over all ways from ``begin`` to each node, by rising ``step`` of the edges."""
        total = np.full(int(self.ends[-1]) + 1 if len(self.ends) else 0, -math.inf)
        total[begin] = 0.0
        order = np.lexsort((target, step))
        source, target, costs = source[order], target[order], costs[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(step[order])) + 1, [len(order)]]).tolist()
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            into, value = target[a:b], total[source[a:b]] + costs[a:b]
            runs = np.flatnonzero(np.concatenate([[True], into[1:] != into[:-1]]))
            most = np.maximum.reduceat(value, runs)
            widths = np.diff(np.concatenate([runs, [b - a]]))
            total[into[runs]] = most + np.log(np.add.reduceat(np.exp(value - np.repeat(most, widths)), runs))
        return total

    def forward(self, costs: np.ndarray) -> np.ndarray:
        """Log probability of reaching each node, over all segmentations."""
        return self._sweep(costs, self.starts, self.source, self.target, self.depth)

    def log_probs(self, pieces: Pieces) -> np.ndarray:
        """Natural log of the probability of each word."""
        return self.forward(self.costs(pieces))[self.ends]

    def shares(self, pieces: Pieces, weights: np.ndarray) -> np.ndarray:
        """Expected number of times that each edge is used, for ``weights`` of each word."""
        costs = self.costs(pieces)
        ahead = self.forward(costs)
        back = self._sweep(costs, self.ends, self.target, self.source, self.height)
        return weights[self.word] * np.exp(
            ahead[self.source] + costs + back[self.target] - ahead[self.ends][self.word])


def single(word: str, pieces: Pieces) -> list[tuple[int, int, float, int, bool]]:
    """(from, to, log probability, piece or character, spelt) of the edges of one word."""
    out, i = [], -1
    for edge in edges_of(word, parts(pieces.path)).tolist():
        length, spelt, number = edge & 255, bool(edge >> 8 & 1), edge >> 9
        i += length == 1
        cost = (sum(pieces.byte_costs[b] for b in chr(number).encode("utf-8", "surrogatepass")) if spelt
                else float(pieces.weights[number]))
        out.append((i, i + length, cost, number, spelt))
    return out


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _ahead(edges: list) -> list[float]:
    forward = [0.0] + [-math.inf] * edges[-1][1]
    for i, j, cost, *_ in edges:
        forward[j] = _add(forward[j], forward[i] + cost)
    return forward


def word_log_prob(word: str, pieces: Pieces) -> float:
    """Natural log of the probability of one word: the sum over all its segmentations.

    A forward recursion in log space over the word with its start mark. A character without a
    piece of its own is spelt in bytes. :class:`Lattices` does the same for many words.
    """
    return _ahead(single(word, pieces))[-1]


def count_pieces(word: str, pieces: Pieces, weight: float, counts: dict[str, float]) -> None:
    """Add to ``counts`` how often each piece is expected over all segmentations of one word.

    Segmentations weigh by their probability (forward and backward recursion); ``weight`` is
    the number of such words. Bytes count as pieces of their own, written as <0x41>.
    """
    edges, model = single(word, pieces), processor(pieces.path)
    forward = _ahead(edges)
    backward = [-math.inf] * edges[-1][1] + [0.0]
    for i, j, cost, *_ in reversed(edges):
        backward[i] = _add(backward[i], backward[j] + cost)
    for i, j, cost, number, spelt in edges:
        share = weight * math.exp(forward[i] + cost + backward[j] - forward[-1])
        for name in [f"<0x{b:02X}>" for b in chr(number).encode("utf-8", "surrogatepass")] if spelt else [
                model.id_to_piece(number)]:
            counts[name] = counts.get(name, 0.0) + share


def expected(found: Lattices, pieces: Pieces, weights: np.ndarray) -> np.ndarray:
    """Expected counts by number of piece, of words that occur ``weights`` times."""
    model = processor(pieces.path)
    share = found.shares(pieces, weights)
    counts = np.bincount(found.number[~found.spelt], share[~found.spelt], model.get_piece_size())
    characters, at = np.unique(found.number[found.spelt], return_inverse=True)
    for c, n in zip(characters.tolist(), np.bincount(at, share[found.spelt], len(characters)).tolist()):
        for b in chr(c).encode("utf-8", "surrogatepass"):
            number = model.piece_to_id(f"<0x{b:02X}>")
            if not model.is_unknown(number):
                counts[number] += n
    return counts


def stored_lattices(batches: Batches, at: int):
    """(batch, lattices) of bounded numbers of words, from their stored edges in column ``at``."""
    for batch in slices(batches, 4096):
        yield batch, Lattices([np.frombuffer(e, "<u4") for e in batch.column(at).to_pylist()])


def refit(counted: DataFrame, vocabulary: str, ends: int, strength: float, rounds: int = 2) -> Pieces:
    """Piece probabilities refitted to expected counts over all segmentations of the training words.

    ``counted`` has (c, edges) of each word. The first round weighs segmentations by the vocabulary's scores alone. A word counts as
    often as it occurs, ``ends`` is the number of training texts, and the scores count as
    ``strength`` pieces. Only one sum per piece reaches the driver.
    """
    model = processor(vocabulary)
    counts = np.zeros(model.get_piece_size())
    pieces = weigh_pieces(vocabulary, counts, ends if not rounds else 0, strength)
    for _ in range(rounds):
        sent = counted.sparkSession.sparkContext.broadcast(pieces)

        def expect(batches: Batches, sent=sent):
            sums = np.zeros(len(sent.value.weights))
            for batch, found in stored_lattices(batches, 1):
                sums += expected(found, sent.value, batch.column(0).to_numpy().astype(float))
            seen = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[seen])], ["piece", "n"])

        found = (counted.filter("c > 0").select("c", "edges").mapInArrow(expect, "piece bigint, n double")
                 .groupBy("piece").agg(F.sum("n").alias("n")).toPandas())
        counts = np.zeros(model.get_piece_size())
        counts[found["piece"].to_numpy(np.int64)] = found["n"]
        pieces = weigh_pieces(vocabulary, counts, ends, strength)
    return pieces


def held_out(id_col: str, parts: int = 7, part: int = 2) -> Column:
    """Whether the crc32 of an id as text has the remainder that is kept for testing."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % parts == part, F.lit(False))


@dataclass
class LatticeModel:
    """``words`` (word, c, lattice, marginal): every word of the corpus with its count in the
    training texts and, as natural logs, its lattice probabilities by ``pieces`` (for words that
    are new) and by ``refitted``; totals of training tokens and kinds."""

    words: DataFrame
    tokens: int
    kinds: int
    ends: int
    pieces: Pieces
    refitted: Pieces


def learn(docs: DataFrame, vocabulary: str, text: str = "text", learned: str = "learned",
          strength: float = 1000.0) -> LatticeModel:
    """Count the words of all texts and weigh the pieces of a given vocabulary.

    Only rows whose ``learned`` is true count; words of the others enter with count 0, so that
    each distinct word is scored once. Pieces are counted in the vocabulary's own segmentation of
    each distinct training word. A word counts once however frequent it is, as the lattice is
    there for words that are new; only the totals (one per piece) reach the driver. NULL texts
    are empty texts.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(learned).alias("learned"))
    words = rows.mapInArrow(_count_words, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))

    def cut(batches: Batches):
        known = parts(vocabulary)
        for batch in slices(batches, 4096):
            edges = [edges_of(w, known).tobytes() for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edges, pa.binary())], ["word", "c", "edges"])

    # The lattice of a word is the same in every round, so it is built once.
    counted = pin(words.mapInArrow(cut, "word string, c bigint, edges binary"))
    ends = rows.filter("learned").count()
    total = counted.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    def segment(batches: Batches):
        model = processor(vocabulary)
        sums = np.zeros(model.get_piece_size(), dtype=np.int64)
        for batch in slices(batches, 4096):
            ids = model.encode(batch.column(0).to_pylist(), num_threads=1)
            flat = np.fromiter((i for word in ids for i in word), np.int64)
            sums += np.bincount(flat, minlength=len(sums))
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[seen])], ["piece", "n"])

    found = (counted.filter("c > 0").select("word").mapInArrow(segment, "piece bigint, n bigint")
             .groupBy("piece").agg(F.sum("n").alias("n")).toPandas())
    counts = np.zeros(processor(vocabulary).get_piece_size())
    counts[found["piece"].to_numpy(np.int64)] = found["n"]
    pieces = weigh_pieces(vocabulary, counts, int(total[1]), strength)
    refitted = refit(counted, vocabulary, ends, strength)
    sent = docs.sparkSession.sparkContext.broadcast((pieces, refitted))

    def weigh(batches: Batches):
        for batch, found in stored_lattices(batches, 2):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *[pa.array(found.log_probs(own)) for own in sent.value]],
                ["word", "c", "lattice", "marginal"])

    words = pin(counted.mapInArrow(weigh, "word string, c bigint, lattice double, marginal double"))
    return LatticeModel(words, int(total[0]) + ends, int(total[1]) + (ends > 0), ends, pieces, refitted)


def _count_words(batches: Batches):
    counts: Counter = Counter()
    others: set[bytes] = set()
    for batch in slices(batches):
        for text, learned in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if learned:
                counts.update(split_words(text))
            else:
                others.update(split_words(text))
        if len(counts) + len(others) > 400_000:
            yield _counted(counts, others)
            counts, others = Counter(), set()
    yield _counted(counts, others)


def _counted(counts: Counter, others: set[bytes]) -> pa.RecordBatch:
    new = [w for w in others if w not in counts]
    words = pa.array([*counts, *new], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [words, pa.array([*counts.values(), *[0] * len(new)], pa.int64())], ["word", "c"])


def rarest(words: DataFrame, head: int) -> int:
    """The smallest count, of at least 2, that at most ``head`` words reach.

    Counts are looked at in steps of an eighth of a doubling, a bounded number of which the driver fetches.
    """
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = words.filter("c > 1").groupBy(step.alias("step")).agg(
        F.count("*").alias("n"), F.min("c").alias("least")).collect()
    least, total = (1 << 63) - 1, 0
    for r in sorted(sizes, key=lambda r: -r.step):
        total += r.n
        if total > head:
            break
        least = r.least
    return least


def score_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text",
                    head: int = 65_536) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score) of every document.

    ``lattice_score`` is the marginal probability of the text over all segmentations of all its
    words, known or new, by the pieces of :func:`refit`. ``score`` mixes word counts with the
    lattice: The probability of a word is its count over the training tokens, plus the mass of new words
    (kinds + 1 of tokens + kinds + 1) times its lattice probability; a text is the product of its
    words and an end. Scores are log10; ``base_score`` adds 1 to every count instead.

    At most ``head`` of the most frequent words are sent to all tasks and settled where the text is read.
    The others, however many, are joined by shuffle; they are rare, so no key is hot. NULL texts
    are empty texts: one end. A NULL id belongs to the training part.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"),
                       held_out(id_col).alias("held_out"))
    model = learn(rows.withColumn("learned", ~F.col("held_out")), vocabulary)
    tokens, kinds = model.tokens, model.kinds
    new = (kinds + 1) / (tokens + kinds + 1)
    frequent = model.words.filter(F.col("c") >= rarest(model.words, head)).toPandas()
    c = frequent["c"].to_numpy(float)
    known = {w.encode(): i for i, w in enumerate(frequent["word"])}
    base = np.log10((c + 1) / (tokens + kinds + 1))
    score = np.log10(c / (tokens + kinds + 1) + new * np.exp(frequent["lattice"].to_numpy(float)))
    marginal = frequent["marginal"].to_numpy(float) / math.log(10)
    end_marginal = model.refitted.end / math.log(10)
    sent = docs.sparkSession.sparkContext.broadcast((known, base, score, marginal))
    end_base = math.log10((model.ends + 1) / (tokens + kinds + 1))
    end_score = math.log10(model.ends / (tokens + kinds + 1) + new * math.exp(model.pieces.end))
    end_known = int(model.ends > 0)

    def settle(batches: Batches):
        known, base, score, marginal = sent.value
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for words in map(split_words, batch.column(1).to_pylist()):
                places = [known.get(w) for w in words]
                at = np.array([p for p in places if p is not None], dtype=np.int64)
                rest = Counter(w for w, p in zip(words, places) if p is None)
                for column, value in zip(out, (
                        len(words) + 1, len(at) + end_known, float(base[at].sum()) + end_base,
                        float(score[at].sum()) + end_score, float(marginal[at].sum()) + end_marginal, rest)):
                    column.append(value)
            starts = np.cumsum([0, *map(len, out[5])])
            rest = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(
                [pa.array([w for r in out[5] for w in r], pa.binary()).cast(pa.string()),
                 pa.array([n for r in out[5] for n in r.values()], pa.int64())], ["word", "n"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *[pa.array(v, pa.int64()) for v in out[:2]],
                 *[pa.array(v, pa.float64()) for v in out[2:5]], rest],
                ["id", "held_out", "n_tokens", "n_known", "base", "score", "marginal", "rest"])

    settled = pin(rows.mapInArrow(settle, (
        f"id {dict(rows.dtypes)['id']}, held_out boolean, n_tokens bigint, n_known bigint, "
        "base double, score double, marginal double, rest array<struct<word:string,n:bigint>>"))
        .withColumn("uid", F.monotonically_increasing_id()))
    rare = (settled.select("uid", F.explode("rest").alias("r")).select("uid", "r.word", "r.n")
            .join(model.words, "word"))
    whole = float(tokens + kinds + 1)
    probability = F.col("c") / F.lit(whole) + F.lit(new) * F.exp("lattice")
    # Beyond the range of doubles the log of the lattice itself is used.
    log_probability = F.when(probability > 1e-290, F.log10(probability)).otherwise(
        F.lit(math.log10(new)) + F.col("lattice") / math.log(10))
    sums = rare.groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10((F.col("c") + 1) / F.lit(whole))).alias("more_base"),
        F.sum(F.col("n") * log_probability).alias("more_score"),
        F.sum(F.col("n") * F.col("marginal") / math.log(10)).alias("more_marginal"))
    zero = F.lit(0)
    return settled.drop("rest").join(sums, "uid", "left").select(
        "id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", zero)).cast("bigint").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
        (F.col("marginal") + F.coalesce("more_marginal", F.lit(0.0))).alias("lattice_score"))

