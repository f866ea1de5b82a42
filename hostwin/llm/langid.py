"""Language identification by words first, with a fall back to shorter and shorter n-grams."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostwin.llm.common import Batches, free_prefix, slices, sole
from hostwin.llm.warc import open_store
from hostwin.session import pin, scratch_path

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters; empty if the text holds no letter."""
    found = _WORD.findall((text or "").lower())
    if any(w.isalpha() for w in found) or any(c.isalpha() for w in found for c in w):
        return found
    return []


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word between blanks."""
    padded = f" {word} "
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


@dataclass(frozen=True)
class Model:
    """The place of a stored table (lang, size, term, n): how often a language has a term.

    ``size`` is 0 for words and their length for n-grams; ``term`` is the XXH64 of the text. The driver
    holds none of it, tasks read it (:func:`load`).
    """

    path: str
    longest: int

    @property
    def languages(self) -> list[str]:
        """The languages that are told apart, by name."""
        return load(self.path).languages


class Costs:
    """Costs (negative log10 of relative frequency) of terms per language, kept sparse.

    A term that a language lacks costs ten times the rarest one of its size, taken from the language that has most
    of them, so that a language with few texts gains nothing by what it does not know.
    """

    def __init__(self, langs: pa.Array, size: np.ndarray, term: np.ndarray, n: np.ndarray):
        self.languages = sorted(langs.unique().to_pylist())
        lang = pa.compute.index_in(langs, pa.array(self.languages, langs.type)).to_numpy(zero_copy_only=False)
        kinds = int(size.max()) + 1 if len(size) else 1
        totals = np.bincount(size * len(self.languages) + lang, n, kinds * len(self.languages))
        totals = totals.reshape(kinds, len(self.languages))
        self.lacking = np.log10(np.maximum(totals.max(axis=1, initial=1), 1)) + 1
        # Words and n-grams may be the same text, so the size is part of the key.
        order = np.lexsort((lang, term, size))
        self.term, self.lang = term[order], lang[order]
        self.saved = (-np.log10(n / totals[size, lang]) - self.lacking[size])[order].astype(np.float32)
        self.first = np.searchsorted(size[order], np.arange(kinds + 1))

    def rows(self, terms: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
        """(known, costs) of terms of one size; the costs of unknown ones mean nothing."""
        costs = np.zeros((len(terms), len(self.languages)), np.float32)
        if size >= len(self.lacking) or not terms:
            return np.zeros(len(terms), bool), costs
        costs += self.lacking[size]
        a, b = self.first[size], self.first[size + 1]
        keys = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 42) for t in terms],
                        np.uint64).view(np.int64)
        low = a + np.searchsorted(self.term[a:b], keys, "left")
        many = a + np.searchsorted(self.term[a:b], keys, "right") - low
        at = np.repeat(np.arange(len(terms)), many)
        found = np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(at))
        costs[at, self.lang[found]] += self.saved[found]
        return many > 0, costs


@lru_cache(maxsize=1)
def load(path: str) -> Costs:
    """The costs of a stored model for the driver; tasks have them in their scorer."""
    return read_costs(path)


def read_costs(path: str) -> Costs:
    """The costs of a stored model."""
    store, root = open_store(path)
    files = [f for f in store.get_file_info(pa.fs.FileSelector(root)) if f.path.endswith(".parquet")]
    parts = [pq.read_table(f.path, filesystem=store) for f in sorted(files, key=lambda f: f.path)]
    table = pa.concat_tables(parts).combine_chunks()
    whole = [table[c].to_numpy() for c in ("size", "term", "n")]
    langs = pa.concat_arrays(table["lang"].chunks) if table.num_rows else pa.array([], pa.string())
    return Costs(langs, whole[0].astype(np.int64), *whole[1:])


def held_out(id_col: str, parts: int = 4, part: int = 2) -> Column:
    """Whether the crc32 of an id as text has the remainder that is never learned from."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % parts == part, F.lit(False))


def learn(train: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id",
          docs_per_language: int = 6000, most_languages: int | None = None, words_per_language: int = 50_000,
          grams_per_language: int = 30_000, longest: int = 5) -> Model:
    """A model from labelled texts.

    Rows with a NULL text or language teach nothing. About ``docs_per_language`` documents of each
    language (or of the ``most_languages`` largest) are used, chosen by a hash of their
    id, and the most frequent words and n-grams of each are kept; these bounds and the number of
    languages are the size of the model, which is a stored table. The n-grams come from all words of the chosen
    documents, known words or not. No labelled rows give a model without languages.
    """
    spark = train.sparkSession
    usable = train.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(id_col).cast("string").alias("id"))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("docs"))
    if most_languages is not None:
        sizes = sizes.orderBy(F.desc("docs"), "lang").limit(most_languages)
    unit = F.pmod(F.xxhash64(F.lit("langid"), "id"), F.lit(1 << 40)) / float(1 << 40)
    # The planner sees the size of the stored counts and sends them to all tasks only while they are small.
    chosen = usable.join(pin(sizes), "lang").filter(unit < docs_per_language / F.col("docs")).select("lang", "text")
    counted = chosen.mapInArrow(_count_words, "lang string, word string, n bigint")
    counted = pin(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    pieces = (counted.select("lang", "n", F.concat(F.lit(" "), "word", F.lit(" ")).alias("padded"),
                             F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("size"))
              .filter(F.length("padded") >= F.col("size"))
              .select("lang", "n", F.explode(F.expr(
                  "transform(sequence(1, length(padded) - size + 1), i -> substring(padded, i, size))"))
                  .alias("word"))
              .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    path = scratch_path(spark, "languages")
    pin(_most_frequent(counted, words_per_language, F.lit(0)).unionAll(
        _most_frequent(pieces, grams_per_language, F.length("word"))), path)
    return Model(path, longest)


def _count_words(batches: Batches):
    counts: Counter = Counter()
    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word, n in Counter(words_of(text)).items():
                counts[lang, word] += n
        if len(counts) > 200_000:
            yield _counted(counts)
            counts = Counter()
    yield _counted(counts)


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()),
         pa.array(counts.values(), pa.int64())], ["lang", "word", "n"])


def _most_frequent(counts: DataFrame, most: int, size: Column) -> DataFrame:
    """The ``most`` most frequent words per language, as rows of a model."""
    # Dealing words over parts first keeps the ranking of a language out of a single task.
    part = F.pmod(F.xxhash64("word"), F.lit(32))
    narrowed = counts.withColumn("part", part).withColumn("place", F.expr(
        "row_number() over (partition by lang, part order by n desc, word)")).filter(F.col("place") <= most)
    return narrowed.withColumn("place", F.expr(
        "row_number() over (partition by lang order by n desc, word)")).filter(F.col("place") <= most).select(
        "lang", size.cast("int").alias("size"), F.xxhash64("word").alias("term"), "n")


class Scorer:
    """Costs of whole texts; costs of words are remembered up to a bound."""

    def __init__(self, costs: Costs, longest: int = 5, remembered: int = 400_000, evidence: int = 25):
        """``remembered`` counts words, of which there are fewer if they would have over 20 million costs."""
        self.model, self.longest, self.evidence = costs, longest, evidence
        self.remembered = max(1, min(remembered, 20_000_000 // max(1, len(costs.languages))))
        self.at: dict[str, int] = {}
        self.costs = np.empty((1024, len(costs.languages)), np.float32)

    def unseen(self, words: list[str]) -> np.ndarray:
        """For each word the mean cost of its longest n-grams that the model knows any of; 0 without."""
        costs = np.zeros((len(words), len(self.model.languages)), np.float32)
        left = range(len(words))
        for n in range(self.longest, 0, -1):
            terms, owners = [], []
            for i in left:
                if n <= len(words[i]) + 2:
                    own = grams(words[i], n)
                    terms += own
                    owners += [i] * len(own)
            known, found = self.model.rows(terms, n)
            at = np.array(owners, np.int64)[known]
            np.add.at(costs, at, found[known])
            many = np.bincount(at, minlength=len(words))
            costs[many > 0] /= many[many > 0, None]
            left = [i for i in left if not many[i]]
        return costs

    def rows_of(self, words: list[str]) -> list[int]:
        """Row numbers of the costs of words, of which there may be as many as are remembered."""
        rows = list(map(self.at.get, words))
        if None not in rows:
            return rows
        missing = {w for w, r in zip(words, rows) if r is None}
        if len(self.at) + len(missing) > self.remembered:
            self.at, missing = {}, set(words)
        new, start = sorted(missing), len(self.at)
        if start + len(new) > len(self.costs):
            more = np.empty((max(len(new), len(self.costs)), self.costs.shape[1]), np.float32)
            self.costs = np.concatenate([self.costs, more])
        for a in range(0, len(new), 4096):
            part = new[a:a + 4096]
            known, costs = self.model.rows(part, 0)
            costs[~known] = self.unseen([w for w, k in zip(part, known.tolist()) if not k])
            self.costs[start + a:start + a + len(part)] = costs
        self.at.update(zip(new, range(start, start + len(new))))
        return list(map(self.at.get, words))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the lowest mean cost per word; the score is its share of 1.

        Languages share 1 in proportion to 10 ** -(cost of the text), where a text longer than
        ``evidence`` words costs as much as so many of its mean words: words of a text are not
        independent, and a long one is not certain for its length. Ties go to the language that
        comes first by name. NULL, letters none or no model: ('und', 0).
        """
        words = words_of(text)
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.model.languages))
        step = self.remembered
        for a in range(0, len(words), step):
            rows = self.rows_of(words[a:a + step])  # first, as it may move the costs
            total += self.costs[rows].sum(axis=0, dtype=np.float64)
        mean = total / len(words)
        best = int(mean.argmin())
        weight = min(len(words), self.evidence)
        return self.model.languages[best], float(1 / (10 ** (weight * (mean[best] - mean))).sum())


@sole
def scorer_of(model: Model) -> Scorer:
    """The scorer of a model, which the tasks of a process share."""
    return Scorer(read_costs(model.path), model.longest)


def identify(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred",
             score: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its score, from the text alone.

    Every task reads the model, whose size the parameters of :func:`learn` bound for each language. Columns of
    ``docs`` with the names of the results are replaced. NULL texts and texts without letters are 'und'; repeated
    rows stay repeated rows; an empty table gives an empty one.
    """
    docs = docs.drop(lang, score)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Batches):
        scorer = None
        for batch in slices(batches):
            scorer = scorer or scorer_of(model)
            at = batch.schema.get_field_index(text)
            found = [scorer.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], [*batch.schema.names, lang, score])

    return docs.mapInArrow(run, f"{fields}, `{lang}` string, `{score}` double")


def identify_held_out(docs: DataFrame, id_col: str = "doc_id", **sizes) -> DataFrame:
    """(id, held_out, lang_pred, score) of every document; the held-out part teaches nothing."""
    flag = docs.withColumn("_held", held_out(id_col))
    model = learn(flag.filter(F.col(id_col).isNotNull() & ~F.col("_held")), id_col=id_col, **sizes)
    rows = docs.select(F.col(id_col).alias("id"), F.col("text"))
    told = identify(rows, model)
    return told.select("id", held_out("id").alias("held_out"), "lang_pred",
                       F.col("lang_score").alias("score"))


def keep_identified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """The documents whose language is recognised with a score of at least ``least``, with their columns.

    NULL texts, texts without letters and, without any labelled row, all texts go. Repeated rows and rows with a
    NULL id stay or go like any other; an empty table stays empty.
    """
    lang, score = (free_prefix(docs) + name for name in ("lang", "score"))
    told = identify(docs, learn(docs, id_col=id_col), lang=lang, score=score)
    return told.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).drop(lang, score)
