"""Secrets in texts: fixed patterns, and strings that pass a battery of randomness tests."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostwin.llm.common import Batches, slices
from hostwin.session import pin

KINDS = ["assign", "access", "hex", "random"]
BASE = KINDS[:3]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")

#: Alphabets by symbol order, smallest first; a string belongs to the first that holds it.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
SHORTEST = 16
#: Length classes begin at these lengths; discoveries are controlled in each on its own.
CLASSES = [16, 20, 24, 32, 40, 48, 64, 128]
BINS = 64
#: A text gives one decoy of each length class, and another for each of these many letters.
DECOY_STEP = 4096
_SYMBOLS = [(set(a), {c: i for i, c in enumerate(a)}) for a in ENCODINGS.values()]
_KINDS_OF = [np.unique([c.isdigit() + 2 * c.islower() + 4 * c.isupper() for c in a], return_inverse=True)[1]
             for a in ENCODINGS.values()]
_PART = re.compile(r"[0-9A-Za-z]+")
#: Dashed groups: parts of one small alphabet, or of any letters and digits, joined by single dashes.
_GROUPS = [re.compile(rf"(?<![0-9A-Za-z]){p}(?:-{p})+(?![0-9A-Za-z])")
           for p in ("[0-9a-f]+", "[0-9A-F]+", "[0-9A-Za-z]+")]
_LETTERS = bytes(i for i in range(256) if not chr(i).isascii() or not chr(i).isalpha())
_RUN = bytes(120 if chr(i) in ENCODINGS["base64"] + "-_" else 32 for i in range(256))
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    found: list[Span] = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    for start, end in long_runs(text):  # every hex run of 24 lies in one of these
        found += [("hex", *m.span()) for m in _HEX.finditer(text, start, end) if len(m[0]) >= 24]
    return found


def long_runs(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of at least SHORTEST letters, digits and ``+/-_`` of ASCII."""
    mask = text.encode("latin-1", "replace").translate(_RUN)  # one byte per character
    start = mask.find(b"x" * SHORTEST)
    while start >= 0:
        end = mask.find(b" ", start)
        end = len(mask) if end < 0 else end
        yield start, end
        start = mask.find(b"x" * SHORTEST, end)


def encoding_of(value: str) -> int | None:
    """Number of the smallest alphabet that holds a string; None for digits alone."""
    symbols = set(value)
    if symbols <= set("0123456789"):
        return None
    return next((i for i, (own, _) in enumerate(_SYMBOLS) if symbols <= own), None)


def randomness(value: str) -> float | None:
    """How well a string agrees with random symbols of its inferred encoding, from 0 to 1.

    Three p-values are combined by Fisher's method: the chi-squared test of equal symbol counts
    (the smaller p of single symbols and of digits, capitals, small letters and marks, twice),
    the runs test about the middle of the alphabet, and the lag-1 serial correlation. None if no
    encoding or digits alone.
    """
    number = encoding_of(value)
    if number is None:
        return None
    place = _SYMBOLS[number][1]
    v = np.array([place[c] for c in value])
    n, k = len(v), len(place)
    counts = np.bincount(v, minlength=k)
    fine = _chi_tail(counts, np.full(k, n / k))
    kinds = _KINDS_OF[number]
    coarse = _chi_tail(np.bincount(kinds, counts), np.bincount(kinds) * n / k)
    p1 = min(1.0, 2 * min(fine, coarse))
    high = v >= k / 2
    n1 = int(high.sum())
    n2 = n - n1
    if n1 == 0 or n2 == 0:
        p2 = 2.0 ** (1 - n)
    else:
        mean = 2 * n1 * n2 / n + 1
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        p2 = 2 * _upper(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / spread)
    centred = v - v.mean()
    power = float(centred @ centred)
    r = float(centred[1:] @ centred[:-1]) / power if power else 1.0
    p3 = 2 * _upper(abs(r + 1 / n) * math.sqrt(n))
    x = -2 * sum(math.log(min(max(p, 1e-300), 1.0)) for p in (p1, p2, p3)) / 2
    return math.exp(-x) * (1 + x + x * x / 2)


def _chi_tail(counts: np.ndarray, expected: np.ndarray) -> float:
    """P-value of Pearson's statistic, by a normal with its exact mean and variance.

    Counts may be small: the variance has the term for few observations.
    """
    n, k = float(counts.sum()), len(counts)
    if k == 1:
        return 1.0
    share = expected / n
    chi = float(((counts - expected) ** 2 / expected).sum())
    variance = 2 * (k - 1) + (float((1 / share).sum()) - k * k - 2 * (k - 1)) / n
    return _upper((chi - (k - 1)) / math.sqrt(max(variance, 1e-9)))


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def length_class(n: int) -> int:
    """Number of the length class of a string."""
    return sum(n >= edge for edge in CLASSES) - 1


def bin_of(p: float) -> int:
    """Quarter powers of ten of a p-value, 0 for the most random strings."""
    return min(BINS - 1, int(-4 * math.log10(max(p, 1e-300))))


def hypotheses(text: str, start: int, end: int) -> set[tuple[int, int, str]]:
    """(start, end, symbols) of the strings in a run that may be secrets, each with SHORTEST symbols or more.

    These are the whole run, its parts between the marks ``+/-_``, and dashed groups, whose dashes
    are no symbols. So a key behind a prefix, in a path or in groups is tested under its own encoding.
    """
    found = {(start, end, text[start:end])}
    found |= {(*m.span(), m[0]) for m in _PART.finditer(text, start, end)}
    for group in _GROUPS:
        found |= {(*m.span(), m[0].replace("-", "")) for m in group.finditer(text, start, end)}
    return {h for h in found if len(h[2]) >= SHORTEST}


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, bin) of the :func:`hypotheses` that have an encoding."""
    found = []
    for run in long_runs(text):
        for start, end, symbols in sorted(hypotheses(text, *run)):
            p = randomness(symbols)
            if p is not None:
                found.append((start, end, length_class(len(symbols)), bin_of(p)))
    return found


def ordinary(text: str) -> str:
    """All letters of a text, those of other scripts as a-z by their code point, so that every script has some."""
    if text.isascii():
        return text.encode().translate(None, _LETTERS).decode()
    return "".join(c if c.isascii() else chr(97 + ord(c) % 26) for c in text if c.isalpha())


def decoys(text: str, lengths: list[int]) -> list[tuple[int, int]]:
    """(length class, bin) of ordinary strings: letters of the text itself, of given lengths.

    Each is cut from a place of the whole text given by a hash of the text; a text with fewer letters has none.
    """
    found, letters = [], ordinary(text)
    seed = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    for i, n in enumerate([*CLASSES * (1 + len(letters) // DECOY_STEP), *lengths]):
        if len(letters) >= n:
            at = (seed + 7919 * i) % (len(letters) - n + 1)
            p = randomness(letters[at:at + n])
            if p is not None:
                found.append((length_class(n), bin_of(p)))
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, base, found, decoys) of every text; NULL texts are empty.

    Each text gives decoys of every length class and one more per candidate, of the least length of its class.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(batches: Batches):
        for batch in slices(batches):
            base, found, fake = [], [], []
            for t in batch.column(1).to_pylist():
                t = t or ""
                base.append([{"kind": BASE.index(k), "start": a, "end": b} for k, a, b in base_spans(t)])
                own = candidates(t)
                found.append([dict(zip(("start", "end", "cls", "bin"), c)) for c in own])
                fake.append([{"cls": c, "bin": b} for c, b in decoys(t, [CLASSES[cls] for _, _, cls, _ in own])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v, _list(*names)) for v, names in (
                    (base, ("kind", "start", "end")), (found, ("start", "end", "cls", "bin")),
                    (fake, ("cls", "bin")))]], ["id", "base", "found", "decoys"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, "
                           "base array<struct<kind:int,start:int,end:int>>, "
                           "found array<struct<start:int,end:int,cls:int,bin:int>>, "
                           "decoys array<struct<cls:int,bin:int>>")


def _list(*names: str) -> pa.DataType:
    return pa.list_(pa.struct([(n, pa.int32()) for n in names]))


def thresholds(scanned: DataFrame, rate: float = 0.05, least_p: float = 0.001) -> list[int]:
    """The highest accepted bin of each length class, -1 where none is.

    The p-value of a candidate is the share of decoys of its length class that look at least as
    random (each class with one more, so it is never 0). The rule of Benjamini and Hochberg then
    accepts candidates of the class at a false discovery rate of at most ``rate``; every hypothesis
    about a run counts, and those about the same run depend on each other positively, as the rule allows. Only strings
    that the battery itself does not reject at ``least_p`` are accepted. The counts per class
    and bin, bounded by their number, are all that reaches the driver.
    """
    counts = np.zeros((2, len(CLASSES), BINS))
    for name, row in (("found", 0), ("decoys", 1)):
        for cls, bin_, n in (scanned.select(F.explode(name).alias("c")).groupBy("c.cls", "c.bin")
                             .count().toPandas().itertuples(index=False)):
            counts[row, cls, bin_] += n
    below = counts.cumsum(axis=2)
    p = (1 + below[1]) / (1 + below[1][:, -1:])
    passed = p <= rate * below[0] / np.maximum(below[0][:, -1:], 1)
    passed[:, bin_of(least_p) + 1:] = False
    passed &= below[0] > 0
    return [int(np.flatnonzero(row).max()) if row.any() else -1 for row in passed]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                 rate: float = 0.05) -> DataFrame:
    """(id, spans) of every document: spans are (start, kind, end) by start, kind as in KINDS.

    Starts and ends count characters, ends excluded. A random string that overlaps a span of a
    fixed pattern is left to that, and one inside another random string to the longer. NULL and empty
    texts have no spans, repeated rows the same ones, and an empty table gives no rows.
    """
    scanned = pin(scan(docs, id_col, text))
    limit = F.array(*[F.lit(b) for b in thresholds(scanned, rate)])
    clear = F.filter("found", lambda c: (c["bin"] <= limit[c["cls"]]) & ~F.exists(
        "base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    # A run of hypotheses overlaps only itself, so the lists are short.
    outer = F.filter("clear", lambda c: ~F.exists("clear", lambda d: (d["start"] <= c["start"]) & (
        d["end"] >= c["end"]) & (d["end"] - d["start"] > c["end"] - c["start"])))
    random = F.transform(outer, lambda c: F.struct(
        c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")))
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"),
                                                  b["end"].alias("end")))
    # Two hypotheses may agree on a span, with and without its dashes.
    return scanned.withColumn("clear", clear).select(
        "id", F.array_sort(F.concat(base, F.array_distinct(random))).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars", mark: str = "[secret]",
           rate: float = 0.05) -> DataFrame:
    """``docs`` with every secret replaced by ``mark``, and ``length`` counted anew where it was.

    Thresholds come from a first pass over all texts; the second finds the spans again and
    replaces them, so texts are never shuffled. Overlapping spans become one mark. Rows without
    secrets, NULL and empty texts stay as they are, repeated rows are treated alike, and an empty table stays empty.
    """
    limits = thresholds(pin(scan(docs.select(F.lit(None).cast("int").alias("_none"), text), "_none", text)), rate)
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Batches):
        for batch in slices(batches):
            texts = batch.column(names.index(text)).to_pylist()
            clean = [t and replaced(t, limits, mark) for t in texts]
            columns = list(batch.columns)
            columns[names.index(text)] = pa.array(clean, batch.schema.field(text).type)
            if length in names:
                old = columns[names.index(length)]
                columns[names.index(length)] = pa.array(
                    [o if a == b else len(b) for o, a, b in zip(old.to_pylist(), texts, clean)], old.type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, fields)


def replaced(text: str, limits: list[int], mark: str) -> str:
    """A text with its secrets replaced."""
    spans = sorted([(a, b) for _, a, b in base_spans(text)]
                   + [(a, b) for a, b, cls, bin_ in candidates(text) if bin_ <= limits[cls]])
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
