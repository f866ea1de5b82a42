"""Vector codes: exact integer codebooks per part, learned over Hilbert-sorted flat blocks."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostwin.llm.common import Batches, attach
from hostwin.llm.packing import hilbert_keys
from hostwin.session import pin

BLOCKS = ("part int, n int, uids array<bigint>, points binary, lo array<bigint>, hi array<bigint>, "
          "sums array<bigint>")
#: Largest magnitude of an integer component whose squared distances stay exact in 64 bits.
LARGEST = 1 << 27


def usable(vector: str) -> Column:
    """Whether a vector has components and none of them is null or non-finite."""
    finite = F.forall(vector, lambda x: F.coalesce(
        F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(F.coalesce(x.cast("double"), F.lit(0.0))))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def integers(vectors: DataFrame, id_col: str, vector: str, label: str, scale: int) -> DataFrame:
    """(uid, id, label, ints) of the usable rows, stored: components as floor(scale * x)."""
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return pin(vectors.filter(usable(vector)).select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(label).alias("label"),
        ints.alias("ints")))


@dataclass
class Books:
    """One codebook per part: an integer matrix of entries x components."""

    parts: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position, comma-joined."""
        flat = ",".join(str(x) for book in self.parts for x in book.ravel().tolist())
        return hashlib.sha256(flat.encode()).hexdigest()


def first_books(rows: DataFrame, parts: int, entries: int) -> Books:
    """Codebooks of the rows with the smallest ids, ascending; repeated ids by their components."""
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()
    matrix = np.array([r.ints for r in seeds], dtype=np.int64)
    return Books([np.ascontiguousarray(m) for m in np.split(matrix, parts, axis=1)])


def cut_blocks(rows: DataFrame, parts: int, width: int, block_rows: int, bits: int = 7) -> DataFrame:
    """Flat blocks of ``block_rows`` parts that lie together on the Hilbert curve, stored.

    Every vector is cut into ``parts``; the rows of a part position are range-sorted by the Hilbert
    key of the part on a grid between the smallest and largest component of each place. A block
    keeps its rows, the box around them (``lo``, ``hi``), their count and componentwise sums.
    """
    size = width // parts
    edges = rows.agg(F.array(*[F.min(F.get("ints", i)) for i in range(width)]).alias("lo"),
                     F.array(*[F.max(F.get("ints", i)) for i in range(width)]).alias("hi")).first()
    low, high = np.array(edges.lo, dtype=np.int64), np.array(edges.hi, dtype=np.int64)
    if max(-low.min(), high.max()) > LARGEST:
        raise ValueError(f"components beyond {LARGEST} after scaling cannot be compared exactly")
    kind = np.dtype("<i2") if max(-low.min(), high.max()) < 1 << 15 else np.dtype("<i4")
    used = max(1, min(bits, 63 // size))

    def cut(batches: Batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = np.asarray(batch.column(1).flatten()).reshape(-1, width)
            cells = ((matrix - low) * ((1 << used) - 1) / np.maximum(high - low, 1)).astype(np.uint64)
            for p in range(parts):
                at = slice(p * size, (p + 1) * size)
                points = np.ascontiguousarray(matrix[:, at].astype(kind))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(points), p, np.int32)), pa.array(hilbert_keys(cells[:, at], used)),
                     batch.column(0), pa.array([row.tobytes() for row in points], pa.binary())],
                    ["part", "key", "uid", "point"])

    keyed = rows.select("uid", "ints").mapInArrow(cut, "part int, key bigint, uid bigint, point binary")
    # Equal keys are told apart by the row, so a range never has to hold all copies of one vector.
    spread = keyed.withColumn("tie", F.xxhash64("uid")).repartitionByRange("part", "key", "tie")
    ordered = spread.sortWithinPartitions("part", "key", "tie").select("part", "uid", "point")

    def pack(batches: Batches):
        held, part = [], None
        for batch in batches:
            column = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(column[1:] != column[:-1]) + 1).tolist(), len(column)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and (column[a] != part or sum(h.num_rows for h in held) >= block_rows * 64):
                    yield _blocks(held, part, size, kind, block_rows)
                    held = []
                part = int(column[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield _blocks(held, part, size, kind, block_rows)

    return pin(ordered.mapInArrow(pack, BLOCKS))


def _blocks(held: list[pa.RecordBatch], part: int, size: int, kind: np.dtype, block_rows: int) -> pa.RecordBatch:
    uids = np.concatenate([h.column(1).to_numpy() for h in held])
    points = np.frombuffer(b"".join(x for h in held for x in h.column(2).to_pylist()), kind).reshape(-1, size)
    starts = range(0, len(points), block_rows)
    each = [points[a:a + block_rows].astype(np.int64) for a in starts]
    return pa.RecordBatch.from_arrays(
        [pa.array([part] * len(each), pa.int32()), pa.array([len(e) for e in each], pa.int32()),
         pa.array([uids[a:a + block_rows] for a in starts], pa.list_(pa.int64())),
         pa.array([points[a:a + block_rows].tobytes() for a in starts], pa.binary()),
         *[pa.array([f(e) for e in each], pa.list_(pa.int64())) for f in (
             lambda e: e.min(axis=0), lambda e: e.max(axis=0), lambda e: e.sum(axis=0))]],
        ["part", "n", "uids", "points", "lo", "hi", "sums"])


def shortlists(book: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which entries (columns) can be the nearest of some point of each box (rows).

    An entry is out if even the nearest corner of the box is farther from it than the farthest
    corner is from some other entry. Entries that could tie stay.
    """
    below, above = lo[:, None, :] - book[None], book[None] - hi[:, None, :]
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=2)
    most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=2)
    return least <= most.min(axis=1, keepdims=True)


def nearest_entries(points: np.ndarray, book: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each point, in integers; ties go to the lower entry."""
    apart = points[:, None, :] - book[among][None]
    d2 = np.einsum("nkw,nkw->nk", apart, apart)
    at = d2.argmin(axis=1)
    return among[at], d2[np.arange(len(at)), at]


def _read(batch: pa.RecordBatch, books: list[np.ndarray]):
    """(row, part, its codebook, shortlist) of every block of a batch."""
    parts = batch.column(batch.schema.get_field_index("part")).to_numpy()
    lo, hi = (np.asarray(batch.column(batch.schema.get_field_index(c)).flatten()).reshape(len(parts), -1)
              for c in ("lo", "hi"))
    for part in np.unique(parts).tolist():
        rows = np.flatnonzero(parts == part)
        for row, able in zip(rows.tolist(), shortlists(books[part], lo[rows], hi[rows])):
            yield row, part, books[part], np.flatnonzero(able)


def _points(raw: bytes, size: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{len(raw) // (size * n)}").reshape(n, size).astype(np.int64)


def refine(blocks: DataFrame, books: Books) -> Books:
    """One round: every part goes to its nearest entry, which becomes floor(sum / count) of its parts.

    A block whose shortlist has one entry adds its stored sums without reading its rows. One row per
    part and entry reaches the driver.
    """
    sent = blocks.sparkSession.sparkContext.broadcast(books.parts)
    size = books.parts[0].shape[1]

    def assign(batches: Batches):
        own = sent.value
        sums = [np.zeros(b.shape, np.int64) for b in own]
        counts = [np.zeros(len(b), np.int64) for b in own]
        for batch in batches:
            if not batch.num_rows:
                continue
            column = dict(zip(batch.schema.names, batch.columns))
            totals = np.asarray(column["sums"].flatten()).reshape(batch.num_rows, size)
            for row, part, book, among in _read(batch, own):
                n = column["n"][row].as_py()
                if len(among) == 1:
                    sums[part][among[0]] += totals[row]
                    counts[part][among[0]] += n
                    continue
                points = _points(column["points"][row].as_py(), size, n)
                entry, _ = nearest_entries(points, book, among)
                for e in np.unique(entry):
                    chosen = points[entry == e]
                    sums[part][e] += chosen.sum(axis=0)
                    counts[part][e] += len(chosen)
        found = [(p, e) for p, c in enumerate(counts) for e in np.flatnonzero(c).tolist()]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in found], pa.int32()), pa.array([e for _, e in found], pa.int32()),
                 pa.array([int(counts[p][e]) for p, e in found], pa.int64()),
                 pa.array([sums[p][e] for p, e in found], pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    found = (blocks.select("part", "n", "points", "lo", "hi", "sums")
             .mapInArrow(assign, "part int, entry int, n bigint, sums array<bigint>").groupBy("part", "entry")
             .agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", i)) for i in range(size)]).alias("sums"))
             .collect())
    new = [b.copy() for b in books.parts]
    for r in found:
        new[r.part][r.entry] = [s // r.n for s in r.sums]
    return Books(new)


def encode(blocks: DataFrame, books: Books) -> DataFrame:
    """(uid, part, entry, error) of every part of every vector."""
    sent = blocks.sparkSession.sparkContext.broadcast(books.parts)
    size = books.parts[0].shape[1]

    def assign(batches: Batches):
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            for row, part, book, among in _read(batch, sent.value) if batch.num_rows else ():
                n = column["n"][row].as_py()
                entry, d2 = nearest_entries(_points(column["points"][row].as_py(), size, n), book, among)
                yield pa.RecordBatch.from_arrays(
                    [column["uids"][row].values, pa.array(np.full(n, part, np.int32)),
                     pa.array(entry.astype(np.int32)), pa.array(d2)], ["uid", "part", "entry", "error"])

    return blocks.select("part", "n", "uids", "points", "lo", "hi").mapInArrow(
        assign, "uid bigint, part int, entry int, error bigint")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
             block_rows: int = 128) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every usable vector.

    Components become floor(scale * x); vectors are cut into ``parts`` equal consecutive parts, each
    with a codebook of ``entries``. Codebooks start as the parts of the rows with the smallest ids
    and are refined in ``rounds``, all in integers, so that the result does not depend on the order
    of rows. Each round broadcasts the codebooks alone and reads one box per block before its rows.

    NULL and empty vectors and those with null or non-finite components have no row, nor have
    vectors of another length than most (ties: the longer). Rows with a repeated id stay separate
    rows, and start codebooks by their components; NULL ids come last. Fewer rows than ``entries`` give as many
    entries; a table without usable rows gives none. Rows without a label sum their errors together.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, id_col, vector, label, scale)
    widths = rows.groupBy(F.size("ints").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    schema = (f"id {dict(rows.dtypes)['id']}, code string, error bigint, label_error bigint, "
              "codebooks_sha256 string")
    if widths is None:
        return spark.createDataFrame([], schema)
    if widths.w % parts:
        raise ValueError(f"vectors of {widths.w} components cannot be cut into {parts} equal parts")
    rows = rows.filter(F.size("ints") == widths.w)
    blocks = cut_blocks(rows, parts, widths.w, block_rows)
    books = first_books(rows, parts, entries)
    for _ in range(rounds):
        refined = refine(blocks, books)
        settled = all(np.array_equal(a, b) for a, b in zip(books.parts, refined.parts))
        books = refined
        if settled:  # Further rounds would change nothing.
            break
    digits = F.transform(F.array_sort("found"), lambda x: F.lower(F.lpad(F.hex(x["entry"]), 2, "0")))
    own = rows.select("uid", "id", "label", F.lit(None).cast("struct<part:int,entry:int>").alias("at"),
                      F.lit(0).cast("bigint").alias("error"))
    coded = encode(blocks, books).select(
        "uid", F.lit(None).cast(dict(rows.dtypes)["id"]).alias("id"),
        F.lit(None).cast(dict(rows.dtypes)["label"]).alias("label"), F.struct("part", "entry").alias("at"), "error")
    # One shuffle brings the parts of a vector and its id and label together; the list has one entry a part.
    whole = pin(own.unionAll(coded).groupBy("uid").agg(
        F.first("id", True).alias("id"), F.struct(F.first("label", True).alias("label")).alias("label"),
        F.collect_list("at").alias("found"), F.sum("error").alias("error")).select(
        "uid", "id", "label", F.concat_ws("", digits).alias("code"), "error"))
    sums = pin(whole.groupBy("label").agg(F.sum("error").alias("label_error")))
    return attach(whole, sums, "label").select(
        "id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
