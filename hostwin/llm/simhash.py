"""SimHash near-duplicates: fingerprints of word shingles, searched in BK-trees."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostwin.llm.common import Batches, attach, chunk_pairs, free_prefix, map_runs, slices, with_uid
from hostwin.llm.components import connected_components
from hostwin.session import pin, scratch_path, scratch_scope

BITS = 64


def shingle_hashes(text: str | None, width: int = 4, seed: int = 42) -> np.ndarray:
    """64-bit hashes of the ``width``-word shingles of a text, repeats included.

    A-Z are lower-cased; words are split at blanks, tabs and line ends. Fewer words than
    ``width`` are one shingle; no words (empty or NULL text) give none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    whole, width = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], seed) for a, b in
                     zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist())],
                    dtype="<u8")


def fold(hashes: np.ndarray) -> int:
    """The SimHash of hashes: a bit is 1 if it is set in over half of them; 0 without any."""
    ones = np.zeros(BITS, dtype=np.int64)
    for part in range(0, len(hashes), 1 << 16):
        block = hashes[part:part + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the :func:`shingle_hashes` of a text; no words give 0."""
    return fold(shingle_hashes(text, width, seed))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                      width: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of every document as a BIGINT with the same 64 bits."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(batches: Batches):
        for batch in slices(batches):
            prints = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, fp bigint")


class BKTree:
    """Fingerprints in a tree whose children are keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        """Insert a value; its number is the count of values before it."""
        self.nodes.append(value)
        self.children.append({})
        new = len(self.nodes) - 1
        at = 0
        while new:
            distance = (value ^ self.nodes[at]).bit_count()
            child = self.children[at].setdefault(distance, new)
            if child == new:
                return
            at = child

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of the values at most ``radius`` bits away."""
        found, todo = [], [0] if self.nodes else []
        nodes, children = self.nodes, self.children
        while todo:
            at = todo.pop()
            distance = (value ^ nodes[at]).bit_count()
            if distance <= radius:
                found.append(at)
            below = children[at]
            if below:
                low, high = distance - radius, distance + radius
                todo += [child for key, child in below.items() if low <= key <= high]
        return found


def near_links(values: list[int], sides: list[int] | None, radius: int,
               holds: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``radius``, as pairs of positions.

    With ``sides`` only links between the two sides count, with ``holds`` only those for which it
    is true. A link inside a tree that is already joined is left out, and not asked for:
    reachability is the same.
    """
    root = list(range(len(values)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []

    def join(i: int, j: int) -> None:
        a, b = top(i), top(j)
        if a != b and (holds is None or holds(i, j)):
            root[max(a, b)] = min(a, b)
            links.append((i, j))

    tree = BKTree()
    if sides is None:
        for i, value in enumerate(values):
            for j in tree.within(value, radius):
                join(i, j)
            tree.add(value)
        return links
    first = min(sides)
    own = [i for i, s in enumerate(sides) if s == first]
    for i in own:
        tree.add(values[i])
    for i, side in enumerate(sides):
        if side != first:
            for j in tree.within(values[i], radius):
                join(i, own[j])
    return links


def block_keys(fp: str, radius: int, agree: int = 2) -> Column:
    """Keys of which two fingerprints within ``radius`` bits share at least one.

    The 64 bits fall into radius + agree blocks. Two such fingerprints differ in at most
    ``radius`` blocks, so they agree on some ``agree`` of them: one key per choice of blocks.
    """
    n = radius + agree
    edges = [BITS * i // n for i in range(n + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(n)]
    keys = []
    for number, choice in enumerate(combinations(range(n), agree)):
        mask = sum(masks[i] for i in choice)
        mask -= 1 << BITS if mask >> (BITS - 1) else 0
        keys.append(F.xxhash64(F.lit(number), F.col(fp).bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def fingerprint_links(prints: DataFrame, radius: int = 4, most: int = 2048) -> DataFrame:
    """(src, dst) links of distinct fingerprints (column fp) that connect all within ``radius``.

    Fingerprints are dealt to shards by :func:`block_keys`; each shard builds its BK-tree and is
    searched only by its own members, so no tree is sent to all tasks and no pair that could be
    near is missed. A shard of over ``most`` members becomes pairs of chunks: the tree of one
    chunk goes to the tasks that search it with another.
    """
    keyed = prints.select("fp", F.explode(block_keys("fp", radius)).alias("key"))
    shards = chunk_pairs(pin(keyed), "key", "fp", most)

    def search(group: pa.RecordBatch) -> pa.RecordBatch | None:
        if group.num_rows < 2:
            return None
        column = dict(zip(group.schema.names, group.columns))
        signed = column["fp"].to_numpy()
        sides = None if column["within"][0].as_py() else column["side"].to_pylist()
        links = near_links(signed.view(np.uint64).tolist(), sides, radius)
        if not links:
            return None
        at = np.array(links)
        return pa.RecordBatch.from_arrays([pa.array(signed[at[:, 0]]), pa.array(signed[at[:, 1]])],
                                          ["src", "dst"])

    return map_runs(shards.select("bucket", "fp", "side", "within"), "bucket", search,
                    "src bigint, dst bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4,
                    radius: int = 4) -> DataFrame:
    """(id, fp, component): every document with its fingerprint and duplicate group.

    ``component`` is the smallest id reachable over links of at most ``radius`` bits, the
    document's own included; equal fingerprints link. Copies are one fingerprint throughout, so
    they are never expanded into pairs. NULL and empty texts share fingerprint 0. Rows with the
    same id stay separate rows; a NULL id is never a component, unless a group has no other.
    """
    prints = pin(with_fingerprints(docs, id_col, text, width))
    classes = pin(prints.groupBy("fp").agg(F.min("id").alias("least")))
    linked = connected_components(fingerprint_links(classes.select("fp"), radius))
    labelled = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("least").alias("smallest"))
    facts = labelled.join(least, "component").select("fp", F.col("smallest").alias("component"))
    return attach(prints, pin(facts), "fp")


def hex_print(fp: str) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without near-duplicates: one row per component stays, that of its id.

    Rows are numbered first, so of several rows with the kept id one stays; which is decided by
    the row number, as with NULL ids.
    """
    uid = free_prefix(docs)
    rows = with_uid(docs, uid)
    # NULL ids come last, so that the smallest is an id wherever there is one.
    whole = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(uid).alias("uid"))
    groups = pin(near_duplicates(rows.select(whole.alias("id"), F.col(text).alias("text")), "id", **options))
    kept = groups.filter(F.col("id.uid") == F.col("component.uid")).select(F.col("id.uid").alias(uid))
    return rows.join(kept, uid, "left_semi").drop(uid)


def band_keys(hashes: np.ndarray, bands: int = 20, rows: int = 6) -> list[int]:
    """Keys of which two sets of hashes share one with probability 1 - (1 - J**rows)**bands.

    J is their Jaccard similarity; a key is a hash of ``rows`` minima under own multipliers.
    """
    odd = np.random.default_rng(11).integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for part in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[part:part + 4096, None] * odd).min(axis=0), out=least)
    raw = least.tobytes()
    return [xxhash.xxh64_intdigest(raw[8 * rows * b:8 * rows * (b + 1)], b) for b in range(bands)]


def with_bands(rows: DataFrame, width: int) -> DataFrame:
    """(uid, whole, digest, bands) of (uid, text, whole): a 128-bit digest of the set of shingles and its band keys."""
    def run(batches: Batches):
        for batch in slices(batches):
            digests, bands = [], []
            for text in batch.column(1).to_pylist():
                own = np.unique(shingle_hashes(text, width))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                bands.append(np.array(band_keys(own) if len(own) else [], dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(digests, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], ["uid", "whole", "digest", "bands"])

    return rows.mapInArrow(run, f"uid bigint, whole {dict(rows.dtypes)['whole']}, digest binary, bands array<bigint>")


def similar_links(members: DataFrame, width: int, least: float, radius: int, most: int) -> DataFrame:
    """(src, dst) links that connect all members (group, node, text) of a group whose sets of
    shingles have a Jaccard similarity of at least ``least``.

    A BK-tree of the sets' SimHashes proposes pairs within ``radius`` bits; the exact similarity decides.
    """
    paired = chunk_pairs(members, "group", "node", most)

    def search(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if batch.num_rows < 2:
            return None
        column = dict(zip(batch.schema.names, batch.columns))
        sets = [np.unique(shingle_hashes(t.as_py(), width)) for t in column["text"]]

        def alike(i: int, j: int) -> bool:
            a, b = sorted((len(sets[i]), len(sets[j])))
            if a < least * b * (1 - 1e-9):
                return False
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            return both / (a + b - both) >= least

        sides = None if column["within"][0].as_py() else column["side"].to_pylist()
        links = near_links([fold(s) for s in sets], sides, radius, alike)
        if not links:
            return None
        at, nodes = np.array(links), column["node"].to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(nodes[at[:, 0]]), pa.array(nodes[at[:, 1]])], ["src", "dst"])

    return map_runs(paired.select("bucket", "node", "text", "side", "within"), "bucket", search,
                    "src bigint, dst bigint")


#: Rows of a bitmap that are sent to all tasks; each has 64 row numbers.
BITMAP_ROWS = 1 << 21


def bitmap(numbers: DataFrame, uid: str) -> DataFrame:
    """(word, bits) for a table of row numbers: one row for each 64 that has any of them."""
    bit = F.expr(f"shiftleft(1L, cast(`{uid}` & 63 as int))")
    return numbers.groupBy(F.shiftright(uid, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def among(rows: DataFrame, uid: str, bits: DataFrame) -> DataFrame:
    """The rows whose number is in a stored :func:`bitmap`, without moving them.

    The bitmap goes to all tasks if it has at most ``BITMAP_ROWS`` rows, as it has for 134 million row numbers;
    a larger one is joined by shuffle.
    """
    small = bits.count() <= BITMAP_ROWS
    word, mask = f"{uid}w", f"{uid}b"
    own = bits.select(F.col("word").alias(word), F.col("bits").alias(mask))
    place = F.expr(f"cast(`{uid}` & 63 as int)")
    return (rows.withColumn(f"{uid}k", F.shiftright(uid, 6))
            .join(F.broadcast(own) if small else own, F.col(f"{uid}k") == F.col(word))
            .filter(F.call_function("getbit", mask, place) == 1).select(*rows.columns))


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5,
                     least: float = 0.8, radius: int = 24, most: int = 1024) -> DataFrame:
    """The documents without near-duplicates by exact similarity: one row per group stays.

    Two documents link if the Jaccard similarity of their sets of ``width``-word shingles is at
    least ``least``; groups are what such links connect, and the smallest id of a group stays.
    Every link is verified. Pairs that share none of the :func:`band_keys` are not compared:
    0.2 % of those at 0.8, fewer above. At 0.8, SimHashes differ in 10 of 64 bits on
    average, so ``radius`` leaves out next to none. Equal sets are one node throughout. Texts without words
    are a group; an empty table stays empty. Only texts that share a key with another travel, to the group of their
    keys; the kept rows are picked by a bitmap of row numbers. What is stored on the way is removed.
    """
    spark, uid = docs.sparkSession, free_prefix(docs)
    rows = with_uid(docs, uid)
    path = scratch_path(spark, "kept")
    with scratch_scope(spark):
        whole = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(uid).alias("uid"))
        texts = rows.select(F.col(uid).alias("uid"), F.col(text).alias("text"))
        marked = with_bands(rows.select(F.col(uid).alias("uid"), F.col(text).alias("text"), whole.alias("whole")), width)
        # Partial minima first: however many copies a text has, one row per task and text is shuffled.
        classes = pin(marked.groupBy("digest").agg(F.min("whole").alias("smallest"), F.min("uid").alias("node"),
                                                   F.first("bands").alias("bands")))
        keyed = pin(classes.select("node", F.explode("bands").alias("key")))
        hubs = pin(keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n"))
                   .filter("n > 1").drop("n"))
        proposed = pin(connected_components(attach(keyed, hubs, "key").select(
            F.col("node").alias("src"), F.col("hub").alias("dst"))).select(
            F.col("node").alias("uid"), F.col("component").alias("group")))
        found = among(texts, "uid", pin(bitmap(proposed, "uid")))
        members = pin(proposed.join(found, "uid").withColumnRenamed("uid", "node"))
        linked = connected_components(similar_links(members, width, least, radius, most))
        labelled = classes.select("node", "smallest").join(linked, "node", "left")
        kept = labelled.groupBy(F.coalesce("component", "node").alias("group")).agg(
            F.min("smallest").alias("smallest")).select(F.col("smallest.uid").alias("uid"))
        bits = pin(bitmap(kept, "uid"), path)
    return among(rows, uid, bits).drop(uid)
