"""Near-duplicate vectors by spherical-cap filters of random product codes."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostwin.llm.common import Batches, attach, chunk_pairs, map_runs, slices
from hostwin.llm.components import connected_components
from hostwin.session import pin


@dataclass(frozen=True)
class CapPlan:
    """``rounds`` product codes of ``blocks`` blocks with ``codes`` words each, and the height from
    which a cap holds a vector."""

    dim: int
    blocks: int
    codes: int
    height: float
    rounds: int = 1
    seed: int = 7


def cap_height(dim: int, share: float) -> float:
    """The height of a cap that holds a ``share`` of all directions."""
    angle = np.linspace(0, math.pi, 20_001)
    weight = np.sin(angle) ** (dim - 2)
    held = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
    return float(np.interp(share, held / held[-1], np.cos(angle)))


@lru_cache(maxsize=64)
def plan_caps(n: int, dim: int, threshold: float, recall: float = 0.999, bucket: int = 16,
              each: float = 1.0, seed: int = 7, trials: int = 4000) -> CapPlan:
    """Caps that hold about ``bucket`` of ``n`` vectors, in enough rounds to meet ``recall``.

    A round is a random rotation with a product code that puts a vector into ``each`` caps on
    average. The caps of a round share code words and so are far from independent; how often a
    round brings two vectors at cosine ``threshold`` together is therefore tried on random
    pairs. Rounds are independent, so their number follows from that. The same rule holds at
    every size; more vectors give more and smaller caps.
    """
    share = min(0.02, bucket / max(n, 1))
    filters = each / share
    blocks = min(dim, max(2, math.ceil(math.log(filters) / math.log(4096))))
    plan = CapPlan(dim, blocks, math.ceil(filters ** (1 / blocks)), cap_height(dim, share), 1, seed)
    rng = np.random.default_rng([seed, dim, n])
    met = 0
    for part in range(8):
        x = rng.standard_normal((trials // 8, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        away = rng.standard_normal(x.shape)
        away -= (away * x).sum(axis=1, keepdims=True) * x
        away /= np.linalg.norm(away, axis=1, keepdims=True)
        own = decode_round(x, plan, part)
        other = decode_round(threshold * x + math.sqrt(1 - threshold**2) * away, plan, part)
        width = plan.codes ** blocks
        shared = np.intersect1d(own[0] * width + own[1], other[0] * width + other[1])
        met += len(np.unique(shared // width))
    found = (met + 1) / (trials + 2)
    rounds = math.ceil(math.log(1 - recall) / math.log(1 - found))
    return CapPlan(dim, blocks, plan.codes, plan.height, rounds, seed)


@lru_cache(maxsize=256)
def code_words(plan: CapPlan, number: int) -> tuple[np.ndarray, list[slice], list[np.ndarray]]:
    """Of a round: a random rotation, the blocks of coordinates and the unit code words of each."""
    rng = np.random.default_rng([plan.seed, plan.dim, number])
    rotation, upper = np.linalg.qr(rng.standard_normal((plan.dim, plan.dim)))
    rotation *= np.sign(np.diag(upper))
    cuts = [plan.dim * i // plan.blocks for i in range(plan.blocks + 1)]
    parts = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
    words = []
    for part in parts:
        w = rng.standard_normal((plan.codes, part.stop - part.start))
        words.append(w / np.linalg.norm(w, axis=1, keepdims=True))
    return rotation, parts, words


def decode_round(units: np.ndarray, plan: CapPlan, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for every product code word of a round whose cap holds a unit vector.

    Code words are extended block by block; a prefix goes on only if the best words of the
    remaining blocks can still lift it to the height.
    """
    rotation, parts, words = code_words(plan, number)
    turned = units @ rotation
    scores = [turned[:, part] @ w.T for part, w in zip(parts, words)]
    best = [s.max(axis=1) for s in scores]
    need = plan.height * math.sqrt(plan.blocks)
    row, code, sum_ = np.arange(len(units)), np.zeros(len(units), np.int64), np.zeros(len(units))
    for k, score in enumerate(scores):
        rest = sum(best[k + 1:], np.zeros(len(units)))
        rows, codes, sums = [row[:0]], [code[:0]], [sum_[:0]]
        for a in range(0, len(row), 4096):
            r, total = row[a:a + 4096], sum_[a:a + 4096, None] + score[row[a:a + 4096]]
            i, word = np.nonzero(total + rest[r][:, None] >= need)
            rows.append(r[i])
            codes.append(code[a:a + 4096][i] * plan.codes + word)
            sums.append(total[i, word])
        row, code, sum_ = np.concatenate(rows), np.concatenate(codes), np.concatenate(sums)
    return row, code


def list_decode(units: np.ndarray, plan: CapPlan) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) over all rounds; filters of different rounds have different numbers."""
    found = [decode_round(units, plan, number) for number in range(plan.rounds)]
    width = plan.codes ** plan.blocks
    return (np.concatenate([row for row, _ in found]),
            np.concatenate([code + number * width for number, (_, code) in enumerate(found)]))


def usable(vector: str) -> Column:
    """Whether a vector has components, all of them finite, and is not zero."""
    return F.expr(f"`{vector}` is not null and size(`{vector}`) > 0 and not exists(`{vector}`, x -> "
                  f"x is null or isnan(x) or abs(x) = double('Infinity')) and "
                  f"exists(`{vector}`, x -> x <> 0)")


def decoded(nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Adds ``filters``: the sorted numbers of all caps that hold the vector.

    Only vectors of one label meet, so caps are planned for the number of the largest label.
    """
    n = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0

    def run(batches: Batches):
        for batch in slices(batches, 512):
            rows = batch.column("vector").to_pylist()
            found: list = [None] * len(rows)
            for dim in {len(r) for r in rows}:
                at = [i for i, r in enumerate(rows) if len(r) == dim]
                x = np.zeros((len(at), max(dim, 4)))  # more zeros change no cosine
                x[:, :dim] = [rows[i] for i in at]
                # Scaled before the norm, so that huge and tiny components keep their direction.
                x /= np.abs(x).max(axis=1, keepdims=True)
                row, code = list_decode(x / np.linalg.norm(x, axis=1, keepdims=True),
                                        plan_caps(n, x.shape[1], threshold, recall))
                order = np.lexsort((code, row))
                ends = np.searchsorted(row[order], np.arange(len(at) + 1))
                code = code[order]
                for k, i in enumerate(at):
                    found[i] = code[ends[k]:ends[k + 1]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, "filters"])

    fields = ", ".join(f"{c} {t}" for c, t in nodes.dtypes)
    return nodes.mapInArrow(run, f"{fields}, filters array<bigint>")


def close_pairs(group: pa.RecordBatch, threshold: float) -> pa.RecordBatch | None:
    """What the verified links of the vectors in one cap come to: (node, partner, linked).

    ``linked`` counts the copies that a node links to, each link only in the first cap that holds
    both its ends. ``partner`` is the first node of the cap that the node reaches; these links
    alone connect what all links connect. So the rows are no more than the vectors in the cap.
    """
    if group.num_rows < 2:
        return None
    column = dict(zip(group.schema.names, group.columns))
    x = column["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = x.reshape(group.num_rows, -1)
    norm = np.sqrt((x * x).sum(axis=1))
    with np.errstate(all="ignore"):
        odd = ~np.isfinite(norm) | (norm < 1e-150)
    if odd.any():  # squares leave the range of doubles
        x = x / np.abs(x).max(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1))
    side = column["side"].to_numpy(zero_copy_only=False)
    within = column["within"][0].as_py()
    own = np.arange(len(x)) if within else np.flatnonzero(side == side.min())
    other = own if within else np.flatnonzero(side != side.min())
    if not len(other):
        return None
    near = (x[own] @ x[other].T) / np.outer(norm[own], norm[other]) >= threshold
    if within:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    i, j = own[i], other[j]
    if not len(i):
        return None
    here = column["filter"][0].as_py()
    lists = column["filters"].to_pylist()
    width = max(map(len, lists))
    earlier = np.full((len(x), width), -1, dtype=np.int64)
    for k, numbers in enumerate(lists):
        before = [f for f in numbers if f < here]
        earlier[k, :len(before)] = before
    new = np.ones(len(i), dtype=bool)
    for a in range(0, len(i), 1024):
        left, right = earlier[i[a:a + 1024], :, None], earlier[j[a:a + 1024], None, :]
        new[a:a + 1024] = ~((left == right) & (left >= 0)).any(axis=(1, 2))
    node, copies = column["node"].to_numpy(), column["copies"].to_numpy()
    linked = np.zeros(len(x), dtype=np.int64)
    np.add.at(linked, i[new], copies[j[new]])
    np.add.at(linked, j[new], copies[i[new]])
    first = np.arange(len(x))
    while True:  # each round takes over the smaller number of a neighbour, and what that has
        least = first.copy()
        np.minimum.at(least, i, first[j])
        np.minimum.at(least, j, first[i])
        least = least[least]
        if (least == first).all():
            break
        first = least
    told = np.flatnonzero((linked > 0) | (first != np.arange(len(x))))
    return pa.RecordBatch.from_arrays(
        [pa.array(v) for v in (node[told], node[first[told]], linked[told])], ["node", "partner", "linked"])


def near_vectors(rows: DataFrame, threshold: float = 0.93, id_col: str = "vec_id",
                 vector: str = "embedding", label: str = "label", recall: float = 0.999,
                 most: int = 2048) -> DataFrame:
    """(id, n_links, component, kept) of every row: links are cosines of at least ``threshold``.

    Only rows with the same label are compared. Equal vectors are one node with a count of
    copies, so a group of copies costs one vector and its links are counted, not listed. Nodes
    are list-decoded to their caps, joined on (label, length, cap) and verified in double
    precision; caps of over ``most`` members are compared in pairs of chunks. ``recall`` is the
    expected share of the links just at the threshold that is found; closer ones are found more
    surely.

    Rows whose label is NULL or whose vector is NULL, empty, zero, or holds NULL or non-finite
    components link with nothing and are components of their own; so are vectors of different
    lengths to each other. A row with a NULL id counts in n_links of others.
    """
    base = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("vector"),
                       F.col(label).alias("label"))
    key = F.when(usable("vector") & F.col("label").isNotNull(), F.concat_ws(
        "-", F.hex(F.xxhash64("label", "vector")), F.hex(F.hash("vector", "label")), F.size("vector")))
    base = base.withColumn("same", key)
    nodes = pin(base.filter("same is not null").groupBy("same").agg(
        F.first("vector").alias("vector"), F.first("label").alias("label"),
        F.count("*").alias("copies"), F.min("id").alias("least"))
        .withColumn("node", F.monotonically_increasing_id()))
    held = pin(decoded(nodes.select("node", "label", "copies", "vector"), threshold, recall))
    keyed = (held.withColumn("filter", F.explode("filters"))
             .withColumn("key", F.xxhash64("label", F.size("vector"), "filter")))
    buckets = chunk_pairs(keyed, "key", "node", most).select(
        "bucket", "side", "within", "filter", "filters", "node", "copies", "vector")
    links = pin(map_runs(buckets, "bucket", lambda g: close_pairs(g, threshold),
                         "node bigint, partner bigint, linked bigint"))
    counted = links.groupBy("node").agg(F.sum("linked").alias("linked"))
    groups = (nodes.select("same", "node", "copies", "least")
              .join(connected_components(links.select(
                  F.col("node").alias("src"), F.col("partner").alias("dst"))), "node", "left")
              .withColumn("component", F.coalesce("component", "node")).join(counted, "node", "left"))
    least = groups.groupBy("component").agg(F.min("least").alias("smallest"))
    facts = pin(groups.join(least, "component").select(
        "same", "smallest", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")))
    out = attach(base.select("id", "same"), facts, "same")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      F.coalesce("smallest", "id").alias("component"),
                      F.col("id").eqNullSafe(F.coalesce("smallest", "id")).alias("kept"))
