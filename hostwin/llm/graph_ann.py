"""Nearest neighbours by inner product: robust-pruned directed graphs, one per shard."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostwin.llm.caps import usable
from hostwin.llm.common import stratum, with_uid
from hostwin.session import pin

INDEX_SCHEMA = "shard int, node int, entry boolean, vector binary, edges binary, ids binary"


def lifted(x: np.ndarray) -> np.ndarray:
    """Vectors with one more component, so that all have the norm of the longest.

    The nearest of them to a query (with 0 there) is the one with the largest inner product.
    """
    square = (x * x).sum(axis=1)
    return np.hstack([x, np.sqrt(np.maximum(square.max(initial=0.0) - square, 0.0))[:, None]])


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray,
                width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances) of the ``width`` nearest nodes that greedy walks meet.

    All queries walk in step: each expands its nearest node not yet expanded, until the beam
    holds none. Missing entries are node -1 at distance infinity.
    """
    count = len(queries)
    square = (x * x).sum(axis=1)
    own = (queries * queries).sum(axis=1)
    nodes = np.full((count, width), -1, dtype=np.int64)
    dist = np.full((count, width), np.inf)
    open_ = np.zeros((count, width), dtype=bool)
    seen = np.zeros((count, len(x)), dtype=bool)
    nodes[:, 0], open_[:, 0], seen[:, entry] = entry, True, True
    dist[:, 0] = square[entry] - 2 * (queries @ x[entry]) + own
    while True:
        rows = np.flatnonzero(open_.any(axis=1))
        if not len(rows):
            return nodes, dist
        col = open_[rows].argmax(axis=1)
        open_[rows, col] = False
        near = edges[nodes[rows, col]]
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        seen[rows[:, None].repeat(near.shape[1], 1)[fresh], near[fresh]] = True
        d = square[near] - 2 * np.einsum("ad,ard->ar", queries[rows], x[near]) + own[rows, None]
        d[~fresh] = np.inf
        all_d = np.concatenate([dist[rows], d], axis=1)
        take = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        dist[rows] = np.take_along_axis(all_d, take, 1)
        all_n = np.concatenate([nodes[rows], np.where(fresh, near, -1)], axis=1)
        nodes[rows] = np.take_along_axis(all_n, take, 1)
        all_o = np.concatenate([open_[rows], fresh], axis=1)
        open_[rows] = np.take_along_axis(all_o, take, 1)


def robust_prune(x: np.ndarray, points: np.ndarray, pool: np.ndarray, degree: int,
                 alpha: float) -> np.ndarray:
    """Up to ``degree`` neighbours of each point out of its ``pool`` (padded by -1).

    The nearest candidate is kept, then every other one that is ``alpha`` times nearer to it than
    to the point is dropped, and so on: what stays points in different directions.
    """
    pool = np.where(pool == points[:, None], -1, pool)
    pool = np.sort(pool, axis=1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    spots = x[pool]
    d = ((spots - x[points][:, None]) ** 2).sum(axis=2)
    d[pool < 0] = np.inf
    square = (spots * spots).sum(axis=2)
    between = square[:, :, None] + square[:, None] - 2 * spots @ spots.transpose(0, 2, 1)
    out = np.full((len(points), degree), -1, dtype=np.int64)
    alive, rows = np.isfinite(d), np.arange(len(points))
    for k in range(degree):
        left = np.where(alive, d, np.inf)
        best = left.argmin(axis=1)
        ok = np.isfinite(left[rows, best])
        if not ok.any():
            break
        out[ok, k] = pool[rows, best][ok]
        alive &= ~(ok[:, None] & (alpha * alpha * between[rows, best] <= d))
        alive[rows, best] = False
    return out


def build_graph(x: np.ndarray, degree: int = 32, width: int = 64, alpha: float = 1.2,
                seed: int = 7, batch: int = 256) -> tuple[np.ndarray, int]:
    """(edges, entry) over the rows of ``x``: a random graph, refined by greedy searches.

    Each batch of points searches the graph as it is; the visited nodes and the old neighbours
    are its candidates, pruned to ``degree``. Edges back to a point are added and pruned likewise.
    """
    n = len(x)
    rng = np.random.default_rng(seed)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    start = min(degree, n - 1)
    edges = np.full((n, degree), -1, dtype=np.int64)
    if start > 0:
        edges[:, :start] = (np.arange(n)[:, None] + 1 + np.sort(
            rng.integers(0, n - 1, (n, start)), axis=1)) % n
    order = rng.permutation(n)
    for a in range(0, n, batch):
        points = order[a:a + batch]
        met, _ = beam_search(x, edges, entry, x[points], width)
        edges[points] = robust_prune(x, points, np.concatenate([met, edges[points]], axis=1), degree, alpha)
        _add_back(x, edges, points, degree, alpha)
    return edges, entry


def _add_back(x: np.ndarray, edges: np.ndarray, points: np.ndarray, degree: int, alpha: float) -> None:
    source = np.repeat(points, degree)
    target = edges[points].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    ends = np.flatnonzero(np.append(target[1:] != target[:-1], True)) + 1 if len(target) else []
    owners, pools, begin = [], [], 0
    for end in ends:
        q, new = target[begin], source[begin:end]
        old = edges[q][edges[q] >= 0]
        both = np.concatenate([old, new[~np.isin(new, old)]])
        if len(both) <= degree:
            edges[q, :len(both)] = both
        else:
            owners.append(q)
            pools.append(both)
        begin = end
    for a in range(0, len(owners), 256):
        part = pools[a:a + 256]
        pool = np.full((len(part), max(map(len, part))), -1, dtype=np.int64)
        for k, p in enumerate(part):
            pool[k, :len(p)] = p
        at = np.array(owners[a:a + 256])
        edges[at] = robust_prune(x, at, pool, degree, alpha)


def build_index(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
                shard_rows: int = 4096, degree: int = 32, width: int = 64,
                alpha: float = 1.2) -> DataFrame:
    """The graphs of all usable vectors, one row per node (INDEX_SCHEMA).

    Rows are dealt evenly to shards of about ``shard_rows``, whatever their ids or values. Equal
    vectors of a shard are one node with the list of their ids, so copies do not crowd the graph.
    Vectors that are NULL, empty or zero, hold NULL or non-finite components, or have another
    length than most are left out, and so are rows without id.
    """
    stored = with_uid(usable_rows(rows, id_col, vector))
    shards = max(1, math.ceil(stored.count() / shard_rows))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.array(frame["vector"].tolist(), dtype=np.float64)
        ids = frame["id"].to_numpy(np.int64)
        nodes, member = np.unique(x, axis=0, return_inverse=True)
        edges, entry = build_graph(lifted(nodes), degree, width, alpha)
        order = np.lexsort((ids, member.ravel()))
        ends = np.searchsorted(member.ravel()[order], np.arange(len(nodes) + 1))
        return pd.DataFrame({
            "shard": frame["shard"].iloc[0], "node": np.arange(len(nodes)),
            "entry": np.arange(len(nodes)) == entry, "vector": [v.tobytes() for v in nodes],
            "edges": [e.astype(np.int32).tobytes() for e in edges],
            "ids": [ids[order[a:b]].tobytes() for a, b in zip(ends, ends[1:])]})

    return (stored.withColumn("shard", stratum("uid", shards)).groupBy("shard")
            .applyInPandas(build, INDEX_SCHEMA))


def usable_rows(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part: usable vectors of the most common length."""
    kept = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("vector")).filter(
        F.col("id").isNotNull() & usable("vector"))
    common = kept.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return kept.filter(F.size("vector") == (common.n if common else 0))


def search_index(index: DataFrame, queries: DataFrame, k: int = 20, width: int = 96,
                 block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows found for each query, own id left out.

    ``queries`` has (id, vector). Blocks of about ``block`` queries meet the graph of every shard
    in a task of its own; each query walks the shard and hands back its ``k`` best by exact inner
    product. Best first, ties to the smaller id. A query whose vector cannot be used, or has
    another length than the index, finds nothing. Rows with the same id are queries of their own.
    """
    queries = with_uid(queries.filter(F.col("id").isNotNull() & usable("vector")), "query")
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    blocks = max(1, math.ceil(queries.count() / block))
    asked = queries.withColumn("block", stratum("query", blocks)).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []})
        if graph.empty or asked.empty:
            return empty
        graph = graph.sort_values("node")
        x = np.frombuffer(b"".join(graph["vector"])).reshape(len(graph), -1)
        asked = asked[asked["vector"].map(len) == x.shape[1]]
        if asked.empty:
            return empty
        edges = np.frombuffer(b"".join(graph["edges"]), dtype=np.int32).reshape(len(graph), -1)
        entry = int(graph["entry"].to_numpy().argmax())
        members = [np.frombuffer(b, dtype=np.int64) for b in graph["ids"]]
        q = np.array(asked["vector"].tolist(), dtype=np.float64)
        met, _ = beam_search(lifted(x), edges, entry, np.hstack([q, np.zeros((len(q), 1))]), width)
        parts = []
        for number, own, vector, nodes in zip(asked["query"], asked["id"], q, met):
            nodes = nodes[nodes >= 0]
            scores = (x[nodes] * vector).sum(axis=1)
            # Of equal vectors only the smallest ids can be among the k best.
            ids = [members[m][:k + 1] for m in nodes]
            score = np.repeat(scores, [len(i) for i in ids])
            ids = np.concatenate(ids)
            score, ids = score[ids != own], ids[ids != own]
            best = np.lexsort((ids, -score))[:k]
            parts.append(pd.DataFrame({"query": number, "query_id": own, "vec_id": ids[best],
                                       "score": score[best]}))
        return pd.concat(parts)

    found = asked.groupBy("shard", "block").cogroup(graphs.groupBy("shard", "block")).applyInPandas(
        lambda asked, graph: search(graph, asked),
        "query bigint, query_id bigint, vec_id bigint, score double")
    rank = F.expr("cast(row_number() over (partition by query order by score desc, vec_id) as int)")
    return (found.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def nearest(rows: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id",
            vector: str = "embedding", **search) -> DataFrame:
    """Search every row whose id is divisible by ``every`` against all rows of the table."""
    index = pin(build_index(rows, id_col, vector))
    asked = usable_rows(rows, id_col, vector).filter(F.col("id") % every == 0)
    return search_index(index, asked, k, **search)
