"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostwin.session import pin

#: Parts that the links of one node are dealt over.
SALTS = 32


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (src, dst; BIGINT, in any direction).

    ``component`` is the smallest node reachable. Each round links every neighbour of a node to
    the smallest one it knows, so chains shorten by half or better; links, nodes and components
    stay distributed, a node with a third of all links is dealt over many tasks, and each round is a stored table. Rows with a NULL end and loops are
    ignored. Rounds go on until none changes a link.
    """
    edges = pin(links.filter("src is not null and dst is not null and src <> dst")
                .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
                .distinct())
    seen = _state(edges)
    while True:
        edges = pin(_small_star(_large_star(edges)))
        now = _state(edges)
        if now == seen:
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                roots.select("node", F.col("node").alias("component")))
        seen = now


def _with_least(rows: DataFrame) -> DataFrame:
    """The rows (u, v) with m, the least v of their u; the rows of one u are dealt over ``SALTS`` parts."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS))).repartition("u", "salt")
    own = dealt.groupBy("u", "salt").agg(F.min("v").alias("least"))
    # At most SALTS rows of a u meet here.
    known = own.select("u", "salt", F.min("least").over(Window.partitionBy("u")).alias("m"))
    return dealt.join(known, ["u", "salt"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (_with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .filter("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    return (_with_least(edges).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x
