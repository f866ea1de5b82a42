"""Vector bin packing of documents into shards that are even in bytes, tokens and rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostwin.session import pin

SIZES = ["bytes", "tokens", "rows"]
#: Importance of the dimensions: shards are to be even in bytes first of all.
WEIGHTS = (4.0, 1.0, 1.0)


def measures(text: Column) -> dict[str, Column]:
    """Bytes (plus one), white-space words and rows of a text; NULL counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    words = F.length(F.regexp_replace(F.translate(whole, "\t\n\r\f\v", "     "), " *[^ ]+ *", "x"))
    return {"bytes": (F.octet_length(whole) + 1).cast("bigint"),
            "tokens": words.cast("bigint"), "rows": F.lit(1).cast("bigint")}


def place(items: np.ndarray, shards: int, weights: tuple[float, ...] | None = None) -> np.ndarray:
    """A shard for each item (rows of non-negative sizes, one column per dimension).

    Items go by falling size to the shard whose residual capacity has the highest dot product
    with them, its dimensions weighted by ``weights`` (1 each if not given); capacities are equal
    shares of the total and may be overdrawn. Ties go to the shard with the lower number.
    """
    scaled = items / np.maximum(items.sum(axis=0) / shards, 1e-300)
    left = np.ones((shards, items.shape[1]))
    worth = np.ones(items.shape[1]) if weights is None else np.array(weights)
    chosen = np.empty(len(items), dtype=np.int32)
    for i in np.argsort(-scaled.sum(axis=1), kind="stable"):
        at = int(np.argmax(left @ (scaled[i] * worth)))
        chosen[i] = at
        left[at] -= scaled[i]
    return chosen


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = 16,
                  lots: int = 8192, fine: int = 256, numbering: int = 64) -> DataFrame:
    """One row per document: id, size (bytes), tokens, text_crc32, shard, slot.

    Groups are equal texts and stay together. A group that is at least 1 / ``fine`` of a shard in
    any dimension is an item of its own (there are at most dimensions * shards * fine of them);
    the others travel in ``lots`` lots by the hash of their text. Only the sizes of these bounded
    items reach the driver, where :func:`place` packs them. A group larger than a whole shard
    would break the balance, so its documents are split into pieces by their row. Slots count
    from 0 without gaps in each shard, over ``numbering`` parts that are numbered side by side.

    NULL texts are empty texts. Documents with a NULL or repeated id keep one row each.
    An empty table gives an empty result.
    """
    sizes = measures(F.col(text))
    rows = pin(docs.select(
        F.col(id_col).alias("id"), *[c.alias(k) for k, c in sizes.items()],
        F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key")))
    rows = rows.withColumn("lot", F.pmod("key", F.lit(lots)).cast("int"))
    total = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SIZES]).first()
    share = {c: max(total[c], 1) / shards for c in SIZES}

    groups = pin(rows.groupBy("key", "lot").agg(*[F.sum(c).alias(c) for c in SIZES]))
    large = " or ".join(f"{c} * {fine} >= {share[c]!r}D" for c in SIZES)
    heavy = groups.filter(large).select("key", *SIZES).toPandas()
    light = (groups.filter(f"not ({large})").groupBy("lot")
             .agg(*[F.sum(c).alias(c) for c in SIZES]).toPandas())

    pieces = np.ceil((heavy[SIZES] / [share[c] for c in SIZES]).max(axis=1)).astype(int)
    items = np.concatenate([
        np.repeat((heavy[SIZES].to_numpy(float) / np.maximum(pieces, 1).to_numpy()[:, None]), pieces,
                  axis=0).reshape(-1, len(SIZES)),
        light[SIZES].to_numpy(float).reshape(-1, len(SIZES))])
    chosen = place(items, shards, WEIGHTS).tolist()
    spark = docs.sparkSession
    keys = [(int(k), p, int(n)) for k, n in zip(heavy["key"], pieces) for p in range(n)]
    own = spark.createDataFrame(
        [(k, p, n, s) for (k, p, n), s in zip(keys, chosen)],
        "key bigint, piece int, pieces int, own int")
    lot_of = spark.createDataFrame(
        [(int(lot), s) for lot, s in zip(light["lot"], chosen[len(keys):])], "lot int, common int")
    split = own.filter("piece = 0").select("key", "pieces")

    dealt = (rows.join(F.broadcast(split), "key", "left")
             .withColumn("piece", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()),
                                         F.coalesce("pieces", F.lit(1))).cast("int"))
             .join(F.broadcast(own.drop("pieces")), ["key", "piece"], "left")
             .join(F.broadcast(lot_of), "lot", "left")
             .withColumn("shard", F.coalesce("own", "common")))
    dealt = pin(dealt.select("id", F.col("bytes").alias("size"), "tokens", "text_crc32", "shard",
                             F.pmod(F.xxhash64("id", "key"), F.lit(numbering)).cast("int").alias("part")))
    return number_slots(dealt, numbering)


def number_slots(dealt: DataFrame, numbering: int) -> DataFrame:
    """Number the rows of each shard from 0, over parts that are numbered side by side.

    The starts of the parts are ``numbering`` rows per shard, so they are broadcast.
    """
    counts = dealt.groupBy("shard", "part").count()
    earlier = counts.withColumn(
        "start", F.expr("sum(count) over (partition by shard order by part) - count"))
    inside = F.expr("row_number() over (partition by shard, part order by id, size, text_crc32) - 1")
    return (dealt.withColumn("inside", inside)
            .join(F.broadcast(earlier.drop("count")), ["shard", "part"])
            .select("id", "size", "tokens", "text_crc32", "shard",
                    (F.col("start") + F.col("inside")).cast("bigint").alias("slot")))
