"""Iterative proportional fitting of a document mix to target marginals, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostwin.functions.scalars import hash_unit
from hostwin.llm.common import free_prefix
from hostwin.session import pin

DIMENSIONS = ["source", "lang", "topic"]
#: Registers of writing that stand for topics where a table has none, by their first mark.
REGISTERS = [("table", " | "), ("shouted", "!!"), ("decorated", "###"), ("coded", "{")]


def register_topic(text: Column) -> Column:
    """The register of a text: the first of REGISTERS whose mark it holds, else 'prose'.

    Empty and NULL texts are 'empty'.
    """
    topic = F.when(F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0, "empty")
    for name, mark in REGISTERS:
        topic = topic.when(F.contains(text, F.lit(mark)), name)
    return topic.otherwise("prose")


def word_count(text: Column) -> Column:
    """Words between blanks; at least 1, so that empty documents have a weight too."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\r\f\v", "     ")
    blanks = F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit("")))
    return (blanks + 1).cast("bigint")


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares of a dimension: its token shares to a power below 1, which evens them out."""
    own = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("raw"))
    total = own.agg(F.sum("raw").alias("all_raw"))
    return own.join(F.broadcast(total)).select(dim, (F.col("raw") / F.col("all_raw")).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 12) -> DataFrame:
    """Scale the ``tokens`` of cells until every marginal of ``weight`` has its target share.

    ``targets`` has (value, target) per dimension; a value without target gets weight 0. Each
    round scales by one dimension after another; its result is stored, so plans stay short.
    Targets are joined once, and a step is one window over the cells of each value: cells are
    one per combination that occurs, far fewer than documents.
    """
    cells = cells.withColumn("weight", F.col("tokens").cast("double"))
    for dim, target in targets.items():
        cells = cells.join(target.withColumnRenamed("target", f"_{dim}"), dim, "left")
    cells = pin(cells)
    for _ in range(rounds):
        for dim in targets:
            now = F.sum("weight").over(Window.partitionBy(dim))
            cells = cells.withColumn("weight", F.coalesce(
                F.col("weight") * F.try_divide(F.col(f"_{dim}"), now), F.lit(0.0)))
        cells = pin(cells)
    return cells.drop(*[f"_{dim}" for dim in targets])


def calibrated(cells: DataFrame, keep: float = 0.8, repeats: bool = False) -> DataFrame:
    """Sampling probability of each cell: in proportion to its weight per token, at most 1.

    The factor is the one with which ``keep`` of all tokens are expected. Cells that it would
    lift above 1 are taken whole, and the factor of the others is raised to make up for them:
    the expected shares then miss those of the weights. With ``repeats`` nothing is capped, a
    probability above 1 is the expected number of copies, and the shares are those of the weights.
    """
    if repeats:
        whole = cells.agg(F.sum("tokens").alias("t"), F.sum("weight").alias("w"))
        return cells.join(F.broadcast(whole)).withColumn("probability", F.coalesce(
            F.try_divide(F.lit(keep) * F.col("t") * F.col("weight"), F.col("w") * F.col("tokens")),
            F.lit(0.0))).drop("t", "w")
    rated = cells.withColumn("rate", F.coalesce(F.try_divide("weight", F.col("tokens").cast("double")),
                                                F.lit(0.0)))
    total = rated.agg(F.sum("tokens").alias("t"), F.sum("weight").alias("w"))
    earlier = (Window.orderBy(F.desc("rate"), *DIMENSIONS)  # one row per cell, not per document
               .rowsBetween(Window.unboundedPreceding, -1))
    filled = rated.join(F.broadcast(total)).withColumns({
        "factor": F.try_divide(
            F.lit(keep) * F.col("t") - F.coalesce(F.sum("tokens").over(earlier), F.lit(0)),
            F.col("w") - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))),
    }).drop("t", "w").withColumn("whole", F.col("factor") * F.col("rate") >= 1)
    cut = filled.agg(F.min(F.when(~F.col("whole"), F.struct(-F.col("rate"), "factor"))).alias("cut"))
    return (filled.drop("factor").join(F.broadcast(cut))
            .withColumn("probability", F.when(F.col("whole"), 1.0).otherwise(
                F.least(F.lit(1.0), F.col("cut.factor") * F.col("rate"))))
            .drop("cut", "whole", "rate"))


def mix_documents(docs: DataFrame, power: float = 0.7, rounds: int = 12, seed: str = "mix",
                  keep: float = 0.8, topic: Column | None = None, targets: dict[str, DataFrame] | None = None,
                  id_col: str = "doc_id", text: str = "text", repeats: bool = True) -> DataFrame:
    """Every document with its cell, calibrated probability and decision.

    Adds to (id): source, lang, topic, tokens, probability, draw, copies, kept. The token weights
    of the cells are raked to the target shares (by default :func:`tempered` own shares).
    ``probability`` is the expected number of copies of each document of a cell: its whole part
    is certain, and one more is taken if a draw in [0, 1) hashed from the id is below the rest.
    Without ``repeats`` it is capped at 1 and the mix misses the targets (see :func:`calibrated`).
    NULL values are a group of their own, written ''. Documents with the same id share a draw;
    NULL ids draw as ''. An empty table gives no rows.
    """
    rows = labelled(docs, topic, id_col, text)
    return (join_cells(rows, cell_odds(rows, power, rounds, keep, targets, repeats))
            .withColumn("draw", draw_of("id", seed))
            .withColumn("copies", copies_of(F.col("probability"), F.col("draw")))
            .withColumn("kept", F.col("draw") < F.col("probability")))


def cell_odds(rows: DataFrame, power: float = 0.7, rounds: int = 12, keep: float = 0.8,
              targets: dict[str, DataFrame] | None = None, repeats: bool = True) -> DataFrame:
    """(source, lang, topic, probability) of every cell of labelled rows, stored."""
    cells = pin(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    targets = targets or {d: pin(tempered(cells, d, power)) for d in DIMENSIONS}
    return pin(calibrated(rake(cells, targets, rounds), keep, repeats).select(*DIMENSIONS, "probability"))


def reached(mixed: DataFrame, power: float = 0.7, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(dimension, value, own, target, expected, reached) token shares of every value.

    ``mixed`` is a result of :func:`mix_documents`; ``expected`` follows from its probabilities,
    ``reached`` from its copies.
    """
    sums = pin(mixed.groupBy(*DIMENSIONS).agg(
        F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("probability")).alias("expected"),
        F.sum(F.col("tokens") * F.col("copies")).alias("reached")))
    total = sums.agg(*[F.sum(c).alias(f"all_{c}") for c in ("tokens", "expected", "reached")])
    parts = None
    for dim in DIMENSIONS:
        target = (targets or {}).get(dim)
        target = tempered(sums, dim, power) if target is None else target
        own = sums.groupBy(dim).agg(*[F.sum(c).alias(c) for c in ("tokens", "expected", "reached")])
        part = (own.join(target, dim, "left").join(F.broadcast(total))
                .select(F.lit(dim).alias("dimension"), F.col(dim).alias("value"),
                        F.try_divide("tokens", "all_tokens").alias("own"),
                        F.coalesce("target", F.lit(0.0)).alias("target"),
                        F.try_divide("expected", "all_expected").alias("expected"),
                        F.try_divide("reached", "all_reached").alias("reached")))
        parts = part if parts is None else parts.unionAll(part)
    return parts


def copies_of(probability: Column, draw: Column) -> Column:
    """The whole part of a probability, and one more if the draw is below the rest."""
    certain = F.floor(probability)
    return (certain + F.when(draw < probability - certain, 1).otherwise(0)).cast("int")


def draw_of(id_col: str, seed: str) -> Column:
    """The draw of an id in [0, 1)."""
    return hash_unit(seed, F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def keep_mixed(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text: str = "text",
               **options) -> DataFrame:
    """The documents that :func:`mix_documents` keeps, once each, with their columns.

    This is not the mix: its token shares are those of :func:`repeat_mixed`.
    """
    return _drawn(docs, lambda p, draw: F.array_repeat(F.lit(0), F.when(draw < p, 1).otherwise(0)),
                  seed, id_col, text, **options)


def repeat_mixed(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text: str = "text",
                 **options) -> DataFrame:
    """As many rows of each document as :func:`mix_documents` counts copies, with its columns."""
    return _drawn(docs, lambda p, draw: F.array_repeat(F.lit(0), copies_of(p, draw)),
                  seed, id_col, text, **options)


def _drawn(docs: DataFrame, rows_of, seed: str, id_col: str, text: str, **options) -> DataFrame:
    """The documents, one row for each element of the array that ``rows_of`` makes of probability and draw."""
    own = free_prefix(docs)
    dims = [own + d for d in DIMENSIONS]
    odds = cell_odds(labelled(docs, None, id_col, text), **options).toDF(*dims, own + "p")
    named = docs.withColumns(dict(zip(dims, (
        F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), register_topic(F.col(text))))))
    return (join_cells(named, odds, dims, id_col, salt=own + "salt")
            .withColumn(own + "c", F.explode(rows_of(F.col(own + "p"), draw_of(id_col, seed))))
            .drop(*dims, own + "p", own + "c"))


def labelled(docs: DataFrame, topic: Column | None = None, id_col: str = "doc_id",
             text: str = "text") -> DataFrame:
    """(id, source, lang, topic, tokens) of documents."""
    named = F.coalesce((register_topic(F.col(text)) if topic is None else topic), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.coalesce("source", F.lit("")).alias("source"),
                       F.coalesce("lang", F.lit("")).alias("lang"), named.alias("topic"),
                       word_count(F.col(text)).alias("tokens"))


def join_cells(rows: DataFrame, odds: DataFrame, dims: list[str] = DIMENSIONS, id_col: str = "id",
               salts: int = 64, salt: str = "_salt") -> DataFrame:
    """Give rows the facts of their cell; a hot cell is dealt over ``salts``.

    The planner broadcasts the stored cells while they are small. Beyond that both sides are
    shuffled on cell and salt, and a cell is repeated once per salt.
    """
    dealt = odds.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int")
    return rows.withColumn(salt, own).join(dealt, [*dims, salt]).drop(salt)


def oracle(power: float = 0.7, rounds: int = 12, seed: str = "mix", keep: float = 0.8) -> str:
    """The same decisions in SQL: one pair of common tables per scaling step."""
    marks = " ".join(f"when contains(text, '{mark}') then '{name}'" for name, mark in REGISTERS)
    blanks = "translate(coalesce(text, ''), chr(9) || chr(10) || chr(13) || chr(12) || chr(11), '     ')"
    steps = [f"""rows as materialized (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang,
 case when length(trim(coalesce(text, ''))) = 0 then 'empty' {marks} else 'prose' end as topic,
 length({blanks}) - length(replace({blanks}, ' ', '')) + 1 as tokens from documents)""",
             "cells as materialized (select source, lang, topic, sum(tokens)::bigint as tokens, "
             "sum(tokens)::double as weight from rows group by all)"]
    for d in DIMENSIONS:
        steps.append(f"own_{d} as (select {d}, pow(sum(tokens)::double, {power}) as raw from cells group by 1)")
        steps.append(f"target_{d} as materialized (select {d}, raw / sum(raw) over () as target from own_{d})")
    last = "cells"
    for r in range(rounds):
        for d in DIMENSIONS:
            steps.append(f"c_{r}_{d} as materialized (select source, lang, topic, tokens, weight * target / "
                         f"sum(weight) over (partition by {d}) as weight from {last} join target_{d} using ({d}))")
            last = f"c_{r}_{d}"
    steps.append(f"rated as (select *, coalesce(weight / tokens, 0) as rate from {last})")
    steps.append(f"""filled as materialized (select *, ({keep} * sum(tokens) over () - coalesce(sum(tokens) over e, 0))
 / (sum(weight) over () - coalesce(sum(weight) over e, 0)) as factor from rated
 window e as (order by rate desc, source, lang, topic rows between unbounded preceding and 1 preceding))""")
    steps.append("""odds as (select source, lang, topic, case when factor * rate >= 1 then 1 else least(1.0, rate
 * (select arg_min(factor, -rate) from filled where factor * rate < 1)) end as probability from filled)""")
    steps.append("drawn as (select *, ('0x' || substr(md5('" + seed + ":' || coalesce(doc_id::varchar, '')), 1, 13))"
                 "::bigint::double / 4503599627370496.0 as draw from rows join odds using (source, lang, topic))")
    return "with " + ",\n".join(steps) + """
select doc_id, source, lang, topic, tokens, round(probability, 9) as probability, round(draw, 9) as draw,
 draw < probability as kept from drawn"""
