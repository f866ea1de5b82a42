"""The mix of the pipeline has the target shares, also where some rates exceed 1."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from hostwin.llm import mixing
from hostwin.session import pin


def table(spark, n=6000):
    """Every third row of one source; rare languages and registers."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(n):
        mark = str(rng.choice(["", " | x", " !! x", " { x"], p=[0.9, 0.05, 0.02, 0.03]))
        rows.append((i, "word " * int(rng.integers(10, 60)) + mark, str(rng.choice(["en", "fr", "de"], p=[0.8, 0.15, 0.05])),
                     "big" if i % 3 == 0 else f"s{i % 10}", 1))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_mix_has_the_target_shares(spark):
    docs = pin(table(spark))
    mixed = pin(mixing.mix_documents(docs))
    assert mixed.filter("probability > 1").count() > 0
    shares = mixing.reached(mixed).collect()
    assert {r.dimension for r in shares} == set(mixing.DIMENSIONS)
    for r in shares:
        assert abs(r.expected - r.target) < 0.003, r
        assert abs(r.reached - r.target) < 0.02, r
    totals = mixed.agg(F.sum(F.expr("tokens * probability")) / F.sum("tokens")).first()[0]
    assert abs(totals - 0.8) < 1e-9
    copies = {r.id: r.copies for r in mixed.collect()}
    stage = Counter(r.doc_id for r in corpus_pipeline.mixture(spark, docs, None).collect())
    assert stage == Counter({i: n for i, n in copies.items() if n})
