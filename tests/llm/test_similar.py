"""Near-duplicates of the pipeline: five-word Jaccard similarity of 0.8 or more."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hostwin.llm import simhash


def shingles(text):
    words = text.split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def edited(pairs=400):
    """(first text, second text, similarity): random words, some of them replaced in the second."""
    rng = np.random.default_rng(7)
    out = []
    for i in range(pairs):
        words = [f"w{n}" for n in rng.integers(0, 50_000, 150)]
        other = list(words)
        for at in rng.choice(150, rng.integers(1, 9), replace=False):
            other[at] = f"x{i}_{at}"
        a, b = " ".join(words), " ".join(other)
        out.append((a, b, len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))))
    return out


@pytest.mark.parametrize("most", [64, 1024])
def test_stage_links_by_exact_similarity(spark, most):
    pairs = edited()
    rows = [(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id for r in (corpus_pipeline.near_duplicates(spark, docs, None) if most == 1024
                               else simhash.keep_one_similar(docs, most=most)).collect()}
    assert {2 * i for i in range(len(pairs))} <= kept
    gone = [2 * i + 1 not in kept for i in range(len(pairs))]
    alike = [p[2] >= 0.8 for p in pairs]
    assert not any(g for g, a in zip(gone, alike) if not a)
    found = [g for g, a in zip(gone, alike) if a]
    assert 100 < len(found) < 300 and np.mean(found) > 0.98


def test_clouds_are_linked_across_chunks(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(i, f"{text} end{i}") for i in range(300)] + [(i, text) for i in range(300, 600)] + [(600, "alone")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = simhash.keep_one_similar(docs.withColumn("uid", F.lit("x")), most=40).collect()
    assert sorted(r.doc_id for r in kept) == [0, 600]
