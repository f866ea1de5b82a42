"""The language model is not cut: sizes, and any number of languages."""

import inspect

from hostwin.llm import langid


def test_every_language_is_learned(spark):
    names = [f"l{i:02d}" for i in range(70)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = {n: letters[i % 26] * 3 + letters[i // 26] * 3 + "q" for i, n in enumerate(names)}
    rows = [(100 * i + k, f"{word[n]} {word[n]}", n) for i, n in enumerate(names) for k in range(2 if i < 64 else 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.learn(docs)
    assert model.languages == names
    told = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert all(told[i] == n for i, _, n in rows)


def test_sizes():
    own = inspect.signature(langid.learn).parameters
    assert own["words_per_language"].default >= 50_000 and own["grams_per_language"].default >= 30_000
