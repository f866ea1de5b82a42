from hostwin.operators import text

LINES = "The dog saw the dog.\n The cat saw\n the\x1cdog"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_tokens_split_like_python(spark):
    got = text.tokens(docs(spark, LINES, "", "  ", "a\xa0b\x85c　d")).collect()
    for i, t in enumerate([LINES, "", "  ", "a\xa0b\x85c　d"]):
        assert [r.word for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.pos)
                ] == t.split()


def test_lower(spark):
    rows = text.tokens(docs(spark, LINES), lower=True).collect()
    assert [r.word for r in sorted(rows, key=lambda r: r.pos)] == LINES.lower().split()


def test_successors_equal_a_dictionary(spark):
    words = LINES.split()
    want = {}
    for a, b in zip(words, words[1:]):
        want.setdefault(a, []).append(b)
    got = text.successors(docs(spark, LINES)).collect()
    assert {r.word: r.nexts for r in got} == want
    assert "The" in want and "the" in want


def test_pairs_stay_inside_a_document(spark):
    rows = text.successor_counts(docs(spark, "a b", "a b c", "single", "")).collect()
    assert {(r.word, r.next): r.n for r in rows} == {("a", "b"): 2, ("b", "c"): 1}


def test_successors_of_repeated_and_missing_keys(spark):
    rows = [(1, "a b a"), (2, "a c"), (1, "a d"), (None, "x y"), (None, "x y z"), (3, None), (4, "one"), (5, "")]
    got = text.successors(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    found = {(r.doc_id, r.word): sorted(r.nexts) for r in got}
    assert len(got) == len(found) and found == {
        (1, "a"): ["b", "d"], (1, "b"): ["a"], (2, "a"): ["c"], (None, "x"): ["y", "y"], (None, "y"): ["z"]}


def test_words_of_a_text_with_its_own_key_are_not_shuffled(spark):
    listed = text.successors(docs(spark, LINES, "a b"))
    assert "Exchange" not in listed._jdf.queryExecution().executedPlan().toString()


def test_every_separator_ends_a_word_and_pairs_are_one_key(spark):
    apart = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert sorted(text.SEPARATORS) == apart
    rows = [*[f"a{c}b{c}{c}É𝒜" for c in apart], "a\u200bb É", None]
    counts = text.successor_counts(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"))
    n = len(apart)
    assert {(r.word, r.next): r.n for r in counts.collect()} == {
        ("a", "b"): n, ("b", "É𝒜"): n, ("a\u200bb", "É"): 1}
    assert counts.columns == ["word", "next", "n"]
    assert "hashpartitioning(pair" in counts._jdf.queryExecution().executedPlan().toString()
