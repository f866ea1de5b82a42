"""Vector codes, spelling variants and the search for benchmark passages against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hostwin.llm import codes, decontaminate, variants
from tests.llm.test_texts import DOCS, EDGES, clashing

# Vector codes


def plain_codes(rows, rounds=6, entries=16, parts=8):
    """Codes and codebooks by comparing every part with every entry, in Python integers."""
    kept = [(i, [int(np.floor(4096 * x)) for x in v]) for i, v in rows]
    width = len(kept[0][1]) // parts
    cut = {i: [tuple(v[p * width:(p + 1) * width]) for p in range(parts)] for i, v in kept}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            at = [nearest(c[p], books[p])[1] for c in cut.values()]
            for n in range(len(books[p])):
                own = [c[p] for c, a in zip(cut.values(), at) if a == n]
                if own:
                    books[p][n] = tuple(sum(x) // len(own) for x in zip(*own))
    found = {i: [nearest(c[p], books[p]) for p in range(parts)] for i, c in cut.items()}
    flat = ",".join(str(x) for b in books for e in b for x in e)
    return ({i: ("".join(f"{n:02x}" for _, n in f), sum(d for d, _ in f)) for i, f in found.items()},
            hashlib.sha256(flat.encode()).hexdigest())


@pytest.mark.parametrize("n, block_rows", [(200, 16), (5, 128)])
def test_codes_equal_plain_integers(spark, n, block_rows):
    rng = np.random.default_rng(n)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(n)]
    rows[3] = rows[2][0] + 1, rows[2][1]
    odd = [(900, None), (901, []), (902, [float("nan")] * 16), (903, [1.0] * 15 + [None]), (904, [float("inf")] * 16),
           (905, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, i % 3 if i % 3 else None, "x") for i, v in rows + odd],
                               "vec_id bigint, embedding array<float>, label int, code string")
    want, sha = plain_codes(rows)
    got = codes.compress(df, block_rows=block_rows).collect()
    assert {r.id: (r.code, r.error) for r in got} == want and {r.codebooks_sha256 for r in got} == {sha}
    sums = Counter()
    for i, (_, error) in want.items():
        sums[i % 3] += error
    assert all(r.label_error == sums[r.id % 3] for r in got)
    assert codes.compress(df.filter("vec_id >= 900 and vec_id < 905")).collect() == []


def test_shortlists_keep_the_nearest():
    rng = np.random.default_rng(0)
    for _ in range(50):
        book, points = rng.integers(-50, 50, (16, 4)), rng.integers(-20, 20, (30, 4))
        able = np.flatnonzero(codes.shortlists(book, points.min(axis=0)[None], points.max(axis=0)[None])[0])
        entry, d2 = codes.nearest_entries(points, book, able)
        every = ((points[:, None] - book[None]) ** 2).sum(-1)
        assert (entry == every.argmin(1)).all() and (d2 == every.min(1)).all()


# Spelling variants


def plain_variants(docs):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    rows = {}
    for w in n:
        others = sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x))
        rows[w] = others[0] if others and n[others[0]] >= 5 * n[w] else None, n[w], len(others)

    def root(w):
        while rows[w][0]:
            w = rows[w][0]
        return w

    return {w: (f, root(w), c, k, n[f] if f else None) for w, (f, c, k) in rows.items()}


def test_variants_equal_plain_search(spark):
    long = "z" * 3000
    words = {"colour": 700, "color": 900, "colours": 30, "colouur": 6, "çolours": 6, "aabbcc": 50, "aabbc": 90, "aabbccc": 9,
             "aabbcb": 9, "neighbour": 300, "neighbor": 60, "neighbars": 5, "NEIGHBOR": 2, long: 40, long + "z": 7,
             long[:-1] + "y": 6, "fewfew": 4, "straße": 30, "strasse": 5}
    rng = np.random.default_rng(1)
    bag = [w for w, k in words.items() for _ in range(k)]
    rng.shuffle(bag)
    docs = [(i, " 1,".join(bag[i * 40:(i + 1) * 40])) for i in range(len(bag) // 40 + 1)]
    docs += [(None, "colour " * 30), (1, docs[1][1]), (3, None), (4, ""), (5, "12 !!")]
    df = clashing(spark.createDataFrame(docs, "doc_id bigint, text string"))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.group_variants(df).collect()}
    assert got == plain_variants(docs) and any(v[0] for v in got.values())
    assert variants.group_variants(df.limit(0)).collect() == []


def test_rounds_of_filters_give_the_same_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list("abcdé"), rng.integers(6, 8))) for _ in range(1500)})
    df = spark.createDataFrame([(w, 5 + i) for i, w in enumerate(words)], "word string, n bigint")
    whole = {tuple(r) for r in variants.near_pairs(df).collect()}
    monkeypatch.setattr(variants, "WORDS_A_SHARD", 300)
    assert {tuple(r) for r in variants.near_pairs(df, round_bytes=1000).collect()} == whole
    known = set(words)
    want = {(w, w[:i] + c + w[i + 1:]) for w in words for i in range(len(w)) for c in "abcdé" if c != w[i]}
    want |= {(w, w[:i] + w[i + 1:]) for w in words for i in range(len(w))}
    want = {p for p in want if p[1] in known}
    want |= {(b, a) for a, b in want}
    assert {p[:2] for p in whole} == want


# Benchmark passages


def plain_leaks(docs, items, window=10):
    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    windows = {}
    for key, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[i:i + window]), set()).add("" if key is None else str(key))
    out = []
    for key, text in docs:
        w, hit, found = split(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                own = windows.get(tuple(w[i:i + k]))
                if own:
                    hit |= set(range(i, i + k))
                    found |= own
        out.append((key, len(w), tuple(sorted(hit)), tuple(sorted(found))))
    return Counter(out)


@pytest.mark.parametrize("shard_words, block", [(1 << 20, 1 << 16), (64, 7)])
def test_leaks_equal_plain_search(spark, shard_words, block):
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(0, 40)}"
    items = [(i, " ".join(word() for _ in range(rng.integers(1, 25)))) for i in range(12)]
    items += [(None, items[0][1]), (12, None), (13, "?!"), (3, items[5][1]), (14, "Größe ÄB 7up"), (15, "w1 " * 14)]
    docs = [(i, " ".join(word() for _ in range(rng.integers(0, 60)))) for i in range(40)]
    docs += [(100 + i, f"{word()}, {t} {word()} {t}") for i, (_, t) in enumerate(items) if t]
    docs += [(200, " ".join(["x", items[7][1]] * 40)), (201, "w1 " * 500), (202, "größe Äb 7up"), (203, "GRÖßE ÄB 7UP"),
             (100, docs[0][1]), (None, items[1][1]), (204, None), (205, "")]
    df = clashing(spark.createDataFrame(docs, "doc_id bigint, text string")).repartition(3)
    bench = clashing(spark.createDataFrame(items, "item_id bigint, text string"))
    got = decontaminate.find_leaks(df, bench, shard_words=shard_words, block=block).collect()
    spans = Counter((r.id, r.n_words, tuple(i for s in r.spans for i in range(s["from"], s["to"])), tuple(r["items"]))
                    for r in got)
    assert spans == plain_leaks(docs, items)
    assert decontaminate.find_leaks(df.limit(0), bench).collect() == []
    alone = decontaminate.find_leaks(df, bench.limit(0)).collect()
    assert len(alone) == len(docs) and all(r.spans == [] and r["items"] == [] for r in alone)


def test_fm_index_finds_every_place():
    rng = np.random.default_rng(4)
    text = np.concatenate([rng.integers(1, 5, 700), np.tile([2, 3, 1], 200), [0]]).astype(np.int32)
    order = decontaminate.suffix_array(text)
    assert [text[i:].tolist() for i in order] == sorted(text[i:].tolist() for i in range(len(text)))
    index = decontaminate.Fm.read(*decontaminate.index_parts(text))
    for length in (1, 2, 5):
        phrases = rng.integers(1, 5, (40, length))
        low, high = index.search(phrases)
        for phrase, a, b in zip(phrases, low, high):
            want = [i for i in range(len(text)) if text[i:i + length].tolist() == phrase.tolist()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_odd_rows(spark):
    edges = clashing(spark.createDataFrame(EDGES, DOCS))
    assert len(decontaminate.find_leaks(edges, edges, item_col="doc_id").collect()) == len(EDGES)
    variants.group_variants(edges).collect()
