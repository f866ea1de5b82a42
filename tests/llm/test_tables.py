"""WARC, mixing, sharding, vector searches, components and the pipeline."""

import base64
import gzip
import hashlib
import io
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hostwin.llm import caps, common, graph_ann, mixing, sharding, simhash, warc
from hostwin.llm.components import connected_components
from hostwin.llm.queries import QUERIES
from hostwin.session import pin, scratch_path
from tests.llm.test_texts import DOCS, EDGES, clashing


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# WARC

PAGES = [(3, "http://a\r\nX: 1", "<p>one</p>"), (1, None, "<p>one</p>"), (2, "http://c", None), (5, "http://d", ""),
         (5, "http://d", ""), (None, "http://e", "<p>one</p>"), (None, None, "alone"), (7, "http://g", "é\r\n\r\n" * 99_999)]


def archived(spark, pages, **options):
    marked = warc.mark_revisits(pages, **options)
    return pin(warc.write_archives(marked, scratch_path(spark, "warc"), archive_bytes=600))


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    listed = archived(spark, pages.withColumn("payload", F.lit(1)).withColumn("_salt", F.lit(2)))
    rows = warc.read_archives(listed).withColumns({
        "page_id": warc.page_number("record_id"), "first": warc.page_number("refers_to")}).collect()
    assert len(rows) == len(PAGES) == sum(r.records for r in listed.collect())
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.page_id].append(r)
    assert by_id[1][0].record_type == "response" and by_id[1][0].payload == b"<p>one</p>"
    assert (by_id[3][0].record_type, by_id[3][0].first, by_id[3][0].payload) == ("revisit", 1, None)
    assert by_id[2][0].payload == b"" and [(r.record_type, r.first) for r in by_id[5]] == [("revisit", 2)] * 2
    assert sorted((r.first or 0, r.record_type) for r in by_id[None]) == [(0, "response"), (1, "revisit")]
    assert by_id[7][0].payload == ("é\r\n\r\n" * 99_999).encode()
    for r in rows:
        if r.payload is not None:
            assert r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
            assert r.payload_bytes == len(r.payload)
    assert by_id[3][0].payload_bytes == 10 and by_id[3][0].target_uri == "http://a%0D%0AX: 1"


def test_each_record_is_a_gzip_member(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    total = 0
    for row in archived(spark, pages).collect():
        store, at = warc.open_store(row.path)
        data = store.open_input_stream(at, compression=None).read()
        members = list(warc.read_members(io.BytesIO(data)))
        assert b"".join(members) == gzip.decompress(data) and len(members) == row.records
        total += len(members)
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_members(io.BytesIO(data[:-9])))
    assert total == len(PAGES)


def test_damaged_records_are_refused():
    good = zlib.decompress(warc.encode_record("urn:page:1", "u", b"payload", None, "d"), 31)
    assert warc.parse_record(good)["payload"] == b"payload"
    for bad in (good.replace(b"payload\r\n", b"Payload\r\n"), good[:-1], good + b"x", b"WARC", b"HTTP\r\n\r\n"):
        with pytest.raises((ValueError, KeyError)):
            warc.parse_record(bad)


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    marked = {r.page_id: r.refers_to for r in warc.mark_revisits(pages, least_bytes=5).collect()}
    assert marked[3] == 1 and marked[5] is None
    assert warc.read_archives(archived(spark, pages.limit(0))).collect() == []


# Mixing

def test_raked_marginals_meet_their_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cells = pin(mixing.labelled(docs).groupBy(*mixing.DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    targets = {d: pin(mixing.tempered(cells, d, 0.5)) for d in mixing.DIMENSIONS}
    raked = mixing.rake(cells, targets, rounds=30).toPandas()
    for d, target in targets.items():
        want = target.toPandas().set_index(d)["target"]
        got = raked.groupby(d)["weight"].sum()
        assert np.allclose(got[want.index], want, rtol=0.02)
    odds = mixing.calibrated(spark.createDataFrame(raked), keep=0.5).toPandas()
    assert odds["probability"].between(0, 1).all()
    assert math.isclose((odds["probability"] * odds["tokens"]).sum(), 0.5 * odds["tokens"].sum(), rel_tol=1e-6)


def test_mixing_edges(spark, edges, none):
    rows = mixing.mix_documents(clashing(edges), rounds=2).collect()
    assert len(rows) == len(EDGES) and {r.source for r in rows} == {"", "s"}
    assert len({r.draw for r in rows if r.id == 4}) == 1
    assert mixing.mix_documents(none, rounds=1).collect() == []
    kept = mixing.keep_mixed(clashing(edges), rounds=2)
    assert sorted(kept.columns) == sorted(clashing(edges).columns)
    want = Counter(r.id for r in rows if r.kept)
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_mixing_uses_no_python(spark, edges):
    plan = mixing.mix_documents(edges, rounds=1)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# Sharding

def check_shards(rows, docs, shards=16):
    assert Counter(r.id for r in rows) == Counter(d for d, _ in docs)
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_shards_are_even_and_keep_copies_together(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").union(
        spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1_000_000))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.assign_shards(docs).collect()
    check_shards(rows, texts.items())
    homes = defaultdict(set)
    for r in rows:
        text = texts[r.id] or ""
        homes[text].add(r.shard)
        assert r.size == len(text.encode()) + 1 and r.text_crc32 == zlib.crc32(text.encode())
        assert r.tokens == len([w for w in text.split() if w])
    assert all(len(h) == 1 for h in homes.values())
    for measure in (lambda r: r.size, lambda r: r.tokens, lambda r: 1):
        load = np.bincount([r.shard for r in rows], [measure(r) for r in rows], 16)
        assert load.max() < 1.25 * load.mean()


def test_packing_places_by_residual_capacity():
    rng = np.random.default_rng(1)
    items = np.column_stack([rng.lognormal(3, 1, 4000), rng.lognormal(2, 1, 4000), np.ones(4000)])
    chosen = sharding.place(items, 16)
    for d in range(3):
        load = np.bincount(chosen, items[:, d], 16)
        assert load.max() / load.mean() < 1.02
    assert sharding.place(np.array([[1.0, 0], [0, 1.0]]), 2).tolist() == [0, 0]  # they fill different dimensions
    assert sharding.place(np.zeros((0, 3)), 4).tolist() == []


def test_hot_group_is_split(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    check_shards(got, rows)
    load = np.bincount([r.shard for r in got], minlength=16)
    assert load.max() < 1.3 * load.mean()


def test_sharding_edges(edges, none):
    rows = sharding.assign_shards(clashing(edges)).collect()
    check_shards(rows, [(e[0], e[1]) for e in EDGES])
    assert {r.size for r in rows if r.id == 1} == {1} and {r.text_crc32 for r in rows if r.id == 1} == {0}
    assert sharding.assign_shards(none).collect() == []


# Vectors

VECTORS = "vec_id bigint, embedding array<float>, label int"


def odd_vectors(dim=8):
    one = [1.0] + [0.0] * (dim - 1)
    nan, inf = float("nan"), float("inf")
    return [(100, None, 1), (101, [0.0] * dim, 1), (102, [nan] + one[1:], 1), (103, [inf] + one[1:], 1),
            (104, [None] + one[1:], 1), (105, [], 1), (106, one, None), (None, one, 1), (108, one, 1), (108, one, 1),
            (109, [-x for x in one], 1), (110, one, 2), (111, one + [0.0], 1)]


def clouds(n=300, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.25 * rng.standard_normal((n, dim))
    return [(int(i), [float(v) for v in np.float32(row)], int(i % 2)) for i, row in enumerate(x)]


def plain_links(rows):
    """n_links and component of each position, comparing all pairs."""
    ok = [e is not None and len(e) > 0 and None not in e and np.isfinite(e).all() and any(e) and label is not None
          for _, e, label in rows]
    near = defaultdict(set)
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows):
            if i != j and ok[i] and ok[j] and la == lb and len(a) == len(b):
                a_, b_ = np.array(a, float), np.array(b, float)
                if a_ @ b_ / np.linalg.norm(a_) / np.linalg.norm(b_) >= 0.93:
                    near[i].add(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids) if ids else None))
    return out


@pytest.mark.parametrize("most", [2048, 5])
def test_cap_filters_find_all_links(spark, most):
    rows = clouds() + odd_vectors()
    df = spark.createDataFrame(rows, VECTORS).withColumn("node", F.lit("x")).withColumn("filter", F.lit("x"))
    got = caps.near_vectors(df, recall=1 - 1e-15, most=most).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted([(r.id, r.n_links, r.component) for r in got], key=key) == sorted(plain_links(rows), key=key)
    assert all(r.kept == (r.id == r.component) for r in got if r.id is not None)
    assert caps.near_vectors(df.limit(0)).collect() == []


def test_list_decoding_is_whole():
    x = np.random.default_rng(2).standard_normal((50, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plan = caps.CapPlan(12, 3, 7, 0.4, rounds=2)
    rotation, parts, words = caps.code_words(plan, 1)
    assert np.allclose(rotation @ rotation.T, np.eye(12))
    row, code = caps.list_decode(x, plan)
    row, code = row[code >= 343], code[code >= 343] - 343  # the second round
    want = set()
    for a in range(7):
        for b in range(7):
            for c in range(7):
                line = np.concatenate([w[k] for w, k in zip(words, (a, b, c))]) / math.sqrt(3)
                want |= {(int(i), (a * 7 + b) * 7 + c) for i in np.flatnonzero(x @ rotation @ line >= 0.4)}
    assert set(zip(row.tolist(), code.tolist())) == want


def test_planned_recall_holds():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    plan = caps.plan_caps(20_000, 64, 0.93)
    sets = [defaultdict(set), defaultdict(set)]
    for own, v in zip(sets, (x, y)):
        for r, f in zip(*caps.list_decode(v, plan)):
            own[r].add(f)
    assert np.mean([bool(sets[0][i] & sets[1][i]) for i in range(1500)]) > 0.99


def exact_nearest(rows, k=20):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(ids[j], score[j]) for j in order]
    return out


def test_graph_search_recall(spark, sf):
    data = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in data.collect()]
    want = exact_nearest(rows)
    index = pin(graph_ann.build_index(data, shard_rows=100))
    asked = graph_ann.usable_rows(data, "vec_id", "embedding").filter("id % 20 = 0")
    got = defaultdict(list)
    for r in graph_ann.search_index(index, asked, width=48).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) > 0.95
    scores = {q: {i: s for i, s in exact_nearest(rows, k=10**6)[q]} for q in list(want)[:3]}
    for q, own in scores.items():
        assert all(math.isclose(own[i], s, rel_tol=1e-12) for i, s in got[q])


def test_graph_search_edges(spark):
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(30)] + [(40, [9.0, 0.0, 0.0], 0), (41, [0.0, 0.0, 1.0], 0)]
    rows += [(i, e, la) for i, e, la in odd_vectors(3)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("node", F.lit("x")).withColumn("query", F.lit(1))
    got = defaultdict(list)
    for r in graph_ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 20, 40}
    assert [(r, i) for r, i, _ in got[0]] == [(i, i) for i in range(1, 21)]  # equal vectors, by id
    assert [i for _, i, _ in got[20]] == list(range(20)) and got[20][0][2] == 14.0
    assert [(i, s) for _, i, s in got[40]] == [(i, 9.0) for i in range(20)]
    wide = {r.vec_id for r in graph_ann.nearest(df, k=40).filter("query_id = 40").collect()}
    assert wide == {*range(30), 41, 106, 108, 109, 110}
    assert graph_ann.nearest(df.limit(0)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 1.0], 0), (1, [2.0, 0.0], 0)], VECTORS)
    assert [(r.query_id, r.vec_id, r.score) for r in graph_ann.nearest(few).collect()] == [(0, 1, 2.0)]


def test_robust_prune_keeps_diverse_neighbours():
    x = np.array([[0.0, 0], [1, 0], [1.1, 0], [0, 2], [5, 5]])
    pool = np.array([[1, 2, 3, 4, -1, 1]])
    assert graph_ann.robust_prune(x, np.array([0]), pool, 3, 1.2).tolist() == [[1, 3, -1]]


# Shared parts

def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 260)] + [(7, i) for i in range(1000, 1400)] + [(5, 5), (None, 3), (9, 8)]
    links += links[:50] + [(b, a) for a, b in links[:50] if b]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "src bigint, dst bigint")).collect()}
    want = {i: 100 for i in range(100, 261)} | {i: 7 for i in [7, *range(1000, 1400)]} | {9: 8, 8: 8}
    assert got == want


def test_runs_cross_batches():
    batches = [pa.RecordBatch.from_pydict({"k": k, "v": list(range(len(k)))}) for k in ([1, 1, 2], [2, 2], [], [2, 3], [4])]
    got = [(g.column(0)[0].as_py(), g.num_rows) for g in common.runs(
        [b if b.num_rows else batches[0].slice(0, 0) for b in batches], "k")]
    assert got == [(1, 2), (2, 4), (3, 1), (4, 1)]


@pytest.mark.parametrize("most", [3, 100])
def test_chunks_bring_every_two_rows_together_once(spark, most):
    df = spark.createDataFrame([(k, m) for k in range(3) for m in range(10 * k + 1)], "key bigint, member bigint")
    rows = common.chunk_pairs(df, "key", "member", most).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.bucket].append(r)
    met = Counter()
    for own in groups.values():
        assert len({r.within for r in own}) == len({r.key for r in own}) == 1
        for i, a in enumerate(own):
            for b in own[:i]:
                if a.within or a.side != b.side:
                    met[a.key, frozenset((a.member, b.member))] += 1
    assert set(met.values()) == {1} and len(met) == 11 * 10 // 2 + 21 * 20 // 2


def test_attach_keeps_every_row(spark):
    df = spark.createDataFrame([(i, 1 if i % 3 else None) for i in range(50)] + [(99, 5)], "id bigint, k bigint")
    got = common.attach(df, spark.createDataFrame([(1, "one")], "k bigint, fact string"), "k").collect()
    assert Counter((r.id, r.fact) for r in got) == Counter(
        [(i, "one" if i % 3 else None) for i in range(50)] + [(99, None)])


# Pipeline

def groups_by_similarity(texts, least=0.8):
    """The smallest id reachable by pairs of texts with a five-word Jaccard similarity of ``least``, all pairs compared."""
    root, sets = {i: i for i in texts}, {}
    for i, t in texts.items():
        words = [w.decode() for w in (t or "").encode().lower().split()]
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if not either or both / either >= least:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in ids}


def test_stages_decide_as_the_operators_do(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = pin(stage(spark, docs, sf))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    texts = {r.doc_id: r.text for r in seen["language"].collect()}
    whole = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(texts) > 0.95 * whole
    groups = groups_by_similarity(texts)
    assert {r.doc_id for r in seen["near_duplicates"].collect()} == set(groups.values())
    clean = {r.doc_id: r.text for r in seen["secrets"].collect()}
    assert set(clean) == set(groups.values())
    from hostwin.llm.secrets import base_spans
    assert not any(base_spans(t) for t in clean.values())
    assert all(clean[i] == texts[i] for i in clean if not base_spans(texts[i]) and "[secret]" not in clean[i])
    mixed = {r.id: r.kept for r in mixing.mix_documents(seen["secrets"]).collect()}
    kept = {r.doc_id for r in seen["mixture"].collect()}
    assert kept == {i for i, k in mixed.items() if k} and len(kept) > 0.6 * len(mixed)
    assert {r.doc_id for r in seen["packing"].collect()} == kept
    key = lambda rows: sorted(tuple(r) for r in rows)
    assert key(corpus_pipeline.run(spark, sf).collect()) == key(seen["packing"].collect())


def test_stages_take_odd_rows(spark, edges, none):
    for table in (edges, none):
        docs = clashing(table)
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = pin(stage(spark, docs, None))
            assert name == "packing" or sorted(docs.columns) == sorted(names)


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 11))
    assert simhash.BITS == 64
