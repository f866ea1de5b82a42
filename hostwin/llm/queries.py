"""One registered query per operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostwin.llm import mixing
from hostwin.llm.caps import near_vectors
from hostwin.llm.codes import compress
from hostwin.llm.common import read_table
from hostwin.llm.decontaminate import find_leaks
from hostwin.llm.graph_ann import nearest
from hostwin.llm.langid import identify_held_out
from hostwin.llm.lattice import score_documents
from hostwin.llm.packing import pack
from hostwin.llm.secrets import KINDS, find_secrets, written
from hostwin.llm.sharding import assign_shards
from hostwin.llm.simhash import hex_print, near_duplicates
from hostwin.llm.variants import group_variants
from hostwin.llm.warc import (
    mark_revisits, page_number, read_archives, write_archives)
from hostwin.session import pin, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query under the name of its function."""
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file(name: str) -> str:
    """A vocabulary of the public tokenizers, which every machine has installed."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = find_secrets(read_table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")

    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("random"))
    return found.select(F.col("id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back."""
    pages = mark_revisits(read_table(spark, sf_dir, "pages"))
    archives = pin(write_archives(pages, scratch_path(spark, "warc")))
    return read_archives(archives, payloads=False).select(
        page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_number("refers_to").alias("refers_to"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens, along the curve."""
    pieces = pack(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"),
                  with_ids=False)
    return pieces.withColumnRenamed("id", "doc_id")


@query
def op4_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every 20th vector."""
    return nearest(read_table(spark, sf_dir, "embeddings"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its raked sampling probability and decision."""
    # The SQL beside it states probabilities of at most 1.
    mixed = mixing.mix_documents(read_table(spark, sf_dir, "documents"), repeats=False)
    return mixed.select(F.col("id").alias("doc_id"), *mixing.DIMENSIONS, "tokens",
                        F.round("probability", 9).alias("probability"),
                        F.round("draw", 9).alias("draw"), "kept")


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with fingerprint and near-duplicate component."""
    groups = near_duplicates(read_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), hex_print("fp").alias("fingerprint"),
                         F.col("component").alias("component_id"))


@query
def op7_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with their number of near-duplicates and component."""
    return near_vectors(read_table(spark, sf_dir, "embeddings")).select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


@query
def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the subword lattice, beside the add-one base and a mixture."""
    scored = score_documents(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
                         F.col("lattice_score").alias("score"), F.col("score").alias("mixture_score"))


@query
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return identify_held_out(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards that are even in bytes, tokens and rows."""
    placed = assign_shards(read_table(spark, sf_dir, "documents"))
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"),
                         "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


@query
def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words with the more frequent word that they are a variant of."""
    return group_variants(read_table(spark, sf_dir, "documents"))


@query
def op12_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the words and items of the benchmark that they repeat."""
    found = find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["to"] - s["from"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["from"], s["to"])), ",").alias("spans"))


@query
def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every vector by exact integer codebooks."""
    return compress(read_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for each query of this package that SQL can express."""
    return {"op2_warc": WARC_SQL, "op5_mixing": mixing.oracle(), "op7_caps": CAPS_SQL, "op11_variants": VARIANTS_SQL,
            "op12_fm_index": LEAKS_SQL, "op13_codes": codes_sql()}


LEAKS_SQL = """
with d as materialized (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark where text is not null),
g as materialized (select distinct item, least(10, len(w)) as k, w[i:i + least(10, len(w)) - 1] as win
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0) s),
p as (select r, k, i, w[i:i + k - 1] as win from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i
  from d, (select distinct k from g) ks) s),
o as materialized (select r, item, i, p.k as k from p join g on p.k = g.k and p.win = g.win),
h as (select r, count(*) as n_hit from (select distinct r, unnest(range(i, i + k)) as pos from o) s group by r),
t as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from o) s group by r),
s as (select r, string_agg(a || ':' || z, ',' order by a) as spans from (select r, min(pos) - 1 as a, max(pos) as z from (
  select r, pos, pos - row_number() over (partition by r order by pos) as island from (select distinct r, unnest(range(i, i + k)) as pos from o) x) y
  group by r, island) z group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated, coalesce(spans, '') as spans
from d left join h using (r) left join t using (r) left join s using (r)
"""


# The crc32 by half bytes: each step looks up the rest of a half byte under the reversed polynomial.
VARIANTS_SQL = """
with recursive t as (select list(reduce(range(4), lambda r, x: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end, v)
  order by v) as t from (select v::bigint as v from range(16) n(v)) s),
r as materialized (select doc_id, run, count(*) as n from (select doc_id, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents) s group by all),
b as (select doc_id, run, n, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x, t from r, t),
h as (select run, n, xor(list_reduce(list_transform(range(1, len(x) + 1),
  lambda i: (strpos('0123456789ABCDEF', substr(x, (case when i % 2 = 1 then i + 1 else i - 1 end)::int, 1)) - 1)::bigint),
  lambda c, v: xor(c >> 4, t[xor(c & 15, v) + 1]), 4294967295::bigint), 4294967295) as h from b),
w as materialized (select word, sum(n)::bigint as n from (select n, case when h % 199 = 0 then
  substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from h) s
  where length(word) >= 6 group by word having sum(n) >= 5),
d as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as cut
  from (select word, n, unnest(range(1, length(word) + 1))::int as i from w) s),
p as materialized (select distinct a.word, b.word as near, b.n as near_n from d a join d b
   on a.cut = b.cut and a.i = b.i and a.word <> b.word
  union select d.word, w.word, w.n from d join w on d.cut = w.word
  union select w.word, d.word, d.n from d join w on d.cut = w.word),
g as (select word, count(*) as n_near, min({'less': -near_n, 'near': near}) as best from p group by word),
f as materialized (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near,
  case when -best.less >= 5 * w.n then best.near end as form, case when -best.less >= 5 * w.n then -best.less end as form_n
  from w left join g using (word)),
c as (select word, word as root, form as next from f union all select c.word, f.word, f.form from c join f on c.next = f.word)
select word, form, root, n, n_near, form_n::bigint as form_n from f join c using (word) where c.next is null
"""


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The codebooks round by round, over all parts and entries."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
a{n} as materialized (select r, p, min({{'d': d, 'e': e}}) as best from (select x.r, x.p, b.e,
  list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i])))::bigint as d
  from x join b{n} b on x.p = b.p) group by r, p)""")
        if n < rounds:
            steps.append(f"""
m{n} as (select p, e, list(m order by i) as v from (select x.p, a.best.e as e, i, floor(sum(x.v[i])::double / count(*))::bigint as m
  from x join a{n} a on x.r = a.r and x.p = a.p, range(1, 1 + (select max(len(v)) from x)) t(i) group by all) group by p, e),
b{n + 1} as materialized (select b.p, b.e, coalesce(m.v, b.v) as v from b{n} b left join m{n} m on b.p = m.p and b.e = m.e)""")
    return f"""
with k as materialized (select row_number() over (order by vec_id) as r, vec_id, label,
  list_transform(embedding, lambda x: floor(x::double * 4096)::bigint) as v from embeddings where embedding is not null
  and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as materialized (select r, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] as v from k, range({parts}) t(p)),
b0 as (select p, (r - 1)::int as e, v from x where r <= {entries}),{','.join(steps)},
o as (select r, string_agg(printf('%02x', best.e), '' order by p) as code, sum(best.d)::bigint as error from a{rounds} group by r),
s as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as sha from b{rounds})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select sha from s) as codebooks_sha256
from k join o using (r)"""


WARC_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload)::bigint as payload_bytes, sha1(payload) as hex from p),
n as (select *, min(page_id) over (partition by hex) as first from d),
-- Hexadecimal digits become five-bit groups, and these the letters of base32.
b as (select *, list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || substr(hex, i::int, 1))::int), 4, '0')),
 'string_agg', '') as bits from n)
select page_id, payload_bytes,
 list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + list_sum(list_transform(range(0, 5), lambda j: substr(bits, 5 * i + j + 1, 1)::int * (16 >> j::int)))::int, 1)),
  'string_agg', '') as payload_digest,
 case when page_id = first then 'response' else 'revisit' end as record_type,
 case when page_id <> first then first end as refers_to from b
"""

CAPS_SQL = """
with recursive v as (select row_number() over () as r, vec_id, label, embedding::double[] as e from embeddings),
u as (select *, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v
 where label is not null and e is not null and len(e) > 0
 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as materialized (select a.r as src, b.r as dst, b.vec_id as other from u a join u b
 on a.label = b.label and len(a.e) = len(b.e) and a.r <> b.r
 where list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach as (select r as src, r as dst from v union select reach.src, links.dst from reach join links on reach.dst = links.src),
least as (select src, min(vec_id) as component_id from reach join v on v.r = reach.dst group by src),
n as (select src, count(*) as n_links from links group by src)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from v join least on least.src = v.r left join n on n.src = v.r
"""
