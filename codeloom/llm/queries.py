"""One thin query per operator, over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, embed, exact, htmlx, langid, packing, passages, secrets, simhash, suffix, toxicity, variants, whiten
from codeloom.llm.common import fold_of
from codeloom.session import read_table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), tokenizer()).drop("same")


@query
def op2_embedding_dedup(spark, sf_dir):
    return embed.near_vectors(read_table(spark, sf_dir, "embeddings"), 0.93)


@query
def op3_suffix_dedup(spark, sf_dir):
    return suffix.remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


@query
def op4_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_simhash(spark, sf_dir):
    out = simhash.simhash_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op6_packing(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer()).drop("padded_to")


@query
def op7_secrets(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query
def op8_html_text(spark, sf_dir):
    out = htmlx.extract(read_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op9_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    out = langid.identify(docs)
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op10_exact_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query
def op11_passage_dedup(spark, sf_dir):
    return passages.remove_passages(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op12_spelling_variants(spark, sf_dir):
    return variants.spelling_variants(read_table(spark, sf_dir, "documents"))


@query
def op13_whitening(spark, sf_dir):
    out = whiten.whiten(read_table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


ORACLE["op10_exact_dedup"] = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
"""

ORACLE["op2_embedding_dedup"] = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
),
ok as (
  select * from v where label is not null and e is not null and not list_contains(list_transform(e, lambda x: x is null or not isfinite(x)), true)
    and coalesce(list_sum(list_transform(e, lambda x: x * x)), 0) > 0
),
link as (
  select a.vec_id as a, b.vec_id as b from ok a join ok b
  on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.93
),
reach(n, r) as (
  select vec_id, vec_id from v union select reach.n, link.b from reach join link on reach.r = link.a
)
select v.vec_id, count(distinct l.b) as n_links, (select min(r) from reach where n = v.vec_id) as component_id,
       v.vec_id = (select min(r) from reach where n = v.vec_id) as kept
from v left join link l on l.a = v.vec_id group by v.vec_id
"""

ORACLE["op11_passage_dedup"] = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
start as (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d),
win as (select doc_id, i, array_to_string(w[i : i + 12], ' ') as s from start),
first as (select s, min(doc_id) as m from win group by s),
gone as (select distinct doc_id, i + k as p from win join first using (s), range(13) r(k) where m < doc_id),
word as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as p from d),
kept as (select doc_id, count(*) as n, string_agg(x, ' ' order by p) as t from word anti join gone using (doc_id, p) group by doc_id)
select d.doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)
"""

LETTERS = "".join(map(chr, range(0xC0, 0x100)))
# DuckDB measures distances in bytes: each accented letter becomes one byte that no word holds.
BYTES = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.islower() and c not in "'")[:64]

ORACLE["op12_spelling_variants"] = f"""
with recursive
crc as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i)) as t),
run as (
  select coalesce(doc_id::varchar, '') || ':' as id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w, count(*) as m
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as r from documents) group by all
),
coded as (
  select w, m, flatten(list_transform(string_split(id || w, ''), lambda c: case when ord(c) < 128 then [ord(c)] else [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] end)) as bytes
  from run
),
hashed as (
  select w, m, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) as h from coded, crc
),
word as (
  select case when h % 97 = 0 then left(w, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, sum(m)::bigint as n
  from hashed group by 1 having length(word) >= 5 and n >= 3
),
less as (
  select word, n, word as v from word
  union select word, n, left(word, i::int) || substr(word, i::int + 2) from (select word, n, unnest(range(length(word))) as i from word)
),
near as (
  select distinct a.word, a.n, b.word as other, b.n as m from less a join less b using (v)
  where a.word <> b.word and levenshtein(translate(a.word, '{LETTERS}', '{BYTES}'), translate(b.word, '{LETTERS}', '{BYTES}')) = 1
),
best as (select word, count(*) as n_near, arg_min(struct_pack(other, m), struct_pack(m := -m, other := encode(other))) as b from near group by word),
form as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when b.m >= 2 * w.n then b.other end as form, case when b.m >= 2 * w.n then b.m end as form_n
  from word w left join best using (word)
),
chain(word, last) as (
  select word, word from form union all select chain.word, form.form from chain join form on chain.last = form.word where form.form is not null
)
select f.word, f.n, f.form, f.form_n, c.last as root, f.n_near
from form f join chain c on c.word = f.word join form e on e.word = c.last and e.form is null
"""
