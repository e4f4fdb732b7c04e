"""Registered queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.byte_bpe import encode_decode
from corpusflow.llm.common import with_small_batches
from corpusflow.llm.cover_search import top_products
from corpusflow.llm.exact_dedup import exact_dedup
from corpusflow.llm.language_id import language_id, model_of
from corpusflow.llm.license_scan import license_scan
from corpusflow.llm.line_dedup import line_dedup
from corpusflow.llm.packing import pack
from corpusflow.llm.periodic import periodic_runs
from corpusflow.llm.simhash import near_duplicates
from corpusflow.llm.spelling import spelling_variants
from corpusflow.llm.token_counts import token_counts
from corpusflow.llm.toxicity import model_of as toxicity_model
from corpusflow.llm.toxicity import toxicity
from corpusflow.llm.warc import warc_round_trip
from corpusflow.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(with_small_batches(prepare(spark)), folder)
        if sql:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op10_exact_dedup",
    """
    with t as (select doc_id, coalesce(text, '') as body from documents)
    select doc_id, max(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
           doc_id = max(doc_id) over (partition by body) as kept, sha256(body) as text_sha256
    from t
    """,
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op1_license_scan")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan(table(spark, folder, "documents"))
    return found.withColumn("spans", F.to_json("spans"))


@query("op2_language_id")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language_id(docs.select("doc_id", "text"), model_of(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score", "n_spans")


@query(
    "op3_warc_index",
    """
    with t as (select page_id, encode(coalesce(html, '')) as body from pages),
    g as (select *, sha1(body) as hexed, min(page_id) over (partition by body) as first from t),
    w as (select *, list_transform(range(8), lambda i: ('0x' || substr(hexed, 5 * i + 1, 5))::bigint) as groups from g)
    select page_id, octet_length(body) as payload_bytes,
           list_aggregate(list_transform(range(32), lambda j:
               substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((groups[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31) + 1, 1)),
               'string_agg', '') as payload_digest,
           case when page_id = first then 'response' else 'revisit' end as record_type,
           case when page_id <> first then first end as refers_to
    from w
    """,
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = warc_round_trip(table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_byte_bpe")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_decode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


@query("op5_best_fit_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(
    "op6_line_dedup",
    r"""
    with t as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as line_no from documents),
    k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line_key from t),
    often as (select line_key, max(doc_id) as last from k where length(line_key) >= 40
              group by line_key having count(distinct doc_id) >= 5),
    f as (select k.*, often.last is not null and k.doc_id < often.last as gone from k left join often using (line_key))
    select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by line_no) filter (not gone), '')) as kept_sha256
    from f group by doc_id
    """,
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


@query("op7_token_counts")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query(
    "op8_exact_topk",
    """
    with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
               where embedding is not null),
    s as (select q.vec_id as query_id, d.vec_id as vec_id, list_inner_product(q.e, d.e)::bigint as score
          from v q join v d on q.vec_id % 100 = 0 and q.vec_id <> d.vec_id),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
    select query_id, rank, vec_id, score from r where rank <= 10
    """,
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return top_products(table(spark, folder, "embeddings"))


@query("op9_simhash_near_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id", "kept")


@query(
    "op11_spelling_variants",
    r"""
    with recursive crc(t) as (
        select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
               lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end))),
    runs as (
        select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents),
    once as (select doc_id, run, count(*) as k, hex(encode(concat(doc_id, ':', run))) as digits from runs
             where length(run) >= 7 group by all),
    hashed as (
        select run, k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(digits) // 2),
               lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::bigint)),
               lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) as h from once, crc),
    lost as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2)
                    else run end as word, k from hashed),
    w as materialized (select word, sum(k)::bigint as n from lost where length(word) >= 7 group by word having sum(k) >= 2),
    d as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
                       from w, unnest(range(1, length(word) + 1)) as u(i)),
    pairs as (
        select a.word as a, a.n as an, b.word as b, b.n as bn from d a join d b on a.rest = b.rest and a.i = b.i and a.word <> b.word
        union select w.word, w.n, d.word, d.n from w join d on w.word = d.rest
        union select d.word, d.n, w.word, w.n from w join d on w.word = d.rest),
    best as (select a as word, count(*) as n_near, max(bn) as most from pairs group by a),
    f as materialized (
        select w.word, w.n, coalesce(n_near, 0) as n_near, case when most >= 10 * w.n then most end as form_n,
               case when most >= 10 * w.n then (select min(b) from pairs where a = w.word and bn = most) end as form
        from w left join best using (word)),
    chain(word, here) as (
        select word, word from f union all
        select c.word, f.form from chain c join f on c.here = f.word where f.form is not null)
    select f.word, f.form, chain.here as root, f.n, f.n_near, f.form_n
    from f join chain on f.word = chain.word join f tip on chain.here = tip.word and tip.form is null
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))


@query("op12_toxicity")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity(docs, toxicity_model(docs, table(spark, folder, "labels").select("doc_id", "toxic")))


@query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs(table(spark, folder, "documents"), repeat_tails=True).drop("runs")
