"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete_at_exit, fresh_path
from . import chat_format, media, near_dedup, packing, pii, quality, sentencepiece_ops, shards, suffix_dedup, topk
from .common import table

#: The extra conversation of op3's contract: what both of its rows say.
TRICKY = r"\### Assistant: </turn> ok"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file is; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"), words=3, percent=85)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return chat_format.digests(chat_format.format_conversations(rows.unionByName(extra)))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_ops.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in eight parts, are stored, compacted and read back from the newest version."""
    docs = table(spark, sf_dir, "documents").withColumn("arrival", F.coalesce(F.pmod("doc_id", F.lit(8)), F.lit(0)).cast("int"))
    root = fresh_path(spark, "store")
    delete_at_exit(spark, root)
    store = shards.shard(docs, F.col("arrival"), root)
    text = F.coalesce("text", F.lit(""))
    return store.read().select("doc_id", "arrival", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.documents_as_media(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_minhash": op2_minhash,
    "op3_chat_format": op3_chat_format,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_sharding": op7_sharding,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_media_columns": op9_media_columns,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_minhash": r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), sets as (
  select doc_id, list_distinct(case when len(w) = 0 then cast([] as varchar[]) when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from words
), shingles as (select doc_id, unnest(s) as g from sets),
common as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select a as doc, a as other from both_ways union select reach.doc, both_ways.b from reach join both_ways on reach.other = both_ways.a),
lowest as (select doc, min(other) as low from reach group by doc)
select doc_id, cast(len(s) as bigint) as n_shingles, coalesce(low, doc_id) as component_id, doc_id = coalesce(low, doc_id) as kept
from sets left join lowest on doc = doc_id""",
    # The template's lengths: "### ", ": " and " </turn>\n" are 15 characters a turn; "###" and "</turn>" become two characters each.
    "op3_chat_format": r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns as (
  select *, replace(replace(text, '###', '\h'), '</turn>', '\c') as light from rows
), shown as (
  select *, case when text = light and text = replace(replace(replace(text, '\c', '</turn>'), '\h', '###'), '\b', '\') then text
                 when replace(replace(replace(light, '\c', '</turn>'), '\h', '###'), '\b', '\') = text then light
                 else replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\c') end as body
  from turns
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(15 + length(role) + length(body)) as bigint) as formatted_chars
from shown group by conv_id""",
    "op5_exact_top_k": """
with vectors as (
  select vec_id, list_transform(embedding, lambda c: cast(floor(64 * cast(c as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
), scored as (
  select q.vec_id as query_id, x.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i])) as bigint) as score
  from vectors q join vectors x on q.vec_id % 20 = 0 and q.vec_id <> x.vec_id and len(q.v) = len(x.v)
), ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 20""",
    "op7_sharding": """
select doc_id, cast(coalesce((doc_id % 8 + 8) % 8, 0) as integer) as arrival, cast(strlen(coalesce(text, '')) as bigint) as n_bytes,
       sha256(coalesce(text, '')) as text_sha256
from documents""",
}
