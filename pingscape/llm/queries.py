"""Registered queries of the operators on texts, vectors and conversations, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment, chat, decontamination, licenses, near_dedup, negatives, packing, sharding, simhash, substring_dedup, tokens, topk, toxicity,
)
from .frames import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_decontamination")
def decontamination_query(spark, folder):
    found = decontamination.contamination(spark, table(spark, folder, "documents"), table(spark, folder, "benchmark"), size=10)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


@query("op2_substring_dedup")
def substring_dedup_query(spark, folder):
    cut = substring_dedup.dedup_substrings(spark, table(spark, folder, "documents"), size=35)
    return cut.select("rest.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_exact_top_k", sql="""
    with v as (
        select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
        from embeddings
        where embedding is not null and len(embedding) = len(list_filter(embedding, lambda x: x is not null and isfinite(x)))
    ), scored as (
        select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
        from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
    ), ranked as (
        select *, row_number() over (partition by query_id order by score desc, vec_id) as place from scored
    )
    select query_id, cast(place as integer) as rank, vec_id, score from ranked where place <= 5
""")
def top_k_query(spark, folder):
    return topk.top_k(spark, table(spark, folder, "embeddings"), k=5, every=50, scale=256)


@query("op4_license_scan")
def license_scan(spark, folder):
    return licenses.license_scan(table(spark, folder, "documents"))


@query("op5_chat_format")
def chat_format(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(chat.probe(spark))
    return chat.read_back(chat.format_turns(turns))


@query("op6_best_fit_packing")
def packing_query(spark, folder):
    return packing.pack(spark, table(spark, folder, "documents"), tokenizer_path(), size=2048, end=0)


@query("op7_near_duplicates")
def near_duplicates_query(spark, folder):
    return near_dedup.near_duplicates(spark, table(spark, folder, "documents"), width=5, percent=75).drop("text_key")


@query("op8_token_counts")
def token_counts(spark, folder):
    return tokens.token_counts(table(spark, folder, "documents"), tokenizer_path(), limit=1024)


@query("op9_sharding")
def shards(spark, folder):
    return sharding.shards(table(spark, folder, "documents"), count=16)


@query("op10_toxicity")
def toxicity_query(spark, folder):
    return toxicity.toxicity(spark, table(spark, folder, "documents"), table(spark, folder, "labels")).drop("text_key")


@query("op11_simhash_near_duplicates")
def simhash_query(spark, folder):
    return simhash.simhash_groups(spark, table(spark, folder, "documents"))


@query("op12_tokenizer_alignment")
def alignment_query(spark, folder):
    return alignment.align(spark, table(spark, folder, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_hard_negatives", sql="""
    with v as (
        select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
            list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
        from embeddings
        where label is not null and embedding is not null
            and len(embedding) = len(list_filter(embedding, lambda x: x is not null and isfinite(x)))
    ), scored as (
        select a.vec_id as anchor_id, c.vec_id, a.label = c.label as alike, cast(list_inner_product(a.v, c.v) as bigint) as score
        from v a join v c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id
    ), positive as (
        select * from (
            select *, row_number() over (partition by anchor_id order by score desc, vec_id) as place from scored where alike
        ) where place <= 5
    ), ranked as (
        select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
            row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) as place
        from positive p join scored n
            on p.anchor_id = n.anchor_id and not n.alike and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
    )
    select anchor_id, positive_id, cast(place as integer) as rank, negative_id, positive_score, negative_score
    from ranked where place <= 10
""")
def hard_negatives_query(spark, folder):
    return negatives.hard_negatives(spark, table(spark, folder, "embeddings"), every=100, positives=5, negatives=10, low=30, high=90)
