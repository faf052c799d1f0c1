"""Queries that apply the operators of this subpackage to whole tables, and their DuckDB twins where SQL has one."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import saved, spread
from . import byte_bpe, langid, mixing, packing, permutation_ann, pivot_topk, quality, repair, secrets, sharding, simhash, suffixes, trie


VOCABULARY = "byte_bpe_50k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def fold(parts: int) -> Column:
    """Remainder of crc32 of the id as text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality.QualityModel:
    """Trusted positives: ids labelled 1 outside the held-out fifth; unlabelled: texts outside it."""
    positives = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    return quality.train(docs, positives, fold(5) != 0)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, sf_dir, docs), threshold=0.3)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.train(docs, fold(4) != 2)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def vocabulary() -> str:
    """The vocabulary file of the tokenizing queries; its folder is a parameter of the installation."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, VOCABULARY)
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


#: Pre-tokens whose ids a worker of the packing query keeps. With 2^16 it forgot them every few batches and asked the model for most of
#: the rarer ones again. The pipeline keeps the smaller default, as its executors have less memory left.
PACKING_CACHE_WORDS = 1 << 19


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_documents(spark, sf_dir), vocabulary(), capacity=2048, cache_words=PACKING_CACHE_WORDS)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests, capacity=2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.count_tokens(_documents(spark, sf_dir).select("doc_id", "text"), vocabulary(), limit=512).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return pivot_topk.pivot_topk(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256)


def op6_interleave_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.interleave_shards(rows, tie_cols=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Target mixture of the mixing query: domains by source, then language, then equal shares for sources.
WEB_SOURCES = 10
DOMAIN_WEIGHTS = {"web": 0.6, "curated": 0.4}
LANG_WEIGHTS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
OTHER_LANG_WEIGHT = 0.05


def mixture(docs: DataFrame, max_epochs: int = 1, total: float | None = None, share: float = 1.0) -> DataFrame:
    """The mixture above over ``docs``: the number behind a source's name tells its domain, words count as tokens."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"(\d+)$", 1)
    domain = F.when(number.try_cast("int") >= WEB_SOURCES, "curated").otherwise("web")
    lang_weight = F.lit(OTHER_LANG_WEIGHT)
    for lang, weight in LANG_WEIGHTS.items():
        lang_weight = F.when(F.col("_lang") == f"1{lang}", weight).otherwise(lang_weight)
    return mixing.mix(
        docs,
        levels={"domain": domain, "lang": F.col("lang"), "source": F.col("source")},
        weights=[F.when(F.col("_domain") == "1web", DOMAIN_WEIGHTS["web"]).otherwise(DOMAIN_WEIGHTS["curated"]), lang_weight, F.lit(1.0)],
        tokens=F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")),
        max_epochs=max_epochs,
        total=total,
        share=share,
        tie=F.md5(F.coalesce("text", F.lit(""))),
    )


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(_documents(spark, sf_dir), max_epochs=2).select("doc_id", "lang", "source", "epoch")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return permutation_ann.permutation_neighbours(vectors, F.col("vec_id") % 20 == 0, k=20)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan_secrets(_documents(spark, sf_dir)).select("doc_id", "spans")
    kinds = [r.kind for r in secrets.BASE_RULES]
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(kinds))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return scanned.select("doc_id", *[count(k).alias(f"n_{k}") for k in kinds], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffixes.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"), window=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return cleaned.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    convs = rows.groupBy(repair.conversation_key(F.col("conv_id")).alias("key")).agg(F.first("conv_id").alias("conv_id"))
    fixed = repair.repair(repair.damaged(rows))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    met = convs.join(fixed.audits, "key", "left").join(repair.digests(fixed.rows), "key", "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return met.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.numbered_turns(spread(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    c = F.col("conv_id")
    convs, rebuilt = trie.with_shared_heads(saved(turns, "trie-turns"), c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9, most=8)
    longs = ["depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return trie.prefix_trie(convs, rebuilt).select("conv_id", *[F.col(x).cast("long").alias(x) for x in longs], "ends_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_language": op3_language,
    "op4_token_counts": op4_token_counts,
    "op5_pivot_topk": op5_pivot_topk,
    "op6_interleave_shards": op6_interleave_shards,
    "op7_mixture": op7_mixture,
    "op8_simhash": op8_simhash,
    "op9_permutation_ann": op9_permutation_ann,
    "op10_secrets": op10_secrets,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_prefix_trie": op13_prefix_trie,
}
