"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crystalspark.llm import class_lm, decontaminate, delta_lloyd, exact_dedup, hilbert_shards, html_blocks, maxscore, merge_counts, mixing, repeated_substrings, simhash_bktree, token_store, toxicity
from crystalspark.llm.common import crc_mod, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_blocks.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars", "n_blocks", "n_kept")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_sum(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


#: Documents at or above this score count as toxic.
TOXIC = 0.3


def toxicity_classifier(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Classifier:
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=crc_mod("doc_id", 4) != 2)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_classifier(spark, sf_dir, docs))
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards.assign(table(spark, sf_dir, "documents"), shards=40, law="rows")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings.remove_repeats(table(spark, sf_dir, "documents"), length=400)


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = class_lm.score(table(spark, sf_dir, "documents"), train=crc_mod("doc_id", 7) != 2)
    return found.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), n=10)
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans",
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.with_domain(table(spark, sf_dir, "documents")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_bktree.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6).drop("label")


#: A document of more tokens is over the limit.
LIMIT = 1024


def op12_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = merge_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


def op13_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.rank_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def queries() -> dict:
    found = (
        op1_main_text, op2_token_store, op3_toxicity, op4_hilbert_shards, op5_repeats, op6_class_lm, op7_decontaminate, op8_exact_dedup, op9_mixing,
        op10_simhash, op11_delta_lloyd, op12_merge_counts, op13_maxscore,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": exact_dedup.ORACLE, "op9_mixing": mixing.oracle(), "op11_delta_lloyd": delta_lloyd.oracle(), "op13_maxscore": maxscore.ORACLE}
