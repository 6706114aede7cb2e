"""The operators as registered queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm import bpe, chat, collocations, decontaminate, neighbours, pii, quality, simhash, spelling, substrings, syncmers, toxicity, urls
from courtside.llm.common import read_table
from courtside.llm.linear import is_held_out
from courtside.llm.oracle import ORACLE_SQL as ORACLE_SQL


def outcomes(labels: DataFrame) -> DataFrame:
    """A page is bad if the document of its number is labelled toxic or of low quality."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).groupBy("page_id").agg(F.max("bad").alias("bad"))


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(read_table(spark, sf_dir, "pages"), outcomes(read_table(spark, sf_dir, "labels")))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(read_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, *vocabulary(spark)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def vocabulary(spark: SparkSession) -> tuple[bytes, str]:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as ranks:
        return ranks.read(), public_tokenizers.PATTERN


def op5_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_likeness(read_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return _predicted(toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels"))), toxicity.THRESHOLD)


def _predicted(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return _predicted(quality.score(docs, quality.fit(docs, read_table(spark, sf_dir, "labels"))), quality.THRESHOLD)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.with_probe(read_table(spark, sf_dir, "conversations")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_url_reputation, op2_decontamination, op3_substring_dedup, op4_byte_bpe, op5_syncmer_fingerprints,
        op6_simhash, op7_toxicity, op8_pii, op9_quality, op10_chat, op11_spelling_variants,
        op12_nearest_neighbours, op13_collocations)
}
