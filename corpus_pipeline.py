"""A training corpus in five stages, each on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm import bpe, decontaminate, pii, simhash, toxicity
from courtside.llm.common import quoted, read_table, stored
from courtside.llm.registered import vocabulary

#: SimHash, span classifiers and tokenizers have no counterpart in SQL; the stages are tested
#: against brute force.
ORACLE_SQL = None


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Texts have changed: their length follows. Columns in their given order."""
    docs = docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else docs
    return docs.select(*map(quoted, columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity model rejects."""
    return toxicity.reject(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (SimHash of 3-word shingles, at most two
    differing bits, joined by chains): the one with the smallest id."""
    return simhash.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of the benchmark out of the texts."""
    return _recounted(decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark")), docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    return _recounted(pii.mask(docs), docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number, and whether they decode to the text."""
    ranks, pattern = vocabulary(spark)
    rows = docs.select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    coded = bpe.encode(rows, ranks, pattern, with_decoded=True)
    return coded.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_tokens"),
                        (F.col("decoded") == F.encode("text", "utf-8")).alias("exact"))


STAGES = [
    ("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("benchmark_decontamination", cut_benchmark),
    ("pii", mask_personal_data), ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is stored, then read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs, name) if number < len(STAGES) - 1 else docs
    return docs
