"""Documents to packed training sequences: language, toxicity, near duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from warden.llm import language_id, ngram_join, packing, toxicity
from warden.llm.common import keep_rows, shared_folder, take_memory
from warden.llm.queries import ship, table, tokenizer_file

#: A text goes if no language holds this share of its words.
LEAST_SCORE = 0.4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those that are in no language for the greater part."""
    ship(spark)
    model = spark.sparkContext.broadcast(language_id.train(docs))

    def decide():
        own = model.value
        take_memory(own)
        return lambda texts: [score >= LEAST_SCORE for _, score, _ in own.predict(texts)]

    return keep_rows(docs, decide)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that the toxicity model marks."""
    model = spark.sparkContext.broadcast(toxicity.train(docs, table(spark, sf_dir, "labels")))

    def decide():
        own = model.value
        take_memory(own)
        return lambda texts: [score < toxicity.THRESHOLD for score in own.score(texts).tolist()]

    return keep_rows(docs, decide)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of 0.75 similarity hold together."""
    ship(spark)
    return ngram_join.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 2048 tokens."""
    ship(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language ID", known_language),
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", without_near_duplicates),
    ("best-fit packing", packed),
]

#: The first two stages are learned models, which SQL cannot express; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read as the next one's input."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return result
        result.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
