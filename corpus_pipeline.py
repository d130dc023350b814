"""A corpus pipeline: documents in, packed training sequences out.

Each stage takes what its predecessor kept, as a table in the shared folder, and returns the columns of documents;
the last one returns the pieces of sequences. Other columns of documents pass through unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelens.llm import decontaminate, language_id, ngram_jaccard, packing, substring_dedup
from probelens.llm.store import small_batches, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. The model is fitted on labelled rows of the documents themselves;
    lang stays as it was given."""
    small_batches(spark)
    model = language_id.fit(docs.where(~language_id.held_out("doc_id", 4, 2)), "doc_id", "text", "lang")
    return language_id.identify(docs, model, carry=COLUMNS).where("NOT rejected").select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; blank documents are in no group."""
    groups = ngram_jaccard.near_duplicates(docs)
    copies = groups.where("component_id <> doc_id").select("doc_id")
    return docs.select(COLUMNS).join(copies, "doc_id", "left_anti").select(COLUMNS)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages an earlier one has. A text that loses words is the other words joined by one
    space; others stay as they are. Documents of which nothing is left go."""
    found = substring_dedup.without_repeats(docs, carry=COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    left = found.where("n_removed = 0 OR n_removed < n_words")
    return left.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(docs, benchmark, carry=COLUMNS).where(F.size("hits") == 0).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document in sequences of 2048 tokens."""
    return packing.pack(docs, packing.word_bpe())


STAGES = [
    ("language", language),
    ("near_duplicates", one_of_each_group),
    ("passages", without_repeated_passages),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

#: Language identification, hashing of near copies and tokenization have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
