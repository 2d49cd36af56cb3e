"""A training corpus from raw documents, in five stages; each works on the table that the one before it wrote.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last have the columns of documents, whatever
further columns docs has. A stage that changes a text also sets n_chars, where there is such a column.

Defined cases: a null text counts as empty, is judged by the classifier like any other, and stays null; a null id is
never dropped for it (it sorts last, so of a group of copies the one with an id stays); of rows that agree in id and
text one stays after the third stage; rows that share an id only are documents of their own; documents without words
are no copies of each other; a document whose lines are all copies of earlier lines goes with them; empty tables give
empty ones. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe, line_dedup, ngram_jaccard, quality, tiling
from quillgraph.llm.common import stored
from quillgraph.llm.queries import pattern, table, vocabulary


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones."""
    done = line_dedup.dedup_lines(docs)
    removed = F.col(line_dedup.counts_of(docs)[1])
    left = done.where((removed == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        left = left.withColumn("n_chars", F.when(removed > 0, size).otherwise(F.col("n_chars")))
    return left.drop(*line_dedup.counts_of(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return ngram_jaccard.one_of_each_group(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return tiling.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of byte-level BPE, and the text as the ids decode to it."""
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    done = bpe.round_trip(docs, path, pattern())
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.decode("decoded", "utf-8").alias("text"))


STAGES = [
    ("quality classifier", accept_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("byte-level BPE encoding and decoding", encode_tokens),
]

#: SQL can express neither the fitted classifier nor the tokenizer's merges
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs
