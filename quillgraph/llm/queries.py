"""The queries of this package, for the driver's registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe, chat, lattice, licenses, line_dedup, ngram_jaccard, quality, repair, tiling, warc
from quillgraph.llm.sql import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, shards = repair.store_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return repair.read_shards(spark, folder, shards)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = r"\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(F.lit("user"), F.lit("assistant"))).alias("role"), F.lit(told).alias("text")).select("conv_id", F.when(F.col("role") == "user", 0).otherwise(1).cast("long").alias("turn"), "role", "text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.format_conversations(rows).withColumn("loss", F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_spans")), ""))
    kept = done.select("conv_id", "formatted", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
    return chat.read_conversations(kept, keep=("loss_chars", "loss_sha256", "formatted_chars")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        "loss_chars",
        "loss_sha256",
        "formatted_chars",
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op6_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the table has no time of capture: pages count as captured a second after one another
    pages = table(spark, sf_dir, "pages").withColumn("captured", F.lit(1_577_836_800) + F.col("page_id"))
    folder, index = warc.archive(pages, time_col="captured")
    return warc.captures(spark, index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents"), path, pattern())
    return bpe.decode(ids, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_lattice_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_repair_tokens, op2_chat_format, op3_ngram_jaccard, op4_license_scan, op5_line_dedup, op6_quality_qda, op7_warc_merge, op8_byte_bpe, op9_lattice_near_dup, op10_string_tiling)}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in queries()}
