"""Retrieval metrics, gold sets and score cards over tables of ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T


def ranked_once(results: DataFrame) -> DataFrame:
    """results (query_id, id, rank) with each id at its first rank only, counted anew."""
    first = results.groupBy("query_id", "id").agg(F.min("rank").alias("r"))
    return first.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("r", "id")).alias("rank"))


def metrics(results: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, precision, rr, ndcg) of every query in gold (query_id, id, grade).

    Precision divides by what was returned, at most k; gains are 2 ** grade - 1; a query without gold has recall 1.
    """
    g = gold.groupBy("query_id", "id").agg(F.max("grade").cast("double").alias("grade"))
    asked = gold.select("query_id").distinct()
    top = ranked_once(results).where(F.col("rank") <= k)
    hits = top.join(g, ["query_id", "id"], "left")
    found = hits.groupBy("query_id").agg(
        F.count("*").alias("shown"),
        F.count_if(F.col("grade") > 0).alias("hits"),
        F.sum(F.when(F.col("grade") > 0, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1))).alias("dcg"),
    )
    full = ranked_once(results).join(g.where("grade > 0"), ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")
    ideal = g.where("grade > 0").withColumn("r", F.row_number().over(w)).groupBy("query_id").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("r") <= k, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("r") + 1))).alias("best"))
    j = asked.join(found, "query_id", "left").join(full, "query_id", "left").join(ideal, "query_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    return j.select(
        "query_id",
        F.when(z("relevant") == 0, 1.0).otherwise(z("hits") / F.col("relevant")).alias("recall"),
        F.when(z("shown") == 0, 0.0).otherwise(z("hits") / F.col("shown")).alias("precision"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.when(z("best") == 0, 0.0).otherwise(z("dcg") / F.col("best")).alias("ndcg"),
    )


def score_card(scored: DataFrame, questions: DataFrame) -> DataFrame:
    """Means per category, and over all questions under 'overall'."""
    j = scored.join(questions.select(F.col("question_id").alias("query_id"), "category"), "query_id")
    return j.rollup("category").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("recall", "precision", "rr", "ndcg")]).withColumn("category", F.coalesce("category", F.lit("overall")))


def efficiency(retrieved: DataFrame, corpus: DataFrame) -> DataFrame:
    """(case_id, full_tokens, shown_tokens, reduction). retrieved: case_id, query_id, text; corpus: case_id, text."""
    full = corpus.groupBy("case_id").agg(F.sum(T.approx_tokens(F.col("text"))).alias("full_tokens"))
    shown = retrieved.groupBy("case_id", "query_id").agg(F.sum(T.approx_tokens(F.col("text"))).alias("t")).groupBy("case_id").agg(F.avg("t").alias("shown_tokens"))
    return full.join(shown, "case_id").withColumn("reduction", F.col("full_tokens") / F.col("shown_tokens"))


def gold_set(chunks: DataFrame, terms: int = 6) -> DataFrame:
    """(query_id, query, id): a query per virtual record, of the longest words of its first chunk."""
    first = chunks.groupBy("virtual_record_id").agg(F.min_by("content", "point_id").alias("content"))
    words = T.salient_terms(F.col("content"), terms)
    return first.where(F.size(words) >= 2).select(F.concat(F.lit("gold:"), "virtual_record_id").alias("query_id"), F.array_join(words, " ").alias("query"), F.col("virtual_record_id").alias("id"))


def abstentions(answers: DataFrame) -> DataFrame:
    """answers (question_id, predicted, abstain) with correct for questions that have no answer."""
    return answers.where("abstain").select("question_id", T.declines(F.col("predicted")).alias("correct"))


def fragmentation(mentions: DataFrame) -> DataFrame:
    """One row: nodes per true entity (truth, node); 1 is ideal."""
    return mentions.agg((F.count_distinct("node") / F.count_distinct("truth")).alias("fragmentation"))
