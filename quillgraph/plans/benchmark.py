"""Conversation benchmarks from end to end: all cases in one job, each a tenant of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.config import Config
from quillgraph.functions import text as T
from quillgraph.functions import vectors
from quillgraph.functions.chunking import chunk_text
from quillgraph.operators import evaluate, retrieval
from quillgraph.operators.lineage import cut


def case_tables(history: DataFrame, cfg: Config = Config()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, records and access of all cases; a case's only reader is the case itself."""
    said = F.concat(F.coalesce(F.concat("speaker", F.coalesce(F.concat(F.lit(" ("), "timestamp", F.lit(")")), F.lit("")), F.lit(": ")), F.lit("")), "text")
    items = history.select("case_id", "item_id", F.concat_ws("/", "case_id", "item_id").alias("record_id"), said.alias("text"))
    pieces = items.select("case_id", "record_id", F.posexplode(chunk_text(F.col("text"), cfg.chunk_size, cfg.min_chunk)).alias("i", "content"))
    chunks = pieces.select(F.concat_ws("#", "record_id", "i").alias("point_id"), F.col("record_id").alias("virtual_record_id"), F.col("case_id").alias("org_id"), "content", vectors.hash_embedding("content").alias("embedding"))
    records = items.select("record_id", F.lit(None).cast("string").alias("owner_id"), F.lit(1.0).alias("importance"), F.lit(0).cast("long").alias("last_accessed_at"), F.lit(0).cast("long").alias("access_count"))
    acl = items.select(F.col("case_id").alias("user_id"), F.col("record_id").alias("virtual_record_id"), "record_id")
    return cut(chunks), records, acl


def run(history: DataFrame, questions: DataFrame, k: int = 10, cfg: Config = Config(), **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(score card by category, metrics per question, tokens per case) of retrieval alone; abstentions aren't scored."""
    spark = history.sparkSession
    chunks, records, acl = case_tables(history, cfg)
    asked = questions.where("not abstain").select(F.col("question_id").alias("query_id"), F.col("case_id").alias("user_id"), F.col("question").alias("query"), vectors.hash_embedding("question").alias("vector"))
    edges = spark.createDataFrame([], "src string, dst string, label string, expired_at long, provenance array<string>")
    found, _ = retrieval.hybrid_search(asked, chunks, records, edges, acl, 0, Config(**{**cfg.__dict__, "topk": k}), **{"tenants": True, **options})
    ids = found.select("query_id", F.regexp_replace("record_id", "^[^/]*/", "").alias("id"), "rank", "passage")
    gold = questions.where("not abstain").select(F.col("question_id").alias("query_id"), F.explode("evidence_ids").alias("id"), F.lit(1.0).alias("grade"))
    scored = evaluate.metrics(ids, gold, k)
    shown = ids.join(questions.select(F.col("question_id").alias("query_id"), "case_id"), "query_id").select("case_id", "query_id", F.col("passage").alias("text"))
    return evaluate.score_card(scored, questions), scored, evaluate.efficiency(shown, history.select("case_id", "text"))


def render(card: list[dict]) -> str:
    """A score card's rows as a Markdown table, overall last."""
    rows = sorted(card, key=lambda r: (r["category"] == "overall", r["category"]))
    lines = ["| category | n | recall | precision | rr | ndcg |", "|-|-|-|-|-|-|"]
    return "\n".join(lines + [f"| {r['category']} | {r['n']} | " + " | ".join(f"{r[c]:.3f}" for c in ("recall", "precision", "rr", "ndcg")) + " |" for r in rows])


def judge(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, correct): refusals are right for questions without an answer; others need the answer's words.

    answers: question_id, predicted, from any injected generator.
    """
    j = questions.join(answers, "question_id", "left")
    said, gold = T.answer_form(F.coalesce("predicted", F.lit(""))), T.answer_form(F.col("answer"))
    return j.select("question_id", F.when(F.col("abstain"), T.declines(F.coalesce("predicted", F.lit("")))).otherwise((gold != "") & F.contains(said, gold)).alias("correct"))
