"""Conversation benchmarks as tables: cases' histories and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN = "struct<speaker:string,dia_id:string,text:string,blip_caption:string>"
QA = "array<struct<question:string,answer:string,adversarial_answer:string,category:int,evidence:array<string>>>"


def locomo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(history, questions) of a file of dialogues whose sessions are fields session_1, session_2, ..."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("at", "sample"))
    one = raw.select("at", F.coalesce(F.get_json_object("sample", "$.sample_id"), F.concat(F.lit("locomo_"), "at")).alias("case_id"), F.from_json(F.get_json_object("sample", "$.conversation"), "map<string,string>").alias("c"), F.from_json(F.get_json_object("sample", "$.qa"), QA).alias("qa"))
    field = one.select("case_id", "c", F.explode("c").alias("name", "value")).where(F.col("name").rlike(r"^session_\d+$"))
    session = field.select("case_id", F.regexp_extract("name", r"(\d+)", 1).cast("int").alias("session"), F.from_json("value", f"array<{TURN}>").alias("turns"), F.try_element_at("c", F.concat("name", F.lit("_date_time"))).alias("timestamp"))
    turn = session.where("turns is not null").select("case_id", "session", "timestamp", F.posexplode("turns").alias("i", "t")).where("t.dia_id is not null")
    photo = F.when(F.coalesce("t.blip_caption", F.lit("")) != "", F.concat(F.lit("[shared photo: "), "t.blip_caption", F.lit("]")))
    history = turn.select("case_id", F.col("t.dia_id").alias("item_id"), F.concat_ws(" ", F.nullif("t.text", F.lit("")), photo).alias("text"), F.col("t.speaker").alias("speaker"), "timestamp", (F.col("session") * 100_000 + F.col("i")).alias("pos"))
    q = one.select("case_id", F.posexplode("qa").alias("i", "q"))
    names = F.create_map(*[F.lit(x) for kv in {1: "multi-hop", 2: "temporal", 3: "open-domain", 4: "single-hop", 5: "abstention"}.items() for x in kv])
    abstain = F.coalesce(F.col("q.category") == 5, F.lit(False))
    questions = q.select(
        "case_id",
        F.concat("case_id", F.lit("_q"), "i").alias("question_id"),
        F.coalesce("q.question", F.lit("")).alias("question"),
        F.coalesce(F.when(abstain, F.coalesce("q.adversarial_answer", "q.answer")).otherwise(F.col("q.answer")), F.lit("")).alias("answer"),
        F.coalesce(F.try_element_at(names, "q.category"), F.lit("single-hop")).alias("category"),
        F.when(abstain, F.array().cast("array<string>")).otherwise(F.coalesce("q.evidence", F.array().cast("array<string>"))).alias("evidence_ids"),
        abstain.alias("abstain"),
    )
    return history, questions


LME = "array<struct<question_id:string,question_type:string,question:string,answer:string,haystack_session_ids:array<string>,haystack_dates:array<string>,haystack_sessions:array<array<struct<role:string,content:string>>>,answer_session_ids:array<string>>>"


def longmemeval(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(history, questions) of a file of questions, each with its own sessions; a session is one item."""
    one = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", LME)).alias("x")).select("x.*")
    s = one.select("question_id", "haystack_session_ids", "haystack_dates", F.posexplode("haystack_sessions").alias("i", "turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("speaker")), F.lit(": "), F.coalesce(t["content"], F.lit("")))), "\n")
    nth = F.col("i") + 1
    history = s.select(F.col("question_id").alias("case_id"), F.coalesce(F.try_element_at("haystack_session_ids", nth), F.concat("question_id", F.lit("_session_"), "i")).alias("item_id"), text.alias("text"), F.lit(None).cast("string").alias("speaker"), F.try_element_at("haystack_dates", nth).alias("timestamp"), F.col("i").alias("pos"))
    kind = F.coalesce("question_type", F.lit(""))
    abstain = F.endswith("question_id", F.lit("_abs")) | kind.rlike("(?i)abst(ention|ain)")
    category = F.when(abstain, "abstention").when(kind == "multi-session", "multi-hop").when(kind == "temporal-reasoning", "temporal").when(kind == "knowledge-update", "knowledge-update").otherwise("single-hop")
    questions = one.select(F.col("question_id").alias("case_id"), "question_id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"), category.alias("category"), F.when(abstain, F.array().cast("array<string>")).otherwise(F.coalesce("answer_session_ids", F.array().cast("array<string>"))).alias("evidence_ids"), abstain.alias("abstain"))
    return history, questions


def synthetic(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A small set of our own for smoke tests: two cases, eight items, questions of every category."""
    h = [
        ("c1", "a1", "Mara works at Helio Labs.", "Mara", "2023-01-05", 0), ("c1", "a2", "Mara moved to Oslo in spring.", "Mara", "2023-04-02", 1), ("c1", "a3", "Mara works at Brine Systems now.", "Mara", "2023-09-11", 2), ("c1", "a4", "Helio Labs is based in Tromso.", "Ivo", "2023-09-12", 3),
        ("c2", "b1", "Ivo adopted a puppy called Nix.", "Ivo", "2024-02-01", 0), ("c2", "b2", "Nix likes the harbour.", "Ivo", "2024-02-09", 1), ("c2", "b3", "Ivo hates early meetings.", "Ivo", "2024-03-01", 2), ("c2", "b4", "The team met on Monday about the roadmap.", "Mara", "2024-03-04", 3),
    ]
    q = [
        ("c1", "q1", "Where does Mara work now?", "Brine Systems", "knowledge-update", ["a3"], False), ("c1", "q2", "Which city is Mara's first employer in?", "Tromso", "multi-hop", ["a1", "a4"], False), ("c1", "q3", "When did Mara move to Oslo?", "spring 2023", "temporal", ["a2"], False),
        ("c2", "q4", "What is the name of Ivo's puppy?", "Nix", "single-hop", ["b1"], False), ("c2", "q5", "Which car does Ivo drive?", "", "abstention", [], True), ("c2", "q6", "What do pets enjoy near water?", "the harbour", "open-domain", ["b2"], False),
    ]
    from quillgraph import schemas

    return spark.createDataFrame(h, schemas.HISTORY), spark.createDataFrame(q, schemas.QUESTIONS)
