"""Exact answers from the graph: templates over a user's relations for many questions at once.

questions: query_id, user_id, query, and where a parser gave them subject, predicate, object, kind. entities: user_id,
id, label, type; relations: user_id, src, dst, label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.config import GENERIC
from quillgraph.functions import text as T

PREFERENCES = tuple(sorted("enjoy enjoys fan_of favors favours fond_of interested_in into keen_on like likes love loves passionate_about prefer prefers".split()))
FILLERS = tuple(sorted("about and are between can compare could did does for from has have her his how into know list show tell that the their them there these they this was were what when where which who why with would you your".split()))


def parse(questions: DataFrame) -> DataFrame:
    """Questions with subject and predicate of simple forms, where no parser gave them."""
    found = T.intent(F.col("query"))
    return questions.select("query_id", "user_id", "query", found["subject"].alias("subject"), found["predicate"].alias("predicate"), F.lit(None).cast("string").alias("object"), F.when(found.isNotNull(), "relation_query").alias("kind"))


def link(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, role, id): by the id that a mention's slug gives, else by label. mentions: query_id, user_id, role, mention."""
    m = mentions.where("mention is not null").withColumn("slug_id", T.entity_id(F.col("mention"))).withColumn("low", F.lower("mention"))
    by_id = m.join(entities.select("user_id", F.col("id").alias("slug_id"), F.col("id")), ["user_id", "slug_id"]).select("query_id", "role", "id", F.lit(0).alias("tier"))
    by_label = m.join(entities.select("user_id", F.lower("label").alias("low"), "id"), ["user_id", "low"]).select("query_id", "role", "id", F.lit(1).alias("tier"))
    return by_id.unionByName(by_label).groupBy("query_id", "role").agg(F.min_by("id", F.struct("tier", "id")).alias("id"))


def fact_text(a: Column, p: Column, b: Column) -> Column:
    return F.concat_ws(" ", a, F.replace(p, F.lit("_"), F.lit(" ")), b)


def named(relations: DataFrame, entities: DataFrame) -> DataFrame:
    n = entities.select("user_id", "id", F.col("label").alias("name"))
    r = relations.join(n.withColumnsRenamed({"id": "src", "name": "src_name"}), ["user_id", "src"], "left").join(n.withColumnsRenamed({"id": "dst", "name": "dst_name"}), ["user_id", "dst"], "left")
    return r.select("user_id", "src", "dst", "label", F.coalesce("src_name", "src").alias("src_name"), F.coalesce("dst_name", "dst").alias("dst_name"))


def answer(questions: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(query_id, route, facts array<string>, confidence): forward, reverse or binary relations, then preferences, then
    facts about the entities that a question names, then relations that it names."""
    rel = named(relations, entities)
    q = questions.withColumn("wanted", T.stem(F.regexp_replace("predicate", r"\s+", "_")))
    roles = q.select("query_id", "user_id", F.explode(F.array(F.struct(F.lit("s").alias("role"), F.col("subject").alias("mention")), F.struct(F.lit("o").alias("role"), F.col("object").alias("mention")))).alias("m")).select("query_id", "user_id", "m.*")
    ids = link(roles, entities).groupBy("query_id").agg(F.max(F.when(F.col("role") == "s", F.col("id"))).alias("s"), F.max(F.when(F.col("role") == "o", F.col("id"))).alias("o"))
    q = q.join(ids, "query_id", "left")
    hit = T.predicate_matches(F.col("label"), F.col("wanted"))
    text = fact_text(F.col("src_name"), F.col("predicate"), F.col("dst_name"))
    asks = q.where("kind = 'relation_query' and wanted is not null")
    forward = asks.where("s is not null and o is null").join(rel, "user_id").where((F.col("src") == F.col("s")) & hit).select("query_id", F.lit(0).alias("tier"), F.lit("forward").alias("route"), text.alias("fact"), F.lit(0.9).alias("confidence"))
    reverse = asks.where("o is not null and s is null").join(rel, "user_id").where((F.col("dst") == F.col("o")) & hit).select("query_id", F.lit(0).alias("tier"), F.lit("reverse").alias("route"), text.alias("fact"), F.lit(0.9).alias("confidence"))
    both = q.where("kind = 'binary_relation' and s is not null and o is not null and wanted is not null")
    holds = both.join(rel, "user_id").where((F.col("src") == F.col("s")) & (F.col("dst") == F.col("o")) & hit).select("query_id").distinct().withColumn("yes", F.lit(True))
    binary = both.join(holds, "query_id", "left").select("query_id", F.lit(0).alias("tier"), F.lit("binary").alias("route"), F.when(F.col("yes"), "Yes.").otherwise("No (not found in your knowledge graph).").alias("fact"), F.when(F.col("yes"), 0.9).otherwise(0.5).alias("confidence"))
    own = fact_text(F.col("src_name"), F.col("label"), F.col("dst_name"))
    liked = rel.where(F.col("label").isin(*PREFERENCES) | T.stem(F.col("label")).isin(*PREFERENCES))
    preference = q.where(T.asks_preference(F.col("query"))).join(liked, "user_id").select("query_id", F.lit(1).alias("tier"), F.lit("preference").alias("route"), own.alias("fact"), F.lit(0.85).alias("confidence"))
    word = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    qw = q.select("query_id", "user_id", F.explode(F.array_distinct(F.filter(word(F.col("query")), lambda w: ~w.isin(*FILLERS)))).alias("w"))
    ew = entities.select("user_id", "id", F.explode(F.array_distinct(word(F.col("label")))).alias("w"))
    anchor = qw.join(ew, ["user_id", "w"])
    at = anchor.select("query_id", "user_id", "id").distinct()
    typed = rel.where(F.col("label") != GENERIC)
    about = at.join(typed, (at["user_id"] == typed["user_id"]) & ((at["id"] == typed["src"]))).select("query_id", own.alias("fact")).unionByName(at.join(typed, (at["user_id"] == typed["user_id"]) & ((at["id"] == typed["dst"]))).select("query_id", own.alias("fact"))).distinct()
    terms = anchor.groupBy("query_id").agg(F.collect_set("w").alias("anchors")).join(q.select("query_id", T.wants_breadth(F.col("query")).alias("broad")), "query_id")
    spoken = about.join(terms, "query_id").withColumn("all", F.forall("anchors", lambda a: F.contains(F.lower("fact"), a)))
    some = F.max("all").over(Window.partitionBy("query_id"))
    entity = spoken.withColumn("some", some).where("broad or not some or `all`").select("query_id", F.lit(2).alias("tier"), F.lit("entity").alias("route"), "fact", F.lit(0.85).alias("confidence"))
    stems = q.select("query_id", "user_id", F.explode(F.array_distinct(F.transform(F.filter(F.split(F.lower("query"), "[^a-z]+"), lambda w: F.length(w) >= 4), T.stem))).alias("w"))
    heads = typed.withColumn("head", T.stem(F.split("label", "_")[0])).where("length(head) >= 4")
    # of two words of which one holds the other, the longer one holds the shorter one's first four letters
    first = lambda df, c: df.withColumn("g", F.substring(c, 1, 4))
    every = lambda df, c: df.withColumn("g", F.explode(T.grams(F.col(c), 4)))
    words, names = stems.select("user_id", "w").distinct(), heads.select("user_id", "head").distinct()
    near = every(words, "w").join(first(names, "head"), ["user_id", "g"]).unionByName(first(words, "w").join(every(names, "head"), ["user_id", "g"]))
    near = near.where(F.contains("w", F.col("head")) | F.contains("head", F.col("w"))).select("user_id", "w", "head").distinct()
    said = stems.join(near, ["user_id", "w"]).join(heads, ["user_id", "head"]).select("query_id", F.lit(3).alias("tier"), F.lit("predicate").alias("route"), own.alias("fact"), F.lit(0.8).alias("confidence"))
    every = forward.unionByName(reverse).unionByName(binary).unionByName(preference).unionByName(entity).unionByName(said)
    best = F.min("tier").over(Window.partitionBy("query_id"))
    first = every.withColumn("best", best).where("tier = best")
    return first.groupBy("query_id").agg(F.first("route").alias("route"), F.array_sort(F.collect_set("fact")).alias("facts"), F.max("confidence").alias("confidence"))


def mentioning_lines(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, line): clean lines of accessible chunks that hold a term. chunks: user_id, content; terms: query_id, user_id, term."""
    lines = chunks.select("user_id", F.explode(F.transform(T.sentences(F.col("content")), T.clean_line)).alias("line")).where(~T.is_boilerplate(F.col("line"))).distinct()
    words = lines.select("user_id", "line", F.explode(F.array_distinct(T.tokens(F.col("line")))).alias("word"))
    return terms.select("query_id", "user_id", F.lower("term").alias("word")).join(words, ["user_id", "word"]).select("query_id", "line").distinct()


def near_best(scored: DataFrame, margin: float = 0.08) -> DataFrame:
    """Lines (query_id, line, score) within a margin of their query's best."""
    return scored.withColumn("top", F.max("score").over(Window.partitionBy("query_id"))).where(F.col("score") >= F.col("top") - margin).drop("top")


def within_budget(notes: DataFrame, budget: int = 4000, limit: int = 12) -> DataFrame:
    """Of notes (query_id, pos, text) each text once, in order, until one would overrun the budget or the limit."""
    form = T.answer_form(F.col("text"))
    once = notes.withColumn("n", F.row_number().over(Window.partitionBy("query_id", form).orderBy("pos"))).where("n = 1").drop("n")
    w = Window.partitionBy("query_id").orderBy("pos")
    run = once.withColumn("at", F.row_number().over(w)).withColumn("upto", F.sum(F.length("text")).over(w))
    return run.where((F.col("upto") <= budget) & (F.col("at") <= limit)).drop("upto", "at")
