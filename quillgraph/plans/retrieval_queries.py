"""Queries of retrieval, fusion, evaluation and resolution over embeddings, documents and the benchmark.

Searches take every row whose id is divisible by 50 as a query, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.config import Config
from quillgraph.functions import text as T
from quillgraph.functions import vectors
from quillgraph.operators import acl as access
from quillgraph.operators import evaluate, ingest, kgqa, memory, resolve, retrieval
from quillgraph.operators.lineage import cut, stored
from quillgraph.plans.registry import ms, query, table


def vector_tables(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, queries and access: a vector's label is its record group, user n sees the labels from n to n + 4 (of 10)."""
    e = table(spark, sf, "embeddings")
    chunks = e.select(F.col("vec_id").alias("point_id"), F.concat(F.lit("v"), "vec_id").alias("virtual_record_id"), "embedding", "label")
    asked = e.where("vec_id % 50 = 0").select(F.concat(F.lit("q"), "vec_id").alias("query_id"), F.concat(F.lit("u"), "label").alias("user_id"), F.col("embedding").alias("vector"))
    sees = spark.range(10).select(F.concat(F.lit("u"), "id").alias("user_id"), F.explode(F.sequence(F.col("id"), F.col("id") + 4)).alias("l")).select("user_id", (F.col("l") % 10).cast("int").alias("label"))
    acl = chunks.join(sees, "label").select("user_id", "virtual_record_id", F.concat(F.lit("r"), F.substring("virtual_record_id", 2, 20)).alias("record_id"))
    return chunks, asked, acl


KNN = """
v as materialized (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
s as (select 'q' || q.vec_id as query_id, v.vec_id as point_id, v.label, q.label as ulabel, list_cosine_similarity(q.e, v.e) as score from v, v q where q.vec_id % 50 = 0)
"""


@query(f"with {KNN}, r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, point_id) as rank from s) select query_id, point_id, round(score, 6) as score, rank::int as rank from r where rank <= 8")
def knn_exact(spark, sf):
    chunks, asked, _ = vector_tables(spark, sf)
    return retrieval.knn(chunks, asked, 8).withColumn("score", F.round("score", 6))


@query(f"with {KNN}, r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, point_id) as rank from s where (label - ulabel + 10) % 10 <= 4) select query_id, point_id, round(score, 6) as score, rank::int as rank from r where rank <= 8")
def knn_acl_filtered(spark, sf):
    """The nearest vectors that the asking user may see."""
    chunks, asked, acl = vector_tables(spark, sf)
    return retrieval.knn(chunks, asked, 8, acl).withColumn("score", F.round("score", 6))


@query(
    """with v as materialized (select vec_id, list_transform(embedding, lambda x: x::double) as e, list_transform(list_slice(embedding, 1, 32), lambda x: x::double) as p from embeddings),
s as (select 'q' || q.vec_id as query_id, v.vec_id as point_id, list_cosine_similarity(q.p, v.p) as short, list_cosine_similarity(q.e, v.e) as score from v, v q where q.vec_id % 50 = 0),
l as (select *, row_number() over (partition by query_id order by round(short, 9) desc, point_id) as n from s),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, point_id) as rank from l where n <= 64)
select query_id, point_id, round(score, 6) as score, rank::int as rank from r where rank <= 8"""
)
def knn_two_stage(spark, sf):
    """Shortlists by halves of the vectors, then exact scores."""
    chunks, asked, _ = vector_tables(spark, sf)
    return retrieval.two_stage_knn(chunks, asked, 8, Config(mrl_prefix=32)).withColumn("score", F.round("score", 6))


def document_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    b = table(spark, sf, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("query_id"), F.lit("u").alias("user_id"), F.col("text").alias("query"))
    return d, b


SPLIT = r"regexp_extract_all(translate({}, 'ACCENTED', 'PLAIN'), '[\p{L}\p{N}\p{Co}]+')".replace("ACCENTED", T.ACCENTED).replace("PLAIN", T.PLAIN)
BM25 = r"""
w as materialized (select doc_id, TOKENS as t from documents),
l as (select doc_id, len(t) as length from w), st as (select count(*)::double as n, avg(length) as average from l),
qt as (select 'b' || item_id as query_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}£$€%.\-]+'), lambda x: length(regexp_replace(x, '[^a-z0-9]', '', 'g')) >= 2)) as term from benchmark),
q as materialized (select query_id, p, count(*) as times from (select query_id, PARTS as p from qt) where len(p) > 0 group by 1, 2),
x as materialized (
  select doc_id, [term] as p, count(*) as tf from (select doc_id, unnest(t) as term from w) where term in (select p[1] from q where len(p) = 1) group by 1, 2
  union all select doc_id, p, tf from (select doc_id, p, len(list_filter(range(1, len(t) - len(p) + 2), lambda i: t[i : i + len(p) - 1] = p)) as tf from w, (select distinct p from q where len(p) > 1) where list_has_all(t, p)) where tf > 0),
df as (select p, count(*) as df from x group by 1),
sc as (select query_id, doc_id, sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))) as score from q join x using (p) join df using (p) join l using (doc_id), st group by 1, 2),
bm as materialized (select query_id, doc_id, score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from sc qualify rank <= 10)
""".replace("TOKENS", SPLIT.replace("{}", "lower(coalesce(text, ''))", 1)).replace("PARTS", SPLIT.replace("{}", "term", 1))


@query(f"with {BM25} select query_id, doc_id, round(score, 6) as score, rank::int as rank from bm")
def bm25_topk(spark, sf):
    d, b = document_tables(spark, sf)
    return retrieval.bm25(d, b, 10, key="doc_id").withColumn("score", F.round("score", 6))


GOLD = "gold as (select 'b' || item_id as query_id, doc_id, 1.0 as grade from benchmark b join documents d on contains(d.text, b.text))"


@query(
    f"""with {BM25}, {GOLD}, h as (select query_id, rank, grade from bm left join gold using (query_id, doc_id)),
m as (select query_id, count(*) as shown, count(grade) as hits, coalesce(sum(case when grade is not null then 1 / log2(rank + 1) end), 0) as dcg, min(case when grade is not null then rank end) as first from h group by 1),
i as (select query_id, count(*) as relevant from gold group by 1), j as (select i.query_id, relevant, shown, hits, dcg, first, (select sum(1 / log2(k + 1)) from (select unnest(range(1, least(relevant, 10) + 1)) as k)) as best from i left join m using (query_id))
select query_id, round(hits / relevant, 6) as recall, round(hits / shown, 6) as precision, round(coalesce(1.0 / first, 0), 6) as rr, round(dcg / best, 6) as ndcg from j"""
)
def retrieval_metrics(spark, sf):
    """How well full-text search finds the documents that hold a benchmark item."""
    d, b = document_tables(spark, sf)
    found = retrieval.bm25(d, b, 10, key="doc_id").select("query_id", F.col("doc_id").alias("id"), "rank")
    items = b.select("query_id", "query")
    hit = gold_by_seed(d, items)
    m = evaluate.metrics(found, hit, 10)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "rr", "ndcg")])


def gold_by_seed(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold an item as it is: they share its longest word, which is joined before texts are compared."""
    longest = F.array_max(F.transform(T.tokens(F.col("query")), lambda t: F.struct(F.length(t).alias("l"), t.alias("t"))))["t"]
    words = docs.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("content")))).alias("w"))
    near = items.withColumn("w", longest).join(words, "w").select("query_id", "query", "doc_id")
    return near.join(docs, "doc_id").where(F.contains("content", F.col("query"))).select("query_id", F.col("doc_id").alias("id"), F.lit(1.0).alias("grade"))


LEGS = """
c as (select event_type as query_id, user_id as point_id, count(*) as n, round(sum(value), 4) as total from events group by 1, 2),
a as (select *, row_number() over (partition by query_id order by n desc, point_id) as rank from c qualify rank <= 40),
b as (select *, row_number() over (partition by query_id order by total desc, point_id) as rank from c qualify rank <= 40),
f as (select query_id, point_id, sum(1.0 / (60 + rank)) as rrf, string_agg(leg, ',' order by leg) as legs from (select query_id, point_id, rank, 'count' as leg from a union all select query_id, point_id, rank, 'total' from b) group by 1, 2)
"""


def event_legs(spark, sf) -> dict[str, DataFrame]:
    c = table(spark, sf, "events").groupBy(F.col("event_type").alias("query_id"), F.col("user_id").alias("point_id")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return {leg: retrieval.top_per_query(c, 40, F.desc(col), F.col("point_id")) for leg, col in (("count", "n"), ("total", "total"))}


@query(f"with {LEGS} select query_id, point_id, round(rrf, 8) as rrf, legs from f")
def rrf_fusion(spark, sf):
    """Users of each event type, by number and by value, fused."""
    return retrieval.fuse(event_legs(spark, sf)).select("query_id", "point_id", F.round("rrf", 8).alias("rrf"), F.array_join("legs", ",").alias("legs"))


@query(f"with {LEGS}, u as (select query_id, point_id, rrf, legs from f union all select query_id, point_id, 1.0 / (60 + rank), 'count' from a) select query_id, point_id, round(sum(rrf), 8) as rrf from u group by 1, 2")
def fused_pools(spark, sf):
    legs = event_legs(spark, sf)
    return retrieval.add_pools(retrieval.fuse(legs), retrieval.fuse({"count": legs["count"]})).select("query_id", "point_id", F.round("rrf", 8).alias("rrf"))


@query(f"with {LEGS}, t as (select *, max(rrf) over (partition by query_id) as top from f), r as (select *, point_id % 7 as g, row_number() over (partition by query_id, point_id % 7 order by round(rrf, 12) desc, point_id) as n from t where rrf >= top * 0.3) select query_id, point_id, (row_number() over (partition by query_id order by round(rrf, 12) desc, point_id))::int as rank from r where n <= 2 qualify rank <= 8")
def diversified(spark, sf):
    """The first eight of each list, at most two of a record (a seventh of the users)."""
    pool = retrieval.fuse(event_legs(spark, sf)).withColumns({"query": F.col("query_id"), "content": F.concat(F.lit("user "), "point_id"), "record_id": F.col("point_id") % 7})
    return retrieval.diversify(pool, 8).select("query_id", "point_id", "rank")


def corpus(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents as chunks and records with an owner (source) and a language group; access by owner and group."""
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("record_id"), F.concat(F.lit("d"), "doc_id").alias("virtual_record_id"), F.lit("org").alias("org_id"), F.concat(F.lit("doc "), "doc_id").alias("record_name"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("owner_id"), F.array(F.concat(F.lit("lang:"), "lang")).alias("permitted_principals"), F.col("doc_id").alias("seq"), F.lit(1_700_000_000_000).alias("created_at"))
    docs, _ = ingest.accepted(d)
    chunks = stored(ingest.pieces(docs), "chunks").withColumn("embedding", vectors.hash_embedding("content", once=True))  # texts are cut once; one leg reads vectors, so these aren't written
    docs = cut(docs.drop("text"))  # and texts aren't read for access
    grants, _ = ingest.grants(docs)
    users = docs.select(F.col("owner_id").alias("user_id")).where("user_id is not null").distinct().withColumn("org_id", F.lit("org"))
    member = users.select(F.col("user_id").alias("src"), F.lit("lang:en").alias("dst"), F.lit("belongsTo").alias("label"))
    null = F.lit(None).cast("string")
    principals = users.select(F.col("user_id").alias("id"), F.lit("users").alias("coll"), "user_id", "org_id", null.alias("file_key"), null.alias("role"))
    records = docs.select("record_id", "virtual_record_id", "org_id", "record_name", "mime_type", "connector_id", "origin", F.lit("COMPLETED").alias("indexing_status"), "owner_id", F.lit(1.0).alias("importance"), F.col("created_at").alias("last_accessed_at"), F.lit(0).cast("long").alias("access_count"))
    return chunks, records, cut(access.accessible(users, principals, grants.unionByName(member), records)), users


@query()
def hybrid_topk(spark, sf):
    """The flagship: benchmark items as questions of all users in turn, over the chunks that each user may see."""
    chunks, records, acl, users = corpus(spark, sf)
    turn = users.select("user_id", (F.row_number().over(Window.orderBy("user_id")) - 1).alias("turn"))  # a row per source
    items = table(spark, sf, "benchmark").withColumn("turn", F.pmod("item_id", F.lit(turn.count())))
    asked = items.join(turn, "turn").select(F.concat(F.lit("b"), "item_id").alias("query_id"), "user_id", F.col("text").alias("query"), vectors.hash_embedding("text").alias("vector"))
    edges = spark.createDataFrame([], "src string, dst string, label string, expired_at long, provenance array<string>")
    found, _ = retrieval.hybrid_search(asked, chunks, records, edges, acl, 1_700_100_000_000)
    return found.select("query_id", "rank", "point_id", "record_id", F.round("rrf", 6).alias("rrf"), F.array_join("legs", ",").alias("legs"), "passage")


@query("select doc_id, text is null or strlen(text) = 0 as empty, quality::int as quality from documents join labels using (doc_id) where quality = 1 and toxic = 0")
def graded_documents(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(l.where("quality = 1 and toxic = 0"), "doc_id").select("doc_id", F.coalesce(F.octet_length("text") == 0, F.lit(True)).alias("empty"), "quality")


@query()
def resolved_entities(spark, sf):
    """Suppliers' and customers' names as surface forms, and variants of them, in groups.

    Each name gets a word from its hash, because the tables' numbered names lie within a typo of each other.
    """
    told = lambda c: F.concat(c, F.lit(" "), F.substring(F.sha2(c, 256), 1, 8))
    n = table(spark, sf, "nation")
    o = table(spark, sf, "supplier").select(told("s_name").alias("name"), F.col("s_suppkey").alias("seq"), F.lit("ORG").alias("type"))
    p = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(told("c_name").alias("name"), F.col("c_custkey").alias("seq"), "n_name", F.lit("PERSON").alias("type"))
    spaced = F.replace("name", F.lit("#"), F.lit(" "))
    org = F.array(F.col("name"), spaced, F.concat("name", F.lit(", Inc.")))
    person = F.array(F.col("name"), F.concat(F.lit("Dr. "), spaced), F.concat(spaced, F.lit(" of "), "n_name"), F.expr("left(name, length(name) - 1)"))
    s = o.select(F.explode(org).alias("label"), "type", "seq").unionByName(p.select(F.explode(person).alias("label"), "type", "seq")).where("label is not null")
    s = s.select(F.concat(F.lit("e"), F.xxhash64("label", "type")).alias("id"), "label", "type", "seq").distinct()
    return resolve.canonicalise(s).groupBy("canonical").agg(F.count("*").alias("forms"))


@query("with n as (select conv_id as query_id, turn, text, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[''’`]', '', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as f from conversations), o as (select * from n qualify row_number() over (partition by query_id, f order by turn) = 1), b as (select query_id, turn as pos, text, sum(length(text)) over w as upto, row_number() over w as nth from o window w as (partition by query_id order by turn rows unbounded preceding)) select query_id, pos, length(text)::bigint as chars from b where upto <= 600 and nth <= 5")
def budgeted_notes(spark, sf):
    n = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), "text")
    return kgqa.within_budget(n, 600, 5).select("query_id", "pos", F.length("text").cast("long").alias("chars"))


@query("with s as (select conv_id as query_id, turn::varchar as line, length(text)::double / 1000 as score from conversations), t as (select *, max(score) over (partition by query_id) as top from s) select query_id, line, score from t where score >= top - 0.08")
def lines_near_best(spark, sf):
    s = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").cast("string").alias("line"), (F.length("text").cast("double") / 1000).alias("score"))
    return kgqa.near_best(s)


@query("select p_partkey, count(*) as accesses, max(epoch_ms(l_shipdate)) as last from part join lineitem on l_partkey = p_partkey group by 1")
def access_log_fold(spark, sf):
    """An access log folded into records: usage and the last use."""
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("record_id"), ms("l_shipdate").alias("ts"))
    r = table(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), F.lit(0).cast("long").alias("access_count"), F.lit(None).cast("long").alias("last_accessed_at"))
    return ingest.touch(r, l).where("access_count > 0").select(F.col("record_id").alias("p_partkey"), F.col("access_count").alias("accesses"), F.col("last_accessed_at").alias("last"))


@query("with m as (select 'o' || l_orderkey as r, 'p' || l_partkey as e from lineitem), c as (select e from m group by 1 having count(*) >= 2), n as (select r, count(*) as n from m join c using (e) group by 1) select 'o' || o_orderkey as record_id, round(greatest(0.5, least(3.0, 1.0 + least(0.5, 0.05 * coalesce(n, 0)))), 3) as importance from orders left join n on r = 'o' || o_orderkey")
def reweighed_records(spark, sf):
    """Records weigh more the more of their entities other records mention."""
    edges = table(spark, sf, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("mentions").alias("label"))
    r = table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("record_id"), F.lit(1.0).alias("importance_base"))
    return memory.reweigh(r, edges).select("record_id", "importance")


@query()
def memory_recall(spark, sf):
    """Facts about order status, recalled for every customer whose key is divisible by 50 by similarity and strength."""
    from quillgraph.plans.relational_queries import ordered_facts

    m = cut(memory.consolidate(ordered_facts(spark, sf))).withColumn("embedding", vectors.hash_embedding("memory"))
    c = table(spark, sf, "customer").where("c_custkey % 50 = 0")
    q = c.select(F.concat(F.lit("q"), "c_custkey").alias("query_id"), F.lit("u").alias("user_id"), F.concat(F.lit("status of customer "), "c_custkey").alias("query")).withColumn("vector", vectors.hash_embedding("query"))
    acl = m.select(F.lit("u").alias("user_id"), "virtual_record_id").distinct()
    return memory.recall(m, q, acl, 1_000_000_000_000).select("query_id", "id", "memory", F.round("similarity", 5).alias("similarity"), "rank")


@query()
def conversation_benchmark(spark, sf):
    """Conversations as cases, each turn an item, its own words the question: does the turn come back?"""
    from quillgraph.plans import benchmark

    c = table(spark, sf, "conversations")
    item = F.concat(F.lit("t"), "turn")
    history = c.select(F.col("conv_id").cast("string").alias("case_id"), item.alias("item_id"), "text", F.col("role").alias("speaker"), F.lit(None).cast("string").alias("timestamp"))
    asked = c.where("role = 'user'").select(F.col("conv_id").cast("string").alias("case_id"), F.concat_ws("/", "conv_id", item).alias("question_id"), F.array_join(T.salient_terms(F.col("text")), " ").alias("question"), F.lit("").alias("answer"), F.lit("single-hop").alias("category"), F.array(item).alias("evidence_ids"), F.lit(False).alias("abstain"))
    card, _, _ = benchmark.run(history, asked)
    return card.select("category", "n", *[F.round(x, 4).alias(x) for x in ("recall", "precision", "rr", "ndcg")])


@query(f"with {LEGS}, u as (select case when query_id = 'click' then 0 else 1 end as query_idx, point_id, rank, total as score from b where query_id in ('click', 'view')), o as (select * from u qualify row_number() over (partition by point_id order by query_idx, rank) = 1) select point_id, score from o order by score desc, point_id limit 20")
def several_wordings(spark, sf):
    hits = event_legs(spark, sf)["total"].where("query_id in ('click', 'view')")
    return retrieval.first_of_queries(hits.select(F.when(F.col("query_id") == "click", 0).otherwise(1).alias("query_idx"), "point_id", "rank", F.col("total").alias("score"))).select("point_id", "score")


@query("select o_orderkey from orders where o_orderstatus in ('O', 'P') and (o_orderpriority in ('5-LOW') or o_custkey in (1, 2, 3, 4, 5))")
def must_and_should(spark, sf):
    return table(spark, sf, "orders").where(retrieval.matching({"o_orderstatus": ["O", "P"]}, {"o_orderpriority": ["5-LOW"], "o_custkey": [1, 2, 3, 4, 5]})).select("o_orderkey")
