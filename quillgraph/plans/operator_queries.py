"""Queries of single operators: visible graphs, access, record pools, memories and reports, each with its SQL.

Orders are records that mention the parts on them; parts on neighbouring lines of an order are sold together; a
nation sees its customers' orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.config import Config
from quillgraph.functions import scores, vectors
from quillgraph.functions import text as T
from quillgraph.operators import acl as access
from quillgraph.operators import ann, audit, evaluate, facts, graph, ingest, memory, retrieval
from quillgraph.plans.registry import ms, query, table
from quillgraph.plans.relational_queries import NOTES, note_events, trade_graph
from quillgraph.plans.retrieval_queries import KNN, vector_tables
from quillgraph.plans.text_queries import salient_sql
from quillgraph.sources import export
from quillgraph.sources.store import by_keys
from quillgraph.streaming import sessions

MENTIONS = """
m as materialized (select distinct 'o' || l_orderkey as record_id, 'p' || l_partkey as e from lineitem),
a as materialized (select 'n' || c_nationkey as user_id, 'o' || o_orderkey as record_id, 'v' || o_orderkey as virtual_record_id from orders join customer on o_custkey = c_custkey),
r as materialized (select 'p' || x.l_partkey as src, 'p' || y.l_partkey as dst, 'sold_with' as label, count(*)::double as weight, case when x.l_partkey % 10 = 0 then 7 end as expired_at, list_sort(list(distinct 'o' || x.l_orderkey)) as provenance
  from lineitem x join lineitem y on x.l_orderkey = y.l_orderkey and y.l_linenumber = x.l_linenumber + 1 where x.l_partkey <> y.l_partkey group by x.l_partkey, y.l_partkey)
"""


def named(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def mention_tables(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, parts as entities, and access."""
    l, o, c, p = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "part"))
    none = F.lit(None).cast("long")
    # by record, in which few mentions come twice: what joins mentions by record finds them in place
    mentions = l.select(named("o", "l_orderkey").alias("src"), named("p", "l_partkey").alias("dst")).repartition("src").distinct().select("src", "dst", F.lit("mentions").alias("label"), F.lit(1.0).alias("weight"), none.alias("expired_at"), F.array("src").alias("provenance"))
    x = l.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("x"))
    pairs = x.join(l.select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"]).where("x <> l_partkey")
    sold = pairs.groupBy("x", "l_partkey").agg(F.count("*").cast("double").alias("weight"), F.array_sort(F.collect_set(named("o", "l_orderkey"))).alias("provenance"))
    sold = sold.select(named("p", "x").alias("src"), named("p", "l_partkey").alias("dst"), F.lit("sold_with").alias("label"), "weight", F.when(F.col("x") % 10 == 0, F.lit(7)).cast("long").alias("expired_at"), "provenance")
    entities = p.select(named("p", "p_partkey").alias("id"), F.col("p_name").alias("label"), F.lit("PRODUCT").alias("type"))
    acl = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(named("n", "c_nationkey").alias("user_id"), named("o", "o_orderkey").alias("record_id"), named("v", "o_orderkey").alias("virtual_record_id"))
    return mentions.unionByName(sold), entities, acl


@query(f"with {MENTIONS} select distinct user_id, e as id from m join a using (record_id)")
def scoped_entities(spark, sf):
    """Of every user the entities that its records mention."""
    return graph.knowledge_graph(*mention_tables(spark, sf))[0].select("user_id", "id")


@query(f"with {MENTIONS} select distinct user_id, src, dst, weight from (select src, dst, weight, unnest(provenance) as record_id from r where expired_at is null) join a using (record_id)")
def scoped_relations(spark, sf):
    """Of every user the live relations that its records assert."""
    return graph.knowledge_graph(*mention_tables(spark, sf), carry=("weight",))[1].select("user_id", "src", "dst", "weight")


@query(f"with {MENTIONS} select distinct user_id, e as id, record_id from m join a using (record_id) where substr(e, 2)::bigint % 50 = 0")
def impacted_records(spark, sf):
    """Records that mention one of the parts whose key is divisible by 50, for every user."""
    edges, _, acl = mention_tables(spark, sf)
    return graph.impact(edges, acl, table(spark, sf, "part").where("p_partkey % 50 = 0").select(named("p", "p_partkey").alias("id")))


@query(
    f"""with {MENTIONS}, rare as (select e, count(*) as deg from m group by 1 having count(*) <= 60),
s as (select 'q' || substr(record_id, 2) as query_id, user_id, record_id from a where substr(record_id, 2)::bigint % 50 = 0),
f as materialized (select distinct query_id, e from s join m using (record_id) where e in (select e from rare)),
hop as (select src as e, dst as "to" from r where expired_at is null union all select dst, src from r where expired_at is null),
near as (select query_id, e, deg from (select query_id, "to" as e from f join hop using (e) union select query_id, e from f) join rare using (e)),
kept as (select * from near qualify row_number() over (partition by query_id order by deg, e) <= 64),
found as (select query_id, record_id, count(*) as shared from kept join m using (e) group by 1, 2),
ok as (select found.* from found join s using (query_id) where exists (select 1 from a where a.user_id = s.user_id and a.record_id = found.record_id) and found.record_id <> s.record_id)
select query_id, record_id, shared, (row_number() over (partition by query_id order by shared desc, record_id))::int as rank from ok qualify rank <= 5"""
)
def related_by_entities(spark, sf):
    """Records that share rare entities with every order whose key is divisible by 50, or with neighbours of them."""
    edges, _, acl = mention_tables(spark, sf)
    seeds = acl.where(F.substring("record_id", 2, 20).cast("long") % 50 == 0).select(F.concat(F.lit("q"), F.substring("record_id", 2, 20)).alias("query_id"), "user_id", "record_id")
    return graph.related_records(edges, acl, seeds)


@query(f"with {MENTIONS}, w as (select user_id, virtual_record_id from a union all select 'n' || ((substr(user_id, 2)::bigint + 1) % 25), virtual_record_id from a) select w.user_id, w.virtual_record_id, a.user_id is not null as allowed from w left join a using (user_id, virtual_record_id)")
def access_checks(spark, sf):
    """May each order be read by its own nation, and by the next one?"""
    _, _, acl = mention_tables(spark, sf)
    other = F.concat(F.lit("n"), (F.substring("user_id", 2, 20).cast("long") + 1) % 25)
    wanted = acl.select("user_id", "virtual_record_id").unionByName(acl.select(other.alias("user_id"), "virtual_record_id"))
    return access.can_access(acl, wanted)


@query(
    """with p as (select 'n' || n_nationkey as name, trim(lower(n_name)) as q, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') as slug, n_name from nation),
e as (select 's' || s_suppkey as id, n_name || ' ' || s_name as label from supplier join nation on s_nationkey = n_nationkey union all select 'x' || n_nationkey, n_name from nation where n_nationkey % 2 = 0),
b as (select n_name as name, id, case when lower(label) = q then 0 else 1 end as tier from p join e on contains(lower(label), q) or (length(slug) >= 3 and contains(id, slug)))
select name, id from b qualify tier = min(tier) over (partition by name)"""
)
def resolved_names(spark, sf):
    """Nations' names among entities: those called so, else those whose label holds the name."""
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    ents = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(named("s", "s_suppkey").alias("id"), F.concat_ws(" ", "n_name", "s_name").alias("label"))
    ents = ents.unionByName(n.where("n_nationkey % 2 = 0").select(named("x", "n_nationkey").alias("id"), F.col("n_name").alias("label")))
    return graph.resolve(n.select(F.col("n_name").alias("name")), ents)


@query("select user_id, arg_max(event_type, event_id) as event_type, round(arg_max(value, event_id), 6) as value from events group by 1")
def node_upserts(spark, sf):
    """The last writer wins."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return facts.latest_nodes(e, "user_id", "event_id").select("user_id", "event_type", F.round("value", 6).alias("value"))


@query(
    f"""with {MENTIONS}, w as (select case when substr(e, 2)::bigint % 10 = 3 then 'p' || (substr(e, 2)::bigint - 1) else e end as to_e, e from (select distinct e from m)),
x as (select s.to_e as src, d.to_e as dst, label, weight, expired_at, provenance from r join w s on s.e = src join w d on d.e = dst)
select src, dst, sum(weight) as weight, case when count(*) filter (expired_at is null) = 0 then max(expired_at) end::bigint as expired_at, array_to_string(list_sort(list_distinct(flatten(list(provenance)))), ',') as provenance from x where src <> dst group by 1, 2"""
)
def merged_entities(spark, sf):
    """Every part whose key ends in 3 becomes one with the part before it."""
    edges, ents, _ = mention_tables(spark, sf)
    key = F.substring("id", 2, 20).cast("long")
    merges = ents.where(key % 10 == 3).select(F.col("id").alias("loser"), F.concat(F.lit("p"), key - 1).alias("winner"))
    rows = edges.where("label = 'sold_with'").withColumns({"created_at": F.lit(0), "valid_at": F.lit(0), "confidence": F.lit(1.0)})
    return facts.merge_entities(rows, merges).select("src", "dst", "weight", "expired_at", F.array_join("provenance", ",").alias("provenance"))


@query(
    f"""with {MENTIONS}, b as (select src, dst from r where substr(src, 2)::bigint % 3 = 0), f as (select src, dst, array_to_string(list_sort(list(distinct x.record_id)), ',') as p from b join m x on x.e = src join m y on y.e = dst and y.record_id = x.record_id group by 1, 2)
select r.src, r.dst, case when substr(r.src, 2)::bigint % 3 = 0 then coalesce(p, '') else array_to_string(provenance, ',') end as provenance from r left join f on f.src = r.src and f.dst = r.dst"""
)
def backfilled_provenance(spark, sf):
    """Edges that lost their provenance get the records that mention both ends."""
    edges, _, _ = mention_tables(spark, sf)
    lost = F.when(F.substring("src", 2, 20).cast("long") % 3 == 0, F.array().cast("array<string>")).otherwise(F.col("provenance"))
    bare = edges.where("label = 'sold_with'").withColumn("provenance", lost)
    return facts.backfill_provenance(bare, edges.where("label = 'mentions'")).select("src", "dst", F.array_join("provenance", ",").alias("provenance"))


NOW = 1_000_000_000_000
STATES = """
s as (select o_orderkey as id, 'order ' || o_orderkey as memory, o_orderstatus <> 'F' as is_latest, o_orderpriority = '5-LOW' as is_forgotten, case when o_custkey % 3 = 0 then epoch_ms(o_orderdate) end as forget_after, o_custkey % 6 = 0 as is_static,
  case when o_orderkey % 2 = 0 then 'semantic' else 'episodic' end as kind, epoch_ms(o_orderdate) as updated_at, o_custkey as use_count, o_totalprice / 1000000 as confidence, o_custkey from orders)
"""


def memory_states(spark, sf) -> DataFrame:
    """Orders as memories in all states."""
    day = ms("o_orderdate")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("order "), "o_orderkey").alias("memory"), (F.col("o_orderstatus") != "F").alias("is_latest"), (F.col("o_orderpriority") == "5-LOW").alias("is_forgotten"),
        F.when(F.col("o_custkey") % 3 == 0, day).alias("forget_after"), (F.col("o_custkey") % 6 == 0).alias("is_static"), F.when(F.col("o_orderkey") % 2 == 0, "semantic").otherwise("episodic").alias("kind"),
        day.alias("updated_at"), F.lit(None).cast("long").alias("last_used_at"), F.col("o_custkey").alias("use_count"), (F.col("o_totalprice") / 1000000).alias("confidence"), F.lit(None).cast("string").alias("forget_reason"), "o_custkey",
    )


@query(f"with {STATES} select id from s where is_latest and not is_forgotten and (forget_after is null or is_static or forget_after > 800000000000) and kind = 'semantic'")
def current_memories(spark, sf):
    """Latest, not forgotten, within their time to live."""
    return memory.current(memory_states(spark, sf), 800_000_000_000, "semantic").select("id")


@query(f"with {STATES}, t as (select *, coalesce(not is_static and not is_forgotten and forget_after <= 800000000000, false) as late from s) select id, is_forgotten or late as is_forgotten, case when late then 'expired' end as forget_reason from t")
def swept_memories(spark, sf):
    """Memories past their time to live are forgotten."""
    return memory.sweep(memory_states(spark, sf), 800_000_000_000).select("id", "is_forgotten", "forget_reason")


@query(f"with {STATES}, t as (select *, pow(0.5, greatest(0.0, ({NOW} - updated_at) / 86400000) / 30) * (1 + ln(1 + use_count)) * greatest(0.0, confidence) as strength from s) select o_custkey, id, (row_number() over (partition by o_custkey order by strength desc, updated_at desc, id))::int as rank from t qualify rank <= 3")
def strongest_memories(spark, sf):
    """Of every customer the three strongest memories."""
    m = memory_states(spark, sf).withColumn("strength", memory.strength(NOW))
    return retrieval.top_per_query(m, 3, F.desc("strength"), F.desc("updated_at"), F.col("id"), by="o_custkey").select("o_custkey", "id", "rank")


@query(
    f"""with v as materialized (select vec_id, list_transform(embedding, lambda x: x::double) as e, {NOW} - (vec_id % 90) * 86400000 as since from embeddings),
s as (select 'q' || q.vec_id as query_id, v.vec_id as id, list_cosine_similarity(q.e, v.e) as similarity, v.since from v, v q where q.vec_id % 50 = 0),
t as (select *, 0.7 * similarity + 0.3 * pow(0.5, ({NOW} - since) / 86400000.0 / 30) as score from s where similarity >= 0.15)
select query_id, id, round(similarity, 6) as similarity, (row_number() over (partition by query_id order by round(score, 9) desc, id))::int as rank from t qualify rank <= 8"""
)
def recalled_episodes(spark, sf):
    """Vectors as episodes: by similarity above the floor, blended with recency."""
    e = table(spark, sf, "embeddings")
    at = F.lit(NOW) - (F.col("vec_id") % 90) * 86_400_000
    m = e.select(F.col("vec_id").alias("id"), F.col("vec_id").cast("string").alias("memory"), "embedding", F.lit("vr").alias("virtual_record_id"), F.lit("episodic").alias("kind"), F.lit(True).alias("is_latest"), F.lit(False).alias("is_forgotten"), F.lit(None).cast("long").alias("forget_after"), F.lit(False).alias("is_static"), at.alias("occurred_at"), at.alias("created_at"), at.alias("updated_at"), F.lit(None).cast("long").alias("last_used_at"), F.lit(0).alias("use_count"), F.lit(1.0).alias("confidence"))
    q = e.where("vec_id % 50 = 0").select(named("q", "vec_id").alias("query_id"), F.lit("u").alias("user_id"), F.col("embedding").alias("vector"))
    acl = spark.createDataFrame([("u", "vr")], "user_id string, virtual_record_id string")
    return memory.recall(m, q, acl, NOW, "episodic").select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    """with v as materialized (select vec_id, 'g' || (vec_id % 100) as g, list_transform(embedding, lambda x: x::double) as e from embeddings),
s as (select 'q' || q.vec_id as query_id, v.vec_id as point_id, v.g, list_cosine_similarity(q.e, v.e) as score from v q, (select unnest([1, 2, 3, 4, 5]) as i), v where q.vec_id % 50 = 0 and v.g = 'g' || ((q.vec_id + i) % 100)),
b as (select * from s qualify row_number() over (partition by query_id, g order by score desc, point_id) = 1)
select query_id, point_id, round(score, 6) as score, (row_number() over (partition by query_id order by round(score, 9) desc, point_id))::int as rank from b"""
)
def graph_leg_topk(spark, sf):
    """Of five related records of each query the best vector."""
    e = table(spark, sf, "embeddings")
    chunks = e.select(F.col("vec_id").alias("point_id"), F.concat(F.lit("g"), F.col("vec_id") % 100).alias("virtual_record_id"), "embedding")
    q = e.where("vec_id % 50 = 0").select(named("q", "vec_id").alias("query_id"), "vec_id", F.col("embedding").alias("vector"))
    related = q.select("query_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.concat(F.lit("g"), (F.col("vec_id") + i) % 100))).alias("virtual_record_id"))
    return retrieval.graph_leg(chunks, q, related, 8).select("query_id", "point_id", F.round("score", 6).alias("score"), "rank")


@query(
    """select o_orderkey, round(1.0 / (60 + o_orderkey % 40) * case when o_custkey % 7 = o_custkey % 5 then 1.2 else 1.0 end
  * (1 + o_totalprice / 1000000) * (0.5 + 0.5 * exp(-(greatest(0.0, (1000000000000 - epoch_ms(o_orderdate)) / 86400000) * (0.6931471805599453 / 60)))) * (1 + 0.15 * ln(1 + o_custkey % 9)) * case when o_orderstatus = 'F' then 0.5 else 1.0 end, 8) as rrf from orders"""
)
def faded_pool(spark, sf):
    """Own records up, old and stale ones down."""
    o = table(spark, sf, "orders")
    key = named("o", "o_orderkey")
    pool = o.select("o_orderkey", key.alias("record_id"), F.concat(F.lit("u"), F.col("o_custkey") % 7).alias("user_id"), (1.0 / (60 + F.col("o_orderkey") % 40)).alias("rrf"))
    records = o.select(key.alias("record_id"), F.concat(F.lit("u"), F.col("o_custkey") % 5).alias("owner_id"), (1 + F.col("o_totalprice") / 1000000).alias("importance"), ms("o_orderdate").alias("last_accessed_at"), (F.col("o_custkey") % 9).alias("access_count"))
    edges = o.where("o_orderstatus = 'F'").select(F.lit("works_at").alias("label"), F.lit(1).alias("expired_at"), F.array(key).alias("provenance"))
    return retrieval.fade(pool, records, retrieval.stale_records(edges), NOW).select("o_orderkey", F.round("rrf", 8).alias("rrf"))


@query(
    f"""with f as (select conv_id, arg_min(coalesce(text, ''), turn) as q from conversations group by 1),
w as (select conv_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{{4,}}')) as w from conversations where turn < 5),
c as (select w.conv_id, q, w.w, count(*) as c from w join f using (conv_id) where not list_contains(regexp_extract_all(lower(q), '[a-z0-9]{{3,}}'), w.w) and w.w not in ({", ".join(repr(x) for x in T.COMMON)}) group by 1, 2, 3),
t as (select *, row_number() over (partition by conv_id order by c desc, w) as rank from c qualify rank <= 8)
select conv_id, q || ' ' || string_agg(w, ' ' order by rank) as expanded from t group by conv_id, q"""
)
def expanded_queries(spark, sf):
    """Each conversation's first text with the most frequent new words of its first five turns."""
    c = table(spark, sf, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"))
    pool = c.join(first, "conv_id").select(F.col("conv_id").alias("query_id"), "query", F.col("text").alias("content"), (F.col("turn") + 1).alias("rank"))
    return retrieval.expansion_terms(pool).select(F.col("query_id").alias("conv_id"), "expanded")


@query("select 'q' || o_orderkey as query_id, 'o' || o_orderkey as record_id, c_name as record_name from orders join customer on o_custkey = c_custkey where o_orderpriority <> '5-LOW' and o_orderstatus <> 'F' and o_orderkey % 2 = 0")
def enriched_hits(spark, sf):
    """Hits with their records' names; hits outside of what the user may see, without text or without a whole record drop."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    key = named("o", "o_orderkey")
    hits = o.select(named("q", "o_orderkey").alias("query_id"), F.lit("u").alias("user_id"), named("v", "o_orderkey").alias("virtual_record_id"), F.lit("claimed").alias("record_id"), "o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("content"))
    acl = o.where("o_orderkey % 2 = 0").select(F.lit("u").alias("user_id"), named("v", "o_orderkey").alias("virtual_record_id"), key.alias("record_id"))
    records = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(key.alias("record_id"), F.col("c_name").alias("record_name"), F.lit("text/plain").alias("mime_type"), F.when(F.col("o_orderstatus") != "F", "UPLOAD").alias("origin"), F.lit("org").alias("org_id"))
    return retrieval.enrich(hits, acl, records).select("query_id", "record_id", "record_name")


@query("with s as (select distinct c_nationkey from customer join orders on o_custkey = c_custkey), f as (select distinct c_nationkey from customer join orders on o_custkey = c_custkey where o_orderpriority = '1-URGENT' and o_totalprice > 450000) select 'n' || n_nationkey as user_id, case when n_nationkey in (select * from s) and n_nationkey in (select * from f) then 200 else 404 end as status from nation")
def search_status(spark, sf):
    """Of each nation whether its search found something."""
    _, _, acl = mention_tables(spark, sf)
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    hits = o.where("o_orderpriority = '1-URGENT' and o_totalprice > 450000").join(c, F.col("o_custkey") == F.col("c_custkey")).select(named("n", "c_nationkey").alias("user_id"))
    return retrieval.status(acl, table(spark, sf, "nation").select(named("n", "n_nationkey").alias("user_id")), hits)


@query("with f as (select conv_id, sum(ceil(length(text) / 4)) as a from conversations group by 1), s as (select conv_id, avg(t) as b from (select conv_id, turn, sum(ceil(length(text) / 4)) as t from conversations where role = 'user' group by 1, 2) group by 1) select conv_id, a::bigint as full_tokens, round(b, 6) as shown_tokens, round(a / b, 6) as reduction from f join s using (conv_id)")
def token_reduction(spark, sf):
    """How many tokens of a conversation a single user turn saves."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("query_id"), "text", "role")
    e = evaluate.efficiency(c.where("role = 'user'"), c)
    return e.select(F.col("case_id").alias("conv_id"), F.col("full_tokens").cast("long").alias("full_tokens"), F.round("shown_tokens", 6).alias("shown_tokens"), F.round("reduction", 6).alias("reduction"))


@query(f"with {salient_sql('select conv_id as key, arg_min(text, turn) as text from conversations group by 1')} select 'gold:' || key as query_id, terms as query from salient where n >= 2")
def gold_queries(spark, sf):
    """A query per conversation, of the longest words of its first turn."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("virtual_record_id"), F.col("turn").alias("point_id"), F.col("text").alias("content"))
    return evaluate.gold_set(c).select("query_id", "query")


@query(f"with {NOTES} select conv_id::varchar as session_id, md5(key) as key, last as last_seen_at from i where repeats > 0 and last >= 2")
def expired_sessions(spark, sf):
    """Items of sessions that were touched within the time to live."""
    return sessions.expire(sessions.fold_notes(note_events(spark, sf)), 3, 1).select("session_id", F.md5(F.lower("content")).alias("key"), "last_seen_at")


@query(
    """with g as materialized (select 's' || l_suppkey as src, 'n' || c_nationkey as dst, count(*)::double as weight from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2),
n as (select 's' || s_suppkey as id, 'suppliers' as coll from supplier union all select 'n' || n_nationkey, 'nations' from nation)
select 'collections' as section, '{"coll":"' || coll || '","n":' || count(*) || '}' as json from n group by coll
union all select 'labels', '{"label":"supplies","n":' || count(*) || '}' from g
union all select 'relations', '{"src":"' || src || '","label":"supplies","dst":"' || dst || '","weight":' || weight || '}' from g
union all select 'degrees', '{"id":"' || id || '","degree":' || count(*) || '}' from (select src as id from g union all select dst from g) group by id"""
)
def dashboard_export(spark, sf):
    """Counts by collection and label, relations and degrees as JSON."""
    nodes = table(spark, sf, "supplier").select(named("s", "s_suppkey").alias("id"), F.lit("suppliers").alias("coll")).unionByName(table(spark, sf, "nation").select(named("n", "n_nationkey").alias("id"), F.lit("nations").alias("coll")))
    return export.dashboard(nodes, trade_graph(spark, sf).withColumn("expired_at", F.lit(None).cast("long")))


@query("select o_orderkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)")
def key_lookups(spark, sf):
    """Rows whose keys are in a list of any length."""
    keys = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return by_keys(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), keys, "o_custkey").select("o_orderkey", "o_totalprice")


@query("select event_id, case when event_type = 'purchase' then 'chars:' || length(props) when length(p) > 120 then left(p, 117) || '...' else p end as target from (select *, repeat(props, 12) as p from events) order by event_id desc limit 50")
def newest_audit_entries(spark, sf):
    """The fifty newest entries of an audit log, without contents."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "ingest").otherwise("search").alias("action"), F.when(F.col("event_type") == "purchase", F.col("props")).otherwise(F.repeat("props", F.lit(12))).alias("target"))
    return audit.newest(e).select(F.col("id").alias("event_id"), audit.redacted(F.col("action"), F.col("target")).alias("target"))


@query(
    """with e as (select o_custkey as record_id, 'e' || (o_orderkey % 40) as id, o_orderpriority as label, case when o_orderstatus = 'O' then 0 else 1 end as source from orders)
select record_id, id, arg_min(label, source * 10 + substr(label, 1, 1)::int) as label from e group by 1, 2"""
)
def united_entities(spark, sf):
    """Entities of two extractors as one list: of equal ids the first extractor's counts."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("record_id"), F.concat(F.lit("e"), F.col("o_orderkey") % 40).alias("id"), F.col("o_orderpriority").alias("label"), "o_orderstatus")
    first, second = o.where("o_orderstatus = 'O'").drop("o_orderstatus"), o.where("o_orderstatus <> 'O'").drop("o_orderstatus")
    return ingest.united_entities(first, second, F.col("label"))


@query(
    """with r as (select l_orderkey as record_id, 'p' || (l_partkey % 9) as a, 'p' || (l_suppkey % 9) as b, 'sold' as label, l_linenumber as n, case when l_linenumber < 3 then 0 else 1 end as source from lineitem)
select record_id, least(a, b) as low, greatest(a, b) as high, arg_min(n, source * 100 + n)::int as n from r where a <> b group by 1, 2, 3"""
)
def united_relations(spark, sf):
    """Relations of two extractors as one list: whichever way round, the first extractor's counts."""
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.concat(F.lit("p"), F.col("l_partkey") % 9).alias("src"), F.concat(F.lit("p"), F.col("l_suppkey") % 9).alias("dst"), F.lit("sold").alias("label"), F.col("l_linenumber").cast("int").alias("n")).where("src <> dst")
    done = ingest.united_relations(l.where("n < 3"), l.where("n >= 3"), F.col("n"))
    return done.select("record_id", F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high"), "n")


@query("select vec_id, len(embedding) as n, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) as total from embeddings where vec_id % 3 > 0 union all select vec_id, 256, null from embeddings where vec_id % 3 = 0")
def reindexed_vectors(spark, sf):
    """Vectors of the wanted length stay, others are made anew from their text (the total of those isn't compared)."""
    e = table(spark, sf, "embeddings")
    t = e.select("vec_id", F.concat(F.lit("text "), "vec_id").alias("content"), F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding")).alias("embedding"))
    kept = ingest.reindex(t, 64)
    total = F.aggregate(vectors.doubles(F.col("embedding")), F.lit(0.0), lambda s, x: s + x)
    return kept.select("vec_id", F.size("embedding").cast("long").alias("n"), F.when(F.col("vec_id") % 3 > 0, F.round(total, 4)).alias("total"))


@query(
    """with v as materialized (select vec_id, list_transform(embedding, lambda x: x::double) as e, list_transform(list_slice(embedding, 1, 32), lambda x: x::double) as p from embeddings),
c as materialized (select vec_id, e, p, list_transform(p, lambda x: floor(x / list_max(list_transform(p, lambda y: abs(y))) * 127 + 0.5)) as codes from v),
s as (select 'q' || q.vec_id as query_id, c.vec_id as point_id, list_cosine_similarity(q.p, c.codes) as short, list_cosine_similarity(q.e, c.e) as score from c, c q where q.vec_id % 50 = 0),
l as (select *, row_number() over (partition by query_id order by round(short, 9) desc, point_id) as n from s)
select query_id, point_id, round(score, 6) as score, (row_number() over (partition by query_id order by round(score, 9) desc, point_id))::int as rank from l where n <= 64 qualify rank <= 8"""
)
def knn_by_codes(spark, sf):
    """Shortlists by 8-bit codes of halves of the vectors, then exact scores."""
    chunks, asked, _ = vector_tables(spark, sf)
    return retrieval.two_stage_knn(chunks, asked, 8, Config(mrl_prefix=32), codes=True).withColumn("score", F.round("score", 6))


@query()
def knn_approximate(spark, sf):
    """Neighbours by inverted lists: of queries whose id is divisible by 50, in the 8 lists nearest to each."""
    chunks, asked, _ = vector_tables(spark, sf)
    c = ann.centroids(chunks)
    indexed = ann.cut(ann.lists(chunks, c))
    return ann.search(indexed, c, asked, 8).withColumn("score", F.round("score", 6))


@query(f"with {NOTES} select count(distinct conv_id) as sessions, count(*) as items from i where repeats > 0")
def session_totals(spark, sf):
    return sessions.session_count(sessions.fold_notes(note_events(spark, sf)))


@query("select c_custkey, lower(to_base(list_reduce([unicode(c)::bigint for c in string_split(c_name, '')], lambda h, c: xor(h, c) * 16777619 & 4294967295, 2166136261::bigint), 36)) as hash from customer")
def content_hashes(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", vectors.content_hash(F.col("c_name")).alias("hash"))


@query("select o_orderkey, case o_orderkey % 3 when 0 then epoch_ms(o_orderdate) when 1 then epoch_ms(date_trunc('day', o_orderdate)) else 5 end as at from orders")
def parsed_times(spark, sf):
    """Times from numbers, dates in text, and neither."""
    text = F.when(F.col("o_orderkey") % 3 == 0, ms("o_orderdate").cast("string")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("some day")
    return table(spark, sf, "orders").select("o_orderkey", scores.when_ms(text, 5).alias("at"))


@query(r"""select conv_id, turn, regexp_matches(lower(coalesce(text, '')), '\b(all|both|compare|comparison|each|every|everything|list|summary|versus|vs)\b') as broad,
regexp_matches(coalesce(text, ''), '(?i)\b(prefer(ence)?s?|interests?|hobb(y|ies)|favou?rites?|passions?|tastes?)\b') or (regexp_matches(coalesce(text, ''), '(?i)\b(fond|keen|into|likes?|lov(ing|es?)|enjoy(s|ing)?|prefers?)\b') and regexp_matches(coalesce(text, ''), '(?i)\b(myself|mine|my|me|i''m|im|i)\b')) as preference from conversations""")
def query_classes(spark, sf):
    """Which texts ask for breadth, and which for preferences."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.wants_breadth(t).alias("broad"), T.asks_preference(t).alias("preference"))


@query(r"""with p as (select page_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(url, '^.*[/\\]', ''), '\.[A-Za-z0-9]{1,5}$', ''), '[-_ :#]+'), lambda p: not regexp_matches(p, '(?i)^([0-9a-f]{8,}|[0-9a-f-]{32,}|\d+)$')) as parts from pages) select page_id, trim(array_to_string(parts, ' ')) as name from p""")
def source_names(spark, sf):
    """Readable names of pages' sources."""
    return table(spark, sf, "pages").select("page_id", T.clean_source(F.col("url")).alias("name"))


@query("select doc_id, doc_id % 4 = 0 and coalesce(length(text), 0) >= 10 as is_binary from documents")
def binary_files(spark, sf):
    """Contents with a zero byte near their start, which a fourth of them are given here."""
    t = F.coalesce("text", F.lit(""))
    raw = F.encode(F.when((F.col("doc_id") % 4 == 0) & (F.length(t) >= 10), F.concat(F.substring(t, 1, 10), F.lit("\0"), t)).otherwise(t), "utf-8")
    return table(spark, sf, "documents").select("doc_id", T.is_binary(raw).alias("is_binary"))
