"""Queries of access control, aggregation, edge and memory states, and streams, over the star schema and events.

Suppliers are users, nations groups, regions organisations; customers are record groups that their nation is granted
where they are of the building segment; orders are records that inherit from their customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators import acl, facts, graph, memory
from quillgraph.plans.registry import ms, query, table
from quillgraph.sources import export
from quillgraph.streaming import sessions


def access_tables(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    s, n, c, o = (table(spark, sf, t) for t in ("supplier", "nation", "customer", "orders"))
    at = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    users = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(at("s", "s_suppkey").alias("user_id"), at("r", "n_regionkey").alias("org_id"))
    null = F.lit(None).cast("string")
    principals = users.select(F.col("user_id").alias("id"), F.lit("users").alias("coll"), "user_id", null.alias("org_id"), null.alias("file_key"), F.lit("viewer").alias("role"))
    principals = principals.unionByName(n.select(at("n", "n_nationkey").alias("id"), F.lit("groups").alias("coll"), null.alias("user_id"), null.alias("org_id"), null.alias("file_key"), null.alias("role")))
    principals = principals.unionByName(c.select(at("g", "c_custkey").alias("id"), F.lit("recordGroups").alias("coll"), null.alias("user_id"), null.alias("org_id"), null.alias("file_key"), null.alias("role")))
    urgent = o.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    principals = principals.unionByName(urgent.select(at("a", "o_orderkey").alias("id"), F.lit("anyone").alias("coll"), null.alias("user_id"), at("r", "n_regionkey").alias("org_id"), at("o", "o_orderkey").alias("file_key"), null.alias("role")))
    edges = s.select(at("s", "s_suppkey").alias("src"), at("n", "s_nationkey").alias("dst"), F.lit("belongsTo").alias("label"))
    edges = edges.unionByName(c.where("c_mktsegment = 'BUILDING'").select(at("n", "c_nationkey").alias("src"), at("g", "c_custkey").alias("dst"), F.lit("permissions").alias("label")))
    edges = edges.unionByName(o.select(at("o", "o_orderkey").alias("src"), at("g", "o_custkey").alias("dst"), F.lit("inheritPermissions").alias("label")))
    records = o.select(at("o", "o_orderkey").alias("record_id"), at("v", "o_orderkey").alias("virtual_record_id"), F.col("o_orderpriority").alias("connector_id"), F.lit("CONNECTOR").alias("origin"), F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("COMPLETED").alias("indexing_status"))
    return users, principals, edges, records


ACL = """
u as (select s_suppkey, s_nationkey, n_regionkey from supplier join nation on s_nationkey = n_nationkey),
acl as (
  select distinct 's' || s_suppkey as user_id, 'v' || o_orderkey as virtual_record_id, 'o' || o_orderkey as record_id, s_nationkey, o_custkey from u join customer on c_nationkey = s_nationkey join orders on o_custkey = c_custkey
  where c_mktsegment = 'BUILDING' and o_orderstatus <> 'F'
  union
  select 's' || s_suppkey, 'v' || o_orderkey, 'o' || o_orderkey, s_nationkey, o_custkey from u join nation n on n.n_regionkey = u.n_regionkey join customer on c_nationkey = n.n_nationkey join orders on o_custkey = c_custkey
  where o_orderpriority = '1-URGENT' and o_orderstatus = 'P')
"""


@query(f"with {ACL} select user_id, virtual_record_id, record_id from acl")
def accessible_records(spark, sf):
    """Every user's records by all paths."""
    return acl.accessible(*access_tables(spark, sf))


@query(f"with {ACL} select user_id, count(*) as n, count(distinct o_custkey) as customers from acl group by 1")
def accessible_counts(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("record_id"), "o_custkey")
    seen, members = acl.accessible_to_classes(*access_tables(spark, sf))
    counts = seen.join(o, "record_id").groupBy("class").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))
    return members.join(counts, "class").select("user_id", "n", "customers")


@query("select 's' || s_suppkey as user_id, unnest(['s' || s_suppkey, 'n' || s_nationkey]) as principal from supplier")
def user_principals(spark, sf):
    users, principals, edges, _ = access_tables(spark, sf)
    return acl.principals_of(users.select("user_id"), edges, principals)


@query(
    """with q as (select 'q' || s_suppkey as request_id, 's' || s_suppkey as user_id, ['viewer', 'member', 'admin'][s_suppkey % 3 + 1] as role, ['create', 'modify', 'delete'][s_suppkey // 3 % 3 + 1] as action, s_suppkey % 2 = 0 as own,
  s_suppkey % 7 = 0 as shares_outside, s_suppkey % 5 = 4 as grants_outside from supplier),
r as (select *, case when action = 'create' and role = 'viewer' then 'viewers don''t create' when action <> 'create' and role <> 'admin' and not own then 'neither owner nor admin'
  when role <> 'admin' and shares_outside then 'shares outside of the organisation' when role <> 'admin' and grants_outside then 'grants outside of its scope' end as reason from q)
select request_id, user_id, action, reason is null as allowed, reason from r"""
)
def authorized_requests(spark, sf):
    """Requests of all roles and actions, on own and others' records, shared and granted inside and outside."""
    users, principals, edges, _ = access_tables(spark, sf)
    k = F.substring("user_id", 2, 20).cast("int")
    role = F.element_at(F.array(*map(F.lit, ("viewer", "member", "admin"))), k % 3 + 1)
    principals = principals.withColumn("role", F.when(F.col("coll") == "users", role))
    nation = edges.where("label = 'belongsTo'").select(F.col("src").alias("user_id"), F.col("dst").alias("nation"))
    asked = users.join(nation, "user_id").select(
        F.concat(F.lit("q"), k).alias("request_id"), "user_id", "org_id", F.element_at(F.array(*map(F.lit, ("create", "modify", "delete"))), (F.floor(k / 3) % 3 + 1).cast("int")).alias("action"),
        F.when(k % 2 == 0, F.col("user_id")).otherwise("s0").alias("owner_id"), F.when(k % 5 == 4, F.array("user_id", F.lit("stranger"))).when(k % 5 == 3, F.array("nation", "user_id")).otherwise(F.array("org_id")).alias("grants"),
        F.when(k % 7 == 0, "elsewhere").when(k % 7 == 1, F.col("org_id")).alias("share_with_org"),
    )
    return acl.authorize(asked, principals, edges)


@query("select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus in ('O')")
def facet_filter(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), "o_orderpriority", "o_orderstatus")
    facets = o.select("record_id", F.explode(F.create_map(F.lit("priority"), "o_orderpriority", F.lit("status"), "o_orderstatus")).alias("facet", "value"))
    return acl.filter_facets(o, facets, {"priority": ["1-URGENT", "2-HIGH"], "status": ["O"]}).select(F.col("record_id").alias("o_orderkey"))


def edge_events(spark, sf) -> DataFrame:
    """Events as asserts: users' signup value is functional, the other types accumulate; errors end a user's clicks."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    row = e.select("event_id", "event_type", ms("ts").alias("ts"), F.concat(F.lit("u"), "user_id").alias("src"), F.concat(F.lit("k"), k).alias("dst"), "value")
    asserts = row.where("event_type <> 'error'").select(F.col("event_id").alias("seq"), "ts", F.lit("assert").alias("op"), "src", "dst", F.when(F.col("event_type") == "signup", "works_at").otherwise(F.col("event_type")).alias("label"), F.lit(1.0).alias("weight"), F.col("ts").alias("valid_at"), F.col("value").alias("confidence"), F.concat(F.lit("rec"), F.floor(F.col("event_id") / 4)).alias("record_id"))
    null = lambda t: F.lit(None).cast(t)
    ends = row.where("event_type = 'error'").select(F.col("event_id").alias("seq"), "ts", F.lit("expire").alias("op"), "src", null("string").alias("dst"), F.lit("click").alias("label"), null("double").alias("weight"), null("long").alias("valid_at"), null("double").alias("confidence"), null("string").alias("record_id"))
    return asserts.unionByName(ends)


EDGES = """
e as (select event_id as seq, event_type, epoch_ms(ts) as ts, 'u' || user_id as src, 'k' || json_extract_string(props, '$.k') as dst, value, 'rec' || (event_id // 4) as rec from events),
a as (select *, case when event_type = 'signup' then 'works_at' else event_type end as label from e where event_type <> 'error'),
s as (select src, dst, label, count(*)::double as weight, min(ts) as created_at, arg_min(ts, seq) as valid_at, max(value) as confidence, list_sort(list(distinct rec)) as provenance, max(seq) as last, arg_max(ts, seq) as last_ts from a group by 1, 2, 3),
x as (select src, max(seq) as eseq, arg_max(ts, seq) as ets from e where event_type = 'error' group by 1),
t as (select s.*, case when label = 'works_at' then lead(last_ts) over (partition by src, label order by last) end as e3, case when label = 'click' and eseq > last then ets end as e2 from s left join x using (src)),
edges as (select src, dst, label, weight, created_at, valid_at, case when label = 'works_at' then e3 else e2 end as expired_at, provenance, confidence from t)
"""


@query(f"with {EDGES} select src, dst, label, weight, created_at, valid_at, expired_at, array_to_string(provenance, ',') as provenance, confidence from edges")
def edge_fold(spark, sf):
    return facts.fold_edges(edge_events(spark, sf)).withColumn("provenance", F.array_join("provenance", ","))


@query(f"with {EDGES} select label, count(*) as n, count(*) filter (expired_at is null) as live, count(*) filter (expired_at is null and label not in ('mentions', 'permissions', 'belongsTo', 'inheritPermissions', 'relates_to')) as typed from edges group by 1")
def edge_labels(spark, sf):
    e = facts.fold_edges(edge_events(spark, sf))
    live = F.col("expired_at").isNull()
    return e.groupBy("label").agg(F.count("*").alias("n"), F.count_if(live).alias("live"), F.count_if(live & facts.is_typed(F.col("label"))).alias("typed"))


@query(f"with {EDGES} select distinct unnest(provenance) as record_id from edges where expired_at is not null and label not in ('relates_to', 'mentions')")
def stale_records(spark, sf):
    from quillgraph.operators.retrieval import stale_records as stale

    return stale(facts.fold_edges(edge_events(spark, sf)))


@query(f"with {EDGES} select src, dst, label, case when list_contains(provenance, 'rec7') then len(provenance) - 1.0 else weight end::double as weight from edges where provenance <> ['rec7']")
def stripped_record(spark, sf):
    return facts.strip_record(facts.fold_edges(edge_events(spark, sf)), "rec7").select("src", "dst", "label", "weight")


def trade_graph(spark, sf) -> DataFrame:
    """Nations, their region, and suppliers and customers: who supplies whom with how many items."""
    l, o, s, c = (table(spark, sf, t) for t in ("lineitem", "orders", "supplier", "customer"))
    j = l.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    pairs = j.groupBy("l_suppkey", "c_nationkey").agg(F.count("*").cast("double").alias("weight"))
    return pairs.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit("supplies").alias("label"), "weight")


TRADE = """
g as materialized (select 's' || l_suppkey as src, 'n' || c_nationkey as dst, 'supplies' as label, count(*)::double as weight from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2),
adj as materialized (select src as node, dst as "to", weight, 'out' as dir from g union all select dst, src, weight, 'in' from g),
deg as materialized (select node, count(*) as degree, sum(weight) as strength from adj group by 1)
"""


@query(f"with {TRADE} select * from deg")
def node_degrees(spark, sf):
    return graph.degrees(trade_graph(spark, sf))


@query(f"with {TRADE} select * from deg order by strength desc, degree desc, node limit 10")
def central_entities(spark, sf):
    return graph.central(trade_graph(spark, sf))


@query(f"with {TRADE} select greatest(50, (list_sort(list(degree)))[least(count(*) - 1, floor(count(*) * 0.99))::int + 1])::bigint as hub from deg")
def hub_degree(spark, sf):
    return graph.hub_threshold(trade_graph(spark, sf))


@query(f"""with {TRADE} select node, "to", 'supplies' as label, dir, weight, (row_number() over (partition by node order by weight desc, "to", dir))::int as rank from adj where node in ('n3', 's7')""")
def neighbour_lists(spark, sf):
    ids = spark.createDataFrame([("n3",), ("s7",)], "id string")
    return graph.neighbours(trade_graph(spark, sf), ids)


def _rank_sql(rounds: int = 30, alpha: float = 0.85) -> str:
    parts = ["r0 as (select 's1' as node, 1.0::double as r)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} as materialized (select node, sum(r) as r from (select arcs.\"to\" as node, {alpha} * r * share as r from r{i} join arcs using (node) union all select 's1', {1 - alpha}::double) group by 1)")
    return f"with {TRADE}, arcs as materialized (select adj.node, \"to\", weight / strength as share from adj join deg using (node)), " + ", ".join(parts) + f" select node, round(r, 6) as score from r{rounds} where node <> 's1' and r > 0"


@query(_rank_sql())
def pagerank_walk(spark, sf):
    """Thirty rounds of a walk that restarts at a supplier."""
    return graph.pagerank(trade_graph(spark, sf), ["s1"]).select("node", F.round("score", 6).alias("score"))


@query("select 'c' || c_custkey as node, min(least('c' || c_custkey, 'x' || c_nationkey)) over (partition by c_nationkey) as component from customer union select 'x' || c_nationkey, min('c' || c_custkey) from customer group by c_nationkey")
def graph_components(spark, sf):
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("x"), "c_nationkey").alias("dst"), F.lit("lives_in").alias("label"), F.lit(1.0).alias("weight"))
    return graph.components(c)


@query(
    f"""with {TRADE}, hub as (select greatest(50, (list_sort(list(degree)))[least(count(*) - 1, floor(count(*) * 0.99))::int + 1]) as h from deg),
one as (select "to" as node from adj where node = 's1' and "to" in (select node from deg, hub where degree <= h)),
two as (select node, weight from adj where "to" = 's2' and node in (select node from one) order by weight desc, node limit 1)
select unnest([1, 2])::int as step, unnest(['s1', node]) as src, 'supplies' as label, unnest([node, 's2']) as dst from two"""
)
def shortest_paths(spark, sf):
    return graph.shortest_path(trade_graph(spark, sf), ["s1"], ["s2"])


@query()
def graph_communities(spark, sf):
    """Label propagation over who supplies whom, in one scope per region of the supplier."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    region = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("scope"))
    return graph.propagate_labels(trade_graph(spark, sf).join(region, "src"), "scope")


BELIEF = "b as (select distinct 'r' || n_regionkey as user_id, 'p' || l_partkey as src, lower(o_orderpriority) as label, o_orderstatus as dst from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"


def beliefs(spark, sf) -> DataFrame:
    """What regions hold about parts: with which priority they were ordered, and in which state the order is."""
    l, o, c, n = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(F.concat(F.lit("r"), "n_regionkey").alias("user_id"), F.concat(F.lit("p"), "l_partkey").alias("src"), F.lower("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("dst"))


@query(f"with {BELIEF}, x as (select src, label, dst from b where user_id = 'r0'), y as (select src, label, dst from b where user_id = 'r1') select *, 'r0' as \"only\" from (select * from x except select * from y) union all select *, 'r1' from (select * from y except select * from x)")
def belief_differences(spark, sf):
    return graph.belief_diff(beliefs(spark, sf), "r0", "r1")


@query(f"with {BELIEF} select src, label, dst from b where user_id in ('r0', 'r1', 'r2') group by 1, 2, 3 having count(distinct user_id) = 3")
def shared_beliefs(spark, sf):
    return graph.shared_beliefs(beliefs(spark, sf), ["r0", "r1", "r2"])


@query("select 'MERGE (n:Entity {id: ''n' || n_nationkey || '''}) SET n.label = ''' || n_name || ''', n.type = ''PLACE'';' as statement from nation union all select 'MATCH (a:Entity {id: ''n' || n_nationkey || '''}), (b:Entity {id: ''r' || n_regionkey || '''}) MERGE (a)-[r:PART_OF]->(b) SET r.weight = 1.0;' from nation")
def cypher_export(spark, sf):
    n = table(spark, sf, "nation")
    e = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit("PLACE").alias("type"))
    r = n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("part_of").alias("label"), F.lit(1.0).alias("weight"))
    return export.cypher(e, r).select("statement")


def ordered_facts(spark, sf) -> DataFrame:
    """Order status over time as facts about customers, numbered by day and key."""
    o = table(spark, sf, "orders")
    day = ms("o_orderdate")
    seq = (day / 86_400_000).cast("long") * 10_000_000_000 + F.col("o_orderkey")
    return o.select(seq.alias("seq"), day.alias("ts"), F.concat(F.lit("customer "), "o_custkey").alias("subject"), F.lit("Status is").alias("predicate"), F.col("o_orderstatus").alias("object"), F.lit(1.0).alias("confidence"), F.concat(F.lit("v"), "o_custkey").alias("virtual_record_id"), F.concat(F.lit("o"), "o_orderkey").alias("record_id"), F.lit("org").alias("org_id"))


VERSIONS = """
f as (select 'entity:customer-' || o_custkey || '|status_is' as subject_key, 'customer ' || o_custkey || ' status is ' || o_orderstatus as memory, epoch_ms(o_orderdate) as ts, (epoch_ms(o_orderdate) // 86400000) * 10000000000 + o_orderkey as seq from orders),
g as (select *, case when lag(memory) over w = memory then 0 else 1 end as new from f window w as (partition by subject_key order by seq)),
h as (select *, sum(new) over (partition by subject_key order by seq) as version from g),
v as (select subject_key, version::int as version, first(memory order by seq) as memory, min(ts) as created_at, max(ts) as updated_at from h group by 1, 2),
m as (select *, version = max(version) over (partition by subject_key) as is_latest from v)
"""


@query(f"with {VERSIONS} select subject_key, memory, version, is_latest, created_at, updated_at from m")
def memory_versions(spark, sf):
    return memory.consolidate_windows(ordered_facts(spark, sf))


@query(f"with {VERSIONS} select subject_key, memory, version, is_latest, created_at, updated_at from m")
def memory_consolidation(spark, sf):
    """The general fold, with certainties and contradictions, over the same facts."""
    return memory.consolidate(ordered_facts(spark, sf)).select("subject_key", "memory", "version", "is_latest", "created_at", "updated_at")


@query(f"with {VERSIONS}, r as (select *, rank() over (partition by subject_key order by created_at desc) as r from m where created_at <= 883612800000) select subject_key, memory, version from r where r = 1")
def facts_as_of(spark, sf):
    m = memory.consolidate_windows(ordered_facts(spark, sf)).withColumn("kind", F.lit("semantic"))
    return memory.as_of(m, 883_612_800_000).select("subject_key", "memory", "version")


@query(f"with {VERSIONS} select subject_key, version, memory, lag(memory) over (partition by subject_key order by version) as before from m")
def memory_history(spark, sf):
    m = memory.consolidate_windows(ordered_facts(spark, sf)).withColumns({"kind": F.lit("semantic"), "root_id": F.col("subject_key"), "is_forgotten": F.lit(False)})
    return memory.history(m).select(F.col("root_id").alias("subject_key"), "version", "memory", "before")


@query(f"with {VERSIONS} select created_at as at, 'fact' as kind, memory as text, version, not is_latest as superseded from m where subject_key like 'entity:customer-7|%'")
def fact_timeline(spark, sf):
    return memory.timeline(memory.consolidate(ordered_facts(spark, sf), subject="entity:customer-7"), "entity:customer-7")


@query(f"with {VERSIONS} select 'updated' as kind, a.memory as before, b.memory as after from m a join m b on a.subject_key = b.subject_key and b.version = a.version + 1")
def memory_revisions(spark, sf):
    return memory.revisions(memory.consolidate(ordered_facts(spark, sf)))


@query(f"with {VERSIONS} select 'semantic' as kind, count(*) as total, count(*) filter (is_latest) as current, 0::bigint as forgotten from m")
def memory_counts(spark, sf):
    return memory.counts(memory.consolidate(ordered_facts(spark, sf)))


@query("select event_type, epoch_ms(time_bucket(interval '1 day', ts)) as start, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling_windows(spark, sf):
    w = sessions.windows(table(spark, sf, "events"), "1 day")
    return w.select("event_type", ms("start").alias("start"), "n", F.round("total", 4).alias("total"))


@query("select event_type, epoch_ms(time_bucket(interval '6 hours', ts) - to_hours(k * 6)) as start, count(*) as n, round(sum(value), 4) as total from events, (select unnest([0, 1]) as k) group by 1, 2")
def sliding_windows(spark, sf):
    w = sessions.windows(table(spark, sf, "events"), "12 hours", "6 hours")
    return w.select("event_type", ms("start").alias("start"), "n", F.round("total", 4).alias("total"))


GAP = "e as (select *, case when epoch_ms(ts) - lag(epoch_ms(ts)) over (partition by user_id order by ts, event_id) > 43200000 then 1 when lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts, event_id) as session from e)"


@query(f"with {GAP} select user_id, session::bigint as session, count(*) as n, epoch_ms(min(ts)) as start from s group by 1, 2")
def session_numbers(spark, sf):
    e = sessions.session_numbers(table(spark, sf, "events").withColumn("ts_ms", ms("ts")), 43_200_000)
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts_ms").alias("start"))


@query(f"with {GAP.replace('> 43200000', '>= 43200000')} select user_id, epoch_ms(min(ts)) as start, count(*) as n from s group by user_id, session")
def session_windows(spark, sf):
    return sessions.sessions(table(spark, sf, "events"), "12 hours").select("user_id", ms("start").alias("start"), "n")


NOTES = r"n as (select conv_id, turn, role, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) as content from conversations), i as (select conv_id, lower(content) as key, count(*) filter (role <> 'assistant') as repeats, count(*) filter (role = 'assistant') as refs, bool_or(role = 'system') as important, min(turn) filter (role <> 'assistant') as first, max(turn) as last from n where content <> '' group by 1, 2)"


def note_events(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("ts"), F.when(F.col("role") == "assistant", "reference").otherwise("note").alias("op"), F.col("text").alias("content"), (F.col("role") == "system").alias("important"))


@query(f"with {NOTES} select conv_id::varchar as session_id, md5(key) as key, repeats::int as repeat_count, refs::int as ref_count, important, first as first_seen_at, last as last_seen_at from i where repeats > 0")
def working_memory(spark, sf):
    return sessions.fold_notes(note_events(spark, sf)).select("session_id", F.md5(F.lower("content")).alias("key"), "repeat_count", "ref_count", "important", "first_seen_at", "last_seen_at")


@query(f"with {NOTES} select conv_id::varchar as session_id, count(*) filter (important or repeats >= 2 or refs >= 2) as promoted, count(*) filter (not (important or repeats >= 2 or refs >= 2)) as dropped from i where repeats > 0 and last >= 0 group by 1")
def consolidated_sessions(spark, sf):
    return sessions.consolidate_session(sessions.fold_notes(note_events(spark, sf)), 0, "vr", 0)[1]


@query(
    """with recursive e as materialized (select user_id, epoch_ms(ts) as ts, row_number() over (partition by user_id order by epoch_ms(ts)) as n from events),
b as (select user_id, 1::bigint as n, ts, 2.0::double as level, true as allowed from e where n = 1
  union all select user_id, n, ts, case when l >= 1 then l - 1 else l end, l >= 1 from (select e.user_id, e.n, e.ts, least(3.0, b.level + (e.ts - b.ts) / 1000 * 0.0005) as l from b join e on e.user_id = b.user_id and e.n = b.n + 1))
select 'u' || user_id as key, count(*) filter (allowed) as allowed, count(*) filter (not allowed) as refused from b group by 1"""
)
def rate_limits(spark, sf):
    """A token bucket per user over all events."""
    e = table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("key"), ms("ts").alias("ts"), F.lit(1.0).alias("cost"))
    return sessions.token_bucket(e, 3, 0.0005).groupBy("key").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


@query("select coalesce(o_orderpriority, 'overall') as category, count(*) as n, round(avg(o_totalprice), 4) as mean from orders group by rollup (o_orderpriority)")
def category_rollup(spark, sf):
    r = table(spark, sf, "orders").rollup("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    return r.select(F.coalesce("o_orderpriority", F.lit("overall")).alias("category"), "n", "mean")


@query("with r as (select l_suppkey, l_partkey, count(*) as n, row_number() over (partition by l_suppkey order by count(*) desc, l_partkey) as rank from lineitem group by 1, 2) select l_suppkey, l_partkey, n, rank::int as rank from r where rank <= 3")
def top_per_group(spark, sf):
    """The bounded selection of the best per group."""
    l = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("n"), "l_partkey")
    return l.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
