"""Queries of text, vector and score functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import chunking, extraction, names, scores, vectors
from quillgraph.functions import text as T
from quillgraph.plans.registry import ms, query, table

CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\*\*|__|`+', '', 'g'), '^\s*#{{1,6}}\s+', ''), '^\s*>+\s*', ''), '^[-*•▪◦\d.)\s]+', ''), '\s+', ' ', 'g'))"


@query("select page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') as slug from pages")
def slugify_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.slugify(F.col("url")).alias("slug"))


@query(f"select conv_id, turn, md5({CLEAN.format('text')}) as cleaned from conversations")
def clean_lines(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(T.clean_line(F.col("text"))).alias("cleaned"))


@query(
    f"""with l as (select doc_id, trim(unnest(string_split_regex(coalesce(text, ''), '\\r?\\n'))) as line from documents)
select doc_id, count(*)::bigint as n_lines, sum(case when line = '' or regexp_matches(line, '{T.BOILERPLATE}') or regexp_matches(line, '{T.NAVIGATION}') then 1 else 0 end)::bigint as n_boilerplate from l group by doc_id"""
)
def boilerplate_lines(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), r"\r?\n").alias("l"))
    return lines.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.size(F.filter("l", T.is_boilerplate)).cast("long").alias("n_boilerplate"))


@query("select item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 3))), ' ') as terms from benchmark")
def query_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(T.query_tokens(F.col("text"))), " ").alias("terms"))


@query("select c_custkey, list_reduce([unicode(c)::bigint for c in string_split(c_name, '')], lambda h, c: xor(h, c) * 16777619 & 4294967295, 2166136261::bigint) as hash from customer")
def fnv_hashes(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", vectors.fnv1a(F.col("c_name")).alias("hash"))


@query(
    """select doc_id, ceil(length(text) / 4)::bigint as tokens, regexp_matches(text, '[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{2066}-\\x{2069}\\x{FEFF}\\x{00AD}\\x{0000}-\\x{0008}\\x{000B}\\x{000C}\\x{000E}-\\x{001F}\\x{007F}-\\x{009F}]') as hidden,
strlen(text) <= 20000 as fits, md5(nfc_normalize(text)) as nfc from documents"""
)
def text_guards(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.approx_tokens(t).cast("long").alias("tokens"), T.has_hidden(t).alias("hidden"), T.within_size(t, 20000).alias("fits"), F.md5(T.nfc(t)).alias("nfc"))


@query(r"select p_partkey, regexp_replace(lower(p_name), '(ing|ed|es|s)$', '') as stem, regexp_replace(lower(trim(p_name)), '\s+', '_', 'g') as predicate from part")
def stems_and_predicates(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.stem(F.col("p_name")).alias("stem"), T.predicate(F.col("p_name")).alias("predicate"))


@query("select cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n, round(sum(value), 4) as total from events group by 1")
def json_properties(spark, sf):
    return table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    """with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
m as (select *, list_max(list_transform(e, lambda x: abs(x))) as top, sqrt(list_dot_product(e, e)) as n from v)
select vec_id, list_sum(list_transform(e, lambda x: floor(x * 127 / top + 0.5)))::bigint as codes, round(top / (127 * n), 8) as scale from m"""
)
def quantized_vectors(spark, sf):
    q = vectors.quantized(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", q.alias("q")).select("vec_id", F.aggregate("q.codes", F.lit(0).cast("long"), lambda s, x: s + x).alias("codes"), F.round("q.scale", 8).alias("scale"))


@query(
    """with v as (select vec_id, list_transform(list_slice(embedding, 1, 16), lambda x: x::double) as e, label from embeddings)
select vec_id, round(list_sum(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))), 6) as total from v"""
)
def vector_prefixes(spark, sf):
    p = vectors.prefix(F.col("embedding"), 16)
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(p, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(
    """with o as (select o_custkey, max(epoch_ms(o_orderdate)) as last, count(*) as n from orders group by 1)
select c_custkey, round((1 + c_acctbal / 10000) * (0.5 + 0.5 * exp(-(greatest(0.0, (1000000000000 - last) / 86400000) * (0.6931471805599453 / 60)))) * (1 + 0.15 * ln(1 + n)), 6) as weight,
round(pow(0.5, greatest(0.0, (1000000000000 - last) / 86400000) / 30) * (1 + ln(1 + n)) * greatest(0.0, c_acctbal / 10000), 6) as strength
from customer join o on c_custkey = o_custkey"""
)
def decay_and_strength(spark, sf):
    now = 1_000_000_000_000
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(ms("o_orderdate")).alias("last"), F.count("*").alias("n"))
    c = table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
    weight = scores.record_decay(now, 1 + F.col("c_acctbal") / 10000, F.col("last"), F.col("n"))
    strength = scores.memory_strength(now, F.col("last"), F.col("last"), F.col("n"), F.col("c_acctbal") / 10000)
    return c.select("c_custkey", F.round(weight, 6).alias("weight"), F.round(strength, 6).alias("strength"))


@query(f"select doc_id, round(least(3.0, greatest(0.5, 1 + case when regexp_matches(text, '{T.CUES}') then 0.5 else 0 end)), 3) as importance from documents")
def importance_cues(spark, sf):
    zero = F.lit(0)
    return table(spark, sf, "documents").select("doc_id", T.importance(zero, zero, zero, F.col("text")).alias("importance"))


@query(
    f"""with a as (select *, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[''’`]', '', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as f from conversations)
select conv_id, turn, f = '' or regexp_matches(f, '{T.REFUSALS}') as declines, md5(f) as form from a"""
)
def answer_forms(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.declines(F.col("text")).alias("declines"), F.md5(T.answer_form(F.col("text"))).alias("form"))


@query("select conv_id, turn, md5('<untrusted_memory id=\"' || turn || '\" source=\"' || role || '\">' || chr(10) || regexp_replace(nfc_normalize(text), '\\s+', '▁', 'g') || chr(10) || '</untrusted_memory>') as wrapped from conversations")
def spotlighted(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(T.wrap_untrusted(F.col("text"), F.col("role"), F.col("turn"), True)).alias("wrapped"))


@query()
def edit_distances(spark, sf):
    """Edits, swaps of neighbours among them, from each part's name to the one before it."""
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    before = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("q"))
    return p.join(before, "p_partkey").select("p_partkey", names.edit_distance("p_name", "q").alias("distance"))


@query()
def chunked_documents(spark, sf):
    """Chunks of all documents: number and letters per document."""
    cut = table(spark, sf, "documents").select("doc_id", chunking.chunk_text(T.strip_boilerplate(F.col("text"))).alias("c"))
    return cut.select("doc_id", F.size("c").alias("n_chunks"), F.aggregate("c", F.lit(0), lambda s, x: s + F.length(x)).alias("n_chars"))


@query()
def extracted_knowledge(spark, sf):
    """Entities and relations of all turns of conversations, counted by type."""
    k = table(spark, sf, "conversations").select(extraction.extract_knowledge("text").alias("k"))
    e = k.select(F.explode("k.entities").alias("e")).groupBy(F.lit("entity").alias("what"), F.col("e.type").alias("type")).agg(F.count("*").alias("n"))
    return e.unionByName(k.select(F.explode("k.relations").alias("r")).groupBy(F.lit("relation").alias("what"), F.col("r.type").alias("type")).agg(F.count("*").alias("n")))


@query()
def hash_embeddings(spark, sf):
    """The hashing embedder over all benchmark items: length, and the place of the largest number."""
    v = table(spark, sf, "benchmark").select("item_id", vectors.hash_embedding("text").alias("v"))
    return v.select("item_id", F.round(vectors.norm(F.col("v")), 4).alias("norm"), F.array_position("v", F.array_max("v")).alias("top"))


@query()
def best_passages(spark, sf):
    """Of each benchmark item the sentence that its own first words point to."""
    b = table(spark, sf, "benchmark")
    return b.select("item_id", T.best_passage(F.col("text"), F.slice(T.query_tokens(F.col("text")), 1, 3)).alias("passage"))


def salient_sql(source: str) -> str:
    """(key, terms) of source (key, text): the longest different words, ties in order of appearance."""
    return f"""w as (select key, unnest(x) as w, unnest(range(1, len(x) + 1)) as i from (select key, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]{{2,}}') as x from ({source}))),
d as (select key, w, min(i) as i from w where w not in ({", ".join(repr(x) for x in T.COMMON)}) group by 1, 2),
l as (select * from d qualify row_number() over (partition by key order by length(w) desc, i) <= 6),
salient as (select key, string_agg(w, ' ' order by length(w) desc, i) as terms, count(*) as n from l group by 1)"""


@query(f"with {salient_sql('select item_id as key, text from benchmark')} select item_id, coalesce(terms, '') as terms from benchmark left join salient on key = item_id")
def salient_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(T.salient_terms(F.col("text")), " ").alias("terms"))
