"""DuckDB SQL for those queries of this package that SQL can express."""

from __future__ import annotations

from quillgraph.llm.licenses import PHRASES, TEMPLATES, regex_of, weight_of

OP2 = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), marked as (
  select *, coalesce(lag(role) over w = role, false) as joins, coalesce(lead(role) over w = role, false) as goes_on,
    length(role) + length(role) - length(replace(replace(role, '\', ''), '<', '')) as role_chars,
    length(text) + length(text) - length(replace(replace(text, '\', ''), '<', '')) as text_chars
  from rows window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(text_chars + case when joins then 8 else 8 + role_chars + 8 end + case when goes_on then 0 else 8 end)::bigint as formatted_chars
from marked group by conv_id
"""

AZ_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def op4() -> str:
    """Phrases by list positions; templates as regular expressions over words that a space follows each."""
    size = {p: len(p.split()) for p in PHRASES}
    at = " union all ".join(
        f"select rid, '{label}' as label, i - 1 as place from rows, lateral (select unnest(range(1, len(w) - {size[p] - 2})) as i) where len(w) >= {size[p]} and list_slice(w, i, i + {size[p] - 1}) = [{', '.join(repr(x) for x in p.split())}]"
        for p, label in PHRASES.items()
    )
    more = " union all ".join(f"select rid, '{label}' as label, {weight_of(t)} as t from rows where regexp_matches(' ' || array_to_string(w, ' ') || ' ', ' {regex_of(t)}')" for label, t in TEMPLATES.items())
    return f"""
with rows as materialized (select row_number() over () as rid, doc_id, {AZ_WORDS} as w from documents),
base as materialized ({at}), more as materialized ({more}),
b as (select rid, count(*) as n, min(place) as f, max(place) as l, string_agg(distinct label, ',' order by label) as s from base group by rid),
m as (select rid, max(t) as t, string_agg(distinct label, ',' order by label) as s from (select rid, label, 0.0 as t from base union all select rid, label, t from more) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_base, f::bigint as first_word, l::bigint as last_word, coalesce(b.s, '') as base_labels, coalesce(m.s, '') as labels,
  case when t > 0 then t when n > 0 then 0.5 else 0.0 end::double as score
from rows left join b using (rid) left join m using (rid)"""


OP3 = r"""
with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as t from documents),
s as materialized (select doc_id, case when len(t) = 0 then []::varchar[] when len(t) < 5 then [array_to_string(t, ' ')] else list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i : i + 4], ' '))) end as g from w),
x as materialized (select doc_id, hash(unnest(g)) as h from s),
p as (select a.doc_id as i, b.doc_id as j, count(*) as c from x a join x b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
l as materialized (select i, j from p join s a on a.doc_id = i join s b on b.doc_id = j where 100 * c >= 80 * (len(a.g) + len(b.g) - c)),
e as materialized (select i, j from l union all select j, i from l),
r as (select doc_id as node, doc_id as root from w union select e.j, r.root from r join e on r.node = e.i)
select s.doc_id, len(g)::bigint as n_shingles, (select count(*) from e where i = s.doc_id)::bigint as n_similar, (select min(root) from r where node = s.doc_id)::bigint as component_id from s
"""

OP7 = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as x from pages), t as (select *, max(page_id) over (partition by x) as top from p)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(x, 1 + (i // 4) * 5, 5))::bigint) >> (15 - 5 * (i % 4))) & 31)::int, 1)), '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id < top then top end as refers_to from t
"""

OP9 = """
with recursive v as materialized (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
l as materialized (select a.vec_id as i, b.vec_id as j from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
r as (select vec_id as node, vec_id as root from v union select l.j, r.root from r join l on r.node = l.i)
select vec_id, (select count(*) from l where i = vec_id)::bigint as n_links, (select min(root) from r where node = vec_id)::bigint as component_id, vec_id = (select min(root) from r where node = vec_id) as kept from v
"""

ORACLES = {"op2_chat_format": OP2, "op3_ngram_jaccard": OP3, "op4_license_scan": op4(), "op7_warc_merge": OP7, "op9_lattice_near_dup": OP9}
