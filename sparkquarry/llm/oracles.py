"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

op9_exact_dedup = f"""
with t as (select doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) as text_sha256 from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from t group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)
"""

op2_url_filter = f"""
with p as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
r(rule_host, rule_path, rule_verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
best as (
  select page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(rule_verdict, length(rule_host || rule_path)) as verdict
  from h join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by 1)
select h.page_id, host, path, rule, coalesce(verdict, case when regexp_matches(host, '(^|[.])(spam|casino|cheap|free|ads)-') then 'block' else 'allow' end) as verdict
from h left join best using (page_id)
"""

op6_chat_format = """
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, turn, role, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) t(turn, role)),
e as (select *, length(role) + length(text) + length(regexp_replace(role || text, '[^\\\\<\\[\\]]', '', 'g')) + 9 as piece from r)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256, sum(piece)::bigint as formatted_chars
from e group by 1
"""

op8_minhash_dedup = f"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from documents),
s as (
  select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) end as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as x from s),
p as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c
  from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p where 100 * c >= 75 * (na + nb - c)),
d as (select a, b from l union all select b, a from l),
r as (select doc_id as node, doc_id as low from documents union select d.b, r.low from r join d on d.a = r.node where r.low < d.b)
select doc_id, len(sh)::bigint as n_shingles, min(low) as component_id, min(low) = doc_id as kept from s join r on r.node = doc_id group by doc_id, sh
"""

op7_embedding_dedup = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
d as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
r as (select vec_id as node, vec_id as low from embeddings union select d.b, r.low from r join d on d.a = r.node where r.low < d.b),
c as (select node, min(low) as component_id from r group by 1),
n as (select a, count(*) as n from d group by 1)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, component_id = vec_id as kept from embeddings join c on node = vec_id left join n on a = vec_id
"""
