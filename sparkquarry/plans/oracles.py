"""DuckDB SQL for the queries of corpus.py."""

from __future__ import annotations

LINES = r"""
parts as (select doc_id, string_split_regex(coalesce(text, ''), '\r\n|\n|\r') as p from documents),
numbered as (select doc_id, unnest(range(1, len(p) + 1)) as line_no, unnest(p) as text, len(p) as n from parts),
lines as (select doc_id, line_no::int as line_no, text from numbered where not (line_no = n and text = ''))"""
SECRET = r"(?i)\b(password|passwd|api_?key|secret|token)\b\s*[:=]\s*[\"'']?[A-Za-z0-9_/+-]{8,}"
FINDINGS = (
    LINES
    + rf""",
hits as (
  select doc_id, line_no, text, unnest(list_filter([
    case when length(text) > 120 then 'TooLongLine' end, case when regexp_matches(text, '[^ \t][ \t]+$') then 'TrailingWhitespace' end,
    case when contains(text, chr(9)) then 'TabulationCharacter' end, case when regexp_matches(text, '{SECRET}') then 'HardcodedSecret' end], lambda x: x is not null)) as kind from lines),
findings as (
  select doc_id, doc_id::varchar as file_id, line_no as line, kind, case kind when 'HardcodedSecret' then 0 when 'TooLongLine' then 1 else 2 end as severity,
    case kind when 'TabulationCharacter' then 0 else 1 end as confidence, kind || ' ' || length(text) as message from hits)"""
)
MARKED = (
    FINDINGS
    + """,
markers as (select doc_id, line_no as marker_line from lines where regexp_matches(text, '(?i)licen[sc]e|^[a-d]')),
targets as (select m.doc_id, marker_line, min(l.line_no) as target_line from markers m join lines l on l.doc_id = m.doc_id and l.line_no > marker_line and trim(l.text, ' ') <> '' group by 1, 2),
covered as (select f.*, marker_line from findings f join targets t on t.doc_id = f.doc_id and target_line = line where kind <> 'HardcodedSecret'),
kept as (select * from findings f where not exists (select 1 from covered c where c.doc_id = f.doc_id and c.line = f.line and c.kind = f.kind))"""
)
HASHED = (
    FINDINGS
    + r""",
norm as (select doc_id, line_no, trim(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ') as norm from lines),
places as (select distinct doc_id, line from findings),
hashes as (select p.doc_id, line, 'v1:' || sha256(coalesce(string_agg(norm, chr(10) order by line_no) filter (where norm <> ''), '')) as context_hash from places p join norm n on n.doc_id = p.doc_id and line_no between line - 3 and line + 3 group by 1, 2),
full_findings as (select f.*, context_hash, sha256(file_id || '|' || kind || '||' || message) as fingerprint from findings f join hashes using (doc_id, line))"""
)


TEXTS = r"""
texts as (
  select 'd' || doc_id as id, text from documents union all
  select 'p' || p_partkey, case p_partkey % 7 when 0 then p_name || '  ' when 1 then p_name || chr(9) || p_brand when 2 then 'one' || chr(10) || 'TODO ' || p_name when 3 then 'see XXX ' || p_name
    when 4 then p_name || chr(10) || 'a' || chr(8203) || 'b' when 5 then ' ' else 'xxx todolist ' || p_name end from part)"""


def text_lines(more: str = "") -> str:
    return rf"""{TEXTS},
parts as (select id, string_split_regex(coalesce(text, ''), '\r\n|\n|\r') as p from (select * from texts {more})),
numbered as (select id, unnest(range(1, len(p) + 1)) as line_no, unnest(p) as text, len(p) as n from parts),
lines as (select id, line_no::int as line_no, text from numbered where not (line_no = n and text = ''))"""


def rule(test: str) -> str:
    return f"with {text_lines()} select id, line_no, length(text) as chars from lines where {test}"


SQL = {
    "line_split": f"with {LINES} select * from lines",
    "too_long_line": rule("length(text) > 120"),
    "trailing_whitespace": rule(r"regexp_matches(text, '[^ \t][ \t]+$')"),
    "tab_character": rule("contains(text, chr(9))"),
    "missing_header": f"with {LINES} select doc_id, count(*) as n_lines from lines group by 1 having not bool_or(line_no <= 3 and regexp_matches(text, '(?i)licen[sc]e|copyright'))",
    "empty_document": rf"with {TEXTS} select id, length(coalesce(text, '')) as chars from texts where not regexp_matches(coalesce(text, ''), '[^ \t\r\n]')",
    "duplicate_line": f"with {LINES} select doc_id, text, count(*) as n, min(line_no) as line, array_to_string(list_sort(list(line_no))[1:50], ',') as related_lines from lines where length(text) >= 4 group by 1, 2 having count(*) >= 3",
    "duplicate_block": rf"""
with {LINES},
norm as (select doc_id, line_no, translate(trim(regexp_replace(text, '[ \t]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from lines),
ix as (select *, row_number() over (partition by doc_id order by line_no) as ix from norm where norm <> ''),
win as (select doc_id, ix, line_no, max(line_no) over w as end_line, list(norm) over w as h from ix window w as (partition by doc_id order by line_no rows between current row and 2 following)),
grp as (select doc_id, h, list(ix order by ix) as ixs, list(line_no order by ix) as nos, list(end_line order by ix) as ends from win where len(h) = 3 group by 1, 2 having count(*) > 1),
shp as (select doc_id, ixs[1] as ix, nos[1] as line, ends[1] as end_line, list_transform(ixs, lambda x: x - ixs[1]) as shape, array_to_string(nos[2:51], ',') as related, len(ixs) as n from grp),
lagged as (select *, lag(ix) over (partition by doc_id, shape order by ix) as before from shp),
isl as (select *, sum(case when ix - before <= 3 then 0 else 1 end) over (partition by doc_id, shape order by ix) as island from lagged)
select doc_id, min(line) as line, max(end_line) as end_line, any_value(n) as n, arg_min(related, ix) as related_lines from isl group by doc_id, shape, island""",
    "unicode_safety": rf"""
with {text_lines("union all select 'h' || page_id, html from pages")}
select id, min(line_no) as line, count(*) as n from lines where regexp_matches(text, '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{2060}}\x{{061C}}\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}]') group by 1""",
    "http_url": r"""
with u as (select page_id, unnest(regexp_extract_all(concat_ws(chr(10), url, html), '(http://[^\s"''<>]+)', 1)) as target from pages)
select page_id, target, count(*) as n from u where not regexp_matches(target, '^http://(localhost|127\.0\.0\.1)([^A-Za-z0-9.]|$)') group by 1, 2""",
    "custom_rules": f"""
with {LINES},
hit as (select 'R1' as id, 1 as severity, doc_id from lines where contains(lower(text), 'licensed under') union all select 'R2', 0, doc_id from lines where regexp_matches(text, '[0-9]{{3}}-[0-9]{{4}}')
  union all select 'R3', 2, doc_id from lines where regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)'))
select id, severity, count(*) as n_lines, count(distinct doc_id) as n_docs from hit group by 1, 2""",
    "todo_marker": rf"""
with {text_lines("union all select 'c' || conv_id || '-' || turn, text from conversations")}
select id, line_no from lines where regexp_matches(text, '(?i)\b(TODO|FIXME|HACK)\b') or regexp_matches(text, '\bXXX\b')""",
    "secret_like": rf"with {LINES} select doc_id, line_no, lower(regexp_extract(text, '{SECRET}', 1)) as name from lines where regexp_matches(text, '{SECRET}')",
    "suppressed": f"with {MARKED} select file_id, line, kind from kept",
    "unused_markers": f"with {MARKED} select t.doc_id::varchar as file_id, marker_line from targets t where not exists (select 1 from covered c where c.doc_id = t.doc_id and c.marker_line = t.marker_line)",
    "path_override": f"""
with {FINDINGS},
g as (select source, kind, case when regexp_matches(source, '(?i)^src1.$') then 'drop' when regexp_matches(source, '(?i)^src1') then 'error' when lower(source) = 'src2' then 'hint' else '' end as action, severity from findings join documents using (doc_id) where severity <= 1)
select source, kind, case action when 'error' then 0 when 'hint' then 2 else severity end as severity, count(*) as n from g where action <> 'drop' group by 1, 2, 3""",
    "severity_gate": f"with {FINDINGS} select file_id, line, kind, severity from findings where severity <= 1 and kind in ('TooLongLine', 'HardcodedSecret', 'TabulationCharacter')",
    "confidence_filter": f"with {FINDINGS} select kind, confidence, count(*) as n from findings where confidence >= 1 group by 1, 2",
    "finding_fingerprint": f"with {FINDINGS} select file_id, line, kind, sha256(file_id || '|' || kind || '||' || message) as fingerprint from findings",
    "context_hashes": f"with {HASHED} select doc_id, line, kind, context_hash from full_findings",
    "baseline_new": f"""
with {HASHED}, known as (select * from full_findings where doc_id % 2 = 0)
select doc_id, line, kind from full_findings where context_hash not in (select context_hash from known) and fingerprint not in (select fingerprint from known)""",
    "enclosing_scope": """
with m as (select user_id, event_id, event_type || ':' || event_id as name from events where event_type in ('signup', 'purchase'))
select e.user_id, e.event_id, m.name as scope from events e asof left join m on m.user_id = e.user_id and m.event_id <= e.event_id where e.event_type in ('error', 'click')""",
    "grades": """
with s as (select user_id, case event_type when 'error' then 0 when 'purchase' then 1 else 2 end as severity from events),
t as (select user_id, sum(case severity when 0 then 100 when 1 then 10 else 1 end)::bigint as health, sum(case severity when 0 then 10 when 1 then 3 else 1 end)::bigint as quality from s group by 1)
select *, case when quality <= 0 then 'A' when quality <= 50 then 'B' when quality <= 200 then 'C' when quality <= 500 then 'D' else 'E' end as grade,
  case when health <= 49 then 'green' when health <= 499 then 'yellow' else 'red' end as light from t""",
    "severity_totals": "select event_type, count(*) filter (where event_type = 'error') as errors, count(*) filter (where event_type = 'purchase') as warnings, count(*) filter (where event_type not in ('error', 'purchase')) as hints from events group by 1",
    "top_kinds": f"with {FINDINGS} select kind, count(*) as n from findings group by 1 order by n desc, kind limit 10",
    "top_files": f"with {FINDINGS} select file_id, sum(case severity when 0 then 100 when 1 then 10 else 1 end)::bigint as score, count(*) as n from findings group by 1 order by score desc, file_id limit 10",
    "finding_rollup": f"with {FINDINGS} select severity, kind, count(*) as n, count(distinct file_id) as files from findings group by rollup (severity, kind)",
    "dead_after": "with l as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by event_id) as before from events) select user_id, event_id, event_type from l where before = 'error'",
    "nesting_depth": """
with s as (select user_id, event_id, sum(case event_type when 'signup' then 1 when 'purchase' then -1 else 0 end) over (partition by user_id order by event_id) as s from events)
select user_id, event_id, (s - least(0, min(s) over (partition by user_id order by event_id)))::bigint as depth from s""",
    "god_object": "with n as (select l_orderkey, count(*) as n from lineitem group by 1) select o_custkey, count(*) as n_orders, sum(coalesce(n, 0))::bigint as n_lines from orders left join n on l_orderkey = o_orderkey group by 1 having count(*) > 20 or sum(coalesce(n, 0)) > 80",
    "large_class": "with n as (select l_partkey, count(*) as n from lineitem group by 1) select p_partkey, p_size::bigint + coalesce(n, 0) as span from part left join n on l_partkey = p_partkey where p_size + coalesce(n, 0) > 70",
    "descendants": """
with recursive e as (select 'n' || n_nationkey as child, 'r' || n_regionkey as parent from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer),
up as (select child as node, parent as ancestor, 1::bigint as depth from e union all select u.node, e.parent, u.depth + 1 from up u join e on e.child = u.ancestor)
select node, ancestor, min(depth) as depth from up group by 1, 2""",
    "cycle_detect": """
with recursive e as (select distinct n_nationkey::bigint as child, (n_nationkey::bigint * 3 + 1) % 10 as parent from nation),
w as (select child as start, parent as cur, 1::bigint as size from e union all select w.start, e.parent, size + 1 from w join e on e.child = w.cur where w.cur <> w.start and size < 32)
select start as node, min(size) as size from w where cur = start group by 1""",
    "rule_recall": f"""
with {FINDINGS}, poor as (select distinct doc_id from labels where quality = 0), rules as (select unnest(['TooLongLine', 'TrailingWhitespace', 'TabulationCharacter', 'HardcodedSecret']) as rule), h as (select distinct kind as rule, doc_id from findings)
select r.rule, count(*) as injected, count(h.doc_id) as found, count(h.doc_id)::double / count(*) as recall from poor p cross join rules r left join h on h.rule = r.rule and h.doc_id = p.doc_id group by 1""",
    "false_positive_rate": f"""
with {FINDINGS}, l as (select doc_id, max(quality) as quality from labels group by 1), h as (select distinct kind as rule, doc_id from findings),
g as (select rule, count(*) as n, count(quality) as audited, count(*) filter (where quality = 1) as false_positives from h left join l using (doc_id) group by 1)
select *, false_positives::double / audited as rate, n * (false_positives::double / audited) as expected from g where audited > 0""",
    "stratified_sample": """
with r as (select doc_id, source, row_number() over (partition by source order by sha256('42:' || doc_id), doc_id) as rn, count(*) over (partition by source) as n from documents)
select doc_id, source from r where rn <= least(ceil(n * 0.3::double), 50)""",
    "diverse_sample": f"""
with {FINDINGS}, t as (select *, row_number() over (partition by kind, severity, file_id order by line) as turn from findings),
p as (select *, row_number() over (partition by kind order by severity, turn, file_id, line) as place from t)
select kind, file_id, line from p where place <= 25""",
    "telemetry_rank": """
with g as (select l_partkey, sum(l_quantity::bigint)::bigint as total, count(*) as calls, max(l_quantity::bigint) as max from lineitem group by 1)
select l_partkey, total, calls, total::double / calls as average, total::double / sum(total) over () as share, row_number() over (order by total desc, l_partkey) as rank, max from g""",
    "diff_gate": """
with h as (select max(event_id)::double / 2 as half from events), n as (select event_type, count(*) as n from events, h where event_id > half group by 1), w as (select event_type, count(*) as n from events, h where event_id <= half group by 1)
select coalesce(n.event_type, w.event_type) as event_type, coalesce(n.n, 0) as actual, coalesce(w.n, 0) as allowed, coalesce(n.n, 0) <= coalesce(w.n, 0) as ok from n full join w on n.event_type = w.event_type""",
    "watch_sessions": """
with g as (select user_id, event_id, ts, case when ts - lag(ts) over w < interval 1 hour then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from g)
select user_id, count(*) as n, arg_max(event_id, {'ts': ts, 'id': event_id}) as last_event from s group by user_id, session""",
    "unsorted_lists": "with l as (select l_orderkey, list(l_partkey order by l_linenumber, l_partkey) as parts from lineitem group by 1) select l_orderkey, len(parts) as n from l where parts <> list_sort(parts)",
    "repeated_section": "with l as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by event_id) as last from events) select user_id, event_id, event_type from l where event_type = last",
    "changed_scope": f"with {FINDINGS}, e as (select kind, count(distinct file_id) as files_with_kind from findings group by 1) select file_id, line, kind, files_with_kind from findings join e using (kind) where doc_id in (select doc_id from labels)",
    "ui_filter": f"with {FINDINGS} select file_id, line, message from findings where severity = 1 and contains(lower(concat_ws(chr(10), file_id, line, line, kind, severity, confidence, message)), 'line 12')",
    "ordered_report": f"with {FINDINGS} select file_id, line, kind, row_number() over (partition by file_id order by severity, line, kind, message) as nth from findings",
    "finding_text": f"with {FINDINGS} select file_id, string_agg(line || ' ' || kind, chr(10) order by line, kind, message) as body from findings group by 1",
    "source_grades": f"""
with {MARKED}, s as (select source, count(k.kind) as n, coalesce(sum(case k.severity when 0 then 100 when 1 then 10 when 2 then 1 end), 0)::bigint as score from documents d left join kept k on k.doc_id = d.doc_id and k.confidence >= 1 group by 1)
select *, case when score <= 0 then 'A' when score <= 50 then 'B' when score <= 200 then 'C' when score <= 500 then 'D' else 'E' end as grade from s""",
}
