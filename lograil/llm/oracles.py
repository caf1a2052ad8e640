"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

from lograil.llm import license
from lograil.llm._common import WORD

_WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"

LINE_DEDUP = f"""
with d as (select doc_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as ls from documents),
l as (select doc_id, i - 1 as pos, ls[i] as line, ls[i + 1] as nxt from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from d)),
one as (select doc_id, pos from l qualify row_number() over (partition by line order by doc_id, pos) > 1 and len(regexp_extract_all(line, '{WORD}')) >= 8),
two as (select doc_id, pos from l where nxt is not null qualify row_number() over (partition by line, nxt order by doc_id, pos) > 1),
gone as (select doc_id, pos from one union select doc_id, pos from two union select doc_id, pos + 1 from two),
runs as (select doc_id, count(*) as c from (select doc_id, pos - row_number() over (partition by doc_id order by pos) as g from gone) group by doc_id, g),
longest as (select doc_id, max(c) as longest_run from runs group by doc_id),
left_over as (select l.doc_id, count(*) filter (gone.pos is not null) as n_removed, coalesce(string_agg(line, chr(10) order by l.pos) filter (gone.pos is null), '') as clean from l left join gone on l.doc_id = gone.doc_id and l.pos = gone.pos group by l.doc_id)
select d.doc_id, cast(coalesce(len(ls), 0) as bigint) as n_lines, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(longest_run, 0) as bigint) as longest_run,
case when coalesce(n_removed, 0) = 0 then text else clean end as text
from d left join left_over on d.doc_id = left_over.doc_id left join longest on d.doc_id = longest.doc_id
"""

QUALITY = f"""
with d as (select doc_id, coalesce(text, '') as text, {_WORDS} as ws from documents),
ln as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines, count(*) filter (regexp_matches(line, '^[\\x20\\x09-\\x0D]*[-*•]')) as bullets
  from (select doc_id, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '{WORD}') group by doc_id),
win as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as w3 from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from d)),
rep as (select doc_id, i from win qualify count(*) over (partition by doc_id, w3) > 1),
cov as (select doc_id, count(*) as n from (select doc_id, i from rep union select doc_id, i + 1 from rep union select doc_id, i + 2 from rep) group by doc_id),
m as (select d.doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words,
  len(list_filter(ws, lambda x: regexp_matches(x, '\\p{{L}}'))) as n_alpha, coalesce(n_lines, 0) as n_lines
  from d left join ln using (doc_id) left join cov using (doc_id))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
(n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or word_chars < 2 * n_words or word_chars > 15 * n_words or 10 * n_symbols > n_words or 10 * n_alpha < 7 * n_words) as kept
from m
"""

WARC = """
with p as (select page_id, coalesce(html, '') as html from pages),
f as (select page_id, html, strlen(html) as n, sha256(html) as d from p),
g as (select *, case when n >= 100 then min(page_id) over (partition by d) else page_id end as first from f)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
case when page_id <> first then first end as refers_to from g
"""

#: One row after another, a recursive step keeps the cheapest and least edits for each phase of the grammar (0 nothing, 1 s, 2 u, 3 a).
CONVERSATIONS = """
with recursive crc(t) as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))),
k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
h as (select k.*, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(key, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as f from k, crc),
d as (select conv_id, turn, case when f = 4 then 'user' else role end as role, case f when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when f = 3 then 2 else 1 end)) as copy from h where f <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from d),
r as (select conv_id, i, turn, role, text, role[1] as c, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1 when row_number() over (partition by conv_id, role, text order by i) > 1 then 2
  when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 3 else 0 end as fault, lag(role[1]) over (partition by conv_id order by i) as prev, count(*) over (partition by conv_id) as n from o),
moves(q, ins, p, pc, pi, pr) as (values (0, 0, 0, 0, '', []::varchar[]), (1, 0, 1, 0, '', []), (2, 0, 2, 0, '', []), (3, 0, 3, 0, '', []), (0, 1, 2, 3, 'I', ['user:']), (1, 1, 2, 3, 'I', ['user:']), (3, 1, 2, 3, 'I', ['user:']), (2, 1, 3, 3, 'I', ['assistant:']),
  (0, 2, 3, 6, 'II', ['user:', 'assistant:']), (1, 2, 3, 6, 'II', ['user:', 'assistant:']), (2, 2, 2, 6, 'II', ['assistant:', 'user:']), (3, 2, 3, 6, 'II', ['user:', 'assistant:'])),
dp as (select conv_id, 0::bigint as i, 0 as q, {'cost': 0::bigint, 'audit': '', 'texts': []::varchar[]} as best from (select distinct conv_id from r)
  union all
  select conv_id, i, q, min(best) as best from (
    select r.conv_id, r.i, case when a = 'D' then p when a = 'K' and p = 0 and c = 's' then 1 when p = 2 then 3 else 2 end as q,
      {'cost': dp.best.cost + pc + case a when 'D' then 4 when 'R' then 3 else 0 end + case when a <> 'D' and fault = 3 then 3 else 0 end, 'audit': dp.best.audit || pi || a,
       'texts': list_concat(list_concat(dp.best.texts, pr), case a when 'D' then []::varchar[] when 'K' then [role || ':' || text] else [case when p = 2 then 'assistant' else 'user' end || ':' || text] end)} as best
    from dp join r on dp.conv_id is not distinct from r.conv_id and r.i = dp.i + 1 join moves on moves.q = dp.q, (values ('D'), ('K'), ('R')) as e(a)
    where a = 'D' or (fault in (0, 3) and (a = 'R' or c = case when p = 2 then 'a' else 'u' end or (p = 0 and c = 's')))) group by conv_id, i, q),
ended as (select dp.conv_id, min({'cost': best.cost + t.c, 'audit': best.audit || t.a, 'texts': list_concat(best.texts, t.x)}) as best
  from dp join (select conv_id, max(n) as n from r group by conv_id) m on dp.conv_id is not distinct from m.conv_id and dp.i = m.n
  join (values (0, 0, '', []::varchar[]), (3, 0, '', []), (2, 3, 'I', ['assistant:']), (1, 6, 'II', ['user:', 'assistant:'])) as t(q, c, a, x) on t.q = dp.q group by dp.conv_id),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
  count(*) filter (prev is not null and prev || c not in ('su', 'ua', 'au')) as illegal from r group by conv_id)
select g.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank, cast(coalesce(duplicate, 0) as bigint) as duplicate, cast(coalesce(truncated, 0) as bigint) as truncated,
cast(coalesce(illegal, 0) as bigint) as illegal, cast(coalesce(best.cost, 0) as bigint) as cost, coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.texts, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) g left join counts on g.conv_id is not distinct from counts.conv_id left join ended on g.conv_id is not distinct from ended.conv_id
"""

_TERMS = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term"

BAG_SEARCH = f"""
with t as (select doc_id, {_TERMS} from documents),
n as (select doc_id, count(*) as n from t group by doc_id),
s as (select count(*) as docs, sum(n)::bigint as total from n),
f as (select doc_id, term, count(*) as tf from t group by doc_id, term),
q as (select distinct item_id, term from (select item_id, {_TERMS} from benchmark)),
w as (select term, floor(1000 * ln((2.0 * docs + 2)::double / (2.0 * count(*) + 1)::double))::bigint as w from f, s where term in (select term from q) group by term, docs),
d as (select doc_id, 100 - 50 + ((50 * n * docs) // total) as m from n, s),
r as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score from q join w using (term) join f using (term) join d using (doc_id) group by item_id, doc_id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from r where score > 0 qualify rank <= 50
"""

ORACLES = {"op12_bag_search": BAG_SEARCH, "op6_warc": WARC, "op13_conversations": CONVERSATIONS, "op3_quality": QUALITY, "op7_line_dedup": LINE_DEDUP, "op8_license": license.oracle()}
