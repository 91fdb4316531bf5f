"""SQL twins of the operators' queries, where SQL can express the result."""

from __future__ import annotations

JACCARD = r"""
with recursive words as (
  select doc_id, [part for part in string_split_regex(lower(coalesce(text, '')), '\s+') if part <> ''] as w from documents),
places as (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as pos from words where len(w) > 0),
grams as (select distinct doc_id, array_to_string(w[pos:pos + 4], ' ') as gram from places),
sizes as (select doc_id, count(*) as n from grams group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as n from grams a join grams b using (gram) where a.doc_id <> b.doc_id group by 1, 2),
blank as (select a.doc_id as a, b.doc_id as b from words a, words b where len(a.w) = 0 and len(b.w) = 0 and a.doc_id <> b.doc_id),
links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where common.n >= 0.8 * (x.n + y.n - common.n)
  union all select a, b from blank),
reach as (select doc_id as a, doc_id as b from documents union select reach.a, links.b from reach join links on links.a = reach.b)
select doc_id, (select min(b) from reach where a = doc_id) as class_id,
  (select count(*) from links where a = doc_id) as n_links, (select count(*) from reach where a = doc_id) as group_size
from documents
"""

HTML = r"""
with found as (select page_id, url, regexp_extract(html, '<article>(.*?)</article>', 1, 's') as article from pages),
flat as (select page_id, url, regexp_replace(regexp_replace(article, '</?b>', '', 'g'), '<[^>]+>', ' ', 'g') as flat from found),
plain as (select page_id, url, trim(regexp_replace(replace(replace(flat, '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) as text from flat)
select page_id, url, text, length(text) as n_chars from plain
"""

WARC = """
with read as (select page_id, coalesce(html, '') as body from pages),
sized as (select page_id, octet_length(encode(body)) as payload_bytes, sha256(body) as payload_digest, min(page_id) over (partition by body) as first from read)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and first <> page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and first <> page_id then first end as refers_to
from sized
"""

LEAKS = r"""
with flat as (select doc_id, regexp_replace(text, '\s+', ' ', 'g') as text from documents),
items as (select item_id, regexp_replace(text, '\s+', ' ', 'g') as item from benchmark),
found as (
  select doc_id, item_id, (length(text) - length(replace(text, item, ''))) // length(item) as times
  from flat, items where contains(text, item)),
counted as (select doc_id, sum(times) as n_leaks, array_to_string(list_sort(list(distinct item_id)), ',') as items from found group by 1)
select doc_id, cast(coalesce(n_leaks, 0) as bigint) as n_leaks, coalesce(items, '') as items, case when n_leaks > 0 then 1 else 0 end as contaminated
from documents left join counted using (doc_id)
"""

REPEATS = """
with read as (select doc_id, hex(coalesce(text, '')) as data, octet_length(encode(coalesce(text, ''))) as n from documents),
parts as (select doc_id, n, data, unnest(generate_series(0, (n - 1) // 512)) * 512 as low from read where n > 0),
pieces as (select doc_id, n, low, substr(data, 2 * low + 1, 1122) as piece from parts),
bytes as (select doc_id, n, low, piece, unnest(generate_series(0, least(511, n - low - 1))) as j from pieces),
strings as (
  select doc_id, n, low + j as pos, substr(piece, 2 * j + 1, 2) as byte,
    case when low + j + 50 <= n then hash(substr(piece, 2 * j + 1, 100)) end as string
  from bytes),
firsts as (select *, string is not null and doc_id > min(doc_id) over (partition by string) as again from strings),
marked as (select *, bool_or(again) over (partition by doc_id order by pos rows between 49 preceding and current row) as gone from firsts),
edged as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by pos), false) as begins from marked),
kept as (
  select doc_id, count(*) filter (gone) as n_removed, count(*) filter (begins) as n_spans,
    sha256(unhex(coalesce(string_agg(byte, '' order by pos) filter (not gone), ''))) as kept_sha256
  from edged group by 1)
select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, coalesce(kept_sha256, sha256('')) as kept_sha256
from read left join kept using (doc_id)
"""

AUDIT = r"""
with words as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
facts as (
  select doc_id, part, case when len(w) < 200 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
    || case when 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) then 'C' else '' end
    || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end
    || case when doc_id > min(doc_id) over (partition by text) then 'E' else '' end as fails
  from words),
docs as (
  select part, fails, case when quality = 1 then 1 else 0 end as good, case when toxic = 1 then 1 else 0 end as toxic
  from facts left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1) using (doc_id)),
cells as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from docs group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
orders as (
  select a.l || b.l || c.l || d.l || e.l as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps as (select filter_order, s as step, filter_order[s] as letter from orders, (select unnest([1, 2, 3, 4, 5]) as s)),
gone as (
  select part, filter_order, fails, n, good, toxic,
    coalesce((select min(s) from (select unnest([1, 2, 3, 4, 5]) as s) where contains(fails, filter_order[s])), 6) as removed_at
  from cells, orders),
found as (
  select part, filter_order, step, any_value(letter) as letter, sum(case when removed_at > step then n else 0 end) as kept,
    sum(case when removed_at = step then n else 0 end) as removed, sum(case when removed_at < step and contains(fails, letter) then n else 0 end) as redundant,
    sum(case when fails = letter then n else 0 end) as unique_fails, sum(case when removed_at = step then good else 0 end) as good_lost,
    sum(case when removed_at = step then toxic else 0 end) as toxic_lost
  from gone join steps using (filter_order) group by 1, 2, 3)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
  cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, letter) as bigint) as shapley
from found
"""

CHECKS = {
    "op3_jaccard": JACCARD,
    "op4_html": HTML,
    "op8_warc": WARC,
    "op9_decontamination": LEAKS,
    "op10_repeats": REPEATS,
    "op11_filter_audit": AUDIT,
}
