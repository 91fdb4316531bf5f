"""SQL twins of the registered queries, written for DuckDB."""

from __future__ import annotations

from logweir.functions.text import SEVERITY_PATTERN
from logweir.operators import alerts
from logweir.plans import queries as q

# ---------------------------------------------------------------- views

LINES = """
select event_id as line_no, ts, user_id, event_type,
  '/var/log/containers/pod' || (user_id % 7) || '_ns' || (user_id % 3) || '_svc' || (user_id % 5) || '-c' || user_id || '.log' as path,
  case when event_type = 'error' then 'stderr' else 'stdout' end as stream,
  case event_type when 'error' then 'ERROR' when 'purchase' then 'WARN' when 'signup' then 'INFO'
    when 'click' then 'DEBUG' else 'TRACE' end as level,
  case event_type when 'error' then 17 when 'purchase' then 13 when 'signup' then 9 when 'click' then 5 else 1 end as number,
  lpad(lower(to_hex(event_id)), 16, '0') as hex16,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as stamp
from events
"""
EVENTS = f"""
lines as ({LINES}),
event_lines as (
  select *, 'svc L:34 - ' || level || ' - req' || line_no || ' - ' || event_type || ' trace_id=' || hex16 as body,
    stamp || ' ' || stream || ' F svc L:34 - ' || level || ' - req' || line_no || ' - ' || event_type || ' trace_id=' || hex16 as line
  from lines),
records as (
  select *, '0000000000000000' || hex16 as trace,
    epoch_us(ts) * 1000 as nanos,
    'event.type=' || event_type || ';log.cri.flag=F;log.iostream=' || stream || ';log.level=' || level || ';request.id=req' || line_no as attributes,
    'container.id=c' || user_id || ';deployment.environment=test;k8s.container.name=svc' || (user_id % 5)
      || ';k8s.namespace.name=ns' || (user_id % 3) || ';k8s.pod.name=pod' || (user_id % 7) || ';log.file.path=' || path
      || ';log.source.rule=pods;log.source.type=container;service.name=shop' as resource
  from event_lines)
"""
# Sizes: 5 attributes and 9 resource entries, each its text without '=' and ';' plus 32.
SIZED = f"""{EVENTS},
sized as (
  select *, strlen(body) + case when line_no = 0 then 0 else 16 end + 128
    + (strlen(attributes) - 5 - 4 + 5 * 32) + (strlen(resource) - 9 - 8 + 9 * 32) as size
  from records)
"""
DOCS = """
doc_pieces as (select doc_id as file_key, strlen(text) as file_size, string_split(text, chr(10)) as l from documents),
doc_lines as (
  select file_key, file_size, cast(generate_subscripts(l, 1) - 1 as bigint) as line_no, unnest(l) as line from doc_pieces)
"""
OFFSETS = f"""{DOCS},
placed as (
  select *, cast(sum(strlen(line) + 1) over (partition by file_key order by line_no) as bigint) as end_offset from doc_lines),
doc_offsets as (select *, end_offset - strlen(line) - 1 as start_offset from placed)
"""
POSITIONS = f"""
positions as (
  select doc_id as file_key, '/data/docs/' || doc_id || '.log' as path,
    case when doc_id % 5 = 3 then strlen(text) + 10 else strlen(text) // 2 end as "offset",
    timestamp '2024-01-01 00:00:00' + to_hours(cast(doc_id % 48 as integer)) as updated_at
  from documents where doc_id % 5 <> 4),
live_files as (
  select case when doc_id % 10 = 3 then doc_id + 1000000 else doc_id end as file_key, '/data/docs/' || doc_id || '.log' as path
  from documents where doc_id % 7 <> 0)
"""
COMMITTED = f"""{OFFSETS},
committed as (
  select file_key, '/data/docs/' || file_key || '.log' as path, max(end_offset) as "offset", timestamp '{q.NOW}' as updated_at
  from doc_offsets where end_offset <= file_size group by file_key)
"""
CONVERSATIONS = """
conv_pieces as (select conv_id as file_key, turn, string_split(role || '> ' || text, chr(10)) as l from conversations),
conv_lines as (
  select file_key, row_number() over (partition by file_key order by turn, part) - 1 as line_no, line
  from (select file_key, turn, generate_subscripts(l, 1) as part, unnest(l) as line from conv_pieces))
"""


def _merge(lines: str, pattern: str) -> str:
    return f"""
select file_key, min(line_no) filter (line <> '') as first_line, max(line_no) as last_line,
  ltrim(string_agg(line, chr(10) order by line_no), chr(10)) as body,
  len(ltrim(string_agg(line, chr(10) order by line_no), chr(10)))
    - len(replace(ltrim(string_agg(line, chr(10) order by line_no), chr(10)), chr(10), '')) + 1 as lines
from (select *, sum(cast(regexp_matches(line, '{pattern}') as int)) over (partition by file_key order by line_no) as g from {lines})
group by file_key, g having min(line_no) filter (line <> '') is not null
"""


# One line after the other: the state of the open record of each file.
LIMITED = f"""with recursive {DOCS},
kept as (
  select file_key, line_no, case when strlen(line) > 700 then left(line, 700) else line end as line,
    regexp_matches(line, '^[A-M]') as edge from doc_lines),
steps as (
  select file_key, line_no, cast(0 as bigint) as start, cast(1 as bigint) as n, strlen(line) as used, line <> '' as has_text
  from kept where line_no = 0
  union all
  select d.file_key, d.line_no, case when cut then d.line_no else s.start end, case when cut then 1 else s.n + 1 end,
    case when not cut and s.has_text then s.used + 1 + strlen(d.line) else strlen(d.line) end,
    case when cut then d.line <> '' else s.has_text or d.line <> '' end
  from steps s join kept d on d.file_key = s.file_key and d.line_no = s.line_no + 1,
    lateral (select s.has_text and (d.edge or s.used + strlen(d.line) + 1 > 700 or s.n >= 3) as cut)
)
select k.file_key, min(k.line_no) filter (k.line <> '') as first_line, max(k.line_no) as last_line,
  ltrim(string_agg(k.line, chr(10) order by k.line_no), chr(10)) as body,
  len(ltrim(string_agg(k.line, chr(10) order by k.line_no), chr(10)))
    - len(replace(ltrim(string_agg(k.line, chr(10) order by k.line_no), chr(10)), chr(10), '')) + 1 as lines
from kept k join steps s on s.file_key = k.file_key and s.line_no = k.line_no
group by k.file_key, s.start having min(k.line_no) filter (k.line <> '') is not null
"""


def _severity(body: str) -> str:
    word = f"upper(regexp_extract(string_split({body}, chr(10))[1], '{SEVERITY_PATTERN}', 1))"
    return f"""case when {word} in ('TRACE') then 'TRACE' when {word} in ('DEBUG') then 'DEBUG'
  when {word} in ('INFO', 'NOTICE') then 'INFO' when {word} in ('WARN', 'WARNING') then 'WARN'
  when {word} in ('ERROR', 'ERR') then 'ERROR'
  when {word} in ('FATAL', 'CRITICAL', 'CRIT', 'ALERT', 'EMERG', 'PANIC') then 'FATAL' else '' end"""


NUMBER = """cast(case severity_text when 'TRACE' then 1 when 'DEBUG' then 5 when 'INFO' then 9 when 'WARN' then 13
  when 'ERROR' then 17 when 'FATAL' then 21 else 0 end as integer)"""

MIXED = f"""{EVENTS},
mixed as (select line_no, path, case when line_no % 10 = 0 then substr(line, 29) else line end as line from event_lines),
cri as (
  select line_no, path, line, regexp_matches(line, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T') as ok,
    regexp_extract(line, '(?s)^([^ ]*) (stdout|stderr) ([PF]) (.*)\\z', 1) as stamp,
    regexp_extract(line, '(?s)^([^ ]*) (stdout|stderr) ([PF]) (.*)\\z', 2) as stream,
    regexp_extract(line, '(?s)^([^ ]*) (stdout|stderr) ([PF]) (.*)\\z', 3) as flag,
    regexp_extract(line, '(?s)^([^ ]*) (stdout|stderr) ([PF]) (.*)\\z', 4) as body
  from mixed),
timed as (select *, case when ok then epoch_us(cast(rtrim(stamp, 'Z') as timestamp)) end as us from cri)
"""

# ---------------------------------------------------------------- targets

PROCESSES = """
processes as (
  select 'node' || (c_custkey % 3) as host, c_custkey // 3 as pid, lower(c_mktsegment) as comm, 'java -jar ' || c_name || '.jar --nation=' || c_nationkey as cmdline from customer),
open_files as (
  select 'node' || (o_custkey % 3) as host, o_custkey // 3 as pid, o_orderkey as fd_order,
    case when o_orderkey % 11 = 0 then 'pipe:[' else '/data/' || lower(o_orderstatus) || '/' end || (o_orderkey % 4000)
      || case when o_orderkey % 13 = 0 then '.log (deleted)' when o_orderkey % 5 = 0 then '.tmp' else '.log' end as path
  from orders),
looked as (
  select *, regexp_matches(comm, '^(machinery|house)') or true as looks from processes),
matched as (
  select host, pid, comm, cmdline, 0 as rule_idx, 'building' as rule from looked where regexp_matches(comm, '^building$')
  union all
  select host, pid, comm, cmdline, 1, 'nations' from looked
    where regexp_matches(comm, '^(machinery|house)') and regexp_matches(cmdline, '--nation=1\\d$')
  union all
  select host, pid, comm, cmdline, 2, 'seven' from looked where regexp_matches(cmdline, '7\\.jar')),
opened as (
  select m.*, o.fd_order, regexp_replace(o.path, ' \\(deleted\\)$', '') as path from matched m join open_files o using (host, pid)),
chosen as (
  select * from opened where path like '/%' and case rule
    when 'building' then regexp_matches(path, '\\.(log|tmp)$') and not regexp_matches(path, '\\.tmp$')
    when 'nations' then regexp_matches(path, '^/data/[of]/')
    else regexp_matches(path, '\\.log$') end),
targets as (
  select * exclude (nth) from (
    select *, row_number() over (partition by host, pid, rule order by fd_order) as nth from chosen)
  where nth <= case rule when 'building' then 3 when 'seven' then 2 else 1000000000 end)
"""
LISTING = """listing as (
  select distinct host, regexp_replace(path, ' \\(deleted\\)$', '') as path from open_files where path like '/%')"""
FIRST = f"""with {PROCESSES}, {LISTING},
every as (
  select host, path, 'process' as source_type, rule, 0 as rank, pid as process_idx, rule_idx, fd_order as include_idx from targets
  union all
  select host, path, 'file', 'finished', 1, 0, 0,
    case when regexp_matches(path, '^/data/f/[^/]*\\.log$') then 0 else 1 end from listing
    where (regexp_matches(path, '^/data/f/[^/]*\\.log$') or regexp_matches(path, '^/data/f/1[^/]*\\.tmp$'))
      and not regexp_matches(path, '^/data/f/[^/]*9\\.log$')
  union all
  select host, path, 'file', 'all', 1, 0, 1, 0 from listing where regexp_matches(path, '^/data/[^/]/[^/]*\\.log$'))
select host, path, source_type, rule, cast(process_idx as bigint) as process_idx, cast(include_idx as bigint) as include_idx
from (select *, row_number() over (partition by host, path order by rank, process_idx, rule_idx, include_idx) as nth from every) where nth = 1
"""

# ---------------------------------------------------------------- export

BATCHES = f"""{SIZED},
numbered as (
  select *, 'pod' || (user_id % 7) as pod, row_number() over (partition by user_id % 7 order by line_no) - 1 as pos
  from sized where level <> 'TRACE'),
steps as (
  select pod, pos, cast(pos as bigint) as batch, cast(1 as bigint) as n, cast(size as bigint) as used from numbered where pos = 0
  union all
  select r.pod, r.pos, case when s.n >= 20 or s.used + r.size > 8000 or s.used >= 8000 then r.pos else s.batch end,
    case when s.n >= 20 or s.used + r.size > 8000 or s.used >= 8000 then 1 else s.n + 1 end,
    case when s.n >= 20 or s.used + r.size > 8000 or s.used >= 8000 then r.size else s.used + r.size end
  from steps s join numbered r on r.pod = s.pod and r.pos = s.pos + 1)
"""

SCHEDULE = """with recursive tries as (
  select event_id // 16 as batch_id, event_id % 16 + 1 as attempt, ts as tried,
    case event_type when 'error' then 503 when 'click' then 429 when 'view' then 500
      when 'signup' then case when event_id % 3 = 0 then 401 end
      else case when event_id % 4 = 0 then 200 else 408 end end as status,
    case when event_id % 6 = 0 then (event_id % 50) * 60000 else 0 end as asked
  from events),
steps as (
  select t.batch_id, cast(0 as bigint) as attempt, tried as started, tried, cast(30000 as bigint) as following, cast(0 as bigint) as wait, 'none' as outcome
  from tries t where attempt = 1
  union all
  select s.batch_id, t.attempt, s.started, t.tried, least(1200000, w * 2), w,
    case when t.status between 200 and 299 then 'ok'
      when t.status not in (408, 429) and t.status < 500 then 'permanent'
      when (epoch_us(t.tried) - epoch_us(s.started)) // 1000 + w > 3000000 then 'gave_up'
      when t.status is null then 'retry_network' else 'retry_status' end
  from steps s join tries t on t.batch_id = s.batch_id and t.attempt = s.attempt + 1,
    lateral (select case when t.status in (408, 429) or t.status >= 500 then greatest(s.following, t.asked) else s.following end as w)
  where s.outcome not in ('ok', 'permanent', 'gave_up'))
select batch_id, cast(attempt as integer) as attempts, outcome,
  case when outcome like 'retry%' then wait else -1 end as wait_ms,
  case when outcome like 'retry%' then epoch_us(tried) + wait * 1000 else -1 end as next_us
from steps qualify row_number() over (partition by batch_id order by attempt desc) = 1
"""

# ---------------------------------------------------------------- alerts

SENT = f"""{EVENTS},
candidates as (
  select *, case when contains(body, 'req11') then 'req11' when contains(body, 'req2') then 'req2' end as ignored_by
  from records where level in ('ERROR', 'WARN')),
sent as (select * from candidates where ignored_by is null)
"""
_ESCAPED = r"regexp_replace({0}, '([\\`<>])', '\\\1', 'g')"
# Value of each part, in the order of the message.
_VALUES = {
    "environment": "'test'", "host": "'node1'", "time": "strftime(ts, '%Y-%m-%d %H:%M:%S')", "level": "level",
    "error_type": "case when contains(body, 'purchase') then 'purchase' when contains(body, 'error') then 'error' else '' end",
    "source": "'pods'", "request_id": "'req' || line_no", "file": "path",
}


def _parts() -> list[tuple[str, str, str]]:
    out = [(alerts.TITLE_PREFIX, "'Shop `alerts`'", "")]
    for name, label, marked in alerts.FIELDS:
        out.append((f"> **{label}：** " + (alerts.OPEN if marked else ""), _VALUES[name], alerts.CLOSE if marked else ""))
    return out


def _full_message() -> str:
    pieces = [f"'{prefix}' || {_ESCAPED.format(value)} || '{suffix}'" for prefix, value, suffix in _parts()]
    head = " || chr(10) || ".join(pieces)
    body = f"'> {alerts.OPEN}' || {_ESCAPED.format('body')} || '{alerts.CLOSE}'"
    return f"{head} || chr(10) || chr(10) || '{alerts.BODY_HEADING}' || chr(10) || {body}"


def _bounded_messages() -> str:
    """The budgeted writer, one step per part."""
    steps = [f"w0 as (select *, '' as content, [40, 120, 200, 290, 400][cast(line_no % 5 as int) + 1] as room from sent)"]
    parts: list[tuple[str, str, str] | None] = [*_parts(), None, (alerts.BODY_HEADING, "''", ""), (f"> {alerts.OPEN}", "body", alerts.CLOSE)]
    mark = len(alerts.TRUNCATED)
    for index, part in enumerate(parts):
        if part is None:
            steps.append(
                f"w{index + 1} as (select * exclude (content, room), "
                f"case when room > 0 and content <> '' then content || chr(10) else content end as content, "
                f"case when room > 0 and content <> '' then room - 1 else room end as room from w{index})"
            )
            continue
        prefix, value, suffix = part
        fixed = f"(case when content = '' then 0 else 1 end + {len(prefix) + len(suffix)})"
        steps.append(
            f"v{index} as (select *, {_ESCAPED.format(value)} as v, room - {fixed} as free from w{index}), "
            f"u{index} as (select *, case when len(v) <= free then v when free <= {mark} then left(v, greatest(free, 0)) "
            f"else left(v, free - {mark}) || '{alerts.TRUNCATED}' end as shown from v{index}), "
            f"w{index + 1} as (select * exclude (content, room, v, free, shown), "
            f"case when free < 0 then content else content || case when content = '' then '' else chr(10) end "
            f"|| '{prefix}' || shown || '{suffix}' end as content, "
            f"case when free < 0 then room else free - len(shown) end as room from u{index})"
        )
    return f"with {SENT}, " + ", ".join(steps) + f" select line_no, content from w{len(parts)}"


# ---------------------------------------------------------------- flow control


def _parts_of(rate: float, burst: int) -> tuple[int, int, int]:
    scale = q.flow.Scale(rate, burst)
    return scale.gain, scale.unit, scale.full


def _late(rate: float, burst: int, key: str, columns: str) -> str:
    gain, unit, _ = _parts_of(rate, burst)
    return f"""
with a as (
  select {key} as key, event_id as seq, cast(epoch_us(ts) as hugeint) * {gain} as due,
    row_number() over (partition by {key} order by ts, event_id) as i from events),
b as (select *, max(due - i * cast({unit} as hugeint)) over (partition by key order by i) as m from a)
select {columns}, cast((greatest(due, m + (i + 1 - {burst}) * cast({unit} as hugeint)) + {gain - 1}) // {gain} as bigint) as admit_us from b
"""


def _drop(rate: float, burst: int, key: str) -> str:
    gain, unit, full = _parts_of(rate, burst)
    return f"""
a as (
  select {key} as key, event_id as seq, ts, epoch_us(ts) as us, row_number() over (partition by {key} order by ts, event_id) as i from events),
steps as (
  select key, seq, ts, i, us, cast({full - unit} as bigint) as have, true as admitted from a where i = 1
  union all
  select n.key, n.seq, n.ts, n.i, n.us, case when h >= {unit} then h - {unit} else h end, h >= {unit}
  from steps s join a n on n.key = s.key and n.i = s.i + 1,
    lateral (select least({full}, s.have + (n.us - s.us) * {gain}) as h))
"""


_USER = _drop(q.USER_RATE, q.USER_BURST, "user_id")
CHECKS = {
    "scan_text_files": """
select source, line, count(*) as n from (select source, unnest(string_split(text, chr(10))) as line from documents)
where source like 'src1%' and not regexp_matches(source, '^src1[5-9]$') group by source, line""",
    "scan_offsets": """
with pieces as (select doc_id // 50 as part, doc_id, string_split(text, chr(10)) as l from documents),
rows as (select part, doc_id, generate_subscripts(l, 1) as n, unnest(l) as line from pieces),
placed as (
  select *, row_number() over w - 1 as line_no, cast(sum(strlen(line) + 1) over w as bigint) as end_offset
  from rows window w as (partition by part order by doc_id, n))
select part, line_no, end_offset - strlen(line) - 1 as start_offset, end_offset, line from placed""",
    "resumed_scan": """
with pieces as (select doc_id // 50 as part, doc_id, string_split(text, chr(10)) as l from documents),
rows as (select part, doc_id, generate_subscripts(l, 1) as n, unnest(l) as line from pieces),
placed as (
  select *, row_number() over w - 1 as line_no, cast(sum(strlen(line) + 1) over w as bigint) as end_offset
  from rows window w as (partition by part order by doc_id, n)),
sizes as (select part, max(end_offset) as size from placed group by 1),
starts as (
  select part, case when part % 5 = 4 then case when part % 2 = 0 then size else 0 end when part % 5 = 3 then 0 else size // 2 end as start
  from sizes)
select part, line_no, end_offset - strlen(line) - 1 as start_offset, end_offset from placed join starts using (part)
where end_offset - strlen(line) - 1 >= start and end_offset - strlen(line) - 1 < start + 20000""",
    "incomplete_tail": f"with {OFFSETS} select file_key, line_no, start_offset, end_offset from doc_offsets where end_offset <= file_size",
    "incomplete_tail_quick": f"with {OFFSETS} select file_key, line_no, line from doc_offsets where end_offset <= file_size",
    "clean_lines": f"""with {DOCS}
select file_key, line_no, left(case when line_no % 3 = 0 then line || chr(65533) else line end, 60) as line from doc_lines""",
    "round_cap": f"""with {OFFSETS} select file_key, line_no, line from doc_offsets where start_offset < 2048""",
    "resumed_lines": f"""with {OFFSETS}, {POSITIONS}
select d.file_key, line_no, start_offset, end_offset from doc_offsets d left join positions p using (file_key)
where start_offset >= case when p."offset" is null and d.file_key % 2 = 0 then file_size when p."offset" > file_size then 0
  else coalesce(p."offset", 0) end""",
    "committed_offsets": f"""with {COMMITTED} select file_key, path, "offset", epoch_us(updated_at) as updated_us from committed""",
    "merged_positions": f"""with {COMMITTED}, {POSITIONS}
select coalesce(p.file_key, c.file_key) as file_key,
  case when c.file_key is null or (c.path = p.path and c."offset" = p."offset") then p.path else c.path end as path,
  case when c.file_key is null or (c.path = p.path and c."offset" = p."offset") then p."offset" else c."offset" end as "offset",
  case when c.file_key is null or (c.path = p.path and c."offset" = p."offset") then epoch_us(p.updated_at) else epoch_us(c.updated_at) end as updated_us
from positions p full join committed c on p.file_key = c.file_key""",
    "pruned_positions": f"""with {POSITIONS}
select file_key, path, "offset" from positions p where updated_at < timestamp '2024-01-02 06:00:00'
  and not exists (select 1 from live_files l where l.file_key = p.file_key and l.path = p.path)""",
    "line_groups": f"""with {DOCS}
select file_key, line_no, cast(sum(cast(regexp_matches(line, '^[A-M]') as int)) over (partition by file_key order by line_no) as bigint) as "group"
from doc_lines""",
    "merged_documents": f"with {DOCS} {_merge('doc_lines', '^[A-M]')}",
    "merged_documents_limited": LIMITED,
    "merged_conversations": f"with {CONVERSATIONS} {_merge('conv_lines', '^user> ')}",
    "cri_fields": f"""with {MIXED}
select line_no, path, ok as cri_ok, cast(us as varchar) as ts_us, cast(us * 1000 as varchar) as time_unix_nano, case when ok then stream end as stream,
  case when ok then flag end as flag, case when ok then body else line end as body,
  case when ok then 'log.cri.flag=' || flag || ';log.iostream=' || stream else '' end as attributes from timed""",
    "cri_varied": """
select event_id as line_no, epoch_us(ts) as ts_us, epoch_us(ts) * 1000 + case when event_id % 5 = 3 then 123 else 0 end as time_unix_nano,
  case event_id % 5 when 1 then 28800 when 4 then -19800 else 0 end as utc_offset, case when event_id % 2 = 0 then 'stdout' else 'stderr' end as stream,
  case when event_id % 7 = 3 then 'P' else 'F' end as flag,
  'id=' || case event_id % 4 when 0 then lpad(lower(to_hex(event_id + 1)), 16, '0') when 1 then lpad(lower(to_hex(event_id)), 32, 'a')
    when 2 then lpad(lower(to_hex(event_id)), 15, 'b') else repeat('0', 32) end || '.' as body from events""",
    "trace_id_widths": """
select event_id as line_no, case event_id % 4 when 0 then lpad(lower(to_hex(event_id + 1)), 32, '0')
  when 1 then lpad(lower(to_hex(event_id)), 32, 'a') end as trace_id from events""",
    "severities": f"""with {EVENTS}, found as (select line_no, {_severity('body')} as severity_text from records)
select line_no, severity_text, {NUMBER} as severity_number, 'log.level=' || severity_text as level from found""",
    "document_severities": f"""
with bodies as (
  select doc_id, ['[warning]', 'x=Err:', 'alert', 'superpanic ', 'CRIT' || chr(10), chr(10) || 'ERROR', '(notice) fatal'][cast(doc_id % 7 as int) + 1] || text as body
  from documents),
found as (select doc_id, {_severity('body')} as severity_text from bodies)
select doc_id, severity_text, {NUMBER} as severity_number from found""",
    "extracted_attributes": f"with {EVENTS} select line_no, attributes from records",
    "trace_ids": f"""with {EVENTS}
select line_no, case when line_no = 0 then null else trace end as completed,
  case when len(cast(line_no as varchar)) = 16 then '' end as too_short, 'req' || line_no as raw from records""",
    "event_times": f"""with {MIXED}
select line_no, coalesce(us, {q.NOW_MICROS}) * 1000 as time_unix_nano, coalesce(us, {q.NOW_MICROS}) as ts_us, cast({q.NOW_MICROS} as bigint) as observed_us
from timed""",
    "container_names": f"""with {EVENTS}
select distinct path, 'container.id=c' || user_id || ';k8s.container.name=svc' || (user_id % 5)
  || ';k8s.namespace.name=ns' || (user_id % 3) || ';k8s.pod.name=pod' || (user_id % 7) as attributes from records""",
    "resources": f"""with {EVENTS}
select distinct path, replace(replace(resource, '=', '|'), ';', '|') || '|' as resource_key from records""",
    "record_sizes": f"with {SIZED} select line_no, cast(size as bigint) as size from sized",
    "document_sizes": """
select doc_id, cast(strlen(text) + 128 + strlen(lang) + strlen(source) + 32 as bigint) as size from documents""",
    "log_records": f"""with {EVENTS}
select line_no, '{{"timeUnixNano":"' || nanos || '","observedTimeUnixNano":"{q.NOW_MICROS}000","severityNumber":' || number
  || ',"severityText":"' || level || '","body":{{"stringValue":"' || body || '"}},"attributes":['
  || '{{"key":"event.type","value":{{"stringValue":"' || event_type || '"}}}},{{"key":"log.cri.flag","value":{{"stringValue":"F"}}}},'
  || '{{"key":"log.iostream","value":{{"stringValue":"' || stream || '"}}}},{{"key":"log.level","value":{{"stringValue":"' || level
  || '"}}}},{{"key":"request.id","value":{{"stringValue":"req' || line_no || '"}}}}]'
  || case when line_no = 0 then '' else ',"traceId":"' || trace || '"' end || '}}' as record from records""",
    "kept_records": f"with {EVENTS} select line_no, level as severity_text, body from records where level <> 'TRACE'",
    "severity_by_resource": f"""with {EVENTS}
select replace(replace(resource, '=', '|'), ';', '|') || '|' as resource, level as severity_text, count(*) as records
from records where level <> 'TRACE' group by all""",
    "rule_matches": f"with {PROCESSES} select host, pid, comm, cmdline, cast(rule_idx as integer) as rule_idx, rule from matched",
    "opened_paths": f"with {PROCESSES} select host, pid, rule, fd_order, path from chosen",
    "process_targets": f"""with {PROCESSES}
select host, pid, rule, fd_order, path, 'log.file.path=' || path || ';log.source.rule=' || rule || ';log.source.type=process;process.command_line='
  || cmdline || ';process.name=' || comm || ';process.pid=' || pid
  || case rule when 'building' then ';team=b' when 'nations' then ';team=n' else '' end as resource from targets""",
    "process_paths": f"""with {PROCESSES}
select host, pid, rule, fd_order, case when fd_order % 3 = 0 then '/proc/' || pid || '/root' || path else path end as path, path as reported_path, 'log.file.path=' || path || ';log.source.rule=' || rule || ';log.source.type=process;process.command_line='
  || cmdline || ';process.name=' || comm || ';process.pid=' || pid
  || case rule when 'building' then ';team=b' when 'nations' then ';team=n' else '' end as resource from targets""",
    "first_targets": FIRST,
    "new_targets": """
select doc_id, '/data/docs/' || doc_id || '.log' as path from documents where doc_id % 7 = 0""",
    "excluded_paths": f"with {PROCESSES}, {LISTING} select host, path from listing l where path not in (select path from listing where regexp_matches(path, '^/data/[of]/1[^/]*\\.log$'))",
    "seen_paths": f"""with {EVENTS}
select path, max(us) as seen_us from (
  select path, epoch_us(ts) as us from records
  union all select path, {q.NOW_MICROS - 86_400_000_000} from records where path like '%pod3\\_%' escape '\\')
group by path having {q.NOW_MICROS - 86_400_000_000} - max(us) <= 36000000000""",
    "rule_options": f"""with {PROCESSES}
select host, pid, rule, case rule when 'building' then 'beginning' else 'end' end as start_at,
  cast(case rule when 'nations' then 250 else 5000 end as bigint) as flush_after_ms from matched""",
    "oversize_records": f"with {SIZED} select line_no, cast(size as bigint) as size, size <= 760 as fits from sized",
    "export_batches": f"""with recursive {BATCHES}
select pod, line_no, pos, cast(size as bigint) as size, batch from numbered join steps using (pod, pos)""",
    "batch_resources": f"""with recursive {BATCHES},
grouped as (
  select pod, batch, path, resource, cast(count(*) as integer) as records, string_agg(cast(nanos as varchar), ',' order by pos) as times
  from numbered join steps using (pod, pos) group by pod, batch, path, resource)
select pod, batch, cast(row_number() over (partition by pod, batch order by replace(replace(resource, '=', chr(1)), ';', chr(1))) - 1 as integer) as nth, path, records, times from grouped""",
    "exported_requests": f"""with {EVENTS}
select 'logweir' as scope, resource, attributes, cast(nanos as varchar) as time, '{q.NOW_MICROS}000' as observed,
  cast(number as integer) as severity_number, level as severity_text, body, case when line_no = 0 then null else trace end as trace_id
from records where level <> 'TRACE'""",
    "delivery_schedule": SCHEDULE,
    "retry_waits": f"""
select event_id, cast(case event_id % 6 when 0 then event_id % 100 * 1000 when 1 then event_id % 10 * 1000 + 250 when 5 then 0
  else greatest(epoch_us(date_trunc('second', ts)) - {q.NOW_MICROS}, 0) // 1000 end as bigint) as wait_ms from events""",
    "reply_outcomes": """
select event_id, case when event_id % 5 = 0 then 'network_error' when event_id % 4 in (2, 3) then 'http_error' when event_id % 3 = 0 then 'bad_answer'
  when event_type = 'error' then 'rejected' else 'ok' end as outcome from events""",
    "alert_candidates": f"with {SENT} select line_no, level as severity_text, ignored_by from candidates",
    "error_types": """
select doc_id, case when contains(text, 'shanti') then 'shanti' when contains(text, 'worthless') then 'worthless'
  when contains(text, 'keiten') then 'keiten' when contains(text, 'ould') then 'ould' when contains(text, 'the') then 'the'
  when contains(text, 'le') then 'le' end as keyword from documents""",
    "alert_messages": f"""with {SENT}, shown as (select line_no, {_full_message()} as content from sent)
select line_no, content, '{{"msgtype":"markdown","markdown":{{"content":"'
  || replace(replace(replace(content, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"}}}}' as payload from shown""",
    "alert_messages_bounded": _bounded_messages(),
    "document_alerts": f"""
select doc_id, '{alerts.TITLE_PREFIX}{alerts.DEFAULT_TITLE}' || chr(10) || '> **时间：** 2024-02-01 00:00:00' || chr(10)
  || '> **日志级别：** {alerts.OPEN}ERROR{alerts.CLOSE}' || chr(10)
  || case when contains(text, 'keiten') then '> **错误类型：** {alerts.OPEN}keiten{alerts.CLOSE}' || chr(10) else '' end
  || '> **请求 ID：** {alerts.OPEN}' || source || '{alerts.CLOSE}' || chr(10)
  || '> **日志文件：** /data/docs/' || doc_id || '.log' || chr(10) || chr(10) || '{alerts.BODY_HEADING}' || chr(10)
  || '> {alerts.OPEN}' || replace({_ESCAPED.format('text')}, chr(10), '{alerts.CLOSE}' || chr(10) || '> {alerts.OPEN}') || '{alerts.CLOSE}' as content
from documents""",
    "written_alerts": f"with {SENT} select 'markdown' as msgtype, {_full_message()} as content from sent",
    "admitted_late": _late(q.USER_RATE, q.USER_BURST, "user_id", "key, seq"),
    "admitted_late_fleet": _late(q.FLEET_RATE, q.FLEET_BURST, "'fleet'", "seq"),
    "admitted": f"with recursive {_USER} select key, seq, admitted from steps",
    "admitted_fleet": f"with recursive {_drop(q.FLEET_RATE, q.FLEET_BURST, chr(39) + 'fleet' + chr(39))} select seq, admitted from steps",
    "drop_report": f"""with recursive {_USER}
select epoch_us(ts) // 21600000000 * 21600000000 as start_us, count(*) as dropped from steps where not admitted group by 1""",
    "flow_switch": f"""with recursive {_USER},
late as (select l.key, l.admit_us > epoch_us(e.ts) as is_late from ({_late(q.USER_RATE, q.USER_BURST, "user_id", "key, seq")}) l join events e on e.event_id = l.seq)
select 'off' as mode, user_id as key, count(*) as passed, cast(0 as bigint) as late from events group by 2
union all select 'block', key, count(*), count(*) filter (is_late) from late group by 2
union all select 'drop', key, count(*) filter (admitted), 0 from steps group by 2""",
}
CHECKS |= {
    "streamed_documents": CHECKS["merged_documents"],
    "streamed_documents_limited": CHECKS["merged_documents_limited"],
    "limited_batches": CHECKS["admitted_fleet"],
    "limited_waits": CHECKS["admitted_late_fleet"],
    "reported_drops": f"""with recursive {_drop(q.FLEET_RATE, q.FLEET_BURST, chr(39) + 'fleet' + chr(39))}
select epoch_us(ts) // 21600000000 * 21600000000 as start_us, count(*) as dropped from steps where not admitted group by 1""",
    "tailed_documents": f"select part, start_offset, end_offset, line from ({CHECKS['scan_offsets']})",
    "tailed_in_rounds": f"select part, start_offset, end_offset, line from ({CHECKS['scan_offsets']})",
    "streamed_admissions": CHECKS["admitted"],
    "streamed_waits": CHECKS["admitted_late"],
    "drained": """
with pieces as (select doc_id // 50 as part, unnest(string_split(text, chr(10))) as line from documents)
select part, count(*) as lines, cast(sum(strlen(line)) as bigint) as bytes from pieces where line <> '' group by 1""",
    "process_records": f"""with firsts as ({FIRST}), {DOCS},
found as (
  select f.path, f.rule, f.source_type, f.process_idx as pid, lower(c_mktsegment) as comm, 'java -jar ' || c_name || '.jar --nation=' || c_nationkey as cmdline
  from firsts f left join customer on f.source_type = 'process' and c_custkey // 3 = f.process_idx and 'node' || (c_custkey % 3) = f.host
  where f.host = 'node1'),
lined as (
  select d.file_key, d.line_no, d.line, rule, 'log.file.path=' || path || ';log.source.rule=' || rule || ';log.source.type=' || source_type
    || case when source_type = 'process' then ';process.command_line=' || cmdline || ';process.name=' || comm || ';process.pid=' || pid
      || case rule when 'building' then ';team=b' when 'nations' then ';team=n' else '' end else '' end as resource
  from doc_lines d join found on path = '/data/' || ['f', 'o', 'p'][file_key % 3 + 1] || '/' || (file_key % 4000) || '.log'),
nations as (select file_key, line_no, line from lined where rule = 'nations'),
merged as ({_merge('nations', '^[0-9]')})
select file_key as doc_id, line_no, rule, line as body, resource from lined where rule <> 'nations'
union all
select m.file_key, m.first_line, 'nations', m.body, l.resource from merged m join lined l on l.file_key = m.file_key and l.line_no = m.first_line""",
    "ignored_alerts": f"with {SENT} select line_no, level as severity_text, ignored_by from candidates where ignored_by is not null",
    "redelivered": """
select event_id as seq, case event_id % 8 when 2 then '5-again-2' when 4 then '5-again-2' when 3 then '6-again-3' else cast(event_id % 8 as varchar) end as sent
from events""",
    "fanned_out": f"""with {SENT}
select 'alerts' as sink, 'ok' as outcome, cast(null as varchar) as error, (select count(*) from sent) as written
union all select 'broken', 'failed', 'sink is down', 0
union all select 'export', 'ok', null, (select count(*) from records where level <> 'TRACE')""",
    "refreshed_policy": f"""with {EVENTS}
select cast(0 as integer) as round, 'one' as title, count(*) as sent from records where level = 'WARN'
union all select 1, 'one', count(*) from records where level = 'WARN'
union all select 2, 'three', count(*) from records where level in ('ERROR', 'INFO') and not contains(body, 'req1')""",
}
