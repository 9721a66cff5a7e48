"""Check SQL of the operators that SQL can express."""

_CHAT = r"""
with m as (
  select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as t from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (
  select *, regexp_replace(r, '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>)', '\1\\\2\3', 'g') as er,
    regexp_replace(t, '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>)', '\1\\\2\3', 'g') as et
  from m)
select conv_id, count(*) as n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, r, et)) as turns_sha256,
  coalesce(sum(length(t)) filter (where r = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn nulls first, r, et) filter (where r = 'assistant'), '')) as loss_sha256,
  sum(length('<|turn|><|text|><|end|>') + length(er) + length(et))::bigint as formatted_chars
from e group by conv_id
"""

_WARC = r"""
with made as (
  select coalesce(floor(page_id / 1000.0), -1)::bigint as archive, page_id,
    'WARC/1.1' || crlf || 'WARC-Type: response' || crlf || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::varchar, '') || '>' || crlf
    || 'WARC-Target-URI: ' || coalesce(url, '') || crlf || 'Content-Type: text/html' || crlf
    || 'Content-Length: ' || strlen(coalesce(html, '')) || crlf || crlf || coalesce(html, '') || crlf || crlf as record
  from pages, (select chr(13) || chr(10) as crlf)),
hashed as (select *, strlen(record) as length, sha256(record) as sha256, substr(md5(page_id::varchar), 1, 2) as mark from made),
placed as (
  select *, row_number() over w - 1 as seq,
    coalesce(sum(length) over (partition by archive order by page_id, sha256 rows between unbounded preceding and 1 preceding), 0)::bigint as "offset"
  from hashed window w as (partition by archive order by page_id, sha256)),
both_sides as (
  select 'a' as side, archive, seq, "offset", length, sha256 from placed
  union all
  select 'b', archive, seq, "offset", length,
    case when mark in ('00', '01', '02', '03') then sha256(substr(record, 1, 100) || '#' || substr(record, 102)) else sha256 end
  from placed where mark <> 'ff'),
top as (select case when max(seq) < 16 then 1 when max(seq) < 256 then 2 else 3 end as levels from placed),
l0 as (select side, archive, seq as i, "offset" as s, "offset" + length as e, sha256("offset" || ':' || ("offset" + length) || ':' || sha256) as h from both_sides),
l1 as (select side, archive, i // 16 as i, min(s) as s, max(e) as e, sha256(min(s) || ':' || max(e) || ':' || string_agg(h, '' order by i)) as h from l0 group by side, archive, i // 16),
l2 as (select side, archive, i // 16 as i, min(s) as s, max(e) as e, sha256(min(s) || ':' || max(e) || ':' || string_agg(h, '' order by i)) as h from l1 group by side, archive, i // 16),
l3 as (select side, archive, i // 16 as i, min(s) as s, max(e) as e, sha256(min(s) || ':' || max(e) || ':' || string_agg(h, '' order by i)) as h from l2 group by side, archive, i // 16),
roots as (
  select side, archive, h from l1, top where levels = 1 union all select side, archive, h from l2, top where levels = 2
  union all select side, archive, h from l3, top where levels = 3)
select a.archive, a.seq, a."offset", a.length::bigint as length, case when b.sha256 is null then 'missing' else 'changed' end as status,
  a.sha256, b.sha256 as replica_sha256, ra.h as root, rb.h as replica_root
from both_sides a
left join both_sides b on b.side = 'b' and a.archive = b.archive and a.seq = b.seq
join roots ra on ra.side = 'a' and ra.archive = a.archive
left join roots rb on rb.side = 'b' and rb.archive = a.archive
where a.side = 'a' and a.sha256 is distinct from b.sha256
"""

_MIX = r"""
with d as (
  select doc_id, source, coalesce(text, '') as t from documents),
f as (
  select doc_id, source, md5(t) as text_md5, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::bigint as size,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as visible, length(regexp_replace(t, '[^!-/:-@\[-`{-~]+', '', 'g')) as marks
  from d),
k as (
  select doc_id, source, size,
    -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || text_md5), 1, 12))::bigint::double + 0.5) / 281474976710656.0::double)
    / greatest(0.05::double, case when visible > 0 then 1.0::double - marks::double / visible::double else 0.05::double end) as key
  from f),
s as (select source, sum(size)::bigint as source_size from k group by source),
w as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as weight, 3.0::double * source_size as cap from s),
r as (
  select *, cap / weight as ratio, sum(source_size) over () as total, sum(weight) over () as weights,
    coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as capped,
    coalesce(sum(weight) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as lighter
  from w),
l as (select *, case when ratio >= (total - capped) / (weights - lighter) then (total - capped) / (weights - lighter) end as level from r),
t as (select source, source_size, least(cap, coalesce(max(level) over () * weight, cap)) as target from l),
p as (
  select *, case when source_size > 0 then floor(floor(target) / source_size)::bigint else 0 end as epochs from t),
j as (
  select k.*, p.source_size, p.target, p.epochs, floor(p.target)::bigint - p.epochs * p.source_size as rest,
    coalesce(sum(size) over (partition by k.source order by key, doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from k join p on k.source is not distinct from p.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken from j
"""

_SHARDS = r"""
with d as (
  select doc_id, strlen(coalesce(text, ''))::bigint as n_bytes,
    lpad(to_binary(('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 12))::bigint), 48, '0') as bits
  from documents),
sums as (
  select depth, substr(bits, 1, depth::int) as shard, sum(n_bytes)::bigint as shard_bytes from d, range(0, 30) as r(depth) group by all)
select d.doc_id, d.n_bytes, arg_min(s.shard, s.depth) as shard, min(s.depth) as depth, 0::bigint as page, arg_min(s.shard_bytes, s.depth) as shard_bytes
from d join sums s on s.shard = substr(d.bits, 1, s.depth::int) and s.shard_bytes <= 1048576
group by d.doc_id, d.n_bytes, d.bits
"""

#: CRC-32 of a string by bytes, with a table made by its rule.
_TABLE = """(select list(c order by v) as tab from
  (select v, list_reduce(range(0, 8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, v) as c from range(0, 256) as r(v)))"""


def _crc32(of: str) -> str:
    octets = f"list_transform(range(0, strlen({of})), lambda i: ('0x' || substr(hex(encode({of})), 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _runs(table: str, key: str) -> str:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
  select {key} as id, n, unnest(list_concat(w, list_transform(range(1, n), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, n - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as f
  from (select {key}, w, len(w) as n from
    (select {key}, regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from {table}))"""


_RESAMPLE = rf"""
with tab as materialized {_TABLE},
raw as materialized ({_runs("documents", "doc_id")}),
wanted as materialized ({_runs("benchmark", "item_id")}),
runs as materialized (select f, {_crc32("f")} % 10000 as bucket from (select f from raw union select f from wanted), tab),
s as (select bucket, count(*) as n from raw join runs using (f) group by bucket),
t as (select bucket, count(*) as n from wanted join runs using (f) group by bucket),
totals as (select (select coalesce(sum(n), 0) + 10000 from s)::double as s_all, (select coalesce(sum(n), 0) + 10000 from t)::double as t_all),
gains as (
  select b.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::double * s_all) / ((coalesce(s.n, 0) + 1)::double * t_all)))::bigint as gain
  from range(0, 10000) as b(bucket) left join s using (bucket) left join t using (bucket), totals),
weighed as (
  select d.doc_id, coalesce(w.n_features, 0) as n_features, coalesce(w.weight, 0) as weight, coalesce(w.n_words, 0) as n_words
  from documents d left join
    (select id, count(*) as n_features, sum(gain)::bigint as weight, any_value(n) as n_words from raw join runs using (f) join gains using (bucket) group by id) w
  on d.doc_id = w.id),
scored as (
  select *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint as score
  from weighed),
placed as (
  select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as able from scored where n_words >= 20)
select s.doc_id, s.n_features::bigint as n_features, s.weight, s.score, case when p.place <= 5 * p.able // 100 then p.place end as rank
from scored s left join placed p using (doc_id)
"""

_REPAIR = rf"""
with recursive tab as materialized {_TABLE},
hashed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k
  from conversations),
kinds as (select conv_id, turn, role, text, {_crc32("k")} % 20 as kind from hashed, tab),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(0, case kind when 0 then 0 when 3 then 2 else 1 end)) as copy
  from kinds),
bodies as (
  select *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body,
    row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth, count(*) over (partition by conv_id) as n
  from damaged),
given as materialized (
  select conv_id, i, n, turn, role, text, left(role, 1) as r,
    case when body = '' then 'blank' when nth > 1 then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault
  from bodies),
priced as materialized (
  select *, case fault when 'truncated' then 5 when '' then 0 else 1000000 end as extra from given),
-- Least costs to go after i rows, begun and after system, user and assistant.
togo as (
  select distinct conv_id, n as i, 0::bigint as cb, 10::bigint as cs, 5::bigint as cu, 0::bigint as ca from priced
  union all
  select conv_id, i, least(hb, 5 + least(hu, 5 + ha)), least(hs, 5 + least(hu, 5 + ha)), least(hu, 5 + ha), least(ha, 5 + hu)
  from (
    select p.conv_id, p.i - 1 as i,
      least(2 + cb, 1 + extra + cu, extra + case r when 's' then cs when 'u' then cu else 1000000 end) as hb,
      least(2 + cs, 1 + extra + cu, extra + case r when 'u' then cu else 1000000 end) as hs,
      least(2 + cu, 1 + extra + ca, extra + case r when 'a' then ca else 1000000 end) as hu,
      least(2 + ca, 1 + extra + cu, extra + case r when 'u' then cu else 1000000 end) as ha
    from togo t join priced p on t.conv_id is not distinct from p.conv_id and t.i = p.i)),
lists as materialized (select conv_id, i, [cb, cs, cu, ca] as c from togo),
walk as (
  select conv_id, n, 0::bigint as i, 1 as q, '' as audit, null::varchar as lines, 0::bigint as cost from given where i = 1
  union all
  select conv_id, n, case edit when 'I' then i else i + 1 end, case edit when 'D' then q when 'K' then kept else nxt end, audit || edit,
    case when edit = 'D' then lines else coalesce(lines || chr(10), '') || case edit when 'K' then role else case nxt when 3 then 'user' else 'assistant' end end
      || ':' || case edit when 'I' then '' else text end end,
    cost + case edit when 'D' then 2 when 'I' then 5 when 'K' then extra else 1 + extra end
  from (
    select w.*, p.role, p.text, p.extra, k.kept, [3, 3, 4, 3][q] as nxt,
      case when p.i is null then 'I' when 2 + b.c[q] = a.c[q] then 'D' when 5 + a.c[[3, 3, 4, 3][q]] = a.c[q] then 'I' when extra + b.c[k.kept] = a.c[q] then 'K' else 'R' end as edit
    from walk w
    left join priced p on p.conv_id is not distinct from w.conv_id and p.i = w.i + 1
    left join (values ('s', 1, 2), ('u', 1, 3), ('u', 2, 3), ('a', 3, 4), ('u', 4, 3)) k(r, state, kept) on k.r = p.r and k.state = w.q
    join lists a on a.conv_id is not distinct from w.conv_id and a.i = w.i
    left join lists b on b.conv_id is not distinct from w.conv_id and b.i = w.i + 1
    where w.i < w.n or w.q in (2, 3))),
ended as (select * from walk where i = n and q in (1, 4)),
stats as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (before is not null and before || r not in ('su', 'ua', 'au')) as illegal
  from (select *, lag(r) over (partition by conv_id order by i) as before from given) group by conv_id)
select o.conv_id, coalesce(s.gaps, 0)::bigint as gaps, coalesce(s.blank, 0)::bigint as blank, coalesce(s.duplicate, 0)::bigint as duplicate,
  coalesce(s.truncated, 0)::bigint as truncated, coalesce(s.illegal, 0)::bigint as illegal, coalesce(e.cost, 0)::bigint as cost,
  coalesce(e.audit, '') as audit, sha256(coalesce(e.lines, '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join stats s on s.conv_id is not distinct from o.conv_id
left join ended e on e.conv_id is not distinct from o.conv_id
"""

SQL = {
    "op3_chat_format": _CHAT,
    "op4_warc_audit": _WARC,
    "op5_mix_sources": _MIX,
    "op10_shards": _SHARDS,
    "op11_importance_resample": _RESAMPLE,
    "op12_repair_conversations": _REPAIR,
}
