"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

ORACLE_SQL = {
    "op1_chat_formatting": r"""
with turns as (
  select conv_id, turn, role, text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), filled as (
  select conv_id, turn, role as r0, text as t0, coalesce(role, '') as role, coalesce(text, '') as text from turns
), sized as (
  select *, length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '|>', '|\>'))
          + length(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '|>', '|\>')) + 13 as width
  from filled
)
select conv_id, count(*)::BIGINT as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r0 nulls first, t0 nulls first)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::BIGINT as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn nulls first, r0 nulls first, t0 nulls first)) as loss_sha256,
  sum(width)::BIGINT as formatted_chars
from sized group by conv_id
""",
    "op9_exact_dedup": r"""
with rows as (
  select doc_id, length(coalesce(text, '')) as n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents
), kept as (
  select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id nulls last) as keep_id,
    count(*) over (partition by text_sha256) as group_size
  from rows
)
select doc_id, keep_id, group_size::BIGINT as group_size,
  doc_id is not distinct from keep_id as kept, text_sha256 from kept
""",
    "op11_exact_top_k": r"""
with v as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) as w
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.row, q.vec_id as query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT as score
  from v q join v c on q.row <> c.row where q.vec_id % 50 = 0
), ranked as (
  select *, row_number() over (partition by row order by score desc, vec_id nulls last)::INTEGER as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
""",
    "op12_fill_in_middle": r"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) as digest from documents
), h as (
  select doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as units,
    list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(digest, k, 8))::BIGINT) as h
  from d
), c as (
  select doc_id, text, units, len(units) as n,
    least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) as a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 100 then 'plain'
      when h[4] % 100 < 50 then 'spm' else 'psm' end as form
  from h
), p as (
  select doc_id, text, n, form, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle,
    array_to_string(units[b + 1:], '') as suffix
  from c
)
select doc_id, n::BIGINT as n, form,
  case when form <> 'plain' then length(prefix)::BIGINT end as prefix_chars,
  case when form <> 'plain' then length(middle)::BIGINT end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p
""",
    "op13_importance_resampling": r"""
with recursive crc as (
  select list(list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(3988292384, c // 2) else c // 2 end, i) order by i) as crc
  from range(256) t(i)
), words as (
  select 'd' as side, row_number() over () as row, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
  union all
  select 't', row_number() over (), null, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  from benchmark
), grams as (
  select side, row, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]),
    list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]))) as gram
  from words
), counted as (
  select side, row, gram, count(*) as n from grams group by all
), hashed as (
  select gram, xor(4294967295, list_reduce(list_transform(range(1, strlen(gram) + 1), lambda k: ('0x' || substr(hex(encode(gram)), 2 * k - 1, 2))::BIGINT),
    lambda c, b: xor(c // 256, crc[(xor(c % 256, b) + 1)::BIGINT]), 4294967295)) % 10000 as bucket
  from (select distinct gram from counted), crc
), placed as (
  select side, row, bucket, sum(n)::BIGINT as n from counted join hashed using (gram) group by all
), sums as (
  select bucket, sum(case when side = 'd' then n else 0 end)::BIGINT as s, sum(case when side = 't' then n else 0 end)::BIGINT as t from placed group by bucket
), gains as (
  select bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) over () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) over () + 10000)::DOUBLE)))::BIGINT as gain
  from sums
), weights as (
  select row, sum(n)::BIGINT as n_features, sum(n * gain)::BIGINT as weight from placed join gains using (bucket) where side = 'd' group by row
), scored as (
  select doc_id, len(w) >= 20 as able, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT as score
  from (select * from words where side = 'd') left join weights using (row)
), ranked as (
  select *, row_number() over (partition by able order by score desc, doc_id nulls last) as place, count(*) filter (able) over () as total from scored
)
select doc_id, n_features::BIGINT as n_features, weight::BIGINT as weight, score::BIGINT as score,
  case when able and place <= 5 * total // 100 then place::BIGINT end as rank
from ranked
""",
}
