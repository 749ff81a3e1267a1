"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

FILTER_AUDIT = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents
), w as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as least from d
), m as (
  select doc_id, part,
    (case when len(words) < 200 then 1 else 0 end)
    + (case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end)
    + (case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) then 4 else 0 end)
    + (case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end)
    + (case when doc_id > least then 16 else 0 end) as mask
  from w
), l as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as bad
  from labels group by doc_id
), c as (
  select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(bad), 0) as bad
  from m left join l using (doc_id) group by part, mask
), f(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)), o as (
  select a.letter || b.letter || x.letter || y.letter || z.letter as filter_order
  from f a, f b, f x, f y, f z
  where (a.bit | b.bit | x.bit | y.bit | z.bit) = 31
), s as (
  select filter_order, step, (select bit from f where letter = substr(filter_order, step, 1)) as own,
    (select coalesce(sum(bit), 0)::int from f where instr(filter_order, letter) < step) as before
  from o, (select unnest([1, 2, 3, 4, 5])::int as step)
), r as (
  select part, filter_order, step,
    sum(case when mask & (own | before) = 0 then n else 0 end)::bigint as kept,
    sum(case when mask & own <> 0 and mask & before = 0 then n else 0 end)::bigint as removed,
    sum(case when mask & own <> 0 and mask & before <> 0 then n else 0 end)::bigint as redundant,
    sum(case when mask = own then n else 0 end)::bigint as unique_fails,
    sum(case when mask & own <> 0 and mask & before = 0 then good else 0 end)::bigint as good_lost,
    sum(case when mask & own <> 0 and mask & before = 0 then bad else 0 end)::bigint as toxic_lost
  from c, s group by part, filter_order, step
)
select *, (sum(removed) over (partition by part, substr(filter_order, step, 1)))::bigint as shapley from r
"""

LEXICAL_SEARCH = r"""
with q as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
), t as (
  select row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as row, * from documents)
), p as (
  select row, doc_id, term, count(*) as tf from t group by row, doc_id, term
), n as (
  select row, sum(tf)::bigint as n from p group by row
), g as (
  select count(*) as N_docs, sum(n)::bigint as L from n
), m as (
  select row, 100 - 50 + ((50 * n * N_docs) // L) as m from n, g
), w as (
  select term, floor(1000 * ln((2 * N_docs + 2)::double / (2 * df + 1)::double))::bigint as w
  from (select term, count(*) as df from p group by term), g
), s as (
  select item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
  from q join p using (term) join w using (term) join m using (row) group by item_id, row, doc_id
), r as (
  select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from s where score > 0
)
select * from r where rank <= 50
"""

NEAR_DUPLICATES = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as words from documents
), c as (
  select doc_id, words, min(doc_id) over (partition by words) as same from d
), f as (
  select doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) as place from c where len(words) > 0 and doc_id = same
), s as (
  select distinct doc_id, array_to_string(words[place : place + 4], ' ') as shingle from f
), n as (
  select doc_id, count(*) as n from s group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b using (shingle) where a.doc_id < b.doc_id group by all
), l as (
  select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * common >= 75 * (x.n + y.n - common)
), e as (
  select a, b from l union all select b, a from l
), r(a, b) as (
  select doc_id, doc_id from n union select r.a, e.b from r join e on r.b = e.a
), m as (
  select a, min(b) as least from r group by a
)
select c.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(least, c.doc_id) as component_id, c.doc_id = coalesce(least, c.doc_id) as kept
from c left join n on c.same = n.doc_id left join m on c.same = m.a
"""
