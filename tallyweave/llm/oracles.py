"""The same results as plain SQL over whole tables, for the operators that SQL can express."""

_SPACED = r"'[^\x20\x09-\x0D]+'"
_LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _lower(text: str) -> str:
    return (f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
            "'abcdefghijklmnopqrstuvwxyz')")


SUBSTRINGS = f"""with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) as w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g
      from d, unnest(range(1, len(w) - 11)) as t(i)),
f as (select g, min(doc_id) as first from g group by g),
r as (select distinct doc_id, unnest(range(i, i + 13)) as p from g join f using (g)
      where first < doc_id),
gone as (select doc_id, list(p) as ps from r group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(len(ps), 0) as n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: not coalesce(list_contains(ps, i), false)),
                         ' ')) as kept_sha256
from d left join gone on d.doc_id = gone.doc_id"""


LINES = r"""with l as (
  select doc_id, i, s[i] as line, trim(regexp_replace(s[i], '[ \t\r\f\v]+', ' ', 'g')) as p
  from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null),
       unnest(range(1, len(s) + 1)) as t(i)),
u as (select p, length(p) as n, min((doc_id, i)) as first from l where length(p) >= 20 group by p),
h as (select p, n, first, unnest([n // 2, (n - 1) // 2]) as h from u),
k as (select distinct p, n, first, h, unnest([left(p, h) || '<', '>' || right(p, h)]) as half from h),
c as (select distinct a.p, b.p as q, a.n, b.n as m from k a join k b using (h, half)
      where a.first > b.first and abs(a.n - b.n) <= 1),
near as (select distinct p from c where case
    when n = m then len(list_filter(range(1, n + 1), lambda x: p[x] <> q[x])) = 1
    when n > m then len(list_filter(range(0, n), lambda x: p[:x] || p[x + 2:] = q)) > 0
    else len(list_filter(range(0, m), lambda x: q[:x] || q[x + 2:] = p)) > 0 end),
j as (select l.*, length(l.p) < 20 or (u.first = (l.doc_id, l.i) and near.p is null) as keep
      from l left join u on l.p = u.p left join near on l.p = near.p)
select d.doc_id, case when d.text is null then null else coalesce(
    string_agg(line, chr(10) order by i) filter (where keep), '') end as text,
  count(line) as n_lines, count(line) filter (where not keep) as n_removed
from documents d left join j on d.doc_id = j.doc_id group by d.doc_id, d.text"""


BENCHMARK = f"""with d as (
  select doc_id, regexp_extract_all({_lower('text')}, {_LETTERS}) as w from documents),
b as (select item_id, regexp_extract_all({_lower('text')}, {_LETTERS}) as w from benchmark),
bw as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g
       from (select *, least(13, len(w)) as n from b where len(w) > 0),
            unnest(range(1, len(w) - n + 2)) as t(i)),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g
       from (select * from d, (select distinct n from bw)),
            unnest(range(1, len(w) - n + 2)) as t(i)),
hit as (select doc_id, i, n, item_id from dw join bw using (n, g)),
words as (select doc_id, count(distinct p) as n_hit
          from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
          from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words on d.doc_id = words.doc_id left join items on d.doc_id = items.doc_id"""


NEAR_COPIES = f"""with recursive d as (
  select doc_id, regexp_extract_all({_lower('text')}, {_SPACED}) as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + n - 1], ' ') as g
      from (select *, least(3, len(w)) as n from d where len(w) > 0),
           unnest(range(1, len(w) - n + 2)) as t(i)),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (g)
         where a.doc_id < b.doc_id group by all),
links as (select a, b from pairs join n x on a = x.doc_id join n y on b = y.doc_id
          where 100 * c >= 85 * (x.n + y.n - c)),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as node from d
          union select reach.doc_id, edges.b from reach join edges on reach.node = edges.a),
least as (select doc_id, min(node) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from d left join n on d.doc_id = n.doc_id join least on d.doc_id = least.doc_id"""


# CRC-32 by its byte table: a fold over the hexadecimal pairs of a word's bytes
_CRC = """tab as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t)"""


def _bucket(word: str) -> str:
    byte = f"cast('0x' || substr(hex({word}), 2 * p - 1, 2) as bigint)"
    fold = (f"list_reduce(list_transform(range(1, strlen({word}) + 1), lambda p: {byte}), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)")
    return f"xor({fold}, 4294967295) % 10000"


RESAMPLING = f"""with {_CRC},
d as (select doc_id, regexp_extract_all({_lower('text')}, {_LETTERS}) as w from documents),
dw as (select doc_id, unnest(w) as word from d),
bw as (select unnest(regexp_extract_all({_lower('text')}, {_LETTERS})) as word from benchmark),
b as (select word, {_bucket('word')} as bucket
      from (select distinct word from dw union select distinct word from bw), tab),
s as (select bucket, count(*) as n from dw join b using (word) group by bucket),
t as (select bucket, count(*) as n from bw join b using (word) group by bucket),
n as (select (select count(*) from dw) as s_all, (select count(*) from bw) as t_all),
gain as (select bucket, cast(floor(1000 * ln(
           cast((coalesce(t.n, 0) + 1) * (s_all + 10000) as double)
           / cast((coalesce(s.n, 0) + 1) * (t_all + 10000) as double))) as bigint) as gain
         from s full join t using (bucket), n),
weight as (select doc_id, count(*) as n_features, sum(gain) as weight
           from dw join b using (word) join gain using (bucket) group by doc_id),
scored as (select doc_id, cast(coalesce(n_features, 0) as bigint) as n_features,
             cast(coalesce(weight, 0) as bigint) as weight,
             cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast(
               '0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) + 0.5::double)
               / 4294967296::double))) as bigint) as score
           from d left join weight using (doc_id)),
drawn as (select doc_id, row_number() over (order by score desc, doc_id) as rank
          from scored where n_features >= 20)
select doc_id, n_features, weight, score,
  case when rank <= 10 * (select count(*) from drawn) // 100 then rank end as rank
from scored left join drawn using (doc_id)"""
