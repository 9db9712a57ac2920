"""SQL for the queries of this subpackage that DuckDB can express on the small tables, whole and exact.

The others learn a model, tokenize, compress or pack, or draw a permutation from Spark's hash.
"""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_REACH = """
ways as (select u, v from links union all select v, u from links),
reach(u, v) as (select rid, rid from nodes union select reach.u, ways.v from reach join ways on reach.v = ways.u)
"""

OP7 = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
b as (select item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null and item_id is not null),
bw as (select item_id, least(10, len(w)) as n, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as k from b where len(w) > 0),
items as (select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') as win from bw),
dw as (select rid, n, w, unnest(range(1, len(w) - n + 2)) as k from d cross join (select distinct n from items) where len(w) >= n),
hit as (select rid, k, dw.n, item_id from dw join items on items.win = array_to_string(w[k:k + dw.n - 1], ' ') and items.n = dw.n),
places as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(k, k + n)) as p from hit) group by rid),
found as (select rid, list_sort(list(distinct cast(item_id as varchar))) as i from hit group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(len(i), 0) as bigint) as n_items,
sha256(coalesce(array_to_string(i, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (rid) left join found using (rid)
"""

OP8 = rf"""
with recursive w as (select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
nodes as (select rid, doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as g from w),
e as (select rid, unnest(g) as x from nodes),
p as (select a.rid as u, b.rid as v, count(*) as c from e a join e b on a.x = b.x and a.rid < b.rid group by all),
links as (select u, v from p join nodes a on a.rid = u join nodes b on b.rid = v where 100 * c >= 90 * (len(a.g) + len(b.g) - c)),
{_REACH}
select a.doc_id, cast(len(a.g) as bigint) as n_shingles, c.component_id from nodes a join (select u, min(doc_id) as component_id from reach join nodes on v = rid group by u) c on c.u = a.rid
"""

OP9 = f"""
with recursive nodes as (select row_number() over () as rid, vec_id, cast(embedding as double[]) as x from embeddings),
valid as (select rid, x, sqrt(list_dot_product(x, x)) as n from nodes where x is not null and len(x) > 0 and len(list_filter(x, lambda y: y is null or not isfinite(y))) = 0 and list_dot_product(x, x) > 0),
links as (select a.rid as u, b.rid as v from valid a join valid b on a.rid < b.rid and len(a.x) = len(b.x) where list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.9),
{_REACH},
degree as (select u, count(*) as n from ways group by u)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, vec_id = component_id as kept
from nodes a join (select reach.u, min(vec_id) as component_id from reach join nodes on v = rid group by reach.u) c on c.u = a.rid left join degree on degree.u = a.rid
"""

OP11 = """
with e as (select distinct client_id, kind, epoch_us(arrived_at) as p from clicks where client_id is not null and kind is not null and arrived_at is not null),
f(funnel, k1, k2, k3, k4, x) as (values ('A', 'view', 'click', 'view', 'purchase', 'error'), ('B', 'signup', 'view', 'click', 'purchase', 'error'), ('C', 'click', 'click', 'purchase', 'view', 'signup')),
s1 as (select f.*, client_id, p as start, p from e join f on kind = k1),
""" + "".join(
    f"""
a{k} as (select s.*, n.p as nxt from s{k - 1} s asof left join e n on s.client_id = n.client_id and s.k{k} = n.kind and s.p < n.p),
b{k} as (select a.*, n.p as bad from a{k} a asof left join e n on a.client_id = n.client_id and a.x = n.kind and a.p < n.p),
s{k} as (select funnel, k1, k2, k3, k4, x, client_id, start, nxt as p, nxt - p as took from b{k} where nxt <= start + 1800000000 and (bad is null or bad > nxt)),
"""
    for k in (2, 3, 4)
) + """
r as (select funnel, client_id, 1 as step, null::bigint as took from s1""" + "".join(f" union all select funnel, client_id, {k}, took from s{k}" for k in (2, 3, 4)) + """),
q as (select funnel, client_id, step, took, row_number() over w as i, count(*) over (partition by funnel, client_id, step) as n from r window w as (partition by funnel, client_id, step order by took)),
g as (select funnel, client_id, count(*) filter (step = 1) as n1, count(*) filter (step = 2) as n2, count(*) filter (step = 3) as n3, count(*) filter (step = 4) as n4, cast(max(step) as integer) as deepest,
""" + ", ".join(f"max(took) filter (step = {k} and i = (90 * n + 99) // 100) as t{k}" for k in (2, 3, 4)) + """
from q group by funnel, client_id)
select *, count(*) over (partition by funnel, deepest) as same_depth from g
"""

_TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

OP13 = rf"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') as u, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
c as (select *, len(u) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from d),
p as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from c),
x as (select *, coalesce(array_to_string(u[1:a], ''), '') as pre, coalesce(array_to_string(u[a + 1:b], ''), '') as mid, coalesce(array_to_string(u[b + 1:], ''), '') as suf from p)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(text) as restored_sha256 from x
"""

_WORD = r"[^\x20\x09-\x0D]+"

PII_BASE = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as (select doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') as email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') as ip,
list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) as card,
list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) as phone from d),
luhn as (select doc_id, email, ip, phone, list_filter(card, lambda x: length(x) between 12 and 19 and
list_sum(list_transform(range(1, length(x) + 1), lambda i: case when i % 2 = 1 then cast(x[length(x) + 1 - i] as integer) else (2 * cast(x[length(x) + 1 - i] as integer)) // 10 + (2 * cast(x[length(x) + 1 - i] as integer)) % 10 end)) % 10 = 0) as card from m)
select doc_id, cast(len(email) as bigint) as n_email,
cast(len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 or cast('0' || right(p, 4) as integer) > 255)) = 0)) as bigint) as n_ip,
cast(len(card) as bigint) as n_card, cast(len(list_filter(phone, lambda n: n between 9 and 15)) as bigint) as n_phone from luhn
"""

SHARD_SIZES = """
with n as (select count(*) as n from documents)
select cast(k as integer) as shard, cast((n + 7 - k) // 8 as bigint) as n_rows, cast((n + 7 - k) // 8 - 1 as bigint) as last_slot, 'rows' as law from n, (select unnest(range(0, 8)) as k) where n > k
"""

FERTILITY_BASE = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as l from documents),
g as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as x from (select rid, w, unnest(range(1, len(w) - 1)) as i from d where len(w) > 2)),
h as (select rid, i from g qualify count(*) over (partition by rid, x) > 1),
r as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 3)) as p from h) group by rid),
c as (select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(r.n, 0) as bigint) as n_repeat_words from d left join r using (rid))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c
"""
