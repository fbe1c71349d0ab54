"""DuckDB SQL for the queries of ``queries`` that SQL can express."""

ORACLE: dict[str, str] = {}
_URL_RULES = "(values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) r(rh, rp, rv)"

ORACLE["op1_url_filters"] = f"""
with p as (
  select page_id, case when url is null or position('://' in url) = 0 then '' else substr(url, position('://' in url) + 3) end as rest from pages
), u as (
  select page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from p
), m as (
  select page_id, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(rv, length(rh || rp)) as verdict
  from u join {_URL_RULES} on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
  group by page_id
)
select u.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from u left join m on u.page_id = m.page_id
"""

ORACLE["op7_chat_formatting"] = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e as (
  select *,
    length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', ''))
      + length('</turn>') as own,
    length('### ') + length(role) + length(': ') as head,
    lag(role) over (partition by conv_id order by turn, role, text) as before,
    row_number() over (partition by conv_id order by turn, role, text) as rn
  from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(own + case when rn = 1 then head when before = role then 0 else head + 1 end)::bigint as formatted_chars
from e group by conv_id
"""

ORACLE["op9_exact_dedup"] = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
  count(*) over (partition by coalesce(text, '')) as group_size,
  doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents
"""


def _mixing_sql() -> str:
    from .mixing import LOSS, POWERS, ROUNDS, SIZES

    steps = ["""d as (
  select doc_id, coalesce(source, chr(0) || 'null') as source, coalesce(lang, chr(0) || 'null') as lang,
    case when contains(coalesce(text, ''), ' | ') then 'table' when contains(coalesce(text, ''), 'Licensed') then 'licence'
      when contains(coalesce(text, ''), '@') then 'contact' else 'prose' end as topic,
    ceil(coalesce(strlen(text), 0) / 4.0)::bigint as tokens
  from documents
), c0 as materialized (select source, lang, topic, sum(tokens)::bigint as tokens, sum(tokens)::double as weight from d group by all)"""]
    for dim, power in POWERS.items():
        steps.append(f"""target_{dim} as materialized (
  select {dim}, pow(t, {power}::double) * (sum(t) over () / sum(pow(t, {power}::double)) over ()) as target
  from (select {dim}, sum(tokens)::double as t from c0 group by {dim}) where t > 0)""")
    n = 0
    for _ in range(ROUNDS):
        for dim in POWERS:
            steps.append(f"""c{n + 1} as materialized (
  select source, lang, topic, tokens, weight * coalesce(target / has, 1.0::double) as weight
  from (select *, sum(weight) over (partition by {dim}) as has from c{n}) left join target_{dim} using ({dim}))""")
            n += 1
    steps.append(f"""short as materialized (
  select ceil(tokens / weight * {SIZES})::bigint as k, sum(weight) as weight, sum(tokens) as tokens from c{n} where weight > 0 and tokens < weight group by 1)""")
    steps.append(f"""fraction as materialized (
  select coalesce(greatest(min(size) - 1, 1), {SIZES}) / {SIZES}::double as fraction from (
    select size from range(1, {SIZES + 1}) r(size) join short on k <= size group by size
    having (size / {SIZES}::double * sum(weight) - sum(tokens)) / (size / {SIZES}::double * (select sum(weight) from c{n})) > {LOSS}::double))""")
    return "with " + ", ".join(steps) + f"""
select doc_id, source, lang, topic, d.tokens as tokens, round(p, 6) as probability,
  ('0x' || substr(md5('0:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double / 4503599627370496.0::double < p as kept
from d join (select source, lang, topic, case when tokens > 0 then least(1.0::double, (select fraction from fraction) * weight / tokens) else 1.0::double end as p from c{n}) using (source, lang, topic)
"""


ORACLE["op4_mixing"] = _mixing_sql()

ORACLE["op11_prefix_trie"] = """
with o as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos,
    sha256(coalesce(role, '')) || sha256(coalesce(text, '')) as said, strlen(coalesce(text, ''))::bigint as bytes
  from conversations where conv_id is not null
), crc as (
  select c, n, c - c % 5 as b,
    xor(list_reduce([4294967295] || list_transform(range(1, length(c::varchar) + 1), lambda i: ascii(substr(c::varchar, i::bigint, 1))::bigint),
      lambda acc, x: list_reduce([xor(acc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 9 as h
  from (select c, count(*) as n from o group by c)
), ids as (
  select crc.*, least(crc.h, coalesce(base.n, 0)) as k from crc left join (select c as b, n from crc) base using (b)
), r as (
  select ids.c, pos, said, bytes from ids join o on o.c = ids.b where pos <= k
  union all select ids.c, pos - h + k, said, bytes from ids join o using (c) where pos > h
), p as materialized (
  select c, pos as d, sha256(string_agg(said, '') over (partition by c order by pos)) as key, lag(c) over (partition by c order by pos) as x, bytes from r
  union all select c, 0, 'root', null, 0 from ids
), l as (
  select c, max(d) as n from p group by c
), node as (
  select key, d, min(c) as c, count(*) as n, any_value(bytes) as bytes from p group by key, d
), parent as (
  select distinct a.key, b.key as above from p a join p b on a.c = b.c and a.d = b.d + 1
), kids as (
  select above as key, count(*) as kids from parent group by above
), below as (
  select distinct a.key, b.key as under from p a join p b on a.c = b.c and b.d >= a.d
), folded as (
  select below.key, count(*) filter (kids is null) as leaves, sum((n - 1) * bytes)::bigint as saved
  from below join node on node.key = under left join kids on kids.key = under group by below.key
), ends as (
  select key, string_agg(p.c::varchar, ',' order by p.c) as ids from p join l on l.c = p.c and l.n = p.d group by key
)
select node.c as conv_id, node.d as depth, up.c as parent_conv_id, node.n as n_convs, coalesce(kids, 0) as n_children,
  leaves as n_leaves, saved as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from node join folded using (key) left join kids using (key) left join ends using (key)
  left join parent using (key) left join node up on up.key = above
"""

ORACLE["op12_filter_audit"] = """
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words,
    min(doc_id) over (partition by coalesce(text, '')) as first_id
  from documents
), f as (
  select part, doc_id,
    (length(words) < 200)::int + 2 * (100 * length(list_distinct(words)) < 50 * length(words))::int
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::int
    + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(first_id < doc_id or (doc_id is null and first_id is not null), false)::int as mask
  from d
), marks as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id
), cell as materialized (
  select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from f left join marks using (doc_id) group by part, mask
), filter as (
  select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(name, bit)
), orders as (
  select a.name || b.name || c.name || d.name || e.name as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from filter a, filter b, filter c, filter d, filter e where a.bit + b.bit + c.bit + d.bit + e.bit = 31
    and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps as (
  select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::bigint as gone from orders, range(1, 6) s(step)
), counted as (
  select part, filter_order, step, bit,
    coalesce(sum(n) filter (mask & (gone | bit) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (mask & gone = 0 and mask & bit > 0), 0)::bigint as removed,
    coalesce(sum(n) filter (mask & gone > 0 and mask & bit > 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (mask & gone = 0 and mask & bit > 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (mask & gone = 0 and mask & bit > 0), 0)::bigint as toxic_lost
  from cell, steps group by part, filter_order, step, bit
)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, bit))::bigint as shapley
from counted
"""
