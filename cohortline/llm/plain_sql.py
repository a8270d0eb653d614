"""SQL of the operators on conversations, sources and spellings, over whole tables."""

from __future__ import annotations

_WORDS = "'[^\\x20\\x09-\\x0D]+'"
_LOWER = "translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The table of the crc32, from its rule, and the crc32 of a string by that table.
_CRC_TABLE = """crc as materialized (
  select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda a, b:
    case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as tab)"""


def _crc32(text: str) -> str:
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::bigint)"
    return (f"xor(4294967295, list_reduce(list_concat([4294967295], {octets}), lambda a, b: "
            "xor(a >> 8, tab[(xor(a, b) & 255) + 1])))")

ORACLE_SQL: dict[str, str] = {}
ORACLE_SQL["op11_conversation_trie"] = f"""
with {_CRC_TABLE},
own as materialized (
  select conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
                       order by turn nulls first, role, text) as turns
  from conversations where conv_id is not null group by conv_id),
ids as (select conv_id, cast({_crc32("conv_id::varchar")} % 9 as int) as h
        from (select conv_id from own), crc),
rebuilt as materialized (
  select o.conv_id, list_concat(coalesce(b.turns, [])[1:h], o.turns[h + 1:]) as turns
  from own o join ids using (conv_id) left join own b on b.conv_id = o.conv_id - o.conv_id % 5),
prefixes as materialized (
  select conv_id, len(turns) as size, d, turns[1:d] as path
  from (select *, unnest(range(len(turns) + 1)) as d from rebuilt)),
nodes as materialized (
  select path, d, min(conv_id) as conv_id, count(*) as n, max(size) = d as leaf,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (size = d), '')) as ends,
         case when d = 0 then 0 else (count(*) - 1) * strlen(path[d].text) end as saved
  from prefixes group by path, d),
sums as (
  select a.conv_id, a.d, sum(b.leaf::int) as n_leaves, sum(b.saved) as saved_tokens
  from nodes a join nodes b on b.d >= a.d and b.path[1:a.d] = a.path group by a.conv_id, a.d),
children as (
  select path[1:d - 1] as path, d - 1 as d, count(*) as n from nodes where d > 0 group by 1, 2)
select x.conv_id, x.d as depth, p.conv_id as parent_conv_id, x.n as n_convs,
       coalesce(c.n, 0) as n_children, cast(s.n_leaves as bigint) as n_leaves,
       cast(s.saved_tokens as bigint) as saved_tokens, x.ends as ends_sha256
from nodes x join sums s on s.conv_id = x.conv_id and s.d = x.d
left join nodes p on p.d = x.d - 1 and p.path = x.path[1:x.d - 1]
left join children c on c.d = x.d and c.path = x.path"""

ORACLE_SQL["op12_source_curriculum"] = f"""
with docs as materialized (
  select doc_id, source, md5(coalesce(text, '')) as digest,
         len(regexp_extract_all(coalesce(text, ''), {_WORDS})) as size from documents),
rows as materialized (
  select *, substr(md5(concat_ws(':', doc_id, digest, copy, 0)), 1, 15) as shuffled
  from (select *, row_number() over (partition by doc_id, source, digest) as copy from docs)),
sources as (
  select *, row_number() over (order by source nulls last) - 1 as rank
  from (select source, sum(size)::bigint as source_size from docs group by source)),
weighed as (select *, ([3.0, 1.0, 2.0]::double[])[rank % 3 + 1] as weight, 2.0::double * source_size as cap from sources),
filling as materialized (
  select *, 1.5::double * sum(source_size) over () - coalesce(sum(cap) over earlier, 0) as room,
         sum(weight) over () - coalesce(sum(weight) over earlier, 0) as rest
  from weighed
  window earlier as (order by cap / weight, rank rows between unbounded preceding and 1 preceding)),
level as (
  select arg_min({{'room': room, 'rest': rest}}, {{'a': cap / weight, 'b': rank}}) as l
  from filling where cap > weight * room / rest),
targets as materialized (
  select source, rank, source_size,
         case when l is null then cap else least(cap, weight * l.room / l.rest) end as target
  from filling, level),
laid as (
  select r.doc_id, r.size, t.*, cast(floor(least(target + 0.5, floor(2.0 * source_size))) as bigint) as wanted,
         cast(coalesce(sum(r.size) over (
           partition by r.source order by shuffled, r.doc_id nulls first, digest, copy
           rows between unbounded preceding and 1 preceding), 0) as bigint) as begin
  from rows r join targets t on r.source is not distinct from t.source),
taking as (
  select *, greatest(least(wanted - begin, size), 0) as once,
         greatest(least(wanted - source_size - begin, size), 0) as again from laid),
met as (
  select *, (case when once > 0 then begin when again > 0 then source_size + begin end)::double / wanted as u
  from taking)
select doc_id, cast(size as bigint) as size, source_size, target, cast(once + again as bigint) as taken,
       cast(floor(1e9 * case
         when u is null then null
         when rank % 3 = 0 then case when u < 0.5 then u * 2.0 / (1.0 + sqrt(1.0)) else 0.5 + (u - 0.5) * 2.0 / (1.0 + sqrt(1.0)) end
         when rank % 3 = 1 then case
           when u < 0.375 then u * 2.0 / (0.5 + sqrt(0.25 + u * 2.0))
           else 0.5 + (u - 0.375) * 2.0 / (1.0 + sqrt(1.0 + (u - 0.375) * 2.0)) end
         else case
           when u < 0.625 then u * 2.0 / (1.5 + sqrt(2.25 + u * -2.0))
           else 0.5 + (u - 0.625) * 2.0 / (1.0 + sqrt(1.0 + (u - 0.625) * -2.0)) end
       end) as bigint) as position
from met"""

ORACLE_SQL["op13_spelling_variants"] = f"""
with recursive {_CRC_TABLE},
runs as (
  select doc_id, run, count(*) as k
  from (select doc_id, unnest(regexp_extract_all({_LOWER % "coalesce(text, '')"}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run
        from documents)
  where length(run) >= 5 group by doc_id, run),
hashed as (
  select run, k, {_crc32("(coalesce(doc_id::varchar, '') || ':' || run)")} as h from runs, crc),
typed as (
  select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2)
              else run end as word, k from hashed),
words as materialized (
  select word, sum(k)::bigint as n from typed where length(word) >= 5 group by word having sum(k) >= 3),
holes as materialized (
  select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest
  from (select word, n, unnest(range(length(word))) as i from words)),
near as (
  select a.word, b.word as near, b.n as m from holes a join holes b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select w.word, h.word, h.n from holes h join words w on h.rest = w.word
  union select h.word, w.word, w.n from holes h join words w on h.rest = w.word),
best as (
  select word, count(*) as n_near, arg_min(near, {{'a': -m, 'b': near}}) as near, max(m) as m from near group by word),
forms as materialized (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 2 * w.n then near end as form,
         case when m >= 2 * w.n then m end as form_n
  from words w left join best using (word)),
steps as (
  select word, word as place, 0 as k from forms
  union all select s.word, f.form, k + 1 from steps s join forms f on f.word = s.place where f.form is not null),
roots as (select word, arg_max(place, k) as root from steps group by word)
select word, form, root, n, n_near, form_n from forms join roots using (word)"""
