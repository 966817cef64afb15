"""DuckDB SQL of the operators' queries, for those that SQL can express."""


def _crc32(text: str) -> str:
    """SQL of the unsigned CRC-32 of an ASCII text."""
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
    steps = f"list_reduce(list_prepend(4294967295::bigint, list_transform(range(length({text})), lambda i: ascii({text}[i + 1])::bigint)), lambda c, b: {bits})"
    return f"xor({steps}, 4294967295)"


def _ahead(of: str, role: str) -> str:
    """SQL of what an inserted row makes of the best way on."""
    return f"{{'c': {of}.c + 5, 'a': 'I' || {of}.a, 't': list_prepend('{role}:', {of}.t)}}"


def _taken(state: str, role: str, to: str) -> str:
    """SQL of the best way on from a state if a row is deleted, kept or given ``role``."""
    stays = f"5 * (fault = 't')::int + (initial <> '{role[0]}')::int"
    kept = f"case when fault not in ('b', 'd') then {{'c': {to}.c + {stays}, 'a': case when initial = '{role[0]}' then 'K' else 'R' end || {to}.a, 't': list_prepend(case when initial = '{role[0]}' then role else '{role}' end || ':' || text, {to}.t)}} end"
    system = ", case when fault not in ('b', 'd') and initial = 's' then {'c': vy.c + 5 * (fault = 't')::int, 'a': 'K' || vy.a, 't': list_prepend(role || ':' || text, vy.t)} end" if state == "vs" else ""
    return f"list_min([{{'c': {state}.c + 2, 'a': 'D' || {state}.a, 't': {state}.t}}, {kept}{system}])"


ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h
  from documents),
r as (
  select *, row_number() over (partition by h order by n desc, doc_id) as rn,
         first_value(doc_id) over (partition by h order by n desc, doc_id) as keep_id,
         count(*) over (partition by h) as group_size
  from t)
select doc_id, keep_id, group_size, rn = 1 as kept, h as text_sha256 from r""",
    "op9_chat_formatting": r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m as (
  select *, case role when 'user' then '[/INST]' when 'assistant' then '</s>' when 'system' then '<</SYS>>' else '[/ROLE]' end as closing,
         case role when 'user' then 13 when 'assistant' then 7 when 'system' then 15 else 19 end as marks
  from c),
e as (
  select *, strpos(text || closing, closing) <> length(text) + 1
            or (role not in ('user', 'assistant', 'system') and strpos(role || '[TEXT]', '[TEXT]') <> length(role) + 1) as escaped,
         case when role in ('user', 'assistant', 'system') then text else role || text end as content
  from m)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(marks + length(content) + case when escaped then 1 + 3 * length(content) - length(replace(content, '~', ''))
                - length(replace(content, '<', '')) - length(replace(content, '[', '')) else 0 end) as bigint) as formatted_chars
from e group by conv_id""",
    "op11_conversation_prefix_trie": f"""
with o as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, conv_id::varchar as id,
         row_number() over (partition by conv_id order by turn nulls first, role, text) as pos
  from conversations where conv_id is not null),
c as (select conv_id, {_crc32("id")} % 6 as h, conv_id - conv_id % 100 as base from (select distinct conv_id, id from o)),
head as (select c.conv_id, o.pos as d, o.role, o.text from c join o on o.conv_id = c.base where o.pos <= c.h),
heads as (select conv_id, count(*) as m from head group by conv_id),
t as (
  select * from head
  union all
  select c.conv_id, o.pos - c.h + coalesce(m, 0), o.role, o.text
  from c join o on o.conv_id = c.conv_id left join heads on heads.conv_id = c.conv_id where o.pos > c.h),
p as (
  select conv_id, d, length(text) as chars,
         sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over (partition by conv_id order by d)) as key
  from t
  union all select conv_id, 0, 0, '' from c),
l as (select conv_id, max(d) as len from p group by conv_id),
n as (
  select d, key, min(p.conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(chars) as saved,
         coalesce(string_agg(p.conv_id::varchar, ',' order by p.conv_id) filter (d = len), '') as ends
  from p join l on l.conv_id = p.conv_id group by d, key),
parents as (select n.*, q.key as up from n left join p q on q.conv_id = n.conv_id and q.d = n.d - 1),
kids as (select d - 1 as d, up as key, count(*) as n_children from parents where d > 0 group by all),
x as (select parents.*, coalesce(n_children, 0) as n_children from parents left join kids on kids.d = parents.d and kids.key = parents.key),
below as (select p.d, p.key, count(*) filter (n_children = 0) as leaves, sum(x.saved) as saved from x join p on p.conv_id = x.conv_id and p.d <= x.d group by p.d, p.key)
select x.conv_id, x.d as depth, u.conv_id as parent_conv_id, x.n_convs, x.n_children, b.leaves as n_leaves,
       b.saved::bigint as saved_tokens, sha256(x.ends) as ends_sha256
from x join below b on b.d = x.d and b.key = x.key left join n u on u.d = x.d - 1 and u.key = x.up""",
    "op12_conversation_structure_repair": rf"""
with recursive i as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key
  from conversations),
z as (select *, {_crc32("key")} % 20 as code from i),
y as (
  select conv_id, turn, case when code = 4 then 'user' else role end as role,
         case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(case code when 0 then []::int[] when 3 then [0, 1] else [0] end) as copy
  from z),
g as (
  select *, row_number() over w as pos, lag(left(role, 1)) over w || left(role, 1) as pair, left(role, 1) as initial,
         case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b'
              when row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 then 'd'
              when regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) not in ('.', '!', '?') then 't' else '-' end as fault
  from y window w as (partition by conv_id order by turn nulls first, role, text, copy)),
s as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
         count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
  from g group by conv_id),
v as (
  select conv_id, n + 1 as pos, {{'c': 0, 'a': '', 't': []::varchar[]}} as vs, {{'c': 10, 'a': 'II', 't': ['user:', 'assistant:']}} as vy,
         {{'c': 5, 'a': 'I', 't': ['assistant:']}} as vu, {{'c': 0, 'a': '', 't': []::varchar[]}} as va
  from s
  union all
  select conv_id, pos - 1, list_min([b_s, {_ahead("u1", "user")}]), list_min([b_y, {_ahead("u1", "user")}]), list_min([bu, {_ahead("a1", "assistant")}]), list_min([ba, {_ahead("u1", "user")}])
  from (
    select *, list_min([bu, {_ahead("ba", "assistant")}]) as u1, list_min([ba, {_ahead("bu", "user")}]) as a1
    from (
      select v.conv_id, v.pos, {_taken("vs", "user", "vu")} as b_s, {_taken("vy", "user", "vu")} as b_y, {_taken("vu", "assistant", "va")} as bu, {_taken("va", "user", "vu")} as ba
      from v join g on g.conv_id is not distinct from v.conv_id and g.pos = v.pos - 1)))
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, coalesce(vs.c, 0)::bigint as cost, coalesce(vs.a, '') as audit, sha256(coalesce(array_to_string(vs.t, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join s on s.conv_id is not distinct from c.conv_id
left join v on v.conv_id is not distinct from c.conv_id and v.pos = 1""",
    "op13_line_dedup": """
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
m as (select key, min(doc_id) as owner from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2)
select doc_id, count(*) as n_lines, count(*) filter (owner <> doc_id) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (owner is null or owner = doc_id), '')) as kept_sha256
from k left join m on m.key = k.key group by doc_id""",
}
