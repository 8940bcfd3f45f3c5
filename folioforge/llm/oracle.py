"""DuckDB SQL of the training-data queries that SQL can express over whole tables.

The SQL of p1_found compares all pairs that share a sequence, so it is a brute-force check at small scale.
"""

from __future__ import annotations

_SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_SEQUENCES = """
r as (select 0 kind, request_id id, body t from (select *, row_number() over (partition by request_id order by received_at desc) n from article_requests) where n = 1
 union all select 1, chunk_id, text from (select *, row_number() over (partition by chunk_id order by created_at desc nulls last) n from chunks) where n = 1),
w as (select kind, id, regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+') w from r where id is not null and t is not null),
g as (select kind, id, hash(w[i], w[i + 1], w[i + 2]) s from (select kind, id, w, unnest(range(1, len(w) - 1)) i from w)),
s as (select distinct kind, id, s from g)"""
_STANDING = """
o as (select * from (select *, row_number() over (partition by request_id order by received_at desc) n from article_requests where request_id is not null) where n = 1),
k as (select nullif(lower(trim(publisher, ' ')), '') p, min(origin) g from publishers group by 1),
s as (select request_id, body, case when nullif(lower(trim(o.publisher, ' ')), '') is not null then coalesce(k.g, lower(trim(o.publisher, ' '))) else nullif(trim(o.origin, ' '), '') end site from o left join k on nullif(lower(trim(o.publisher, ' ')), '') = k.p),
n as (select site, count(*) total from s where site is not null group by 1),
l as (select site, request_id, unnest(string_split(body, chr(10))) line, generate_subscripts(string_split(body, chr(10)), 1) line_no from s where body is not null),
f as (select site, request_id, line_no::int line_no, line, regexp_replace(trim(regexp_replace(lower(line), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), '\\p{Nd}+', '0', 'g') form from l),
g as (select * from f where site is not null and regexp_matches(form, '\\p{L}')),
c as (select site, form, count(distinct request_id) c from g group by all),
found as (select request_id, line_no from g join c using (site, form) join n using (site) where c >= 5 and c >= 0.03 * total)"""

ORACLE: dict[str, str] = {
    "p1_found": f"""with {_SEQUENCES}, n as (select kind, id, count(*) n from s group by all),
c as (select a.kind, a.id a, b.id b, count(*) both_n from s a join s b on a.kind = b.kind and a.s = b.s and a.id < b.id group by all)
select a record_a, b record_b from c join n x on x.kind = c.kind and x.id = a join n y on y.kind = c.kind and y.id = b where 2 * both_n >= x.n + y.n - both_n""",
    "p1_classes": f"""with {_SEQUENCES}, m as (select kind, id, count(*) n, md5(string_agg(s::varchar, ',' order by s)) cls from s group by all), k as (select kind, cls, min(id) first, count(*) copies, any_value(n) n from m group by all),
e as (select k.kind, k.first, k.n, s.s from k join s on s.kind = k.kind and s.id = k.first),
c as (select a.kind, a.first a, b.first b from e a join e b on a.kind = b.kind and a.s = b.s and a.first <> b.first group by all having 2 * count(*) >= any_value(a.n) + any_value(b.n) - count(*)), d as (select kind, a, count(*) links from c group by all)
select case m.kind when 0 then 'request' else 'chunk' end kind, m.id record_id, k.first class_id, k.copies, coalesce(d.links, 0) links from m join k using (kind, cls) left join d on d.kind = m.kind and d.a = k.first""",
    "p4_found": f"""
with t as (select chunk_id, text from (select *, row_number() over (partition by chunk_id order by created_at desc nulls last) r from chunks where chunk_id is not null and length(text) > 1200) where r = 1),
l as (select chunk_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n from t),
f as (select *, {_strip("line")} bare, sum(case when starts_with(line, '```') then 1 else 0 end) over (partition by chunk_id order by n) fences from l),
p as (select *, sum(case when bare = '' and fences % 2 = 0 then 1 else 0 end) over (partition by chunk_id order by n) par from f),
m1 as (select chunk_id, max(length(x)) m from (select chunk_id, {_strip("string_agg(line, chr(10) order by n)")} x from p group by chunk_id, par) group by 1),
m2 as (select chunk_id, max(length(bare)) m from p group by 1),
m3 as (select chunk_id, max(length({_strip("x")})) m from (select chunk_id, unnest(string_split(regexp_replace(line, '([.!?]["''”’»)\\]}}]?){_SPACE}+', '\\1' || chr(1), 'g'), chr(1))) x from p) group by 1),
m4 as (select chunk_id, max(length(x)) m from (select chunk_id, unnest(regexp_split_to_array(line, '{_SPACE}+')) x from p) group by 1)
select t.chunk_id, case when m1.m <= 1050 then 'paragraph' when m2.m <= 1050 then 'line' when m3.m <= 1050 then 'sentence' when m4.m <= 1050 then 'word' else 'hard' end boundary
from t join m1 using (chunk_id) join m2 using (chunk_id) join m3 using (chunk_id) join m4 using (chunk_id)""",
    "p6_found": f"with {_STANDING} select * from found",
    "p6_bodies": f"""with {_STANDING}, kept as (select f.request_id, string_agg(line, chr(10) order by f.line_no) filter (found.line_no is null) t, count(found.line_no) gone from f left join found using (request_id, line_no) group by 1)
select s.request_id, s.site, case when coalesce(gone, 0) = 0 then s.body else regexp_replace(coalesce(t, ''), '\\n{{3,}}', chr(10) || chr(10), 'g') end body, coalesce(gone, 0)::int n_removed from s left join kept using (request_id)""",
}
