"""DuckDB SQL that the core queries are held against, on the same tables."""

from __future__ import annotations

# Written from the specification, apart from the engine's own patterns: white space, line ends and word characters as Unicode text handling has them.
SPACE = "[\\x{9}\\x{a}\\x{b}\\x{c}\\x{d}\\x{1c}\\x{1d}\\x{1e}\\x{1f}\\x{20}\\x{85}\\p{Z}]"
LINE_END = "\\r\\n|\\n|\\r|\\x{b}|\\x{c}|\\x{1c}|\\x{1d}|\\x{1e}|\\x{85}|\\x{2028}|\\x{2029}"
_W = "\\p{L}\\p{N}_"
_T = f"[{_W}]+(?:[''-]+[{_W}]+)*"
PAGE_MARKER = "<!--[ \\t]*page:[ \\t]*([0-9]+)[ \\t]*-->"
NOW_S = 1737331200  # 2025-01-20 00:00:00 UTC


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _slug(c: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'source')"


def _live(*cols: str) -> str:
    return f"live as (select chunk_id, {', '.join(cols)} from (select *, row_number() over (partition by chunk_id order by created_at desc nulls last) r from chunks where chunk_id is not null) where r = 1)"


_JOBS = "j as (select * from (select *, row_number() over (partition by job_id order by updated_at desc, attempts desc) r from jobs where job_id is not null and status in ('queued','running','succeeded','failed')) where r = 1)"
_MANIFESTS = "m as (select * from (select *, row_number() over (partition by source_id order by updated_at desc) r from source_manifests) where r = 1)"
_QUALITY = f"""
b as (select *, {_strip("coalesce(text, '')")} t from documents),
q as (select *, length(t) char_count, regexp_extract_all(t, '{_T}') w,
        length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) alnum, length(t) - length(replace(t, '�', '')) replaced,
        len(list_filter(regexp_split_to_array(t, '{LINE_END}'), lambda x: length(regexp_replace(x, '{SPACE}', '', 'g')) > 0)) line_count from b),
r as (select *, len(w) word_count, case when char_count > 0 then alnum / char_count else 0.0 end alpha_ratio, case when char_count > 0 then replaced / char_count else 0.0 end replacement_char_ratio,
        case when len(w) > 0 then length(array_to_string(w, '')) / len(w) else 0.0 end avg_word_length from q),
f as (select *, list_filter([case when char_count < 200 then 'too_few_chars' end, case when alpha_ratio < 0.45 then 'low_alpha_ratio' end, case when replacement_char_ratio > 0.02 then 'replacement_chars' end,
        case when avg_word_length > 35 then 'long_average_word' end, case when line_count = 0 then 'no_lines' end], lambda x: x is not null) flags from r),
p as (select *, len(flags) = 0 is_true_text, char_count >= 50 and alpha_ratio >= 0.45 and not list_contains(flags, 'replacement_chars') and not list_contains(flags, 'long_average_word') usable from f),
v as (select source, count(*) pages, count(*) filter (usable) usable_pages, count(*) filter (is_true_text) true_text_pages from p group by source),
vote as (select *, true_text_pages > 0 and (usable_pages / pages >= 0.5 or true_text_pages >= 3) likely_true_text from v)
"""


def _url(c: str) -> str:
    shape = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$"
    part = lambda k: f"regexp_extract({_strip(c)}, '{shape}', {k})"
    ends = r"^(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$"
    host, port = f"lower(regexp_extract({part(2)}, '{ends}', 1))", f"regexp_extract({part(2)}, '{ends}', 2)"
    path = f"regexp_replace({part(3)}, '/+$', '')"
    scheme = f"lower({part(1)})"
    return (
        f"case when regexp_matches({_strip(c)}, '{shape}') and {scheme} in ('http','https') and {host} <> '' and not contains({part(2)}, '@') then "
        f"{scheme} || '://' || {host} || case when {port} = '' or ({scheme} = 'https' and {port} = '443') or ({scheme} = 'http' and {port} = '80') then '' else ':' || {port} end || "
        f"case when {path} = '' then '/' else {path} end || case when {part(4)} = '?' then '' else {part(4)} end end"
    )


def _key(hash_: str, external: str = "external_id") -> str:
    address = "coalesce(nullif(canonical_url, ''), nullif(url, ''))"
    return (
        f"case when nullif({external}, '') is not null then 'external:' || nullif(lower({_strip('origin')}), '') || ':' || {_strip(external)} "
        f"when {address} is not null then 'url:' || {_url(address)} else 'sha256:' || {hash_} end"
    )


_IDENTITIES = f"""
once as (select * from (select *, row_number() over (partition by request_id order by received_at desc) r from article_requests) where r = 1),
i as (select request_id, received_at, duplicate_policy, {_key("sha256(coalesce(body, ''))")} identity_key from once)
"""
_BACKFILLED = f"{_MANIFESTS}, k as (select source_id, nullif(identity_key, '') is null backfilled, coalesce(nullif(identity_key, ''), {_key('nullif(content_sha256, chr(0))', 'case when nullif(origin, chr(0)) is not null then external_id end')}) identity_key from m)".replace("chr(0)", "''")
_BM25_LIVE = _live("source_id", "title", "chapter", "section", "page_start", "page_end", "text", "language", "embedding_model", "embedding_dimension", "embedding")


def _bm25(where: str = "true", terms: tuple[str, ...] = ("router", "firewall", "packet")) -> str:
    n = range(len(terms))
    tf = ", ".join(f"len(list_filter(k, lambda x: x = '{t}')) tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) filter (tf{i} > 0) df{i}" for i in n)
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * dl / av))" for i in n)
    return f"""
tk as (select *, regexp_extract_all(lower(coalesce(text, '')), '{_T}') k from live),
ct as (select *, len(k) dl, {tf} from tk),
st as (select count(*) n, avg(dl) av, {df} from ct),
lx as (select chunk_id, round({score}, 6) lexical from ct, st where {where}),
lexed as (select * from lx where lexical > 0)"""


_VEC = """
qv as (select embedding::double[] q from chunks where embedding_model = 'harbor-embed-64' and len(embedding) = embedding_dimension order by chunk_id, created_at limit 1),
vx as (select chunk_id, language, round(list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q))), 6) cosine
       from live, qv where embedding_model = 'harbor-embed-64' and len(embedding) = embedding_dimension and len(embedding) = len(q) and list_dot_product(embedding::double[], embedding::double[]) > 0)"""


def _hybrid(score: str) -> str:
    return f"""with {_BM25_LIVE}, {_bm25("language = 'en'")}, {_VEC},
a as (select chunk_id, lexical, row_number() over (order by lexical desc, chunk_id) lr from lexed),
c as (select chunk_id, cosine, row_number() over (order by cosine desc, chunk_id) cr from vx where language = 'en'),
u as (select coalesce(a.chunk_id, c.chunk_id) chunk_id, lexical, cosine, lr, cr from a full outer join c on a.chunk_id = c.chunk_id),
e as (select min(lexical) ll, max(lexical) lh, min(cosine) cl, max(cosine) ch from u),
s as (select chunk_id, lexical, cosine, round({score}, 9) score from u, e)
select row_number() over (order by score desc, chunk_id)::int rank, chunk_id, score, lexical, cosine from s qualify rank <= 12"""


_RELATIVE = "0.65 * coalesce(case when ch > cl then (cosine - cl) / (ch - cl) when cosine is not null then 1.0 end, 0.0) + (1 - 0.65) * coalesce(case when lh > ll then (lexical - ll) / (lh - ll) when lexical is not null then 1.0 end, 0.0)"


def _hashed(rows: str) -> str:
    """(k, b, v): sums of signs by bucket of the words of (k, t) rows."""
    return f"""select k, h % 64 b, sum(case when (h // 64) % 2 = 1 then 1.0 else -1.0 end)::double v from
 (select k, ('0x' || substr(md5(w), 1, 8))::bigint h from (select k, unnest(regexp_extract_all(lower(t), '[{_W}]+(?:[''-][{_W}]+)*')) w from ({rows}))) group by all"""


_INSTRUCTED = "Instruct: Given a question, retrieve relevant source passages that answer it' || chr(10) || 'Query: "
_ASKED = "How do routers and firewalls pass packets?"
#: The whole search: words of the question by BM25, its hashed vector after the instruction by cosine, English chunks only, both lists fused.
_HITS = f"""with {_live("title", "chapter", "section", "page_start", "page_end", "text", "language")},
{_bm25("language = 'en'", ("how", "do", "routers", "and", "firewalls", "pass", "packets"))},
bv as ({_hashed("select chunk_id k, coalesce(text, '') t from live where language = 'en'")}), qb as ({_hashed(f"select 0 k, '{_INSTRUCTED}{_ASKED}' t")}),
vx as (select n.k chunk_id, round(coalesce(d, 0) / (size * (select sqrt(sum(v * v)) from qb)), 6) cosine from (select k, sqrt(sum(v * v)) size from bv group by k) n left join (select bv.k, sum(bv.v * qb.v) d from bv join qb using (b) group by bv.k) x on n.k = x.k where size > 0),
u as (select coalesce(lexed.chunk_id, vx.chunk_id) chunk_id, lexical, cosine from lexed full outer join vx on lexed.chunk_id = vx.chunk_id),
e as (select min(lexical) ll, max(lexical) lh, min(cosine) cl, max(cosine) ch from u),
s as (select chunk_id, lexical, cosine, round({_RELATIVE}, 9) score from u, e),
hits as (select row_number() over (order by score desc, s.chunk_id) rank, score, lexical, cosine, live.* from s join live using (chunk_id) qualify rank <= 10)"""
_GENERATIONS = f"{_live('source_id', 'chunk_index', 'text', 'page_start')}, old as (select * from live where chunk_index % 7 <> 0), new as (select chunk_id, source_id, chunk_index, case when chunk_index % 3 = 0 then upper(text) else text end text, page_start from live where chunk_index % 5 <> 0)"


def _label(zero: str = "") -> str:
    return f"case when page_start is null then 'unknown' when page_end is null or page_end = page_start {zero} then page_start::varchar else page_start || '–' || page_end end"


_PACK_HEAD = "# Context Pack\n\nUser question:\nHow do routers and firewalls pass packets?\n\nInstructions:\nUse only the provided context. Cite sources as [Title, p. 87]. If the answer is not in the context, say so.\n\nTask: answer\n\n"

_SP = SPACE
_PLAIN = lambda c: _strip(f"regexp_replace(regexp_replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '[`*_]+', '', 'g'), '{_SP}+', ' ', 'g')")
#: Chunks of documents, one row each: units by windows over parts, then a fold that carries the open chunk from unit to unit.
_PACKED = f"""recursive p0 as (select doc_id::varchar src, unnest(regexp_split_to_array(text, '\\n{_SP}*\\n')) part, generate_subscripts(regexp_split_to_array(text, '\\n{_SP}*\\n'), 1) o from documents where text is not null),
p1 as (select src, part, row_number() over (partition by src order by o) i from p0 where {_strip("part")} <> ''),
p2 as (select *, nullif(regexp_extract(part, '<!--{_SP}*page:{_SP}*([0-9]+){_SP}*-->', 1), '')::int pg, length(regexp_extract(part, '(?m)^(#{{1,6}}){_SP}+([^\\n]+?){_SP}*$', 1)) lv,
 {_strip(f"regexp_extract(part, '(?m)^(#{{1,6}}){_SP}+([^\\n]+?){_SP}*$', 2)")} raw, case when regexp_matches(part, '^{_SP}*#{_SP}+[^\\n]+?{_SP}*$') then 'L' when regexp_matches({_PLAIN("part")}, '(?i)\\bthis +chapter +covers\\b') then 'C' else '-' end kind,
 {_strip(f"regexp_replace(regexp_replace(part, '<!--{_SP}*page:{_SP}*[0-9]+{_SP}*-->', '', 'g'), '(?mi)^{_SP}*##{_SP}+Page{_SP}+[0-9]+{_SP}*$', '', 'g')")} = '' bare from p1),
p3 as (select *, {_PLAIN("raw")} title, string_agg(kind, '') over (partition by src order by i rows between 1 following and 4 following) ahead from p2),
p4 as (select *, lv = 1 and regexp_matches(title, '(?i)^(chapter +[0-9]+\\b.*|[0-9]+ *: +[^ ].*)$') explicit from p3),
p5 as (select *, lv = 1 and not explicit and regexp_matches(coalesce(ahead, ''), '^-*C') untitled from p4),
p6 as (select *, case when explicit then title when untitled then 'Chapter ' || count(*) filter (untitled) over (partition by src order by i) || ': ' || title end ch, case when lv > 0 and title <> '' and not starts_with(lower(title), 'page ') then raw end sec, coalesce(count(*) filter (not bare) over (partition by src order by i rows between unbounded preceding and 1 preceding), 0) g from p5),
p7 as (select src, i, g, part, last_value(pg ignore nulls) over w pg, last_value(sec ignore nulls) over w sec, last_value(ch ignore nulls) over w ch, row_number() over (partition by src, g order by i) k from p6 window w as (partition by src order by i rows between unbounded preceding and current row)),
u as (select src, g + 1 j, {_strip(f"string_agg(case when k = 1 then part else regexp_replace(part, '{_SP}+$', '') end, chr(10) order by i)")} t, arg_max(coalesce(pg, 0), i) pg, nullif(arg_max(coalesce(sec, chr(0)), i), chr(0)) sec, nullif(arg_max(coalesce(ch, chr(0)), i), chr(0)) ch from p7 group by src, g),
n as (select src, max(j) n from u group by src),
f as (
 select src, 0::bigint j, ''::varchar buf, []::int[] pages, null::varchar ch, null::varchar sec, ''::varchar a, []::int[] a_pages, null::varchar a_ch, null::varchar a_sec, ''::varchar b, []::int[] b_pages, null::varchar b_ch, null::varchar b_sec from n
 union all
 select x.src, x.j + 1, case when last or big then '' when spills then {_strip(f"{_strip('right(held, 150)')} || chr(10) || chr(10) || t")} when held = '' then t else held || chr(10) || chr(10) || t end,
  case when last or big then [] when spills then case when {_strip("right(held, 150)")} <> '' and len(held_pages) > 0 then [held_pages[-1]] else [] end || own else held_pages || own end,
  x.uch, x.usec, case when turn then buf else '' end, x.pages, x.ch, x.sec, case when last or big or spills then held else '' end, held_pages, x.ch, case when last then x.sec else x.usec end
 from (select f.*, u.t, case when u.pg > 0 then [u.pg] else [] end own, u.ch uch, u.sec usec, u.j is null as last, coalesce(length(u.t) > 1200, false) big,
   buf <> '' and coalesce(u.ch, '') <> '' and f.ch is distinct from u.ch turn, case when buf <> '' and coalesce(u.ch, '') <> '' and f.ch is distinct from u.ch then '' else buf end held,
   case when buf <> '' and coalesce(u.ch, '') <> '' and f.ch is distinct from u.ch then [] else f.pages end held_pages,
   buf <> '' and not (coalesce(u.ch, '') <> '' and f.ch is distinct from u.ch) and length(buf) >= 250 and length(buf) + 2 + length(u.t) > 1200 spills
  from f join n on n.src = f.src and f.j <= n.n left join u on u.src = f.src and u.j = f.j + 1) x),
cut(src, j, text, a, e) as (
 select src, j, t, 0, case when length(regexp_extract(substr(t, 1, 1200), '(?s)^(.*)[ \\n]', 1)) > 600 then length(regexp_extract(substr(t, 1, 1200), '(?s)^(.*)[ \\n]', 1)) + 1 else 1200 end from u where length(t) > 1200
 union all
 select src, j, text, greatest(e - 150, a + 1), case when greatest(e - 150, a + 1) + 1200 >= length(text) then length(text)
   when length(regexp_extract(substr(text, greatest(e - 150, a + 1) + 1, 1200), '(?s)^(.*)[ \\n]', 1)) > 600 then greatest(e - 150, a + 1) + length(regexp_extract(substr(text, greatest(e - 150, a + 1) + 1, 1200), '(?s)^(.*)[ \\n]', 1)) + 1
   else greatest(e - 150, a + 1) + 1200 end from cut where e < length(text)),
every_ as (select src, j, 0 o, 0 k, a t, a_pages pages, a_ch ch, a_sec sec from f union all select src, j, 1, 0, b, b_pages, b_ch, b_sec from f
 union all select cut.src, cut.j, 2, a, substr(text, (a + 1)::bigint, (e - a)::bigint), case when u.pg > 0 then [u.pg] else [] end, u.ch, u.sec from cut join u on u.src = cut.src and u.j = cut.j),
packed as (select src, row_number() over (partition by src order by j, o, k) - 1 chunk_index, ch, sec, list_sort(list_distinct(pages)) pages, {_strip("t")} t from every_ where {_strip("t")} <> '')"""


ORACLE: dict[str, str] = {
    "text_quality": f"with {_QUALITY} select doc_id, char_count, word_count, round(alpha_ratio, 6) alpha_ratio, round(replacement_char_ratio, 6) replacement_char_ratio, round(avg_word_length, 6) avg_word_length, line_count, array_to_string(flags, ',') flags, is_true_text from p",
    "quality_flag_counts": f"with {_QUALITY}, x as (select unnest(flags) flag from p) select flag, count(*) documents from x group by flag",
    "ocr_route": f"""with {_QUALITY}, s as (select p.*, likely_true_text, doc_id % 5 = 0 has_images, doc_id % 5 = 0 or is_true_text or doc_id % 3 = 0 has_visual from p left join vote on p.source is not distinct from vote.source)
select doc_id, usable, likely_true_text, case when is_true_text then 'text' when likely_true_text and not has_visual then 'text'
 when char_count > 0 and not has_images and len(list_filter(flags, lambda x: x <> 'too_few_chars')) = 0 then 'text' when char_count > 0 and not has_visual then 'text' when has_visual then 'ocr' else 'text' end route from s""",
    "source_votes": f"with {_QUALITY} select source, pages, usable_pages, true_text_pages, likely_true_text from vote",
    "extraction_summary": """with l as (select * from (select *, row_number() over (partition by source_id, page_number order by extracted_at desc) r from page_metadata) where r = 1)
select source_id, count(*) pages_total, count(*) filter (extraction_method = 'pymupdf4llm') pages_layout, count(*) filter (extraction_method = 'ocr') pages_ocr,
 case when count(distinct case when extraction_method = 'ocr' then ocr_provider end) > 1 then 'mixed' else min(case when extraction_method = 'ocr' then ocr_provider end) end ocr_provider,
 case when count(distinct case when extraction_method = 'ocr' then ocr_model end) > 1 then 'mixed' else min(case when extraction_method = 'ocr' then ocr_model end) end ocr_model,
 bool_and(coalesce(extraction_method = 'skipped', false)) all_skipped from l group by source_id""",
    "normalized_pages": f"""with b as (select doc_id, doc_id % 50 + 1 n, regexp_replace({_strip("regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g')")}, '\\n{{3,}}', chr(10) || chr(10), 'g') t from documents),
m as (select doc_id, t, regexp_replace(case when starts_with(t, '<!-- page: ' || n || ' -->') then t else '<!-- page: ' || n || ' -->' || chr(10) || chr(10) || '## Page ' || n || chr(10) || chr(10) || t end, '{SPACE}+$', '') || chr(10) markdown from b)
select doc_id, markdown, case when t = '' then 0 else length({_strip("markdown")}) end char_count, case when t = '' then 0 else len(list_filter(regexp_split_to_array({_strip("markdown")}, '{SPACE}+'), lambda w: w <> '')) end word_count from m""",
    "combined_chapters": f"with {_live('source_id', 'chapter', 'chunk_index', 'text')} select source_id, chapter, {_strip('string_agg(' + _strip('text') + ', chr(10) order by chunk_index, text)')} || chr(10) markdown from live where text is not null group by source_id, chapter",
    "raster_signals": "select event_id, (event_id * 37) % 4000 <= greatest(8, 100) blank, event_id % 97 = 0 or ((event_id * 37) % 4000) / 1000000 >= 0.002 visual from events",
    "url_forms": f"select distinct request_id, {_url('url')} url_form, {_url('canonical_url')} canonical_form from article_requests",
    "source_ids": f"""with t as (select distinct source_id, title, created_at, epoch_us(created_at) u from source_manifests), s as (select *, make_timestamp(u) ts from t),
i as (select *, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when u % 1000000 = 0 then '' else '.' || lpad((u % 1000000)::varchar, 6, '0') end || '+00:00' iso from s)
select source_id, {_slug('title')} slug, {_slug('title')} || '_' || year(ts) || '_' || substr(sha1(title || ':' || iso), 1, 6) made_id, regexp_full_match(source_id, '[A-Za-z0-9][A-Za-z0-9_-]{{0,199}}') valid from i""",
    "file_names": """select distinct job_id, coalesce(nullif(substr(trim(regexp_replace(list_extract(string_split('/in box/' || filename || ' (1)', '/'), -1), '[^A-Za-z0-9._-]+', '_', 'g'), '._'), 1, 120), ''), 'upload') file_name,
 'chapter_' || lpad((right(regexp_extract(job_id, '([0-9]+)$', 1), 3)::int)::varchar, greatest(2, length((right(regexp_extract(job_id, '([0-9]+)$', 1), 3)::int)::varchar))::int, '0') || '.md' chapter_file from jobs""",
    "tags_normalized": f"with t as (select distinct request_id, tags from article_requests) select request_id, array_to_string(list_filter(list_transform(flatten(list_transform(coalesce(tags, []), lambda t: string_split(t, ','))), lambda x: {_strip('x')}), lambda x: x <> ''), '|') tags from t",
    "input_kinds": "select case lower(regexp_extract(filename, '\\.([A-Za-z0-9]+)$', 1)) when 'pdf' then 'pdf' when 'md' then 'markdown' when 'markdown' then 'markdown' when 'txt' then 'text' when 'png' then 'image' when 'jpg' then 'image' when 'jpeg' then 'image' when 'tif' then 'image' when 'tiff' then 'image' when 'webp' then 'image' when 'bmp' then 'image' end kind, count(*) jobs from jobs group by 1",
    "front_matter": f"with {_MANIFESTS} select source_id, replace(nullif(title, ''), chr(34), chr(39)) title, replace(nullif(collection, ''), chr(34), chr(39)) collection, replace(nullif(external_id, ''), chr(34), chr(39)) external_id, array_to_string(list_filter(list_transform(flatten(list_transform(coalesce(tags, []), lambda t: string_split(t, ','))), lambda x: {_strip('x')}), lambda x: x <> ''), '|') tags, 'other' source_type, 'unknown' AS language, 'Body of it.' body, null::varchar front_error, coalesce(length({_strip('title')}) > 0, false) has_title from m",
    "service_answers": "select event_id, event_type markdown, case when event_id % 7 = 0 then 0.0::double else 1.0::double end first_x, 0.8::double second_y from events",
    "identity_keys": f"with {_IDENTITIES} select request_id, identity_key from i",
    "duplicate_decisions": f"""with {_IDENTITIES}, d as (select *, case when identity_key is not null then first_value(request_id) over (partition by identity_key order by received_at, request_id) end f from i)
select request_id, case when identity_key is null then 'invalid' when f = request_id or duplicate_policy = 'create' then 'accepted' else 'rejected' end decision, case when f <> request_id then f end existing_id from d""",
    "identity_backfill": f"with {_BACKFILLED} select source_id, identity_key, backfilled from k",
    "identity_collisions": f"with {_BACKFILLED}, a as (select source_id, identity_key from k union all select source_id || '_again', identity_key from k where length(source_id) % 5 = 0) select identity_key, count(*) n_sources, string_agg(source_id, ',' order by source_id) source_ids from a where identity_key is not null group by identity_key having count(*) > 1",
    "published_already": f"with {_BACKFILLED}, {_IDENTITIES}, s as (select identity_key, min(source_id) source_id from k where identity_key is not null group by identity_key) select request_id, s.source_id from i left join s using (identity_key)",
    "reservation_reconcile": f"with {_JOBS}, {_MANIFESTS} select job_id owner_id, exists (select 1 from m where m.source_id = j.source_id) or (attempts <= 1 and status not in ('queued', 'running') and {NOW_S} - floor(epoch(created_at)) > 300) or (attempts > 1 and {NOW_S} - floor(epoch(created_at)) > 86400) as release from j",
    "split_long_text": f"""with recursive w(doc_id, text, a, b) as (
 select doc_id, text, 0, case when length(text) <= 1200 then length(text) else 0 end from documents where text is not null
 ), cut(doc_id, text, a, b) as (
 select doc_id, text, 0, case when length(text) <= 1200 then length(text) when length(regexp_extract(substr(text, 1, 1200), '(?s)^(.*)[ \\n]', 1)) > 600 then length(regexp_extract(substr(text, 1, 1200), '(?s)^(.*)[ \\n]', 1)) + 1 else 1200 end from w
 union all
 select doc_id, text, greatest(b - 150, a + 1), case when greatest(b - 150, a + 1) + 1200 >= length(text) then length(text)
   when length(regexp_extract(substr(text, greatest(b - 150, a + 1) + 1, 1200), '(?s)^(.*)[ \\n]', 1)) > 600 then greatest(b - 150, a + 1) + length(regexp_extract(substr(text, greatest(b - 150, a + 1) + 1, 1200), '(?s)^(.*)[ \\n]', 1)) + 1
   else greatest(b - 150, a + 1) + 1200 end from cut where b < length(text))
select doc_id, a::bigint char_from, b::bigint char_to, {_strip("substr(text, (a + 1)::bigint, (b - a)::bigint)")} AS text from cut where {_strip("substr(text, (a + 1)::bigint, (b - a)::bigint)")} <> ''""",
    "packed_chunks": f"with {_PACKED} select src AS source, chunk_index::int chunk_index, ch inferred_chapter, sec section, array_to_string(pages, ',') pages, t AS text from packed",
    "described_chunks": f"""with {_PACKED}, d as (select *, doc_id % 4 = 0 scanned from documents),
x as (select packed.*, d.title, d.lang, case when len(pages) = 0 then 'mixed' when pages = [1] then case when scanned then 'ocr' else 'markdown' end when list_contains(pages, 1) then 'mixed' else 'unknown' end way, case when scanned and list_contains(pages, 1) then 'm1' end model from packed join d on d.doc_id::varchar = src)
select src || '_' || {_slug("coalesce('ch' || ch, 'doc')")} || '_p' || lpad(coalesce(pages[1], 0)::varchar, greatest(4, length(coalesce(pages[1], 0)::varchar))::int, '0') || '_' || lpad(chunk_index::varchar, greatest(4, length(chunk_index::varchar))::int, '0') chunk_id,
 src source_id, ch chapter, sec section, pages[1] page_start, pages[-1] page_end, chunk_index::int chunk_index, way extraction_method, model ocr_model, title, lang AS language from x""",
    "markdown_parts": f"""with p as (select doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t\\n]*\\n')) part, generate_subscripts(regexp_split_to_array(text, '\\n[ \\t\\n]*\\n'), 1) - 1 pos from documents where text is not null)
select doc_id, pos, nullif(regexp_extract(part, '{PAGE_MARKER}', 1), '')::bigint page, {_strip(f"regexp_replace(regexp_replace(regexp_replace(nullif(regexp_extract(part, '(?m)^(#{{1,6}})[ \\t]+([^\\n]+)$', 2), ''), '<[^>]+>', '', 'g'), '[`*_]+', '', 'g'), '{SPACE}+', ' ', 'g')")} heading
from p where regexp_replace(part, '{SPACE}', '', 'g') <> ''""",
    "filter_equal_pages": f"with {_live('language', 'source_type', 'page_start', 'page_end')} select chunk_id from live where language = 'en' and source_type = 'documentation' and page_end >= 3 and page_start <= 20",
    "filter_tags": f"with {_live('tags')} select chunk_id from live where list_contains(tags, 'law')",
    "page_overlaps": f"with {_live('source_id', 'chapter', 'page_start', 'page_end')} select a.chunk_id left_id, count(*) n_overlaps from live a join live b on a.source_id = b.source_id and coalesce(a.chapter, '') = coalesce(b.chapter, '') and a.chunk_id < b.chunk_id and a.page_start <= b.page_end and b.page_start <= a.page_end where a.page_start <= a.page_end and b.page_start <= b.page_end group by 1",
    "bm25_topk": f"with {_BM25_LIVE}, {_bm25()} select chunk_id, lexical, row_number() over (order by lexical desc, chunk_id)::int rank from lexed qualify rank <= 20",
    "vector_topk": f"with {_BM25_LIVE}, {_VEC} select chunk_id, cosine, row_number() over (order by cosine desc, chunk_id)::int rank from vx qualify rank <= 20",
    "hybrid_relative": _hybrid(_RELATIVE),
    "search_hits": f"{_HITS} select rank::int rank, chunk_id, round(score, 6) score, lexical, round(cosine, 5) cosine, title, 'hashed-words-64' embedding_model from hits",
    "chunk_shown": f"with {_live('source_id', 'title', 'text')} select chunk_id, source_id, title, text from live where chunk_id = (select min(chunk_id) from chunks)",
    "source_shown": f"with {_MANIFESTS} select source_id, title, source_type, collection from m where source_id = (select min(source_id) from source_manifests)",
    "hashed_embeddings": f"""with {_live("text")}, v as ({_hashed("select chunk_id k, text t from live where text is not null")}), q as ({_hashed("select 0 k, 'router firewall packet' t")}),
n as (select k, sqrt(sum(v * v)) size from v group by k), d as (select v.k, sum(v.v * q.v) d from v join q using (b) group by v.k)
select chunk_id, case when coalesce(size, 0) > 0 then 1.0 else 0.0 end::double AS size, round(coalesce(d / (size * (select sqrt(sum(v * v)) from q)), 0), 4)::double likeness from live left join n on n.k = chunk_id left join d on d.k = chunk_id where text is not null""",
    "hybrid_rrf": _hybrid("0.65 * coalesce(1 / (60 + cr), 0.0) + (1 - 0.65) * coalesce(1 / (60 + lr), 0.0)"),
    "search_lines": f"{_HITS} select rank::int rank, rank || '. ' || coalesce(title, '') || ', chapter ' || coalesce(nullif(chapter, ''), '-') || ', section ' || coalesce(nullif(section, ''), '-') || ', pages ' || {_label('or page_end = 0')} || chr(10) || '   score: ' || printf('%.6f', score) || chr(10) || '   chunk_id: ' || chunk_id || chr(10) || '   snippet: ' || substr(replace(text, chr(10), ' '), 1, 300) AS line from hits",
    "context_pack": f"""{_HITS}, b as (select rank, concat_ws(chr(10), '## Source ' || rank, 'Title: ' || coalesce(title, ''), 'Chapter: ' || coalesce(chapter, ''), 'Section: ' || coalesce(section, ''), 'Pages: ' || {_label()}, 'Chunk ID: ' || chunk_id, '', {_strip('text')}, '') t from hits)
select regexp_replace('{_PACK_HEAD}' || coalesce(string_agg(t, chr(10) order by rank), ''), '\\s+$', '') || chr(10) context_pack, count(*) sources from b""",
    "model_mismatch": f"with {_live('embedding_model')} select distinct embedding_model from live where embedding_model is not null and embedding_model <> 'harbor-embed-64'",
    "neighbours_by_label": "with q as (select embedding::double[] q from embeddings order by vec_id limit 1), v as (select vec_id::varchar chunk_id, label, round(list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q))), 6) cosine from embeddings, q where len(embedding) = len(q)) select chunk_id, label, cosine, row_number() over (partition by label order by cosine desc, chunk_id)::int rank from v qualify rank <= 3",
    "stale_chunks": f"with {_GENERATIONS} select chunk_id from old except select chunk_id from new",
    "generation_diff": f"with {_GENERATIONS} select case when a.chunk_id is null then 'added' when b.chunk_id is null then 'removed' when a.source_id is not distinct from b.source_id and a.chunk_index is not distinct from b.chunk_index and a.text is not distinct from b.text and a.page_start is not distinct from b.page_start then 'same' else 'changed' end change, count(*) chunks from old a full outer join new b on a.chunk_id = b.chunk_id group by 1",
    "upsert_generation": f"with {_GENERATIONS} select chunk_id, md5(coalesce(text, '')) text_md5 from new union all select chunk_id, md5(coalesce(text, '')) from old where chunk_id not in (select chunk_id from new)",
    "duplicate_chunk_ids": "select source_id, chunk_id, count(*) n from chunks group by all having count(*) > 1",
    "dimension_report": "select embedding_model, count(*) vectors, min(len(embedding)) least, max(len(embedding)) most, count(*) filter (embedding_dimension is distinct from len(embedding)) misstated, min(len(embedding)) = max(len(embedding)) uniform from chunks where embedding is not null and embedding_model is not null group by 1",
    "source_models": "select source_id, coalesce(string_agg(distinct embedding_model, ',' order by embedding_model), '') models, bool_or(coalesce(embedding_model <> 'harbor-embed-64', false)) mismatch from chunks group by 1",
    "chunk_stats": f"with {_live('source_id', 'text', 'page_start', 'page_end')} select source_id, count(*) chunks, sum(length(text))::bigint chars, min(page_start) first_page, max(page_end) last_page, round(avg(length(text)), 6) mean_chars from live group by 1",
    "facet_rollup": f"with {_live('source_type', 'language')} select source_type, language, count(*) chunks, grouping(source_type, language) AS level from live group by rollup (source_type, language)",
    "chunk_keys": f"""with {_live('source_id')}, d as (select chunk_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(chunk_id)) h from live)
select chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::int % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) object_key from d""",
    "object_faults": f"with {_live('text', 'embedding', 'embedding_dimension')}, f as (select chunk_id, case when text is null then 'no_text' when embedding is null or len(embedding) = 0 then 'no_vector' when len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) > 0 then 'bad_vector' when embedding_dimension is distinct from len(embedding) then 'wrong_length' end fault from live) select * from f where fault is not null",
    "snapshot_faults": """with f as (select case when chunk_id is null then 'no_id' when text is null then 'no_text' when embedding is null or len(embedding) = 0 then 'no_vector' when len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) > 0 then 'bad_vector' when embedding_dimension is distinct from len(embedding) then 'wrong_length' end fault from chunks
 union all select 'two_sources' from (select chunk_id from chunks where chunk_id is not null group by 1 having min(source_id) <> max(source_id)) union all select 'unknown_source' from chunks where source_id is null or source_id not in (select source_id from source_manifests where source_id is not null))
select fault, count(*) AS rows from f where fault is not null group by 1""",
    "source_scan": f"with {_live('source_id', 'chunk_index', 'text')}, b as (select source_id from live group by 1 order by count(*) desc, source_id limit 1) select chunk_id, source_id, chunk_index, text from live where source_id = (select source_id from b) order by chunk_id limit 20 offset 20",
    "input_refusals": "with j as (select distinct job_id, filename, (regexp_extract(job_id, '([0-9]+)$', 1)::bigint * 7919) % 400 n from jobs), s as (select case when n % 5 = 0 then filename || '.zip' else filename end f, case when n % 7 = 0 then 0 else n end n from j) select case when not regexp_matches(f, '(?i)\\.(pdf|png|jpe?g|tiff?|webp|bmp|md|markdown|txt)$') then 'unsupported' when n = 0 then 'blank' when n > 300 then 'too_large' end reason, count(*) jobs from s group by 1",
    "failure_kinds": "with m as (select distinct error from jobs where error is not null) select null::varchar error, code::int code, null::varchar kind, code >= 500 or code in (408, 425, 429) again from range(400, 520) t(code) union all select error, null, k.kind, k.kind = 'ReadTimeout' or regexp_matches(error, '(?i)unavailable|deadline_exceeded|connection (refused|lost|reset)|failed to connect|transport is closing') from m, (values ('ReadTimeout'), ('ValueError')) k(kind)",
    "index_properties": f"""with {_live('source_id', 'section', 'page_start', 'tags')} select chunk_id, '{{' || concat_ws(',', '"chunk_id":' || to_json(chunk_id), '"source_id":' || to_json(source_id), '"section":' || to_json(section), '"page_start":' || page_start, case when len(tags) > 0 then '"tags":[' || array_to_string(list_transform(tags, lambda t: coalesce(to_json(t)::varchar, 'null')), ',') || ']' end) || '}}' properties from live""",
    "source_list": f"with {_MANIFESTS} select source_id, title, source_type, chapter from m",
    "chunk_list": f"with {_live('title', 'page_start', 'page_end')} select chunk_id, title, {_label()} pages from live",
    "job_ready": f"with {_JOBS} select job_id from j where status = 'queued' and (next_attempt_at is null or epoch_us(next_attempt_at) <= {NOW_S}000000) order by created_at, job_id limit 25",
    "job_claim": f"with {_JOBS}, c as (select job_id from j where status = 'queued' and (next_attempt_at is null or epoch_us(next_attempt_at) <= {NOW_S}000000) order by created_at, job_id limit 1) select j.job_id, case when c.job_id is not null then 'running' else status end status, case when c.job_id is not null then attempts + 1 else attempts end attempts, case when c.job_id is not null then 'worker-x' else worker_id end worker_id from j left join c on j.job_id = c.job_id",
    "job_recovery": f"with {_JOBS} select case when status = 'running' then 'queued' else status end status, count(*) jobs, count(case when status <> 'running' then worker_id end) owned from j group by 1",
    "job_failures": f"with {_JOBS}, e as (select job_id, error, regexp_matches(coalesce(error, ''), '(?i)statuscode.unavailable|statuscode.deadline_exceeded|connection refused|connection lost|connection reset|failed to connect|service unavailable|transport is closing') retryable from j where status = 'failed') select job_id, error, retryable, case when retryable then 'queued' else 'failed' end next_status, case when retryable then {NOW_S}::bigint + 10 end next_attempt_s from e",
    "admission_control": f"""with recursive {_JOBS}, u as (select request_id, max(length(body))::bigint bytes, row_number() over (order by min(received_at), request_id) n, coalesce(max(length(body)), 0)::bigint b from article_requests group by request_id),
w(n, places, used, decision) as (
 select 0::bigint, 20, 30000::bigint, ''
 union all
 select u.n, case when d = 'admitted' then places - 1 else places end, case when d = 'admitted' then used + b else used end, d
 from w join u on u.n = w.n + 1, lateral (select case when places = 0 then 'queue_full' when used + least(b, 2500) > 60000 then 'storage_full' when b > 2500 then 'too_large' else 'admitted' end d))
select request_id, bytes, decision from u join w using (n)""",
    "retry_jobs": f"""with {_JOBS}, held as (select distinct a.job_id from j a join j b on a.identity_key = b.identity_key and a.source_id is distinct from b.source_id and b.status in ('queued', 'running')),
o as (select job_id, created_at, case when status <> 'failed' then 'not_failed' when phase in ('queued', 'extracting') and attempts % 2 <> 0 then 'upload_gone' when job_id in (select job_id from held) and coalesce(duplicate_policy, 'reject') = 'reject' then 'identity_held' end no from j),
f as (select *, row_number() over (partition by no is null order by created_at, job_id) r from o)
select job_id, coalesce(no, case when r <= 7 then 'queued' else 'queue_full' end) outcome from f union all select 'no-such-job', 'unknown'""",
    "terminal_cleanup": f"with {_JOBS} select job_id, case status when 'succeeded' then 'drop_upload' else 'release_identity' end AS action, case status when 'succeeded' then upload_path else identity_key end AS target from j where (status = 'succeeded' and upload_path is not null) or (status = 'failed' and identity_key is not null)",
    "blank_sources": """with l as (select * from (select *, row_number() over (partition by source_id, page_number order by extracted_at desc) r from page_metadata) where r = 1)
select source_id, count(*) pages_total from l group by source_id having bool_and(coalesce(extraction_method = 'skipped', false))""",
    "blocked_jobs": f"""with {_JOBS}, {_MANIFESTS}, a as (select job_id, status, source_id, identity_key from j union all select job_id || '-again', 'queued', source_id || '_2', identity_key from j where status in ('succeeded', 'failed')),
h as (select job_id, source_id, identity_key from a where identity_key is not null and (status in ('queued', 'running') or (status = 'succeeded' and source_id in (select source_id from m))))
select a.job_id, min(h.job_id) blocked_by from a join h on a.identity_key = h.identity_key and a.source_id is distinct from h.source_id group by 1""",
    "expired_uploads": f"with {_JOBS}, r as (select job_id, upload_path, case when status = 'succeeded' then 'succeeded' when status = 'failed' and {NOW_S} - floor(epoch(finished_at)) >= 604800 then 'failed' end reason from j) select * from r where reason is not null",
    "orphan_uploads": f"with {_JOBS}, u as (select upload_path, job_id from j union all select upload_path || '.tmp', job_id from j where attempts = 1) select upload_path, job_id from u where upload_path not in (select upload_path from j where upload_path is not null) and job_id not in (select job_id from j where status = 'running')",
    "worker_health": f"with {_JOBS} select worker_id, count(*) jobs, floor(epoch(max(updated_at)))::bigint last_seen_s, {NOW_S} - floor(epoch(max(updated_at)))::bigint age_s, {NOW_S} - floor(epoch(max(updated_at)))::bigint <= 15 healthy from j where worker_id is not null group by 1",
    "queue_health": f"with {_JOBS}, c as (select count(*) filter (status = 'queued') queued, count(*) filter (status = 'running') running, count(*) filter (status = 'succeeded') succeeded, count(*) filter (status = 'failed') failed, count(*) filter (status = 'failed') reserved, (select count(distinct source_id) from source_manifests) sources from j) select *, queued + running + reserved active, queued + running + reserved < 20 has_room, case when queued + running + reserved < 20 then 'ok' else 'degraded' end state from c",
    "job_phases": f"with {_JOBS} select status, phase, case when status in ('queued', 'running') then case phase when 'queued' then 'extracting' when 'extracting' then 'embedding' when 'embedding' then 'indexing' when 'indexing' then 'done' end end next_phase, case when status in ('queued', 'running') then case when phase = 'queued' then 'extracting' when phase in ('extracting', 'embedding', 'indexing') then 'done' end end next_unindexed, case when phase in ('embedding', 'indexing') then phase else 'extracting' end resumed, count(*) jobs from j group by all",
    "event_activity": "select (floor(epoch(ts) / 3600) * 3600)::bigint hour_s, event_type, count(*) events, round(sum(value), 4) total from events group by 1, 2",
    "index_copy_check": f"""with {_live('chunk_index', 'embedding')}, copy as (select chunk_id, case when chunk_index % 11 = 0 then embedding[1:2] else embedding end v from live where chunk_index % 13 <> 0),
j as (select live.*, copy.chunk_id is null gone, embedding is distinct from v other from live left join copy using (chunk_id))
select (select count(*) from live) old_rows, (select count(*) from copy) new_rows, count(*) filter (gone) missing, count(*) filter (not gone and other) different, count(*) filter (gone or other) = 0 complete from j""",
    "layout_fallback": f"""with {_live('source_id', 'page_start', 'text')}, l as (select * from (select *, row_number() over (partition by source_id, page_number order by extracted_at desc) r from page_metadata where source_id is not null) where r = 1),
t as (select source_id, page_start page_number, min(text) plain from live where text is not null group by all), j as (select l.*, plain, case when extraction_method <> 'skipped' then upper(plain) end layout from l left join t using (source_id, page_number)),
e as (select *, coalesce(extraction_method = 'failed', false) bad, trim(coalesce(layout, ''), ' ') = '' no_text from j), b as (select *, coalesce(lag(bad) over (partition by source_id order by page_number), false) before from e)
select source_id, page_number, case when bad or no_text then 'pymupdf' else 'pymupdf4llm' end extraction_method, case when bad then 'layout_failed:RuntimeError' when no_text then 'layout_empty' else '' end flags, bad and before fatal, md5(coalesce(case when bad or no_text then plain else layout end, '')) text_md5 from b""",
    "page_routes": f"""with {_live('source_id', 'page_start', 'chunk_index', 'text')}, t as (select source_id, page_start page_number, {_strip("string_agg(" + _strip('text') + ", chr(10) order by chunk_index, text)")} || chr(10) AS text from live where text is not null and page_start is not null group by all),
documents as (select l.source_id AS source, page_number, image_path is not null has_images, image_path is not null or not coalesce(text_layer_detected, false) as sees, t.text from (select *, row_number() over (partition by source_id, page_number order by extracted_at desc) r from page_metadata) l left join t using (source_id, page_number) where r = 1 and l.source_id is not null and page_number is not null),
{_QUALITY}
select source source_id, page_number, usable, likely_true_text, case when is_true_text then 'text' when likely_true_text and not sees then 'text'
 when char_count > 0 and not has_images and len(list_filter(flags, lambda x: x <> 'too_few_chars')) = 0 then 'text' when char_count > 0 and not sees then 'text' when sees then 'ocr' else 'text' end route from p left join vote using (source)""",
    "publication_outcomes": f"with {_MANIFESTS} select source_id, case when length(source_id) % 2 <> 0 then 'new' when length(source_id) % 3 = 0 and content_sha256 is distinct from 'changed' then 'conflict' else 'same' end outcome from m",
}
