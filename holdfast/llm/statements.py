"""DuckDB statements for the queries that SQL can express, written from the raw tables."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
with d as (select doc_id, {_LOWER.format("coalesce(text, '')")} as body from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, sha256(body) as text_sha256
from d window g as (partition by body)
"""

_HOST = _LOWER.format("coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), '')")
_PATH = "coalesce(regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_KEY = f"""case when contains({{0}}, '://') then {_HOST} || regexp_extract({{0}}, '(?s)^.*?://[^/?#]*([^#]*)', 1) end"""

_UNSEEN = r"(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script|$)|<style\b.*?(?:</style|$)|<template\b.*?(?:</template|$)"
_TAGS = r"""(?is)<(?:link|meta)[\s/](?:[^>"'']|"[^"]*"|''[^'']*'')*>"""
_ATTRIBUTE = r"""([^\s"''<>/=]+)(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+))?"""
_REFRESH = r"""(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["'']?([^"'']*)"""
#: A path without the steps . and .., which go from the left; the query stays.
_STEPS = "string_split(substr(regexp_extract({0}, '(?s)^([^?#]*)', 1), 2), '/')"
_NO_DOTS = f"""case when regexp_matches({{0}}, '^[^?#]*/[.][.]?(/|[?#]|$)') then '/' || array_to_string(list_reduce(
    list_prepend([]::varchar[], list_transform({_STEPS}, lambda x: [x])), lambda d, x: case
      when x[1] = '..' then d[1:len(d) - 1] when x[1] = '.' then d else d || x end), '/')
    || case when regexp_matches({{0}}, '^[^?#]*/[.][.]?([?#]|$)') then '/' else '' end
    || regexp_extract({{0}}, '(?s)^[^?#]*(.*)', 1) else {{0}} end"""

OP2 = f"""
with recursive rules(verdict, rule, name, start) as (
  values ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
         ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'),
         ('block', 'com/de/', 'com', '/de/')),
tags as (
  select url, unnest(regexp_extract_all(regexp_replace(html, '{_UNSEEN}', '', 'g'), '{_TAGS}', 0)) as tag from pages),
parsed as (
  select url, list_transform(regexp_extract_all(tag, '{_ATTRIBUTE}', 1), lambda x: lower(x)) as names,
         list_transform(regexp_extract_all(tag, '{_ATTRIBUTE}', 2),
           lambda x: replace(trim(regexp_replace(x, '^["'']|["'']$', '', 'g'), e' \t\r\n'), '&amp;', '&')) as vals from tags),
named as (
  select url, case
    when names[1] = 'link' and list_contains(regexp_split_to_array(lower(coalesce(vals[list_position(names, 'rel')], '')), '\\s+'), 'canonical')
      then vals[list_position(names, 'href')]
    when names[1] = 'meta' and lower(vals[list_position(names, 'http-equiv')]) = 'refresh'
      then trim(regexp_extract(vals[list_position(names, 'content')], '{_REFRESH}', 1)) end as target from parsed),
placed as (
  select url, target, regexp_extract(url, '(?s)^(.*?)://', 1) as scheme, {_HOST.format("url")} as host,
         case when {_PATH.format("url")} = '' then '/' else {_PATH.format("url")} end as path,
         regexp_extract(url, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1) as query from named where target <> ''),
linked as (
  select url, case
    when regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') then target
    when regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') then null
    when starts_with(target, '//') then scheme || ':' || target
    when starts_with(target, '/') then scheme || '://' || host || {_NO_DOTS.format("target")}
    when starts_with(target, '?') then scheme || '://' || host || path || target
    when starts_with(target, '#') then scheme || '://' || host || path || query
    else scheme || '://' || host || {_NO_DOTS.format("(regexp_extract(path, '(?s)^(.*/)', 1) || target)")} end as target from placed),
edges as (select {_KEY.format("url")} as a, {_KEY.format("target")} as b from linked where target <> ''),
ways as (select a, b from edges where a <> b union select b, a from edges where a <> b),
reach(a, b) as (select a, a from ways union select reach.a, ways.b from reach join ways on reach.b = ways.a),
urls as (select url from pages union select target from linked where target <> ''),
judged as (
  select url, {_KEY.format("url")} as node, {_HOST.format("url")} as host, {_PATH.format("url")} as path from urls),
best as (
  select url, rule, verdict from (
    select j.url, r.rule, r.verdict, row_number() over (partition by j.url order by length(r.rule) desc, r.verdict) as n
    from judged j join rules r on (j.host = r.name or ends_with(j.host, '.' || r.name)) and starts_with(j.path, r.start))
  where n = 1),
said as (select j.node, b.verdict from judged j join best b on j.url = b.url),
passed as (select r.a as node, min(s.verdict) as verdict from reach r join said s on s.node = r.b group by 1)
select p.page_id, {_HOST.format("p.url")} as host, {_PATH.format("p.url")} as path, b.rule,
       coalesce(b.verdict, x.verdict, 'allow') as verdict
from pages p left join best b on b.url = p.url left join passed x on x.node = {_KEY.format("p.url")}
"""

OP4 = f"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from l),
c as (select key, max(doc_id) as holder from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select k.*, c.key is not null and k.doc_id <> c.holder as gone from k left join c on k.key = c.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""

_UNIFORM = "('0x' || substr(md5({0}), 1, 13))::bigint"

OP3 = f"""
with recursive counts as (
  select coalesce(source, '') as src, count(*) as n,
         case coalesce(source, '') when 'src0' then 2.0 when 'src1' then 4.0 when 'src2' then 0.5 when 'src3' then 1.5
         else 1.0 end::double as weight
  from documents group by 1, 3),
rates as (select src, weight / sum(weight) over () * sum(n) over () / n as mean from counts),
cdf(src, k, p, c, mean) as (
  select src, 0, exp(-mean), exp(-mean), mean from rates
  union all select src, k + 1, p * mean / (k + 1), c + p * mean / (k + 1), mean from cdf where k < mean + 12 * sqrt(mean) + 40),
drawn as (select *, {_UNIFORM.format("'20250301:' || coalesce(doc_id::varchar, '') || ':1'")}::double / 4503599627370496.0 as u
          from documents),
counted as (
  select d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) as times
  from drawn d join cdf on cdf.src = coalesce(d.source, '') and cdf.c <= d.u group by all)
select doc_id, text, lang, source, n_chars, copy,
       {_UNIFORM.format("'20250301:turn:' || coalesce(doc_id::varchar, '') || ':' || copy")} as mix_key
from (select *, unnest(generate_series(1, times))::int as copy from counted)
"""

_VECTORS = """select vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0"""

OP8 = f"""
with v as ({_VECTORS}),
pairs as (select q.vec_id as query_id, c.vec_id, list_distance(q.v, c.v) as score
          from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0)
select query_id, row_number() over (partition by query_id order by score, vec_id)::int as rank, vec_id, score
from pairs qualify rank <= 10
"""

_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP12 = f"""
with d as (select doc_id, {_TERMS.format("text")} as own from documents where text is not null),
held as (select doc_id, term, count(*) as tf from (select doc_id, unnest(own) as term from d) group by all),
sizes as (select doc_id, len(own)::bigint as n from d where len(own) > 0),
total as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from sizes),
asked as (select distinct item_id, unnest({_TERMS.format("text")}) as term from benchmark),
weights as (
  select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)))::bigint as w
  from held, total group by term),
norms as (select doc_id, 100 - 90 + ((90 * n * n_docs) // n_terms) as m from sizes, total),
scores as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from asked join weights using (term) join held using (term) join norms using (doc_id) group by all)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from scores where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10
"""

ORACLES: dict[str, str] = {
    "op1_exact_dedup": OP1,
    "op2_url_filters": OP2,
    "op3_mix_sources": OP3,
    "op4_line_dedup": OP4,
    "op8_neighbours": OP8,
    "op12_lexical_search": OP12,
}
