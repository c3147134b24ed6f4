"""Queries that SQL can express: each with its tables, its Spark SQL and its DuckDB SQL.

A query's name leads to (tables, Spark SQL, DuckDB SQL or None where one text serves both). Tables
appear as {name} in Spark's text.
"""

from __future__ import annotations


_KIND = "case when {h} = '' then 'unsupported' when {h} like '#%' then 'anchor' when {h} like 'file:%' then 'file' when {h} like 'http://%' or {h} like 'https://%' or {h} like '/%' then 'web' when {h} rlike '^[a-zA-Z][a-zA-Z0-9+.-]*:' then 'unsupported' else 'web' end"
_kind = _KIND.format(h="href")
_kind_d = _kind.replace("href rlike '^[a-zA-Z][a-zA-Z0-9+.-]*:'", "regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:')")
_LINKS_S = "(select page_id, url, pos as ord, href from {pages} lateral view posexplode(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) t as pos, href)"
_LINKS_D = "(select page_id, url, generate_subscripts(l, 1) - 1 as ord, unnest(l) as href from (select page_id, url, regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1) as l from pages))"
_LINES_S = "(select doc_id, pos as line, col as text from {documents} lateral view posexplode(split(text, '\\n')) t as pos, col)"
_LINES_D = "(select doc_id, generate_subscripts(l, 1) - 1 as line, unnest(l) as text from (select doc_id, string_split(text, chr(10)) as l from documents))"
_VISITS = "(select event_id as pos, concat('https://', event_type, '.example/', cast(user_id % 40 as string)) as url, if(user_id % 3 = 0, '', concat('T', cast(event_id % 7 as string))) as title, ts as visited, user_id from {events})"
_VISITS_D = "(select event_id as pos, 'https://' || event_type || '.example/' || (user_id % 40)::varchar as url, case when user_id % 3 = 0 then '' else 'T' || (event_id % 7)::varchar end as title, ts as visited, user_id from events)"
_AUTH = "split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1)"


def _terms(*words: str) -> str:
    return "(values " + ", ".join(f"('{w}')" for w in words) + ") as t(term)"


def _pair(spark: str, duck: str | None = None, *tables: str):
    return tables, spark, duck if duck is not None else spark


RELATIONAL: dict[str, tuple[tuple[str, ...], str, str]] = {
    "raw_links": _pair(f"select page_id, cast(ord as bigint) as ord, href, {_kind} as kind from {_LINKS_S}", f"select page_id, ord::bigint as ord, href, {_kind_d} as kind from {_LINKS_D}", "pages"),
    "link_kinds_by_host": _pair(f"select {_AUTH} as host, {_kind} as kind, count(*) as n from {_LINKS_S} group by 1, 2", f"select {_AUTH} as host, {_kind_d} as kind, count(*) as n from {_LINKS_D} group by 1, 2", "pages"),
    "distinct_links": _pair(
        f"select page_id, href, dense_rank() over (partition by page_id order by first_ord) as link_id, n from (select page_id, href, min(ord) as first_ord, count(*) as n from {_LINKS_S} group by page_id, href)",
        f"select page_id, href, dense_rank() over (partition by page_id order by first_ord)::int as link_id, n from (select page_id, href, min(ord) as first_ord, count(*) as n from {_LINKS_D} group by page_id, href)", "pages"),
    "page_titles": _pair(
        r"select page_id, replace(replace(replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as title from {pages}",
        r"select page_id, replace(replace(replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as title from pages", "pages"),
    "cache_keys": _pair("select page_id, substr(sha2(concat('1|', url), 256), 1, 32) as key from {pages}", "select page_id, substr(sha256('1|' || url), 1, 32) as key from pages", "pages"),
    "page_hosts": _pair(f"select {_AUTH} as host, count(*) as n, sum(length(html)) as chars from {{pages}} group by 1", f"select {_AUTH} as host, count(*) as n, sum(length(html))::bigint as chars from pages group by 1", "pages"),
    "dropped_tag_words": _pair(
        r"select page_id, cast(size(filter(split(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' '), '(?s)<(script|style|nav|footer)[^>]*>.*?</(script|style|nav|footer)>', ' '), '<[^>]*>', ' '), '[ \\n\\t\\r]+'), w -> w <> '')) as bigint) as words from {pages}",
        r"select page_id, len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<(script|style|nav|footer)[^>]*>.*?</(script|style|nav|footer)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \n\t\r]+'), lambda w: w <> ''))::bigint as words from pages", "pages"),
    "sanitize_text": _pair(
        r"select doc_id, regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f]', '') as clean from {documents}",
        r"select doc_id, regexp_replace(text, '[\x00-\x08\x0b-\x1f\x7f-\x{9f}]', '', 'g') as clean from documents", "documents"),
    "unicode_fields_count": _pair(
        r"select doc_id, cast(size(filter(split(text, '[\\s\\x85\\p{{Z}}]+'), t -> t <> '')) as bigint) as n from {documents}",
        r"select doc_id, len(list_filter(regexp_split_to_array(text, '[\s\v\x{85}\pZ]+'), lambda t: t <> ''))::bigint as n from documents", "documents"),
    "word_counts": _pair(
        r"select doc_id, cast(size(w) as bigint) as n_words, cast(size(array_distinct(w)) as bigint) as n_distinct from (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+', 0) as w from {documents})",
        r"select doc_id, len(w)::bigint as n_words, len(list_distinct(w))::bigint as n_distinct from (select doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') as w from documents)", "documents"),
    "line_explode": _pair(f"select doc_id, cast(line as bigint) as line, text from {_LINES_S}", f"select doc_id, line::bigint as line, text from {_LINES_D}", "documents"),
    "smart_case_search": _pair(
        f"select doc_id, cast(line as bigint) as line, q, cast(if(q rlike '\\\\p{{{{Lu}}}}', regexp_count(text, q), regexp_count(text, concat('(?iu)', q))) as bigint) as n from {_LINES_S} lateral view explode(array('the', 'The')) p as q where if(q rlike '\\\\p{{{{Lu}}}}', contains(text, q), contains(lower(text), q))",
        f"select doc_id, line::bigint as line, q, len(regexp_extract_all(text, case when q = 'The' then q else '(?i)' || q end))::bigint as n from {_LINES_D}, (values ('the'), ('The')) as p(q) where case when q = 'The' then contains(text, q) else contains(lower(text), q) end", "documents"),
    "contains_all_filter": _pair("select doc_id from {documents} where forall(split(lower('The ing on'), ' +'), w -> contains(lower(text), w))", "select doc_id from documents where contains(lower(text), 'the') and contains(lower(text), 'ing') and contains(lower(text), 'on')", "documents"),
    "ranked_search": _pair(
        "select doc_id, sum(least(12, n) + if(at_start, 2, 0) + if(in_title, 8, 0)) as score from (select doc_id, term, cast((length(b) - length(replace(b, term, ''))) / length(term) as bigint) as n, startswith(b, term) as at_start, contains(lower(source), term) as in_title from (select doc_id, source, lower(text) as b from {documents}) lateral view explode(array('the', 'ing', 'src1')) t as term) group by doc_id having bool_and(n > 0 or in_title) order by score desc, doc_id limit 24",
        "select doc_id, sum(least(12, n) + case when at_start then 2 else 0 end + case when in_title then 8 else 0 end)::bigint as score from (select doc_id, term, ((length(b) - length(replace(b, term, ''))) // length(term))::bigint as n, starts_with(b, term) as at_start, contains(lower(source), term) as in_title from (select doc_id, source, lower(text) as b from documents), " + _terms("the", "ing", "src1") + ") group by doc_id having bool_and(n > 0 or in_title) order by score desc, doc_id limit 24", "documents"),
    "snippets": _pair(
        "select doc_id, substr(text, greatest(1, locate('tion', text) - 73), 220) as snippet from {documents} where contains(text, 'tion')",
        "select doc_id, substr(text, greatest(1, instr(text, 'tion') - 73), 220) as snippet from documents where contains(text, 'tion')", "documents"),
    "passage_recall": _pair("select item_id, doc_id from {benchmark} b join {documents} d on contains(d.text, b.text)", "select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text)", "benchmark", "documents"),
    "repeated_lines": _pair(
        f"select doc_id, count(*) as n from (select doc_id, text, lag(text) over (partition by doc_id order by line) as before from {_LINES_S} where trim(text) <> '') where text = before and length(text) > 12 group by doc_id",
        f"select doc_id, count(*) as n from (select doc_id, text, lag(text) over (partition by doc_id order by line) as before from {_LINES_D} where trim(text) <> '') where text = before and length(text) > 12 group by doc_id", "documents"),
    "dedupe_adjacent_lines": _pair(
        f"select doc_id, cast(line as bigint) as line, text from (select *, lag(nullif(trim(text), '')) ignore nulls over (partition by doc_id order by line) as before from {_LINES_S}) where not (trim(text) <=> before)",
        f"select doc_id, line::bigint as line, text from (select *, lag(nullif(trim(text), '') ignore nulls) over (partition by doc_id order by line) as before from {_LINES_D}) where trim(text) is distinct from before", "documents"),
    "leak_counts": _pair(
        r"select doc_id, cast(regexp_count(text, '[#*%&$]{{3}}') as bigint) as junk, cast(regexp_count(text, '[0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}') as bigint) as ips, cast(regexp_count(text, '!!') as bigint) as shouts from {documents}",
        r"select doc_id, len(regexp_extract_all(text, '[#*%&$]{3}'))::bigint as junk, len(regexp_extract_all(text, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}'))::bigint as ips, len(regexp_extract_all(text, '!!'))::bigint as shouts from documents", "documents"),
    "lead_paragraph": _pair(
        f"select doc_id, if(length(lead) > 240, concat(rtrim(substr(lead, 1, 240)), '…'), lead) as lead from (select doc_id, min_by(trim(text), line) as lead from {_LINES_S} where length(trim(text)) > 3 and text not like '|%' group by doc_id)",
        f"select doc_id, case when length(lead) > 240 then rtrim(substr(lead, 1, 240)) || '…' else lead end as lead from (select doc_id, arg_min(trim(text), line) as lead from {_LINES_D} where length(trim(text)) > 3 and text not like '|%' group by doc_id)", "documents"),
    "history_latest_per_url": _pair(f"select url, title, pos from (select *, row_number() over (partition by url order by pos desc) as r from {_VISITS}) where r = 1", f"select url, title, pos from (select *, row_number() over (partition by url order by pos desc) as r from {_VISITS_D}) where r = 1", "events"),
    "history_collapse": _pair(
        f"select user_id, url, min(pos) as pos, min(visited) as visited, max_by(nullif(title, ''), if(title = '', null, pos)) as title, count(*) as n from (select *, sum(if(url <=> before, 0, 1)) over (partition by user_id order by pos) as island from (select *, lag(url) over (partition by user_id order by pos) as before from {_VISITS})) group by user_id, url, island",
        f"select user_id, url, min(pos) as pos, min(visited) as visited, arg_max(nullif(title, ''), case when title = '' then null else pos end) as title, count(*) as n from (select *, sum(case when url is not distinct from before then 0 else 1 end) over (partition by user_id order by pos) as island from (select *, lag(url) over (partition by user_id order by pos) as before from {_VISITS_D})) group by user_id, url, island", "events"),
    "history_limit_then_filter": _pair(f"select pos, url from (select * from {_VISITS} order by pos desc limit 50) where contains(url, 'click') or contains(title, 'click')", f"select pos, url from (select * from {_VISITS_D} order by pos desc limit 50) where contains(url, 'click') or contains(title, 'click')", "events"),
    "history_human_age": _pair(
        "select event_id, case when s < 60 then 'just now' when s < 3600 then concat(cast(s div 60 as string), ' min ago') when s < 172800 then concat(cast(s div 3600 as string), ' h ago') else concat(cast(s div 86400 as string), ' d ago') end as age from (select event_id, unix_timestamp(timestamp'2024-01-31 00:00:00') - unix_timestamp(ts) as s from {events})",
        "select event_id, case when s < 60 then 'just now' when s < 3600 then (s // 60)::varchar || ' min ago' when s < 172800 then (s // 3600)::varchar || ' h ago' else (s // 86400)::varchar || ' d ago' end as age from (select event_id, (epoch(timestamp '2024-01-31 00:00:00') - floor(epoch(ts)))::bigint as s from events)", "events"),
    "bookmarks_semi": _pair("select doc_id, source from {documents} d where exists (select 1 from {labels} l where l.doc_id = d.doc_id)", "select doc_id, source from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id)", "documents", "labels"),
    "history_anti": _pair("select doc_id, source from {documents} d where not exists (select 1 from {labels} l where l.doc_id = d.doc_id)", "select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)", "documents", "labels"),
    "omni_suggestions": _pair(
        # The best four marks and the best twelve visited ones are taken first: eight rows in all can't need more.
        f"with h as {_VISITS}, b as (select url, min(pos) as o from h where user_id < 3 group by url order by o desc, url limit 4), v as (select url, max(pos) as o from h group by url order by o desc, url limit 12), u as (select url, 1 as src, row_number() over (order by o desc) as r from b union all select url, 2 as src, row_number() over (order by o desc) as r from v) select url, src, cast(row_number() over (order by src, r) as bigint) as rank from (select url, min(src) as src, min_by(r, src) as r from u group by url) order by src, r limit 8",
        f"with h as {_VISITS_D}, b as (select distinct url, 1 as src, min(pos) over (partition by url) as o from h where user_id < 3), u as (select url, 1 as src, row_number() over (order by o desc) as r from b union all select url, 2 as src, row_number() over (order by max(pos) desc) as r from h group by url) select url, src, row_number() over (order by src, r) as rank from (select url, min(src) as src, arg_min(r, src) as r from u where src = 2 or r <= 4 group by url) order by src, r limit 8", "events"),
    "multi_click_runs": _pair(
        "select user_id, run, count(*) as clicks from (select user_id, sum(if(gap is null or gap > 45000000, 1, 0)) over (partition by user_id order by event_id) as run from (select user_id, event_id, unix_micros(cast(ts as timestamp)) - unix_micros(cast(lag(ts) over (partition by user_id order by event_id) as timestamp)) as gap from {events})) group by user_id, run",
        "select user_id, run::bigint as run, count(*) as clicks from (select user_id, sum(case when gap is null or gap > 45000000 then 1 else 0 end) over (partition by user_id order by event_id) as run from (select user_id, event_id, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by event_id)) as gap from events)) group by user_id, run", "events"),
    "next_event_asof": _pair(
        "select event_id, user_id, min(if(event_type = 'purchase', event_id, null)) over (partition by user_id order by event_id rows between current row and unbounded following) as next_id, max(if(event_type = 'purchase', event_id, null)) over (partition by user_id order by event_id rows between unbounded preceding and current row) as prev_id from {events}",
        "select e.event_id, e.user_id, n.event_id as next_id, p.event_id as prev_id from events e asof left join (select * from events where event_type = 'purchase') n on e.user_id = n.user_id and e.event_id <= n.event_id asof left join (select * from events where event_type = 'purchase') p on e.user_id = p.user_id and e.event_id >= p.event_id", "events"),
    "step_wrap": _pair(
        "select event_id, coalesce(lead(event_id) over w, first_value(event_id) over w) as next_id from {events} window w as (partition by user_id order by event_id)",
        "select event_id, coalesce(lead(event_id) over w, first_value(event_id) over w) as next_id from events window w as (partition by user_id order by event_id)", "events"),
    "keep_last_n": _pair("select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id desc) as r from {events}) where r <= 20", "select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r <= 20", "events"),
    "lru_recency_set": _pair(f"select user_id, url from (select user_id, url, row_number() over (partition by user_id order by max(pos) desc) as r from {_VISITS} group by user_id, url) where r <= 3", f"select user_id, url from (select user_id, url, row_number() over (partition by user_id order by max(pos) desc) as r from {_VISITS_D} group by user_id, url) where r <= 3", "events"),
    "category_report": _pair(
        "select lang, source, sum(n) as n, min(if(upto * 2 >= known, n_chars, null)) / 2D + min(if(upto * 2 > known, n_chars, null)) / 2D as mid, min(if(upto > known div 10, n_chars, null)) as p10, sum(if(n_chars < 50, n, 0)) as near_empty from (select *, sum(if(n_chars is null, 0, n)) over (partition by lang, source order by n_chars nulls first) as upto, sum(if(n_chars is null, 0, n)) over (partition by lang, source) as known from (select lang, source, n_chars, count(*) as n from {documents} group by lang, source, n_chars)) group by lang, source",
        "select lang, source, count(*) as n, median(n_chars)::double as mid, list_sort(list(n_chars))[count(n_chars) // 10 + 1] as p10, count(*) filter (n_chars < 50) as near_empty from documents group by lang, source", "documents"),
    "most_common": _pair("select source, count(*) as n from {documents} group by source order by n desc, source limit 5", "select source, count(*) as n from documents group by source order by n desc, source limit 5", "documents"),
    "worst_k": _pair("select doc_id, n_chars from {documents} where n_chars < 5000 order by n_chars, doc_id limit 25", "select doc_id, n_chars from documents where n_chars < 5000 order by n_chars, doc_id limit 25", "documents"),
    "bench_compare": _pair(
        "select coalesce(b.name, c.name) as name, case when b.ns is null or b.ns = 0 then 'NEW' when c.ns is null or c.ns = 0 then 'GONE' when c.ns > 1.25 * b.ns then 'REGRESSION' when c.ns < 0.75 * b.ns then 'faster' when c.ns > 1.1 * b.ns then 'warning' else 'ok' end as verdict from (select event_type as name, max(event_id) as ns from {events} where ts < timestamp '2024-01-10 00:00:00' group by event_type union all select 'left', 5) b full join (select event_type as name, max(event_id) as ns from {events} where ts >= timestamp '2024-01-10 00:00:00' group by event_type union all select 'come', 7) c on b.name = c.name",
        "select coalesce(b.name, c.name) as name, case when b.ns is null or b.ns = 0 then 'NEW' when c.ns is null or c.ns = 0 then 'GONE' when c.ns > 1.25 * b.ns then 'REGRESSION' when c.ns < 0.75 * b.ns then 'faster' when c.ns > 1.1 * b.ns then 'warning' else 'ok' end as verdict from (select event_type as name, max(event_id) as ns from events where ts < timestamp '2024-01-10 00:00:00' group by event_type union all select 'left', 5) b full join (select event_type as name, max(event_id) as ns from events where ts >= timestamp '2024-01-10 00:00:00' group by event_type union all select 'come', 7) c on b.name = c.name", "events"),
    "coverage_diff": _pair("select doc_id, 'missing' as side from (select doc_id from {documents} except select doc_id from {labels}) union all select doc_id, 'extra' as side from (select doc_id from {labels} except select doc_id from {documents})", "select doc_id, 'missing' as side from (select doc_id from documents except select doc_id from labels) union all select doc_id, 'extra' as side from (select doc_id from labels except select doc_id from documents)", "documents", "labels"),
    "search_url": _pair("select page_id, concat('https://search.example/?q=', replace(replace(url_encode(url), '*', '%2A'), '%7E', '~')) as target from {pages}", "select page_id, 'https://search.example/?q=' || replace(url_encode(url), '%20', '+') as target from pages", "pages"),
    "json_props": _pair("select event_id, cast(get_json_object(props, '$.k') as bigint) as k from {events}", "select event_id, json_extract_string(props, '$.k')::bigint as k from events", "events"),
    "cache_stats": _pair("select count(*) as entries, sum(length(html)) as size from {pages}", "select count(*) as entries, sum(length(html))::bigint as size from pages", "pages"),
    "turn_neighbours": _pair("select conv_id, turn, lag(turn) over w as before, lead(turn) over w as after from {conversations} window w as (partition by conv_id order by turn)", "select conv_id, turn, lag(turn) over w as before, lead(turn) over w as after from conversations window w as (partition by conv_id order by turn)", "conversations"),
    "status_hints": _pair(
        "select page_id, status, case when status in (401, 403) then 'refused' when status in (404, 410) then 'gone' when status = 429 then 'wait' when status = 451 then 'legal' when status >= 500 then 'failing' when status >= 400 then 'error' else '' end as hint from (select page_id, element_at(array(200, 301, 401, 403, 404, 408, 410, 418, 429, 451, 500, 503), cast(page_id % 12 as int) + 1) as status from {pages})",
        "select page_id, status, case when status in (401, 403) then 'refused' when status in (404, 410) then 'gone' when status = 429 then 'wait' when status = 451 then 'legal' when status >= 500 then 'failing' when status >= 400 then 'error' else '' end as hint from (select page_id, ([200, 301, 401, 403, 404, 408, 410, 418, 429, 451, 500, 503])[(page_id % 12)::int + 1] as status from pages)", "pages"),
    "error_page_titles": _pair(
        r"select page_id, if(length(t) > 60, concat(substr(t, 1, 60), '…'), t) as title from (select page_id, trim(regexp_replace(regexp_extract(substr(html, 1, 65536), '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n\\r]+', ' ')) as t from {pages})",
        r"select page_id, case when length(t) > 60 then substr(t, 1, 60) || '…' else t end as title from (select page_id, trim(regexp_replace(regexp_extract(substr(html, 1, 65536), '(?is)<title[^>]*>(.*?)</title>', 1), '[ \t\n\r]+', ' ', 'g')) as t from pages)", "pages"),
}
