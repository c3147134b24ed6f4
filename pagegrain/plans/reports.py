"""Further queries with SQL twins: key tables, reports, samples, spans, runs. Same form as RELATIONAL."""

from __future__ import annotations

from .relational import _LINES_D, _LINES_S, _VISITS, _VISITS_D, _pair

_SLUG_S = r"regexp_replace(regexp_replace(regexp_replace(lower(text), '[ _-]+', '-'), '[^\\p{{L}}\\p{{Nd}}-]', ''), '-+$', '')"
_SLUG_D = r"regexp_replace(regexp_replace(regexp_replace(lower(text), '[ _-]+', '-', 'g'), '[^\pL\p{Nd}-]', '', 'g'), '-+$', '')"
_ELEMENTS = ("p", "a", "li", "h1", "b", "br", "div", "script", "article")

REPORTS = {
    "section_anchors": _pair(
        f"select doc_id, min(line) as line from (select doc_id, cast(line as bigint) as line, {_SLUG_S} as slug, last_value({_SLUG_S}) over (partition by doc_id order by line rows between unbounded preceding and unbounded following) as wanted from {_LINES_S}) where slug = wanted group by doc_id",
        f"select doc_id, min(line) as line from (select doc_id, line::bigint as line, {_SLUG_D} as slug, last_value({_SLUG_D}) over (partition by doc_id order by line rows between unbounded preceding and unbounded following) as wanted from {_LINES_D}) where slug = wanted group by doc_id", "documents"),
    "point_in_span": _pair(
        f"select c.doc_id, c.at, s.line from (select doc_id, cast(length(text) div 2 as bigint) as at from {{documents}}) c join (select doc_id, cast(line as bigint) as line, sum(length(text) + 1) over w - length(text) - 1 as start, sum(length(text) + 1) over w as stop from {_LINES_S} window w as (partition by doc_id order by line)) s on c.doc_id = s.doc_id and s.start <= c.at and c.at < s.stop",
        f"select c.doc_id, c.at, s.line from (select doc_id, (length(text) // 2)::bigint as at from documents) c join (select doc_id, line::bigint as line, sum(length(text) + 1) over w - length(text) - 1 as start, sum(length(text) + 1) over w as stop from {_LINES_D} window w as (partition by doc_id order by line)) s on c.doc_id = s.doc_id and s.start <= c.at and c.at < s.stop", "documents"),
    "preferred_event": _pair(
        "select user_id, min_by(event_id, named_struct('p', case event_type when 'purchase' then 1 when 'signup' then 2 else 3 end, 'e', event_id)) as event_id from {events} group by user_id",
        "select user_id, arg_min(event_id, case event_type when 'purchase' then 1 when 'signup' then 2 else 3 end * 1000000000000 + event_id) as event_id from events group by user_id", "events"),
    "sampled_sentences": _pair(
        r"select doc_id, posexplode(transform(sequence(0, least(40, n) - 1), i -> s[cast(floor(i * n / least(40, n)) as int)])) as (ord, sentence) from (select doc_id, s, size(s) as n from (select doc_id, filter(split(text, '[.!?][ \\n]+'), x -> length(x) >= 50) as s from {documents})) where n > 0",
        r"select doc_id, (unnest(range(least(40, n))))::int as ord, unnest([s[(floor(i * n / least(40, n)))::int + 1] for i in range(least(40, n))]) as sentence from (select doc_id, s, len(s) as n from (select doc_id, list_filter(regexp_split_to_array(text, '[.!?][ \n]+'), lambda x: length(x) >= 50) as s from documents)) where n > 0", "documents"),
    "rows_around": _pair("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as r, count(*) over (partition by user_id) as n from {events}) where r between n div 2 - 5 and n div 2 + 5", "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as r, count(*) over (partition by user_id) as n from events) where r between n // 2 - 5 and n // 2 + 5", "events"),
    "strip_ansi": _pair(
        r"select doc_id, md5(regexp_replace(concat('\u001b[1;31m', text, '\u001b[0m\u001b]8;;x\u0007'), '\\x1b(\\[[0-9;?]*[ -/]*[@-~]|\\][^\\x07\\x1b]*(\\x07|\\x1b\\\\))', '')) as digest from {documents}",
        "select doc_id, md5(text) as digest from documents", "documents"),
    "marked_terms": _pair("select doc_id, md5(regexp_replace(text, '(?i)(the|on)', '<mark>$1</mark>')) as digest from {documents}", r"select doc_id, md5(regexp_replace(text, '(?i)(the|on)', '<mark>\1</mark>', 'g')) as digest from documents", "documents"),
    "page_find": _pair("select doc_id, cast(regexp_count(lower(text), 'the') as bigint) as n from {documents}", "select doc_id, len(regexp_extract_all(lower(text), 'the'))::bigint as n from documents", "documents"),
    "panel_filter": _pair(f"select pos, url from {_VISITS} where contains(lower(concat_ws(' ', title, url)), 't3 https://c')", f"select pos, url from {_VISITS_D} where contains(lower(concat_ws(' ', title, url)), 't3 https://c')", "events"),
    "scenario_report": _pair(
        "select event_type, count(*) as scenarios, count_if(ok) as passed, sum(steps) as steps, bool_and(ok) as all_ok from (select user_id, event_type, count(*) as steps, bool_and(value >= 1) as ok from {events} group by user_id, event_type) group by event_type",
        "select event_type, count(*) as scenarios, count(*) filter (ok) as passed, sum(steps)::bigint as steps, bool_and(ok) as all_ok from (select user_id, event_type, count(*) as steps, bool_and(value >= 1) as ok from events group by user_id, event_type) group by event_type", "events"),
    "media_manifest": _pair(
        "select count(*) as files, sum(coalesce(size, 0)) as total from (select user_id, max_by(try_cast(get_json_object(props, '$.k') as bigint), event_id) as size from {events} group by user_id)",
        "select count(*) as files, sum(coalesce(size, 0))::bigint as total from (select user_id, arg_max(coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0), event_id) as size from events group by user_id)", "events"),
    "merged_runs": _pair(
        "select user_id, event_type, min(event_id) as first_id, max(event_id) as last_id, count(*) as n from (select *, sum(if(event_type <=> before, 0, 1)) over (partition by user_id order by event_id) as run from (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by event_id) as before from {events})) group by user_id, event_type, run",
        "select user_id, event_type, min(event_id) as first_id, max(event_id) as last_id, count(*) as n from (select *, sum(case when event_type is not distinct from before then 0 else 1 end) over (partition by user_id order by event_id) as run from (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by event_id) as before from events)) group by user_id, event_type, run", "events"),
    "rejoined_lines": _pair(
        "select conv_id, min(turn) as turn, array_join(transform(array_sort(collect_list(struct(turn, text))), x -> x.text), ' ') as text from (select *, turn div 2 as part from {conversations}) group by conv_id, part",
        "select conv_id, min(turn) as turn, string_agg(text, ' ' order by turn, text) as text from (select *, turn // 2 as part from conversations) group by conv_id, part", "conversations"),
    "trimmed_history": _pair(
        "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) as r, count(*) over (partition by user_id) as n from {events}) where r <= if(n <= 20, n, 10 + (n - 21) % 11)",
        "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) as r, count(*) over (partition by user_id) as n from events) where r <= case when n <= 20 then n else 10 + (n - 21) % 11 end", "events"),
    "element_counts": _pair(
        "select page_id, " + ", ".join(f"cast(regexp_count(html, '<{e}[ >]') as bigint) as n_{e}" for e in _ELEMENTS) + " from {pages}",
        "select page_id, " + ", ".join(f"len(regexp_extract_all(html, '<{e}[ >]'))::bigint as n_{e}" for e in _ELEMENTS) + " from pages", "pages"),
    "turn_overlap": _pair(
        r"select conv_id, turn, cast(size(array_intersect(w, before)) as bigint) as both, cast(size(array_union(w, before)) as bigint) as either from (select conv_id, turn, w, lag(w) over (partition by conv_id order by turn) as before from (select conv_id, turn, array_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+', 0)) as w from {conversations})) where before is not null",
        r"select conv_id, turn, len(list_intersect(w, before))::bigint as both, len(list_distinct(list_concat(w, before)))::bigint as either from (select conv_id, turn, w, lag(w) over (partition by conv_id order by turn) as before from (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\pL\pN]+')) as w from conversations)) where before is not null", "conversations"),
    "start_page": _pair(
        f"(select 'bookmark' as src, url, pos from (select url, min(pos) as pos from {_VISITS} where title = '' group by url) order by pos limit 12) union all (select 'recent' as src, url, pos from (select url, max(pos) as pos from {_VISITS} group by url) order by pos desc limit 15)",
        f"(select 'bookmark' as src, url, pos from (select url, min(pos) as pos from {_VISITS_D} where title = '' group by url) order by pos limit 12) union all (select 'recent' as src, url, pos from (select url, max(pos) as pos from {_VISITS_D} group by url) order by pos desc limit 15)", "events"),
    "document_size": _pair(f"select doc_id, sum(octet_length(text) + 24) as size from {_LINES_S} group by doc_id", f"select doc_id, sum(strlen(text) + 24)::bigint as size from {_LINES_D} group by doc_id", "documents"),
}
