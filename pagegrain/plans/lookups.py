"""Versions, sizes, hosts, labels, keys, headers, checksums and settings, on values that the tables give, with DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import lookups as L
from ..functions import text as T
from ..operators import markdown
from ..sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        name = f.__name__.removeprefix("q_")
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bindings: a user's actions are the kinds of their events, a key is a letter by the event's number, in the order of first use.
_BOUND = "select user_id as owner, event_type as action, substr('abcdefghijklmnopqrstuvwxyz', cast(event_id % 26 as int) + 1, 1) as key, min(event_id) as ord from events group by 1, 2, 3"


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    key = F.expr("substr('abcdefghijklmnopqrstuvwxyz', cast(event_id % 26 as int) + 1, 1)")
    return events.groupBy(F.col("user_id").alias("owner"), F.col("event_type").alias("action"), key.alias("key")).agg(F.min("event_id").alias("ord"))


@query(f"select owner, key, arg_min(action, ord) as action, count(*) as n from ({_BOUND}) group by owner, key")
def q_key_conflicts(spark, sf_dir):
    """A key's action is the one that came first; n says how many want it."""
    return _bound(spark, sf_dir).groupBy("owner", "key").agg(F.min_by("action", "ord").alias("action"), F.count("*").alias("n"))


@query(f"""with b as ({_BOUND}), d as (select owner, action, string_agg(key, ' ' order by key) as keys from b group by 1, 2), o as (select owner, action, coalesce(string_agg(key, ' ' order by key) filter (key > 'm'), '') as keys from b where ord % 3 = 0 group by 1, 2)
select d.owner, d.action, coalesce(o.keys, d.keys) as keys, coalesce(o.keys = '', false) as unbound from d left join o on d.owner = o.owner and d.action = o.action""")
def q_effective_keys(spark, sf_dir):
    """Defaults, and a person's own keys over them; an empty list of one's own unbinds."""
    bound = _bound(spark, sf_dir)
    default = bound.groupBy("owner", "action").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    own = bound.where("ord % 3 = 0").groupBy("owner", "action").agg(F.sort_array(F.collect_list(F.when(F.col("key") > "m", F.col("key")))).alias("own"))
    both = default.join(own, ["owner", "action"], "left")
    return both.select("owner", "action", F.array_join(F.coalesce("own", "keys"), " ").alias("keys"), F.coalesce(F.size("own") == 0, F.lit(False)).alias("unbound"))


@query(f"""with b as ({_BOUND}), t as (select owner, arg_min(key, ord) as key from b where action = 'purchase' group by owner)
select b.owner, b.action, case when b.action = 'signup' and t.key is not null then t.key else coalesce(string_agg(b.key, ' ' order by b.key) filter (t.key is null or b.key <> t.key), '') end as keys from b left join t on b.owner = t.owner group by b.owner, b.action, t.key""")
def q_rebound_keys(spark, sf_dir):
    """A person's first purchase key goes to signup, which then has it alone, and leaves all other actions."""
    bound = _bound(spark, sf_dir)
    taken = bound.where("action = 'purchase'").groupBy("owner").agg(F.min_by("key", "ord").alias("taken"))
    held = bound.groupBy("owner", "action").agg(F.sort_array(F.collect_list("key")).alias("keys")).join(taken, "owner", "left")
    rest = F.when(F.col("taken").isNull(), F.col("keys")).otherwise(F.array_except("keys", F.array("taken")))
    keys = F.when((F.col("action") == "signup") & F.col("taken").isNotNull(), F.array("taken")).otherwise(rest)
    return held.select("owner", "action", F.array_join(keys, " ").alias("keys"))


_TAG = "case when event_id % 11 = 0 then 'dev' else {v} || ((event_id // {a}) % 3)::varchar || '.' || ((event_id // {b}) % 4)::varchar || case when event_id % {c} = 0 then '' else '.' || ((event_id // 5) % 3)::varchar end || case when event_id % {d} = 0 then '-rc1' else '' end end"


@query(f"""with t as (select event_id, {_TAG.format(v="'v'", a=7, b=3, c=6, d=9)} as latest, {_TAG.format(v="''", a=2, b=13, c=5, d=7)} as current from events),
v as (select *, string_split(string_split(replace(latest, 'v', ''), '-')[1], '.') as a, string_split(string_split(current, '-')[1], '.') as b, contains(latest, '-') as ap, contains(current, '-') as bp, latest <> 'dev' as known from t),
n as (select *, case when known then a[1]::int * 10000 + a[2]::int * 100 + coalesce(a[3], '0')::int end as x, case when known then b[1]::int * 10000 + b[2]::int * 100 + coalesce(b[3], '0')::int end as y from v)
select event_id, latest, current, coalesce(not ap and (x > y or (x = y and bp)), false) as newer, coalesce(not ap and not bp and x = y, false) as same from n""")
def q_semver_order(spark, sf_dir):
    tag = lambda **k: F.expr(_TAG.format(**k).replace("//", "div").replace("::varchar", ""))
    rows = _table(spark, sf_dir, "events").select("event_id", tag(v="'v'", a=7, b=3, c=6, d=9).alias("latest"), tag(v="''", a=2, b=13, c=5, d=7).alias("current"))
    return rows.select("event_id", "latest", "current", L.newer(F.col("latest"), F.col("current")).alias("newer"), L.same_version(F.col("latest"), F.col("current")).alias("same"))


@query("with s as (select doc_id, (octet_length(encode(coalesce(text, ''))) * (doc_id % 400))::bigint as n from documents) select doc_id, case when n < 1024 then n::varchar || ' B' when n < 1048576 then printf('%.1f KB', n / 1024.0::double) else printf('%.1f MB', n / 1048576.0::double) end as size from s")
def q_human_size(spark, sf_dir):
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") * (F.col("doc_id") % 400)
    return _table(spark, sf_dir, "documents").select("doc_id", L.human_size(n).alias("size"))


#: What might be typed, from pages' addresses: hosts with ports, paths and ends, names of one's own network, addresses, words.
_TYPED = """case page_id % 12 when 0 then host when 1 then host || ':8080/x?y' when 2 then 'localhost:' || page_id when 3 then replace(host, '.', ' ') when 4 then replace(host, '.', '') when 5 then '.' || host when 6 then host || '.'
 when 7 then '10.0.' || (page_id % 300) || '.7' when 8 then '172.' || (page_id % 40) || '.1.1' when 9 then replace(host, '.com', '.local') when 10 then host || ':8x' else '  https://' || host || '/ ' end"""
_HOST_D = f"(select page_id, {_TYPED} as input from (select page_id, split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1) as host from pages))"
_HOST_RULES = r"""p as (select *, regexp_extract(trim(input), '^([^/?#]*)', 1) as auth from i),
k as (select *, not regexp_matches(trim(input), '[ \t]') and (regexp_matches(auth, '(?i)^localhost(:.*)?$') or regexp_matches(auth, '^[\pL\p{Nd}-][\pL\p{Nd}.-]*\.([\pL\p{Nd}.-]*[\pL\p{Nd}-])(:[0-9]*)?$')) as host, lower(split_part(auth, ':', 1)) as name from p),
o as (select *, regexp_matches(name, '^(localhost|.*\.local)$') or (regexp_matches(name, '^10\.[0-9]+\.[0-9]+\.[0-9]+$') and coalesce(try_cast(split_part(name, '.', 3) as int) < 256, false)) or (regexp_matches(name, '^172\.[0-9]+\.1\.1$') and coalesce(try_cast(split_part(name, '.', 2) as int) between 16 and 31, false)) as own from k)"""


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1)
    return _table(spark, sf_dir, "pages").select("page_id", host.alias("host")).select("page_id", F.expr(_TYPED).alias("input"))


@query(f"with i as {_HOST_D}, {_HOST_RULES} select page_id, input, host, own as local from o")
def q_looks_like_host(spark, sf_dir):
    bare = F.trim("input")
    return _typed(spark, sf_dir).select("page_id", "input", T.looks_like_host(bare).alias("host"), T.is_local_host(bare).alias("local"))


@query(f"""with i as {_HOST_D}, {_HOST_RULES} select page_id, case when regexp_matches(trim(input), '^(https?|file)://') then trim(input) when host then case when own then 'http://' else 'https://' end || trim(input)
 else 'https://html.duckduckgo.com/html/?q=' || replace(url_encode(trim(input)), '%20', '+') end as target, not regexp_matches(trim(input), '^(https?|file)://') and not host as is_search from o""")
def q_typed_addresses(spark, sf_dir):
    return _typed(spark, sf_dir).select("page_id", T.resolved_input(F.col("input")).alias("r")).select("page_id", "r.target", "r.is_search")


@query("""with n as (select doc_id, len(string_split(coalesce(text, ''), chr(10))) * (doc_id % 7) as n from documents), e as (select doc_id, n, unnest(range(least(n, 81)))::int as ord from n)
select doc_id, ord, case when n <= 9 then substr('asdfghjkl', ord + 1, 1) else substr('asdfghjkl', ord // 9 + 1, 1) || substr('asdfghjkl', ord % 9 + 1, 1) end as label from e""")
def q_hint_labels(spark, sf_dir):
    """Labels of as many links as a document has lines, times its number's rest by 7."""
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n")) * (F.col("doc_id") % 7).cast("int")
    return _table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).select("doc_id", F.posexplode(L.hint_labels(F.col("n"))).alias("ord", "label"))


_LOCALE = "case doc_id % 6 when 0 then lang when 1 then concat(coalesce(lang, ''), '_', upper(coalesce(lang, ''))) when 2 then concat(coalesce(lang, ''), '_XX.UTF-8') when 3 then 'C' when 4 then '' else 'POSIX' end"


@query(f"""with l as (select doc_id, {_LOCALE} as locale, split_part(coalesce(locale, ''), '.', 1) as b from documents)
select doc_id, case when b in ('', 'C', 'POSIX') or split_part(b, '_', 1) = 'en' then 'en' when contains(b, '_') then replace(b, '_', '-') || ', ' || split_part(b, '_', 1) || ';q=0.9, en;q=0.6' else b || ', en;q=0.6' end as header from l""")
def q_accept_language(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.expr(_LOCALE).alias("locale"))
    return rows.select("doc_id", L.accept_language(F.col("locale")).alias("header"))


#: A source's checksum file: a line a document, digests in capitals for some, names with a star for others, some lines broken; some digests of another text.
@query("""with d as (select doc_id, coalesce(source, '') as source, md5(coalesce(text, '')) as own from documents)
select doc_id, case when doc_id % 10 = 9 then '' else lower(case when doc_id % 8 = 3 then md5(own) else own end) end as digest, doc_id % 10 <> 9 and doc_id % 8 <> 3 as matches from d""")
def q_checksum_of(spark, sf_dir):
    """Each document's digest looked up by name in its source's list of fifty documents, and held against its text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.expr("doc_id div 50").alias("part"), F.md5(F.coalesce("text", F.lit(""))).alias("own"))
    said = F.when(F.col("doc_id") % 8 == 3, F.md5("own")).otherwise(F.col("own"))
    said = F.when(F.col("doc_id") % 2 == 0, F.upper(said)).otherwise(said)
    name = F.concat(F.lit("tool_"), F.col("doc_id").cast("string"), F.lit(".tar.gz"))
    line = F.when(F.col("doc_id") % 10 == 9, F.concat(said, F.lit("  "), name, F.lit(" extra"))).otherwise(F.concat(said, F.when(F.col("doc_id") % 3 == 0, " *").otherwise("  "), name))
    sums = docs.groupBy("source", "part").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("sums"))
    found = docs.join(sums, ["source", "part"]).select("doc_id", "own", L.checksum_for(F.col("sums"), name).alias("digest"))
    return found.select("doc_id", "digest", (F.col("digest") == F.col("own")).alias("matches"))


#: Settings files: of each user the last value for a name by the event's number; kinds and ranges are wrong for some.
_NAMES = ("width", "spacing", "wheel_lines", "cache_days", "history_limit", "links", "footer_progress", "scroll_speed", "accent", "search_engine", "center", "mouse", "other")
_SETTING_D = f"""select user_id, ([{", ".join(f"'{n}'" for n in _NAMES)}])[(event_id % 13)::int + 1] as name, case event_id // 13 % 6 when 0 then (event_id % 600)::varchar when 1 then '-3' when 2 then '"' || (['inline', 'bar', 'fast', 'teal', 'github', 'https://x/?q=%s', 'none'])[(event_id % 7)::int + 1] || '"' when 3 then 'true' when 4 then '0' else '"hidden"' end as value from events"""
_RANGE_SQL = " ".join(f"when name = '{k}' and n is not null then {'case when n = 0 then 0 else ' * (k == 'width')}least(greatest(n, {lo}), {hi}){' end' * (k == 'width')}::varchar" for k, (lo, hi) in L.RANGES.items())
_CHOICE_SQL = " ".join(f"""when name = '{k}' and w in ({", ".join(f"'{x}'" for x in v)}) then said""" for k, v in L.CHOICES.items())
_DEFAULT_SQL = ", ".join(f"('{k}', '{L._json(v)}')" for k, v in L.DEFAULTS.items())


@query(rf"""with r as ({_SETTING_D}), s as (select user_id, name, max(value) as said from r group by 1, 2), e as (select user_id, name, d from (select distinct user_id from r), (values {_DEFAULT_SQL}) as v(name, d)),
b as (select e.*, said, case when regexp_matches(said, '^-?[0-9]+$') then said::int end as n, case when starts_with(said, '"') then replace(said, '"', '') end as w from e left join s on e.user_id = s.user_id and e.name = s.name)
select user_id, name, coalesce(case {_RANGE_SQL} {_CHOICE_SQL} when name = 'search_engine' and (w in ('duckduckgo', 'wikipedia', 'github') or contains(w, '%s')) then said when name in ('center', 'mouse', 'history') and said in ('true', 'false') then said end, d) as value from b""")
def q_tool_config(spark, sf_dir):
    """Users' settings over defaults: numbers held in their range, words that aren't a setting's, and values of another kind, left out."""
    names = ", ".join(f"'{n}'" for n in _NAMES)
    value = """case event_id div 13 % 6 when 0 then cast(event_id % 600 as string) when 1 then '-3' when 2 then concat('"', array('inline', 'bar', 'fast', 'teal', 'github', 'https://x/?q=%s', 'none')[cast(event_id % 7 as int)], '"') when 3 then 'true' when 4 then '0' else '"hidden"' end"""
    rows = _table(spark, sf_dir, "events").select("user_id", F.expr(f"array({names})[cast(event_id % 13 as int)]").alias("name"), F.expr(value).alias("value"))
    return L.normalised_settings(rows, ["user_id"])


@query("select event_id as pos, 'https://' || event_type || '.example/' || (user_id % 40)::varchar as url from events where event_id % 4 = 0")
def q_tool_history_clear(spark, sf_dir):
    """A history that is cleared, and what is visited after it."""
    visits = _table(spark, sf_dir, "events").selectExpr("event_id pos", "concat('https://', event_type, '.example/', cast(user_id % 40 as string)) url")
    return Engine(spark).clear(visits.where("pos % 4 <> 0")).unionByName(visits.where("pos % 4 = 0"))


@query(r"select doc_id, rtrim(regexp_replace(regexp_replace(lower(string_split(coalesce(text, ''), chr(10))[1]), '[ _-]+', '-', 'g'), '[^\pL\p{Nd}-]', '', 'g'), '-') as slug from documents")
def q_slugify(spark, sf_dir):
    """The whole first line."""
    line = F.split(F.coalesce("text", F.lit("")), "\n")[0]
    slug = F.regexp_replace(F.regexp_replace(F.lower(line), "[ _-]+", "-"), r"[^\p{L}\p{Nd}-]", "")
    return _table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(slug, r"-+\z", "").alias("slug"))


#: The first words of a document, small ASCII letters, six of them with `none` for what is missing.
_SIX = "list_concat(list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]+')[:6], lambda x: lower(x)), ['none', 'none', 'none', 'none', 'none', 'none'])"


def _six(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.transform(F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-zA-Z]+"), F.lit(0)), 1, 6), lambda x: F.lower(x))
    padded = F.concat(words, F.array(*[F.lit("none")] * 6))
    return _table(spark, sf_dir, "documents").select("doc_id", padded.alias("w")).selectExpr("doc_id", *[f"w[{i}] w{i}" for i in range(6)])


@query(f"""with w as (select doc_id, {_SIX} as w from documents)
select doc_id, w[1] || ' ' || w[2] || ' ' || w[3] || ' & <i>' || w[4] || '</i>' as plain, w[1] || ' ' || w[2] || ' ' || w[3] || ' & ' || w[4] as body, '**' || w[1] || '** <code>' || w[2] || '</code> [' || w[3] || '](#' || w[4] || ') &amp; &lt;i&gt;' || w[4] || '&lt;/i&gt;' as html,
 '\\[' || w[1] || '\\]\\`' || w[2] || ' ' || w[3] as escaped, w[4] || chr(10) || '---' || chr(10) || w[5] as matter, w[5] || '_' || w[6] || '_to_url' as snake from w""")
def q_inline_texts(spark, sf_dir):
    rows = _six(spark, sf_dir)
    inline = F.format_string("**%s** `%s` [%s](#%s) & <i>%s</i>", "w0", "w1", "w2", "w3", "w3")
    return rows.select(
        "doc_id", T.plain_text(inline).alias("plain"), T.plain_body(inline).alias("body"), T.inline_html(inline).alias("html"), T.md_escape(F.format_string(" [%s]`%s\n %s", "w0", "w1", "w2")).alias("escaped"),
        T.without_frontmatter(F.format_string("---\n%s: %s\n---\n%s\n---\n%s", "w1", "w2", "w3", "w4")).alias("matter"), T.snake(F.concat("w4", F.initcap("w5"), F.lit("ToURL"))).alias("snake"),
    )


@query(f"""with w as (select doc_id, {_SIX} as w from documents) select doc_id, '[image: ' || w[1] || '] ' || w[2] || ' ' || w[3] || ' ' || w[5] || '(' || w[6] || ') \\[' || w[4] || '\\]' as plain from w""")
def q_strip_links(spark, sf_dir):
    text = F.format_string("[\\[image: %s\\]](https://x/%s) %s ![%s](y) [%s](z)(%s) \\[%s\\]", "w0", "w1", "w1", "w2", "w4", "w5", "w3")
    return _six(spark, sf_dir).select("doc_id", T.stripped_links(text).alias("plain"))


#: Lines of a document that can stand in a table's cells, two words of each; and those that make a release.
@query(r"""with l as (select doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: len(regexp_extract_all(x, '[a-zA-Z]+')) > 1) as l from documents),
e as (select doc_id, generate_subscripts(l, 1) - 1 as i, regexp_extract_all(unnest(l), '[a-zA-Z]+') as w from l)
select doc_id, (i // 4)::int as tbl, (i % 4)::int as row, w[1] as first, w[2] as second, case when i >= 4 then 'At ' || (i // 4) end as heading from e""")
def q_pipe_tables(spark, sf_dir):
    """Tables of four rows, the first one the head, each under a heading but the first."""
    words = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.regexp_extract_all(x, F.lit("[a-zA-Z]+"), F.lit(0)))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.filter(words, lambda w: F.size(w) > 1).alias("w"))
    head = lambda i: F.when(i % 4 == 0, F.when(i > 0, F.concat(F.lit("\n## At "), F.floor(i / 4).cast("string"), F.lit("\n\n"))).otherwise("")).otherwise("")
    row = F.transform("w", lambda w, i: F.concat(head(i), F.lit("| "), w[0], F.lit(" |"), w[1], F.lit(" |"), F.when(i % 4 == 0, "\n|:--|--:|").otherwise("")))
    found = markdown.tables(docs.select("doc_id", F.array_join(row, "\n").alias("markdown")), "doc_id")
    return found.select("doc_id", "tbl", "row", F.col("cells")[0].alias("first"), F.col("cells")[1].alias("second"), "heading")


@query(r"""with l as (select doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '\S')) as l from documents),
e as (select doc_id, generate_subscripts(l, 1) - 1 as i, unnest(l) as x from l)
select doc_id, (i + 1)::int as ord, (i % 3) || '.' || (doc_id % 10) || '.' || i as version, case when i % 2 = 0 then 'https://x/' || i end as url, case when i % 3 = 0 then '2024-01-0' || (i % 9 + 1) end as released,
 trim(regexp_replace(regexp_replace(regexp_replace('### it' || chr(10) || chr(10) || '* **changed** ' || x, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[#*`]', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) as plain, i = 0 as latest from e""")
def q_change_logs(spark, sf_dir):
    """A release a line, with and without links and dates."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"\S"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", lines.alias("l"))

    def release(x, i):
        version = F.concat((i % 3).cast("string"), F.lit("."), (F.col("doc_id") % 10).cast("string"), F.lit("."), i.cast("string"))
        named = F.when(i % 2 == 0, F.concat(F.lit("["), version, F.lit("](https://x/"), i.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("v"), version))
        date = F.when(i % 3 == 0, F.concat(F.lit(" (2024-01-0"), (i % 9 + 1).cast("string"), F.lit(")"))).otherwise("")
        return F.concat(F.lit("## "), named, date, F.lit("\n\n### it\n\n* **changed** "), x, F.lit("\n"))

    found = markdown.releases(docs.select("doc_id", F.concat(F.lit("# Log\n\n"), F.array_join(F.transform("l", release), "\n")).alias("markdown")), "doc_id")
    return found.select("doc_id", "ord", "version", "url", "released", F.trim(F.regexp_replace("plain", r"\s+", " ")).alias("plain"), "latest")


@query("""with t as (select arg_max(event_type, event_id) as url from events)
select distinct event_type as url from events where event_type <> (select url from t) union all select url || '!' from t where not exists (select 1 from events where event_type = (select url || '!' from t))""")
def q_bookmark_toggle(spark, sf_dir):
    """The kinds of events as bookmarks: the last event's kind goes, one that isn't there comes."""
    events = _table(spark, sf_dir, "events")
    marks = events.groupBy(F.col("event_type").alias("url")).agg(F.lit("").alias("title"), F.min("ts").cast("timestamp").alias("at"), F.min("event_id").alias("pos"))
    last = events.agg(F.max_by("event_type", "event_id")).first()[0]
    engine = Engine(spark)
    for url in (last, f"{last}!"):
        marks = engine.bookmark_toggle(marks, url, "", "2024-02-01 00:00:00")
    return marks.select("url")


@query("""select conv_id, turn, '{"jsonrpc":"2.0","id":' || turn || ',' || case turn % 5 when 4 then '"error":{"code":-32601,"message":"no ' || role || '"}}' when 3 then '"error":{"code":-32603,"message":""}}'
 else '"result":{' || case when turn % 2 = 0 then '"role":"' || role || '",' else '' end || '"resultType":"complete","_meta":{"server":{"name":"pagegrain","version":"1.0"}}}}' end as reply from conversations where turn % 7 <> 6""")
def q_reply_envelopes(spark, sf_dir):
    """Results and errors of several codes; every seventh one is a notification."""
    rows = _table(spark, sf_dir, "conversations").select(
        F.struct("conv_id", "turn").alias("key"), F.when(F.col("turn") % 7 != 6, F.col("turn")).alias("id"), F.when(F.col("turn") % 2 == 0, F.format_string('"role":"%s"', "role")).alias("result"),
        F.when(F.col("turn") % 5 == 4, "method").when(F.col("turn") % 5 == 3, "odd").alias("problem"), F.when(F.col("turn") % 5 == 4, F.concat(F.lit("no "), "role")).alias("message"))
    return sinks.envelopes(rows, "pagegrain", "1.0", keep="key").select("key.conv_id", "key.turn", "reply")
