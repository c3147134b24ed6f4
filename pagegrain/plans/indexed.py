"""Queries over structures that the library writes first: postings, the cache store, anchors, as-of ranges, apportioned widths.

Each has a DuckDB twin that says the same without the structure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import asof, containment, postings
from ..sources import sinks, store, tables
from ..streaming import aging
from .relational import RELATIONAL

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


def _index(spark: SparkSession, sf_dir: str) -> postings.Index:
    return postings.build(spark, _table(spark, sf_dir, "documents"), "doc_id", "text", "source")


@query(RELATIONAL["ranked_search"][2])
def q_indexed_search(spark, sf_dir):
    return postings.search(spark, _index(spark, sf_dir), "The ing, src1").withColumnRenamed("entry", "doc_id")


@query(r"""with w as (select doc_id, 'body' as field, unnest(regexp_extract_all(lower(text), '[\pL\pN]+')) as word from documents
 union all select doc_id, 'title', unnest(regexp_extract_all(lower(source), '[\pL\pN]+')) from documents)
select doc_id % 64 as part, field, count(distinct (doc_id, word)) as postings, count(*) as n, count(distinct word) as words, sum(length(word))::bigint as letters from w group by 1, 2""")
def q_index_digest(spark, sf_dir):
    """What the index holds, by the entries' part and field."""
    rows = _index(spark, sf_dir).postings(spark)
    return rows.groupBy(F.expr("entry % 64").alias("part"), "field").agg(F.count("*").alias("postings"), F.sum("n").alias("n"), F.count_distinct("word").alias("words"), F.sum(F.expr("n * char_length(word)")).alias("letters"))


@query(r"""with w as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[\pL\pN]+')) as word from documents),
t as (select doc_id, word from w where contains(word, 'tion') or contains(word, 'en')),
f as (select word, count(*) as df from t group by word)
select term, word, (df + coalesce((select count(distinct source) * 0 from documents), 0))::bigint as df, ((length(word) - length(replace(word, term, ''))) // length(term))::bigint as times, starts_with(word, term) as opens_word
from f, (values ('tion'), ('en')) as v(term) where contains(word, term) and not exists (select 1 from documents where contains(lower(source), word))""")
def q_term_words(spark, sf_dir):
    """The words that hold a term anywhere, from one folder a term; words of titles left out."""
    docs = _table(spark, sf_dir, "documents")
    found = postings.words_of(spark, _index(spark, sf_dir), ["tion", "en"])
    return found.join(docs.select(F.explode(postings.tokens(F.col("source"))).alias("word")).distinct(), "word", "left_anti").select("term", "word", "df", "times", "opens_word")


@query(r"""with b as (select doc_id, source, text, lower(text) as b from documents),
s as (select doc_id, source, text, least(12, (length(b) - length(replace(b, 'ment', ''))) // 4) + case when starts_with(b, 'ment') then 2 else 0 end
 + least(12, (length(b) - length(replace(b, 'les', ''))) // 3) + case when starts_with(b, 'les') then 2 else 0 end + case when contains(lower(source), 'ment') then 8 else 0 end + case when contains(lower(source), 'les') then 8 else 0 end as score,
 instr(b, 'ment') - 1 as found, case when instr(b, 'ment') = 0 then 0 else greatest(0, instr(b, 'ment') - 1 - 73) end as start
 from b where (contains(b, 'ment') or contains(lower(source), 'ment')) and (contains(b, 'les') or contains(lower(source), 'les')) order by score desc, doc_id limit 24)
select doc_id, source as title, score::bigint as score, case when start > 0 then '…' else '' end || regexp_replace(substr(text, start::bigint + 1, 220) || case when found >= 0 and start + 220 < length(text) then '…' else '' end, '\A\s+|\s+\z', '', 'g') as snippet from s""")
def q_search_hits(spark, sf_dir):
    """The hits with their snippets."""
    return postings.hits(spark, _index(spark, sf_dir), _table(spark, sf_dir, "documents"), "doc_id", "text", "source", "ment les")


_SAVED = "timestamp '2024-02-20 00:00:00' - interval '1 day' * (page_id % 40)"
#: What a store holds after storing all pages, newer contents of every third, removing every fifth, and pruning at thirty days.
_STORE_D = f"""with last as (select url, arg_max(page_id, page_id) as page_id from pages group by url),
o as (select url, arg_max(html, ({_SAVED}, html)) as content, max({_SAVED}) as saved from pages group by url),
n as (select url, max(html || '+') as content, timestamp '2024-02-21 00:00:00' as saved from pages where page_id % 3 = 0 group by url),
s as (select coalesce(n.url, o.url) as url, coalesce(n.content, o.content) as content, coalesce(n.saved, o.saved) as saved from o left join n using (url)),
k as (select *, substr(sha256('2|' || url), 1, 32) as key from s where url not in (select url from pages where page_id % 5 = 0) and not saved < timestamp '2024-02-21 00:00:00' - interval 30 days)
"""


def _store(spark: SparkSession, sf_dir: str) -> store.CacheStore:
    pages = _table(spark, sf_dir, "pages")
    held = store.CacheStore(spark, tables.own_path(spark, "cache"))
    held.put(pages.select("url", F.col("html").alias("content"), F.expr("timestamp'2024-02-20 00:00:00' - make_interval(0, 0, 0, cast(page_id % 40 as int))").alias("saved")))
    held.put(pages.where("page_id % 3 = 0").select("url", F.concat("html", F.lit("+")).alias("content"), F.lit("2024-02-21 00:00:00").cast("timestamp").alias("saved")))
    held.delete(pages.where("page_id % 5 = 0").select("url"))
    held.prune("2024-02-21 00:00:00")
    return held


@query(_STORE_D + "select url, md5(content) as digest, saved from k where url in (select url from pages where page_id % 2 = 0)")
def q_store_lookups(spark, sf_dir):
    """Half of the addresses, and some that were never stored, looked up in the store."""
    pages = _table(spark, sf_dir, "pages")
    asked = pages.where("page_id % 2 = 0").select("url").unionAll(pages.select(F.concat("url", F.lit("#none"))))
    return _store(spark, sf_dir).get(asked).select("url", F.md5("content").alias("digest"), "saved")


@query(_STORE_D + "select substr(key, 1, 2) as prefix, count(*) as entries, sum(octet_length(encode(content)) + octet_length(encode('page-cache 2 ' || epoch(saved)::bigint || ' ' || url)) + 1)::bigint as size, min(saved) as oldest from k group by 1")
def q_store_folders(spark, sf_dir):
    """Entries and bytes of each of the store's folders."""
    return _store(spark, sf_dir).rows().groupBy("prefix").agg(F.count("*").alias("entries"), F.sum("size").alias("size"), F.min("saved").alias("oldest"))


@query(r"""select 'v' || doc_id as version, '<item><title>Doc &amp; ' || doc_id || '</title><link>https://x/' || 'v' || doc_id || '/</link><pubDate>' || case when lang = 'en' then strftime(timestamp '2024-01-01 00:00:00' + interval '1 hour' * (doc_id % 9000)::int, '%a, %d %b %Y %H:%M:%S GMT') else 'Thu, 01 Jan 1970 00:00:00 GMT' end || '</pubDate><description>' ||
replace(replace(replace(replace(string_split(coalesce(text, ''), chr(10))[1], '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</description></item>' as item from documents""")
def q_release_items(spark, sf_dir):
    """Each document as a release of a feed."""
    released = F.when(F.col("lang") == "en", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(doc_id % 9000 as int))"))
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("version"), released.alias("released"), F.split(F.coalesce("text", F.lit("")), "\n")[0].alias("plain"))
    return sinks.feed_items(docs, "Doc &", "https://x").select(F.concat(F.lit("v"), "version").alias("version"), "item")


@query(r"""with e as (select source as doc, lang as label, doc_id as ord, 's' || doc_id as section, string_split(coalesce(text, ''), chr(10))[1] as title, case when doc_id % 3 = 0 then '' else 'about ' || doc_id end as summary from documents where source is not null and doc_id % 10 <> 0),
b as (select doc, coalesce(min(label), '') as label from e group by doc)
select doc, md5('## ' || b.label || chr(10) || chr(10) || 'All of ' || doc || chr(10) || chr(10) || string_agg('- [' || title || '](https://x/' || doc || '/' || section || '/): ' || case when summary = '' then 'All of ' || doc else summary end, chr(10) order by ord)) as digest from e join b using (doc) group by doc, b.label""")
def q_text_map(spark, sf_dir):
    """A source's documents as the sections of a text map; every tenth one is an index and left out."""
    docs = _table(spark, sf_dir, "documents").where("source is not null")
    rows = docs.select(F.col("source").alias("doc"), F.coalesce("lang", F.lit("")).alias("label"), F.concat(F.lit("All of "), "source").alias("blurb"), F.col("doc_id").alias("ord"),
        F.when(F.col("doc_id") % 10 == 0, "index").otherwise(F.concat(F.lit("s"), F.col("doc_id").cast("string"))).alias("section"), F.split(F.coalesce("text", F.lit("")), "\n")[0].alias("title"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("about "), F.col("doc_id").cast("string"))).alias("summary"))
    return sinks.text_map(rows, "https://x").select("doc", F.md5("text").alias("digest"))


@query(r"""with recursive e as (select user_id as session, row_number() over (partition by user_id order by ts, event_id) - 1 as seq, epoch_ms(ts) as ms, epoch_ms(ts) // 1000 as s, 'v1.' || (event_id % 3) || '.0' as cur, case when event_type <> 'error' then 'v1.' || (event_id // 50 % 5) || '.0' end as fnd from events),
f(session, seq, ms, latest, checked, failed, told, seen, asked, newer, announce, just_updated) as (select distinct session, -1::bigint, null::bigint, null::varchar, null::bigint, null::bigint, null::varchar, null::varchar, false, false, false, false from e
 union all select session, seq, ms, latest, checked, failed, case when announce then latest else told0 end, case when lost then seen0 else cur end, asked, newer, announce,
  not lost and seen0 is not null and seen0 <> cur and coalesce(latest = cur, false) from
 (select *, newer and not lost and told0 is distinct from latest as announce from
 (select *, coalesce(split_part(latest, '.', 2)::int > split_part(cur, '.', 2)::int, false) as newer from
 (select session, seq, ms, cur, told0, seen0, not waits as asked, not waits and fnd is null as lost, case when not waits and fnd is not null then fnd else latest0 end as latest,
  case when not waits and fnd is not null then s else checked0 end as checked, case when waits then failed0 when fnd is null then s end as failed from
 (select *, latest0 is not null and (coalesce(s - checked0 < 43200, false) or coalesce(s - failed0 < 3600, false)) as waits from
 (select e.*, case when keep then f.latest end as latest0, case when keep then f.checked end as checked0, case when keep then f.failed end as failed0, case when keep then f.told end as told0, case when keep then f.seen end as seen0
  from (select f.*, e.ms as next_ms, not coalesce(e.ms - f.ms > 86400000, false) as keep from f join e on e.session = f.session and e.seq = f.seq + 1) f join e on e.session = f.session and e.seq = f.seq + 1))))))
select session, seq, asked, newer, announce, just_updated from f where seq >= 0""")
def q_update_checks(spark, sf_dir):
    """Looks for a newer release: what each asks and tells, a session forgotten after a day of silence."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _table(spark, sf_dir, "events").select(
        F.col("user_id").cast("long").alias("session"), (F.row_number().over(order) - 1).cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("at"),
        F.expr("concat('v1.', event_id % 3, '.0')").alias("current"), F.expr("if(event_type <> 'error', concat('v1.', event_id div 50 % 5, '.0'), null)").alias("found"))
    return aging.folded(rows, aging.CHECKS, 86_400)


@query(RELATIONAL["passage_recall"][2])
def q_anchored_passages(spark, sf_dir):
    """Benchmark texts in documents, each looked for at its rarest run of words."""
    found = containment.contained(spark, _table(spark, sf_dir, "benchmark").selectExpr("item_id sentence_key", "text sentence"), _table(spark, sf_dir, "documents").selectExpr("doc_id text_key", "text"))
    return found.selectExpr("sentence_key item_id", "text_key doc_id")


#: Sentences of pages' plain text: what stands between two marks, 40 to 300 characters long.
_SENTENCES_D = r"""s as (select doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x)), lambda x: length(x) between 12 and 300)) as sentence from documents where doc_id % 20 = 0)"""


@query(f"with {_SENTENCES_D}, d as (select distinct sentence from s), h as (select sentence, count(*) as n from d join documents t on contains(t.text, d.sentence) group by sentence) select doc_id, count(*) as sentences, count(*) filter (n > 1) as shared, sum(n)::bigint as places, round(count(*) filter (n > 1) / count(*), 3) as ratio from s join h using (sentence) group by doc_id")
def q_sentence_overlap(spark, sf_dir):
    """Of every twentieth document's sentences: how many other documents hold them, and the share of those that some does."""
    docs = _table(spark, sf_dir, "documents")
    cut = F.filter(F.transform(F.split("text", r"[.!?\n]+"), lambda x: F.trim(x)), lambda x: F.char_length(x).between(12, 300))
    each = docs.where("doc_id % 20 = 0").select("doc_id", F.explode(cut).alias("sentence"))
    distinct = each.select("sentence").distinct().select(F.col("sentence").alias("sentence_key"), "sentence")
    holders = containment.contained(spark, distinct, docs.selectExpr("doc_id text_key", "text")).groupBy(F.col("sentence_key").alias("sentence")).agg(F.count("*").alias("n"))
    shared = F.count_if(F.col("n") > 1)
    return each.join(holders, "sentence").groupBy("doc_id").agg(F.count("*").alias("sentences"), shared.alias("shared"), F.sum("n").alias("places"), F.round(shared / F.count("*"), 3).alias("ratio"))


#: Events with one key for half of them, and what is looked up: purchases as a table of their own.
_HALF = "(select event_id, ts, case when event_id % 2 = 0 then 0 else user_id end as k from events)"
_BOUGHT = "(select event_id as bought, value, ts, case when event_id // 3 % 2 = 0 then 0 else user_id end as k from events where event_type = 'purchase')"


@query(f"select e.event_id, e.k, b.bought, b.value, n.bought as next_bought from {_HALF} e asof left join (select k, ts, arg_max(bought, (ts, value, bought)) as bought, arg_max(value, (ts, value, bought)) as value from {_BOUGHT} group by k, ts) b on e.k = b.k and e.ts >= b.ts asof left join (select k, ts, min(bought) as bought from {_BOUGHT} group by k, ts) n on e.k = n.k and e.ts <= n.ts")
def q_asof_purchases(spark, sf_dir):
    """For each event the last purchase of its key before it and the next one after it; one key holds half of all rows."""
    left, right = _asof_sides(spark, sf_dir)
    back = asof.asof(spark, left, right, "k", "at", range_rows=1000).select("event_id", "k", "at", "found.bought", "found.value")
    both = asof.asof(spark, back, right, "k", "at", forward=True, range_rows=1000)
    return both.select("event_id", "k", "bought", "value", F.col("found.bought").alias("next_bought"))


@query(f"select e.event_id, coalesce(n.bought, (select arg_min(bought, (ts, bought)) from {_BOUGHT} f where f.k = e.k)) as next_bought from {_HALF} e asof left join (select k, ts, min(bought) as bought from {_BOUGHT} group by k, ts) n on e.k = n.k and e.ts <= n.ts")
def q_asof_wrapped(spark, sf_dir):
    """The next purchase of an event's key, the key's first one after the last."""
    left, right = _asof_sides(spark, sf_dir)
    return asof.asof(spark, left, right, "k", "at", forward=True, wrap=True, range_rows=1000).select("event_id", F.col("found.bought").alias("next_bought"))


def _asof_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = _table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    left = events.select("event_id", "at", F.expr("if(event_id % 2 = 0, 0, user_id)").alias("k"))
    right = events.where("event_type = 'purchase'").select("at", F.col("event_id").alias("bought"), "value", F.expr("if(event_id div 3 % 2 = 0, 0, user_id)").alias("k"))
    return left, right
