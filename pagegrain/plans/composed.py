"""Queries over widths, code fidelity, links between documents, clicks and lookups, on values derived from the tables, with DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import fidelity, linking, markdown, widths
from ..streaming import aging

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


#: Each document as a table: its first line's words are the head, each further line's words a row; words of 2 to 9 columns, by doc_id.
@query(r"""with l as (select doc_id, doc_id % 8 + 2 as k, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '^[^|]*[^|\s][^|]*$')) as lines from documents),
w as (select doc_id, k, [list_filter(string_split_regex(x, '\s+'), lambda t: t <> '')[:k] for x in lines] as rows from l),
c as (select doc_id, generate_subscripts(r, 1) - 1 as col, unnest(r) as cell from (select doc_id, unnest(rows) as r from w)),
n as (select doc_id, col, max(length(cell))::int as nat from c group by 1, 2),
t as (select *, count(*) over p as cols, sum(nat) over p as total, 60 - (3 * count(*) over p + 1) as room from n window p as (partition by doc_id)),
a as (select *, total > room and room > 4 * cols as tight, (count(*) over q) - 1 as gone, coalesce(sum(nat) over (partition by doc_id order by nat, col rows between unbounded preceding and 1 preceding), 0) as before from t window q as (partition by doc_id order by nat, col rows between unbounded preceding and current row)),
s as (select *, nat * (room - 4 * gone) >= 4 * (total - before) as ok from a),
f as (select doc_id, min(gone) as k from s where ok group by doc_id),
e as (select s.*, gone >= f.k as stays, arg_min(room - 4 * gone, gone) filter (gone >= f.k) over (partition by s.doc_id) as r, arg_min(total - before, gone) filter (gone >= f.k) over (partition by s.doc_id) as m from s left join f using (doc_id)),
g as (select *, case when stays then nat * r // m else 4 end as low, case when stays then nat * r % m else -1 end as rest from e),
h as (select *, room - sum(low) over (partition by doc_id) as spare, row_number() over (partition by doc_id order by rest desc, col) as place from g)
select doc_id, col::int as col, nat, (case when tight then greatest(4, nat * room // total) else nat end)::bigint as shrunk, (case when tight then low + case when place <= spare then 1 else 0 end else nat end)::bigint as width from h""")
def q_column_widths(spark, sf_dir):
    """Widths of a document's table in 60 columns."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"^[^|]*[^|\s][^|]*$"))
    words = F.transform("lines", lambda x: F.slice(F.filter(F.split(x, r"\s+"), lambda t: t != ""), F.lit(1), (F.col("doc_id") % 8 + 2).cast("int")))
    rows = F.transform("rows", lambda r: F.concat(F.lit("|"), F.array_join(r, "|"), F.lit("|")))
    docs = _table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines")).select("doc_id", words.alias("rows")).select("doc_id", rows.alias("rows"))
    docs = docs.select("doc_id", F.array_join(F.concat(F.slice("rows", 1, 1), F.array(F.lit("|-|-|")), F.expr("slice(rows, 2, greatest(size(rows) - 1, 0))")), "\n").alias("markdown"))
    cells = markdown.tables(docs, "doc_id")
    return widths.shared(widths.natural(cells, "doc_id"), 60, "doc_id").where("tbl = 0").drop("tbl")


#: Code derived from documents: lines get a tab by their place; what is shown is wrapped at 30 characters, and wrong in some documents.
_CODE_D = r"""with l as (select doc_id, lang, generate_subscripts(x, 1) - 1 as i, unnest(x) as t, len(x) as n from (select doc_id, lang, string_split(coalesce(text, ''), chr(10)) as x from documents where doc_id % 3 = 0)),
w as (select doc_id, lang, i, n, case when (i + doc_id) % 4 = 0 then '    ' || t else t end as want from l),
g as (select *, case when doc_id % 7 = 1 and i = n // 2 then want || '  ' when doc_id % 11 = 1 and i = n // 3 then want || '!' else want end as got from w),
d as (select doc_id, lang, i, want, case when doc_id % 13 = 1 and i = n - 1 then null else got end as got from g),
e as (select doc_id, max(i) filter (want <> '') as lw, max(i) filter (coalesce(got, '') <> '') as lg from d group by doc_id),
j as (select d.doc_id, lang, i, case when i <= coalesce(lw, 0) then want end as want, case when i <= coalesce(lg, -1) then coalesce(got, '') end as got from d join e using (doc_id)),
o as (select doc_id, lang, i, want, got, (want is null) <> (got is null) and not (i = 0 and coalesce(want, 'x') = '') as missing from j),
r as (select doc_id, max(lang) as lang, count(*) filter (missing) as missing, count(*) filter (missing or coalesce(want, '') <> coalesce(got, '')) as odd,
 min(case when want is not null and got is not null and not missing and regexp_replace(want, '\s+$', '') <> regexp_replace(got, '\s+$', '') then i + 1 end) as first from o group by doc_id),
c as (select doc_id, lang, case when first is not null then 'line' when missing > 0 then 'count' when odd > 0 then 'spaces' else 'bytes' end as how, first::int as line from r)
"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id", "lang", F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    tabbed = lambda tab: F.transform("l", lambda t, i: F.when((i + F.col("doc_id")) % 4 == 0, F.concat(F.lit(tab), t)).otherwise(t))
    sources = docs.select("doc_id", "lang", F.array_join(tabbed("\t"), "\n").alias("code"))
    n = F.size("l")
    wrong = lambda t, i: F.when((F.col("doc_id") % 7 == 1) & (i == F.floor(n / 2)), F.concat(t, F.lit("  "))).when((F.col("doc_id") % 11 == 1) & (i == F.floor(n / 3)), F.concat(t, F.lit("!"))).otherwise(t)
    shown = docs.select("doc_id", n.alias("n"), F.posexplode(F.transform(tabbed("    "), wrong)).alias("i", "t")).where("not (doc_id % 13 = 1 and i = n - 1)")
    pieces = F.expr("transform(sequence(0, greatest(char_length(t) - 1, 0) div 30), k -> substr(t, k * 30 + 1, 30))")
    rows = shown.select("doc_id", "i", F.posexplode(pieces).alias("k", "text"))
    return fidelity.compared(sources, rows.select("doc_id", (F.col("i") * 1_000_000 + F.col("k")).cast("long").alias("pos"), "text", (F.col("k") > 0).alias("soft")), ["doc_id"])


@query(_CODE_D + "select doc_id, lang, how in ('bytes', 'spaces') as same, how, line from c")
def q_code_fidelity(spark, sf_dir):
    return _compared(spark, sf_dir)


@query(_CODE_D + "select lang, count(*) as n, round(avg((how in ('bytes', 'spaces'))::int), 3) as same, round(avg((how = 'bytes')::int), 3) as exact from c group by lang")
def q_code_fidelity_by_language(spark, sf_dir):
    return fidelity.by_language(_compared(spark, sf_dir))


#: Documents' lines as sections; links lead on by place; every ninth section has moved to the next document, some in circles.
@query(r"""with recursive s as (select distinct doc_id as doc, 's' || (i % 12) as slug from (select doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i from documents) where (doc_id + i) % 9 <> 0),
k as (select distinct doc_id as doc, i from (select doc_id, unnest(range(least(12, len(string_split(coalesce(text, ''), chr(10)))))) as i from documents)),
m as (select doc, 's' || i as slug, case when doc % 27 = 0 then doc else doc + 1 end as to_doc, 's' || (case when doc % 27 = 0 then (i + 1) % 2 else i end) as to_slug from k where (doc + i) % 9 = 0 or (doc % 27 = 0 and i < 2)),
f as (select doc, slug, to_doc, to_slug, 1 as n from m union all select f.doc, f.slug, m.to_doc, m.to_slug, n + 1 from f join m on m.doc = f.to_doc and m.slug = f.to_slug where n < 60),
e as (select doc, slug, arg_max(to_doc, n) as to_doc, arg_max(to_slug, n) as to_slug, max(n) as n from f group by doc, slug),
l as (select doc, i as ord, doc + i % 3 as to_doc, case when i % 5 = 4 then '' else 's' || (i % 12) end as to_slug from k),
x as (select l.doc, l.ord, l.to_doc as a_doc, l.to_slug as a_slug, e.doc is not null as has, case when e.doc is null then l.to_doc when e.n < 60 then e.to_doc end as to_doc, case when e.doc is null then l.to_slug when e.n < 60 then e.to_slug end as to_slug from l left join e on e.doc = l.to_doc and e.slug = l.to_slug),
y as (select x.*, case when a_slug = '' and exists (select 1 from s where s.doc = x.to_doc) then 'document' when s.doc is not null and has then 'moved' when s.doc is not null then 'section' else 'dangling' end as state from x left join s on s.doc = x.to_doc and s.slug = x.to_slug)
select doc, ord::int as ord, case when state = 'dangling' then a_doc else to_doc end as to_doc, case when state = 'dangling' then a_slug else to_slug end as to_slug, state from y""")
def q_document_links(spark, sf_dir):
    lines = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "t"))
    sections = lines.where("(doc + i) % 9 <> 0").select("doc", F.expr("concat('s', i % 12)").alias("slug"))
    few = lines.where("i < 12").select("doc", "i")
    moves = few.where("(doc + i) % 9 = 0 or (doc % 27 = 0 and i < 2)").selectExpr("doc", "concat('s', i) slug", "if(doc % 27 = 0, doc, doc + 1) to_doc", "concat('s', if(doc % 27 = 0, (i + 1) % 2, i)) to_slug")
    links = few.selectExpr("doc", "i ord", "doc + i % 3 to_doc", "if(i % 5 = 4, '', concat('s', i % 12)) to_slug")
    return linking.linked(spark, links, sections, moves)


@query("""with c as (select user_id as session, row_number() over w - 1 as seq, (event_id % 2)::int as line, (event_id // 2 % 3)::int as col, epoch_ms(timestamp '2024-01-01 00:00:00') + 200 * row_number() over w + event_id % 7 * 100 as ms from events window w as (partition by user_id order by event_id)),
g as (select *, coalesce(ms - lag(ms) over w < 450 and line = lag(line) over w and abs(col - lag(col) over w) <= 1, false) as near from c window w as (partition by session order by seq)),
r as (select *, sum((not near)::int) over (partition by session order by seq) as run from g)
select session, seq, row_number() over (partition by session, run order by seq)::int as clicks from r""")
def q_click_counts(spark, sf_dir):
    """Clicks in a row: within 450 ms, on one line, a column apart at most."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    n = F.row_number().over(order)
    at = F.timestamp_millis(F.unix_millis(F.lit("2024-01-01 00:00:00").cast("timestamp")) + 200 * n + F.col("event_id") % 7 * 100)
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("session"), (n - 1).cast("long").alias("seq"), at.alias("at"), (F.col("event_id") % 2).cast("int").alias("line"), F.expr("cast(event_id div 2 % 3 as int)").alias("col"))
    return aging.folded(rows, aging.CLICKS, 3600)
