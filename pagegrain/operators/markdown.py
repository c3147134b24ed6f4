"""Markdown documents to sections, tables, releases, notes and key tables.

A document's lines are an array, worked on inside its row: nothing is shuffled, and rows that share a key never meet. Each operator
takes documents with a key column and a Markdown column, null Markdown giving no rows (introductions and titles: one row).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import folded, let

#: Formats of headings, contents items and releases, and what a line of nothing but links is.
_FENCE = r"^\s*(`{3,}|~{3,})(.*)$"
_LINK_ONLY = r"^[ \t]*(\[[^\]]*\]\([^)]*\)[ \t]*){4,}$"
_HEADING = r"^##\s+(.+?)\s*$"
_TITLE = r"^#\s+(.+?)\s*$"
_TOC = r"^\s*[-*]\s+\[[^\]]*\]\(#[^)]*\)\s*$"
_RELEASE = r"^##\s+(?:\[([^\]]+)\]\(([^)]*)\)|v?([^\s(]+))\s*(?:\(([^)]*)\))?\s*$"


def _lines(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, row, pos, line) of all lines, texts that are null left out; row tells documents of one key apart."""
    rows = docs.select(F.col(key), F.split(text, "\n").alias("lines"), F.monotonically_increasing_id().alias("row"))
    return rows.select(key, "row", F.posexplode("lines").alias("pos", "line"))


def _spans(lines: Column) -> Column:
    """Of a text's lines: stretches (a, n, code) that cover them all in order, a fence's own lines with its code.

    A fold over the lines that could open or close a fence, as what closes one depends on what opened it: a run of
    the same mark, as long at least, and nothing else. Backtick fences have no backtick after their mark."""
    mark = lambda x: F.regexp_extract(x, _FENCE, 1)
    rest = lambda x: F.trim(F.regexp_extract(x, _FENCE, 2))
    found = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), mark(x).alias("mark"), rest(x).alias("rest"))), lambda c: c.mark != "")
    span = lambda a, n, code: F.array(F.struct(a.cast("int").alias("a"), n.cast("int").alias("n"), F.lit(code).alias("code")))
    kind = "array<struct<a: int, n: int, code: boolean>>"

    def step(s: Column, c: Column) -> tuple[dict[str, Column], Column]:
        opens = (s.mark == "") & ~(c.mark.startswith("`") & F.contains(c.rest, F.lit("`")))
        closes = (s.mark != "") & (c.rest == "") & c.mark.startswith(s.mark)
        fields = {"mark": F.when(opens, c.mark).when(closes, "").otherwise(s.mark), "at": F.when(opens, c.i).when(closes, c.i + 1).otherwise(s["at"])}
        return fields, F.when(opens, span(s["at"], c.i - s["at"], False)).when(closes, span(s["at"], c.i + 1 - s["at"], True)).otherwise(F.array().cast(kind))

    def end(s: Column) -> Column:
        return F.concat(s["out"], F.array(F.struct(s["at"].alias("a"), (F.size(lines) - s["at"]).cast("int").alias("n"), (s.mark != "").alias("code"))))

    return F.filter(folded(found, {"mark": F.lit(""), "at": F.lit(0)}, step, kind, end), lambda s: s.n > 0)


def _coded(text: Column) -> Column:
    """A text's lines: (pos, line, code: whether inside a fence or one of its own lines, stretch: the number of its stretch); null for null."""

    def of(lines: Column) -> Column:
        part = lambda s, k: F.transform(F.slice(lines, s.a + 1, s.n), lambda x, i: F.struct((s.a + i).cast("int").alias("pos"), x.alias("line"), s.code.alias("code"), k.alias("stretch")))
        return let(_spans(lines), lambda spans: F.flatten(F.transform(spans, part)))

    return let(F.split(text, "\n"), of)


def _uncoded(text: Column) -> Column:
    """A text's lines in the form of _coded, none of them code."""
    return F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line"), F.lit(False).alias("code"), F.lit(0).alias("stretch")))


def _text(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x.line), "\n")


def fenced_lines(docs: DataFrame, key: str = "page_id", text: Column | str = "markdown") -> DataFrame:
    """(key, pos, line, code) of all lines of texts, code: whether inside a fence or one of its own lines. A fence that
    nothing closes goes on to the end. Null texts have no lines; every line once."""
    text = F.col(text) if isinstance(text, str) else text
    rows = docs.select(key, F.explode_outer(_coded(text)).alias("x"))
    return rows.where("x is not null").select(key, "x.pos", "x.line", "x.code")


def tidied(docs: DataFrame, key: str = "page_id", text: str = "markdown") -> DataFrame:
    """(key, markdown): outside of fences lines of nothing but four links and more, and list separators, are blank, ends
    of lines go, and of blank lines in a row one stays. Code stays as it is."""
    gone = lambda line: line.rlike(_LINK_ONLY) | (F.trim(line) == "<!--THE END-->")
    said = lambda x: F.when(x.code, x.line).when(gone(x.line), "").otherwise(F.regexp_replace(x.line, r"\s+$", ""))
    blank = lambda x: ~x.code & (x.line == "")
    clean = lambda lines: F.transform(lines, lambda x: F.struct(said(x).alias("line"), x.code.alias("code")))
    kept = lambda lines: F.filter(lines, lambda x, i: ~(blank(x) & F.coalesce(blank(F.get(lines, i - 1)), F.lit(False))))
    return docs.where(F.col(text).isNotNull()).select(key, let(clean(_coded(F.col(text))), lambda lines: _text(kept(lines))).alias("markdown"))


def without_repeated_links(docs: DataFrame, key: str = "page_id", text: str = "markdown") -> DataFrame:
    """(key, markdown) without lines outside of fences that hold a link, or are an image, and equal the last line with
    text before them, if no fence is between."""

    def again(x: Column, before: Column) -> Column:
        said = F.trim(x.line)
        link = F.contains(said, F.lit("](")) | said.rlike(r"^!?\[image:")
        return F.coalesce(link & (said == F.trim(before.line)) & (x.stretch == before.stretch), F.lit(False))

    def kept(lines: Column, told: Column) -> Column:
        """The lines ahead of the first one with text, then each such line, unless it is told again, with what follows it up to the next."""
        first = F.coalesce(F.get(told, F.lit(0)).pos, F.size(lines))

        def part(x: Column, i: Column) -> Column:
            skip = again(x, F.get(told, i - 1)).cast("int")
            return F.slice(lines, x.pos + 1 + skip, F.coalesce(F.get(told, i + 1).pos, F.size(lines)) - x.pos - skip)

        return F.concat(F.slice(lines, F.lit(1), first), F.flatten(F.transform(told, part)))

    told = lambda lines: F.filter(lines, lambda x: ~x.code & (F.trim(x.line) != ""))
    whole = let(_coded(F.col(text)), lambda lines: let(told(lines), lambda t: _text(kept(lines, t))))
    return docs.where(F.col(text).isNotNull()).select(key, whole.alias("markdown"))


#: What counts as structure of a Markdown text, by line or anywhere.
STRUCTURE = {
    "headings": r"(?m)^#{1,6}\s", "fences": r"(?m)^(`{3,}|~{3,})", "fence_langs": r"(?m)^`{3,}([A-Za-z0-9+#._-]+)", "tables": r"(?m)^\|.*\|\s*$", "images": r"!?\[image:",
    "links": r"(?<!!)\[[^\]]*\]\([^)]*\)", "bare_links": r"(?m)^\s*(?:\[[^\]]*\]\([^)]*\)\s*)+$", "lists": r"(?m)^\s*(?:[-*+]|\d+\.)\s",
}
#: Words that page furniture leaves behind, by family.
LEAKS = {
    "cookie/consent": r"(?i)\b(cookies?|consentimiento|consent|aceptar todas|accept all)\b",
    "newsletter": r"(?i)\b(newsletter|bolet[ií]n|suscr[ií]bete|subscribe to)\b",
    "signin/login": r"(?i)\b(sign in|log in|iniciar sesi[oó]n|acceder|register|reg[ií]strate)\b",
    "ads": r"(?i)\b(advertisement|publicidad|sponsored|patrocinado)\b",
    "share": r"(?i)\b(share this|comparte|compartir|copy link|comparte este art[ií]culo)\b",
    "related": r"(?i)\b(related posts?|art[ií]culos relacionados|te puede interesar|read more|leer m[aá]s)\b",
    "comments": r"(?i)\b(comments?|comentarios)\b",
    "footer/legal": r"(?i)(all rights reserved|todos los derechos reservados|privacy policy|pol[ií]tica de privacidad|terms of (use|service))",
    "social/follow": r"(?i)\b(follow us|s[ií]guenos|twitter|facebook|instagram|linkedin|youtube|telegram|whatsapp)\b",
    "nav/menu": r"(?i)\b(skip to (main )?content|navigation|men[uú] principal|main menu|breadcrumb)\b",
    "app-push": r"(?i)\b(download (our|the) app|descarga (nuestra|la) app|enable javascript|activa javascript)\b",
    "paywall": r"(?i)\b(subscribe now|suscr[ií]bete ahora|already a subscriber|ya eres suscriptor|paywall|premium)\b",
}


def structure(text: Column) -> list[Column]:
    """Counts of a Markdown text's structure, its lines and whether it opens with a title. Two fence lines are a fence."""
    n = lambda p: F.regexp_count(text, F.lit(p.replace("(?m)", "(?dm)"))).cast("long")  # noqa: E731  (?d): only a line feed ends a line
    counts = [(F.floor(n(p) / 2).cast("long") if k == "fences" else n(p)).alias(f"md_{k}") for k, p in STRUCTURE.items()]
    return [*counts, (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("md_lines"), text.rlike(r"\A\s*#\s+\S").alias("md_has_title")]


#: Parts of LEAKS' words: a text in which a family matches has one of the family's, in small letters. Most texts have none, and finding that out is cheap.
LEAK_PARTS = {
    "cookie/consent": ("cookie", "consent", "aceptar todas", "accept all"),
    "newsletter": ("newsletter", "bolet", "suscr", "subscribe to"),
    "signin/login": ("sign in", "log in", "iniciar sesi", "acceder", "register", "strate"),
    "ads": ("advertisement", "publicidad", "sponsored", "patrocinado"),
    "share": ("share this", "comparte", "compartir", "copy link"),
    "related": ("related post", "culos relacionados", "te puede interesar", "read more", "leer m"),
    "comments": ("comment", "comentarios"),
    "footer/legal": ("all rights reserved", "todos los derechos reservados", "privacy policy", "tica de privacidad", "terms of "),
    "social/follow": ("follow us", "guenos", "twitter", "facebook", "instagram", "linkedin", "youtube", "telegram", "whatsapp"),
    "nav/menu": ("skip to ", "navigation", " principal", "main menu", "breadcrumb"),
    "app-push": (" app", "javascript"),
    "paywall": ("subscribe now", "bete ahora", "already a subscriber", "ya eres suscriptor", "paywall", "premium"),
}


def leaks(text: Column) -> Column:
    """Counts of the families of LEAKS that a text has, as a map."""

    def counted(small: Column, k: str) -> Column:
        parts = reduce(lambda a, b: a | b, [F.contains(small, F.lit(x)) for x in LEAK_PARTS[k]])
        return F.when(parts, F.regexp_count(text, F.lit("(?U)" + LEAKS[k]))).when(text.isNotNull(), 0).cast("int")

    # The three letters that patterns take for an i or s, though they aren't its small or capital form.
    small = F.lower(F.translate(text, "\u0130\u0131\u017f", "iis"))
    each = let(small, lambda s: F.array(*[F.struct(F.lit(k).alias("key"), counted(s, k).alias("value")) for k in LEAKS]))
    return F.map_from_entries(F.filter(each, lambda e: e.value > 0))


def anomalies(docs: DataFrame, key: str = "page_id", text: str = "markdown") -> DataFrame:
    """(key, backslash_breaks, repeated_lines, empty_links, skip_links) outside of fences: lines that end in a backslash,
    lines of more than 12 characters that equal the one before (blank lines and table rows apart), links without text, and skip links
    among the first 600 characters. A document without lines outside of fences has none."""

    def counts(lines: Column) -> Column:
        said = F.filter(F.transform(lines, lambda x: F.trim(x.line)), lambda x: (x != "") & ~x.startswith("|"))
        again = lambda t: F.size(F.filter(t, lambda x, i: (i > 0) & (x == F.get(t, i - 1)) & (F.length(x) > 12)))
        empty = F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.regexp_count(x.line, F.lit(r"\[\s*\]\(")))
        return F.struct(
            F.size(lines).alias("n"), F.size(F.filter(lines, lambda x: x.line.rlike(r"\\\s*$"))).cast("long").alias("backslash_breaks"), let(said, again).cast("long").alias("repeated_lines"),
            empty.alias("empty_links"), F.regexp_count(F.left(_text(lines), F.lit(600)), F.lit("(?i)skip to (the )?(main )?content")).cast("long").alias("skip_links"),
        )

    found = docs.select(key, let(F.filter(_coded(F.col(text)), lambda x: ~x.code), counts).alias("c")).where("c.n > 0")
    return found.select(key, "c.backslash_breaks", "c.repeated_lines", "c.empty_links", "c.skip_links")


def titles(docs: DataFrame, key: str = "page_id", text: str = "markdown", url: str = "url") -> DataFrame:
    """(key, title, has_title, body_words): the first line with text if it is a level-1 heading, else the address's host;
    whether a level-1 heading stands outside of fences; words but for those of level-1 heading lines."""
    head = lambda x: x.line.startswith("# ")
    words = lambda x: F.when(head(x), 0).otherwise(F.size(F.filter(F.split(x.line, r"\s+"), lambda w: w != "")))

    def told(lines: Column) -> Column:
        first = F.get(F.filter(F.transform(lines, lambda x: F.trim(x.line)), lambda x: x != ""), F.lit(0))
        return F.struct(first.alias("first"), F.exists(lines, lambda x: ~x.code & head(x)).alias("has_title"), F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + words(x)).alias("body_words"))

    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1).alias("host")
    found = docs.select(key, host, let(_coded(F.col(text)), told).alias("t"))
    title = F.when(F.col("t.first").startswith("# "), F.trim(F.substring("t.first", 3, 1 << 30))).otherwise(F.col("host"))
    return found.select(key, title.alias("title"), F.coalesce("t.has_title", F.lit(False)).alias("has_title"), F.coalesce("t.body_words", F.lit(0)).alias("body_words"))


def _joined(lines: Column) -> Column:
    """Lines as one text without white space around it."""
    return F.regexp_replace(_text(lines), r"\A\s+|\s+\z", "")


def _parts(docs: DataFrame, key: str, lines: Column, heading: str) -> DataFrame:
    """(key, ord, head, body): what stands under each heading outside of fences, numbered from 1; head is its line."""

    def parts(lines: Column) -> Column:
        heads = F.filter(lines, lambda x: ~x.code & x.line.rlike(heading))
        upto = lambda h, i, x: F.slice(lines, x.pos + 2, F.coalesce(F.get(h, i + 1).pos, F.size(lines)) - x.pos - 1)
        return let(heads, lambda h: F.transform(h, lambda x, i: F.struct((i + 1).cast("int").alias("ord"), x.line.alias("head"), _joined(upto(h, i, x)).alias("body"))))

    return docs.select(key, F.explode_outer(let(lines, parts)).alias("p")).where("p is not null").select(key, "p.*")


def sections(docs: DataFrame, key: str = "page_id", text: str = "markdown") -> DataFrame:
    """(key, ord, slug, heading, body): parts under level-2 headings, those in fenced code not counting."""
    found = _parts(docs, key, _coded(T.without_frontmatter(F.col(text))), _HEADING).withColumn("heading", T.plain_text(F.regexp_extract("head", _HEADING, 1)))
    return found.select(key, "ord", T.slug(F.col("heading")).alias("slug"), "heading", "body")


def introductions(docs: DataFrame, key: str = "page_id", text: str = "markdown") -> DataFrame:
    """(key, title, summary, intro): the first level-1 heading, the first paragraph, and what comes before the
    first section, without a hand-written contents list (two and more anchor items in a row)."""
    toc = lambda x: F.coalesce(x.line.rlike(_TOC), F.lit(False))

    def told(lines: Column) -> Column:
        heads = F.filter(lines, lambda x: ~x.code & x.line.rlike(_HEADING))
        title = F.get(F.filter(lines, lambda x: x.line.rlike(_TITLE)), F.lit(0)).line
        ahead = F.slice(lines, F.lit(1), F.coalesce(F.get(heads, F.lit(0)).pos, F.size(lines)))

        def kept(a: Column) -> Column:
            listed = lambda x, i: toc(x) & (toc(F.get(a, i - 1)) | toc(F.get(a, i + 1)))
            keep = F.filter(a, lambda x, i: ~listed(x, i) & ~((x.pos == 0) & x.line.rlike(_TITLE)))
            says = lambda x: (F.trim(x.line) != "") & ~toc(x) & ~F.trim(x.line).rlike(r"^[-*]\s")
            return let(keep, lambda k: F.struct(F.regexp_extract(title, _TITLE, 1).alias("title"), F.get(F.filter(k, says), F.lit(0)).line.alias("first"), _joined(k).alias("intro")))

        return let(ahead, kept)

    found = docs.select(key, let(_coded(F.coalesce(T.without_frontmatter(F.col(text)), F.lit(""))), told).alias("t"))
    empty = F.lit("")
    return found.select(key, F.coalesce(T.plain_text(F.col("t.title")), empty).alias("title"), F.coalesce(T.plain_text(F.col("t.first")), empty).alias("summary"), F.regexp_replace("t.intro", r"\n{3,}", "\n\n").alias("intro"))


def without_lead(body: Column, lead: Column) -> Column:
    """A body without its first paragraph where that, as plain text, is the summary shown above it."""
    first = F.regexp_extract(body, r"(?s)\A\s*(.*?)(\n\s*\n|\z)", 1)
    rest = F.regexp_replace(body, r"(?s)\A\s*.*?(\n\s*\n|\z)", "")
    return F.when(T.plain_text(first) == lead, rest).otherwise(body)


def tables(docs: DataFrame, key: str = "page_id", text: str = "markdown") -> DataFrame:
    """(key, tbl, row, heading, cells): rows of pipe tables, numbered; row 0 has the column names. A table is a
    row, a line of dashes, and the rows up to the next line that is neither. heading: the one above, or null."""
    order = Window.partitionBy("row").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    line = F.trim("line")
    lines = _lines(docs, key, F.col(text)).withColumn("rule", line.rlike(r"^\|?[\s:|-]+\|[\s:|-]*$") & line.contains("-"))
    lines = lines.withColumn("pipe", line.startswith("|")).withColumn("under", F.lag("pipe", 1, False).over(order)).withColumn("ruled", F.lead("rule", 1, False).over(order))
    lines = lines.withColumn("above", F.last(F.when(F.col("line").rlike(r"^#{1,6}\s"), T.plain_text(F.regexp_replace("line", r"^#{1,6}\s+", ""))), ignorenulls=True).over(upto))
    lines = lines.withColumn("block", F.sum((~(F.col("pipe") | (F.col("rule") & F.col("under")))).cast("int")).over(upto))
    inside = Window.partitionBy("row", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("rules", F.sum(F.col("rule").cast("int")).over(inside))
    head = F.col("pipe") & F.col("ruled") & (F.col("rules") == F.col("rule").cast("int")) & (F.col("rules") == 0)
    lines = lines.withColumn("head", head).where(F.col("head") | (F.col("pipe") & ~F.col("rule") & (F.col("rules") == 1)))
    lines = lines.withColumn("tbl", F.sum(F.col("head").cast("int")).over(upto) - 1).where("tbl >= 0")
    cells = F.transform(F.split(F.regexp_replace(line, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    number = F.row_number().over(Window.partitionBy("row", "tbl").orderBy("pos")) - 1
    return lines.select(key, F.col("tbl").cast("int").alias("tbl"), number.alias("number"), F.col("above").alias("heading"), cells.alias("cells")).withColumnRenamed("number", "row")


def releases(docs: DataFrame, key: str = "page_id", text: str = "markdown") -> DataFrame:
    """(key, ord, version, url, released, body, plain, latest) of a change log, in its order; a level-2 heading
    that isn't one of a release belongs to the body."""
    got = lambda i: F.nullif(F.regexp_extract("head", _RELEASE, i), F.lit(""))
    found = _parts(docs, key, _uncoded(F.col(text)), _RELEASE).withColumn("h", F.struct(F.coalesce(got(1), got(3)).alias("version"), got(2).alias("url"), got(4).alias("released")))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("body", r"\[([^\]]*)\]\([^)]*\)", "$1"), "[#*`]", " "), r"\s+", " "))
    return found.select(key, "ord", F.regexp_replace("h.version", "^v", "").alias("version"), "h.url", "h.released", "body", plain.alias("plain"), (F.col("ord") == 1).alias("latest"))


def release_notes(docs: DataFrame, key: str = "page_id", text: str = "markdown") -> DataFrame:
    """(key, ord, kind, note): a release's lines as title (its date), head, item or text, without commit links
    and bold scopes; blank lines, rules and generated remarks go."""
    title, head, item = r"^#{1,2}\s+\[?v?([0-9][^\]\s)]*)\]?(?:\([^)]*\))?\s*(?:\(([\d-]+)\))?", r"^#{3,6}\s+(.*)$", r"^\s*[*+-]\s+(.*)$"
    lines = _lines(docs, key, F.replace(F.col(text), F.lit("\r"), F.lit(""))).withColumn("line", F.regexp_replace("line", r"[ \t]+$", ""))
    lines = lines.where("trim(line) <> '' and not line rlike '^(:robot:|---|This PR was generated)'")
    line = F.col("line")
    said = F.regexp_replace(F.regexp_replace(F.regexp_extract(line, item, 1), r"\s*\(\[[0-9a-f]{7,40}\]\([^)]*\)\)\s*$", ""), r"^\*\*([^*]+):\*\*\s*", "$1: ")
    shape = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("note"))
    row = F.when(line.rlike(title), shape("title", F.regexp_extract(line, title, 2))).when(line.rlike(head), shape("head", F.trim(F.regexp_extract(line, head, 1)))).when(line.rlike(item), shape("item", T.plain_note(said))).otherwise(shape("text", T.plain_note(F.trim(line))))
    return lines.select(key, F.col("pos").alias("ord"), row.alias("r")).select(key, "ord", "r.kind", "r.note")


def key_bindings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ord, action, grp, label, keys) of source texts with entries {actName, "group", "label"} and default
    lists actName: {"k", ...}; an action without a list has no keys. The last list of an action counts."""
    entry, default = r'\{\s*act(\w+)\s*,\s*"([^"]*)"\s*,\s*"([^"]*)"\s*\}', r"act(\w+)\s*:\s*\{([^}]*)\}"
    every = lambda p, i: F.regexp_extract_all(F.col(text), F.lit(p), F.lit(i))
    lists = F.arrays_zip(every(default, 1).alias("name"), every(default, 2).alias("body"))
    found = docs.select(key, lists.alias("lists"), F.posexplode(F.arrays_zip(every(entry, 1).alias("name"), every(entry, 2).alias("grp"), every(entry, 3).alias("label"))).alias("ord", "e"))
    body = F.try_element_at(F.filter("lists", lambda x: T.snake(x["name"]) == T.snake(F.col("e.name"))), F.lit(-1))["body"]
    keys = F.coalesce(F.regexp_extract_all(body, F.lit('"([^"]*)"'), F.lit(1)), F.array().cast("array<string>"))
    return found.select(key, "ord", T.snake(F.col("e.name")).alias("action"), "e.grp", "e.label", keys.alias("keys"))


def rewritten_links(docs: DataFrame, slugs: DataFrame, base: str, files: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, html): anchors that name a section of slugs (key, slug) lead to base/slug, links to Markdown files of
    the repository to files/path; others stay. One join on the key: a document's own slugs."""
    own = slugs.groupBy(key).agg(F.collect_set("slug").alias("__slugs"))
    parts = F.split(F.col(html), '(?=href="#[^"]+")')

    def moved(p: Column) -> Column:
        anchor = F.regexp_extract(p, r'\Ahref="#([^"]+)"', 1)
        known = (anchor != "") & F.coalesce(F.array_contains(F.col("__slugs"), anchor), F.lit(False))
        return F.when(known, F.concat(F.lit(f'href="{base}/'), F.substring(p, 8, 1 << 30))).otherwise(p)

    done = F.array_join(F.transform(parts, moved), "")
    done = F.regexp_replace(done, r'href="(?:\.\.?/)?([\w./-]*\.md)(#[^"]*)?"', f'href="{files}/$1$2"')
    return docs.join(own, key, "left").select(key, done.alias(html))
