"""Text expressions: inline Markdown, slugs, escapes, addresses. All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Search engines by name; any other text with %s is a template, the first engine the default.
ENGINES = {"duckduckgo": "https://html.duckduckgo.com/html/?q=%s", "wikipedia": "https://en.wikipedia.org/w/index.php?search=%s", "github": "https://github.com/search?q=%s"}
#: Host endings of one's own network.
OWN_HOSTS = ("localhost", "local", "test", "internal", "lan")


def _replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, by in pairs:
        c = F.regexp_replace(c, pattern, by)
    return c


def plain_text(c: Column) -> Column:
    """Inline Markdown's text: code, bold, emphasis and links give what they show."""
    return F.trim(_replaced(c, (r"`([^`]*)`", "$1"), (r"\*\*([^*]*)\*\*", "$1"), (r"\*([^*]*)\*", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1")))


def plain_body(c: Column) -> Column:
    """plain_text() of a whole body: besides, fenced code, images, tags, heading and list marks go and blanks are
    one space."""
    c = _replaced(c, (r"(?s)```.*?```", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"<[^>]*>", " "), (r"(?m)^\s*(?:#{1,6}|[-*+]|\d+\.|>)\s+", ""), (r"\|", " "))
    return F.trim(F.regexp_replace(plain_text(c), r"\s+", " "))


def plain_note(c: Column) -> Column:
    """A release note's text: links give their text, bold marks and backticks go."""
    return _replaced(c, (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"\*\*|`", ""), (r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", ""))


def slug(c: Column) -> Column:
    return F.regexp_replace(_replaced(F.lower(c), (r"[ _-]+", "-"), (r"[^\p{L}\p{Nd}-]", "")), "-+$", "")


def cell_text(c: Column) -> Column:
    return F.trim(_replaced(c, (r"`([^`]*)`", "$1"), (r"\*\*([^*]*)\*\*", "$1")))


def inline_html(c: Column) -> Column:
    """Escaped text, code spans as elements."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return F.regexp_replace(c, "`([^`]*)`", "<code>$1</code>")


def stripped_links(c: Column) -> Column:
    """Links and images give the text that they show, brackets in it unescaped; the rest stays as it is. Control characters 1 and 2, which sanitising takes out, must not
    be there: they mark the texts in between."""
    marked = F.regexp_replace(c, r"!?\[((?:[^\]\\]|\\.)*)\]\([^)]*\)", "\x01$1\x02")
    shown = lambda x: F.replace(F.replace(F.substring_index(x, "\x02", 1), F.lit("\\["), F.lit("[")), F.lit("\\]"), F.lit("]"))
    rest = lambda x: F.substr(x, F.locate("\x02", x) + 1)
    return F.array_join(F.transform(F.split(marked, "\x01"), lambda x, i: F.when(i == 0, x).otherwise(F.concat(shown(x), rest(x)))), "")


def md_escape(c: Column) -> Column:
    """One line, with brackets, backslashes and backticks escaped."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"([\[\]\\`])", r"\\$1")


def without_frontmatter(c: Column) -> Column:
    return F.regexp_replace(c, r"\A---\r?\n[\s\S]*?\r?\n---\r?\n?", "")


def snake(c: Column) -> Column:
    return F.lower(_replaced(c, (r"([a-z0-9])([A-Z])", "$1_$2"), (r"([A-Z]+)([A-Z][a-z])", "$1_$2")))


def _authority(c: Column) -> Column:
    return F.regexp_extract(c, r"\A([^/?#]*)", 1)


def looks_like_host(c: Column) -> Column:
    """A host, with or without port and path: no blanks, an inner dot (or localhost), digits as the port."""
    return F.coalesce(~c.rlike(r"[ \t]") & (_authority(c).rlike(r"(?i)\Alocalhost(:.*)?\z") | _authority(c).rlike(r"\A(?!\.)(?=[^:]*\.)[\p{L}\p{Nd}.-]*(?<!\.)(:\p{Nd}*)?\z")), F.lit(False))


def is_local_host(c: Column) -> Column:
    """A name of this machine or its own network, or a loopback, private or link-local address."""
    host = F.lower(F.substring_index(_authority(c), ":", 1))
    octet = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    names = host.rlike(r"\A(localhost|.*\.(" + "|".join(OWN_HOSTS) + r"))\z")
    ranges = rf"\A(127\.{octet}|10\.{octet}|172\.(1[6-9]|2\d|3[01])|192\.168|169\.254)(\.{octet})" + r"{2}\z"
    return F.coalesce(names | host.rlike(ranges), F.lit(False))


def search_url(query: Column, engine: str = "duckduckgo") -> Column:
    template = ENGINES.get(engine) or (engine if "%s" in engine else ENGINES["duckduckgo"])
    before, after = template.split("%s", 1)
    return F.concat(F.lit(before), F.replace(F.replace(F.url_encode(query), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")), F.lit(after))


def resolved_input(c: Column, engine: str = "duckduckgo", home: str = "/", is_file: Column | None = None) -> Column:
    """struct(target, is_search) of what was typed: an address, a path, a host (http on one's own network, else
    https), or words to search for. Blank gives an empty target. is_file: whether a bare name is a file."""
    s = F.trim(F.regexp_replace(c, r"\A\s+|\s+\z", ""))
    path = F.when(s.startswith("~/"), F.concat(F.lit(home.rstrip("/")), F.substring(s, 2, 1 << 30))).otherwise(s)
    kind = (
        F.when(s.rlike(r"\A(https?|file)://"), F.struct(s.alias("target"), F.lit(False).alias("is_search")))
        .when(s == "", F.struct(F.lit("").alias("target"), F.lit(False).alias("is_search")))
        .when(path.rlike(r"\A(/|\./|\.\./)") | (F.lit(False) if is_file is None else F.coalesce(is_file, F.lit(False))), F.struct(F.concat(F.lit("file://"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(home.rstrip("/") + "/"), F.regexp_replace(path, r"\A\./", "")))).alias("target"), F.lit(False).alias("is_search")))
        .when(looks_like_host(s), F.struct(F.concat(F.when(is_local_host(s), "http://").otherwise("https://"), s).alias("target"), F.lit(False).alias("is_search")))
        .otherwise(F.struct(search_url(s, engine).alias("target"), F.lit(True).alias("is_search")))
    )
    return F.when(c.isNotNull(), kind)


def split_fragment(c: Column) -> Column:
    """struct(address, fragment) of an address, cut at its first #; without one the fragment is empty."""
    return F.when(c.isNotNull(), F.struct(F.regexp_extract(c, r"\A([^#]*)", 1).alias("address"), F.regexp_extract(c, r"\A[^#]*#([\s\S]*)\z", 1).alias("fragment")))


def local_path(c: Column) -> Column:
    """The path of a file: address, without fragment and query and with its escapes undone; null for others."""
    path = F.regexp_extract(c, r"(?i)\Afile:(?://(?:localhost)?)?(/[^?#]*)", 1)
    return F.when(path != "", F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def visit_title(title: Column, url: Column) -> Column:
    """A visit's title, or its address where that is null or blank."""
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), url)


def word_bounds(line: Column, at: Column) -> Column:
    """struct(start, stop) of the word at code point `at` of a line, from 0; on another character, that alone; null
    beyond the line."""
    letter = F.substring(line, at + 1, F.lit(1)).rlike(r"[\p{L}\p{N}_]")
    before = F.length(F.regexp_extract(F.substring(line, F.lit(1), at), r"([\p{L}\p{N}_]*)\z", 1))
    after = F.length(F.regexp_extract(F.substring(line, at + 1, F.length(line)), r"\A([\p{L}\p{N}_]*)", 1))
    found = F.when(letter, F.struct((at - before).cast("int").alias("start"), (at + after).cast("int").alias("stop"))).otherwise(F.struct(at.cast("int").alias("start"), (at + 1).cast("int").alias("stop")))
    return F.when((at >= 0) & (at < F.length(line)), found)


def read_percent(top: Column, height: Column, total: Column) -> Column:
    """How much of `total` lines is above the end of a view of `height` lines from `top`, in whole percent; 100 where
    everything fits."""
    return F.when(total <= height, F.lit(100)).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), F.floor((top * 100) / (total - height))))).cast("int")


def scroll_thumb(top: Column, height: Column, total: Column) -> Column:
    """struct(at, size) of a scroll bar's thumb over `height` cells; as tall as the bar where everything fits."""
    size = F.greatest(F.lit(1), F.floor(height * height / F.greatest(total, F.lit(1))))
    room = F.greatest(F.lit(0), total - height)
    at = F.when(room > 0, F.floor((height - size) * F.least(top, room) / room)).otherwise(F.lit(0))
    return F.when(total > height, F.struct(at.cast("int").alias("at"), size.cast("int").alias("size"))).otherwise(F.struct(F.lit(0).alias("at"), height.cast("int").alias("size")))


def progress_cells(share: Column, width: int = 20) -> Column:
    """A bar of `width` cells, filled to `share` (0 to 1)."""
    full = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def layout_signature(width: Column, link_mode: Column, theme: Column, content: Column) -> Column:
    """What a layout depends on, as one key: a layout of an equal key may be used again."""
    return F.sha2(F.concat_ws("\0", width.cast("string"), F.coalesce(link_mode, F.lit("")), F.coalesce(theme, F.lit("")), F.coalesce(content, F.lit(""))), 256)


def one_of(c: Column, *allowed: str) -> Column:
    """c where it is one of the values, else the first of them."""
    return F.when(c.isin(*allowed), c).otherwise(F.lit(allowed[0]))


def without_colours(c: Column) -> Column:
    """A text without terminal escapes."""
    return F.regexp_replace(c, r"\x1b(\[[0-9;?]*[ -/]*[@-~]|\][^\x07\x1b]*(\x07|\x1b\\))", "")


def open_colours(c: Column) -> Column:
    """The colour codes that hold at a text's end: those after its last reset, in order."""
    codes = F.regexp_extract_all(c, F.lit(r"\x1b\[([0-9;]*)m"), F.lit(1))
    reset = F.array_position(F.reverse(F.transform(codes, lambda x: x.rlike(r"\A0*\z"))), True)
    return F.when(reset == 0, codes).otherwise(F.slice(codes, F.size(codes) - reset.cast("int") + 2, F.greatest(reset.cast("int") - 1, F.lit(0))))
