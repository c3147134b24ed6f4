"""Columns for versions, sizes, labels, language headers, checksums and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The letters of labels, in order.
LETTERS = "asdfghjkl"
#: Ranges of settings that are numbers (width may be 0 as well), the values of those that are words, and defaults.
RANGES = {"width": (40, 400), "spacing": (0, 2), "wheel_lines": (1, 20), "cache_days": (1, 3650), "history_limit": (50, 20000)}
CHOICES = {
    "links": ("footnotes", "inline", "hidden"), "footer_progress": ("both", "percent", "bar", "off"), "scroll_speed": ("slow", "normal", "fast"),
    "accent": ("blue", "cyan", "green", "magenta", "yellow", "red", "gray", "white", "orange", "violet", "teal", "pink", "lime", "slate"),
}
ENGINES = ("duckduckgo", "wikipedia", "github")
DEFAULTS = {
    "width": 100, "spacing": 1, "wheel_lines": 3, "cache_days": 30, "history_limit": 1000, "links": "footnotes", "footer_progress": "both", "scroll_speed": "normal", "accent": "blue",
    "search_engine": "duckduckgo", "center": True, "mouse": True, "history": True,
}


def version(c: Column) -> Column:
    """struct(x, y, z, pre) of a tag such as v1.2.3-rc1; null for what is no version of two or three numbers."""
    body = F.split_part(F.regexp_replace(F.trim(c), "^v", ""), F.lit("-"), F.lit(1))
    core = F.split_part(body, F.lit("+"), F.lit(1))
    n = lambda i: F.get(F.split(core, r"\."), F.lit(i)).cast("int")
    made = F.struct(n(0).alias("x"), n(1).alias("y"), F.coalesce(n(2), F.lit(0)).alias("z"), F.contains(c, F.lit("-")).alias("pre"))
    return F.when(core.rlike(r"\A[0-9]{1,9}\.[0-9]{1,9}(\.[0-9]{1,9})?\z"), made)


def _numbers(v: Column) -> Column:
    return F.struct(v.x, v.y, v.z)


def newer(latest: Column, current: Column) -> Column:
    """Whether a release proper is newer than what runs: by its numbers, or the release of a forerunner of the same numbers."""
    a, b = version(latest), version(current)
    return F.coalesce(~a.pre & ((_numbers(a) > _numbers(b)) | ((_numbers(a) == _numbers(b)) & b.pre)), F.lit(False))


def same_version(one: Column, two: Column) -> Column:
    a, b = version(one), version(two)
    return F.coalesce(~a.pre & ~b.pre & (_numbers(a) == _numbers(b)), F.lit(False))


def human_size(n: Column) -> Column:
    """Bytes, KB or MB; a half goes to the even digit."""
    said = lambda unit, of: F.format_string(f"%.1f {unit}", F.bround(n / F.lit(float(of)), 1))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, said("KB", 1 << 10)).otherwise(said("MB", 1 << 20))


def hint_labels(n: Column) -> Column:
    """Labels of n links: single letters where they suffice, else pairs in order, as many as there are pairs."""
    k, letter = len(LETTERS), lambda i: F.substr(F.lit(LETTERS), i.cast("int") + 1, F.lit(1))
    one = lambda i: F.when(n <= k, letter(i)).otherwise(F.concat(letter(F.floor(i / k)), letter(i % k)))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.least(n, F.lit(k * k)).cast("int") - 1), one)).otherwise(F.array().cast("array<string>"))


def accept_language(locale: Column) -> Column:
    """The header of a locale: its language and region, then the language, then English."""
    base = F.split_part(F.coalesce(locale, F.lit("")), F.lit("."), F.lit(1))
    lang = F.split_part(base, F.lit("_"), F.lit(1))
    plain = base.isin("", "C", "POSIX") | (lang == "en")
    return F.when(plain, "en").when(F.contains(base, F.lit("_")), F.concat(F.replace(base, F.lit("_"), F.lit("-")), F.lit(", "), lang, F.lit(";q=0.9, en;q=0.6"))).otherwise(F.concat(base, F.lit(", en;q=0.6")))


def checksum_for(sums: Column, name: Column) -> Column:
    """The digest, in small letters, of the first line of sums (digest, blanks, name with or without a star) that has that name; empty if none has."""
    fields = lambda line: F.filter(F.split(line, r"\s+"), lambda x: x != "")
    own = lambda f: (F.size(f) == 2) & (F.regexp_replace(F.get(f, F.lit(1)), r"^\*", "") == name)
    found = F.get(F.filter(F.transform(F.split(sums, "\n"), fields), own), F.lit(0))
    return F.coalesce(F.lower(F.get(found, F.lit(0))), F.lit(""))


def normalised_settings(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, name, value) of settings (keep, name, value as JSON): every name of DEFAULTS for each keep, in its kind and range. A value of another kind, a word that
    isn't one of a setting's, and a search address without a place for the words give the default; numbers are held in their range; unknown names go; of a repeated
    name the greatest value counts."""
    said = rows.groupBy(*keep, "name").agg(F.max("value").alias("said"))
    every = rows.select(*keep).distinct().select(*keep, F.explode(F.create_map(*[F.lit(x) for k, v in DEFAULTS.items() for x in (k, _json(v))])).alias("name", "default"))
    both = every.join(said, [*keep, "name"], "left")
    number = F.when(F.col("said").rlike(r"\A-?[0-9]{1,9}\z"), F.col("said").cast("int"))
    word = F.when(F.col("said").rlike(r'\A"[^"\\]*"\z'), F.expr("substr(said, 2, char_length(said) - 2)"))
    value = F.lit(None).cast("string")
    for k, (lo, hi) in RANGES.items():
        held = F.least(F.greatest(number, F.lit(lo)), F.lit(hi))
        value = F.when((F.col("name") == k) & number.isNotNull(), (F.when(number == 0, 0).otherwise(held) if k == "width" else held).cast("string")).otherwise(value)
    for k, words in CHOICES.items():
        value = F.when((F.col("name") == k) & word.isin(*words), F.col("said")).otherwise(value)
    value = F.when((F.col("name") == "search_engine") & (word.isin(*ENGINES) | F.contains(word, F.lit("%s"))), F.col("said")).otherwise(value)
    switches = [k for k, v in DEFAULTS.items() if isinstance(v, bool)]
    value = F.when(F.col("name").isin(*switches) & F.col("said").isin("true", "false"), F.col("said")).otherwise(value)
    return both.select(*keep, "name", F.coalesce(value, "default").alias("value"))


def _json(v: object) -> str:
    import json

    return json.dumps(v)
