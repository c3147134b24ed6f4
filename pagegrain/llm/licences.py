"""Operator 6, licence scans: known sentences to identifiers, identifier sequences to rules. Built-in functions only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import CATALOGUE, REFERENCE, SPDX, SPDX_IDS, identifier
from .common import table

def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _known(catalogue: tuple) -> dict[str, str]:
    """Sentences and references to their identifiers; a reference is a name behind @, an SPDX identifier behind #."""
    sentences, names, _ = catalogue
    spdx = {"#" + " ".join(re.findall("[a-z0-9]+", x.lower())): identifier(x) for x in SPDX_IDS}
    sentences = {re.sub("^" + REFERENCE, "@", s): i for s, i in sentences.items()}
    return sentences | {"@" + n: identifier(x) for n, x in names.items()} | spdx


def _cut(sentence: str, end: str = "") -> str:
    """SQL: a sentence with what introduces a reference replaced by its mark."""
    return f"regexp_replace(regexp_replace({sentence}, '^{REFERENCE}', '@'{end}), '^{SPDX}', '#'{end})"


def _wrapped(ids: tuple[str, ...]) -> str:
    return "".join(f",{i}," for i in ids)


def _outer(rules: tuple, ids: tuple[str, ...]) -> list[str]:
    """The sequences of longer rules that begin with this one's."""
    return [_wrapped(x) for _, _, x in rules if len(x) > len(ids) and x[: len(ids)] == ids]


def _masked(line: str, rules: tuple, ids: tuple[str, ...]) -> str:
    """SQL: the line of identifiers without those that longer rules match; places stay."""
    for x in _outer(rules, ids):
        line = f"replace({line}, {_quoted(x)}, {_quoted(re.sub('[^,]', '-', x))})"
    return line


def scanned(spark: SparkSession, docs: DataFrame, catalogue: tuple = CATALOGUE) -> DataFrame:
    """(doc_id, licence, kind, n_sentences, first_sentence): one row for each licence of a row of docs
    (doc_id, text) that some rule of the catalogue finds. n_sentences counts the document's known sentences,
    first_sentence is the place of the rule's first among them.

    A sentence begins and ends at a line feed, at ; or : before white space, or at . ! or ? before white space; any but
    the last may also come between its words, so that hard-wrapped and commented texts are read like running ones. Null
    and empty texts have none; repeated rows give their rows each; an empty table gives none. Every text is read whole.
    Where several rules of a licence match, the first of the catalogue counts; a rule doesn't match where a longer one
    that begins with its sequence does; other columns are ignored.
    The SQL takes each line for itself: it gives the same rows where no known sentence goes over a line's end or meets ; or :.
    """
    sentences, names, rules = catalogue
    known = "map(" + ", ".join(f"{_quoted(s)}, {_quoted(i)}" for s, i in _known(catalogue).items()) + ")"
    # Capitals are free once the text is folded: S stands for a sentence's end, L for a line's end.
    text = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    text = rf"concat('S', regexp_replace(regexp_replace({text}, r'[.!?][ \t\r\n]+', 'S'), r'\n|[;:][ \t\r\n]+', 'L'), 'S')"
    text = f"regexp_replace(regexp_replace({text}, '[^a-z0-9SL]+', ' '), '[ L]*S[ SL]*', ' S ')"
    text = f"regexp_replace({text}, ' ?L[ L]*', ' L ')"
    longest = lambda xs: "(?:" + "|".join(sorted(xs, key=len, reverse=True)) + ")"
    spdx = [k[1:] for k in _known(catalogue) if k[0] == "#"]
    pattern = "(?:" + "|".join((longest(sentences), REFERENCE + longest(names), SPDX + longest(spdx))) + ")"
    pattern = "(?<=[SL] )" + pattern.replace(" ", "(?: L)? ") + "(?= [SL])"
    one = _cut("replace(s, ' L', '')")
    found = docs.select("doc_id", F.expr(f"transform(regexp_extract_all({text}, '{pattern}', 0), s -> try_element_at({known}, {one})) ids"))
    found = found.select("doc_id", F.expr("size(ids)").cast("long").alias("n_sentences"), F.expr("array_join(transform(ids, i -> concat(',', i, ',')), '')").alias("line"))
    done = "array(" + ", ".join(
        f"named_struct('licence', {_quoted(name)}, 'kind', {_quoted(kind)}, 'at', locate({_quoted(_wrapped(ids))}, {_masked('line', rules, ids)}), 'ord', {k})" for k, (name, kind, ids) in enumerate(rules)
    ) + ")"
    first = f"filter({done}, r -> r.at > 0)"
    found = found.where("n_sentences > 0").select("doc_id", "n_sentences", "line", F.explode_outer(F.expr(
        f"transform(array({first}), all -> filter(all, r -> not exists(all, q -> q.licence = r.licence and q.ord < r.ord)))[0]")).alias("r")).where("r is not null")
    before = "substr(line, 1, r.at)"
    return found.selectExpr("doc_id", "r.licence licence", "r.kind kind", "n_sentences", f"cast((length({before}) - length(replace({before}, ',', '')) + 1) / 2 as bigint) first_sentence")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of all documents."""
    return scanned(spark, table(spark, sf_dir, "documents"))


_RULES = CATALOGUE[2]
ORACLE = f"""
with known(sentence, id) as (values {", ".join(f"({_quoted(s)}, {_quoted(i)})" for s, i in _known(CATALOGUE).items())}),
s as (select doc_id, unnest(p) as s, generate_subscripts(p, 1) as i from (select doc_id, string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.!?][ \\t\\r\\n]+', chr(10), 'g'), chr(10)) as p from documents)),
k as (select doc_id, i, id from s join known on sentence = {_cut("trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))")}),
d as (select doc_id, count(*) as n_sentences, string_agg(',' || id || ',', '' order by i) as line from k group by doc_id),
f as (select doc_id, n_sentences, line, unnest([{", ".join(f"{{'ord': {k}, 'licence': {_quoted(n)}, 'kind': {_quoted(kind)}, 'at': instr({_masked('line', _RULES, ids)}, {_quoted(_wrapped(ids))})}}" for k, (n, kind, ids) in enumerate(_RULES))}]) as r from d),
m as (select doc_id, r.licence as licence, r.kind as kind, n_sentences, line[1:r.at] as before, row_number() over (partition by doc_id, r.licence order by r.ord) as nth from f where r.at > 0)
select doc_id, licence, kind, n_sentences, ((length(before) - length(replace(before, ',', '')) + 1) // 2)::bigint as first_sentence from m where nth = 1
"""
