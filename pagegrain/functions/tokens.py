"""Code as coloured tokens, by rules that many languages share."""

from __future__ import annotations

import re

_WORDS = "and as async await break case catch class const continue def default del do elif else enum except export extends false finally fn for from func function go if impl import in interface is lambda let loop match mod mut new nil none not null or package pass private protected public pub raise return select self static struct super switch this throw true try type use using var void where while with yield"
_KEYWORDS = frozenset(_WORDS.split())
_TOKEN = re.compile(
    r"""(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*|\#[^\n]*|--[^\n]*)|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`[^`]*`?)|(?P<number>\b\d[\w.]*)|(?P<name>[^\W\d]\w*)|(?P<space>\s+)|(?P<mark>.)""", re.S | re.X
)


#: Colours of token kinds, as SGR codes; what isn't listed keeps the text's own.
COLOURS = {"comment": "2;3", "string": "32", "number": "33", "keyword": "1;35"}


def coloured(code: str) -> str:
    """Code with its tokens' colours as terminal escapes."""
    return "".join(f"\x1b[{COLOURS[k]}m{t}\x1b[0m" if k in COLOURS else t for k, t in tokens(code))


def tokens(code: str) -> list[tuple[str, str]]:
    """(kind, text) whose texts join to the code: comment, string, number, keyword, name, space or mark."""
    found = ((m.lastgroup, m[0]) for m in _TOKEN.finditer(code))
    return [("keyword" if kind == "name" and text.lower() in _KEYWORDS else kind, text) for kind, text in found]
