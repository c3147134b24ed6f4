"""HTML to Markdown: a small tree, cleaning passes, and a serialiser.

A page is cut into tags and texts by one pattern and read in one pass. Elements nested deeper than DEPTH become
siblings of the last that isn't, as in browsers, so that no page, however nested, costs more than its size or
ends in an error; their texts stay.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from urllib.parse import urljoin

DEPTH = 300
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never content, class tokens and roles of page furniture.
DROPPED = frozenset("script style noscript nav aside footer svg button iframe template dialog select input textarea label".split())
JUNK = frozenset("toc table-of-contents breadcrumb breadcrumbs sidebar cookie cookies related newsletter social share sharing advert advertisement footer".split())
ROLES = frozenset(("navigation", "banner", "contentinfo"))
BLOCKS = frozenset("address article blockquote body dd div dl dt figure figcaption form h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section table tbody td tfoot th thead tr ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset(("ul", "ol", "dl", "table", "body", "html"))
#: Elements whose content is text up to their end tag; in those of the second set entities count.
_RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
_RAW_ENTITIES = frozenset(("title", "textarea"))
#: A comment's start; a tag with its name and attributes, where > in quotes doesn't end it; or what no reader shows.
_TAG = re.compile(r"""<(?:!--|(/?)([a-zA-Z][^\s/>]*+)((?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>|[!?][^>]*+>?|/[^a-zA-Z][^>]*+>?)""")
_ATTR = re.compile(r"""([^\s=>/"'][^\s=>/]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")


#: What becomes of an element when its parent is settled: it stays, goes, or gives way to its own content; OUT is past.
STAYS, GOES, OPENS, OUT = range(4)


class Node:
    __slots__ = ("tag", "attrs", "kids", "up", "depth", "fate")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, up: Node | None = None):
        self.tag, self.attrs, self.kids, self.up = tag, attrs or {}, [], up
        self.depth, self.fate = up.depth + 1 if up is not None else 0, STAYS

    def walk(self):
        """All elements below, in document order."""
        todo = [k for k in reversed(self.kids) if type(k) is Node]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(k for k in reversed(n.kids) if type(k) is Node)

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def text(self) -> str:
        """What a reader sees: blocks are set off by blanks, elements that are never content give nothing."""
        out: list[str] = []
        todo = self.kids[::-1]
        while todo:
            k = todo.pop()
            if type(k) is str:
                out.append(k)
            elif k.tag == "br":
                out.append("\n")
            elif k.tag not in DROPPED:
                if k.tag in BLOCKS:
                    out.append(" ")
                    todo.append(" ")
                todo.extend(reversed(k.kids))
        return "".join(out)

    def weight(self) -> int:
        return len(self.text().split())

    def meets(self, fate: int, changed: dict[int, Node]) -> None:
        """Marks an element that still stands in its tree, and its parent as changed."""
        if self.up is not None and self.fate == STAYS:
            self.fate = fate
            changed[id(self.up)] = self.up


def settle(changed: dict[int, Node]) -> None:
    """Takes the marked children of changed elements out, or puts their content in their place; each list of children is made anew once."""
    for up in changed.values():
        kids, todo = [], up.kids[::-1]
        while todo:
            k = todo.pop()
            if type(k) is str or k.fate == STAYS:
                kids.append(k)
                if type(k) is Node:
                    k.up = up
            elif k.fate == OPENS:
                k.fate = OUT
                todo.extend(reversed(k.kids))
            else:
                k.fate = OUT
        up.kids = kids
    changed.clear()


def _attributes(said: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTR.findall(said):
        value = values[0] or values[1] or values[2]
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return found


def parse(html: str) -> Node:
    root = at = Node("html")
    pos, n, deep = 0, len(html), []  # deep: open elements below DEPTH, which are only counted
    ends: dict[str, re.Pattern] = {}
    while pos < n:
        m = _TAG.search(html, pos)
        text = html[pos : m.start()] if m else html[pos:]
        if text:
            at.kids.append(unescape(text) if "&" in text else text)
        if m is None:
            break
        pos = m.end()
        if m[2] is None:
            if m[0] == "<!--":
                end = html.find("-->", pos)
                pos = n if end < 0 else end + 3
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in deep:
                while deep.pop() != tag:
                    pass
                continue
            up = at
            while up is not None and up.tag != tag:
                up = up.up
            if up is not None and up.up is not None:
                at = up.up
                deep.clear()
            continue
        closes = _CLOSES.get(tag) or ({"p"} if tag in BLOCKS and tag not in ("html", "body") else ())
        for names in (closes, {"p"}) if closes and tag in _CLOSES and tag in BLOCKS else (closes,):
            up = at
            while names and up is not None and up.tag not in _SCOPE:
                if up.tag in names:
                    at = up.up or root
                    break
                up = up.up
        node = Node(tag, _attributes(m[3]) if m[3] and not m[3].isspace() else None, at)
        at.kids.append(node)
        if tag in _RAW:
            if tag not in ends:
                ends[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I)
            close = ends[tag].search(html, pos)
            inner = html[pos : close.start()] if close else html[pos:]
            pos = close.end() if close else n
            if inner:
                node.kids.append(unescape(inner) if tag in _RAW_ENTITIES and "&" in inner else inner)
        elif tag not in VOID and not m[3].endswith("/"):
            if node.depth < DEPTH:
                at = node
            else:
                deep.append(tag)
    return root


def pick_root(tree: Node) -> tuple[Node, bool]:
    """The content's element, and whether it is an article: the heaviest outermost article if it holds 60 % of
    all articles' words and the page has less than five times its words; else main, or body."""
    body = box = None
    articles: list[Node] = []
    for n in tree.walk():
        if n.tag == "article":
            articles.append(n)
        elif body is None and n.tag == "body":
            body = n
        if box is None and (n.tag == "main" or n.attrs.get("role") == "main"):
            box = n
    box = box or body or tree
    outermost = []
    for n in articles:
        up = n.up
        while up is not None and up is not box and up.tag != "article":
            up = up.up
        if up is box:
            outermost.append((n.weight(), n))
    if not outermost:
        return box, False
    best, node = max(outermost, key=lambda x: x[0])
    return (node, True) if best * 100 >= sum(w for w, _ in outermost) * 60 and box.weight() < 5 * best else (box, False)


def has_junk_class(value: str) -> bool:
    return any(t in JUNK or t.startswith("cookie") or any(t.startswith((j + "-", j + "_")) for j in JUNK) for t in value.lower().split())


def _hidden(n: Node) -> bool:
    style = re.sub(r"\s", "", n.attrs.get("style", "").lower())
    return ("hidden" in n.attrs and n.attrs["hidden"] != "until-found") or n.attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


def clean(root: Node, is_article: bool) -> None:
    """Takes page furniture out of a root. What holds more than half of the root's words always stays."""
    nodes, header, changed = [], False, {}
    for n in root.walk():
        if n.tag in DROPPED or n.tag == "title":
            n.meets(GOES, changed)
        elif n.attrs and (_hidden(n) or n.attrs.get("role") in ROLES or has_junk_class(n.attrs.get("class", ""))):
            nodes.append(n)
        header |= n.tag == "header"
    settle(changed)
    total = root.weight() if nodes else 0
    for n in nodes:
        if n.weight() * 2 <= total:
            n.meets(GOES, changed)
    settle(changed)
    if header and not is_article:
        kept = False
        for n in root.find("header"):
            h = next(iter(n.find("h1")), None)
            if h is not None and not kept and n.up is not None:
                n.up.kids[n.up.kids.index(n)] = h
                h.up, kept = n.up, True
            else:
                n.meets(GOES, changed)
        settle(changed)


#: Class patterns that name a code's language outright, and those trusted only for a known language.
_LANG = (
    re.compile(r"(?i)(?:^|\s)(?:language|lang|highlight-source|brush)[-:_ ]+([\w+#.-]+)"),
    re.compile(r"(?i)(?:^|\s)sourceCode\s+([\w+#-]+)"),
)
_WEAK_LANG = (
    re.compile(r"(?i)(?:^|\s)mw-highlight-lang-([\w+#-]+)"),
    re.compile(r"(?i)(?:^|\s)highlight-([\w+#-]+)"),
)
_KNOWN = frozenset("bash c cpp csharp css diff dockerfile go html java javascript json kotlin lua makefile markdown php python r ruby rust scala sql swift toml typescript xml yaml".split())
#: Classes of widgets in code, of line number cells and of hidden labels; permalink texts; skip links.
_WIDGET = re.compile(r"(?i)line-?no|line-?num|gutter|copy|clipboard")
_GUTTER = re.compile(r"(?i)(?:^|[\s_-])(?:line-?nos?|line-?numbers?|linenos|gutter)(?:$|[\s_-])")
_PERMALINKS = frozenset(("", "¶", "#", "§", "¤", "🔗", "∞", "⚓", "permalink", "link", "anchor", "copy link"))
_PERMALINK_STARTS = ("link to this", "direct link to", "permalink to")
_SKIP_LINK = re.compile(r"(?i)^\s*(skip|jump) to (the )?(main |primary )?(content|navigation|menu|search|footer)")
#: Short names of languages; an empty one means none.
_ALIAS = {
    "shell": "bash", "sh": "bash", "zsh": "bash", "console": "bash", "shellsession": "bash",
    "golang": "go", "js": "javascript", "ts": "typescript", "yml": "yaml", "py": "python",
    "docker": "dockerfile", "text": "", "plaintext": "", "txt": "",
    "ipython": "python", "ipython3": "python", "python3": "python", "py3": "python", "pycon": "python",
    "cs": "csharp", "nodejs": "javascript", "none": "", "default": "",
}
#: Our own additions.
_ALIAS |= {"rb": "ruby", "c++": "cpp"}


def _named(n: Node) -> str:
    """The language that an element declares, by attribute or class, or an empty string."""
    if said := n.attrs.get("data-language") or n.attrs.get("data-lang"):
        return said
    classes = n.attrs.get("class", "")
    if not classes:
        return ""
    sure = (m[1] for p in _LANG if (m := p.search(classes)))
    known = (m[1] for p in _WEAK_LANG if (m := p.search(classes)) and _ALIAS.get(m[1].lower(), m[1].lower()) in _KNOWN)
    return next(sure, "") or next(known, "")


def code_language(pre: Node) -> str:
    """The language that a code block, its code element or one of its next three ancestors declares."""
    places = [pre, *pre.find("code")[:1]]
    up = pre.up
    while up is not None and len(places) < 5:
        places.append(up)
        up = up.up
    found = next(filter(None, map(_named, places)), "").lower()
    return _ALIAS.get(found, found)


def fence(code: str, lang: str) -> str:
    mark = "`" * max(3, max((len(x) for x in re.findall("`+", code)), default=0) + 1)
    return f"{mark}{lang}\n{code}\n{mark}"


def _raw(n: Node) -> str:
    out: list[str] = []
    todo = n.kids[::-1]
    while todo:
        k = todo.pop()
        if type(k) is str:
            out.append(k)
        elif k.tag == "br":
            out.append("\n")
        else:
            todo.extend(reversed(k.kids))
    return "".join(out)


def _code(pre: Node) -> str:
    """A code block's text. Where its lines are block elements, each ends a line."""
    if not pre.find("div", "p", "li", "tr"):
        return _raw(pre)
    out: list[str] = []

    def add(n: Node) -> None:
        for k in n.kids:
            if isinstance(k, str):
                out.append(k)
            elif k.tag == "br":
                out.append("\n")
            else:
                add(k)
                last = next((x for x in reversed(out) if x), "\n")
                if k.tag in ("div", "p", "li", "tr") and not last.endswith("\n"):
                    out.append("\n")

    add(next(iter(pre.find("code")), pre))
    return "".join(out)


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_BLANKS = re.compile(r"\s{2,}|[^\S ]")


def tidy(root: Node, title: str) -> None:
    """Takes what readers don't see or need out of code, headings, images and links; cards' links move to their
    heading, or else to their first block."""
    by: dict[str, list[Node]] = {}
    changed: dict[int, Node] = {}
    for n in root.walk():
        by.setdefault("h" if n.tag in _HEADINGS else n.tag, []).append(n)
    for pre in by.get("pre", ()):
        for n in list(pre.walk()):
            if _WIDGET.search(n.attrs.get("class", "")):
                n.meets(GOES, changed)
    settle(changed)
    for figure in by.get("figure", ()):
        if figure.find("pre"):
            for n in (x for c in figure.find("figcaption") for x in c.walk()):
                if {"sr-only", "visually-hidden"} & set(n.attrs.get("class", "").split()):
                    n.meets(GOES, changed)
    settle(changed)
    for table in by.get("table", ()):
        if table.find("pre"):
            for cell in table.find("td", "th"):
                if _GUTTER.search(cell.attrs.get("class", "")):
                    cell.meets(GOES, changed)
    settle(changed)
    for h in by.get("h", ()):
        for a in h.find("a"):
            said = _raw(a).strip().lower()
            if said in _PERMALINKS or said.startswith(_PERMALINK_STARTS):
                a.meets(GOES, changed)
            elif a.attrs.get("href", "").strip().startswith("#"):
                a.meets(OPENS, changed)
    settle(changed)
    for img in by.get("img", ()):
        if img.attrs.get("alt", "").strip().lower() in title.lower():
            img.meets(GOES, changed)
    settle(changed)
    for a in by.get("a", ()):
        said = " ".join(_raw(a).split())
        if (not said and not a.find("img")) or (len(said) < 40 and _SKIP_LINK.search(said)):
            a.meets(GOES, changed)
            continue
        if all(type(k) is str for k in a.kids):
            continue
        for br in a.find("br"):
            br.tag, br.kids = "span", [" "]
        leaves = [n for n in a.walk() if n.tag in BLOCKS and _raw(n).strip() and not any(x.tag in BLOCKS for x in n.walk())]
        if a.attrs.get("href") and leaves:
            best = next((n for n in leaves if n.tag in _HEADINGS), leaves[0])
            link = Node("a", a.attrs, best)
            link.kids, best.kids = best.kids, [link]
            a.meets(OPENS, changed)
    settle(changed)


@lru_cache(maxsize=4096)
def absolute(base: str, href: str) -> str:
    """href against base; where either is no address, href as it is."""
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def _inline(n: Node, base: str) -> str:
    out = []
    for k in n.kids:
        if type(k) is str:
            out.append(_BLANKS.sub(" ", k))
            continue
        inner = _BLANKS.sub(" ", k.kids[0]) if len(k.kids) == 1 and type(k.kids[0]) is str else _inline(k, base)
        if k.tag == "br":
            out.append("\n")
        elif k.tag == "img":
            out.append(f"[image: {k.attrs['alt'].strip()}]" if k.attrs.get("alt", "").strip() else "")
        elif k.tag == "a" and inner.strip():
            out.append(f"[{inner.strip()}]({absolute(base, k.attrs['href'])})" if k.attrs.get("href") and not k.attrs["href"].startswith("javascript:") else inner)
        elif k.tag in ("b", "strong", "i", "em", "del", "s", "strike") and inner.strip():
            mark = "**" if k.tag in ("b", "strong") else "*" if k.tag in ("i", "em") else "~~"
            out.append(inner[: len(inner) - len(inner.lstrip())] + mark + inner.strip() + mark + inner[len(inner.rstrip()) :])
        elif k.tag == "code":
            out.append(f"`{_raw(k)}`")
        else:
            out.append(f" {inner} " if k.tag in BLOCKS else inner)
    return "".join(out)


def _lines(text: str) -> str:
    return "\n".join((_BLANKS.sub(" ", x) if "  " in x else x).strip() for x in text.split("\n")).strip()


def _table(n: Node, base: str) -> str:
    def span(c: Node, name: str) -> int:
        said = c.attrs.get(name, "1").strip()
        return min(max(int(said), 1), 50) if said.isdecimal() else 1

    rows, covered = [], {}  # covered: rows that a cell above still takes, by column
    trs, todo = [], [k for k in reversed(n.kids) if type(k) is Node]
    while todo:  # this table's own rows: those of a table in a cell are that cell's text
        k = todo.pop()
        if k.tag == "tr":
            trs.append(k)
        elif k.tag != "table":
            todo.extend(x for x in reversed(k.kids) if type(x) is Node)
    for tr in trs:
        row: list[str] = []

        def skip() -> None:
            while covered.get(len(row), 0):
                covered[len(row)] -= 1
                row.append("")

        for c in (k for k in tr.kids if isinstance(k, Node) and k.tag in ("td", "th")):
            skip()
            items = [" ".join(_inline(li, base).split()) for li in c.find("li")]
            wide, high = span(c, "colspan"), span(c, "rowspan")
            covered |= {len(row) + i: high - 1 for i in range(wide) if high > 1}
            row.append((" · ".join(items) if items else " ".join(_inline(c, base).split())).replace("|", "\\|"))
            row.extend([""] * (wide - 1))
        skip()
        rows.append(row)
    width = max((len(r) for r in rows), default=0)
    if not width:
        return ""
    out = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([out[0], "|" + " --- |" * width, *out[1:]])


def blocks(n: Node, base: str, depth: int = 0) -> list[tuple[str, str]]:
    """(kind, Markdown) of a root's blocks, in order."""
    out: list[tuple[str, str]] = []
    run = Node("span")

    def flush() -> None:
        text = _lines(_inline(run, base))
        if text:
            out.append(("paragraph", text))
        run.kids = []

    for k in n.kids:
        if isinstance(k, str) or (k.tag not in BLOCKS and not any(x.tag in BLOCKS for x in k.walk())):
            run.kids.append(k)
            continue
        flush()
        if k.tag in _HEADINGS:
            if text := " ".join(_inline(k, base).split()):
                out.append(("heading", "#" * int(k.tag[1]) + " " + text))
        elif k.tag == "pre":
            out.append(("code", fence(_code(k).strip("\n").replace("\x1b", "␛"), code_language(k))))
        elif k.tag in ("ul", "ol"):
            items = []
            for i, li in enumerate((x for x in k.kids if isinstance(x, Node) and x.tag == "li"), 1):
                body = "\n".join(m for _, m in blocks(li, base, depth + 1))
                if body.strip():
                    items.append((f"{i}. " if k.tag == "ol" else "- ") + body.replace("\n", "\n  "))
            if items:
                out.append(("list", "\n".join(items)))
        elif k.tag == "table":
            if text := _table(k, base):
                out.append(("table", text))
        elif k.tag == "blockquote":
            if inner := "\n\n".join(m for _, m in blocks(k, base)):
                out.append(("quote", "\n".join("> " + x if x else ">" for x in inner.split("\n"))))
        elif k.tag == "hr":
            out.append(("rule", "---"))
        else:
            out.extend(blocks(k, base, depth))
    flush()
    return out


_CONTROL = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f]")


#: Words that lead to other pages.
_PAGER = frozenset("next previous prev up back home".split())
_MD_LINK = re.compile(r"!?\[((?:[^\]\\]|\\.)*)\]\([^)]*\)")
_LINKS_ONLY = re.compile(r"[ \t]*(?:\[[^\]]*\]\([^)]*\)[ \t]*){4,}")
_LABEL = re.compile(r"(?=.{1,30}\Z)[^\s.!?:;\[\]()`*_<>|]+(?: [^\s.!?:;\[\]()`*_<>|]+){0,3}")
#: The most blocks that a page may open with before its content, and the cells of a navigation item.
_OPENING, _ITEM = 3, 40


def _leads_away(kind: str, text: str) -> float:
    """How surely a block only leads elsewhere, by what it says outside of its links: 1 for several links and
    nothing else, or links and pager words; a half for one link alone or a short list of short items, which may also be content."""
    if kind == "list":
        items = [_MD_LINK.sub(r"\1", x) for x in text.split("\n")]
        return 0.5 if 2 <= len(items) <= 5 and all(x[:1] in "-*+0123456789" and len(x.partition(" ")[2]) <= _ITEM for x in items) else 0
    links = len(_MD_LINK.findall(text))
    if kind != "paragraph" or not links or "\n" in text:
        return 0
    said = re.findall(r"\w+", _MD_LINK.sub(" ", text).lower())
    return 0 if not _PAGER.issuperset(said) else 1 if links + len(said) > 1 else 0.5 if len(text.partition("](")[0]) <= _ITEM + 1 else 0


def _opening(found: list[tuple[str, str]]) -> int:
    """How many blocks a page opens with that aren't its content: those that surely lead away, and up to a heading
    close by what may do so, with labels of a few words between."""
    sure = [_leads_away(*b) for b in found[:_OPENING]]
    n = next((i for i, x in enumerate(sure) if x < 1), len(sure))
    heading = next((i for i, (kind, _) in enumerate(found[: _OPENING + 1]) if kind == "heading"), 0)
    between = range(n, heading)
    if all(sure[i] or (i and found[i][0] == "paragraph" and _LABEL.fullmatch(found[i][1])) for i in between):
        n = max(n, heading)
    return n if n < len(found) else 0


def trimmed(found: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Blocks without what a page opens with before its content, lines of four links and more and nothing else,
    and rules right under the title."""
    out: list[tuple[str, str]] = []
    for kind, text in found[_opening(found) :]:
        if kind == "paragraph":
            text = "\n".join(x for x in text.split("\n") if not _LINKS_ONLY.fullmatch(x))
        under_title = kind == "rule" and all(k == "heading" for k, _ in out) and len(out) < 2
        if text and not under_title:
            out.append((kind, text))
    return out


def converted(body: str | None, url: str | None, ctype: str | None) -> str | None:
    """Markdown of what an address gave: Markdown as it is, JSON, plain text and XML as code, the rest as a page;
    null for a type that has no text."""
    kind, text = (ctype or "").split(";")[0].strip().lower(), _CONTROL.sub("", body or "")
    end = (url or "").split("?", 1)[0].rstrip("/").lower().rsplit("/", 1)[-1].rpartition(".")[2]
    if kind and not kind.startswith("text/") and "json" not in kind and "xml" not in kind:
        return None
    if kind in ("text/markdown", "text/x-markdown") or (kind in ("", "text/plain") and end in ("md", "markdown")):
        return text
    if "json" in kind:
        return fence(text, "json")
    if kind == "text/plain" or (not kind and end == "txt"):
        return fence(text, "")
    return fence(text, "xml") if "xml" in kind and "xhtml" not in kind else extract(body, url)["markdown"]


def extract(html: str | None, url: str | None) -> dict:
    """title, root_kind, is_shell, markdown, words and blocks of a page; null and broken pages give what is there."""
    return extracted_tree(parse(html or ""), url)


def extracted_tree(tree: Node, url: str | None) -> dict:
    """extract() of a page that is parsed; the tree is used up."""
    title, mount, scripted = None, False, False
    for n in tree.walk():
        if n.tag == "title" and title is None:
            title = " ".join(n.text().split())
        mount |= n.tag == "div" and n.attrs.get("id") in ("root", "app", "__next", "__nuxt")
        scripted |= n.tag == "script" and bool(n.attrs.get("src"))
    title = title or ""
    root, is_article = pick_root(tree)
    clean(root, is_article)
    tidy(root, title)
    found = [(kind, _CONTROL.sub("", m)) for kind, m in blocks(root, url or "")]
    found = [b for i, b in enumerate(found) if not (i and b == found[i - 1] and "](" in b[1])]
    found = trimmed(found)
    if title and not any(kind == "heading" and m.startswith("# ") for kind, m in found):
        found.insert(0, ("heading", "# " + _CONTROL.sub("", title)))
    words = sum(len(m.split()) for kind, m in found if not m.startswith("# "))
    return {
        "title": title, "root_kind": "article" if is_article else root.tag, "is_shell": words < 15 and (mount or scripted),
        "markdown": "\n\n".join(m for _, m in found), "words": words, "blocks": [{"kind": k, "text": m} for k, m in found],
    }
