"""Pages that scripts draw: what they say about themselves outside of their body, and their other versions."""

from __future__ import annotations

import ipaddress
import json
import re
from urllib.parse import urljoin, urlsplit

from .html import Node, _CONTROL, extract, extracted_tree, parse
from .text import OWN_HOSTS

THIN_WORDS, BARE_WORDS, REMARK_WORDS = 40, 15, 25
NOTICE = "> **This page draws its content with JavaScript**, which is not run here, so only its summary is shown."
_NOSCRIPT = re.compile(r"<noscript\b[^>]*>(.*?)</noscript\s*>", re.S | re.I)
#: Where frameworks draw a page.
_MOUNT_IDS = frozenset(("root", "app", "__next", "__nuxt", "svelte", "q-app", "___gatsby"))
_TEXT_TYPES = frozenset(("text/markdown", "text/x-markdown", "text/plain"))


def _words(text: str) -> list[str]:
    return text.split()


def _whole(n: Node) -> str:
    out, todo = [], n.kids[::-1]
    while todo:
        k = todo.pop()
        out.append(k) if isinstance(k, str) else todo.extend(reversed(k.kids))
    return "".join(out)


def _noscripts(html: str) -> list[str]:
    body = re.search(r"<body\b", html, re.I)
    return _NOSCRIPT.findall(html, body.start() if body else 0)


def linked_data(value: object) -> tuple[list[str], list[str]]:
    """(bodies, summaries) in decoded linked data: article bodies, and descriptions of what has a type, through
    lists and graphs, in order."""
    bodies, summaries, todo = [], [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo.extend(reversed(v))
        elif isinstance(v, dict):
            if isinstance(v.get("articleBody"), str):
                bodies.append(v["articleBody"])
            if isinstance(v.get("description"), str) and v.get("@type") is not None:
                summaries.append(v["description"])
            if "@graph" in v:
                todo.append(v["@graph"])
    return bodies, summaries


def _said(candidates: list[str]) -> list[str]:
    """Candidates in order, without short remarks on JavaScript and what an earlier one has said already."""
    kept: list[tuple[str, str]] = []
    for text in candidates:
        text = _CONTROL.sub("", text).strip()
        folded = " ".join(_words(text.lower()))
        remark = "javascript" in folded and len(_words(text)) < REMARK_WORDS
        if folded and not remark and not any(folded in before for _, before in kept):
            kept.append((text, folded))
    return [t for t, _ in kept]


def hints(html: str, tree: Node | None = None) -> tuple[list[str], bool]:
    """(summary paragraphs by trust, whether scripts seem to draw the page). tree: the page, parsed."""
    tree, inner = parse(html) if tree is None else tree, _noscripts(html)
    texts = [" ".join(_words(_whole(e))) for raw in inner for e in parse(raw).find("h1", "h2", "h3", "p", "li")]
    bodies, summaries = [], []
    for s in tree.find("script"):
        if s.attrs.get("type") == "application/ld+json":
            try:
                b, d = linked_data(json.loads(_whole(s)))
            except (ValueError, RecursionError):
                continue
            bodies += b
            summaries += d
    metas = tree.find("meta")
    for attr, name in (("name", "description"), ("property", "og:description")):
        first = next((m for m in metas if m.attrs.get(attr) == name), None)
        if first is not None and first.attrs.get("content", "").strip():
            summaries.insert(0, first.attrs["content"].strip())
            break
    mounts = [n for n in tree.walk() if n.attrs.get("id") in _MOUNT_IDS or n.tag == "app-root" or "data-reactroot" in n.attrs]
    sources = [s for s in tree.find("script") if "src" in s.attrs]
    body = next(iter(tree.find("body")), None)
    drawn = (
        any("javascript" in raw.lower() for raw in inner)
        or any(len(_words(_whole(n))) < BARE_WORDS for n in mounts)
        or any(s.attrs.get("type") == "module" for s in sources)
        or (body is not None and body.weight() < BARE_WORDS and bool(sources))
    )
    return _said(texts + bodies + summaries), drawn


def noscript_article(html: str) -> str:
    """The longest noscript markup that holds a whole article, or an empty string."""
    long = [raw for raw in _noscripts(html) if len(_words(_whole(parse(raw)))) >= 4 * THIN_WORDS]
    return max(long, key=len, default="")


def is_own_host(host: str | None) -> bool:
    host = (host or "").lower().strip("[]")
    if host == "localhost" or host.endswith(tuple("." + h for h in OWN_HOSTS)):
        return True
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return False
    return ip.is_loopback or ip.is_private or ip.is_link_local


def alternates(html: str, url: str, tree: Node | None = None) -> tuple[str | None, str | None]:
    """(text version, AMP version) that a page advertises: web addresses only, and none of one's own network from
    a page elsewhere."""
    text = amp = None
    for n in (parse(html) if tree is None else tree).find("link"):
        rel, href = n.attrs.get("rel", "").split(), n.attrs.get("href")
        if href is None or not {"alternate", "amphtml"} & set(rel):
            continue
        try:
            target = urljoin(url, href)
            there, here = urlsplit(target), urlsplit(url)
            if there.scheme not in ("http", "https") or (is_own_host(there.hostname) and not is_own_host(here.hostname)):
                continue
        except ValueError:
            continue
        kind = n.attrs.get("type", "").split(";")[0].strip().lower()
        if text is None and kind in _TEXT_TYPES and not href.rstrip("/").rsplit("/", 1)[-1].startswith("llms"):
            text = target
        if amp is None and "amphtml" in rel:
            amp = target
    return text, amp


def read(html: str | None, url: str | None) -> dict:
    """A page with its fallbacks: title, markdown, body_words, is_shell, hints, text_url, amp_url. A thin page that
    scripts draw gets a notice and what it says about itself; a whole article in noscript replaces the body."""
    html, url = html or "", url or ""
    tree = parse(html)
    said, drawn = hints(html, tree)
    text, amp = alternates(html, url, tree)
    page = extracted_tree(tree, url)
    if drawn and (page["words"] < THIN_WORDS) and (inner := noscript_article(html)):
        page = extract(f"<title>{page['title']}</title><body>{inner}</body>", url)
    body, shell = page["markdown"], drawn and page["words"] < THIN_WORDS
    if shell:
        new = [h for h in said if h not in body and h.lower() not in page["title"].lower()]
        body = "\n\n".join([NOTICE, *new, body.strip()]) + "\n"
    return {"title": page["title"], "markdown": body, "body_words": sum(len(_words(x)) for x in body.split("\n") if not x.startswith("# ")), "is_shell": shell, "hints": said, "text_url": text, "amp_url": amp}
