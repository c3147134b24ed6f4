"""Blocks of Markdown laid out as lines of a width."""

from __future__ import annotations

import re
import unicodedata

_LINK = re.compile(r"\[([^\]]*)\]\(([^)\s]*)\)")
_MARKS = re.compile(r"\*\*|~~|(?<!\w)\*|\*(?!\w)|`")


#: Marks around a link's text while it is laid out; they take no cells.
OPEN, CLOSE = "\ue000", "\ue001"


def cells(text: str) -> int:
    """Terminal cells of a text: wide characters take two, combining ones and link marks none."""
    return sum(0 if c in (OPEN, CLOSE) or unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def plain(text: str) -> str:
    return _MARKS.sub("", _LINK.sub(r"\1", text))


def wrap(text: str, width: int) -> list[str]:
    """Words in lines of at most `width` cells; a longer word is cut."""
    out, line, used = [], "", 0
    for word in text.split():
        while cells(word) > width:
            if line:
                out.append(line)
                line, used = "", 0
            cut, n = 0, 0
            while cut < len(word) and n + cells(word[cut]) <= width:
                n += cells(word[cut])
                cut += 1
            cut = max(cut, 1)
            out.append(word[:cut])
            word = word[cut:]
        n = cells(word)
        if line and used + 1 + n > width:
            out.append(line)
            line, used = word, n
        elif word:
            line, used = (f"{line} {word}", used + 1 + n) if line else (word, n)
    return out + [line] if line else out


def spans(blocks: list[tuple[str, str]], width: int) -> list[tuple[int, int, int, int, str]]:
    """(line, from, to, link, target) of link texts on lines(blocks, width), in cells; a link that goes on on the
    next lines has a span on each. Links are numbered by the first place of their target, from 1."""
    targets: list[str] = []

    def marked(m: re.Match) -> str:
        targets.append(m[2])
        return OPEN + m[1] + CLOSE

    texts = [(k, t if k in ("code", "rule") else _LINK.sub(marked, t.replace(OPEN, "").replace(CLOSE, ""))) for k, t in blocks]
    number: dict[str, int] = {}
    out, seen, inside = [], 0, False
    for n, (kind, _, text) in enumerate(lines(texts, width)):
        if kind == "code":
            continue
        lead = re.match(r"[\s•│]*", text)[0] if inside else ""
        at = start = cells(lead)
        for c in text[len(lead) :]:
            if c == OPEN:
                inside, start = True, at
            elif c == CLOSE and inside:
                target = targets[seen]
                if at > start:
                    out.append((n, start, at, number.setdefault(target, len(number) + 1), target))
                seen, inside = seen + 1, False
            else:
                at += cells(c)
        if inside and at > start and seen < len(targets):
            out.append((n, start, at, number.setdefault(targets[seen], len(number) + 1), targets[seen]))
    return out


def lines(blocks: list[tuple[str, str]], width: int) -> list[tuple[str, bool, str]]:
    """(kind, soft, text) a line: soft lines go on the one before. Blocks are parted by a blank line."""
    width = max(width, 10)
    out: list[tuple[str, bool, str]] = []
    for kind, text in blocks:
        if out:
            out.append(("blank", False, ""))
        if kind == "code":
            body = text.split("\n")
            lang = body[0].strip("`") or "text"
            out.append(("code", False, f"┌ {lang}"))
            for row in body[1:-1]:
                row = row.replace("\t", "    ")
                parts = [row[i : i + width - 2] for i in range(0, len(row), width - 2)] or [""]
                out.extend(("code", i > 0, "│ " + x) for i, x in enumerate(parts))
            out.append(("code", False, "└"))
        elif kind == "rule":
            out.append(("rule", False, "─" * width))
        elif kind == "table":
            rows = [[c.strip() for c in re.split(r"(?<!\\)\|", r.strip().strip("|"))] for r in text.split("\n")]
            rows = [r for i, r in enumerate(rows) if i != 1 or not all(re.fullmatch("-+", c) for c in r)]
            n = max(map(len, rows))
            rows = [[plain(c) for c in r] + [""] * (n - len(r)) for r in rows]
            room = max(4, (width - 3 * (n - 1)) // n)
            wide = [min(room, max(cells(r[k]) for r in rows)) for k in range(n)]
            for r in rows:
                parts = [wrap(c, max(4, w)) or [""] for c, w in zip(r, wide, strict=True)]
                for i in range(max(map(len, parts))):
                    row = " │ ".join((p[i] if i < len(p) else "").ljust(w) for p, w in zip(parts, wide, strict=True))
                    out.append(("table", i > 0, row.rstrip()))
        else:
            for row in text.split("\n"):
                lead = re.match(r"\s*(?:[-*] |\d+\. |> |#{1,6} )?", row)[0]
                body = wrap(plain(row[len(lead) :]), width - len(lead))
                shown = "" if kind == "heading" else lead.replace("- ", "• ").replace("> ", "│ ")
                out.extend((kind, i > 0, (shown if i == 0 else " " * len(shown)) + x) for i, x in enumerate(body))
    return out
