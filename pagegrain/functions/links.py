"""Link resolution against a page's address."""

from __future__ import annotations

from urllib.parse import parse_qs, urljoin, urlsplit


def resolve(base: str | None, href: str | None) -> tuple[str | None, bool]:
    """(target, followed). Blank is refused, a fragment stays as it is, others resolve by RFC 3986; http and https
    are followed, file only from a page that isn't http, other schemes not. A search engine's redirect link
    gives its destination."""
    href = (href or "").strip()
    if not href:
        return None, False
    if href.startswith("#"):
        return href, True
    try:
        target = urljoin(base or "", href)
        parts = urlsplit(target)
    except ValueError:
        return None, False
    if parts.hostname and parts.hostname.endswith("duckduckgo.com") and parts.path == "/l/":
        wanted = parse_qs(parts.query).get("uddg")
        if wanted:
            target, parts = wanted[0], urlsplit(wanted[0])
    if parts.scheme in ("http", "https"):
        return target, True
    if parts.scheme == "file" and not (base or "").startswith(("http://", "https://")):
        return target, True
    return None, False
