"""HTML pages in Python: title, body text, metadata, language and links. Malformed markup is read as far as it goes."""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

LINK_TAGS = frozenset({"a"})
LINK_ATTRIBUTES = frozenset({"href"})
ALL_LINK_TAGS = frozenset("a img frame iframe link area input bgsound object blockquote q ins del embed".split())
ALL_LINK_ATTRIBUTES = frozenset({"href", "src", "data", "cite"})
_UNSEEN = frozenset({"script", "style", "noscript", "template"})


@dataclass
class Link:
    url: str
    anchor_text: str = ""
    rel: str = ""


@dataclass
class Page:
    title: str = ""
    text: str = ""
    meta: dict[str, str] = field(default_factory=dict)
    language: str = ""
    base: str = ""
    links: list[Link] = field(default_factory=list)


class _Reader(HTMLParser):
    def __init__(self, tags: frozenset[str], attributes: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.tags, self.attributes = tags, attributes
        self.page, self.body, self.titles, self.links = Page(), [], [], []
        self.unseen, self.in_title, self.in_head = 0, False, False
        self.open: tuple[str, list[Link], list[str]] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found = {k: v or "" for k, v in reversed(attrs)}
        if tag in _UNSEEN:
            self.unseen += 1
        elif tag == "title":
            self.in_title = not self.titles
        elif tag == "html":
            self.page.language = self.page.language or found.get("lang", "")
        elif tag == "meta":
            name = (found.get("name") or found.get("http-equiv") or found.get("property") or "").lower()
            if name:
                self.page.meta.setdefault(name, found.get("content", ""))
        elif tag == "base" and found.get("href"):
            self.page.base = self.page.base or found["href"]
        if tag in self.tags:
            self._close(tag)
            links = [Link(found[k].strip(), "", found.get("rel", "")) for k in found if k in self.attributes and found[k].strip()]
            self.links += links
            if links:
                self.open = (tag, links, [])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in _UNSEEN:
            self.unseen -= 1
        self._close(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _UNSEEN:
            self.unseen = max(0, self.unseen - 1)
        elif tag == "title":
            self.in_title = False
        self._close(tag)

    def _close(self, tag: str) -> None:
        if self.open and self.open[0] == tag:
            text = "".join(self.open[2]).strip()
            for link in self.open[1]:
                link.anchor_text = text
            self.open = None

    def handle_data(self, data: str) -> None:
        if self.unseen:
            return
        if self.in_title:
            self.titles.append(data)
            return
        self.body.append(data)
        if self.open:
            self.open[2].append(data)


def read(html: str | None, url: str = "", tags: frozenset[str] = LINK_TAGS, attributes: frozenset[str] = LINK_ATTRIBUTES, most_links: int = 51) -> Page:
    """A page's parts. Links are absolute, each once with the first anchor text, at most `most_links`; a robots meta of none or nofollow leaves none."""
    reader = _Reader(tags, attributes)
    reader.feed(html or "")
    reader.close()
    if reader.open:
        reader._close(reader.open[0])
    page = reader.page
    page.title = "".join(reader.titles).strip()
    page.text = f"{page.title} {''.join(reader.body)}".strip()
    page.base = urljoin(url, page.base) if page.base else url
    barred = {w.strip().lower() for w in page.meta.get("robots", "").split(",")} & {"none", "nofollow"}
    seen: dict[str, Link] = {}
    for link in [] if barred else reader.links:
        try:
            link.url = urljoin(page.base, link.url)
        except ValueError:
            continue
        seen.setdefault(link.url, link)
    page.links = list(seen.values())[:most_links]
    return page
