"""Text and links of HTML, without a DOM: block tags break lines, scripts and styles are skipped."""

from __future__ import annotations

import re
from html.parser import HTMLParser

BLOCKS = frozenset("address article aside blockquote br div dl dt dd fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
HIDDEN = frozenset(("script", "style", "head", "title", "noscript", "template"))
URL = re.compile(r"(?i)(?:https?://|www\.)[^\s<>\"']+")


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.open: list[tuple[str, list[str]]] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BLOCKS:
            self.out.append("\n")
        if tag in ("a", "area") and (href := (a.get("href") or "").strip()):
            self._close()
            self.open.append((href, []))
            if tag == "area":
                self._close()
        elif tag == "form" and (action := (a.get("action") or "").strip()):
            self.links.append((action, "form action"))
        elif tag == "img" and self.open and a.get("alt"):
            self.open[-1][1].append(a["alt"])

    def _close(self):
        if self.open:
            href, text = self.open.pop()
            self.links.append((href, " ".join("".join(text).split())))

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag == "a":
            self._close()
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)
            if self.open:
                self.open[-1][1].append(data)


def read_html(markup: str, most: int = 500) -> tuple[str, list[tuple[str, str]]]:
    """(visible text, links as (href, text)); broken markup is read as far as it goes."""
    r = _Reader()
    try:
        r.feed(markup)
        r.close()
    except (AssertionError, ValueError):
        pass
    r._close()
    lines = [" ".join(x.split()) for x in "".join(r.out).split("\n")]
    return "\n".join(x for x in lines if x), r.links[:most]


def urls_of(text: str) -> list[str]:
    return list(dict.fromkeys(u.rstrip(".,;:!?)]}") for u in URL.findall(text)))
