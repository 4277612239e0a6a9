"""Web pages: main content, title and links, with the standard library's parser.

Pages may leave tags open, so text is gathered by a stack that tolerates it. The
functions run over Arrow batches; one page is one row, so memory follows the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose text isn't content, and those that end a line (fixed values).
SKIPPED = {"script", "style", "nav", "noscript", "head", "form"}
BLOCKS = {"p", "div", "br", "li", "h1", "h2", "h3", "tr", "article", "section"}
#: Elements that stay empty (fixed values).
VOID = {"br", "img", "meta", "link", "hr", "input", "col", "source", "wbr"}

CONTENT = "page_id long, title string, text string, error string"
LINKS = "page_id long, place int, url string, label string"
SHORT_HTML, SHORT_TEXT = 100, 40


class Page(HTMLParser):
    """Title, content text and links of one page."""

    def __init__(self, container: tuple[str, ...] = ("article", "main")):
        super().__init__(convert_charrefs=True)
        self.container, self.open = container, []
        self.title, self.inside, self.all = [], [], []
        self.links: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._put("\n")
        if tag == "a":
            self.links.append((dict(attrs).get("href") or "", []))
        if tag not in VOID:
            self.open.append((tag, "ad" in (dict(attrs).get("class") or "").split()))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
        if tag in BLOCKS:
            self._put("\n")

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        if tags and tags[-1] == "title":
            self.title.append(data)
        if "a" in tags and self.links:
            self.links[-1][1].append(data)
        self._put(data)

    def _put(self, data):
        tags = {t for t, _ in self.open}
        if tags & SKIPPED or any(ad for _, ad in self.open):
            return
        self.all.append(data)
        if tags & set(self.container):
            self.inside.append(data)

    def text(self) -> str:
        lines = ("".join(self.inside or self.all)).split("\n")
        return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)


def parse(html: str | None) -> Page:
    page = Page()
    page.feed(html or "")
    page.close()
    return page


def main_content(pages: DataFrame) -> DataFrame:
    """Title and content of each page, or why there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_id, html in zip(batch["page_id"], batch["html"], strict=True):
                page = parse(html)
                text = page.text()
                error = "html_too_short" if len(html or "") < SHORT_HTML else "content_too_short" if len(text) < SHORT_TEXT else None
                out.append((page_id, " ".join("".join(page.title).split()), None if error else text, error))
            yield pd.DataFrame(out, columns=["page_id", "title", "text", "error"])

    return pages.select("page_id", "html").mapInPandas(run, CONTENT)


def links(pages: DataFrame) -> DataFrame:
    """Each page's links in order, resolved against its URL, the first of equals only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                found = {}
                for href, label in parse(html).links:
                    found.setdefault(urljoin(url or "", href).split("#")[0], " ".join("".join(label).split()))
                out += [(page_id, i, u, label) for i, (u, label) in enumerate(found.items())]
            yield pd.DataFrame(out, columns=["page_id", "place", "url", "label"]).astype({"place": "int32"})

    return pages.select("page_id", "url", "html").mapInPandas(run, LINKS)


def external(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Links that leave their page's host."""
    from ..functions.urls import host

    own = pages.select("page_id", host(F.col("url")).alias("own"))
    return found.join(own, "page_id").filter(host(F.col("url")) != F.col("own")).drop("own")


def same_host(a: str, b: str) -> bool:
    strip = lambda u: (urlsplit(u).hostname or "").removeprefix("www.")
    return strip(a) == strip(b)
