"""Fact-check articles: claim, verdict, categories, links and emphasised words, from one parse of each page."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pages import registrable

# Elements that have no end, and the names by which the site marks its parts.
EMPTY = {"meta", "link", "img", "br", "hr", "input"}
REVIEWED, VERDICT, OLD_VERDICT, SOURCES, TRAIL = "claimReviewed", "claim", "claim-old", "article-sources-box", "breadcrumb-nav"
LEAST_WORDS = 10  # of a paragraph whose links count


@dataclass
class Element:
    name: str
    attrs: dict[str, str]
    parent: Element | None
    parts: list = field(default_factory=list)

    def text(self) -> str:
        return "".join(p if isinstance(p, str) else p.text() for p in self.parts)

    def all(self, name: str) -> Iterator[Element]:
        for p in self.parts:
            if isinstance(p, Element):
                if p.name == name:
                    yield p
                yield from p.all(name)

    def first(self, name: str, key: str | None = None, value: str | None = None) -> Element | None:
        return next((e for e in self.all(name) if key is None or value in e.attrs.get(key, "").split()), None)


class _Tree(HTMLParser):
    """Elements as nested in the source; a p ends the p before it, an end tag ends what is open within it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)
        self.depth = 0

    def _close(self, name: str) -> None:
        e = self.at
        while e.parent and e.name != name:
            e = e.parent
        if e.parent:
            self.at = e.parent

    def handle_starttag(self, tag, attrs):
        if tag == "p":
            e = self.at
            while e.parent and e.name not in ("p", "div", "td", "li", "article", "section", "body"):
                e = e.parent
            if e.name == "p":
                self.at = e.parent
        new = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(new)
        if tag not in EMPTY and self._room():
            self.at = new

    def _room(self) -> bool:
        """Elements nest to a bounded depth; deeper ones stand side by side."""
        n, e = 0, self.at
        while e.parent and n < 200:
            n, e = n + 1, e.parent
        return n < 200

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        self.at.parts.append(data)


def parse(html: str | None) -> Element:
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


def _after_label(text: str, *labels: str) -> str:
    for x in labels:
        text = text.replace(x, "", 1)
    return text.strip()


def claim_and_result(page: Element) -> tuple[str | None, str | None]:
    """The claim and its verdict, from the first of these that a page has.

    A paragraph marked as the reviewed claim, with the verdict's own box; else the first paragraph with a label
    "Claim": in a span, a strong or a font.  The verdict is then the next paragraph; before it comes an old verdict box where the
    label has a colon, and a font label takes a next paragraph that names a status, else the first font of a table.
    """
    reviewed = page.first("p", "itemprop", REVIEWED)
    if reviewed:
        box = page.first("div", "class", VERDICT)
        return reviewed.text().strip(), box.text().strip() if box else None
    paragraphs = list(page.all("p"))
    for p, after in zip(paragraphs, [*paragraphs[1:], None]):
        following = after.text().strip() if after else None
        span = next((s.text().strip() for s in p.all("span") if s.text().strip() in ("Claim", "Claim:")), None)
        if span == "Claim":
            return _after_label(p.text(), "Claim: ", "Claim"), following
        if span:
            old = page.first("div", "class", OLD_VERDICT)
            return _after_label(p.text(), "Claim:"), old.text().strip() if old else following
        if any(s.text().startswith("Claim") for s in p.all("strong")):
            return _after_label(p.text(), "Claim: ", "Claim:"), following
        if any(s.text().startswith("Claim") for s in p.all("font")):
            if following and "Status" in following:
                return _after_label(p.text(), "Claim: ", "Claim:"), _after_label(following, "Status: ", "Status:")
            table = next((f for t in page.all("table") for f in t.all("font")), None)
            return _after_label(p.text(), "Claim: ", "Claim:"), table.text().strip() if table else None
    return None, None


def _link(a: Element, paragraph: str) -> dict | None:
    site = registrable(a.attrs.get("href", "").split("//", 1)[-1].split("/", 1)[0]) if "//" in a.attrs.get("href", "") else ""
    if "." not in site:
        return None
    up = a.parent
    return {"text": a.text(), "site": site, "href": a.attrs["href"], "parent": up.name if up else "", "grandparent": up.parent.name if up and up.parent else "", "paragraph": paragraph}


def article(html: str | None) -> dict:
    """One page's parse: parse_result is ok, or no_result where no verdict was found."""
    page = parse(html)
    claim, result = claim_and_result(page)
    links, seen, emphasised = [], set(), []
    for p in page.all("p"):
        words = " ".join(p.text().split())
        if len(words.split()) >= LEAST_WORDS:
            for a in p.all("a"):
                if a.attrs.get("href") and (found := _link(a, words)):
                    links.append(found)
                    seen.add(a.attrs["href"])
        if not (p.parent and SOURCES in p.parent.attrs.get("class", "").split()):
            emphasised += [{"text": e.text(), "paragraph": words} for e in p.all("em")]
    links += [found for a in page.all("a") if a.attrs.get("href") and a.attrs["href"] not in seen and (found := _link(a, ""))]
    trail = page.first("div", "class", TRAIL)
    return {"parse_result": "ok" if result else "no_result", "claim": claim, "result": result, "categories": [a.text() for a in trail.all("a")] if trail else [], "links": links, "emphasised": emphasised}


_LINK = pa.struct([(n, pa.string()) for n in ("text", "site", "href", "parent", "grandparent", "paragraph")])
_FIELDS = [("parse_result", pa.string()), ("claim", pa.string()), ("result", pa.string()), ("categories", pa.list_(pa.string())), ("links", pa.list_(_LINK)), ("emphasised", pa.list_(pa.struct([("text", pa.string()), ("paragraph", pa.string())])))]


def articles(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, parse_result, claim, result, categories, links, emphasised), a row for each page; a null page has no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [article(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array([f[n] for f in found], t) for n, t in _FIELDS)], names=["key", *(n for n, _ in _FIELDS)])

    rows = df.select(F.col(key).alias("key"), F.col(html).alias("html"))
    link = "struct<" + ", ".join(f"{n}: string" for n in ("text", "site", "href", "parent", "grandparent", "paragraph")) + ">"
    schema = f"key {dict(rows.dtypes)['key']}, parse_result string, claim string, result string, categories array<string>, links array<{link}>, emphasised array<struct<text: string, paragraph: string>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
