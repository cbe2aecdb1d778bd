"""Metadata, links and clean addresses of web pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# For each field the places that may hold it, in order: (element, attribute, its value, where the text is).
SELECTORS: dict[str, list[tuple[str, str | None, str | None, str | None]]] = {
    "canonical_url": [("link", "rel", "canonical", "href"), ("meta", "property", "og:url", "content")],
    "title": [("meta", "property", "og:title", "content"), ("title", None, None, None), ("h1", None, None, None)],
    "description": [("meta", "property", "og:description", "content"), ("meta", "name", "description", "content")],
    "author": [("meta", "name", "author", "content"), ("meta", "property", "article:author", "content")],
    "date_published": [("meta", "property", "article:published_time", "content"), ("meta", "itemprop", "datePublished", "content"), ("time", None, None, "datetime")],
}
# Second-level suffixes under which names are registered.
SECOND = {"co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "com.br", "com.mx", "co.za", "co.in", "com.ar", "com.tr"}


class Elements(HTMLParser):
    """Elements with their attributes and texts; links with the text around them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, dict[str, str], list[str]]] = []
        self.open: list[tuple[str, list[str]]] = []
        self.links: list[dict] = []
        self.paragraph: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        text: list[str] = []
        self.found.append((tag, a, text))
        if tag == "p":
            self.paragraph = []
        if tag == "a" and a.get("href"):
            up = [t for t, _ in self.open[::-1]]
            self.links.append({"href": a["href"], "text": text, "parent": up[0] if up else "", "grandparent": up[1] if len(up) > 1 else "", "paragraph": self.paragraph})
        if tag not in ("meta", "link", "img", "br", "hr", "input"):
            self.open.append((tag, text))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        for _, text in self.open:
            text.append(data)
        self.paragraph.append(data)


def parse(html: str | None) -> Elements:
    e = Elements()
    e.feed(html or "")
    e.close()
    return e


def metadata(html: str | Elements | None) -> dict[str, str]:
    """Each field of a page, or of a parsed one, by the first selector that any element meets, even if that is blank; values joined by commas."""
    e, out = html if isinstance(html, Elements) else parse(html), {}
    for name, selectors in SELECTORS.items():
        out[name] = ""
        for tag, attr, value, where in selectors:
            hits = [(a, t) for g, a, t in e.found if g == tag and (attr is None or a.get(attr, "").lower() == value)]
            if hits:
                out[name] = re.sub(r"[\r\n\t]+", " ", ",".join(a.get(where, "") if where else "".join(t) for a, t in hits)).strip()
                break
    return out


def registrable(host: str | None) -> str:
    parts = re.sub(r":\d+$", "", (host or "").lower()).strip(".").split(".")
    if len(parts) < 2 or all(p.isdigit() for p in parts):
        return ".".join(parts)
    return ".".join(parts[-3:] if ".".join(parts[-2:]) in SECOND and len(parts) > 2 else parts[-2:])


def clean_url(url: str | None, links: dict[str, str] | None = None, depth: int = 3) -> str:
    """What an address stands for: archived pages give the page, shorteners the target, platforms the account."""
    u = (url or "").strip()
    m = re.match(r"https?://(?:www\.|m\.)?([^/?#]+)([^?#]*)(\?[^#]*)?", u, re.I)
    if not m:
        return u.lower()
    host, path = m[1].lower(), m[2].rstrip("/")
    inner = re.search(r"https?(?:://|%3A%2F%2F).+$", u[8:], re.I)
    if depth and inner and (host.endswith("archive.org") or host.startswith("webcache.")):
        return clean_url(inner[0].replace("%3A%2F%2F", "://"), links, depth - 1)
    if depth and host in ("archive.is", "archive.today", "t.co") and links and u in links:
        return clean_url(links[u], links, depth - 1)
    if host in ("twitter.com", "facebook.com", "reddit.com"):
        keep = {"twitter.com": 1, "facebook.com": 1, "reddit.com": 2}[host]
        return "/".join([host, *[p for p in path.split("/") if p][:keep]]).lower()
    if re.search(r"\.(blogspot|wordpress|tumblr|medium)\.", host):
        return host
    return registrable(host)


@F.pandas_udf(T.StructType([T.StructField(name, T.StringType()) for name in SELECTORS]))
def page_metadata(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([metadata(x) for x in s], columns=list(SELECTORS))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(name, T.StringType()) for name in ("href", "text", "parent", "grandparent", "paragraph")])))
def page_links(s: pd.Series) -> pd.Series:
    def one(x):
        return [{**k, "text": "".join(k["text"]), "paragraph": " ".join("".join(k["paragraph"]).split())} for k in parse(x).links]

    return s.map(one)


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("links", T.ArrayType(T.StructType([T.StructField(name, T.StringType()) for name in ("href", "text", "parent")])))]))
def page_anchors(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Title and links of a page from one parse, without the paragraph around each link, which a long page would repeat for each."""
    for s in batches:
        rows = []
        for x in s:
            e = parse(x)
            rows.append((metadata(e)["title"], [{"href": k["href"], "text": "".join(k["text"]), "parent": k["parent"]} for k in e.links]))
        yield pd.DataFrame(rows, columns=["title", "links"])


@F.pandas_udf(T.StringType())
def registrable_domain(s: pd.Series) -> pd.Series:
    return s.map(registrable)


@F.pandas_udf(T.StringType())
def canonical_site(s: pd.Series) -> pd.Series:
    return s.map(clean_url)
