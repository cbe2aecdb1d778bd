"""Main text of web pages by equivalence-class template deduction.

A page's tokens are its element paths (two tokens each, the start and the end) and the words of its text blocks.  Tokens whose
occurrence vectors over a host's pages are equal form an equivalence class; vectors are compared by two sums over pages of a hash
of (page, count), so a host of any size is a plain group-by.  A class in at least half of a host's pages (three at
least) is valid if it has three tokens or more, its members do not interleave, and all of them lie within members of it or of
one class that is in the template already.  Valid classes are nested into the template whole, from the class of
the root outward; others are data.  What lies between the template's tokens are its slots; the slot that holds
most data in the most article-like role is the main one, and its text without the template's own is the page's text.  Hosts
of too few pages use the template of all hosts.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import materialize, tidy

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_LOOSE = re.compile(r"(?:<(?![a-zA-Z/!?]))+")
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
# Elements by their part in the layout, and words in class, id and role that mark a page's furniture.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template", "select"}
FURNITURE = {"head", "nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "svg", "object", "canvas", "audio", "video", "input", "option", "datalist", "fieldset"} | RAW
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
MARKS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations breadcrumb breadcrumbs comment comments disqus respond replies reply nav navbar navigation menu sidebar "
    "footer header masthead toolbar pagination pager widget widgets skip complementary contentinfo search dialog".split()
)
#: Words that only say where or how something stands; with them a name of MARKS still names furniture.
LAYOUT = set("bar box block inner outer wrapper wrap container content section area slot unit item items list row col column grid panel card link links button buttons icon icons form text title heading top bottom left right main primary secondary inline site page post posts article articles story stories news more view".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "td", "th", "blockquote"}
#: Roles of a slot.
CHROME, PLAIN, MAIN = 0, 1, 2


@dataclass
class Node:
    name: str
    path: int
    role: int
    at: int  # place in Page.nodes of the element, or of the block element around an inline one


@dataclass
class Block:
    text: str
    path: int
    at: int
    role: int
    place: int  # among all starts, ends and blocks of the page


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    #: Elements in order: path, place of the parent in this list, role, first and last place among starts, ends and blocks.
    nodes: list[list[int]] = field(default_factory=lambda: [[0, -1, PLAIN, 0, 0]])


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) >> 1


def _names_furniture(value: str) -> bool:
    """Whether one of the class names or ids is of furniture as a whole: "ad", "share-buttons"; not "related-work"."""
    for one in value.split():
        parts = [w for w in re.split(r"[^a-z0-9]+", one) if w]
        if any(w in MARKS and w not in ("header", "masthead") for w in parts) and all(w in MARKS or w in LAYOUT for w in parts):
            return True
    return False


def _furniture(name: str, attrs: str, article: bool = False) -> tuple[bool, str]:
    """Whether an element is furniture, and the part of its path that its attributes give.

    Within an article a name counts only as a whole, and a header is the article's own."""
    sign = ""
    if attrs and not attrs.isspace():
        hidden = False
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id", "role"):
                sign += f" {value}"
            hidden |= key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "")
        if name not in ("html", "body", "article", "main") or "comment" in sign:
            if article:
                if hidden or _names_furniture(sign):
                    return True, sign
                return name in FURNITURE and name != "header", sign
            words = re.split(r"[^a-z0-9]+", sign)
            if hidden or any(w in MARKS and (not k or words[k - 1] not in ("has", "with", "no")) for k, w in enumerate(words)):
                return True, sign
    return name in FURNITURE and not (article and name == "header"), sign


def _tags(source: str) -> Iterator[tuple[int, str, str, str, int]]:
    """(kind, name, attributes, text, end) from left to right: kind 0 text, 1 start tag, 2 end tag.  Send a place to go on from there.

    Each character is looked at a bounded number of times: once a tag's quotes are not closed before the end of the
    page, tags end at their first ">" whatever quotes say.
    """
    at, size, trusted = 0, len(source), True
    while at < size:
        if source[at] != "<":
            end = source.find("<", at)
            end = size if end < 0 else end
            yield 0, "", "", source[at:end], end
            at = end
            continue
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        if source.startswith("<![CDATA[", at):
            end = source.find("]]>", at)
            end = size if end < 0 else end
            yield 0, "", "", source[at + 9 : end], end
            at = end + 3
            continue
        closing = source.startswith("</", at)
        m = _LOOSE.match(source, at)
        if m:
            yield 0, "", "", m[0], m.end()
            at = m.end()
            continue
        m = _NAME.match(source, at + 1 + closing)
        begin = m.end() if m else at + 1
        whole = _QUOTED.match(source, begin) if trusted else None
        end = whole.end() if whole else source.find(">", begin) + 1
        trusted = trusted and whole is not None
        if not end:  # no ">" any more: what looks like a tag is text
            yield 0, "", "", source[at:], size
            return
        at = end
        if m:
            moved = yield 1 + closing, m[0].lower(), source[begin : end - 1], "", end
            at = moved if moved is not None else end


def parse(source: str | None) -> Page:
    """Blocks of text in page order, and elements.  Bad markup is read as browsers do, near enough."""
    page, text, ticks = Page(), [], 0
    stack = [Node("", 0, PLAIN, 0)]
    opened: Counter[str] = Counter()

    def flush() -> None:
        nonlocal ticks
        if text:
            whole = " ".join("".join(text).split())
            text.clear()
            if whole:
                k = len(stack) - 1
                while k and stack[k].name in INLINE:
                    k -= 1
                ticks += 1
                page.blocks.append(Block(whole, stack[k].path, stack[k].at, stack[k].role, ticks))

    def close(k: int) -> None:
        nonlocal ticks
        while len(stack) > k:
            node = stack.pop()
            opened[node.name] -= 1
            if node.name not in INLINE:
                ticks += 1
                page.nodes[node.at][4] = ticks

    source = source or ""
    tags = _tags(source)
    tag = next(tags, None)
    while tag is not None:
        kind, name, attrs, data, at = tag
        move = None
        if kind == 0:
            if stack[-1].role != CHROME:
                text.append(_html.unescape(data) if "&" in data else data)
        elif kind == 2:
            if name not in INLINE:
                flush()
            if opened[name]:
                k = len(stack) - 1
                if name in INLINE:  # an inline end tag does not close the blocks around it
                    while stack[k].name in INLINE and stack[k].name != name:
                        k -= 1
                else:
                    while stack[k].name != name:
                        k -= 1
                if stack[k].name == name:
                    close(k)
        else:
            if name not in INLINE:
                flush()
            if name in RAW:
                if not (attrs.endswith("/") and name not in ("script", "style")):
                    end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                    move = end.end() if end else len(source)
            elif name not in VOID and not (attrs.endswith("/") and name in INLINE):
                if name not in INLINE:
                    closes = CLOSES.get(name, set()) | {"p"}
                    if any(opened[c] for c in closes):
                        for k in range(len(stack) - 1, 0, -1):
                            if stack[k].name in closes:
                                close(k)
                                break
                            if stack[k].name in SCOPES:
                                break
                elif name == "a" and opened["a"] and stack[-1].name == "a":
                    close(len(stack) - 1)
                top = stack[-1]
                chrome, sign = _furniture(name, attrs, top.role == MAIN)
                opened[name] += 1
                if name in INLINE:
                    stack.append(Node(name, top.path, CHROME if chrome else top.role, top.at))
                else:
                    role = CHROME if chrome or top.role == CHROME else MAIN if name in ("article", "main") or top.role == MAIN else PLAIN
                    ticks += 1
                    stack.append(Node(name, _hash(top.path, name, sign), role, len(page.nodes)))
                    page.nodes.append([stack[-1].path, top.at, role, ticks, 0])
        try:
            tag = tags.send(move)
        except StopIteration:
            tag = None
    flush()
    close(1)
    page.nodes[0][4] = ticks + 1
    return page


def host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page: tokens with their parent, role, size, characters (of an element: all below it), first and last place, and two hashes of (page, count)."""
    for batch in batches:
        rows: list[tuple] = []
        for key, url, source in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "html"))):
            page, name = parse(source), host(url)
            below = [0] * len(page.nodes)
            texts: dict[tuple[int, int], list[int]] = {}
            for b in page.blocks:
                below[b.at] += len(b.text)
                seen = texts.setdefault((_hash(b.path, b.text), b.path), [0, b.role, len(b.text.split()), 0, b.place, 0])
                seen[0] += 1
                seen[3] += len(b.text)
                seen[5] = b.place
            paths: dict[int, list[int]] = {}
            for k in range(len(page.nodes) - 1, -1, -1):
                path, parent, role, first, last = page.nodes[k]
                if k:
                    below[parent] += below[k]
                of = paths.setdefault(path, [0, page.nodes[parent][0] if k else -1, role, 0, first, last])
                of[0] += 1
                of[3] += below[k]
                of[4], of[5] = min(of[4], first), max(of[5], last)
            for p, (n, parent, role, chars, first, last) in paths.items():
                rows.append((name, p, parent, role, False, n, chars, key, 2, first, last))
            for (t, p), (n, role, size, chars, first, last) in texts.items():
                rows.append((name, t, p, role, True, n, chars, key, size, first, last))
        h = [_hash(r[7], r[5]) for r in rows]
        typed = ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()), (4, pa.bool_()), (8, pa.int64()), (6, pa.int64()), (9, pa.int64()), (10, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], t) for k, t in typed), pa.array([x & 0x7FFFFFFF for x in h], pa.int64()), pa.array([x >> 31 & 0x7FFFFFFF for x in h], pa.int64())],
            names=["host", "token", "parent", "role", "is_text", "size", "chars", "first", "last", "h1", "h2"],
        )


#: The fewest tokens of a class.
LEAST = 3


def interleaved(members: list, pages: int) -> bool:
    """Whether two members' stretches of the page overlap without one holding the other."""
    ends: list[float] = []
    for first, last in sorted((m.first / pages, -m.last / pages) for m in members):
        while ends and ends[-1] <= first:
            ends.pop()
        if ends and -last > ends[-1]:
            return True
        ends.append(-last)
    return False


def deduce(pdf: pd.DataFrame) -> pd.DataFrame:
    """One host's frequent tokens -> its main slot, the template's texts, and those of them that every page has once.

    Rows: token, parent, role, is_text, size, and sums over pages of chars, first, last, h1, h2.  A class is nested whole or
    not at all; see the head of this module for what makes it valid.
    """
    tokens = {int(r.token): r for r in pdf.sort_values("token").itertuples()}
    classes: dict[tuple[int, int, int], list] = {}
    for r in tokens.values():
        classes.setdefault((r.pages, r.h1, r.h2), []).append(r)
    of = {int(r.token): k for k, c in classes.items() for r in c}
    template: set[int] = set()

    def owner(token: int, among: set[int]) -> int | None:
        """The nearest element around a token that is in the template or among these."""
        up = int(tokens[token].parent)
        while up in tokens and up not in template and up not in among:
            up = int(tokens[up].parent)
        return up if up in tokens else None

    def valid(key: tuple[int, int, int]) -> bool:
        members = classes[key]
        own = {int(r.token) for r in members}
        around = {owner(t, own) for t in own if t}
        holders = {of[o] for o in around - own - {None}}
        once = key == root  # members that come several times on a page interleave in their own way
        return sum(r.size for r in members) >= LEAST and None not in around and len(holders) <= 1 and not (once and interleaved([r for r in members if not r.is_text], key[0]))

    root = of.get(0)
    empty = pd.DataFrame({"host": [pdf["host"].iloc[0]], "main": [0], "fixed": [[]], "always": [[]]})
    if root is None or not valid(root):
        return empty
    template |= {int(r.token) for r in classes[root]}
    open_, grown = [k for k in sorted(classes) if k != root], True
    while grown:  # outward from the root
        fresh = [k for k in open_ if valid(k)]
        template |= {int(r.token) for k in fresh for r in classes[k]}
        open_, grown = [k for k in open_ if k not in fresh], bool(fresh)
    # What a slot holds besides the template's own text.
    data = {t: int(r.chars) for t, r in tokens.items() if not r.is_text and t in template}
    for t, r in tokens.items():
        up = owner(t, set()) if r.is_text and t in template else None
        while up is not None:
            data[up] -= int(r.chars)
            up = owner(up, set()) if up else None
    slots = [t for t in data if t and tokens[t].role != CHROME]
    if not slots:
        return empty
    role = max(tokens[t].role for t in slots)
    slots = [t for t in slots if tokens[t].role == role]
    most = max(data[t] for t in slots)
    deep = [t for t in slots if data[t] >= 0.8 * most]  # the innermost that still holds most of the data
    holds = {owner(t, set()) for t in deep}
    main = min((t for t in deep if t not in holds), key=lambda t: (-data[t], t))
    fixed = [t for t, r in tokens.items() if r.is_text and t in template]
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "main": [main], "fixed": [fixed], "always": [[t for t in fixed if of[t] == root]]})


def main_text(page: Page, slot: int, fixed: frozenset[int], always: frozenset[int]) -> str:
    """The text of a page's main slot without the template's.

    An article's own slot is all of its parts, and loses only the texts that every page has once, as long as other text
    is left.  Where the page has neither an article nor the slot, all of its text that is not the template's.
    """
    blocks = [b for b in page.blocks if b.role != CHROME]
    article = [b for b in blocks if b.role == MAIN]
    if article:
        return " ".join(b.text for b in ([b for b in article if _hash(b.path, b.text) not in always] or article))
    within = [False] * len(page.nodes)
    for k, (path, parent, *_) in enumerate(page.nodes):
        within[k] = bool(slot) and path == slot or k > 0 and within[parent]
    inside = [b for b in blocks if within[b.at]]
    return " ".join(b.text for b in inside or blocks if _hash(b.path, b.text) not in fixed)


def _extract(shared, names: list[str], outs: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value if shared is not None else {}
        for batch in batches:
            texts = []
            own = batch.column("__slot").to_pylist() if shared is None else [None] * len(batch)
            for url, source, slot in zip(batch.column("__url").to_pylist(), batch.column("__html").to_pylist(), own):
                found = known.get(host(url)) or known.get("*") or (0, frozenset(), frozenset()) if slot is None else (slot["main"], frozenset(slot["fixed"]), frozenset(slot["always"]))
                texts.append(main_text(parse(source), *found))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*names, *outs])

    return run


def extract_main_text(df: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text", chars_col: str = "n_chars", template_bytes: int = 16 << 20, least_pages: int = 3, support: float = 0.5) -> DataFrame:
    """df with text_col, each page's main text, and chars_col, its code points.

    Character references are decoded; white space inside a block becomes one space; blocks are joined by one
    space.  A null or empty html gives an empty text; a null url is a host of its own ("").  Every row stays; columns of
    df named as the results are replaced.  Repeated pages count each.  Templates of all hosts are broadcast
    where they take template_bytes at most, else joined.  A class counts from `least_pages` pages and a share of `support` of
    its host's pages.  One task holds one host's frequent tokens: as many as its pages have, not as it has pages.
    """
    spark = df.sparkSession
    kept = [f for f in df.schema if f.name not in (text_col, chars_col)]
    names = [f.name for f in kept]
    pages = df.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    tokens = pages.select(F.xxhash64("url", "html").alias("key"), "url", "html").mapInArrow(tidy(_tokens), "host string, token long, parent long, role int, is_text boolean, size long, chars long, first long, last long, h1 long, h2 long")
    keys = ["token", "parent", "role", "is_text", "size"]
    sums = [F.sum(c).alias(c) for c in ("chars", "first", "last", "h1", "h2")]
    by_host = tokens.groupBy("host", *keys).agg(F.count("*").alias("pages"), *sums)
    by_host = materialize(by_host, "tokens")
    everywhere = by_host.groupBy(*keys).agg(F.sum("pages").alias("pages"), *sums).withColumn("host", F.lit("*"))
    both = by_host.unionByName(everywhere)
    of = both.filter("token = 0").select("host", F.col("pages").alias("of"))
    frequent = both.join(of, "host").filter(f"pages >= {least_pages} and pages >= {support} * of")
    templates = materialize(frequent.groupBy("host").applyInPandas(deduce, "host string, main long, fixed array<long>, always array<long>"), "templates")
    size = templates.agg(F.sum(F.length("host") + F.size("fixed") * 16 + 16)).first()[0] or 0
    source = df.select(*[F.col(f"`{n}`") for n in names], F.col(url_col).alias("__url"), F.col(html_col).alias("__html"))
    schema = T.StructType([*kept, T.StructField(text_col, T.StringType()), T.StructField(chars_col, T.LongType())])
    if size <= template_bytes:
        shared = spark.sparkContext.broadcast({r["host"]: (r["main"], frozenset(r["fixed"]), frozenset(r["always"])) for r in templates.collect()})
        return source.mapInArrow(tidy(_extract(shared, names, (text_col, chars_col))), schema)
    rest = templates.filter("host = '*'").select(F.struct("main", "fixed", "always").alias("slot"))
    fallback = rest.first()
    name = F.lower(F.regexp_extract(F.coalesce("__url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    joined = source.withColumn("__host", name).join(templates.select(F.col("host").alias("__host"), F.struct("main", "fixed", "always").alias("__slot")), "__host", "left").drop("__host")
    longs = lambda name: F.array(*[F.lit(x) for x in (fallback["slot"][name] if fallback else [])]).cast("array<long>").alias(name)
    other = F.struct(F.lit(fallback["slot"]["main"] if fallback else 0).cast("long").alias("main"), longs("fixed"), longs("always"))
    return joined.withColumn("__slot", F.coalesce("__slot", other)).mapInArrow(tidy(_extract(None, names, (text_col, chars_col))), schema)
