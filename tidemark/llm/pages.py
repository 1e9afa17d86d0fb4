"""Main text of web pages by equivalence-class template deduction.

Tokens are the page's structural elements, each named by its path, and its text blocks. Tokens of one
host whose occurrence vectors (how often in each page) are equal form a class: they come from the
same part of the host's template. A vector is summed up as the XOR of a hash of (page, count) over
its pages, so counting is one map-side combined aggregate over ``(host, token)`` whatever the size of
a host. Classes that occur in most pages and whose tokens keep their order are valid; paths nest them
into the template. Pages of one host with the same text count as one page. What the template says:

* text blocks of the template are not content, in an article or out of it;
* the deepest element of the template that holds most of the text is its slot; elements of the template
  outside it whose name has a listed word in it (class "site-sidebar") are not content.

Names are an aid. Elements that name themselves (nav, footer, class "ad", ...) are left out, but not
those that hold the page's article or most of its text. Article and main decide alone only for a host
without a template. What neither shows is kept.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .url_filter import with_parts

LEAST_PAGES = 3
#: Vectors are sums modulo 2**40, so that Spark adds those of 2**23 tasks without overflow.
_VECTOR = (1 << 40) - 1
#: Templates go to all executors up to so many bytes in all, else they are joined by host.
BROADCAST_BYTES = 16 << 20
_RAW = "script|style|noscript|template|svg|iframe|textarea|select|button|object|canvas|title"
_OPEN = re.compile(rf"<(?:(!--)|({_RAW})\b|(/?)([a-z][a-z0-9:-]*)|[!?])", re.I)
_CLOSE = {raw: re.compile(rf"</{raw}\s*>", re.I) for raw in _RAW.split("|")}
_ENDS = re.compile("[>\"']")
#: The rest of a tag without angle brackets in its quotes: no attempt passes the next bracket.
_REST = re.compile(r"[^<>\"']*+(?:(?:\"[^\"<>]*+\"|'[^'<>]*+')[^<>\"']*+)*+>")
#: What is left out of a page's digest: comments, scripts, styles and tags.
_NOT_SHOWN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\z)|</?[a-z][^<>]*>"
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
_STRUCTURE = frozenset("html head body div section article main nav header footer aside form ul ol dl table fieldset "
                       "figure details dialog center".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                    "samp small span strike strong sub sup time tt u var wbr img input meta link".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NOT_CONTENT = frozenset("head nav footer aside form dialog menu".split())
_NOT_CONTENT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices banner alert comment comments "
    "disqus reply replies respond footer masthead related recommended share sharing social subscribe "
    "subscription newsletter signup login popup modal overlay widget toolbar pagination pager skip".split())
#: Articles in these count as the page's article only where there is no other.
_OTHERS = frozenset("aside comment comments disqus reply replies respond".split())
#: These are left out even with most of the text in them.
_NEVER_MOST = frozenset("nav footer menu".split())


class _Element:
    """``named``: 0, or how firmly its own name bars it; ``hinted``: a part of its name would."""

    __slots__ = ("tag", "path", "depth", "parent", "content", "named", "hinted", "barred", "slot", "chars")

    def __init__(self, tag, path, depth, parent, content, named, hinted, slot):
        self.tag, self.path, self.depth, self.parent = tag, path, depth, parent
        self.content, self.named, self.hinted, self.slot = content, named, hinted, slot
        self.barred, self.chars = False, 0


def _names(values: str) -> tuple[set[str], bool]:
    """Listed words that are a name, or all words of one, and whether another name has one among its words."""
    whole, part = set(), False
    for name in values.split():
        words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())) - {""}
        if found := words & _NOT_CONTENT_WORDS:
            if found == words:
                whole |= words
            else:
                part = True
    return whole, part


def walk(page: str, slot: int | None = None, known: frozenset = frozenset()) -> list[tuple[_Element, str | None]]:
    """``(element, None)`` when a structural element opens, ``(element, block)`` for a text block in it.

    ``slot`` and ``known`` are the host's template.
    """
    events = list(_events(page, slot))
    elements = [e for e, block in events if block is None]
    for e, block in events:
        if block is not None:
            e.chars += len(block)
    for e in reversed(elements):
        e.parent.chars += e.chars
    _bar(elements, slot, known)
    return events


def _up(e: _Element) -> Iterator[_Element]:
    while e.parent is not None:
        yield e
        e = e.parent


def _bar(elements: list[_Element], slot: int | None, known: frozenset) -> None:
    """Decide which elements are left out, by their names and by where the page has its text."""
    if slot is not None:
        around = {id(x) for e in elements if e.path == slot for x in _up(e)}
        for e in elements:
            if e.hinted and not e.named and e.path in known and not e.slot and not e.content and id(e) not in around:
                e.named = 1
    if any(e.named for e in elements):
        total = elements[0].parent.chars  # the first one stands in the root
        marked = [e for e in elements if e.content and not e.parent.content and e.chars]
        free = total - sum(e.chars for e in elements if e.named and not any(x.named for x in _up(e.parent)))
        open_ones = [e for e in marked if not any(x.named for x in _up(e))]
        first = [e for e in marked if max(x.named for x in _up(e)) < 2]
        main = max(first or marked, key=lambda e: e.chars, default=None)
        if main not in open_ones and main and main.chars <= free:  # a teaser or a comment beside the text
            main = max(open_ones, key=lambda e: e.chars, default=None)
        around = {id(x) for x in _up(main)} if main else ()
        for e in elements:
            if e.named and (id(e) in around or e.named < 3 and 2 * e.chars > total and (
                    main is None or any(x is main for x in _up(e)))):
                e.named = 0
    for e in elements:
        e.barred = e.parent.barred or e.named > 0


def _tokens(page: str) -> Iterator[tuple[int, int, bool, str, str, str]]:
    """``(start, end, raw, tag, closing, attributes)`` of comments, raw elements (with what is in them), tags.

    A tag ends at the first ``>`` outside quotes, without one at the first ``>``. Quotes from which no such end is
    reached are remembered, so that each is followed once and the time is linear in the page.
    """
    last, dead, ahead = page.rfind(">"), set(), (0, -1)

    def unquoted(p: int) -> int:
        nonlocal ahead
        followed = []
        while True:
            if not ahead[0] <= p <= ahead[1]:
                found = _ENDS.search(page, p)
                ahead = (p, found.start() if found else len(page))
            q = ahead[1]
            if q < len(page) and page[q] == ">":
                return q + 1
            p = page.find(page[q], q + 1) + 1 if q < len(page) and q not in dead else 0
            if q < len(page):
                followed.append(q)
            if not p:
                dead.update(followed)
                return 0

    at = page.find("<")
    while at >= 0:
        m, end = _OPEN.match(page, at), 0
        if m and m[1]:
            end = page.find("-->", m.end()) + 3
            end = end if end > 2 else len(page)
        elif m and m[4] and (rest := _REST.match(page, m.end())):
            end = rest.end()
        elif m and at < last:
            first = page.find(">", m.end()) + 1
            if m[2]:
                close = _CLOSE[m[2].lower()].search(page, first)
                end = close.end() if close else len(page)
            else:
                end = m[4] and unquoted(m.end()) or first
        if end:
            raw = bool(m[2])
            yield at, end, raw, m[4] or "", m[3] or "", page[m.end():end - 1] if m[4] else ""
        at = page.find("<", end or at + 1)


def _events(page: str, slot: int | None) -> Iterator[tuple[_Element, str | None]]:
    root = _Element("", 0, 0, None, False, 0, False, False)
    stack, text, at = [root], [], 0

    def block():
        words = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        return words

    for start, end, raw, tag, closing, attributes in _tokens(page):
        if start > at:
            text.append(page[at:start])
        at = end
        if not tag:
            if raw and text:
                text.append(" ")
            continue
        tag = tag.lower()
        marks = "" if closing else attributes and " ".join(
            f"{k.lower()}={a or b or c}" for k, a, b, c in _ATTRIBUTE.findall(attributes))
        if tag in _INLINE and (closing or not marks or tag in _VOID or tag != "span"):
            if tag == "span" and closing and stack[-1].tag == "span":
                if one := block():
                    yield stack[-1], one
                stack.pop()
            continue
        if one := block():
            yield stack[-1], one
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if stack[-1].tag == "p" and tag != "span":
            stack.pop()
        if tag in _VOID or tag not in _STRUCTURE and not marks:
            continue
        top = stack[-1]
        name = re.sub(r"\d+", "0", marks.lower())
        path = xxhash.xxh64_intdigest(f"{top.path} {tag} {name}") >> 1
        whole, hinted = _names(" ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(attributes))) if marks else ((), False)
        named = 0
        if tag not in ("body", "html", "article", "main"):
            if tag in _NEVER_MOST:
                named = 3
            elif tag == "aside" or _OTHERS.intersection(whole):
                named = 2
            elif (whole or tag in _NOT_CONTENT or "aria-hidden=true" in name or tag == "header" and not top.content
                  or attributes and _HIDDEN.search(attributes)):
                named = 1
        content = tag in ("article", "main") or "role=main" in name or bool(
            {"articlebody"} & set(re.split(r"[^a-z]+", name)))
        e = _Element(tag, path, top.depth + 1, top, top.content or content, named, hinted, top.slot or path == slot)
        stack.append(e)
        yield e, None
    text.append(page[at:])
    if one := block():
        yield stack[-1], one


def _text_token(e: _Element, block: str) -> int:
    return xxhash.xxh64_intdigest(f"{e.path} {block}") >> 1


_COUNTED = ("host string, token long, is_path boolean, depth int, hinted boolean, pages double, vector long, chars double, "
            "low int, high int")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences by (host, token), summed over the pages of a batch; order is the place among tokens.

    A page that stands ``copies`` times counts for one in all its copies together, so its vector entry
    is a hash of its digest, and entries are added: copies would cancel each other in an XOR."""
    for batch in batches:
        seen: dict[tuple, list] = {}
        for digest, copies, host, html in zip(*[c.to_pylist() for c in batch.columns]):
            count, first, chars, depth, hinted = Counter(), {}, Counter(), {}, set()
            share = 1 / copies
            total = 0
            open_at: list[tuple[_Element, str | None]] = []
            for e, block in walk(html or ""):
                if e.barred:
                    continue
                if block is None:
                    count[e.path] += 1
                    first.setdefault(e.path, len(first))
                    depth[e.path] = e.depth
                    if e.hinted:
                        hinted.add(e.path)
                    while open_at and open_at[-1].depth >= e.depth:
                        open_at.pop()
                    open_at.append(e)
                else:
                    token = _text_token(e, block)
                    count[token] += 1
                    first.setdefault(token, len(first))
                    while open_at and open_at[-1].depth > e.depth:
                        open_at.pop()
                    for x in open_at:
                        chars[x.path] += len(block)
                    total += len(block)
            for token, n in count.items():
                v = xxhash.xxh64_intdigest(f"{digest} {n}") & _VECTOR
                key = (host, token, token in depth)
                old = seen.get(key)
                place = first[token]
                if old is None:
                    seen[key] = [depth.get(token, 0), token in hinted, share, v, chars[token] * share, place, place]
                else:
                    old[2] += share
                    old[3] = old[3] + v & _VECTOR
                    old[4] += chars[token] * share
                    old[5], old[6] = min(old[5], place), max(old[6], place)
            key = (host, -1, True)  # the host's own row: its pages and all their text
            old = seen.setdefault(key, [0, False, 0.0, 0, 0.0, 0, 0])
            old[2] += share
            old[4] += total * share
        if seen:
            rows = [(*k, *v) for k, v in seen.items()]
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_(), pa.float64(), pa.int64(), pa.float64(),
                     pa.int32(), pa.int32())
            names = [f.split()[0] for f in _COUNTED.split(", ")]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def templates(pages: DataFrame, share: float = 0.5, mass: float = 0.6) -> DataFrame:
    """``(host, slot, blocks)`` for the hosts with a template; ``pages`` has ``digest, host, html``.

    ``blocks`` are the template's text blocks, and its elements with a listed word in their name.
    """
    repeated = stored(pages.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    size = repeated.agg(F.sum(48 + F.octet_length("host"))).first()[0] or 0
    known = pages.join(F.broadcast(repeated) if size <= BROADCAST_BYTES else repeated, ["host", "digest"], "left").select(
        "digest", F.coalesce("copies", F.lit(1)).alias("copies"), "host", "html")
    # Shares of copies add up to whole pages but for rounding.
    counted = (known.mapInArrow(_count, _COUNTED).groupBy("host", "token", "is_path")
               .agg(F.max("depth").alias("depth"), F.max("hinted").alias("hinted"), F.round(F.sum("pages"), 6).alias("pages"),
                    F.sum("vector").bitwiseAND(_VECTOR).alias("vector"), F.round(F.sum("chars"), 3).alias("chars"),
                    F.min("low").alias("low"), F.max("high").alias("high")))
    counted = stored(counted.where("token = -1 or pages > 1"), "tokens")  # those of one page are in no template
    hosts = counted.where("token = -1").select("host", F.col("pages").alias("all_pages"), F.col("chars").alias("all_chars"))
    often = (counted.where("token <> -1").join(hosts, "host")
             .where((F.col("all_pages") >= LEAST_PAGES) & (F.col("pages") > share * F.col("all_pages"))))
    # A class keeps its order when its tokens, by first place, also follow each other by last place.
    same = Window.partitionBy("host", "pages", "vector").orderBy("low", "high", "token")
    valid = often.withColumn("before", F.lag("high").over(same)).where("before is null or before <= high")
    slots = valid.where(F.col("is_path") & (F.col("chars") >= mass * F.col("all_chars")))
    best = slots.groupBy("host").agg(F.max(F.struct("depth", "chars", "token")).alias("best"))
    blocks = valid.where("not is_path or hinted").groupBy("host").agg(F.collect_set("token").alias("blocks"))
    return best.select("host", F.col("best.token").alias("slot")).join(blocks, "host", "full")


def main_text(html: str | None, slot: int | None = None, blocks: frozenset = frozenset()) -> str:
    """The content blocks of a page joined by one space.

    All text that is neither in the template nor barred; where the host has no template and the page
    marks an article or a main part, the text of that. A template that holds all text of the page's
    article, or of a page without one, tells nothing about it, and that text stays.
    """
    found = [(e.content, _text_token(e, block) in blocks if blocks else False, block)
             for e, block in walk(html or "", slot, blocks) if block is not None and not e.barred]
    marked = any(content for content, _, _ in found)
    lost = all(known for content, known, _ in found if content or not marked)
    alone = marked and slot is None and not blocks
    return " ".join(block for content, known, block in found
                    if (content or not alone) and (not known or lost and (content or not marked)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple, frozenset] = {}
    for batch in batches:
        page, url, html, slot, blocks = (c.to_pylist() for c in batch.columns)
        for a in range(0, len(page), 500):
            text = []
            for h, s, b in zip(html[a:a + 500], slot[a:a + 500], blocks[a:a + 500]):
                key = tuple(b or ())
                if key not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[key] = frozenset(key)
                text.append(main_text(h, s, known[key]))
            yield pa.record_batch([pa.array(page[a:a + 500], pa.int64()), pa.array(url[a:a + 500], pa.string()),
                                   pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())],
                                  ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages``.

    Character references are decoded, white space inside a block becomes one space, blocks are joined
    in page order by one space; nothing else is dropped or cut. A null or empty html has an empty
    text. Pages without a host, and hosts of fewer than ``LEAST_PAGES`` different pages, have no template.
    """
    rows = with_parts(pages.select(F.col(key).cast("long").alias("page"), F.col(url).alias("url"),
                                   F.col(html).alias("html")))
    shown = F.regexp_replace(F.coalesce("html", F.lit("")), _NOT_SHOWN, " ")
    made = stored(templates(rows.where("__host <> ''").select(F.md5(shown).alias("digest"), F.col("__host").alias("host"),
                                                              "html")), "templates")
    size = made.agg(F.sum(16 + F.octet_length("host") + 8 * F.coalesce(F.size("blocks"), F.lit(0)))).first()[0] or 0
    made = made.withColumnRenamed("host", "__host")
    rows = rows.join(F.broadcast(made) if size <= BROADCAST_BYTES else made, "__host", "left")
    return rows.select("page", "url", "html", "slot", "blocks").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")
