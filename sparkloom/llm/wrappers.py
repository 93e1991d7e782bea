"""HTML extraction by wrappers: union-free patterns inferred per host by aligning the token streams of its pages.

A page is cut into tokens and folded to nested block elements; a run of text and inline markup is one text token.  Two
streams of the same host are aligned element by element: equal elements go on, texts that differ become slots, an element
that follows its like becomes a repeated group, and any other mismatch is resolved by the shorter skip on either side
into an optional group.  The result is again a pattern, so a host's pages are folded into one wrapper: different pages in the
order of their hashes, dealt to salts, then salts by SALTS at a time, so no task sees all pages of a large host and the
wrapper is the same however the rows lie.

Markup and wrapper together tell the article from the rest.  Elements and roles that say what they are (nav, header, footer, aside,
form) are left out; a header inside an article is its heading.  Names of classes and ids only make a region suspect:

* named by listed words alone (`sidebar`, `related-posts`), it goes unless it holds more than half of the page's text beside reader
  comments, so no article is lost with what is around it; a region of reader comments goes whatever its length;
* named by a listed word among others (`related-work`, `notice-of-death`), it goes only if the wrapper tells so: all its texts are
  the same on several pages, most of its blocks are links, or it is several blocks that some pages of the host lack, outside of articles, and
  fewer than those of another part of the same element;
* named by what it has or lacks (`no-sidebar`, `has-header`), or inline, it stays.

Where a page marks an article or main part, only that is kept; all of it, if whole articles are asked for, as the registered query does,
else without the texts that the wrapper holds fixed (a lead that each issue repeats).  Elsewhere the wrapper decides: fixed texts are the
template's own; a block that is mostly links is left out where most blocks of the wrapper's group around it, over all pages of the
host, are (a menu), and stays where they are not (a paragraph).  Texts are fixed if all pages of the host with different html, two or more, have
them at one place; where they are the greater part, the pages are versions of one article, and all stay.  Nothing else is dropped.

Defined cases: null or empty html has an empty text; a null or unreadable url is the host ''; unclosed and crossed tags
are closed as in browsers, at any depth; a very long page is read whole; equal pages of a host count once; repeated rows give a
row each; an empty table gives no rows; extra columns, also of the names used here, are ignored.
"""

from __future__ import annotations

import html
import json
import re
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value, cut, relax, small_batches, worker_cache

by_value(__name__)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements of HTML by kind.
RAW = frozenset("script style noscript template textarea title iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button select option svg object audio video canvas".split()
)
OUT = frozenset("head nav header footer aside form dialog menu button select svg object audio video canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Words in class and id that name regions outside the article.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion promotions nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist respond reply replies disqus discussion widget widgets pager pagination toolbar search form hidden copyright disclaimer".split()
)
#: Those of them that an article element itself may be left out for.
NO_ARTICLE = frozenset("ad ads advert advertisement sponsored promo related comment comments reply replies widget".split())
#: Those of them that name what readers wrote.
TALK = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
#: Words beside them that say nothing of the content, and first words that say what a region has or lacks.
NEUTRAL = frozenset("area bar block bottom box button buttons col column container content group heading icon icons inner item items left link links list main module outer page panel post posts primary right row secondary section site text title top unit wrap wrapper".split())
OTHER = frozenset("has have hide no non not with without".split())
#: Share of links in a menu (characters of a block, blocks of a group), salts merged at once, pages folded per salt.
LINKS, SALTS, PAGES = 0.5, 32, 1_000
#: What names make of a region.
NAMELESS, SUSPECT, NAMED, COMMENTS = range(4)
CLOSES_P = BLOCK - {"button", "select", "option", "svg", "object", "audio", "video", "canvas", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
P_WALLS = frozenset("td th li div article section".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}


class Element:
    """A block element: its signature, whether its region is out of or marked as the article, what its names make of it, children (elements
    and texts); shade: it or one around it is out or named; mass and talk: characters inside, and those of them in regions of comments."""

    __slots__ = ("article", "children", "mass", "noise", "out", "shade", "sig", "tag", "talk")

    def __init__(self, tag: str, sig: str, out: bool, article: bool, noise: int = NAMELESS, shade: bool = False):
        self.tag, self.sig, self.out, self.article, self.noise, self.shade, self.children, self.mass, self.talk = tag, sig, out, article, noise, shade or out or noise >= NAMED, [], 0, 0


class Text:
    """A run of text and inline markup: one block of text."""

    __slots__ = ("linked", "text")

    def __init__(self, text: str, linked: int):
        self.text, self.linked = text, linked


def _names(attributes: dict[str, str]) -> set[str]:
    return {w.lower() for w in NAME.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}")}


def _is_out(tag: str, attributes: dict[str, str]) -> bool:
    if tag in OUT or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    return attributes.get("role", "").lower() in ROLES


def _noise(tag: str, attributes: dict[str, str]) -> int:
    """What the names of a block element make of its region."""
    if tag in ("html", "body", "main"):
        return NAMELESS
    found = NAMELESS
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in NAME.findall(name)]
        listed = [w for w in words if w in NOISE]
        if not listed or words[0] in OTHER:
            continue
        if tag == "article" and not NO_ARTICLE.intersection(listed):
            continue
        alone = all(w in NOISE or w in NEUTRAL for w in words)
        found = max(found, SUSPECT if not alone else COMMENTS if TALK.intersection(listed) else NAMED)
    return found


def parse(source: str) -> Element:
    """The page as nested block elements."""
    root = Element("", "", False, False)
    made: list[tuple[Element, Element]] = []  # with the one around each
    stack, run, linked, link, at = [root], [], 0, 0, 0
    out_inline: list[str] = []
    places: dict[str, list[int]] = {}  # of each tag, where it stands in the stack
    one_article = len(re.findall(r"<(?:article|main)\b", source, re.I)) == 1

    def flush():
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                stack[-1].children.append(Text(text, min(linked, len(text))))
            run.clear()
        linked = 0

    def words(text: str):
        nonlocal linked
        if text and not out_inline:
            run.append(text)
            if link:
                linked += len(text)

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(place: int):
        """Takes the elements from a place on off the stack."""
        while len(stack) > max(place, 1):
            places[stack.pop().tag].pop()

    while m := TOKEN.search(source, at):
        words(source[at : m.start()])
        at = m.end()
        if not m.group(2):
            continue
        tag, closing = m.group(2).lower(), bool(m.group(1))
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in ("br", "hr", "img", "wbr"):
            run.append(" " if run else "")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in BLOCK:
            if tag == "a":
                link = 0 if closing else 1
            if closing:
                if out_inline and out_inline[-1] == tag:
                    out_inline.pop()
            elif out_inline:
                if out_inline[-1] == tag:
                    out_inline.append(tag)
            elif m.group(3).strip():
                attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m.group(3))}
                if tag != "a" and _is_out(tag, attributes):
                    out_inline.append(tag)
            continue
        flush()
        out_inline.clear()
        link = 0
        if closing:
            if place := last((tag,)):
                close(place)
            continue
        if tag in CLOSES_P and (place := last(("p",))) > last(P_WALLS):
            close(place)
        if tag in CLOSES and (place := last(CLOSES[tag])) > last(WALLS[tag]):
            close(place)
        if tag == "body":
            while stack[-1].tag == "head":
                close(len(stack) - 1)
        attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m.group(3))} if m.group(3).strip() else {}
        names = _names(attributes)
        if tag in ("article", "main") and one_article:
            while stack[-1].shade and len(stack) > 1:  # the only article, in a region that was never closed
                close(len(stack) - 1)
        above = stack[-1]
        sig = tag + "".join(f".{n}" for n in sorted(names)) if names else tag
        marked = tag in ("article", "main") or attributes.get("role", "").lower() == "main" or "articlebody" in attributes.get("itemprop", "").lower()
        heading = tag == "header" and above.article
        element = Element(tag, sig, above.out or (not heading and _is_out(tag, attributes)), above.article or marked, _noise(tag, attributes) if names else NAMELESS, above.shade)
        above.children.append(element)
        made.append((element, above))
        places.setdefault(tag, []).append(len(stack))
        stack.append(element)
    words(source[at:])
    flush()
    _weigh(root, made)
    return root


def _weigh(root: Element, made: list[tuple[Element, Element]]) -> None:
    """Sets the characters in each element, from the innermost on; regions that are out have none."""
    for e, above in reversed([(root, None), *made]):
        if not e.out:
            own = sum(len(c.text) for c in e.children if isinstance(c, Text))
            e.mass += own
            if e.noise == COMMENTS:
                e.talk = e.mass
            if above is not None:
                above.mass += e.mass
                above.talk += e.talk


# A pattern is [signature, quantifier (1, ?, + or *), pages, children, blocks of text that are mostly links, blocks of text] of an element, blocks
# in regions that are left out not counted; a text's signature is "#" and its place of children holds the text of all pages, or null (a slot).
SIG, QUANTIFIER, SEEN, INSIDE, LINKED, BLOCKS = range(6)


def at_any_depth() -> None:
    """Patterns nest as pages do; these functions call none but each other on the way down."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 2_000_000))


def pattern(e: Element | Text) -> list:
    at_any_depth()
    return _pattern(e)


def _pattern(e: Element | Text) -> list:
    if isinstance(e, Text):
        return ["#", "1", 1, e.text, int(e.linked > LINKS * len(e.text)), 1]
    children: list[list] = []
    own = [e.sig, "1", 1, children, 0, 0]
    for c in e.children:
        p = _pattern(c)
        for i in () if e.out or e.noise >= NAMED else (LINKED, BLOCKS):
            own[i] += p[i]
        _follow(children, p)
    return own


def _follow(children: list[list], p: list) -> None:
    """Adds p behind the children; one that follows its like makes a repeated group."""
    if children and children[-1][SIG] == p[SIG] != "#":
        n = max(children[-1][SEEN], p[SEEN])
        children[-1] = _merge(children[-1], p, False)
        children[-1][QUANTIFIER], children[-1][SEEN] = "*" if children[-1][QUANTIFIER] in "?*" and p[QUANTIFIER] in "?*" else "+", n
    else:
        children.append(p)


def _quantifier(a: str, b: str) -> str:
    return {(False, False): "1", (True, False): "?", (False, True): "+", (True, True): "*"}["?" in (a, b) or "*" in (a, b), "+" in (a, b) or "*" in (a, b)]


def merge(a: list, b: list) -> list:
    """The pattern that covers two patterns of the same signature, of different pages."""
    at_any_depth()
    return _merge(a, b, True)


def _merge(a: list, b: list, apart: bool) -> list:
    """Pages of different patterns (apart) add up; of neighbours, which the same pages may hold, the greater number is sure."""
    seen = a[SEEN] + b[SEEN] if apart else max(a[SEEN], b[SEEN])
    sums = [a[i] + b[i] for i in (LINKED, BLOCKS)]
    own = [a[SIG], _quantifier(a[QUANTIFIER], b[QUANTIFIER]), seen, [], *sums]
    if a[SIG] == "#":
        own[INSIDE] = a[INSIDE] if a[INSIDE] == b[INSIDE] else None
        return own
    x, y, i, j, out = a[INSIDE], b[INSIDE], 0, 0, own[INSIDE]
    in_x, in_y = _by_signature(x), _by_signature(y)
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i][SIG] == y[j][SIG]:
            _follow(out, _merge(x[i], y[j], apart))
            i, j = i + 1, j + 1
            continue
        # the mismatch: skip on the side where the other's element comes sooner
        skip_y = _next(in_y, x[i][SIG], j) if i < len(x) else None
        skip_x = _next(in_x, y[j][SIG], i) if j < len(y) else None
        if j >= len(y) or (skip_x is not None and (skip_y is None or skip_x - i <= skip_y - j)) or (i < len(x) and skip_y is None):
            p, i = x[i], i + 1
        else:
            p, j = y[j], j + 1
        _follow(out, [p[SIG], {"1": "?", "+": "*"}.get(p[QUANTIFIER], p[QUANTIFIER]), *p[SEEN:]])
    return own


def _by_signature(nodes: list[list]) -> dict[str, list[int]]:
    """The places of each signature, in order."""
    places: dict[str, list[int]] = {}
    for i, n in enumerate(nodes):
        places.setdefault(n[SIG], []).append(i)
    return places


def _next(places: dict[str, list[int]], sig: str, at: int) -> int | None:
    """The first place of a signature from one on."""
    found = places.get(sig, [])
    k = bisect_left(found, at)
    return found[k] if k < len(found) else None


def dumps(p: list) -> str:
    """A pattern as JSON without nesting: its nodes in order, an element with its number of children."""
    flat, todo = [], [p]
    while todo:
        node = todo.pop()
        if node[SIG] == "#":
            flat.append(node)
        else:
            flat.append([*node[:INSIDE], len(node[INSIDE]), *node[LINKED:]])
            todo += reversed(node[INSIDE])
    return json.dumps(flat)


def loads(text: str) -> list:
    root: list = []
    todo = [(root, 1)]
    for node in json.loads(text):
        to, left = todo.pop()
        to.append(node)
        if left > 1:
            todo.append((to, left - 1))
        if node[SIG] != "#":
            n, node[INSIDE] = node[INSIDE], []
            if n:
                todo.append((node[INSIDE], n))
    return root[0]


def align(children: list[Element | Text], nodes: list[list]) -> list[list | None]:
    """The pattern's node that each child of an element stands for, by running the pattern over the children; None where it has none."""
    steps: list[dict[int, int] | None] = []  # places that a child may have, each with that of the child before
    places, sure = _by_signature(nodes), [i for i, n in enumerate(nodes) if n[QUANTIFIER] in "1+"]
    now = {-1: -1}
    for c in children:
        sig, text = ("#", c.text) if isinstance(c, Text) else (c.sig, None)
        own, new = places.get(sig, []), {}
        for k in now if own else ():
            if k >= 0 and nodes[k][SIG] == sig != "#" and nodes[k][QUANTIFIER] in "+*":
                new.setdefault(k, k)
            stop = bisect_right(sure, k)  # up to the next one that must be there
            for j in own[bisect_right(own, k) : bisect_right(own, sure[stop]) if stop < len(sure) else None]:
                if text is None or nodes[j][INSIDE] in (None, text):
                    new.setdefault(j, k)
        steps.append(new or None)
        now = new or now
    ends = [k for k in now if not sure or k >= sure[-1]]
    place = min(ends or now)
    out: list[list | None] = []
    for step in reversed(steps):
        out.append(None if step is None else nodes[place])
        place = place if step is None else step[place]
    return out[::-1]


def _slots(p: list) -> int:
    """Texts of a pattern that differ between pages."""
    found, todo = 0, [p]
    while todo:
        n = todo.pop()
        if n[SIG] == "#":
            found += n[INSIDE] is None
        else:
            todo += n[INSIDE]
    return found


def _goes(e: Element, page: Element, q: list | None, beside: list[list]) -> bool:
    """Whether a region that its names make suspect is left out, by its share of the page's text or by its node of the wrapper."""
    if e.noise == COMMENTS:
        return True
    if e.noise == NAMED:
        return 2 * (e.mass - e.talk) <= page.mass - page.talk
    if e.noise != SUSPECT or q is None:
        return False
    if q[BLOCKS] >= 2 and q[LINKED] > LINKS * q[BLOCKS]:
        return True
    if q[SEEN] >= 2 and not _slots(q):
        return 2 * (e.mass - e.talk) <= page.mass - page.talk
    several = q[BLOCKS] >= 2 * q[SEEN]
    return not e.article and several and q[QUANTIFIER] in "?*" and any(n is not q and n[BLOCKS] > q[BLOCKS] for n in beside)


def blocks(page: Element, wrapper: list | None, whole_articles: bool = False) -> list[str]:
    """The page's main texts, in order."""
    found: list[tuple[str, bool, bool, bool]] = []  # text, in an article, fixed, of a menu

    def placed(e: Element, p: list | None) -> Iterator[tuple[Element | Text, list | None]]:
        return zip(e.children, [None] * len(e.children) if p is None else align(e.children, p[INSIDE]), strict=True)

    open_ = [(page, wrapper, placed(page, wrapper), False)]
    while open_:
        e, p, children, menu = open_.pop()
        for c, q in children:
            if isinstance(c, Text):
                if not e.out:
                    fixed = q is not None and q[QUANTIFIER] == "1" and wrapper[SEEN] == q[SEEN] >= 2 and q[INSIDE] == c.text
                    found.append((c.text, e.article, fixed, menu and c.linked > LINKS * len(c.text)))
            elif not c.out and not _goes(c, page, q, p[INSIDE] if p else []):
                # the innermost element that holds two blocks or more on a page says whether this is a menu
                inner = menu if q is None or q[BLOCKS] < 2 * q[SEEN] else q[LINKED] > LINKS * q[BLOCKS]
                open_ += [(e, p, children, menu), (c, q, placed(c, q), inner)]
                break

    if any(a for _, a, _, _ in found):
        found = [f for f in found if f[1]]
        if whole_articles:
            return [t for t, _, _, _ in found]
    copied = 2 * sum(len(t) for t, _, fixed, _ in found if fixed) > sum(len(t) for t, *_ in found)
    return [t for t, article, fixed, menu in found if (copied or not fixed) and (article or not menu)]


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host, salt and hash to one pattern for each host and salt; equal pages count once."""
    key, last, whole = None, None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([dumps(whole)], pa.string())], ["host", "salt", "wrapper"])

    for b in batches:
        for name, salt, h, source in zip(*(b.column(c).to_pylist() for c in ("host", "salt", "hash", "html")), strict=True):
            if (name, salt) != key:
                if key is not None:
                    yield out()
                key, last, whole = (name, salt), None, None
            if h != last:
                p = pattern(parse(source))
                whole, last = p if whole is None else merge(whole, p), h
    if key is not None:
        yield out()
    relax()


def _merged(table: pa.Table) -> pa.Table:
    whole = None
    for w in table.sort_by("salt")["wrapper"].to_pylist():
        whole = loads(w) if whole is None else merge(whole, loads(w))
    return pa.table([table["host"].slice(0, 1), table["to"].slice(0, 1), pa.array([dumps(whole)], pa.string())], ["host", "salt", "wrapper"])


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) from all different pages."""
    schema = "host string, salt long, wrapper string"
    full = pages.where("html <> ''").select(host(F.col("url")).alias("host"), "html")
    n, levels = full.count(), 1
    while n > PAGES * SALTS**levels:
        levels += 1
    hashed = full.withColumn("hash", F.sha2("html", 256)).withColumn("salt", F.pmod(F.xxhash64("hash"), F.lit(SALTS**levels)))
    rows = hashed.repartition("host", "salt").sortWithinPartitions("host", "salt", "hash").mapInArrow(_folded, schema)
    for _ in range(levels):
        rows = rows.withColumn("to", F.floor(F.col("salt") / SALTS)).groupBy("host", "to").applyInArrow(_merged, schema)
    return rows.select("host", "wrapper")


def _extract(batches: Iterator[pa.RecordBatch], whole_articles: bool) -> Iterator[pa.RecordBatch]:
    cache = worker_cache().setdefault("wrappers", {})
    for b in batches:
        texts = []
        for source, wrapper in zip(b.column("html").to_pylist(), b.column("wrapper"), strict=True):
            key = wrapper.as_py()
            if key is not None and key not in cache:
                if len(cache) > 2_000:
                    cache.clear()
                cache[key] = loads(key)
            texts.append("\n\n".join(blocks(parse(source), cache.get(key), whole_articles)) if source else "")
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
    relax()


#: Wrappers are broadcast up to this many bytes; beyond, pages are joined to them by host (large hosts split at run time).
BROADCAST_BYTES = 32_000_000


def extract(pages: DataFrame, whole_articles: bool = False) -> DataFrame:
    """Per page row: page_id, url, text, n_chars."""
    wrappers = cut(infer(small_batches(pages)), "wrappers").select(F.col("host").alias("h"), "wrapper")
    size = wrappers.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("h") + 64), F.lit(0))).first()[0]
    side = F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers
    joined = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(side, F.col("host") == F.col("h"), "left")
    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(lambda batches: _extract(batches, whole_articles), f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
