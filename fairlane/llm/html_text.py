"""Main text of web pages by tag-path ratios.

A page's text blocks are grouped by their root-to-leaf tag path (tags with
their classes). Each path has a text ratio (characters per node) and a
punctuation ratio (punctuation marks per node); both are smoothed over the
paths in page order, fused by multiplication, and paths above the threshold
(the standard deviation of the fused ratio) are content. Their mass decides
the content node: from the root down, the one child element that holds nearly
all of it, as long as no heading or paragraph lies beside it. The blocks
below that node are text, but for those in elements whose tag, role, class or
id marks them as a menu, header, footer, sidebar, notice, advert, form or
comment, for lists of nothing but links, and for boxes beside the content
without a content path or heading. Inside an article or main element a mark
counts only if all words of the class and id agree with it, running text goes
only as an advert, and lists of links stay.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlane.llm.common import prepare

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas video audio textarea title noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img"
    .split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
    "section table ul li dd dt".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
            "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
SCOPES = frozenset("html body table td th ul ol dl article section div main".split())
BOX = frozenset("html body div section article main table tbody tr td center form".split())
# What marks an element as no part of the article.
DROP_TAGS = frozenset("head nav footer aside form button select dialog menu fieldset datalist".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
DROP_WORDS = frozenset(
    "nav navbar navigation navigations menu menus submenu breadcrumb breadcrumbs header masthead topbar banner footer bottombar sidebar sidebars aside rail widget "
    "widgets ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox dfp sponsor sponsored sponsors promo promos promotion cookie "
    "cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin search share sharing sharebar "
    "social comment comments commentlist disqus respond reply replies discussion related recommended recommendations pagination pager paginator toolbar skip "
    "copyright legal disclaimer form forms paywall outbrain taboola adsbygoogle".split())
HEADER_WORDS = frozenset(("header", "masthead", "banner"))
ARTICLE_WORDS = frozenset(("article", "post", "entry", "story", "content", "title"))
# Of DROP_WORDS, those that also name wrappers of a whole page.
WRAPPER_WORDS = frozenset("header banner widget widgets share social form forms alert modal overlay popup paywall skip".split())
# Words that say nothing beside one of DROP_WORDS (as in "share-buttons"), tags of running text, and the
# words that mark these as an advert.
NEUTRAL_WORDS = frozenset(
    "area bar bars block blocks body bottom box boxes bar btn button buttons container content count counter counts el element entry group head heading holder icon icons "
    "inline inner item items js left link links list lists main module outer page panel post posts region right row rows section site slot small story "
    "text thread title tool tools top unit view wrap wrapper".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
ADVERT_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion".split())
KEEP_TAGS = frozenset("html body main article".split())
WRAPS = 3

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCT = re.compile(r"[.,;:!?…。，、！？；]")


class _Element:
    __slots__ = ("tag", "path", "parent", "drop", "holds_main", "in_main")      # drop: 1 by a word, 2 hidden, 3 by a wrapper's word, 4 by tag or role

    def __init__(self, tag, path, parent, drop, in_main):
        self.tag, self.path, self.parent, self.drop, self.in_main, self.holds_main = tag, path, parent, drop, in_main, False


def _marks_inside(tag: str, words: set[str], hit: set[str]) -> bool:
    """Whether an element inside the article is marked as no part of it: by all its
    words ("share-buttons", not "share-price"), running text as an advert only."""
    if words - DROP_WORDS - NEUTRAL_WORDS:
        return False
    return bool(hit & ADVERT_WORDS) if tag in TEXT_TAGS else hit != {"discussion"}


def _open(tag: str, attrs: str, parent: _Element) -> _Element:
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs else {}
    marks = html.unescape(f"{got.get('class', '')} {got.get('id', '')}")
    words = {w.lower() for w in _TOKENS.findall(marks)} if marks.strip() else set()
    in_main = parent.in_main or tag in ("article", "main") or got.get("role", "").lower() == "main" or "articlebody" in got.get("itemprop", "").lower()
    drop = 0
    if tag in DROP_TAGS or (tag == "header" and not parent.in_main) or got.get("role", "").lower() in DROP_ROLES:
        drop = 4
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in got.get("style", "").replace(" ", "").lower():
        drop = 2
    elif drop:
        pass
    elif tag not in KEEP_TAGS:
        hit = words & (DROP_WORDS - HEADER_WORDS if parent.in_main or words & ARTICLE_WORDS else DROP_WORDS)
        if hit and parent.in_main and not _marks_inside(tag, words, hit):
            hit = set()
        drop = 0 if not hit else 3 if hit <= WRAPPER_WORDS else 1
    path = f"{parent.path}/{tag}" + ("." + got["class"].strip() if got.get("class", "").strip() else "")
    e = _Element(tag, path, parent, drop, in_main)
    if in_main and not parent.in_main:
        up = parent
        while up is not None and not up.holds_main:
            up.holds_main = True
            up = up.parent
    return e


def _blocks(page: str) -> list[tuple[_Element, str, int]]:
    """(element, text, characters inside links) of each block in page order."""
    root = _Element("", "", None, 0, False)
    stack, out, buf, links, in_link = [root], [], [], 0, 0

    def flush():
        nonlocal links
        if buf:
            text = " ".join(html.unescape("".join(buf)).split())
            if text:
                out.append((stack[-1], text, links))
            buf.clear()
        links = 0

    def close_to(i):
        del stack[i:]

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        piece = page[at:m.start() if m else n]
        if piece:
            buf.append(piece)
            if in_link:
                links += len(piece)
        if not m:
            break
        at = m.end()
        if m[1] is not None:
            buf.append(html.escape(m[1], quote=False))
            continue
        end, tag, attrs = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not end and not (attrs or "").rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else n
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = max(0, in_link - 1) if end else 1
            continue
        flush()
        if tag in VOID:
            continue
        in_link = 0
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close_to(i)
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close_to(i)
                    break
                if stack[i].tag in SCOPES:
                    break
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SIBLINGS[tag]:
                    close_to(i)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                elif stack[i].tag in ("table", "ul", "ol", "dl", "select"):
                    break
        if (tag == "body" or tag == "html") and any(e.tag == tag for e in stack):
            continue
        if tag == "body":
            close_to(next((i for i, e in enumerate(stack) if e.tag == "head"), len(stack)))
        stack.append(_open(tag, attrs, stack[-1]))
    flush()
    return out


def _spare_wrappers(blocks: list[tuple[_Element, str, int]]) -> None:
    """Keep elements that are marked but wrap the page.

    One that only a wrapper's word marks is kept when it holds more than half
    of the text. One that another word, its tag or its role marks is kept when
    it holds more than half of the prose and, without the marked elements
    inside it, ``WRAPS`` times the text that would be left without it; no
    prose of that may stand in an article or main element.
    """
    chars: dict[int, int] = {}
    marked: dict[int, _Element] = {}
    for e, text, _ in blocks:
        while e is not None:
            chars[id(e)] = chars.get(id(e), 0) + len(text)
            if e.drop == 3:
                marked[id(e)] = e
            e = e.parent
    total = sum(len(text) for _, text, _ in blocks)
    for k, e in marked.items():
        if 2 * chars[k] > total:
            e.drop = 0
    # other marks, by the text that isn't mostly links; prose is what of it has punctuation
    plain = [(e, len(text), len(text) if _PUNCT.search(text) else 0) for e, text, links in blocks if 2 * links < len(text)]
    mass: dict[int, int] = {}
    wraps: dict[int, tuple[_Element, int]] = {}
    above = {}
    for e, _, n in plain:
        if id(e) not in above:
            above[id(e)] = _above(e)
        for depth, up in enumerate(reversed(above[id(e)])):
            mass[id(up)] = mass.get(id(up), 0) + n
            if up.drop in (1, 4):
                wraps[id(up)] = up, depth
    total = sum(n for _, _, n in plain)
    for e, _ in sorted((w for k, w in wraps.items() if 2 * mass[k] > total), key=lambda w: -w[1]):
        over = {id(up) for up in _above(e)}
        own = rest = 0
        for b, size, n in plain:
            marks = {id(up) for up in above[id(b)] if up.drop}
            if marks <= over:
                if any(up is e for up in above[id(b)]):
                    own += n
                else:
                    rest += size + (total if n and b.in_main else 0)
        if own and own >= WRAPS * rest:
            e.drop = 0


def _above(e: _Element | None) -> list[_Element]:
    out = []
    while e is not None:
        out.append(e)
        e = e.parent
    return out


def _dropped(e: _Element) -> bool:
    while e is not None:
        if e.drop in (2, 4) or (e.drop and not e.holds_main):
            return True
        e = e.parent
    return False


def _smooth(x: list[float]) -> list[float]:
    w = (0.25, 0.5, 0.25)
    return [sum(w[d + 1] * x[min(len(x) - 1, max(0, i + d))] for d in (-1, 0, 1)) for i in range(len(x))]


def _content(paths: dict[str, list[float]]) -> dict[str, float]:
    """Fused ratio of the content paths, from (nodes, characters, punctuation, link characters) of each path."""
    keys = list(paths)
    text = _smooth([(paths[k][1] - paths[k][3]) / paths[k][0] for k in keys])
    marks = _smooth([paths[k][2] / paths[k][0] for k in keys])
    fused = [max(t, 0.0) * math.log(2 + m) * math.sqrt(paths[k][0]) for t, m, k in zip(text, marks, keys)]
    mean = sum(fused) / len(fused)
    limit = min(max(fused), math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused)))
    return {k: f for k, f in zip(keys, fused) if f >= limit}


def main_text(page: str | None) -> str:
    """The article of a page, its blocks in page order joined by one space; empty if there is none."""
    blocks = _blocks(page or "")
    _spare_wrappers(blocks)
    blocks = [b for b in blocks if not _dropped(b[0])]
    if not blocks:
        return ""
    paths: dict[str, list[float]] = {}
    for e, text, links in blocks:
        p = paths.setdefault(e.path, [0, 0, 0, 0])
        p[0] += 1
        p[1] += len(text)
        p[2] += len(_PUNCT.findall(text))
        p[3] += min(links, len(text))
    content = _content(paths)
    # mass of content characters of every element above a content block
    mass: dict[int, float] = {}
    below: dict[int, list[_Element]] = {}
    seen: set[int] = set()
    top = None
    for e, text, _ in blocks:
        if e.path not in content:
            continue
        up = e
        while up is not None:
            mass[id(up)] = mass.get(id(up), 0.0) + len(text)
            if id(up) not in seen:
                seen.add(id(up))
                if up.parent is not None:
                    below.setdefault(id(up.parent), []).append(up)
                else:
                    top = up
            up = up.parent
    node, best = top, None
    while node is not None:
        kids = [k for k in below.get(id(node), []) if k.tag in BOX]
        best = max(kids, key=lambda k: (mass[id(k)], k.in_main), default=None)
        if best is None or mass[id(best)] < 0.7 * mass[id(top)]:
            best = None
            break
        if best.tag in ("article", "main") and not best.holds_main:
            node, best = best, None
            break
        if any(_beside(e, node, best) for e, _, _ in blocks):
            break
        node = best
    kept = []
    for e, text, _ in blocks:
        child, up = None, e
        while up is not None and up is not node:
            child, up = up, up.parent
        p = paths[e.path]
        only_links = p[3] > 0.8 * p[1] and p[0] >= 3 and e.tag != "p" and e.path not in content and not e.in_main
        aside = best is not None and child is not None and child.tag in BOX and not mass.get(id(child)) and e.tag not in ("h1", "h2")
        if up is not None and not only_links and not aside:
            kept.append(text)
    return " ".join(kept)


def _beside(e: _Element, node: _Element, best: _Element) -> bool:
    """Whether a block is part of the article at ``node`` though outside its child ``best``: a heading, or text in no box."""
    child, up = None, e
    while up is not None and up is not node:
        if up is best:
            return False
        child, up = up, up.parent
    return up is node and (e.tag in ("h1", "h2") or child is None or child.tag not in BOX and child.tag not in ("ul", "ol", "dl"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of text).

    The whole html is read; a null or empty one, and one without text, gives
    an empty text. Broken markup is closed as browsers do for paragraphs,
    lists and tables. Rows that repeat an id are each returned; other columns
    are not read; an empty table gives an empty result.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))

    def run(batches):
        for batch in batches:
            text = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
