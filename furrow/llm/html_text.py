"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags; each has its length, its share of link characters
and of stop words, and marks of the elements around it. The first pass decides what these tell: blocks
in menus, footers, sidebars, notices, adverts, forms and comments, and blocks made of links, are
not text; long blocks with stop words and few links are. Blocks that are too short, or not clear,
stay open. The second pass gives them the label of the nearest decided neighbours: both alike, that
one; else the nearer one. At a page's ends, and at the borders of an article or main element,
stands a decided neighbour too: text inside of such an element, none outside. Where a page has
an article or main element, blocks outside of them are not text; inside of it adverts and the like are no
neighbours, and the links of paragraphs and headings count as prose.

Whole pages are read, in one pass without a shuffle; the blocks of a batch of pages are judged on
arrays. Null or empty html, and pages without any text block, give an empty text and 0. Malformed
tags are read as browsers do: unclosed elements end with what holds them, a ``<`` that begins no
tag is text. Ties between two equally near neighbours go to text for a heading before text, and inside
an article for a block with some stop words, else to none. Repeated rows, and rows with equal or null ids, are
read each for itself; an empty table gives an empty one. Only page_id, url and html are read, so other columns
may have any name.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import slices
from .common import Remembered

#: Frequent function words of English, German, French, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = """
a about after all also an and any are as at be because been but by can could do for from had has have he her his if in into is it its
more not of on one or our she so some than that the their them then there they this to up was we were what when which who will with would you
aber als am an auch auf aus bei bis da das dass dem den der des die doch ein eine einem einen einer er es für hat ich im in ist ja kann man
mit nach nicht noch nur oder sein sich sie sind so über um und vom von vor war was wenn wie wir wird zu zum zur
au aux avec ce ces cette dans de des du elle en est et été être il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui
sa se ses si son sont sur un une vous
al como con cuando de del desde e el ella en entre era es esta este está fue ha hasta la las le lo los más me muy no o para pero por que se ser si
sin sobre son su sus también un una uno y ya
anche che chi da dei del della di gli il io nel non per più quando questo sono tra una
ao as com das do dos ela ele em foi mais mas na nas nem nos os pela pelo quem seu sua são também uma
aan dat de deze die dit door een en er het hij ik in is je maar met naar niet nog of om ook op te tot uit van voor was wat we wordt zijn zo
""".split()
STOP = frozenset(STOP_WORDS)

#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their own end tag; none of it is shown as text.
RAW = frozenset("script style noscript iframe noframes noembed xmp title textarea template svg object canvas audio video map select".split())
TO_THE_END = frozenset("script style title textarea xmp".split())
#: Elements that hold no article text.
BARRED = frozenset("nav footer aside form button dialog menu search datalist".split())
#: Elements whose name alone tells something.
TELLING = BARRED | {"article", "main", "header"}
#: Roles that hold no article text.
BARRED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar tooltip".split())
#: Words of a class or id that name what is no article text.
BARRED_WORDS = frozenset("""
ad ads advert adverts advertisement advertisements advertising adsense adbox adslot banner banners sponsor sponsors sponsored promo promos promotion
nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar aside toc pager pagination skip toolbar topbar masthead header footer
cookie cookies consent gdpr notice notices disclaimer copyright legal alert popup modal overlay lightbox newsletter subscribe subscription paywall
form login signin signup register search comment comments disqus discussion replies reply respond feedback related recommended recommendations teaser
share sharing social widget widgets
""".split())
#: Words before or after a barred word that take its meaning away, and words of an article's own header.
EXCUSED = frozenset("has have with without no non free".split())
OWN_HEADER = frozenset("article post entry story content page".split())
#: Classes and ids of the article's own element.
MAIN_NAMES = frozenset("article article-body article-content article-text articlebody post-content post-body entry-content entry-body story-body story-content main main-content maincontent content-main page-content content".split())
#: Elements whose links are part of an article's prose.
PROSE_NAMES = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption summary dd".split())
CLOSES_P = BLOCKS - frozenset("body head html title option optgroup legend caption tbody td tfoot th thead tr".split())
#: An opening of the same kind ends an open element, up to the element that holds it.
SIBLINGS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

#: Thresholds of the two passes: link shares, characters and stop-word shares.
MAX_LINKS, MAX_LINKS_INSIDE, SHORT, LONG, SOME_STOP, MANY_STOP = 0.2, 0.5, 70, 140, 0.05, 0.12

TAG = re.compile(
    r"""<(?:(?P<comment>!--(?:-?>|.*?(?:--!?>|\Z)))|(?P<bogus>[!?][^>]*(?:>|\Z)|/(?![a-zA-Z])[^>]*(?:>|\Z))|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(?:>|\Z))""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
EDGE = ".,;:!?()[]{}\"'«»„“”‚‘’…*#%&$|<>-–—"

#: 1 for a stop word, whatever its case and the marks around it, else 0.
STOPS = Remembered(lambda w: int(w.strip(EDGE).lower() in STOP))

#: Marks of open elements: what they hold is no article text; a link; a heading; text that isn't the block's around it; prose; of blocks: a copyright line.
BARS, LINK, HEADING, SKIP, PROSE, NOTICE = 1, 2, 4, 8, 16, 32
#: What may hold the article: an element named like one, a main element, an article element. The highest of a page counts.
NAMED, MAIN, ARTICLE = 1, 2, 3


@dataclass
class Block:
    text: str
    link_chars: int
    words: int
    stop_words: int
    marks: int
    level: int  # what holds it: NAMED, MAIN, ARTICLE, or 0
    inside: int  # number of the element that does


@dataclass
class Reader:
    """Cuts one page into blocks."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[tuple[str, int, int, int]] = field(default_factory=list)  # name, marks, level, inside
    open: dict[str, int] = field(default_factory=dict)
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    mains: int = 0

    def around(self) -> tuple[int, int, int]:
        return self.stack[-1][1:] if self.stack else (0, 0, 0)

    def push(self, name: str, marks: int, level: int, inside: int) -> None:
        self.stack.append((name, marks, level, inside))
        self.open[name] = self.open.get(name, 0) + 1

    def pop(self) -> None:
        self.open[self.stack.pop()[0]] -= 1

    def close(self, name: str, until: tuple[str, ...] = ()) -> None:
        """End the innermost element of this name, and what is open inside it; with ``until``, only
        if none of those elements lies between."""
        if not self.open.get(name):
            return
        if until:
            for other, *_ in reversed(self.stack):
                if other in until:
                    return
                if other == name:
                    break
        if name in BLOCKS:
            self.flush()
        while self.stack:
            ended = self.stack[-1][0]
            if ended in BLOCKS:
                self.flush()
            self.pop()
            if ended == name:
                return

    def flush(self) -> None:
        """End the current block."""
        if not self.parts:
            return
        words = "".join(self.parts).split()
        if words:
            links = sum(len(w) for w in "".join(self.linked).split())
            stop = sum(map(STOPS.__getitem__, words))
            marks, *where = self.around()
            marks |= NOTICE * (words[0].lower() in ("©", "(c)", "copyright"))
            self.blocks.append(Block(" ".join(words), links, len(words), stop, marks, *where))
        self.parts, self.linked = [], []

    def text(self, raw: str) -> None:
        marks = self.around()[0]
        if marks & SKIP:
            return
        shown = html.unescape(raw) if "&" in raw else raw
        self.parts.append(shown)
        if marks & LINK:
            self.linked.append(shown)

    def begin(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.flush()
            if name in CLOSES_P:
                self.close("p", ("button", "table", "td", "th", "li", "div"))
        if name in SIBLINGS and self.stack:
            self.close(name, SIBLINGS[name])
            if name in ("td", "th"):
                self.close("th" if name == "td" else "td", SIBLINGS[name])
            elif name in ("dt", "dd"):
                self.close("dd" if name == "dt" else "dt", SIBLINGS[name])
        elif name[0] == "h" and name[1:].isdigit():
            for other in "123456":
                self.close(f"h{other}", ("div", "section", "article", "td", "li"))
        elif name == "a":
            self.close("a", ("div", "td", "li", "section", "article", "nav"))
        elif name in ("article", "main"):
            self.close("nav")  # a menu that was left open
        if name == "br":
            self.text("\n")
        if name in VOID:
            if name == "hr":
                self.flush()
            return
        marks, level, inside = self.around()
        if attributes or name in TELLING:
            marks, level, inside = self.told(name, attributes, marks, level, inside)
        if name in BLOCKS:
            marks = marks | PROSE if name in PROSE_NAMES else marks & ~PROSE
        if name == "a":
            marks |= LINK
        elif name[0] == "h" and name[1:].isdigit():
            marks |= HEADING
        self.push(name, marks, level, inside)

    def told(self, name: str, attributes: str, marks: int, level: int, inside: int) -> tuple[int, int, int]:
        """Marks, level and number inside an element, from those around it and what its name and attributes tell."""
        given = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes.strip(" \t\n\r\f/") else {}
        names, role = f"{given.get('class', '')} {given.get('id', '')}", given.get("role", "").lower()
        holds = self.holds(name, role, names, given)
        if name == "main":
            marks &= ~BARS
        of_name = name not in ("html", "body") and barred(names, holds >= MAIN, level > 0)
        if name in BARRED or role in BARRED_ROLES or name == "header" and not level or hidden(given) or of_name:
            marks |= BARS if marks & BARS or name in BLOCKS else BARS | SKIP
        elif holds > level and not marks & BARS:
            self.mains += 1
            level, inside = holds, self.mains
        return marks, level, inside

    @staticmethod
    def holds(name: str, role: str, names: str, given: dict[str, str]) -> int:
        if name == "article" or role == "article" or given.get("itemprop", "").lower() == "articlebody":
            return ARTICLE
        if name == "main" or role == "main":
            return MAIN
        return NAMED if name in ("div", "section", "td") and MAIN_NAMES & {*names.lower().split()} else 0


def hidden(given: dict[str, str]) -> bool:
    style = given.get("style", "").replace(" ", "").lower()
    return "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


def barred(names: str, main: bool, inside: bool) -> bool:
    """Whether a class or id names what is no article text. An article element is so if it is a comment or a teaser."""
    for one in names.split():
        words = [w.lower() for w in WORD_PARTS.findall(one)]
        for i, w in enumerate(words):
            if w not in BARRED_WORDS or EXCUSED & {*words[max(i - 1, 0) : i], *words[i + 1 : i + 2]}:
                continue
            if w == "header" and (inside or OWN_HEADER & set(words)):
                continue
            if main and w not in ("comment", "comments", "reply", "teaser", "related", "ad", "advert", "advertisement", "sponsored", "promo"):
                continue
            return True
    return False


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order."""
    r, at = Reader(), 0
    lower = None
    for m in iter(lambda: TAG.search(page, at), None):
        if m.start() > at:
            r.text(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name == "p" and not r.open.get("p"):
                r.flush()
            elif name == "br":
                r.text("\n")
            elif name[0] == "h" and name[1:].isdigit():
                for other in "123456":
                    r.close(f"h{other}", ("div", "section", "article", "td", "li"))
            else:
                r.close(name)
            continue
        if name in RAW and not (name == "svg" and m["attributes"].endswith("/")):
            if name in BLOCKS:
                r.flush()
            begun = at
            lower = page.lower() if lower is None else lower
            if len(lower) != len(page):  # a letter that grows in lower case
                lower = re.sub("[A-Z]", lambda c: c[0].lower(), page)
            at = lower.find(f"</{name}", at)
            while at >= 0 and at + len(name) + 2 < len(page) and page[at + len(name) + 2] not in " \t\n\r\f/>":
                at = lower.find(f"</{name}", at + 1)
            if at < 0:  # never ended: scripts and the like go to the page's end, of others only the tag
                at = len(page) if name in TO_THE_END else begun
            else:
                at = page.find(">", at) + 1 or len(page)
            continue
        r.begin(name, m["attributes"])
    if at < len(page):
        r.text(page[at:])
    while r.stack:
        if r.stack[-1][0] in BLOCKS:
            r.flush()
        r.pop()
    r.flush()
    return r.blocks


def first_pass(chars, links, words, stop, marks, inside, has_main, known) -> np.ndarray:
    """1 text, -1 none, 0 open; on arrays of blocks. Pages in languages whose stop words aren't
    ``known`` are judged by length and links."""
    link, stops = links / np.maximum(chars, 1), np.where(known, stop / np.maximum(words, 1), MANY_STOP)
    within = inside > 0
    label = np.zeros(len(chars), dtype=np.int8)
    label[(chars > LONG) & (stops >= MANY_STOP)] = 1
    label[(chars >= SHORT) & (stops < SOME_STOP) & ~within] = -1
    label[within & (chars >= SHORT) & (stops >= SOME_STOP)] = 1
    label[(link > np.where(within, MAX_LINKS_INSIDE, MAX_LINKS)) & ~(within & ((marks & PROSE) > 0))] = -1
    label[((marks & NOTICE) > 0) & ~within] = -1
    label[(marks & BARS) > 0] = -1
    label[~within & has_main] = -1
    return label


def second_pass(label, page, inside, stops, heading) -> np.ndarray:
    """Open blocks take the label of the nearest decided neighbours of their page and element."""
    n = len(label)
    if not n:
        return label
    at = np.arange(n)
    group = np.concatenate([[True], (page[1:] != page[:-1]) | (inside[1:] != inside[:-1])])
    start = np.maximum.accumulate(np.where(group, at, 0))
    last = np.concatenate([group[1:], [True]])
    stop = np.minimum.accumulate(np.where(last, at, n)[::-1])[::-1]
    edge = np.where(inside > 0, 1, -1)
    before = np.maximum.accumulate(np.where(label != 0, at, -1))
    after = np.minimum.accumulate(np.where(label != 0, at, n)[::-1])[::-1]
    own_before, own_after = before >= start, after <= stop
    left = np.where(own_before, label[np.maximum(before, 0)], edge)
    right = np.where(own_after, label[np.minimum(after, n - 1)], edge)
    to_left = at - np.where(own_before, before, start - 1)
    to_right = np.where(own_after, after, stop + 1) - at
    nearer = np.where(to_left < to_right, left, np.where(to_right < to_left, right, np.where((inside > 0) & (stops >= SOME_STOP) | heading & (right > 0), 1, -1)))
    return np.where(label != 0, label, np.where(left == right, left, nearer))


def labelled(pages: list[list[Block]]) -> list[np.ndarray]:
    """Whether each block of each page is main text."""
    flat = [b for p in pages for b in p]
    sizes = np.array([len(p) for p in pages])
    page = np.repeat(np.arange(len(pages)), sizes)
    columns = np.array([(len(b.text), b.link_chars, b.words, b.stop_words, b.marks, b.level, b.inside) for b in flat], dtype=np.int64).reshape(-1, 7).T
    chars, links, words, stop, marks, level, inside = columns
    top = np.zeros(len(pages), dtype=np.int64)
    np.maximum.at(top, page, np.where(marks & BARS, 0, level))
    inside = np.where(level == top[page], inside, 0)
    heading = (marks & HEADING) > 0
    after = np.concatenate([np.where(page[1:] == page[:-1], inside[1:], 0), [0]])[: len(page)]
    inside = np.where(heading & (inside == 0) & ((marks & BARS) == 0), after, inside)  # a title right before the article
    share = np.bincount(page, stop, len(pages)) / np.maximum(np.bincount(page, words, len(pages)), 1)
    label = first_pass(chars, links, words, stop, marks, inside, top[page] > 0, share[page] >= SOME_STOP / 5)
    apart = (inside > 0) & ((marks & BARS) > 0)  # an advert within an article tells nothing of the text around it
    label = np.where(apart, -1, second_pass(np.where(apart, 0, label), page, inside, stop / np.maximum(words, 1), heading))
    return np.split(label > 0, np.cumsum(sizes)[:-1]) if len(pages) else []


def extract(pages: DataFrame, batch_chars: int = 4_000_000) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks (text blocks) and n_left (blocks that are none)."""

    def rows(batches):
        for batch in batches:
            for part in slices(batch, batch_chars, 2):
                STOPS.trim()
                cut = [blocks_of(h or "") for h in part.column(2).to_pylist()]
                kept = labelled(cut)
                text = [" ".join(b.text for b, k in zip(bs, ks) if k) for bs, ks in zip(cut, kept)]
                numbers = [[len(t) for t in text], [int(k.sum()) for k in kept], [int((~k).sum()) for k in kept]]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)], ["page_id", "url", "text", "n_chars", "n_blocks", "n_left"])

    return pages.select("page_id", "url", "html").mapInArrow(rows, "page_id long, url string, text string, n_chars long, n_blocks long, n_left long")
