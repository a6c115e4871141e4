"""Main text of web pages by two-pass block rules.

A linear scan cuts a page into blocks at block-level tags and line breaks, and keeps each block's length, link density, stop-word density
and place (inside an article, inside a part that is never main text). Pass 1 decides each block on its own: good, bad, or open (short or
in between). Pass 2 gives an open block the label of its nearest decided neighbour, good where two are as near or none is decided; blocks of parts
that are never main text are nobody's neighbours.

An article or main element is one feature of many: where it holds most of the good text of pass 1, blocks outside it are bad and its own
blocks have only each other as neighbours; where it doesn't, it counts for nothing.

Cases: null and empty html give an empty text; unclosed tags, comments, quotes and attributes are tolerated, a tag that never ends is dropped with
what follows; nothing else is dropped or cut; repeated rows give repeated results; ids of any type, null too, are passed on unread; an empty table
gives no rows; extra columns are not read. Time is linear in a page's length, whatever its markup.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.llm.common import map_texts

#: Frequent function words of four languages.
STOP_WORDS = frozenset(
    (
        "the of and to in is that it for was on are as with be by at this have from or an not but they which you all were her his "
        "le la les de des du et un une en est que qui dans pour par sur pas au avec plus ce se ne sont il elle nous vous "
        "der die das und den von zu mit sich ist im dem nicht ein eine als auch es an auf für wird aus bei nach wie "
        "el los las y del que en una por con para su al lo como más pero sus le ya o este sí porque esta entre cuando"
    ).split()
)
#: Elements whose content is never main text.
DROPPED = frozenset("head script style noscript template iframe object svg canvas math audio video map nav footer header aside form button select textarea fieldset label dialog menu menuitem".split())
#: Of these, the ones whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li legend main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that end an open p, as in the HTML standard's tag omission; those that end an open one of their kind.
ENDS_P = BLOCK - frozenset("br td th tr tbody thead tfoot caption option legend".split())
ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
MAIN = frozenset(("article", "main"))
#: Words that make a class or id token the name of a part that is never main text, if the token's other words only say where or what kind of box.
NOT_MAIN = frozenset(
    (
        "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay "
        "newsletter newsletters subscribe subscription signup paywall share shares sharing social related recommend recommended recommendations sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs "
        "pagination pager toolbar topbar masthead header footer foot copyright legal comment comments reply replies respond disqus discussion discussions form forms login search"
    ).split()
)
PLACES = frozenset("site page main global top bottom left right upper lower primary secondary sub mobile desktop sticky fixed box boxes container wrapper wrap block area section region list lists item items link links bar buttons button icons icon module unit slot panel inner outer row column col group holder inline floating text label title posts stories articles news more also you may like the and of to this us article entry post story blog thread form".split())
#: Whose header is its headline.
HEADED = frozenset("article entry post story blog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOPPER = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]*))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
WORD = re.compile(r"[^\W\d_]+")
SPACE = re.compile(r"\s+")
RAW_END = {name: re.compile(f"</{name}(?![a-zA-Z0-9-])[^>]*>?", re.I) for name in RAW}

#: Pass 1's limits: characters of a short block, link density of a bad one, stop-word density of a good one and of a bad one, characters of a long one.
SHORT, LINKS, STOPS_GOOD, STOPS_BAD, LONG = 70, 0.35, 0.20, 0.06, 200


def names_no_text(token: str) -> bool:
    """Whether a class or id token as a whole names a part that is never main text: `site-footer` does, `has-footer` doesn't."""
    words = {w.lower() for w in PART.findall(token)}
    found = words & NOT_MAIN
    if not found or words - NOT_MAIN - PLACES:
        return False
    return not (found <= {"header"} and words & HEADED)


def _marked(attributes: str) -> tuple[bool, bool]:
    """(never main text, main text) by attributes."""
    bad = good = False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id"):
            bad |= any(map(names_no_text, value.split()))
        elif name == "role":
            bad |= value.lower() in ROLES
            good |= value.lower() in ("main", "article")
        elif name == "hidden":
            bad = True
        elif name == "aria-hidden":
            bad |= value.lower() == "true"
        elif name == "style":
            bad |= bool(HIDDEN.search(value))
        elif name == "itemprop":
            good |= value == "articleBody"
    return bad, good


class Page:
    """A page cut into blocks, (text, characters inside links, in a dropped part, in an article) each, non-empty, in page order."""

    def __init__(self, page: str):
        self.page, self.blocks = page, []
        self.open: list[list] = []  # [name, drops, opens an article, still open], outermost first; blocks and every name have their own stacks
        self.open_blocks: list[list] = []
        self.by_name: dict[str, list[list]] = {}
        self.dropped = self.main = self.links = 0
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.missing: dict[str, int] = {}  # the places from which on the page doesn't hold a string
        self.read()

    def find(self, what: str, at: int) -> int:
        """str.find that looks for what isn't there once only."""
        if at >= self.missing.get(what, len(self.page)):
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.missing[what] = at
        return k

    def cut(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
            if text:
                self.blocks.append((text, len(SPACE.sub(" ", html.unescape("".join(self.linked))).strip()), self.dropped > 0, self.main > 0))
            self.parts.clear()
            self.linked.clear()

    def push(self, name: str, drops: bool, opens: bool) -> None:
        x = [name, drops, opens, True]
        self.open.append(x)
        self.by_name.setdefault(name, []).append(x)
        if name in BLOCK:
            self.open_blocks.append(x)
        self.dropped, self.main, self.links = self.dropped + drops, self.main + opens, self.links + (name == "a")

    def drop(self, x: list) -> None:
        """Close one element, the last open one of its name."""
        name, drops, opens, _ = x
        x[3] = False
        self.by_name[name].pop()
        self.dropped, self.main, self.links = self.dropped - drops, self.main - opens, self.links - (name == "a")

    def close(self, x: list) -> None:
        """Close a block and all in it."""
        while True:
            last = self.open.pop()
            if last[3]:
                self.drop(last)
                if last[0] in BLOCK:
                    self.open_blocks.pop()
            if last is x:
                return

    def tag_end(self, at: int) -> int:
        """The place of the > that ends a tag, by its quotes; where these don't pair, the first >; -1 without any."""
        first = self.find(">", at)
        k = at
        while m := STOPPER.search(self.page, k):
            if m[0] == ">":
                return m.start()
            value = self.page[max(at, m.start() - 64) : m.start()].rstrip()[-1:] == "="
            k = self.find(m[0], m.end()) if value else m.start()
            if k < 0 or k > m.start() and self.page[k + 1 : k + 2] not in ("", " ", "\t", "\n", "\r", "\f", "/", ">"):
                return first
            k += 1
        return first

    def read(self) -> None:
        page, at = self.page, 0
        while True:
            k = self.find("<", at)
            self.text(page[at:] if k < 0 else page[at:k])
            if k < 0:
                break
            at = self.markup(k)
        self.cut()

    def text(self, text: str) -> None:
        if text:
            self.parts.append(text)
            if self.links:
                self.linked.append(text)

    def markup(self, k: int) -> int:
        """Read what the < at k begins; returns where to go on."""
        page, size = self.page, len(self.page)
        if page.startswith("<!--", k):
            end = self.find("-->", k + 4)
            return size if end < 0 else end + 3
        if page.startswith("<![CDATA[", k):
            end = self.find("]]>", k + 9)
            self.text(page[k + 9 :] if end < 0 else page[k + 9 : end])
            return size if end < 0 else end + 3
        ends = page.startswith("</", k)
        m = NAME.match(page, k + 1 + ends)
        if not m:
            if not ends and page[k + 1 : k + 2] not in ("!", "?"):
                self.text("<")
                return k + 1
            end = self.find(">", k + 1)
            return size if end < 0 else end + 1
        end = self.tag_end(m.end())
        if end < 0:
            return size
        name, attributes = m[0].lower(), page[m.end() : end]
        if ends:
            self.end_tag(name)
            return end + 1
        return self.start_tag(name, attributes, end + 1)

    def end_tag(self, name: str) -> None:
        if name in BLOCK:
            self.cut()
        if own := self.by_name.get(name):
            if name in BLOCK:
                self.close(own[-1])
            else:  # an inline end tag ends its own element only
                if own[-1][1] or own[-1][2]:
                    self.cut()
                self.drop(own[-1])

    def start_tag(self, name: str, attributes: str, at: int) -> int:
        if name in BLOCK:
            self.cut()
            if name in ENDS_P and self.open_blocks and self.open_blocks[-1][0] == "p":
                self.close(self.open_blocks[-1])
            if self.open_blocks and self.open_blocks[-1][0] in ENDS_OWN.get(name, ()):
                self.close(self.open_blocks[-1])
                if name == "tr" and self.open_blocks and self.open_blocks[-1][0] == "tr":
                    self.close(self.open_blocks[-1])
        if name in RAW:
            m = RAW_END[name].search(self.page, at)
            return m.end() if m else len(self.page)
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            return at
        bad, good = _marked(attributes) if attributes else (False, False)
        drops, opens = name in DROPPED or bad and name not in ("html", "body", "article", "main"), name in MAIN or good
        if drops or opens:
            self.cut()
        self.push(name, drops, opens)
        return at


def blocks(page: str) -> list[tuple[str, int, bool, bool]]:
    return Page(page).blocks


def decide(text: str, linked: int, dropped: bool, inside: bool) -> int:
    """Pass 1: 1 good, -1 bad, 0 open."""
    if dropped or linked and linked > LINKS * len(text):
        return -1
    if len(text) < SHORT:
        return 0
    words = WORD.findall(text.lower())
    density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if density >= STOPS_GOOD:
        return 1
    return -1 if len(text) >= LONG and density < STOPS_BAD and not inside else 0


def labels(found: list[tuple[str, int, bool, bool]]) -> list[int]:
    """Both passes: 1 for main text, -1 for the rest."""
    label = [decide(*b) for b in found]
    good = [sum(len(b[0]) for b, x in zip(found, label) if x > 0 and b[3] == inside) for inside in (False, True)]
    trusted = any(b[3] and not b[2] for b in found) and good[1] >= good[0]
    own = [i for i, b in enumerate(found) if not b[2] and (b[3] or not trusted)]
    out = [-1] * len(found)
    near: dict[int, tuple[float, int]] = {}  # (distance, minus the label) of the nearest decided neighbour
    for order in (own, own[::-1]):
        last = None
        for place, i in enumerate(order):
            if label[i]:
                last, out[i] = (place, label[i]), label[i]
            elif last:
                near[i] = min(near.get(i, (float("inf"), 0)), (place - last[0], -last[1]))
    for i in own:
        if not label[i]:
            out[i] = -near[i][1] if i in near else 1
    return out


def extract(page: str | None) -> str:
    found = blocks(page or "")
    return " ".join(b[0] for b, x in zip(found, labels(found)) if x > 0)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (main text, blocks joined by a space), n_chars (code points), one row per row: a narrow map, no shuffle."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def start():
        def work(texts: list[str]) -> list:
            found = list(map(extract, texts))
            return [found, list(map(len, found))]

        return work

    return map_texts(rows, {"text": "string", "n_chars": "bigint"}, start)
