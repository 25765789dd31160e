"""Main text of web pages by tree scoring.

A page is parsed into a tree and its text into blocks.  Each block outside page furniture earns points for its length
and commas, discounted by the share of its text inside links, and passes them to its ancestors with decreasing weight.
The best container, the article around it if there is one, and siblings with enough points are kept.

Tags that never hold the article are thrown away.  A class, an id or a form only hints at furniture: text inside earns
less per hint.  Such a part is left out unless the best container is inside it or the article consists mainly of such.
A form inside an article that has neither its headline nor an article is left out in any case.

Pages are parsed alone, in batches, so the job has no shuffle; a page is one row by definition.  Open elements are looked
up by name and place, so time grows with the page, however deep or badly nested it is.

Defined cases: a null or empty html gives an empty text; unclosed and misnested tags close where the next block begins;
a cut tag at the end of a page is markup, not text; repeated rows each get a row; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul head title".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "head title script style template noscript iframe svg canvas object nav footer aside select button input textarea dialog menu audio video datalist".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr "
    "notice notification popup modal overlay newsletter subscribe subscription signup login share sharing social sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead comment comments commentlist disqus reply replies respond related recommended widget toolbar "
    "pagination pager paging skip copyright".split()
)
#: What is left of points earned inside a hint of furniture, and the share of plain text below which hints are ignored.
HINTED, PLAIN_SHARE = 0.25, 0.25
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What tells a form around the article from one inside it.
CORE = frozenset("article main h1".split())
#: An opening tag of the key closes an open element of the values, up to one of the walls.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = {"ul", "ol", "dl", "table", "select", "body", "article", "div", "section", "main"}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page(HTMLParser):
    """The tree of a page as parallel lists (parents come before children) and its text blocks in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.dropped, self.link = ["#root"], [0], [False], [False]
        self.hint, self.hints, self.form = [False], [0], [False]  # whether a node looks like furniture, how many do from the root to it, forms
        self.stack = [0]
        self.places: dict[str, list[int]] = {}  # where in the stack the open elements of a name are
        self.walls = [0]  # where in the stack elements are that an implied close does not go beyond
        self.outer = [0]  # where in the stack blocks are
        self.blocks: list[tuple[int, list[tuple[int, str]]]] = []
        self.open_block = False

    def _push(self, node: int, tag: str) -> None:
        depth = len(self.stack)
        self.places.setdefault(tag, []).append(depth)
        if tag in BLOCK:
            self.outer.append(depth)
        if tag in WALLS or tag in BLOCK and tag not in CLOSES:
            self.walls.append(depth)
        self.stack.append(node)

    def _pop_to(self, depth: int) -> None:
        for node in self.stack[depth:]:
            self.places[self.tag[node]].pop()
        if self.outer[-1] >= depth:
            self.open_block = False
        for places in (self.outer, self.walls):
            while places[-1] >= depth:
                places.pop()
        del self.stack[depth:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._close_implied(tag)
            self.open_block = False
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        top = self.stack[-1]
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(top)
        self.dropped.append(self.dropped[top] or self._dropped(tag, dict(attrs)))
        self.form.append(tag == "form" or (dict(attrs).get("role") or "").lower() == "form")
        self.hint.append(self.form[-1] or self._furniture(tag, dict(attrs)))
        self.hints.append(self.hints[top] + self.hint[-1])
        self.link.append(self.link[top] or tag == "a")
        self._push(node, tag)

    handle_startendtag = handle_starttag

    def _close_implied(self, tag: str) -> None:
        wall = self.walls[-1]
        closed = max((self.places[t][-1] for t in CLOSES.get(tag, ()) if self.places.get(t)), default=0)
        if closed > wall:
            self._pop_to(closed)
        elif self.tag[self.stack[wall]] == "p" and tag not in ("head", "title"):
            self._pop_to(wall)

    def handle_endtag(self, tag):
        if tag in VOID or not self.places.get(tag):
            return
        depth = self.places[tag][-1]
        if tag in BLOCK or depth > self.outer[-1]:  # an inline end tag does not close blocks
            self._pop_to(depth)

    def handle_data(self, data):
        node = self.stack[-1]
        if self.dropped[node]:
            return
        if not self.open_block:
            self.blocks.append((self.stack[self.outer[-1]], []))
            self.open_block = True
        self.blocks[-1][1].append((node, data))

    def holding(self, tags: frozenset[str]) -> list[bool]:
        """For each node, whether an element of these names is inside it."""
        out = [False] * len(self.tag)
        for i in range(len(self.tag) - 1, 0, -1):
            if out[i] or self.tag[i] in tags:
                out[self.parent[i]] = True
        return out

    def form_inside(self) -> list[bool]:
        """For each node, whether it belongs to a form that stands inside an article and has neither its headline nor an article."""
        core, inside, out = self.holding(CORE), [False] * len(self.tag), [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            inside[i] = inside[self.parent[i]] or self.tag[i] in ("article", "main")
            out[i] = out[self.parent[i]] or (self.form[i] and inside[i] and not core[i])
        return out

    def _dropped(self, tag: str, attrs: dict) -> bool:
        if tag in DROPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true" or (attrs.get("role") or "").lower() in ROLES:
            return True
        return "display:none" in (attrs.get("style") or "").replace(" ", "").lower()

    def _furniture(self, tag: str, attrs: dict) -> bool:
        if tag in ("html", "body", "main"):
            return False
        names = {p.lower() for a in ("class", "id") for p in _PART.findall(attrs.get(a) or "")}
        return bool(names & FURNITURE)


def _parsed(html: str) -> Page:
    page = Page()
    cut = html.rfind("<")
    if cut >= 0 and html.find(">", cut) < 0 and re.match(r"<[a-zA-Z/!?]", html[cut:]):
        html = html[:cut]  # a tag cut off at the end of the page
    page.feed(html)
    page.close()
    return page


def _container(page: Page, texts: list[tuple[int, str, float]]) -> tuple[list[float], int]:
    """Points of each node and the node of the best container (0: none)."""
    points = [0.0] * len(page.tag)
    fewest = min((page.hints[node] for node, text, _ in texts if len(text) >= 25), default=0)
    for node, text, linked in texts:
        if len(text) < 25:
            continue
        earned = (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - linked) * HINTED ** min(page.hints[node] - fewest, 50)
        at = node if page.tag[node] not in ("p", "pre", "blockquote", *HEADINGS) else page.parent[node]
        share = 1.0
        while at and share > 0.1:
            points[at] += earned * share
            at, share = page.parent[at], share / 2
    best = max(range(len(points)), key=lambda i: (points[i], -i))
    return points, best if points[best] > 0 else 0


def main_blocks(html: str) -> list[str]:
    """Texts of the blocks of the main content, in page order."""
    page = _parsed(html)
    texts = []
    outside = page.form_inside()
    for node, pieces in page.blocks:
        if outside[node]:
            continue
        text = " ".join("".join(t for _, t in pieces).split())
        if text:
            total = sum(len(t.strip()) for _, t in pieces) or 1
            texts.append((node, text, sum(len(t.strip()) for i, t in pieces if page.link[i]) / total))
    points, best = _container(page, texts)
    if not best:  # nothing long enough to score: an article or main element, else the body
        named = [i for i, t in enumerate(page.tag) if t in ("article", "main") and not page.dropped[i]]
        best = named[0] if named else 0
    at = best
    while at and page.tag[at] not in ("article", "main"):
        at = page.parent[at]
    if at:
        kept = {at}
    else:
        above = page.parent[best]
        siblings = [i for i in range(len(page.tag)) if page.parent[i] == above and i != best and i and not page.dropped[i] and not outside[i] and (page.hint[best] or not page.hint[i])] if best else []
        enough = max(10.0, 0.2 * points[best])
        long_enough = {}
        for node, text, linked in texts:
            long_enough[node] = long_enough.get(node, False) or (len(text) >= 80 and linked < 0.25)
        kept = {best} | {i for i in siblings if points[i] >= enough or page.tag[i] in ("h1", "h2") or page.tag[i] == "p" and long_enough.get(i)}
    heading = page.holding(HEADINGS)
    inside, headed = [False] * len(page.tag), [False] * len(page.tag)
    for i in range(len(page.tag)):
        above = page.parent[i]
        header = page.tag[i] == "header" and not heading[i]
        headed[i] = page.tag[i] == "header" or headed[above]
        inside[i] = (i in kept or (i > 0 and inside[above])) and not header
    if best == 0 and at == 0:
        inside = [not h for h in headed]
    return _without_hinted(page, best, [t for t in texts if inside[t[0]]])


def _without_hinted(page: Page, best: int, texts: list[tuple[int, str, float]]) -> list[str]:
    """The texts outside furniture, apart from furniture around ``best``; all of them if that is only a small share."""
    out = [False] * len(page.tag)
    around = {best, *_ancestors(page, best)}
    for i in range(1, len(page.tag)):
        out[i] = out[page.parent[i]] or (page.hint[i] and i not in around)
    weigh = lambda rows: sum(len(text) * (1 - linked) for _, text, linked in rows)
    plain = [t for t in texts if not out[t[0]]]
    return [text for _, text, _ in (plain if plain and weigh(plain) >= PLAIN_SHARE * weigh(texts) else texts)]


def _ancestors(page: Page, node: int) -> Iterator[int]:
    while node:
        node = page.parent[node]
        yield node


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page; needs the columns page_id, url and html."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["\n".join(main_blocks(h)) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
