"""Main text of web pages by the maximum-scoring contiguous region.

A page is a sequence of words and tags. Each word scores by the kind of place it stands in (paragraph, heading, link,
list, …) and each tag by its name: words are positive unless their kind is rare in content, tags are never positive. One
linear scan finds the contiguous region with the greatest sum, the page's content. Furniture inside the region (menus, page
headers and footers, sidebars, notices, adverts, forms, reader comments) goes, wherever it stands; it weighs little against
the region, so an advert does not part it. Scripts, styles, templates and markup comments hold no words at all.

Furniture is told by elements (nav, footer, aside, form, …), roles, hidden attributes, and by class and id names: whole
names, or names made of nothing but furniture words and words for places ("social-share", not "social-sciences"). Names,
forms, headers and elements that are never closed only propose it: if such a block holds most of the page's score, as a form
around a whole page does, the scores outvote its name, and what lies inside is judged anew.

The weights come from labelled pages: those that mark exactly one region with ``<article>`` or ``<main>`` say which words
and tags are content. Weights are log odds of the kind inside rather than outside of it, smoothed towards ``PRIOR``
weights; the sample is bounded by ``sample`` pages (by hash of the id). Without labelled pages the prior weights hold.

Text: character references are decoded, white space in a block becomes one space, blocks are trimmed and joined in page
order by an empty line; nothing else is dropped or cut.

Edge cases: a null or empty page has the empty text, and so has one with furniture alone; end tags may be left out wherever
HTML allows it (head, paragraphs, list items, cells), stray ones are passed over; an attribute's quotation mark that is
never closed ends with its tag; a button or the like that is never closed hides nothing; an unclosed script or comment goes
on to the page's end; a page of any length is read whole; rows with a null id take no part; repeated rows each get their row;
an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteverify.session import ship

from .common import bounded_batches, slices

SAMPLE = 2_000

#: Element names by their part in a page.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas select option textarea button title video audio map datalist".split())
RAW = frozenset("script style noscript template iframe textarea title svg math select".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
FURNITURE = frozenset("nav footer aside form menu dialog fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_LINES = INLINE | HIDDEN | {"input"}  # these do not end a line of text
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset("td th caption".split())
ITEMS = frozenset("li dt dd".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_BUTTON = frozenset("article blockquote h1 h2 h3 h4 h5 h6 main p section table".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words of class and id values that name furniture, and words that may stand beside them in such a name.
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus reply replies respond related recommended recommendations widget widgets toolbar pagination pager skip search searchform form".split())
BESIDE = frozenset("area bar block bottom box button buttons container group header inner item items left link links list main outer page panel post posts primary right row secondary section side site slot sticky text title top unit wrap wrapper".split())
COMMENTS = frozenset("comment comments commentlist reply replies respond".split())
PAGE_PARTS = frozenset("header topbar header-top site-header page-header".split())
#: Share of a page's score from which a block proposed as furniture is none.
MOST_OF_PAGE = 0.5

_QUOTED = r"\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z)"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|{_QUOTED}|[\"'])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TELLING = re.compile("class|id|role|hidden|style", re.I)
PARTS = re.compile(r"[a-z]+|[0-9]+")

#: Weights by kind before any page was seen, and how many words or tags they count for.
PRIOR = {"word p": 1.0, "word heading": 0.5, "word text": 0.3, "word item": 0.4, "word cell": 0.3, "word link": -0.3, "word furniture": -0.2, "tag p": -0.1, "tag inline": -0.05, "tag heading": -0.3, "tag item": -0.3, "tag link": -0.5, "tag block": -1.0, "tag furniture": -0.5}
PRIOR_WEIGHT, LEAST, MOST = 50.0, -4.0, 2.0


def tag_kind(name: str) -> str:
    if name == "p":
        return "tag p"
    if name == "a":
        return "tag link"
    if name in HEADINGS:
        return "tag heading"
    if name in ITEMS:
        return "tag item"
    return "tag inline" if name in INLINE else "tag block"


def names_furniture(value: str, names: frozenset[str]) -> bool:
    """Whether one of a class or id value's names is a furniture word, or is made of such and of words for places."""
    for name in value.lower().split():
        parts = [x for x in PARTS.findall(name) if not x.isdigit()]
        if any(x in names for x in parts) and all(x in names or x in BESIDE for x in parts):
            return True
    return False


@lru_cache(maxsize=1 << 12)
def attributes_of(text: str) -> dict[str, str]:
    """The first value of each attribute, by its name in small letters."""
    out: dict[str, str] = {}
    if TELLING.search(text):
        for key, *values in ATTRIBUTE.findall(text):
            out.setdefault(key.lower(), next((v for v in values if v), ""))
    return out


def proposes_furniture(name: str, attributes: str, in_content: bool) -> bool:
    if name in ("html", "body", "main") or not attributes:
        return False
    found = attributes_of(attributes)
    if found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in found.get("style", "").lower().replace(" ", ""):
        return True
    names = COMMENTS if name == "article" else NAMES
    for value in (found.get("class", ""), found.get("id", "")):
        if names_furniture(value, names) or not in_content and any(x in PAGE_PARTS for x in value.lower().split()):
            return True
    return False


class Open(NamedTuple):
    """An open element: its name, the innermost furniture it stands in (a place in Page.roots, or -1), whether it stands in
    marked content, whether it is hidden, whether it is itself that furniture."""

    name: str
    root: int
    content: bool
    hidden: bool
    is_root: bool


class Page:
    """The page as a list of tokens: (kind, words, block number or -1, text, in marked content, innermost furniture or -1).
    ``roots``: for each furniture block the one around it, and whether scores may outvote it."""

    def __init__(self, html: str):
        self.tokens: list[tuple[str, int, int, str, bool, int]] = []
        self.roots: list[list] = []
        self.marks = 0
        self.open: list[Open] = []
        self.names: Counter[str] = Counter()  # open elements by name
        ends = Counter(x.lower() for x in re.findall(r"</([a-zA-Z][^\s/>]*)", html))
        block, at = 0, 0
        for m in TOKEN.finditer(html):
            if m.start() < at:
                continue
            if m.start() > at:
                self._text(html[at : m.start()], block)
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    self._text(m[0][9:].removesuffix("]]>"), block, plain=True)
                continue
            name = m[2].lower()
            if m[1]:
                ends[name] -= 1
                root, content = self._around()
                if self.names[name]:
                    while self.open[-1].name != name:
                        self._pop()
                    root = self.open[-1].root
                    if self.open[-1].is_root:
                        self.roots[root][1] = self.roots[root][2]
                    self._pop()
                if name not in IN_LINES:
                    block += 1
                self.tokens.append((tag_kind(name), 0, -1, "", content, root))
                continue
            if self.names["head"] and name not in IN_HEAD and name != "head":
                self._close(("head",), ())
            if name in CLOSES_P:
                self._close(("p",), (), INLINE)
            if name in CLOSES_BUTTON or name == "button":
                self._close(("button",), ())
            if name == "a":
                self._close(("a",), ())
            if name in ITEMS or name in CELLS or name == "tr":
                self._close(ITEMS if name in ITEMS else CELLS if name in CELLS else ("tr",), ("ul", "ol", "dl", "table", "menu"))
            root, content = self._around()
            proposed = proposes_furniture(name, m[3], content)
            by_name = name in FURNITURE or name == "header" and not content
            if proposed or by_name:
                # whether scores may outvote it, as long as its end tag wasn't met; and after that
                self.roots.append([root, True, proposed or name in ("form", "fieldset", "header")])
                root = len(self.roots) - 1
            marked = name in ("article", "main")
            if marked and not content and root < 0:
                self.marks += 1
            if name not in IN_LINES:
                block += 1
            elif name == "br":
                self.tokens.append(("tag inline", 0, block, " ", content, root))
                continue
            self.tokens.append((tag_kind(name), 0, -1, "", content, root))
            if name in VOID or m[3].endswith("/") and name in RAW:
                continue
            if name in RAW:
                at = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)|\Z", re.I).search(html, at).end()
                continue
            hidden = bool(self.open) and self.open[-1].hidden or name in HIDDEN and ends[name] > 0
            self.open.append(Open(name, root, content or marked, hidden, proposed or by_name))
            self.names[name] += 1
        if at < len(html):
            self._text(html[at:], block)

    def _around(self) -> tuple[int, bool]:
        return (self.open[-1].root, self.open[-1].content) if self.open else (-1, False)

    def _pop(self) -> None:
        self.names[self.open.pop().name] -= 1

    def _close(self, names, until, through=None) -> None:
        """Ends the innermost open element of these names, and what is open inside it; not beyond an element of ``until``,
        nor beyond any that is not of ``through``."""
        if not any(self.names[x] for x in names):
            return
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i].name
            if name in names:
                while len(self.open) > i:
                    self._pop()
                return
            if name in until or through is not None and name not in through:
                return

    def _text(self, text: str, block: int, plain: bool = False) -> None:
        if self.names["head"] and text.strip() and not (self.open and self.open[-1].hidden):
            self._close(("head",), ())
        if self.open and self.open[-1].hidden:
            return
        root, content = self._around()
        text = text if plain else unescape(text)
        kind = "word text"
        for name, *_ in reversed(self.open):
            if name == "a":
                kind = "word link"
            elif name == "p" or name in ("blockquote", "pre"):
                kind = "word p"
            elif name in HEADINGS:
                kind = "word heading"
            elif name in ITEMS:
                kind = "word item"
            elif name in CELLS:
                kind = "word cell"
            elif name in INLINE:
                continue
            break
        self.tokens.append((kind, len(text.split()), block, text, content, root))

    def furniture(self, weights: dict[str, float]) -> list[bool]:
        """Which of the proposed blocks are furniture: not those that hold most of the page's score and may be outvoted."""
        if not self.roots:
            return []
        score, total = [0.0] * len(self.roots), 0.0
        for kind, words, _, _, _, root in self.tokens:
            if words and (gain := weights[kind] * words) > 0:
                total += gain
                if root >= 0:
                    score[root] += gain
        for i in range(len(score) - 1, -1, -1):
            if self.roots[i][0] >= 0:
                score[self.roots[i][0]] += score[i]
        out: list[bool] = []
        for (around, open_to_votes, _), own in zip(self.roots, score):
            out.append(around >= 0 and out[around] or not (open_to_votes and own > MOST_OF_PAGE * total))
        return out

    def judged(self, weights: dict[str, float]) -> list[tuple[str, int, int, str, bool, bool]]:
        """The tokens with their final kinds, and whether they are furniture."""
        gone = self.furniture(weights)
        kept = []
        for kind, words, block, text, content, root in self.tokens:
            is_gone = root >= 0 and gone[root]
            kept.append((f"{kind.split()[0]} furniture" if is_gone else kind, words, block, text, content, is_gone))
        return kept

    def counts(self) -> dict[tuple[str, bool], int]:
        """Words and tags by kind and by whether they stand in marked content."""
        out: dict[tuple[str, bool], int] = defaultdict(int)
        for kind, words, _, _, content, _ in self.judged(PRIOR):
            out[kind, content] += words if kind.startswith("word") else 1
        return out

    def text(self, weights: dict[str, float]) -> str:
        tokens = self.judged(weights)
        first, last = region(tokens, weights)
        blocks: dict[int, list[str]] = {}
        for _, _, block, text, _, gone in tokens[first:last]:
            if block >= 0 and not gone:
                blocks.setdefault(block, []).append(text)
        joined = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n\n".join(x for x in joined if x)


def region(tokens, weights: dict[str, float]) -> tuple[int, int]:
    """First and last + 1 of the tokens (kind, words, …) with the greatest sum of scores; of equal ones the first, and the
    longest."""
    best, total, begin = (0.0, 0, 0), 0.0, 0
    for i, (kind, words, *_) in enumerate(tokens):
        total += weights[kind] * (words if kind.startswith("word") else 1)
        if total > best[0] or total == best[0] > 0 and begin == best[1]:
            best = (total, begin, i + 1)
        if total < 0:
            total, begin = 0.0, i + 1
    return best[1], best[2]


def weights_from(counts: dict[tuple[str, bool], float]) -> dict[str, float]:
    """Log odds by kind, from the counts inside and outside of marked content; tags are never positive."""
    from math import log

    out = {}
    for group in ("word", "tag"):
        kinds = [k for k in PRIOR if k.startswith(group)]
        inside, outside = (sum(counts.get((k, side), 0) for k in kinds) for side in (True, False))
        for kind in kinds:
            a, b = counts.get((kind, True), 0), counts.get((kind, False), 0)
            odds = log((a + 0.5) / (inside + 1)) - log((b + 0.5) / (outside + 1)) if inside and outside else PRIOR[kind]
            value = (odds * (a + b) + PRIOR[kind] * PRIOR_WEIGHT) / (a + b + PRIOR_WEIGHT)
            if kind.endswith("furniture"):  # left out anyway; it must not part a page's content in two
                value = PRIOR[kind]
            elif group == "tag":
                value = min(value, -0.02)
            out[kind] = max(LEAST, min(MOST, value))
    return out


def learned_weights(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from a bounded sample of the pages that mark one region."""
    share = min(1.0, sample / max(1, pages.count()))

    def run(batches):
        for batch in batches:
            total: dict[tuple[str, bool], int] = defaultdict(int)
            for html in batch.column("html").to_pylist():
                page = Page(html)
                if page.marks == 1:
                    for key, n in page.counts().items():
                        total[key] += n
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total]), pa.array([k[1] for k in total]), pa.array(list(total.values()), pa.int64())], ["kind", "content", "n"])

    chosen = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select("html")
    rows = chosen.mapInArrow(run, "kind string, content boolean, n long").groupBy("kind", "content").agg(F.sum("n").alias("n")).collect()  # two rows a kind at most
    return weights_from({(r["kind"], r["content"]): r["n"] for r in rows})


def main_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    ship(pages.sparkSession)
    bounded_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).where("page_id IS NOT NULL")
    weights = learned_weights(pages, sample)

    def run(batches):
        for batch in slices(batches, column="html"):
            texts = [Page(html).text(weights) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
