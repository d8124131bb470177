"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags; scripts, styles and other raw elements, comments and declarations are
skipped. A block knows its text, how much of it is link text, and the regions it stands in: an article or main region,
and regions that a tag, a role, or a class or id marks as boilerplate (menus, headers, footers, sidebars, adverts,
notices, forms, reader comments). A mark by class or id, or by a form, does not count if its region holds most of the
page's prose: then it is a wrapper, such as a layout with a sidebar; marks of reader comments always count.

The first pass decides blocks by length, link density and stop-word density. Blocks with too much link text, and those of
a marked region, are bad. Blocks with enough stop words are good if they are long, or of some length and in an article.
Long blocks without stop words are bad, except in an article or where no long block of the page has any, which is then
in a language without a list. All others are ambiguous. In the second pass an ambiguous block inherits from its nearest
decided neighbours of the same region, before and behind: both good, or the nearer one good, makes it good. One without
decided neighbours is good only inside an article. On a page with an article, blocks outside of it are never good by
themselves: they are bad, or ambiguous if they are long prose.

Nulls: a null or empty page has the empty text. A null page_id or url is carried through; repeated rows give repeated
rows; an empty table gives an empty table. Only page_id, url and html are read. A tag that no `>` ends goes with all that
follows it. Time grows in proportion to the page, whatever its markup.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Frequent function words of some languages.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be been but by can could for from had has have he her his how if in "
    "into is it its more most no not of on one only or other our out over she so some such than that the their them "
    "then there these they this to up was we were what when which who will with would you your "
    "au aux avec ce ces cette dans de des du elle en est et ils je la le les leur mais ne nous on ou par pas plus pour "
    "que qui sa se ses son sont sur un une vous "
    "aber als am auch auf aus bei das dass dem den der des die du ein eine einem einen einer er es für hat ich ihr im "
    "in ist mit nach nicht noch nur oder sich sie sind so über um und von vor war was wenn werden wie wir zu zum zur "
    "al como con cuando del desde donde el ella ellos era esta este esto fue ha hay las lo los más muy nos o para pero "
    "por porque ser si sin sobre su sus también te tiene todo tu y ya".split()
)
#: Elements whose content is no text.
RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "textarea", "title")
#: Elements that never have content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Inline elements: they end no block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
BOILERPLATE_TAGS = frozenset("nav footer aside form button select option dialog menu fieldset head".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
ARTICLE_TAGS = frozenset(("article", "main"))
ARTICLE_NAMES = frozenset("article-body article-content post-content entry-content articlebody main-content".split())
#: Parts of class and id names that mark boilerplate.
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adbox banner sponsor sponsored promo promotion nav navbar navigation menu submenu "
    "breadcrumb breadcrumbs sidebar side aside footer foot masthead topbar toolbar cookie cookies consent gdpr notice "
    "notices disclaimer copyright popup modal overlay newsletter subscribe signup login share sharing social related "
    "recommended recommendations comment comments discussion replies reply respond disqus widget pagination pager tags skip form".split()
)
#: Those of them whose regions are never wrappers.
COMMENT_NAMES = frozenset("comment comments discussion replies reply respond disqus related recommended recommendations".split())
#: First parts of names that tell what a wrapper has.
MODIFIERS = frozenset("with has no without hide show is".split())

TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
TAG_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
ENDS = {x: re.compile(rf"</{x}\s*>", re.IGNORECASE) for x in RAW}
PARTS = re.compile(r"[a-z0-9]+")

LINK_SHARE = 1 / 3
SHORT, LONG = 40, 120
STOP_LOW, STOP_HIGH = 0.08, 0.2

GOOD, BAD, OPEN = 1, 0, None


class Region:
    """A marked region, its place among the others, and how much prose it holds. A firm mark counts in any case."""

    __slots__ = ("firm", "outer", "prose")

    def __init__(self, firm: bool, outer: Region | None):
        self.firm, self.outer, self.prose = firm, outer, 0


class Block:
    __slots__ = ("pieces", "linked", "article", "scope", "region", "text", "density")

    def __init__(self, article: bool, scope: int, region: Region | None):
        self.pieces: list[str] = []
        self.linked = 0
        self.article, self.scope, self.region = article, scope, region


def _marks(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element opens a boilerplate region, whether that mark is firm, and whether it opens an article region."""
    bad = tag in BOILERPLATE_TAGS or (tag == "header" and not in_article)  # a header inside an article holds its title
    firm, article = bad and tag != "form", tag in ARTICLE_TAGS
    if attributes and tag not in ("body", "html"):
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "role":
                bad, firm = bad or value in BOILERPLATE_ROLES, firm or value in BOILERPLATE_ROLES - {"form"}
                article = article or value in ("main", "article")
            elif name in ("class", "id"):
                for word in value.split():
                    article = article or word in ARTICLE_NAMES
                    parts = PARTS.findall(word)
                    if parts and parts[0] not in MODIFIERS and not BOILERPLATE_NAMES.isdisjoint(parts):
                        comment = not COMMENT_NAMES.isdisjoint(parts)
                        if comment or tag not in ARTICLE_TAGS:
                            bad, firm = True, firm or comment
    return bad, firm, article and not (bad and firm)


def blocks(html: str) -> list[Block]:
    """The blocks of a page with text, in page order."""
    found: list[Block] = []
    stack: list[tuple[str, bool, int, Region | None]] = []  # tag, and article, scope and region before it
    begun: Counter[str] = Counter()
    article, region = False, None
    scope = scopes = links = 0
    block = Block(article, scope, region)
    ended: dict[str, bool] = {}  # raw elements that no end follows any more

    def close() -> None:
        nonlocal block
        if block.pieces:
            found.append(block)
        block = Block(article, scope, region)

    def text(raw: str) -> None:
        if raw:
            piece = unescape(raw) if "&" in raw else raw
            block.pieces.append(piece)
            if links:
                block.linked += len(piece.strip())

    at, quotes = 0, True
    while (begin := html.find("<", at)) >= 0:
        if html.startswith("<!--", begin) or html.startswith("<![CDATA[", begin):
            text(html[at:begin])
            sign = "-->" if html[begin + 2] == "-" else "]]>"
            end = html.find(sign, begin + 4)
            if sign == "]]>":
                block.pieces.append(html[begin + 9 : end if end >= 0 else len(html)])
            at = end + 3 if end >= 0 else len(html)
            continue
        if html[begin + 1 : begin + 2] in ("!", "?"):
            text(html[at:begin])
            end = html.find(">", begin)
            at = end + 1 if end >= 0 else len(html)
            continue
        m = TAG_NAME.match(html, begin + 1)
        if not m:  # a sign in the text
            text(html[at : begin + 1])
            at = begin + 1
            continue
        text(html[at:begin])
        rest = TAG_REST.match(html, m.end()) if quotes else None
        # once quotes do not close, they are no more heeded
        end = rest.end() - 1 if rest else html.find(">", m.end())
        quotes = quotes and rest is not None
        if end < 0:
            at = len(html)
            break
        attributes, at = html[m.end() : end], end + 1
        tag, ends = m[2].lower(), bool(m[1])
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if ends else 1))
            continue
        if tag == "br":
            block.pieces.append(" ")
            continue
        close()
        if ends:
            if begun[tag]:
                while True:
                    last, article, scope, region = stack.pop()
                    begun[last] -= 1
                    if last == tag:
                        break
            links = 0
        elif tag in ENDS and not (tag in ("svg", "math") and attributes.endswith("/")):  # only these two close themselves
            stop = None if ended.get(tag) else ENDS[tag].search(html, at)
            ended[tag] = stop is None
            at = stop.end() if stop else len(html)
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append((tag, article, scope, region))
            begun[tag] += 1
            bad, firm, is_article = _marks(tag, attributes, article)
            if bad:
                region = Region(firm, region)
            if bad or is_article:
                scopes += 1
                scope, article = scopes, article or is_article
        block = Block(article, scope, region)
    text(html[at:])
    close()
    return found


def measure(found: list[Block]) -> list[Block]:
    """The blocks with a text, which and its stop-word density they then know; regions know how much prose they hold."""
    out = []
    for block in found:
        block.text = " ".join("".join(block.pieces).split())
        if not block.text:
            continue
        words = block.text.lower().split()
        block.density = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
        if block.region and block.linked <= LINK_SHARE * len(block.text) and len(block.text) >= SHORT:
            block.region.prose += len(block.text)
        out.append(block)
    return out


def wrappers(found: list[Block]) -> set[Region]:
    """The marked regions that hold most of the page's prose and so are not marked in truth."""
    total = sum(len(b.text) for b in found if b.linked <= LINK_SHARE * len(b.text) and len(b.text) >= SHORT)
    inner: list[Region] = []
    held: dict[Region, int] = {}
    seen: set[Region] = set()
    for block in found:
        region = block.region
        while region and region not in seen:
            seen.add(region)
            inner.append(region)
            region = region.outer
    # an inner region is made after those around it, so sums pass outwards once each
    depth: dict[Region, int] = {}
    for region in inner:
        path = []
        at: Region | None = region
        while at and at not in depth:
            path.append(at)
            at = at.outer
        for x in reversed(path):
            depth[x] = depth[x.outer] + 1 if x.outer else 0
    for region in sorted(inner, key=depth.__getitem__, reverse=True):
        held[region] = held.get(region, 0) + region.prose
        if region.outer and not region.firm:
            held[region.outer] = held.get(region.outer, 0) + held[region]
    return {r for r, n in held.items() if not r.firm and 2 * n > total}


def marked(block: Block, void: set[Region], known: dict[Region, bool]) -> bool:
    """Whether a region of the block counts as boilerplate."""
    path, region = [], block.region
    while region and region not in known:
        path.append(region)
        region = region.outer
    state = known[region] if region else False
    for x in reversed(path):
        state = known[x] = state or x not in void
    return state


def first_pass(block: Block, bad: bool, has_article: bool, covered: bool) -> int | None:
    """The label that the rules give to a block by itself. `covered`: a long block of the page has stop words."""
    size = len(block.text)
    if bad or (block.linked > LINK_SHARE * size and size < 4 * LONG):
        return BAD
    if block.article:
        if block.density >= STOP_LOW and size >= SHORT:
            return GOOD
        return GOOD if size >= LONG else OPEN
    prose = size >= LONG and block.density >= STOP_HIGH
    if has_article:
        return OPEN if prose else BAD
    if size < LONG:
        return OPEN
    if not covered:
        return GOOD
    return GOOD if prose else OPEN if block.density >= STOP_LOW else BAD


def second_pass(labels: list[int | None], found: list[Block]) -> list[int]:
    """Open blocks take the label of their nearest decided neighbours in the same region."""
    out = []
    before: dict[int, tuple[int, int]] = {}
    behind: list[tuple[int, int] | None] = [None] * len(labels)
    seen: dict[int, tuple[int, int]] = {}
    for i in range(len(labels) - 1, -1, -1):
        behind[i] = seen.get(found[i].scope)
        if labels[i] is not OPEN:
            seen[found[i].scope] = (i, labels[i])
    for i, label in enumerate(labels):
        if label is not OPEN:
            before[found[i].scope] = (i, label)
            out.append(label)
            continue
        left, right = before.get(found[i].scope), behind[i]
        if left and right:
            near = left if i - left[0] < right[0] - i else right  # a heading goes with what it stands before
            out.append(GOOD if left[1] and right[1] else near[1])
        elif left or right:
            out.append((left or right)[1])
        else:
            out.append(GOOD if found[i].article else BAD)
    return out


def main_text(html: str | None) -> str:
    """The good blocks of a page, white space inside a block as one space, joined by one space."""
    if not html:
        return ""
    found = measure(blocks(html))
    void, known = wrappers(found), {}
    bad = [marked(b, void, known) for b in found]
    has_article = any(b.article and not x for b, x in zip(found, bad))
    covered = any(len(b.text) >= LONG and b.density >= STOP_LOW for b in found)
    labels = second_pass([first_pass(b, x, has_article, covered) for b, x in zip(found, bad)], found)
    return " ".join(b.text for b, label in zip(found, labels) if label)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages`; each page is a row's own work, no shuffle."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`extract` over all pages."""
    return extract(table(spark, sf_dir, "pages"))
