"""HTML extraction by tag-path ratios.

A page's text nodes are grouped by their path of elements from the root (names with class and id). Each path sums up the length of
its text, the part in links, and its punctuation. Text per node and punctuation per node are smoothed over the paths
that come before and after in page order and fused into one score. Class, id and role names that usually mark notices, widgets or
forms lower their paths' scores. Paths that reach a fraction of the best score are content.

The scores choose the part of the page that is read: the elements marked as an article, if content paths hold a fair share of their
weight inside them, else the smallest element that holds nearly all of it. In that part a container goes if none of its
paths is content and it is made of links, or it has one of the names above, or (outside a marked article) it doesn't lie between
content; nothing is left out for being short. Menus, footers, sidebars, adverts, page headers, form controls and comments never count where
elements, roles or unmistakable names mark them, headings excepted. A form that holds most of a page's text is a wrapper, no form.

A page is a row of its own: no shuffle, and a page's cost and memory follow its length: paths are numbered by parent and name.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: The slash of a tag that closes itself, and not the end of an unquoted value.
CLOSED = re.compile(r"""(?:^|[\s"'])/$""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup. Without an end, script and style take the rest of the page; of the others only the tag is skipped.
RAW = frozenset("script style noscript iframe template textarea title".split())
#: Elements that authors close in the tag itself.
SELF_CLOSED = frozenset("svg math object iframe template noscript textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br button cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an opening tag ends where they are open.
ENDED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SECTIONS = frozenset("html body main article section div td blockquote center header form fieldset".split())
WHOLE = frozenset("html body main article".split())
NEVER = frozenset("head nav footer aside button select input dialog menu object svg legend optgroup option datalist".split())
NEVER_ROLES = frozenset("navigation contentinfo complementary search dialog alertdialog menu menubar toolbar".split())
#: Words of class and id names. A name of such words alone, at least one of them a tell-tale, marks an element as no part of the article, whatever its
#: text; one that has any other word (social-history, comments-on-methods) says nothing. A menu within an article is judged by its links.
TELLTALE = frozenset(
    """ad ads adv adsense advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion promotions cookie cookies consent gdpr popup modal overlay
    newsletter newsletters subscribe nav navs navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar footer comment comments disqus respond replies share sharing social
    addthis related recommended recommendations login signup search skip""".split()
)
OF_WIDGETS = frozenset(
    """site page global top main bottom left right header head body box boxes section area list thread item items text form wrapper wrap container content block bar banner notice popup policy link
    links button buttons icon icons widget widgets slot unit space placeholder post posts article articles story stories news reading media tools toolbar toolbox count title inner outer primary secondary
    mobile desktop fixed sticky dialog panel card cards group row col column input field small large this follow us""".split()
)
PARTED = re.compile(r"(?<![a-z])(sign|log|side|nav)[-_]?(up|in|bar)(?![a-z])", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+(?:x[0-9]+)?|[^\W\d_a-zA-Z]+")
#: Whole names of page headers: no part of the article unless they lie in it.
HEADERS = re.compile(r"(?:(?:site|page|global|top|main)[-_])?(?:header|masthead|banner|topbar)|top-?bar", re.I)
#: Whole names that lower a container's score.
DOUBTFUL = re.compile(r"(?:.+[-_])?(?:alerts?|notices?|notifications?|announcements?|disclaimer|widgets?|form|banner|copyright|legal)(?:[-_].+)?", re.I)
ARTICLE = re.compile(r"article|articlebody|main|main-content|post-content|entry-content|article-body|article-content|post-body|story-body", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？؟]")
DOUBT = 0.2


def unmistakable(name: str, in_article: bool) -> bool:
    """Whether a class or id name marks a widget, advert, notice or comment. A plain `menu` in an article may be what the article is about."""
    words = [w.lower() for w in WORDS.findall(PARTED.sub(lambda m: (m[1] + m[2]).lower(), name))]
    known = all(w in TELLTALE or w in OF_WIDGETS or w[0].isdigit() for w in words)
    return known and any(w in TELLTALE for w in words) and not (in_article and words in (["menu"], ["menus"]))


class Element:
    """An open element. block: the nearest one that is not inline; container: the number of the nearest section."""

    __slots__ = ("name", "path", "never", "link", "block", "container", "article", "foreign")

    def __init__(self, name: str, path: int, above: Element | None):
        self.name, self.path = name, path
        self.never = self.link = self.article = self.foreign = False
        self.block, self.container = self, 0
        if above:
            self.never, self.link, self.container, self.article, self.foreign = above.never, above.link, above.container, above.article, above.foreign


class Block:
    __slots__ = ("parts", "path", "name", "container", "linked", "text")

    def __init__(self, at: Element):
        self.parts, self.path, self.name, self.container, self.linked, self.text = [], at.path, at.name, at.container, 0, ""


class Container:
    __slots__ = ("parent", "marked", "form", "doubtful")

    def __init__(self, parent: int, marked: bool, form: bool, doubtful: bool):
        self.parent, self.marked, self.form, self.doubtful = parent, marked, form, doubtful


class Page:
    """A page's blocks with text outside elements that never count, in page order, and the sections they lie in."""

    def __init__(self, page: str):
        self.containers = [Container(0, False, False, False)]
        self.numbers: dict[tuple[int, str], int] = {}
        self.doubtful: set[int] = set()
        self.stack = [Element("", 0, None)]
        self.open: Counter = Counter()
        self.blocks: list[Block] = []
        self.unclosed: set[str] = set()
        self.read(page)
        for b in self.blocks:
            b.text = " ".join(html.unescape("".join(b.parts)).split())
        self.blocks = [b for b in self.blocks if b.text]

    def opened(self, name: str, attributes: str) -> None:
        above = self.stack[-1]
        found = ATTRIBUTE.findall(attributes) if attributes else ()
        marks = " ".join(a or b or c for _, a, b, c in found)
        path = self.numbers.setdefault((above.path, f"{name} {marks}" if marks else name), len(self.numbers) + 1)
        e = Element(name, path, above)
        doubtful = above.path in self.doubtful
        names = [n for key, a, b, c in found if key.lower() != "role" for n in (a or b or c).split()]
        roles = [r.lower() for key, a, b, c in found if key.lower() == "role" for r in (a or b or c).split()]
        marked = name in ("article", "main") or "main" in roles or (name in SECTIONS and any(ARTICLE.fullmatch(n) for n in names))
        if name in INLINE and above.name:
            e.block = above.block
        e.link = e.link or name == "a"
        e.foreign = e.foreign or name == "svg"
        if name not in HEADINGS and not e.never:
            e.never = name in NEVER or any(r in NEVER_ROLES for r in roles)
            if name not in WHOLE:
                e.never = e.never or any(unmistakable(n, above.article) for n in names)
                page_header = name == "header" or "banner" in roles or any(HEADERS.fullmatch(n) for n in names)
                e.never = e.never or (page_header and not above.article)
        e.article = above.article or marked
        if name in SECTIONS:
            doubtful = doubtful or (name not in WHOLE and ("alert" in roles or any(DOUBTFUL.fullmatch(n) for n in names)))
            e.container = len(self.containers)
            self.containers.append(Container(above.container, marked and not e.never, name == "form" or "form" in roles, doubtful))
        if doubtful:
            self.doubtful.add(path)
        self.stack.append(e)
        self.open[name] += 1

    def close(self, at: int) -> None:
        for e in self.stack[at:]:
            self.open[e.name] -= 1
        del self.stack[at:]

    def read(self, page: str) -> None:
        stack, blocks = self.stack, self.blocks
        fresh, at, end = True, 0, len(page)
        while at < end:
            found = MARKUP.search(page, at)
            text = page[at : found.start()] if found else page[at:]
            top = stack[-1]
            if text and not top.never:
                if fresh:
                    blocks.append(Block(top.block))
                    fresh = False
                blocks[-1].parts.append(text)
                if top.link:
                    blocks[-1].linked += len(text)
            if not found:
                break
            at = found.end()
            name = found[2]
            if name is None:
                continue
            name = name.lower()
            inline = name in INLINE or self.open["math"] > 0
            if not inline:
                fresh = True
            if found[1]:
                if self.open[name]:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].name == name:
                            self.close(i)
                            break
                        if inline and stack[i].name not in INLINE and not self.open["math"]:
                            break
                continue
            if name == "br" and blocks and not fresh:
                blocks[-1].parts.append(" ")
            closed = bool(CLOSED.search(found[3]))
            if closed and (name in SELF_CLOSED or top.foreign or self.open["math"]):
                continue
            if name in RAW:
                # one that has no end has none further on either: the rest of the page is searched once for each name
                close = None if name in self.unclosed else re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
                if close is None:
                    self.unclosed.add(name)
                if close is not None:
                    at = page.find(">", close.end())
                    at = end if at < 0 else at + 1
                elif name in ("script", "style"):
                    break
                continue
            if name in ENDS_P or name in ENDED:
                if top.foreign:  # an element of the page itself ends a drawing that was never closed
                    self.close(next(i for i, e in enumerate(stack) if e.foreign))
                ends = ENDED.get(name, {"p"})
                if any(self.open[e] for e in ends):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].name in ends:
                            self.close(i)
                            break
                        if stack[i].name in LISTS or (stack[i].name in SECTIONS and name not in ENDED):
                            break
            if name not in VOID and not (closed and name in INLINE):
                self.opened(name, found[3])


def path_scores(blocks: list[Block], doubtful: set[int]) -> dict[int, float]:
    """Each path's fused score: text outside links a node, and punctuation a node, both smoothed over neighbouring paths."""
    sums: dict[int, list[int]] = {}
    for b in blocks:
        own = sums.setdefault(b.path, [0, 0, 0])
        own[0] += 1
        own[1] += max(0, len(b.text) - b.linked)
        own[2] += len(PUNCTUATION.findall(b.text)) if len(b.text) > b.linked else 0
    order = list(sums)
    texts = [sums[p][1] / sums[p][0] for p in order]
    marks = [sums[p][2] / sums[p][0] for p in order]

    def smooth(x: list[float], i: int) -> float:
        """A path weighs as much as both its neighbours together; one of links alone stays at nothing."""
        near = x[max(0, i - 1) : i] + x[i + 1 : i + 2]
        return (x[i] + sum(near) / len(near)) / 2 if near and sums[order[i]][1] else x[i]

    fused = {p: math.sqrt(smooth(texts, i) * (1 + smooth(marks, i))) for i, p in enumerate(order)}
    return {p: s * DOUBT if p in doubtful else s for p, s in fused.items()}


def summed(containers: list[Container], own: list[float]) -> list[float]:
    """Each container's value with those of all containers in it; parents come before their children."""
    total = list(own)
    for i in range(len(total) - 1, 0, -1):
        total[containers[i].parent] += total[i]
    return total


def inherited(containers: list[Container], own: list[bool]) -> list[bool]:
    found = list(own)
    for i in range(1, len(found)):
        found[i] = found[i] or found[containers[i].parent]
    return found


def heading_before(blocks: list[Block], chosen: list[bool]) -> set[int]:
    """Where the part that is read has no h1, the last one before it, with what follows it in its own container and isn't links: a headline and its introduction."""
    inside = [i for i, b in enumerate(blocks) if chosen[b.container]]
    if not inside or any(blocks[i].name == "h1" for i in inside):
        return set()
    at = next((i for i in range(inside[0] - 1, -1, -1) if blocks[i].name == "h1"), None)
    if at is None:
        return set()
    return {i for i in range(at, inside[0]) if blocks[i].container == blocks[at].container and 2 * blocks[i].linked <= len(blocks[i].text)}


def main_text(page: str, threshold: float = 0.2) -> str:
    """The page's article: blocks in page order joined by two line ends, each with references decoded and white space made one space."""
    read = Page(page)
    blocks, boxes = read.blocks, read.containers
    spoken = [0.0] * len(boxes)
    for b in blocks:
        spoken[b.container] += max(0, len(b.text) - b.linked)
    within = summed(boxes, spoken)
    forms = inherited(boxes, [box.form and 2 * within[i] < within[0] for i, box in enumerate(boxes)])
    blocks = [b for b in blocks if not forms[b.container]]
    if not blocks:
        return ""
    scores = path_scores(blocks, read.doubtful)
    level = threshold * max(scores.values())
    content = [scores[b.path] >= level and scores[b.path] > 0 for b in blocks]
    own = [0.0] * len(boxes)
    for b, good in zip(blocks, content, strict=True):
        if good:
            own[b.container] += max(0, len(b.text) - b.linked) * scores[b.path]
    weight = summed(boxes, own)
    marked = inherited(boxes, [box.marked for box in boxes])
    inside = [sum(w for w, m in zip(own, marked, strict=True) if m), 0.0]
    trusted = weight[0] > 0 and inside[0] >= 0.3 * weight[0]
    if trusted:
        # of nested marks, such as articles in a main, the innermost that hold most of the weight count
        nested = inherited(boxes, [box.marked and marked[box.parent] and i > 0 for i, box in enumerate(boxes)])
        if 2 * sum(w for w, m in zip(own, nested, strict=True) if m) >= inside[0]:
            marked = nested
        chosen = marked
    else:
        root, kids = 0, [0] * len(boxes)
        for i in range(len(boxes) - 1, 0, -1):  # each container's heaviest child
            p = boxes[i].parent
            if not kids[p] or weight[i] >= weight[kids[p]]:
                kids[p] = i
        while kids[root] and weight[kids[root]] >= 0.9 * weight[root] > 0:
            root = kids[root]
        chosen = inherited(boxes, [i == root for i in range(len(boxes))])
    lead = set() if trusted else heading_before(blocks, chosen)
    kept = [(b, good or i in lead) for i, (b, good) in enumerate(zip(blocks, content, strict=True)) if chosen[b.container] or i in lead]
    speaks, links, holds = ([0.0] * len(boxes) for _ in range(3))
    for b, good in kept:
        speaks[b.container] += max(0, len(b.text) - b.linked)
        links[b.container] += min(b.linked, len(b.text))
        holds[b.container] += good
    has = summed(boxes, holds)
    at = [i for i, (_, good) in enumerate(kept) if good]
    first, last = (at[0], at[-1]) if at else (0, len(kept))

    def stays(i: int, b: Block, good: bool) -> bool:
        if good or (b.name in HEADINGS and (trusted or has[b.container])):
            return True
        c = b.container
        if boxes[c].doubtful or (links[c] > speaks[c] and not holds[c]):
            return False
        return trusted or not at or first < i < last or bool(holds[c])

    return "\n\n".join(b.text for i, (b, good) in enumerate(kept) if stays(i, b, good))


def article_text(page: Column) -> Column:
    """A column of pages' main text; null counts as the empty page."""

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text)

    return extracted(F.coalesce(F.make_valid_utf8(page), F.lit("")))


def extracted(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars, a row for each row.

    Pages that are null, empty or without an article have the empty text. A page without markup is a block of its own. A tag cut
    off by the page's end is dropped. Repeated rows and null ids are extracted each. Other columns are not looked at."""
    return pages.select("page_id", "url", article_text(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
