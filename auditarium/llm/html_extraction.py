"""Main text of web pages by tag-path ratios.

A page is cut into text blocks; a block's path is the chain of block-level tags from the root to it (inline tags don't count). For each
path the lengths and punctuation marks of its blocks are aggregated to a text ratio (characters a block) and a punctuation ratio (marks a
block). Both are given to the blocks in page order and smoothed by a Gaussian, in which neighbours in another
element count less (NEAR where one's element is around the other's, else FAR), so a heading is judged with the text it stands by and a teaser isn't. They are fused to one product with the share of text outside
links and the weight of the elements around; paths whose best block reaches THRESHOLD of the page's mean or deviation are content paths.
The smallest element that holds all blocks of content paths is the article; its blocks are the result, short ones too.

Elements that are forms, menus, footers and the like by their tag don't count, unless they hold the main element, or the h1 and most of the text outside links, or
most of that on a page without h1, article and main (a page in a form, a menu that nobody closed). Hidden elements, scripts and styles never count. Names in role, class and id only lower weights: WHOLE for a
name that is such a word or is made with one (cookie-banner), NAMED for one that also speaks of content or layout (entry-header, has-sidebar), none at all for a name whose
elements hold most of the page's text, and one of the first kind outside the article or main element of a page that has one weighs nothing. Elements with a name have paths of their
own, and their short blocks only stay if one of their paths is content. Ids made from headings name a topic and say nothing. Inside running text only adverts
and hidden elements are left out.

Rows are independent: there is no shuffle. Time and memory are linear in the page, whatever its nesting: a block holds its element's number,
elements hold their parent's. A null html and a page without content give an empty text; a null page_id or url stays null; repeated rows are
each returned, ties (blocks of equal ratios) share their fate; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

SMOOTHING, THRESHOLD = 1.0, 0.1
#: What neighbours count whose parent elements differ by one level, and by more.
NEAR, FAR = 0.5, 0.1
#: Weights of elements with a furniture word in a name that also speaks of content, and in others; shares of the page's text that no furniture holds, by name and by tag.
NAMED, WHOLE, MOST, MOST_TAG = 0.25, 0.002, 0.85, 0.5

#: Fixed values of HTML: elements without content, of raw text, of running text, and those that end an open p.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object noframes title select xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start tag ends open elements of these, up to the given border.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = frozenset("html body article section div table td th main aside nav header footer form ul ol".split())
#: Furniture that a page may stand in.
KEPT = frozenset("nav form footer aside menu dialog fieldset".split())
#: Furniture by tag, and by the words of role, class and id.
FURNITURE_TAGS = frozenset("nav aside footer form button menu dialog select input label fieldset legend head".split())
FURNITURE = re.compile(r"(?:^|[_-])(?:ads?|adverts?|advertisements?|adbox|sponsor(?:ed)?|promos?|promotion|banner|nav|navbar|navigation|menus?|breadcrumbs?|sidebar|side|rail|footer|foot|masthead|topbar|toolbar|header|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommend(?:ed|ations)?|widgets?|tags?|pagination|pager|comments?|respond|replies|reply|disqus|discussion|complementary|contentinfo|dialog|hidden|skip)(?:$|[_-])", re.I)
#: Words that make a name with a furniture word one of content or layout.
LAYOUT = re.compile(r"(?:^|[_-])(?:has|no|not|with|without|layout|enabled|disabled|content|article|entry|post|story|page|title|xs|sm|md|lg|xl|above|below|to|wrap|wrapper|container|inner|grid|row|col|columns?|my|works?)(?:$|[_-])", re.I)
ADVERT = re.compile(r"(?:^|[_-])(?:ads?|adverts?|advertisements?|adbox|sponsor(?:ed)?)(?:$|[_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]++|<", re.S)
_NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_MARK = re.compile(r"[.,;:!?、。，！？]")


class Page:
    """The block-level elements of a page, numbered as they begin (0: the page itself), and its text blocks."""

    def __init__(self, page: str):
        self.parent, self.depth, self.tag, self.end = [0], [0], [""], [0]
        self.hidden, self.furniture, self.article = [False], [False], [False]  # inside a hidden element; furniture by its own tag; inside an article or main element
        self.names: list[list[tuple[str, str, str, bool]]] = [[]]
        #: Element, text, text without adverts inside it, characters in links.
        self.blocks: list[tuple[int, str, str, int]] = []
        self._parse(page)
        self._leave_out()

    def _leave_out(self) -> None:
        """Drops the blocks of furniture by tag, but for furniture that the page itself stands in."""
        n = len(self.parent)
        chars, heads, mains = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for e, text, _, linked in self.blocks:
            chars[e + 1] += max(0, len(text) - linked)
        for e in range(n):
            chars[e + 1] += chars[e]
            heads[e + 1] = heads[e] + (self.tag[e] == "h1")
            mains[e + 1] = mains[e] + (self.tag[e] == "main")
        told = heads[n] or any(self.article)
        out = [False] * n
        for e in range(1, n):
            end = self.end[e] + 1
            kept = self.tag[e] in KEPT and (mains[end] > mains[e] or chars[end] - chars[e] > MOST_TAG * chars[n] and (heads[end] > heads[e] if told else self.tag[e] != "footer"))
            out[e] = out[self.parent[e]] or self.furniture[e] and not kept
        self.blocks = [b for b in self.blocks if not out[b[0]]]

    def _parse(self, page: str) -> None:
        stack = [0]
        opened: dict[str, int] = defaultdict(int)  # open elements by tag
        inline: list[tuple[str, int, bool]] = []  # open inline elements left out: tag, block-level element around, hidden
        last_end: dict[str, int] = {}  # where the next end of a raw element is (the page's size: there is none)
        parts: list[tuple[str, bool, int]] = []
        links, nested, at, size = False, defaultdict(int), 0, len(page)

        def end_block() -> None:
            if parts:
                if not self.hidden[stack[-1]]:
                    text = _plain(p for p, _, kind in parts if kind < 2)
                    if text:
                        clean = text if all(kind == 0 for *_, kind in parts) else _plain(p for p, _, kind in parts if not kind)
                        self.blocks.append((stack[-1], text, clean, len(_plain(p for p, link, kind in parts if link and not kind))))
                parts.clear()

        def close(depth: int) -> None:
            for e in stack[depth:]:
                self.end[e] = len(self.parent) - 1
                opened[self.tag[e]] -= 1
            del stack[depth:]
            while inline and inline[-1][1] > stack[-1]:
                inline.pop()
                nested.clear()

        while at < size:
            m = _TOKEN.match(page, at)
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                if page[m.start()] != "<" or m.end() == m.start() + 1:
                    parts.append((m[0], links, 0 if not inline else 2 if any(hidden for *_, hidden in inline[-1:]) else 1))
                continue
            closing, attributes = m[1] or m[4], m[3] or m[6] or ""
            if tag in RAW and not closing:
                if not attributes.endswith("/"):
                    if last_end.get(tag, 0) <= at:
                        found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
                        last_end[tag] = found.end() if found else size + 1
                    at = last_end[tag] if last_end[tag] <= size else size if tag in ("script", "style") else at
                continue
            if tag in INLINE:
                if tag == "a":
                    links = not closing
                if inline and tag == inline[-1][0] and not attributes.endswith("/"):  # its own end, not that of one inside it
                    nested[tag] += -1 if closing else 1
                    if nested[tag] < 0:
                        inline.pop()
                        nested.clear()
                elif not closing and attributes and not attributes.endswith("/") and not inline:
                    hidden = bool(_HIDDEN.search(attributes))
                    if hidden or any(ADVERT.search(name) for kind, *values in _NAMES.findall(attributes) if kind.lower() != "id" for name in "".join(values).split()):
                        inline.append((tag, stack[-1], hidden))
                        nested.clear()
                continue
            if tag in VOID:
                parts.append((" ", False, 0))
                if tag == "hr":
                    end_block()
                continue
            end_block()
            if closing:
                if opened[tag]:
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] == tag:
                            close(k)
                            break
                        if tag == "p" and self.tag[stack[k]] in SCOPE:
                            break
                continue
            if tag in CLOSES_P and opened["p"]:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == "p":
                        close(k)
                        break
                    if self.tag[stack[k]] in SCOPE:
                        break
            if tag in SIBLINGS:
                ends, border = SIBLINGS[tag]
                if any(opened[t] for t in ends):
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] in border:
                            break
                        if self.tag[stack[k]] in ends:
                            close(k)
                            break
            if tag == "body" and self.tag[stack[-1]] == "head":
                close(len(stack) - 1)
            if not attributes.endswith("/"):
                up = stack[-1]
                e = len(self.parent)
                inside = self.article[up] or tag in ("article", "main")
                hidden = bool(attributes and _HIDDEN.search(attributes)) and tag not in ("html", "body")
                self.parent.append(up)
                self.depth.append(self.depth[up] + 1)
                self.tag.append(tag)
                self.end.append(e)
                self.hidden.append(self.hidden[up] or hidden)
                self.furniture.append(tag in FURNITURE_TAGS or tag == "header" and not inside)
                self.article.append(inside)
                self.names.append(_named(tag, attributes))
                stack.append(e)
                opened[tag] += 1
        end_block()
        close(1)
        self.end[0] = len(self.parent) - 1


def _plain(parts) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def _named(tag: str, attributes: str) -> list[tuple[str, str, str, bool]]:
    """The furniture names of an element: its tag, attribute, name, and whether the name speaks of nothing else."""
    if not attributes or tag in ("html", "body", "article", "main", "header"):
        return []
    out = []
    for kind, a, b, c in _NAMES.findall(attributes):
        kind = kind.lower()
        if kind != "id" or tag not in _HEADING:
            for name in _HUMP.sub("-", a or b or c).lower().split():
                if FURNITURE.search(name):
                    out.append((tag, kind, name, not LAYOUT.search(name)))
    return out


def _slug(text: str) -> str:
    return "-".join(re.findall(r"\w+", text.lower()))


def weighed(page: Page) -> tuple[list[tuple[int, str, int]], list[float], list[int], list[int]]:
    """The blocks (element, text, characters in links), and of each element its weight, the number of its path, and the outermost element around it
    that has a furniture name (0: none)."""
    use = 2 if any(clean for *_, clean, _ in page.blocks) else 1  # a page that is an advert as a whole keeps its text
    blocks = [(e, block[use], linked) for block in page.blocks for e, linked in [(block[0], block[3])] if block[use]]
    before = 0
    for e, text, _ in blocks:  # ids that are made from the heading an element begins with
        heading, up = e, e
        while page.tag[heading] not in _HEADING and heading > before:
            heading = page.parent[heading]
        if page.tag[heading] in _HEADING and heading > before:
            slug = _slug(text)
            while up > before:
                page.names[up] = [x for x in page.names[up] if x[1] != "id" or page.tag[up] != "section" and x[2] != slug]
                up = page.parent[up]
        before = max(before, e)
    n = len(page.parent)
    chars = [0] * (n + 1)
    for e, text, _ in blocks:
        chars[e + 1] += len(text)
    for e in range(n):
        chars[e + 1] += chars[e]
    total, held, until = chars[n], defaultdict(int), {}
    for e in range(n):
        for name in set(page.names[e]):
            if until.get(name, -1) < e:  # not inside another of this name
                held[name] += chars[page.end[e] + 1] - chars[e]
                until[name] = page.end[e]
    told = any(page.article[e] for e, *_ in blocks)  # the page itself tells where its article is
    weight, path, around = [1.0] * n, [0] * n, [0] * n
    number: dict[tuple[int, str], int] = {}
    for e in range(1, n):
        up = page.parent[e]
        outside = told and not page.article[e]
        own = [0.0 if clear and outside else WHOLE if clear else NAMED for *_, clear in (x for x in page.names[e] if held[x] <= MOST * total or x[3] and outside)]
        weight[e] = min([weight[up], *own])
        around[e] = around[up] or (e if own else 0)
        path[e] = number.setdefault((path[up], page.tag[e] + "~" * bool(own)), len(number) + 1)
    return blocks, weight, path, around


def _smoothed(values: list[float], parents: list[int], above: list[int]) -> list[float]:
    """above: parents of the parents."""
    reach = max(1, round(2 * SMOOTHING))
    kernel = [math.exp(-k * k / (2 * SMOOTHING**2)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        p, up = parents[i], above[i]
        near = [(kernel[j - i + reach] * (1 if parents[j] == p else NEAR if up == parents[j] or p == above[j] else FAR), values[j]) for j in range(max(0, i - reach), min(len(values), i + reach + 1))]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def main_text(html_text: str | None, threshold: float = THRESHOLD) -> str:
    """The page's main text; blocks in page order, joined by one space."""
    page = Page(html_text or "")
    blocks, weight, path, around = weighed(page)
    if not blocks:
        return ""
    total: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for e, text, _ in blocks:
        t = total[path[e]]
        t[0] += 1
        t[1] += len(text)
        t[2] += len(_MARK.findall(text))
    ratios = [[total[path[e]][k] / total[path[e]][0] for e, *_ in blocks] for k in (1, 2)]
    parents = [page.parent[e] for e, *_ in blocks]
    above = [page.parent[p] for p in parents]
    fused = []
    for near, own, (e, text, linked) in zip(zip(*(_smoothed(r, parents, above) for r in ratios), strict=True), zip(*ratios, strict=True), blocks, strict=True):
        length, marks = own if around[e] else near  # no neighbour speaks for a named element
        fused.append(length * (1 + marks) * (1 - min(1.0, linked / len(text))) * weight[e])
    mean = sum(fused) / len(fused)
    border = threshold * max(mean, math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused)))
    best: dict[int, float] = defaultdict(float)
    for x, (e, *_) in zip(fused, blocks, strict=True):
        best[path[e]] = max(best[path[e]], x)
    content = [best[path[e]] >= border for e, *_ in blocks]
    # the article: the smallest element around every block of a content path; for a single block the one around its own element
    found = [e for keep, (e, *_) in zip(content, blocks, strict=True) if keep]
    low, high = found[0] if len(found) > 1 else page.parent[found[0]], found[-1]
    while not low <= high <= page.end[low]:
        low = page.parent[low]
    judged = {0, *(around[e] for e in found)}
    return " ".join(text for keep, (e, text, linked) in zip(content, blocks, strict=True) if low <= e <= page.end[low] and (keep or around[e] in judged and linked < 0.5 * len(text)))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of pages with page_id, url, html."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
