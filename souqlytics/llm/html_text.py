"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that start and end a block of text; all others are part of the text around them.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody "
    "td tfoot th thead tr ul".split())
# Elements whose content is never text of the page.
SKIPPED = "script|style|head|noscript|template|textarea|select|button|svg|math|iframe|object|canvas|audio|video|title"
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
# What the names of elements, classes, ids and roles say about the text inside.
ELEMENT = {"nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "menu": -9.0, "search": -9.0, "dialog": -9.0, "header": -7.0, "article": 3.0, "main": 3.0}
AGAINST = frozenset(
    "ad ads advert adverts advertisement advertisements adv banner banners breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices pager "
    "pagination popup promo promoted promotion recommended related reply replies respond search share sharing sidebar signup "
    "social sponsor sponsored subscribe subscription tags teaser toolbar widget widgets complementary contentinfo".split())
IN_FAVOUR = frozenset("article body content entry main post story text".split())

# A quote delimits a value only behind an equals sign; elsewhere it is a character like others.
_ATTRIBUTES = r"((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)>"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:" + SKIPPED + r")\b" + _ATTRIBUTES.replace("((", "(?:(", 1) + r".*?(?:</(?:" + SKIPPED + r")\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)" + _ATTRIBUTES + r"|<[!?][^>]*>", re.S | re.I)
# What may stand behind the last ``>`` of a page and is not text.
_TAIL = re.compile(r"<!--.*\Z|<(?=/?[a-zA-Z])[^<]*\Z", re.S)
_SKIP = re.compile(r"<(" + SKIPPED + r")\b", re.I)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_BLANK = re.compile(r"\s+")
_LEGAL = re.compile(r"©|\bcopyright\b|\ball rights reserved\b", re.I)


@dataclass
class Block:
    text: str
    node: int  # number of the block element around it, 0 for none
    hint: float
    linked: int
    heading: bool


HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# Their names speak of the whole page, not of what the element is.
ROOTS = frozenset(("html", "body", "main"))


@dataclass
class Element:
    tag: str
    parent: int  # number of the block element around it, 0 for none
    names: frozenset[str]  # parts of its class, id and role
    inside: bool  # an article or main is around it
    depth: int = 1
    mark: int = 0  # the nearest article or element that speaks against the text, from itself on
    by_tag: bool = False  # the tag speaks against the text inside
    by_name: bool = False  # a name does
    under: bool = False  # it or an element around it speaks against the text


def _element(tag: str, attributes: str, parent: int, elements: list[Element]) -> Element:
    around = elements[parent - 1] if parent else None
    inside = around is not None and (around.inside or around.tag in ("article", "main"))
    names = frozenset(p.lower() for m in _NAMES.finditer(attributes) for p in _PART.findall(m[2] or m[3] or m[4] or ""))
    under = around is not None and around.under and tag != "main"
    e = Element(tag, parent, names, inside, around.depth + 1 if around else 1)
    e.by_tag = ELEMENT.get(tag, 0.0) < 0 and not (tag == "header" and inside)
    against = names & AGAINST
    if inside or names & IN_FAVOUR:
        against -= {"header"}  # the head of an article, not of the site
    # an article's names tell of its layout, unless it stands among boilerplate
    e.by_name = bool(against) and tag not in ROOTS and tag != "blockquote" and (tag != "article" or under)
    e.under = under or e.by_tag or e.by_name
    e.mark = len(elements) + 1 if e.by_name or e.by_tag or tag == "article" else around.mark if around else 0
    return e


def _leader(blocks: list[Block], elements: list[Element]) -> int:
    """Number of the element that would be lost with more text than the page has left, or 0.

    Unlinked text counts for the nearest article or element that speaks against it. What holds
    more than all text that nothing speaks against is the page's content, whatever it is named.
    """
    free, held = 0, {}
    for b in blocks:
        size = len(b.text) - b.linked
        n = b.node
        if not n or not elements[n - 1].under:
            free += size
            continue
        while n := elements[n - 1].mark:
            e = elements[n - 1]
            if e.by_name or e.tag == "article":
                held[n] = held.get(n, 0) + size
            if e.by_name or e.by_tag or not (n := e.parent):
                break
    # of equals the outermost
    n = max(held, key=lambda n: (held[n], -n), default=0)
    return n if n and held[n] > free else 0


def _own_hint(e: Element, heading: bool) -> float:
    value = ELEMENT.get(e.tag, 0.0)
    if e.tag == "header" and e.inside:
        value = 0.0 if heading else -1.0
    if e.by_name:
        return min(value, -9.0)
    return max(value, 2.0) if e.names & IN_FAVOUR and not e.names & AGAINST and value >= 0 else value


def _give_hints(blocks: list[Block], elements: list[Element]) -> None:
    """The hint of every block from the elements around it."""
    leader = n = _leader(blocks, elements)
    while n:  # wrappers of most of the text
        elements[n - 1].by_name = False
        n = elements[n - 1].parent
    # by element: the hint for plain text and for headings, and whether a tag speaks against them
    hints: list[tuple[float, float, bool]] = []
    for number, e in enumerate(elements, 1):
        # the leader or a main lifts what is said around it
        fresh = not e.parent or number == leader or e.tag == "main"
        plain, heading, tagged = (0.0, 0.0, False) if fresh else hints[e.parent - 1]
        hints.append((_joined(plain, _own_hint(e, False)), _joined(heading, _own_hint(e, True)), tagged or e.by_tag))
    for b in blocks:
        plain, heading, tagged = hints[b.node - 1] if b.node else (0.0, 0.0, False)
        hint = heading if b.heading else plain
        if hint <= -9.0 and not tagged:
            # a name alone is outweighed by long text without links
            words = (b.text.count(" ") + 1) * (1 - b.linked / len(b.text))
            hint += min(max(words - 40, 0) / 20, 9.0)
        b.hint = hint


def _joined(hint: float, own: float) -> float:
    if own < 0 or hint <= -9.0:
        return min(hint, own)
    return max(hint, own) if hint >= 0 else hint + own


def blocks_of(page: str) -> tuple[list[Block], list[Element]]:
    """The blocks of a page in order, white space folded and character references decoded, and its elements."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # tag, number
    elements: list[Element] = []
    parts: list[tuple[str, bool]] = []
    link, at, headings = False, 0, 0
    opened: Counter[str] = Counter()  # open elements by tag

    def flush() -> None:
        nonlocal link
        text = _BLANK.sub(" ", entities.unescape("".join(p for p, _ in parts))).strip()
        if text:
            linked = sum(len(p) for p, of_link in parts if of_link)
            out.append(Block(text, stack[-1][1] if stack else 0, 0.0, min(linked, len(text)), headings > 0))
        parts.clear()
        link = False

    def pop(i: int) -> None:
        nonlocal headings
        flush()
        for tag, _ in stack[i:]:
            headings -= tag in HEADINGS
            opened[tag] -= 1
        del stack[i:]

    last = page.rfind(">")
    while at < len(page):
        m = (_TOKEN if at <= last else _TAIL).search(page, at)
        if m is None:
            parts.append((page[at:], link))
            break
        if m.start() > at:
            parts.append((page[at : m.start()], link))
        at = m.end()
        if m.re is _TAIL:
            break
        if m[2] is None:
            if (skip := _SKIP.match(m[0])) is not None:
                # the element ends at its own end tag, not at one of another kind inside it
                end = re.compile(r"</" + skip[1] + r"\s*>", re.I).search(page, page.index(">", m.start()) + 1)
                at = end.end() if end else len(page)
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag == "a":
            link = not closing
        elif tag == "br":
            parts.append((" ", link))
        elif tag in BLOCKS:
            if closing and not opened[tag]:
                flush()
                continue
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        pop(i)
                        break
                continue
            flush()
            if stack and stack[-1][0] == "p":
                pop(len(stack) - 1)
            if stack and stack[-1][0] in CLOSES.get(tag, ()):
                pop(len(stack) - 1)
            if tag in VOID:
                continue
            elements.append(_element(tag, m[3] or "", stack[-1][1] if stack else 0, elements))
            stack.append((tag, len(elements)))
            headings += tag in HEADINGS
            opened[tag] += 1
    flush()
    _give_hints(out, elements)
    return out, elements


def score(b: Block) -> float:
    """How much a block looks like content (over 0) or boilerplate (under 0)."""
    words, linked = b.text.count(" ") + 1, b.linked / len(b.text)
    own = min(words, 40) / 10 - 1.5
    if b.hint >= 0 and not b.linked:
        own = max(own, 0.05)  # short text tells little by itself: what is around it decides
    if b.hint < 3.0 and words < 30 and _LEGAL.search(b.text):
        own -= 4.0
    return b.hint + own - (3.0 if b.hint >= 3.0 else 5.0) * linked + (1.0 if b.heading else 0.0)


def smoothness(a: Block, b: Block, elements: list[Element]) -> float:
    """Cost of giving two neighbours different labels: high for near relatives in the tree."""
    x, y, steps = a.node, b.node, 0
    while x != y:
        # up from the deeper one; between blocks that follow each other every element is passed once
        if (elements[x - 1].depth if x else 0) >= (elements[y - 1].depth if y else 0):
            x = elements[x - 1].parent
        else:
            y = elements[y - 1].parent
        steps += 1
    return 2.0 / (1 + steps)


class Network:
    """Maximum flow by shortest augmenting levels."""

    def __init__(self, n: int):
        self.edges: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def join(self, a: int, b: int, forth: float, back: float = 0.0) -> None:
        for x, y, c in ((a, b, forth), (b, a, back)):
            self.edges[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)

    def levels(self, s: int) -> list[int]:
        level = [-1] * len(self.edges)
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for e in self.edges[x]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        """Push all flow from s to t; which nodes are then still reached from s."""
        while (level := self.levels(s))[t] >= 0:
            turn = [0] * len(self.edges)
            path: list[int] = []
            x = s
            while True:
                if x == t:
                    low = min(self.room[e] for e in path)
                    cut = None
                    for i, e in enumerate(path):
                        self.room[e] -= low
                        self.room[e ^ 1] += low
                        if cut is None and self.room[e] <= 1e-9:
                            cut = i
                    x = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                while turn[x] < len(self.edges[x]):
                    e = self.edges[x][turn[x]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[x] + 1:
                        path.append(e)
                        x = self.to[e]
                        break
                    turn[x] += 1
                else:
                    if not path:
                        break
                    x = self.to[path.pop() ^ 1]
                    turn[x] += 1
        return [v >= 0 for v in level]


def content(blocks: list[Block], elements: list[Element]) -> list[bool]:
    """The labelling of least cost: a block's own cost where it goes against its score, and the
    smoothness of every pair of neighbours with different labels. Neighbours are blocks next
    to each other on the page, and consecutive blocks of one parent element."""
    n = len(blocks)
    net = Network(n + 2)
    s, t = n, n + 1
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        v = score(b)
        net.join(s, i, v) if v > 0 else net.join(i, t, -v)
        if i:
            w = smoothness(blocks[i - 1], b, elements)
            net.join(i - 1, i, w, w)
        parent = elements[b.node - 1].parent if b.node else 0
        if (j := last.get(parent, i)) < i - 1:
            w = smoothness(blocks[j], b, elements)
            net.join(j, i, w, w)
        last[parent] = i
    return net.source_side(s, t)[:n]


def main_text(page: str | None) -> str:
    blocks, elements = blocks_of(page or "")
    return "\n".join(b.text for b, keep in zip(blocks, content(blocks, elements)) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    The page is cut into blocks at block elements (``br`` is white space); the minimum cut
    tells content from boilerplate. Null and empty html, and pages without content, give the
    empty text. Broken markup is read as far as it goes: open elements end with the page, end
    tags without a start are skipped. Pages are independent rows, read whole, one at a time:
    repeated rows give equal rows. Other columns are ignored; an empty table gives no rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
