"""HTML extraction: paragraphs give points to their ancestors, the best container and its siblings are kept.

Each page is parsed by a small tolerant tree builder. Every text block passes points for its length and
its commas to its parent and, less, to the ancestors above; a container's points are discounted by the share
of its text that stands in links. A main or sole article element is the container that the page itself names,
and is taken before any points are judged. Else blocks of the best container, of siblings with enough points or of
its own tag and class, and all between these are kept, in page order. Sums go from each element to its parent once, from the
last element to the first, and what an element inherits is set when it opens, so the time of a page grows with its
length, however deep or broken it is. Pages are judged one by one inside Arrow batches, so nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never text of the page, elements without content, and blocks.
RAW = frozenset("script style textarea title noscript iframe svg annotation annotation-xml template object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements and roles that hold no article text, and words of class or id that say the same.
OFF_TAGS = frozenset("nav footer aside form menu button select input label dialog head script style noscript".split())
OFF_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
OFF_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar side rail widget "
    "footer header masthead comment comments disqus respond reply replies cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup share sharing social "
    "related recommended recommendations toolbar pagination pager login search tags skip".split()
)
#: Of these words, those that also name parts of an article: inside one they count only where links make up half of the text.
DOUBTFUL_WORDS = frozenset("header masthead banner side rail tags related recommended notice widget social search skip".split())
ARTICLES, HEADINGS = ("article", "main"), ("h1", "h2", "h3", "h4", "h5", "h6")
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?", re.S)
NAME = re.compile(r"</?[a-zA-Z][^\s/><]*+")
QUOTE = re.compile("[\"']")
SPACE = re.compile(r"\s+")
#: A start of these ends an open p; a start of li, dd, ... ends an open one of its kind.
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MIN_CHARS, SIBLING_SHARE, DECAY = 25, 0.2, 0.5
#: Points of a block of MIN_CHARS outside a p, shorter ones in proportion; and the share of links that settles a doubtful word.
SHORT_POINTS, DOUBT = 0.25, 0.5


#: Elements that an end of one of the kinds before them does not pass.
P_STOPS, LIST_STOPS = (BLOCK - {"p"}) | {"button"}, frozenset("ul ol dl table select menu".split())


class Node:
    __slots__ = ("tag", "parent", "off", "attributes", "doubtful", "points", "chars", "links", "depth", "block", "p_stop", "list_stop", "outer", "number", "last", "state")

    def __init__(self, tag: str, parent: "Node | None", number: int, off: bool, attributes: str = "", doubtful: bool = False):
        self.tag, self.parent, self.off, self.attributes, self.doubtful = tag, parent, off, attributes, doubtful
        self.points, self.chars, self.links = 0.0, 0, 0
        self.number = self.last = number
        self.state = None
        above = parent or self
        self.depth = parent.depth + 1 if parent else 0
        # the nearest elements of each kind, this one included, and the outermost article
        self.block = self if tag in BLOCK or parent is None else above.block
        self.p_stop = self if tag in P_STOPS or parent is None else above.p_stop
        self.list_stop = self if tag in LIST_STOPS or parent is None else above.list_stop
        self.outer = parent.outer if parent and parent.outer else self if tag in ARTICLES else None

    def holds(self, x: "Node") -> bool:
        """Whether x is this element or inside it."""
        return self.number <= x.number <= self.last


class Unended:
    """Starts of tags without an end: whether one at a place must fail as an earlier one did.

    After its name a start reads on outside or inside quotes; two that are in one state at one place end alike. So at most
    three kinds of failed starts are followed, each over the page once.
    """

    def __init__(self, page: str):
        self.page, self.failed = page, {}

    def fails(self, at: int) -> bool:
        """Whether a failed start is outside quotes at this place, so that a tag from here has no end either."""
        moved = {}
        for state, place in self.failed.items():
            while True:
                found = QUOTE.search(self.page, place, at) if not state else None
                end = found.start() if found else self.page.find(state, place, at) if state else -1
                if end < 0:
                    break
                state, place = ("" if state else self.page[end]), end + 1
            moved[state] = at
        self.failed = moved
        return "" in moved

    def add(self, at: int) -> None:
        self.failed[""] = at


def _is_off(tag: str, attributes: str, inside_article: bool) -> bool | None:
    """Whether an element holds no article text; None if links must tell."""
    doubtful = False
    if tag in OFF_TAGS or tag == "header" and not inside_article:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value in OFF_ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", *ARTICLES):
            words = OFF_WORDS & set(re.split(r"[^a-z0-9]+", value))
            if tag in HEADINGS:
                words -= DOUBTFUL_WORDS
            if words and not (inside_article and words <= DOUBTFUL_WORDS):
                return True
            doubtful = doubtful or bool(words)
    return None if doubtful else False


def _kind(x: Node) -> tuple[str, str]:
    """Tag and class of an element."""
    found = (a or b or c for name, a, b, c in ATTRIBUTE.findall(x.attributes) if name.lower() == "class")
    return x.tag, " ".join(sorted(next(found, "").lower().split()))


def blocks_of(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """All elements in page order, and (container, text, characters in links) of every block of text that is not switched off."""
    at = Node("#root", None, 0, False)
    nodes, found, buffer = [at], [], []
    opened: dict[str, list[Node]] = {}
    linked = in_link = articles = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            if text and not at.off:
                found.append((at.block, text, min(linked, len(text))))
            buffer.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not at.off:
            buffer.append(text)
            if in_link:
                linked += len(text.strip())

    def close(tags: set[str], stop: Node) -> None:
        """Close up to the nearest open element of tags, unless stop is inside it."""
        nonlocal at, in_link, articles
        x = max((opened[t][-1] for t in tags if opened.get(t)), key=lambda y: y.depth, default=None)
        if x is None or stop.depth > x.depth:
            return
        if any(y in BLOCK for y in tags):
            flush()
        while at is not x.parent:
            opened[at.tag].pop()
            in_link -= at.tag == "a"
            articles -= at.tag in ARTICLES
            at = at.parent

    end = place = 0
    length = len(page)
    unended = Unended(page)
    while end < length:
        place = page.find("<", place)
        if place < 0:
            add(re.sub(r"<[a-zA-Z/!][^<]*\Z", "", page[end:]))
            break
        name = NAME.match(page, place)
        m = None if name and unended.failed and unended.fails(name.end()) else TAG.match(page, place)
        if m is None:
            if name:
                unended.add(name.end())
            place += 1
            continue
        add(page[end:place])
        end = place = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                flush()
            else:
                close({tag}, nodes[0] if tag in BLOCK else at.block)
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, end)
            end = place = stop.end() if stop else length
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                buffer.append(" ") if tag == "br" and not at.off else flush()
            continue
        if tag in BLOCK:
            flush()
            if tag not in ("html", "body"):
                close({"p"}, at.p_stop)
        if tag in SELF_CLOSING:
            close(SELF_CLOSING[tag], at.list_stop)
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        off = _is_off(tag, m[3], articles > 0)
        at = Node(tag, at, len(nodes), at.off or bool(off), m[3], off is None)
        nodes.append(at)
        opened.setdefault(tag, []).append(at)
        in_link += tag == "a"
        articles += tag in ARTICLES
    flush()
    return nodes, found


def _summed(nodes: list[Node]) -> None:
    """Pass every element's sums on to its parent, points by half."""
    for x in reversed(nodes[1:]):
        x.parent.chars += x.chars
        x.parent.links += x.links
        x.parent.points += DECAY * x.points
        x.parent.last = max(x.parent.last, x.last)


def _settled(nodes: list[Node], found: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """found without the blocks of doubtful elements that are mostly links."""
    if not any(x.doubtful for x in nodes):
        return found
    for owner, text, linked in found:
        owner.chars += len(text)
        owner.links += linked
    _summed(nodes)
    for x in nodes:
        x.state = bool(x.parent and x.parent.state) or x.doubtful and x.links >= DOUBT * x.chars
    kept = [f for f in found if not f[0].state]
    for x in nodes:
        x.chars, x.links, x.state = 0, 0, None
    return kept


def main_text(page: str | None) -> str:
    """The article of a page, one line a block; empty if there is none."""
    if not page:
        return ""
    nodes, found = blocks_of(page)
    found = _settled(nodes, found)
    if not found:
        return ""
    named: dict[int, Node] = {}
    for owner, text, linked in found:
        whole = 1 + text.count(",") + text.count("、") + min(len(text) / 100, 3) if len(text) >= MIN_CHARS or owner.tag == "p" else SHORT_POINTS * len(text) / MIN_CHARS
        up = owner if owner.tag not in ("p", "pre", "blockquote", *HEADINGS, "li", "td") else owner.parent or owner
        up.points += whole * (1 - linked / len(text))
        up.state = True
        owner.chars += len(text)
        owner.links += linked
        if owner.outer is not None:
            named[owner.outer.number] = owner.outer
    _summed(nodes)
    for x in reversed(nodes[1:]):
        x.parent.state = x.parent.state or x.state
    touched = [x for x in nodes if x.state]
    density = lambda x: x.links / x.chars if x.chars else 0.0
    score = lambda x: x.points * (1 - density(x))
    best = max(touched, key=lambda x: (score(x), x.depth))
    # an enclosing article or main is the container that its parts belong to
    best = best.outer or best
    mains = [x for x in named.values() if x.tag == "main"]
    sole = max(mains, key=score) if mains else next(iter(named.values())) if len(named) == 1 else None
    # a single article beside a container with more text may be a teaser; a main never is
    if sole is not None and (mains or best.holds(sole) or sole.chars - sole.links >= best.chars - best.links):
        best = sole
    if score(best) <= 0 and best.tag not in ARTICLES:
        return ""
    keep = {best.number}
    around = best.parent
    if around is not None:
        like = _kind(best)
        for x in touched:
            if x.parent is around and density(x) < 0.3:
                much, same = score(x) >= max(2.0, SIBLING_SHARE * score(best)), _kind(x) == like
                # beside an article only others of its kind and weight belong to the text
                if much and same if best.tag in ARTICLES else much or score(x) > 0 and same:
                    keep.add(x.number)
    beside = best.tag not in (*ARTICLES, "body")
    for x in nodes:
        if x.number in keep:
            x.state = "chosen"
        elif beside and around is not None and x.parent is around and x.tag in ("p", "h1", "h2", "h3", "blockquote", "pre"):
            x.state = "loose"
        else:
            x.state = x.parent.state if x.parent else None
    chosen = [i for i, f in enumerate(found) if f[0].state == "chosen"]
    # what stands between kept containers belongs to the article, whatever its points
    between = {i for i in range(chosen[0], chosen[-1]) if around is not None and best.tag not in ARTICLES and around.holds(found[i][0])} if chosen else set()
    return "\n".join(f[1] for i, f in enumerate(found) if f[0].state or i in between)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("html")
        texts = pa.array([main_text(x.as_py()) for x in batch.column(at)], pa.string())
        rest = [i for i in range(batch.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), texts], [*(batch.schema.names[i] for i in rest), "text"])


def html_extract(pages: DataFrame) -> DataFrame:
    """Every row of pages with text, the main text of the whole html, in place of html; a column text is replaced.

    Null and empty pages, and pages without an article, give the empty text. Broken markup is read as far as
    it goes: an unclosed element ends with its parent. Character references are decoded, white space inside
    a block is one space, and blocks are joined by a line feed. Repeated rows give equal texts.
    """
    kept = [c for c in pages.columns if c not in ("text", "html")]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)
    return pages.select(*(F.col(f"`{c}`") for c in kept), F.col("html").cast("string").alias("html")).mapInArrow(_extracted, f"{schema}, text string")
