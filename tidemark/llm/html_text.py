"""HTML extraction by tree scoring.

Each page becomes a tree of elements.  Paragraphs pass points for length and commas to their
ancestors, links discount them.  An article or main element with the best container in it is kept
whole; elsewhere the best container is kept together with those of its siblings that read like text.
Pages are independent of each other, so the operator is a map without shuffle.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import text_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg object canvas noframes".split())
BLOCK = frozenset(
    "html body p div section article header footer nav aside main form ul ol li dl dt dd table caption thead tbody "
    "tfoot tr td th h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address hr fieldset details summary dialog "
    "menu center".split()
)
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: A start tag of the key ends an open element of the value, unless a container of the third is in between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements without main text.
DROPPED = RAW | frozenset("head nav aside footer button select input menu dialog annotation annotation-xml".split())
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split()
)
#: Parts of class and id values.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?(?:by\w+|sense|box|slot|unit)?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|popup|modal|"
    r"overlay|newsletter|subscribe|signup|login|comments?|commentlist|disqus|respond|replies|sidebar|side|menu|navbar|"
    r"nav|navigation|breadcrumbs?|pagination|pager|footer|foot|masthead|header|toolbar|share|sharing|social|related|"
    r"recommend\w*|widget|teaser|skip|copyright|legal)(?:$|[\s_-]|\d)",
    re.I,
)
#: Parts of class and id values that a likely name beside them does not outweigh.
NEVER_TEXT = re.compile(
    r"comment|sidebar|footer|cookie|advert|sponsor|newsletter|breadcrumb|pagination"
    r"|(?:^|[\s_-])(?:nav|navbar|navigation|menu|share|sharing|related)(?:$|[\s_-]|\d)",
    re.I,
)
#: Whole names of parts of an article that are not its text; other unlikely names there count only on lists of links.
NEVER_INSIDE = re.compile(
    r"(?:^|\s)(?:(?:article|entry|post|page|site)[-_])?(?:ads?|adsbygoogle|ad[-_](?:banner|box|container|slot|unit|wrapper)|advert\w*|sponsor\w*|"
    r"promo\w*|banner|cookies?(?:[-_](?:banner|bar|consent|notice))?|consent|gdpr|popup|modal|overlay|newsletter(?:[-_]\w+)*|subscribe(?:[-_]\w+)*|"
    r"signup|login|comments?(?:[-_]?(?:area|list|section))?|commentlist|disqus(?:_thread)?|respond|replies|sidebar|menu|navbar|nav|navigation|"
    r"breadcrumbs?|pagination|pager|footer|masthead|toolbar|share(?:[-_](?:bar|buttons?|links|tools))?|sharing|skip(?:[-_]links?)?|copyright|teaser|"
    r"notice|notification)(?:$|\s)",
    re.I,
)
#: What a bar above or below a text says where no element tells.
BAR = re.compile(r"[|»·•›].*[|»·•›]|©|\(c\)\s*(?:19|20)\d\d|\bcopyright\b|all rights reserved", re.I | re.S)
BAR_SIZE = 300
#: Where words of a name in camel case meet.
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|main|content|entry|post|story|body|text|page)(?:$|[\s_-]|\d)", re.I)
#: Words on the layout around a text, such as with-sidebar, and whole words of an area of comments.
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:with|without|has|no)[-_]\S+", re.I)
COMMENTS = re.compile(r"(?:^|\s)(?:comments?|comments?-?(?:list|area|section)|disqus(?:_thread)?|respond|replies)(?:$|\s)", re.I)
#: Parts of class and id values that make a list of links a menu.
MENU = re.compile(
    r"(?:^|[\s_-])(?:menu|navbar|nav|navigation|breadcrumbs?|pagination|pager|toolbar|share|sharing|social|related|skip)"
    r"(?:$|[\s_-]|\d)",
    re.I,
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dl table figure".split())
WHOLE = ("article", "main")
CONTAINERS = frozenset("body main article section div td blockquote li".split())

TAG_POINTS = {"article": 30.0, "main": 20.0, "section": 2.0, "div": 5.0, "blockquote": 3.0, "body": 0.0}
CLASS_POINTS = 25.0
LENGTH_UNIT, LENGTH_MOST = 100, 3
SIBLING_SHARE, SIBLING_LEAST = 0.2, 10.0
LINKY = 0.5
#: A paragraph's points go up to so many elements; each container halves them.
LEVELS = 8


class Node:
    """An element: its children are nodes and strings, in order."""

    __slots__ = ("name", "words", "parent", "children", "dropped", "doubtful", "linky", "form", "banner", "inside", "holds", "above",
                 "points", "size", "linked")

    def __init__(self, name: str, parent: Node | None, words: str = "", dropped: bool = False, doubtful: bool = False) -> None:
        self.name, self.parent, self.words, self.dropped, self.doubtful = name, parent, words, dropped, doubtful
        self.children: list[Node | str] = []
        # Inside of an article or main element; holding one; the nearest element above that takes points.
        self.inside = name in WHOLE or (parent is not None and parent.inside)
        self.form = name == "form" or (parent is not None and parent.form)
        self.banner = self.holds = self.linky = False
        self.above: Node | None = None
        self.points, self.size, self.linked = 0.0, 0, 0


def _element(name: str, raw: str, parent: Node) -> Node:
    words, role, gone = "", "", name in DROPPED or (parent.form and name in ("label", "legend"))
    if raw and not raw.isspace():
        attrs = {}
        for key, a, b, c in ATTRIBUTE.findall(raw):
            attrs.setdefault(key.lower(), a or b or c)
        words = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        if words:
            words = CAMEL.sub("-", LAYOUT.sub("", words).strip())
        role = attrs.get("role", "").lower()
        gone = (
            gone
            or role in DROPPED_ROLES
            or "hidden" in attrs
            or attrs.get("aria-hidden", "").lower() == "true"
            or ("style" in attrs and re.search(r"display\s*:\s*none", attrs["style"], re.I) is not None)
        )
    unlikely = name not in ("html", "body", *WHOLE) and _unlikely(words)
    # In an article, a word of a name may be its subject.
    within = unlikely and parent.inside and not NEVER_INSIDE.search(words)
    node = Node(name, parent, words, gone, name == "form" or role == "form" or (unlikely and not within))
    node.linky = within
    # A header is the page's unless it is part of an article or main element.
    if name == "header" and not node.inside and not gone:
        node.banner = node.dropped = True
    return node


def _unlikely(words: str) -> bool:
    return bool(words and UNLIKELY.search(words)) and (not LIKELY.search(words) or NEVER_TEXT.search(words) is not None)


def parse(page: str) -> Node:
    """The page as a tree; broken markup gives the tree that browsers would roughly make of it.

    The open elements are known by name, so that each tag takes the same time however deep it stands.
    """
    root = Node("#root", None)
    open_ = [root]
    places: dict[str, list[int]] = {}
    blocks: list[int] = []

    def close(depth: int) -> None:
        """Ends the open elements from this depth on."""
        for node in open_[depth:]:
            places[node.name].pop()
            if node.name in BLOCK:
                blocks.pop()
        del open_[depth:]

    def last(names: Iterable[str]) -> int:
        """The depth of the last open element of these names, 0 without one."""
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    at, end = 0, len(page)
    while at < end:
        found = TOKEN.search(page, at)
        if found is None:
            open_[-1].children.append(page[at:])
            break
        if found.start() > at:
            open_[-1].children.append(page[at : found.start()])
        at = found.end()
        name = found["name"] or found["name2"]
        if not name:
            continue
        name = name.lower()
        if found["close"] or found["close2"]:
            own = places.get(name)
            depth = own[-1] if own else 0
            # An inline end tag ends nothing outside of the block that it stands in.
            if depth and (name in BLOCK or not blocks or blocks[-1] < depth):
                close(depth)
            continue
        if name in CLOSES_P and places.get("p"):
            depth = last(("p", "td", "th", "button", "table"))
            if open_[depth].name == "p":
                close(depth)
        if name in ENDS:
            ended, fence = ENDS[name]
            within = last(fence)
            depths = [own[i] for own in (places.get(n, ()) for n in ended) if (i := bisect_right(own, within)) < len(own)]
            if depths:
                close(min(depths))
        child = _element(name, found["attrs"] or found["attrs2"] or "", open_[-1])
        open_[-1].children.append(child)
        if name in WHOLE:
            _mark_holders(child)
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
        elif name not in VOID:
            places.setdefault(name, []).append(len(open_))
            if name in BLOCK:
                blocks.append(len(open_))
            open_.append(child)
    return root


def _mark_holders(whole: Node) -> None:
    """The elements around an article or main element hold it; a header that does is no banner."""
    up = whole.parent
    while up is not None and not up.holds:
        up.holds = True
        if up.banner:
            up.dropped = False
        up = up.parent


def _squeezed(parts: list[str]) -> str:
    return " ".join("".join(map(entities.unescape, parts)).split())


def _prose_points(text: str) -> float:
    return 1.0 + text.count(",") + min(len(text) / LENGTH_UNIT, LENGTH_MOST)


def _settle(root: Node) -> None:
    """Drops the doubtful elements but those that hold the page's text.

    An element that has a main element or most of the paragraph points is kept, and one that has articles
    where those outside of it have little.  An area of comments never outweighs text elsewhere.
    """
    # Sums by the nearest doubtful element: points of all text, of that in articles, of that in likely elements.
    own: dict[Node, list[float]] = {root: [0.0, 0.0, 0.0]}
    above: dict[Node, Node] = {}
    mains: set[Node] = set()
    articles: set[Node] = set()
    stack = [(root, root, False, False)]
    while stack:
        node, area, whole, likely = stack.pop()
        if node.doubtful:
            own[node], above[node], area = [0.0, 0.0, 0.0], area, node
            whole = likely = False
        if node.name in WHOLE and not _unlikely(node.words):
            whole = True
            (mains if node.name == "main" else articles).add(area)
        likely = likely or (node.name not in ("html", "body") and LIKELY.search(node.words) is not None)
        if node.name in BLOCK and node.name not in HEADINGS and (text := _own_text(node).strip()):
            points = _prose_points(text)
            for i, here in enumerate((True, whole, likely)):
                own[area][i] += points * here
        stack += [(c, area, whole, likely) for c in reversed(node.children) if isinstance(c, Node) and not c.dropped]
    total = {area: sums[0] for area, sums in own.items()}
    for area in reversed(above):
        total[above[area]] += total[area]
        for kind in (mains, articles):
            if area in kind:
                kind.add(above[area])
    beside = {root: (0.0, 0.0)}
    for area, outer in above.items():
        in_whole, in_likely = beside[area] = tuple(x + y for x, y in zip(beside[outer], own[outer][1:], strict=True))
        comments = COMMENTS.search(area.words) is not None
        home = max(in_whole, in_likely) if comments else in_whole
        rest = home <= (0.0 if comments else SIBLING_SHARE * total[area])
        # A notice on a page of a few words is not its text.
        most = total[area] > total[root] / 2 and (total[area] >= SIBLING_LEAST or (total[area] == total[root] and area.name != "form"))
        area.dropped = not (area in mains or (area in articles and (rest or most)) or (most and rest))


def _measure(root: Node) -> list[Node]:
    """Sizes and link sizes of all nodes, bottom up; the nodes in document order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        if (up := node.parent) is not None:
            node.above = up if _takes_points(up) else up.above
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped]
    for node in reversed(order):
        for child in node.children:
            if isinstance(child, str):
                node.size += len(child) - child.count(" ") // 8 if not child.isspace() else 0
            elif not child.dropped:
                node.size += child.size
                node.linked += child.linked
        if node.name == "a":
            node.linked = node.size
        # The sizes above it are still to be summed, so what goes here does not count in them.
        node.dropped = node.dropped or (node.linky and _density(node) >= LINKY)
    gone: set[Node] = set()
    for node in order:
        if node.dropped or node.parent in gone:
            gone.add(node)
    return [node for node in order if node not in gone] if gone else order


def _takes_points(node: Node) -> bool:
    return node.name in CONTAINERS or node.name in LISTS


def _own_text(node: Node) -> str:
    """Text of the node without that of the blocks in it."""
    parts, stack = [], list(reversed(node.children))
    while stack:
        child = stack.pop()
        if isinstance(child, str):
            parts.append(child)
        elif child.name == "br":
            parts.append(" ")
        elif not (child.dropped or child.doubtful) and child.name not in BLOCK:
            stack += reversed(child.children)
    return "".join(parts)


def _density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _best(root: Node) -> list[Node]:
    """The best container, with those of its siblings that belong to the text, in page order."""
    _settle(root)
    order = _measure(root)
    scored: list[Node] = []
    for node in order:
        if node.name in BLOCK and node.size:
            text = _own_text(node).strip()
            if not text:
                continue
            points = _prose_points(text)
            if node.name in HEADINGS:
                node.points += points
                continue
            share, up = 1.0, node
            if node.name in ("p", "li", "dd", "dt", "td", "th", "pre") or not _takes_points(node):
                up = node.above
            for _ in range(LEVELS):
                if up is None:
                    break
                if up.name in CONTAINERS:
                    up.points += points * share
                    scored.append(up)
                    share /= 2
                else:
                    up.points += points
                up = up.above
    best, most = None, 0.0
    for node in dict.fromkeys(scored):
        points = node.points + TAG_POINTS.get(node.name, 0.0)
        points += CLASS_POINTS * bool(LIKELY.search(node.words)) - CLASS_POINTS * bool(UNLIKELY.search(node.words))
        node.points = points * (1.0 - _density(node))
        if best is None or node.points > most:
            best, most = node, node.points
    if best is None:
        return [next((n for n in order if n.name == "body"), root)]
    up = best
    while up is not None:
        if up.name in WHOLE:
            best = up
        up = up.parent
    # A container that only wraps the best one's equals, such as several articles, is no better.
    if not best.inside:
        _drop_bars(best)
    if best.parent is None or best.name == "body":
        return [best]
    kept = []
    for child in best.parent.children:
        if child is best:
            kept.append(child)
        elif isinstance(child, Node) and not child.dropped and child.size:
            reads = child.name in ("p", "blockquote", "pre") and _density(child) < LINKY / 2 and child.size >= 80
            strong = child.points >= max(SIBLING_LEAST, SIBLING_SHARE * most) and _density(child) < LINKY
            # Outside of article and main elements nothing tells which of the siblings are the text's.
            alike = child.name in WHOLE if best.name in WHOLE else _has_prose(child)
            if reads or strong or (alike and _density(child) < LINKY):
                kept.append(child)
    return kept


def _drop_bars(top: Node) -> None:
    """Drops bars of links, names or rights before the first and after the last text of a container that is no article."""
    for children in (top.children, reversed(top.children)):
        for child in children:
            if isinstance(child, str):
                if child.strip():
                    break
            elif child.size and not child.dropped:
                if child.name not in BLOCK or child.name == "p" or child.name in HEADINGS or _has_prose(child):
                    break
                text = _squeezed(list(_all_text(child)))
                if len(text) > BAR_SIZE or not (BAR.search(text) or _density(child) >= LINKY):
                    break
                child.dropped = True


def _all_text(node: Node) -> Iterator[str]:
    stack: list[Node | str] = [node]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            yield node
        elif not node.dropped:
            yield " "
            stack += reversed(node.children)


def _has_prose(node: Node) -> bool:
    """Whether the node is or has a paragraph, heading, list or table with text."""
    stack = [node]
    while stack:
        node = stack.pop()
        if node.size and (node.name in ("p", "blockquote", "pre") or node.name in HEADINGS or node.name in LISTS):
            return True
        stack += [c for c in node.children if isinstance(c, Node) and not c.dropped]
    return False


def _blocks(top: Node) -> list[str]:
    """The texts of the blocks below top, in page order."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if parts:
            if text := _squeezed(parts):
                out.append(text)
            parts.clear()

    # With each node, whether it or an element around it is marked as a menu.
    stack: list[tuple[Node | str | None, bool]] = [(top, False)]
    while stack:
        node, menu = stack.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            parts.append(node)
        elif node.name == "br":
            parts.append(" ")
        elif not node.dropped or node is top:
            block = node.name in BLOCK or node is top
            menu = menu or (node is not top and MENU.search(node.words) is not None)
            # A list or table that is nearly all links is navigation where it is marked so.
            if menu and node.name in ("ul", "ol", "table", "dl") and _density(node) > 0.8:
                flush()
                continue
            if block:
                flush()
                stack.append((None, False))
            stack += [(c, menu) for c in reversed(node.children)]
    flush()
    return out


def main_text(page: str) -> str:
    """The page's main text, its blocks joined by line ends; empty where there is none."""
    if not page:
        return ""
    return "\n".join(x for top in _best(parse(page)) for x in _blocks(top))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points of text).

    Null or empty html, and pages without text, give an empty text.  Repeated rows each get their row,
    other columns are not read, an empty table gives an empty result.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(x) for x in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(scan, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
