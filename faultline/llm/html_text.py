"""Main text of a page by tree scoring.

Paragraph-like blocks pass points to their ancestors: one, one per comma, and one per 100
characters (three at most) to the parent; half to the grandparent; a third, a quarter and so on
further up.  A container's points are discounted by its share of link text.  The best container
is widened to the article or main element around it.  Without one its siblings that hold text and
few links are kept with it; beside one, those that score nearly as well or are paragraphs, titles
or articles with few links.  Elements that by
tag, role or class name are menus, notices, adverts, comments and the like are left out first.

A name counts by whole tokens of class, id and role: all of its words must say so ("site-footer").
A token with other words beside ("related-work") only makes links suspect, and one that tells of
the page's layout ("has-sidebar") says nothing.  No name by itself removes a heading, a paragraph,
or an element that holds an article, the main element or most of the text: it lowers their points.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from faultline.llm.common import ship

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template xmp iframe noembed noframes".split())
LEFT_OUT = RAW | set("nav footer aside form button select dialog menu header svg canvas object audio video".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr img".split()
)
SCORED = set("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
STORY = {"article", "main"}
PROSE = set("p pre blockquote".split())
TEXT_TAGS = set("p h1 h2 h3 h4 h5 h6".split())
MAYBE, SURE = 1, 2
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Words in class, id and role that mark what is not main text, and words that speak for it.
NAMED_OUT = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|comment(?:s|list|area|box|form|ers?|thread|section|wrap\w*)|commentlist\w*|complementary|contentinfo|cookies?|consent|disqus"
    r"|discussions?|footer|gdpr|masthead|menu\w*|modal|nav|nav(?:s|bar|igation)\w*|newsletter|notice|notification|pagination|popup|promo\w*"
    r"|reactions?|related|remarks?|repl(?:y|ies)|replylist|respond|responses?|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar"
    r"|widget|alert|search|login",
    re.I,
)
#: Words that leave the meaning of such a name as it is, and words that turn it into a state of the page.
BESIDE = re.compile(
    r"\d*|\w|\d+x\d+|area|articles?|aside|bar|block|body|bottom|box|btn|buttons?|center|col|column|container|content"
    r"|desktop|floating|form|fixed|global|google|group|header|icons?|inner|items?|language|left|level|links?|list"
    r"|local|main|mega|mobile|more|outer|overlay|page|panel|posts?|primary|right|secondary|section|side|site"
    r"|slot|sticky|stories|tertiary|thread|toggle|top|unit|wrap|wrapper",
    re.I,
)
STATE = re.compile(r"has|have|is|no|non|not|with|without|hide|hides|hidden|show|shows|open|closed|enabled|disabled|off", re.I)
REMARKS = re.compile(
    r"(?:^|[\s_-])(?:comment(?!ar)\w*|discussions?|disqus|reactions?|remarks?|repl(?:y|ies)|replylist|respond|responses?)"
    r"(?:$|[\s_-])",
    re.I,
)
NAMED_IN = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text)(?:$|[\s_-])", re.I)

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    # a quote opens a value only behind "=", and only if it closes
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=(?:\s*(?:\"[^\"]*\"|'[^']*'))?)*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
TOLD = {"class", "id", "role", "hidden", "style", "aria-hidden"}
WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "names", "children", "parent", "out", "points", "length", "linked", "commas", "named", "weight", "prose")

    def __init__(self, tag: str, parent: Node | None, names: str = "", out: bool = False, named: int = 0):
        self.tag, self.parent, self.names, self.out, self.named = tag, parent, names, out, named
        self.children: list = []
        self.points, self.weight = 0.0, 1.0
        self.prose = 0
        self.length = self.linked = self.commas = 0


def _names(attributes: str) -> tuple[str, str, bool]:
    """Class, id and role as one string; the id; whether the element is hidden."""
    names, own, hidden = [], "", False
    for key, value in ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key not in TOLD:
            continue
        value = value.strip("\"'")
        if key in ("class", "id", "role"):
            names.append(value)
            own = value if key == "id" else own
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            hidden = True
        elif key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    return " ".join(names), own, hidden


def parse(page: str) -> Node:
    """Element tree with forgiving rules for missing and stray end tags."""
    root = Node("#root", None)
    here, at, size = root, 0, len(page)
    opened: dict[str, int] = {}  # open elements by tag
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            here.children.append(page[at:])
            break
        if mark > at:
            here.children.append(page[at:mark])
        found = TOKEN.match(page, mark)
        if found is None:
            if page[mark + 1 : mark + 2].isalpha() or page[mark + 1 : mark + 2] == "/":
                at = page.find("<", mark + 1)  # a tag that never ends
                at = size if at < 0 else at
            else:  # a bare "<"
                here.children.append("<")
                at = mark + 1
            continue
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if opened.get(tag):  # else it is a stray one
                here = _closed(here, tag, opened)
            continue
        if tag in ENDS_P and opened.get("p"):
            node = here
            while node is not root and (node.tag in INLINE):
                node = node.parent
            if node.tag == "p":
                here = _closed(here, "p", opened)
        if tag in CLOSES and any(map(opened.get, CLOSES[tag])):
            node = here
            while node is not root and node.tag not in ("ul", "ol", "dl", "select", "table", "tbody", "thead"):
                above = node.parent
                if node.tag in CLOSES[tag]:
                    here = _closed(here, node.tag, opened)
                    if tag != "tr":
                        break
                node = above
        names, own, hidden = _names(found[3]) if found[3] else ("", "", False)
        named = _named(names) if names and tag not in ("html", "body") else 0
        if named == SURE and tag == "section" and names == own and _within(here, STORY) and (
            not REMARKS.search(own) or own.lower() in ("discussion", "responses")
        ):
            named = MAYBE  # ids of sections are targets of links to their headings
        node = Node(tag, here, names, hidden or tag in LEFT_OUT, named)
        here.children.append(node)
        if tag in RAW and not found[3].rstrip().endswith("/"):
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not found[3].rstrip().endswith("/"):
            here = node
            opened[tag] = opened.get(tag, 0) + 1
    return root


def _closed(here: Node, tag: str, opened: dict[str, int]) -> Node:
    """Where the page goes on once the innermost open element of that tag is closed."""
    while True:
        opened[here.tag] -= 1
        found, here = here.tag == tag, here.parent
        if found:
            return here


def _named(names: str) -> int:
    """Whether class, id and role mark an element as no main text: not, perhaps (``MAYBE``), or ``SURE``."""
    most = 0
    for token in names.replace("side-bar", "sidebar").split():
        if token.lower() in ("article", "main", "content"):
            return 0
        words = re.split(r"[_-]+", token)
        if any(map(NAMED_OUT.fullmatch, words)) and not any(map(STATE.fullmatch, words)):
            most = max(most, SURE if all(NAMED_OUT.fullmatch(w) or BESIDE.fullmatch(w) for w in words) else MAYBE)
    return most


def _within(node: Node | None, tags: set[str]) -> bool:
    while node is not None and node.tag not in tags:
        node = node.parent
    return node is not None


def _leave_out(root: Node) -> None:
    """Leaves out what names mark, and lowers the weight of what they may not remove."""
    order = _walk(root)
    if not any(node.named for node in order):
        return
    _measure(order)
    holds: set[Node] = set()
    for node in reversed(order):
        if node.tag in PROSE:
            node.prose = node.length - node.linked
        if node.parent is not None:
            node.parent.prose += node.prose
            if node in holds or (node.tag in STORY and node.named < SURE):
                holds.add(node.parent)
    whole = root.prose
    for node in order:
        above = node.parent
        if above is not None:
            node.out, node.weight = node.out or above.out, above.weight
        if node.tag in STORY and not node.named:
            node.weight = 1.0
        if not node.named or node.out:
            continue
        # most of the text of paragraphs, or of all text outside links if there are none
        most = 2 * node.prose > whole if whole else 2 * (node.length - node.linked) > root.length - root.linked
        keeps = node.tag in STORY or node.tag in TEXT_TAGS or node in holds or most
        if not keeps and (node.named == SURE or _density(node) >= 0.5):
            node.out = True
        else:
            node.weight *= 0.1 if node.named == SURE and REMARKS.search(node.names) else 0.5
    for node in order:
        node.length = node.linked = node.commas = 0


def _walk(root: Node) -> list[Node]:
    """All kept elements, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.out)
    return order


def _measure(order: list[Node]) -> None:
    """Lengths of text and of link text, and commas, summed up the tree."""
    for node in reversed(order):
        for child in node.children:
            if isinstance(child, str):
                solid = len(child) - child.count(" ")
                node.length += solid
                node.commas += child.count(",") + child.count("，") + child.count("、")
            elif not child.out:
                node.length += child.length
                node.commas += child.commas
                node.linked += child.linked
        if node.tag == "a":
            node.linked = node.length


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _score(order: list[Node]) -> None:
    for node in order:
        texts = any(isinstance(c, str) and c.strip() for c in node.children)
        if not (node.tag in SCORED or (node.tag in ("div", "section", "article", "main", "body") and texts)):
            continue
        if node.length < 15:
            continue
        points = (1 + node.commas + min(node.length // 100, 3)) * (1 - _density(node)) * node.weight
        step, above = 0, node.parent if node.tag in SCORED else node
        while above is not None and step < 6:
            above.points += points / (1 if step == 0 else step + 1)
            above, step = above.parent, step + 1
    for node in order:
        if node.tag in ("article", "main") or NAMED_IN.search(node.names):
            node.points *= 1.25
        node.points *= 1 - _density(node)


def _blocks(node: Node, out: list[str], buffer: list[str]) -> None:
    """Texts of blocks in page order; inline elements belong to the block around them."""
    stack: list = [(node, 0)]
    while stack:
        now, i = stack.pop()
        while i < len(now.children):
            child = now.children[i]
            i += 1
            if isinstance(child, str):
                buffer.append(child)
            elif child.out:
                if child.tag not in INLINE:
                    _close(out, buffer)
            elif child.tag in INLINE:
                stack.append((now, i))
                now, i = child, 0
            else:
                _close(out, buffer)
                stack.append((now, i))
                now, i = child, 0
        if now.tag not in INLINE:
            _close(out, buffer)


def _close(out: list[str], buffer: list[str]) -> None:
    text = WHITE.sub(" ", html.unescape("".join(buffer))).strip()
    buffer.clear()
    if text:
        out.append(text)


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by a space; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    _leave_out(root)
    order = _walk(root)
    _measure(order)
    _score(order)
    inner = [n for n in order if n.tag not in ("#root", "html", "head") + tuple(SCORED | INLINE)]
    best = max(inner, key=lambda n: n.points, default=None)
    if best is None or best.points <= 0:
        best = next((n for n in order if n.tag in ("article", "main")), None)
        best = best or next((n for n in order if n.tag == "body"), None) or order[0]
    least = max(2.0, best.points * 0.2)
    best = _story(best)
    out: list[str] = []
    buffer: list[str] = []
    loose: list[str | Node] = []
    for child in best.parent.children if best.parent is not None else [best]:
        if isinstance(child, str) or (child.tag in INLINE and child is not best):
            loose.append(child)
            continue
        _loose(loose, best, out)
        if child is best or (not child.out and _belongs(child, best, least)):
            _blocks(child, out, buffer)
    _loose(loose, best, out)
    return " ".join(out)


def _story(best: Node) -> Node:
    """The nearest article, or else the nearest main element, that holds the container; or itself."""
    found, node = None, best
    while node is not None:
        if node.tag == "article" and node.named < SURE:
            return node
        if node.tag == "main" and found is None:
            found = node
        node = node.parent
    return found or best


def _belongs(child: Node, best: Node, least: float) -> bool:
    """Whether a sibling of the container is main text too."""
    if child.tag in ("head", "body") or (child.named == SURE and REMARKS.search(child.names)):
        return False
    density = _density(child)
    if child.tag not in ("ul", "ol") and child.points >= least and density < 0.3:
        return True
    if best.tag == "body" or not child.length or density >= 0.25 or (child.named == SURE and child.tag not in TEXT_TAGS):
        return False
    return best.tag not in STORY or child.tag in ("p", "h1", "h2", "article")


def _loose(run: list, best: Node, out: list[str]) -> None:
    """Bare text and inline elements beside the container, as a block of its own."""
    nodes = [c for c in run if isinstance(c, Node) and not c.out]
    texts = sum(len(c) - c.count(" ") for c in run if isinstance(c, str) and c.strip())
    total = texts + sum(n.length for n in nodes)
    if best.tag not in STORY and best.tag != "body" and total and sum(n.linked for n in nodes) < 0.25 * total:
        block = Node("div", None)
        block.children = list(run)
        _blocks(block, out, [])
    run.clear()


def extract(pages: DataFrame, name: str = "text") -> DataFrame:
    """``pages`` (with ``html``) plus the main text; a column of that name is replaced.

    A null or empty page gives an empty text.  Rows are independent.
    """
    ship(pages.sparkSession)
    pages = pages.drop(name)
    schema = T.StructType([*pages.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [main_text(p.as_py()) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=schema.names)

    return pages.mapInArrow(run, schema)
