"""Main text of web pages by composite text density.

A page becomes a tree of elements. For every node, the characters it holds per
tag, adjusted by those in links, give its density; the node whose children
have the largest sum of densities is the page's main part, and nodes below the
least density on the path from it to the body are noise."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?", re.S)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Kinds of elements.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("script style noscript template head nav footer aside form iframe button select textarea option svg canvas object embed applet dialog menu noembed noframes xmp title audio video map input".split())
CLOSES_P = BLOCKS - frozenset("body html li dd dt td th tr tbody thead tfoot legend summary figcaption".split())
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
PARTS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
INLINE = frozenset("b i em strong a span font u s small big code tt cite abbr sub sup mark q kbd samp var del ins label".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr newsletter subscribe subscription signup "
    "login popup popover modal overlay paywall sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer topbar toolbar comment comments commentlist disqus respond reply replies "
    "recommended recommendations pagination pager".split()
)
#: Words that suspect a node only where its class or id has no others but these, NOISE_WORDS and words of layout.
WEAK_WORDS = frozenset("notice notices alert foot header masthead share sharing social related widget widgets skip toc copyright legal disclaimer hidden".split())
LAYOUT_WORDS = frozenset("area articles bar block bottom box btn button buttons container content global group icon icons inner item items left link links list module page panel posts right row section site stories text top wrap wrapper".split())
#: Elements whose ids are anchors in a text.
TEXT_TAGS = HEADINGS | frozenset("p li dt dd td th tr pre blockquote figure table".split())
#: A node that a word of its class or id suspects is noise up to so many characters outside links, or up to so large a share of the page's.
LITTLE, SHARE = 200, 0.2


class Node:
    __slots__ = ("tag", "parts", "parent", "noise", "suspect", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False, suspect: bool = False) -> None:
        self.tag, self.parent, self.noise, self.suspect, self.parts = tag, parent, noise, suspect, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _noise(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether a node is noise whatever it holds, and whether a word of its class or id suspects it."""
    suspect = False
    if tag in DROPPED or tag == "header" and not inside_article:
        return True, suspect
    if not attributes or tag in ("html", "body"):
        return False, suspect
    named = tag in ("article", "main")
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower()
        if named and name not in ("class", "id"):
            continue
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in NOISE_ROLES:
            return True, suspect
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, suspect
        if name == "class" or name == "id" and tag not in TEXT_TAGS:
            words = set(re.split(r"[^a-z0-9]+", value)) - {""}
            suspect |= not NOISE_WORDS.isdisjoint(words) or not WEAK_WORDS.isdisjoint(words) and words <= WEAK_WORDS | LAYOUT_WORDS
    return False, suspect


def tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, tag, attributes or text, end) of a page; kind is "text", "open" or "close". The caller may send the place to go on from.

    Quotes in a tag hide its end. Where they are not closed the next > ends it;
    looking for their ends in vain is given up once that took a few times the page's length."""
    at, n, spent = 0, len(page), 0
    while at < n:
        start = page.find("<", at)
        if start != at:
            end = n if start < 0 else start
            at = (yield "text", "", page[at:end], end) or end
            continue
        if (m := _MARKUP.match(page, at)) is not None:
            at = m.end()
            continue
        end = -1
        if (m := _NAME.match(page, at)) is not None:
            if spent <= 4 * n and (found := _QUOTED.match(page, m.end())) is not None:
                end = found.end()
            else:
                spent += n - at
                end = page.find(">", m.end()) + 1 or -1
        if end < 0:
            if m is not None:  # no tag ends any more
                yield "text", "", page[at:], n
                return
            at = (yield "text", "", "<", at + 1) or at + 1
        else:
            at = (yield "close" if m[1] else "open", m[2].lower(), page[m.end() : end - 1], end) or end


def parsed(page: str) -> Node:
    """The page's tree under its body; dropped elements keep their place but are marked."""
    root = node = Node("body", None)
    held = Counter()  # open elements by tag
    stream, jump = tokens(page), None

    def leave(up: Node) -> Node:
        """Closes all up to and with a node."""
        at = node
        while at is not up:
            held[at.tag] -= 1
            at = at.parent
        held[up.tag] -= 1
        return up.parent

    while True:
        try:
            kind, tag, inner, end = stream.send(jump)
        except StopIteration:
            return root
        jump = None
        if kind == "text":
            node.parts.append(inner)
            continue
        if kind == "close":
            if held[tag] > 0:
                up = node
                while up.tag != tag and not (tag in INLINE and up.tag in BLOCKS):
                    up = up.parent
                if up.tag == tag:
                    node = leave(up)
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            if held["p"] > 0:
                up = node
                while up.tag != "p" and up.tag not in BLOCKS:
                    up = up.parent
                if up.tag == "p":
                    node = leave(up)
        elif tag in PARTS:
            left, up = sum(held[x] for x in PARTS[tag]), node
            while left > 0 and up.tag not in SIBLINGS[tag]:
                left -= up.tag in PARTS[tag]
                up, node = up.parent, leave(up) if up.tag in PARTS[tag] else node
        if node.tag == "head" and tag not in ("title", "meta", "link", "script", "style", "base", "noscript", "template"):
            node = leave(node)
        made = Node(tag, node, *_noise(tag, inner, held["article"] + held["main"] > 0))
        node.parts.append(made)
        if tag in _RAW_END:
            found = _RAW_END[tag].search(page, end)
            made.noise, jump = True, found.end() if found else len(page)
        elif tag not in VOID:
            node = made
            held[tag] += 1


def measured(root: Node) -> list[Node]:
    """Counts and densities of all nodes without noise, parents before children."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [p for p in reversed(node.parts) if isinstance(p, Node) and not p.noise]
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = 0.0
        link = node.tag == "a"
        for p in node.parts:
            if isinstance(p, str):
                node.chars += len("".join(p.split()))
            elif not p.noise:
                node.chars += p.chars
                node.tags += p.tags + 1
                node.link_chars += p.link_chars
                node.link_tags += p.link_tags
        if link:
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    ratio = root.link_chars / max(1, root.chars)
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if c:
            base = math.log(c / max(1, c - node.link_chars) * node.link_chars + ratio * c + math.e)
            node.density = c / t * math.log(max(1.0, c / lc * (t / lt))) / base
            node.density = max(node.density, 1e-9)
        node.total = sum(p.density for p in node.parts if isinstance(p, Node) and not p.noise)
    return order


def _densest(order: list[Node]) -> Node:
    return max(order, key=lambda x: x.total) if len(order) > 1 else order[0]


def _named(order: list[Node], best: Node) -> Node | None:
    """The outermost article or main around the largest sum, or one within it that has most of that sum, if there is any."""
    for node in order:
        if node.tag in ("article", "main") and (_within(best, node) or _within(node, best) and node.total >= 0.5 * best.total):
            return node
    return None


def judged(root: Node) -> list[Node]:
    """measured(), after suspect nodes have been found to be noise or not.

    They are noise only if they hold little text outside links, or a small
    share of the page's, and neither an article, a main nor the largest sum.
    Where the rest of the page has a main part that is an article or main,
    those outside of it do not compete with it."""
    order = measured(root)
    suspects = [n for n in order if n.suspect and n.tag not in ("article", "main")]
    if not suspects:
        return order
    holds: set[Node] = set()

    def hold(node: Node | None) -> None:
        while node is not None and node not in holds:
            holds.add(node)
            node = node.parent

    articles = [n for n in order if n.tag in ("article", "main") and not (n.suspect and n.chars <= SHARE * root.chars)]
    for node in articles:
        hold(node)
    inside = set(articles)
    for node in order:
        if node.parent in inside:
            inside.add(node)
    beside = [s for s in suspects if s not in holds and s not in inside] if articles else []
    for node in beside:
        node.noise = True
    rest = measured(root) if beside else order
    if beside and (_named(rest, _densest(rest)) is None or root.chars - root.link_chars <= LITTLE):
        for node in beside:
            node.noise = False
        beside, rest = [], measured(root)
    hold(_densest(rest))
    marked = False
    for node in rest:
        own = node.chars - node.link_chars
        if node.suspect and node not in holds and node.tag not in ("article", "main") and (own <= LITTLE or node.link_chars > own or node.chars <= SHARE * root.chars):
            node.noise = marked = True
    return measured(root) if marked else rest


def main_text(page: str | None) -> str:
    """The article of a page, one line for each block; empty if there is none."""
    if not page:
        return ""
    order = judged(parsed(page))
    root = order[0]
    best = _densest(order)
    least, node = best.density if best is not root else 0.0, best
    while node is not root:
        least, node = min(least, node.density), node.parent
    top = _named(order, best)
    if top is None:
        top = best
        while top is not root and top.tag not in BLOCKS:
            top = top.parent
        first, node = top, top
        while node is not root:
            if any(_belongs(n, least) for n in node.parent.parts if n is not node):
                top = node.parent
            node = node.parent
        node = first
        while node is not top:
            _leave_links(node.parent, node)
            node = node.parent
    lines: list[str] = []
    _collect(top, top, least, lines)
    return "\n".join(lines)


def _belongs(part: Node | str, least: float) -> bool:
    """Whether what stands beside the main part shows that the article goes on there: headings, and blocks over the threshold or with more than little text."""
    if isinstance(part, str) or part.noise or not part.chars:
        return False
    return part.tag in HEADINGS or part.link_chars < 0.3 * part.chars and (part.density >= least or part.chars > LITTLE and not part.suspect)


def _leave_links(parent: Node, main: Node) -> None:
    """Marks as noise the link-heavy blocks, and runs of text and inline elements, beside the main part."""
    run: list[int] = []

    def judge() -> None:
        own = [parent.parts[k] for k in run]
        nodes = [n for n in own if isinstance(n, Node)]
        if _heavy(sum(n.link_tags for n in nodes), sum(n.link_chars for n in nodes), sum(len("".join(n.split())) if isinstance(n, str) else n.chars for n in own)):
            for k in run:
                if isinstance(parent.parts[k], str):
                    parent.parts[k] = " "
                else:
                    parent.parts[k].noise = True
        run.clear()

    for k, part in enumerate(parent.parts):
        if part is main or isinstance(part, Node) and (part.noise or part.tag in BLOCKS):
            judge()
            if part is not main and part.tag not in HEADINGS and _heavy(part.link_tags, part.link_chars, part.chars):
                part.noise = True
        else:
            run.append(k)
    judge()


def _heavy(links: int, link_chars: int, chars: int) -> bool:
    return links >= 2 and 2 * link_chars > chars


def _within(node: Node, top: Node) -> bool:
    while node is not None and node is not top:
        node = node.parent
    return node is top


def _link_list(node: Node) -> bool:
    return node.tag in ("ul", "ol", "div", "table", "section", "p") and node.link_tags >= 3 and node.link_chars > 0.8 * node.chars


def _collect(top: Node, start: Node, least: float, lines: list[str]) -> None:
    """Blocks in page order; lists of links below the threshold are left out."""
    parts: list[str] = []

    def flush() -> None:
        line = " ".join("".join(parts).split())
        parts.clear()
        if line:
            lines.append(line)

    stack: list[tuple[Node, int]] = [(start, 0)]
    while stack:
        node, k = stack.pop()
        if k == 0 and node.tag in BLOCKS:
            flush()
        went = False
        while k < len(node.parts):
            p = node.parts[k]
            k += 1
            if isinstance(p, str):
                parts.append(html.unescape(p))
            elif p.tag == "br":
                parts.append(" ")
            elif not p.noise and not (p is not top and p.density < least and _link_list(p)):
                stack += [(node, k), (p, 0)]
                went = True
                break
            elif p.tag in BLOCKS:
                flush()
        if not went and node.tag in BLOCKS:
            flush()
    flush()


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    A null or empty page, or one without an article, has an empty text. Of
    nodes with equal sums the first one counts. Repeated rows give repeated
    results; other columns are ignored; an empty table gives no rows. Pages of
    any length and nesting are read whole, in time linear in them and without
    recursion."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def make():
        def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

        return extract

    return by_batch(rows, "page_id long, url string, text string, n_chars long", make)
