"""Main text of web pages by composite text density.

Every element of the page's tree gets a density: its characters per tag,
adjusted by how many of both lie in links. The sum of the densities of the
blocks in it marks how much of an element's worth comes from below it; the
subtree with the largest sum holds the article. The smallest density on the
path from there to the body is the threshold that other subtrees must reach to
count as well.
What stands beside the article on that path without a link in it (a headline, a
closing line) is taken too.
Elements that are never article text (navigation, scripts, controls, what is
hidden) are cut off before densities are taken. An element that only its class,
id or role speaks against, or a form, is cut if the page has other text: if it
holds nearly all of the prose, it is a page's frame and stays (:func:`settle`).
"""

from __future__ import annotations

import html as entities
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Elements whose content is never text of the article.
CUT_TAGS = frozenset("script style noscript template iframe object embed svg canvas audio video map nav header footer aside button select textarea label legend datalist menu dialog head title".split())
#: Elements whose content is not markup.
RAW_TAGS = "script|style|textarea|title|noscript|template|iframe|svg"
#: Words of class and id that mark such content.
CUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promotion promoted banner sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices notification alert popup popover modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations widget pagination pager toolbar skip".split()
)
#: First words of a class that tell of a page's layout, as in with-sidebar.
LAYOUT = frozenset("with without has have no not non is js".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Elements that keep their content whatever their class says, but for comments.
TRUSTED = frozenset(("html", "body", "main", "article"))
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: A suspect stays if the prose that nothing speaks against is less than this
#: share of its own; the second for what seems to be reader comments.
FRAME, COMMENTED_FRAME = 0.25, 0.05
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Start tags that end an open paragraph, and elements that end their own kind.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table body article section div main td th".split())

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + RAW_TAGS + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "parent", "cut", "doubt", "kids", "chars", "tags", "link_chars", "link_tags", "density", "sum", "parts")

    def __init__(self, tag: str, parent, cut: bool):
        self.tag, self.parent, self.cut = tag, parent, cut
        self.doubt = 0.0  # share below which other prose saves a suspect; 0: none
        self.kids: list = []  # elements, texts and the mark of a line break, in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.parts: list[Node] = []  # the outermost blocks below


BREAK = object()


def _named(value: str) -> set[str]:
    """Words of a class or id; names of a layout and their modifiers have none."""
    names = (_WORDS.findall(name.split("--")[0]) for name in value.split())
    return {w.lower() for words in names if words and words[0].lower() not in LAYOUT for w in words}


def _judged(tag: str, attrs: str) -> tuple[bool, float]:
    """(never article text, share of a suspect or 0) of an element."""
    if tag in CUT_TAGS:
        return True, 0.0
    doubt = FRAME if tag == "form" else 0.0
    if not attrs:
        return False, doubt
    found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True, 0.0
    words = _named(found.get("class", "")) | _named(found.get("id", ""))
    if tag in TRUSTED:
        return False, COMMENTED_FRAME if tag == "article" and words & COMMENT_WORDS else 0.0
    if words & COMMENT_WORDS:
        return False, COMMENTED_FRAME
    return False, FRAME if words & CUT_WORDS or found.get("role", "").lower() in CUT_ROLES else doubt


def parse(html: str) -> Node:
    """The body's tree; unclosed, misnested and stray tags are put right."""
    root = node = Node("body", None, False)
    at = 0
    for m in _PIECE.finditer(html):
        start = m.start()
        if start > at and (node.cut is False):
            node.kids.append(html[at:start])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in ("html", "body"):
            continue
        if m["end"]:
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node = up.parent
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                node.kids.append(BREAK)
            node.tags += 1
            continue
        if tag in ENDS_P:
            up = node
            while up is not root and up.tag != "p" and (up.tag in INLINE):
                up = up.parent
            if up.tag == "p":
                node = up.parent
        elif tag in ENDS_OWN:
            up = node
            while up is not root and up.tag not in ENDS_OWN[tag] and up.tag not in SCOPES:
                up = up.parent
            if up is not root and up.tag in ENDS_OWN[tag]:
                node = up.parent
                while tag == "tr" and node.tag in ("td", "th", "tr") and node is not root:
                    node = node.parent
        cut, doubt = _judged(tag, m["attrs"])
        child = Node(tag, node, node.cut or cut)
        child.doubt = doubt
        if not child.cut:
            node.kids.append(child)
        if not m["attrs"].endswith("/") or tag not in ("svg", "path"):
            node = child
    if at < len(html) and not node.cut:
        node.kids.append(html[at:])
    return root


def settle(root: Node) -> None:
    """Cut the suspects, but for frames of the page.

    Within the body, and again within each suspect that stays: the prose
    (characters outside links) of the outermost suspects, the largest first, is
    set against the prose outside all of them and of those that stay. Where an
    article or main element has prose, all suspects go.
    """
    order, stack = [], [(root, False)]
    while stack:
        n, linked = stack.pop()
        order.append((n, linked))
        stack += [(k, linked or k.tag == "a") for k in n.kids if isinstance(k, Node)]
    prose: dict[int, int] = {}
    for n, linked in reversed(order):
        own = 0 if linked else sum(len("".join(k.split())) for k in n.kids if isinstance(k, str))
        prose[id(n)] = own + sum(prose[id(k)] for k in n.kids if isinstance(k, Node))
    frames = [root]
    while frames:
        frame = frames.pop()
        suspects, stack, sure = [], [frame], False
        while stack:
            for k in stack.pop().kids:
                if isinstance(k, Node):
                    (suspects if k.doubt else stack).append(k)
                    sure |= k.tag in ("article", "main") and not k.doubt and prose[id(k)] > 0
        rest = math.inf if sure else prose[id(frame)] - sum(prose[id(k)] for k in suspects)
        for k in sorted(suspects, key=lambda k: -prose[id(k)]):
            if rest < k.doubt * prose[id(k)]:
                frames.append(k)
                rest += prose[id(k)]
            else:
                k.parent.kids.remove(k)


def measure(root: Node) -> None:
    """Characters, tags, and both in links, from the leaves up."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [k for k in n.kids if isinstance(k, Node)]
    for n in reversed(order):
        for k in n.kids:
            if isinstance(k, Node):
                n.chars += k.chars
                n.tags += k.tags + 1
                n.link_chars += k.link_chars
                n.link_tags += k.link_tags
            elif k is not BREAK:
                n.chars += len("".join(k.split()))
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags + 1
    body_ratio = root.link_chars / max(root.chars, 1)
    for n in reversed(order):
        c, t, lc, lt = n.chars, max(n.tags, 1), n.link_chars, n.link_tags
        if c:
            base = math.log(c * lc / max(c - lc, 1) + body_ratio * c + math.e)
            n.density = c / t * max(math.log(c * t / (max(lc, 1) * max(lt, 1)), base) if base != 1 else math.log(c * t / (max(lc, 1) * max(lt, 1))), 0.0)
        # formatting within a block is no part of its own: blocks below it count for the block
        n.parts = [b for k in n.kids if isinstance(k, Node) for b in ([k] if k.tag not in INLINE else k.parts)]
        n.sum = sum(k.density for k in n.parts) if n.parts else n.density


def _best(root: Node) -> Node:
    """The block with the largest sum of its parts' densities, the outermost of
    equals; one without parts counts with its own density."""
    best, most, stack = root, -1.0, [root]
    while stack:
        n = stack.pop()
        if n.sum > most:
            best, most = n, n.sum
        stack += reversed(n.parts)
    return best


def select(root: Node) -> list[Node]:
    """Roots of the subtrees that hold the article, in page order.

    The first is the subtree with the largest sum. The smallest density on its
    path to the body is what any other subtree must reach to be taken as well,
    each down to where its own sum is largest. A block beside that path is taken
    whole if it has text and no link.
    """
    best = _best(root)
    threshold, up, path = best.density, best.parent, {id(best)}
    while up is not None:
        path.add(id(up))
        threshold, up = min(threshold, up.density) if up is not root else threshold, up.parent
    found, stack = [], [root]
    while stack:
        n = stack.pop()
        beside = n.parent is not None and id(n.parent) in path and id(n) not in path and n.chars and not n.link_chars
        if n is best or beside or (n.density >= threshold > 0 and id(n) not in path):
            found.append(n if n is best or beside else _best(n))
        else:
            stack += reversed(n.parts)
    return found


def text_of(nodes: list[Node]) -> str:
    blocks: list[list[str]] = [[]]
    for top in nodes:
        stack: list = [top]
        while stack:
            k = stack.pop()
            if isinstance(k, str):
                blocks[-1].append(k)
            elif k is BREAK:
                blocks.append([])
            else:
                if k.tag not in INLINE:
                    blocks.append([])
                    stack.append(BREAK)
                stack += reversed(k.kids)
    joined = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return " ".join(b for b in joined if b)


def main_text(html: str | None) -> str:
    """The article's text; '' for null, empty or textless pages."""
    if not html:
        return ""
    root = parse(html)
    settle(root)
    measure(root)
    return text_of(select(root))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null and empty pages give ''; repeated pages give repeated rows; other
    columns are ignored. Each page is parsed whole, whatever its length.
    """

    def work(batches):
        for b in batches:
            found = [main_text(h) for h in b.column("html").to_pylist()]
            yield {"page_id": b.column("page_id"), "url": b.column("url"), "text": found, "n_chars": [len(t) for t in found]}

    return arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"), work, "page_id long, url string, text string, n_chars long")
