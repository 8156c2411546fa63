"""Main-text extraction by tree scoring.

A page's markup becomes a tree; what is never article text goes first: scripts, styles, forms, navigation, headers,
footers, sidebars, notices, adverts and reader comments, told by element, role, visibility or class and id. Outside an
article element a telling word within a class or id is enough. Inside one, a whole token has to say it (`social-share`,
not `social-history`), and paragraphs and headings are only judged by tokens that cannot name a subject. A token that says
how something is (`has-sidebar`, `menu-open`) tells nothing. A form or an element told by its class or id that holds more
than half of the page's paragraph points stays, unless it holds reader comments: it is a wrapper of the article.

Paragraphs then pass points (one, one for each comma, one for each hundred characters up to three) to their ancestors: all
of them to the parent, and half of what an element got to the next. An element's score is discounted by its link density
and the best container wins. Where it stands in an article element, that element is the author's own word for it: it
overrides the score and is taken whole. Else the container is taken together with its siblings: text, paragraphs,
headings, quotes, lists and tables, sections that are not mostly links, containers that score enough beside it, and those that stand
between kept ones or are paragraphs that end as sentences do; lists that are mostly links (menus) go.

One scan without a shuffle; a page is one small tree, built and scored in time linear in its length, whatever its depth.
Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by one
space; nothing else is dropped or cut.

Defined cases: null, empty or text-free html gives an empty text. Tags are read by the HTML standard's rules for
attributes (a stray quote is part of a name); a quote that never closes ends at the tag's end. Unclosed, misnested and
cut-off markup is read as it comes. A page without paragraphs gives its article, main or body element's text. Repeated
rows give equal results; of equal scores the first element in page order wins. Very long pages are read whole. Extra
columns pass through `extract`.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, rows_at_once

_VALUE = r"\s*=\s*(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++|(?=>))"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:{_VALUE})?+)*+)>|([^<]+)", re.S)
#: A tag that the standard's rules don't end before the page does: a quote is open.
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)()", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+|\d+")

RAW = frozenset("script style noscript template iframe textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening element ends these open ones, up to the barrier.
CLOSES = {**{t: ("p",) for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}, "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARRIER = frozenset("ul ol dl table td th article section div body html button".split())
DROPPED = frozenset("head script style noscript template iframe svg canvas nav footer aside form button input select textarea dialog menu object embed audio video map title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of class and id that tell what isn't the article.
TELLTALE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices popup modal overlay paywall subscribe subscription newsletter signup"
    " social share sharing related recommended recommendation recommendations sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead comment comments disqus replies reply respond toolbar skip login search"
    " outbrain taboola tags tagcloud alert disclaimer topbar header site-header".split()
)
#: Words that say nothing of a token's subject.
NEUTRAL = frozenset("box block container wrapper wrap inner outer list item items section bar links link post posts area top bottom left right inline unit slot widget form panel content main site page and by on the this article entry icons buttons button group thread reader user template".split())
#: Words that may well name a subject: on their own they tell only of plain containers.
SUBJECT = frozenset("comment comments alert notice notices tags search login reply replies respond header banner footer promotion social sharing related cookie cookies consent menu subscription disclaimer sponsor sponsors recommendation recommendations".split())
PLAIN = frozenset("div ul ol li aside form header footer".split())
#: Words that say how an element is, not what.
MODIFIERS = frozenset("has no with without open opened closed enabled disabled hidden visible fixed sticky active is on off".split())
#: Words of reader comments and of teasers for other pages: they tell of article elements, too.
READERS = frozenset("comment comments reply replies respond disqus".split())
TEASERS = frozenset("related recommended recommendation recommendations sponsored promo".split())
PARAGRAPH = frozenset("p pre td blockquote".split())
#: Elements that are text of their own beside the best container.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption hr br img".split())
LISTED = frozenset("ul ol dl table section main div".split())
KEEPS = frozenset(("html", "body", "main"))


class Node:
    __slots__ = ("tag", "parent", "near", "children", "score", "dropped", "spared", "length", "linked", "commas", "article")

    def __init__(self, tag: str, parent: "Node | None"):
        self.tag, self.parent, self.children, self.score = tag, parent, [], 0.0
        # spared: dropped by a rule that does not hold for a wrapper of the article.
        self.dropped = self.spared = self.article = False
        self.length = self.linked = self.commas = 0
        # The closest element from here upwards that a search for an element to end has to look at.
        self.near = self if parent is None or tag in SEARCHED else parent.near


SEARCHED = BARRIER | {t for closed in CLOSES.values() for t in closed}


def _telling(value: str, tag: str, inside: bool) -> bool:
    """Whether a class or id tells that the element isn't article text."""
    for token in value.split():
        words = {w.lower() for w in _WORD.findall(token)}
        if words & MODIFIERS:
            continue
        hit = words & TELLTALE
        if tag == "article":
            if words <= TELLTALE | NEUTRAL and hit & (READERS | TEASERS):
                return True
            continue
        if "side" in words and "bar" in words:
            return True
        if not hit:
            continue
        if not inside:
            return True
        if words <= TELLTALE | NEUTRAL and "header" not in words and (tag in PLAIN or hit - SUBJECT or (tag not in TEXTUAL and len(words) > 1) or (tag == "section" and "comments" in words)):
            return True
    return False


def _unwanted(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element isn't article text, and whether that would not hold for a wrapper of the article."""
    if tag == "form":
        return True, True
    if tag in DROPPED or tag == "header" and not inside:
        return True, False
    if not attributes or tag in KEEPS:
        return False, False
    told = readers = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False
        if name == "role" and value.lower() in ROLES:
            return True, False
        if name in ("class", "id") and _telling(value, tag, inside):
            told = True
            readers = readers or any({w.lower() for w in _WORD.findall(token)} & READERS for token in value.split())
    return told, not readers


def parse(page: str) -> Node:
    """The tree; text is a str among the children."""
    root = node = Node("html", None)
    at, end = 0, len(page)
    open_tags: Counter = Counter()

    def back_to(up: Node) -> Node:
        """Ends all elements from the current one to `up`, each once in its life."""
        n = node
        while n is not up.parent:
            open_tags[n.tag] -= 1
            n = n.parent
        return n

    while at < end:
        m = _TOKEN.match(page, at) or _LOOSE.match(page, at)
        if m is None:
            node.children.append("<")
            at += 1
            continue
        at = m.end()
        if m[4]:
            node.children.append(m[4])
        elif m[2] is not None:
            tag = m[2].lower()
            if m[1]:
                if open_tags[tag]:
                    up = node
                    while up.tag != tag:
                        up = up.parent
                    node = back_to(up)
                continue
            if tag in ("html", "body"):
                continue
            for closed in CLOSES.get(tag, ()):
                if not open_tags[closed]:
                    continue
                up = node.near
                while up.parent is not None and up.tag not in BARRIER and up.tag != closed:
                    up = up.parent.near
                if up.tag == closed and up.parent is not None:
                    node = back_to(up)
            new = Node(tag, node)
            new.article = node.article or tag in ("article", "main")
            new.dropped, new.spared = _unwanted(tag, m[3], node.article)
            node.children.append(new)
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
                at = stop.end()
            elif tag not in VOID and not m[3].endswith("/"):
                node = new
                open_tags[tag] += 1
    return root


def _ordered(root: Node) -> list[tuple[Node, bool]]:
    """The elements that are not dropped, in page order, and whether they stand in a link."""
    stack, out = [(root, False)], []
    while stack:
        n, linked = stack.pop()
        linked = linked or n.tag == "a"
        out.append((n, linked))
        stack += [(c, linked) for c in reversed(n.children) if not isinstance(c, str) and not c.dropped]
    return out


def spare_wrappers(root: Node) -> None:
    """Elements dropped by class, id or as forms stay where they hold more than half of all paragraph points (of what may be text at all)."""
    stack, order = [root], []
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [c for c in n.children if not isinstance(c, str) and (not c.dropped or c.spared)]
    if not any(n.dropped for n in order):
        return
    points: dict[int, float] = {}
    for n in reversed(order):
        size = sum(len(c.strip()) for c in n.children if isinstance(c, str))
        inner = sum(points.get(id(c), 0.0) for c in n.children if not isinstance(c, str))
        points[id(n)] = inner + (1 + size / 100 if n.tag in PARAGRAPH and size >= 20 else 0.0)
    for n in order:
        if n.dropped and 2 * points[id(n)] > points[id(root)]:
            n.dropped = False


def _is_paragraph(n: Node) -> bool:
    return n.tag in PARAGRAPH or n.tag in ("div", "section", "article", "li") and not any(not isinstance(c, str) and c.tag not in INLINE and c.tag != "br" for c in n.children)


def score(root: Node) -> list[Node]:
    """Lengths, linked lengths and scores of all elements that are not dropped, from the leaves up, each looked at once."""
    order = _ordered(root)
    for n, linked in reversed(order):
        for c in n.children:
            if isinstance(c, str):
                size = len("".join(c.split()))
                n.length += size
                n.linked += size if linked else 0
                n.commas += c.count(",")
            elif not c.dropped:
                n.length += c.length
                n.linked += c.linked
                n.commas += c.commas
                n.score += c.score / 2
                if c.length >= 20 and _is_paragraph(c):
                    n.score += 1 + c.commas + min(c.length / 100, 3)
    return [n for n, _ in order]


def _density(n: Node) -> float:
    return n.linked / n.length if n.length else 0.0


def _decoded(parts: list, left_out) -> str:
    """The text of text and elements side by side, with a space at each block's edge."""
    out: list[str] = []
    stack = parts[::-1]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif not n.dropped and not left_out(n):
            if n.tag not in INLINE:
                out.append(" ")
                stack.append(" ")
            stack += reversed(n.children)
    return " ".join(html.unescape("".join(out)).split())


def _raw(node: Node, prune: bool = False) -> str:
    """Text below an element, decoded, with a space at each block's edge; prune: without what is mostly links."""
    return _decoded([node], lambda n: prune and n is not node and n.tag in LISTED and n.length > 0 and _density(n) > 0.6)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    spare_wrappers(root)
    elements = score(root)
    best = max((n for n in elements if n.score), key=lambda n: n.score * (1 - _density(n)), default=None)
    if best is None or best.parent is None:
        best = next((n for n in elements if n.tag in ("article", "main") and n.length), best or root)
    up = best
    while up is not None:
        if up.tag == "article":
            best = up
        up = up.parent
    if best.tag == "article":
        return _raw(best)
    if best.parent is None:
        return _raw(best, True)
    least = 0.2 * best.score * (1 - _density(best))
    # Blocks in page order, and whether each stays for itself; a container between two that stay, stays, too.
    blocks: list[tuple[str, bool]] = []
    line: list = []

    def end() -> None:
        """Text and inline elements side by side are one block."""
        if own := _decoded(line, lambda n: False):
            blocks.append((own, True))
        line.clear()

    for s in best.parent.children:
        if isinstance(s, str) or s.tag in INLINE and not s.dropped and s.tag != "a":
            line.append(s)
            continue
        if s.dropped or s.tag == "a":
            continue
        end()
        few = _density(s) <= 0.5
        stays = s is best or s.tag in TEXTUAL or s.tag in ("ul", "ol", "dl", "table", "section") and few or s.score and s.score * (1 - _density(s)) >= least
        if (stays or few and s.tag in ("div", "main", "article")) and (own := _raw(s, True)):
            blocks.append((own, bool(stays or _is_prose(s) and own[-1] in ".!?")))
    end()
    at = [k for k, (_, stays) in enumerate(blocks) if stays]
    return " ".join(own for own, _ in blocks[at[0] : at[-1] + 1]) if at else ""


def _is_prose(n: Node) -> bool:
    """Whether an element has paragraphs and no other elements."""
    own = [c for c in n.children if not isinstance(c, str) and not c.dropped]
    return bool(own) and all(c.tag == "p" for c in own)


def extract(pages: DataFrame) -> DataFrame:
    """pages' columns with `text` added (html kept); no shuffle."""
    names = pages.columns
    at = names.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in rows_at_once(batch, at)):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([main_text(h) for h in part.column(at).to_pylist()], pa.string())], [*names, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return arrow_map(pages, run, f"{kinds}, text string")


def digest(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    out = extract(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
