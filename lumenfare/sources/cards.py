"""Offers in rendered pages: price leaves, the repeated element around them, and its name and price selectors.

The idea is that a list of rooms repeats one element, each instance holding one price and a name of its own. Every
element that holds exactly one price leaf votes for its signature (tag and classes); the signature whose instances are
most, most distinct in name and shortest wins.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import payloads
from ..functions import parsing

_PRICE = re.compile(r"(?:₹|Rs\.?|INR|\$|€|£)\s?\d[\d,.]*\d")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CARDS = "card_selector string, name_selector string, price_selector string, n_cards int, cards array<struct<name: string, text: string>>"
_CARDS = pa.struct([("card_selector", pa.string()), ("name_selector", pa.string()), ("price_selector", pa.string()), ("n_cards", pa.int32()), ("cards", pa.list_(pa.struct([("name", pa.string()), ("text", pa.string())])))])


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = [{"sig": "html", "up": -1, "text": []}]
        self.open = [0]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        classes = " ".join(v or "" for k, v in attrs if k == "class").split()
        self.nodes.append({"sig": ".".join([tag, *classes]), "up": self.open[-1], "text": []})
        if tag not in _VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[k]]["sig"].split(".")[0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.nodes[self.open[-1]]["text"].append(data.strip())


#: Plain tags, as most pages that repeat cards are made of; whatever else a page holds goes through the parser.
_PLAIN = re.compile(r'(</?[a-z][a-z0-9]*(?: class="[\w -]*")?>)')
_RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp plaintext".split())
_LETTERS = re.compile(r"[A-Za-z].*[A-Za-z]")
#: Nodes of a page whose structure is remembered, at most, and how many structures are.
_REMEMBERED_NODES, _REMEMBERED = 512, 1024


def _tags(tags: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[int, ...], tuple[int, ...]] | None:
    """Signatures, parents, and the node of each text between these tags; None where the parser must look."""
    tree, slots = _Tree(), [0]
    for tag in tags:
        name, _, rest = tag[1:-1].strip("/").partition(" ")
        if name in _RAW:
            return None
        if tag[1] == "/":
            tree.handle_endtag(name)
        else:
            tree.handle_starttag(name, [("class", rest[7:-1])] if rest else [])
        slots.append(tree.open[-1])
    return tuple(n["sig"] for n in tree.nodes), tuple(n["up"] for n in tree.nodes), tuple(slots)


def _groups(sigs: tuple[str, ...], ups: tuple[int, ...], prices: tuple[int, ...], lettered: tuple[int, ...]) -> list[tuple]:
    """(signature, price's signature, cards with the nodes in each, names' signatures with each card's node) of all repeated elements; texts play no part."""
    below: dict[int, list[int]] = {}
    for p in prices:
        k = ups[p]
        while k > 0:
            below.setdefault(k, []).append(p)
            k = ups[k]
    inside: dict[int, list[int]] = {}
    for k in range(len(sigs)):
        up = k
        while up > 0:
            inside.setdefault(up, []).append(k)
            up = ups[up]
    groups: dict[str, list[tuple[int, int]]] = {}
    for k, own in below.items():
        if len(own) == 1:
            groups.setdefault(sigs[k], []).append((k, own[0]))
    named, out = set(lettered), []
    for sig, cards in groups.items():
        if len(cards) < 2:
            continue
        price_sig = sigs[cards[0][1]]
        cards = [c for c in cards if sigs[c[1]] == price_sig]
        names: dict[str, dict[int, int]] = {}
        for k, p in cards:
            for x in inside[k]:
                if x != p and x in named and sigs[x] != price_sig:
                    names.setdefault(sigs[x], {}).setdefault(k, x)
        full = {s: [t[k] for k, _ in cards] for s, t in names.items() if len(t) == len(cards)}
        if full:
            out.append((sig, price_sig, [inside[k] for k, _ in cards], full))
    return out


_known_tags, _known_groups = lru_cache(_REMEMBERED)(_tags), lru_cache(_REMEMBERED)(_groups)


def _read(page: str) -> tuple[tuple[str, ...], tuple[int, ...], list[str]]:
    """Signatures, parents and own texts of a page's nodes."""
    if "&" not in page:
        parts = _PLAIN.split(page)
        tags = tuple(parts[1::2])
        if page.count("<") == len(tags) and (known := (_known_tags if len(tags) <= _REMEMBERED_NODES else _tags)(tags)):
            sigs, ups, slots = known
            texts = [""] * len(sigs)
            for slot, text in zip(slots, parts[::2]):
                if text := text.strip():
                    texts[slot] = f"{texts[slot]} {text}" if texts[slot] else text
            return sigs, ups, texts
    tree = _Tree()
    tree.feed(page)
    return tuple(n["sig"] for n in tree.nodes), tuple(n["up"] for n in tree.nodes), [" ".join(n["text"]) for n in tree.nodes]


def find_cards(page: str | None) -> dict | None:
    """The page's room cards, or None: selectors, and each card's name and text."""
    sigs, ups, texts = _read(page or "")
    prices = tuple(k for k, t in enumerate(texts) if t and _PRICE.search(t))
    lettered = tuple(k for k, t in enumerate(texts) if t and _LETTERS.search(t))
    best = None
    for sig, price_sig, cards, full in (_known_groups if len(sigs) <= _REMEMBERED_NODES else _groups)(sigs, ups, prices, lettered):
        own = {s: [texts[x] for x in nodes] for s, nodes in full.items()}
        name_sig = max(own, key=lambda s: (len(set(own[s])), -sum(map(len, own[s]))))
        whole = [" ".join(texts[x] for x in nodes).strip() for nodes in cards]
        rank = (len(cards), len(set(own[name_sig])), -sum(map(len, whole)))
        if best is None or rank > best[0]:
            best = (rank, {"card_selector": sig, "name_selector": name_sig, "price_selector": price_sig, "n_cards": len(cards), "cards": [{"name": n, "text": t} for n, t in zip(own[name_sig], whole)]})
    return best[1] if best else None


def room_cards(html: Column) -> Column:
    """struct of CARDS for each page, null where it has none."""

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([find_cards(p) for p in pages.to_pylist()], _CARDS)

    return F.arrow_udf(run, CARDS)(html)


def offer_from_card(card: Column) -> Column:
    """An offer from a card's name and text: price, tax basis, sold out; a card with neither price nor such words is an error."""
    text = card["text"]
    price = parsing.parse_price(F.nullif(F.regexp_extract(text, _PRICE.pattern, 0), F.lit("")))
    basis, gone = parsing.tax_basis(text), parsing.card_looks_sold_out(text)
    value = F.when(~gone, price["value"])
    return F.struct(
        card["name"].alias("raw_room_name"), F.when(basis.isNull() | (basis == "inclusive"), value).alias("price_inclusive"), F.when(basis == "exclusive", value).alias("price_exclusive"),
        parsing.detect_currency(text).alias("currency"), (~gone).alias("is_available"), parsing.rooms_left(text).alias("rooms_left"), F.when(~gone, price["error"]).alias("error"),
    )


payloads.register("rendered_page")(lambda pages: pages.select("page_id", F.explode(room_cards(F.col("html"))["cards"]).alias("card")).select("page_id", offer_from_card(F.col("card")).alias("o")).select("page_id", "o.*"))
