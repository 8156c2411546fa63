"""Discovery: where in unknown payloads the offers are. Arrays of objects are listed, flattened, scored and checked against the page."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship

# What a path's last part holds (first hit is best), what is never the price, words of room names, currency marks.
NAME_HINTS = ("roomname", "room_name", "displayname", "display_name", "roomtype", "room_type", "title", "name", "label", "roomtitle", "category")
PRICE_HINTS = ("sellrate", "sellprice", "netprice", "finalprice", "discountedprice", "price", "rate", "totalrate", "amount", "total", "nightlyrate", "perNight")
PRICE_BLOCKLIST = (
    "originalprice", "original_rate", "rackrate", "strikeprice", "oldprice", "mrp", "tax", "taxes", "gst", "deposit", "discountamount", "saving", "extraadult", "extrachild", "childprice", "id", "roomid", "hotelcode", "pincode", "phone", "rating", "reviews", "distance",
)
AVAILABLE_HINTS = ("isavailable", "available", "isactive", "instock", "bookable")
COUNT_HINTS = ("availablerooms", "available_rooms", "roomsleft", "rooms_left", "allocation", "inventory", "totalcount", "quantity", "stock")
DATED_SEGMENT = r"(^|\.)\d{4}-\d{2}-\d{2}(\.|$)|(^|\.)\d{8}(\.|$)"
NAME_LIKE = r"^[A-Za-z][\w\s\-/&'(),.+]{2,79}$"
ROOM_WORDS = r"(?i)\b(room|suite|deluxe|standard|superior|premium|executive|cottage|villa|studio|tent|dorm|family|double|twin|triple|single|apartment|bed|queen|king|balcony|view|ac|non\s*ac)\b"
MARKED_PRICE = r"(?:₹|Rs\.?|INR|\$|€|£)[^0-9]{0,3}([0-9][0-9,]{2,}(?:\.[0-9]{1,2})?)"
LEAST_PRICE, MOST_PRICE = 100, 500000
#: Depth of arrays and of an object's leaves; elements looked into; objects and values sampled.
MAX_DEPTH, LEAF_DEPTH, SAMPLE, OBJECTS, VALUES = 6, 3, 3, 12, 8


def arrays_of_objects(payload: str | None) -> Iterator[tuple[str, list]]:
    """Every list that begins with an object in a payload, with its dotted path."""
    try:
        top = json.loads(payload or "null")
    except ValueError:
        return
    stack = [("", top, 0)]
    while stack:
        path, node, depth = stack.pop()
        if depth > MAX_DEPTH:
            continue
        if isinstance(node, list):
            if node and isinstance(node[0], dict):
                yield path, node
            stack += [(f"{path}.{i}" if path else str(i), x, depth + 1) for i, x in reversed(list(enumerate(node[:SAMPLE])))]
        elif isinstance(node, dict):
            stack += [(f"{path}.{k}" if path else k, v, depth + 1) for k, v in reversed(list(node.items()))]


def leaves_of(node: dict) -> Iterator[tuple[str, str | int | float | None]]:
    """An object's leaves by dotted path, objects within objects up to LEAF_DEPTH, lists of objects by their first; true and false have no value."""
    stack = [("", node, 0)]
    while stack:
        path, x, depth = stack.pop()
        if depth > LEAF_DEPTH:
            continue
        for k, v in x.items():
            leaf = f"{path}.{k}" if path else k
            if isinstance(v, dict):
                stack.append((leaf, v, depth + 1))
            elif isinstance(v, list) and v and isinstance(v[0], dict):
                stack.append((f"{leaf}.0", v[0], depth + 1))
            else:
                yield leaf, None if isinstance(v, (bool, list)) else v


#: The patterns as Java reads them: classes are ASCII, word bounds are not, and an end may stand before a line's end.
_END = r"(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z"
_DATED, _NAME = (re.compile(x.replace("$", _END), re.ASCII) for x in (DATED_SEGMENT, NAME_LIKE))
_ROOM, _SPACES = re.compile(ROOM_WORDS.removeprefix("(?i)")), re.compile(r"\s+", re.ASCII)
_NUMBER, _MARKED = re.compile(r"[0-9][0-9,]*(?:\.[0-9]+)?"), re.compile(MARKED_PRICE)
_DECIMAL = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d{1,9})?")
_BELOW = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
_BLANK, _PLACES = "".join(map(chr, range(33))), Decimal("1e-10")


def hint_rank(path: str, hints: tuple[str, ...]) -> int | None:
    """Place of the first hint that the path's last part contains (neither has - or _), or None."""
    leaf = re.sub("[_-]", "", path.rsplit(".", 1)[-1].lower())
    return next((k for k, h in enumerate(hints) if h.replace("_", "") in leaf), None)


def blocked(path: str) -> bool:
    """Whether a field is never the price, whatever it holds."""
    leaf = path.rsplit(".", 1)[-1].lower().replace("_", "")
    return any(b.replace("_", "") in leaf for b in PRICE_BLOCKLIST)


@lru_cache(maxsize=4096)
def roles(leaf: str) -> tuple[int, int | None, int | None, int | None] | None:
    """What a field may be by its path: its ranks as a name and, if it can be one, as a price, as availability and as what is left; None for a field of one day."""
    if _DATED.search(leaf):
        return None
    named = hint_rank(leaf, NAME_HINTS)
    return 50 if named is None else named, None if blocked(leaf) else hint_rank(leaf, PRICE_HINTS), hint_rank(leaf, AVAILABLE_HINTS), hint_rank(leaf, COUNT_HINTS)


def plausible_price(value: str | int | float) -> Decimal | None:
    """A value as a price of ten decimal places, if it is a plausible one."""
    if isinstance(value, str):
        bare = value.replace(",", "").replace("₹", "").strip(_BLANK)
        if not _DECIMAL.fullmatch(bare):
            return None
        value = Decimal(bare)
    # Anything else is far off, and need not be rounded.
    if not 99 < value < MOST_PRICE + 1:
        return None
    number = Decimal(str(value)).quantize(_PLACES, ROUND_HALF_UP)
    return number if LEAST_PRICE <= number <= MOST_PRICE else None


class Field:
    """What the objects of one array hold under one path, as far as it can take a part."""

    __slots__ = ("may", "present", "named", "distinct", "roomy", "prices", "names")

    def __init__(self, leaf: str):
        self.may, self.present, self.named, self.distinct, self.roomy, self.prices, self.names = roles(leaf), 0, None, set(), 0, [], set()

    def put(self, k: int, value: str | int | float) -> None:
        """One value; of objects from OBJECTS on only a text's, which counts among the names."""
        if isinstance(value, str):
            bare = value.strip(" ")
            if bare:
                self.names.add(bare)
            if k >= OBJECTS:
                return
            if bare:
                self.present += 1
                self.distinct.add(bare.lower())
                self.roomy += _ROOM.search(value.lower() if value.isascii() else value.translate(_BELOW)) is not None
            if self.named is not False:
                self.named = _NAME.match(_SPACES.sub(" ", bare)) is not None
        elif k >= OBJECTS:
            return
        else:
            self.named = False
        if self.may[1] is not None:
            price = plausible_price(value)
            if price is not None:
                self.prices.append((k, price))


def fields_of(payloads: list[str]) -> dict[tuple[str, int, int], dict[str, Field]]:
    """The fields of a page's arrays by (path, number of rows, sampled objects); each payload is parsed once."""
    out: dict[tuple[str, int, int], dict[str, Field]] = {}
    for payload in payloads:
        for path, rows in arrays_of_objects(payload):
            sample = [x for x in rows[:OBJECTS] if isinstance(x, dict)]
            fields = out.setdefault((path, len(rows), len(sample)), {})
            for k, x in enumerate(sample + [x for x in rows[OBJECTS:] if isinstance(x, dict)] if len(rows) > OBJECTS else sample):
                late = k >= len(sample)
                for leaf, value in leaves_of(x):
                    if late and not isinstance(value, str):
                        continue
                    f = fields.get(leaf)
                    if f is None:
                        f = fields[leaf] = Field(leaf)
                    if f.may is not None and value is not None:
                        f.put(OBJECTS if late else k, value)
    return out


def numbers_of(text: str | None) -> dict[str, bool]:
    """A page's numbers, whole and without fraction, and whether a currency stands beside them."""
    out: dict[str, bool] = {}
    for pattern, marked in ((_NUMBER, False), (_MARKED, True)):
        for n in pattern.findall(text or ""):
            bare = n.replace(",", "")
            whole = bare.partition(".")[0]
            out.setdefault(whole, False)
            exact = bare.rstrip("0").rstrip(".") if whole != bare else bare
            out[exact] = out.get(exact, False) or marked
    return out


def best_arrays(payloads: list[str], text: str | None, keep: int) -> list[tuple]:
    """A page's candidates, best first, as `candidates` gives them."""
    names, prices, rest = {}, {}, {}
    for (path, n_rows, sampled), fields in fields_of(payloads).items():
        half, at = max(1, sampled // 2), (path, n_rows)
        for leaf, f in fields.items():
            may = f.may
            if may is None:
                continue
            if f.named and f.present >= half and (f.present <= 2 or len(f.distinct) >= max(2, f.present // 2)):
                names.setdefault(at, []).append((-f.roomy, may[0], leaf, len(f.names)))
            if may[1] is not None and len(f.prices) >= half:
                prices.setdefault(at, []).append((may[1], leaf, [p for _, p in sorted(f.prices)[:VALUES]]))
            for i in (2, 3):
                if may[i] is not None:
                    rest.setdefault((at, i), []).append((may[i], leaf))
    best = [(at, min(names[at]), min(prices[at])) for at in names if at in prices]
    if not best:
        return []
    # A path's sampled prices meet the page's numbers.
    index, hits = numbers_of(text), {}
    for (path, _), _, (_, _, amounts) in best:
        for k, amount in enumerate(amounts):
            exact = f"{amount:f}".rstrip("0").rstrip(".")
            for form in (exact, str(int(amount))):
                if form in index:
                    own = hits.setdefault(path, {})
                    own[k] = own.get(k, False) or index[form]
    out = []
    for (path, n_rows), (less, _, name, n_names), (rank, price, amounts) in best:
        own = hits.get(path, {})
        marked, verified = sum(own.values()), len(own) * 2 >= len(amounts)
        available, left = (min(rest[(path, n_rows), i])[1] if ((path, n_rows), i) in rest else None for i in (2, 3))
        score = -3.0 * less + (10 - min(rank, 10)) + min(n_rows, 12) * 0.4 + (0.0 if available is None and left is None else 4.0) + (25.0 if verified else 0.0)
        out.append((path, name, price, available, left, n_rows, n_names, len(amounts), len(own), marked, float(Decimal(repr(score)).quantize(Decimal("0.01"), ROUND_HALF_UP)), verified, verified and marked > 0))
    out.sort(key=lambda x: (-x[10], x[0]))
    return [(*x, place) for place, x in enumerate(out[:keep], 1)]


def price_digits(number: Column) -> Column:
    """A price's digits as two spellings of it share them: no separators, no zeros at the end of a fraction."""
    bare = F.regexp_replace(number, "[,\\s]", "")
    return F.when(F.contains(bare, F.lit(".")), F.regexp_replace(bare, r"\.?0*$", "")).otherwise(bare)


def page_numbers(pages: DataFrame) -> DataFrame:
    """(page_id, number, marked): the index of each page's numbers, whole and without fraction; marked where a currency stands beside it."""
    every = lambda pattern, group: F.regexp_extract_all("page_text", F.lit(pattern), F.lit(group))
    plain = pages.select("page_id", F.explode(every(r"[0-9][0-9,]*(?:\.[0-9]+)?", 0)).alias("n"), F.lit(False).alias("marked"))
    both = plain.union(pages.select("page_id", F.explode(every(MARKED_PRICE, 1)).alias("n"), F.lit(True)))
    forms = F.inline(F.array(F.struct(price_digits(F.col("n")).alias("number"), F.col("marked").alias("marked")), F.struct(F.substring_index(F.regexp_replace("n", ",", ""), ".", 1).alias("number"), F.lit(False).alias("marked"))))
    return both.select("page_id", forms).groupBy("page_id", "number").agg(F.bool_or("marked").alias("marked"))


def candidates(payloads: DataFrame, keep: int = 4) -> DataFrame:
    """(page_id, path, name_field, price_field, available_field, left_field, n_rows, n_names, n_prices, n_matched, n_marked, score, verified, strong, place): best arrays of each page.

    payloads: page_id, payload, page_text (a page's payloads share one). Fields are told by the first twelve objects (n_names counts the names of all): a name
    is text like a room's name, mostly there and mostly distinct; a price a plausible number in half of them, under a
    hinting name that is not blocked; paths through a date hold for one day only and never count. Up to eight sampled prices
    are looked up in the page's index of numbers (whole numbers, never parts of longer ones): half of them verify a
    candidate, and one with a currency beside it does so strongly. A page is judged in one go: its payloads are parsed and its
    text is read once each, and a task holds one page's.
    """
    kind = payloads.schema["page_id"].dataType.simpleString()
    schema = "path string, name_field string, price_field string, available_field string, left_field string, n_rows int, n_names bigint, n_prices bigint, n_matched bigint, n_marked bigint, score double, verified boolean, strong boolean, place int"
    arrow = pa.schema([*to_arrow_schema(payloads.select("page_id").schema), *to_arrow_schema(StructType.fromDDL(schema))])

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple | None]:
        """Each page whole, and None after each batch."""
        now, held, text = None, [], None
        for batch in batches:
            for lo in range(0, len(batch), 256):
                for page, payload, about in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns)):
                    if held and page != now:
                        yield now, held, text
                        held, text = [], None
                    now = page
                    held.append(payload)
                    # A null page_id is no page's, so that nothing is found in its text.
                    if page is not None and about is not None and (text is None or about > text):
                        text = about
                yield None
        if held:
            yield now, held, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)), arrow)], schema=arrow)
            out.clear()
            return batch

        for page in pages(batches):
            if page is not None:
                out += [(page[0], *x) for x in best_arrays(page[1], page[2], keep)]
            elif out:
                yield made()
        if out:
            yield made()

    ship(payloads.sparkSession)
    # The window's only use is that a page's rows come together, without a shuffle where they are already dealt by page.
    together = payloads.where("payload is not null").withColumn("_turn", F.row_number().over(Window.partitionBy("page_id").orderBy("page_id")))
    return together.where("_turn > 0").select("page_id", "payload", "page_text").mapInArrow(run, f"page_id {kind}, {schema}")


def unlearnable(text: Column) -> Column:
    """Why a page can teach nothing, first rule wins: no text, no price with a currency, sold out; null where it can."""
    from ..functions import parsing

    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(flat == "", "no_text").when(~flat.rlike(MARKED_PRICE), "no_marked_price").when(parsing.looks_sold_out(flat), "sold_out")


def may_repair(enabled: Column, attempts: Column, last_try: Column, now: Column, most: int = 3, cool_hours: int = 24) -> Column:
    """struct(allowed, reason) for a source that wants its configuration learnt anew."""
    reason = F.when(~F.coalesce(enabled, F.lit(False)), "disabled").when(attempts >= most, "attempts_used").when((F.unix_seconds(now) - F.unix_seconds(last_try)) < cool_hours * 3600, "cooling_down")
    return F.struct(reason.isNull().alias("allowed"), reason.alias("reason"))


def claim_repair(state: Column, now: Column) -> Column:
    """struct(attempts, last_attempt_at, last_outcome): an attempt is spent as it starts, whatever becomes of it."""
    return F.struct((F.coalesce(state["attempts"], F.lit(0)) + 1).alias("attempts"), now.alias("last_attempt_at"), F.lit("started").alias("last_outcome"))


def settle_repair(state: Column, now: Column, outcome: Column, reset: Column, refund: Column) -> Column:
    """How a claimed attempt ended: a refund gives it back (never below none), a reset clears the count; a refund goes first."""
    spent = F.coalesce(state["attempts"], F.lit(0))
    return F.struct(F.when(refund, F.greatest(spent - 1, F.lit(0))).when(reset, 0).otherwise(spent).alias("attempts"), now.alias("last_attempt_at"), outcome.alias("last_outcome"))


#: Parts of a source's configuration that discovery owns.
OWNED = ("kind", "rooms_path", "field_map", "selectors", "json_fragment", "discovery_note")


def merge_config(current: Column, found: Column) -> Column:
    """Maps: what discovery owns comes from the finding, everything else stays."""
    return F.map_concat(F.map_filter(current, lambda k, _: ~k.isin(*OWNED)), F.map_filter(found, lambda k, _: k.isin(*OWNED)))


def really_changed(before: Column, after: Column) -> Column:
    """Whether two configurations differ in more than the note."""
    bare = lambda m: F.array_sort(F.map_entries(F.map_filter(m, lambda k, _: k != "discovery_note")))
    return ~bare(before).eqNullSafe(bare(after))


def names_to_retire(collapsed: Column, discovered: Column) -> Column:
    return F.array_except(collapsed, discovered)
