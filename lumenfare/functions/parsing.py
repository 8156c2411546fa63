"""Text to typed values: prices, currencies, availability, tax basis. All built-in expressions; errors are values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plausible prices, currency marks in order of search, and the phrases that decide availability and tax.
MIN_PRICE, MAX_PRICE = "100", "500000"
CURRENCIES = (("₹", "INR"), ("rs.", "INR"), ("rs", "INR"), ("inr", "INR"), ("$", "USD"), ("usd", "USD"), ("€", "EUR"), ("£", "GBP"))
SOLD_OUT = (
    "sold out", "soldout", "no rooms available", "no rooms left", "no rooms found", "no room available", "rooms are not available", "not available for",
    "no availability", "not currently available", "no longer available", "fully booked", "houseful", "no vacancies",
)
CARD_SOLD_OUT = (*SOLD_OUT, "not available", "unavailable", "not bookable", "no rooms")
TAX_EXCLUSIVE = (
    "exclusive of tax", "excluding tax", "excluding taxes", "excl. tax", "excl tax", "before tax", "plus tax", "plus taxes", "+ tax", "+ taxes",
    "tax extra", "taxes extra", "extra taxes",
)
TAX_INCLUSIVE = ("inclusive of tax", "including tax", "including taxes", "incl. tax", "incl tax", "tax included", "taxes included", "all inclusive", "inclusive of all taxes")
URGENCY = ("left", "remaining", "last", "only")
NUMBER = r"[-+]?\d[\d,.\u00A0\u202F ]*\d|\d"


def let(x: Column, body) -> Column:
    """body(x) with x computed once: keeps generated code small where a value is used many times."""
    return F.transform(F.array(x), body)[0]


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    """Whether any mark occurs; null text has none."""
    found = F.lit(False)
    for m in marks:
        found = found | F.contains(text, F.lit(m))
    return F.coalesce(found, F.lit(False))


def first_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, NUMBER, 0), F.lit(""))


def normal_number(raw: Column) -> Column:
    """Grouping removed, decimal point as '.': Indian, European and plain notations.

    With both separators the later one is decimal; a lone comma is decimal before exactly two last digits; lone dots are
    grouping when they part groups of three.
    """
    return let(F.regexp_replace(raw, r"[\u00A0\u202F ]", ""), _plain)


def _plain(n: Column) -> Column:
    comma, dot = F.contains(n, F.lit(",")), F.contains(n, F.lit("."))
    last_comma, last_dot = F.length(n) - F.instr(F.reverse(n), ","), F.length(n) - F.instr(F.reverse(n), ".")
    return (
        # Plain numbers, most by far, need none of the rest.
        F.when(n.rlike(r"^[-+]?\d+(\.\d{1,2})?$"), n)
        .when(comma & dot & (last_comma > last_dot), F.regexp_replace(F.regexp_replace(n, r"\.", ""), ",", "."))
        .when(comma & dot, F.regexp_replace(n, ",", ""))
        .when(comma, F.when(n.rlike(r"^[-+]?\d+,\d{2}$"), F.regexp_replace(n, ",", ".")).otherwise(F.regexp_replace(n, ",", "")))
        .when(dot & n.rlike(r"^[-+]?\d{1,3}(\.\d{3})+$"), F.regexp_replace(n, r"\.", ""))
        .otherwise(n)
    )


def parse_price(text: Column, least: str = MIN_PRICE, most: str = MAX_PRICE) -> Column:
    """struct(value decimal(12,2), error): the error is null, no_text, no_number, unparseable or out_of_range."""
    low, high = F.lit(least).cast("decimal(38,10)"), F.lit(most).cast("decimal(38,10)")
    blank = F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit("")) == ""

    def judge(x: Column) -> Column:
        value = x["value"]
        error = F.when(x["blank"], "no_text").when(x["raw"].isNull(), "no_number").when(value.isNull(), "unparseable").when((value < low) | (value > high), "out_of_range")
        return F.struct(F.when(error.isNull(), F.round(value, 2)).cast("decimal(12,2)").alias("value"), error.alias("error"))

    read = let(first_number(text), lambda raw: F.struct(raw.alias("raw"), normal_number(raw).try_cast("decimal(38,10)").alias("value"), blank.alias("blank")))
    return let(read, judge)


def bare_number(text: Column) -> Column:
    """The first number without the spaces in it."""
    return F.regexp_replace(first_number(text), r"[\u00A0\u202F ]", "")


def price_of_bare(number: Column) -> Column:
    """A bare number's value from 0 on; null on any error. For plans that hold `bare_number` as a column of its own."""
    value = _plain(number).try_cast("decimal(38,10)")
    return F.when((value >= 0) & (value <= F.lit(MAX_PRICE).cast("decimal(38,10)")), F.round(value, 2)).cast("decimal(12,2)")


def price_or_null(text: Column) -> Column:
    """The value alone, from 0 on; null on any error."""
    return let(bare_number(text), price_of_bare)


def detect_currency(text: Column, default: str = "INR") -> Column:
    """The first mark, in order, that occurs anywhere in the text."""
    low, out = F.lower(text), None
    for mark, code in CURRENCIES:
        hit = F.contains(low, F.lit(mark))
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise(default)


def looks_sold_out(text: Column) -> Column:
    return _any(_squeezed(text), SOLD_OUT)


def card_looks_sold_out(text: Column) -> Column:
    """A card's wider list counts only where the card shows no price."""
    return _any(_squeezed(text), CARD_SOLD_OUT) & parse_price(text)["error"].isNotNull()


def rooms_left(text: Column) -> Column:
    """A number of one to three digits beside a word of urgency, from 1 to 100."""
    n = F.nullif(F.regexp_extract(text, r"\b(\d{1,3})\b", 1), F.lit("")).cast("int")
    return F.when(_any(F.lower(text), URGENCY) & n.between(1, 100), n)


def tax_basis(text: Column) -> Column:
    """exclusive, inclusive, or null where the text says neither or both."""
    t = _squeezed(text)
    ex, inc = _any(t, TAX_EXCLUSIVE), _any(t, TAX_INCLUSIVE)
    return F.when(ex & ~inc, "exclusive").when(inc & ~ex, "inclusive")


def positive(x: Column) -> Column:
    """A decimal above zero, or null."""
    d = x.cast("string").try_cast("decimal(12,2)")
    return F.when(d > 0, d)


def iso_date(x: Column) -> Column:
    """A date, or null where the text is none."""
    return F.when(F.trim(x).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.trim(x).try_cast("date"))


def blank_as_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def prettify(slug: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(slug, "[-_]+", " ")))


def truthy(x: Column) -> Column:
    """Availability of a JSON scalar given as text: known refusals are false, null is null, whatever else is said is true."""
    t = F.lower(F.trim(x))
    return F.when(x.isNull(), F.lit(None).cast("boolean")).when(t.isin("false", "0", "no", "n", "", "sold_out", "soldout", "unavailable", "none", "null"), False).otherwise(True)


def refundable(text: Column) -> Column:
    """Three states from text: refusals are tried before promises."""
    t = F.lower(text)
    return F.when(_any(t, ("non-refundable", "non refundable", "nonrefundable", "no refund")), False).when(_any(t, ("refundable", "free cancellation")), True)
