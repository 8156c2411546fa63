"""Text for people: money, percents, dates, ages, escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYMBOLS = {"INR": "₹", "USD": "$", "EUR": "€", "GBP": "£"}


def money(amount: Column, currency: Column) -> Column:
    """Indian grouping for INR, thousands for others; hundredths (half up) only where there are some; a dash for null."""
    a = F.round(amount.cast("decimal(38,4)"), 2)
    whole = F.regexp_extract(F.abs(a).cast("string"), r"^(\d+)", 1)
    part = F.regexp_extract(F.abs(a).cast("string"), r"\.(\d\d)", 1)
    code = F.upper(currency)
    head = F.substring(whole, F.lit(1), F.greatest(F.length(whole) - 3, F.lit(0)))
    indian = F.when(F.length(whole) > 3, F.concat(F.regexp_replace(head, r"(\d)(?=(\d\d)+$)", "$1,"), F.lit(","), F.substring(whole, F.length(whole) - 2, F.lit(3)))).otherwise(whole)
    grouped = F.when(code == "INR", indian).otherwise(F.regexp_replace(whole, r"(\d)(?=(\d{3})+$)", "$1,"))
    symbol = F.lit(None).cast("string")
    for known, s in SYMBOLS.items():
        symbol = F.when(code == known, s).otherwise(symbol)
    return F.coalesce(F.concat(F.when(a < 0, "-").otherwise(""), F.coalesce(symbol, F.concat(code, F.lit(" "))), grouped, F.when(part.isin("", "00"), "").otherwise(F.concat(F.lit("."), part))), F.lit("—"))


def percent(x: Column) -> Column:
    """How far, whichever way; nothing for null."""
    return F.when(x.isNotNull(), F.concat(F.bround(F.abs(x.cast("decimal(20,4)")), 1).cast("decimal(20,1)").cast("string"), F.lit("%"))).otherwise("")


def pretty_date(d: Column) -> Column:
    return F.date_format(d, "dd MMM yyyy")


def stay(check_in: Column, check_out: Column) -> Column:
    return F.concat(pretty_date(check_in), F.lit(" → "), pretty_date(check_out))


def escape(x: Column) -> Column:
    """HTML escaping; the ampersand first."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _moved(line: Column, up: str, down: str) -> Column:
    """A priced move's amount and share, with its direction's sign."""
    return F.concat(F.when(line["direction"] == "increase", up).otherwise(down), money(F.abs(line["delta"]), line["currency"]), F.lit(" ("), percent(line["delta_pct"]), F.lit(")"))


def headline(line: Column) -> Column:
    """One change as a line. line: struct of room, direction, old_price, new_price, delta, delta_pct, currency, overnight. A sold-out room has no price and no percent."""
    new = money(line["new_price"], line["currency"])
    rises = line["direction"] == "increase"
    basis = F.when(F.coalesce(line["overnight"], F.lit(False)), " vs last night").otherwise("")
    word = F.when(rises, "Increase ").otherwise("Decrease ")
    moved = F.concat(F.when(rises, "▲ ").otherwise("▼ "), line["room"], F.lit(": "), money(line["old_price"], line["currency"]), F.lit(" → "), new, basis, F.lit("  ("), word, money(F.abs(line["delta"]), line["currency"]), F.lit(", "), percent(line["delta_pct"]), F.lit(")"))
    return F.when(line["direction"] == "became_unavailable", F.concat(F.lit("🚫 "), line["room"], F.lit(" — sold out"))).when(line["direction"] == "became_available", F.concat(F.lit("✅ "), line["room"], F.lit(" — available again at "), new)).otherwise(moved)


def _stay_of(line: Column) -> Column:
    return stay(line["check_in"], line["check_out"])


def digest_subject(hotel: Column, lines: Column) -> Column:
    """lines: an array of lines in order."""
    first = lines[0]
    about = F.when(first["direction"] == "became_unavailable", F.concat(first["room"], F.lit(" sold out"))).otherwise(F.concat(first["room"], F.lit(" "), money(first["new_price"], first["currency"])))
    return F.when(F.size(lines) == 1, F.concat(F.lit("Price change: "), hotel, F.lit(" — "), about)).otherwise(F.concat(F.size(lines).cast("string"), F.lit(" price changes: "), hotel))


def digest_body(hotel: Column, lines: Column, stamp: Column) -> Column:
    """The text of a message: its heading, two lines and a blank one for each change, and when it was checked."""
    head = F.when(F.size(lines) == 1, "🔔 Room Price Changed").otherwise(F.concat(F.lit("🔔 "), F.size(lines).cast("string"), F.lit(" Room Price Changes")))
    plan = lambda x: F.when(F.coalesce(x["meal_plan"], F.lit("")) != "", F.concat(F.lit("   Plan: "), x["meal_plan"])).otherwise("")
    each = F.transform(lines, lambda x: F.concat(headline(x), F.lit("\n   Stay: "), _stay_of(x), plan(x), F.lit("\n\n")))
    return F.concat(head, F.lit("\nHotel: "), hotel, F.lit("\n\n"), F.array_join(each, ""), F.lit("Checked: "), stamp)


def digest_rows(lines: Column) -> Column:
    """The table of a message in HTML: room, was, now, change and stay, all that comes from elsewhere escaped."""
    gone, back = "<b>Sold out</b>", "<b>Available again</b>"
    change = lambda x: F.when(x["direction"] == "became_unavailable", gone).when(x["direction"] == "became_available", back).otherwise(_moved(x, "+", "−"))
    now = lambda x: F.when(x["direction"] == "became_unavailable", "—").otherwise(money(x["new_price"], x["currency"]))
    row = lambda x: F.concat(*(c for v in (escape(x["room"]), money(x["old_price"], x["currency"]), now(x), change(x), escape(_stay_of(x))) for c in (F.lit("<td>"), v, F.lit("</td>"))))
    return F.concat(F.lit("<table><tr><th>Room</th><th>Was</th><th>Now</th><th>Change</th><th>Stay</th></tr>"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<tr>"), row(x), F.lit("</tr>"))), ""), F.lit("</table>"))


def template_values(hotel: Column, lines: Column, stamp: Column) -> Column:
    """A template message's seven values: hotel, room, old, new, change, stay, time; the first change stands for all."""
    first = lines[0]
    room = F.when(F.size(lines) == 1, first["room"]).otherwise(F.concat(first["room"], F.lit(" +"), (F.size(lines) - 1).cast("string"), F.lit(" more")))
    change = F.when(first["direction"] == "became_unavailable", "sold out").when(first["delta"].isNotNull(), _moved(first, "+", "-")).otherwise("now available")
    return F.array(hotel, room, money(first["old_price"], first["currency"]), money(first["new_price"], first["currency"]), change, _stay_of(first), stamp)
