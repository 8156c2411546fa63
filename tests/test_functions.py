"""Case tables of the scalar functions."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lumenfare.functions import dates, keys, mapping, matching, parsing, render
from lumenfare.operators import detector, discovery


def one(spark, col, **values):
    cols = [F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items()] or [F.lit(1).alias("_")]
    return spark.range(1).select(*cols).select(col.alias("v")).first()[0]


BASE = dict(hotel_id=1, source_id=2, room_type_id=3, check_in=dt.date(2026, 8, 20), check_out=dt.date(2026, 8, 21), adults=2, children=0, meal_plan="Room Only", refundable=True, currency="INR")


def key(spark, **changed):
    v = BASE | changed
    cols = {n: (F.lit(x) if x is not None else F.lit(None).cast("boolean" if n == "refundable" else "string")) for n, x in v.items()}
    return spark.range(1).select(keys.offer_key(**cols)).first()[0]


def test_offer_key(spark):
    base = key(spark)
    assert base == "72c19e46409a00b739c41fd174990298e6201c5a257c0165c4ea689ffdb86eb0"
    assert key(spark, meal_plan="  room   ONLY ") == base and key(spark, currency="inr") == base
    assert key(spark, meal_plan=None) == key(spark, meal_plan="")
    assert len({key(spark, refundable=x) for x in (None, True, False)}) == 3
    for name, x in dict(hotel_id=9, source_id=9, room_type_id=9, check_in=dt.date(2026, 8, 19), check_out=dt.date(2026, 8, 22), adults=3, children=1, meal_plan="Breakfast", currency="USD").items():
        assert key(spark, **{name: x}) != base


@pytest.mark.parametrize("text, price, error", [
    ("2500", 2500, None), ("2,500", 2500, None), ("₹2,500", 2500, None), ("Rs. 2,500", 2500, None), ("INR 2500", 2500, None), ("₹ 2,500.00", 2500, None), ("2,500.50", Decimal("2500.50"), None), ("₹1,23,456", 123456, None),
    ("₹2,50,000", 250000, None), ("2.500", 2500, None), ("From ₹3,299", 3299, None), ("3 200", 3200, None), ("", None, "no_text"), ("   ", None, "no_text"), (None, None, "no_text"), ("Sold Out", None, "no_number"), ("4.5", None, "out_of_range"), ("20% off", None, "out_of_range"), ("12", None, "out_of_range"), ("999999999", None, "out_of_range"),
])
def test_price(spark, text, price, error):
    got = one(spark, parsing.parse_price(F.col("t")), t=text)
    assert (got.value, got.error) == (price, error)


def test_other_parsing(spark):
    assert one(spark, parsing.price_or_null(F.col("t")), t="₹0") == 0 and one(spark, parsing.price_or_null(F.col("t")), t="not a price") is None
    for text, code in (("$5", "USD"), ("€5", "EUR"), ("£5", "GBP"), ("rs 5", "INR"), ("5", "INR")):
        assert one(spark, parsing.detect_currency(F.col("t")), t=text) == code
    assert one(spark, parsing.looks_sold_out(F.col("t")), t="Sorry,\n fully   BOOKED") and not one(spark, parsing.looks_sold_out(F.col("t")), t="No rooms selected yet")
    assert one(spark, parsing.card_looks_sold_out(F.col("t")), t="Not available") and not one(spark, parsing.card_looks_sold_out(F.col("t")), t="Breakfast not available, 2,500")
    for text, n in (("Only 2 rooms left!", 2), ("3", None), ("Only 500 rooms left", None), (None, None)):
        assert one(spark, parsing.rooms_left(F.col("t")), t=text) == n
    for text, basis in (("Exclusive of Tax", "exclusive"), ("incl. tax", "inclusive"), ("excl tax, incl tax", None), ("3200", None), (None, None)):
        assert one(spark, parsing.tax_basis(F.col("t")), t=text) == basis
    assert one(spark, parsing.iso_date(F.col("t")), t="2026-08-20") == dt.date(2026, 8, 20) and one(spark, parsing.iso_date(F.col("t")), t="soon") is None
    assert one(spark, parsing.truthy(F.col("t")), t="SOLD_OUT") is False and one(spark, parsing.truthy(F.col("t")), t="maybe") is True and one(spark, parsing.truthy(F.col("t")), t=None) is None
    assert one(spark, parsing.refundable(F.col("t")), t="Non-refundable") is False and one(spark, parsing.refundable(F.col("t")), t="Free cancellation") is True


PAYLOAD = '{"data":{"rooms":[{"name":"Deluxe Room","rates":[{"total":2500,"taxes":450,"board":"Room Only"}],"available":true,"roomsLeft":3,"refundable":true},{"name":"Suite","rates":[{"total":"₹8,900","taxes":null,"board":"Breakfast"}],"available":"SOLD_OUT"},{"rates":[]}]}}'
MAP = dict(room_name="name", price_inclusive="rates.0.total", taxes_fees="rates.0.taxes", meal_plan="rates.0.board", available="available", rooms_left="roomsLeft", refundable="refundable")


def test_json_mapping(spark):
    from lumenfare.sources import payloads

    got = payloads.adapter("http_json")(spark.createDataFrame([(1, PAYLOAD)], "run long, payload string"), "data.rooms", MAP).orderBy("ordinal").collect()
    a, b, c = got
    assert (a.raw_room_name, a.price_inclusive, a.price_exclusive, a.meal_plan, a.refundable, a.is_available, a.rooms_left, a.error) == ("Deluxe Room", 2500, 2050, "Room Only", True, True, 3, None)
    assert (b.raw_room_name, b.price_inclusive, b.is_available, b.error) == ("Suite", 8900, False, None) and c.error == "no_name"
    dig = lambda p, **k: one(spark, mapping.dig(F.col("p"), p, **k), p=PAYLOAD)
    assert dig("data.rooms.0.name").value == "Deluxe Room" and dig("").value == PAYLOAD and dig("data.x", required=True).error == "missing data.x" and dig("data.x", default="d").value == "d"
    assert dig("data.rooms.9.name").value is None and dig("data.rooms.1.rates.0.taxes", required=True) == (None, None)
    with pytest.raises(KeyError):
        payloads.adapter("nowhere")


def test_urls(spark):
    assert mapping.parameterised("https://x.example/book?checkin=2026-08-20&adults=2&k=v") == "https://x.example/book?checkin={check_in}&adults={adults}&k=v"
    assert mapping.parameterised("https://x.example/b?Arrival-Date=2026-08-20&roomConfig=2-0&pax=&occupancy=2&no_of_kids=1#top") == "https://x.example/b?Arrival-Date={check_in}&roomConfig={adults}-{children}&pax=&occupancy=2&no_of_kids={children}#top"
    assert mapping.templated("https://x.example/2026-08-20?to=x")[1] == {"path date": "2026-08-20 -> {check_in}", "to": "x -> {check_out}"} and mapping.templated(None) == (None, {})
    assert mapping.parameterised("https://x.example/2026-08-20/2026-08-21/a") == "https://x.example/{check_in}/{check_out}/a"
    assert one(spark, mapping.json_fragment(F.col("u")), u="https://x.example/api/v1/rates?x=1") == "v1/rates"
    assert one(spark, mapping.render_template(F.col("u"), {"check_in": F.lit("2026-08-20")}), u="a/{check_in}/{other}") == "a/2026-08-20/{other}"


def test_dates(spark):
    day = lambda s: F.lit(s).cast("date")
    assert one(spark, dates.next_weekend(day("2026-08-21")))[0] == dt.date(2026, 8, 28)
    assert [w.check_in.day for w in one(spark, dates.default_windows(day("2026-08-17")))] == [24, 31, 21]
    assert one(spark, dates.stay_window(F.lit("fixed"), day("2026-08-20"), day("2026-08-01"), day("2026-08-02"), F.lit(1), F.lit(1))).check_in is None
    assert one(spark, dates.stay_window(F.lit("rolling"), day("2026-08-20"), day("2026-08-01"), day("2026-08-02"), F.lit(2), F.lit(3))).check_out == dt.date(2026, 8, 25)
    assert [one(spark, dates.in_quiet_hours(F.lit(h * 3600), F.lit(22 * 3600), F.lit(7 * 3600))) for h in (21, 22, 3, 7)] == [False, True, True, False]
    got = one(spark, dates.release_time(F.lit("2026-08-20 18:00:00").cast("timestamp"), F.lit(7 * 3600), "Asia/Kolkata").cast("string"))
    assert got == "2026-08-21 01:30:00"
    assert [one(spark, dates.retry_delay(F.lit(k))) for k in range(4)] == [30, 120, 480, 480]
    assert one(spark, dates.month_of_partition(F.lit("observations_2026_08"))) == dt.date(2026, 8, 1)


def test_rendering(spark):
    money = lambda x: one(spark, render.money(F.lit(x).cast("decimal(12,2)"), F.lit("INR")))
    assert [money(x) for x in ("123456", "2500.5", "999", "-1234567", None)] == ["₹1,23,456", "₹2,500.50", "₹999", "-₹12,34,567", "—"]
    others = [one(spark, render.money(F.lit(x).cast("decimal(24,3)"), F.lit(c))) for x, c in (("1234567", "USD"), ("-1234567.005", "eur"), ("123456789012345678", "GBP"), ("999.5", "CHF"), ("123456789", "inr"))]
    assert others == ["$1,234,567", "-€1,234,567.01", "£123,456,789,012,345,678", "CHF 999.50", "₹12,34,56,789"]
    assert [one(spark, render.percent(F.lit(x).cast("decimal(9,2)"))) for x in ("-8", "2.25", "2.35", "0.04", None)] == ["8.0%", "2.2%", "2.4%", "0.0%", ""]
    assert one(spark, render.escape(F.lit("<a&b>"))) == "&lt;a&amp;b&gt;" and one(spark, render.stay(F.lit("2026-08-20").cast("date"), F.lit("2026-08-21").cast("date"))) == "20 Aug 2026 → 21 Aug 2026"


def _line(room, direction, old, new, delta=None, pct=None, overnight=False, plan=None):
    d = lambda x: None if x is None else Decimal(x)
    return (room, direction, d(old), d(new), d(delta), d(pct), "INR", overnight, dt.date(2026, 8, 20), dt.date(2026, 8, 21), plan)


def test_messages(spark):
    up, gone = _line("Deluxe", "increase", "2500", "2700", "200", "8", True, "Breakfast"), _line("Suite & <b>", "became_unavailable", "9000", None)
    back = _line("Suite", "became_available", None, "9000")
    kind = "hotel string, lines array<struct<room string, direction string, old_price decimal(12,2), new_price decimal(12,2), delta decimal(12,2), delta_pct decimal(9,2), currency string, overnight boolean, check_in date, check_out date, meal_plan string>>"
    df = spark.createDataFrame([("H", [up]), ("H", [gone, up]), ("H", [back])], kind)
    stamp = F.lit("5:30 PM IST")
    got = df.select(render.digest_subject(F.col("hotel"), F.col("lines")).alias("subject"), render.digest_body(F.col("hotel"), F.col("lines"), stamp).alias("body"), render.digest_rows(F.col("lines")).alias("html"), render.template_values(F.col("hotel"), F.col("lines"), stamp).alias("values")).collect()
    assert [r.subject for r in got] == ["Price change: H — Deluxe ₹2,700", "2 price changes: H", "Price change: H — Suite ₹9,000"]
    first = "▲ Deluxe: ₹2,500 → ₹2,700 vs last night  (Increase ₹200, 8.0%)\n   Stay: 20 Aug 2026 → 21 Aug 2026   Plan: Breakfast\n\n"
    assert got[0].body == "🔔 Room Price Changed\nHotel: H\n\n" + first + "Checked: 5:30 PM IST"
    assert got[1].body == "🔔 2 Room Price Changes\nHotel: H\n\n🚫 Suite & <b> — sold out\n   Stay: 20 Aug 2026 → 21 Aug 2026\n\n" + first + "Checked: 5:30 PM IST"
    assert "<td>Suite &amp; &lt;b&gt;</td><td>₹9,000</td><td>—</td><td><b>Sold out</b></td>" in got[1].html and "+₹200 (8.0%)" in got[0].html
    assert list(got[0]["values"]) == ["H", "Deluxe", "₹2,500", "₹2,700", "+₹200 (8.0%)", "20 Aug 2026 → 21 Aug 2026", "5:30 PM IST"]
    assert got[1]["values"][1:5] == ["Suite & <b> +1 more", "₹9,000", "—", "sold out"] and got[2]["values"][4] == "now available" and "available again at ₹9,000" in got[2].body


def test_room_names():
    n = matching.normal_name
    assert n("Deluxe Room") == n("  DELUXE   ROOM  ") == n("Deluxe-Room") == n("Deluxe Room!") == n("The Deluxe Room") == "deluxe"
    assert n("Deluxe Double") == n("Double Deluxe") and n("Dlx Dbl Room") == n("Deluxe Double Room") and n("AC Deluxe Room") != n("Non AC Deluxe Room")
    assert n("room") == "" and n(None) == "" and n("Tree House Villa") == "house tree villa" and n("Suité") == "suite"
    assert round(matching.similarity("deluxe double occupancy super", "deluxe double occupancy"), 2) == 88.46
    assert matching.similarity("", "x") == 0 and matching.similarity("deluxe", "deluxe") == 100


T = detector.Thresholds(Decimal(50), Decimal(2), 1)


@pytest.mark.parametrize("last, pend, seen, outcome", [
    (None, None, 2500, "first_sight"), (2500, None, 2500, "unchanged"), (2500, 2300, 2500, "unchanged"), (2500, None, 2300, "changed"), (2500, None, 2900, "changed"), (2500, None, 2520, "insignificant"), (1000, None, 1030, "insignificant"), (50000, None, 50500, "insignificant"),
])
def test_detector_step(last, pend, seen, outcome):
    state = None if last is None else detector.State(Decimal(last), True, Decimal(pend) if pend else None, 1 if pend else 0)
    got, after = detector.step(state, Decimal(seen), True, 1, T)
    assert got == outcome and after.pend is None


def test_detector_property(spark):
    """Expression, sorted partitions and stream agree on random histories with ties, nulls and replays."""
    import random

    from lumenfare.streaming import detector as streaming

    rng = random.Random(5)
    start = dt.datetime(2026, 1, 1)
    data = []
    for k in range(400):
        price = rng.choice([None, 1000, 1010, 1100, 1200, 0])
        data.append((f"k{rng.randrange(6)}", start + dt.timedelta(minutes=rng.randrange(500)), k, Decimal(price) if price is not None else None, rng.random() > 0.2))
    obs = spark.createDataFrame(data, "offer_key string, checked_at timestamp, event_id long, price decimal(12,2), is_available boolean")
    names = ["offer_key", "event_id", "outcome", "last_price"]
    a, b = (sorted(map(tuple, f(obs).select(*names).collect()), key=repr) for f in (detector.fold, detector.fold_stream))
    assert a == b and len({x[2] for x in a}) == 7
    assert detector.fold(obs.limit(0)).count() == 0
    kept = [r for r in detector.without_replays(obs).collect()]
    plain = {}
    for r in sorted(kept, key=lambda r: (r.offer_key, r.checked_at, r.event_id)):
        outcome, plain[r.offer_key] = detector.step(plain.get(r.offer_key), r.price, r.is_available, r.checked_at, detector.Thresholds())
        assert (r.offer_key, r.event_id, outcome) in {x[:3] for x in a}
    assert streaming.OUTPUT.startswith("offer_key")


def test_carry_over_reads_the_state_at_first_sight(spark):
    from lumenfare.operators import carryover

    at = lambda d, h: dt.datetime(2026, 8, d, h)
    rows = [("a", 18, at(17, 9), 1, 1000), ("a", 18, at(17, 12), 2, 2000), ("a", 18, at(17, 13), 3, 2000), ("b", 19, at(17, 10), 4, 1100)]
    obs = spark.createDataFrame([(k, 1, 1, 1, 2, 0, None, None, "INR", dt.date(2026, 8, d), dt.date(2026, 8, d + 1), t, e, Decimal(p), True) for k, d, t, e, p in rows],
        "offer_key string, hotel_id long, room_type_id long, source_id long, adults long, children long, meal_plan string, refundable boolean, currency string, check_in date, check_out date, checked_at timestamp, event_id long, price decimal(12,2), is_available boolean")
    steps = detector.fold(obs)
    live = carryover.carry_over(obs, steps).collect()
    assert [(r.offer_key, r.old_price, r.new_price, r.direction) for r in live] == [("b", 1000, 1100, "increase")]
    final = carryover.carry_over(obs, steps, final_state=True).collect()
    assert [(r.old_price, r.direction) for r in final] == [(2000, "decrease")]


def test_discovery_helpers(spark):
    from lumenfare.operators import discovery

    m = lambda **k: F.create_map(*[F.lit(x) for p in k.items() for x in p])
    assert one(spark, discovery.merge_config(m(kind="dom", timeout="5"), m(kind="json", rooms_path="a"))) == {"timeout": "5", "kind": "json", "rooms_path": "a"}
    assert one(spark, discovery.really_changed(m(kind="dom", discovery_note="x"), m(kind="dom", discovery_note="y"))) is False
    got = one(spark, discovery.may_repair(F.lit(True), F.lit(3), F.lit(None).cast("timestamp"), F.current_timestamp()))
    assert (got.allowed, got.reason) == (False, "attempts_used")


CARD_PAGE = """<div class="legend">From ₹999</div><div class="list">
<div class="card"><h3 class="name">Deluxe Room</h3><span class="price">₹2,500</span><p>Exclusive of tax. Only 2 left</p></div>
<div class="card"><h3 class="name">Suite</h3><span class="price">₹8,900</span><p>Lake view</p></div>
<div class="card"><h3 class="name">Family Room</h3><span class="price">₹4,100</span><p>Garden</p></div></div>"""


def test_room_cards(spark):
    from lumenfare.sources import cards, payloads

    pages = spark.createDataFrame([(1, CARD_PAGE), (2, "<p>nothing</p>"), (3, None)], "page_id long, html string")
    found = {r.page_id: r.c for r in pages.select("page_id", cards.room_cards(F.col("html")).alias("c")).collect()}
    assert (found[1].card_selector, found[1].name_selector, found[1].price_selector, found[1].n_cards) == ("div.card", "h3.name", "span.price", 3)
    got = {r.raw_room_name: r for r in payloads.adapter("rendered_page")(pages).collect()}
    assert got["Deluxe Room"].price_exclusive == 2500 and got["Deluxe Room"].price_inclusive is None and got["Deluxe Room"].rooms_left == 2
    assert got["Suite"].price_inclusive == 8900 and got["Suite"].is_available and len(got) == 3


def test_engines_and_rebase(spark):
    got = one(spark, mapping.detect_engine(F.col("u")), u="https://live.IPMS247.com/booking/?hotelCode=17&x=1")
    assert (got.engine, got.external_id) == ("ezee-letsbook", "17") and one(spark, mapping.detect_engine(F.col("u")), u="https://other.org/1").engine is None
    at = lambda h: dt.datetime(2026, 1, 1, h)
    obs = spark.createDataFrame([("a", at(1), 1, Decimal(1000), True, "inclusive"), ("a", at(2), 2, Decimal(900), True, "exclusive"), ("a", at(3), 3, Decimal(900), True, "exclusive")], "offer_key string, checked_at timestamp, event_id long, price decimal(12,2), is_available boolean, basis string")
    assert [r.outcome for r in detector.fold_rebased(obs, "basis").orderBy("event_id").collect()] == ["first_sight", "first_sight", "unchanged"]


def test_nested_redaction(spark):
    hide = lambda x: one(spark, mapping.scrub_json(F.col("x")), x=x)
    assert hide('{"a": [{"Api-Key": {"deep": [1]}, "b": "Bearer abcdefghijklmn.x"}], "n": null}') == '{"a":[{"Api-Key":"***REDACTED***","b":"Bearer ***REDACTED***"}],"n":null}'
    assert hide("bearer abcdefghijklmn, so " + "x" * 40) == "bearer ***REDACTED***, so ***REDACTED***" and hide("7") == "7" and hide("") == ""
    deep = "[" * 14 + "1" + "]" * 14
    assert hide(deep) == "[" * 13 + '"***TRUNCATED***"' + "]" * 13


def test_discovery_rules(spark):
    import json

    rooms = [{"title": f"Deluxe Room {k}", "mrp": 9000 + k, "taxes": 300, "meal": "Breakfast", "data": {"x": {"y": {"z": {"price": 5000}}}, "rates": [{"sell_rate": f"{2000 + k},50" if k == 9 else 2000.5 + k}], "2024-01-05": {"sellRate": 1500}}, "available": True, "roomsLeft": 3} for k in range(4)]
    one_name = [{"name": "King Size Bed", "price": 1000 + k} for k in range(4)]
    text = "Deluxe from ₹ 2,000.50 or 2001.5, was 9000; size 134 m2"
    pages = spark.createDataFrame([(1, json.dumps({"d": {"list": rooms}}), text), (1, json.dumps(one_name), text), (2, json.dumps(rooms), "134 2000 20005"), (3, "no json", text), (4, None, None), (5, json.dumps({"rooms": rooms[:1]}), "INR 2000")], "page_id long, payload string, page_text string")
    got = {r.page_id: r for r in discovery.candidates(pages).collect()}
    assert sorted(got) == [1, 2, 5]
    r = got[1]
    assert (r.path, r.name_field, r.price_field, r.available_field, r.left_field) == ("d.list", "title", "data.rates.0.sell_rate", "available", "roomsLeft")
    # Half of the four prices are there, one of them with a currency; a price's whole part counts as the page's number.
    assert (r.n_matched, r.n_marked, r.verified, r.strong, r.score) == (2, 1, True, True, 4 * 3 + 10 + 1.6 + 4 + 25)
    assert (got[2].n_matched, got[2].verified, got[2].strong) == (1, False, False)
    assert (got[5].n_matched, got[5].n_marked, got[5].strong) == (1, 1, True)
    why = lambda x: one(spark, discovery.unlearnable(F.col("x")), x=x)
    assert [why(x) for x in (None, " ", "sold out", "sold out, was ₹ 2,500", "Rs 2500", "$ 99")] == ["no_text", "no_text", "no_marked_price", "sold_out", None, "no_marked_price"]


def test_fold_by_blocks_is_linear_in_a_keys_length(spark):
    """A key's steps are never copied as a whole: one key of 4000 takes about what four of 1000 take. Blocks' edges change nothing."""
    import time

    def made(keys, n):
        at = F.col("id").cast("long")
        return spark.range(keys * n).select((at % keys).cast("string").alias("offer_key"), F.timestamp_seconds(at).alias("checked_at"), at.alias("event_id"), (F.lit(1000) + at * 7919 % 13 * 100).cast("decimal(12,2)").alias("price"), (at * 31 % 11 > 0).alias("is_available"))

    def took(keys, n):
        began = time.perf_counter()
        detector.fold(made(keys, n).coalesce(1)).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    took(1, 1000)
    assert took(1, 4000) < 3 * took(4, 1000) + 2
    for n in (1, detector.BLOCK, detector.BLOCK + 1, 3 * detector.BLOCK + 5):
        assert sorted(map(repr, detector.fold(made(2, n)).collect())) == sorted(map(repr, detector.fold_stream(made(2, n)).select(*detector.fold(made(2, n)).columns).collect()))


def test_pages_are_judged_in_one_go(spark):
    """A page's rows are shuffled once, and its values are never rows of their own."""
    from lumenfare import registry
    from tests.oracle import SF

    plan = registry.QUERIES["d7_discover_arrays"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_discovery_reads_values_as_columns_do(spark):
    """Prices and names are told by Python; the rules are those of Spark's casts and patterns."""
    values = ["100", "99.99999999999", "99.9999999999", "500,000", "500000.00000000001", "500001", "₹ 1,234.50", " 120 ", "\t120\n", "1_000", "1e3", "5E+2", "+150.", ".5e3", "1e", "nan", "inf", "١٢٣", "120d", "0x99", "\u00a0120", "--120", "1e400", ""]
    names = ["Deluxe Room", "Deluxe\u00a0Room", "Suite\u2028", "Suite \n", "Zimmer für zwei", "Bed", "AB", "9 Beds", "x" * 80, "x" * 81, "ſuite", "twin-bed", "Süd roomé", "éroom", "NON  AC", "K\u0131ng", "", "2024-01-05\n", "a.20240105.b", "20240105\u0085"]
    number = F.regexp_replace("value", "[,₹]", "").try_cast("decimal(38,10)")
    bare = F.regexp_replace(F.trim("value"), r"\s+", " ")
    rows = spark.createDataFrame([(v,) for v in values + names], "value string").select("value", F.when(number.between(discovery.LEAST_PRICE, discovery.MOST_PRICE), number).alias("price"), bare.rlike(discovery.NAME_LIKE).alias("named"), F.col("value").rlike(discovery.ROOM_WORDS).alias("roomy"), F.col("value").rlike(discovery.DATED_SEGMENT).alias("dated")).collect()
    for r in rows:
        field = discovery.Field("price")
        field.put(0, r.value)
        assert (discovery.plausible_price(r.value), field.named, field.roomy > 0, discovery.roles(r.value) is None) == (r.price, r.named, r.roomy and r.value.strip(" ") != "", r.dated), r


def test_names_of_long_arrays_are_counted_whole(spark):
    """Fields are told by twelve objects, the names of all are counted."""
    import json

    rooms = [{"room_name": f"Room {k % 15}", "price": 1000 + k} for k in range(20)]
    p = spark.createDataFrame([(1, json.dumps({"rooms": rooms}), "₹ 1000 ₹ 1001 ₹ 1002 ₹ 1003")], "page_id long, payload string, page_text string")
    got = discovery.candidates(p).collect()
    assert [(r.path, r.n_rows, r.n_names, r.n_prices, r.n_matched) for r in got] == [("rooms", 20, 15, 8, 4)]


def test_long_texts_are_masked_and_lowered_once(spark):
    import re

    from lumenfare import registry
    from lumenfare.sources import payloads
    from tests.oracle import SF

    plan = registry.QUERIES["i7_error_rows"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 3
    walls = spark.createDataFrame([("Just a moment", "Verify you are human"), (None, None), ("x", "ACCESS denied")], "title string, body string").select(payloads.bot_wall(F.col("title"), F.col("body")).alias("sign"))
    assert [r.sign for r in walls.collect()] == ["verify you are human", None, "access denied"]
    assert not re.search(r"lambdafunction\(.*lower\(", walls._jdf.queryExecution().optimizedPlan().toString())


def test_notifications_hash_each_digest_once(spark):
    from lumenfare import registry
    from tests.oracle import SF

    plan = registry.QUERIES["n7_notifications"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2(" not in plan and "array_join(" not in plan


def test_digests_are_dealt_by_list_and_written_once(spark, tmp_path, monkeypatch):
    import hashlib
    import os

    from lumenfare.operators import routing

    ids = spark.range(8 * 30_000).select((F.col("id") + 5_000_000).alias("change_id"), (F.col("id") % 8).alias("hotel_id"), F.lit("changed").alias("direction"), F.lit(9.0).alias("delta"), F.lit(9.0).alias("delta_pct"))
    people = spark.range(2400).select(F.col("id").alias("recipient_id"), F.lit("email").alias("channel"), F.lit(True).alias("is_active"))
    asked = people.select("recipient_id", (F.col("recipient_id") % 8).alias("hotel_id"), F.lit(5.0).alias("min_delta_abs"), F.lit(None).cast("double").alias("min_delta_pct"), F.lit(True).alias("is_active"))
    routing.digests(ids, asked, people).write.parquet(f"{tmp_path}/out")
    # 576 MB of lists, of which eight are distinct.
    files = [os.path.getsize(f"{tmp_path}/out/{f}") for f in os.listdir(f"{tmp_path}/out") if f.endswith(".parquet")]
    assert len(files) > 1 and sum(files) < 20_000_000
    small = lambda: routing.digests(ids.where("change_id % 1000 < 8"), asked, people).withColumn("task", F.spark_partition_id()).collect()
    whole = {r[:6] for r in small()}
    monkeypatch.setattr(routing, "PART", 20)
    dealt = small()
    assert {r[:6] for r in dealt} == whole and len(dealt) == len(whole) == 2400 and min(len({r.task for r in dealt if r.hotel_id == h}) for h in range(8)) > 1
    for r in dealt[::100]:
        want = ",".join(str(k) for k in range(5_000_000, 5_240_000) if k % 1000 < 8 and k % 8 == r.hotel_id)
        assert (r.change_ids, r.n_changes, r.dedupe_key) == (want, want.count(",") + 1, hashlib.sha256(f"v1|{r.recipient_id}|email|{want}".encode()).hexdigest())
