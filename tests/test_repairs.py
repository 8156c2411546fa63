"""Repairs, configurations as data, run logs and pruned files."""

import datetime as dt
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from lumenfare import registry
from lumenfare.functions import mapping
from lumenfare.operators import repair
from lumenfare.sources import artifacts
from tests.oracle import SF


def test_configurations_are_data(spark):
    rows = [("a", 1, json.dumps({"d": {"my list": [{"n": "Deluxe", "p": {"in": "2,500"}, "open": "SOLD_OUT"}, {"n": " ", "p": {"in": 900}}]}})), ("a", 2, "[1"), ("a", 3, None), ("b", 4, json.dumps([{"it's": "Suite", "ex": 3000, "tax": 150.5, "left": 2}])), ("c", 5, "[]"), ("d", 6, json.dumps({"x": 1}))]
    payloads = spark.createDataFrame(rows, "site string, page_id long, payload string")
    configs = spark.createDataFrame([("a", "d.my list", {"room_name": "n", "price_inclusive": "p.in", "available": "open"}), ("b", "", {"room_name": "it's", "price_exclusive": "ex", "taxes_fees": "tax", "rooms_left": "left"}), ("d", "x", {"room_name": "n"})], "site string, rooms_path string, fields map<string,string>")
    got = {(r.page_id, r.place): r._o for r in mapping.offers_by_config(payloads, configs, "site").collect()}
    assert sorted(got) == [(1, 0), (1, 1), (4, 0)]
    assert (got[1, 0].raw_room_name, float(got[1, 0].price_inclusive), got[1, 0].is_available, got[1, 1].error) == ("Deluxe", 2500.0, False, "no_name")
    assert (float(got[4, 0].price_inclusive), got[4, 0].rooms_left, got[4, 0].error) == (3150.5, 2, None)


def test_rediscovery_and_errors(spark):
    now = F.lit("2026-08-20 12:00:00").cast("timestamp")
    at = lambda h: dt.datetime(2026, 8, 20, h)
    kind = "source_id long, enabled boolean, config map<string,string>, state struct<attempts:int,last_attempt_at:timestamp,last_outcome:string>"
    sources = spark.createDataFrame([(1, True, {"kind": "old", "city": "x"}, (2, None, None)), (2, True, {}, (1, at(11), "error")), (3, True, None, None), (4, True, {"kind": "old"}, (0, None, None)), (5, None, {}, None)], kind)
    rooms = json.dumps({"rooms": [{"room_name": f"Deluxe {k}", "price": 2000 + k} for k in range(3)]})
    # Payloads tell before cards do; a source without evidence was not read; one page shows rates of which none has a currency.
    html = '<ul><li class="r"><h3>A room</h3><b>Rs. 700</b></li><li class="r"><h3>B room</h3><b>Rs. 800</b></li></ul>'
    evidence = spark.createDataFrame([(1, "https://x/api/v2/rates?d=1", rooms, html, "₹2,000 and 2001, 2002"), (1, "https://x/api/v2/other", json.dumps([{"name": "x"}]), None, None), (4, "https://x/r", rooms, None, "2000 2001 Rs. 150"), (2, "u", rooms, None, "₹2,000")], "source_id long, source_url string, payload string, html string, page_text string")
    got = {r.source_id: r for r in repair.rediscover(sources, evidence, now).collect()}
    assert {k: r.outcome for k, r in got.items()} == {1: "repaired", 2: "cooling_down", 3: "unlearnable", 4: "unverified", 5: "disabled"}
    assert got[1].config["city"] == "x" and got[1].config["kind"] == "json" and got[1].config["rooms_path"] == "rooms" and "3/3 prices confirmed, 1 with" in got[1].config["discovery_note"]
    assert (got[1].state.attempts, got[2].state.attempts, got[3].state.attempts, got[4].state.attempts) == (0, 1, 0, 1) and got[4].config == {"kind": "old"} and got[5].state is None
    errors = spark.createDataFrame([(1, 1, "parse_schema_drift", None), (2, 1, "timeout", None), (3, 1, "adapter_config", at(1)), (4, 4, "adapter_config", None), (5, None, "adapter_config", None)], "error_id long, source_id long, error_class string, resolved_at timestamp")
    done = {r.error_id: r.resolved_at for r in repair.resolve_errors(errors, spark.createDataFrame(list(got.values())), now).collect()}
    assert done == {1: at(12), 2: None, 3: at(1), 4: None, 5: None}
    assert repair.rediscover(sources.limit(0), evidence, now).count() == 0 and repair.inspect(evidence.limit(0)).count() == 0


def test_runs_are_logged_in_the_pass_that_writes(spark, tmp_path):
    base, at = f"file://{tmp_path}", dt.datetime(2026, 8, 20, 12)
    offers = spark.createDataFrame([(1, True, 2500.0), (2, True, None), (3, False, None)], "id long, is_available boolean, price double")
    write = lambda df, run, path="offers": artifacts.write_with_log(df, f"{base}/{path}", f"{base}/log", run, "schedule", at, at)
    assert artifacts.runs(spark, f"{base}/log").count() == 0
    row = write(offers, "r1")
    assert (row["status"], row["offers"], row["available"], row["priced"], row["cheapest"]) == ("success", 3, 2, 1, 2500.0)
    assert write(offers, "r1")["status"] == "success" and spark.read.parquet(f"{base}/offers").count() == 3
    assert write(offers.where("id > 1"), "r2")["status"] == "partial" and write(offers.limit(0), "r3")["status"] == "empty" and write(offers.where("id = 3"), "r4")["status"] == "success"
    with pytest.raises(Exception, match="broken"):
        write(offers.withColumn("id", F.raise_error(F.lit("broken")).cast("long")), "r5", "other")
    log = {r.run_id: r for r in artifacts.runs(spark, f"{base}/log").collect()}
    assert sorted(log) == ["r1", "r2", "r3", "r4", "r5"] and log["r5"].status == "failed" and "broken" in log["r5"].error_summary


def test_old_files_go_but_those_in_use(spark, tmp_path):
    now = dt.datetime(2026, 8, 20, tzinfo=dt.timezone.utc).timestamp()
    for name, days in (("old.png", 40), ("kept.html", 40), ("told.html", 40), ("new.png", 1), ("sub/deep.png", 31)):
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        open(f"{tmp_path}/{name}", "w").write("x")
        os.utime(f"{tmp_path}/{name}", (now - days * 86400,) * 2)
    errors = spark.createDataFrame([("kept.html", None), ("told.html", dt.datetime(2026, 8, 1)), (None, None)], "artifact string, resolved_at timestamp")
    gone = artifacts.prunable(artifacts.stored_files(spark, f"file://{tmp_path}"), errors, F.lit("2026-08-20 00:00:00").cast("timestamp"))
    assert sorted(r.name for r in gone.collect()) == ["deep.png", "old.png", "told.html"]
    read = re.findall(r"ReadSchema: struct<([^>]*)>", gone._jdf.queryExecution().executedPlan().toString())
    assert any("modificationTime" in x for x in read) and not any("content" in x for x in read)
    assert artifacts.prune(gone) == 3 and sorted(f for _, _, fs in os.walk(tmp_path) for f in fs) == ["kept.html", "new.png"]


def test_cards_of_plain_pages_need_no_parser_and_equal_its_findings(monkeypatch):
    import random

    from lumenfare.sources import cards

    rng = random.Random(3)
    texts = ["Rs. 1,200", "Room A", "Suite", "  ", "x & y", "&amp; 3", "€ 55 and Rs. 9", "a < b", "inclusive", "> "]
    marks = ["<br>", "</div>", "<b>", "<!-- x -->", "<IMG src=x>", "<script>", "<title>", ""]
    item = lambda: f'<li class="room"><h3>{rng.choice(texts)}</h3>{rng.choice(marks)}<p class="cost">{rng.choice(texts)}</p>{rng.choice(texts)}</li>'
    pages = ["<ul>" + "".join(item() for _ in range(rng.randint(1, 6))) for _ in range(2000)]
    got = [cards.find_cards(p) for p in pages]
    with monkeypatch.context() as m:
        # Nothing is a plain tag: every page goes through the parser.
        m.setattr(cards, "_PLAIN", __import__("re").compile("(\\Z.)"))
        assert got == [cards.find_cards(p) for p in pages] and sum(x is not None for x in got) > 100
    monkeypatch.setattr(cards._Tree, "feed", lambda *_: 1 / 0)
    plain = "<ul>" + "".join(f'<li class="room"><h3>Room {k}</h3><p class="cost">Rs. 2,{k}00</p></li>' for k in range(3)) + "</ul>"
    assert cards.find_cards(plain)["n_cards"] == 3


def test_paths_of_configurations_are_not_parsed_for_each_value(spark):
    payload = json.dumps({"d": [1, {"my.x": 1, "7": "key", "x": [{"n": "a"}, {"n": {"k": [5, 2.50, None, True]}}]}], "": {"": "e"}})
    v = spark.createDataFrame([(p, payload) for p in ("d.1.x.1.n.k.1", "d.1.x.1.n.k", "d.1.x.1.n.k.2", "d.1.x.1.n.k.3", "d.1.x.1.n.k.4", "d.1.7", "d.x", "d.1.x.n", "..", ".", "d.99999999999", "", None, "d.0.a")], "path string, payload string")
    got = {r.path: r.v for r in v.select("path", mapping.at(F.try_parse_json("payload"), mapping.steps(F.col("path")), "string").alias("v")).collect()}
    whole = got.pop("")
    assert json.loads(whole) == json.loads(payload)
    assert {k: x for k, x in got.items() if x is not None} == {"d.1.x.1.n.k.1": "2.5", "d.1.x.1.n.k": "[5,2.5,null,true]", "d.1.x.1.n.k.3": "true", ".": "e"}
    plan = registry.QUERIES["d11_offers_by_config"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # Every path into a variant is a constant; only first pages are made for learning.
    assert plan.count("variant_get(") == plan.count(", $, ") > 0 and "min_by" not in plan
