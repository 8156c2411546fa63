"""The read queries' plans on cases that the tables don't hold; test_queries holds them against SQL on the tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from lumenfare.plans import derive, feeds
from tests.oracle import SF, expected, rows


@pytest.fixture(scope="module")
def without_events(spark, tmp_path_factory):
    """The tables with no event at all."""
    path = str(tmp_path_factory.mktemp("none"))
    for name in derive.BASE:
        t = derive.load(spark, SF, name)
        (t.limit(0) if name == "events" else t).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", ["q4_changes_feed", "q9_dashboard_summary", "q11_hotel_health", "q12_targets_list", "q16_source_usage", "q17_overview", "q20_relative_bars", "q23_hotel_page", "q26_change_cursor", "q31_age_text"])
def test_no_observations(spark, without_events, name):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in derive.BASE:
        con.execute(f"create view {t} as select * from '{without_events}/{t}.parquet/*.parquet'")
    got = feeds.QUERIES[name](spark, without_events)
    want = con.execute(feeds.ORACLE_SQL[name]).df()
    assert got.count() == len(want)
    if name == "q9_dashboard_summary":
        r = got.collect()[0]
        assert (r.series, r.open_series, r.changes, r.increases, r.errors, r.newest_check) == (0, 0, 0, 0, 0, None)
        assert r.active_hotels == want.active_hotels[0] and r.enabled_targets == want.enabled_targets[0]


def test_flat_moves(spark):
    day = [datetime.date(2024, 1, d) for d in range(1, 6)]
    data = [(1, day[0], 5.0)] * 3 + [(1, day[1], 5.0)] * 2 + [(1, day[2], 5.0), (1, day[2], 5.0), (1, day[2], -5.0)] + [(2, day[0], -7.5)] * 4 + [(2, day[3], None)] * 3 + [(2, day[4], 0.0)] * 3
    data += [(3, day[0], 5.0), (3, day[0], 5.0), (3, day[0], 5.0), (3, day[0], None), (None, None, 1.0), (None, None, 1.0), (None, None, 1.0)]
    got = feeds.flat_moves(spark.createDataFrame(data, "hotel_id long, check_in date, delta double"))
    assert rows(got) == sorted([("2024-01-01", 5.0, 1, 3), ("2024-01-01", -7.5, 2, 4), ("2024-01-01", 5.0, 3, 3), (None, 1.0, None, 3)], key=repr)


def test_age_text(spark):
    cases = {-1: "just now", 0: "just now", 1: "1 minute ago", 2: "2 minutes ago", 18: "18 minutes ago", 59: "59 minutes ago", 60: "1 hour ago", 119: "1 hour ago", 120: "2 hours ago", 1439: "23 hours ago", 1440: "1 day ago", 2879: "1 day ago", 2880: "2 days ago", 14400: "10 days ago"}
    got = spark.createDataFrame([(m,) for m in cases], "m long").select("m", feeds.age_text(F.col("m")).alias("age")).collect()
    assert {r.m: r.age for r in got} == cases


@pytest.mark.parametrize(("name", "folds"), [("q9_dashboard_summary", 1), ("q4_changes_feed", 1), ("q17_overview", 1), ("q11_hotel_health", 0), ("q23_hotel_page", 0), ("q31_age_text", 0), ("q33_purge_hotel", 0)])
def test_observations_are_folded_once_at_most(spark, name, folds):
    plan = feeds.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("mapinarrow") == folds
    assert "Cross" not in plan


def test_unmatched_queue_is_the_live_one(spark):
    got = feeds.q6_unmatched_queue(spark, SF).collect()
    assert got and [r.occurrence_count for r in got] == sorted((r.occurrence_count for r in got), reverse=True)
    assert not any(r.normalized == "igloo" and r.hotel_id < 3 for r in got)
    assert rows(feeds.q6_unmatched_queue(spark, SF)) == expected(feeds.ORACLE_SQL["q6_unmatched_queue"])
