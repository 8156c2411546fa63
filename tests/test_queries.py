"""Every registered query of the engine against its SQL."""

import pytest

from lumenfare import registry
from tests.oracle import SF, rows, same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name])


def test_raw_history_keeps_every_observation(spark, tmp_path):
    from pyspark.sql import functions as F

    # A third of 2,400 rows, and 200 of the others, are of one offer: 1,000 in all, at four times.
    e = spark.range(2400).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) - F.col("id") % 4).alias("ts"), F.when((F.col("id") % 3 == 0) | (F.col("id") < 301), 7).otherwise(F.col("id")).cast("long").alias("user_id"),
        F.when(F.col("id") % 5 == 0, "error").otherwise("click").alias("event_type"), F.col("id").cast("double").alias("value"), F.format_string('{"k": %d}', F.when((F.col("id") % 3 == 0) | (F.col("id") < 301), 1).otherwise(2)).alias("props"),
    )
    e.write.parquet(f"{tmp_path}/events.parquet")
    read = registry.QUERIES["q2_history_raw"]
    got = read(spark, str(tmp_path)).collect()
    keys_ = [(r.offer_key, r.checked_at, r.event_id) for r in got]
    assert keys_ == sorted(keys_) and sorted(r.event_id for r in got) == list(range(2400))
    sizes = {}
    for k, _, _ in keys_:
        sizes[k] = sizes.get(k, 0) + 1
    assert max(sizes.values()) == 1000
    page = read(spark, str(tmp_path), limit=500).collect()
    assert page == [r for i, r in enumerate(got) if i - next(j for j, x in enumerate(keys_) if x[0] == keys_[i][0]) < 500]


def test_room_resolution(spark):
    got = {r.raw_name: r for r in registry.QUERIES["r3_room_resolution"](spark, SF).collect()}
    assert got["The Standard Room"].room_type_id == 0 and got["The Standard Room"].score == 100
    assert got["Family rooms"].is_exact and got["Family rooms"].room_type_id == 4
    assert got["Dlx Dbl Room"].room_type_id is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_works_without_the_llm_folders(tmp_path):
    """On a copy without them and without the pipeline's file: the entry imports and registers the engine's own queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    shutil.copytree(top / "lumenfare", tmp_path / "lumenfare", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q); print(e.__file__)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and str(tmp_path) in out.stdout, out.stderr


def test_token_bucket_equals_a_replay(spark):
    from pyspark.sql import functions as F

    from lumenfare.plans import derive

    e = derive.load(spark, SF, "events").select((F.col("user_id") % 10).alias("s"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", (F.col("event_type") == "error").alias("failed")).collect()
    want, state = {}, {}
    for r in sorted(e, key=lambda r: (r.s, r.at, r.event_id)):
        tokens, at, until = state.get(r.s, (3.0, 0, 0))
        tokens = min(3.0, tokens + (r.at - at) * ((0.001 if r.at < until else 0.002) / 60e6))
        ok = tokens >= 1
        want[r.event_id] = ok
        state[r.s] = (tokens - 1 if ok else tokens, r.at, r.at + 3600 * 10**6 if ok and r.failed else until)
    got = dict((r.request_id, r.allowed) for r in registry.QUERIES["w8_token_bucket"](spark, SF).collect())
    assert got == want and not all(want.values())


def test_probe_verdicts(spark):
    from lumenfare.sources import payloads

    pages = spark.createDataFrame([(1, "<p>Rooms from ₹2,500 and Rs. 3,200</p>"), (2, "<h1>Just a moment</h1>"), (3, ""), (4, "<script>fetch('/api/x')</script><p>x</p>"), (5, "<p>hello</p>"), (6, None)], "page_id long, html string")
    got = {r.page_id: (r.verdict, r.n_prices) for r in payloads.probe_report(pages).collect()}
    assert got[1] == ("dom", 2) and got[2][0] == "blocked" and got[3][0] == "empty" and got[4][0] == "json" and got[5][0] == "no_prices"
    assert len(rows(payloads.probe_report(pages))) == 6
