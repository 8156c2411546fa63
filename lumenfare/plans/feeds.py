"""The read queries as DataFrame plans. `reads` has the SQL that each is held against, stated apart from these plans.

Where the SQL reads an offer's or a change's place through the offers' present state, a plan takes it from the observations
or the change itself, so that a query folds the observations once or not at all; newest rows are taken by aggregates that
combine before the shuffle, not by ranking windows. Limits are those of pages, whose order ends in a unique column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chain, derive
from .domain import Domain, oracle
from .reads import READS

_DAY = 86_400_000_000


def _us(name: str, at: str | None = None) -> Column:
    return F.unix_micros(F.col(at or name).cast("timestamp")).alias(name)


def _text(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def _price() -> Column:
    return F.col("price").cast("double")


def _now(obs: DataFrame) -> Column:
    return obs.agg(F.max(F.unix_micros("checked_at"))).scalar()


def _hotels(d: Domain) -> DataFrame:
    return d["hotels"].select("hotel_id", F.col("name").alias("hotel"))


def _runs(obs: DataFrame) -> DataFrame:
    return obs.groupBy("hotel_id", F.date_trunc("hour", "checked_at").alias("run_at")).agg(F.count("*").alias("seen"), F.count_if("is_available").alias("open_offers"), F.min("event_id").alias("run_id"))


def _changes(d: Domain) -> DataFrame:
    """Confirmed changes with the place of their own observation."""
    about = d["obs"].select("event_id", "hotel_id", "room_type_id", "check_in")
    told = d["steps"].where("direction is not null").withColumnRenamed("checked_at", "changed_at")
    return told.join(about, "event_id").withColumnRenamed("event_id", "change_id")


def _count_by(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name))


def q3_history_hourly(spark, sf):
    g = Domain(spark, sf)["obs"].groupBy("offer_key", F.date_trunc("hour", "checked_at").alias("bucket"))
    return g.agg(F.round(F.avg(_price()), 6).alias("avg_price"), F.bool_or("is_available").alias("any_open"), F.count("*").alias("n")).withColumn("bucket", _us("bucket"))


def q3_history_daily(spark, sf):
    g = Domain(spark, sf)["obs"].groupBy("hotel_id", "room_type_id", F.date_trunc("day", "checked_at").alias("bucket"))
    return g.agg(F.round(F.avg(_price()), 6).alias("avg_price"), F.bool_or("is_available").alias("any_open"), F.count("*").alias("n")).withColumn("bucket", _us("bucket"))


def q4_changes_feed(spark, sf):
    d = Domain(spark, sf)
    named = _changes(d).join(_hotels(d), "hotel_id").join(d["rooms"], "room_type_id", "left")
    return named.orderBy(F.desc("changed_at"), F.desc("change_id")).limit(100).select("change_id", "hotel", "room", "direction", "old_price", "new_price", "delta", "delta_pct", _us("changed_at"))


def q6_unmatched_queue(spark, sf):
    """Names that still have no room, those met most often first."""
    open_ = chain.r8_unmatched_queue(spark, sf).where("resolved_to is null").join(_hotels(Domain(spark, sf)), "hotel_id")
    return open_.orderBy(F.desc("occurrence_count"), "hotel_id", "normalized").limit(100).select("hotel_id", "hotel", "normalized", "occurrence_count", "first_seen_at", "last_seen_at")


Q6_SQL = f"""
SELECT q.hotel_id, h.name AS hotel, q.normalized, q.occurrence_count, q.first_seen_at, q.last_seen_at FROM ({chain.R8_SQL}) q JOIN {{hotels}} h ON h.hotel_id = q.hotel_id
WHERE q.resolved_to IS NULL ORDER BY q.occurrence_count DESC, q.hotel_id, q.normalized LIMIT 100"""


def q7_errors(spark, sf):
    d = Domain(spark, sf)
    return d["errors"].join(_hotels(d), "hotel_id", "left").select("error_id", "hotel", "error_class", "has_artifact", _us("occurred_at"))


def q8_recent_failures(spark, sf):
    d = Domain(spark, sf)
    newest = d["errors"].where(F.unix_micros("occurred_at") >= _now(d["obs"]) - _DAY).orderBy(F.desc("occurred_at"), F.desc("error_id")).limit(200)
    return newest.join(_hotels(d), "hotel_id", "left").select("error_id", "hotel", "error_class", _us("occurred_at"))


def q9_dashboard_summary(spark, sf):
    """One fold for the offers' state and for the changes; every other figure is a scalar."""
    d = Domain(spark, sf)
    way = lambda k: F.count_if(F.col("direction") == k)
    offers = d["steps"].groupBy("offer_key").agg(F.max(F.struct("checked_at", "event_id", "is_available"))["is_available"].alias("is_open"), F.count("direction").alias("n"), way("increase").alias("up"), way("decrease").alias("down"))
    sums = offers.agg(F.count("*").alias("series"), F.count_if("is_open").alias("open_series"), *[F.coalesce(F.sum(a), F.lit(0)).alias(b) for a, b in (("n", "changes"), ("up", "increases"), ("down", "decreases"))])
    return sums.select(
        d["hotels"].where("is_active").agg(F.count("*")).scalar().alias("active_hotels"), d["targets"].where("is_enabled").agg(F.count("*")).scalar().alias("enabled_targets"), "series", "open_series", "changes", "increases", "decreases",
        d["errors"].agg(F.count("*")).scalar().alias("errors"), d["targets"].agg(F.min(F.unix_micros(F.col("last_success_at").cast("timestamp")))).scalar().alias("oldest_success"), _now(d["obs"]).alias("newest_check"),
    )


def q10_hotels_list(spark, sf):
    own = Domain(spark, sf)["hotels"].where(F.lower("name").contains("supplier"))
    return own.select("hotel_id", "name", "city", "region", "is_active", own.agg(F.count("*")).scalar().alias("total"))


def q11_hotel_health(spark, sf):
    """Offers are counted from the observations; no fold is needed."""
    d = Domain(spark, sf)
    targets = d["targets"].groupBy("hotel_id").agg(F.count("*").alias("n_targets"), F.count_if("is_enabled").alias("n_enabled"))
    offers = d["obs"].groupBy("hotel_id", "offer_key").agg(F.max("checked_at").alias("at")).groupBy("hotel_id").agg(F.count("*").alias("n_series"), F.max("at").alias("last_checked_at"))
    all_ = d["hotels"].select("hotel_id", "name").join(targets, "hotel_id", "left").join(offers, "hotel_id", "left").join(_count_by(d["errors"], "hotel_id", "n_errors"), "hotel_id", "left")
    return all_.na.fill(0, ["n_targets", "n_enabled", "n_series", "n_errors"]).withColumn("last_checked_at", _us("last_checked_at"))


def q12_targets_list(spark, sf):
    d = Domain(spark, sf)
    tonight = d["obs"].agg(F.max("check_in")).scalar()
    after = lambda days, name: F.date_add(tonight, days.cast("int")).cast("string").alias(name)
    return d["targets"].join(_hotels(d), "hotel_id").select("target_id", "hotel", "strategy", "is_enabled", "interval_minutes", after(F.col("lead_days"), "check_in"), after(F.col("lead_days") + F.col("stay_nights"), "check_out"))


def q13_check_runs(spark, sf):
    newest = _runs(Domain(spark, sf)["obs"]).orderBy(F.desc("run_at"), F.desc("run_id")).limit(50)
    return newest.select("run_id", "hotel_id", _us("run_at"), "seen", "open_offers")


def q14_recipients(spark, sf):
    d = Domain(spark, sf)
    n = _count_by(d["assignments"], "recipient_id", "n_assignments")
    return d["recipients"].select("recipient_id", "name", "is_active").join(n, "recipient_id", "left").na.fill(0, ["n_assignments"])


def _notifications(d: Domain) -> DataFrame:
    """Orders as notifications, with their recipient."""
    o = d["orders"].select(F.col("o_orderkey").alias("notification_id"), F.col("o_custkey").alias("recipient_id"), "o_orderstatus", "o_orderdate")
    return o.join(d["recipients"].select("recipient_id", F.col("name").alias("recipient"), "channel"), "recipient_id")


def q15_notifications_list(spark, sf):
    d = Domain(spark, sf)
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "sent").otherwise("queued")
    n = _notifications(d).withColumn("hotel_id", F.col("recipient_id") % 10).join(_hotels(d), "hotel_id", "left")
    return n.select("notification_id", "recipient", "channel", "hotel", status.alias("status"), _us("created_at", "o_orderdate"))


def q16_source_usage(spark, sf):
    offers = Domain(spark, sf)["obs"].select("offer_key", "hotel_id", (F.col("room_type_id") % 3).alias("source_id")).distinct()
    by_hotel = offers.groupBy("source_id", "hotel_id").agg(F.count("*").alias("n"))
    return by_hotel.groupBy("source_id").agg(F.count("hotel_id").alias("n_hotels"), F.sum("n").alias("n_offers"))


def q17_overview(spark, sf):
    d = Domain(spark, sf)
    recent = d["steps"].where(F.col("direction").isNotNull() & (F.unix_micros("checked_at") >= _now(d["obs"]) - _DAY))
    return recent.groupBy("direction").agg(F.count("*").alias("n"), F.max(F.abs("delta")).alias("largest"), F.max(F.unix_micros("checked_at")).alias("newest"))


def q17_top_changes(spark, sf):
    d = Domain(spark, sf)
    recent = _changes(d).where(F.unix_micros("changed_at") >= _now(d["obs"]) - _DAY).join(_hotels(d), "hotel_id")
    return recent.orderBy(F.desc("changed_at"), F.desc("change_id")).limit(20).select("change_id", "hotel", "direction", "delta", _us("changed_at"))


def flat_moves(changes: DataFrame) -> DataFrame:
    """Nights on which a hotel's changes, three or more, all moved by the same amount: the smallest is the largest, so nothing need be distinct. Changes without an amount, or of none, don't count."""
    moved = changes.where("delta <> 0").groupBy("hotel_id", "check_in").agg(F.count("*").alias("n"), F.min("delta").alias("least"), F.max("delta").alias("delta"))
    return moved.where("n >= 3 and least = delta").select("hotel_id", _text("check_in"), "n", "delta")


def q19_flat_moves(spark, sf):
    return flat_moves(_changes(Domain(spark, sf)))


def q20_relative_bars(spark, sf):
    told = Domain(spark, sf)["steps"].where("direction is not null and delta_pct is not null").select(F.col("event_id").alias("change_id"), F.abs("delta_pct").alias("p"))
    top = F.nullif(told.agg(F.max("p")).scalar(), F.lit(0.0))
    return told.select("change_id", (F.col("p") / F.coalesce(top, F.lit(1.0))).alias("bar"))


def q21_dashboard_matrix(spark, sf):
    _, s = chain._series(spark, sf)
    return s.groupBy("hotel_id", "check_in", "room_type_id").agg(F.min(F.when(F.col("current_price") > 0, F.col("current_price"))).alias("price"), F.count("*").alias("n")).withColumn("check_in", _text("check_in"))


def q22_hotels_page(spark, sf):
    d = Domain(spark, sf)
    own = d["hotels"].where(F.lower("name").contains("00")).select("hotel_id", "name")
    return own.join(_count_by(d["targets"], "hotel_id", "n_targets"), "hotel_id", "left").na.fill(0, ["n_targets"])


def q23_hotel_page(spark, sf):
    """The ten newest runs of every hotel, and whether it has offers of nights gone by."""
    obs = Domain(spark, sf)["obs"]
    past = obs.groupBy("hotel_id").agg(F.coalesce(F.min("check_in") < obs.agg(F.max("check_in")).scalar(), F.lit(False)).alias("had_past"))
    newest = Window.partitionBy("hotel_id").orderBy(F.desc("run_at"), F.desc("run_id"))
    runs = _runs(obs).withColumn("k", F.row_number().over(newest)).where("k <= 10")
    return runs.join(past, "hotel_id").select("hotel_id", "run_id", _us("run_at"), "seen", "had_past")


def q24_changes_by_local_day(spark, sf):
    day = F.floor((F.unix_micros("changed_at") + 19_800_000_000) / _DAY).cast("long")
    return _changes(Domain(spark, sf)).select("change_id", "hotel_id", "direction", "delta", day.alias("local_day"))


def q26_change_cursor(spark, sf):
    """A page of 50 beyond the cursor, and how many more there are."""
    d = Domain(spark, sf)
    since = d["obs"].agg(F.max("event_id")).scalar() / 2
    new = d["steps"].where(F.col("direction").isNotNull() & (F.col("event_id") > since))
    page = new.orderBy(F.desc("event_id")).limit(50).join(d["obs"].select("event_id", "hotel_id"), "event_id")
    return page.select(F.col("event_id").alias("change_id"), "hotel_id", "direction", "delta", F.greatest(F.lit(0).cast("long"), new.agg(F.count("*") - 50).scalar()).alias("more"))


def q27_popup_lines(spark, sf):
    whole = lambda c: F.col(c).cast("long").cast("string")
    moved = F.concat("direction", F.lit(" "), whole("old_price"), F.lit(" to "), whole("new_price"))
    line = F.when(F.col("direction") == "became_unavailable", "Sold out").when(F.col("direction") == "became_available", "Back on sale").otherwise(moved)
    return Domain(spark, sf)["steps"].where("direction is not null").select(F.col("event_id").alias("change_id"), line.alias("line"))


def q28_attention(spark, sf):
    by_hotel = Domain(spark, sf)["errors"].groupBy("error_class", "hotel_id").agg(F.count("*").alias("n"), F.max(F.unix_micros("occurred_at")).alias("newest"))
    return by_hotel.groupBy("error_class").agg(F.sum("n").alias("n"), F.count("hotel_id").alias("n_hotels"), F.max("newest").alias("newest"))


def q30_notifications_page(spark, sf):
    d = Domain(spark, sf)
    n = d["assignments"].where("is_active").select("recipient_id", "hotel_id").distinct().groupBy("recipient_id").agg(F.count("hotel_id").alias("n_hotels"))
    newest = _notifications(d).orderBy(F.desc("o_orderdate"), F.desc("notification_id")).limit(300)
    return newest.join(n, "recipient_id", "left").na.fill(0, ["n_hotels"]).select("notification_id", "recipient", "n_hotels", _us("created_at", "o_orderdate"))


def age_text(minutes: Column) -> Column:
    """Whole minutes as a reader says them."""
    many = lambda size, unit: F.concat(F.floor(minutes / size).cast("long").cast("string"), F.lit(f" {unit}s ago"))
    short = F.when(minutes < 1, "just now").when(minutes < 2, "1 minute ago").when(minutes < 60, many(1, "minute"))
    return short.when(minutes < 120, "1 hour ago").when(minutes < 1440, many(60, "hour")).when(minutes < 2880, "1 day ago").otherwise(many(1440, "day"))


def q31_age_text(spark, sf):
    obs = Domain(spark, sf)["obs"]
    last = obs.groupBy("offer_key").agg(F.max(F.unix_micros("checked_at")).alias("at"))
    minutes = last.select("offer_key", F.floor((_now(obs) - F.col("at")) / 60_000_000).alias("m"))
    return minutes.select("offer_key", age_text(F.col("m")).alias("age"))


def q32_local_times(spark, sf):
    minute = F.date_trunc("minute", F.col("checked_at") + F.expr("interval 330 minutes"))
    return Domain(spark, sf)["steps"].where("direction is not null").select(F.col("event_id").alias("change_id"), F.unix_micros(minute).alias("local_minute"))


def q33_purge_hotel(spark, sf, hotel_id: int = 3):
    """What stays by hotel once all observations of one hotel's offers are gone."""
    obs = Domain(spark, sf)["obs"].select("hotel_id", "offer_key")
    gone = obs.where(F.col("hotel_id") == hotel_id).select("offer_key").distinct()
    return _count_by(obs.join(gone, "offer_key", "left_anti"), "hotel_id", "kept")


def agg_outcome_counts(spark, sf):
    d = Domain(spark, sf)
    return d["steps"].select("event_id", "outcome").join(d["obs"].select("event_id", "hotel_id"), "event_id").groupBy("hotel_id", "outcome").agg(F.count("*").alias("n"))


def i3_collapsed_offers(spark, sf):
    return _collapsed(Domain(spark, sf)["obs"]).select("hotel_id", _us("run_at"), "collapsed", "kept")


def _collapsed(obs: DataFrame) -> DataFrame:
    """Per run, its offers and how many sightings were of an offer already seen in it."""
    offers = obs.groupBy("hotel_id", F.date_trunc("hour", "checked_at").alias("run_at"), "offer_key").agg(F.count("*").alias("n"))
    return offers.groupBy("hotel_id", "run_at").agg(F.sum(F.col("n") - 1).alias("collapsed"), F.count("*").alias("kept"))


def i4_run_counters(spark, sf):
    d = Domain(spark, sf)
    met = d["obs"].select("event_id", "hotel_id", "is_available", F.date_trunc("hour", "checked_at").alias("run_at")).join(d["steps"].select("event_id", "outcome", "direction"), "event_id")
    of = lambda k: F.count_if(F.col("outcome") == k)
    g = met.groupBy("hotel_id", "run_at").agg(F.count("*").alias("seen"), F.count("direction").alias("changed"), of("pending").alias("pending"), of("first_sight").alias("first_sights"), (~F.bool_or("is_available")).alias("sold_out"))
    return g.withColumn("run_at", _us("run_at"))


def i5_sold_out_fetches(spark, sf):
    return _runs(Domain(spark, sf)["obs"]).select("hotel_id", _us("run_at"), "seen", ((F.col("seen") > 0) & (F.col("open_offers") == 0)).alias("sold_out"))


def i6_collapse_alarm(spark, sf):
    return _collapsed(Domain(spark, sf)["obs"]).where("collapsed > 0").select("hotel_id", _us("run_at"), "collapsed")


def c15_rebuild_current(spark, sf):
    newest = F.max(F.struct("checked_at", "event_id", _price().alias("price"), "is_available"))
    return Domain(spark, sf)["obs"].groupBy("offer_key").agg(newest.alias("s")).select("offer_key", "s.price", "s.is_available")


def w6_tumbling_buckets(spark, sf):
    w = Domain(spark, sf)["obs"].groupBy("hotel_id", F.window("checked_at", "1 day")).agg(F.count("*").alias("n"), F.max(_price()).alias("top"))
    return w.select("hotel_id", F.unix_micros("window.start").alias("bucket"), "n", "top")


def n11_release_held(spark, sf):
    o = derive.load(spark, sf, "orders").where((F.col("o_orderstatus") == "P") & (F.unix_micros(F.col("o_orderdate").cast("timestamp")) <= 883_612_800_000_000))
    return o.orderBy("o_orderdate", "o_orderkey").limit(500).select(F.col("o_orderkey").alias("notification_id"), F.col("o_custkey").alias("recipient_id"))


def n12_digest_lines(spark, sf):
    d = Domain(spark, sf)
    return _changes(d).join(d["rooms"], "room_type_id", "left").join(_hotels(d), "hotel_id", "left").select("change_id", "hotel", "room", _text("check_in"), "direction", "delta")


def n18_silence_by_hotel(spark, sf):
    d = Domain(spark, sf)
    bound = d["target_runs"].agg(F.max("ran_at")).scalar() - F.expr("interval 90 days")
    silent = d["targets"].where(F.col("is_enabled") & (F.col("last_success_at") < bound))
    return silent.groupBy("hotel_id").agg(F.count("*").alias("n_stale"), F.min("target_id").alias("first_target"), F.max("target_id").alias("last_target"), F.max(F.unix_micros(F.col("last_success_at").cast("timestamp"))).alias("newest_success"))


def r10_manual_aliases(spark, sf):
    """Of a hotel's aliases of one name the manual one holds, else an exact one, else a guess; of these the newest."""
    o = derive.load(spark, sf, "orders")
    kind = F.element_at(F.array(F.lit("manual"), F.lit("exact")), (F.col("o_orderkey") % 9 + 1).cast("int"))
    kind = F.when(F.col("o_orderkey") % 9 < 2, kind).otherwise("fuzzy")
    a = o.select(F.col("o_orderkey").alias("alias_id"), (F.col("o_custkey") % 10).alias("hotel_id"), F.concat(F.lit("name "), (F.col("o_custkey") % 50).cast("string")).alias("normalized"), (F.col("o_orderkey") % 5).alias("room_type_id"), kind.alias("kind"))
    rank = F.when(F.col("kind") == "manual", 2).when(F.col("kind") == "exact", 1).otherwise(0)
    best = a.groupBy("hotel_id", "normalized").agg(F.max(F.struct(rank.alias("rank"), "alias_id", "room_type_id", "kind")).alias("b"))
    return best.select("hotel_id", "normalized", "b.room_type_id", "b.kind")


def t15_standing_rates(spark, sf):
    allowed = (F.col("strategy") == "rolling") & (F.col("lead_days") == 0) & (F.col("stay_nights") == 1)
    return Domain(spark, sf)["targets"].select("target_id", allowed.alias("allowed"))


ORACLE_SQL = {name: oracle(READS[name]) for name in READS if name in globals()} | {"q6_unmatched_queue": oracle(Q6_SQL)}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
