"""SQL of the read queries: prices, histories, change feeds, matrices, health, notifications. `feeds`, `chain` and `service`
have the plans that Spark runs; these texts are what the plans are held against.

The clock is the newest observation's time. Every sort that a limit follows ends in a unique column; a limit stands only
where the feature is a page or a top-k report.
"""

from __future__ import annotations

_NOW = "(SELECT max(checked_at) FROM {obs})"
_TODAY = "(SELECT max(check_in) FROM {obs})"

READS = {
    "confirmed_changes": """
SELECT change_id, offer_key, hotel_id, room_type_id, CAST(check_in AS STRING) AS check_in, US(changed_at) AS changed_at, US(first_seen_at) AS first_seen_at, old_price, new_price, delta, delta_pct, direction FROM {changes}""",
    "q1_current_prices": """
SELECT s.offer_key, h.name AS hotel, r.room, CAST(s.check_in AS STRING) AS check_in, s.current_price, s.is_available,
  US(s.last_checked_at) < (SELECT max(US(checked_at)) FROM {obs}) - 10800000000 AS is_stale
FROM {series} s JOIN {hotels} h ON h.hotel_id = s.hotel_id JOIN {rooms} r ON r.room_type_id = s.room_type_id""",
    "q2_history_raw": """
SELECT offer_key, US(checked_at) AS checked_at, event_id, CAST(price AS DOUBLE) AS price, is_available FROM {obs}""",
    "q3_history_hourly": """
SELECT offer_key, US(bucket) AS bucket, avg_price, any_open, n FROM (
  SELECT offer_key, date_trunc('hour', checked_at) AS bucket, round(avg(CAST(price AS DOUBLE)), 6) AS avg_price, bool_or(is_available) AS any_open, count(*) AS n FROM {obs} GROUP BY offer_key, date_trunc('hour', checked_at)) t""",
    "q3_history_daily": """
SELECT hotel_id, room_type_id, US(bucket) AS bucket, avg_price, any_open, n FROM (
  SELECT hotel_id, room_type_id, date_trunc('day', checked_at) AS bucket, round(avg(CAST(price AS DOUBLE)), 6) AS avg_price, bool_or(is_available) AS any_open, count(*) AS n FROM {obs} GROUP BY hotel_id, room_type_id, date_trunc('day', checked_at)) t""",
    "q4_changes_feed": """
SELECT c.change_id, h.name AS hotel, r.room, c.direction, c.old_price, c.new_price, c.delta, c.delta_pct, US(c.changed_at) AS changed_at
FROM {changes} c JOIN {hotels} h ON h.hotel_id = c.hotel_id LEFT JOIN {series} s ON s.offer_key = c.offer_key LEFT JOIN {rooms} r ON r.room_type_id = s.room_type_id ORDER BY c.changed_at DESC, c.change_id DESC LIMIT 100""",
    "q5_price_matrix": """
SELECT s.hotel_id, h.name AS hotel, CAST(s.check_in AS STRING) AS check_in, min(CASE WHEN s.is_available THEN s.current_price END) AS best_price, count(*) AS n_offers, count(*) FILTER (WHERE s.is_available) AS n_open,
  bool_or(s.recent) AS has_recent
FROM (SELECT *, coalesce(US(last_changed_at) >= (SELECT max(US(checked_at)) FROM {obs}) - 86400000000, FALSE) AS recent FROM {series}) s JOIN {hotels} h ON h.hotel_id = s.hotel_id GROUP BY s.hotel_id, h.name, s.check_in""",
    "q7_errors": """
SELECT e.error_id, h.name AS hotel, e.error_class, e.has_artifact, US(e.occurred_at) AS occurred_at FROM {errors} e LEFT JOIN {hotels} h ON h.hotel_id = e.hotel_id""",
    "q8_recent_failures": """
SELECT e.error_id, h.name AS hotel, e.error_class, US(e.occurred_at) AS occurred_at FROM {errors} e LEFT JOIN {hotels} h ON h.hotel_id = e.hotel_id
WHERE US(e.occurred_at) >= (SELECT max(US(checked_at)) FROM {obs}) - 86400000000 ORDER BY e.occurred_at DESC, e.error_id DESC LIMIT 200""",
    "q9_dashboard_summary": """
SELECT (SELECT count(*) FROM {hotels} WHERE is_active) AS active_hotels, (SELECT count(*) FROM {targets} WHERE is_enabled) AS enabled_targets, (SELECT count(*) FROM {series}) AS series, (SELECT count(*) FROM {series} WHERE is_available) AS open_series,
  (SELECT count(*) FROM {changes}) AS changes, (SELECT count(*) FROM {changes} WHERE direction = 'increase') AS increases, (SELECT count(*) FROM {changes} WHERE direction = 'decrease') AS decreases,
  (SELECT count(*) FROM {errors}) AS errors, (SELECT min(US(last_success_at)) FROM {targets}) AS oldest_success, (SELECT max(US(checked_at)) FROM {obs}) AS newest_check""",
    "q10_hotels_list": """
SELECT hotel_id, name, city, region, is_active, (SELECT count(*) FROM {hotels} WHERE lower(name) LIKE '%supplier%') AS total FROM {hotels} WHERE lower(name) LIKE '%supplier%'""",
    "q11_hotel_health": """
SELECT h.hotel_id, h.name, coalesce(t.n_targets, 0) AS n_targets, coalesce(t.n_enabled, 0) AS n_enabled, coalesce(s.n_series, 0) AS n_series, US(s.last_checked_at) AS last_checked_at, coalesce(e.n_errors, 0) AS n_errors
FROM {hotels} h LEFT JOIN (SELECT hotel_id, count(*) AS n_targets, count(*) FILTER (WHERE is_enabled) AS n_enabled FROM {targets} GROUP BY hotel_id) t ON t.hotel_id = h.hotel_id
LEFT JOIN (SELECT hotel_id, count(*) AS n_series, max(last_checked_at) AS last_checked_at FROM {series} GROUP BY hotel_id) s ON s.hotel_id = h.hotel_id
LEFT JOIN (SELECT hotel_id, count(*) AS n_errors FROM {errors} GROUP BY hotel_id) e ON e.hotel_id = h.hotel_id""",
    "q13_check_runs": """
SELECT run_id, hotel_id, US(run_at) AS run_at, seen, open_offers FROM {runs} ORDER BY run_at DESC, run_id DESC LIMIT 50""",
    "q14_recipients": """
SELECT r.recipient_id, r.name, r.is_active, coalesce(a.n, 0) AS n_assignments FROM {recipients} r LEFT JOIN (SELECT recipient_id, count(*) AS n FROM {assignments} GROUP BY recipient_id) a ON a.recipient_id = r.recipient_id""",
    "q16_source_usage": """
SELECT room_type_id % 3 AS source_id, count(DISTINCT hotel_id) AS n_hotels, count(*) AS n_offers FROM {series} GROUP BY room_type_id % 3""",
    "q17_overview": """
SELECT direction, count(*) AS n, max(abs(delta)) AS largest, max(US(changed_at)) AS newest FROM {changes}
WHERE US(changed_at) >= (SELECT max(US(checked_at)) FROM {obs}) - 86400000000 GROUP BY direction""",
    "q17_top_changes": """
SELECT c.change_id, h.name AS hotel, c.direction, c.delta, US(c.changed_at) AS changed_at FROM {changes} c JOIN {hotels} h ON h.hotel_id = c.hotel_id
WHERE US(c.changed_at) >= (SELECT max(US(checked_at)) FROM {obs}) - 86400000000 ORDER BY c.changed_at DESC, c.change_id DESC LIMIT 20""",
    "q18_tonight": """
SELECT h.hotel_id, h.name, count(s.offer_key) AS n_offers, count(*) FILTER (WHERE s.is_available) AS n_open, min(s.current_price) AS low, max(s.current_price) AS high,
  CASE WHEN count(s.offer_key) = 0 THEN 'no_data' WHEN count(*) FILTER (WHERE s.is_available) = 0 THEN 'sold_out' WHEN count(*) FILTER (WHERE s.is_available) < count(s.offer_key) THEN 'partly_open' ELSE 'open' END AS status
FROM {hotels} h LEFT JOIN (SELECT * FROM {series} WHERE check_in = (SELECT max(check_in) FROM {obs})) s ON s.hotel_id = h.hotel_id GROUP BY h.hotel_id, h.name""",
    "q19_flat_moves": """
SELECT hotel_id, CAST(check_in AS STRING) AS check_in, count(*) AS n, max(delta) AS delta FROM {changes} WHERE delta <> 0 GROUP BY hotel_id, check_in HAVING count(*) >= 3 AND count(DISTINCT delta) = 1""",
    "q20_relative_bars": """
SELECT change_id, abs(delta_pct) / (SELECT CASE WHEN max(abs(delta_pct)) = 0 THEN 1 ELSE max(abs(delta_pct)) END FROM {changes}) AS bar FROM {changes} WHERE delta_pct IS NOT NULL""",
    "q21_dashboard_matrix": """
SELECT s.hotel_id, CAST(s.check_in AS STRING) AS check_in, s.room_type_id, min(CASE WHEN s.current_price > 0 THEN s.current_price END) AS price, count(*) AS n FROM {series} s GROUP BY s.hotel_id, s.check_in, s.room_type_id""",
    "q22_hotels_page": """
SELECT h.hotel_id, h.name, coalesce(t.n, 0) AS n_targets FROM {hotels} h LEFT JOIN (SELECT hotel_id, count(*) AS n FROM {targets} GROUP BY hotel_id) t ON t.hotel_id = h.hotel_id WHERE lower(h.name) LIKE '%00%'""",
    "q23_hotel_page": """
SELECT r.hotel_id, r.run_id, US(r.run_at) AS run_at, r.seen, p.n_past > 0 AS had_past FROM (
  SELECT *, row_number() OVER (PARTITION BY hotel_id ORDER BY run_at DESC, run_id DESC) AS k FROM {runs}) r
JOIN (SELECT hotel_id, count(*) FILTER (WHERE check_in < (SELECT max(check_in) FROM {obs})) AS n_past FROM {series} GROUP BY hotel_id) p ON p.hotel_id = r.hotel_id WHERE r.k <= 10""",
    "q26_change_cursor": """
SELECT change_id, hotel_id, direction, delta, (SELECT greatest(0, count(*) - 50) FROM {changes} WHERE change_id > (SELECT max(event_id) FROM {obs}) / 2) AS more
FROM {changes} WHERE change_id > (SELECT max(event_id) FROM {obs}) / 2 ORDER BY change_id DESC LIMIT 50""",
    "q28_attention": """
SELECT error_class, count(*) AS n, count(DISTINCT hotel_id) AS n_hotels, max(US(occurred_at)) AS newest FROM {errors} GROUP BY error_class""",
    "q31_age_text": """
SELECT offer_key, CASE WHEN m < 1 THEN 'just now' WHEN m < 2 THEN '1 minute ago' WHEN m < 60 THEN CAST(m AS STRING) || ' minutes ago' WHEN m < 120 THEN '1 hour ago' WHEN m < 1440 THEN CAST(CAST(floor(m / 60) AS BIGINT) AS STRING) || ' hours ago'
  WHEN m < 2880 THEN '1 day ago' ELSE CAST(CAST(floor(m / 1440) AS BIGINT) AS STRING) || ' days ago' END AS age
FROM (SELECT offer_key, CAST(floor(((SELECT max(US(checked_at)) FROM {obs}) - US(last_checked_at)) / 60000000) AS BIGINT) AS m FROM {series}) t""",
    "q33_purge_hotel": """
SELECT hotel_id, count(*) AS kept FROM {obs} o WHERE NOT EXISTS (SELECT 1 FROM {series} s WHERE s.offer_key = o.offer_key AND s.hotel_id = 3) GROUP BY hotel_id""",
    "agg_outcome_counts": """
SELECT o.hotel_id, s.outcome, count(*) AS n FROM {steps} s JOIN {obs} o ON o.event_id = s.event_id GROUP BY o.hotel_id, s.outcome""",
    "i4_run_counters": """
SELECT o.hotel_id, US(run_at) AS run_at, seen, changed, pending, first_sights, sold_out FROM (
  SELECT o.hotel_id, date_trunc('hour', o.checked_at) AS run_at, count(*) AS seen, count(*) FILTER (WHERE s.direction IS NOT NULL) AS changed, count(*) FILTER (WHERE s.outcome = 'pending') AS pending,
    count(*) FILTER (WHERE s.outcome = 'first_sight') AS first_sights, NOT bool_or(o.is_available) AS sold_out
  FROM {obs} o JOIN {steps} s ON s.event_id = o.event_id GROUP BY o.hotel_id, date_trunc('hour', o.checked_at)) o""",
    "i3_collapsed_offers": """
SELECT hotel_id, US(run_at) AS run_at, count(*) - count(DISTINCT offer_key) AS collapsed, count(DISTINCT offer_key) AS kept FROM (SELECT *, date_trunc('hour', checked_at) AS run_at FROM {obs}) t GROUP BY hotel_id, run_at""",
    "c15_rebuild_current": """
SELECT offer_key, CAST(price AS DOUBLE) AS price, is_available FROM (
  SELECT offer_key, price, is_available, row_number() OVER (PARTITION BY offer_key ORDER BY checked_at DESC, event_id DESC) AS k FROM {obs}) t WHERE k = 1""",
    "w6_tumbling_buckets": """
SELECT hotel_id, US(bucket) AS bucket, count(*) AS n, max(CAST(price AS DOUBLE)) AS top FROM (SELECT *, date_trunc('day', checked_at) AS bucket FROM {obs}) t GROUP BY hotel_id, bucket""",
    "q12_targets_list": """
SELECT t.target_id, h.name AS hotel, t.strategy, t.is_enabled, t.interval_minutes, CAST((SELECT max(check_in) FROM {obs}) + CAST(t.lead_days AS INT) AS STRING) AS check_in, CAST((SELECT max(check_in) FROM {obs}) + CAST(t.lead_days + t.stay_nights AS INT) AS STRING) AS check_out
FROM {targets} t JOIN {hotels} h ON h.hotel_id = t.hotel_id""",
    "q15_notifications_list": """
SELECT o.o_orderkey AS notification_id, r.name AS recipient, r.channel, h.name AS hotel, CASE o.o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'sent' ELSE 'queued' END AS status, US(o.o_orderdate) AS created_at
FROM {orders} o JOIN {recipients} r ON r.recipient_id = o.o_custkey LEFT JOIN {hotels} h ON h.hotel_id = o.o_custkey % 10""",
    "q24_changes_by_local_day": """
SELECT change_id, hotel_id, direction, delta, CAST(floor((US(changed_at) + 19800000000) / 86400000000) AS BIGINT) AS local_day FROM {changes}""",
    "q27_popup_lines": """
SELECT change_id, CASE direction WHEN 'became_unavailable' THEN 'Sold out' WHEN 'became_available' THEN 'Back on sale' ELSE direction || ' ' || CAST(CAST(old_price AS BIGINT) AS STRING) || ' to ' || CAST(CAST(new_price AS BIGINT) AS STRING) END AS line FROM {changes}""",
    "n11_release_held": """
SELECT o_orderkey AS notification_id, o_custkey AS recipient_id FROM {orders} WHERE o_orderstatus = 'P' AND US(o_orderdate) <= 883612800000000 ORDER BY o_orderdate, o_orderkey LIMIT 500""",
    "n12_digest_lines": """
SELECT c.change_id, h.name AS hotel, r.room, CAST(s.check_in AS STRING) AS check_in, c.direction, c.delta FROM {changes} c LEFT JOIN {series} s ON s.offer_key = c.offer_key LEFT JOIN {rooms} r ON r.room_type_id = s.room_type_id LEFT JOIN {hotels} h ON h.hotel_id = c.hotel_id""",
    "n18_silence_by_hotel": """
SELECT hotel_id, count(*) AS n_stale, min(target_id) AS first_target, max(target_id) AS last_target, max(US(last_success_at)) AS newest_success FROM {targets} WHERE is_enabled AND last_success_at < (SELECT max(ran_at) FROM {target_runs}) - INTERVAL 90 DAYS GROUP BY hotel_id""",
    "i5_sold_out_fetches": """
SELECT hotel_id, US(run_at) AS run_at, seen, seen > 0 AND open_offers = 0 AS sold_out FROM {runs}""",
    "i6_collapse_alarm": """
SELECT hotel_id, US(run_at) AS run_at, collapsed FROM (SELECT hotel_id, run_at, count(*) - count(DISTINCT offer_key) AS collapsed FROM (SELECT *, date_trunc('hour', checked_at) AS run_at FROM {obs}) t GROUP BY hotel_id, run_at) x WHERE collapsed > 0""",
    "q30_notifications_page": """
SELECT o.o_orderkey AS notification_id, r.name AS recipient, coalesce(a.n_hotels, 0) AS n_hotels, US(o.o_orderdate) AS created_at
FROM {orders} o JOIN {recipients} r ON r.recipient_id = o.o_custkey LEFT JOIN (SELECT recipient_id, count(DISTINCT hotel_id) AS n_hotels FROM {assignments} WHERE is_active GROUP BY recipient_id) a ON a.recipient_id = r.recipient_id
ORDER BY o.o_orderdate DESC, o.o_orderkey DESC LIMIT 300""",
    "q32_local_times": """
SELECT change_id, US(local_minute) AS local_minute FROM (SELECT change_id, date_trunc('minute', changed_at + INTERVAL 330 MINUTES) AS local_minute FROM {changes}) t""",
    "r10_manual_aliases": """
SELECT hotel_id, normalized, room_type_id, kind FROM (
  SELECT *, row_number() OVER (PARTITION BY hotel_id, normalized ORDER BY CASE kind WHEN 'manual' THEN 0 WHEN 'exact' THEN 1 ELSE 2 END, alias_id DESC) AS k FROM (
    SELECT o_orderkey AS alias_id, o_custkey % 10 AS hotel_id, 'name ' || CAST(o_custkey % 50 AS STRING) AS normalized, o_orderkey % 5 AS room_type_id, CASE o_orderkey % 9 WHEN 0 THEN 'manual' WHEN 1 THEN 'exact' ELSE 'fuzzy' END AS kind FROM {orders}) a) t WHERE k = 1""",
    "t15_standing_rates": """
SELECT target_id, strategy = 'rolling' AND lead_days = 0 AND stay_nights = 1 AS allowed FROM {targets}""",
}
