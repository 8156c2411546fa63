"""Portable definitions of the domain: each table's SQL reads the same in Spark and in a plain SQL engine.

Spark runs a query over lazy DataFrames, one for each table it names; observations and the fold are built by their
operators there. Elsewhere the same names are common table expressions. US(x) stands for microseconds since the epoch.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detector
from . import derive

#: Tables with portable SQL, in order of dependence; {name} refers to another table.
TABLES = {
    "series": """
SELECT offer_key, hotel_id, room_type_id, check_in, check_out, meal_plan, refundable, last_price, current_price, is_available, checked_at AS last_checked_at, first_checked_at, last_changed_at
FROM (SELECT s.*, o.hotel_id, o.room_type_id, o.check_in, o.check_out, o.meal_plan, o.refundable,
        row_number() OVER (PARTITION BY s.offer_key ORDER BY s.checked_at DESC, s.event_id DESC) AS latest,
        min(s.checked_at) OVER (PARTITION BY s.offer_key) AS first_checked_at,
        max(CASE WHEN s.direction IS NOT NULL THEN s.checked_at END) OVER (PARTITION BY s.offer_key) AS last_changed_at
      FROM {steps} s JOIN {obs} o ON o.event_id = s.event_id) t
WHERE latest = 1""",
    "changes": """
SELECT s.event_id AS change_id, s.offer_key, o.hotel_id, o.room_type_id, o.check_in, s.checked_at AS changed_at, s.first_seen_at, s.old_price, s.new_price, s.delta, s.delta_pct, s.direction
FROM {steps} s JOIN {obs} o ON o.event_id = s.event_id WHERE s.direction IS NOT NULL""",
    "runs": """
SELECT hotel_id, date_trunc('hour', checked_at) AS run_at, count(*) AS seen, count(*) FILTER (WHERE is_available) AS open_offers, min(event_id) AS run_id
FROM {obs} GROUP BY hotel_id, date_trunc('hour', checked_at)""",
    "errors": """
SELECT event_id AS error_id, hotel_id, checked_at AS occurred_at, room_type_id = 3 AS has_artifact,
  CASE room_type_id WHEN 0 THEN 'timeout' WHEN 1 THEN 'schema_drift' WHEN 2 THEN 'network' WHEN 3 THEN 'blocked' ELSE 'rate_limited' END AS error_class
FROM {obs} WHERE NOT is_available""",
    "recipients": """
SELECT c_custkey AS recipient_id, c_name AS name, c_acctbal >= 0 AS is_active, c_mktsegment = 'MACHINERY' AS receives_ops,
  CASE WHEN c_nationkey % 2 = 0 THEN 'email' ELSE 'whatsapp' END AS channel FROM {customer}""",
    "assignments": """
SELECT c_custkey AS recipient_id, c_custkey % 10 AS hotel_id, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 3 * 60 AS DOUBLE) END AS min_delta_abs,
  CASE WHEN c_custkey % 4 = 0 THEN CAST(5 AS DOUBLE) END AS min_delta_pct, c_custkey % 7 <> 0 AS is_active FROM {customer}
UNION ALL
SELECT c_custkey, (c_custkey + 3) % 10, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), TRUE FROM {customer} WHERE c_mktsegment = 'BUILDING'""",
    "target_runs": """
SELECT o_custkey AS target_id, o_orderkey AS run_id, o_orderdate AS ran_at, o_orderstatus <> 'F' AS ok, o_orderpriority = '1-URGENT' AS refused FROM {orders}""",
    "targets": """
SELECT c.c_custkey AS target_id, c.c_custkey % 10 AS hotel_id, 30 + c.c_custkey % 4 * 30 AS interval_minutes, c.c_acctbal >= 0 AS is_enabled, c.c_custkey % 2 + 1 AS adults, c.c_nationkey % 3 AS children,
  CASE c.c_custkey % 3 WHEN 0 THEN 'fixed' ELSE 'rolling' END AS strategy, c.c_nationkey % 5 AS lead_days, 1 + c.c_custkey % 2 AS stay_nights, r.last_success_at, r.last_failure_at
FROM {customer} c LEFT JOIN (
  SELECT target_id, max(CASE WHEN ok THEN ran_at END) AS last_success_at, max(CASE WHEN NOT ok THEN ran_at END) AS last_failure_at FROM {target_runs} GROUP BY target_id) r ON r.target_id = c.c_custkey""",
}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Domain:
    """Lazy DataFrames of one folder's domain tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self._make(name)
        return self.made[name]

    def _make(self, name: str) -> DataFrame:
        if name == "obs":
            return derive.observations(self.spark, self.sf_dir)
        if name == "steps":
            steps = detector.fold_stream(self["obs"])
            return steps.select(*[F.col(c).cast("double").alias(c) if kind.startswith("decimal") else F.col(c) for c, kind in steps.dtypes])
        if name == "hotels":
            return derive.hotels(self.spark, self.sf_dir)
        if name == "rooms":
            return derive.rooms(self.spark)
        if name in TABLES:
            return self.sql(TABLES[name])
        return derive.load(self.spark, self.sf_dir, name)

    def sql(self, sql: str) -> DataFrame:
        """A portable query over this domain's tables."""
        return self.spark.sql(_spark(sql), **{n: self[n] for n in _needs(sql)})


def _spark(sql: str) -> str:
    return re.sub(r"US\(([\w.]+)\)", r"unix_micros(CAST(\1 AS TIMESTAMP))", sql)


def _plain(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", re.sub(r"US\(([\w.]+)\)", r"epoch_us(CAST(\1 AS TIMESTAMP))", sql))


def oracle(sql: str) -> str:
    """The query with its tables as common table expressions."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        if name in parts or name in derive.BASE:
            return
        if name == "obs":
            parts[name] = derive.OBS_SQL
        elif name == "steps":
            add("obs")
            parts[name] = detector.STEPS_SQL
        elif name == "hotels":
            parts[name] = derive.HOTELS_SQL
        elif name == "rooms":
            parts[name] = derive.ROOMS_SQL
        else:
            for n in _needs(TABLES[name]):
                add(n)
            parts[name] = f"{name} AS ({_plain(TABLES[name])})"

    for n in _needs(sql):
        add(n)
    head = "WITH RECURSIVE " + ",\n".join(parts.values()) + "\n" if parts else ""
    return head + _plain(sql)
