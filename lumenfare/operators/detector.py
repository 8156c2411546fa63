"""The change detector: a debounced state machine folded over each offer's observations.

One definition of a step, in two bindings. `fold_stream` runs it over sorted partitions, holding one key's state only, and
is what everything else uses: a key may have any number of observations. `fold` states it as a higher-order expression
inside the JVM; it collects a key's rows, so it is for keys of bounded length. `streaming.detector` keeps the step as
keyed state.

Thresholds are one set for all, or each observation's own: with `own_thresholds` its columns min_abs, min_pct and confirm
override the set where they are not null. `as_of` gives observations the settings of their target that held at their time,
so that floors vary by key and by time in either form.

Order within a key is (checked_at, event_id). Exact replays (same key and time) are dropped before the fold, so that a
replay changes nothing. Null prices of available offers neither confirm nor change anything.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequential import fold_sorted

NOTIFIABLE = ("changed", "became_unavailable", "became_available")


@dataclass(frozen=True)
class Thresholds:
    """Floors of a significant move (both must be reached) and how many checks confirm it."""

    min_abs: Decimal = Decimal("50")
    min_pct: Decimal = Decimal("2")
    confirm: int = 2


def delta(new: Column, old: Column) -> Column:
    return F.round(new - old, 2)


def percent(new: Column, old: Column) -> Column:
    """Percent change; against a baseline of zero 100, or 0 where the new price is 0 too."""
    return F.when(old == 0, F.when(new == 0, F.lit(0)).otherwise(F.lit(100)).cast("decimal(7,2)")).otherwise(F.round((new - old) / F.nullif(old, F.lit(0).cast("decimal(12,2)")) * 100, 2).try_cast("decimal(7,2)"))


OWN = ("min_abs", "min_pct", "confirm")


def as_of(obs: DataFrame, settings: DataFrame, target: str, time: str = "checked_at") -> DataFrame:
    """obs with OWN, the settings (target, since, *OWN) of their target that held at their time; null before the first and without any.

    A target's settings are a short history: each row meets those of its own target only, and of two that begin at one
    time the larger counts.
    """
    one = settings.groupBy(target, "since").agg(F.max(F.struct(*OWN)).alias("_own"))
    line = Window.partitionBy(target).orderBy("since")
    spans = one.select(F.col(target).alias("_target"), F.col("since").alias("_since"), F.lead("since").over(line).alias("_until"), "_own")
    holds = (F.col(target) == F.col("_target")) & (F.col(time) >= F.col("_since")) & (F.col("_until").isNull() | (F.col(time) < F.col("_until")))
    return obs.join(spans, holds, "left").select(*(obs[c] for c in obs.columns), *(F.col(f"_own.{c}").alias(c) for c in OWN))


def _floors(obs: DataFrame, t: Thresholds, own: bool) -> list[Column]:
    """OWN as columns of the set's types."""
    mine = lambda c, d, kind: F.coalesce(F.col(c).cast(kind), F.lit(str(d)).cast(kind)).alias(c) if own else F.lit(str(d)).cast(kind).alias(c)
    return [mine("min_abs", t.min_abs, "decimal(12,2)"), mine("min_pct", t.min_pct, "decimal(7,2)"), mine("confirm", t.confirm, "int")]


def _reaches(new: Column, old: Column, min_abs: Column, min_pct: Column) -> Column:
    share = F.when(old == 0, F.when(new == 0, F.lit(0.0)).otherwise(F.lit(100.0))).otherwise(F.abs((new - old).cast("double") / F.nullif(old, F.lit(0).cast("decimal(12,2)")).cast("double") * 100))
    return (F.abs(new - old) >= min_abs) & (F.round(share, 2) >= min_pct.cast("double"))


def significant(new: Column, old: Column, t: Thresholds) -> Column:
    return _reaches(new, old, F.lit(str(t.min_abs)).cast("decimal(12,2)"), F.lit(str(t.min_pct)).cast("decimal(7,2)"))


_STATE = "seen boolean, last decimal(12,2), avail boolean, pend decimal(12,2), n int, since timestamp, current decimal(12,2)"
_STEP = "event_id bigint, checked_at timestamp, outcome string, old_price decimal(12,2), new_price decimal(12,2), first_seen_at timestamp, last_price decimal(12,2), current_price decimal(12,2), is_available boolean, pending_count int"
_EMPTY = "named_struct('seen', false, 'last', cast(null as decimal(12,2)), 'avail', cast(null as boolean), 'pend', cast(null as decimal(12,2)), 'n', 0, 'since', cast(null as timestamp), 'current', cast(null as decimal(12,2)))"


#: Observations of one block of a fold. An aggregate copies all that it holds with each step, so that no step may hold a key's whole result.
BLOCK = 32


def _merge():
    """Two merges for F.aggregate: of a state alone, and of a state with a block's steps so far (state, steps)."""

    def outcome(s: Column, o: Column) -> Column:
        count = F.when(s["pend"] == o["price"], s["n"] + 1).otherwise(1)
        return (
            F.when(~s["seen"], "first_sight").when(s["avail"] & ~o["avail"], "became_unavailable").when(~s["avail"] & o["avail"], "became_available")
            .when(~o["avail"] | o["price"].isNull() | s["last"].isNull() | (o["price"] == s["last"]), "unchanged")
            .when(~_reaches(o["price"], s["last"], o["min_abs"], o["min_pct"]), "insignificant").when(count < o["confirm"], "pending").otherwise("changed")
        )

    def after(s: Column, o: Column, oc: Column) -> Column:
        held = F.when(oc.isin("first_sight", "became_available", "changed"), o["price"]).when((oc == "unchanged") & o["avail"], F.coalesce(s["last"], o["price"])).otherwise(s["last"])
        same = s["pend"] == o["price"]
        waits = oc == "pending"
        return F.struct(
            F.lit(True).alias("seen"), held.alias("last"), o["avail"].alias("avail"), F.when(waits, o["price"]).alias("pend"), F.when(waits, F.when(same, s["n"] + 1).otherwise(1)).otherwise(0).alias("n"),
            F.when(waits, F.when(same, s["since"]).otherwise(o["at"])).alias("since"), F.coalesce(o["price"], s["current"]).alias("current"),
        )

    def state_only(s: Column, o: Column) -> Column:
        return F.transform(F.array(outcome(s, o)), lambda oc: after(s, o, oc))[0]

    def with_steps(acc: Column, o: Column) -> Column:
        s = acc["state"]
        # One-element transforms bind the outcome and the new state to names.
        named = F.transform(F.array(outcome(s, o)), lambda oc: F.struct(oc.alias("oc"), after(s, o, oc).alias("next")))[0]
        return F.transform(
            F.array(named),
            lambda x: F.struct(
                x["next"].alias("state"),
                F.concat(
                    acc["steps"],
                    F.array(
                        F.struct(
                            o["event_id"].alias("event_id"), o["at"].alias("checked_at"), x["oc"].alias("outcome"), s["last"].alias("old_price"), o["price"].alias("new_price"),
                            F.when(x["oc"].isin(*NOTIFIABLE), F.coalesce(s["since"], o["at"])).otherwise(o["at"]).alias("first_seen_at"), x["next"]["last"].alias("last_price"), x["next"]["current"].alias("current_price"), o["avail"].alias("is_available"), x["next"]["n"].alias("pending_count"),
                        )
                    ),
                ).alias("steps"),
            ),
        )[0]

    return state_only, with_steps


def without_replays(obs: DataFrame, *more: Column) -> DataFrame:
    """One observation for each key and time, the one of the smallest event_id, with the columns `more` of it."""
    return obs.groupBy("offer_key", "checked_at").agg(F.min(F.struct("event_id", "price", "is_available", *more)).alias("x")).select("offer_key", "checked_at", "x.*")


def fold(obs: DataFrame, t: Thresholds = Thresholds(), price: str = "price", own_thresholds: bool = False) -> DataFrame:
    """(offer_key, event_id, checked_at, outcome, old_price, new_price, delta, delta_pct, first_seen_at, and the state after): a row for each observation.

    obs needs offer_key, checked_at, event_id, price and is_available; no rows give none.
    """
    floors = _floors(obs, t, own_thresholds)
    rows = without_replays(obs.withColumn("price", F.col(price)), *(floors if own_thresholds else ()))
    row = F.struct(F.col("checked_at").alias("at"), "event_id", F.col("price").cast("decimal(12,2)").alias("price"), F.coalesce("is_available", F.lit(False)).alias("avail"), *(OWN if own_thresholds else floors))
    kind = f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in _split(_STEP))}>>"
    empty, states = F.expr(_EMPTY), f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in _split(_STATE))}>>"
    state_only, with_steps = _merge()
    # A key's rows in blocks; then each block's state at its beginning; then each block's steps from there.
    gathered = rows.groupBy("offer_key").agg(F.array_sort(F.collect_list(row)).alias("all"))
    blocks = gathered.select("offer_key", F.transform(F.sequence(F.lit(0), F.expr(f"(size(all) - 1) div {BLOCK}").cast("int")), lambda b: F.slice("all", b * BLOCK + 1, BLOCK)).alias("blocks"))
    begun = lambda acc, block: F.struct(F.aggregate(block, acc["state"], state_only).alias("state"), F.concat(acc["begun"], F.array(acc["state"])).alias("begun"))
    known = blocks.withColumn("begun", F.aggregate("blocks", F.struct(empty.alias("state"), F.expr(f"cast(array() as {states})").alias("begun")), begun, lambda acc: acc["begun"]))
    walked = F.zip_with("blocks", "begun", lambda block, s: F.aggregate(block, F.struct(s.alias("state"), F.expr(f"cast(array() as {kind})").alias("steps")), with_steps, lambda acc: acc["steps"]))
    steps = known.select("offer_key", F.flatten(walked).alias("steps"))
    out = steps.select("offer_key", F.inline("steps"))
    return with_deltas(out)


def fold_rebased(obs: DataFrame, basis: str, t: Thresholds = Thresholds()) -> DataFrame:
    """The fold where a price's basis (with or without tax) may change: a new basis starts the offer anew, as a first sight."""
    line = Window.partitionBy("offer_key").orderBy("checked_at", "event_id")
    turned = (~F.col(basis).eqNullSafe(F.lag(basis).over(line))).cast("int")
    parts = obs.withColumn("_turned", turned).withColumn("offer_key", F.concat("offer_key", F.lit("#"), F.sum("_turned").over(line).cast("string")))
    return fold_stream(parts, t).withColumn("offer_key", F.regexp_replace("offer_key", r"#\d+$", ""))


def _split(schema: str) -> list[str]:
    out, depth, word = [], 0, ""
    for ch in schema:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(word.strip())
            word = ""
        else:
            word += ch
    return [*out, word.strip()]


def with_deltas(steps: DataFrame) -> DataFrame:
    """Signed delta and percent of priced changes, and the direction."""
    priced = F.col("outcome").isin("changed", "became_available") & F.col("old_price").isNotNull() & F.col("new_price").isNotNull()
    d = F.when(priced, delta(F.col("new_price"), F.col("old_price")).cast("decimal(12,2)"))
    way = F.when(F.col("outcome") == "changed", F.when(F.col("new_price") > F.col("old_price"), "increase").otherwise("decrease")).when(F.col("outcome").isin(*NOTIFIABLE), F.col("outcome"))
    return steps.select("*", d.alias("delta"), F.when(priced, percent(F.col("new_price"), F.col("old_price"))).alias("delta_pct"), way.alias("direction"))


def changes(obs: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The steps that are told to people."""
    return fold_stream(obs, t).where(F.col("outcome").isin(*NOTIFIABLE))


@dataclass(frozen=True)
class State:
    """One offer's state between observations."""

    last: Decimal | None = None
    avail: bool | None = None
    pend: Decimal | None = None
    n: int = 0
    since: object = None
    current: Decimal | None = None


def step(s: State | None, price: Decimal | None, avail: bool, at: object, t: Thresholds) -> tuple[str, State]:
    """The same step in Python: outcome and state after."""
    current = price if price is not None else (s.current if s else None)
    calm = dict(pend=None, n=0, since=None, current=current, avail=avail)
    if s is None:
        return "first_sight", State(price, avail, current=current)
    if s.avail != avail:
        return ("became_available", replace(s, **calm | {"last": price})) if avail else ("became_unavailable", replace(s, **calm))
    if not avail:
        return "unchanged", replace(s, **calm)
    if price is None or s.last is None or price == s.last:
        return "unchanged", replace(s, **calm | {"last": s.last if s.last is not None else price})
    moved = abs(price - s.last)
    share = Decimal(100 if price else 0) if not s.last else abs(price - s.last) * 100 / s.last
    if moved < t.min_abs or share.quantize(Decimal("0.01"), ROUND_HALF_UP) < t.min_pct:
        return "insignificant", replace(s, **calm)
    same = s.pend == price
    n = s.n + 1 if same else 1
    if n < t.confirm:
        return "pending", replace(s, pend=price, n=n, since=s.since if same else at, current=current, avail=avail)
    return "changed", replace(s, **calm | {"last": price})


def fold_stream(obs: DataFrame, t: Thresholds = Thresholds(), own_thresholds: bool = False) -> DataFrame:
    """As fold, for keys of any length: partitions sorted by key and time, one key's state held at a time."""
    own = OWN if own_thresholds else ()
    rows = without_replays(obs, *(_floors(obs, t, True) if own else ())).select("offer_key", "checked_at", "event_id", F.col("price").cast("decimal(12,2)").alias("price"), F.coalesce("is_available", F.lit(False)).alias("is_available"), *own)

    def walk(before: State | None, at: object, event: int, price: Decimal | None, avail: bool, *floors) -> tuple[State, tuple]:
        outcome, after = step(before, price, avail, at, Thresholds(*floors) if floors else t)
        since = (before.since or at) if before and outcome in NOTIFIABLE else at
        return after, (event, at, outcome, before.last if before else None, price, since, after.last, after.current, avail, after.n)

    return with_deltas(fold_sorted(rows, "offer_key", ["checked_at", "event_id"], walk, _STEP))


#: The fold for a plain SQL engine: a recursion over each offer's observations in order.
STEPS_SQL = """ordered AS (
  SELECT *, row_number() OVER (PARTITION BY offer_key ORDER BY checked_at, event_id) AS k FROM (
    SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY offer_key, checked_at ORDER BY event_id) = 1)),
walk AS (
  SELECT offer_key, k, event_id, checked_at, 'first_sight' AS outcome, CAST(NULL AS DOUBLE) AS old_price, price AS new_price, checked_at AS first_seen_at,
         price AS last_price, is_available, CAST(NULL AS DOUBLE) AS pend, 0 AS n, CAST(NULL AS TIMESTAMP) AS since, price AS current_price
  FROM ordered WHERE k = 1
  UNION ALL
  SELECT offer_key, k, event_id, checked_at, outcome, s_last, price, CASE WHEN outcome IN ('changed', 'became_unavailable', 'became_available') THEN coalesce(s_since, checked_at) ELSE checked_at END,
         CASE WHEN outcome IN ('became_available', 'changed') THEN price WHEN outcome = 'unchanged' AND is_available THEN coalesce(s_last, price) ELSE s_last END,
         is_available, CASE WHEN outcome = 'pending' THEN price END, CASE WHEN outcome = 'pending' THEN CASE WHEN s_pend = price THEN s_n + 1 ELSE 1 END ELSE 0 END,
         CASE WHEN outcome = 'pending' THEN CASE WHEN s_pend = price THEN s_since ELSE checked_at END END, coalesce(price, s_current)
  FROM (
    SELECT o.*, w.last_price AS s_last, w.pend AS s_pend, w.n AS s_n, w.since AS s_since, w.current_price AS s_current,
      CASE WHEN w.is_available AND NOT o.is_available THEN 'became_unavailable' WHEN NOT w.is_available AND o.is_available THEN 'became_available'
           WHEN NOT o.is_available OR o.price IS NULL OR w.last_price IS NULL OR o.price = w.last_price THEN 'unchanged'
           WHEN abs(o.price - w.last_price) < 50 OR round(abs(CASE WHEN w.last_price = 0 THEN CASE WHEN o.price = 0 THEN 0 ELSE 100 END ELSE (o.price - w.last_price) / w.last_price * 100 END), 2) < 2 THEN 'insignificant'
           WHEN CASE WHEN w.pend = o.price THEN w.n + 1 ELSE 1 END < 2 THEN 'pending' ELSE 'changed' END AS outcome
    FROM walk w JOIN ordered o ON o.offer_key = w.offer_key AND o.k = w.k + 1)),
steps AS (
  SELECT *, CASE WHEN outcome IN ('changed', 'became_available') THEN new_price - old_price END AS delta,
         CASE WHEN outcome IN ('changed', 'became_available') THEN CASE WHEN old_price = 0 THEN CASE WHEN new_price = 0 THEN 0 ELSE 100 END ELSE round((new_price - old_price) / old_price * 100, 2) END END AS delta_pct,
         CASE WHEN outcome = 'changed' THEN CASE WHEN new_price > old_price THEN 'increase' ELSE 'decrease' END WHEN outcome IN ('became_unavailable', 'became_available') THEN outcome END AS direction
  FROM walk)"""
