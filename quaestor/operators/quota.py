"""Usage quotas: hourly session and address counters, daily counters of AI answers.

Events: event_id, ts, session, ip, paid, kind ('reserve' | 'release'),
reserved_at and reservation_id (releases only). Hourly decisions never depend on
the daily counters, so reservations are decided in two stages: first per hour,
then, for accepted paid ones, per day. Within an hour only records that share an
address or a session depend on each other; each such group is replayed in
order, one row at a time, with a state of counters only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.fixed_values import (
    DAILY_AI_LIMIT,
    DAILY_AI_MAX,
    IP_DAILY_AI_LIMIT,
    IP_DAILY_AI_MAX,
    IP_HOURLY_LIMIT,
    SESSION_HOURLY_LIMIT,
    SESSION_HOURLY_MAX,
)
from quaestor.functions.records import day_stamp, hour_stamp
from quaestor.operators.linking import linked_groups
from quaestor.operators.running import ordered_fold

EARLIEST_RELEASE = "INTERVAL 10 MINUTES"
LATEST_RELEASE = "INTERVAL 1 MINUTE"


@dataclass(frozen=True)
class Limits:
    session_hourly: int = SESSION_HOURLY_LIMIT
    daily_ai: int = DAILY_AI_LIMIT
    ip_daily_ai: int = IP_DAILY_AI_LIMIT
    ip_hourly: int = IP_HOURLY_LIMIT

    @property
    def valid(self) -> bool:
        return min(self.session_hourly, self.daily_ai, self.ip_daily_ai) >= 1


@dataclass
class Counters:
    """Uses per counter and the reservations still counted."""

    used: dict[str, int] = field(default_factory=dict)
    granted: set[int] = field(default_factory=set)

    def reserve(self, reservation: int, caps: dict[str, int]) -> bool:
        """Counts one use everywhere, or nothing when a counter is at its cap."""
        if any(self.used.get(name, 0) >= cap for name, cap in caps.items()):
            return False
        for name in caps:
            self.used[name] = self.used.get(name, 0) + 1
        self.granted.add(reservation)
        return True

    def release(self, reservation: int, names: list[str]) -> bool:
        """Takes back a counted use; never creates a counter nor goes below zero."""
        if reservation not in self.granted:
            return False
        self.granted.discard(reservation)
        for name in names:
            if self.used.get(name, 0) > 0:
                self.used[name] -= 1
        return True


def hourly_caps(session: str, ip: str, limits: Limits) -> dict[str, int]:
    return {f"s:{session}": min(limits.session_hourly, SESSION_HOURLY_MAX), f"ip:{ip}": limits.ip_hourly}


def daily_caps(ip: str, limits: Limits) -> dict[str, int]:
    return {"ai": min(limits.daily_ai, DAILY_AI_MAX), f"ai-ip:{ip}": min(limits.ip_daily_ai, IP_DAILY_AI_MAX)}


def timely(events: DataFrame) -> DataFrame:
    """Without the releases that come too late or too early; ``at`` is the time of the reservation."""
    ts, reserved = F.col("ts"), F.col("reserved_at")
    in_time = reserved.between(ts - F.expr(EARLIEST_RELEASE), ts + F.expr(LATEST_RELEASE))
    return events.where((F.col("kind") == "reserve") | F.coalesce(in_time, F.lit(False))).withColumn(
        "at", F.when(F.col("kind") == "reserve", ts).otherwise(reserved)
    )


def _components(events: DataFrame, period: Column) -> DataFrame:
    """Adds ``period`` and ``component``: groups of events of a period that share no counter.

    A component is one address, or the addresses that sessions which use several in the period join, through any chain.
    """
    address = F.concat_ws("\u0001", "period", "ip")
    timed = events.withColumn("period", period).withColumn("_address", address)
    roaming = (
        timed.groupBy("period", "session")
        .agg(F.min("ip").alias("_a"), F.max("ip").alias("_b"))
        .where(F.col("_a") != F.col("_b"))
        .select("period", "session", F.concat_ws("\u0001", "period", "_a").alias("a"))
    )
    links = timed.join(roaming, ["period", "session"]).select("a", F.col("_address").alias("b")).distinct()
    groups = linked_groups(links).withColumnRenamed("key", "_address")
    return timed.join(groups, "_address", "left").withColumn("component", F.coalesce("root", "_address")).drop("root", "_address")


HOURLY_COLUMNS = "event_id bigint, micros bigint, session string, ip string, paid boolean, kind string, reservation_id bigint, period string, counted boolean"


def hourly_step(limits: Limits):
    """Decision of one event on the hourly counters."""

    def step(counters: Counters, row: tuple) -> list[tuple]:
        period, _, micros, event_id, session, ip, paid, kind, reservation = row
        caps = hourly_caps(session, ip, limits)
        if kind == "reserve":
            counted = limits.valid and counters.reserve(event_id, caps)
        else:
            counted = counters.release(int(reservation), list(caps))
        return [(event_id, micros, session, ip, paid, kind, reservation, period, counted)]

    return step


def daily_step(limits: Limits):
    """Decision of one accepted paid event on the daily AI counters."""

    def step(counters: Counters, row: tuple) -> list[tuple]:
        _, _, event_id, ip, kind, reservation = row
        caps = daily_caps(ip, limits)
        if kind == "reserve":
            return [(event_id, counters.reserve(event_id, caps))]
        counters.release(int(reservation), list(caps))
        return []

    return step


def decisions(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(event_id, grant) of every reservation: 'ia', 'extraits' or 'refuse'."""
    hourly_in = _components(timely(events), hour_stamp(F.col("at"))).select(
        "period",
        "component",
        F.unix_micros("ts").alias("micros"),
        "event_id",
        "session",
        "ip",
        "paid",
        "kind",
        F.coalesce("reservation_id", F.lit(-1)).alias("reservation_id"),
    )
    hourly = ordered_fold(
        hourly_in, ["period", "component"], ["micros", "event_id"], Counters, hourly_step(limits), HOURLY_COLUMNS
    )
    daily_in = hourly.where("counted AND paid").select(
        F.substring("period", 1, 10).alias("day"), "micros", "event_id", "ip", "kind", "reservation_id"
    )
    daily = ordered_fold(
        daily_in, ["day"], ["micros", "event_id"], Counters, daily_step(limits), "event_id bigint, ai boolean"
    )
    return hourly.where("kind = 'reserve'").join(daily, "event_id", "left").select(
        "event_id",
        F.when(~F.col("counted"), "refuse").when(F.coalesce("ai", F.lit(False)), "ia").otherwise("extraits").alias("grant"),
    )


def hourly_use(events: DataFrame, name: str, cap: int) -> DataFrame:
    """(event_id, accepted) of reservations on a single hourly counter, without releases.

    Only the first ``cap`` events of each counter and hour are kept by the window
    (in each partition, before the shuffle); all others are refused.
    """
    from pyspark.sql import Window as W

    reserve = events.where(F.col("kind") == "reserve").withColumn("hour", hour_stamp(F.col("ts")))
    order = W.partitionBy(name, "hour").orderBy("ts", "event_id")
    kept = reserve.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap)
    return reserve.select("event_id", name, "hour").join(
        kept.select("event_id", F.lit(True).alias("_ok")), "event_id", "left"
    ).select("event_id", F.col(name).alias("counter"), "hour", F.coalesce("_ok", F.lit(False)).alias("accepted"))


def counter_uses(events: DataFrame, granted: DataFrame) -> DataFrame:
    """(bucket, used) after all reservations, from their grants; released ones are not in ``granted``."""
    counted = events.join(granted.where(F.col("grant") != "refuse"), "event_id")
    ts = F.col("ts")
    hourly = F.array(F.concat_ws(":", F.lit("s"), "session", hour_stamp(ts)), F.concat_ws(":", F.lit("ip"), "ip", hour_stamp(ts)))
    daily = F.array(F.concat_ws(":", F.lit("ai"), day_stamp(ts)), F.concat_ws(":", F.lit("ai-ip"), "ip", day_stamp(ts)))
    buckets = F.when(F.col("grant") == "ia", F.concat(hourly, daily)).otherwise(hourly)
    return counted.select(F.explode(buckets).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("used"))


def window_quota(events: DataFrame, session_limit: int, ip_limit: int, window_seconds: int) -> DataFrame:
    """(event_id, accepted) when a counter's window starts at its first use instead of on the hour.

    Both counters are checked before either is incremented. Windows are equally long, so they end in the
    order in which they began: those that ended are dropped from the front, and the state holds one window's uses.
    """
    span = window_seconds * 1_000_000

    def step(buckets: dict, row: tuple) -> list[tuple]:
        _, _, micros, event_id, session, ip = row
        names = {f"session:{session}": session_limit, f"ip:{ip}": ip_limit}
        while buckets and next(iter(buckets.values()))[1] <= micros:
            del buckets[next(iter(buckets))]
        accepted = all(buckets.get(name, (0, 0))[0] < limit for name, limit in names.items())
        if accepted:
            for name in names:
                count, expires = buckets.get(name, (0, micros + span))
                buckets[name] = (count + 1, expires)
        return [(event_id, accepted)]

    reserve = _components(events.where(F.col("kind") == "reserve"), F.lit("all"))
    narrow = reserve.select("period", "component", F.unix_micros("ts").alias("micros"), "event_id", "session", "ip")
    return ordered_fold(
        narrow, ["period", "component"], ["micros", "event_id"], dict, step, "event_id bigint, accepted boolean"
    )
