import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quaestor.operators.quota import Limits, decisions, hourly_use, window_quota
from quaestor.operators.running import running
from quaestor.streaming.quota_stream import run_available

SCHEMA = "event_id bigint, ts timestamp, session string, ip string, paid boolean, kind string, reserved_at timestamp, reservation_id bigint"
START = datetime(2024, 1, 1)


def made_up(seed, n=400, roaming=False):
    rng = random.Random(seed)
    rows, when, reserved = [], START, []
    for i in range(n):
        when += timedelta(seconds=rng.randint(1, 240))
        if reserved and rng.random() < 0.2:
            r = rng.choice(reserved[-6:])
            rows.append((i, when, r[2], r[3], r[4], "release", r[1], r[0]))
            continue
        session = f"s{rng.randint(0, 5)}"
        ip = f"i{rng.randint(0, 2)}" if roaming else f"i{int(session[1:]) % 3}"
        row = (i, when, session, ip, rng.random() < 0.6, "reserve", None, None)
        rows.append(row)
        reserved.append(row)
    return rows


def by_hand(rows, limits):
    """The rules applied one event after the other to shared counters."""
    used, grant = {}, {}
    for event, ts, session, ip, paid, kind, reserved_at, reservation in rows:
        at = ts if kind == "reserve" else reserved_at
        hour, day = at.strftime("%Y-%m-%d-%H"), at.strftime("%Y-%m-%d")
        hourly = {("s", session, hour): min(limits.session_hourly, 100), ("ip", ip, hour): limits.ip_hourly}
        daily = {("ai", day): min(limits.daily_ai, 10000), ("ai-ip", ip, day): min(limits.ip_daily_ai, 1000)}
        if kind == "reserve":
            if any(used.get(k, 0) >= cap for k, cap in hourly.items()):
                grant[event] = "refuse"
                continue
            for k in hourly:
                used[k] = used.get(k, 0) + 1
            grant[event] = "extraits"
            if paid and all(used.get(k, 0) < cap for k, cap in daily.items()):
                for k in daily:
                    used[k] = used.get(k, 0) + 1
                grant[event] = "ia"
        elif -timedelta(minutes=1) <= ts - reserved_at <= timedelta(minutes=10):
            counted = grant.get(reservation)
            done = used.setdefault("released", set())
            if counted in (None, "refuse") or reservation in done:
                continue
            done.add(reservation)
            for k in [*hourly, *(daily if counted == "ia" else [])]:
                used[k] -= 1
    return grant


def test_decisions_match_a_replay_of_the_rules(spark):
    for seed, roaming in ((1, False), (2, True), (3, True)):
        rows = made_up(seed, roaming=roaming)
        limits = Limits(session_hourly=3, daily_ai=12, ip_daily_ai=5, ip_hourly=6)
        got = {r.event_id: r.grant for r in decisions(spark.createDataFrame(rows, SCHEMA), limits).collect()}
        assert got == by_hand(rows, limits)


def test_exhausted_ai_budget_falls_back_to_extracts(spark):
    rows = [(i, START + timedelta(seconds=i), f"session-{i}", "203.0.113.7", True, "reserve", None, None) for i in range(3)]
    got = decisions(spark.createDataFrame(rows, SCHEMA), Limits(ip_daily_ai=2)).orderBy("event_id").collect()
    assert [r.grant for r in got] == ["ia", "ia", "extraits"]
    refused = decisions(spark.createDataFrame(rows, SCHEMA), Limits(daily_ai=0)).collect()
    assert {r.grant for r in refused} == {"refuse"}


def test_hourly_use_accepts_the_first_ones(spark):
    rows = [r for r in made_up(5) if r[5] == "reserve"]
    got = {r.event_id: r.accepted for r in hourly_use(spark.createDataFrame(rows, SCHEMA), "session", 2).collect()}
    seen, expected = {}, {}
    for row in rows:
        key = (row[2], row[1].strftime("%Y%m%d%H"))
        seen[key] = seen.get(key, 0) + 1
        expected[row[0]] = seen[key] <= 2
    assert got == expected


def test_window_starts_at_first_use(spark):
    rows = [(i, START + timedelta(minutes=m), "s", "i", False, "reserve", None, None) for i, m in enumerate((50, 70, 100, 111, 115))]
    got = {r.event_id: r.accepted for r in window_quota(spark.createDataFrame(rows, SCHEMA), 2, 10, 3600).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True}


def test_running_values_do_not_depend_on_the_slices(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, rng.randint(-5, 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, n int, x int")

    def values(chunk):
        out = running(df, ["k"], F.floor(F.col("n") / chunk), ["n"], sums={"s": F.col("x")}, maxima={"m": F.col("x")})
        return sorted(map(tuple, out.collect()))

    sums, best, expected = {}, {}, []
    for k, n, x in rows:
        sums[k] = sums.get(k, 0) + x
        best[k] = max(best.get(k, x), x)
        expected.append((k, n, x, sums[k], best[k]))
    assert values(7) == values(1000) == sorted(expected)


def test_stream_takes_the_decisions_of_the_batch(spark, tmp_path):
    rows = made_up(9, n=150)
    limits = Limits(session_hourly=3, daily_ai=12, ip_daily_ai=5, ip_hourly=6)
    source = str(tmp_path / "events")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    out = run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"), limits)
    assert {r.event_id: r.grant for r in out.collect()} == by_hand(rows, limits)


def test_only_linked_addresses_are_replayed_together(spark):
    from quaestor.operators.quota import _components

    pairs = [(f"s{i}", f"i{i}") for i in range(12)] + [(f"s{i}", f"i{i + 1}") for i in range(5)] + [("s8", "i9"), (None, "i0"), ("s11", None)]
    rows = [(i, START + timedelta(seconds=i), s, ip, True, "reserve", None, None) for i, (s, ip) in enumerate(pairs)]
    found = _components(spark.createDataFrame(rows, SCHEMA), F.lit("p")).collect()
    assert len(found) == len(rows)
    groups = {}
    for r in found:
        groups.setdefault(r.component, set()).add(r.ip)
    assert sorted(sorted(x) for x in groups.values() if None not in x) == sorted([[f"i{i}" for i in range(6)], ["i6"], ["i7"], ["i8", "i9"], ["i10"], ["i11"]])


def test_long_windows_of_many_sessions(spark):
    rng = random.Random(8)
    rows = [(i, START + timedelta(seconds=40 * i + rng.randint(0, 39)), f"s{rng.randint(0, 9)}", f"i{rng.randint(0, 3)}", False, "reserve", None, None) for i in range(400)]
    counters, expected = {}, {}
    for event, at, session, ip, *_ in rows:
        caps = {session: 3, ip: 8}
        for name in caps:
            if name in counters and counters[name][1] <= at:
                del counters[name]
        expected[event] = all(counters.get(name, (0,))[0] < cap for name, cap in caps.items())
        for name in caps if expected[event] else ():
            used, end = counters.get(name, (0, at + timedelta(hours=1)))
            counters[name] = used + 1, end
    got = {r.event_id: r.accepted for r in window_quota(spark.createDataFrame(rows, SCHEMA), 3, 8, 3600).collect()}
    assert got == expected
