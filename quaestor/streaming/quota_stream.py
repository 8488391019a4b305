"""The quota decisions on a stream of usage events, with keyed state.

Two chained stages as in the batch job: an hourly one keyed by reservation hour
and address, a daily one keyed by day. State expires by itself: two hours for
hourly counters, two days for daily ones. A session is expected to keep its
address within an hour; the batch job also covers sessions that change it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quaestor.functions.records import hour_stamp
from quaestor.operators.quota import Counters, Limits, daily_step, hourly_step, timely

HOURLY_TTL_MS = 2 * 3600 * 1000
DAILY_TTL_MS = 2 * 24 * 3600 * 1000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

HOURLY_OUTPUT = "event_id bigint, micros bigint, session string, ip string, paid boolean, kind string, reservation_id bigint, period string, counted boolean"
DAILY_OUTPUT = "event_id bigint, ai boolean"


class _CountersProcessor(StatefulProcessor):
    """Applies one decision step to the events of a key, in time order within a batch."""

    columns: list[str] = []
    output: list[str] = []
    ttl_ms = HOURLY_TTL_MS

    def __init__(self, step):
        self._step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("counters", "value string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counters = Counters()
        if self._state.exists():
            stored = json.loads(self._state.get()[0])
            counters = Counters(stored["used"], set(stored["granted"]))
        # The rows of one key in one micro-batch, whose size the source bounds.
        batch = pd.concat(list(rows)).sort_values(["micros", "event_id"])
        out: list[tuple] = []
        for row in batch[self.columns].itertuples(index=False, name=None):
            out.extend(self._step(counters, row))
        used = {name: n for name, n in counters.used.items() if n > 0}
        self._state.update((json.dumps({"used": used, "granted": sorted(counters.granted)}),))
        yield pd.DataFrame(out, columns=self.output)

    def close(self) -> None:
        pass


class HourlyProcessor(_CountersProcessor):
    columns = ["period", "component", "micros", "event_id", "session", "ip", "paid", "kind", "reservation_id"]
    output = [c.split()[0] for c in HOURLY_OUTPUT.split(", ")]


class DailyProcessor(_CountersProcessor):
    columns = ["day", "micros", "event_id", "ip", "kind", "reservation_id"]
    output = [c.split()[0] for c in DAILY_OUTPUT.split(", ")]
    ttl_ms = DAILY_TTL_MS


def hourly_decisions(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Stage one on a stream of usage events; append mode."""
    prepared = timely(events).select(
        hour_stamp(F.col("at")).alias("period"),
        F.concat(F.lit("ip:"), "ip").alias("component"),
        F.unix_micros("ts").alias("micros"),
        "event_id",
        "session",
        "ip",
        "paid",
        "kind",
        F.coalesce("reservation_id", F.lit(-1)).alias("reservation_id"),
    )
    return prepared.groupBy("period", "component").transformWithStateInPandas(
        HourlyProcessor(hourly_step(limits)), HOURLY_OUTPUT, outputMode="Append", timeMode="ProcessingTime"
    )


def daily_decisions(hourly: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Stage two on the output of stage one (read back from its sink); append mode."""
    prepared = hourly.where("counted AND paid").select(
        F.substring("period", 1, 10).alias("day"), "micros", "event_id", "ip", "kind", "reservation_id"
    )
    return prepared.groupBy("day").transformWithStateInPandas(
        DailyProcessor(daily_step(limits)), DAILY_OUTPUT, outputMode="Append", timeMode="ProcessingTime"
    )


def run_available(events: DataFrame, sink: str, checkpoint: str, limits: Limits = Limits()) -> DataFrame:
    """Runs both stages over what the source holds now and returns (event_id, grant) of its reservations."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # State that expires by processing time asks for empty batches for ever; a
    # run over what is available ends with the data.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")

    def drain(df: DataFrame, name: str) -> None:
        query = (
            df.writeStream.format("parquet")
            .option("path", f"{sink}/{name}")
            .option("checkpointLocation", f"{checkpoint}/{name}")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    drain(hourly_decisions(events, limits), "hourly")
    hourly = spark.read.parquet(f"{sink}/hourly")
    drain(daily_decisions(spark.readStream.schema(HOURLY_OUTPUT).parquet(f"{sink}/hourly"), limits), "daily")
    daily = spark.read.schema(DAILY_OUTPUT).parquet(f"{sink}/daily")
    return hourly.where("kind = 'reserve'").join(daily, "event_id", "left").select(
        "event_id",
        F.when(~F.col("counted"), "refuse").when(F.coalesce("ai", F.lit(False)), "ia").otherwise("extraits").alias("grant"),
    )
