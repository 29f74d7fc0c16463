"""Hourly binning over an event stream.

``hourly_stream`` is the plain windowed form. ``hourly_states`` keeps the state itself: it gives the same rows as the batch bins,
reports late events instead of dropping them unseen, and closes its last hours when the stream is flushed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cohortspark.config import ConceptRule
from cohortspark.operators.events import order_key


def hourly_stream(
    events: DataFrame, rules: Sequence[ConceptRule], lateness: str = "2 hours"
) -> DataFrame:
    """Streaming form of the hourly bins: one row per stay, feature and closed hour.

    State is kept per (hour, stay, feature) and dropped once the watermark passes the
    hour. Every statistic the rules can ask for is an algebraic aggregate, so the state
    of one key has a fixed size however many events it gets.
    """
    wanted = events.filter(F.col("feature").isin(*[r.feature for r in rules]))
    v = F.col("value")
    order = order_key(events, ("ts", "event_id"))
    binned = (
        wanted.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 hour").alias("w"), "stay_id", "feature")
        .agg(
            F.avg(v).alias("mean"), F.sum(v).alias("sum"), F.max(v).alias("max"), F.min(v).alias("min"),
            F.max_by(v, order).alias("last"), F.min_by(v, order).alias("first"),
            F.max((v != 0).cast("double")).alias("any"), F.count(v).alias("n"),
        )
    )
    chosen = None
    for r in rules:
        hit = F.col("feature") == r.feature
        chosen = F.when(hit, F.col(r.agg)) if chosen is None else chosen.when(hit, F.col(r.agg))
    return binned.select(
        "stay_id", F.col("w.start").alias("hour_start"), "feature", chosen.alias("value"), "n"
    )


def run_to_folder(
    stream: DataFrame, path: str, checkpoint: str, per_batch: Callable | None = None,
    available_now: bool = True,
):
    """Append the closed hours of each micro-batch to a folder.

    ``foreachBatch`` writes into a folder named after the batch, in overwrite mode, so a
    batch that is run again after a failure replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        out = per_batch(batch) if per_batch else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.outputMode("append").foreachBatch(write)
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


# --- own state, late rows and a flush -------------------------------------------------------

HOUR_MS = 3_600_000
#: what is kept of a feature's values in an hour: enough for every statistic a rule can ask for
CELL = "n bigint, total double, low double, high double, some boolean, first_ts bigint, first_id bigint, first double, last_ts bigint, last_id bigint, last double"
OUT = "stay_id bigint, hour_start timestamp, feature string, value double, n bigint, late boolean, event_id bigint"


class HourlyBins(StatefulProcessor):
    """Per stay the open hours as cells (hour, feature); a timer at the end of each hour closes it.

    An event of an hour that is closed is given out as a late row of its own, with its value and id. State of a stay
    is bounded by its open hours and the rules.
    """

    def __init__(self, rules: Sequence[ConceptRule]):
        self.rules = {r.feature: r.agg for r in rules}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "hour bigint, feature string", CELL)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs()
        held: dict[tuple[int, str], list] = {}
        late = []
        for pdf in rows:
            for ts, event_id, feature, value in pdf[["ms", "event_id", "feature", "value"]].itertuples(index=False):
                if feature not in self.rules:
                    continue
                hour = int(ts) // HOUR_MS * HOUR_MS
                if hour + HOUR_MS <= closed:
                    late.append((key[0], pd.Timestamp(hour, unit="ms"), feature, value, 1, True, int(event_id)))
                    continue
                at = (hour, feature)
                if at not in held:
                    held[at] = list(self.cells.getValue(at)) if self.cells.containsKey(at) else [0, 0.0, None, None, False, None, None, None, None, None, None]
                add(held[at], int(ts), int(event_id), value)
        for at, cell in held.items():
            self.cells.updateValue(at, tuple(cell))
        for hour in {h for h, _ in held}:
            self.handle.registerTimer(hour + HOUR_MS)
        if late:
            yield self.frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        done = [(at, cell) for at, cell in self.cells.iterator() if at[0] + HOUR_MS == end]
        out = []
        for (hour, feature), cell in done:
            out.append((key[0], pd.Timestamp(hour, unit="ms"), feature, value_of(tuple(cell), self.rules[feature]), cell[0], False, None))
            self.cells.removeKey((hour, feature))
        if out:
            yield self.frame(out)

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["stay_id", "hour_start", "feature", "value", "n", "late", "event_id"])
        return out.astype({"event_id": "Int64", "value": "float64"})

    def close(self) -> None:
        pass


def add(cell: list, ts: int, event_id: int, value) -> None:
    """Take a value into a cell; missing ones count for nothing."""
    if value is None or value != value:
        return
    cell[0] += 1
    cell[1] += value
    cell[2] = value if cell[2] is None else min(cell[2], value)
    cell[3] = value if cell[3] is None else max(cell[3], value)
    cell[4] = bool(cell[4] or value != 0)
    if cell[5] is None or (ts, event_id) < (cell[5], cell[6]):
        cell[5:8] = [ts, event_id, value]
    if cell[8] is None or (ts, event_id) > (cell[8], cell[9]):
        cell[8:11] = [ts, event_id, value]


def value_of(cell: Sequence, agg: str) -> float | None:
    n, total, low, high, some, _, _, first, _, _, last = cell
    if not n:
        return None
    return float({"mean": total / n, "sum": total, "min": low, "max": high, "any": float(some), "first": first, "last": last}[agg])


def hourly_states(events: DataFrame, rules: Sequence[ConceptRule], lateness: str = "2 hours") -> DataFrame:
    """(stay_id, hour_start, feature, value, n, late, event_id): closed hours, and late events (``late``) as rows of their own.

    Events of other features only move the watermark, so one of them, later than all others by more than ``lateness``
    and an hour, flushes the stream (``write_flush``). Needs the state store that keeps timers: ``STATE_STORE``. Times are
    told apart to the millisecond and by event id.
    """
    # no filter by feature: it would be pushed in front of the watermark; without ts, as Spark drops late rows by that column
    rows = events.withWatermark("ts", lateness).select(
        "stay_id", F.unix_millis("ts").alias("ms"), F.col("event_id").cast("bigint").alias("event_id"), "feature", F.col("value").cast("double").alias("value")
    )
    return rows.groupBy("stay_id").transformWithStateInPandas(HourlyBins(rules), OUT, "Append", "EventTime")


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
FLUSH = "__flush__"


def write_flush(spark: SparkSession, events: DataFrame, folder: str, last: datetime, lateness: timedelta) -> None:
    """Append the event that closes all hours up to ``last`` to the stream's folder; ``events`` gives the schema."""
    at = last + lateness + timedelta(hours=2)
    given = {"ts": F.lit(at).cast("timestamp"), "feature": F.lit(FLUSH)}
    row = spark.range(1).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields])
    row.coalesce(1).write.mode("append").parquet(folder)


def batch_rows(events: DataFrame, rules: Sequence[ConceptRule]) -> DataFrame:
    """The rows that ``hourly_states`` closes, from events at rest: stay_id, hour_start, feature, value, n."""
    v, order = F.col("value"), order_key(events, ("ts", "event_id"))
    per = events.filter(F.col("feature").isin(*[r.feature for r in rules])).groupBy(
        "stay_id", F.date_trunc("hour", "ts").alias("hour_start"), "feature"
    ).agg(
        F.avg(v).alias("mean"), F.sum(v).alias("sum"), F.max(v).alias("max"), F.min(v).alias("min"),
        F.max_by(v, F.when(v.isNotNull(), order)).alias("last"), F.min_by(v, F.when(v.isNotNull(), order)).alias("first"),
        F.max((v != 0).cast("double")).alias("any"), F.count(v).alias("n"),
    )
    chosen = F.lit(None)
    for r in rules:
        chosen = F.when(F.col("feature") == r.feature, F.col(r.agg)).otherwise(chosen)
    return per.select("stay_id", "hour_start", "feature", chosen.cast("double").alias("value"), "n")
