"""Stateful jobs with timers: sessions that close at a deadline, and records that are forgotten after a while.

Both keep their state in Spark's state store by key, so a job that is started again with
its checkpoint goes on where the last batch ended, and each deadline fires once.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scrivane.streaming.jobs import source, to_table

_PROVIDER, _EMPTY = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SESSION = "key bigint, number bigint, first_us bigint, last_us bigint, events bigint, value double"


@contextlib.contextmanager
def state_in_rocks(spark: SparkSession, empty_batches: bool = True):
    """The state store that timers need, for the queries started inside.

    By processing time a batch without rows may follow for ever, so a job that is to end
    does without them.
    """
    wanted = {_PROVIDER: _ROCKS, _EMPTY: str(empty_batches).lower()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: An open session; `known` counts the values that are not null.
_OPEN = np.dtype([("first_us", "<i8"), ("last_us", "<i8"), ("events", "<i8"), ("known", "<i8"), ("value", "<f8")])


class Sessions(StatefulProcessor):
    """Events of a key whose distance is `gap_us` or less are one session; it is written when the watermark has passed its last event by that much.

    A key's state is one value: how many sessions were written, its one timer (the next
    deadline, 0 for none), and the open sessions as packed rows, as events may come in any
    order before the watermark. Each call reads it once and writes it once, since every
    access to the state store is a message to the JVM, and every row of a list one more
    entry of the store.
    """

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sessions", "written bigint, timer bigint, open binary")

    def _read(self) -> tuple[int, int, list[tuple]]:
        held = self.state.get()
        return (0, 0, []) if held is None else (held[0], held[1], np.frombuffer(bytes(held[2]), _OPEN).tolist())

    def _keep(self, written: int, timer: int, sessions: list[tuple]) -> None:
        """Hold the open sessions, and a timer for the first of their deadlines in place of `timer`."""
        wanted = (min(s[1] for s in sessions) + self.gap) // 1000 + 1 if sessions else 0
        if wanted != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if wanted:
                self.handle.registerTimer(wanted)
        self.state.update((written, wanted, np.array(sessions, _OPEN).tobytes()))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        written, timer, sessions = self._read()
        for r in rows:
            us, value = r["us"], r["value"]
            sessions.append((us, us, 1, 0, 0.0) if value is None else (us, us, 1, 1, value))
        sessions.sort()
        merged: list[tuple] = []
        for s in sessions:
            if merged and s[0] - merged[-1][1] <= self.gap:
                a = merged[-1]
                merged[-1] = (a[0], max(a[1], s[1]), a[2] + s[2], a[3] + s[3], a[4] + s[4])
            else:
                merged.append(s)
        self._keep(written, timer, merged)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        written, _, sessions = self._read()
        left = []
        for s in sorted(sessions):
            if s[1] + self.gap < now:
                written += 1
                yield Row(key=key[0], number=written, first_us=s[0], last_us=s[1], events=s[2], value=s[4] if s[3] else None)
            else:
                left.append(s)
        self._keep(written, 0, left)  # the timer that ran out is gone

    def close(self) -> None:
        pass


def timed_sessions(spark: SparkSession, path: str, gap_seconds: int, late: str = "0 seconds", key: str = "user_id", ts: str = "ts", value: str = "value", out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """(SESSION): the sessions that are over by the watermark, read from where they were written."""
    at = F.col(ts).cast("timestamp")
    rows = source(spark, path).select(F.col(key).alias("key"), at.alias("at"), F.unix_micros(at).alias("us"), F.col(value).alias("value")).where("key IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    done = rows.groupBy("key").transformWithState(Sessions(gap_seconds * 1_000_000), outputStructType=SESSION, outputMode="append", timeMode="eventTime")
    with state_in_rocks(spark):
        return spark.read.schema(SESSION).parquet(to_table(done, "sessions", out, checkpoint))


class Recent(StatefulProcessor):
    """The first row of each value of a key; a value that was not met for `ttl_ms` is forgotten, and then first again."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "item string", "n bigint", self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            item = (r["item"],)
            known = self.seen.containsKey(item)
            self.seen.updateValue(item, ((self.seen.getValue(item)[0] if known else 0) + 1,))
            if not known:
                yield Row(key=key[0], item=r["item"])

    def close(self) -> None:
        pass


def first_of_each(stream: DataFrame, key: str, item: str, ttl_ms: int, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """(key, item): each item once for as long as it is remembered."""
    spark = stream.sparkSession
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(item).cast("string").alias("item"))
    done = rows.groupBy("key").transformWithState(Recent(ttl_ms), outputStructType="key string, item string", outputMode="append", timeMode="processingTime")
    with state_in_rocks(spark, empty_batches=False):
        return spark.read.schema("key string, item string").parquet(to_table(done, "first-of-each", out, checkpoint))


def with_progress(spark: SparkSession, run) -> tuple[object, DataFrame]:
    """(what run() gives, a row for each batch of the streams that ran meanwhile: query, batch, rows, seconds, state rows)."""
    from pyspark.sql.streaming import StreamingQueryListener

    held: list[tuple] = []

    class Watch(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            p = event.progress
            held.append((str(p.id), p.batchId, sum(s.numInputRows for s in p.sources), p.batchDuration / 1000, sum(o.numRowsTotal for o in p.stateOperators)))

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    watch = Watch()
    spark.streams.addListener(watch)
    try:
        result = run()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(watch)
    return result, spark.createDataFrame(held, "query string, batch bigint, rows bigint, seconds double, state_rows bigint")
