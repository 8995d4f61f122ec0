"""An exact limit of a rate over a stream, with state that ends by itself."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@contextmanager
def lasting_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start within have their state in RocksDB, which state that ends by itself needs; the session's own choice comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def over_any(events: DataFrame, time: str, key: str, id_col: str, most: int = 120, seconds: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """Events with which a key has more than ``most`` in the time up to and with them (key, id, at, n).

    Any span of so many seconds counts, both ends inside, not fixed windows:
    an event is judged once the watermark has passed it, in the order of
    times, by the events of its key that it may count.  Events of one moment
    count for each other.  Rows later than ``late`` behind the newest are left
    out, as in any watermark, and what the watermark hasn't passed when a
    stream ends isn't judged.  Repeated rows count each; a null key is a key, a
    null time is left out.  A key's state holds the times of the last span and
    what waits; a timer at the oldest of these ends it.  Needs the RocksDB
    state store.
    """
    schema = events.schema
    micros = int(seconds * 1_000_000)
    kind = T.StructType([T.StructField(key, schema[key].dataType), T.StructField("id", schema[id_col].dataType), T.StructField("at", T.LongType()), T.StructField("n", T.LongType())])
    waiting_kind = T.StructType([T.StructField("at", T.LongType()), T.StructField("id", schema[id_col].dataType)])

    class Judge(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", waiting_kind)
            self.recent = handle.getListState("recent", "at long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            passed = timerValues.getCurrentWatermarkInMs() * 1000  # 0 before there is one
            came = [(int(at), i) for some in rows for i, at in zip(some.iloc[:, 1], some.iloc[:, 2]) if not passed or at >= passed]  # the key is the first
            if came:
                self.waiting.appendList(came)
                self._wake(min(at for at, _ in came))
            yield pd.DataFrame([], columns=kind.names, dtype=object)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            waiting = sorted(((int(at), i) for at, i in self.waiting.get()), key=lambda x: x[0])
            recent = sorted(int(x[0]) for x in self.recent.get())
            ready = bisect.bisect_left(waiting, passed, key=lambda x: x[0])
            times = sorted(recent + [at for at, _ in waiting[:ready]])
            out = []
            for at, i in waiting[:ready]:
                n = bisect.bisect_right(times, at) - bisect.bisect_left(times, at - micros)
                if n > most:
                    out.append((*key, i, at, n))
            left, kept = waiting[ready:], times[bisect.bisect_left(times, passed - micros) :]
            self.waiting.put(left) if left else self.waiting.clear()
            self.recent.put([(at,) for at in kept]) if kept else self.recent.clear()
            if left:
                self._wake(left[0][0])
            elif kept:
                self._wake(kept[-1] + micros)
            yield pd.DataFrame(out, columns=kind.names, dtype=object)

        def _wake(self, at: int) -> None:
            """A timer for once the watermark is past a time."""
            self.handle.registerTimer(at // 1000 + 1)

    when = F.col(time).cast("timestamp")
    rows = events.filter(F.col(time).isNotNull()).select(F.col(key), F.col(id_col).alias("item"), F.unix_micros(when).alias("micros"), when.alias("moment")).withWatermark("moment", late)
    judged = rows.groupBy(key).transformWithStateInPandas(statefulProcessor=Judge(), outputStructType=kind, outputMode="Append", timeMode="EventTime")
    return judged.select(key, "id", F.timestamp_micros("at").alias("at"), "n")
