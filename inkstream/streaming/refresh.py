"""Refresh times of pages as timers: each page is fetched when it is asked for and due, and again when its time comes.

State and timers belong to the page. What is asked is kept until the watermark has passed it and is then taken in order of
time, so the rows do not depend on the order in which they come, on the size of batches, or on where a query starts
again. Requests that come later than the watermark allows are dropped, as in every stream.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MINUTE = 60_000_000


class _Pages(StatefulProcessor):
    """State of a page: when it is due, when it was last asked for (microseconds), and requests still to be taken."""

    def __init__(self, key: str, ts: str, every: int, keep: int | None):
        self.key, self.ts, self.every, self.keep = key, ts, every * _MINUTE, None if keep is None else keep * _MINUTE

    def init(self, handle: StatefulProcessorHandle) -> None:
        moment = T.StructType([T.StructField("at", T.LongType())])
        self.handle = handle
        self.due, self.asked = handle.getValueState("due", moment), handle.getValueState("asked", moment)
        self.waiting = handle.getListState("waiting", moment)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [t.value // 1_000 for frame in rows for t in frame[self.ts].dropna()]
        return self._until(key, 1_000 * timerValues.getCurrentWatermarkInMs(), came)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._until(key, 1_000 * timerValues.getCurrentWatermarkInMs(), [])

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        told = [t.value // 1_000 for t in initialState["due"].dropna()]
        if told:
            self.due.update((max(told),))
            self.asked.update((max(told),))
            self.handle.registerTimer(-(-max(told) // 1_000))

    def _until(self, key: tuple, watermark: int, came: list[int]) -> Iterator[pd.DataFrame]:
        """Takes all that lies before the watermark, in order of time."""
        due = self.due.get()[0] if self.due.exists() else None
        asked = self.asked.get()[0] if self.asked.exists() else None
        waiting = sorted([*(x[0] for x in self.waiting.get()), *came]) if self.waiting.exists() else sorted(came)
        out, taken = [], 0
        while True:
            request = waiting[taken] if taken < len(waiting) else None
            timer = due if self.keep is not None and due is not None and asked is not None and due - asked <= self.keep else None
            ahead = [t for t in (request, timer) if t is not None]
            if not ahead or min(ahead) >= watermark:
                break
            if request is not None and (timer is None or request <= timer):
                taken += 1
                asked = request
                if due is None or request >= due:
                    out.append((request, True))
                    due = request + self.every
            else:
                out.append((timer, False))
                due = timer + self.every
        rest = waiting[taken:]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rest or taken:
            self.waiting.clear()
        if rest:
            self.waiting.put([(t,) for t in rest])
        elif taken == 0 and came:
            self.waiting.clear()
        if due is not None:
            self.due.update((due,))
            self.asked.update((asked,))
        if ahead:
            self.handle.registerTimer(-(-min(ahead) // 1_000))
        elif self.keep is not None and due is not None:  # nothing to come: the page is forgotten
            self.due.clear()
            self.asked.clear()
        if out:
            yield pd.DataFrame({self.key: [key[0]] * len(out), self.ts: pd.to_datetime([t for t, _ in out], unit="us"), "asked": [a for _, a in out]})

    def close(self) -> None:
        pass


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def refreshes(requests: DataFrame, key: str, ts: str, minutes: int = 120, keep: int | None = None, delay: str = "1 hour", known: DataFrame | None = None) -> DataFrame:
    """(key, ts, asked): when pages are fetched, from a stream of requests.

    A request counts if the page was never fetched or its refresh time, `minutes` after the last fetch, has come; requests
    in between give no row. With `keep`, a page is fetched when its time comes without being asked (asked is false), until
    nobody has asked for it in so many minutes; then it is forgotten. known: a table (key, due) of pages and refresh times
    to begin with. Rows come once the watermark, `delay` behind the latest request, has passed their time.
    """
    spark = requests.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # the store that has timers
    kind = dict(requests.dtypes)[key]
    grouped = requests.select(key, ts).withWatermark(ts, delay).groupBy(key)
    first = None if known is None else known.select(F.col(key), F.col("due")).groupBy(key)
    return grouped.transformWithStateInPandas(_Pages(key, ts, minutes, keep), f"`{key}` {kind}, `{ts}` timestamp, asked boolean", "append", "EventTime", initialState=first)


def due_times(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """(key, due): the refresh times that a stopped query holds, read from its state as a table."""
    state = spark.read.format("statestore").option("stateVarName", "due").load(checkpoint)
    return state.select(F.col(f"key.{key}").alias(key), F.timestamp_micros(F.col("value.at")).alias("due"))


def remaining(spark: SparkSession, checkpoint: str, key: str, ts: str, minutes: int = 120) -> DataFrame:
    """(key, ts, asked): what `refreshes` without `keep` would still give for requests that a stopped query holds because
    the watermark has not passed them. For a finite input these rows and the stream's own are all there are. A key's
    requests of the watermark's delay meet in one row."""
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    waiting = state("waiting").groupBy(F.col(f"key.{key}").alias(key)).agg(F.sort_array(F.collect_list("list_element.at")).alias("asked"))
    due = state("due").select(F.col(f"key.{key}").alias("_key"), F.col("value.at").alias("due"))
    start = F.struct(F.col("due").alias("due"), F.array().cast("array<bigint>").alias("taken"))
    take = lambda at, t: F.when(at["due"].isNull() | (t >= at["due"]), F.struct((t + minutes * _MINUTE).alias("due"), F.concat(at["taken"], F.array(t)).alias("taken"))).otherwise(at)
    taken = waiting.join(due, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, F.explode(F.aggregate("asked", start, take, lambda at: at["taken"])).alias("at"))
    return taken.select(key, F.timestamp_micros("at").alias(ts), F.lit(True).alias("asked"))
