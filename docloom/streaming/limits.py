"""Rate limits as a stateful stream: a sliding window and the day's totals of each key, with timers.

The state of a key is a list of the events of its last window and a value with the day and its counts. Events of a
micro-batch are taken in time order; with a new day the counts begin at zero. A timer at the end of the window drops what
has aged, and one at the end of the day drops the day's counts, so a key that stays away leaves no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

DAY = 86_400_000_000
#: What stateful processors need: a state store with lists and timers.
STORE = {"spark__sql__streaming__stateStore__providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_LONGS = lambda *names: StructType([StructField(n, LongType()) for n in names])


class Usage(StatefulProcessor):
    """Of each event the window's and the day's totals, itself included; equal times count for one another."""

    def __init__(self, seconds: int) -> None:
        self.wide = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getListState("window", _LONGS("us", "amount"))
        self.day = handle.getValueState("day", _LONGS("day", "requests", "tokens"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(["us", "id"], kind="stable")
        held = np.array(sorted(tuple(x) for x in self.window.get()), np.int64).reshape(-1, 2)
        day, requests, tokens = self.day.get() if self.day.exists() else (None, 0, 0)
        us, amount = new["us"].to_numpy(np.int64), new["amount"].to_numpy(np.int64)
        # Running sums: an event's totals are differences of two of them, however many events its window holds.
        before, own = (np.concatenate([[0], np.cumsum(a)]) for a in (held[:, 1], amount))
        aged, first, last = np.searchsorted(held[:, 0], us - self.wide, "right"), np.searchsorted(us, us - self.wide, "right"), np.searchsorted(us, us, "right")
        days = us // DAY
        begin, goes_on = np.searchsorted(days, days, "left"), (days == days[0]) & (days[0] == day)
        day_requests, day_tokens = last - begin + np.where(goes_on, requests, 0), own[last] - own[begin] + np.where(goes_on, tokens, 0)
        live = [*map(tuple, held[aged[-1] :].tolist()), *zip(us[first[-1] :].tolist(), amount[first[-1] :].tolist())]
        self.window.put(live)
        day = int(days[-1])
        self.day.update((day, int(day_requests[-1]), int(day_tokens[-1])))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        for at in (live[-1][0] + self.wide, (day + 1) * DAY):
            self.handle.registerTimer(at // 1000 + 1)
        frame = pd.DataFrame({"id": new["id"], "requests": len(held) - aged + last - first, "tokens": before[-1] - before[aged] + own[last] - own[first], "day_requests": day_requests, "day_tokens": day_tokens}).astype("int64")
        frame.insert(0, "key", str(key[0]))
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if self.window.exists():
            live = [tuple(x) for x in self.window.get() if x[0] > now - self.wide]
            self.window.put(live) if live else self.window.clear()
        if self.day.exists() and (self.day.get()[0] + 1) * DAY <= now:
            self.day.clear()
        yield from ()

    def close(self) -> None:
        pass


def usage_stream(stream: DataFrame, key: str, ts: str, tokens: str, id: str, seconds: int = 60, late: str = "0 seconds") -> DataFrame:
    """key, id, requests, tokens (of the window), day_requests and day_tokens (of the UTC day so far) of each event.

    The query has to be started while STORE is set. Rows without a time are left out; late ones are dropped by the watermark.
    """
    rows = stream.where(F.col(ts).isNotNull()).selectExpr(f"cast(`{key}` as string) as __key", f"cast(`{ts}` as timestamp) as __at", f"cast(`{tokens}` as bigint) as amount", f"cast(`{id}` as bigint) as id")
    timed = rows.withColumn("us", F.expr("unix_micros(__at)")).withWatermark("__at", late)
    return timed.groupBy("__key").transformWithStateInPandas(Usage(seconds), "key string, id bigint, requests bigint, tokens bigint, day_requests bigint, day_tokens bigint", "Append", "EventTime")
