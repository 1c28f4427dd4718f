"""Lives of players from a stream of their rows, with timers that close them and free their state.

The state of a player holds the rows since its last death, and no more: a life is given out once the watermark is so far
past its end that nothing can change it, and the rest once the player has been silent for long.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from matchlake.operators import stateful

OUT = "game_id int, slot int, idx int, t0 double, t1 double, ended string"


class LifeProcessor(StatefulProcessor):
    """One player of one game; times are seconds of the epoch."""

    def __init__(self, gap: float, respawn: float, tail: float, near: float, over: float):
        self.rules = {"gap": gap, "respawn": respawn, "tail": tail, "near": near}
        self.settled = max(gap, respawn, near)
        self.over = max(over, self.settled)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "t double, alive boolean, killed boolean")
        self.done = handle.getValueState("done", "died double, idx int, last double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))[["t", "alive", "killed"]]
        self.rows.appendList([(float(t), bool(a), bool(k)) for t, a, k in came.itertuples(index=False)])
        died, idx, last = self._done()
        if len(came) and came["t"].max() > last:
            self._sleep(last := float(came["t"].max()))
        self.done.update((died, idx, last))
        yield self._given(key, timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        yield self._given(key, now)
        if self.done.exists() and now >= self._done()[2] + self.over:
            self._forget()

    def close(self) -> None:
        pass

    def _done(self) -> tuple[float, int, float]:
        return tuple(self.done.get()) if self.done.exists() else (float("-inf"), 0, float("-inf"))

    def _sleep(self, last: float) -> None:
        """Timers for when the last rows settle and for when the player counts as gone."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        for wait in (self.settled, self.over):
            self.handle.registerTimer(int((last + wait) * 1000) + 1)

    def _forget(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.rows.clear()
        self.done.clear()

    def _given(self, key: Any, now: float) -> pd.DataFrame:
        """Lives that nothing can change any more; their rows leave the state."""
        died, idx, last = self._done()
        held = pd.DataFrame(list(self.rows.get()), columns=["t", "alive", "killed"]) if self.rows.exists() else pd.DataFrame(columns=["t", "alive", "killed"])
        gone = now >= last + self.over
        held = held[held["t"] <= now] if not gone else held
        empty = pd.DataFrame({"game_id": pd.Series(dtype="int32"), "slot": pd.Series(dtype="int32"), "idx": pd.Series(dtype="int32"), "t0": pd.Series(dtype="float64"), "t1": pd.Series(dtype="float64"), "ended": pd.Series(dtype="object")})
        if not len(held):
            return empty
        found = stateful.lives(held.assign(game_id=int(key[0]), slot=int(key[1])), held[held["killed"]], since=died, first=idx, **self.rules)
        # a life may still turn from an end into a death; a death is what it is once its time has passed
        final = found if gone else found[(found["ended"] == "death") & (found["t1"] + self.settled <= now)]
        if not len(final):
            return empty
        until = float(final["t1"].iat[-1])
        kept = [tuple(r) for r in self.rows.get() if r[0] > until]
        if kept:
            self.rows.put(kept)
        else:
            self.rows.clear()
        self.done.update((until if final["ended"].iat[-1] == "death" else died, idx + len(final), last))
        return final.astype({"game_id": "int32", "slot": "int32", "idx": "int32"})


def live_lives(rows: DataFrame, late: str = "10 seconds", gap: float = 0.35, respawn: float = 12.0, tail: float = 3.0, near: float = 2.0, over: float = 1800.0) -> DataFrame:
    """Lives of a stream of rows (game_id, slot, at, alive, killed), each once, when it is certain: game_id, slot, idx, t0, t1, ended.

    Equal to the lives of all rows at once as long as a player is not silent for `over` seconds in a game, after which
    its state is dropped. Needs the RocksDB state store, which is set for the session.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = rows.withWatermark("at", late).select("game_id", "slot", "at", (F.unix_micros("at") / 1e6).alias("t"), "alive", "killed")
    return timed.groupBy("game_id", "slot").transformWithStateInPandas(LifeProcessor(gap, respawn, tail, near, over), OUT, "Append", "EventTime")
