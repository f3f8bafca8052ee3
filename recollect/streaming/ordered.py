"""Keyed streams read in event-time order: rows wait in state until the watermark has passed them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: step(key, carry, rows) -> (carry, outputs): rows are (micros, id, value) in order, carry a list of (micros, value), outputs tuples.
Step = Callable[[tuple, list[tuple], list[tuple]], tuple[list[tuple], list[tuple]]]
#: Stands for a null time.
NEVER = -(1 << 62)
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started within keep their state in RocksDB, as timers and list state need; the session's own setting comes back after."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


class InOrder(StatefulProcessor):
    """Of each key: rows that wait, what the step carries on, how far it has read, and one timer, at the earliest waiting row.

    A row that comes after a later one of its key has been read is given out as late and changes nothing.
    With `forget` (microseconds) a key's state goes once so long has passed, in event time, since its last row; rows behind the
    watermark are late for a key without state then.
    """

    def __init__(self, keys: list[str], columns: list[str], step: Step, late: Callable[[tuple, tuple], tuple], forget: int | None):
        self.keys, self.columns, self.step, self.late, self.forget = keys, columns, step, late, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros long, id string, value string")
        self.carry = handle.getListState("carry", "micros long, value string")
        self.read = handle.getValueState("read", "micros long, id string, timer long, idle boolean")

    def close(self) -> None:
        pass

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=[*self.keys, *self.columns])

    def _note(self, micros: int | None, name: str | None, old: int | None, timer: int | None, idle: bool) -> None:
        """How far the key is read, and its timer in place of the old one."""
        if timer != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if timer is not None:
                self.handle.registerTimer(timer)
        self.read.update((micros, name, timer, idle))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        micros, name, timer, idle = self.read.get() if self.read.exists() else (None, None, None, False)
        # A key that was forgotten may have read later rows than any behind the watermark.
        lost = timerValues.getCurrentWatermarkInMs() * 1000 if self.forget is not None and not self.read.exists() else NEVER
        fresh, late = [], []
        for batch in rows:
            for row in zip(batch["row_at"].tolist(), batch["row_id"].tolist(), batch["row_value"].tolist(), strict=True):
                behind = row[0] == NEVER or row[0] < lost or micros is not None and row[:2] < (micros, name)
                (late if behind else fresh).append(row)
        if fresh:
            self.waiting.appendList(fresh)
            first = min(r[0] for r in fresh) // 1000 + 1
            self._note(micros, name, timer, first if timer is None or idle else min(first, timer), False)
        if late:
            yield self._frame(key, [self.late(key, r) for r in sorted(late)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        until = timerValues.getCurrentWatermarkInMs() * 1000
        micros, name, _, _ = self.read.get()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[0] < until], [r for r in rows if r[0] >= until]
        if ready:
            carry, out = self.step(key, list(self.carry.get()) if self.carry.exists() else [], ready)
            micros, name = ready[-1][:2]
            if carry:
                self.carry.put(carry)
            else:
                self.carry.clear()
            if out:
                yield self._frame(key, out)
        # The timer that fired is gone.
        if rest:
            self.waiting.put(rest)
            self._note(micros, name, None, rest[0][0] // 1000 + 1, False)
        else:
            self.waiting.clear()
            if self.forget is None:
                self._note(micros, name, None, None, False)
            elif micros + self.forget < until:  # nothing came for so long
                self.carry.clear()
                self.read.clear()
            else:
                self._note(micros, name, None, (micros + self.forget) // 1000 + 1, True)


def in_order(
    rows: DataFrame, keys: list[str], at: str, id_: Column, value: Column, delay: str, step: Step, late: Callable[[tuple, tuple], tuple],
    columns: list[str], schema: str, forget: int | None = None,
) -> DataFrame:
    """Run `step` over each key's rows in order of (at, id), however batches mix them; start the query within `keyed_state`.

    Rows wait for `delay` behind the newest row of the whole stream. Time goes on in microseconds under another name, so that
    Spark does not drop rows behind the watermark: the processor tells them as late, and only those that would have to be read before
    one that has been read already. Rows of a null time are late at once. A null id or value is read as empty.
    """
    watched = rows.withWatermark(at, delay)
    sent = watched.select(
        *keys, F.coalesce(F.unix_micros(at), F.lit(NEVER)).alias("row_at"), F.coalesce(id_.cast("string"), F.lit("")).alias("row_id"),
        F.coalesce(value.cast("string"), F.lit("")).alias("row_value"),
    )
    return sent.groupBy(*keys).transformWithStateInPandas(InOrder(keys, columns, step, late, forget), schema, "Append", "EventTime")
