"""A retry queue as a stream: waiting items are kept in the state of their share of the keys, and a timer calls for its next attempt.

An item is tried when it comes. After its n-th failure it waits base^n minutes; the failure after `most` retries makes it dead.
Every step is a row (key, state, retry_count, at, due): `success`, `waiting` or `dead`. Finished items leave the state, so a
later row of the same key is a new item; a row of a key that waits is left out. State and timers are in the checkpoint: a
restart goes on where the stream stopped and tries nothing twice.

The clock is the event time of the rows (attempts are made at the times that the watermark has passed: the same rows give
the same result) or the processing time of the cluster. Rows with a null key or time are left out. Items are spread by key over
shares, and only waiting ones are held, so state grows with the backlog, not with the input. A share goes to Python whole, so a batch costs as many
calls as it touches shares, whatever its items; the hook alone is called for each try.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE, SHARES = 60_000, 4096


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started within keep their state in the store that timers need."""
    held = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, held)


class Retries:
    """A batch of one share of the keys. attempt(payload, retry_count) says whether a try succeeds; an exception is a failure."""

    def __init__(self, attempt: Callable[[str, int], bool], most: int, base: int, by_event_time: bool):
        self.attempt, self.most, self.base, self.by_event_time = attempt, most, base, by_event_time

    def _tries(self, key: int, payload: str | None, n: int, at: int, now: int, steps: list[tuple], waits: dict[int, tuple]) -> None:
        """The try at `at`, and those that fall due up to now."""
        while True:
            try:
                ok = bool(self.attempt(payload, n))
            except Exception:  # whatever the hook raises
                ok = False
            if ok:
                steps.append((key, "success", n, at, None))
                return
            n += 1
            if n > self.most:
                steps.append((key, "dead", n, at, None))
                return
            due = at + self.base**n * MINUTE
            steps.append((key, "waiting", n, at, due))
            if due > now:
                waits[key] = (payload, n, due)
                return
            at = due

    @staticmethod
    def _frame(steps: list[tuple]) -> pd.DataFrame:
        key, state, n, at, due = zip(*steps)
        stamp = lambda ms: pd.Series(np.array(ms, "datetime64[ms]").astype("datetime64[us]"))
        return pd.DataFrame({"key": key, "state": state, "retry_count": pd.Series(n, dtype="int32"), "at": stamp(at), "due": stamp(due)})

    def __call__(self, share: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waits = {k: (p, n, due) for k, p, n, due in zip(*state.get)} if state.exists else {}
        now = state.getCurrentWatermarkMs() if self.by_event_time else state.getCurrentProcessingTimeMs()
        fresh: dict[int, tuple] = {}
        if not state.hasTimedOut:
            for part in parts:
                for key, payload, at in zip(part["key"].tolist(), part["payload"].tolist(), part["at_ms"].tolist()):
                    if key not in waits and (key not in fresh or (at, payload or "") < (fresh[key][1], fresh[key][0] or "")):
                        fresh[key] = (payload, at)
        steps: list[tuple] = []
        for key in [k for k, w in waits.items() if w[2] <= now]:
            payload, n, due = waits.pop(key)
            self._tries(key, payload, n, due if self.by_event_time else now, now, steps, waits)
        for key, (payload, at) in fresh.items():
            self._tries(key, payload, 0, int(at) if self.by_event_time else now, now, steps, waits)
        if waits:
            state.update(([*waits], *(list(x) for x in zip(*waits.values()))))
            first = min(w[2] for w in waits.values())
            if self.by_event_time:
                state.setTimeoutTimestamp(max(first - 1, now, 1))  # it runs out when the watermark is beyond it
            else:
                state.setTimeoutDuration(max(first - now, 1))
        elif state.exists:
            state.remove()
        if steps:
            yield self._frame(steps)


def retries(items: DataFrame, attempt: Callable[[str, int], bool], key: str, payload: str, time: str, most: int = 5, base: int = 2, event_time: bool = True, shares: int = SHARES) -> DataFrame:
    """The steps of a stream of items. By event time, items needs a watermark on `time`. Start it within keyed_state().

    shares: the keys are dealt to so many states, each read and written once a batch; it must stay the same over restarts.
    """
    long = F.col(key).cast("long")
    picked = items.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.pmod(F.xxhash64(long), F.lit(shares)).alias("share"), long.alias("key"), F.col(payload).cast("string").alias("payload"), F.col(time), F.unix_millis(F.col(time)).alias("at_ms"))
    return picked.groupBy("share").applyInPandasWithState(
        Retries(attempt, most, base, event_time).__call__,
        outputStructType="key long, state string, retry_count int, at timestamp_ntz, due timestamp_ntz",
        stateStructType="keys array<long>, payloads array<string>, counts array<int>, dues array<long>",
        outputMode="append",
        timeoutConf="EventTimeTimeout" if event_time else "ProcessingTimeTimeout",
    )


def last_steps(steps: DataFrame, key: str = "key") -> DataFrame:
    """The last step of each item."""
    last = F.max_by(F.struct("state", "retry_count", "at", "due"), F.struct("at", "retry_count"))
    return steps.groupBy(key).agg(last.alias("_s")).select(key, "_s.*")
