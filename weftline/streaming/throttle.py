"""The delay between requests to a host, from how the host answers: as a batch fold over
ordered answers and as a stateful stream. Both give the delay after each answer."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW, SLOW = 10, 0.5
STATE = "active double, backoff int, times array<double>"


def step(active: float, backoff: int, times: list[float], status: int | None, seconds: float | None, base: float) -> tuple[float, int, list[float]]:
    """429 doubles the delay (one second at least) and is remembered; each other answer takes
    one off the memory, and the last brings the base delay back; slow answers (over half a
    second in the mean of the last ten) ask for half their time. A null status is no answer."""
    if status is None:
        return active, backoff, times
    if status == 429:
        return max(1.0, 2 * active), backoff + 1, times
    if backoff:
        backoff -= 1
        active = active if backoff else base
    times = [*times, seconds or 0.0][-WINDOW:]
    mean = sum(times) / len(times)
    if mean > SLOW and not backoff:
        active = max(base, mean / 2)
    return active, backoff, times


class Pace:
    """One host's turns: requests begin at least the present delay apart, whatever the threads,
    and each answer sets the next delay by `step`. clock and sleep are for tests."""

    def __init__(self, base: float, state: tuple[float, int, list[float]] | None = None, clock=time.monotonic, sleep=time.sleep):
        self.base, self.state = base, state or (base, 0, [])
        self.clock, self.sleep, self.lock, self.next = clock, sleep, threading.Lock(), None
        self.answers = 0

    def turn(self) -> None:
        """Returns when it is the caller's turn."""
        with self.lock:
            now = self.clock()
            at = now if self.next is None else max(now, self.next)
            self.next = at + self.state[0]
        if at > now:
            self.sleep(at - now)

    def answered(self, status: int | None, seconds: float | None) -> None:
        with self.lock:
            self.answers += 1
            before, self.state = self.state[0], step(*self.state, status, seconds, self.base)
            if self.next is not None and self.state[0] > before:
                self.next += self.state[0] - before


def delays(df: DataFrame, key: str, order: str, status: str = "status", seconds: str = "seconds", base: float = 0.0) -> DataFrame:
    """(key, order, delay) after each answer, in order. One group's answers are folded by one
    task and must fit its memory; a host is asked seldom enough for that."""

    def run(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        state = (base, 0, [])
        out = []
        for o, s, t in group.sort_values([order, status, seconds])[[order, status, seconds]].itertuples(index=False):
            state = step(*state, None if pd.isna(s) else int(s), None if pd.isna(t) else float(t), base)
            out.append((keys[0], o, state[0]))
        return pd.DataFrame(out, columns=[key, order, "delay"])

    kinds = dict(df.dtypes)
    return df.select(key, order, status, seconds).groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, delay double")


def delay_stream(df: DataFrame, key: str, order: str, status: str = "status", seconds: str = "seconds", base: float = 0.0) -> DataFrame:
    """The same on a stream: state is the delay, the memory and the last ten times of each
    key; answers within a micro-batch are taken in order, late ones when they come."""

    def run(keys: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (base, 0, [])
        group = pd.concat(list(groups)).sort_values([order, status, seconds])
        out = []
        for o, s, t in group[[order, status, seconds]].itertuples(index=False):
            now = step(now[0], now[1], list(now[2]), None if pd.isna(s) else int(s), None if pd.isna(t) else float(t), base)
            out.append((keys[0], o, now[0]))
        state.update((now[0], now[1], list(now[2])))
        yield pd.DataFrame(out, columns=[key, order, "delay"])

    kinds = dict(df.dtypes)
    return df.select(key, order, status, seconds).groupBy(key).applyInPandasWithState(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, delay double", STATE, "append", GroupStateTimeout.NoTimeout)


def rolling_mean(df: DataFrame, key: str, order: str, seconds: str = "seconds", rows: int = WINDOW) -> DataFrame:
    """Mean of each answer's and the nine before's times, as a window."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - rows, 0)
    return df.withColumn("mean_seconds", F.avg(seconds).over(w))
