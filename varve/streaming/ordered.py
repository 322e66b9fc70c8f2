"""Change-only price points of a stream in order of event time, whatever order its files come in.

An observation waits in state until the watermark has passed it; a timer in event time then takes all that
waited up to the watermark, in order of time, and compares each with the one before it of its key. So a row that comes
late, within the bound, is compared where it belongs, and no answer depends on how rows were dealt to micro-batches. Rows
later than the bound are left out, as Spark drops them at the watermark.

A call of the processor and a value of its state cost some milliseconds and tenths of them, whatever is in them, so keys are
dealt into GROUPS of state by hash and rows wait in chunks of up to CHUNK. A group's waiting rows are never all in
memory: their times are (8 bytes each), and chunks are read from the list state again for each stretch of STRETCH rows. What waits
on is moved to a second list, and the two change places. A group's keys, with what each logged last, are in memory while it
is gone over. With forget_days, an observation that comes so long after the one before it counts as a change, and a timer
drops keys without news for that long, which no answer depends on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from varve.functions.prices import EPSILON

OUT = "key string, observed_at timestamp, price double, list_price double, in_stock boolean"
#: A row in state; in_stock is 0, 1 or missing.
ROW = pa.schema([("key", pa.string()), ("at", pa.int64()), ("price", pa.float64()), ("list_price", pa.float64()), ("in_stock", pa.float64())])
VALUES = ["price", "list_price", "in_stock"]
#: Rows of a group that are sorted in memory at once, and of a value of its state.
STRETCH, CHUNK = 50_000, 10_000
#: Groups that keys are dealt into. State is kept by group, so a checkpoint is read with the number that it was written with.
GROUPS = 4096
#: The state store that keyed lists and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def differs(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether prices differ by EPSILON or more, or one alone is missing."""
    return ~(np.isnan(one) & np.isnan(two)) & ~(np.abs(one - two) < EPSILON)


def changed(rows: pd.DataFrame, last: tuple | None, forget: int | None = None) -> tuple[pd.DataFrame, tuple]:
    """Those rows (ROW, in order) that differ from the row logged before them, the first from last (a row, too); and the last
    row's time with the values logged last. After more than `forget` microseconds without a row, the next one is logged."""
    price, list_price = (rows[c].to_numpy(float, na_value=np.nan) for c in ("price", "list_price"))
    stock = rows["in_stock"].map({True: 1.0, False: 0.0}).to_numpy(float, na_value=np.nan)
    values, times = np.stack([price, list_price, stock], 1), rows["at"].to_numpy(np.int64)
    known = None if last is None else np.array([np.nan if v is None else float(v) for v in last[1:]], float)
    fresh = np.zeros(len(rows), bool)
    if forget is not None:
        fresh = np.diff(times, prepend=times[0] if last is None else last[0]) > forget
    if last is None:
        fresh[0] = True
    log, known = logged(values, fresh, known)
    none = lambda v: None if np.isnan(v) else float(v)
    return rows[log], (int(times[-1]), none(known[0]), none(known[1]), None if np.isnan(known[2]) else bool(known[2]))


def logged(values: np.ndarray, fresh: np.ndarray, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a key are fresh or differ from the one logged before them (known, at first), and the values logged last."""
    log = np.zeros(len(values), bool)
    at, width = 0, 32
    while at < len(values):  # from change to change
        news = fresh[at : at + width] if known is None else fresh[at : at + width] | differs(values[at : at + width], known).any(1)
        if not news.any():
            at, width = at + width, min(2 * width, 4096)
            continue
        at, width = at + int(news.argmax()), 32
        log[at], known = True, values[at]
        at += 1
    return log, known


def changed_of_keys(rows: pd.DataFrame, last: pd.DataFrame, forget: int | None = None) -> tuple[pd.DataFrame, pd.DataFrame]:
    """changed() of all keys at once (ROW; rows in any order, last with a row a key): the changes, and the new last rows.

    A row equal to the one before it is no change, as that one was logged or is as near to the logged one. Where all others differ from
    the one before by EPSILON or more, all of them are changes; only keys with smaller steps are gone through from change to change."""
    both = pd.concat([last, rows], ignore_index=True) if len(last) else rows.reset_index(drop=True)
    keys, _ = pd.factorize(both["key"], use_na_sentinel=False)
    order = np.lexsort((*(both[c].to_numpy() for c in reversed(VALUES)), both["at"].to_numpy(), np.arange(len(both)) >= len(last), keys))
    both, keys, old = both.iloc[order], keys[order], order < len(last)
    values, times = both[VALUES].to_numpy(float), both["at"].to_numpy(np.int64)
    start = np.diff(keys, prepend=-1) != 0
    fresh = start | (np.diff(times, prepend=times[0]) > forget) if forget is not None else start
    prior = np.roll(values, 1, 0)
    kept = np.flatnonzero(fresh | ~((values == prior) | (np.isnan(values) & np.isnan(prior))).all(1))
    steps = fresh[kept]
    steps[1:] |= differs(values[kept[1:]], values[kept[:-1]]).any(1)
    log = np.zeros(len(both), bool)
    log[kept] = steps
    for key in np.unique(keys[kept[~steps]]):
        low, high = np.searchsorted(keys, (key, key + 1))
        log[low:high] = logged(values[low:high], fresh[low:high], None)[0]
    ends = np.flatnonzero(np.append(start[1:], True))
    known = np.maximum.accumulate(np.where(log, np.arange(len(both)), 0))[ends]
    return both[log & ~old], both.iloc[known].assign(at=times[ends])


def packed(rows: pd.DataFrame) -> list[tuple]:
    """rows (ROW) as values of a list state, CHUNK of them in each."""
    out = []
    for batch in pa.Table.from_pandas(rows, ROW, preserve_index=False).replace_schema_metadata().to_batches(CHUNK):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        out.append((sink.getvalue().to_pybytes(),))
    return out


def unpacked(values: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    for (value,) in values:
        yield pa.ipc.open_stream(value).read_pandas()


def together(frames: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0] if frames else ROW.empty_table().to_pandas()


class OrderedChanges(StatefulProcessor):
    def __init__(self, forget: int | None):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = [handle.getListState(f"waiting_{k}", "rows binary") for k in (0, 1)]
        self.last = handle.getListState("last", "rows binary")
        self.turn = handle.getValueState("turn", "list int, timer long")

    def _turn(self) -> tuple[int, int]:
        return tuple(self.turn.get()) if self.turn.exists() else (0, -1)

    def _wake(self, which: int, timer: int, at: int) -> None:
        """One timer at a time, for the millisecond after `at`."""
        due = at // 1000 + 1
        if due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.turn.update((which, due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        which, timer = self._turn()
        have = self.waiting[which]
        first = (timer - 1) * 1000 if have.exists() else None  # else the timer is one by which keys are forgotten
        for frame in rows:
            if len(frame):
                least = int(frame["at"].min())
                first = least if first is None else min(first, least)
                have.appendList(packed(frame[ROW.names]))
        if first is not None:
            self._wake(which, timer, first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        which, _ = self._turn()
        have, spare = self.waiting[which], self.waiting[1 - which]
        before = timerValues.getCurrentWatermarkInMs() * 1000  # times up to it are settled
        held, times = [], [np.empty(0, np.int64)]
        for chunk in unpacked(have.get()):
            times.append(chunk["at"].to_numpy(np.int64))
            if held is not None:
                held = [*held, chunk] if sum(map(len, times)) <= STRETCH else None
        chunks = (lambda: iter(held)) if held is not None else lambda: unpacked(have.get())
        times = np.concatenate(times)
        rest, due = times[times > before], np.sort(times[times <= before])
        last = together(list(unpacked(self.last.get())))
        begin = 0
        while begin < len(due):
            end = min(begin + STRETCH, len(due))
            end = int(np.searchsorted(due, due[end - 1], "right"))  # equal times stay together
            low, high = int(due[begin]), int(due[end - 1])
            out, last = changed_of_keys(together([c[c["at"].between(low, high)] for c in chunks()]), last, self.forget)
            begin = end
            if len(out):
                stock = out["in_stock"].map({1.0: True, 0.0: False}).astype("boolean")
                yield pd.DataFrame({"key": out["key"], "observed_at": pd.to_datetime(out["at"], unit="us", utc=True), "price": out["price"], "list_price": out["list_price"], "in_stock": stock})
        if self.forget is not None:
            last = last[last["at"] + self.forget >= before]
        if len(last):
            self.last.put(packed(last))
        else:
            self.last.clear()
        some = []
        for c in chunks() if len(rest) else ():
            some.append(c[c["at"] > before])
            if sum(map(len, some)) >= CHUNK:
                spare.appendList(packed(together(some)))
                some = []
        if some:
            spare.appendList(packed(together(some)))
        have.clear()
        if len(rest):
            self._wake(1 - which, -1, int(rest.min()))
        elif self.forget is not None and len(last):
            self._wake(which, -1, int(last["at"].min()) + self.forget)
        elif len(last):
            self.turn.update((which, -1))
        else:
            self.turn.clear()

    def close(self) -> None:
        pass


def ordered_changes(observations: DataFrame, late: str = "1 hour", key: str = "key", forget_days: int | None = None) -> DataFrame:
    """A stream of key, observed_at, price, list_price, in_stock as its changes, each given once, when the watermark (late
    behind the newest observation) has passed it. Of observations with equal times, the smaller price comes first. forget_days: after so
    long without news a key starts anew. Needs the session's state store to be STORE."""
    rows = observations.withColumn("observed_at", F.col("observed_at").cast("timestamp")).withWatermark("observed_at", late)
    rows = rows.select(F.col(key).cast("string").alias("key"), "observed_at", F.unix_micros("observed_at").alias("at"), *(F.col(c).cast("double").alias(c) for c in ("price", "list_price")), F.col("in_stock").cast("boolean").cast("double").alias("in_stock"))
    forget = None if forget_days is None else forget_days * 86_400_000_000
    groups = rows.filter("observed_at is not null").withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS))).groupBy("group")
    return groups.transformWithStateInPandas(OrderedChanges(forget), OUT, "Append", "EventTime")
