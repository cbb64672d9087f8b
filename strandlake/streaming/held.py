"""Rows that are held until they can't contribute any more, and windows that wait for all samples.

A row is held in its key's state from when it comes until the watermark has passed its time by `hold`:
till then later rows may still belong to it. A timer of event time then lets it go, with what its
followers added up to, and evicts it. Rows later than the watermark's delay don't come in.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows as plain objects, so that Arrow gets one array a column."""
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in zip(("key", "id", "us", "n_followers", "amount"), columns, strict=True)})


class Holder(StatefulProcessor):
    """State of a key: its held rows (id, time in microseconds, amount), in a list of packs.

    A pack has the rows of a batch, or those left by a timer, as arrays: state is moved by packs, not row by row. Calls that
    give nothing yield no frame.
    """

    def __init__(self, key: str, hold_us: int) -> None:
        self.key, self.hold = key, hold_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "id array<long>, us array<long>, amount array<double>")

    def _until(self, us: int) -> int:
        """The timer, in milliseconds, at which a row of that time goes: not before its hold has passed."""
        return -(-(us + self.hold) // 1000)

    def _rows(self) -> list[tuple]:
        return [r for pack in self.held.get() for r in zip(*pack, strict=True)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = min((min(pack[1]) for pack in self.held.get()), default=None)
        made = [tuple(batch[c].tolist() for c in ("id", "us", "amount")) for batch in rows]
        self.held.appendList(made)
        least = min(min(us) for _, us, _ in made)
        if before is None or least < before:
            self.handle.registerTimer(self._until(least))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self._rows(), key=lambda r: (r[1], r[0]))
        out, end, gone = [], 0, 0
        for k, (name, us, own) in enumerate(rows):
            if self._until(us) > now:
                break
            gone = k + 1
            # followers are the rows after this time, up to the hold: a window that moves on with k
            if end <= k:
                end = k
            while end < len(rows) and rows[end][1] <= us + self.hold:
                end += 1
            first = k
            while first < end and rows[first][1] <= us:
                first += 1
            out.append((key[0], name, us, end - first, sum(r[2] for r in rows[first:end])))
        if gone:
            rest = rows[gone:]
            if rest:
                self.held.put([tuple(map(list, zip(*rest, strict=True)))])
                self.handle.registerTimer(self._until(rest[0][1]))
            else:
                self.held.clear()
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


def held(rows: DataFrame, key: str, row_id: str, time: str, amount: str, hold_us: int, lateness: str) -> DataFrame:
    """(key, id, time, n_followers, amount): every row of a stream once its hold has passed, in append mode.

    n_followers and amount count and add up the rows of its key that come after its time, within `hold_us`
    microseconds. The key should be as fine as the data allow (sample, contig and bin, say): its rows are held by one task.
    """
    kind = rows.schema[key].dataType.simpleString()
    rows.sparkSession.conf.set(STORE, ROCKS)
    named = rows.withWatermark(time, lateness).select(F.col(key).alias("key"), F.col(row_id).cast("long").alias("id"), F.unix_micros(F.col(time)).alias("us"), F.col(amount).cast("double").alias("amount"), F.col(time).alias("time"))
    schema = f"key {kind}, id long, us long, n_followers long, amount double"
    made = named.groupBy("key").transformWithStateInPandas(Holder("key", hold_us), schema, "Append", "eventTime")
    return made.select("key", "id", F.timestamp_micros("us").alias("time"), "n_followers", "amount")


def together(samples: list[DataFrame], time: str, width: str, lateness: str, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates of windows over several streams, each given out only when every stream has passed it.

    Each stream has a watermark of its own, and the slowest one is that of all: a barrier before each window.
    """
    conf = samples[0].sparkSession.conf
    conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")
    marked = [s.withWatermark(time, lateness) for s in samples]
    grouped = reduce(DataFrame.unionByName, marked).groupBy(F.window(time, width)).agg(*[a.alias(n) for n, a in aggregates.items()])
    return grouped.select(F.col("window.start").alias("window_start"), *aggregates)
