"""Order surges on a stream, in event-time order.

The state is kept per product and time slice, not per product: catching up on a long history
spreads a hot product over its slices, and a slice's state is dropped when the watermark passes its
end. Orders wait in cells of time, each with a timer of its own, so a timer reads the orders
that are due and nothing else; of those before it only the last n - 1 are kept.

As in the batch form no order is copied. A slice hands on its first and last n - 1 orders, and a second step
finds the runs that reach over slices among these edges of a product. A slice may be shorter than `within`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from repricer.functions.intervals import floor_to, micros

RUNS = "product_id string, product_name string, first_ts timestamp, ts timestamp, seq bigint"

# a found run, or an edge order: `first_at` is then NULL
_FOUND = "product_id string, lane bigint, product_name string, first_at bigint, at bigint, seq bigint, is_head boolean"
_found = Row("product_id", "lane", "product_name", "first_at", "at", "seq", "is_head")
#: Lane of the edges of a product; runs keep to lanes by slice.
_EDGES = 0


class _SliceRuns(StatefulProcessor):
    """Runs inside a slice, and its edges.

    An order is final once the watermark has passed its cell; timers come in the order of their time.
    """

    def __init__(self, n: int, within: int, slice_width: int, cell: int):
        self._n, self._within, self._width, self._cell = n, within, slice_width, cell

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._cells = handle.getMapState("cells", "cell bigint", "orders array<struct<at: bigint, seq: bigint, product_name: string>>")
        # the last orders that are final, and how many there have been
        self._recent = handle.getValueState(
            "recent", "orders array<struct<at: bigint, seq: bigint, product_name: string>>, count bigint"
        )
        self._is_open = handle.getValueState("is_open", "yes boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = defaultdict(list)
        for row in rows:
            new[row.at // self._cell].append((row.at, row.seq, row.product_name))
        for cell, orders in new.items():
            if self._cells.containsKey((cell,)):
                orders = [tuple(o) for o in self._cells.getValue((cell,))[0]] + orders
            else:
                self._handle.registerTimer((cell + 1) * self._cell // 1000)
            self._cells.updateValue((cell,), (orders,))
        if not self._is_open.exists():
            self._is_open.update((True,))
            self._handle.registerTimer((key[1] + self._width) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        product, slice_start = key
        due = expiredTimerInfo.getExpiryTimeInMs()
        recent, count = self._recent.get() if self._recent.exists() else ([], 0)
        recent = [tuple(o) for o in recent]
        if due == (slice_start + self._width) // 1000 + 1:
            # those of the last orders that were not handed on as first ones
            late = recent[max(0, self._n - 1 - (count - len(recent))):]
            self._recent.clear()
            self._is_open.clear()
            yield from (_found(product, _EDGES, name, None, at, seq, False) for at, seq, name in late)
            return
        cell = due * 1000 // self._cell - 1
        if not self._cells.containsKey((cell,)):
            return
        orders = sorted((tuple(o) for o in self._cells.getValue((cell,))[0]), key=lambda o: o[:2])
        self._cells.removeKey((cell,))
        for at, seq, name in orders:
            count += 1
            if count < self._n:
                yield _found(product, _EDGES, name, None, at, seq, True)
            elif at - (first := recent[1 - self._n] if self._n > 1 else (at, seq, name))[0] < self._within:
                yield _found(product, 1 + slice_start, first[2], first[0], at, seq, None)
            recent = [*recent, (at, seq, name)][1 - self._n:] if self._n > 1 else []
        self._recent.update((recent, count))

    def close(self) -> None:
        pass


class _EdgeRuns(StatefulProcessor):
    """Runs that end among the first orders of a slice; those found inside one pass."""

    def __init__(self, n: int, within: int):
        self._n, self._within = n, within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._recent = handle.getValueState("recent", "orders array<struct<at: bigint, product_name: string>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[1] != _EDGES:
            yield from rows
            return
        recent = [tuple(o) for o in self._recent.get()[0]] if self._recent.exists() else []
        # at most 2 (n - 1) rows of each slice; a slice is over before the next one hands on anything
        for row in sorted(rows, key=lambda r: (r.at, r.seq)):
            if row.is_head and len(recent) >= self._n - 1 and row.at - recent[1 - self._n][0] < self._within:
                first_at, name = recent[1 - self._n]
                yield _found(row.product_id, _EDGES, name, first_at, row.at, row.seq, None)
            recent = [*recent, (row.at, row.product_name)][1 - self._n:]
        self._recent.update((recent,))

    def close(self) -> None:
        pass


def surge_runs(
    orders: DataFrame,
    *,
    n: int = 10,
    within: str = "1 minute",
    watermark: str = "0 seconds",
    slice_width: str = "1 hour",
    cell: str = "1 second",
) -> DataFrame:
    """The runs of the batch operator of the same name, each emitted once it is final.

    `cell` is how long an order may wait for others of its time; slices are multiples of it.
    """
    within_us, width, cell_us = micros(within), micros(slice_width), micros(cell)
    if width % cell_us or cell_us % 1000:
        raise ValueError("slice_width must be a multiple of cell, and cell of a millisecond")
    inside = (
        orders.select("product_id", "product_name", "ts", "seq")
        .withWatermark("ts", watermark)
        .withColumn("at", F.unix_micros("ts"))
        .withColumn("slice", floor_to(F.col("at"), width))
        .groupBy("product_id", "slice")
        .transformWithState(_SliceRuns(n, within_us, width, cell_us), _FOUND, "append", "eventTime")
    )
    found = inside.groupBy("product_id", "lane").transformWithState(_EdgeRuns(n, within_us), _FOUND, "append", "none")
    return found.where("first_at IS NOT NULL").select(
        "product_id",
        "product_name",
        F.timestamp_micros("first_at").alias("first_ts"),
        F.timestamp_micros("at").alias("ts"),
        "seq",
    )
