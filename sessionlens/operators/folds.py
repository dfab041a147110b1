"""Folds along sessions: a state is carried through sorted Arrow batches, across their borders.

Rows are dealt by session and sorted inside partitions, on disk where they don't fit; a task holds one batch and one
state, never a session's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappush, heappushpop

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema


def carried(rows: DataFrame, session: str, order: list[str | Column], uses: list[str], new: Callable[[], Callable], name: str, kind: str) -> DataFrame:
    """rows with the column `name` of type `kind`: new() makes a session's fold, which is called with each row's
    `uses` in `order` and gives the row's value. A null session is one session."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{name}` {kind}"
    out = to_arrow_schema(rows.sparkSession.createDataFrame([], f"x {kind}").schema).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = fold = None
        for b in batches:
            values = []
            for at, *x in zip(b.column(session).to_pylist(), *(b.column(c).to_pylist() for c in uses), strict=True):
                if fold is None or at != now:
                    now, fold = at, new()
                values.append(fold(*x))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, out)], names=[*b.schema.names, name])

    return rows.repartition(session).sortWithinPartitions(session, *order).mapInArrow(run, schema)


class UpperMedian:
    """sorted[n // 2] of the values so far, nulls left out: the lower half in one heap, the upper in another."""

    def __init__(self) -> None:
        self.low: list = []
        self.high: list = []

    def __call__(self, x):
        if x is not None:
            if len(self.low) < len(self.high):  # as many below as from the median on, or one fewer
                heappush(self.low, -heappushpop(self.high, x))
            else:
                heappush(self.high, -heappushpop(self.low, -x))
        return self.high[0] if self.high else None


class Spaced:
    """Is this row taken? At most `most` are, each at least `gap` from those taken before."""

    def __init__(self, most: int, gap: float) -> None:
        self.most, self.gap, self.taken = most, gap, []

    def __call__(self, at) -> bool:
        take = at is not None and len(self.taken) < self.most and all(abs(at - t) >= self.gap for t in self.taken)
        if take:
            self.taken.append(at)
        return take


class Packed:
    """The number of the run that a row is in: a run is closed before it would be beyond `most`; a row that is beyond
    it alone is a run of its own."""

    def __init__(self, most: int) -> None:
        self.most, self.run, self.size = most, -1, None

    def __call__(self, size) -> int:
        size = size or 0
        if size > self.most or self.size is None or self.size + size > self.most:
            self.run += 1
            self.size = None if size > self.most else size
        else:
            self.size += size
        return self.run
