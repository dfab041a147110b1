"""Packing documents into sequences of a fixed number of tokens: dominance reduction, then best fit.

Each task encodes its documents, cuts only those that are longer than a sequence, and numbers its pieces within each
length. The plan needs only how many pieces each length has, at most one row for each length: whole classes of equal
pieces are placed at once. First the reduction of Martello and Toth: for the longest open piece, sets of up to three
pieces that dominate whatever else could stand with it are fixed for good (it alone where nothing fits beside it; an
exact complement; the longest partner where only one fits or where no two outweigh it; the heaviest fitting pair where
no other two can outdo it). What is left goes by best fit, longest first. The plan is a list of runs: pieces of one
length from one rank on, so many to a sequence, from one sequence and offset on. A piece finds its run by its rank.

Size of the plan: placing a class ends at most one group of equal sequences, and whatever it goes into keeps less
than half of its room, so there are at most about twelve runs for each of four groups a length, whatever the input.

Defined results: a null text is empty (its one id is the end id); rows of one doc_id are packed one by one; a null
doc_id is kept; an empty table gives an empty result; other columns are ignored; a text of any length is whole, in
pieces of the sequence's size, of which the last may be shorter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlens.llm.common import in_slices, stored, table
from sessionlens.llm.token_files import VOCABULARY, encoder, vocabulary_path

#: Tokens of a sequence, and the id after each document.
MOST, END = 4096, 1


class Run(NamedTuple):
    """Pieces of one length, from `rank` on, `each` to a sequence, in the sequences from `sequence` on, at `offset`."""

    length: int
    rank: int
    pieces: int
    sequence: int
    each: int
    offset: int


class Plan:
    """Sequences for `counts` pieces of each length, made by `reduce` and `fill`."""

    def __init__(self, counts: dict[int, int], most: int = MOST) -> None:
        self.most = most
        self.left = np.zeros(most + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.ranks: dict[int, int] = defaultdict(int)
        self.runs: list[Run] = []
        self.sequences = 0
        self.fixed = 0
        self.reduce()
        self.fill()

    def _place(self, length: int, pieces: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append(Run(length, self.ranks[length], pieces, sequence, each, offset))
        self.ranks[length] += pieces
        self.left[length] -= pieces

    def dominating(self, j: int) -> list[int] | None:
        """Lengths of a set with j that dominates every other feasible set with j; None where none is known."""
        rest = self.left.copy()
        rest[j] -= 1
        room = self.most - j
        there = np.flatnonzero(rest[: room + 1])
        if not len(there):
            return [j]
        partner = int(there[-1])
        if partner == room:
            return [j, partner]
        fit, used = 0, 0
        for s in there[:3].tolist():
            for _ in range(min(3 - fit, int(rest[s]))):
                used += s
                fit += used <= room
        if fit == 1:
            return [j, partner]
        if fit > 2:
            return None
        # the heaviest pair: for each first length the longest second one that still fits
        below = np.zeros(room + 1, dtype=np.int64)
        below[there] = there
        below = np.maximum.accumulate(below)
        second = below[np.minimum(there, room - there)]
        alone = (second == there) & (rest[there] < 2)
        second[alone] = below[there[alone] - 1]
        weight = np.where(second > 0, there + second, 0)
        if weight.max() <= partner:
            return [j, partner]
        best = np.flatnonzero(weight == weight.max())[-1]
        a, b = int(there[best]), int(second[best])
        if a != partner:
            return None
        rest[a] -= 1
        between = there[(there > b) & (rest[there] > 0)]
        least = [s for s in between[:2].tolist() for _ in range(min(2, int(rest[s])))][:2]
        if len(least) == 2 and sum(least) <= room:
            return None
        return [j, a, b]

    def reduce(self) -> None:
        """Fix dominating sets, longest piece first, until no length has one. Copies of a set go at once: each copy
        taken leaves fewer other sets to dominate."""
        changed = True
        while changed:
            changed = False
            for j in np.flatnonzero(self.left)[::-1].tolist():
                while self.left[j] and (found := self.dominating(j)):
                    times = min(int(self.left[s]) // n for s, n in Counter(found).items())
                    offset = 0
                    for s, n in sorted(Counter(found).items(), reverse=True):
                        self._place(s, n * times, self.sequences, n, offset)
                        offset += s * n
                    self.sequences += times
                    self.fixed += times
                    changed = True

    def fill(self) -> None:
        """Best fit of the pieces left, longest first: each goes where the least room is left that holds it."""
        rooms: list[int] = []
        groups: dict[int, list[tuple[int, int]]] = {}

        def put(room: int, sequence: int, n: int) -> None:
            if room and n:
                if room not in groups:
                    groups[room] = []
                    rooms.insert(bisect_left(rooms, room), room)
                groups[room].append((sequence, n))

        for length in np.flatnonzero(self.left)[::-1].tolist():
            while n := int(self.left[length]):
                at = bisect_left(rooms, length)
                if at < len(rooms):
                    room = rooms[at]
                    sequence, many = groups[room].pop()
                    if not groups[room]:
                        del groups[room], rooms[at]
                else:
                    room, sequence, many = self.most, self.sequences, -(-n // (self.most // length))
                    self.sequences += many
                each = room // length
                full = min(many, n // each)
                if full:
                    self._place(length, full * each, sequence, each, self.most - room)
                    put(room - each * length, sequence, full)
                sequence, many, over = sequence + full, many - full, int(self.left[length])
                if many and over:  # fewer than fill one
                    self._place(length, over, sequence, over, self.most - room)
                    put(room - over * length, sequence, 1)
                    sequence, many = sequence + 1, many - 1
                put(room, sequence, many)


def pieces(docs: DataFrame, most: int = MOST, end: int = END, path: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece, written once; task and nth number the pieces
    of each length within the task that made them."""
    path = path or vocabulary_path(VOCABULARY)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint" + ids * ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, enc, last = TaskContext.get().partitionId(), encoder(path), end.to_bytes(4, "little")
        seen = [0] * (most + 1)
        for b in in_slices(batches):
            row, piece, length, crc, nth, data = [], [], [], [], [], []
            for i, x in enumerate(enc.encode(b.column("text").to_pylist())):
                x += last
                for k, at in enumerate(range(0, len(x), 4 * most)):
                    part = x[at : at + 4 * most] if len(x) > 4 * most else x
                    n = len(part) // 4
                    row.append(i)
                    piece.append(k)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    nth.append(seen[n])
                    seen[n] += 1
                    if ids:
                        data.append(np.frombuffer(part, "<i4"))
            which = np.array(piece, dtype=np.int32)
            cols = [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(which), pa.array(which.astype(np.int64) * most), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task, dtype=np.int32)), pa.array(nth, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            if ids:
                cols.append(pa.array(data, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return stored(rows.mapInArrow(run, schema), "packing-pieces")


def planned(made: DataFrame, most: int = MOST) -> Plan:
    """The plan for pieces; one row for each length, `most` at most, comes to the driver."""
    return Plan(dict(made.groupBy("length").count().collect()), most)


def packed(made: DataFrame, most: int = MOST) -> DataFrame:
    """The pieces with sequence_id and offset."""
    runs = planned(made, most).runs
    by: dict[int, list[Run]] = defaultdict(list)
    for r in runs:
        by[r.length].append(r)
    tables = {length: np.array(found, dtype=np.int64) for length, found in by.items()}
    tasks = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    over = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = tasks.select("length", "task", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    ranked = made.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "task", "nth")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                size = int(length[rows[0]])
                found = tables[size]
                at = found[np.searchsorted(found[:, 1], rank[rows], side="right") - 1]
                k = rank[rows] - at[:, 1]
                sequence[rows] = at[:, 3] + k // at[:, 4]
                offset[rows] = at[:, 5] + k % at[:, 4] * size
            kept = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema + ", sequence_id bigint, offset bigint")


def sequences(docs: DataFrame, most: int = MOST, end: int = END, path: str | None = None) -> DataFrame:
    """sequence_id and ids: the token ids of each sequence, its pieces one after another; `most` ids at most."""
    placed = packed(pieces(docs, most, end, path, ids=True), most)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(pieces(table(spark, sf_dir, "documents")))
