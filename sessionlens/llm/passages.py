"""Passages of at least `RUN` words that repeat word for word, wherever they begin and whatever the line layout.

A window is RUN words in a row; equal windows have equal least hashes of their 25-word parts. Windows in a row with
one least are a unit. Leasts that occur twice anywhere are kept in one bitmap, those that occur in units that differ
in another (filters only: what they let through too much goes at the exact step). A repeated least whose units are all
equal sends a row for each unit, the others one for each window, and rows are grouped by the hash of their words. The
first (least doc_id, then position) stays, the others are repeats; within its own document a repeat doesn't overlap the
first (units of one least that overlap count as different). Touching repeats make one passage.
Rows of hot leasts are compared inside each task first: only a task's earliest row of equal ones goes on to the
others', the rest are repeats already. So no window's rows meet in one task, however common it is.
Texts are read twice and never shuffled. Words are lower-cased (ASCII) and compared by 64-bit hashes.

Defined results as in paragraph_minhash: null and empty texts have no passages, rows with one doc_id count as one
document, rows with a null doc_id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import HOT, released, stored
from sessionlens.llm.near import MIX, U64, splitmix

RUN = 50
PART = RUN // 2
#: Windows of a unit at most, so that its first and its last window hold all its words.
SPAN = RUN - PART + 1
FACTOR, FACTOR5 = U64(int(MIX) ** 2 % 2**64), U64(int(MIX) ** 10 % 2**64)
#: Bits of the bitmap for each repeated least, and at most (32 MB a bitmap; beyond, more windows go to the exact step).
BITS, MOST_BITS = 16, 1 << 28
#: Bytes of text taken at once.
SLICE = 1 << 20
#: Hot rows that a task remembers; beyond, it begins anew and the tasks that follow compare what it had.
MOST_EARLIEST = 1 << 17


def _rolled(h: np.ndarray, k: int, step: int, factor: np.uint64) -> np.ndarray:
    """For each place the polynomial of k values that lie step apart."""
    n = max(len(h) - (k - 1) * step, 0)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * factor + h[i * step : i * step + n]
    return out


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text's index, start, end, least, hash) of every window of every text; positions in characters."""
    b = np.frombuffer(b"\n".join(texts).lower() + b"\n", dtype=np.uint8)
    word = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word]).astype(np.int8)))
    s, e = edge[::2], edge[1::2]
    none = np.empty(0, dtype=np.int64)
    if len(s) < RUN:
        return none, none, none, none.view(U64), none.view(U64)
    size = e - s
    power = np.full(int(size.max()), MIX, dtype=U64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    at = np.flatnonzero(word)
    base = np.cumsum(size) - size
    values = (b[at].astype(U64) + U64(1)) * power[np.arange(len(at)) - np.repeat(base, size)]
    h = splitmix(np.add.reduceat(values, base) ^ (size.astype(U64) * MIX))
    g = _rolled(_rolled(h, 5, 1, FACTOR), 5, 5, FACTOR5)
    part = splitmix(g)
    least = part
    for wide in (1, 2, 4, 8):
        least = np.minimum(least[:-wide], least[wide:])
    more = RUN - PART + 1 - 16  # 16 parts so far, of the RUN - PART + 1 of a window
    least = np.minimum(least[:-more], least[more:])
    whole = splitmix(part[:-PART] * MIX + g[PART:])
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    doc = np.searchsorted(begins, s, "right") - 1
    chars = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    ok = np.flatnonzero(doc[: 1 - RUN] == doc[RUN - 1 :])
    doc = doc[ok]
    zero = chars[begins[doc]]
    return doc, chars[s[ok]] - zero, chars[e[ok + RUN - 1]] - zero, least[ok], whole[ok]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
        part, first = np.cumsum(size) // SLICE, 0
        for end in [*(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), b.num_rows]:
            if end > first:
                x = b.slice(first, end - first)
                yield x, [t.encode() for t in x.column("text").to_pylist()]
            first = end
    pa.default_memory_pool().release_unused()


def _units(doc: np.ndarray, least: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, hash) of every unit: one begins at a new least, and after SPAN windows of one."""
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])])
    at = np.arange(len(doc))
    begins = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % SPAN == 0)
    lasts = np.concatenate([begins[1:], [len(doc)]]) - 1
    return begins, lasts, splitmix(whole[begins] * MIX ^ splitmix(whole[lasts] + (lasts - begins).astype(U64)))


def _leasts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least and the hash of every unit; another hash where it overlaps one of its text with the same least."""
    for _, texts in _slices(batches):
        doc, start, end, least, whole = windows(texts)
        if len(doc):
            begins, lasts, unit = _units(doc, least, whole)
            doc, start, end, least = doc[begins], start[begins], end[lasts], least[begins]
            order = np.lexsort((start, least, doc))
            a, b = order[:-1], order[1:]
            unit[b[(doc[a] == doc[b]) & (least[a] == least[b]) & (start[b] < end[a])]] ^= U64(1)
            yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(unit.view(np.int64))], names=["least", "unit"])


class Earliest:
    """The earliest row so far of each hot window in a task; `add` gives the rows that are settled by it."""

    def __init__(self) -> None:
        self.rows: dict[int, tuple] = {}  # h -> (doc_id, start, end)

    def add(self, h: list, doc: list, start: list, end: list) -> tuple[list[tuple], list[tuple]]:
        """(repeats as (h, row, first_doc), rows still open as (h, row)): a row that overlaps the earliest one of its
        own document stays open, as does the earliest one itself."""
        done, open_ = [], []
        for k, *row in zip(h, doc, start, end, strict=True):
            first, row = self.rows.get(k), tuple(row)
            if first is None:
                self.rows[k] = row
                continue
            if row < first:
                self.rows[k] = row
                first, row = row, first
            if row[0] == first[0] and row[1] < first[2]:
                open_.append((k, row))
            else:
                done.append((k, row, first[0]))
        return done, open_


_ROW = "h bigint, lane int, doc_id {0}, start int, end int, first_doc {0}"


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h, lane, doc_id, start: those that are not the first of their h, with the first's doc_id.

    Rows of a lane other than 0 are repeats already. Streams: what it keeps between batches is one row."""
    first = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b] if first is None else [first, b]).combine_chunks().to_batches()[0]
        h, lane = t.column("h").to_numpy(), t.column("lane").to_numpy()
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (lane[1:] != lane[:-1])])
        at = np.arange(len(h))
        at = np.maximum.accumulate(np.where(new, at, 0))
        head = t.take(pa.array(at))
        own = pc.equal(t.column("doc_id"), head.column("doc_id")).to_numpy(zero_copy_only=False)
        own &= t.column("start").to_numpy() < head.column("end").to_numpy()
        told = lane > 0
        of = pc.if_else(pa.array(told), t.column("first_doc"), head.column("doc_id"))
        out = pa.RecordBatch.from_arrays([*(t.column(c) for c in ("doc_id", "start", "end")), of], names=["doc_id", "start", "end", "first_doc"])
        yield out.filter(pa.array(told | ~own))
        first = None if told[-1] else t.slice(int(at[-1]), 1)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by doc_id, start as passages: what touches is one, with the first_doc of its beginning; where
    its first_doc changes inside, a row of no span names the next one."""
    left = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b] if left is None else [left, b]).combine_chunks().to_batches()[0]
        start, end, doc, of = t.column("start").to_numpy(), t.column("end").to_numpy(), t.column("doc_id"), t.column("first_doc")
        other = pc.not_equal(doc.slice(1), doc.slice(0, len(doc) - 1)).to_numpy(zero_copy_only=False)
        begins = np.concatenate([[True], other | (start[1:] > end[:-1] + 1)])
        turns = np.concatenate([[False], pc.not_equal(of.slice(1), of.slice(0, len(of) - 1)).to_numpy(zero_copy_only=False)]) & ~begins
        at = np.flatnonzero(begins)
        head = t.take(pa.array(at))
        head = head.set_column(2, "end", pa.array(np.maximum.reduceat(end, at), pa.int32()))
        left = head.slice(len(at) - 1)
        yield head.slice(0, len(at) - 1)
        if turns.any():
            more = t.take(pa.array(np.flatnonzero(turns)))
            none = pa.nulls(len(more), pa.int32())
            yield more.set_column(1, "start", none).set_column(2, "end", none)
    if left is not None:
        yield left


#: Lanes that the settled rows of hot windows are spread over.
LANES = 256


def found(docs: DataFrame) -> DataFrame:
    """doc_id, start, end and first_doc of every passage that repeats an earlier one, and (doc_id, null, null,
    first_doc) for every further document that a passage repeats."""
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    by = texts.mapInArrow(_leasts, "least bigint, unit bigint").groupBy("least").agg(F.count("*").alias("n"), (F.min("unit") != F.max("unit")).alias("several"))
    many = stored(by.where("n > 1"), "passage-leasts")
    total = many.agg(F.count("*").alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    bits = 1 << 10
    while bits < min(BITS * total["kinds"], MOST_BITS):
        bits *= 2
    at = F.col("least").bitwiseAND(F.lit(bits - 1))
    bit = F.expr("shiftleft(1L, cast(least & 63 as int))")
    rows = many.select(F.shiftright(at, 6).cast("int").alias("at"), bit.alias("bit"), F.when(F.col("several"), bit).otherwise(F.lit(0)).alias("more"))
    rows = rows.groupBy("at").agg(F.bit_or("bit").alias("repeated"), F.bit_or("more").alias("several")).toArrow()
    bitmaps = np.zeros((2, bits // 64), dtype=np.int64)
    for k, name in enumerate(("repeated", "several")):
        bitmaps[k][rows.column("at").to_numpy()] = rows.column(name).to_numpy()
    # HOT of them at most, each with that part of the rows or more
    hot = np.array([r[0] for r in many.where(F.col("n") * HOT >= total["rows"]).select("least").collect()], dtype=np.int64)
    released(many)
    shared = spark.sparkContext.broadcast((bitmaps, hot))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, hot = shared.value[0].view(U64), shared.value[1].view(U64)
        earliest = Earliest()
        names = ["h", "lane", "doc_id", "start", "end", "first_doc"]
        id_type = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            """(h, lane, row, first_doc) as a batch."""
            h, lane, row, of = zip(*rows, strict=True)
            doc, start, end = zip(*row, strict=True)
            kinds = (pa.int64(), pa.int32(), id_type, pa.int32(), pa.int32(), id_type)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((h, lane, doc, start, end, of), kinds, strict=True)], names=names)

        def rest(earliest: Earliest) -> Iterator[pa.RecordBatch]:
            rows = [(k, 0, row, None) for k, row in earliest.rows.items()]
            for at in range(0, len(rows), 1 << 14):
                yield batch(rows[at : at + (1 << 14)])

        for b, texts_ in _slices(batches):
            id_type = b.column("doc_id").type
            doc, start, end, least, h = windows(texts_)
            if not len(doc):
                continue
            begins, lasts, unit = _units(doc, least, h)
            place = least[begins] & U64(bits - 1)
            repeated, several = ((x[place >> U64(6)] >> (place & U64(63))) & U64(1) != 0 for x in have)
            is_hot = repeated & np.isin(least[begins], hot) if len(hot) else np.zeros(len(begins), dtype=bool)
            # a row for each unit, or for each of its windows
            one = np.flatnonzero(repeated & ~several)
            each = np.flatnonzero(np.repeat(several, lasts - begins + 1))
            of = np.searchsorted(begins, each, "right") - 1
            is_hot = np.concatenate([is_hot[one], is_hot[of]])
            h = np.concatenate([unit[one], h[each]])
            doc, start, end = np.concatenate([doc[begins[one]], doc[each]]), np.concatenate([start[begins[one]], start[each]]), np.concatenate([end[lasts[one]], end[each]])
            at = np.flatnonzero(~is_hot)
            n, ids = len(at), b.column("doc_id").take(pa.array(doc[at]))
            cols = [pa.array(h[at].view(np.int64)), pa.array(np.zeros(n, dtype=np.int32)), ids, pa.array(start[at], pa.int32()), pa.array(end[at], pa.int32()), pa.nulls(n, id_type)]
            yield pa.RecordBatch.from_arrays(cols, names=names)
            if is_hot.any():
                at = np.flatnonzero(is_hot)
                ids = b.column("doc_id").take(pa.array(doc[at])).to_pylist()
                done, open_ = earliest.add(h[at].view(np.int64).tolist(), ids, start[at].tolist(), end[at].tolist())
                rows = [(k, 1 + i % LANES, row, of) for i, (k, row, of) in enumerate(done)] + [(k, 0, row, None) for k, row in open_]
                if rows:
                    yield batch(rows)
                if len(earliest.rows) > MOST_EARLIEST:
                    yield from rest(earliest)
                    earliest = Earliest()
        yield from rest(earliest)

    rows = texts.mapInArrow(candidates, _ROW.format(kind)).repartition("h", "lane").sortWithinPartitions("h", "lane", "doc_id", "start")
    schema = f"doc_id {kind}, start int, end int, first_doc {kind}"
    again = rows.mapInArrow(_repeats, schema).repartition("doc_id").sortWithinPartitions("doc_id", "start")
    return again.mapInArrow(_merged, schema)


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, start, end and first_doc (of its beginning) of every passage that repeats an earlier one."""
    return found(docs).where("start is not null")


def with_passages(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows (one for each doc_id) with n_passages, passages (start:end, joined), passage_of (doc_ids) and source_of:
    whether a passage of this document is one that another one repeats."""
    every = stored(found(docs), "passages")
    spans = F.sort_array(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "end"))))
    by = every.groupBy("doc_id").agg(F.count("start").alias("n_passages"), spans.alias("spans"), F.sort_array(F.collect_set("first_doc")).alias("passage_of"))
    sources = every.where("first_doc <> doc_id").select(F.col("first_doc").alias("doc_id")).distinct().withColumn("source_of", F.lit(True))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    empty = F.array().cast(by.schema["passage_of"].dataType)
    out = rows.join(by, "doc_id", "left").join(sources, "doc_id", "left")
    return out.select(*rows.columns, F.coalesce("n_passages", F.lit(0)).alias("n_passages"), F.coalesce(spans, F.lit("")).alias("passages"), F.coalesce("passage_of", empty).alias("passage_of"), F.coalesce("source_of", F.lit(False)).alias("source_of"))
