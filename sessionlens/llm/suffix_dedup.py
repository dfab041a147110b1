"""Exact substring dedup: every byte covered by a string of `length` bytes that starts twice or more goes.

1. Anchors deal the corpus into shards. Every window of `length` bytes has an anchor, the last of its least
   48-byte hashes, which depends on the window's bytes alone; equal windows therefore meet under one anchor hash.
   Neighbouring windows with one anchor make a unit. Units whose bytes are equal are repeated as a whole; only
   units that share an anchor hash but not their bytes need to be compared.
2. Those units' bytes are sorted by external induced suffix sorting (see `induced`), shard by shard: tuples of a
   suffix's symbols and the rank behind them go through queues that lie on disk beyond a bound, and common prefixes
   are carried through the recursion. Units, text and results of a long shard are files of the task.
3. Neighbours in suffix order that share `length` bytes mark their windows.
An anchor with many open units is no single shard: its windows are dealt on by further anchors, the least bytes of
other hashes over the same window, which equal windows share too.

Strings are judged on the input and matches never cross documents. Defined results: a null text is empty;
repeated rows count as documents of their own (their windows repeat); a null doc_id is a value like others; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm.common import HOT, in_slices, stored, table
from sessionlens.llm.induced import Disk, Text, sorted_suffixes
from sessionlens.llm.near import U64, splitmix

LENGTH = 400
#: Bytes of the hashed strings that anchors are chosen by.
GRAM = 48
#: Bytes handled at once when anchors are chosen; longer texts go in overlapping pieces.
PIECE = 1 << 19
#: Bytes of text that are sorted together, about; a larger group of units under one anchor is sorted whole.
BLOCK = 2 << 20
#: Tuples, and symbols of a text, above which a sort lies on disk.
IN_MEMORY = 1 << 22
#: Further hashes whose anchors deal out the windows of a hot anchor.
FURTHER = 3

_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = splitmix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, U64(_BASE))
    up[0] = 1
    down = np.full(n, U64(pow(_BASE, -1, 1 << 64)))
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POWERS: list = []


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, dtype=U64)]).reshape(-1, w)
    fore = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], fore[w - 1 : w - 1 + n])


def grams(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM-byte strings of `data` (at most 2**20 bytes)."""
    if not _POWERS:
        _POWERS.extend(_powers(1 << 20))
    up, down = _POWERS
    total = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(_VALUES[data] * up[: len(data)], dtype=U64)])
    return splitmix((total[GRAM:] - total[:-GRAM]) * down[: len(data) - GRAM + 1])


def least(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(least hash, its position) of the window that starts at each position."""
    low = U64((1 << 20) - 1)
    at = np.arange(len(h), dtype=U64)
    least_ = _sliding_min((h & ~low) | (low - at), length - GRAM + 1)  # of equal hashes the last position wins
    pos = (low - (least_ & low)).astype(np.int64)
    return h[pos], pos


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor hash, anchor position) of the window that starts at each position of `data`."""
    return least(grams(data), length)


def dealt_on(data: bytes, length: int) -> list[tuple[int, int, int]]:
    """(hash, first, last start) of a unit's windows by FURTHER other anchors each."""
    h = grams(np.frombuffer(data, dtype=np.uint8))
    name, new = np.zeros(len(data) - length + 1, dtype=U64), np.zeros(len(data) - length + 1, dtype=bool)
    new[0] = True
    for k in range(1, FURTHER + 1):
        of, pos = least(splitmix(h + U64(k * _BASE % (1 << 64))), length)
        name = splitmix(name ^ of)
        new[1:] |= pos[1:] != pos[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(name) - 1)
    return list(zip(name[first].view(np.int64).tolist(), first.tolist(), last.tolist(), strict=True))


def units_of(texts: list[bytes], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(text's number, anchor hash, first, last start) of the units of each text."""
    group: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> Iterator[tuple[int, int, int, int]]:
        data = np.frombuffer(b"".join(t for _, _, t in group), dtype=np.uint8)
        if len(data) < length:
            return
        h, pos = anchors(data, length)
        at = 0
        for i, shift, t in group:
            n = len(t) - length + 1
            hh, pp = h[at : at + n], pos[at : at + n]
            first = np.flatnonzero(np.concatenate([[True], pp[1:] != pp[:-1]]))
            last = np.concatenate([first[1:] - 1, [n - 1]])
            for a, s, e in zip(hh[first].view(np.int64).tolist(), first.tolist(), last.tolist(), strict=True):
                yield i, a, s + shift, e + shift
            at += len(t)

    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        # pieces overlap so that each window lies in one piece whole
        for shift in range(0, len(t) - length + 1, PIECE - length + 1):
            piece = t[shift : shift + PIECE]
            if held + len(piece) > PIECE:
                yield from flush()
                group, held = [], 0
            group.append((i, shift, piece))
            held += len(piece)
    if group:
        yield from flush()


def suffix_order(text: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """Start positions (all, or the wanted ones) in the order of their suffixes; text as in `sorted_suffixes`."""
    return sorted_suffixes(text, wanted, LENGTH, IN_MEMORY)[0]


class Shard:
    """Units that are sorted together. Their symbols (bytes plus two, one behind each unit) and what is known of them
    go to files once they are long."""

    UNIT = np.dtype([("key", "V16"), ("first", "<i8"), ("last", "<i8"), ("single", "?"), ("at", "<i8")])

    def __init__(self, length: int) -> None:
        self.length, self.size, self.windows = length, 0, 0
        self.symbols: list[np.ndarray] = []
        self.units: list[tuple] = []
        self.held = 0
        self.folder: tempfile.TemporaryDirectory | None = None

    def add(self, key: bytes, first: int, last: int, single: bool, data: bytes) -> None:
        x = np.ones(len(data) + 1, dtype=np.uint16)
        x[:-1] = np.frombuffer(data, dtype=np.uint8)
        x[:-1] += 2
        self.symbols.append(x)
        self.units.append((key, first, last, single, self.size))
        self.size += len(x)
        self.held += len(x)
        self.windows += last - first + 1
        if self.held > IN_MEMORY:
            self._spill()

    def _spill(self) -> None:
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="sl_shard_")
        with open(os.path.join(self.folder.name, "symbols"), "ab") as f:
            np.concatenate(self.symbols).tofile(f)
        with open(os.path.join(self.folder.name, "units"), "ab") as f:
            np.array(self.units, dtype=self.UNIT).tofile(f)
        self.symbols, self.units, self.held = [], [], 0

    def _loaded(self) -> tuple[np.ndarray, np.ndarray]:
        """(text with its end, units), from the files where there are any."""
        self.symbols.append(np.zeros(1, dtype=np.uint16))
        if self.folder is None:
            return np.concatenate(self.symbols), np.array(self.units, dtype=self.UNIT)
        self._spill()
        return tuple(np.memmap(os.path.join(self.folder.name, name), dtype=kind, mode="r") for name, kind in (("symbols", np.uint16), ("units", self.UNIT)))

    def repeated(self) -> Iterator[pa.RecordBatch]:
        """(key, first, last) ranges of windows of single units whose string starts anywhere else in the shard."""
        with tempfile.TemporaryDirectory(prefix="sl_sort_") as folder:
            disk = Disk(IN_MEMORY, folder)
            text, units = self._loaded()
            wanted, at = disk.empty(self.windows), 0
            for part in disk.parts(len(units)):
                u = units[part]
                n = u["last"] - u["first"] + 1
                end = at + int(n.sum())
                wanted[at:end] = np.repeat(u["at"] - (np.cumsum(n) - n), n) + np.arange(end - at)
                at = end
            order, shared = Text(disk, text).sorted(wanted, self.length)
            twice = disk.empty(len(text), bool)
            for part in disk.parts(len(text)):
                twice[part] = False
            for part in disk.parts(self.windows):
                hit = np.flatnonzero(shared[part] >= self.length) + part.start
                twice[order[hit]] = True
                twice[order[hit - 1]] = True
            for part in disk.parts(len(units)):
                key, first, last = [], [], []
                for k, s, e, single, at in units[part].tolist():
                    if single:
                        hit = np.flatnonzero(np.diff(np.concatenate([[0], twice[at : at + e - s + 1].astype(np.int8), [0]])))
                        for a, b in zip(hit[::2].tolist(), hit[1::2].tolist(), strict=True):
                            key.append(k)
                            first.append(s + a)
                            last.append(s + b - 1)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["key", "first", "last"])
        if self.folder is not None:
            self.folder.cleanup()


# ---- the dataflow


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes, key: a 128-bit digest of both."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text)))
    return docs.select("doc_id", text.cast("binary").alias("text"), key.alias("key"))


def _units(rows: DataFrame, length: int) -> DataFrame:
    """anchor, digest of the unit's bytes, key, first and last start, of every unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in in_slices(batches):
            texts, keys = b.column("text").to_pylist(), b.column("key").to_pylist()
            anchor, digest, key, first, last = [], [], [], [], []
            for i, a, s, e in units_of(texts, length):
                anchor.append(a)
                digest.append(xxhash.xxh3_128_digest(texts[i][s : e + length]))
                key.append(keys[i])
                first.append(s)
                last.append(e)
            cols = [pa.array(anchor, pa.int64()), pa.array(digest, pa.binary()), pa.array(key, pa.binary()), pa.array(first, pa.int64()), pa.array(last, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["anchor", "digest", "key", "first", "last"])

    return rows.select("key", "text").mapInArrow(run, "anchor bigint, digest binary, key binary, first bigint, last bigint")


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream units sorted by (anchor, digest): `whole` units, whose bytes repeat, and one `open` unit of each
    class under an anchor with several classes (with `single`: its bytes don't repeat as a whole).

    What it keeps between batches is two rows, so an anchor of any size passes through.
    """
    held = None  # the latest unit, not sent yet: (anchor, digest, key, first, last), how many like it, classes so far
    waiting = None  # the first class of the anchor, until a second one turns up
    same, classes = 0, 0
    for b in batches:
        out: list[tuple] = []

        def close(unit: tuple, last_of_anchor: bool, out: list = out) -> None:
            """The class of `unit` is complete."""
            nonlocal waiting
            one = (*unit, False, True, same == 1)
            if classes == 1:
                waiting = one
            else:
                if waiting is not None:
                    out.append(waiting)
                    waiting = None
                out.append(one)
            if last_of_anchor:
                waiting = None

        for unit in zip(*(b.column(c).to_pylist() for c in ("anchor", "digest", "key", "first", "last")), strict=True):
            if held is not None and unit[:2] == held[:2]:
                if same == 1:
                    out.append((*held, True, False, False))
                out.append((*unit, True, False, False))
                same += 1
                continue
            if held is not None:
                close(held, unit[0] != held[0])
            classes = classes + 1 if held is not None and unit[0] == held[0] else 1
            held, same = unit, 1
        yield _as_batch(out)
    if held is not None:
        out = []
        if classes > 1:
            out = [waiting] if waiting is not None else []
            out.append((*held, False, True, same == 1))
        yield _as_batch(out)


_SORTED = "anchor bigint, digest binary, key binary, first bigint, last bigint, whole boolean, open boolean, single boolean"


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
    cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(cols, names=[x.split(" ")[0] for x in _SORTED.split(", ")])


def _open_texts(rows: DataFrame, open_: DataFrame, length: int, hot: frozenset[int]) -> DataFrame:
    """The bytes of open units, cut from their documents; those under a hot anchor are dealt on (sub, offset in the
    unit)."""
    by = open_.groupBy("key").agg(F.collect_list(F.struct("anchor", "digest", "first", "last", "single")).alias("units"))
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    names = ["anchor", "sub", "digest", "offset", "key", "first", "last", "single", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            out = []
            for key, text, units in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("units").to_pylist(), strict=True):
                for u in units:
                    first, last = u["first"], u["last"]
                    pieces = dealt_on(text[first : last + length], length) if u["anchor"] in hot else [(0, 0, last - first)]
                    out += [(u["anchor"], sub, u["digest"], s, key, first + s, first + e, u["single"], text[first + s : first + e + length]) for sub, s, e in pieces]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    schema = "anchor bigint, sub bigint, digest binary, offset bigint, key binary, first bigint, last bigint, single boolean, bytes binary"
    return rows.select("key", "text").join(by, "key").mapInArrow(run, schema)


def _compared(length: int):
    """Stream open units sorted by anchor, sort the suffixes of whole anchors shard by shard, and give the
    (key, first, last) ranges of windows of single units that start elsewhere too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, group, before = Shard(length), None, None
        for b in batches:
            seen = (b.column(c).to_pylist() for c in ("anchor", "sub", "digest", "offset", "key", "first", "last", "single", "bytes"))
            for anchor, sub, digest, offset, key, first, last, single, data in zip(*seen, strict=True):
                if before == (anchor, sub, digest, offset):
                    continue  # the same unit from a repeated row
                if shard.size >= BLOCK and group != (anchor, sub):
                    yield from shard.repeated()
                    shard = Shard(length)
                group, before = (anchor, sub), (anchor, sub, digest, offset)
                shard.add(key, first, last, single, data)
        if shard.size:
            yield from shard.repeated()

    return run


def covered(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """key, first, last: ranges of window starts whose string starts elsewhere too; may touch or overlap."""
    units = _units(rows, length).repartition("anchor").sortWithinPartitions("anchor", "digest", "key", "first")
    told = stored(units.mapInArrow(_sorted_out, _SORTED), "suffix-units")
    opens = told.where("open")
    # anchors that hold 1 / HOT of the open bytes, HOT at most, and more than a shard
    size = F.sum(F.col("last") - F.col("first") + length)
    total = opens.agg(size).first()[0] or 0
    big = opens.groupBy("anchor").agg(size.alias("size")).where((F.col("size") * HOT >= total) & (F.col("size") > BLOCK))
    hot = frozenset(r[0] for r in big.select("anchor").collect())
    texts = _open_texts(rows, opens, length, hot)
    texts = texts.repartition("anchor", "sub").sortWithinPartitions("anchor", "sub", "digest", "offset")
    found = texts.mapInArrow(_compared(length), "key binary, first bigint, last bigint")
    return told.where("whole").select("key", "first", "last").unionAll(found)


def merged(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal removed (start, end) of window-start ranges."""
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e + length)
        else:
            out.append([s, e + length])
    return [(s, e) for s, e in out]


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start:end, joined), kept (the bytes left)."""
    rows = _rows(docs)
    by = covered(rows, length).groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans string, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            out = []
            for text, ranges in zip(b.column("text").to_pylist(), b.column("ranges").to_pylist(), strict=True):
                spans = merged([(r["first"], r["last"]) for r in ranges or []], length)
                at, parts = 0, []
                for s, e in spans:
                    parts.append(text[at:s])
                    at = e
                kept = b"".join([*parts, text[at:]])
                out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), ",".join(f"{s}:{e}" for s, e in spans), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            cols = [b.column("doc_id"), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return rows.join(by, "key", "left").select("doc_id", "text", "ranges").mapInArrow(run, schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).drop("kept")
