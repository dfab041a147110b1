"""What the near-duplicate operators share: word shingles, bands, and links confirmed on full sets.

A class is all units (documents, paragraphs) with the same shingle set, named by the set's 128-bit digest. Links
are looked for between classes only. Every band value makes a bucket; in each bucket every class is paired with
the bucket's least class, so the pairs grow with the bucket and not with its square. Buckets whose classes are
still in several components after those links go through block pairs: every pair across components is compared
by signature, in bounded blocks, and those that may pass are confirmed too. So no candidate is lost, whatever
the size of a bucket, and no group is ever held whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import block_pairs, components, released, stored

U64 = np.uint64
MIX = U64(0x9E3779B97F4A7C15)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The public SplitMix64 finalizer."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingle_sets(units: list[list[bytes]], k: int = 5) -> list[np.ndarray]:
    """For each list of words its sorted distinct 64-bit shingles of k words; fewer words are one shingle, none is
    the empty set. All words of the units are hashed and rolled in one array."""
    import xxhash

    words = [w for u in units for w in u]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U64, count=len(words))
    n = max(len(h) - k + 1, 0)
    w = h[:n].copy()
    for i in range(1, k):
        w = (w ^ (w >> U64(29))) * MIX + h[i : i + n]
    w = splitmix(w)
    out, at = [], 0
    for u in units:
        size = len(u)
        if size >= k:
            s = np.sort(w[at : at + size - k + 1])
            same = s[1:] == s[:-1]
            out.append(s[np.concatenate([[True], ~same])] if same.any() else s)
        elif size:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(u), seed=size)], dtype=U64))
        else:
            out.append(np.empty(0, dtype=U64))
        at += size
    return out


def set_digest(s: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


@lru_cache(maxsize=16)
def tuned(threshold: float, most: int = 128, recall: float = 0.99999) -> tuple[int, int]:
    """(bands, rows) within `most` components: the most rows (fewest false candidates), and for them the fewest
    bands, that find a pair at the threshold with probability `recall`, one minus (1 - threshold**rows)**bands."""
    for rows in range(16, 0, -1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    return most, 1


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature (units x components)."""
    s = sig[:, : bands * rows].reshape(len(sig), bands, rows).astype(U64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * MIX, (len(sig), bands)).copy()
    for r in range(rows):
        key = splitmix(key ^ s[:, :, r]) + MIX
    return key.view(np.int64)


def min_hash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Plain MinHash: for each (non-empty) set the least of m multiplicative 32-bit hashes of its elements, which
    are mixed already."""
    seeds = (splitmix(np.arange(1, m + 1, dtype=U64) * MIX) >> U64(32)).astype(np.uint32) | np.uint32(1)
    room = np.empty((1024, m), dtype=np.uint32)
    out = np.full((len(sets), m), 0xFFFFFFFF, dtype=np.uint32)
    for i, s in enumerate(sets):
        x = (s >> U64(32)).astype(np.uint32)[:, None]
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            h = np.multiply(part, seeds, out=room[: len(part)])
            np.minimum(out[i], h.min(axis=0), out=out[i])
    return out


def rows_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of an Arrow list column as NumPy views."""
    out = []
    for c in column.chunks:
        at, values = c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)
        out += [values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return out


#: In blocks, a pair whose signatures agree by less than the threshold minus this isn't confirmed. A signature's
#: agreement deviates by sqrt(j * (1 - j) / 128), 0.035 at most from j = 0.8 on, so this is six deviations: of 1e9
#: pairs at the threshold about one is lost here.
SLACK = 0.22
BLOCK_SIGNATURE = 128


def _across(percent: int):
    """Links between classes of different components in one block pair, confirmed on the full sets.

    A pair that shares several bands is left to the group of the first of them.
    """
    threshold = percent / 100

    def run(t: pa.Table) -> pa.Table:
        fp, comp = t.column("fp").to_pylist(), np.array([hash(x) for x in t.column("comp").to_pylist()])
        n, side, band = t.column("n").to_numpy(), t.column("side").to_numpy(), t.column("band")[0].as_py()
        sets, bands = rows_of(t.column("set")), np.stack(rows_of(t.column("bands")))
        sig = min_hash([x.view(U64) for x in sets], BLOCK_SIGNATURE)
        one = np.flatnonzero(side == 0)
        two = np.flatnonzero(side == 1) if (t.column("bi")[0].as_py() != t.column("bj")[0].as_py()) else one
        a, b = [], []
        for i in one:
            fit = two[two > i] if two is one else two
            fit = fit[(comp[fit] != comp[i]) & (np.minimum(n[fit], n[i]) >= threshold * np.maximum(n[fit], n[i]))]
            fit = fit[(sig[fit] == sig[i]).mean(axis=1) >= threshold - SLACK]
            for j in fit:
                if comp[j] == comp[i] or bands[i][np.argmax(bands[i] == bands[j])] != band:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a.append(fp[i])
                    b.append(fp[j])
                    comp[comp == comp[j]] = comp[i]  # these two components need no other link from here
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, s) sorted by band: give every row of a band of two or more distinct s the band's first as hub.

    Streams: what it keeps between batches is one row, so a band of any size passes through. An s that comes again
    at once counts once.
    """
    band0 = hub0 = last0 = None
    hub_out = True
    for x in batches:
        band, s = x.column("band").to_numpy(), x.column("s").to_numpy()
        if not len(band):
            continue
        again = np.concatenate([[band[0] == band0 and s[0] == last0], (band[1:] == band[:-1]) & (s[1:] == s[:-1])])
        band, s = band[~again], s[~again]
        if not len(band):
            continue
        start = np.concatenate([[band0 is None or band[0] != band0], band[1:] != band[:-1]])
        at = np.maximum.accumulate(np.where(start, np.arange(len(band)), -1))
        hub = np.where(at >= 0, s[np.maximum(at, 0)], hub0 if hub0 is not None else 0)
        more = np.flatnonzero(~start)
        first = more[np.concatenate([[True], at[more][1:] != at[more][:-1]])] if len(more) else more
        if len(first) and at[first[0]] < 0 and hub_out:
            first = first[1:]
        band0, hub0, last0 = band[-1], hub[-1], s[-1]
        # has the last run's hub gone out by now?
        hub_out = bool(len(more)) and more[-1] == len(band) - 1 if start.any() else hub_out or bool(len(more))
        out_b, out_s, out_h = np.concatenate([band[first], band[more]]), np.concatenate([hub[first], s[more]]), np.concatenate([hub[first], hub[more]])
        yield pa.RecordBatch.from_arrays([pa.array(out_b), pa.array(out_s), pa.array(out_h)], names=["band", "s", "hub"])


def class_components(classes: DataFrame, banded: DataFrame, sets_of: Callable[[DataFrame, bool], DataFrame], percent: int, block: int = 256) -> DataFrame:
    """(node, component): components of the classes that have links; node and component are set digests.

    classes: fp binary, n long (set size); one row a class. banded: fp, bands array<long>; read once, so it may
    be computed on the fly. sets_of: given a table of fp, returns (fp, set array<long>), one row each, and with
    True their bands too.
    Links are pairs with 100 * intersection >= percent * union. Bucket rows carry a 64-bit stand-in of fp; where
    two classes share one, both are tried.
    """
    threshold = percent / 100
    rows = banded.select(F.xxhash64("fp").alias("s"), F.explode("bands").alias("band"))
    # one numeric sort column, which Spark sorts by its bits; any member of a bucket may be its hub
    rows = rows.repartition("band").sortWithinPartitions("band")
    members = stored(rows.mapInArrow(_runs, "band bigint, s bigint, hub bigint"), "near-members")
    names = classes.select(F.xxhash64("fp").alias("s"), "fp", "n")
    pairs = members.where("s <> hub").select("s", "hub").distinct()
    pairs = pairs.join(names.select("s", F.col("fp").alias("a"), F.col("n").alias("na")), "s")
    pairs = pairs.join(names.select(F.col("s").alias("hub"), F.col("fp").alias("b"), F.col("n").alias("nb")), "hub")
    near = F.least("na", "nb") >= threshold * F.greatest("na", "nb")
    links = confirmed(pairs.where(near & (F.col("a") != F.col("b"))).select("a", "b"), sets_of, percent)
    roots = stored(components(links), "near-roots")
    released(links)

    # buckets of three and more that are still in several components: the pairs across them, in blocks
    wide = members.join(members.groupBy("band").agg(F.count("*").alias("size")).where("size > 2").select("band"), "band", "left_semi")
    wide = wide.select("band", "s").distinct().join(names, "s").join(roots, F.col("fp") == F.col("node"), "left")
    wide = stored(wide.select("band", "fp", "n", F.coalesce("component", "fp").alias("comp")), "near-wide")
    split = wide.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band")
    rest = stored(wide.join(split, "band", "left_semi"), "near-rest")
    released(members, wide)
    if rest.isEmpty():
        return roots
    full = stored(sets_of(rest.select("fp").distinct(), True), "near-full")
    dealt = block_pairs(rest, ["band"], "fp", block, "n").join(full, "fp")
    more = dealt.groupBy("band", "bi", "bj").applyInArrow(_across(percent), "a binary, b binary")
    links = stored(more.unionAll(roots.select(F.col("node").alias("a"), F.col("component").alias("b"))), "near-more")
    released(rest, full)
    return components(links)


#: Pairs of one hub that a lane takes, about.
LANE = 4_096


def confirmed(pairs: DataFrame, sets_of: Callable[[DataFrame, bool], DataFrame], percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets pass.

    A hub may be the b of very many pairs: they are dealt into lanes by a, as many as the number of pairs asks
    for, and its set goes to each lane that it has pairs in.
    """
    pairs = stored(pairs, "near-pairs")
    lanes, n = 16, pairs.count()
    while lanes * LANE < n:
        lanes *= 2
    ends = pairs.select(F.col("a").alias("fp")).unionAll(pairs.select(F.col("b").alias("fp"))).distinct()
    sets = stored(sets_of(ends, False), "near-sets")
    pairs_in = pairs.withColumn("lane", F.pmod(F.xxhash64("a"), F.lit(lanes)))
    hubs = pairs_in.select("b", "lane").distinct().join(sets.select(F.col("fp").alias("b"), F.col("set").alias("y")), "b")
    out = pairs_in.join(sets.select(F.col("fp").alias("a"), F.col("set").alias("x")), "a").join(hubs, ["b", "lane"])
    both = F.size(F.array_intersect("x", "y")).cast("long")
    passes = F.lit(100) * both >= F.lit(percent) * (F.size("x") + F.size("y") - both)
    out = stored(out.where(passes).select("a", "b"), "near-links")
    released(pairs, sets)
    return out
