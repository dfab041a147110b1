"""Sharding by balanced label propagation, in DataFrame operations only.

Linked documents are those of equal text. A group's documents in one shard form a cell (group, shard, rows), so
the graph is never spelled out in pairs. Cells start by the hash of doc_id. In every round each group names the
shard where most of its documents are, its other cells ask to move there, and each shard admits requests in order
of gain up to its quota; what is refused asks for the next fullest shard of the group in the next round. Rounds go on
until they bring hardly any documents together; the best round counts. Documents without links have no edge to cut and
fill what is left, so that the counts end at most one apart (law `rows`).

Defined results: a null text has size 8, the checksum of no bytes, and no links; repeated rows are documents of
their own, and those with one doc_id and one text are ranked in one window; a null doc_id is a value like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlens.llm.common import checkpointed, joined, running_total, stored, table

SHARDS = 24
#: Rounds end after two that each close less than this part of the gap to whole groups.
SETTLED = 0.01
#: Rows of a lane, about, when rows get ranks.
LANE = 4_096


def _nodes(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, digest of the text (null: none), uid: a spread order of the rows."""
    text = F.col("text").cast("string")
    bytes_ = F.octet_length(F.coalesce(text, F.lit(""))).cast("long")
    return docs.select(
        "doc_id",
        (bytes_ + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.md5(text).alias("digest"),
        F.xxhash64("doc_id", F.coalesce(text, F.lit(""))).alias("uid"),
    )


def _lanes(rows: int) -> int:
    """Lanes for so many rows, 64 at least."""
    return max(64, 1 << (rows // LANE).bit_length())


def _together(cells: DataFrame) -> float:
    """How far groups are in one place: the sum of n * log2(n) over cells, which small groups count in as well."""
    return float(cells.agg(F.coalesce(F.sum(F.col("n") * F.log2("n")), F.lit(0.0))).first()[0])


def propagated(linked: DataFrame, quotas: DataFrame, shards: int) -> DataFrame:
    """Cells (digest, shard, n) after balanced label propagation.

    linked: digest, shard: the documents with links at their first shard. quotas: shard, quota.
    """
    best = cells = checkpointed(linked.groupBy("digest", "shard").agg(F.count("*").alias("n")))
    spread = _lanes(cells.count() // shards)
    most = quotas.agg(F.max("quota")).first()[0] or 1
    whole = cells.groupBy("digest").agg(F.sum("n").alias("n"))
    goal = float(whole.agg(F.coalesce(F.sum(F.col("n") * F.log2(F.least("n", F.lit(most)))), F.lit(0.0))).first()[0])
    reached, idle = _together(cells), 0
    while idle < 2 and reached < goal:
        load = quotas.join(cells.groupBy("shard").agg(F.sum("n").alias("load")), "shard", "left")
        room = load.select("shard", (F.col("quota") - F.coalesce("load", F.lit(0))).alias("room"))
        # the fullest shard of each group that has room, ties by a hash so that groups spread
        tie = F.xxhash64("digest", "shard")
        open_cells = cells.join(F.broadcast(room.where("room > 0")), "shard")
        to = open_cells.groupBy("digest").agg(F.max(F.struct("n", tie.alias("tie"), "shard")).alias("best"))
        asks = cells.join(to, "digest").where("shard <> best.shard").select("digest", "shard", "n", F.col("best.shard").alias("to"), F.col("best.n").alias("gain"))
        asks = asks.withColumn("band", (-F.floor(F.log2("gain"))).cast("long")).withColumn("lane", F.col("band") * spread + F.pmod(F.xxhash64("digest"), F.lit(spread)))
        # admitted in order of gain (by powers of two, then spread) until the shard's room is full
        placed = running_total(asks, ["to"], "lane", [F.desc("gain"), "digest", "shard"], "n", "ahead")
        placed = placed.join(F.broadcast(room.withColumnRenamed("shard", "to")), "to")
        moves = placed.withColumn("moved", F.least("n", F.greatest(F.col("room") - F.col("ahead"), F.lit(0)))).where("moved > 0")
        moves = checkpointed(moves.select("digest", "shard", "to", "moved"))
        change = moves.select("digest", "shard", (-F.col("moved")).alias("n")).unionAll(moves.select("digest", F.col("to").alias("shard"), F.col("moved").alias("n")))
        cells = checkpointed(cells.unionByName(change).groupBy("digest", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
        now = _together(cells)
        idle = 0 if now - reached >= SETTLED * (goal - reached) else idle + 1
        if now > reached:
            best, reached = cells, now
    return best


def _shed(cells: DataFrame, quotas: DataFrame) -> DataFrame:
    """Where linked documents alone overfill a shard (many links, unlucky hashes), move the surplus to shards
    with room: surplus and room are laid along one line each and matched by overlap."""
    load = quotas.join(cells.groupBy("shard").agg(F.sum("n").alias("load")), "shard", "left").withColumn("load", F.coalesce("load", F.lit(0)))
    over = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    rooms = load.withColumn("room", F.greatest(F.col("quota") - F.col("load"), F.lit(0)))
    rooms = rooms.select(F.col("shard").alias("to"), F.coalesce(F.sum("room").over(over), F.lit(0)).alias("room_from"), "room").where("room > 0")
    excess = load.withColumn("excess", F.greatest(F.col("load") - F.col("quota"), F.lit(0)))
    excess = excess.select("shard", "excess", F.coalesce(F.sum("excess").over(over), F.lit(0)).alias("excess_from")).where("excess > 0")
    spread = _lanes(cells.count() // max(1, quotas.count()))
    small = cells.join(F.broadcast(excess), "shard").withColumn("lane", F.floor(F.log2("n")).cast("long") * spread + F.pmod(F.xxhash64("digest"), F.lit(spread)))
    out = running_total(small, ["shard"], "lane", ["digest"], "n", "ahead").where("ahead < excess")
    out = out.select("digest", "shard", (F.col("excess_from") + F.col("ahead")).alias("a"), (F.col("excess_from") + F.least(F.col("ahead") + F.col("n"), F.col("excess"))).alias("b"))
    lots = [(r["to"], r["room_from"], r["room_from"] + r["room"]) for r in rooms.collect()]  # at most one a shard
    if not lots:
        return cells
    each = [F.struct(F.lit(to).alias("to"), F.lit(a).alias("a"), F.lit(b).alias("b")) for to, a, b in lots]
    moves = out.withColumn("lot", F.explode(F.array(*each)))
    moved = F.least("b", F.col("lot.b")) - F.greatest("a", F.col("lot.a"))
    moves = moves.select("digest", "shard", F.col("lot.to").alias("to"), moved.alias("moved")).where("moved > 0")
    change = moves.select("digest", "shard", (-F.col("moved")).alias("n")).unionAll(moves.select("digest", F.col("to").alias("shard"), F.col("moved").alias("n")))
    return cells.unionByName(change).groupBy("digest", "shard").agg(F.sum("n").alias("n")).where("n > 0")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot (gapless from 0 in each shard), grown_shard (null)."""
    spark = docs.sparkSession
    nodes = stored(_nodes(docs), "shard-nodes")
    groups = nodes.where("digest is not null").groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1")
    # copies: how many documents have the text; null without links
    nodes = stored(joined(nodes, stored(groups, "shard-groups"), "digest", "copies"), "shard-marked")
    linked = nodes.where("copies is not null").withColumn("shard", F.pmod("uid", F.lit(shards)).cast("int"))
    total = nodes.count()
    quotas = spark.range(shards, numPartitions=1).select(F.col("id").cast("int").alias("shard"))
    quotas = quotas.withColumn("quota", F.lit(total // shards) + (F.col("shard") < total % shards).cast("long"))
    cells = checkpointed(_shed(propagated(linked, quotas, shards), quotas))

    # linked rows: rank within the group by lanes, as many as its size asks for, and the group's cells as ranges of
    # ranks (one array a group), which reach the rows lane by lane
    ranked = linked.withColumn("lane", F.pmod(F.shiftright("uid", 8), F.ceil(F.col("copies") / LANE)))
    upto = Window.partitionBy("digest").orderBy("shard")
    ranges = cells.select("digest", "shard", F.sum("n").over(upto).alias("upto")).groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("ranges"))
    before = Window.partitionBy("digest").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = ranked.groupBy("digest", "lane").agg(F.count("*").alias("n"))
    lanes = lanes.select("digest", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")).join(ranges, "digest")
    inside = Window.partitionBy("digest", "lane").orderBy("uid", "doc_id")
    ranked = ranked.join(lanes, ["digest", "lane"]).withColumn("rank", F.col("offset") + F.row_number().over(inside) - 1)
    at = F.filter("ranges", lambda r: r["upto"] > F.col("rank"))
    put = ranked.select("doc_id", "size", "text_crc32", "uid", F.element_at(at, 1)["shard"].alias("shard"))

    # rows without links fill up each shard's quota, in the order of their hash
    bits = _lanes(total).bit_length() - 1
    alone = nodes.where("copies is null").select("doc_id", "size", "text_crc32", "uid", F.lit(1).alias("one"))
    alone = alone.withColumn("lane", F.shiftright("uid", 64 - bits))
    alone = running_total(alone, [], "lane", ["uid", "doc_id"], "one", "rank")
    held = cells.groupBy("shard").agg(F.sum("n").alias("held"))
    free = quotas.join(held, "shard", "left").withColumn("free", F.col("quota") - F.coalesce("held", F.lit(0)))
    upto = Window.partitionBy(F.lit(0)).orderBy("shard")
    free = free.select("shard", F.sum("free").over(upto).alias("upto"))
    to = F.lit(None).cast("int")
    for r in free.orderBy(F.desc("shard")).collect():  # one row a shard
        to = F.when(F.col("rank") < r["upto"], F.lit(r["shard"])).otherwise(to)
    filled = alone.select("doc_id", "size", "text_crc32", "uid", to.alias("shard"))

    every = put.unionByName(filled).withColumn("one", F.lit(1)).withColumn("lane", F.pmod(F.shiftright("uid", 16), F.lit(_lanes(total // shards))))
    every = running_total(stored(every, "shard-put"), ["shard"], "lane", ["uid", "doc_id"], "one", "slot")
    return every.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))
