"""Merkle manifest of a table: a leaf for each row, a tree of runs for each group, a tree of runs over the groups.

Leaves are hashed where the rows are read; their places within a group come from a range exchange and from one count
for each group and partition. A level is one window: rows are partitioned by group and parent's place, the ordered
list over the full frame is the parent's preimage and gives each row its siblings, and the parents, one of each run
after duplicates are dropped, are the next level, an eighth of the rows. Paths are put together from the top down, so
that a run's path is built once; a row's proof holds the hashes left and right of it, level by level.

Defined results: a null field is `-`, so a null text and an empty one differ; null groups come first and are a group
of their own, null orders come first; rows of one order go by their leaves, equal rows are leaves of their own; a group
of one row has that leaf as subroot; an empty table gives an empty result; other columns are ignored, whatever their
names; a text of any length is hashed as one stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlens.llm.common import SMALL, joined, stored, table

#: Consecutive nodes that become one parent.
RUN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(c: Column) -> Column:
    """A field in a leaf's preimage: its UTF-8 byte count, a colon and its value; `-` where it is null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `at`, the place in their group g by `order` from 0, and `n`, the rows of g.

    A range exchange over (g, *order) lays the rows in order; a group may span partitions. Only one row for each
    group and partition is ordered after that.
    """
    laid = stored(rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("id", F.monotonically_increasing_id()), "merkle-laid")
    part = F.shiftrightunsigned("id", 33).alias("part")
    counts = laid.groupBy("g", part).agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = stored(counts.select("g", "part", "first", before.alias("before"), F.sum("rows").over(group).alias("n")), "merkle-counts")
    few = counts.count() <= SMALL
    out = laid.withColumn("part", part).join(F.broadcast(counts) if few else counts, ["g", "part"])
    return out.withColumn("at", F.col("id") - F.col("first") + F.col("before")).drop("id", "part", "first", "before")


def with_run(nodes: DataFrame) -> DataFrame:
    """nodes (g, at, n, h, ...) with `up`, their parent's place, and `run`, the hashes of their run in order."""
    nodes = nodes.withColumn("up", F.floor(F.col("at") / RUN))
    whole = Window.partitionBy("g", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.withColumn("run", F.collect_list("h").over(whole))


def step() -> Column:
    """What stands left and right of a node in its run."""
    place = (F.col("at") % RUN).cast("int")
    left, right = F.slice("run", F.lit(1), place), F.slice("run", place + 2, F.lit(RUN))
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def climbed(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """base (g, at, n, h, ...; places and counts in g) with path, the steps up to its group's top, and top; and
    the tops alone, (g, h, held) with the rows that the group has.

    Every level above the base is written once; each has an eighth of the rows of the one below.
    """
    most = base.agg(F.max("n")).first()[0] or 0
    none = F.array().cast("array<struct<left:string,right:string>>")
    levels, nodes = [], base.select("g", "at", "n", "h", F.col("n").alias("held"))
    tops = nodes.where("n = 1").select("g", "h", "held")
    while most > 1:
        runs = with_run(nodes.where("n > 1"))
        parents = runs.select("g", F.col("up").alias("at"), F.ceil(F.col("n") / RUN).alias("n"), F.sha2(F.array_join("run", ""), 256).alias("h"), "held")
        nodes = stored(parents.dropDuplicates(["g", "at"]), "merkle-level")
        levels.append(nodes)
        tops = tops.unionByName(nodes.where("n = 1").select("g", "h", "held"))
        most = -(-most // RUN)
    above = None
    for nodes in reversed([base, *levels]):
        ends = nodes.where("n = 1").withColumn("path", none).withColumn("top", F.col("h"))
        if above is not None:
            rest = with_run(nodes.where("n > 1")).join(above, ["g", "up"])
            rest = rest.withColumn("path", F.concat(F.array(step()), "path")).drop("up", "run")
            ends = ends.unionByName(rest)
        if nodes is base:
            return ends, tops
        above = stored(ends, "merkle-paths").select("g", F.col("at").alias("up"), "path", "top")
    raise AssertionError("the base is the last level")


def folded(path: Column, start: Column) -> Column:
    """The root that `start` gives with the siblings of `path`."""
    return F.aggregate(path, start, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def manifest(rows: DataFrame, fields: list[str], group: str, order: str, altered: Column | None = None) -> DataFrame:
    """order, leaf, altered (the leaf of `altered`'s row or null), subroot, root, path (steps from leaf to root).

    altered: a column over `rows` that gives the leaf of a changed row.
    """
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null first, the rest bytewise
    made = rows.select(F.col(order).alias("key"), g.alias("g"), leaf([F.col(f) for f in fields]).alias("h"), (F.lit(None).cast("string") if altered is None else altered).alias("altered"))
    # equal rows are told apart by where they were written, so that a range may cut between them
    made = stored(made.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    base, tops = climbed(numbered(made, ["key", "h", "tie"]))
    heads, _ = climbed(numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("of"), "h", F.col("held").alias("under")), ["of"]))
    heads = stored(heads.select(F.col("of").alias("g"), F.col("path").alias("higher"), F.col("top").alias("root"), "under"), "merkle-heads")
    base = base.select("key", "g", "h", "altered", F.col("top").alias("subroot"), "path")
    out = base.join(F.broadcast(heads), "g") if heads.count() <= SMALL else joined(stored(base, "merkle-base"), heads, "g", "under")
    return out.select(F.col("key").alias(order), F.col("h").alias("leaf"), "altered", "subroot", "root", F.concat("path", "higher").alias("path"))


def verified(proofs: DataFrame, order: str) -> DataFrame:
    """The proofs of `manifest` in digests, with the root that each row, as altered, gives."""
    again = folded(F.col("path"), F.coalesce("altered", "leaf"))
    out = proofs.select(order, "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lower = [F.translate(f, _UPPER, _LOWER) if f == "text" else F.col(f) for f in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return verified(manifest(docs, list(FIELDS), "lang", "doc_id", F.when(tampered, leaf(lower))), "doc_id")


#: Levels that the SQL unrolls: groups of up to 8 ** 9 rows, and as many groups.
_LEVELS = 9


def _tree_sql(name: str, base: str) -> str:
    """CTEs over `base` (g, pos, n, h, id): {name}_l{k} are its levels, {name} has id, top, sib and fold."""
    out = [f"{name}_l0 AS (SELECT g, pos, n, h FROM {base})"]
    for k in range(_LEVELS):
        out.append(f"{name}_r{k} AS (SELECT g, pos // 8 AS up, list(h ORDER BY pos) AS run FROM {name}_l{k} WHERE n > 1 GROUP BY ALL)")
        out.append(f"{name}_l{k + 1} AS (SELECT g, r.up AS pos, (n + 7) // 8 AS n, sha256(array_to_string(run, '')) AS h FROM {name}_r{k} r JOIN (SELECT DISTINCT g, n FROM {name}_l{k}) USING (g))")
    out.append(f"{name}_s0 AS (SELECT id, g, pos, n, h AS top, fold, sib FROM {base})")
    for k in range(_LEVELS):
        place = "CAST(pos % 8 AS INTEGER)"
        left, right = f"array_to_string(run[1:{place}], '')", f"array_to_string(run[{place} + 2:], '')"
        out.append(
            f"{name}_s{k + 1} AS (SELECT id, s.g, pos // 8 AS pos, CASE WHEN n > 1 THEN (n + 7) // 8 ELSE n END AS n, "
            f"CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE top END AS top, "
            f"CASE WHEN n > 1 THEN sha256(concat({left}, fold, {right})) ELSE fold END AS fold, "
            f"CASE WHEN n > 1 THEN concat(sib, {left}, {right}) ELSE sib END AS sib "
            f"FROM {name}_s{k} s LEFT JOIN {name}_r{k} r ON s.g = r.g AND s.pos // 8 = r.up AND s.n > 1)"
        )
    out.append(f"{name} AS (SELECT id, g, top, fold, sib FROM {name}_s{_LEVELS})")
    return ",\n".join(out)


def _oracle_sql() -> str:
    part = lambda c: f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)), '-')"
    null_safe = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE {part(c)} END"
    whole = lambda text: "sha256(concat(" + ", ".join(null_safe(text if f == "text" else f) for f in FIELDS) + "))"
    bit = "lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), {bit})"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {codes}), {byte}), 4294967295::UBIGINT)"
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    return f"""
WITH made AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS g, {whole("text")} AS leaf,
         CASE WHEN {crc} % 3 = 0 THEN {whole(lower)} ELSE {whole("text")} END AS fold
  FROM documents),
base AS (
  SELECT id, doc_id, g, leaf, leaf AS h, fold, '' AS sib, count(*) OVER (PARTITION BY g) AS n,
         row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos
  FROM made),
{_tree_sql("low", "base")},
tops AS (SELECT g, any_value(top) AS h FROM low GROUP BY g),
heads AS (SELECT g AS lang_key, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, '' AS g FROM tops),
high_base AS (SELECT low.id, heads.g, heads.pos, heads.n, heads.h, low.fold, low.sib FROM low JOIN heads ON low.g = heads.lang_key),
{_tree_sql("high", "high_base").replace("high_l0 AS (SELECT g, pos, n, h FROM high_base)", "high_l0 AS (SELECT g, pos, n, h FROM heads)")}
SELECT doc_id, leaf, low.top AS subroot, high.top AS root, sha256(high.sib) AS proof_sha256, high.fold AS folded_root,
       high.fold = high.top AS verified
FROM base JOIN low USING (id) JOIN high USING (id)
"""


ORACLE_SQL = _oracle_sql()
