"""Entities: mentions in tool calls, name resolution, confidence, promotion, occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.operators.shared import checkpointed

# The ladder of confidence.
LADDER = ["raw", "llm_verified", "session", "corpus"]
# The types that entities of extracted memories have, and the raw types renamed to them.
MEMORY_TYPES = ["technology", "concept", "dataset", "model", "org", "person", "tool", "file", "commit", "pr"]
RENAMED_TYPES = {"framework": "technology", "algorithm": "concept", "project": "technology", "org": "org", "tool": "technology"}
FILE_IN_COMMAND = r"""/[^\s"']+\.[a-zA-Z0-9]+"""
COMMIT = r"\b[0-9a-f]{7,40}\b"
PULL = r"PR\s*#(\d+)"


def rank_of(confidence: Column) -> Column:
    out = F.lit(0)
    for i, name in enumerate(LADDER):
        out = F.when(confidence == name, i).otherwise(out)
    return out


def name_of(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LADDER)), rank.cast("int") + 1)


def shared_type(kind: Column) -> Column:
    """The shared vocabulary's type of a raw one: renamed, or as it is if the vocabulary has it, or concept."""
    low = F.lower(F.regexp_replace(kind, r"^\s+|\s+$", ""))
    renamed = F.create_map(*[F.lit(x) for pair in RENAMED_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(renamed, low), F.when(low.isin(MEMORY_TYPES), low), F.lit("concept"))


def command_mentions(df: DataFrame, keep: list[str], command: str) -> DataFrame:
    """keep, name, entity_type, role, pos: files, commits (with a letter) and pull requests named in a command."""
    files = F.transform(F.regexp_extract_all(command, F.lit(FILE_IN_COMMAND), F.lit(0)), lambda x: F.struct(x.alias("name"), F.lit("file").alias("entity_type"), F.lit("subject").alias("role")))
    commits = F.filter(F.regexp_extract_all(command, F.lit(COMMIT), F.lit(0)), lambda x: x.rlike("[a-f]"))
    commits = F.transform(commits, lambda x: F.struct(x.alias("name"), F.lit("commit").alias("entity_type"), F.lit("commit_ref").alias("role")))
    pulls = F.transform(F.regexp_extract_all(command, F.lit(PULL), F.lit(1)), lambda x: F.struct(F.concat(F.lit("PR#"), x).alias("name"), F.lit("pr").alias("entity_type"), F.lit("subject").alias("role")))
    return df.select(*keep, F.posexplode(F.concat(files, commits, pulls)).alias("pos", "m")).select(*keep, F.col("pos").cast("long").alias("pos"), "m.name", "m.entity_type", "m.role")


def confidence_after(chunks: DataFrame, current: DataFrame, least: int = 2) -> DataFrame:
    """(entity_id, confidence): `session` for entities in `least` chunks of one session; never lowered.

    chunks: entity_id, session_id, record_id. current: entity_id, confidence.
    """
    most = chunks.groupBy("entity_id", "session_id").agg(F.countDistinct("record_id").alias("n")).groupBy("entity_id").agg(F.max("n").alias("most"))
    rows = current.join(most, "entity_id", "left")
    new = F.when(F.coalesce("most", F.lit(0)) >= least, F.lit(LADDER.index("session"))).otherwise(F.lit(0))
    return rows.select("entity_id", name_of(F.greatest(rank_of(F.col("confidence")), new)).alias("confidence"))


def promotion(occ: DataFrame, entities: DataFrame, sessions_total: int, records_total: int, degree: int = 3, per_session: int = 2, session_share: float = 0.8, chunk_share: float = 0.5) -> DataFrame:
    """Entities that recur across sessions without being everywhere: degree, occurrences, most chunks in a session."""
    by = occ.groupBy("entity_id", "session_id").agg(F.countDistinct("record_id").alias("chunks"), F.count("*").alias("n"))
    agg = by.groupBy("entity_id").agg(F.count("*").alias("degree"), F.sum("n").alias("total"), F.max("chunks").alias("most"), F.sum("chunks").alias("chunks"))
    keep = (F.col("degree") >= degree) & (F.col("most") >= per_session) & (F.col("degree") <= session_share * sessions_total) & (F.col("chunks") <= chunk_share * records_total)
    return agg.where(keep).join(entities, "entity_id").select("entity_id", "degree", "total", "most")


def upserted(old: DataFrame, mentions: DataFrame) -> DataFrame:
    """(entity_id, degree, last_seen, confidence) after new sessions: degree counts distinct sessions, last_seen is
    the latest, confidence never drops. old: entity_id, session_id, seen, confidence (one row a session)."""
    rows = old.unionByName(mentions)
    return rows.groupBy("entity_id").agg(F.countDistinct("session_id").alias("degree"), F.max("seen").alias("last_seen"), name_of(F.max(rank_of(F.col("confidence")))).alias("confidence"))


def resolved_in_order(mentions: DataFrame, most: int = 2) -> DataFrame:
    """(mention_id, canonical_id): in order of sight, each mention goes to the first canonical name of its type
    within `most` edits, or becomes canonical itself.

    mentions: mention_id (in order of sight), name, entity_type. A name is canonical if none of its earlier
    neighbours is, so each round settles the names whose earlier neighbours are all settled or one of which is
    canonical already; rounds go on until all are settled, as many as the longest chain of earlier neighbours. Each round's
    table is a reliable checkpoint. Null names and types are left out.
    """
    low, near = _near_names(mentions.where("name is not null and entity_type is not null"), most)
    near = checkpointed(near.where("first < at").select("at", "first"))
    none = F.lit(None).cast("boolean")
    state = low.groupBy("entity_type", "n").agg(F.min("mention_id").alias("at")).select("at")
    state = state.join(near.select("at").distinct().withColumn("later", F.lit(True)), "at", "left")
    state = checkpointed(state.select("at", F.when(F.col("later"), none).otherwise(F.lit(True)).alias("canonical")))
    while not state.where("canonical is null").isEmpty():
        of = near.join(state.withColumnRenamed("at", "first"), "first").groupBy("at").agg(F.bool_or("canonical").alias("some"), F.count_if(F.col("canonical").isNull()).alias("open"))
        found = F.when(F.col("some"), F.lit(False)).when(F.col("open") == 0, F.lit(True))
        state = checkpointed(state.join(of, "at", "left").select("at", F.coalesce("canonical", found).alias("canonical")))
    kept = state.where("canonical").select(F.col("at").alias("first"))
    first = near.join(kept, "first", "left_semi").groupBy("at").agg(F.min("first").alias("canonical_id"))
    names = low.groupBy("entity_type", "n").agg(F.min("mention_id").alias("at")).join(first, "at", "left")
    return low.join(names, ["entity_type", "n"]).select("mention_id", F.coalesce("canonical_id", "at").alias("canonical_id"))


def _near_names(mentions: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The mentions with lower-case names n, and (entity_type, m, at, n, first): every name m, first seen at `at`, with
    each name n seen no later, at `first`, within `most` edits (itself too).

    A blocked theta join: names within `most` edits
    differ by at most that in length and share one of their pieces when cut into most + 1 (the pigeonhole
    principle), so candidates meet on (type, piece number and text, length) and edits are counted for those alone.
    """
    low = mentions.select("mention_id", "entity_type", F.lower("name").alias("n")).withColumn("len", F.char_length("n"))
    distinct = low.groupBy("entity_type", "n", "len").agg(F.min("mention_id").alias("first"))
    k = most + 1

    def pieces(length: Column, text: Column, shift: Column) -> Column:
        """Piece i of a name of `length` cut into k pieces, found at its place moved by `shift` in `text`."""
        start = lambda i: F.floor(length * i / k).cast("int")
        one = lambda i: F.struct(i.alias("i"), F.substring(text, start(i) + 1 + shift, start(i + 1) - start(i)).alias("p"), (start(i) + shift >= 0).alias("ok"))
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), one)

    shifts = F.sequence(F.lit(-most), F.lit(most))
    index = distinct.select("entity_type", "n", "first", F.col("len").alias("base"), F.explode(pieces(F.col("len"), F.col("n"), F.lit(0))).alias("q"))
    probe = distinct.select("entity_type", F.col("n").alias("m"), F.col("first").alias("at"), F.explode(F.transform(shifts, lambda d: F.col("len") + d)).alias("base")).where("base >= 0")
    probe = probe.select("entity_type", "m", "at", "base", F.explode(shifts).alias("shift"))
    probe = probe.select("entity_type", "m", "at", "base", F.explode(pieces(F.col("base"), F.col("m"), F.col("shift"))).alias("q")).where("q.ok")
    on = ["entity_type", "base", "i", "p"]
    index = index.select("entity_type", "n", "first", "base", "q.i", "q.p")
    probe = probe.select("entity_type", "m", "at", "base", "q.i", "q.p")
    near = probe.join(index, on).where("first <= at").select("entity_type", "m", "at", "n", "first").distinct()
    return low, near.where(F.levenshtein("m", "n", most) >= 0)


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def sentence_context(text: Column, mention: Column, around: int = 2, size: int = 500) -> Column:
    """The sentences around the first that holds the mention (any case), joined by '. ' and cut."""
    parts = F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != "")
    hit = F.transform(parts, lambda s: F.contains(F.lower(s), F.lower(mention)))
    at = F.array_position(hit, True)
    lo = F.greatest(at - around, F.lit(1))
    cut = F.array_join(F.slice(parts, lo.cast("int"), F.least(at + around, F.size(parts)).cast("int") - lo.cast("int") + 1), ". ")
    return F.when(at > 0, F.left(cut, F.lit(size)))
