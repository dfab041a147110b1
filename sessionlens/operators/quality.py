"""Quality of extracted memories against annotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.operators.shared import written

# What a run has to reach.
LEAST_RECALL, MOST_FALSE = 0.60, 0.25
TRIVIAL_WORDS = 10
#: Characters by which a word meets the tokens that hold it.
HEAD = 4
#: Memories that expectations meet at first, and the most that are put in order for that at once.
FIRST, MOST_ORDERED = 256, 1 << 16
#: Words that go to all tasks at once.
MOST_SENT = 500_000


def _holding(memories: DataFrame, words: DataFrame, sent: int | None = None) -> DataFrame:
    """(memory_id, own, word): which memories (memory_id, own, content) hold each of the distinct words (word, none empty).

    Words go to the texts, `sent` at a time, and meet their tokens by first characters: no token goes through an exchange.
    A memory may be told of a word more than once."""
    passes = -(-words.count() // (sent or MOST_SENT))
    out = [memories.select("memory_id", "own", F.lit("").alias("word")).limit(0)]
    for i in range(passes):
        some = words.where(F.pmod(F.xxhash64("word"), F.lit(passes)) == i).select("word", F.left("word", F.lit(HEAD)).alias("head"))
        tokens = memories.select("memory_id", "own", F.explode(F.array_distinct(F.split(F.lower("content"), r"\s+"))).alias("token"))
        for size in sorted(r[0] for r in some.select(F.char_length("head")).distinct().collect()):
            starts = F.sequence(F.lit(1), F.char_length("token") - size + 1)
            by = tokens.where(F.char_length("token") >= size).select("memory_id", "own", "token", F.explode(starts).alias("at"))
            by = by.select("memory_id", "own", "token", F.substr("token", F.col("at"), F.lit(size)).alias("head"))
            found = by.join(F.broadcast(some.where(F.char_length("head") == size)), "head").where(F.contains("token", F.col("word")))
            out.append(written(found.select("memory_id", "own", "word").distinct()))
    return reduce(DataFrame.unionByName, out)


def mentioned(memories: DataFrame, sources: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(session_id, entity_id): what is mentioned in the sessions that memories come from."""
    of = sources.join(memories.select("memory_id"), "memory_id", "left_semi").select("session_id").distinct()
    return occurrences.select("session_id", "entity_id").join(of, "session_id", "left_semi").distinct()


def matched(memories: DataFrame, sources: DataFrame, occurrences: DataFrame, entities: DataFrame, expected: DataFrame, first: int = FIRST) -> DataFrame:
    """(expected_id, memory_id): for each expectation the least memory that meets it.

    expected: expected_id, entity_name, memory_type, content_hint. A memory meets it if a session of its own
    mentions the entity, its content holds every word of the hint of two letters or more, and its type is the
    expected one where one is given. Expectations without a name or a hint are met by none.

    No expectation meets all sessions of its name. A hint asks by the word that the first memories hold least (of equal
    ones the longest), and memories are gone through in order, `first` of them and then more each time: what many memories
    meet is met by early ones and asks no more, so the later memories only meet what few do. A hint's other words are
    looked up in the texts of the memories left.
    """
    want = expected.select("expected_id", F.lower("entity_name").alias("name"), F.lower(F.coalesce("memory_type", F.lit(""))).alias("type"), F.lower("content_hint").alias("hint"))
    want = want.where("name <> '' and hint <> ''")
    words = F.array_sort(F.array_distinct(F.filter(F.split("hint", r"\s+"), lambda w: F.char_length(w) > 1)))
    # every content holds the empty word, which stands for a hint without words
    want = written(want.select("expected_id", "name", "type", F.when(F.size(words) > 0, words).otherwise(F.array(F.lit(""))).alias("words")))
    hints = written(want.select("words").distinct().withColumn("hint", F.monotonically_increasing_id()))
    names = written(want.select("name").distinct().withColumn("named", F.monotonically_increasing_id()))
    asked = want.join(hints, "words").join(names, "name").select("named", "type", "hint").distinct().withColumn("want", F.monotonically_increasing_id())
    asked = written(asked)
    named = entities.select("entity_id", F.lower("canonical_name").alias("name")).join(names, "name").select("entity_id", "named")
    at = occurrences.select("session_id", "entity_id").join(named, "entity_id").select("named", "session_id").distinct()
    mine = memories.select("memory_id", F.lower("memory_type").alias("own"), "content")
    near = written(at.join(sources, "session_id").select("named", "memory_id").distinct().join(mine.select("memory_id"), "memory_id", "left_semi"))

    anchored, met, after, most = None, None, None, first
    while True:
        upto = None
        ids = near.select("memory_id") if after is None else near.where(F.col("memory_id") > after).select("memory_id")
        if most <= MOST_ORDERED:
            upto = ids.distinct().orderBy("memory_id").limit(most).agg(F.max("memory_id"), F.count("*")).first()
            upto = upto[0] if upto[1] == most else None
        part = lambda df: df.where((F.lit(True) if after is None else F.col("memory_id") > after) & (F.lit(True) if upto is None else F.col("memory_id") <= upto))  # noqa: B023, E731
        left = asked if met is None else written(asked.join(met, "want", "left_anti"))
        if anchored is None:
            each = hints.select("hint", F.explode("words").alias("word"))
            early = part(mine) if upto is not None else part(mine).join(ids.distinct().orderBy("memory_id").limit(most), "memory_id", "left_semi")
            early = _holding(early, each.select("word").where("word <> ''").distinct()).groupBy("word").agg(F.countDistinct("memory_id").alias("df"))
            rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), (-F.char_length("word")).alias("short"), "word"))["word"]
            anchored = written(each.join(early, "word", "left").groupBy("hint").agg(rarest.alias("word")).join(hints, "hint"))
        asking = anchored.join(left, "hint", "left_semi")
        held = _holding(part(mine), asking.select("word").where("word <> ''").distinct())
        held = held.unionByName(part(mine).select("memory_id", "own", F.lit("").alias("word")).distinct())
        maybe = held.join(asking, "word").join(left, "hint").where("type = '' or type = own")
        maybe = written(maybe.select("memory_id", "named", "type", "words", "want").distinct().join(part(near), ["memory_id", "named"], "left_semi"))
        others = maybe.where(F.size("words") > 1).select("memory_id", "type", "want", F.explode("words").alias("word"))
        texts = part(mine).select("memory_id", "own", F.lower("content").alias("text"))
        whole = others.join(texts, "memory_id").where("type = '' or type = own").groupBy("want", "memory_id", F.xxhash64("text").alias("of"))
        whole = whole.agg(F.bool_and(F.contains("text", F.col("word"))).alias("all")).where("all")
        good = whole.select("want", "memory_id").unionByName(maybe.where(F.size("words") == 1).select("want", "memory_id"))
        good = written(good.groupBy("want").agg(F.min("memory_id").alias("memory_id")))
        met = good if met is None else met.unionByName(good)
        if upto is None or asked.count() == met.count():
            break
        after, most = upto, most * 16
    ids = asked.join(met, "want").join(hints, "hint").join(names, "named").select("name", "type", "words", "memory_id")
    return want.join(ids, ["name", "type", "words"]).groupBy("expected_id").agg(F.min("memory_id").alias("memory_id"))


def gate(memories: DataFrame, sources: DataFrame, occurrences: DataFrame, entities: DataFrame, expected: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row: total, cross_session, trivial, coverage, recall, false_rate and whether the targets are met.

    entities has a boolean `promoted`, labelled a `label` (correct, incorrect, or others that don't count).
    Without labelled memories the false rate is the share of memories that no expectation found; without
    expectations either it is 1.
    """
    words = F.char_length("content") - F.char_length(F.replace("content", F.lit(" "), F.lit(""))) + 1
    total = memories.agg(F.count("*").alias("total"), F.count_if(F.col("evidence") >= 2).alias("cross_session"), F.count_if(words < TRIVIAL_WORDS).alias("trivial"))
    own = entities.where("promoted")
    told = written(mentioned(memories, sources, occurrences))
    covered = told.select("entity_id").distinct()
    covered = own.join(covered.withColumn("has", F.lit(1)), "entity_id", "left").agg(F.count("has").alias("c"), F.count("*").alias("p"))
    found = matched(memories, sources, told, entities, expected).agg(F.countDistinct("memory_id").alias("found"))
    asked = expected.agg(F.count("*").alias("asked"))
    judged = labelled.agg(F.count_if(F.col("label") == "correct").alias("yes"), F.count_if(F.col("label") == "incorrect").alias("no"), F.count("*").alias("labelled"))
    one = total
    for x in (covered, found, asked, judged):  # a row each
        one = one.unionByName(x, allowMissingColumns=True)
    one = one.agg(*[F.max(c).alias(c) for c in one.columns])
    share = lambda a, b, none: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(none))
    one = one.withColumn("judged", F.col("yes") + F.col("no")).withColumn("unmet", F.col("total") - F.col("found"))
    by_match = F.when(F.col("asked") > 0, share("unmet", "total", 1.0)).otherwise(F.lit(1.0))
    one = one.withColumn("recall", share("found", "asked", 0.0)).withColumn("false_rate", F.when(F.col("labelled") > 0, share("no", "judged", 0.0)).otherwise(by_match))
    return one.select(
        "total", "cross_session", "trivial", F.when(F.col("total") > 0, share("c", "p", 0.0)).otherwise(F.lit(0.0)).alias("coverage"), "recall", "false_rate",
        ((F.col("recall") > LEAST_RECALL) & (F.col("false_rate") < MOST_FALSE)).alias("passes"),
    )
