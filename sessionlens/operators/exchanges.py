"""Turns to exchanges, chunks, descriptors and session aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.functions import text as T
from sessionlens.operators.folds import Packed, carried

MAX_TOKENS = 800
OVERLAP = 0.1
HEAD, TAIL = 5, 3
TRIVIAL_TYPES = ["progress", "file-history-snapshot", "queue-operation"]


def numbered(turns: DataFrame, session: str, order: str, opens: Column) -> DataFrame:
    """Add `exchange` (0-based): every turn that opens one and what follows; turns before the first are dropped."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(opens.cast("int")).over(w)
    return turns.withColumn("exchange", (n - 1).cast("long")).where(F.col("exchange") >= 0)


def exchange_rows(turns: DataFrame, session: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each exchange: user_text, user_word_count, model_turn_count, n_turns, body (all turns in order)."""
    rows = numbered(turns, session, order, F.col(role) == "user")
    body = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(role).alias("role"), F.col(text).alias("text"))))
    out = rows.groupBy(session, "exchange").agg(body.alias("body"))
    user = F.element_at("body", 1)["text"]
    return out.select(
        session,
        "exchange",
        user.alias("user_text"),
        T.word_count(user).alias("user_word_count"),
        F.size(F.filter("body", lambda t: t["role"] == "assistant")).cast("long").alias("model_turn_count"),
        F.size("body").cast("long").alias("n_turns"),
        "body",
    )


def serialized(body: Column, head: int = HEAD, tail: int = TAIL) -> Column:
    """The exchange as text: user line, then at most head + tail turns with a marker where some are left out."""
    user = F.left(F.element_at(body, 1)["text"], F.lit(500))
    first = F.concat(F.lit("USER: "), F.when(user == "", F.lit("(no text)")).otherwise(user))
    rest = F.slice(body, F.lit(2), F.greatest(F.size(body) - 1, F.lit(0)))
    n = F.size(rest)
    line = lambda t: F.concat(F.when(t["role"] == "assistant", F.lit("A: ")).otherwise(F.lit("[result]: ")), F.left(t["text"], F.lit(500)))
    marker = F.array(F.concat(F.lit("[... "), (n - head - tail).cast("string"), F.lit(" intermediate turns omitted ...]")))
    seen = F.when(
        n > head + tail,
        F.concat(F.transform(F.slice(rest, F.lit(1), F.lit(head)), line), marker, F.transform(F.slice(rest, F.greatest(n - tail + 1, F.lit(1)), F.lit(tail)), line)),
    ).otherwise(F.transform(rest, line))
    return F.array_join(F.concat(F.array(first), seen), "\n")


def packed_chunks(exchanges: DataFrame, session: str = "conv_id", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Greedy packing: (session, chunk_index, span_start, span_end, token_count) of runs of whole exchanges.

    exchanges: session, exchange, tokens. An exchange beyond the budget closes the run and is a chunk of its own
    (to be split by `windows`). A state of one run is carried along a session's exchanges, in order.
    """
    rows = exchanges.select(session, F.col("exchange").cast("long").alias("exchange"), F.col("tokens").cast("long").alias("tokens"))
    order = [F.col("exchange").asc_nulls_last(), F.col("tokens").asc_nulls_last()]
    runs = carried(rows, session, order, ["tokens"], lambda: Packed(max_tokens), "chunk_index", "bigint")
    ends = [F.min("exchange").alias("span_start"), F.max("exchange").alias("span_end"), F.sum("tokens").alias("token_count")]
    return runs.groupBy(session, "chunk_index").agg(*ends).select(session, "chunk_index", "span_start", "span_end", "token_count")


def windows(df: DataFrame, text: str, size: int, overlap: int, keep: list[str]) -> DataFrame:
    """keep, part, piece: character windows that overlap; the last one ends with the text."""
    n, step = F.char_length(text), size - overlap
    count = F.greatest(F.ceil((n - overlap) / F.lit(step)), F.lit(1)).cast("int")
    out = df.select(*keep, F.col(text).alias("__t"), F.explode(F.sequence(F.lit(0), count - 1)).alias("part"))
    return out.select(*keep, F.col("part").cast("long").alias("part"), F.substring(F.col("__t"), F.col("part") * step + 1, F.lit(size)).alias("piece"))


def tool_split(text: pd.Series, max_tokens: int = MAX_TOKENS) -> pd.Series:
    """Pieces that end at tool marks, each as long as the budget allows; the text before a too-long piece is kept."""
    import re

    def cut(t: str | None) -> list[str]:
        if not t:
            return [""] if t is not None else []
        ends = [m.end() for m in re.finditer(r"\[TOOL:[^\]]+\]", t)]
        if not ends:
            return [t]
        out, start, last = [], 0, 0
        for e in ends:
            if max(1, int(len(t[start:e].split()) * 1.3)) > max_tokens and last > start:
                out.append(t[start:last])
                start = last
            last = e
        out.append(t[start:])
        return out

    return text.map(cut)


def split_at_tools(df: DataFrame, text: str, keep: list[str], max_tokens: int = MAX_TOKENS) -> DataFrame:
    @F.pandas_udf("array<string>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield tool_split(s, max_tokens)

    return df.select(*keep, F.posexplode(run(F.col(text))).alias("part", "piece"))


def exchange_class(user_text: Column, tool_names: Column) -> Column:
    """Who or what an exchange comes from; the first rule that holds."""
    return (
        F.when(user_text.startswith("Base directory for this skill:"), "skill_invocation")
        .when(F.contains(user_text, F.lit("<task-notification")), "task_notification")
        .when(user_text.startswith("This session is being continued"), "context_continuation")
        .when(F.array_contains(tool_names, "ScheduleWakeup"), "wakeup_injection")
        .when(F.size(tool_names) == 0, "genuine_text")
        .otherwise("genuine_human")
    )


def structural_sample(chunks: DataFrame, session: str, index: str, text: str, middle: int = 8, size: int = 2000) -> DataFrame:
    """(session, sample): first and last chunk and `middle` others in order, chosen by hash; cut at `size`."""
    w = Window.partitionBy(session)
    at = chunks.withColumn("lo", F.min(index).over(w)).withColumn("hi", F.max(index).over(w))
    edge = (F.col(index) == F.col("lo")) | (F.col(index) == F.col("hi"))
    order = Window.partitionBy(session, "edge").orderBy(F.md5(F.concat_ws(":", F.col(session).cast("string"), F.col(index).cast("string"))), index)
    kept = at.withColumn("edge", edge).withColumn("r", F.row_number().over(order)).where(F.col("edge") | (F.col("r") <= middle))
    rows = kept.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(text).alias("t")))).alias("parts"))
    return rows.select(session, F.left(F.array_join(F.transform("parts", lambda p: p["t"]), "\n\n"), F.lit(size)).alias("sample"))
