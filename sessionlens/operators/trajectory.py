"""Features and events along a session: window statistics, loops, step costs and scores, critical steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.operators.folds import Spaced, UpperMedian, carried

WINDOW = 5
Z = 2.0
LOOKBACK = 5
FEATURES = ["action_entropy", "action_target_recurrence", "error_rate", "user_turn_length_ratio", "read_only_ratio", "model_turn_count"]
# Tools that only read.
READ_ONLY = ["Read", "Glob", "read_file", "list_directory", "google_web_search", "web_fetch"]
# Weights of the progress parts and of the two costs.
WEIGHTS = {"delta_test": 0.30, "delta_scope": 0.25, "delta_patch": 0.20, "delta_info": 0.25}
COSTS = {"tokens": 0.15, "redundancy": 0.25}


def entropy(names: Column) -> Column:
    """Shannon entropy (bits) of an array of strings; 0 for none."""
    n = F.size(names).cast("double")
    share = F.transform(F.array_distinct(names), lambda x: F.size(F.filter(names, lambda y: y == x)) / n)
    return F.when(F.size(names) > 0, F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(F.lit(0.0))


def expanding_z(x: Column, part: str, order: list) -> Column:
    """z-score against the rows up to and with this one: sample deviation, 1 for a single row, 0 where it is 0."""
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n, sd = F.count(x).over(w), F.stddev_samp(x).over(w)
    return F.when(n < 2, x - F.avg(x).over(w)).when(sd > 0, (x - F.avg(x).over(w)) / F.when(sd > 0, sd)).otherwise(F.lit(0.0))


def turn_features(turns: DataFrame, session: str, order: str) -> DataFrame:
    """The six features of each turn and their expanding z-scores (z_<feature>).

    turns: session, order, user_word_count, model_turn_count, tools array<string>, targets array<string>,
    errors array<boolean>; already limited to genuine exchanges.
    """
    frame = Window.partitionBy(session).orderBy(order).rowsBetween(-(WINDOW - 1), 0)
    first = turns.select(session, F.col(order).alias("__at"), F.explode(F.array_distinct("targets")).alias("__target"))
    first = first.groupBy(session, "__target").agg(F.min("__at").alias("__first"))
    long = turns.select(session, order, F.explode("targets").alias("__target")).join(first, [session, "__target"])
    again = long.groupBy(session, order).agg(F.count_if(F.col("__first") < F.col(order)).alias("__again"))
    # the running upper median of the words, by a fold: one heap a side
    kind = turns.schema["user_word_count"].dataType.simpleString()
    rows = carried(turns, session, [order], ["user_word_count"], UpperMedian, "__median", kind).join(again, [session, order], "left")
    names, errors = F.flatten(F.collect_list("tools").over(frame)), F.flatten(F.collect_list("errors").over(frame))
    rows = rows.withColumn("__names", names).withColumn("__errors", errors)
    share = lambda hit, n: F.when(n > 0, hit / F.when(n > 0, n)).otherwise(F.lit(0.0))
    rows = rows.withColumn("action_entropy", entropy(F.col("__names")))
    rows = rows.withColumn("action_target_recurrence", share(F.coalesce("__again", F.lit(0)), F.size("targets")))
    rows = rows.withColumn("error_rate", share(F.size(F.filter("__errors", lambda e: e)), F.size("__errors")))
    rows = rows.withColumn("user_turn_length_ratio", F.when(F.col("__median") > 0, F.col("user_word_count") / F.when(F.col("__median") > 0, F.col("__median"))).otherwise(F.lit(1.0)))
    rows = rows.withColumn("read_only_ratio", share(F.size(F.filter("__names", lambda t: t.isin(READ_ONLY))), F.size("__names")))
    rows = rows.withColumn("model_turn_count", F.avg("model_turn_count").over(frame))
    rows = rows.withColumn("turn_index", F.row_number().over(Window.partitionBy(session).orderBy(order)) - 1)
    rows = rows.withColumn("n_turns", F.count("*").over(Window.partitionBy(session)))
    for f in FEATURES:
        rows = rows.withColumn(f"z_{f}", expanding_z(F.col(f).cast("double"), session, [order]))
    return rows.select(session, order, "turn_index", "n_turns", *FEATURES, *[f"z_{f}" for f in FEATURES])


def dominant(rows: DataFrame) -> DataFrame:
    """Add dominant_feature (greatest |z|, the first of equals), dominant_z and strength."""
    best = F.greatest(*[F.abs(f"z_{f}") for f in FEATURES])
    name = F.coalesce(*[F.when(F.abs(f"z_{f}") == best, F.lit(f)) for f in FEATURES])
    value = F.coalesce(*[F.when(F.abs(f"z_{f}") == best, F.col(f"z_{f}")) for f in FEATURES])
    return rows.withColumn("dominant_feature", name).withColumn("dominant_z", value).withColumn("strength", best)


def episode_kind() -> Column:
    """The type of a turn's episode; `entropy_up` is a loop's exit within a loop and a change of strategy outside."""
    d, z = F.col("dominant_feature"), F.col("dominant_z")
    return (
        F.when(((d == "model_turn_count") & (z > 0) & (F.col("read_only_ratio") > 0.6)) | ((d == "read_only_ratio") & (z > 0)), "agent_thrash")
        .when((d == "action_target_recurrence") & (z > 0), "loop_entry")
        .when((d == "action_entropy") & (z < 0), "loop_entry")
        .when((d == "action_entropy") & (z > 0), "entropy_up")
        .when((d == "error_rate") & (z > 0) & (F.col("error_rate") > 0.5), "escalation")
        .when((d == "user_turn_length_ratio") & (z < 0) & (F.col("user_turn_length_ratio") < 0.5), "user_correction")
    )


def precipitating(session: str) -> Column:
    """The turn, at most LOOKBACK back, where errors began or new targets were followed by known ones; else the one before."""
    w = Window.partitionBy(session).orderBy("turn_index")
    errors = (F.col("error_rate") > 0) & ((F.col("turn_index") == 0) | (F.lag("error_rate", 1).over(w) == 0))
    fresh = (F.col("action_target_recurrence") == 0) & (F.lead("action_target_recurrence", 1).over(w) > 0)
    found = [F.when(F.lag(errors, 1).over(w), F.col("turn_index") - 1)]
    found += [F.when(F.lag(errors | fresh, k).over(w), F.col("turn_index") - k) for k in range(2, LOOKBACK + 1)]
    return F.coalesce(*found, F.greatest(F.col("turn_index") - 1, F.lit(0)))


def inflections(turns: DataFrame, session: str, order: str) -> DataFrame:
    """Episodes of each session of more than WINDOW turns.

    Features, types and causes are windows; the loop automaton is one fold over a session's anomalous turns, in the
    JVM. Turn numbers count genuine turns; entry_exchange is the order value of the entry.
    """
    rows = dominant(turn_features(turns, session, order)).withColumn("cause", precipitating(session)).withColumn("kind", episode_kind())
    hits = rows.where((F.col("n_turns") > WINDOW) & (F.col("turn_index") >= WINDOW) & (F.col("strength") >= Z) & F.col("kind").isNotNull())
    item = F.struct(F.col("turn_index").cast("bigint").alias("at"), "kind", F.col("cause").cast("bigint").alias("cause"), F.col(order).alias("entry_exchange"), F.round("strength", 3).alias("strength"), F.col("dominant_feature").alias("feature"))
    by = hits.groupBy(session).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = turns.schema[order].dataType.simpleString()
    episode = f"struct<inflection_type:string,precipitating_turn:bigint,entry_turn:bigint,exit_turn:bigint,entry_exchange:{kind},signal_strength:double,dominant_feature:string>"
    zero = F.struct(F.lit(False).alias("looping"), F.array().cast(f"array<{episode}>").alias("out"))

    def made(x: Column, name: Column, exit_: Column) -> Column:
        return F.struct(name.alias("inflection_type"), x["cause"].alias("precipitating_turn"), x["at"].alias("entry_turn"), exit_.alias("exit_turn"), x["entry_exchange"].alias("entry_exchange"), x["strength"].alias("signal_strength"), x["feature"].alias("dominant_feature"))

    def step(acc: Column, x: Column) -> Column:
        out, n = acc["out"], F.size(acc["out"])
        closed = F.transform(out, lambda e, i: F.when((i == n - 1) & (e["inflection_type"] == "loop_entry"), e.withField("exit_turn", x["at"])).otherwise(e))
        name = F.when(x["kind"] == "entropy_up", "strategy_pivot").otherwise(x["kind"])
        more = F.concat(out, F.array(made(x, name, F.when(name != "loop_entry", x["at"]))))
        leaves = acc["looping"] & (x["kind"] == "entropy_up")
        state = lambda looping, o: F.struct(looping.alias("looping"), o.alias("out"))
        return F.when(leaves, state(F.lit(False), closed)).otherwise(state(acc["looping"] | (x["kind"] == "loop_entry"), more))

    return by.select(session, F.explode(F.aggregate("items", zero, step, lambda acc: acc["out"])).alias("e")).select(session, "e.*")


def token_proxy(words: Column, n_calls: Column) -> Column:
    return F.greatest(F.lit(1), words.cast("long") + 50 * n_calls).cast("long")


def raw_redundancy(pairs: Column, part: str, order: str, k: int = 10) -> Column:
    """Share of this exchange's (tool, target) pairs seen in the k exchanges before it."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(-k, -1)
    seen = F.flatten(F.collect_list(pairs).over(w))
    hit = F.size(F.filter(pairs, lambda p: F.array_contains(seen, p)))
    return F.when(F.size(pairs) > 0, hit / F.when(F.size(pairs) > 0, F.size(pairs))).otherwise(F.lit(0.0))


def cost_vectors(steps: DataFrame, session: str, order: str) -> DataFrame:
    """Add tokens and redundancy costs. steps: words, n_calls, pairs array<string>."""
    by = Window.partitionBy(session)
    rows = steps.withColumn("tok", token_proxy(F.col("words"), F.col("n_calls"))).withColumn("raw", raw_redundancy(F.col("pairs"), session, order))
    rows = rows.withColumn("median_tok", F.median("tok").over(by)).withColumn("median_raw", F.median("raw").over(by))
    tokens = F.least(F.greatest(F.col("tok") / F.col("median_tok"), F.lit(0.0)), F.lit(3.0)) / 3
    excess = F.least(F.greatest(F.col("raw") - F.col("median_raw"), F.lit(0.0)), F.lit(0.5))
    return rows.withColumn("tokens", F.round(tokens, 4)).withColumn("redundancy", F.round(excess, 4))


def buckets(x: Column, limits: list[tuple[float, str, bool]], last: str) -> Column:
    """The first label whose limit holds: (limit, label, closed)."""
    out = None
    for limit, label, closed in limits:
        cond = (x <= limit) if closed else (x < limit)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(last)


def evidence_supports(progress: dict[str, Column], tokens: Column, redundancy: Column) -> Column:
    raw = sum((F.lit(w) * progress[k] for k, w in WEIGHTS.items()), F.lit(0.0)) - COSTS["tokens"] * tokens - COSTS["redundancy"] * redundancy
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def failure_mode(scope: Column, patch: Column, info: Column, test: Column, tokens: Column, redundancy: Column) -> Column:
    """The most negative progress part's mode (the first of equals), else inflation of a cost beyond 0.7."""
    low = F.least(scope, patch, info, test)
    by = F.when(scope == low, "wrong_target").when(patch == low, "tool_misread").when(info == low, "evidence_thin").otherwise("premature_done")
    return F.when(low < 0, by).when(F.greatest(tokens, redundancy) > 0.7, "trajectory_inflation")


def critical_steps(steps: DataFrame, session: str, order: str, low: float = 0.35, high: float = 0.80, change: float = 0.25, k: int = 3, calibrate: bool = True, corroborate: bool = True) -> DataFrame:
    """Steps tagged recovery, failure or success (in that precedence), with their delta.

    steps: score, tokens, error_bucket, parse_failed. Thresholds only tighten, to the session's positional 20th
    and 80th percentile of valid scores where there are five or more.
    """
    by, run = Window.partitionBy(session), Window.partitionBy(session).orderBy(order)
    valid = F.when(~F.col("parse_failed"), F.col("score"))
    rows = steps.withColumn("valid", valid)
    place = F.row_number().over(by.orderBy(F.asc_nulls_last("valid"))) - 1
    rows = rows.withColumn("__at", place).withColumn("__n", F.count("valid").over(by))
    at = lambda i: F.max(F.when(F.col("__at") == i, F.col("valid"))).over(by)
    p20 = at(F.greatest(F.floor(F.col("__n") * 0.2) - 1, F.lit(0)))
    p80 = at(F.least(F.col("__n") - 1, F.floor(F.col("__n") * 0.8)))
    enough = (F.col("__n") >= 5) & F.lit(calibrate)
    rows = rows.withColumn("eff_low", F.when(enough, F.greatest(F.lit(low), p20)).otherwise(F.lit(low)))
    rows = rows.withColumn("eff_high", F.when(enough, F.greatest(F.lit(high), p80)).otherwise(F.lit(high)))
    rows = rows.withColumn("prev", F.last("valid", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("delta", F.col("score") - F.coalesce("prev", "score"))
    back = run.rowsBetween(-(k + 1), -1)
    window_scores = F.collect_list("valid").over(back)
    rows = rows.withColumn("__w", window_scores).withColumn("j", F.row_number().over(run) - 1)
    stuck = F.size(F.filter("__w", lambda s: s <= F.col("eff_low")))
    recovery = (F.col("delta") >= change) & (F.col("j") > 0) & (F.size("__w") >= k) & (stuck >= k)
    jump = (F.col("j") > 0) & (F.col("delta") <= -change)
    absolute = F.col("score") <= F.col("eff_low")
    evidence = (F.col("tokens") > 0.3) | (F.col("error_bucket") != "0%") | F.lit(not corroborate)
    tag = (
        F.when(F.col("parse_failed"), F.lit(None).cast("string"))
        .when(recovery, "recovery_critical")
        .when(jump | (absolute & evidence), "failure_critical")
        .when(absolute, F.lit(None).cast("string"))
        .when((F.col("score") >= F.col("eff_high")) & (F.col("tokens") > 0.1), "success_critical")
    )
    return rows.withColumn("tag", tag).drop("__at", "__n", "__w", "valid", "prev")


def spaced(rows: DataFrame, session: str, at: str, order: list[str], most: int = 2, gap: int = 7) -> DataFrame:
    """At most `most` rows a session, taken in `order` (a leading - means descending), each at least `gap` from those taken before."""

    sort = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in order]
    return carried(rows, session, sort, [at], lambda: Spaced(most, gap), "__taken", "boolean").where("__taken").drop("__taken")
