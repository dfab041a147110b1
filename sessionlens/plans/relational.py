"""Filters, joins, aggregates, set operations, sorting and report queries over the session store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.functions import text as T
from sessionlens.functions.ordering import average_ranks
from sessionlens.operators import entities as E
from sessionlens.operators.graph import pairs_sharing
from sessionlens.plans.registry import add


def n(c="*"):
    return F.count(c)


# ---- filters


@add("f1_equality_in_null", "memories", "SELECT memory_id, status FROM memories WHERE memory_type IN ('fact', 'decision') AND lang = 'en' AND (status IS NULL OR status <> 'open')")
def f1(m):
    return m.where(F.col("memory_type").isin("fact", "decision") & (F.col("lang") == "en") & (F.col("status").isNull() | (F.col("status") != "open"))).select("memory_id", "status")


@add("f2_prefix", "entities", "SELECT entity_id, canonical_name FROM entities WHERE canonical_name LIKE 're%'")
def f2(e):
    return e.where(F.col("canonical_name").startswith("re")).select("entity_id", "canonical_name")


@add("f3_substring_any_case", "memories", "SELECT memory_id FROM memories WHERE contains(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the on')")
def f3(m):
    return m.where(T.like_literal(F.col("content"), "the on")).select("memory_id")


@add("f4_fulltext_match", "memories", r"SELECT memory_id FROM memories WHERE list_has_any(regexp_extract_all(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{ffff}]+'), ['thea', 'ouen'])")
def f4(m):
    return m.where(F.arrays_overlap(T.tokens(F.col("content")), F.array(F.lit("thea"), F.lit("ouen")))).select("memory_id")


@add("f5_not_superseded", "memories", "SELECT memory_id FROM memories WHERE status IS DISTINCT FROM 'superseded'")
def f5(m):
    return m.where(~F.col("status").eqNullSafe("superseded")).select("memory_id")


@add("f6_weight_threshold", "lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, l_discount FROM lineitem WHERE l_discount > 0.05 AND l_tax >= 0.04")
def f6(x):
    return x.where("l_discount > 0.05 AND l_tax >= 0.04").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")


@add("f7_between", "descriptors", "SELECT session_id, exchange_idx FROM descriptors WHERE exchange_idx BETWEEN 3 AND 7")
def f7(x):
    return x.where(F.col("exchange_idx").between(3, 7)).select("session_id", F.col("exchange_idx").cast("long"))


@add("f8_confidence_ladder", "entities", "SELECT entity_id, confidence FROM entities WHERE CASE confidence WHEN 'raw' THEN 0 WHEN 'llm_verified' THEN 1 WHEN 'session' THEN 2 ELSE 3 END >= 2")
def f8(e):
    return e.where(E.rank_of(F.col("confidence")) >= E.LADDER.index("session")).select("entity_id", "confidence")


@add("f9_word_count", "memories", "SELECT memory_id, length(content) - length(replace(content, ' ', '')) + 1 AS words FROM memories WHERE length(content) - length(replace(content, ' ', '')) + 1 < 40")
def f9(m):
    words = (F.char_length("content") - F.char_length(F.replace("content", F.lit(" "), F.lit(""))) + 1).cast("long")
    return m.select("memory_id", words.alias("words")).where("words < 40")


@add("f10_dynamic_conjunction", "memories", "SELECT memory_id FROM memories WHERE memory_type = 'insight' AND workspace = 'src3' AND evidence >= 4 AND contains(lower(content), 'th')")
def f10(m):
    chosen = {"memory_type": "insight", "workspace": "src3"}
    conds = [F.col(k) == v for k, v in chosen.items()] + [F.col("evidence") >= 4, F.contains(F.lower("content"), F.lit("th"))]
    return m.where(reduce(lambda a, b: a & b, conds)).select("memory_id")


@add("f11_all_hint_words", "memories", "SELECT memory_id FROM memories WHERE contains(lower(content), 'the') AND contains(lower(content), 'onre') AND contains(lower(content), 'st')")
def f11(m):
    hints = F.array(*map(F.lit, ["the", "onre", "st"]))
    return m.where(F.forall(hints, lambda h: F.contains(F.lower("content"), h))).select("memory_id")


@add("f12_stub_exchanges", "descriptors", "SELECT session_id, exchange_idx FROM descriptors WHERE NOT (tool IN ('view', 'signup') AND words < 12)")
def f12(x):
    stub = F.col("tool").isin("view", "signup") & (F.col("words") < 12)
    return x.where(~stub).select("session_id", F.col("exchange_idx").cast("long"))


@add("f13_activity_gate", "descriptors", "SELECT d.session_id, d.exchange_idx FROM descriptors d JOIN (SELECT session_id FROM descriptors GROUP BY session_id HAVING count(*) FILTER (WHERE tool <> 'view') = 0 OR count(*) FILTER (WHERE tool = 'view') / CAST(count(*) FILTER (WHERE tool <> 'view') AS DOUBLE) > 0.4) g ON d.session_id = g.session_id")
def f13(x):
    gate = x.groupBy("session_id").agg(F.count_if(F.col("tool") == "view").alias("human"), F.count_if(F.col("tool") != "view").alias("tools"))
    gate = gate.where((F.col("tools") == 0) | (F.try_divide("human", "tools") > 0.4)).select("session_id")
    return x.join(gate, "session_id", "left_semi").select("session_id", F.col("exchange_idx").cast("long"))


# ---- joins


@add("j1_inner", "occurrences entities", "SELECT o.record_id, o.entity_id, e.canonical_name FROM occurrences o JOIN entities e ON o.entity_id = e.entity_id WHERE e.entity_type = 'small'")
def j1(o, e):
    return o.join(e.where("entity_type = 'small'"), "entity_id").select("record_id", "entity_id", "canonical_name")


@add("j2_multiway", "memory_sources memories sessions", "SELECT s.plugin, m.memory_type, count(*) AS pairs FROM memory_sources x JOIN memories m ON x.memory_id = m.memory_id JOIN sessions s ON x.session_id = s.session_id GROUP BY ALL")
def j2(x, m, s):
    return x.join(m, "memory_id").join(s, "session_id").groupBy("plugin", "memory_type").agg(n().alias("pairs"))


@add("j3_left", "sessions metadata", "SELECT s.session_id, s.plugin, m.model, m.input_tokens FROM sessions s LEFT JOIN metadata m ON s.session_id = m.session_id")
def j3(s, m):
    return s.join(m, "session_id", "left").select("session_id", "plugin", "model", "input_tokens")


_EDGES_SQL = "SELECT l_orderkey AS src, l_suppkey * 7 AS tgt, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE l_partkey + 1000000 END AS via FROM lineitem WHERE l_quantity > 45"


@add("j4_polymorphic_left", "lineitem entities memories", f"SELECT x.src, x.tgt, x.via, coalesce(e.canonical_name, m.memory_type, 'unknown') AS reason FROM ({_EDGES_SQL}) x LEFT JOIN entities e ON x.via = e.entity_id LEFT JOIN memories m ON x.via = m.memory_id + 1000000")
def j4(x, e, m):
    via = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).otherwise(F.col("l_partkey") + 1000000)
    x = x.where("l_quantity > 45").select(F.col("l_orderkey").alias("src"), (F.col("l_suppkey") * 7).alias("tgt"), via.alias("via"))
    e = e.select(F.col("entity_id").alias("via"), "canonical_name")
    m = m.select((F.col("memory_id") + 1000000).alias("via"), "memory_type")
    return x.join(e, "via", "left").join(m, "via", "left").select("src", "tgt", "via", F.coalesce("canonical_name", "memory_type", F.lit("unknown")).alias("reason"))


@add("j5_fan_out_counts", "sessions memory_sources occurrences metadata", "SELECT s.session_id, count(DISTINCT x.memory_id) AS memories, count(DISTINCT o.entity_id) AS entities, max(m.input_tokens) AS input_tokens FROM sessions s LEFT JOIN memory_sources x ON s.session_id = x.session_id LEFT JOIN occurrences o ON s.session_id = o.session_id LEFT JOIN metadata m ON s.session_id = m.session_id GROUP BY s.session_id")
def j5(s, x, o, m):
    x = x.groupBy("session_id").agg(F.countDistinct("memory_id").alias("memories"))
    o = o.groupBy("session_id").agg(F.countDistinct("entity_id").alias("entities"))
    out = s.select("session_id").join(x, "session_id", "left").join(o, "session_id", "left").join(m.select("session_id", "input_tokens"), "session_id", "left")
    return out.fillna(0, ["memories", "entities"])


@add("j6_anti_exists", "records vectors", "SELECT record_id FROM records r WHERE NOT EXISTS (SELECT 1 FROM vectors v WHERE v.record_id = r.record_id)")
def j6(r, v):
    return r.join(v, "record_id", "left_anti").select("record_id")


@add("j7_anti_in", "memories memory_sources", "SELECT memory_id FROM memories WHERE memory_id NOT IN (SELECT memory_id FROM memory_sources)")
def j7(m, x):
    return m.join(x, "memory_id", "left_anti").select("memory_id")


@add("j8_semi", "memories vectors", "SELECT memory_id FROM memories m WHERE EXISTS (SELECT 1 FROM vectors v WHERE v.record_id = m.memory_id)")
def j8(m, v):
    return m.join(v.select(F.col("record_id").alias("memory_id")), "memory_id", "left_semi").select("memory_id")


@add("j9_chunks_sharing_entity", "occurrences", "SELECT DISTINCT a.record_id, b.record_id AS other FROM occurrences a JOIN occurrences b ON a.entity_id = b.entity_id AND a.record_id <> b.record_id")
def j9(o):
    """All chunks that share a thing, each pair once."""
    return pairs_sharing(o, "record_id", "entity_id").select(F.col("src").alias("record_id"), F.col("tgt").alias("other"))


@add("j10_same_workspace", "customer nation", "SELECT a.c_custkey AS src, count(*) AS others FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey <> b.c_custkey GROUP BY 1")
def j10(c, _):
    """Counted by group, without pairs: all rows of the group but those of the same customer."""
    k = ["c_nationkey", "c_mktsegment"]
    own = c.dropna(subset=["c_custkey", *k]).groupBy(*k, "c_custkey").agg(n().alias("own"))
    total = own.groupBy(*k).agg(F.sum("own").alias("total"))
    by = own.join(total, k).groupBy(F.col("c_custkey").alias("src")).agg(F.sum(F.col("own") * (F.col("total") - F.col("own"))).alias("others"))
    return by.where("others > 0")


@add("j12_all_pairs_threshold", "vectors", "SELECT a.record_id AS src, b.record_id AS tgt, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS weight FROM vectors a JOIN vectors b ON a.record_id < b.record_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3")
def j12(v):
    from sessionlens.operators.similarity import pairs_above

    return pairs_above(v, "record_id", "embedding", 0.3).select("src", "tgt", F.round("weight", 6).alias("weight"))


@add("j13_interval_containment", "descriptors", "SELECT d.session_id, d.exchange_idx, s.span FROM descriptors d JOIN (SELECT session_id, exchange_idx // 8 AS span, min(exchange_idx) AS lo, max(exchange_idx) AS hi FROM descriptors GROUP BY 1, 2) s ON d.session_id = s.session_id AND d.exchange_idx BETWEEN s.lo AND s.hi")
def j13(d):
    spans = d.groupBy("session_id", F.floor(F.col("exchange_idx") / 8).alias("span")).agg(F.min("exchange_idx").alias("lo"), F.max("exchange_idx").alias("hi"))
    spans = spans.select("session_id", "span", F.explode(F.sequence("lo", "hi")).alias("exchange_idx"))
    return d.join(spans, ["session_id", "exchange_idx"]).select("session_id", F.col("exchange_idx").cast("long"), "span")


@add("j14_proportional_position", "descriptors records", "SELECT d.session_id, d.i, CAST(floor(d.i * 10 / CAST(d.n AS DOUBLE)) AS BIGINT) AS slot FROM (SELECT session_id, exchange_idx AS i, count(*) OVER (PARTITION BY session_id) AS n FROM descriptors) d")
def j14(d, _):
    total = F.count("*").over(Window.partitionBy("session_id"))
    return d.select("session_id", F.col("exchange_idx").cast("long").alias("i"), F.floor(F.col("exchange_idx") * 10 / total).alias("slot"))


@add("j15_nearest_preceding", "descriptors", "SELECT session_id, exchange_idx, last_value(CASE WHEN tool = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY exchange_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior, lead(value) OVER (PARTITION BY session_id ORDER BY exchange_idx) AS following FROM descriptors")
def j15(d):
    w = Window.partitionBy("session_id").orderBy("exchange_idx")
    prior = F.last(F.when(F.col("tool") == "purchase", F.col("value")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return d.select("session_id", F.col("exchange_idx").cast("long"), prior.alias("prior"), F.lead("value").over(w).alias("following"))


@add("j16_hydrate_ranked_ids", "memories", "SELECT m.memory_id, m.memory_type, r.rank FROM (SELECT memory_id, row_number() OVER (ORDER BY evidence DESC, memory_id) AS rank FROM memories ORDER BY evidence DESC, memory_id LIMIT 20) r JOIN memories m ON m.memory_id = r.memory_id WHERE m.status IS DISTINCT FROM 'superseded'")
def j16(m):
    top = m.select("memory_id", "evidence").orderBy(F.desc("evidence"), "memory_id").limit(20)
    top = top.select("memory_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("evidence"), "memory_id")).cast("long").alias("rank"))
    return m.join(top, "memory_id").where(~F.col("status").eqNullSafe("superseded")).select("memory_id", "memory_type", "rank")


@add("j17_resolved_in_order", "entities", """WITH RECURSIVE names AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY first) AS r FROM (SELECT entity_type, lower(canonical_name) AS n, min(entity_id) AS first FROM entities GROUP BY 1, 2)),
  fold AS (SELECT entity_type, n, r, first AS canonical_id, [{'first': first, 'n': n}] AS made FROM names WHERE r = 1
    UNION ALL SELECT d.entity_type, d.n, d.r, coalesce(list_filter(f.made, lambda x: levenshtein(x.n, d.n) <= 2)[1].first, d.first),
      CASE WHEN len(list_filter(f.made, lambda x: levenshtein(x.n, d.n) <= 2)) > 0 THEN f.made ELSE list_append(f.made, {'first': d.first, 'n': d.n}) END
    FROM fold f JOIN names d ON d.entity_type = f.entity_type AND d.r = f.r + 1)
  SELECT e.entity_id AS mention_id, f.canonical_id FROM entities e JOIN fold f ON e.entity_type = f.entity_type AND lower(e.canonical_name) = f.n""")
def j17r(e):
    return E.resolved_in_order(e.select(F.col("entity_id").alias("mention_id"), F.col("canonical_name").alias("name"), "entity_type"))


@add("j18_any_case_name", "entities part", "SELECT e.entity_id, min(p.p_partkey) AS first_match FROM entities e JOIN part p ON lower(upper(p.p_name)) = lower(e.canonical_name) GROUP BY 1")
def j18(e, p):
    first = p.groupBy(F.lower(F.upper("p_name")).alias("k")).agg(F.min("p_partkey").alias("first_match"))
    return e.select("entity_id", F.lower("canonical_name").alias("k")).join(first, "k").select("entity_id", "first_match")


@add("j19_scalar_subquery", "memories memory_sources sessions", "SELECT m.memory_id, (SELECT min(s.workspace) FROM memory_sources x JOIN sessions s ON x.session_id = s.session_id WHERE x.memory_id = m.memory_id) AS first_workspace FROM memories m")
def j19(m, x, s):
    first = x.join(s, "session_id").groupBy("memory_id").agg(F.min("workspace").alias("first_workspace"))
    return m.select("memory_id").join(first, "memory_id", "left")


@add("j20_merge_left", "vectors records", "SELECT v.record_id, v.label, r.session_id FROM vectors v LEFT JOIN records r ON v.record_id = r.record_id")
def j20(v, r):
    return v.select("record_id", "label").join(r.select("record_id", "session_id"), "record_id", "left")


# ---- aggregates


@add("a1_table_counts", "sessions entities memories occurrences", "SELECT 'sessions' AS name, count(*) AS rows FROM sessions UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'memories', count(*) FROM memories UNION ALL SELECT 'occurrences', count(*) FROM occurrences")
def a1(*tables):
    return reduce(DataFrame.unionByName, [t.agg(n().alias("rows")).select(F.lit(k).alias("name"), "rows") for k, t in zip(["sessions", "entities", "memories", "occurrences"], tables, strict=True)])


@add("a2_group_counts", "memories", "SELECT memory_type, status, count(*) AS n FROM memories GROUP BY ALL")
def a2(m):
    return m.groupBy("memory_type", "status").agg(n().alias("n"))


@add("a3_distinct_per_session", "occurrences memory_sources memories", "SELECT o.session_id, o.entities, coalesce(x.memories, 0) AS memories, coalesce(x.recoveries, 0) AS recoveries FROM (SELECT session_id, count(DISTINCT entity_id) AS entities FROM occurrences GROUP BY 1) o LEFT JOIN (SELECT session_id, count(DISTINCT x.memory_id) AS memories, count(DISTINCT x.memory_id) FILTER (WHERE memory_type = 'pattern_recovery') AS recoveries FROM memory_sources x JOIN memories m ON x.memory_id = m.memory_id GROUP BY 1) x ON o.session_id = x.session_id")
def a3(o, x, m):
    o = o.groupBy("session_id").agg(F.countDistinct("entity_id").alias("entities"))
    x = x.join(m, "memory_id").groupBy("session_id").agg(F.countDistinct("memory_id").alias("memories"), F.countDistinct(F.when(F.col("memory_type") == "pattern_recovery", F.col("memory_id"))).alias("recoveries"))
    return o.join(x, "session_id", "left").fillna(0, ["memories", "recoveries"])


@add("a4_per_chunk_counts", "occurrences", "SELECT session_id, chunk_index, count(DISTINCT entity_id) AS entities FROM occurrences GROUP BY 1, 2")
def a4(o):
    return o.groupBy("session_id", "chunk_index").agg(F.countDistinct("entity_id").alias("entities"))


_MART = """SELECT s.session_id, s.plugin, s.session_type, m.model, m.permission_mode, coalesce(x.memories, 0) AS memories, coalesce(o.entities, 0) AS entities,
  round(coalesce(x.memories, 0) / CAST(nullif(s.chunk_count, 0) AS DOUBLE), 2) AS mem_per_chunk,
  round(100.0 * m.cache_read / nullif(m.cache_read + m.input_tokens, 0), 1) AS cache_hit_pct,
  round(m.tool_calls / CAST(nullif(m.user_turns, 0) AS DOUBLE), 2) AS tools_per_turn
FROM sessions s LEFT JOIN metadata m ON s.session_id = m.session_id
LEFT JOIN (SELECT session_id, count(DISTINCT memory_id) AS memories FROM memory_sources GROUP BY 1) x ON s.session_id = x.session_id
LEFT JOIN (SELECT session_id, count(DISTINCT entity_id) AS entities FROM occurrences GROUP BY 1) o ON s.session_id = o.session_id"""
_MART_VIEWS = "sessions metadata memory_sources occurrences"


def session_mart(s, m, x, o):
    """Each session with its counts and ratios; null where a denominator is 0."""
    x = x.groupBy("session_id").agg(F.countDistinct("memory_id").alias("memories"))
    o = o.groupBy("session_id").agg(F.countDistinct("entity_id").alias("entities"))
    rows = s.join(m, "session_id", "left").join(x, "session_id", "left").join(o, "session_id", "left").fillna(0, ["memories", "entities"])
    return rows.select(
        "session_id", "plugin", "session_type", "model", "permission_mode", "memories", "entities",
        F.round(F.try_divide("memories", "chunk_count"), 2).alias("mem_per_chunk"),
        F.round(F.try_divide(F.lit(100.0) * F.col("cache_read"), F.col("cache_read") + F.col("input_tokens")), 1).alias("cache_hit_pct"),
        F.round(F.try_divide("tool_calls", "user_turns"), 2).alias("tools_per_turn"),
    )


add("a5_session_mart", _MART_VIEWS, _MART)(session_mart)


@add("a6_group_summary", _MART_VIEWS, f"SELECT plugin, model, count(*) AS sessions, CAST(sum(memories) AS BIGINT) AS memories, round(avg(cache_hit_pct), 4) AS cache_hit_pct, round(avg(tools_per_turn), 4) AS tools_per_turn FROM ({_MART}) GROUP BY plugin, model")
def a6(*t):
    return session_mart(*t).groupBy("plugin", "model").agg(n().alias("sessions"), F.sum("memories").alias("memories"), F.round(F.avg("cache_hit_pct"), 4).alias("cache_hit_pct"), F.round(F.avg("tools_per_turn"), 4).alias("tools_per_turn"))


@add("a6_group_summary_cube", _MART_VIEWS, f"SELECT plugin, session_type, count(*) AS sessions, CAST(sum(memories) AS BIGINT) AS memories, CAST(grouping(plugin, session_type) AS BIGINT) AS level FROM ({_MART}) GROUP BY CUBE (plugin, session_type)")
def a6c(*t):
    return session_mart(*t).cube("plugin", "session_type").agg(n().alias("sessions"), F.sum("memories").alias("memories"), F.grouping_id().alias("level"))


@add("a7_density_by_type", "sessions memory_sources memories", "WITH c AS (SELECT session_type, sum(chunk_count) AS chunks FROM sessions GROUP BY 1), k AS (SELECT s.session_type, m.memory_type, count(*) AS n FROM sessions s JOIN memory_sources x ON s.session_id = x.session_id JOIN memories m ON x.memory_id = m.memory_id GROUP BY 1, 2) SELECT k.session_type, k.memory_type, round(k.n / CAST(c.chunks AS DOUBLE), 6) AS per_chunk FROM k JOIN c ON k.session_type = c.session_type")
def a7(s, x, m):
    chunks = s.groupBy("session_type").agg(F.sum("chunk_count").alias("chunks"))
    k = s.join(x, "session_id").join(m, "memory_id").groupBy("session_type", "memory_type").agg(n().alias("k"))
    return k.join(chunks, "session_type").select("session_type", "memory_type", F.round(F.col("k") / F.col("chunks"), 6).alias("per_chunk"))


@add("a8_yield_quartiles", _MART_VIEWS, f"SELECT session_type, round(quantile_cont(mem_per_chunk, 0.25), 6) AS q1, round(quantile_cont(mem_per_chunk, 0.5), 6) AS q2, round(quantile_cont(mem_per_chunk, 0.75), 6) AS q3 FROM ({_MART}) GROUP BY 1")
def a8(*t):
    q = F.percentile("mem_per_chunk", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return session_mart(*t).groupBy("session_type").agg(q.alias("q")).select("session_type", *[F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)])


@add("a9_weekly_pivot", "sessions memory_sources", "SELECT date_trunc('week', s.ts) AS week, count(*) FILTER (WHERE s.chunk_count < 4) AS easy, count(*) FILTER (WHERE s.chunk_count >= 4) AS hard FROM sessions s JOIN memory_sources x ON s.session_id = x.session_id GROUP BY 1")
def a9(s, x):
    rows = s.join(x, "session_id").select(F.date_trunc("week", "ts").alias("week"), F.when(F.col("chunk_count") < 4, "easy").otherwise("hard").alias("struggle"))
    return rows.groupBy("week").pivot("struggle", ["easy", "hard"]).agg(n(F.lit(1))).fillna(0)


@add("a10_conditional_counts", "memories", "SELECT workspace, count(*) FILTER (WHERE memory_type = 'pattern_recovery') AS recoveries, count(*) FILTER (WHERE memory_type = 'episodic' AND status = 'open') AS open_episodes, round(100.0 * count(*) FILTER (WHERE status = 'resolved') / count(*), 4) AS resolved_pct FROM memories GROUP BY 1")
def a10(m):
    hit = lambda c: F.count_if(F.expr(c))
    return m.groupBy("workspace").agg(hit("memory_type = 'pattern_recovery'").alias("recoveries"), hit("memory_type = 'episodic' AND status = 'open'").alias("open_episodes"), F.round(100.0 * hit("status = 'resolved'") / n(), 4).alias("resolved_pct"))


@add("a11_workspace_leaders", "memory_sources sessions", "SELECT s.workspace, count(DISTINCT x.memory_id) AS memories FROM memory_sources x JOIN sessions s ON x.session_id = s.session_id GROUP BY 1 ORDER BY memories DESC, workspace LIMIT 15")
def a11(x, s):
    return x.join(s, "session_id").groupBy("workspace").agg(F.countDistinct("memory_id").alias("memories")).orderBy(F.desc("memories"), "workspace").limit(15)


@add("a12_cluster_composition", "memberships memories", "SELECT c.cluster_id, m.memory_type, count(*) AS n FROM memberships c JOIN memories m ON c.member_id = m.memory_id GROUP BY 1, 2")
def a12(c, m):
    return c.join(m, c["member_id"] == m["memory_id"]).groupBy("cluster_id", "memory_type").agg(n().alias("n"))


@add("a13_retrieval_health", "memories retrievals", "SELECT m.memory_id, count(r.retrieval_id) AS retrievals, max(r.retrieved_at) AS last_retrieved, date_diff('day', CAST(max(r.retrieved_at) AS DATE), DATE '2024-12-31') AS age_days FROM memories m LEFT JOIN retrievals r ON m.memory_id = r.memory_id GROUP BY 1")
def a13(m, r):
    r = r.groupBy("memory_id").agg(n().alias("retrievals"), F.max("retrieved_at").alias("last_retrieved"))
    rows = m.select("memory_id").join(r, "memory_id", "left").fillna(0, ["retrievals"])
    return rows.withColumn("age_days", F.datediff(F.lit("2024-12-31").cast("date"), F.col("last_retrieved").cast("date")).cast("long"))


@add("a14_max_of_counts", "occurrences", "SELECT entity_id, max(n) AS most FROM (SELECT entity_id, session_id, count(DISTINCT record_id) AS n FROM occurrences GROUP BY 1, 2) GROUP BY 1")
def a14(o):
    return o.groupBy("entity_id", "session_id").agg(F.countDistinct("record_id").alias("k")).groupBy("entity_id").agg(F.max("k").alias("most"))


@add("a15_median", "metadata", "SELECT model, median(input_tokens) AS median_tokens, median(tool_calls) AS median_tools FROM metadata GROUP BY 1")
def a15(m):
    return m.groupBy("model").agg(F.median("input_tokens").alias("median_tokens"), F.median("tool_calls").alias("median_tools"))


@add("a16_vector_mean", "vectors", "SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS pos FROM vectors) GROUP BY 1, 2")
def a16(v):
    from sessionlens.functions.vectors import mean_vectors

    return mean_vectors(v, "label", "embedding").select("label", F.posexplode("mean_vec").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("mean"))


@add("a17_mode_first_seen", "descriptors", "SELECT session_id, tool FROM (SELECT session_id, tool, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, min(exchange_idx)) AS r FROM descriptors GROUP BY 1, 2) WHERE r = 1")
def a17(d):
    by = d.groupBy("session_id", "tool").agg(n().alias("k"), F.min("exchange_idx").alias("at"))
    return E.first_wins(by, ["session_id"], [F.desc("k"), "at"]).select("session_id", "tool")


@add("a18_session_rollup", "descriptors", "SELECT session_id, count(*) AS turns, min(ts) AS started, max(ts) AS ended, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS duration_ms, round(sum(value), 4) AS total, arg_min(tool, exchange_idx) AS first_tool FROM descriptors GROUP BY 1")
def a18(d):
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return d.groupBy("session_id").agg(n().alias("turns"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.floor((micros(F.max("ts")) - micros(F.min("ts"))) / 1000).alias("duration_ms"), F.round(F.sum("value"), 4).alias("total"), F.min_by("tool", "exchange_idx").alias("first_tool"))


@add("a24_macro_average", "labels documents", "SELECT lang, round(avg(s), 6) AS macro FROM (SELECT d.source, d.lang, avg(l.quality) AS s FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1, 2) GROUP BY 1")
def a24(lab, d):
    by = lab.join(d, "doc_id").groupBy("source", "lang").agg(F.avg("quality").alias("s"))
    return by.groupBy("lang").agg(F.round(F.avg("s"), 6).alias("macro"))


@add("a26_label_census", "labels", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def a26(lab):
    return lab.groupBy("quality", "toxic").agg(n().alias("n"))


@add("a27_bare_column", "occurrences", "SELECT session_id, max(role) AS role, min(entity_id) AS entity_id FROM occurrences GROUP BY 1")
def a27(o):
    return o.groupBy("session_id").agg(F.max("role").alias("role"), F.min("entity_id").alias("entity_id"))


@add("a27_most_common_role", "occurrences", "SELECT session_id, role FROM (SELECT session_id, role, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, role) AS r FROM occurrences WHERE role IS NOT NULL GROUP BY 1, 2) WHERE r = 1")
def a27b(o):
    by = o.where("role IS NOT NULL").groupBy("session_id", "role").agg(n().alias("k"))
    return E.first_wins(by, ["session_id"], [F.desc("k"), "role"]).select("session_id", "role")


@add("a28_cluster_length_stats", "memberships memories", "SELECT cluster_id, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, min(n_chars) AS min_chars, max(n_chars) AS max_chars, count(DISTINCT workspace) AS workspaces FROM memberships JOIN memories ON member_id = memory_id GROUP BY 1")
def a28(c, m):
    return c.join(m, c["member_id"] == m["memory_id"]).groupBy("cluster_id").agg(n().alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"), F.countDistinct("workspace").alias("workspaces"))


@add("a29_cluster_keywords", "memberships memories", "WITH t AS (SELECT cluster_id, unnest(regexp_extract_all(lower(content), '[a-z]{3,}')) AS term FROM memberships JOIN memories ON member_id = memory_id), k AS (SELECT cluster_id, term, count(*) AS n FROM t WHERE term NOT IN ('the', 'and', 'for', 'que', 'les') GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, term) AS r FROM k) SELECT cluster_id, term, n FROM r WHERE r <= 5")
def a29(c, m):
    t = c.join(m, c["member_id"] == m["memory_id"]).select("cluster_id", F.explode(F.regexp_extract_all(F.lower("content"), F.lit("[a-z]{3,}"), F.lit(0))).alias("term"))
    k = t.where(~F.col("term").isin("the", "and", "for", "que", "les")).groupBy("cluster_id", "term").agg(n().alias("n"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "term")
    return k.withColumn("r", F.row_number().over(w)).where("r <= 5").drop("r")


@add("a30_session_cluster_pivot", "memberships memories", "SELECT workspace, count(*) FILTER (WHERE level = 'cross') AS \"cross\", count(*) FILTER (WHERE level = 'within') AS within FROM memberships JOIN memories ON member_id = memory_id GROUP BY 1")
def a30(c, m):
    return c.join(m, c["member_id"] == m["memory_id"]).groupBy("workspace").pivot("level", ["cross", "within"]).agg(n(F.lit(1))).fillna(0)


@add("a31_harness_features", "conversations", r"SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS user_turns, round(count(*) FILTER (WHERE role = 'assistant') / CAST(count(*) AS DOUBLE), 6) AS assistant_rate, round(avg(length(text)), 6) AS mean_chars, max(length(text)) AS max_chars FROM conversations GROUP BY 1")
def a31(c):
    return c.groupBy("conv_id").agg(n().alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.round(F.count_if(F.col("role") == "assistant") / n(), 6).alias("assistant_rate"), F.round(F.avg(F.char_length("text")), 6).alias("mean_chars"), F.max(F.char_length("text")).cast("long").alias("max_chars"))


@add("a32_spearman", "metadata", "WITH r AS (SELECT (rank() OVER (ORDER BY input_tokens) + (count(*) OVER (PARTITION BY input_tokens) - 1) / 2.0) AS a, (rank() OVER (ORDER BY tool_calls) + (count(*) OVER (PARTITION BY tool_calls) - 1) / 2.0) AS b FROM metadata) SELECT round(corr(a, b), 6) AS spearman FROM r")
def a32(m):
    rows = m.join(average_ranks(m, "input_tokens", "r_input_tokens"), "input_tokens").join(average_ranks(m, "tool_calls", "r_tool_calls"), "tool_calls")
    return rows.agg(F.round(F.corr("r_input_tokens", "r_tool_calls"), 6).alias("spearman"))


@add("a32_kruskal_wallis", "metadata", "WITH r AS (SELECT model, rank() OVER (ORDER BY tool_calls) + (count(*) OVER (PARTITION BY tool_calls) - 1) / 2.0 AS r, count(*) OVER () AS n FROM metadata) SELECT round(12.0 / (max(n) * (max(n) + 1)) * sum(s) - 3 * (max(n) + 1), 4) AS h FROM (SELECT model, sum(r) * sum(r) / count(*) AS s, max(n) AS n FROM r GROUP BY 1)")
def a32b(m):
    ranks = average_ranks(m, "tool_calls", "r")
    by = m.join(ranks, "tool_calls").groupBy("model").agg(F.sum("r").alias("s"), n().alias("k"))
    total = F.sum("k")
    return by.agg(F.round(12.0 / (total * (total + 1)) * F.sum(F.col("s") * F.col("s") / F.col("k")) - 3 * (total + 1), 4).alias("h"))


@add("a32_feature_importance", "sessions metadata")
def a32c(s, m):
    """Which structural features tell the session types apart."""
    from sessionlens.operators.importance import feature_importance

    features = ["input_tokens", "cache_read", "output_tokens", "tool_calls", "user_turns"]
    return feature_importance(s.join(m, "session_id"), "session_type", features).select("feature", F.round("importance", 4).alias("importance"))


@add("a33_histogram", _MART_VIEWS, f"SELECT least(floor(cache_hit_pct / 5), 19) AS bucket, count(*) AS n FROM ({_MART}) WHERE cache_hit_pct IS NOT NULL GROUP BY 1")
def a33(*t):
    return session_mart(*t).where("cache_hit_pct IS NOT NULL").groupBy(F.least(F.floor(F.col("cache_hit_pct") / 5), F.lit(19)).cast("double").alias("bucket")).agg(n().alias("n"))


@add("a35_recurrence_gate", "memberships memory_sources", "SELECT cluster_id, count(DISTINCT session_id) AS evidence FROM memberships JOIN memory_sources ON member_id = memory_id GROUP BY 1 HAVING count(DISTINCT session_id) >= 2")
def a35(c, x):
    return c.join(x, c["member_id"] == x["memory_id"]).groupBy("cluster_id").agg(F.countDistinct("session_id").alias("evidence")).where("evidence >= 2")


@add("a37_decile_histogram", "lineitem", "SELECT CAST(least(floor(l_discount * 10 * 10), 9) AS BIGINT) AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def a37(x):
    return x.groupBy(F.least(F.floor(F.col("l_discount") * 10 * 10), F.lit(9)).cast("long").alias("bucket")).agg(n().alias("n"))


@add("a40_by_entity_with_unknown", "memories entities", "SELECT coalesce(e.canonical_name, '(unknown entity)') AS entity, count(*) AS n FROM memories m LEFT JOIN entities e ON m.entity_id = e.entity_id GROUP BY 1")
def a40(m, e):
    return m.join(e, "entity_id", "left").groupBy(F.coalesce("canonical_name", F.lit("(unknown entity)")).alias("entity")).agg(n().alias("n"))


# ---- named reports


@add("q1_session_list", "sessions metadata memory_sources memories", "SELECT s.session_id, s.ts, coalesce(a.memories, 0) AS memories, coalesce(a.recoveries, 0) AS recoveries, m.input_tokens FROM sessions s LEFT JOIN (SELECT session_id, count(DISTINCT x.memory_id) AS memories, count(DISTINCT x.memory_id) FILTER (WHERE memory_type = 'pattern_recovery') AS recoveries FROM memory_sources x JOIN memories m ON x.memory_id = m.memory_id GROUP BY 1) a ON s.session_id = a.session_id LEFT JOIN metadata m ON s.session_id = m.session_id ORDER BY s.ts DESC, s.session_id")
def q1(s, m, x, mem):
    a = x.join(mem, "memory_id").groupBy("session_id").agg(F.countDistinct("memory_id").alias("memories"), F.countDistinct(F.when(F.col("memory_type") == "pattern_recovery", F.col("memory_id"))).alias("recoveries"))
    out = s.join(a, "session_id", "left").join(m, "session_id", "left").fillna(0, ["memories", "recoveries"])
    return out.select("session_id", "ts", "memories", "recoveries", "input_tokens").orderBy(F.desc("ts"), "session_id")


@add("q2_session_entities", "occurrences entities", "SELECT o.session_id, e.canonical_name, e.entity_type, e.confidence, count(*) AS occurrences FROM occurrences o JOIN entities e ON o.entity_id = e.entity_id GROUP BY 1, 2, 3, 4")
def q2(o, e):
    return o.join(e, "entity_id").groupBy("session_id", "canonical_name", "entity_type", "confidence").agg(n().alias("occurrences"))


@add("q3_entities_by_type", "occurrences entities", "SELECT o.session_id, e.entity_type, string_agg(DISTINCT e.canonical_name, ',' ORDER BY e.canonical_name) AS names FROM occurrences o JOIN entities e ON o.entity_id = e.entity_id GROUP BY 1, 2")
def q3(o, e):
    return o.join(e, "entity_id").groupBy("session_id", "entity_type").agg(F.array_join(F.array_sort(F.collect_set("canonical_name")), ",").alias("names"))


@add("q4_cluster_card", "sessions region", "SELECT session_type, count(*) AS sessions, round(avg(chunk_count), 6) AS mean_chunks, coalesce(max(r.r_name), session_type) AS label FROM sessions LEFT JOIN region r ON session_type = 'cluster_' || CAST(r.r_regionkey AS VARCHAR) GROUP BY session_type")
def q4(s, r):
    labels = r.select(F.concat(F.lit("cluster_"), F.col("r_regionkey").cast("string")).alias("session_type"), F.col("r_name").alias("label"))
    by = s.groupBy("session_type").agg(n().alias("sessions"), F.round(F.avg("chunk_count"), 6).alias("mean_chunks"))
    return by.join(labels, "session_type", "left").withColumn("label", F.coalesce("label", "session_type"))


@add("q5_session_memories_by_type", "memory_sources memories", "SELECT x.session_id, m.memory_id, m.evidence FROM memory_sources x JOIN memories m ON x.memory_id = m.memory_id WHERE m.memory_type = 'decision' ORDER BY x.session_id, m.evidence DESC, m.memory_id")
def q5(x, m):
    return x.join(m.where("memory_type = 'decision'"), "memory_id").select("session_id", "memory_id", "evidence").orderBy("session_id", F.desc("evidence"), "memory_id")


@add("q6_scorecard", "sessions metadata memory_sources memories", "SELECT s.session_id, m.input_tokens, m.output_tokens, k.memory_types FROM sessions s JOIN metadata m ON s.session_id = m.session_id LEFT JOIN (SELECT session_id, string_agg(memory_type || '=' || CAST(n AS VARCHAR), ',' ORDER BY memory_type) AS memory_types FROM (SELECT session_id, memory_type, count(*) AS n FROM memory_sources x JOIN memories m ON x.memory_id = m.memory_id GROUP BY 1, 2) GROUP BY 1) k ON s.session_id = k.session_id")
def q6(s, m, x, mem):
    k = x.join(mem, "memory_id").groupBy("session_id", "memory_type").agg(n().alias("k"))
    k = k.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "memory_type", F.col("k").cast("string")))), ",").alias("memory_types"))
    return s.select("session_id").join(m.select("session_id", "input_tokens", "output_tokens"), "session_id").join(k, "session_id", "left")


@add("q7_corpus_overview", "memories memory_sources", "SELECT count(DISTINCT m.memory_id) AS memories, count(DISTINCT x.session_id) AS sessions, count(DISTINCT m.workspace) AS workspaces FROM memories m LEFT JOIN memory_sources x ON m.memory_id = x.memory_id")
def q7(m, x):
    return m.join(x, "memory_id", "left").agg(F.countDistinct("memory_id").alias("memories"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("workspace").alias("workspaces"))


_CONFLICTS = "SELECT memory_id AS a, memory_id + 7 AS b, CASE WHEN memory_id % 5 = 0 THEN NULL ELSE 'kept' END AS resolution FROM memories WHERE memory_id % 6 = 0"


@add("q8_conflicts", "memories", f"SELECT c.a, c.b, m1.memory_type AS type_a, m2.memory_type AS type_b, c.resolution FROM ({_CONFLICTS}) c JOIN memories m1 ON c.a = m1.memory_id JOIN memories m2 ON c.b = m2.memory_id")
def q8(m):
    c = m.where("memory_id % 6 = 0").select(F.col("memory_id").alias("a"), (F.col("memory_id") + 7).alias("b"), F.when(F.col("memory_id") % 5 != 0, "kept").alias("resolution"))
    one = m.select(F.col("memory_id").alias("a"), F.col("memory_type").alias("type_a"))
    two = m.select(F.col("memory_id").alias("b"), F.col("memory_type").alias("type_b"))
    return c.join(one, "a").join(two, "b").select("a", "b", "type_a", "type_b", "resolution")


@add("q9_top_clusters", "memberships memories", "SELECT cluster_id, CAST(sum(evidence) AS BIGINT) AS evidence FROM memberships JOIN memories ON member_id = memory_id WHERE level = 'cross' AND status IS DISTINCT FROM 'superseded' GROUP BY 1 ORDER BY evidence DESC, cluster_id LIMIT 15")
def q9(c, m):
    rows = c.where("level = 'cross'").join(m.where(~F.col("status").eqNullSafe("superseded")), c["member_id"] == m["memory_id"])
    return rows.groupBy("cluster_id").agg(F.sum("evidence").alias("evidence")).orderBy(F.desc("evidence"), "cluster_id").limit(15)


@add("q10_cluster_members", "memberships memories", "SELECT memory_type, count(*) AS n FROM memberships JOIN memories ON member_id = memory_id WHERE cluster_id = 4 GROUP BY 1")
def q10(c, m):
    return c.where("cluster_id = 4").join(m, c["member_id"] == m["memory_id"]).groupBy("memory_type").agg(n().alias("n"))


@add("q11_source_sessions", "memory_sources sessions", "SELECT x.memory_id, s.session_id, s.workspace, s.plugin FROM memory_sources x JOIN sessions s ON x.session_id = s.session_id WHERE x.memory_id = 12")
def q11(x, s):
    return x.where("memory_id = 12").join(s, "session_id").select("memory_id", "session_id", "workspace", "plugin")


@add("q12_recent_occurrences", "occurrences sessions", "SELECT o.entity_id, o.record_id, s.ts FROM (SELECT DISTINCT entity_id, record_id, session_id FROM occurrences WHERE entity_id = 17) o JOIN sessions s ON o.session_id = s.session_id ORDER BY s.ts DESC, o.record_id LIMIT 10")
def q12(o, s):
    return o.where("entity_id = 17").select("entity_id", "record_id", "session_id").distinct().join(s, "session_id").select("entity_id", "record_id", "ts").orderBy(F.desc("ts"), "record_id").limit(10)


@add("q13_memories_with_entity", "memories entities", "SELECT m.memory_id, e.canonical_name FROM memories m LEFT JOIN entities e ON m.entity_id = e.entity_id WHERE m.memory_type = 'fact' ORDER BY coalesce(e.canonical_name, ''), m.memory_id")
def q13(m, e):
    return m.where("memory_type = 'fact'").join(e, "entity_id", "left").select("memory_id", "canonical_name").orderBy(F.coalesce("canonical_name", F.lit("")), "memory_id")


@add("q14_workspace_fallback", "sessions", "SELECT session_id, chunk_count FROM sessions WHERE workspace = 'ws7' ORDER BY chunk_count DESC, session_id LIMIT 1")
def q14(s):
    return s.where("workspace = 'ws7'").select("session_id", "chunk_count").orderBy(F.desc("chunk_count"), "session_id").limit(1)


@add("q15_scored_sessions", "descriptors", "SELECT DISTINCT session_id FROM descriptors WHERE tool = 'purchase'")
def q15(d):
    return d.where("tool = 'purchase'").select("session_id").distinct()


@add("q16_ordered_vectors", "records vectors", "SELECT r.session_id, r.chunk_index, round(CAST(v.embedding[1] AS DOUBLE), 6) AS first_component FROM records r JOIN vectors v ON r.record_id = v.record_id ORDER BY 1, 2")
def q16(r, v):
    return r.join(v, "record_id").select("session_id", "chunk_index", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_component")).orderBy("session_id", "chunk_index")


@add("q17_duplicate_sessions", "documents", "SELECT n_chars, md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def q17(d):
    return d.groupBy("n_chars", F.md5("text").alias("digest")).agg(n().alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@add("q18_entity_fragmentation", "entities", "SELECT lower(canonical_name) AS name, count(DISTINCT entity_type) AS types FROM entities GROUP BY 1 HAVING count(DISTINCT entity_type) > 1")
def q18(e):
    return e.groupBy(F.lower("canonical_name").alias("name")).agg(F.countDistinct("entity_type").alias("types")).where("types > 1")


@add("q19_entity_frequency_tail", "occurrences", "SELECT entity_id, count(DISTINCT record_id) AS chunks, round(count(DISTINCT record_id) / CAST((SELECT count(DISTINCT record_id) FROM occurrences) AS DOUBLE), 8) AS share FROM occurrences GROUP BY 1")
def q19(o):
    total = o.select("record_id").distinct().count()
    return o.groupBy("entity_id").agg(F.countDistinct("record_id").alias("chunks")).withColumn("share", F.round(F.col("chunks") / F.lit(float(max(1, total))), 8))


@add("q20_needs_backfill", "sessions metadata occurrences", "SELECT s.session_id FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM metadata m WHERE m.session_id = s.session_id) OR EXISTS (SELECT 1 FROM occurrences o WHERE o.session_id = s.session_id AND o.role IS NULL)")
def q20(s, m, o):
    gap = o.where("role IS NULL").select("session_id").distinct().withColumn("gap", F.lit(True))
    rows = s.select("session_id").join(m.select("session_id").withColumn("has", F.lit(True)), "session_id", "left").join(gap, "session_id", "left")
    return rows.where("has IS NULL OR gap").select("session_id")


@add("q21_pending_files", "pages", "SELECT page_id, url FROM pages WHERE url LIKE 'http://th%' ORDER BY page_id LIMIT 20")
def q21(p):
    return p.where(F.col("url").startswith("http://th")).select("page_id", "url").orderBy("page_id").limit(20)


@add("q22_chunk_export", "records customer", "SELECT r.record_id, r.session_id, r.chunk_index, r.n_chars, c.c_mktsegment FROM records r JOIN customer c ON r.record_id = c.c_custkey ORDER BY r.session_id, r.chunk_index")
def q22(r, c):
    return r.join(c, r["record_id"] == c["c_custkey"]).select("record_id", "session_id", "chunk_index", "n_chars", "c_mktsegment").orderBy("session_id", "chunk_index")


# ---- sort, limit, sets


@add("t1_order_by", "entities", "SELECT entity_id, canonical_name FROM entities ORDER BY canonical_name DESC, entity_id")
def t1(e):
    return e.select("entity_id", "canonical_name").orderBy(F.desc("canonical_name"), "entity_id")


@add("t2_limit_one", "sessions", "SELECT session_id, ts FROM sessions ORDER BY ts DESC, session_id LIMIT 1")
def t2(s):
    return s.select("session_id", "ts").orderBy(F.desc("ts"), "session_id").limit(1)


@add("t3_multi_key_top", "memories", "SELECT memory_id, evidence, access FROM memories ORDER BY evidence DESC, access DESC, memory_id LIMIT 30")
def t3(m):
    return m.select("memory_id", "evidence", "access").orderBy(F.desc("evidence"), F.desc("access"), "memory_id").limit(30)


@add("t6_leaderboard_floor", "memories", "SELECT workspace, round(count(*) FILTER (WHERE status = 'resolved') / CAST(count(*) AS DOUBLE), 6) AS rate, count(*) AS n FROM memories GROUP BY 1 HAVING count(*) >= 10 ORDER BY rate DESC, workspace")
def t6(m):
    return m.groupBy("workspace").agg(F.round(F.count_if(F.col("status") == "resolved") / n(), 6).alias("rate"), n().alias("n")).where("n >= 10").orderBy(F.desc("rate"), "workspace")


@add("t7_random_sample", "memories", "SELECT memory_id FROM memories ORDER BY md5('7:' || CAST(memory_id AS VARCHAR)), memory_id LIMIT 5")
def t7(m):
    return m.select("memory_id").orderBy(F.md5(F.concat(F.lit("7:"), F.col("memory_id").cast("string"))), "memory_id").limit(5)


@add("t8_paging", "records", "SELECT record_id, chunk_index FROM records WHERE chunk_index >= 100 ORDER BY chunk_index LIMIT 25")
def t8(r):
    return r.where("chunk_index >= 100").select("record_id", "chunk_index").orderBy("chunk_index").limit(25)


@add("set1_intersect_except", "entities", "SELECT 'both' AS side, count(*) AS n FROM (SELECT DISTINCT entity_type, canonical_name FROM entities WHERE entity_id % 2 = 0 INTERSECT SELECT entity_type, canonical_name FROM entities WHERE entity_id % 3 = 0) UNION ALL SELECT 'left', count(*) FROM (SELECT DISTINCT entity_type, canonical_name FROM entities WHERE entity_id % 2 = 0 EXCEPT SELECT entity_type, canonical_name FROM entities WHERE entity_id % 3 = 0)")
def set1(e):
    a = e.where("entity_id % 2 = 0").select("entity_type", "canonical_name").distinct()
    b = e.where("entity_id % 3 = 0").select("entity_type", "canonical_name").distinct()
    return a.intersect(b).agg(n().alias("n")).select(F.lit("both").alias("side"), "n").unionByName(a.join(b, ["entity_type", "canonical_name"], "left_anti").agg(n().alias("n")).select(F.lit("left").alias("side"), "n"))


@add("set2_overlap_ratio", "memberships", "WITH a AS (SELECT cluster_id, member_id FROM memberships), b AS (SELECT member_id % 10 AS old, member_id FROM memberships WHERE member_id % 2 = 0), sz AS (SELECT cluster_id, count(*) AS s FROM a GROUP BY 1) SELECT a.cluster_id, b.old, round(count(*) / CAST(max(s) AS DOUBLE), 6) AS overlap FROM a JOIN b ON a.member_id = b.member_id JOIN sz ON a.cluster_id = sz.cluster_id GROUP BY 1, 2")
def set2(c):
    size = c.groupBy("cluster_id").agg(n().alias("s"))
    b = c.where("member_id % 2 = 0").select((F.col("member_id") % 10).alias("old"), "member_id")
    return c.join(b, "member_id").groupBy("cluster_id", "old").agg(n().alias("k")).join(size, "cluster_id").select("cluster_id", "old", F.round(F.col("k") / F.col("s"), 6).alias("overlap"))


@add("set4_union_first_wins", "memories", "SELECT memory_id, max(score) AS score FROM (SELECT memory_id, evidence / 10.0 AS score FROM memories WHERE evidence > 6 UNION ALL SELECT memory_id, access / 20.0 FROM memories WHERE access > 3) GROUP BY 1")
def set4(m):
    a = m.where("evidence > 6").select("memory_id", (F.col("evidence") / 10.0).alias("score"))
    b = m.where("access > 3").select("memory_id", (F.col("access") / 20.0).alias("score"))
    return a.unionByName(b).groupBy("memory_id").agg(F.max("score").alias("score"))


@add("set5_distinct", "occurrences", "SELECT DISTINCT session_id, entity_id FROM occurrences")
def set5(o):
    return o.select("session_id", "entity_id").distinct()


@add("set6_upsert", "memories", "WITH new AS (SELECT memory_id + 5 AS memory_id, 'new' AS status FROM memories WHERE memory_id % 3 = 0) SELECT memory_id, status FROM new UNION ALL SELECT memory_id, status FROM memories m WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.memory_id = m.memory_id)")
def set6(m):
    from sessionlens.sources.tables import upserted

    new = m.where("memory_id % 3 = 0").select((F.col("memory_id") + 5).alias("memory_id"), F.lit("new").alias("status"))
    return upserted(m.select("memory_id", "status"), new, ["memory_id"])


@add("set7_replace_partition", "lineitem", "SELECT l_linestatus AS edge_type, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1 UNION ALL SELECT 'F', 3")
def set7(x):
    from sessionlens.sources.tables import replaced_where

    new = x.where("l_linestatus = 'F'").limit(3)
    return replaced_where(x, new, F.col("l_linestatus") == "F").groupBy(F.col("l_linestatus").alias("edge_type")).agg(n().alias("n"))


@add("set8_cascade_delete", "occurrences memory_sources memories", "WITH o AS (SELECT * FROM occurrences WHERE session_id % 10 <> 0), x AS (SELECT * FROM memory_sources WHERE session_id % 10 <> 0) SELECT 'degree' AS kind, entity_id AS id, count(DISTINCT session_id) AS n FROM o GROUP BY 2 UNION ALL SELECT 'orphan', memory_id, 0 FROM memories WHERE memory_id IN (SELECT memory_id FROM memory_sources) AND memory_id NOT IN (SELECT memory_id FROM x)")
def set8(o, x, m):
    gone = F.col("session_id") % 10 == 0
    degree = o.where(~gone).groupBy("entity_id").agg(F.countDistinct("session_id").alias("n")).select(F.lit("degree").alias("kind"), F.col("entity_id").alias("id"), "n")
    orphans = m.select("memory_id").join(x, "memory_id", "left_semi").join(x.where(~gone), "memory_id", "left_anti")
    return degree.unionByName(orphans.select(F.lit("orphan").alias("kind"), F.col("memory_id").alias("id"), F.lit(0).cast("long").alias("n")))


@add("tr13_entity_promotion", "occurrences entities", "WITH b AS (SELECT entity_id, session_id, count(DISTINCT record_id) AS c, count(*) AS n FROM occurrences GROUP BY 1, 2), a AS (SELECT entity_id, count(*) AS degree, CAST(sum(n) AS BIGINT) AS total, max(c) AS most, sum(c) AS chunks FROM b GROUP BY 1) SELECT a.entity_id, degree, total, most FROM a JOIN entities e ON a.entity_id = e.entity_id WHERE degree >= 3 AND most >= 2 AND degree <= 0.8 * (SELECT count(DISTINCT session_id) FROM occurrences) AND chunks <= 0.5 * (SELECT count(DISTINCT record_id) FROM occurrences)")
def tr13(o, e):
    totals = o.agg(F.countDistinct("session_id").alias("s"), F.countDistinct("record_id").alias("r")).first()
    return E.promotion(o, e, totals["s"], totals["r"])


@add("tr14_confidence", "occurrences entities", "SELECT e.entity_id, CASE WHEN coalesce(m.most, 0) >= 2 AND e.confidence IN ('raw', 'llm_verified') THEN 'session' ELSE e.confidence END AS confidence FROM entities e LEFT JOIN (SELECT entity_id, max(n) AS most FROM (SELECT entity_id, session_id, count(DISTINCT record_id) AS n FROM occurrences GROUP BY 1, 2) GROUP BY 1) m ON e.entity_id = m.entity_id")
def tr14(o, e):
    return E.confidence_after(o, e.select("entity_id", "confidence"))


@add("tr15_entity_upsert", "occurrences entities", "SELECT entity_id, count(DISTINCT session_id) AS degree, max(seen) AS last_seen, CASE max(r) WHEN 0 THEN 'raw' WHEN 1 THEN 'llm_verified' WHEN 2 THEN 'session' ELSE 'corpus' END AS confidence FROM (SELECT o.entity_id, o.session_id, o.seen, CASE WHEN o.chunk_index = 1 THEN 2 ELSE 0 END AS r FROM occurrences o) GROUP BY 1")
def tr15(o, _):
    rows = o.select("entity_id", "session_id", "seen", F.when(F.col("chunk_index") == 1, "session").otherwise("raw").alias("confidence"))
    return E.upserted(rows.where("session_id % 2 = 0"), rows.where("session_id % 2 <> 0"))
