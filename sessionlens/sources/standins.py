"""The driver's tables in the roles of the engine's tables, as portable SELECTs.

The same text makes the DataFrame (through Spark SQL) and the oracle's common table expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SELECTS = {
    "sessions": """
        SELECT o_orderkey AS session_id, concat('ws', o_custkey % 40) AS workspace, o_orderdate AS ts,
          CASE o_orderkey % 3 WHEN 0 THEN 'claude_code' WHEN 1 THEN 'gemini_cli' ELSE 'opencode' END AS plugin,
          CASE WHEN o_orderkey % 11 = 0 THEN 'noise' ELSE concat('cluster_', o_orderkey % 5) END AS session_type,
          1 + o_orderkey % 9 AS chunk_count, o_orderpriority AS summary
        FROM orders""",
    "metadata": """
        SELECT o_orderkey AS session_id, CAST(floor(o_totalprice) AS BIGINT) AS input_tokens,
          CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE CAST(floor(o_totalprice * 0.5) AS BIGINT) END AS cache_read,
          CAST(floor(o_totalprice / 8) AS BIGINT) AS output_tokens, o_orderkey % 17 AS tool_calls,
          o_orderkey % 6 AS user_turns, o_orderpriority AS model,
          CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'F' THEN '[rules]' ELSE 'default' END AS permission_mode
        FROM orders WHERE o_orderkey % 10 <> 3""",
    "occurrences": """
        SELECT l_orderkey AS session_id, l_orderkey * 10 + l_linenumber AS record_id, l_linenumber AS chunk_index,
          l_partkey AS entity_id, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS role, l_shipdate AS seen
        FROM lineitem""",
    # things that few sessions share
    "rare_occurrences": "SELECT l_orderkey AS session_id, l_partkey * 10 + l_linenumber AS entity_id FROM lineitem",
    "entities": """
        SELECT p_partkey AS entity_id, p_name AS canonical_name, lower(p_type) AS entity_type,
          CASE p_size % 4 WHEN 0 THEN 'raw' WHEN 1 THEN 'llm_verified' WHEN 2 THEN 'session' ELSE 'corpus' END AS confidence
        FROM part""",
    "memories": """
        SELECT doc_id AS memory_id, text AS content, source AS workspace, lang,
          CASE doc_id % 7 WHEN 0 THEN 'fact' WHEN 1 THEN 'decision' WHEN 2 THEN 'preference' WHEN 3 THEN 'episodic'
            WHEN 4 THEN 'pattern_recovery' WHEN 5 THEN 'procedure' ELSE 'insight' END AS memory_type,
          CASE doc_id % 9 WHEN 0 THEN 'superseded' WHEN 1 THEN NULL WHEN 2 THEN 'open' WHEN 3 THEN 'reverted' ELSE 'resolved' END AS status,
          n_chars % 13 AS evidence, n_chars % 7 AS access, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id % 200 END AS entity_id,
          n_chars
        FROM documents""",
    "memory_sources": "SELECT DISTINCT l_partkey AS memory_id, l_orderkey AS session_id FROM lineitem WHERE l_linenumber = 1",
    "records": """
        SELECT doc_id AS record_id, source AS session_id, CAST(doc_id AS BIGINT) AS chunk_index, text AS chunk_text, lang, n_chars
        FROM documents""",
    "vectors": "SELECT vec_id AS record_id, embedding, label FROM embeddings",
    "descriptors": """
        SELECT user_id AS session_id, event_id, ts, event_type AS tool, event_type = 'error' AS failed, value,
          row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS exchange_idx,
          CAST(floor(value) AS BIGINT) % 40 AS words
        FROM events""",
    "retrievals": """
        SELECT event_id AS retrieval_id, event_id % 500 AS memory_id, ts AS retrieved_at,
          CASE event_type WHEN 'click' THEN 'recall' WHEN 'view' THEN 'chunk_search' ELSE 'graph_walk' END AS method
        FROM events WHERE event_type <> 'error'""",
    "memberships": """
        SELECT doc_id % 40 AS cluster_id, doc_id AS member_id, CASE WHEN doc_id % 3 = 0 THEN 'cross' ELSE 'within' END AS level
        FROM documents WHERE doc_id % 4 <> 1""",
}


def frames(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Stand-ins, or the driver's own tables by their names."""
    out = []
    for name in names:
        if name not in SELECTS:
            out.append(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
            continue
        base = re.search(r"FROM (\w+)", SELECTS[name])[1]
        out.append(spark.sql(re.sub(rf"FROM {base}\b", "FROM {base}", SELECTS[name]), base=spark.read.parquet(f"{sf_dir}/{base}.parquet")))
    return out


def with_views(body: str, *names: str) -> str:
    """An oracle's SQL: the stand-ins as common table expressions before the body."""
    head = ",\n".join(f"{n} AS ({SELECTS[n].strip()})" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
