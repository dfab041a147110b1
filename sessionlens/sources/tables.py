"""Tables of the store: schemas, loading, keyed upserts, replacement, additive migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemas by DDL; times are kept as text beside a parsed timestamp where a table has both.
SCHEMAS = {
    "sessions": "id string, source_type string, source_plugin string, workspace_id string, session_timestamp string, ts timestamp, session_type string, chunk_count bigint, session_summary string, content_hash string",
    "records": "id string, session_id string, chunk_index bigint, chunk_text string, chunk_summary string, evidence_text string, token_count bigint, span_start bigint, span_end bigint",
    "entities": "id string, canonical_name string, entity_type string, confidence string, degree_count bigint, first_seen timestamp, last_seen timestamp",
    "occurrences": "id string, record_id string, session_id string, entity_id string, role string, mention_text string, context_text string",
    "session_graph_edges": "src string, tgt string, edge_type string, via_entity_id string, weight double",
    "memories": "id string, workspace_id string, memory_type string, content string, status string, entity_id string, evidence_count bigint, access_count bigint, extraction_method string",
    "memory_sources": "memory_id string, session_id string",
    "memory_cluster_members": "cluster_id string, member_id string",
    "conflicts": "id string, memory_a string, memory_b string, resolution string",
    "step_scores": "session_id string, exchange_idx bigint, evidence_supports double, tokens double, redundancy double, features string",
    "critical_steps": "id string, session_id string, exchange_idx bigint, tag string, failure_mode string, delta double",
    "session_inflections": "session_id string, inflection_type string, precipitating_turn bigint, entry_turn bigint, exit_turn bigint, signal_strength double, dominant_feature string",
    "ingestion_state": "id string, abs_path string, file_type string, content_hash string, session_id string, status string",
    "memory_retrievals": "id string, memory_id string, query string, method string, rank bigint, retrieved_at timestamp",
}

#: Keys of the tables that have more than one key column; the others' key is their first column.
KEYS = {
    "session_graph_edges": ["src", "tgt", "edge_type", "via_entity_id"],
    "memory_sources": ["memory_id", "session_id"],
    "memory_cluster_members": ["cluster_id", "member_id"],
    "step_scores": ["session_id", "exchange_idx"],
    "session_inflections": ["session_id", "inflection_type", "precipitating_turn", "entry_turn"],
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def migrated(df: DataFrame, name: str, fill: dict[str, Column] | None = None) -> DataFrame:
    """The table in today's schema: missing columns appear (with `fill` or null), values are cast, others go."""
    fill = fill or {}
    cols = []
    for f in schema(name):
        now = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append((F.coalesce(now.cast(f.dataType), fill[f.name]) if f.name in fill else now.cast(f.dataType)).alias(f.name))
    return df.select(cols)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` replace those of `old` with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` whose keys are not there yet are added; of several one stays."""
    return old.unionByName(new.join(old, keys, "left_anti").dropDuplicates(keys))


def replaced_where(old: DataFrame, new: DataFrame, part: Column) -> DataFrame:
    """The rows of `old` that meet `part` go, and `new` comes in."""
    return old.where(~F.coalesce(part, F.lit(False))).unionByName(new)
