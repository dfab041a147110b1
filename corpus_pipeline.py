"""Documents to token ids in stages: each takes (spark, docs, sf_dir) and returns a DataFrame.

run() applies STAGES to documents; between stages the rows are written as Parquet and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionlens.llm.bpe import bpe_stage
from sessionlens.llm.common import stored, table
from sessionlens.llm.mixing import mixing_stage
from sessionlens.llm.pii import pii_stage
from sessionlens.llm.quality_rules import quality_stage
from sessionlens.llm.super_minhash import near_stage

STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: The learned rules and the tokenizer's merges are beyond SQL; the stages have brute-force tests instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
