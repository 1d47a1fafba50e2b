"""The corpus pipeline: five stages over ``documents``, each reading what the one before kept.

Cases: null and empty texts are documents like others to the classifier, equal to each other in exact
deduplication, linked with nothing in near deduplication, never contaminated, and encoded as no ids; rows
that repeat count as copies of each other, so one stays; ties are those of the stages' operators; an empty
table passes through all stages; columns besides those of documents are kept up to the last stage, whatever
their names and types (maps and variants included).  Names that differ in case only are refused by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.bottomk import near_stage
from scriptorium.llm.common import documents, stage
from scriptorium.llm.decontaminate import decontaminate_stage
from scriptorium.llm.exact_dedup import dedup_stage
from scriptorium.llm.lexicon import encode_stage
from scriptorium.llm.quality import quality_stage

STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", dedup_stage),
    ("minhash_near_dedup", near_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("bpe_encoding", encode_stage),
]

#: Trained models, similarity joins and tokenisers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order; each is written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    for k, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
    return docs
