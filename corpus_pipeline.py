"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. Stages are written as Parquet and read again, so a lost
executor costs its tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bbit_minhash, common, fm_decontam, line_templates, packing, quality_ledger


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their ids; a null text is the end id alone, rows of one id have pieces of their own."""
    pieces = packing.decompose(docs)
    return pieces.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [
    ("quality_rules", quality_ledger.keep_stage),
    ("line_dedup", line_templates.dedup_stage),
    ("near_dedup", bbit_minhash.dedup_stage),
    ("decontamination", fm_decontam.remove_stage),
    ("packing", _pack),
]

#: Tokenizing and the template tree are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. Once a stage is written, what it read and made on its way is removed."""
    docs, before = common.table(spark, sf_dir, "documents"), common.made()
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
        common.clean(spark, since=before, last=True)
    return docs
