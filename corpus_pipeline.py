"""Corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, benchmark decontamination, BPE encoding.

Each stage takes the rows that its predecessor kept. Between stages the rows are Parquet files in the shared folder.
The stage on word shingles takes five words and a similarity of 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm.bpe import bpe_stage
from lexweave.llm.common import Scratch, table
from lexweave.llm.decontaminate import decontaminate_stage
from lexweave.llm.jaccard_join import jaccard_stage
from lexweave.llm.line_dedup import line_stage
from lexweave.llm.quality_classifier import quality_stage

STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", jaccard_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", bpe_stage),
]

#: The learned stages, the edit join and the encoder have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"{k}-{name}")
    return docs
