"""A training-data pipeline over `documents`: quality, exact dedup, near dedup, mixing, segmentation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. The pipeline has no SQL: the classifier, the hash
thresholds and the sampled segmentations cannot be expressed in it; `tests/llm/test_pipeline.py` compares its rows with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelode.llm import common, exactdups, mixing, neardups, quality, segmentation

STAGES = [
    ("quality classifier", quality.stage),
    ("exact dedup", exactdups.stage),
    ("MinHash near-dedup", neardups.stage),
    ("mixing sources to target weights", mixing.stage),
    ("SentencePiece encoding and decoding", segmentation.stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(spark, stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
