"""From raw documents to encoded training text, in five stages.

Each stage is a function of (spark, docs, sf_dir): docs is the Parquet of its predecessor, sf_dir has the other tables.
All but the last keep the columns of `documents`. The last gives doc_id, text and the piece ids.

In every stage null texts are like empty ones and stay as they are, further columns travel along whatever their names, and an empty table
gives an empty one. Rows that repeat an id are judged one by one, but for near-duplicates, where all rows of an id stay or go together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from surveil.llm._spark import checkpoint_dir, table
from surveil.llm.decontaminate import drop_contaminated
from surveil.llm.near_duplicates import drop_near_duplicates
from surveil.llm.pieces import encode
from surveil.llm.quality import keep_quality
from surveil.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject: a score of 0.3 or more stays. Without labels every score is a half and all stay."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates. Texts without words, and rows without id, are near none and stay."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Items of fewer than five words, null ones and an empty benchmark match nothing."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars to match; where spans overlap the earlier one counts. Without a secret to learn from only the patterns are masked."""
    return redact_secrets(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids; null texts have null ids, empty ones none. Of equal scores the path with the longer last piece is taken."""
    return encode(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding", pieces),
]

#: SQL cannot express a trained classifier, a trained field or the piece lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again, and goes when its successor is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            folder = spark._jvm.org.apache.hadoop.fs.Path(before)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
