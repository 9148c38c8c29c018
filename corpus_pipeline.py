"""Training-corpus pipeline: quality, toxicity, near duplicates, benchmark passages, tokens; each stage on all its predecessor kept."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowengine.llm import decontaminate, quality_crf, sentencepiece_viterbi, simhash_vptree, toxicity_cnn
from flowengine.llm.shared import table, unused, with_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    score = unused(docs, "score")
    rows = quality_crf.quality_scores(docs, table(spark, sf_dir, "labels"), out=score)
    return rows.where(F.col(score) >= quality_crf.THRESHOLD).drop(score)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not flagged as toxic at their language's threshold."""
    score, flag = unused(docs, "score"), unused(docs, "flagged")
    rows = toxicity_cnn.toxicity_scores(docs, table(spark, sf_dir, "labels"), out=score, flag=flag)
    return rows.where(~F.col(flag)).drop(score, flag)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates."""
    return simhash_vptree.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, n_spelled, exact) of every document left."""
    return sentencepiece_viterbi.tokenised(docs)


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxicity),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", tokens),
]
#: Classifiers and fingerprints are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again as the next one's input."""
    with_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
