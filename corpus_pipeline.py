"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of `documents`; the last returns
the packed pieces. Stages are written as Parquet in the shared folder and read again, so a lost executor
costs one stage's tasks and no stage sees more than its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapweave.llm import decontaminate, linededup, ngram_join, packing, toxicity
from snapweave.llm.common import Shelf, table

#: Documents whose toxicity reaches this are rejected.
TOXIC = 0.3


def apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stage's rows with the columns of `docs`, whatever these are called: the operator sees them under other names."""
    names = {c if c in ("doc_id", "text") else f"c{i}": c for i, c in enumerate(docs.columns)}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    found = stage(docs.select(*[quoted(c).alias(own) for own, c in names.items()]))
    return found.select(*[F.col(own).alias(c) for own, c in names.items()])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; learned from labels of rows that are not held out."""
    detector = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return apart(docs, lambda own: toxicity.score_toxicity(own, detector).where(F.col("toxicity") < TOXIC))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that stand earlier; documents of which nothing is left go.

    Shorter lines stay, so that passages of the benchmark reach their own stage whole. `n_chars` follows the text.
    """

    def stage(own: DataFrame) -> DataFrame:
        found = linededup.dedup_lines(own, far=linededup.OWN_FAR)
        return found.where((F.col("n_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))

    left = apart(docs, stage)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return left


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word 5-grams at 80 % Jaccard similarity."""
    return apart(docs, lambda own: ngram_join.keep_one(own, n=5, num=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item (nor a shorter item)."""
    benchmark = table(spark, sf_dir, "benchmark")
    return apart(docs, lambda own: decontaminate.decontaminate(own, benchmark, nameless=True).where(F.col("n_hit") == 0))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]
#: Learned scores, winnowing and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    shelf, docs = Shelf(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shelf.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
