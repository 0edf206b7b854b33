"""A training-corpus pipeline: each stage takes what its predecessor kept, written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Rows with
a null doc_id can't be told apart, so the stages that drop by id keep them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, minhash, sentencepiece, streamdedup, toxicity
from gridloom.llm.common import discard, scratch, table, written

#: Ids that are broadcast at most, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, find: Callable[[], DataFrame]) -> DataFrame:
    """The rows whose doc_id is not among those found; the tables made to find them go."""
    with scratch(docs.sparkSession) as keep:
        gone = written(find().select("doc_id").distinct(), "dropped")
        keep(gone)
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), trains="crc32(cast(doc_id as string)) % 5 <> 0")
    taken = {c.lower() for c in docs.columns}
    free = next(n for n in map("score_{}".format, range(len(taken) + 1)) if n not in taken)
    return toxicity.scored(docs, model, keep=free).where(F.col(free) < 0.5).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, lambda: streamdedup.exact_duplicates(docs).where("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, lambda: minhash.near_duplicates(docs).where("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, lambda: decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(docs, decoded=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]

#: Most stages can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            discard(before)
    return docs
