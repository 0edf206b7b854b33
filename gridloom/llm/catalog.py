"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, htmltext, langid, linededup, minhash, sentencepiece, streamdedup, tokencount, toxicity, urlfilter
from .common import table


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = tokencount.token_blocks(table(spark, sf_dir, "documents"))
    return tokencount.token_counts(blocks).select(F.col("id").alias("doc_id"), "n_tokens")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=85, den=100)


def op3_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.verdicts(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(table(spark, sf_dir, "pages"))


def op5_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), F.expr("crc32(cast(doc_id as string)) % 5 = 0")
    found = toxicity.fitted_scores(docs, table(spark, sf_dir, "labels"), trains="crc32(cast(doc_id as string)) % 5 <> 0")
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamdedup.exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.fuzzy_lines(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(table(spark, sf_dir, "documents"), ids=False, decoded=False)


def op10_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, trains="crc32(cast(doc_id as string)) % 3 <> 1")
    return langid.identified(docs, model).withColumn("held_out", F.expr("crc32(cast(doc_id as string)) % 3 = 1"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_separator_scan": op1_separator_scan,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_redirect_equivalence": op3_redirect_equivalence,
    "op4_line_block_text": op4_line_block_text,
    "op5_weak_toxicity": op5_weak_toxicity,
    "op6_stream_dedup": op6_stream_dedup,
    "op7_string_tiling": op7_string_tiling,
    "op8_fuzzy_lines": op8_fuzzy_lines,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_kneser_ney_langid": op10_kneser_ney_langid,
}

OP6_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""

ORACLES: dict[str, str] = {
    "op3_redirect_equivalence": urlfilter.sql(),
    "op6_stream_dedup": OP6_SQL,
}
