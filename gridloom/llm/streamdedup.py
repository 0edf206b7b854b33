"""Exact deduplication by stateful streaming.

Documents arrive as (digest, identifier, content locator). A streaming aggregation keyed by digest holds, in RocksDB on
the executors' disks and without expiry, the largest identifier, its locator and the number of copies; arrivals are
summed within each task before they reach the state, so a digest of any frequency gives each task one row. A digest with
more than one arrival is a hit: the texts behind the hits are read again and grouped by their full bytes, and digests
that stand for different texts are split.

Texts are equal when identical after lower-casing A-Z only. Cases: a null text counts as empty; of equal texts the row
with the largest id stays; rows that share an id and a text are kept or dropped together; a null id stays only if no
equal row has an id; texts of any length are compared whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, filter_of, new_path, opened, scratch, text_batches, written

#: Files of arrivals that a micro-batch takes.
FILES = 64
#: Bits of the filter that tells which texts to read again: 1 MB, whatever the input.
FILTER_BITS = 1 << 23


def sha256(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def arrivals(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """(id, locator, digest); works on streams as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            found = [digest(normalised(x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["id", "locator", "digest"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.input_file_name().alias("locator"), text_col).mapInArrow(run, "id bigint, locator string, digest binary")


def retained(path: str, like: DataFrame) -> DataFrame:
    """Streams the arrivals at `path` through the keyed state: (digest, keep_id, locator, group_size)."""
    spark = like.sparkSession
    conf = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        # a store per partition: without space set aside for each, and with changes rather than whole files sent at a commit
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    out = new_path(spark, "retained")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", FILES).parquet(path)
        state = stream.groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("kept"), F.count("*").alias("group_size"))
        state = state.select("digest", F.col("kept.id").alias("keep_id"), F.col("kept.locator").alias("locator"), "group_size")
        query = state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "digest binary, keep_id bigint, locator string, group_size bigint, batch int"
    changes = spark.read.schema(schema).parquet(out) if _any(spark, out) else spark.createDataFrame([], schema)
    last = changes.groupBy("digest").agg(F.max(F.struct("batch", "keep_id", "locator", "group_size")).alias("at"))
    return last.select("digest", "at.keep_id", "at.locator", "at.group_size")


def _any(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _texts_of(docs: DataFrame, id_col: str, text_col: str, hits: DataFrame, digest: Callable[[bytes], bytes]) -> DataFrame:
    """(id, digest, raw) of the documents whose digests are hits, and of few others."""
    at = F.expr(f"cast(conv(hex(substring(digest, 1, 4)), 16, 10) as bigint) % {FILTER_BITS}").alias("at")
    held = docs.sparkSession.sparkContext.broadcast(filter_of(hits.select(at), FILTER_BITS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in bounded(batches):
            ids, digests, raws = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = digest(raw := normalised(text))
                place = int.from_bytes(found[:4], "big") % FILTER_BITS
                if table[place >> 5] >> (place & 31) & 1:
                    ids.append(i)
                    digests.append(found)
                    raws.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())], ["id", "digest", "raw"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), text_col).mapInArrow(read, "id bigint, digest binary, raw binary")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, locator) of every row; locator: the file that holds the row that stays."""
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    with scratch(spark) as keep:
        path = new_path(spark, "arrivals")
        arrivals(docs, id_col, text_col, digest).write.parquet(path)
        rows = opened(spark, "id bigint, locator string, digest binary", path)
        state = written(retained(path, rows), "state-of-digests")
        hits = state.where("group_size > 1").select("digest")
        texts = _texts_of(docs, id_col, text_col, hits, digest)
        classes = texts.groupBy("digest", "raw").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        split = written(classes.groupBy("digest").count().where("count > 1").select("digest"), "collisions")
        out = rows.select("id", "digest").join(state, "digest")
        if not split.isEmpty():  # different texts with one digest: their classes are those of the full bytes
            apart = written(texts.join(split, "digest", "left_semi").join(classes, ["digest", "raw"]).select("id", "digest", "keep_id", "group_size"), "collided")
            out = out.join(split, "digest", "left_anti").unionByName(apart, allowMissingColumns=True)
            keep(split, apart)
        keep(rows, state)
    hexed = F.lower(F.hex("digest"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), hexed.alias("text_sha256"), "locator")
