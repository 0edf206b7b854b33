"""Token counts of documents in flat token files that have no index.

A flat file is a sequence of fixed-width token ids in which a separator id ends each document; a block is any stretch of
it, cut without regard to documents. Each block is searched for separators in one vectorised comparison. What a block
tells the blocks after it is two numbers, its length and the place of its last separator; these are combined by a prefix
scan in levels of FAN blocks, so that no task holds all blocks of a file, and the scan stitches documents that
cross any number of blocks.

Cases: a null text counts as empty, and an empty text has 0 tokens; a document longer than a block, a separator on a
block's edge and blocks without separators are counted right; what follows a file's last separator is a document that is
not terminated; repeated rows are documents of their own; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, text_batches, written

BLOCK_TOKENS = 1 << 16
FAN = 1024
SEPARATOR = 50256

BLOCKS = "file string, block bigint, payload binary, ids array<bigint>"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_tokenizers: dict[str, object] = {}


def tokenizer(ranks_file: str):
    if ranks_file not in _tokenizers:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_file, "rb"))}
        _tokenizers[ranks_file] = tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _tokenizers[ranks_file]


def token_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_file: str | None = None, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Tokenises documents into flat files, one a partition, as blocks of `block_tokens` ids (of two bytes each).

    ids: the documents whose separators lie in the block, in their order; the scan itself reads the payload alone."""
    text_batches(docs.sparkSession)
    path = ranks_file or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        file, block = f"part-{TaskContext.get().partitionId():06d}", 0
        parts: list[np.ndarray] = []
        ends: list[tuple[int, int | None]] = []
        size = 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal parts, ends, size, block
            flat = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
            at = 0
            while len(flat) - at >= block_tokens or last and at < len(flat):
                piece = flat[at : at + block_tokens]
                own = [i for e, i in ends if e < at + len(piece)]
                ends = ends[len(own) :]
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([piece.tobytes()], pa.binary()), pa.array([own], pa.list_(pa.int64()))], ["file", "block", "payload", "ids"])
                at += len(piece)
                block += 1
            parts, size = [flat[at:]], len(flat) - at
            ends = [(e - at, i) for e, i in ends]

        for batch in bounded(batches):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = encode(text) if text else []
                found.append(separator)
                parts.append(np.array(found, np.uint16))
                size += len(found)
                ends.append((size - 1, i))
            if size >= 16 * block_tokens:
                yield from cut(False)
        yield from cut(True)

    return docs.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(run, BLOCKS)


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of flat token files below a folder; a file may have 2 GB, as Spark's binary reader holds it in one row."""
    text_batches(spark)
    step = width * block_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = raw.as_buffer()
                for k, at in enumerate(range(0, whole.size - whole.size % width, step)):
                    part = whole.slice(at, min(step, whole.size - whole.size % width - at)).to_pybytes()
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([part], pa.binary()), pa.array([[]], pa.list_(pa.int64()))], ["file", "block", "payload", "ids"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, BLOCKS)


def separators(blocks: DataFrame, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """(file, block, n, ends, ids): each block's length and the places of its separators."""
    kind = {2: np.uint16, 4: np.uint32}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            flat = [np.frombuffer(x or b"", kind) for x in batch.column(2).to_pylist()]
            ends = pa.array([np.flatnonzero(x == separator) for x in flat], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in flat], pa.int64()), ends, batch.column(3)], ["file", "block", "n", "ends", "ids"])

    return blocks.mapInArrow(run, "file string, block bigint, n bigint, ends array<bigint>, ids array<bigint>")


def prefix_scan(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """(file, pos, n, last) with start, the tokens before, and before, the place of the last separator before (null: none)."""
    most = rows.agg(F.max("pos")).first()[0] or 0

    def within(*keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        out = rows.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)))
        return out.withColumn("before", F.max(F.col("start") + F.col("last")).over(w))

    if most < fan:
        return within("file")
    rows = rows.withColumn("up", F.expr(f"pos div {fan}"))
    inner = within("file", "up")
    above = inner.groupBy("file", "up").agg(F.sum("n").alias("n"), F.max(F.col("start") + F.col("last")).alias("last"))
    above = prefix_scan(written(above.withColumnRenamed("up", "pos"), "scan"), fan)
    above = above.select("file", F.col("pos").alias("up"), F.col("start").alias("up_start"), F.col("before").alias("up_before"))
    joined = inner.join(above, ["file", "up"])
    return joined.withColumn("before", F.coalesce(F.col("up_start") + F.col("before"), "up_before")).withColumn("start", F.col("up_start") + F.col("start")).drop("up", "up_start", "up_before")


def token_counts(blocks: DataFrame, separator: int = SEPARATOR, width: int = 2, fan: int = FAN) -> DataFrame:
    """(file, start, n_tokens, terminated, id) of every document; id: null where blocks carry none."""
    found = written(separators(blocks, separator, width), "separators")
    rows = found.select("file", F.col("block").alias("pos"), "n", F.array_max("ends").alias("last"), "ends", "ids")
    placed = prefix_scan(rows, fan)
    previous = F.expr("concat(array(before), transform(slice(ends, 1, greatest(size(ends) - 1, 0)), x -> x + start))")
    each = placed.where("size(ends) > 0").select("file", "start", F.explode(F.arrays_zip(F.col("ends"), previous.alias("previous"), F.col("ids"))).alias("d"))
    each = each.select("file", (F.coalesce(F.col("d.previous"), F.lit(-1)) + 1).alias("from"), (F.col("start") + F.col("d.ends")).alias("end"), F.col("d.ids").alias("id"))
    each = each.select("file", F.col("from").alias("start"), (F.col("end") - F.col("from")).alias("n_tokens"), F.lit(True).alias("terminated"), "id")
    tails = placed.groupBy("file").agg(F.max(F.col("start") + F.col("n")).alias("end"), (F.coalesce(F.max(F.coalesce(F.col("start") + F.col("last"), "before")), F.lit(-1)) + 1).alias("start"))
    tails = tails.where("end > start").select("file", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"), F.lit(None).cast("bigint").alias("id"))
    return each.unionAll(tails)
