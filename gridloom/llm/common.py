"""What the training-data operators share: shared-folder tables, word hashing, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of whole texts that a worker takes from an Arrow batch at a time.
TEXT_BATCH_ROWS = 256

#: Words longer than this, in bytes, are hashed by BLAKE2 instead of the vectorised polynomial.
LONG_WORD = 1 << 15
#: Bytes of text that are hashed at a time.
SEGMENT = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir). Where it is unset a local session, as in
    tests, gets one; a cluster has none to fall back to, since a folder of one machine is not seen by the others."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = held.get()
    return where.rstrip("/")


#: The open scopes of the running thread, the innermost last: the paths that each removes at its end.
_scopes: ContextVar[tuple[set[str], ...]] = ContextVar("scopes", default=())


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    for held in _scopes.get()[-1:]:
        held.add(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Removes at its end the tables made within, but for those handed to the function it gives, which belong to the
    scope around it. What leaves the scope must not read removed tables any more."""
    outer, own = _scopes.get(), set()
    _scopes.set((*outer, own))

    def keep(*tables: DataFrame | str) -> None:
        kept = {t if isinstance(t, str) else t._written_at for t in tables}
        own.difference_update(kept)
        for held in outer[-1:]:
            held.update(kept)

    try:
        yield keep
    finally:
        _scopes.set(outer)
        for path in own:
            remove(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and survives lost executors. The shuffle files of the
    job go as soon as the table is there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return opened(spark, df.schema, path)


def opened(spark: SparkSession, schema: StructType | str, path: str) -> DataFrame:
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Removes tables that written() made and that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df._written_at)


def filter_of(ids: DataFrame, bits: int) -> np.ndarray:
    """A one-hash Bloom filter of fixed size over the column `at` (values below `bits`), put together on the executors."""
    words = ids.selectExpr("cast(shiftright(at, 5) as int) as word", "shiftleft(1L, cast(at & 31 as int)) as bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out


def passes(held: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the filter has the places."""
    return (held[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)


def text_batches(spark: SparkSession) -> None:
    """Lowers the rows of an Arrow batch to TEXT_BATCH_ROWS for this session; Spark bounds its bytes too. A plan reads the
    setting when it runs, after the operator has returned, so it stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))


def bounded(batches: Iterator[pa.RecordBatch], rows: int = TEXT_BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some rows. Spark bounds a batch by bytes (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB);
    the slices bound what a worker holds of it as Python objects."""
    for batch in batches:
        for lo in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(lo, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHasher:
    """64-bit hashes of the words of a text, a word being a run of bytes that aren't ASCII white space.

    A prefix sum of byte * base^i gives the hash of every word of a segment at once."""

    def __init__(self) -> None:
        self._up = _powers(_BASE, 1 << 12)
        self._down = _powers(_INV, 1 << 12)

    def _segment(self, a: np.ndarray) -> np.ndarray:
        if len(a) > len(self._up):
            n = 1 << (len(a) - 1).bit_length()
            self._up, self._down = _powers(_BASE, n), _powers(_INV, n)
        inside = np.concatenate(([False], ~_SPACE[a], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * self._up[: len(a)], dtype=np.uint64)))
        sizes = (ends - starts).astype(np.uint64)
        out = mix64((sums[ends] - sums[starts]) * self._down[starts] + sizes * np.uint64(0xD6E8FEB86659FD93))
        for i in np.flatnonzero(sizes > LONG_WORD):
            out[i] = int.from_bytes(blake2b(a[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        return out

    def words(self, raw: bytes) -> np.ndarray:
        a = np.frombuffer(raw, np.uint8)
        if len(a) <= SEGMENT:
            return self._segment(a) if len(a) else np.zeros(0, np.uint64)
        parts, at = [], 0
        while at < len(a):
            end = min(at + SEGMENT, len(a))
            if end < len(a):
                gaps = np.flatnonzero(_SPACE[a[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:  # a word longer than a segment: up to the next white space
                    while end < len(a) and not _SPACE[a[end]]:
                        step = _SPACE[a[end : end + SEGMENT]]
                        end += int(step.argmax()) if step.any() else len(step)
                    parts.append(np.array([int.from_bytes(blake2b(a[at:end].tobytes(), digest_size=8).digest(), "little")], np.uint64))
                    at = end
                    continue
            parts.append(self._segment(a[at:end]))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def shingles(self, raw: bytes, width: int) -> np.ndarray:
        """Sorted distinct hashes of all runs of `width` words; of the whole sequence if there are fewer; none without words."""
        w = self.words(raw)
        if not len(w):
            return w
        k = min(width, len(w))
        h = np.zeros(len(w) - k + 1, np.uint64)
        for i in range(k):
            h = mix64(h * np.uint64(0xFF51AFD7ED558CCD) + w[i : len(w) - k + 1 + i] + np.uint64(k))
        return np.unique(h)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node reaches over the undirected edges.

    Alternates large-star and small-star rounds; each round is written to the shared folder. Minima are
    pre-aggregated before the shuffle, and a hub's edges meet its minimum in an inner join, which adaptive
    execution may split, so no task has to hold all the edges of one node. The caller may discard the result, a written
    table, once it is read."""
    now = written(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo <> hi").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct()
        large = written(large, "large-star")
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select(F.col("m").alias("lo"), F.col("lo").alias("mid"), "hi")
        small = small.select("lo", F.explode(F.array("mid", "hi")).alias("hi")).where("lo <> hi").distinct()
        old, now = now, written(small, "small-star")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        discard(old, large)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    out = written(now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()), "components")
    discard(now)
    return out
