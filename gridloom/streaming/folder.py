"""New files of a folder, tidied as they arrive: an extension that the batch engine makes possible."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.classify import numeric_values
from ..plans.analyze import analyze_cells
from ..plans.compose import compose_long
from ..sources.delimited import text_cells, text_lines


def watch_folder(spark: SparkSession, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None], files_per_batch: int = 1000, once: bool = True) -> StreamingQuery:
    """Delimited text files below `path` as long tidy rows, one micro-batch after another, to sink(rows, batch id)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_batch).load(path)

    def each(batch: DataFrame, number: int) -> None:
        lines = text_lines(batch.select(F.col("path").alias("sheet_id"), "content"))
        sink(compose_long(analyze_cells(numeric_values(text_cells(lines)))), number)

    out = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
