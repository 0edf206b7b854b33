"""Results that several steps read, and the folder that all executors share."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def kept(df: DataFrame) -> DataFrame:
    """df without its lineage, in the checkpoint folder that all executors share; where none is set, df persisted."""
    held = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    return df.checkpoint() if held else df.persist()


def shared_path(spark: SparkSession, name: str) -> str:
    """A folder below spark.checkpoint.dir; a local session without one, as in tests, gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: files need a folder that all executors share")
        where = tempfile.mkdtemp(prefix="gridloom-")
    return f"{where.rstrip('/')}/gridloom/{name}-{spark.sparkContext.applicationId}"
