"""Incremental ingestion: each file is taken once, across runs, with cumulative counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunecorpus.functions import text
from dunecorpus.sources.readers import CORRUPT


def ingest(spark: SparkSession, source: str, schema: str, out: str, state: str, text_column: str = "text") -> DataFrame:
    """Clean the JSON lines files that are new since the last call into ``out``; the run log so far is returned.

    The checkpoint in ``state`` remembers the files.  A batch that is run again
    after a loss overwrites its own folder of ``out``, so nothing doubles.
    """

    def put(batch: DataFrame, number: int) -> None:
        good = batch.where(F.col(CORRUPT).isNull() & F.col(text_column).isNotNull()).drop(CORRUPT)
        cleaned = text.clean(good, text_column, keep_null=True)
        cleaned.withColumn("file", F.input_file_name()).write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.unpersist()

    stream = spark.readStream.schema(f"{schema}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).json(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    log = spark.read.parquet(out).groupBy("batch").agg(F.count("*").alias("collected"), F.count(text_column).alias("retained"), F.count_if(F.col(text_column).isNull()).alias("dropped"))
    return log
