"""A unified corpus that grows by batches of files, with cumulative sets and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunecorpus.functions.tokens import whitespace_tokens
from dunecorpus.operators.staging import cut
from dunecorpus.sources.readers import CORRUPT

#: Sets that the state keeps: name -> the record's column.
SETS = {"channels": "channel", "videos": "video_id"}


def fold(spark: SparkSession, source: str, schema: str, corpus: str, state: str, checkpoint: str, files: int | None = None) -> DataFrame:
    """Fold the JSON lines files that are new since the last call into ``corpus``; one row of totals so far is returned.

    ``corpus`` gets (id, text) of records that have both, a folder a batch.
    ``state`` is a table of set members and of totals, each committed under its
    batch's number: (kind, member) rows that no earlier batch holds, and one
    ``total`` row with the batch's documents and tokens.  A batch that is run
    again, by a restart before its commit, overwrites its own numbers and looks
    only at lower ones, so nothing doubles.  ``files`` bounds a batch's files.
    """

    def put(batch: DataFrame, number: int) -> None:
        good = batch.where(F.col(CORRUPT).isNull() & F.col("id").isNotNull() & (F.col("id") != "") & F.col("text").isNotNull())
        good = cut(good.select("id", "text", *SETS.values()))
        good.select("id", "text").write.mode("overwrite").parquet(f"{corpus}/batch={number}")
        members = None
        for kind, column in SETS.items():
            some = good.select(F.lit(kind).alias("kind"), F.col(column).alias("member")).where(F.coalesce(F.col("member") != "", F.lit(False))).distinct()
            members = some if members is None else members.unionByName(some)
        known = read_state(spark, state).where(F.col("batch") < number)
        new = members.join(known.select("kind", "member"), ["kind", "member"], "left_anti").select("kind", "member", F.lit(None).cast("long").alias("docs"), F.lit(None).cast("long").alias("tokens"))
        total = good.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size(whitespace_tokens(F.col("text")))), F.lit(0)).alias("tokens"))
        total = total.select(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("member"), "docs", "tokens")
        new.unionByName(total).write.mode("overwrite").parquet(f"{state}/batch={number}")

    reader = spark.readStream.schema(f"{schema}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    reader.json(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return totals(spark, state)


def read_state(spark: SparkSession, state: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(state)
    schema = "kind string, member string, docs long, tokens long, batch int"
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(state)


def totals(spark: SparkSession, state: str) -> DataFrame:
    """(docs, tokens, a count of each set) so far."""
    rows = read_state(spark, state)
    return rows.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), *[F.count_if(F.col("kind") == k).alias(k) for k in SETS])
