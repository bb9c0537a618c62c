"""Where results are put on the way: the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slices in which :func:`sliced` takes its rows: so much less of a shuffle is on disk at a time.
SLICES = 3


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session that names none gets a temporary one."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (None if known.isEmpty() else known.get())
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="dunecorpus-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder, so that lost executors cost no more than their own part."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate results, wherever Spark keeps it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` as compressed Parquet, a fraction of a checkpoint's bytes; what led to it is let go, or its shuffle files stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path)
    del df
    free(spark)
    return spark.read.parquet(path)


def free(spark: SparkSession) -> None:
    """Let shuffle files go that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def sliced(make: Callable[[Callable[..., DataFrame]], DataFrame], path: str) -> DataFrame:
    """``make`` for one slice of its rows after the other, each stored before the next one begins.

    ``make`` gets a function that takes a relation's rows of the slice by a
    hash of some columns; all rows of equal columns are in one slice, so what is
    grouped or joined by them is whole.
    """
    spark = None
    for i in range(SLICES):
        spark = stored(make(lambda df, *keys, i=i: df.where(F.pmod(F.xxhash64(*keys), F.lit(SLICES)) == i)), f"{path}/slice={i}").sparkSession
    return spark.read.parquet(path).drop("slice")
