"""Packed binary files of fixed-width records, as a Spark data source with task commit and abort.

    df.write.format("packed").mode("overwrite").option("layout", "triplet").save(path)
    spark.read.format("packed").option("layout", "triplet").load(path)

A task writes one file under a name of its own in ``_parts``; a file moves to
its place only when its task commits, the driver lists the committed files in
``_SUCCESS.json``, and an aborted or lost task's file is deleted.  Readers take
what that list names, so an attempt that was killed is never read.  ``path`` is
a folder that driver and executors share.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: layout -> (little-endian record, Spark's columns)
LAYOUTS = {
    "uint16": (np.dtype([("value", "<u2")]), "value int"),
    "triplet": (np.dtype([("i", "<i4"), ("j", "<i4"), ("x", "<f4")]), "i int, j int, x float"),
}
#: Records of a file that one task reads, and of a batch.
SPLIT, BATCH = 1 << 22, 1 << 16
DONE = "_SUCCESS.json"


def _folder(options) -> str:
    return os.path.abspath(options["path"].removeprefix("file://").removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int


class PackedWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.folder, self.overwrite = _folder(options), overwrite
        self.record = LAYOUTS[options.get("layout", "triplet")][0]
        self.run = uuid.uuid4().hex[:8]
        os.makedirs(f"{self.folder}/_parts", exist_ok=True)

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():05d}-{self.run}-{TaskContext.get().taskAttemptId()}.bin"
        records = 0
        try:
            with open(f"{self.folder}/_parts/{name}", "wb") as f:
                for batch in iterator:
                    out = np.empty(batch.num_rows, self.record)
                    for field in self.record.names:
                        column = batch.column(batch.schema.names.index(field))
                        if column.null_count:
                            raise ValueError(f"{field} holds nulls; packed records have none")
                        x = np.asarray(column)
                        kind = self.record[field]
                        if kind.kind in "ui" and len(x) and not (np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max):
                            raise ValueError(f"{field} doesn't fit {kind}")
                        out[field] = x
                    out.tofile(f)
                    records += len(out)
        except BaseException:
            os.unlink(f"{self.folder}/_parts/{name}")  # a failed task leaves nothing
            raise
        return Written(name, records)

    def commit(self, messages) -> None:
        known = {} if self.overwrite else files_of(self.folder)
        for m in messages:
            if m is not None:
                os.replace(f"{self.folder}/_parts/{m.name}", f"{self.folder}/{m.name}")
                known[m.name] = m.records
        with open(f"{self.folder}/{DONE}.{self.run}", "w") as f:
            json.dump(known, f)
        os.replace(f"{self.folder}/{DONE}.{self.run}", f"{self.folder}/{DONE}")
        for name in os.listdir(self.folder):
            if name.endswith(".bin") and name not in known:
                os.unlink(f"{self.folder}/{name}")
        self.abort([])

    def abort(self, messages) -> None:
        parts = f"{self.folder}/_parts"
        for name in os.listdir(parts) if os.path.isdir(parts) else ():
            if f"-{self.run}-" in name:  # what lost attempts of this write have left
                os.unlink(f"{parts}/{name}")
        if os.path.isdir(parts) and not os.listdir(parts):
            shutil.rmtree(parts, ignore_errors=True)


def files_of(folder: str) -> dict[str, int]:
    """name -> records of the committed files."""
    if not os.path.exists(f"{folder}/{DONE}"):
        return {}
    with open(f"{folder}/{DONE}") as f:
        return json.load(f)


@dataclass
class Range(InputPartition):
    name: str
    first: int
    records: int


class PackedReader(DataSourceReader):
    def __init__(self, options):
        self.folder = _folder(options)
        self.record = LAYOUTS[options.get("layout", "triplet")][0]

    def partitions(self):
        out = [Range(name, at, min(SPLIT, n - at)) for name, n in sorted(files_of(self.folder).items()) for at in range(0, n, SPLIT)]
        return out or [Range("", 0, 0)]

    def read(self, partition):
        import pyarrow as pa

        for at in range(0, partition.records, BATCH):
            n = min(BATCH, partition.records - at)
            rows = np.fromfile(f"{self.folder}/{partition.name}", self.record, n, offset=(partition.first + at) * self.record.itemsize)
            if len(rows) < n:
                raise OSError(f"{partition.name} is shorter than its list says")
            fields = [pa.array(np.ascontiguousarray(rows[f]).astype(np.int32 if self.record[f].kind in "ui" else self.record[f])) for f in self.record.names]
            yield pa.RecordBatch.from_arrays(fields, names=list(self.record.names))


class Packed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed"

    def schema(self) -> str:
        return LAYOUTS[self.options.get("layout", "triplet")][1]

    def writer(self, schema, overwrite):
        return PackedWriter(self.options, overwrite)

    def reader(self, schema):
        return PackedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Packed)
